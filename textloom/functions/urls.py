"""URL expressions and page classification; sites are configuration."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hrefs that aren't followed, sections without articles, and markers of wiki pages without articles.
SKIP = ("action=edit", ".jpg", ".pdf", "facebook.com", "twitter.com")
NEWS_SECTIONS = ("/video/", "/audio/", "/gallery/", "/crosswords/")
NEWS_ARTICLE = "/[0-9]{4}/[a-z]{3}/[0-9]{1,2}/"
WIKI_MARKERS = ("File:", "Special:", "Talk:", "User:", "Template:", "Help:", "Wikipedia:", "Draft:", "Portal:", "Main_Page", "Template_talk:", "Category_talk:", "action=", "diff=", "oldid=")
UNKNOWN, CATEGORY, ARTICLE = "unknown", "category", "article"
HREF = "href=[\"']([^\"']+)[\"']"


@dataclass(frozen=True)
class Site:
    host: str
    label: str
    kind: str  # "wiki" or "news"


SITES = (Site("wikipedia.org", "wikipedia", "wiki"), Site("theguardian.com", "theguardian", "news"))


def normalize_url(url: Column) -> Column:
    """No fragment, no leading www., https where the scheme is missing; the rest as it is."""
    bare = F.regexp_replace(url, "#.*$", "")
    bare = F.regexp_replace(bare, r"^([a-zA-Z][a-zA-Z0-9+.-]*://)www\.", "$1")
    return F.when(bare.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), bare).when(bare.startswith("//"), F.concat(F.lit("https:"), F.regexp_replace(bare, r"^//www\.", "//"))).otherwise(F.concat(F.lit("https://"), bare))


def canonical_url(url: Column) -> Column:
    return F.regexp_replace(url, "[?#].*$", "")


def url_path(url: Column) -> Column:
    """Empty where there is none."""
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def any_of(text: Column, parts: Sequence[str]) -> Column:
    return text.rlike("|".join(re.escape(p) for p in parts))


def news_page_type(url: Column) -> Column:
    path = url_path(url)
    segments = F.size(F.split(F.regexp_replace(path, "^/+|/+$", ""), "/"))
    return F.when((path == "") | any_of(url, NEWS_SECTIONS), UNKNOWN).when(path.rlike(NEWS_ARTICLE), ARTICLE).when(segments <= 3, CATEGORY).otherwise(UNKNOWN)


def wiki_page_type(url: Column) -> Column:
    path = url_path(url)
    return F.when((path == "") | any_of(path, WIKI_MARKERS), UNKNOWN).when(path.contains("/Category:"), CATEGORY).when(path.startswith("/wiki/"), ARTICLE).otherwise(UNKNOWN)


def page_type(url: Column, sites: Sequence[Site] = SITES) -> Column:
    out = F.lit(UNKNOWN)
    for s in reversed(sites):
        out = F.when(url.contains(s.host), wiki_page_type(url) if s.kind == "wiki" else news_page_type(url)).otherwise(out)
    return out


def site_label(url: Column, sites: Sequence[Site] = SITES) -> Column:
    out = F.lit("")
    for s in reversed(sites):
        out = F.when(url.contains(s.host), F.lit(s.label)).otherwise(out)
    return out


def should_skip(href: Column) -> Column:
    return href.startswith("#") | any_of(F.lower(href), SKIP)


def matches(url: Column, pattern: str) -> Column:
    """False for a pattern that isn't valid."""
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(False)
    return url.rlike(pattern)


def should_follow(url: Column, follow: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """No excluded pattern matches, and one to follow does if there are any."""
    out = F.lit(not follow)
    for p in follow:
        out = out | matches(url, p)
    for p in exclude:
        out = out & ~matches(url, p)
    return out


def extract_links(html: Column, base: Column) -> Column:
    """http links as they are, root-relative ones behind scheme and host of base, no others; an array."""
    root = F.concat(F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1), F.lit("://"), F.regexp_extract(base, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    hrefs = F.filter(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)), lambda h: h.startswith("http") | h.startswith("/"))
    return F.transform(hrefs, lambda h: F.when(h.startswith("http"), h).otherwise(F.concat(root, h)))


def link_region(html: Column, url: Column, sites: Sequence[Site] = SITES) -> Column:
    """The part of a page whose links are followed: member lists of wiki categories, main of news categories, articles of other news pages, else nothing."""
    part = lambda pattern: F.array_join(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), " ")
    out, kind = F.lit(""), page_type(url, sites)
    for s in reversed(sites):
        if s.kind == "wiki":
            own = F.when(kind == CATEGORY, part('(?is)<div[^>]*id="mw-(?:pages|subcategories)"[^>]*>(.*?)</div>')).otherwise(F.lit(""))
        else:
            own = F.when(kind == CATEGORY, part("(?is)<main(?:\\s[^>]*)?>(.*?)</main>")).otherwise(part("(?is)<article(?:\\s[^>]*)?>(.*?)</article>"))
        out = F.when(url.contains(s.host), own).otherwise(out)
    return out
