"""Text expressions: HTML to text, white space, tokens, hashes."""

from __future__ import annotations

import json
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags whose content is no text, tags that begin with a space, and the entities of the fixture.
SKIPPED = ("head", "script", "style", "noscript", "iframe", "title")
BLOCKS = "p|div|h[1-6]|br|li|tr|td|th|article|section|header|footer|blockquote|pre"
ENTITIES = (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&nbsp;", " "), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
#: Fixed value: a token; extracted before lower-casing, so that only ASCII letters count.
WORD = "(?:[A-Za-z]+|[0-9]+)"
TOKEN = f"(?:{WORD}')*[0-9]+[.,][0-9]+(?:'{WORD})*|{WORD}(?:'{WORD})*"
SPACE = r"[ \t\n\r\f\x0B]+"
#: What an article's text leaves out, and where it ends.
ASIDES = r"(?is)<(figure|aside|script|style)(\s[^>]*)?>.*?</(figure|aside|script|style)\s*>"
ASIDE_CLASSES = ("dcr-citation", "element-atom", "mw-editsection")
ARTICLE_END = "Reuse this content"


def html_steps() -> list[tuple[str, str]]:
    """(pattern, replacement) in order, for any regex dialect without look-around."""
    tags = [(rf"(?is)<{t}(\s[^>]*)?>.*?</{t}\s*>", "") for t in SKIPPED]
    return [(r">\s+<", "><"), (r"(?s)<!--.*?-->", ""), *tags, (rf"(?i)<({BLOCKS})(\s[^>]*)?/?>", " "), (r"(?s)<[^>]*>", "")]


@lru_cache(maxsize=1)
def named_entities() -> str:
    """All entities of HTML 5 that end in a semicolon, as JSON of a map; the no-break space becomes a space."""
    return json.dumps({f"&{k}": v.replace("\u00a0", " ") for k, v in html5.items() if k.endswith(";")})


def code_point(number: Column) -> Column:
    """The character of a number; null where there is none."""
    ok = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))


def decode_entities(text: Column) -> Column:
    """Named, decimal and hexadecimal entities as their characters, each once: what "&amp;" leaves is no entity again. Unknown ones stay."""
    names = F.from_json(F.lit(named_entities()), "map<string,string>")

    def sign(e: Column) -> Column:
        hexed, digits = F.regexp_extract(e, "^&#[xX]([0-9A-Fa-f]{1,6});$", 1), F.regexp_extract(e, "^&#([0-9]{1,7});$", 1)
        number = F.when(hexed != "", F.conv(hexed, 16, 10)).when(digits != "", digits).cast("long")
        return F.coalesce(F.try_element_at(names, e), F.replace(code_point(number), F.lit("\u00a0"), F.lit(" ")), e)

    pieces = F.regexp_extract_all(text, F.lit("(&#?[0-9A-Za-z]+;|[^&]+|&)"), F.lit(1))
    out = F.array_join(F.transform(pieces, lambda p: F.when(p.startswith("&") & p.endswith(";"), sign(p)).otherwise(p)), "")
    return F.when(text.contains("&"), out).otherwise(text)


def html_text(html: Column) -> Column:
    """Visible text with entities decoded, before white space is cleaned."""
    out = html
    for pattern, new in html_steps():
        out = F.regexp_replace(out, pattern, new)
    return F.get(F.transform(F.array(out), decode_entities), F.lit(0))  # bound to a name, so that it is worked out once


def clean_text(text: Column) -> Column:
    """Runs of white space become a space; none at either end."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def html_to_text(html: Column) -> Column:
    return clean_text(html_text(html))


def article_html(html: Column) -> Column:
    """The main content: the first article, else main, else body, else everything. A heuristic in place of a readability model."""
    found = [F.nullif(F.regexp_extract(html, rf"(?is)<{t}(?:\s[^>]*)?>(.*)</{t}\s*>", 1), F.lit("")) for t in ("article", "main", "body")]
    return F.coalesce(*found, html)


def page_title(html: Column) -> Column:
    return clean_text(html_text(F.regexp_extract(html, r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>", 1)))


def article_text(html: Column) -> Column:
    """Text of an article without figures, asides and elements of ASIDE_CLASSES (up to the first end tag of their kind), up to ARTICLE_END."""
    rest = F.regexp_replace(html, ASIDES, "")
    for name in ASIDE_CLASSES:
        rest = F.regexp_replace(rest, rf"""(?is)<([a-z][a-z0-9]*)\s[^>]*?class\s*=\s*["'](?:[^"']*\s)?{name}(?:\s[^"']*)?["'][^>]*>.*?</\1\s*>""", "")
    text = html_to_text(rest)
    return F.trim(F.split_part(text, F.lit(ARTICLE_END), F.lit(1)))


def raw_tokens(text: Column) -> Column:
    """Lower-case tokens, in order, with duplicates."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1)), lambda t: F.lower(t))


def kept_tokens(stems: Column) -> Column:
    """Stems without apostrophes at their end; empty ones go."""
    return F.filter(F.transform(stems, lambda t: F.regexp_replace(t, "'+$", "")), lambda t: t != "")


def query_chunks(query: Column) -> Column:
    """A query's operators and the runs between them."""
    return F.regexp_extract_all(query, F.lit("([()!&|]|[^ ()!&|]+)"), F.lit(1))


def mean_length(raw: Column, kept: Column) -> Column:
    """Bytes of all tokens before stemming for each token kept; 0 if none is."""
    total = F.aggregate(raw, F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t))
    return F.when(F.size(kept) == 0, F.lit(0.0)).otherwise(total / F.size(kept))


def content_hash(text: Column) -> Column:
    return F.md5(text)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as a long."""
    hexes = F.hex(F.encode(text, "UTF-8"))
    at = F.when(F.length(hexes) > 0, F.sequence(F.lit(1), F.length(hexes) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    step = lambda h, i: (h.bitwiseXOR(F.conv(F.substring(hexes, i, F.lit(2)), 16, 10).cast("long")) * 16777619) % (1 << 32)
    return F.aggregate(at, F.lit(2166136261).cast("long"), step)


def varint_bytes(value: Column) -> Column:
    """Bytes of an unsigned number in groups of seven bits."""
    size = F.lit(5)
    for n, bits in ((4, 28), (3, 21), (2, 14), (1, 7)):
        size = F.when(value < (1 << bits), F.lit(n)).otherwise(size)
    return size


def fnv1a_of(word: str) -> int:
    h = 2166136261
    for b in word.encode():
        h = (h ^ b) * 16777619 % (1 << 32)
    return h


def pack_varints(numbers: Column) -> Column:
    """An array of numbers below 2^35 as bytes, each in groups of seven bits, the lowest first; all but a number's last byte have the high bit."""
    byte = lambda v, k: F.lpad(F.hex(F.shiftright(v, 7 * k).bitwiseAND(127) + F.when(v >= (1 << (7 * k + 7)), 128).otherwise(0)), 2, "0")
    one = lambda v: F.concat(*(F.when(varint_bytes(v) > k, byte(v, k)).otherwise(F.lit("")) for k in range(5)))
    return F.unhex(F.array_join(F.transform(numbers, lambda v: one(v.cast("long"))), ""))


def unpack_varints(packed: Column) -> Column:
    """The array again."""
    hexes = F.hex(packed)
    at = F.when(F.length(hexes) > 0, F.sequence(F.lit(1), F.length(hexes) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    kind = "struct<numbers:array<bigint>,now:bigint,unit:bigint>"
    zero = F.struct(F.array(), F.lit(0), F.lit(1)).cast(kind)

    def step(acc: Column, i: Column) -> Column:
        b = F.conv(F.substring(hexes, i, F.lit(2)), 16, 10).cast("long")
        now = acc["now"] + b.bitwiseAND(127) * acc["unit"]
        more = F.struct(acc["numbers"], now, acc["unit"] * 128).cast(kind)
        return F.when(b >= 128, more).otherwise(F.struct(F.concat(acc["numbers"], F.array(now)), F.lit(0), F.lit(1)).cast(kind))

    return F.aggregate(at, zero, step, lambda acc: acc["numbers"])
