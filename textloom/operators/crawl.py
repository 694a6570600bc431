"""Crawl state and frontier over tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import article_html, article_text, content_hash, page_title

STATE = "normalized_url string, title string, html_content string, content_hash string, content_length int, first_scraped long, last_scraped long, last_modified long, scraped_count long"


def fold_scrapes(scrapes: DataFrame) -> DataFrame:
    """scrapes(normalized_url, ts, title, html_content) -> the state after upserting them in order of ts.

    An unchanged hash only moves last_scraped and the count; a changed one takes title, content, hash, length and last_modified.
    """
    rows = scrapes.withColumn("content_hash", content_hash(F.col("html_content")))
    order = Window.partitionBy("normalized_url").orderBy("ts", "content_hash")
    rows = rows.withColumn("_changed", ~F.col("content_hash").eqNullSafe(F.lag("content_hash").over(order)) | (F.row_number().over(order) == 1))
    at = F.struct("ts", "content_hash")
    last = lambda c: F.max_by(c, F.when(F.col("_changed"), at))
    return rows.groupBy("normalized_url").agg(
        last("title").alias("title"), last("html_content").alias("html_content"), last("content_hash").alias("content_hash"), last(F.octet_length("html_content")).alias("content_length"),
        F.min("ts").alias("first_scraped"), F.max("ts").alias("last_scraped"), F.max(F.when(F.col("_changed"), F.col("ts"))).alias("last_modified"), F.count(F.lit(1)).alias("scraped_count"),
    )


def merge_state(state: DataFrame, scrapes: DataFrame) -> DataFrame:
    """State after more scrapes, all of them later than the state's own."""
    new = fold_scrapes(scrapes)
    first = scrapes.groupBy("normalized_url").agg(F.min_by(content_hash(F.col("html_content")), F.struct("ts", content_hash(F.col("html_content")).alias("h"))).alias("_first_hash"), F.countDistinct(content_hash(F.col("html_content"))).alias("_kinds"))
    both = new.join(first, "normalized_url").alias("n").join(state.alias("o"), "normalized_url", "full")
    old, fresh = F.col("o.content_hash").isNotNull(), F.col("n.content_hash").isNotNull()
    same = (F.col("_first_hash") == F.col("o.content_hash")) & (F.col("_kinds") == 1)
    take = lambda c: F.when(fresh & ~(old & same), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    kept = [take(c).alias(c) for c in ("title", "html_content", "content_hash", "content_length")]
    return both.select(
        "normalized_url", *kept, F.coalesce("o.first_scraped", "n.first_scraped").alias("first_scraped"), F.greatest("o.last_scraped", "n.last_scraped").alias("last_scraped"),
        take("last_modified").alias("last_modified"), (F.coalesce("o.scraped_count", F.lit(0)) + F.coalesce("n.scraped_count", F.lit(0))).alias("scraped_count"),
    )


def stale_documents(state: DataFrame, now: int, hours: int, limit: int = 200) -> DataFrame:
    """Keys scraped before now - hours, the oldest first."""
    return state.where(F.col("last_scraped") < now - hours * 3600).orderBy("last_scraped", "normalized_url").limit(limit).select("normalized_url", "last_scraped")


def get_document(state: DataFrame, key: str) -> DataFrame:
    return state.where(F.col("normalized_url") == key).limit(1)


def document_exists(keys: DataFrame, state: DataFrame) -> DataFrame:
    """Those of keys(normalized_url) that the state has."""
    return keys.join(state.select("normalized_url"), "normalized_url", "left_semi")


def extract_articles(pages: DataFrame, sites: Sequence[urls.Site] = urls.SITES, least_bytes: int = 200) -> DataFrame:
    """Pages of type article with more than least_bytes of clean text, as scrapes; ``ts`` is carried along where pages have it."""
    rows = pages.where(urls.page_type(F.col("url"), sites) == urls.ARTICLE).withColumn("html_content", article_html(F.col("html")))
    rows = rows.withColumn("text", article_text(F.col("html_content"))).where(F.octet_length("text") > least_bytes)
    when = ["ts"] if "ts" in pages.columns else []
    return rows.select(urls.normalize_url(F.col("url")).alias("normalized_url"), "url", urls.site_label(F.col("url"), sites).alias("source"), *when, page_title(F.col("html")).alias("title"), "html_content", "text")


#: Answers that a crawl passes over without a word, beside those that robots.txt forbids.
SILENT_STATUS = (429,)


def scrape_outcome(pages: DataFrame, sites: Sequence[urls.Site] = urls.SITES, least_bytes: int = 200) -> DataFrame:
    """Adds ``outcome`` to pages(url, html, status, error): saved, blocked, throttled, failed, unknown_type, not_an_article or too_short. All but saved are the dead letters; nothing is tried again."""
    kind = urls.page_type(F.col("url"), sites)
    long_enough = F.coalesce(F.octet_length(article_text(article_html(F.col("html")))) > least_bytes, F.lit(False))
    failed = F.col("error").isNotNull() | F.col("html").isNull() | ~F.coalesce(F.col("status"), F.lit(200)).between(200, 299)
    return pages.withColumn(
        "outcome",
        F.when(F.lower("error").contains("robots"), "blocked").when(F.col("status").isin(*SILENT_STATUS), "throttled").when(failed, "failed")
        .when(kind == urls.UNKNOWN, "unknown_type").when(kind != urls.ARTICLE, "not_an_article").when(~long_enough, "too_short").otherwise("saved"),
    )


def crawl_counters(outcomes: DataFrame) -> DataFrame:
    """(outcome, pages): what a run reports at its end."""
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("pages"))


def recrawl(state: DataFrame, fetched: DataFrame, now: int, hours: int, batch: int | None = None, sites: Sequence[urls.Site] = urls.SITES, least_bytes: int = 200) -> DataFrame:
    """The state after one pass over what is stale at now: every stale key at most once, batch keys if given, so that pages which fail or are too short can't keep it going.

    fetched(url, html): what the keys hold now. Links aren't expanded.
    """
    stale = state.where(F.col("last_scraped") < now - hours * 3600).select("normalized_url")
    if batch is not None:
        stale = stale_documents(state, now, hours, batch).select("normalized_url")
    rows = extract_articles(fetched, sites, least_bytes).join(stale, "normalized_url", "left_semi").dropDuplicates(["normalized_url"])
    return merge_state(state, rows.select("normalized_url", F.lit(now).cast("long").alias("ts"), "title", "html_content"))


def page_links(pages: DataFrame, sites: Sequence[urls.Site] | None = None) -> DataFrame:
    """(url, link): distinct canonical links that aren't skipped; with sites only those in a page's region that lead to a known type of page."""
    html = F.col("html") if sites is None else urls.link_region(F.col("html"), F.col("url"), sites)
    found = pages.select("url", F.explode(urls.extract_links(html, F.col("url"))).alias("link"))
    found = found.where(~urls.should_skip(F.col("link"))).select("url", urls.canonical_url(F.col("link")).alias("link")).distinct()
    return found if sites is None else found.where(urls.page_type(F.col("link"), sites) != urls.UNKNOWN)


def within_cap(requests: DataFrame, saved: int, max_pages: int) -> DataFrame:
    """requests(url, depth, is_recrawl): recrawls, and as many others as pages are still allowed, the nearest first."""
    fresh = requests.where("NOT is_recrawl").orderBy("depth", "url").limit(max(0, max_pages - saved))
    return requests.where("is_recrawl").unionByName(fresh)


def expand(frontier: DataFrame, links: DataFrame, visited: DataFrame, max_depth: int) -> DataFrame:
    """(url, depth) of the links of frontier(url, depth) that aren't visited; pages at max_depth and recrawled ones don't expand."""
    open_ = frontier.where(F.col("depth") < max_depth)
    if "is_recrawl" in frontier.columns:
        open_ = open_.where("NOT is_recrawl")
    new = open_.join(links, "url").groupBy(F.col("link").alias("url")).agg((F.min("depth") + 1).alias("depth"))
    return new.join(visited, "url", "left_anti")


def discover(pages: DataFrame, seeds: DataFrame, max_depth: int = 2, max_pages: int | None = None, checkpoint_every: int = 5, sites: Sequence[urls.Site] | None = None, mark_seeds: bool = True) -> DataFrame:
    """(url, depth) reached from seeds(url) over pages, breadth first; rounds are depth, and lineage is cut by checkpoint() where a checkpoint folder is set.

    With sites only links of a page's region to known types of pages count. Without mark_seeds a seed that is linked to is reached again, a row of its own.
    """
    spark = pages.sparkSession
    links = page_links(pages, sites).persist()
    frontier = seeds.select("url", F.lit(0).alias("depth"))
    first = frontier
    visited = frontier if mark_seeds else frontier.where(F.lit(False))
    for hop in range(max_depth):
        frontier = expand(frontier, links, visited.select("url"), max_depth).persist()
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
        if (hop + 1) % checkpoint_every == 0 and spark.sparkContext.getCheckpointDir():
            visited = visited.checkpoint()
    visited = visited if mark_seeds else first.unionByName(visited)
    return visited if max_pages is None else visited.orderBy("depth", "url").limit(max_pages)
