"""The registered queries of the search and crawl engine, each beside its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as X
from .functions import urls as U
from .functions.stemmer import DUCKDB, stem_sql
from .operators import crawl, index, search, stats
from .plans import query_plan as plan
from .sources import store
from .storage import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id")).alias("url"), "text")


#: Folders of the indexes that this process has saved, by application, table, its state and kind of index.
STORED: dict[tuple, str] = {}


def table_state(spark: SparkSession, path: str) -> int:
    """The latest time of change under a path."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return max([fs.getFileStatus(root).getModificationTime(), *(x.getModificationTime() for x in fs.listStatus(root))])


def stored_index(spark: SparkSession, sf: str, pruned: bool = False, packed: bool = False) -> index.SearchIndex:
    """The saved index of documents, loaded. It is built when an application first asks for it, and again once the table has changed: searches read it, not the texts."""
    path = f"{sf}/documents.parquet"
    key = (spark.sparkContext.applicationId, path, table_state(spark, path), pruned, packed)
    if key not in STORED:
        folder = scratch(spark, "index")
        store.save_index(index.build_index(documents(spark, sf)), folder, packed=packed, pruned=pruned)
        STORED[key] = folder
    return store.load_index(spark, STORED[key])


# SQL building blocks
TOKENS = f"list_filter(list_transform(list_transform(regexp_extract_all(text, $r${X.TOKEN}$r$), lambda t: lower(t)), lambda t: rtrim(t, '''')), lambda t: t <> '')"
CTE = f"WITH tok AS (SELECT doc_id, {TOKENS} AS ts FROM documents), occ AS (SELECT doc_id, unnest(ts) AS term FROM tok), post AS (SELECT term, doc_id, count(*) AS tf FROM occ GROUP BY ALL)"
NSQL = "(SELECT count(*) FROM documents)"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def html_sql(column: str) -> str:
    out = column
    for pattern, new in X.html_steps():
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(new)}, 'g')"
    for entity, sign in X.ENTITIES:
        out = f"replace({out}, {quoted(entity)}, {quoted(sign)})"
    return f"trim(regexp_replace({out}, {quoted(X.SPACE)}, ' ', 'g'))"


@query(f"SELECT doc_id, md5(trim(regexp_replace(text, {quoted(X.SPACE)}, ' ', 'g'))) AS clean_md5 FROM documents")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(X.clean_text(F.col("text"))).alias("clean_md5"))


@query(f"SELECT page_id, {html_sql('html')} AS page_text FROM pages")
def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.html_to_text(F.col("html")).alias("page_text"))


@query(f"SELECT page_id, strlen({html_sql('html')}) > 200 AS long_enough FROM pages")
def length_gate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", (F.octet_length(X.html_to_text(F.col("html"))) > 200).alias("long_enough"))


@query(f"SELECT doc_id, len(ts)::INTEGER AS n_tokens FROM (SELECT doc_id, {TOKENS} AS ts FROM documents)")
def token_count(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.size(index.tokens(F.col("text"))).alias("n_tokens"))


@query(f"SELECT doc_id, array_to_string(ts, ' ') AS tokens FROM (SELECT doc_id, {TOKENS} AS ts FROM documents)")
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.array_join(index.tokens(F.col("text")), " ").alias("tokens"))


@query(f"SELECT doc_id, CASE WHEN len(ts) = 0 THEN 0.0 ELSE round(list_sum(list_transform(ts, lambda t: strlen(t)))::DOUBLE / len(ts), 6) END AS mean_length FROM (SELECT doc_id, {TOKENS} AS ts FROM documents)")
def avg_token_len(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).withColumn("raw", X.raw_tokens(F.col("text")))
    return docs.select("doc_id", F.round(X.mean_length(F.col("raw"), X.kept_tokens(F.col("raw"))), 6).alias("mean_length"))


@query("SELECT item_id, array_to_string(regexp_extract_all(text, '[()!&|]|[^ ()!&|]+'), '~') AS chunks FROM benchmark")
def query_split(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.array_join(X.query_chunks(F.col("text")), "~").alias("chunks"))


STEMMED = f"regexp_replace(list_extract({stem_sql('list_value(token)', DUCKDB)}, 1), '''+$', '')"


@query(f"{CTE}, vocab AS (SELECT DISTINCT term AS token FROM occ), s AS (SELECT token, {STEMMED} AS term FROM vocab) SELECT token, term FROM s WHERE term <> ''")
def stem_vocab(spark: SparkSession, sf: str) -> DataFrame:
    words = index.occurrences(documents(spark, sf)).select(F.regexp_replace("token", "'+$", "").alias("token")).where("token <> ''").distinct()
    return index.stem_vocabulary(words, "porter_expression")


@query(f"{CTE}, vocab AS (SELECT DISTINCT term AS token FROM occ), s AS (SELECT token, {STEMMED} AS term FROM vocab) SELECT token, term FROM s WHERE term <> ''")
def stem_vocab_vectorized(spark: SparkSession, sf: str) -> DataFrame:
    words = index.occurrences(documents(spark, sf)).select(F.regexp_replace("token", "'+$", "").alias("token")).where("token <> ''").distinct()
    return index.stem_vocabulary(words, "porter")


@query(f"{CTE} SELECT term AS token, count(*) AS frequency FROM occ GROUP BY term")
def tokens_freq(spark: SparkSession, sf: str) -> DataFrame:
    return stats.token_frequency(documents(spark, sf))


@query(f"{CTE} SELECT count(*) AS unique_tokens, round(avg(length(term)), 6) AS mean_token_length, sum(n)::BIGINT AS n_tokens, (SELECT sum(strlen(text)) FROM documents)::BIGINT AS text_bytes FROM (SELECT term, count(*) AS n FROM occ GROUP BY term)")
def vocab_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.vocabulary_stats(documents(spark, sf))


@query(f"{CTE}, f AS (SELECT term AS token, count(*) AS frequency FROM occ GROUP BY term) SELECT row_number() OVER (ORDER BY frequency DESC, token) AS rank, token, frequency, round(max(frequency) OVER () / (row_number() OVER (ORDER BY frequency DESC, token))::DOUBLE, 6) AS expected FROM f")
def zipf_table(spark: SparkSession, sf: str) -> DataFrame:
    return stats.zipf(stats.token_frequency(documents(spark, sf)))


@query(f"SELECT count(html) AS n_docs, sum(strlen(html))::BIGINT AS html_bytes, sum(strlen({html_sql('html')}))::BIGINT AS text_bytes FROM pages")
def corpus_report(spark: SparkSession, sf: str) -> DataFrame:
    return stats.corpus_report(table(spark, sf, "pages"))


@query(f"{CTE} SELECT term, doc_id, tf FROM post")
def postings_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    return index.build_index(documents(spark, sf)).postings


@query(f"{CTE} SELECT term, doc_id, 1::BIGINT AS tf FROM post")
def postings_boolean(spark: SparkSession, sf: str) -> DataFrame:
    return index.build_index(documents(spark, sf), boolean=True).postings


@query(f"{CTE}, v AS (SELECT token, {STEMMED} AS stem FROM (SELECT DISTINCT term AS token FROM occ)) SELECT stem AS term, doc_id, sum(tf)::BIGINT AS tf FROM post JOIN v ON post.term = v.token WHERE stem <> '' GROUP BY ALL")
def postings_porter(spark: SparkSession, sf: str) -> DataFrame:
    return index.build_index(documents(spark, sf), "porter").postings


@query(f"{CTE} SELECT term, count(*) AS df, string_agg(doc_id || ':' || tf, ' ' ORDER BY doc_id) AS postings FROM post GROUP BY term")
def posting_lists(spark: SparkSession, sf: str) -> DataFrame:
    lists = index.posting_lists(index.build_index(documents(spark, sf)).postings)
    return lists.select("term", "df", F.array_join(F.transform("postings", lambda p: F.concat(p["doc_id"], F.lit(":"), p["tf"])), " ").alias("postings"))


@query(f"{CTE} SELECT term, count(*) AS df FROM post GROUP BY term")
def doc_freq(spark: SparkSession, sf: str) -> DataFrame:
    return index.document_frequency(index.build_index(documents(spark, sf)).postings)


KEPT = f"kept AS (SELECT term, count(*) AS df FROM post GROUP BY term HAVING (count(*) > 1 OR arg_min(tf, doc_id) > 1) AND count(*) < 0.95 * {NSQL})"


@query(f"{CTE}, {KEPT} SELECT term, df FROM kept")
def index_prune(spark: SparkSession, sf: str) -> DataFrame:
    built = index.build_index(documents(spark, sf))
    return index.kept_terms(built.postings, built.total())


@query(f"{CTE} SELECT term, list_reduce(list_transform(string_split(term, ''), lambda c: ascii(c)::BIGINT), lambda h, b: (xor(h, b) * 16777619) % 4294967296, 2166136261::BIGINT) AS term_hash, count(*) AS df FROM post GROUP BY term")
def index_terms_hash(spark: SparkSession, sf: str) -> DataFrame:
    return index.term_directory(index.build_index(documents(spark, sf)).postings)


@query(f"{CTE} SELECT term, doc_id, tf, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term ORDER BY doc_id) AS gap FROM post")
def posting_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return index.with_gaps(index.build_index(documents(spark, sf)).postings)


@query(f"{CTE}, {KEPT} SELECT post.term, doc_id, tf FROM post SEMI JOIN kept ON post.term = kept.term")
def index_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return stored_index(spark, sf, pruned=True).postings


@query(f"{CTE}, {KEPT} SELECT post.term, doc_id, tf FROM post SEMI JOIN kept ON post.term = kept.term")
def packed_index_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return stored_index(spark, sf, pruned=True, packed=True).postings


LOOKED_UP = ("the", "of", "que", "les", "zzzzzz", "1")


@query(f"{CTE} SELECT term, list_reduce(list_transform(string_split(term, ''), lambda c: ascii(c)::BIGINT), lambda h, b: (xor(h, b) * 16777619) % 4294967296, 2166136261::BIGINT) AS term_hash, count(*) AS df FROM post WHERE term IN {LOOKED_UP} GROUP BY term")
def directory_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return stored_index(spark, sf).lookup(LOOKED_UP)


@query(f"{CTE} SELECT term AS token, count(*) AS frequency FROM occ GROUP BY term")
def frequency_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "frequency")
    store.write_frequency_csv(stats.token_frequency(documents(spark, sf)), path)
    return store.read_frequency_csv(spark, path)


VARINT = "CASE WHEN {0} < 128 THEN 1 WHEN {0} < 16384 THEN 2 WHEN {0} < 2097152 THEN 3 WHEN {0} < 268435456 THEN 4 ELSE 5 END"


@query(
    f"{CTE}, g AS (SELECT tf, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term ORDER BY doc_id) AS gap FROM post) SELECT count(*) AS n_postings, count(*) * 8 AS raw_bytes, sum({VARINT.format('gap')} + {VARINT.format('tf')})::BIGINT AS packed_bytes, "
    f"(SELECT count(DISTINCT term) FROM post) AS n_terms, (SELECT sum(strlen(term) + 1) FROM (SELECT DISTINCT term FROM post))::BIGINT AS term_bytes, {NSQL} AS n_docs, (SELECT sum(strlen('doc-' || doc_id) + 4) FROM documents)::BIGINT AS url_bytes FROM g"
)
def index_size_report(spark: SparkSession, sf: str) -> DataFrame:
    return index.size_report(index.build_index(documents(spark, sf)))


@query(f"{CTE} SELECT term, doc_id, tf FROM post WHERE term = 'the'")
def term_postings(spark: SparkSession, sf: str) -> DataFrame:
    return stored_index(spark, sf).get_postings("the").select(F.lit("the").alias("term"), "doc_id", "tf")


def sql_condition(text: str) -> str:
    """The SQL of a well-formed or ill-formed query, from the same postfix form."""
    stack: list[str] = []
    for p in plan.postfix(plan.infix(text)):
        if p == "!":
            if stack:
                stack.append(f"(NOT {stack.pop()})")
        elif p in plan.OPERATORS:
            if len(stack) >= 2:
                b, a = stack.pop(), stack.pop()
                if p != "(":
                    stack.append(f"({a} {'AND' if p == '&' else 'OR'} {b})")
        else:
            stack.append(f"list_contains(ts, {quoted(p)})")
    return stack[-1] if stack else "false"


@query(
    f"{CTE}, g AS (SELECT term, doc_id // {index.PACKED_ROWS} AS block, doc_id, tf, doc_id - lag(doc_id, 1, doc_id) OVER (PARTITION BY term, doc_id // {index.PACKED_ROWS} ORDER BY doc_id) AS gap FROM post) "
    f"SELECT term, min(doc_id) AS first, count(*)::INTEGER AS n, sum({VARINT.format('gap')})::INTEGER AS gap_bytes, sum({VARINT.format('tf')})::INTEGER AS tf_bytes FROM g GROUP BY term, block"
)
def packed_postings(spark: SparkSession, sf: str) -> DataFrame:
    packed = index.pack_postings(index.build_index(documents(spark, sf)).postings)
    return packed.select("term", "first", "n", F.octet_length("gaps").alias("gap_bytes"), F.octet_length("tfs").alias("tf_bytes"))


def register_search(name: str, text: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return search.boolean_search(stored_index(spark, sf), text)

    QUERIES[name] = run
    SQL[name] = f"{CTE} SELECT doc_id, 'doc-' || doc_id AS url, 0.0::DOUBLE AS score FROM tok WHERE {sql_condition(text)}"


for _name, _text in {
    "search_and": "the & and", "search_or": "que | les", "search_not": "!the", "search_nested": "(the | que) & !(of | les)", "search_implicit_and": "the of !and", "search_unbalanced": ")the of) & (and", "search_double_not": "the & !!of", "search_open_parenthesis": "the | (of",
    "search_missing_term": "the | zzzzzz & que",
}.items():
    register_search(_name, _text)


def tfidf_sql(text: str, post: str = "post", extra: str = "") -> str:
    terms = plan.terms_of(plan.infix(text))
    values = ", ".join(f"({quoted(t)}, {terms.count(t)})" for t in dict.fromkeys(terms))
    holds = sql_condition(text)
    if post != "post":
        holds = "true" if len(set(terms)) == 1 else holds
    return (
        f"{CTE}{extra}, q(term, n) AS (VALUES {values}), df AS (SELECT term, count(*) AS df FROM {post} GROUP BY term), s AS (SELECT doc_id, sum(n * (1 + ln(tf)) * ln({NSQL}::DOUBLE / (1 + df))) AS s FROM {post} JOIN q USING (term) JOIN df USING (term) GROUP BY doc_id), "
        f"r AS (SELECT doc_id, 'doc-' || doc_id AS url, round(coalesce(s, 0.0), 6) AS score FROM tok LEFT JOIN s USING (doc_id) WHERE {holds}) SELECT * FROM (SELECT doc_id, url, score, row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS rank FROM r) WHERE rank <= 10"
    )


def register_tfidf(name: str, text: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return search.search(stored_index(spark, sf), text)

    QUERIES[name] = run
    SQL[name] = tfidf_sql(text)


for _name, _text in {"tfidf_top10": "the & on", "tfidf_with_not": "que !les", "tfidf_dup_term": "of of that", "tfidf_or": "der | les | que"}.items():
    register_tfidf(_name, _text)


@query(tfidf_sql("that | les", "pruned", f", {KEPT}, pruned AS (SELECT post.* FROM post SEMI JOIN kept ON post.term = kept.term)").replace("WHERE (list_contains(ts, 'that') OR list_contains(ts, 'les'))", "WHERE doc_id IN (SELECT doc_id FROM pruned WHERE term IN ('that', 'les'))"))
def tfidf_pruned(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(stored_index(spark, sf, pruned=True), "that | les")


@query(f"{CTE} SELECT doc_id, tf FROM post WHERE term = 'the' AND doc_id IN (SELECT doc_id FROM post WHERE term = 'of')")
def set_intersect(spark: SparkSession, sf: str) -> DataFrame:
    built = stored_index(spark, sf)
    return search.intersect_lists(built.get_postings("the"), built.get_postings("of"))


@query(f"{CTE} SELECT doc_id, coalesce(max(tf) FILTER (WHERE term = 'the'), max(tf)) AS tf FROM post WHERE term IN ('the', 'que') GROUP BY doc_id")
def set_union(spark: SparkSession, sf: str) -> DataFrame:
    built = stored_index(spark, sf)
    return search.union_lists(built.get_postings("the"), built.get_postings("que"))


@query(f"{CTE} SELECT doc_id, 0::BIGINT AS tf FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM post WHERE term = 'the')")
def set_complement(spark: SparkSession, sf: str) -> DataFrame:
    built = stored_index(spark, sf)
    return search.not_list(built.get_postings("the"), built.docs)


NORMAL = r"CASE WHEN regexp_matches({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN regexp_replace(regexp_replace({0}, '#.*$', ''), '^([a-zA-Z][a-zA-Z0-9+.-]*://)www\.', '\1') ELSE 'https://' || regexp_replace({0}, '#.*$', '') END"


@query(f"SELECT page_id, {NORMAL.format('u')} AS normalized FROM (SELECT page_id, replace(url, '://', '://www.') || '?b=1#c' AS u FROM pages)")
def url_normalize(spark: SparkSession, sf: str) -> DataFrame:
    u = F.concat(F.replace(F.col("url"), F.lit("://"), F.lit("://www.")), F.lit("?b=1#c"))
    return table(spark, sf, "pages").select("page_id", U.normalize_url(u).alias("normalized"))


@query("SELECT page_id, regexp_replace(url || '?q=1#top', '[?#].*$', '') AS canonical FROM pages")
def url_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", U.canonical_url(F.concat("url", F.lit("?q=1#top"))).alias("canonical"))


#: Hosts of the fixture stand in for the two kinds of site.
FIXTURE_SITES = (U.Site("example.org", "wiki", "wiki"), U.Site("example.com", "news", "news"))
PATH = r"regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
NEWS = f"CASE WHEN {PATH} = '' OR regexp_matches(url, '{'|'.join(U.NEWS_SECTIONS)}') THEN 'unknown' WHEN regexp_matches({PATH}, '{U.NEWS_ARTICLE}') THEN 'article' WHEN len(string_split(regexp_replace({PATH}, '^/+|/+$', '', 'g'), '/')) <= 3 THEN 'category' ELSE 'unknown' END"
WIKI = f"CASE WHEN {PATH} = '' OR regexp_matches({PATH}, '{'|'.join(U.WIKI_MARKERS)}') THEN 'unknown' WHEN contains({PATH}, '/Category:') THEN 'category' WHEN starts_with({PATH}, '/wiki/') THEN 'article' ELSE 'unknown' END"


@query(f"SELECT page_id, CASE WHEN contains(url, 'example.org') THEN {WIKI} WHEN contains(url, 'example.com') THEN {NEWS} ELSE 'unknown' END AS page_type, CASE WHEN contains(url, 'example.org') THEN 'wiki' WHEN contains(url, 'example.com') THEN 'news' ELSE '' END AS label FROM pages")
def page_type(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", U.page_type(F.col("url"), FIXTURE_SITES).alias("page_type"), U.site_label(F.col("url"), FIXTURE_SITES).alias("label"))


LINKS = "links AS (SELECT page_id, url, unnest(list_filter(regexp_extract_all(html, 'href=[\"'']([^\"'']+)[\"'']', 1), lambda h: starts_with(h, 'http') OR starts_with(h, '/'))) AS h FROM pages), whole AS (SELECT page_id, url, CASE WHEN starts_with(h, 'http') THEN h ELSE regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || h END AS link FROM links)"


@query(f"WITH {LINKS} SELECT page_id, link FROM whole")
def link_extract(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.explode(U.extract_links(F.col("html"), F.col("url"))).alias("link"))


SKIPS = r"(starts_with(link, '#') OR regexp_matches(lower(link), 'action=edit|\.jpg|\.pdf|facebook\.com|twitter\.com'))"


@query(f"WITH {LINKS} SELECT DISTINCT url, regexp_replace(link, '[?#].*$', '') AS link FROM whole WHERE NOT {SKIPS}")
def link_filter(spark: SparkSession, sf: str) -> DataFrame:
    return crawl.page_links(table(spark, sf, "pages"))


@query(f"WITH {LINKS} SELECT page_id, link, NOT regexp_matches(link, 'about') AND regexp_matches(link, '/[a-m]') AS follow FROM whole")
def should_follow(spark: SparkSession, sf: str) -> DataFrame:
    return link_extract(spark, sf).withColumn("follow", U.should_follow(F.col("link"), ["/[a-m]", "("], ["about"]))


REGION = r"array_to_string(regexp_extract_all(html, '(?is)<article(?:\s[^>]*)?>(.*?)</article>', 1), ' ')"
MEMBERS = """array_to_string(regexp_extract_all(html, '(?is)<div[^>]*id="mw-(?:pages|subcategories)"[^>]*>(.*?)</div>', 1), ' ')"""
MAIN = r"array_to_string(regexp_extract_all(html, '(?is)<main(?:\s[^>]*)?>(.*?)</main>', 1), ' ')"
FOLLOWED = f"CASE WHEN contains(url, 'example.org') THEN CASE WHEN {WIKI} = 'category' THEN {MEMBERS} ELSE '' END WHEN contains(url, 'example.com') THEN CASE WHEN {NEWS} = 'category' THEN {MAIN} ELSE {REGION} END ELSE '' END"


@query(f"SELECT page_id, md5({FOLLOWED}) AS region_md5 FROM pages")
def link_regions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.md5(U.link_region(F.col("html"), F.col("url"), FIXTURE_SITES)).alias("region_md5"))


@query("SELECT page_id, md5(html) AS content_hash FROM pages")
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.content_hash(F.col("html")).alias("content_hash"))


@query("SELECT md5(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_content(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(X.content_hash(F.col("text")).alias("content_hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def scrape_log(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as a scrape log: a turn is a scrape at 2 * turn, and an even turn is scraped again unchanged."""
    rows = table(spark, sf, "conversations").select(F.concat(F.lit("conv-"), "conv_id").alias("normalized_url"), "turn", F.col("role").alias("title"), F.col("text").alias("html_content"))
    again = rows.where("turn % 2 = 0").withColumn("ts", F.col("turn") * 2 + 1)
    return rows.withColumn("ts", F.col("turn") * 2).unionByName(again).drop("turn")


LOG = "log AS (SELECT 'conv-' || conv_id AS k, 2 * turn AS ts, role, text, md5(text) AS h FROM conversations UNION ALL SELECT 'conv-' || conv_id, 2 * turn + 1, role, text, md5(text) FROM conversations WHERE turn % 2 = 0)"


@query(
    f"WITH {LOG}, c AS (SELECT *, h IS DISTINCT FROM lag(h) OVER (PARTITION BY k ORDER BY ts) AS changed FROM log) SELECT k AS normalized_url, arg_max(role, ts) FILTER (WHERE changed) AS title, arg_max(h, ts) FILTER (WHERE changed) AS content_hash, arg_max(strlen(text), ts) FILTER (WHERE changed)::INTEGER AS content_length, "
    "min(ts) AS first_scraped, max(ts) AS last_scraped, max(ts) FILTER (WHERE changed) AS last_modified, count(*) AS scraped_count FROM c GROUP BY k"
)
def crawl_upsert_state(spark: SparkSession, sf: str) -> DataFrame:
    return crawl.fold_scrapes(scrape_log(spark, sf)).drop("html_content")


#: A fixed moment and threshold for the stale selection over events.
NOW, HOURS = 1_800_000_000, 24


def visits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.concat(F.lit("user-"), "user_id").alias("normalized_url")).agg(F.max(F.unix_timestamp("ts")).alias("last_scraped"))


@query(f"SELECT normalized_url, last_scraped FROM (SELECT 'user-' || user_id AS normalized_url, floor(epoch(max(ts)))::BIGINT AS last_scraped FROM events GROUP BY user_id) WHERE last_scraped < {NOW} - {HOURS} * 3600 ORDER BY last_scraped, normalized_url LIMIT 200")
def stale_pages(spark: SparkSession, sf: str) -> DataFrame:
    return crawl.stale_documents(visits(spark, sf), NOW, HOURS)


@query("SELECT 'user-' || user_id AS normalized_url, floor(epoch(max(ts)))::BIGINT AS last_scraped FROM events WHERE user_id = 7 GROUP BY user_id")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return crawl.get_document(visits(spark, sf), "user-7")


@query("SELECT 'conv-' || c AS normalized_url FROM (SELECT DISTINCT conv_id AS c FROM conversations) SEMI JOIN documents ON c = doc_id")
def existing_keys(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "conversations").select(F.concat(F.lit("conv-"), "conv_id").alias("normalized_url")).distinct()
    return crawl.document_exists(keys, table(spark, sf, "documents").select(F.concat(F.lit("conv-"), "doc_id").alias("normalized_url")))


@query(
    f"WITH {LINKS}, edges AS (SELECT DISTINCT url, regexp_replace(link, '[?#].*$', '') AS link FROM whole WHERE NOT {SKIPS}), d0 AS (SELECT url, 0 AS depth FROM pages WHERE page_id = 0), d1 AS (SELECT DISTINCT link AS url, 1 AS depth FROM edges JOIN d0 USING (url) WHERE link NOT IN (SELECT url FROM d0)), "
    "d2 AS (SELECT DISTINCT link AS url, 2 AS depth FROM edges JOIN d1 USING (url) WHERE link NOT IN (SELECT url FROM d0 UNION SELECT url FROM d1)) SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2"
)
def visited_frontier(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return crawl.discover(pages, pages.where("page_id = 0").select("url"), max_depth=2)


SITE_LINKS = f"parts AS (SELECT page_id, url, {FOLLOWED} AS html FROM pages), {LINKS.replace('FROM pages', 'FROM parts')}"
SITE_TYPE = f"CASE WHEN contains(url, 'example.org') THEN {WIKI} WHEN contains(url, 'example.com') THEN {NEWS} ELSE 'unknown' END"


@query(
    f"WITH {SITE_LINKS}, named AS (SELECT DISTINCT url AS src, regexp_replace(link, '[?#].*$', '') AS url FROM whole WHERE NOT {SKIPS}), edges AS (SELECT src, url FROM named WHERE {SITE_TYPE} <> 'unknown'), d0 AS (SELECT url, 0 AS depth FROM pages WHERE page_id % 10 = 0), "
    "d1 AS (SELECT DISTINCT e.url, 1 AS depth FROM edges e JOIN d0 ON d0.url = src), d2 AS (SELECT DISTINCT e.url, 2 AS depth FROM edges e JOIN d1 ON d1.url = src WHERE e.url NOT IN (SELECT url FROM d1)) SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2"
)
def discover_sites(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return crawl.discover(pages, pages.where("page_id % 10 = 0").select("url"), max_depth=2, sites=FIXTURE_SITES, mark_seeds=False)


@query("SELECT 'https://example.com/sport?page=' || i AS url FROM range(100) r(i) UNION ALL VALUES ('https://example.com/sport'), ('https://example.org/wiki/Category:Sports')")
def seed_urls(spark: SparkSession, sf: str) -> DataFrame:
    return store.seed_urls(spark, "https://example.com/sport", 100, "https://example.org/wiki/Category:Sports")


@query(f"WITH {LOG} SELECT k AS normalized_url, ts, h IS DISTINCT FROM lag(h) OVER (PARTITION BY k ORDER BY ts) AS changed FROM log")
def scrape_changes(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("normalized_url").orderBy("ts")
    rows = scrape_log(spark, sf).withColumn("h", X.content_hash(F.col("html_content")))
    return rows.select("normalized_url", "ts", (~F.col("h").eqNullSafe(F.lag("h").over(order))).alias("changed"))
