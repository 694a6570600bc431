"""Goldens, laws and round trips of the search engine and crawl state."""

from __future__ import annotations

import hashlib
import html
import html.entities
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom import queries
from textloom.functions import urls as U
from textloom.functions.stemmer import Rules, stem_array, stem_words
from textloom.functions.text import article_text, decode_entities, fnv1a, fnv1a_of, html_to_text
from textloom.operators import crawl, index, search, stats
from textloom.plans import query_plan as plan
from textloom.sources import store
from textloom.sources.config import load_config, parse_yaml
from textloom.streaming.crawl_stream import StateTable, crawl_stream, read_pages, report, upsert_stream

#: Words for each rule of the stemmer, with what the rules make of them.
STEMS = {
    "plurals": {"glasses": "glass", "berries": "berri", "moss": "moss", "lamps": "lamp"},
    "past and -ing": {"freed": "free", "planted": "plant", "sled": "sled", "singing": "sing", "bring": "bring"},
    "restored ends": {"inflated": "infl", "tumbled": "tumbl", "prized": "prize", "dropped": "drop", "fizzed": "fizz", "filing": "file"},
    "final y": {"lucky": "lucki", "cry": "cry", "yearly": "yearli"},
    "step 2": {"sensational": "sens", "fluency": "fluenc", "organizer": "organ"},
    "step 3": {"duplicate": "dupl", "playful": "play", "kindness": "kind"},
    "step 4": {"payment": "pay", "adoption": "adopt", "million": "million"},
    "final e and l": {"cease": "ceas", "rate": "rate", "controll": "control", "roll": "roll"},
    "short or empty": {"is": "is", "ox": "ox", "ful": "", "ness": "", "ative": ""},
}
TOKENS = {
    "rain; sun: wind?": "rain sun wind", "half-open isn't 2.5 7,500": "half open isn't 2.5 7,500", "Route 66b": "route 66 b", "v4.5.6": "v 4.5 6", "Größe": "gr e",
    "x'9": "x'9", "x''y": "x y", "12,34,56": "12,34 56", "8'1.5": "8'1.5", "?!": "", "": "", "dogs' bowl'": "dogs bowl",
}
COLOURS = [(0, "a", "red green"), (1, "b", "green blue"), (2, "c", "red blue pink")]


def indexed(spark, rows, **k):
    return index.build_index(spark.createDataFrame(rows, "doc_id long, url string, text string"), **k)


def found(idx, q):
    return [r["doc_id"] for r in search.boolean_search(idx, q).collect()]


def test_stems(spark):
    for rule, words in STEMS.items():
        assert {w: Rules()(w) for w in words} == words, rule
    g = random.Random(1)
    fuzz = ["".join(g.choices("aeiouybcdlnrstzxw'1", k=g.randint(1, 6))) + g.choice(["", "ed", "ing", "ational", "ness", "ion", "y", "lly", "ies", "ement", "izer"]) for _ in range(4000)]
    want = list(map(Rules(), fuzz))
    assert stem_words(pa.array(fuzz)).to_pylist() == want
    df = spark.createDataFrame([(fuzz[:2000],)], "w array<string>")
    assert df.select(stem_array("w")).first()[0] == want[:2000]
    assert stem_words(pa.array([], pa.string())).to_pylist() == []


def test_tokens(spark):
    df = spark.createDataFrame(list(TOKENS.items()), "text string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", F.array_join(index.tokens(F.col("text")), " ").alias("got")).collect())
    assert all(" ".join(plan.tokenize(t)) == want for t, want in TOKENS.items())


def test_html(spark):
    df = spark.createDataFrame([("<html><head><title>T</title></head><body><p>a</p>b<script>x()</script><b>c</b> <i>d</i>&amp;lt;</body></html>",)], "html string")
    assert df.select(html_to_text(F.col("html"))).first()[0] == "abcd&lt;"
    assert df.select(article_text(F.lit("<p>x</p><aside>no</aside> y Reuse this content z"))).first()[0] == "x y"


@pytest.mark.parametrize(
    ("query", "rpn"),
    [("a | b & c", "a b c & |"), ("apple !banana", "apple banana ! &"), ("!well-known", "well ! known &"), ("!!a", "! a !"), ("a & !!b", "a ! b ! &"), ("a (b", "a b ( &"), ("a | (b", "a b ( |"), ("(a b", "a b & ("), (")a b", "a & b &"), ("a b)", "a b &"), ("a & & b", "a & b &"), ("& a", "a &"), ("a !", "a ! &"), ("()", ""), ("", "")],
)
def test_postfix(query, rpn):
    assert " ".join(plan.postfix(plan.infix(query))) == rpn


def test_search(spark):
    colours = indexed(spark, COLOURS)
    for q, want in {"red": [0, 2], "red blue": [2], "red | green": [0, 1, 2], "!green": [2], "grey": [], "a (b": [], "red (blue": [], "(red blue": [2], "": [], "!grey": [0, 1, 2], "red | !blue": [0, 2]}.items():
        assert found(colours, q) == want, q
    tf = indexed(spark, [(0, "a", "red red green"), (1, "b", "red blue")])
    assert [r["url"] for r in search.search(tf, "red").collect()] == ["b", "a"]  # the idf of a term of all documents is negative
    assert colours.get_url(9) == "" and colours.n_terms() == 4


def test_scores_are_those_of_the_formula(spark):
    docs = [(k, f"u{k}", " ".join(random.Random(k).choices(["red", "green", "blue", "pink"], k=k))) for k in range(12)]
    idx = indexed(spark, docs)
    df = {t: sum(t in d[2].split() for d in docs) for t in ("red", "pink")}
    weight = lambda text, t: (1 + math.log(text.split().count(t))) * math.log(len(docs) / (1 + df[t])) if t in text.split() else 0.0
    got = {r["doc_id"]: r["score"] for r in search.tfidf_search(idx, "red | red !pink").collect()}
    for k, _, text in docs:
        here, pink = "red" in text.split(), "pink" in text.split()
        assert (k in got) == (here or (here and not pink))
        if k in got:
            assert abs(got[k] - 2 * weight(text, "red") - weight(text, "pink")) < 1e-5


def test_random_queries_select_what_sets_do(spark):
    g = random.Random(2)
    docs = [(k, f"u{k}", " ".join(g.sample("abcd", g.randint(0, 4)))) for k in range(20)]
    idx = indexed(spark, docs)
    idx = type(idx)(idx.docs.cache(), idx.postings.cache())
    for _ in range(25):
        q = " ".join(g.choices(["a", "b", "c", "d", "&", "|", "!", "(", ")"], k=g.randint(1, 6)))
        stack: list[set] = []
        everything = {d[0] for d in docs}
        for p in plan.postfix(plan.infix(q)):
            if p == "!":
                stack.append(everything - stack.pop()) if stack else None
            elif p in plan.OPERATORS:
                if len(stack) > 1:
                    y, x = stack.pop(), stack.pop()
                    stack.append(x & y if p == "&" else x | y) if p != "(" else None
            else:
                stack.append({d[0] for d in docs if p in d[2].split()})
        assert found(idx, q) == sorted(stack[-1] if stack else set()), q


def test_laws(spark):
    a, b = (spark.createDataFrame([(i, 1) for i in s], "doc_id long, tf long") for s in ((1, 3, 5), (2, 3, 4)))
    docs = spark.range(6).withColumnRenamed("id", "doc_id")
    ids = lambda d: sorted(r["doc_id"] for r in d.collect())
    assert ids(search.intersect_lists(a, b)) == [3] and ids(search.union_lists(a, b)) == [1, 2, 3, 4, 5] and ids(search.not_list(a, docs)) == [0, 2, 4]
    assert ids(search.not_list(search.union_lists(a, b), docs)) == ids(search.intersect_lists(search.not_list(a, docs), search.not_list(b, docs)))


def test_prune_and_store(spark, tmp_path):
    idx = indexed(spark, [(0, "url1", "shared twice twice"), (1, "url2", "shared once")])
    assert found(index.prune(idx), "shared") == [] and found(index.prune(idx, None), "shared") == [0, 1]
    assert found(index.prune(idx), "twice") == [0] and found(index.prune(idx), "once") == []
    for packed in (False, True):
        store.save_index(idx, f"{tmp_path}/{packed}", packed)
        loaded = store.load_index(spark, f"{tmp_path}/{packed}")
        assert found(loaded, "twice") == [0] and found(loaded, "once") == []
        store.save_index(idx, f"{tmp_path}/{packed}-whole", packed, pruned=False)
        whole = store.load_index(spark, f"{tmp_path}/{packed}-whole")
        assert found(whole, "shared !once") == [0] and {r["term"]: r["df"] for r in whole.lookup(["shared", "twice", "grey"]).collect()} == {"shared": 2, "twice": 1}
    with pytest.raises(Exception):
        store.load_index(spark, f"{tmp_path}/missing")


def test_saved_postings_are_read_by_term(spark, tmp_path):
    store.save_index(indexed(spark, COLOURS), f"{tmp_path}/i", pruned=False)
    plan_text = search.evaluated(store.load_index(spark, f"{tmp_path}/i"), "red & blue")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [blue,red])" in plan_text and "text" not in plan_text


def test_packed_postings_come_back(spark):
    g = random.Random(3)
    rows = [(t, d, g.choice([1, 2, 127, 128, 70_000])) for t in ("a", "b") for d in sorted(g.sample(range(20_000), 300))]
    postings = spark.createDataFrame(rows, "term string, doc_id long, tf long")
    packed = index.pack_postings(postings)
    assert sorted(map(tuple, index.unpack_postings(packed).collect())) == sorted(rows)
    assert packed.agg(F.max("n")).first()[0] <= index.PACKED_ROWS and packed.count() == 10
    size = lambda v: max(1, -(-v.bit_length() // 7))
    assert packed.agg(F.sum(F.length("tfs"))).first()[0] == sum(size(r[2]) for r in rows)


def test_own_stemmer(spark, tmp_path):
    first = index.CustomStemmer("three letters", lambda c: F.left(c, F.lit(3)), lambda w: w[:3])
    idx = indexed(spark, [(0, "a", "sunny window"), (1, "b", "sunset"), (2, "c", "windy")], stemmer=first)
    assert found(idx, "sunflower") == [0, 1] and found(idx, "wind !sun") == [2]
    store.save_index(idx, f"{tmp_path}/i", pruned=False)
    assert found(store.load_index(spark, f"{tmp_path}/i", first), "sunflower") == [0, 1]
    with pytest.raises(ValueError):
        store.load_index(spark, f"{tmp_path}/i")
    with pytest.raises(ValueError):
        indexed(spark, COLOURS, stemmer="unknown")


def test_document_numbers_follow_the_order(spark):
    rows = [(f"u{k:03}", f"t{k % 7}") for k in range(200)]
    out = index.with_doc_ids(spark.createDataFrame(rows, "url string, text string").repartition(5), "text", "url")
    assert [tuple(r) for r in sorted(out.collect())] == [(k, *r) for k, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))]


def test_frequency_csv_comes_back(spark, tmp_path):
    rows = [("a", 3), ("it's", 1), ("1,5", 7), ("semi;colon", 2), ('quo"te', 1)]
    store.write_frequency_csv(spark.createDataFrame(rows, "token string, frequency long"), f"{tmp_path}/f")
    assert sorted(map(tuple, store.read_frequency_csv(spark, f"{tmp_path}/f").collect())) == sorted(rows)


def test_entities(spark):
    texts = ["caf&eacute; &#233;&#xE9; &mdash;", "&amp;lt; &#38;amp; &amp;amp;amp;", "&nosuch; &notin; & x", "&#0; &#55296; &#1114112;", "a&nbsp;b&#160;c", "none"]
    want = ["café éé —", "&lt; &amp; &amp;amp;", "&nosuch; ∉ & x", "&#0; &#55296; &#1114112;", "a b c", "none"]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(decode_entities(F.col("t"))).collect()]
    assert got == want
    some = [k for k in html.entities.html5 if k.endswith(";")][::40]
    row = spark.createDataFrame([(" ".join(f"&{k}" for k in some),)], "t string").select(decode_entities(F.col("t"))).first()[0]
    assert row == " ".join(html.unescape(f"&{k}") for k in some).replace("\u00a0", " ")


def test_numbers(spark):
    assert spark.range(1).select(fnv1a(F.lit("a"))).first()[0] == fnv1a_of("a") == 0xE40C292C
    gaps = index.with_gaps(indexed(spark, COLOURS).postings).withColumn("n", F.col("doc_id"))
    assert index.without_gaps(gaps.withColumnRenamed("doc_id", "was")).where("was <> doc_id").count() == 0
    z = stats.zipf(spark.createDataFrame([("x", 4), ("y", 2), ("z", 2)], "token string, frequency long"))
    assert [(r["rank"], r["token"], r["expected"]) for r in z.orderBy("rank").collect()] == [(1, "x", 4.0), (2, "y", 2.0), (3, "z", round(4 / 3, 6))]


def test_urls(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(U.normalize_url(F.lit("https://www.x.org/a?b=1#c"))) == "https://x.org/a?b=1"
    news = {"/sport/2024/jan/05/story": "article", "/sport": "category", "/sport/video/x": "unknown", "": "unknown"}
    assert all(one(U.news_page_type(F.lit(f"https://n.com{p}"))) == want for p, want in news.items())
    wiki = {"/wiki/Category:Sports": "category", "/wiki/Tennis": "article", "/wiki/Talk:Tennis": "unknown"}
    assert all(one(U.wiki_page_type(F.lit(f"https://w.org{p}"))) == want for p, want in wiki.items())
    assert all(one(U.should_skip(F.lit(h))) for h in ("#top", "x?action=edit", "x.JPG", "y.pdf", "https://facebook.com/a"))
    assert one(U.should_follow(F.lit("https://a/b"), [], ["("])) is True


def test_link_regions(spark, tmp_path):
    parts = '<article>art</article><main class="m">one</main><main>two</main><div id="mw-pages">pages</div><div id="x">no</div><div class="c" id="mw-subcategories">subs</div><article id="b">icle</article>'
    want = {
        "https://example.org/wiki/Category:Sports": "pages subs", "https://example.org/wiki/Tennis": "", "https://example.org/wiki/Talk:Tennis": "", "https://example.org/en/1": "",
        "https://example.com/sport": "one two", "https://example.com/sport/2024/jan/05/story": "art icle", "https://example.com/video/x": "art icle", "https://example.com/a/b/c/d": "art icle", "https://example.net/sport": "",
    }
    rows = [(k, url, parts) for k, url in enumerate(want)] + [(len(want), "https://example.com/sport", "<p>none</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["region_md5"] for r in queries.link_regions(spark, str(tmp_path)).collect()}
    assert got == {k: hashlib.md5(t.encode()).hexdigest() for k, t in enumerate([*want.values(), ""])}


SCRAPES = [("u", 10, "t1", "one"), ("u", 20, "t2", "one"), ("u", 30, "t3", "two"), ("v", 15, "t", "x"), ("u", 40, "t4", "one")]


def test_upsert(spark, tmp_path):
    rows = lambda s: spark.createDataFrame(s, "normalized_url string, ts long, title string, html_content string")
    seen = lambda d: {r["normalized_url"]: (r["title"], r["html_content"], r["first_scraped"], r["last_scraped"], r["last_modified"], r["scraped_count"]) for r in d.collect()}
    want = {"u": ("t4", "one", 10, 40, 40, 4), "v": ("t", "x", 15, 15, 15, 1)}
    assert seen(crawl.fold_scrapes(rows(SCRAPES))) == want
    for k in range(1, 5):
        later = sorted(SCRAPES, key=lambda s: s[1])
        assert seen(crawl.merge_state(crawl.fold_scrapes(rows(later[:k])), rows(later[k:]))) == want
    table = StateTable(spark, f"{tmp_path}/state")
    for k, s in enumerate(sorted(SCRAPES, key=lambda s: s[1])):
        rows([s]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("normalized_url string, ts long, title string, html_content string").parquet(f"{tmp_path}/in")
        upsert_stream(stream, table, f"{tmp_path}/ck").awaitTermination()
    assert seen(table.read()) == want


def test_zipf_ranks_rare_tokens_in_blocks(spark):
    g = random.Random(5)
    rows = list({"".join(g.choices("abcé", k=g.randint(1, 6))): g.choice([1, 1, 1, 2, 9]) for _ in range(600)}.items())
    got = [(r["rank"], r["token"]) for r in stats.zipf(spark.createDataFrame(rows, "token string, frequency long")).orderBy("rank").collect()]
    assert got == [(k + 1, t) for k, (t, n) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0].encode())))]


LONG_TEXT = "<article><p>" + "words and " * 40 + "{}</p></article>"
PAGES = "url string, html string, ts long"


def test_crawl_stream_keeps_each_scrape_with_its_time(spark, tmp_path):
    site = (U.Site("news.test", "news", "news"),)
    url = "https://www.news.test/sport/2024/jan/05/story"
    page = lambda t: f"<html><head><title>{t}</title></head><body>{LONG_TEXT.format(t)}</body></html>"
    rows = [(url, page("old"), 10), (url, page("new"), 20), ("https://news.test/sport", page("x"), 5), (url.replace("05", "06"), "<article>short</article>", 7), (url.replace("05", "07"), page("y"), None)]
    spark.createDataFrame(rows, PAGES).coalesce(1).write.parquet(f"{tmp_path}/in")
    table = StateTable(spark, f"{tmp_path}/state")
    query = crawl_stream(read_pages(spark, f"{tmp_path}/in"), table, f"{tmp_path}/ck", site)
    query.awaitTermination()
    got = [(r["normalized_url"], r["title"], r["first_scraped"], r["last_scraped"], r["scraped_count"]) for r in table.read().collect()]
    assert got == [("https://news.test/sport/2024/jan/05/story", "new", 10, 20, 2)]
    assert sum(n for _, n in report(query)) == len(rows)


def test_ties_in_time_fold_alike_at_once_and_later(spark):
    rows = lambda s: spark.createDataFrame(s, "normalized_url string, ts long, title string, html_content string")
    for a, b in (("p", "q"), ("q", "p")):
        first, later = [("u", 1, "t", a)], [("u", 2, "t", a), ("u", 2, "t", b)]
        whole = crawl.fold_scrapes(rows(first + later)).collect()
        assert [r.asDict() for r in crawl.merge_state(crawl.fold_scrapes(rows(first)), rows(later)).collect()] == [r.asDict() for r in whole]


def test_outcomes_and_recrawl(spark):
    site = (U.Site("news.test", "news", "news"),)
    story, page = "https://news.test/sport/2024/jan/{}/story", f"<title>t</title>{LONG_TEXT.format('z')}"
    rows = [(story.format("01"), page, 200, None), (story.format("02"), None, None, "blocked by robots.txt"), (story.format("03"), "x", 429, None), (story.format("04"), None, None, "timeout"), (story.format("05"), page, 500, None), ("https://news.test/video/x", page, 200, None), ("https://news.test/sport", page, 200, None), (story.format("06"), "<p>short</p>", 200, None)]
    out = crawl.scrape_outcome(spark.createDataFrame(rows, "url string, html string, status int, error string"), site)
    assert [r["outcome"] for r in out.collect()] == ["saved", "blocked", "throttled", "failed", "failed", "unknown_type", "not_an_article", "too_short"]
    assert {r["outcome"]: r["pages"] for r in crawl.crawl_counters(out).collect()}["failed"] == 2
    state = crawl.fold_scrapes(spark.createDataFrame([(story.format(d), ts, "t", "old") for d, ts in (("01", 0), ("06", 0), ("08", 9000))], "normalized_url string, ts long, title string, html_content string"))
    after = {r["normalized_url"][-8:-6]: (r["last_scraped"], r["scraped_count"]) for r in crawl.recrawl(state, spark.createDataFrame([r[:2] for r in rows], "url string, html string"), 10_000, 2, sites=site).collect()}
    assert after == {"01": (10_000, 2), "06": (0, 1), "08": (9000, 1)}
    asked = spark.createDataFrame([("a", 2, False), ("b", 1, False), ("c", 3, True)], "url string, depth int, is_recrawl boolean")
    assert sorted(r["url"] for r in crawl.within_cap(asked, 9, 10).collect()) == ["b", "c"] and [r["url"] for r in crawl.within_cap(asked, 10, 10).collect()] == ["c"]


def test_discovery_follows_regions_of_known_pages(spark):
    site = (U.Site("news.test", "news", "news"),)
    root = "https://news.test"
    pages = [(f"{root}/sport", f'<main><a href="/a/2024/jan/05/s?x=1">1</a><a href="/video/x">no</a><a href="/sport">self</a></main><a href="/outside">no</a>'), (f"{root}/a/2024/jan/05/s", '<article><a href="/next">2</a></article>')]
    df = spark.createDataFrame(pages, "url string, html string")
    seeds = spark.createDataFrame([(f"{root}/sport",)], "url string")
    walk = lambda **k: sorted((r["depth"], r["url"].removeprefix(root)) for r in crawl.discover(df, seeds, 3, sites=site, **k).collect())
    assert walk() == [(0, "/sport"), (1, "/a/2024/jan/05/s"), (2, "/next")]
    assert walk(mark_seeds=False) == [(0, "/sport"), (1, "/a/2024/jan/05/s"), (1, "/sport"), (2, "/next")]


def test_article_text_leaves_out_classes(spark):
    text = '<p>x</p><span class="a mw-editsection">no</span> <div class=\'element-atom\'>no</div>y<i class="dcr-citations">z</i>'
    assert spark.range(1).select(article_text(F.lit(text))).first()[0] == "x yz"


def test_load_config(tmp_path):
    (tmp_path / "c.yaml").write_text("db:\n  database: crawl\n  collections:\n    documents: pages\nlogic:\n  delay_ms: 5\n")
    config = load_config(str(tmp_path / "c.yaml"))
    assert (config.database, config.documents, config.delay_ms, config.max_depth) == ("crawl", "pages", 5, 1000)


def test_config():
    assert parse_yaml('db:\n  connection: "x"\nlogic:\n  delay_ms: 5\nlist:\n  - a\n  - 2\n') == {"db": {"connection": "x"}, "logic": {"delay_ms": 5}, "list": ["a", 2]}


def test_entry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "tfidf_top10" in e.queries()
