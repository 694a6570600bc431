"""Search: Boolean evaluation as one aggregate over the query's postings, and TF-IDF ranking."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import query_plan as plan
from .index import CustomStemmer, SearchIndex


def intersect_lists(left: DataFrame, right: DataFrame) -> DataFrame:
    """Postings of left whose document right has too."""
    return left.join(right.select("doc_id"), "doc_id", "left_semi")


def union_lists(left: DataFrame, right: DataFrame) -> DataFrame:
    """Documents of either; left's tf counts."""
    return left.unionByName(right.join(left.select("doc_id"), "doc_id", "left_anti"))


def not_list(postings: DataFrame, docs: DataFrame) -> DataFrame:
    return docs.select("doc_id").join(postings.select("doc_id"), "doc_id", "left_anti").withColumn("tf", F.lit(0).cast("long"))


def _stem(index: SearchIndex) -> plan.Stemmer:
    if isinstance(index.stemmer, CustomStemmer):
        return index.stemmer.word
    return plan.plain if index.stemmer == "none" else plan.porter()


def evaluated(index: SearchIndex, query: str, weights: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, url, _s) of the documents that a query selects; _s is the sum of the weights of its postings, null where there are none.

    One scan of the terms' postings, one shuffle, no self-join. Documents without any of the terms are looked at only by queries that select such.
    """
    rpn = plan.postfix(plan.infix(query, _stem(index)))
    distinct = list(dict.fromkeys(plan.terms_of(rpn)))
    flag = {t: f"_t{k}" for k, t in enumerate(distinct)}
    found = plan.condition(rpn, lambda t: F.col(flag[t]))
    if found is None:
        return index.docs.select("doc_id", "url", F.lit(None).cast("double").alias("_s")).where(F.lit(False))
    score = F.lit(None).cast("double") if not weights else F.sum(plan.choose(F.col("term"), weights))
    own = index.postings.where(F.col("term").isin(distinct)).groupBy("doc_id").agg(*(F.max(F.col("term") == t).alias(flag[t]) for t in distinct), score.alias("_s"))
    if plan.holds_without_terms(rpn):
        return index.docs.join(own, "doc_id", "left").where(found).select("doc_id", "url", "_s")
    return index.docs.join(own.where(found), "doc_id").select("doc_id", "url", "_s")


def boolean_search(index: SearchIndex, query: str) -> DataFrame:
    """(doc_id, url, score 0) by doc_id; documents without a url are left out."""
    return evaluated(index, query).where("url <> ''").select("doc_id", "url", F.lit(0.0).alias("score")).orderBy("doc_id")


def tfidf_search(index: SearchIndex, query: str) -> DataFrame:
    """(doc_id, url, score): every occurrence of a term in the query adds (1 + ln tf) * ln(N / (1 + df)); unordered. df of the query's terms comes from the directory."""
    times = Counter(plan.terms_of(plan.infix(query, _stem(index))))
    known = {r["term"]: r["df"] for r in index.lookup(list(times)).select("term", "df").collect()} if times else {}
    n = index.total() if known else 0
    weights = {t: F.lit(times[t] * math.log(n / (1 + df))) * (1 + F.log("tf")) for t, df in known.items()}
    return evaluated(index, query, weights).select("doc_id", "url", F.round(F.coalesce("_s", F.lit(0.0)), 6).alias("score"))


def top(results: DataFrame, k: int = 10) -> DataFrame:
    """The k best with their rank from 1; ties by doc_id."""
    best = results.orderBy(F.desc("score"), "doc_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))


def search(index: SearchIndex, query: str, mode: str = "tfidf", k: int | None = 10) -> DataFrame:
    if mode == "boolean":
        return boolean_search(index, query)
    out = tfidf_search(index, query)
    return out.orderBy(F.desc("score"), "doc_id") if k is None else top(out, k)


def search_many(index: SearchIndex, queries: dict[str, str], mode: str = "tfidf", k: int = 10) -> DataFrame:
    """Results of named queries in one table (query, rank, ...)."""
    out = None
    for name, q in queries.items():
        own = search(index, q, mode, k)
        own = (own if mode == "tfidf" else own.withColumn("rank", F.row_number().over(Window.orderBy("doc_id")))).select(F.lit(name).alias("query"), "rank", "doc_id", "url", "score")
        out = own if out is None else out.unionByName(own)
    return out
