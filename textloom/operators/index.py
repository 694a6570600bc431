"""The inverted index as tables: docs(doc_id, url), postings(term, doc_id, tf)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stemmer import stem_array, stem_series
from ..functions.text import fnv1a, fnv1a_of, kept_tokens, pack_varints, raw_tokens, unpack_varints, varint_bytes
from ..storage import scratch

STEMMERS = ("none", "porter", "porter_expression")


@dataclass(frozen=True)
class CustomStemmer:
    """A caller's own stemmer: over a column for documents, over a word for queries. The two have to agree."""

    name: str
    column: Callable[[Column], Column]
    word: Callable[[str], str]


@dataclass(frozen=True)
class SearchIndex:
    """terms(term, term_hash, df): the directory, where there is one."""

    docs: DataFrame
    postings: DataFrame
    n_docs: int | None = None
    stemmer: str | CustomStemmer = "none"
    terms: DataFrame | None = None

    def total(self) -> int:
        """All documents, those without tokens too."""
        return self.docs.count() if self.n_docs is None else self.n_docs

    def lookup(self, terms: Sequence[str]) -> DataFrame:
        """(term, term_hash, df) from the directory, found by hash and then by comparison; terms that it hasn't are left out."""
        wanted = list(dict.fromkeys(terms))
        directory = term_directory(self.postings.where(F.col("term").isin(wanted))) if self.terms is None else self.terms
        return directory.where(F.col("term_hash").isin([fnv1a_of(t) for t in wanted]) & F.col("term").isin(wanted))

    def get_postings(self, term: str) -> DataFrame:
        return self.postings.where(F.col("term") == term).select("doc_id", "tf").orderBy("doc_id")

    def get_url(self, doc_id: int) -> str:
        row = self.docs.where(F.col("doc_id") == doc_id).select("url").first()
        return row[0] if row else ""

    def n_terms(self) -> int:
        return self.postings.select("term").distinct().count()


def with_doc_ids(docs: DataFrame, *order: str) -> DataFrame:
    """Numbers from 0 in the order given, for sources without ids: rows are written down in that order, and a file's rows follow those of the files before. Only row counts of files meet in one place."""
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "numbered")
    docs.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
    rows = spark.read.schema(docs.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_file", (F.sum("_size").over(Window.orderBy("_file")) - F.col("_size")).alias("_before"))
    return rows.join(F.broadcast(before), "_file").select((F.col("_before") + F.col("_row")).alias("doc_id"), *(F.col(f"`{c}`") for c in docs.columns))


#: Tables that Spark takes for smaller than this are dealt out over all cores before their texts are split into tokens.
SPREAD_BYTES = 256 << 20


def spread(docs: DataFrame) -> DataFrame:
    """The rows over all cores if the table is small, as then a few tasks would hold all its texts; larger tables lie in many partitions and stay where they are."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(docs.sparkSession.sparkContext.defaultParallelism) if size < SPREAD_BYTES else docs


def tokens(text: Column) -> Column:
    return kept_tokens(raw_tokens(text))


def occurrences(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, token, n): tokens are counted for each document before any shuffle meets them."""
    return spread(docs.select("doc_id", text)).select("doc_id", F.explode(raw_tokens(F.col(text))).alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))


def stem_vocabulary(words: DataFrame, stemmer: str | CustomStemmer) -> DataFrame:
    """words(token) -> (token, term): each distinct token once; tokens that stem to nothing are left out."""
    # a vocabulary is small beside its texts: without a number Spark would put it into a few partitions
    spark = words.sparkSession
    words = words.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    if isinstance(stemmer, CustomStemmer):
        stemmed = stemmer.column(F.col("token"))
    elif stemmer == "porter":
        stemmed = stem_series(F.col("token"))
    else:
        words, stemmed = words.withColumn("_w", F.array("token")), F.get(stem_array("_w"), F.lit(0))
    return words.withColumn("term", F.regexp_replace(stemmed, "'+$", "")).where("term <> ''").select("token", "term")


def terms_by_document(docs: DataFrame, stemmer: str | CustomStemmer, text: str) -> DataFrame:
    if stemmer not in STEMMERS and not isinstance(stemmer, CustomStemmer):
        raise ValueError(f"stemmer is one of {STEMMERS} or a CustomStemmer")
    found = occurrences(docs, text)
    if stemmer == "none":
        return found.select(F.regexp_replace("token", "'+$", "").alias("term"), "doc_id", "n").where("term <> ''")
    words = found.select("token").distinct()
    return found.join(stem_vocabulary(words, stemmer), "token").select("term", "doc_id", "n")


def tfidf_postings(docs: DataFrame, stemmer: str | CustomStemmer = "none", text: str = "text") -> DataFrame:
    own = terms_by_document(docs, stemmer, text)
    if stemmer == "none":
        return own.select("term", "doc_id", F.col("n").alias("tf"))
    return own.groupBy("term", "doc_id").agg(F.sum("n").alias("tf"))


def boolean_postings(docs: DataFrame, stemmer: str | CustomStemmer = "none", text: str = "text") -> DataFrame:
    return terms_by_document(docs, stemmer, text).select("term", "doc_id").distinct().withColumn("tf", F.lit(1).cast("long"))


def build_index(docs: DataFrame, stemmer: str | CustomStemmer = "none", boolean: bool = False, url: str = "url", text: str = "text") -> SearchIndex:
    """Index docs(doc_id, url, text); rows of equal url are separate documents."""
    rows = docs.where(F.col(text).isNotNull() & F.col(url).isNotNull())
    made = boolean_postings if boolean else tfidf_postings
    return SearchIndex(rows.select("doc_id", F.col(url).alias("url")), made(rows, stemmer, text), None, stemmer)


def posting_lists(postings: DataFrame) -> DataFrame:
    """(term, df, postings): lists in ascending doc_id. A frequent term's list is a row; search() doesn't need it."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("postings"))


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def kept_terms(postings: DataFrame, n_docs: int, max_df_ratio: float | None = 0.95) -> DataFrame:
    """(term, df): terms of more than one document or with a first tf over 1, but for those in max_df_ratio of all documents or more."""
    stats = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.min_by("tf", "doc_id").alias("_tf"))
    kept = stats.where("df > 1 OR _tf > 1")
    if max_df_ratio is not None:
        kept = kept.where(F.col("df") < F.lit(max_df_ratio * n_docs))
    return kept.select("term", "df")


def prune(index: SearchIndex, max_df_ratio: float | None = 0.95) -> SearchIndex:
    n = index.total()
    kept = kept_terms(index.postings, n, max_df_ratio).select("term")
    return replace(index, postings=index.postings.join(kept, "term", "left_semi"), n_docs=n, terms=None)


def term_directory(postings: DataFrame) -> DataFrame:
    """(term, term_hash, df) in the order of the directory."""
    return document_frequency(postings).withColumn("term_hash", fnv1a(F.col("term"))).select("term", "term_hash", "df").orderBy("term_hash", "term")


def with_gaps(postings: DataFrame) -> DataFrame:
    """Adds ``gap`` to the posting before, the first from 0."""
    own = Window.partitionBy("term").orderBy("doc_id")
    return postings.withColumn("gap", F.col("doc_id") - F.lag("doc_id", 1, 0).over(own))


def without_gaps(gapped: DataFrame) -> DataFrame:
    """doc_id from gaps, given the order ``n`` in each term's list."""
    own = Window.partitionBy("term").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return gapped.withColumn("doc_id", F.sum("gap").over(own))


#: Postings in a packed row; longer lists take several.
PACKED_ROWS = 4096


def pack_postings(postings: DataFrame) -> DataFrame:
    """(term, first, n, gaps, tfs): lists in rows of at most PACKED_ROWS postings, as varint bytes of the gaps to the posting before in the row (the first is 0, from ``first``) and of the counts.

    A row covers PACKED_ROWS document numbers, so that lists are cut without a number for each posting.
    """
    rows = postings.withColumn("_block", F.floor(F.col("doc_id") / PACKED_ROWS)).groupBy("term", "_block").agg(F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("_p"))
    ids = F.col("_p.doc_id")
    gaps = F.transform(ids, lambda d, i: d - F.when(i == 0, F.get(ids, F.lit(0))).otherwise(F.get(ids, i - 1)))
    return rows.select("term", F.get(ids, F.lit(0)).alias("first"), F.size("_p").alias("n"), pack_varints(gaps).alias("gaps"), pack_varints(F.col("_p.tf")).alias("tfs"))


def unpack_postings(packed: DataFrame) -> DataFrame:
    """(term, doc_id, tf) again."""
    gaps = unpack_varints(F.col("gaps"))
    zero = F.struct(F.col("first").alias("at"), F.array().cast("array<bigint>").alias("ids"))
    ids = F.aggregate(gaps, zero, lambda acc, g: F.struct((acc["at"] + g).alias("at"), F.concat(acc["ids"], F.array(acc["at"] + g)).alias("ids")), lambda acc: acc["ids"])
    pairs = packed.select("term", F.explode(F.arrays_zip(ids.alias("d"), unpack_varints(F.col("tfs")).alias("t"))).alias("_p"))
    return pairs.select("term", F.col("_p.d").alias("doc_id"), F.col("_p.t").alias("tf"))


#: Fixed value: bytes of a directory entry, four 32-bit numbers of hash, count and two offsets of which one is wide.
ENTRY_BYTES = 24


def size_report(index: SearchIndex) -> DataFrame:
    """One row: bytes of postings raw and with varint gaps, of terms and of urls, and counts; a directory has ENTRY_BYTES for each term beside."""
    per = with_gaps(index.postings).agg(F.count(F.lit(1)).alias("n_postings"), (F.count(F.lit(1)) * 8).alias("raw_bytes"), F.sum(varint_bytes(F.col("gap")) + varint_bytes(F.col("tf"))).alias("packed_bytes"))
    terms = index.postings.select("term").distinct().agg(F.count(F.lit(1)).alias("n_terms"), F.sum(F.octet_length("term") + 1).alias("term_bytes"))
    urls = index.docs.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.octet_length("url") + 4).alias("url_bytes"))
    return per.crossJoin(terms).crossJoin(urls)
