"""Sources and sinks: corpus scans, the persisted index, frequency CSV, seeds, configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fnv1a
from ..operators.index import STEMMERS, CustomStemmer, SearchIndex, document_frequency, kept_terms, pack_postings, unpack_postings

#: Fixed values of the format: its name and version without and with compression.
MAGIC, RAW, PACKED = 0xABC1234, 1, 2


def read_corpus(spark: SparkSession, path: str, columns: tuple[str, ...] = ("url", "html"), max_documents: int = 0) -> DataFrame:
    """Only the columns named, rows with all of them; at most max_documents rows if that is positive."""
    rows = spark.read.parquet(path).select(*columns).dropna(subset=list(columns))
    return rows.limit(max_documents) if max_documents > 0 else rows


#: Row groups of postings and the directory, so that a term's rows are found among few others.
ROW_GROUP_BYTES = 1 << 20


def save_index(index: SearchIndex, path: str, packed: bool = False, max_df_ratio: float | None = 0.95, pruned: bool = True) -> None:
    """Postings sorted by term, so that row-group and page statistics find a term's rows; the directory sorted by hash; docs; meta. pruned: leave out what kept_terms() leaves out.

    packed: postings as rows of varint bytes (pack_postings), compressed. A custom stemmer is saved by its name.
    """
    n = index.total()
    kept, postings = document_frequency(index.postings), index.postings
    if pruned:
        kept = kept_terms(index.postings, n, max_df_ratio)
        postings = index.postings.join(kept.select("term"), "term", "left_semi")
    codec = "zstd" if packed else "uncompressed"
    rows, order = (pack_postings(postings), ("term", "first")) if packed else (postings, ("term", "doc_id"))
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", codec).option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{path}/postings")
    directory = kept.withColumn("term_hash", fnv1a(F.col("term"))).repartitionByRange("term_hash", "term").sortWithinPartitions("term_hash", "term")
    directory.select("term", "term_hash", "df").write.option("compression", codec).option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{path}/terms")
    index.docs.write.option("compression", codec).parquet(f"{path}/docs")
    spark = index.docs.sparkSession
    n_terms = spark.read.parquet(f"{path}/terms").count()
    name = index.stemmer if isinstance(index.stemmer, str) else index.stemmer.name
    spark.createDataFrame([(MAGIC, PACKED if packed else RAW, n, n_terms, name)], "magic long, version int, num_docs long, num_terms long, stemmer string").coalesce(1).write.parquet(f"{path}/meta")


def load_index(spark: SparkSession, path: str, stemmer: CustomStemmer | None = None) -> SearchIndex:
    """Raises ValueError for a folder that isn't an index, or one whose custom stemmer isn't given; a missing one raises Spark's AnalysisException."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta is None or meta["magic"] != MAGIC or meta["version"] not in (RAW, PACKED):
        raise ValueError(f"{path} is no index: invalid magic")
    known = meta["stemmer"] in STEMMERS
    if not known and (stemmer is None or stemmer.name != meta["stemmer"]):
        raise ValueError(f"{path} was built with the stemmer {meta['stemmer']}")
    postings = spark.read.parquet(f"{path}/postings")
    return SearchIndex(spark.read.parquet(f"{path}/docs"), unpack_postings(postings) if meta["version"] == PACKED else postings, meta["num_docs"], meta["stemmer"] if known else stemmer, spark.read.parquet(f"{path}/terms"))


def write_frequency_csv(frequency: DataFrame, path: str) -> None:
    frequency.select("token", "frequency").write.option("sep", ";").option("header", True).csv(path)


def read_frequency_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", ";").option("header", True).schema("token string, frequency long").csv(path)


def seed_urls(spark: SparkSession, base: str, pages: int = 100, *more: str) -> DataFrame:
    """base?page=0 .. pages - 1, then base itself and more."""
    listed = spark.range(pages).select(F.concat(F.lit(f"{base}?page="), F.col("id")).alias("url"))
    return listed.unionByName(spark.createDataFrame([(u,) for u in (base, *more)], "url string"))
