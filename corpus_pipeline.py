"""The corpus pipeline: toxicity, near-duplicates, benchmark contamination, source mixing, token output.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. The first four return the columns of documents; the last returns
``doc_id, start, n_tokens, ids_crc32`` of the token table it wrote and read back. Mixing leaves files of rows in random order; tokens are numbered in the order in which Spark
reads these files, which depends on their sizes, so that start isn't the rank of the mixing key. Documents whose doc_id repeats after mixing keep a row for each copy.
Every stage gives an empty table for an empty one; null and empty texts are clean, nobody's near copy, free of benchmark words, and become their end id alone. Rows equal in doc_id share
their fate in the near-duplicate stage and their count in mixing; a null doc_id is a document of its own. Columns beside doc_id, text and source are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontaminate, mixing, near_dup, token_output, toxicity
from textloom.llm.queries import MIX_SEED, table, tokenizer_path

#: Near-duplicates are judged on five-word shingles.
SHINGLE_WORDS, SIMILARITY_PERCENT, TOXIC_AT = 5, 80, 0.3


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose most toxic window scores TOXIC_AT or more go."""
    net = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, net, TOXIC_AT)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates that of the smallest doc_id stays."""
    return near_dup.drop_near_duplicates(docs, shingle=SHINGLE_WORDS, percent=SIMILARITY_PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more lies in benchmark windows go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All sources get an equal share; copies are rows, in a global random order."""
    return mixing.mix(docs, default_weight=1.0, seed=MIX_SEED).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, numbered in the order in which the rows are read."""
    return token_output.encode_documents(docs, tokenizer_path(), order="given")


STAGES = [("toxicity", toxicity_stage), ("near_dedup", near_dup_stage), ("decontamination", decontamination_stage), ("source_mixing", mixing_stage), ("token_output", token_stage)]
#: A trained network and stored token ids are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.common import stage_table

    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
