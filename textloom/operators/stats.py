"""Corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import html_to_text, raw_tokens
from .index import spread


#: First characters of a token that tell its block; as ordering goes by characters, blocks are in the order of their tokens.
BLOCK_CHARS = 3


def token_frequency(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, frequency) over unstemmed tokens."""
    raw = spread(docs.select(text)).select(F.explode(raw_tokens(F.col(text))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    return raw.select(F.regexp_replace("t", "'+$", "").alias("token"), "n").where("token <> ''").groupBy("token").agg(F.sum("n").alias("frequency"))


def vocabulary_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: bytes tokenized, distinct tokens, their mean length (0 if there are none)."""
    words = token_frequency(docs, text).agg(F.count(F.lit(1)).alias("unique_tokens"), F.coalesce(F.round(F.avg(F.length("token")), 6), F.lit(0.0)).alias("mean_token_length"), F.coalesce(F.sum("frequency"), F.lit(0)).alias("n_tokens"))
    return words.crossJoin(docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("text_bytes")))


def zipf(frequency: DataFrame, limit: int | None = None) -> DataFrame:
    """(rank, token, frequency, expected): expected = highest frequency / rank.

    Frequencies are few, so ranks come from counts by frequency; only a frequency's own tokens are ordered beside each other.
    """
    if limit is not None:
        frequency = frequency.orderBy(F.desc("frequency"), "token").limit(limit)
    # tokens of one frequency are cut into blocks by their first characters, so that no task orders all of the rare ones
    frequency = frequency.withColumn("_block", F.substring("token", 1, BLOCK_CHARS))
    blocks = frequency.groupBy("frequency", "_block").agg(F.count(F.lit(1)).alias("_n"))
    above = Window.partitionBy("frequency").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("frequency", "_block", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_inside"), "_n")
    levels = blocks.groupBy("frequency").agg(F.sum("_n").alias("_n"))
    higher = Window.orderBy(F.desc("frequency")).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.select("frequency", F.coalesce(F.sum("_n").over(higher), F.lit(0)).alias("_above"), F.max("frequency").over(Window.partitionBy()).alias("_top"))
    starts = blocks.join(levels, "frequency").select("frequency", "_block", (F.col("_above") + F.col("_inside")).alias("_before"), "_top")
    own = Window.partitionBy("frequency", "_block").orderBy("token")
    ranked = frequency.withColumn("_row", F.row_number().over(own)).join(starts, ["frequency", "_block"]).withColumn("rank", F.col("_before") + F.col("_row"))
    return ranked.select("rank", "token", "frequency", F.round(F.col("_top") / F.col("rank"), 6).alias("expected"))


def corpus_report(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row: pages, bytes of HTML and of their text."""
    return pages.agg(F.count(html).alias("n_docs"), F.coalesce(F.sum(F.octet_length(html)), F.lit(0)).alias("html_bytes"), F.coalesce(F.sum(F.octet_length(html_to_text(F.col(html)))), F.lit(0)).alias("text_bytes"))
