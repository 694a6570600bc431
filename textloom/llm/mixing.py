"""Mixing sources to target weights by Poisson replication.

A document of source s appears Poisson(rate_s) times, rate_s = share of s in the target * target rows / rows of s. The count is the
inverse of the Poisson distribution at a uniform number hashed from seed and doc_id, so it doesn't depend on partitions or retries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hex_number, stage_table

#: Rates above it are the sum of several Poisson numbers, so that the table of a source stays short.
MOST_RATE = 64.0
#: Steps of a table: at a mean of MOST_RATE, what lies beyond has a probability under 1e-12.
STEPS = 160
#: Rate tables of more sources than this are joined, not broadcast (a row takes about 1.3 KB).
BROADCAST_SOURCES = 5_000
SALTS = 64


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, target_rows: int | None = None, source_col: str = "source") -> DataFrame:
    """``source, n_rows, rate, parts, cdf`` for each source (null is one too); cdf is that of a Poisson number of mean rate / parts.

    weights are relative; a source not named has default_weight; weight 0 leaves a source out. target_rows: all rows if None.
    """
    counts = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n_rows"))
    own = F.lit(float(default_weight))
    if weights:
        named = F.create_map(*(F.lit(x) for name, weight in weights.items() for x in (name, float(weight))))
        own = F.coalesce(F.try_element_at(named, F.col("source")), own)
    counts = counts.select("source", "n_rows", own.alias("_w"))
    counts = stage_table(counts, "sources")
    total, weight = counts.agg(F.sum("n_rows"), F.sum("_w")).first()
    rows = float(target_rows if target_rows is not None else total or 0)
    rate = F.col("_w") / F.lit(float(weight or 1)) * F.lit(rows) / F.col("n_rows")
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_RATE)).cast("int")
    steps = F.sequence(F.lit(1), F.lit(STEPS))
    first = F.struct(-F.col("_mean"), F.exp(-F.col("_mean")), F.array(F.exp(-F.col("_mean"))))
    zero = first.cast("struct<logp:double,total:double,cdf:array<double>>")

    def step(acc: Column, k: Column) -> Column:
        logp = acc["logp"] + F.log(F.col("_mean") / k)
        total = acc["total"] + F.exp(logp)
        return F.struct(logp, total, F.concat(acc["cdf"], F.array(total))).cast("struct<logp:double,total:double,cdf:array<double>>")

    table = counts.withColumn("rate", rate).withColumn("parts", parts).withColumn("_mean", F.col("rate") / F.col("parts"))
    cdf = F.when(F.col("_mean") > 0, F.aggregate(steps, zero, step, lambda a: a["cdf"])).otherwise(F.array(F.lit(2.0)))
    return stage_table(table.select("source", "n_rows", "rate", "parts", F.when(F.col("_mean") > 0, cdf).otherwise(F.array(F.lit(1.0))).alias("cdf"), (F.col("_mean") > 0).alias("_used")), "rates")


def numbered_without_id(docs: DataFrame, id_col: str, source_col: str) -> DataFrame:
    """``_row, _ident, _own``: the rows with an id under it, those without under a number of their own, written down once so that a retry draws the same."""
    found = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(f"`{id_col}`").cast("string").alias("_ident"), F.col(f"`{source_col}`").cast("string").alias("_own"))
    if docs.where(F.col(f"`{id_col}`").isNull()).isEmpty():
        return found
    loose = stage_table(found.where("_ident IS NULL").withColumn("_ident", F.concat(F.lit("null:"), F.monotonically_increasing_id())), "without_id")
    return found.where("_ident IS NOT NULL").unionByName(loose)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, target_rows: int | None = None, seed: int = 1, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The input's columns plus ``_copy`` (from 1) and ``_mix_key``, in the global order of _mix_key.

    Rows of equal doc_id get the same count, so their total misses the target by more than single rows would: its variance is the rate times the sum of the squares of the
    repeats. Rows without a doc_id are drawn one by one. A null source is a source of its own; texts aren't looked at; an empty table gives an empty table. Input columns
    named _copy or _mix_key are replaced, others may have any name. The rate table is broadcast up to BROADCAST_SOURCES sources; beyond that, rows are joined to it over SALTS salts.
    """
    spark = docs.sparkSession
    rates = source_rates(docs, weights, default_weight, target_rows, source_col)
    n = rates.count()
    rates = rates.where("_used").select(F.col("source").alias("_source"), F.col("parts").alias("_parts"), F.col("cdf").alias("_cdf"))
    kept = [c for c in docs.columns if c not in ("_copy", "_mix_key")]
    rows = numbered_without_id(docs.select(*(F.col(f"`{c}`") for c in kept)), id_col, source_col)
    ident = F.concat(F.lit(f"{seed}:"), F.col("_ident"))
    same = F.col("_own").eqNullSafe(F.col("_source"))
    if n <= BROADCAST_SOURCES:
        rows = rows.join(F.broadcast(rates), same)
    else:
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_ident"), F.lit(SALTS)))
        rates = rates.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        rows = rows.join(rates, same & (F.col("_salt") == F.col("_s")))

    def drawn(part: Column) -> Column:
        uniform = (hex_number(F.md5(F.concat(ident, F.lit(":"), part.cast("string"))), 13).cast("double") + 0.5) / float(1 << 52)
        return F.size(F.filter("_cdf", lambda c: c <= uniform))

    count = F.aggregate(F.sequence(F.lit(1), F.col("_parts")), F.lit(0), lambda n, part: n + drawn(part))
    rows = rows.withColumn("_n", count).where("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    key = F.md5(F.concat(ident, F.lit("#"), F.col("_copy").cast("string")))
    rows = rows.select("_row", "_copy", key.alias("_mix_key"))
    # keys are uniform, so equal ranges of their leading digits are equal parts without a sample of the rows
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.floor(hex_number(F.col("_mix_key"), 8) * parts / F.lit(1 << 32)).cast("int")
    return rows.repartitionById(parts, place).sortWithinPartitions("_mix_key").select(*(F.col(f"_row.`{c}`") for c in kept), "_copy", "_mix_key")
