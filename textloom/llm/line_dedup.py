"""Line dedup over content-defined chunks of lines, with DataFrame functions only.

A rolling hash over the hashes of neighbouring lines ends a chunk wherever it is 0 modulo the mean length, so that chunk boundaries move with
the lines when lines are inserted before. A chunk of at least two lines that occurs again anywhere is kept once and removed elsewhere, after its bytes were compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, hex_number, release_shuffles, stage_table, text_or_empty

#: Mean lines of a chunk, and factor and modulus of the rolling hash over two lines.
MEAN_LINES, FACTOR, MODULUS = 4, 31, 2147483647
#: Bits of the map of documents that a step concerns: 8 MB at any size of the input. A full map only means that more texts are shuffled.
MAP_BITS = 1 << 26


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_chunks(docs: DataFrame, mean_lines: int = MEAN_LINES) -> DataFrame:
    """docs(_id, _th, _text) -> one row per chunk of two lines or more: ``_id, _th, _no, _start, _len, _key``."""
    rows = docs.withColumn("_lines", lines_of(F.col("_text")))
    rows = rows.select("_id", "_th", "_lines", F.transform("_lines", lambda x: hex_number(F.md5(x), 8)).alias("_hash"))
    last = F.size("_hash") - 1
    rolled = lambda i: (F.get("_hash", i) * FACTOR + F.when(i == 0, F.lit(0)).otherwise(F.get("_hash", i - 1))) % MODULUS
    rows = rows.select("_id", "_th", "_lines", F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (rolled(i) % mean_lines == 0)).alias("_ends"))
    begin = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get("_ends", k - 1) + 1)
    spans = F.transform("_ends", lambda e, k: F.struct(k.alias("_no"), begin(k).alias("_start"), (e + 1 - begin(k)).alias("_len")))
    rows = rows.select("_id", "_th", "_lines", F.filter(spans, lambda s: s["_len"] > 1).alias("_spans"))
    keyed = F.transform("_spans", lambda s: F.struct(s["_no"].alias("_no"), s["_start"].alias("_start"), s["_len"].alias("_len"), F.unhex(F.md5(chunk_text(s))).alias("_key")))
    return rows.select("_id", "_th", F.inline(keyed))


def chunk_text(span: Column) -> Column:
    return F.array_join(F.slice(F.col("_lines"), span["_start"] + 1, span["_len"]), "\n")


def map_place() -> Column:
    return F.pmod(F.xxhash64("_id", "_th"), F.lit(MAP_BITS)) + 1


def marked(rows: DataFrame, some: DataFrame) -> DataFrame:
    """Adds ``_maybe`` to rows(_id, _th): false only where no row of some(_id, _th) equals it. Tells which texts have to be shuffled to meet some."""
    bits = some.select(F.bitmap_bucket_number(map_place()).alias("_bucket"), F.bitmap_bit_position(map_place()).alias("_bit"))
    maps = bits.repartition("_bucket").groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    out = rows.withColumn("_bucket", F.bitmap_bucket_number(map_place())).withColumn("_bit", F.bitmap_bit_position(map_place()))
    byte = F.conv(F.hex(F.substring("_map", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1, F.lit(False))
    return out.join(F.broadcast(maps), "_bucket", "left").withColumn("_maybe", maybe).drop("_bucket", "_bit", "_map")


def dedup_lines(docs: DataFrame, mean_lines: int = MEAN_LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, text`` (what is left), ``n_lines, n_removed, n_chunks`` (removed chunks).

    Joins by document are merge joins at every size, so that none depends on an estimate of a broadcast side. Of equal chunks, that of the smallest (doc_id, text hash, chunk number) stays; null ids come last. A null text counts as empty and has one
    empty line; single-line chunks are never removed; rows equal in doc_id and text share one fate; extra columns are ignored; an empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text")).withColumn("_th", F.xxhash64("_text"))
    chunks = stage_table(line_chunks(rows, mean_lines), "chunks")
    repeated = stage_table(chunks.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key"), "repeated")
    own = chunks.join(repeated, "_key").groupBy("_id", "_th").agg(F.array_sort(F.collect_set(F.struct("_no", "_start", "_len", "_key"))).alias("_spans"))

    own = stage_table(own.withColumnsRenamed({"_id": "_i", "_th": "_t"}), "spans")
    texts = marked(rows, own.select(F.col("_i").alias("_id"), F.col("_t").alias("_th"))).where("_maybe").join(own.hint("merge"), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_t"))).withColumn("_lines", lines_of(F.col("_text")))
    cand = texts.select("_id", "_th", F.inline(F.transform("_spans", lambda s: F.struct(s["_no"].alias("_no"), s["_start"].alias("_start"), s["_len"].alias("_len"), s["_key"].alias("_key"), chunk_text(s).alias("_chunk")))))
    cand = stage_table(cand, "candidates")
    release_shuffles(docs.sparkSession)

    place = F.struct(F.col("_id").isNull().alias("_last"), "_id", "_th", "_no")
    firsts = cand.groupBy("_key", "_chunk").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key", "_chunk", "_first")
    firsts = stage_table(firsts, "firsts")
    again = cand.join(firsts, ["_key", "_chunk"]).where(~place.eqNullSafe(F.col("_first")))
    removed = again.groupBy("_id", "_th").agg(F.collect_set(F.struct("_start", "_len")).alias("_spans"))
    removed = stage_table(removed.withColumnsRenamed({"_id": "_i", "_th": "_t"}), "removed")
    for table in (chunks, repeated, own, cand, firsts):
        drop_table(table)
    release_shuffles(docs.sparkSession)

    seen = marked(rows, removed.select(F.col("_i").alias("_id"), F.col("_t").alias("_th")))
    some = seen.where("_maybe").join(removed.hint("merge"), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_t")), "left").withColumn("_lines", lines_of(F.col("_text")))
    gone = F.flatten(F.transform("_spans", lambda s: F.sequence(s["_start"], s["_start"] + s["_len"] - 1)))
    some = some.withColumn("_gone", F.coalesce(gone, F.array().cast("array<int>")))
    some = some.withColumn("_kept", F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone")))
    left = F.when(F.col("_spans").isNull(), F.col("_text")).otherwise(F.array_join(F.transform("_kept", lambda i: F.get("_lines", i)), "\n"))
    some = some.select(
        F.col("_id").alias("doc_id"), left.alias("text"), F.size("_lines").cast("long").alias("n_lines"), F.size("_gone").cast("long").alias("n_removed"), F.coalesce(F.size("_spans"), F.lit(0)).cast("long").alias("n_chunks")
    )
    whole = seen.where("NOT _maybe").select(F.col("_id").alias("doc_id"), F.col("_text").alias("text"), F.size(lines_of(F.col("_text"))).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_chunks"))
    return some.union(whole)


#: DuckDB SQL for the digest columns of dedup_lines over documents with distinct ids.
LINE_DEDUP_SQL = f"""
WITH lines AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
hashed AS (SELECT doc_id, ls, list_transform(ls, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT) AS hs FROM lines),
ended AS (SELECT doc_id, ls, list_filter(range(1, len(ls) + 1), lambda i: i = len(ls) OR (hs[i] * {FACTOR} + CASE WHEN i = 1 THEN 0 ELSE hs[i - 1] END) % {MODULUS} % {MEAN_LINES} = 0) AS ends FROM hashed),
numbered AS (SELECT doc_id, ls, ends, unnest(range(1, len(ends) + 1)) AS k FROM ended),
chunks AS (SELECT doc_id, k, CASE WHEN k = 1 THEN 1 ELSE ends[k - 1] + 1 END AS a, ends[k] AS b, ls FROM numbered),
multi AS (SELECT doc_id, k, a, b, array_to_string(ls[a:b], chr(10)) AS chunk FROM chunks WHERE b > a),
ranked AS (SELECT doc_id, a, b, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, k) AS r FROM multi),
gone AS (SELECT doc_id, list(unnested) AS dropped, count(DISTINCT a) AS n_chunks FROM (SELECT doc_id, a, unnest(range(a, b + 1)) AS unnested FROM ranked WHERE r > 1) GROUP BY doc_id),
kept AS (SELECT l.doc_id, len(ls) AS n_lines, coalesce(len(dropped), 0) AS n_removed, coalesce(n_chunks, 0) AS n_chunks,
  CASE WHEN dropped IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(dropped, i)), lambda i: ls[i]), chr(10)) END AS left_text
  FROM lines l LEFT JOIN gone g USING (doc_id))
SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, n_chunks::BIGINT AS n_chunks, sha256(left_text) AS kept_sha256 FROM kept
"""
