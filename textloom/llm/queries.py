"""The thin queries opN_<name> over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, line_dedup, media_flac, mixing, near_dup, suffix_dedup, token_output, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_chunks", F.sha2("text", 256).alias("kept_sha256"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


#: A conversation beside those of the table: both turns say a string full of other templates' control strings.
EXTRA_CONVERSATION = [(-1, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA_CONVERSATION, "conv_id long, turn long, role string, text string")
    return chat_format.format_turns(turns.union(extra))


#: DuckDB SQL but for formatted_chars, which is the template's own.
CHAT_LENGTH = "length(replace(replace(replace(replace(replace(replace(replace(replace(t, '&', '&amp;'), '<|', '&lt;|'), '<s>', '&lt;s>'), '</s>', '&lt;/s>'), '<<SYS>>', '&lt;&lt;SYS>>'), '<</SYS>>', '&lt;&lt;/SYS>>'), '[INST]', '&#91;INST]'), '[/INST]', '&#91;/INST]'))"
CHAT_SQL = f"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + {CHAT_LENGTH} + {len(chat_format.OPEN) + len(chat_format.CLOSE) + 1})::BIGINT AS formatted_chars FROM rows GROUP BY conv_id
"""


def op4_media_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_flac.media_round_trip(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(table(spark, sf_dir, "documents"), length=200)


#: All sources get an equal share of an epoch of as many rows as the corpus has.
MIX_SEED = 20


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), default_weight=1.0, seed=MIX_SEED)
    return out.select("doc_id", "source", F.col("_copy").alias("copy_no"), F.col("_mix_key").alias("mix_key"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


MIX_SQL = f"""
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, (SELECT sum(n) FROM counts)::DOUBLE / (SELECT count(*) FROM counts) / n AS rate FROM counts),
tables AS (SELECT source, list_transform(range(0, {mixing.STEPS} + 1), lambda k: list_sum(list_transform(range(0, k + 1), lambda j: exp(-rate + j * ln(rate) - lgamma(j + 1))))) AS cdf FROM rates),
drawn AS (SELECT d.doc_id, d.source, d.text, (('0x' || substr(md5('{MIX_SEED}:' || doc_id || ':1'), 1, 13))::BIGINT + 0.5) / {1 << 52}::DOUBLE AS u, t.cdf FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source),
counted AS (SELECT doc_id, source, text, len(list_filter(cdf, lambda c: c <= u)) AS n FROM drawn),
copies AS (SELECT doc_id, source, text, unnest(range(1, n + 1)) AS copy_no FROM counted WHERE n > 0)
SELECT doc_id, source, copy_no::INTEGER AS copy_no, md5('{MIX_SEED}:' || doc_id || '#' || copy_no) AS mix_key, md5(coalesce(text, '')) AS text_md5 FROM copies
"""


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATE_SQL = f"""
WITH items AS (SELECT item_id, {WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS win, least(len(w), 13) AS size FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM windows),
starts AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size),
hits AS (SELECT s.doc_id, s.i, s.size, item_id FROM (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM starts) s JOIN windows USING (win, size)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN names USING (doc_id)
"""

def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"), least_bytes=0)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), threshold=0.3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_dedup, op2_token_output, op3_chat_format, op4_media_flac, op5_source_mixing, op6_suffix_dedup, op7_decontamination, op8_warc, op9_near_dedup, op10_toxicity)}
SQL: dict[str, str] = {"op1_line_dedup": line_dedup.LINE_DEDUP_SQL, "op3_chat_format": CHAT_SQL, "op8_warc": warc.WARC_SQL, "op5_source_mixing": MIX_SQL, "op7_decontamination": DECONTAMINATE_SQL, "op9_near_dedup": near_dup.NEAR_DUP_SQL}
