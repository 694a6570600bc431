"""Removal of repeated byte strings by suffix sorting.

Equal strings of LENGTH bytes have the same anchor: the smallest hashed GRAM-byte string inside. Starts are dealt out by anchor, so that equal strings meet in one shard with
their contexts; anchors that occur once can't repeat and stay where they are. Starts of an anchor with many distinct contexts are dealt out again, by finer
functions of their strings, until no key has more than HOT_BYTES. A shard's distinct contexts are suffix-sorted (suffix_array) and starts whose
suffixes share LENGTH bytes are repeated. Contexts that many documents share are one context with a weight.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, release_shuffles, shared_dir, stage_table
from .suffix_array import QUEUE_BYTES, common_prefixes, suffix_array

GRAM = 32
SLICE_BYTES = 2_000_000
#: Bytes of contexts that are sorted at once; the contexts of one key always stay together.
SHARD_BYTES = 2 << 20
#: Bytes of distinct contexts from which an anchor's starts are dealt out by finer keys.
HOT_BYTES = 1 << 19
#: Rounds of finer keys by a further anchor; the last round is by the whole string, of which a key has one context.
FINER_ROUNDS = 3
#: Positions are packed below the hash; longer texts are taken in chunks of starts.
POSITION_BITS = 24
CHUNK = (1 << POSITION_BITS) - 4096
U = np.uint64


def gram_hashes(raw: np.ndarray, gram: int = GRAM, seed: int = 5) -> np.ndarray:
    """A 64-bit hash of the gram bytes (a power of two) from each position on."""
    h = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=U)[raw]
    span = 1
    while span < gram:
        h = h[: len(h) - span] * U(0x9E3779B97F4A7C15 + 2 * span) + h[span:]
        h ^= h >> U(29)
        span *= 2
    return h * U(0xBF58476D1CE4E5B9)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(raw: np.ndarray, bounds: np.ndarray, length: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts raw[bounds[d]:bounds[d+1]]: text, first and last start, anchor position (all in raw) and anchor hash of every run of starts with one anchor."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, none, none
    h = gram_hashes(raw, seed=seed)
    low = U((1 << POSITION_BITS) - 1)
    least = sliding_min((h & ~low) | np.arange(len(h), dtype=U), length - GRAM + 1)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(least)]
    ok = np.arange(len(least)) + length <= bounds[1:][doc]
    starts = np.flatnonzero(ok)
    if not len(starts):
        return none, none, none, none, none
    at = (least[starts] & low).astype(np.int64)
    cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(doc[starts]) != 0))
    first, last = starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])]
    at = at[np.concatenate([[0], cut + 1])]
    return doc[first], first, last, at, h[at].view(np.int64)


def text_runs(texts: list[bytes]) -> Iterator[tuple[int, list[bytes], int]]:
    """Row number, texts and the offset of the first in its row's text: runs of whole rows of about SLICE_BYTES, CHUNK at most; texts over CHUNK by chunks that overlap."""
    first, held = 0, 0
    for j, t in enumerate(texts):
        if len(t) > CHUNK:
            if j > first:
                yield first, texts[first:j], 0
            for at in range(0, len(t), CHUNK - 4096):
                yield j, [t[at : at + CHUNK]], at
            first, held = j + 1, 0
            continue
        if held + len(t) > CHUNK:
            yield first, texts[first:j], 0
            first, held = j, 0
        held += len(t)
        if held >= SLICE_BYTES or j == len(texts) - 1:
            yield first, texts[first : j + 1], 0
            first, held = j + 1, 0
    if first < len(texts):
        yield first, texts[first:], 0


def find_anchors(rows: DataFrame, length: int) -> DataFrame:
    """rows(_id, _th, _text) -> ``_id, _th, _first, _n, _h``: n starts from first on, by byte offset in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes = b.column("_id").to_numpy(zero_copy_only=False), b.column("_th").to_numpy(zero_copy_only=False)
            for row, texts, at in text_runs(b.column("_text").cast(pa.binary()).to_pylist()):
                bounds = np.cumsum([0, *map(len, texts)])
                doc, first, last, _, h = anchors(np.frombuffer(b"".join(texts), np.uint8), bounds, length)
                if at and len(first):  # starts that the chunk before had
                    keep = last >= 4096 - length + 1
                    doc, first, last, h = doc[keep], np.maximum(first[keep], 4096 - length + 1), last[keep], h[keep]
                yield pa.RecordBatch.from_arrays([pa.array(ids[row + doc]), pa.array(hashes[row + doc]), pa.array(first - bounds[doc] + at), pa.array((last - first + 1).astype(np.int32)), pa.array(h)], names=["_id", "_th", "_first", "_n", "_h"])

    return rows.mapInArrow(run, "_id long, _th long, _first long, _n int, _h long")


def cut_contexts(joined: DataFrame, length: int) -> DataFrame:
    """joined(_id, _th, _text, _runs) -> ``_id, _th, _first, _h, _n, _hot, _c``: the bytes that n starts need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("_text").cast(pa.binary())
            for k in range(b.num_rows):
                text, runs = texts[k].as_py(), b.column("_runs")[k].values
                first, n = (runs.field(c).to_numpy() for c in ("_first", "_n"))
                contexts = [text[a : a + m + length - 1] for a, m in zip(first.tolist(), n.tolist(), strict=True)]
                m = len(first)
                yield pa.RecordBatch.from_arrays([pa.repeat(b.column("_id")[k], m), pa.repeat(b.column("_th")[k], m), runs.field("_first"), runs.field("_h"), runs.field("_n"), runs.field("_hot"), pa.array(contexts, pa.binary())], names=["_id", "_th", "_first", "_h", "_n", "_hot", "_c"])

    return joined.mapInArrow(run, "_id long, _th long, _first long, _h long, _n int, _hot boolean, _c binary")


def string_keys(raw: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts raw[bounds[d]:bounds[d+1]]: text, first and last start and a hash of the whole string, for every start."""
    gram = 1 << (length.bit_length() - 1)
    h = gram_hashes(raw, gram)
    h = h[: len(raw) - length + 1] * U(0x9E3779B97F4A7C15) + h[length - gram :]
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(h)]
    starts = np.flatnonzero(np.arange(len(h)) + length <= bounds[1:][doc])
    return doc[starts], starts, starts, h[starts].view(np.int64)


def finer_contexts(contexts: DataFrame, length: int, level: int) -> DataFrame:
    """contexts(_ph, _pk, _first, _h, _c, _w) -> the same starts with finer keys, which equal strings of one key share, in contexts of their own; _first stays an offset in the first context."""
    schema = "_ph long, _pk binary, _first long, _h long, _c binary, _w long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begin, old = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_first", "_h"))
            for row, texts, _ in text_runs(b.column("_c").to_pylist()):
                bounds = np.cumsum([0, *map(len, texts)])
                raw = np.frombuffer(b"".join(texts), np.uint8)
                if level < FINER_ROUNDS:
                    doc, first, last, _, h = anchors(raw, bounds, length, 5 + level)
                else:
                    doc, first, last, h = string_keys(raw, bounds, length)
                keys = (old[row + doc].view(U) * U(0x9E3779B97F4A7C15) + h.view(U)) * U(0xBF58476D1CE4E5B9)
                for i in range(0, len(doc), 20_000):
                    part = slice(i, i + 20_000)
                    d, f, e = doc[part], first[part], last[part]
                    cut = pa.array([raw[x : y + length].tobytes() for x, y in zip(f.tolist(), e.tolist(), strict=True)], pa.binary())
                    own = pa.array(row + d)
                    yield pa.RecordBatch.from_arrays([b.column("_ph").take(own), b.column("_pk").take(own), pa.array(begin[row + d] + f - bounds[d]), pa.array(keys[part].view(np.int64)), cut, b.column("_w").take(own)], names=["_ph", "_pk", "_first", "_h", "_c", "_w"])

    return contexts.select("_ph", "_pk", "_first", "_h", "_c", "_w").mapInArrow(run, schema).withColumn("_k", F.unhex(F.md5("_c")))


def hot_keys(contexts: DataFrame) -> DataFrame | None:
    """Keys with more than HOT_BYTES of distinct contexts; None if there are none."""
    size = contexts.select("_h", "_k", F.length("_c").alias("_b")).distinct().groupBy("_h").agg(F.sum("_b").alias("_b"))
    hot = stage_table(size.where(F.col("_b") > HOT_BYTES).select("_h"), "hot")
    return None if hot.isEmpty() else hot


def split_hot(distinct: DataFrame, length: int) -> tuple[DataFrame | None, list[DataFrame]]:
    """distinct(_h, _c, _w, _k) -> the starts of keys with more than HOT_BYTES under finer keys: ``_ph, _pk`` (key and md5 of the context in distinct), ``_first, _h, _c, _w, _k``, in keys that
    are within HOT_BYTES or have one context; None if no key is hot. And the tables to drop after use."""
    cool, made = [], []
    part = distinct.select(F.col("_h").alias("_ph"), F.col("_k").alias("_pk"), F.lit(0).cast("long").alias("_first"), "_h", "_c", "_w", "_k")
    hot, level = hot_keys(part), 1
    if hot is None:
        return None, made
    while hot is not None:
        if level > 1:
            cool.append(part.join(hot, "_h", "left_anti").select(*part.columns))
        part = stage_table(finer_contexts(part.join(hot, "_h", "left_semi"), length, level), f"finer{level}")
        made += [hot, part]
        hot = hot_keys(part) if level < FINER_ROUNDS else None
        level += 1
    for c in cool:
        part = part.unionByName(c)
    return part, made


def repeated_starts(contexts: list[bytes], weights: np.ndarray, groups: np.ndarray, length: int, folder: str | None) -> list[list[tuple[int, int]]]:
    """Of each context, the runs (begin, end) of its starts whose string also starts elsewhere in a context of the same group, or in a second owner of the same context."""
    sizes = np.array([len(c) for c in contexts])
    text = np.frombuffer(b"".join(contexts), np.uint8)
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(contexts)), sizes)
    order = suffix_array(text, length, folder, QUEUE_BYTES)
    own = owner[order]
    ok = order - begin[own] <= sizes[own] - length
    order, own = order[ok], own[ok]
    shared = common_prefixes(text, order, length)
    string = np.cumsum(shared < length)
    # strings that agree beside different anchors are counted with their own anchor only
    key = string * (int(groups.max()) + 1) + groups[own]
    _, where = np.unique(key, return_inverse=True)
    again = np.bincount(where, weights[own])[where] > 1
    marked = np.zeros(len(text) + 1, bool)
    marked[order[again]] = True
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    edge = np.zeros(len(text) + 1, bool)
    edge[begin] = True  # a run ends with its context
    first = np.flatnonzero(marked[:-1] & (edge[:-1] | ~np.concatenate([[False], marked[:-2]])))
    last = np.flatnonzero(marked[:-1] & (edge[1:] | ~marked[1:])) + 1
    own = owner[first]
    for d, x, y in zip(own.tolist(), (first - begin[own]).tolist(), (last - begin[own]).tolist(), strict=True):
        out[d].append((x, y))
    return out


def sort_shards(contexts: DataFrame, length: int, folder: str | None) -> DataFrame:
    """contexts(_h, _c, _w), dealt by _h, no key with more than HOT_BYTES -> ``_h, _k, _runs`` for contexts with repeated starts; _k is the context's md5."""

    def flush(held: list) -> pa.RecordBatch:
        h = np.array([x[0] for x in held])
        _, groups = np.unique(h, return_inverse=True)
        found = repeated_starts([x[1] for x in held], np.array([x[2] for x in held]), groups, length, folder)
        kept = [(x[0], hashlib.md5(x[1]).digest(), [{"a": a, "b": b} for a, b in runs]) for x, runs in zip(held, found, strict=True) if runs]
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in kept], pa.int64()), pa.array([x[1] for x in kept], pa.binary()), pa.array([x[2] for x in kept], kind)], names=["_h", "_k", "_runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for h, c, w in zip(*(b.column(i).to_pylist() for i in ("_h", "_c", "_w")), strict=True):
                if size >= SHARD_BYTES and held[-1][0] != h:
                    yield flush(held)
                    held, size = [], 0
                held.append((h, c, w))
                size += len(c)
        if held:
            yield flush(held)

    return contexts.repartition("_h").sortWithinPartitions("_h").mapInArrow(run, "_h long, _k binary, _runs array<struct<a:int,b:int>>")


def spill_folder(spark: SparkSession) -> str | None:
    """The shared folder for queues on disk; only where executors reach it as files."""
    base = shared_dir(spark)
    path = base.removeprefix("file://") if base.startswith("file:") else base
    return path if path.startswith("/") else None


def find_repeats(rows: DataFrame, length: int) -> DataFrame:
    """rows(_id, _th, _text) -> ``_id, _th, _runs``: runs (begin, end) of the starts, in bytes, of repeated strings of a text; texts without are left out."""
    spark = rows.sparkSession
    found = stage_table(find_anchors(rows, length), "anchors")
    twice = found.groupBy("_h").agg(F.count(F.lit(1)).alias("_w"), F.sum(F.col("_n") + (length - 1)).alias("_b")).where("_w > 1")
    twice = stage_table(twice.select("_h", (F.col("_b") > HOT_BYTES).alias("_hot")), "twice")
    runs = found.join(twice, "_h").groupBy("_id", "_th").agg(F.collect_set(F.struct("_first", "_n", "_h", "_hot")).alias("_runs"))
    runs = stage_table(runs, "runs")
    drop_table(found)
    drop_table(twice)
    release_shuffles(spark)
    contexts = stage_table(cut_contexts(rows.join(runs, ["_id", "_th"]).select("_id", "_th", "_text", "_runs"), length).withColumn("_k", F.unhex(F.md5("_c"))), "contexts")
    release_shuffles(spark)
    made = [runs, contexts]
    weighed = lambda some: some.groupBy("_h", "_c").agg(F.count(F.lit(1)).alias("_w"))
    folder = spill_folder(spark)
    # copies of a context are one row from here on; keys that may be hot are looked at apart
    maybe = stage_table(weighed(contexts.where("_hot")).withColumn("_k", F.unhex(F.md5("_c"))), "maybe")
    finer, more = split_hot(maybe, length)
    cool = maybe if finer is None else maybe.join(more[0], "_h", "left_anti")
    release_shuffles(spark)
    marked = stage_table(sort_shards(weighed(contexts.where("NOT _hot")).unionByName(cool.select("_h", "_c", "_w")), length, folder), "marked")
    made += [maybe, *more, marked]
    release_shuffles(spark)
    if finer is not None:
        again = stage_table(sort_shards(finer.groupBy("_h", "_c").agg(F.sum("_w").alias("_w")), length, folder), "again")
        runs_at = F.transform("_runs", lambda r: F.struct((r["a"] + F.col("_first")).cast("int").alias("a"), (r["b"] + F.col("_first")).cast("int").alias("b")))
        parents = finer.select("_ph", "_pk", "_first", "_h", "_k").join(again, ["_h", "_k"]).select("_ph", "_pk", F.inline(runs_at))
        parents = stage_table(parents.groupBy(F.col("_ph").alias("_h"), F.col("_pk").alias("_k")).agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("_runs")), "parents")
        made += [again, parents]
        marked = marked.unionByName(parents)
        release_shuffles(spark)
    back = contexts.select("_id", "_th", "_first", "_h", "_k").join(marked, ["_h", "_k"])
    spans = F.transform("_runs", lambda r: F.struct((r["a"] + F.col("_first")).alias("a"), (r["b"] + F.col("_first")).alias("b")))
    out = stage_table(back.select("_id", "_th", F.inline(spans)).groupBy("_id", "_th").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("_runs")), "repeats")
    for t in made:
        drop_table(t)
    release_shuffles(spark)
    return out


def removed_spans(runs: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by strings of length that start in runs, which are sorted."""
    out: list[list[int]] = []
    for a, b in runs:
        end = b - 1 + length
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([a, end])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, spans, kept`` for each row: every byte covered by a length-byte string that also starts anywhere else in any text is removed.

    Strings never cross texts; kept has the remaining bytes (not always valid UTF-8). A null text is empty. Rows equal in doc_id and text repeat each other. A null doc_id stays null.
    Extra columns are ignored; an empty table gives an empty table.
    """
    if length < GRAM:
        raise ValueError(f"length is at least {GRAM}")
    none = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(none)).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).withColumn("_th", F.xxhash64("_text"))
    repeats = find_repeats(rows.select("_id", "_th", "_text"), length)
    joined = rows.join(repeats, ["_id", "_th"], "left").select("_id", "_text", "_runs")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<begin:long,end:long>>, kept binary"
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            texts = b.column("_text").cast(pa.binary())
            for k, (ident, runs) in enumerate(zip(b.column("_id").to_pylist(), b.column("_runs").to_pylist(), strict=True)):
                text = texts[k].as_py()
                spans = removed_spans([(r["a"], r["b"]) for r in runs or ()], length)
                edges = [0, *(x for s in spans for x in s), len(text)]
                kept = b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
                out.append((None if ident == none else ident, len(text), len(text) - len(kept), len(spans), [{"begin": a, "end": e} for a, e in spans], kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), kind, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return joined.mapInArrow(run, schema)


def repeat_digests(docs: DataFrame, length: int = 200) -> DataFrame:
    """The digests of remove_repeats(), with its rules for nulls, empty and repeated rows and empty tables."""
    return remove_repeats(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
