"""MinHash near-dedup with tensored banding.

Two collections of SUB sub-keys, each of ROWS minhashes, are paired into SUB * SUB table keys, so that 2 * SUB * ROWS minhashes serve as many tables
as would else need SUB * SUB * 2 * ROWS. Documents with equal shingle sets are one class; classes that share a table key are candidates, and links are
confirmed on full sets. In each bucket members are first compared with its smallest, then with its largest member. What is still apart is compared by how
it differs from the shingles that most sets of its family have: near copies share nearly all their shingles but few of their differences, so differences
lead to links where whole sets would lead to all pairs of a family.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, drop_table, give_back, release_shuffles, stage_table, text_or_empty

#: A pair of similarity 0.8 is missed with probability 2 * (1 - 0.8 ** ROWS) ** SUB, about 4e-4, at 0.9 less than 1e-6.
SUB, ROWS = 12, 3
SLICE_BYTES = 2_000_000
#: Ids of compared documents up to this count (8 bytes each) are broadcast to pick their texts; beyond it they are joined.
BROADCAST_IDS = 1_000_000
#: Bytes that separate words.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
U = np.uint64
P, P_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@lru_cache(maxsize=4)
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def shingle_hashes(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all word k-shingles, text after text, and how many each text has."""
    joined = b" ".join(texts).lower() + b" "
    raw = np.frombuffer(joined, np.uint8)
    blank = BLANK[raw]
    edges = np.flatnonzero(np.diff(blank.astype(np.int8), prepend=1))
    begin, end = edges[0::2], edges[1::2]
    size = 1 << max(12, len(raw).bit_length())
    sums = np.concatenate([np.zeros(1, U), np.cumsum((raw.astype(U) + U(1)) * powers(P, size)[: len(raw)], dtype=U)])
    words = mixed((sums[end] - sums[begin]) * powers(P_INV, size)[begin] + (end - begin).astype(U) * U(0xD6E8FEB86659FD93))
    bounds = np.searchsorted(begin, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    n_words = np.diff(bounds)
    counts = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    out = np.zeros(len(words), U)
    whole = max(0, len(words) - k + 1)
    for j in range(k):
        out[:whole] = mixed(out[:whole] * U(0x2545F4914F6CDD1D) + words[j : j + whole] + U(j))
    for d in np.flatnonzero((n_words > 0) & (n_words < k)):
        h = np.zeros(1, U)
        for j in range(bounds[d], bounds[d + 1]):
            h = mixed(h * U(0xA0761D6478BD642F) + words[j : j + 1] + U(77))
        out[bounds[d]] = h[0]
    starts = np.cumsum(counts) - counts
    return out[np.repeat(bounds[:-1] - starts, counts) + np.arange(int(counts.sum()))], counts


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted set of each text."""
    flat, counts = shingle_hashes(texts, k)
    return [np.unique(x) for x in np.split(flat, np.cumsum(counts)[:-1])] if texts else []


def sketch(sets: list[np.ndarray], sub: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sub-keys (documents x 2 * sub) and set fingerprints (documents x 2) of nonempty sets."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    keys = np.zeros((len(sets), 2 * sub), U)
    rng = np.random.default_rng(7)
    factors = rng.integers(1, 1 << 63, 2 * sub * rows, dtype=U) | U(1)
    for i in range(2 * sub * rows):
        least = np.minimum.reduceat((flat * factors[i]) ^ (flat >> U(29)), starts)
        keys[:, i // rows] = mixed(keys[:, i // rows] * U(0x2545F4914F6CDD1D) + least + U(i))
    prints = np.stack([np.add.reduceat(mixed(flat + U(1)), starts), np.add.reduceat(mixed(flat ^ U(0x5851F42D4C957F2D)), starts)], 1)
    return keys, prints


def utf8_slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    texts = batch.column(column).cast(pa.binary()).to_pylist()
    first, held = 0, 0
    for j, t in enumerate(texts):
        held += len(t)
        if held >= size or j == len(texts) - 1:
            yield first, texts[first : j + 1]
            first, held = j + 1, 0


def sketches(rows: DataFrame, k: int, sub: int, r: int) -> DataFrame:
    """rows(_id, _text) -> ``_id, _n, _f1, _f2, _a, _b``; _a and _b are null where the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in utf8_slices(b, "_text"):
                sets = shingle_sets(texts, k)
                sizes = np.array([len(x) for x in sets])
                full = np.flatnonzero(sizes)
                f = np.zeros((len(sets), 2), np.int64)
                a: list = [None] * len(sets)
                c: list = [None] * len(sets)
                if len(full):
                    keys, prints = sketch([sets[d] for d in full], sub, r)
                    f[full] = prints.view(np.int64)
                    keys = keys.view(np.int64)
                    for d, row in zip(full, keys, strict=True):
                        a[d], c[d] = row[:sub], row[sub:]
                kind = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("_id").slice(first, len(texts)), pa.array(sizes, pa.int64()), pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(a, kind), pa.array(c, kind)], names=["_id", "_n", "_f1", "_f2", "_a", "_b"])
        powers.cache_clear()
        give_back()

    return rows.mapInArrow(run, "_id long, _n long, _f1 long, _f2 long, _a array<long>, _b array<long>")


def confirmed(pairs: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs(_x, _y), staged, those with 100 * |intersection| >= percent * |union| of the full shingle sets."""
    ids = pairs.select(F.explode(F.array("_x", "_y")).alias("_id")).distinct()
    ids = stage_table(ids, "ids")
    few = ids.count() <= BROADCAST_IDS
    texts = rows.join(F.broadcast(ids) if few else ids, "_id", "left_semi")
    left = pairs.join(texts.select(F.col("_id").alias("_x"), F.col("_text").alias("_tx")), "_x")
    both = left.join(texts.select(F.col("_id").alias("_y"), F.col("_text").alias("_ty")), "_y").select("_x", "_y", "_tx", "_ty")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[int, np.ndarray] = {}
        for b in batches:
            x, y = b.column("_x").to_numpy(), b.column("_y").to_numpy()
            tx, ty = b.column("_tx").cast(pa.binary()), b.column("_ty").cast(pa.binary())
            for first in range(0, len(x), 200):
                if len(memo) > 2000:
                    memo.clear()
                span = range(first, min(first + 200, len(x)))
                for ids, column in ((x, tx), (y, ty)):
                    new = {int(ids[j]): column[j].as_py() for j in span if int(ids[j]) not in memo}
                    memo.update(zip(new, shingle_sets(list(new.values()), k), strict=True))
                keep = []
                for j in span:
                    s, t = memo[int(x[j])], memo[int(y[j])]
                    same = 0
                    if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)):
                        at = np.searchsorted(t, s)
                        same = int(np.count_nonzero(t[np.minimum(at, len(t) - 1)] == s)) if len(t) else 0
                    keep.append(same > 0 and 100 * same >= percent * (len(s) + len(t) - same))
                yield b.slice(first, len(span)).select(["_x", "_y"]).filter(pa.array(keep, pa.bool_()))
        memo.clear()
        powers.cache_clear()
        give_back()

    out = stage_table(both.mapInArrow(run, "_x long, _y long").distinct(), "links")
    drop_table(ids)
    return out


def components(links: DataFrame) -> DataFrame:
    """links(_x, _y) -> ``_id, _component`` (the smallest id reachable) for the ids in links; alternating large and small stars.

    Links of an id with itself, repeated links and those in either direction count as one; no links give no rows. Rounds end when the edges are stars already,
    which the least and largest neighbours tell: each node is then the smallest of its neighbours or has only one.
    """
    edges = stage_table(links.where("_x != _y").select(F.greatest("_x", "_y").alias("_x"), F.least("_x", "_y").alias("_y")).distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("_y"), F.col("_x")))
        # large star: every larger neighbour of a node is tied to the node's smallest neighbour
        least = stage_table(both.groupBy("_x").agg(F.least(F.min("_y"), F.col("_x")).alias("_m"), (F.min("_y") != F.max("_y")).alias("_many")), "least")
        if least.where("_m != _x AND _many").isEmpty():
            drop_table(least)
            break
        large = both.join(least, "_x").where("_y > _x").select(F.col("_y").alias("_x"), F.col("_m").alias("_y"))
        large = stage_table(large, "large")
        # small star: a node and its smaller neighbours are tied to the smallest of them
        low = stage_table(large.groupBy("_x").agg(F.min("_y").alias("_m")), "low")
        small = large.join(low, "_x").select(F.col("_y").alias("_x"), F.col("_m").alias("_y")).union(low.select("_x", F.col("_m")))
        new = stage_table(small.where("_x != _y").distinct(), "edges")
        for t in (edges, least, large, low):
            drop_table(t)
        edges = new
    return edges.select(F.col("_x").alias("_id"), F.col("_y").alias("_component")).union(edges.select(F.col("_y"), F.col("_y")).distinct())


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels(_id, _component) of components() with further links(_x, _y), staged; the same table where there are none."""
    if links.isEmpty():
        return labels
    return stage_table(components(labels.select(F.col("_id").alias("_x"), F.col("_component").alias("_y")).union(links)), "labels")


def bucket_rows(reps: DataFrame) -> DataFrame:
    """reps(_id, _n, _a, _b) -> ``_key, _id, _n, _lo, _hi`` for keys that several ids share."""
    rows = reps.select("_id", "_n", "_b", F.posexplode("_a").alias("_i", "_ka")).select("_id", "_n", "_i", "_ka", F.posexplode("_b").alias("_j", "_kb"))
    rows = rows.select(F.xxhash64("_i", "_ka", "_j", "_kb").alias("_key"), "_id", "_n")
    own = Window.partitionBy("_key")
    return rows.withColumn("_lo", F.min("_id").over(own)).withColumn("_hi", F.max("_id").over(own)).where("_lo < _hi")


def with_component(rows: DataFrame, labels: DataFrame | None, id_col: str = "_id", out: str = "_c") -> DataFrame:
    if labels is None:
        return rows.withColumn(out, F.col(id_col))
    return rows.join(labels.select(F.col("_id").alias(id_col), F.col("_component").alias("_l")), id_col, "left").withColumn(out, F.coalesce("_l", id_col)).drop("_l")


def member_sets(members: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The sets of members(_id, _c, _g) -> ``_r, _id, _n, _c, _g, _s``, one row for each different set of an id."""
    few = members.count() <= BROADCAST_IDS
    texts = rows.join(F.broadcast(members) if few else members, "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in utf8_slices(b, "_text"):
                sets = shingle_sets(texts, k)
                own = b.slice(first, len(texts))
                n, prints = [len(x) for x in sets], [int(mixed(x + U(1)).sum(dtype=U).view(np.int64)) for x in sets]
                s = pa.ListArray.from_arrays(np.cumsum([0, *n]).astype(np.int32), np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays([own.column("_id"), own.column("_c"), own.column("_g"), pa.array(n, pa.int64()), pa.array(prints, pa.int64()), s], names=["_id", "_c", "_g", "_n", "_f", "_s"])
        powers.cache_clear()
        give_back()

    sets = texts.mapInArrow(run, "_id long, _c long, _g long, _n long, _f long, _s array<long>").where("_n > 0").dropDuplicates(["_id", "_n", "_f"])
    return sets.select(F.xxhash64("_id", "_n", "_f").alias("_r"), "_id", "_n", "_c", "_g", "_s")


def cross_links(apart: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (_x, _y) between ids of apart(_key, _id, _c) that share a key, or a chain of keys, and have different _c; exact on full sets.

    Ids that keys connect are a family, and its pivot holds the shingles that more than half of its sets have. A set of n shingles has d differences: what it has
    beside the pivot and what it lacks of it. Two sets with o differences in common differ by d + d' - 2 * o shingles, so they are linked if and only if
    2 * (100 + percent) * o >= W + W', where W = (100 + percent) * d - (100 - percent) * n. Sets with W + (the least W of the family) <= 0 are linked with that
    set whatever they share. All other links have a set beyond that and share so many differences that one is among the rarest few of both (a prefix filter on
    differences, with positions).
    """
    span = Window.partitionBy("_key")
    chains = apart.select(F.col("_id").alias("_x"), F.min("_id").over(span).alias("_y"))
    families = components(chains)
    members = stage_table(apart.select("_id", "_c").distinct().join(families.select("_id", F.col("_component").alias("_g")), "_id"), "members")
    own = stage_table(member_sets(members, rows, k), "sets")
    sizes = stage_table(own.groupBy("_g").agg(F.count(F.lit(1)).alias("_z")), "sizes")
    # more than half of two sets or more are two at least, and a family of one set has no links
    most = own.select("_g", F.explode("_s").alias("_e")).groupBy("_g", "_e").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").join(sizes, "_g").where("2 * _k > _z")
    pivots = stage_table(most.groupBy("_g").agg(F.collect_list("_e").alias("_p")), "pivots")

    pivot = F.coalesce("_p", F.array().cast("array<long>"))
    differences = F.concat(F.array_except("_s", pivot), F.array_except(pivot, "_s"))
    sets = own.join(pivots, "_g", "left").select("_r", "_id", "_n", "_c", "_g", differences.alias("_d"))
    unit = 2 * (100 + percent)
    sets = stage_table(sets.withColumn("_w", F.size("_d") * (100 + percent) - F.col("_n") * (100 - percent)), "differences")
    # one row a family and weight, then one a family, so that the sets of a large family meet its bounds in one join that can be split
    weights = sets.groupBy("_g", "_w").agg(F.min_by("_id", "_r").alias("_best"))
    least = stage_table(weights.groupBy("_g").agg(F.min("_w").alias("_least"), F.min_by("_best", "_w").alias("_best")), "least")
    far_least = weights.join(least, "_g").where("_w + _least > 0").groupBy("_g").agg(F.min("_w").alias("_far_least"))
    bounds = stage_table(least.join(far_least, "_g", "left"), "bounds")
    sets = sets.join(bounds, "_g").withColumn("_far", F.col("_w") + F.col("_least") > 0)
    # families without sets beyond have all their links by now
    beyond = stage_table(sets.where("_far_least IS NOT NULL"), "beyond")
    certain = sets.where("NOT _far AND _id != _best").select(F.col("_id").alias("_x"), F.col("_best").alias("_y"))

    flat = beyond.select("_g", "_r", F.explode("_d").alias("_e"))
    rarity = flat.groupBy("_g", "_e").agg(F.count(F.lit(1)).alias("_k"))
    ranked = flat.join(rarity, ["_g", "_e"]).groupBy("_r").agg(F.array_sort(F.collect_list(F.struct("_k", "_e"))).alias("_o"))
    need = lambda w: F.ceil((F.col("_w") + F.col(w)) / unit)
    docs = beyond.join(ranked, "_r").withColumn("_size", F.size("_d")).withColumn("_to_far", F.col("_size") - need("_far_least") + 1)
    docs = docs.withColumn("_to_near", F.when(F.expr("_far AND _least <= 0"), F.col("_size") - need("_least") + 1))
    posted = docs.select("_g", "_r", "_c", "_n", "_w", "_far", "_size", "_to_far", "_to_near", F.posexplode("_o").alias("_at", "_oe"))
    posted = posted.where((F.col("_at") < F.greatest("_to_far", F.coalesce("_to_near", "_to_far"))) & (F.col("_oe._k") > 1)).withColumn("_e", F.col("_oe._e")).drop("_oe")
    posted = stage_table(posted, "posted")
    other = posted.select("_g", "_e", *(F.col(c).alias(f"{c}o") for c in ("_r", "_c", "_n", "_w", "_far", "_size", "_to_far", "_at")))
    near = ~F.col("_faro") & (F.col("_at") < F.col("_to_near"))
    far = F.col("_faro") & (F.col("_at") < F.col("_to_far")) & (F.col("_ato") < F.col("_to_faro")) & (F.col("_r") < F.col("_ro"))
    left = F.least(F.col("_size") - F.col("_at"), F.col("_sizeo") - F.col("_ato"))
    fits = (F.least("_n", "_no") * 100 >= F.greatest("_n", "_no") * percent) & (left * unit >= F.col("_w") + F.col("_wo"))
    pairs = posted.where("_far").join(other, ["_g", "_e"]).where((F.col("_c") != F.col("_co")) & fits & (near | far))
    pairs = stage_table(pairs.select("_r", "_ro").distinct(), "pairs")

    side = beyond.select("_r", "_id", "_w", "_d")
    other = side.select(*(F.col(c).alias(f"{c}o") for c in side.columns))
    shared = F.size(F.array_intersect("_d", "_do"))
    found = pairs.join(side, "_r").join(other, "_ro").where(shared * unit >= F.col("_w") + F.col("_wo"))
    out = stage_table(certain.union(found.select(F.col("_id").alias("_x"), F.col("_ido").alias("_y"))).distinct(), "links")
    for t in (members, own, sizes, pivots, least, bounds, beyond, posted, pairs):
        drop_table(t)
    return out


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, sub: int = SUB, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    A null text is empty; empty sets are linked with nothing. Rows of equal doc_id are one node that has all their links; a null doc_id is linked with nothing,
    has a null component_id and is kept. Extra columns are ignored; an empty table gives an empty table.
    """
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text"))
    own = stage_table(sketches(texts, shingle, sub, rows), "sketches")
    known = own.where("_n > 0 AND _id IS NOT NULL")
    classes = stage_table(known.groupBy("_n", "_f1", "_f2").agg(F.min("_id").alias("_rep"), F.any_value("_a").alias("_a"), F.any_value("_b").alias("_b")), "classes")
    buckets = stage_table(bucket_rows(classes.select(F.col("_rep").alias("_id"), "_n", "_a", "_b")), "buckets")
    release_shuffles(spark)

    tested, labels = None, None
    for end in ("_lo", "_hi"):
        rows_now = buckets.select("_id", F.col(end).alias("_end")).where("_id != _end").distinct()
        if labels is not None:
            rows_now = with_component(with_component(rows_now, labels), labels, "_end", "_ce").where("_c != _ce")
        pairs = rows_now.select(F.greatest("_id", "_end").alias("_x"), F.least("_id", "_end").alias("_y")).distinct()
        pairs = stage_table(pairs if tested is None else pairs.join(tested, ["_x", "_y"], "left_anti"), "pairs")
        found = confirmed(pairs, texts, shingle, percent)
        labels = stage_table(components(found), "labels") if labels is None else merged(labels, found)
        tested = pairs if tested is None else tested.union(pairs)
        release_shuffles(spark)
    apart = with_component(buckets.select("_key", "_id", "_n"), labels)
    span = Window.partitionBy("_key")
    apart = stage_table(apart.withColumn("_l", F.min("_c").over(span)).withColumn("_h", F.max("_c").over(span)).where("_l < _h").select("_key", "_id", "_c"), "apart")
    # rows of one doc_id may be in several classes: they tie those classes together
    ties = known.join(classes.select("_n", "_f1", "_f2", "_rep"), ["_n", "_f1", "_f2"]).where("_id != _rep").select(F.col("_id").alias("_x"), F.col("_rep").alias("_y")).distinct()
    labels = merged(labels, cross_links(apart, texts, shingle, percent).union(ties))
    for t in (buckets, apart, classes):
        drop_table(t)
    release_shuffles(spark)
    out = own.select("_id", "_n").join(labels, "_id", "left")
    component = F.coalesce("_component", "_id")
    return out.select(F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **options: object) -> DataFrame:
    """The rows of the smallest doc_id of each component, with all their columns, whatever their names. Rows without an id, without words and an empty table stay as they are; rows of one id stay or go together."""
    gone = near_duplicates(docs, id_col=id_col, **options).where("NOT kept").select("doc_id").distinct().alias("gone")
    return docs.alias("own").join(gone, F.col(f"own.`{id_col}`") == F.col("gone.doc_id"), "left_anti")


WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
NEAR_DUP_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, {WORDS} AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
flat AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sets p ON p.doc_id = x JOIN sets q ON q.doc_id = y WHERE 100 * n >= 80 * (len(p.s) + len(q.s) - n)),
ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, e.y FROM reach r JOIN ways e ON r.b = e.x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM sets JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) ON a = doc_id
"""
