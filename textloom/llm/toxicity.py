"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy, over all overlapping windows of words.

A word enters as its hashed embedding beside the mean embedding of its hashed character n-grams. Windows of WINDOW words begin every STRIDE words;
a document's score is that of its most toxic window. Only the text is an input.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, drop_table, give_back, stage_table, text_or_empty

WINDOW, STRIDE = 24, 12
WORD_BUCKETS, CHAR_BUCKETS, WORD_DIM, CHAR_DIM, HIDDEN = 1 << 13, 1 << 15, 6, 10, 8
GRAMS = (3, 4, 5)
#: Training reads at most so many labelled rows of each class; the first two epochs so many windows of each, the others choose among all of its windows.
TRAIN_TOXIC, TRAIN_CLEAN, TOXIC_WINDOWS, CLEAN_WINDOWS = 800, 1600, 16, 6
#: One labelled row in so many is held back from training to choose the epoch and the cut.
HOLD_BACK = 6
EPOCHS, BATCH, LEAST_STEPS, RATE = 5, 256, 60, 0.02
#: The cut between the classes' most toxic windows is moved to this score.
CUT = 0.3
SLICE_BYTES = 2_000_000
U = np.uint64


def words_of(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct lower-case words, the index of each word of all texts, and how many words each text has."""
    split = [t.lower().encode("utf-8", "surrogatepass").split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for ws in split for w in ws), np.int64, int(counts.sum()))
    return list(index), ids, counts


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word bucket of each word, and buckets of its character n-grams one word after the other with their counts."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    buckets = np.fromiter((zlib.crc32(w) % WORD_BUCKETS for w in words), np.int64, len(words))
    joined = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8).astype(U)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(joined))
    all_grams, owners = [], []
    for n in GRAMS:
        h = np.full(max(0, len(joined) - n + 1), n, U)
        for j in range(n):
            h = (h ^ joined[j : j + len(h)]) * U(0x9E3779B97F4A7C15)
        ok = left[: len(h)] >= n
        all_grams.append(((h >> U(40)) % U(CHAR_BUCKETS)).astype(np.int64)[ok])
        owners.append(owner[: len(h)][ok])
    grams, owners = np.concatenate(all_grams), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return buckets, grams[order], np.bincount(owners, minlength=len(words))


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin (in all words), size, and document of every window; a document without words has one empty window."""
    number = np.maximum(1, 1 + np.ceil((counts - WINDOW) / STRIDE).astype(np.int64))
    doc = np.repeat(np.arange(len(counts)), number)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
    first = np.cumsum(counts) - counts
    return first[doc] + k * STRIDE, np.minimum(WINDOW, counts[doc] - k * STRIDE), doc


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters by name in p; ids index the distinct words of a batch, -1 pads a window."""

    def __init__(self, seed: int = 3):
        g = np.random.default_rng(seed)
        draw = lambda *shape, s=1.0: (g.standard_normal(shape) * s).astype(np.float32)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.p = {"word": draw(WORD_BUCKETS, WORD_DIM, s=0.1), "char": draw(CHAR_BUCKETS, CHAR_DIM, s=0.3), "v": draw(2 * h, s=0.3), "w": draw(2 * h, s=0.3), "b": np.full(1, -1.5, np.float32)}
        for way in "fb":
            self.p |= {f"W{way}": draw(d, 3 * h, s=d**-0.5), f"U{way}": draw(h, 3 * h, s=h**-0.5), f"c{way}": np.zeros(3 * h, np.float32)}

    def embed(self, features: tuple) -> np.ndarray:
        buckets, grams, n = features
        chars = np.zeros((len(buckets), CHAR_DIM), np.float32)
        if len(grams):
            some = np.flatnonzero(n)
            at = (np.cumsum(n) - n)[some]
            table = self.p["char"]
            for i in range(CHAR_DIM):
                chars[some, i] = np.add.reduceat(table[:, i][grams], at) / np.sqrt(n[some])
        return np.concatenate([self.p["word"][buckets], chars], 1)

    def run(self, inputs: dict[str, np.ndarray], ids: np.ndarray, keep: bool = False) -> tuple:
        """inputs: projections of each distinct word with a last row for padding. Returns logits, and what back() needs if keep."""
        n, length = ids.shape
        h = HIDDEN
        states = np.zeros((length, n, 2 * h), np.float32)
        saved: dict[str, list] = {"f": [], "b": []}
        real = (ids >= 0).astype(np.float32)
        for way in "fb":
            x, u = inputs[way], self.p[f"U{way}"]
            s = np.zeros((n, h), np.float32)
            for t in range(length) if way == "f" else range(length - 1, -1, -1):
                a = x[ids[:, t]]
                m = s @ u
                zr = sigmoid(a[:, : 2 * h] + m[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                q = np.tanh(a[:, 2 * h :] + r * m[:, 2 * h :])
                on = z * real[:, t : t + 1]
                if keep:
                    saved[way].append((t, s, z, r, q, m[:, 2 * h :], on))
                s = s + on * (q - s)
                states[t, :, h * (way == "b") : h * (way == "b") + h] = s
        score = states @ self.p["v"]
        score = np.where(real.T > 0, score, np.float32(-30))
        e = np.exp(score - score.max(0))
        att = e / e.sum(0)
        pooled = np.einsum("tn,tnh->nh", att, states)
        return pooled @ self.p["w"] + self.p["b"][0], (states, saved, att, pooled, real) if keep else None

    def inputs(self, emb: np.ndarray) -> dict[str, np.ndarray]:
        emb = np.concatenate([emb, np.zeros((1, emb.shape[1]), np.float32)])
        return {way: emb @ self.p[f"W{way}"] + self.p[f"c{way}"] for way in "fb"}

    def back(self, emb: np.ndarray, features: tuple, ids: np.ndarray, kept: tuple, slope: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients from slope, that of the loss by each logit."""
        states, saved, att, pooled, real = kept
        h, p = HIDDEN, self.p
        g = {"w": pooled.T @ slope, "b": slope.sum(keepdims=True)}
        dpool = slope[:, None] * p["w"]
        value = np.einsum("tnh,nh->tn", states, dpool)
        dscore = att * (value - (att * value).sum(0)) * real.T
        g["v"] = np.einsum("tn,tnh->h", dscore, states)
        dstates = att[:, :, None] * dpool + dscore[:, :, None] * p["v"]
        demb = np.zeros_like(emb)
        for way in "fb":
            u, part = p[f"U{way}"], slice(h * (way == "b"), h * (way == "b") + h)
            da_all = np.zeros((*ids.shape, 3 * h), np.float32)
            gu, ds = np.zeros_like(u), np.zeros((len(ids), h), np.float32)
            for t, s, z, r, q, mq, on in reversed(saved[way]):
                ds = ds + dstates[t][:, part]
                dq = ds * on * (1 - q * q)
                dz = ds * (q - s) * real[:, t : t + 1] * z * (1 - z)
                dr = dq * mq * r * (1 - r)
                da = np.concatenate([dz, dr, dq], 1)
                dm = np.concatenate([dz, dr, dq * r], 1)
                gu += s.T @ dm
                ds = ds * (1 - on) + dm @ u.T
                da_all[:, t] = da
            ok = ids >= 0
            flat, at = da_all[ok], ids[ok]
            dx = np.stack([np.bincount(at, flat[:, i], len(emb)) for i in range(3 * h)], 1).astype(np.float32)
            g |= {f"U{way}": gu, f"W{way}": emb.T @ dx, f"c{way}": dx.sum(0)}
            demb += dx @ p[f"W{way}"].T
        buckets, grams, n = features
        g["word"] = np.stack([np.bincount(buckets, demb[:, i], WORD_BUCKETS) for i in range(WORD_DIM)], 1).astype(np.float32)
        each = np.repeat(demb[:, WORD_DIM:] / np.sqrt(np.maximum(n, 1))[:, None], n, 0)
        g["char"] = np.stack([np.bincount(grams, each[:, i], CHAR_BUCKETS) for i in range(CHAR_DIM)], 1).astype(np.float32)
        return g

    def calibrate(self, top: np.ndarray, label: np.ndarray) -> None:
        """Move the bias so that the cut with the fewest errors among labelled rows' logits, each counted by how far it lies on the wrong side of the cut, gets the score CUT."""
        y = label > 0
        cuts = np.linspace(top.min() - 1, top.max() + 1, 400)
        errors = np.array([sigmoid(c - top[y]).sum() + sigmoid(top[~y] - c).sum() for c in cuts])
        self.p["b"] = self.p["b"] + np.float32(np.log(CUT / (1 - CUT)) - cuts[errors.argmin()])

    def scores(self, texts: list[str]) -> np.ndarray:
        """The score of each text's most toxic window."""
        return 1 / (1 + np.exp(-self.highest(texts)[0]))

    def highest(self, texts: list[str], rows: int = 4096) -> tuple[np.ndarray, list[str]]:
        """Logit and words of each text's most toxic window, the first of equal ones."""
        if not texts:
            return np.zeros(0), []
        words, ids, counts = words_of(texts)
        inputs = self.inputs(self.embed(word_features(words)))
        begin, size, doc = windows_of(counts)
        logit = np.zeros(len(begin))
        ids = np.append(ids, -1)
        for k in range(0, len(begin), rows):
            b, s = begin[k : k + rows, None], size[k : k + rows, None]
            steps = np.arange(max(1, int(s.max())))
            own = np.where(steps < s, ids[np.minimum(b + steps, len(ids) - 1)], -1)
            logit[k : k + rows] = self.run(inputs, own)[0]
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        best = np.maximum.reduceat(logit, first)
        at = np.flatnonzero(logit == best[doc])
        at = at[np.unique(doc[at], return_index=True)[1]]
        return best, [window_text(words, ids, begin[k], size[k]) for k in at]


def window_text(words: list[bytes], ids: np.ndarray, begin: int, size: int) -> str:
    return b" ".join(words[i] for i in ids[begin : begin + size].tolist()).decode("utf-8", "replace")


def drawn_windows(texts: list[str], keys: list[int], toxic: list[int]) -> list[list[str]]:
    """Of each text at most TOXIC_WINDOWS or CLEAN_WINDOWS windows, drawn by its key."""
    words, ids, counts = words_of(texts)
    begin, size, doc = windows_of(counts)
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    for d, (key, label) in enumerate(zip(keys, toxic, strict=True)):
        g = np.random.default_rng(key & 0xFFFFFFFF)
        chosen = g.permutation(np.arange(bounds[d], bounds[d + 1]))[: TOXIC_WINDOWS if label else CLEAN_WINDOWS]
        out.append([window_text(words, ids, begin[k], size[k]) for k in chosen])
    return out


#: A labelled window: its row's key, label and whether the row is held back, the window's words, and the logit of the row's most toxic window.
Window = tuple[int, int, bool, str, float]
Miner = Callable[["Network | None"], list[Window]]


def mine_rows(net: Network | None, keys: list[int], toxic: list[int], held: list[bool], texts: list[str]) -> list[Window]:
    """Without a network the drawn windows of each row, with one the row's most toxic window of all."""
    if net is None:
        return [(k, y, h, w, 0.0) for k, y, h, ws in zip(keys, toxic, held, drawn_windows(texts, keys, toxic), strict=True) for w in ws]
    logits, windows = net.highest(texts)
    return list(zip(keys, toxic, held, windows, logits.tolist(), strict=True))


class Trainer:
    """Adam over minibatches of windows."""

    def __init__(self, net: Network, g: np.random.Generator):
        self.net, self.g, self.count = net, g, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))

    def epoch(self, windows: list[str], toxic: np.ndarray, times: int, rate: float) -> None:
        words, ids, counts = words_of(windows)
        features, ids = word_features(words), np.append(ids, -1)
        begin, steps = np.cumsum(counts) - counts, np.arange(WINDOW)
        grid = np.where(steps < counts[:, None], ids[np.minimum(begin[:, None] + steps, len(ids) - 1)], -1)
        gram_at = np.cumsum(features[2]) - features[2]
        rows = np.tile(np.arange(len(windows)), times)
        for part in np.array_split(self.g.permutation(rows), min(len(rows), max(LEAST_STEPS, len(rows) // BATCH))):
            distinct, back = np.unique(grid[part], return_inverse=True)
            back = back.reshape(grid[part].shape) - int(distinct[0] == -1)
            distinct = distinct[distinct >= 0]
            n = features[2][distinct]
            grams = features[1][np.repeat(gram_at[distinct] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            self.step((features[0][distinct], grams, n), back, toxic[part], rate)

    def step(self, features: tuple, ids: np.ndarray, toxic: np.ndarray, rate: float) -> None:
        net, emb = self.net, self.net.embed(features)
        logit, kept = net.run(net.inputs(emb), ids, keep=True)
        slope = ((sigmoid(logit) - toxic) / len(toxic)).astype(np.float32)
        self.count += 1
        for k, grad in net.back(emb, features, ids, kept, slope).items():
            self.m[k] += np.float32(0.1) * (grad - self.m[k])
            self.v[k] += np.float32(0.01) * (grad * grad - self.v[k])
            net.p[k] -= np.float32(rate) * (self.m[k] / (1 - 0.9**self.count)) / (np.sqrt(self.v[k] / (1 - 0.99**self.count)) + np.float32(1e-7))


def learn(mine: Miner, seed: int = 3) -> Network:
    """First all drawn windows with their row's label, then in each epoch the window of each row that scores highest of all its windows.

    Rows held back are never trained on: of the states after each epoch that with the fewest errors on them stays (the smaller loss if equal), and they set the cut.
    Without both labels among the rows to train on the network stays as drawn, with low scores.
    """
    net = Network(seed)
    rows = sorted(mine(None))
    if len({y for _, y, h, _, _ in rows if not h}) < 2:
        return net
    trainer = Trainer(net, np.random.default_rng(seed))
    best: tuple | None = None
    for epoch in range(EPOCHS):
        own = [r for r in rows if not r[2]]
        trainer.epoch([r[3] for r in own], np.array([r[1] for r in own], np.float32), 1 if epoch < 2 else 2, RATE * (0.5 if epoch == EPOCHS - 1 else 1))
        if epoch == 0:
            continue
        rows = sorted(mine(net))
        apart = [r for r in rows if r[2]]
        apart = apart if len({r[1] for r in apart}) == 2 else rows
        top, label = np.array([r[4] for r in apart]), np.array([r[1] for r in apart], np.float32)
        state = Network(seed)
        state.p = {k: x.copy() for k, x in net.p.items()}
        state.calibrate(top, label)
        top = top + float(state.p["b"][0] - net.p["b"][0])
        judged = (int(((sigmoid(top) >= CUT) != (label > 0)).sum()), float(np.mean(np.logaddexp(0, np.where(label > 0, -top, top)))))
        if best is None or judged < best[0]:
            best = (judged, state)
    return best[1] if best else net


def train(texts: list[str], toxic: list[int], seed: int = 3) -> Network:
    """learn() from texts in memory; each HOLD_BACK-th row is held back."""
    keys = list(range(len(texts)))
    return learn(lambda net: mine_rows(net, keys, toxic, [k % HOLD_BACK == HOLD_BACK - 1 for k in keys], texts), seed)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_k, _i, _y, _held, _t``: at most TRAIN_TOXIC and TRAIN_CLEAN labelled ids whose crc32(doc_id) mod 4 is not 2, one row for each id and label (of several the text of the smallest hash)."""
    known = labels.where("toxic IN (0, 1)").select(F.col("doc_id").alias("_i"), F.col("toxic").cast("int").alias("_y")).distinct()
    known = known.where(F.pmod(F.crc32(F.col("_i").cast("string").cast("binary")), F.lit(4)) != 2)
    chosen = None
    for kind, most in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN)):
        some = known.where(F.col("_y") == kind).orderBy(F.xxhash64("_i", F.lit(11)), "_i").limit(most)
        chosen = some if chosen is None else chosen.union(some)
    rows = docs.select(F.col(id_col).alias("_i"), text_or_empty(text_col).alias("_t")).join(F.broadcast(chosen), "_i")
    rows = rows.groupBy("_i", "_y").agg(F.min(F.struct(F.xxhash64("_t").alias("h"), F.col("_t").alias("t"))).alias("_m"))
    held = F.pmod(F.xxhash64("_i", F.lit(12)), F.lit(HOLD_BACK)) == 0
    return rows.select(F.xxhash64("_i", "_y", F.lit(13)).alias("_k"), "_i", "_y", held.alias("_held"), F.col("_m.t").alias("_t"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """The network for labels(doc_id, toxic); null labels and null ids don't count, extra columns are ignored.

    Windows are cut and scored where the sampled rows lie: the driver gets at most TOXIC_WINDOWS or CLEAN_WINDOWS windows of a row, never a text.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = stage_table(labelled_sample(docs, labels, id_col, text_col), "labelled")

    def mine(net: Network | None) -> list[Window]:
        shared = spark.sparkContext.broadcast(net)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                columns = [b.column(c).to_pylist() for c in ("_k", "_y", "_held")]
                for first, texts in text_slices(b.column("_t")):
                    found = mine_rows(shared.value, *(c[first : first + len(texts)] for c in columns), texts)
                    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names=["k", "y", "held", "w", "top"])
            give_back()

        out = [tuple(r) for r in rows.mapInArrow(run, "k long, y int, held boolean, w string, top double").collect()]
        shared.destroy()
        return out

    net = learn(mine)
    drop_table(rows)
    return net


def text_slices(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    texts = column.to_pylist()
    first, held = 0, 0
    for j, t in enumerate(texts):
        held += len(t or "")
        if held >= SLICE_BYTES or j == len(texts) - 1:
            yield first, [x or "" for x in texts[first : j + 1]]
            first, held = j + 1, 0


def score_documents(docs: DataFrame, net: Network, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row, where it lies. Null and empty texts have one window without words; extra columns are ignored."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in text_slices(b.column("_t")):
                s = shared.value.scores(texts)
                own = b.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
        give_back()

    held = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), text_or_empty(text_col).alias("_t"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, net: Network, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents that score below the threshold, with all their columns, unshuffled."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in text_slices(b.column(text_col)):
                yield b.slice(first, len(texts)).filter(pa.array(shared.value.scores(texts) < threshold))
        give_back()

    return docs.mapInArrow(run, docs.schema)
