"""Benchmark decontamination by Wu-Manber multi-pattern search.

Test items give windows of words. Patterns of similar length share a block shift table: the block that ends the search window
says how far it may move, a block that can end a pattern's first m bytes leads to a bucket of patterns, and direct comparison confirms.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, text_or_empty

#: Bytes that are part of a word stay (A-Z in lower case), all others become a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Shortest patterns, in bytes, of the classes with a table of their own: a few short patterns don't slow the rest.
CLASSES = (48, 32, 16, 8, 0)
#: Bytes of item text in one block of the query set; a larger benchmark is taken in several blocks. A worker's tables take about 230 bytes for each.
BLOCK_BYTES = 256 << 10
#: Bytes of documents for which the tables of a block are built, if there are several blocks.
CHUNK_BYTES = 16 << 20


def fold(text: str) -> bytes:
    """' word word ... ' in UTF-8; b' ' if there is no word."""
    words = text.encode("utf-8", "surrogatepass").translate(FOLD).split()
    return b" " + b" ".join(words) + b" " if words else b" "


class WuManber:
    def __init__(self, patterns: Iterable[bytes]):
        self.tables = []
        left = set(patterns)
        for least in CLASSES:
            own = sorted(p for p in left if len(p) >= least)
            left.difference_update(own)
            if own:
                self.tables.append(self.table(own))

    @staticmethod
    def table(patterns: list[bytes]) -> tuple:
        m = min(map(len, patterns))
        block = max(1, min(16, m // 3))
        shift: dict[bytes, int] = {}
        buckets: dict[bytes, dict[bytes, list[bytes]]] = {}
        for p in patterns:
            for end in range(block, m + 1):
                key = p[end - block : end]
                if shift.get(key, m) > m - end:
                    shift[key] = m - end
            buckets.setdefault(p[m - block : m], {}).setdefault(p[:m], []).append(p)
        return m, block, shift, buckets

    def search(self, text: bytes) -> list[tuple[int, bytes]]:
        """Every (offset, pattern) that occurs, overlaps included."""
        found = []
        for m, block, shift, buckets in self.tables:
            end, n, far, step = m, len(text), m - block + 1, shift.get
            while end <= n:
                key = text[end - block : end]
                move = step(key, far)
                if move:
                    end += move
                    continue
                for p in buckets[key].get(text[end - m : end], ()):
                    if text.startswith(p, end - m):
                        found.append((end - m, p))
                end += 1
        return found


class ItemSet:
    """The windows of a block of test items: (item, its words or a part of them)."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int):
        self.owners: dict[bytes, set[str | None]] = {}
        for item, words in items:
            for k in range(max(1, len(words) - window + 1)):
                self.owners.setdefault(b" " + b" ".join(words[k : k + window]) + b" ", set()).add(item)
        self.matcher = WuManber(self.owners)
        self.sizes = {p: p.count(b" ") - 1 for p in self.owners}

    def hits(self, folded: bytes) -> tuple[list[tuple[int, int]], set[str]]:
        """Ranges of words that lie in an occurrence, and the items with one."""
        found = self.matcher.search(folded)
        if not found:
            return [], set()
        spaces = np.flatnonzero(np.frombuffer(folded, np.uint8) == 32)
        first = np.searchsorted(spaces, [at for at, _ in found])
        return [(int(k), int(k) + self.sizes[p]) for k, (_, p) in zip(first, found, strict=True)], set().union(*(self.owners[p] for _, p in found))


def covered(ranges: list[tuple[int, int]]) -> int:
    total, end = 0, 0
    for a, b in sorted(ranges):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def item_blocks(items: DataFrame, window: int, id_col: str, text_col: str) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The query set, streamed through the driver in blocks of about BLOCK_BYTES; an item longer than that is cut into parts that share window - 1 words."""
    held, size = [], 0
    for item, text in items.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        words = fold(text or "").split()
        each = max(1, BLOCK_BYTES // (2 + max(map(len, words), default=0)))
        for k in range(0, max(1, len(words) - window + 1) if words else 0, each):
            held.append((item, words[k : k + each + window - 1]))
            size += sum(map(len, held[-1][1])) + len(held[-1][1])
            if size >= BLOCK_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def load_items(items: DataFrame, window: int = 13, id_col: str = "item_id", text_col: str = "text") -> list:
    """Broadcasts, each of a block of at most about 2 * BLOCK_BYTES of item text."""
    sc = items.sparkSession.sparkContext
    return [sc.broadcast((block, window)) for block in item_blocks(items, window, id_col, text_col)]


Found = tuple[int, int, list]


def scan_texts(texts: list[str | None], sets: Iterable[ItemSet]) -> list[Found]:
    """(n_words, n_hit, items) of each text."""
    folded = [fold(t or "") for t in texts]
    ranges: list[list] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    for own in sets:
        for k, f in enumerate(folded):
            more, which = own.hits(f)
            ranges[k] += more
            items[k] |= which
    return [(f.count(b" ") - 1, covered(r), sorted(i, key=lambda x: (x is None, x or ""))) for f, r, i in zip(folded, ranges, items, strict=True)]


def scan(batches: Iterator[pa.RecordBatch], column: str, blocks: list) -> Iterator[tuple[pa.RecordBatch, list[Found]]]:
    """Each batch with what was found in its texts. The tables of one block are in memory at a time: for all of a task if there is no other, else for CHUNK_BYTES of documents."""
    if len(blocks) < 2:
        own = [ItemSet(*shared.value) for shared in blocks]
        for b in batches:
            yield b, scan_texts(b.column(column).to_pylist(), own)
        return

    def flush(held: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[Found]]]:
        found = scan_texts([t for b in held for t in b.column(column).to_pylist()], (ItemSet(*shared.value) for shared in blocks))
        for b in held:
            yield b, found[: b.num_rows]
            found = found[b.num_rows :]

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.column(column).nbytes for x in held) >= CHUNK_BYTES:
            yield from flush(held)
            held = []
    if held:
        yield from flush(held)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, items, contaminated`` (n_hit > 0 and share * n_hit >= n_words).

    Documents are scanned where they lie, without a shuffle. Null and empty texts have no words and are clean; null item texts have no
    windows; repeated item ids share their windows, null item ids are one item, a null in items; repeated documents each get a row; extra columns are ignored;
    an empty table of documents gives an empty table, an empty one of items no hit.
    """
    bounded_batches(docs.sparkSession)
    blocks = load_items(items, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in scan(batches, "text", blocks):
            words, hit = [x[0] for x in found], [x[1] for x in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(words, pa.int64()), pa.array(hit, pa.int64()), pa.array([x[2] for x in found], pa.list_(pa.string())), pa.array([h > 0 and share * h >= w for w, h in zip(words, hit, strict=True)], pa.bool_())],
                names=["doc_id", "n_words", "n_hit", "items", "contaminated"],
            )
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_hit long, items array<string>, contaminated boolean")


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20, text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns, unshuffled. Nulls, empty texts and tables and repeated rows as in decontaminate()."""
    bounded_batches(docs.sparkSession)
    blocks = load_items(items, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in scan(batches, text_col, blocks):
            yield b.filter(pa.array([not (h > 0 and share * h >= w) for w, h, _ in found], pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def contamination_digests(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``n_items`` counts a null item id as one, ``items_sha256`` leaves it out; nulls, empty texts and tables as in decontaminate()."""
    found = decontaminate(docs, items)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")
