"""Token-ID output: Parquet list columns with chosen encoding, row groups and page indexes.

One row per document: ``doc_id, part, local_start, n_tokens, ids``. Metadata columns can be read without the ids, and a
range of documents without the others' pages (row groups and column indexes follow the ascending doc_id order).
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, new_path, text_or_empty

#: Letters and signs for which the split below is the byte-level pre-tokenizer's; other texts go whole to the library.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
PLAIN = rf"^[\t\n\r\x20-\x7e{LETTERS}¡§«°·»¿–—‘’“”…€]*$"
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
#: Where a text has none of these (white-space characters in a row, a full stop or comma after anything but a letter or digit), cutting
#: before each space, full stop and comma and around each line end only cuts where the pre-tokenizer does.
UNEVEN = rf"\s\s|(?:^|[^{LETTERS}0-9])[.,]"
#: Pieces kept at once; beyond it the memo starts anew.
MEMO_PIECES = 500_000
SLICE_BYTES = 4_000_000
#: Characters that go to the library at once; its result holds about a hundred bytes for each id.
WHOLE_CHARS = 500_000


class Encoder:
    """A tokenizers file with a memo of pieces: equal pieces are encoded once by the library.

    Where the file is a byte-level BPE without normalizer, a text's ids are those of its pieces one after the other. Any
    other tokenizer, and any text with characters outside PLAIN or with an added token's string, is encoded whole.
    """

    def __init__(self, path: str):
        # tasks fill the cores already; threads of the library would only hold memory
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.by_piece = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and model["type"] == "BPE" and not model.get("dropout")
        )
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.led = np.zeros(self.tokenizer.get_vocab_size() + len(self.added) + 1, bool)
        if self.by_piece:
            self.led[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("Ġ")]] = True
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.starts, self.sizes, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0

    def learn(self, pieces: list[str]) -> None:
        """Encode new pieces; those that begin with their only space go to the library as running text, which is faster."""
        led = [p for p in pieces if p[:1] == " " and len(p.split()) == 1 and not p[1].isspace() and not p[-1].isspace()]
        texts = ["".join(led[k : k + 500]) for k in range(0, len(led), 500)]
        joined = [np.array(x.ids, np.int32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        joined = np.concatenate([*joined, np.zeros(0, np.int32)])
        at = np.flatnonzero(self.led[joined])
        if len(at) != len(led):
            raise ValueError("the tokenizer joined pieces over a space")
        seen = set(led)
        rest = [p for p in pieces if p not in seen]
        found = [np.array(x.ids, np.int32) for x in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        sizes = np.concatenate([np.diff(np.append(at, len(joined))), np.fromiter(map(len, found), np.int64, len(found))])
        flat = np.concatenate([joined, *found])
        n, more, total = len(self.index), len(sizes), len(flat)
        while n + more > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.sizes[n : n + more] = sizes
        self.starts[n : n + more] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + total] = flat
        self.used += total
        self.index.update(zip([*led, *rest], range(n, n + more), strict=True))

    def by_pieces(self, split: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        coded = split.flatten().dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        if len(self.index) > MEMO_PIECES:
            self.reset()
        get = self.index.get
        known = np.fromiter((get(p, -1) for p in pieces), np.int64, len(pieces))
        fresh = np.flatnonzero(known < 0)
        if len(fresh):
            self.learn([pieces[k] for k in fresh])
            known[fresh] = np.fromiter((self.index[pieces[k]] for k in fresh), np.int64, len(fresh))
        codes = coded.indices.to_numpy()
        sizes = self.sizes[known][codes]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.repeat(self.starts[known][codes] - ends + sizes, sizes) + np.arange(total)]
        per_text = np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return flat, np.diff(per_text)

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        block = np.cumsum([len(t) for t in texts]) // WHOLE_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)]
        found = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            found += [np.array(x.ids, np.int32) for x in self.tokenizer.encode_batch_fast(texts[a:b], add_special_tokens=False)]
        return np.concatenate([*found, np.zeros(0, np.int32)]), np.fromiter(map(len, found), np.int64, len(found))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one text after the other, and how many each text has."""
        plain = np.zeros(len(texts), bool)
        if self.by_piece and len(texts):
            plain = pc.match_substring_regex(texts, PLAIN).to_numpy(zero_copy_only=False)
            for a in self.added:
                plain &= ~pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        even = plain & ~pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False) if plain.any() else plain
        done = []
        if even.any():
            cut = texts.filter(pa.array(even))
            for old, new in ((" ", "\0 "), (".", "\0."), (",", "\0,"), ("\n", "\0\n\0")):
                cut = pc.replace_substring(cut, old, new)
            done.append((even, *self.by_pieces(pc.split_pattern(cut, "\0"))))
        if (odd := plain & ~even).any():
            done.append((odd, *self.by_pieces(pa.array([PIECE.findall(t) for t in texts.filter(pa.array(odd)).to_pylist()], pa.list_(pa.string())))))
        if not plain.all():
            done.append((~plain, *self.whole(texts.filter(pa.array(~plain)).to_pylist())))
        counts = np.zeros(len(texts), np.int64)
        if len(done) == 1:
            return done[0][1].astype(np.int32, copy=False), done[0][2]
        parts: dict[int, np.ndarray] = {}
        for mask, flat, sizes in done:
            at = np.flatnonzero(mask)
            counts[at] = sizes
            parts.update(zip(at.tolist(), np.split(flat, np.cumsum(sizes)[:-1]), strict=True))
        return np.concatenate([*(parts[k] for k in range(len(texts))), np.zeros(0, np.int32)]).astype(np.int32, copy=False), counts


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about size bytes of text; a text longer than that is a run of its own."""
    lengths = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    first = 0
    while first < len(ends):
        stop = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + size)))
        yield batch.slice(first, stop - first)
        first = stop


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 0,
    order: str = "id",
    encoding: str = "dictionary",
    row_group_bytes: int = 16 << 20,
    page_bytes: int = 64 << 10,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode whole texts, append end_id to each, and write them to path; returns the table as read back.

    order: "id" deals rows out by ascending id (ties by text, null ids first) so that files, row groups and pages follow it;
    "given" keeps the rows where they are, for input that was shuffled on purpose. encoding: "dictionary" or "delta".
    A null text counts as empty, rows with equal ids each get their own row, extra columns are ignored, an empty table gives an empty table.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    if order == "id":
        rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    elif order != "given":
        raise ValueError(f"order is 'id' or 'given', not {order!r}")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, at = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "text"):
                flat, counts = own.encode(batch.column("text"))
                ends = np.cumsum(counts)
                flat = np.insert(flat, ends, end_id).astype(np.int32, copy=False)
                counts = counts + 1
                offsets = np.concatenate([[0], np.cumsum(counts)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(at + offsets[:-1]), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))],
                    names=["doc_id", "part", "local_start", "n_tokens", "ids"],
                )
                at += int(offsets[-1])
        encoder(tokenizer_path).reset()
        give_back()

    out = rows.mapInArrow(encode, "doc_id long, part int, local_start long, n_tokens long, ids array<int>")
    writer = out.write.option("compression", "zstd").option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
    writer = writer.option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
    if encoding == "delta":
        writer = writer.option("parquet.writer.version", "PARQUET_2_0")
    writer.parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def with_starts(table: DataFrame) -> DataFrame:
    """Adds ``start``: ids of all documents before. Only a sum for each written part meets in one task and is broadcast: 12 bytes for each task that wrote."""
    sums = table.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    offsets = sums.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    return table.join(F.broadcast(offsets), "part").withColumn("start", F.col("_before") + F.col("local_start")).drop("_before")


def token_digests(table: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the stored ids."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            flat, offsets = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    found = with_starts(table).select("doc_id", "start", "n_tokens", "ids")
    return found.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, tokenizer_path: str, order: str = "id", **options: object) -> DataFrame:
    """Writes the token table into the shared folder and returns the digests read back from it."""
    return token_digests(write_tokens(docs, new_path(docs.sparkSession, "tokens"), tokenizer_path, order=order, **options))
