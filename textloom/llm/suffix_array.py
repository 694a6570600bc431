"""Suffix sorting of a shard by external induced sorting.

Suffixes are induced bucket by bucket from the sorted leftmost-S suffixes: L-types in ascending, S-types in descending order. The queue of suffixes waiting for
their bucket is disk-backed: what is beyond its memory goes to a file of the folder given. A whole wave of a bucket is handled by one numpy step.
Sorting stops at a depth: suffixes that agree on so many bytes stay in any order beside each other, with a common prefix value of that depth.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Bytes of waiting suffixes that a queue keeps in memory.
QUEUE_BYTES = 256 << 20


class BucketQueue:
    """Runs of suffixes by bucket, in the order they came; the priority is the bucket."""

    def __init__(self, buckets: int, folder: str | None = None, memory: int = QUEUE_BYTES):
        self.runs: list[list] = [[] for _ in range(buckets)]
        self.folder, self.memory, self.held, self.file = folder, memory, 0, None

    def push(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for a, b in zip(np.concatenate([[0], cuts]).tolist(), np.concatenate([cuts, [len(keys)]]).tolist(), strict=True):
            self.runs[int(keys[a])].append(values[a:b])
        self.held += values.nbytes
        if self.folder and self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(dir=self.folder)
        self.file.seek(0, os.SEEK_END)
        for runs in self.runs:
            if any(isinstance(r, np.ndarray) for r in runs):
                for k, r in enumerate(runs):
                    if isinstance(r, np.ndarray):
                        runs[k] = (self.file.tell(), len(r))
                        self.file.write(np.ascontiguousarray(r, np.int64).tobytes())
        self.held = 0

    def pop(self, bucket: int) -> np.ndarray:
        runs, self.runs[bucket] = self.runs[bucket], []
        out = []
        for r in runs:
            if isinstance(r, tuple):
                self.file.seek(r[0])
                r = np.frombuffer(self.file.read(8 * r[1]), np.int64)
            else:
                self.held -= r.nbytes
            out.append(r)
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def smaller_types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; t ends with its only smallest symbol."""
    step = np.sign(np.diff(t.astype(np.int16)))
    at = np.where(step != 0, np.arange(len(step)), len(step))
    at = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(len(t), bool)
    out[:-1] = step[np.minimum(at, len(step) - 1)] > 0
    return out


def induce(t: np.ndarray, small: np.ndarray, seeds: np.ndarray, folder: str | None, memory: int) -> np.ndarray:
    """The suffix array of t from its leftmost-S suffixes in order."""
    buckets = 257
    starts = BucketQueue(buckets, folder, memory)
    starts.push(t[seeds], seeds)
    queue, larger, firsts = BucketQueue(buckets, folder, memory), [], []
    try:
        for c in range(buckets):
            waves, now = [], queue.pop(c)
            while len(now):
                waves.append(now)
                before = now[now > 0] - 1
                before = before[~small[before]]
                symbols = t[before]
                far = symbols != c
                if far.any():
                    queue.push(symbols[far], before[far])
                now = before[~far]
            own = starts.pop(c)
            if len(own):
                before = own[own > 0] - 1
                before = before[~small[before]]
                if len(before):
                    queue.push(t[before], before)
            larger.append(np.concatenate(waves) if waves else np.zeros(0, np.int64))
        for c in range(buckets - 1, -1, -1):
            waves, now = [], queue.pop(c)
            if c == 0:
                now = np.array([len(t) - 1])
            while len(now):
                waves.append(now)
                before = now[now > 0] - 1
                before = before[small[before]]
                symbols = t[before]
                far = symbols != c
                if far.any():
                    queue.push(symbols[far], before[far])
                now = before[~far]
            back = larger[c][::-1]
            before = back[back > 0] - 1
            before = before[small[before]]
            if len(before):
                queue.push(t[before], before)
            firsts.append(np.concatenate([larger[c], (np.concatenate(waves) if waves else np.zeros(0, np.int64))[::-1]]))
    finally:
        queue.close()
        starts.close()
    return np.concatenate(firsts[::-1])


def named(t: np.ndarray, small: np.ndarray, order: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of the leftmost-S substrings in their sorted order, equal ones with equal numbers; ends: the position that ends each."""
    a, b = order[:-1], order[1:]
    la, lb = ends[:-1] - a, ends[1:] - b
    same = (la == lb) & (t[a] == t[b])
    live = np.flatnonzero(same)
    j = 0
    while len(live):
        x, y = a[live] + j, b[live] + j
        ok = (t[x] == t[y]) & (small[x] == small[y])
        same[live[~ok]] = False
        live = live[ok & (la[live] > j)]
        j += 1
    return np.concatenate([[0], np.cumsum(~same)])


def doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes of names by their first depth symbols, by prefix doubling; after the first round only groups of equal rank are sorted again."""
    n = len(names)
    order = np.argsort(names)
    sorted_names = names[order]
    first = np.concatenate([[True], sorted_names[1:] != sorted_names[:-1]])
    rank, span = np.empty(n, np.int64), 1
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    while span < depth:
        # places in order whose group has several members
        alone = first & np.concatenate([first[1:], [True]])
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        own = order[at]
        later = own + span
        key = rank[own] * (n + 1) + np.where(later < n, rank[np.minimum(later, n - 1)] + 1, 0)
        turn = np.argsort(key)
        own, key = own[turn], key[turn]
        order[at] = own
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        first[at] = fresh
        rank[own] = np.maximum.accumulate(np.where(fresh, at, 0))
        span *= 2
    return order


def suffix_array(text: np.ndarray, depth: int, folder: str | None = None, memory: int = QUEUE_BYTES) -> np.ndarray:
    """Starts of the suffixes of a byte array, sorted by their first depth bytes at least."""
    if not len(text):
        return np.zeros(0, np.int64)
    t = np.concatenate([text.astype(np.uint16) + 1, np.zeros(1, np.uint16)])
    small = smaller_types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    rough = induce(t, small, lms, folder, memory)
    place = np.full(len(t), -1, np.int64)
    place[lms] = np.arange(len(lms))
    order = rough[place[rough] >= 0]
    ends = np.append(lms[1:], lms[-1])
    names = np.empty(len(lms), np.int64)
    numbers = named(t, small, order, ends[place[order]])
    names[place[order]] = numbers
    if numbers[-1] + 1 < len(lms):
        order = lms[doubled(names, depth // 2 + 2)]
    return induce(t, small, order, folder, memory)[1:]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each suffix in order shares with the one before, depth at most; 0 for the first."""
    data = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    words = np.ndarray(len(data) - 7, "<u8", data.data, 0, (1,))  # the eight bytes from each position on
    out = np.zeros(len(order), np.int64)
    a, b = order[:-1], order[1:]
    room = np.minimum(len(text) - np.maximum(a, b), depth)
    live, done = np.arange(len(a)), room.copy()
    x, y, j = a, b, 0
    while len(live):
        differ = words[x + j] ^ words[y + j]
        same = differ == 0
        if not same.all():
            d = differ[~same]
            shared = (np.frexp((d & (~d + np.uint64(1))).astype(np.float64))[1] - 1) // 8
            gone = live[~same]
            done[gone] = np.minimum(j + shared, room[gone])
        j += 8
        live = live[same]
        live = live[room[live] > j]
        x, y = a[live], b[live]
    out[1:] = done
    return out
