"""Plain versions of the operators to hold results against."""

from __future__ import annotations

import hashlib
from collections import Counter


def repeats(texts: dict[int, str | None], length: int) -> dict[int, tuple]:
    raw = {d: (t or "").encode() for d, t in texts.items()}
    seen = Counter(t[i : i + length] for t in raw.values() for i in range(len(t) - length + 1))
    out = {}
    for d, t in raw.items():
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out
