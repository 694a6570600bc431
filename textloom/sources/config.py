"""Crawl configuration: defaults, and a reader for the small YAML subset of mappings, lists and scalars."""

from __future__ import annotations

import ast
from dataclasses import dataclass, field, fields


@dataclass
class CrawlConfig:
    database: str = "corpus"
    documents: str = "documents"
    delay_ms: int = 500
    timeout_sec: int = 30
    max_retries: int = 3
    max_depth: int = 1000
    recrawl_threshold_hours: int = 24
    max_concurrent_workers: int = 8
    stale_batch: int = 200
    least_text_bytes: int = 200
    sources: dict = field(default_factory=dict)


def parse_yaml(text: str) -> dict:
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]

    def scalar(x: str) -> object:
        try:
            return {"true": True, "false": False, "null": None}[x] if x in ("true", "false", "null") else ast.literal_eval(x)
        except (ValueError, SyntaxError):
            return x

    def block(k: int, indent: int) -> tuple[object, int]:
        if lines[k][1].startswith("- "):
            items = []
            while k < len(lines) and lines[k][0] == indent and lines[k][1].startswith("- "):
                items.append(scalar(lines[k][1][2:].strip()))
                k += 1
            return items, k
        out: dict = {}
        while k < len(lines) and lines[k][0] == indent:
            key, _, value = lines[k][1].partition(":")
            k += 1
            if value.strip():
                out[key] = scalar(value.strip())
            elif k < len(lines) and (lines[k][0] > indent or lines[k][1].startswith("- ")):
                out[key], k = block(k, lines[k][0])
            else:
                out[key] = None
        return out, k

    return block(0, lines[0][0])[0] if lines else {}  # type: ignore[return-value]


def load_config(path: str) -> CrawlConfig:
    with open(path, encoding="utf-8") as f:
        spec = parse_yaml(f.read())
    flat = {**(spec.get("db") or {}), **(spec.get("logic") or {}), **{k: v for k, v in spec.items() if k not in ("db", "logic")}}
    flat["documents"] = (flat.pop("collections", None) or {}).get("documents", "documents")
    names = {f.name for f in fields(CrawlConfig)}
    return CrawlConfig(**{k: v for k, v in flat.items() if k in names and v is not None})
