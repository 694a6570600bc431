"""python -m textloom.cli index|search|stats: build an index, ask it, or describe a corpus."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import functions as F

from .functions.text import html_to_text
from .operators import index, search, stats
from .session import session
from .sources import store


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="textloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("index")
    build.add_argument("pages")
    build.add_argument("dump")
    build.add_argument("-z", "--packed", action="store_true")
    build.add_argument("--limit", type=int, default=0, help="documents to index; all of them if 0")
    ask = commands.add_parser("search")
    ask.add_argument("dump")
    ask.add_argument("query", nargs="*", help="read from stdin if there is none")
    ask.add_argument("-k", type=int, default=10)
    tell = commands.add_parser("stats")
    tell.add_argument("pages")
    tell.add_argument("csv")
    args = parser.parse_args(argv)
    spark = session()
    if args.command == "search":
        loaded = store.load_index(spark, args.dump)
        for query in args.query or (line.rstrip("\n") for line in sys.stdin):
            began = time.time()
            found = search.tfidf_search(loaded, query).persist()
            rows = search.top(found, args.k).collect()
            print(f"{found.count()} documents in {time.time() - began:.3f} s")
            for r in rows:
                print(f"{r['rank']}. {r['url']} ({r['score']})")
            found.unpersist()
        return 0
    limit = args.limit if args.command == "index" else 0
    pages = store.read_corpus(spark, args.pages, ("page_id", "url", "html"), limit)
    docs = pages.select(F.col("page_id").alias("doc_id"), "url", html_to_text(F.col("html")).alias("text"))
    began = time.time()
    if args.command == "index":
        store.save_index(index.build_index(docs, "porter"), args.dump, args.packed)
        print(stats.corpus_report(pages).first().asDict() | {"seconds": round(time.time() - began, 3)})
    else:
        store.write_frequency_csv(stats.token_frequency(docs), args.csv)
        print(stats.vocabulary_stats(docs).first().asDict() | {"seconds": round(time.time() - began, 3)})
    return 0


if __name__ == "__main__":
    sys.exit(main())
