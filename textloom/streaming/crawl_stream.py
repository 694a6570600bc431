"""The crawl writer as a stream: pages arrive, articles are upserted into versioned state folders batch by batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import urls
from ..operators.crawl import STATE, extract_articles, fold_scrapes, merge_state


def read_pages(spark: SparkSession, path: str, schema: str = "url string, html string, ts long", files_per_batch: int = 100) -> DataFrame:
    """A bounded intake: at most files_per_batch files wait in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


class StateTable:
    """State in folders by batch; the latest complete one counts, so a batch that runs again writes the same folder again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath() for s in fs.listStatus(root)]
        return sorted(int(p.getName()[1:]) for p in names if p.getName()[:1] == "v" and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self, before: int | None = None) -> DataFrame:
        known = [v for v in self.versions() if before is None or v < before]
        if not known:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.parquet(f"{self.path}/v{known[-1]}")

    def upsert(self, scrapes: DataFrame, batch: int) -> None:
        state = self.read(before=batch)
        merged = fold_scrapes(scrapes) if not state.take(1) else merge_state(state, scrapes)
        merged.write.mode("overwrite").parquet(f"{self.path}/v{batch}")


def upsert_stream(scrapes: DataFrame, table: StateTable, checkpoint: str) -> StreamingQuery:
    """Takes all that is there and stops; start it again to go on from the checkpoint."""
    return scrapes.writeStream.foreachBatch(lambda batch, n: table.upsert(batch, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def crawl_stream(pages: DataFrame, table: StateTable, checkpoint: str, sites: Sequence[urls.Site] = urls.SITES, least_bytes: int = 200) -> StreamingQuery:
    """Classify, extract, gate and upsert pages(url, html, ts)."""

    def write(batch: DataFrame, n: int) -> None:
        rows = extract_articles(batch.where(F.col("ts").isNotNull()), sites, least_bytes)
        table.upsert(rows.select("normalized_url", "ts", "title", "html_content"), n)

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def report(query: StreamingQuery) -> list[tuple[int, int]]:
    """(batch, rows) of the batches that a query has finished: what was taken in before it drained or was stopped. A stopped one goes on from its checkpoint."""
    return [(p["batchId"], p["numInputRows"]) for p in query.recentProgress]
