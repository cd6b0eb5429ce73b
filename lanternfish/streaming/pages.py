"""Page rules over a stream of crawled pages. The rules are page by page, so the stream needs no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lanternfish.operators import issues
from lanternfish.sources import html
from lanternfish.sources import pages as source

PAGE = "page_id bigint, url string, html string"


def violations(stream: DataFrame) -> DataFrame:
    """Violations of page-local rules for a streaming or static table of pages."""
    return issues.violations(source.completed(html.page_records(html.parsed(stream))))


def start(spark: SparkSession, folder: str, target: str, checkpoint: str, files_per_batch: int = 64) -> StreamingQuery:
    """Reads Parquet files as they arrive below `folder` and appends their violations to `target`; exactly once over restarts."""
    stream = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return violations(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start()
