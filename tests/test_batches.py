"""Pages and bodies go to Python in small batches, whatever a task holds."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

from lanternfish.plans.tables import BATCH_BYTES, BATCH_ROWS
from lanternfish.sources import bodies, html


def _largest(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"id": [b.num_rows]})

    return spark.range(4000).coalesce(1).mapInArrow(sizes, "id bigint").agg(F.max("id")).first()[0]


def _unbounded(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert _largest(spark) == 4000


def test_batches_of_pages(spark):
    _unbounded(spark)
    html.parsed(spark.createDataFrame([(1, "https://a.b/", "<p>x")], "page_id bigint, url string, html string"))
    assert _largest(spark) <= BATCH_ROWS


def test_batches_of_bodies(spark):
    _unbounded(spark)
    bodies.decoded(F.col("body"), F.col("kind"))
    assert _largest(spark) <= BATCH_ROWS


@pytest.mark.parametrize("name", ["rich_records", "prices_not_shown", "orphans"])
def test_batches_of_queries(spark, name):
    """Bounds hold for the query as registered, in rows and, for large pages, in bytes."""
    _unbounded(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "100000000")
    assert entry.queries()[name](spark, entry.SMOKE_DIR).count()
    assert _largest(spark) <= BATCH_ROWS

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    large = spark.range(40).coalesce(1).select(F.repeat(F.lit("x"), 500_000).alias("html")).mapInArrow(sizes, "n bigint")
    assert large.agg(F.max("n")).first()[0] <= BATCH_BYTES + 600_000
