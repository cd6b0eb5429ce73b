"""Tables that a plan of several jobs hands on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of a batch of pages or bodies that goes to Python. Without bounds a batch is as large as its task, up to 10,000 pages,
#: and each worker keeps the memory of the largest one.
BATCH_ROWS, BATCH_BYTES = 256, 2_000_000


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches of the session's Python steps by rows and bytes. Spark reads the bounds when a plan runs, so they are lowered
    in the session (never raised) and stay lowered."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}").lower().removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written once as Parquet below spark.checkpoint.dir, and read again. Where that is unset, a temporary folder serves in local
    mode, and it is an error elsewhere."""
    spark = df.sparkSession
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="lanternfish-")
        spark.conf.set("spark.checkpoint.dir", place)
    path = f"{place.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
