"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: a batch is closed at whichever it reaches first, so very long texts stand in batches of few rows.
BATCH_ROWS, BATCH_BYTES = 512, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode, else an error."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="lanternfish-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and returns a reader of it: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches bounded by rows and bytes. Spark reads these bounds from the session when the plan runs, so they
    are lowered there (never raised) and stay lowered."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(f"spark.sql.execution.arrow.{name}").lower().removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return df.mapInArrow(work, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that no column of df has (names differ in more than case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def fold_of(doc_id: str, folds: int):
    """crc32 of the id written as text, modulo folds (null id: fold of the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds
