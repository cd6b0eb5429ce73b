"""Bodies of answers as text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lanternfish.plans.tables import small_batches


@F.pandas_udf(StringType())
def _decoded(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    import codecs

    def one(body, charset):
        if body is None:
            return None
        try:
            codecs.lookup(charset)
            return bytes(body).decode(charset, errors="replace")
        except (LookupError, ValueError):
            return bytes(body).decode("utf-8", errors="replace")

    for bodies, charsets in parts:
        yield pd.Series([one(b, c) for b, c in zip(bodies, charsets)])


def decoded(body: Column, content_type: Column) -> Column:
    """Text of a body by the charset of its content type; UTF-8 without one or with an unknown one. What cannot be decoded becomes
    U+FFFD. UTF-8 stays in the JVM; only other charsets, of which Spark knows few, go to Python. Null stays null."""
    small_batches(SparkSession.active())
    charset = F.lower(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset=([\w-]+)", 1))
    plain = charset.isin("", "utf-8", "utf8")
    return F.when(plain, F.make_valid_utf8(body.cast("string"))).otherwise(_decoded(F.when(~plain, body), charset))
