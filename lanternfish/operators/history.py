"""Audits over time, field trends, headings and representatives: window operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Least rise that counts as a degradation.
FLOORS = {"lcp": 200.0, "inp": 30.0, "cls": 0.02, "fcp": 150.0, "ttfb": 100.0}


def audit_deltas(audits: DataFrame) -> DataFrame:
    """site, day, score, delta to the previous scored audit, first (the first scored one)."""
    before = Window.partitionBy("site").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    previous = F.last("score", ignorenulls=True).over(before)
    return audits.select("site", "day", "score", (F.col("score") - previous).alias("delta"), (F.col("score").isNotNull() & (F.count("score").over(before) == 0)).alias("first"))


def trends(series: DataFrame, least: dict[str, float] = FLOORS) -> DataFrame:
    """site, metric, age (trailing periods without value), k, before, now, degraded.

    series: site, metric, period, value (null allowed). The mean of the last k values against the k before them, with k of at
    most 4 and half of the values; degraded if the verdict of now is not good and the rise reaches the metric's floor.
    """
    from lanternfish.functions.text import vitals_verdict

    back = Window.partitionBy("site", "metric").orderBy(F.desc("period"))
    known = F.col("value").isNotNull()
    s = series.withColumn("seen", F.count("value").over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    s = s.withColumn("n", F.count("value").over(Window.partitionBy("site", "metric"))).withColumn("k", F.least(F.lit(4), F.floor(F.col("n") / 2)).cast("int"))
    out = s.groupBy("site", "metric").agg(
        F.count_if(F.col("seen") == 0).alias("age"), F.max("k").alias("k"),
        F.avg(F.when(known & (F.col("seen") > F.col("k")) & (F.col("seen") <= 2 * F.col("k")), F.col("value"))).alias("before"),
        F.avg(F.when(known & (F.col("seen") <= F.col("k")), F.col("value"))).alias("now"),
    )
    floor = F.element_at(F.create_map(*[F.lit(x) for p in least.items() for x in p]), F.col("metric"))
    worse = (vitals_verdict(F.col("metric"), F.col("now")) != "bon") & (F.col("now") - F.col("before") >= floor)
    return out.withColumn("degraded", F.coalesce(worse, F.lit(False)))


def field_findings(values: DataFrame, trend: DataFrame | None = None, periods_fresh: int = 8) -> DataFrame:
    """site, key, severity: one finding for each metric that is not good, the gravest over devices; and degradations.

    values: site, device, metric, value.
    """
    from lanternfish.functions import text

    verdict = text.vitals_verdict(F.col("metric"), F.col("value"))
    grave = F.when((verdict == "mauvais") & ~F.col("metric").isin("fcp", "ttfb"), 1).when(verdict.isin("mauvais", "moyen"), 2)
    rows = values.select("site", F.concat(F.lit("terrain_"), "metric").alias("key"), grave.alias("r")).filter("r IS NOT NULL")
    out = rows.groupBy("site", "key").agg(text.severity_of(F.min("r")).alias("severity"))
    if trend is not None:
        old = trend.filter("degraded").groupBy("site").agg(F.min("age").alias("age"))
        out = out.unionByName(old.select("site", F.lit("terrain_degradation").alias("key"), F.when(F.col("age") > periods_fresh, "info").otherwise("moyenne").alias("severity")))
    return out


def skipped_headings(headings: DataFrame) -> DataFrame:
    """Headings more than one level under the one before in the same landmark. headings: url, landmark, pos, level, text, and seq where a
    url may have several records."""
    w = Window.partitionBy("url", *[c for c in ("seq",) if c in headings.columns], "landmark").orderBy("pos")
    return headings.withColumn("previous", F.lag("level").over(w)).filter("level > previous + 1")


def representatives(pages: DataFrame, per_segment: int = 1, most: int = 12) -> DataFrame:
    """site, segment, url, place: the most linked pages of each first path segment; segments by number of pages, home first."""
    # Counts are summed up before the exchange, and a ranking that is cut keeps only its first rows in each task.
    sizes = pages.groupBy("site", "segment").agg(F.count("*").alias("pages"))
    rank = F.row_number().over(Window.partitionBy("site", "segment").orderBy(F.desc("inlinks"), "seq"))
    rows = pages.withColumn("in_segment", rank).filter(F.col("in_segment") <= per_segment).join(sizes, ["site", "segment"])
    order = Window.partitionBy("site").orderBy(F.col("segment") != "", F.desc("pages"), "segment", "in_segment")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("site", "segment", "url", "place")


def child_segments(pages: DataFrame, least: int = 2, most: int = 6) -> DataFrame:
    """site, segment, children: first segments with several pages below them, at most `most` for a site."""
    from lanternfish.functions import urls

    child = F.regexp_extract(urls.path(F.col("url")), r"^/[^/]+/(.+)$", 1)
    n = pages.select("site", urls.segment(F.col("url")).alias("segment"), child.alias("child")).filter("segment <> '' AND child <> ''").groupBy("site", "segment").agg(F.countDistinct("child").alias("children"))
    w = Window.partitionBy("site").orderBy(F.desc("children"), "segment")
    return n.filter(F.col("children") >= least).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).drop("place")


def capped(df: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """The first rows of each group, and how many of the group are left out."""
    w = Window.partitionBy(*keys)
    return df.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("left_out", F.greatest(F.count("*").over(w) - most, F.lit(0))).filter(F.col("place") <= most)


def probe_urls(urls_of: DataFrame, per_host: int = 2, most: int = 5, examined: int = 200) -> DataFrame:
    """site, url: sitemap urls to probe, a few for each scheme and host among the first `examined`. urls_of: site, seq, url."""
    from lanternfish.functions import urls

    first = urls_of.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy("seq"))).filter(F.col("place") <= examined)
    key = [F.col("site"), urls.scheme(F.col("url")), urls.authority(F.col("url"))]
    few = first.withColumn("in_host", F.row_number().over(Window.partitionBy(*key).orderBy("place"))).filter(F.col("in_host") <= per_host)
    return few.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("place"))).filter(F.col("n") <= most).select("site", "url")
