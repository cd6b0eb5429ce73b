"""Tables of the summary, the report and the history page. Every list that a report cuts keeps its first rows in each task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.functions import text


def status_histogram(pages: DataFrame) -> DataFrame:
    """site, status, pages: pages by their final status, redirected ones by their first. pages: site, status, final_status, redirect_hops."""
    shown = F.when(F.col("redirect_hops") == 0, F.col("final_status")).otherwise(F.col("status"))
    return pages.groupBy("site", shown.alias("status")).agg(F.count("*").alias("pages"))


def linked_extremes(pages: DataFrame, shown: int = 10) -> DataFrame:
    """site, kind (most, least), place, url, inlinks: the most and the least linked of the indexable pages, in the order of the crawl
    where they are even. pages: site, url, seq, indexable, inlinks."""
    rows = pages.filter("indexable").select("site", "url", "seq", F.coalesce("inlinks", F.lit(0)).alias("inlinks"))

    def first(kind: str, *order) -> DataFrame:
        return rows.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy(*order))).filter(F.col("place") <= shown).select("site", F.lit(kind).alias("kind"), "place", "url", "inlinks")

    return first("most", F.desc("inlinks"), "seq").unionByName(first("least", "inlinks", F.desc("seq")))


def report_head(signals: DataFrame, shown: int = 15) -> DataFrame:
    """The first signals of each site, in the order of the report."""
    from lanternfish.operators.findings import ranked

    return ranked(signals).filter(F.col("place") <= shown)


def ranked_code(found: DataFrame) -> DataFrame:
    """Code findings with `place`: the gravest first within a site."""
    return found.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy(text.rank(F.col("severity")), "category", "key")))


def history_index(audits: DataFrame) -> DataFrame:
    """site, first_day, last_day, n_audits, n_scored, score, grade, delta: one line of the history page for each site. delta compares
    the last audit with the last scored one before it, and is null if either has no score. audits: site, day, score (null allowed)."""
    scored = F.when(F.col("score").isNotNull(), F.struct("day", "score"))
    last = audits.groupBy("site").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n_audits"), F.count("score").alias("n_scored"), F.max_by("score", "day").alias("score"))
    days = audits.join(last.select("site", "last_day"), "site")
    before = days.filter("day < last_day").groupBy("site").agg(F.max(scored).alias("b"))
    out = last.join(before, "site", "left")
    return out.select("site", "first_day", "last_day", "n_audits", "n_scored", "score", text.grade(F.col("score")).alias("grade"), (F.col("score") - F.col("b.score")).alias("delta"))
