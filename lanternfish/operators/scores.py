"""Domain scores, global score, grades, recall: arithmetic over counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.functions import text

# Weight of each domain in the global score, and domains that count with another.
WEIGHTS = {"SEO technique": 25, "Contenu": 15, "GEO": 15, "Performance": 20, "Sécurité": 15, "Accessibilité": 10}
COUNTS_WITH = {"Indexation": "SEO technique", "Maillage": "SEO technique", "Code": "Performance", "Terrain": "Performance", "Données structurées": "GEO", "Domaine": "Sécurité"}
CAPPING = ("Sécurité", "SEO technique")
CAP = 49


def domain_scores(signals: DataFrame, audited: DataFrame | None = None) -> DataFrame:
    """site, domain, one count for each severity, score. signals: site, domain, severity; audited: site, domain that count even without findings."""
    domain = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in COUNTS_WITH.items() for x in p]), F.col("domain")), F.col("domain"))
    rows = signals.select("site", domain.alias("domain"), "severity")
    if audited is not None:
        rows = rows.unionByName(audited.select("site", domain.alias("domain"), F.lit(None).cast("string").alias("severity")))
    counts = rows.groupBy("site", "domain").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in text.SEVERITIES])
    lost = sum((F.col(s) * p for s, p in text.POINTS.items()), F.lit(0))
    return counts.withColumn("score", F.greatest(F.lit(0), F.lit(100) - lost).cast("bigint"))


def global_scores(scores: DataFrame) -> DataFrame:
    """site, score (weighted mean over the domains present, half to even), capped (a critical finding in a capping domain), grade."""
    weight = F.element_at(F.create_map(*[F.lit(x) for p in WEIGHTS.items() for x in p]), F.col("domain"))
    rows = scores.withColumn("w", weight).filter("w IS NOT NULL")
    mean = F.bround(F.sum(F.col("w") * F.col("score")) / F.sum("w"), 0).cast("bigint")
    grave = F.bool_or(F.col("domain").isin(*CAPPING) & (F.col("critique") > 0))
    out = rows.groupBy("site").agg(mean.alias("raw"), grave.alias("capped"))
    score = F.when(F.col("capped"), F.least("raw", F.lit(CAP))).otherwise(F.col("raw"))
    return out.select("site", score.alias("score"), (F.col("capped") & (F.col("raw") > CAP)).alias("capped"), text.grade(score).alias("grade"))


def order_statistics(df: DataFrame, keys: list[str], value: str, places: dict[str, str]) -> DataFrame:
    """keys, n, largest, and for each name of places the element at that place (an expression of n, from 0) of the group's sorted
    values; exact.

    Approximate percentiles (partial aggregates) bracket the middle; what lies below the bracket is counted, and within it equal
    values are counted before they are put in order. So neither a group of any size nor a value that most rows share meets in one
    task. Places must lie in the middle of a group.
    """
    from pyspark.sql import Window

    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"))
    ends = F.percentile_approx("v", [0.498, 0.502], F.lit(10_000))
    brackets = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max("v").alias("largest"), ends.alias("e"))
    # Small groups are taken whole, as an element more or less is more than a thousandth of them.
    brackets = brackets.withColumn("lo", F.when(F.col("n") > 5000, F.get("e", F.lit(0)))).withColumn("hi", F.when(F.col("n") > 5000, F.get("e", F.lit(1)))).drop("e")
    counts = rows.groupBy(*keys, "v").agg(F.count("*").alias("c")).join(brackets, keys)
    below = counts.filter("v < lo").groupBy(*keys).agg(F.sum("c").alias("below"))
    inside = counts.filter("lo IS NULL OR v BETWEEN lo AND hi").join(below, keys, "left")
    upto = inside.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys).orderBy("v")) + F.coalesce("below", F.lit(0)))
    at = [F.min(F.when(F.col("upto") > F.expr(place), F.col("v"))).alias(name) for name, place in places.items()]
    return upto.groupBy(*keys).agg(F.first("n").alias("n"), F.first("largest").alias("largest"), *at)


def half_up_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median rounded half up, by keys."""
    t = order_statistics(df, keys, value, {"low": "floor((n - 1) / 2)", "high": "floor(n / 2)"})
    return t.select(*keys, F.floor((F.col("low") + F.col("high")) / 2 + 0.5).cast("bigint").alias("median"))


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Element n // 2 of the sorted values, and the largest; exact."""
    return order_statistics(df, keys, value, {"median": "floor(n / 2)"}).select(*keys, "median", "largest")


def lower_median_run(runs: DataFrame, keys: list[str], value: str, run: str) -> DataFrame:
    """The run of the lower median score of each group."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    ranked = runs.withColumn("r", F.row_number().over(w.orderBy(value, run))).withColumn("n", F.count("*").over(w))
    return ranked.filter("r = floor((n + 1) / 2)").select(*keys, run, value)


def recall(truth: DataFrame) -> DataFrame:
    """domain (`*` for all), found, total, recall (3 digits). truth: domain, detected (boolean)."""
    each = truth.groupBy("domain").agg(F.count_if("detected").alias("found"), F.count("*").alias("total"))
    every = each.agg(F.lit("*").alias("domain"), F.sum("found").alias("found"), F.sum("total").alias("total"))
    return each.unionByName(every).withColumn("recall", F.round(F.col("found") / F.col("total"), 3))


def met(truth: DataFrame, outputs: DataFrame, strict: bool = True) -> DataFrame:
    """id of the entries of `truth` that the outputs of an audit show.

    truth: id, type, source, pattern, contains. outputs: type, source, key, text, places. By type: crawl_issue wants the key itself;
    code, geo_signal and texte search the text; lighthouse searches key and text. `contains` must be part of a place where it is
    given; without `strict` it is not asked for, as the places of one site do not exist on its twin.
    """
    rows = outputs.select("type", "source", "key", "text", "places").distinct()
    pairs = truth.filter("type <> 'unitaire'").select("id", "type", "source", "pattern", "contains").join(rows, ["type", "source"])
    searched = F.expr("text rlike concat('(?im)', pattern)") | (F.col("type") == "lighthouse") & F.expr("key rlike concat('(?i)', pattern)")
    fits = F.when(F.col("type") == "crawl_issue", F.col("key") == F.col("pattern")).otherwise(searched)
    if strict:
        fits = fits & (F.col("contains").isNull() | F.coalesce(F.expr("exists(places, x -> contains(x, contains))"), F.lit(False)))
    return pairs.filter(fits).select("id").distinct()


def evaluation(truth: DataFrame, broken: DataFrame, clean: DataFrame, phase: int = 0) -> DataFrame:
    """truth with detected, required and false_positive; entries of type `unitaire` are left to unit tests.

    required: the entry's phase has come. false_positive: the clean twin shows it too, unless `on_clean` says that it may (any value
    but `absent`). truth: id, domain, phase, on_clean, and what met() reads.
    """
    t = truth.filter("type <> 'unitaire'")
    seen = t.join(met(t, broken).withColumn("detected", F.lit(True)), "id", "left").join(met(t, clean, strict=False).withColumn("wrong", F.lit(True)), "id", "left")
    false = F.coalesce("wrong", F.lit(False)) & (F.coalesce("on_clean", F.lit("absent")) == "absent")
    return seen.select(*t.columns, F.coalesce("detected", F.lit(False)).alias("detected"), (F.col("phase") <= phase).alias("required"), false.alias("false_positive"))


def evaluation_verdicts(details: DataFrame, clean: DataFrame, least: float = 0.0, least_by_domain: dict[str, float] | None = None, most_false: int = 0, most_unexpected: int = 0) -> DataFrame:
    """what, value, bound of each threshold that an evaluation misses: recall of all and of a domain (1 without required entries; 0
    for a domain that is not there), false positives, and grave findings on the clean twin. clean: severity."""
    spark = details.sparkSession
    required = details.filter("required")
    recalls = recall(required).select("domain", "recall")
    bounds = spark.createDataFrame([("*", float(least)), *((d, float(x)) for d, x in (least_by_domain or {}).items())], "domain string, bound double")
    low = bounds.join(recalls, "domain", "left").withColumn("value", F.coalesce("recall", F.when(F.col("domain") == "*", 1.0).otherwise(0.0))).filter("value < bound")
    low = low.select(F.concat(F.lit("recall "), "domain").alias("what"), F.col("value").cast("double").alias("value"), "bound")
    counted = lambda df, what, most: df.agg(F.count("*").cast("double").alias("value")).filter(F.col("value") > most).select(F.lit(what).alias("what"), "value", F.lit(float(most)).alias("bound"))
    return low.unionByName(counted(details.filter("false_positive"), "false positives", most_false)).unionByName(counted(clean.filter("severity IN ('critique', 'haute')"), "unexpected", most_unexpected))
