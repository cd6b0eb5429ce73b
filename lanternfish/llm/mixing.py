"""Mixing sources to target weights by hash-threshold histograms (DataFrame operations only).

Each document gets a 60-bit hash. Per source, sizes are summed by hash bucket; the bucket in which the running sum reaches the
budget is the boundary, and only its rows are histogrammed again by the next 12 bits, until it holds one hash value. A document
is then taken if its hash is under its source's threshold: nothing is sorted, and a larger budget takes a superset.

A source whose target exceeds its size takes every document once (or twice) and the rest of the budget by threshold. The last
hash value is taken if that comes nearer to the budget.

Defined cases: a null text has size 0 and is never needed; a null source is a source of its own, ranked last; rows that repeat
id and text share a hash and are taken together; if all sizes are 0 all targets are 0; an empty table gives no rows; further
columns pass through mix() unchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanternfish.llm.common import fresh, stored, table

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)  # 150 % of all sizes, as a fraction of whole numbers
CAP = 2
#: Right shifts of the hash, level by level: 12 more bits each time.
SHIFTS = (48, 36, 24, 12, 0)
#: Rows of the per-source tables up to which they are broadcast; beyond it they are joined by shuffle.
BROADCAST_SOURCES = 50_000


def size_of(text: str) -> Column:
    """Number of words: runs of characters other than the blanks \\x20 and \\x09-\\x0D."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash_of(id_col: str, text_col: str) -> Column:
    """The first 60 bits of the MD5 of id and text."""
    both = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\n"), F.coalesce(F.col(text_col), F.lit("")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, 15), 16, 10).cast("long")


def _maybe_broadcast(small: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(small) if rows <= BROADCAST_SOURCES else small


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size -> target: budget by weight, filled up to `cap` times the size, the excess reshared.

    With sources in the order of cap * size / weight, those that stop at their cap are a prefix, and one level is left for
    the rest. The windows run over one row for each source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    w = sizes.withColumn("weight", cycle.cast("long")).withColumn("most", F.lit(cap).cast("long") * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    w = w.withColumns({
        "capped": F.coalesce(F.sum("most").over(before), F.lit(0)),
        "left": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "budget": F.sum("source_size").over(whole) * share[0] / share[1],
    })
    w = w.withColumn("level", (F.col("budget") - F.col("capped")) / F.col("left"))
    # The first source whose cap is not under the level at its place: it and all after it get weight * level.
    stop = F.min(F.when(F.col("most") >= F.col("weight") * F.col("level"), F.struct(F.col("most") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(whole)
    w = w.withColumn("at", stop.getField("level"))
    fill = F.least(F.col("most").cast("double"), F.coalesce(F.col("weight") * F.col("at"), F.col("most").cast("double")))
    return w.select("source", "weight", "source_size", fill.alias("target"))


def thresholds(docs: DataFrame, goals: DataFrame, n_sources: int) -> DataFrame:
    """For each source the copies that every document gets, and the hash up to which one more is taken (null: none).

    docs: source, size, h; goals: source, source_size, target.
    """
    full = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(CAP))).otherwise(F.lit(0)).cast("long")
    state = goals.select("source", "source_size", "target", full.alias("full")).withColumns({
        "rest": F.col("target") - F.col("full") * F.col("source_size"), "base": F.lit(0).cast("long"), "prefix": F.lit(0).cast("long"),
    })
    for level, shift in enumerate(SHIFTS):
        state = stored(state, "mix-level")
        bound = _maybe_broadcast(state.filter("rest > 0").select(F.col("source").alias("s"), F.col("prefix").alias("p")), n_sources)
        last = F.shiftright("h", SHIFTS[level - 1]) if level else F.lit(0).cast("long")
        inside = docs.join(bound, F.col("source").eqNullSafe(F.col("s")) & (last == F.col("p")), "inner")
        hist = inside.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("n"))
        # One row for each bucket of a source, at most 4096.
        run = hist.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("b"))).select(F.col("source").alias("s"), "b", "n", "upto")
        met = state.filter("rest > 0").join(run, F.col("source").eqNullSafe(F.col("s")) & (F.col("base") + F.col("upto") >= F.col("rest")), "left")
        first = met.groupBy("source").agg(F.min(F.struct("b", F.col("base") + F.col("upto") - F.col("n"), "n")).alias("x"))
        first = first.select(F.col("source").alias("s"), F.col("x.b").alias("nb"), F.col("x.col2").alias("nbase"), F.col("x.n").alias("nn"))
        state = state.join(_maybe_broadcast(first, n_sources), F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", "source_size", "target", "full", "rest", F.coalesce("nbase", "base").alias("base"), F.coalesce("nb", "prefix").alias("prefix"), F.coalesce("nn", F.lit(0)).alias("n")
        )
        if shift:
            state = state.drop("n")
    nearer = F.abs(F.col("base") + F.col("n") - F.col("rest")) <= F.abs(F.col("rest") - F.col("base"))
    upto = F.when(F.col("rest") > 0, F.when(nearer, F.col("prefix")).otherwise(F.col("prefix") - 1))
    return stored(state.select("source", "source_size", "target", "full", upto.alias("upto")), "mix-thresholds")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(text_col).alias("size"), hash_of(id_col, text_col).alias("h"))


def _plan(sized: DataFrame) -> tuple[DataFrame, int]:
    sizes = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sizes")
    n = sizes.count()
    return thresholds(sized.select("source", "size", "h"), targets(sizes), n), n


def _taken(sized: DataFrame, cuts: DataFrame, n: int) -> DataFrame:
    cuts = _maybe_broadcast(cuts.withColumnRenamed("source", "cut_source"), n)
    copies = F.col("full") + F.when(F.col("h") <= F.col("upto"), F.lit(1)).otherwise(F.lit(0))
    return sized.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left").withColumn("copies", copies)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: id, size, source_size, target, copies and taken (size times copies)."""
    sized = stored(_sized(docs, id_col, text_col, source_col), "mix-sized")
    cuts, n = _plan(sized)
    out = _taken(sized, cuts, n)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: every row of docs as often as the mix takes it. Texts are not shuffled."""
    sized = stored(_sized(docs, id_col, text_col, source_col), "mix-sized")
    cuts, n = _plan(sized)
    source, full, upto, copy = fresh(docs, "mix_source", "mix_full", "mix_upto", "mix_copy")
    cuts = _maybe_broadcast(cuts.select(F.col("source").alias(source), F.col("full").alias(full), F.col("upto").alias(upto)), n)
    copies = F.col(full) + F.when(hash_of(id_col, text_col) <= F.col(upto), F.lit(1)).otherwise(F.lit(0))
    joined = docs.join(cuts, F.col(source_col).eqNullSafe(F.col(source)), "left")
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = {
    "op8_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2 * source_size AS most FROM s),
v AS (SELECT *, (sum(source_size) OVER () * 3 / 2.0 - coalesce(sum(most) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
      FROM w WINDOW o AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT min_by(level, most / weight) FILTER (most >= weight * level) AS fill FROM v),
t AS (SELECT source, source_size, least(most, coalesce(weight * fill, most))::DOUBLE AS target FROM v CROSS JOIN x),
u AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END AS copies FROM t),
r AS (SELECT d.*, u.source_size, u.target, u.copies, u.target - u.copies * u.source_size AS rest,
             sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS here
      FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target,
       (size * (copies + CASE WHEN rest > 0 AND (upto < rest OR (upto - here < rest AND abs(upto - rest) <= abs(rest - upto + here))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r""",
}
QUERIES = {"op8_mixing": op8_mixing}
