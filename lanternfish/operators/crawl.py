"""What a crawler decides, over ingested answers and links: redirect chains, the order of visits under a budget, probes that stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.functions import urls
from lanternfish.plans.tables import stored

#: Requests that a fetch makes at most.
MOST_HOPS = 10
_CHAIN = "array<struct<url:string,status:int>>"


def redirect_chains(answers: DataFrame, hops: int = MOST_HOPS) -> DataFrame:
    """site, url, chain (url and status of each redirect), final_url, status (of the first answer), final_status, redirect_hops,
    redirect_statuses of every answer. answers: site, url, status, location (one row for each url that was asked).

    Chains are composed by doubling: a table of all chains of up to n redirects, joined with itself, holds those of up to 2 n, so
    `hops` take log2(hops) joins. Where an answer is lacking the final status is 0; a chain that is not at its end after `hops`
    redirects, as in a circle, has final status -1.
    """
    moved = F.col("status").between(300, 399) & (F.trim(F.coalesce("location", F.lit(""))) != "")
    one = answers.select("site", "url", F.when(moved, urls.resolved(F.col("url"), F.trim("location"))).otherwise(F.col("url")).alias("to"), F.when(moved, F.array(F.struct("url", F.col("status").cast("int").alias("status")))).otherwise(F.array().cast(_CHAIN)).alias("chain"))
    # Fragments are not asked for.
    one = stored(one.withColumn("to", F.regexp_replace("to", "#.*$", "")), "redirects-1")

    def then(first: DataFrame, second: DataFrame) -> DataFrame:
        """A chain, then that of the url that it ends at; chains that are at their end stay."""
        at = second.filter("size(chain) > 0").select("site", F.col("url").alias("to"), F.col("to").alias("next"), F.col("chain").alias("more"))
        open_ = first.filter("size(chain) > 0").join(at, ["site", "to"], "left")
        open_ = open_.select("site", "url", F.coalesce("next", "to").alias("to"), F.concat("chain", F.coalesce("more", F.array().cast(_CHAIN))).alias("chain"))
        return open_.unionByName(first.filter("size(chain) = 0"))

    whole, power, left, bit = None, one, hops, 1
    while left:
        if left & bit:
            whole = power if whole is None else stored(then(whole, power), f"redirects-whole-{bit}")
            left -= bit
        if left:
            power, bit = stored(then(power, power), f"redirects-{2 * bit}"), 2 * bit
    last = answers.select("site", F.col("url").alias("to"), F.col("status").cast("int").alias("last"), moved.alias("on"))
    out = whole.join(last, ["site", "to"], "left").join(answers.select("site", "url", F.col("status").cast("int").alias("status")), ["site", "url"])
    final = F.when(F.size("chain") >= hops, -1).when(F.col("last").isNull(), 0).otherwise(F.col("last"))
    return out.select("site", "url", "chain", F.col("to").alias("final_url"), "status", final.alias("final_status"), F.size("chain").alias("redirect_hops"), F.transform("chain", lambda c: c["status"]).alias("redirect_statuses"))


def visits(start: DataFrame, links: DataFrame, sitemap: DataFrame, most: int, blocked: DataFrame | None = None) -> DataFrame:
    """site, url, depth, place: the pages that a breadth-first crawl visits, in its order, up to `most` for each site.

    start: site, url; links: site, src, pos, target (allowed ones); sitemap: site, url, pos; blocked: site, url. A page's links are
    followed in their order, pages in the order in which they were found. When no link leads further and the budget is not spent,
    pages of the sitemap follow in its order, without a depth, and then what only they lead to. Blocked pages take no place and are not followed.

    Each level is one join over the links of its pages and a stored table. Rankings keep only the rows that the budget can still
    take, so a level of a large site is not sorted whole.
    """
    edges = links.select("site", "src", "pos", "target")
    closed = blocked.select("site", "url").distinct().withColumn("closed", F.lit(True)) if blocked is not None else None

    def allowed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("closed", F.lit(False)) if closed is None else rows.join(closed, ["site", "url"], "left").fillna(False, ["closed"])

    def placed(found: DataFrame, order: list) -> DataFrame:
        """found: site, url, depth, used (places taken before) and the columns of order."""
        w = Window.partitionBy("site").orderBy(*order)
        ranked = found.filter("NOT closed").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
        return ranked.select("site", "url", "depth", (F.col("used") + F.col("rank")).alias("place")).filter(F.col("place") <= most)

    seen, done = None, None
    level = stored(placed(allowed(start.select("site", "url").distinct()).withColumns({"depth": F.lit(0), "used": F.lit(0)}), ["url"]), "crawl-level")
    seen = start.select("site", "url").distinct()
    phase = 1
    while True:
        done = level if done is None else done.unionByName(level)
        taken = done.groupBy("site").agg(F.max("place").alias("used"))
        found = None
        if not level.isEmpty():
            reached = level.select("site", F.col("url").alias("src"), "depth", "place").join(edges, ["site", "src"]).groupBy("site", F.col("target").alias("url"))
            found = reached.agg(F.min(F.struct("place", "pos")).alias("first"), F.min_by("depth", F.struct("place", "pos")).alias("depth")).withColumn("depth", F.col("depth") + 1)
        elif phase == 1:
            phase, found = 2, sitemap.join(start.select("site").distinct(), "site", "left_semi").groupBy("site", "url").agg(F.min(F.struct(F.lit(0).alias("place"), F.col("pos").cast("bigint").alias("pos"))).alias("first")).withColumn("depth", F.lit(None).cast("int"))
        else:
            return done
        fresh = stored(found.join(seen, ["site", "url"], "left_anti"), "crawl-found")
        seen = stored(seen.unionByName(fresh.select("site", "url")), "crawl-seen")
        level = stored(placed(allowed(fresh).join(taken, "site", "left").fillna(0, ["used"]).filter(F.col("used") < most), ["first"]), "crawl-level")


def probed(candidates: DataFrame, answers: DataFrame, most: int = 5, failures: int = 3) -> DataFrame:
    """site, url, status of the probes that are made: in the order of candidates (site, url, place), until `most` are made or
    `failures` in a row got no answer. answers: site, url, status (0 and less, or none: no answer)."""
    t = candidates.join(answers.select("site", "url", "status"), ["site", "url"], "left").withColumn("status", F.coalesce("status", F.lit(0)))
    w = Window.partitionBy("site").orderBy("place", "url")
    t = t.withColumns({"nth": F.row_number().over(w), "good": F.sum((F.col("status") > 0).cast("int")).over(w)}).filter(F.col("nth") <= most)
    # Failures since the last answer; the first time that they are enough ends the site's probes.
    run = F.row_number().over(Window.partitionBy("site", "good").orderBy("nth")) - F.when(F.col("good") > 0, 1).otherwise(0)
    t = t.withColumn("run", run)
    end = F.min(F.when(F.col("run") >= failures, F.col("nth"))).over(Window.partitionBy("site"))
    return t.withColumn("end", end).filter("end IS NULL OR nth <= end").select("site", "url", "status")
