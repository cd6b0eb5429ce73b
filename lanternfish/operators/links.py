"""Link graph: in-links, anchors, click depth, and the facts of a page that come from other pages."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.plans.tables import stored


def inlinks(links: DataFrame) -> DataFrame:
    """site, target, inlinks (distinct other pages that link to it), nofollow (links that say so)."""
    others = links.filter(F.col("src") != F.col("target"))
    nofollow = F.coalesce(F.array_contains(F.split("rel", r"\s+"), "nofollow"), F.lit(False))
    # Distinct pairs first, so that a page linked from everywhere is summed up before the exchange.
    pairs = others.groupBy("site", "target", "src").agg(F.count_if(nofollow).alias("nofollow"))
    return pairs.groupBy("site", "target").agg(F.count("*").alias("inlinks"), F.sum("nofollow").alias("nofollow"))


def anchors(links: DataFrame, top: int = 10) -> DataFrame:
    """site, target, anchor (lower case, 80 characters), n, place: the most frequent anchor texts, ties by first appearance."""
    text = F.substring(F.lower(F.trim("text")), 1, 80)
    counts = links.filter(F.trim("text") != "").groupBy("site", "target", text.alias("anchor")).agg(F.count("*").alias("n"), F.min(F.struct("seq", "pos")).alias("first"))
    place = F.row_number().over(Window.partitionBy("site", "target").orderBy(F.desc("n"), "first"))
    return counts.withColumn("place", place).filter(F.col("place") <= top).drop("first")


def with_inlinks(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """Pages with inlinks and nofollow, 0 where nothing links to them."""
    c = counts.select(F.col("site").alias("c_site"), F.col("target").alias("c_url"), F.col("inlinks"), F.col("nofollow"))
    out = pages.drop("inlinks", "nofollow").join(c, (F.col("site") == F.col("c_site")) & (F.col("url") == F.col("c_url")), "left").drop("c_site", "c_url")
    return out.fillna(0, ["inlinks", "nofollow"])


def with_sitemap(pages: DataFrame, sitemap: DataFrame) -> DataFrame:
    """Pages with in_sitemap and sitemap_lastmod. sitemap: site, url, lastmod."""
    s = sitemap.groupBy(F.col("site").alias("s_site"), F.col("url").alias("s_url")).agg(F.max("lastmod").alias("sitemap_lastmod"))
    out = pages.drop("in_sitemap", "sitemap_lastmod").join(s, (F.col("site") == F.col("s_site")) & (F.col("url") == F.col("s_url")), "left")
    return out.withColumn("in_sitemap", F.col("s_url").isNotNull()).drop("s_site", "s_url")


def click_depth(pages: DataFrame, links: DataFrame, starts: DataFrame) -> DataFrame:
    """site, url, depth: fewest clicks from a start page over links between known pages; null if none leads there.

    pages: site, url; links: site, src, target; starts: site, url. Each round reads only the frontier; rounds are tables, so a
    lost executor costs a round at most. There are as many rounds as the deepest page needs.
    """
    known = pages.select("site", "url").distinct()
    edges = stored(
        links.select("site", "src", F.col("target").alias("url")).filter("src <> url").distinct().join(known, ["site", "url"], "left_semi"), "depth-edges"
    )
    seen = stored(starts.select("site", "url").distinct().join(known, ["site", "url"], "left_semi").withColumn("depth", F.lit(0)), "depth-seen")
    frontier = seen
    for d in count(1):
        step = edges.join(frontier.select("site", F.col("url").alias("src")), ["site", "src"]).select("site", "url").distinct()
        frontier = stored(step.join(seen.select("site", "url"), ["site", "url"], "left_anti").withColumn("depth", F.lit(d)), "depth-frontier")
        if frontier.isEmpty():
            break
        seen = stored(seen.unionByName(frontier), "depth-seen") if d % 8 == 0 else seen.unionByName(frontier)
    return known.join(seen, ["site", "url"], "left")


def orphans(pages: DataFrame, sitemap: DataFrame, counts: DataFrame, home: Column) -> DataFrame:
    """Sitemap urls of pages that answer 200 without redirect, that nothing links to; the home page left out."""
    fine = pages.filter((F.col("final_status") == 200) & (F.col("redirect_hops") == 0) & ~home).select("site", "url")
    linked = counts.filter("inlinks > 0").select("site", F.col("target").alias("url"))
    return sitemap.select("site", "url").distinct().join(fine, ["site", "url"], "left_semi").join(linked, ["site", "url"], "left_anti")


def canonical_targets(pages: DataFrame, checked: DataFrame | None = None, crawled: DataFrame | None = None) -> DataFrame:
    """site, url, seq (where pages have it), target, and of the first canonical's page: t_status, t_hops, t_noindex. checked: more targets of that shape;
    crawled: the records that canonicals are looked up in, where these are more than pages. Of several records of one url the first tells what a canonical that names it meets; each of them is a row of its own."""
    seq = [c for c in ("seq",) if c in pages.columns]
    state = F.struct(*seq, F.col("final_status").alias("t_status"), F.col("redirect_hops").alias("t_hops"), F.col("noindex").alias("t_noindex"))
    known = (pages if crawled is None else crawled).groupBy("site", F.col("url").alias("target")).agg(F.min(state).alias("s")).select("site", "target", "s.t_status", "s.t_hops", "s.t_noindex")
    if checked is not None:
        known = known.unionByName(checked.join(known.select("site", "target"), ["site", "target"], "left_anti"))
    first = F.get("canonicals", F.lit(0))
    return pages.select("site", "url", *seq, first.alias("target")).filter("target IS NOT NULL AND target <> url").join(known, ["site", "target"], "left")


def resources(uses: DataFrame, most: int = 400) -> DataFrame:
    """Resources by number of pages that use them, then url. uses: site, page, resource."""
    n = uses.groupBy("site", "resource").agg(F.countDistinct("page").alias("n_pages"), F.min("page").alias("first_page"))
    place = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("n_pages"), "resource"))
    return n.withColumn("place", place).filter(F.col("place") <= most)
