"""Crawl findings that need more than one page: canonical targets, sitemaps, robots files, images, reader errors. Every function
returns site, key, severity, seq, url, n like the page rules, so fold() takes their union; seq is null for findings about a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish.functions import urls
from lanternfish.operators import issues, links

SHAPE = "site string, key string, severity string, seq bigint, url string, n bigint"


def _found(rows: DataFrame, key: Column | str, severity: Column | str, seq=None, url="url") -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select("site", lit(key).alias("key"), lit(severity).alias("severity"), F.col(seq).cast("bigint").alias("seq") if seq else F.lit(None).cast("bigint").alias("seq"), F.col(url).alias("url"), F.lit(1).cast("bigint").alias("n"))


def canonical_targets(pages: DataFrame, checked: DataFrame | None = None) -> DataFrame:
    """canonical_bad_target and canonical_target_unreachable of pages with one canonical that names another page, whose state is
    known from the crawl or from `checked` (site, target, t_status, t_hops, t_noindex)."""
    rows = issues.judged(pages).filter(f"({issues.H}) AND n_canonicals = 1 AND canonical <> url")
    t = links.canonical_targets(rows, checked, pages).filter("t_status IS NOT NULL")
    bad = (F.col("t_status") != 200) | (F.col("t_hops") > 0) | F.coalesce("t_noindex", F.lit(False))
    key = F.when(F.col("t_status") <= 0, "canonical_target_unreachable").when(bad, "canonical_bad_target")
    severity = F.when(F.col("t_status") <= 0, "basse").otherwise("haute")
    return _found(t.withColumn("key", key).filter("key IS NOT NULL"), F.col("key"), severity, "seq")


def site_files(sites: DataFrame, sitemap: DataFrame, robots_files: DataFrame, robots_sitemaps: DataFrame) -> DataFrame:
    """no_sitemap, robots_missing and robots_sitemap_relative. sites: site, start; robots_files: site, status, text;
    robots_sitemaps: site, url, relative (robots.sitemap_lines())."""
    s = sites.select("site", F.col("start").alias("url"))
    without = s.join(sitemap.select("site").distinct(), "site", "left_anti")
    served = robots_files.filter("status = 200 AND trim(coalesce(text, '')) <> ''").select("site").distinct()
    relative = robots_sitemaps.filter("relative").select("site", "url")
    return (
        _found(without, "no_sitemap", "haute").unionByName(_found(s.join(served, "site", "left_anti"), "robots_missing", "moyenne"))
        .unionByName(_found(relative, "robots_sitemap_relative", "moyenne"))
    )


def blocked(closed: DataFrame, sitemap: DataFrame, inlinks: DataFrame) -> DataFrame:
    """sitemap_blocked and linked_blocked (those not in the sitemap) of urls that robots.txt closes. closed: site, url."""
    rows = closed.select("site", "url").distinct()
    listed = sitemap.select("site", "url").distinct().withColumn("listed", F.lit(True))
    linked = inlinks.filter("inlinks > 0").select("site", F.col("target").alias("url"), F.lit(True).alias("linked"))
    rows = rows.join(listed, ["site", "url"], "left").join(linked, ["site", "url"], "left").filter("listed OR linked")
    return _found(rows, F.when(F.col("listed"), "sitemap_blocked").otherwise("linked_blocked"), F.when(F.col("listed"), "haute").otherwise("basse"))


def broken_images(images: DataFrame) -> DataFrame:
    """One finding for each image source that was asked for and answered with an error. images: site, url, status."""
    return _found(images.filter("status >= 400").select("site", "url").distinct(), "broken_images", "moyenne")


def reader_errors(items: DataFrame) -> DataFrame:
    """modules_en_erreur for each kind of error at which pages could not be read (elements with the tag `!error`)."""
    rows = items.filter("tag = '!error'").groupBy("site", F.col("attrs")["why"].alias("why")).agg(F.min("seq").alias("seq"), F.min("url").alias("url"))
    return _found(rows, "modules_en_erreur", "haute", "seq")


def sitemap_variants(sitemap: DataFrame, pages: DataFrame, sites: DataFrame, probes: DataFrame) -> DataFrame:
    """Sitemap urls that were not crawled as written. A (scheme, host) other than the crawl's is judged as a group by its probes:
    only 2xx answers and no redirect give sitemap_sans_redirection for all of its urls, else they are sitemap_redirect; of other
    urls, those whose own probe redirects. sites: site, start; probes: site, url, status."""
    s = sitemap.select("site", "url").distinct().join(pages.select("site", "url"), ["site", "url"], "left_anti").join(sites.select("site", "start"), "site")
    p = probes.select("site", "url", "status").groupBy("site", "url").agg(F.min("status").alias("status"))
    ok, moved = F.col("status").between(200, 299), F.col("status").between(300, 399)
    groups = p.groupBy("site", urls.scheme(F.col("url")).alias("scheme"), urls.authority(F.col("url")).alias("place")).agg(F.count_if(ok).alias("fine"), F.count_if(moved).alias("moved"))
    s = s.withColumns({"scheme": urls.scheme(F.col("url")), "place": urls.authority(F.col("url")), "variant": urls.is_variant(F.col("url"), F.col("start"))})
    s = s.join(p, ["site", "url"], "left").join(groups, ["site", "scheme", "place"], "left")
    key = F.when(F.col("variant") & (F.col("fine") > 0) & (F.col("moved") == 0), "sitemap_sans_redirection").when(F.col("variant") | moved, "sitemap_redirect")
    return _found(s.withColumn("key", key).filter("key IS NOT NULL"), F.col("key"), "moyenne")


def duplicates(pages: DataFrame) -> DataFrame:
    """title_dup, desc_dup (n: pages that share the value) and near_dup_titles (n: pairs of near pages, at the first page of a
    class). Pages are told apart by their url: see issues.near_url_pairs()."""
    found = issues.duplicates(pages, "title", "title_dup").unionByName(issues.duplicates(pages, "meta_description", "desc_dup")).select("site", "key", "severity", "seq", "url", "n")
    near = issues.near_url_pairs(pages)
    return found.unionByName(near.select("site", F.lit("near_dup_titles").alias("key"), F.lit("moyenne").alias("severity"), "seq", "url", F.col("pairs").alias("n")))
