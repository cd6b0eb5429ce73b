"""Files of a site that its pages load: weights, caches, fonts. Measurements are ingested; a file is judged once, with its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish.functions import text, urls
from lanternfish.operators.modules import held

IMAGE_LIMIT, SCRIPT_LIMIT, CACHE_LEAST, CACHE_GRAVE, CACHE_SECONDS = 200 * 1024, 150 * 1024, 10 * 1024, 100 * 1024, 3600
IN_PROPS = r"(?i)\"((?:/(?!/)|https?://)[^\s\"'<>]+\.(?:png|jpe?g|gif|webp|avif|svg)(?:\?[^\s\"']*)?)\""


def uses(items: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """site, page, `by` (seq: each record of a url for itself), url, type of the files that each page loads from its own host: images (of island properties too), scripts, style
    sheets, fonts. Of several uses on a page the first tells the type; images made on demand are left out."""
    a = F.col("attrs")
    rel = F.split(F.lower(F.coalesce(a["rel"], F.lit(""))), r"\s+")
    one = lambda when, kind, ref: F.when(when & (F.coalesce(ref, F.lit("")) != ""), F.struct(F.lit(kind).alias("type"), ref.alias("ref")))
    tag = lambda t: F.col("tag") == t
    preload = lambda as_: tag("link") & F.array_contains(rel, "preload") & ~F.array_contains(rel, "modulepreload") & ~F.array_contains(rel, "stylesheet") & (a["as"] == as_)
    direct = F.array(
        one(tag("img"), "image", a["src"]), one(tag("script") & a["nomodule"].isNull(), "script", a["src"]), *[one(tag("astro-island"), "script", a[k]) for k in ("component-url", "renderer-url", "before-hydration-url")],
        one(tag("link") & F.array_contains(rel, "modulepreload"), "script", a["href"]), one(tag("link") & F.array_contains(rel, "stylesheet") & ~F.array_contains(rel, "modulepreload"), "css", a["href"]),
        one(preload("image"), "image", a["href"]), one(preload("script"), "script", a["href"]), one(preload("font"), "police", a["href"]),
    )
    props = F.when(tag("astro-island"), F.transform(F.regexp_extract_all(F.coalesce(a["props"], F.lit("")), F.lit(IN_PROPS), F.lit(1)), lambda x: F.struct(F.lit("image").alias("type"), x.alias("ref"))))
    loaded = items.filter(F.col("tag").isin("img", "script", "astro-island", "link") & ~F.coalesce("inert", F.lit(False)))
    each = loaded.select("site", "seq", F.col("url").alias("page"), "pos", F.explode(F.concat(F.array_compact(direct), F.coalesce(props, F.array().cast("array<struct<type:string,ref:string>>")))).alias("u"))
    each = held(each, "url", urls.resolved(F.col("page"), F.trim("u.ref"))).select("site", "page", "seq", "pos", "u.type", "url")
    own = (urls.authority(F.col("url")) == urls.authority(F.col("page"))) & urls.scheme(F.col("url")).isin("http", "https") & ~urls.path(F.col("url")).startswith("/_image")
    return each.filter(own).groupBy("site", "page", *by, F.regexp_replace("url", "#.*$", "").alias("url")).agg(F.min_by("type", F.struct("seq", "pos")).alias("type"))


def _briefly(cc: Column, expires_in: Column) -> Column:
    cc = F.lower(F.coalesce(cc, F.lit("")))
    age = F.nullif(F.regexp_extract(cc, r"(?<![\w-])max-age=([0-9]{1,15})", 1), F.lit("")).cast("bigint")
    return cc.rlike("no-store|no-cache") | F.coalesce(age < CACHE_SECONDS, F.coalesce(expires_in, F.lit(0)) < CACHE_SECONDS)


def _never(cc: Column) -> Column:
    cc = F.lower(F.coalesce(cc, F.lit("")))
    return cc.rlike(r"no-store|no-cache|(?<![\w-])max-age=0+(?![0-9])")


def resource_findings(used: DataFrame, measured: DataFrame) -> DataFrame:
    """Observations (one for each page that loads the file): images over 200 KiB, scripts over 150 KiB as sent, files without a hash
    in their name that are cached for less than an hour. Those without a cache are graver for the whole site if one of them is large
    and never kept. measured: site, url, status, bytes (as sent), cache_control, content_type, expires_in (seconds; null if unknown).
    Files that do not answer 200, answer with a page, or were not measured give none."""
    fine = measured.filter((F.col("status") == 200) & ~F.lower(F.coalesce("content_type", F.lit(""))).startswith("text/html")).dropDuplicates(["site", "url"])
    path, size = urls.path(F.col("url")), F.floor(F.col("bytes") / 1024).cast("string")
    shown = urls.secretless_url(F.col("url"))
    plain = ~text.is_versioned_path(path) & (F.col("bytes") >= CACHE_LEAST) & _briefly(F.col("cache_control"), F.col("expires_in"))
    f = fine.select("site", "url", "bytes", "content_type", "cache_control", plain.alias("brief"), F.concat(shown, F.lit(" ("), size, F.lit(" Ko)")).alias("label"), F.concat(shown, F.lit(" (Cache-Control : "), F.coalesce(F.nullif(F.substring(text.masked(F.col("cache_control")), 1, 80), F.lit("")), F.lit("absent")), F.lit(")")).alias("cache_label"))
    grave = f.filter("brief").groupBy("site").agg(F.bool_or((F.col("bytes") >= CACHE_GRAVE) & _never(F.col("cache_control"))).alias("grave"))
    rows = used.join(f, ["site", "url"]).join(grave, "site", "left")
    one = lambda when, key, severity, label: F.when(when, F.struct(F.lit(key).alias("key"), severity.alias("severity"), F.col(label).alias("signature")))
    image = (F.col("type") == "image") | F.lower(F.coalesce("content_type", F.lit(""))).startswith("image/")
    hit = F.array(
        one(image & (F.col("bytes") > IMAGE_LIMIT), "image_lourde", F.lit("moyenne"), "label"), one((F.col("type") == "script") & (F.col("bytes") > SCRIPT_LIMIT), "js_lourd", F.lit("moyenne"), "label"),
        one(F.col("brief"), "asset_sans_cache", F.when(F.col("grave"), "moyenne").otherwise("basse"), "cache_label"),
    )
    return rows.select("site", F.col("page").alias("url"), F.explode(F.array_compact(hit)).alias("h")).select("site", "url", "h.key", "h.severity", "h.signature", F.col("h.signature").alias("example"))


def font_findings(items: DataFrame, used: DataFrame, sheets: DataFrame) -> DataFrame:
    """Fonts that keep text invisible while they load: in style elements, and in the style sheets that pages use (site, url, css)."""
    inline = items.filter((F.col("tag") == "style") & ~F.coalesce("inert", F.lit(False))).select("site", "url", F.lit("style en ligne").alias("place"), F.explode(text.fonts_without_display(F.col("text"))).alias("family"))
    linked = used.filter("type = 'css'").join(sheets.select("site", "url", F.explode(text.fonts_without_display(F.col("css"))).alias("family")), ["site", "url"])
    rows = inline.unionByName(linked.select("site", F.col("page").alias("url"), urls.path(F.col("url")).alias("place"), "family"))
    label = F.concat("family", F.lit(" ("), "place", F.lit(")"))
    return rows.select("site", "url", F.lit("police_sans_font_display").alias("key"), F.lit("basse").alias("severity"), label.alias("signature"), label.alias("example"))
