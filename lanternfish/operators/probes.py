"""Security probes beyond fixed paths: scripts of the home page, their source maps, secrets that are delivered, the image proxy, CORS.

Answers are ingested. A script belongs to a site if the home page loads it from its own origin; what the pages ask for is a row for
each script, answers are joined on their address, and secrets are searched in each body on its own, so nothing is put together.

Defined cases: null bodies hold nothing; a script that is loaded twice counts once, at its first place; a site without an answer to
a probe gets no finding for it, except that a proxy that answers neither with an image nor with a refusal is undecided.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish.functions import urls
from lanternfish.functions.sanitise import KNOWN_KEYS

# Attributes that load a script, scripts that are probed on each site, what of a script's end is searched for its
# map, refusals of the image proxy, a key that may be public, characters of a secret that are shown.
SCRIPT_ATTRIBUTES = r"(?:src|href|component-url|renderer-url)=\"([^\"]+\.m?js(?:\?[^\"]*)?)\""
MOST_SCRIPTS, END_OF_SCRIPT, SHOWN = 12, 300, 12
REFUSALS = (400, 403, 404)
PUBLIC_KEY = "AIza"
MAP_REFERENCE = r"sourceMappingURL=([^ \n]+)"


def home_scripts(homes: DataFrame, most: int = MOST_SCRIPTS) -> DataFrame:
    """site, place, url: scripts of each home page from its own origin, without queries; of the first `most` addresses that the page
    names. homes: site, url, html."""
    named = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(SCRIPT_ATTRIBUTES), F.lit(1)), lambda x: F.regexp_replace(x, r"\?.*$", "")))
    each = homes.select("site", F.col("url").alias("home"), F.posexplode(F.slice(named, 1, most)).alias("place", "ref"))
    each = each.withColumn("url", urls.resolved(F.col("home"), F.col("ref")))
    own = (urls.authority(F.col("url")) == urls.authority(F.col("home"))) & (urls.scheme(F.col("url")) == urls.scheme(F.col("home")))
    return each.filter(own).groupBy("site", "url").agg(F.min("place").alias("place")).select("site", "place", "url")


def public_maps(scripts: DataFrame, answers: DataFrame) -> DataFrame:
    """site, url, map_status, reference of scripts whose map is served or named at their end. answers: url, status, body of the scripts
    and of their addresses with `.map`."""
    ends = answers.select("url", F.nullif(F.regexp_extract(F.coalesce(F.expr(f"right(body, {END_OF_SCRIPT})"), F.lit("")), MAP_REFERENCE, 1), F.lit("")).alias("reference"))
    maps = answers.select(F.col("url").alias("map_url"), F.col("status").alias("map_status"))
    each = scripts.join(ends, "url", "left").join(maps, F.concat("url", F.lit(".map")) == F.col("map_url"), "left")
    return each.filter((F.col("map_status") == 200) | F.col("reference").isNotNull()).select("site", "url", "map_status", "reference")


def delivered_secrets(bodies: DataFrame) -> DataFrame:
    """site, shown, severity, n: known keys in delivered bodies, cut to a few characters; a key that may be public is basse. n: bodies
    that hold it. bodies: site, url, body."""
    each = bodies.select("site", "url", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(KNOWN_KEYS), F.lit(0)))).alias("key"))
    return each.groupBy("site", "key").agg(F.count_distinct("url").alias("n")).select(
        "site", F.concat(F.left("key", F.lit(SHOWN)), F.lit("…")).alias("shown"), F.when(F.col("key").startswith(PUBLIC_KEY), "basse").otherwise("haute").alias("severity"), "n"
    )


def proxy_verdict(status: Column, content_type: Column) -> Column:
    """`ouvert` if an image of another site came back transformed, `refuse`, else `indetermine`."""
    image = F.coalesce(content_type.rlike("(?i)^image/"), F.lit(False))
    return F.when((status == 200) & image, "ouvert").when(status.isin(*REFUSALS), "refuse").otherwise("indetermine")


def probe_findings(scripts: DataFrame, homes: DataFrame, answers: DataFrame, proxies: DataFrame, origins: DataFrame) -> DataFrame:
    """site, key, severity, text of all probes.

    scripts: home_scripts(); homes: site, url, html; answers: url, status, body; proxies: site, status, content_type of an image of
    another site asked of the image proxy; origins: site, allow_origin that the page gives to a foreign origin.
    """
    maps = public_maps(scripts, answers).select("site", F.lit("source_map_publique").alias("key"), F.lit("basse").alias("severity"), F.col("url").alias("text"))
    served = scripts.join(answers, "url").select("site", "url", "body").unionByName(homes.select("site", "url", F.col("html").alias("body")))
    secrets = delivered_secrets(served).select("site", F.when(F.col("severity") == "haute", "secret_livre").otherwise("cle_publique").alias("key"), "severity", F.col("shown").alias("text"))
    verdict = proxy_verdict(F.col("status"), F.col("content_type"))
    judged = proxies.withColumn("verdict", verdict).filter("verdict <> 'refuse'")
    proxy = judged.select("site", F.concat(F.lit("proxy_images_"), "verdict").alias("key"), F.when(F.col("verdict") == "ouvert", "haute").otherwise("basse").alias("severity"), F.coalesce(F.col("status").cast("string"), F.lit("")).alias("text"))
    cors = origins.filter("allow_origin <> ''").select("site", F.lit("cors_ouvert").alias("key"), F.lit("basse").alias("severity"), F.col("allow_origin").alias("text"))
    return maps.unionByName(secrets).unionByName(proxy).unionByName(cors)
