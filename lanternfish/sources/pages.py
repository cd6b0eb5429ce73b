"""The columns of page records, addresses and followed links of crawled pages; sources/html.py reads the records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.functions import urls

#: Columns of a page record and what stands for a page of which the fact is not known.
DEFAULTS = {
    "site": "string", "url": "string", "seq": "bigint", "final_url": "string", "status": "int", "final_status": "int", "redirect_hops": "int", "redirect_statuses": "array<int>", "is_html": "boolean",
    "ttfb": "double", "title": "string", "meta_description": "string", "n_h1": "int", "h1": "array<string>", "words": "bigint", "content_words": "bigint", "bytes_html": "bigint",
    "depth": "int", "inlinks": "bigint", "in_sitemap": "boolean", "n_jsonld": "int", "microdata_items": "int", "jsonld_errors": "int", "og_title": "boolean", "og_image": "boolean", "canonicals": "array<string>",
    "noindex": "boolean", "meta_robots": "string", "lang": "string", "viewport": "boolean", "imgs_no_alt": "bigint", "imgs_no_dims": "bigint", "form_fields_no_label": "bigint", "lazy_first_img": "boolean",
    "mixed_content": "array<string>", "hreflang": "array<string>",
}


def addresses(pages: DataFrame) -> DataFrame:
    """site, url and seq of the table (page_id, url, html): its pages count as fetched in the order of their ids."""
    return pages.select(urls.host(F.col("url")).alias("site"), "url", F.col("page_id").alias("seq"))


def completed(df: DataFrame) -> DataFrame:
    """df with all columns of a page record; those it lacks are null."""
    have = set(df.columns)
    return df.select(*[c for c in df.columns if c in DEFAULTS], *[F.lit(None).cast(t).alias(c) for c, t in DEFAULTS.items() if c not in have])


def links(pages: DataFrame) -> DataFrame:
    """site, src, seq, pos, href, target, text and rel of every followed link, by built-in functions."""
    whole = F.regexp_extract_all("html", F.lit(r"(?s)<a\s[^>]*>.*?</a>"), F.lit(0))
    each = pages.select("url", F.col("page_id").alias("seq"), F.posexplode(whole).alias("pos", "a"))
    href = F.regexp_extract("a", r'href="([^"]*)"', 1)
    each = each.select("url", "seq", "pos", href.alias("href"), F.trim(F.regexp_replace("a", r"(?s)<[^>]*>", "")).alias("text"), F.lower(F.regexp_extract("a", r'rel="([^"]*)"', 1)).alias("rel"))
    each = each.filter(urls.is_followed_href(F.col("href")))
    # Two steps, so that each expression is evaluated once.
    each = each.withColumn("whole", urls.resolved(F.col("url"), F.col("href")))
    target = urls.normalized(F.col("whole"))
    return each.select(urls.host(F.col("url")).alias("site"), F.col("url").alias("src"), "seq", "pos", "href", target.alias("target"), F.substring("text", 1, 120).alias("text"), "rel").filter("target IS NOT NULL")
