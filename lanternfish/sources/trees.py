"""Files on disk as tables: sitemap documents (plain or gzip) and source trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that are never read, endings of texts, the largest file that is read.
SKIPPED_FOLDERS = ("node_modules", ".git", "dist", ".astro", ".vercel", ".netlify", "build", "coverage")
TEXT_NAMES = r"(?i)\.(?:astro|tsx?|jsx?|mjs|cjs|css|scss|html|mdx?|json|ya?ml|toml|txt|svg|xml)$"
MOST_OCTETS = 8_000_000


def sitemap_documents(spark: SparkSession, path: str, site: str) -> DataFrame:
    """site, url (the file's own), xml of the sitemap files below a path; files whose name ends in .gz are decompressed by Spark."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.lit(site).alias("site"), F.input_file_name().alias("url"), F.col("value").alias("xml"))


def source_tree(spark: SparkSession, path: str, site: str, most: int = MOST_OCTETS) -> tuple[DataFrame, DataFrame]:
    """Files of a source tree: (site, path, text) of those that are read, and (site, path, octets, why) of those that are not
    (`folder`, `kind`, `size`, `binary`). Paths are relative to the tree. Of files that are passed over only the sizes are
    read. Spark's file sources do not list names that start with a dot or an underscore; such files come from elsewhere."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = F.regexp_replace(F.lit(path), "^(?:file:)?/*(.*?)/*$", "$1")
    inner = F.regexp_replace(F.split_part("path", F.concat(F.lit("/"), root, F.lit("/")), F.lit(2)), "^/+", "")
    listed = found.select(inner.alias("path"), F.col("length").alias("octets"), "content")
    folder = F.col("path").rlike(f"(?:^|/)(?:{'|'.join(f.replace('.', '[.]') for f in SKIPPED_FOLDERS)})/") & ~F.col("path").rlike(r"^node_modules/astro/package[.]json$|^dist/(?:client/)?_astro/")
    why = F.when(folder, "folder").when(~F.col("path").rlike(TEXT_NAMES), "kind").when(F.col("octets") > most, "size")
    passed = listed.select("path", "octets", why.alias("why")).filter("why IS NOT NULL")
    read = listed.filter(why.isNull()).select("path", "octets", "content")
    binary = F.contains(F.substring("content", 1, 8192), F.lit(b"\x00"))
    passed = passed.unionByName(read.filter(binary).select("path", "octets", F.lit("binary").alias("why")))
    texts = read.filter(~binary).select(F.lit(site).alias("site"), "path", F.try_validate_utf8("content").alias("text"))
    return texts.filter("text IS NOT NULL"), passed.select(F.lit(site).alias("site"), "path", "octets", "why")
