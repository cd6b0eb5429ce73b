"""Readers of report files, sitemaps, summaries and sheets, and the writers of results. Paths are anything that Spark can open."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the page export, in order.
PAGE_COLUMNS = (
    "url", "final_status", "redirect_hops", "depth", "inlinks", "in_sitemap", "indexable", "noindex", "canonical", "title", "title_length", "meta_description", "h1", "n_h1", "words", "content_words", "lang", "viewport",
    "og_title", "og_image", "n_jsonld", "imgs_no_alt", "imgs_no_dims", "ttfb", "bytes_html", "segment",
)


def lines(spark: SparkSession, path: str, site: str) -> DataFrame:
    """site, pos, line of text files; pos orders the lines of a file."""
    return spark.read.text(path, wholetext=True).select(F.lit(site).alias("site"), F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))


def tolerant_json(texts: DataFrame, column: str, schema: str) -> DataFrame:
    """texts with `parsed`; null where the JSON cannot be read."""
    return texts.withColumn("parsed", F.from_json(column, schema, {"mode": "PERMISSIVE"}))


_SITEMAP = "url array<struct<loc: string, lastmod: string>>, sitemap array<struct<loc: string, lastmod: string>>"


def sitemap(texts: DataFrame) -> DataFrame:
    """site, url, lastmod, is_index of sitemap documents (site, xml), read by Spark's XML parser: entities and CDATA are decoded and
    namespaces do not matter; broken documents give no rows."""
    doc = texts.select("site", F.from_xml(F.trim(F.regexp_replace("xml", r"^\x{FEFF}", "")), _SITEMAP, {"ignoreNamespace": "true", "mode": "PERMISSIVE"}).alias("d"))
    of = lambda name, index: F.transform(F.coalesce(F.col("d")[name], F.array().cast("array<struct<loc: string, lastmod: string>>")), lambda x: F.struct(F.trim(x["loc"]).alias("url"), F.nullif(F.trim(x["lastmod"]), F.lit("")).alias("lastmod"), F.lit(index).alias("is_index")))
    return doc.select("site", F.inline(F.concat(of("url", False), of("sitemap", True)))).filter("url <> ''")


def sitemaps(start: DataFrame, documents: DataFrame) -> DataFrame:
    """All page urls below start maps (site, url), following index files of any depth through `documents` (site, url, xml); a file
    that names itself, or one read before, is not read again."""
    from lanternfish.plans.tables import stored

    at, read, out = start.select("site", "url").distinct(), None, None
    while not at.isEmpty():
        read = at if read is None else read.unionByName(at)
        found = stored(sitemap(documents.join(at, ["site", "url"], "left_semi").select("site", "xml")), "sitemaps")
        pages = found.filter("NOT is_index").drop("is_index")
        out = pages if out is None else out.unionByName(pages)
        at = stored(found.filter("is_index").select("site", "url").distinct().join(read, ["site", "url"], "left_anti"), "sitemap-frontier")
    return sitemap(documents.limit(0)).drop("is_index") if out is None else out.distinct()


def suffix_rules(texts: DataFrame) -> DataFrame:
    """rule, kind (plain, wildcard, exception; without its marks), private of public suffix lists (name, text).

    Comments begin with `//`; those that open and close the private section set `private`. Rules stand in lower case and ASCII;
    what has no such form is left out. Of equal rules the last one holds. The lines of one list are put in order by a window.
    """
    from pyspark.sql import Window

    from lanternfish.functions.text import ascii_host

    each = texts.select("name", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    mark = F.when(F.contains("line", F.lit("===BEGIN PRIVATE DOMAINS===")), True).when(F.contains("line", F.lit("===END PRIVATE DOMAINS===")), False)
    mark = F.when(F.col("line").startswith("//"), mark)
    told = each.withColumn("private", F.coalesce(F.last(mark, ignorenulls=True).over(Window.partitionBy("name").orderBy("pos")), F.lit(False)))
    rules = told.filter("line <> '' AND NOT startswith(line, '//')").withColumn("raw", F.lower(F.regexp_extract("line", r"^(\S+)", 1)))
    kind = F.when(F.col("raw").startswith("!"), "exception").when(F.col("raw").startswith("*."), "wildcard").otherwise("plain")
    clean = rules.select("name", "pos", "private", kind.alias("kind"), ascii_host(F.regexp_replace("raw", r"^(!|\*\.)", "")).alias("rule")).filter("rule IS NOT NULL")
    return clean.groupBy("rule", "kind").agg(F.max_by("private", F.struct("name", "pos")).alias("private"))


def lighthouse(reports: DataFrame) -> DataFrame:
    """site, run, id, title, score, gain_ms, gain_octets, failed of every audit in Lighthouse reports (site, run, json).

    An audit fails with a score of 0 if it is binary, under 0.9 if numeric.
    """
    audit = "struct<id: string, title: string, score: double, scoreDisplayMode: string, details: struct<overallSavingsMs: double, overallSavingsBytes: double>>"
    rows = reports.select("site", "run", F.from_json(F.get_json_object("json", "$.audits"), f"map<string, {audit}>").alias("a"))
    each = rows.select("site", "run", F.explode(F.map_values("a")).alias("x")).select("site", "run", "x.*")
    failed = F.when(F.col("scoreDisplayMode") == "binary", F.col("score") == 0).when(F.col("scoreDisplayMode").isin("numeric", "metricSavings"), F.col("score") < 0.9).otherwise(False)
    return each.select("site", "run", "id", "title", "score", F.col("details.overallSavingsMs").alias("gain_ms"), F.col("details.overallSavingsBytes").alias("gain_octets"), F.coalesce(failed, F.lit(False)).alias("failed"))


def lighthouse_scores(reports: DataFrame) -> DataFrame:
    """site, run, category, score (0 to 100)."""
    rows = reports.select("site", "run", F.from_json(F.get_json_object("json", "$.categories"), "map<string, struct<score: double>>").alias("c"))
    return rows.select("site", "run", F.explode("c").alias("category", "s")).select("site", "run", "category", F.round(F.col("s.score") * 100).cast("int").alias("score"))


def sheets(texts: DataFrame) -> DataFrame:
    """name, fields (front matter as a map), triggers (its list of `source: pattern`), body of sheets (name, text)."""
    head = F.regexp_extract("text", r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    pairs = F.filter(F.split(head, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_]+:"))
    entry = lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)), F.regexp_replace(F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1)), r"^[\"']|[\"']$", ""))
    listed = F.regexp_extract_all(head, F.lit(r"(?m)^\s+-\s+(.+?)\s*$"), F.lit(1))
    return texts.select("name", F.map_from_entries(F.transform(pairs, entry)).alias("fields"), listed.alias("triggers"), F.regexp_replace("text", r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", "").alias("body"))


def package_findings(files: DataFrame, known: DataFrame) -> DataFrame:
    """site, name, current, latest of dependencies in package.json files (site, text) that have a later version. known: name, latest."""
    both = F.map_concat(*[F.coalesce(F.from_json(F.get_json_object("text", f"$.{k}"), "map<string,string>"), F.create_map().cast("map<string,string>")) for k in ("dependencies",)])
    return files.select("site", F.explode(both).alias("name", "current")).join(known, "name")


def write_pages(records: DataFrame, path: str) -> None:
    """The page export: fixed columns, headings joined by ` | `, headed CSV."""
    from lanternfish.functions import urls
    from lanternfish.operators.issues import judged

    rows = judged(records).withColumns({"title_length": F.length("title"), "segment": urls.segment(F.col("url")), "h1": F.concat_ws(" | ", "h1"), "url": urls.public_url(F.col("url"))})
    rows.select(*PAGE_COLUMNS).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def summary(issues: DataFrame, most: int = 200) -> str:
    """Markdown of the gravest issues: at most `most` lines reach the driver."""
    from lanternfish.functions.text import rank

    rows = issues.orderBy(rank(F.col("severity")), F.desc("count"), "site", "key").limit(most).collect()
    return "\n".join(["| site | règle | sévérité | nombre |", "|-|-|-|-|", *(f"| {r['site']} | {r['key']} | {r['severity']} | {r['count']} |" for r in rows)]) + "\n"


def write_corrections(plan: DataFrame, path: str) -> None:
    """The correction plan as one JSON object for each correction, in folders by site."""
    plan.write.mode("overwrite").partitionBy("site").json(path)


def raw_report(signals: DataFrame, site: str, most: int = 1000) -> str:
    """Markdown of one site's signals by severity: counts, then at most `most` lines."""
    from lanternfish.operators.findings import ranked

    rows = signals.filter(F.col("site") == site)
    counts = {r["severity"]: r["count"] for r in rows.groupBy("severity").count().collect()}
    shown = ranked(rows).filter(F.col("place") <= most).orderBy("place").select("severity", "domain", "text").collect()
    head = ", ".join(f"{s} {n}" for s, n in sorted(counts.items(), key=lambda x: x[0]))
    return "\n".join([f"# {site}", "", head, "", *(f"- **{r['severity']}** [{r['domain']}] {r['text']}" for r in shown)]) + "\n"
