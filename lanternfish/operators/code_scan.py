"""Source-code findings over a table of files (site, path, text): line rules, file rules, and rules of absence.

Comments are blanked first; line rules keep the line number. Rules of absence need the whole tree, so they run per site over
flags that are summed up before the exchange, and only for sites that are marked complete.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from lanternfish.functions import javascript

#: key, severity, file pattern, line pattern.
LINE_RULES = (
    ("client_load", "moyenne", r"^src/.*\.(astro|[jt]sx?|mjs|svelte|vue|mdx?)$", r"\bclient:load\b"),
    ("client_only", "basse", r"^src/.*\.(astro|[jt]sx?|mjs|svelte|vue|mdx?)$", r"\bclient:only\b"),
    ("img_brute", "moyenne", r"^src/.*\.(astro|[jt]sx|svelte|vue|mdx)$", r"(?i)<img\b"),
    ("env_public_secret", "critique", r"\.(astro|[jt]sx?|mjs)$", r"PUBLIC_[A-Z_]*(SECRET|TOKEN|PASSWORD|PRIVATE)"),
    ("polices_google", "moyenne", r"^src/.*\.(astro|[jt]sx?|mjs|svelte|vue|mdx?)$", r"fonts\.(googleapis|gstatic)\.com"),
    ("tiers_charges", "info", r"^src/.*\.(astro|[jt]sx?|mjs|svelte|vue|mdx?)$", r"(?i)googletagmanager|google-analytics|gtag\(|connect\.facebook|fbq\(|hotjar|clarity\.ms|intercom|crisp\.chat|tawk\.to|hs-scripts|linkedin\.com/insight|tiktok|calendly|youtube\.com/embed|player\.vimeo"),
    ("validateur_any", "basse", r"^convex/.*\.[jt]s$", r"\bv\.any\(\)"),
    ("console", "info", r"\.(astro|[jt]sx?|mjs)$", r"\bconsole\.(log|debug)\("),
)
#: key, severity, and the pattern of a path that a complete tree must have.
REQUIRED_FILES = (
    ("page_404_absente", "moyenne", r"^src/pages/404\.(astro|md|mdx)$"), ("robots_absent", "moyenne", r"^public/robots\.txt$|^src/pages/.*robots[^/]*\.[jt]s$"), ("favicon_absente", "basse", r"^public/favicon\.(ico|svg|png)$"),
    ("llms_absent", "basse", r"^public/llms\.txt$|^src/pages/.*llms[^/]*\.[jt]s$"), ("lockfile_absent", "moyenne", r"^(package-lock\.json|pnpm-lock\.yaml|yarn\.lock|bun\.lockb?)$"), ("package_absent", "haute", r"^package\.json$"),
)
#: Category of the keys above; the others are `code`.
CATEGORIES = {
    "client_load": "performance", "client_only": "seo", "img_brute": "performance", "env_public_secret": "securite", "polices_google": "performance", "tiers_charges": "performance", "validateur_any": "securite",
    "page_404_absente": "seo", "robots_absent": "seo", "favicon_absente": "seo", "llms_absent": "geo", "lockfile_absent": "projet", "package_absent": "projet", "env_suivi": "securite", "env_non_ignore": "securite",
}
MOST_BYTES = 1_500_000


@F.pandas_udf(StringType())
def _marked_up(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Components without comments, lines kept. Their prose would mislead a lexer of code, so this one pattern of strings and
    comments does."""
    import re

    both = re.compile(r"""("(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(//[^\n]*|/\*.*?(?:\*/|\Z))""", re.S)
    blank = lambda m: m.group(1) if m.group(1) is not None else re.sub(r"[^\n]", " ", m.group(2))
    for t in texts:
        yield t.map(lambda x: None if x is None else both.sub(blank, x))


def without_comments(text: Column, path: Column) -> Column:
    """Sources without comments, lines kept: scripts by the lexer, components by a pattern. A row goes to one of the two; the other
    gets null for it."""
    script = path.rlike(javascript.SCRIPTS)
    return F.coalesce(javascript.without_comments(F.when(script, text), path), _marked_up(F.when(~script, text)))


# Folders of builds and dependencies.
LEFT_OUT = r"(^|/)(node_modules|\.git|dist|\.astro|\.vercel|\.netlify|\.output|_generated|\.turbo|\.cache|coverage|\.next)/"


def in_tree() -> Column:
    return ~F.col("path").rlike(LEFT_OUT)


def is_text() -> Column:
    return (F.octet_length("text") <= MOST_BYTES) & ~F.contains(F.substring("text", 1, 8192), F.lit("\x00"))


def readable(files: DataFrame) -> DataFrame:
    """Text files of at most MOST_BYTES bytes without NUL near their start, outside build and dependency folders."""
    return files.filter(in_tree() & is_text())


def line_findings(files: DataFrame, rules=LINE_RULES) -> DataFrame:
    """site, key, severity, path, line, excerpt (160 characters)."""
    some = F.lit(False)
    for _, _, of, _ in rules:
        some = some | F.col("path").rlike(of)
    each = readable(files).filter(some).select("site", "path", F.posexplode(F.split(without_comments(F.col("text"), F.col("path")), "\n")).alias("n", "line"))
    hit = [F.when(F.col("path").rlike(of) & F.col("line").rlike(rx), F.struct(F.lit(k).alias("key"), F.lit(s).alias("severity"))) for k, s, of, rx in rules]
    found = each.select("site", "path", (F.col("n") + 1).alias("line_no"), F.substring(F.trim("line"), 1, 160).alias("excerpt"), F.explode(F.array_compact(F.array(*hit))).alias("f"))
    return found.select("site", "f.key", "f.severity", "path", "line_no", "excerpt")


def absences(files: DataFrame, complete: DataFrame) -> DataFrame:
    """site, key, severity of required files that a complete tree lacks. complete: site."""
    flags = files.groupBy("site").agg(*[F.bool_or(F.col("path").rlike(rx)).alias(k) for k, _, rx in REQUIRED_FILES])
    hit = [F.when(~F.col(k), F.struct(F.lit(k).alias("key"), F.lit(s).alias("severity"))) for k, s, _ in REQUIRED_FILES]
    return flags.join(complete, "site", "left_semi").select("site", F.explode(F.array_compact(F.array(*hit))).alias("f")).select("site", "f.key", "f.severity")


def hydration(files: DataFrame) -> DataFrame:
    """site, directive, n of client:* directives."""
    found = F.explode(F.regexp_extract_all("text", F.lit(r"\bclient:(load|idle|visible|media|only)\b"), F.lit(1)))
    return readable(files).filter(F.col("path").rlike(r"\.(astro|mdx)$")).select("site", found.alias("directive")).groupBy("site", "directive").agg(F.count("*").alias("n"))


@F.pandas_udf(LongType())
def packed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compressed size."""
    import gzip

    for t in texts:
        yield t.map(lambda x: len(gzip.compress((x or "").encode(), 6, mtime=0)))


def bundle_sizes(files: DataFrame, top: int = 15) -> DataFrame:
    """site, ext, octets, largest, heaviest: compressed sizes by extension, and the paths of the `top` largest files in order."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    sized = files.select("site", ext.alias("ext"), "path", packed("text").alias("size"))
    ranked = sized.withColumn("place", F.row_number().over(Window.partitionBy("site", "ext").orderBy(F.desc("size"), "path"))).filter(F.col("place") <= top)
    heaviest = ranked.groupBy("site", "ext").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("heaviest"))
    return sized.groupBy("site", "ext").agg(F.sum("size").alias("octets"), F.max("size").alias("largest")).join(heaviest, ["site", "ext"])


def tracked_secrets(files: DataFrame) -> DataFrame:
    """site, key, severity: a tracked .env, or one that .gitignore does not name."""
    env, ignore = F.col("path").rlike(r"(^|/)\.env(\.local|\.production)?$"), F.col("path") == ".gitignore"
    f = files.groupBy("site").agg(F.bool_or(env).alias("tracked"), F.coalesce(F.bool_or(ignore & F.col("text").rlike(r"(?m)^/?\.env")), F.lit(False)).alias("ignored"))
    found = F.array(F.when(F.col("tracked"), F.struct(F.lit("env_suivi").alias("key"), F.lit("critique").alias("severity"))), F.when(~F.col("ignored"), F.struct(F.lit("env_non_ignore").alias("key"), F.lit("haute").alias("severity"))))
    return f.select("site", F.explode(F.array_compact(found)).alias("f")).select("site", "f.key", "f.severity")
