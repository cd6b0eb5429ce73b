"""Text and verdict expressions of the audit: tokens, masking, severities, grades."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The order of severities and the points that each takes off a score.
SEVERITIES = ("critique", "haute", "moyenne", "basse", "info")
POINTS = {"critique": 20, "haute": 10, "moyenne": 4, "basse": 1}
# Words of titles that say nothing about the page.
STOP_WORDS = ("les", "des", "une", "pour", "avec", "dans", "sur", "par", "est", "vos", "nos", "votre", "notre", "the", "and", "for", "you", "your", "comment", "qui", "que", "aux", "plus", "tout", "tous")
# Grades by least score.
GRADES = ((90, "A"), (75, "B"), (60, "C"), (40, "D"))
# Metric, good up to, poor beyond (milliseconds, but for the shift).
VITALS = (("lcp", 2500.0, 4000.0), ("inp", 200.0, 500.0), ("cls", 0.1, 0.25), ("fcp", 1800.0, 3000.0), ("ttfb", 800.0, 1800.0))
# Secrets that must not be shown.
SECRET_PATTERNS = (
    r"AKIA[0-9A-Z]{16}", r"(?:sk|pk|rk)_(?:live|test)_[0-9A-Za-z]{16,}", r"gh[pousr]_[0-9A-Za-z]{30,}", r"xox[baprs]-[0-9A-Za-z-]{10,}", r"AIza[0-9A-Za-z_-]{30,}",
    r"eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{5,}",
)


def rank(severity: Column) -> Column:
    """0 for the gravest; 9 for unknown words."""
    out = F.lit(9)
    for k, s in reversed(list(enumerate(SEVERITIES))):
        out = F.when(severity == s, F.lit(k)).otherwise(out)
    return out


def severity_of(rank_col: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), F.least(rank_col, F.lit(len(SEVERITIES) - 1)) + 1)


def title_tokens(text: Column) -> Column:
    """Distinct words of three letters or digits and more, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-zà-ÿ0-9]{3,}"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOP_WORDS)))


def masked(text: Column) -> Column:
    """Known secrets, and values that names call secret, as a mark."""
    out = F.regexp_replace(text, "|".join(SECRET_PATTERNS), "***")
    out = F.regexp_replace(out, r"(?i)\b(bearer)\s+[0-9A-Za-z._~+/-]{8,}=*", "$1 ***")
    return F.regexp_replace(out, r"""(?i)\b(token|secret|password|passwd|api[_-]?key|access[_-]?key)("?\s*[=:]\s*"?)[^\s"'&,;]{4,}""", "$1$2***")


def one_line(text: Column, width: int = 300) -> Column:
    """Blanks folded, control characters dropped, secrets masked, cut at `width` with an ellipsis."""
    clean = masked(F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"\p{C}", "")))
    return F.when(F.length(clean) > width, F.concat(F.rtrim(F.substring(clean, 1, width - 1)), F.lit("…"))).otherwise(clean)


def example_text(parts: Column, width: int = 220) -> Column:
    """`k: v — k: v` of a map, cut at `width`."""
    pairs = F.transform(F.map_entries(parts), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.substring(F.array_join(pairs, " — "), 1, width)


def saving_severity(ms: Column, octets: Column) -> Column:
    ms, octets = F.coalesce(ms, F.lit(0)), F.coalesce(octets, F.lit(0))
    return F.when((ms >= 1000) | (octets >= 1_000_000), "haute").when((ms >= 300) | (octets >= 250_000), "moyenne").otherwise("basse")


def grade(score: Column) -> Column:
    out = F.lit("E")
    for least, letter in reversed(GRADES):
        out = F.when(score >= least, letter).otherwise(out)
    return F.when(score.isNotNull(), out)


def vitals_verdict(metric: Column, value: Column) -> Column:
    """bon, moyen or mauvais, bounds included."""
    out = F.lit(None).cast("string")
    for name, good, poor in VITALS:
        verdict = F.when(value <= good, "bon").when(value <= poor, "moyen").otherwise("mauvais")
        out = F.when((metric == name) & value.isNotNull(), verdict).otherwise(out)
    return out


def suspicious_alt(alt: Column) -> Column:
    """Why an image text says nothing: fichier, identifiant, generique, echappement; null where it may stand."""
    a = F.lower(F.trim(alt))
    return (
        F.when(a.rlike(r"\.(jpe?g|png|gif|webp|avif|svg)$"), "fichier")
        .when(a.rlike(r"^(img|dsc|image|photo)?[-_ ]?[0-9]{3,}$") | a.rlike(r"^[0-9a-f]{12,}$"), "identifiant")
        .when(a.isin("image", "photo", "logo", "picture", "icon", "icone", "icône", "img", "illustration", "untitled"), "generique")
        .when(a.rlike("&amp;(amp|quot|#[0-9]+);"), "echappement")
    )


def is_hashed_name(name: Column) -> Column:
    """A file name with a content hash: eight or more letters and digits of both kinds before the extension."""
    stem = F.regexp_extract(name, r"[.\-_]([A-Za-z0-9_-]{8,})\.[a-z0-9]+$", 1)
    return (stem != "") & stem.rlike("[0-9]") & stem.rlike("[A-Za-z]")


def max_age(cache_control: Column) -> Column:
    return F.regexp_extract(F.lower(cache_control), r"(?:^|[,\s])max-age=([0-9]{1,12})", 1).try_cast("bigint")


def is_uncached(cache_control: Column) -> Column:
    return F.coalesce(F.lower(cache_control).rlike("no-store") | (max_age(cache_control) == 0), F.lit(True))


def is_briefly_cached(cache_control: Column, least: int = 86_400) -> Column:
    """A maximal age under `least` seconds and not immutable."""
    return F.coalesce(~F.lower(cache_control).rlike("immutable") & (max_age(cache_control) < least), F.lit(False))


def is_versioned_path(path: Column) -> Column:
    """A path whose name changes with each version: in a folder of built files, or a name with a content hash. Eight lower-case
    letters may be a word and count as none; eight upper-case ones count."""
    stem = F.regexp_replace(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.map$", ""), r"\.[^.]*$", "")
    part = F.exists(F.slice(F.split(stem, r"\."), 2, 1000), lambda x: (F.length(x) >= 8) & x.rlike("[0-9]") & x.rlike("[A-Za-z]"))
    end = F.regexp_extract(stem, r"[.\-_]([A-Za-z0-9_-]{8})$", 1)
    mixed = end.rlike("[0-9]") & end.rlike("[A-Za-z]") | end.rlike("[a-z]") & end.rlike("^.+[A-Z]") | end.rlike("[A-Z]") & ~end.rlike("[a-z]") | end.rlike("[A-Za-z0-9][_-][A-Za-z0-9]")
    return path.rlike("/_astro/|/_next/static/") | part | ((end != "") & ~end.rlike(r"^[0-9]+[xX][0-9]+$") & mixed)


def fonts_without_display(css: Column) -> Column:
    """Families of @font-face blocks that lack font-display, or set it to block or auto; blocks that load only local fonts are fine."""
    found = F.regexp_extract_all(F.regexp_replace(css, r"(?s)/\*.*?\*/", ""), F.lit(r"(?i)(@font-face\s*\{[^}]*\})"), F.lit(1))
    late = lambda b: ~b.rlike(r"(?i)font-display\s*:") | b.rlike(r"(?i)font-display\s*:\s*(block|auto)\b")
    loads = lambda b: ~b.rlike(r"(?i)\blocal\(") | b.rlike(r"(?i)\burl\(")
    name = lambda b: F.regexp_replace(F.trim(F.regexp_extract(b, r"(?i)font-family\s*:\s*[\"']?([^;\"'}]+)", 1)), "-[0-9a-f]{16}$", "")
    return F.transform(F.filter(found, lambda b: late(b) & loads(b)), lambda b: F.coalesce(F.nullif(name(b), F.lit("")), F.lit("?")))


def octets(product: Column) -> Column:
    """Value of `10 * 1024 * 1024`; null if a factor is no whole number."""
    factors = F.transform(F.split(product, r"\*"), lambda x: F.trim(x).try_cast("bigint"))
    return F.aggregate(factors, F.lit(1).cast("bigint"), lambda a, x: a * x)


# Words that open a question.
QUESTION_WORDS = (
    "comment", "pourquoi", "quel", "quelle", "quels", "quelles", "qu['’]est", "combien", "où", "quand", "faut-il", "peut-on", "est-ce", "how", "what", "why", "which", "when", "where", "can", "does", "is",
)


def is_question(heading: Column) -> Column:
    return F.trim(heading).rlike(r"\?\s*$") | F.trim(heading).rlike(rf"(?iU)^({'|'.join(QUESTION_WORDS)})\b")


def max_snippet(directives: Column) -> Column:
    """True if snippets are limited to less than 160 characters (and not unlimited)."""
    n = F.regexp_extract(F.lower(directives), r"max-snippet\s*:\s*(-?[0-9]+)", 1).try_cast("int")
    return F.coalesce((n < 160) & (n != -1), F.lit(False))


def text_ratio(words: Column, octets_html: Column) -> Column:
    return F.when(octets_html > 0, F.round(words * 6 / octets_html, 3))


def audit_date(name: Column) -> Column:
    """Date in a folder name or a log line, if it is one."""
    return F.regexp_extract(name, r"(20[0-9]{2}-[0-9]{2}-[0-9]{2})", 1).try_cast("date")


MONTHS = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")


def long_date(day: Column) -> Column:
    """`1er mars 2026`."""
    d = F.when(F.dayofmonth(day) == 1, F.lit("1er")).otherwise(F.dayofmonth(day).cast("string"))
    whole = F.concat_ws(" ", d, F.element_at(F.array(*map(F.lit, MONTHS)), F.month(day)), F.year(day).cast("string"))
    return F.when(day.isNotNull(), whole)


def short_date(day: Column) -> Column:
    return F.date_format(day, "dd/MM/yy")


def directives(policy: Column) -> Column:
    """Content security policy as map directive -> sources in lower case; the first of equal directives wins."""
    parts = F.filter(F.transform(F.split(F.lower(policy), ";"), lambda p: F.regexp_replace(F.trim(p), r"\s+", " ")), lambda p: p != "")
    names = F.transform(parts, lambda p: F.split_part(p, F.lit(" "), F.lit(1)))
    first = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_position(names, F.element_at(names, i.cast("int"))) == i)
    entries = F.transform(first, lambda i: F.struct(F.element_at(names, i.cast("int")), F.slice(F.split(F.element_at(parts, i.cast("int")), " "), 2, 100_000)))
    return F.when(F.size(parts) > 0, F.map_from_entries(entries))


@F.pandas_udf(StringType())
def folded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC, apostrophes alike, case folded, marks and symbols as blanks. Spark has no normalisation forms, hence the UDF."""
    import unicodedata

    def one(t):
        if t is None:
            return None
        plain = unicodedata.normalize("NFKC", t).replace("\u2019", "'").replace("\u02bc", "'")
        return " ".join("".join(" " if unicodedata.category(c)[0] in "PSC" else c for c in plain).casefold().split())

    for t in texts:
        yield t.map(one)


@F.pandas_udf(StringType())
def ascii_host(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A host name in its ASCII form, lower case, without a closing dot; null if it has none."""

    def one(n):
        try:
            return None if n is None else n.strip().rstrip(".").lower().encode("idna").decode() or None
        except UnicodeError:
            return None

    for n in names:
        yield n.map(one)


def inline_code(value: Column) -> Column:
    """Markdown code span that holds the value, back-ticks included."""
    fence = F.when(F.contains(value, F.lit("`")), F.lit("`` ")).otherwise(F.lit("`"))
    return F.concat(fence, F.regexp_replace(value, r"\s+", " "), F.reverse(fence))


def escaped_prose(value: Column) -> Column:
    """Text with Markdown and HTML marks escaped."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "&", "&amp;"), "<", "&lt;"), r"([\\`*_\[\]|#])", r"\\$1")
