"""From findings to signals, and from signals to a correction plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.functions import text

SIGNAL = "site string, source string, key string, severity string, domain string, text string, examples array<string>, seq bigint"
EFFORTS = ("S", "M", "L")


def union_all(*sources: DataFrame) -> DataFrame:
    """Signals of all sources; columns that one lacks are null."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def from_issues(issues: DataFrame, source: str, domain: str) -> DataFrame:
    """Issues as signals with at most five examples. issues: site, key, severity, count, examples (joined by blanks)."""
    return issues.select(
        "site", F.lit(source).alias("source"), "key", "severity", F.lit(domain).alias("domain"), F.concat("key", F.lit(" ("), F.col("count").cast("string"), F.lit(")")).alias("text"),
        F.slice(F.split("examples", " "), 1, 5).alias("examples"), F.xxhash64("key").alias("seq"),
    )


def from_lines(lines: DataFrame, source: str, domain: str) -> DataFrame:
    """Signals from report lines: ❌ is haute; ⚠️ is basse in table rows and list items, but not in headings or beside ✅.

    Lines that say `mode test` are left out. lines: site, pos, line.
    """
    line = F.col("line")
    bad, warn = F.contains(line, F.lit("❌")), F.contains(line, F.lit("⚠️"))
    row, item = F.trim(line).startswith("|"), F.trim(line).rlike(r"^[-*] ")
    severity = F.when(bad, "haute").when(warn & (row | (item & ~F.contains(line, F.lit("✅")))) & ~F.trim(line).startswith("#"), "basse")
    body = text.one_line(F.trim(F.regexp_replace(F.regexp_replace(line, r"[❌⚠️✅]", ""), r"^\s*[|*-]\s*|\s*\|\s*$", "")))
    rows = lines.filter(~F.contains(F.lower(line), F.lit("mode test"))).select("site", F.lit(source).alias("source"), severity.alias("severity"), F.lit(domain).alias("domain"), body.alias("text"), F.col("pos").cast("bigint").alias("seq"))
    return rows.filter("severity IS NOT NULL").withColumn("key", F.regexp_replace(F.lower("text"), r"[^a-z0-9]+", "_"))


# Domains of signals by source or category, severities of vulnerabilities, domains that an issue may name itself.
ISSUE_DOMAINS = {"crawl": "SEO technique", "rendu": "Accessibilité", "domaine": "Sécurité", "terrain": "Performance"}
CODE_DOMAINS = {"performance": "Performance", "seo": "SEO technique", "securite": "Sécurité", "accessibilite": "Accessibilité", "geo": "GEO / IA", "projet": "Code", "config": "Code"}
AUDIT_DOMAINS = {"accessibility": "Accessibilité", "seo": "SEO technique"}
VULNERABILITIES = {"- **critical**": "critique", "- **high**": "haute", "- **moderate**": "moyenne"}
KNOWN_DOMAINS = ("Performance", "Serveur / HTTP", "SEO technique", "Contenu", "GEO / IA", "Code", "Sécurité", "Accessibilité", "RGPD / traceurs", "Bonnes pratiques")
LONGEST_TEXT, RUN_SHARE, SHOWN_EXAMPLES, SHOWN_PACKAGES = 220, 6, 5, 10


def _chosen(of: dict[str, str], c: str, otherwise: str) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in of.items() for x in pair))[F.col(c)], F.lit(otherwise))


_NONE = "cast(array() AS array<string>)"


def from_audits(found: DataFrame) -> DataFrame:
    """Signals of sources that report issues. found: site, source, key, label, severity, domain (null: the source's), count, examples
    array<string>, seq."""
    domain = F.when(F.col("domain").isin(*KNOWN_DOMAINS), F.col("domain")).otherwise(_chosen(ISSUE_DOMAINS, "source", "SEO technique"))
    return found.select("site", "source", "key", "severity", domain.alias("domain"), F.concat("label", F.lit(" — "), F.col("count").cast("string")).alias("text"), F.slice("examples", 1, SHOWN_EXAMPLES).alias("examples"), "seq")


def from_geo(found: DataFrame) -> DataFrame:
    """Signals of findings about answer engines: their text is their key. found: site, severity, text, seq."""
    return found.select("site", F.lit("geo").alias("source"), F.col("text").alias("key"), "severity", F.lit("GEO / IA").alias("domain"), "text", F.expr(_NONE).alias("examples"), "seq")


def from_code(found: DataFrame) -> DataFrame:
    """Signals of the code scan, with the way out after an arrow. found: site, severity, category, text, hint, places array<string>, seq."""
    hint = F.when(F.coalesce("hint", F.lit("")) != "", F.concat(F.lit(" → "), "hint")).otherwise(F.lit(""))
    return found.select("site", F.lit("code").alias("source"), F.col("text").alias("key"), "severity", _chosen(CODE_DOMAINS, "category", "Code").alias("domain"), F.concat("text", hint).alias("text"), F.slice("places", 1, SHOWN_EXAMPLES).alias("examples"), "seq")


def from_runs(runs: DataFrame) -> DataFrame:
    """Signals of saving opportunities, once for each id over the runs of a site; of each run only the first few are looked at. One
    without a gain counts only if it is an insight that failed. runs: site, run, strategy, pos, id, title, score, gain_ms, gain_octets."""
    ms, size = F.coalesce("gain_ms", F.lit(0)), F.coalesce("gain_octets", F.lit(0))
    failed = F.col("id").endswith("-insight") & F.coalesce(F.col("score") == 0, F.lit(False))
    kept = runs.filter((F.col("pos") < RUN_SHARE) & ((ms > 0) | (size > 0) | failed))
    first = kept.groupBy("site", "id").agg(F.min_by(F.struct("title", "strategy", "gain_ms", "gain_octets", "run", "pos"), F.struct("run", "pos")).alias("o")).select("site", "id", "o.*")
    gain = F.concat_ws(" + ", F.when(ms > 0, F.concat(ms.cast("string"), F.lit(" ms"))), F.when(size > 0, F.concat(F.floor(size / 1024).cast("string"), F.lit(" Ko"))))
    shown = F.when(gain != "", F.concat("title", F.lit(" (gain estimé "), gain, F.lit(", "), "strategy", F.lit(")"))).otherwise(F.concat("title", F.lit(" ("), "strategy", F.lit(")")))
    return first.select(
        "site", F.lit("lighthouse").alias("source"), F.concat_ws(" ", "id", "title").alias("key"), text.saving_severity(F.col("gain_ms"), F.col("gain_octets")).alias("severity"), F.lit("Performance").alias("domain"), shown.alias("text"),
        F.expr(_NONE).alias("examples"), (F.col("run") * 1000 + F.col("pos")).cast("bigint").alias("seq"),
    )


def from_failures(failures: DataFrame) -> DataFrame:
    """Signals of failed audits of other categories, once for each site, category and title. failures: site, run, category, pos, title."""
    once = failures.groupBy("site", "category", "title").agg(F.min(F.col("run") * 1000 + F.col("pos")).cast("bigint").alias("seq"))
    return once.select("site", F.lit("lighthouse").alias("source"), F.col("title").alias("key"), F.lit("moyenne").alias("severity"), _chosen(AUDIT_DOMAINS, "category", "Bonnes pratiques").alias("domain"), F.concat(F.lit("Lighthouse : "), "title").alias("text"), F.expr(_NONE).alias("examples"), "seq")


def from_project(lines: DataFrame) -> DataFrame:
    """Signals of a project report: marked lines and vulnerabilities one by one, packages a major version behind as one signal that
    names the first of them. lines: site, pos, line."""
    rows = lines.withColumn("line", F.trim("line"))
    late = F.col("line").startswith("|") & F.contains(F.col("line"), F.lit("⚠️ oui"))
    vulnerable = F.coalesce(*[F.when(F.col("line").startswith(k), F.lit(v)) for k, v in VULNERABILITIES.items()])
    severity = F.coalesce(vulnerable, F.when(F.contains(F.col("line"), F.lit("❌")), "haute").when(F.contains(F.col("line"), F.lit("⚠️")), "basse"))
    plain = F.substring(F.replace(F.replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("line", r"^[| ]+|[| ]+$", ""), "^[- ]+", ""), "[| ]+$", ""), F.lit(" | "), F.lit(" · ")), F.lit("**"), F.lit("")), 1, LONGEST_TEXT)
    each = rows.filter(~late & severity.isNotNull()).select("site", F.lit("projet").alias("source"), F.col("line").alias("key"), severity.alias("severity"), F.lit("Code").alias("domain"), plain.alias("text"), F.expr(_NONE).alias("examples"), F.col("pos").cast("bigint").alias("seq"))
    name = F.trim(F.split_part(F.regexp_replace("line", r"^[| ]+", ""), F.lit("|"), F.lit(1)))
    placed = rows.filter(late).select("site", "pos", name.alias("name"), F.replace(F.regexp_replace("line", r"^[| ]+|[| ]+$", ""), F.lit(" | "), F.lit(" · ")).alias("row"))
    top = placed.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("pos")))
    counted = placed.groupBy("site").agg(F.count("*").alias("all"), F.max("pos").cast("bigint").alias("seq"))
    shown = top.filter(F.col("n") <= SHOWN_PACKAGES).groupBy("site").agg(F.array_sort(F.collect_list(F.struct("n", "name", "row"))).alias("s")).join(counted, "site")
    rest = F.col("all") - SHOWN_PACKAGES
    more = F.when(rest > 0, F.concat(F.lit(", … et "), rest.cast("string"), F.lit(" autres"))).otherwise(F.lit(""))
    names = F.array_join("s.name", ", ")
    examples = F.concat(F.col("s.row"), F.when(rest > 0, F.array(F.concat(F.lit("… et "), rest.cast("string"), F.lit(" autres")))).otherwise(F.expr(_NONE)))
    behind = shown.select(
        "site", F.lit("projet").alias("source"), F.concat(F.lit("dépendances obsolètes saut majeur : "), names).alias("key"), F.lit("basse").alias("severity"), F.lit("Code").alias("domain"),
        F.concat(F.col("all").cast("string"), F.lit(" dépendance(s) avec saut de version majeure : "), names, more).alias("text"), examples.alias("examples"), F.col("seq"),
    )
    return each.unionByName(behind)


def index_rows(plan: DataFrame, hits: DataFrame, missed: DataFrame, sheets: DataFrame, triggers: DataFrame) -> DataFrame:
    """site, part, place, entry (JSON) of the index of a correction plan: `corrections` with their signals, `sans_fiche` the signals that
    no sheet answers, and `sans_detection` the sheets that nothing triggers (for all sites: site is null). An entry is a row, so no
    site's index is put together in one place; the signals of one correction are those of its own triggers."""
    signal = F.struct(F.col("text").alias("texte"), "source", F.col("key").alias("cle"))
    of = hits.groupBy("site", "sheet_id").agg(F.array_sort(F.collect_set(signal)).alias("signaux"))
    done = plan.join(of, ["site", "sheet_id"]).select("site", F.lit("corrections").alias("part"), F.col("rank").alias("place"), F.to_json(F.struct(F.col("rank").alias("num"), F.col("sheet_id").alias("id"), F.col("title").alias("titre"), F.col("domain").alias("domaine"), F.col("severity").alias("severite"), F.col("effort"), "signaux")).alias("entry"))
    left = missed.select("site", F.lit("sans_fiche").alias("part"), F.concat_ws(" ", text.rank(F.col("severity")).cast("string"), "domain", "source", "key").alias("place"), F.to_json(F.struct(F.col("text").alias("texte"), "source", F.col("key").alias("cle"), F.col("severity").alias("severite"), F.col("domain").alias("domaine"), F.col("examples").alias("exemples"))).alias("entry"))
    idle = undetected(sheets, triggers).select(F.lit(None).cast("string").alias("site"), F.lit("sans_detection").alias("part"), F.col("sheet_id").alias("place"), F.to_json(F.struct(F.col("sheet_id").alias("id"), F.col("title").alias("titre"))).alias("entry"))
    return done.unionByName(left).unionByName(idle)


def ranked(signals: DataFrame) -> DataFrame:
    """Signals with `place`: by severity, then domain, then order of arrival, for each site."""
    w = Window.partitionBy("site").orderBy(text.rank(F.col("severity")), "domain", "source", "seq", "key")
    return signals.withColumn("place", F.row_number().over(w))


def opportunities(runs: DataFrame, per_run: int = 6) -> DataFrame:
    """Saving opportunities once each over all runs, the first run's; of each run the `per_run` weightiest.

    runs: site, run, id, title, gain_ms, gain_octets, weight.
    """
    weight = F.coalesce("gain_ms", F.lit(0)) + F.coalesce("weight", F.lit(0)) + F.coalesce("gain_octets", F.lit(0)) / 10_000
    top = runs.withColumn("w", weight).withColumn("pos", F.row_number().over(Window.partitionBy("site", "run").orderBy(F.desc("w"), "id"))).filter(F.col("pos") <= per_run)
    once = top.withColumn("r", F.row_number().over(Window.partitionBy("site", "id").orderBy("run", "pos"))).filter("r = 1")
    return once.select("site", "id", "title", "run", "pos", text.saving_severity(F.col("gain_ms"), F.col("gain_octets")).alias("severity"))


def outdated(packages: DataFrame, shown: int = 10) -> DataFrame:
    """One signal for all packages a major version behind: some names and `+ N autres`. packages: site, name, current, latest."""
    major = lambda c: F.regexp_extract(c, r"^[^0-9]*([0-9]+)", 1).try_cast("int")
    late = packages.filter(major("latest") > major("current")).withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy("name")))
    out = late.groupBy("site").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("place") <= shown, F.col("name")))).alias("names"))
    rest = F.when(F.col("n") > shown, F.concat(F.lit(" + "), (F.col("n") - shown).cast("string"), F.lit(" autres"))).otherwise(F.lit(""))
    return out.select("site", "n", F.concat(F.array_join("names", ", "), rest).alias("text"))


def matched(signals: DataFrame, triggers: DataFrame) -> DataFrame:
    """Signals with the sheets that they call for. triggers: sheet_id, source, pattern.

    Crawl keys must equal the pattern (an equi-join); keys and texts of other sources are searched by regular expression, case
    aside, among the triggers of the same source, so this join has a key as well.
    """
    t = triggers.select("sheet_id", F.col("source").alias("t_source"), "pattern")
    exact = signals.filter("source = 'crawl'").join(t, (F.col("source") == F.col("t_source")) & (F.col("key") == F.col("pattern")))
    found = F.expr("key rlike concat('(?i)', pattern) OR text rlike concat('(?i)', pattern)")
    searched = signals.filter("source <> 'crawl'").join(t, (F.col("source") == F.col("t_source")) & found)
    return exact.unionByName(searched).drop("t_source", "pattern").distinct()


def unmatched(signals: DataFrame, hits: DataFrame) -> DataFrame:
    return signals.join(hits.select("site", "source", "key").distinct(), ["site", "source", "key"], "left_anti")


def corrections(hits: DataFrame, sheets: DataFrame) -> DataFrame:
    """site, rank (zero-padded), sheet_id, title, severity, effort, domain, n_signals.

    The severity is the gravest of the signals, or the sheet's own if that is critique; order: severity, effort, domain, id.
    """
    n = hits.groupBy("site", "sheet_id").agg(F.min(text.rank(F.col("severity"))).alias("r"), F.countDistinct("source", "key").alias("n_signals"))
    c = n.join(sheets.select("sheet_id", "title", F.col("domain").alias("sheet_domain"), "sheet_severity", "effort"), "sheet_id")
    c = c.withColumn("r", F.when(F.col("sheet_severity") == "critique", 0).otherwise(F.col("r")))
    effort = F.array_position(F.array(*map(F.lit, EFFORTS)), F.col("effort"))
    w = Window.partitionBy("site")
    c = c.withColumn("place", F.row_number().over(w.orderBy("r", effort, "sheet_domain", "sheet_id"))).withColumn("n", F.count("*").over(w))
    rank = F.lpad(F.col("place").cast("string"), F.when(F.col("n") > 99, 3).otherwise(2), F.lit("0"))
    return c.select("site", rank.alias("rank"), "sheet_id", "title", text.severity_of(F.col("r")).alias("severity"), "effort", F.col("sheet_domain").alias("domain"), "n_signals")


def undetected(sheets: DataFrame, triggers: DataFrame) -> DataFrame:
    """Sheets without a trigger: to be checked by hand."""
    return sheets.join(triggers.select("sheet_id").distinct(), "sheet_id", "left_anti")


def linked_corrections(signals: DataFrame, hits: DataFrame) -> DataFrame:
    """Report rows with the sheets of their sanitised (source, key)."""
    clean = lambda c: F.regexp_replace(F.lower(c), r"[^a-z0-9_-]+", "-")
    h = hits.select("site", F.col("source").alias("h_source"), clean("key").alias("h_key"), "sheet_id").distinct()
    s = signals.withColumn("clean_key", clean("key"))
    on = (s["site"] == h["site"]) & (F.col("source") == F.col("h_source")) & (F.col("clean_key") == F.col("h_key"))
    return s.join(h, on, "left").select(s["site"], "source", "key", "sheet_id")


def cautions(plan: DataFrame) -> DataFrame:
    """Notes of care for corrections by domain, severity and commands in the sheet. plan: …, domain, severity, body."""
    notes = F.array(
        F.when(F.col("domain") == "Sécurité", F.lit("tester en préproduction")), F.when(F.col("severity") == "critique", F.lit("relire à deux")),
        F.when(F.lower("body").rlike(r"\b(rm -rf|drop table|force|--hard|delete)\b"), F.lit("commande destructrice")),
    )
    return plan.withColumn("cautions", F.array_compact(notes))


def detected(truth: DataFrame, signals: DataFrame) -> DataFrame:
    """truth with `detected`: key equality for crawl_issue, search in the text else, by source. truth: id, domain, type, source, pattern."""
    exact = truth.filter("type = 'crawl_issue'").join(signals.select("key").distinct(), F.col("pattern") == F.col("key"), "left_semi").select("id")
    s = signals.select(F.col("source").alias("s_source"), "text").distinct()
    found = truth.filter("type <> 'crawl_issue'").join(s, (F.col("source") == F.col("s_source")) & F.expr("text rlike concat('(?i)', pattern)"), "left_semi").select("id")
    return truth.join(exact.unionByName(found).withColumn("detected", F.lit(True)), "id", "left").fillna(False, ["detected"])
