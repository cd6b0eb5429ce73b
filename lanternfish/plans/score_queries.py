"""Registered queries over signals, scores, histories and texts, each with its SQL.

The reference work has no tables of this shape among the driver's, so audits, field values and savings are read from `events`,
`lineitem` and `part` by the rules stated at each input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.functions import text, urls
from lanternfish.operators import domain, findings, history, issues, reports, scores
from lanternfish.plans.page_queries import HOST, JUDGED, RECORDS, VIOLATIONS, _f, pages_of, records_of

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Signals: crawl violations, by domain of the key.
DOMAINS = {"title_short": "SEO technique", "param_indexable": "Indexation", "thin_content": "Contenu", "no_jsonld": "Données structurées", "viewport_missing": "Accessibilité", "og_image_absent": "GEO", "canonical_missing": "Maillage"}
_DOMAIN_SQL = "CASE key " + " ".join(f"WHEN '{k}' THEN '{d}'" for k, d in DOMAINS.items()) + " ELSE 'Sécurité' END"
_COUNTS_SQL = "CASE domain " + " ".join(f"WHEN '{k}' THEN '{d}'" for k, d in scores.COUNTS_WITH.items()) + " ELSE domain END"
_WEIGHT_SQL = "CASE domain " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in scores.WEIGHTS.items()) + " END"
SIGNALS = f"WITH {RECORDS}, {JUDGED}, {VIOLATIONS}, sig AS (SELECT DISTINCT site, 'crawl' AS source, key, severity, {_DOMAIN_SQL} AS domain, key AS text FROM vio)"
COUNTS = ", ".join(f"(count(*) FILTER (severity = '{s}'))::BIGINT AS {s}" for s in text.SEVERITIES)
SCORES = f""", dom AS (SELECT *, greatest(0, 100 - 20 * critique - 10 * haute - 4 * moyenne - basse)::BIGINT AS score FROM (
    SELECT site, {_COUNTS_SQL} AS domain, {COUNTS} FROM (SELECT site, domain, severity FROM sig UNION ALL SELECT DISTINCT site, 'Performance', NULL FROM sig) GROUP BY 1, 2))"""


def signals_of(spark, sf_dir) -> DataFrame:
    """A signal for each rule that a site breaks."""
    v = issues.violations(records_of(spark, sf_dir)).select("site", "key", "severity").distinct()
    of = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in DOMAINS.items() for x in p]), F.col("key")), F.lit("Sécurité"))
    return v.select("site", F.lit("crawl").alias("source"), "key", "severity", of.alias("domain"), F.col("key").alias("text"), F.lit(0).cast("long").alias("seq"))


def _scores(spark, sf_dir) -> DataFrame:
    s = signals_of(spark, sf_dir)
    return scores.domain_scores(s, s.select("site").distinct().withColumn("domain", F.lit("Performance")))


@query("domain_scores", SIGNALS + SCORES + " SELECT * FROM dom")
def domain_scores(spark, sf_dir):
    return _scores(spark, sf_dir)


@query("global_scores", SIGNALS + SCORES + f""",
w AS (SELECT *, {_WEIGHT_SQL} AS w FROM dom), g AS (SELECT site, round_even(sum(w * score) / sum(w), 0)::BIGINT AS raw, bool_or(domain IN ('Sécurité', 'SEO technique') AND critique > 0) AS c FROM w WHERE w IS NOT NULL GROUP BY site),
h AS (SELECT site, CASE WHEN c THEN least(raw, 49) ELSE raw END AS score, c AND raw > 49 AS capped FROM g)
SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'E' END AS grade FROM h""")
def global_scores(spark, sf_dir):
    return scores.global_scores(_scores(spark, sf_dir))


_RANK = "CASE severity WHEN 'critique' THEN 0 WHEN 'haute' THEN 1 WHEN 'moyenne' THEN 2 WHEN 'basse' THEN 3 WHEN 'info' THEN 4 ELSE 9 END"


@query("ranked_signals", SIGNALS + f" SELECT site, key, severity, domain, row_number() OVER (PARTITION BY site ORDER BY {_RANK}, domain, key)::INT AS place FROM sig")
def ranked_signals(spark, sf_dir):
    return findings.ranked(signals_of(spark, sf_dir)).select("site", "key", "severity", "domain", "place")


# Our own sheets: id, title, domain, severity, effort; and what calls for them.
SHEETS = (
    ("seo-titres", "Titres courts ou longs", "SEO technique", "moyenne", "S"), ("seo-params", "Adresses à paramètres", "SEO technique", "moyenne", "M"), ("contenu-mince", "Pages pauvres en texte", "Contenu", "haute", "L"),
    ("geo-jsonld", "Données structurées absentes", "GEO", "basse", "M"), ("a11y-viewport", "Zone d'affichage non déclarée", "Accessibilité", "haute", "S"), ("a11y-manuel", "Parcours au clavier", "Accessibilité", "moyenne", "M"),
)
TRIGGERS = (("seo-titres", "crawl", "title_short"), ("seo-titres", "crawl", "title_long"), ("seo-params", "crawl", "param_indexable"), ("contenu-mince", "crawl", "thin_content"), ("geo-jsonld", "crawl", "no_jsonld"), ("a11y-viewport", "crawl", "viewport_missing"), ("a11y-viewport", "geo", "viewport"))
_SHEETS_SQL = ", she(sheet_id, title, domain, sheet_severity, effort) AS (VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in SHEETS) + "), tri(sheet_id, source, pattern) AS (VALUES " + ", ".join(str(r) for r in TRIGGERS) + ")"


def sheets_of(spark) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(SHEETS, "sheet_id string, title string, domain string, sheet_severity string, effort string"), spark.createDataFrame(TRIGGERS, "sheet_id string, source string, pattern string")


@query("corrections", SIGNALS + _SHEETS_SQL + f""", hit AS (SELECT site, source, key, min({_RANK}) AS r, sheet_id FROM sig JOIN tri USING (source) WHERE key = pattern GROUP BY ALL),
c AS (SELECT site, sheet_id, min(r) AS r, count(DISTINCT key)::BIGINT AS n_signals FROM hit GROUP BY ALL)
SELECT site, lpad(row_number() OVER (PARTITION BY site ORDER BY r, CASE effort WHEN 'S' THEN 1 WHEN 'M' THEN 2 ELSE 3 END, domain, sheet_id)::VARCHAR, 2, '0') AS rank, sheet_id, title, ['critique', 'haute', 'moyenne', 'basse', 'info'][r + 1] AS severity, effort, domain, n_signals
FROM c JOIN she USING (sheet_id)""")
def corrections(spark, sf_dir):
    sheets, triggers = sheets_of(spark)
    return findings.corrections(findings.matched(signals_of(spark, sf_dir), triggers), sheets)


@query("unmatched_signals", SIGNALS + _SHEETS_SQL + " SELECT site, source, key FROM sig WHERE key NOT IN (SELECT pattern FROM tri WHERE source = 'crawl')")
def unmatched_signals(spark, sf_dir):
    s = signals_of(spark, sf_dir)
    return findings.unmatched(s, findings.matched(s, sheets_of(spark)[1])).select("site", "source", "key")


@query("undetected_sheets", SIGNALS + _SHEETS_SQL + " SELECT DISTINCT site, sheet_id, title FROM sig JOIN she ON sheet_id NOT IN (SELECT sheet_id FROM tri)")
def undetected_sheets(spark, sf_dir):
    """For every site, the sheets that a person has to check."""
    sheets = findings.undetected(*sheets_of(spark)).select("sheet_id", "title").withColumn("all", F.lit(True))
    return signals_of(spark, sf_dir).select("site").distinct().withColumn("all", F.lit(True)).join(F.broadcast(sheets), "all").drop("all")


@query("linked_corrections", SIGNALS + _SHEETS_SQL + " SELECT DISTINCT site, sig.source, key, sheet_id FROM sig LEFT JOIN tri ON key = pattern AND sig.source = tri.source")
def linked_corrections(spark, sf_dir):
    s = signals_of(spark, sf_dir)
    return findings.linked_corrections(s, findings.matched(s, sheets_of(spark)[1]))


TRUTH = (("T1", "seo", "crawl_issue", "crawl", "title_short"), ("T2", "seo", "crawl_issue", "crawl", "http_5xx"), ("T3", "a11y", "texte", "crawl", "^viewport"), ("T4", "geo", "texte", "geo", "jsonld"), ("T5", "geo", "texte", "crawl", "JSONLD"))


@query("truth_recall", SIGNALS + ", t(id, domain, type, source, pattern) AS (VALUES " + ", ".join(str(r) for r in TRUTH) + """), d AS (SELECT domain, CASE WHEN type = 'crawl_issue' THEN pattern IN (SELECT key FROM sig)
ELSE EXISTS (SELECT 1 FROM sig WHERE sig.source = t.source AND regexp_matches(text, '(?i)' || pattern)) END AS detected FROM t)
SELECT coalesce(domain, '*') AS domain, count_if(detected)::BIGINT AS found, count(*)::BIGINT AS total, round(count_if(detected) / count(*), 3) AS recall FROM d GROUP BY ROLLUP (domain)""")
def truth_recall(spark, sf_dir):
    return scores.recall(findings.detected(spark.createDataFrame(TRUTH, "id string, domain string, type string, source string, pattern string"), signals_of(spark, sf_dir)))


# Audits: one site for each user, an audit for each event, without score where the event is an error.
AUDITS = "aud AS (SELECT user_id AS site, event_id AS day, CASE WHEN event_type <> 'error' THEN floor(value)::BIGINT END AS score FROM events)"


def events_of(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def audits_of(spark, sf_dir) -> DataFrame:
    return events_of(spark, sf_dir).select(F.col("user_id").alias("site"), F.col("event_id").alias("day"), F.when(F.col("event_type") != "error", F.floor("value")).alias("score"))


@query("audit_deltas", f"""
WITH {AUDITS}, p AS (SELECT *, last_value(score IGNORE NULLS) OVER w AS before, count(score) OVER w AS n FROM aud WINDOW w AS (PARTITION BY site ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT site, day, score, score - before AS delta, score IS NOT NULL AND n = 0 AS first FROM p""")
def audit_deltas(spark, sf_dir):
    return history.audit_deltas(audits_of(spark, sf_dir))


# Field values: the event's type as the metric, its number as the period, its value (times 60) in milliseconds; errors have none.
SERIES = "ser AS (SELECT user_id AS site, ['lcp', 'inp', 'fcp', 'ttfb'][event_id % 4 + 1] AS metric, event_id AS period, CASE WHEN event_type <> 'error' THEN round(value * 60, 2) END AS value FROM events)"


def series_of(spark, sf_dir) -> DataFrame:
    e = events_of(spark, sf_dir)
    metric = F.element_at(F.array(*map(F.lit, ("lcp", "inp", "fcp", "ttfb"))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(F.col("user_id").alias("site"), metric.alias("metric"), F.col("event_id").alias("period"), F.when(F.col("event_type") != "error", F.round(F.col("value") * 60, 2)).alias("value"))


def _verdict(metric: str, value: str) -> str:
    return "CASE " + " ".join(f"WHEN {metric} = '{m}' AND {value} <= {g} THEN 'bon' WHEN {metric} = '{m}' AND {value} <= {p} THEN 'moyen' WHEN {metric} = '{m}' AND {value} IS NOT NULL THEN 'mauvais'" for m, g, p in text.VITALS) + " END"


@query("field_trends", f"""
WITH {SERIES}, r AS (SELECT *, count(value) OVER (PARTITION BY site, metric ORDER BY period DESC) AS seen, count(value) OVER (PARTITION BY site, metric) AS n FROM ser),
k AS (SELECT *, least(4, n // 2)::INT AS k FROM r),
t AS (SELECT site, metric, count_if(seen = 0)::BIGINT AS age, max(k) AS k, avg(value) FILTER (seen > k AND seen <= 2 * k) AS before, avg(value) FILTER (seen <= k) AS now FROM k GROUP BY ALL)
SELECT site, metric, age, k, round(before, 4) AS before, round(now, 4) AS now, coalesce({_verdict("metric", "now")} <> 'bon' AND now - before >= CASE metric {" ".join(f"WHEN '{m}' THEN {f}" for m, f in history.FLOORS.items())} END, FALSE) AS degraded FROM t""")
def field_trends(spark, sf_dir):
    return history.trends(series_of(spark, sf_dir)).withColumns({"before": F.round("before", 4), "now": F.round("now", 4)})


@query("field_verdicts", f"""
WITH {SERIES}, p AS (SELECT site, metric, quantile_disc(value, 0.75) AS p75 FROM ser WHERE value IS NOT NULL GROUP BY ALL) SELECT site, metric, p75, {_verdict("metric", "p75")} AS verdict FROM p""")
def field_verdicts(spark, sf_dir):
    p = series_of(spark, sf_dir).filter("value IS NOT NULL").groupBy("site", "metric").agg(F.expr("percentile_disc(0.75) WITHIN GROUP (ORDER BY value)").alias("p75"))
    return p.withColumn("verdict", text.vitals_verdict(F.col("metric"), F.col("p75")))


@query("field_findings", f"""
WITH {SERIES}, v AS (SELECT site, metric, CASE {_verdict("metric", "value")} WHEN 'mauvais' THEN CASE WHEN metric IN ('fcp', 'ttfb') THEN 2 ELSE 1 END WHEN 'moyen' THEN 2 END AS r FROM ser)
SELECT site, 'terrain_' || metric AS key, ['critique', 'haute', 'moyenne', 'basse', 'info'][min(r) + 1] AS severity FROM v WHERE r IS NOT NULL GROUP BY ALL""")
def field_findings(spark, sf_dir):
    return history.field_findings(series_of(spark, sf_dir).withColumn("device", F.lit("mobile")))


@query("upper_medians", """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(value) FILTER (r = n // 2 + 1) AS median, max(value) AS largest FROM r GROUP BY event_type""")
def upper_medians(spark, sf_dir):
    return scores.upper_median(events_of(spark, sf_dir), ["event_type"], "value")


@query("half_up_medians", "SELECT user_id, floor(median(floor(value)) + 0.5)::BIGINT AS median FROM events GROUP BY user_id")
def half_up_medians(spark, sf_dir):
    return scores.half_up_median(events_of(spark, sf_dir).withColumn("value", F.floor("value")), ["user_id"], "value")


@query("lower_median_runs", """
WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_id, value FROM r WHERE r = (n + 1) // 2""")
def lower_median_runs(spark, sf_dir):
    return scores.lower_median_run(events_of(spark, sf_dir), ["user_id"], "value", "event_id")


@query("log_report", "SELECT event_type AS status, count(*)::BIGINT AS hits, count(DISTINCT user_id)::BIGINT AS visitors FROM events GROUP BY event_type")
def log_report(spark, sf_dir):
    return events_of(spark, sf_dir).groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("hits"), F.countDistinct("user_id").alias("visitors"))


# Savings: suppliers as sites, line numbers as runs, parts (modulo 20) as audits; price as bytes and quantity as milliseconds.
RUNS = "run AS (SELECT l_suppkey % 40 AS site, l_linenumber AS run, l_partkey % 20 AS id, max(l_quantity)::DOUBLE * 30 AS gain_ms, max(l_extendedprice) * 5 AS gain_octets FROM lineitem GROUP BY ALL)"


@query("opportunities", f"""
WITH {RUNS}, t AS (SELECT *, row_number() OVER (PARTITION BY site, run ORDER BY gain_ms + gain_octets / 10000 DESC, id) AS pos FROM run), o AS (SELECT * FROM t WHERE pos <= 6 QUALIFY row_number() OVER (PARTITION BY site, id ORDER BY run, pos) = 1)
SELECT site, id, run, pos::INT AS pos, CASE WHEN gain_ms >= 1000 OR gain_octets >= 1000000 THEN 'haute' WHEN gain_ms >= 300 OR gain_octets >= 250000 THEN 'moyenne' ELSE 'basse' END AS severity FROM o""")
def opportunities(spark, sf_dir):
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")  # noqa: E741
    runs = l.groupBy((F.col("l_suppkey") % 40).alias("site"), F.col("l_linenumber").alias("run"), (F.col("l_partkey") % 20).alias("id")).agg((F.max("l_quantity") * 30).alias("gain_ms"), (F.max("l_extendedprice") * 5).alias("gain_octets"))
    return findings.opportunities(runs.withColumns({"title": F.lit(""), "weight": F.lit(0.0)})).select("site", "id", "run", "pos", "severity")


@query("outdated_packages", """
WITH l AS (SELECT c_nationkey AS site, c_name AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) AS p FROM customer WHERE c_custkey % 7 > 3)
SELECT site, count(*)::BIGINT AS n, string_agg(name, ', ' ORDER BY name) FILTER (p <= 10) || CASE WHEN count(*) > 10 THEN ' + ' || (count(*) - 10) || ' autres' ELSE '' END AS text FROM l GROUP BY site""")
def outdated_packages(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return findings.outdated(c.select(F.col("c_nationkey").alias("site"), F.col("c_name").alias("name"), F.lit("^3.9.1").alias("current"), F.concat((F.col("c_custkey") % 7).cast("string"), F.lit(".0.0")).alias("latest")))


@query("capped_resources", """
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INT AS place, greatest(count(*) OVER (PARTITION BY user_id) - 15, 0)::BIGINT AS left_out FROM events) SELECT * FROM r WHERE place <= 15""")
def capped_resources(spark, sf_dir):
    return history.capped(events_of(spark, sf_dir).select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), "event_id"], 15).select("user_id", "event_id", "place", "left_out")


# Texts.
_MASK = "regexp_replace(regexp_replace(regexp_replace({0}, '" + "|".join(text.SECRET_PATTERNS) + r"', '***', 'g'), '(?i)\b(bearer)\s+[0-9A-Za-z._~+/-]{8,}=*', '\1 ***', 'g'), '(?i)\b(token|secret|password|passwd|api[_-]?key|access[_-]?key)(" + r'"?\s*[=:]\s*"?)[^\s"' + r"''&,;]{4,}', '\1\2***', 'g')"


@query("masked_texts", "SELECT doc_id, md5(" + _f(_MASK, "text") + ") AS masked FROM documents")
def masked_texts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(text.masked(F.col("text")).cast("binary")).alias("masked"))


@query("question_turns", rf"""
SELECT conv_id, turn, regexp_matches(trim(text), '\?\s*$') OR regexp_matches(lower(trim(text)), '^({"|".join(text.QUESTION_WORDS).replace("'", "''")})([^\p{{L}}\p{{N}}_]|$)') AS question FROM conversations""")
def question_turns(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", text.is_question(F.col("text")).alias("question"))


@query("token_frequency", f"""
SELECT token, count(*)::BIGINT AS df FROM (SELECT unnest(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-zà-ÿ0-9]{{3,}}')), lambda w: NOT list_contains([{", ".join(f"'{w}'" for w in text.STOP_WORDS)}], w))) AS token FROM benchmark) GROUP BY token""")
def token_frequency(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.explode(text.title_tokens(F.col("text"))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("df"))


SUFFIXES = (("com", "plain"), ("net", "plain"), ("example.com", "plain"), ("example.net", "wildcard"), ("www.example.net", "exception"))


@query("registrable_domains", rf"""
WITH h AS (SELECT DISTINCT {_f(HOST, "url")} AS host FROM pages), l AS (SELECT host, string_split(host, '.') AS l FROM h),
s AS (SELECT host, l, len(l) AS n, CASE WHEN l[-2] = 'example' AND l[-1] = 'com' THEN 2 WHEN host LIKE '%www.example.net' THEN 2 WHEN l[-2] = 'example' AND l[-1] = 'net' AND len(l) > 2 THEN 3 ELSE 1 END AS z FROM l)
SELECT host, array_to_string(l[n - z + 1:], '.') AS public_suffix, CASE WHEN n > z THEN array_to_string(l[n - z:], '.') END AS domain FROM s""")
def registrable_domains(spark, sf_dir):
    hosts = pages_of(spark, sf_dir).select(urls.host(F.col("url")).alias("host"))
    return domain.registrable(hosts, spark.createDataFrame(SUFFIXES, "rule string, kind string"))


@query("label_recall", """
WITH d AS (SELECT lang AS domain, regexp_matches(text, '%%%|!!|[|]') AS detected FROM documents JOIN labels USING (doc_id) WHERE quality = 0)
SELECT coalesce(domain, '*') AS domain, count_if(detected)::BIGINT AS found, count(*)::BIGINT AS total, round(count_if(detected) / count(*), 3) AS recall FROM d GROUP BY ROLLUP (domain)""")
def label_recall(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 0"), "doc_id")
    return scores.recall(d.select(F.col("lang").alias("domain"), F.col("text").rlike("%%%|!!|[|]").alias("detected")))


@query("report_head", SIGNALS + f" SELECT site, key, severity, domain, row_number() OVER (PARTITION BY site ORDER BY {_RANK}, domain, key)::INT AS place FROM sig QUALIFY place <= 15")
def report_head(spark, sf_dir):
    return reports.report_head(signals_of(spark, sf_dir)).select("site", "key", "severity", "domain", "place")


@query("history_index", f"""
WITH {AUDITS}, l AS (SELECT site, min(day) AS first_day, max(day) AS last_day, count(*)::BIGINT AS n_audits, count(score)::BIGINT AS n_scored FROM aud GROUP BY site),
s AS (SELECT l.*, (SELECT a.score FROM aud a WHERE a.site = l.site AND a.day = last_day) AS score, (SELECT max_by(a.score, a.day) FROM aud a WHERE a.site = l.site AND a.day < last_day AND a.score IS NOT NULL) AS b FROM l)
SELECT site, first_day, last_day, n_audits, n_scored, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' WHEN score IS NOT NULL THEN 'E' END AS grade, score - b AS delta FROM s""")
def history_index(spark, sf_dir):
    return reports.history_index(audits_of(spark, sf_dir))


# Entries: id, domain, type, source, pattern, contains, phase, on_clean. The clean twin are the sites whose names hold a 1.
EVALUATED = (
    ("E1", "seo", "crawl_issue", "crawl", "title_short", None, 0, "absent"), ("E2", "seo", "crawl_issue", "crawl", "http_5xx", None, 0, "absent"), ("E3", "seo", "crawl_issue", "crawl", "thin_content", "example", 0, "present"), ("E4", "seo", "crawl_issue", "crawl", "no_jsonld", "nowhere", 0, "absent"),
    ("E5", "geo", "texte", "crawl", "^TITLE_", None, 0, "absent"), ("E6", "geo", "texte", "crawl", "h1_", None, 1, "absent"), ("E7", "geo", "unitaire", "crawl", "x", None, 0, "absent"), ("E8", "a11y", "texte", "other", ".", None, 0, "absent"),
)
_EVALUATED_SQL = ", t(id, domain, type, source, pattern, part, phase, on_clean) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in EVALUATED) + ")"
_DETAILS = SIGNALS + _EVALUATED_SQL + """, s AS (SELECT DISTINCT site, source, key, text, severity, contains(site, '1') AS clean FROM sig),
d AS (SELECT id, domain, EXISTS (SELECT 1 FROM s WHERE NOT clean AND s.source = t.source AND (part IS NULL OR contains(site, part)) AND CASE WHEN t.type = 'crawl_issue' THEN key = pattern ELSE regexp_matches(text, '(?im)' || pattern) END) AS detected, phase <= 0 AS required,
    on_clean = 'absent' AND EXISTS (SELECT 1 FROM s WHERE clean AND s.source = t.source AND CASE WHEN t.type = 'crawl_issue' THEN key = pattern ELSE regexp_matches(text, '(?im)' || pattern) END) AS false_positive FROM t WHERE type <> 'unitaire')"""


def _twins(spark, sf_dir):
    s = signals_of(spark, sf_dir).withColumns({"type": F.explode(F.array(F.lit("crawl_issue"), F.lit("texte"))), "places": F.array("site")})
    truth = spark.createDataFrame(EVALUATED, "id string, domain string, type string, source string, pattern string, contains string, phase int, on_clean string")
    clean = F.contains("site", F.lit("1"))
    return truth, s.filter(~clean), s.filter(clean)


@query("evaluation_details", _DETAILS + " SELECT * FROM d")
def evaluation_details(spark, sf_dir):
    return scores.evaluation(*_twins(spark, sf_dir)).select("id", "domain", "detected", "required", "false_positive")


@query("evaluation_verdicts", _DETAILS + """, r AS (SELECT coalesce(domain, '*') AS domain, round(count_if(detected) / count(*), 3) AS recall FROM d WHERE required GROUP BY ROLLUP (domain))
SELECT 'recall ' || b.domain AS what, coalesce(recall, 0) AS value, bound FROM (VALUES ('*', 0.9::DOUBLE), ('seo', 0.1::DOUBLE), ('code', 0.5::DOUBLE)) b(domain, bound) LEFT JOIN r USING (domain) WHERE coalesce(recall, 0) < bound
UNION ALL SELECT 'false positives', count(*)::DOUBLE, 0::DOUBLE FROM d WHERE false_positive HAVING count(*) > 0 UNION ALL SELECT 'unexpected', count(*)::DOUBLE, 0::DOUBLE FROM s WHERE clean AND severity IN ('critique', 'haute') HAVING count(*) > 0""")
def evaluation_verdicts(spark, sf_dir):
    truth, broken, clean = _twins(spark, sf_dir)
    return scores.evaluation_verdicts(scores.evaluation(truth, broken, clean), clean.filter("type = 'texte'"), 0.9, {"seo": 0.1, "code": 0.5})
