"""Registered queries over inputs of which the driver's tables have only the pages: answers, files and reports that each page's site
would give, by cases.

Every page of `pages` is a world of its own: it gets one of the query's cases by its id, under a name of its own, so the operator
runs over as many worlds as there are pages. The SQL has the result of each case and joins it to the pages in the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lanternfish.functions import text, urls
from lanternfish.operators import code_rules, code_scan, domain, findings, geo, headers, history, issues, links, robots, scores
from lanternfish.plans.page_queries import HOST, _f, pages_of
from lanternfish.plans.tables import stored
from lanternfish.sources import files, html

QUERIES, SQL = {}, {}
#: Domain names of cases, which are renamed for each world wherever they stand.
NAMES = r"\b([abcx])\.com\b"


class Worlds:
    """Tables of cases, dealt to the pages. A table with the column `key` is split into cases by its values; other tables are the
    same for all worlds. With `names`, domain names in all columns are renamed instead."""

    def __init__(self, spark: SparkSession, sf_dir: str, key: str | None, keys: tuple[str, ...], names: bool):
        self.spark, self.key, self.keys, self.names = spark, key, keys, names
        self.ids = pages_of(spark, sf_dir).select("page_id", (F.col("page_id") % len(keys)).cast("int").alias("case"))

    def createDataFrame(self, rows: list[tuple], schema: str) -> DataFrame:  # noqa: N802  as the session's own
        df = self.spark.createDataFrame(rows, schema)
        if self.names:
            each = self.ids.join(F.broadcast(df.withColumn("case", F.lit(0))), "case")
            own = lambda c: F.regexp_replace(c, NAMES, F.concat(F.lit("$1-"), F.col("page_id").cast("string"), F.lit(".com")))
            kinds = {f.name: f.dataType for f in df.schema}
            return each.select(*[(own(F.col(c)) if isinstance(t, StringType) else F.transform(c, own) if isinstance(t, ArrayType) else F.col(c)).alias(c) for c, t in kinds.items()])
        if self.key is None:
            return self.ids.join(F.broadcast(df.withColumn("case", F.lit(0))), "case").drop("case", "page_id")
        if self.key not in df.columns:
            return df
        case = F.array_position(F.array(*map(F.lit, self.keys)), F.col(self.key)) - 1
        each = self.ids.join(F.broadcast(df.withColumn("case", case.cast("int"))), "case")
        return each.withColumn(self.key, F.concat(self.key, F.lit("~"), "page_id")).select(*df.columns)


def _value(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def golden(name: str, columns: str, *rows: tuple, key: str | None = "site", keys: tuple[str, ...] = ("s",), names: bool = False):
    """columns: `name:TYPE` separated by blanks; rows: the result of the cases. The key's column comes first if it is not named."""
    cols = [c.split(":") for c in columns.split()]
    if key and not names and key not in [c for c, _ in cols]:
        cols, rows = [[key, "VARCHAR"], *cols], tuple((keys[0], *r) for r in rows)
    at = [c for c, _ in cols].index(key) if key and not names else None
    shown = lambda c, t: f"{c} || '~' || page_id AS {c}" if c == key and not names else f"regexp_replace({c}, '([abcx])\\.com', '\\1-' || page_id || '.com') AS {c}" if names and t == "VARCHAR" else f"{c}::{t} AS {c}"
    values = ", ".join("(" + ", ".join([str(keys.index(r[at]) if at is not None else 0), *map(_value, r)]) + ")" for r in rows)
    SQL[name] = f"SELECT {', '.join(shown(c, t) for c, t in cols)} FROM (SELECT page_id FROM pages) p JOIN (VALUES {values}) t(\"case\", {', '.join(c for c, _ in cols)}) ON page_id % {len(keys)} = \"case\""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Worlds(spark, sf_dir, key, keys, names))
        return f

    return add


@golden("header_findings", "url:VARCHAR key:VARCHAR severity:VARCHAR", ("https://s/a", "version_serveur", "basse"), ("https://s/a", "hsts_absent", "moyenne"), ("https://s/a", "html_lourd", "basse"), ("http://s/b", "compression_absente", "moyenne"))
def header_findings(spark):
    good = {"Content-Encoding": "br", "Cache-Control": "max-age=60", "Content-Security-Policy": "frame-ancestors 'none'", "X-Content-Type-Options": "nosniff", "Referrer-Policy": "same-origin", "Permissions-Policy": "a", "Cross-Origin-Opener-Policy": "same-origin"}
    rows = [("s", "https://s/a", 150_001, {**good, "Server": "nginx/1.25"}), ("s", "http://s/b", 150_000, {**good, "Content-Encoding": ""})]
    return headers.header_findings(spark.createDataFrame(rows, "site string, url string, bytes bigint, headers map<string,string>"))


@golden("policy_findings", "url:VARCHAR key:VARCHAR", ("u1", "csp_unsafe_inline"), ("u1", "csp_joker"), ("u1", "csp_sans_base_uri"), ("u1", "csp_sans_object_src"), ("u4", "csp_sans_script"), ("u4", "csp_sans_base_uri"), ("u4", "csp_sans_object_src"))
def policy_findings(spark):
    rows = [("s", "u1", ["script-src 'unsafe-inline' *"]), ("s", "u2", ["script-src 'unsafe-inline'", "script-src 'self'; base-uri 'none'; object-src 'none'"]), ("s", "u3", ["script-src 'unsafe-inline' 'nonce-x'; base-uri 'self'; default-src 'none'"]), ("s", "u4", ["img-src 'self'"]), ("s", "u5", [])]
    return headers.policy_findings(spark.createDataFrame(rows, "site string, url string, policies array<string>"))


@golden("cookie_findings", "name:VARCHAR kind:VARCHAR key:VARCHAR severity:VARCHAR", ("sid", "session", "cookie_sans_secure", "haute"), ("sid", "session", "cookie_sans_httponly", "haute"), ("sid", "session", "cookie_sans_samesite", "haute"), ("__Host-x", "autre", "cookie_prefixe_invalide", "moyenne"), ("_ga", "mesure", "cookie_none_sans_secure", "haute"), ("_ga", "mesure", "cookie_sans_secure", "info"))
def cookie_findings(spark):
    rows = [("s", True, "sessionid=1; Secure; HttpOnly; SameSite=Lax"), ("s", True, "sid=2"), ("s", True, "_ga=3; SameSite=None"), ("s", True, "__Host-x=4; Secure; HttpOnly; SameSite=Lax; Domain=s; Path=/"), ("s", True, "csrf_t=5; Secure; SameSite=Strict")]
    return headers.cookie_findings(spark.createDataFrame(rows, "site string, https boolean, cookie string"))


@golden("asset_findings", "url:VARCHAR key:VARCHAR severity:VARCHAR", ("http://s/app.3f9a1c2b.js", "hache_sans_immutable", "basse"), ("http://s/app.3f9a1c2b.js", "cache_court", "basse"), ("http://s/app.3f9a1c2b.js", "non_compresse", "moyenne"), ("http://s/app.3f9a1c2b.js", "js_lourd", "moyenne"), ("http://s/p.jpg", "image_lourde", "moyenne"), ("http://s/p.jpg", "asset_sans_cache", "moyenne"))
def asset_findings(spark):
    rows = [("s", "http://s/app.3f9a1c2b.js", 200_000, "max-age=60", None), ("s", "http://s/i.png", 10, "max-age=31536000, immutable", None), ("s", "http://s/p.jpg", 200_001, "no-store", None)]
    return headers.asset_findings(spark.createDataFrame(rows, "site string, url string, bytes bigint, cache_control string, encoding string"))


@golden("exposures", "path:VARCHAR severity:VARCHAR", ("/.env", "critique"))
def exposures(spark):
    return headers.exposures(spark.createDataFrame([("s", "/.env", 200, "KEY=1"), ("s", "/.git/config", 200, "<html>"), ("s", "/id_rsa", 404, "PRIVATE KEY")], "site string, path string, status int, body string"))


@golden("soft_404", "segment:VARCHAR", ("blog",))
def soft_404(spark):
    return headers.soft_404(spark.createDataFrame([("s", "blog", 200), ("s", "docs", 404)], "site string, segment string, status int"))


@golden("blocked_access", "agent:VARCHAR why:VARCHAR", ("GPTBot", "statut"), ("X", "corps_reduit"), ("Z", "defi"))
def blocked_access(spark):
    rows = [("s", "reference", 200, 1000, ""), ("s", "GPTBot", 403, 10, ""), ("s", "X", 200, 299, ""), ("s", "Y", 200, 300, ""), ("s", "Z", 200, 900, "Just a moment...")]
    return headers.blocked_access(spark.createDataFrame(rows, "site string, agent string, status int, bytes int, body string"))


ANSWERS = [
    ("a.com", "TXT", 0, False, ['"v=spf1 include:_s.x.com ~all"']), ("_s.x.com", "TXT", 0, False, ["v=spf1 a mx redirect=b.com"]), ("b.com", "TXT", 0, False, ["v=spf1 +all"]), ("c.com", "TXT", 0, False, ["v=spf1 -all", "v=spf1 ?all"]),
    ("_dmarc.a.com", "TXT", 0, False, ["v=DMARC1; p=reject; sp=none"]), ("sub.a.com", "TXT", 2, False, []), ("a.com", "CAA", 0, True, ["0 issue ca"]), ("a.com", "AAAA", 0, True, ["::1"]),
]


def _dns(spark):
    names = spark.createDataFrame([("a.com",), ("b.com",), ("c.com",), ("sub.a.com",)], "name string")
    return names, spark.createDataFrame(ANSWERS, "name string, type string, status int, ad boolean, data array<string>")


@golden("spf_records", "name:VARCHAR records:BIGINT ends:VARCHAR lookups:BIGINT", ("a.com", 1, "~", 4), ("b.com", 1, "+", 0), ("c.com", 2, "-", 0), ("sub.a.com", 0, None, 0), key=None, names=True)
def spf_records(spark):
    return domain.spf(*_dns(spark)).withColumnRenamed("all", "ends")


@golden("dmarc_policies", "name:VARCHAR found_at:VARCHAR policy:VARCHAR", ("a.com", "a.com", "reject"), ("sub.a.com", "a.com", "none"), key=None, names=True)
def dmarc_policies(spark):
    return domain.dmarc(*_dns(spark)).withColumnRenamed("at", "found_at")


@golden(
    "domain_findings", "name:VARCHAR key:VARCHAR severity:VARCHAR", ("b.com", "spf_permissif", "haute"), ("b.com", "dmarc_absent", "moyenne"), ("b.com", "caa_absent", "basse"), ("b.com", "dnssec_absent", "info"), ("b.com", "ipv6_absent", "info"),
    ("c.com", "spf_multiple", "haute"), ("c.com", "dmarc_absent", "moyenne"), ("c.com", "caa_absent", "basse"), ("c.com", "dnssec_absent", "info"), ("c.com", "ipv6_absent", "info"), ("sub.a.com", "dmarc_none", "basse"), ("sub.a.com", "dnssec_absent", "info"), ("sub.a.com", "ipv6_absent", "info"), key=None, names=True,
)
def domain_findings(spark):
    return domain.findings(*_dns(spark))


TREE = [("s", "src/a.astro", "<X client:load />\n// <Y client:only />\n<p>'// client:only'</p>\n/* <img */ <img src=x>"), ("s", "node_modules/b.astro", "<X client:load />"), ("s", ".env", "A=1"), ("s", "package.json", '{"dependencies": {"astro": "^3.1.0", "x": "1.0.0"}}')]


def _tree(spark):
    return spark.createDataFrame(TREE, "site string, path string, text string")


@golden("code_lines", "key:VARCHAR severity:VARCHAR path:VARCHAR line_no:INT", ("client_load", "moyenne", "src/a.astro", 1), ("client_only", "basse", "src/a.astro", 3), ("img_brute", "moyenne", "src/a.astro", 4))
def code_lines(spark):
    return code_scan.line_findings(_tree(spark)).drop("excerpt")


@golden("code_absences", "key:VARCHAR severity:VARCHAR", ("page_404_absente", "moyenne"), ("robots_absent", "moyenne"), ("favicon_absente", "basse"), ("llms_absent", "basse"), ("lockfile_absent", "moyenne"))
def code_absences(spark):
    return code_scan.absences(_tree(spark), spark.createDataFrame([("s",)], "site string"))


# A tree with faults of each group of rules, and one whose only fault is a missing option.
FAULTS = [
    ("s", "package.json", '{"dependencies": {"astro": "^6.1.0", "lodash": "4"}}'), ("s", "package-lock.json", "{}"), ("s", ".gitignore", ".env"), ("s", "public/favicon.svg", "<svg/>"), ("s", "public/llms.txt", "#"), ("s", "public/robots.txt", "User-agent: *\nSitemap: /m.xml"), ("s", "src/pages/404.astro", "<p>404</p>"),
    ("s", "astro.config.mjs", "// site: 'https://x.fr'\nexport default { trailingSlash: 'never', security: { checkOrigin: false, csp: true }, session: { driver: { ttl: 1 } }, experimental: { logger: 1 }, prefetch: 1, clientPrerender: 1 }"),
    ("s", "src/pages/[id].astro", "<p>\n<img src={a} alt='' width='1' height='1'>\n<p set:html={x} /><script type='application/ld+json' set:html={y} />"), ("s", "src/actions/index.ts", "export const a = defineAction({\n handler: (x) => x })"),
    ("s", "convex/a.ts", "export const put = mutation({\n handler: async (ctx) => ctx.db })\nexport const get = query({ args: {}, handler: (c) => c.db.query('t')\n .collect() })"),
    ("t", "astro.config.ts", "export default { site: 'https://x.fr', trailingSlash: 'never', prefetch: 0, clientPrerender: 1 }"),
]


@golden(
    "code_findings", "site:VARCHAR key:VARCHAR severity:VARCHAR category:VARCHAR n:BIGINT first_place:VARCHAR", ("s", "site_non_defini", "haute", "seo", 1, "astro.config.mjs"), ("s", "origine_non_verifiee", "moyenne", "securite", 1, "astro.config.mjs"), ("s", "version_en_retard", "moyenne", "code", 1, "astro.config.mjs"),
    ("s", "dependances_lourdes", "basse", "performance", 1, "astro.config.mjs"), ("s", "options_a_retirer", "basse", "code", 1, "astro.config.mjs"), ("s", "session_sans_fin", "info", "securite", 1, "astro.config.mjs"), ("s", "img_brute", "moyenne", "performance", 1, "src/pages/[id].astro:2"), ("s", "set_html", "moyenne", "securite", 1, "src/pages/[id].astro:3"),
    ("s", "route_sans_404", "haute", "seo", 1, "src/pages/[id].astro"), ("s", "robots_sitemap_relatif", "moyenne", "seo", 1, "public/robots.txt:2"), ("s", "action_sans_validation", "moyenne", "securite", 1, "src/actions/index.ts:1"), ("s", "fonction_sans_identite", "haute", "securite", 1, "convex/a.ts:1"),
    ("s", "fonction_sans_args", "moyenne", "securite", 1, "convex/a.ts:1"), ("s", "collect_sans_borne", "basse", "performance", 1, "convex/a.ts:4"), ("t", "env_non_ignore", "haute", "securite", 1, None), keys=("s", "t"),
)
def code_findings(spark):
    files = spark.createDataFrame(FAULTS, "site string, path string, text string")
    found = code_rules.code_findings(files, spark.createDataFrame([("s",)], "site string"), 7)
    return found.select("site", "key", "severity", "category", "n", F.get("places", F.lit(0)).alias("first_place"))


@golden("server_counters", "what:VARCHAR n:BIGINT", ("mutation", 1), ("query", 1))
def server_counters(spark):
    return code_rules.server_counters(spark.createDataFrame(FAULTS, "site string, path string, text string"))


@golden("tracked_secrets", "key:VARCHAR severity:VARCHAR", ("env_suivi", "critique"), ("env_non_ignore", "haute"))
def tracked_secrets(spark):
    return code_scan.tracked_secrets(_tree(spark))


@golden("hydration_directives", "directive:VARCHAR n:BIGINT", ("load", 1), ("only", 2))
def hydration_directives(spark):
    return code_scan.hydration(_tree(spark))


@golden("package_versions", "name:VARCHAR have:VARCHAR latest:VARCHAR", ("astro", "^3.1.0", "5.0.0"))
def package_versions(spark):
    known = spark.createDataFrame([("astro", "5.0.0"), ("y", "1.0.0")], "name string, latest string")
    return files.package_findings(_tree(spark).filter("path = 'package.json'"), known).select("site", "name", F.col("current").alias("have"), "latest")


@golden("bundle_extensions", "ext:VARCHAR packed:BOOLEAN", ("astro", True), ("env", True), ("json", True))
def bundle_extensions(spark):
    return code_scan.bundle_sizes(_tree(spark)).select("site", "ext", (F.col("octets") > 0).alias("packed"))


@golden("report_lines", "seq:BIGINT severity:VARCHAR text:VARCHAR", (1, "haute", "compression | absente"), (2, "basse", "cache | court"), (3, "basse", "à voir"))
def report_lines(spark):
    rows = [("s", 0, "# ⚠️ titre"), ("s", 1, "| compression | ❌ absente |"), ("s", 2, "| cache | ⚠️ court |"), ("s", 3, "- ⚠️ à voir"), ("s", 4, "- ⚠️ mais ✅"), ("s", 5, "⚠️ prose"), ("s", 6, "| x | ❌ (mode test) |")]
    return findings.from_lines(spark.createDataFrame(rows, "site string, pos int, line string"), "http", "Sécurité").select("site", "seq", "severity", "text")


@golden("sitemap_urls", "url:VARCHAR lastmod:VARCHAR", ("http://s/a?x=1&y=2", "2026-01-01"), ("http://s/b", None))
def sitemap_urls(spark):
    docs = [("s", "m0", "<sitemapindex><sitemap><loc>m1</loc></sitemap></sitemapindex>"), ("s", "m1", "<urlset><url><loc> http://s/a?x=1&amp;y=2 </loc><lastmod>2026-01-01</lastmod></url><url><loc><![CDATA[http://s/b]]></loc></url></urlset>")]
    return files.sitemaps(spark.createDataFrame([("s", "m0")], "site string, url string"), spark.createDataFrame(docs, "site string, url string, xml string"))


def suffix_rules(spark, sf_dir):
    """A list for each page: the same public rules, and a private one of its own."""
    listed = "// head\ncom // note\n*.ck\n!WWW.ck\nрф\n\n// ===BEGIN PRIVATE DOMAINS===\nhost-{}.io\n// ===END PRIVATE DOMAINS===\nuk"
    name = F.col("page_id").cast("string")
    return files.suffix_rules(pages_of(spark, sf_dir).select(name.alias("name"), F.replace(F.lit(listed), F.lit("{}"), name).alias("text")))


QUERIES["suffix_rules"] = suffix_rules
SQL["suffix_rules"] = """SELECT rule, kind, private FROM (VALUES ('com', 'plain', FALSE), ('ck', 'wildcard', FALSE), ('www.ck', 'exception', FALSE), ('xn--p1ai', 'plain', FALSE), ('uk', 'plain', FALSE)) t(rule, kind, private)
WHERE EXISTS (SELECT 1 FROM pages) UNION ALL SELECT DISTINCT 'host-' || page_id || '.io', 'plain', TRUE FROM pages"""


REPORT = '{"categories":{"performance":{"score":0.885}},"audits":{"a":{"id":"a","title":"A","score":0.5,"scoreDisplayMode":"numeric","details":{"overallSavingsMs":400}},"b":{"id":"b","title":"B","score":1,"scoreDisplayMode":"binary"},"c":{"id":"c","title":"C","score":0,"scoreDisplayMode":"binary"}}}'


@golden("lighthouse_audits", "id:VARCHAR failed:BOOLEAN gain_ms:DOUBLE", ("a", True, 400.0), ("b", False, None), ("c", True, None))
def lighthouse_audits(spark):
    return files.lighthouse(spark.createDataFrame([("s", 1, REPORT), ("s", 2, "broken")], "site string, run int, json string")).select("site", "id", "failed", "gain_ms")


@golden("lighthouse_scores", "category:VARCHAR score:INT", ("performance", 89))
def lighthouse_scores(spark):
    return files.lighthouse_scores(spark.createDataFrame([("s", 1, REPORT), ("s", 2, "broken")], "site string, run int, json string")).select("site", "category", "score")


@golden("sheet_fields", "id:VARCHAR titre:VARCHAR triggers:VARCHAR body:VARCHAR", ("t1", "Un titre", "crawl: title_short", "Corps"), key=None)
def sheet_fields(spark):
    sh = files.sheets(spark.createDataFrame([("x", '---\nid: t1\ntitre: "Un titre"\ndeclencheurs:\n  - crawl: title_short\n---\nCorps')], "name string, text string"))
    return sh.select(F.col("fields")["id"].alias("id"), F.col("fields")["titre"].alias("titre"), F.array_join("triggers", ",").alias("triggers"), "body")


@golden("tolerant_json", "id:INT a:INT", (1, 5), (2, None), (3, None), key=None)
def tolerant_json(spark):
    t = files.tolerant_json(spark.createDataFrame([(1, '{"a": 5}'), (2, "{bad"), (3, None)], "id int, raw string"), "raw", "a int")
    return t.select("id", F.col("parsed.a").alias("a"))


@golden("robots_rules", "group_id:BIGINT agent:VARCHAR allow:BOOLEAN pattern:VARCHAR", (1, "a", False, "/x"), (1, "b", False, "/x"), (2, "*", True, "/y$"))
def robots_rules(spark):
    r = robots.rules(spark.createDataFrame([("s", "User-agent: a\nUser-agent: B\nDisallow: /x # no\n\nUser-agent: *\nAllow: /y$\nDisallow:\n")], "site string, text string"))
    return r.select("site", "group_id", "agent", "allow", "pattern")


@golden("robots_sitemaps", "url:VARCHAR relative:BOOLEAN", ("/m.xml", True), ("https://s/n.xml", False))
def robots_sitemaps(spark):
    return robots.sitemap_lines(spark.createDataFrame([("s", "Sitemap: /m.xml\nsitemap: https://s/n.xml")], "site string, text string"))


@golden("robots_findings", "site:VARCHAR robots_blocks_all:BOOLEAN robots_blocks_assets:BOOLEAN", ("s", True, True), ("t", False, False), keys=("s", "t"))
def robots_findings(spark):
    rows = [("s", "*", False, "/"), ("s", "*", False, "/_astro/"), ("t", "*", False, "/x")]
    return issues.robots_findings(spark.createDataFrame(rows, "site string, agent string, allow boolean, pattern string"), ~F.col("site").startswith("s"))


@golden("link_findings", "key:VARCHAR url:VARCHAR n:BIGINT", ("utm_internal", "https://a.b/x?utm_a=1", 1), ("variant_links", "http://a.b/y", 1), ("nofollow_internal", "https://a.b/z", 2))
def link_findings(spark):
    rows = [("s", 1, "https://a.b/x?utm_a=1", ""), ("s", 2, "http://a.b/y", ""), ("s", 3, "https://a.b/z", "nofollow"), ("s", 4, "https://a.b/z", "nofollow"), ("s", 5, "https://c.d/", "nofollow")]
    return issues.link_findings(spark.createDataFrame(rows, "site string, seq int, target string, rel string"), spark.createDataFrame([("s", "https://a.b/")], "site string, start string")).select("site", "key", "url", "n")


@golden("canonical_targets", "url:VARCHAR target:VARCHAR t_status:INT", ("a", "b", 404), ("c", "x", None), ("d", "y", 200))
def canonical_targets(spark):
    p = spark.createDataFrame([("s", "a", ["b"], 200, 0, False), ("s", "b", [], 404, 0, False), ("s", "c", ["x"], 200, 0, False), ("s", "d", ["y"], 200, 0, False)], "site string, url string, canonicals array<string>, final_status int, redirect_hops int, noindex boolean")
    checked = spark.createDataFrame([("s", "y", 200, 0, False)], "site string, target string, t_status int, t_hops int, t_noindex boolean")
    return links.canonical_targets(p, checked).select("site", "url", "target", "t_status")


@golden("skipped_headings", "pos:INT previous:INT level:INT", (1, 1, 3), key="url", keys=("u",))
def skipped_headings(spark):
    h = spark.createDataFrame([("u", 1, 0, 1, "a"), ("u", 1, 1, 3, "b"), ("u", 2, 2, 2, "c")], "url string, landmark int, pos int, level int, text string")
    return history.skipped_headings(h).select("url", "pos", "previous", "level")


@golden("correction_cautions", "sheet_id:VARCHAR cautions:VARCHAR", ("a", "tester en préproduction, commande destructrice"), ("b", "relire à deux"), ("c", ""), key="sheet_id", keys=("a", "b", "c"))
def correction_cautions(spark):
    rows = [("a", "Sécurité", "haute", "git push --force"), ("b", "GEO", "critique", "x"), ("c", "GEO", "basse", "reinforce")]
    return findings.cautions(spark.createDataFrame(rows, "sheet_id string, domain string, severity string, body string")).select("sheet_id", F.array_join("cautions", ", ").alias("cautions"))


@golden("capped_score", "site:VARCHAR score:BIGINT capped:BOOLEAN grade:VARCHAR", ("s", 49, True, "D"), ("t", 93, False, "A"), keys=("s", "t"))
def capped_score(spark):
    s = spark.createDataFrame([("s", "Sécurité", "critique"), ("t", "Contenu", "haute"), ("t", "Contenu", "moyenne")], "site string, domain string, severity string")
    return scores.global_scores(scores.domain_scores(s, spark.createDataFrame([("s", "Performance"), ("t", "GEO")], "site string, domain string")))


_TEXTS = [(1, "IMG_1234.jpg"), (2, "logo"), (3, "Un chat noir"), (4, "a1b2c3d4e5f6"), (5, "10 * 1024"), (6, "audit-2026-03-01"), (7, "max-snippet:50")]


@golden("text_verdicts", "id:INT alt:VARCHAR octets:BIGINT day:VARCHAR snippet:BOOLEAN", (1, "fichier", None, None, False), (2, "generique", None, None, False), (3, None, None, None, False), (4, "identifiant", None, None, False), (5, None, 10240, None, False), (6, None, None, "1er mars 2026", False), (7, None, None, None, True), key=None)
def text_verdicts(spark):
    t, c = spark.createDataFrame(_TEXTS, "id int, t string"), F.col("t")
    return t.select("id", text.suspicious_alt(c).alias("alt"), text.octets(c).alias("octets"), text.long_date(text.audit_date(c)).alias("day"), text.max_snippet(c).alias("snippet"))


@golden("resolved_links", "href:VARCHAR target:VARCHAR", ("../c?k#l", "http://s.com/c?k"), ("?x", "http://s.com/a/b?x"), ("//T.org", "http://t.org/"), ("d/./e/../f", "http://s.com/a/d/f"), key=None)
def resolved_links(spark):
    t = spark.createDataFrame([("../c?k#l",), ("?x",), ("//T.org",), ("d/./e/../f",)], "href string").withColumn("whole", urls.resolved(F.lit("http://s.com/a/b"), F.col("href")))
    return t.select("href", urls.normalized(F.col("whole")).alias("target"))


@golden("public_urls", "id:INT url:VARCHAR", (1, "https://a.b/x?page=2&token=…88d4#z"), (2, "https://a.b/"), key=None)
def public_urls(spark):
    t = spark.createDataFrame([(1, "https://me:pw@a.b/x?page=2&token=abcd#z"), (2, "https://a.b/")], "id int, u string")
    return t.select("id", urls.public_url(F.col("u")).alias("url"))


# Structured data and headings that every third, and every fifth, page gets; one organisation with two names, one price that the page shows
# and one that it lacks.
_JSONLD = """<p>Prix : 1 234,50 EUR</p><script type="application/ld+json">[{"@type":"Organization","@id":"#o","name":"A","sameAs":["x"]},{"@graph":[{"@type":["Organization"],"@id":"#o","url":"u","name":"B"}]},
{"@type":"WebPage","mainEntity":{"@type":"Product","name":"p","offers":{"price":"1234.50"}}},{"@type":"Product","name":"q","offers":{"price":"98765.43"}},{"@type":"Article","headline":"h","author":"z"}]</script>"""
_TOLD = f"replace(html, '<article>', CASE WHEN page_id % 3 = 0 THEN '{_JSONLD}' ELSE '' END || CASE WHEN page_id % 5 = 0 THEN '<section><h2>Comment ?</h2><h4>Saut</h4></section>' ELSE '' END || '<article>')"
_SITES = f"sit AS (SELECT {_f(HOST, 'url')} AS site, url, page_id % 3 = 0 AND contains(html, '<article>') AS told, page_id % 5 = 0 AND contains(html, '<article>') AS asks, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h1 FROM pages)"


def over_pages(name: str, sql: str):
    SQL[name] = f"WITH {_SITES} {sql}"

    def add(f):
        def run(spark, sf_dir):
            read = stored(html.parsed(pages_of(spark, sf_dir).selectExpr("page_id", "url", f"{_TOLD} AS html")), "parsed")
            return f(read, html.elements(read))

        QUERIES[name] = run
        return f

    return add


@over_pages("jsonld_types", "SELECT site, type, n * count(*)::BIGINT AS n FROM sit CROSS JOIN (VALUES ('Organization', 2), ('Product', 2), ('Article', 1), ('WebPage', 1)) t(type, n) WHERE told GROUP BY site, type, n")
def jsonld_types(read, items):
    return geo.type_counts(html.jsonld(items))


@over_pages("entity_findings", "SELECT site, CASE WHEN bool_or(told) THEN 'marque_incoherente' ELSE 'entite_absente' END AS key FROM sit GROUP BY site")
def entity_findings(read, items):
    return geo.entity_findings(read.select("site").distinct(), html.jsonld(items))


@over_pages("article_findings", "SELECT site, url, 'article_sans_date' AS key FROM sit WHERE told")
def article_findings(read, items):
    return geo.article_findings(html.jsonld(items))


@over_pages("prices_not_shown", "SELECT site, url, 98765.43::DOUBLE AS price FROM sit WHERE told")
def prices_not_shown(read, items):
    from lanternfish.operators.structured import page_texts

    return geo.prices_not_shown(html.jsonld(items), page_texts(html.lines(read)))


@over_pages("skipped_heading_pages", "SELECT site, url, 'h2 > h4' AS jump FROM sit WHERE asks")
def skipped_heading_pages(read, items):
    t = history.skipped_headings(html.headings(items))
    return t.select("site", "url", F.concat(F.lit("h"), F.col("previous").cast("string"), F.lit(" > h"), F.col("level").cast("string")).alias("jump"))


@over_pages("merged_identities", "SELECT site, url, '#o' AS id, 'A' AS name, 'u' AS address FROM sit WHERE told")
def merged_identities(read, items):
    """Objects of a page that share an `@id`, as one: the first name, and the address that only the second gives."""
    from lanternfish.operators.structured import merged, objects

    given = F.col("given")
    return merged(objects(items)).select("site", "url", "id", given["name"].alias("name"), given["url"].alias("address"))


@golden("question_share", "site:VARCHAR questions:BIGINT pages:BIGINT few:BOOLEAN", ("s", 0, 1, True), ("t", 1, 1, False), keys=("s", "t"))
def question_share(spark):
    heads = spark.createDataFrame([("s", "Un titre"), ("t", "Comment ?")], "site string, text string")
    return geo.question_share(heads, spark.createDataFrame([("s", "u"), ("t", "u")], "site string, url string"))


@golden("llms_files", "site:VARCHAR there:BOOLEAN title:BOOLEAN quote:BOOLEAN sections:INT links:INT", ("s", True, True, True, 1, 2), ("t", False, False, False, 0, 0), ("u", False, False, False, 0, 0), keys=("s", "t", "u"))
def llms_files(spark):
    rows = [("s", 200, "# Site\n> court\n## Docs\n- [a](https://s/a)\n- [b](https://s/b)\n"), ("t", 404, "# x"), ("u", 200, "<!doctype html># x")]
    return geo.llms_files(spark.createDataFrame(rows, "site string, status int, text string")).withColumnRenamed("exists", "there")


@golden("audit_validity", "site:VARCHAR missing:VARCHAR valid:BOOLEAN", ("s", "geo", False), ("t", "", True), keys=("s", "t"))
def audit_validity(spark):
    rows = [("s", "crawl", True), ("s", "geo", False), ("t", "crawl", True), ("t", "geo", True)]
    return geo.audit_validity(spark.createDataFrame(rows, "site string, step string, ok boolean"), ("crawl", "geo"))


def _signals(spark):
    audits = [("s", "crawl", "title_missing", "Titre absent", "haute", None, 7, [f"/p{k}" for k in range(7)], 1), ("s", "rendu", "noms", "Sans nom", "moyenne", "Contenu", 2, ["/a"], 2), ("s", "terrain", "lcp", "LCP lent", "basse", "Autre", 1, [], 3)]
    code = [("s", "moyenne", "seo", "site non défini", "le définir", ["a.mjs:1"], 1), ("s", "info", "x", "divers", "", [], 2)]
    runs = [("s", 1, "mobile", 0, "img", "Images", None, 1200, 51200), ("s", 1, "mobile", 1, "cls-insight", "Décalage", 0, None, None), ("s", 1, "mobile", 2, "zero", "Rien", 1, 0, 0), ("s", 1, "mobile", 6, "late", "Tard", None, 900, None), ("s", 2, "desktop", 0, "img", "Images", None, 10, None)]
    failures = [("s", 1, "accessibility", 0, "Contraste"), ("s", 2, "accessibility", 0, "Contraste"), ("s", 1, "best-practices", 1, "Console")]
    project = [("s", k, f"| p{k:02d} | 1 | 2 | ⚠️ oui |") for k in range(12)] + [("s", 20, "- **high** : 2 failles"), ("s", 21, "- ❌ pas de **lockfile**"), ("s", 22, "| a | ⚠️ b |"), ("s", 23, "- ✅ bien")]
    lines = [("s", 1, "| /.env | ❌ exposé |"), ("s", 2, "rien")]
    return findings.union_all(
        findings.from_audits(spark.createDataFrame(audits, "site string, source string, key string, label string, severity string, domain string, count int, examples array<string>, seq bigint")),
        findings.from_geo(spark.createDataFrame([("s", "basse", "llms.txt absent", 1)], "site string, severity string, text string, seq bigint")),
        findings.from_code(spark.createDataFrame(code, "site string, severity string, category string, text string, hint string, places array<string>, seq bigint")),
        findings.from_runs(spark.createDataFrame(runs, "site string, run int, strategy string, pos int, id string, title string, score int, gain_ms int, gain_octets int")),
        findings.from_failures(spark.createDataFrame(failures, "site string, run int, category string, pos int, title string")),
        findings.from_project(spark.createDataFrame(project, "site string, pos int, line string")),
        findings.from_lines(spark.createDataFrame(lines, "site string, pos int, line string"), "securite", "Sécurité"),
    )


@golden(
    "report_signals", "source:VARCHAR severity:VARCHAR domain:VARCHAR text:VARCHAR n_examples:BIGINT",
    ("crawl", "haute", "SEO technique", "Titre absent — 7", 5), ("rendu", "moyenne", "Contenu", "Sans nom — 2", 1), ("terrain", "basse", "Performance", "LCP lent — 1", 0), ("geo", "basse", "GEO / IA", "llms.txt absent", 0),
    ("code", "moyenne", "SEO technique", "site non défini → le définir", 1), ("code", "info", "Code", "divers", 0), ("lighthouse", "haute", "Performance", "Images (gain estimé 1200 ms + 50 Ko, mobile)", 0), ("lighthouse", "basse", "Performance", "Décalage (mobile)", 0),
    ("lighthouse", "moyenne", "Accessibilité", "Lighthouse : Contraste", 0), ("lighthouse", "moyenne", "Bonnes pratiques", "Lighthouse : Console", 0), ("projet", "haute", "Code", "high : 2 failles", 0), ("projet", "haute", "Code", "❌ pas de lockfile", 0), ("projet", "basse", "Code", "a · ⚠️ b", 0),
    ("projet", "basse", "Code", "12 dépendance(s) avec saut de version majeure : " + ", ".join(f"p{k:02d}" for k in range(10)) + ", … et 2 autres", 11), ("securite", "haute", "Sécurité", "/.env | exposé", 0),
)
def report_signals(spark):
    s = _signals(spark)
    return s.select("site", "source", "severity", "domain", "text", F.coalesce(F.size("examples"), F.lit(0)).cast("bigint").alias("n_examples"))


@golden(
    "correction_index", "part:VARCHAR place:VARCHAR id:VARCHAR severity:VARCHAR n_signals:BIGINT",
    ("corrections", "01", "seo-titres", "haute", 1), ("corrections", "02", "paquets", "haute", 2), ("corrections", "03", "images", "haute", 1), ("sans_fiche", "1 Code projet - **high** : 2 failles", "- **high** : 2 failles", "haute", None), ("sans_fiche", "3 GEO / IA geo llms.txt absent", "llms.txt absent", "basse", None),
)
def correction_index(spark):
    """The index of a plan over the signals of four sources, with sheets for three of them."""
    wanted = F.col("text").rlike("^(Titre absent|Images|12 dépendance|❌ pas|high|llms)")
    s = _signals(spark).filter(wanted)
    sheets = spark.spark.createDataFrame([("seo-titres", "Titres", "Contenu", None, "S"), ("images", "Images", "Performance", None, "M"), ("paquets", "Paquets", "Code", None, "M"), ("seule", "Seule", "Code", None, "L")], "sheet_id string, title string, domain string, sheet_severity string, effort string")
    triggers = spark.spark.createDataFrame([("seo-titres", "crawl", "title_missing"), ("images", "lighthouse", "^img"), ("paquets", "projet", "lockfile|obsolètes")], "sheet_id string, source string, pattern string")
    hits = findings.matched(s, triggers)
    rows = findings.index_rows(findings.corrections(hits, sheets), hits, findings.unmatched(s, hits), sheets, triggers).filter("part <> 'sans_detection'")
    return rows.select("site", "part", "place", F.coalesce(F.get_json_object("entry", "$.id"), F.get_json_object("entry", "$.cle")).alias("id"), F.get_json_object("entry", "$.severite").alias("severity"), F.when(F.col("part") == "corrections", F.size(F.from_json(F.get_json_object("entry", "$.signaux"), "array<string>")).cast("bigint")).alias("n_signals"))
