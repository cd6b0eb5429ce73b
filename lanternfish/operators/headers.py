"""Response headers: security and cache verdicts, content security policies, cookies, exposure probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish.functions import text

#: key, severity, and the predicate over h (map of lower-case header names) and row columns that shows the defect.
HEADER_RULES = (
    ("compression_absente", "moyenne", "coalesce(h['content-encoding'], '') NOT RLIKE '(?i)br|gzip|zstd'"),
    ("html_lourd", "basse", "bytes > 150000"),
    ("cache_control_absent", "basse", "h['cache-control'] IS NULL"),
    ("version_serveur", "basse", "coalesce(h['server'], '') RLIKE '[0-9]+[.][0-9]+' OR h['x-powered-by'] IS NOT NULL"),
    ("csp_absente", "moyenne", "h['content-security-policy'] IS NULL"),
    ("hsts_absent", "moyenne", "https AND h['strict-transport-security'] IS NULL"),
    ("nosniff_absent", "basse", "lower(coalesce(h['x-content-type-options'], '')) <> 'nosniff'"),
    ("referrer_policy_absente", "basse", "h['referrer-policy'] IS NULL"),
    ("permissions_policy_absente", "info", "h['permissions-policy'] IS NULL"),
    ("xfo_absent", "basse", "h['x-frame-options'] IS NULL AND NOT contains(coalesce(h['content-security-policy'], ''), 'frame-ancestors')"),
    ("coop_absent", "info", "h['cross-origin-opener-policy'] IS NULL"),
)


def header_findings(responses: DataFrame, rules=HEADER_RULES) -> DataFrame:
    """site, url, key, severity. responses: site, url, bytes, headers map<string, string>."""
    r = responses.withColumn("h", F.transform_keys("headers", lambda k, v: F.lower(k))).withColumn("https", F.col("url").startswith("https:"))
    hit = [F.when(F.expr(rule), F.struct(F.lit(k).alias("key"), F.lit(s).alias("severity"))) for k, s, rule in rules]
    return r.select("site", "url", F.explode(F.array_compact(F.array(*hit))).alias("f")).select("site", "url", "f.key", "f.severity")


def asset_findings(assets: DataFrame) -> DataFrame:
    """site, url, key, severity for static files. assets: site, url, bytes, cache_control, encoding."""
    name, ext = F.regexp_extract("url", r"([^/?#]+)(?:[?#].*)?$", 1), F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    cc = F.col("cache_control")
    one = lambda when, key, severity: F.when(when, F.struct(F.lit(key).alias("key"), F.lit(severity).alias("severity")))
    found = F.array(
        one(text.is_hashed_name(name) & ~F.coalesce(F.lower(cc).rlike("immutable"), F.lit(False)), "hache_sans_immutable", "basse"),
        one(text.is_uncached(cc) & cc.isNotNull(), "asset_sans_cache", "moyenne"), one(cc.isNull() | text.is_briefly_cached(cc), "cache_court", "basse"),
        one(ext.isin("js", "mjs", "css", "svg") & (F.coalesce("encoding", F.lit("")) == "") & (F.col("bytes") > 1400), "non_compresse", "moyenne"),
        one(ext.isin("jpg", "jpeg", "png", "gif", "webp", "avif") & (F.col("bytes") > 200_000), "image_lourde", "moyenne"),
        one(ext.isin("js", "mjs") & (F.col("bytes") > 150_000), "js_lourd", "moyenne"),
    )
    return assets.select("site", "url", F.explode(F.array_compact(found)).alias("f")).select("site", "url", "f.key", "f.severity")


def _sources(policy: Column, name: str) -> Column:
    d = text.directives(policy)
    return F.coalesce(F.element_at(d, name), F.element_at(d, "default-src"))


def policy_findings(responses: DataFrame) -> DataFrame:
    """site, url, key of script defects that every restricting policy of a page has, and of missing base-uri and object-src.

    responses: site, url, policies array<string>. All policies apply, so one that forbids is enough.
    """
    script = lambda p: _sources(p, "script-src")
    strict = lambda p: F.exists(script(p), lambda s: s.rlike("^'(nonce-|sha(256|384|512)-|strict-dynamic)"))
    restricting = F.filter("policies", lambda p: script(p).isNotNull())
    every = lambda bad: (F.size(restricting) > 0) & F.forall(restricting, bad)
    hold = lambda value: lambda p: F.array_contains(script(p), value)
    one = lambda when, key: F.when(when, F.lit(key))
    found = F.array(
        one(F.size(restricting) == 0, "csp_sans_script"),
        one(every(lambda p: F.array_contains(script(p), "'unsafe-inline'") & ~strict(p)), "csp_unsafe_inline"), one(every(hold("'unsafe-eval'")), "csp_unsafe_eval"),
        one(every(lambda p: F.exists(script(p), lambda s: s.isin("*", "http:", "https:", "data:"))), "csp_joker"),
        one(~F.exists("policies", lambda p: F.map_contains_key(text.directives(p), "base-uri")), "csp_sans_base_uri"),
        one(~F.exists("policies", lambda p: _sources(p, "object-src").isNotNull()), "csp_sans_object_src"),
    )
    return responses.filter("size(policies) > 0").select("site", "url", F.explode(F.array_compact(found)).alias("key"))


# Names of cookies by purpose.
SESSION = r"(?i)session|sessid|(^|[^a-z])sid($|[^a-z])|[a-z]sid$|auth(?!or)|token|jwt"
CSRF = r"(?i)csrf|xsrf"
ANALYTICS = r"(?i)^(_ga|_gid|_gat|_gcl_|_gac_|_fbp|_fbc|_hj|_pk_|__utm|_clck|_clsk|ajs_|amplitude|mp_|_uet|_scid|_ttp|_tt_|_pin_|_dc_gtm|__hs|hubspotutk|_vwo|_pendo|_cs_|_lr_)"


def cookie_findings(cookies: DataFrame) -> DataFrame:
    """site, name, kind, key, severity. cookies: site, https, cookie (a Set-Cookie value)."""
    name = F.trim(F.split_part("cookie", F.lit("="), F.lit(1)))
    kind = F.when(name.rlike(CSRF), "csrf").when(name.rlike(ANALYTICS), "mesure").when(name.rlike(SESSION), "session").otherwise("autre")
    flags = F.transform(F.slice(F.split("cookie", ";"), 2, 1000), lambda p: F.lower(F.trim(p)))
    c = cookies.select("site", "https", name.alias("name"), kind.alias("kind"), flags.alias("flags"))
    has = lambda f: F.array_contains("flags", f)
    starts = lambda p: F.exists("flags", lambda x: x.startswith(p))
    severity = F.when(F.col("kind") == "session", "haute").when(F.col("kind") == "mesure", "info").otherwise("basse")
    one = lambda when, key, s=severity: F.when(when, F.struct(F.lit(key).alias("key"), s.alias("severity")))
    host, secure = F.col("name").startswith("__Host-"), F.col("name").startswith("__Secure-")
    found = F.array(
        one(F.col("https") & ~has("secure"), "cookie_sans_secure"), one(~has("httponly") & ~F.col("kind").isin("csrf", "mesure"), "cookie_sans_httponly"),
        one(~starts("samesite="), "cookie_sans_samesite"), one(starts("samesite=none") & ~has("secure"), "cookie_none_sans_secure", F.lit("haute")),
        one((host & (~has("secure") | starts("domain=") | ~has("path=/"))) | (secure & ~has("secure")), "cookie_prefixe_invalide", F.lit("moyenne")),
    )
    return c.select("site", "name", "kind", F.explode(F.array_compact(found)).alias("f")).select("site", "name", "kind", "f.key", "f.severity")


# Paths that must not be served, what their content would show (case aside; empty: nothing proves it), and how grave it is.
PROBES = (
    ("/.env", "^[A-Z_]+=|CONVEX_|SECRET|API_KEY|TOKEN", "critique"), ("/.env.local", "^[A-Z_]+=", "critique"), ("/.env.production", "^[A-Z_]+=", "critique"), ("/.git/HEAD", "^ref: refs/", "critique"),
    ("/.git/config", r"\[core\]", "critique"), ("/.npmrc", "_authToken|registry", "haute"), ("/.DS_Store", "Bud1", "basse"), ("/package.json", '"dependencies"', "moyenne"), ("/package-lock.json", '"lockfileVersion"', "basse"),
    ("/astro.config.mjs", "defineConfig", "moyenne"), ("/astro.config.ts", "defineConfig", "moyenne"), ("/convex/schema.ts", "defineSchema", "moyenne"), ("/src/pages/index.astro", "---", "moyenne"),
    ("/dist/server/entry.mjs", "import", "haute"), ("/server/entry.mjs", "import", "haute"), ("/Dockerfile", "FROM ", "basse"), ("/docker-compose.yml", "services:", "moyenne"), ("/backup.zip", "", "haute"),
    ("/backup.sql", "INSERT INTO|CREATE TABLE", "critique"), ("/dump.sql", "INSERT INTO|CREATE TABLE", "critique"), ("/db.sqlite", "SQLite format", "critique"), ("/__vite_ping", "", "moyenne"),
    ("/@vite/client", "import.meta.hot|vite", "haute"), ("/phpinfo.php", r"phpinfo\(\)|PHP Version", "haute"), ("/server-status", "Apache Server Status", "moyenne"), ("/wp-login.php", "wp-submit|user_login", "info"),
    ("/xmlrpc.php", "XML-RPC", "info"), ("/wp-content/debug.log", "PHP (Warning|Notice|Fatal)", "haute"),
)


def probe_verdicts(responses: DataFrame) -> DataFrame:
    """site, path, severity, verdict of the probed paths: `expose` if the content proves it, `generique` for a page served in its
    place, `a_verifier` for other answers with 200, `ferme` else. responses: site, path, status, body."""
    spark = responses.sparkSession
    rules = spark.createDataFrame(PROBES, "path string, pattern string, severity string")  # one row for each of PROBES
    fine = F.coalesce(F.col("status") == 200, F.lit(False))
    shown = (F.col("pattern") != "") & F.coalesce(F.expr("body rlike concat('(?im)', pattern)"), F.lit(False))
    page = F.coalesce(F.col("body").rlike("(?i)<html|<!doctype"), F.lit(False))
    verdict = F.when(~fine, "ferme").when(shown, "expose").when(page, "generique").otherwise("a_verifier")
    return responses.join(F.broadcast(rules), "path").select("site", "path", "severity", verdict.alias("verdict"))


def exposures(responses: DataFrame) -> DataFrame:
    """site, path, severity of probes that answer 200 with what must not be there. responses: site, path, status, body."""
    return probe_verdicts(responses).filter("verdict = 'expose'").drop("verdict")


def security_txt(responses: DataFrame) -> DataFrame:
    """site, verdict of /.well-known/security.txt: `present` with a Contact field, `absent` for 200 without one, 404 and 410, else `inconnu`."""
    rows = responses.filter("path = '/.well-known/security.txt'")
    has = F.coalesce(F.col("body").rlike("(?im)^contact:"), F.lit(False))
    return rows.select("site", F.when((F.col("status") == 200) & has, "present").when(F.col("status").isin(200, 404, 410), "absent").otherwise("inconnu").alias("verdict"))


def soft_404(answers: DataFrame) -> DataFrame:
    """Segments under which an invented page answers 200. answers: site, segment, status."""
    return answers.filter("status = 200").select("site", "segment").distinct()


# Words of pages that stand between a crawler and what it asked for.
CHALLENGES = r"(?i)just a moment|cf-browser-verification|challenge-platform|attention required|captcha|access denied|request blocked|sucuri website firewall|wordfence"


def blocked_access(live: DataFrame) -> DataFrame:
    """site, agent, why: crawlers that are refused, challenged (where the reference is not), or served under 30 % of the reference body.

    live: site, agent, status, bytes, body; the reference is the row of agent `reference`.
    """
    ref = live.filter("agent = 'reference'").select("site", F.col("bytes").alias("ref_bytes"), F.coalesce(F.col("body").rlike(CHALLENGES), F.lit(False)).alias("ref_challenged"))
    why = (
        F.when(F.col("status").isin(401, 403, 406, 429, 503), "statut").when(F.col("body").rlike(CHALLENGES) & ~F.coalesce("ref_challenged", F.lit(False)), "defi")
        .when(F.col("bytes") < 0.3 * F.col("ref_bytes"), "corps_reduit")
    )
    return live.filter("agent <> 'reference'").join(ref, "site", "left").select("site", "agent", why.alias("why")).filter("why IS NOT NULL")
