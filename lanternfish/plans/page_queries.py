"""Registered queries over the crawled pages, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.functions import text, urls
from lanternfish.operators import geo, history, issues, links, reports, resources, robots, site_issues
from lanternfish.plans.tables import stored
from lanternfish.sources import bodies, html
from lanternfish.sources import pages as source

QUERIES, SQL = {}, {}

# SQL pieces that several queries share.
HOST = "regexp_replace(regexp_replace(lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', '')"
PATH = "regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
QUERY = r"regexp_extract({0}, '^[^?#]*\?([^#]*)', 1)"
SCHEME = "lower(regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"
PLACE = "regexp_replace(lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', '')"
NORMALIZED = (
    f"CASE WHEN {SCHEME} IN ('http', 'https') AND {HOST} <> '' THEN {SCHEME} || '://' || regexp_replace({PLACE}, CASE WHEN {SCHEME} = 'http' THEN ':80$' ELSE ':443$' END, '')"
    f" || CASE WHEN {PATH} = '' THEN '/' ELSE {PATH} END || CASE WHEN {QUERY} <> '' THEN '?' || {QUERY} ELSE '' END END"
)


def _f(piece: str, column: str) -> str:
    return piece.replace("{0}", column)


TAG = r"""regexp_extract(html, '(?is)<{0}[^>]*\s{1}="([^"]*)"', 1)"""
META = r"""trim(regexp_extract(html, '(?is)<meta [^>]*(name|property)="{0}"[^>]*content="([^"]*)"', 2))"""
IMAGES = r"regexp_extract_all(html, '(?is)<img\b[^>]*>')"
JSONLD = r"""regexp_extract_all(html, '(?is)<script [^>]*application/ld\+json[^>]*>(.*?)</script>', 1)"""
PLAIN = "replace(replace(regexp_replace(regexp_replace({0}, '&quot;?', '\"', 'g'), '&amp;?', '&', 'g'), '&middot;', '·'), '&copy;', '©')"
_TITLE = r"trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\s+', ' ', 'g'))"
RECORDS = rf"""
rec AS (SELECT {_f(HOST, "url")} AS site, url, page_id AS seq, {_f(PLAIN, _TITLE)} AS title,
    [{_f(PLAIN, "trim(x)")} for x in regexp_extract_all(html, '(?s)<h1>(.*?)</h1>', 1)] AS h1, len(regexp_extract_all(html, '<h1'))::INT AS n_h1, {TAG.replace("{0}", "html").replace("{1}", "lang")} AS lang,
    len(regexp_extract_all(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '(?s)<[^>]*>', ' ', 'g'), '\S+'))::BIGINT AS content_words, strlen(html)::BIGINT AS bytes_html,
    {_f(META, "description")} AS meta_description, regexp_matches(html, '<meta name="viewport"') AS viewport, regexp_matches(html, '<meta property="og:title"') AS og_title, regexp_matches(html, '<meta property="og:image"') AS og_image,
    lower({_f(META, "robots")}) AS meta_robots, regexp_extract_all(html, '<link rel="canonical" href="([^"]*)"', 1) AS canonicals, regexp_extract_all(html, '<link rel="alternate" hreflang="[^"]*" href="([^"]*)"', 1) AS hreflang,
    len({JSONLD})::INT AS n_jsonld, len([x for x in {JSONLD} if NOT json_valid(x)])::INT AS jsonld_errors, len([x for x in {IMAGES} if NOT contains(x, ' alt=')])::BIGINT AS imgs_no_alt,
    len([x for x in {IMAGES} if NOT (contains(x, ' width=') AND contains(x, ' height='))])::BIGINT AS imgs_no_dims, coalesce(contains({IMAGES}[1], 'loading="lazy"'), FALSE) AS lazy_first_img,
    len([x for x in regexp_extract_all(html, '<input type="text"[^>]*>') if NOT regexp_matches(x, ' (id|aria-label)=')])::BIGINT AS form_fields_no_label,
    CASE WHEN url LIKE 'https://%' THEN len(regexp_extract_all(html, '<(img|script|iframe) [^>]*src="http://')) ELSE 0 END AS n_mixed FROM pages)"""
JUDGED = f"""
jud AS (SELECT *, NOT noindex AND coalesce(canonical = url, TRUE) AS indexable FROM (SELECT *, 200 AS final_status, 0 AS redirect_hops, NULL::INT AS status, TRUE AS is_html, contains(meta_robots, 'noindex') AS noindex,
    len(list_distinct(canonicals)) AS n_canonicals, canonicals[1] AS canonical, len(hreflang) AS n_hreflang, len([x for x in hreflang if {_f(NORMALIZED, "x")} = {_f(NORMALIZED, "url")}]) > 0 AS hreflang_self,
    NULL::DOUBLE AS ttfb, NULL::INT AS depth, NULL::BIGINT AS inlinks,
    regexp_matches({_f(PATH, "url")}, '[A-Z]') OR contains({_f(PATH, "url")}, '_') OR length(url) > 115 AS unclean, {_f(QUERY, "url")} <> '' AS has_query FROM rec))"""
VIOLATIONS = "vio AS (" + " UNION ALL ".join(f"SELECT site, '{k}' AS key, '{s}' AS severity, seq, url, ({n})::BIGINT AS n FROM jud WHERE ({scope}) AND ({rule})" for k, s, scope, rule, n in issues.PAGE_RULES) + ")"
LINKS = rf"""
raw AS (SELECT url, page_id AS seq, unnest(range(1, len(l) + 1)) AS pos, l FROM (SELECT url, page_id, regexp_extract_all(html, '(?s)<a\s[^>]*>.*?</a>') AS l FROM pages)),
lnk AS (SELECT {_f(HOST, "url")} AS site, url AS src, seq, pos - 1 AS pos, regexp_extract(l[pos], 'href="([^"]*)"', 1) AS href,
    substr(trim(regexp_replace(l[pos], '(?s)<[^>]*>', '', 'g')), 1, 120) AS text, {_f(SCHEME, "url")} || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) AS base FROM raw),
lk AS (SELECT site, src, seq, pos, href, text, {_f(NORMALIZED, "(base || href)")} AS target FROM lnk WHERE href <> '' AND NOT regexp_matches(href, '^(mailto:|tel:|javascript:|#|data:)'))"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def records_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.completed(html.page_records(html.parsed(pages_of(spark, sf_dir))))


def addresses_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.addresses(pages_of(spark, sf_dir))


# Heads and bodies with every fact that page rules read, by the page's id and url, so that the same rules meet both cases at full size.
HEADS = (
    ("page_id % 2 = 0", '<meta name="viewport" content="width=device-width">'), ("page_id % 3 = 0", '<meta name="description" content="what this page says to those who search for it, in some seventy letters">'),
    ("page_id % 3 = 1", '<meta name="description" content="short">'), ("page_id % 5 < 3", '<meta property="og:title" content="t"><meta property="og:image" content="/i.png">'),
    ("page_id % 7 = 0", '<meta name="robots" content="noindex, follow">'), ("page_id % 4 = 1", '<link rel="canonical" href="{url}">'), ("page_id % 4 = 2", '<link rel="canonical" href="https://other.example.org/">'),
    ("page_id % 8 = 5", '<link rel="canonical" href="/second">'), ("page_id % 6 = 0", '<link rel="alternate" hreflang="fr" href="{url}">'), ("page_id % 6 = 1", '<link rel="alternate" hreflang="fr" href="/fr/">'),
    ("page_id % 3 < 2", '<script type="application/ld+json">{"@type": "WebPage", "name": "x"}</script>'), ("page_id % 11 = 0", '<script type="application/ld+json">{"@type": </script>'),
)
BODIES = (
    ("page_id % 5 = 1", '<img loading="lazy" src="/a.png"><img src="/b.png" alt="" width="1" height="1">'), ("page_id % 5 = 2", '<img src="http://cdn.example.org/a.png" alt="a">'),
    ("page_id % 9 = 0", '<input type="text"><input type="text" id="q"><input type="hidden">'), ("page_id % 10 = 0", "<h1>Second</h1>"),
)


def _inserted(parts) -> str:
    """SQL of both engines for the parts whose condition holds."""
    return " || ".join(f"CASE WHEN {when} THEN replace('{part}', '{{url}}', url) ELSE '' END" for when, part in parts)


RICH = f"page_id, url, replace(replace(html, '</head>', {_inserted(HEADS)} || '</head>'), '<article>', {_inserted(BODIES)} || '<article>') AS html"


def rich_pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_of(spark, sf_dir).selectExpr(*[RICH[: RICH.index(", replace(")].split(", ")[0], "url", RICH[RICH.index("replace(") :]])


@query("url_parts", f"""
SELECT page_id, {_f(NORMALIZED, "url")} AS normalized, {_f(SCHEME, "url")} AS scheme, {_f(HOST, "url")} AS host, {_f(PATH, "url")} AS path, {_f(QUERY, "url")} AS query,
       regexp_extract({_f(PATH, "url")}, '^/([^/]*)', 1) AS segment, regexp_matches({_f(QUERY, "url")}, '(?i)(^|&)utm_') AS utm,
       regexp_matches({_f(PATH, "url")}, '[A-Z]') OR contains({_f(PATH, "url")}, '_') OR length(url) > 115 AS unclean,
       NOT regexp_matches({_f(PATH, "url")}, '(?i)[.]({urls.SKIPPED_EXTENSIONS})$') AND NOT regexp_matches({_f(PATH, "url")}, '(?i){urls.SKIPPED_PATHS}') AND NOT regexp_matches({_f(QUERY, "url")}, '(?i){urls.SKIPPED_QUERY}') AS crawlable,
       regexp_replace({_f(HOST, "url")}, '^www\\.', '') || regexp_replace({_f(PATH, "url")}, '/+$', '') || '?' || {_f(QUERY, "url")} AS equivalence FROM pages""")
def url_parts(spark, sf_dir):
    u = F.col("url")
    return pages_of(spark, sf_dir).select(
        "page_id", urls.normalized(u).alias("normalized"), urls.scheme(u).alias("scheme"), urls.host(u).alias("host"), urls.path(u).alias("path"), urls.query(u).alias("query"), urls.segment(u).alias("segment"),
        urls.has_utm(u).alias("utm"), urls.is_unclean(u).alias("unclean"), urls.is_crawlable(u).alias("crawlable"), urls.equivalence_key(u).alias("equivalence"),
    )


SHOWN = ("site", "url", "seq", "title", "n_h1", "lang", "content_words", "bytes_html", "meta_description", "viewport", "og_title", "og_image", "meta_robots", "n_jsonld", "jsonld_errors", "imgs_no_alt", "imgs_no_dims", "lazy_first_img", "form_fields_no_label")
RECORD_SQL = f"SELECT {', '.join(SHOWN)}, h1[1] AS h1, len(canonicals)::INT AS n_canonicals, array_to_string(hreflang, ' ') AS hreflang, n_mixed::INT AS n_mixed FROM rec"


def _shown(records: DataFrame) -> DataFrame:
    robots = F.regexp_replace("meta_robots", "^,|,$", "")
    return records.withColumn("meta_robots", robots).select(*SHOWN, F.get("h1", F.lit(0)).alias("h1"), F.size("canonicals").alias("n_canonicals"), F.array_join("hreflang", " ").alias("hreflang"), F.size("mixed_content").alias("n_mixed"))


@query("page_records", f"WITH {RECORDS} {RECORD_SQL}")
def page_records(spark, sf_dir):
    return _shown(records_of(spark, sf_dir))


RICH_RECORDS = f"rich AS (SELECT {RICH} FROM pages), {RECORDS.replace('FROM pages)', 'FROM rich)')}"


def rich_records_of(spark, sf_dir):
    return source.completed(html.page_records(html.parsed(rich_pages_of(spark, sf_dir))))


@query("rich_records", f"WITH {RICH_RECORDS} {RECORD_SQL}")
def rich_records(spark, sf_dir):
    return _shown(rich_records_of(spark, sf_dir))


#: What a fetch would know, by the page's id: every rule of the catalogue meets pages that break it.
FETCHED = {
    "final_status": "CASE WHEN seq % 13 = 0 THEN 404 WHEN seq % 17 = 0 THEN 503 WHEN seq % 19 = 0 THEN -1 ELSE 200 END", "redirect_hops": "CASE WHEN seq % 14 = 1 THEN 2 WHEN seq % 7 = 1 THEN 1 ELSE 0 END",
    "status": "CASE WHEN seq % 21 = 1 THEN 302 WHEN seq % 7 = 1 THEN 301 ELSE 200 END", "ttfb": "CAST(seq % 10 AS DOUBLE) / 8", "depth": "CAST(seq % 6 AS INT)", "inlinks": "CAST(seq % 4 AS BIGINT)",
}
_UNKNOWN = {"final_status": "200", "redirect_hops": "0", "status": "NULL::INT", "ttfb": "NULL::DOUBLE", "depth": "NULL::INT", "inlinks": "NULL::BIGINT"}
FETCHED_JUDGED = JUDGED
for _name, _expr in FETCHED.items():
    FETCHED_JUDGED = FETCHED_JUDGED.replace(f"{_UNKNOWN[_name]} AS {_name}", f"{_expr} AS {_name}")


def fetched_records_of(spark, sf_dir):
    """Records of rich pages with the facts of a fetch."""
    facts = {k: F.expr(v) for k, v in FETCHED.items()}
    return source.completed(html.page_records(html.parsed(rich_pages_of(spark, sf_dir))).withColumns(facts))


@query("rich_violations", f"WITH {RICH_RECORDS}, {FETCHED_JUDGED}, {VIOLATIONS} SELECT * FROM vio")
def rich_violations(spark, sf_dir):
    return issues.violations(fetched_records_of(spark, sf_dir))


@query("rich_issues", f"""
WITH {RICH_RECORDS}, {FETCHED_JUDGED}, {VIOLATIONS}, p AS (SELECT *, row_number() OVER (PARTITION BY site, key ORDER BY seq, url) AS place FROM vio)
SELECT site, key, min_by(severity, place) AS severity, sum(n)::BIGINT AS count, string_agg(url, ' ' ORDER BY place) FILTER (place <= 25) AS examples FROM p GROUP BY site, key""")
def rich_issues(spark, sf_dir):
    """All 36 rules of the catalogue but heavy_html, of which the driver's pages have none."""
    return issues.fold(issues.violations(fetched_records_of(spark, sf_dir)))


@query("description_duplicates", f"""
WITH {RICH_RECORDS}, {JUDGED} SELECT site, 'desc_dup' AS key, 'moyenne' AS severity, min(seq) AS seq, min_by(url, seq) AS url, count(*)::BIGINT AS n, substr(lower(trim(meta_description)), 1, 90) AS value
FROM jud WHERE indexable AND meta_description <> '' GROUP BY site, lower(trim(meta_description)) HAVING count(*) > 1""")
def description_duplicates(spark, sf_dir):
    return issues.duplicates(rich_records_of(spark, sf_dir), "meta_description", "desc_dup")


@query("crawl_violations", f"WITH {RECORDS}, {JUDGED}, {VIOLATIONS} SELECT * FROM vio")
def crawl_violations(spark, sf_dir):
    return issues.violations(records_of(spark, sf_dir))


@query("crawl_issues", f"""
WITH {RECORDS}, {JUDGED}, {VIOLATIONS}, p AS (SELECT *, row_number() OVER (PARTITION BY site, key ORDER BY seq, url) AS place FROM vio)
SELECT site, key, min_by(severity, place) AS severity, sum(n)::BIGINT AS count, string_agg(url, ' ' ORDER BY place) FILTER (place <= 25) AS examples FROM p GROUP BY site, key""")
def crawl_issues(spark, sf_dir):
    return issues.fold(issues.violations(records_of(spark, sf_dir)))


@query("title_duplicates", f"""
WITH {RECORDS}, {JUDGED} SELECT site, 'title_dup' AS key, 'moyenne' AS severity, min(seq) AS seq, min_by(url, seq) AS url, count(*)::BIGINT AS n, substr(lower(trim(title)), 1, 90) AS value
FROM jud WHERE title <> '' GROUP BY site, lower(trim(title)) HAVING count(*) > 1""")
def title_duplicates(spark, sf_dir):
    return issues.duplicates(records_of(spark, sf_dir), "title", "title_dup")


WORDS = f"""
tok AS (SELECT site, seq, url, unnest(list_filter(list_distinct(regexp_extract_all(lower(title || ' ' || coalesce(h1[1], '')), '[a-zà-ÿ0-9]{{3,}}')), lambda w: NOT list_contains([{", ".join(f"'{w}'" for w in text.STOP_WORDS)}], w))) AS token FROM rec),
tot AS (SELECT site, count(*) AS pages FROM rec GROUP BY site),
brd AS (SELECT site, token FROM tok JOIN tot USING (site) GROUP BY site, token, pages HAVING pages > 4 AND count(*) > 0.5 * pages),
wrd AS (SELECT tok.* FROM tok ANTI JOIN brd USING (site, token))"""


@query("title_words", f"WITH {RECORDS}, {WORDS} SELECT site, token, count(*)::BIGINT AS df FROM wrd GROUP BY site, token")
def title_words(spark, sf_dir):
    return issues.title_words(stored(records_of(spark, sf_dir), "records")).groupBy("site", "token").agg(F.count("*").alias("df"))


_NEAR = f"""{WORDS}, siz AS (SELECT site, url, seq, count(*) AS n, string_agg(token, ' ' ORDER BY token) AS words FROM wrd GROUP BY ALL HAVING count(*) >= 2),
cls AS (SELECT *, min(seq) OVER (PARTITION BY site, words) AS class, min_by(url, seq) OVER (PARTITION BY site, words) AS class_url FROM siz),
com AS (SELECT x.site, x.url AS a, y.url AS b, count(*) AS c FROM wrd x JOIN wrd y ON x.site = y.site AND x.token = y.token AND x.seq < y.seq GROUP BY ALL),
par AS (SELECT com.site, a, b, x.class AS ca, y.class AS cb FROM com JOIN cls x ON x.site = com.site AND x.url = a JOIN cls y ON y.site = com.site AND y.url = b WHERE c / (x.n + y.n - c) >= 0.7 - 1e-9),
lnk2 AS (SELECT site, url, count(*) AS links FROM (SELECT site, a AS url FROM par UNION ALL SELECT site, b FROM par) GROUP BY ALL),
prs AS (SELECT site, least(ca, cb) AS class, count(*) AS pairs FROM par GROUP BY ALL),
nea AS (SELECT cls.site, cls.class AS seq, class_url AS url, count(*)::BIGINT AS n, any_value(links)::BIGINT AS links, coalesce(any_value(pairs), 0)::BIGINT AS pairs FROM cls JOIN lnk2 ON lnk2.site = cls.site AND lnk2.url = cls.url LEFT JOIN prs ON prs.site = cls.site AND prs.class = cls.class GROUP BY cls.site, cls.class, class_url)"""


#: By class and url, as the findings about duplicates count them.
_NEAR_CLASSES = f"WITH {RECORDS}, {_NEAR} SELECT * FROM nea"
_NEAR_PAGES = f"""{_NEAR[: _NEAR.index("com AS")]}com AS (SELECT x.site, x.seq AS a, y.seq AS b, count(*) AS c FROM wrd x JOIN wrd y ON x.site = y.site AND x.token = y.token AND x.seq < y.seq GROUP BY ALL),
par AS (SELECT com.site, a, b, x.class AS ca, y.class AS cb, c / (x.n + y.n - c) AS similarity FROM com JOIN cls x ON x.site = com.site AND x.seq = a JOIN cls y ON y.site = com.site AND y.seq = b WHERE c / (x.n + y.n - c) >= 0.7 - 1e-9),
lnk2 AS (SELECT site, seq, count(*) AS links FROM (SELECT site, a AS seq FROM par UNION ALL SELECT site, b FROM par) GROUP BY ALL),
prs AS (SELECT DISTINCT site, least(ca, cb) AS class, greatest(ca, cb) AS other, round(similarity, 6) AS similarity FROM par WHERE ca <> cb)"""


@query("near_titles", f"""
WITH {RECORDS}, {_NEAR_PAGES} SELECT rec.site, rec.seq, rec.url, class, coalesce(links, 0)::BIGINT AS links, NULL::BIGINT AS other, NULL::DOUBLE AS similarity
FROM rec LEFT JOIN cls ON cls.site = rec.site AND cls.seq = rec.seq LEFT JOIN lnk2 ON lnk2.site = rec.site AND lnk2.seq = rec.seq
UNION ALL SELECT prs.site, seq, url, prs.class, NULL, other, similarity FROM prs JOIN rec ON rec.site = prs.site AND rec.seq = prs.class""")
def near_titles(spark, sf_dir):
    """Each page with its class and links, and each pair of near classes."""
    return issues.near_title_pages(stored(records_of(spark, sf_dir), "records")).withColumn("similarity", F.round("similarity", 6))


@query("page_links", f"WITH {LINKS} SELECT site, src, seq, pos, href, target, text FROM lk WHERE target IS NOT NULL")
def page_links(spark, sf_dir):
    return source.links(pages_of(spark, sf_dir)).drop("rel")


@query("inlink_counts", f"WITH {LINKS} SELECT site, target, count(DISTINCT src)::BIGINT AS inlinks, 0::BIGINT AS nofollow FROM lk WHERE src <> target GROUP BY site, target")
def inlink_counts(spark, sf_dir):
    return links.inlinks(source.links(pages_of(spark, sf_dir)))


@query("anchor_texts", f"""
WITH {LINKS}, c AS (SELECT site, target, substr(lower(trim(text)), 1, 80) AS anchor, count(*)::BIGINT AS n, min((seq, pos)) AS f FROM lk WHERE trim(text) <> '' GROUP BY ALL)
SELECT site, target, anchor, n, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY site, target ORDER BY n DESC, f) AS place FROM c) WHERE place <= 10""")
def anchor_texts(spark, sf_dir):
    return links.anchors(source.links(pages_of(spark, sf_dir)))


@query("shared_resources", f"""
WITH {LINKS}, n AS (SELECT site, target AS resource, count(DISTINCT src)::BIGINT AS n_pages, min(src) AS first_page FROM lk GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY site ORDER BY n_pages DESC, resource)::INT AS place FROM n QUALIFY place <= 400""")
def shared_resources(spark, sf_dir):
    return links.resources(source.links(pages_of(spark, sf_dir)).select("site", F.col("src").alias("page"), F.col("target").alias("resource")))


GRAPH = "e AS (SELECT DISTINCT o_orderstatus AS site, o_custkey AS src, o_orderkey % (SELECT count(*) FROM customer) AS url FROM orders)"
DEPTHS = f"""{GRAPH}, v AS (SELECT site, src AS url FROM e UNION SELECT site, url FROM e), b AS (SELECT site, min(url) AS url FROM v GROUP BY site),
w(site, url, depth) USING KEY (site, url) AS (SELECT site, url, 0 FROM b UNION (SELECT e.site, e.url, min(w.depth) + 1 FROM w JOIN e ON e.site = w.site AND e.src = w.url
    WHERE NOT EXISTS (SELECT 1 FROM recurring.w AS r WHERE r.site = e.site AND r.url = e.url) GROUP BY ALL)),
d AS (SELECT v.site, v.url, depth::INT AS depth FROM v LEFT JOIN w USING (site, url))"""


def graph(spark, sf_dir):
    """A link graph of the size of the orders table: customers as pages, order states as sites."""
    n = spark.read.parquet(f"{sf_dir}/customer.parquet").agg(F.count("*").alias("n"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").join(F.broadcast(n))
    edges = o.select(F.col("o_orderstatus").alias("site"), F.col("o_custkey").alias("src"), (F.col("o_orderkey") % F.col("n")).alias("target"))
    nodes = edges.select("site", F.col("src").alias("url")).union(edges.select("site", "target")).distinct()
    return nodes, edges


@query("click_depth", f"WITH RECURSIVE {DEPTHS} SELECT * FROM d")
def click_depth(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    return links.click_depth(nodes, edges, nodes.groupBy("site").agg(F.min("url").alias("url")))


@query("depth_histogram", f"WITH RECURSIVE {DEPTHS} SELECT site, depth, count(*)::BIGINT AS pages FROM d GROUP BY ALL")
def depth_histogram(spark, sf_dir):
    return click_depth(spark, sf_dir).groupBy("site", "depth").agg(F.count("*").alias("pages"))


SITEMAP = f"smp AS (SELECT site, url, seq FROM rec WHERE seq % 3 <> 0)"  # noqa: F541


def sitemap_of(records: DataFrame) -> DataFrame:
    """Two of three pages as the sites' sitemaps."""
    return records.filter("seq % 3 <> 0").select("site", "url", F.lit(None).cast("string").alias("lastmod"))


@query("not_in_sitemap", f"WITH {RECORDS}, {SITEMAP} SELECT site, url, seq FROM rec WHERE site IN (SELECT site FROM smp) AND url NOT IN (SELECT url FROM smp)")
def not_in_sitemap(spark, sf_dir):
    r = records_of(spark, sf_dir)
    return issues.not_in_sitemap(r, sitemap_of(r))


@query("sitemap_targets", f"""
WITH {RECORDS}, {SITEMAP} SELECT site, regexp_replace(url, '^http:', 'https:') AS url, CASE WHEN url LIKE 'http:%' AND regexp_replace(url, '^http:', 'https:') NOT IN (SELECT url FROM rec) THEN 'sitemap_redirect' END AS key FROM smp""")
def sitemap_targets(spark, sf_dir):
    """The sitemap lists every page under https, so the pages that were fetched over http are found by their equivalence key."""
    r = records_of(spark, sf_dir)
    return issues.sitemap_targets(r, sitemap_of(r).withColumn("url", F.regexp_replace("url", "^http:", "https:")))


@query("orphans", f"""
WITH {RECORDS}, {SITEMAP}, {LINKS} SELECT DISTINCT site, url FROM smp WHERE {_f(PATH, "url")} NOT IN ('', '/') AND (site, url) NOT IN (SELECT site, target FROM lk WHERE src <> target AND target IS NOT NULL)""")
def orphans(spark, sf_dir):
    r = records_of(spark, sf_dir)
    return links.orphans(r, sitemap_of(r), links.inlinks(source.links(pages_of(spark, sf_dir))), urls.path(F.col("url")).isin("", "/"))


ROBOTS = "User-agent: *\nDisallow: /fr/\nAllow: /fr/8\nDisallow: /*.html$\n\nUser-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\nAllow: /en/\n# closed\nSitemap: /sitemap.xml\n"
_PATTERNS = (("*", "/fr/", "FALSE", "^/fr/"), ("*", "/fr/8", "TRUE", "^/fr/8"), ("*", "/*.html$", "FALSE", r"^/.*\.html$"), ("gptbot", "/", "FALSE", "^/"), ("gptbot", "/en/", "TRUE", "^/en/"))


@query("robots_access", f"""
WITH r(agent, pattern, allow, rx) AS (VALUES {", ".join(f"('{a}', '{p}', {w}, '{x}')" for a, p, w, x in _PATTERNS)}), b(agent, grp) AS (VALUES ('GPTBot', 'gptbot'), ('Googlebot', '*')),
u AS (SELECT DISTINCT {_f(HOST, "url")} AS site, {_f(PATH, "url")} AS path FROM pages), m AS (SELECT site, path, b.agent, allow, length(pattern) AS n FROM u CROSS JOIN b LEFT JOIN r ON r.agent = b.grp AND regexp_matches(path, rx))
SELECT site, path, agent, coalesce(max_by(allow, (n, allow)), TRUE) AS allowed FROM m GROUP BY ALL""")
def robots_access(spark, sf_dir):
    at = pages_of(spark, sf_dir).select(urls.host(F.col("url")).alias("site"), urls.path(F.col("url")).alias("path"))
    files = at.select("site").distinct().withColumn("text", F.lit(ROBOTS))
    return robots.verdicts(at, robots.rules(files), ("GPTBot", "Googlebot"))


@query("blocked_bots", f"""
WITH b(agent, purpose) AS (VALUES {", ".join(f"('{a}', '{p}')" for a, p in robots.BOTS.items())}), s AS (SELECT DISTINCT {_f(HOST, "url")} AS site FROM pages)
SELECT site, agent, purpose, 'info' AS severity FROM s CROSS JOIN b WHERE agent IN ('GPTBot', 'CCBot')""")
def blocked_bots(spark, sf_dir):
    sites = pages_of(spark, sf_dir).select(urls.host(F.col("url")).alias("site")).distinct()
    rules = robots.rules(sites.withColumn("text", F.lit(ROBOTS)))
    return robots.blocked_bots(robots.verdicts(sites.withColumn("path", F.lit("/")), rules, tuple(robots.BOTS)))


@query("representatives", f"""
WITH {RECORDS}, {LINKS}, i AS (SELECT site, target AS url, count(DISTINCT src) AS inlinks FROM lk WHERE src <> target GROUP BY ALL),
p AS (SELECT rec.site, rec.url, seq, regexp_extract({_f(PATH, "rec.url")}, '^/([^/]*)', 1) AS segment, coalesce(inlinks, 0) AS inlinks FROM rec LEFT JOIN i USING (site, url)),
r AS (SELECT *, count(*) OVER (PARTITION BY site, segment) AS pages, row_number() OVER (PARTITION BY site, segment ORDER BY inlinks DESC, seq) AS k FROM p)
SELECT site, segment, url, row_number() OVER (PARTITION BY site ORDER BY segment <> '', pages DESC, segment)::INT AS place FROM r WHERE k = 1 QUALIFY place <= 12""")
def representatives(spark, sf_dir):
    p = links.with_inlinks(addresses_of(spark, sf_dir), links.inlinks(source.links(pages_of(spark, sf_dir))))
    return history.representatives(p.withColumn("segment", urls.segment(F.col("url"))))


@query("child_segments", f"""
WITH {RECORDS}, c AS (SELECT site, regexp_extract({_f(PATH, "url")}, '^/([^/]*)', 1) AS segment, regexp_extract({_f(PATH, "url")}, '^/[^/]+/(.+)$', 1) AS child FROM rec)
, d AS (SELECT site, segment, count(DISTINCT child)::BIGINT AS children FROM c WHERE segment <> '' AND child <> '' GROUP BY site, segment HAVING count(DISTINCT child) >= 2)
SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY site ORDER BY children DESC, segment) <= 6""")
def child_segments(spark, sf_dir):
    return history.child_segments(addresses_of(spark, sf_dir))


@query("probe_urls", f"""
WITH {RECORDS}, a AS (SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY site ORDER BY seq) <= 200), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY site, {_f(SCHEME, "url")} ORDER BY seq) <= 2)
SELECT site, url FROM b QUALIFY row_number() OVER (PARTITION BY site ORDER BY seq) <= 5""")
def probe_urls(spark, sf_dir):
    return history.probe_urls(addresses_of(spark, sf_dir))


@query("missing_trust_pages", f"""
WITH {RECORDS}, k(kind, rx) AS (VALUES {", ".join(f"('{k}', '{x}')" for k, x in geo.TRUST_PAGES.items())})
SELECT site, kind FROM rec CROSS JOIN k GROUP BY site, kind, rx HAVING NOT bool_or(regexp_matches(lower({_f(PATH, "url")}), rx))""")
def missing_trust_pages(spark, sf_dir):
    return geo.trust_pages(addresses_of(spark, sf_dir))


@query("text_ratio", f"WITH {RECORDS} SELECT site, url, round(content_words * 6 / bytes_html, 3) AS ratio, regexp_matches(trim(title), '\\?\\s*$') AS question FROM rec")
def text_ratio(spark, sf_dir):
    r = records_of(spark, sf_dir)
    return r.select("site", "url", text.text_ratio(F.col("content_words"), F.col("bytes_html")).alias("ratio"), F.trim("title").rlike(r"\?\s*$").alias("question"))


@query("element_counts", r"SELECT page_id AS seq, tag, count(*)::BIGINT AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY ALL")
def element_counts(spark, sf_dir):
    return html.elements(pages_of(spark, sf_dir)).groupBy("seq", "tag").agg(F.count("*").alias("n"))


def _from_aggregates(items: DataFrame) -> DataFrame:
    """Facts of pages from the table of elements, summed up by page."""
    head = lambda name: F.max(F.when((F.col("tag") == "meta") & (F.lower(F.coalesce(F.col("attrs")["name"], F.col("attrs")["property"])) == name), F.col("attrs")["content"]))
    return items.groupBy("site", "seq", "url").agg(
        F.min_by(F.when(F.col("tag") == "title", F.col("text")), F.when(F.col("tag") == "title", F.col("pos"))).alias("title"), F.count_if(F.col("tag") == "h1").cast("int").alias("n_h1"),
        F.coalesce(head("description"), F.lit("")).alias("meta_description"), head("viewport").isNotNull().alias("viewport"), F.count_if((F.col("tag") == "img") & F.col("attrs")["alt"].isNull()).alias("imgs_no_alt"),
    )


@query("parsed_records", f"WITH {RICH_RECORDS} SELECT site, seq, url, title, n_h1, meta_description, viewport, imgs_no_alt FROM rec")
def parsed_records(spark, sf_dir):
    return _from_aggregates(html.elements(rich_pages_of(spark, sf_dir)))


@query("parsed_issues", SQL["crawl_issues"])
def parsed_issues(spark, sf_dir):
    """The issues of records that are stored first, for reports that read them several times."""
    return issues.fold(issues.violations(stored(records_of(spark, sf_dir), "records")))


# Pieces that modules find fault with: condition on page_id, marker before which it stands, piece, and what each page with it gives
# (key, severity, signature, example).
FAULTS = (
    ("page_id % 2 = 0", "<article>", '<a href="/vide"></a><button></button>', (("lien_sans_nom", "haute", "/vide", "/vide"), ("bouton_sans_nom", "haute", "button", "button"))),
    ("page_id % 3 = 0", "<article>", '<section><h2>Un</h2><h4>Saut</h4></section><p aria-describedby="absent">x<p aria-labelledby="la">y', (("titres_sautes", "moyenne", "h2 > h4", "Saut"), ("aria_ref_cassee", "moyenne", "absent", "absent"), ("aria_ref_cassee", "moyenne", "la", "la"))),
    ("page_id % 3 = 1", "<article>", '<iframe src="/cadre?k=1"></iframe><div aria-label="zone">q</div>', (("iframe_sans_titre", "moyenne", "/cadre", "/cadre"), ("aria_label_interdit", "moyenne", "zone", "zone"))),
    ("page_id % 5 = 0", "<article>", '<svg viewBox="0 0 1 1"></svg><svg role="img" fill="red"></svg>', (("svg_non_masque", "moyenne", "0 0 1 1", "0 0 1 1"), ("svg_img_sans_nom", "haute", "red", "red"))),
    ("page_id % 5 = 1", "<article>", '<a href="/c">Ici</a><a href="/d">ici</a><a href="/d">Le tarif</a><img src="/i.png" alt="IMG_1234.jpg"><a href="/chat">Un chat<img src="/c.png" alt="un chat"></a>', (("lien_generique", "basse", "ici", "ici"), ("alt_suspect", "basse", "IMG_1234.jpg", "IMG_1234.jpg"), ("alt_redondant", "basse", "un chat", "un chat"))),
    ("page_id % 7 = 0", "<article>", "<p>Lorem ipsum dolor sit amet<p><q>dolor sit amet</q>", (("contenu_demo", "moyenne", "lorem ipsum (texte) : « Lorem ipsum dolor sit amet »", "lorem ipsum (texte) : « Lorem ipsum dolor sit amet »"),)),
    ("page_id % 7 < 3", "<article>", "<p>Prix : undefined €<p>La valeur null est un mot de ce texte<ul><li>null</ul><code>NaN min</code>", (("fuite_rendu", "haute", "undefined — « Prix : undefined € »", "undefined — « Prix : undefined € »"), ("fuite_rendu_isolee", "basse", "null — « null »", "null — « null »"))),
    ("page_id % 11 = 0", "<article>", '<img src="/a.png" alt="Vue de NaN"><a href="/cours/undefined">Cours</a><a href="https://doc.example.com/null">Doc</a>', (("fuite_rendu_isolee", "basse", 'NaN — alt="Vue de NaN"', 'NaN — alt="Vue de NaN"'), ("fuite_rendu", "haute", "undefined — href /cours/undefined", "undefined — href /cours/undefined"))),
    ("page_id % 4 = 0", "<article>", '<script src="https://cdn.tiers.net/x.js"></script><script src="https://www.googletagmanager.com/gtag.js"></script>', (("sri_absent", "basse", "https://cdn.tiers.net/x.js", "https://cdn.tiers.net/x.js"), ("sri_non_applicable", "info", "https://www.googletagmanager.com/gtag.js", "chargeur au contenu changeant : Google Tag Manager / gtag"))),
    ("page_id % 4 = 1", "<article>", '<script type="application/ld+json">{"@type": "WebPage", "mainEntity": {"@type": "Product", "name": "x", "@id": "#p"}, "about": [{"@type": "HowTo"}]}</script>', (("jsonld_proprietes_requises", "moyenne", "Product : offers|review|aggregateRating", "Product : offers|review|aggregateRating"), ("jsonld_type_sans_effet", "info", "HowTo : résultats enrichis retirés en 2023", "HowTo : résultats enrichis retirés en 2023"))),
    ("page_id % 4 = 2", "<article>", '<script type="application/ld+json">{"@graph": [{"@type": "Product", "@id": "#p", "name": "x"}, {"@type": "Offer", "itemOffered": {"@id": "#p"}}, {"@type": "Course", "name": "c"}]}</script>', (("jsonld_cours_incomplet", "basse", "Course : description", "Course : description"),)),
    ("page_id % 6 = 5", "</head>", '<meta name="viewport" content="maximum-scale=1">', (("zoom_bloque", "haute", "maximum-scale=1", "maximum-scale=1"),)),
)
LOST_HEADS = (
    ("page_id % 4 = 0", '<img><link rel="canonical" href="x">', "haute", "<img> puis : link canonical"), ("page_id % 4 = 1", 'words<meta name="description" content="d">', "moyenne", "#texte puis : meta description"),
    ("page_id % 4 = 2", '<noscript><iframe></iframe></noscript><meta name="robots" content="noindex">', "moyenne", "<noscript><iframe> (sans JavaScript) puis : meta robots"),
)


def _broken(parts) -> str:
    """SQL of both engines: html with the pieces of (condition, marker, piece) put before their markers."""
    out = "html"
    for marker in dict.fromkeys(m for _, m, _ in parts):
        put = " || ".join(f"CASE WHEN {when} THEN '{piece}' ELSE '' END" for when, m, piece in parts if m == marker)
        out = f"replace({out}, '{marker}', {put} || '{marker}')"
    return out


FAULTY = _broken([f[:3] for f in FAULTS])
OBSERVED = "obs AS (" + " UNION ALL ".join(
    f"SELECT {_f(HOST, 'url')} AS site, url, '{k}' AS key, '{s}' AS severity, '{g}' AS signature, '{e}' AS example FROM pages WHERE {when} AND contains(html, '{marker}')" for when, marker, _, seen in FAULTS for k, s, g, e in seen
) + ")"


@query("module_observations", f"""
WITH {OBSERVED}, p AS (SELECT site, key, severity, signature, url, count(*) AS n, min(example) AS example FROM obs GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY site, key, signature ORDER BY url) AS place FROM p)
SELECT site, key, severity, signature, sum(n)::BIGINT AS occurrences, count(*)::BIGINT AS pages, string_agg(url, ' ' ORDER BY url) FILTER (place <= 3) AS first_pages, min(example) AS example FROM r GROUP BY ALL""")
def module_observations(spark, sf_dir):
    """All modules over pages with the pieces of FAULTS."""
    from lanternfish.operators import modules

    read = stored(html.parsed(pages_of(spark, sf_dir).selectExpr("page_id", "url", f"{FAULTY} AS html")), "parsed")
    items, lines = stored(html.elements(read), "elements"), html.lines(read)
    return modules.groups(modules.observations(items, lines).drop("module"))


@query("broken_heads", "SELECT site, url, 'tete_interrompue' AS key, severity, signature, signature AS example FROM (" + " UNION ALL ".join(
    f"SELECT {_f(HOST, 'url')} AS site, url, '{s}' AS severity, '{g}' AS signature FROM pages WHERE {when} AND contains(html, '</head>')" for when, _, s, g in LOST_HEADS) + ")")
def broken_heads(spark, sf_dir):
    """Heads that an image, a text or a noscript ends before their time."""
    from lanternfish.operators import modules

    heads = _broken([(when, "</head>", piece) for when, piece, _, _ in LOST_HEADS])
    return modules.broken_head(html.parsed(pages_of(spark, sf_dir).selectExpr("page_id", "url", f"{heads} AS html")))


# Findings over several pages. States that the tables lack are read from the page's id: of every site, pages 2 of 5 are in the
# sitemap (every other one of them as http), and one page in nine is closed by robots.txt.
SITES = "sit AS (SELECT site, min_by(url, seq) AS start, min(seq) AS first FROM rec GROUP BY site)"
STATES = f"{SITES}, smp AS (SELECT site, CASE WHEN seq % 10 = 0 THEN regexp_replace(url, '^https:', 'http:') ELSE url END AS url FROM rec WHERE seq % 5 < 2)"
SHAPE_SQL = "NULL::BIGINT AS seq, url, 1::BIGINT AS n"


def _states(records: DataFrame):
    sites = records.groupBy("site").agg(F.min_by("url", "seq").alias("start"), F.min("seq").alias("first"))
    sitemap = records.filter("seq % 5 < 2").select("site", F.expr("CASE WHEN seq % 10 = 0 THEN regexp_replace(url, '^https:', 'http:') ELSE url END").alias("url"))
    return sites, sitemap


@query("canonical_findings", f"""
WITH {RICH_RECORDS}, {JUDGED}, x AS (SELECT site, 'https://other.example.org/' AS target, CASE WHEN first % 3 = 0 THEN 0 WHEN first % 3 = 1 THEN 404 ELSE 200 END AS t_status FROM (SELECT site, min(seq) AS first FROM rec GROUP BY site))
SELECT jud.site, CASE WHEN t_status <= 0 THEN 'canonical_target_unreachable' ELSE 'canonical_bad_target' END AS key, CASE WHEN t_status <= 0 THEN 'basse' ELSE 'haute' END AS severity, seq, url, 1::BIGINT AS n
FROM jud JOIN x ON x.site = jud.site AND x.target = canonical WHERE n_canonicals = 1 AND canonical <> url AND t_status <> 200""")
def canonical_findings(spark, sf_dir):
    """Pages whose canonical names another site's page, which is gone, out of reach or fine by the first page of the site."""
    r = rich_records_of(spark, sf_dir)
    first = r.groupBy("site").agg(F.min("seq").alias("first"))
    status = F.when(F.col("first") % 3 == 0, 0).when(F.col("first") % 3 == 1, 404).otherwise(200)
    checked = first.select("site", F.lit("https://other.example.org/").alias("target"), status.alias("t_status"), F.lit(0).alias("t_hops"), F.lit(False).alias("t_noindex"))
    return site_issues.canonical_targets(r, checked)


@query("site_file_findings", f"""
WITH {RECORDS}, {STATES}, r AS (SELECT site, start FROM sit WHERE first % 2 = 0)
SELECT site, 'no_sitemap' AS key, 'haute' AS severity, NULL::BIGINT AS seq, start AS url, 1::BIGINT AS n FROM sit WHERE site NOT IN (SELECT site FROM smp)
UNION ALL SELECT site, 'robots_missing', 'moyenne', NULL, start, 1 FROM sit WHERE site NOT IN (SELECT site FROM r) UNION ALL SELECT site, 'robots_sitemap_relative', 'moyenne', NULL, '/sitemap.xml', 1 FROM r""")
def site_file_findings(spark, sf_dir):
    """The robots file of every site whose first page has an even number answers."""
    sites, sitemap = _states(addresses_of(spark, sf_dir))
    files = sites.select("site", F.when(F.col("first") % 2 == 0, 200).otherwise(404).alias("status"), F.lit(ROBOTS).alias("text"))
    return site_issues.site_files(sites, sitemap, files, robots.sitemap_lines(files.filter("status = 200").select("site", "text")))


@query("blocked_findings", f"""
WITH {RECORDS}, {STATES}, {LINKS}, b AS (SELECT DISTINCT site, url FROM rec WHERE seq % 9 = 1 UNION SELECT site, target FROM lk WHERE target IS NOT NULL AND contains(target, 'th')),
c AS (SELECT site, url, (site, url) IN (SELECT site, url FROM smp) AS listed, (site, url) IN (SELECT site, target FROM lk WHERE src <> target AND target IS NOT NULL) AS linked FROM b)
SELECT site, CASE WHEN listed THEN 'sitemap_blocked' ELSE 'linked_blocked' END AS key, CASE WHEN listed THEN 'haute' ELSE 'basse' END AS severity, {SHAPE_SQL} FROM c WHERE listed OR linked""")
def blocked_findings(spark, sf_dir):
    p, l = addresses_of(spark, sf_dir), source.links(pages_of(spark, sf_dir))  # noqa: E741
    closed = p.filter("seq % 9 = 1").select("site", "url").unionByName(l.filter("contains(target, 'th')").select("site", F.col("target").alias("url")))
    return site_issues.blocked(closed, _states(p)[1], links.inlinks(l))


@query("broken_images", f"""
WITH rich AS (SELECT {RICH} FROM pages), i AS (SELECT {_f(HOST, "url")} AS site, unnest(regexp_extract_all(html, '(?i)<img[^>]* src="([^"]*)"', 1)) AS src FROM rich)
SELECT DISTINCT site, 'broken_images' AS key, 'moyenne' AS severity, NULL::BIGINT AS seq, src AS url, 1::BIGINT AS n FROM i WHERE src LIKE '%a.png'""")
def broken_images(spark, sf_dir):
    """Images named a.png do not answer."""
    items = html.elements(rich_pages_of(spark, sf_dir)).filter("tag = 'img'")
    src = F.col("attrs")["src"]
    return site_issues.broken_images(items.select("site", src.alias("url"), F.when(src.endswith("a.png"), 404).otherwise(200).alias("status")))


@query("sitemap_variants", f"""
WITH {RECORDS}, {STATES}, s AS (SELECT DISTINCT site, url FROM smp WHERE (site, url) NOT IN (SELECT site, url FROM rec)), t AS (SELECT s.*, start, first, length(s.url) % 3 AS k FROM s JOIN sit USING (site)),
g AS (SELECT site, {_f(SCHEME, "url")} AS scheme, {_f(PLACE, "url")} AS place, count(*) FILTER (k = 0 OR first % 2 = 0) AS fine, count(*) FILTER (k = 1 AND first % 2 = 1) AS moved FROM t WHERE k < 2 GROUP BY ALL),
v AS (SELECT t.*, fine, moved, {_f(SCHEME, "url")} <> {_f(SCHEME, "start")} OR {_f(PLACE, "url")} <> {_f(PLACE, "start")} AS variant FROM t LEFT JOIN g ON g.site = t.site AND g.scheme = {_f(SCHEME, "t.url")} AND g.place = {_f(PLACE, "t.url")})
SELECT site, CASE WHEN variant AND fine > 0 AND moved = 0 THEN 'sitemap_sans_redirection' ELSE 'sitemap_redirect' END AS key, 'moyenne' AS severity, {SHAPE_SQL} FROM v
WHERE variant OR (k = 1 AND first % 2 = 1)""")
def sitemap_variants(spark, sf_dir):
    """Two of three urls are probed, by their length; sites whose first page has an even number never redirect."""
    p = addresses_of(spark, sf_dir)
    sites, sitemap = _states(p)
    k = F.length("url") % 3
    probed = sitemap.join(sites.select("site", "first"), "site").filter(k < 2)
    probed = probed.join(p.select("site", "url"), ["site", "url"], "left_anti")
    status = F.when((k == 0) | (F.col("first") % 2 == 0), 200).otherwise(301)
    return site_issues.sitemap_variants(sitemap, p, sites, probed.select("site", "url", status.alias("status")))


@query("duplicate_findings", SQL["title_duplicates"].replace("SELECT site, 'title_dup'", "SELECT site, key, severity, seq, url, n FROM (SELECT site, 'title_dup'").replace(RECORDS, RICH_RECORDS).replace("WHERE title", "WHERE indexable AND title") + ")"
       + " UNION ALL SELECT site, key, severity, seq, url, n FROM (" + SQL["description_duplicates"] + ") UNION ALL SELECT site, 'near_dup_titles', 'moyenne', seq, url, pairs FROM ("
       + _NEAR_CLASSES.replace(RECORDS, RICH_RECORDS).replace("FROM rec)", "FROM jud WHERE indexable)").replace("FROM rec GROUP", "FROM jud WHERE indexable GROUP").replace(f"{RICH_RECORDS}, ", f"{RICH_RECORDS}, {JUDGED}, ") + " WHERE pairs > 0)")
def duplicate_findings(spark, sf_dir):
    return site_issues.duplicates(stored(rich_records_of(spark, sf_dir), "rich-records"))


_STATUS = "CASE WHEN seq % 7 = 0 THEN 301 WHEN seq % 11 = 0 THEN 404 ELSE 200 END"


@query("status_histogram", f"WITH {RECORDS} SELECT site, {_STATUS} AS status, count(*)::BIGINT AS pages FROM rec GROUP BY ALL")
def status_histogram(spark, sf_dir):
    """Every seventh page was redirected, every eleventh of the others is gone."""
    first = F.expr(_STATUS)
    final = F.when(first == 301, 200).otherwise(first)
    return reports.status_histogram(addresses_of(spark, sf_dir).withColumns({"status": first, "final_status": final, "redirect_hops": (first == 301).cast("int")}))


@query("linked_extremes", f"""
WITH {RECORDS}, {JUDGED}, {LINKS}, c AS (SELECT site, target, count(DISTINCT src)::BIGINT AS n FROM lk WHERE src <> target GROUP BY ALL), p AS (SELECT jud.site, url, seq, coalesce(c.n, 0)::BIGINT AS inlinks FROM jud LEFT JOIN c ON c.site = jud.site AND target = url WHERE indexable)
SELECT site, 'most' AS kind, row_number() OVER (PARTITION BY site ORDER BY inlinks DESC, seq)::INT AS place, url, inlinks FROM p QUALIFY place <= 10
UNION ALL SELECT site, 'least' AS kind, row_number() OVER (PARTITION BY site ORDER BY inlinks, seq DESC)::INT AS place, url, inlinks FROM p QUALIFY place <= 10""")
def linked_extremes(spark, sf_dir):
    counted = links.with_inlinks(issues.judged(records_of(spark, sf_dir)), links.inlinks(source.links(pages_of(spark, sf_dir))))
    return reports.linked_extremes(counted)


@query("decoded_bodies", "SELECT page_id, md5(html) AS digest FROM pages")
def decoded_bodies(spark, sf_dir):
    """Every third page as UTF-16, the others as UTF-8, with or without a charset, or with one that nobody knows."""
    k = F.col("page_id") % 3
    kind = F.when(k == 0, "text/html; Charset=UTF-16BE").when(k == 1, "text/html").otherwise("text/html; charset=x-none")
    body = F.when(k == 0, F.encode("html", "UTF-16BE")).otherwise(F.encode("html", "UTF-8"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.md5(F.encode(bodies.decoded(body, kind), "UTF-8")).alias("digest"))


@query("own_pages", rf"""
WITH s AS (SELECT DISTINCT {_f(HOST, "url")} AS host FROM pages), p AS (SELECT page_id, url, {_f(HOST, "url")} AS host, (SELECT min(host) FROM s) AS h FROM pages)
SELECT page_id, 'https://www.' || h || CASE WHEN {PATH.replace("{0}", "url")} = '' THEN '/' ELSE {PATH.replace("{0}", "url")} END || CASE WHEN {QUERY.replace("{0}", "url")} <> '' THEN '?' || {QUERY.replace("{0}", "url")} ELSE '' END AS own, TRUE AS variant
FROM p WHERE {PLACE.replace("{0}", "url")} IN (h, 'www.' || h)""")
def own_pages(spark, sf_dir):
    """Pages of the first host, as seen from a start page of its www form."""
    p = pages_of(spark, sf_dir).select("page_id", "url")
    first = p.agg(F.min(urls.host(F.col("url"))).alias("h"))
    own = urls.own_page(F.col("url"), F.concat(F.lit("https://www."), "h", F.lit("/")))
    return p.join(F.broadcast(first)).withColumn("o", own).filter("o IS NOT NULL").select("page_id", F.col("o.url").alias("own"), F.col("o.variant").alias("variant"))


_USED = f"""rich AS (SELECT {RICH} FROM pages), i AS (SELECT {_f(HOST, "url")} AS site, url AS page, {_f(SCHEME, "url")} || '://' || {_f(PLACE, "url")} AS base, unnest(regexp_extract_all(html, '(?i)<img[^>]* src="([^"]*)"', 1)) AS src FROM rich),
u AS (SELECT DISTINCT site, page, base || src AS url, 'image' AS type FROM i WHERE src LIKE '/%')"""


def _used(spark, sf_dir) -> DataFrame:
    return resources.uses(html.elements(rich_pages_of(spark, sf_dir)))


@query("page_resources", f"WITH {_USED} SELECT * FROM u")
def page_resources(spark, sf_dir):
    return _used(spark, sf_dir)


@query("resource_findings", f"""
WITH {_USED}, f AS (SELECT * FROM u WHERE url LIKE '%/a.png')
SELECT site, page AS url, 'image_lourde' AS key, 'moyenne' AS severity, url || ' (292 Ko)' AS signature FROM f
UNION ALL SELECT site, page, 'asset_sans_cache', 'moyenne', url || ' (Cache-Control : no-store)' FROM f""")
def resource_findings(spark, sf_dir):
    """Files named a.png are heavy and never kept; the others are small."""
    used = _used(spark, sf_dir)
    heavy = F.col("url").endswith("/a.png")
    measured = used.select("site", "url").distinct().select("site", "url", F.lit(200).alias("status"), F.when(heavy, 300_000).otherwise(900).alias("bytes"), F.when(heavy, "no-store").alias("cache_control"), F.lit("image/png").alias("content_type"), F.lit(None).cast("bigint").alias("expires_in"))
    return resources.resource_findings(used, measured).drop("example")
