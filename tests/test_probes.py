"""Security probes over ingested answers."""

from lanternfish.operators import probes


def test_home_scripts(spark):
    many = "".join(f'<script src="/s{k}.js"></script>' for k in range(20))
    rows = [
        ("a", "https://a.com/x/", '<script src="y.js?v=1"></script><link href="/z.mjs"><script src="/z.mjs"></script><script src="http://a.com/t.js"></script><script src="https://b.com/u.js"></script><img src="/i.jsx">'),
        ("b", "https://b.com/", many), ("c", "https://c.com/", None), ("d", "https://d.com/", ""), ("e", "https://e.com/", '<script src="/k.js"></script><script src="https://e.com/k.js"></script>'),
    ]
    got = sorted(tuple(r) for r in probes.home_scripts(spark.createDataFrame(rows, "site string, url string, html string")).collect())
    assert got == sorted([("a", 0, "https://a.com/x/y.js"), ("a", 1, "https://a.com/z.mjs"), ("e", 0, "https://e.com/k.js"), *(("b", k, f"https://b.com/s{k}.js") for k in range(12))])


def test_maps_are_served_or_named(spark):
    scripts = spark.createDataFrame([("s", 0, f"u{k}") for k in range(5)], "site string, place int, url string")
    rows = [("u0", 200, "x\n//# sourceMappingURL=u0.map"), ("u1", 200, "//# sourceMappingURL=far.map" + 400 * " "), ("u1.map", 404, ""), ("u2", 200, None), ("u2.map", 200, "{}"), ("u3", 404, "")]
    got = sorted(map(tuple, probes.public_maps(scripts, spark.createDataFrame(rows, "url string, status int, body string")).collect()))
    assert got == [("s", "u0", None, "u0.map"), ("s", "u2", 200, None)]


def test_secrets_are_cut_and_counted_by_body(spark):
    key = "sk_live_" + 20 * "a"
    rows = [("s", "u", f"a='{key}'; b='{key}'"), ("s", "v", key), ("s", "w", "AIza" + 30 * "b"), ("s", "x", None), ("s", "y", "class=sk-skeleton-loading-placeholder-item"), ("t", "z", "x" + key)]
    got = sorted(map(tuple, probes.delivered_secrets(spark.createDataFrame(rows, "site string, url string, body string")).collect()))
    assert got == [("s", "AIzabbbbbbbb…", "basse", 1), ("s", "sk_live_aaaa…", "haute", 2)]


def test_findings_of_nothing(spark):
    scripts = spark.createDataFrame([], "site string, place int, url string")
    homes, answers = spark.createDataFrame([], "site string, url string, html string"), spark.createDataFrame([], "url string, status int, body string")
    proxies = spark.createDataFrame([("a", 200, "IMAGE/png"), ("b", 200, "text/html"), ("c", None, None), ("d", 404, "image/png")], "site string, status int, content_type string")
    origins = spark.createDataFrame([("a", "*"), ("b", ""), ("c", None)], "site string, allow_origin string")
    got = sorted(map(tuple, probes.probe_findings(scripts, homes, answers, proxies, origins).collect()))
    assert got == [("a", "cors_ouvert", "basse", "*"), ("a", "proxy_images_ouvert", "haute", "200"), ("b", "proxy_images_indetermine", "basse", "200"), ("c", "proxy_images_indetermine", "basse", "")]
