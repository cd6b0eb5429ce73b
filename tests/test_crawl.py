"""Redirect chains, the order of visits, probes, readers of files, and secrets in nested values."""

import gzip
import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from lanternfish.functions import sanitise
from lanternfish.operators import crawl
from lanternfish.sources import files, trees


def brute_chain(answers, url, hops):
    chain, at = [], url
    for _ in range(hops):
        if at not in answers:
            return chain, at, 0
        status, location = answers[at]
        if 300 <= status < 400 and location:
            chain.append((at, status))
            at = location
            continue
        return chain, at, status
    return chain, at, -1


@pytest.mark.parametrize("hops", [1, 3, 10])
def test_redirect_chains_match_brute_force(spark, hops):
    """Chains of every length, circles, ends without an answer, a page that all lead to, redirects without a target."""
    rng = random.Random(hops)
    u = lambda k: f"https://s.com/{k}"
    answers = {u(k): (301 if k % 3 else 302, u(k + 1)) for k in range(40)} | {u(40): (200, None), u(50): (301, u(51)), u(51): (302, u(50)), u(60): (308, u(60)), u(70): (301, u(999)), u(71): (304, None), u(72): (404, u(1))}
    answers |= {u(k): (301, u(rng.choice([39, 40, 50, 70, 200 + (k + 1) % 100]))) for k in range(200, 300)}
    rows = [("s", k, st, loc) for k, (st, loc) in answers.items()] + [("t", u(0), 200, None)]
    got = {(r.site, r.url): ([tuple(c) for c in r.chain], r.final_url, r.final_status) for r in crawl.redirect_chains(spark.createDataFrame(rows, "site string, url string, status int, location string"), hops).collect()}
    assert got == {("s", k): brute_chain(answers, k, hops) for k in answers} | {("t", u(0)): ([], u(0), 200)}


def test_relative_redirects(spark):
    rows = [("s", "https://s.com/a/b", 301, "../c#x"), ("s", "https://s.com/c", 302, "//t.com/d"), ("s", "https://t.com/d", 500, None)]
    got = crawl.redirect_chains(spark.createDataFrame(rows, "site string, url string, status int, location string")).filter("url = 'https://s.com/a/b'").first()
    assert (got.final_url, got.status, got.final_status, got.redirect_hops, got.redirect_statuses) == ("https://t.com/d", 301, 500, 2, [301, 302])


def brute_visits(start, links, sitemap, most, blocked):
    seen, queue, pages, phase = {start: 0}, deque([start]), [], 1
    while len(pages) < most:
        if not queue:
            if phase == 2:
                break
            phase = 2
            for u in sitemap:
                if u not in seen:
                    seen[u] = None
                    queue.append(u)
            if not queue:
                break
            continue
        u = queue.popleft()
        if u in blocked:
            continue
        pages.append((u, seen[u]))
        for t in links.get(u, ()):
            if t not in seen:
                seen[t] = None if seen[u] is None else seen[u] + 1
                queue.append(t)
    return [(u, d, k + 1) for k, (u, d) in enumerate(pages)]


@pytest.mark.parametrize("most", [1, 7, 30, 1000])
def test_visits_match_brute_force(spark, most):
    rng = random.Random(most)
    rows, want, maps, closed, starts = [], [], [], [], []
    for site in ("s", "t", "u"):
        names = [f"{site}{k}" for k in range(60)]
        links = {n: [rng.choice(names[:40]) for _ in range(rng.randint(0, 4))] for n in names}
        sitemap, blocked = rng.sample(names, 25) * 2, set(rng.sample(names[1:], 8))
        if site == "u":
            blocked = {names[0]}
        rows += [(site, n, p, t) for n, ts in links.items() for p, t in enumerate(ts)]
        maps += [(site, u, p) for p, u in enumerate(sitemap)]
        closed += [(site, u) for u in blocked]
        starts.append((site, names[0]))
        want += [(site, *v) for v in brute_visits(names[0], links, sitemap, most, blocked)]
    table = lambda r, s: spark.createDataFrame(r, s).repartition(3)
    got = crawl.visits(table(starts, "site string, url string"), table(rows, "site string, src string, pos int, target string"), table(maps, "site string, url string, pos int"), most, table(closed, "site string, url string"))
    sites = {w[0] for w in want}
    assert sorted(map(tuple, got.filter(F.col("site").isin(*sites)).select("site", "url", "depth", "place").collect()), key=repr) == sorted(want, key=repr)


def test_probes_stop(spark):
    statuses = {"a": [0, 0, 0, 200, 200], "b": [0, 0, 200, 0, 0, 0, 200], "c": [200, 404, -1, None, 200], "d": [0, 0], "e": [200, 0, 0, 0, 200]}
    rows = [(s, f"{s}{k}", k) for s, v in statuses.items() for k in range(len(v))]
    answers = [(s, f"{s}{k}", x) for s, v in statuses.items() for k, x in enumerate(v) if x is not None]
    got = crawl.probed(spark.createDataFrame(rows, "site string, url string, place int"), spark.createDataFrame(answers, "site string, url string, status int")).collect()
    of = {s: sorted(r.url for r in got if r.site == s) for s in statuses}
    assert of == {"a": ["a0", "a1", "a2"], "b": ["b0", "b1", "b2", "b3", "b4"], "c": ["c0", "c1", "c2", "c3", "c4"], "d": ["d0", "d1"], "e": ["e0", "e1", "e2", "e3"]}


def test_sitemap_files(spark, tmp_path):
    one = '<?xml version="1.0" encoding="UTF-8"?>\n<s:urlset xmlns:s="http://www.sitemaps.org/schemas/sitemap/0.9"><s:url><s:loc> http://s/a?x=1&amp;y=&#50; </s:loc><s:lastmod>2026-01-01</s:lastmod></s:url><s:url><s:loc><![CDATA[http://s/b&c]]></s:loc></s:url><s:url><s:loc/></s:url></s:urlset>'
    (tmp_path / "maps").mkdir()
    (tmp_path / "maps" / "a.xml").write_text(one)
    (tmp_path / "maps" / "b.xml.gz").write_bytes(gzip.compress(b"<urlset><url><loc>http://s/z</loc></url></urlset>"))
    (tmp_path / "maps" / "c.xml").write_text("<urlset><url><loc>http://s/broken</url>")
    (tmp_path / "maps" / "d.xml").write_text("<sitemapindex><sitemap><loc>http://s/m.xml</loc></sitemap></sitemapindex>")
    got = files.sitemap(trees.sitemap_documents(spark, str(tmp_path / "maps"), "s")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("s", "http://s/a?x=1&y=2", "2026-01-01", False), ("s", "http://s/b&c", None, False), ("s", "http://s/z", None, False), ("s", "http://s/m.xml", None, True)], key=repr)


def test_source_trees(spark, tmp_path):
    tree = {"package.json": b"{}", "src/pages/a.astro": "é".encode(), "public/logo.png": b"\x89PNG", "src/b.ts": b"x\x00y", "node_modules/x/index.js": b"x", "node_modules/astro/package.json": b'{"version":"5"}', "src/big.css": b"a" * 2000}
    for name, data in tree.items():
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_bytes(data)
    texts, passed = trees.source_tree(spark, str(tmp_path / "t"), "s", most=1000)
    assert sorted(map(tuple, texts.collect())) == [("s", "node_modules/astro/package.json", '{"version":"5"}'), ("s", "package.json", "{}"), ("s", "src/pages/a.astro", "é")]
    assert sorted((r.path, r.octets, r.why) for r in passed.collect()) == [("node_modules/x/index.js", 1, "folder"), ("public/logo.png", 4, "kind"), ("src/b.ts", 3, "binary"), ("src/big.css", 2000, "size")]


def test_names_of_secrets(spark):
    names = {"token": True, "apiKey": True, "x-auth": True, "%74oken": True, "%2574oken": True, "session_id": True, "accessKey": True, "keyword": False, "page": False, "author": False, "codec": False, "monkey": True, "": False}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", sanitise.secret_name(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in got} == names


def test_nested_values_lose_their_secrets(spark):
    value = {"u": "https://me:pw@a.b/x?page=2&token=abcd#z", "deep": [{"a": {"b": ["see https://a.b/?next=%2Fcb%253Fapi_key%253Dq1.", {"password": "p\"w", "note": "a=1 secret=xyz b"}]}}], "https://a.b/?sig=zz": 1, "src": "/i?key=1", "n": [1, None, True, "plain \\ \" text\n"],
             "id": "ghp_" + "a1" * 12, "v": "https://a.b/?v=Zk3jQ8sLmN0pQrStUvWx&lang=Zk3jQ8sLmN0pQrStUvWx&m=me@x.org"}
    rows = [(1, json.dumps(value, ensure_ascii=False)), (2, "3"), (3, None), (4, '"https://a.b/?token=x"'), (5, "")]
    got = {r.id: r.j for r in spark.createDataFrame(rows, "id int, t string").select("id", sanitise.public_json(F.col("t")).alias("j")).collect()}
    out = json.loads(got[1])
    for gone in ("pw@", "abcd", "q1", 'p"w', "xyz", "zz", "a1a1", "me@x.org", "?v=Zk3"):
        assert gone not in got[1] and gone not in json.dumps(out, ensure_ascii=False), gone
    assert out["u"].startswith("https://a.b/x?page=2&token=…") and out["n"] == value["n"] and out["deep"][0]["a"]["b"][1] == {"password": "…", "note": "a=1 secret=… b"} and out["src"].startswith("/i?key=…")
    assert out["deep"][0]["a"]["b"][0].startswith("see https://a.b/?next=…") and out["deep"][0]["a"]["b"][0].endswith(".") and [k for k in out if k.startswith("https://a.b/?sig=…")] and "lang=Zk3" in out["v"]
    assert got[2] == "3" and got[3] is None and got[4].startswith('"https://a.b/?token=…') and got[5] == ""
