"""Centroid clustering, importance resampling and SimHash against brute-force versions, and their defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lanternfish.llm import centroid_clustering, components, importance_resampling, simhash_dedup

SF = "/root/testdata/sf0.001"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PROSE = "the quick brown fox jumps over the lazy dog while the old grey cat sleeps near the warm stove and dreams of fish"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
CLASH = "id string, fp string, text_ string, part string, place string, before string, row string, score string, weight string, n_words string, name string, root string, least string, v string, key string, distance string, cell string"
ROWS = [
    (1, PROSE), (2, PROSE), (2, PROSE), (3, None), (4, ""), (5, "!!! ..."), (6, PROSE + " indeed"), (None, "a null id with some words in it " * 4), (7, LONG),
    (8, "  two \n\n spaces\tand tabs "), (9, "ÀÉ grüße Straße 日本  x"), (10, "five words stand right here"), (11, "hi"), (12, "HI"), (13, "A B"), (None, None),
]


def odd(spark, rows=ROWS):
    names = [c.split()[0] for c in CLASH.split(", ")]
    return spark.createDataFrame([(*r, *names) for r in rows], f"doc_id bigint, text string, {CLASH}").repartition(3)


def typed(rows):
    return sorted(map(tuple, rows), key=repr)


# Centroid clustering


def brute_clusters(rows, k, rounds, width):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [int(x) * 64 if abs(x) > 2**900 else math.floor(x * 64) for x in v], v) for i, v in kept]
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))
    cents = [v for _, v, _ in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        of = [near(v)[1] for _, v, _ in kept]
        groups = [[v for (_, v, _), j in zip(kept, of, strict=True) if j == c] for c in range(len(cents))]
        cents = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, cents, strict=True)]
    final = [(i, *near(v)[::-1]) for i, v, _ in kept]
    within = Counter()
    for _, j, d in final:
        within[j] += d
    long = lambda x: x if x < 2**63 else None
    return [(i, j, long(d), long(within[j]), long(sum(within.values())), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, j, d in final]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id bigint, embedding array<double>, id string, cluster string").repartition(3)


def test_clusters_match_brute_force(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute_clusters([(r.vec_id, r.embedding) for r in df.collect()], 16, 3, 64)
    assert typed(centroid_clustering.cluster(df).collect()) == typed(want)


@pytest.mark.parametrize("top", [1.0, 2.0**18, 2.0**23, 2.0**40, 2.0**1020])
def test_clusters_of_any_magnitude(spark, top):
    """Doubles, 64-bit integers and longer whole numbers; ordinary rows stand beside large ones; ties, repeats and odd vectors."""
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * (top if i % 3 == 0 else 1.0) for _ in range(4)]) for i in range(60)]
    rows += [(100, [1.0, 0.0, 0.0, 0.0]), (101, [-1.0, 0.0, 0.0, 0.0])] * 3 + [(None, [0.5] * 4), (None, [0.25] * 4)]
    rows += [(200, None), (201, []), (202, [1.0] * 3), (203, [1.0, None, 1.0, 1.0]), (204, [float("nan")] * 4), (205, [float("inf"), 0.0, 0.0, 0.0]), (206, [-0.0] * 4)]
    for k in (1, 5):
        got = centroid_clustering.cluster(vectors(spark, rows), k=k, width=4).collect()
        assert typed(got) == typed(brute_clusters(rows, k, 3, 4))


def test_clusters_edges(spark):
    few = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [5.0, 5.0])]
    assert typed(centroid_clustering.cluster(vectors(spark, few), width=2).collect()) == typed(brute_clusters(few, 16, 3, 2))
    assert centroid_clustering.cluster(vectors(spark, [])).count() == 0
    assert centroid_clustering.cluster(vectors(spark, [(1, None)])).count() == 0


def test_products_are_guarded():
    """At the bound of each kind of arithmetic the distances are those of whole numbers of any length."""
    rng = np.random.default_rng(3)
    for bits in (20, 21, 24, 27, 28, 40):
        v = rng.integers(2**bits - 5, 2**bits + 5, (7, 64)).astype(float) / 64
        c = [[int(x) for x in row] for row in rng.integers(-(2**bits) - 5, -(2**bits) + 5, (3, 64))]
        want = [[sum((int(a * 64) - b) ** 2 for a, b in zip(x, k, strict=True)) for k in c] for x in v.tolist()]
        assert [[int(x) for x in row] for row in centroid_clustering.squared(v, c)] == want


# Importance resampling


def brute_sample(docs, target, modulus=10_000):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))

    def buckets(t):
        w = words(t)
        return [zlib.crc32(f.encode()) % modulus for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]

    s, t = Counter(b for _, x in docs for b in buckets(x)), Counter(b for x in target for b in buckets(x))
    n, m = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n + modulus) / ((s[b] + 1) * (m + modulus)))) for b in range(modulus)]
    out = []
    for i, x in docs:
        bs = buckets(x)
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: 25 * len(fit) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def sampled(docs, target):
    return typed(importance_resampling.resampled(docs, target).select("doc_id", "n_features", "weight", "score", "rank").collect())


def test_sample_matches_brute_force(spark):
    docs, target = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = sampled(docs, target)
    assert got == typed(brute_sample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()]))
    assert sum(r[4] is not None for r in got) > 40


def test_sample_edges(spark):
    """Nulls, short texts, one id on a third of the rows, equal scores, an empty target and empty tables."""
    rows = ROWS + [(50, PROSE)] * 30 + [(k, PROSE + f" nr {k}") for k in range(60, 110)]
    some = spark.createDataFrame([("fox and dog", "x"), (None, "y"), ("the lazy dog", "z")], "text string, bucket string")
    for target in (some, some.filter("false")):
        assert sampled(odd(spark, rows), target) == typed(brute_sample(rows, [r.text for r in target.collect()]))
    assert importance_resampling.resampled(odd(spark, []), some).count() == 0


def test_a_full_dictionary_starts_anew(monkeypatch):
    texts = [f"w{k} x{k % 7} same words here".encode() for k in range(200)]
    monkeypatch.setattr(importance_resampling, "WORDS", 5)
    small = importance_resampling.Dictionary(997)
    for t in texts:
        words = t.split()
        owner = np.zeros(len(words), np.int64)
        got = sorted(small.buckets(small.ids(words), owner, (1, 2, 3))[0].tolist())
        want = sorted(zlib.crc32(b" ".join(words[i : i + n])) % 997 for n in (1, 2, 3) for i in range(len(words) - n + 1))
        assert got == want
    assert len(small.words) <= 5 + 6


# SimHash


def brute_print(text):
    words = [w for w in re.split(r"[ \t-\r]+", (text or "").translate(AZ)) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """fingerprint -> least id that is reachable, over all pairs."""
    distinct = np.array(sorted({p for _, p in prints}), np.uint64)
    up = list(range(len(distinct)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(distinct)):
        for j in np.flatnonzero(np.bitwise_count(distinct[i + 1 :] ^ distinct[i]) <= 3).tolist():
            a, b = root(i), root(i + 1 + j)
            up[max(a, b)] = min(a, b)
    place, least = {int(p): root(i) for i, p in enumerate(distinct)}, {}
    for i, p in prints:
        if i is not None:
            least[place[p]] = min(least.get(place[p], i), i)
    return [(i, f"{p:016x}", least.get(place[p])) for i, p in prints]


def test_simhash_matches_brute_force(spark):
    for df in (spark.read.parquet(f"{SF}/documents.parquet"), odd(spark)):
        want = brute_components([(r.doc_id, brute_print(r.text)) for r in df.collect()])
        assert typed(simhash_dedup.near_duplicates(df).collect()) == typed(want)
    assert simhash_dedup.near_duplicates(odd(spark, [])).count() == 0


def near_prints(seed, n):
    """Families of fingerprints a few bits apart, chains, and loose ones."""
    rng = random.Random(seed)
    out = [0, (1 << 64) - 1, 1 << 63, 7, 0x5555555555555555, 0xAAAAAAAAAAAAAAAA]
    while len(out) < n:
        p = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 30])):
            out.append(p)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4])):
                p ^= 1 << b
    return sorted(set(out))


@pytest.mark.parametrize("block", [3, 40, 2048])
def test_grid_join_loses_no_link(spark, block, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "PAIRS", 50)
    prints = near_prints(block, 1500)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    df = spark.createDataFrame(signed, "fp bigint").repartition(5)
    edges = components.stored(simhash_dedup.links(simhash_dedup.units(df, block)).distinct(), "edges")
    assert all((a ^ b).bit_count() <= 64 for a, b in edges.collect())
    roots = {r.node % (1 << 64): r.root for r in components.components(edges).collect()}
    want = {int(f, 16): c for _, f, c in brute_components(list(enumerate(prints)))}
    groups = Counter(want.values())
    assert {p for p in prints if p in roots} == {p for p in prints if groups[want[p]] > 1}
    of = {}
    for p, r in roots.items():
        assert of.setdefault(want[p], r) == r
    assert len(set(of.values())) == len(of)


def test_cells_hold_every_pair_once_placed():
    """Two fingerprints within 3 bits share a cell in which at least one of them stands."""
    rng = random.Random(1)

    def places(p):
        out = set()
        for half in range(2):
            bits = p >> 32 * half & 0xFFFFFFFF
            home = (bits & 0x55555555) + (bits >> 1 & 0x55555555)
            out |= {(half, home, 0)} | {(half, home + (1 << 2 * i), 1) for i in range(16) if home >> 2 * i & 3 < 2}
        return out

    for _ in range(3000):
        p = rng.getrandbits(64)
        q = p
        for b in rng.sample(range(64), rng.randint(0, 3)):
            q ^= 1 << b
        a, b = places(p), places(q)
        assert any((h, c, 1 - k) in b or (k == 0 and (h, c, 0) in b) for h, c, k in a)


def test_components_of_hubs_and_chains(spark, monkeypatch):
    """A node that is linked to all, and a long chain; the hot keys go the way of the broadcast."""
    monkeypatch.setattr(components, "HOT", 2)
    star = [(0, k) for k in range(1, 3000)]
    chain = [(10_000 + k, 10_001 + k) for k in range(300)]
    edges = components.stored(spark.createDataFrame(star + chain, "a bigint, b bigint"), "edges")
    got = dict(map(tuple, components.components(edges).collect()))
    assert got == {k: 0 for k in range(3000)} | {10_000 + k: 10_000 for k in range(301)}
    rows = components.stored(spark.range(5000).select((F.col("id") % 2 * F.col("id")).alias("k")), "rows")
    table = components.stored(spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")), "table")
    assert components.lookup(rows, ["k"], table).filter("v = 2 * k").count() == 5000
    assert components.lookup(rows, ["k"], table.filter("k > 10"), "left").filter("v IS NULL").count() == 2505
