"""Each operator against a brute-force version and on the defined edge cases."""

import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternfish.llm import decontamination, licenses, mixing, ngram_join, pii, quality_classifier, quality_rules, token_output, toxicity, url_filters
from lanternfish.llm.common import fold_of

SF = "/root/testdata/sf0.001"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PROSE = "the quick brown fox jumps over the lazy dog while the old grey cat sleeps near the warm stove and dreams of fish"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, key string, n int, size string, score string, token string, rid string, h string, " \
    "ngram_key string, ngram_keep_id string, keep_id string, keep_key string, rows string, root string, bad_id string, bad_key string, mix_source string, mix_full string, mix_upto string, mix_copy string"
CLASH = tuple(f"clash{i}" for i in range(12))
ROWS = [
    (1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (2, PROSE, "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, "!!! ...", "en", "b"),
    (6, PROSE + " indeed", None, "c"), (None, "a null id with some words in it", "en", None), (7, LONG, "en", "c"), (8, "  two \n\n spaces\tand tabs ", "de", "b"),
    (9, "ÀÉ grüße Straße 日本  x", "de", "a"), (10, "five words stand right here", "en", "a"), (11, "hi", "en", "a"), (12, "hi", "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeats, ties, and further columns with names that operators use inside."""
    return spark.createDataFrame([(*r, 0, "x", "y", 1, "z", "s", "t", "r", "h", *CLASH) for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# Quality rules


def brute_measures(text):
    words = [w for w in re.split(r"[ \t-\r]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^ \t-\r]", x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = {p for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines), len(lines) - len(set(lines)), len(again))


def test_rules_match_brute_force(docs, odd):
    for df in (docs, odd):
        got = sorted(tuple(r) for r in quality_rules.ledger(df).select(*quality_rules.MEASURES[:6]).collect())
        assert got == sorted(brute_measures(r.text) for r in df.collect())


def test_repeated_windows_with_many_distinct_words():
    words = [f"w{i}".encode() for i in range(9000)]
    assert quality_rules._repeated(words + words[:7]) == 14
    assert quality_rules._repeated([b"a"] * 6) == 6
    assert quality_rules._repeated([b"a"] * 5) == 0


def test_rules_edges(spark, odd):
    book = quality_rules.ledger(odd)
    assert book.count() == len(ROWS)
    failed = {r.doc_id: r.failed for r in book.collect()}
    assert failed[3] & quality_rules.BITS["few_words"] and failed[4] == quality_rules.BITS["few_words"] and failed[1] == 0
    assert quality_rules.ledger(empty(spark)).count() == 0
    assert quality_rules.ablations(quality_rules.ledger(empty(spark)), "v1").count() == 0


def test_ablations(odd):
    book = quality_rules.ledger(odd)
    masks = [r.failed for r in book.collect()]
    for r in quality_rules.ablations(book, "v1").collect():
        bit = quality_rules.BITS[r.rule]
        assert (r.n_failed, r.n_failed_alone, r.n_kept_without) == (sum(bool(m & bit) for m in masks), masks.count(bit), sum(not m & ~bit for m in masks))


# URL filters


def brute_url(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = host.translate(AZ)
    fits = []
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if h and (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), len(h), verdict == "block", rule))
    if not fits:
        return host, path, None, default
    best = max(fits)
    return host, path, best[3], "block" if best[2] else "allow"


URLS = [
    None, "", "no scheme/x", "http://", "http://COM/", "http://a.com", "http://a.com/", "http://a.com?x=/", "https://www.Example.com/en/1#a/b", "http://example.com/en", "http://example.com/en/",
    "http://notexample.com/en/", "http://x.www.example.com/en/q?u=http://b.net/es/", "ftp://b.net/es/1", "http://net/fr/", "http://.net/fr/a", "http://b.net./es/", "http://b.net/ES/", "http://é.net/es/ü",
    "http://a..com/x", "http://b.net/es/1", "http://b.net/es/1", "a\nb://c.net/es/\nd",
]


@pytest.mark.parametrize("parts", [1, 7])
def test_urls_match_brute_force(spark, parts):
    urls = spark.createDataFrame([(i // 2 if i % 5 else None, u, "h", "p", "r") for i, u in enumerate(URLS * 9)], "page_id bigint, url string, host string, path string, rid string")
    more = (*url_filters.RULES, ("block", "com/"), ("allow", "b.net/es/1"), ("block", "a.com/x/"), ("allow", "/nohost"), ("block", "net/"))
    for rules in (url_filters.RULES, more, ()):
        table = url_filters.rule_table(spark, rules) if rules else spark.createDataFrame([], "host string, path string, verdict string")
        got = sorted((tuple(r) for r in url_filters.judge(urls, table, parts=parts).collect()), key=repr)
        assert got == sorted(((r.page_id, *brute_url(r.url, rules)) for r in urls.collect()), key=repr)


def test_urls_empty(spark):
    none = spark.createDataFrame([], "page_id bigint, url string")
    assert url_filters.judge(none, url_filters.rule_table(spark, url_filters.RULES)).count() == 0


# Decontamination


def brute_hits(text, items, width=13):
    words = WORDS.findall((text or "").translate(AZ))
    hit, names = set(), set()
    for item, body in items:
        w = WORDS.findall((body or "").translate(AZ))
        n = min(width, len(w))
        wins = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(words) - n + 1) if w else ():
            if tuple(words[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                names.add(str(item))
    return len(words), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("bound", [decontamination.BROADCAST_WINDOWS, 0])
def test_decontamination_matches_brute_force(spark, docs, odd, bound):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    items = [tuple(r) for r in bench.collect()]
    extra = [(900, "HI"), (901, None), (902, "..."), (903, PROSE[:90]), (904, " ".join(LONG.split()[500:540])), (905, "hi"), (None, "Grüße, straße")]
    bench = bench.unionByName(spark.createDataFrame(extra, "item_id bigint, text string"))
    for df in (docs, odd):
        got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontamination.measured(df, bench, broadcast_windows=bound).collect()), key=repr)
        want = [(r.doc_id, *brute_hits(r.text, [x for x in items + extra if x[0] is not None])) for r in df.collect()]
        if df is odd:  # the null item's windows hit without a name
            got = [g for g in got if g[0] != 9]
            want = [w for w in want if w[0] != 9]
        assert got == sorted(want, key=repr)


def test_decontamination_with_hot_tokens_on_the_shuffle_path(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "HOT", 4)
    rnd = np.random.default_rng(1)
    words = ["aa", "bb", "cc", "dd"]  # every prefix token is hot
    text = lambda n: " ".join(rnd.choice(words, n))
    bench = spark.createDataFrame([(k, text(n)) for k, n in enumerate((3, 5, 13, 14, 20))], "item_id bigint, text string")
    docs = spark.createDataFrame([(k, text(int(rnd.integers(0, 400)))) for k in range(30)] + [(30, None), (31, "")], "doc_id bigint, text string")
    both = [sorted(map(repr, decontamination.measured(docs, bench, broadcast_windows=b).drop("key").collect())) for b in (0, 200_000)]
    assert both[0] == both[1] and len(both[0]) == 32


def test_decontamination_keeps_and_drops(spark, odd):
    bench = spark.createDataFrame([(1, PROSE)], "item_id bigint, text string")
    kept = decontamination.clean(odd, bench)
    assert kept.columns == odd.columns
    assert {r[-len(CLASH) :] for r in kept.collect()} == {CLASH}
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r[0] for r in ROWS if not (r[1] or "").startswith(PROSE)), key=repr)
    assert decontamination.measured(empty(spark), bench).count() == 0
    assert decontamination.measured(odd, bench.limit(0)).filter("n_hit > 0").count() == 0


# Mixing


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, budget, out = set(names), 1.5 * sum(sizes.values()), {}
    while left:
        share = budget / sum(w[s] for s in left)
        over = {s for s in left if w[s] * share > 2 * sizes[s]}
        if not over:
            out |= {s: w[s] * share for s in left}
            break
        out |= {s: 2.0 * sizes[s] for s in over}
        budget -= sum(2 * sizes[s] for s in over)
        left -= over
    return out


def test_mixing_targets_and_budgets(docs, odd):
    for df in (docs, odd):
        rows, got = df.collect(), mixing.measured(df).collect()
        assert len(rows) == len(got)
        sizes, largest, taken = Counter(), Counter(), Counter()
        for r in rows:
            n = len([w for w in re.split(r"[ \t-\r]+", r.text or "") if w])
            sizes[r.source] += n
            largest[r.source] = max(largest[r.source], n)
        want = brute_targets(sizes)
        of = {(r.source_size, round(r.target, 6)) for r in got}
        assert of == {(sizes[s], round(want[s], 6)) for s in sizes}
        for r in got:
            assert 0 <= r.taken <= 2 * r.size
        for s in {r.source for r in rows}:
            ids = {r.doc_id for r in rows if r.source == s}
            taken[s] = sum(r.taken for r in got if r.doc_id in ids and round(r.target, 6) == round(want[s], 6))
            assert abs(taken[s] - want[s]) <= 3 * largest[s]
        assert sorted(map(repr, mixing.measured(df).collect())) == sorted(map(repr, got))


def test_mix_repeats_rows(spark, odd):
    copies = Counter()
    for r in mixing.measured(odd).collect():
        copies[r.doc_id] += r.copies
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    assert Counter(r.doc_id for r in mixed.collect()) == +copies
    assert mixing.mix(empty(spark)).count() == 0 == mixing.measured(empty(spark)).count()


def test_mixing_splits_large_sources_closely(spark):
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.pmod("id", F.lit(7)).cast("int") + 1).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 11)).alias("source"))
    rows = mixing.measured(many).join(many, "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("goal")).collect()
    assert all(abs(r.t - r.goal) <= 7 for r in rows)


# N-gram join


def brute_near(texts):
    sets = []
    for t in texts:
        w = WORDS.findall((t or "").translate(AZ))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n = len(texts)
    link = {(i, j) for i in range(n) for j in range(i) if sets[i] and sets[j] and texts[i] != texts[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])}
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    first = {}
    for i, t in enumerate(texts):
        if sets[i]:
            up[root(i)] = root(first.setdefault(t, i))
    for i, j in link:
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    links = Counter()
    for i, j in {(a, b) for i, j in link for a, b in ((i, j), (j, i))}:
        links[i, texts[j]] = 1
    count = Counter(i for i, _ in links)
    return [root(i) for i in range(n)], [count[i] for i in range(n)]


def test_ngram_join_matches_brute_force(spark, docs):
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    near = [(10_000 + k, " ".join(PROSE.split() * 6) + f" tail{k % 40}") for k in range(120)]  # near and exact copies
    ids, texts = [r.doc_id for r in rows] + [k for k, _ in near], [r.text for r in rows] + [t for _, t in near]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.classes(spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string")).collect()}
    roots, links = brute_near(texts)
    assert got == {i: (ids[r], n) for i, r, n in zip(ids, roots, links)}


def test_ngram_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    texts = [" ".join(f"w{i}" for i in range(200)) + f" end{k}" for k in range(60)]
    got = ngram_join.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(0, 59)}


def test_ngram_edges(spark, odd):
    got = {(r.doc_id, r.class_id, r.n_links) for r in ngram_join.classes(odd).collect()}
    assert {(1, 1, 1), (2, 1, 1), (6, 1, 1), (3, 3, 0), (4, 4, 0), (5, 5, 0), (11, 11, 0), (12, 11, 0), (None, None, 0)} <= got
    kept = ngram_join.deduplicated(odd)
    assert kept.columns == odd.columns
    assert {r[-len(CLASH) :] for r in kept.collect()} == {CLASH}
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 3, 4, 5, 7, 8, 9, 10, 11, None], key=repr)
    assert ngram_join.classes(empty(spark)).count() == 0 == ngram_join.deduplicated(empty(spark)).count()


def test_forest_depth_reaches_recall():
    d = ngram_join.depth_for()
    assert 1 - (1 - 0.8**d) ** ngram_join.TREES >= ngram_join.RECALL and (d == ngram_join.DEPTH or 1 - (1 - 0.8 ** (d + 1)) ** ngram_join.TREES < ngram_join.RECALL)


def near_threshold(n, rnd):
    """Pairs of texts with a similarity between 0.8 and 0.83."""
    out = []
    for k in range(n):
        words = [f"p{k}w{i}" for i in range(int(rnd.integers(90, 120)))]
        other = list(words)
        for at in range(8, 8 + 12 * int(len(words) * 0.0206), 12):  # each changed word costs five shingles on either side
            other[at] += "x"
        out += [" ".join(words), " ".join(other)]
    return out


def test_forest_recall_near_the_threshold(spark):
    texts = near_threshold(400, np.random.default_rng(3))
    roots, links = brute_near(texts[:40])
    assert sum(links) >= 30
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    want = sum(10 * len(a & b) >= 8 * len(a | b) for a, b in zip(sets[::2], sets[1::2]))
    got = ngram_join.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).agg(F.sum("n_links")).first()[0]
    assert want >= 300 and got == 2 * want


@pytest.mark.parametrize("parts", [1, 5])
def test_tries_count_runs_over_all_ranges(spark, monkeypatch, parts):
    """Open nodes against counts of prefixes, with small values so that nodes are shared and cross the ranges."""
    monkeypatch.setattr(ngram_join, "WIDE", 6)
    rnd = np.random.default_rng(7)
    made = [(i, int(rnd.integers(1, 50)), rnd.integers(0, 3, ngram_join.TREES * ngram_join.DEPTH).astype(">u4").tobytes()) for i in range(300)]
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {(r.tree, r.cid): (r.node, r.blocks) for r in ngram_join._open_nodes(spark.createDataFrame(made, "cid bigint, n int, paths binary"), 4).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    names = {}
    for tree in range(ngram_join.TREES):
        path = {i: p[16 * tree : 16 * tree + 16] for i, _, p in made}
        count = Counter(p[: 4 * d] for p in path.values() for d in (2, 3, 4))
        for i, p in path.items():
            lead = next(p[: 4 * d] for d in (2, 3, 4) if d == 4 or count[p[: 4 * d]] <= 6)
            if count[lead] < 2:
                assert (tree, i) not in got
                continue
            node, blocks = got.pop((tree, i))
            assert names.setdefault((tree, lead), node) == node and blocks == -(-count[lead] // 4)
    assert not got and len(set(names.values())) == len(names)


# Token output


def test_tokens_round_trip(spark, docs, odd):
    tok = token_output.tokenizer(str(token_output.vocabulary_path()))
    for df in (docs, odd):
        rows = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id, r.text or ""))
        want, start = [], 0
        for r in rows:
            ids = tok.encode(r.text or "", add_special_tokens=False).ids + [0]
            want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        got = [tuple(r) for r in token_output.encoded(df).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert token_output.encoded(empty(spark)).count() == 0


def test_encoder_is_exact_on_odd_blanks():
    rnd = np.random.default_rng(3)
    parts = ["a", " ", "  ", "\n", "\t", "é", "1", ".", "'s", " x", "\x1c", "\x85", "<|endoftext|>", "日", "​", "Ł", "word,", " Word.\nNext"]
    texts = ["".join(rnd.choice(parts, rnd.integers(1, 14))) for _ in range(4000)]
    coder = token_output.Encoder(str(token_output.vocabulary_path()))
    for t, x in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(x, "<u4").tolist() == coder.tok.encode(t, add_special_tokens=False).ids + [0]


def test_encoder_is_exact_on_marks_lines_and_a_turning_cache(monkeypatch):
    monkeypatch.setattr(token_output, "CACHE", 40)
    rnd = np.random.default_rng(5)
    parts = ["ab", "Été", "word", "***", ",", ".", "'s", "-", "12", "\n", "\n\n", " ", " ", " ", "日本", "ß", "Ł", "<", "|", "ĠĊ", "\x00"]
    coder = token_output.Encoder(str(token_output.vocabulary_path()))
    for _ in range(60):
        texts = [" ".join("".join(rnd.choice(parts, rnd.integers(1, 7))).split(" ")) for _ in range(40)] + ["", None, "ab.\nword*** ab.\nword*** ab ***"]
        for t, x in zip(texts, coder.encode(texts), strict=True):
            assert np.frombuffer(x, "<u4").tolist() == coder.tok.encode(t or "", add_special_tokens=False).ids + [0]
    assert coder.old


def test_tokenizer_is_asked_for_new_letters_only():
    class Counted:
        def __init__(self, tok):
            self.tok, self.n = tok, 0

        def __getattr__(self, name):
            return getattr(self.tok, name)

        def encode_batch_fast(self, texts, **options):
            out = self.tok.encode_batch_fast(texts, **options)
            self.n += sum(len(x.ids) for x in out)
            return out

    rnd = np.random.default_rng(7)
    words = ["".join(rnd.choice(list("abcdefgh"), 6)) for _ in range(500)]
    coder = token_output.Encoder(str(token_output.vocabulary_path()))
    least = sum(len(coder.tok.encode(" " + w).ids) for w in set(words))
    coder.tok = Counted(coder.tok)
    coder.encode(["a " + " ".join(words), "a " + " ".join(w + "," for w in words), "a " + " ".join(words)])
    assert coder.tok.n <= least + 10


def test_reader_opens_only_what_is_asked(tmp_path):
    import pyarrow.fs as pafs

    path = str(tmp_path / "x.zst")
    with open(path, "wb") as f:
        w = token_output.FrameWriter(f)
        big = np.arange(token_output.FRAME_IDS, dtype="<u4").tobytes()
        for k in range(12):
            w.add(k, big)
        w.close()
    with pafs.LocalFileSystem().open_input_file(path) as f:
        r = token_output.FrameReader(f)
        assert len(r.frames) > 1 and r.ids(r.docs[5]) == big
        seen = r.places[r.docs[11][1]]
    raw = bytearray(open(path, "rb").read())
    raw[seen + 40] ^= 1
    open(path, "wb").write(raw)
    with pafs.LocalFileSystem().open_input_file(path) as f:
        r = token_output.FrameReader(f)
        assert r.ids(r.docs[0]) == big
        with pytest.raises(Exception):  # noqa: B017
            r.ids(r.docs[11])


# Personal data


def brute_base(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c in "0123456789"][::-1]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_base_spans_match_the_patterns(spark, docs, odd):
    rnd = np.random.default_rng(4)
    texts = ["".join(rnd.choice(list("a.@-+ 01239()é%\n"), rnd.integers(1, 40))) for _ in range(20_000)]
    texts += ["".join(rnd.choice(list("0123456789 -"), rnd.integers(10, 30))) for _ in range(5000)]
    for t in texts:
        assert pii.base_spans(t) == brute_base(t)
    for df in (docs, odd):
        got = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.spans(df).collect()), key=repr)
        want = []
        for r in df.collect():
            s = brute_base(r.text or "")
            n = Counter(k for k, *_ in s)
            want.append((r.doc_id, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest()))
        assert got == sorted(want, key=repr)


def test_long_runs_stay_linear():
    assert pii.base_spans("1" * 200_000 + "a" * 200_000 + "." * 100_000) == []


@pytest.mark.parametrize("n", [256, 257, 300, 5000])
def test_secrets_have_no_greatest_length(n):
    rnd = np.random.default_rng(n)
    s = "".join(rnd.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), n))
    text = f'set token = "{s}" here'
    assert ("secret", 13, 13 + n) in [x[:3] for x in pii.added_spans([text], [pii.base_spans(text)])[0]]


def test_added_spans_and_redaction(spark, odd):
    text = 'write to bob@mail.example.com, token = "ede43f42c939b6405768150e0411590525cf889e", phone (609) 555-7932.'
    assert pii.redact(text) == 'write to [EMAIL], token = "[SECRET]", phone [PHONE].'
    assert pii.redact(PROSE) == PROSE and pii.redact("version 12.10.2024 of item 2024-10-12, at home. Of course") == "version 12.10.2024 of item 2024-10-12, at home. Of course"
    assert pii.redact(None) is None and pii.redact("") == ""
    assert pii.redacted(odd).columns == odd.columns and pii.spans(empty(spark)).count() == 0


def test_thresholds_reach_their_precision():
    import random

    trees, limits = pii.model()
    rnd = random.Random(77)
    rows = [pii._example(rnd) for _ in range(3000)]
    p = trees.probability(np.array([pii.features(*r[:4]) for r in rows]))
    chosen = [r[4] for r, q in zip(rows, p) if q >= limits[r[0]]]
    assert sum(chosen) / len(chosen) > 0.93 and sum(chosen) > 0.6 * sum(r[4] for r in rows)


# Licenses


def test_every_known_sentence_holds_a_hint_and_blanks_do_not_matter(spark):
    assert all(any(h in s for h in licenses.HINTS) for s in licenses.KNOWN)
    free = "This is free and unencumbered software released into the public{}domain."
    texts = [free.format(x) for x in (" ", "\n", "  ", "\t")] + ["This file is licensed under the MIT License.", "Note. The library is distributed under the terms of the Apache License, Version 2.0.", "CC0 1.0 Universal", "Sold under the counter."]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == {0: ["Unlicense"], 1: ["Unlicense"], 2: ["Unlicense"], 3: ["Unlicense"], 4: ["MIT"], 5: ["Apache-2.0"], 6: ["CC0-1.0"], 7: []}


def test_license_sequences_are_matched_in_linear_time(spark):
    parts = [licenses.SENTENCES[x] + ".\n" for x in ("bsd.redistribute", "bsd.source", "bsd.binary")]
    texts = ["".join(parts) * 3000, "".join(reversed(parts)), "".join(parts) * 3000 + licenses.SENTENCES["bsd.endorse"] + "."]
    began = time.time()
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == {0: ["BSD-2-Clause"], 1: [], 2: ["BSD-3-Clause"]} and time.time() - began < 60


def test_licenses(spark, odd):
    texts = [
        "x. Released under the MIT License. y", "Licensed under CC BY-NC 4.0.", "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0!", "mit license", None, "",
        "This work is licensed under the GNU General\nPublic License, version 3.\nAll rights reserved.", "Redistribution and use, in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    got = {r.doc_id: r.licenses for r in rows}
    assert got == {0: ["MIT"], 1: ["CC-BY-NC-4.0"], 2: ["Apache-2.0"], 3: [], 4: [], 5: [], 6: ["All-Rights-Reserved", "GPL-3.0"], 7: []}
    s = licenses.SENTENCES
    order = lambda *ids: ". ".join(s[i] for i in ids)
    seq = [order("bsd.redistribute", "bsd.source", "bsd.binary", "bsd.endorse"), order("bsd.redistribute", "bsd.source", "bsd.binary"), order("bsd.source", "bsd.redistribute")]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(seq)), "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.licenses for r in rows} == {0: ["BSD-3-Clause"], 1: ["BSD-2-Clause"], 2: []}
    assert licenses.scan(odd).count() == len(ROWS) and licenses.scan(empty(spark)).count() == 0


NOTICES = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.""",
    "LGPL-3.0": """This library is free software: you can redistribute it and/or modify
it under the terms of the GNU Lesser General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published
by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of Example Works, Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.""",
}


def test_published_notices_plain_indented_and_in_comments(spark):
    def dressed(text):
        lines = text.split("\n")
        yield text
        yield text.replace("\n", "\r\n")
        yield "\n".join("    " + x for x in lines)
        for lead in ("# ", "// ", ";; ", "-- ", "> "):
            yield "code()\n\n" + "\n".join((lead + x).rstrip() for x in lines) + "\n\ncode()"
        yield "/*\n" + "\n".join((" * " + x).rstrip() for x in lines) + "\n */\ncode()"
        yield "/* " + "\n   ".join(lines) + " */"
        yield "<!--\n" + text + "\n-->"

    rows = [(f"{name} {k}", t) for name, text in NOTICES.items() for k, t in enumerate(dressed(text))]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {r.doc_id: r.licenses for r in got} == {k: [k.split()[0]] for k, _ in rows}


def test_near_misses_of_notices_are_no_licences(spark):
    bsd, gpl = NOTICES["BSD-3-Clause"], NOTICES["GPL-2.0"]
    texts = [bsd[: bsd.index("3. Neither")], bsd[: bsd.index("2. Redis")], gpl.replace("version 2", "version 1"), gpl.replace("General", "Lesser General"), "the mozilla public license, v. 2.0 is a license", "call 555-0938\nLicensed under the Apache License, Version 2.0."]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.licenses for r in rows} == {0: ["BSD-2-Clause"], 1: [], 2: [], 3: [], 4: [], 5: ["Apache-2.0"]}


def test_every_header_is_normal_and_used_by_known_rules():
    known = licenses.SENTENCES | licenses.HEADERS
    assert len(set(known.values())) == len(known) and {i for seqs in licenses.HEADER_RULES.values() for q in seqs for i in q} <= set(known)
    assert set(licenses.HEADER_RULES) <= {name for name, _, _ in licenses.RULES}
    for s in licenses.HEADERS.values():
        assert re.fullmatch(r"[a-z0-9]+( [a-z0-9]+)*", s), s


def test_every_known_sentence_is_normal_and_hinted():
    for s in licenses.SENTENCES.values():
        assert re.fullmatch(r"[a-z0-9]+( [a-z0-9]+)*", s) and re.search(licenses.HINT, s), s


# Classifiers


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_quality_on_held_out_rows(spark, labels):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality_classifier.fit(docs, labels, keep=fold_of("doc_id", 3) != 1)
    rows = quality_classifier.scored(docs, model).join(labels, "doc_id").filter(fold_of("doc_id", 3) == 1).collect()
    right = sum((r.score >= 0.5) == (r.quality == 1) for r in rows)
    assert right / len(rows) > 0.9


def test_quality_edges(spark, odd, labels):
    none = quality_classifier.fit(odd, labels.limit(0))
    assert {r.score for r in quality_classifier.scored(odd, none).collect()} == {0.5}
    assert quality_classifier.scored(empty(spark), none).count() == 0
    few = quality_classifier.fit(odd, spark.createDataFrame([(1, 1, None), (4, 0, 1), (None, 1, 1), (99, None, 0)], "doc_id bigint, quality int, toxic int"))
    assert all(0 <= r.score <= 1 for r in quality_classifier.scored(odd, few).collect())


def test_random_indexing_matches_a_plain_loop(spark):
    texts = ["a b a c", "c, d", None, "", "a"]
    got = quality_classifier.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2))
    slots, total, count = quality_classifier.Slots(), np.zeros((quality_classifier.VOCABULARY, quality_classifier.SIZE)), Counter()
    for t in texts:
        ids = slots.of(t).tolist()
        for i, a in enumerate(ids):
            count[a] += 1
            for j in range(max(0, i - 2), min(len(ids), i + 3)):
                if i != j:
                    np.add.at(total[a], quality_classifier._PLACES[ids[j]], quality_classifier._SIGNS[ids[j]])
    centre = total.sum(axis=0) / sum(count.values())
    for a, n in count.items():
        assert np.allclose(got[a], total[a] / n - centre, atol=1e-4)


def test_block_max_search_is_exact():
    rnd = np.random.default_rng(9)
    factor = np.r_[rnd.uniform(1, 6, 400), 0.0]
    chance = 1 / np.arange(2, 402)  # some terms are in most vectors, most in few
    picks = [np.flatnonzero(rnd.random(400) < chance * 3) for _ in range(1100)]
    vectors = [(p, toxicity.weigh(rnd.integers(1, 4, len(p)).astype(float), factor[p])) for p in picks]
    flat = [np.concatenate([v[k] for v in vectors[:900]]) for k in (0, 1)]
    index = toxicity.Index({f"t{i}": i for i in range(401)}, factor, np.array([len(v[0]) for v in vectors[:900]]), flat[0].astype(int), flat[1], rnd.integers(0, 2, 900).astype(float), np.arange(900), 0.5)
    assert index.often.any() and not index.often.all()
    for terms, weights in [*vectors[900:], (np.empty(0, int), np.empty(0)), (np.array([400]), np.array([1.0])), (np.array([399]), np.array([1.0]))]:
        q = np.zeros(401)
        q[terms] = weights
        of = {int(index.ids[i]): i for i in range(900)}
        cosines = np.zeros(900)
        for e, (t, w) in enumerate(vectors[:900]):
            cosines[of[e]] = (q[t] * w).sum()
        at, score = index.nearest(terms.astype(int), weights)
        cut = max(np.sort(cosines)[-toxicity.K], 1e-9)
        assert set(np.flatnonzero(cosines > cut + 1e-9)) <= set(at) <= set(np.flatnonzero(cosines >= cut - 1e-9))
        assert np.allclose(score, cosines[at])


def test_toxicity_matches_a_plain_cosine_over_all_words(spark, labels):
    """Fit and scores against dictionaries, with every word of every indexed example as a term."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    keep = fold_of("doc_id", 4) != 2
    index = toxicity.fit(docs, labels, keep=keep)
    held = {r.doc_id: r.held for r in toxicity.examples(docs, labels, "toxic", keep, toxicity.MAX_EXAMPLES).collect()}
    label = {r.doc_id: r.toxic for r in labels.collect()}
    words = {r.doc_id: Counter(re.findall(r"[^\W\d_]+", (r.text or "").lower())) for r in docs.collect()}
    frequency = Counter(w for c in words.values() for w in c)
    inside = [d for d, h in held.items() if not h]
    of = [Counter(w for d in inside if label[d] == y for w in words[d]) for y in (0, 1)]
    assert set(index.vocabulary) == set(of[0]) | set(of[1])
    factor = {w: np.log((1 + len(words)) / (1 + frequency[w])) * np.log2(2 + of[1][w] / max(1, of[0][w])) for w in index.vocabulary}

    def vector(d):
        raw = {w: (1 + np.log(n)) * factor[w] for w, n in words[d].items() if w in factor}
        norm = sum(x * x for x in raw.values()) ** 0.5
        return {w: x / norm for w, x in raw.items()} if norm else {}

    vectors = {d: vector(d) for d in inside}
    near = {r.doc_id: (r.score, r.near) for r in toxicity.scored(docs, index).collect()}
    for d in words:
        v = vector(d)
        cosine = {e: sum(x * vectors[e].get(w, 0.0) for w, x in v.items()) for e in inside}
        cut = max(sorted(cosine.values())[-toxicity.K], 1e-11)
        votes = {e: c**toxicity.SHARPNESS for e, c in cosine.items() if c >= cut - 1e-12}
        if not votes:
            assert near[d] == (index.prior, [])
            continue
        share = sum(x for e, x in votes.items() if label[e]) / sum(votes.values())
        assert abs(np.interp(share, index.grid, index.table) - near[d][0]) < 1e-6
        assert near[d][1] == sorted(votes, key=lambda e: (-round(cosine[e], 9), e))[:5]


def test_toxicity_on_held_out_rows(spark, labels):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    index = toxicity.fit(docs, labels, keep=fold_of("doc_id", 4) != 2)
    rows = toxicity.scored(docs, index).join(labels, "doc_id").filter(fold_of("doc_id", 4) == 2).collect()
    assert sum((r.score >= 0.3) == (r.toxic == 1) for r in rows) / len(rows) > 0.85 and len({r.score for r in rows}) > len(rows) / 4
    kept = toxicity.keep_clean(docs, index)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_toxicity_edges(spark, odd, labels):
    none = toxicity.fit(odd, labels.limit(0))
    assert {r.score for r in toxicity.scored(odd, none).collect()} == {0.0}
    assert toxicity.keep_clean(odd, none).count() == len(ROWS) and toxicity.scored(empty(spark), none).count() == 0
    few = toxicity.fit(odd, spark.createDataFrame([(1, 1, None), (4, 0, 1), (None, 1, 1), (99, None, 0), (6, 1, 0)], "doc_id bigint, quality int, toxic int"))
    assert all(0 <= r.score <= 1 for r in toxicity.scored(odd, few).collect())
