"""N-gram Jaccard join: MinHash LSH forest, then exact verification.

Texts are lower-cased words; a shingle is SHINGLE consecutive words (a text of fewer words is one shingle); two texts are linked
if the Jaccard similarity of their shingle sets is at least THRESHOLD.

1. Rows are grouped by the hash of the text into classes of exact copies; all that follows is about one text for each class.
2. A signature feeds TREES prefix tries, each a path of DEPTH MinHash values. The paths of all texts are sorted by tree and path
   over ranges, so a trie's nodes are runs of a sorted array; a walk over each range counts the runs at every depth, and runs
   that go on in the next range are summed up.
3. Matched prefixes are shortened from DEPTH. At the depth at which a pair at the threshold is found with probability RECALL the
   texts of every node meet; a node of at most WIDE texts is shortened further, as long as it stays so small, which finds the
   rest of the pairs for next to nothing. So every text has one open node in each tree, at a depth of its own.
4. Open nodes are cut into blocks by count and by weight, and pairs of blocks are the units of work, so no task holds a whole
   node. A pair is looked at only in the first tree in which it meets; no pair is ever a row.
5. Units whose members have such a pair get the shingles of these members and count exact links; they return a count for each
   member and the edges of a spanning forest.
6. Classes that are linked, directly or over others, form groups (minimum labels with pointer jumping on tables).

Defined cases: null texts and texts without words link to nothing and stand alone, even when equal; repeated rows are copies;
null ids are allowed, the least id that is not null names a group (null if there is none); empty tables give no rows; further
columns pass through deduplicated() unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.llm.common import fresh, map_arrow, stored, table

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 20, 4, 0.9999
#: Texts of a node up to which its prefix is shortened further, and by how many values at most.
WIDE, SHORTER = 32, 2
#: Members and shingles of a block of a node.
BLOCK, BLOCK_SHINGLES = 256, 2_000_000
#: Distinct words whose hashes a task keeps; at the bound it starts anew.
CACHE = 300_000

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(1 << 62, 1 << 63, TREES * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(0, 1 << 63, TREES * DEPTH, np.uint64)
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def depth_for(threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair at the threshold is found in some tree with probability `recall`."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, cache: dict[str, int]) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text."""
    words = _WORD.findall((text or "").translate(_AZ))
    if not words:
        return np.empty(0, np.uint64)
    if len(cache) > CACHE:
        cache.clear()
    got = [cache.get(w) for w in words]
    if None in got:
        for k, v in enumerate(got):
            if v is None:
                got[k] = cache[words[k]] = xxhash.xxh3_64_intdigest(words[k])
    h = np.array(got, np.uint64)
    n = max(1, len(h) - SHINGLE + 1)
    acc = np.full(n, len(h) if len(h) < SHINGLE else SHINGLE, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        acc = _mixed(acc * _STEP + h[k : k + n])
    return np.unique(acc)


def paths(sh: np.ndarray) -> bytes:
    """DEPTH MinHash values of 4 bytes for each tree, one tree after the other; bytes sort as the values do."""
    low = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(sh), 2048):
        np.minimum(low, ((sh[k : k + 2048, None] ^ _FLIP) * _MULTIPLY).min(axis=0), out=low)
    return (_mixed(low * _STEP) >> np.uint64(32)).astype(">u4").tobytes()


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of equal first `keys` columns, which stand together."""
    at, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:keys] != at:
                if held:
                    yield at, held
                at, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield at, held


def _pairs(tree: int, bi: int, bj: int, block: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members of the two blocks of a unit, and which pairs of them meet in this tree first."""
    a = np.flatnonzero(block == bi)
    b = a if bi == bj else np.flatnonzero(block == bj)
    meet = np.ones((len(a), len(b)), bool)
    for t in range(tree):
        meet &= keys[a, t][:, None] != keys[b, t][None, :]
    meet &= keys[a, tree][:, None] == keys[b, tree][None, :]
    if bi == bj:
        meet &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
    return a, b, meet


def _links(meet: np.ndarray, left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of the pairs in `meet` reach the threshold, by exact intersections."""
    n1, n2 = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    # Sizes bound the similarity: the smaller set must be at least `threshold` of the larger.
    meet = meet & (np.minimum(n1[:, None], n2[None, :]) >= threshold * np.maximum(n1[:, None], n2[None, :]) - 1e-9)
    rows, cols = np.nonzero(meet)
    both = np.zeros(meet.shape)
    if len(rows) <= 4 * (len(left) + len(right)):
        for i, j in zip(rows, cols, strict=True):
            both[i, j] = len(np.intersect1d(left[i], right[j], assume_unique=True))
    else:
        flat = np.concatenate([*left, *right])
        _, place, count = np.unique(flat, return_inverse=True, return_counts=True)
        place = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[place]
        width = int((count > 1).sum())
        owner = np.repeat(np.arange(len(left) + len(right)), np.concatenate([n1, n2]))
        owner, place = owner[place >= 0], place[place >= 0]
        for k in range(0, width, 4096):
            m = np.zeros((len(left) + len(right), min(4096, width - k)), np.float32)
            here = (place >= k) & (place < k + 4096)
            m[owner[here], place[here] - k] = 1
            both += m[: len(left)] @ m[len(left) :].T
    whole = n1[:, None] + n2[None, :] - both
    return meet & (both >= threshold * whole - 1e-9)


def _forest(n: int, pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """(member, root) for members that are linked within a unit, roots left out."""
    up = list(range(n))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in pairs:
        i, j = root(i), root(j)
        if i != j:
            up[max(i, j)] = min(i, j)
    return [(i, root(i)) for i in range(n) if root(i) != i]


def _groups(edges: DataFrame) -> DataFrame:
    """cid -> root, the least cid of its connected component. edges: a, b."""
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "ngram-edges")
    labels = stored(both.groupBy(F.col("a").alias("cid")).agg(F.min("b").alias("m")).select("cid", F.least("cid", "m").alias("root")), "ngram-labels")
    while True:
        near = both.join(labels.select(F.col("cid").alias("b"), "root"), "b").groupBy(F.col("a").alias("cid")).agg(F.min("root").alias("m"))
        step = labels.join(near, "cid").select("cid", F.col("root").alias("old"), F.least("root", "m").alias("to"))
        step = stored(step, "ngram-step")
        jump = step.select(F.col("cid").alias("to"), F.col("to").alias("next"))
        now = stored(step.join(jump, "to").select("cid", "old", F.least("to", "next").alias("root")), "ngram-labels")
        labels = now.select("cid", "root")
        if now.filter("old <> root").isEmpty():
            return labels


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, key (hash of the text), text_id (least id of the exact copies), class_id (least id of the group of near copies),
    n_links (other texts that this text is linked to) and root (number of the group, null without words) for every row of docs."""
    depth = depth_for(threshold)
    id_type = docs.schema[id_col].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for b in batches:
            sets = [shingles(t, cache) for t in b.column(2).to_pylist()]
            made = [paths(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int32()), pa.array(made, pa.binary())], ["id", "key", "n", "paths"])

    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("key"), F.col(text_col).alias("text"))
    signed = stored(map_arrow(rows, sign, f"id {id_type}, key binary, n int, paths binary"), "ngram-signed")
    texts = signed.filter("n > 0").groupBy("key").agg(F.min("id").alias("text_id"), F.max("n").alias("n"), F.max("paths").alias("paths"))
    texts = stored(texts.select(F.monotonically_increasing_id().alias("cid"), "*"), "ngram-texts")

    nodes = stored(_open_nodes(texts, depth), "ngram-nodes")
    # One row for each text again, with its open nodes of all trees (a number of its own where it has none).
    of = F.map_from_entries(F.collect_list(F.struct("tree", "node")))
    mine = nodes.groupBy("cid").agg(of.alias("of"), F.collect_list(F.struct("tree", "node", "blocks")).alias("open"))
    keys = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.lpad(F.hex(F.coalesce(F.col("of")[t], F.xxhash64("cid", t))), 16, "0"))
    mine = mine.select("cid", F.unhex(F.array_join(keys, "")).alias("keys"), F.inline("open"))
    met = mine.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    unit = ["tree", "node", "bi", "bj"]
    met = met.select("tree", "node", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "cid", "keys")

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (tree, node, bi, bj), rows in _runs(batches, 4):
            block = np.array([r[0] for r in rows])
            keys = np.frombuffer(b"".join(r[2] for r in rows), ">i8").reshape(len(rows), TREES)
            a, b, meet = _pairs(tree, bi, bj, block, keys)
            for k in sorted({*a[meet.any(axis=1)].tolist(), *b[meet.any(axis=0)].tolist()}):
                out.append((tree, node, bi, bj, *rows[k]))
            if len(out) >= 4096:
                yield _batch(out)
                out = []
        yield _batch(out)

    fields = "tree int, node bigint, bi int, bj int, block int, cid bigint, keys binary"
    members = stored(map_arrow(met.repartition(*unit).sortWithinPartitions(*unit), needed, fields), "ngram-members")

    # The shingles of the texts that have a candidate, each made once.
    wanted = texts.join(members.select("cid").distinct(), "cid", "left_semi").select("cid", "key", F.col("text_id"))
    source = rows.filter(F.col("text").isNotNull()).join(wanted, (F.col("id").eqNullSafe(F.col("text_id"))) & (rows["key"] == wanted["key"])).select("cid", "text")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for b in batches:
            sets = pa.array([shingles(t, cache).tobytes() for t in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), sets], ["cid", "shingles"])

    # Rows that repeat id and text give the same shingles twice; one of them is enough.
    made = map_arrow(source, expand, "cid bigint, shingles binary")
    if not signed.groupBy("id", "key").count().filter("count > 1").isEmpty():
        made = made.groupBy("cid").agg(F.first("shingles").alias("shingles"))
    filled = members.join(made, "cid").select(*unit, "block", "cid", "keys", "shingles")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, _, bi, bj), rows in _runs(batches, 4):
            block = np.array([r[0] for r in rows])
            cid = [r[1] for r in rows]
            keys = np.frombuffer(b"".join(r[2] for r in rows), ">i8").reshape(len(rows), TREES)
            sets = [np.frombuffer(r[3], np.uint64) for r in rows]
            a, b, meet = _pairs(tree, bi, bj, block, keys)
            linked = _links(meet, [sets[k] for k in a], [sets[k] for k in b], threshold)
            count = np.zeros(len(rows), np.int64)
            np.add.at(count, a, linked.sum(axis=1))
            np.add.at(count, b, linked.sum(axis=0))
            if count.any():
                i, j = np.nonzero(linked)
                up = dict(_forest(len(rows), zip(a[i].tolist(), b[j].tolist(), strict=True)))
                out = [(cid[k], cid[up.get(k, k)], n) for k, n in enumerate(count.tolist()) if n]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["cid", "root", "links"])

    found = stored(map_arrow(filled.repartition(*unit).sortWithinPartitions(*unit), verify, "cid bigint, root bigint, links bigint"), "ngram-links")
    links = found.groupBy("cid").agg(F.sum("links").alias("n_links"))
    roots = _groups(found.filter("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b")))
    joined = texts.select("cid", F.col("key").alias("of_key"), "text_id").join(links, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    joined = stored(joined, "ngram-joined")
    least = stored(joined.groupBy("root").agg(F.min("text_id").alias("class_id")), "ngram-least")
    named = stored(joined.join(least, "root").select("of_key", "text_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "root"), "ngram-named")
    out = signed.select("id", "key", "n").join(named, (F.col("key") == F.col("of_key")) & (F.col("n") > 0), "left")
    alone = F.col("of_key").isNull()
    return out.select(
        F.col("id").alias(id_col), "key", F.when(alone, F.col("id")).otherwise(F.col("text_id")).alias("text_id"),
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "root",
    )


def _entries(texts: DataFrame) -> DataFrame:
    """tree, path, cid and n for each tree of each text."""
    each = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring(F.col("paths"), t * F.lit(4 * DEPTH) + F.lit(1), F.lit(4 * DEPTH)))
    return texts.select("cid", "n", F.posexplode(each).alias("tree", "path")).select("tree", "path", "cid", "n")


def _walk(batches: Iterator[pa.RecordBatch], depths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """A sorted range of tree, path, cid, n: members and weight of each row's run at each depth, and whether the run is the first
    or last of the range, so that it may go on outside. Rows that stand alone at every depth are left out."""

    def annotated(held: list[pa.RecordBatch], first: bool, last: bool) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        tree, n = t["tree"].to_numpy(), t["n"].to_numpy().astype(np.int64)
        values = np.frombuffer(b"".join(t["path"].to_pylist()), ">u4").reshape(len(tree), DEPTH)
        new, out, keep = np.r_[True, tree[1:] != tree[:-1]], [], np.zeros(len(tree), bool)
        for d in range(1, max(depths) + 1):
            new[1:] |= values[1:, d - 1] != values[:-1, d - 1]
            if d not in depths:
                continue
            starts = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            members, weight = np.diff(np.r_[starts, len(tree)])[run], np.add.reduceat(n, starts)[run]
            edge = (first & (run == 0)) | (last & (run == len(starts) - 1))
            keep |= (members > 1) | edge
            out += [pa.array(members, pa.int64()), pa.array(weight, pa.int64()), pa.array(edge, pa.bool_())]
        names = [x + str(d) for d in depths for x in ("members", "weight", "edge")]
        return pa.RecordBatch.from_arrays([*(t[c].combine_chunks() for c in t.column_names), *out], [*t.column_names, *names]).filter(pa.array(keep))

    # A chunk ends with a run of the shortest depth.
    wide, held, at, first = 4 * min(depths), [], None, True
    for b in batches:
        if not b.num_rows:
            continue
        lead = list(zip(b.column("tree").to_pylist(), (x[:wide] for x in b.column("path").to_pylist()), strict=True))
        cut = 0
        if lead[-1] != at:
            cut = lead.index(lead[-1])
            if held or cut:
                if cut:
                    held.append(b.slice(0, cut))
                yield annotated(held, first, False)
                first, held = False, []
            at = lead[-1]
        held.append(b.slice(cut))
    if held:
        yield annotated(held, first, True)


def _open_nodes(texts: DataFrame, depth: int) -> DataFrame:
    """tree, node, blocks and cid of each text's open node in each tree in which others share it."""
    depths = tuple(range(max(1, depth - SHORTER), depth + 1))
    ranges = _entries(texts).repartitionByRange("tree", "path", "cid").sortWithinPartitions("tree", "path", "cid")
    fields = "tree int, path binary, cid bigint, n int, " + ", ".join(f"members{d} bigint, weight{d} bigint, edge{d} boolean" for d in depths)
    rows = stored(map_arrow(ranges, lambda batches: _walk(batches, depths), fields), "ngram-tries")
    chosen = F.lit(None)
    for d in reversed(depths):
        lead = F.substring("path", 1, 4 * d)
        # Two runs of a range at most are at its edges, so there are at most two rows for each task; all rows of such a run are marked.
        whole = rows.filter(f"edge{d}").groupBy(F.col("tree").alias("at"), lead.alias("lead")).agg(F.count("*").alias(f"all{d}"), F.sum("n").alias(f"sum{d}"))
        rows = rows.join(F.broadcast(whole), F.col(f"edge{d}") & (F.col("tree") == F.col("at")) & (lead == F.col("lead")), "left").drop("at", "lead")
        members, weight = F.coalesce(f"all{d}", f"members{d}"), F.coalesce(f"sum{d}", f"weight{d}")
        node = F.struct(F.xxhash64("tree", F.lit(d), lead).alias("node"), members.alias("members"), weight.alias("weight"))
        chosen = node if d == depth else F.when(members <= WIDE, node).otherwise(chosen)
    out = rows.select("tree", "cid", chosen.alias("x")).filter("x.members > 1")
    blocks = F.greatest(F.ceil(F.col("x.members") / BLOCK), F.ceil(F.col("x.weight") / BLOCK_SHINGLES)).cast("int")
    return out.select("tree", F.col("x.node").alias("node"), blocks.alias("blocks"), "cid")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"tree": pa.int32(), "node": pa.int64(), "bi": pa.int32(), "bj": pa.int32(), "block": pa.int32(), "cid": pa.int64(), "keys": pa.binary()}
    cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True)], list(kinds))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group: that of the least id, and of several such rows one of the least text hash."""
    of, keep_id, keep_key = fresh(docs, "ngram_key", "ngram_keep_id", "ngram_keep_key")
    judged = stored(classes(docs, id_col, text_col), "ngram-judged").select(F.col(id_col).alias("id"), "key", "root")
    grouped = judged.filter("root IS NOT NULL")
    first = grouped.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("x"))
    first = stored(first.select(F.col("x.id").alias(keep_id), F.col("x.key").alias(keep_key)), "ngram-kept")
    marked = docs.withColumn(of, F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    kept = marked.join(first, F.col(id_col).eqNullSafe(F.col(keep_id)) & (F.col(of) == F.col(keep_key)))
    many = grouped.groupBy("id", "key").count().filter("count > 1")
    if not many.isEmpty():  # the same row several times
        kept = kept.dropDuplicates([id_col, of])
    wordless = docs.filter(F.col(text_col).isNull() | ~F.col(text_col).rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))
    return kept.select(*docs.columns).unionByName(wordless)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "text_id", "n_links")


ORACLE_SQL = {
    "op2_ngram_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT min(doc_id) AS text_id, any_value(w) AS w, text FROM d WHERE len(w) > 0 GROUP BY text),
s AS (SELECT DISTINCT text_id, hash(array_to_string(w[i:i + {SHINGLE - 1}], ' ')) AS h
      FROM (SELECT text_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM t)),
n AS (SELECT text_id, count(*) AS n FROM s GROUP BY text_id),
b AS (SELECT x.text_id AS a, y.text_id AS b, count(*) AS common FROM s x JOIN s y ON x.h = y.h AND x.text_id <> y.text_id GROUP BY ALL),
e AS (SELECT a, b FROM b JOIN n x ON x.text_id = a JOIN n y ON y.text_id = b WHERE 10 * common >= {round(10 * THRESHOLD)} * (x.n + y.n - common)),
r AS (SELECT text_id AS a, text_id AS b FROM t UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS class_id FROM r GROUP BY a),
l AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(text_id, doc_id) AS text_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM d LEFT JOIN t ON d.text = t.text AND len(d.w) > 0 LEFT JOIN c ON c.a = text_id LEFT JOIN l ON l.a = text_id""",
}
QUERIES = {"op2_ngram_join": op2_ngram_join}
