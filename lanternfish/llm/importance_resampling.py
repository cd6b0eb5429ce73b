"""Target-distribution importance resampling over hashed word n-grams, with an integer word dictionary.

1. Words get numbers in a dictionary that a task fills as it meets them, so an n-gram is a tuple of numbers. The distinct tuples
   of a batch are found by sorting these numbers; the bytes of each distinct tuple are put together and hashed once, and its
   bucket goes back to all places of the tuple. A document leaves the pass as its buckets, 2 bytes for each feature.
2. Buckets are counted within tasks before they are shuffled: one row for each task and bucket. A bucket's gain is the logarithm
   of its share in the target over its share in the corpus; there are MODULUS gains, whatever the corpus.
3. A document's weight is the floored mean of its gains; with Gumbel noise from its id's hash, the highest scores are a sample
   without replacement by weight. Scores are whole numbers within a fixed range (logarithms of 64-bit counts), so the score at
   which the sample ends comes from counts by score.
4. Rows at or above it are dealt to ranges of score and id, sorted there and numbered; a range's ranks start after the rows of the
   ranges before it. Ranges are also cut within equal ids, so no task holds more than its share.

The dictionary of a task starts anew at WORDS entries; this bounds its memory and never changes a bucket.

Defined cases: a null text has no words, weight 0, and is never drawn; a null id is hashed as the empty text and comes last among
equal scores; rows that repeat are scored and drawn each for itself; an empty target has all counts 0; an empty table gives no
rows; further columns are left out.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.llm.common import map_arrow, stored, table

MODULUS, LENGTHS, SEED = 10_000, (1, 2), 7
LEAST_WORDS, SHARE = 20, (25, 100)
#: Distinct words that a task keeps numbered.
WORDS = 1 << 20

#: Letters A-Z in lower case, digits, a-z and all bytes of longer characters as they are, everything else a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Dictionary:
    """Words and their numbers, in order of appearance."""

    def __init__(self, modulus: int):
        self.modulus, self.number, self.words = modulus, {}, []

    def ids(self, words: list[bytes]) -> np.ndarray:
        if len(self.words) > WORDS:
            self.number, self.words = {}, []
        number = self.number
        for w in set(words).difference(number):
            number[w] = len(self.words)
            self.words.append(w)
        return np.fromiter(map(number.__getitem__, words), np.int64, len(words))

    def buckets(self, ids: np.ndarray, owner: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and owner of every run of n ids within one owner, for each n of lengths."""
        out, of = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for n in lengths:
            m = len(ids) - n + 1
            if m < 1:
                continue
            inside = np.flatnonzero(owner[:m] == owner[n - 1 :])
            # Each step joins one more word to the distinct tuples so far: a pair of numbers stands for a whole tuple.
            uniq, place = np.unique(ids[inside], return_inverse=True)
            tuples = uniq[:, None]
            for k in range(1, n):
                pair, place = np.unique((place.astype(np.int64) << 32) | ids[inside + k], return_inverse=True)
                tuples = np.column_stack([tuples[pair >> 32], pair & 0xFFFFFFFF])
            words = self.words
            crc = [zlib.crc32(b" ".join([words[i] for i in t])) for t in tuples.tolist()]
            out.append((np.array(crc, np.int64) % self.modulus)[place] if crc else np.empty(0, np.int64))
            of.append(owner[inside])
        bucket, of_ = np.concatenate(out), np.concatenate(of)
        order = np.argsort(of_, kind="stable")
        return bucket[order], of_[order]


def _kind(modulus: int) -> np.dtype:
    return np.dtype("<u2" if modulus <= 1 << 16 else "<u4")


def features(docs: DataFrame, id_col: str, text_col: str, modulus: int = MODULUS, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """id, n_words, n_features and buckets (whole numbers of 2 or 4 bytes) of every row."""
    kind = _kind(modulus)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Dictionary(modulus)
        for b in batches:
            split = [(t or b"").translate(_FOLD).split() for t in b.column(1).to_pylist()]
            count = np.array([len(w) for w in split], np.int64)
            ids = known.ids([w for words in split for w in words])
            bucket, of = known.buckets(ids, np.repeat(np.arange(len(split)), count), lengths)
            n = np.bincount(of, minlength=len(split)) if len(split) else np.empty(0, np.int64)
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(split), [None, pa.py_buffer(np.r_[0, np.cumsum(n * kind.itemsize)].astype(np.int64).tobytes()), pa.py_buffer(bucket.astype(kind).tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), pa.array(n, pa.int64()), data.cast(pa.binary())], ["id", "n_words", "n_features", "buckets"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return map_arrow(rows, work, f"id {docs.schema[id_col].dataType.simpleString()}, n_words bigint, n_features bigint, buckets binary")


def histogram(rows: DataFrame, modulus: int = MODULUS) -> list[int]:
    """How often each bucket occurs, over all rows of features()."""
    kind = _kind(modulus)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(modulus, np.int64)
        for b in batches:
            for data in b.column(0).to_pylist():
                total += np.bincount(np.frombuffer(data, kind), minlength=modulus)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    out = [0] * modulus
    for r in map_arrow(rows.select("buckets"), count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log ratio of each bucket's smoothed shares, floored, in doubles."""
    m, s, t = len(corpus), sum(corpus), sum(target)
    return [math.floor(1000 * math.log(float((b + 1) * (s + m)) / float((a + 1) * (t + m)))) for a, b in zip(corpus, target, strict=True)]


def noise(doc_id: str, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(rows: DataFrame, gain: list[int], seed: int = SEED) -> DataFrame:
    """features() rows with weight and score in place of buckets, and row, a number of the row."""
    kind, value = _kind(len(gain)), np.array(gain, np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weight = [int(value[np.frombuffer(d, kind)].sum()) // (len(d) // kind.itemsize) if d else 0 for d in b.column(4).to_pylist()]
            score = [w + noise(i or "", seed) for w, i in zip(weight, b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(weight, pa.int64()), pa.array(score, pa.int64())], ["id", "n_words", "n_features", "weight", "score"])

    named = rows.select("id", F.col("id").cast("string").alias("name"), "n_words", "n_features", "buckets")
    out = map_arrow(named, work, f"id {rows.schema['id'].dataType.simpleString()}, n_words bigint, n_features bigint, weight bigint, score bigint")
    return out.withColumn("row", F.monotonically_increasing_id())


def ranked(rows: DataFrame, allowed: Column, share: tuple[int, int] = SHARE) -> DataFrame:
    """Stored scored() rows with rank: 1, 2, … by descending score, then id, for the share of the allowed rows that is drawn."""
    spark = rows.sparkSession
    # One row for each score that occurs: scores lie within the range of the logarithms of 64-bit counts and of the noise.
    counts = sorted(((r.score, r.n) for r in rows.filter(allowed).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    draw = sum(n for _, n in counts) * share[0] // share[1]
    cut, left = None, draw
    for score, n in counts:
        if left <= 0:
            break
        cut, left = score, left - n
    none = F.lit(None).cast("bigint").alias("rank")
    if cut is None:
        return rows.select("*", none)
    over = allowed & (F.col("score") >= cut)
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]
    dealt = rows.filter(over).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(np.arange(at + 1, at + 1 + b.num_rows), pa.int64())], [*b.schema.names, "part", "place"])
            at += b.num_rows

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = stored(map_arrow(dealt, number, f"{fields}, part int, place bigint"), "resampling-placed")
    # One row for each range.
    before, start = 0, []
    for r in sorted(placed.groupBy("part").count().collect()):
        start.append((r[0], before))
        before += r[1]
    at = F.broadcast(spark.createDataFrame(start, "part int, before bigint"))
    rank = F.col("before") + F.col("place")
    drawn = placed.join(at, "part").select(*rows.columns, F.when(rank <= draw, rank).alias("rank"))
    return rows.filter(~over).select("*", none).unionByName(drawn)


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """id, n_words, n_features, weight, score and rank of every row of docs; target holds texts of the wanted distribution."""
    mine = stored(features(docs, id_col, text_col), "resampling-features")
    gain = gains(histogram(mine), histogram(features(target.select(F.lit(0).alias("id"), F.col(target_text).alias("t")), "id", "t")))
    rows = stored(scored(mine, gain), "resampling-scored")
    out = ranked(rows, F.col("n_words") >= LEAST_WORDS)
    return out.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


# DuckDB has no crc32: it is folded over the bytes of each distinct feature, with the table of its 256 remainders.
ORACLE_SQL = {
    "op12_resampling": rf"""
WITH crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) AS r(i)),
d AS (SELECT 0 AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
      UNION ALL
      SELECT 1, row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT side, id, unnest(w) AS g FROM d UNION ALL SELECT side, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d),
u AS (SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM f)),
b AS (SELECT g, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
                                lambda c, y: xor(c >> 8, tab[xor(c & 255, y) + 1])), 4294967295) % {MODULUS} AS bucket FROM u CROSS JOIN crc),
h AS (SELECT bucket, count_if(side = 0) AS s, count_if(side = 1) AS t FROM f JOIN b USING (g) GROUP BY bucket),
n AS (SELECT sum(s)::BIGINT AS s, sum(t)::BIGINT AS t FROM h),
q AS (SELECT bucket, floor(1000 * ln(((h.t + 1) * (n.s + {MODULUS}))::DOUBLE / ((h.s + 1) * (n.t + {MODULUS}))::DOUBLE))::BIGINT AS gain FROM h CROSS JOIN n),
w AS (SELECT id, count(*) AS n, sum(gain)::BIGINT AS gain FROM f JOIN b USING (g) JOIN q USING (bucket) WHERE side = 0 GROUP BY id),
s AS (SELECT d.id, len(d.w) AS n_words, coalesce(w.n, 0) AS n_features, coalesce((gain - ((gain % w.n) + w.n) % w.n) // w.n, 0) AS weight,
             floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise FROM d LEFT JOIN w ON w.id = d.id WHERE d.side = 0),
r AS (SELECT id, row_number() OVER (ORDER BY weight + noise DESC, id) AS rank, {SHARE[0]} * count(*) OVER () // {SHARE[1]} AS most FROM s WHERE n_words >= {LEAST_WORDS})
SELECT s.id AS doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, (weight + noise)::BIGINT AS score, r.rank::BIGINT AS rank
FROM s LEFT JOIN r ON r.id = s.id AND r.rank <= r.most""",
}
QUERIES = {"op12_resampling": op12_resampling}
