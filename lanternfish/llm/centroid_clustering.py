"""Centroid clustering of integer vectors: distances by GEMM expansion, sums by treeAggregate.

A vector's components x become whole numbers floor(64 * x). Squared distances to all centroids are |x|^2 - 2 x.c + |c|^2, by one
matrix product of doubles for each block of rows. Every term and partial sum is a whole number, so the product is exact in any
order of summation as long as the sums stay below 2^53, which a bound on the magnitudes of rows and centroids guarantees. Rows or
centroids beyond the bound are computed in 64-bit integers, and beyond the bound of those in whole numbers of any length.

Each round is one pass over the table: tasks turn their Arrow batches into one partial sum each (a sum and a count for each
centroid), and RDD.treeAggregate adds these up in a tree. Nothing is shuffled by key, and what reaches the driver is one sum for
each centroid, whatever the number of vectors.

Defined cases: vectors that are null, of another length, or with null, NaN or infinite components are left out; a null id is hashed
as the empty text; rows that repeat an id count each for itself, and of those with the same hash the smaller components are drawn
first as centroids; fewer vectors than centroids give fewer centroids; ties go to the smaller number; an empty centroid stays; a
distance or inertia beyond 64 bits is null; an empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.llm.common import map_arrow, table

WIDTH, SCALE, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Rows of one matrix product.
BLOCK = 4096
EXACT, LONG = 2**53, 2**63


def kept(vectors: DataFrame, id_col: str, vector_col: str, width: int = WIDTH) -> DataFrame:
    """id and v of the vectors that take part."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return vectors.filter((F.size(vector_col) == width) & finite).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))


def whole(v: np.ndarray) -> np.ndarray:
    """floor(SCALE * v) as doubles, which hold these whole numbers exactly unless they overflow to infinity."""
    with np.errstate(over="ignore"):
        return np.floor(v * SCALE)


def _ints(v: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The same in whole numbers of any length."""
    exact = [int(b) if math.isfinite(b) else int(a) * SCALE for a, b in zip(v.ravel().tolist(), y.ravel().tolist(), strict=True)]
    return np.array(exact, object).reshape(v.shape)


def _level(top: float, width: int) -> int:
    """0: doubles are exact, 1: 64-bit integers are, 2: neither, for components up to `top`. No partial sum exceeds 4 width top^2."""
    return 0 if 4 * width * top * top < EXACT else 1 if 4 * width * top * top < LONG else 2


def _expanded(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


def squared(v: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact squared distances of rows v (components before scaling) to centroids: 64-bit integers, or objects where these are too short."""
    y, width = whole(v), v.shape[1]
    c = np.array(centroids, object)
    row = np.array([_level(t, width) for t in np.abs(y).max(axis=1).tolist()]) if _level(float(np.abs(y).max(initial=0)), width) else np.zeros(len(v), int)
    col = np.array([_level(max(map(abs, k)), width) for k in centroids])
    out = np.zeros((len(v), len(c)), object if max(row.max(initial=0), col.max(initial=0)) == 2 else np.int64)
    for a in range(3):
        for b in range(3):
            rows, cols = np.flatnonzero(row == a), np.flatnonzero(col == b)
            if not len(rows) or not len(cols):
                continue
            kind = (np.float64, np.int64, object)[max(a, b)]
            x = _ints(v[rows], y[rows]) if kind is object else y[rows].astype(kind)
            found = _expanded(x, c[cols].astype(kind))
            out[np.ix_(rows, cols)] = found if kind is object else found.astype(np.int64)
    return out


def assigned(v: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each row; the smaller number wins ties."""
    near, dist = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k in range(0, len(v), BLOCK):
        d = squared(v[k : k + BLOCK], centroids)
        near.append(d.argmin(axis=1))
        dist.append(d[np.arange(len(d)), near[-1]])
    return np.concatenate(near), np.concatenate(dist)


def _sums(v: np.ndarray, near: np.ndarray, k: int) -> list[list[int]]:
    """Componentwise sums of the rows of each of k centroids, exact."""
    y = whole(v)
    if len(v) * float(np.abs(y).max(initial=0)) < EXACT:
        hot = np.zeros((k, len(v)))
        hot[near, np.arange(len(v))] = 1
        return (hot @ y).astype(np.int64).tolist()
    x = _ints(v, y)
    return [[int(t) for t in x[near == j].sum(axis=0)] if (near == j).any() else [0] * v.shape[1] for j in range(k)]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


Partial = tuple[list[int], list[list[int]], list[int]]  # rows, sums and inertia of each centroid


def _add(a: Partial, b: Partial) -> Partial:
    return ([x + y for x, y in zip(a[0], b[0], strict=True)], [[x + y for x, y in zip(p, q, strict=True)] for p, q in zip(a[1], b[1], strict=True)], [x + y for x, y in zip(a[2], b[2], strict=True)])


def totals(rows: DataFrame, centroids: list[list[int]]) -> Partial:
    """Rows, componentwise sums and summed distances of each centroid over the whole table."""
    k, width = len(centroids), len(centroids[0])
    zero: Partial = ([0] * k, [[0] * width for _ in range(k)], [0] * k)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = zero
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column(0), width)
                near, dist = assigned(v, centroids)
                count = np.bincount(near, minlength=k).tolist()
                total = _add(total, (count, _sums(v, near, k), [sum(dist[near == j].tolist()) for j in range(k)]))
        yield pa.RecordBatch.from_arrays([pa.array([repr(total)])], ["total"])

    def parsed(row) -> Partial:
        import ast

        return ast.literal_eval(row.total)

    parts = map_arrow(rows.select("v"), partial, "total string").rdd
    return parts.treeAggregate(zero, lambda acc, row: _add(acc, parsed(row)), _add) if parts.getNumPartitions() else zero


def seeds(rows: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> list[list[int]]:
    """The k vectors whose hash of seed and id is least."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    drawn = np.array([r.v for r in rows.withColumn("key", key).orderBy("key", "v").limit(k).collect()], np.float64)
    return _ints(drawn, whole(drawn)).tolist()


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector that takes part."""
    rows = kept(vectors, id_col, vector_col, width)
    fields = f"id {vectors.schema[id_col].dataType.simpleString()}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    centroids = seeds(rows, k, seed)
    if not centroids:
        return rows.sparkSession.createDataFrame([], fields).withColumnRenamed("id", id_col)
    for _ in range(rounds):
        count, total, _ = totals(rows, centroids)
        centroids = [[t // n for t in s] if n else c for n, s, c in zip(count, total, centroids, strict=True)]
    inertia = totals(rows, centroids)[2]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def long(x: int) -> int | None:
        return int(x) if -LONG <= x < LONG else None

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, dist = assigned(_matrix(b.column(1), width), centroids) if b.num_rows else (np.empty(0, np.int64), np.empty(0, np.int64))
            near = near.tolist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(near, pa.int32()), pa.array([long(d) for d in dist.tolist()], pa.int64()), pa.array([long(inertia[j]) for j in near], pa.int64()),
                 pa.array([long(sum(inertia))] * len(near), pa.int64()), pa.array([names[j] for j in near], pa.string())],
                ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
            )

    return map_arrow(rows, final, fields).withColumnRenamed("id", id_col)


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    apart = "list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    near = f"(SELECT k.id, k.v, min([{apart}::BIGINT, c.c]) AS m FROM k CROSS JOIN c{{0}} AS c GROUP BY ALL)"
    floor = "((s - ((s % n) + n) % n) // n)"
    text = f"""
WITH k AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: isfinite(x))) = {WIDTH}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || id)) - 1 AS c, v FROM k ORDER BY sha256('{SEED}:' || id) LIMIT {CENTROIDS})"""
    for r in range(ROUNDS):
        text += f""",
a{r} AS {near.format(r)},
s{r} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT m[2] AS c, unnest(range(1, {WIDTH + 1})) AS i, unnest(v) AS x FROM a{r}) GROUP BY c, i),
n{r} AS (SELECT c, list({floor}::BIGINT ORDER BY i) AS v FROM s{r} GROUP BY c),
c{r + 1} AS (SELECT c.c, coalesce(n.v, c.v) AS v FROM c{r} AS c LEFT JOIN n{r} AS n ON n.c = c.c)"""
    return text + f""",
f AS (SELECT id, m[1] AS distance, m[2] AS cluster FROM {near.format(ROUNDS)})
SELECT id AS vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM f JOIN c{ROUNDS} AS c ON c.c = f.cluster"""


ORACLE_SQL = {"op11_clustering": _sql()}
QUERIES = {"op11_clustering": op11_clustering}
