"""Quality classifier: random-indexing word vectors, pooled per document, then a two-layer network with a fitted temperature.

Tokens (words with their case, and runs of marks) are hashed to VOCABULARY slots. Each slot has a fixed sparse random vector of
+1 and -1; a slot's word vector is the mean of the random vectors of its neighbours up to WINDOW tokens away, over all documents.
Tasks add up a table of bounded size, so what is shuffled and sent to the driver does not depend on the number of distinct words.
A document is the mean and the spread of its tokens' vectors, its length and its share of distinct tokens. The network is
trained on at most MAX_TRAIN labelled rows, chosen by hash; a temperature is fitted on a fifth of them that training leaves out.

Defined cases: null and empty texts have the zero vector and get a score like any other text; labels that are null or have no
document teach nothing; without labels of both kinds the score is the share of good labels (0.5 if there are none); repeated
rows score alike; an empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.llm.common import fold_of, map_arrow, table

VOCABULARY, SIZE, NONZERO, WINDOW = 1 << 14, 64, 4, 2
#: Bound of the labelled sample: features of some 500 bytes each on the driver.
MAX_TRAIN = 16_000
HIDDEN, EPOCHS, BATCH, RATE = 32, 25, 128, 3e-3
THRESHOLD = 0.5
CACHE = 300_000
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
_rng = np.random.default_rng(5)
#: Positions and signs of each slot's random vector; the last row is a stop between documents, with no signs.
_PLACES = np.vstack([np.argsort(_rng.random((VOCABULARY, SIZE)), axis=1)[:, :NONZERO], np.zeros((1, NONZERO), int)]).astype(np.int32)
_SIGNS = np.vstack([_rng.choice([-1.0, 1.0], (VOCABULARY, NONZERO)), np.zeros((1, NONZERO))])
FEATURES = 2 * SIZE + 3


class Slots:
    """Tokens of a text as slots, with a bounded cache."""

    def __init__(self):
        self.cache: dict[str, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        tokens = _TOKEN.findall(text or "")
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache = self.cache
        got = [cache.get(t) for t in tokens]
        if None in got:
            for k, v in enumerate(got):
                if v is None:
                    got[k] = cache[tokens[k]] = xxhash.xxh32_intdigest(tokens[k]) % VOCABULARY
        return np.array(got, np.int32)


def _neighbours(ids: np.ndarray, into: np.ndarray) -> None:
    """Adds the random vectors of the tokens around each token. ids: slots, with WINDOW stops between documents."""
    for k in range(1, WINDOW + 1):
        for here, there in ((ids[k:], ids[:-k]), (ids[:-k], ids[k:])):
            real = (here < VOCABULARY) & (there < VOCABULARY)
            here, there = here[real], there[real]
            flat = here[:, None] * SIZE + _PLACES[there]
            into += np.bincount(flat.ravel(), _SIGNS[there].ravel(), VOCABULARY * SIZE)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """VOCABULARY x SIZE vectors from all documents."""
    names = [f"v{k}" for k in range(SIZE)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, table, counts = Slots(), np.zeros(VOCABULARY * SIZE), np.zeros(VOCABULARY + 1)
        stop, held, n = np.full(WINDOW, VOCABULARY, np.int32), [], 0

        def add() -> None:
            ids = np.concatenate(held)
            _neighbours(ids, table)
            counts.__iadd__(np.bincount(ids, minlength=VOCABULARY + 1))

        for b in batches:
            for t in b.column(0).to_pylist():
                held += [slots.of(t), stop]
                n += len(held[-2])
                if n > 1 << 18:
                    add()
                    held, n = [], 0
        if held:
            add()
        used = np.flatnonzero(counts[:VOCABULARY])
        table = table.reshape(VOCABULARY, SIZE)[used].astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used], pa.float64()), *(pa.array(table[:, k]) for k in range(SIZE))], ["slot", "n", *names])

    schema = "slot int, n double, " + ", ".join(f"{v} float" for v in names)
    parts = map_arrow(docs.select(text_col), work, schema)
    rows = parts.groupBy("slot").agg(F.sum("n"), *(F.sum(v) for v in names)).collect()  # at most VOCABULARY rows
    out, counts = np.zeros((VOCABULARY, SIZE)), np.zeros(VOCABULARY)
    for r in rows:
        counts[r[0]], out[r[0]] = r[1], r[2:]
    mean = out / np.maximum(counts, 1)[:, None]
    centre = out.sum(axis=0) / max(1.0, counts.sum())
    return np.where(counts[:, None] > 0, mean - centre, 0).round(5).astype(np.float32)


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The features of one document."""
    out = np.zeros(FEATURES, np.float32)
    if len(ids):
        slot, count = np.unique(ids, return_counts=True)
        share, v = (count / len(ids)).astype(np.float32), vectors[slot]
        mean = share @ v
        out[:SIZE] = mean
        out[SIZE : 2 * SIZE] = np.sqrt(np.maximum(share @ (v * v) - mean * mean, 0))
        out[2 * SIZE :] = np.log1p(len(ids)) / 10, len(slot) / len(ids), count.max() / len(ids)
    return out


@dataclass
class Model:
    vectors: np.ndarray
    prior: float
    shift: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: tuple | None = None
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(((x - self.shift) / self.scale).astype(np.float64) @ w1 + b1) @ w2 + b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def train(self, x: np.ndarray, y: np.ndarray) -> None:
        """Adam on the log loss; every fifth row is left out and fits the temperature."""
        rng = np.random.default_rng(11)
        out = np.arange(len(y)) % 5 == 0
        self.shift, self.scale = x[~out].mean(axis=0), x[~out].std(axis=0) + 1e-3
        z, t = ((x[~out] - self.shift) / self.scale).astype(np.float64), y[~out]
        w = [rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for _ in range(max(EPOCHS, min(200, 40_000 // max(1, len(t))))):
            order = rng.permutation(len(t))
            for k in range(0, len(t), BATCH):
                at = order[k : k + BATCH]
                h = np.tanh(z[at] @ w[0] + w[1])
                d = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - t[at]) / len(at)
                dh = d[:, None] * w[2] * (1 - h * h)
                step += 1
                for i, g in enumerate((z[at].T @ dh + 1e-4 * w[0], dh.sum(axis=0), h.T @ d + 1e-4 * w[2], d.sum(keepdims=True))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    w[i] = w[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.weights = tuple(w)
        logit, t = self.logits(x[out]), y[out]
        loss = lambda s: float(np.logaddexp(0, -(2 * t - 1) * logit / s).mean())
        self.temperature = min((float(s) for s in np.geomspace(0.25, 8, 61)), key=loss)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", keep=None, max_train: int = MAX_TRAIN) -> Model:
    """Word vectors over all of docs, the network over the labelled rows for which `keep` holds."""
    vectors = word_vectors(docs)
    rows = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (F.lit(True) if keep is None else keep)).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    total = rows.count()
    if total > max_train:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 20)) < int((1 << 20) * max_train / total))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for b in batches:
            x = [pooled(slots.of(t), vectors).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("y"), pa.array(x, pa.binary())], ["doc_id", "y", "x"])

    chosen = docs.select("doc_id", "text").join(F.broadcast(rows.limit(2 * max_train)), "doc_id")
    got = sorted(map_arrow(chosen, features, "doc_id bigint, y int, x binary").collect())
    y = np.array([r["y"] for r in got], float)
    model = Model(vectors, float(y.mean()) if len(y) else 0.5)
    if 0 < y.sum() < len(y) and len(y) >= 10:
        model.train(np.frombuffer(b"".join(bytes(r["x"]) for r in got), np.float32).reshape(len(got), FEATURES), y)
    return model


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # VOCABULARY x SIZE floats, 4 MB, and the network

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, model = Slots(), shared.value
        for b in batches:
            x = np.array([pooled(slots.of(t), model.vectors) for t in b.column(1).to_pylist()], np.float32).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.probability(x), pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(rows, work, f"id {docs.schema[id_col].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = scored(docs, fit(docs, labels, "quality", fold_of("doc_id", 3) != 1))
    return out.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op1_quality": op1_quality}
