"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, with distance-weighted votes.

Examples are labelled rows, at most about MAX_EXAMPLES with some MAX_WORDS words, chosen by hash. Every word of the indexed
examples is a term. A vector holds 1 + log(tf), times log(N / df) over all N documents, times the relevance frequency
log2(2 + a / max(1, b)) of a term that a toxic and b other indexed examples hold (the tf.idf.rf scheme of Lan et al., 2009: at
least 1, more for words that lean to the label), and is normalised over the terms.

The index holds, for each term and each block of BLOCK examples, the largest weight and a run of postings. A query first adds up
the postings of its few frequent terms (held by one example in OFTEN), whose maxima say little. The sum of a block's best example
so far and of the block maxima of the other terms is an upper bound of the block; blocks are visited from the highest bound down
until the next one is under the K-th best cosine, so the K nearest are exact. All examples with the K-th cosine vote, in weight of cosine ** SHARPNESS; the share of toxic votes is mapped
to a probability by a monotone table fitted on examples that are left out of the index.

Defined cases: null and empty texts, and texts without a word of any example, have no neighbours and get the share of toxic
examples; repeated rows score alike; labels that are null or have no document are not examples; with no examples, or of one label
only, every score is the share of toxic examples (0 if there are none); further columns pass through keep_clean() unchanged.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.llm.common import fold_of, map_arrow, stored, table

#: Bounds of the labelled sample, in rows and in words (with repeats): they bound the index in the driver and in each worker.
MAX_EXAMPLES, MAX_WORDS = 8_000, 4_000_000
#: Of the examples, one in so many is left out of the index to calibrate the votes.
CALIBRATE = 4
K, BLOCK, SHARPNESS = 15, 64, 4.0
#: A term is frequent if one example in so many holds it. Texts whose sums over frequent terms are made together.
OFTEN, TOGETHER = 16, 64
#: Blocks that a query visits first, and by how much each later visit is wider.
VISIT, WIDEN = 8, 3
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> Counter[str]:
    return Counter(_WORD.findall((text or "").lower()))


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of all runs, one after the other."""
    return np.arange(int(length.sum())) + np.repeat(start - np.cumsum(length) + length, length)


class Index:
    """Labelled vectors in blocks of like ones. `terms` and `weights` are the vectors one after the other, `size` their lengths."""

    def __init__(self, vocabulary: dict[str, int], factor: np.ndarray, size: np.ndarray, terms: np.ndarray, weights: np.ndarray, labels: np.ndarray, ids: np.ndarray, prior: float):
        self.vocabulary, self.factor, self.prior = vocabulary, factor, prior
        self.grid, self.table = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        n = len(size)
        owner = np.repeat(np.arange(n), size)
        order = self._order(n, owner, terms, weights)
        self.labels, self.ids = labels[order], ids[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        owner = rank[owner]
        by_term = np.lexsort((owner, terms))
        terms, owner = terms[by_term], owner[by_term]
        self.owner, self.weight = owner, weights[by_term]
        # An entry is the run of postings of one term in one block.
        block = owner // BLOCK
        self.n_blocks = -(-n // BLOCK)
        starts = np.flatnonzero(np.r_[True, (terms[1:] != terms[:-1]) | (block[1:] != block[:-1])]) if len(terms) else np.empty(0, np.int64)
        self.run_at = np.r_[starts, len(terms)].astype(np.int64)
        self.run_block = block[starts]
        self.run_most = np.maximum.reduceat(self.weight, starts) if len(starts) else np.empty(0)
        self.entry_at = np.searchsorted(terms[starts], np.arange(len(factor) + 1))
        self.often = np.bincount(terms, minlength=len(factor)) * OFTEN >= max(n, 1)
        self.rows: np.ndarray | None = None

    @staticmethod
    def _order(n: int, owner: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Like vectors side by side make the block maxima tight: sorted by the heaviest terms that one vector in 200 has."""
        if not n:
            return np.empty(0, np.int64)
        common = np.bincount(terms)[terms] * 200 >= n
        owner, terms, weights = owner[common], terms[common], weights[common]
        by = np.lexsort((terms, -weights, owner))
        owner, terms = owner[by], terms[by]
        first = np.searchsorted(owner, np.arange(n))
        keys = []
        for k in range(3):
            at = np.minimum(first + k, max(len(owner) - 1, 0))
            has = (first + k < len(owner)) & (owner[at] == np.arange(n)) if len(owner) else np.zeros(n, bool)
            keys.append(np.where(has, terms[at] if len(terms) else -1, -1))
        return np.lexsort(keys[::-1])

    def vector(self, words: Counter[str]) -> tuple[np.ndarray, np.ndarray]:
        """Terms, ascending, and weights of a text; words of no example count for nothing."""
        get = self.vocabulary.get
        at = np.array([-1 if (t := get(w)) is None else t for w in words], np.int64)
        tf = np.array(list(words.values()), float)
        order = np.argsort(at)
        order = order[np.searchsorted(at[order], 0) :]
        at = at[order]
        return at, weigh(tf[order], self.factor[at])

    def partial(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Sums over the frequent terms, for at most TOGETHER vectors at once and all examples. Their postings are laid out as
        plain rows where they are used: at most OFTEN * MAX_WORDS numbers."""
        if self.rows is None:
            terms = np.flatnonzero(self.often)
            self.column = np.full(len(self.often), -1)
            self.column[terms] = np.arange(len(terms))
            self.rows = np.zeros((len(terms), len(self.labels)))
            for k, t in enumerate(terms.tolist()):
                at = slice(self.run_at[self.entry_at[t]], self.run_at[self.entry_at[t + 1]])
                self.rows[k, self.owner[at]] = self.weight[at]
        dense = np.zeros((TOGETHER, len(self.rows)))  # of one shape, so a vector's sums do not depend on its company
        for k, (terms, weights) in enumerate(vectors):
            often = self.often[terms]
            dense[k, self.column[terms[often]]] = weights[often]
        return dense @ self.rows

    def _kth(self, cosine: np.ndarray) -> float:
        return float(np.partition(cosine, -K)[-K]) if len(cosine) >= K else 0.0

    def nearest(self, terms: np.ndarray, weights: np.ndarray, partial: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The examples of the K highest cosines (ties of the last included) among those above 0, and their cosines."""
        if not len(self.labels):
            return np.empty(0, np.int64), np.empty(0)
        cosine = self.partial([(terms, weights)])[0] if partial is None else partial.copy()
        run = self.entry_at[terms]
        length = self.entry_at[terms + 1] - run
        often = self.often[terms]
        entry, q = _spread(run[~often], length[~often]), np.repeat(weights[~often], length[~often])
        block = self.run_block[entry]
        bound = np.maximum.reduceat(cosine, np.arange(self.n_blocks) * BLOCK) + np.bincount(block, q * self.run_most[entry], self.n_blocks)
        order = np.argsort(-bound, kind="stable")
        # Sums of a part of the terms are lower bounds, so the K-th of them may already rule blocks out.
        worst, done, step = self._kth(cosine), 0, VISIT
        while done < self.n_blocks and bound[order[done]] > max(worst, 1e-11) - 1e-12:
            now = order[done : done + step]
            here = np.zeros(self.n_blocks, bool)
            here[now[bound[now] > worst - 1e-12]] = True
            take = here[block]
            start = self.run_at[entry[take]]
            n = self.run_at[entry[take] + 1] - start
            at = _spread(start, n)
            cosine += np.bincount(self.owner[at], np.repeat(q[take], n) * self.weight[at], len(cosine))
            worst = self._kth(cosine)
            done, step = done + step, step * WIDEN
        at = np.flatnonzero((cosine > 1e-11) & (cosine >= worst - 1e-12))
        return at, cosine[at]

    def shares(self, texts: list[str | None]) -> Iterator[tuple[float | None, list[int], np.ndarray]]:
        """Share of toxic votes (None without neighbours), ids of the nearest examples and heaviest terms, at most 5 each, of each text."""
        for k in range(0, len(texts), TOGETHER):
            vectors = [self.vector(words_of(t)) for t in texts[k : k + TOGETHER]]
            partial = self.partial(vectors)
            for (terms, weights), sums in zip(vectors, partial, strict=False):
                at, cosine = self.nearest(terms, weights, sums)
                heavy = terms[np.argsort(-np.round(weights, 9), kind="stable")[:5]]
                if not len(at):
                    yield None, [], heavy
                    continue
                weight = cosine**SHARPNESS
                top = at[np.lexsort((self.ids[at], -np.round(cosine, 9)))[:5]]
                yield round(float((weight * self.labels[at]).sum() / weight.sum()), 9), self.ids[top].tolist(), heavy

    def scores(self, texts: list[str | None]) -> Iterator[tuple[float, list[int], np.ndarray]]:
        """The same with the calibrated score in place of the share."""
        for share, near, heavy in self.shares(texts):
            yield self.prior if share is None else min(1.0, max(0.0, float(np.interp(share, self.grid, self.table)))), near, heavy


def weigh(tf: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Normalised weights of terms that occur tf times."""
    raw = (1 + np.log(tf)) * factor
    return raw / max(float(np.sqrt((raw * raw).sum())), 1e-300)


def _monotone(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of y on x by pooling adjacent violators; a prior of one row of each label holds each pool from 0 and 1."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for v in np.unique(x[order]):
        here = y[x == v]
        pools.append([float(here.sum()), float(len(here)), float(v), float(v)])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, n, _, hi = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][3] = hi
    # A pool stands at its middle, so scores between two pools are interpolated.
    grid = np.array([(lo + hi) / 2 for _, _, lo, hi in pools])
    return grid, np.maximum.accumulate(np.array([(s + y.mean()) / (n + 1) for s, n, _, _ in pools]))


def examples(docs: DataFrame, labels: DataFrame, label: str, keep, bound: int, words: int = MAX_WORDS) -> DataFrame:
    """doc_id, y, text and held (left out of the index) of labelled rows for which `keep` holds. At most about `bound` rows, with
    about `words` words; which ones, a hash of the id tells."""
    rows = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & keep).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    slot = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20))
    total = rows.count()
    if total > bound:
        rows = rows.filter(slot < int((1 << 20) * bound / total))
    chosen = docs.select("doc_id", "text").join(F.broadcast(rows.limit(2 * bound)), "doc_id")
    chosen = stored(chosen.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(CALIBRATE)) == 0), "toxic-examples")
    # A word has two characters at least, with the blank after it.
    size = chosen.agg(F.sum(F.length("text"))).first()[0] or 0
    return chosen if size <= 2 * words else chosen.filter(F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(1 << 20)) < int((1 << 20) * 2 * words / size))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", keep=None, max_examples: int = MAX_EXAMPLES) -> Index:
    """The index over the labelled examples; document frequencies of its terms are counted over all of docs."""
    chosen = examples(docs, labels, label, F.lit(True) if keep is None else keep, max_examples)
    n = {(r["y"], r["held"]): r["count"] for r in chosen.groupBy("y", "held").count().collect()}
    toxic, rows = sum(k for (y, _), k in n.items() if y), sum(n.values())
    none = np.empty(0)
    empty = Index({}, none, none.astype(int), none.astype(int), none, none, none.astype(int), toxic / rows if rows else 0.0)
    if not n.get((0, False)) or not n.get((1, False)):
        return empty

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for y, t in zip(b.column("y").to_pylist(), b.column("text").to_pylist(), strict=True):
                of[y].update(words_of(t).keys())
        terms = list(of[0] | of[1])
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in of)], ["term", "clean", "toxic"])

    counted = map_arrow(chosen.filter("NOT held").select("y", "text"), tally, "term string, clean bigint, toxic bigint")
    # At most MAX_WORDS terms.
    found = counted.groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b")).toArrow().sort_by("term")
    vocabulary = {t: i for i, t in enumerate(found["term"].to_pylist())}
    a, b = found["a"].to_numpy(), found["b"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        df, seen = np.zeros(len(shared.value), np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                seen += 1
                df[[i for w in set(_WORD.findall((t or "").lower())) if (i := get(w)) is not None]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at], pa.int32()), pa.array(np.r_[seen, df[at]], pa.int64())], ["term", "n"])

    # A row for each term, at most.
    counted = map_arrow(docs.select("text"), frequencies, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    terms, times = counted["term"].to_numpy(), counted["n"].to_numpy()
    df = np.zeros(len(vocabulary))
    df[terms[terms >= 0]] = times[terms >= 0]
    factor = np.log((1 + times[terms < 0].sum()) / (1 + df)) * np.log2(2 + a / np.maximum(1, b))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for b in batches:
            found = [sorted((i, n) for w, n in words_of(t).items() if (i := get(w)) is not None) for t in b.column("text").to_pylist()]
            at, tf = ([[x[k] for x in f] for f in found] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("y"), b.column("held"), pa.array(at, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))], ["doc_id", "y", "held", "at", "tf"])

    # MAX_EXAMPLES rows with MAX_WORDS words; arrays of numbers.
    made = map_arrow(chosen.select("doc_id", "y", "held", "text"), vectors, "doc_id bigint, y int, held boolean, at array<int>, tf array<int>").toArrow()
    made = made.sort_by([("doc_id", "ascending"), ("y", "ascending")]).combine_chunks()
    ids, y, held = made["doc_id"].to_numpy(), made["y"].to_numpy().astype(float), made["held"].to_numpy(zero_copy_only=False)
    at, tf = made["at"].combine_chunks(), made["tf"].combine_chunks()
    size, at, tf = at.value_lengths().to_numpy(), at.flatten().to_numpy(), tf.flatten().to_numpy()
    del made
    raw = (1 + np.log(tf)) * factor[at]
    owner = np.repeat(np.arange(len(size)), size)
    weights = raw / np.sqrt(np.maximum(np.bincount(owner, raw * raw, len(size)), 1e-300))[owner]
    inside = ~held[owner]
    index = Index(vocabulary, factor, size[~held], at[inside], weights[inside], y[~held], ids[~held], toxic / rows)
    if len(set(y[held])) == 2:
        calibrated = _shares(chosen.filter("held").select("y", "text"), index).toArrow()  # at most MAX_EXAMPLES rows
        index.grid, index.table = _monotone(calibrated["share"].to_numpy(), calibrated["y"].to_numpy().astype(float))
    return index


def _shares(rows: DataFrame, index: Index) -> DataFrame:
    """y and share of toxic votes of rows that have neighbours."""
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            share = pa.array([s for s, _, _ in shared.value.shares(b.column(1).to_pylist())], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), share], ["y", "share"]).filter(share.is_valid())

    return map_arrow(rows, work, "y int, share double")


def scored(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, near (ids of the nearest examples) and evidence (the words that weigh most) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by MAX_EXAMPLES and MAX_WORDS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        names = list(index.vocabulary)
        for b in batches:
            scores, near, why = [], [], []
            for s, ids, heavy in index.scores(b.column(1).to_pylist()):
                scores.append(s)
                near.append(ids)
                why.append([names[k] for k in heavy])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(near, pa.list_(pa.int64())), pa.array(why, pa.list_(pa.string()))], ["id", "score", "near", "evidence"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = map_arrow(rows, work, f"id {docs.schema[id_col].dataType.simpleString()}, score double, near array<bigint>, evidence array<string>")
    return out.withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, index: Index, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs whose score is under the threshold, decided in place: nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            ok = [s < threshold for s, _, _ in index.scores(b.column(text_col).to_pylist())]
            yield b.filter(pa.array(ok, pa.bool_()))

    return map_arrow(docs, work, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    index = fit(docs, labels, "toxic", fold_of("doc_id", 4) != 2)
    out = scored(docs, index)
    return out.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "near", "evidence")


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op5_toxicity": op5_toxicity}
