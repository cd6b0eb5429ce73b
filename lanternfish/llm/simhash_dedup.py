"""SimHash near-duplicates by a segment-popcount embedding and a grid range join.

A text's shingles are SHINGLE lower-cased words, repeats included; bit k of its fingerprint is 1 if it is set in over half of the
shingles' hashes (XXH64, seed 42). Fingerprints that differ in at most DISTANCE bits are linked; components follow.

1. Documents are grouped by fingerprint first, so copies cost one row.
2. A fingerprint is embedded as the bit counts of its 32 segments of 2 bits, which fit into 2 bits each. The Manhattan distance of
   two embeddings never exceeds the number of differing bits. The embedding has two halves of 16 segments, so two linked
   fingerprints have a half in which their embeddings lie within DISTANCE // 2 = 1.
3. The grid of a half has one cell for each vector of counts. A fingerprint stands in its own cell and calls at every cell one step
   up, so of two fingerprints within 1 one stands where the other stands or calls: a range join by equal cells.
4. In a cell, those that stand there are compared with all that stand or call: whole embeddings first, then all bits. Cells with
   more than BLOCK rows are cut into blocks, and pairs of blocks are the units of work, so no task holds a cell.
5. A unit returns a chain through each of its linked groups, never pairs, so the edges grow with its rows; components of the edges
   give each fingerprint, and by it each document, the least id that is reachable.

Defined cases: a null text has no words; texts without words have the fingerprint zero and are linked like others; a text of fewer
words than a shingle is one shingle; rows that repeat are copies; null ids are allowed, the least id that is not null names a
component (null if there is none); an empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.llm.common import map_arrow, stored, table
from lanternfish.llm.components import components, lookup

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Rows of a block of a cell, pairs compared at a time, and hashes whose bits are counted at a time.
BLOCK, PAIRS, HASHES = 2048, 1 << 20, 1 << 16
_EVEN = 0x5555555555555555


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a whole text."""
    words = (text or b"").lower().split()  # on bytes: A-Z only, and the blanks \x20 and \x09-\x0D only
    n = max(1, len(words) - shingle + 1) if words else 0
    ones = np.zeros(64, np.int64)
    for k in range(0, n, HASHES):
        h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(k, min(n, k + HASHES))), np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and fp, the fingerprint as a signed whole number, of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made.view(np.int64), pa.int64())], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return map_arrow(rows, work, f"id {docs.schema[id_col].dataType.simpleString()}, fp bigint")


def cells(prints: DataFrame) -> DataFrame:
    """half, cell, call and fp: where each fingerprint stands (call 0) and calls (call 1). A cell is the 16 bit counts of a half,
    2 bits each."""
    fp, bits, home, even = F.col("fp"), F.col("bits"), F.col("home"), F.lit(_EVEN & 0xFFFFFFFF)
    each = prints.select("fp", F.posexplode(F.array(fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32))).alias("half", "bits"))
    each = each.select("fp", "half", (bits.bitwiseAND(even) + F.shiftrightunsigned(bits, 1).bitwiseAND(even)).alias("home"))
    up = F.array(*(F.when(home.bitwiseAND(F.lit(3 << 2 * i)) < (2 << 2 * i), home + F.lit(1 << 2 * i)) for i in range(16)))
    stands = F.array(F.struct(home.alias("cell"), F.lit(0).alias("call")))
    calls = F.transform(F.array_compact(up), lambda c: F.struct(c.alias("cell"), F.lit(1).alias("call")))
    return each.select("fp", "half", F.inline(F.concat(stands, calls)))


def units(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """half, cell, bi, bj, call, block and fp: the rows of cells() in each pair of blocks of its cell that they belong to."""
    rows = cells(prints)
    full = rows.groupBy("half", "cell").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    full = stored(full.select("half", "cell", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "simhash-full")
    if full.isEmpty():
        return rows.select("half", "cell", F.lit(0).alias("bi"), F.lit(0).alias("bj"), "call", F.lit(0).alias("block"), "fp")
    marked = lookup(rows, ["half", "cell"], full, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    marked = marked.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return marked.select("half", "cell", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "call", "block", "fp")


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each row's least known companion) after the links i-j."""
    while len(i):
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            break
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return label


def _chains(unit: np.ndarray, cross: np.ndarray, call: np.ndarray, block: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join all linked rows of whole units. unit: number of each row's unit, rows that stand there first; cross: whether
    only pairs from two blocks count."""
    n = len(fp)
    end = np.searchsorted(unit, unit, "right")
    even = np.uint64(_EVEN)
    counts = (fp & even) + ((fp >> np.uint64(1)) & even)
    unary = counts | ((counts >> np.uint64(1)) & even)  # 0, 1, 2 as 00, 01, 11: differing bits are the Manhattan distance
    stands = np.flatnonzero(call == 0)
    partners = end[stands] - stands - 1
    upto = np.cumsum(partners)
    label, k = np.arange(n), 0
    while k < len(stands):
        last = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + PAIRS, "right")))
        count = partners[k:last]
        i = np.repeat(stands[k:last], count)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        near = np.bitwise_count(unary[i] ^ unary[j]) <= DISTANCE
        near &= ~cross[i] | (block[i] != block[j])
        i, j = i[near], j[near]
        same = np.bitwise_count(fp[i] ^ fp[j]) <= DISTANCE
        label = _joined(label, i[same], j[same])
        k = last
    order = np.lexsort((np.arange(n), label))
    chained = np.flatnonzero(label[order[1:]] == label[order[:-1]])
    return fp[order[chained]], fp[order[chained + 1]]


def links(dealt: DataFrame) -> DataFrame:
    """Edges a-b between fingerprints that join all linked fingerprints of every unit."""
    names = ["half", "cell", "bi", "bj", "call", "block", "fp"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(cols: list[np.ndarray], first: np.ndarray) -> pa.RecordBatch:
            _, _, bi, bj, call, block, fp = cols
            a, b = _chains(np.cumsum(first), bi != bj, call, block, fp.view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64), pa.int64()) for x in (a, b)], ["a", "b"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            cols = cols if held is None else [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
            first = np.r_[True, np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)]
            cut = int(np.flatnonzero(first)[-1])  # the last unit may go on in the next batch
            if cut:
                yield edges([c[:cut] for c in cols], first[:cut])
            held = [c[cut:] for c in cols]
        if held is not None:
            yield edges(held, np.r_[True, np.zeros(len(held[0]) - 1, bool)])

    unit = names[:4]
    return map_arrow(dealt.select(*names).repartition(*unit).sortWithinPartitions(*unit, "call", "fp"), work, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id for every row of docs."""
    made = stored(fingerprints(docs, id_col, text_col), "simhash-prints")
    prints = stored(made.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    roots = components(stored(links(units(prints.select("fp"), block)).distinct(), "simhash-links"))
    named = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = stored(named, "simhash-named")
    least = stored(named.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    of = stored(lookup(named.select("fp", "root"), ["root"], least).select("fp", "component_id"), "simhash-components")
    return lookup(made, ["fp"], of).select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: XXH64 is not in the oracle's SQL; the query is tested against brute force.
ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op13_simhash": op13_simhash}
