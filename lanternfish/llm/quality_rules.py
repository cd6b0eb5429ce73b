"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger holds the measurements and one bit per failed rule; policies are
versioned masks that are applied to the ledger later, and ablations come from counts per distinct mask.

Defined cases: a null text counts as an empty one (no words); empty texts fail `few_words`; repeated rows and equal ids are
judged row by row; every further column of the input is left out unless named in `keep`; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.llm.common import map_arrow, table

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"

#: Measurements of the ledger, all of them whole numbers.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters")

#: Rule k sets bit k of `failed`. Each is a predicate over the measurements.
RULES = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 30 * n_words)"),
    ("shouting", "n_letters > 0 AND 10 * n_upper > 5 * n_letters"),
)
BITS = {name: 1 << k for k, (name, _) in enumerate(RULES)}

#: A policy is the mask of the rules that reject. Versions are only added, never changed.
POLICIES = {
    "base": BITS["few_words"] | BITS["repeated_windows"],
    "v1": sum(BITS.values()),
}


def _repeated(words: list[bytes], width: int = 5) -> int:
    """How many words stand in windows of `width` words that the text has twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    key, span = ids[:n], len(seen)
    for k in range(1, width):
        if span > (1 << 62) // max(1, len(seen)):
            key = np.unique(key, return_inverse=True)[1]
            span = len(words)
        key = key * len(seen) + ids[k : k + n]
        span *= len(seen)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[width : width + n] -= twice
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of MEASURES."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()  # on bytes: the blanks \x20 and \x09-\x0D only
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = sum(map(text.count, "abcdefghijklmnopqrstuvwxyz"))
    return (
        len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)),
        len(lines), len(lines) - len(set(lines)), _repeated(words), upper, upper + lower,
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, the measurements, and `failed`, the mask of failed rules."""
    kind = docs.schema[id_col].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(t.as_py()) for t in b.column(1)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["id", *MEASURES])

    schema = f"id {kind.simpleString()}, " + ", ".join(f"{m} bigint" for m in MEASURES)
    out = map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), work, schema)
    failed = sum((F.when(F.expr(rule), F.lit(BITS[name])).otherwise(F.lit(0)) for name, rule in RULES), F.lit(0))
    return out.withColumn("failed", failed.cast("long")).withColumnRenamed("id", id_col)


def rejected(policy: str) -> Column:
    """Whether a row of the ledger fails a rule of the policy."""
    return F.col("failed").bitwiseAND(F.lit(POLICIES[policy])) != 0


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: rows that fail it, that fail it alone, and that would be kept without it.

    Rows are first counted per distinct mask, so that what follows has at most 2 ** len(RULES) rows.
    """
    mask = POLICIES[policy]
    by_mask = book.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in BITS.items() if b & mask))
    each = by_mask.select("n", "bits", F.explode(rules).alias("r")).select("n", "bits", "r.rule", "r.bit")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = ledger(table(spark, sf_dir, "documents"))
    base, all_rules = rejected("base"), rejected("v1")
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & ~all_rules).alias("kept"), "n_lines", "failed",
    )


def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablations(ledger(table(spark, sf_dir, "documents")), "v1")


_LEDGER_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, unnest(range(1, greatest(len(words) - 3, 1))) AS i, words FROM w WHERE len(words) >= 5),
k AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS win FROM g),
t AS (SELECT doc_id, i FROM k QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM t) GROUP BY doc_id),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
             length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
             length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::BIGINT AS n_letters FROM w LEFT JOIN r USING (doc_id)),
""" + "f AS (SELECT *, (" + " + ".join(f"CASE WHEN {rule} THEN {BITS[name]} ELSE 0 END" for name, rule in RULES) + ")::BIGINT AS failed FROM m)\n"

ORACLE_SQL = {
    "op10_quality_rules": _LEDGER_SQL + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed & {POLICIES["base"]} <> 0 AS base_failed, failed & {POLICIES["v1"]} = 0 AS kept, n_lines, failed FROM f""",
    "quality_rule_ablations": _LEDGER_SQL + ", x AS (" + " UNION ALL ".join(f"SELECT '{n}' AS rule, {b} AS bit" for n, b in BITS.items()) + """)
SELECT rule, count_if(failed & bit <> 0)::BIGINT AS n_failed, count_if(failed = bit)::BIGINT AS n_failed_alone,
       count_if(failed & ~bit = 0)::BIGINT AS n_kept_without FROM f CROSS JOIN x GROUP BY rule""",
}
QUERIES = {"op10_quality_rules": op10_quality_rules, "quality_rule_ablations": quality_rule_ablations}
