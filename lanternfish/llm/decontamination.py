"""Benchmark decontamination by a prefix-filtered join (DataFrame operations only).

Benchmark items are cut into windows of WIDTH consecutive words. All words of the benchmark are counted over the corpus; the
rarest word of a window is its prefix token, as a document that holds the window must hold that token. Document words are joined
with the prefix tokens; the token's place in the window bounds where the window can start and end in the document (positional and
length bounds), and a comparison of the words in between verifies it exactly.

With at most BROADCAST_WINDOWS windows of BROADCAST_BYTES the token join is a broadcast join that is fused with the explosion of the
words, so no text is shuffled. Beyond it, corpus words are counted before they meet the benchmark's, thin (row, place, token) rows
are joined by shuffle, tokens with a large share of them under SALTS keys, and verified against the words of their rows.

Defined cases: a null or wordless text has no words, no hits and no items, and is not contaminated; items without words have no
window; an item shorter than WIDTH words is one window; equal windows of several items name them all; repeated rows are judged
row by row; empty tables work; further columns are left out of measured() and pass through clean() unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.llm.common import fresh, stored, table

WIDTH = 13
#: Distinct windows, and bytes of their words, up to which they are broadcast.
BROADCAST_WINDOWS, BROADCAST_BYTES = 200_000, 48 << 20
#: A token that makes up one in HOT of the corpus' words (so there are at most HOT of them) is joined under so many keys.
HOT, SALTS = 1_000, 64

AZ, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> Column:
    """Words of the text after A-Z are lower-cased: runs of a-z, 0-9 and all characters beyond ASCII."""
    t = F.coalesce(F.col(text), F.lit(""))
    # For plain ASCII, lower() does the same as the slower translate().
    low = F.when(t.rlike(r"[^\x00-\x7F]"), F.translate(t, AZ, LOWER)).otherwise(F.lower(t))
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """item, win (array of words) for every distinct window of every item."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(text_col).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    return items.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s"), width).alias("win")).distinct()


def _prefixed(corpus_words: DataFrame, wins: DataFrame, small: bool) -> DataFrame:
    """win -> its rarest word over the corpus and that word's place. corpus_words: w (array)."""
    vocabulary, each = wins.select(F.explode("win").alias("token")).distinct(), corpus_words.select(F.explode("w").alias("token"))
    if small:
        counts = each.join(F.broadcast(vocabulary), "token").groupBy("token").count()
    else:  # summed up within each task first, so a frequent word is one row of it
        counts = each.groupBy("token").count().join(vocabulary, "token", "left_semi")
    counts = stored(counts, "decon-rarity")  # at most one row for each word of the benchmark
    places = wins.select("win", F.posexplode("win").alias("place", "token"))
    rare = places.join(counts, "token", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token", "place")).alias("x"))
    # A window with a word that the corpus lacks cannot occur.
    return rare.filter("x.n > 0").select("win", "x.n", "x.token", "x.place", F.size("win").alias("len"), F.xxhash64("win").alias("wid"))


def _same() -> Column:
    start = F.col("pos") - F.col("place")
    fits = (start >= 0) & (start + F.col("len") <= F.col("n_words"))
    return F.when(fits, F.slice("w", F.when(fits, start + 1).otherwise(F.lit(1)), F.when(fits, F.col("len")).otherwise(F.lit(0))) == F.col("win")).otherwise(F.lit(False))


def hits(docs: DataFrame, wins: DataFrame, id_col: str, text_col: str, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """rid, id, n_words, key (hash of the text) and, where a window occurs, start, len and wid; each row of docs has one row without."""
    words = docs.select(F.col(id_col).alias("id"), words_of(text_col).alias("w"), F.xxhash64(text_col).alias("key"))
    distinct = stored(wins.select("win").distinct(), "decon-windows")
    n, size = distinct.agg(F.count("*"), F.sum(F.length(F.concat_ws(" ", "win")))).first()
    small = n <= broadcast_windows and 4 * (size or 0) <= BROADCAST_BYTES  # a character has four bytes at most
    marked = stored(_prefixed(words.select("w"), distinct, small), "decon-prefixes")
    rows = words.select(F.monotonically_increasing_id().alias("rid"), "id", "key", F.size("w").alias("n_words"), "w")
    start = F.col("pos") - F.col("place")
    if small:
        # Each row also has the token '' behind its words, which stands for the row itself.
        itself = docs.sparkSession.range(1).select(F.array(F.lit("")).alias("win"), F.lit("").alias("token"), F.lit(0).alias("place"), F.lit(-1).alias("len"), F.lit(0).cast("long").alias("wid"))
        spread = rows.select("*", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "token"))
        marked = marked.drop("n").unionByName(itself)
        met = spread.join(F.broadcast(marked), (spread["token"] == marked["token"]) & ((F.col("len") < 0) | _same()))
        real = F.col("len") > 0
        return met.select("rid", "id", "n_words", "key", F.when(real, start).alias("start"), F.when(real, F.col("len")).alias("len"), F.when(real, F.col("wid")).alias("wid"))
    rows = stored(rows, "decon-rows")
    total = rows.agg(F.sum("n_words")).first()[0] or 0
    hot = marked.filter(F.col("n") * HOT >= total).select("token").distinct().withColumn("salts", F.lit(SALTS))  # at most HOT rows
    salts = F.coalesce("salts", F.lit(1))
    thin = rows.select("rid", F.posexplode("w").alias("pos", "token")).join(F.broadcast(hot), "token", "left").withColumn("salt", F.pmod(F.xxhash64("rid", "pos"), salts).cast("int")).drop("salts")
    marked = marked.join(F.broadcast(hot), "token", "left").select("token", "place", "len", "wid", "win", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    near = thin.join(marked, ["token", "salt"])
    met = near.join(rows, "rid").filter(_same()).select("rid", "id", "n_words", "key", start.alias("start"), "len", "wid")
    return rows.select("rid", "id", "n_words", "key", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("len"), F.lit(None).cast("long").alias("wid")).unionByName(met)


def measured(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per row of docs: id, key (hash of the text), n_words, n_hit, items (sorted) and contaminated."""
    wins = stored(windows(benchmark, item_col, item_text, width), "decon-items")
    found = hits(docs, wins, id_col, text_col, broadcast_windows)
    # All rows of a document come from one task, so these lists are made before the exchange; they are as long as its hits.
    spans = F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "len")))
    per_doc = found.groupBy("rid").agg(F.max("id").alias("id"), F.max("n_words").alias("n_words"), F.max("key").alias("key"), spans.alias("spans"), F.collect_set("wid").alias("wids"))
    end = lambda s: s["start"] + s["len"]
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), end(s) - F.greatest(a["upto"], s["start"]))).alias("n"), F.greatest(a["upto"], end(s)).alias("upto")),
        lambda a: a["n"].cast("long"),
    )
    per_doc = stored(per_doc.select("rid", "id", "key", F.col("n_words").cast("long"), covered.alias("n_hit"), "wids"), "decon-hits")
    named = per_doc.filter(F.size("wids") > 0).select("rid", F.explode("wids").alias("wid"))
    of_item = wins.select("item", F.xxhash64("win").alias("wid")).distinct()
    items = named.join(of_item, "wid").groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    joined = per_doc.drop("wids").join(items, "rid", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    bad = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return joined.select(F.col("id").alias(id_col), "key", "n_words", "n_hit", "items", bad.alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows of docs that are not contaminated."""
    judged = measured(docs, benchmark, id_col, text_col, item_col, item_text)
    bad_id, bad_key = fresh(docs, "bad_id", "bad_key")
    bad = judged.filter("contaminated").select(F.col(id_col).alias(bad_id), F.col("key").alias(bad_key)).distinct()
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(bad_id)) & (F.xxhash64(text_col) == F.col(bad_key)), "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = measured(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return judged.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


ORACLE_SQL = {
    "op4_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{AZ}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{AZ}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(w[s:s + {WIDTH - 1}], ' ') AS win, least(len(w), {WIDTH}) AS n
       FROM (SELECT *, unnest(range(1, greatest(len(w) - {WIDTH - 2}, 2))) AS s FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d JOIN ns ON len(w) >= n)),
h AS (SELECT DISTINCT doc_id, s, dw.n, item_id FROM dw JOIN bw USING (win, n)),
p AS (SELECT doc_id, count(DISTINCT i)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id)""",
}
QUERIES = {"op4_decontamination": op4_decontamination}
