"""URL filters: a distributed sort-merge range join between urls and nested host/path rules.

A rule is a host and a path prefix. Its canonical key is the reversed host, `/`, and the path; all urls below it have a key in
the interval [key, key + 0xFF). A url has one key for each suffix of its host whose number of labels occurs among the rules, so
a rule also covers subdomains. Rules and url keys are dealt to ranges of the key (a rule to each range that its interval
meets), sorted there, and swept once with a stack of the rules that are open; as prefix intervals nest, the top is the longest.

Range bounds hold the key and a salt of the row, so that even one url that makes up a third of all rows is spread over tasks.
The bounds come from a sample; they only balance the tasks and never change a result.

Defined cases: a null url, or one without `://`, has an empty host and path and fits no rule; an empty host in a rule fits
nothing; of rules with the same host and path, `block` wins; repeated rows are judged row by row; an empty table gives no rows,
an empty rule set gives every url the default verdict; further columns of the input are left out unless named in `keep`.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.llm.common import map_arrow, table

RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

AZ, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Points of the sample behind each range bound.
POINTS = 30


def split_url(urls: DataFrame, url_col: str) -> DataFrame:
    """Adds `host` and `path` as the contract defines them."""
    u = F.col(url_col)
    rest = F.when(F.instr(u, "://") > 0, u.substr(F.instr(u, "://") + 3, F.length(u))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return urls.withColumns({"host": F.translate(raw, AZ, LOWER), "path": path})


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(verdict, `host/path`) pairs as the rule columns that judge() takes."""
    rows = [(r.partition("/")[0].translate(str.maketrans(AZ, LOWER)), "/" + r.partition("/")[2], v) for v, r in rules]
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def _reverse(host: str) -> str:
    return ".".join(reversed(host.split(".")))


_ROW = "pid int, key binary, kind int, salt int, rid bigint, upper binary, rule string, block boolean, width int, id {id}, host string, path string"


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", parts: int | None = None) -> DataFrame:
    """id, host, path, rule (`host/path` of the longest that fits, else null) and verdict for every row of urls."""
    spark = urls.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rules = rules.filter((F.col("host") != "") & F.col("path").isNotNull())
    # Host depths are at most the labels that a host name can have.
    depths = sorted(r[0] for r in rules.select(F.size(F.split("host", r"\.")).alias("n")).distinct().collect())
    base = split_url(urls.select(F.col(id_col).alias("id"), F.col(url_col).alias("u")), "u").select(
        F.monotonically_increasing_id().alias("rid"), "id", "host", "path"
    )
    row = _ROW.format(id=base.schema["id"].dataType.simpleString())
    names = [x.split()[0] for x in row.split(", ")]

    def keys(host: str, path: str) -> list[bytes]:
        labels = host.split(".")
        found = [f"{'.'.join(reversed(labels[-d:]))}/{path}".encode() for d in depths if host and d <= len(labels)]
        return found or [b""]

    def salted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, (rid * 2654435761 >> 7) & 0xFFFF) for rid, h, p in zip(*(b.column(n).to_pylist() for n in ("rid", "host", "path")), strict=True) for k in keys(h, p)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32())], ["key", "salt"])

    total = urls.count()
    share = min(1.0, POINTS * parts / max(1, total))
    some = map_arrow(base.sample(share, seed=7), salted, "key binary, salt int")
    points = sorted((bytes(k), s) for k, s in some.collect())
    bounds = sorted({points[i * len(points) // parts] for i in range(1, parts)}) if points else []

    def route_urls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for rid, i, h, p in zip(*(b.column(n).to_pylist() for n in ("rid", "id", "host", "path")), strict=True):
                for k in keys(h, p):
                    s = (rid * 2654435761 >> 7) & 0xFFFF
                    out.append((bisect_right(bounds, (k, s)), k, 1, s, rid, None, None, None, None, i, h, p))
            yield batch(out, b.schema.field("id").type)

    def route_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, p, v in zip(*(b.column(n).to_pylist() for n in ("host", "path", "verdict")), strict=True):
                k = f"{_reverse(h)}/{p}".encode()
                for pid in range(bisect_right(bounds, (k, -1)), bisect_right(bounds, (k + b"\xff", -1)) + 1):
                    out.append((pid, k, 0, int(v == "block"), None, k + b"\xff", h + p, v == "block", len(h), None, None, None))
            yield batch(out, b.schema.field("id").type)

    kinds = {"pid": pa.int32(), "key": pa.binary(), "kind": pa.int32(), "salt": pa.int32(), "rid": pa.int64(), "upper": pa.binary(), "rule": pa.string(), "block": pa.bool_(), "width": pa.int32(), "host": pa.string(), "path": pa.string()}

    def batch(rows: list[tuple], of_id: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, of_id)) for n, c in zip(names, cols, strict=True)], names)

    bare = rules.select("host", "path", "verdict", F.lit(None).cast(base.schema["id"].dataType).alias("id"))
    rule_rows = map_arrow(bare, route_rules, row)
    dealt = map_arrow(base, route_urls, row).unionByName(rule_rows)
    dealt = dealt.repartition(parts, "pid").sortWithinPartitions("pid", "key", "kind", "salt")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple] = []
        at = None
        for b in batches:
            out = {n: [] for n in ("rid", "id", "host", "path", "rule", "block", "width")}
            for pid, key, kind, rid, upper, rule, block, width, i, h, p in zip(*(b.column(n).to_pylist() for n in names if n != "salt"), strict=True):
                if pid != at:
                    at, stack = pid, []
                while stack and stack[-1][0] <= key:
                    stack.pop()
                if kind == 0:
                    stack.append((upper, rule, block, width))
                    continue
                best = stack[-1][1:] if stack else (None, None, None)
                for n, v in zip(out, (rid, i, h, p, *best), strict=True):
                    out[n].append(v)
            of = {**kinds, "id": b.schema.field("id").type}
            yield pa.RecordBatch.from_arrays([pa.array(v, of[n]) for n, v in out.items()], list(out))

    swept = map_arrow(dealt, sweep, f"rid bigint, {row.split(', ')[-3]}, host string, path string, rule string, block boolean, width int")
    best = F.max(F.struct(F.length("rule").alias("n"), "width", "block", "rule"))
    out = swept.groupBy("rid").agg(F.first("id").alias(id_col), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("best"))
    verdict = F.when(F.col("best.rule").isNull(), F.lit(default)).when(F.col("best.block"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(id_col, "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


def _sql() -> str:
    fits = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rules = sorted(((v, r) for v, r in RULES), key=lambda x: -len(x[1]))
    case = lambda what, rest: "CASE " + " ".join(f"WHEN {fits.format(h=r.partition('/')[0], p='/' + r.partition('/')[2])} THEN '{what(v, r)}'" for v, r in rules) + f" ELSE {rest} END"
    return rf"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{AZ}', '{LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a)
SELECT page_id, host, path, {case(lambda v, r: r, 'NULL')} AS rule, {case(lambda v, r: v, "'allow'")} AS verdict FROM b"""


ORACLE_SQL = {"op3_url_filters": _sql()}
QUERIES = {"op3_url_filters": op3_url_filters}
