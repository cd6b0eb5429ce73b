"""Mail and name checks over ingested DNS answers, and public suffixes. A name of which the resolver failed gives no finding.

answers: name, type, status (0 ok, 3 no such name, else failure), ad (boolean), data array<string>.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.functions import urls
from lanternfish.plans.tables import stored

MOST_LOOKUPS, MOST_DEPTH = 10, 10


def registrable(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, public_suffix, domain: longest rule, exceptions first; without a rule the last label. hosts: host.

    rules: rule, kind (plain, wildcard without its `*.`, exception without its `!`). Each host is exploded into its suffixes, so
    the lookup is an equi-join.
    """
    h = hosts.select(F.lower("host").alias("host")).distinct()
    each = h.select("host", F.explode(urls.suffixes(F.col("host"))).alias("suffix")).withColumn("n", F.size(F.split("suffix", r"\.")))
    # A wildcard rule covers names of one more label than it has.
    parent = F.regexp_extract("suffix", r"^[^.]*\.(.*)$", 1)
    keys = F.array(F.struct(F.col("suffix").alias("rule"), F.lit("plain").alias("kind")), F.struct(parent.alias("rule"), F.lit("wildcard").alias("kind")), F.struct(F.col("suffix").alias("rule"), F.lit("exception").alias("kind")))
    met = each.select("host", "n", F.explode(keys).alias("k")).select("host", "n", "k.rule", "k.kind").join(rules, ["rule", "kind"])
    best = met.groupBy("host").agg(F.max(F.struct((F.col("kind") == "exception").cast("int").alias("e"), "n")).alias("b"))
    size = F.when(F.col("b.e") == 1, F.col("b.n") - 1).otherwise(F.coalesce("b.n", F.lit(1)))
    out = h.join(best, "host", "left").withColumn("size", size)
    labels = F.split("host", r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    return out.select("host", last(F.col("size")).alias("public_suffix"), F.when(F.size(labels) > F.col("size"), last(F.col("size") + 1)).alias("domain"))


def _txt(answers: DataFrame, pattern: str) -> DataFrame:
    """name, record of the TXT answers that match."""
    each = answers.filter("type = 'TXT' AND status = 0").select("name", F.explode("data").alias("record"))
    return each.withColumn("record", F.regexp_replace(F.trim("record"), r'^"|"$|"\s+"', "")).filter(F.lower("record").rlike(pattern))


def spf(names: DataFrame, answers: DataFrame) -> DataFrame:
    """name, records, all (qualifier of the effective `all`), lookups: includes and redirects are followed by a bounded loop of joins."""
    records = stored(_txt(answers, r"^v=spf1(\s|$)").groupBy("name").agg(F.count("*").alias("records"), F.min("record").alias("record")), "spf-records")
    terms = records.select("name", F.posexplode(F.split(F.lower("record"), r"\s+")).alias("pos", "term"))
    kind = F.regexp_extract("term", r"^[+?~-]?(include|a|mx|ptr|exists|redirect|all)\b", 1)
    terms = stored(terms.select("name", "pos", "term", kind.alias("kind"), F.regexp_extract("term", r"^[+?~-]?(?:include:|redirect=)(.+)$", 1).alias("to")), "spf-terms")
    at = names.select(F.col("name").alias("root"), "name").withColumn("depth", F.lit(0))
    seen = None
    for depth in range(MOST_DEPTH + 1):
        here = stored(at.join(terms, "name").select("root", "name", "depth", "pos", "term", "kind", "to"), "spf-step")
        seen = here if seen is None else seen.unionByName(here)
        # A redirect counts only where the record has no `all` of its own.
        closed = here.filter("kind = 'all'").select("root", "name").distinct()
        nxt = here.filter("kind = 'include' OR kind = 'redirect'").join(closed.withColumn("closed", F.lit(True)), ["root", "name"], "left")
        at = nxt.filter("kind = 'include' OR closed IS NULL").select("root", F.col("to").alias("name")).distinct().withColumn("depth", F.lit(depth + 1))
        if at.isEmpty():
            break
    lookups = seen.groupBy("root").agg(F.count_if(F.col("kind").isin("include", "a", "mx", "ptr", "exists", "redirect")).alias("lookups"))
    redirected = seen.filter("kind = 'redirect'").select("root", F.col("to").alias("via")).distinct()
    own = seen.filter("kind = 'all' AND (name = root)").select("root", "depth", "term")
    via = seen.filter("kind = 'all'").join(redirected, ["root"]).filter(F.col("name") == F.col("via")).select("root", "depth", "term")
    ends = own.unionByName(via).groupBy("root").agg(F.min_by("term", "depth").alias("term"))
    out = names.join(records.select("name", "records"), "name", "left").join(lookups.withColumnRenamed("root", "name"), "name", "left").join(ends.withColumnRenamed("root", "name"), "name", "left")
    sign = F.when(F.col("term").isNotNull(), F.coalesce(F.nullif(F.regexp_extract("term", r"^([+?~-])", 1), F.lit("")), F.lit("+")))
    return out.select("name", F.coalesce("records", F.lit(0)).alias("records"), sign.alias("all"), F.coalesce("lookups", F.lit(0)).alias("lookups"))


def _nearest(names: DataFrame, found: DataFrame) -> DataFrame:
    """name, at, record of the nearest ancestor (or itself) that has one. found: at, record."""
    up = names.select("name", F.posexplode(urls.suffixes(F.col("name"))).alias("depth", "at"))
    return up.join(found, "at").groupBy("name").agg(F.min_by(F.struct("at", "record"), "depth").alias("x")).select("name", "x.at", "x.record")


def dmarc(names: DataFrame, answers: DataFrame) -> DataFrame:
    """name, at, policy: `sp` of an ancestor's record if it has one, else `p`."""
    found = _txt(answers, r"^v=dmarc1").select(F.regexp_replace("name", r"^_dmarc\.", "").alias("at"), "record")
    near = _nearest(names, found.groupBy("at").agg(F.min("record").alias("record")))
    tag = lambda t: F.nullif(F.regexp_extract(F.lower("record"), rf"(?:^|;)\s*{t}\s*=\s*([a-z]+)", 1), F.lit(""))
    return near.select("name", "at", F.when(F.col("name") == F.col("at"), tag("p")).otherwise(F.coalesce(tag("sp"), tag("p"))).alias("policy"))


def caa(names: DataFrame, answers: DataFrame) -> DataFrame:
    found = answers.filter("type = 'CAA' AND status = 0 AND size(data) > 0").select(F.col("name").alias("at"), F.get("data", F.lit(0)).alias("record"))
    return _nearest(names, found)


def findings(names: DataFrame, answers: DataFrame) -> DataFrame:
    """name, key, severity of all name checks."""
    failed = answers.filter("status NOT IN (0, 3)").select(F.regexp_replace("name", r"^_dmarc\.", "").alias("name"), "type").distinct()
    fail = failed.groupBy("name").agg(F.collect_set("type").alias("failed"))
    ok = lambda t: ~F.array_contains(F.coalesce("failed", F.array().cast("array<string>")), t)
    has = answers.filter("status = 0 AND size(data) > 0").groupBy("name").agg(F.bool_or(F.col("type") == "AAAA").alias("ipv6"), F.bool_or("ad").alias("dnssec"))
    s, d, c = spf(names, answers), dmarc(names, answers), caa(names, answers)
    t = names.join(s, "name").join(d.select("name", "policy"), "name", "left").join(c.select("name", F.lit(True).alias("caa")), "name", "left").join(has, "name", "left").join(fail, "name", "left")
    one = lambda when, key, severity: F.when(when, F.struct(F.lit(key).alias("key"), F.lit(severity).alias("severity")))
    found = F.array(
        one(ok("TXT") & (F.col("records") == 0), "spf_absent", "moyenne"), one(F.col("records") > 1, "spf_multiple", "haute"), one(F.col("all").isin("+", "?"), "spf_permissif", "haute"),
        one(F.col("lookups") > MOST_LOOKUPS, "spf_trop_de_requetes", "moyenne"), one(ok("TXT") & F.col("policy").isNull(), "dmarc_absent", "moyenne"), one(F.col("policy") == "none", "dmarc_none", "basse"),
        one(ok("CAA") & F.col("caa").isNull(), "caa_absent", "basse"), one(ok("A") & ~F.coalesce("dnssec", F.lit(False)), "dnssec_absent", "info"),
        one(ok("AAAA") & ~F.coalesce("ipv6", F.lit(False)), "ipv6_absent", "info"),
    )
    return t.select("name", F.explode(F.array_compact(found)).alias("f")).select("name", "f.key", "f.severity")
