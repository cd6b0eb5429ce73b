"""robots.txt: rules from lines, longest match, access of crawlers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Crawlers of language models and what they fetch for.
BOTS = {
    "GPTBot": "training", "OAI-SearchBot": "search", "ChatGPT-User": "on-demand", "ClaudeBot": "training", "Claude-User": "on-demand", "Claude-SearchBot": "search",
    "PerplexityBot": "search", "Perplexity-User": "on-demand", "Google-Extended": "training", "Googlebot": "search", "Bingbot": "search", "Applebot": "search", "Applebot-Extended": "training",
    "CCBot": "training", "Bytespider": "training", "Amazonbot": "search", "Meta-ExternalAgent": "training", "DuckAssistBot": "search", "MistralAI-User": "on-demand",
}


def lines(files: DataFrame) -> DataFrame:
    """site, pos, field, value of the meaning lines. files: site, text."""
    each = files.select("site", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    clean = F.trim(F.regexp_replace("line", "#.*$", ""))
    return each.select("site", "pos", F.lower(F.trim(F.split_part(clean, F.lit(":"), F.lit(1)))).alias("field"), F.trim(F.regexp_extract(clean, r"^[^:]*:(.*)$", 1)).alias("value")).filter("field <> ''")


def rules(files: DataFrame) -> DataFrame:
    """site, group_id, agent, seq, allow, pattern.

    A group starts at a user-agent line that does not follow another one; its number is a running sum over the file's lines,
    and a file is one row of `files`, so the window is as long as one file.
    """
    l = lines(files).filter(F.col("field").isin("user-agent", "allow", "disallow"))  # noqa: E741
    w = Window.partitionBy("site").orderBy("pos")
    agent = F.col("field") == "user-agent"
    starts = agent & ~F.coalesce(F.lag("field").over(w) == "user-agent", F.lit(False))
    l = l.withColumn("group_id", F.sum(starts.cast("int")).over(w))  # noqa: E741
    agents = l.filter(agent).select("site", "group_id", F.lower("value").alias("agent")).distinct()
    paths = l.filter(~agent & (F.col("value") != "")).select("site", "group_id", F.col("pos").alias("seq"), (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"))
    return agents.join(paths, ["site", "group_id"], "left")


def sitemap_lines(files: DataFrame) -> DataFrame:
    """site, url, relative (does not start with http)."""
    return lines(files).filter("field = 'sitemap'").select("site", F.col("value").alias("url"), (~F.lower("value").startswith("http")).alias("relative"))


def pattern_regex(pattern):
    """A robots pattern as a regular expression that matches from the start: `*` is anything, a closing `$` the end."""
    quoted = F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*+", ".*"), F.when(pattern.endswith("$"), F.lit("$")).otherwise(F.lit("")))


def verdicts(urls: DataFrame, table: DataFrame, agents: Sequence[str]) -> DataFrame:
    """site, path, agent, allowed: the longest matching pattern decides, allow on ties, and what nothing matches is allowed.

    urls: site, path; table: rules(). An agent without a group of its own falls under `*`. Which group speaks to an agent is
    settled for each site before the paths come in; patterns are tested once for each path and group, whatever the number of agents.
    """
    asked = urls.select("site", "path").distinct()
    groups = asked.select("site").distinct().select("site", F.explode(F.array(*map(F.lit, agents)) if agents else F.array().cast("array<string>")).alias("agent"))
    own = table.select(F.col("site").alias("own_site"), F.col("agent").alias("own")).distinct()
    groups = groups.join(own, (F.col("site") == F.col("own_site")) & (F.lower("agent") == F.col("own")), "left").select("site", "agent", F.coalesce("own", F.lit("*")).alias("group_agent"))
    a = asked.join(groups.select("site", "group_agent").distinct(), "site")
    r = table.filter("pattern IS NOT NULL").select(F.col("site").alias("r_site"), F.col("agent").alias("r_agent"), "allow", "pattern", pattern_regex(F.col("pattern")).alias("rx"))
    met = a.join(r, (F.col("site") == F.col("r_site")) & (F.col("group_agent") == F.col("r_agent")) & F.expr("path rlike rx"), "left")
    best = F.max_by("allow", F.struct(F.length("pattern"), "allow"))
    judged = met.groupBy("site", "path", "group_agent").agg(F.coalesce(best, F.lit(True)).alias("allowed"))
    return judged.join(groups, ["site", "group_agent"]).select("site", "path", "agent", "allowed")


def blocked_bots(allowed: DataFrame) -> DataFrame:
    """site, agent, purpose, severity of blocked crawlers: haute for search and on-demand, info for training."""
    purpose = F.element_at(F.create_map(*[F.lit(x) for p in BOTS.items() for x in p]), F.col("agent"))
    rows = allowed.filter("NOT allowed").select("site", "agent", purpose.alias("purpose"))
    return rows.withColumn("severity", F.when(F.col("purpose") == "training", "info").otherwise("haute"))
