"""Signals for answer engines: llms.txt, entities, authorship, snippets, trust pages, JSON-LD identity and prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish.functions import text, urls

# Kinds of pages that show who stands behind a site, by the path.
TRUST_PAGES = {
    "a_propos": "a-propos|about|qui-sommes-nous|notre-histoire|l-agence|le-cabinet|presentation", "contact": "contact", "mentions_legales": "mentions-legales|legal-notice|imprint|informations-legales",
    "confidentialite": "confidentialit|privacy|donnees-personnelles|rgpd", "equipe_auteurs": "equipe|team|auteur|author|fondateur|formateur|expert", "faq": "faq|questions-frequentes|foire-aux-questions",
    "avis": "avis|temoignages|testimonials|reviews|references|realisations|etudes-de-cas|case-stud", "cgv": "cgv|conditions-generales|terms",
}
ENTITIES = ("Organization", "LocalBusiness", "Person", "Corporation", "EducationalOrganization", "NGO", "OnlineStore")
ARTICLES = ("Article", "NewsArticle", "BlogPosting")


def trust_pages(pages: DataFrame) -> DataFrame:
    """site, kind of trust pages that a site lacks, from flags that are summed up before the exchange."""
    path = F.lower(urls.path(F.col("url")))
    flags = pages.groupBy("site").agg(*[F.bool_or(path.rlike(rx)).alias(k) for k, rx in TRUST_PAGES.items()])
    return flags.select("site", F.explode(F.array_compact(F.array(*[F.when(~F.col(k), F.lit(k)) for k in TRUST_PAGES]))).alias("kind"))


def llms_files(files: DataFrame) -> DataFrame:
    """site, exists, title, quote, sections, links of llms.txt answers. files: site, status, text."""
    t = F.col("text")
    fine = F.coalesce((F.col("status") == 200) & ~F.lower(t).rlike(r"\A\s*<(!doctype|html)"), F.lit(False))
    return files.select(
        "site", fine.alias("exists"), (fine & t.rlike(r"(?m)\A\s*# \S")).alias("title"), (fine & t.rlike(r"(?m)^> \S")).alias("quote"), F.when(fine, F.regexp_count(t, F.lit(r"(?m)^## \S"))).otherwise(0).alias("sections"),
        F.when(fine, F.regexp_count(t, F.lit(r"\]\(https?://[^)]+\)"))).otherwise(0).alias("links"),
    )


def _path(o: str, name: str, kind: str = "string") -> Column:
    return F.expr(f"try_variant_get({o}, '$.{name}', '{kind}')")


def type_counts(objects: DataFrame) -> DataFrame:
    """site, type, n over a site's JSON-LD objects (sources.html.jsonld)."""
    return objects.groupBy("site", "type").agg(F.count("*").alias("n"))


def entity_findings(sites: DataFrame, objects: DataFrame) -> DataFrame:
    """site, key: entite_absente, sameas_absent, marque_incoherente (several names of entities)."""
    e = objects.filter(F.col("type").isin(*ENTITIES))
    facts = e.groupBy("site").agg(F.count_if(F.expr("try_variant_get(o, '$.sameAs', 'variant') IS NOT NULL")).alias("same_as"), F.countDistinct(F.lower(F.trim(_path("o", "name")))).alias("names"))
    t = sites.join(facts, "site", "left")
    found = F.array(F.when(F.col("names").isNull(), F.lit("entite_absente")), F.when(F.col("same_as") == 0, F.lit("sameas_absent")), F.when(F.col("names") > 1, F.lit("marque_incoherente")))
    return t.select("site", F.explode(F.array_compact(found)).alias("key"))


def article_findings(objects: DataFrame) -> DataFrame:
    """site, url, key of articles without author or date."""
    a = objects.filter(F.col("type").isin(*ARTICLES))
    lacks = lambda name: F.expr(f"try_variant_get(o, '$.{name}', 'variant') IS NULL")
    found = F.array(F.when(lacks("author"), F.lit("article_sans_auteur")), F.when(lacks("datePublished") & lacks("dateModified"), F.lit("article_sans_date")))
    return a.select("site", "url", F.explode(F.array_compact(found)).alias("key"))


def snippet_limits(records: DataFrame) -> DataFrame:
    return records.filter(text.max_snippet(F.col("meta_robots")) | F.coalesce(F.lower("meta_robots").rlike("nosnippet"), F.lit(False))).select("site", "url")


def question_share(headings: DataFrame, pages: DataFrame) -> DataFrame:
    """site, questions, pages, few: sites with fewer headings that ask a question than pages."""
    q = headings.groupBy("site").agg(F.count_if(text.is_question(F.col("text"))).alias("questions"))
    n = pages.groupBy("site").agg(F.count("*").alias("pages"))
    return n.join(q, "site", "left").fillna(0, ["questions"]).withColumn("few", F.col("questions") < F.col("pages"))


def price(value: Column) -> Column:
    """A price as a number: `1 234,50 €`, `1,234.50` and `1234.5` alike; null where it is none."""
    bare = F.regexp_replace(value, r"[^0-9.,]", "")
    comma = F.regexp_replace(F.regexp_replace(bare, r"[.](?=[0-9]{3}(\D|$))", ""), ",", ".")
    dotted = F.regexp_replace(bare, r",(?=[0-9]{3}(\D|$))", "")
    return F.when(bare.rlike(r",[0-9]{1,2}$"), comma).otherwise(dotted).try_cast("double")


def prices_not_shown(objects: DataFrame, pages: DataFrame) -> DataFrame:
    """site, url, price of offers whose price the visible text lacks. pages: url, seq, text (of the body)."""
    offers = objects.withColumn("p", F.coalesce(_path("o", "offers.price"), _path("o", "price"), F.expr("try_variant_get(o, '$.offers[0].price', 'string')"))).filter("p IS NOT NULL")
    shown = F.transform(F.regexp_extract_all("text", F.lit(r"[0-9][0-9\s.,]*[0-9]|[0-9]"), F.lit(0)), lambda x: price(x))
    t = offers.select("site", "url", "seq", price(F.col("p")).alias("price")).join(pages.select("url", "seq", "text"), ["url", "seq"]).filter("price IS NOT NULL")
    return t.filter(~F.coalesce(F.array_contains(shown, F.col("price")), F.lit(False))).select("site", "url", "price")


def audit_validity(steps: DataFrame, needed: tuple[str, ...]) -> DataFrame:
    """site, missing (steps without a good result, joined), valid. steps: site, step, ok."""
    done = steps.groupBy("site").agg(F.collect_set(F.when(F.col("ok"), F.col("step"))).alias("done"))
    missing = F.array_except(F.array(*map(F.lit, needed)), "done")
    return done.select("site", F.array_join(missing, ", ").alias("missing"), (F.size(missing) == 0).alias("valid"))
