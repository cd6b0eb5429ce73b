"""Values of a programme shown to visitors: undefined, NaN, null, [object Object], Invalid Date, {{ name }}.

Texts (lines of blocks, attributes, titles) are cut at such tokens once, by built-in functions; each token gets what stands left and
right of it and whether the text ends with it, and is typed by these neighbours: one pass, linear in the text. A word in a
sentence is no leak. Grave (fuite_rendu) is a token beside a value, a label or a greeting; a token that fills its element, or
ends an attribute, may be meant (fuite_rendu_isolee).

All leaks of a text are counted; signatures hold no secrets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish.functions import text, urls
from lanternfish.operators.modules import held
from lanternfish.sources import html

# Tokens, and what makes a token beside other words a value.
WORD = r"(?:undefined|NaN|null)(?![\w-])"
TOKEN = rf"(?<![\w-]){WORD}"
OBJECT, DATE, TEMPLATE, INFINITE = r"\[object Object\]", r"(?<![\w-])Invalid Date(?![\w-])", r"\{\{\s*[\w.]+\s*\}\}|\$\{[\w.]+\}", r"(?<!\w)-?Infinity(?!\w)"
UNITS = (
    "h|hr|hrs|heures?|min|mn|minutes?|sec|secondes?|jours?|j|semaines?|mois|ans|km|m|cm|mm|kg|g|ml|pers|personnes?|places?|participants?|stagiaires?|inscrits?|abonnés?|avis|vues?|étoiles?|commentaires?|notes?|mises?"
    "|pts|points?|ko|mo|go|px|fois|séances?|sessions?|modules?|élèves|étudiants?|eur|usd|euros?"
)
VALUE_AFTER, VALUE_BEFORE = rf"(?iU)^\s*(?:[€$£%‰]|\d|(?:{UNITS})(?![^\W\d_]))", r"(?U)[\d€$£%]\s*(?:[/x×+–-]\s*)?$"
RUN_AFTER, RUN_BEFORE = rf"(?U)^\s*/\s*{WORD}", r"(?U)(?<![\w-])(?:undefined|NaN|null)\s*/\s*$"
LABEL = r"(?U)(?:^|[.!?;]\s+)([^:.!?;]{1,30}?)\s*:\s*$"
LABEL_WORDS = r"(?U)^[^\W\d_][^*+=<>/'\"()]*$"
GREETING = (
    r"(?iU)(?:(?:^|[.!?]\s+)(?:Bonjour|Bonsoir|Salut|Bienvenue|Hello|Hi|Hey|Coucou|Cher|Chère|Par|Auteur)|\b(?:écrit|posté|publié|rédigé|ajouté|créé|mis à jour) par"
    r"|\b(?:ajouté|publié|créé|modifié|posté|édité|écrit|rédigé|mis à jour|mise à jour)\s+(?:le|en))\s*[,:]?\s*(?:à\s+)?$"
)
PERIOD = r"(?iU)(?:^|[.!?]\s+)(?:Du|De|Entre le)\s*$"
PERIOD_AFTER, PERIOD_BEFORE = rf"(?U)^\s+(?:au|à|et)\s+(?:le\s+)?{WORD}", r"(?iU)(?:^|[.!?]\s+)(?:Du|De|Entre le)\s+(?:undefined|NaN|null)\s+(?:au|à|et)\s+(?:le\s+)?$"
GOES_ON = r"(?U)^(?:\s*[(\[]|\s*,\s*\S|\s+(?:le|du|au|à|depuis)\s+\d)"
TAUGHT = (
    "exemple", "exemples", "remarque", "remarques", "astuce", "attention", "définition", "syntaxe", "retour", "résultat", "résultats", "sortie", "valeur", "valeurs", "type", "types", "réponse", "erreur", "explication",
    "conseil", "cas", "output", "example", "examples", "result", "returns", "return", "value", "note technique", "valeur retournée", "valeur par défaut", "par défaut", "default", "défaut", "number", "string", "boolean",
    "object", "array", "bigint", "symbol", "function", "nombre", "chaîne", "booléen", "tableau", "fonction", "q", "r",
)
SENTENCE_WORDS = (
    "de", "du", "des", "que", "qu", "le", "la", "les", "l", "en", "à", "au", "aux", "sur", "et", "ou", "vs", "avec", "sans", "pour", "par", "ce", "cet", "cette", "un", "une", "pourquoi", "comment", "quand", "si",
    "is", "the", "of", "about", "and", "with", "to", "a", "an", "what", "why", "how", "or", "valeur", "type", "mot", "variable", "propriété", "erreur", "constante", "résultat", "value", "keyword", "error",
)
ARTICLES = ("le", "la", "les", "l", "un", "une", "the", "a", "an")
TITLES = {"og:title": "titre", "twitter:title": "titre", "description": "description", "og:description": "description", "twitter:description": "description"}
TITLE_PARTS = r"(?U)\s*[|–—·»]\s*|\s+-\s+"
NO_ATTRIBUTES = ("meta", "link", "base", "script", "style", "head", "html")
UNWRITTEN_INPUTS = ("hidden", "password", "checkbox", "radio", "file", "image", "color", "range")
#: Characters of a token's neighbourhood, and tokens with their gaps that can lie in it (each takes 4 characters at least).
LEFT, RIGHT, NEAR = 60, 80, 20

#: What a text must hold to be looked at more closely.
_MAYBE = r"undefined|NaN|null|Infinity|\[object Object\]|Invalid Date|\{\{|\$\{"
_ANY = f"(?U){OBJECT}|{DATE}|{TEMPLATE}|{INFINITE}|{TOKEN}"
# Possessive, so that the length of a text does not matter to the depth of the match.
_FILLED = r"(?U)^\W*+(?:undefined|NaN|null)(?:[\s/.\-]++(?:undefined|NaN|null))*+\W*+$"
_PLAIN = r"^(?:undefined|NaN|null)$"


def _neighbours(t: Column) -> Column:
    """Array of tok, left, right and ends (only tokens and punctuation follow) for the tokens of a text, in order."""
    pieces, toks = F.split(t, _ANY, -1), F.regexp_extract_all(t, F.lit(_ANY), F.lit(0))
    cut = F.struct(pieces.alias("p"), toks.alias("k"))
    of = F.transform(F.array(cut), lambda c: F.struct(c["p"].alias("p"), c["k"].alias("k"), _last_break(c["p"], c["k"]).alias("last")))

    def around(c: Column) -> Column:
        p, k, n = c["p"], c["k"], F.size(c["k"])
        ends = F.element_at(p, -1).rlike(r"""(?U)^[\s.,;!?)\]»”"']*$""")
        before = lambda i: F.concat(F.array_join(F.transform(F.sequence(F.greatest(i - NEAR, F.lit(0)), i), lambda j: F.when(j == i, F.get(p, j)).otherwise(F.concat(F.right(F.get(p, j), F.lit(LEFT)), F.get(k, j)))), ""))
        after = lambda i: F.array_join(F.transform(F.sequence(i + 1, F.least(i + NEAR, n)), lambda j: F.concat(F.left(F.get(p, j), F.lit(RIGHT)), F.when(j < n, F.get(k, j)).otherwise(F.lit("")))), "")
        one = lambda i: F.struct(F.get(k, i).alias("tok"), F.right(before(i), F.lit(LEFT)).alias("left"), F.left(after(i), F.lit(RIGHT)).alias("right"), (ends & (i >= c["last"])).alias("ends"))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<struct<tok:string,left:string,right:string,ends:boolean>>"))

    return F.get(F.transform(of, around), F.lit(0))


def _last_break(p: Column, k: Column) -> Column:
    """The last token that is more than a blank or comma away from the token before it, or no plain token; 0 if there is none."""
    plain = lambda j: F.get(k, j).rlike(_PLAIN) & F.get(p, j).rlike(r"(?U)^[\s,/.\-]+$")
    later = F.when(F.size(k) > 1, F.sequence(F.lit(1), F.size(k) - 1)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.array_max(F.filter(later, lambda j: ~plain(j))), F.lit(0))


def _beside_value(left: Column, right: Column) -> Column:
    return right.rlike(VALUE_AFTER) | left.rlike(VALUE_BEFORE) | right.rlike(RUN_AFTER) | left.rlike(RUN_BEFORE)


def _excerpt(t: Column, tok: Column, left: Column, right: Column) -> Column:
    """Up to 60 characters of the text around the token."""
    more = F.lit("…")
    cut = F.concat(F.when(F.length(left) > 25, more).otherwise(""), F.right(left, F.lit(25)), tok, F.left(right, F.lit(30)), F.when(F.length(right) > 30, more).otherwise(""))
    return F.coalesce(t, cut)


def found(rows: DataFrame) -> DataFrame:
    """rows (with t, a text whose blanks are folded) -> the same without t, once for each leak: tok, excerpt, kind (object, value, bare) and nth (order)."""
    keys = [c for c in rows.columns if c != "t"]
    rows = held(rows.withColumnRenamed("t", "text"), "t", F.col("text")).drop("text").filter(F.col("t").rlike(_ANY))
    rows = held(rows, "whole", F.when(F.col("t").rlike(_FILLED), F.array_sort(F.array_distinct(F.regexp_extract_all("t", F.lit(f"(?U){TOKEN}"), F.lit(0))))))
    # A text of tokens only: one token repeated is a value, several are what they are.
    several = F.regexp_count("t", F.lit(f"(?U){TOKEN}")) > 1
    first = F.regexp_extract("t", rf"(?U)^(.*?){TOKEN}(.*)$", 1), F.regexp_extract("t", rf"(?U)^(.*?){TOKEN}(.*)$", 2)
    alone = F.when(F.when(several, F.size("whole") == 1).otherwise(_beside_value(*first)), "value").otherwise("bare")
    filled = rows.filter("whole IS NOT NULL").select(*keys, F.explode("whole").alias("tok"), F.substring("t", 1, 60).alias("excerpt"), alone.alias("kind"), F.lit(1_000_000_000).alias("nth"))
    brief = F.when(F.length("t") <= 60, F.col("t")).alias("brief")
    each = rows.filter("whole IS NULL").select(*keys, brief, F.posexplode(_neighbours(F.col("t"))).alias("nth", "x")).select(*keys, "brief", "nth", "x.*")
    left, right, tok = F.col("left"), F.col("right"), F.col("tok")
    finishes = F.col("ends") | right.rlike(GOES_ON)
    label = F.trim(F.regexp_extract(F.right(left, F.lit(50)), LABEL, 1))
    labelled = (F.length(label) >= 3) & (F.size(F.split(label, r"(?U)\s+")) <= 4) & ~F.lower(label).isin(*TAUGHT) & label.rlike(LABEL_WORDS)
    period = (F.right(left, F.lit(12)).rlike(PERIOD) & right.rlike(PERIOD_AFTER)) | F.right(left, F.lit(50)).rlike(PERIOD_BEFORE)
    value = _beside_value(left, right) | (tok.rlike(_PLAIN) & (((labelled | F.right(left, F.lit(40)).rlike(GREETING)) & finishes) | period))
    # Of the first two kinds only the first of a text counts.
    grave = tok.rlike(f"^(?:{OBJECT}|Invalid Date|{TEMPLATE})$")
    kind = F.when(grave, "object").when(value, "value")
    name = F.when(tok.contains("Infinity"), "Infinity").otherwise(tok)
    each = each.select(*keys, name.alias("tok"), _excerpt(F.col("brief"), tok, left, right).alias("excerpt"), kind.alias("kind"), F.when(grave, F.col("nth")).otherwise(F.col("nth") + 1_000_000_000).alias("nth")).filter("kind IS NOT NULL")
    once = F.col("tok").isin("[object Object]", "Invalid Date")
    firsts = each.filter(once).groupBy(*keys, "tok", "kind").agg(F.min_by("excerpt", "nth").alias("excerpt"), F.min("nth").alias("nth"))
    return filled.unionByName(each.filter(~once)).unionByName(firsts)


def _mark(tok: Column, what: Column) -> Column:
    return F.concat(tok, F.lit(" — "), what)


def _quoted(what: Column) -> Column:
    return F.concat(F.lit("« "), what, F.lit(" »"))


def in_lines(items: DataFrame, lines: DataFrame) -> DataFrame:
    """Leaks of the text of blocks; a token that fills an inline element counts if the element is a value of its own (a link, a
    button) or if its line is no sentence of three other words."""
    some = lines.filter(F.col("line").rlike(_MAYBE)).select("site", "url", "seq", "pos", "line")
    shown = held(some, "t", text.masked(html.unmarked(F.col("line"), 3))).drop("line").filter("t <> ''")
    hits = found(shown)
    label = items.filter("tag = 'button' AND lone IS NULL AND NOT hidden").select("url", "seq", F.col("block").alias("pos"), F.regexp_extract("text", rf"(?U)({TOKEN})\W*$", 1).alias("tok"), F.lit(True).alias("strong"), F.size(F.split("text", " ")).alias("n")).filter("tok <> '' AND n <= 8").drop("n")
    lone = items.filter("lone IS NOT NULL AND NOT hidden").select("url", "seq", F.col("block").alias("pos"), F.col("lone").alias("tok"), F.col("tag").isin(*sorted(html.VALUES)).alias("strong"))
    alone = lone.unionByName(label).groupBy("url", "seq", "pos", "tok").agg(F.bool_or("strong").alias("strong"))
    alone = alone.join(hits.select("url", "seq", "pos", "tok").distinct(), ["url", "seq", "pos", "tok"], "left_anti").join(shown, ["url", "seq", "pos"])
    side = held(alone, "side", F.split("t", F.concat(F.lit(r"(?U)(?<![\w-])"), F.col("tok"), F.lit(r"(?![\w-])")), 2)).filter("size(side) = 2")
    left, right = F.get("side", F.lit(0)), F.get("side", F.lit(1))
    words = F.regexp_count(F.concat_ws(" ", F.right(left, F.lit(200)), F.left(right, F.lit(200))), F.lit(r"(?U)\w+"))
    brief = F.when(F.length("t") <= 60, F.col("t"))
    bare = side.filter(F.col("strong") | (words < 3)).select("site", "url", "tok", _excerpt(brief, F.col("tok"), left, right).alias("excerpt"), F.lit("bare").alias("kind"))
    all_ = hits.select("site", "url", "tok", "excerpt", "kind").unionByName(bare)
    return all_.select("site", "url", _mark(F.col("tok"), _quoted(F.col("excerpt"))).alias("signature"), (F.col("kind") == "bare").alias("alone"))


def _written(items: DataFrame) -> DataFrame:
    """Elements whose attributes are shown: not hidden, not in code or the head."""
    return items.filter(~F.col("hidden") & ~F.col("head") & ~F.col("tag").isin(*NO_ATTRIBUTES) & (F.col("within").bitwiseAND(F.lit(3)) == 0))


def in_attributes(items: DataFrame) -> DataFrame:
    """Leaks in attributes that visitors read or hear."""
    a = lambda k: F.col("attrs")[k]
    typed = (F.col("tag") == "input") & ~F.lower(F.trim(F.coalesce(a("type"), F.lit("text")))).isin(*UNWRITTEN_INPUTS)
    pairs = F.array(*(F.struct(F.lit(k).alias("name"), (F.when(typed, a(k)) if k == "value" else a(k)).alias("value")) for k in ("alt", "title", "aria-label", "placeholder", "datetime", "value")))
    rows = _written(items).select("site", "url", "seq", "pos", F.inline(F.filter(pairs, lambda x: x["value"].rlike(_ANY))))
    rows = rows.select("site", "url", "seq", "pos", "name", text.masked(F.trim(F.regexp_replace("value", r"(?U)\s+", " "))).alias("t"))
    first = found(rows.withColumn("shown", F.substring("t", 1, 60))).groupBy("site", "url", "seq", "pos", "name", "shown").agg(F.min_by("tok", F.struct("nth", "tok")).alias("tok")).withColumn("alone", F.lit(False))
    last = rows.filter(F.col("name").isin("alt", "title", "aria-label")).select("site", "url", "seq", "pos", "name", F.substring("t", 1, 60).alias("shown"), F.regexp_extract("t", rf"(?U)({TOKEN})\W*$", 1).alias("tok"), F.lit(True).alias("alone"))
    last = last.filter("tok <> ''").join(first.select("url", "seq", "pos", "name"), ["url", "seq", "pos", "name"], "left_anti")
    said = F.concat(F.col("name"), F.lit('="'), F.col("shown"), F.lit('"'))
    return first.unionByName(last).select("site", "url", _mark(F.col("tok"), said).alias("signature"), "alone")


def in_addresses(items: DataFrame) -> DataFrame:
    """Leaks in link and source addresses: a path segment on the page's own host, a query value anywhere, an empty contact."""
    pairs = F.array(*(F.struct(F.lit(k).alias("name"), F.trim(F.col("attrs")[k]).alias("u")) for k in ("href", "src")))
    rows = _written(items).select("site", "url", F.inline(F.filter(pairs, lambda x: x["u"].rlike(r"(?i)undefined|null|NaN|object"))))
    u, decoded = F.col("u"), lambda c: F.coalesce(F.try_url_decode(c), c)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.trim(decoded(F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z]+:([^?#]*)", 1), r"\+", "%2B")))
    contact = F.when(rest.rlike(r"^(?:undefined|null|NaN)$|^undefined@|@(?:undefined|null|NaN)(?:\.|$)"), F.coalesce(*(F.when(rest.contains(w), F.lit(w)) for w in ("undefined", "null", "NaN"))))
    place = F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    bare = lambda h: F.regexp_replace(F.lower(h), r"^www\.", "")
    own = (place == "") | (bare(place) == bare(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)))
    path = F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    segment = F.nullif(F.regexp_extract(path, r"(?:^|/)(undefined|null|NaN)(?=[/.]|$)", 1), F.lit(""))
    pair = F.get(F.filter(F.split(F.regexp_extract(u, r"\?([^#]*)", 1), "&"), lambda p: F.regexp_extract(p, "=(.*)$", 1).isin("undefined", "null", "NaN")), F.lit(0))
    value = F.regexp_extract(pair, "=(.*)$", 1)
    within = F.when(decoded(u).rlike(OBJECT), F.lit("[object Object]")).otherwise(F.coalesce(F.when(own, segment), value))
    by_value = ~decoded(u).rlike(OBJECT) & F.coalesce(F.when(own, segment), F.lit("")).eqNullSafe("") & ~scheme.isin("tel", "mailto")
    rows = rows.filter(~scheme.isin("data", "javascript", "blob")).withColumns({"tok": F.when(scheme.isin("tel", "mailto"), contact).otherwise(within), "by_value": by_value, "pair": F.regexp_extract(pair, "^([^=]*)", 1)}).filter("tok IS NOT NULL")
    named = F.when(F.col("by_value"), F.concat(F.lit("?"), F.when(F.col("pair").rlike(urls.SECRET_NAMES), "…").otherwise(F.substring("pair", 1, 20)), F.lit("="), "tok")).otherwise("")
    return rows.select("site", "url", _mark(F.col("tok"), F.concat("name", F.lit(" "), F.substring(urls.secretless_url(u), 1, 60), named)).alias("signature"), F.lit(False).alias("alone"))


def in_titles(items: DataFrame) -> DataFrame:
    """Leaks in titles and descriptions: a part between bars that is a token, or a title that ends with one; once for each page."""
    name = F.lower(F.trim(F.coalesce(F.nullif(F.col("attrs")["property"], F.lit("")), F.col("attrs")["name"])))
    label = F.element_at(F.create_map(*map(F.lit, (x for p in TITLES.items() for x in p))), name)
    told = items.filter((F.col("tag") == "meta") & ~F.col("hidden") & name.isin(*TITLES)).select("site", "url", "seq", label.alias("label"), F.col("attrs")["content"].alias("v"))
    title = items.filter("tag = 'title' AND text <> ''").select("site", "url", "seq", F.lit("titre").alias("label"), F.col("text").alias("v"))
    rows = title.unionByName(told).filter(F.col("v").rlike(_ANY)).select("site", "url", "seq", "label", text.masked(F.trim(F.regexp_replace("v", r"(?U)\s+", " "))).alias("v")).distinct()
    parts = rows.select("*", F.posexplode(F.split("v", TITLE_PARTS)).alias("part", "t")).withColumn("t", F.trim("t"))
    hits = found(parts)
    ended = parts.filter("label = 'titre'").withColumns({"tok": F.regexp_extract("t", rf"(?U)({TOKEN})[\s.!]*$", 1), "words": F.regexp_extract_all(F.lower(F.regexp_extract("t", rf"(?U)^(.*){TOKEN}[\s.!]*$", 1)), F.lit(r"(?U)\w+"), F.lit(0))})
    phrase = (F.size("words") > 0) & (F.element_at("words", -1).isin(*SENTENCE_WORDS) | F.get("words", F.lit(0)).isin(*ARTICLES))
    ended = ended.filter((F.col("tok") != "") & ~F.coalesce(phrase, F.lit(False))).join(hits.select("url", "seq", "label", "v", "part"), ["url", "seq", "label", "v", "part"], "left_anti")
    same = ["site", "url", "seq", "label", "v", "tok"]
    once = hits.select(*same).unionByName(ended.select(*same)).distinct()
    return once.select("site", "url", _mark(F.col("tok"), F.concat("label", F.lit(" "), _quoted(F.substring("v", 1, 60)))).alias("signature"), F.lit(False).alias("alone"))


def leaks(items: DataFrame, lines: DataFrame) -> DataFrame:
    """Observations of all leaks. items: sources.html.elements(); lines: sources.html.lines() of the same pages."""
    every = in_lines(items, lines).unionByName(in_attributes(items)).unionByName(in_addresses(items)).unionByName(in_titles(items))
    key = F.when(F.col("alone"), "fuite_rendu_isolee").otherwise("fuite_rendu")
    return every.select("site", "url", key.alias("key"), F.when(F.col("alone"), "basse").otherwise("haute").alias("severity"), F.substring("signature", 1, 200).alias("signature"), F.substring("signature", 1, 160).alias("example"))
