"""HTML as elements, text nodes and blocks of text, and page records as expressions over them.

The only Python is a small reader that turns a page into arrays (one pass, linear in the page, Arrow batches); every rule over
them is a DataFrame expression. Page records need no shuffle, so tables and streams share them.

Elements are numbered in document order: the descendants of element `pos` are those up to `leave`, and the text within it are the
text nodes from `t0` up to `t1`. A text node is kept once, however deep it stands; the text of an element is made from its range.
A block is an element that is not inline, with the text that stands in it outside other blocks; every shown text node belongs to
the one block around it.

Reader rules: tag and attribute names in lower case, the first of equal attributes counts; an end tag closes everything above its
match; void elements have no content; a new p, li, dt, dd, option, tr, td, th, a, button or heading closes the open one that it
cannot stand in; text in script, style, noscript, svg and template is not visible; an element is hidden by `hidden`, `aria-hidden`,
an inline `display:none` or `visibility:hidden`, a closed dialog, or an ancestor.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish.functions import urls

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NO_TEXT = frozenset("script style noscript svg template".split())
LANDMARKS = frozenset("main nav header footer aside section article".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
# Elements whose text is no part of what a page shows, and elements that stand in the line of the block around them;
# the text of the second kind of those is a value of its own.
NOT_SHOWN = frozenset("script style noscript template textarea title".split())
INLINE = frozenset("a abbr b bdi bdo big button cite data del dfn em font i ins label mark option output q s small span strong sub summary sup time tt u".split())
VALUES = frozenset("a button label option summary".split())
#: Bits of what stands in code, in variables, in quotations, in elements whose content a head does not read as its own, in noscript.
WITHIN = {"code": 1, "pre": 1, "kbd": 1, "samp": 1, "var": 2, "q": 4, "cite": 4, **dict.fromkeys("title script style noframes template iframe noembed xmp textarea svg math".split(), 8), "noscript": 16}
#: Elements with a text of their own in elements(), beside those that another element names as its label.
TEXTED = ("title", "script", "style", "a", "button", "label", *sorted(HEADINGS))
#: Characters of text after which a batch is handed on; texts stay whole.
BATCH_TEXT = 4_000_000
_MARKS = {1: " ", 2: " "}
_LONE = re.compile(r"\W*(undefined|NaN|null)\W*")

# Start tag -> open elements that it closes, and elements that it does not look beyond.
_CELLS, _TABLE = frozenset(("td", "th")), frozenset(("table", "template"))
_SCOPE = _TABLE | _CELLS | frozenset(("caption", "button", "html", "object"))
IMPLIED: dict[str, tuple[frozenset, frozenset]] = {
    **dict.fromkeys(
        "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr main menu nav ol p pre search section summary table ul".split(),
        (frozenset(("p",)), _SCOPE),
    ),
    **dict.fromkeys(HEADINGS, (HEADINGS | {"p"}, _SCOPE | LANDMARKS | {"div", "li", "blockquote"})),
    "li": (frozenset(("li", "p")), _SCOPE | {"ul", "ol", "menu", "dir"}),
    **dict.fromkeys(("dt", "dd"), (frozenset(("dt", "dd", "p")), _SCOPE | {"dl"})),
    "option": (frozenset(("option",)), _SCOPE | {"select", "datalist"}),
    "optgroup": (frozenset(("option", "optgroup")), _SCOPE | {"select"}),
    **dict.fromkeys(_CELLS, (_CELLS, _TABLE | {"tr"})),
    "tr": (_CELLS | {"tr"}, _TABLE),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (_CELLS | {"tr", "thead", "tbody", "tfoot"}, _TABLE)),
    "a": (frozenset(("a",)), _SCOPE),
    "button": (frozenset(("button",)), _TABLE | _CELLS),
}


class Reader(HTMLParser):
    """Elements, text nodes and blocks of one page. Every element is opened and closed once and every text node is added once;
    counts of open tags spare the search for tags that are not open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.texts: list[dict] = []
        self.lines: dict[int, list[str]] = {}
        self.open: list[int] = []
        self.count: Counter[str] = Counter()
        self.words, self.gap = 0, False

    def handle_starttag(self, tag, attrs):
        closes, bounds = IMPLIED.get(tag, (frozenset(), frozenset()))
        if any(self.count[t] for t in closes):
            last = None
            for k in range(len(self.open) - 1, -1, -1):
                at = self.rows[self.open[k]]["tag"]
                if at in closes:
                    last = k
                elif at in bounds:
                    break
            if last is not None:
                self._close(last)
        up = self.rows[self.open[-1]] if self.open else None
        seen: dict[str, str] = {}
        for k, v in attrs:
            seen.setdefault(k, v or "")
        style = seen.get("style", "").replace(" ", "").lower()
        hidden = "hidden" in seen or seen.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style or tag in ("template", "noscript") or (tag == "dialog" and "open" not in seen)
        inline = (tag in INLINE or "-" in tag) and up is not None
        pos = len(self.rows)
        row = {
            "pos": pos, "tag": tag, "attrs": seen, "parent": up["pos"] if up else -1, "leave": pos, "t0": len(self.texts), "t1": len(self.texts), "words": self.words, "hidden": hidden or bool(up and up["hidden"]),
            "inert": tag in ("template", "noscript") or bool(up and up["inert"]), "landmark": pos if tag in LANDMARKS else (up["landmark"] if up else -1), "scope": (up["pos"] if "itemscope" in up["attrs"] else up["scope"]) if up else -1, "head": tag == "head" or bool(up and up["head"]),
            "main": tag == "main" or bool(up and up["main"]), "closed": tag in VOID, "block": up["block"] if inline else pos, "lone": None, "within": WITHIN.get(tag, 0) | (up["within"] if up else 0),
            "quiet": tag in NO_TEXT or bool(up and up["quiet"]), "unshown": tag in NOT_SHOWN or bool(up and up["unshown"]),
        }
        self.rows.append(row)
        self.gap |= tag in VALUES
        if tag == "img" and not row["hidden"] and self.open and "alt" in seen:
            self.texts.append({"kind": 2, "at": pos, "text": seen["alt"]})
        if tag == "br" and self.open:
            self._line(up, "\n")
        if tag in VOID:
            row["words"] = 0
        else:
            self.open.append(pos)
            self.count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.count[tag]:
            for k in range(len(self.open) - 1, -1, -1):
                if self.rows[self.open[k]]["tag"] == tag:
                    self.rows[self.open[k]]["closed"] = True
                    self._close(k)
                    return

    def _close(self, k: int):
        """Ends the open elements from the k-th on."""
        for pos in reversed(self.open[k:]):
            row = self.rows[pos]
            self.count[row["tag"]] -= 1
            row["leave"], row["t1"], row["words"] = len(self.rows), len(self.texts), self.words - row["words"]
            if row["block"] != pos:
                # A word alone in an inline element: few words and few nodes, so that nested elements are not read again and again.
                few = self.texts[row["t0"] : row["t1"]] if row["words"] <= 3 and row["t1"] - row["t0"] <= 8 else []
                lone = _LONE.fullmatch(" ".join("".join(t["text"] for t in few if t["kind"] == 0).split())) if not row["hidden"] and not row["unshown"] and not row["within"] & 3 else None
                if lone:
                    row["lone"] = lone.group(1)
                    first = next(t for t in few if t["kind"] == 0 and t["text"].strip())
                    if "line" in first:
                        line, at = first["line"]
                        line[at] = " " + line[at]
                self.gap |= bool(lone) or row["tag"] in VALUES
        del self.open[k:]

    def _line(self, up: dict, data: str) -> tuple[list[str], int] | None:
        """Adds shown text to the line of the block around it."""
        if up["hidden"] or up["unshown"]:
            return None
        line = self.lines.setdefault(up["block"], [])
        data = data.translate(_MARKS)
        if up["within"] & 7:
            line.append(f"\x01{up['within'] & 7}{data}\x02")  # what is left out depends on the rule
        else:
            line.append(" " + data if self.gap else data)
        self.gap = False
        return line, len(line) - 1

    def handle_data(self, data):
        if not self.open:
            self.texts.append({"kind": 1, "at": -1, "text": data})
            return
        up = self.rows[self.open[-1]]
        node = {"kind": 1 if up["quiet"] else 0, "at": up["pos"], "text": data}
        line = self._line(up, data)
        if line:
            node["line"] = line
        self.texts.append(node)
        if not up["quiet"]:
            self.words += len(data.split())

    def close(self):
        super().close()
        self._close(0)


ITEM = "pos int, tag string, attrs map<string,string>, parent int, leave int, t0 int, t1 int, words int, hidden boolean, inert boolean, landmark int, head boolean, main boolean, closed boolean, block int, lone string, within int, scope int"
PARSED = f"seq bigint, site string, url string, bytes_html bigint, items array<struct<{ITEM.replace(' ', ':').replace(',:', ', ')}>>, texts array<struct<kind:int, at:int, text:string>>, blocks array<struct<pos:int, text:string>>"


def _read(html: str) -> tuple[list[dict], list[dict], list[dict]]:
    reader = Reader()
    try:
        reader.feed(html)
        reader.close()
    except Exception as e:  # a page that breaks the reader must not end the job; it is reported as an element
        return [{"pos": 0, "tag": "!error", "attrs": {"why": type(e).__name__}, "parent": -1, "leave": 0, "t0": 0, "t1": 0, "words": 0, "hidden": False, "inert": False, "landmark": -1, "head": False, "main": False, "closed": True, "block": 0, "within": 0, "scope": -1}], [], []
    return reader.rows, reader.texts, [{"pos": k, "text": "".join(v)} for k, v in reader.lines.items()]


def parsed(pages: DataFrame, seq_col: str = "page_id") -> DataFrame:
    """seq, site, url, bytes_html, items (elements in order), texts (text nodes in order; kind 0 visible, 1 not, 2 the alt text of an
    image) and blocks of each page (url, html). A page that cannot be read has one element with the tag `!error`; a page without
    elements has empty arrays; pages without url are left out."""
    from lanternfish.plans.tables import small_batches
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    small_batches(pages.sparkSession)
    schema = to_arrow_schema(_parse_datatype_string(PARSED))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for seq, site, url, n, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                items, texts, blocks = _read(html or "")
                for x in items:
                    x["attrs"] = list(x["attrs"].items())
                out.append({"seq": seq, "site": site, "url": url, "bytes_html": n, "items": items, "texts": texts, "blocks": blocks})
                size += 200 * len(items) + sum(len(x["text"]) for x in texts) + sum(len(x["text"]) for x in blocks)
                if size > BATCH_TEXT:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, size = [], 0
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    rows = pages.filter(F.col("url").isNotNull()).select(F.col(seq_col).cast("bigint").alias("seq"), urls.host(F.col("url")).alias("site"), "url", F.coalesce(F.octet_length("html"), F.lit(0)).cast("bigint").alias("bytes_html"), "html")
    return rows.mapInArrow(work, PARSED)


def _folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _range(x: Column, kind: Column) -> Column:
    """The text nodes of one kind within an element, as an array of texts."""
    nodes = F.slice("texts", x["t0"] + 1, x["t1"] - x["t0"])
    return F.transform(F.filter(nodes, lambda t: t["kind"] == kind), lambda t: t["text"])


def text_of(x: Column) -> Column:
    """The text of an element: its visible text nodes joined, or those that are not visible where it is itself not visible."""
    quiet = x["tag"].isin(*sorted(NO_TEXT))
    return _folded(F.array_join(_range(x, F.when(quiet, 1).otherwise(0)), ""))


def elements(read: DataFrame, seq_col: str = "page_id") -> DataFrame:
    """One row for each element of pages (url, html) or of parsed(). text and alts (alt texts within) stand only at elements of which rules read them: TEXTED,
    buttons by role, properties of microdata, and those that aria-labelledby names; text is null elsewhere."""
    read = read if "items" in read.columns else parsed(read, seq_col)
    named = F.flatten(F.transform("items", lambda x: F.split(F.trim(F.coalesce(x["attrs"]["aria-labelledby"], F.lit(""))), r"\s+")))
    read = read.withColumn("named", F.array_remove(F.array_distinct(named), ""))
    told = lambda x: x["tag"].isin(*TEXTED) | (x["attrs"]["itemprop"].isNotNull() & x["attrs"]["itemscope"].isNull()) | F.coalesce(x["attrs"]["role"] == "button", F.lit(False)) | F.coalesce(F.array_contains("named", x["attrs"]["id"]), F.lit(False))
    each = read.select("seq", "site", "url", F.explode(F.transform("items", lambda x: F.struct(
        x.alias("x"), F.when(told(x), text_of(x)).alias("text"), F.when(told(x), F.trim(F.array_join(_range(x, F.lit(2)), " "))).alias("alts")))).alias("e"))
    return each.select("seq", "site", "url", "e.x.*", "e.text", "e.alts")


def lines(pages: DataFrame, seq_col: str = "page_id") -> DataFrame:
    """seq, site, url, pos, line of each block of pages or of parsed(); unmarked() gives the text of a line."""
    read = pages if "blocks" in pages.columns else parsed(pages, seq_col)
    return read.select("seq", "site", "url", F.inline("blocks")).withColumnRenamed("text", "line")


def unmarked(line: Column, without: int = 7) -> Column:
    """The text of a line without what stands in the WITHIN kinds of the mask `without`; runs of blanks are one blank."""
    drop = "".join(str(k) for k in range(1, 8) if k & without)
    kept = F.regexp_replace(line, f"\\x01[{drop}][^\\x02]*\\x02", "") if drop else line
    return _folded(F.regexp_replace(kept, "\\x01[1-7]|\\x02", ""))


def page_records(read: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Page records from parsed(), page by page. facts: url, final_status, … of the fetch, joined where given. Texts that a page
    lacks are empty and counts are 0; null is left for what is not known."""
    def lower(x, k):
        return F.lower(F.coalesce(x["attrs"][k], F.lit("")))

    def rel(x):
        return F.split(lower(x, "rel"), r"\s+")

    def every(when, value):
        return F.transform(F.filter("items", when), value)

    def first(when, value):
        return F.coalesce(F.get(every(when, value), F.lit(0)), F.lit(""))

    def count(when):
        return F.size(F.filter("items", when))

    def is_tag(*names):
        return lambda x: x["tag"].isin(*names)

    def named(name):
        return lambda x: (x["tag"] == "meta") & (F.lower(F.coalesce(x["attrs"]["name"], x["attrs"]["property"], x["attrs"]["http-equiv"])) == name)

    def meta(name):
        return first(named(name), lambda x: F.trim(x["attrs"]["content"]))

    def field(x):
        return x["tag"].isin("input", "select", "textarea") & ~lower(x, "type").isin("hidden", "submit", "button", "image", "reset")

    def nameless(x):
        return x["attrs"]["aria-label"].isNull() & x["attrs"]["aria-labelledby"].isNull() & x["attrs"]["title"].isNull() & x["attrs"]["id"].isNull()

    def jsonld(x):
        return (x["tag"] == "script") & (lower(x, "type") == "application/ld+json")

    def src(x):
        return F.coalesce(x["attrs"]["src"], x["attrs"]["href"])

    def insecure(x):
        link = F.array_contains(rel(x), "canonical") | F.array_contains(rel(x), "alternate")
        return x["tag"].isin("img", "script", "iframe", "link") & src(x).startswith("http://") & ~((x["tag"] == "link") & link)

    zone = F.array_max(every(is_tag("main", "article"), lambda x: F.struct((x["tag"] == "main").alias("m"), x["words"].alias("words"))))["words"]
    words = F.array_max(every(is_tag("body"), lambda x: x["words"]))
    robots = F.lower(F.concat_ws(",", meta("robots"), meta("googlebot")))
    out = read.select(
        "site", "seq", "url", first(is_tag("title"), text_of).alias("title"), meta("description").alias("meta_description"), robots.alias("meta_robots"), (count(named("viewport")) > 0).alias("viewport"),
        (count(named("og:title")) > 0).alias("og_title"), (count(named("og:image")) > 0).alias("og_image"), F.trim(first(is_tag("html"), lambda x: x["attrs"]["lang"])).alias("lang"),
        count(is_tag("h1")).alias("n_h1"), every(is_tag("h1"), text_of).alias("h1"),
        every(lambda x: (x["tag"] == "link") & F.array_contains(rel(x), "canonical") & x["attrs"]["href"].isNotNull(), lambda x: x["attrs"]["href"]).alias("canonicals"),
        every(lambda x: (x["tag"] == "link") & F.array_contains(rel(x), "alternate") & x["attrs"]["hreflang"].isNotNull(), lambda x: x["attrs"]["href"]).alias("hreflang"),
        words.cast("bigint").alias("words"), F.coalesce(F.nullif(zone, F.lit(0)), words, F.lit(0)).cast("bigint").alias("content_words"),
        count(lambda x: (x["tag"] == "img") & x["attrs"]["alt"].isNull()).cast("bigint").alias("imgs_no_alt"), count(lambda x: (x["tag"] == "img") & (x["attrs"]["width"].isNull() | x["attrs"]["height"].isNull())).cast("bigint").alias("imgs_no_dims"),
        (F.lower(first(is_tag("img"), lambda x: x["attrs"]["loading"])) == "lazy").alias("lazy_first_img"), count(lambda x: field(x) & nameless(x)).cast("bigint").alias("form_fields_no_label"),
        count(lambda x: x["attrs"]["itemtype"].isNotNull()).alias("microdata_items"), count(jsonld).alias("n_jsonld"), count(lambda x: jsonld(x) & F.try_parse_json(text_of(x)).isNull()).alias("jsonld_errors"),
        F.when(F.col("url").startswith("https://"), every(insecure, src)).otherwise(F.array().cast("array<string>")).alias("mixed_content"), "bytes_html",
    )
    out = out.withColumns({"is_html": F.lit(True), "noindex": F.contains("meta_robots", F.lit("noindex")) | F.array_contains(F.split(F.regexp_replace("meta_robots", r"\s", ""), ","), "none")})
    # Out of a generator each fact is computed once; the optimiser would write it anew at each of its uses in rules.
    out = out.select(F.inline(F.array(F.struct(*out.columns))))
    if facts is not None:
        return out.join(facts, "url", "left")
    return out.withColumns({"final_status": F.lit(200), "redirect_hops": F.lit(0)})


def headings(items: DataFrame) -> DataFrame:
    return items.filter(F.col("tag").rlike("^h[1-6]$") & ~F.col("hidden")).select("site", "url", "seq", "landmark", "pos", F.substring("tag", 2, 1).cast("int").alias("level"), F.substring("text", 1, 200).alias("text"))


def jsonld_objects(items: DataFrame) -> DataFrame:
    """site, url, seq, pos, path, key, role, o of every object with a type or an `@id` in the JSON-LD of pages, at any depth.

    path is the place in the block (keys and numbers from its root); key is the property that holds the object, arrays left out; role is `full` for objects that stand for
    themselves (the root, its list, `@graph`, and what OWN names), `review` below reviews and ratings, else null. The frontier holds
    the values of one depth, each level is a stored table, and the search ends when no value has children.
    """
    from lanternfish.plans.tables import stored

    block = F.try_parse_json("text")
    level = items.filter("tag = 'script' AND contains(lower(attrs['type']), 'ld+json')").select("site", "url", "seq", "pos", block.alias("v")).filter("v IS NOT NULL")
    level = level.withColumns({"path": F.lit("$"), "key": F.lit(None).cast("string"), "role": F.lit("full"), "types": F.array().cast("array<string>")})
    found = None
    while True:
        typed = F.expr("coalesce(try_variant_get(v, '$[\"@type\"]', 'array<string>'), array_compact(array(try_variant_get(v, '$[\"@type\"]', 'string'))))")
        level = level.withColumn("types", F.transform(F.filter(typed, lambda t: t.isNotNull() & (t != "")), lambda t: F.regexp_replace(t, r"^(https?://schema\.org/|schema:)", "")))
        level = stored(level.filter("schema_of_variant(v) LIKE 'OBJECT%' OR schema_of_variant(v) LIKE 'ARRAY%'"), "jsonld-level")
        if level.isEmpty():
            break
        here = level.filter("schema_of_variant(v) LIKE 'OBJECT%' AND (size(types) > 0 OR try_variant_get(v, '$[\"@id\"]', 'string') IS NOT NULL)")
        here = here.select("site", "url", "seq", "pos", "path", "key", "role", "types", F.col("v").alias("o"))
        found = here if found is None else found.unionByName(here)
        each = level.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("n", "k", "child")).select("site", "url", "seq", "pos", "path", "key", "role", "types", "n", "k", "child")
        own = F.col("k").isin(*OWN) | ((F.col("k") == "item") & F.array_contains("types", "ListItem")) | ((F.col("k") == "itemListElement") & F.array_contains("types", "ItemList"))
        role = F.when(F.col("k").isNull() | (F.col("k") == "@graph"), F.col("role")).when(own, "full").when(F.col("k").isin(*RATED), "review")
        level = each.select("site", "url", "seq", "pos", F.concat_ws("/", "path", F.coalesce("k", F.lpad(F.col("n").cast("string"), 6, "0"))).alias("path"), F.coalesce("k", "key").alias("key"), role.alias("role"), F.col("child").alias("v"), "types")
    if found is None:
        return level.select("site", "url", "seq", "pos", "path", "key", "role", "types", F.col("v").alias("o"))
    return found


#: Properties whose objects stand for themselves, and those that hold reviews and ratings.
OWN = ("mainEntity", "mainEntityOfPage", "video", "breadcrumb")
RATED = ("review", "reviews", "aggregateRating")


def jsonld(items: DataFrame) -> DataFrame:
    """site, url, seq, pos, o, type of every typed object at any depth, once for each of its types."""
    return jsonld_objects(items).select("site", "url", "seq", "pos", "o", F.explode("types").alias("type"))


def microdata(items: DataFrame) -> DataFrame:
    """site, url, item (its element), type, id, prop, value, holds (the item that a property is, null for plain values) of microdata:
    a property belongs to the nearest item around it; a name list gives a row for each name. `itemref` is not followed."""
    a = lambda k: F.col("attrs")[k]
    at = F.col("tag")
    value = (
        F.when(at == "meta", a("content")).when(at.isin("audio", "embed", "iframe", "img", "source", "track", "video"), a("src")).when(at.isin("a", "area", "link"), a("href"))
        .when(at == "object", a("data")).when(at.isin("data", "meter"), a("value")).when((at == "time") & a("datetime").isNotNull(), a("datetime")).otherwise(F.col("text"))
    )
    holds = F.when(a("itemscope").isNotNull(), F.col("pos"))
    props = items.filter(a("itemprop").isNotNull() & (F.col("scope") >= 0)).select("site", "url", "seq", F.col("scope").alias("item"), F.explode(F.split(F.trim(a("itemprop")), r"\s+")).alias("prop"), F.when(holds.isNull(), value).alias("value"), holds.alias("holds"))
    scopes = items.filter(a("itemscope").isNotNull()).select("seq", "url", F.col("pos").alias("item"), a("itemtype").alias("type"), a("itemid").alias("id"))
    return props.join(scopes, ["url", "seq", "item"]).select("site", "url", "item", "type", "id", "prop", "value", "holds")
