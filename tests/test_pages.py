"""The reader of pages, heads, and structured data on small pages."""

import time

import pytest
from pyspark.sql import functions as F

from lanternfish.operators import modules, structured
from lanternfish.sources import html


def pages(spark, *bodies):
    return html.parsed(spark.createDataFrame([(k, f"https://s.com/{k}", b) for k, b in enumerate(bodies)], "page_id bigint, url string, html string")).cache()


def shape(text):
    """tag -> parent tag, in order."""
    rows = html._read(text)[0]
    return [(r["tag"], rows[r["parent"]]["tag"] if r["parent"] >= 0 else None) for r in rows]


def test_implied_end_tags():
    assert shape("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == [("ul", None), ("li", "ul"), ("li", "ul"), ("ul", "li"), ("li", "ul"), ("li", "ul")]
    assert shape("<div><p>a<p>b<div>c</div></div>") == [("div", None), ("p", "div"), ("p", "div"), ("div", "div")]
    assert shape("<table><tr><td>a<td>b<tr><th>c<table><tr><td>d</table><td>e</table>") == [("table", None), ("tr", "table"), ("td", "tr"), ("td", "tr"), ("tr", "table"), ("th", "tr"), ("table", "th"), ("tr", "table"), ("td", "tr"), ("td", "tr")]
    assert shape("<dl><dt>a<dd>b<dt>c</dl><select><option>x<option>y</select>") == [("dl", None), ("dt", "dl"), ("dd", "dl"), ("dt", "dl"), ("select", None), ("option", "select"), ("option", "select")]
    assert shape("<a href=1>x<a href=2>y</a><button>b<button>c</button><h1>t<h2>u</h2>") == [("a", None), ("a", None), ("button", None), ("button", None), ("h1", None), ("h2", None)]
    assert shape("<p><button><p>x</p></button></p></nope>") == [("p", None), ("button", "p"), ("p", "button")]


def test_numbers_of_elements_and_texts():
    items, texts, blocks = html._read("<body>a<div id=d>b<p>c <b>d</b><img alt=e></div>f</body>")
    of = {r["tag"]: r for r in items}
    within = lambda r: "".join(t["text"] for t in texts[r["t0"] : r["t1"]] if t["kind"] == 0)
    assert (within(of["body"]), within(of["div"]), within(of["p"]), within(of["b"])) == ("abc df", "bc d", "c d", "d")
    assert (of["body"]["leave"], of["div"]["leave"], of["p"]["leave"], of["b"]["leave"], of["img"]["leave"]) == (5, 5, 5, 4, 4)
    assert (of["body"]["words"], of["div"]["words"], of["p"]["words"]) == (5, 3, 2)
    assert [(b["pos"], b["text"]) for b in blocks] == [(0, "af"), (1, "b"), (2, "c d")]


@pytest.mark.parametrize("piece", ["<li>hello world again ", "<p>one <b>two ", "<div>x", "<span>null ", "<td>a<tr>", "<b></i>x", "<a href='/x'>y<h1>z"])
def test_pages_are_read_in_linear_time_and_space(piece):
    def took(n):
        began = time.perf_counter()
        _, texts, blocks = html._read(piece * n)
        return time.perf_counter() - began, sum(len(t["text"]) for t in texts), sum(len(b["text"]) for b in blocks)

    took(100)
    few, many = took(2500), took(10_000)
    assert many[1] == 4 * few[1] and many[2] <= 4 * few[2] + 8
    assert many[0] < 1.5 and many[0] < 10 * few[0] + 0.1


def test_ten_thousand_open_items_in_spark(spark):
    read = pages(spark, "<ul>" + "<li>hello world again <a href='/x'>y</a>" * 10_000)
    items = html.elements(read)
    assert items.groupBy("tag").count().orderBy("tag").collect() == [("a", 10_000), ("li", 10_000), ("ul", 1)]
    assert items.agg(F.sum(F.length("text"))).first()[0] == 10_000 and html.lines(read).count() == 10_000


LINK, META, TITLE = "<link rel=canonical href=x>", "<meta name=description content=d>", "<title>t</title>"
HEADS = [
    (f"<html><head>{TITLE}<img>{LINK}{META}</head><body></body></html>", [("haute", "<img> puis : link canonical, meta description")]),
    (f"<head>{TITLE}<div></div>{META}</head>", [("moyenne", "<div> puis : meta description")]), (f"<head>{TITLE}<div></div></head>{LINK}", []), (f"<head>{LINK}{META}</head><body><div></div>{LINK}</body>", []),
    (f"<head>{TITLE}words{LINK}</head>", [("haute", "#texte puis : link canonical")]), (f"<head>{TITLE} \n\t<!-- <div> -->{LINK}</head>", []), (f"<head>{TITLE} {LINK}</head>", [("haute", "#texte puis : link canonical")]),
    (f"﻿<!DOCTYPE html><html><head>{TITLE}{LINK}</head>", []), (f"{TITLE}<p>x</p>{META}<body>", [("moyenne", "<p> puis : meta description")]), (f"<div></div><head>{LINK}</head>", []), (f"words<head><p>{LINK}</head>", []),
    (f"<head><script>var a = '<div>'</script><style>p > a</style><template><div>{LINK}</div></template>{LINK}</head>", []), (f"<head><svg><title>x</title></svg>{META}</head>", [("moyenne", "<svg> puis : meta description")]),
    (f"<head><noscript><img></noscript>{LINK}</head>", [("moyenne", "<noscript><img> (sans JavaScript) puis : link canonical")]), (f"<head><noscript><link rel=stylesheet><style>a</style></noscript>{LINK}</head>", []),
    (f"<head><noscript>words</noscript>{META}</head>", [("moyenne", "<noscript>#texte (sans JavaScript) puis : meta description")]), (f"<head><div></div><noscript><img></noscript>{LINK}</head>", [("haute", "<div> puis : link canonical")]),
    (f"<head><noscript><img></noscript>{META}<div></div>{LINK}</head>", [("haute", "<div> puis : link canonical"), ("moyenne", "<noscript><img> (sans JavaScript) puis : meta description, link canonical")]),
    ("<head><custom-tag></custom-tag><meta property='og:title' content=x><link rel=alternate hreflang=fr href=y><link rel=alternate href=z></head>", [("haute", "<custom-tag> puis : meta og:title, link hreflang, link alternate")]),
    ("", []), (None, []), ("<head>", []),
]


def test_heads_that_end_early(spark):
    got = {}
    for r in modules.broken_head(pages(spark, *[h for h, _ in HEADS])).collect():
        got.setdefault(int(r.url.rsplit("/", 1)[1]), []).append((r.severity, r.signature))
    for k, (h, want) in enumerate(HEADS):
        assert sorted(got.get(k, [])) == sorted(want), h


def ld(*blocks):
    return "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks)


LD = [
    # required properties, alternatives, depth
    ('{"@type": "Product", "name": "x"}', ["Product : offers|review|aggregateRating"]), ('{"@type": "http://schema.org/Product", "name": "x", "offers": {"price": 1}}', []),
    ('{"@type": "WebPage", "mainEntity": {"@type": "Recipe", "name": " ", "image": []}}', ["Recipe : name, image"]), ('{"@type": "WebPage", "about": {"@type": "Recipe"}}', []),
    ('{"@graph": [{"@type": ["Dentist", "LocalBusiness"], "name": "n"}, {"@type": "WebSite"}]}', ["Dentist : address"]), ('[{"@type": "BreadcrumbList"}]', ["BreadcrumbList : itemListElement"]),
    ('{"@type": "ItemList", "itemListElement": [{"@type": "ListItem", "item": {"@type": "VideoObject", "name": "v", "thumbnailUrl": "t"}}]}', ["VideoObject : uploadDate"]),
    ('{"@type": "Organization", "review": {"@type": "Review", "author": "a"}, "aggregateRating": {"@type": "AggregateRating", "ratingValue": 4}}', ["AggregateRating : ratingCount|reviewCount", "Review : reviewRating"]),
    # references
    ('{"@graph": [{"@type": "Product", "@id": "#p", "name": "x"}, {"@type": "Offer", "itemOffered": {"@id": "#p"}, "price": 0}]}', []), ('{"@graph": [{"@type": "Product", "@id": "#p"}, {"@id": "#p", "name": "x", "offers": {"@id": "#o"}}]}', []),
    ('{"@graph": [{"@type": "Product", "@id": "#p", "name": "x"}, {"@type": "Review", "author": "a", "reviewRating": 1, "itemReviewed": [{"@id": "#p"}]}]}', []),
    # places and offers
    ('{"@type": "MusicEvent", "name": "n", "startDate": "d", "location": {"@type": "Place", "name": "p"}}', ["MusicEvent : location.address"]), ('{"@type": "Event", "name": "n", "startDate": "d", "location": [{"@type": "Place"}, {"@type": "VirtualLocation"}]}', []),
    ('{"@type": "Event", "name": "n", "startDate": "d", "location": "Lyon"}', []), ('{"@graph": [{"@type": "Event", "name": "n", "startDate": "d", "location": {"@id": "#l"}}, {"@type": "Place", "@id": "#l", "name": "p"}]}', ["Event : location.address"]),
    ('{"@type": "Event", "name": "n", "startDate": "d", "location": {"@id": "#elsewhere"}}', []), ('{"@type": "WebApplication", "name": "n", "aggregateRating": {"ratingValue": 1}, "offers": [{"@type": "Offer"}]}', ["WebApplication : offers.price"]),
    ('{"@type": "SoftwareApplication", "name": "n", "review": [1], "offers": {"price": 0}}', []),
    # courses, retired types
    ('{"@type": "Course", "name": "n", "hasCourseInstance": {}}', ["Course : description", structured.COURSE_INFO]), ('[{"@type": "Course", "name": "n"}, {"@type": "Course"}, {"@type": "Course", "name": "n", "description": "d"}]', ["Course : description", "Course : name, description"]),
    ('{"@type": "Thing", "about": {"@type": ["HowTo", "Quiz"]}}', [structured.RETIRED["HowTo"], structured.RETIRED["Quiz"]]), ('{"@type": "WebSite", "potentialAction": [{"@type": "SearchAction"}]}', [structured.SEARCH_BOX]),
    ('{"@type": "Vehicle", "offers": {"price": 1}}', [structured.VEHICLES]), ('{"@type": "VideoObject", "name": "n", "thumbnailUrl": "t", "uploadDate": "u", "educationalLevel": "e"}', [structured.LEARNING_VIDEO]),
    ("{bad", []), ("3", []), ('{"@type": null, "name": 1}', []), ('{"@type": ""}', []),
]


def test_structured_data_as_a_graph(spark):
    read = pages(spark, *[ld(b) for b, _ in LD])
    got = {}
    for r in structured.findings(html.elements(read)).collect():
        got.setdefault(int(r.url.rsplit("/", 1)[1]), []).append(r.signature)
    for k, (block, want) in enumerate(LD):
        assert sorted(got.get(k, [])) == sorted(want), block


def test_objects_of_any_depth(spark):
    deep = '{"@type": "A", "x": [' * 30 + '{"@id": "#last"}' + "]}" * 30
    found = html.jsonld_objects(html.elements(pages(spark, ld(deep, '{"@type": ["B", "C"]}'))))
    assert found.count() == 32
    assert html.jsonld(html.elements(pages(spark, ld(deep, '{"@type": ["B", "C"]}')))).groupBy("type").count().orderBy("type").collect() == [("A", 30), ("B", 1), ("C", 1)]
    assert html.jsonld_objects(html.elements(pages(spark, "<p>no data"))).count() == 0


def test_prices_that_the_text_lacks(spark):
    text = "<p>Formation de deux jours : 1&nbsp;490,50 € ; atelier 49 € ; coffret 1.200 €. " + "mot " * 40 + "</p>"
    block = ld('{"@type": "Product", "name": "x", "offers": [' + ", ".join('{"@type": "Offer", "price": %s}' % p for p in ("1490.5", '"49,00"', "1200", "75", '"sur devis"', "0", '"12345678901234567890"')) + "]}")
    read = pages(spark, text + block, "<p>court</p>" + block)
    got = structured.findings(html.elements(read), structured.page_texts(html.lines(read))).collect()
    assert [(r.url, r.key, r.signature) for r in got] == [("https://s.com/0", "jsonld_prix_absent_du_texte", "Offer : prix 75 absent du texte visible")]
