"""Values of a programme in texts, attributes, addresses and titles: which count as leaks, which are words."""

import time

import pytest
from pyspark.sql import functions as F

from lanternfish.operators import leaks
from lanternfish.sources import html

HEAD = "<html><head><title>{}</title><meta name=description content='{}'></head><body><p>Salut</p></body></html>"
#: html, grave tokens, tokens that stand alone
CASES = [
    # beside values, labels, greetings and dates
    ("<p>Montant : undefined €</p>", ["undefined"], []), ("<p>Temps : NaN min</p>", ["NaN"], []), ("<p>Budget : null</p>", ["null"], []), ("<p>Sièges restants : undefined</p>", ["undefined"], []),
    ("<p>Somme NaN €</p>", ["NaN"], []), ("<p>7 undefined</p>", ["undefined"], []), ("<p>Dès 12 € / NaN</p>", ["NaN"], []), ("<p>undefined%</p>", ["undefined"], []), ("<p>NaN abonnés</p>", ["NaN"], []),
    ("<p>NaN/NaN/NaN</p>", ["NaN"], []), ("<p>undefined undefined</p>", ["undefined"], []), ("<p>Ville : undefined, Lyon</p>", ["undefined"], []), ("<p>Salut null !</p>", ["null"], []),
    ("<p>Rédigé par undefined le 3 mai</p>", ["undefined"], []), ("<p>Publié le undefined</p>", ["undefined"], []), ("<p>Du undefined au undefined</p>", ["undefined", "undefined"], []), ("<p>Entre le NaN et le NaN</p>", ["NaN", "NaN"], []),
    ("<p>Coût : Infinity €</p>", ["Infinity"], []), ("<p>Contact : undefined undefined</p>", ["undefined"], []),
    # objects and templates anywhere
    ("<p>La liste de [object Object] et la suite du texte, bien plus longue que soixante caractères.</p>", ["[object Object]"], []), ("<p>Cher ${nom}, merci. {{ ville }}</p>", ["${nom}", "{{ ville }}"], []),
    ("<p>Vu le <time>Invalid Date</time></p>", ["Invalid Date"], []), ("<p>Coût : <!-- a -->undefined<!-- b --> €</p>", ["undefined"], []), ("<p><span>NaN</span>%</p>", ["NaN"], []),
    # alone in an element
    ("<ul><li>undefined<li>null</ul>", [], ["null", "undefined"]), ("<table><tr><td>NaN<td>ok</table>", [], ["NaN"]), ("<h3>undefined</h3>", [], ["undefined"]), ("<div><span>undefined</span><span>NaN</span></div>", [], ["NaN", "undefined"]),
    ("<p>Lire la page <a href='/x'>undefined</a> pour tout savoir sur ce vaste sujet.</p>", [], ["undefined"]), ("<p>Choix : <b>null</b></p>", ["null"], []), ("<button>Partir à undefined</button>", [], ["undefined"]),
    ("<select><option>undefined<option>Lyon</select>", [], ["undefined"]),
    # attributes
    ("<img src='/a.png' alt='undefined'>", ["undefined"], []), ("<img src='/a.png' alt='Vue de undefined'>", [], ["undefined"]), ("<input value='[object Object]'><input type=hidden value=undefined>", ["[object Object]"], []),
    ("<input placeholder='null'>", ["null"], []), ("<code title='undefined'>x</code><img alt='La valeur null en bref' src='/b.png'>", [], []), ("<time datetime='Invalid Date'>hier</time>", ["Invalid Date"], []),
    # addresses
    ("<a href='/cours/undefined'>F</a>", ["undefined"], []), ("<a href='https://www.ex.fr/cours/null/'>F</a>", ["null"], []), ("<a href='https://doc.example.org/js/undefined'>F</a><a href='/cours/nullable'>G</a>", [], []),
    ("<a href='https://doc.example.org/p?id=undefined'>F</a>", ["undefined"], []), ("<a href='tel:undefined'>F</a><a href='mailto:null@ex.fr'>G</a>", ["undefined"], []), ("<a href='/f?x=%5Bobject+Object%5D'>x</a>", ["[object Object]"], []),
    # titles
    (HEAD.format("undefined | Site", "Une page."), ["undefined"], []), (HEAD.format("Cours NaN", "Une page."), ["NaN"], []), (HEAD.format("Tout sur null", "La valeur null et undefined, en bref."), [], []), (HEAD.format("Cours", "Mise à jour : Invalid Date"), ["Invalid Date"], []),
    # words and code
    ("<p>En JavaScript, undefined veut dire que rien n'a été posé.</p>", [], []), ("<p>La valeur <em>null</em> marque une absence voulue.</p>", [], []), ("<p>Sortie : NaN</p>", [], []), ("<p>null, undefined et NaN ne sont pas pareils.</p>", [], []),
    ("<pre>Coût : undefined €</pre><p>Avec <code>NaN min</code></p>", [], []), ("<script>var a = undefined;</script><p hidden>undefined</p><template><p>null</p></template><textarea>null</textarea>", [], []),
    ("<p>Le match est nul ; nullable et undefined_x sont des noms.</p>", [], []), ("<p>La fonction, si rien n'est trouvé, rend la valeur : null</p>", [], []), ("<p>Par défaut : undefined</p>", [], []), ("<p>Infinity est un nombre.</p>", [], []),
]


@pytest.fixture(scope="module")
def read(spark):
    rows = [(k, f"https://ex.fr/{k}", h) for k, (h, _, _) in enumerate(CASES)]
    return html.parsed(spark.createDataFrame(rows, "page_id int, url string, html string").repartition(4)).cache()


def test_leaks_and_words(read):
    got = {}
    for r in leaks.leaks(html.elements(read).cache(), html.lines(read).cache()).collect():
        got.setdefault((int(r.url.rsplit("/", 1)[1]), r.key), []).append(r.signature.split(" — ")[0])
    for k, (h, grave, alone) in enumerate(CASES):
        assert (sorted(got.get((k, "fuite_rendu"), [])), sorted(got.get((k, "fuite_rendu_isolee"), []))) == (grave, alone), h


def test_signatures(spark):
    body = "<p>" + "mot " * 40 + "Coût : NaN € fin " + "mot " * 40 + "</p><a href='/a/undefined?token=s3cr3t'>x</a><img src='/i.png' alt='null'>"
    read = html.parsed(spark.createDataFrame([(1, "https://ex.fr/", body)], "page_id int, url string, html string"))
    got = sorted(r.signature for r in leaks.leaks(html.elements(read), html.lines(read)).collect())
    assert got[1:] == ['null — alt="null"', "undefined — href /a/undefined"]
    assert got[0].startswith("NaN — « …") and "Coût : NaN €" in got[0] and len(got[0]) <= 90


@pytest.mark.parametrize("text", ["<p>" + "null " * 5000, "<p>" + "Le null " * 5000 + "fin", "<p>" + "Coût : null € " * 5000, "<div>" + "<span>null</span> " * 5000])
def test_thousands_of_tokens_in_one_block(spark, text):
    """Twice the tokens take about twice the time."""
    def took(n):
        pages = spark.createDataFrame([(1, "https://ex.fr/", text * n)], "page_id int, url string, html string")
        read = html.parsed(pages).cache()
        read.count()
        began = time.time()
        leaks.in_lines(html.elements(read), html.lines(read)).agg(F.count("*")).collect()
        return time.time() - began

    took(1)
    assert took(4) < 6 * took(1) + 4
