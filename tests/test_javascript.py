"""The lexer of scripts: parts in every context, offsets, and work that stays linear."""

import random
import time

import pytest

from lanternfish.functions import javascript
from lanternfish.operators import code_rules, code_scan


def found(source, elements=False):
    return [(k, source[a:b]) for k, a, b in javascript.parts(source, elements)]


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("a = /[`'\"/]/g; b = 'x' // c\nd", [("regex", "/[`'\"/]/g"), ("string", "'x'"), ("comment", "// c")]),
        ("x = a / b / c; y = (a) / 'q' / 2; z = t[0] / `r` / 2", [("string", "'q'"), ("template", "r")]),
        ("i++ / 2 / 3; a + /b'/", [("regex", "/b'/")]),
        ("a / /b'/.c / d", [("regex", "/b'/")]),
        ("`a${ b ? `c${d}` : {e: '}'} }f` + 1", [("template", "a"), ("template", "c"), ("string", "'}'"), ("template", "f")]),
        ("return /re'{2}/i.test(x)", [("regex", "/re'{2}/i")]),
        ("$return / 'a' / 2", [("string", "'a'")]),
        ("'abc\n 'd\\'e'", [("string", "'abc"), ("string", "'d\\'e'")]),
        ("'a\\\nb' /* c\n", [("string", "'a\\\nb'"), ("comment", "/* c\n")]),
        ("a = `u", [("template", "u")]),
        ("", []),
        ("'", [("string", "'")]),
        ("`a\\", [("template", "a")]),
        ("= [/ 'b' /", [("regex", "/ 'b' /")]),
        ("= /[ 'b' /", [("string", "'b'")]),
    ],
)
def test_parts_of_code(source, expected):
    assert found(source) == expected


def test_parts_of_elements():
    assert found("const a = <p title=\"it's\">don't // {x /* c */}<br/><img src='q'><b>z</b></p>; // yes", True) == [
        ("string", "\"it's\""), ("text", "don't // "), ("comment", "/* c */"), ("string", "'q'"), ("text", "z"), ("comment", "// yes"),
    ]
    assert found("x = <>it's {y && <A.B c={`d`} />} e</>; 'k'", True) == [("text", "it's "), ("template", "d"), ("text", " e"), ("string", "'k'")]
    assert found("if (a < b && c > d) e = 'f'; const g = <T,>(h: T) => 'i'; f<T>('j')", True) == [("string", "'f'"), ("string", "'i'"), ("string", "'j'")]


def test_random_programs_keep_their_parts():
    """Programs put together from known parts, separated by code after which an expression or a value is due."""
    rng = random.Random(5)
    for _ in range(300):
        source, expected = "", []
        for _ in range(rng.randint(1, 12)):
            kind = rng.choice(("comment", "string", "regex", "template"))
            body = "".join(rng.choice("ab{}() ;=<>,'\"`") for _ in range(rng.randint(1, 6)))
            if kind == "comment":
                part = rng.choice((f"/*{body}*/", f"//{body}"))
            elif kind == "string":
                quote = rng.choice("'\"")
                part = quote + body.replace(quote, "\\" + quote) + quote
            elif kind == "regex":
                part = f"/{body}[/{body}]\\/x/gi"
            else:
                part = body.replace("`", "\\`")
            source += " = " + ("`" + part + "`" if kind == "template" else part) + rng.choice(("\n", "\n;", "\n+ b / c\n", "\n, f(d) / 2\n"))
            expected.append((kind, part))
        assert found(source) == expected, source
        bare = javascript.blanked(source, False, javascript.NO_CODE)
        assert len(bare) == len(source) and bare.count("\n") == source.count("\n")


@pytest.mark.parametrize("unit", ["=[/", "=/[/]", "/[", "/=", "`${", "=<a>", "=<a></", "=/\\", "=/*", "var a = /x[/]'/g, b = `t${c + 'd'}u`; // e\n"])
def test_linear(unit):
    def seconds(size):
        start = time.process_time()
        n = sum(1 for _ in javascript.parts(unit * (size // len(unit)), True))
        return time.process_time() - start, n

    assert seconds(1_600_000)[0] < 12 * seconds(200_000)[0] + 1


def test_rows(spark):
    rows = [("s", "src/a.ts", "r = /'/ // client:load\nx = 'a'"), ("s", "src/b.ts", None), ("s", "src/c.tsx", "a = <p>it's</p> // b"), ("s", "src/d.astro", "<p>// x</p>"), ("s", "src/e.ts", "")]
    files = spark.createDataFrame(rows, "site string, path string, text string")
    got = {r.path: r.t for r in files.select("path", code_scan.without_comments(files.text, files.path).alias("t")).collect()}
    assert got == {"src/a.ts": "r = /'/               \nx = 'a'", "src/b.ts": None, "src/c.tsx": "a = <p>it's</p>     ", "src/d.astro": "<p>" + 8 * " ", "src/e.ts": ""}
    assert files.select(javascript.structure(files.text, files.path).alias("t")).collect()[2].t == "a = <p>    </p>     "
    spots = {r.path: r.p for r in files.select("path", javascript.literals(files.text, files.path).alias("p")).collect()}
    assert spots["src/b.ts"] is None and spots["src/e.ts"] == []
    assert [tuple(x) for x in spots["src/a.ts"]] == [("regex", 4, 7, 1), ("comment", 8, 22, 1), ("string", 27, 30, 2)]


def test_brackets_in_expressions_close_no_block(spark):
    """A regular expression with a bracket or quote neither ends a block nor hides what follows."""
    source = "a = defineAction({ input: /[}'\"]/, handler: (x) => x })\nb = defineAction({ handler: 1 })"
    row = spark.createDataFrame([(source,)], "t string").select(code_rules.blocks(r"defineAction\(\{")("t").alias("b")).first().b
    assert [(r.line_no, "handler" in r.block, "input" in r.top) for r in row] == [(1, True, True), (2, True, False)]
