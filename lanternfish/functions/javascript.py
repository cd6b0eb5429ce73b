"""JavaScript and TypeScript sources told apart into code, comments, strings, templates, regular expressions and text of elements.

One pass over the tokens from left to right with a stack of contexts: code between brackets, templates with code in `${}`, tags of
elements and what stands between them. A slash opens a regular expression where no value stands before it, and `<` an element
likewise, in files whose names end in `x`. The work is linear in the text, also for lines without a line end or a closing mark.

Defined cases: null gives null, the empty text is empty; a string ends at the end of its line at the latest, comments and
templates that are never closed run to the end of the text; blanked characters become blanks, so offsets and lines stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

#: Names of files that the lexer reads.
SCRIPTS = r"\.[cm]?[jt]sx?$"

_CODE = re.compile(r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\n])*+"?|'(?:\\.|[^'\\\n])*+'?)|(?P<word>[\w$]+)|(?P<space>\s+)|(?P<mark>.)""", re.S)
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])++", re.S)
_TAG = re.compile(r"""(?P<string>"[^"]*+"?|'[^']*+'?)|(?P<comment>/\*.*?(?:\*/|\Z))|(?P<end>/?>)|(?P<open>\{)|(?P<other>[^"'{}/>]++|.)""", re.S)
_BETWEEN = re.compile(r"(?P<close></[^>]*+>?)|(?P<tag><(?=[A-Za-z_$>])(?![\w$]+\s*(?:,|extends\s)))|(?P<open>\{)|(?P<text>[^<{]++|.)", re.S)
_PLAIN, _CLASS = re.compile(r"(?:\\[^\n]|[^/\\\[\n])*+"), re.compile(r"\[(?:\\[^\n]|[^\]\\\n])*+\]")
_NAME, _FLAGS = re.compile(r"[\w$.:-]*+"), re.compile(r"[A-Za-z]*+")

# Words of the language that an expression follows, and elements of HTML that have no end.
BEFORE_VALUE = frozenset("return typeof case in of delete void throw new instanceof do else yield await default".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Marks that end a value.
ENDS_VALUE = frozenset((")", "]", "++", "--", "`", '"'))


class _Expressions:
    """Ends of regular expressions. What one failed try has seen to lead nowhere is not tried again, so all tries are linear."""

    def __init__(self, text: str):
        self.text, self.dead, self.unclosed = text, set(), (0, 0)

    def end(self, at: int) -> int:
        """The end of the expression that opens at `at`, 0 if there is none."""
        seen, k = [], at + 1
        while True:
            k = _PLAIN.match(self.text, k).end()
            here = self.text[k : k + 1]
            if here == "/":
                return _FLAGS.match(self.text, k + 1).end() if k > at + 1 else 0
            if here != "[" or k in self.dead or self.unclosed[0] <= k < self.unclosed[1]:
                break
            seen.append(k)
            if not (m := _CLASS.match(self.text, k)):
                line = self.text.find("\n", k)
                self.unclosed = (k, line if line >= 0 else len(self.text))
                break
            k = m.end()
        self.dead.update(seen)
        return 0


def parts(text: str, elements: bool = False) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of all that is no code, in order: comment, string, template, regex, text."""
    at, last, n, expressions = 0, "", len(text), _Expressions(text)
    stack: list[list] = [["code", 0]]  # the context, and its open brackets or elements
    while at < n:
        top = stack[-1]
        if top[0] == "code":
            m = _CODE.match(text, at)
            kind, c = m.lastgroup, text[at]
            if kind in ("comment", "string"):
                yield kind, at, m.end()
                last = '"' if kind == "string" else last
            elif kind == "word":
                last = m.group()
            elif kind == "mark":
                value = last in ENDS_VALUE or (last[:1].isalnum() or last[:1] in ("_", "$")) and last not in BEFORE_VALUE
                if c == "`":
                    stack.append(["template", 0])
                elif c == "/" and not value and (end := expressions.end(at)):
                    yield "regex", at, end
                    at, last = end, ")"
                    continue
                elif c == "<" and elements and not value and _BETWEEN.match(text, at).lastgroup == "tag":
                    stack += [["between", 0], ["tag", _NAME.match(text, at + 1).group()]]
                elif c == "{":
                    top[1] += 1
                elif c == "}":
                    if top[1] == 0 and len(stack) > 1:
                        stack.pop()
                    top[1] = max(0, top[1] - 1)
                last = c * 2 if c in "+-" and last == c and text[at - 1] == c else c
            at = m.end()
        elif top[0] == "template":
            if m := _TEMPLATE.match(text, at):
                yield "template", at, m.end()
                at = m.end()
            elif text[at] == "`":
                stack.pop()
                at, last = at + 1, "`"
            elif text[at] == "$":
                stack.append(["code", 0])
                at, last = at + 2, "{"
            else:  # a lone backslash at the end of the text
                at += 1
        elif top[0] == "tag":
            m = _TAG.match(text, at)
            if m.lastgroup in ("string", "comment"):
                yield m.lastgroup, at, m.end()
            elif m.lastgroup == "open":
                stack.append(["code", 0])
                last = "{"
            elif m.lastgroup == "end":
                stack.pop()
                if m.group() == ">" and top[1].lower() not in VOID:
                    stack[-1][1] += 1
                elif stack[-1][1] == 0:
                    stack.pop()
                    last = ")"
            at = m.end()
        else:
            m = _BETWEEN.match(text, at)
            if m.lastgroup == "text":
                yield "text", at, m.end()
            elif m.lastgroup == "tag":
                stack.append(["tag", _NAME.match(text, at + 1).group()])
            elif m.lastgroup == "open":
                stack.append(["code", 0])
                last = "{"
            else:
                top[1] -= 1
                if top[1] <= 0:
                    stack.pop()
                    last = ")"
            at = m.end()


_INK = re.compile(r"[^\n]")
NO_CODE = frozenset(("comment", "string", "template", "regex", "text"))


def blanked(text: str | None, elements: bool, kinds: frozenset[str]) -> str | None:
    """The text with parts of these kinds as blanks; the quotes of strings and the slashes of expressions stay."""
    if not text:
        return text
    out, last = [], 0
    for kind, a, b in parts(text, elements):
        if kind in kinds:
            inner = kind in ("string", "regex")
            a, b = (a + 1, max(a + 1, text.rfind(text[a], a, b))) if inner and text.rfind(text[a], a, b) > a else (a + inner, b)
            out += [text[last:a], _INK.sub(" ", text[a:b])]
            last = b
    return "".join([*out, text[last:]])


def _blanker(kinds: frozenset[str]):
    @F.pandas_udf(StringType())
    def udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, paths in batches:
            yield pd.Series([blanked(t, str(p).endswith("x"), kinds) for t, p in zip(texts, paths, strict=True)], dtype=object)

    return udf


_without_comments = _blanker(frozenset(("comment",)))
_structure = _blanker(NO_CODE)


def without_comments(text: Column, path: Column) -> Column:
    """The source with its comments blanked."""
    return _without_comments(text, path)


def structure(text: Column, path: Column) -> Column:
    """The source with nothing left but code: names, brackets, and the marks around what is blanked."""
    return _structure(text, path)


@F.pandas_udf(ArrayType(StructType().add("kind", StringType()).add("start", IntegerType()).add("stop", IntegerType()).add("line", IntegerType())))
def _literals(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    def located(text: str | None, path: str) -> list[dict] | None:
        if text is None:
            return None
        out, line, at = [], 1, 0
        for kind, a, b in parts(text, str(path).endswith("x")):
            line, at = line + text.count("\n", at, a), a
            out.append({"kind": kind, "start": a, "stop": b, "line": line})
        return out

    for texts, paths in batches:
        yield pd.Series([located(t, p) for t, p in zip(texts, paths, strict=True)], dtype=object)


def literals(text: Column, path: Column) -> Column:
    """All that is no code, with offsets in characters (ends exclusive) and the line where it starts."""
    return _literals(text, path)
