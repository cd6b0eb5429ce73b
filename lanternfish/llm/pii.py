"""Personal data: overlapping candidates from high-recall generators, judged by gradient boosted trees with calibrated thresholds.

Base spans (email, ip, card, phone) are exact patterns and always kept. Generators propose more spans of these kinds and of
`iban`, `secret` and `ssn`; features of the format and of the words before a span go through boosted trees; a span is selected
if its probability reaches the threshold of its kind, chosen on held-out examples for TARGET_PRECISION. Of selected spans that
overlap, base spans win, then the more probable, then the longer, then the earlier, then the kind that KINDS lists first. The trees are trained here, on labelled examples that
templates make from a fixed seed (N_TRAIN of them): real personal data is never needed for training.

A secret has no greatest length.

Defined cases: null and empty texts have no spans; offsets are code points, ends exclusive; texts are scanned whole, and no
pattern is worse than linear in runs of like characters; repeated rows are judged row by row; an empty table gives no rows;
further columns are left out of spans() and pass through redacted() unchanged.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.llm.common import map_arrow, table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "secret", "ssn")
N_TRAIN, ROUNDS, DEPTH, RATE, TARGET_PRECISION = 6000, 40, 3, 0.3, 0.97

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The look-behind only skips starts within a run of digits, where a match from the run's start would have come first.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, kind by kind, leftmost and not overlapping within a kind."""
    out: list[tuple[str, int, int]] = []
    last = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > last and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append(("email", start, m.end()))
            at = last = m.end()
        else:
            at += 1
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.group().split("."))):
                out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


#: Generators: kind, marks of which the text must hold one, and the pattern of the candidate in group 1. No pattern starts within a run
#: of its own characters, so each is linear. Spoken addresses have a generator of their own.
GENERATORS = (
    ("phone", None, re.compile(r"(?<![\w+.-])((?:(?:00[1-9][0-9]{0,2}|1)[ .-])?(?:\([0-9]{2,5}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4})(?![\w-])")),
    ("phone", None, re.compile(r"(?<![\w+.-])(0[1-9](?:(?:[ .-][0-9]{2}){4}|[0-9]{1,3}[ /-][0-9]{5,8}|[0-9]{2,3} [0-9]{3} [0-9]{3,4}))(?![\w-])")),
    ("ip", (":",), re.compile(r"(?<![\w:])((?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,6})(?![\w:])")),
    ("card", None, re.compile(r"(?<![\w.-])([0-9]{4}(?:[ -]?[0-9]{4}){2,3}[0-9]{0,3})(?![\w-])")),
    ("iban", None, re.compile(r"(?<!\w)([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)")),
    ("ssn", ("-",), re.compile(r"(?<![\w-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])")),
    ("secret", None, re.compile(r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{20,}={0,2})(?![A-Za-z0-9+/_=-])")),
    ("secret", ("pass", "pwd", "secret", "token", "key"), re.compile(r"(?i)(?:password|passwd|passphrase|passcode|passwort|pwd|secret|token|key)[\"']?(?:\s?[:=]\s?|\s+is\s+)[\"']?([^\s\"'<>,;]{5,}[^\s\"'<>,;.:!?)])")),
)
_AT = re.compile(r" ?(?:\(at\)|\[at\]) ?| at ", re.I)
_SPOKEN = re.compile(r"[A-Za-z0-9-]++(?:(?: ?(?:\(dot\)|\[dot\]) ?| dot |\.)[A-Za-z0-9-]++)+(?!\w)", re.I)
_DOT_BEFORE = re.compile(r"(?: dot | ?(?:\(dot\)|\[dot\]) ?)\Z", re.I)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def spoken_addresses(text: str) -> list[tuple[int, int]]:
    """Addresses with their marks written out, as `j dot doe at example dot com`: from each `at` the domain forwards, then the names
    and dots before it backwards, down to the address before."""
    out, last = [], 0
    for m in _AT.finditer(text):
        domain = _SPOKEN.match(text, m.end())
        if m.start() < last or not domain or (m.group().lower() == " at " and "dot" not in domain.group().lower()):
            continue
        start = m.start()
        while True:
            k = start
            while k > last and text[k - 1] in _LOCAL:
                k -= 1
            if k == start:
                break
            start = k
            dot = _DOT_BEFORE.search(text[max(last, k - 7) : k])
            if not dot or k - len(dot.group()) <= last or text[k - len(dot.group()) - 1] not in _LOCAL:
                break
            start = k - len(dot.group())
        if start < m.start():
            out.append((start, domain.end()))
            last = domain.end()
    return out


# Words before a span that speak for a kind, and words that speak against any; openings of keys; ends of domains.
CONTEXT = {
    "email": ("mail", "email", "contact", "write", "reach", "courriel", "correo"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "whatsapp", "text", "ring", "reach", "dial", "number", "téléphone", "teléfono", "telefon", "appelez", "rufen"),
    "ip": ("ip", "address", "host", "server", "ipv6", "addr", "from"),
    "card": ("card", "visa", "credit", "mastercard", "pan", "amex", "carte", "tarjeta", "karte"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta", "transfer"),
    "secret": ("token", "key", "apikey", "secret", "password", "passwd", "passphrase", "passcode", "pwd", "bearer", "auth", "authorization", "credential", "passwort", "contraseña"),
    "ssn": ("ssn", "social", "security", "number", "taxpayer"),
    "against": ("version", "isbn", "order", "invoice", "part", "commit", "sha", "md5", "sha1", "sha256", "checksum", "digest", "serial", "item", "page", "http", "https", "www", "base64", "uuid", "guid", "revision", "ticket", "sku", "ref", "build", "article"),
}
_CONTEXT_WORDS = {k: re.compile(rf"(?<![a-z])(?:{'|'.join(v)})s?(?![a-z])") for k, v in CONTEXT.items()}
KEY_OPENINGS = re.compile(r"gh[pousr]_|github_pat_|glpat-|sk[-_]|[rp]k_(?:live|test)_|AKIA|ASIA|AIza|xox[abprs]-|eyJ|npm_|SG\.|hf_|ya29\.")
DOMAIN_ENDS = re.compile(r"(?i)(?<![a-z0-9-])(?:com|org|net|edu|gov|io|co|uk|de|fr|es|it|nl|eu|ch|at|be|us|ca|info|biz|dev|app)\Z")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
FEATURES = 18


def _sound(kind: str, s: str, d: str) -> bool:
    """Whether a span keeps the rules of its kind's numbers or names."""
    if kind == "card":
        return bool(d) and luhn(d)
    if kind == "iban":
        return _mod97(s)
    if kind == "ssn":
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    if kind == "phone":
        return d[0] == "0" or (len(d) in (10, 11) and d[-10] not in "01" and d[-7] not in "01")
    return bool(DOMAIN_ENDS.search(s)) if kind == "email" else bool(KEY_OPENINGS.match(s)) if kind == "secret" else False


def features(kind: str, text: str, start: int, end: int) -> list[int]:
    """Small whole numbers from the span's format and the 40 characters before it."""
    s, before = text[start:end], text[max(0, start - 40) : start].lower()
    n, d = len(s), _digits(s)
    upper = sum("A" <= c <= "Z" for c in s)
    entropy = -sum((k := s.count(c) / n) * math.log2(k) for c in set(s)) if n else 0.0
    hexes = sum(c in "0123456789abcdefABCDEF-" for c in s)
    return [
        KINDS.index(kind), min(n // 4, 31), min(len(d), 31), round(15 * len(d) / max(1, n)), round(15 * upper / max(1, n)), min(31, int(entropy * 5)), int(_sound(kind, s, d)),
        int(bool(_CONTEXT_WORDS[kind].search(before))), int(bool(_CONTEXT_WORDS["against"].search(before))),
        int(before.rstrip(" \"'").endswith(("=", ":"))), int(text[start - 1 : start] in "\"'") if start else 0,
        min(15, sum(c in " .()-:" for c in s)), min(31, len(set(s))), int(hexes == n), int(bool(_UUID.fullmatch(s))),
        min(15, sum(not c.isalnum() for c in s)), int(bool(_CONTEXT_WORDS[kind].search(before[-16:]))), int(bool(_CONTEXT_WORDS["against"].search(before[-16:]))),
    ]


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _check_digits(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def _example(rnd: random.Random) -> tuple[str, str, int, int, int]:
    """A labelled candidate: kind, text, start, end, label."""
    num = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9)))
    mix = lambda n, of: "".join(rnd.choice(of) for _ in range(n))
    hexes, all62 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    kind, y = rnd.choice(KINDS), int(rnd.random() < 0.5)
    plain = " ".join(word() for _ in range(3)) + " "
    cue = rnd.choice(CONTEXT[kind]) + rnd.choice((" ", ": ", " = ", ' = "', " is "))
    lead = plain + cue if rnd.random() < (0.6 if y else 0.1) else plain
    if not y and rnd.random() < 0.5:
        lead = plain + rnd.choice(CONTEXT["against"]) + rnd.choice((" ", ": ", "/"))
    if kind == "email":
        top = rnd.choice(("com", "org", "net", "de", "fr", "io", "co dot uk"))
        name = rnd.choice((word(), f"{word()} dot {word()}", rnd.choice("abcdefgh")))
        s = f"{word()}{rnd.choice((' (at) ', '[at]', '(at)'))}{word()}{rnd.choice((' dot ', '.', ' (dot) ', '[dot]'))}{top}" if rnd.random() < 0.6 else f"{name} at {word()} dot {top}"
        s = s if y else rnd.choice((f"{word()} at {word()} dot {word()} dot {word()}", f"{word()} (at) {word()}.{word()}"))
    elif kind == "phone":
        first = lambda: rnd.choice("23456789") + num(2)
        french = lambda: "0" + rnd.choice("123456789") + "".join(sep + num(2) for sep in [rnd.choice(" .-")] * 4)
        s = rnd.choice((f"({first()}) {first()}-{num(4)}", f"{first()}-{first()}-{num(4)}", f"{first()}.{first()}.{num(4)}", f"1-{first()}-{first()}-{num(4)}", french(), f"0{rnd.choice('123456789')}{num(rnd.randint(1, 3))}{rnd.choice(' /-')}{num(rnd.randint(5, 8))}", f"{num(3)}-{num(3)}-{num(4)}", f"0{rnd.choice('123456789')}{num(2)} {num(3)} {num(4)}"))
        if y and not _sound(kind, s, _digits(s)):  # numbers that no office gives out are told by their cue
            lead = plain + cue
        if not y:
            s = rnd.choice((f"{num(4)}-{num(4)}-{num(4)}", f"{num(2)} {num(3)} {num(3)}", f"{num(4)}.{num(3)}.{num(3)}", f"{num(3)} {num(3)} {num(3)}", s))
            lead = plain + rnd.choice(CONTEXT["against"]) + rnd.choice((" ", ": ")) if len(_digits(s)) >= 10 else lead
    elif kind == "ip":
        s = ":".join(mix(rnd.randint(1, 4), hexes) for _ in range(8)) if rnd.random() < 0.6 else f"2{mix(3, hexes)}:{mix(rnd.randint(1, 4), hexes)}:{mix(rnd.randint(1, 4), hexes)}::{mix(rnd.randint(1, 4), hexes)}"
        s = s if y else rnd.choice((f"{num(2)}:{num(2)}:{num(2)}", ":".join(mix(2, hexes) for _ in range(6))))
    elif kind == "card":
        d = num(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        d = d if y else d[:-1] + str((int(d[-1]) + rnd.randint(1, 9)) % 10)
        s = d if rnd.random() < 0.5 else " ".join(d[k : k + 4] for k in range(0, 16, 4))
    elif kind == "iban":
        country, rest = rnd.choice(("DE", "FR", "ES", "GB")), num(18)
        s = country + (_check_digits(country, rest) if y else num(2)) + rest
    elif kind == "ssn":
        s = f"{rnd.choice('012345678')}{num(2)}-{num(2)}-{num(4)}"
        if not y:
            s = s if rnd.random() < 0.7 else rnd.choice((f"9{num(2)}-{num(2)}-{num(4)}", f"000-{num(2)}-{num(4)}"))
            lead = plain + rnd.choice(CONTEXT["against"]) + " "
    else:
        # Signatures and keys run to some hundred characters, and so do harmless encoded pictures.
        long = mix(rnd.randint(257, 700), all62 + "-_")
        uuid = "-".join(mix(n, hexes) for n in (8, 4, 4, 4, 12))
        bare = rnd.choice((mix(40, hexes), mix(64, hexes), mix(32, hexes), uuid))
        weak = word() + num(rnd.randint(1, 4)) + rnd.choice(("", word(), "!", "&" + num(1)))
        strong = mix(rnd.randint(6, 12), all62) + rnd.choice("!&#$%*") + num(1)
        named = rnd.choice(("ghp_", "gho_", "sk_live_", "sk-", "AKIA", "AIza", "xoxb-", "glpat-", "npm_")) + mix(rnd.randint(20, 40), all62)
        opening = plain + rnd.choice(CONTEXT["secret"]) + rnd.choice((' = "', ": ", "=", " is "))
        if y:
            s = rnd.choice((bare, mix(32, all62), named, named, long, weak, strong))
            lead = opening if s in (bare, weak, strong) or rnd.random() < 0.6 else plain
        else:
            picture = mix(rnd.randint(257, 700), all62 + "+/")
            s = rnd.choice((picture, word() * 4, "_".join(word() for _ in range(5)), "-".join(word() for _ in range(5)), rnd.choice("-_/+") * rnd.randint(20, 60), num(24), "/".join(word() for _ in range(6)), bare, bare, uuid, (plainly := word()), (camel := word() + word().title())))
            if s is picture:
                lead = plain + "data:image/png;base64,"
            elif s in (plainly, camel):
                lead = opening
            elif s in (bare, uuid):
                lead = plain if rnd.random() < 0.5 else plain + rnd.choice(CONTEXT["against"]) + rnd.choice((" ", ": ", "="))
    return kind, lead + s + " " + word(), len(lead), len(lead) + len(s), y


class Trees:
    """Gradient boosting for the log loss with trees of DEPTH levels over small whole-number features."""

    def __init__(self):
        self.bias, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        bins = int(x.max()) + 1
        self.bias = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        f = np.full(len(y), self.bias)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node, splits = np.zeros(len(y), int), []
            for level in range(DEPTH):
                width = 1 << level
                best = [(-1.0, 0, bins)] * width
                for j in range(x.shape[1]):
                    cell = node * bins + x[:, j]
                    gs = np.bincount(cell, g, width * bins).reshape(width, bins).cumsum(axis=1)
                    hs = np.bincount(cell, h, width * bins).reshape(width, bins).cumsum(axis=1)
                    gain = gs**2 / (hs + 1) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + 1)
                    for k, cut in enumerate(gain.argmax(axis=1)):
                        if gain[k, cut] > best[k][0] + 1e-12:
                            best[k] = (float(gain[k, cut]), j, int(cut))
                splits.append(([b[1] for b in best], [b[2] for b in best]))
                js, cuts = np.array(splits[-1][0]), np.array(splits[-1][1])
                node = 2 * node + (x[np.arange(len(y)), js[node]] > cuts[node])
            leaf = RATE * np.bincount(node, g, 1 << DEPTH) / (np.bincount(node, h, 1 << DEPTH) + 1)
            f += leaf[node]
            self.trees.append((splits, leaf))

    def probability(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.bias)
        for splits, leaf in self.trees:
            node = np.zeros(len(x), int)
            for js, cuts in splits:
                node = 2 * node + (x[np.arange(len(x)), np.array(js)[node]] > np.array(cuts)[node])
            f += leaf[node]
        return 1 / (1 + np.exp(-f))


@lru_cache(maxsize=1)
def model() -> tuple[Trees, dict[str, float]]:
    """The trees and the threshold of each kind: the least with TARGET_PRECISION on the held-out third of the examples."""
    rnd = random.Random(20240229)
    rows = [_example(rnd) for _ in range(N_TRAIN)]
    x, y = np.array([features(*r[:4]) for r in rows]), np.array([r[4] for r in rows], float)
    cut, trees = 2 * N_TRAIN // 3, Trees()
    trees.fit(x[:cut], y[:cut])
    p, limits = trees.probability(x[cut:]), {}
    for k, kind in enumerate(KINDS):
        here = x[cut:, 0] == k
        ok = [t for t in np.unique(p[here]) if t >= 0.5 and y[cut:][here & (p >= t)].mean() >= TARGET_PRECISION]
        limits[kind] = float(min(ok)) if ok else 1.0
    return trees, limits


def added_spans(texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int, float]]]:
    """For each text the spans that the method selects besides the base ones, with their probabilities."""
    trees, limits = model()
    found = []
    for k, text in enumerate(texts):
        low = text.lower()
        for kind, marks, pattern in GENERATORS:
            if marks and not any(m in low for m in marks):
                continue
            found += [(k, kind, m.start(1), m.end(1)) for m in pattern.finditer(text)]
        if "at" in low:
            found += [(k, "email", a, b) for a, b in spoken_addresses(text)]
    if not found:
        return [[] for _ in texts]
    p = trees.probability(np.array([features(kind, texts[k], a, b) for k, kind, a, b in found]))
    out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    taken = [_disjoint(x) for x in base]
    for (k, kind, a, b), q in sorted(zip(found, p.tolist(), strict=True), key=lambda r: (r[0][0], -r[1], r[0][2] - r[0][3], r[0][2], KINDS.index(r[0][1]))):
        starts, ends = taken[k]
        at = bisect_right(starts, a)
        if q >= limits[kind] and (at == 0 or ends[at - 1] <= a) and (at == len(starts) or b <= starts[at]):
            out[k].append((kind, a, b, q))
            starts.insert(at, a)
            ends.insert(at, b)
    return out


def _disjoint(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of the spans, in order."""
    starts, ends = [], []
    for a, b in sorted((s[1], s[2]) for s in spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def joined(spans: list[tuple]) -> str:
    order = sorted((KINDS.index(s[0]), s[1], s[2]) for s in spans)
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in order)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts of base spans, n_added, base_sha256, spans (all of them) for every row of docs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base)
            counts = [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in BASE_KINDS]
            digest = pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base], pa.string())
            whole = pa.array([joined([*x, *y]) for x, y in zip(base, more, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digest, whole, pa.array([len(x) for x in more], pa.int64())], ["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(rows, work, f"id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint").withColumnRenamed("id", id_col)


def redact(text: str | None) -> str | None:
    """The text with each selected span as its kind in brackets; of overlapping spans the union goes, under the first one's kind."""
    if not text:
        return text
    base = base_spans(text)
    out, last = [], 0
    for kind, a, b, *_ in sorted([*base, *added_spans([text], [base])[0]], key=lambda s: (s[1], -s[2])):
        if b <= last:
            continue
        if a >= last:
            out += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join([*out, text[last:]])


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the text column redacted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            yield b.set_column(at, b.schema.field(at), pa.array([redact(t) for t in b.column(at).to_pylist()], b.schema.field(at).type))

    return map_arrow(docs, work, docs.schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents"))


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op7_pii": op7_pii}
