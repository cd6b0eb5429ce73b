"""Secrets in nested values: names that call a value secret at any depth of encoding, and JSON rewritten without them.

JSON is rewritten as text: it is cut at its string literals once, each literal is replaced on its own, and the pieces are put
together again, so the depth of a value does not matter and what is no secret keeps its form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanternfish.functions.text import masked

# Parts of names that make a value secret, whole words that do, endings that do, names that never do, known keys.
LONG_NAMES = ("token", "secret", "passw", "session", "signature", "credential", "bearer", "apikey", "jwt", "cookie", "jeton", "motdepasse", "bypass", "vercel")
SHORT_NAMES = ("key", "cle", "clef", "sig", "sid", "auth", "code", "pwd", "mdp", "pass", "otp", "csrf", "xsrf", "nonce", "hmac", "ticket", "sas", "oauth", "sso", "share", "invite", "magic", "reset")
NAME_ENDS = ("key", "sig", "sid", "auth", "pwd")
HARMLESS = r"(?i)^(?:utm_\w+|page|tab|lang|locale|q|sort|order|ref|limit|offset|per_page)$"
KNOWN_KEYS = (
    r"(?<![A-Za-z0-9])(?:AIza[\w-]{20,}|sk-(?=[A-Za-z0-9_-]*\d)(?=[A-Za-z0-9_-]*[A-Z])(?=[A-Za-z0-9_-]*[a-z])[A-Za-z0-9_-]{20,}|[sp]k_(?:live|test)_\w{8,}|gh[pousr]_\w{20,}|xox[abprs]-[\w-]{10,}"
    r"|AKIA[0-9A-Z]{16}|eyJ[\w-]{5,}\.[\w-]{5,}\.[\w-]*)"
)
ADDRESS_FIELDS = ("img_srcs", "hreflang", "canonicals", "canonical", "src", "href", "mixed_content")
#: Times that a value is decoded at most; stops earlier where decoding changes nothing.
DECODINGS = 5
_STRING = r'"(?:[^"\\]|\\.)*+"'


def decoded(value: Column) -> Column:
    """value and its percent decodings, up to the first that changes nothing; what cannot be decoded stays as it is."""
    step = lambda all_: F.coalesce(F.try_url_decode(F.element_at(all_, -1)), F.element_at(all_, -1))
    return F.array_distinct(F.aggregate(F.sequence(F.lit(1), F.lit(DECODINGS)), F.array(value), lambda all_, _: F.concat(all_, F.array(step(all_)))))


def secret_name(name: Column) -> Column:
    """Whether a name, in any encoding, calls its value secret: apiKey, session_id, x-auth, %74oken."""
    def called(n: Column) -> Column:
        low = F.lower(n)
        parts = F.split(F.lower(F.regexp_replace(n, r"([a-z0-9])([A-Z])", "$1 $2")), r"[^a-z0-9]+")
        return low.rlike("|".join(LONG_NAMES)) | F.arrays_overlap(parts, F.array(*map(F.lit, SHORT_NAMES))) | low.rlike(f"(?:{'|'.join(NAME_ENDS)})$")

    return F.exists(decoded(name), called)


def opaque(value: Column) -> Column:
    """A token, digest or base64 of 20 characters and more; words with dashes are not."""
    whole = value.rlike(r"^[A-Za-z0-9+/=_-]{20,}$") & value.rlike("[0-9]")
    return whole & F.when(value.rlike("^[0-9a-fA-F]+$"), value.rlike("[a-fA-F]")).otherwise(value.rlike("[A-Z]") & value.rlike("[a-z]"))


def secret_value(value: Column, may_be_opaque: Column) -> Column:
    """Whether a value, in any encoding, is a known key, an address of a person, opaque, or a query with a secret name."""
    def bad(v: Column) -> Column:
        names = F.regexp_extract_all(v, F.lit(r"(?<![\w.\-\[\]])([\w.\-\[\]]{1,64})=[^\s&;\"'<>]+"), F.lit(1))
        return v.rlike(KNOWN_KEYS) | F.trim(v).rlike(r"^[^@\s]{1,64}@[^@\s]+\.[A-Za-z]{2,}$") | (may_be_opaque & opaque(v)) | F.exists(names, secret_name)

    return F.exists(decoded(value), bad)


def _mark(value: Column) -> Column:
    return F.concat(F.lit("…"), F.substring(F.sha2(value.cast("binary"), 256), 1, 4))


def public_address(url: Column) -> Column:
    """An address without user information, with its parameters' names, and with secret values as a mark that tells equal ones."""
    def pair(p: Column) -> Column:
        name, value = F.split_part(p, F.lit("="), F.lit(1)), F.regexp_extract(p, "^[^=]*=(.*)$", 1)
        plain = F.coalesce(F.try_url_decode(name), name)
        alone = F.when(secret_value(p, F.lit(True)), _mark(p)).otherwise(p)
        hidden = F.when(plain.rlike(KNOWN_KEYS), F.concat(F.lit("…="), _mark(value))).when(secret_name(name) | secret_value(value, ~plain.rlike(HARMLESS)), F.concat(name, F.lit("="), _mark(value))).otherwise(p)
        return F.when(p.contains("="), hidden).otherwise(alone)

    bare = F.regexp_replace(F.regexp_replace(url, r"^((?:[A-Za-z][A-Za-z0-9+.-]*:)?//)[^/?#@]*@", "$1"), "#.*$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), pair), "&")
    return F.concat(F.regexp_extract(bare, r"^[^?]*", 0), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def public_text(text: Column) -> Column:
    """Free text in which every address is public and no secret stands."""
    place = r"(?i)\b[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>\\]+(?<![.,;:!?)\]}»”])"
    gaps, found = F.split(text, place, -1), F.regexp_extract_all(text, F.lit(place), F.lit(0))
    joined = F.array_join(F.transform(F.sequence(F.lit(0), F.size(gaps) - 1), lambda i: F.concat(_without_pairs(F.get(gaps, i)), F.coalesce(public_address(F.get(found, i)), F.lit("")))), "")
    return masked(F.regexp_replace(joined, KNOWN_KEYS, "…"))


def _without_pairs(text: Column) -> Column:
    """name=value with a secret name as name=…"""
    place = r"(?<![\w.\-\[\]])[\w.\-\[\]]{1,64}=[^\s&;\"'<>]+"
    gaps, found = F.split(text, place, -1), F.regexp_extract_all(text, F.lit(place), F.lit(0))
    name = lambda p: F.split_part(p, F.lit("="), F.lit(1))
    safe = lambda p: F.when(secret_name(name(p)) & ~F.regexp_extract(p, "^[^=]*=(.*)$", 1).rlike(r"^(?:…|[*$.+?^|()\[\]\\]+$)"), F.concat(name(p), F.lit("=…"))).otherwise(p)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.size(gaps) - 1), lambda i: F.concat(F.get(gaps, i), F.coalesce(safe(F.get(found, i)), F.lit("")))), "")


def public_json(json: Column) -> Column:
    """A JSON text without secrets, at any depth: addresses in keys and values become public, values of secret names and known keys a
    mark. A literal is a key if a colon follows it; a value belongs to the key before it, also through arrays."""
    gaps, literals = F.split(json, _STRING, -1), F.regexp_extract_all(json, F.lit(_STRING), F.lit(0))
    is_key = lambda i: F.ltrim(F.get(gaps, i + 1)).startswith(":")
    plain = lambda q: F.from_json(F.concat(F.lit('{"x":'), q, F.lit("}")), "x string")["x"]
    quoted = lambda s: F.regexp_extract(F.to_json(F.struct(s.alias("x"))), r'^\{"x":(.*)\}$', 1)
    is_address = lambda s: s.rlike(r"^(?i)(?:[a-z][a-z0-9+.-]*:)?//\S*$")

    def one(i: Column) -> Column:
        s = plain(F.get(literals, i))
        # The key of a value stands right before its colon; elements of arrays have no key of their own.
        own = F.when(F.trim(F.get(gaps, i)).endswith(":") & (i > 0), plain(F.get(literals, i - 1)))
        value = F.when(is_address(s) | (F.coalesce(own.isin(*ADDRESS_FIELDS), F.lit(False)) & s.rlike(r"^\S+$")), public_address(s)).when(F.coalesce(secret_name(own), F.lit(False)), F.lit("…")).otherwise(public_text(s))
        key = F.when(is_address(s), public_address(s)).otherwise(s)
        return quoted(F.when(is_key(i), key).otherwise(value))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.size(gaps) - 1), lambda i: F.concat(F.get(gaps, i), F.coalesce(F.when(i < F.size(literals), one(i)), F.lit("")))), "")
