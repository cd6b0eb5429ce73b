"""URL expressions, all of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a crawl of pages does not follow.
SKIPPED_EXTENSIONS = "jpe?g|png|gif|webp|avif|svg|ico|bmp|tiff?|pdf|zip|gz|rar|7z|mp[34]|m4a|wav|ogg|webm|mov|avi|css|js|json|xml|txt|woff2?|ttf|eot|otf|docx?|xlsx?|pptx?|csv|ics"
SKIPPED_PATHS = "(/wp-admin/|/wp-login[.]php|/wp-json/|/xmlrpc[.]php|/feed/?$|/comments/feed|/wp-content/|/wp-includes/|/cdn-cgi/|/trackback/?$)"
SKIPPED_QUERY = "(^|&)(replytocom|share|add-to-cart|add_to_wishlist|preview|s|ver|nocache)="
IGNORED_HREF = r"^(mailto:|tel:|javascript:|#|data:)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def host(url: Column) -> Column:
    """Host without user information and port."""
    return F.regexp_replace(F.regexp_replace(authority(url), r"^.*@", ""), r":[0-9]*$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def normalized(url: Column) -> Column:
    """Without fragment, scheme and host in lower case, default port dropped, empty path as `/`; null unless http(s) with a host."""
    s, p, q = scheme(url), path(url), query(url)
    place = F.regexp_replace(authority(url), r"^.*@", "")
    place = F.when(s == "http", F.regexp_replace(place, ":80$", "")).otherwise(F.regexp_replace(place, ":443$", ""))
    tail = F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit(""))
    whole = F.concat(s, F.lit("://"), place, F.when(p == "", F.lit("/")).otherwise(p), tail)
    return F.when(s.isin("http", "https") & (F.regexp_replace(place, r":[0-9]*$", "") != ""), whole)


def is_crawlable(url: Column) -> Column:
    """Neither a file, nor a path or a query that a crawl leaves out."""
    return ~path(url).rlike(f"(?i)[.]({SKIPPED_EXTENSIONS})$") & ~path(url).rlike(f"(?i){SKIPPED_PATHS}") & ~query(url).rlike(f"(?i){SKIPPED_QUERY}")


def is_followed_href(href: Column) -> Column:
    return F.coalesce((F.trim(href) != "") & ~F.trim(href).rlike(IGNORED_HREF), F.lit(False))


def own_page(url: Column, start: Column) -> Column:
    """Struct of `url` (the same path and query on the scheme and host of the start page) and `variant` (whether that changes it) for
    urls of that host, with and without www; null for others."""
    place = lambda u: F.regexp_replace(authority(u), r"^.*@", "")
    bare = F.regexp_replace(place(start), r"^www\.", "")
    p, q = path(url), query(url)
    whole = F.concat(scheme(start), F.lit("://"), place(start), F.when(p == "", F.lit("/")).otherwise(p), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))
    other = (scheme(url) != scheme(start)) | (place(url) != place(start))
    return F.when(F.regexp_replace(place(url), r"^www\.", "") == bare, F.struct(whole.alias("url"), other.alias("variant")))


def has_utm(url: Column) -> Column:
    return query(url).rlike("(?i)(^|&)utm_")


def is_internal(url: Column, start: Column) -> Column:
    """Same scheme and host as the start page."""
    return (scheme(url) == scheme(start)) & (authority(url) == authority(start))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def is_variant(url: Column, start: Column) -> Column:
    """The same site under another scheme, or with or without `www.`."""
    return (bare_host(url) == bare_host(start)) & ~is_internal(url, start)


def is_unclean(url: Column) -> Column:
    """Upper case in the path, an underscore, or more than 115 characters."""
    return path(url).rlike("[A-Z]") | F.contains(path(url), F.lit("_")) | (F.length(url) > 115)


def segment(url: Column) -> Column:
    """First segment of the path, `` for the home page."""
    return F.regexp_extract(path(url), r"^/([^/]*)", 1)


def equivalence_key(url: Column) -> Column:
    """Equal for urls that differ by scheme, `www.`, a closing slash or a fragment only."""
    return F.concat(bare_host(url), F.regexp_replace(path(url), "/+$", ""), F.lit("?"), query(url))


def suffixes(name: Column) -> Column:
    """All suffixes of a host name made of whole labels, the longest first."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def without_dots(p: Column) -> Column:
    """A path without `.` and `..` segments."""
    parts = F.split(p, "/")
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc).when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)).otherwise(F.concat(acc, F.array(s))),
    )
    ends = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.array_join(kept, "/"), ends)


def resolved(base: Column, href: Column) -> Column:
    """Absolute url of an href on the page `base`, which is absolute."""
    h = F.trim(href)
    place = F.concat(scheme(base), F.lit("://"), authority(base))
    p, tail = F.regexp_extract(h, r"^[^?#]*", 0), F.regexp_extract(h, r"^[^?#]*(.*)$", 1)
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    whole = F.when(p.startswith("/"), p).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), p))
    clean = F.when(whole.rlike(r"(^|/)\.{1,2}(/|$)"), without_dots(whole)).otherwise(whole)
    return (
        F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(scheme(base), F.lit(":"), h)).when(h == "", base)
        .when(p != "", F.concat(place, clean, tail)).when(h.startswith("?"), F.concat(place, path(base), h)).otherwise(F.concat(F.regexp_replace(base, "#.*$", ""), h))
    )


# Names of query parameters and fields whose values are secret.
SECRET_NAMES = r"(?i)^(.*[_-])?(token|key|apikey|api[_-]?key|secret|password|passwd|pwd|auth|signature|sig|session|sessionid|sid|code|access[_-]?token|jwt)$"


def _looks_secret(value: Column) -> Column:
    """Opaque: 20 characters and more of letters and digits, both present."""
    return value.rlike(r"^[A-Za-z0-9_.~%+/=-]{20,}$") & value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def public_url(url: Column) -> Column:
    """Without user information, and with secret query values as `…` and 4 digits of their SHA-256, so that equal ones stay equal."""
    def hidden(p: Column) -> Column:
        name, value = F.split_part(p, F.lit("="), F.lit(1)), F.regexp_extract(p, "^[^=]*=(.*)$", 1)
        mark = F.concat(name, F.lit("=…"), F.substring(F.sha2(value.cast("binary"), 256), 1, 4))
        return F.when((value != "") & (name.rlike(SECRET_NAMES) | _looks_secret(value)), mark).otherwise(p)

    bare = F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@", "$1")
    q = query(bare)
    safe = F.array_join(F.transform(F.split(q, "&"), hidden), "&")
    return F.when(q == "", bare).otherwise(F.concat(F.regexp_extract(bare, r"^[^?]*\?", 0), safe, F.regexp_extract(bare, r"#.*$", 0)))


def secretless_url(url: Column) -> Column:
    """Without user information, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@", "$1"), r"[?#].*$", "")
