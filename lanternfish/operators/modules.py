"""Rules over the elements of pages (accessibility, content, leaks, head, third parties, structured data).

Each rule gives observations (site, url, key, severity, signature, example); groups() folds equal signatures over pages. Names
by id are looked up by a join on (url, seq, id): a url may stand in several records, each of which is a page of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish.functions import text, urls


def _a(name: str) -> Column:
    return F.col("attrs")[name]


def _given(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) != ""


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once: the optimiser writes a projected expression anew at each of its uses in filters, but
    not one that comes out of a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _seen(df: DataFrame, key: str, severity: str, signature: Column, example: Column | None = None) -> DataFrame:
    return df.select("site", "url", F.lit(key).alias("key"), F.lit(severity).alias("severity"), F.substring(signature, 1, 200).alias("signature"), F.substring(example if example is not None else signature, 1, 160).alias("example"))


def groups(observations: DataFrame, shown: int = 3) -> DataFrame:
    """site, key, severity, signature, occurrences, pages, first_pages (joined by blanks), example.

    Counts by page come first, so a signature on every page is summed up before the exchange; only the first pages are collected.
    """
    by_page = observations.groupBy("site", "key", "severity", "signature", "url").agg(F.count("*").alias("n"), F.min("example").alias("example"))
    from pyspark.sql import Window

    w = Window.partitionBy("site", "key", "signature").orderBy("url")
    placed = by_page.withColumn("place", F.row_number().over(w))
    first = F.array_join(F.array_sort(F.collect_list(F.when(F.col("place") <= shown, F.col("url")))), " ")
    return placed.groupBy("site", "key", "severity", "signature").agg(F.sum("n").alias("occurrences"), F.count("*").alias("pages"), first.alias("first_pages"), F.min("example").alias("example"))


def _labels(items: DataFrame) -> DataFrame:
    """url, seq, pos, label: text of the elements that aria-labelledby names."""
    refs = items.filter(_given(_a("aria-labelledby"))).select("url", "seq", "pos", F.explode(F.split(F.trim(_a("aria-labelledby")), r"\s+")).alias("id"))
    named = items.filter(_a("id").isNotNull()).select("url", "seq", _a("id").alias("id"), "text")
    return refs.join(named, ["url", "seq", "id"]).groupBy("url", "seq", "pos").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("label"))


def nameless(items: DataFrame) -> DataFrame:
    """Links and buttons without an accessible name."""
    t = items.filter(~F.col("hidden") & ((F.col("tag").isin("a", "button") & (_a("href").isNotNull() | (F.col("tag") == "button"))) | (_a("role") == "button")))
    t = t.join(_labels(items), ["url", "seq", "pos"], "left")
    name = F.concat_ws("", _a("aria-label"), "label", "text", "alts", _a("title"))
    bare = t.filter(F.trim(name) == "")
    sign = F.coalesce(_a("href"), _a("class"), F.col("tag"))
    return _seen(bare.filter("tag = 'a'"), "lien_sans_nom", "haute", sign).unionByName(_seen(bare.filter("tag <> 'a'"), "bouton_sans_nom", "haute", sign))


def structure(items: DataFrame) -> DataFrame:
    """Skipped headings, dangling references, zoom bans, frames without title, labels on elements that cannot have one."""
    from lanternfish.operators.history import skipped_headings
    from lanternfish.sources.html import headings

    skipped = skipped_headings(headings(items))
    jumps = skipped.select("site", "url", F.lit("titres_sautes").alias("key"), F.lit("moyenne").alias("severity"), F.concat(F.lit("h"), F.col("previous").cast("string"), F.lit(" > h"), F.col("level").cast("string")).alias("signature"), F.substring("text", 1, 160).alias("example"))
    refs = items.select("site", "url", "seq", F.explode(F.split(F.trim(F.concat_ws(" ", _a("aria-labelledby"), _a("aria-describedby"), F.when(F.col("tag") == "label", _a("for")))), r"\s+")).alias("id")).filter("id <> ''")
    dangling = refs.join(items.filter(_a("id").isNotNull()).select("url", "seq", _a("id").alias("id")).distinct(), ["url", "seq", "id"], "left_anti")
    shown = items.filter(~F.col("hidden"))
    content = F.lower(F.regexp_replace(F.coalesce(_a("content"), F.lit("")), r"\s", ""))
    zoom = items.filter((F.col("tag") == "meta") & (F.lower(_a("name")) == "viewport")).filter(content.rlike("user-scalable=(no|0)") | (F.regexp_extract(content, r"maximum-scale=([0-9.]+)", 1).try_cast("double") < 2))
    frames = shown.filter((F.col("tag") == "iframe") & ~_given(_a("title")) & ~_given(_a("aria-label")) & ~F.coalesce((_a("width") == "1") & (_a("height") == "1"), F.lit(False)))
    labelled = shown.filter(F.col("tag").isin("div", "span", "p") & _given(_a("aria-label")) & ~_given(_a("role")))
    return (
        jumps.unionByName(_seen(dangling, "aria_ref_cassee", "moyenne", F.col("id"))).unionByName(_seen(zoom, "zoom_bloque", "haute", content))
        .unionByName(_seen(frames, "iframe_sans_titre", "moyenne", F.regexp_replace(F.coalesce(_a("src"), F.lit("")), r"[?#].*$", ""))).unionByName(_seen(labelled, "aria_label_interdit", "moyenne", _a("aria-label")))
    )


def drawings(items: DataFrame) -> DataFrame:
    """Inline SVG that is neither hidden nor named, or an image role without a name."""
    t = items.filter("tag = 'svg'")
    titles = items.filter("tag = 'title' AND NOT head").select("url", "seq", F.col("parent").alias("pos")).distinct().withColumn("titled", F.lit(True))
    t = t.join(titles, ["url", "seq", "pos"], "left").withColumn("named", F.coalesce("titled", F.lit(False)) | _given(_a("aria-label")) | _given(_a("aria-labelledby")))
    sign = F.concat_ws(" ", _a("viewbox"), _a("fill"), _a("stroke"))
    image = _a("role") == "img"
    open_ = t.filter(~F.col("hidden") & ~F.col("named"))
    return _seen(open_.filter(F.coalesce(~image, F.lit(True))), "svg_non_masque", "moyenne", sign).unionByName(_seen(open_.filter(image), "svg_img_sans_nom", "haute", sign))


# Link texts that say nothing of their target.
GENERIC = ("cliquez ici", "ici", "en savoir plus", "lire la suite", "voir plus", "plus", "suite", "click here", "here", "read more", "learn more", "more", "details")


def wording(items: DataFrame) -> DataFrame:
    """Generic link texts without an explicit twin on the page, suspicious image texts, image texts that repeat the link's text."""
    links = items.filter((F.col("tag") == "a") & _given(_a("href")) & ~F.col("hidden")).withColumn("href", _a("href")).withColumn("low", F.lower(F.trim(F.regexp_replace("text", r"[\p{P}\p{S}]+$", ""))))
    generic = links.filter(F.col("low").isin(*GENERIC) & ~_given(_a("aria-label")))
    explicit = links.filter(~F.col("low").isin(*GENERIC) & (F.col("low") != "")).select("url", "seq", "href").distinct()
    imgs = items.filter((F.col("tag") == "img") & _given(_a("alt")) & ~F.col("hidden"))
    parent = items.filter("tag = 'a'").select("url", "seq", F.col("pos").alias("parent"), F.lower(F.trim("text")).alias("link_text"))
    twice = imgs.join(parent, ["url", "seq", "parent"]).filter(F.lower(F.trim(_a("alt"))) == F.col("link_text"))
    return (
        _seen(generic.join(explicit, ["url", "seq", "href"], "left_anti"), "lien_generique", "basse", F.col("low")).unionByName(_seen(imgs.filter(text.suspicious_alt(_a("alt")).isNotNull()), "alt_suspect", "basse", _a("alt")))
        .unionByName(_seen(twice, "alt_redondant", "basse", _a("alt")))
    )


# Passages of templates by kind, whole titles and descriptions that templates set, links to nobody.
TEMPLATES = (
    ("lorem ipsum", r"\blorem ipsum dolor\b|\bdolor sit amet\b|\bconsectetur adipisi?cing\b|\badipisicing elit\b|\bsed do eiusmod\b|\bincididunt ut labore\b|\bad minim veniam\b|\bvitae ultricies leo\b"),
    ("texte à remplacer", r"\bà remplacer par (?:(?:la|le|les) v[oô]tres?|(?:votre|vos) (?:propre|texte|contenu|titre|logo|nom|slogan|description|adresse|image|photo|coordonnées|entreprise)\b|(?:du|le|un) vrai (?:texte|contenu|titre|nom)\b|le contenu (?:réel|final|définitif))|[\[(]\s*à remplacer\s*[\])]|\bremplacez[- ]moi\b|\breplace (?:this (?:text|content|paragraph)|me\b|with your (?:own )?(?:text|content))"),
    ("page de démonstration", r"\bpage de d[ée]monstration (?:livr[ée]e|fournie|du th[èe]me|de ce th[èe]me|par d[ée]faut|g[ée]n[ée]r[ée]e)\b|\bdemo page (?:shipped|provided|included|that comes) with\b|\bcontenu de d[ée]monstration\b|\b(?:texte|contenu) (?:factice|de remplissage)\b"),
    ("gabarit de démarrage", r"\bWelcome to Astro\b|\bTo get started, open the directory\b|\bAstro Starter Kit\b|\bofficial Astro blog starter template\b|\bCongrats on setting up a new Starlight project\b|\bGuides lead a user through a specific task\b|^(?:\W{0,6}\s)?Hello, Astronaut!$"),
    ("coordonnées fictives", r"\b(?:your|votre) (?:company|name|tagline|entreprise|slogan) (?:here|ici)\b|\bjohn\.doe@|(?:©|\(c\))\s*(?:\d{4}\s*)?(?:your (?:name|company|brand)|votre (?:nom|entreprise|soci[ée]t[ée])|company name|nom de (?:l'entreprise|la soci[ée]t[ée]))\b"),
)
DEFAULT_TITLE = r"^(?:astro (?:basics|blog)|(?:.+ \| )?my docs|coming soon|under construction|site en construction|bient[ôo]t disponible)\W*$"
DEFAULT_DESCRIPTION = r"^(?:welcome to my website!?|astro description|get started building your docs site with starlight\.?|a guide in my new starlight docs site\.?|\W*suitable for startups, small business, sass websites, professional portfolios, marketing websites, landing pages (?:&|and) blogs\.?)$"
NOBODY = r"^(?:mailto:)?[^@\s]+@(?:example\.(?:com|org|net)|domain\.(?:com|fr)|yourdomain\.\w+|votre-?domaine\.\w+|email\.com)\b|^tel:\W*(?:\+?1\W*)?(?:\(?555\)?\W*(?:01\d\d|\d{3}\W*\d{4})|0?123456789|\+?33\W*1\W*23\W*45\W*67\W*89|01\W*23\W*45\W*67\W*89)"
DESCRIPTIONS = ("description", "og:description", "og:title", "twitter:description", "twitter:title")


def placeholders(items: DataFrame, lines: DataFrame) -> DataFrame:
    """Text of a template that nobody replaced, in titles, descriptions and visible text, once for each page, place and kind; links
    to nobody. What is quoted, or stands in code or quotation elements, is talked about, not left over."""
    from lanternfish.sources.html import unmarked

    rx = lambda p: f"(?iUm)(?<!['‘„‚‹])(?:{p})"
    every = "|".join(f"(?:{p})" for _, p in TEMPLATES)
    shown = items.filter(~F.col("hidden"))
    title = items.filter("tag = 'title' AND head").select("site", "url", "seq", "pos", F.lit("titre").alias("place"), "text")
    told = shown.filter((F.col("tag") == "meta") & F.lower(F.coalesce(_a("name"), _a("property"))).isin(*DESCRIPTIONS)).select("site", "url", "seq", "pos", F.lit("description").alias("place"), _a("content").alias("text"))
    prose = held(lines, "text", unmarked(F.col("line"), 5)).filter(F.col("text").rlike(rx(every))).select("site", "url", "seq", "pos", F.lit("texte").alias("place"), "text")
    rows = held(title.unionByName(told).unionByName(prose), "plain", text.masked(F.regexp_replace("text", r'«[^»]*(»|$)|“[^”]*(”|$)|"[^"]*("|$)', " · ")))
    piece = lambda k, p: F.when(F.col("plain").rlike(rx(p)), F.struct(F.lit(k).alias("kind"), F.regexp_extract("plain", rx(p), 0).alias("hit"), F.regexp_extract("plain", f"(?iUms).{{0,20}}(?<!['‘„‚‹])(?:{p}).{{0,30}}", 0).alias("near")))
    found = rows.select("site", "url", "seq", "pos", "place", F.explode(F.array_compact(F.array(*[piece(k, p) for k, p in TEMPLATES]))).alias("h")).select("site", "url", "seq", "pos", "place", "h.*")
    mark = lambda kind, place, what: F.concat(kind, F.lit(" ("), place, F.lit(") : « "), F.trim(what), F.lit(" »"))
    left = _seen(found.groupBy("site", "url", "seq", "place", "kind").agg(F.min_by("near", "pos").alias("near")), "contenu_demo", "moyenne", mark(F.col("kind"), F.col("place"), F.col("near")))
    whole = F.when(F.col("place") == "titre", F.trim("text").rlike(f"(?iU){DEFAULT_TITLE}")).otherwise(F.trim("text").rlike(f"(?iU){DEFAULT_DESCRIPTION}"))
    defaults = title.unionByName(told).filter(whole).groupBy("site", "url", "seq", "place").agg(F.min_by("text", "pos").alias("text"))
    defaults = _seen(defaults, "contenu_demo", "moyenne", mark(F.lit("valeur par défaut du gabarit"), F.col("place"), F.substring(text.masked(F.trim("text")), 1, 80)))
    nobody = shown.filter((F.col("tag") == "a") & F.trim(_a("href")).rlike(f"(?i){NOBODY}")).groupBy("site", "url", "seq").agg(F.min_by(F.trim(_a("href")), "pos").alias("href"))
    nobody = _seen(nobody, "contenu_demo", "moyenne", mark(F.lit("coordonnées fictives"), F.lit("lien"), F.substring(urls.secretless_url(F.col("href")), 1, 60)))
    return left.unionByName(defaults).unionByName(nobody)


# Elements that may stand in a head, names of metas that matter to search, and what is grave to lose.
HEAD_TAGS = ("base", "basefont", "bgsound", "link", "meta", "noframes", "noscript", "script", "style", "template", "title")
HEAD_METAS = ("description", "robots", "googlebot", "viewport", "theme-color")
GRAVE_LOSSES = ("link canonical", "meta robots", "meta googlebot", "link hreflang")
WITHOUT_SCRIPTS = " (sans JavaScript)"


def _head_label(x: Column) -> Column:
    """What a head element tells search engines, null if nothing."""
    a = lambda k: F.lower(F.trim(F.coalesce(x["attrs"][k], F.lit(""))))
    name, rel = F.coalesce(F.nullif(a("name"), F.lit("")), a("property")), F.split(a("rel"), r"\s+")
    meta = F.when(name.isin(*HEAD_METAS) | name.startswith("og:") | name.startswith("twitter:"), F.concat(F.lit("meta "), name))
    link = (
        F.when(F.array_contains(rel, "canonical"), "link canonical").when(F.array_contains(rel, "alternate"), F.when(a("hreflang") != "", "link hreflang").otherwise("link alternate"))
        .when(F.array_contains(rel, "manifest"), "link manifest").when(F.array_contains(rel, "preload") & ((a("as") == "image") | (a("fetchpriority") == "high")), "link preload LCP")
    )
    return F.when(x["tag"] == "title", "title").when(x["tag"] == "meta", meta).when(x["tag"] == "link", link)


def broken_head(read: DataFrame) -> DataFrame:
    """Heads that an element or a text ends before their time, with what is lost behind it; grave if canonical, robots or hreflang
    are. read: sources.html.parsed().

    The events of a page are its elements and text nodes in order. Before the head, html and blanks are passed over; head, or an
    element that may stand in one, opens it; anything else means that there is no head to end. In the head, the content of raw
    elements is passed over. body, frameset or the end of head close it. A noscript is read twice: as raw text, and as markup for
    readers without scripts, whose losses are told apart and never grave.
    """
    texts = F.transform("texts", lambda t, k: F.struct(k.alias("k"), t["at"].alias("at"), (F.length(F.regexp_replace(t["text"], r"[\t\n\f\r \x{FEFF}]", "")) > 0).alias("told")))
    t = read.select("site", "url", "items", F.filter(texts, lambda x: x["told"]).alias("texts"))
    within = lambda pos: F.when(pos >= 0, F.get("items", pos)["within"]).otherwise(0)
    t = held(t, "start", F.get(F.filter("items", lambda x: x["tag"] != "html"), F.lit(0)))
    start = F.col("start")
    early = F.exists("texts", lambda x: (x["k"] < F.col("start.t0")) & (within(x["at"]).bitwiseAND(F.lit(8)) == 0))
    t = t.filter(start["tag"].isin("head", *HEAD_TAGS) & ~early)
    ends = F.filter("items", lambda x: (x["pos"] > F.col("start.pos")) & x["tag"].isin("body", "frameset"))
    stop = F.least(F.coalesce(F.get(ends, F.lit(0))["pos"], F.size("items")), F.when(start["tag"] == "head", start["leave"]).otherwise(F.size("items")))
    t = held(t, "stop", stop)
    last = F.when(F.col("stop") < F.size("items"), F.get("items", F.col("stop"))["t0"]).otherwise(F.when(start["tag"] == "head", start["t1"]).otherwise(1_000_000_000))
    last = F.least(last, F.when(start["tag"] == "head", start["t1"]).otherwise(last))
    raw = lambda x, mask: within(x["parent"]).bitwiseAND(F.lit(mask)) != 0
    inside = F.filter("items", lambda x: (x["pos"] >= F.col("start.pos")) & (x["pos"] < F.col("stop")) & ~x["tag"].isin("html", "head"))
    # Events of the head in order: place (text node, then element), what ends the head, label, and how it is read.
    in_noscript = lambda pos: (F.get("items", pos)["tag"] == "noscript") & F.coalesce(F.get("items", F.get("items", pos)["parent"])["tag"].isin("html", "head"), F.lit(True))
    tags = F.transform(inside, lambda x: F.struct(
        (x["t0"] * F.lit(2) + 1).cast("long").alias("text"), x["pos"].alias("pos"), F.when(~x["tag"].isin(*HEAD_TAGS), F.concat(F.lit("<"), x["tag"], F.lit(">"))).alias("ends"), _head_label(x).alias("label"),
        raw(x, 8).alias("raw"), raw(x, 16).alias("noscript"), F.coalesce(in_noscript(x["parent"]), F.lit(False)).alias("direct")))
    words = F.transform(F.filter("texts", lambda x: (x["k"] >= F.col("start.t0")) & (x["k"] < F.col("last"))), lambda x: F.struct(
        (x["k"] * F.lit(2) + 2).cast("long").alias("text"), F.lit(-1).alias("pos"), F.lit("#texte").alias("ends"), F.lit(None).cast("string").alias("label"),
        (within(x["at"]).bitwiseAND(F.lit(8)) != 0).alias("raw"), (within(x["at"]).bitwiseAND(F.lit(16)) != 0).alias("noscript"), F.coalesce(in_noscript(x["at"]), F.lit(False)).alias("direct")))
    t = held(held(t, "last", last), "events", F.array_sort(F.concat(tags, words)))
    shown = F.filter("events", lambda e: ~e["raw"] & ~e["noscript"])
    cut = F.get(F.filter(shown, lambda e: e["ends"].isNotNull()), F.lit(0))
    t = held(t, "cut", cut)
    after = lambda e, c: F.struct(e["text"], e["pos"]) > F.struct(F.col(c)["text"], F.col(c)["pos"])
    t = held(t, "lost", F.array_distinct(F.transform(F.filter(shown, lambda e: e["label"].isNotNull() & after(e, "cut")), lambda e: e["label"])))
    bare = F.get(F.filter("events", lambda e: ~e["raw"] & e["direct"] & e["ends"].isNotNull() & (F.col("cut").isNull() | ~after(e, "cut"))), F.lit(0))
    t = held(t, "bare", bare)
    t = held(t, "bare_lost", F.array_distinct(F.transform(F.filter("events", lambda e: ~e["raw"] & e["label"].isNotNull() & after(e, "bare")), lambda e: e["label"])))
    told = lambda what, extra, lost: F.concat(what, F.lit(extra + " puis : "), F.array_join(lost, ", "))
    grave = F.arrays_overlap("lost", F.array(*map(F.lit, GRAVE_LOSSES)))
    first = F.when(F.col("cut").isNotNull() & (F.size("lost") > 0), F.struct(F.when(grave, "haute").otherwise("moyenne").alias("severity"), told(F.col("cut.ends"), "", "lost").alias("signature")))
    known = F.col("cut").isNotNull() & (F.size(F.array_except("bare_lost", "lost")) == 0)
    second = F.when(F.col("bare").isNotNull() & (F.size("bare_lost") > 0) & ~known, F.struct(F.lit("moyenne").alias("severity"), told(F.concat(F.lit("<noscript>"), "bare.ends"), WITHOUT_SCRIPTS, "bare_lost").alias("signature")))
    out = t.select("site", "url", F.inline(F.array_compact(F.array(first, second))))
    return out.select("site", "url", F.lit("tete_interrompue").alias("key"), "severity", "signature", F.col("signature").alias("example"))


# Hosts of script loaders whose content changes, so that no fingerprint can hold, with the path they need and their name.
LOADERS = (
    ("googletagmanager.com", None, "Google Tag Manager / gtag"),
    ("google-analytics.com", None, "Google Analytics"),
    ("plausible.io", None, "Plausible"),
    ("js.stripe.com", None, "Stripe.js"),
    ("static.cloudflareinsights.com", None, "Cloudflare Web Analytics"),
    ("challenges.cloudflare.com", None, "Cloudflare Turnstile"),
    ("recaptcha.net", None, "reCAPTCHA"),
    ("google.com", "/recaptcha/", "reCAPTCHA"),
    ("gstatic.com", "/recaptcha/", "reCAPTCHA"),
    ("hcaptcha.com", None, "hCaptcha"),
    ("connect.facebook.net", None, "Pixel / SDK Meta"),
    ("static.hotjar.com", None, "Hotjar"),
    ("clarity.ms", None, "Microsoft Clarity"),
    ("snap.licdn.com", None, "LinkedIn Insight"),
    ("js.hs-scripts.com", None, "HubSpot"),
    ("js.hsforms.net", None, "HubSpot"),
    ("widget.intercom.io", None, "Intercom"),
    ("client.crisp.chat", None, "Crisp"),
    ("embed.tawk.to", None, "Tawk.to"),
    ("assets.calendly.com", None, "Calendly"),
    ("consent.cookiebot.com", None, "Cookiebot"),
    ("player.vimeo.com", None, "lecteur Vimeo"),
    ("youtube.com", "/iframe_api", "API YouTube"),
    ("ytimg.com", "/yts/jsbin/", "API YouTube"),
    ("maps.googleapis.com", None, "Google Maps"),
    ("accounts.google.com", "/gsi/", "Google Sign-In"),
    ("apis.google.com", None, "API Google"),
    ("googleadservices.com", None, "Google Ads"),
    ("cal.com", None, "Cal.com"),
    ("paypal.com", None, "PayPal"),
    ("paypalobjects.com", None, "PayPal"),
    ("cookielaw.org", None, "OneTrust"),
    ("onetrust.com", None, "OneTrust"),
    ("privacy-center.org", None, "Didomi"),
    ("didomi.io", None, "Didomi"),
    ("axept.io", None, "Axeptio"),
    ("cdn.segment.com", None, "Segment"),
    ("bat.bing.com", None, "Bing UET"),
    ("sibforms.com", None, "Brevo"),
    ("sendinblue.com", None, "Brevo"),
    ("brevo.com", None, "Brevo"),
    ("sibautomation.com", None, "Brevo"),
    ("platform.twitter.com", None, "widgets X / Twitter"),
    ("static.ads-twitter.com", None, "pixel X / Twitter"),
    ("js.sentry-cdn.com", None, "Sentry"),
    ("embed.typeform.com", None, "Typeform"),
    ("js.hs-analytics.net", None, "HubSpot"),
)
LIBRARIES = ("jsdelivr.net", "unpkg.com", "cdnjs.cloudflare.com")
PINNED_PACKAGE = r"@v?\d+\.\d+\.\d+(?:[-+][0-9A-Za-z.+-]*)?(?:/|$)|@[0-9a-f]{40}(?:/|$)"
PINNED_LIBRARY = r"/ajax/libs/[^/]+/v?\d+\.\d+(?:\.\d+)*[0-9A-Za-z.+-]*/"
# Script types that run.
SCRIPT_TYPES = (
    "", "module", "text/javascript", "application/javascript", "application/x-javascript", "text/ecmascript", "application/ecmascript", "text/x-javascript", "text/jscript", "text/livescript",
    "text/javascript1.0", "text/javascript1.1", "text/javascript1.2", "text/javascript1.3", "text/javascript1.4", "text/javascript1.5",
)
# Suffixes of several labels under which each name is another site.
SUFFIXES = (
    "co.uk org.uk me.uk ltd.uk plc.uk net.uk ac.uk gov.uk sch.uk com.au net.au org.au edu.au gov.au asn.au id.au co.nz net.nz "
    "org.nz govt.nz ac.nz co.jp ne.jp or.jp ac.jp go.jp com.br net.br org.br gov.br com.ar com.mx com.co com.pe com.ve com.uy "
    "com.cn net.cn org.cn gov.cn co.in net.in org.in firm.in gen.in ind.in co.za org.za web.za com.tr org.tr com.sg com.hk "
    "com.tw co.kr or.kr co.id web.id co.il org.il com.my com.ph com.vn co.th in.th com.ua com.pl com.es com.pt com.eg com.sa "
    "com.ng co.ke com.gr com.ro asso.fr com.fr gouv.fr nom.fr prd.fr presse.fr tm.fr vercel.app netlify.app pages.dev github.io "
    "gitlab.io herokuapp.com onrender.com fly.dev workers.dev web.app firebaseapp.com appspot.com azurewebsites.net cloudfront.net "
    "surge.sh glitch.me repl.co pythonanywhere.com convex.cloud convex.site ngrok.io ngrok-free.app trycloudflare.com s3.amazonaws.com"
).split()


def _site_of(host: Column) -> Column:
    """The name that is registered: one label more than the longest suffix; addresses and bare suffixes stay whole."""
    labels = F.split(host, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    listed = lambda n: (F.size(labels) > n) & last(n).isin(*[x for x in SUFFIXES if x.count(".") == n - 1])
    return F.when(host.rlike(r"^[0-9.]+$|^\["), host).when(listed(3), last(4)).when(listed(2), last(3)).otherwise(last(2))


def third_parties(items: DataFrame) -> DataFrame:
    """Scripts of other sites that run without integrity: sri_absent where their content can be fixed, sri_non_applicable for
    loaders and for libraries without an exact version. Sources are resolved against the page's first base above them."""
    base = items.filter((F.col("tag") == "base") & _given(_a("href"))).groupBy("url", "seq").agg(F.min(F.struct("pos", F.trim(_a("href")).alias("href"))).alias("b"))
    base = held(base, "base", urls.resolved(F.col("url"), F.col("b.href"))).select("url", "seq", F.col("b.pos").alias("base_pos"), "base")
    t = items.filter((F.col("tag") == "script") & _given(_a("src")) & ~_given(_a("integrity")) & ~F.coalesce("inert", F.lit(False)))
    t = t.filter(F.lower(F.trim(F.split_part(F.coalesce(_a("type"), F.lit("")), F.lit(";"), F.lit(1)))).isin(*SCRIPT_TYPES)).join(base, ["url", "seq"], "left")
    t = held(t, "at", F.when(F.col("base_pos") < F.col("pos"), F.col("base")).otherwise(F.col("url")))
    t = held(t, "src", urls.resolved(F.col("at"), F.trim(_a("src")))).filter(F.col("src").rlike("(?i)^https?://[^/]"))
    bare = lambda u: F.regexp_replace(F.regexp_replace(urls.host(u), r"\.$", ""), r"^www\.", "")
    path = urls.path(F.col("src"))
    t = held(held(t, "host", bare(F.col("src"))), "path", F.coalesce(F.try_url_decode(F.regexp_replace(path, r"\+", "%2B")), path))
    t = held(t, "own", bare(F.col("url"))).filter(_site_of(F.col("host")) != _site_of(F.col("own")))
    under = lambda h: (F.col("host") == h) | F.col("host").endswith("." + h)
    name = F.coalesce(*[F.when(under(h) & (F.col("path").startswith(p) if p else F.lit(True)), F.lit(n)) for h, p, n in LOADERS])
    library = under(LIBRARIES[0]) | under(LIBRARIES[1]) | under(LIBRARIES[2])
    why = F.when(name.isNotNull(), F.concat(F.lit("chargeur au contenu changeant : "), name)).when(library & ~F.col("path").rlike(PINNED_PACKAGE) & ~F.col("path").rlike(PINNED_LIBRARY), "bibliothèque sans version exacte")
    t, source = held(t, "why", why), urls.secretless_url(F.col("src"))
    return _seen(t.filter("why IS NULL"), "sri_absent", "basse", source).unionByName(_seen(t.filter("why IS NOT NULL"), "sri_non_applicable", "info", source, F.col("why")))


def _registered() -> dict:
    """Module name -> rule over elements and lines."""
    from lanternfish.operators.leaks import leaks
    from lanternfish.operators.structured import structured_data

    alone = {"a11y_noms": nameless, "a11y_structure": structure, "a11y_svg": drawings, "a11y_textes": wording, "securite_html": third_parties}
    return {k: (lambda items, lines, rule=rule: rule(items)) for k, rule in alone.items()} | {"contenu_demo": placeholders, "fuites_rendu": leaks, "donnees_structurees": structured_data}


def observations(items: DataFrame, lines: DataFrame, modules=None) -> DataFrame:
    """Observations of all registered modules over the elements and the lines of the same pages (store both first: each module reads them). A module
    whose rule cannot be built, or fails while it runs, does not end the others: it is reported, for every site, as modules_en_erreur.
    The observations of each module are a stored table."""
    from lanternfish.plans.tables import stored

    out, failed = None, []
    for name, rule in (modules or _registered()).items():
        try:
            rows = stored(rule(items, lines).withColumn("module", F.lit(name)), "module")  # run here, so that a rule fails in its own turn
        except Exception as e:
            failed.append((name, type(e).__name__))
            continue
        out = rows if out is None else out.unionByName(rows)
    if failed:
        names = F.explode(F.array(*[F.struct(F.lit(n).alias("module"), F.lit(e).alias("example")) for n, e in failed]))
        rows = items.groupBy("site").agg(F.min("url").alias("url")).select("site", "url", names.alias("x"))
        rows = rows.select("site", "url", F.lit("modules_en_erreur").alias("key"), F.lit("haute").alias("severity"), F.col("x.module").alias("signature"), "x.example", "x.module")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out
