"""JSON-LD of pages as one graph: objects of any depth, joined by `@id`, against the properties that rich results need.

Only objects that stand for themselves are judged (sources.html.jsonld_objects). What an object lacks may stand at another object
of the page with the same `@id`, or be given by an offer or a review that points to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish.sources import html

# Types that count as another, the properties that each type needs (one of each group), what was retired.
LOCAL = (
    "LocalBusiness Restaurant Store ProfessionalService MedicalClinic Dentist Hotel Bakery CafeOrCoffeeShop AutoRepair HealthAndBeautyBusiness LegalService RealEstateAgent FoodEstablishment BarOrPub FastFoodRestaurant "
    "IceCreamShop Winery Brewery LodgingBusiness Motel Hostel BedAndBreakfast Resort Electrician Plumber Locksmith RoofingContractor GeneralContractor HVACBusiness MovingCompany HousePainter HairSalon BeautySalon DaySpa "
    "NailSalon HealthClub GymOrFitnessCenter Physician Pharmacy AutoDealer AutoWash GasStation AccountingService Attorney Notary TravelAgency InsuranceAgency FinancialService BankOrCreditUnion Library BookStore "
    "ClothingStore Florist FurnitureStore HardwareStore GroceryStore PetStore EntertainmentBusiness"
).split()
EVENTS = "BusinessEvent ChildrensEvent ComedyEvent DanceEvent EducationEvent ExhibitionEvent Festival FoodEvent Hackathon LiteraryEvent MusicEvent ScreeningEvent SocialEvent SportsEvent TheaterEvent VisualArtsEvent".split()
APPLICATIONS = ("MobileApplication", "WebApplication")
REQUIRED = {
    "Event": (("name",), ("startDate",), ("location",)),
    "Product": (("name",), ("offers", "review", "aggregateRating")),
    "JobPosting": (("datePosted",), ("description",), ("hiringOrganization",), ("jobLocation", "applicantLocationRequirements"), ("title",)),
    "Recipe": (("name",), ("image",)),
    "VideoObject": (("name",), ("thumbnailUrl",), ("uploadDate",)),
    "BreadcrumbList": (("itemListElement",),),
    "Course": (("name",), ("description",)),
    "SoftwareApplication": (("name",), ("offers",), ("aggregateRating", "review")),
    "Review": (("author",), ("reviewRating",)),
    "AggregateRating": (("ratingValue",), ("ratingCount", "reviewCount")),
    "LocalBusiness": (("name",), ("address",)),
}
RETIRED = {
    "ClaimReview": "ClaimReview : affichage en cours de retrait (bannière Google du 12/06/2025)",
    "SpecialAnnouncement": "SpecialAnnouncement : documentation supprimée le 09/09/2025",
    "Occupation": "Estimated salary (Occupation) : documentation supprimée le 09/09/2025",
    "Quiz": "Practice problem (Quiz) : déprécié le 05/11/2025, documentation supprimée le 06/01/2026",
    "HowTo": "HowTo : résultats enrichis retirés en 2023",
    "FAQPage": "FAQPage : résultat enrichi FAQ arrêté le 07/05/2026 (restreint aux sites gouvernementaux et de santé depuis 2023)",
}
COURSE_INFO = "Course Info (hasCourseInstance) : documentation supprimée le 09/09/2025"
VEHICLES = "Vehicle listing : documentation supprimée le 09/09/2025"
LEARNING_VIDEO = "Learning video : documentation supprimée le 09/09/2025"
SEARCH_BOX = "Sitelinks search box (WebSite + SearchAction) : documentation supprimée le 29/11/2024"
PRICED = ("Offer", "AggregateOffer", "PriceSpecification", "UnitPriceSpecification")
#: Courses that make a list, characters of text below which prices are not compared, digits of a price.
LISTED_COURSES, LEAST_TEXT, MOST_DIGITS = 3, 100, 15

#: A record of a page (a url may have several), and an object in it.
PAGE = ["site", "url", "seq"]
AT = [*PAGE, "pos", "path"]


def _get(v: str, name: str, kind: str = "string") -> Column:
    return F.expr(f"""try_variant_get({v}, '$["{name}"]', '{kind}')""")


def _many(v: Column) -> Column:
    """A variant as an array of variants: its elements, or itself."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))


def objects(items: DataFrame) -> DataFrame:
    """Objects with n (their number), id and props (name -> value as JSON, empty ones left out)."""
    o = html.jsonld_objects(items)
    props = F.map_filter(F.from_json(F.to_json("o"), "map<string,string>"), lambda k, v: v.isNotNull() & ~F.trim(v).isin("", "[]", "{}"))
    return o.withColumns({"id": _get("o", "@id"), "props": props})


def merged(found: DataFrame) -> DataFrame:
    """site, url, seq, id, given: the objects of a page that share an `@id` as one; the first value of each property counts. Objects that
    only refer bring nothing; offers and reviews bring themselves to what they point at."""
    own = found.filter("id IS NOT NULL AND size(map_filter(props, (k, v) -> k <> '@id')) > 0").select(*PAGE, "id", "pos", "path", F.explode("props").alias("k", "v"), F.lit(0).alias("late"))
    gives = F.when(F.col("k") == "itemOffered", "offers").when(F.array_contains("types", "Review"), "review").when(F.array_contains("types", "AggregateRating"), "aggregateRating")
    refers = F.array(*(F.struct(F.lit(k).alias("k"), _get("o", k, "variant").alias("v")) for k in ("itemOffered", "itemReviewed")))
    points = found.select(*AT, "types", F.inline(refers)).filter("v IS NOT NULL").withColumn("to", F.explode(_many(F.col("v"))))
    points = points.select(*PAGE, _get("to", "@id").alias("id"), "pos", "path", gives.alias("k"), F.lit("{}?").alias("v"), F.lit(1).alias("late")).filter("id IS NOT NULL AND k IS NOT NULL")
    first = own.unionByName(points).groupBy(*PAGE, "id", "k").agg(F.min_by("v", F.struct("late", "pos", "path")).alias("v"))
    return first.groupBy(*PAGE, "id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("given"))


def _parts(found: DataFrame, graph: DataFrame, name: str) -> DataFrame:
    """AT, nth, el, known (object whose reference is no riddle), have: the objects that a property of an object holds, with the
    properties that they have themselves or by their `@id`."""
    whole = F.coalesce(_get("o", name, "variant"), F.try_parse_json(F.col("given")[name]))
    each = found.select(*AT, F.posexplode(_many(whole)).alias("nth", "el")).filter("el IS NOT NULL")
    each = each.withColumns({"ref": _get("el", "@id"), "keys": F.map_keys(F.map_filter(F.from_json(F.to_json("el"), "map<string,string>"), lambda k, v: v.isNotNull() & ~F.trim(v).isin("", "[]", "{}")))})
    each = each.join(graph.select(*PAGE, F.col("id").alias("ref"), F.col("given").alias("ref_given")), [*PAGE, "ref"], "left")
    is_object = F.schema_of_variant("el").startswith("OBJECT")
    known = is_object & ((F.size(F.array_except("keys", F.array(F.lit("@id")))) > 0) | F.col("ref_given").isNotNull())
    have = F.array_union(F.coalesce("keys", F.array().cast("array<string>")), F.coalesce(F.map_keys("ref_given"), F.array().cast("array<string>")))
    virtual = F.coalesce(_get("el", "@type"), F.lit("")).endswith("VirtualLocation") | F.coalesce(F.exists(_get("el", "@type", "array<string>"), lambda t: t.endswith("VirtualLocation")), F.lit(False))
    return each.select(*AT, "nth", known.alias("known"), have.alias("have"), virtual.alias("virtual"))


def findings(items: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """site, url, key, severity, signature: required properties that objects lack, types without effect, prices that the page does
    not show. texts: site, url, seq, text (the whole visible text of pages); without it prices are not compared."""
    from lanternfish.plans.tables import stored

    found = stored(objects(items), "jsonld-objects")
    graph = stored(merged(found), "jsonld-graph")
    found = found.join(graph.withColumnRenamed("given", "by_id"), [*PAGE, "id"], "left").withColumn("given", F.coalesce("by_id", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))).drop("by_id")
    found = found.withColumn("have", F.array_union(F.map_keys("props"), F.map_keys("given")))
    kind = lambda t: F.when(t.isin(*LOCAL), "LocalBusiness").when(t.isin(*EVENTS), "Event").when(t.isin(*APPLICATIONS), "SoftwareApplication").otherwise(t)
    # Of the types that count as the same one, the first.
    typed = found.filter("role IS NOT NULL").select("*", F.posexplode("types").alias("nth", "type")).withColumn("family", kind(F.col("type")))
    typed = typed.filter(F.col("family").isin(*REQUIRED) & ((F.col("role") == "full") | F.col("family").isin("Review", "AggregateRating")))
    firsts = typed.groupBy(*AT, "family").agg(F.min("nth").alias("nth"))
    typed = typed.join(firsts, [*AT, "family", "nth"], "left_semi")
    groups = F.element_at(F.create_map(*[x for t, g in REQUIRED.items() for x in (F.lit(t), F.array(*(F.array(*map(F.lit, p)) for p in g)))]), F.col("family"))
    lacks = F.transform(F.filter(groups, lambda g: ~F.arrays_overlap(g, "have")), lambda g: F.array_join(g, "|"))
    typed = typed.withColumn("lacks", lacks)
    # A place needs a name and an address, an offer of an application a price: one part that is whole, or cannot be judged, is enough.
    places = _parts(typed.filter("family = 'Event' AND array_contains(have, 'location')"), graph, "location")
    open_ = F.array_compact(F.array(*(F.when(~F.array_contains("have", p), F.lit(f"location.{p}")) for p in ("name", "address"))))
    places = places.groupBy(*AT).agg(F.bool_or(~F.col("known") | F.col("virtual") | (F.size(open_) == 0)).alias("fine"), F.min_by(open_, "nth").alias("more")).filter("NOT fine").select(*AT, "more", F.lit("Event").alias("family"))
    offers = _parts(typed.filter("family = 'SoftwareApplication' AND array_contains(have, 'offers')"), graph, "offers")
    offers = offers.groupBy(*AT).agg(F.bool_or(~F.col("known") | F.array_contains("have", "price")).alias("fine")).filter("NOT fine").select(*AT, F.array(F.lit("offers.price")).alias("more"), F.lit("SoftwareApplication").alias("family"))
    typed = typed.join(places.unionByName(offers), [*AT, "family"], "left").withColumn("lacks", F.concat("lacks", F.coalesce("more", F.array().cast("array<string>")))).filter("size(lacks) > 0")
    courses = found.filter("role IS NOT NULL AND array_contains(types, 'Course')").groupBy(*PAGE).agg((F.count("*") >= LISTED_COURSES).alias("list"))
    typed = typed.join(courses, PAGE, "left")
    lone = (F.col("family") == "Course") & ~F.coalesce("list", F.lit(False))
    missing = typed.select("site", "url", F.when(lone, "jsonld_cours_incomplet").otherwise("jsonld_proprietes_requises").alias("key"), F.when(lone, "basse").otherwise("moyenne").alias("severity"), F.concat("type", F.lit(" : "), F.array_join("lacks", ", ")).alias("signature"))
    is_ = lambda t: F.array_contains("types", t)
    has = lambda p: F.map_contains_key("props", p)
    acts = F.exists(_many(_get("o", "potentialAction", "variant")), lambda a: F.coalesce(F.try_variant_get(a, '$["@type"]', "string"), F.lit("")).rlike("(^|[:/])SearchAction$"))
    gone = F.array_compact(F.array(
        *(F.when(is_(t), F.lit(m)) for t, m in RETIRED.items()), F.when(is_("Course") & _get("o", "hasCourseInstance", "variant").isNotNull(), F.lit(COURSE_INFO)), F.when((is_("Car") | is_("Vehicle")) & has("offers"), F.lit(VEHICLES)),
        F.when(is_("VideoObject") & (has("learningResourceType") | has("educationalLevel") | has("educationalAlignment")), F.lit(LEARNING_VIDEO)), F.when(is_("WebSite") & acts, F.lit(SEARCH_BOX)),
    ))
    retired = found.select("site", "url", F.lit("jsonld_type_sans_effet").alias("key"), F.lit("info").alias("severity"), F.explode(gone).alias("signature"))
    out = missing.unionByName(retired)
    return out if texts is None else out.unionByName(prices(found, texts))


def prices(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Prices of offers that the text of their page does not show, however they are written there."""
    bare = F.regexp_replace(_get("o", "price"), r"(?U)\s", "")
    plain = F.when(bare.contains(",") & ~bare.contains("."), F.regexp_replace(bare, ",", ".")).otherwise(bare)
    price = F.when((F.length(plain) <= MOST_DIGITS + 3) & plain.rlike(r"^\d+(?:\.\d+)?$"), F.round(plain.try_cast("double"), 2))
    offered = found.filter(F.arrays_overlap("types", F.array(*map(F.lit, PRICED)))).select(*AT, price.alias("price")).filter("price > 0")
    short = lambda x: F.length(x) <= MOST_DIGITS + 3
    number = lambda x: F.round(x.try_cast("double"), 2)
    grouped = F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"\d{1,3}(?:[ .,]\d{3})+(?:[.,]\d+)?"), F.lit(0)), lambda x: F.regexp_replace(x, " ", "")), short)
    simple = F.filter(F.regexp_extract_all("text", F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0)), short)
    whole = lambda x: number(F.regexp_replace(x, "[.,]", ""))
    cents = lambda x: number(F.concat(F.regexp_replace(F.regexp_extract(x, r"^(.*)[.,]\d+$", 1), "[.,]", ""), F.lit("."), F.regexp_extract(x, r"[.,](\d+)$", 1)))
    shown = F.concat(F.transform(grouped, whole), F.transform(grouped, cents), F.transform(simple, lambda x: number(F.regexp_replace(x, ",", "."))), F.transform(simple, whole))
    t = texts.filter(F.length("text") >= LEAST_TEXT).join(offered.select(*PAGE).distinct(), PAGE, "left_semi").select(*PAGE, F.array_distinct(shown).alias("shown"))
    lost = offered.join(t, PAGE).filter(~F.array_contains("shown", F.col("price")))
    said = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", "price"), r"0+$", ""), r"\.$", "")
    return lost.select("site", "url", F.lit("jsonld_prix_absent_du_texte").alias("key"), F.lit("basse").alias("severity"), F.concat(F.lit("Offer : prix "), said, F.lit(" absent du texte visible")).alias("signature"))


def page_texts(lines: DataFrame) -> DataFrame:
    """site, url, seq, text: the blocks of a page in the order of the page, blanks folded."""
    every = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", html.unmarked(F.col("line"), 0).alias("t")))), lambda x: x["t"]), " ")
    return lines.groupBy(*PAGE).agg(every.alias("text"))


def structured_data(items: DataFrame, lines: DataFrame) -> DataFrame:
    """All findings as observations of a module."""
    t = findings(items, page_texts(lines))
    return t.select("site", "url", "key", "severity", F.substring("signature", 1, 200).alias("signature"), F.substring("signature", 1, 160).alias("example"))
