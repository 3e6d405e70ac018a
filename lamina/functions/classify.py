"""Types, severities and rule tables as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.functions import text

#: Number prefixes that name a type; phrases of a summary, first match wins; document titles.
NUMBER_PREFIXES = ("TSB", "PIT", "PIC", "PIP")
SUMMARY_PHRASES = (
    ("customer satisfaction", "CSP"), ("special coverage", "SC"), ("safety recall", "RC"), ("recall campaign", "RC"), ("warranty administration", "WA"),
    ("technical service bulletin", "TSB"), ("this technical bulletin provides", "TSB"), ("technical bulletin", "TB"), ("service bulletin", "SB"),
    ("service update", "SU"), ("informational bulletin", "IB"), ("this bulletin provides information", "IB"), ("preliminary information", "PIT"),
)
DOCUMENT_TITLES = (("owner letter", "OL"), ("dealer letter", "DL"), ("service bulletin document", "SB"), ("bulletin", "BL"), ("manufacturer communications", "MC"))
#: Tiers of types; every other type is small.
TIERS = {"serious": ("TSB", "CSP", "RC"), "medium": ("PIT", "PIC", "SB", "TB", "SU", "WA", "SC")}
#: Words of a query and words of a document's tags that point at the same system.
SYSTEM_RULES = (
    ("brakes", ("brake", "braking", "abs", "anti-lock", "antilock", "stability", "decelerat"), ("brake", "abs", "stability", "chassis")),
    ("infotainment", ("radio", "screen", "display", "infotainment", "touchscreen", "head unit", "hud", "head-up", "heads up", "heads-up", "cluster", "google", "app", "onstar", "connected service"), ("infotainment", "radio", "display", "cluster", "telematics", "hud")),
    ("powertrain", ("propulsion", "power loss", "loss of power", "no start", "won't start", "wont start", "stall", "drivetrain", "motor", "drive unit", "reduced power"), ("powertrain", "engine", "propulsion", "drivetrain")),
    ("electrical", ("electrical", "wiring", "wire", "12 volt", "12-volt", "module", "fuse", "high voltage", "battery", "charge", "charging"), ("electrical", "electric")),
    ("suspension", ("suspension", "leveling", "air ride", "ride height", "shock", "air leveling"), ("suspension",)),
    ("hvac", ("heat", "hvac", "a/c", "air conditioning", "climate", "defrost", "no heat"), ("hvac", "climate", "heat")),
    ("tpms", ("tpms", "tire pressure", "tire", "tyre"), ("tire pressure", "tpms", "tire")),
    ("steering", ("steering", "steer", "steering wheel"), ("steering",)),
    ("body", ("door", "hood", "tailgate", "liftgate", "window", "glass", "trunk", "latch", "footwell", "carpet", "water leak", "leak", "seat", "mirror"), ("body", "glass")),
    ("driver_assist", ("super cruise", "adaptive cruise", "lane keep", "lane depart", "collision", "driver assist", "safety feature", "park assist", "blind zone", "blind spot", "cruise", "camera"), ("driver assist", "assistance", "adas", "safety", "collision", "cruise", "camera")),
)
#: Fixed value: added to a score for each system that query and document share.
TAG_BOOST = 0.001


def _first(pairs: list[tuple[Column, str]]) -> Column:
    return F.coalesce(*[F.when(test, value) for test, value in pairs])


def bulletin_type(number: Column, summary: Column, titles: Column) -> Column:
    """By number prefix, else phrase of the summary, else the first known document title, else NA form, else OTHER."""
    prefix = F.upper(F.substring(number, 1, 3))
    low = F.lower(summary)
    known = {title: code for title, code in DOCUMENT_TITLES}
    codes = F.transform(titles, lambda t: _first([(F.lower(F.trim(t)) == k, v) for k, v in known.items()]))
    first_title = F.get(F.filter(codes, lambda c: c.isNotNull()), F.lit(0))
    up = F.upper(number)
    return F.coalesce(
        F.when(prefix.isin(*NUMBER_PREFIXES), prefix),
        _first([(F.contains(low, F.lit(phrase)), code) for phrase, code in SUMMARY_PHRASES]),
        first_title,
        F.when(F.contains(up, F.lit("-NA-")) | up.endswith("-NA"), "NA"),
        F.lit("OTHER"),
    )


def type_severity(kind: Column) -> Column:
    """The tier of a type; unknown and null are small."""
    return F.when(kind.isin(*TIERS["serious"]), "serious").when(kind.isin(*TIERS["medium"]), "medium").otherwise("small")


def document_severity(doc_kind: Column, symptoms: Column, remedy: Column, audience: Column) -> Column:
    """(severity, reason) of a document; what is meant for dealers is medium at most."""
    remedied = F.coalesce(F.trim(remedy) != "", F.lit(False))

    def verdict(severity: str, reason: str) -> Column:
        return F.struct(F.lit(severity).alias("severity"), F.lit(reason).alias("reason"))

    found = (
        F.when(doc_kind == "recall", verdict("serious", "recall"))
        .when((doc_kind == "customer_letter") & remedied, verdict("serious", "owner letter with remedy"))
        .when(doc_kind == "service_procedure", verdict("medium", "service procedure"))
        .when((doc_kind == "informational") & (F.size(symptoms) > 0) & remedied, verdict("medium", "informational with symptoms and remedy"))
        .otherwise(verdict("small", "no escalating signal"))
    )
    return F.when((audience == "dealer") & (found["severity"] == "serious"), verdict("medium", "dealer-facing capped")).otherwise(found)


def query_systems(query: str) -> list[str]:
    """Systems whose words occur in the query, as plain substrings."""
    low = query.lower()
    return [name for name, words, _ in SYSTEM_RULES if any(w in low for w in words)]


def shared_systems(query: str, tags: Column) -> Column:
    """Names of the systems that the query and the tags both point at."""
    joined = F.lower(F.array_join(tags, " "))
    asked = set(query_systems(query))
    hits = [F.when(F.coalesce(joined.rlike("|".join(words)), F.lit(False)), name) for name, _, words in SYSTEM_RULES if name in asked]
    return F.filter(F.array(*hits), lambda h: h.isNotNull()) if hits else F.array().cast("array<string>")


def clean_extraction(payload: Column) -> Column:
    """(error, years, models, symptoms, summary) of a model's JSON answer, checked against its contract."""
    read = lambda p: F.from_json(p, "summary STRING, symptoms ARRAY<STRING>, remedy STRING, doc_kind STRING, audience STRING, applicability_years ARRAY<STRING>, applicability_models ARRAY<STRING>", {"mode": "PERMISSIVE"})

    def checked(row: Column) -> Column:
        got = row["got"]
        # a failed cast costs as much as the rest, so what has no digit is not tried
        years = F.filter(F.transform(got["applicability_years"], lambda y: F.when(y.rlike("[0-9]"), F.trim(y).try_cast("int"))), lambda y: y.between(1950, 2100))
        trimmed = [F.filter(F.transform(got[c], lambda v: F.trim(v)), lambda v: v != "") for c in ("applicability_models", "symptoms")]
        keys = row["keys"]
        missing = F.array_except(F.array(*[F.lit(k) for k in ("summary", "symptoms", "remedy", "doc_kind", "audience")]), keys)
        kinds, readers = ("recall", "customer_letter", "service_procedure", "informational"), ("owner", "dealer", "both")
        error = (
            F.when(keys.isNull(), "invalid JSON")
            .when(F.size(missing) > 0, F.concat(F.lit("missing fields: "), F.array_join(missing, ", ")))
            .when(~got["doc_kind"].isin(*kinds), "doc_kind not allowed")
            .when(~got["audience"].isin(*readers), "audience not allowed")
            .when(F.coalesce(F.trim(got["summary"]), F.lit("")) == "", "summary is empty")
        )
        return F.struct(error.alias("error"), F.array_distinct(years).alias("years"), F.array_distinct(trimmed[0]).alias("models"), trimmed[1].alias("symptoms"), F.trim(got["summary"]).alias("summary"))

    # the answer is parsed once, however many of its fields are looked at
    return text.let(text.let(payload, lambda p: F.struct(read(p).alias("got"), F.json_object_keys(p).alias("keys"))), checked)
