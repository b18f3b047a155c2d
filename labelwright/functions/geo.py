"""Country, address and origin columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules.literals import folded, may_match
from .heads import tested
from .text import bind, blank_to_null, capture, matches, replace_all, rx, strip

# States, union territories and cities that place an address in India.
INDIA_PLACES = (
    r"\b("
    r"Andhra\s*Pradesh|Arunachal\s*Pradesh|Assam|Bihar|Chhattisgarh|Goa|Gujarat|"
    r"Haryana|Himachal\s*Pradesh|Jharkhand|Karnataka|Kerala|Madhya\s*Pradesh|"
    r"Maharashtra|Manipur|Meghalaya|Mizoram|Nagaland|Odisha|Orissa|Punjab|"
    r"Rajasthan|Sikkim|Tamil\s*Nadu|Telangana|Tripura|Uttar\s*Pradesh|Uttarakhand|"
    r"West\s*Bengal|"
    r"Andaman|Nicobar|Chandigarh|Dadra|Nagar\s*Haveli|Daman|Diu|Delhi|"
    r"Jammu|Kashmir|Ladakh|Lakshadweep|Puducherry|Pondicherry|"
    r"Mumbai|Bombay|Delhi|Kolkata|Calcutta|Chennai|Madras|Bangalore|Bengaluru|"
    r"Hyderabad|Ahmedabad|Pune|Surat|Jaipur|Lucknow|Kanpur|Nagpur|Indore|"
    r"Thane|Bhopal|Visakhapatnam|Pimpri|Patna|Vadodara|Ghaziabad|Ludhiana|"
    r"Agra|Nashik|Faridabad|Meerut|Rajkot|Varanasi|Srinagar|Aurangabad|"
    r"Dhanbad|Amritsar|Navi\s*Mumbai|Allahabad|Howrah|Coimbatore|Jabalpur|"
    r"Gwalior|Vijayawada|Jodhpur|Madurai|Raipur|Kota|Guwahati|Chandigarh|"
    r"Solapur|Hubli|Baddi|Silvassa|Haridwar|Rishikesh|Noida|Gurugram|Gurgaon"
    r")\b"
)
PIN_ANY = r"\b[1-9]\d{5}\b"

# Country patterns in the order they are tried.
COUNTRY_PATTERNS = [
    (r"\bChina\b|\bPRC\b|\bPeople'?s\s*Republic\b", "China"),
    (r"\bUSA\b|\bUnited\s*States\b|\bU\.S\.A\.?\b", "USA"),
    (r"\bUnited\s*Kingdom\b|\bU\.K\.?\b|\bEngland\b|\bBritain\b", "United Kingdom"),
    (r"\bGermany\b|\bDeutschland\b", "Germany"),
    (r"\bFrance\b|\bFrench\b", "France"),
    (r"\bItaly\b|\bItalia\b", "Italy"),
    (r"\bJapan\b|\bJapanese\b", "Japan"),
    (r"\bSri\s*Lanka\b", "Sri Lanka"),
    (r"\bBangladesh\b", "Bangladesh"),
    (r"\bPakistan\b", "Pakistan"),
    (r"\bNepal\b", "Nepal"),
    (r"\bAustralia\b", "Australia"),
    (r"\bCanada\b", "Canada"),
    (r"\bThailand\b", "Thailand"),
    (r"\bVietnam\b", "Vietnam"),
    (r"\bIndonesia\b", "Indonesia"),
    (r"\bMalaysia\b", "Malaysia"),
    (r"\bSingapore\b", "Singapore"),
    (r"\bIsrael\b", "Israel"),
    (r"\bNetherlands\b|\bHolland\b", "Netherlands"),
    (r"\bSpain\b|\bEspana\b", "Spain"),
    (r"\bSwitzerland\b", "Switzerland"),
    (r"\bDenmark\b", "Denmark"),
    (r"\bSweden\b", "Sweden"),
    (r"\bNorway\b", "Norway"),
    (r"\bBelgium\b", "Belgium"),
    (r"\bPoland\b", "Poland"),
    (r"\bTurkey\b|\bTürkiye\b", "Turkey"),
    (r"\bMexico\b", "Mexico"),
    (r"\bBrazil\b|\bBrasil\b", "Brazil"),
    (r"\bSouth\s*Korea\b|\bRepublic\s*of\s*Korea\b", "South Korea"),
    (r"\bTaiwan\b", "Taiwan"),
    (r"\bIndia\b", "India"),
]

# Country keywords (plain substrings) with name and confidence, in order.
COUNTRY_KEYWORDS = [
    ("india", "India", 95), ("china", "China", 95), ("usa", "USA", 95),
    ("united states", "USA", 95), ("united kingdom", "United Kingdom", 95),
    ("uk", "United Kingdom", 80), ("germany", "Germany", 95), ("france", "France", 95),
    ("japan", "Japan", 95), ("south korea", "South Korea", 95), ("korea", "South Korea", 85),
    ("bangladesh", "Bangladesh", 95), ("sri lanka", "Sri Lanka", 95), ("pakistan", "Pakistan", 95),
    ("vietnam", "Vietnam", 95), ("thailand", "Thailand", 95), ("indonesia", "Indonesia", 95),
    ("malaysia", "Malaysia", 95), ("singapore", "Singapore", 95), ("nepal", "Nepal", 95),
    ("italy", "Italy", 95), ("spain", "Spain", 95), ("australia", "Australia", 95),
    ("new zealand", "New Zealand", 95), ("canada", "Canada", 95), ("brazil", "Brazil", 95),
    ("israel", "Israel", 95), ("turkey", "Turkey", 95),
]
STATE_SIGNAL = (
    r"\b(Maharashtra|Gujarat|Karnataka|Tamil Nadu|Rajasthan|Delhi|"
    r"Uttar Pradesh|Madhya Pradesh|West Bengal|Punjab|Haryana|Kerala|"
    r"Bihar|Odisha|Assam|Telangana|Andhra Pradesh|Himachal Pradesh|"
    r"Uttarakhand|Jharkhand|Chhattisgarh|Goa|Sikkim|Tripura|Manipur|"
    r"Meghalaya|Mizoram|Nagaland|Arunachal Pradesh|Puducherry|Chandigarh)\b"
)
PIN_SIGNAL = r"\b([1-8]\d{5})\b"
PHONE_SIGNAL = r"(\+91|0\d{10}|1800[\s\-]?\d{6,})"

# State names and abbreviations for address parsing.
ADDRESS_STATES = [
    "Andhra Pradesh", "Arunachal Pradesh", "Assam", "Bihar", "Chhattisgarh",
    "Goa", "Gujarat", "Haryana", "Himachal Pradesh", "Jharkhand", "Karnataka",
    "Kerala", "Madhya Pradesh", "Maharashtra", "Manipur", "Meghalaya", "Mizoram",
    "Nagaland", "Odisha", "Punjab", "Rajasthan", "Sikkim", "Tamil Nadu",
    "Telangana", "Tripura", "Uttar Pradesh", "Uttarakhand", "West Bengal",
    "Delhi", "Jammu and Kashmir", "Ladakh", "Puducherry", "Chandigarh",
    "Andaman and Nicobar Islands", "Dadra and Nagar Haveli", "Daman and Diu",
    "Lakshadweep", "AP", "UP", "MP", "HP", "J&K",
]
ADDRESS_PIN = r"\b([1-9]\d{5})\b"
COMPANY_SUFFIX = (
    r"\b(Private\s+Limited|Pvt\.?\s*Ltd\.?|Limited|Ltd\.?|LLP|"
    r"Industries|Enterprises|Corporation|Co\.|Foods|Agro|Dairy|"
    r"Pharmaceuticals|Healthcare|Wellness|Solutions|Products|Traders)\b"
)
ROLE_PREFIX = (
    r"(?:Manufactured|Marketed|Packed|Processed|Imported|Distributed)\s*"
    r"(?:and\s+\w+\s*)?(?:by|for)\s*[:\-]?"
)
ADDRESS_COUNTRY = r"\b(India|China|USA|United States|UK|Germany|France|Japan|Korea)\b"


def address_state_pattern() -> str:
    """State alternation, longest names first so that a name wins over its own prefix."""
    return r"\b(" + "|".join(sorted(ADDRESS_STATES, key=len, reverse=True)) + r")\b"


def any_country_pattern() -> str:
    """Any of the country patterns, all of whose alternatives are whole words."""
    words = [w for pattern, _ in COUNTRY_PATTERNS for w in pattern.split("|")]
    return r"\b(?:" + "|".join(w.removeprefix(r"\b").removesuffix(r"\b") for w in words) + r")\b"


def infer_country(text: Column) -> Column:
    """Country an address text points to, or NULL.

    Indian place names decide first, then the ordered country patterns, then a
    six-digit PIN once 14-digit licence numbers are taken out.  The country patterns are tried in order only where one
    of them matches, and each only where the text holds a literal that it needs.
    """

    def ordered(low: Column) -> Column:
        chain = None
        for pattern, country in COUNTRY_PATTERNS:
            worth, hit = may_match(low, pattern), matches(text, pattern)
            cond = hit if worth is None else worth & hit
            chain = F.when(cond, country) if chain is None else chain.when(cond, country)
        return chain

    return (
        F.when(text.isNull() | (F.length(strip(text)) < 5), None)
        .when(matches(text, tested(INDIA_PLACES)), "India")
        .when(matches(text, tested(any_country_pattern())), bind(folded(text), ordered))
        .when(matches(replace_all(text, r"\d{14}", "", ""), PIN_ANY, ""), "India")
    )


def detect_country(text: Column) -> Column:
    """Struct ``country, confidence, signals``.

    Keywords are plain substrings tried in order ("usa" also hits inside
    "thousand"); that is the specified behaviour.  What is found in the text is found once, and read from there.
    """

    def keyword(lowered: Column) -> Column:
        chain = None
        for kw, name, conf in COUNTRY_KEYWORDS:
            hit = F.struct(F.lit(name).alias("name"), F.lit(conf).alias("conf"))
            cond = lowered.contains(kw)
            chain = F.when(cond, hit) if chain is None else chain.when(cond, hit)
        return chain

    found = F.struct(
        bind(F.lower(text), keyword).alias("keyword"),
        capture(text, STATE_SIGNAL).alias("state"),
        capture(text, PIN_SIGNAL, flags="").alias("pin"),
        matches(text, PHONE_SIGNAL, "").alias("phone"),
    )
    return bind(found, _country_of)


def _country_of(found: Column) -> Column:
    """Country, confidence and signals from the keyword, state, PIN and phone number found."""
    named, conf, state, pin, phone = found["keyword"]["name"], found["keyword"]["conf"], found["state"], found["pin"], found["phone"]
    before_pin = F.coalesce(named, F.when(state.isNotNull(), "India"))
    conf_before_pin = F.coalesce(conf, F.when(state.isNotNull(), 88))
    confidence = (
        F.when(
            pin.isNotNull(),
            F.when(before_pin.isNull(), 82)
            .when(before_pin == "India", F.least(conf_before_pin + 5, F.lit(98)))
            .otherwise(conf_before_pin),
        )
        .when(before_pin.isNotNull(), conf_before_pin)
        .when(phone, 75)
        .otherwise(0)
    )
    country = F.coalesce(before_pin, F.when(pin.isNotNull() | phone, "India"), F.lit("Unknown"))
    signals = F.array_compact(
        F.array(
            F.when(named.isNotNull(), F.concat(F.lit("Explicit country name: '"), named, F.lit("'"))),
            F.when(state.isNotNull(), F.concat(F.lit("Indian state detected: '"), state, F.lit("'"))),
            F.when(pin.isNotNull(), F.concat(F.lit("Indian PIN code: "), pin)),
            F.when(phone, F.lit("Indian phone number detected")),
        )
    )
    return F.struct(country.alias("country"), confidence.alias("confidence"), signals.alias("signals"))


def address_text(raw: Column) -> Column:
    return strip(replace_all(F.regexp_replace(strip(raw), "\\.+$", ""), ROLE_PREFIX, ""))


def parse_address(raw: Column) -> Column:
    """Struct of company, address lines, city, state, pincode, country, full text and confidence.

    Absent parts are NULL.
    """

    def locate(p: Column) -> Column:
        by_suffix = F.array_position(
            F.transform(p["parts"], lambda x: x.rlike(rx(COMPANY_SUFFIX)) & (F.length(x) > 5)), True
        )
        first = F.get(p["parts"], F.lit(0))
        leading = first.rlike("^[A-Z]") & (F.length(first) > 4)
        return F.struct(
            p["parts"].alias("parts"),
            # 1-based position of the company piece, 0 if there is none
            bind(by_suffix, lambda n: F.when(n > 0, n).when(leading, F.lit(1)).otherwise(F.lit(0))).alias("company_at"),
            capture(p["text"], ADDRESS_PIN, flags="").alias("pincode"),
            capture(p["text"], address_state_pattern()).alias("state"),
            capture(p["text"], ADDRESS_COUNTRY).alias("named"),
        )

    def settle(p: Column) -> Column:
        return F.struct(
            F.get(p["parts"], (p["company_at"] - 1).cast("int")).alias("company"),
            p["pincode"].alias("pincode"),
            p["state"].alias("state"),
            F.coalesce(p["named"], F.when(p["state"].isNotNull() | p["pincode"].isNotNull(), F.lit("India"))).alias("country"),
            F.filter(
                F.transform(p["parts"], lambda x, i: F.when(i + 1 != p["company_at"], x)), lambda x: x.isNotNull()
            ).alias("rest"),
        )

    def place(p: Column) -> Column:
        holds = lambda x, c: F.coalesce(F.lower(x).contains(F.lower(c)), F.lit(False))
        same = lambda x, c: F.coalesce(F.lower(x) == F.lower(c), F.lit(False))
        pin_part = F.get(
            F.filter(
                p["rest"],
                lambda x: ~holds(x, p["state"]) & ~holds(x, p["country"]) & F.coalesce(x.contains(p["pincode"]), F.lit(False)),
            ),
            F.lit(0),
        )
        city = F.btrim(replace_all(pin_part, ADDRESS_PIN, "", ""), F.lit(" -"))
        return F.struct(
            *[p[c].alias(c) for c in ("company", "pincode", "state", "country")],
            bind(city, lambda c: F.when(F.length(c) > 2, c)).alias("city"),
            F.filter(p["rest"], lambda x: ~same(x, p["state"]) & ~same(x, p["country"])).alias("lines"),
        )

    def build(p: Column) -> Column:
        score = F.lit(0)
        for part, points in (("company", 25), ("pincode", 30), ("state", 25), ("country", 10), ("city", 10)):
            score = score + F.when(p[part].isNotNull(), points).otherwise(0)
        present = raw != ""
        return F.struct(
            F.when(present, p["company"]).alias("company"),
            F.when(present, F.get(p["lines"], F.lit(0))).alias("address_line1"),
            F.when(present, blank_to_null(F.array_join(F.slice(p["lines"], 2, 2), ", "))).alias("address_line2"),
            *[F.when(present, p[c]).alias(c) for c in ("city", "state", "pincode", "country")],
            F.when(present, strip(raw)).alias("full_address"),
            F.when(present, score).otherwise(0).alias("confidence"),
        )

    pieces = bind(
        address_text(raw),
        lambda t: F.struct(
            t.alias("text"),
            F.filter(F.transform(F.split(t, "[,\n]+"), strip), lambda x: x != "").alias("parts"),
        ),
    )
    return bind(bind(bind(bind(pieces, locate), settle), place), build)


def classify_origin(manufacturer: Column, importer: Column, declared: Column) -> Column:
    """Struct ``classification, notes`` from three country names (NULL counts as empty)."""
    mfr, imp, decl = (F.coalesce(c, F.lit("")) for c in (manufacturer, importer, declared))
    m, i, d = F.lower(mfr), F.lower(imp), F.lower(decl)
    india = F.lit("india")
    domestic_plain = (m == india) & (i == "")
    imported_by = (i == india) & (m != "") & (m != india)
    imported_decl = (d != "") & (d != india)
    domestic = (m == india) | (d == india)
    classification = (
        F.when(domestic_plain, "Domestic Product")
        .when(imported_by | imported_decl, "Imported Product")
        .when(domestic, "Domestic Product")
        .otherwise("Unknown")
    )
    notes = (
        F.when(domestic_plain, F.lit("Manufactured in India"))
        .when(imported_by, F.concat(F.lit("Manufactured in "), mfr, F.lit(", Imported to India")))
        .when(imported_decl, F.concat(F.lit("Declared Country of Origin: "), decl))
        .when(domestic, F.lit("Manufactured/Originated in India"))
        .otherwise(F.lit("Insufficient data to classify"))
    )
    return F.struct(classification.alias("classification"), notes.alias("notes"))
