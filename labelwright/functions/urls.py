"""URL columns: safety, marketplace, category hint and canonical forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, matches, rx, strip

# Marketplaces recognised by a fragment of the URL, in order: (fragment, name, needs a browser).
PLATFORMS = [
    ("amazon", "Amazon", False), ("flipkart", "Flipkart", True), ("meesho", "Meesho", True),
    ("myntra", "Myntra", True), ("jiomart", "JioMart", True), ("bigbasket", "BigBasket", True),
    ("blinkit", "Blinkit", True), ("zepto", "Zepto", True), ("swiggy", "Swiggy Instamart", True),
    ("tatacliq", "Tata Cliq", True), ("ajio", "AJIO", True), ("snapdeal", "Snapdeal", False),
    ("nykaa", "Nykaa", True), ("firstcry", "FirstCry", True), ("purplle", "Purplle", False),
    ("healthkart", "HealthKart", False),
]
GENERIC_NAME = "Generic E-Commerce Website"
MARKETPLACES = [
    ("amazon", "Amazon"), ("flipkart", "Flipkart"), ("meesho", "Meesho"),
    ("myntra", "Myntra"), ("nykaa", "Nykaa"), ("bigbasket", "BigBasket"),
]

# Private address ranges and the rejection reasons.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
PRIVATE_V4 = (
    rf"^(?:10\.{_OCTET}\.{_OCTET}|172\.(?:1[6-9]|2\d|3[01])\.{_OCTET}|192\.168\.{_OCTET}"
    rf"|127\.{_OCTET}\.{_OCTET}|169\.254\.{_OCTET})\.{_OCTET}$"
)
PRIVATE_V6 = r"^(?:(?:0{0,4}:){2,7}0{0,3}1|f[cd][0-9a-f]{2}:[0-9a-f:]*)$"
DOTTED_QUAD = r"^\d+\.\d+\.\d+\.\d+$"
URL_SCHEME = r"^([a-z][a-z0-9+.\-]*):"
URL_HOST = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#]*@)?(?:\[([^\]/?#]*)\]|([^:/?#\[\]]*))"
ASIN = r"/dp/([A-Z0-9]{10})"

# Category hints in the URL and category words in the product text, in order.
CATEGORY_HINTS = [
    ("groceries", "Food & Beverage"), ("food", "Food & Beverage"), ("beauty", "Beauty & Personal Care"),
    ("health", "Pharmaceuticals & Healthcare"), ("baby", "Baby & Child Care"),
    ("household", "Household & Cleaning"), ("pet", "Pet Care"),
]
CATEGORY_WORDS = [
    (r"\b(shampoo|conditioner|serum|moisturiser|moisturizer|sunscreen|face\s*wash|toner|"
     r"lip\s*balm|lipstick|mascara|foundation|concealer|kajal|eyeliner|nail\s*polish|"
     r"lotion|cream|gel|scrub|cleanser|deodorant|perfume|cologne|soap|body\s*wash|"
     r"hair\s*oil|hair\s*mask|hand\s*wash)\b", "Beauty & Personal Care"),
    (r"\b(ragi|powder|porridge|oats|flour|atta|maida|rice|dal|lentil|pulse|"
     r"biscuit|cookie|snack|chips|namkeen|chocolate|candy|jam|pickle|sauce|"
     r"ghee|oil|butter|milk|curd|yogurt|cheese|paneer|honey|sugar|salt|"
     r"spice|masala|tea|coffee|juice|drink|beverage|water|protein|supplement|"
     r"multivitamin|vitamin|mineral|probiotic|cereal|granola|muesli|"
     r"noodle|pasta|bread|cake|cookie|cracker|wafer|bar)\b", "Food & Beverage"),
    (r"\b(tablet|capsule|syrup|drops|ointment|cream|gel|spray|inhaler|"
     r"antibiotic|painkiller|ibuprofen|paracetamol|ayurvedic|homeopathic|"
     r"pharmaceutical|medicine|drug|rx|prescription)\b", "Pharmaceuticals & Healthcare"),
    (r"\b(detergent|dishwash|floor\s*cleaner|toilet\s*cleaner|glass\s*cleaner|"
     r"bleach|insecticide|pesticide|disinfectant|sanitizer|mosquito|cockroach|"
     r"fabric\s*softener|stain\s*remover|air\s*freshener)\b", "Household & Cleaning"),
    (r"\b(baby|infant|toddler|child|kids|diapers|nappy|formula|baby\s*food)\b", "Baby & Child Care"),
    (r"\b(pet\s*food|dog\s*food|cat\s*food|pet\s*care|aquarium)\b", "Pet Care"),
    (r"\b(electronic|phone|laptop|tablet|charger|cable|earphone|speaker|"
     r"camera|watch|gadget|appliance)\b", "Electronics"),
]


def _first_contained(c: Column, pairs, default) -> Column:
    chain = None
    for fragment, value in pairs:
        cond = c.contains(fragment)
        chain = F.when(cond, value) if chain is None else chain.when(cond, value)
    return chain if default is None else chain.otherwise(default)


def detect_platform(url: Column) -> Column:
    """Struct ``platform, adapter_key, is_js_heavy, display_name``."""

    def build(u: Column) -> Column:
        name = _first_contained(u, [(k, n) for k, n, _ in PLATFORMS], "Generic")
        return F.struct(
            name.alias("platform"),
            _first_contained(u, [(k, k) for k, _, _ in PLATFORMS], "generic").alias("adapter_key"),
            _first_contained(u, [(k, F.lit(js)) for k, _, js in PLATFORMS], F.lit(False)).alias("is_js_heavy"),
            _first_contained(u, [(k, n) for k, n, _ in PLATFORMS], GENERIC_NAME).alias("display_name"),
        )

    return bind(F.lower(url), build)


def detect_marketplace(url: Column) -> Column:
    return bind(F.lower(url), lambda u: _first_contained(u, MARKETPLACES, "Unknown"))


def url_host(url: Column) -> Column:
    u = F.lower(strip(url))
    return F.concat(F.regexp_extract(u, rx(URL_HOST), 1), F.regexp_extract(u, rx(URL_HOST), 2))


def url_status(url: Column) -> Column:
    """``OK`` or why a URL may not be fetched."""

    def judge(host: Column) -> Column:
        scheme = F.regexp_extract(F.lower(strip(url)), rx(URL_SCHEME), 1)
        return (
            F.when(strip(url) == "", "EMPTY")
            .when(~scheme.isin("http", "https"), "BAD_SCHEME")
            .when(host == "", "NO_HOST")
            .when(host.isin("localhost", "localhost."), "LOCALHOST")
            .when(matches(host, PRIVATE_V4) | matches(host, PRIVATE_V6), "PRIVATE_ADDRESS")
            .when(matches(host, DOTTED_QUAD), "DIRECT_ADDRESS")
            .otherwise("OK")
        )

    return F.when(url.isNull(), "EMPTY").otherwise(bind(url_host(url), judge))


def canonical_url(url: Column, by_region: bool = True) -> Column:
    """Product URL without tracking parts; ``by_region=False`` always gives the .in site."""
    asin = F.regexp_extract(url, rx(ASIN, ""), 1)
    site = (
        F.when(url.contains("amazon.in") | url.contains(".in/"), "www.amazon.in").otherwise("www.amazon.com")
        if by_region
        else F.lit("www.amazon.in")
    )
    return F.when(asin != "", F.concat(F.lit("https://"), site, F.lit("/dp/"), asin, F.lit("?th=1&psc=1"))).otherwise(url)


def infer_category(url: Column, text: Column) -> Column:
    """Category from the URL hints, else from the first word list found in the product text, else NULL."""

    def from_words(t: Column) -> Column:
        chain = None
        for pattern, label in CATEGORY_WORDS:
            cond = matches(t, pattern)
            chain = F.when(cond, label) if chain is None else chain.when(cond, label)
        return chain

    hint = bind(F.lower(url), lambda u: _first_contained(u, CATEGORY_HINTS, None))
    return F.coalesce(hint, bind(F.lower(text), from_words))
