"""Image-candidate columns: validity, scores, categories and text signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .heads import tested
from .text import any_of, bind, int_or_null, matches, rx, strip, word_count, words

# Extensions, hosts and the patterns that mark an image as unusable.
EXTENSIONS = r"^(?:https?:)?(?://[^/?#]*)?/[^?#]*\.(?:jpg|jpeg|png|webp|gif|avif)(?:[?#]|$)"
ANY_EXTENSION = r"\.jpg|\.jpeg|\.png|\.webp"
CDN_HOSTS = ["myntassets.com", "cloudinary.com", "media.meesho.com", "rukminim"]
OPEN_HOSTS = r"images-amazon\.com|m\.media-amazon\.com|i\.imgur\.com"
SKIP_URL = (
    r"amazon-logo|amzn-logo|sprite[_/]|ic_[a-z]|btmbar|nav[_-]icon|/nav/|/icons/|"
    r"[/_-]icon[/_-]|[/_-]badge[/_-]|[/_-]star[/_.-]|[/_-]rating[/_-]|[/_-]arrow[/_-]|"
    r"[/_-]cart[/_-]|[/_-]wishlist[/_-]|[/_-]share[/_-]|[/_-]social[/_-]|[/_-]button[/_-]|[/_-]widget[/_-]|"
    r"[/_-]flag[/_-]|[/_-]spinner[/_.-]|[/_-]loader[/_.-]|[/_-]shimmer|[/_-]skeleton|[/_-]placeholder|"
    r"transparent-pixel|amazon_pay|pay_icon|prime[_-]logo|/gp/aw/|pdp_loader|"
    r"customer[_-]image|review[_-]image|review_img|favicon|spacer|pixel|blank|retaillabs|"
    r"watermark|overlay|social-icon|facebook\.com|twitter\.com|instagram\.com|youtube\.com|"
    r"/logo/|[/_-]logo\.(?:png|jpg|svg|webp)|data:image"
)
SKIP_ALT = (
    r"amazon\s*logo|brand\s*logo|promotional|lifestyle|marketing|banner|offer|discount|sale|"
    r"buy\s*now|add\s*to\s*cart|free\s*delivery|prime|serving\s*suggestion|packaging\s*may\s*vary|"
    r"image\s*for\s*representation|for\s*illustration|customer\s*image|customer\s*review|"
    r"related\s*product|similar\s*product|amazon\s*fresh|amazon\s*basics|^\s*fresh\s*$"
)
TINY_SIZE = r"_SX\d{1,2}_|_SY\d{1,2}_|_SS\d{2}_"

# The rendered-page predicate.
USEFUL_SKIP = (
    r"logo|icon|banner|arrow|star|rating|spinner|favicon|cart|wishlist|share|badge|nav|menu|button|"
    r"placeholder|blank|spacer|pixel|advertisement|loader|shimmer|skeleton|retaillabs"
)
USEFUL_EXTENSION = r"\.(jpe?g|png|webp|avif|gif)(\?|$)"
USEFUL_HOSTS = (
    r"rukminim|img-f\.scribdassets|fk-p-l\.justdial|cf\.shopify|images-na\.ssl-images-amazon|m\.media-amazon|"
    r"media\.flipkart|img-f\.meesho|assets\.myntassets|bigbasket\.com/media|grofers|blinkit|zepto|magicpin"
)

# Collector score.
SIZE_TOKEN = r"_SL(\d{3,4})_|_AC_SL(\d{3,4})|_SX(\d{3,4})"
INDEX_TOKEN = r"\.(\d{2})\."
GROCERY_HOSTS = r"bigbasket\.com/media|blinkit\.com|zeptonow\.com|swiggy\.com"
TRANSFORM_TOKEN = r"h_\d{4}|w_\d{4}|q_\d{2,3}"
LABEL_WORDS = r"back|rear|label|ingredient|nutrition|fssai|manufacturer|barcode|declaration"

# Compliance score over URL, alt text and source.
REJECT_URL = (
    r"(amazon-logo|amzn-logo|sprite[_/]|ic_|btmbar|nav-icon|[/_-]icon[/_-]|[/_-]badge[/_-]|[/_-]star[/_-]|"
    r"[/_-]review[/_-]|[/_-]cart[/_-]|[/_-]wishlist[/_-]|[/_-]checkout[/_-]|[/_-]offer[/_-]|[/_-]deal[/_-]|"
    r"[/_-]payment[/_-]|[/_-]widget[/_-]|[/_-]share[/_-]|watermark|overlay|retaillabs|placeholder|spacer|pixel|"
    r"pdp_loader|favicon|[/_-]banner[/_-]|[/_-]hero[/_-]|[/_-]model[/_-]|background|bg-|_bg\.|social-icon|"
    r"facebook\.com|twitter\.com|instagram\.com|logo(?!.*product)|lifestyle|howto|how-to|how_to|"
    r"serving[_-]?suggestion|serving[_-]?size[_-]?image|benefit[_-]image|claim[_-]image|feature[_-]image|infographic[_-]|"
    r"step[_-]?\d[_-]|steps[_-]?to|usage[_-]?image|packaging[_-]?may[_-]?vary|may[_-]?vary|for[_-]?illustration|"
    r"representat|for[_-]?represent|image[_-]?purpose|[/_-]promo[/_-]|promotional[/_-]|[/_-]sale[/_-]|"
    r"[/_-]ad[/_-]|advertisement)"
)
REJECT_ALT = (
    r"(amazon logo|brand logo|promotional|lifestyle|marketing|banner|offer|discount|sale|buy now|add to cart|"
    r"free delivery|prime|icon|graphic|illustration|serving suggestion|packaging may vary|"
    r"image for representation|for illustration)"
)
PREFER_URL = (
    r"(back|rear|side|label|nutrition|ingredient|allergen|declaration|compliance|specification|spec-|"
    r"manufacturer|mfg|barcode|qrcode|_SL1500_|_SL1000_|_SL500_|_SX679_|_SX466_|h_1440|h_2000|q_90|w_1500|"
    r"large|zoom|hires|hi-res|full|/p/\d|/product/\d|/dp/)"
)
PREFER_ALT = (
    r"(back|reverse|label|ingredient|nutrition|allergen|manufacturer|packer|importer|fssai|"
    r"net.?weight|net.?qty|net.?quantity|mrp|country.?of.?origin|consumer.?care|best.?before|expiry|batch|lot.?no|"
    r"barcode|qr.?code|declaration|statutory|packaging|package)"
)
ALT_KEYWORDS = [
    ("net.?weight|net.?qty|net.?quantity|net.?content", 25),
    (r"mrp|maximum.?retail.?price|price.?per", 25),
    ("manufacturer|mfg.?by|marketed.?by|packed.?by|packer", 25),
    ("importer|imported.?by", 25),
    ("fssai|lic.?no|licence|license", 20),
    ("country.?of.?origin", 15),
    ("consumer.?care|customer.?care|helpline", 15),
    ("best.?before|expiry|exp.?date|use.?by", 15),
    ("batch|lot.?no|b.?no", 10),
    ("ingredients|allergen|nutritional", 10),
    ("back|rear|reverse", 20),
    ("side|label|declaration|statutory", 15),
    ("front|main|primary", 8),
]
URL_KEYWORDS = ["back", "rear", "reverse", "side", "label", "nutrition", "ingredient", "manufacturer", "declaration", "barcode"]
THUMB_TOKEN = r"_SS(\d{2,3})_|_SX(\d{2})_|_UX(\d{2,3})_"
TINY_DIMENSIONS = r"[_-](\d{2,3})x\1[_-]|/(\d{2})x(\d{2})/"
SOURCE_TRUST = [
    (("adapter",), 30, "Adapter-provided product image (+30)"),
    (("amazon_hires", "amazon_dynamic"), 25, "Amazon high-resolution image source (+25)"),
    (("amazon_gallery",), 15, "Amazon gallery image (+15)"),
    (("myntra_script",), 20, "Myntra product image (+20)"),
    (("jsonld",), 10, "JSON-LD structured data image (+10)"),
]

# Category keywords; ties go to the earlier category.
CATEGORIES = {
    "front_package": ["front", "main", "primary", "_sl1500_", "_sl1000_", "front-view", "pack-front", "_ac_sl", "product-image", "pdp-"],
    "back_package": ["back", "rear", "reverse", "back-view", "pack-back", "ingredients", "nutrition", "nutrition-label"],
    "side_label": ["side", "label", "detail", "spec", "specification", "manufacturer", "mfg", "barcode", "qr", "declaration"],
    "nutrition": ["nutrition", "nutritional", "allergen", "supplement-facts", "facts-panel"],
    "ingredient_panel": ["ingredient", "ingredients", "composition", "made-from", "made-with", "prepared-from", "content-list"],
    "lifestyle": ["lifestyle", "model", "person", "happy", "banner", "hero", "mood", "scene", "background"],
}
PACKAGING = ("front_package", "back_package", "side_label", "nutrition")
SIZED_URL = r"_SL\d{3,4}_|_AC_SL\d+|_SX\d+"

# Text signals of a pre-read image: pattern, points, wording.
SIGNALS = {
    "has_fssai": r"FSSAI|F\.?S\.?S\.?A\.?I|Lic(?:ence|ense)?\.?\s*No\.?|License\s*No|Licence\s*No|[1-9]\d{13}",
    "has_mrp": r"M\.?R\.?P\.?|Maximum\s*Retail\s*Price|Rs\.?\s*\d|₹\s*\d",
    "has_manufacturer": r"Manufactur|Mfg\.?\s*[Bb]y|Packed\s*[Bb]y|Marketed\s*[Bb]y|Imported\s*[Bb]y|MANUFACTURER|PACKER|IMPORTER",
    "has_net_qty": r"Net\s*(?:Weight|Wt\.?|Quantity|Qty\.?|Content|Vol)|NET\s*WT|Nett?\s*Wt|Net\s+Content|\d+\s*(?:kg|g|ml|litre|liter|L)\b",
    "has_consumer_care": r"Consumer\s*Care|Customer\s*Care|Helpline|Toll[\s-]*Free|1800[\s-]\d",
    "has_date_batch": r"Batch|Lot\s*No|Mfg\s*Date|Best\s*Before|Expiry|BBE|Use\s*By",
    "has_country": r"Country\s*of\s*Origin|Made\s*in\s*India|Product\s*of",
    "has_ingredients": (
        r"INGRED[A-Za-z1l]{2,7}[S]?\s*[:\-.]?|COMPOSITION\s*[:\-.]?|MADE\s+(?:FROM|WITH)\s*[:\-.]?"
        r"|PREPARED\s+FROM\s*[:\-.]?|CONTAINS\s*[:\-]\s*[A-Z]|CONTENT\s*[:\-]\s*[A-Z]"
    ),
}
NUTRITION_SIGNAL = (
    r"NUTRITION\s*(?:FACTS?|INFORMATION|VALUE|PER\s+\d+)|(?:CALORIES?|ENERGY)\s*[:\-]?\s*\d"
    r"|TOTAL\s+(?:FAT|CARB|PROTEIN)\s*[:\-]?\s*\d|AMOUNT\s+PER\s+SERVING"
)
MARKETING_SIGNAL = (
    r"100%\s*(?:Pure|Natural|Organic)|No\s*Preservatives|(?:Free\s*from|Contains\s*no)\s+(?:artificial|added)|"
    r"Loved\s*by|Trusted\s*by|Award\s*winning|Best\s*seller|Clinically\s*(?:proven|tested)|Dermatologist|Satisfaction\s*Guaranteed"
)
LICENCE_STRICT = r"[1-9]\d{13}"
LICENCE_SPACED = r"[1-9](?:\d[\s\-]?){3}(?:\d[\s\-]?){4}(?:\d[\s\-]?){4}\d\d"
LICENCE_LABEL = r"L\.?I\.?C\.?\s*N[O0]\.?|LIC(?:ENCE|ENSE)?\s*N[O0]\.?|LICENCE\s*N[O0]|LICENSE\s*N[O0]"
SIGNAL_POINTS = [
    ("has_mrp", 35, "MRP detected (+35)"),
    ("has_manufacturer", 35, "Manufacturer/packer text (+35)"),
    ("has_net_qty", 30, "Net quantity text (+30)"),
    ("has_ingredients", 45, "Ingredient heading detected (+45)"),
    ("has_consumer_care", 20, "Consumer care info (+20)"),
    ("has_date_batch", 20, "Batch/date info (+20)"),
    ("has_country", 15, "Country of origin (+15)"),
]
SIGNAL_NAMES = (
    "has_fssai", "has_mrp", "has_manufacturer", "has_net_qty", "has_consumer_care", "has_date_batch", "has_country",
    "has_ingredients", "has_nutrition_only", "is_marketing_only", "has_dense_text", "has_fssai_with_number",
)
DENSE_WORDS, SOME_WORDS = 40, 20


def _points(*terms: tuple[Column, int]) -> Column:
    total = F.lit(0)
    for cond, pts in terms:
        total = total + F.when(cond, pts).otherwise(0)
    return total


def is_valid_image_url(url: Column) -> Column:
    lowered = F.lower(url)
    scheme = F.regexp_extract(lowered, r"^([a-z][a-z0-9+.\-]*):", 1)
    usable = (F.length(url) >= 20) & ~url.startswith("data:") & scheme.isin("http", "https", "")
    hosted = url.rlike(any_of(CDN_HOSTS)) & url.rlike(ANY_EXTENSION)
    return F.coalesce(usable & (matches(url, EXTENSIONS) | hosted | url.rlike(OPEN_HOSTS)), F.lit(False))


def should_skip(url: Column, alt: Column) -> Column:
    return matches(url, SKIP_URL) | matches(alt, SKIP_ALT) | F.coalesce(url.rlike(TINY_SIZE), F.lit(False))


def is_useful_image(url: Column) -> Column:
    """Rendered-page predicate: long enough, http(s), no interface words, looks like an image."""
    lowered = F.lower(url)
    looks = matches(url, USEFUL_EXTENSION) | matches(url, USEFUL_HOSTS) | lowered.contains("image") | lowered.contains("img")
    return F.coalesce(
        (F.length(url) >= 15) & lowered.rlike("^https?:") & ~matches(url, USEFUL_SKIP) & looks, F.lit(False)
    )


def _size(url: Column, flags: str) -> Column:
    # the digits of a token are its only ones
    return int_or_null(F.regexp_extract(F.regexp_extract(url, rx(SIZE_TOKEN, flags), 0), rx(r"\d{3,4}", ""), 0))


def _index(url: Column) -> Column:
    return int_or_null(F.regexp_extract(url, rx(INDEX_TOKEN, ""), 1))


def is_rejected(url: Column) -> Column:
    """The address marks something other than a package."""
    return matches(F.lower(url), REJECT_URL)


def collector_score(url: Column, alt: Column) -> Column:
    facts = F.struct(_size(url, "").alias("size"), _index(url).alias("idx"))
    return bind(facts, lambda p: _collected_points(url, alt, p["size"], p["idx"]))


def _collected_points(url: Column, alt: Column, size: Column, idx: Column) -> Column:
    combined = F.lower(F.concat(url, F.lit(" "), F.coalesce(alt, F.lit(""))))
    jio = url.contains("jiomartjcp.com") | url.contains("jiomart.com") | url.contains("jiostatic.com")
    return (
        F.when(size >= 1000, 25).when(size >= 500, 12).otherwise(0)
        + F.when(idx == 1, 5).when(idx.between(2, 6), 20).when(idx.between(7, 9), -10).when(idx.isNotNull(), -20).otherwise(0)
        + F.when(url.contains("rukminim"), F.when(url.contains("/832/") | url.contains("/1664/"), 20).otherwise(10)).otherwise(0)
        + F.when(jio, F.when(url.contains("/original/"), 22).otherwise(18)).otherwise(0)
        + _points(
            (url.rlike(GROCERY_HOSTS), 15),
            (url.rlike(TRANSFORM_TOKEN), 15),
            (url.contains("amazon_gallery") | url.contains("adapter"), 20),
            (combined.rlike(LABEL_WORDS), 15),
        )
    )


def url_score(url: Column, alt: Column, source: Column, collected: Column, rejected: Column | None = None) -> Column:
    """Struct ``score, reasons`` from URL, alt text, source and the collector's score.

    ``rejected`` is ``is_rejected(url)``, where the caller has it already.  Every test runs once; a rejected image needs no other.
    """
    facts = F.struct(
        F.lower(url).alias("u"),
        F.lower(F.coalesce(alt, F.lit(""))).alias("a"),
        _size(F.lower(url), "i").alias("size"),
        _index(url).alias("idx"),
    )
    scored = bind(facts, lambda p: _score_facts(p["u"], p["a"], p["size"], p["idx"], source, collected))
    reason = "URL matches non-packaging pattern (icon/logo/UI/promotional)"
    turned_down = F.struct(F.lit(-120).alias("score"), F.array(F.lit(reason)).alias("reasons"))
    return F.when(is_rejected(url) if rejected is None else rejected, turned_down).otherwise(scored)


def _score_facts(u: Column, a: Column, size: Column, idx: Column, source: Column, collected: Column) -> Column:
    two = F.lpad(idx.cast("string"), 2, "0")
    terms: list[tuple[Column, Column, Column]] = []

    def add(cond: Column, points: int, reason) -> None:
        terms.append((cond, F.lit(points), reason if isinstance(reason, Column) else F.lit(reason)))

    add(matches(a, REJECT_ALT), -60, "Alt text matches promotional/marketing content")
    add(matches(u, TINY_DIMENSIONS), -40, "Appears to be a tiny thumbnail")
    add(matches(u, THUMB_TOKEN), -50, "Amazon small thumbnail URL")
    for names, points, reason in SOURCE_TRUST:
        add(source.isin(*names), points, reason)
    add(matches(u, PREFER_URL), 20, "URL matches high-res/packaging pattern (+20)")
    add(size >= 1000, 25, F.concat(F.lit("Amazon high-res image "), size.cast("string"), F.lit("px (+25)")))
    add(size.between(500, 999), 12, F.concat(F.lit("Amazon medium-res image "), size.cast("string"), F.lit("px (+12)")))
    add(u.rlike(TRANSFORM_TOKEN), 18, "Cloudinary high-res transform (+18)")
    add(idx == 1, 5, "Amazon primary image index 01 (+5)")
    add(idx.between(2, 5), 18, F.concat(F.lit("Amazon image index "), two, F.lit(" (back/side/detail range, +18)")))
    add(idx.between(6, 9), -15, F.concat(F.lit("Amazon image index "), two, F.lit(" (likely lifestyle/promo, -15)")))
    add(idx >= 10, -25, F.concat(F.lit("Amazon image index "), two, F.lit(" (very likely brand/lifestyle, -25)")))
    add(matches(a, PREFER_ALT), 18, "Alt text suggests compliance-relevant content (+18)")
    alt_place = kw = None
    for i, (pattern, _) in enumerate(ALT_KEYWORDS):
        cond = matches(a, pattern)
        alt_place = F.when(cond, i) if alt_place is None else alt_place.when(cond, i)
    for word in URL_KEYWORDS:
        cond = u.contains(word)
        kw = F.when(cond, word) if kw is None else kw.when(cond, word)
    outcome = F.struct(*[cond.alias(f"c{i}") for i, (cond, _, _) in enumerate(terms)], F.when(a != "", alt_place).alias("alt"), kw.alias("kw"))

    def build(t: Column) -> Column:
        alt_points = alt_reason = None
        for i, (pattern, points) in enumerate(ALT_KEYWORDS):
            text = f"Alt text: '{pattern}' compliance field (+{points})"
            alt_points = F.when(t["alt"] == i, points) if alt_points is None else alt_points.when(t["alt"] == i, points)
            alt_reason = F.when(t["alt"] == i, text) if alt_reason is None else alt_reason.when(t["alt"] == i, text)
        total = F.coalesce(alt_points, F.lit(0)) + F.when(t["kw"].isNotNull(), 12).otherwise(0)
        total = total + F.when(collected > 0, F.least(collected, F.lit(15))).otherwise(0)
        for i, (_, points, _) in enumerate(terms):
            total = total + F.when(t[f"c{i}"], points).otherwise(0)
        reasons = F.array_compact(
            F.array(
                *[F.when(t[f"c{i}"], reason) for i, (_, _, reason) in enumerate(terms)],
                alt_reason,
                F.concat(F.lit("URL contains '"), t["kw"], F.lit("' (+12)")),
            )
        )
        return F.struct(total.alias("score"), reasons.alias("reasons"))

    return bind(outcome, build)


def classify_image(url: Column, alt: Column, rejected: Column | None = None) -> Column:
    """Struct ``category, confidence, is_packaging`` by keyword counts; ``rejected`` as in ``url_score``."""

    def build(text: Column) -> Column:
        counts = F.array(
            *[
                F.struct(
                    _points(*[(text.contains(w), 1) for w in kws]).alias("n"),
                    F.lit(-i).alias("first"),
                    F.lit(name).alias("category"),
                )
                for i, (name, kws) in enumerate(CATEGORIES.items())
            ]
        )

        def settle(best: Column) -> Column:
            out = is_rejected(url) if rejected is None else rejected
            facts = F.struct(best["n"].alias("n"), best["category"].alias("category"), out.alias("out"), F.when(best["n"] == 0, url.rlike(SIZED_URL)).alias("sized"))
            return bind(facts, judge)

        def judge(p: Column) -> Column:
            category = (
                F.when(p["out"], "non_packaging")
                .when(p["n"] > 0, p["category"])
                .when(p["sized"], "front_package")
                .otherwise("unknown")
            )
            hits = F.when(p["out"], 0).when(p["n"] > 0, p["n"]).when(p["sized"], 1).otherwise(0)
            return F.struct(
                category.alias("category"),
                F.round(F.least(F.lit(0.5) + hits * 0.1, F.lit(0.95)), 2).alias("confidence"),
                category.isin(*PACKAGING).alias("is_packaging"),
            )

        return bind(F.array_max(counts), settle)

    return bind(F.lower(F.concat(url, F.lit(" "), F.coalesce(alt, F.lit("")))), build)


def text_signals(text: Column) -> Column:
    """Struct ``boost, reason, signals`` of an image's pre-read text; ``signals`` is NULL for no text."""

    def build(t: Column) -> Column:
        # each test runs once, also where several flags read it
        hits = {k: matches(t, tested(p)) for k, p in SIGNALS.items()}
        hits["has_fssai"] = hits["has_fssai"] | matches(t, LICENCE_LABEL)
        found = F.struct(*[v.alias(k) for k, v in hits.items()], word_count(t).alias("word_count"))

        def flagged(s: Column) -> Column:
            number = matches(t, LICENCE_STRICT, "") | matches(t, LICENCE_SPACED, "")
            return F.struct(
                *[s[k].alias(k) for k in SIGNALS],
                (~s["has_ingredients"] & matches(t, tested(NUTRITION_SIGNAL))).alias("has_nutrition_only"),
                (s["word_count"] >= DENSE_WORDS).alias("has_dense_text"),
                (s["has_fssai"] & number).alias("has_fssai_with_number"),
                matches(t, tested(MARKETING_SIGNAL)).alias("marketing"),
                s["word_count"].alias("word_count"),
            )

        def score(s: Column) -> Column:
            any_signal = s["has_fssai"]
            for k in SIGNALS:
                any_signal = any_signal | s[k]
            marketing_only = s["marketing"] & ~any_signal
            licence = F.when(s["has_fssai_with_number"], 150).when(s["has_fssai"], 80).otherwise(0)
            density = F.when(s["has_dense_text"], 60).when(s["word_count"] >= SOME_WORDS, 25).otherwise(0)
            boost = licence + density + _points(*[(s[k], p) for k, p, _ in SIGNAL_POINTS]) + F.when(marketing_only, -40).otherwise(0)
            reason = F.concat_ws(
                "; ",
                F.when(s["has_fssai_with_number"], "FSSAI LICENCE NUMBER visible (+150) — HIGHEST PRIORITY").when(
                    s["has_fssai"], "FSSAI text detected (+80)"
                ),
                F.when(
                    s["has_dense_text"],
                    F.concat(F.lit("DENSE TEXT: "), s["word_count"].cast("string"), F.lit(" words detected — back label/ingredient panel (+60)")),
                ).when(
                    s["word_count"] >= SOME_WORDS,
                    F.concat(F.lit("MODERATE TEXT: "), s["word_count"].cast("string"), F.lit(" words detected (+25)")),
                ),
                *[F.when(s[k], text) for k, _, text in SIGNAL_POINTS],
                F.when(marketing_only, "Confirmed marketing-only content (-40)"),
            )
            signals = F.struct(
                *[
                    (marketing_only if k == "is_marketing_only" else s[k]).alias(k)
                    for k in SIGNAL_NAMES
                ],
                s["word_count"].alias("word_count"),
            )
            return F.struct(boost.alias("boost"), reason.alias("reason"), signals.alias("signals"))

        return bind(bind(found, flagged), score)

    return F.when(text != "", bind(text, build))


def best_of_srcset(srcset: Column) -> Column:
    """URL with the largest width or density in a srcset; the first one if no sizes are given."""

    def entry(part: Column, i: Column) -> Column:
        def build(tokens: Column) -> Column:
            n = F.size(tokens)
            size = F.regexp_replace(F.try_element_at(tokens, F.lit(-1)), "[wx]+$", "").try_cast("int")
            return F.struct(
                F.when(n > 1, F.coalesce(size, F.lit(0))).otherwise(0).alias("size"),
                (-i).alias("first"),
                F.get(tokens, F.lit(0)).alias("url"),
            )

        return bind(words(part), build)

    parts = F.filter(F.split(srcset, ","), lambda p: strip(p) != "")
    return F.array_max(F.transform(parts, entry))["url"]


# CDN address parts that select a resolution.
AMAZON_TRANSFORM = r"^(https?://[^/]+/images/I/[A-Za-z0-9+/]{8,25})(\._[^/]+?)(\.(?:jpg|jpeg|png|webp))"
AMAZON_ID = r"/images/I/([A-Za-z0-9]{8,25})\."


def upgrade_amazon(url: Column) -> Column:
    """Full-size address of a gallery image; empty for a video overlay."""
    p = rx(AMAZON_TRANSFORM)
    transform = F.regexp_extract(url, p, 2)
    video = transform.contains("PKmb") | F.lower(transform).contains("play-button")
    return F.when(transform == "", url).when(video, "").otherwise(
        F.concat(F.regexp_extract(url, p, 1), F.lit("._SL1500_"), F.regexp_extract(url, p, 3))
    )


def amazon_image_key(url: Column) -> Column:
    key = F.regexp_extract(url, rx(AMAZON_ID, ""), 1)
    return F.when(key != "", key).otherwise(url)


def upgrade_flipkart(url: Column) -> Column:
    return F.regexp_replace(url, r"/\d+/\d+/", "/832/832/")


def upgrade_jiomart(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"/t\.\w+\([^)]*\)/", "/original/"), r"\?.*$", "")


def upgrade_meesho(url: Column) -> Column:
    return F.regexp_replace(url, r"/\d+/\d+", "/1080/1080")


# Addresses of product images inside the pages of three marketplaces, and what marks other images.
RECORD_IMAGES = {
    "flipkart": r"https?://rukminim\d*\.flixcart\.com/image/[^\s\"'<>\\]+\.(?:jpg|jpeg|png|webp)",
    "jiomart": r"https?://(?:cdn\d*\.jiomartjcp\.com|cdn\.jiomart\.com|jiostatic\.com)/[^\s\"'<>\\]+\.(?:jpg|jpeg|png|webp)",
    "myntra": r"https?://(?:assets\.myntassets\.com|assets\.myntra\.com)/assets/images/(\d{4}/\w+/\d+/[A-Za-z0-9_]+\.(?:jpg|jpeg|png|webp))",
}
RECORD_SIZE = r"/\d{2,4}/\d{2,4}/"
THEME_IMAGES = ("/theme/assets/", "/icons/", "/logo")
MYNTRA_FULL = "https://assets.myntassets.com/h_1440,q_75,w_1080/v1/assets/images/"


def record_images(adapter: Column, html: Column, state: Column) -> Column:
    """Product images that a marketplace's page names, full size, each once in page order; empty for other pages.

    ``state`` is the text of the embedded state, read where the page itself names none.
    """

    def named(text: Column, site: str, group: int = 0) -> Column:
        return F.regexp_extract_all(text, F.lit(rx(RECORD_IMAGES[site])), F.lit(group))

    def theme(u: Column) -> Column:
        return u.contains(THEME_IMAGES[0]) | u.contains(THEME_IMAGES[1]) | F.lower(u).contains(THEME_IMAGES[2])

    flipkart = bind(named(html, "flipkart"), lambda us: F.when(F.size(us) > 0, us).otherwise(named(F.coalesce(state, F.lit("")), "flipkart")))
    found = (
        F.when(adapter == "flipkart", F.transform(flipkart, lambda u: F.regexp_replace(u, RECORD_SIZE, "/832/832/")))
        .when(adapter == "jiomart", F.transform(F.filter(named(html, "jiomart"), lambda u: ~theme(u)), upgrade_jiomart))
        .when(adapter == "myntra", F.transform(named(html, "myntra", 1), lambda p: F.concat(F.lit(MYNTRA_FULL), p)))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.array_distinct(found)


def absolute_url(url: Column, base: Column) -> Column:
    """Resolve protocol-relative and host-relative addresses against the page address."""
    u = strip(url)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    return F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.startswith("/"), F.concat(root, u)).otherwise(u)


def url_without_query(url: Column) -> Column:
    return F.split(url, "\\?", 2)[0]
