"""Page extraction: crawled HTML to structured metadata and product records.

Every step is a projection of the pages table, so pages are read once and
nothing is shuffled.  Columns of one marketplace are computed only for its own
pages.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import images as I
from ..functions import urls as U
from ..functions.normalize import collapse_newlines
from ..functions.text import any_of, bind, blank_to_null, replace_all, rx, strip, strip_to_null
from . import marketplaces as M

LICENCE = r"[1-9]\d{13}"
BLOCKED_BELOW = 3000
LISTING_BLOCKED_BELOW = 5000


def page_table(pages: DataFrame, max_chars: int | None = None, blocked_below: int = BLOCKED_BELOW) -> DataFrame:
    """Add ``content_length`` and ``fetch_status``; ``max_chars`` cuts the HTML (default: whole pages)."""
    html = F.col("html") if max_chars is None else F.substring("html", 1, max_chars)
    return (
        pages.withColumn("html", html)
        .withColumn("content_length", F.length("html"))
        .withColumn("fetch_status", F.when(F.length("html") < blocked_below, "BLOCKED").otherwise("OK"))
    )


# ---- structured metadata


def _json(node: Column, *paths: str) -> Column:
    return F.coalesce(*[strip_to_null(F.get_json_object(node, p)) for p in paths])


def _first_of(nodes: Column, *paths: str) -> Column:
    return F.get(F.filter(F.transform(nodes, lambda n: _json(n, *paths)), lambda v: v.isNotNull()), F.lit(0))


def _last_of(nodes: Column, *paths: str) -> Column:
    return F.try_element_at(F.filter(F.transform(nodes, lambda n: _json(n, *paths)), lambda v: v.isNotNull()), F.lit(-1))


def _brand(node: Column) -> Column:
    brand = F.get_json_object(node, "$.brand")
    return F.when(brand.startswith("{"), F.get_json_object(node, "$.brand.name")).otherwise(brand)


def _offer(node: Column) -> Column:
    offers = F.get_json_object(node, "$.offers")
    return F.when(offers.startswith("["), F.get(F.from_json(offers, "array<string>"), F.lit(0))).otherwise(offers)


def _images(node: Column) -> Column:
    image = F.get_json_object(node, "$.image")
    empty = F.array().cast("array<string>")
    urls = (
        F.when(image.startswith("["), F.coalesce(F.from_json(image, "array<string>"), empty))
        .when(image.startswith("{"), F.array(F.get_json_object(node, "$.image.url")))
        .when(image.isNotNull(), F.array(image))
        .otherwise(empty)
    )
    return F.filter(urls, lambda u: u != "")


@lru_cache(maxsize=1)
def _structured_columns() -> list[list[Column]]:
    html = F.col("html")
    docs = [F.col("*"), H.ld_documents(html).alias("_docs"), H.metas(html).alias("_metas")]
    nodes = [F.col("*"), H.ld_products(F.col("_docs")).alias("_nodes")]
    offers = [
        F.col("*"),
        F.filter(F.transform("_nodes", _offer), lambda o: o.startswith("{")).alias("_offers"),
    ]
    n, o, m = F.col("_nodes"), F.col("_offers"), F.col("_metas")
    meta_price = F.get(H.meta_values(m, "product:price:amount"), F.lit(0))
    meta_brand = F.get(H.meta_values(m, "product:brand"), F.lit(0))
    last = F.lit(-1)
    ld_price = _last_of(o, "$.price")
    links = F.regexp_extract_all(html, F.lit(rx(r"<link\b[^>]*\brel\s*=\s*[\"']canonical[\"'][^>]*>", "is")), F.lit(0))
    out = [
        _first_of(n, "$.name").alias("name"),
        _first_of(n, "$.description").alias("description"),
        _first_of(n, "$.sku").alias("sku"),
        _first_of(n, "$.gtin13", "$.gtin", "$.gtin8", "$.mpn").alias("gtin"),
        F.coalesce(
            strip_to_null(F.try_element_at(F.filter(F.transform(n, _brand), lambda b: b.isNotNull()), last)), meta_brand
        ).alias("brand"),
        F.coalesce(ld_price, meta_price).alias("price"),
        F.when(F.size(o) > 0, F.coalesce(_last_of(o, "$.priceCurrency"), F.lit("INR"))).alias("currency"),
        _last_of(o, "$.availability").alias("availability"),
        _last_of(o, "$.seller.name", "$.seller").alias("seller"),
        F.flatten(F.transform(n, _images)).alias("image_urls"),
        F.try_element_at(H.meta_values(m, "og:title"), last).alias("og_title"),
        H.meta_values(m, "og:image").alias("og_images"),
        F.try_element_at(H.meta_values(m, "og:description"), last).alias("og_description"),
        blank_to_null(H.attribute(F.get(links, F.lit(0)), "href")).alias("canonical_url"),
    ]
    return [docs, nodes, offers, out]


STRUCTURED_FIELDS = (
    "name", "description", "sku", "gtin", "brand", "price", "currency", "availability", "seller",
    "image_urls", "og_title", "og_images", "og_description", "canonical_url",
)


def structured_data(pages: DataFrame, prefix: str = "") -> DataFrame:
    """JSON-LD product, OpenGraph and canonical link of each page, as columns after the input's."""
    steps = _structured_columns()
    out = pages
    for step in steps[:-1]:
        out = out.select(*step)
    return out.select(*pages.columns, *[c.alias(prefix + n) for c, n in zip(steps[-1], STRUCTURED_FIELDS)])


# ---- marketplace records


def is_relevant_key(adapter: str, key: Column) -> Column:
    """Whether a table key belongs to the declarations of interest."""
    low = F.lower(key)
    hit = low.rlike(any_of(M.COMPLIANCE_KEYS[adapter]))
    skipped = M.SKIPPED_KEYS.get(adapter)
    return hit & ~low.rlike(any_of(skipped)) if skipped else hit


def _relevant(adapter: str, rows: Column) -> Column:
    return F.filter(rows, lambda r: is_relevant_key(adapter, r["key"]))


def spec_pairs(html: Column) -> Column:
    """Label and value pairs of two-child blocks and of bold labels followed by text.

    Blocks whose children are themselves nested are not seen.
    """
    two = r"<(?:div|li|p)\b[^>]*>\s*<[a-z0-9]+\b[^>]*>([^<]+)</[a-z0-9]+>\s*<[a-z0-9]+\b[^>]*>([^<]+)</[a-z0-9]+>\s*</(?:div|li|p)>"
    bold = r"<(?:strong|b|span|dt)\b[^>]*>([^<]+)</(?:strong|b|span|dt)\s*>\s*(?:<[a-z][^>]*>\s*)?([^<]+)"

    def pairs(pattern: str, chars: str) -> Column:
        return F.transform(
            F.regexp_extract_all(html, F.lit(rx(pattern, "i")), F.lit(0)),
            lambda m: F.struct(
                F.btrim(strip(H.decode(F.regexp_extract(m, rx(pattern, "i"), 1))), F.lit(chars)).alias("key"),
                strip(H.decode(F.regexp_extract(m, rx(pattern, "i"), 2))).alias("value"),
            ),
        )

    return F.filter(F.concat(pairs(two, ": "), pairs(bold, ":")), lambda r: (r["key"] != "") & (r["value"] != ""))


def state_text(html: Column) -> Column:
    """Keys and values of the JSON state embedded in scripts, joined by blanks.

    A state object runs to the last brace of its script; one that does not parse is ignored.
    """

    def blob(script: Column) -> Column:
        body = strip(script)
        found = F.regexp_extract(body, rx(M.STATE_PREFIXES, "s"), 1)
        return (
            F.when(found != "", found)
            .when(body.startswith("{"), body)
            .otherwise("")
        )

    # both escapes become one control character each, so that a string is a flat class of characters
    token = r'"[^"]*"|-?\d+(?:\.\d+)?'
    masked = lambda b: F.replace(F.replace(b, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    shown = lambda t: F.replace(F.replace(t, F.lit("\x01"), F.lit("\\\\")), F.lit("\x02"), F.lit('\\"'))
    scripts = F.regexp_extract_all(html, F.lit(rx(H.SCRIPT, "is")), F.lit(1))
    blobs = F.filter(F.transform(scripts, blob), lambda b: (b != "") & F.try_parse_json(b).isNotNull())
    tokens = F.flatten(F.transform(blobs, lambda b: F.regexp_extract_all(masked(b), F.lit(token), F.lit(0))))
    return F.array_join(F.transform(tokens, lambda t: F.replace(shown(F.btrim(t, F.lit('"'))), F.lit("\\/"), F.lit("/"))), " ")


# Rows that name a maker, best first.
MAKER_KEYS = ["Manufacturer Name", "Manufacturer", "Marketed by", "Manufactured by", "Manufacturer Details", "Packer", "Packed by", "Manufacturer Address"]
# where specifications stand in a page
SPEC_BLOCK = (["div"], H.by_class(M.SPEC_CLASSES))
SPEC_SECTION = (["section", "article"], "")


def spec_texts(html: Column) -> Column:
    """Texts of specification blocks and sections that mention a declaration, one per line."""
    def texts(which: tuple, words: list[str]) -> Column:
        found = F.transform(H.elements(html, *which), lambda b: H.node_text(b, "\n"))
        return F.filter(found, lambda t: F.lower(t).rlike(any_of(words)))

    return F.array_join(
        F.concat(texts(SPEC_BLOCK, M.COMPLIANCE_KEYS["flipkart"]), texts(SPEC_SECTION, M.SECTION_WORDS)), "\n"
    )


def compliance_paragraphs(html: Column) -> Column:
    """Blocks that mention a declaration, in page order.

    Blocks end at the first closing tag, so of nested blocks the innermost text is seen once.
    """
    clean = H.without(html, M.CLEAN_TAGS)
    block = r"<(?:p|li|div|span)\b[^>]*>(.*?)</(?:p|li|div|span)\s*>"
    texts = F.transform(F.regexp_extract_all(clean, F.lit(rx(block, "is")), F.lit(1)), H.node_text_item)
    return F.filter(texts, lambda t: F.lower(t).rlike(any_of(M.COMPLIANCE_KEYS["generic"])))


def next_data(html: Column) -> Column:
    pattern = r"<script\b[^>]*\bid\s*=\s*[\"']__(?:NEXT|NUXT)_DATA__[\"'][^>]*>(.*?)</script\s*>"
    body = strip(F.regexp_extract(html, rx(pattern, "is"), 1))
    return bind(body, lambda b: F.when(F.try_parse_json(b).isNotNull(), b))


def product_details(html: Column) -> Column:
    """Titled product details routed to fields: ``array<struct<field,content>>`` in page order."""

    def route(title: Column) -> Column:
        chain = None
        for field, pattern in M.DETAIL_ROUTES:
            cond = title.rlike(pattern)
            chain = F.when(cond, field) if chain is None else chain.when(cond, field)
        return chain

    blocks = F.regexp_extract_all(html, F.lit(rx(M.PRODUCT_DETAILS, "s")), F.lit(1))
    parsed = F.flatten(
        F.transform(
            blocks,
            lambda b: F.coalesce(
                F.from_json(b, "array<struct<title:string,content:string>>"),
                F.array().cast("array<struct<title:string,content:string>>"),
            ),
        )
    )
    routed = F.transform(
        parsed,
        lambda i: F.struct(
            bind(F.lower(strip(F.coalesce(i["title"], F.lit("")))), route).alias("field"),
            strip(F.coalesce(i["content"], F.lit(""))).alias("content"),
        ),
    )
    return F.filter(routed, lambda i: ~F.lower(i["content"]).isin("", "n/a", "na") & i["field"].isNotNull())


def titled_name(html: Column) -> Column:
    """Product name inside a "Buy … from/at …" page title."""

    def clean(c: Column) -> Column:
        return strip(replace_all(strip(c), r"\s*\|\s*Myntra\s*$", ""))

    def bought(c: Column, pattern: str) -> Column:
        return strip_to_null(F.regexp_extract(c, rx(pattern), 1))

    og = clean(F.regexp_extract(html, rx(r'<meta[^>]+property="og:title"[^>]+content="([^"]+)"'), 1))
    tw = clean(F.regexp_extract(html, rx(r'<meta[^>]+name="twitter:title"[^>]+content="([^"]+)"'), 1))
    title = strip(F.regexp_extract(html, rx(r"<title>([^<]+)</title>"), 1))
    usable = lambda c: F.when(~F.lower(c).isin("", "default"), c)
    return F.coalesce(
        bind(
            og,
            lambda c: F.coalesce(
                bought(c, r"^Buy\s+(.+?)\s*(?:\s*-\s*\w+\s*for\s+|\s*from\s+|\s*at\s+Rs)"), usable(c)
            ),
        ),
        bind(tw, usable),
        bought(title, r"^Buy\s+(.+?)\s*(?:\s*-\s*|\s*from\s+|\s*at\s+)"),
    )


def _title(adapter: str) -> Column:
    patterns = M.TITLE.get(adapter, M.TITLE["generic"])
    return F.coalesce(*[H.element_text(F.col("html"), p) for p in patterns])


def _by_adapter(choices: dict[str, Column]) -> Column:
    chain = None
    for adapter, value in choices.items():
        cond = F.col("_adapter") == adapter
        chain = F.when(cond, value) if chain is None else chain.when(cond, value)
    return chain


def _typed_docs() -> Column:
    return F.filter(
        "_docs", lambda d: F.coalesce(F.get_json_object(d, "$.@type"), F.lit("")).isin("Product", "ItemPage", "FoodProduct")
    )


def _bullet_with(words: list[str]) -> Column:
    return F.get(F.filter("_bullets", lambda b: F.lower(b).rlike(any_of(words))), F.lit(0))


def _source(step: tuple) -> Column:
    kind = step[0]
    rows, corpus, html = F.col("_rows"), F.col("_corpus"), F.col("html")
    if kind == "rows":
        return bind(rows, lambda r: strip_to_null(strip(H.first_row_value(r, step[1]))))
    if kind == "licence_rows":
        return bind(
            rows,
            lambda r: F.coalesce(
                *[
                    F.regexp_substr(F.regexp_replace(H.row_value(r, k), rx(r"\s", ""), ""), F.lit(rx(LICENCE, "")))
                    for k in step[1]
                ]
            ),
        )
    if kind == "number_rows":
        return bind(
            rows,
            lambda r: F.coalesce(
                *[
                    F.regexp_replace(F.regexp_substr(H.row_value(r, k), F.lit(rx(r"[\d,]+\.?\d{0,2}", ""))), ",", "")
                    for k in step[1]
                ]
            ),
        )
    if kind in ("text", "html"):
        return bind(
            corpus if kind == "text" else html, lambda t: strip_to_null(F.regexp_extract(t, rx(step[1], step[2]), 1))
        )
    if kind == "plain":
        return bind(corpus, lambda t: strip_to_null(F.regexp_replace(F.regexp_extract(t, rx(step[1], step[2]), 1), ",", "")))
    if kind == "whole":
        return bind(corpus, lambda t: strip_to_null(F.regexp_extract(t, rx(step[1], step[2]), 0)))
    if kind == "sane_price":
        return bind(
            F.regexp_replace(F.regexp_extract(corpus, rx(step[1], ""), 1), ",", ""),
            lambda p: F.when(p.try_cast("double").between(1, 100000), p),
        )
    return F.col("_" + step[1])


@lru_cache(maxsize=1)
def _record_columns() -> list[list[Column]]:
    html, adapter = F.col("html"), F.col("_adapter")
    star = F.col("*")
    s0 = [
        star,
        F.when(F.col("platform.adapter_key").isin(*M.ADAPTERS), F.col("platform.adapter_key"))
        .otherwise("generic")
        .alias("_adapter"),
        H.node_text(html).alias("_text"),
    ]
    empty_rows = F.array().cast("array<struct<key:string,value:string>>")
    s1 = [
        star,
        F.when(~adapter.isin(*M.NO_ROWS), H.table_rows(html)).otherwise(empty_rows).alias("_table"),
        F.when(adapter.isin("jiomart", "generic"), H.ld_documents(html)).alias("_docs"),
        F.when(adapter.isin("meesho", "generic"), next_data(html)).alias("_next"),
        F.when(
            adapter == "amazon",
            H.items(F.coalesce(H.section(html, "feature-bullets"), F.lit(""))),
        ).alias("_bullets"),
        F.when(
            adapter == "amazon",
            F.flatten(
                F.array(
                    *[
                        H.key_value_items(F.coalesce(H.section(html, i), F.lit("")))
                        for i in M.DETAIL_IDS
                    ]
                )
            ),
        ).alias("_detail_items"),
        F.when(adapter == "myntra", product_details(html)).alias("_details"),
        F.when(adapter == "flipkart", state_text(html)).alias("_state"),
        F.when(adapter == "flipkart", spec_texts(html)).alias("_specs"),
    ]
    known = F.transform("_table", lambda r: r["key"])
    s2 = [
        star,
        F.when(
            adapter == "amazon",
            F.concat("_table", F.reverse(F.filter("_detail_items", lambda r: ~F.array_contains(known, r["key"])))),
        )
        .when(adapter == "jiomart", F.concat("_table", F.reverse(spec_pairs(html))))
        .otherwise(F.col("_table"))
        .alias("_rows"),
        F.when(adapter == "flipkart", F.concat_ws("\n", "_text", F.concat(F.lit(" "), F.col("_state")), "_specs"))
        .when(adapter == "jiomart", F.concat("_text", F.lit("\n "), F.array_join("_docs", " ")))
        .otherwise(F.col("_text"))
        .alias("_corpus"),
    ]

    def doc(path: str) -> Column:
        return bind(
            F.when(adapter == "jiomart", _typed_docs()).otherwise(F.col("_docs")), lambda d: _first_of(d, path)
        )

    def next_value(pattern: str, path: str, last: bool = False) -> Column:
        found = F.regexp_extract_all("_next", F.lit(rx(pattern, "s")), F.lit(1))
        picked = F.try_element_at(found, F.lit(-1 if last else 1))
        exact = F.coalesce(
            *[F.get_json_object("_next", f"$.props.pageProps.{p}.{path}") for p in ("product", "productDetails")]
        )
        return bind(F.when(adapter == "meesho", exact).otherwise(picked), strip_to_null)

    def named_manufacturer(rows: Column) -> Column:
        shared = H.row_value(rows, "Manufacturer Address")
        arms = []
        for k in MAKER_KEYS:
            val = H.row_value(rows, k)
            own = shared if "Name" in k else F.coalesce(H.row_value(rows, f"{k} Address"), shared)
            extra = F.when(~val.contains(own), F.concat(F.lit(", "), own))
            arms.append(F.concat(val, F.coalesce(extra, F.lit(""))))
        return F.coalesce(*arms)

    size = strip(F.regexp_extract(html, rx(r'"brandSize"\s*:\s*"([^"]+)"', ""), 1))
    stated = F.regexp_extract(html, rx(r'"countryOfOrigin"\s*:\s*"([^"]{2,})"', ""), 1)
    s3 = [
        star,
        F.coalesce(*[F.when(adapter == a, _title(a)) for a in M.ADAPTERS]).alias("_title"),
        F.when(adapter.isin("jiomart", "generic"), doc("$.name")).alias("_ld_name"),
        F.when(adapter == "jiomart", bind(_typed_docs(), lambda d: F.get(F.transform(d, _brand), F.lit(0)))).alias("_ld_brand"),
        F.when(adapter == "jiomart", doc("$.description")).alias("_ld_description"),
        F.when(adapter.isin("jiomart", "generic"), bind(F.col("_docs"), lambda d: _first_of(d, "$.offers.price"))).alias("_ld_price"),
        F.coalesce(
            next_value(r'"productName"\s*:\s*"([^"]+)"', "name"), next_value(r'"name"\s*:\s*"([^"]{6,})"', "name")
        ).alias("_next_name"),
        next_value(r'"brand"\s*:\s*"([^"]+)"', "brand", last=True).alias("_next_brand"),
        next_value(r'"mrp"\s*:\s*"?([^",}\]]+)', "mrp", last=True).alias("_next_mrp"),
        F.when(adapter == "meesho", next_value(r'"description"\s*:\s*"([^"]+)"', "description")).alias("_next_description"),
        F.when(adapter == "amazon", _bullet_with(M.BULLET_MANUFACTURER)).alias("_bullet_manufacturer"),
        F.when(adapter == "amazon", _bullet_with(["packed by"])).alias("_bullet_packer"),
        F.when(
            adapter == "amazon",
            F.get(
                F.filter(
                    F.transform("_bullets", lambda b: strip(F.regexp_extract(b, rx(M.BULLET_COUNTRY), 1))),
                    lambda v: v != "",
                ),
                F.lit(0),
            ),
        ).alias("_bullet_country"),
        F.when(
            adapter == "amazon",
            H.node_text(F.coalesce(H.section(html, "productDescription"), F.lit("")), "\n"),
        ).alias("_description_block"),
        F.when(
            adapter == "amazon",
            H.node_text(F.coalesce(*[H.section(html, i) for i in M.PRICE_IDS], F.lit(""))),
        ).alias("_price_block_text"),
        F.when(adapter == "jiomart", bind(F.col("_rows"), named_manufacturer)).alias("_named_manufacturer"),
        F.when(adapter == "myntra", titled_name(html)).alias("_titled_name"),
        F.when(adapter == "myntra", bind(F.lower(F.regexp_extract(size, rx(M.SIZE_QUANTITY), 0)), blank_to_null)).alias("_size_quantity"),
        F.when(
            adapter == "myntra", bind(stated, lambda c: F.when(~F.lower(c).isin("", "country of origin"), c))
        ).alias("_stated_country"),
    ]
    for field in dict.fromkeys(f for f, _ in M.DETAIL_ROUTES):
        s3.append(
            F.get(F.transform(F.filter("_details", _routed_to(field)), lambda i: i["content"]), F.lit(0)).alias(f"_detail_{field}")
        )

    s4 = [star]
    for field in RECORD_ORDER:
        choices = {
            a: F.coalesce(*[_source(step) for step in spec[field] if step != ("column", "party_phone")])
            for a, spec in M.FIELDS.items()
            if field in spec
        }
        s4.append(_by_adapter(choices).alias(f"_f_{field}"))

    phone = F.coalesce(
        *[
            strip_to_null(F.regexp_extract(f"_f_{p}", rx(M.AMAZON_PHONE, ""), 0))
            for p in ("packer_raw", "manufacturer_raw", "importer_raw")
        ]
    )
    rows_of = F.coalesce(
        *[
            F.when(adapter == a, _relevant(a, F.col("_rows")))
            for a in ("amazon", "flipkart", "jiomart", "generic")
        ],
        F.col("_rows"),
    )
    s5 = [
        *[
            blank_to_null(
                F.when(adapter == "amazon", F.coalesce(phone, F.col("_f_consumer_care_phone"))).otherwise(
                    F.col("_f_consumer_care_phone")
                )
                if f == "consumer_care_phone"
                else F.col(f"_f_{f}")
            ).alias(f)
            for f in RECORD_ORDER
        ],
        H.rows_to_map(F.transform(rows_of, lambda r: F.struct(r["key"].alias("key"), r["value"].alias("value")))).alias("page_rows"),
        F.coalesce("_bullets", F.array().cast("array<string>")).alias("feature_bullets"),
        F.when(adapter == "generic", F.array_join(compliance_paragraphs(html), "\n")).alias("compliance_text"),
        F.col("_text").alias("page_text"),
        I.record_images(adapter, html, state_text(html)).alias("product_image_urls"),
    ]
    return [s0, s1, s2, s3, s4, s5]


RECORD_ORDER = M.RECORD_FIELDS


def _routed_to(field: str):
    return lambda i: i["field"] == field


def extract_pages(pages: DataFrame) -> DataFrame:
    """Product record of every page: platform, source, the record fields, ``page_rows`` map,

    ``feature_bullets``, ``compliance_text``, ``page_text`` and ``product_image_urls``.  Input needs ``page_id, url, html``;
    further columns are carried along.
    """
    steps = _record_columns()
    carry = [c for c in pages.columns if c not in ("page_id", "url", "html")]
    out = pages.select("*", U.detect_platform(F.col("url")).alias("platform"))
    for step in steps[:-1]:
        out = out.select(*step)
    source = {"amazon": "Amazon", "flipkart": "Flipkart", "jiomart": "JioMart", "myntra": "Myntra", "meesho": "Meesho"}
    label = F.coalesce(*[F.when(F.col("_adapter") == a, F.lit(n)) for a, n in source.items()], F.lit("Generic"))
    return out.select(
        "page_id", "url", F.col("platform.platform").alias("platform"), F.col("platform.display_name").alias("display_name"),
        label.alias("source"), *steps[-1], *carry,
    )


# ---- listing texts (the older, text-only reading of a page)


# Facts looked for in the text of a listing (key, pattern, flags), its price, and where a page's main part is.
LISTING_SCAN = [
    ("Country of Origin", r"Country\s+of\s+Origin\s*[:\-]?\s*([A-Za-z][A-Za-z\s]{2,}?)(?:\s*\n|\s{2,}|$|\|)", "i"),
    ("FSSAI Lic No", r"\b([1-9]\d{13})\b", ""),
    ("Best Before", r"(?:shelf\s*life|best\s*before|expiry)[:\s]*([^\n\|]{4,60}[^\n|.;]*)", "i"),
    ("Mfg Date", r"(?:Mfg\.?\s*Date|Date\s*of\s*Manufacture|Manufacturing\s*Date)[:\s]+([^\n\|]{4,30}[^\n|.;]*)", "i"),
]
LISTING_MRP = r"M\.?R\.?P\.?\s*[:\s₹Rs.]*\s*([\d,]+\.?\d{0,2})"
LISTING_MAIN = (r"<main\b[^>]*>(.*)</main\s*>", r"<article\b[^>]*>(.*?)</article\s*>", r"<body\b[^>]*>(.*)</body\s*>")


def listing_texts(pages: DataFrame, max_text: int | None = None) -> DataFrame:
    """``product_name`` and compliance text of each page, built per marketplace.

    ``max_text`` cuts the page text of the generic form (default: whole text).
    """
    html = F.col("html")
    base = pages.select(
        "page_id", "url", "html", U.detect_marketplace(F.col("url")).alias("marketplace"),
        F.length("html").alias("raw_html_length"), H.node_text(html).alias("_text"), H.table_rows(html).alias("_table"),
    )
    amazon, flipkart = F.col("marketplace") == "Amazon", F.col("marketplace") == "Flipkart"
    text = F.col("_text")
    pairs = F.flatten(
        F.array(*[H.key_value_items(F.coalesce(H.section(html, i), F.lit(""))) for i in M.DETAIL_IDS[:3]])
    )

    def found(key: str, pattern: str, flags: str) -> Column:
        value = strip(F.regexp_extract(text, rx(pattern, flags), 1))
        return F.when(value != "", F.struct(F.lit(key).alias("key"), value.alias("value")))

    scanned = F.array_compact(F.array(*[found(*s) for s in LISTING_SCAN]))
    price_id = F.coalesce(*[H.section(html, i) for i in M.LISTING_PRICE_IDS])
    mrp = F.regexp_extract(text, rx(LISTING_MRP), 1)
    staged = base.select(
        "*",
        F.when(amazon, F.concat("_table", pairs, scanned)).otherwise(F.col("_table")).alias("_all"),
        F.when(amazon, F.coalesce(*[H.element_text(html, p) for p in M.TITLE["amazon"]]))
        .otherwise(H.element_text(html, M.TITLE["generic"][0]))
        .alias("_name"),
        F.when(
            amazon,
            F.coalesce(
                    blank_to_null(H.node_text(price_id)), F.when(mrp != "", F.concat(F.lit("MRP: Rs. "), mrp))
                ),
        ).alias("_price"),
    )
    rows = bind(F.col("_all"), lambda r: F.map_entries(H.rows_to_map(r)))
    always = [key for key, _, _ in LISTING_SCAN]

    def relevant(k: Column) -> Column:
        low = F.lower(k)
        keep = low.rlike(any_of(M.COMPLIANCE_KEYS["listing_text"]))
        return F.when(
            amazon, (keep | k.isin(*always)) & ~low.rlike(any_of(M.SKIPPED_KEYS["listing_text"]))
        ).otherwise(keep)

    lines = F.transform(
        F.filter(rows, lambda e: relevant(e["key"])),
        lambda e: F.concat(
            e["key"], F.lit(": "), F.when(amazon, e["value"]).otherwise(e["value"])
        ),
    )
    clean = H.without(html, M.CLEAN_TAGS[:6])
    main = bind(clean, lambda c: F.coalesce(*[bind(F.regexp_extract(c, rx(p, "is"), 1), blank_to_null) for p in LISTING_MAIN], c))
    page_text = H.node_text(main, "\n")
    if max_text is not None:
        page_text = F.substring(page_text, 1, max_text)
    blocks = F.transform(H.elements(html, ["div"], H.by_class("|".join(M.LISTING_CLASSES))), lambda b: H.node_text(b, "\n"))
    listing = F.concat_ws(
        "\n",
        F.concat(F.lit("Product: "), F.col("_name")),
        F.array_join(lines, "\n"),
        F.concat(F.lit("\nMRP: "), F.col("_price")),
        F.lit("\n" + M.LISTING_SOURCE),
        F.lit(M.LISTING_NOTE),
    )
    blank_free = lambda *parts: F.array_join(F.filter(F.concat(*parts), lambda p: p != ""), "\n\n")
    name = F.array(F.coalesce("_name", F.lit("")))
    body = (
        F.when(amazon, F.when(F.col("_name").isNull() & (F.size(lines) == 0) & F.col("_price").isNull(), H.node_text(clean, "\n")).otherwise(listing))
        .when(flipkart, blank_free(name, lines, blocks))
        .otherwise(blank_free(name, lines, F.array(page_text)))
    )
    return staged.select(
        "page_id", "marketplace", F.col("_name").alias("product_name"), strip(collapse_newlines(body)).alias("extracted_text"),
        "raw_html_length",
    )


__all__ = [
    "extract_pages", "structured_data", "listing_texts", "page_table", "is_relevant_key", "spec_pairs", "state_text",
    "spec_texts", "compliance_paragraphs", "next_data", "product_details", "titled_name",
]
