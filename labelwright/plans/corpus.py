"""Label, page, image and detection corpora derived from the star-schema tables.

No given table holds label text, so these views turn parts, suppliers, orders
and line items into labels, product pages, image candidates and OCR words.  The
row counts follow the base tables.  Each view is one SQL text that Spark and the
checking database both understand; ``{name}`` marks a base table.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(key: str, modulus: int, values: dict[int, str]) -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in values.items())
    return f"CASE {key} % {modulus} {arms} END"


_PRICE = "CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING)"
_COMPANY = "substr(s_name, 1, 8) || ' ' || CAST(k % 97 AS STRING)"
_MONTH = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(3 * extract(month FROM made) - 2 AS INT), 3)"
_MM = "lpad(CAST(extract(month FROM made) AS STRING), 2, '0')"
_YYYY = "CAST(extract(year FROM made) AS STRING)"
_NEXT = "CAST(extract(year FROM made) + 1 AS STRING)"
_PIN = "CAST(400000 + k % 99999 AS STRING)"
_LICENCE = "CAST(10000000000000 + (k * 790123457) % 89999999999999 AS STRING)"

# what each line of a label can say, by key modulo a prime, so that every verdict occurs
LABEL_LINES = {
    "product": _case("k", 5, {0: "NULL", 1: "'Product: ' || p_name", 2: "'Product Name - ' || p_name",
                              3: "'Item: ' || p_name", 4: "'Brand: ' || replace(p_brand, '#', ' ') || ' Select'"}),
    "party": _case("k", 11, {
        0: f"'Manufactured by: ' || {_COMPANY} || ' Foods Private Limited'",
        1: f"'Mfd by ' || {_COMPANY} || ' Agro Industries'",
        2: f"'Packed by: ' || {_COMPANY} || ' Packers'",
        3: f"'Imported by: ' || {_COMPANY} || ' Traders Ltd.'",
        4: f"'Manufacturer: ' || {_COMPANY} || ' Dairy'",
        5: f"'Mkt. By: ' || {_COMPANY} || ' Wellness LLP'",
        6: f"'Manufactured & Marketed By: ' || {_COMPANY} || ' Healthcare Pvt. Ltd.'",
        7: f"'Imported and Marketed by: ' || {_COMPANY} || ' Solutions'",
        8: f"'Manufactured by:' || chr(10) || {_COMPANY} || chr(10) || 'Snack Division'",
        9: f"'Manufacturer Contact Information: ' || {_COMPANY} || ' Enterprises'"}),
    "address": _case("k", 7, {
        0: f"'Address: Plot 12, Industrial Area, Pune, Maharashtra - ' || {_PIN}",
        1: f"'Survey No. 45, Village Road, Surat - ' || {_PIN} || ', Gujarat, India'",
        2: f"'Block K56, Kakina-' || {_PIN} || ', Udupi, Karnataka, India.'",
        3: "'Via Roma 5, Milano, Italy'",
        4: f"'165/166, Backbay Road, Mumbai - ' || {_PIN}",
        5: f"'Gate 4, Shed 9, Solan, HP ' || {_PIN}"}),
    "quantity": _case("k", 9, {
        0: "'Net Weight: ' || CAST(p_size AS STRING) || ' g'", 1: "'Net Qty: ' || CAST(p_size AS STRING) || '.5 kg'",
        2: "'Net Volume: ' || CAST(p_size * 25 AS STRING) || ' ml'", 3: "CAST(p_size AS STRING) || ' Tablets'",
        4: "'Net Content: ' || CAST(p_size AS STRING) || ' L'", 5: "'NET WT: 1,' || CAST(100 + p_size AS STRING) || ' gms'",
        6: "'Unit Count: ' || CAST(p_size AS STRING) || ' count'", 7: "'Quantity: .5 kg'"}),
    "made": _case("k", 8, {
        0: f"'Mfg Date: ' || {_MONTH} || ' ' || {_YYYY}", 1: f"'Mfg. Date: ' || {_MM} || '/' || {_YYYY}",
        2: f"'Packed on: 15/' || {_MM} || '/' || {_YYYY}", 3: f"'Mfd: 15.' || {_MM} || '.' || {_YYYY}",
        4: f"'Date of Mfg: ' || {_YYYY} || '/' || {_MM}", 5: f"'Manufactured on: ' || {_MONTH} || '. ' || {_YYYY}",
        6: f"'Mfg Date: 05-' || {_MM} || '-' || {_YYYY}"}),
    "expiry": _case("k", 6, {
        0: "'Best Before: 12 Months from manufacturing'", 1: f"'Best Before: ' || {_MONTH} || ' ' || {_NEXT}",
        2: f"'Expiry Date: ' || {_MM} || '/' || {_NEXT}", 3: f"'Use By: 15/' || {_MM} || '/' || {_NEXT}",
        4: "'Shelf Life: 24 months'"}),
    "batch": _case("k", 4, {1: "'Batch No. B' || CAST(k AS STRING) || '/A'", 3: "'Lot No: L-' || CAST(k AS STRING)"}),
    "price": _case("k", 10, {
        0: f"'MRP: Rs. ' || {_PRICE} || ' (Incl. of all taxes)'", 1: f"'MRP (incl. taxes) ₹ ' || {_PRICE}",
        2: "'MRP Rs. 1,' || CAST(200 + p_size AS STRING)", 3: f"'₹' || {_PRICE}",
        4: f"'Price: Rs. ' || {_PRICE}", 5: f"'M.R.P. ' || {_PRICE}",
        6: f"'Maximum Retail Price: INR ' || {_PRICE}", 7: "'MRP: see pack'"}),
    "care": _case("k", 7, {
        0: "'Consumer Care: 1800 425 1000 | care@brand' || CAST(k % 13 AS STRING) || '.com'",
        1: "'Helpline: +91 98765' || CAST(43000 + k % 999 AS STRING)",
        2: "'Email: help.desk@brand' || CAST(k % 13 AS STRING) || '.co.in'", 3: "'Toll Free 1800-425-1000'",
        4: "'Customer Care Executive: write to us at the above address'"}),
    "origin": _case("k", 9, {
        0: "'Country of Origin: India'", 1: "'Made in Italy'", 2: "'Product of Sri Lanka.'",
        3: "'Country of Origin' || chr(10) || 'India'", 4: "'Origin: Nepal'",
        5: "'Country of Origin: ' || upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2, 5)) || 'land | Imported'",
        6: "'Manufactured in: Thailand, sold by the thousand'"}),
    "licence": _case("k", 8, {
        0: f"'FSSAI Lic No.: ' || {_LICENCE}", 1: f"'FSSAI ' || {_LICENCE}",
        2: f"'Lic. No. ' || substr({_LICENCE}, 1, 4) || ' ' || substr({_LICENCE}, 5, 4) || ' ' || substr({_LICENCE}, 9, 4) || ' ' || substr({_LICENCE}, 13, 2)",
        3: _LICENCE, 4: "'Licence No: AB' || CAST(1000000000 + k AS STRING)",
        5: f"'8901' || CAST(100000000 + k AS STRING)"}),
    "ingredients": _case("k", 6, {
        0: "'INGREDIENTS: Rolled Oats (25%), Wheat Flakes (20%), Sugar, Salt.'",
        1: "'COMPOSITION: Wheat Flour, Edible Oil, Salt and'",
        2: "'MADE FROM: Oats, Wheat, Ragi, Jowar, Almonds,'",
        3: "'Ingredients - Sugar, Cocoa Solids, Milk Solids   and   Emulsifier 322' || chr(10) || 'NUTRITION FACTS: Calories 200, Total Fat 5g'",
        4: "'CONTAINS: Milk Solids, Sugar, Wheat Gluten, Permitted Emulsifier and Added Flavour'"}),
    "allergen": _case("k", 5, {
        0: "'ALLERGEN INFORMATION: Contains wheat and milk.'", 2: "'May contain traces of nuts.'"}),
    "storage": _case("k", 4, {
        0: "'STORAGE INSTRUCTIONS: Keep in a cool dry place'", 2: "'Store in an airtight container. Keep dry.'"}),
    "veg": _case("k", 6, {0: "'Vegetarian'", 1: "'Non-Veg product'", 2: "'100% Natural, pure veg'"}),
    "listing": _case("k", 4, {0: "'Source: Amazon e-commerce listing (online marketplace)'"}),
}
_TEXT = "concat_ws(chr(10), " + ", ".join(LABEL_LINES.values()) + ")"
_TEXT_BLOCKS = (
    "concat_ws(chr(10), "
    + ", ".join(v for k, v in LABEL_LINES.items() if k in ("product", "party", "address"))
    + ", CASE WHEN k % 3 = 0 THEN '' END, "
    + ", ".join(v for k, v in LABEL_LINES.items() if k not in ("product", "party", "address"))
    + ")"
)
_PLATFORM = _case("k", 12, {
    0: "'Amazon'", 1: "'Amazon'", 2: "'Amazon'", 3: "'Amazon'", 4: "'Flipkart'", 5: "'Flipkart'",
    6: "'JioMart'", 7: "'Myntra'", 8: "'Meesho'", 9: "'BigBasket'", 10: "'Nykaa'", 11: "NULL"})

# one label per order: (record_id, text, source_type, product_name, category, platform, created_at)
ORDER_LABELS = f"""
SELECT CAST(k AS STRING) AS record_id, {_TEXT} AS text,
       CASE k % 4 WHEN 0 THEN 'URL' WHEN 1 THEN 'IMAGE' WHEN 2 THEN 'CSV' ELSE 'TEXT' END AS source_type,
       CASE WHEN k % 3 = 0 THEN p_name END AS product_name,
       CASE WHEN k % 10 = 9 THEN NULL ELSE p_type END AS category,
       {_PLATFORM} AS platform, made AS created_at
FROM (
  SELECT o_orderkey AS k, o_orderdate AS made, p_name, p_brand, p_type, p_size, p_retailprice, s_name, n_name
  FROM {{orders}} o
  JOIN (SELECT l_orderkey, min(l_partkey) AS pk, min(l_suppkey) AS sk FROM {{lineitem}} GROUP BY l_orderkey) l
    ON o.o_orderkey = l.l_orderkey
  JOIN {{part}} p ON p.p_partkey = l.pk
  JOIN {{supplier}} s ON s.s_suppkey = l.sk
  JOIN {{nation}} n ON n.n_nationkey = s.s_nationkey
) b"""

#: Parts of the products, pages and image candidates for each core.
PARTS_A_CORE = 8

_PRODUCTS = """
  SELECT p_partkey AS k, made, p_name, p_brand, p_type, p_size, p_retailprice, s_name, n_name
  FROM {part} p
  JOIN (SELECT l_partkey, min(l_suppkey) AS sk, max(l_shipdate) AS made FROM {lineitem} GROUP BY l_partkey) l
    ON p.p_partkey = l.l_partkey
  JOIN {supplier} s ON s.s_suppkey = l.sk
  JOIN {nation} n ON n.n_nationkey = s.s_nationkey
"""

# one label per product: (product_id, text)
PRODUCT_LABELS = f"""
SELECT CAST(k AS STRING) AS product_id, {_TEXT_BLOCKS} AS text, {_PLATFORM} AS platform
FROM ({_PRODUCTS}) b"""

# labels of products followed by the free texts, for jobs that read any text
ANY_TEXT = f"""
SELECT 'P' || product_id AS id, text FROM ({PRODUCT_LABELS}) q
UNION ALL
SELECT 'D' || CAST(doc_id AS STRING) AS id, text FROM {{documents}} d"""

# short raw values for the scalar normalisers, one row per line item
RAW_VALUES = f"""
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING)
         || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING) AS id,
  {_case("l_orderkey", 8, {
      0: "CAST(CAST(l_quantity AS INT) AS STRING) || ' g'", 1: "CAST(CAST(l_quantity AS INT) AS STRING) || '.5 kg'",
      2: "' 1,' || CAST(100 + l_linenumber AS STRING) || ' Litre '", 3: "CAST(CAST(l_quantity AS INT) AS STRING) || ' Tablets'",
      4: "CAST(CAST(l_quantity AS INT) AS STRING) || 'oz'", 5: "'about 2 lb'", 6: "'no quantity'",
      7: "'12345678 grams'"})} AS qty_a,
  {_case("l_partkey", 6, {
      0: "CAST(CAST(l_quantity AS INT) AS STRING) || '000 mg'", 1: "CAST(CAST(l_quantity AS INT) AS STRING) || ' kg'",
      2: "CAST(CAST(l_quantity AS INT) AS STRING) || ' gm'", 3: "''", 4: "CAST(CAST(l_quantity AS INT) AS STRING) || ' tabs'",
      5: "CAST(CAST(l_quantity AS INT) AS STRING) || ' ml'"})} AS qty_b,
  {_case("l_orderkey", 6, {
      0: "'Rs. ' || CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING)", 1: "'₹ 1,' || CAST(100 + l_linenumber AS STRING)",
      2: "CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING)", 3: "'free'", 4: "'₹'",
      5: "'MRP: ' || CAST(CAST(floor(l_extendedprice) AS INT) AS STRING) || '.5'"})} AS price_a,
  {_case("l_partkey", 4, {
      0: "CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING)", 1: "'INR ' || CAST(CAST(floor(l_extendedprice) AS INT) AS STRING)",
      2: "''", 3: "'₹ 1,' || CAST(100 + l_linenumber AS STRING)"})} AS price_b,
  {_case("l_orderkey", 7, {
      0: "'Jan 2025'", 1: "'3/2025'", 2: "'15/03/2025'", 3: "'15.03.2025'", 4: "'2025-07'",
      5: "'12 Months from manufacturing'", 6: "'Foo 2024 or 11-2023'"})} AS date_a,
  {_case("l_partkey", 5, {
      0: "'1001 4022 0027 11'", 1: "'1OO14O22OO27ll'", 2: "'100140220027' || CAST(10 + l_linenumber AS STRING)",
      3: "'0' || CAST(1000000000000 + l_orderkey AS STRING)", 4: "'1001S022002711'"})} AS licence_a
FROM {{lineitem}} l"""

# addresses, one row per order
ADDRESSES = f"""
SELECT CAST(k AS STRING) AS id,
  {_case("k", 9, {
      0: f"'Bolas Agro Private Limited, Ground Floor, Block K56, Kakina-' || {_PIN} || ', Udupi, Karnataka, India.'",
      1: f"'Manufactured by: ' || {_COMPANY} || ' Foods, Plot 12, Pune - ' || {_PIN} || ', Maharashtra'",
      2: f"{_COMPANY} || chr(10) || 'Via Roma 5' || chr(10) || 'Milano, Italy'",
      3: f"'Imported and Marketed by: ' || {_COMPANY} || ' Traders, MG Road, Bengaluru ' || {_PIN}",
      4: "'sold by the thousand, grow up fast'", 5: "''",
      6: f"'Unit 5, Shenzhen, China, Tel +91 9876543210'", 7: f"'PO Box ' || {_PIN}",
      8: "'J&K Traders, Srinagar, J&K, UK office'"})} AS address,
  {_case("k", 5, {0: "'India'", 1: "'China'", 2: "''", 3: "'Unknown'", 4: "NULL"})} AS mfr_country,
  {_case("k", 3, {0: "'India'", 1: "''", 2: "NULL"})} AS imp_country,
  {_case("k", 4, {0: "'India'", 1: "'Italy'", 2: "''", 3: "NULL"})} AS declared_country
FROM (
  SELECT o_orderkey AS k, s_name
  FROM {{orders}} o
  JOIN (SELECT l_orderkey, min(l_suppkey) AS sk FROM {{lineitem}} GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey
  JOIN {{supplier}} s ON s.s_suppkey = l.sk
) b"""


def _row(key: str, value: str) -> str:
    return f"'<tr><th>{key}:</th><td>' || {value} || '</td></tr>'"


_IMG_ID = "'61' || substr('ABCDEFGHIJ', CAST(1 + k % 9 AS INT), 2) || 'xyZ' || CAST(10000 + k AS STRING)"
_HOST = _case("k", 8, {
    0: "'https://www.amazon.in/Some-Oats/dp/B0' || CAST(10000000 + k AS STRING) || '?ref=sr_1&tag=x'",
    1: "'https://www.flipkart.com/item/p/itm' || CAST(k AS STRING)",
    2: "'https://www.jiomart.com/p/groceries/item/' || CAST(k AS STRING)",
    3: "'https://www.myntra.com/health-drinks/item/' || CAST(k AS STRING)",
    4: "'https://www.meesho.com/item/p/' || CAST(k AS STRING)",
    5: "'https://www.bigbasket.com/pd/' || CAST(k AS STRING)",
    6: "'https://shop.example.com/beauty/' || CAST(k AS STRING)",
    7: "'http://192.168.0.' || CAST(k % 250 AS STRING) || '/item'"})
_HTML = f"""concat(
  '<!DOCTYPE html><html><head><title>Buy ', p_name, ' online</title>',
  '<meta property="og:title" content="Buy ', p_name, ' from Store at Rs 99 | Myntra"/>',
  '<meta content="https://cdn.example.com/img/pack-front-', CAST(k AS STRING), '.jpg" property="og:image">',
  '<meta name="description" content="d"><meta property="og:description" content="A fine ', p_name, ' for all">',
  {_case("k", 3, {0: "'<meta property=\"product:price:amount\" content=\"' || " + _PRICE + " || '\"><meta property=\"product:brand\" content=\"MetaBrand\">'", 1: "''", 2: "''"})},
  '<link rel="canonical" href="https://shop.example.com/c/', CAST(k AS STRING), '">',
  {_case("k", 5, {
      0: "'<script type=\"application/ld+json\">{\"@type\":\"Product\",\"name\":\"' || p_name || '\",\"sku\":\"S' || CAST(k AS STRING) || '\",\"gtin13\":\"8901234567890\",\"brand\":{\"name\":\"LdBrand\"},\"offers\":{\"price\":' || " + _PRICE + " || ',\"priceCurrency\":\"INR\",\"seller\":{\"name\":\"LdSeller\"}},\"image\":[\"https://cdn.example.com/i/ld-' || CAST(k AS STRING) || '-back.jpg\"]}</script>'",
      1: "'<script type=\"application/ld+json\">[{\"@type\":\"BreadcrumbList\"},{\"@type\":[\"Thing\",\"FoodProduct\"],\"name\":\"List ' || p_name || '\",\"mpn\":\"M1\",\"brand\":\"PlainBrand\",\"offers\":[{\"price\":\"55.50\",\"availability\":\"InStock\"}],\"image\":\"https://cdn.example.com/i/one.png\"}]</script>'",
      2: "'<script type=\"application/ld+json\">{\"@graph\":[{\"@type\":\"WebSite\",\"name\":\"no\"},{\"@type\":\"Product\",\"name\":\"Graph ' || p_name || '\",\"description\":\"Graph text\",\"image\":{\"url\":\"https://cdn.example.com/i/g.webp\"}}]}</script>'",
      3: "'<script type=\"application/ld+json\">{broken json</script>'",
      4: "'<script type=\"application/ld+json\">' || repeat('{\"@graph\":[{\"@type\":\"WebSite\",\"name\":\"a ] b }\"},[', 8) || '{\"@type\":\"Product\",\"name\":\"Deep ' || p_name || '\",\"sku\":\"D1\",\"brand\":\"DeepBrand\",\"related\":{\"@type\":\"Product\"}}' || repeat(']]}', 8) || '</script>'"})},
  '<style>p {{ margin: 0 }}</style></head><body><nav><a href="/">Home</a></nav><main id="product-main">',
  '<span id="productTitle"> ', p_name, ' <span>&amp;</span> Co </span><h1>', p_name, '&nbsp;Pack</h1>',
  {_case("k", 4, {0: "'<div id=\"corePriceDisplay_desktop_feature_div\"><span>M.R.P.: ₹' || " + _PRICE + " || '</span></div>'",
                  1: "'<p>M.R.P. Rs. ' || " + _PRICE + " || '</p>'", 2: "'<p>₹' || " + _PRICE + " || '</p>'", 3: "''"})},
  '<table>',
  {_case("k", 6, {0: _row("Manufacturer", _COMPANY + " || ' Foods Private Limited, Plot 12, Pune - ' || " + _PIN + " || ', Maharashtra'"),
                  1: _row("Manufacturer Name", _COMPANY + " || ' Dairy'") + " || " + _row("Manufacturer Address", "'Surat ' || " + _PIN + " || ', Gujarat'"),
                  2: _row("Marketed by", _COMPANY + " || ' Wellness'"), 3: "''", 4: "''",
                  5: _row("Importer", _COMPANY + " || ' Traders, Delhi, 1800 2027 080'")})},
  {_case("k", 5, {0: _row("Packer Contact Information", _COMPANY + " || ', 18002027080'"), 1: _row("Packer", _COMPANY),
                  2: "''", 3: "''", 4: "''"})},
  {_case("k", 3, {0: _row("Country of Origin", "'India'"), 1: _row("Origin", "'Sri Lanka'"), 2: "''"})},
  {_case("k", 4, {0: _row("Net Quantity", "CAST(p_size AS STRING) || ' g'"), 1: _row("Item Weight", "CAST(p_size AS STRING) || ' Grams'"),
                  2: _row("Unit Count", "CAST(p_size AS STRING) || ' Count'"), 3: "''"})},
  {_case("k", 7, {0: _row("FSSAI Lic. No", "substr(" + _LICENCE + ", 1, 7) || ' ' || substr(" + _LICENCE + ", 8, 7)"),
                  1: "'<tr><td>Best Before</td><td>12 <b>Months</b></td></tr>'", 2: _row("Shelf Life", "'180 days'"),
                  3: _row("Brand", "replace(p_brand, '#', ' ')"), 4: _row("MRP", "'₹ ' || " + _PRICE),
                  5: "'<tr><td>Colour</td><td>Red</td><td>x</td></tr><tr><td>solo</td></tr>'", 6: "''"})},
  '</table>',
  {_case("k", 3, {0: "'<div id=\"detailBullets_feature_div\"><ul><li><span>Brand Contact : ' || " + _COMPANY + " || '</span></li><li>Country of Origin: Nepal</li><li>no pair</li></ul></div>'", 1: "''", 2: "''"})},
  {_case("k", 4, {0: "'<div id=\"feature-bullets\"><div><ul><li>None</li></ul></div><ul><li>Mfg. by ' || " + _COMPANY + " || ' Works</li><li>Made in India</li><li>Packed by hand</li></ul></div>'", 1: "''", 2: "''", 3: "''"})},
  '<div id="productDescription"><div><p>Tasty ', p_name, '</p></div><!-- </div> --><div><div/><p>for all</p></div>and more</div>',
  '<section><p>', replace({_TEXT_BLOCKS}, chr(10), '</p><p>'), '</p></section>',
  {_case("k", 3, {0: "'<p><strong>Net Weight:</strong> ' || CAST(p_size AS STRING) || ' g</p><dl><dt>Licence No</dt><dd>' || " + _LICENCE + " || '</dd></dl>'", 1: "''", 2: "''"})},
  {_case("k", 8, {
      0: "'<script>var d = {\"colorImages\": {\"initial\": [{\"hiRes\":\"https://m.media-amazon.com/images/I/' || " + _IMG_ID + " || '._SL1200_.jpg\",\"large\":\"https://m.media-amazon.com/images/I/' || " + _IMG_ID + " || '._AC_.jpg\"},{\"hiRes\":\"https://m.media-amazon.com/images/I/71backLabel' || CAST(k AS STRING) || '._AC_SL500_.jpg\"}]}};</script><div id=\"altImages\"><ul><li><img src=\"https://m.media-amazon.com/images/I/' || " + _IMG_ID + " || '._SS40_.jpg\" alt=\"\"></li><li><img alt=\"video\" src=\"https://m.media-amazon.com/images/I/71videoThumb._SS40_PKmb-play-button-overlay_.jpg\"></li></ul></div><img id=\"landingImage\" alt=\"main\" data-old-hires=\"https://m.media-amazon.com/images/I/81landing' || CAST(k AS STRING) || '._SL1500_.jpg\"><div id=\"reviews\"><img src=\"https://m.media-amazon.com/images/I/91reviewPic._SL1500_.jpg\"></div>'",
      1: "'<script>window.__PRELOADED_STATE__ = {\"product\":{\"Manufactured By\":\"State Foods\",\"mrp\":\"Net Quantity: 250 g\",\"code\":' || CAST(k AS STRING) || ',\"img\":\"https://rukminim2.flixcart.com/image/128/128/x/back-label-' || CAST(k AS STRING) || '.jpeg\"},\"filler\":\"0123456789012345678901234567890123456789\"};</script><div class=\"_2RngUh\"><div class=\"_1UhVsV\">Specifications</div><div>Country of Origin India</div>in the box</div><img src=\"https://rukminim1.flixcart.com/image/312/312/x/front-' || CAST(k AS STRING) || '.jpeg\">'",
      2: "'<img src=\"https://cdn1.jiomartjcp.com/images/product/t.resize(w:330)/back-' || CAST(k AS STRING) || '.jpg\"><img src=\"https://cdn1.jiomartjcp.com/theme/assets/logo.png\">'",
      3: "'<script>{\"brandName\":\"MynBrand\",\"mrp\":\"' || CAST(p_size * 10 AS STRING) || '\",\"brandSize\":\"' || CAST(p_size AS STRING) || ' g\",\"countryOfOrigin\":\"India\",\"seller\":\"MynSeller\",\"productDetails\":[{\"title\":\"Manufacturer Details\",\"content\":\"Myn Foods Ltd\"},{\"title\":\"Ingredient List\",\"content\":\"Oats, Salt\"},{\"title\":\"Packer\",\"content\":\"N/A\"}],\"styleId\":1}</script><img src=\"https://assets.myntassets.com/assets/images/2024/JUNE/7/abc' || CAST(k AS STRING) || '_1.jpg\"><img src=\"https://assets.myntassets.com/assets/images/retaillabs/x.png\">'",
      4: "'<script id=\"__NEXT_DATA__\" type=\"application/json\">{\"props\":{\"pageProps\":{\"product\":{\"name\":\"Mee ' || p_name || '\",\"brand\":\"MeeBrand\",\"mrp\":' || CAST(p_size AS STRING) || ',\"description\":\"Mee text\"}}}}</script><img src=\"https://media.meesho.com/images/products/' || CAST(k AS STRING) || '/256/256/a.jpg\">'",
      5: "'<script id=\"__NEXT_DATA__\" type=\"application/json\">{\"props\":{\"pageProps\":{\"product\":{\"name\":\"Gen ' || p_name || '\",\"mrp\":\"' || CAST(p_size AS STRING) || '\",\"brand\":\"GenBrand\",\"imageUrl\":\"https://www.bigbasket.com/media/uploads/p/back-' || CAST(k AS STRING) || '.jpg\"}}}}</script><img srcset=\"https://cdn.example.com/a-300.jpg 300w, https://cdn.example.com/a-900.jpg 900w\" src=\"/img/side-label-' || CAST(k AS STRING) || '.jpg\" alt=\"side label\">'",
      6: "'<img data-src=\"//cdn.example.com/lifestyle/happy-' || CAST(k AS STRING) || '.png\" src=\"https://cdn.example.com/p/ingredients-' || CAST(k AS STRING) || '.webp\" alt=\"ingredients list\"><img src=\"https://cdn.example.com/icons/star.png\">'",
      7: "''"})},
  '</main><footer>&copy; Shop 2025 &lt;ok&gt;</footer></body></html>')"""

# product pages built around the label text, followed by the crawled pages: (page_id, url, html)
PRODUCT_PAGES = f"""
SELECT 'P' || CAST(k AS STRING) AS page_id, {_HOST} AS url, {_HTML} AS html
FROM ({_PRODUCTS}) b
UNION ALL
SELECT 'W' || CAST(page_id AS STRING) AS page_id, url, html FROM {{pages}} w"""

# web records of products, their pack texts and codes: what extraction from pages and images gives, stated directly
WEB_RECORDS = f"""
SELECT 'P' || CAST(k AS STRING) AS page_id, {_HOST} AS url, {_case("k", 8, {0: "'amazon'", 1: "'flipkart'", 2: "'jiomart'", 3: "'myntra'", 4: "'meesho'", 5: "'bigbasket'", 6: "'generic'", 7: "'generic'"})} AS platform,
  {_case("k", 8, {0: "'Amazon'", 1: "'Flipkart'", 2: "'JioMart'", 3: "'Myntra'", 4: "'Meesho'", 5: "'BigBasket'", 6: "'Generic'", 7: "'Generic'"})} AS display_name,
  {_case("k", 7, {0: "'Amazon'", 1: "'Flipkart'", 2: "'JioMart'", 3: "'Generic'"})} AS source,
  {_case("k", 6, {0: "CAST(p_size AS STRING) || ' Count'", 1: "''"})} AS row_count, {_case("k", 5, {0: "CAST(p_size AS STRING) || ' Grams'", 2: "' '"})} AS row_weight,
  {_case("k", 3, {0: "'Red'", 1: "'made in Nepal.'"})} AS row_other,
  {_case("k", 5, {0: "'Packed by hand|Mfg. by ' || " + _COMPANY + " || ' Works|Manufactured with care ', ", 1: "'Tasty|Marketed by ' || " + _COMPANY, 2: "'plain'"}).replace("care ', ", "care '")} AS bullets,
  {_case("k", 4, {0: "p_name", 1: "'  '"})} AS product_name, {_case("k", 5, {0: "replace(p_brand, '#', ' ')", 1: "''", 2: "'WebBrand'"})} AS brand,
  {_case("k", 7, {0: _COMPANY + " || ' Foods Private Limited, Plot 12, Pune - ' || " + _PIN + " || ', Maharashtra'", 1: _COMPANY + " || ' Wellness'", 2: _COMPANY + " || chr(10) || 'Via Roma 5' || chr(10) || 'Milano, Italy'", 3: "' '"})} AS manufacturer_raw,
  {_case("k", 5, {0: _COMPANY + " || ' Packers, MG Road, Bengaluru ' || " + _PIN, 1: _COMPANY + " || ' Wellness'"})} AS packer_raw,
  {_case("k", 6, {0: _COMPANY + " || ' Traders, Delhi, 1800 2027 080'", 1: "'Shenzhen Imports, Shenzhen, China'"})} AS importer_raw,
  {_case("k", 5, {0: "'India'", 1: "'Sri Lanka'", 2: "''"})} AS country_of_origin, {_case("k", 4, {0: "CAST(p_size AS STRING) || ' g'", 1: "'1.5 kg'"})} AS net_quantity,
  {_case("k", 5, {0: "'12 Months'", 1: "'Best before use'"})} AS best_before, {_case("k", 3, {0: _LICENCE})} AS fssai, {_case("k", 4, {0: _PRICE, 1: "'99'", 2: "'free'"})} AS mrp,
  {_case("k", 6, {0: "'Jan 2024'", 1: "'soon'"})} AS mfg_date, {_case("k", 5, {0: "'1800 425 1000'"})} AS consumer_care_phone, {_case("k", 7, {0: "'care@web.example.com'"})} AS consumer_care_email,
  {_case("k", 4, {0: "'MySeller'"})} AS seller, {_case("k", 3, {0: "'A fine ' || p_name"})} AS description, {_case("k", 5, {0: "'Oats, Salt and'", 1: "'Rice, Sugar'"})} AS ingredients,
  {_case("k", 6, {0: "'Contains nuts'"})} AS allergen_info, {_case("k", 6, {1: "'Keep cool'"})} AS storage_instructions, {_case("k", 7, {2: "'M.R.P.: Rs 45'"})} AS price_block,
  {_case("k", 9, {0: "'Lic. No. 1234567 and Vegetarian food'"})} AS compliance_text, CASE WHEN k % 2 = 0 THEN {_TEXT_BLOCKS} ELSE 'Welcome to the shop' END AS page_text,
  {_case("k", 5, {1: "'Ld ' || p_name"})} AS s_name, {_case("k", 5, {2: "'Ld text'"})} AS s_description, {_case("k", 3, {1: "'SKU' || CAST(k AS STRING)"})} AS s_sku, {_case("k", 9, {1: "'8901234567890'"})} AS s_gtin,
  {_case("k", 4, {1: "'LdBrand'"})} AS s_brand, {_case("k", 4, {1: "'55.50'", 2: "'1,200'"})} AS s_price, {_case("k", 4, {1: "'INR'"})} AS s_currency, {_case("k", 8, {1: "'InStock'"})} AS s_availability,
  {_case("k", 6, {1: "'LdSeller'"})} AS s_seller, {_case("k", 3, {2: "'Og ' || p_name"})} AS s_og_title, {_case("k", 4, {3: "'Og text, Country of Origin: Nepal'"})} AS s_og_description, {_case("k", 5, {0: "'https://shop.example.com/c'"})} AS s_canonical_url
FROM ({_PRODUCTS}) b WHERE k % 11 <> 5"""
PACK_TEXTS = f"SELECT 'P' || product_id AS product_id, text FROM ({PRODUCT_LABELS}) l WHERE CAST(product_id AS BIGINT) % 7 <> 3"
PACK_CODES = f"""SELECT 'P' || CAST(k AS STRING) AS product_id, {_case("k", 4, {0: "CAST(8900000000000 + k AS STRING)", 1: "' '"})} AS barcode,
  {_case("k", 4, {0: "'EAN13'"})} AS barcode_type, {_case("k", 6, {0: "'https://qr.example.com/' || CAST(k AS STRING)"})} AS qr_code FROM ({_PRODUCTS}) b WHERE k % 3 <> 1"""

_IMG_KIND = _case("i", 12, {
    0: "'front-view'", 1: "'back-view'", 2: "'ingredients'", 3: "'nutrition-label'", 4: "'side-label'",
    5: "'lifestyle'", 6: "'zoom'", 7: "'barcode'", 8: "'pack_icon_small'", 9: "'spec'", 10: "'main'", 11: "'plain'"})

_OFFERS = """
  SELECT l_partkey, l_suppkey, min(l_orderkey * 7 + l_linenumber) AS i
  FROM {lineitem} l GROUP BY l_partkey, l_suppkey
"""

# image candidates, one row per line item of the product
IMAGE_CANDIDATES = f"""
SELECT CAST(l_partkey AS STRING) AS product_id, l_suppkey AS ord,
  CASE i % 5
    WHEN 0 THEN 'https://m.media-amazon.com/images/I/61' || CAST(100000 + l_suppkey AS STRING) || 'Ab._SL' || CAST(400 + 100 * (i % 12) AS STRING) || '_.jpg'
    WHEN 1 THEN 'https://cdn.example.com/p/' || {_IMG_KIND} || '/item.0' || CAST(i % 9 AS STRING) || '.jpg?v=' || CAST(i % 3 AS STRING)
    WHEN 2 THEN 'https://rukminim2.flixcart.com/image/832/832/x/' || {_IMG_KIND} || '-' || CAST(i % 40 AS STRING) || '.jpeg'
    WHEN 3 THEN 'https://assets.myntassets.com/h_1440,q_75,w_1080/v1/assets/images/' || {_IMG_KIND} || '/' || CAST(i AS STRING) || '.jpg'
    ELSE 'https://shop.example.com/static/' || {_IMG_KIND} || '/img' || CAST(i % 100 AS STRING) || '.png' END AS url,
  {_case("i", 9, {0: "''", 1: "'back of pack with FSSAI number'", 2: "'net weight and mrp'", 3: "'limited offer'",
                  4: "'front'", 5: "NULL", 6: "'ingredients list'", 7: "'customer care details'", 8: "'product photo'"})} AS alt,
  {_case("i", 7, {0: "'adapter'", 1: "'amazon_gallery'", 2: "'jsonld'", 3: "'myntra_script'", 4: "'og_image'",
                  5: "'img_tag'", 6: "'amazon_hires'"})} AS source,
  CAST(i % 30 - 5 AS INT) AS score,
  CAST(i % 11 - 4 AS INT) AS visual_score,
  CASE WHEN i % 6 = 0 THEN 'h' || CAST(i % 4 AS STRING) ELSE '' END AS phash,
  {_case("i", 10, {
      0: "'FSSAI Lic. No. 1001 4022 0027 11 MRP Rs. 45'", 1: "''", 2: "'INGREDIENTS: Oats, Wheat Mfg by: Test Ltd'",
      3: "'Loved by millions 100% Natural'", 4: "'Net Weight 200 g Best Before 12 months'",
      5: "'Consumer Care 1800 425 1000 Country of Origin India Batch 12'",
      6: "'NUTRITION FACTS Calories 200 Total Fat 5'", 7: "NULL",
      8: "'LIC NO 10014022002711 ' || 'one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty'",
      9: "'word a b c d e f g h i j k l m n o p q r s t u v w x y z a b c d e f g h i j k l m n o p q r s t MRP 45'"})} AS ocr_text
FROM ({_OFFERS}) b"""

# package-side facts of each image: (image_id, width_px, package_area_cm2, reference_width_mm, total_surface_cm2, pdp_area_cm2)
IMAGES = """
SELECT CAST(p_partkey AS STRING) AS image_id, CAST(800 + 10 * p_size AS INT) AS width_px,
       CAST(100 * p_size AS DOUBLE) AS package_area_cm2,
       CASE WHEN p_partkey % 3 = 0 THEN CAST(50 + p_size AS DOUBLE) END AS reference_width_mm,
       CASE p_partkey % 4 WHEN 0 THEN CAST(600 AS DOUBLE) WHEN 1 THEN CAST(0 AS DOUBLE) WHEN 2 THEN CAST(900 AS DOUBLE) END AS total_surface_cm2,
       CASE WHEN p_partkey % 5 <> 4 THEN CAST(10 * p_size AS DOUBLE) END AS pdp_area_cm2
FROM {part} p"""


def _named(text: str, name) -> str:
    for t in TABLES:
        if "{" + t + "}" in text:
            text = text.replace("{" + t + "}", name(t))
    return text


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` in several parts a core.

    Joins and files leave parts sized for reading, at times a single one; what is made of a row takes far longer than reading it.
    """
    return df.repartition(PARTS_A_CORE * df.sparkSession.sparkContext.defaultParallelism, key)


def frame(spark: SparkSession, sf_dir: str, text: str, **given: DataFrame) -> DataFrame:
    """Evaluate one corpus text in Spark; ``given`` replaces base tables, for instance by a stream.

    Products and offers are dealt while their rows are short, before texts are made of them.
    """
    names = {}
    for rows, key in ((_PRODUCTS, "k"), (_OFFERS, "l_partkey")):
        if f"({rows})" in text:
            view = f"corpus_dealt_{key}_{uuid.uuid4().hex}" if given else f"corpus_dealt_{key}_{hashlib.sha1(sf_dir.encode()).hexdigest()[:8]}"
            _dealt(frame(spark, sf_dir, rows, **given), key).createOrReplaceTempView(view)
            text = text.replace(f"({rows})", view)
    for t in TABLES:
        if "{" + t + "}" in text:
            tag = uuid.uuid4().hex if t in given else hashlib.sha1(sf_dir.encode()).hexdigest()[:8]
            names[t] = f"corpus_{t}_{tag}"
            (given[t] if t in given else table(spark, sf_dir, t)).createOrReplaceTempView(names[t])
    return spark.sql(_named(text, names.get))


def sql(text: str) -> str:
    """The same corpus text over the plain table names."""
    return _named(text, lambda t: t)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR words of every product label: (product_id, image_id, variant, ord, bbox, text, conf)."""
    labels = frame(spark, sf_dir, PRODUCT_LABELS)
    lines = labels.select(
        "product_id", F.posexplode(F.split("text", "\n")).alias("ln", "line")
    )
    words = lines.select("product_id", "ln", F.posexplode(F.split("line", " ")).alias("wn", "word"))
    k, ln, wn = F.col("product_id").cast("bigint"), F.col("ln"), F.col("wn")
    x = (wn * 60 + k % 7).cast("double")
    y = (ln * 20 + wn % 3).cast("double")
    h = (8 + (k + wn) % 12).cast("double")
    corner = lambda a, b: F.array(a, b)
    return words.select(
        "product_id",
        F.col("product_id").alias("image_id"),
        F.element_at(F.array(*map(F.lit, ("full", "bottom", "contrast", "mid"))), (1 + ln % 4).cast("int")).alias("variant"),
        (ln * 1000 + wn).cast("int").alias("ord"),
        F.array(corner(x, y), corner(x + 50, y), corner(x + 50, y + h), corner(x, y + h)).alias("bbox"),
        F.col("word").alias("text"),
        ((50 + (ln * 7 + wn * 3) % 50) / 100).cast("double").alias("conf"),
    )


DETECTIONS_SQL = """
SELECT product_id, image_id, variant, ord, x AS x0, y AS y0, x + 50 AS x1, y + h AS y1, text, conf FROM (
  SELECT product_id, product_id AS image_id,
    list_extract(['full', 'bottom', 'contrast', 'mid'], 1 + ln % 4) AS variant,
    CAST(ln * 1000 + wn AS INT) AS ord,
    CAST(wn * 60 + CAST(product_id AS BIGINT) % 7 AS DOUBLE) AS x,
    CAST(ln * 20 + wn % 3 AS DOUBLE) AS y,
    CAST(8 + (CAST(product_id AS BIGINT) + wn) % 12 AS DOUBLE) AS h,
    word AS text, (50 + (ln * 7 + wn * 3) % 50) / 100.0 AS conf
  FROM (
    SELECT product_id, ln, unnest(ws) AS word, CAST(unnest(range(len(ws))) AS INT) AS wn
    FROM (
      SELECT product_id, CAST(ln AS INT) AS ln, string_split(line, ' ') AS ws
      FROM (SELECT product_id, unnest(ls) AS line, unnest(range(len(ls))) AS ln
            FROM (SELECT product_id, string_split(text, chr(10)) AS ls FROM (@labels) a) b) c
    ) d
  ) e
) f""".replace("@labels", sql(PRODUCT_LABELS))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, PRODUCT_PAGES, pages=_dealt(table(spark, sf_dir, "pages"), "page_id"))
