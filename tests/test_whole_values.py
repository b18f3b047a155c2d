"""Values beyond the lengths and counts at which they were once cut."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from labelwright.functions import entities as E
from labelwright.functions.html import rows_to_map
from labelwright.operators import pages as P
from labelwright.operators.attributes import extract_attributes

PAGE = "page_id string, url string, html string"


def page(spark, html, url="https://shop.example.com/p"):
    return spark.createDataFrame([("1", url, html)], PAGE)


def test_state_text_of_a_million_escapes(spark):
    state = json.dumps({"label": 'Net "Qty" \\ 5 g/piece', "html": '<div class="x">' * 500_000, "n": -1.5})
    row = page(spark, f"<script>window.__PRELOADED_STATE__ = {state};</script><script>{{\"k\":\"short\"}}</script>").select(P.state_text(F.col("html")).alias("t")).first()
    assert row.t.startswith('label Net \\"Qty\\" \\\\ 5 g/piece html') and row.t.endswith("n -1.5 k short")


def test_thirty_product_details(spark):
    details = [{"title": f"Manufacturer {i}", "content": "x" * 400} for i in range(30)]
    html = f'<script>{{"productDetails": {json.dumps(details)}, "styleId": 5}}</script>'
    row = page(spark, html).select(F.size(P.product_details(F.col("html"))).alias("n")).first()
    assert row.n == 30


def test_ninth_bullet_and_long_rows(spark):
    bullets = "".join(f"<li>Point {i}</li>" for i in range(8)) + "<li>Packed by: " + "Acme " * 100 + "</li>"
    table = "<table><tr><th>Manufacturer</th><td>" + "Maker " * 100 + "</td></tr></table>"
    df = page(spark, f'<div id="feature-bullets"><ul>{bullets}</ul></div>{table}', "https://www.amazon.in/dp/B000000001")
    row = P.extract_pages(df).first()
    assert len(row.feature_bullets) == 9 and len(row.packer_raw) > 400 and len(row.manufacturer_raw) > 500 and len(row.page_rows["Manufacturer"]) > 500


def test_late_long_and_short_paragraphs(spark):
    html = "<p>MRP: 5</p>" + "".join(f"<p>Net weight of item {i}: {i} g</p>" for i in range(25)) + "<p>Manufactured by: " + "Acme " * 200 + "</p>"
    row = page(spark, html).select(P.compliance_paragraphs(F.col("html")).alias("p")).first()
    assert len(row.p) == 27 and len(row.p[-1]) > 900


def test_long_attributes(spark):
    parts = ", ".join(f"Item number {i}" for i in range(200))
    df = spark.createDataFrame([("1", f"INGREDIENTS: {parts}.\n\nSTORAGE: {'keep dry ' * 60}\n\nALLERGEN INFO: {'nuts and ' * 60}milk\n\nMRP: 5")], "id string, text string")
    row = extract_attributes(df).first()
    assert "Item number 199" in row.ingredients and len(row.storage_instructions) > 400 and row.allergen_info.endswith("milk")
    text = "Statutory warning: smoking kills\nFSSAI licence 12345\nVegetarian\nCertified Organic food\nLic. No. 123456\nAll weights are approximate\nWeigh before buying"
    assert len(spark.range(1).select(E.declarations(F.lit(text)).alias("d")).first().d) == 7


def test_ten_thousand_rows_to_a_map(spark):
    rows = F.transform(F.sequence(F.lit(0), F.lit(20_000)), lambda i: F.struct(F.concat(F.lit("k"), (i % 10_000).cast("string")).alias("key"), i.cast("string").alias("value")))
    row = spark.range(1).select(rows_to_map(rows).alias("m")).select(F.map_keys("m").alias("k"), F.map_values("m").alias("v")).first()
    assert row.k == [f"k{i}" for i in range(10_000)] and row.v[0] == "20000" and row.v[5] == "10005"


def test_long_record_values(spark):
    listed = ", ".join(f"item {i}" for i in range(100))
    maker = "Acme Foods " * 30
    assert len(listed) > 850 and len(maker) > 300
    for url, label in (("https://www.jiomart.com/p/1", "Manufactured by: "), ("https://www.flipkart.com/p/1", "Manufactured By: "), ("https://shop.example.com/p", "Manufactured By: ")):
        row = P.extract_pages(page(spark, f"<div>Ingredients: {listed}</div><div>{label}{maker}</div>", url)).first()
        assert len(row.manufacturer_raw) > 300
        assert "jiomart" not in url or "item 99" in row.ingredients


def test_long_allergens_storage_and_care(spark):
    long = "nuts and " * 50 + "milk"
    texts = {"a": f"Contains: {long}.", "b": f"May contain {long}.", "c": f"Store in {long}.", "d": f"Consumer care: {long}"}
    rows = {r.id: r for r in extract_attributes(spark.createDataFrame(list(texts.items()), "id string, text string")).collect()}
    assert rows["a"].allergen_info.endswith("milk") and rows["b"].allergen_info.endswith("milk")
    assert rows["c"].storage_instructions.endswith("milk") and rows["d"].consumer_care_raw.endswith("milk")


LONG_COUNTRY = "United Kingdom of Great Britain and Northern Ireland"
SENTENCE = "see the printed code on the bottom of the pack for the day on which it was packed 12/2024"


def test_long_countries_brands_and_batches(spark):
    lines = [f"Country of Origin: {LONG_COUNTRY}\nx", f"Origin - {LONG_COUNTRY}\nx", f"Made in {LONG_COUNTRY}.", f"Product of {LONG_COUNTRY},", f"Produce of {LONG_COUNTRY}|"]
    rows = [(str(i), t) for i, t in enumerate(lines)] + [("b", "Brand: " + "Acme and " * 10 + "Sons\nBatch No: " + "AB12" * 12)]
    got = {r.id: r for r in extract_attributes(spark.createDataFrame(rows, "id string, text string")).collect()}
    assert all(got[str(i)].country_of_origin == LONG_COUNTRY for i in range(5))
    assert got["b"].brand.endswith("Sons") and got["b"].batch_no == "AB12" * 12


def test_long_fallbacks_and_declarations(spark):
    text = F.lit(f"Country of Origin: {LONG_COUNTRY}\nBrand: {'Acme ' * 12}\nShelf life: {SENTENCE}\nMfg Date: {SENTENCE}\n")
    names = ("country_of_origin", "brand", "best_before", "mfg_date")
    row = spark.range(1).select(*[E.fallback_field(text, n).alias(n) for n in names]).first()
    assert row.country_of_origin == LONG_COUNTRY and len(row.brand) == 59 and row.best_before == row.mfg_date == SENTENCE
    kept = "Statutory warning: " + "smoke " * 40 + "kills\nLic. No. " + "1234567890" * 8 + "\nWeigh before buying " + "each " * 30 + "time"
    found = spark.range(1).select(E.declarations(F.lit(kept)).alias("d")).first().d
    assert found[0].endswith("kills") and found[1].endswith("1234567890") and len(found[1]) > 80 and found[2].endswith("time")


def test_long_values_of_every_marketplace(spark):
    body = f"<div>Country of Origin: {LONG_COUNTRY}|</div><div>Shelf Life: {SENTENCE}|</div><div>Mfg Date: {SENTENCE}|</div>"
    for url in ("https://www.amazon.in/dp/B000000001", "https://www.flipkart.com/p/1", "https://www.jiomart.com/p/1", "https://www.meesho.com/p/1", "https://shop.example.com/p"):
        row = P.extract_pages(page(spark, body, url)).first()
        assert row.country_of_origin == LONG_COUNTRY, url
        assert "meesho" in url or row.best_before == SENTENCE
        assert "meesho" in url or "example" in url or row.mfg_date == SENTENCE
    listing = P.listing_texts(page(spark, body, "https://www.amazon.in/dp/B000000001")).first().extracted_text
    assert LONG_COUNTRY in listing and listing.count(SENTENCE) == 2
    bullet = page(spark, '<div id="feature-bullets"><ul><li>Country of origin: ' + "Abcdefghij" * 4 + "</li></ul></div>", "https://www.amazon.in/dp/B000000001")
    assert P.extract_pages(bullet).first().country_of_origin == "Abcdefghij" * 4


def test_long_myntra_values(spark):
    html = json.dumps({"brandName": "B" * 150, "seller": "S" * 150, "brandSize": "500 g " + "x" * 60, "countryOfOrigin": LONG_COUNTRY * 2})
    row = P.extract_pages(page(spark, f"<script>{html}</script>", "https://www.myntra.com/p/1")).first()
    assert row.brand == "B" * 150 and row.seller == "S" * 150 and row.net_quantity == "500 g" and row.country_of_origin == LONG_COUNTRY * 2
    text = "<p>Seller: " + "Acme Trading " * 8 + "Address: Pune</p>"
    assert P.extract_pages(page(spark, text, "https://www.myntra.com/p/1")).first().seller == ("Acme Trading " * 8).strip()


def test_long_keys_and_quantities(spark):
    key = "Net quantity of the contents of this pack, without the weight of the wrapper"
    pairs = page(spark, f"<p><b>{key}:</b> 500 g</p>").select(P.spec_pairs(F.col("html")).alias("p")).first().p
    assert [(r.key, r.value) for r in pairs] == [(key, "500 g")]
    row = P.extract_pages(page(spark, "<p>Net Weight: 500 g when packed in the works at Pune under normal air|</p>", "https://www.flipkart.com/p/1")).first()
    assert row.net_quantity.endswith("under normal air|")


def test_the_shorter_pass_is_kept(spark):
    from labelwright.operators import ocr as O

    rows = [("i", "full", "MRP Rs. 5 and a long text about nothing at all", 0.9), ("i", "contrast", "FSSAI Lic No 10014022002711", 0.8)]
    both = O.combine_scan(spark.createDataFrame(rows, "image_id string, variant string, text string, conf double"))
    assert both.first().other_text == rows[1][2]
    flagged = O.flag_signals(both).first()
    assert flagged.has_fssai_signal and rows[0][2] in flagged.text and rows[1][2] in flagged.text
