from __future__ import annotations

from pyspark.sql import functions as F

from labelwright.functions import entities as E
from labelwright.functions import geo as G
from labelwright.functions import normalize as N
from labelwright.functions.text import bind, format_general
from labelwright.operators.attributes import coverage_percent, extract_attributes, missing_critical


def attrs(spark, text):
    return extract_attributes(spark.createDataFrame([(text,)], "text string")).first()


def one(spark, fn, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return row.select(fn(*[F.col(f"c{i}") for i in range(len(values))]).alias("v")).first().v


def test_ingredient_headings(spark):
    for text in (
        "COMPOSITION: Rolled Oats (25%), Wheat Flakes (20%), Sugar.",
        "MADE FROM: Oats, Wheat, Ragi, Jowar, Almonds.",
        "INGREDIENTS: Rolled Oats (25%), Wheat Flakes (20%).",
    ):
        a = attrs(spark, text)
        assert a.ingredients and a.ingredient_complete is True


def test_completeness(spark):
    got = [one(spark, E.ingredients_complete, t) for t in ("Rolled Oats, Wheat, Sugar.", "Rolled Oats, Wheat, Sugar,", "Rolled Oats and")]
    assert got == [True, False, False]


def test_party_roles_and_split(spark):
    a = attrs(spark, "Manufactured & Marketed By: Good Foods Pvt. Ltd.\nPlot 5, Pune 411001\n\nPacked by: Other Packers\nRoad 9\n\nImported by: Far Traders")
    assert a.manufacturer_name == "Good Foods Pvt. Ltd." and a.manufacturer_address == "Plot 5, Pune 411001"
    assert a.packer_name == "Other Packers" and a.packer_address == "Road 9"
    assert a.importer_name == "Far Traders" and a.marketer_name is None
    assert a.country_of_origin == "India" and a.country_inferred_from_address is True


def test_price_guard_barcode_and_veg(spark):
    a = attrs(spark, "MRP: 0\n8901234567890\nnon-veg")
    assert a.mrp is None and a.barcode_ocr == "8901234567890" and a.veg_status == "Non-Vegetarian"
    b = attrs(spark, "10014022002711 then 8901234567890 MRP Rs. 1,250.50 pure veg")
    assert b.barcode_ocr is None and b.fssai == "10014022002711" and b.mrp == "1250.50" and b.veg_status == "Vegetarian"


def test_licence_cleaning(spark):
    got = [one(spark, N.clean_licence, t) for t in ("1001 4022 0027 11", "1OO14O22OO27ll", "01014022002711", "100140220027", "1001S022002711")]
    assert got == ["10014022002711", "10014022002711", None, None, "10015022002711"]


def test_label_values(spark):
    for raw, want in {
        "15/03/2025": "03/2025", "15.03.2025": "03/2025", "3-2025": "03/2025", "2025/07": "07/2025", "Sept. 2024": "09/2024",
        "12 Months from manufacturing": "12 Months from manufacturing", " x ": "x",
    }.items():
        assert one(spark, N.label_date, raw) == want
    for raw, want in {"1,200 gms": "1200 g", ".5 kg": ".5 kg", "2 L": "2 l", "2 litre": "2 L", "2.50 kg": "2.5 kg", "5": "5"}.items():
        assert one(spark, N.label_quantity, raw) == want
    for raw, want in {"1,200": "Rs. 1200.00", "₹": "₹", "85.5": "Rs. 85.50"}.items():
        assert one(spark, N.label_price, raw) == want


def test_canonical_quantity_and_price(spark):
    q = one(spark, N.canonical_quantity, "1 kg")
    assert (q.canonical_value, q.canonical_unit, q.display) == (1000.0, "g", "1 kg (1000 g)")
    assert one(spark, N.canonical_quantity, "180 Tablets").display == "180 tablets"
    assert one(spark, N.canonical_quantity, "none").display == "none" and one(spark, N.canonical_quantity, "").display == "Not Found"
    assert one(spark, N.canonical_price, "MRP: 1,200.5").display == "₹1200.50"


def test_general_number_form(spark):
    values = [0.0, 1.0, 2.5, 1234567.0, 123456.0, 0.0001, 0.00001234, 1e10, 453.59]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", format_general(F.col("v")).alias("g"))
    assert {r.v: r.g for r in df.collect()} == {v: f"{v:g}" for v in values}


def test_countries(spark):
    assert one(spark, lambda c: bind(c, G.infer_country), "Via Roma, Milano, Italy") == "Italy"
    assert one(spark, lambda c: bind(c, G.infer_country), "Licence 10014022002711 only") is None
    d = one(spark, G.detect_country, "sold by the thousand")
    assert (d.country, d.confidence) == ("USA", 95)
    d = one(spark, G.detect_country, "Pune 411001, Maharashtra")
    assert (d.country, d.confidence, len(d.signals)) == ("India", 93, 2)


def test_address(spark):
    a = one(spark, G.parse_address, "Bolas Agro Private Limited, Ground Floor, Block K56, Kakina-574110, Udupi, Karnataka, India.")
    assert (a.company, a.pincode, a.state, a.country, a.city, a.confidence) == (
        "Bolas Agro Private Limited", "574110", "Karnataka", "India", "Kakina", 100
    )
    assert a.address_line1 == "Ground Floor" and a.address_line2 == "Block K56, Kakina-574110"


def test_critical_fields(spark):
    df = spark.createDataFrame([("MRP Rs 5 net weight 5 g",), ("",)], "t string")
    rows = df.select(missing_critical(F.col("t")).alias("m")).select("m", coverage_percent(F.col("m")).alias("c")).collect()
    assert rows[0].m == ["manufacturer", "fssai", "country", "ingredients"] and rows[0].c == 33
    assert rows[1].c == 0
