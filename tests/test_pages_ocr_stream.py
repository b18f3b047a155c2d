from __future__ import annotations

from pyspark.sql import functions as F

from labelwright.functions import html as H
from labelwright.functions.urls import url_status
from labelwright.operators import fonts as T
from labelwright.operators import fusion as M
from labelwright.operators import ocr as O
from labelwright.operators import pages as P
from labelwright.operators import reports as R
from labelwright.operators import scan as S
from labelwright.sources.schemas import LABELS_IN
from labelwright.streaming import read_labels, write_scan_stream

PAGE = (
    '<html><head><meta property="og:title" content="Oats &amp; Co"></head><body><h1>Good Oats</h1><script>var x = "<b>";</script>'
    "<table><tr><th>Net Quantity:</th><td>500 <b>g</b></td></tr><tr><td>Manufacturer</td><td>Acme Foods, Pune 411001</td></tr>"
    "<tr><td>Net Quantity</td><td>600 g</td></tr></table><p>M.R.P. ₹ 1,250.00</p><p>Lic No 10014022002711</p></body></html>"
)


def test_visible_text_and_rows(spark):
    df = spark.createDataFrame([(PAGE,)], "h string")
    text, rows, last = df.select(
        H.node_text(F.col("h")), H.table_rows(F.col("h")), H.row_value(H.table_rows(F.col("h")), "Net Quantity")
    ).first()
    assert text.startswith("Good Oats Net Quantity: 500 g Manufacturer") and "var x" not in text
    assert [r.key for r in rows] == ["Net Quantity", "Manufacturer", "Net Quantity"] and last == "600 g"


def test_generic_record_fusion_and_report(spark):
    pages = spark.createDataFrame([("P1", "https://shop.example.com/food/1", PAGE)], "page_id string, url string, html string")
    pack = spark.createDataFrame([("P1", "Net Weight: 600 g\nMRP Rs. 1250\nCountry of Origin: India\nINGREDIENTS: Oats, Wheat, Salt and")], "product_id string, text string")
    web = M.web_products(pages)
    row = web.first()
    assert (row.product_name, row.net_quantity, row.mrp, row.fssai) == ("Good Oats", "600 g", "1250.00", "10014022002711")
    assert row.s_og_title == "Oats & Co"
    model = M.completeness(M.product_comparisons(M.compliance_texts(M.fuse_products(web, pack))))
    m = model.first()
    status = {c.field: c.status for c in m.comparisons}
    assert status["Net Quantity"] == "MATCH" and status["MRP"] == "MATCH" and status["Country of Origin"] == "MATCH"
    assert m.category == "Food & Beverage" and "Country of Origin: India" in m.compliance_text
    assert m.manufacturer.name == "Acme Foods" and m.manufacturer.parsed.pincode == "411001"
    report = R.product_report(model).first().report
    assert "POSSIBLE TRUNCATION" in report and "⚠" not in report.split("COMPARISON")[1].split("DATA SOURCE")[0]
    bare = R.product_report(M.completeness(M.product_comparisons(M.fuse_products(web, pack.filter("false"))))).first().report
    assert "Ingredient declaration not found" in bare


def test_url_safety(spark):
    cases = {
        "https://shop.example.com/x": "OK", "": "EMPTY", "ftp://a.b": "BAD_SCHEME", "http://": "NO_HOST", "http://localhost:80/": "LOCALHOST",
        "http://10.1.2.3/": "PRIVATE_ADDRESS", "http://[::1]/": "PRIVATE_ADDRESS", "http://[fd00::1]/": "PRIVATE_ADDRESS",
        "http://8.8.8.8/": "DIRECT_ADDRESS", "http://172.20.1.1": "PRIVATE_ADDRESS", "http://172.32.1.1": "DIRECT_ADDRESS",
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string").select("u", url_status(F.col("u")).alias("s"))
    assert {r.u: r.s for r in df.collect()} == cases


def test_ld_forms(spark):
    tag = '<script type="application/ld+json">%s</script>'
    html = tag % '[{"@type":"Thing"},{"@graph":[{"@type":"WebSite"},{"@type":["Product"],"name":"Deep"}]}]' + tag % "{broken"
    df = spark.createDataFrame([("1", "u", html)], "page_id string, url string, html string")
    assert P.structured_data(df).first().name == "Deep"


DETECTION = "image_id string, variant string, ord int, bbox array<array<double>>, text string, conf double"


def box(x, y, h=10.0):
    return [[x, y], [x + 40.0, y], [x + 40.0, y + h], [x, y + h]]


def test_lines_and_confidence(spark):
    words = [
        ("i", "full", 1, box(600.0, 5.0), "World", 0.5), ("i", "full", 2, box(10.0, 4.0), "Hello", 1.0), ("i", "full", 3, box(10.0, 45.0), "again", 0.25),
    ]
    row = O.image_texts(spark.createDataFrame(words, DETECTION)).first()
    assert row.text == "Hello World\nagain" and row.conf == 0.5


def test_font_verdicts(spark):
    words = spark.createDataFrame([("a", "full", i, box(0.0, 0.0, h), f"w{i}", 0.9) for i, h in enumerate((2.0, 40.0))], DETECTION)
    images = spark.createDataFrame(
        [("a", 1000, 300.0, 100.0, 100.0, 50.0), ("b", 1000, 300.0, None, None, None)],
        "image_id string, width_px int, package_area_cm2 double, reference_width_mm double, total_surface_cm2 double, pdp_area_cm2 double",
    )
    got = {r.image_id: r for r in T.font_verdicts(T.measure_words(words, images), images).collect()}
    assert got["a"].overall_status == "FAIL" and got["a"].smallest_mm == 0.2 and '"w0"(0.2mm)' in got["a"].verdict
    assert got["a"].pdp.status == "PASS" and got["b"].overall_status == "REVIEW" and got["b"].px_per_mm == 3.78


def test_stream_equals_batch_and_replays_drop_duplicates(spark, tmp_path):
    texts = [f"Manufactured by: Maker {i}\nNet Weight: {i} g\nMRP: Rs. {i}" for i in range(1, 6)]
    rows = [(str(i), t, "TEXT", None, None, None, None) for i, t in enumerate(texts)]
    labels = spark.createDataFrame(rows, LABELS_IN).withColumn("created_at", F.lit("2025-01-01 10:00:00").cast("timestamp"))
    labels.union(labels).coalesce(1).write.parquet(str(tmp_path / "in"))
    write_scan_stream(read_labels(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out" / "scans"))
    batch = S.scan_labels(labels)
    key = lambda df, text: sorted((r[0], r[1], r[2]) for r in df.select(text, "score", "status").collect())
    assert key(streamed, "raw_text") == key(batch, "text")
    assert spark.read.parquet(str(tmp_path / "out" / "field_results")).count() == 40
