"""Cases in which rows or values must not get lost."""

from __future__ import annotations

from test_pages_ocr_stream import DETECTION, box

from labelwright.operators import compare as K
from labelwright.operators import fonts as T
from labelwright.operators import ocr as O
from labelwright.operators import scan as S
from labelwright.sources.labels import read_label_csv
from labelwright.sources.schemas import LABELS_IN
from labelwright.sources.sinks import write_scans
from labelwright.streaming import read_labels, write_scan_stream

TEXT = "Manufactured by: Maker\nNet Weight: 5 g\nMRP: Rs. 5"


def test_late_stream_rows_are_kept(spark, tmp_path):
    for i, day in enumerate(("2025-03-01", "2025-01-05", "2025-01-01", "2025-01-01")):
        n = min(i, 2)  # the last file repeats the third record
        row = [(str(n), f"{TEXT} {n}", "TEXT", None, None, None, None)]
        spark.createDataFrame(row, LABELS_IN).selectExpr("* except (created_at)", f"timestamp'{day} 10:00:00' AS created_at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        write_scan_stream(read_labels(spark, str(tmp_path / "in"), files_per_batch=1), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out" / "scans")).count() == 3
        assert spark.read.parquet(str(tmp_path / "out" / "field_results")).count() == 24


def test_equal_labels_stay_two_scans(spark, tmp_path):
    path = tmp_path / "labels.csv"
    path.write_text('text\n"same label text"\n"same label text"\n', encoding="utf-8")
    scans = S.with_scan_id(S.scan_labels(read_label_csv(spark, str(path)))).cache()
    nested = S.nested_scans(scans.select("scan_id"), S.field_rows(scans), S.violation_rows(scans)).collect()
    assert len(nested) == 2 and all(len(r.fields) == 8 for r in nested)
    violations = S.violation_rows(scans)
    assert violations.join(scans.select("scan_id"), "scan_id").count() == violations.count()


def test_rewriting_a_batch_changes_nothing(spark, tmp_path):
    labels = spark.createDataFrame([("1", TEXT), ("2", TEXT)], "record_id string, text string")
    for _ in range(2):
        write_scans(S.scan_labels(labels), str(tmp_path), "a")
    tables = {t: spark.read.parquet(str(tmp_path / t)) for t in ("scans", "field_results", "violations")}
    assert tables["scans"].count() == 2 and tables["field_results"].count() == 16
    assert tables["scans"].select("created_at").union(tables["violations"].select("created_at")).distinct().count() == 1


def test_comparison_takes_the_stated_value(spark):
    web = spark.createDataFrame([("p", None, None), ("p", "500 g", None)], "product_id string, quantity string, mrp string").selectExpr("*", "CAST(NULL AS STRING) AS country", "CAST(NULL AS STRING) AS brand", "CAST(NULL AS STRING) AS maker")
    pack = spark.createDataFrame([("p", 2, "400 g"), ("p", 1, "500 g")], "product_id string, ord int, quantity string").selectExpr("*", "CAST(NULL AS STRING) AS mrp", "CAST(NULL AS STRING) AS country", "CAST(NULL AS STRING) AS maker")
    row = K.compare_records(web, pack).first()
    assert (row.website_value, row.package_value, row.status) == ("500 g", "500 g", "MATCH")


def test_all_passes_and_zones_are_kept(spark):
    rich = "MRP manufacturer net weight " * 12
    rows = [("i", "full", rich, 0.9), ("i", "bottom", "zzz", 0.4), ("i", "bottom_crop", "Lic No 10013022002115", 0.8), ("j", "mid", "x", 0.1)]
    texts = spark.createDataFrame(rows, "image_id string, variant string, text string, conf double")
    got = {r.image_id: r for r in O.combine_scan(texts).collect()}
    assert got["i"].text == O.CROP_MARK.join([rich, "zzz", "Lic No 10013022002115"]) and got["j"].text == "x"
    assert got["i"].conf == 0.9 and got["i"].used_variants == "full+bottom_crop"
    zones = spark.createDataFrame([("j", "Lic No 10013022002115"), ("j", "zzz")], "image_id string, zone_text string")
    flagged = {r.image_id: r for r in O.flag_signals(O.combine_scan(texts), zones).collect()}
    assert flagged["j"].has_fssai_signal and "10013022002115" in flagged["j"].text


def test_more_than_four_images_and_five_offenders(spark):
    rows = [("p", i, True, f"text {i}", 0.5, i == 6) for i in range(7)]
    images = spark.createDataFrame(rows, "product_id string, rank int, downloaded boolean, text string, conf double, has_fssai_signal boolean")
    row = O.product_texts(images).first()
    assert row.combined_text.count("text") == 7 and row.fssai_found_in == 6
    words = spark.createDataFrame([("a", "full", i, box(0.0, 0.0, 2.0), f"w{i}", 0.9) for i in range(9)], DETECTION)
    facts = spark.createDataFrame([("a", 1000, 300.0, 100.0, 100.0, 50.0)], "image_id string, width_px int, package_area_cm2 double, reference_width_mm double, total_surface_cm2 double, pdp_area_cm2 double")
    measured = T.measure_words(words, facts)
    assert T.font_verdicts(measured, facts).first().verdict.count('"w') == 9
    assert T.font_verdicts(measured, facts, shown=5).first().verdict.count('"w') == 5
