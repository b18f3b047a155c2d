"""A report over the statuses of fields computes nothing else of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelwright.operators import scan as S


def test_statuses_of_fields_read_no_evidence(spark):
    df = spark.createDataFrame([("1", "MRP: Rs. 5\nMade in Italy."), ("2", "Mfd by: Foo Foods, Plot 1, Pune 411001"), ("3", ""), ("4", None)], "record_id string, text string")
    scans = S.scan_labels(df).withColumn("scan_id", F.col("record_id"))
    got, want = S.field_statuses(scans), S.field_rows(scans).select("field_id", "status")
    assert got.columns == want.columns and got.count() == 32
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert "(?s:.*)" in want._jdf.queryExecution().optimizedPlan().toString()
    assert "(?s:.*)" not in got._jdf.queryExecution().optimizedPlan().toString()
