"""Corpora are dealt into several parts a core, and hold the rows that their text states."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from labelwright.plans import corpus as C

SF = os.environ.get("LABELWRIGHT_TEST_SF", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["PRODUCT_PAGES", "PRODUCT_LABELS", "WEB_RECORDS", "PACK_CODES", "IMAGE_CANDIDATES"])
def test_parts_and_rows(spark, name):
    text = getattr(C, name)
    dealt = C.pages(spark, SF) if name == "PRODUCT_PAGES" else C.frame(spark, SF, text)
    assert dealt.select(F.spark_partition_id().alias("p")).distinct().count() >= 2 * spark.sparkContext.defaultParallelism
    plain = spark.sql(C._named(text, lambda t: f"parquet.`{SF}/{t}.parquet`"))
    assert dealt.columns == plain.columns
    assert dealt.exceptAll(plain).count() == 0 and plain.exceptAll(dealt).count() == 0
