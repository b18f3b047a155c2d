"""Values of a page that hold a whole element are made once, not once to test and once to return."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from labelwright.functions import html as H
from labelwright.operators import pages as P

PAGE = "<body><main><div id='a'>one <div>two</div></div><div id='b'> </div></main></body>"


@pytest.mark.parametrize(("of", "reads", "value"), [(H.section, 1, "one <div>two</div>"), (lambda h, i: H.element_text(h, H.by_id(i)), 3, "one two")])
def test_an_element_is_made_once(spark, of, reads, value):
    df = spark.createDataFrame([(PAGE, None)], "html string, first string")
    got = df.select(*[F.coalesce("first", of(F.col("html"), i)).alias(i) for i in ("a", "b", "c")])
    assert got.first().a == value and got.first().c is None
    plan = got.select("a")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == reads


def test_the_cleaned_page_is_made_once(spark):
    df = spark.createDataFrame([("p", "https://shop.example.com/x", "<html>" + PAGE + "</html>")], "page_id string, url string, html string")
    got = P.listing_texts(df)
    assert "one" in got.first().extracted_text and "two" in got.first().extracted_text
    assert got._jdf.queryExecution().optimizedPlan().toString().count("<nav") <= 2
