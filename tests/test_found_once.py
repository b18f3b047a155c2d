"""What is looked for in a text is looked for once, cheapest first, and only what is read is computed."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from labelwright.functions import geo as G
from labelwright.functions import heads
from labelwright.functions.heads import ahead
from labelwright.functions.text import bind, matches, replace_all, rx, strip
from labelwright.operators import scan as S
from labelwright.rules.literals import needed, sought


def test_a_country_is_found_once(spark):
    df = spark.createDataFrame([("Pune 411001, Maharashtra",)], "t string")
    plan = df.select(bind(F.col("t"), G.detect_country))._jdf.queryExecution().optimizedPlan().toString()
    # a lambda is printed with its own names and with those of the one around it
    once = df.select(bind(F.col("t"), lambda t: bind(F.lower(t), F.length)))._jdf.queryExecution().optimizedPlan().toString().count("lower(")
    assert [plan.count(s) for s in ("lower(", G.STATE_SIGNAL[:40], G.PHONE_SIGNAL[:10])] == [once] * 3


def test_countries_as_by_patterns_in_order(spark):
    random.seed(11)
    words = [*{c for _, c in G.COUNTRY_PATTERNS}, "PRC", "People's Republic", "Republic of Korea", "U.S.A.", "U.K.", "TÜRKIYE", "ſpain", "İsrael", "K", "Goa", "puneX", "411001", "10014022002711", "x", "_"]
    rows = [(random.choice([" ", "  ", "", "-", "\n", " "]).join(random.choices(words, k=random.choice([1, 2, 3, 6]))),) for _ in range(3000)]
    df = spark.createDataFrame([*rows, ("",), (None,)], "t string").coalesce(2).cache()
    t = F.col("t")
    plain = F.when(t.isNull() | (F.length(strip(t)) < 5), None).when(t.rlike("(?Udi)" + G.INDIA_PLACES), "India")
    for p, country in G.COUNTRY_PATTERNS:
        plain = plain.when(t.rlike("(?Udi)" + p), country)
    plain = plain.when(replace_all(t, r"\d{14}", "", "").rlike("(?Ud)" + G.PIN_ANY), "India")
    assert df.filter(~bind(t, G.infer_country).eqNullSafe(plain)).count() == 0
    assert df.select(bind(t, G.infer_country).alias("c")).distinct().count() > 20


def test_a_word_boundary_is_tried_last(spark):
    assert ahead(r"\b(ab|cd)") == "(?<![0-9A-Z_a-z])(?=[ACac][BDbd])" and "?<!" not in ahead(r"(?:\bab|cd)") and ahead(r"\b|x") == ""
    assert ahead(r"\b(?:₹|rs)\d").startswith("(?=") and ahead(r"(?:mfg|packed)\s*on") == "(?=[MPmp][AFaf][CGcg])" and ahead(r"x*") == ""
    random.seed(12)
    patterns = [G.INDIA_PLACES, G.any_country_pattern(), r"\bveg\b|\bkg\b", r"\b(?:_a|1b)\b", r"(?:\bab|cd)", r"\bmade\s+in\b", r"\b[1-9]\d{5}\b"]
    pieces = ["Pune", "Goa", "India", "USA", "veg", "kg", "K", "g", "_a", "1b", "ab", "cd", "made", "in", "411001", " ", " ", " ", "-", "_", "é", "é", "́", "ſ", "İ", "😀", "Ⅰ", "٣"]
    rows = [("".join(random.choices(pieces, k=random.choice([1, 2, 3, 8]))),) for _ in range(4000)]
    df, t = spark.createDataFrame(rows, "t string").coalesce(2).cache(), F.col("t")
    wrong = F.lit(False)
    for p in patterns:
        for flags in ("", "i"):
            wrong = wrong | (matches(t, p, flags) != t.rlike(f"(?Ud{flags}){p}"))
            wrong = wrong | ~F.regexp_extract_all(t, F.lit(rx(p, flags)), F.lit(0)).eqNullSafe(F.regexp_extract_all(t, F.lit(f"(?Ud{flags}){p}"), F.lit(0)))
    assert df.filter(wrong).count() == 0


def test_inner_choices_stand_together_by_their_beginnings():
    assert "nited(?:\\s*States|\\s*Kingdom)" in heads.tested(G.any_country_pattern())


def test_a_literal_is_looked_for_from_its_rarest_letter():
    assert sought("expiry") == "xpiry" and sought("marketed") == "keted" and sought("best") == "best" and sought("m.r.p") == "m.r.p" and sought("₹") == "₹"
    for p, _ in G.COUNTRY_PATTERNS:
        assert all(w.endswith(sought(w)) and len(sought(w)) >= min(4, len(w)) for w in needed(p) or ())


def test_the_length_of_a_text_is_taken_once(spark):
    df = spark.createDataFrame([("1", "MRP: Rs. 5")], "record_id string, text string")
    plan = S.scan_labels(df).select("violations")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"length\(text#\d+\)", plan)) == 1


def test_signals_of_a_text_are_tested_once(spark):
    from labelwright.functions import images as I

    df = spark.createDataFrame([("FSSAI Lic. No. 10014022002711 INGREDIENTS: Oats",)], "t string")
    plan = df.select(bind(F.col("t"), I.text_signals))._jdf.queryExecution().optimizedPlan().toString()
    # as above, a lambda is printed twice
    assert plan.count("regexp_extract_all(") == 2
    got = df.select(bind(F.col("t"), I.text_signals).alias("s")).first().s
    assert got.signals.has_fssai and got.signals.has_ingredients and got.signals.word_count == 6
