"""Lookaheads that patterns start with, and captures read in one run."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from labelwright.functions import images as I
from labelwright.functions.heads import always_captures, factored, guard, looks_back
from labelwright.functions.text import first_capture, rx
from labelwright.operators import scan as S
from labelwright.rules import default_rules

RULES = [p for f in default_rules().fields for p in (*f.patterns, *f.address_patterns)] + [S.ONLINE_LISTING]
MORE = [r"(?:ab|\d)c", r"a?bc", r"(?:abc|abd)?x\d", r"\b(?:kg|is)\b", r"(?:a|b)*c", r"(ab){2}", r"(?:ſ|é)x", r"^x$|yz", r"(?=a)ab", r"(?:₹|rs)\s*\d", r"[^a]bc", r"(?:a{2,}|b)c", r"x*", r"(?:a|)b"]


@pytest.mark.parametrize(
    "pattern, want",
    [
        (r"(?:mfg|packed)\s*on", "(?=(?-i:[MPmp][AFaf][CGcg]))"), (r"\b(ab|cd)", "(?=(?-i:[ACac][BDbd]))"), (r"is\d", "(?=(?-i:[Iiİ-K][Ssİ-K]))"),
        (r"(?:ab|\d)c", ""), (r"x*", ""), (r"(?:a|)b", "(?=(?-i:[ABab]))"), (r"(?:é|x)y", ""), (r"(unclosed", ""),
    ],
)
def test_guard(pattern, want):
    assert guard(pattern) == want


def test_guards_change_no_match(spark):
    random.seed(3)
    pieces = sorted({w for p in RULES + MORE for w in re.findall(r"[A-Za-z]+", p)}) + [" ", ":", "\n", "12", "14/2025", "₹ 5", "10014022002711", "ſ", "K", "K", "İ", "ı", "é", "😀"]
    rows = [("".join(random.choices(pieces, k=random.choice([1, 2, 3, 20]))),) for _ in range(1500)]
    df = spark.createDataFrame([*rows, ("",), (None,)], "t string").coalesce(2).cache()
    t = F.col("t")
    guarded = [p for p in RULES + MORE if guard(p)]
    assert len(guarded) > 40
    for start in range(0, len(guarded), 8):
        wrong = F.lit(False)
        for p in guarded[start : start + 8]:
            for flags in ("", "im"):
                wrong = wrong | ~F.regexp_extract_all(t, F.lit(rx(p, flags)), F.lit(0)).eqNullSafe(F.regexp_extract_all(t, F.lit(f"(?Ud{flags}){p}"), F.lit(0)))
        assert df.filter(wrong).count() == 0


def test_always_captures_and_looks_back():
    assert always_captures(r"a([0-9]+)", 1) and always_captures(r"a", 0) and always_captures(r"(?:x(b))", 1)
    assert not always_captures(r"a([0-9]*)", 1) and not always_captures(r"a([0-9])?", 1) and not always_captures(r"(?:a|(b))", 1) and not always_captures(r"a*", 0)
    assert looks_back(r"\bx") and looks_back(r"^x") and looks_back(r"(?<=a)b") and looks_back(r"(?:a|\bb)") and not looks_back(r"x(?=a)$")


def test_first_capture(spark):
    df = spark.createDataFrame([("ab:  x12",), ("c7",), ("a",), ("",), (None,), ("dd",)], "t string")
    patterns = [(r"b:(\s*)", "", 1), (r"c(\d?)", "", 1), (r"(a)", "", 1), (r"d+", "", 0)]
    got = [tuple(r["x"]) for r in df.select(first_capture(F.col("t"), patterns).alias("x")).collect()]
    assert got == [(1, "  "), (2, "7"), (3, "a"), (0, None), (0, None), (4, "dd")]
    assert first_capture(F.col("t"), [(r"x*", "", 0)]) is not None


def test_evidence_of_wide_characters_and_words(spark):
    rules = default_rules()
    texts = ["😀" * 40 + "Made in Italy." + "😀" * 40, "remade in x\nMade in Nepal, " + "y" * 50, "MRP: Rs. 5"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "record_id string, text string")
    found = {(r.record_id, r.field_id): r.evidence for r in S.field_rows(S.scan_labels(df, rules).withColumn("scan_id", F.col("record_id")).withColumn("record_id", F.col("record_id"))).selectExpr("scan_id as record_id", "field_id", "evidence").collect()}
    assert found["0", "F07"] == "..." + "😀" * 30 + "Made in Italy." + "😀" * 30 + "..."
    assert found["1", "F07"].startswith("...remade in x Made in Nepal,")
    assert found["2", "F05"] == "...MRP: Rs. 5..."


def test_index_and_capture_share_a_run(spark):
    """The capture of a rule comes with its index: no pattern of the default rules runs again for its value."""
    df = spark.createDataFrame([("1", "MRP: Rs. 5")], "record_id string, text string")
    plan = S.scan_labels(df).select("score", "status")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(rx(default_rules().fields[1].patterns[0], "im")[:60]) == 1


def test_factored_patterns_match_the_same_texts(spark):
    random.seed(4)
    patterns = [p for n, p in vars(I).items() if n.isupper() and isinstance(p, str) and "|" in p] + [*I.SIGNALS.values(), "ab|a|b|cd|c?d", "a*|ab|ac|^b", "(a|b)|ab|c|d", r"[a\]]b|[a\]]c|\.x|\.y"]
    changed = [p for p in patterns if factored(p) != p]
    assert len(changed) > 15
    assert factored(r"ab1|ac2|b|d\d") == r"a(?:b1|c2)|b|d\d"
    pieces = sorted({w for p in changed for w in re.findall(r"[A-Za-z]+", p)}) + list("/_-.:% ") + ["12", "100%", "1500_", "₹ 5", "10014022002711", "ſ", "ı", "İ"]
    rows = [("".join(random.choices(pieces, k=random.choice([1, 2, 4, 12]))),) for _ in range(3000)]
    df = spark.createDataFrame([*rows, ("",)], "t string").coalesce(2).cache()
    t = F.col("t")
    for start in range(0, len(changed), 8):
        wrong = F.lit(False)
        for p in changed[start : start + 8]:
            for flags in ("", "i"):
                wrong = wrong | (t.rlike(rx(factored(p), flags)) != t.rlike(f"(?Ud{flags}){p}"))
        assert df.filter(wrong).count() == 0


def test_a_rejecting_pattern_runs_once_a_row(spark):
    from labelwright.operators import images as M

    cols = "product_id string, ord int, url string, alt string, source string, score int, visual_score int, phash string, ocr_text string"
    df = spark.createDataFrame([("1", 1, "https://x/back.jpg", "", "adapter", 1, 1, "", "MRP Rs. 5")], cols)
    plan = M.score_images(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(rx(factored(I.REJECT_URL))[:200]) == 1


def test_attribute_patterns_run_only_where_their_literals_stand(spark):
    """The same values with and without the folded text; a pattern that always captures is not tested first."""
    from labelwright.functions import entities as E
    from labelwright.rules.literals import folded

    random.seed(5)
    names = [n for n in E.PATTERNS if n != "fssai"]
    pieces = sorted({w for n in names for p, _ in E.PATTERNS[n] for w in re.findall(r"[A-Za-z]{3,}", p)}) + [":", "\n", "\n\n", "500 g", "Rs. 45", "12/2024", "10014022002711", "Pune 411001", ",", "ıſ"]
    df = spark.createDataFrame([(" ".join(random.choices(pieces, k=25)),) for _ in range(300)] + [("",), (None,)], "t string")
    t, low = F.col("t"), F.col("low")
    rows = df.withColumn("low", folded(t)).cache()
    for n in names:
        plain = [F.when(t.rlike(rx(p, f)), F.regexp_extract(t, rx(p, f), 1)) for p, f in E.PATTERNS[n]]
        want = E.clean_entity_text(F.coalesce(*plain))
        assert rows.filter(~E.first_attribute(t, n, low).eqNullSafe(want)).count() == 0
    assert rows.filter(~E.licence_number(t, low).eqNullSafe(E.licence_number(t))).count() == 0
    shown = rows.select(E.first_attribute(t, "net_quantity", low))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in shown


def test_tests_do_not_follow_repeats_at_their_ends():
    from labelwright.functions.heads import tested

    assert tested(r"(?:\d{1,4}[,\s]+[a-z][^\n]{10,100}(?:rd|st)[^\n]{0,60})") == r"(?:\d[,\s]+[a-z][^\n]{10,100}(?:rd|st))"
    assert tested(r"x{2,5}(?:y|z{1,3})+") == "x{2}(?:y|z)"
    assert tested(r"x?\by*") == r"\b"
    assert tested(r"\d{1,4}+a") == r"\d{1,4}+a" and tested(r"\x41?b") == r"\x41?b"
    rng = random.Random(7)
    pieces = ["12", "3456", "400612", " ", ", ", "\n", "-", "Plot", "K-5", "Main", "road", "st", "UP", "Bihar", "abc def gh", "Mfd by: ", "MRP Rs. 5", "net wt 5 kg", "₹"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(4000)]
    for f in default_rules().fields:
        for p in (*f.patterns, *f.address_patterns, *(g for g in f.address_guards if g)):
            one, other = re.compile(p, re.I | re.M), re.compile(tested(p).replace("(?-i:", "(?:"), re.I | re.M)
            assert [bool(one.search(t)) for t in texts] == [bool(other.search(t)) for t in texts], p
