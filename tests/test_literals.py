"""Literals that patterns need, and the scan with and without them."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from labelwright.functions.text import rx
from labelwright.operators import scan as S
from labelwright.rules import default_rules
from labelwright.rules.literals import folded, may_match, needed

PATTERNS = [p for f in default_rules().fields for p in (*f.patterns, *f.address_patterns)] + [S.ONLINE_LISTING]


@pytest.mark.parametrize(
    "pattern, want",
    [
        (r"(?:mrp|m\.r\.p\.)\s*\d+", {"m.r.p.", "mrp"}), (r"\d+\s*kg", {"kg"}), (r"[\d,]+", None), (r"(?:ab|\d)c", None), (r"(?:abc|abd)?x\d", None),
        (r"licen[cs]e\s+no", {"licence", "license"}), (r"(?:net\s*wt|qty)+:", {"net", "qty"}), (r"₹\s*\d", {"₹"}), (r"colou?r", {"color", "colour"}),
        (r"\bMade\s+in(?=x)", {"made"}), (r"a{2,}", None), (r"(?:fssai|fss)", {"fss"}),
    ],
)
def test_needed(pattern, want):
    got = needed(pattern)
    assert (None if got is None else set(got)) == want


def test_a_match_holds_a_needed_literal():
    random.seed(1)
    known = [p for p in PATTERNS if needed(p)]
    assert len(known) >= len(PATTERNS) - 8
    pieces = sorted({w for p in known for w in re.findall(r"[A-Za-z]+", p)}) + [" ", ":", "\n", "12", "14/2025", "₹ 5", "100140220027"]
    for _ in range(3000):
        text = "".join(random.choices(pieces, k=12))
        for p in known:
            if re.search(p, text, re.I | re.M):
                assert any(w in text.lower() for w in needed(p)), (p, text)


def test_letters_that_equal_ascii_ones(spark):
    texts = ["PRİCE: Rs. 5", "prıce: Rs. 5", "conſumer care: abcdef", "PACKED ON: 12/2024", "paKed on: 12/2024", "straße"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    low = folded(F.col("t"))
    for p in PATTERNS:
        worth = may_match(low, p)
        if worth is not None:
            assert df.filter(F.col("t").rlike(rx(p, "im")) & ~worth).count() == 0


def test_scan_is_the_same_without_literals(spark, monkeypatch):
    random.seed(2)
    pieces = sorted({w for p in PATTERNS for w in re.findall(r"[A-Za-z]{3,}", p)})
    rows = []
    for k in range(400):
        words = [random.choice([*pieces, ":", "\n", "500 g", "Rs. 45", "12/2024", "10014022002711", "Pune 411001", "Amazon listing"]) for _ in range(25)]
        rows.append((str(k), " ".join(words)))
    df = spark.createDataFrame(rows, "record_id string, text string")
    with_ = S.scan_labels(df).select("record_id", "score", "status", "fields").collect()
    monkeypatch.setattr(S, "may_match", lambda low, p: None)
    S._scan_columns.cache_clear()
    without = S.scan_labels(df).select("record_id", "score", "status", "fields").collect()
    S._scan_columns.cache_clear()
    assert sorted(with_) == sorted(without) and len({r.score for r in with_}) > 3
