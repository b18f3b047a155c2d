"""Rules over time, as-of joins, pages by cursor, and rows that are rejected."""

from __future__ import annotations

import json
import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from labelwright.operators import analytics as A
from labelwright.operators import scan as S
from labelwright.operators.joins import as_of_join, band_join, spread_join
from labelwright.rules import RuleHistory, RuleSet, default_rules, load_history
from labelwright.sources.labels import read_label_csv, tagged_label_csv, write_outcomes
from labelwright.sources.sinks import write_by_date

TEXT = "Manufactured by: Maker\nNet Weight: 5 g\nMRP: Rs. 5"
START = datetime(2024, 1, 1)


def test_each_row_is_scanned_with_the_rules_of_its_day(spark, tmp_path):
    fields = default_rules().fields
    old = RuleSet("v1", tuple(f for f in fields if f.id in ("F01", "F02")))
    new = RuleSet("v2", tuple(replace(f, severity="medium") for f in fields if f.id != "F08"))
    history = RuleHistory.of((datetime(2024, 6, 1), new), (datetime(2024, 1, 1), old))
    times = [datetime(2020, 1, 1), datetime(2024, 5, 31, 23, 59, 59), datetime(2024, 6, 1), datetime(2025, 1, 1), None]
    df = spark.createDataFrame([(str(i), TEXT, t) for i, t in enumerate(times)], "record_id string, text string, created_at timestamp")
    got = {r.record_id: r for r in S.scan_as_of(df, history).collect()}
    assert [got[str(i)].rule_version for i in range(5)] == ["v1", "v1", "v2", "v2", "v2"]
    assert [len(got[str(i)].fields) for i in range(5)] == [2, 2, 7, 7, 7]
    again = {r.record_id: r for r in S.scan_labels(df, old).collect()}
    assert got["0"] == again["0"] and got["0"].score != got["2"].score
    for name, at, rules in (("a", "2024-01-01", old), ("b", "2024-06-01T00:00:00", new)):
        doc = {"valid_from": at, "rule_version": rules.rule_version, "fields": [{"id": f.id, "label": f.label, "legal_ref": f.legal_ref, "severity": f.severity, "patterns": list(f.patterns), "address_patterns": list(f.address_patterns)} for f in rules.fields]}
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    loaded = load_history(spark, str(tmp_path))
    assert [v[1].rule_version for v in loaded.versions] == ["v1", "v2"]
    assert sorted((r.record_id, r.score) for r in S.scan_as_of(df, loaded).collect()) == sorted((k, r.score) for k, r in got.items())
    assert [(r.rule_version, r.valid_to) for r in history.to_frame(spark).orderBy("valid_from").collect()] == [("v1", datetime(2024, 6, 1)), ("v2", None)]
    with pytest.raises(ValueError):
        RuleHistory.of()
    with pytest.raises(ValueError):
        RuleHistory.of((START, old), (START, new))


@pytest.mark.parametrize("parts", [1, 7])
def test_as_of_join_with_a_hot_time(spark, parts):
    random.seed(3)
    rows = [(k, START + timedelta(hours=0 if k % 3 == 0 else random.randrange(-50, 3000))) for k in range(2000)] + [(-1, None), (-2, START), (-2, START)]
    versions = [(f"v{k}", START + timedelta(hours=k * 37)) for k in range(40)]
    left = spark.createDataFrame(rows, "k int, created_at timestamp").repartition(parts)
    right = spark.createDataFrame(versions, "version string, since timestamp")
    got = as_of_join(left, right, "created_at", "since")
    assert got.columns == ["k", "created_at", "version", "since"]
    want = sorted(((k, t, max(((s, v) for v, s in versions if t is not None and s <= t), default=(None, None))[1]) for k, t in rows), key=str)
    assert sorted(((r.k, r.created_at, r.version) for r in got.collect()), key=str) == want
    assert as_of_join(left, right.limit(0), "created_at", "since").filter("version is null").count() == len(rows)
    assert as_of_join(left.limit(0), right, "created_at", "since").count() == 0


def test_spread_and_band_joins(spark):
    random.seed(4)
    rows = [("hot" if random.random() < 0.4 else f"k{random.randrange(900)}", i) for i in range(3000)] + [(None, -1)]
    left = spark.createDataFrame(rows, "k string, i int")
    right = left.filter("k is not null and k <> 'k7'").groupBy("k").agg(F.count(F.lit(1)).alias("rows"), F.max("i").alias("most"))
    most = {}
    for k, i in rows:
        if k not in (None, "k7"):
            most[k] = max(i, most.get(k, i))
    got = spread_join(left, right, ["k"], "rows")
    assert got.columns == ["k", "i", "most"] and sorted(map(tuple, got.collect()), key=str) == sorted(((k, i, most.get(k)) for k, i in rows), key=str)
    points = [(random.choice("ab"), random.randrange(-60, 60), n) for n in range(150)]
    df = spark.createDataFrame(points, "g string, v int, n int")
    met = band_join(df, df, ["g"], "v", 7)
    want = sorted((a[2], b[2]) for a in points for b in points if a[0] == b[0] and abs(a[1] - b[1]) <= 7)
    assert sorted((r.n, r.n_2) for r in met.collect()) == want


def tables(spark, path, n=3000):
    random.seed(5)
    scans = spark.createDataFrame(
        [(f"s{k:05d}", f"product {k}", random.choice(["Amazon", "Flipkart"]), START + timedelta(hours=random.randrange(17_000))) for k in range(n)],
        "scan_id string, product_name string, platform string, created_at timestamp",
    )
    each = F.explode(F.array(*[F.lit(f) for f in ("F01", "F02", "F05")])).alias("field_id")
    rows = scans.select("scan_id", "created_at", each, F.lit("label").alias("field_label"), F.lit("ref").alias("legal_reference"), F.lit("why").alias("reason"))
    rows = rows.withColumn("severity", F.when(F.col("field_id") == "F05", "medium").otherwise("high"))
    write_by_date(scans, f"{path}/scans", 10)
    write_by_date(rows, f"{path}/violations", 10)
    return spark.read.parquet(f"{path}/violations"), spark.read.parquet(f"{path}/scans")


def test_pages_by_cursor_equal_pages_by_offset(spark, tmp_path):
    violations, scans = tables(spark, str(tmp_path))
    for args in ({}, {"severity": "high", "platform": "ama"}):
        every = A.violations_with_scans(violations, scans.drop("scan_date", "scan_month"), **args).orderBy(F.desc("created_at"), "scan_id", "field_id").collect()
        key = lambda r: (r.created_at, r.scan_id, r.field_id)
        for at in (0, 1, 700, len(every) - 60, len(every)):
            cursor = key(every[at - 1]) if at else None
            page = A.violation_page_after(violations, scans, cursor, 50, **args)
            assert [key(r) for r in page.collect()] == [key(r) for r in every[at : at + 50]]


def test_a_late_page_reads_no_more_files_than_the_first(spark, tmp_path):
    violations, scans = tables(spark, str(tmp_path), 9000)
    every = violations.orderBy(F.desc("created_at"), "scan_id", "field_id").select("created_at", "scan_id", "field_id").collect()
    months = lambda page: {(r.created_at.year, r.created_at.month) for r in page.collect()}
    first = A.violation_page_after(violations, scans, None, 20)
    late = A.violation_page_after(violations, scans, tuple(every[20_000]), 20)
    assert len(months(late)) <= 2
    wanted = lambda page: page._jdf.queryExecution().optimizedPlan().toString().count("scan_month")
    assert wanted(late) <= wanted(first) + 4
    filters = [line for line in late._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in line]
    assert filters and all("scan_month" in line.split("PartitionFilters")[1][:90] for line in filters)


def test_every_row_of_a_file_is_accepted_or_rejected(spark, tmp_path):
    lines = ["text,platform", '"a long enough label\nin two lines",Amazon', '"   ",x', "short,y", '"another long ""quoted"" label",', "too,many,cells,here", "alone long enough", '"a long enough label\nin two lines",Amazon']
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    tagged = tagged_label_csv(spark, str(tmp_path / "in.csv"))
    counts = write_outcomes(tagged, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert counts == {"accepted": 3, "malformed row": 2, "blank text": 1, "text too short": 1} and back.count() == 7
    assert {r.reason: r["count"] for r in back.groupBy("reason").count().collect()} == counts
    broken = {r.raw_row for r in back.filter("reason = 'malformed row'").collect()}
    assert "too,many,cells,here" in broken
    taken = back.filter("reason = 'accepted'")
    assert taken.select("record_id").distinct().count() == 3 and {r.platform for r in taken.collect()} == {"Amazon", ""}
    (tmp_path / "none.csv").write_text("text\n", encoding="utf-8")
    assert write_outcomes(tagged_label_csv(spark, str(tmp_path / "none.csv")), str(tmp_path / "empty")) == {}
    (tmp_path / "bad.csv").write_text("label\nx\n", encoding="utf-8")
    for read in (tagged_label_csv, read_label_csv):
        with pytest.raises(ValueError):
            read(spark, str(tmp_path / "bad.csv"))
