"""Layout of the scan tables, daily rollups, and ids that have been stored."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from labelwright.operators import analytics as A
from labelwright.operators import rollups as R
from labelwright.operators import scan as S
from labelwright.sources import seen
from labelwright.sources.schemas import LABELS_IN
from labelwright.sources.sinks import write_by_date, write_scans
from labelwright.streaming import live_platforms, live_trends, read_labels, scan_stream, write_scan_stream

TEXT = "Manufactured by: Maker\nNet Weight: 5 g\nMRP: Rs. 5"
SCAN = "scan_id string, category string, platform string, status string, score int, created_at timestamp"


def scans(spark, n=3000, days=400):
    random.seed(7)
    start = datetime(2024, 1, 1, 3)
    rows = [
        (
            f"s{k}", random.choice(["a", "b", None]), random.choice(["x", "y"]), random.choice(["PASS", "FAIL", "PARTIAL"]), random.randrange(101),
            start + timedelta(days=0 if k % 3 == 0 else random.randrange(days), minutes=random.randrange(1200)),
        )
        for k in range(n)
    ]
    return spark.createDataFrame(rows, SCAN)


def parquet_files(path):
    return [str(p) for p in Path(path).rglob("*.parquet")]


def test_files_are_few_and_hot_days_are_split(spark, tmp_path):
    df = scans(spark).repartition(8)
    write_by_date(df, str(tmp_path / "one"), 10)
    assert len(parquet_files(tmp_path / "one")) <= 14  # a file a month
    write_by_date(df, str(tmp_path / "many"), 2000, file_bytes=100)  # 20 ranges
    assert len(parquet_files(tmp_path / "many")) <= 14 + 20
    back = spark.read.parquet(str(tmp_path / "many"))
    assert sorted(back.select(*df.columns).collect(), key=str) == sorted(df.collect(), key=str)
    hot = back.filter("scan_date = '2024-01-01'").select(F.input_file_name()).distinct().count()
    assert hot >= 5  # a third of the rows
    pruned = A.recent(back, F.lit(datetime(2024, 12, 1)))
    assert len(pruned.inputFiles()) == len(back.inputFiles()) and "scan_month" in pruned._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:80]


@pytest.mark.parametrize("now", [datetime(2024, 12, 31, 9, 30), datetime(2025, 1, 1)])
def test_reports_from_rollups_equal_those_from_scans(spark, tmp_path, now):
    df = scans(spark)
    write_by_date(df, str(tmp_path / "scans"), 10)
    stored = spark.read.parquet(str(tmp_path / "scans"))
    a, b = df.filter("hash(scan_id) % 2 = 0"), df.filter("hash(scan_id) % 2 <> 0")
    merged = R.merged(R.rollup_rows(a), R.rollup_rows(b))
    assert R.summary(merged).collect() == A.summary(df).collect()
    assert R.by_category(merged).collect() == A.by_category(df).collect()
    assert R.by_platform(merged, top=1).collect() == A.by_platform(df, top=1).collect()
    assert R.trends(merged, stored, F.lit(now), 60).collect() == A.trends(df, F.lit(now), 60).collect()
    empty = R.summary(R.rollup_rows(df.limit(0))).first()
    assert empty.total_scans == 0 and empty.avg_score == 0


def late_input(spark, path):
    for i, day in enumerate(("2025-03-01", "2025-03-02", "2025-01-01")):
        row = [(str(i), f"{TEXT} {i}", "TEXT", None, None, "P", None)]
        spark.createDataFrame(row, LABELS_IN).selectExpr("* except (created_at)", f"timestamp'{day} 10:00:00' AS created_at").coalesce(1).write.mode("append").parquet(path)


def test_a_row_sixty_days_late_changes_its_day(spark, tmp_path):
    late_input(spark, str(tmp_path / "in"))
    write_scan_stream(read_labels(spark, str(tmp_path / "in"), files_per_batch=1), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    rolled = R.read_rollups(spark, str(tmp_path / "out"))
    assert {r.date: r.scans for r in R.daily(rolled).collect()} == {"2025-03-01": 1, "2025-03-02": 1, "2025-01-01": 1}
    assert R.summary(rolled).first().total_scans == 3
    for report in (live_trends, live_platforms):
        out, path = [], str(tmp_path / report.__name__)
        live = report(scan_stream(read_labels(spark, str(tmp_path / "in"), files_per_batch=1)))
        live.writeStream.outputMode("complete").foreachBatch(lambda d, _, out=out: out.append(d.collect())).option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()
        assert {r.date for r in out[-1]} == {"2025-03-01", "2025-03-02", "2025-01-01"}


def test_files_read_do_not_grow_when_ids_are_new(spark, tmp_path):
    path, read = str(tmp_path), []
    for batch in range(6):
        ids = spark.range(batch * 2000, batch * 2000 + 2000).select(F.concat(F.lit("id"), "id").alias("scan_id"))
        new, maybe = seen.split_new(ids, path)
        assert new.count() + (0 if maybe is None else maybe.count()) == 2000 and seen.unseen(ids, path, str(batch)).count() == 2000
        state, valid = seen.filters(spark, path)
        read.append(0 if state is None else len(state.inputFiles()))
        seen.remember(ids, path, str(batch))
    assert max(read) <= 2 * (max(valid) + 1) and read[-1] <= read[2] + 2
    again = spark.range(3000, 13_000).select(F.concat(F.lit("id"), "id").alias("scan_id"))
    assert seen.unseen(again, path, "9").count() == 1000
    # a batch that is written again finds its own ids new
    own = spark.range(2000, 4000).select(F.concat(F.lit("id"), "id").alias("scan_id"))
    assert seen.unseen(own, path, "1").count() == 2000
    assert seen.unseen(own.union(own), path, "2").count() == 0


def test_layers_grow_and_a_broken_version_does_not_count(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(seen, "LEAST_BITS", 64)
    path = str(tmp_path)
    for batch in range(5):
        seen.remember(spark.range(batch * 300, batch * 300 + 300).select(F.col("id").cast("string").alias("scan_id")), path, str(batch))
    _, valid = seen.filters(spark, path)
    assert len(valid) > 1 and valid[max(valid)][3] > valid[0][3]
    ids = spark.range(1600).select(F.col("id").cast("string").alias("scan_id"))
    assert seen.unseen(ids, path, "x").count() == 100
    layer = max(valid)
    slot = valid[layer][0]
    part = spark.read.parquet(f"{path}/seen/layer={layer}/slot={slot}").withColumn("version", F.lit(99).cast("bigint")).limit(5)
    part.write.mode("overwrite").parquet(f"{path}/seen/layer={layer}/slot={1 - slot}")
    assert seen.filters(spark, path)[1] == valid


def test_batches_and_streams_share_the_ids(spark, tmp_path):
    late_input(spark, str(tmp_path / "in"))
    labels = spark.read.schema(LABELS_IN).parquet(str(tmp_path / "in"))
    from labelwright.sources.labels import label_records

    write_scans(S.scan_labels(S.with_scan_id(label_records(labels))), str(tmp_path / "out"), "upload")
    write_scan_stream(read_labels(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "scans")).count() == 3


def test_order_labels_are_dealt_into_parts_of_like_size(spark):
    from labelwright.plans import q_scan

    labels = q_scan.order_labels(spark, "/root/testdata/sf0.01")
    sizes = [r["count"] for r in labels.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    # the engine does not put the parts together, so that no core waits for a last large one
    assert len(sizes) >= 4 * spark.sparkContext.defaultParallelism
    assert max(sizes) < 2 * sum(sizes) / len(sizes)
