from __future__ import annotations

import random

from pyspark.sql import functions as F

from labelwright.llm import nearest
from labelwright.llm.nearest import search

NAN, INF = float("nan"), float("inf")


def rows():
    random.seed(2)
    out = [(i, [random.gauss(0, 1) for _ in range(8)]) for i in range(0, 400)]
    out += [(400 + i, [1.0, 2.0, 0.5, 0.0, 0.0, -1.0, 3.0, 1.0]) for i in range(200)]  # ties
    out += [(1000, None), (1020, []), (1040, [0.0] * 8), (1060, [1.0, NAN] + [0.0] * 6), (1080, [INF] + [0.0] * 7), (1100, [None] + [1.0] * 7), (None, [1.0] * 8)]
    out += [(1200, [1.0, 2.0]), (1201, [2.0, 1.0]), (1220, [1.0, 0.0, 1e-3]), (1240, [1e30] * 8), (1241, [1e-30] * 8), (20, [0.1] * 8)]
    return out


def brute(table, k=20):
    good = [(i, v) for i, v in table if i is not None and v and all(x is not None and abs(x) < INF for x in v) and any(v)]
    out = []
    for q, a in good:
        if q % 20 == 0:
            scored = []
            for c, b in good:
                if c != q and len(a) == len(b):
                    total = 0.0
                    for x, y in zip(a, b, strict=True):
                        total += x * y
                    scored.append((-total, c))
            out += [(q, n, c, -s) for n, (s, c) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def result(spark, table, k=20):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in table], "vec_id bigint, embedding array<double>, label int, score string").repartition(3)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in search(df, F.col("vec_id") % 20 == 0, k).collect())


def test_equals_brute_force(spark):
    table = rows()  # the id 20 has two vectors
    assert result(spark, table) == brute(table)
    assert result(spark, table, 3) == brute(table, 3)


def test_repeated_query_rows(spark):
    table = rows() + [rows()[20], rows()[20], rows()[40], rows()[41]]
    got = result(spark, table)
    assert got == brute(table)
    for q in (20, 40):  # every list is whole: as many of each rank as there are rows of the id
        ranks = [r for i, r, _, _ in got if i == q]
        assert ranks == sorted([*range(1, 21)] * sum(i == q for i, _ in table))


def test_query_blocks_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(nearest, "TILE", 700)
    monkeypatch.setattr(nearest, "CANDIDATE_BYTES", 9000)
    table = rows() + [rows()[60]]
    assert result(spark, table) == brute(table)


def test_rows_are_read_once_by_many_blocks(spark, monkeypatch):
    table = spark.createDataFrame(rows(), "vec_id bigint, embedding array<double>")
    plans = []
    for size in (2000, 200):
        monkeypatch.setattr(nearest, "BLOCK_BYTES", size)
        plans.append(search(table, F.col("vec_id") % 20 == 0)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD"))
    assert plans[0] == plans[1]


def test_few_or_no_rows(spark):
    assert result(spark, []) == []
    assert result(spark, [(0, [1.0, 1.0]), (3, [1.0, 0.0])]) == [(0, 1, 3, 1.0)]
    assert result(spark, [(1, [1.0])]) == []
