from __future__ import annotations

import math
import random

import numpy as np
import pytest

from labelwright.llm.queries import R
from labelwright.llm.whitening import whiten

SCHEMA = "vec_id bigint, embedding array<float>"


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def brute(rows, k=4, weights="one"):
    """(vec_id, n, deviation, whitened, explained) of each usable row, all of one length."""
    grid = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in rows if usable(v)]
    distinct = sorted({x for _, x in grid})
    w = np.array([sum(x == y for _, y in grid) if weights == "count" else 1 for x in distinct])
    x, n = np.array(distinct, object), int(w.sum())
    total = (x * w[:, None]).sum(axis=0)
    z = (x * n - total).astype(float) / n
    value, vector = np.linalg.eigh((z * w[:, None]).T @ z / n)
    value, vector = value[::-1], vector[:, ::-1]
    out = []
    for i, v in grid:
        diff = np.array(v, object) * n - total
        out.append((i, n, int((diff * diff).sum()), (diff.astype(float) / n) @ vector[:, :k] / np.sqrt(value[:k]), value[:k] / value.sum()))
    return out


def vectors(n=400, d=7):
    rng = np.random.default_rng(8)
    made = rng.normal(size=(n, d)) * np.arange(1, d + 1) @ rng.normal(size=(d, d)) / 9
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(made)]
    rows += [(1000 + k, rows[5][1]) for k in range(200)] + [(7, rows[7][1]), (None, rows[8][1])]
    rows += [(2000, None), (2001, [1.0] * 6 + [None]), (2002, [float("nan")] * 7), (2003, [float("inf")] * 7)]
    rows += [(2004, [0.0] * 7), (2005, [-0.0] * 7)]
    random.seed(1)
    random.shuffle(rows)
    return rows


def same(got, want):
    got = sorted(got, key=lambda r: (str(r["vec_id"]), r["deviation"]))
    want = sorted(want, key=lambda r: (str(r[0]), r[2]))
    assert [(r["vec_id"], r["n"], r["deviation"]) for r in got] == [w[:3] for w in want]
    a, b = np.array([r["whitened"] for r in got]), np.array([w[3] for w in want])
    sign = np.sign((a * b).sum(axis=0))
    assert np.allclose(a * sign, b, atol=1e-9) and np.allclose([r["explained"] for r in got], [w[4] for w in want], rtol=1e-9)
    assert all(r["identity_error"] < 1e-9 for r in got)


@pytest.mark.parametrize("weights", ["one", "count"])
def test_equals_brute_force(spark, weights):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    same(whiten(df, weights=weights).collect(), brute(rows, weights=weights))


def test_large_numbers_are_exact(spark):
    rows = [(k, [float(2**40 + 3 * k * k), float(-(2**41)) + k]) for k in range(50)]
    got = {r.vec_id: r.deviation for r in whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), components=2).collect()}
    x = [[math.floor(256 * c) for c in v] for _, v in rows]
    total = [sum(c) for c in zip(*x, strict=True)]
    assert got == {k: sum((50 * c - t) ** 2 for c, t in zip(v, total, strict=True)) for k, v in enumerate(x)}
    wide = [(k, [float(10**15 * k)]) for k in range(3)]
    assert {r.deviation for r in whiten(spark.createDataFrame(wide, "vec_id bigint, embedding array<double>")).collect()} == {None, 0}


def test_defined_cases(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, []), (3, [0.5]), (4, [0.7]), (5, [1.5, 2.0]), (6, [3.0, 3.0, 3.0])]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "vec_id bigint, embedding array<double>, other string, n double")
    got = sorted(whiten(df).collect(), key=lambda r: r.vec_id)
    assert [(r.vec_id, r.other, r.n, r.deviation) for r in got[:2]] == [(1, "x", 2, 128**2)] * 2
    assert got[2].whitened == [] and got[3].n == 2 and np.allclose(sorted(r.whitened[0] for r in got[3:5]), [-1, 1])
    # one vector, or an axis along which all agree: no variance
    assert got[6].whitened == [None] * 3 and got[6].explained == [0.0] * 3 and got[6].identity_error is None
    assert abs(abs(got[0].whitened[0]) - 1) < 1e-12 and got[0].whitened[1] is None and got[0].explained == [1.0, 0.0] and got[0].identity_error < 1e-12
    empty = whiten(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["vec_id", "embedding", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whiten(spark.createDataFrame([(1, None)], SCHEMA)).count() == 0


def test_query(spark, tmp_path):
    rows = vectors(120, 9)
    rows = [(i, v) for i, v in rows if v is None or len(v) == 9]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = R["op12_embedding_whitening"].run(spark, str(tmp_path))
    assert got.dtypes == [
        ("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"),
    ]
    want = brute(rows)
    found = got.collect()
    assert len(found) == 4 * len(want) and sorted({r.component for r in found}) == [1, 2, 3, 4] and {r.n for r in found} == {want[0][1]}
