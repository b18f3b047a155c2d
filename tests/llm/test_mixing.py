from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import pytest

from labelwright.llm.mixing import SCHEDULES, integrated, mix, running_sums, source_targets, training_order
from labelwright.llm.queries import R

DOCS = "doc_id bigint, text string, source string"


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by rounds: what a full source can't give goes to the others by weight."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if most * sizes[s] <= level * weight[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return target


def brute_mix(rows, seed="mix"):
    by = defaultdict(list)
    for k, (i, t, s) in enumerate(rows):
        by[s].append((hashlib.md5(f"{seed}:{i}".encode()).hexdigest() if i is not None else "", -1 if i is None else i, len((t or "").encode().split()), k))
    sizes = {s: sum(d[2] for d in ds) for s, ds in by.items()}
    target, out = brute_targets(sizes), Counter()
    for s, ds in by.items():
        left = int(target[s] + 0.5)
        for _ in range(2):
            for *_, n, k in sorted(ds):
                took = min(n, left)
                left -= took
                out[k] += took
    return sorted(((i, len((t or "").encode().split()), sizes[s], round(target[s], 6), out[k]) for k, (i, t, s) in enumerate(rows)), key=str)


def corpus(n=400):
    random.seed(2)
    rows = []
    for k in range(n):
        source = random.choice(["big"] * 6 + ["a", "é", "Z", "ｚ", "😀", "", None, f"s{random.randrange(12)}"])
        text = random.choice([None, "", "\n\t", " ".join(["w"] * random.randrange(1, 200)), "x y z" * random.randrange(1, 9)])
        rows.append((None if k % 50 == 0 else k, text, source))
    return rows + [(7, "one two three", "big")] * 5 + [(9000, "w " * 20_000, "s1")]


@pytest.mark.parametrize("rows", [corpus(), corpus(20), [(1, "a b c", "only")], [(1, "a", "x"), (2, "b " * 999, "y")], [(1, None, None), (2, "", "z")]])
def test_equals_brute_force(spark, rows):
    mixed = mix(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixed), key=str) == brute_mix(rows)
    took = Counter()
    for r in mixed:
        took[r.source] += r.taken
        assert r.taken <= 2 * r.size and r.taken == sum(p.words for p in r.passes) and len(r.passes) <= 2
    assert all(took[r.source] == int(r.target + 0.5) for r in mixed)


def test_sql(spark, tmp_path):
    spark.createDataFrame(corpus(), DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = R["op13_curriculum_mix"].run(spark, str(tmp_path))
    rows = got.collect()
    assert [r.position for r in rows if r.position is not None] == sorted(r.position for r in rows if r.position is not None)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(R["op13_curriculum_mix"].sql)
    assert [d[0] for d in cur.description] == got.columns
    assert sorted(map(tuple, rows), key=str) == sorted(cur.fetchall(), key=str)
    again = R["op13_curriculum_mix"].run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, rows), key=str)


def test_demand_follows_the_schedules(spark):
    rows = [(k, "w " * 10, f"s{k % 3}") for k in range(3000)]
    order = training_order(mix(spark.createDataFrame(rows, DOCS), weights=(1, 1, 1))).collect()
    assert [r.position for r in order] == sorted(r.position for r in order) and 0 <= order[0].position and order[-1].position < 1
    for k, schedule in enumerate(SCHEDULES):
        mine = [r for r in order if r.source == f"s{k}"]
        total, pieces = sum(r.words for r in mine), integrated(schedule)
        for t in (0.1, 0.25, 0.5, 0.6, 0.9):
            area, start, rate, slope = [p for p in pieces if p[1] <= t][-1]
            due = area + (t - start) * rate + slope * (t - start) ** 2 / 2
            assert abs(sum(r.words for r in mine if r.position < t) / total - due) < 0.002


def test_running_sums_over_ranges(spark):
    rows = [(random.Random(k).randrange(40), k, k * k) for k in range(3000)]
    got = running_sums(spark.createDataFrame(rows, "a int, k int, v bigint").repartition(7), ["a", "k"], {"before": "v", "n": "k"}).collect()
    before = n = 0
    for r in sorted(got, key=lambda r: (r.a, r.k)):
        assert (r.before, r.n) == (before, n)
        before, n = before + r.v, n + r.k


def test_targets_of_many_sources(spark):
    sizes = {f"s{k:04d}": random.Random(k).choice([0, 1, 5, 50, 1000, 100_000]) for k in range(700)}
    df = spark.createDataFrame([(f"0{s}", n, 1) for s, n in sizes.items()], "source_key string, source_size bigint, documents bigint")
    got = {r.source_key[1:]: r.target for r in source_targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-9 * max(1, want[s]) for s in want)


def test_defined_cases(spark):
    assert mix(spark.createDataFrame([], DOCS)).count() == 0
    df = spark.createDataFrame([(1, "a b", "s", "x", 5)], DOCS + ", target string, size int")
    assert mix(df).columns == ["doc_id", "source", "size", "source_size", "target", "taken", "passes"]
    with pytest.raises(ValueError):
        integrated(((0, 1), (0.5, 1)))
    with pytest.raises(ValueError):
        integrated(((0, 0), (1, 0)))
