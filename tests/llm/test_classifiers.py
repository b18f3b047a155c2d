"""Held-out accuracy of the two classifiers, and their treatment of odd rows."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest

from labelwright.llm import quality, toxicity

SF = os.environ.get("LABELWRIGHT_TEST_SF_LABELS", "/root/testdata/sf0.01")
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
INSULTS = ["blorgface", "snarkwit", "mugdrip"]


def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()).item()


def invented(n=500):
    random.seed(8)
    syllables = ["ra", "to", "mi", "len", "sor", "ka", "ve", "pi", "nd", "é"]
    say = lambda k: ["".join(random.choices(syllables, k=random.randint(1, 4))) for _ in range(k)]
    docs, labels = [], []
    for i in range(n):
        words = say(random.randint(5, 80))
        if i % 4 == 0:
            for _ in range(2):
                words.insert(random.randrange(len(words)), random.choice(INSULTS))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    return docs, labels


def test_toxicity_on_invented_insults(spark, docs):
    rows, labels = invented()
    table = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None), (9999, 1, 1), labels[0]], "doc_id bigint, quality int, toxic int")
    odd = [(None, None), (None, ""), (7000, "?! 123 --"), (7004, "x" * 30_000), rows[0]]
    out = toxicity.toxicity(docs(rows + odd, ["score", "features", "lang"]), table)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    held = [r for r in got if r.held_out and r.doc_id < 500]
    assert len(held) > 70 and all(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    assert by[7000].predicted == by[7004].predicted == 0
    assert toxicity.toxicity(docs(rows[:3]), table.limit(0)).select("score").distinct().collect()[0][0] == 0
    assert toxicity.toxicity(docs([]), table).count() == 0


def test_gapped_and_inserted_letters(spark, docs):
    rows, labels = invented()
    model = toxicity.train(docs(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    score = toxicity.Scorer(model["weights"], model["bias"])
    margins = lambda words: score.units([toxicity.codes(w) for w in words])
    plain = margins(sorted({w for _, t in rows for w in t.split() if w not in INSULTS}))
    hidden = ["blorg-face", "b.l.o.r.g.f.a.c.e", "blorgfface", "snarkkwit", "s-narkwit", "mug*drip", "m.u.g.d.r.i.p", "BLORGFACE!!"]
    assert toxicity.tokens_of("ka m u g d r i p ve") >= {"mugdrip"}
    assert margins(hidden).min() > plain.max(), (dict(zip(hidden, margins(hidden), strict=True)), plain.max())


def test_kernel_against_enumeration():
    from itertools import combinations

    def brute(x, y):
        each = lambda s: [(tuple(s[i] for i in c), toxicity.DECAY ** (c[-1] - c[0] + 1)) for c in combinations(range(len(s)), 4) if all(s[i] for i in c)]
        return sum(a * b for u, a in each(x) for v, b in each(y) if u == v)

    units = [toxicity.codes(t) for t in ("idiot", "id.i.ot", "banana", "a", "thlyeror", "ßü-é9x")]
    for u in units:
        if len(u) >= 4:
            assert np.isclose(toxicity.self_kernel(np.frombuffer(u, np.uint8).astype(np.int32)[None])[0], brute(u, u))
    rows, column = toxicity.span(units[:3])
    got = toxicity.evaluate(units, rows, column)
    for i, u in enumerate(units):
        for j, z in enumerate(units[:3]):
            want = brute(u, z) / np.sqrt(max(brute(u, u), 1e-12) * brute(z, z)) if len(u) >= 4 else 0
            assert np.isclose(got[i, j], want, atol=1e-6)


@needs_data
def test_quality_on_held_out_labels(spark):
    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality(documents, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert auc(got["quality"].to_numpy(), got["score"].to_numpy()) > 0.95
    assert (got["predicted"] == got["quality"]).mean() > 0.9


def test_quality_of_odd_rows(spark, docs):
    random.seed(1)
    good = [(i, " ".join(random.choices(["some", "plain", "words", "of", "text."], k=40))) for i in range(200)]
    poor = [(200 + i, "BUY!! " * random.randint(5, 50)) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(400)] + [(None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    odd = [(None, None), (None, ""), (900, "\n \n"), (901, "é" * 50_000), good[0]]
    got = quality.quality(docs(good + poor + odd, ["stats", "score"]), labels).collect()
    assert len(got) == 405 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert np.mean([r.predicted == int(r.doc_id < 200) for r in held]) > 0.95
    assert {r.score for r in quality.quality(docs(good[:3]), labels.limit(0)).collect()} == {0.5}
    assert quality.quality(docs([]), labels).count() == 0


def test_pooling():
    assert quality.pool(np.array([1.0, 3.0, 2.0, 2.0, 5.0]), np.array([1.0, 1.0, 1.0, 2.0, 1.0])).tolist() == [1.0, 2.25, 2.25, 2.25, 5.0]


def test_insults_across_blanks(spark, docs):
    """Insults split by blanks, and insults of two plain words, are found in texts of the held-out fold."""
    random.seed(12)
    syllables = ["ra", "to", "mi", "len", "sor", "ka", "ve", "pi", "nd", "é"]
    say = lambda k: ["".join(random.choices(syllables, k=random.randint(2, 4))) for _ in range(k)]
    rows, labels = [], []
    for i in range(900):
        words = say(random.randint(10, 60))
        kind = i % 6
        if kind == 0:
            words[2:2] = [random.choice(INSULTS)]
        elif kind == 1:  # two plain words side by side
            words[3:3] = ["gubbet", "savitro"]
        elif kind < 4:  # the same two, apart
            words[1:1], words[6:6] = ["savitro"], ["gubbet"]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(kind < 2)))
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    split = ["blorg face", "snark wit", "mug drip", "bl orgface", "blorgf ace", "snar kwit"]
    odd = [(5000 + i, " ".join([*say(8), s, *say(8)])) for i, s in enumerate(split)]
    clean = [(6000 + i, " ".join(say(25))) for i in range(60)]
    model = toxicity.train(docs(rows), table)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs(rows + odd + clean), model).collect()}
    missed = [s for i, s in enumerate(split) if not got[5000 + i].predicted]
    assert not missed
    assert sum(got[6000 + i].predicted for i in range(60)) <= 1
    import zlib

    held = [(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    wrong = [(i % 6, y) for i, y in held if got[i].predicted != y]
    assert len(wrong) <= 0.03 * len(held), wrong
    assert toxicity.Scorer(model["weights"], model["bias"], pieces=model["pieces"]).across("ka blorg face vo")


def test_score_of_the_machine_against_landmark_kernels():
    """The collapsed weights give the sum over landmarks of kernel times weight."""
    toxic, clean = ([toxicity.codes(w) for w in ws] for ws in (INSULTS, ["ratomi", "lensor", "kavepi", "banana"]))
    rows, column = toxicity.span([*toxic, *clean])
    values, vectors = np.linalg.eigh(rows.T.astype(np.float64) @ rows)
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    w = np.linspace(-1, 1, len(root) + 1)
    weights = (rows @ (root @ w[:-1]))[column].astype(np.float32)
    units = [toxicity.codes(t) for t in ("blorg-face", "snarkwitt", "kavepii", "mugdrip")]
    kernels = toxicity.evaluate(units, rows, column)
    for bias in (w[-1], -1.5):  # margins below the floor are the floor
        want = np.maximum(kernels @ root @ w[:-1] + bias, toxicity.FLOOR)
        assert np.allclose(toxicity.Scorer(weights, bias).units(units), want, atol=1e-4)


def test_repeated_ids_count_once(spark, docs):
    from labelwright.llm.labelled import training_texts

    rows = [(i, f"text {i}") for i in range(200)] + [(7, "a text"), (7, None)] * 50
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, toxic int")
    got = training_texts(docs(rows), labels, "toxic", {0: 1000, 1: 1000}).collect()
    assert 120 < len(got) < 200 and sum(r.text == "a text" for r in got) <= 1 and len({r.text for r in got}) == len(got)


def test_quality_sums_and_scores_against_plain_algebra(spark, docs):
    from pyspark.sql import functions as F

    random.seed(4)
    good = [(i, " ".join(random.choices(["some", "plain", "words", "of", "text."], k=random.randint(5, 60)))) for i in range(150)]
    poor = [(200 + i, random.choice(["BUY!! ", "a a ", "x1x2 "]) * random.randint(1, 50)) for i in range(170)]
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i, _ in good + poor], "doc_id bigint, quality int, toxic int")
    machine = quality.train(docs(good + poor), labels)
    texts = quality.training_texts(docs(good + poor), labels, "quality", quality.DOCUMENTS)
    rows = texts.withColumn("later", F.pmod(F.xxhash64("text"), F.lit(5)) == 0).collect()
    x, y = np.array([quality.statistics(r.text) for r in rows if not r.later]), np.array([r.y for r in rows if not r.later])
    assert np.allclose(machine.mean, x.mean(axis=0)) and np.allclose(machine.spread, np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0))
    w = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    z = machine.features(x)
    want = np.linalg.solve((z * w[:, None]).T @ z + quality.RIDGE * np.eye(z.shape[1]), (z * w[:, None]).T @ y)
    assert np.allclose(z @ machine.weights, z @ want, atol=1e-6)
    got = {r.doc_id: r.score for r in quality.score_quality(docs(good + poor), machine).collect()}
    for i, t in good + poor:
        raw = machine.features(np.array([quality.statistics(t)])) @ want
        assert abs(got[i] - np.clip(np.interp(raw, *machine.curve), 0, 1)[0]) < 1e-6
    # the cosines approximate a Gaussian kernel of the standardised statistics
    waves = z[:, : quality.FEATURES]
    s = np.clip((x - machine.mean) / machine.spread, -6, 6)
    used = max(1, int((x.std(axis=0) > 1e-9).sum()))
    kernel = np.exp(-((s[:, None] - s[None]) ** 2).sum(axis=2) / (2 * 1.5 * used))
    assert np.abs(waves @ waves.T - kernel).mean() < 0.08
