"""Quality scores from random Fourier features, ridge regression and isotonic calibration.

Statistics of a whole text (its make-up of characters, words, lines and repetitions) are
standardised and mapped to cosines of random directions, which approximate a Gaussian
kernel.  Each partition of the training sample sums its part of the normal equations; the sums give the
ridge weights.  A part of the training fold that the weights did not see is scored, summed into bins, and
pooled into a rising step curve that turns the raw value into a probability.

Defined cases: null and empty texts have zero statistics and are scored like any other;
repeated rows score alike, and a labelled id that repeats is one training row; texts of any length are read whole;
without labels of both classes every score is 0.5; an empty table gives an empty one; other columns are passed
through.  Beside the cosines the machine holds the standardised statistics themselves, so the fit is a kernel's plus a plane.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, cut
from .labelled import held_out, training_texts

FEATURES, SEED, RIDGE, BINS = 320, 20, 0.3, 400
#: Partitions of the training sample, each with its part of the normal equations.
PARTS = 16
#: Training documents of each class, at most.
DOCUMENTS = {1: 16_000, 0: 8_000}
MARKS = b"!|#$%&*.,;:?-'\""
NAMES = 40


def statistics(text: str | None) -> np.ndarray:
    """Statistics of a whole text that do not depend on its language."""
    out = np.zeros(NAMES)
    if not text:
        return out
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    count = np.bincount(data, minlength=256)
    n = len(data)
    words, lines = text.split(), text.split("\n")
    k, m = max(1, len(words)), len(lines)
    letters = count[65:91].sum() + count[97:123].sum() + count[128:].sum()
    marks = n - letters - count[48:58].sum() - count[9:14].sum() - count[32]
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    filled = [x for x in lines if x.strip()]
    shape = [
        np.log1p(n), np.log1p(len(words)), np.log1p(m), count[65:91].sum() / max(1, letters), count[48:58].sum() / n,
        marks / n, count[128:].sum() / n, (count[9:14].sum() + count[32]) / n, m / k, lengths.mean(), lengths.std(), np.log1p(lengths.max()),
        (lengths <= 3).mean(), (lengths >= 16).mean(), len(set(words)) / k, len({*zip(words, words[1:], strict=False)}) / max(1, k - 1),
        len({*zip(words, words[1:], words[2:], strict=False)}) / max(1, k - 2), len(set(filled)) / max(1, len(filled)),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / k, np.log1p(k / max(1, m)), sum(map(str.isdigit, words)) / k,
        (count > 0).sum() / 256, -(p := count[count > 0] / n) @ np.log(p), count[32:48].max() / n, float(text[-1:] in ".!?\n"),
    ]
    out[: len(shape)] = shape
    out[len(shape) : len(shape) + len(MARKS)] = np.minimum(count[list(MARKS)] / k, 3.0)
    return out


class Machine:
    """Standardisation, random directions, ridge weights and the calibration curve."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        random = np.random.default_rng(SEED)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        used = max(1, int((spread > 1e-9).sum()))
        self.directions = random.normal(0, 1 / np.sqrt(1.5 * used), (len(mean), FEATURES))
        self.phases = random.uniform(0, 2 * np.pi, FEATURES)
        self.weights: np.ndarray | None = None
        self.curve: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / FEATURES)
        return np.hstack([waves, z / np.sqrt(FEATURES), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.curve), 0.0, 1.0)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Append ``stats``, an array of doubles."""

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            rows = np.array([statistics(t) for t in texts.to_pylist()]).reshape(-1, NAMES)
            return [pa.ListArray.from_arrays(np.arange(0, rows.size + 1, NAMES, dtype=np.int32), pa.array(rows.ravel()))]

        return work

    return add_columns(df, [text], "stats array<double>", make)


def _sums(batches: Iterator[pa.RecordBatch], machine: Machine) -> Iterator[pa.RecordBatch]:
    """The partition's part of the normal equations, as one row."""
    size = NAMES + FEATURES + 1
    left, right = np.zeros((size, size)), np.zeros(size)
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            z, w = machine.features(_matrix(part.column(0))), np.asarray(part.column(2))[:, None]
            left += (z * w).T @ z
            right += (z * w).T @ np.asarray(part.column(1))
    yield pa.RecordBatch.from_arrays([pa.array([left.tobytes()]), pa.array([right.tobytes()])], names=["left", "right"])


def pool(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Closest rising sequence in weighted squares: neighbours that fall are pooled."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Machine | None:
    texts = training_texts(docs, labels, label, DOCUMENTS)
    # a fifth of the sample, by a hash of the text, is kept for the calibration
    rows = with_statistics(texts.withColumn("later", F.pmod(F.xxhash64("text"), F.lit(5)) == 0)).select("stats", "y", "later")
    rows = cut(rows.repartition(PARTS, F.xxhash64("stats")))
    n = {r["y"]: r["count"] for r in rows.filter("not later").groupBy("y").count().collect()}
    if not (n.get(0) and n.get(1)):
        return None
    at = [F.element_at("stats", i + 1) for i in range(NAMES)]
    m = rows.filter("not later").agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(at)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(at)]).first()
    machine = Machine(np.array(m[:NAMES]), np.array(m[NAMES:]))
    total = n[0] + n[1]
    weighted = rows.filter("not later").select("stats", F.col("y").cast("double").alias("y"), F.when(F.col("y") == 1, total / (2 * n[1])).otherwise(total / (2 * n[0])).alias("w"))
    size = NAMES + FEATURES + 1
    left, right = RIDGE * np.eye(size), np.zeros(size)
    sums = weighted.coalesce(PARTS).mapInArrow(lambda b: _sums(b, machine), "left binary, right binary")
    for row in sums.toLocalIterator():  # at most PARTS rows of about a megabyte, one by one
        left += np.frombuffer(row["left"]).reshape(size, size)
        right += np.frombuffer(row["right"])
    machine.weights = np.linalg.solve(left, right)
    held = rows.filter("later")
    held = held if held.limit(1).count() else rows

    def raw():
        return lambda stats: [pa.array(machine.raw(_matrix(stats)))]

    scored = add_columns(held.select("stats", "y"), ["stats"], "raw double", raw)
    place = F.floor(F.greatest(F.least(F.col("raw"), F.lit(1.5)), F.lit(-0.5)) * (BINS / 2))
    bins = scored.groupBy(place.alias("bin")).agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").toPandas()
    machine.curve = (bins["raw"].to_numpy(), pool(bins["y"].to_numpy(), bins["n"].to_numpy()))
    return machine


def score_quality(df: DataFrame, machine: Machine | None, text: str = "text") -> DataFrame:
    """Append ``score`` (0 to 1, higher is better) and ``predicted`` (1 from 0.3 on) to every row."""
    if machine is None:
        return df.withColumns({"score": F.lit(0.5), "predicted": F.lit(1)})

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            rows = [statistics(t) for t in texts.to_pylist()]
            return [pa.array(machine.score(np.array(rows).reshape(-1, NAMES)), pa.float64())]

        return work

    return add_columns(df, [text], "score double", make).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    machine = train(docs, labels)
    return score_quality(docs.select("doc_id", "text"), machine).select("doc_id", held_out().alias("held_out"), "score", "predicted")
