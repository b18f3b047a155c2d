"""Whitening of embeddings, fitted on distinct vectors with weights.

Vectors are put on a grid, x = floor(scale * c), as long numbers.  Equal x vectors form one row with its
number of copies; a fit weighs each such row with one, or with its copies.  Counts and sums are exact.
A second pass multiplies the weighted vectors, centred, block by block (GEMM) and sums
the products of all partitions entry by entry.  The driver sees one d x d matrix; its unit eigenvectors,
by falling eigenvalue, whiten each distinct vector once, and the results are joined back to the rows.
Vectors that many rows share are joined by a broadcast, all others by a shuffle, so copies go to no single task.

Defined cases: rows whose vector is null or holds a null or non-finite entry are left out; -0 counts as 0;
repeated rows and rows without an id get a result each; vectors of different length are fitted and whitened
apart; an empty vector has no components; a component without variance has null values and no part
in the identity error, which is null if there is no other; a deviation beyond a long number is null;
an empty table gives an empty one; columns that clash with the new ones are replaced.
An eigenvector's sign makes its largest entry positive.  Equal eigenvalues leave the axes among them open.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_join

#: Vectors of one block of a product.
BLOCK = 4096
NEW = ("n", "deviation", "whitened", "explained", "identity_error")
MOST = 2**63 - 1


def usable(vector: Column) -> Column:
    """No null and no non-finite entry."""
    wrong = F.exists(vector, lambda c: F.coalesce(F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")), F.lit(True)))
    return vector.isNotNull() & ~wrong


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors of equal length (rows x d, long) and their weights, a block at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK):
            part = whole.slice(at, BLOCK)
            x, weight = part.column(0), part.column(1).to_numpy(zero_copy_only=False)
            sizes = np.diff(x.offsets.to_numpy())
            flat, starts = x.values.to_numpy(zero_copy_only=False), x.offsets.to_numpy()[:-1]
            for d in np.unique(sizes[sizes > 0]).tolist():
                own = np.flatnonzero(sizes == d)
                yield flat[starts[own][:, None] + np.arange(d)], weight[own]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, place, n, total): exact weighted sums of a partition; place 0 to d - 1."""
    held: dict[int, list] = {}
    for x, weight in _blocks(batches):
        d = x.shape[1]
        wide = int(np.abs(x.astype(float)).max()) * int(weight.sum()) >= 2**62
        total = (x.astype(object) * weight.astype(object)[:, None] if wide else x * weight[:, None]).sum(axis=0)
        own = held.setdefault(d, [0, [0] * d])
        own[0] += int(weight.sum())
        own[1] = [a + int(b) for a, b in zip(own[1], total, strict=True)]
    for d, (n, total) in held.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([*map(Decimal, total)], pa.decimal128(38, 0))],
            names=["d", "place", "n", "total"],
        )


def centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """n * x - total, exact: long numbers where they suffice, else Python's."""
    most = max(float(np.abs(x.astype(float)).max(initial=0)) * n, max((abs(int(t)) for t in total), default=0))
    if most < 2**61:
        return x * n - total.astype(np.int64)
    return x.astype(object) * n - total


def _products(sums: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for x, weight in _blocks(batches):
            n, total = sums[x.shape[1]]
            z = centred(x, n, total).astype(float) / n
            product = (z * weight[:, None]).T @ z
            held[x.shape[1]] = held.get(x.shape[1], 0.0) + product
        for d, product in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([product.ravel()], pa.list_(pa.float64()))], names=["d", "product"])

    return run


def axes(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to ``k`` unit eigenvectors as columns, their eigenvalues (falling; 0 if there is no variance) and shares of the trace."""
    value, vector = np.linalg.eigh((covariance + covariance.T) / 2)
    value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
    trace = float(np.trace(covariance))
    value = np.where(value > trace * len(covariance) * 1e-15, value, 0.0)
    sign = np.sign(vector[np.abs(vector).argmax(axis=0), np.arange(vector.shape[1])])
    return vector * sign, value, value / trace if trace > 0 else value


def _whitened(fits: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                part = whole.slice(at, BLOCK)
                x, sizes = part.column(0), np.diff(part.column(0).offsets.to_numpy())
                flat, starts = x.values.to_numpy(zero_copy_only=False), x.offsets.to_numpy()[:-1]
                values: list = [None] * len(sizes)
                deviation: list = [0] * len(sizes)
                for d in np.unique(sizes).tolist():
                    own = np.flatnonzero(sizes == d)
                    n, total, vector, value = fits[d][:4]
                    diff = centred(flat[starts[own][:, None] + np.arange(d)], n, total)
                    exact = diff if diff.dtype == object or float(np.abs(diff).max(initial=0)) ** 2 * d < 2**62 else diff.astype(object)
                    squares = (exact * exact).sum(axis=1).tolist()
                    with np.errstate(divide="ignore", invalid="ignore"):
                        white = np.where(value > 0, (diff.astype(float) / n) @ vector / np.sqrt(value), np.nan)
                    for row, w, s in zip(own.tolist(), white.tolist(), squares, strict=True):
                        values[row] = [v if v == v else None for v in w]
                        deviation[row] = int(s) if s <= MOST else None
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(sizes, pa.int32()), pa.array(deviation, pa.int64()), pa.array(values, pa.list_(pa.float64()))],
                    names=["x_", "weight_", "rows_", "d_", "deviation", "whitened"],
                )

    return run


def _identity_errors(white: DataFrame, k: int) -> dict[int, float | None]:
    """Per length of vectors, the largest absolute entry of the whitened vectors' weighted covariance minus the identity."""
    part = [F.get("whitened", F.lit(i)) for i in range(k)]
    mean = white.groupBy("d_").agg(*[(F.sum(F.col("weight_") * p) / F.sum("weight_")).alias(f"m{i}") for i, p in enumerate(part)])
    means = {r["d_"]: r for r in mean.collect()}
    if not means:
        return {}
    at = white.join(F.broadcast(mean), "d_")
    entries = [
        (i, j, (F.sum(F.col("weight_") * (part[i] - F.col(f"m{i}")) * (part[j] - F.col(f"m{j}"))) / F.sum("weight_")).alias(f"c{i}_{j}")) for i in range(k) for j in range(i, k)
    ]
    rows = at.groupBy("d_").agg(*[e[2] for e in entries]).collect()
    return {r["d_"]: max((abs(v - (i == j)) for i, j, _ in entries if (v := r[f"c{i}_{j}"]) is not None), default=None) for r in rows}


def whiten(df: DataFrame, vector: str = "embedding", components: int = 4, weights: str = "one", scale: int = 256) -> DataFrame:
    """Rows with a usable vector, with ``n`` (total weight of the fit), ``deviation`` (sum over dimensions of (n * x - S)^2),
    ``whitened`` and ``explained`` (a value for each component) and ``identity_error``.

    ``weights`` is "one" (each distinct x vector once) or "count" (as often as it occurs).
    """
    if weights not in ("one", "count"):
        raise ValueError("weights must be 'one' or 'count'")
    grid = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * scale))
    rows = df.filter(usable(F.col(vector))).select(F.struct(*[df[c] for c in df.columns if c not in NEW]).alias("row_"), grid.alias("x_"))
    held = rows.groupBy("x_").agg(F.count(F.lit(1)).alias("rows_"))
    held = cut(held.select("x_", (F.col("rows_") if weights == "count" else F.lit(1).cast("bigint")).alias("weight_"), "rows_"))

    # two small tables of the vectors' dimensions come to the driver: sums, then products
    sums: dict[int, list] = {}
    summed = held.select("x_", "weight_").mapInArrow(_sums, "d int, place int, n bigint, total decimal(38,0)")
    for r in summed.groupBy("d", "place").agg(F.sum("n").alias("n"), F.sum("total").cast("string").alias("total")).orderBy("d", "place").collect():
        sums.setdefault(r["d"], [r["n"], []])[1].append(int(r["total"]))
    sums = {d: (n, np.array(total, object)) for d, (n, total) in sums.items()}
    made = held.select("x_", "weight_").mapInArrow(_products(sums), "d int, product array<double>")
    entries = made.select("d", F.posexplode("product")).groupBy("d", "pos").agg(F.sum("col").alias("entry")).toArrow()
    which, place, entry = (entries[c].to_numpy() for c in ("d", "pos", "entry"))
    fits = {0: (0, np.zeros(0, object), np.zeros((0, 0)), np.zeros(0), np.zeros(0))}
    for d, (n, total) in sums.items():
        covariance = np.zeros(d * d)
        covariance[place[which == d]] = entry[which == d] / n
        fits[d] = (n, total, *axes(covariance.reshape(d, d), components))

    white = cut(held.mapInArrow(_whitened(fits), "x_ array<bigint>, weight_ bigint, rows_ bigint, d_ int, deviation bigint, whitened array<double>"))
    errors = _identity_errors(white, components)
    known = [(d, fit[0], [float(v) for v in fit[4]], errors.get(d)) for d, fit in fits.items()]
    stated = df.sparkSession.createDataFrame(known, "d_ int, n bigint, explained array<double>, identity_error double")
    joined = spread_join(rows, white.drop("weight_"), "x_", "rows_").join(F.broadcast(stated), "d_")
    return joined.select("row_.*", "n", "deviation", "whitened", "explained", "identity_error")
