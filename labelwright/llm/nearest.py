"""Exact nearest neighbours by inner product, as a block matrix join of int8 tiles.

Queries that fit a block of bounded size are broadcast and held against all rows.  More queries are
dealt into blocks, and so are the rows; a shuffle brings every block of queries and every block of rows together in a
unit of its own, which holds the queries and reads the rows in batches.  So all rows are read once, however
many queries there are, and none pass through the driver.
Within a task, a tile is the product of the int8 forms of a query block and a
batch of candidates.  From what quantisation left over on either side comes a bound on the error
of each product; a pair survives if its upper bound reaches the lower bound of the query's
k-th best so far.  Survivors are recomputed on the original vectors, in double precision and
from the first component to the last, and kept in heaps.  Each task sends the k best of
each query; heaps merge them query by query.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no
part, nor do rows without an id; vectors meet only those of the same dimension; ties go to the smaller id;
a repeated id is a candidate each time it occurs, except for queries of that id; a repeated query row is
answered each time, and rows of one id with different vectors are queries of their own; an empty table gives an empty answer; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import merge
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Bytes of query vectors in one block, bytes of candidates in one, and products in one tile.
BLOCK_BYTES, CANDIDATE_BYTES, TILE = 32 << 20, 256 << 20, 4 << 20
LISTS = "q bigint, ids array<bigint>, scores array<double>"


def usable(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): rows whose vector can take part, as doubles."""
    v = F.col(embedding).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    return rows.filter(finite & F.exists("v", lambda x: x != 0))


class Side:
    """Vectors with their int8 form and what that leaves over."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, keys: np.ndarray | None = None):
        self.ids, self.vectors, self.keys = ids, vectors, ids if keys is None else keys
        self.scale = np.abs(vectors).max(axis=1) / 127.0
        self.scale[self.scale == 0] = np.finfo(float).tiny
        self.int8 = np.rint(vectors / self.scale[:, None]).clip(-127, 127).astype(np.int8)
        rounded = self.int8 * self.scale[:, None]
        self.left = np.linalg.norm(vectors - rounded, axis=1)
        self.norm = np.linalg.norm(vectors, axis=1)
        self.rounded_norm = np.linalg.norm(rounded, axis=1)

    def cut(self, rows: slice) -> Side:
        part = object.__new__(Side)
        part.__dict__ = {k: v[rows] for k, v in self.__dict__.items()}
        return part


def tile(q: Side, c: Side) -> tuple[np.ndarray, np.ndarray]:
    """Approximate inner products of all pairs, and bounds on their error.

    |<q,c> - <q',c'>| <= |q - q'| |c| + |q'| |c - c'|, with a margin for rounding in floats.
    """
    kind = np.float32 if q.int8.shape[1] * 127 * 127 < 1 << 24 else np.float64  # exact sums of int8 products
    products = (q.int8.astype(kind) @ c.int8.astype(kind).T).astype(np.float64)
    products *= q.scale[:, None]
    products *= c.scale
    error = np.outer(q.left, c.norm) + np.outer(q.rounded_norm, c.left)
    error += 1e-12 * np.outer(q.norm + q.rounded_norm, c.norm + c.rounded_norm)
    return products, error


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, added from the first component on."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


class Best:
    """The k best candidates of each query so far; unused places hold minus infinity."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def offer(self, row: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[row], scores]), np.concatenate([self.ids[row], ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[row], self.ids[row] = scores[order], ids[order]


def _meet(q: Side, c: Side, best: Best) -> None:
    step = max(1, TILE // len(c.ids))
    for at in range(0, len(q.ids), step):
        rows = slice(at, at + step)
        part = q.cut(rows)
        products, error = tile(part, c)
        lower, upper = products - error, products + error
        own = part.ids[:, None] == c.ids[None, :]
        lower[own] = upper[own] = -np.inf
        floor = best.scores[rows, -1]
        if len(c.ids) >= best.k:
            floor = np.maximum(floor, np.partition(lower, -best.k, axis=1)[:, -best.k])
        qs, cs = np.nonzero((upper >= floor[:, None]) & ~own)
        for lo in range(0, len(qs), 1 << 17):
            a, b = qs[lo : lo + (1 << 17)], cs[lo : lo + (1 << 17)]
            scores = exact(part.vectors[a], c.vectors[b])
            starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else []
            for s, e in zip(starts, [*starts[1:], len(a)], strict=True):
                best.offer(at + int(a[s]), scores[s:e], c.ids[b[s:e]])


def _sides(ids: pa.Array, vectors: pa.Array, keys: pa.Array | None = None) -> dict[int, Side]:
    """By dimension; ``keys`` tell queries apart."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    ids = np.asarray(ids)
    keys = ids if keys is None else np.asarray(keys)
    sizes = np.diff(np.asarray(vectors.offsets))
    flat, starts = np.asarray(vectors.values), np.asarray(vectors.offsets)[:-1]
    out = {}
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        out[int(d)] = Side(ids[rows], flat[starts[rows][:, None] + np.arange(d)], keys[rows])
    return out


class Search:
    """Queries and the best candidates that they have met."""

    def __init__(self, queries: dict[int, Side], k: int):
        self.queries, self.best = queries, {d: Best(len(q.ids), k) for d, q in queries.items()}

    def meet(self, ids: pa.Array, vectors: pa.Array) -> None:
        for at in range(0, len(ids), 4096):
            for d, side in _sides(ids.slice(at, 4096), vectors.slice(at, 4096)).items():
                if d in self.queries:
                    _meet(self.queries[d], side, self.best[d])

    def lists(self) -> Iterator[pa.RecordBatch]:
        for d, q in self.queries.items():
            ids, scores = self.best[d].ids, self.best[d].scores
            used = scores > -np.inf
            for at in range(0, len(q.ids), 4096):
                rows = [i for i in range(at, min(at + 4096, len(q.ids))) if used[i].any()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q.keys[rows], pa.int64()), pa.array([ids[i][used[i]].tolist() for i in rows], pa.list_(pa.int64())), pa.array([scores[i][used[i]].tolist() for i in rows], pa.list_(pa.float64()))],
                    names=["q", "ids", "scores"],
                )


def _candidates(batches: Iterator[pa.RecordBatch], blocks, k: int) -> Iterator[pa.RecordBatch]:
    """Lists of the broadcast queries over the rows (vec_id, v) of a task."""
    search = Search({d: Side(*parts) for d, parts in blocks.value.items()}, k)
    for batch in batches:
        search.meet(batch.column(0), batch.column(1))
    yield from search.lists()


def _units(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Lists of the units in a sorted partition of (unit, side, q, vec_id, v): a unit's queries, side 0, come before its rows."""
    unit, held, search = None, [], None
    for batch in batches:
        units, sides = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        edges = np.flatnonzero(np.r_[True, (np.diff(units) != 0) | (np.diff(sides) != 0)])
        for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(units)], strict=True):
            part = batch.slice(lo, hi - lo)
            if units[lo] != unit:
                if search:
                    yield from search.lists()
                unit, held, search = units[lo], [], None
            if sides[lo] == 0:
                held.append(part)
            elif held:
                if search is None:
                    q = pa.Table.from_batches(held).combine_chunks()
                    search = Search(_sides(q["vec_id"].combine_chunks(), q["v"], q["q"].combine_chunks()), k)
                search.meet(part.column(3), part.column(4))
    if search:
        yield from search.lists()


def _grid(rows: DataFrame, queries: DataFrame, blocks: int, strips: int, k: int) -> DataFrame:
    """Lists of all queries over all rows, in ``blocks`` times ``strips`` units."""
    block, strip = F.pmod(F.col("q"), F.lit(blocks)), F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(strips))
    each = lambda n, step: F.explode(F.sequence(*[F.lit(x).cast("bigint") for x in (0, (n - 1) * step, step)]))
    asked = queries.select((block * strips).alias("from"), each(strips, 1).alias("to"), F.lit(0).alias("side"), "q", "vec_id", "v")
    met = rows.select(strip.alias("from"), each(blocks, strips).alias("to"), F.lit(1).alias("side"), F.lit(0).cast("bigint").alias("q"), "vec_id", "v")
    both = asked.union(met).select((F.col("from") + F.col("to")).alias("unit"), "side", "q", "vec_id", "v")
    ready = both.repartition("unit").sortWithinPartitions("unit", "side")
    return ready.mapInArrow(lambda b: _units(b, k), LISTS)


def _merge(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Merge the sorted lists of each query; a query's rows follow each other."""

    def rows():
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    out: list[tuple] = []
    for query, lists in groupby(rows(), key=lambda r: r[0]):
        top: list[tuple[float, int]] = []
        for _, ids, scores in lists:
            top = list(islice(merge(top, zip([-s for s in scores], ids, strict=True)), k))
        out.extend((query, n, i, -s) for n, (s, i) in enumerate(top, 1))
        if len(out) > 20_000:
            yield _ranked(out)
    yield _ranked(out)


def _ranked(out: list[tuple]) -> pa.RecordBatch:
    columns = [*zip(*out, strict=True)] or [[], [], [], []]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["q", "rank", "vec_id", "score"])
    out.clear()
    return batch


def search(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of every row for which ``is_query`` holds."""
    rows = usable(vectors, vec_id, embedding)
    asked = rows.filter(is_query).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies"))
    asked = cut(asked.withColumn("q", F.monotonically_increasing_id()))
    bytes_ = F.coalesce(F.sum(F.size("v") * 8 + 16), F.lit(0))
    blocks = max(1, -(-asked.agg(bytes_).first()[0] // BLOCK_BYTES))
    if blocks == 1:
        mine = asked.select("vec_id", "v", "q").toArrow()  # one block at most
        sides = _sides(mine["vec_id"].combine_chunks(), mine["v"], mine["q"].combine_chunks()) if mine.num_rows else {}
        sent = vectors.sparkSession.sparkContext.broadcast({d: (s.ids, s.vectors, s.keys) for d, s in sides.items()})
        lists = rows.mapInArrow(lambda x: _candidates(x, sent, k), LISTS)
    else:
        strips = max(1, -(-rows.agg(bytes_).first()[0] // CANDIDATE_BYTES))
        lists = _grid(rows, asked, blocks, strips, k)
    near = lists.repartition("q").sortWithinPartitions("q").mapInArrow(lambda x: _merge(x, k), "q bigint, rank int, vec_id bigint, score double")
    named = near.join(asked.select("q", F.col("vec_id").alias("query_id"), "copies"), "q")
    return named.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("col")
