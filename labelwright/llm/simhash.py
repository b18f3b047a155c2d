"""SimHash near-duplicates, linked with BK-trees.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's word shingles.
Copies share one fingerprint, so trees hold distinct fingerprints only.  The 64 bits are
cut into blocks; fingerprints at most ``radius`` bits apart agree on some
choice of blocks, so every choice of blocks and its value make a shard.  A
shard's fingerprints form a BK-tree, children keyed by their distance to the
parent, and a probe follows only edges within the radius.  A shard of more than
``SHARD`` fingerprints is dealt into parts, and each pair of parts is a task
unit of its own: one part's tree, probed by the other.  The trees of all shards grow
with the data and are therefore not broadcast: each is built where the shuffle
brings its probes.  A unit returns a spanning forest of its links, never all pairs.

Defined cases: a null text, or one without words, has fingerprint zero and is
linked like any other; repeated rows get the same result; rows without an id take
part, and a component in which no row has an id has a null component id; a bit that exactly half of the
hashes set is 0; texts of any length are read whole; an empty table gives an empty one; other
columns of the input are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_columns, cut, spread_join
from .components import components

SEED = 42
#: Fingerprints in one tree, at most.
SHARD = 2048
#: Blocks are added until a shard holds this many fingerprints on average, were they spread evenly.
EVEN = 64


def fingerprint(text: str | None, shingle: int) -> int:
    """Majority fingerprint of a text, as a signed 64-bit number."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(shingle)), strict=False)]
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        bits = np.unpackbits(np.frombuffer(b"".join(hashes[at : at + 8192]), np.uint8)).reshape(-1, 64)
        votes += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big", signed=True)


def with_fingerprint(df: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """Append ``fp``, the fingerprint as a bigint."""

    def make():
        return lambda texts: [pa.array([fingerprint(t, shingle) for t in texts.to_pylist()], pa.int64())]

    return add_columns(df, [text], "fp bigint", make)


class BKTree:
    """Distinct fingerprints; the children of a node are keyed by their distance to it."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at = 0
        if self.values:
            while d := (value ^ self.values[at]).bit_count():
                child = self.children[at].get(d)
                if child is None:
                    self.children[at][d] = len(self.values)
                    break
                at = child
            else:
                return
        self.values.append(value)
        self.children.append({})

    def near(self, value: int, radius: int) -> Iterator[int]:
        """Positions within the radius, following only edges that can lead there."""
        values, children = self.values, self.children
        todo = [0] if values else []
        while todo:
            at = todo.pop()
            d = (value ^ values[at]).bit_count()
            if d <= radius:
                yield at
            if branches := children[at]:
                low, high = d - radius, d + radius
                todo.extend([c for e, c in branches.items() if low <= e <= high])


def forest(tree_side: list[int], probes: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two parts of a shard, or inside one (``probes`` is None)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    tree = BKTree()
    if probes is not None:
        for x in tree_side:
            tree.add(x)
    for x in tree_side if probes is None else probes:
        for i in tree.near(x, radius):
            a, b = find(x), find(tree.values[i])
            if a != b:
                root[max(a, b)] = min(a, b)
        if probes is None:
            tree.add(x)
    return [(x, find(x)) for x in list(root) if find(x) != x]


def _masks(blocks: int, radius: int) -> list[int]:
    """Bit masks of every choice of ``blocks`` out of ``blocks + radius`` blocks, as signed numbers."""
    edges = np.linspace(0, 64, blocks + radius + 1).round().astype(int).tolist()
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(block, blocks)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of the task units in a sorted partition; a unit's rows follow each other and number at most 2 parts."""
    unit, parts, found = None, ([], []), []

    def close():
        if unit is not None and (parts[1] or len(parts[0]) > 1):
            found.extend(forest(parts[0], parts[1] if unit[2] != unit[3] else None, radius))

    def drain():
        out = pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], names=["u", "v"])
        found.clear()
        return out

    for batch in batches:
        for *key, second, fp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != unit:
                close()
                unit, parts = key, ([], [])
            parts[second].append(fp)
        if len(found) > 10_000:
            yield drain()
    close()
    yield drain()


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(u, v): links that connect all fingerprints of column ``fp`` (distinct) within ``radius`` bits of each other, directly or by others."""
    n = fps.count()
    blocks = 1
    while blocks < 6 and n / 2 ** (blocks * 64 // (blocks + radius)) > EVEN:
        blocks += 1
    masks = _masks(blocks, radius)
    assert len(masks) == comb(blocks + radius, radius)
    shards = fps.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(masks)])).alias("s")
    ).select("s.choice", "s.value", "fp")
    key = ["choice", "value"]
    large = shards.groupBy(*key).count().filter(F.col("count") > SHARD).select(*key, F.ceil(F.col("count") / SHARD * 1.25).cast("int").alias("parts"))
    dealt = shards.join(large, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part: Column = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int")
    units = (
        dealt.withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(*key, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).cast("int").alias("second"), "fp")
    )
    order = [*key, "i", "j"]
    ready = units.repartition(*order).sortWithinPartitions(*order, "second", "fp")
    return ready.mapInArrow(lambda b: _links(b, radius), "u bigint, v bigint").distinct()


def near_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """Per row: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id linked to it."""
    docs = cut(with_fingerprint(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", shingle).drop("text"))
    fps = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows")))
    roots = components(links(fps, radius)).withColumnRenamed("node", "fp")
    placed = cut(roots.join(fps, "fp"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("least_id"))
    linked = placed.join(least, "root").select("fp", "least_id")
    classes = cut(fps.join(linked, "fp", "left").select("fp", "rows", F.coalesce("least_id", "first_id").alias("component_id")))
    # a fingerprint that many rows share is broadcast, so these rows do not meet in one task
    return spread_join(docs, classes, "fp", "rows").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
