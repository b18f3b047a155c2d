"""Folds and bounded samples of labelled documents, shared by the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold that training never sees: crc32 of the id as text, modulo 5, is 0; false without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int]) -> DataFrame:
    """(text, y): documents of the training fold with their label, at most about ``most[y]`` of each class.

    Labels that are null are ignored and repeated ones averaged.  The sample is taken by a
    hash of the id; its labels number at most ``most`` and are broadcast.  An id whose document repeats
    counts once, with its smallest text, so the bound holds for rows as well.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()).groupBy("doc_id")
    known = known.agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    sizes = dict(known.groupBy("y").count().collect())
    share = lambda y: min(1.0, most[y] / sizes.get(y, 1))
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000))
    sample = known.filter(place < F.when(F.col("y") == 1, share(1) * 1_000_000).otherwise(share(0) * 1_000_000))
    found = docs.select("doc_id", "text").join(F.broadcast(cut(sample)), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y")
