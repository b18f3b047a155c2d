"""A training mix of all documents: target words for each source, and a curriculum that changes over time.

Targets.  The sources, in code point order with the null source last, weigh ``weights`` in turn and share ``share``
times all words.  A source gives at most ``most`` times its own words; what it can't give is shared by the others,
by weight.  That water level has a closed form: with sources in order of what they can give per weight, the level is
the largest of (words left) / (weight left) over all places in this order.

Curriculum.  Each source has a schedule of rates, piecewise linear over the time from 0 to 1.  Its integral, scaled to
the source's target, is the source's cumulative demand.  The source's documents stand in a fixed random order, pass after
pass; the words before a document are the demand at which it is due, and the inverse of the integral is
the time of training at which this demand is reached: its position.  Sorted by ranges of positions, the documents of all
sources interleave as the schedules say.  The last document that a source gives is taken in part, so its words equal its target, rounded.

Only DataFrame operations are used.  Words before a document are sums over ranges of the whole order (``running_sums``), so that no
source is handled in one place, whatever its share of the rows.

Defined cases: a null text has no words; a document without words is taken with no words and has no position; rows of a null
source form one source; repeated rows are documents of their own; rows without an id take part; rows that agree in
id, source and size are interchangeable; an empty table gives an empty mix; texts are counted whole; other columns are not carried.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, spread_join

#: Rates (at, rate) in turn: early, steady and late sources.
SCHEDULES = (((0.0, 2.0), (0.5, 1.0), (1.0, 0.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.0), (0.25, 1.0), (1.0, 1.5)))


def running_sums(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """``df`` with the sum of each column over all rows that come before in the order; ``sums`` maps new names to columns.

    Rows are dealt by ranges of the order.  Each range's totals, one row a range, give the sums
    before it; within a range a window adds the rest.
    """
    placed = cut(df.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()))
    totals = placed.groupBy("range_").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("range_", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_start") for n in sums])
    within = Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = placed.join(F.broadcast(starts), "range_")
    return found.select(*df.columns, *[(F.col(f"{n}_start") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(n) for n, c in sums.items()])


def in_turn(values: list, place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (place % len(values) + 1).cast("int"))


def source_targets(sources: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Sources (source_key, source_size, documents) with ``place`` in order of their keys, ``words_before`` and ``target``."""
    placed = running_sums(sources.withColumn("one", F.lit(1).cast("bigint")), ["source_key"], {"place": "one", "words_before": "source_size"})
    placed = cut(placed.drop("one").withColumn("weight", in_turn([float(w) for w in weights], F.col("place"))).withColumn("gives", F.col("source_size") * F.lit(float(most))))
    words, weight = placed.agg(F.sum("source_size"), F.sum("weight")).first()
    ordered = running_sums(placed.withColumn("each", F.col("gives") / F.col("weight")), ["each", "source_key"], {"given": "gives", "weighed": "weight"})
    levels = cut(ordered.withColumn("level", (F.lit(float(words or 0) * share) - F.col("given")) / (F.lit(float(weight or 0)) - F.col("weighed"))))
    level = levels.agg(F.max("level")).first()[0] or 0.0
    return levels.select("source_key", "source_size", "documents", "place", "words_before", F.least("gives", F.col("weight") * F.lit(level)).alias("target"))


def integrated(knots: tuple) -> list[tuple[float, float, float, float]]:
    """Pieces (area before, start, rate at the start, slope) of a schedule, scaled to a total area of one."""
    if [k[0] for k in knots] != sorted({k[0] for k in knots}) or (knots[0][0], knots[-1][0]) != (0, 1) or min(k[1] for k in knots) < 0:
        raise ValueError("a schedule's knots run from 0 to 1 in order, with rates of 0 or more")
    steps = list(zip(knots, knots[1:], strict=False))
    total = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in steps)
    if total <= 0:
        raise ValueError("a schedule's rates must not all be 0")
    out, area = [], 0.0
    for a, b in steps:
        if a[1] or b[1]:  # nothing is due while the rate is 0
            out.append((area, float(a[0]), a[1] / total, (b[1] - a[1]) / total / (b[0] - a[0])))
            area += (b[0] - a[0]) * (a[1] + b[1]) / total / 2
    return out


def due_time(schedules: tuple, place: Column, demand: Column) -> Column:
    """The time at which a share of a source's target is reached: the inverse of the schedule's integral."""
    names = ("area", "start", "rate", "slope")
    stated = F.array(*[F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, piece, strict=True)]) for piece in integrated(s)]) for s in schedules])
    pieces = F.element_at(stated, (place % len(schedules) + 1).cast("int"))
    piece = F.try_element_at(F.filter(pieces, lambda p: p["area"] <= demand), F.lit(-1))

    def solved(p: Column) -> Column:
        left = demand - p["area"]
        root = F.sqrt(F.greatest(p["rate"] * p["rate"] + 2 * p["slope"] * left, F.lit(0.0)))
        return p["start"] + F.coalesce(F.try_divide(2 * left, p["rate"] + root), F.lit(0.0))

    return F.get(F.transform(F.array(piece), solved), F.lit(0))


def mix(
    docs: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, most: float = 2.0, schedules: tuple = SCHEDULES, seed: str = "mix"
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target (of its source), taken (words) and
    ``passes``, an array of (pass, position, words) for each time the document is taken."""
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    place = F.coalesce(F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary")), F.lit(""))
    rows = cut(docs.select("doc_id", "source", size.alias("size"), key.alias("source_key"), place.alias("draw")))
    sources = cut(rows.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents")))
    targets = cut(source_targets(sources, weights, share, most))
    ready = running_sums(spread_join(rows, targets, "source_key", "documents"), ["source_key", "draw", "doc_id", "size"], {"all_before": "size"})
    due = F.floor(F.col("target") + 0.5)
    ready = ready.withColumns({"due": due, "before": F.col("all_before") - F.col("words_before")})

    def taken(p: int) -> Column:
        start = F.col("source_size") * p + F.col("before")
        words = F.greatest(F.least("size", F.col("due") - start), F.lit(0))
        return F.struct(F.lit(p + 1).alias("pass"), due_time(schedules, F.col("place"), F.try_divide(start, F.col("due"))).alias("position"), words.alias("words"))

    passes = F.filter(F.array(*[taken(p) for p in range(ceil(most))]), lambda p: p["words"] > 0)
    ready = ready.withColumn("passes", passes)
    words = F.aggregate("passes", F.lit(0).cast("bigint"), lambda total, p: total + p["words"])
    return ready.select("doc_id", "source", "size", "source_size", "target", words.alias("taken"), "passes")


def training_order(mixed: DataFrame) -> DataFrame:
    """Each document as often as it is taken, range-sorted by position: the order of training."""
    each = mixed.select("doc_id", "source", F.inline("passes"))
    return each.orderBy("position", "source", "doc_id", "pass")
