"""Daily partial states of the scans, which merge by addition.

A rollup row holds counts and the score sum of one day, for all scans or for one category or
platform.  Every batch and every micro-batch writes its own rows; readers add them up, so a
row that comes late corrects its day, however late it is, and a batch that is written again replaces
its own part.  Reports read rollups, whose number depends on days and names and not on scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .analytics import month_of, one_decimal

KEY = ("scan_date", "dimension", "value")
SUMS = ("scans", "passed", "failed", "partial", "score_sum")


def rollup_rows(scans: DataFrame) -> DataFrame:
    """``scan_date, dimension, value, scans, passed, failed, partial, score_sum``; the dimension is all, category or platform."""
    each = F.array(
        F.struct(F.lit("all").alias("dimension"), F.lit(None).cast("string").alias("value")),
        *[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("category", "platform")],
    )
    rows = scans.select(F.to_date("created_at").alias("scan_date"), F.inline(each), "status", "score")
    return rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("scans"),
        *[F.count_if(F.col("status") == s).alias(n) for n, s in (("passed", "PASS"), ("failed", "FAIL"), ("partial", "PARTIAL"))],
        F.sum(F.col("score").cast("bigint")).alias("score_sum"),
    )


def merged(*rollups: DataFrame) -> DataFrame:
    """One row for each day, dimension and value."""
    rows = rollups[0].select(*KEY, *SUMS)
    for more in rollups[1:]:
        rows = rows.unionByName(more.select(*KEY, *SUMS))
    return rows.groupBy(*KEY).agg(*[F.sum(s).alias(s) for s in SUMS])


def read_rollups(spark: SparkSession, path: str) -> DataFrame:
    """The merged rollups of all batches below ``path``."""
    return merged(spark.read.parquet(f"{path}/rollups"))


def _of(rollups: DataFrame, dimension: str) -> DataFrame:
    return rollups.filter(F.col("dimension") == dimension)


def _mean_score() -> Column:
    return one_decimal(F.try_divide(F.sum("score_sum"), F.sum("scans")))


def _rate(part: str) -> Column:
    return one_decimal(F.try_divide(F.sum(part), F.sum("scans")) * 100)


def summary(rollups: DataFrame) -> DataFrame:
    total = [F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("scans", "total_scans"), ("passed", "pass_count"), ("failed", "fail_count"), ("partial", "partial_count"))]
    return _of(rollups, "all").agg(*total, _mean_score().alias("avg_score"), _rate("passed").alias("compliance_rate"))


def by_category(rollups: DataFrame) -> DataFrame:
    rows = _of(rollups, "category").groupBy(F.col("value").alias("category"))
    return rows.agg(F.sum("scans").alias("count"), _mean_score().alias("avg_score")).orderBy(F.desc("count"), "category")


def by_platform(rollups: DataFrame, top: int | None = None) -> DataFrame:
    """Scan count and fail rate per platform, most scanned first; ``top`` keeps the chart's leaders."""
    rows = _of(rollups, "platform").groupBy(F.col("value").alias("platform"))
    out = rows.agg(F.sum("scans").alias("count"), _rate("failed").alias("fail_rate")).orderBy(F.desc("count"), "platform")
    return out if top is None else out.limit(top)


def daily(rollups: DataFrame) -> DataFrame:
    """Scans and average score of every day."""
    rows = _of(rollups, "all").groupBy(F.date_format("scan_date", "yyyy-MM-dd").alias("date"))
    return rows.agg(F.sum("scans").alias("scans"), _mean_score().alias("avg_score"))


def daily_platforms(rollups: DataFrame) -> DataFrame:
    """Scans and fail rate of every day and platform."""
    rows = _of(rollups, "platform").groupBy(F.date_format("scan_date", "yyyy-MM-dd").alias("date"), F.col("value").alias("platform"))
    return rows.agg(F.sum("scans").alias("count"), _rate("failed").alias("fail_rate"))


def trends(rollups: DataFrame, scans: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Scans and average score per day over the last ``days`` days before ``now``.

    Whole days come from the rollups; the scans of the first day, which the period may cut, are counted
    from the scans themselves, of that day's month.
    """
    if not 7 <= days <= 365:
        raise ValueError("days must lie between 7 and 365")
    since = now - F.expr(f"INTERVAL {days} DAYS")
    first = scans.filter((F.col("scan_month") == month_of(since)) & (F.col("scan_date") == F.to_date(since)) & (F.col("created_at") >= since))
    parts = merged(_of(rollups, "all").filter(F.col("scan_date") > F.to_date(since)), _of(rollup_rows(first), "all"))
    return daily(parts).orderBy("date")
