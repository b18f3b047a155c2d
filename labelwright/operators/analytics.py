"""Regulator analytics over the scan and violation tables.

All reports are single-pass aggregates with few groups; Spark combines them
map-side, so even a category that holds a third of all scans costs one row per
task in the shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_decimal(c: Column) -> Column:
    return F.bround(F.coalesce(c, F.lit(0.0)), 1)


def month_of(when: Column) -> Column:
    """Year and month as a number; scans are stored in folders of it."""
    return F.year(when) * 100 + F.month(when)


def recent(scans: DataFrame, since: Column) -> DataFrame:
    """Scans from a time on; of scans in monthly folders, earlier months are not read."""
    found = scans.filter(F.col("created_at") >= since)
    return found.filter(F.col("scan_month") >= month_of(since)) if "scan_month" in scans.columns else found


def summary(scans: DataFrame) -> DataFrame:
    total = F.count(F.lit(1))
    passed = F.count_if(F.col("status") == "PASS")
    return scans.agg(
        total.alias("total_scans"),
        passed.alias("pass_count"),
        F.count_if(F.col("status") == "FAIL").alias("fail_count"),
        F.count_if(F.col("status") == "PARTIAL").alias("partial_count"),
        one_decimal(F.avg("score")).alias("avg_score"),
        one_decimal(F.try_divide(passed, total) * 100).alias("compliance_rate"),
    )


def by_category(scans: DataFrame) -> DataFrame:
    return (
        scans.groupBy("category")
        .agg(F.count(F.lit(1)).alias("count"), one_decimal(F.avg("score")).alias("avg_score"))
        .orderBy(F.desc("count"), "category")
    )


def by_platform(scans: DataFrame, top: int | None = None) -> DataFrame:
    """Scan count and fail rate per platform, most scanned first; ``top`` keeps the chart's leaders."""
    n = F.count(F.lit(1))
    out = (
        scans.groupBy("platform")
        .agg(
            n.alias("count"),
            one_decimal(F.try_divide(F.count_if(F.col("status") == "FAIL"), n) * 100).alias("fail_rate"),
        )
        .orderBy(F.desc("count"), "platform")
    )
    return out if top is None else out.limit(top)


def trends(scans: DataFrame, now: Column, days: int = 30, fill_gaps: bool = False) -> DataFrame:
    """Scans and average score per day over the last ``days`` days before ``now``.

    The time filter is a comparison with a constant, so it is pushed to the scan
    and prunes files when the table is laid out by date.
    """
    if not 7 <= days <= 365:
        raise ValueError("days must lie between 7 and 365")
    since = now - F.expr(f"INTERVAL {days} DAYS")
    daily = (
        recent(scans, since)
        .groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("date"))
        .agg(F.count(F.lit(1)).alias("scans"), one_decimal(F.avg("score")).alias("avg_score"))
    )
    if fill_gaps:
        span = daily.sparkSession.range(1).select(
            F.explode(F.transform(F.sequence(since.cast("date"), now.cast("date")), lambda d: d.cast("string"))).alias("date")
        )
        daily = span.join(daily, "date", "left").select(
            "date", F.coalesce("scans", F.lit(0)).alias("scans"), F.coalesce("avg_score", F.lit(0.0)).alias("avg_score")
        )
    return daily.orderBy("date")


def violations_with_scans(
    violations: DataFrame, scans: DataFrame, severity: str | None = None, platform: str | None = None
) -> DataFrame:
    """Violations joined to their scans, filtered by severity and/or part of a platform name.

    Both filters are applied below the join.
    """
    v = violations if severity is None else violations.filter(F.col("severity") == severity.lower())
    s = scans if platform is None else scans.filter(F.col("platform").ilike(f"%{platform}%"))
    return v.join(s.select("scan_id", "product_name", "platform"), "scan_id", "inner").select(
        "scan_id", "product_name", "platform", "field_id", "field_label",
        "legal_reference", "severity", "reason", "created_at",
    )


def violation_total(joined: DataFrame) -> DataFrame:
    return joined.agg(F.count(F.lit(1)).alias("total"))


def violation_page(joined: DataFrame, skip: int = 0, limit: int = 50) -> DataFrame:
    """One page, newest first.  Offset and limit become a per-task top-k, not a full sort."""
    if skip < 0 or not 1 <= limit <= 200:
        raise ValueError("skip must be >= 0 and limit between 1 and 200")
    return (
        joined.orderBy(F.desc("created_at"), "scan_id", "field_id")
        .offset(skip)
        .limit(limit)
        .select(
            "scan_id", "product_name", "platform", "field_label", "legal_reference",
            "severity", "reason", "created_at",
        )
    )


def _months(table: DataFrame) -> list[int]:
    """Months of a table in monthly folders, newest first, from the names of its files."""
    return sorted({int(m) for f in table.inputFiles() for m in re.findall(r"scan_month=(\d+)", f)}, reverse=True)


def violation_page_after(
    violations: DataFrame, scans: DataFrame, cursor: tuple | None = None, limit: int = 50, severity: str | None = None, platform: str | None = None
) -> DataFrame:
    """The page, newest first, that follows the row (created_at, scan_id, field_id) of ``cursor``; the first page without one.

    Both tables are in monthly folders.  Only months up to the cursor's are read, newest first, twice as many each time until
    the page is full, so a page far back costs what the first one costs.  Rows carry ``field_id``, for the next cursor.
    """
    if not 1 <= limit <= 200:
        raise ValueError("limit must lie between 1 and 200")
    months = _months(violations)
    if cursor is not None:
        at, scan, field = cursor
        months = [m for m in months if m <= at.year * 100 + at.month]
    take, page = 1, None
    while page is None or (len(page.take(limit)) < limit and take < 2 * len(months)):
        chosen = months[:take]
        v = violations.filter(F.col("scan_month").isin(chosen))
        if cursor is not None:
            later = (F.col("created_at") == F.lit(at)) & ((F.col("scan_id") > scan) | ((F.col("scan_id") == scan) & (F.col("field_id") > field)))
            v = v.filter((F.col("created_at") <= F.lit(at)) & ((F.col("created_at") < F.lit(at)) | later))
        s = scans.filter(F.col("scan_month").isin(chosen)).drop("scan_date", "scan_month")
        page = violations_with_scans(v, s, severity, platform).orderBy(F.desc("created_at"), "scan_id", "field_id").limit(limit)
        take *= 2
    return page
