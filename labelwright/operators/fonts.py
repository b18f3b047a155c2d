"""Font-height and display-panel checks over OCR words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip

# Largest package area (cm², None = no limit) and minimum height in mm; display share; default scale.
SCHEDULE = [(200.0, 1.0), (500.0, 2.0), (2500.0, 4.0), (None, 6.0)]
DEFAULT_AREA = 200.0
DEFAULT_PX_PER_MM = 96 / 25.4
REQUIRED_SHARE = 40.0


def min_font_height(area: Column) -> Column:
    chain = None
    for limit, mm in SCHEDULE:
        if limit is None:
            return chain.otherwise(mm)
        chain = F.when(area <= limit, mm) if chain is None else chain.when(area <= limit, mm)
    return chain


def schedule_table(spark: SparkSession) -> DataFrame:
    """The schedule as ``min_area_exclusive, max_area, min_font_mm`` rows."""
    rows, low = [], None
    for limit, mm in SCHEDULE:
        rows.append((low, limit, mm))
        low = limit
    return spark.createDataFrame(rows, "min_area_exclusive double, max_area double, min_font_mm double")


def with_schedule(images: DataFrame) -> DataFrame:
    """Range join of images to the schedule; the table has four rows, so it is broadcast."""
    s = F.broadcast(schedule_table(images.sparkSession))
    area = F.col("package_area_cm2")
    low = F.col("min_area_exclusive").isNull() | (area > F.col("min_area_exclusive"))
    high = F.col("max_area").isNull() | (area <= F.col("max_area"))
    return images.join(s, low & high, "left").drop("min_area_exclusive", "max_area")


def px_per_mm(width_px: Column, reference_mm: Column) -> Column:
    return F.when(reference_mm > 0, width_px / reference_mm).otherwise(F.lit(DEFAULT_PX_PER_MM))


def measure_words(detections: DataFrame, images: DataFrame) -> DataFrame:
    """Height of each non-blank word in pixels and millimetres.

    The image facts join by image; heights come from the box alone.
    """
    ys = F.transform("bbox", lambda p: F.get(p, F.lit(1)))
    boxes = detections.filter(strip(F.col("text")) != "").select(
        "image_id", "variant", "ord", strip(F.col("text")).alias("text"), F.bround("conf", 3).alias("confidence"),
        (F.array_max(ys) - F.array_min(ys)).alias("_px"),
    )
    facts = images.select(
        "image_id", px_per_mm(F.col("width_px"), F.col("reference_width_mm")).alias("px_per_mm"),
        min_font_height(F.col("package_area_cm2")).alias("min_required_mm"),
    )
    return boxes.join(facts, "image_id").select(
        "image_id", "variant", "ord", "text", "confidence", "px_per_mm", "min_required_mm",
        F.bround("_px", 1).alias("height_px"), F.bround(F.col("_px") / F.col("px_per_mm"), 2).alias("height_mm"),
    )


def pdp_compliance(total: Column, panel: Column) -> Column:
    """Struct ``pdp_percentage, required_percentage, status, verdict, error``."""
    pct = F.bround(F.try_divide(panel, total) * 100, 1)
    ok = pct >= REQUIRED_SHARE
    bad = total <= 0
    verdict = F.concat(
        F.lit("PDP occupies "), pct.cast("string"), F.lit("% of total surface — "),
        F.when(ok, "meets").otherwise("does NOT meet"), F.lit(" the ≥40% requirement of Rule 9."),
    )
    return F.struct(
        F.when(~bad, pct).alias("pdp_percentage"),
        F.when(~bad, F.lit(REQUIRED_SHARE)).alias("required_percentage"),
        F.when(~bad, F.when(ok, "PASS").otherwise("FAIL")).alias("status"),
        F.when(~bad, verdict).alias("verdict"),
        F.when(bad, F.lit("Total surface area must be > 0")).alias("error"),
    )


def _mean(total: Column, n: Column) -> Column:
    """Whole-number mean of whole numbers of 0 or more; a half goes to the even neighbour, exactly."""
    rest = total % n
    whole = ((total - rest) / n).cast("bigint")
    return whole + F.when((2 * rest > n) | ((2 * rest == n) & (whole % 2 == 1)), 1).otherwise(0)


def font_verdicts(measured: DataFrame, images: DataFrame, shown: int | None = None) -> DataFrame:
    """Verdict per image: REVIEW without words, FAIL if any word is too small, else PASS.

    Statistics are partial aggregates, the mean a sum of whole hundredths.  The verdict names
    the words that are too small, the first ``shown`` of them if given.
    """
    small = F.col("height_mm") < F.col("min_required_mm")
    stats = measured.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("word_count"),
        F.bround(F.min("height_mm"), 2).alias("smallest_mm"),
        (_mean(F.sum(F.round(F.col("height_mm") * 100).cast("bigint")), F.count(F.lit(1))) / 100).alias("avg_mm"),
        F.count_if(small).alias("non_compliant_count"),
    )
    offenders = measured.filter(small)
    if shown is not None:
        w = Window.partitionBy("image_id").orderBy("ord", "variant")
        offenders = offenders.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= shown)
    named = (
        offenders.groupBy("image_id")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("ord", "variant", "text", "height_mm"))),
                    lambda m: F.concat(F.lit('"'), m["text"], F.lit('"('), m["height_mm"].cast("string"), F.lit("mm)")),
                ),
                ", ",
            ).alias("_named")
        )
    )
    d = images.join(stats, "image_id", "left").join(named, "image_id", "left").withColumn(
        "min_required_mm", min_font_height(F.col("package_area_cm2"))
    )
    n = F.coalesce("word_count", F.lit(0))
    bad = F.coalesce("non_compliant_count", F.lit(0))
    limit, area, least = (F.col(c).cast("string") for c in ("min_required_mm", "package_area_cm2", "smallest_mm"))
    verdict = (
        F.when(n == 0, "No text detected in the image. Cannot assess font compliance.")
        .when(
            bad == 0,
            F.concat(
                F.lit("All "), n.cast("string"), F.lit(" detected text elements meet the minimum "), limit,
                F.lit(" mm height required by Schedule II for a "), area, F.lit(" cm² package. Smallest detected: "), least, F.lit(" mm."),
            ),
        )
        .otherwise(
            F.concat(
                bad.cast("string"), F.lit(" of "), n.cast("string"), F.lit(" text elements are below the "), limit,
                F.lit(" mm minimum (Schedule II). Smallest detected: "), least, F.lit(" mm. Non-compliant text: "), F.col("_named"),
            )
        )
    )
    pdp = F.when(
        (F.coalesce("total_surface_cm2", F.lit(0.0)) != 0) & (F.coalesce("pdp_area_cm2", F.lit(0.0)) != 0),
        pdp_compliance(F.col("total_surface_cm2"), F.col("pdp_area_cm2")),
    )
    return d.select(
        "image_id", "package_area_cm2", "min_required_mm", n.alias("word_count"),
        F.coalesce("smallest_mm", F.lit(0.0)).alias("smallest_mm"), F.coalesce("avg_mm", F.lit(0.0)).alias("avg_mm"),
        bad.alias("non_compliant_count"),
        F.when(n == 0, "REVIEW").when(bad == 0, "PASS").otherwise("FAIL").alias("overall_status"),
        verdict.alias("verdict"),
        F.bround(px_per_mm(F.col("width_px"), F.col("reference_width_mm")), 3).alias("px_per_mm"), pdp.alias("pdp"),
    )
