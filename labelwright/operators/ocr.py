"""OCR-detection jobs: words to lines to image text, pass combination, product text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.text import bind, labelled_line, matches, strip, words
from .attributes import FLAG_ATTRIBUTES, STRING_ATTRIBUTES

BAND = 20
SEGMENT = 512  # pixels; splits the words of a line so that no first-step group is a whole line

# Signals flagged in recognised text, marks between passes, product code types.
LICENCE_SIGNAL = (
    r"FSSAI|Lic\.?\s*No\.?|Licence\s*No|License\s*No|LIC\s*NO|[1-9]\d{13}"
    r"|[1-9]\d{3}[\s\-]\d{4}[\s\-]\d{4}[\s\-]\d{2}|[1-9]\d{3}[\s\-]\d{4}[\s\-]\d{6}|[1-9]\d{1,3}(?:[\s\-]\d{2,4}){3,5}"
)
COMPLIANCE_SIGNAL = (
    r"manufacturer|packer|importer|mrp|net.?weight|net.?qty|consumer.?care|country.?of.?origin|best.?before|batch|lot.?no|ingredient"
)
CROP_MARK, ZONE_MARK = "\n\n[CROP]\n", "\n\n[FSSAI_ZONE]\n"
BARCODE_TYPES = ("EAN13", "EAN8", "CODE128", "UPCA", "GTIN")


def word_boxes(detections: DataFrame) -> DataFrame:
    """Add the line band and the left edge of every word."""
    box = F.col("bbox")
    centre = (F.get(F.get(box, F.lit(0)), F.lit(1)) + F.get(F.get(box, F.lit(2)), F.lit(1))) / 2
    return detections.withColumn("band", (centre / BAND).cast("int")).withColumn("x", F.get(F.get(box, F.lit(0)), F.lit(0)))


def text_lines(detections: DataFrame) -> DataFrame:
    """One row per line: words of a 20-pixel band, left to right.

    Words are first joined within a stretch of a band, then the stretches of the
    band; confidences travel as sums.
    """
    keys = ["image_id", "variant", "band"]
    pieces = (
        word_boxes(detections)
        .groupBy(*keys, F.floor(F.col("x") / SEGMENT).alias("_seg"))
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("x", "ord", "text"))), lambda w: w["text"]), " "
            ).alias("_piece"),
            F.sum("conf").alias("_sum"),
            F.count(F.lit(1)).alias("_n"),
        )
    )
    return pieces.groupBy(*keys).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_seg", "_piece"))), lambda p: p["_piece"]), " "
        ).alias("line"),
        (F.sum("_sum") / F.sum("_n")).alias("line_conf"),
    )


def image_texts(detections: DataFrame) -> DataFrame:
    """Text and confidence of each (image, variant): lines top to bottom; confidence is the mean of line means.

    The lines of one image end up in one value, which is what the result is;
    they arrive there already joined from words.
    """
    return (
        text_lines(detections)
        .groupBy("image_id", "variant")
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("band", "line"))), lambda r: r["line"]), "\n"
            ).alias("text"),
            F.avg("line_conf").alias("conf"),
        )
    )


# variants of each pass, in order
PASSES = {"full": ("full",), "contrast": ("contrast",), "bottom": ("bottom", "bottom_crop"), "mid": ("mid", "mid_crop")}


def passes_of(texts: DataFrame) -> DataFrame:
    """One row per image with the non-empty texts of each pass in variant order, and the confidence of the first of them.

    An image has at most one text for each of the few variants.
    """
    aggs = []
    for name, members in PASSES.items():
        place = F.array_position(F.array(*map(F.lit, members)), F.col("variant"))
        hit = F.when(F.col("variant").isin(*members) & (F.col("text") != ""), F.struct(place.alias("place"), "text", "conf"))
        aggs.append(F.array_sort(F.collect_list(hit)).alias(name))
    rows = texts.groupBy("image_id").agg(*aggs)
    return rows.select(
        "image_id",
        *[F.transform(n, lambda x: x["text"]).alias(f"{n}_texts") for n in PASSES],
        *[F.get(n, F.lit(0))["conf"].alias(f"{n}_conf") for n in PASSES],
    )


def _combined(texts: DataFrame, mark: str) -> DataFrame:
    """Longer of the full and the contrast pass, then every crop; the other of the two is ``other_text``."""
    d = passes_of(texts)
    full, contrast = (F.coalesce(F.get(f"{n}_texts", F.lit(0)), F.lit("")) for n in ("full", "contrast"))
    swap = F.length(contrast) > F.length(full)
    best = F.when(swap, contrast).otherwise(full)
    used = F.concat_ws(
        "+", F.when((full != "") & ~swap, "full"), F.when(swap, "contrast"),
        F.when(F.size("bottom_texts") > 0, "bottom_crop"), F.when(F.size("mid_texts") > 0, "mid_crop"),
    )
    return d.select(
        "image_id",
        F.array_join(F.concat(F.filter(F.array(best), lambda t: t != ""), "bottom_texts", "mid_texts"), mark).alias("text"),
        F.when(best == "", 0.0).when(swap, F.col("contrast_conf")).otherwise(F.col("full_conf")).alias("conf"),
        F.when(swap, full).otherwise(contrast).alias("other_text"), used.alias("used_variants"),
    )


def combine_upload(texts: DataFrame) -> DataFrame:
    """All passes of an uploaded image, parted by blank lines."""
    return _combined(texts, "\n\n").drop("used_variants")


def combine_scan(texts: DataFrame) -> DataFrame:
    """All passes of the product scan, parted by crop marks, with the passes used."""
    return _combined(texts, CROP_MARK)


def flag_signals(images: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Flag licence and declaration signals; text of the licence zone (image_id, zone_text) joins if it has one.

    Where the chosen text shows no licence and the pass that was not chosen (``other_text``) does, that pass joins too.
    """
    t = F.col("text")
    if "other_text" in images.columns:
        more = ~matches(t, LICENCE_SIGNAL) & matches(F.col("other_text"), LICENCE_SIGNAL)
        images = images.withColumn("text", F.when(more, F.concat(t, F.lit(ZONE_MARK), "other_text")).otherwise(t))
    out = images.withColumn("has_fssai_signal", matches(t, LICENCE_SIGNAL)).withColumn(
        "has_compliance_signal", matches(t, COMPLIANCE_SIGNAL)
    )
    if zones is None:
        return out
    # zones in which a licence is seen; an image has few of them
    seen = zones.filter(matches(F.col("zone_text"), LICENCE_SIGNAL)).groupBy("image_id").agg(F.sort_array(F.collect_set("zone_text")).alias("_zones"))
    joined = out.join(seen, "image_id", "left")
    add = ~F.col("has_fssai_signal") & F.col("_zones").isNotNull()
    return (
        joined.withColumn("_add", add)
        .withColumn("text", F.when(F.col("_add"), F.array_join(F.concat(F.array(t), "_zones"), ZONE_MARK)).otherwise(t))
        .withColumn("has_fssai_signal", F.col("has_fssai_signal") | F.col("_add"))
        .drop("_add", "_zones")
    )


def product_texts(images: DataFrame, max_images: int | None = None) -> DataFrame:
    """Texts of a product's images joined in rank order, with confidence and licence position.

    Input: ``product_id, rank, downloaded, text, conf, has_fssai_signal``, ranks from 0 on.  Only the
    first ``max_images`` ranks take part if that is given.
    """
    top = images.withColumn("_rn", F.col("rank") + 1)
    if max_images is not None:
        top = top.filter(F.col("_rn") <= max_images)
    present = F.col("downloaded") & (F.col("text") != "")
    return top.groupBy("product_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(present, F.struct("_rn", "text")))), lambda r: r["text"]
            ),
            "\n\n",
        ).alias("combined_text"),
        F.bround(F.coalesce(F.avg(F.when(present, F.col("conf"))), F.lit(0.0)), 3).alias("avg_confidence"),
        F.count(F.lit(1)).alias("images_processed"),
        F.count_if("downloaded").alias("images_downloaded"),
        F.min(F.when(F.col("has_fssai_signal"), F.col("_rn") - 1)).alias("fssai_found_in"),
    )


def merge_barcodes(barcodes: DataFrame) -> DataFrame:
    """First product barcode and first QR code of each product."""
    code = F.col("type").isin(*BARCODE_TYPES)
    first = lambda cond: F.min(F.when(cond, F.struct("image_ord", "ord", "type", "value")))
    return (
        barcodes.groupBy("product_id")
        .agg(first(code).alias("b"), first(F.col("type") == "QRCODE").alias("q"))
        .select(
            "product_id", F.col("b.value").alias("barcode"), F.col("b.type").alias("barcode_type"), F.col("q.value").alias("qr_code"),
        )
    )


def clean_lines(text: Column, min_chars: int, filler: str, drop: tuple[str, ...] = ()) -> Column:
    """Trimmed lines of a text that carry content, as an array."""
    lines = F.transform(F.split(text, "\r\n|\n|\r"), strip)

    def keep(line: Column) -> Column:
        ok = (F.length(line) >= min_chars) & (F.btrim(line, F.lit(filler)) != "") & ~line.contains("Not Detected")
        for d in drop:
            ok = ok & (line != d)
        return ok

    return F.filter(lines, keep)


def upload_lines(text: Column) -> Column:
    return clean_lines(text, 4, "=-_*#|[]")


def scan_lines(text: Column) -> Column:
    return clean_lines(text, 9, "=-_*#", ("INFORMATION",))


def label_texts(attributes: DataFrame, text: str = "text") -> DataFrame:
    """Structured label text from extracted attributes, with the cleaned raw text below it.

    Adds ``extracted_text, word_count, fields_detected``.
    """
    a = F.col
    name = F.coalesce("manufacturer_name", "manufacturer_raw", F.lit(""))
    address = F.coalesce("manufacturer_address", F.lit(""))
    packer = F.coalesce("packer_name", "packer_raw", F.lit(""))
    importer = F.coalesce("importer_name", "importer_raw", F.lit(""))
    party = F.when((name != "") & (address != ""), F.concat(name, F.lit(", "), address)).when(name != "", name).otherwise(address)
    known = F.concat_ws(" ", F.when(name != "", name), F.when(address != "", address), F.when(packer != "", packer))
    prepared = attributes.select(
        "*",
        F.coalesce("country_of_origin", bind(known, geo.infer_country), bind(a(text), geo.infer_country)).alias("_coo"),
        upload_lines(a(text)).alias("_raw_lines"),
    )
    number = F.regexp_replace("mrp", "[^0-9.]", "")
    lines = F.concat_ws(
        "\n",
        labelled_line("Manufactured by", party),
        F.when((packer != name) & (packer != address), labelled_line("Packed by", packer)),
        labelled_line("Imported by", importer),
        labelled_line("Net Quantity", a("net_quantity")),
        F.when(number != "", F.concat(F.lit("MRP: Rs. "), number)),
        labelled_line("Mfg. Date", a("mfg_date")),
        labelled_line("Best Before", a("expiry_date")),
        labelled_line("Consumer Care", a("consumer_care_phone")),
        labelled_line("Consumer Care Email", a("consumer_care_email")),
        labelled_line("Country of Origin", a("_coo")),
        F.concat(F.lit("FSSAI Licence No. "), a("fssai")),
        labelled_line("Ingredients", a("ingredients")),
        labelled_line("Batch No.", a("batch_no")),
        F.when(
            F.size("_raw_lines") > 0, F.concat(F.lit("\n--- Extracted Text ---\n"), F.array_join("_raw_lines", "\n"))
        ),
    )
    names = [n for n in STRING_ATTRIBUTES] + [f for f in FLAG_ATTRIBUTES if f == "ingredient_complete"]
    detected = F.array_compact(
        F.array(
            *[
                F.when(F.col(n) if n in FLAG_ATTRIBUTES else F.col(n).isNotNull(), F.lit(n)) for n in names
            ],
            F.when(a("_coo").isNotNull() & a("country_of_origin").isNull(), F.lit("country_of_origin (inferred)")),
        )
    )
    staged = prepared.select("*", lines.alias("extracted_text"), detected.alias("fields_detected"))
    return staged.withColumn("word_count", F.size(words(a("extracted_text")))).drop("_coo", "_raw_lines")

