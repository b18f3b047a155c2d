"""OCR-detection and font queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fonts as T
from ..operators import ocr as O
from ..operators.attributes import extract_attributes
from ..oracle.sqlx import has, q, strip
from ..oracle.text_sql import attributes as attributes_sql
from ..oracle.text_sql import infer_country
from . import corpus as C
from .registry import Registry

R = Registry()
DET = C.DETECTIONS_SQL
IMAGES = C.sql(C.IMAGES)
LABELS = C.sql(C.PRODUCT_LABELS)

_LINES = f"""SELECT image_id, variant, band, string_agg(text, ' ' ORDER BY x0, ord) AS line, avg(conf) AS line_conf
FROM (SELECT *, CAST(trunc((y0 + y1) / 2 / 20) AS INT) AS band FROM ({DET}) d0) d1 GROUP BY image_id, variant, band"""
_TEXTS = f"SELECT image_id, variant, string_agg(line, chr(10) ORDER BY band) AS text, avg(line_conf) AS conf FROM ({_LINES}) l GROUP BY image_id, variant"
_PIVOT = "SELECT image_id, " + ", ".join(
    f"max(CASE WHEN variant = '{v}' THEN text END) AS {v}_text, max(CASE WHEN variant = '{v}' THEN conf END) AS {v}_conf"
    for v in ("full", "contrast", "bottom", "mid")
) + f" FROM ({_TEXTS}) t GROUP BY image_id"


def detections(spark, sf_dir):
    return C.detections(spark, sf_dir)


def texts(spark, sf_dir):
    return O.image_texts(detections(spark, sf_dir))


def images(spark, sf_dir):
    return C.frame(spark, sf_dir, C.IMAGES)


@R.add("src_05_detections", f"SELECT image_id, variant, ord, x0, y0, x1, y1, text, CAST(conf AS DOUBLE) AS conf FROM ({DET}) d")
def src_detections(spark, sf_dir):
    a, b = F.get("bbox", F.lit(0)), F.get("bbox", F.lit(2))
    return detections(spark, sf_dir).select(
        "image_id", "variant", "ord", F.get(a, F.lit(0)).alias("x0"), F.get(a, F.lit(1)).alias("y0"),
        F.get(b, F.lit(0)).alias("x1"), F.get(b, F.lit(1)).alias("y1"), "text", "conf",
    )


@R.add("ocr_01_lines", f"SELECT image_id, variant, band, line, round(line_conf, 6) AS line_conf FROM ({_LINES}) l")
def lines(spark, sf_dir):
    return O.text_lines(detections(spark, sf_dir)).withColumn("line_conf", F.round("line_conf", 6))


@R.add("ocr_01_agg_11_image_text", f"SELECT image_id, variant, text, round(conf, 6) AS conf FROM ({_TEXTS}) t")
def image_text(spark, sf_dir):
    return texts(spark, sf_dir).withColumn("conf", F.round("conf", 6))


_SWAP = "length(coalesce(contrast_text, '')) > length(coalesce(full_text, ''))"
_BEST = f"nullif(CASE WHEN {_SWAP} THEN contrast_text ELSE coalesce(full_text, '') END, '')"


def _passes(mark: str) -> str:
    return f"""SELECT image_id, concat_ws({mark}, {_BEST}, nullif(bottom_text, ''), nullif(mid_text, '')) AS text,
  CASE WHEN {_BEST} IS NULL THEN 0 WHEN {_SWAP} THEN contrast_conf ELSE full_conf END AS conf,
  concat_ws('+', CASE WHEN coalesce(full_text, '') <> '' AND NOT ({_SWAP}) THEN 'full' END, CASE WHEN {_SWAP} THEN 'contrast' END,
    CASE WHEN bottom_text <> '' THEN 'bottom_crop' END, CASE WHEN mid_text <> '' THEN 'mid_crop' END) AS used_variants,
  CASE WHEN {_SWAP} THEN coalesce(full_text, '') ELSE coalesce(contrast_text, '') END AS other_text FROM ({_PIVOT}) p"""


@R.add("ocr_02_upload_passes", f"SELECT image_id, text, round(conf, 6) AS conf, other_text FROM ({_passes('chr(10) || chr(10)')}) z")
def upload_passes(spark, sf_dir):
    return O.combine_upload(texts(spark, sf_dir)).withColumn("conf", F.round("conf", 6))


_SCAN = _passes(q(O.CROP_MARK))


@R.add("ocr_03_scan_passes", f"SELECT image_id, text, round(conf, 6) AS conf, other_text, used_variants FROM ({_SCAN}) z")
def scan_passes(spark, sf_dir):
    return O.combine_scan(texts(spark, sf_dir)).withColumn("conf", F.round("conf", 6))


_JOINED = f"SELECT * REPLACE (CASE WHEN NOT {has('text', O.LICENCE_SIGNAL)} AND {has('other_text', O.LICENCE_SIGNAL)} THEN text || {q(O.ZONE_MARK)} || other_text ELSE text END AS text) FROM ({_SCAN}) z"
_FLAGGED = f"SELECT *, {has('text', O.LICENCE_SIGNAL)} AS has_fssai_signal, {has('text', O.COMPLIANCE_SIGNAL)} AS has_compliance_signal FROM ({_JOINED}) z"
# the licence zone of an image is the bottom pass of the image before it
_ZONES = f"SELECT CAST(CAST(image_id AS BIGINT) + 1 AS STRING) AS image_id, text AS zone_text FROM ({_TEXTS}) t WHERE variant = 'bottom'"


def _zones(spark, sf_dir):
    return texts(spark, sf_dir).filter("variant = 'bottom'").select(
        (F.col("image_id").cast("bigint") + 1).cast("string").alias("image_id"), F.col("text").alias("zone_text")
    )


@R.add(
    "ocr_04_signals",
    f"""SELECT f.image_id, CASE WHEN NOT has_fssai_signal AND {has('zone_text', O.LICENCE_SIGNAL)} THEN text || {q(O.ZONE_MARK)} || zone_text ELSE text END AS text,
  has_fssai_signal OR {has('zone_text', O.LICENCE_SIGNAL)} AS has_fssai_signal, has_compliance_signal
FROM ({_FLAGGED}) f LEFT JOIN ({_ZONES}) z ON f.image_id = z.image_id""",
)
def signals(spark, sf_dir):
    flagged = O.flag_signals(O.combine_scan(texts(spark, sf_dir)), _zones(spark, sf_dir))
    return flagged.select("image_id", "text", "has_fssai_signal", "has_compliance_signal")


# products of up to nine images: images grouped by the leading part of their number
_PRODUCT = "CAST(CAST(image_id AS BIGINT) // 9 AS STRING) AS product_id, CAST(image_id AS BIGINT) % 9 AS rank"


def product_images(spark, sf_dir):
    n = F.col("image_id").cast("bigint")
    return O.flag_signals(O.combine_scan(texts(spark, sf_dir))).select(
        F.floor(n / 9).cast("string").alias("product_id"), (n % 9).alias("rank"), (n % 7 != 3).alias("downloaded"),
        "text", "conf", "has_fssai_signal",
    )


@R.add(
    "ocr_05_product_texts",
    f"""SELECT product_id, coalesce(string_agg(CASE WHEN downloaded AND text <> '' THEN text END, chr(10) || chr(10) ORDER BY rank), '') AS combined_text,
  round(coalesce(avg(CASE WHEN downloaded AND text <> '' THEN conf END), 0), 3) AS avg_confidence, count(*) AS images_processed,
  count(*) FILTER (WHERE downloaded) AS images_downloaded, min(CASE WHEN has_fssai_signal THEN rank END) AS fssai_found_in
FROM (SELECT *, {_PRODUCT}, CAST(image_id AS BIGINT) % 7 <> 3 AS downloaded FROM ({_FLAGGED}) f) h GROUP BY product_id""",
)
def product_texts(spark, sf_dir):
    return O.product_texts(product_images(spark, sf_dir))


_CODES = """SELECT CAST(l_partkey AS STRING) AS product_id, l_linenumber AS image_ord, l_orderkey * 1000 + l_suppkey AS ord,
  CASE l_orderkey % 4 WHEN 0 THEN 'QRCODE' WHEN 1 THEN 'EAN13' WHEN 2 THEN 'CODE39' ELSE 'UPCA' END AS type,
  CAST(8900000000000 + l_orderkey AS STRING) AS value FROM {lineitem}"""


@R.add(
    "ocr_06_barcodes",
    f"""SELECT product_id, min_by(value, CAST(image_ord AS BIGINT) * 1000000000 + ord) FILTER (WHERE type IN ('EAN13', 'UPCA')) AS barcode,
  min_by(type, CAST(image_ord AS BIGINT) * 1000000000 + ord) FILTER (WHERE type IN ('EAN13', 'UPCA')) AS barcode_type,
  min_by(value, CAST(image_ord AS BIGINT) * 1000000000 + ord) FILTER (WHERE type = 'QRCODE') AS qr_code
FROM ({C.sql(_CODES)}) b GROUP BY product_id""",
)
def barcodes(spark, sf_dir):
    return O.merge_barcodes(C.frame(spark, sf_dir, _CODES))


def _clean_sql(text: str, n: int, filler: str, drop: str = "") -> str:
    return (
        f"list_filter(list_transform(string_split({text}, chr(10)), lambda s: {strip('s')}), "
        f"lambda s: length(s) >= {n} AND trim(s, {q(filler)}) <> '' AND NOT contains(s, 'Not Detected'){drop})"
    )


@R.add(
    "flt_11_clean_lines",
    f"""SELECT product_id, array_to_string({_clean_sql('text', 9, '=-_*#', " AND s <> 'INFORMATION'")}, chr(10)) AS scan_lines,
  array_to_string({_clean_sql('text', 4, '=-_*#|[]')}, chr(10)) AS upload_lines FROM ({LABELS}) l""",
)
def clean_lines(spark, sf_dir):
    return C.frame(spark, sf_dir, C.PRODUCT_LABELS).select(
        "product_id", F.array_join(O.scan_lines(F.col("text")), "\n").alias("scan_lines"),
        F.array_join(O.upload_lines(F.col("text")), "\n").alias("upload_lines"),
    )


def _line(label: str, e: str) -> str:
    return f"CASE WHEN {strip(e)} <> '' THEN '{label}: ' || {e} END"


_ATTR = f"SELECT a.*, l.text FROM ({attributes_sql(LABELS, 'product_id')}) a JOIN ({LABELS}) l USING (product_id)"
_NAME, _ADDR = "coalesce(manufacturer_name, manufacturer_raw, '')", "coalesce(manufacturer_address, '')"
_PACK, _IMP = "coalesce(packer_name, packer_raw, '')", "coalesce(importer_name, importer_raw, '')"
_KNOWN = f"concat_ws(' ', nullif({_NAME}, ''), nullif({_ADDR}, ''), nullif({_PACK}, ''))"
_PARTY = f"CASE WHEN {_NAME} <> '' AND {_ADDR} <> '' THEN {_NAME} || ', ' || {_ADDR} WHEN {_NAME} <> '' THEN {_NAME} ELSE {_ADDR} END"
_LABEL_SQL = f"""SELECT product_id, concat_ws(chr(10), {_line('Manufactured by', 'party')},
  CASE WHEN pack <> name AND pack <> addr THEN {_line('Packed by', 'pack')} END, {_line('Imported by', 'imp')}, {_line('Net Quantity', 'net_quantity')},
  CASE WHEN num <> '' THEN 'MRP: Rs. ' || num END, {_line('Mfg. Date', 'mfg_date')}, {_line('Best Before', 'expiry_date')},
  {_line('Consumer Care', 'consumer_care_phone')}, {_line('Consumer Care Email', 'consumer_care_email')}, {_line('Country of Origin', 'coo')},
  'FSSAI Licence No. ' || fssai, {_line('Ingredients', 'ingredients')}, {_line('Batch No.', 'batch_no')},
  CASE WHEN len(raw) > 0 THEN chr(10) || '--- Extracted Text ---' || chr(10) || array_to_string(raw, chr(10)) END) AS extracted_text
FROM (SELECT *, {_PARTY} AS party, {_NAME} AS name, {_ADDR} AS addr, {_PACK} AS pack, {_IMP} AS imp, regexp_replace(mrp, '[^0-9.]', '', 'g') AS num,
  coalesce(country_of_origin, {infer_country(_KNOWN)}, {infer_country('text')}) AS coo, {_clean_sql('text', 4, '=-_*#|[]')} AS raw FROM ({_ATTR}) a0) a1"""


@R.add("ocr_07_label_texts", f"SELECT * , len(list_filter(regexp_split_to_array(extracted_text, '\\s+'), lambda w: w <> '')) AS word_count FROM ({_LABEL_SQL}) z")
def label_texts(spark, sf_dir):
    labels = C.frame(spark, sf_dir, C.PRODUCT_LABELS)
    return O.label_texts(extract_attributes(labels)).select("product_id", "extracted_text", "word_count")


_PXMM = "CASE WHEN reference_width_mm > 0 THEN width_px / reference_width_mm ELSE CAST(96 AS DOUBLE) / CAST(25.4 AS DOUBLE) END"
_MINMM = "CASE WHEN package_area_cm2 <= 200 THEN 1.0 WHEN package_area_cm2 <= 500 THEN 2.0 WHEN package_area_cm2 <= 2500 THEN 4.0 ELSE 6.0 END"


def _dec(e: str, n: int) -> str:
    return f"CAST(round_even(CAST(CAST({e} AS STRING) AS DECIMAL(38,20)), {n}) AS DOUBLE)"


_MEASURED = f"""SELECT d.image_id, variant, ord, {strip('text')} AS text, {_dec('conf', 3)} AS confidence, CAST({_PXMM} AS DOUBLE) AS px_per_mm,
  CAST({_MINMM} AS DOUBLE) AS min_required_mm, {_dec('(y1 - y0)', 1)} AS height_px, {_dec(f'(CAST(y1 - y0 AS DOUBLE) / CAST({_PXMM} AS DOUBLE))', 2)} AS height_mm
FROM ({DET}) d JOIN ({IMAGES}) i ON d.image_id = i.image_id WHERE {strip('text')} <> ''"""


@R.add("fnt_01_word_heights", f"SELECT image_id, variant, ord, text, confidence, height_px, height_mm FROM ({_MEASURED}) m")
def word_heights(spark, sf_dir):
    return T.measure_words(detections(spark, sf_dir), images(spark, sf_dir)).select(
        "image_id", "variant", "ord", "text", "confidence", "height_px", "height_mm"
    )


@R.add("fnt_02_jn_04_schedule", f"SELECT image_id, package_area_cm2, {_MINMM}::DOUBLE AS min_font_mm, {_MINMM}::DOUBLE AS by_case FROM ({IMAGES}) i")
def schedule(spark, sf_dir):
    return T.with_schedule(images(spark, sf_dir)).select(
        "image_id", "package_area_cm2", "min_font_mm", T.min_font_height(F.col("package_area_cm2")).alias("by_case")
    )


@R.add(
    "fnt_03_verdicts",
    f"""SELECT i.image_id, coalesce(n, 0) AS word_count, coalesce(smallest, 0) AS smallest_mm, coalesce((total // n + CASE WHEN 2 * (total % n) > n OR (2 * (total % n) = n AND (total // n) % 2 = 1) THEN 1 ELSE 0 END) / 100, 0) AS avg_mm, coalesce(bad, 0) AS non_compliant_count,
  CASE WHEN coalesce(n, 0) = 0 THEN 'REVIEW' WHEN bad = 0 THEN 'PASS' ELSE 'FAIL' END AS overall_status
FROM ({IMAGES}) i LEFT JOIN (SELECT image_id, count(*) AS n, min(height_mm) AS smallest, CAST(sum(CAST(round(height_mm * 100) AS BIGINT)) AS BIGINT) AS total,
  count(*) FILTER (WHERE height_mm < min_required_mm) AS bad FROM ({_MEASURED}) m GROUP BY image_id) s ON i.image_id = s.image_id""",
)
def verdicts(spark, sf_dir):
    i = images(spark, sf_dir)
    return T.font_verdicts(T.measure_words(detections(spark, sf_dir), i), i).select(
        "image_id", "word_count", "smallest_mm", "avg_mm", "non_compliant_count", "overall_status"
    )


_MM = lambda e: f"CAST(CAST({e} AS DOUBLE) AS STRING)"
_VERDICT = f"""SELECT i.image_id, {_dec(f'CAST({_PXMM} AS DOUBLE)', 3)} AS px_per_mm,
  CASE WHEN coalesce(n, 0) = 0 THEN 'No text detected in the image. Cannot assess font compliance.'
    WHEN bad = 0 THEN 'All ' || n || ' detected text elements meet the minimum ' || {_MM(_MINMM)} || ' mm height required by Schedule II for a ' || {_MM('package_area_cm2')} || ' cm² package. Smallest detected: ' || {_MM('smallest')} || ' mm.'
    ELSE bad || ' of ' || n || ' text elements are below the ' || {_MM(_MINMM)} || ' mm minimum (Schedule II). Smallest detected: ' || {_MM('smallest')} || ' mm. Non-compliant text: ' || named END AS verdict
FROM ({IMAGES}) i LEFT JOIN (SELECT image_id, count(*) AS n, min(height_mm) AS smallest, count(*) FILTER (WHERE height_mm < min_required_mm) AS bad,
  string_agg(CASE WHEN height_mm < min_required_mm THEN '"' || text || '"(' || {_MM('height_mm')} || 'mm)' END, ', ' ORDER BY ord, variant) AS named
  FROM ({_MEASURED}) m GROUP BY image_id) s ON i.image_id = s.image_id"""


@R.add("fnt_03_verdict_texts", _VERDICT)
def verdict_texts(spark, sf_dir):
    i = images(spark, sf_dir)
    return T.font_verdicts(T.measure_words(detections(spark, sf_dir), i), i).select("image_id", "verdict", "px_per_mm")


_PCT = _dec("(pdp_area_cm2 / nullif(total_surface_cm2, 0) * 100)", 1)


@R.add(
    "fnt_04_display_panel",
    f"""SELECT image_id, CASE WHEN total_surface_cm2 > 0 THEN {_PCT} END AS pdp_percentage,
  CASE WHEN total_surface_cm2 > 0 THEN CASE WHEN {_PCT} >= 40 THEN 'PASS' ELSE 'FAIL' END END AS status,
  CASE WHEN total_surface_cm2 <= 0 THEN 'Total surface area must be > 0' END AS error
FROM ({IMAGES}) i""",
)
def display_panel(spark, sf_dir):
    d = images(spark, sf_dir).select(
        "image_id", T.pdp_compliance(F.col("total_surface_cm2"), F.col("pdp_area_cm2")).alias("p")
    )
    return d.select("image_id", "p.pdp_percentage", "p.status", "p.error")
