"""Fusion, comparison, report, sink and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import compare as K
from ..operators import fusion as M
from ..operators import ocr as O
from ..operators import reports as T
from ..operators import rollups
from ..operators import scan as S
from ..operators.attributes import extract_attributes
from ..oracle import fusion_sql as Z
from ..oracle import scan_sql as X
from ..oracle.sqlx import one_decimal, q
from ..oracle.text_sql import attributes as attributes_sql
from ..session import ensure_checkpoint_dir
from . import corpus as C
from .q_pages import pages
from .q_scan import ORDERS, SCANS_SQL, order_scans
from .registry import Registry

R = Registry()
RAW = C.sql(C.RAW_VALUES)

_SIDES = f"""SELECT id, qty_a AS wq, nullif(qty_b, '') AS pq, price_a AS wm, nullif(price_b, '') AS pm,
  CASE length(id) % 3 WHEN 0 THEN 'India' WHEN 1 THEN 'Italy' END AS dc, CASE length(price_a) % 3 WHEN 0 THEN 'INDIA' WHEN 1 THEN 'China' END AS xc FROM ({RAW}) r"""
_Q = f"SELECT id, wq, pq, {X.canonical_quantity_columns('wq', 'a_')}, {X.canonical_quantity_columns('pq', 'b_')} FROM ({_SIDES}) s"
_P = f"SELECT id, wm, pm, {X.canonical_price_columns('wm', 'a_')}, {X.canonical_price_columns('pm', 'b_')} FROM ({_SIDES}) s"


@R.add(
    "jn_06_compare_records",
    f"""SELECT id AS product_id, 'Net Quantity' AS field, coalesce(wq, 'Not Found') AS website_value, coalesce(pq, 'Not Found') AS package_value,
  CASE WHEN NOT a_found AND NOT b_found THEN 'NOT_FOUND' WHEN NOT a_found THEN 'PACKAGE_ONLY' WHEN NOT b_found THEN 'WEBSITE_ONLY'
    WHEN a_canonical_unit <> b_canonical_unit THEN 'UNIT_MISMATCH'
    WHEN abs(a_canonical_value - b_canonical_value) / greatest(a_canonical_value, 1) * 100 < 1 THEN 'MATCH' ELSE 'MISMATCH' END AS status
FROM ({_Q}) x WHERE wq IS NOT NULL OR pq IS NOT NULL
UNION ALL
SELECT id, 'MRP', CASE WHEN wm IS NULL THEN 'Not Found' ELSE a_display END, CASE WHEN pm IS NULL THEN 'Not Found' ELSE b_display END,
  CASE WHEN NOT a_found AND NOT b_found THEN 'NOT_FOUND' WHEN NOT a_found THEN 'PACKAGE_ONLY' WHEN NOT b_found THEN 'WEBSITE_ONLY'
    WHEN abs(a_value - b_value) < 0.5 THEN 'MATCH' ELSE 'MISMATCH' END FROM ({_P}) x WHERE wm IS NOT NULL OR pm IS NOT NULL
UNION ALL
SELECT id, 'Country of Origin', coalesce(dc, 'Not Found'), coalesce(xc, 'Not Found'),
  CASE WHEN dc IS NULL THEN 'PACKAGE_ONLY' WHEN xc IS NULL THEN 'WEBSITE_ONLY' WHEN lower(dc) = lower(xc) THEN 'MATCH' ELSE 'REVIEW' END
FROM ({_SIDES}) s WHERE dc IS NOT NULL OR xc IS NOT NULL""",
)
def compare_records(spark, sf_dir):
    raw = C.frame(spark, sf_dir, C.RAW_VALUES)
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    third = lambda e, a, b: F.when(e % 3 == 0, a).when(e % 3 == 1, b)
    none = F.lit(None).cast("string")
    web = raw.select(
        F.col("id").alias("product_id"), F.col("qty_a").alias("quantity"), F.col("price_a").alias("mrp"),
        third(F.length("id"), "India", "Italy").alias("country"), none.alias("brand"), none.alias("maker"),
    )
    pack = raw.select(
        F.col("id").alias("product_id"), blank("qty_b").alias("quantity"), blank("price_b").alias("mrp"),
        third(F.length("price_a"), "INDIA", "China").alias("country"), none.alias("maker"),
    )
    return K.compare_records(web, pack).select("product_id", "field", "website_value", "package_value", "status")


_A = attributes_sql(C.sql(C.PRODUCT_LABELS), "product_id")
_B = attributes_sql(
    f"SELECT CAST(doc_id AS STRING) AS product_id, text FROM documents", "product_id"
)


@R.add(
    "jn_08_overlay",
    f"""SELECT coalesce(p.product_id, w.product_id) AS product_id, coalesce(p.mrp, w.mrp) AS mrp, coalesce(p.net_quantity, w.net_quantity) AS net_quantity,
  coalesce(p.consumer_care_phone, w.consumer_care_phone) AS consumer_care_phone, coalesce(p.consumer_care_email, w.consumer_care_email) AS consumer_care_email,
  coalesce(p.country_of_origin, w.country_of_origin) AS country_of_origin
FROM ({_B}) w FULL JOIN ({_A}) p ON w.product_id = p.product_id""",
)
def overlay(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("product_id"), "text")
    labels = C.frame(spark, sf_dir, C.PRODUCT_LABELS)
    both = M.overlay(extract_attributes(docs), extract_attributes(labels))
    return both.select("product_id", "mrp", "net_quantity", "consumer_care_phone", "consumer_care_email", "country_of_origin")


def package_texts(spark, sf_dir):
    """Pack text of each product page, from the recognised words of its label."""
    texts = O.combine_scan(O.image_texts(C.detections(spark, sf_dir)))
    return texts.select(F.concat(F.lit("P"), F.col("image_id")).alias("product_id"), "text")


def model(spark, sf_dir):
    return M.fuse_products(M.web_products(pages(spark, sf_dir)), package_texts(spark, sf_dir), C.frame(spark, sf_dir, C.PACK_CODES))


@R.add("jn_07_fuse_products")
def fuse(spark, sf_dir):
    d = model(spark, sf_dir)
    return d.select(
        "product_id", F.col("product.name").alias("name"), F.col("product.brand").alias("brand"), "commerce.platform",
        "commerce.mrp_raw", F.col("manufacturer.name").alias("manufacturer"), F.col("manufacturer.source").alias("maker_source"),
        F.col("manufacturer.country").alias("maker_country"), "origin.declared_country", "origin.detected_country",
        F.col("quantity.normalized.display").alias("quantity"), "regulatory.fssai", "dates.expiry_date",
        "product_classification.classification", F.array_join("regulatory.declarations", " | ").alias("declarations"),
    )


@R.add("pge_18_web_corpus")
def web_corpus(spark, sf_dir):
    web = M.web_products(pages(spark, sf_dir))
    return extract_attributes(web.select("page_id", M.web_corpus().alias("corpus")), "corpus", keep=("page_id",)).select(
        "page_id", "net_quantity", "mrp", "fssai", "country_of_origin", "consumer_care_phone"
    )


@R.add("jn_06_product_comparisons")
def product_comparisons(spark, sf_dir):
    d = M.product_comparisons(model(spark, sf_dir))
    return d.select("product_id", F.inline_outer("comparisons")).filter("field IS NOT NULL")


@R.add("txt_01_agg_08_compliance_text")
def compliance_text(spark, sf_dir):
    return M.compliance_texts(model(spark, sf_dir)).select(
        "product_id", "compliance_text", "lm_coverage", "lm_band", "category", F.array_join("missing_fields", ",").alias("missing")
    )


@R.add("txt_01_scan_products")
def scan_products(spark, sf_dir):
    """Fused products through the rule scan."""
    texts = M.compliance_texts(model(spark, sf_dir)).select("product_id", F.col("compliance_text").alias("text"))
    return S.scan_labels(texts).select("product_id", "score", "status")


@R.add("agg_09_completeness")
def completeness(spark, sf_dir):
    return M.completeness(model(spark, sf_dir)).select(
        "product_id", F.array_join("critical_found", ",").alias("found"), F.array_join("critical_missing", ",").alias("missing"),
        "critical_percent",
    )


@R.add("txt_02_product_report")
def product_report(spark, sf_dir):
    return T.product_report(M.completeness(M.product_comparisons(model(spark, sf_dir))))


# ---- the same steps over stated records, so that a checking statement can follow them column by column

_WEB, _PACK, _CODES = (C.sql(t) for t in (C.WEB_RECORDS, C.PACK_TEXTS, C.PACK_CODES))


def web_records(spark, sf_dir):
    """Stated web records in the form in which pages are extracted."""
    raw = C.frame(spark, sf_dir, C.WEB_RECORDS)
    named = F.map_from_arrays(F.array(F.lit("Unit Count"), F.lit("Item Weight"), F.lit("Colour")), F.array("row_count", "row_weight", "row_other"))
    none = F.lit(None).cast("array<string>")
    return raw.select(
        "*", F.map_filter(named, lambda _, v: v.isNotNull()).alias("page_rows"), F.split("bullets", "\\|").alias("feature_bullets"), none.alias("s_image_urls"), none.alias("s_og_images")
    )


def stated_model(spark, sf_dir):
    return M.fuse_products(web_records(spark, sf_dir), C.frame(spark, sf_dir, C.PACK_TEXTS), C.frame(spark, sf_dir, C.PACK_CODES))


def _over(last: str) -> str:
    return Z.model(_WEB, _PACK, _CODES, last)


@R.add(
    "pge_18_stated_corpus",
    _over("SELECT w.page_id, corpus, a.net_quantity, a.mrp, a.fssai, a.country_of_origin, a.consumer_care_phone FROM site w JOIN aw a ON a.product_id = w.page_id"),
)
def stated_corpus(spark, sf_dir):
    web = web_records(spark, sf_dir)
    return extract_attributes(web.select("page_id", M.web_corpus().alias("corpus")), "corpus").select(
        "page_id", "corpus", "net_quantity", "mrp", "fssai", "country_of_origin", "consumer_care_phone"
    )


_PARTY = "{r}_name AS {r}, {r}_text, {r}_structured, {r}_country, CAST({r}_sure AS INT) AS {r}_sure, {r}_source"


@R.add(
    "jn_07_stated_products",
    _over(
        f"""SELECT product_id, name, brand, description, platform, seller, mrp_raw, CASE WHEN mrp_raw IS NOT NULL THEN m_display END AS mrp, {", ".join(_PARTY.format(r=r) for r in M.ENTITY_ROLES)},
  declared, detected, website_qty, package_qty, CASE WHEN qty IS NOT NULL THEN n_display END AS quantity, mfg_date, expiry_date, care_raw, care_phone, care_email, fssai, code AS barcode, barcode_type, qr_code, batch_no,
  array_to_string(declarations, ' | ') AS declarations, ingredients, e_ingredient_complete AS ingredient_complete, allergen_info, storage_instructions, package_mrp, classification FROM model"""
    ),
)
def stated_products(spark, sf_dir):
    parties = [
        F.col(f"{r}.{c}").alias(n)
        for r in M.ENTITY_ROLES
        for c, n in (("name", r), ("address_raw", f"{r}_text"), ("address_structured", f"{r}_structured"), ("country", f"{r}_country"), ("country_confidence", f"{r}_sure"), ("source", f"{r}_source"))
    ]
    return stated_model(spark, sf_dir).select(
        "product_id", "product.name", "product.brand", "product.description", "commerce.platform", "commerce.seller", "commerce.mrp_raw", F.col("commerce.mrp_normalized.display").alias("mrp"), *parties,
        F.col("origin.declared_country").alias("declared"), F.col("origin.detected_country").alias("detected"), F.col("quantity.website_raw").alias("website_qty"),
        F.col("quantity.package_raw").alias("package_qty"), F.col("quantity.normalized.display").alias("quantity"), "dates.mfg_date", "dates.expiry_date", F.col("consumer_care.raw").alias("care_raw"),
        F.col("consumer_care.phone").alias("care_phone"), F.col("consumer_care.email").alias("care_email"), "regulatory.fssai", "regulatory.barcode", "regulatory.barcode_type", "regulatory.qr_code",
        "regulatory.batch_no", F.array_join("regulatory.declarations", " | ").alias("declarations"), "ingredients", "ingredient_complete", "allergen_info", "storage_instructions", "package_mrp",
        "product_classification.classification",
    )


@R.add("jn_06_stated_comparisons", _over(Z.compared()))
def stated_comparisons(spark, sf_dir):
    d = M.product_comparisons(stated_model(spark, sf_dir))
    return d.select("product_id", F.inline_outer("comparisons")).filter("field IS NOT NULL")


_TEXTS_STEP = Z.compliance_step()


@R.add(
    "txt_01_agg_08_stated_texts",
    _over(f"""SELECT product_id, compliance_text, lm_coverage, CASE WHEN lm_coverage >= {M.COVERAGE_GOOD} THEN 'good' WHEN lm_coverage >= {M.COVERAGE_FAIR} THEN 'fair' ELSE 'poor' END AS lm_band, category, missing FROM ({_TEXTS_STEP}) t"""),
)
def stated_texts(spark, sf_dir):
    return M.compliance_texts(stated_model(spark, sf_dir)).select(
        "product_id", "compliance_text", "lm_coverage", "lm_band", "category", F.array_join("missing_fields", ",").alias("missing")
    )


@R.add("txt_01_stated_scans", _over(f"SELECT product_id, score, status FROM ({X.scan_table(f'SELECT product_id, compliance_text AS text FROM ({_TEXTS_STEP}) t', 'product_id')}) z"))
def stated_scans(spark, sf_dir):
    texts = M.compliance_texts(stated_model(spark, sf_dir)).select("product_id", F.col("compliance_text").alias("text"))
    return S.scan_labels(texts).select("product_id", "score", "status")


_HELD, _LACKED = Z.critical()


@R.add(
    "agg_09_stated_completeness",
    _over(f"""SELECT product_id, array_to_string({_HELD}, ',') AS found, array_to_string({_LACKED}, ',') AS missing, CAST(floor(100 * len({_HELD}) / 7) AS INT) AS critical_percent FROM model"""),
)
def stated_completeness(spark, sf_dir):
    return M.completeness(stated_model(spark, sf_dir)).select(
        "product_id", F.array_join("critical_found", ",").alias("found"), F.array_join("critical_missing", ",").alias("missing"), "critical_percent"
    )


_K = "CAST(substr(product_id, 2) AS BIGINT)"
_FIGURES = f"SELECT product_id, {_K} % 9 AS found_n, {_K} % 5 AS downloaded, {_K} % 5 + 1 AS processed, {_K} % 10 / 10 AS confidence FROM model"


@R.add("txt_02_stated_reports", _over(Z.report_query(_FIGURES)))
def stated_reports(spark, sf_dir):
    """Product reports with the figures of the images that were read."""
    d = M.completeness(M.product_comparisons(stated_model(spark, sf_dir)))
    k = F.substring("product_id", 2, 20).cast("bigint")
    figures = {"images_found": k % 9, "images_downloaded": k % 5, "images_processed": k % 5 + 1, "avg_confidence": (k % 10) / 10}
    return T.product_report(d.withColumns(figures))


_FIELDS = X.field_table(ORDERS)
_DETAIL = f"""'  [' || rpad(status, 6, ' ') || '] ' || field_id || ' — ' || field_label
  || coalesce(chr(10) || '           Value     : ' || detected_value, '') || coalesce(chr(10) || '           Normalised: ' || normalized_value, '')
  || coalesce(chr(10) || '           Note      : ' || reason, '') || chr(10)"""


def _head(label: str, e: str) -> str:
    return f"'  {label:<12}: ' || {e}"


@R.add(
    "snk_02_scan_reports",
    f"""SELECT s.scan_id, concat_ws(chr(10), {q(T.WIDE)}, {q(T.TITLE)}, {q(T.SUBTITLE)}, {q(T.WIDE)}, {_head('Scan ID', 's.scan_id')},
  {_head('Product', 'product_name')}, {_head('Category', 'category')}, {_head('Platform', 'platform')}, {_head('Source', 'source_type')},
  {_head('Rule Set', "'PCR-2011-v2'")}, {_head('Scanned On', "strftime(created_at, '%d %b %Y, %H:%M UTC')")},
  {_head('Score', "CAST(score AS STRING) || '/100'")}, {_head('Verdict', 'status')}, {q(T.THIN)}, '  FIELD RESULTS', {q(T.THIN)}, f.body, f.bad, {q(T.WIDE)}) AS report
FROM ({SCANS_SQL}) s JOIN (SELECT record_id, string_agg({_DETAIL}, chr(10) ORDER BY field_id) AS body,
  {q(T.THIN)} || chr(10) || '  VIOLATIONS' || chr(10) || {q(T.THIN)} || chr(10) ||
  string_agg(CASE WHEN status <> 'PASS' THEN '  • [' || upper(severity) || '] ' || field_label || ' (' || legal_reference || ')' || chr(10) || '    ' || coalesce(reason, '') || chr(10) END, chr(10) ORDER BY field_id) AS bad
  FROM ({_FIELDS}) z GROUP BY record_id) f ON s.scan_id = f.record_id""",
)
def scan_reports(spark, sf_dir):
    scans = order_scans(spark, sf_dir)
    filled = scans.select(
        "scan_id", "created_at", "score", "status", "rule_version", "fields", "violations",
        *[F.coalesce(F.col(c), F.lit(S.DEFAULTS[c])).alias(c) for c in ("product_name", "category", "platform", "source_type")],
    )
    return T.scan_report(filled)


def _work_dir(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/labelwright-{uuid.uuid4().hex}"


@R.add(
    "snk_01_write_scans",
    f"SELECT status, count(*) AS scans, sum(score) AS score_sum, 8 * count(*) AS field_rows FROM ({SCANS_SQL}) s GROUP BY status",
)
def write_scans(spark, sf_dir):
    """Write the three tables to the shared folder and report over what was written."""
    from ..sources.sinks import write_scans as write

    path = _work_dir(spark)
    write(order_scans(spark, sf_dir), path, "orders")
    scans = spark.read.parquet(f"{path}/scans")
    fields = spark.read.parquet(f"{path}/field_results").groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"))
    return scans.join(fields, "scan_id").groupBy("status").agg(
        F.count(F.lit(1)).alias("scans"), F.sum("score").alias("score_sum"), F.sum("n").alias("field_rows")
    )


def _order_stream(spark, sf_dir):
    """Orders arriving as a stream, turned into labels with the static part and supplier tables."""
    schema = C.table(spark, sf_dir, "orders").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    return C.frame(spark, sf_dir, C.ORDER_LABELS, orders=stream)


def _streamed(spark, sf_dir) -> str:
    """Folder of the tables that the continuous scan of the order stream has written."""
    from ..streaming import write_scan_stream

    path = _work_dir(spark)
    write_scan_stream(_order_stream(spark, sf_dir), f"{path}/out", f"{path}/ckpt").awaitTermination()
    return f"{path}/out"


@R.add(
    "str_02_live_trends",
    f"SELECT strftime(created_at, '%Y-%m-%d') AS date, count(*) AS scans, {one_decimal('avg(score)')} AS avg_score FROM ({SCANS_SQL}) s GROUP BY 1",
)
def live_trends(spark, sf_dir):
    """Daily trend of the stream, from the rollups of its micro-batches."""
    return rollups.daily(rollups.read_rollups(spark, _streamed(spark, sf_dir)))


@R.add(
    "str_02_live_platforms",
    f"""SELECT strftime(created_at, '%Y-%m-%d') AS date, platform, count(*) AS count,
  {one_decimal("count(*) FILTER (WHERE status = 'FAIL') / count(*) * 100")} AS fail_rate FROM ({SCANS_SQL}) s GROUP BY 1, 2""",
)
def live_platforms(spark, sf_dir):
    return rollups.daily_platforms(rollups.read_rollups(spark, _streamed(spark, sf_dir)))


@R.add(
    "str_01_03_scan_stream",
    f"SELECT status, count(*) AS scans, sum(score) AS score_sum FROM ({SCANS_SQL}) s GROUP BY status",
)
def scan_stream(spark, sf_dir):
    """Continuous scan into tables, de-duplicated by id, then a report over the written scans."""
    return spark.read.parquet(f"{_streamed(spark, sf_dir)}/scans").groupBy("status").agg(
        F.count(F.lit(1)).alias("scans"), F.sum("score").alias("score_sum")
    )
