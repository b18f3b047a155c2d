"""Scan, violation and analytics queries over the order labels."""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import matched_index
from ..operators import analytics as A
from ..operators import rollups
from ..operators import scan as S
from ..operators.joins import as_of_join
from ..oracle import scan_sql as O
from ..oracle.sqlx import extract, has, nz, one_decimal, q, strip
from ..rules import RuleHistory, RuleSet, default_rules
from ..session import ensure_checkpoint_dir
from ..sources.labels import read_label_csv, tagged_label_csv, write_outcomes
from ..sources.sinks import write_scans
from . import corpus as C
from .registry import Registry

R = Registry()

ORDERS = C.sql(C.ORDER_LABELS)
DOCS = "SELECT CAST(doc_id AS STRING) AS record_id, text FROM documents"
#: Parts of the labels for each core.
PARTS_A_CORE = 8
CARRY = ("product_name", "category", "platform", "source_type", "created_at")
# "now" for the trend report: the day after the last record
NOW = "(SELECT max(o_orderdate) + INTERVAL 1 DAY FROM orders)"


def order_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order labels, dealt into several parts a core.

    The joins leave parts sized for reading, often one more than there are cores; a scan takes far longer a row, and
    the cores then wait for the last part.
    """
    labels = C.frame(spark, sf_dir, C.ORDER_LABELS)
    return labels.repartition(PARTS_A_CORE * spark.sparkContext.defaultParallelism, "record_id")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("record_id"), "text")


def order_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = S.scan_labels(order_labels(spark, sf_dir)).withColumn("scan_id", F.col("record_id"))
    return scans


_STORED: dict[tuple, str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the scan tables that SNK-01 writes for the order labels; they are written once per session and state of the input."""
    return spark.read.parquet(f"{_stored_path(spark, sf_dir)}/{name}")


def _stored_path(spark: SparkSession, sf_dir: str) -> str:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(sf_dir)
    state = files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)"))).first()
    key = (spark.sparkContext.applicationId, sf_dir, *state)
    if key not in _STORED:
        path = f"{ensure_checkpoint_dir(spark)}/labelwright-scans-{uuid.uuid4().hex}"
        write_scans(order_scans(spark, sf_dir), path, "orders", track_ids=False)
        _STORED[key] = path
    return _STORED[key]


def scan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "scans").drop("batch")


def rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.read_rollups(spark, _stored_path(spark, sf_dir))


SCANS_SQL = f"""SELECT record_id AS scan_id, coalesce(product_name, 'Unknown') AS product_name,
  coalesce(category, 'General Packaged Commodities') AS category, coalesce(platform, 'Unknown') AS platform,
  source_type, created_at, score, status FROM ({O.scan_table(ORDERS, "record_id", CARRY)}) z"""
VIOLATIONS_SQL = f"SELECT record_id AS scan_id, * EXCLUDE (record_id) FROM ({O.violation_table(ORDERS, 'record_id', CARRY)}) z"


@R.add(
    "src_01_label_csv",
    f"""SELECT {strip('text')} AS text, coalesce(product_name, '') AS product_name, coalesce(category, '') AS category, coalesce(platform, '') AS platform, 'CSV' AS source_type
FROM ({ORDERS}) z WHERE {strip('text')} <> ''""",
)
def label_csv(spark, sf_dir):
    """The order labels written as CSV to the shared folder and read back as a batch upload."""
    path = f"{ensure_checkpoint_dir(spark)}/labelwright-csv-{uuid.uuid4().hex}"
    labels = order_labels(spark, sf_dir).select("text", "product_name", "category", "platform")
    labels.write.option("header", True).option("quoteAll", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)
    return read_label_csv(spark, path).drop("record_id")


_NOTES = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '  ' WHEN 1 THEN substr(trim(text), 1, 7) WHEN 2 THEN NULL ELSE text END AS text,
  CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END AS platform FROM {documents}"""


@R.add(
    "src_01_label_outcomes",
    f"""SELECT reason, count(*) AS rows, count(DISTINCT platform) AS platforms FROM (SELECT CASE WHEN coalesce({strip('text')}, '') = '' THEN 'blank text' WHEN length({strip('text')}) < 10 THEN 'text too short' ELSE 'accepted' END AS reason,
  coalesce(platform, '') AS platform FROM ({C.sql(_NOTES)}) n) z GROUP BY reason""",
)
def label_outcomes(spark, sf_dir):
    """Notes as a batch upload, accepted or rejected with a reason, written in one pass and counted from what was written."""
    path = f"{ensure_checkpoint_dir(spark)}/labelwright-outcomes-{uuid.uuid4().hex}"
    notes = C.frame(spark, sf_dir, _NOTES).select("text", "platform")
    notes.write.option("header", True).option("quoteAll", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(f"{path}/in")
    counts = write_outcomes(tagged_label_csv(spark, f"{path}/in"), f"{path}/out")
    written = spark.read.parquet(f"{path}/out")
    if sum(counts.values()) != written.count():
        raise RuntimeError("rows observed and rows written differ")
    return written.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("platform").alias("platforms"))


@R.add("cmp_08_scan_labels", f"SELECT record_id, 'PCR-2011-v2' AS rule_version, score, status FROM ({O.scan_table(ORDERS)}) z")
def scan_labels(spark, sf_dir):
    return S.scan_labels(order_labels(spark, sf_dir)).select("record_id", "rule_version", "score", "status")


@R.add("cmp_08_scan_documents", f"SELECT record_id, score, status FROM ({O.scan_table(DOCS)}) z")
def scan_documents(spark, sf_dir):
    return S.scan_labels(documents(spark, sf_dir)).select("record_id", "score", "status")


@R.add(
    "cmp_01_04_field_results",
    f"""SELECT record_id AS scan_id, field_id, field_label, legal_reference, status, detected_value, normalized_value,
  CAST(confidence AS DOUBLE) AS confidence, evidence, reason FROM ({O.field_table(ORDERS)}) z""",
)
def field_results(spark, sf_dir):
    return S.field_rows(order_scans(spark, sf_dir)).drop("created_at")


@R.add(
    "cmp_02_document_evidence",
    f"SELECT record_id, field_id, status, detected_value, evidence FROM ({O.field_table(DOCS)}) z WHERE detected_value IS NOT NULL",
)
def document_evidence(spark, sf_dir):
    return (
        S.scan_labels(documents(spark, sf_dir))
        .select("record_id", F.inline_outer("fields"))
        .filter(F.col("detected_value").isNotNull())
        .select("record_id", "field_id", "status", "detected_value", "evidence")
    )


@R.add(
    "cmp_05_06_score_histogram",
    f"SELECT score, status, count(*) AS scans FROM ({O.scan_table(ORDERS)}) z GROUP BY score, status",
)
def score_histogram(spark, sf_dir):
    return S.scan_labels(order_labels(spark, sf_dir)).groupBy("score", "status").agg(F.count(F.lit(1)).alias("scans"))


@R.add(
    "cmp_07_violations",
    f"SELECT scan_id, field_id, field_label, legal_reference, severity, reason, evidence FROM ({VIOLATIONS_SQL}) z",
)
def violations(spark, sf_dir):
    return S.violation_rows(order_scans(spark, sf_dir)).drop("created_at")


@R.add(
    "cmp_09_product_name",
    f"""SELECT record_id, coalesce({nz('product_name')},
  {nz(strip(extract('text', S.PRODUCT_NAME, 1)))}, 'Unknown') AS product_name FROM ({ORDERS}) z""",
)
def product_name(spark, sf_dir):
    from ..sources.labels import label_records

    return label_records(order_labels(spark, sf_dir)).select("record_id", "product_name")


@R.add(
    "flt_01_short_texts",
    f"SELECT doc_id, length({strip('text')}) AS n FROM documents WHERE length({strip('text')}) >= 10",
)
def short_texts(spark, sf_dir):
    from ..sources.labels import long_enough

    d = C.table(spark, sf_dir, "documents")
    return d.filter(long_enough(F.col("text"))).select("doc_id", F.length(S.strip(F.col("text"))).alias("n"))


@R.add(
    "flt_06_listing_marker",
    f"SELECT record_id, {has('text', S.ONLINE_LISTING)} AS is_listing FROM ({ORDERS}) z",
)
def listing_marker(spark, sf_dir):
    return order_labels(spark, sf_dir).select(
        "record_id", S.matches(F.col("text"), S.ONLINE_LISTING).alias("is_listing")
    )


_RULES = " UNION ALL ".join(
    f"SELECT '{f.id}' AS field_id, {q(f.severity)} AS severity, {q(p)} AS pattern, {i} AS ord"
    for f in default_rules().fields
    for i, p in enumerate(f.patterns, 1)
)


@R.add(
    "src_06_rule_hits",
    f"""SELECT field_id, ord, count(*) AS hits FROM (
  SELECT record_id, field_id, min(ord) AS ord FROM (
  {" UNION ALL ".join(
      f"SELECT record_id, '{f.id}' AS field_id, {i} AS ord FROM ({ORDERS}) z WHERE {has('text', p, 'im')}"
      for f in default_rules().fields for i, p in enumerate(f.patterns, 1))}
  ) a GROUP BY record_id, field_id) b GROUP BY field_id, ord""",
)
def rule_hits(spark, sf_dir):
    """How often each pattern of the rule table decides its field."""
    rules = default_rules()
    t = F.col("text")
    hits = order_labels(spark, sf_dir).select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(f.id).alias("field_id"),
                        matched_index(t, [(p, "im") for p in f.patterns]).alias("ord"),
                    )
                    for f in rules.fields
                ]
            )
        ).alias("h")
    )
    return (
        hits.select("h.*").filter("ord > 0").groupBy("field_id", "ord").agg(F.count(F.lit(1)).alias("hits"))
    )


def _older_rules() -> list[tuple[str, RuleSet]]:
    """Two earlier versions of the rules: without country and licence, then with fewer spellings of the price."""
    fields = default_rules().fields
    first = RuleSet("PCR-2011-v0", tuple(f for f in fields if f.id not in ("F07", "F08")))
    second = RuleSet("PCR-2011-v1", tuple(replace(f, patterns=f.patterns[:1]) if f.id == "F05" else replace(f, severity="medium") if f.id == "F07" else f for f in fields))
    return [("1992-01-01 00:00:00", first), ("1994-03-15 00:00:00", second), ("1996-08-01 12:00:00", default_rules())]


_IN_FORCE = "SELECT * FROM (VALUES " + ", ".join(f"(TIMESTAMP '{at}', {q(r.rule_version)})" for at, r in _older_rules()) + ") v(valid_from, rule_version)"


def _history() -> RuleHistory:
    return RuleHistory.of(*[(datetime.fromisoformat(at), r) for at, r in _older_rules()])


@R.add(
    "src_06_scans_as_of",
    " UNION ALL ".join(
        f"SELECT record_id, {q(r.rule_version)} AS rule_version, score, status FROM ({O.scan_table(f'SELECT * FROM ({ORDERS}) o WHERE ' + where, rules=r)}) z"
        for (at, r), where in zip(
            _older_rules(),
            ("created_at < TIMESTAMP '1994-03-15'", "created_at >= TIMESTAMP '1994-03-15' AND created_at < TIMESTAMP '1996-08-01 12:00:00'", "created_at >= TIMESTAMP '1996-08-01 12:00:00'"),
            strict=True,
        )
    ),
)
def scans_as_of(spark, sf_dir):
    """Every label scanned with the rules of its day."""
    return S.scan_as_of(order_labels(spark, sf_dir), _history()).select("record_id", "rule_version", "score", "status")


@R.add("src_06_rules_in_force", f"SELECT record_id, created_at, rule_version FROM ({ORDERS}) o ASOF JOIN ({_IN_FORCE}) v ON o.created_at >= v.valid_from")
def rules_in_force(spark, sf_dir):
    """The rule version of every record, by an as-of join with the table of versions."""
    records = order_labels(spark, sf_dir).select("record_id", "created_at")
    versions = _history().to_frame(spark).select("rule_version", "valid_from")
    return as_of_join(records, versions, "created_at", "valid_from").select("record_id", "created_at", "rule_version")


@R.add("agg_01_summary", O.summary(SCANS_SQL))
def agg_summary(spark, sf_dir):
    return rollups.summary(rolled(spark, sf_dir))


@R.add(
    "agg_02_categories",
    f"SELECT category, count(*) AS count, {one_decimal('avg(score)')} AS avg_score FROM ({SCANS_SQL}) s GROUP BY category ORDER BY count DESC, category",
)
def agg_categories(spark, sf_dir):
    return rollups.by_category(rolled(spark, sf_dir))


_PLATFORMS = f"""SELECT platform, count(*) AS count,
  {one_decimal("count(*) FILTER (WHERE status = 'FAIL') / count(*) * 100")} AS fail_rate
FROM ({SCANS_SQL}) s GROUP BY platform ORDER BY count DESC, platform"""


@R.add("agg_03_platforms", _PLATFORMS)
def agg_platforms(spark, sf_dir):
    return rollups.by_platform(rolled(spark, sf_dir))


@R.add("srt_03_top_platforms", _PLATFORMS + " LIMIT 8")
def top_platforms(spark, sf_dir):
    return rollups.by_platform(rolled(spark, sf_dir), top=8)


def _now(spark, sf_dir):
    """One aggregated timestamp; the trend filter then compares with a constant."""
    return F.lit(C.table(spark, sf_dir, "orders").agg(F.max("o_orderdate") + F.expr("INTERVAL 1 DAY")).first()[0])


@R.add(
    "agg_04_trends",
    f"""SELECT strftime(created_at, '%Y-%m-%d') AS date, count(*) AS scans, {one_decimal('avg(score)')} AS avg_score
FROM ({SCANS_SQL}) s WHERE created_at >= {NOW} - INTERVAL 365 DAY GROUP BY 1 ORDER BY 1""",
)
def agg_trends(spark, sf_dir):
    return rollups.trends(rolled(spark, sf_dir), scan_table(spark, sf_dir), _now(spark, sf_dir), days=365)


@R.add(
    "flt_05_recent_scans",
    f"SELECT scan_id, score FROM ({SCANS_SQL}) s WHERE created_at >= {NOW} - INTERVAL 30 DAY",
)
def recent_scans(spark, sf_dir):
    since = _now(spark, sf_dir) - F.expr("INTERVAL 30 DAYS")
    return A.recent(scan_table(spark, sf_dir), since).select("scan_id", "score")


def _joined(spark, sf_dir, severity=None, platform=None):
    violations = stored(spark, sf_dir, "violations").drop("batch")
    return A.violations_with_scans(violations, scan_table(spark, sf_dir).drop("scan_date", "scan_month"), severity, platform)


@R.add(
    "jn_01_violations_with_scans",
    f"""SELECT scan_id, coalesce(product_name, 'Unknown') AS product_name, coalesce(platform, 'Unknown') AS platform, field_id, severity, reason
FROM ({VIOLATIONS_SQL}) v""",
)
def violations_join(spark, sf_dir):
    return _joined(spark, sf_dir).select("scan_id", "product_name", "platform", "field_id", "severity", "reason")


@R.add(
    "flt_03_04_violation_filter",
    f"""SELECT scan_id, coalesce(platform, 'Unknown') AS platform, field_id, severity FROM ({VIOLATIONS_SQL}) v
WHERE severity = 'high' AND coalesce(platform, 'Unknown') ILIKE '%ama_on%'""",
)
def violation_filter(spark, sf_dir):
    return _joined(spark, sf_dir, "HIGH", "ama_on").select("scan_id", "platform", "field_id", "severity")


@R.add("agg_05_violation_total", f"SELECT count(*) AS total FROM ({VIOLATIONS_SQL}) v WHERE severity = 'medium'")
def violation_total(spark, sf_dir):
    return A.violation_total(_joined(spark, sf_dir, "medium"))


@R.add(
    "srt_01_violation_page",
    f"""SELECT scan_id, coalesce(product_name, 'Unknown') AS product_name, coalesce(platform, 'Unknown') AS platform,
  field_label, legal_reference, severity, reason, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at
FROM ({VIOLATIONS_SQL}) v ORDER BY v.created_at DESC, scan_id, field_id LIMIT 50 OFFSET 100""",
)
def violation_page(spark, sf_dir):
    page = A.violation_page(_joined(spark, sf_dir), skip=100, limit=50)
    return page.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@R.add(
    "srt_01_seek_page",
    f"""SELECT scan_id, field_id, coalesce(product_name, 'Unknown') AS product_name, coalesce(platform, 'Unknown') AS platform, severity, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at
FROM ({VIOLATIONS_SQL}) v WHERE severity = 'high' ORDER BY v.created_at DESC, scan_id, field_id LIMIT 50 OFFSET 150""",
)
def seek_page(spark, sf_dir):
    """The page after the 150th violation, found from the last row before it."""
    tables = stored(spark, sf_dir, "violations").drop("batch"), scan_table(spark, sf_dir)
    before = A.violation_page_after(*tables, limit=150, severity="high").collect()
    last = before[-1]
    page = A.violation_page_after(*tables, (last.created_at, last.scan_id, last.field_id), 50, severity="high")
    return page.select("scan_id", "field_id", "product_name", "platform", "severity", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@R.add(
    "agg_06_field_counts",
    f"""SELECT record_id, count(*) FILTER (WHERE status = 'PASS') AS pass_fields, count(*) FILTER (WHERE status = 'FAIL') AS fail_fields,
  count(*) FILTER (WHERE status = 'REVIEW') AS review_fields FROM ({O.field_table(ORDERS)}) z GROUP BY record_id""",
)
def field_counts(spark, sf_dir):
    return S.status_counts(S.scan_labels(order_labels(spark, sf_dir))).select(
        "record_id", "pass_fields", "fail_fields", "review_fields"
    )


@R.add(
    "jn_03_severity_of_results",
    f"SELECT severity, status, count(*) AS n FROM ({O.field_table(ORDERS)}) z GROUP BY severity, status",
)
def severity_of_results(spark, sf_dir):
    """Field results joined to the rule table (39 rows, so the broadcast is bounded by the rule document)."""
    rules = (
        default_rules().to_frame(spark).select("field_id", "severity").distinct().coalesce(1)
    )
    fields = S.field_statuses(order_scans(spark, sf_dir))
    return (
        fields.join(F.broadcast(rules), "field_id", "left")
        .groupBy(F.coalesce("severity", F.lit("medium")).alias("severity"), "status")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@R.add(
    "jn_02_snk_03_nested_scans",
    f"""SELECT scan_id, count(*) AS n_fields, string_agg(field_id || '=' || status, ' ' ORDER BY field_id) AS fields,
  coalesce(string_agg(CASE WHEN status <> 'PASS' THEN field_id || '/' || severity END, ' ' ORDER BY field_id), '') AS violations
FROM (SELECT record_id AS scan_id, * FROM ({O.field_table(ORDERS)}) y) z GROUP BY scan_id""",
)
def nested(spark, sf_dir):
    full = S.nested_scans(
        scan_table(spark, sf_dir).select("scan_id"),
        stored(spark, sf_dir, "field_results").select("scan_id", "field_id", "status"),
        stored(spark, sf_dir, "violations").select("scan_id", "field_id", "severity"),
    )
    return full.select(
        "scan_id",
        F.size("fields").alias("n_fields"),
        F.array_join(F.transform("fields", lambda f: F.concat(f["field_id"], F.lit("="), f["status"])), " ").alias("fields"),
        F.array_join(
            F.transform("violations", lambda f: F.concat(f["field_id"], F.lit("/"), f["severity"])), " "
        ).alias("violations"),
    )


@R.add("snk_04_batch_result", f"SELECT scan_id, product_name, score, status FROM ({SCANS_SQL}) s")
def batch_result(spark, sf_dir):
    return S.batch_result(scan_table(spark, sf_dir))

