"""Rule scan: label text to field verdicts, score, verdict and violations.

The scan is a chain of projections, so a table of any size is scanned without a
shuffle.  Status columns are kept apart from the value and evidence columns:
a report that only needs the verdict does not pay for evidence, because the
optimizer drops the columns nobody reads.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.heads import looks_back, tested
from ..functions.normalize import label_value
from ..functions.text import bind, blank_to_null, first_capture, matches, rx, strip, strip_to_null
from ..rules import RuleField, RuleHistory, RuleSet, default_rules
from ..rules.literals import folded, may_match

# Marker of an online listing, fields printed on the pack only, verdict weights and
# limits, wording of the reasons.
ONLINE_LISTING = r"(?:amazon|flipkart|meesho|myntra|e-commerce|marketplace)\s*(?:\.in|listing|online)"
PACK_ONLY_FIELDS = ("F03", "F04", "F07", "F08")
WEIGHTS = {"PASS": 1.0, "REVIEW": 0.5, "FAIL": 0.0}
PASS_SCORE, PARTIAL_SCORE = 85, 50
NO_ADDRESS_REASON = "Manufacturer name found but complete address not clearly identified."
LISTING_REASON = (
    "{label} not found in the online listing — this field is mandatory on the physical packaging. "
    "Verify compliance on the physical product label. ({ref})"
)
MISSING_REASON = "{label} not found in the provided text. Required by {ref}."
PRODUCT_NAME = r"(?:^|\n)\s*(?:product\s*(?:name)?|brand|item|commodity|generic\s*name)\s*[:\-]\s*(.+)"
DEFAULTS = {
    "product_name": "Unknown",
    "category": "General Packaged Commodities",
    "platform": "Unknown",
    "source_type": "TEXT",
    "scanned_by": "consumer",
}
EVIDENCE_MARGIN = 30

FIELD_COLUMNS = (
    "field_id", "field_label", "legal_reference", "status", "detected_value",
    "normalized_value", "confidence", "evidence", "reason",
)


def infer_product_name(text: Column) -> Column:
    """Product name from a ``Product:``/``Brand:``/… line, NULL if there is none."""
    return blank_to_null(strip(F.regexp_extract(text, rx(PRODUCT_NAME), 1)))


def _pick(field: RuleField, index: Column, build) -> Column:
    """``build(i)`` of the pattern that matched; evaluated for that pattern only."""
    chain = None
    for i in range(len(field.patterns)):
        cond = index == i + 1
        chain = F.when(cond, build(i)) if chain is None else chain.when(cond, build(i))
    return F.lit(None).cast("string") if chain is None else chain


def _evidence(text: Column, length: Column, pattern: str) -> Column:
    """Thirty characters either side of the first match, on one line, between dots; ``length`` is the text's."""
    # the text from the match on tells where it begins; the match is then read off its head
    rest = F.regexp_extract(text, rx(rf"(?:{pattern})(?s:.*)", "im"), 0)
    after = rf"(?:{pattern})(?s:.{{0,{EVIDENCE_MARGIN}}})"

    def around(r: Column) -> Column:
        found = F.regexp_extract(text, rx(after, "im"), 0) if looks_back(pattern) else F.regexp_extract(r, rx(r"\A" + after, "im"), 0)
        return F.concat(bind(length - F.length(r), before), found)

    def before(at: Column) -> Column:
        return F.substring(text, F.greatest(at - EVIDENCE_MARGIN, F.lit(0)) + 1, F.least(at, F.lit(EVIDENCE_MARGIN)))

    return F.concat(F.lit("..."), strip(F.replace(bind(rest, around), F.lit("\n"), F.lit(" "))), F.lit("..."))


def _reason(field: RuleField) -> Column:
    status, value = F.col(f"_s_{field.id}"), F.col(f"_v_{field.id}")
    return (
        F.when((status == "REVIEW") & value.isNotNull(), NO_ADDRESS_REASON)
        .when(status == "REVIEW", LISTING_REASON.format(label=field.label, ref=field.legal_ref))
        .when(status == "FAIL", MISSING_REASON.format(label=field.label, ref=field.legal_ref))
    )


def _field_struct(field: RuleField) -> Column:
    f = field.id
    status, value = F.col(f"_s_{f}"), F.col(f"_v_{f}")
    confidence = (
        F.when(status == "PASS", 0.9)
        .when((status == "REVIEW") & value.isNotNull(), 0.6)
        .when(status == "REVIEW", 0.5)
        .otherwise(1.0)
    )
    return F.struct(
        F.lit(f).alias("field_id"),
        F.lit(field.label).alias("field_label"),
        F.lit(field.legal_ref).alias("legal_reference"),
        status.alias("status"),
        value.alias("detected_value"),
        bind(value, lambda v: label_value(f, v)).alias("normalized_value"),
        confidence.alias("confidence"),
        F.col(f"_e_{f}").alias("evidence"),
        _reason(field).alias("reason"),
    )


def _violation_struct(field: RuleField) -> Column:
    return F.when(
        F.col(f"_s_{field.id}").isin("FAIL", "REVIEW"),
        F.struct(
            F.lit(field.id).alias("field_id"),
            F.lit(field.label).alias("field_label"),
            F.lit(field.legal_ref).alias("legal_reference"),
            F.lit(field.severity).alias("severity"),
            F.coalesce(_reason(field), F.lit("")).alias("reason"),
            F.col(f"_e_{field.id}").alias("evidence"),
        ),
    )


def _matcher(field: RuleField, low: Column):
    worth = [may_match(low, p) for p in field.patterns]
    return lambda text: first_capture(text, [(p, "im", field.value_group(i)) for i, p in enumerate(field.patterns)], worth)


def _found(text: Column, low: Column, pattern: str, flags: str) -> Column:
    """``matches``, run only where the text holds a literal that the pattern needs."""
    worth, hit = may_match(low, pattern), matches(text, tested(pattern), flags)
    return hit if worth is None else F.coalesce(worth, F.lit(False)) & hit


def _witness(field: RuleField, text: Column):
    return lambda k: _pick(field, k, lambda i: _evidence(text, F.col("_length"), field.patterns[i]))


@lru_cache(maxsize=32)
def _scan_columns(rules: RuleSet, text: str) -> list[list[Column]]:
    """The projections of a scan, one list per step; built once per rule set.

    0. the text in the form in which literals are looked for, and its length
    1. which pattern of each field matches first, and its capture; a pattern runs only if the text holds a literal that it needs
    2. the captured value (a blank capture still ends the search: not detected)
    3. status and evidence
    4. score
    5. verdict, nested fields and violations
    """
    t, low = F.col(text), F.col("_low")
    form = [F.col("*"), folded(t).alias("_low"), F.length(t).alias("_length")]
    index = [F.col("*"), _found(t, low, ONLINE_LISTING, "i").alias("_listing")]
    values, judged = [F.col("*")], [F.col("*")]
    for f in rules.fields:
        k, v = F.col(f"_k_{f.id}.k"), F.col(f"_v_{f.id}")
        index.append(bind(t, _matcher(f, low)).alias(f"_k_{f.id}"))
        values.append(strip_to_null(F.col(f"_k_{f.id}.raw")).alias(f"_v_{f.id}"))
        missing = (
            F.when(F.col("_listing"), "REVIEW").otherwise("FAIL") if f.id in PACK_ONLY_FIELDS else F.lit("FAIL")
        )
        if f.id == "F01":
            address = F.lit(False)
            # the shortest pattern first: it tends to cost least, and one that matches is enough
            for guard, p in sorted(f.guarded_addresses(), key=lambda g: len(g[1])):
                hit = _found(t, low, p, "im")
                address = address | (hit if guard is None else _found(t, low, guard, "im") & hit)
            present = F.when(address, "PASS").otherwise("REVIEW")
        else:
            present = F.lit("PASS")
        judged.append(F.when(v.isNotNull(), present).otherwise(missing).alias(f"_s_{f.id}"))
        judged.append(F.when(v.isNotNull(), bind(k, _witness(f, t))).alias(f"_e_{f.id}"))
    earned, high_fails = F.lit(0.0), F.lit(0)
    for f in rules.fields:
        s = F.col(f"_s_{f.id}")
        earned = earned + F.when(s == "PASS", WEIGHTS["PASS"]).when(s == "REVIEW", WEIGHTS["REVIEW"]).otherwise(0.0)
        if f.severity == "high":
            high_fails = high_fails + F.when(s == "FAIL", 1).otherwise(0)
    total = float(len(rules.fields))
    score = F.bround(earned / F.lit(total) * 100, 0).cast("int") if total else F.lit(0)
    verdict = (
        F.when((F.col("score") >= PASS_SCORE) & (F.col("_high_fails") == 0), "PASS")
        .when(F.col("score") >= PARTIAL_SCORE, "PARTIAL")
        .otherwise("FAIL")
    )
    result = [
        F.lit(rules.rule_version).alias("rule_version"),
        F.col("score"),
        verdict.alias("status"),
        F.array(*[_field_struct(f) for f in rules.fields]).alias("fields"),
        F.array_compact(F.array(*[_violation_struct(f) for f in rules.fields])).alias("violations"),
    ]
    return [form, index, values, judged, [F.col("*"), score.alias("score"), high_fails.alias("_high_fails")], result]


def scan_labels(labels: DataFrame, rules: RuleSet | None = None, text: str = "text") -> DataFrame:
    """Scan every row; input columns are kept and joined by

    ``rule_version, score, status, fields array<struct>, violations array<struct>``.
    """
    steps = _scan_columns(rules or default_rules(), text)
    out = labels
    for step in steps[:-1]:
        out = out.select(*step)
    return out.select(*labels.columns, *steps[-1])


def scan_as_of(labels: DataFrame, history: RuleHistory, text: str = "text", time: str = "created_at") -> DataFrame:
    """Scan every row with the rules in force at its time; a row without a time gets the rules in force last.

    Each version is compiled once and scans the rows of its span; spans are ranges of the time column, so stored
    labels are pruned to them.
    """
    at, out = F.col(time), None
    for start, end, rules in history.spans():
        within = F.lit(True)
        if start is not None:
            within = within & (at >= F.lit(start))
        if end is not None:
            within = within & (at < F.lit(end))
        part = scan_labels(labels.filter(within if end is not None else within | at.isNull()), rules, text)
        out = part if out is None else out.unionByName(part)
    return out


def scan_id(*parts: Column) -> Column:
    """Deterministic id, so that scanning the same record again does not add a scan."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def with_scan_id(scans: DataFrame, text: str = "text") -> DataFrame:
    """Add ``scan_id``; ``record_id`` tells records with equal contents apart."""
    if "record_id" not in scans.columns:
        raise ValueError("a scan id needs record_id, the place of the record in its source")
    cols = [c for c in ("record_id", "source_type", "product_name", "category", "platform", text) if c in scans.columns]
    return scans.withColumn("scan_id", scan_id(*[F.col(c) for c in cols]))


def scan_rows(scans: DataFrame, text: str = "text") -> DataFrame:
    """The ``scans`` table: one row per scan with the metadata defaults filled in."""
    have = set(scans.columns)
    meta = [
        (F.coalesce(F.col(c), F.lit(d)) if c in have else F.lit(d)).alias(c) for c, d in DEFAULTS.items()
    ]
    created = F.col("created_at") if "created_at" in have else F.current_timestamp()
    return scans.select(
        "scan_id", *meta, F.col(text).alias("raw_text"), "score", "status", "rule_version",
        created.alias("created_at"),
    )


def _children(scans: DataFrame, column: str) -> DataFrame:
    # The outer form keeps the optimizer from deriving a size filter on the array, which it would
    # push below the scan and so evaluate every rule twice; the rows it adds are removed here.
    extra = ["created_at"] if "created_at" in scans.columns else []
    return scans.select("scan_id", *extra, F.inline_outer(column)).filter(F.col("field_id").isNotNull())


def field_rows(scans: DataFrame) -> DataFrame:
    """The ``field_results`` table: one row per (scan, rule field)."""
    return _children(scans, "fields")


def field_statuses(scans: DataFrame) -> DataFrame:
    """``field_id, status`` of ``field_rows``; nothing else of the fields is read, so that the optimizer drops what they hold beside."""
    pairs = F.arrays_zip(F.col("fields.field_id").alias("field_id"), F.col("fields.status").alias("status"))
    return scans.select(F.inline_outer(pairs).alias("field_id", "status")).filter(F.col("field_id").isNotNull())


def violation_rows(scans: DataFrame) -> DataFrame:
    """The ``violations`` table: the FAIL and REVIEW fields with their severity."""
    return _children(scans, "violations")


def nested_scans(scans: DataFrame, fields: DataFrame, violations: DataFrame) -> DataFrame:
    """Scans with their fields and violations nested again, each list in field order.

    The groups hold at most one row per rule field, so nothing unbounded is collected.
    """

    def nest(children: DataFrame, name: str) -> DataFrame:
        cols = [c for c in children.columns if c not in ("scan_id", "created_at", "field_id")]
        return children.groupBy("scan_id").agg(
            F.array_sort(F.collect_list(F.struct("field_id", *cols))).alias(name)
        )

    out = scans.join(nest(fields, "fields"), "scan_id", "left").join(
        nest(violations, "violations"), "scan_id", "left"
    )
    return out.withColumn("fields", F.coalesce("fields", F.array())).withColumn(
        "violations", F.coalesce("violations", F.array())
    )


def status_counts(scans: DataFrame) -> DataFrame:
    """PASS, FAIL and REVIEW fields inside each scan.

    Only the statuses are read, in one place, so that the optimizer drops what else the fields hold: evidence is
    not computed for a count.
    """

    def count(statuses: Column, status: str) -> Column:
        return F.size(F.filter(statuses, lambda s: s == status)).alias(f"{status.lower()}_fields")

    counts = bind(F.col("fields.status"), lambda s: F.struct(*[count(s, k) for k in ("PASS", "FAIL", "REVIEW")]))
    return scans.select("*", counts.alias("_counts")).select(*scans.columns, "_counts.*")


def batch_result(scans: DataFrame) -> DataFrame:
    """Short per-scan result of a batch."""
    return scans.select("scan_id", "product_name", "score", "status")
