"""Rule scan and analytics as SQL."""

from __future__ import annotations

from ..functions.normalize import CANONICAL_UNITS, MONTHS, UNIT_ALIASES
from ..operators import scan as S
from ..rules import RuleSet, default_rules
from .sqlx import case, extract, has, lookup, nz, one_decimal, q, replace_all, strip


def label_price(e: str) -> str:
    amount = f"try_cast({replace_all(e, r'[^0-9.]', '', '')} AS DOUBLE)"
    return f"CASE WHEN {e} = '' THEN NULL ELSE coalesce('Rs. ' || printf('%.2f', {amount}), {strip(e)}) END"


def label_quantity(e: str) -> str:
    p = r"^([\d,]+(?:\.\d+)?)\s*([a-zA-Z]+)"
    s = strip(e)
    unit = f"lower({extract(s, p, 2)})"
    value = f"try_cast(replace({extract(s, p, 1)}, ',', '') AS DOUBLE)"
    text = f"format('{{:g}}', {value}) || ' ' || {lookup(unit, UNIT_ALIASES, unit)}"
    return f"CASE WHEN {e} = '' THEN NULL ELSE coalesce(CASE WHEN {unit} <> '' THEN {text} END, {s}) END"


def label_date(e: str) -> str:
    s = strip(e)
    named = r"([A-Za-z]{3,9})\.?\s*(\d{4})"
    month = lookup(f"lower(substr({extract(s, named, 1, '')}, 1, 3))", MONTHS)
    my, ym, full = r"(\d{1,2})[/\-](\d{4})", r"(\d{4})[/\-](\d{2})", r"(\d{2})[/\-.](\d{2})[/\-.](\d{4})"
    return (
        f"CASE WHEN {e} = '' THEN NULL ELSE coalesce({month} || '/' || {extract(s, named, 2, '')}, "
        f"CASE WHEN {has(s, my, '')} THEN lpad({extract(s, my, 1, '')}, 2, '0') || '/' || {extract(s, my, 2, '')} END, "
        f"CASE WHEN {has(s, ym, '')} THEN {extract(s, ym, 2, '')} || '/' || {extract(s, ym, 1, '')} END, "
        f"CASE WHEN {has(s, full, '')} THEN {extract(s, full, 2, '')} || '/' || {extract(s, full, 3, '')} END, {s}) END"
    )


def _normal(field_id: str, e: str) -> str:
    if field_id == "F05":
        return label_price(e)
    if field_id == "F02":
        return label_quantity(e)
    if field_id in ("F03", "F04"):
        return label_date(e)
    return f"CASE WHEN {e} <> '' THEN {strip(e)} END"


def field_table(source: str, key: str = "record_id", carry: tuple[str, ...] = (), rules: RuleSet | None = None) -> str:
    """One row per (record, field): ``key, carry…, field_id, …, severity, weight``."""
    rules = rules or default_rules()
    extra = "".join(f", {c}" for c in carry)
    parts = []
    for f in rules.fields:
        hits = [(has("text", p, "im"), str(i + 1)) for i, p in enumerate(f.patterns)]
        value = case([(f"k = {i + 1}", extract("text", p, f.value_group(i), "im")) for i, p in enumerate(f.patterns)])
        before = case(
            [(f"k = {i + 1}", f"length({extract('text', chr(92) + 'A((?s:.*?))(?:' + p + ')', 1, 'im')})") for i, p in enumerate(f.patterns)]
        )
        size = case([(f"k = {i + 1}", f"length({extract('text', p, 0, 'im')})") for i, p in enumerate(f.patterns)])
        if f.id == "F01":
            address = " OR ".join(has("text", p, "im") for p in f.address_patterns)
            present = f"CASE WHEN {address} THEN 'PASS' ELSE 'REVIEW' END"
        else:
            present = "'PASS'"
        missing = (
            f"CASE WHEN {has('text', S.ONLINE_LISTING)} THEN 'REVIEW' ELSE 'FAIL' END"
            if f.id in S.PACK_ONLY_FIELDS
            else "'FAIL'"
        )
        reason = case(
            [
                ("status = 'REVIEW' AND v IS NOT NULL", q(S.NO_ADDRESS_REASON)),
                ("status = 'REVIEW'", q(S.LISTING_REASON.format(label=f.label, ref=f.legal_ref))),
                ("status = 'FAIL'", q(S.MISSING_REASON.format(label=f.label, ref=f.legal_ref))),
            ]
        )
        parts.append(
            f"""SELECT {key}{extra}, '{f.id}' AS field_id, {q(f.label)} AS field_label, {q(f.legal_ref)} AS legal_reference,
  '{f.severity}' AS severity, status, v AS detected_value, {_normal(f.id, 'v')} AS normalized_value,
  CASE WHEN status = 'PASS' THEN 0.9 WHEN status = 'REVIEW' AND v IS NOT NULL THEN 0.6 WHEN status = 'REVIEW' THEN 0.5 ELSE 1.0 END AS confidence,
  CASE WHEN v IS NOT NULL THEN '...' || {strip("replace(substr(text, greatest(b - 30, 0) + 1, b + n + 30 - greatest(b - 30, 0)), chr(10), ' ')")} || '...' END AS evidence,
  {reason} AS reason
FROM (SELECT *, CASE WHEN v IS NOT NULL THEN {present} ELSE {missing} END AS status
      FROM (SELECT *, {nz(strip(value))} AS v, {before} AS b, {size} AS n
            FROM (SELECT *, {case(hits, '0')} AS k FROM ({source}) s0) s1) s2) s3"""
        )
    return "\nUNION ALL\n".join(parts)


def scan_table(source: str, key: str = "record_id", carry: tuple[str, ...] = (), rules: RuleSet | None = None) -> str:
    """One row per record with score and verdict."""
    extra = "".join(f", {c}" for c in carry)
    return f"""SELECT {key}{extra}, CAST(score AS INT) AS score,
  CASE WHEN score >= {S.PASS_SCORE} AND high_fails = 0 THEN 'PASS' WHEN score >= {S.PARTIAL_SCORE} THEN 'PARTIAL' ELSE 'FAIL' END AS status
FROM (SELECT {key}{extra},
  round_even(sum(CASE status WHEN 'PASS' THEN 1.0 WHEN 'REVIEW' THEN 0.5 ELSE 0.0 END) / count(*) * 100, 0) AS score,
  count(*) FILTER (WHERE status = 'FAIL' AND severity = 'high') AS high_fails
  FROM ({field_table(source, key, carry, rules)}) f GROUP BY {key}{extra}) g"""


def violation_table(source: str, key: str = "record_id", carry: tuple[str, ...] = ()) -> str:
    extra = "".join(f", {c}" for c in carry)
    return (
        f"SELECT {key}{extra}, field_id, field_label, legal_reference, severity, coalesce(reason, '') AS reason, evidence "
        f"FROM ({field_table(source, key, carry)}) f WHERE status IN ('FAIL', 'REVIEW')"
    )


def summary(scans: str) -> str:
    return f"""SELECT count(*) AS total_scans, count(*) FILTER (WHERE status = 'PASS') AS pass_count,
  count(*) FILTER (WHERE status = 'FAIL') AS fail_count, count(*) FILTER (WHERE status = 'PARTIAL') AS partial_count,
  {one_decimal("coalesce(avg(score), 0)")} AS avg_score,
  {one_decimal("coalesce(count(*) FILTER (WHERE status = 'PASS') / nullif(count(*), 0) * 100, 0)")} AS compliance_rate
FROM ({scans}) s"""


def canonical_quantity_columns(e: str, prefix: str) -> str:
    from ..functions.normalize import QUANTITY

    value = f"try_cast(replace({extract(e, QUANTITY, 1)}, ',', '') AS DOUBLE)"
    unit = f"CASE WHEN {value} IS NOT NULL THEN lower({extract(e, QUANTITY, 2)}) END"
    factor = lookup(unit, {k: m for k, (_, m) in CANONICAL_UNITS.items()}, "1.0")
    cunit = lookup(unit, {k: u for k, (u, _) in CANONICAL_UNITS.items()}, unit)
    shown = f"format('{{:g}}', {value}) || ' ' || {unit}"
    display = (
        f"CASE WHEN {factor} <> 1.0 THEN {shown} || ' (' || format('{{:g}}', {value} * {factor}) || ' ' || {cunit} || ')' ELSE {shown} END"
    )
    return (
        f"{value} AS {prefix}value, {unit} AS {prefix}unit, CASE WHEN {value} IS NOT NULL THEN {value} * {factor} END AS {prefix}canonical_value, "
        f"CASE WHEN {value} IS NOT NULL THEN {cunit} END AS {prefix}canonical_unit, coalesce({display}, {nz(e)}, 'Not Found') AS {prefix}display, "
        f"{value} IS NOT NULL AS {prefix}found"
    )


def canonical_price_columns(e: str, prefix: str) -> str:
    from ..functions.normalize import BARE_PRICE, TAGGED_PRICE

    number = f"CASE WHEN {has(e, TAGGED_PRICE)} THEN {extract(e, TAGGED_PRICE, 1)} ELSE {extract(e, BARE_PRICE, 1, '')} END"
    value = f"try_cast(replace({number}, ',', '') AS DOUBLE)"
    return (
        f"{value} AS {prefix}value, coalesce('₹' || printf('%.2f', {value}), {nz(e)}, 'Not Found') AS {prefix}display, "
        f"{value} IS NOT NULL AS {prefix}found"
    )


def clean_licence(e: str) -> str:
    kept = replace_all(e, r"[^\dOIlS\s\-]", "", "")
    digits = f"translate({kept}, 'OIl', '011')"
    # no look-around here: doubling the pass covers letters that share a digit
    once = f"regexp_replace({digits}, '([0-9])S([0-9])', '\\15\\2', 'g')"
    twice = f"regexp_replace({once}, '([0-9])S([0-9])', '\\15\\2', 'g')"
    bare = replace_all(twice, r"[\s\-]", "", "")
    return f"CASE WHEN length({bare}) = 14 AND regexp_matches({bare}, '^[1-9]') THEN {bare} END"


def clean_entity_text(e: str) -> str:
    squeezed = replace_all(replace_all(strip(e), r"\s{3,}", "\n", ""), r"[ \t]{2,}", " ", "")
    return strip(squeezed)


__all__ = [n for n in dir() if not n.startswith("_")]
