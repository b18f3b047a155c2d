"""Attributes, normalisers and geography as SQL."""

from __future__ import annotations

import re

from ..functions import entities as E
from ..functions import geo as G
from .scan_sql import clean_entity_text, clean_licence
from .sqlx import case, extract, first_match, has, nz, q, replace_all, strip


def _bounded(p: str) -> str:
    """Split repetitions beyond the 1000 limit."""
    return re.sub(r"\{39,\}\?", "{39,1000}?", p)


def first_attribute(name: str) -> str:
    return nz(clean_entity_text(first_match("text", [(_bounded(p), f) for p, f in E.PATTERNS[name]])))


def licence_number(e: str = "text") -> str:
    return "coalesce(" + ", ".join(clean_licence(extract(e, p, 1, f)) for p, f in E.PATTERNS["fssai"]) + ")"


def party(role: str, e: str = "text") -> str:
    return "coalesce(" + ", ".join(
        nz(clean_entity_text(extract(e, p, 1, f))) for p, f, roles in E.PARTY_PATTERNS if role in roles
    ) + ")"


def infer_country(e: str) -> str:
    pairs = [(f"{e} IS NULL OR length({strip(e)}) < 5", "NULL"), (has(e, G.INDIA_PLACES), "'India'")]
    pairs += [(has(e, p), q(c)) for p, c in G.COUNTRY_PATTERNS]
    pairs.append((has(replace_all(e, r"\d{14}", "", ""), G.PIN_ANY, ""), "'India'"))
    return case(pairs)


def split_company(block: str) -> tuple[str, str]:
    """(company, address) expressions over a column holding a block."""
    lines = f"list_filter(list_transform(string_split({strip(block)}, chr(10)), lambda x: {strip('x')}), lambda x: x <> '')"
    ends = f"list_transform({lines}, lambda x, i: {has('x', E.ADDRESS_WORDS)} OR {has('x', E.COMPANY_WORDS)} OR i > 2)"
    at = f"coalesce(list_position({ends}, true), 0)"
    hit = f"{lines}[{at}]"
    n = (
        f"greatest(CASE WHEN {at} = 0 THEN len({lines}) WHEN {has(hit, E.ADDRESS_WORDS)} THEN {at} - 1 "
        f"WHEN {has(hit, E.COMPANY_WORDS)} THEN {at} ELSE {at} - 1 END, 1)"
    )
    return f"array_to_string({lines}[1:{n}], ' ')", f"array_to_string({lines}[{n} + 1:], chr(10))"


def attributes(source: str, key: str = "id") -> str:
    """One wide row per text."""
    simple = [n for n in E.PATTERNS if n not in ("mrp", "fssai", "country_of_origin")]
    first = ", ".join(
        [f"{first_attribute(n)} AS {n}" for n in simple]
        + [f"replace({first_attribute('mrp')}, ',', '') AS mrp0", f"{licence_number()} AS fssai"]
        + [f"{first_attribute('country_of_origin')} AS declared"]
        + [f"{party(r)} AS {r}0" for r in E.ROLES]
        + [
            f"{nz(strip(extract('text', E.PHONE, 0, '')))} AS consumer_care_phone",
            f"{nz(extract('text', E.EMAIL, 0, ''))} AS consumer_care_email",
            f"{nz(strip(extract('text', E.BRAND, 1)))} AS brand",
            f"{extract('text', E.BARCODE, 1, '')} AS bc",
            f"CASE WHEN {has('text', E.NON_VEG)} THEN 'Non-Vegetarian' WHEN {has('text', E.VEG)} THEN 'Vegetarian' END AS veg_status",
        ]
    )
    own = (
        "manufacturer0 AS manufacturer_raw, importer0 AS importer_raw, "
        "CASE WHEN packer0 IS DISTINCT FROM manufacturer0 THEN packer0 END AS packer_raw, "
        "CASE WHEN marketer0 IS DISTINCT FROM manufacturer0 THEN marketer0 END AS marketer_raw"
    )
    parts = []
    for r in E.ROLES:
        company, address = split_company(f"{r}_raw")
        parts.append(f"CASE WHEN {r}_raw IS NOT NULL THEN {nz(company)} END AS {r}_name")
        if r != "marketer":
            parts.append(f"CASE WHEN {r}_raw IS NOT NULL THEN {nz(address)} END AS {r}_address")
    parties = "concat_ws(' ', manufacturer_raw, manufacturer_address, packer_raw, packer_address, importer_raw, importer_address)"
    return f"""SELECT {key}, {', '.join(f'{r}_raw, {r}_name' for r in E.ROLES)}, manufacturer_address, packer_address, importer_address,
  {', '.join(simple)}, fssai, brand, veg_status, consumer_care_phone, consumer_care_email,
  CASE WHEN try_cast(mrp0 AS DOUBLE) > 0 AND try_cast(mrp0 AS DOUBLE) <= 1000000 THEN mrp0 END AS mrp,
  CASE WHEN length(bc) IN (8, 12, 13) AND bc IS DISTINCT FROM fssai THEN bc END AS barcode_ocr,
  coalesce(declared, inferred) AS country_of_origin,
  CASE WHEN declared IS NULL AND inferred IS NOT NULL THEN true END AS country_inferred_from_address,
  CASE WHEN ingredients IS NOT NULL THEN NOT {has(f"right({strip('ingredients')}, 80)", E.TRUNCATED)} END AS ingredient_complete
FROM (SELECT *, {infer_country(parties)} AS inferred FROM (
  SELECT *, {', '.join(parts)} FROM (SELECT *, {own} FROM (SELECT {key}, {first} FROM ({source}) s0) s1) s2) s3) s4"""


def detect_country(e: str) -> tuple[str, str, str]:
    kw_name = case([(f"contains(lower({e}), {q(k)})", q(n)) for k, n, _ in G.COUNTRY_KEYWORDS])
    kw_conf = case([(f"contains(lower({e}), {q(k)})", str(c)) for k, _, c in G.COUNTRY_KEYWORDS])
    state, pin = nz(extract(e, G.STATE_SIGNAL, 1)), nz(extract(e, G.PIN_SIGNAL, 1, ""))
    phone = has(e, G.PHONE_SIGNAL, "")
    before = f"coalesce({kw_name}, CASE WHEN {state} IS NOT NULL THEN 'India' END)"
    conf0 = f"coalesce({kw_conf}, CASE WHEN {state} IS NOT NULL THEN 88 END)"
    country = f"coalesce({before}, CASE WHEN {pin} IS NOT NULL OR {phone} THEN 'India' END, 'Unknown')"
    confidence = (
        f"CASE WHEN {pin} IS NOT NULL THEN CASE WHEN {before} IS NULL THEN 82 WHEN {before} = 'India' THEN least({conf0} + 5, 98) ELSE {conf0} END "
        f"WHEN {before} IS NOT NULL THEN {conf0} WHEN {phone} THEN 75 ELSE 0 END"
    )
    signals = (
        f"concat_ws('; ', 'Explicit country name: ''' || {kw_name} || '''', 'Indian state detected: ''' || {state} || '''', "
        f"'Indian PIN code: ' || {pin}, CASE WHEN {phone} THEN 'Indian phone number detected' END)"
    )
    return country, confidence, signals


def parsed_addresses(source: str) -> str:
    """Parts of the addresses of ``source`` (id, address)."""
    t = strip(replace_all(f"regexp_replace({strip('address')}, '\\.+$', '')", G.ROLE_PREFIX, ""))
    parts = f"list_filter(list_transform(regexp_split_to_array(t, '[,\\n]+'), lambda p: {strip('p')}), lambda p: p <> '')"
    suffix = f"coalesce(list_position(list_transform(parts, lambda p: {has('p', G.COMPANY_SUFFIX)} AND length(p) > 5), true), 0)"
    return f"""
SELECT id, company, address_line1, address_line2, city, state, pincode, country, full_address,
  CASE WHEN company IS NOT NULL THEN 25 ELSE 0 END + CASE WHEN pincode IS NOT NULL THEN 30 ELSE 0 END
  + CASE WHEN state IS NOT NULL THEN 25 ELSE 0 END + CASE WHEN country IS NOT NULL THEN 10 ELSE 0 END
  + CASE WHEN city IS NOT NULL THEN 10 ELSE 0 END AS confidence
FROM (SELECT *, CASE WHEN length(c0) > 2 THEN c0 END AS city, lines[1] AS address_line1,
        nullif(array_to_string(lines[2:3], ', '), '') AS address_line2
  FROM (SELECT *,
      trim(regexp_replace(list_filter(rest, lambda p: NOT coalesce(contains(lower(p), lower(state)), false)
        AND NOT coalesce(contains(lower(p), lower(country)), false) AND coalesce(contains(p, pincode), false))[1], '\\b([1-9][0-9]{{5}})\\b', '', 'g'), ' -') AS c0,
      list_filter(rest, lambda p: NOT coalesce(lower(p) = lower(state), false) AND NOT coalesce(lower(p) = lower(country), false)) AS lines
    FROM (SELECT *, parts[pos] AS company, list_filter(list_transform(parts, lambda p, i: CASE WHEN i <> pos THEN p END), lambda p: p IS NOT NULL) AS rest,
        coalesce(nullif(regexp_extract(t, {q('(?i)' + G.ADDRESS_COUNTRY)}, 1), ''), CASE WHEN state IS NOT NULL OR pincode IS NOT NULL THEN 'India' END) AS country
      FROM (SELECT *, CASE WHEN {suffix} > 0 THEN {suffix} WHEN regexp_matches(parts[1], '^[A-Z]') AND length(parts[1]) > 4 THEN 1 ELSE 0 END AS pos,
          nullif({extract('t', G.ADDRESS_PIN, 1, '')}, '') AS pincode, nullif({extract('t', G.address_state_pattern(), 1)}, '') AS state
        FROM (SELECT *, {parts} AS parts FROM (SELECT id, nullif({strip('address')}, '') AS full_address, {t} AS t FROM ({source}) a0) a1) a2) a3) a4) a5) a6"""


def classified_origin(manufacturer: str, importer: str, declared: str) -> tuple[str, str]:
    """(classification, notes) by the countries of the parties and the declared one."""
    m, i, d = (f"coalesce({c}, '')" for c in (manufacturer, importer, declared))
    cases = [
        (f"lower({m}) = 'india' AND {i} = ''", "'Domestic Product'", "'Manufactured in India'"),
        (f"lower({i}) = 'india' AND {m} <> '' AND lower({m}) <> 'india'", "'Imported Product'", f"'Manufactured in ' || {m} || ', Imported to India'"),
        (f"{d} <> '' AND lower({d}) <> 'india'", "'Imported Product'", f"'Declared Country of Origin: ' || {d}"),
        (f"lower({m}) = 'india' OR lower({d}) = 'india'", "'Domestic Product'", "'Manufactured/Originated in India'"),
    ]
    return case([(c, k) for c, k, _ in cases], "'Unknown'"), case([(c, n) for c, _, n in cases], "'Insufficient data to classify'")


def missing_fields(e: str, present: dict[str, str] | None = None, address: str = "''") -> str:
    """List of the critical fields that neither the text nor the conditions ``present`` supply."""
    present, parts = present or {}, []
    for n, p in E.CRITICAL_PATTERNS.items():
        found = has(e, p)
        if n in present:
            found = f"({found} OR {present[n]})"
        if n == "country":
            found = f"({found} OR {infer_country(address)} IS NOT NULL OR {infer_country(e)} IS NOT NULL)"
        parts.append(f"CASE WHEN NOT {found} THEN '{n}' END")
    return "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"
