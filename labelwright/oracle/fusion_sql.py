"""Product fusion as SQL, one step over the columns of the step before."""

from __future__ import annotations

from ..functions import entities as E
from ..operators import fusion as M
from ..operators import compare as K
from ..operators import reports as D
from ..operators.attributes import FLAG_ATTRIBUTES, STRING_ATTRIBUTES
from ..operators.marketplaces import RECORD_FIELDS
from . import page_sql as P
from . import scan_sql as X
from . import text_sql as T
from .sqlx import case, extract, first_nonblank, has, nz, q, strip

NAMES = STRING_ATTRIBUTES + FLAG_ATTRIBUTES
ROLES = M.ENTITY_ROLES
NL = "chr(10)"


def _quantity(e: str, prefix: str) -> str:
    return X.canonical_quantity_columns(e, prefix)


def _steps(web: str, pack: str, codes: str) -> dict[str, str]:
    adapter = f"concat_ws({NL}, source, {', '.join(RECORD_FIELDS)}, compliance_text, array_to_string(row_values, {NL}), array_to_string(feature_bullets, {NL}))"
    steps = {
        "rec": f"SELECT *, string_split(bullets, '|') AS feature_bullets, list_filter([row_count, row_weight, row_other], lambda v: v IS NOT NULL) AS row_values FROM ({web}) w",
        "site": f"SELECT *, {adapter} AS adapter_text0, concat_ws({NL}, {adapter}, page_text, {', '.join(f's_{f}' for f in M.STRUCTURED_STRINGS)}) AS corpus FROM rec",
        "pack": pack,
        "codes": codes,
        "aw": T.attributes("SELECT page_id AS product_id, corpus AS text FROM site", "product_id"),
        "ap": T.attributes("SELECT product_id, text FROM pack", "product_id"),
    }
    own = ", ".join([f"w.{f} AS w_{f}" for f in RECORD_FIELDS] + [f"s_{f}" for f in M.STRUCTURED_STRINGS])
    both = ", ".join(f"coalesce(ap.{n}, aw.{n}) AS e_{n}" for n in NAMES)
    steps["met"] = f"""SELECT coalesce(w.page_id, p.product_id) AS product_id, w.url AS w_url, w.source AS w_source, w.display_name AS w_display_name, w.row_count, w.row_weight, w.feature_bullets, {own}, coalesce(adapter_text0, '') AS adapter_text,
  coalesce(p.text, '') AS ocr, p.text AS ocr_text, {both}, c.barcode, c.barcode_type, c.qr_code
FROM site w FULL JOIN pack p ON p.product_id = w.page_id LEFT JOIN aw ON aw.product_id = w.page_id LEFT JOIN ap ON ap.product_id = p.product_id
LEFT JOIN codes c ON c.product_id = coalesce(w.page_id, p.product_id)"""
    found = [f"{strip(extract(t, p, g, f))} AS {side}_{n}" for n, (p, g, f) in E.FALLBACK_FIELDS.items() for side, t in (("fw", "adapter_text"), ("fo", "ocr"))]
    for r in ROLES:
        composed = nz(f"concat_ws({NL}, e_{r}_name, e_{r}_address)")
        found += [
            f"{first_nonblank(f'e_{r}_raw', f'w_{r}_raw', composed)} AS {r}_text", f"{first_nonblank(f'e_{r}_name')} AS {r}_own", f"{first_nonblank(f'e_{r}_address')} AS {r}_at",
            f"CASE WHEN coalesce(e_{r}_name, e_{r}_address, e_{r}_raw) IS NOT NULL THEN 'ocr' WHEN w_{r}_raw IS NOT NULL THEN 'webpage' ELSE 'none' END AS {r}_source",
        ]
    text = f"concat_ws({NL}, nullif(adapter_text, ''), nullif(ocr, ''))"
    found.append(f"list_filter([{', '.join(strip(extract(text, p, 0)) for p in E.DECLARATIONS)}], lambda h: h <> '') AS declarations")
    found.append(f"{nz(extract('ocr', K.PACKAGE_MRP, 1))} AS package_mrp")
    steps["found"] = f"SELECT *, {', '.join(found)} FROM met"
    for r in ROLES:
        steps[f"a_{r}"] = T.parsed_addresses(f"SELECT product_id AS id, {r}_text AS address FROM found")
    parties = []
    for r in ROLES:
        country, sure, _ = T.detect_country(f"coalesce({r}_text, {r}_at)")
        have = f"coalesce({r}_text, {r}_at) IS NOT NULL"
        place = f"trim(coalesce(a_{r}.state, '') || ' - ' || coalesce(a_{r}.pincode, ''), ' -')"
        lines = nz(f"concat_ws({NL}, a_{r}.address_line1, a_{r}.address_line2, a_{r}.city, {nz(place)}, a_{r}.country)")
        parties += [
            f"coalesce({r}_own, a_{r}.company) AS {r}_name", f"coalesce({r}_at, CASE WHEN {r}_text IS NOT NULL THEN {lines} END) AS {r}_structured",
            f"CASE WHEN {have} THEN {country} END AS {r}_country", f"CASE WHEN {have} THEN {sure} ELSE 0 END AS {r}_sure",
        ]
    parties += [
        f"{first_nonblank('e_country_of_origin', 'w_country_of_origin', 'fo_country_of_origin', 'fw_country_of_origin')} AS declared",
        f"{first_nonblank('row_count', 'row_weight', 'w_net_quantity')} AS website_qty", f"{first_nonblank('e_net_quantity')} AS package_qty",
        f"{first_nonblank('w_mrp', 's_price', 'e_mrp')} AS mrp_raw",
    ]
    joins = " ".join(f"LEFT JOIN a_{r} ON a_{r}.id = f.product_id" for r in ROLES)
    steps["known"] = f"SELECT f.*, {', '.join(parties)} FROM found f {joins}"
    country, sure, _ = T.detect_country("declared")
    from_maker = "manufacturer_country IS NOT NULL AND manufacturer_country <> 'Unknown'"
    steps["model0"] = f"""SELECT *, {first_nonblank('w_product_name', 's_name', 's_og_title')} AS name, {first_nonblank('e_brand', 'w_brand', 'fw_brand', 's_brand')} AS brand,
  {first_nonblank('w_description', 's_og_description')} AS description, coalesce(w_source, 'Unknown') AS platform, {first_nonblank('w_seller', 's_seller')} AS seller,
  CASE WHEN {from_maker} THEN manufacturer_country WHEN declared IS NOT NULL THEN {country} END AS detected,
  CAST(CASE WHEN {from_maker} THEN manufacturer_sure WHEN declared IS NOT NULL THEN {sure} ELSE 0 END AS INT) AS detected_sure, coalesce(package_qty, website_qty) AS qty,
  {first_nonblank('e_mfg_date', 'w_mfg_date', 'fo_mfg_date', 'fw_mfg_date')} AS mfg_date, {first_nonblank('e_expiry_date', 'w_best_before', 'fo_best_before', 'fw_best_before')} AS expiry_date,
  {first_nonblank('e_consumer_care_raw')} AS care_raw, {first_nonblank('e_consumer_care_phone', 'w_consumer_care_phone', 'fw_consumer_care_phone')} AS care_phone,
  {first_nonblank('e_consumer_care_email', 'fw_consumer_care_email')} AS care_email, {first_nonblank('e_fssai', 'w_fssai', 'fo_fssai', 'fw_fssai')} AS fssai,
  {first_nonblank('barcode', 'e_barcode_ocr')} AS code, {first_nonblank('e_ingredients', 'w_ingredients')} AS ingredients, {first_nonblank('e_allergen_info', 'w_allergen_info')} AS allergen_info,
  {first_nonblank('e_storage_instructions', 'w_storage_instructions')} AS storage_instructions, {first_nonblank('e_batch_no')} AS batch_no FROM known"""
    kind, _ = T.classified_origin("manufacturer_country", "importer_country", "declared")
    steps["model"] = f"SELECT *, {_quantity('qty', 'n_')}, {X.canonical_price_columns('mrp_raw', 'm_')}, {kind} AS classification FROM model0"
    return steps


def model(web: str, pack: str, codes: str, last: str, recursive: str = "") -> str:
    """``last``, a query over the fused products ``model``."""
    steps = ",\n".join(f"{n} AS MATERIALIZED ({body})" for n, body in _steps(web, pack, codes).items())
    return f"WITH {recursive}{steps}\n{last}"


def _line(label: str, e: str) -> str:
    return f"CASE WHEN {e} <> '' THEN '{label}' || {e} END"


def compliance() -> dict[str, str]:
    """Columns of the compliance text step over ``model``: prepared ones, then the results."""
    maker, packer, importer = "coalesce(manufacturer_name, manufacturer_text, w_manufacturer_raw)", "coalesce(packer_name, packer_text, w_packer_raw)", "coalesce(importer_name, importer_text)"
    places = "concat_ws(' ', manufacturer_text, packer_text, importer_text, w_manufacturer_raw, w_packer_raw)"
    return {
        "maker": maker, "packer": packer, "importer": importer, "country": f"coalesce(declared, detected, w_country_of_origin, {T.infer_country(places)})",
        "kept": f"list_filter(list_transform(coalesce(feature_bullets, []), lambda b: {strip('b')}), lambda b: regexp_matches(lower(b), {q(M.BULLET_WORDS)}))",
        "pack_lines": f"list_filter(list_transform(string_split(ocr, {NL}), lambda s: {strip('s')}), lambda s: length(s) >= 9 AND trim(s, '=-_*#') <> '' AND NOT contains(s, 'Not Detected') AND s <> 'INFORMATION')",
    }


def compliance_step() -> str:
    """SELECT of the compliance text, coverage, category and missing fields over ``model``."""
    prepared = ", ".join(f"{e} AS x_{n}" for n, e in compliance().items())
    shown = "coalesce(x_maker, x_packer, x_importer)"
    care = "coalesce(care_raw, care_phone, care_email, w_consumer_care_phone)"
    lines = [
        _line("Manufactured by: ", "x_maker"), f"CASE WHEN x_packer IS DISTINCT FROM x_maker THEN {_line('Packed by: ', 'x_packer')} END", _line("Imported by: ", "x_importer"),
        nz(f"array_to_string(x_kept, {NL})"), _line("Net Quantity: ", "coalesce(package_qty, website_qty)"), _line("MRP: Rs. ", "coalesce(mrp_raw, w_mrp, w_price_block)"),
        _line("Mfg. Date: ", "mfg_date"), _line("Best Before: ", "expiry_date"), _line("Best Before: ", "w_best_before"), _line("Consumer Care: ", "care_raw"),
        _line("Consumer Care Helpline: ", "care_phone"), _line("Consumer Care Email: ", "care_email"), _line("Consumer Care: ", "w_consumer_care_phone"),
        _line("Country of Origin: ", "x_country"), _line("FSSAI Licence No. ", "coalesce(fssai, w_fssai)"), _line("INGREDIENTS: ", "ingredients"), _line("Barcode: ", "code"),
        nz(f"array_to_string(x_pack_lines, {NL})"),
    ]
    mandatory = [shown, "coalesce(package_qty, website_qty)", "mfg_date", "coalesce(expiry_date, w_best_before)", "coalesce(CASE WHEN mrp_raw IS NOT NULL THEN m_display END, mrp_raw, w_mrp)", care, "x_country", "coalesce(fssai, w_fssai)"]
    have = " + ".join(f"CASE WHEN {strip(m)} <> '' THEN 1 ELSE 0 END" for m in mandatory)
    coverage = f"CAST(floor(({have}) * 100.0 / {len(mandatory)} + 0.5) AS INT)"
    words = "concat_ws(' ', name, brand, ingredients, description)"
    present = {
        "manufacturer": "coalesce(w_manufacturer_raw, w_packer_raw) IS NOT NULL", "mrp": "coalesce(w_mrp, w_price_block) IS NOT NULL", "fssai": "w_fssai IS NOT NULL",
        "country": "w_country_of_origin IS NOT NULL",
    }
    text = f"concat_ws({NL}, nullif(ocr, ''), adapter_text)"
    category = P.category(words).replace("lower(url)", "lower(coalesce(w_url, ''))")
    return f"""SELECT *, {category} AS category, array_to_string({T.missing_fields(text, present, "concat_ws(' ', w_manufacturer_raw, w_packer_raw)")}, ',') AS missing FROM (
  SELECT *, concat_ws({NL}, {', '.join(lines)}) AS compliance_text, {coverage} AS lm_coverage FROM (SELECT *, {prepared} FROM model) m1) m2"""


def critical() -> tuple[str, str]:
    """(found, missing) lists of the seven reported fields over ``model``."""
    values = {
        "Manufacturer": "coalesce(manufacturer_name, manufacturer_text)", "Net Quantity": "coalesce(package_qty, website_qty)",
        "MRP": "coalesce(CASE WHEN mrp_raw IS NOT NULL THEN m_display END, mrp_raw)", "Country": "coalesce(declared, detected)", "FSSAI": "fssai", "Expiry Date": "expiry_date", "Mfg Date": "mfg_date",
    }
    ok = {n: f"coalesce({strip(e)} <> '' AND lower({strip(e)}) NOT IN ({', '.join(map(q, M.ABSENT))}), false)" for n, e in values.items()}
    of = lambda want: "list_filter([" + ", ".join(f"CASE WHEN {want} {c} THEN {q(n)} END" for n, c in ok.items()) + "], lambda v: v IS NOT NULL)"
    return of(""), of("NOT")


def compared() -> str:
    """Comparison rows over ``model``."""
    two = "printf('%.2f', abs(a_value - b_value))"
    number = lambda e: f"CASE WHEN {e} = floor({e}) AND abs({e}) < 1e15 THEN CAST(CAST({e} AS BIGINT) AS VARCHAR) || '.0' ELSE CAST({e} AS VARCHAR) END"
    quantity = f"SELECT product_id, website_qty AS w, package_qty AS p, {_quantity('website_qty', 'a_')}, {_quantity('package_qty', 'b_')} FROM model WHERE website_qty IS NOT NULL OR package_qty IS NOT NULL"
    price = f"SELECT product_id, mrp_raw AS w, package_mrp AS p, {X.canonical_price_columns('mrp_raw', 'a_')}, {X.canonical_price_columns('package_mrp', 'b_')} FROM model WHERE mrp_raw IS NOT NULL OR package_mrp IS NOT NULL"
    status = lambda match, extra="": f"CASE WHEN NOT a_found AND NOT b_found THEN 'NOT_FOUND' WHEN NOT a_found THEN 'PACKAGE_ONLY' WHEN NOT b_found THEN 'WEBSITE_ONLY' {extra} WHEN {match} THEN 'MATCH' ELSE 'MISMATCH' END"
    maker = "coalesce(manufacturer_name, manufacturer_text)"
    return f"""SELECT product_id, 'Net Quantity' AS field, coalesce(w, 'Not Found') AS website_value, coalesce(p, 'Not Found') AS package_value, status,
  coalesce(CASE status WHEN 'MATCH' THEN 'Both normalized to ' || {number('a_canonical_value')} || ' ' || a_canonical_unit WHEN 'MISMATCH' THEN 'Website: ' || a_display || ' vs Package: ' || b_display
    WHEN 'WEBSITE_ONLY' THEN 'Only website value found: ' || a_display WHEN 'PACKAGE_ONLY' THEN 'Only package value found: ' || b_display END, '') AS notes
FROM (SELECT *, {status("abs(a_canonical_value - b_canonical_value) / greatest(a_canonical_value, 1) * 100 < 1", "WHEN a_canonical_unit <> b_canonical_unit THEN 'UNIT_MISMATCH'")} AS status FROM ({quantity}) x) y
UNION ALL SELECT product_id, 'MRP', CASE WHEN w IS NULL THEN 'Not Found' ELSE a_display END, CASE WHEN p IS NULL THEN 'Not Found' ELSE b_display END, status,
  CASE status WHEN 'MATCH' THEN 'MRP matches between website and package' WHEN 'MISMATCH' THEN 'Price difference: ₹' || {two} || ' — REVIEW REQUIRED'
    WHEN 'WEBSITE_ONLY' THEN 'MRP found only on website listing' WHEN 'PACKAGE_ONLY' THEN 'MRP found only on package/OCR' ELSE '' END
FROM (SELECT *, {status('abs(a_value - b_value) < 0.5')} AS status FROM ({price}) x) y
UNION ALL SELECT product_id, 'Country of Origin', coalesce(declared, 'Not Found'), coalesce(detected, 'Not Found'),
  {case([("declared IS NULL", "'PACKAGE_ONLY'"), ("detected IS NULL", "'WEBSITE_ONLY'"), ("lower(declared) = lower(detected)", "'MATCH'")], "'REVIEW'")},
  {case([("declared IS NULL", "'Country of Origin only found via address detection'"), ("detected IS NULL", "'Country declared on page, not confirmed from OCR'"), ("lower(declared) = lower(detected)", "'Declared and detected country agree'")], "'Declared: ' || declared || ', Detected: ' || detected")}
FROM model WHERE declared IS NOT NULL OR detected IS NOT NULL
UNION ALL SELECT product_id, 'Brand', brand, {q(K.NOT_VERIFIED)}, 'WEBSITE_ONLY', 'Brand confirmed from product listing' FROM model WHERE brand IS NOT NULL
UNION ALL SELECT product_id, 'Manufacturer', CASE WHEN manufacturer_source = 'webpage' THEN {maker} ELSE 'Not Found on website' END, CASE WHEN manufacturer_source = 'ocr' THEN {maker} ELSE {q(K.NOT_VERIFIED)} END,
  CASE WHEN manufacturer_source = 'webpage' THEN 'WEBSITE_ONLY' ELSE 'PACKAGE_ONLY' END, 'Source: ' || manufacturer_source FROM model WHERE {maker} IS NOT NULL"""


def _section(title: str) -> str:
    return q(f"\n{D.SECTION}\n{title}\n{D.SECTION}\n")


def _field(label: str, e: str) -> str:
    return f"{q(label + ':' + chr(10))} || coalesce({nz(strip(e))}, {q(D.ABSENT)}) || {NL}"


def _optional(label: str, e: str) -> str:
    return f"CASE WHEN {strip(e)} <> '' THEN {q(label + ':' + chr(10))} || {strip(e)} || {NL} END"


def _tagged(label: str, source: str, e: str) -> str:
    tag = "CASE " + source + " " + " ".join(f"WHEN {q(k)} THEN {q(t)}" for k, t in D.SOURCE_TAGS.items()) + " ELSE '' END"
    return f"{q(label)} || {tag} || ':' || {NL} || {e} || {NL}"


def _party(title: str, r: str, shown: str, country: bool) -> str:
    label, name, address = title.title(), f"coalesce({r}_name, {r}_text)", f"coalesce({r}_structured, {r}_text)"
    parts = [_section(f"{title} INFORMATION"), _tagged(label, f"{r}_source", name), f"CASE WHEN {strip(address)} <> {strip(name)} THEN {q(label + ' Address:' + chr(10))} || {address} || {NL} END"]
    if country:
        parts.append(_optional(f"{label} Country", f"{r}_country"))
    return f"CASE WHEN {shown} THEN concat_ws({NL}, {', '.join(parts)}) END"


def report_query(figures: str) -> str:
    """product_id and report over ``model``; ``figures`` is a query (product_id, found_n, downloaded, processed, confidence) of the images."""
    held, lacked = critical()
    name, address = "coalesce(manufacturer_name, manufacturer_text)", "coalesce(manufacturer_structured, manufacturer_text)"
    known = "coalesce(manufacturer_country <> 'Unknown', false)"
    seen = "coalesce(detected <> 'Unknown', false)"
    packer = "coalesce(packer_name, packer_text)"
    display, percent = "coalesce(w_display_name, 'E-Commerce')", "CAST(CAST(round(confidence * 100) AS INT) AS VARCHAR) || '%'"
    status = "CASE status " + " ".join(f"WHEN {q(k)} THEN {q(t)}" for k, t in D.STATUS_LABELS.items()) + " ELSE status END"
    line = (
        f"concat_ws({NL}, field || ':' || {NL} || '  Website:  ' || website_value || {NL} || '  Package:  ' || package_value || {NL} || '  Status:   ' || {status}, "
        f"CASE WHEN notes <> '' THEN '  Note:     ' || notes END, '')"
    )
    order = "CASE field " + " ".join(f"WHEN {q(f)} THEN {i}" for i, f in enumerate(("Net Quantity", "MRP", "Country of Origin", "Brand", "Manufacturer"))) + " END"
    text = lambda s: q(s)
    parts = [
        _section("PRODUCT INFORMATION"), _field("Product Name", "name"), _field("Brand", "brand"), _optional("SKU", "s_sku"), _optional("Vegetarian / Non-Vegetarian", "e_veg_status"), _optional("Description", "description"),
        _section("E-COMMERCE INFORMATION"), _field("Platform", "w_display_name"), _optional("Seller", "seller"), _field("MRP", "coalesce(CASE WHEN m_found THEN m_display END, mrp_raw)"), _optional("Listed Quantity", "website_qty"),
        _section("MANUFACTURER INFORMATION"), f"coalesce({_tagged('Manufacturer', 'manufacturer_source', name)}, {text(f'Manufacturer:{chr(10)}{D.ABSENT}{chr(10)}')})",
        f"CASE WHEN {strip(address)} <> {strip(name)} THEN {text('Manufacturer Address:' + chr(10))} || {address} || {NL} END",
        f"{text('Manufacturer Country:' + chr(10))} || CASE WHEN {known} THEN manufacturer_country ELSE {q(D.ABSENT)} END || {NL}",
        f"CASE WHEN {known} AND manufacturer_sure > 0 THEN {text('Country Confidence:' + chr(10))} || manufacturer_sure || {text('% (from address analysis)' + chr(10))} END",
        _party("PACKER", "packer", f"{packer} IS NOT NULL AND {strip(packer)} IS DISTINCT FROM {strip(name)}", False), _party("IMPORTER", "importer", "coalesce(importer_name, importer_text) IS NOT NULL", True),
        _section("COUNTRY OF ORIGIN"), _field("Declared Country of Origin", "declared"),
        f"CASE WHEN {seen} THEN {text('Detected Country:' + chr(10))} || detected || CASE WHEN declared IS NULL THEN {text(' (from address analysis)' + chr(10))} ELSE {text(' (confirmed)' + chr(10))} END END",
        f"CASE WHEN {seen} AND detected_sure > 0 THEN {text('Detection Confidence:' + chr(10))} || detected_sure || {text('%' + chr(10))} END", _optional("Product Classification", "classification"),
        _section("PACKAGE INFORMATION"),
        f"CASE WHEN package_qty IS NOT NULL THEN {text('Net Weight / Quantity [Package]:' + chr(10))} || package_qty || {NL} WHEN website_qty IS NOT NULL THEN {text('Net Weight / Quantity [Website]:' + chr(10))} || website_qty || {NL} ELSE {text(f'Net Weight / Quantity:{chr(10)}{D.ABSENT}{chr(10)}')} END",
        f"CASE WHEN qty IS NOT NULL AND n_found THEN {_optional('Normalized Quantity', 'n_display')} END",
        _section("REGULATORY INFORMATION"), _field("FSSAI Licence Number", "fssai"),
        f"CASE WHEN code IS NOT NULL THEN 'Barcode' || coalesce(' (' || barcode_type || ')', '') || ':' || {NL} || code || {NL} ELSE {text(f'Barcode:{chr(10)}{D.ABSENT}{chr(10)}')} END",
        _optional("QR Code", "qr_code"), _optional("Batch / Lot Number", "batch_no"), f"CASE WHEN len(declarations) > 0 THEN {text('Legal Declarations:' + chr(10))} || array_to_string(declarations, {NL}) || {NL} END",
        _section("INGREDIENTS"),
        f"coalesce(ingredients || {NL}, {text(D.ABSENT + chr(10) + 'Note: Ingredient declaration not found in any accessible product image.' + chr(10) + 'If the product has a physical packaging label, upload it in the Label Image tab.' + chr(10))})",
        f"CASE WHEN ingredients IS NOT NULL THEN CASE e_ingredient_complete WHEN true THEN {text('Completeness: COMPLETE' + chr(10))} WHEN false THEN {text('Completeness: POSSIBLE TRUNCATION — the list may continue on another panel or image. Upload packaging photos for full extraction.' + chr(10))} END END",
        f"CASE WHEN allergen_info IS NOT NULL THEN {_section('ALLERGEN INFORMATION')} || {NL} || allergen_info || {NL} END", f"CASE WHEN storage_instructions IS NOT NULL THEN {_section('STORAGE INSTRUCTIONS')} || {NL} || storage_instructions || {NL} END",
        _section("DATES"), _field("Manufacturing Date", "mfg_date"), text(f"Packing Date:\n{D.ABSENT}\n"), _field("Expiry / Best Before", "expiry_date"),
        _section("CONSUMER CARE"), _optional("Consumer Care", "care_raw"), _optional("Phone", "care_phone"), _optional("Email", "care_email"),
        f"CASE WHEN coalesce(care_raw, care_phone, care_email) IS NULL THEN {text(f'Consumer Care:{chr(10)}{D.ABSENT}{chr(10)}')} END",
        f"{_section('WEBSITE ↔ PACKAGE COMPARISON')} || {NL} || compared",
        f"concat_ws({NL}, {_section('IMAGE ANALYSIS')}, 'Images Found: ' || found_n || {NL} || 'Images Downloaded: ' || downloaded || '/' || processed || {NL} || 'OCR Characters Extracted: ' || length(ocr) || {NL} || 'Average OCR Confidence: ' || {percent} || {NL})",
        f"CASE WHEN length(ocr) > 0 THEN {_section('OCR EXTRACTED TEXT (Packaging Images)')} || {NL} || ocr || {NL} END",
        _section("DATA SOURCE"), f"{text('Webpage Data:' + chr(10))} || {display} || {text(' product listing' + chr(10))}",
        f"CASE WHEN length(ocr) > 0 THEN {text('Packaging Data:' + chr(10))} || downloaded || {text(' product image(s) downloaded and OCR analysed' + chr(10))} ELSE {text('Packaging Data:' + chr(10) + 'Not available — use the Label Image tab to upload packaging photos for full OCR analysis' + chr(10))} END",
        text("Note:\nAI/OCR extraction is an assistance mechanism. Manual verification required before making any legal compliance determination.\n"),
        _section("EXTRACTION COMPLETENESS"), f"'Critical Fields: ' || len(held) || '/' || 7 || ' (' || CAST(floor(100 * len(held) / 7) AS INT) || {text('%)' + chr(10))}",
        f"'OCR Images Analysed: ' || downloaded || {NL} || 'OCR Characters Extracted: ' || format('{{:,}}', length(ocr)) || {NL} || 'Average OCR Confidence: ' || {percent} || {NL}",
        f"CASE WHEN len(held) > 0 THEN 'Found:   ' || array_to_string(held, ' | ') || {NL} END", f"CASE WHEN len(lacked) > 0 THEN 'Missing: ' || array_to_string(lacked, ' | ') || {NL} END",
        f"CASE WHEN len(lacked) > 0 AND code IS NOT NULL THEN 'Barcode: ' || code || {text('  (Barcode found — additional data may be available)' + chr(10))} END",
        f"CASE WHEN CAST(floor(100 * len(held) / 7) AS INT) < 60 THEN {text('Note: Critical field coverage is below 60%. Upload packaging photos in the Label Image tab for complete extraction.' + chr(10))} END",
        f"'Source: ' || {display} || ' e-commerce listing (online marketplace)'",
    ]
    return f"""SELECT product_id, concat_ws({NL}, {', '.join(parts)}) AS report FROM (SELECT *, {held} AS held, {lacked} AS lacked FROM model) m JOIN ({figures}) i USING (product_id)
LEFT JOIN (SELECT product_id, string_agg({line}, {NL} ORDER BY {order}) AS compared FROM ({compared()}) x GROUP BY product_id) c USING (product_id)"""
