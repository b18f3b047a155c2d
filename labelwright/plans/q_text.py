"""Normaliser, attribute and geography queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import entities as E
from ..functions import geo as G
from ..functions import normalize as N
from ..functions.text import bind
from ..operators import attributes as A
from ..oracle import scan_sql as O
from ..oracle import text_sql as X
from ..oracle.sqlx import case, extract, has, nz, q, replace_all, strip
from . import corpus as C
from .registry import Registry

R = Registry()
RAW = C.sql(C.RAW_VALUES)
ANY = C.sql(C.ANY_TEXT)
ADDR = C.sql(C.ADDRESSES)


def raw(spark, sf_dir):
    return C.frame(spark, sf_dir, C.RAW_VALUES)


def any_text(spark, sf_dir):
    return C.frame(spark, sf_dir, C.ANY_TEXT)


def addresses(spark, sf_dir):
    return C.frame(spark, sf_dir, C.ADDRESSES)


@R.add(
    "nrm_01_04_label_values",
    f"SELECT id, {O.label_price('price_a')} AS price, {O.label_quantity('qty_a')} AS quantity, {O.label_date('date_a')} AS date FROM ({RAW}) r",
)
def label_values(spark, sf_dir):
    return raw(spark, sf_dir).select(
        "id",
        N.label_value("F05", F.col("price_a")).alias("price"),
        N.label_value("F02", F.col("qty_a")).alias("quantity"),
        N.label_value("F03", F.col("date_a")).alias("date"),
    )


@R.add("nrm_05_canonical_quantity", f"SELECT id, {O.canonical_quantity_columns('qty_a', 'a_')} FROM ({RAW}) r")
def canonical_quantity(spark, sf_dir):
    d = raw(spark, sf_dir).select("id", N.canonical_quantity(F.col("qty_a")).alias("a"))
    return d.select("id", *[F.col(f"a.{c}").alias(f"a_{c}") for c in ("value", "unit", "canonical_value", "canonical_unit", "display", "found")])


@R.add("nrm_06_canonical_price", f"SELECT id, {O.canonical_price_columns('price_a', 'a_')} FROM ({RAW}) r")
def canonical_price(spark, sf_dir):
    d = raw(spark, sf_dir).select("id", N.canonical_price(F.col("price_a")).alias("a"))
    return d.select("id", *[F.col(f"a.{c}").alias(f"a_{c}") for c in ("value", "display", "found")])


@R.add("nrm_07_clean_text", f"SELECT id, {O.clean_entity_text('text')} AS cleaned FROM ({ANY}) r")
def clean_text(spark, sf_dir):
    return any_text(spark, sf_dir).select("id", N.clean_entity_text(F.col("text")).alias("cleaned"))


@R.add("nrm_08_clean_licence", f"SELECT id, {O.clean_licence('licence_a')} AS licence FROM ({RAW}) r")
def clean_licence(spark, sf_dir):
    return raw(spark, sf_dir).select("id", N.clean_licence(F.col("licence_a")).alias("licence"))


@R.add("nrm_09_collapse_newlines", "SELECT doc_id, regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g') AS text FROM documents")
def collapse_newlines(spark, sf_dir):
    return C.table(spark, sf_dir, "documents").select("doc_id", N.collapse_newlines(F.col("text")).alias("text"))


_BOTH = f"SELECT id, {O.canonical_quantity_columns('qty_a', 'a_')}, {O.canonical_quantity_columns('qty_b', 'b_')} FROM ({RAW}) r"


@R.add(
    "nrm_11_compare_quantities",
    f"""SELECT id, CASE WHEN NOT a_found AND NOT b_found THEN 'NOT_FOUND' WHEN NOT a_found THEN 'PACKAGE_ONLY'
  WHEN NOT b_found THEN 'WEBSITE_ONLY' WHEN a_canonical_unit <> b_canonical_unit THEN 'UNIT_MISMATCH'
  WHEN abs(a_canonical_value - b_canonical_value) / greatest(a_canonical_value, 1) * 100 < 1 THEN 'MATCH' ELSE 'MISMATCH' END AS status,
  CASE WHEN NOT a_found AND b_found THEN 'WEBSITE_ONLY' WHEN a_found AND NOT b_found THEN 'PACKAGE_ONLY' END AS compat_one_sided
FROM ({_BOTH}) c""",
)
def compare_quantities(spark, sf_dir):
    d = raw(spark, sf_dir).select(
        "id", N.canonical_quantity(F.col("qty_a")).alias("a"), N.canonical_quantity(F.col("qty_b")).alias("b")
    )
    compat = N.compare_quantities(F.col("a"), F.col("b"), compat=True)
    return d.select(
        "id",
        N.compare_quantities(F.col("a"), F.col("b")).alias("status"),
        F.when(F.col("a.found") != F.col("b.found"), compat).alias("compat_one_sided"),
    )


_PRICES = f"SELECT id, {O.canonical_price_columns('price_a', 'a_')}, {O.canonical_price_columns('price_b', 'b_')} FROM ({RAW}) r"


@R.add(
    "nrm_12_compare_prices",
    f"""SELECT id, CASE WHEN NOT a_found AND NOT b_found THEN 'NOT_FOUND' WHEN NOT a_found THEN 'PACKAGE_ONLY'
  WHEN NOT b_found THEN 'WEBSITE_ONLY' WHEN abs(a_value - b_value) < 0.5 THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM ({_PRICES}) c""",
)
def compare_prices(spark, sf_dir):
    d = raw(spark, sf_dir).select(
        "id", N.canonical_price(F.col("price_a")).alias("a"), N.canonical_price(F.col("price_b")).alias("b")
    )
    return d.select("id", N.compare_prices(F.col("a"), F.col("b")).alias("status"))


@R.add(
    "jn_05_unit_lookup",
    f"SELECT a_unit AS unit, a_canonical_unit AS canonical_unit, count(*) AS n, sum(a_canonical_value) AS total FROM ({_BOTH}) c WHERE a_found GROUP BY 1, 2",
)
def unit_lookup(spark, sf_dir):
    """Quantities joined to the unit table (a fixed table of some thirty rows, hence the broadcast)."""
    units = spark.createDataFrame(
        [(u, c, m) for u, (c, m) in N.CANONICAL_UNITS.items()], "unit string, canonical_unit string, factor double"
    )
    parsed = raw(spark, sf_dir).select(
        F.lower(F.regexp_extract("qty_a", E.rx(N.QUANTITY), 2)).alias("unit"),
        F.regexp_replace(F.regexp_extract("qty_a", E.rx(N.QUANTITY), 1), ",", "").try_cast("double").alias("value"),
    ).filter(F.col("value").isNotNull())
    return (
        parsed.join(F.broadcast(units), "unit", "left")
        .groupBy("unit", F.coalesce("canonical_unit", "unit").alias("canonical_unit"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value") * F.coalesce("factor", F.lit(1.0))).alias("total"))
    )


@R.add("ent_00_attributes", X.attributes(ANY))
def attributes(spark, sf_dir):
    return A.extract_attributes(any_text(spark, sf_dir), keep=("id",))


@R.add(
    "ent_01_02_parties",
    f"SELECT id, {', '.join(f'{r}_raw, {r}_name' for r in E.ROLES)}, manufacturer_address FROM ({X.attributes(C.sql(C.PRODUCT_LABELS), 'product_id').replace('SELECT product_id,', 'SELECT product_id AS id,', 1)}) z",
)
def parties(spark, sf_dir):
    labels = C.frame(spark, sf_dir, C.PRODUCT_LABELS).select(F.col("product_id").alias("id"), "text")
    d = A.extract_attributes(labels, keep=("id",))
    return d.select("id", *[f"{r}_{k}" for r in E.ROLES for k in ("raw", "name")], "manufacturer_address")


@R.add(
    "ent_15_fallback_fields",
    "SELECT id, " + ", ".join(
        f"{nz(strip(extract('text', p, g, f)))} AS {n}" for n, (p, g, f) in E.FALLBACK_FIELDS.items()
    ) + f" FROM ({ANY}) z",
)
def fallback_fields(spark, sf_dir):
    d = any_text(spark, sf_dir).select(
        "id", *[E.fallback_field(F.col("text"), n).alias(n) for n in E.FALLBACK_FIELDS]
    )
    return d.select("id", *[F.when(F.col(n) != "", F.col(n)).alias(n) for n in E.FALLBACK_FIELDS])


@R.add(
    "ent_16_declarations",
    "SELECT id, array_to_string(list_filter([" + ", ".join(strip(extract("text", p, 0)) for p in E.DECLARATIONS)
    + f"], lambda h: h <> ''), ' | ') AS declarations FROM ({ANY}) z",
)
def declarations(spark, sf_dir):
    return any_text(spark, sf_dir).select(
        "id", F.array_join(E.declarations(F.col("text")), " | ").alias("declarations")
    )


@R.add(
    "ent_17_agg_07_missing_fields",
    f"""SELECT id, array_to_string(m, ',') AS missing, CAST(floor(100 * (6 - len(m)) / 6) AS INT) AS coverage,
  array_to_string(list_filter(['manufacturer', 'net_qty', 'mrp', 'fssai', 'country', 'ingredients'], lambda x: NOT list_contains(m, x)), ',') AS found
FROM (SELECT id, {X.missing_fields('text')} AS m FROM ({ANY}) z) y""",
)
def missing_fields(spark, sf_dir):
    d = any_text(spark, sf_dir).select("id", A.missing_critical(F.col("text")).alias("m"))
    return d.select(
        "id",
        F.array_join("m", ",").alias("missing"),
        A.coverage_percent(F.col("m")).alias("coverage"),
        F.array_join(A.found_critical(F.col("m")), ",").alias("found"),
    )


@R.add("geo_01_infer_country", f"SELECT id, {X.infer_country('address')} AS country FROM ({ADDR}) z")
def infer_country(spark, sf_dir):
    return addresses(spark, sf_dir).select("id", bind(F.col("address"), G.infer_country).alias("country"))


_COUNTRY, _CONF, _SIGNALS = X.detect_country("address")


@R.add(
    "geo_02_detect_country",
    f"SELECT id, {_COUNTRY} AS country, {_CONF} AS confidence, {_SIGNALS} AS signals FROM ({ADDR}) z",
)
def detect_country(spark, sf_dir):
    d = addresses(spark, sf_dir).select("id", bind(F.col("address"), G.detect_country).alias("c"))
    return d.select("id", "c.country", "c.confidence", F.array_join("c.signals", "; ").alias("signals"))


@R.add("geo_03_parse_address", X.parsed_addresses(ADDR))
def parse_address(spark, sf_dir):
    d = addresses(spark, sf_dir).select("id", bind(F.col("address"), G.parse_address).alias("a"))
    return d.select("id", "a.*")


_CLASS, _NOTES = X.classified_origin("mfr_country", "imp_country", "declared_country")


@R.add("geo_04_classify_origin", f"SELECT id, {_CLASS} AS classification, {_NOTES} AS notes FROM ({ADDR}) z")
def classify_origin(spark, sf_dir):
    d = addresses(spark, sf_dir).select(
        "id", G.classify_origin(F.col("mfr_country"), F.col("imp_country"), F.col("declared_country")).alias("o")
    )
    return d.select("id", "o.*")
