"""Attribute extraction: one wide row of typed attributes per label, no shuffle."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import entities as E
from ..functions import geo
from ..functions.text import bind, blank_to_null, matches, rx, strip
from ..rules.literals import folded

STRING_ATTRIBUTES = (
    "manufacturer_name", "manufacturer_address", "manufacturer_raw",
    "packer_name", "packer_address", "packer_raw",
    "importer_name", "importer_address", "importer_raw",
    "marketer_name", "marketer_raw",
    "net_quantity", "mrp", "fssai", "mfg_date", "expiry_date", "batch_no", "country_of_origin",
    "ingredients", "allergen_info", "storage_instructions",
    "consumer_care_raw", "consumer_care_phone", "consumer_care_email",
    "barcode_ocr", "brand", "veg_status",
)
FLAG_ATTRIBUTES = ("country_inferred_from_address", "ingredient_complete")
SIMPLE = (
    "net_quantity", "mfg_date", "expiry_date", "batch_no", "country_of_origin",
    "ingredients", "allergen_info", "storage_instructions", "consumer_care_raw",
)


def _simple(name: str):
    return lambda x: E.first_attribute(x, name, F.col("_low"))


def _party(i: int):
    return lambda x: E.party_block(x, i, F.col("_low"))


@lru_cache(maxsize=16)
def _columns(text: str) -> list[list[Column]]:
    t = F.col(text)
    form = [F.col("*"), folded(t).alias("_low")]
    found = [F.col("*")]
    found += [bind(t, _party(i)).alias(f"_p{i}") for i in range(len(E.PARTY_PATTERNS))]
    found += [bind(t, _simple(n)).alias(f"_{n}") for n in SIMPLE]
    found += [
        F.regexp_replace(bind(t, _simple("mrp")), ",", "").alias("_mrp"),
        bind(t, lambda x: E.licence_number(x, F.col("_low"))).alias("fssai"),
        strip(F.regexp_extract(t, rx(E.PHONE, ""), 0)).alias("_phone"),
        F.regexp_extract(t, rx(E.EMAIL, ""), 0).alias("_email"),
        F.regexp_extract(t, rx(E.BARCODE, ""), 1).alias("_barcode"),
        strip(F.regexp_extract(t, rx(E.BRAND), 1)).alias("_brand"),
        F.when(matches(t, E.NON_VEG), "Non-Vegetarian").when(matches(t, E.VEG), "Vegetarian").alias("veg_status"),
    ]

    roles = [F.col("*")]
    for role in E.ROLES:
        blocks = [
            blank_to_null(F.col(f"_p{i}")) for i, (_, _, r) in enumerate(E.PARTY_PATTERNS) if role in r
        ]
        roles.append(F.coalesce(*blocks).alias(f"_{role}"))

    # a packer or marketer that repeats the manufacturer is not a party of its own
    manufacturer = F.col("_manufacturer")
    own = [F.col("*"), manufacturer.alias("manufacturer_raw"), F.col("_importer").alias("importer_raw")]
    for role in ("packer", "marketer"):
        block = F.col(f"_{role}")
        own.append(F.when(~block.eqNullSafe(manufacturer), block).alias(f"{role}_raw"))
    split = [F.col("*")] + [
        F.when(F.col(f"{r}_raw").isNotNull(), E.split_company(F.col(f"{r}_raw"))).alias(f"_{r}_split") for r in E.ROLES
    ]

    final: list[Column] = [F.col("*")]
    for role in E.ROLES:
        parts = F.col(f"_{role}_split")
        final.append(blank_to_null(parts["company"]).alias(f"{role}_name"))
        if role != "marketer":
            final.append(blank_to_null(parts["address"]).alias(f"{role}_address"))
    for name in SIMPLE:
        if name != "country_of_origin":
            final.append(blank_to_null(F.col(f"_{name}")).alias(name))
    price = F.col("_mrp").try_cast("double")
    final += [
        F.when((price > 0) & (price <= 1000000), F.col("_mrp")).alias("mrp"),
        blank_to_null(F.col("_phone")).alias("consumer_care_phone"),
        blank_to_null(F.col("_email")).alias("consumer_care_email"),
        blank_to_null(F.col("_brand")).alias("brand"),
        F.when(
            F.length("_barcode").isin(8, 12, 13) & ~F.col("_barcode").eqNullSafe(F.col("fssai")), F.col("_barcode")
        ).alias("barcode_ocr"),
        blank_to_null(F.col("_country_of_origin")).alias("_declared"),
        F.when(F.col("_ingredients") != "", E.ingredients_complete(F.col("_ingredients"))).alias("ingredient_complete"),
    ]

    parties = F.concat_ws(
        " ", *[F.col(f"{r}_{k}") for r in ("manufacturer", "packer", "importer") for k in ("raw", "address")]
    )
    inferred = [
        F.col("*"),
        F.when(F.col("_declared").isNull(), bind(parties, geo.infer_country)).alias("_inferred"),
    ]
    out = [F.coalesce("_declared", "_inferred").alias("country_of_origin")]
    out.append(F.when(F.col("_inferred").isNotNull(), F.lit(True)).alias("country_inferred_from_address"))
    return [form, found, roles, own, split, final, inferred, out]


def extract_attributes(df: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Append the attribute columns; an attribute that is absent is NULL.

    ``keep`` lists the input columns to carry (default: all).
    """
    steps = _columns(text)
    carry = list(df.columns if keep is None else keep)
    out = df
    for step in steps[:-1]:
        out = out.select(*step)
    done = {"country_of_origin": steps[-1][0], "country_inferred_from_address": steps[-1][1]}
    return out.select(*carry, *[done.get(n, F.col(n)) for n in STRING_ATTRIBUTES + FLAG_ATTRIBUTES])


def missing_critical(text: Column, present: dict[str, Column] | None = None, address: Column | None = None) -> Column:
    """Names of the critical fields that neither the text nor the given columns supply."""
    present = present or {}
    address = F.lit("") if address is None else address

    def build(t: Column) -> Column:
        names = []
        for name, pattern in E.CRITICAL_PATTERNS.items():
            found = matches(t, pattern)
            if name in present:
                found = found | F.coalesce(present[name], F.lit(False))
            if name == "country":
                found = found | geo.infer_country(address).isNotNull() | geo.infer_country(t).isNotNull()
            names.append(F.when(~found, F.lit(name)))
        return F.array_compact(F.array(*names))

    return bind(text, build)


def coverage_percent(missing: Column) -> Column:
    """Whole percent of the critical fields found."""
    total = len(E.CRITICAL_PATTERNS)
    return F.floor(100 * (F.lit(total) - F.size(missing)) / total).cast("int")


def found_critical(missing: Column) -> Column:
    return F.array_except(F.array(*[F.lit(n) for n in E.CRITICAL_PATTERNS]), missing)
