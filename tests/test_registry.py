"""A sample of the registered queries against the checking database, and the contract of the entry file."""

from __future__ import annotations

import importlib
import os

import duckdb
import pytest

from labelwright.plans import corpus as C

SF = os.environ.get("LABELWRIGHT_TEST_SF", "/root/testdata/sf0.001")
SAMPLE = [
    "cmp_01_04_field_results", "agg_04_trends", "srt_01_violation_page", "ent_00_attributes", "geo_03_parse_address",
    "pge_04_table_rows", "pge_16_prj_02_generic_record", "pge_07_json_ld", "pge_17_listing_texts", "pge_12_14_record_images", "img_01_collect_images", "img_12_near_duplicates",
    "img_06_stated_union", "jn_07_stated_products", "jn_06_stated_comparisons", "txt_01_agg_08_stated_texts", "txt_02_stated_reports", "src_06_scans_as_of", "src_06_rules_in_force", "src_01_label_outcomes",
    "srt_01_seek_page", "agg_01_summary", "str_02_live_platforms", "fnt_03_verdicts", "img_15_srt_04_total_score", "ocr_03_scan_passes", "jn_06_compare_records",
]
entry = importlib.import_module("__spark_entry__")
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def text(v):
    if v is None or isinstance(v, (bool, str)):
        return str(v)
    return f"{float(v):.9g}" if isinstance(v, (int, float)) or hasattr(v, "as_tuple") else str(v)


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 100


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in C.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(text(v) for v in r) for r in df.select(*cols).collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(text(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(names) == cols and got == want
