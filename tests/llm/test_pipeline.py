"""The pipeline against a plain version of each stage, over the smallest tables."""

from __future__ import annotations

import hashlib
import os

import corpus_pipeline as C
import public_tokenizers
import pytest
from test_decontaminate import brute as brute_contamination
from test_pii import brute as brute_spans
from test_jaccard import brute_kept
from tokenizers import Tokenizer

SF = os.environ.get("LABELWRIGHT_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before and after each stage."""
    root = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(None, None, "en", "x", 0), (None, "no id", "en", "x", 5), (900001, "", "en", "x", 0), (900002, "", "en", "x", 0)], docs.schema)
    docs.union(extra).union(docs.limit(3)).write.parquet(str(root / "in"))
    docs = spark.read.parquet(str(root / "in"))
    out = {}
    for name, stage in C.STAGES:
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(str(root / name))
        docs = spark.read.parquet(str(root / name))
        out[name] = (before, docs.collect(), docs.columns)
    return out


def test_columns_stay(stages):
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "bpe"]
    assert all(cols == ["doc_id", "text", "lang", "source", "n_chars"] for n, (_, _, cols) in stages.items() if n != "bpe")


def test_toxicity_keeps_what_it_does_not_reject(stages):
    before, after, _ = stages["toxicity"]
    assert len(before) * 0.8 < len(after) <= len(before) and set(after) <= set(before)


def test_one_document_of_each_group(stages):
    before, after, _ = stages["near_duplicates"]
    rows = [(r.doc_id, r.text) for r in before]
    keep = brute_kept([r for r in rows if r[0] is not None])
    want = {(d, t) for d, t in rows if d is None or d in keep}
    assert sorted(((r.doc_id, r.text) for r in after), key=str) == sorted(want, key=str)
    assert len(after) < len(before)


def test_contaminated_documents_go(spark, stages):
    before, after, _ = stages["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {d for d, *_, flag in brute_contamination([(r.doc_id, r.text) for r in before], items) if flag}
    assert bad and {r.doc_id for r in before} - {r.doc_id for r in after} == bad


def test_personal_data_is_masked(stages):
    before, after, _ = stages["personal_data"]
    by = {r.doc_id: r for r in after}
    assert len(before) == len(after)
    hidden = 0
    for r in before:
        spans = brute_spans(r.text or "")
        hidden += len(spans)
        if r.doc_id is not None and spans:
            assert all((r.text)[s:e] not in by[r.doc_id].text for _, s, e in spans) and by[r.doc_id].n_chars == len(by[r.doc_id].text)
        elif r.doc_id is not None:
            assert by[r.doc_id].text == r.text
    assert hidden


def test_ids_of_the_library(stages):
    before, after, _ = stages["bpe"]
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in before if r.doc_id is not None}
    assert len(before) == len(after)
    for r in after:
        if r.doc_id is not None:
            ids = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
            assert list(r.ids) == ids and r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_returns_the_last_stage(spark, tmp_path):
    assert C.run(spark, SF).columns == ["doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]


def test_a_worker_keeps_one_operator_at_a_time(spark):
    """Stages share their workers: what an operator keeps from task to task goes when another one begins."""
    import pyarrow as pa
    import public_tokenizers

    from labelwright.llm.bpe_codec import codec, encode_texts
    from labelwright.llm.common import add_columns

    docs = spark.range(64, numPartitions=2).selectExpr("id", "concat('some words ', id) AS text")
    path = public_tokenizers.path("word_bpe_49k.json")

    def make():
        held = codec.cache_info().currsize
        return lambda ids: [pa.array([held] * len(ids), pa.int64())]

    for _ in range(2):
        assert encode_texts(docs, path).filter("size(ids) < 2").count() == 0
        assert add_columns(docs, ["id"], "held bigint", make).filter("held > 0").count() == 0
