from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from labelwright.llm.bpe_codec import Codec, decode_ids, encode_texts, round_trip
from labelwright.llm.token_count import Counter, count_tokens

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "  a", "a  b   c\n\n d \n", "<|endoftext|>x<|endoftext|>", " <|startoftext|> hi", "ΑΣ ΑΣΣ", "İ ı ſ", "é á", "a\x1cb\x85c d",
    "a" * 700, "don't DON'T I'LL we've", "日本語テキスト", "🙂🙃 x", "١٢٣ ⅷ ²", "x" * 20_000, "̈́ͅ", "Ᲊ Ɤ ՘ ࢏", "\x00a\x00", "word " * 5000,
]


def texts():
    random.seed(4)
    letters = list("ab  \n\t'sStrellvem.,!1²é́\x1c日ΣσA🙂")
    return ODD + ["".join(random.choices(letters, k=random.randint(1, 60))) for _ in range(800)]


@pytest.fixture(scope="module")
def expected():
    lib = Tokenizer.from_file(BYTES)
    return [len(e.ids) for e in lib.encode_batch(texts(), add_special_tokens=False)]


def test_counts_equal_the_library(spark, docs, expected):
    rows = [*enumerate(texts()), (None, None), (0, "")]
    got = count_tokens(docs(rows, ["n_tokens", "source"]), BYTES, limit=300)
    assert got.columns == ["doc_id", "text", "source", "n_bytes", "n_tokens", "over_limit"]
    by = {(r.doc_id, r.text): r for r in got.collect()}
    assert [by[r].n_tokens for r in rows] == [*expected, 0, 0]
    assert all(r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 300) for r in by.values())
    assert count_tokens(docs([]), BYTES).count() == 0


def test_counts_survive_a_full_memory(monkeypatch, expected):
    monkeypatch.setattr("labelwright.llm.token_count.MEMORY", 3)
    count = Counter(BYTES)
    assert [count.text(t) for t in texts()] == expected


def test_round_trip_equals_the_library(spark, docs):
    rows = [*enumerate(texts()), (None, None), (7, "again"), (7, "again")]
    lib = Tokenizer.from_file(WORDS)
    df = docs(rows, ["ids", "decoded"])
    got = decode_ids(encode_texts(df, WORDS), WORDS).collect()
    assert len(got) == len(rows) and sorted(round_trip(df, WORDS).select(*got[0].__fields__).collect(), key=str) == sorted(got, key=str)
    assert round_trip(docs([]), WORDS).count() == 0
    for r in got:
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded == lib.decode(ids, skip_special_tokens=False)


def test_pair_index_on_repeats():
    lib, codec = Tokenizer.from_file(WORDS), Codec(WORDS)
    for word in ("aaaa", "aaaaa", "abababab", "inininin", "thethethe" * 30):
        ids = memoryview(codec.encode([word])[0]).cast("i").tolist()
        assert ids == lib.encode(word, add_special_tokens=False).ids
