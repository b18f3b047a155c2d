from __future__ import annotations

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

from labelwright.llm.periodic import describe, find_runs, numbered, periodic_runs, unite


def brute(words, least=12):
    """All runs (start, length, period) by trying every period at every place."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed(words, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return b" ".join(w for k, w in enumerate(words) if k not in gone)


def cases():
    random.seed(3)
    out = [b"", b" ", b"a", b"a " * 11, b"a " * 12, b"a b " * 6, b"x " + b"a b c " * 40 + b"a", b"\xc2\xa0 a " * 9]
    fib = ["a", "b"]
    while len(fib) < 300:
        fib += fib[: -len(fib) // 2 or None]
    out.append(" ".join(fib).encode())
    a, b = "a", "ab"
    for _ in range(10):
        a, b = b, b + a
    out.append(" ".join(b).encode())
    for _ in range(150):
        letters = random.choice(["ab", "abc", "abcdefgh"])
        words = random.choices(letters, k=random.randrange(0, 120))
        for _ in range(random.randrange(4)):
            at, p = random.randrange(len(words) + 1), random.randrange(1, 20)
            piece = words[at : at + p] or ["z"]
            words[at:at] = piece * random.randrange(1, 6)
        out.append(random.choice([" ", "\n", "\t ", "\x0b"]).join(words).encode())
    return out


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_equal_brute_force(least):
    texts = cases()
    sizes, runs, kept = describe(texts, least)
    for text, n, found, rest in zip(texts, sizes, runs, kept, strict=True):
        words = text.split()
        want = brute(words, least)
        assert n == len(words) and [tuple(r) for r in found.tolist()] == want and rest == collapsed(words, want)


def test_neighbours_only():
    # 4 and 9 are united with {0, 10} at once: 0-4 and 9-10 are neighbours, 4-10 and 0-9 are not
    assert sorted(unite([0, 10, 4, 9], [20, 6, 20], 6)) == [(0, 4, 6), (0, 10, 20), (4, 9, 20), (9, 10, 6)]


def test_long_texts():
    random.seed(4)
    words = [str(random.randrange(5000)).encode() for _ in range(60_000)]
    words[10_000:40_000] = words[10_000:10_700] * 42 + words[:600]
    runs = find_runs(numbered([words]))
    assert [r for r in runs.tolist() if r[1] > 1000] == [[10_000, 29_400, 700]]
    one = describe([b"w " * 300_000, b"w"])
    assert one[0] == [300_000, 1] and one[1][0].tolist() == [[0, 300_000, 1]] and one[2] == [b"w", b"w"]


def test_rows(spark, docs):
    rows = [(1, None), (2, ""), (3, "a b " * 20), (3, "a b " * 20), (None, "a " * 12), (4, "so it is")]
    got = sorted(periodic_runs(docs(rows, extra=("runs", "n_words", "other")), "text").collect(), key=str)
    assert len(got) == 6 and got[0].other == "x"
    by = {(r.doc_id, r.text): (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got}
    assert by[3, rows[2][1]] == (40, [(0, 40, 2)], "a b") and by[None, rows[4][1]] == (12, [(0, 12, 1)], "a")
    assert by[1, None] == by[2, ""] == (0, [], "") and by[4, "so it is"] == (3, [], "so it is")
    assert periodic_runs(docs([])).count() == 0


def test_query(spark, tmp_path):
    from labelwright.llm.queries import R

    random.seed(5)
    rows = [(k, " ".join(random.choices("abcdefghij", k=random.randrange(0, 90)))) for k in range(120)] + [(None, "a " * 20), (500, None), (3, "again " * 30)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = R["op11_periodic_runs"].run(spark, str(tmp_path)).collect()
    want, planted = [], 0
    for doc_id, text in rows:
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        runs = brute(words)
        s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        lines = "".join(f"{x},{y},{z}\n" for x, y, z in runs)
        want.append((doc_id, len(runs), s, length, q, None if s is None else 1000 * length // q, sha256(lines.encode()).hexdigest(), sha256(collapsed(words, runs)).hexdigest()))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(r[c] for c in names) for r in got), key=str) == sorted(want, key=str) and planted > 3
    assert np.array(dict(R["op11_periodic_runs"].run(spark, str(tmp_path)).dtypes)["n_runs"]) == "bigint"
