from __future__ import annotations

import hashlib
import random
import re

from labelwright.llm import decontaminate
from labelwright.llm.decontaminate import contamination


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item_id, item in items:
            v = words(item)
            k = min(13, len(v))
            windows = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    found.add(str(item_id))
        n = len(hit)
        out.append((doc_id, len(w), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0 and 20 * n >= len(w)))
    return sorted(out, key=str)


def case():
    random.seed(9)
    vocabulary = ["the", "a", "of", "É", "é", "Übung", "x1", *("".join(random.choices("abcdeß", k=4)) for _ in range(60))]
    say = lambda n: " ".join(random.choices(vocabulary, k=n))
    items = [(i, say(n)) for i, n in enumerate((13, 14, 40, 40, 90, 5, 1, 12, 30))]
    items += [(50, items[2][1]), (51, None), (52, ""), (53, "..."), (10, items[4][1][:120]), (60, "the the the the the the the the the the the the the the")]
    docs = [(1, None), (2, ""), (3, "!!!"), (None, items[0][1]), (4, items[2][1].upper()), (5, "the " * 40), (6, "The, " * 13 + "end")]
    for i in range(60):
        parts = [say(random.randint(0, 300))]
        for _ in range(random.randint(0, 3)):
            v = words(random.choice(items)[1])
            a = random.randint(0, len(v))
            parts += [" -- ".join(v[a : a + random.choice([11, 12, 13, 14, 40, 90])]), say(random.randint(0, 40))]
        docs.append((100 + i, " ".join(parts)))
    return docs + docs[-2:] + [(100, "same id, other text")], items


def result(spark, docs, rows, items):
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = contamination(docs(rows, ["n_words", "term"]), table).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=str)


def test_equals_brute_force(spark, docs):
    rows, items = case()
    want = brute(rows, items)
    assert sum(r[2] > 0 for r in want) > 20
    assert result(spark, docs, rows, items) == want


def test_terms_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 900)
    rows, items = case()
    assert result(spark, docs, rows, items) == brute(rows, items)


def test_empty_tables(spark, docs):
    rows, items = case()
    assert result(spark, docs, [], items) == []
    assert result(spark, docs, rows[:9], []) == brute(rows[:9], [])


def test_proximity(spark, docs):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen")], "item_id bigint, text string")
    near = docs([(1, "one two three four five six OTHER eight nine ten eleven twelve thirteen")])
    counts = decontaminate.term_counts(near, items.select(decontaminate.F.explode(decontaminate.words_of(decontaminate.F.col("text"))).alias("term")).distinct())
    named = decontaminate.anchors(items, counts.withColumnRenamed("n", "counts"))
    assert [r.term for r in named.collect()] == ["seven"]
    entries = decontaminate.anchors(items, counts.filter("term <> 'one'").withColumnRenamed("n", "counts").union(spark.createDataFrame([("seven", 5)], "term string, counts bigint"))).withColumn("entry", decontaminate.F.lit(0))
    found = decontaminate.matches(decontaminate.postings(near, entries.select("term")).filter("term <> ''"), entries).collect()
    assert [(r.exact, r.near) for r in found] == [(False, 12)]


PASSAGE = [f"w{i}" for i in range(13)]


def near_items(spark, docs, texts, items=None):
    table = spark.createDataFrame(items or [(1, " ".join(PASSAGE))], "item_id bigint, text string")
    return {r.doc_id: (r.n_items, r.near_items, r.contaminated) for r in contamination(docs(texts), table).collect()}


def test_proximity_allows_shifts(spark, docs):
    put = lambda at, w: " ".join([*PASSAGE[:at], w, *PASSAGE[at:]])
    swapped = [*PASSAGE]
    swapped[3:5] = swapped[4:2:-1]
    rows = [
        (1, " ".join(PASSAGE)), (2, put(6, "extra")), (3, put(6, "two more")), (4, " ".join(PASSAGE[:4] + PASSAGE[5:])), (5, " ".join(swapped)), (6, " ".join(PASSAGE[::-1])),
        (7, " ".join(PASSAGE[:6])), (8, " x ".join(PASSAGE)), (9, "none of it"), (10, None), (11, "w0 " * 13),
    ]
    got = near_items(spark, docs, rows)
    assert got[1] == (1, ["1"], True)
    assert all(got[k] == (0, ["1"], False) for k in (2, 3, 4, 5))
    assert all(got[k] == (0, [], False) for k in (6, 7, 8, 9, 10, 11))
    short = near_items(spark, docs, [(1, "a b c"), (2, "a c b"), (3, "a b x")], [(5, "a b c"), (6, "a b c"), (7, None)])
    # a word that changes sides with the anchor does not count
    assert short[1] == (2, ["5", "6"], True) and short[2] == (0, [], False) and short[3] == (0, [], False)


def test_a_very_long_document(spark, docs):
    random.seed(1)
    words_ = [random.choice(["the", "of", "a", "and", f"x{random.randrange(4000)}"]) for _ in range(120_000)]
    words_[70_000:70_000] = PASSAGE
    got = near_items(spark, docs, [(1, " ".join(words_)), (2, " ".join(words_[:500]))])
    assert got[1] == (1, ["1"], False) and got[2] == (0, [], False)
