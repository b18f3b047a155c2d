from __future__ import annotations

import random
import re

import xxhash

from labelwright.llm import simhash
from labelwright.llm.components import components
from labelwright.llm.simhash import BKTree, near_groups


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    left, out = set(range(len(rows))), {}
    while left:
        todo, group = [left.pop()], []
        while todo:
            i = todo.pop()
            group.append(i)
            near = {j for j in left if (fps[i] ^ fps[j]).bit_count() <= 3}
            left -= near
            todo += near
        least = min((rows[i][0] for i in group if rows[i][0] is not None), default=None)
        out |= {i: least for i in group}
    return sorted(((rows[i][0], f"{fps[i]:016x}", out[i]) for i in range(len(rows))), key=str)


def corpus():
    random.seed(5)
    vocabulary = ["".join(random.choices("abcdeé", k=random.randint(1, 5))) for _ in range(300)]
    rows = [(None, None), (900, ""), (901, " \n\t"), (902, None), (3, "One"), (4, "one two"), (5, "ONE two"), (6, "a b"), (None, "lonely text without id")]
    for k in range(60):
        words = random.choices(vocabulary, k=random.choice([1, 2, 3, 30, 200]))
        for copy in range(random.choice([1, 1, 2, 6])):
            changed = list(words)
            for _ in range(copy):
                changed[random.randrange(len(changed))] = random.choice(vocabulary)
            rows.append((1000 - 7 * k + copy, " ".join(changed)))
    return rows + rows[-3:]


def result(spark, docs, rows):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in near_groups(docs(rows, ["fp", "fingerprint"])).collect()), key=str)


def test_groups_equal_brute_force(spark, docs):
    rows = corpus()
    assert result(spark, docs, rows) == brute_groups(rows)
    assert near_groups(docs([])).count() == 0


def test_crowded_shards_are_dealt_in_parts(spark, docs, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 3)
    rows = corpus()
    assert result(spark, docs, rows) == brute_groups(rows)


def test_finer_blocks_find_the_same(spark, docs, monkeypatch):
    monkeypatch.setattr(simhash, "EVEN", 1e-6)
    rows = corpus()
    assert result(spark, docs, rows) == brute_groups(rows)


def test_tree_finds_all_within_radius():
    random.seed(1)
    values = [random.getrandbits(16) for _ in range(400)]
    tree = BKTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert {tree.values[i] for i in tree.near(q, 3)} == {v for v in values if (v ^ q).bit_count() <= 3}


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (7, 6)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
