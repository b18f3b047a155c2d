from __future__ import annotations

import random
import re
from itertools import product

import numpy as np

from labelwright.llm import pii


def brute(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c in "0123456789"]
        if 13 <= len(d) <= 19 and sum(c if i % 2 == 0 else 2 * c - 9 * (c > 4) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


PLAIN = ["mail bob.x@mail.example.com now", "host 10.1.2.3 and 300.1.1.1", "card 4111 1111 1111 1111 ok", "call +1 (756) 555-9792 today", "no data 12.5 in 2024-01-02 here", "version 2.0.1 of 1,200 things"]


def field(spark, docs):
    return pii.train(docs([(i, t) for i in range(40) for t in PLAIN]))


def test_base_spans_equal_the_patterns():
    random.seed(6)
    for _ in range(20_000):
        t = "".join(random.choices("a1234567890.@-+ ()%_é\n", k=random.randint(1, 60)))
        assert sorted(pii.base_spans(t)) == sorted(brute(t)), t
    for t in ("a" * 200_000, "1" * 200_000, "@" * 50_000, "+1" * 50_000, "1." * 50_000, "a.b@" * 50_000):
        pii.base_spans(t)  # in linear time


def test_consistent_labels_within_a_document(spark, docs):
    f = field(spark, docs)
    spans = lambda t: [(k, t[s:e], b) for k, s, e, b in pii.all_spans(t, f)]
    assert spans("call +1 (756) 555-9792 x (756) 555-9792, 7565559792; 7565559793") == [
        ("phone", "+1 (756) 555-9792", True), ("phone", "(756) 555-9792", False), ("phone", "7565559792", False)
    ]
    assert ("email", "bob (at) mail (dot) com", False) in spans("bob@mail.com or bob (at) mail (dot) com")
    assert spans("7565559792 and again 7565559792") == []
    assert all(pii.all_spans(t, f) == [(*s, True) for s in pii.base_spans(t)] for t in PLAIN)
    many = "+1 (756) 555-9792, x " + "(756) 555-9792 b, " * 3000
    assert len(pii.all_spans(many, f)) == 3001


def test_columns_and_masks(spark, docs):
    f = field(spark, docs)
    rows = [(None, None), (1, ""), (2, "x é a.b@c.de, +1 (756) 555-9792"), (2, "x é a.b@c.de, +1 (756) 555-9792"), (3, "4111 1111 1111 1111")]
    got = pii.mask(pii.find_spans(docs(rows, ["spans", "kind"]), f), "text", "spans")
    by = sorted(((r.doc_id, r.masked, r.kind) for r in got.collect()), key=str)
    assert by == sorted([(None, None, "x"), (1, "", "x"), (2, "x é <EMAIL>, <PHONE>", "x"), (2, "x é <EMAIL>, <PHONE>", "x"), (3, "<CARD>", "x")], key=str)
    whole = pii.find_and_mask(docs(rows, ["masked"]), f).collect()
    assert sorted(((r.doc_id, r.masked) for r in whole), key=str) == sorted(((d, m) for d, m, _ in by), key=str)
    assert pii.personal_data(docs([])).count() == 0 and pii.find_and_mask(docs([]), f).count() == 0
    assert pii.masked("abcdef", [{"kind": "ip", "start": 1, "end": 4}, {"kind": "card", "start": 2, "end": 5}]) == "a<IP>f"


def enumerated(field, nodes):
    """Marginals by the sum over all labellings."""
    labels = len(pii.KINDS) + 1
    unary = [field.unary(t) for t in nodes]
    edges = [(i, i + 1, field.chain) for i in range(len(nodes) - 1)] + [(a, b, field.skip * np.eye(labels)) for a, b in pii.skips(nodes)]
    out = np.zeros((len(nodes), labels))
    for ys in product(range(labels), repeat=len(nodes)):
        weight = np.exp(sum(u[y] for u, y in zip(unary, ys, strict=True)) + sum(t[ys[a], ys[b]] for a, b, t in edges))
        for i, y in enumerate(ys):
            out[i, y] += weight
    return out / out.sum(axis=1, keepdims=True)


def test_beliefs_equal_enumeration(spark, docs):
    f = field(spark, docs)
    nodes = lambda t: pii.tokens(t, pii.base_spans(t))
    chains = ["1234567 and 12.34.568 or 98765432", "+1 (756) 555-9792, 1234567, 7654321", "4111 1111 1111 1111 x 1234567890123", "a.b@c.de 1234567"]
    for text in chains:  # no two tokens share a value: a tree, for which message passing is exact
        assert len(nodes(text)) > 1 and not pii.skips(nodes(text))
        assert np.allclose(f.beliefs(nodes(text)), enumerated(f, nodes(text)), atol=1e-3)
    for text in ("+1 (756) 555-9792, 1234567, 7565559792", "7565559792, 1234567, 7565559792, 1234567"):  # loops
        want = enumerated(f, nodes(text))
        assert pii.skips(nodes(text)) and np.abs(f.beliefs(nodes(text)) - want).max() < 0.15
        assert (f.beliefs(nodes(text)).argmax(axis=1) == want.argmax(axis=1)).all()


def test_evidence_of_all_texts(spark, docs):
    """Counts are those of a plain loop over every row, repeats included."""
    rows = [(i, t) for i in range(7) for t in [*PLAIN, None, "", "+1 (756) 555-9792, 1234567"]]
    f = pii.train(docs(rows).repartition(5))
    count = np.ones(len(pii.KINDS) + 1)
    for _, t in rows:
        nodes = pii.tokens(t, pii.base_spans(t)) if t else []
        unsure = {i for e in pii.skips(nodes) for i in e if not nodes[i].label}
        for i, n in enumerate(nodes):
            count[n.label] += i not in unsure
    assert np.allclose(f.prior, np.log(count / count.sum()))
