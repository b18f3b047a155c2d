"""Personal data by fixed patterns and a skip-chain conditional random field.

Patterns find e-mail addresses, IP addresses, card numbers and telephone numbers.  The
field then looks at every token of a text that could stand for one of these: numbers in groups and
addresses with spelled-out signs.  Neighbours in the text share a chain potential, and tokens that repeat a value,
or end in the same digits, share a skip potential however far apart.  Loopy
message passing lets a value that a pattern has recognised in one place carry its label to the places where it is
written in another form; those spans are added.  Pattern spans are observed and always stay.

Each occurrence of a value is linked to the one before it and to the first recognised one, not to all
others, so a text's graph grows in proportion to its tokens.

Weights are learnt from the patterns' own findings in all texts: shape features that do not give away a
pattern, transitions along the chain, and how often linked recognised tokens agree.

Defined cases: a null or empty text has no spans; repeated rows are treated alike; very long texts are read
whole, in time proportional to their length; an empty table gives an empty one, and a field without evidence; other columns are passed through, and one named ``spans`` is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_columns

#: Kinds in the order of the results; label 0 stands for none of them.
KINDS = ("email", "ip", "card", "phone")
#: Belief from which a span is added.
SURE = 0.9
ROUNDS, DAMP = 30, 0.3
# The patterns. The local part of an address is read backwards from its sign, so a long run
# of its characters is read once; a number's first digit has none before it, which finds the same spans.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NUMBER = re.compile(r"(?<![0-9])\+?\(?[0-9]+(?:[ ().-]{1,2}[0-9]+)*")
SPELLED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)|@| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\.| dot ) ?[A-Za-z0-9-]{1,63})+", re.IGNORECASE
)
SPAN = "array<struct<kind:string,start:int,end:int,base:boolean>>"

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Leftmost spans of each kind that do not overlap; failing ones are dropped."""
    out: list[Span] = []
    end, sign = 0, text.find("@")
    while sign >= 0:
        start = sign
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < sign and (m := DOMAIN.match(text, sign)):
            out.append(("email", start, m.end()))
            end = m.end()
        sign = text.find("@", max(sign + 1, end))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


class Token:
    """A candidate: its place, its label if a pattern gave one (0 if none), its features and its values."""

    __slots__ = ("start", "end", "label", "shape", "keys")

    def __init__(self, text: str, start: int, end: int, label: int):
        self.start, self.end, self.label = start, end, label
        piece = text[start:end]
        letters = any(map(str.isalpha, piece))
        digits = _digits(piece)
        n = len(digits)
        if letters:
            size, self.keys = "letters", [("a", re.sub(r"(?i)[\[(]?\bat\b[\])]?|@", "@", re.sub(r"(?i) ?[\[(]?\bdot\b[\])]? ?", ".", piece)).replace(" ", "").lower())]
        else:
            size = f"digits {n if n < 20 else 20}"
            self.keys = [("n", digits)] if n >= 7 else []
            if n >= 9 and piece.count(".") != 3:
                self.keys += [("e", digits[-9:])]
        points = piece.count(".")
        # a leading plus and the form of the sign are left out: they would give the pattern away
        self.shape = (size, f"points {min(points, 4) if not letters else 'any'}", f"sum {not letters and 13 <= n <= 19 and luhn(digits)}", f"brackets {'(' in piece}")


def tokens(text: str, spans: list[Span]) -> list[Token]:
    """Candidates of a text in order; those that overlap a pattern's span are that span."""
    found = [Token(text, s, e, KINDS.index(k) + 1) for k, s, e in spans]
    taken = sorted((s, e) for _, s, e in spans)
    starts = [s for s, _ in taken]
    reach = list(np.maximum.accumulate([e for _, e in taken])) if taken else []
    free = lambda s, e: not (i := bisect_left(starts, e)) or reach[i - 1] <= s
    extra = [(m.start(), m.end()) for m in NUMBER.finditer(text) if m.end() - m.start() >= 7]
    if "@" in text or "at" in text.lower():
        low = text.lower()
        if "@" in text or " at " in low or "(at)" in low or "[at]" in low:
            extra += [(m.start(), m.end()) for m in SPELLED.finditer(text)]
    found += [Token(text, s, e, 0) for s, e in extra if free(s, e)]
    return sorted(found, key=lambda t: (t.start, t.end))


def skips(nodes: list[Token]) -> list[tuple[int, int]]:
    """Skip edges: each occurrence of a value with the one before and with the first recognised one."""
    last: dict[tuple, int] = {}
    first: dict[tuple, int] = {}
    for i, t in enumerate(nodes):
        for k in t.keys:
            if t.label:
                first.setdefault(k, i)
    edges = set()
    for i, t in enumerate(nodes):
        for k in t.keys:
            if k in last:
                edges.add((last[k], i))
            last[k] = i
            if (f := first.get(k, i)) != i:
                edges.add((min(f, i), max(f, i)))
    return sorted(edges)


class Field:
    """Potentials of the field, as logarithms."""

    def __init__(self, shapes: dict[str, np.ndarray], prior: np.ndarray, chain: np.ndarray, skip: float):
        self.shapes, self.prior, self.chain, self.skip = shapes, prior, chain, skip

    def unary(self, t: Token) -> np.ndarray:
        if t.label:
            out = np.full(len(KINDS) + 1, -50.0)
            out[t.label] = 0.0
            return out
        return self.prior + sum(self.shapes[s] for s in t.shape if s in self.shapes)

    def beliefs(self, nodes: list[Token]) -> np.ndarray:
        """Marginals by loopy message passing along chain and skip edges."""
        n, labels = len(nodes), len(KINDS) + 1
        pairs = [(i, i + 1, 0) for i in range(n - 1)] + [(a, b, 1) for a, b in skips(nodes)]
        unary = np.array([self.unary(t) for t in nodes])
        if not pairs:
            return _normal(unary)
        a, b, kind = (np.array(x) for x in zip(*pairs, strict=True))
        src, dst = np.r_[a, b], np.r_[b, a]
        mirror = np.r_[np.arange(len(a)) + len(a), np.arange(len(a))]
        same = self.skip * np.eye(labels)
        table = np.where(kind[:, None, None] == 0, self.chain[None], same[None])
        table = np.concatenate([table, table.transpose(0, 2, 1)])  # from label of src, to label of dst
        messages = np.zeros((len(src), labels))
        for _ in range(ROUNDS):
            total = unary.copy()
            np.add.at(total, dst, messages)
            ready = total[src] - messages[mirror]
            top = (ready[:, :, None] + table).max(axis=1)
            new = top + np.log(np.exp(ready[:, :, None] + table - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            change = np.abs(new - messages).max()
            messages = DAMP * messages + (1 - DAMP) * new
            if change < 1e-4:
                break
        np.add.at(unary, dst, messages)
        return _normal(unary)


def _normal(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def all_spans(text: str | None, field: Field) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) of every span, by kind as listed, then by start."""
    if not text:
        return []
    base = base_spans(text)
    out = [(k, s, e, True) for k, s, e in base]
    if base:  # a label can only come from a recognised value
        nodes = tokens(text, base)
        linked = {i for e in skips(nodes) for i in e} if any(not t.label for t in nodes) else set()
        if any(not nodes[i].label for i in linked):
            for i, belief in enumerate(field.beliefs(nodes)):
                t, best = nodes[i], int(belief.argmax())
                if not t.label and best and belief[best] >= SURE and i in linked:
                    out.append((KINDS[best - 1], t.start, t.end, False))
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts for training: (what, key, label, n), summed over each task."""
    seen: dict[tuple[str, str, int], int] = defaultdict(int)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            base = base_spans(text) if text else []
            nodes = tokens(text, base) if text else []
            edges = skips(nodes)
            unsure = {i for a, b in edges for i in (a, b) if not nodes[i].label}  # may be another form: no evidence
            for i, t in enumerate(nodes):
                if i not in unsure:
                    seen["label", "", t.label] += 1
                    for s in t.shape:
                        seen["shape", s, t.label] += 1
            for a, b in zip(nodes, nodes[1:], strict=False):
                seen["chain", str(a.label), b.label] += 1
            for a, b in edges:
                if nodes[a].label and nodes[b].label:
                    seen["skip", "", int(nodes[a].label == nodes[b].label)] += 1
    columns = [*zip(*((*k, v) for k, v in seen.items()), strict=True)] or [[], [], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=["what", "key", "label", "n"])


def train(docs: DataFrame, text: str = "text") -> Field:
    """A field from what the patterns find in all texts; the counts are summed by task before they are shuffled."""
    counted = docs.select(F.col(text).alias("text")).mapInArrow(_evidence, "what string, key string, label int, n bigint").groupBy("what", "key", "label").agg(F.sum("n").alias("n"))
    labels = len(KINDS) + 1
    by: dict[str, dict[str, np.ndarray]] = defaultdict(lambda: defaultdict(lambda: np.ones(labels)))
    for what, key, label, n in counted.collect():  # shapes are few: sizes, points, sums, brackets
        by[what][key][label] += n
    prior = by["label"][""]
    shapes = {k: np.log(v + 1) - np.log(prior + len(by["shape"])) for k, v in by["shape"].items()}
    chain = np.zeros((labels, labels))
    for k, v in by["chain"].items():
        chain[int(k)] = 0.5 * (np.log(v / v.sum()) - np.log(prior / prior.sum()))
    agree = by["skip"][""]
    return Field(shapes, np.log(prior / prior.sum()), np.clip(chain, -2, 2), log(agree[1] / agree[0]) + log(labels - 1) + exp(1))


def find_spans(df: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """Append ``spans`` to every row."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
    names = ("kind", "start", "end", "base")

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            return [pa.array([[dict(zip(names, s, strict=True)) for s in all_spans(t, field)] for t in texts.to_pylist()], kind)]

        return work

    return add_columns(df, [text], f"spans {SPAN}", make)


def find_and_mask(df: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """Append ``masked``, the text with its spans replaced as ``mask`` does; spans are found and replaced in one pass of a worker."""

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            held = texts.to_pylist()
            found = ([{"kind": k, "start": s, "end": e} for k, s, e, _ in all_spans(t, field)] for t in held)
            return [pa.array([masked(t, s) for t, s in zip(held, found, strict=True)], pa.string())]

        return work

    return add_columns(df, [text], "masked string", make)


def digest_text(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Replace each span in ``text`` by its kind in angle brackets; overlapping spans are replaced as one, by the first kind."""

    def make():
        def work(texts: pa.Array, found: pa.Array) -> list[pa.Array]:
            return [pa.array([masked(t, s) for t, s in zip(texts.to_pylist(), found.to_pylist(), strict=True)], pa.string())]

        return work

    return add_columns(df, [text, spans], "masked string", make)


def masked(text: str | None, spans: list[dict] | None) -> str | None:
    if not text or not spans:
        return text
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"<{s['kind'].upper()}>"]
        at = max(at, s["end"])
    return "".join(out) + text[at:]


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and spans of every document."""
    docs = docs.select("doc_id", "text")
    return find_spans(docs, train(docs)).drop("text")
