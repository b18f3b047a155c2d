"""Toxicity scores from a subsequence string kernel, Nyström landmarks and a support vector machine.

The units of comparison are taken along each text, folded to letters: every token, and windows across blanks, which are up
to three neighbouring tokens with a gap for each blank between them.  A run of single
characters counts as one token, and characters that are no letters hold a place as gaps.
A window across blanks is a unit if the letters on its blanks hold as many four-letter pieces of a toxic landmark as two
tokens that a blank has split would; all other windows have next to no subsequence in common with one.
Two units are compared by their common subsequences of four symbols, each
weighted by a decay to the power of its span; so "id-i-ot" stays close to "idiot".

Training: a unit of a toxic document is taken for toxic if more toxic documents share it than chance allows; pairs of
neighbouring tokens are such units too, so an insult may be made of two plain words.  Units of clean documents are clean.  Landmarks drawn from both kinds span the feature space, a linear
machine with squared hinge loss is fitted there, and clean units that score highest, and
high-scoring ones that only toxic documents have, are added for further fits.  A document is described by the margins of its worst tokens, how many lie on the toxic side, and
its length; a logistic fit over the training documents turns these into a probability.

Scoring: the machine is a sum of kernels with the landmarks.  As each kernel is a product over common
subsequences, the sum collapses to one weight per subsequence of four symbols, and the score of a unit is the
weighted sum over its own subsequences, divided by its norm.

Defined cases: a null or empty text, and one without letters, scores like the mildest document; repeated
rows score alike, and a labelled id that repeats is one training text; very long tokens are scored in overlapping windows; without usable
labels of both classes nothing is taken for toxic and all scores are 0; texts of any length are read
whole; an empty table gives an empty one; other columns are passed through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32
from itertools import combinations
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, begin, cut, keeps
from .labelled import held_out, training_texts

DECAY, ORDER = 0.6, 4
#: Landmarks of either kind.
TOXIC_LANDMARKS, CLEAN_LANDMARKS = 200, 100
#: Symbols: 0 a gap, 1-26 letters, 27 and 28 the two ends of a unit, from 29 on all other letters.
SYMBOLS, OPEN, CLOSE = 40, 27, 28
LONG, STRIDE = 24, 12
#: Training documents of each class, and units of each kind, at most.
DOCUMENTS = {1: 6_000, 0: 12_000}
UNITS = 3_000
#: Log-likelihood ratio from which a unit counts as shared by toxic documents.
CHANCE = 20.0
#: Least ratio of a unit's share of toxic documents to its share of clean ones.
ODDS = 8.0
MEMORY = 400_000
#: Least margin of any unit, and the margin of tokens without letters.
FLOOR = -0.5
# Digits and signs that are written in place of letters.
STAND_INS = str.maketrans("013457@$", "oieastas")
LONELY = re.compile(r"\s\S\s\S(?!\S)|\A\S\s\S(?!\S)")
SPELLED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")


@lru_cache(4096)
def _symbol(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    return 29 + ord(normalize("NFC", c)[0]) % (SYMBOLS - 29) if c.isalpha() else 0


ASCII = bytes(_symbol(chr(i)) for i in range(128)) + bytes(128)
EDGES = "0123456789!?.,;:|*#%&$@()[]{}\"'-_/\\"


def codes(token: str) -> bytes:
    """Symbols of a token between its ends, without gaps at the ends; empty if it has no letters."""
    token = token.lower()
    if not token.isalpha():
        token = token.strip(EDGES)
        token = token.translate(STAND_INS) if any(map(str.isalpha, token)) else ""
    body = (token.encode().translate(ASCII) if token.isascii() else bytes(map(_symbol, token))).strip(b"\0")
    return bytes([OPEN]) + body + bytes([CLOSE]) if body else b""


def windows(unit: bytes) -> list[bytes]:
    """A unit, or its overlapping windows if it is very long."""
    return [unit] if len(unit) <= LONG else [unit[i : i + LONG] for i in range(0, len(unit) - STRIDE, STRIDE)]


@keeps
@lru_cache(64)
def places(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ways to choose four of n places, as two pairs of places; the pairs; and the weights."""
    pairs = np.array(list(combinations(range(n), 2)), np.intp).reshape(-1, 2)
    number = {tuple(p): i for i, p in enumerate(pairs.tolist())}
    at = list(combinations(range(n), ORDER))
    halves = np.array([(number[c[:2]], number[c[2:]]) for c in at], np.intp).reshape(-1, 2)
    return pairs, halves, np.array([DECAY ** (c[-1] - c[0] + 1) for c in at], np.float32)


def subsequences(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the subsequences of each row of symbols, and their weights; one with a gap has number 0."""
    pairs, halves, weight = places(x.shape[1])
    left, right = x[:, pairs[:, 0]], x[:, pairs[:, 1]]
    pair = left * np.int32(SYMBOLS) + right
    index = pair[:, halves[:, 0]]
    index *= np.int32(SYMBOLS**2)
    index += pair[:, halves[:, 1]]
    if not x.all():
        whole = (left > 0) & (right > 0)
        index *= whole[:, halves[:, 0]] & whole[:, halves[:, 1]]
    return index, weight


def self_kernel(x: np.ndarray) -> np.ndarray:
    """Kernel of each row of symbols with itself, by dynamic programming over prefixes."""
    w, n = x.shape
    t = np.ascontiguousarray(x.T)
    same = ((t[:, None] == t[None]) & (t[:, None] > 0)) * np.float32(DECAY**2)
    before = np.ones((n + 1, n + 1, w), np.float32)
    for _ in range(ORDER - 1):
        now = np.zeros((n + 1, n + 1, w), np.float32)
        for a in range(1, n + 1):
            row = np.zeros(w, np.float32)
            step = same[a - 1] * before[a - 1, :n]
            for b in range(1, n + 1):
                row = DECAY * row + step[b - 1]
                now[a, b] = DECAY * now[a - 1, b] + row
        before = now
    return (same * before[:n, :n]).sum(axis=(0, 1), dtype=np.float64)


def evaluate(units: list[bytes], weights: np.ndarray, column: np.ndarray | None = None, least: float | None = None) -> np.ndarray:
    """Normalised weighted sums over the subsequences of each unit.

    ``weights`` has a row per subsequence, or per entry of ``column``, which maps subsequences to rows.  With ``least`` a
    unit whose sum can't exceed it gets ``least``: its norm is at least what it would be were all its subsequences
    different, so only the others need their norm.
    """
    out = np.zeros((len(units), weights.shape[1]))
    by_size: dict[int, list[int]] = {}
    for i, u in enumerate(units):
        by_size.setdefault(len(u), []).append(i)
    for n, rows in by_size.items():
        if n < ORDER:
            continue
        step = min(2048, max(1, 4_000_000 // (max(1, len(places(n)[1])) * weights.shape[1])))
        for lo in range(0, len(rows), step):
            part = rows[lo : lo + step]
            x = np.frombuffer(b"".join(units[i] for i in part), np.uint8).reshape(-1, n).astype(np.int32)
            index, weight = subsequences(x)
            if least is not None and column is None:
                sums = np.take(weights, index) @ weight
                square = (weight * weight).sum() if x.all() else (index > 0) @ (weight * weight)
                high = np.flatnonzero(sums > least * np.sqrt(square) * 0.999 - 1e-6)
                values = np.full(len(part), least)
                if len(high):
                    values[high] = np.maximum(sums[high] / np.sqrt(np.maximum(self_kernel(x[high].astype(np.uint8)), 1e-12)), least)
                out[part] = values[:, None]
                continue
            norm = np.sqrt(np.maximum(self_kernel(x.astype(np.uint8)), 1e-12))
            if column is None:
                sums = (np.take(weights, index) @ weight)[:, None]
            else:
                sums = np.einsum("wtm,t->wm", weights[column[index]], weight, optimize=True)
            out[part] = sums / norm[:, None]
    return out


def span(landmarks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Normalised subsequence weights of the landmarks, a row for each subsequence that any of them has, and the row of every subsequence."""
    found = []
    for z in landmarks:
        index, weight = subsequences(np.frombuffer(z, np.uint8).astype(np.int32)[None])
        keys, back = np.unique(index[0], return_inverse=True)
        sums = np.bincount(back, weight)
        sums[keys == 0] = 0
        found.append((keys, sums / max(np.linalg.norm(sums), 1e-12)))
    every = np.unique(np.concatenate([[0], *(k for k, _ in found)]))
    column = np.zeros(SYMBOLS**ORDER, np.int32)
    column[every] = np.arange(len(every))
    rows = np.zeros((len(every), len(landmarks)), np.float32)
    for j, (keys, sums) in enumerate(found):
        rows[column[keys], j] = sums
    rows[0] = 0
    return rows, column


def fit_machine(features: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-5) -> np.ndarray:
    """Linear machine with squared hinge loss, by Newton steps on the units inside the margin; the last weight is the bias."""
    x = np.hstack([features, np.ones((len(features), 1))])
    sign, w = np.where(y > 0, 1.0, -1.0), np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-9
    loss = lambda v: (weight * np.maximum(0, 1 - sign * (x @ v)) ** 2).sum() + v @ penalty @ v
    for _ in range(40):
        inside = sign * (x @ w) < 1
        a = x[inside] * weight[inside, None]
        new = np.linalg.solve(a.T @ x[inside] + penalty, a.T @ sign[inside])
        step = 1.0
        while step > 1e-3 and loss(w + step * (new - w)) > loss(w):
            step /= 2
        if np.abs(step * (new - w)).max() < 1e-7:
            break
        w = w + step * (new - w)
    return w


def disguised(unit: bytes) -> list[bytes]:
    """The unit with a gap, an inserted or a doubled letter in its middle, and with gaps between all letters."""
    body, m = unit[1:-1], len(unit) // 2
    other = bytes([1 + sum(unit) % 26])
    spaced = b"\0".join(body[i : i + 1] for i in range(len(body)))
    return [unit[:1] + b + unit[-1:] for b in (body[:m] + b"\0" + body[m:], body[:m] + other + body[m:], body[:m] + body[m - 1 :], spaced)]


def train_machine(toxic: list[bytes], strength: np.ndarray, clean: list[bytes]) -> tuple[np.ndarray, float]:
    """Weight per subsequence of symbols and bias, from units of either kind; the first ones serve as landmarks, and take part in disguise too."""
    rows, column = span([*toxic[:TOXIC_LANDMARKS], *clean[:CLEAN_LANDMARKS]])
    values, vectors = np.linalg.eigh(rows.T.astype(np.float64) @ rows)
    root = vectors / np.sqrt(np.maximum(values, 1e-6))  # the inverse root of the landmarks' kernel
    hidden = [d for u in toxic[:TOXIC_LANDMARKS] if len(u) > 5 for d in disguised(u) if len(d) <= LONG]
    plain = [d for u in clean[:TOXIC_LANDMARKS] if len(u) > 5 for d in disguised(u) if len(d) <= LONG]
    units = [*toxic, *hidden, *clean, *plain]
    y = np.r_[np.ones(len(toxic) + len(hidden)), np.zeros(len(clean) + len(plain))]
    strength = np.r_[strength, np.full(len(hidden), 0.25 * strength.mean())]
    weight = np.r_[0.5 * strength / strength.sum(), np.full(len(clean) + len(plain), 0.5 / (len(clean) + len(plain)))]
    w = fit_machine(evaluate(units, rows, column) @ root, y, weight)
    return (rows @ (root @ w[:-1]))[column].astype(np.float32), float(w[-1])


def body_of(token: str) -> bytes:
    """Symbols of a token without its ends; a very long token counts as none here."""
    return c[1:-1] if (c := codes(token)) and len(c) <= LONG else b""


def piece_table(units: list[bytes]) -> np.ndarray:
    """Numbers of the pieces of four letters that the units hold, gaps left out, ascending."""
    bodies = (u[1:-1].replace(b"\0", b"") for u in units)
    found = {b[i : i + ORDER] for b in bodies for i in range(len(b) - ORDER + 1)}
    return np.array(sorted(_piece_number(np.frombuffer(p, np.uint8))[0] for p in found), np.int32)


def _piece_number(x: np.ndarray) -> np.ndarray:
    n, x = len(x) - ORDER + 1, x.astype(np.int32)
    return ((x[:n] * SYMBOLS + x[1 : n + 1]) * SYMBOLS + x[2 : n + 2]) * SYMBOLS + x[3 : n + 3]


def across(units: list[bytes], marked: np.ndarray) -> set[bytes]:
    """Units of up to three neighbouring tokens, given as units, whose letters across the blanks hold marked pieces: two, or all if fewer cross."""
    bodies = [u[1:-1] for u in units if u and len(u) <= LONG]
    sizes = np.fromiter(map(len, bodies), np.int32, len(bodies))
    x = np.frombuffer(b"".join(bodies), np.uint8)
    if len(x) < ORDER:
        return set()
    token = np.repeat(np.arange(len(bodies), dtype=np.int32), sizes)
    first, last = token[: 1 - ORDER], token[ORDER - 1 :]
    cross = np.flatnonzero((last > first) & (last - first <= 2))
    hit = cross[marked[_piece_number(x)[cross]]] if len(cross) else cross
    held: dict[tuple[int, int], int] = {}
    for a, b in zip(first[hit].tolist(), last[hit].tolist(), strict=True):
        held[a, b] = held.get((a, b), 0) + 1
    out = set()
    for (a, b), n in held.items():
        shortest = min(sizes[a], sizes[b])
        if n >= min(2, shortest) and sum(sizes[a : b + 1]) >= 5:
            out.add(bytes([OPEN]) + b"\0".join(bodies[a : b + 1]) + bytes([CLOSE]))
    return {w for u in out for w in windows(u)}


@keeps
@lru_cache(1)
def _marked(pieces: bytes) -> np.ndarray:
    table = np.zeros(SYMBOLS**ORDER, bool)
    table[np.frombuffer(pieces, np.int32)] = True
    return table


class _Remembered(dict):
    """A function's values by its argument."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


def _units_of(texts: list[str | None], code: dict[str, bytes]) -> list[tuple[set[bytes], list[bytes]]]:
    """For each text the distinct units of its tokens, and the units in order."""
    out = []
    for text in texts:
        low = (text or "").lower()
        row = list(map(code.__getitem__, low.split()))
        distinct = set(row)
        if LONELY.search(low):
            distinct.update(map(codes, tokens_of(text)))
        distinct.discard(b"")
        out.append((distinct, row))
    return out


class Scorer:
    """Scores units and documents; remembers units already seen."""

    def __init__(self, weights: np.ndarray, bias: float, memory: int = MEMORY, pieces: np.ndarray | None = None):
        self.memory = memory
        self.weights, self.bias = weights.reshape(-1, 1), bias
        self.code = _Remembered(codes)
        self.known: set[bytes] = set()
        self.near: dict[bytes, float] = {}
        self.marked = _marked((np.zeros(0, np.int32) if pieces is None else pieces).tobytes())

    def units(self, units: list[bytes]) -> np.ndarray:
        """Margins; a very long unit scores like its worst window."""
        cut_up = [windows(u) for u in units]
        least = FLOOR - self.bias if FLOOR > self.bias else None
        flat = np.maximum(evaluate([w for ws in cut_up for w in ws], self.weights, least=least)[:, 0] + self.bias, FLOOR)
        ends = np.cumsum([0, *map(len, cut_up)])
        return np.maximum.reduceat(flat, ends[:-1]) if len(units) else flat

    def documents(self, texts: list[str | None]) -> np.ndarray:
        """For each text: the four highest margins, the length, and three counts of units on or near the toxic side."""
        if len(self.code) > self.memory:
            self.code.clear()
            self.known.clear()
            self.near.clear()
        known, close = self.known, self.near
        rows = [(own, across(row, self.marked)) for own, row in _units_of(texts, self.code)]
        new = sorted(set().union(*(us - known for row in rows for us in row)))
        known.update(new)
        close.update((u, m) for u, m in zip(new, self.units(new).tolist(), strict=True) if m > FLOOR)
        out = np.full((len(texts), 8), FLOOR)
        for line, (own, wide) in zip(out, rows, strict=True):
            near = [close[u] for u in own & close.keys()]
            # a window is counted if none of its tokens is clearly toxic by itself
            near += [close[u] for u in wide & close.keys() if all(close.get(u[:1] + p + u[-1:], FLOOR) <= 0.5 for p in u[1:-1].split(b"\0"))]
            near.sort(reverse=True)
            line[: min(4, len(near))] = near[:4]
            hits = sum(m > 0 for m in near)
            line[4:] = np.log1p(len(own)), np.log1p(hits), np.log1p(sum(min(1.0, max(0.0, m + 0.5)) for m in near)), hits / np.sqrt(len(own) + 1)
        return out

    def across(self, text: str | None) -> set[bytes]:
        """Units across the blanks of a text."""
        return across(_units_of([text], self.code)[0][1], self.marked)


def tokens_of(text: str | None) -> set[str]:
    """Distinct tokens of a text, in lower case and without signs at the ends; a run of single characters counts as one more."""
    if not text:
        return set()
    low = text.lower()
    out = {t.strip(EDGES) for t in {*low.split()}}
    if LONELY.search(low):
        out.update("".join(m.split()) for m in SPELLED.findall(low))
    return out


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, y, copy) for each distinct unit of each text; ``copy`` is alike for most near copies of a text."""
    begin(__name__)
    for whole in batches:
        for at in range(0, whole.num_rows, 128):
            part = whole.slice(at, 128)
            rows: list[tuple[bytes, int, int]] = []
            for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                units = {w for t in tokens_of(text) if (c := codes(t)) for w in windows(c)}
                copy = min((hash_unit(u) for u in units), default=0)
                rows.extend((u, y, copy) for u in units)
            columns = [*zip(*rows, strict=True)] or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], names=["unit", "y", "copy"])


def hash_unit(unit: bytes) -> int:
    return crc32(unit[::-1])


def _pair_rows(only: set[bytes] | None = None):
    """(unit, y, copy) for each distinct pair of neighbouring tokens of each text; of ``only`` these if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(__name__)
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                part = whole.slice(at, 128)
                rows: list[tuple[bytes, int, int]] = []
                for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    bodies = [b for t in (text or "").lower().split() if (b := body_of(t))]
                    units = {bytes([OPEN]) + a + b"\0" + b + bytes([CLOSE]) for a, b in zip(bodies, bodies[1:], strict=False) if len(a) + len(b) + 3 <= LONG}
                    copy = min((hash_unit(u) for u in units), default=0)
                    rows.extend((u, y, copy) for u in (units if only is None else units & only))
                columns = [*zip(*rows, strict=True)] or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], names=["unit", "y", "copy"])

    return run


def _counted(rows: DataFrame) -> DataFrame:
    """(unit, pos, neg): toxic and clean documents that hold a unit, near copies once."""
    return rows.distinct().groupBy("unit").agg(F.sum("y").cast("int").alias("pos"), F.sum(1 - F.col("y")).cast("int").alias("neg"))


def _shared(units: DataFrame, n: dict[int, int]) -> DataFrame:
    """Units that more toxic documents share than chance allows, with ``ratio``, the log-likelihood ratio of their share."""
    all_, part = F.col("pos") + F.col("neg"), n[1] / (n[0] + n[1])
    ratio = 2 * (F.col("pos") * F.log(F.col("pos") / (all_ * part)) + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / (all_ * (1 - part)))).otherwise(0.0))
    odds = (F.col("pos") + 0.1) / (n[1] + 1) / ((F.col("neg") + 0.1) / (n[0] + 1))
    return units.filter("pos > 0").withColumn("ratio", ratio).filter((odds > ODDS) & (F.col("ratio") > CHANCE))


def _pair_seeds(texts: DataFrame, n: dict[int, int], seeds: set[bytes]) -> list:
    """Pairs of tokens, neither of them a seed, that toxic documents share."""
    schema = "unit binary, y int, copy bigint"
    often = texts.filter("y = 1").mapInArrow(_pair_rows(), schema).distinct().groupBy("unit").count().filter("count > 4")
    found = {bytes(r["unit"]) for r in often.orderBy(F.desc("count"), "unit").limit(4 * UNITS).collect()}
    bodies = {s[1:-1] for s in seeds}
    found = {u for u in found if not any(b in bodies for b in u[1:-1].split(b"\0"))}
    if not found:
        return []
    return _shared(_counted(texts.mapInArrow(_pair_rows(found), schema)), n).orderBy(F.desc("ratio"), "unit").limit(UNITS).collect()


def _across_rows(pieces: np.ndarray):
    """(unit, y, copy) for each unit across the blanks of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(__name__)
        own = Scorer(np.zeros(1), 0.0, pieces=pieces)
        for whole in batches:
            rows = [(u, y, crc32((text or "").encode())) for text, y in zip(whole.column(0).to_pylist(), whole.column(1).to_pylist(), strict=True) for u in own.across(text)]
            columns = [*zip(*rows, strict=True)] or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], names=["unit", "y", "copy"])

    return run


def _scored_units(units: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    sent = units.sparkSession.sparkContext.broadcast((weights, bias))

    def make():
        score = Scorer(*sent.value)
        return lambda u: [pa.array(score.units(u.to_pylist()))]

    return add_columns(units, ["unit"], "margin double", make)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> dict | None:
    """Weights, bias and the logistic fit; None if a class has no usable unit."""
    texts = cut(training_texts(docs, labels, label, DOCUMENTS))
    found = texts.mapInArrow(_unit_rows, "unit binary, y int, copy bigint").distinct()
    units = cut(_counted(found))
    n = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
    if not (n.get(1) and n.get(0)):
        return None
    seeds = _shared(units, n).orderBy(F.desc("ratio"), "unit").limit(UNITS).collect()
    seeds += _pair_seeds(texts, n, {bytes(r["unit"]) for r in seeds})
    common = units.filter("neg > 0").orderBy(F.desc("neg"), "unit").limit(UNITS).collect()
    spread = units.filter("neg > 0").orderBy(F.xxhash64("unit"), "unit").limit(UNITS).collect()
    if not seeds or not common:
        return None
    seeds.sort(key=lambda r: -r["ratio"])
    toxic = {bytes(r["unit"]): float(np.sqrt(r["pos"])) for r in seeds}
    pieces = piece_table([*toxic][:TOXIC_LANDMARKS])
    wide = _counted(texts.mapInArrow(_across_rows(pieces), "unit binary, y int, copy bigint"))
    units = cut(units.unionByName(wide.join(units.select("unit"), "unit", "left_anti")))
    clean = [u for u in dict.fromkeys(bytes(r["unit"]) for r in [*common[:CLEAN_LANDMARKS], *spread, *common]) if u not in toxic]
    for more in (True, True, False):
        weights, bias = train_machine([*toxic], np.array([*toxic.values()]), clean)
        if more:
            scored = _scored_units(units, weights, bias).filter("margin > -0.5")
            hard = scored.filter("neg > 0").orderBy(F.desc("margin"), "unit").limit(UNITS).collect()
            clean = [u for u in dict.fromkeys([*clean, *(bytes(r["unit"]) for r in hard)]) if u not in toxic]
            alike = scored.filter("neg = 0 and margin > 0.5").orderBy(F.desc("margin"), "unit").limit(UNITS).collect()
            toxic = {bytes(r["unit"]): 0.5 for r in alike} | toxic
            toxic = dict(sorted(toxic.items(), key=lambda x: -x[1]))
    found = _features(texts, weights, bias, pieces).select("features", "y").toArrow()  # bounded by the sample
    x = np.asarray(found["features"].combine_chunks().values).reshape(-1, 8)
    return {"weights": weights, "bias": bias, "pieces": pieces, "curve": _logistic(x, found["y"].to_numpy())}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic fit; the last is the offset."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z, w = np.c_[(x - mean) / spread, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return np.r_[w[:-1] / spread, w[-1] - (w[:-1] * mean / spread).sum()]


def _features(df: DataFrame, weights: np.ndarray, bias: float, pieces: np.ndarray, text: str = "text", memory: int = MEMORY) -> DataFrame:
    """Append ``features``, the description of each text."""
    sent = df.sparkSession.sparkContext.broadcast((weights, bias, pieces))  # a weight per subsequence: 10 MB, whatever the input

    def make():
        weights, bias, pieces = sent.value
        score = Scorer(weights, bias, memory, pieces)

        def work(texts: pa.Array) -> list[pa.Array]:
            rows = score.documents(texts.to_pylist())
            return [pa.ListArray.from_arrays(np.arange(0, rows.size + 1, 8, dtype=np.int32), pa.array(rows.ravel()))]

        return work

    return add_columns(df, [text], "features array<double>", make)


def score_toxicity(df: DataFrame, model: dict | None, text: str = "text", memory: int = MEMORY) -> DataFrame:
    """Append ``score`` (0 to 1, higher is more toxic) and ``predicted`` (1 from 0.5 on) to every row; ``memory`` bounds the tokens a worker remembers."""
    if model is None:
        return df.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    described = _features(df, model["weights"], model["bias"], model["pieces"], text, memory)
    sums = sum((F.element_at("features", i + 1) * float(w) for i, w in enumerate(model["curve"][:-1])), F.lit(float(model["curve"][-1])))
    score = 1 / (1 + F.exp(-F.greatest(F.least(sums, F.lit(35.0)), F.lit(-35.0))))
    return described.withColumn("score", score).drop("features").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    model = train(docs, labels)
    return score_toxicity(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
