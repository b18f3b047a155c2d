"""Periodic runs of words in each text: unite suffix classes by decreasing LCP.

A run is a stretch of words whose words a smallest period ``q`` apart are identical, that is at
least ``least`` words and two periods long, and that no neighbouring word extends.

A run of period q that starts at s is the pair of suffixes (s, s + q): their longest
common prefix is the run's length less q, so it is no shorter than their distance.
No suffix between the two shares that much with them, or the run had a smaller period.  So the
method is Kruskal's on the suffixes' LCPs: in decreasing order of LCP, union-find
unites the classes of suffixes that share so many words; each class is an ordered set of
positions, and the smaller set is put into the larger.  Two positions that become
neighbours in a class at a distance of at most the LCP seed a run; it is one if
the words before them differ.

Only suffixes whose first ``least / 2`` words come again in their text, no farther away than
repeats go on, can be in such a pair, so the others never enter.  The suffix classes come from
doubling the compared length; equality is decided on numbers of words, never on hashes alone.
Every text is handled whole and by itself; a task handles about ``WORDS`` words at a time, or one longer
text (its memory is some hundred bytes a word).

Defined cases: a null or empty text, or one without words, has no words, no run and an empty
collapsed text; texts of any length are read whole; repeated rows get equal results; an
empty table gives an empty one; columns that clash with the new ones are replaced.
Of equal runs there are none: a start and a period belong to one run.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import add_columns

#: Words that a task handles at a time.
WORDS = 400_000
#: Shortest run by default.
LEAST = 12
SCHEMA = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def numbered(texts: list[list[bytes]]) -> np.ndarray:
    """The words of all texts as numbers: equal only for equal words of the same text."""
    parts, base = [np.zeros(0, np.int64)], 0
    for words in texts:
        last = dict(zip(words, range(base, base + len(words)), strict=True))
        parts.append(np.fromiter(map(last.__getitem__, words), np.int64, len(words)))
        base += len(words)
    return np.concatenate(parts)


def _grams(ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions, ascending, whose next ``width`` words occur more than once, and a number for those words."""
    n = len(ids) - width + 1
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = np.zeros(n, np.uint64)
    for k in range(width):
        mixed = (mixed ^ ids[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    slots = (mixed & np.uint64((1 << max(n * 8 - 1, 1).bit_length()) - 1)).astype(np.int64)
    at = np.flatnonzero(np.bincount(slots)[slots] > 1)
    order = np.argsort(mixed[at], kind="stable")
    equal = np.diff(mixed[at][order]) == 0
    at = np.sort(at[order[np.r_[False, equal] | np.r_[equal, False]]]) if len(at) else at
    gram = ids[at]
    for k in range(1, width):
        gram = np.unique(gram * len(ids) + ids[at + k], return_inverse=True)[1]
    return at, gram


def _blocks(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position its stretch of consecutive positions, and the last position of that."""
    ends = np.flatnonzero(np.r_[np.diff(at) != 1, True])
    block = np.searchsorted(ends, np.arange(len(at)))
    return block, at[ends[block]]


class Suffixes:
    """Suffixes at some positions, ranked by their first words in the order of numbers; ``width``, the words compared, is doubled until all differ.

    ``at`` holds whole stretches of positions whose next words come again, ``last`` the last of each stretch.  Equal suffixes
    end their common prefix at most ``width`` past a stretch, so these positions are ranked too, by their first words only.
    """

    def __init__(self, ids: np.ndarray, at: np.ndarray, last: np.ndarray, width: int):
        n = len(ids)
        past = (last[:, None] + np.arange(1, width + 1)).ravel()
        self.ids, self.at = ids, np.union1d(at, past[past <= n])
        self.slot = np.full(n + 1, -1, np.int64)
        self.slot[self.at] = np.arange(len(self.at))
        self.inner = np.zeros(len(self.at) + 1, bool)  # the last one stands for no position
        self.inner[self.slot[at]] = True
        padded = np.r_[ids + 1, np.zeros(width + 1, np.int64)]
        gram = padded[self.at]
        for k in range(1, width):
            gram = np.unique(gram * (n + 1) + padded[self.at + k], return_inverse=True)[1]
        size = np.bincount(gram)
        rank = (np.cumsum(size) - size)[gram]
        self.levels = [(width, rank)]
        active = self.slot[at]
        active = active[np.bincount(gram[active], minlength=len(size))[gram[active]] > 1]
        while len(active):
            follow = rank[self.slot[self.at[active] + width]]
            order = np.lexsort((follow, rank[active]))
            active, follow, base = active[order], follow[order], rank[active[order]]
            first = np.r_[True, np.diff(base) != 0]
            new = first | np.r_[True, np.diff(follow) != 0]
            place = np.arange(len(active))
            start = np.maximum.accumulate(np.where(first, place, 0))
            rank = rank.copy()
            rank[active] = base + np.maximum.accumulate(np.where(new, place, 0)) - start
            active = active[~(new & np.r_[new[1:], True])]
            width *= 2
            self.levels.append((width, rank))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``a`` and at ``b``."""
        total, n = np.zeros(len(a), np.int64), len(self.ids)
        a, b = a.copy(), b.copy()
        for width, rank in reversed(self.levels):
            x, y = self.slot[np.minimum(a, n)], self.slot[np.minimum(b, n)]
            step = (self.inner[x] & self.inner[y] & (rank[x] == rank[y])) * width
            total, a, b = total + step, a + step, b + step
        open_ = np.ones(len(a), bool)
        for _ in range(self.levels[0][0] - 1):
            open_ &= (np.maximum(a, b) < n) & (self.ids[np.minimum(a, n - 1)] == self.ids[np.minimum(b, n - 1)])
            total, a, b = total + open_, a + open_, b + open_
        return total


def unite(order: list[int], lcp: list[int], least: int) -> list[tuple[int, int, int]]:
    """(i, j, l): positions that become neighbours in a class of LCP ``l`` at a distance of at most ``l``.

    ``order`` holds the positions of suffixes so that each class is a stretch of it, ``lcp`` the LCPs of
    neighbours there; those below ``least`` are left alone.
    """
    root, sets, found = list(range(len(order))), [[p] for p in order], []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for edge in sorted((k for k, shared in enumerate(lcp) if shared >= least), key=lambda k: -lcp[k]):
        a, b, shared = find(edge), find(edge + 1), lcp[edge]
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large, small = sets[a], sets[b]
        places = [bisect_left(large, p) for p in small]
        for k, (p, place) in enumerate(zip(small, places, strict=True)):
            if place and p - large[place - 1] <= shared and (k == 0 or small[k - 1] < large[place - 1]):
                found.append((large[place - 1], p, shared))
            if place < len(large) and large[place] - p <= shared and (k + 1 == len(small) or small[k + 1] > large[place]):
                found.append((p, large[place], shared))
        if len(small) > 16:
            large += small
            large.sort()  # two ascending stretches: one pass
        else:
            for p, place in zip(reversed(small), reversed(places), strict=True):
                large.insert(place, p)
        root[b], sets[b] = a, None
    return found


def find_runs(ids: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period."""
    width = max(1, (least + 1) // 2)
    at, gram = _grams(ids, width)
    if not len(at):
        return np.zeros((0, 3), np.int64)
    order = np.argsort(gram, kind="stable")
    gap = np.where(np.diff(gram[order]) == 0, np.diff(at[order]), len(ids))
    near = np.empty(len(at), np.int64)
    near[order] = np.minimum(np.r_[gap, len(ids)], np.r_[len(ids), gap])
    block, last = _blocks(at)
    able = near <= last - at + width
    used = np.zeros(block[-1] + 1, bool)
    used[block[able]] = True
    within = used[block]
    if not within.any():
        return np.zeros((0, 3), np.int64)
    suffixes = Suffixes(ids, at[within], np.unique(last[within]), width)
    able = at[able]
    ranked = able[np.argsort(suffixes.levels[-1][1][suffixes.slot[able]])]
    pairs = unite(ranked.tolist(), suffixes.common(ranked[:-1], ranked[1:]).tolist(), width)
    i, j, shared = np.array(pairs, np.int64).reshape(-1, 3).T
    starts = (j - i + shared >= least) & ((i == 0) | (ids[i - 1] != ids[j - 1]))
    runs = np.c_[i, j - i + shared, j - i][starts]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _described(texts: list[list[bytes]], least: int) -> tuple[list[np.ndarray], list[bytes]]:
    """Runs and collapsed text of each text."""
    ids = numbered(texts)
    edges = np.cumsum([0, *map(len, texts)])
    runs = find_runs(ids, least)
    turn = np.zeros(len(ids) + 1, np.int64)
    np.add.at(turn, runs[:, 0] + runs[:, 2], 1)
    np.add.at(turn, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(turn)[:-1] == 0
    cuts = np.searchsorted(runs[:, 0], edges)
    found, kept = [], []
    for k, words in enumerate(texts):
        own = runs[cuts[k] : cuts[k + 1]].copy()
        own[:, 0] -= edges[k]
        found.append(own)
        kept.append(b" ".join(compress(words, keep[edges[k] : edges[k + 1]].tolist()) if len(own) else words))
    return found, kept


def describe(texts: list[bytes | None], least: int = LEAST) -> tuple[list[int], list[np.ndarray], list[bytes]]:
    """Number of words, runs and collapsed text of each text (UTF-8), some texts at a time."""
    sizes, runs, kept, part, held = [], [], [], [], 0
    for k, text in enumerate(texts):
        part.append(text.split() if text else [])  # bytes are cut at blanks and the five ASCII line and tab signs
        sizes.append(len(part[-1]))
        held += sizes[-1]
        if held >= WORDS or k + 1 == len(texts):
            more = _described(part, least)
            runs += more[0]
            kept += more[1]
            part, held = [], 0
    return sizes, runs, kept


def periodic_runs(df: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """Append ``n_words``, ``runs`` (by start, then period) and ``collapsed``, the words that no run repeats, joined by blanks."""

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            sizes, runs, kept = describe(texts.cast(pa.binary()).to_pylist(), least)
            flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
            items = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
            offsets = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
            return [pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, items), pa.array(kept, pa.binary()).cast(pa.string())]

        return work

    return add_columns(df, [text], SCHEMA, make)
