"""Token counts of a byte-level BPE vocabulary, by heap-and-linked-list merging.

The symbols of a piece are its bytes, chained in a linked list.  A heap holds the
adjacent pairs that are merges, lowest rank first; each pop joins two neighbours
and pushes the pairs that arise.  The count of a piece is the number of its bytes
minus the number of merges, so no identifiers are made.

Defined cases: a null or empty text has 0 tokens and 0 bytes; repeated rows are
counted each; the string of an added token inside a text counts as one token,
as the library treats it by default; texts of any length are counted whole; an empty table gives an
empty one; other columns are passed through, and a column named like a result is replaced.
"""

from __future__ import annotations

import json
import sys
from functools import lru_cache
from heapq import heapify, heappop, heappush
from unicodedata import category

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import add_columns, keeps

# The Unicode white space of the split pattern, and the pattern itself.
SPACE = "\t-\r \x85\xa0  -     　"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[L]+| ?[N]+| ?[^{SPACE}LN]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Entries kept per Python worker before the memory of counts is emptied.
MEMORY = 1_200_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + i)
    return letters


def runs(letters: list[str]) -> str:
    """A character class body that matches just these characters."""
    out, at = [], 0
    while at < len(letters):
        end = at
        while end + 1 < len(letters) and ord(letters[end + 1]) == ord(letters[end]) + 1:
            end += 1
        out.append(f"{letters[at]}-{letters[end]}")
        at = end + 1
    return "".join(out)


class Splitter:
    """Finds the pieces of a text as the library's pattern does.

    Pattern module and library may know different versions of Unicode.  For characters
    that this Python does not know yet, but the pattern module does, the library is
    asked whether it takes them for letters or numbers.
    """

    def __init__(self, path: str, pattern: str):
        asked = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        known = regex.compile(r"[\p{L}\p{N}]").match
        new = [c for i in range(0x80, sys.maxunicode + 1) if category(c := chr(i)) == "Cn" and known(c)]
        letters = [c for c in new if len(asked("a" + c)) == 1]
        others = [c for c in new if len(asked("!" + c)) == 1]
        numbers = sorted({*new} - {*letters} - {*others})
        usual = pattern.replace("L", r"\p{L}").replace("N", r"\p{N}")
        lacks, has = (runs(x) for x in (new, letters))
        letter = rf"[\p{{L}}--[{lacks}]]" if new else r"\p{L}"
        number = rf"[\p{{N}}--[{lacks}]]" if new else r"\p{N}"
        rare = pattern.replace("L", letter + has).replace("N", number + runs(numbers))
        self.usual, self.rare = regex.compile(usual).findall, regex.compile(rare, regex.V1).findall
        self.new = regex.compile(f"[{lacks}]").search if new else lambda _: None

    def __call__(self, text: str) -> list[str]:
        return self.usual(text) if text.isascii() or not self.new(text) else self.rare(text)


class Counter:
    """Counts tokens; remembers counts of pieces already seen."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids: dict[str, int] = {}

        def number(symbol: str) -> int:
            return ids.setdefault(symbol, len(ids))

        letters = byte_letters()
        self.first = [number(letters[b]) for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((number(a), number(b)), (rank, number(a + b)))
        added = [t["content"] for t in spec.get("added_tokens") or []]
        self.added = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.added_texts = added
        self.pieces = Splitter(path, PIECES)
        self.two_spaces = regex.compile(rf"[{SPACE}]{{2}}").search
        self.counts: dict[str, int] = {}

    def piece(self, text: str) -> int:
        """Tokens of one piece: symbols minus merges."""
        symbols = [self.first[b] for b in text.encode("utf-8", "surrogatepass")]
        n = len(symbols)
        if n < 2:
            return n
        merges = self.merges.get
        heap = [(m[0], i, m[1]) for i in range(n - 1) if (m := merges((symbols[i], symbols[i + 1])))]
        if not heap:
            return n
        heapify(heap)
        after = list(range(1, n + 1))  # the neighbour to the right; n ends the list
        before = list(range(-1, n - 1))
        made = 0
        while heap:
            rank, i, whole = heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j >= n or (m := merges((symbols[i], symbols[j]))) is None or m[0] != rank:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = whole, -1
            k = after[i] = after[j]
            made += 1
            if k < n:
                before[k] = i
                if m := merges((whole, symbols[k])):
                    heappush(heap, (m[0], i, m[1]))
            h = before[i]
            if h >= 0 and (m := merges((symbols[h], whole))):
                heappush(heap, (m[0], h, m[1]))
        return n - made

    def chunk(self, text: str) -> int:
        """Tokens of a text without added tokens, each piece on its own."""
        known, total = self.counts, 0
        for p in self.pieces(text):
            n = known.get(p)
            if n is None:
                n = self.piece(p)
                if len(p) < 64:
                    known[p] = n
            total += n
        return total

    def plain(self, text: str) -> int:
        """Tokens of a text without added tokens.

        Where no two spaces are adjacent, a blank always opens the piece that follows it,
        so the text can be cut before every blank.
        """
        if not text:
            return 0
        if len(self.counts) > MEMORY:
            self.counts.clear()
        if self.two_spaces(text):
            return self.chunk(text)
        known = self.counts
        first, *rest = text.split(" ")
        total = self.chunk(first)
        for w in rest:
            n = known.get(w := " " + w)
            if n is None:
                n = self.chunk(w)
                if len(w) < 64:
                    known[w] = n
            total += n
        return total

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        if self.added is None or not any(t in text for t in self.added_texts):
            return self.plain(text)
        found = len(self.added.findall(text))
        return found + sum(map(self.plain, self.added.split(text)))


@keeps
@lru_cache(2)
def counter(path: str) -> Counter:
    """One counter per worker process and vocabulary; the process keeps it from task to task."""
    return Counter(path)


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """Append ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) to every row.

    ``vocabulary`` is the path of a byte-level BPE file, present on every worker.
    """

    def make():
        count = counter(vocabulary).text

        def work(texts: pa.Array) -> list[pa.Array]:
            values = texts.to_pylist()
            tokens = [count(t) for t in values]
            return [
                pa.array([len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in values], pa.int64()),
                pa.array(tokens, pa.int64()),
                pa.array([n > limit for n in tokens], pa.bool_()),
            ]

        return work

    return add_columns(df, [text], "n_bytes bigint, n_tokens bigint, over_limit boolean", make)
