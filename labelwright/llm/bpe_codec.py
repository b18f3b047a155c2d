"""BPE encoding and decoding by a pair occurrence index.

The words of a batch that have not been seen before are laid out one after the
other as symbols.  An index maps every adjacent pair that is a merge to all its
positions in the batch.  The active ranks are applied in ascending order: all
positions of the lowest one are merged, and only the lists of the neighbouring
pairs are updated.

Defined cases: a null or empty text has no ids and decodes to an empty text;
repeated rows are encoded each; the string of an added token inside a text is
that token; texts of any length are encoded whole; an empty table gives an empty one; other columns
are passed through, and a column named like a result is replaced.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush
from unicodedata import category, normalize

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import add_columns, keeps
from .token_count import SPACE, Splitter, byte_letters

# The words of the vocabulary's split rule.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|[L]+|[N]|[^{SPACE}LN]+"
#: Chunks kept per Python worker before the memory of ids is emptied, about 250 bytes each.
MEMORY = 800_000
#: Characters at which Python's own split and the vocabulary's white space differ.
ODD_SPACE = re.compile("[\x1c-\x1f]")


class Codec:
    """Encodes and decodes with a word vocabulary; remembers the ids of chunks already seen."""

    def __init__(self, path: str, memory: int = MEMORY):
        self.memory = memory
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = [vocab[letters[b]] for b in range(256)]
        self.final = [vocab[letters[b] + self.end] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        birth: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            whole = vocab[a + b]
            self.merges.setdefault((vocab[a], vocab[b]), (rank, whole))
            birth.setdefault(whole, rank)
        for (a, b), (rank, _) in self.merges.items():
            if max(birth.get(a, -1), birth.get(b, -1)) >= rank:
                raise ValueError("a merge precedes the merge that makes one of its parts: ranks can't be applied in order")
        added = spec.get("added_tokens") or []
        self.special = {t["content"]: t["id"] for t in added}
        names = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in added}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if added else None
        self.words = Splitter(path, WORDS)
        self.normal = Tokenizer.from_file(path).normalizer.normalize_str
        self.spaces = regex.compile(f"[{SPACE}]+")
        self.chunks: dict[str, bytes] = {}  # ids as int32

    def apply(self, words: list[str]) -> list[bytes]:
        """Ids of each word; all words share one pair occurrence index."""
        symbols: list[int] = []
        starts: list[int] = []
        for w in words:
            data = w.encode("utf-8", "surrogatepass")
            starts.append(len(symbols))
            symbols.extend(map(self.inner.__getitem__, data[:-1]))
            symbols.append(self.final[data[-1]])
            symbols.append(-1)  # ends a word; no pair reaches across
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = self.merges
        positions: dict[tuple[int, int], list[int]] = {}
        for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)):
            if pair in merges:
                positions.setdefault(pair, []).append(i)
        active = [(merges[p][0], p) for p in positions]
        heapify(active)
        while active:
            _, pair = heappop(active)
            a, b = pair
            whole = merges[pair][1]
            for i in sorted(positions.pop(pair)):  # from left to right, as in "aaa"
                j = after[i]
                if symbols[i] != a or j >= n or symbols[j] != b:
                    continue
                symbols[i], symbols[j] = whole, -2
                k = after[i] = after[j]
                before[k] = i
                for at, new in ((before[i], (symbols[before[i]], whole) if before[i] >= 0 else None), (i, (whole, symbols[k]))):
                    if new in merges:
                        if new in positions:
                            positions[new].append(at)
                        else:
                            positions[new] = [at]
                            heappush(active, (merges[new][0], new))
        out = []
        for i in starts:
            ids = []
            while symbols[i] != -1:
                ids.append(symbols[i])
                i = after[i]
            out.append(array("i", ids).tobytes())
        return out

    def split(self, text: str) -> list[str]:
        if ODD_SPACE.search(text):
            return [c for c in self.spaces.split(text) if c]
        return text.split()

    def parts(self, text: str) -> list[str]:
        """The text cut at added tokens, these included."""
        if self.cut is None or not any(t in text for t in self.special):
            return [text]
        return [p for p in self.cut.split(text) if p]

    def lower(self, chunk: str) -> str:
        """NFC and lower case, letter by letter; the library is asked where this Python's Unicode is too old."""
        if chunk.isascii():
            return chunk.lower()
        if any(category(c) == "Cn" for c in chunk):
            return self.normal(chunk)
        chunk = normalize("NFC", chunk)
        return "".join(map(str.lower, chunk)) if "Σ" in chunk else chunk.lower()

    def learn(self, chunks: set[str]) -> None:
        """Encode chunks not seen before; a chunk that is a lower-case word serves as that word later."""
        known, ids, split = self.chunks, {}, {}
        for c in chunks:
            words = split[c] = self.words(self.lower(c))
            for w in words:
                if w not in ids:
                    ids[w] = known.get(w) if w.isascii() else None
        fresh = [w for w, x in ids.items() if x is None]
        ids.update(zip(fresh, self.apply(fresh), strict=True))
        for c, ws in split.items():
            known[c] = ids[ws[0]] if len(ws) == 1 else b"".join(map(ids.__getitem__, ws))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as int32."""
        if len(self.chunks) > self.memory:
            self.chunks.clear()
        cut = [[(p, None) if p in self.special else (p, self.split(p)) for p in self.parts(t)] if t else [] for t in texts]
        fresh: set[str] = set()
        for parts in cut:
            for _, chunks in parts:
                if chunks:
                    fresh.update(chunks)
        fresh = {c for c in fresh if c not in self.chunks}
        if fresh:
            self.learn(fresh)
        known = self.chunks.__getitem__
        out = []
        for parts in cut:
            out.append(b"".join(array("i", [self.special[p]]).tobytes() if chunks is None else b"".join(map(known, chunks)) for p, chunks in parts))
        return out

    def decode(self, ids) -> str:
        """The tokens joined by blanks: the vocabulary names no decoder."""
        return " ".join(map(self.names.__getitem__, ids))


@keeps
@lru_cache(1)
def codec(path: str, memory: int = MEMORY) -> Codec:
    """One codec per worker process; the process keeps it from task to task."""
    return Codec(path, memory)


def encode_texts(df: DataFrame, vocabulary: str, text: str = "text", memory: int = MEMORY) -> DataFrame:
    """Append ``ids`` (array of int) to every row; ``memory`` bounds the chunks whose ids a worker remembers."""

    def make():
        encode = codec(vocabulary, memory).encode

        def work(texts: pa.Array) -> list[pa.Array]:
            rows = encode(texts.to_pylist())
            ends = np.cumsum([0, *(len(r) // 4 for r in rows)]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), np.int32)))]

        return work

    return add_columns(df, [text], "ids array<int>", make)


def decode_ids(df: DataFrame, vocabulary: str, ids: str = "ids", memory: int = MEMORY) -> DataFrame:
    """Append ``decoded``, the text of the ids with special tokens kept; null ids give an empty text."""

    def make():
        decode = codec(vocabulary, memory).decode

        def work(arrays: pa.Array) -> list[pa.Array]:
            return [pa.array([decode(row) if row else "" for row in arrays.to_pylist()], pa.string())]

        return work

    return add_columns(df, [ids], "decoded string", make)


def round_trip(df: DataFrame, vocabulary: str, text: str = "text", memory: int = MEMORY) -> DataFrame:
    """Append ``ids`` and ``decoded``, the text of these ids, as ``encode_texts`` and ``decode_ids`` do, in one pass of a worker."""

    def make():
        own = codec(vocabulary, memory)

        def work(texts: pa.Array) -> list[pa.Array]:
            rows = [np.frombuffer(r, np.int32) for r in own.encode(texts.to_pylist())]
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            ids = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32))
            return [pa.ListArray.from_arrays(pa.array(ends), ids), pa.array([own.decode(r.tolist()) for r in rows], pa.string())]

        return work

    return add_columns(df, [text], "ids array<int>, decoded string", make)
