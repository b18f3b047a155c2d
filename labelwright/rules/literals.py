"""Literals that a pattern needs, derived from its structure.

``needed(pattern)`` is a set of lower-case texts one of which occurs in every text that the pattern
matches, ignoring case.  Looking for a few literals costs far less than running the pattern, so a scan
asks for them first.  A pattern without such a set (digits only, say) gives None and is always run.
"""

from __future__ import annotations

from functools import lru_cache
from re import _constants as K
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings kept for one stretch of a pattern, and literals looked for before a pattern.
SPELLINGS = 48
MOST = 12
SHORTEST = 2
#: Least length to which a literal is cut.
ENOUGH = 4
# Letters from rare to frequent.
RARE_FIRST = "zqxjkvbygpfwmculdrhsnioate"
# Letters beyond ASCII that equal an ASCII letter when case is ignored.
FOLDED = str.maketrans({"İ": "i", "ı": "i", "ſ": "s", "K": "k"})


def folded(text: Column) -> Column:
    """Lower case in which every letter that a pattern takes for an ASCII letter is that letter."""
    special = text.contains("İ") | text.contains("ı") | text.contains("ſ") | text.contains("\u212a")
    return F.lower(F.when(special, F.translate(text, "İıſ\u212a", "iisk")).otherwise(text))


def _better(a: frozenset | None, b: frozenset | None) -> frozenset | None:
    """Of two needed sets the one with the longer shortest literal, then with fewer."""
    if a is None or b is None:
        return a or b
    return max(a, b, key=lambda s: (min(min(map(len, s)), 5), -len(s)))


def _spellings(item) -> frozenset | None:
    """All texts that an item stands for, if these are few."""
    op, value = item
    if op is K.LITERAL:
        return frozenset([chr(value).translate(FOLDED).lower()])
    if op is K.IN and all(o is K.LITERAL for o, _ in value):
        return frozenset(chr(v).translate(FOLDED).lower() for _, v in value)
    if op is K.AT or op is K.ASSERT or op is K.ASSERT_NOT:
        return frozenset([""])
    if op is K.SUBPATTERN:
        return _all_spellings(value[-1])
    if op is K.BRANCH:
        each = [_all_spellings(b) for b in value[1]]
        return None if None in each else frozenset().union(*each)
    if op in (K.MAX_REPEAT, K.MIN_REPEAT) and value[1] <= 1:
        once = _all_spellings(value[2])
        return None if once is None else once | ({""} if value[0] == 0 else set())
    return None


def _all_spellings(items) -> frozenset | None:
    out = frozenset([""])
    for item in items:
        each = _spellings(item)
        if each is None or len(out) * len(each) > SPELLINGS:
            return None
        out = frozenset(a + b for a in out for b in each)
    return out


def _inside(item) -> frozenset | None:
    """A needed set of an item whose spellings are too many."""
    op, value = item
    if op is K.SUBPATTERN:
        return _needed(value[-1])
    if op is K.BRANCH:
        each = [_needed(b) for b in value[1]]
        return None if None in each else frozenset().union(*each)
    if op in (K.MAX_REPEAT, K.MIN_REPEAT) and value[0] >= 1:
        return _needed(value[2])
    return None


def _needed(items) -> frozenset | None:
    best, stretch = None, frozenset([""])

    def close():
        return frozenset(stretch) if all(len(s) >= SHORTEST or (s and not s.isascii()) for s in stretch) else None

    for item in items:
        each = _spellings(item)
        if each is not None and len(stretch) * len(each) <= SPELLINGS:
            # an optional item does not spoil a stretch that stands before it
            best = _better(best, close()) if "" in each else best
            stretch = frozenset(a + b for a in stretch for b in each)
            continue
        best = _better(best, close())
        stretch = each if each is not None else frozenset([""])
        if each is None:
            best = _better(best, _inside(item))
    return _better(best, close())


@lru_cache(maxsize=1024)
def needed(pattern: str) -> tuple[str, ...] | None:
    found = _needed(_parser.parse(pattern))
    if found is None:
        return None
    # a literal that holds another is found with it
    found = {s for s in found if not any(o != s and o in s for o in found)}
    return tuple(sorted(found)) if len(found) <= MOST else None


def sought(word: str) -> str:
    """The part of a literal that is looked for: from its rarest letter on, since every place of a text that holds the first is compared."""
    starts = range(max(1, len(word) - ENOUGH + 1))
    return word[min(starts, key=lambda i: RARE_FIRST.find(word[i])) :] if word.isalpha() and word.isascii() else word


def may_match(low: Column, pattern: str) -> Column | None:
    """Whether the folded text holds a literal that the pattern needs; None if it needs none."""
    words = needed(pattern)
    if words is None:
        return None
    words = list(dict.fromkeys(map(sought, words)))
    hit = low.contains(words[0])
    for w in words[1:]:
        hit = hit | low.contains(w)
    return hit
