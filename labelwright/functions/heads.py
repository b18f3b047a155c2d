"""How a match of a pattern can begin, derived from the pattern's structure.

The regular-expression engine tries every alternative of a pattern at every character of a text.  A lookahead with the
few characters that can stand first, second and third turns almost all of these places down at once, and
changes no match: every match begins with them.
"""

from __future__ import annotations

import re
from functools import lru_cache
from re import PatternError
from re import _constants as K
from re import _parser

#: Characters looked at, beginnings of a pattern kept apart, and characters of one place.
DEPTH = 3
HEADS = 512
WIDEST = 64
# Letters beyond ASCII that equal an ASCII letter when case is ignored.
LIKE_ASCII = {"i": "\u0130\u0131", "s": "\u017f", "k": "\u212a"}
_SPECIAL = set("\\^-[]&~|#$.*+?(){}")
#: Alternatives from which on those that begin alike are put together.
FEWEST = 4
_CLASS = re.compile(r"\[\^?\]?(?:[^\]\[\\]|\\.)*\]")
_FIRST = re.compile(r"(?:\[(?:[^\]\[\\^]|\\.)+\]|\\[./?+*()|$^-]|[A-Za-z0-9/_<>\"' ,:;%₹-])(?![?*+{])")
_OFTEN = re.compile(r"(?:[?*+]|\{\d+(?:,\d*)?\})?\??")
# possessive repeats and atomic groups do not give back what they took
_OWNS = re.compile(r"[?*+}]\+|\(\?>|\(\?[a-zA-Z]*x|\\[NpPxu0]")
_REFERS = re.compile(r"\\[1-9]|\(\?[a-zA-Z-]+[:)]|\(\?P|\\Q")
#: A head is the sets of its first characters, and whether what follows them is known.
Head = tuple[tuple[frozenset, ...], bool]
_UNKNOWN: frozenset = frozenset([((), False)])


def _cases(ch: str) -> frozenset | None:
    """The characters that equal ``ch`` when case is ignored; None if that is not plain."""
    if ch.isascii():
        low = ch.lower()
        return frozenset(low + ch.upper() + LIKE_ASCII.get(low, ""))
    return frozenset(ch) if ch.lower() == ch.upper() and ord(ch) < 0xD800 else None


def _one_of(members) -> frozenset | None:
    """The characters of a class, if they are few and listed."""
    out: set = set()
    for op, value in members:
        if op is K.LITERAL:
            chars = [value]
        elif op is K.RANGE and value[1] - value[0] < WIDEST:
            chars = range(value[0], value[1] + 1)
        else:
            return None
        for c in chars:
            cases = _cases(chr(c))
            if cases is None:
                return None
            out |= cases
    return frozenset(out) if len(out) <= WIDEST else None


def _joined(first: frozenset, then) -> frozenset:
    """Heads of one thing followed by another, whose heads ``then`` gives if they are asked for."""
    out: set = set()
    for chars, known in first:
        if not known or len(chars) >= DEPTH:
            out.add((chars[:DEPTH], False))
        else:
            out |= {((*chars, *more)[:DEPTH], k and len(chars) + len(more) < DEPTH) for more, k in then()}
    return frozenset(out) if len(out) <= HEADS else frozenset((c[:1], False) for c, _ in out)


def _item_heads(item) -> frozenset:
    op, value = item
    if op is K.LITERAL:
        cases = _cases(chr(value))
        return _UNKNOWN if cases is None else frozenset([((cases,), True)])
    if op is K.IN:
        chars = _one_of(value)
        return _UNKNOWN if chars is None else frozenset([((chars,), True)])
    if op in (K.AT, K.ASSERT, K.ASSERT_NOT):
        return frozenset([((), True)])
    if op is K.SUBPATTERN:
        return _heads(value[-1])
    if op is K.BRANCH:
        return frozenset().union(*[_heads(b) for b in value[1]])
    if op in (K.MAX_REPEAT, K.MIN_REPEAT):
        least, most, body = value
        once = _heads(body)
        out = frozenset([((), True)])
        for _ in range(min(least, DEPTH)):
            out = _joined(out, lambda: once)
        if most != least:
            # more rounds may follow, or none; what follows a further round is not looked at
            more = _joined(out, lambda: frozenset((c, False) for c, _ in once))
            out = out | more
        elif least > DEPTH:
            out = frozenset((c, False) for c, _ in out)
        return out
    return _UNKNOWN


def _heads(items) -> frozenset:
    out = frozenset([((), True)])
    for item in items:
        if not any(known and len(chars) < DEPTH for chars, known in out):
            break
        out = _joined(out, lambda item=item: _item_heads(item))
    return out


def _split(pattern: str) -> list[str] | None:
    """The alternatives of a pattern; None where brackets nest in a way that is not plain."""
    out, start, depth, i = [], 0, 0, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 1
        elif ch == "[":
            end = _CLASS.match(pattern, i)
            if end is None:
                return None
            i = end.end() - 1
        elif ch in "()":
            depth += 1 if ch == "(" else -1
        elif ch == "|" and depth == 0:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*out, pattern[start:]] if depth == 0 else None


def _shared(alternatives: list[str]) -> str:
    """An alternation in which alternatives that begin alike stand together behind their common beginning."""
    groups: dict[str, list[str]] = {}
    for i, alternative in enumerate(alternatives):
        first = _FIRST.match(alternative)
        key, rest = (first.group(0), alternative[first.end() :]) if first else (f"\0{i}", alternative)
        groups.setdefault(key, []).append(rest)
    parts = []
    for key, rests in groups.items():
        head = "" if key.startswith("\0") else key
        inner = rests[0] if len(rests) == 1 else _shared(rests)
        parts.append(head + (inner if len(rests) == 1 or len(_split(inner) or ()) == 1 else f"(?:{inner})"))
    return "|".join(parts)


def _atoms(pattern: str) -> list[tuple[str, str]] | None:
    """The parts of one alternative, each with its quantifier; None where that is not plain."""
    out, i = [], 0
    while i < len(pattern):
        start, ch = i, pattern[i]
        if ch == "\\":
            i += 2
        elif ch == "[":
            end = _CLASS.match(pattern, i)
            if end is None:
                return None
            i = end.end()
        elif ch == "(":
            depth = 0
            while i < len(pattern):
                if pattern[i] == "\\":
                    i += 1
                elif pattern[i] == "[":
                    end = _CLASS.match(pattern, i)
                    if end is None:
                        return None
                    i = end.end() - 1
                elif pattern[i] in "()":
                    depth += 1 if pattern[i] == "(" else -1
                    if depth == 0:
                        break
                i += 1
            i += 1
        else:
            i += 1
        often = _OFTEN.match(pattern, i)
        out.append((pattern[start:i], often.group(0)))
        i = often.end()
    return out


def _inside(atom: str) -> str | None:
    """What a plain group holds."""
    if not atom.startswith("("):
        return None
    return atom[3:-1] if atom.startswith("(?:") else None if atom.startswith("(?") else atom[1:-1]


def _least(often: str) -> int:
    return {"": 1, "?": 0, "*": 0, "+": 1}.get(often[:1], None) if often[:1] != "{" else int(often[1:].split(",")[0].rstrip("}?") or 0)


def _lean(pattern: str, first: bool) -> str:
    """The alternatives, each with the repeats at one of its ends cut to their least number.

    A text that holds X{3}Y holds X{1}Y from the last X on, and one that holds YX{3} holds YX{1}.
    """
    alternatives = _split(pattern)
    if alternatives is None:
        return pattern
    out = []
    for alternative in alternatives:
        atoms = _atoms(alternative)
        if atoms is None:
            return pattern
        while atoms:
            at = 0 if first else -1
            atom, often = atoms[at]
            if often and _least(often) == 0:
                del atoms[at]
                continue
            inner = _inside(atom) if _least(often) == 1 else None
            cut = atom if inner is None else f"(?:{_lean(inner, first)})"
            atoms[at] = (cut, "" if _least(often) == 1 else "{%d}" % _least(often))
            break
        out.append("".join(a + q for a, q in atoms))
    return "|".join(out)


def _headed(pattern: str) -> str:
    """A lookahead before each inner choice, whose alternatives stand together by their beginnings: they are not tried one by one."""
    atoms = [_atoms(a) for a in _split(pattern) or ()]
    if not atoms or None in atoms:
        return pattern
    out = []
    for alternative in atoms:
        parts = []
        for i, (atom, often) in enumerate(alternative):
            inner = _inside(atom)
            if inner is None:
                parts.append(atom + often)
                continue
            choices = _split(inner)
            many = choices is not None and len(choices) >= FEWEST
            ahead = guard(inner) if many and i else ""
            body = _headed(_shared(choices) if many else inner)
            parts.append((f"(?:{ahead}(?:{body}))" if ahead else f"(?:{body})") + often)
        out.append("".join(parts))
    return "|".join(out)


@lru_cache(maxsize=1024)
def factored(pattern: str) -> str:
    """A pattern that matches in the same texts, for tests only: alternatives are reordered and groups may change.

    The engine tries alternatives one by one; those that begin with the same character are then tried together.
    """
    if _REFERS.search(pattern):
        return pattern
    inner = pattern
    if pattern.startswith("(") and pattern.endswith(")") and not pattern.startswith("(?") and _split(pattern[1:-1]):
        inner = pattern[1:-1]
    alternatives = _split(inner)
    if not alternatives or len(alternatives) < FEWEST:
        return pattern
    out = _shared(alternatives)
    try:
        _parser.parse(out)
    except PatternError:
        return pattern
    return out


@lru_cache(maxsize=1024)
def tested(pattern: str) -> str:
    """``factored``, with the repeats at both ends, which a test need not follow, cut to their least number; for tests only."""
    if _REFERS.search(pattern) or _OWNS.search(pattern):
        return factored(pattern)
    out = _headed(_lean(_lean(factored(pattern), True), False))
    try:
        _parser.parse(out)
    except PatternError:
        return factored(pattern)
    return out


def _class(chars: set) -> str:
    folded = set("".join(LIKE_ASCII.values()))
    # one range for all letters beyond ASCII: a wider class turns down less and is looked up faster
    listed = "".join(("\\" + c if c in _SPECIAL else c) for c in sorted(chars - folded))
    return "[" + listed + ("\u0130-\u212a" if chars & folded else "") + "]"


def _runs_through(items, group: int) -> bool:
    """Whether every match captures text in the group."""
    for op, value in items:
        if op is K.SUBPATTERN:
            if value[0] == group:
                return value[-1].getwidth()[0] > 0
            if _runs_through(value[-1], group):
                return True
    return False


@lru_cache(maxsize=1024)
def always_captures(pattern: str, group: int) -> bool:
    """Whether the group of every match holds text, so that an empty capture tells that nothing matched."""
    items = _parser.parse(pattern)
    return items.getwidth()[0] > 0 if group == 0 else _runs_through(items, group)


def _looks_back(items) -> bool:
    for op, value in items:
        if op is K.AT and value not in (K.AT_END, K.AT_END_STRING):
            return True
        if op in (K.ASSERT, K.ASSERT_NOT):
            if value[0] < 0 or _looks_back(value[1]):
                return True
        elif op is K.SUBPATTERN:
            if _looks_back(value[-1]):
                return True
        elif op is K.BRANCH:
            if any(map(_looks_back, value[1])):
                return True
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            if _looks_back(value[2]):
                return True
        elif op not in (K.AT, K.LITERAL, K.NOT_LITERAL, K.ANY, K.IN, K.GROUPREF):
            return True
    return False


@lru_cache(maxsize=1024)
def looks_back(pattern: str) -> bool:
    """Whether a match may depend on what stands before it; if not, it is the same in the text from its start on."""
    return _looks_back(_parser.parse(pattern))


def _bounded(items) -> bool:
    """Whether every match begins at a word boundary that the pattern asks for first."""
    if not len(items):
        return False
    op, value = items[0]
    if op is K.SUBPATTERN:
        return _bounded(value[-1])
    if op is K.BRANCH:
        return all(map(_bounded, value[1]))
    return op is K.AT and value is K.AT_BOUNDARY


def _places(pattern: str):
    """The parsed pattern and the characters that can stand at its first places; None if it is not worth a lookahead."""
    try:
        items = _parser.parse(pattern)
    except (PatternError, RecursionError, OverflowError):
        return None
    if not len(items) or items[0][0] in (K.LITERAL, K.IN, K.NOT_LITERAL, K.ANY) and len(items) == 1:
        return None
    heads = _heads(items)
    depth = min(len(chars) for chars, _ in heads)
    return items, [set().union(*[chars[i] for chars, _ in heads]) for i in range(depth)]


@lru_cache(maxsize=4096)
def guard(pattern: str) -> str:
    """A lookahead that holds wherever the pattern matches, whatever its flags; the empty string if none is worth it."""
    found = _places(pattern)
    if found is None or not found[1] or min(map(len, found[1])) > WIDEST // 2:
        return ""
    return "(?=(?-i:" + "".join(map(_class, found[1])) + "))"


@lru_cache(maxsize=4096)
def ahead(pattern: str) -> str:
    """``guard`` for a place before the flags, where no group is needed around it, which the engine would enter at every character.

    A word boundary costs the engine far more than a class.  Where one comes first and a word character follows, no ASCII letter, digit or
    underscore may stand before; that is looked at first.
    """
    found = _places(pattern)
    if found is None or not found[1]:
        return ""
    items, places = found
    first = places[0] - set("".join(LIKE_ASCII.values()))
    word = _bounded(items) and all(c.isascii() and (c.isalnum() or c == "_") for c in first)
    if not word and min(map(len, places)) > WIDEST // 2:
        return ""
    return ("(?<![0-9A-Z_a-z])" if word else "") + "(?=" + "".join(map(_class, places)) + ")"
