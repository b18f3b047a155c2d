"""Small SQL-text helpers for the checking database.

Its regular expressions are RE2: no look-around, ASCII classes, at most 1000
repetitions.  ``re2`` rewrites a pattern so that it means what the Java form
with Unicode classes means.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..functions.text import WHITESPACE

# White space beyond RE2's own class.
_WIDE_SPACE = r"\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(pattern: str, flags: str = "i", consume: bool = True) -> str:
    """RE2 form of a pattern.

    A look-ahead at the end becomes a consuming group: where only an inner
    group is read, the first match is the same.
    """
    out, i, in_class = [], 0, False
    multi = "m" in flags
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            two = pattern[i : i + 2]
            if two == "\\s":
                out.append(r"\s" + _WIDE_SPACE if in_class else r"[\s" + _WIDE_SPACE + "]")
            elif two == "\\d":
                out.append(r"\p{Nd}")
            elif two == "\\w":
                out.append(r"\p{L}\p{N}\p{M}_" if in_class else r"[\p{L}\p{N}\p{M}_]")
            else:
                out.append(two)
            i += 2
            continue
        if in_class:
            if ch == "]":
                in_class = False
            out.append(ch)
        elif ch == "[":
            in_class = True
            out.append(ch)
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
        elif ch == "$" and not multi:
            out.append(r"(?:\n?\z)")
        elif consume and pattern[i : i + 3] == "(?=":
            out.append("(?:")
            i += 3
            continue
        else:
            out.append(ch)
        i += 1
    body = "".join(out)
    return f"(?{flags})" + body if flags else body


def strip(e: str) -> str:
    return f"trim({e}, {q(WHITESPACE)})"


def nz(e: str) -> str:
    return f"nullif({e}, '')"


def has(e: str, pattern: str, flags: str = "i") -> str:
    return f"coalesce(regexp_matches({e}, {q(re2(pattern, flags))}), false)"


def extract(e: str, pattern: str, group: int = 1, flags: str = "i") -> str:
    return f"regexp_extract({e}, {q(re2(pattern, flags))}, {group})"


def capture(e: str, pattern: str, group: int = 1, flags: str = "i") -> str:
    return nz(extract(e, pattern, group, flags))


def first_match(e: str, patterns: Sequence[tuple[str, str]], group: int = 1) -> str:
    arms = " ".join(f"WHEN {has(e, p, f)} THEN {extract(e, p, group, f)}" for p, f in patterns)
    return f"CASE {arms} END"


def replace_all(e: str, pattern: str, repl: str, flags: str = "i") -> str:
    return f"regexp_replace({e}, {q(re2(pattern, flags))}, {q(repl)}, 'g')"


def first_nonblank(*exprs: str) -> str:
    return "coalesce(" + ", ".join(nz(strip(e)) for e in exprs) + ")"


def case(pairs: Sequence[tuple[str, str]], default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


def lookup(e: str, table: dict, default: str = "NULL") -> str:
    def lit(v):
        return q(v) if isinstance(v, str) else repr(v)

    return f"CASE {e} " + " ".join(f"WHEN {q(k)} THEN {lit(v)}" for k, v in table.items()) + f" ELSE {default} END"


def one_decimal(e: str) -> str:
    """Half-even rounding of the decimal text, as the reports do it."""
    return f"CAST(round_even(CAST({e} AS DECIMAL(30,12)), 1) AS DOUBLE)"


def cte(**parts: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS (\n{body}\n)" for name, body in parts.items())
