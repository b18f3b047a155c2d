"""Text and regular-expression helpers shared by every job.

Patterns are written once in the syntax common to Python and Java and are
compiled for Java with ``(?Ud…)``: ``U`` makes ``\\s \\d \\w \\b`` Unicode-aware
(crawled text is full of no-break spaces) and ``d`` makes ``\\n`` the only line
end for ``.``, ``^`` and ``$``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .heads import ahead, always_captures, factored, tested

# The characters Unicode calls white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def rx(pattern: str, flags: str = "i") -> str:
    """Java form of a pattern; ``flags`` are any of i (case), m (line anchors), s (dot matches all).

    A lookahead goes first, before the flags, where the pattern tells how its matches begin; the matches are the same.
    """
    before = ahead(pattern)
    return f"{before}(?Ud{flags})" + (f"(?:{pattern})" if before else pattern)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    The body runs as a lambda, outside the generated row loop.  Wide pattern
    cascades go through here: inlined they would push the loop over the JVM's
    method-size limit, and their cost is in the matcher anyway.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(c, F.lit(WHITESPACE))


def blank_to_null(c: Column) -> Column:
    """NULL for the empty string.  ``c`` is read twice: give it a column, or go through ``bind``."""
    return F.when(c != "", c)


def strip_to_null(c: Column) -> Column:
    return bind(strip(c), blank_to_null)


def first_nonblank(*cols: Column) -> Column:
    """First value that is not blank after trimming, trimmed; NULL if there is none."""
    return F.coalesce(*[strip_to_null(c) for c in cols])


def matches(c: Column, pattern: str, flags: str = "i") -> Column:
    return F.coalesce(c.rlike(rx(factored(pattern), flags)), F.lit(False))


def capture(c: Column, pattern: str, group: int = 1, flags: str = "i") -> Column:
    """Group of the first match; NULL where the pattern does not match (or the group is empty)."""
    return bind(F.regexp_extract(c, rx(pattern, flags), group), blank_to_null)


def first_match(c: Column, patterns: Sequence[tuple[str, str]], group: int = 1, worth: Sequence[Column | None] = ()) -> Column:
    """Group of the first pattern, in list order, that matches anywhere.

    ``patterns`` holds ``(pattern, flags)``.  The first *matching* pattern
    decides even if what it captured is blank; later patterns are not evaluated for that row.  Where the group of a
    match can't be empty, the pattern runs once, else once to test and once to extract.  ``worth`` as in ``matched_index``.
    """

    def attempt(i: int, p: str, f: str) -> Column:
        got, needs = F.regexp_extract(c, rx(p, f), group), worth[i] if worth else None
        if always_captures(p, group):
            got = bind(got, blank_to_null)
            return got if needs is None else F.when(needs, got)
        hit = c.rlike(rx(tested(p), f))
        return F.when(hit if needs is None else needs & hit, got)

    return F.coalesce(*[attempt(i, p, f) for i, (p, f) in enumerate(patterns)])


def matched_index(c: Column, patterns: Sequence[tuple[str, str]], worth: Sequence[Column | None] = ()) -> Column:
    """1-based position of the first matching pattern, 0 if none matches.

    ``worth`` gives for each pattern a cheaper condition that must hold where it matches, or None.
    """
    chain = None
    for i, (p, f) in enumerate(patterns, start=1):
        cond = c.rlike(rx(tested(p), f))
        if worth and worth[i - 1] is not None:
            cond = worth[i - 1] & cond
        chain = F.when(cond, F.lit(i)) if chain is None else chain.when(cond, F.lit(i))
    return F.lit(0) if chain is None else F.coalesce(chain.otherwise(F.lit(0)), F.lit(0))


def first_capture(c: Column, patterns: Sequence[tuple[str, str, int]], worth: Sequence[Column | None] = ()) -> Column:
    """Struct ``k, raw``: 1-based position of the first matching pattern and what its group captured; 0 and null if none matches.

    ``patterns`` holds ``(pattern, flags, group)``.  Where the group of a match can't be empty, the capture
    tells whether there is a match, and the pattern runs once.  ``worth`` as in ``matched_index``.
    """

    def attempt(i: int, p: str, f: str, group: int) -> Column:
        found = lambda raw: F.struct(F.lit(i).alias("k"), raw.alias("raw"))
        capture_, needs = F.regexp_extract(c, rx(p, f), group), worth[i - 1] if worth else None
        if always_captures(p, group):
            got = bind(capture_, lambda raw: F.when(raw != "", found(raw)))
            return got if needs is None else F.when(needs, got)
        hit = c.rlike(rx(tested(p), f))
        return F.when(hit if needs is None else needs & hit, found(capture_))

    none = F.struct(F.lit(0).alias("k"), F.lit(None).cast("string").alias("raw"))
    return F.coalesce(*[attempt(i, *p) for i, p in enumerate(patterns, start=1)], none)


def replace_all(c: Column, pattern: str, repl: str, flags: str = "i") -> Column:
    return F.regexp_replace(c, rx(pattern, flags), repl)


def labelled_line(label: str, value: Column) -> Column:
    """``label: value`` or NULL when the value is blank."""
    return F.when(strip(value) != "", F.concat(F.lit(f"{label}: "), value))


def join_lines(*lines: Column) -> Column:
    """Join the lines that are present with a line feed."""
    return F.concat_ws("\n", *lines)


def lookup(c: Column, table: dict, default: Column | None = None) -> Column:
    """Literal lookup as a CASE chain over a small fixed table."""
    chain = None
    for k, v in table.items():
        value = v if isinstance(v, Column) else F.lit(v)
        chain = F.when(c == k, value) if chain is None else chain.when(c == k, value)
    return chain if default is None else chain.otherwise(default)


def format_general(v: Column) -> Column:
    """Shortest decimal text with six significant digits (the ``%g`` form).

    ``%e`` gives the rounded six-digit mantissa and the exponent; casting that
    text to a decimal yields the plain form without going back through binary.
    A value whose shortest decimal form has exactly seven digits ending in five
    is rounded up, whatever its binary value; label quantities are shorter.
    """

    def text(sci: Column) -> Column:
        exponent = F.regexp_extract(sci, "e([+-]\\d+)$", 1).try_cast("int")
        mantissa = F.regexp_replace(F.regexp_extract(sci, "^(-?[\\d.]+)e", 1), "\\.?0+$", "")
        plain = F.regexp_replace(sci.try_cast("decimal(24,10)").cast("string"), "\\.?0+$", "")
        scientific = F.concat(mantissa, F.regexp_extract(sci, "(e[+-]\\d+)$", 1))
        return F.when(exponent.between(-4, 5), plain).otherwise(scientific)

    return F.when(v == 0, F.lit("0")).when(v.isNotNull(), bind(F.format_string("%.5e", v), text))


def words(c: Column) -> Column:
    """Split on runs of white space, without empty pieces."""
    return F.filter(F.split(c, rx("\\s+", "")), lambda w: w != "")


def word_count(c: Column) -> Column:
    """The number of ``words``, without making them."""
    return F.size(F.regexp_extract_all(c, F.lit(rx("\\S+", "")), F.lit(0)))


def int_or_null(digits: Column) -> Column:
    """The number that digits tell; NULL for the empty string, which a cast would turn down by raising an error."""
    return bind(digits, lambda d: F.when(d != "", d.try_cast("int")))


def any_of(fragments: Sequence[str]) -> str:
    """Alternation of literal fragments, for use on lower-cased text."""
    special = set("\\^$.|?*+()[]{}")
    return "|".join("".join("\\" + ch if ch in special else ch for ch in f) for f in fragments)
