"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

1. One pass over the corpus counts the occurrences of every term of the benchmark.
2. In each window of 13 words of an item (in the whole item, if shorter) the term that is rarest
   in the corpus is the anchor.  Neighbouring windows mostly share theirs.
3. A second pass stores the postings of the anchors: term, document, position and the
   terms at the 12 offsets on either side.  Documents' lengths come with the same pass.
4. Postings meet the anchors of the items on the term, and the lists are intersected offset by
   offset, outwards from the rarest term.  A run of 13 equal offsets (or the whole shorter item) holds
   exactly the windows through this anchor; every window has an anchor, so none is missed.
5. Around the same anchors, item words are also counted that stand within ``SHIFT`` places of their offset, so
   that words put in, left out or swapped do not end the count.  If all but one word in six of a window are
   found so, the place is a proximity match, reported beside the phrases.  A place whose anchors are themselves altered is not seen.

Terms are broadcast in blocks of at most ``BLOCK_BYTES``; a larger set takes more passes,
each over the whole corpus.

Defined cases: a null text, or one without words, has no words and is not contaminated; items
that are null or without words match nothing; repeated documents each get the same result, and
items with equal text are all reported; texts of any length are read whole; of equally rare terms the first in
order is the anchor; an empty corpus gives an empty result; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WINDOW = 13
#: Words lie between runs of these characters, once A-Z are lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK_BYTES = 16 << 20
#: Places by which a word may stand off its offset in a proximity match.
SHIFT = 2
DOC = ["doc_id", "text_hash"]


def words_of(text: Column) -> Column:
    """Words of a text, with A-Z in lower case and all other letters as they are."""
    text = F.coalesce(text, F.lit(""))
    plain = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))
    return F.array_remove(F.split(plain, BETWEEN), "")


def _each_block(terms: DataFrame, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``job`` over the terms, given as broadcasts of proven size, one pass of the corpus for each."""
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 32), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    parts = [terms.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == b) if blocks > 1 else terms for b in range(blocks)]
    return reduce(DataFrame.union, [job(F.broadcast(p)) for p in parts])


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences in the corpus of each of the ``terms`` (term, distinct); absent ones have no row."""
    words = docs.select(F.explode_outer(words_of(F.col("text"))).alias("term"))
    return _each_block(terms, lambda t: words.join(t, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n")))


def postings(docs: DataFrame, terms: DataFrame, reach: int = WINDOW - 1) -> DataFrame:
    """Positional postings (term, doc_id, text_hash, pos, before, after) of the ``terms``.

    ``before`` and ``after`` hold the terms at offsets 1 to ``reach`` on either side.  The empty
    term closes every document: the position of its posting is the number of words.
    """
    ended = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.concat(words_of(F.col("text")), F.array(F.lit(""))).alias("words"))
    placed = ended.select(*DOC, "words", F.posexplode_outer("words").alias("pos", "term"))
    p = F.col("pos")
    near = {
        "before": F.when(F.col("term") != "", F.reverse(F.slice("words", F.greatest(p - (reach - 1), F.lit(1)), F.least(F.lit(reach), p)))),
        "after": F.when(F.col("term") != "", F.slice("words", p + 2, F.lit(reach))),
    }
    closing = docs.sparkSession.range(1).select(F.lit("").alias("term"))
    wanted = terms.select("term").union(closing)
    return _each_block(wanted, lambda t: placed.join(t, "term").select("term", *DOC, "pos", *[c.alias(n) for n, c in near.items()]))


def anchors(items: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, term, before, after, need): for each window of an item its rarest term, with the terms around it."""
    texts = items.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    texts = cut(texts.groupBy("words").agg(F.collect_set("item_id").alias("ids")).withColumn("text_id", F.monotonically_increasing_id()))
    placed = texts.select("text_id", F.size("words").alias("size"), F.posexplode("words").alias("pos", "term")).join(counts, "term", "left")
    ahead = Window.partitionBy("text_id").orderBy("pos").rowsBetween(0, window - 1)
    rarest = F.min(F.struct(F.coalesce(F.col("counts"), F.lit(0)).alias("n"), "term", "pos"))
    least = placed.select("text_id", "size", "pos", rarest.over(ahead).alias("a"))
    chosen = least.filter(F.col("pos") <= F.greatest(F.col("size") - window, F.lit(0))).select("text_id", F.col("a.term").alias("term"), F.col("a.pos").alias("pos")).distinct()
    p, reach = F.col("pos"), window - 1
    return chosen.join(texts, "text_id").select(
        F.explode("ids").alias("item_id"),
        "term",
        F.reverse(F.slice("words", F.greatest(p - (reach - 1), F.lit(1)), F.least(F.lit(reach), p))).alias("item_before"),
        F.slice("words", p + 2, F.lit(reach)).alias("item_after"),
        F.least(F.size("words"), F.lit(window)).alias("need"),
    )


def _equal(ours: str, theirs: str) -> Column:
    return F.zip_with(ours, theirs, lambda a, b: a.eqNullSafe(b))


def _run(equal: Column) -> Column:
    """Length of the leading run of true."""
    first = F.array_position(equal, False)
    return F.when(first == 0, F.size(equal)).otherwise(first - 1).cast("int")


def _near(ours: str, theirs: str, shift: int) -> Column:
    """Number of their words that ours has within ``shift`` places of the same offset."""

    def around(place: Column) -> Column:
        low = F.greatest(place - shift, F.lit(1))
        return F.coalesce(F.array_contains(F.slice(ours, low, place + shift + 1 - low), F.get(theirs, place - 1)), F.lit(False))

    return F.when(F.size(theirs) > 0, F.size(F.filter(F.sequence(F.lit(1), F.size(theirs)), around))).otherwise(0)


def matches(found: DataFrame, entries: DataFrame, shift: int = SHIFT) -> DataFrame:
    """Phrase and proximity figures where a posting of ``found`` meets an anchor of ``entries``.

    ``first`` and ``last`` bound the run of equal words around the anchor, ``exact`` says that it holds a
    window, ``near`` is the number of item words around the anchor that stand within ``shift`` places of their
    offset, and ``close`` says that these make a proximity match.
    """
    met = found.join(entries, "term").select(
        *DOC, "entry", "pos", "need", _run(_equal("before", "item_before")).alias("l"), _run(_equal("after", "item_after")).alias("r"),
        (1 + _near("before", "item_before", shift) + _near("after", "item_after", shift)).alias("near"),
    )
    return met.select(
        *DOC, "entry", (F.col("pos") - F.col("l")).alias("first"), (F.col("pos") + F.col("r")).alias("last"), (F.col("l") + F.col("r") + 1 >= F.col("need")).alias("exact"),
        "pos", "need", "near", (F.col("near") >= F.col("need") - F.floor(F.col("need") / 6)).alias("close"),
    )


def _covered(spans: Column) -> Column:
    """Number of positions in a union of sorted (first, last) spans."""
    start = F.struct(F.lit(-1).alias("end"), F.lit(0).cast("bigint").alias("n"))

    def step(acc, s):
        fresh = F.greatest(s["last"] - F.greatest(s["first"] - 1, acc["end"]), F.lit(0)).cast("bigint")
        return F.struct(F.greatest(acc["end"], s["last"]).alias("end"), (acc["n"] + fresh).alias("n"))

    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_hit, n_items, items_sha256 and contaminated, against ``items`` (item_id, text).

    A document is contaminated if at least one word in twenty is hit.  ``near_items`` are the items with a proximity
    match, those with a phrase included; they do not count as hits.
    """
    terms = cut(items.select(F.explode(words_of(F.col("text"))).alias("term")).distinct())
    counts = cut(term_counts(docs, terms).groupBy("term").agg(F.sum("n").alias("counts")))
    named = cut(anchors(items, counts, window))
    keys = ["term", "item_before", "item_after", "need"]
    entries = cut(named.select(*keys).distinct().withColumn("entry", F.monotonically_increasing_id()))
    of_item = named.join(entries, keys).select("entry", "item_id").distinct()
    index = cut(postings(docs, entries.select("term").distinct(), window - 1))
    met = cut(matches(index.filter("term <> ''"), entries).filter("exact or close").select(*DOC, "entry", "first", "last", "exact").distinct())
    hits = met.filter("exact").drop("exact")
    spans = hits.groupBy(*DOC).agg(_covered(F.array_sort(F.collect_set(F.struct("first", "last")))).alias("n_hit"))
    per_item = met.groupBy(*DOC, "entry").agg(F.max("exact").alias("exact")).join(of_item, "entry").groupBy(*DOC, "item_id").agg(F.max("exact").alias("exact"))
    name = F.col("item_id").cast("string")
    lists = [F.sort_array(F.collect_set(F.when(F.col("exact"), name))).alias("items"), F.sort_array(F.collect_set(name)).alias("near_items")]
    listed = per_item.groupBy(*DOC).agg(*lists)
    same = lambda a, b: a.doc_id.eqNullSafe(b.doc_id) & (a.text_hash == b.text_hash)
    hit = listed.join(spans, same(listed, spans), "left").select(listed.doc_id, listed.text_hash, "n_hit", "items", "near_items")
    every = index.filter("term = ''").select(*DOC, F.col("pos").cast("bigint").alias("n_words"))
    joined = every.join(hit, same(every, hit), "left").select(every.doc_id, every.text_hash, "n_words", "n_hit", "items", "near_items")
    none = F.array().cast("array<string>")
    n_hit, items_, near = F.coalesce("n_hit", F.lit(0)).cast("bigint"), F.coalesce("items", none), F.coalesce("near_items", none)
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_).cast("bigint").alias("n_items"), items_.alias("items"),
        F.sha2(F.array_join(items_, ",").cast("binary"), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "text_hash",
        F.size(near).cast("bigint").alias("n_near_items"), near.alias("near_items"),
    )
