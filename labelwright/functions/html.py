"""Tag-level reading of HTML with regular expressions.

There is no document tree here.  Elements found by id or class are whole: their
closing tag is found by counting the tags of their kind (``element``, ``elements``).  Table
rows, cells and list items end at the first closing tag of their kind.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, blank_to_null, rx, strip

# Character references that are decoded, the ampersand last.
REFERENCES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&copy;", "©"), ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—"), ("&rsquo;", "’"), ("&#8377;", "₹"),
    ("&amp;", "&"),
]
UNSEEN = r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>"
TAG = r"<[^>]*>"
ROW = r"<tr\b[^>]*>(.*?)</tr\s*>"
CELL = r"<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"
ITEM = r"<li\b[^>]*>(.*?)</li\s*>"
SCRIPT = r"<script\b[^>]*>(.*?)</script\s*>"
LD_SCRIPT = r"<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script\s*>"
META = r"<meta\b[^>]*>"
MARK = "\u0001"


def block_pattern(tags: Sequence[str]) -> str:
    """Elements of these kinds with their content, to the first closing tag of the same kind."""
    return "|".join(rf"<{t}\b.*?</{t}\s*>" for t in tags)


def decode(c: Column) -> Column:
    for ref, ch in REFERENCES:
        c = F.replace(c, F.lit(ref), F.lit(ch))
    return c


def node_text(html: Column, sep: str = " ") -> Column:
    """Text pieces between tags, each trimmed, joined by ``sep``; scripts, styles and comments are unseen."""
    bare = F.regexp_replace(F.regexp_replace(html, rx(UNSEEN, "is"), MARK), TAG, MARK)
    pieces = F.transform(F.split(decode(bare), MARK), strip)
    return F.array_join(F.filter(pieces, lambda p: p != ""), sep)


def without(html: Column, tags: Sequence[str]) -> Column:
    return F.regexp_replace(html, rx(block_pattern(tags), "is"), MARK)


def table_rows(html: Column) -> Column:
    """``array<struct<key,value>>`` of every table row with two cells or more, in page order."""

    def pair(row: Column) -> Column:
        def cells(cs: Column) -> Column:
            return F.struct(
                F.btrim(node_text(F.get(cs, F.lit(0))), F.lit(":")).alias("key"),
                node_text(F.get(cs, F.lit(1))).alias("value"),
            )

        return bind(F.regexp_extract_all(row, F.lit(rx(CELL, "is")), F.lit(1)), cells)

    rows = F.transform(F.regexp_extract_all(html, F.lit(rx(ROW, "is")), F.lit(1)), pair)
    return F.filter(rows, lambda r: (r["key"] != "") & (r["value"] != ""))


def row_value(rows: Column, key: str) -> Column:
    """Value of a row key; a later duplicate wins."""
    return F.try_element_at(F.filter(rows, lambda r: r["key"] == key), F.lit(-1))["value"]


def first_row_value(rows: Column, keys: Sequence[str]) -> Column:
    return F.coalesce(*[row_value(rows, k) for k in keys])


def rows_to_map(rows: Column) -> Column:
    """Map with one entry per key, in order of first appearance, holding the last value; found by one sort."""

    def build(sorted_rows: Column) -> Column:
        other = lambda r, j: ~F.get(sorted_rows, j)["k"].eqNullSafe(r["k"])
        first = F.filter(sorted_rows, lambda r, j: (j == 0) | other(r, j - 1))
        last = F.filter(sorted_rows, lambda r, j: (j == F.size(sorted_rows) - 1) | other(r, j + 1))
        entries = F.zip_with(first, last, lambda a, b: F.struct(a["i"].alias("i"), a["k"].alias("k"), b["v"].alias("v")))
        return bind(F.array_sort(entries), lambda es: F.map_from_arrays(F.transform(es, lambda e: e["k"]), F.transform(es, lambda e: e["v"])))

    placed = F.transform(rows, lambda r, i: F.struct(r["key"].alias("k"), i.alias("i"), r["value"].alias("v")))
    return bind(F.array_sort(placed), build)


def _tags_apart(html: Column, kind: str | Column) -> Column:
    """``html`` cut before every tag of a kind; a blank leads, so the first piece starts with no such tag."""
    name = kind if isinstance(kind, Column) else F.lit(kind)
    return F.split(F.concat(F.lit(" "), html), F.concat(F.lit("(?i)(?=</?"), name, F.lit(r"[\s/>])")))


def _step(piece: Column) -> Column:
    """Change of depth at the tag that a piece starts with: 1, -1, or 0 for none and for a tag that closes itself."""
    return (
        F.when(piece.startswith("</"), -1).when(~piece.startswith("<"), 0).when(piece.rlike(r"^<[^>]*/>"), 0).otherwise(1)
    )


def visible(html: Column) -> Column:
    """Without what may hold tags that are none: comments, scripts, styles, templates."""
    return F.regexp_replace(html, rx(UNSEEN, "is"), "")


def element(html: Column, opening: str) -> Column:
    """Inner HTML of the first element whose opening tag is ``opening`` (group 1 = its kind); NULL if absent or empty.

    The element is whole, whatever is nested in it: one pass over the tags of its kind counts
    the depth.  One that is never closed ends with the page.
    """

    def inner(v: Column) -> Column:
        kind = F.lower(F.regexp_extract(v, rx(opening, "is"), 1))
        rest = F.try_element_at(F.split(v, rx(opening, "is"), 2), F.lit(2))
        zero = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("end"))

        def walk(s: Column, p: Column) -> Column:
            depth = s["depth"] + _step(p)
            return F.struct(
                depth.alias("depth"), (s["at"] + F.length(p)).alias("at"),
                F.when((s["end"] < 0) & (depth == 0), s["at"]).otherwise(s["end"]).alias("end"),
            )

        def cut(r: Column) -> Column:
            end = F.aggregate(_tags_apart(r, kind), zero, walk, lambda s: F.when(s["end"] < 0, s["at"]).otherwise(s["end"]))
            return F.substring(r, F.lit(1), end - 1)

        return bind(rest, cut)

    return F.when(html.rlike(rx(opening, "is")), bind(bind(visible(html), inner), blank_to_null))


def elements(html: Column, kinds: Sequence[str], attributes: str = "") -> Column:
    """Inner HTML of every element of these kinds whose opening tag holds ``attributes``, in page order, nested ones too.

    For each kind one pass over its tags counts the depth and keeps the open elements that are
    wanted; those never closed end with the page.
    """
    opening = rf"<(?:{'|'.join(kinds)})\b[^>]*{attributes}"

    def spans(v: Column, kind: str) -> Column:
        span = "array<struct<start:int,end:int>>"
        wanted = rx(rf"^<{kind}\b[^>]*{attributes}[^>]*>", "is")
        zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.array().cast("array<struct<depth:int,start:int>>").alias("open"), F.array().cast(span).alias("found"))

        def walk(s: Column, p: Column) -> Column:
            step = _step(p)
            inside = F.struct((s["depth"] + 1).alias("depth"), (s["at"] + F.length(F.regexp_extract(p, r"^<[^>]*>", 0))).alias("start"))
            top = F.try_element_at(s["open"], F.lit(-1))
            closes = (step == -1) & F.coalesce(top["depth"] == s["depth"], F.lit(False))
            ended = F.struct(top["start"].alias("start"), s["at"].alias("end"))
            return F.struct(
                (s["at"] + F.length(p)).alias("at"),
                # a closing tag too many opens nothing
                F.greatest(s["depth"] + step, F.lit(0)).alias("depth"),
                F.when(closes, F.slice(s["open"], F.lit(1), F.size(s["open"]) - 1))
                .when((step == 1) & p.rlike(wanted), F.concat(s["open"], F.array(inside))).otherwise(s["open"]).alias("open"),
                F.when(closes, F.concat(s["found"], F.array(ended))).otherwise(s["found"]).alias("found"),
            )

        def finish(s: Column) -> Column:
            return F.concat(s["found"], F.transform(s["open"], lambda o: F.struct(o["start"].alias("start"), s["at"].alias("end"))))

        return F.aggregate(_tags_apart(v, kind), zero, walk, finish)

    def inner(v: Column) -> Column:
        found = F.array_sort(F.concat(*[spans(v, k) for k in kinds]))
        # positions count the blank that leads
        return F.transform(found, lambda e: F.substring(v, e["start"], e["end"] - e["start"]))

    return F.when(html.rlike(rx(opening, "is")), bind(visible(html), inner)).otherwise(F.array().cast("array<string>"))


def by_id(element_id: str) -> str:
    """Opening tag with this id."""
    return rf"<([a-z0-9]+)\b[^>]*\sid\s*=\s*[\"']?{element_id}(?:[\"'\s/][^>]*)?>"


def by_class(classes: str) -> str:
    """Attribute of a tag of any of these classes (alternatives)."""
    return rf"\sclass\s*=\s*(?:[\"'][^\"']*(?:{classes})[^\"']*[\"']|[^\s\"'>]*(?:{classes}))"


def section(html: Column, element_id: str) -> Column:
    """Inner HTML of the element with this id, whole; NULL if absent."""
    return element(html, by_id(element_id))


def element_text(html: Column, opening: str) -> Column:
    """Text of the first element whose opening tag is ``opening`` (group 1 = its kind); NULL if it has none."""
    return bind(node_text(F.coalesce(element(html, opening), F.lit(""))), blank_to_null)


def items(html: Column) -> Column:
    """Texts of the list items."""
    return F.transform(F.regexp_extract_all(html, F.lit(rx(ITEM, "is")), F.lit(1)), node_text_item)


def node_text_item(c: Column) -> Column:
    return node_text(c)


def key_value_items(html: Column) -> Column:
    """``array<struct<key,value>>`` of list items that read ``key: value``."""

    def pair(t: Column) -> Column:
        return F.struct(
            strip(F.regexp_extract(t, r"(?s)^([^:]*):(.*)$", 1)).alias("key"),
            strip(F.regexp_extract(t, r"(?s)^([^:]*):(.*)$", 2)).alias("value"),
        )

    return F.filter(F.transform(items(html), pair), lambda r: (r["key"] != "") & (r["value"] != ""))


def attribute(tag: Column, name: str) -> Column:
    """Attribute value of a tag, decoded; empty if absent."""
    pattern = rf"\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    return decode(
        F.concat(F.regexp_extract(tag, rx(pattern, "is"), 1), F.regexp_extract(tag, rx(pattern, "is"), 2))
    )


def metas(html: Column) -> Column:
    """``array<struct<prop,content>>`` of meta tags with content, named by property or name."""

    def build(tag: Column) -> Column:
        return F.struct(
            bind(attribute(tag, "property"), lambda p: F.when(p != "", p).otherwise(attribute(tag, "name"))).alias("prop"),
            attribute(tag, "content").alias("content"),
        )

    tags = F.transform(F.regexp_extract_all(html, F.lit(rx(META, "is")), F.lit(0)), build)
    return F.filter(tags, lambda m: m["content"] != "")


def meta_values(ms: Column, *props: str) -> Column:
    return F.transform(F.filter(ms, lambda m: m["prop"].isin(*props)), lambda m: m["content"])


# ---- JSON-LD


def is_product(node: Column) -> Column:
    return F.coalesce(F.lower(F.get_json_object(node, "$.@type")).contains("product"), F.lit(False))


# a text in quotes, one sign of structure, or anything else; escapes are masked before
_JSON_TOKEN = r'"[^"]*"|[{}\[\],:]|[^"{}\[\],:]+'


def _graph_objects(document: Column) -> Column:
    """Objects of a JSON text that lists and ``@graph`` lead to from its root, in order, as JSON texts.

    One pass over the tokens with the open brackets as a stack, so any depth is reached.
    """
    # each mask is as long as what it hides, so places stay
    masked = F.replace(F.replace(document, F.lit("\\\\"), F.lit("\u0001\u0001")), F.lit('\\"'), F.lit("\u0002\u0002"))
    tokens = F.regexp_extract_all(masked, F.lit(_JSON_TOKEN), F.lit(0))
    zero = F.struct(
        F.lit(1).alias("at"), F.lit("").alias("last"), F.lit("").alias("key"),
        F.array().cast("array<struct<start:int,list:boolean,reached:boolean>>").alias("open"),
        F.array().cast("array<struct<start:int,end:int>>").alias("found"),
    )

    def walk(s: Column, t: Column) -> Column:
        top = F.try_element_at(s["open"], F.lit(-1))
        opens, closes = t.isin("{", "["), t.isin("}", "]")
        reached = F.coalesce(top["reached"] & (top["list"] | (s["key"] == '"@graph"')), F.lit(True))
        frame = F.struct(s["at"].alias("start"), (t == "[").alias("list"), reached.alias("reached"))
        whole = F.struct(top["start"].alias("start"), (s["at"] + 1).alias("end"))
        return F.struct(
            (s["at"] + F.length(t)).alias("at"),
            F.when(t.startswith('"'), t).otherwise(s["last"]).alias("last"),
            F.when(t == ":", s["last"]).when(opens | (t == ","), F.lit("")).otherwise(s["key"]).alias("key"),
            F.when(opens, F.concat(s["open"], F.array(frame))).when(closes & top.isNotNull(), F.slice(s["open"], F.lit(1), F.size(s["open"]) - 1)).otherwise(s["open"]).alias("open"),
            F.when((t == "}") & F.coalesce(top["reached"], F.lit(False)), F.concat(s["found"], F.array(whole))).otherwise(s["found"]).alias("found"),
        )

    found = F.aggregate(tokens, zero, walk, lambda s: F.array_sort(s["found"]))
    return F.transform(found, lambda o: F.substring(document, o["start"], o["end"] - o["start"]))


def ld_documents(html: Column) -> Column:
    """JSON-LD script bodies that parse, as text."""
    bodies = F.transform(F.regexp_extract_all(html, F.lit(rx(LD_SCRIPT, "is")), F.lit(1)), strip)
    return F.filter(bodies, lambda b: F.try_parse_json(b).isNotNull())


def ld_products(documents: Column) -> Column:
    """First product node of each JSON-LD document, found through lists and ``@graph`` at any depth."""

    def first_product(doc: Column) -> Column:
        return F.when(is_product(doc), doc).otherwise(F.get(F.filter(_graph_objects(doc), is_product), F.lit(0)))

    return F.filter(F.transform(documents, first_product), lambda n: n.isNotNull())
