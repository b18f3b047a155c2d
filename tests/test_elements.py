"""Whole elements, against a plain reading of the tags."""

from __future__ import annotations

import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from labelwright.functions import html as H
from labelwright.operators.pages import extract_pages, listing_texts
from labelwright.oracle import page_sql as O


def brute(html, kinds, wanted):
    """Inner HTML of the wanted elements, by a stack for each kind."""
    found = []
    for kind in kinds:
        stack = []
        for m in re.finditer(rf"(?is)<(/?){kind}(?=[\s/>])[^>]*>", html):
            if m[1]:
                if stack and (begin := stack.pop()) is not None:
                    found.append((begin, m.start()))
            elif not m[0].endswith("/>"):
                stack.append(m.end() if re.search(wanted, m[0]) else None)
        found += [(b, len(html)) for b in stack if b is not None]
    return [html[b:e] for b, e in sorted(found)]


def pages(n=60):
    random.seed(6)
    parts = ["<div>", "<div class='x'>", '<DIV class="a x b">', "</div>", "</div >", "<p>", "</p>", "<section>", "</section>", "<div/>", "<divider>", "t", " é ", "<span id=q>"]
    return ["".join(random.choices(parts, k=random.randrange(40))) for _ in range(n)]


def test_elements_equal_a_stack(spark):
    rows = pages()
    df = spark.createDataFrame([(k, h) for k, h in enumerate(rows)], "k int, h string")
    got = dict(df.select("k", H.elements(F.col("h"), ["div", "section"]).alias("e")).collect())
    assert got == {k: brute(h, ["div", "section"], "") for k, h in enumerate(rows)}
    classed = dict(df.select("k", H.elements(F.col("h"), ["div"], H.by_class("x")).alias("e")).collect())
    assert classed == {k: brute(h, ["div"], r"class=.[^\"']*x") for k, h in enumerate(rows)}
    con = duckdb.connect()
    for k, h in enumerate(rows):
        assert con.execute(f"SELECT {O.elements('h', ['div'], H.by_class('x'))} FROM (SELECT ? AS h)", [h]).fetchone()[0] == classed[k]


@pytest.mark.parametrize(
    "html, want",
    [
        ("<div id=productDescription><div>one</div><div>two</div></div>after", "<div>one</div><div>two</div>"),
        ("<ul id='productDescription'><li><ul><li>a</ul>b</ul>c", "<li><ul><li>a</ul>b"),
        ("<div id=productDescription>never <b>closed", "never <b>closed"),
        ("<!-- <div id=productDescription> --><p>no</p>", None),
        ("<div id=productDescription><!-- </div> --><script>'</div>'</script>in</div>out", "in"),
        ("<div id=productDescription></div>", None),
        ("<p>none</p>", None),
        (None, None),
    ],
)
def test_first_element(spark, html, want):
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(H.section(F.col("h"), "productDescription")).first()[0] == want
    assert duckdb.connect().execute(f"SELECT {O.section('h', 'productDescription')} FROM (SELECT ?::VARCHAR AS h)", [html]).fetchone()[0] == want


def test_nested_blocks_reach_the_records(spark):
    amazon = "<div id=productDescription><div>one</div><div>two</div></div>"
    flipkart = '<h1>Oats</h1><div class="X3BRps"><div>Specifications</div><div>Country of Origin: India</div> and more</div>'
    df = spark.createDataFrame([("a", "https://www.amazon.in/dp/B012345678", amazon), ("f", "https://www.flipkart.com/p", flipkart)], "page_id string, url string, html string")
    assert {r.page_id: r.description for r in extract_pages(df).collect()}["a"] == "one\ntwo"
    assert "Country of Origin: India\nand more" in {r.page_id: r.extracted_text for r in listing_texts(df).collect()}["f"]


def test_a_page_of_many_tags(spark):
    inner = "<div><p>x</p><div></div></div>" * 33_000
    page = f"<div><div id=big class=X3BRps>{inner}</div>after</div>"
    df = spark.createDataFrame([(page,)], "h string")
    start = time.perf_counter()
    one, all_ = df.select(H.section(F.col("h"), "big"), H.elements(F.col("h"), ["div"], H.by_class("X3BRps"))).first()
    assert one == inner and all_ == [inner] and time.perf_counter() - start < 60


def nested(depth, inner):
    return '{"@context":"x","@graph":[{"@type":"WebSite","name":"a ] \\"} b"},[' * depth + inner + "]]}" * depth


@pytest.mark.parametrize(
    "doc, want",
    [
        ('{"@type":"Product","name":"p"}', "p"),
        ('[{"@type":"Thing"},[{"@type":["Food","FoodProduct"],"name":"p"}],{"@type":"Product","name":"q"}]', "p"),
        ('{"@graph":{"@type":"Product","name":"p"}}', "p"),
        ('{"@graph":[{"name":"x","offers":{"@type":"Product","name":"no"}},{"@type":"Product","name":"p"}]}', "p"),
        ('{"mainEntity":{"@type":"Product","name":"no"}}', None),
        ('{"a":"@graph","b":[{"@type":"Product"}]}', None),
        ('{"@graph":[1,null,"@graph",{"@graph":["{",{"@type":"Product","name":"p"}]}]}', "p"),
        (nested(6, '{"@type":"Product","name":"p"}'), "p"),
        (nested(50, '{"@type":"Product","name":"p \\\\"}'), "p \\"),
        ("[]", None),
        ('"Product"', None),
    ],
)
def test_products_at_any_depth(spark, doc, want):
    df = spark.createDataFrame([(f'<script type="application/ld+json">{doc}</script>',)], "h string")
    got = df.select(F.transform(H.ld_products(H.ld_documents(F.col("h"))), lambda n: F.get_json_object(n, "$.name"))).first()[0]
    assert got == ([] if want is None else [want])


def test_a_long_graph(spark):
    doc = '{"@graph":[' + ",".join(f'{{"@type":"Thing","n":{i}}}' for i in range(5000)) + ',{"@type":"Product","name":"last"}]}'
    df = spark.createDataFrame([(doc,)], "d string")
    assert df.select(F.get_json_object(H.ld_products(F.array("d"))[0], "$.name")).first()[0] == "last"
