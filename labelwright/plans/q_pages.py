"""Page, URL and marketplace queries over the product and crawled pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import images as I
from ..functions import urls as U
from ..operators import marketplaces as M
from ..operators import pages as P
from ..oracle import page_sql as O
from ..oracle.sqlx import case, extract, nz, q, strip
from . import corpus as C
from .registry import Registry

R = Registry()
PAGES = C.sql(C.PRODUCT_PAGES)


def pages(spark, sf_dir):
    return C.pages(spark, sf_dir)


@R.add(
    "src_03_04_page_status",
    f"""SELECT page_id, length(html) AS content_length, CASE WHEN length(html) < 3000 THEN 'BLOCKED' ELSE 'OK' END AS fetch_status,
  CASE WHEN length(html) < 5000 THEN 'BLOCKED' ELSE 'OK' END AS listing_status FROM ({PAGES}) p""",
)
def page_status(spark, sf_dir):
    d = P.page_table(pages(spark, sf_dir))
    return d.select(
        "page_id", "content_length", "fetch_status",
        F.when(F.col("content_length") < P.LISTING_BLOCKED_BELOW, "BLOCKED").otherwise("OK").alias("listing_status"),
    )


@R.add("flt_02_url_status", f"SELECT page_id, {O.url_status()} AS url_status, {O.host()} AS host FROM ({PAGES}) p")
def url_status(spark, sf_dir):
    return C.pages(spark, sf_dir).select(
        "page_id", U.url_status(F.col("url")).alias("url_status"), U.url_host(F.col("url")).alias("host")
    )


@R.add(
    "nrm_10_canonical_url",
    f"SELECT page_id, {O.canonical_url(True)} AS by_region, {O.canonical_url(False)} AS always_in FROM ({PAGES}) p",
)
def canonical_url(spark, sf_dir):
    return C.pages(spark, sf_dir).select(
        "page_id",
        U.canonical_url(F.col("url")).alias("by_region"),
        U.canonical_url(F.col("url"), by_region=False).alias("always_in"),
    )


@R.add(
    "pge_01_02_platform",
    f"""SELECT page_id, {O.platform()} AS platform,
  {O.first_contained('lower(url)', [(k, k) for k, _, _ in U.PLATFORMS], "'generic'")} AS adapter_key,
  {O.first_contained('lower(url)', [(k, js) for k, _, js in U.PLATFORMS], 'false')} AS is_js_heavy,
  {O.first_contained('lower(url)', U.MARKETPLACES, "'Unknown'")} AS marketplace FROM ({PAGES}) p""",
)
def platform(spark, sf_dir):
    d = C.pages(spark, sf_dir).select(
        "page_id", U.detect_platform(F.col("url")).alias("p"), U.detect_marketplace(F.col("url")).alias("marketplace")
    )
    return d.select("page_id", "p.platform", "p.adapter_key", "p.is_js_heavy", "marketplace")


@R.add("pge_03_category", f"SELECT page_id, {O.category(O.node_text('html'))} AS category FROM ({PAGES}) p")
def category(spark, sf_dir):
    d = pages(spark, sf_dir).select("page_id", "url", H.node_text(F.col("html")).alias("t"))
    return d.select("page_id", U.infer_category(F.col("url"), F.col("t")).alias("category"))


@R.add("pge_19_visible_text", f"SELECT page_id, {O.node_text('html')} AS text FROM ({PAGES}) p")
def visible_text(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", H.node_text(F.col("html")).alias("text"))


@R.add(
    "pge_04_table_rows",
    f"SELECT page_id, r.key AS key, r.value AS value FROM (SELECT page_id, unnest({O.rows('html')}) AS r FROM ({PAGES}) p) z",
)
def table_rows(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.inline_outer(H.table_rows(F.col("html")))).filter("key IS NOT NULL")


_DETAILS = "flatten([" + ", ".join(
    O.key_value_items(f"coalesce({O.section('html', i)}, '')") for i in M.DETAIL_IDS
) + "])"


@R.add(
    "pge_05_detail_bullets",
    f"SELECT page_id, r.key AS key, r.value AS value FROM (SELECT page_id, unnest({_DETAILS}) AS r FROM ({PAGES}) p) z",
)
def detail_bullets(spark, sf_dir):
    html = F.col("html")
    found = F.flatten(
        F.array(*[H.key_value_items(F.coalesce(H.section(html, i), F.lit(""))) for i in M.DETAIL_IDS])
    )
    return pages(spark, sf_dir).select("page_id", F.inline_outer(found)).filter("key IS NOT NULL")


_TWO = r"<(?:div|li|p)\b[^>]*>\s*<[a-z0-9]+\b[^>]*>([^<]+)</[a-z0-9]+>\s*<[a-z0-9]+\b[^>]*>([^<]+)</[a-z0-9]+>\s*</(?:div|li|p)>"
_BOLD = r"<(?:strong|b|span|dt)\b[^>]*>([^<]+)</(?:strong|b|span|dt)\s*>\s*(?:<[a-z][^>]*>\s*)?([^<]+)"


def _pairs_sql(pattern: str, chars: str) -> str:
    return (
        f"list_transform({O.extract_all('html', pattern, 0, 'i')}, lambda m: {{'key': trim({strip(O.decode(extract('m', pattern, 1)))}, {q(chars)}), "
        f"'value': {strip(O.decode(extract('m', pattern, 2)))}}})"
    )


@R.add(
    "pge_06_spec_pairs",
    f"""SELECT page_id, r.key AS key, r.value AS value FROM (SELECT page_id,
  unnest(list_concat({_pairs_sql(_TWO, ': ')}, {_pairs_sql(_BOLD, ':')})) AS r FROM ({PAGES}) p) z WHERE r.key <> '' AND r.value <> ''""",
)
def spec_pairs(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.inline_outer(P.spec_pairs(F.col("html")))).filter("key IS NOT NULL")


_LD = r"<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script\s*>"


_LD_PRODUCT = """coalesce(contains(lower(CAST(node->'$."@type"' AS VARCHAR)), 'product'), false)"""
# the places of a node among the members that lists and @graph lead to, from the root, are its path
_LD_MEMBERS = f"""CASE WHEN json_type(node) = 'ARRAY' THEN CAST(node AS JSON[]) WHEN {_LD_PRODUCT} THEN CAST([] AS JSON[]) WHEN json_type(node, '$."@graph"') = 'ARRAY' THEN CAST(node->'$."@graph"' AS JSON[])
  WHEN json_type(node, '$."@graph"') = 'OBJECT' THEN [node->'$."@graph"'] ELSE CAST([] AS JSON[]) END"""


@R.add(
    "pge_07_json_ld",
    f"""WITH RECURSIVE n AS (SELECT page_id, body, [0::BIGINT] AS path, CAST(body AS JSON) AS node FROM (SELECT page_id, unnest({O.extract_all('html', _LD)}) AS body FROM ({PAGES}) p) b0 WHERE json_valid(body)
  UNION ALL SELECT page_id, body, list_append(path, i), members[i] FROM (SELECT page_id, body, path, {_LD_MEMBERS} AS members, unnest(range(1, len({_LD_MEMBERS}) + 1)) AS i FROM n) m)
SELECT page_id, node->>'$.name' AS name, node->>'$.sku' AS sku, coalesce(node->>'$.gtin13', node->>'$.mpn') AS gtin,
  CASE WHEN json_type(node, '$.brand') = 'OBJECT' THEN node->>'$.brand.name' ELSE node->>'$.brand' END AS brand,
  CASE json_type(node, '$.image') WHEN 'ARRAY' THEN array_to_string(list_transform(CAST(node->'$.image' AS JSON[]), lambda i: i->>'$'), ' ')
       WHEN 'OBJECT' THEN node->>'$.image.url' WHEN 'VARCHAR' THEN node->>'$.image' ELSE '' END AS images
FROM (SELECT page_id, arg_min(node, path) AS node FROM n WHERE {_LD_PRODUCT} GROUP BY page_id, body)
""",
)
def json_ld(spark, sf_dir):
    d = P.structured_data(pages(spark, sf_dir))
    nodes = F.size(H.ld_products(H.ld_documents(F.col("html"))))
    return d.filter(nodes > 0).select(
        "page_id", "name", "sku", "gtin",
        F.when(F.col("brand") != "MetaBrand", F.col("brand")).alias("brand"),
        F.array_join("image_urls", " ").alias("images"),
    )


@R.add(
    "pge_08_open_graph",
    f"""SELECT page_id, list_filter(m, lambda s: s.prop = 'og:title')[-1].content AS og_title,
  list_filter(m, lambda s: s.prop = 'og:description')[-1].content AS og_description,
  array_to_string(list_transform(list_filter(m, lambda s: s.prop = 'og:image'), lambda s: s.content), ' ') AS og_images,
  {nz(O.attribute(O.extract_all('html', r"<link[^>]*rel\s*=\s*[\"']canonical[\"'][^>]*>", 0) + '[1]', 'href'))} AS canonical_url
FROM (SELECT page_id, html, {O.metas('html')} AS m FROM ({PAGES}) p) z""",
)
def open_graph(spark, sf_dir):
    return P.structured_data(pages(spark, sf_dir)).select(
        "page_id", "og_title", "og_description", F.array_join("og_images", " ").alias("og_images"), "canonical_url"
    )


_KEYS = " UNION ALL ".join(
    f"SELECT '{a}' AS variant, key, count(*) AS n FROM k WHERE {O.relevant(a, 'key')} GROUP BY key" for a in M.COMPLIANCE_KEYS
)


@R.add(
    "flt_07_relevant_keys",
    f"WITH k AS (SELECT r.key AS key FROM (SELECT unnest({O.rows('html')}) AS r FROM ({PAGES}) p) z) {_KEYS}",
)
def relevant_keys(spark, sf_dir):
    rows = table_rows(spark, sf_dir)
    flags = F.array_compact(
        F.array(*[F.when(P.is_relevant_key(a, F.col("key")), F.lit(a)) for a in M.COMPLIANCE_KEYS])
    )
    return (
        rows.select("key", F.explode(flags).alias("variant")).groupBy("variant", "key").agg(F.count(F.lit(1)).alias("n"))
    )


_CLEAN = f"regexp_replace(html, {q('(?is)' + H.block_pattern(M.CLEAN_TAGS))}, chr(1), 'g')"
_BLOCK = r"<(?:p|li|div|span)\b[^>]*>(.*?)</(?:p|li|div|span)\s*>"


@R.add(
    "flt_12_compliance_paragraphs",
    f"""SELECT page_id, array_to_string(list_filter(list_transform({O.extract_all(_CLEAN, _BLOCK)}, lambda b: {O.node_text('b')}),
  lambda t: regexp_matches(lower(t), {q(O.any_of(M.COMPLIANCE_KEYS['generic']))})), chr(10)) AS compliance_text
FROM ({PAGES}) p""",
)
def compliance_paragraphs(spark, sf_dir):
    return pages(spark, sf_dir).select(
        "page_id", F.array_join(P.compliance_paragraphs(F.col("html")), "\n").alias("compliance_text")
    )


_BLOB = f"""CASE WHEN {extract(strip('s'), M.STATE_PREFIXES, 1, 's')} <> '' THEN {extract(strip('s'), M.STATE_PREFIXES, 1, 's')} WHEN starts_with({strip('s')}, '{{') THEN {strip('s')} ELSE '' END"""
_MASKED = "replace(replace(b, '\\\\', chr(1)), '\\\"', chr(2))"
_SHOWN = "replace(replace(replace(trim(t, '\"'), chr(1), '\\\\'), chr(2), '\\\"'), '\\/', '/')"
_STATE = f"""SELECT page_id, array_to_string(list_transform(flatten(list_transform(list_filter(list_transform({O.extract_all('html', H.SCRIPT)}, lambda s: {_BLOB}),
  lambda b: b <> '' AND json_valid(b)), lambda b: regexp_extract_all({_MASKED}, '"[^"]*"|-?[0-9]+(?:[.][0-9]+)?'))), lambda t: {_SHOWN}), ' ') AS state FROM ({PAGES}) p"""


@R.add("pge_09_state_text", f"SELECT page_id, state FROM ({_STATE}) z WHERE state <> ''")
def state_text(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", P.state_text(F.col("html")).alias("state")).filter("state <> ''")


_PRODUCT = "coalesce(n->'$.props.pageProps.product', n->'$.props.pageProps.productDetails')"


@R.add(
    "pge_10_next_data",
    f"""SELECT page_id, {_PRODUCT}->>'$.name' AS name, {_PRODUCT}->>'$.brand' AS brand, {_PRODUCT}->>'$.mrp' AS mrp
FROM (SELECT page_id, CAST(b AS JSON) AS n FROM (SELECT page_id, {O.next_script()} AS b FROM ({PAGES}) p) y WHERE json_valid(b)) z""",
)
def next_data(spark, sf_dir):
    d = pages(spark, sf_dir).select("page_id", P.next_data(F.col("html")).alias("n")).filter("n IS NOT NULL")

    def get(path):
        return F.coalesce(
            *[F.get_json_object("n", f"$.props.pageProps.{p}.{path}") for p in ("product", "productDetails")]
        )

    return d.select("page_id", get("name").alias("name"), get("brand").alias("brand"), get("mrp").alias("mrp"))


def _record(spark, sf_dir, source, fields):
    d = P.extract_pages(pages(spark, sf_dir))
    return d.filter(F.col("source") == source).select("page_id", *fields)


_BULLETS = f"{O.items('coalesce(' + O.section('html', 'feature-bullets') + ', ' + repr('') + ')')}"
_AMAZON_NAMED = {
    "title": O.title("amazon"),
    "bullet_manufacturer": f"list_filter({_BULLETS}, lambda b: regexp_matches(lower(b), {q(O.any_of(M.BULLET_MANUFACTURER))}))[1]",
    "bullet_packer": f"list_filter({_BULLETS}, lambda b: contains(lower(b), 'packed by'))[1]",
    "bullet_country": f"list_filter(list_transform({_BULLETS}, lambda b: {strip(extract('b', M.BULLET_COUNTRY, 1))}), lambda v: v <> '')[1]",
    "description_block": nz(O.node_text("coalesce(" + O.section("html", "productDescription") + ", '')", "chr(10)")),
    "price_block_text": nz(O.node_text("coalesce(" + ", ".join(O.section("html", i) for i in M.PRICE_IDS) + ", '')")),
}
_AMAZON_FIELDS = [f for f in M.RECORD_FIELDS if f in M.FIELDS["amazon"] and f != "consumer_care_phone"]


@R.add("pge_11_amazon_record", O.record(PAGES, "amazon", _AMAZON_FIELDS, _AMAZON_NAMED))
def amazon_record(spark, sf_dir):
    return _record(spark, sf_dir, "Amazon", _AMAZON_FIELDS)


_STATE_OF = _STATE.split(" AS state FROM")[0].removeprefix("SELECT page_id, ")


def _spec_blocks(which: tuple, words: list[str]) -> str:
    return f"list_filter(list_transform({O.elements('html', *which)}, lambda b: {O.node_text('b', 'chr(10)')}), lambda t: regexp_matches(lower(t), {q(O.any_of(words))}))"


_SPECS = (
    f"array_to_string(list_concat({_spec_blocks(P.SPEC_BLOCK, M.COMPLIANCE_KEYS['flipkart'])}, {_spec_blocks(P.SPEC_SECTION, M.SECTION_WORDS)}), chr(10))"
)
_FLIPKART_FIELDS = [f for f in M.RECORD_FIELDS if f in M.FIELDS["flipkart"]]
_FLIPKART_CORPUS = f"concat_ws(chr(10), {O.node_text('html')}, ' ' || {_STATE_OF}, {_SPECS})"


@R.add("pge_12_flipkart_record", O.record(PAGES, "flipkart", _FLIPKART_FIELDS, {"title": O.title("flipkart")}, corpus=_FLIPKART_CORPUS))
def flipkart_record(spark, sf_dir):
    return _record(spark, sf_dir, "Flipkart", _FLIPKART_FIELDS)


_LD_DOCS = f"list_filter(list_transform({O.extract_all('html', _LD)}, lambda b: {strip('b')}), lambda b: json_valid(b))"
_LD_TYPED = f"list_filter({_LD_DOCS}, lambda d: coalesce(CAST(d AS JSON)->>'$.\"@type\"', '') IN ('Product', 'ItemPage', 'FoodProduct'))"


def _ld_first(value: str) -> str:
    return f"list_filter(list_transform({_LD_TYPED}, lambda d: {value}), lambda v: v IS NOT NULL)[1]"


_PAIR_ROWS = f"list_filter(list_concat({_pairs_sql(_TWO, ': ')}, {_pairs_sql(_BOLD, ':')}), lambda r: r.key <> '' AND r.value <> '')"
_JIOMART_ROWS = f"list_concat({O.rows('html')}, list_reverse({_PAIR_ROWS}))"
_SHARED = O.row_value("Manufacturer Address")


def _named_maker(key: str) -> str:
    value = O.row_value(key)
    own = _SHARED if "Name" in key else f"coalesce({O.row_value(key + ' Address')}, {_SHARED})"
    return f"{value} || coalesce(CASE WHEN NOT contains({value}, {own}) THEN ', ' || {own} END, '')"


_JIOMART_NAMED = {
    "title": O.title("jiomart"),
    "ld_name": _ld_first("CAST(d AS JSON)->>'$.name'"),
    "ld_brand": f"list_transform({_LD_TYPED}, lambda d: CASE WHEN json_type(CAST(d AS JSON), '$.brand') = 'OBJECT' THEN CAST(d AS JSON)->>'$.brand.name' ELSE CAST(d AS JSON)->>'$.brand' END)[1]",
    "ld_description": _ld_first("CAST(d AS JSON)->>'$.description'"),
    "ld_price": f"list_filter(list_transform({_LD_DOCS}, lambda d: CAST(d AS JSON)->>'$.offers.price'), lambda v: v IS NOT NULL)[1]",
    "named_manufacturer": "coalesce(" + ", ".join(map(_named_maker, P.MAKER_KEYS)) + ")",
}
_JIOMART_FIELDS = [f for f in M.RECORD_FIELDS if f in M.FIELDS["jiomart"]]
_JIOMART_CORPUS = f"{O.node_text('html')} || chr(10) || ' ' || array_to_string({_LD_DOCS}, ' ')"


@R.add("pge_13_jiomart_record", O.record(PAGES, "jiomart", _JIOMART_FIELDS, _JIOMART_NAMED, corpus=_JIOMART_CORPUS, base_rows=_JIOMART_ROWS))
def jiomart_record(spark, sf_dir):
    return _record(spark, sf_dir, "JioMart", _JIOMART_FIELDS)


_SIZE = strip(extract("html", r'"brandSize"\s*:\s*"([^"]+)"', 1, ""))
_STATED = extract("html", r'"countryOfOrigin"\s*:\s*"([^"]{2,})"', 1, "")
_PD = M.PRODUCT_DETAILS
_ROUTE = case([(f"regexp_matches(lower(trim(i->>'$.title')), {q(p)})", q(f)) for f, p in M.DETAIL_ROUTES])
_ITEMS = (
    f"list_filter(list_transform(flatten(list_transform({O.extract_all('html', _PD, 1, 's')}, lambda b: CAST(CAST(b AS JSON) AS JSON[]))), "
    f"lambda i: {{'f': {_ROUTE}, 'c': {strip('(i->>' + repr('$.content') + ')')}}}), lambda s: lower(s.c) NOT IN ('', 'n/a', 'na'))"
)
_OG = strip("regexp_replace(" + strip(extract("html", r'<meta[^>]+property="og:title"[^>]+content="([^"]+)"', 1)) + f", {q(chr(40) + '?i)' + chr(92) + 's*' + chr(92) + '|' + chr(92) + 's*Myntra' + chr(92) + 's*$')}, '')")
_MYNTRA_NAMED = {
    "titled_name": f"coalesce({nz(strip(extract(_OG, r'^Buy\s+(.+?)\s*(?:\s*-\s*\w+\s*for\s+|\s*from\s+|\s*at\s+Rs)', 1)))}, CASE WHEN lower({_OG}) NOT IN ('', 'default') THEN {_OG} END)",
    "title": O.title("myntra"),
    "size_quantity": nz(f"lower({extract(_SIZE, M.SIZE_QUANTITY, 0)})"),
    "stated_country": f"CASE WHEN lower({_STATED}) NOT IN ('', 'country of origin') THEN {_STATED} END",
    **{f"detail_{f}": f"list_filter({_ITEMS}, lambda s: s.f = '{f}')[1].c" for f, _ in M.DETAIL_ROUTES},
}
_MYNTRA_FIELDS = [f for f in M.RECORD_FIELDS if f in M.FIELDS["myntra"]]


@R.add("pge_14_myntra_record", O.record(PAGES, "myntra", _MYNTRA_FIELDS, _MYNTRA_NAMED))
def myntra_record(spark, sf_dir):
    return _record(spark, sf_dir, "Myntra", _MYNTRA_FIELDS)


_NEXT = f"CASE WHEN json_valid({O.next_script()}) THEN CAST({O.next_script()} AS JSON) END"
_MEESHO_NAMED = {
    "title": O.title("meesho"),
    **{f"next_{f}": f"({_NEXT})->>'$.props.pageProps.product.{f}'" for f in ("name", "brand", "mrp", "description")},
}
_MEESHO_FIELDS = [f for f in M.RECORD_FIELDS if f in M.FIELDS["meesho"]]


@R.add("pge_15_meesho_record", O.record(PAGES, "meesho", _MEESHO_FIELDS, _MEESHO_NAMED))
def meesho_record(spark, sf_dir):
    return _record(spark, sf_dir, "Meesho", _MEESHO_FIELDS)


_DOCS = f"list_filter({O.extract_all('html', _LD)}, lambda b: json_valid(b))"
_NS = nz(O.next_script())
_GENERIC_NAMED = {
    "title": O.title("generic"),
    "next_name": f"coalesce({nz(extract(_NS, chr(34) + 'productName' + chr(34) + r'\s*:\s*' + chr(34) + '([^' + chr(34) + ']+)' + chr(34), 1, 's'))}, {nz(extract(_NS, r'"name"\s*:\s*"([^"]{6,})"', 1, 's'))})",
    "next_brand": f"regexp_extract_all({_NS}, {q(O.re2(r'"brand"\s*:\s*"([^"]+)"', 's'))}, 1)[-1]",
    "next_mrp": f"regexp_extract_all({_NS}, {q(O.re2(r'"mrp"\s*:\s*"?([^",}\]]+)', 's'))}, 1)[-1]",
    "ld_name": f"list_filter(list_transform({_DOCS}, lambda d: CAST(d AS JSON)->>'$.name'), lambda v: v IS NOT NULL)[1]",
    "ld_price": f"list_filter(list_transform({_DOCS}, lambda d: CAST(d AS JSON)->>'$.offers.price'), lambda v: v IS NOT NULL)[1]",
}
_GENERIC_FIELDS = [f for f in M.RECORD_FIELDS if f in M.FIELDS["generic"]]


@R.add("pge_16_prj_02_generic_record", O.record(PAGES, "generic", _GENERIC_FIELDS, _GENERIC_NAMED))
def generic_record(spark, sf_dir):
    return _record(spark, sf_dir, "Generic", _GENERIC_FIELDS)


_LST_SCAN = "list_filter([" + ", ".join(
    f"CASE WHEN {strip(extract('txt', p, 1, f))} <> '' THEN {{'key': {q(k)}, 'value': {strip(extract('txt', p, 1, f))}}} END" for k, p, f in P.LISTING_SCAN
) + "], lambda e: e IS NOT NULL)"
_LST_PAIRS = "flatten([" + ", ".join(O.key_value_items(f"coalesce({O.section('html', i)}, '')") for i in M.DETAIL_IDS[:3]) + "])"
_LST_CLEAN = f"regexp_replace(html, {q('(?is)' + H.block_pattern(M.CLEAN_TAGS[:6]))}, chr(1), 'g')"
_LST_KEEP = f"regexp_matches(lower(e.key), {q(O.any_of(M.COMPLIANCE_KEYS['listing_text']))})"
_LST_SKIP = f"regexp_matches(lower(e.key), {q(O.any_of(M.SKIPPED_KEYS['listing_text']))})"
_LST_ALWAYS = ", ".join(q(k) for k, _, _ in P.LISTING_SCAN)
_LST_MAIN = "coalesce(" + ", ".join(nz(extract("clean", p, 1, "is")) for p in P.LISTING_MAIN) + ", clean)"
_LST_BLOCKS = f"list_transform({O.elements('html', ['div'], H.by_class('|'.join(M.LISTING_CLASSES)))}, lambda b: {O.node_text('b', 'chr(10)')})"
# keys in order of first appearance, each with its last value
_LST_ROWS = "list_transform(list_filter(facts, lambda e, i: list_position(list_transform(facts, lambda f: f.key), e.key) = i), lambda e: {'key': e.key, 'value': list_filter(facts, lambda f: f.key = e.key)[-1].value})"


def _joined_parts(last: str) -> str:
    """Name, lines and a list of further parts, without blank ones, a blank line between."""
    return f"array_to_string(list_filter(list_concat(list_concat([coalesce(name, '')], lines), {last}), lambda p: p <> ''), chr(10) || chr(10))"


_LISTING = f"""WITH p AS (SELECT *, {O.first_contained('lower(url)', U.MARKETPLACES, "'Unknown'")} AS marketplace, {O.node_text('html')} AS txt, {O.rows('html')} AS tab, {_LST_CLEAN} AS clean FROM ({PAGES}) p0),
f AS (SELECT *, CASE WHEN marketplace = 'Amazon' THEN list_concat(list_concat(tab, {_LST_PAIRS}), {_LST_SCAN}) ELSE tab END AS facts,
  CASE WHEN marketplace = 'Amazon' THEN {O.title('amazon')} ELSE {nz(O.node_text(f"coalesce({O.element('html', M.TITLE['generic'][0])}, '')"))} END AS name,
  CASE WHEN marketplace = 'Amazon' THEN coalesce({nz(O.node_text("coalesce(" + ", ".join(O.section('html', i) for i in M.LISTING_PRICE_IDS) + ")"))}, 'MRP: Rs. ' || {nz(extract('txt', P.LISTING_MRP, 1))}) END AS price,
  {O.node_text(_LST_MAIN, 'chr(10)')} AS main_text, {_LST_BLOCKS} AS blocks FROM p),
l AS (SELECT *, list_transform(list_filter({_LST_ROWS}, lambda e: CASE WHEN marketplace = 'Amazon' THEN ({_LST_KEEP} OR e.key IN ({_LST_ALWAYS})) AND NOT {_LST_SKIP} ELSE {_LST_KEEP} END), lambda e: e.key || ': ' || e.value) AS lines FROM f),
b AS (SELECT *, CASE WHEN marketplace = 'Amazon' THEN CASE WHEN name IS NULL AND len(lines) = 0 AND price IS NULL THEN {O.node_text('clean', 'chr(10)')}
    ELSE concat_ws(chr(10), 'Product: ' || name, array_to_string(lines, chr(10)), chr(10) || 'MRP: ' || price, chr(10) || {q(M.LISTING_SOURCE)}, {q(M.LISTING_NOTE)}) END
  WHEN marketplace = 'Flipkart' THEN {_joined_parts('blocks')} ELSE {_joined_parts('[main_text]')} END AS body FROM l)
SELECT page_id, marketplace, name AS product_name, {strip(r"regexp_replace(body, '\n{3,}', chr(10) || chr(10), 'g')")} AS extracted_text, length(html) AS raw_html_length FROM b"""


@R.add("pge_17_listing_texts", _LISTING)
def listing_texts(spark, sf_dir):
    return P.listing_texts(pages(spark, sf_dir))


def record_images_sql(pages: str) -> str:
    """page_id and the list of product images of its record."""
    names = lambda e, site, group=0: O.extract_all(e, I.RECORD_IMAGES[site], group, "i")
    own = names("html", "flipkart")
    flipkart = f"list_transform(CASE WHEN len({own}) > 0 THEN {own} ELSE {names(f'coalesce({_STATE_OF}, {chr(39) * 2})', 'flipkart')} END, lambda u: regexp_replace(u, '/[0-9]{{2,4}}/[0-9]{{2,4}}/', '/832/832/', 'g'))"
    theme = " OR ".join([f"contains(u, {q(t)})" for t in I.THEME_IMAGES[:2]] + [f"contains(lower(u), {q(I.THEME_IMAGES[2])})"])
    full = "regexp_replace(regexp_replace(u, '/t\\.[a-zA-Z0-9_]+\\([^)]*\\)/', '/original/', 'g'), '\\?.*$', '')"
    jiomart = f"list_transform(list_filter({names('html', 'jiomart')}, lambda u: NOT ({theme})), lambda u: {full})"
    myntra = f"list_transform({names('html', 'myntra', 1)}, lambda p: {q(I.MYNTRA_FULL)} || p)"
    return f"""SELECT page_id, list_filter(us, lambda u, i: list_position(us, u) = i) AS images FROM (
  SELECT page_id, CASE {O.adapter()} WHEN 'flipkart' THEN {flipkart} WHEN 'jiomart' THEN {jiomart} WHEN 'myntra' THEN {myntra} ELSE [] END AS us FROM ({pages}) p) z"""


@R.add("pge_12_14_record_images", f"SELECT page_id, array_to_string(images, ' ') AS images FROM ({record_images_sql(PAGES)}) r WHERE len(images) > 0")
def record_images(spark, sf_dir):
    d = P.extract_pages(pages(spark, sf_dir)).select("page_id", "product_image_urls")
    return d.filter(F.size("product_image_urls") > 0).select("page_id", F.array_join("product_image_urls", " ").alias("images"))
