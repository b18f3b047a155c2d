"""Image-candidate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import images as I
from ..functions.text import any_of
from ..operators import images as M
from ..oracle.page_sql import attribute, elements, extract_all, metas, section
from ..oracle.sqlx import case, extract, has, q, re2, strip
from . import corpus as C
from .q_pages import PAGES, pages, record_images_sql
from .registry import Registry

R = Registry()
CAND = C.sql(C.IMAGE_CANDIDATES)


def candidates(spark, sf_dir):
    return C.frame(spark, sf_dir, C.IMAGE_CANDIDATES)


def _valid(u: str) -> str:
    scheme = extract(f"lower({u})", r"^([a-z][a-z0-9+.\-]*):", 1, "")
    hosted = f"(regexp_matches({u}, {q(any_of(I.CDN_HOSTS))}) AND regexp_matches({u}, {q(I.ANY_EXTENSION)}))"
    return (
        f"coalesce(length({u}) >= 20 AND NOT starts_with({u}, 'data:') AND {scheme} IN ('http', 'https', '') "
        f"AND ({has(u, I.EXTENSIONS)} OR {hosted} OR regexp_matches({u}, {q(I.OPEN_HOSTS)})), false)"
    )


def _skip(u: str, a: str) -> str:
    return f"({has(u, I.SKIP_URL)} OR {has(a, I.SKIP_ALT)} OR coalesce(regexp_matches({u}, {q(I.TINY_SIZE)}), false))"


@R.add(
    "flt_08_10_image_filters",
    f"""SELECT product_id, ord, url, {_valid('url')} AS valid, {_skip('url', 'alt')} AS skipped,
  coalesce(length(url) >= 15 AND regexp_matches(lower(url), '^https?:') AND NOT {has('url', I.USEFUL_SKIP)}
    AND ({has('url', I.USEFUL_EXTENSION)} OR {has('url', I.USEFUL_HOSTS)} OR contains(lower(url), 'image') OR contains(lower(url), 'img')), false) AS useful
FROM ({CAND}) c""",
)
def image_filters(spark, sf_dir):
    url = F.col("url")
    return candidates(spark, sf_dir).select(
        "product_id", "ord", "url",
        I.is_valid_image_url(url).alias("valid"),
        I.should_skip(url, F.col("alt")).alias("skipped"),
        I.is_useful_image(url).alias("useful"),
    )


def _sum(*pairs) -> str:
    return " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p in pairs)


def _size_sql(u: str, flags: str) -> str:
    return "try_cast(" + " || ".join(extract(u, I.SIZE_TOKEN, g, flags) for g in (1, 2, 3)) + " AS INT)"


_IDX = f"try_cast({extract('url', I.INDEX_TOKEN, 1, '')} AS INT)"
_COMBINED = "lower(url || ' ' || coalesce(alt, ''))"
_COLLECTOR = (
    f"CASE WHEN {_size_sql('url', '')} >= 1000 THEN 25 WHEN {_size_sql('url', '')} >= 500 THEN 12 ELSE 0 END"
    f" + CASE WHEN {_IDX} = 1 THEN 5 WHEN {_IDX} BETWEEN 2 AND 6 THEN 20 WHEN {_IDX} BETWEEN 7 AND 9 THEN -10 WHEN {_IDX} IS NOT NULL THEN -20 ELSE 0 END"
    " + CASE WHEN contains(url, 'rukminim') THEN CASE WHEN contains(url, '/832/') OR contains(url, '/1664/') THEN 20 ELSE 10 END ELSE 0 END"
    " + CASE WHEN contains(url, 'jiomartjcp.com') OR contains(url, 'jiomart.com') OR contains(url, 'jiostatic.com') THEN CASE WHEN contains(url, '/original/') THEN 22 ELSE 18 END ELSE 0 END + "
    + _sum(
        (f"regexp_matches(url, {q(I.GROCERY_HOSTS)})", 15),
        (f"regexp_matches(url, {q(I.TRANSFORM_TOKEN)})", 15),
        ("contains(url, 'amazon_gallery') OR contains(url, 'adapter')", 20),
        (f"regexp_matches({_COMBINED}, {q(I.LABEL_WORDS)})", 15),
    )
)


@R.add("img_07_collector_score", f"SELECT product_id, ord, url, {_COLLECTOR} AS score FROM ({CAND}) c")
def collector_score(spark, sf_dir):
    return candidates(spark, sf_dir).select(
        "product_id", "ord", "url", I.collector_score(F.col("url"), F.col("alt")).alias("score")
    )


# no look-ahead in the checking dialect: the last "logo" must not be followed by "product"
_PLAIN_REJECT = I.REJECT_URL.replace(r"logo(?!.*product)|", "")
_REJECTED = (
    f"({has('u', _PLAIN_REJECT)} OR (contains(u, 'logo') AND NOT contains(regexp_replace(u, '^.*logo', ''), 'product')))"
)
_IDX2 = "lpad(CAST(idx AS STRING), 2, '0')"
_TERMS = [
    (has("a", I.REJECT_ALT), -60, "'Alt text matches promotional/marketing content'"),
    ("regexp_extract(u, '[_-]([0-9]{2,3})x([0-9]{2,3})[_-]', 1) <> '' AND regexp_extract(u, '[_-]([0-9]{2,3})x([0-9]{2,3})[_-]', 1) = regexp_extract(u, '[_-]([0-9]{2,3})x([0-9]{2,3})[_-]', 2) OR regexp_matches(u, '/[0-9]{2}x[0-9]{2}/')", -40, "'Appears to be a tiny thumbnail'"),
    (has("u", I.THUMB_TOKEN), -50, "'Amazon small thumbnail URL'"),
    *[(f"source IN ({', '.join(q(n) for n in names)})", p, q(r)) for names, p, r in I.SOURCE_TRUST],
    (has("u", I.PREFER_URL), 20, "'URL matches high-res/packaging pattern (+20)'"),
    ("size >= 1000", 25, "'Amazon high-res image ' || CAST(size AS STRING) || 'px (+25)'"),
    ("size BETWEEN 500 AND 999", 12, "'Amazon medium-res image ' || CAST(size AS STRING) || 'px (+12)'"),
    (f"regexp_matches(u, {q(I.TRANSFORM_TOKEN)})", 18, "'Cloudinary high-res transform (+18)'"),
    ("idx = 1", 5, "'Amazon primary image index 01 (+5)'"),
    ("idx BETWEEN 2 AND 5", 18, f"'Amazon image index ' || {_IDX2} || ' (back/side/detail range, +18)'"),
    ("idx BETWEEN 6 AND 9", -15, f"'Amazon image index ' || {_IDX2} || ' (likely lifestyle/promo, -15)'"),
    ("idx >= 10", -25, f"'Amazon image index ' || {_IDX2} || ' (very likely brand/lifestyle, -25)'"),
    (has("a", I.PREFER_ALT), 18, "'Alt text suggests compliance-relevant content (+18)'"),
]
_ALT_PTS = case([(has("a", p), str(n)) for p, n in I.ALT_KEYWORDS], "0")
_ALT_WHY = case([(has("a", p), q(f"Alt text: '{p}' compliance field (+{n})")) for p, n in I.ALT_KEYWORDS])
_KW = case([(f"contains(u, '{w}')", f"'{w}'") for w in I.URL_KEYWORDS])
_CATS = {c: " + ".join(f"CASE WHEN contains(t, {q(w)}) THEN 1 ELSE 0 END" for w in ws) for c, ws in I.CATEGORIES.items()}
_BEST = "greatest(" + ", ".join(_CATS.values()) + ")"
_CATEGORY = (
    f"CASE WHEN {_REJECTED} THEN 'non_packaging' WHEN {_BEST} > 0 THEN "
    + case([(f"({e}) = {_BEST}", q(c)) for c, e in _CATS.items()])
    + f" WHEN regexp_matches(url, {q(I.SIZED_URL)}) THEN 'front_package' ELSE 'unknown' END"
)
_HITS = f"CASE WHEN {_REJECTED} THEN 0 WHEN {_BEST} > 0 THEN {_BEST} WHEN regexp_matches(url, {q(I.SIZED_URL)}) THEN 1 ELSE 0 END"
_BASE = f"""SELECT *, lower(url) AS u, lower(coalesce(alt, '')) AS a, lower(url || ' ' || coalesce(alt, '')) AS t,
  {_size_sql('lower(url)', 'i')} AS size, {_IDX} AS idx FROM ({CAND}) c"""
_URL_SCORED = f"""SELECT *, CASE WHEN {_REJECTED} THEN -120 ELSE {_sum(*[(c, p) for c, p, _ in _TERMS])} + {_ALT_PTS}
    + CASE WHEN {_KW} IS NOT NULL THEN 12 ELSE 0 END + CASE WHEN score > 0 THEN least(score, 15) ELSE 0 END END AS url_score,
  CASE WHEN {_REJECTED} THEN 'URL matches non-packaging pattern (icon/logo/UI/promotional)' ELSE
    concat_ws('; ', {', '.join(f'CASE WHEN {c} THEN {r} END' for c, _, r in _TERMS)}, {_ALT_WHY}, 'URL contains ''' || {_KW} || ''' (+12)') END AS url_reasons,
  {_CATEGORY} AS category FROM ({_BASE}) b"""


@R.add("img_08_url_score", f"SELECT product_id, ord, url, url_score, url_reasons FROM ({_URL_SCORED}) z")
def url_score(spark, sf_dir):
    return M.score_by_url(candidates(spark, sf_dir)).select(
        "product_id", "ord", "url", "url_score", F.array_join("url_reasons", "; ").alias("url_reasons")
    )


@R.add(
    "img_09_classify",
    f"""SELECT product_id, ord, url, {_CATEGORY} AS category, round(least(0.5 + ({_HITS}) * 0.1, 0.95), 2)::DOUBLE AS confidence,
  ({_CATEGORY}) IN ('front_package', 'back_package', 'side_label', 'nutrition') AS is_packaging FROM ({_BASE}) b""",
)
def classify(spark, sf_dir):
    d = candidates(spark, sf_dir).select("product_id", "ord", "url", I.classify_image(F.col("url"), F.col("alt")).alias("c"))
    return d.select("product_id", "ord", "url", "c.category", "c.confidence", "c.is_packaging")


_O = "ocr_text"
_SIG = {k: has(_O, p) for k, p in I.SIGNALS.items()}
_SIG["has_fssai"] = f"({_SIG['has_fssai']} OR {has(_O, I.LICENCE_LABEL)})"
_NUMBER = f"({has(_O, I.LICENCE_STRICT, '')} OR {has(_O, I.LICENCE_SPACED, '')})"
_WORDS = f"len(list_filter(regexp_split_to_array({strip(_O)}, '[\\s\\x0b\\x{{a0}}]+'), lambda w: w <> ''))"
_MARKETING = f"({has(_O, I.MARKETING_SIGNAL)} AND NOT ({' OR '.join(_SIG.values())}))"
_NUTRITION = f"({has(_O, I.NUTRITION_SIGNAL)} AND NOT {_SIG['has_ingredients']})"
_BOOST = (
    f"CASE WHEN {_SIG['has_fssai']} AND {_NUMBER} THEN 150 WHEN {_SIG['has_fssai']} THEN 80 ELSE 0 END"
    f" + CASE WHEN {_WORDS} >= 40 THEN 60 WHEN {_WORDS} >= 20 THEN 25 ELSE 0 END + "
    + _sum(*[(_SIG[k], p) for k, p, _ in I.SIGNAL_POINTS], (_MARKETING, -40))
)


@R.add(
    "img_10_text_signals",
    f"""SELECT product_id, ord, url, CASE WHEN coalesce(ocr_text, '') <> '' THEN {_BOOST} END AS boost,
  CASE WHEN coalesce(ocr_text, '') <> '' THEN {_WORDS} END AS word_count,
  CASE WHEN coalesce(ocr_text, '') <> '' THEN {_MARKETING} END AS is_marketing_only,
  CASE WHEN coalesce(ocr_text, '') <> '' THEN {_NUTRITION} END AS has_nutrition_only,
  {', '.join(f"CASE WHEN coalesce(ocr_text, '') <> '' THEN {e} END AS {k}" for k, e in _SIG.items())} FROM ({CAND}) c""",
)
def text_signals(spark, sf_dir):
    d = candidates(spark, sf_dir).select("product_id", "ord", "url", I.text_signals(F.col("ocr_text")).alias("t"))
    s = F.col("t.signals")
    return d.select(
        "product_id", "ord", "url", "t.boost",
        *[s[k].alias(k) for k in ("word_count", "is_marketing_only", "has_nutrition_only", *I.SIGNALS)],
    )


_SCORED = f"""SELECT *, CASE WHEN seen THEN visual_score ELSE 0 END AS vis, url_score + CASE WHEN seen THEN visual_score ELSE 0 END AS pre_score,
  url_score + CASE WHEN seen THEN visual_score ELSE 0 END + CASE WHEN url_score + CASE WHEN seen THEN visual_score ELSE 0 END > -50 AND coalesce(ocr_text, '') <> '' THEN {_BOOST} ELSE 0 END AS compliance_score
FROM (SELECT *, url_score > -50 AS seen FROM ({_URL_SCORED}) z0) z1"""


@R.add(
    "img_15_srt_04_total_score",
    f"SELECT product_id, ord, url, url_score, vis AS visual_score, compliance_score FROM ({_SCORED}) z",
)
def total_score(spark, sf_dir):
    return M.score_images(candidates(spark, sf_dir)).select(
        "product_id", "ord", "url", "url_score", "visual_score", "compliance_score"
    )


@R.add(
    "img_05_dedupe",
    f"""SELECT product_id, ord, url FROM (SELECT *, row_number() OVER (PARTITION BY product_id, string_split(url, '?')[1] ORDER BY score DESC, ord, url) AS rn FROM ({CAND}) c) z WHERE rn = 1""",
)
def dedupe(spark, sf_dir):
    return M.dedupe(candidates(spark, sf_dir), [-F.col("score"), F.col("ord"), F.col("url")]).select("product_id", "ord", "url")


@R.add(
    "agg_10_category_counts",
    f"SELECT product_id, category, count(*) AS images, count(*) FILTER (WHERE compliance_score < -30) AS rejected FROM ({_SCORED}) z GROUP BY product_id, category",
)
def category_counts(spark, sf_dir):
    return M.category_counts(M.score_images(candidates(spark, sf_dir)))


_UNIQUE = M._bits(*M.UNIQUE_SIGNALS)
_MASK_PARTS = {
    "has_fssai_with_number": f"{_SIG['has_fssai']} AND {_NUMBER}", "has_dense_text": f"{_WORDS} >= 40", "has_nutrition_only": _NUTRITION, **_SIG
}
_MASK = " + ".join(f"CASE WHEN ocr_read AND ({_MASK_PARTS[f]}) THEN {1 << i} ELSE 0 END" for i, f in enumerate(M.FIELD_WEIGHTS))
_NEXT = f"""SELECT s.product_id, list_concat(s.picks, CASE WHEN n.pos IS NULL THEN [] ELSE [n.pos] END) AS picks FROM {{last}} s LEFT JOIN (
  SELECT product_id, arg_min(pos, (-worth, pos)) AS pos FROM (
    SELECT c.product_id, c.pos, c.compliance_score + {_sum(*[(f"c.mask & {1 << i} <> 0 AND t.covered & {1 << i} = 0", w) for i, w in enumerate(M.FIELD_WEIGHTS.values())])}
      + CASE WHEN c.mask & {M._bits('has_dense_text')} <> 0 THEN {M.DENSE_BONUS} ELSE 0 END + CASE WHEN c.ocr_read THEN {M.SIGNAL_BONUS} ELSE 0 END AS worth
    FROM live c JOIN (SELECT s.product_id, any_value(s.picks) AS picks, coalesce(bit_or(d.mask), 0) AS covered, coalesce(bool_or(d.category = 'front_package'), false) AS front
        FROM {{last}} s LEFT JOIN pool d ON d.product_id = s.product_id AND list_contains(s.picks, d.pos) WHERE len(s.picks) < {M.MAX_SELECTED} GROUP BY s.product_id) t ON c.product_id = t.product_id
    WHERE NOT (t.front AND c.category = 'front_package') AND NOT EXISTS (SELECT 1 FROM pool d WHERE d.product_id = c.product_id AND list_contains(t.picks, d.pos)
      AND (d.pos = c.pos OR (d.hash <> '' AND d.hash = c.hash) OR (d.category = c.category AND c.category IN ('front_package', 'back_package')
        AND abs(d.compliance_score - c.compliance_score) <= {M.SCORE_GAP} AND (c.mask | d.mask) & {_UNIQUE} = 0)))) w GROUP BY product_id) n ON n.product_id = s.product_id"""
_best = lambda cond: f"arg_min(pos, (-compliance_score, pos)) FILTER (WHERE {cond})"
_num, _lic, _den = (f"mask & {M._bits(f)} <> 0" for f in ("has_fssai_with_number", "has_fssai", "has_dense_text"))
_POOL = f"""pool AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY compliance_score DESC, pre_score DESC, url_score DESC, ord, url) AS pos FROM (
    SELECT *, row_number() OVER (PARTITION BY product_id, string_split(url, '?')[1] ORDER BY compliance_score DESC, pre_score DESC, url_score DESC, ord, url) AS rn FROM (
      SELECT product_id, ord, url, url_score, pre_score, compliance_score, category, ocr_read, CASE WHEN seen THEN coalesce(phash, '') ELSE '' END AS hash, {_MASK} AS mask, ocr_read AND {_MARKETING} AS marketing
      FROM (SELECT *, pre_score > -50 AND coalesce(ocr_text, '') <> '' AS ocr_read FROM ({_SCORED}) z) y) x WHERE string_split(url, '?')[1] <> '') v WHERE rn = 1)"""
_SELECT = f"""WITH {_POOL},
live AS (SELECT * FROM pool WHERE compliance_score >= {M.MIN_SCORE} AND NOT marketing),
p0 AS (SELECT product_id, list_concat(list_concat(CASE WHEN a IS NULL THEN [] ELSE [a] END, CASE WHEN b IS NULL THEN [] ELSE [b] END),
    CASE WHEN c IS NULL OR coalesce(c = a, false) OR coalesce(c = b, false) THEN [] ELSE [c] END) AS picks
  FROM (SELECT product_id, {_best(_num)} AS a, {_best(f"{_lic} AND NOT ({_num})")} AS b, {_best(f"{_den} AND NOT ({_num})")} AS c FROM live GROUP BY product_id) f),
{', '.join(f"p{i + 1} AS MATERIALIZED (" + _NEXT.replace("{last}", f"p{i}") + ")" for i in range(M.MAX_SELECTED))},
fin AS (SELECT * FROM p{M.MAX_SELECTED}),
picked AS (SELECT product_id, unnest(picks) AS pos, unnest(range(1, len(picks) + 1)) AS rank FROM fin)
SELECT d.product_id, CAST(k.rank AS INT) AS rank, d.url, 'coverage' AS how, d.compliance_score, d.category FROM picked k JOIN pool d USING (product_id, pos)
UNION ALL SELECT product_id, CAST(r + n AS INT), url, 'fill', compliance_score, category FROM (
  SELECT d.*, coalesce(len(f.picks), 0) AS n, row_number() OVER (PARTITION BY d.product_id ORDER BY d.pos) AS r FROM pool d LEFT JOIN fin f ON f.product_id = d.product_id
  WHERE d.compliance_score > {M.MIN_SCORE} AND NOT EXISTS (SELECT 1 FROM picked k WHERE k.product_id = d.product_id AND k.pos = d.pos)) u WHERE r + n <= {M.MAX_SELECTED}"""


@R.add("img_11_13_select", _SELECT)
def select(spark, sf_dir):
    return M.select_images(M.score_images(candidates(spark, sf_dir)))


_CELL = f"category IN ('front_package', 'back_package') AND mask & {_UNIQUE} = 0"
_TWINS = f"""WITH {_POOL},
near AS (SELECT p.product_id, p.pos, count(*) AS n FROM pool p JOIN pool d ON d.product_id = p.product_id AND d.pos <> p.pos AND ((p.hash <> '' AND d.hash = p.hash) OR (d.category = p.category
  AND p.category IN ('front_package', 'back_package') AND abs(d.compliance_score - p.compliance_score) <= {M.SCORE_GAP} AND (p.mask | d.mask) & {_UNIQUE} = 0)) GROUP BY p.product_id, p.pos)
SELECT product_id, url, CASE WHEN hash <> '' THEN first_value(url) OVER (PARTITION BY product_id, hash ORDER BY pos) END AS hash_class,
  CASE WHEN {_CELL} THEN first_value(url) OVER (PARTITION BY product_id, {_CELL}, category, compliance_score ORDER BY pos) END AS cell_class, coalesce(n, 0) AS n_near
FROM pool LEFT JOIN near USING (product_id, pos)"""


@R.add("img_12_near_duplicates", _TWINS)
def near_duplicates(spark, sf_dir):
    return M.near_duplicates(M.score_images(candidates(spark, sf_dir)))


@R.add(
    "img_12_near_cells",
    f"""WITH {_POOL},
cells AS (SELECT product_id, category, compliance_score AS score, arg_min(url, pos) AS url, count(*) AS n FROM pool WHERE {_CELL} GROUP BY 1, 2, 3)
SELECT product_id, a.category, a.url AS a_url, a.score AS a_score, a.n AS a_images, b.url AS b_url, b.score AS b_score, b.n AS b_images
FROM cells a JOIN cells b USING (product_id) WHERE a.category = b.category AND a.score > b.score AND a.score - b.score <= {M.SCORE_GAP}""",
)
def near_cells(spark, sf_dir):
    return M.near_cells(M.score_images(candidates(spark, sf_dir)))


_MISSING = f"SELECT DISTINCT product_id, CASE ord % 4 WHEN 0 THEN 'fssai' WHEN 1 THEN 'ingredients' WHEN 2 THEN 'manufacturer' ELSE 'mrp' END AS field FROM ({CAND}) c"


def _missing(spark, sf_dir):
    field = F.when(F.col("ord") % 4 == 0, "fssai").when(F.col("ord") % 4 == 1, "ingredients").when(F.col("ord") % 4 == 2, "manufacturer").otherwise("mrp")
    return C.frame(spark, sf_dir, C.IMAGE_CANDIDATES).select("product_id", field.alias("field")).distinct()


def _lack(f: str) -> str:
    return f"list_contains(missing, '{f}')"


_RANK_BOOST = " + ".join(
    [f"CASE WHEN ocr_read AND {_SIG[s]} AND {_lack(f)} THEN 60 ELSE 0 END" for s, f in M.SIGNAL_FIELDS.items()]
    + [
        f"CASE WHEN {_lack(f)} THEN CASE category " + " ".join(
            f"WHEN '{c}' THEN {M.PLACE_POINTS[min(i, 2)]}" for i, c in enumerate(types)
        ) + " ELSE 0 END ELSE 0 END"
        for f, types in M.PREFERRED_TYPES.items()
    ]
    + [
        f"CASE WHEN {_lack(f)} AND ({' OR '.join(f'contains(lower(coalesce(ocr_text, {chr(39)}{chr(39)})), {q(w)})' for w in ws)}) THEN 20 ELSE 0 END"
        for f, ws in M.PREVIEW_WORDS.items()
    ]
)


@R.add(
    "img_14_rank_for_missing",
    f"""SELECT product_id, ord, url, compliance_score + {_RANK_BOOST} AS field_score
FROM (SELECT z.*, m.missing, pre_score > -50 AND coalesce(ocr_text, '') <> '' AS ocr_read
  FROM ({_SCORED}) z JOIN (SELECT product_id, list(field) AS missing FROM ({_MISSING}) GROUP BY product_id) m USING (product_id)) y""",
)
def rank_for_missing(spark, sf_dir):
    ranked = M.rank_for_missing(M.score_images(candidates(spark, sf_dir)), _missing(spark, sf_dir))
    return ranked.select("product_id", "ord", "url", "field_score")


@R.add(
    "jn_09_flag_selected",
    f"SELECT c.product_id, c.url, s.url IS NOT NULL AS auto_selected FROM ({CAND}) c LEFT JOIN (SELECT DISTINCT product_id, url FROM ({CAND}) WHERE score >= 20) s ON c.product_id = s.product_id AND c.url = s.url",
)
def flag_selected(spark, sf_dir):
    c = C.frame(spark, sf_dir, C.IMAGE_CANDIDATES)
    return M.flag_selected(c, c.filter("score >= 20")).select("product_id", "url", "auto_selected")


@R.add(
    "jn_10_unknown_requests",
    f"SELECT product_id, url FROM (SELECT product_id, CASE WHEN ord % 5 = 0 THEN url || '#x' ELSE url END AS url FROM ({CAND}) c) r WHERE NOT EXISTS (SELECT 1 FROM ({CAND}) k WHERE k.product_id = r.product_id AND k.url = r.url)",
)
def unknown_requests(spark, sf_dir):
    c = C.frame(spark, sf_dir, C.IMAGE_CANDIDATES)
    requests = c.select("product_id", F.when(F.col("ord") % 5 == 0, F.concat("url", F.lit("#x"))).otherwise(F.col("url")).alias("url"))
    return M.unknown_requests(requests, c)


def _upgrade_sql() -> str:
    p = I.AMAZON_TRANSFORM
    t = extract("url", p, 2)
    return (
        f"CASE WHEN {t} = '' THEN url WHEN contains({t}, 'PKmb') OR contains(lower({t}), 'play-button') THEN '' "
        f"ELSE {extract('url', p, 1)} || '._SL1500_' || {extract('url', p, 3)} END"
    )


@R.add(
    "img_02_upgrade_urls",
    f"""SELECT product_id, ord, url, {_upgrade_sql()} AS amazon, regexp_replace(url, '/[0-9]+/[0-9]+/', '/832/832/', 'g') AS flipkart,
  regexp_replace(regexp_replace(url, '/t\\.\\w+\\([^)]*\\)/', '/original/', 'g'), '\\?.*$', '') AS jiomart,
  regexp_replace(url, '/[0-9]+/[0-9]+', '/1080/1080', 'g') AS meesho FROM ({CAND}) c""",
)
def upgrade_urls(spark, sf_dir):
    url = F.col("url")
    return candidates(spark, sf_dir).select(
        "product_id", "ord", "url", I.upgrade_amazon(url).alias("amazon"), I.upgrade_flipkart(url).alias("flipkart"),
        I.upgrade_jiomart(url).alias("jiomart"), I.upgrade_meesho(url).alias("meesho"),
    )


@R.add(
    "img_03_best_of_srcset",
    """SELECT page_id, CASE WHEN 100 + page_id % 5 * 150 > 100 + page_id % 7 * 100 THEN url || '/b.jpg' ELSE url || '/a.jpg' END AS best FROM pages""",
)
def best_of_srcset(spark, sf_dir):
    widths = C.table(spark, sf_dir, "pages").selectExpr(
        "page_id", "concat(url, '/a.jpg ', 100 + page_id % 7 * 100, 'w, ', url, '/b.jpg ', 100 + page_id % 5 * 150, 'w') AS srcset"
    )
    return widths.select("page_id", I.best_of_srcset(F.col("srcset")).alias("best"))


_USEFUL = (
    f"coalesce(length(url) >= 15 AND regexp_matches(lower(url), '^https?:') AND NOT {has('url', I.USEFUL_SKIP)} "
    f"AND ({has('url', I.USEFUL_EXTENSION)} OR {has('url', I.USEFUL_HOSTS)} OR contains(lower(url), 'image') OR contains(lower(url), 'img')), false)"
)
_STATE_IMAGES = f"""WITH k AS (SELECT DISTINCT page_id, url FROM (SELECT page_id, regexp_replace(u, '/[0-9]{{2,3}}/[0-9]{{2,3}}/', '/832/832/', 'g') AS url
    FROM (SELECT page_id, unnest({extract_all('html', M.STATE_IMAGES, 1, 'i')}) AS u FROM ({PAGES}) p) x) y WHERE {_USEFUL}),
b AS (SELECT DISTINCT page_id, url FROM (SELECT page_id, unnest({extract_all('html', M.BARE_IMAGES, 1, 'i')}) AS url FROM ({PAGES}) p) x
  WHERE {_USEFUL} AND regexp_matches(url, {q(M.BARE_HOSTS)}) AND NOT EXISTS (SELECT 1 FROM k WHERE k.page_id = x.page_id AND k.url = x.url))
SELECT page_id, url, 'product' AS alt, 'browser_state' AS source, 15 AS score FROM k UNION ALL SELECT page_id, url, 'product', 'browser_cdn', 18 FROM b"""


@R.add("img_03_04_state_images", _STATE_IMAGES)
def state_images(spark, sf_dir):
    return M.state_images(pages(spark, sf_dir))


@R.add("img_06_union_sources")
def union_sources(spark, sf_dir):
    """All sources of a page's images: collected, structured data, its record, and the record of the rendered page."""
    from ..operators.pages import extract_pages, structured_data

    p = pages(spark, sf_dir)
    collected = M.collect_images(p).withColumnRenamed("page_id", "product_id")
    both = structured_data(p).select(
        F.col("page_id").alias("product_id"), F.posexplode(F.concat("image_urls", "og_images")).alias("ord", "url")
    )
    own, rendered = (M.record_candidates(extract_pages(d)) for d in (p, _rendered(p)))
    return M.union_sources(collected, jsonld=both, adapter=own, browser_adapter=rendered).select("product_id", "url", "alt", "source", "score")


def _rendered(p):
    """The pages as a browser might show them: the same, but for one image that only scripts add."""
    return p.withColumn("html", F.replace("html", F.lit("back-"), F.lit("side-")))


_RENDERED = f"SELECT page_id, url, replace(html, 'back-', 'side-') AS html FROM ({PAGES}) r"
_OGS = f"list_transform(list_filter({metas('html')}, lambda s: s.prop = 'og:image'), lambda s: s.content)"
_POOL_SOURCES = f"""SELECT 'P' || product_id AS product_id, 0 AS rank, ord, url, alt, source, score FROM ({CAND}) c
UNION ALL SELECT page_id, 1, 0, unnest({_OGS}), '', 'jsonld', 5 FROM ({PAGES}) p
UNION ALL SELECT page_id, 2, 0, unnest(images), 'product', 'adapter', 12 FROM ({record_images_sql(PAGES)}) r
UNION ALL SELECT page_id, 3, 0, unnest(images), 'product', 'browser_adapter', 18 FROM ({record_images_sql(_RENDERED)}) r"""


@R.add(
    "img_06_stated_union",
    f"""SELECT product_id, url, best.alt AS alt, best.source AS source, best.score + CASE WHEN best.source = 'adapter' THEN {M.ADAPTER_BOOST} ELSE 0 END AS score FROM (
  SELECT product_id, url, arg_min(struct_pack(alt, source, score), (rank, ord, source, coalesce(alt, ''), score)) AS best FROM ({_POOL_SOURCES}) s WHERE url <> '' GROUP BY product_id, url) b""",
)
def stated_union(spark, sf_dir):
    """The union of stated candidates with the images that pages and their records name."""
    from ..functions.html import meta_values
    from ..functions.html import metas as read_metas
    from ..operators.pages import extract_pages

    p = pages(spark, sf_dir)
    stated = candidates(spark, sf_dir).withColumn("product_id", F.concat(F.lit("P"), "product_id"))
    og = p.select(F.col("page_id").alias("product_id"), F.posexplode(meta_values(read_metas(F.col("html")), "og:image")).alias("ord", "url"))
    own, rendered = (M.record_candidates(extract_pages(d)) for d in (p, _rendered(p)))
    return M.union_sources(stated, jsonld=og, adapter=own, browser_adapter=rendered).select("product_id", "url", "alt", "source", "score")


def _given(urls: str, source: str, alt: str = "''") -> str:
    return f"list_transform({urls}, lambda u: {{'url': u, 'alt': {alt}, 'source': {q(source)}}})"


def _tag_images(html: str, source: str, *names: str) -> str:
    url = "coalesce(" + ", ".join(f"nullif({attribute('g', n)}, '')" for n in names) + ")"
    tags = extract_all(html, r"<img\b[^>]*>", 0)
    return f"list_filter(list_transform({tags}, lambda g: {{'url': {url}, 'alt': {attribute('g', 'alt')}, 'source': {q(source)}}}), lambda c: c.url IS NOT NULL)"


def _og_images(source: str, alt: str, *props: str) -> str:
    return f"list_transform(list_filter({metas('html')}, lambda s: s.prop IN ({', '.join(map(q, props))})), lambda s: {{'url': s.content, 'alt': {alt}, 'source': {q(source)}}})"


def _ld_of(source: str, alt: str, typed: bool) -> str:
    images = "CASE json_type(CAST(d AS JSON), '$.image') WHEN 'ARRAY' THEN list_transform(CAST(CAST(d AS JSON)->'$.image' AS JSON[]), lambda i: i->>'$') WHEN 'OBJECT' THEN [CAST(d AS JSON)->>'$.image.url'] WHEN 'VARCHAR' THEN [CAST(d AS JSON)->>'$.image'] ELSE [] END"
    docs = f"list_filter(list_transform({extract_all('html', H.LD_SCRIPT)}, lambda b: {strip('b')}), lambda b: json_valid(b))"
    if typed:
        docs = f"list_filter({docs}, lambda d: coalesce(CAST(d AS JSON)->>'$.\"@type\"', '') IN ('Product', 'ItemPage'))"
    return _given(f"list_filter(flatten(list_transform({docs}, lambda d: {images})), lambda u: u <> '')", source, alt)


def _chain(*lists: str) -> str:
    out = lists[0]
    for more in lists[1:]:
        out = f"list_concat({out}, {more})"
    return out


def _first_url(cands: str, key: str = "c.url") -> str:
    """First candidate of each key."""
    return f"list_transform([{cands}], lambda cs: list_filter(cs, lambda c, i: list_position(list_transform(cs, lambda c: {key}), {key}) = i))[1]"


_USABLE = f"({_valid('c.url')} AND NOT {_skip('c.url', 'c.alt')})"
_ROOT = extract("url", r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)


def _absolute(u: str, root: str) -> str:
    return f"CASE WHEN starts_with({strip(u)}, '//') THEN 'https:' || {strip(u)} WHEN starts_with({strip(u)}, '/') THEN {root} || {strip(u)} ELSE {strip(u)} END"


_IMG_KINDS = case([(has("url", M.AMAZON_SITE), "'amazon'")] + [(f"contains(lower(url), {q(f)})", q(n)) for f, n in M.SITES], "'generic'")
_ABOVE = f"regexp_replace(html, {q(re2(M.REVIEWS_START + '.*', 'is'))}, '')"
_BLOCK = extract("above", M.COLOR_IMAGES, 0, "is")
_JS_TEXT = f"CASE WHEN {_BLOCK} <> '' THEN {_BLOCK} ELSE above END"
_JS = f"list_transform([{_JS_TEXT}], lambda t: CASE WHEN len({extract_all('t', M.HIRES, 1, 'i')}) > 0 THEN {extract_all('t', M.HIRES, 1, 'i')} ELSE {extract_all('t', M.LARGE, 1, 'i')} END)[1]"
_GALLERY = "coalesce(" + ", ".join(section("html", i) for i in ("altImages", "imageBlock_feature_div", "imageBlock")) + ", '')"
_UPGRADED = f"list_filter(list_transform(%s, lambda c: {{'url': {_upgrade_sql().replace('url', _absolute('c.url', chr(39) * 2))}, 'alt': c.alt, 'source': c.source}}), lambda c: {_USABLE})"
_IMAGE_KEY = f"CASE WHEN {extract('c.url', I.AMAZON_ID, 1, '')} <> '' THEN {extract('c.url', I.AMAZON_ID, 1, '')} ELSE c.url END"
_AMAZON_ELSE = _first_url(
    _UPGRADED % _given(f"list_transform({extract_all('above', M.ANY_AMAZON, 0, 'i')}, lambda u: regexp_replace(u, '(?i)([.]_[^.]+_)?[.](?:jpg|jpeg|png|webp)$', '._SL1500_.jpg'))", "html_cdn_fallback"), _IMAGE_KEY
)
_AMAZON_OG = f"list_filter({_og_images('og_image', chr(39) * 2, 'og:image')}, lambda c: {_USABLE})"
_MYNTRA = f"list_transform(list_filter({extract_all('html', M.MYNTRA_CDN, 1, 'i')}, lambda p: NOT contains(p, 'retaillabs')), lambda p: {q(M.MYNTRA_PREFIX)} || p)"
_JIO = f"list_transform(list_filter({extract_all('html', M.JIOMART_CDN, 0, 'i')}, lambda u: NOT regexp_matches(lower(u), {q(M.JIOMART_SKIP)})), lambda u: regexp_replace(regexp_replace(u, '/t\\.\\w+\\([^)]*\\)/', '/original/', 'g'), '\\?.*$', ''))"
_SITE_IMAGES = {
    "flipkart": _chain(
        _given(f"list_transform({extract_all('html', M.FLIPKART_CDN, 1, 'i')}, lambda u: regexp_replace(u, '/[0-9]+/[0-9]+/', '/832/832/', 'g'))", "flipkart_cdn", "'product'"),
        _tag_images(f"array_to_string({elements('html', ['div'], H.by_class(M.FLIPKART_CLASSES))}, ' ')", "flipkart_gallery", "src", "data-src"),
    ),
    "jiomart": _chain(_given(_JIO, "jiomart_cdn", "'product'"), _ld_of("jiomart_jsonld", "'product'", False), _og_images("og_image", "'product'", "og:image")),
    "myntra": _given(_MYNTRA, "myntra_script", "'product'"),
    "meesho": _given(f"list_transform({extract_all('html', M.MEESHO_CDN, 0, 'i')}, lambda u: regexp_replace(u, '/[0-9]+/[0-9]+', '/1080/1080', 'g'))", "meesho_cdn", "'product'"),
}
_TAG = extract("html", M.LANDING, 0, "is")
_SIZES = f"coalesce(try_cast({attribute(_TAG, 'data-a-dynamic-image')} AS JSON), '{{}}'::JSON)"
_AREA = "coalesce(CAST(j->k->0 AS BIGINT) * CAST(j->k->1 AS BIGINT), 0)"
_DYNAMIC = f"list_transform([{_SIZES}], lambda j: list_sort(list_transform(json_keys(j), lambda k: {{'area': {_AREA}, 'url': k}}), 'DESC')[1].url)[1]"
_LANDING = _chain(
    f"list_filter([{{'url': {attribute(_TAG, 'data-old-hires')}, 'alt': {attribute(_TAG, 'alt')}, 'source': 'landingImage_hires'}}], lambda c: c.url <> '')",
    f"list_filter([{{'url': {_DYNAMIC}, 'alt': {attribute(_TAG, 'alt')}, 'source': 'landingImage_dynamic'}}], lambda c: coalesce(c.url <> '', false))",
)
_AMAZON_ALL = _first_url(_UPGRADED % _chain(_given(_JS, "colorImages_js"), _tag_images("gallery", "altImages_dom", "src"), _LANDING), _IMAGE_KEY)
_SITE_IMAGES["amazon"] = _chain(f"list_transform([{_AMAZON_ALL}], lambda m: CASE WHEN len(m) > 0 THEN m ELSE {_AMAZON_ELSE} END)[1]", _AMAZON_OG)
_BEST = (
    "list_transform([list_filter(string_split(s, ','), lambda p: trim(p) <> '')], lambda ps: list_sort(list_transform(ps, lambda p, i: "
    "{'size': CASE WHEN len(regexp_extract_all(p, '\\S+')) > 1 THEN coalesce(try_cast(regexp_replace(regexp_extract_all(p, '\\S+')[-1], '[wx]+$', '') AS INT), 0) ELSE 0 END, "
    "'first': -i, 'url': regexp_extract_all(p, '\\S+')[1]}), 'DESC')[1].url)[1]"
)
_SRCSET = f"coalesce(list_transform([{attribute('g', 'srcset')}], lambda s: CASE WHEN s <> '' THEN {_BEST} END)[1], '')"
_PER_TAG = "[" + ", ".join(
    [f"{{'url': {attribute('g', a)}, 'alt': {attribute('g', 'alt')}, 'source': {q('generic_' + a)}}}" for a in M.LAZY_ATTRIBUTES]
    + [f"{{'url': {_SRCSET}, 'alt': {attribute('g', 'alt')}, 'source': 'generic_srcset'}}", f"{{'url': {attribute('g', 'src')}, 'alt': {attribute('g', 'alt')}, 'source': 'img_tag'}}"]
) + "]"
_BODY = f"substr(html, coalesce(nullif(instr(html, {extract('html', M.CONTAINER, 0, 'is')}), 0), 1))"
_PAGE_TAGS = f"list_filter({extract_all(_BODY, r'<img\b[^>]*>', 0)}, lambda g: NOT {_skip(attribute('g', 'src'), attribute('g', 'alt'))})"
_SITE_IMAGES["generic"] = _chain(
    _og_images("og_image", "''", "og:image", "og:image:secure_url"), _og_images("twitter_image", "''", "twitter:image", "twitter:image:src"), _ld_of("jsonld", "''", True),
    f"list_filter(flatten(list_transform({_PAGE_TAGS}, lambda g: {_PER_TAG})), lambda c: c.url <> '')",
)
_RAW_IMAGES = "CASE kind " + " ".join(f"WHEN {q(k)} THEN {e}" for k, e in _SITE_IMAGES.items()) + " END"
_FULL = f"list_filter(list_transform(raw, lambda c: {{'url': {_absolute('c.url', 'root')}, 'alt': c.alt, 'source': c.source}}), lambda c: {_USABLE})"
_COLLECTED = f"""WITH p AS (SELECT *, {_IMG_KINDS} AS kind, {_ROOT} AS root, {_ABOVE} AS above, {_GALLERY} AS gallery FROM ({PAGES}) p0),
r AS (SELECT page_id, root, {_RAW_IMAGES} AS raw FROM p),
c AS (SELECT page_id, unnest({_first_url(_FULL)}) AS c, unnest(range(1, len({_first_url(_FULL)}) + 1)) AS i FROM r),
s AS (SELECT page_id, i, c.url AS url, c.alt AS alt, c.source AS source FROM c)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, i) - 1 AS ord, url, alt, source, score FROM (SELECT *, {_COLLECTOR} AS score FROM s) z"""


@R.add("img_01_collect_images", _COLLECTED)
def collect(spark, sf_dir):
    return M.collect_images(pages(spark, sf_dir))
