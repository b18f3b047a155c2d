"""The registered queries of the corpus operators, with checking SQL where SQL can say it."""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.sql import functions as F

from labelwright.functions.text import bind
from labelwright.plans.registry import Registry

from .common import table

R = Registry()


@R.add("op1_token_counts")
def token_counts(spark, sf_dir):
    from .token_count import count_tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")


def bpe_digests(docs, path):
    from .bpe_codec import round_trip

    coded = round_trip(docs, path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@R.add("op6_bpe_round_trip")
def bpe_round_trip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


@R.add("op2_simhash_groups")
def simhash_groups(spark, sf_dir):
    from .simhash import near_groups

    return near_groups(table(spark, sf_dir, "documents"))


@R.add(
    "op3_warc_index",
    """SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < winner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < winner THEN winner END AS refers_to
FROM (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS winner
  FROM (SELECT page_id, coalesce(html, '') AS html FROM pages) p) q""",
)
def warc_index(spark, sf_dir):
    from .common import new_folder
    from .warc import read_archives, write_archives

    folder = new_folder(spark, "warc")
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(index, folder)


# Words of a text as SQL; whole windows are compared as joined words.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@R.add(
    "op9_decontamination",
    f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(13, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) x WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM b) x),
dw AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM
  (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM b) ks WHERE len(w) >= k) x),
m AS (SELECT rid, item_id, i, dw.k FROM dw JOIN bw ON dw.k = bw.k AND dw.s = bw.s),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM m) x GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM m) x GROUP BY rid),
c AS (SELECT term, count(*) AS n FROM (SELECT unnest(w) AS term FROM d) x GROUP BY term),
bt AS (SELECT b.item_id, b.w AS v, k, p, b.w[p] AS term FROM (SELECT item_id, w, k, unnest(range(1, len(w) + 1)) AS p FROM b) b),
ba AS (SELECT DISTINCT item_id, v, k, a FROM (SELECT x.item_id, x.v, x.k, arg_min(y.p, (coalesce(c.n, 0), y.term, y.p)) AS a FROM bt x JOIN bt y ON y.item_id = x.item_id AND y.v = x.v AND y.p BETWEEN x.p AND x.p + 12
  LEFT JOIN c ON c.term = y.term WHERE x.p <= greatest(len(x.v) - 12, 1) GROUP BY x.item_id, x.v, x.k, x.p) g),
dp AS (SELECT rid, w, p, w[p] AS term FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS p FROM d) x WHERE w[p] IN (SELECT v[a] FROM ba)),
pr AS (SELECT rid, item_id, k, len(list_filter(range(greatest(1, a - 12), least(len(v), a + 12) + 1), lambda i: i = a
    OR (i < a AND list_contains(w[greatest(1, p - least(12, a - i + 2)):greatest(p - greatest(1, a - i - 2), 0)], v[i]))
    OR (i > a AND list_contains(w[p + greatest(1, i - a - 2):p + least(12, i - a + 2)], v[i])))) AS near FROM dp JOIN ba ON ba.v[ba.a] = dp.term),
n AS (SELECT rid, count(DISTINCT item_id) AS n_near FROM (SELECT rid, item_id FROM pr WHERE near >= k - k // 6 UNION ALL SELECT rid, item_id FROM m) x GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near_items
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid) LEFT JOIN n USING (rid)""",
)
def decontamination(spark, sf_dir):
    from .decontaminate import contamination

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark")).drop("items", "near_items", "text_hash")


@R.add(
    "op10_nearest_vectors",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) r WHERE rank <= 20""",
)
def nearest_vectors(spark, sf_dir):
    from .nearest import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@R.add("op8_toxicity")
def toxicity_scores(spark, sf_dir):
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@R.add("op4_quality")
def quality_scores(spark, sf_dir):
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@R.add("op5_personal_data")
def personal_data(spark, sf_dir):
    from .pii import KINDS, digest_text, personal_data

    found = personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    of = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *map(of, KINDS), F.sha2(digest_text(base).cast("binary"), 256).alias("base_sha256"), digest_text(F.col("spans")).alias("spans"))


# Tool traffic derived from the turns.  A user's turn calls a tool, and the assistant's next turn is the result; a system turn is a call
# without an identifier.  Turns with a comma call "note", other long ones "ask", and the rest a tool that has no schema.  In some
# conversations an identifier comes again, calls wait for each other or for themselves; some arguments lack a key, state one twice
# or with a wrong type, or hold nested values in a form that is not canonical.
_CALLS = """SELECT conv_id, turn, CASE WHEN role = 'user' THEN concat('c', CASE WHEN conv_id % 3 = 0 AND turn = 4 THEN 2 ELSE turn END) END AS call_id,
  CASE WHEN text LIKE '%,%' OR role = 'system' THEN 'note' WHEN length(text) > 40 THEN 'ask' ELSE 'other' END AS name,
  CASE WHEN conv_id % 5 = 1 AND turn IN (0, 2) THEN concat('c', 2 - turn) WHEN conv_id % 7 = 3 AND turn = 4 THEN 'c4' WHEN turn >= 2 THEN concat('c', turn - 2) END AS after,
  turn % 10 = 2 AS lacks, turn % 14 = 4 AS odd, length(text) % 9 = 5 AS twice, length(text) % 4 = 0 AS deep, text FROM {conversations} WHERE role IN ('user', 'system')"""
_RESULTS = "SELECT conv_id, turn, concat('c', turn - 1) AS call_id, text AS content FROM {conversations} WHERE role = 'assistant'"
_DEEP = '{"n" : [1.50, 1e2, -0, 12345678901234567890123456789012345678901234],"k":{ "b":true,"a":null},"\\ud83d\\ude00":2 ,"\\ufb01":"\\u00e9\\/"}'
_FLAT = '{"k":{"a":null,"b":true},"n":[1.5,100,0,12345678901234567890123456789012345678901234],"\ufb01":"\u00e9/","\U0001f600":2}'


def _over_conversations(query: str, name: str = "conversations") -> str:
    return query.replace("{conversations}", name)


_TOOL_SQL = f"""WITH RECURSIVE c0 AS ({_over_conversations(_CALLS)}), c AS (SELECT *, call_id IS NOT NULL AND turn = min(turn) OVER (PARTITION BY conv_id, call_id) AS first FROM c0), r AS ({_over_conversations(_RESULTS)}),
lv AS (SELECT conv_id, turn, call_id, first, 0 AS level FROM c WHERE NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.call_id = c.after)
  UNION ALL SELECT c.conv_id, c.turn, c.call_id, c.first, lv.level + 1 FROM c JOIN lv ON c.conv_id = lv.conv_id AND c.after = lv.call_id AND lv.first),
a AS (SELECT c.conv_id, c.turn, c.call_id, c.name, lv.level, r.content,
    CASE WHEN c.call_id IS NULL THEN 'unlinked' WHEN NOT c.first THEN 'duplicate' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
    concat('{{', CASE WHEN deep THEN concat('"opts":', '{_FLAT}', ',') END, '"size":', CASE WHEN odd AND NOT lacks THEN concat('"', length(text), '"') ELSE CAST(length(text) AS VARCHAR) END,
      CASE WHEN NOT lacks THEN concat(',"text":', CAST(to_json(text) AS VARCHAR)) END, '}}') AS arguments,
    array_to_string(list_filter([CASE WHEN lacks AND c.name <> 'other' THEN 'missing text' END, CASE WHEN twice THEN 'repeated size' END, CASE WHEN odd AND NOT lacks AND c.name <> 'other' THEN 'type of size' END,
      CASE WHEN c.name = 'other' THEN 'unknown tool' END], lambda p: p IS NOT NULL), '; ') AS problems
  FROM c LEFT JOIN lv USING (conv_id, turn) LEFT JOIN r ON c.first AND r.conv_id = c.conv_id AND r.call_id = c.call_id
  UNION ALL SELECT conv_id, turn, call_id, NULL, NULL, content, 'orphan', '{{}}', '' FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = r.conv_id AND c.call_id = r.call_id))
SELECT conv_id, turn, call_id, level, status, problems = '' AND status <> 'orphan' AS valid, problems,
  concat('{{"arguments":', arguments, ',', substr(CAST(json_object('call_id', call_id, 'content', content, 'level', level, 'name', name, 'status', status, 'valid', problems = '' AND status <> 'orphan') AS VARCHAR), 2)) AS line FROM a"""


@R.add("op7_tool_calls", _TOOL_SQL)
def tool_calls(spark, sf_dir):
    from .tool_calls import format_calls

    view = f"conversations_{uuid4().hex}"
    table(spark, sf_dir, "conversations").createOrReplaceTempView(view)
    made, results = (spark.sql(_over_conversations(q, view)) for q in (_CALLS, _RESULTS))
    spark.catalog.dropTempView(view)
    quoted = F.regexp_extract(F.to_json(F.struct("text")), r"(?s)^\{.text.:(.*)\}$", 1)
    size = F.length("text").cast("string")
    arguments = F.concat(
        F.lit("{"), F.when(~F.col("lacks"), F.concat(F.lit('"text": '), quoted, F.lit(","))).otherwise(""), F.when(F.col("twice"), F.lit('"size":[0],')).otherwise(""),
        F.when(F.col("deep"), F.lit(f'"opts": {_DEEP},')).otherwise(""), F.lit('"size" : '), F.when(F.col("odd") & ~F.col("lacks"), F.concat(F.lit('"'), size, F.lit('"'))).otherwise(size), F.lit("}"),
    )
    calls = made.select("conv_id", "turn", "call_id", "name", arguments.alias("arguments"), "after")
    schemas = spark.createDataFrame(
        [(n, k, t, r) for n in ("ask", "note") for k, t, r in (("text", "string", True), ("size", "integer", False), ("opts", "object", False))], "name string, key string, type string, required boolean"
    )
    return format_calls(calls, results, schemas)


def with_planted_repeats(docs):
    """Documents whose id has a crc32 divisible by ten go round in circles from some word on; the others stay as they are."""
    h, g = F.crc32(F.col("doc_id").cast("string")), F.floor(F.crc32(F.col("doc_id").cast("string")) / 10)

    def circling(words):
        n = F.size(words).cast("bigint")
        at = g % n
        period = 1 + F.floor((n - at) / (3 + g % 8))
        return F.transform(words, lambda w, i: F.when(i < at, w).otherwise(F.get(words, (at + (i - at) % period).cast("int"))))

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return docs.withColumn("text", F.when(h % 10 == 0, F.array_join(bind(words, circling), " ")).otherwise(F.col("text")))


# crc32 bit by bit over the digits; a pair of equal words six words long at a distance is extended by counting neighbouring pairs.
_RUNS_SQL = r"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda r, c: list_reduce([0::BIGINT, 1, 2, 3, 4, 5, 6, 7], lambda s, k: xor(s >> 1, (s & 1) * 3988292384), xor(r, c)), 4294967295), 4294967295) AS h FROM documents),
g AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM t),
d AS (SELECT rid, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) END AS w FROM g),
s AS (SELECT rid, i, array_to_string(w[i + 1:i + 6], ' ') AS gram FROM (SELECT rid, w, unnest(range(0, n - 5)) AS i FROM d WHERE n > 5)),
p AS (SELECT x.rid, x.i, y.i - x.i AS q FROM s x JOIN s y ON x.rid = y.rid AND x.gram = y.gram AND x.i < y.i),
e AS (SELECT rid, q, min(i) AS start, count(*) + 5 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM p) GROUP BY rid, q, island),
r AS (SELECT rid, start, length, min(q) AS period FROM e WHERE length >= 2 * q AND length >= 12 GROUP BY rid, start, length),
o AS (SELECT rid, count(*) AS n_runs, arg_min(struct_pack(start, length, period), [-length, start, period]) AS best,
  string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS runs FROM r GROUP BY rid),
z AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT d.rid, string_agg(d.word, ' ' ORDER BY d.i) AS kept FROM (SELECT rid, unnest(range(0, n)) AS i, unnest(w) AS word FROM d) d ANTI JOIN z ON z.rid = d.rid AND z.i = d.i GROUP BY d.rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN o USING (rid) LEFT JOIN k USING (rid)"""


@R.add("op11_periodic_runs", _RUNS_SQL)
def periodic(spark, sf_dir):
    from .periodic import periodic_runs

    found = periodic_runs(with_planted_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("least"), r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    found = found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), digest(F.array_join(lines, "")).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256")
    )
    exponent = F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli")
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent, "runs_sha256", "collapsed_sha256")


@R.add("op12_embedding_whitening")
def embedding_whitening(spark, sf_dir):
    from .whitening import whiten

    white = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "c")
    rows = white.select("vec_id", "n", "deviation", "identity_error", each)
    return rows.select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


def _mix_sql() -> str:
    from .mixing import SCHEDULES, integrated

    def solved(pieces):
        one = lambda a, s, r, m: f"{s!r}::DOUBLE + coalesce(2 * (u - {a!r}::DOUBLE) / nullif({r!r}::DOUBLE + sqrt(greatest({r!r}::DOUBLE * {r!r}::DOUBLE + 2 * {m!r}::DOUBLE * (u - {a!r}::DOUBLE), 0)), 0), 0)"
        return "CASE " + " ".join(f"WHEN u >= {p[0]!r}::DOUBLE THEN {one(*p)}" for p in reversed(pieces)) + " END"

    times = "CASE place % 3 " + " ".join(f"WHEN {i} THEN {solved(integrated(s))}" for i, s in enumerate(SCHEDULES)) + " END"
    return rf"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CASE WHEN source IS NULL THEN '1' ELSE concat('0', source) END AS k, coalesce(md5('mix:' || CAST(doc_id AS VARCHAR)), '') AS draw FROM documents),
s AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(k)) - 1 AS place FROM d GROUP BY k),
w AS (SELECT *, CAST([3, 1, 2][place % 3 + 1] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS gives FROM s),
l AS (SELECT *, ((SELECT CAST(sum(source_size) AS DOUBLE) FROM s) * 1.5::DOUBLE - coalesce(sum(gives) OVER o, 0)) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY gives / weight, encode(k) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(gives, weight * (SELECT max(level) FROM l)) AS target FROM l),
b AS (SELECT doc_id, size, source_size, target, place, CAST(floor(target + 0.5) AS BIGINT) AS due,
  CAST(coalesce(sum(size) OVER (PARTITION BY d.k ORDER BY draw, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d JOIN t USING (k)),
x AS (SELECT *, greatest(least(size, due - start), 0) AS first, greatest(least(size, due - source_size - start), 0) AS second, start / nullif(due, 0)::DOUBLE AS u FROM b)
SELECT doc_id, size, source_size, target, CAST(first + second AS BIGINT) AS taken, CASE WHEN first > 0 THEN {times} END AS position FROM x"""


@R.add("op13_curriculum_mix", _mix_sql())
def curriculum_mix(spark, sf_dir):
    from .mixing import mix

    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    found = mixed.select("doc_id", "size", "source_size", "target", "taken", F.array_min(F.transform("passes", lambda p: p["position"])).alias("position"))
    return found.orderBy(F.asc_nulls_last("position"), "doc_id")
