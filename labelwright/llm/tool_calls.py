"""Chat formatting of tool calls, in DataFrame operations only.

* Linking: calls and results meet in a hash join on conversation and call identifier.
* Order: a call may name the call whose result it uses (``after``).  Levels come from pointer doubling:
  each round every call jumps to the call its target had reached, so a chain of length n takes log2(n)
  rounds; every edge leads from a lower level to a higher one, and a call on a cycle gets no level.
* Validation: arguments are parsed, exploded into keys and joined with the schema of the tool; unknown tools,
  missing, unknown and repeated keys and wrong types are reported.
* Serialisation: canonical JSON without blanks, keys in order of code points at every depth, numbers with all their digits in one form.

Defined cases: a repeated identifier is told apart by its turn, the first call with it is the linked one and
later ones are ``duplicate``; of repeated results the earliest counts, all others and those of unknown calls
are ``orphan`` rows; arguments that are null count as an empty object, and those that are not a JSON object as
invalid (``null`` in the line); of a repeated key the last value counts; a call naming an unknown call starts a chain; calls without an
identifier are ``unlinked``; of calls or results of one turn and identifier any one is the first; texts of any length are kept
whole; empty tables give an empty result; other columns are not carried.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.functions.text import bind

from .common import cut

SCHEMA_BYTES = 8 << 20
TYPES = {"STRING": "string", "BIGINT": "integer", "BOOLEAN": "boolean", "VOID": "null", "DOUBLE": "number"}


def numbered(calls: DataFrame) -> DataFrame:
    """``calls`` (conv_id, turn, call_id, name, arguments, after) with a row key, canonical arguments (null if they are not
    JSON), the keys that these repeat, and whether each call is the first of its identifier."""
    text = F.coalesce("arguments", F.lit("{}"))
    rows = cut(calls.select("conv_id", "turn", "call_id", "name", text.alias("given"), repeated_keys(text).alias("repeated"), "after"))
    rows = rows.withColumns({"row": F.monotonically_increasing_id(), "arguments": canonical(F.col("given"))}).drop("given")
    rows = cut(rows)
    first = rows.filter("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "row")).alias("m"))
    first = first.select(F.col("m.row").alias("row"), F.lit(True).alias("first"))
    return rows.join(first, "row", "left").withColumn("first", F.coalesce("first", F.lit(False)))


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls with their results, and results without a call: adds ``content`` and ``status``."""
    given = cut(results.select("conv_id", F.col("turn").alias("result_turn"), "call_id", "content").withColumn("result_row", F.monotonically_increasing_id()))
    earliest = given.groupBy("conv_id", "call_id").agg(F.min(F.struct("result_turn", "result_row")).alias("m")).select(F.col("m.result_row").alias("result_row"), F.lit(True).alias("kept"))
    given = given.join(earliest, "result_row", "left")
    # what can't be linked keeps its own key, so that it meets nothing
    left = calls.withColumn("k", F.when(F.col("first"), F.col("call_id")))
    right = given.withColumnsRenamed({"conv_id": "result_conv", "call_id": "result_call"})
    both = left.join(right.filter("kept").hint("shuffle_hash"), F.col("conv_id").eqNullSafe(F.col("result_conv")) & (F.col("k") == F.col("result_call")), "left")
    linked = both.filter("result_row is not null").select("result_row")
    orphans = right.join(linked, "result_row", "left_anti")
    status = F.when(F.col("call_id").isNull(), "unlinked").when(~F.col("first"), "duplicate").when(F.col("result_row").isNull(), "unanswered").otherwise("linked")
    columns = ["conv_id", "turn", "call_id", "name", "arguments", "after", "row", "first", "content"]
    lost = orphans.select(
        F.col("result_conv").alias("conv_id"), F.col("result_turn").alias("turn"), F.col("result_call").alias("call_id"), *[F.lit(None).cast("string").alias(c) for c in ("name", "arguments", "after")],
        (-1 - F.col("result_row")).alias("row"), F.lit(False).alias("first"), "content", F.lit("orphan").alias("status"),
    )
    return both.select(*columns, status.alias("status")).unionByName(lost)


def levels(calls: DataFrame) -> DataFrame:
    """(row, level): the length of the chain of calls that each call follows; null on and behind a cycle."""
    ids = calls.filter("first").select("conv_id", F.col("call_id").alias("after"), F.col("row").alias("up"))
    now = cut(calls.join(ids, ["conv_id", "after"], "left").select("row", "up", F.when(F.col("up").isNull(), 0).otherwise(1).alias("level")))
    n, rounds = now.filter("up is not null").count(), 0
    waiting = n
    while waiting and 2**rounds <= n:
        there = now.select(F.col("row").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        now = cut(now.join(there, "up", "left").select("row", F.col("next").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")))
        waiting, rounds = now.filter("up is not null").count(), rounds + 1
    return now.select("row", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


# a text in quotes, one sign of structure, or anything else; escapes are masked before, by as many signs
TOKEN = r'"[^"]*"|[{}\[\],:]|[^"{}\[\],:]+'
MEMBER = "struct<key:string,place:int,text:string>"


def canonical_number(token: Column) -> Column:
    """One form for each number, with all its digits: plain from 1e-6 to 1e400, else with an exponent."""

    def form(p: Column) -> Column:
        sign, whole, part = (F.regexp_extract(token, r"^(-?)([0-9]+)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?$", i) for i in (1, 2, 3))
        return F.struct(sign.alias("sign"), F.concat(whole, part).alias("all"), (F.length(whole) + F.coalesce(p.try_cast("bigint"), F.lit(0))).alias("point"))

    def plain(x: Column) -> Column:
        lead = F.length(x["all"]) - F.length(F.ltrim(x["all"], F.lit("0")))
        digits, point = F.btrim(x["all"], F.lit("0")), x["point"] - lead

        def write(d: Column) -> Column:
            n, zeros = F.length(d), lambda k: F.repeat(F.lit("0"), k.cast("int"))
            cut = F.greatest(F.least(point, F.lit(512)), F.lit(-64)).cast("int")
            text = (
                F.when(d == "", F.lit("0"))
                .when((point >= n) & (point <= 400), F.concat(d, zeros(cut - n)))
                .when((point > 0) & (point <= 400), F.concat(F.substring(d, F.lit(1), cut), F.lit("."), F.substring(d, cut + 1, n)))
                .when((point <= 0) & (point > -6), F.concat(F.lit("0."), zeros(-cut), d))
                .otherwise(F.concat(F.substring(d, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(d, F.lit(2), n))).otherwise(""), F.lit("e"), (point - 1).cast("string")))
            )
            return F.when(d == "", text).otherwise(F.concat(x["sign"], text))

        return bind(digits, write)

    power = F.regexp_extract(token, r"[eE]([+-]?[0-9]+)$", 1)
    return bind(form(power), plain)


def _scalar(token: Column) -> Column:
    """Canonical text of a string (in quotes), a number or a literal."""
    value = F.get_json_object(F.concat(F.lit('{"v":'), token, F.lit("}")), "$.v")
    quoted = F.to_json(F.struct(value.alias("v")))
    return F.when(token.startswith('"'), F.substring(quoted, F.lit(6), F.length(quoted) - 6)).when(token.rlike("^-?[0-9]"), canonical_number(token)).otherwise(token)


def _closed(frame: Column) -> Column:
    """Text of a list, or of an object with its keys in order, the last of repeated ones."""
    sorted_ = F.array_sort(frame["members"])
    after = lambda i: F.get(sorted_, i + 1)["key"]
    last = F.filter(sorted_, lambda m, i: ~F.coalesce(after(i) == m["key"], F.lit(False)))
    pairs = F.transform(last, lambda m: F.concat(m["key"], F.lit(":"), m["text"]))
    listed = F.transform(frame["members"], lambda m: m["text"])
    return F.when(frame["list"], F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]"))).otherwise(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")))


def canonical(json: Column) -> Column:
    """Canonical form of a JSON text: no blanks, keys in order of code points, strings with the fewest escapes, one form for each
    number that keeps its digits; of repeated keys the last counts; null if it is not JSON.

    One pass over the tokens; the containers that are open form a stack.
    """
    valid = F.try_parse_json(json).isNotNull() | F.from_json(json, "map<string,string>").isNotNull()
    masked = F.replace(F.replace(json, F.lit("\\\\"), F.lit("\u0001\u0001")), F.lit('\\"'), F.lit("\u0001\u0002"))
    tokens = F.filter(F.transform(F.regexp_extract_all(masked, F.lit(TOKEN), F.lit(0)), lambda t: F.btrim(t, F.lit(" \t\r\n"))), lambda t: t != "")
    zero = F.struct(F.lit(None).cast("string").alias("held"), F.lit(None).cast("string").alias("key"), F.array().cast(f"array<struct<list:boolean,key:string,members:array<{MEMBER}>>>").alias("open"))

    def shown(t: Column) -> Column:
        return F.replace(F.replace(t, F.lit("\u0001\u0002"), F.lit('\\"')), F.lit("\u0001\u0001"), F.lit("\\\\"))

    def filled(s: Column) -> Column:
        """The innermost container with the value that is held."""
        top = F.try_element_at(s["open"], F.lit(-1))
        member = F.struct(s["key"].alias("key"), F.size(top["members"]).alias("place"), s["held"].alias("text"))
        members = F.when(s["held"].isNull(), top["members"]).otherwise(F.concat(top["members"], F.array(member)))
        return F.struct(top["list"].alias("list"), top["key"].alias("key"), members.alias("members"))

    def walk(s: Column, t: Column) -> Column:
        opens, closes = t.isin("{", "["), t.isin("}", "]")
        n, none = F.size(s["open"]), F.lit(None).cast("string")
        frame = F.struct((t == "[").alias("list"), s["key"].alias("key"), F.array().cast(f"array<{MEMBER}>").alias("members"))
        outer = F.slice(s["open"], F.lit(1), F.greatest(n - 1, F.lit(0)))
        held = F.when(opens | t.isin(":", ","), none).when(closes, bind(filled(s), _closed)).otherwise(bind(shown(t), _scalar))
        key = F.when(t == ":", s["held"]).when(opens | (t == ","), none).when(closes, F.try_element_at(s["open"], F.lit(-1))["key"]).otherwise(s["key"])
        stack = F.when(opens, F.concat(s["open"], F.array(frame))).when(closes, outer).when((t == ",") & (n > 0), F.concat(outer, F.array(filled(s)))).otherwise(s["open"])
        return F.struct(held.alias("held"), key.alias("key"), stack.alias("open"))

    return F.when(valid, F.aggregate(tokens, zero, walk, lambda s: s["held"]))


def repeated_keys(json: Column) -> Column:
    """Keys that a JSON object states more than once, at its top."""
    keys = F.coalesce(F.map_keys(F.from_json(json, "map<string,string>")), F.array().cast("array<string>"))
    return F.array_distinct(bind(F.array_sort(keys), lambda ks: F.filter(ks, lambda k, i: F.coalesce(F.get(ks, i + 1) == k, F.lit(False)))))


def problems(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(row, problems): what is wrong with the arguments of each call; calls without fault have no row.

    ``schemas``: a row (name, key, type, required) per parameter.
    """
    size = schemas.agg(F.coalesce(F.sum(F.octet_length("name") + F.octet_length("key") + 64), F.lit(0))).first()[0]
    small = F.broadcast if size <= SCHEMA_BYTES else (lambda df: df)
    tools = small(schemas.select("name").distinct().withColumn("known", F.lit(True)))
    parsed = calls.join(tools, "name", "left").select("row", "name", "known", "arguments", F.try_parse_json("arguments").alias("v"))
    keys = F.from_json(F.to_json("v"), "map<string,string>")
    is_object = F.schema_of_variant("v").startswith("OBJECT")
    whole = parsed.select("row", "name", "known", "arguments", "v", (F.col("v").isNotNull() & is_object).alias("object"), keys.alias("keys"))
    wrong = whole.select("row", F.when(F.col("known").isNull(), F.lit("unknown tool")).when(~F.coalesce("object", F.lit(False)), F.lit("not an object")).alias("problem")).filter("problem is not null")
    good = whole.filter("known and object")
    needed = good.select("row", "name", "keys").join(small(schemas.filter("required").select("name", "key")), "name")
    missing = needed.filter(~F.coalesce(F.map_contains_key("keys", F.col("key")), F.lit(False))).select("row", F.concat(F.lit("missing "), "key").alias("problem"))
    view = f"calls_{uuid4().hex}"
    good.createOrReplaceTempView(view)
    each = calls.sparkSession.sql(
        f"SELECT row, name, e.key AS key, schema_of_variant(e.value) AS kind, arguments FROM {view}, LATERAL variant_explode(v) AS e"
    )
    calls.sparkSession.catalog.dropTempView(view)
    plain = F.split("kind", r"[<(]")[0]
    kind = F.when(plain.isin("OBJECT", "ARRAY"), F.lower(plain)).when(plain == "DECIMAL", "number")
    for have, name in TYPES.items():
        kind = kind.when(plain == have, name)
    # a whole number beyond the decimals is stated with all its digits in the canonical arguments
    digits = F.concat(F.lit(r"\Q"), F.to_json(F.array("key")).substr(F.lit(2), F.length(F.to_json(F.array("key"))) - 2), F.lit(r"\E:-?[0-9]{19,}[,}]"))
    kind = F.when((kind == "number") & F.regexp_like("arguments", digits), "integer").otherwise(kind)
    typed = each.withColumn("kind", kind).join(small(schemas.select("name", "key", "type")), ["name", "key"], "left")
    fits = (F.col("kind") == F.col("type")) | ((F.col("kind") == "integer") & (F.col("type") == "number"))
    bad = typed.select("row", F.when(F.col("type").isNull(), F.concat(F.lit("unknown "), "key")).when(~fits, F.concat(F.lit("type of "), "key")).alias("problem")).filter("problem is not null")
    twice = calls.select("row", F.explode("repeated").alias("k")).select("row", F.concat(F.lit("repeated "), "k").alias("problem"))
    return wrong.union(missing).union(bad).union(twice).groupBy("row").agg(F.sort_array(F.collect_set("problem")).alias("problems"))


def format_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """A row per call and per orphan result: conv_id, turn, call_id, level, status, valid, problems and ``line``, canonical JSON.

    Sorting a conversation's rows by (level, turn) puts every call behind the one it follows.
    """
    rows = cut(numbered(calls))
    linked, placed, found = link(rows, results), levels(rows), problems(rows, schemas)
    whole = linked.join(placed, "row", "left").join(found, "row", "left")
    none = F.array().cast("array<string>")
    checked = whole.withColumn("problems", F.coalesce("problems", none)).withColumn("valid", (F.size("problems") == 0) & (F.col("status") != "orphan"))
    head = F.to_json(F.struct("call_id", "content", "level", "name", "status", "valid"), {"ignoreNullFields": "false"})
    arguments = F.when(F.col("status") == "orphan", "{}").otherwise(F.coalesce("arguments", F.lit("null")))
    line = F.concat(F.lit('{"arguments":'), arguments, F.lit(","), F.substring(head, 2, 1 << 30))
    return checked.select("conv_id", "turn", "call_id", F.col("level").cast("int").alias("level"), "status", "valid", F.array_join("problems", "; ").alias("problems"), line.alias("line"))
