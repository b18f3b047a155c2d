"""Which ids have been stored: Bloom filters by bucket in front of an exact table.

An id belongs to one of ``BUCKETS`` buckets by its hash.  A layer holds a Bloom filter for each
bucket, ``BITS_PER_ID`` bits for every id it is made for; when it is full, a layer of at least twice the
size is begun.  A micro-batch reads the filters, whose number of files does not grow with the
number of batches, and rewrites those of the last layer only.  An id that no filter knows is new.  The few
others are looked up in the exact table, in their buckets only.

The last layer is written to two folders in turn, so that a job that fails while it writes leaves
the version before; a version counts only if all its rows are there.  Bits of a batch that is written again are there already
and do no harm: the exact table leaves out the batch itself.
"""

from __future__ import annotations

from math import ceil

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
BITS_PER_ID = 32
HASHES = 12
#: Least bits of a bucket's filter.
LEAST_BITS = 1 << 13
FILE_BYTES = 128 << 20


def bucket_of(scan_id: Column) -> Column:
    return F.pmod(F.xxhash64(scan_id), F.lit(BUCKETS)).cast("int")


def _place(scan_id: Column, k: int, bits: Column) -> Column:
    return F.pmod(F.xxhash64(scan_id, F.lit(k)), bits)


def _held(scan_id: Column, bits: Column) -> Column:
    """All of the id's places are marked."""
    hit = F.lit(True)
    for k in range(HASHES):
        place = _place(scan_id, k, F.size(bits).cast("bigint") * 64)
        word = F.get(bits, F.shiftright(place, 6).cast("int"))
        hit = hit & (F.call_function("shiftright", word, F.pmod(place, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return hit


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table; None if nothing has been written there yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def filters(spark: SparkSession, path: str) -> tuple[DataFrame | None, dict[int, tuple[int, int, int, int]]]:
    """The valid filters below ``path``, and for each layer its (slot, version, ids, bits of a bucket)."""
    state = read_table(spark, f"{path}/seen")
    if state is None:
        return None, {}
    # one row a layer and slot
    found = state.groupBy("layer", "slot").agg(
        F.max("version").alias("version"), F.max("size").alias("size"), F.count(F.lit(1)).alias("rows"), F.max("ids").alias("ids"), F.max(F.size("bits")).alias("words")
    )
    valid: dict[int, tuple[int, int, int, int]] = {}
    for r in sorted(found.filter("rows = size").collect(), key=lambda r: r["version"]):
        valid[r["layer"]] = (r["slot"], r["version"], r["ids"], r["words"] * 64)
    chosen = F.lit(False)
    for layer, (slot, *_) in valid.items():
        chosen = chosen | ((F.col("layer") == layer) & (F.col("slot") == slot))
    return state.filter(chosen), valid


def split_new(records: DataFrame, path: str) -> tuple[DataFrame, DataFrame | None]:
    """Records (scan_id, ...) whose id is surely new, and those that may be stored already (None if nothing is)."""
    state, _ = filters(records.sparkSession, path)
    if state is None:
        return records, None
    state = state.select(F.col("bucket").alias("bucket_"), F.col("bits").alias("bits_"))
    match = (bucket_of(F.col("scan_id")) == F.col("bucket_")) & _held(F.col("scan_id"), F.col("bits_"))
    return records.join(state, match, "left_anti"), records.join(state, match, "left_semi")


def unseen(records: DataFrame, path: str, batch: str) -> DataFrame:
    """Records (scan_id, ...) that no other batch below ``path`` has stored; each id once."""
    fresh = records.dropDuplicates(["scan_id"])
    new, maybe = split_new(fresh, path)
    if maybe is None:
        return new
    # only buckets of ids that may be stored; there are ``BUCKETS`` at most
    buckets = [r[0] for r in maybe.select(bucket_of(F.col("scan_id"))).distinct().collect()]
    if not buckets:
        return new
    stored = records.sparkSession.read.parquet(f"{path}/ids").filter(F.col("bucket").isin(buckets) & (F.col("batch").cast("string") != batch))
    return new.unionByName(maybe.join(stored.select("scan_id"), "scan_id", "left_anti").select(*new.columns))


def remember(ids: DataFrame, path: str, batch: str) -> None:
    """Store a batch's ids (scan_id) in the exact table and mark them in the filters."""
    spark = ids.sparkSession
    exact = f"{path}/ids/batch={batch}"
    ids.select("scan_id", bucket_of(F.col("scan_id")).alias("bucket")).repartitionByRange("bucket", "scan_id").sortWithinPartitions("bucket").write.mode("overwrite").parquet(exact)
    own = spark.read.parquet(exact)
    n = own.count()
    state, valid = filters(spark, path)
    layer = max(valid, default=0)
    slot, version, held, bits = valid.get(layer, (1, 0, 0, LEAST_BITS))
    if (held + n) * BITS_PER_ID > bits * BUCKETS and held:
        layer, slot, held, bits, state = layer + 1, 1, 0, bits * 2, None
    while (held + n) * BITS_PER_ID > bits * BUCKETS:
        bits *= 2
    place = F.explode(F.array(*[_place(F.col("scan_id"), k, F.lit(bits)) for k in range(HASHES)]))
    marks = own.select("bucket", place.alias("place")).select(
        "bucket", F.shiftright("place", 6).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("place", F.lit(64)).cast("int")).alias("bits")
    )
    blank = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(bits // 64 - 1))).alias("word"), F.lit(0).cast("bigint").alias("bits"))
    parts = [blank, marks]
    if state is not None and layer in valid and held:
        parts.append(state.filter(F.col("layer") == layer).select("bucket", F.posexplode("bits").alias("word", "bits")))
    words = parts[0]
    for more in parts[1:]:
        words = words.unionByName(more)
    dense = words.groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits")).groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w"))
    rows = dense.select(
        F.lit(version + 1).cast("bigint").alias("version"), F.lit(BUCKETS).cast("bigint").alias("size"), F.lit(held + n).cast("bigint").alias("ids"), "bucket",
        F.transform("w", lambda w: w["bits"]).alias("bits"),
    )
    files = max(1, ceil(BUCKETS * bits / 8 / FILE_BYTES))
    rows.repartition(files, "bucket").write.mode("overwrite").parquet(f"{path}/seen/layer={layer}/slot={1 - slot}")
