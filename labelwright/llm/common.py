"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from labelwright.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared checkpoint folder, and read from it: like ``cut``, but smaller for many rows."""
    path = new_folder(df.sparkSession, kind)
    df.write.parquet(path)
    gc.collect()  # lets Spark drop finished plans and their shuffle files
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, most: str = "4m") -> None:
    """Let Arrow batches of this session hold so many bytes at most; the default bounds rows only, and so not the memory of long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


#: What a worker process keeps from task to task, by the module that keeps it.
_KEPT: dict[str, list] = {}


def keeps(cache):
    """Mark a cached function whose values a worker keeps until a task of another module begins."""
    _KEPT.setdefault(cache.__module__, []).append(cache)
    return cache


def settle() -> None:
    """Give memory that a task has freed back to the system; the allocators keep it else, and stages that share a worker add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def begin(module: str) -> None:
    """Drop what other modules keep in this worker, as a task of ``module`` begins."""
    held = [c for other, caches in _KEPT.items() if other != module for c in caches if c.cache_info().currsize]
    for cache in held:
        cache.cache_clear()
    if held:
        settle()


def add_columns(
    df: DataFrame, inputs: list[str], schema: str, make: Callable[[], Callable[..., list[pa.Array]]], clash: str = "drop"
) -> DataFrame:
    """Append the columns of ``schema``, computed batch by batch from the columns ``inputs``.

    ``make`` runs once per task and returns a function from Arrow arrays to Arrow
    arrays; what other modules keep in the worker is dropped first.  Rows are cut to at most 512 a call, so that a batch of long texts is
    handled in bounded steps.  Columns of ``df`` that clash with a new name are
    replaced by it.
    """
    new = StructType.fromDDL(schema).names
    keep = [f for f in df.schema.fields if f.name not in new]
    carried = [f.name for f in keep]
    narrow = df.select(*[df[c] for c in carried])
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [schema])
    missing = [c for c in inputs if c not in carried]
    if missing:
        raise ValueError(f"input columns are overwritten or absent: {missing}")

    owner = make.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(owner)
        work = make()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                got = work(*[batch.column(batch.schema.get_field_index(c)) for c in inputs])
                yield pa.RecordBatch.from_arrays([*batch.columns, *got], names=[*batch.schema.names, *new])
        work = batch = got = whole = None
        settle()

    return narrow.mapInArrow(run, out)


def spread_join(left: DataFrame, right: DataFrame, key: str, rows: str) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row a key and the number of its ``rows`` in ``left``.

    A key that holds over a thousandth of all rows would go to one task.  There are fewer than
    a thousand such keys, whatever the data, so these are broadcast, and the rows of all other keys are
    shuffled.  Rows whose key is null are left out.  ``rows`` is not kept.
    """
    others = [c for c in right.columns if c not in (key, rows)]
    total = right.agg(F.sum(rows)).first()[0] or 0
    hot = right.filter(F.col(rows) * 1000 > total).select(key, F.struct(*others).alias("hot_"))
    marked = left.join(F.broadcast(hot), key, "left")
    many = marked.filter("hot_ is not null").select(*left.columns, "hot_.*")
    few = marked.filter("hot_ is null").select(*left.columns).join(right.select(key, *others), key)
    return many.unionByName(few.select(*many.columns))
