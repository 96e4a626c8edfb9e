"""Helpers shared by the operators: shared storage, blocks of texts, hashing."""
from __future__ import annotations

import atexit
from collections.abc import Callable, Iterator
from contextlib import contextmanager
import ctypes
import os
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of text that one block holds at most, unless a single text is longer.
BLOCK_BYTES = 4 << 20
#: Runs of these characters part words and are equal to one space.
WHITE = r"[\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a session."""
    context = spark.sparkContext
    if getattr(context, "_ringside_sent", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="ringside-")  # executors fetch the archive from the driver when they first need it
    archive = shutil.make_archive(os.path.join(folder, f"ringside-{uuid.uuid4().hex[:8]}"), "zip", os.path.dirname(package), os.path.basename(package))
    context.addPyFile(archive)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context._ringside_sent = True


#: What a Python worker holds between the tasks of one operator (tables, remembered words), and whose tasks ran last.
KEPT: list[dict] = []
_LAST = {"owner": ""}


def take_over(owner: str) -> None:
    """Let go of what the tasks of another operator left in this worker."""
    if _LAST["owner"] != owner:
        for held in KEPT:
            held.clear()
        give_back()
        _LAST["owner"] = owner


def give_back() -> None:
    """Return freed memory to the system; an executor's workers wait side by side, each with what it hasn't returned."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def mapped(df: DataFrame, function: Callable, schema) -> DataFrame:
    """mapInArrow with this package at hand."""
    ship(df.sparkSession)
    owner = function.__module__

    def run(batches):
        take_over(owner)
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


def grouped(df: DataFrame, key: str, function: Callable, schema) -> DataFrame:
    """function(rows), as an Arrow table, for each value of `key`, with this package at hand."""
    ship(df.sparkSession)
    owner = function.__module__

    def run(rows):
        take_over(owner)
        out = function(rows)
        del rows
        give_back()
        return out

    return df.groupBy(key).applyInArrow(run, schema)


def cogrouped(left: DataFrame, right: DataFrame, key: str, function: Callable, schema) -> DataFrame:
    """function(left rows, right rows), as Arrow tables, for each value of `key`, with this package at hand."""
    ship(left.sparkSession)
    owner = function.__module__

    def run(a, b):
        take_over(owner)
        return function(a, b)

    return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder, deleted when the session's JVM ends."""
    place = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return place


def store(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write a frame to the shared folder and read it from there: the lineage is cut, lost executors cost nothing."""
    spark, place = df.sparkSession, new_path(df.sparkSession, label)
    df.write.parquet(place, compression=compression)
    stored = spark.read.schema(df.schema).parquet(place)
    stored._place = place
    return stored


def discard(stored: DataFrame) -> None:
    """Delete a table of store() that nothing reads any more."""
    path = stored.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(stored._place)
    path.getFileSystem(stored.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def swept(spark: SparkSession):
    """Shuffle files of the queries run within go as soon as a query is done, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spread(manifest: DataFrame) -> DataFrame:
    """A manifest's files over as many tasks as a shuffle has, however few bytes its rows have."""
    return manifest.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")


def crc_mod(column: str, n: int):
    """crc32 of a number written as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def text_bytes(column: pa.Array) -> pa.Array:
    """Texts as binary values; null is empty."""
    if pa.types.is_null(column.type):
        return pa.array([b""] * len(column), pa.binary())
    return pc.fill_null(column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()), b"")


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BLOCK_BYTES):
    """Slices of batches with their texts as bytes, so that a task holds few texts at once."""
    for batch in batches:
        texts = text_bytes(batch.column(batch.schema.get_field_index(column)))
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, stop - at), texts.slice(at, stop - at).to_pylist()
            at = stop


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits of the input."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def random_words(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit numbers."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, n, dtype=np.uint64)


def keyed(docs: DataFrame, label: str, **columns) -> DataFrame:
    """Whole rows as one struct `row`, a number `rid` that is the row's own, and more columns, stored.

    The struct keeps a table's own columns apart from ours, whatever they are called; the stored
    number tells repeated rows apart and stays the same however often the table is read.
    """
    return store(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
                             *[c.alias(name) for name, c in columns.items()]), label)
