"""Helpers shared by the llm operators: shipping the code, staging, Arrow buffers."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylake.session import shared_dir

#: Rows of one Arrow batch between the JVM and Python (texts may be long).
BATCH_ROWS = 1000
#: Bytes of text that one vectorised step handles (a longer text is one step).
SLICE_BYTES = 2_000_000
#: Spark's setting that removes an execution's shuffle files at its end.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Make the package importable on every executor and bound the Arrow batches
    (for the whole session: plans run after this call returns).  A batch has at most
    ``BATCH_ROWS`` rows and Spark's own byte bound (64 MB by default) plus one text.

    The package is added to the application as a zip (``addPyFile``), so
    executors need no folder in common with the driver.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        path = os.path.join(tempfile.mkdtemp(prefix="paylake-py-"), "paylake-src.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for top, _, files in os.walk(os.path.join(root, "paylake")):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(top, f)
                        z.write(full, os.path.relpath(full, root))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a table, through Arrow: plain lists start Python
    workers beside those of the operators on every executor."""
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame(pa.table({n: pa.array([r[i] for r in rows]) for i, n in enumerate(names)}), schema)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the cluster's shared folder."""
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, drop_shuffles: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, so a
    lost executor costs a re-read and not a recomputation.  ``drop_shuffles``: the
    write's shuffle files go when it ends, not when the driver next collects garbage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    _write(df, path, drop_shuffles, "errorifexists")
    return spark.read.schema(df.schema).parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Add ``df``'s rows to a folder from ``new_path``; the write's shuffle files go when it ends."""
    _write(df, path, True, "append")


def _write(df: DataFrame, path: str, drop_shuffles: bool, mode: str) -> None:
    spark = df.sparkSession
    before = spark.conf.get(DROP_SHUFFLES, "false")
    if drop_shuffles:
        spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.mode(mode).parquet(path)
    finally:
        if drop_shuffles:
            spark.conf.set(DROP_SHUFFLES, before)


def release() -> None:
    """Give the memory that a Python worker has freed back to the system.  Workers
    live on from stage to stage, and allocators keep what the largest step took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)    # glibc only
    if trim is not None:
        trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow or mapInPandas, its memory given back when a task ends."""
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()
    return task


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls count as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    if texts.type != pa.large_string():
        texts = texts.cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def slices(lengths: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose lengths sum to about ``most`` (one row at least)."""
    first, total = 0, 0
    for i, n in enumerate(lengths):
        if i > first and total + n > most:
            yield first, i
            first, total = i, 0
        total += int(n)
    if first < len(lengths):
        yield first, len(lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """A full-avalanche bijection of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_key() -> list:
    """Columns that tell rows of a text table apart as far as results can differ:
    the id and a hash of the text (rows equal in both get equal results)."""
    return [F.col("doc_id").cast("long").alias("doc_id"),
            F.xxhash64(F.col("text").cast("string")).alias("th"),
            F.col("text").cast("string").alias("text")]
