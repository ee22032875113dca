"""Replaceable Parquet tables: fresh folders and one committed pointer.

A partition is never rewritten in place.  Every write goes to a fresh folder
``gen=N`` of the table; then one small file ``_pointer/N`` is renamed into place
that lists the leaf directories that are the table from now on.  Readers follow
the newest pointer, so a writer that dies at any moment leaves the old table whole
(its folder is left over and removed by :func:`vacuum`), and a rerun gives the
same rows.  Directories are known by the paths that the file system lists, never
by formatted values, so null and escaped partition values keep their identity.

Streams write their own ``batch_id`` directories beside the generations (a
replayed batch replaces its own output).  Those plain directories belong to the
table until a pointer lists them as ``retired``.

One writer at a time is assumed; a second one that commits the same generation
fails at the rename.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_POINTER = "_pointer"
_GEN = "gen"
#: Bytes of a row group.  A scan gives a row group to one task: a file of the
#: advisory size that is one group would be read by one task, however many are free.
ROW_GROUP = 8 * 2**20
#: Fixed value: the directory name of a null partition value.
NULL_NAME = "__HIVE_DEFAULT_PARTITION__"


def _fs(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names below ``path`` (none if it isn't there)."""
    fs, hpath = _fs(spark, path)
    return [st.getPath().getName() for st in fs.listStatus(hpath)] if fs.exists(hpath) else []


def _leaf_dirs(spark: SparkSession, path: str, below: str = "") -> list[str]:
    """Relative paths of the directories that hold files, found by listing."""
    fs, hpath = _fs(spark, f"{path}/{below}" if below else path)
    if not fs.exists(hpath):
        return []
    out, here = [], False
    for st in fs.listStatus(hpath):
        name = st.getPath().getName()
        if name.startswith(("_", ".")):
            continue
        if not st.isDirectory():
            here = True
        elif "=" in name:
            out += _leaf_dirs(spark, path, f"{below}/{name}" if below else name)
    return out + ([below] if here else [])


def pointer(spark: SparkSession, path: str) -> dict | None:
    """The newest committed pointer: ``gen``, ``live`` and ``retired`` leaf
    directories, ``schema`` of the rows and its partition columns ``by``; None
    for a table that was never written through this module."""
    done = _committed(spark, path)
    return _read_pointer(spark, path, done[-1]) if done else None


def _committed(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n) for n in _names(spark, f"{path}/{_POINTER}") if n.isdigit())


def _read_pointer(spark: SparkSession, path: str, number: int) -> dict:
    fs, hpath = _fs(spark, f"{path}/{_POINTER}/{number}")
    stream = fs.open(hpath)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, state: dict) -> None:
    """Make ``state`` the table's pointer: written aside, then renamed to its number."""
    fs, target = _fs(spark, f"{path}/{_POINTER}/{state['gen']}")
    _, aside = _fs(spark, f"{path}/{_POINTER}/.{state['gen']}.new")
    out = fs.create(aside, True)
    try:
        out.write(bytearray(json.dumps(state).encode()))
    finally:
        out.close()
    if fs.exists(target) or not fs.rename(aside, target):
        raise RuntimeError(f"generation {state['gen']} of {path} was committed by another writer")


def plain_leaves(spark: SparkSession, path: str) -> list[str]:
    """Leaf directories that streams or plain writers put beside the generations."""
    return [d for d in _leaf_dirs(spark, path) if d and not d.startswith(f"{_GEN}=")]


def leaves(spark: SparkSession, path: str) -> list[str]:
    """The leaf directories that are the table now, relative to ``path``."""
    state = pointer(spark, path) or {"live": [], "retired": []}
    gone = set(state["retired"])
    return state["live"] + [d for d in plain_leaves(spark, path) if d not in gone]


def level(leaf: str, column: str) -> str | None:
    """The directory name's text after ``column=``, as it stands (escaped)."""
    return next((p.split("=", 1)[1] for p in leaf.split("/") if p.startswith(f"{column}=")), None)


def levels(leaf: str) -> list[str]:
    """The partition columns of a leaf directory, generation left out."""
    return [p.split("=", 1)[0] for p in leaf.split("/") if not p.startswith(f"{_GEN}=")]


def read_leaves(spark: SparkSession, path: str, dirs: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """The rows of some leaf directories.  With ``schema`` (as the pointer keeps it)
    files that lack a column give nulls and no directory's type is guessed."""
    kinds = [[d for d in dirs if d.startswith(f"{_GEN}=")], [d for d in dirs if not d.startswith(f"{_GEN}=")]]
    frames = []
    for some in kinds:
        if some:
            reader = spark.read.option("basePath", path)
            if schema is not None:
                reader = reader.schema(schema)
            frames.append(reader.parquet(*[f"{path}/{d}" for d in some]))
    if not frames:
        if schema is None:
            raise FileNotFoundError(f"no rows of {path}")
        return spark.createDataFrame([], schema)
    frames = [f.drop(_GEN) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table: what the newest pointer lists, or all directories without one."""
    state = pointer(spark, path)
    if state is None:
        return _unpointed(spark, path)
    return read_leaves(spark, path, leaves(spark, path), T.StructType.fromJson(state["schema"]))


def _unpointed(spark: SparkSession, path: str) -> DataFrame:
    """A table without pointer; what a first writer left when it died is no part of it."""
    left = any(n.startswith(f"{_GEN}=") for n in _names(spark, path))
    paths = [f"{path}/{d}" for d in plain_leaves(spark, path)] if left else [path]
    return spark.read.option("basePath", path).parquet(*paths)


def read_some(spark: SparkSession, path: str, dirs: Sequence[str]) -> DataFrame:
    """The rows of some of the table's leaf directories, in the table's schema."""
    state = pointer(spark, path)
    schema = T.StructType.fromJson(state["schema"]) if state else _unpointed(spark, path).schema
    return read_leaves(spark, path, dirs, schema)


def _next(spark: SparkSession, path: str) -> int:
    """A generation number that no folder and no pointer has had."""
    used = [int(n.split("=", 1)[1]) for n in _names(spark, path) if n.startswith(f"{_GEN}=")]
    used += [int(n.lstrip(".").removesuffix(".new")) for n in _names(spark, f"{path}/{_POINTER}")]
    return max(used, default=0) + 1


def replace(spark: SparkSession, path: str, rows: DataFrame | None, by: Sequence[str], gone: Sequence[str] = (),
            sort_cols: Sequence[str] = (), max_records_per_file: int | None = None,
            before_commit: Callable[[list[str]], None] | None = None) -> list[str]:
    """Write ``rows``, partitioned ``by``, as a fresh generation that takes the
    place of the leaf directories ``gone`` (none: an append); returns the new leaf
    directories.  ``rows`` may read the directories that it replaces.
    ``before_commit`` is called with the new directories once they are written.

    REBALANCE lets AQE split a partition value that holds a large share of the
    rows into several files of the advisory size instead of one task."""
    state = pointer(spark, path) or {"live": [], "retired": [], "schema": None, "by": list(by)}
    gen, fresh, schema = _next(spark, path), [], state["schema"]
    if schema is None and plain_leaves(spark, path):
        schema = json.loads(_unpointed(spark, path).schema.json())
    if rows is not None:
        out = rows.hint("rebalance", *by)
        if sort_cols:
            out = out.sortWithinPartitions(*by, *sort_cols)
        writer = out.write.option("parquet.block.size", ROW_GROUP).partitionBy(*by)
        if max_records_per_file:
            writer = writer.option("maxRecordsPerFile", max_records_per_file)
        writer.parquet(f"{path}/{_GEN}={gen}")
        fresh = [f"{_GEN}={gen}/{d}" for d in _leaf_dirs(spark, f"{path}/{_GEN}={gen}") if d]
        schema = _grown(schema, rows.schema, by)
    if before_commit:
        before_commit(fresh)
    gone = set(gone)
    plain = [d for d in gone if not d.startswith(f"{_GEN}=")]
    commit(spark, path, {"gen": gen, "live": [d for d in state["live"] if d not in gone] + fresh,
                         "retired": sorted({*state["retired"], *plain}), "schema": schema, "by": list(by)})
    return fresh


def _grown(old: dict | None, new: T.StructType, by: Sequence[str]) -> dict:
    """The stored schema with the columns that the written rows add to it; the
    partition columns last, as a scan gives them."""
    fields = {f.name: f for f in T.StructType.fromJson(old).fields} if old else {}
    for f in new.fields:
        fields.setdefault(f.name, T.StructField(f.name, f.dataType, True))
    ordered = [f for n, f in fields.items() if n not in by] + [fields[n] for n in by]
    return json.loads(T.StructType(ordered).json())


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete the directories that none of the newest ``keep`` pointers lists and
    the pointers before them; returns how many directories went.  Give ``keep`` as
    many pointers as running readers may still follow."""
    done = _committed(spark, path)
    if not done:
        return 0
    kept = [_read_pointer(spark, path, n) for n in done[-keep:]]
    live = {d for state in kept for d in state["live"]}
    retired = set(kept[0]["retired"])                       # no kept pointer lists these
    gone = [d for d in plain_leaves(spark, path) if d in retired]
    gone += [d for d in _leaf_dirs(spark, path) if d.startswith(f"{_GEN}=") and d not in live
             and int(level(d, _GEN)) <= done[-1]]           # a running writer's folder has a higher number
    fs, _ = _fs(spark, path)
    for d in gone:
        fs.delete(_fs(spark, f"{path}/{d}")[1], True)
    for n in done[:-keep]:
        fs.delete(_fs(spark, f"{path}/{_POINTER}/{n}")[1], False)
    return len(gone)
