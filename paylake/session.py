"""Session helpers: the SQL settings every paylake job relies on."""

from __future__ import annotations

import tempfile

from pyspark.errors import PySparkAttributeError, PySparkNotImplementedError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings that can be changed on a live session (SQL confs).
RUNTIME_CONF = {
    # All timestamps are UTC wall-clock; reports must not move with the host zone.
    "spark.sql.session.timeZone": "UTC",
    # The gate's JSON rule lets the last duplicate key win (as a JSON decoder does).
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rebalance/coalesce towards ~64 MB partitions (the lane-B file-size target).
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings paylake needs to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def get_session(master: str | None = None, app: str = "paylake",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with paylake's settings.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset so that the
    cluster's own values apply; tests pass ``local[*]`` and a small number.
    """
    builder = (SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               # checkpoint files of DataFrames that went out of scope are removed
               .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**RUNTIME_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder for checkpoints and written intermediate tables.

    Read from ``spark.checkpoint.dir``.  Only when the session has none (local
    tests) is a private folder created and registered.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="paylake-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
        spark.sparkContext.setCheckpointDir(current)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current.rstrip("/")


def computed(df: DataFrame) -> DataFrame:
    """The rows of ``df`` with every column computed once, as the rows of a generator.

    Catalyst pushes a filter through projections and puts a column's expression in
    place of each mention of it; a filter shares nothing between the mentions, so one
    on a parsed message parses it again for each.  No filter passes a generator:
    what stands above reads values.  Row-local, also in streams."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin a *batch* input over the cluster when its source yields
    fewer partitions than ``min_partitions`` (default: the cluster's default
    parallelism) -- e.g. one large unsplittable file or a topic with few
    partitions feeding CPU-heavy row-local work such as JSON validation.

    A no-op for streaming frames and for inputs already split finer than
    that (the normal case for a large table), so it never adds a shuffle to
    a well-partitioned 100 TB scan.  Only call it on plans without a shuffle
    (a scan plus projections): the partition count is read from the plan.
    Catalyst pushes filters through a repartition, so materialise the result
    (``checkpoint``) when an expensive filter follows.  Streams use the
    source's own split option instead (Kafka ``minPartitions``)."""
    if df.isStreaming:
        return df
    try:
        target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        current = df.rdd.getNumPartitions()
    except (PySparkAttributeError, PySparkNotImplementedError):    # sessions without RDD access: leave as is
        return df
    return df.repartition(target) if current < target else df
