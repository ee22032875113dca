"""Layer registry and table scans.

Every layer is a Parquet directory under one root.  A scan is a plain
``spark.read.parquet`` so Catalyst gets partition discovery, partition
pruning, pushed filters and column pruning for free.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from paylake.sources import generations

# Layer name -> (sub-directory, partition column).
LAYERS = {
    "bronze_a": ("bronze/payments_bronze", "payment_month"),
    "bronze_b": ("bronze/payments", "payment_date"),
    "quarantine": ("bronze/quarantine", None),
    "ingest_log": ("bronze/_ingest_log/payments_bronze", "batch_id"),
    "ingest_log_b": ("bronze/_ingest_log/payments", "batch_id"),
    "silver_events": ("silver/silver_events", "payment_month"),
    "silver_payments": ("silver/silver_payments", "payment_date"),
    "gold_revenue": ("gold/gold_revenue", "version"),
    "gold_revenue_daily": ("gold/gold_revenue_daily", "payment_date"),
    "silver_users": ("silver/silver_users", "version"),
    "run_log": ("silver/_run_log", "kind"),
    "silver_sessions": ("silver/silver_sessions", "version"),
    "user_parts": ("silver/_user_parts", "payment_month"),
    "session_parts": ("silver/_session_parts", "payment_month"),
    "sync_quarantine": ("silver/_sync_quarantine", "batch_id"),
    "sync_quarantine_b": ("silver/_sync_quarantine_b", "batch_id"),
}


@dataclass(frozen=True)
class Lakehouse:
    """Paths of all layers under one (cluster-shared) root directory."""

    root: str

    def path(self, layer: str) -> str:
        return f"{self.root.rstrip('/')}/{LAYERS[layer][0]}"

    def partition_column(self, layer: str) -> str | None:
        return LAYERS[layer][1]

    def exists(self, spark: SparkSession, layer: str) -> bool:
        return path_exists(spark, self.path(layer))

    def read(self, spark: SparkSession, layer: str) -> DataFrame:
        """S5 ``layer(spark, name)``: the current content of a layer."""
        if self.partition_column(layer) == "version":
            return read_latest_version(spark, self.path(layer))
        return bronze_table(spark, self.path(layer))


def bronze_table(spark: SparkSession, path: str) -> DataFrame:
    """S4 query-on-read scan of a partitioned Parquet table (no copy); a table
    with a committed pointer is read as that lists it."""
    return generations.read(spark, path)


def external_table(spark: SparkSession, name: str, path: str) -> None:
    """S4 as a catalog table: ``name`` stands for the Parquet files at ``path``
    (nothing is copied), its partitions are discovered from the directories.  For
    tables that streams append to; call it again to see later partitions."""
    schema = spark.read.option("basePath", path).parquet(path).schema
    by = generations.levels(generations.leaves(spark, path)[0])
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY ({', '.join(by)}) LOCATION '{path}'")
    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when ``path`` exists on the (possibly distributed) file system."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def read_latest_version(spark: SparkSession, path: str) -> DataFrame:
    """Read the newest complete ``version=N`` of a full-refresh table (M5).

    The newest version is found by listing the version directories (a
    metadata operation); only that version's files are scanned.  A version
    counts once its job has committed and left ``_SUCCESS`` in it, so a run that
    died half way is never read."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    versions = [int(st.getPath().getName().split("=", 1)[1]) for st in fs.listStatus(hpath)
                if st.isDirectory() and st.getPath().getName().startswith("version=")
                and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS"))]
    if not versions:
        raise FileNotFoundError(f"no version of {path}")
    return (spark.read.option("basePath", path).parquet(f"{path}/version={max(versions)}")
                 .drop("version"))


def register_views(spark: SparkSession, frames: dict[str, DataFrame]) -> None:
    """Expose DataFrames as temp views for ad-hoc SQL reports."""
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
