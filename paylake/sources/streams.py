"""Streaming message sources.

In production the topics are Kafka (``kafka://host:port/topic``); the Kafka
connector is not on this image's classpath, so tests and the registered
queries use directories of JSON-lines text files (one message per line) or a
parquet table projected into messages.  Both give a streaming DataFrame with
a ``value`` STRING column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylake.sources.tables import path_exists

# Rows of a consumed block, and how many consumers take one at a time.
BLOCK_ROWS = 65536
CONSUMERS = 4


def _kafka(spark: SparkSession, url: str, starting: str, max_rows: int | None,
           min_partitions: int | None, group: str | None) -> DataFrame:
    servers, _, topic = url[len("kafka://"):].partition("/")
    reader = (spark.readStream.format("kafka")
              .option("kafka.bootstrap.servers", servers)
              .option("subscribe", topic)
              .option("startingOffsets", starting))      # lost offsets stop the query (the default)
    if max_rows:
        reader = reader.option("maxOffsetsPerTrigger", max_rows)
    if min_partitions:
        reader = reader.option("minPartitions", min_partitions)
    if group:
        reader = reader.option("groupIdPrefix", group)
    return reader.load().select(F.col("key").cast("string").alias("key"),
                                F.col("value").cast("string").alias("value"),
                                "partition", "offset")


def read_messages(spark: SparkSession, src: str, starting: str = "earliest",
                  max_rows: int | None = None, min_partitions: int | None = None,
                  group: str | None = None, max_files: int | None = None,
                  position: str | None = None, max_bytes: int | str | None = None) -> DataFrame:
    """A stream of raw message text from a Kafka URL or a text directory/glob.

    ``max_rows`` bounds a Kafka batch.  A directory admits whole files, at most
    ``max_files`` or ``max_bytes`` (``"512m"``) of them a batch, a file beyond the
    bytes alone; where the gate lands a topic, files end after ``BLOCK_ROWS`` rows,
    so ``max_files`` bounds rows too.

    ``starting='latest'`` on a directory skips files that already existed at the
    stream's first start (filter on the file's modification time).  That start
    is written to the folder ``position`` (keep it beside the stream's
    checkpoint) and read from there on later starts, so files that arrive while
    the query is down are read after a restart; without ``position`` it is the
    time of this call.  (Kafka keeps the position in its checkpoint itself.)"""
    if src.startswith("kafka://"):
        return _kafka(spark, src, starting, max_rows, min_partitions, group)
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    elif max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    stream = reader.load(src)
    if starting == "latest":
        started = first_start(spark, position)
        stream = (stream.filter(F.col("_metadata.file_modification_time") > F.lit(started))
                        .select("value"))
    return stream


def first_start(spark: SparkSession, position: str | None):
    """The time of a stream's first start, kept in the folder ``position``."""
    now = spark.range(1).select(F.current_timestamp().alias("started"))
    if position is None:
        return now.first()[0]
    if not path_exists(spark, position):
        now.coalesce(1).write.mode("ignore").parquet(position)
    return spark.read.parquet(position).agg(F.min("started")).first()[0]


def read_events(spark: SparkSession, src: str, starting: str = "earliest",
                group: str | None = None, max_files: int | None = None) -> DataFrame:
    """The raw payment-event topic, own position, oldest first."""
    return read_messages(spark, src, starting=starting, group=group, max_files=max_files)


def read_validated(spark: SparkSession, src: str, starting: str = "earliest",
                   max_rows: int | None = BLOCK_ROWS, min_partitions: int | None = CONSUMERS,
                   max_files: int | None = None, position: str | None = None,
                   max_bytes: int | str | None = None) -> DataFrame:
    """S2 (lane A, earliest, 65,536-row blocks, 4 consumers) and S3 (lane B,
    ``starting='latest'``) read of the validated topic.  From a directory each
    consumer takes a file, which the gate ends after a block, a batch
    (``max_files`` / ``max_bytes`` bound it otherwise)."""
    if max_files is None and max_bytes is None:
        max_files = min_partitions
    return read_messages(spark, src, starting=starting, max_rows=max_rows, min_partitions=min_partitions,
                         max_files=max_files, position=position, max_bytes=max_bytes)


def read_table_stream(spark: SparkSession, directory: str, table: str,
                      max_files: int | None = None) -> DataFrame:
    """Stream the rows of ``<directory>/<table>.parquet`` (schema from the file)."""
    schema = spark.read.parquet(f"{directory.rstrip('/')}/{table}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(directory)
