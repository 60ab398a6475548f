"""Streams: files into an index as they appear, and counts over the activity log. Extensions; nothing here is needed for a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.naming import category, norm_path, suffix
from ..operators.filters import EXTENSIONS, has_extension
from ..sources.files import LOG, decode, plain_path


def stream_files(spark: SparkSession, root: str, origin: str, extensions=EXTENSIONS) -> DataFrame:
    """Files below ``root`` as they appear or change, as rows of ``sources.files.scan``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root)
    path = norm_path(plain_path(F.col("path")))
    rows = raw.withColumn("path", path).where(has_extension(F.col("path"), extensions))
    return decode(rows.select("path", F.lit(origin).alias("origin"), suffix(F.col("path")).alias("ext"), category(F.col("path")).alias("category"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "content"))


def keep_index(files: DataFrame, make_chunks, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes the chunks of each batch of files under ``path``, a folder for each batch, which a repeated batch writes again.
    ``latest`` reads what holds."""

    def write(batch: DataFrame, number: int) -> None:
        chunks = make_chunks(batch.dropDuplicates(["path", "sha256"])).withColumn("__batch", F.lit(number))
        chunks.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of each file's last batch."""
    chunks = spark.read.parquet(path)
    last = chunks.groupBy("path").agg(F.max("__batch").alias("__batch"))
    return chunks.join(last, ["path", "__batch"], "left_semi").drop("__batch", "batch")


def log_counts(spark: SparkSession, path: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events of a log folder by window and kind as lines are appended; lines later than ``late`` are dropped."""
    rows = spark.readStream.schema(LOG).json(path).withColumn("ts", F.try_to_timestamp("timestamp"))
    return rows.withWatermark("ts", late).groupBy(F.window("ts", window), "event").agg(F.count("*").alias("n"))
