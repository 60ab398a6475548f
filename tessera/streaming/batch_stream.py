"""Batches of questions as a stream: JSON-lines files are answered as they appear, each micro-batch by one search plan.

Results are committed by the number of the micro-batch, a folder each. Spark repeats a micro-batch with the same files and number if it ended before
its offsets were kept; one whose folder is whole is not answered again, one that was cut off is written anew. So no line is answered twice in what
``answered`` reads, whenever the driver was lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.hybrid import Index, run_batch
from ..sources.files import parse_batch
from ..sources.shared import hadoop_path, settled


def stream_lines(spark: SparkSession, folder: str, files_at_once: int | None = None) -> DataFrame:
    """(file, line, value) of the files of ``folder`` as they appear, lines counted from 0. A file is one row until its lines are numbered; a
    batch is as small as someone's questions. Files without any line that isn't blank give nothing."""
    raw = spark.readStream.format("text").option("wholetext", "true")
    raw = raw.option("maxFilesPerTrigger", files_at_once) if files_at_once else raw
    rows = raw.load(folder).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    return rows.where(F.trim(F.regexp_replace("value", r"\s+", " ")) != "")


def answer_lines(lines: DataFrame, index: Index, **options) -> DataFrame:
    """``lines(file, line, value)`` with query_id (of this batch alone), question, status, results or error. One plan for all."""
    given = settled(lines.withColumn("query_id", F.monotonically_increasing_id()))
    done = run_batch(parse_batch(given.select("query_id", "value")), index, **options)
    return given.join(done, "query_id")


def committed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the micro-batches whose results are whole."""
    fs, top = hadoop_path(spark, path)
    if not fs.exists(top):
        return []
    names = [s.getPath() for s in fs.listStatus(top)]
    whole = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(int(p.getName().removeprefix("batch=")) for p in names if p.getName().startswith("batch=") and whole(p))


def answer_stream(lines: DataFrame, index: Index, path: str, checkpoint: str, once: bool = False, **options) -> StreamingQuery:
    """Answers a stream of lines with ``index`` and writes each micro-batch below ``path``. ``once``: what is there now, then it ends."""

    def write(batch: DataFrame, number: int) -> None:
        if number not in committed(batch.sparkSession, path):
            answer_lines(batch, index, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()


def answered(spark: SparkSession, path: str) -> DataFrame:
    """All committed results, with the micro-batch of each."""
    numbers = committed(spark, path)
    if not numbers:
        raise ValueError(f"nothing was answered below {path}")
    return spark.read.option("basePath", path).parquet(*(f"{path}/batch={n}" for n in numbers))
