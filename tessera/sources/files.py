"""Files and stores as DataFrames, and back."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ElementTree
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.batches import bounded
from ..functions.naming import category, norm_path, suffix
from ..operators.filters import EXTENSIONS, passes

#: A file above so many bytes holds more than the characters that are indexed; it isn't read.
MOST_BYTES = 4 * 120_000
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def plain_path(uri: Column) -> Column:
    return F.regexp_replace(uri, r"^[a-z0-9]+:/+(?=/)|^file:(?=/)", "")


def scan(spark: SparkSession, roots: dict[str, list[str]], extensions=EXTENSIONS, folders: tuple[str, ...] | None = None, include: list[str] | None = None, exclude: list[str] | None = None, text: bool = True) -> DataFrame:
    """Files below ``roots`` (origin -> folders) that pass the filters: path, origin, ext, category, bytes, modified and, with
    ``text``, text, n_chars and sha256. A file that two roots reach is one row; the first origin by name has it. Only the
    listing is filtered; a file's content is read after that, as ``content`` is the last column to be needed."""
    parts = []
    for origin, tops in roots.items():
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(tops)
        raw = raw if text else raw.drop("content")
        parts.append(raw.withColumn("origin", F.lit(origin)))
    if not parts:
        raise ValueError("no roots")
    raw = parts[0]
    for p in parts[1:]:
        raw = raw.unionByName(p)
    path = norm_path(plain_path(F.col("path")))
    kw = {} if folders is None else {"folders": folders}
    kept = raw.withColumn("path", path).where(passes(F.col("path"), extensions, include=include, exclude=exclude, **kw))
    first = kept.groupBy("path").agg(F.min("origin").alias("origin")) if len(roots) > 1 or any(len(t) > 1 for t in roots.values()) else None
    if first is not None:
        # Listings alone are made distinct; contents follow their path.
        kept = kept.join(first, ["path", "origin"], "left_semi").dropDuplicates(["path"])
    out = kept.select("path", "origin", suffix(F.col("path")).alias("ext"), category(F.col("path")).alias("category"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), *(["content"] if text else []))
    return decode(out) if text else out


def document_text(path: str, data: bytes) -> str:
    """Paragraphs of a Word file, pages of a PDF where a reader for them is installed, else UTF-8 text without its invalid bytes
    and with plain line ends. "" for what can't be read."""
    ending = path.rpartition(".")[2].lower()
    if ending in ("docx", "docm"):
        try:
            body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return ""
        return "\n".join("".join(t.text or "" for t in p.iter(WORD + "t")) for p in body.iter(WORD + "p"))
    if ending == "pdf":
        try:
            from pypdf import PdfReader
            from pypdf.errors import PyPdfError
        except ImportError:
            return ""
        try:
            return "\n".join(filter(None, (p.extract_text() for p in PdfReader(io.BytesIO(data)).pages)))
        except PyPdfError:
            return ""
    return data.decode("utf-8", errors="ignore").replace("\r\n", "\n")


def decode(files: DataFrame) -> DataFrame:
    """``files(path, ..., content)`` with text, n_chars and sha256 in place of content."""
    at, place = files.columns.index("content"), files.columns.index("path")
    schema = StructType([*files.drop("content").schema, StructField("text", StringType())])

    def run(batches):
        for b in bounded(batches, at):
            made = [document_text(p, c or b"") for p, c in zip(b.column(place).to_pylist(), b.column(at).to_pylist(), strict=True)]
            rest = [i for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in rest), pa.array(made, pa.string())], names=[*(b.schema.names[i] for i in rest), "text"])

    return files.mapInArrow(run, schema).withColumns({"n_chars": F.length("text"), "sha256": F.sha2("text", 256)})


def from_index(spark: SparkSession, index_path: str, listing: DataFrame, extensions=EXTENSIONS) -> DataFrame:
    """The files of a JSON index ``{"files": [{"fullPath", "path"}]}`` that ``listing(path)`` has, with a known extension."""
    schema = "files array<struct<path: string, fullPath: string, bytes: bigint, extension: string, preview: string>>"
    rows = spark.read.schema(schema).json(index_path, multiLine=True).select(F.explode("files").alias("f"))
    path = norm_path(F.coalesce(F.when(F.col("f.fullPath") != "", F.col("f.fullPath")), F.col("f.path")))
    named = rows.select(path.alias("path")).where("path IS NOT NULL").distinct().where(suffix(F.col("path")).isin(*extensions))
    return listing.join(named, "path", "left_semi")


def legacy_index(files: DataFrame, lines: int = 20, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row for each file that isn't too large: path, bytes, extension and its first lines."""
    small = files.where(F.col("bytes") <= most_bytes)
    return small.select("path", "bytes", F.col("ext").alias("extension"), F.array_join(F.slice(F.split("text", "\n"), 1, lines), "\n").alias("preview"))


def read_lines(path: str) -> list[str]:
    """Lines of a small settings file without comments and blanks; none if it doesn't exist."""
    p = Path(path)
    rows = p.read_text(encoding="utf-8").splitlines() if p.exists() else []
    return [x for x in (r.strip() for r in rows) if x and not x.startswith("#")]


def read_dirs(path: str, root: str) -> list[str]:
    """Folders that a settings file lists, {ENGINE_ROOT} replaced; those that don't exist are left out."""
    return [d for d in (x.replace("{ENGINE_ROOT}", root) for x in read_lines(path)) if Path(d).is_dir()]


def read_ignores(paths: list[str]) -> tuple[list[str], list[str]]:
    """(folders, globs of file names) from ignore files: a line with *, ? or [ is a glob."""
    rows = list(dict.fromkeys(x.rstrip("/") for p in paths for x in read_lines(p)))
    is_glob = lambda x: bool(re.search(r"[*?\[]", x))
    return [x for x in rows if not is_glob(x)], [x for x in rows if is_glob(x)]


def read_settings(path: str) -> dict[str, str]:
    """KEY=VALUE lines; quotes around a value go."""
    pairs = (x.partition("=") for x in read_lines(path))
    return {k.strip(): v.strip().strip("\"'") for k, eq, v in pairs if eq}


def write_settings(path: str, settings: dict[str, str]) -> None:
    Path(path).write_text("".join(f"{k}={v}\n" for k, v in settings.items()), encoding="utf-8")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_store(chunks: DataFrame, path: str) -> None:
    """By origin, so that a search in one scope reads only its files. Spark's commit makes the files appear together."""
    chunks.write.mode("overwrite").partitionBy("origin").parquet(path)


def read_if_exists(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A store, or an empty one where there is none yet; a store that can't be read still fails."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)


# A line of a batch of questions.
BATCH = "question string, top_k int, scope string, filter string, show_reasoning boolean, use_reranker boolean, model string"


def parse_batch(lines: DataFrame) -> DataFrame:
    """``lines(query_id, value)`` of JSON as questions with their defaults; blank lines go but count in query_id. status is
    "error" for a line that isn't a JSON object, with the line in error."""
    raw = lines.where(F.trim(F.regexp_replace("value", r"\s+", " ")) != "")
    whole = F.trim("value")
    q = raw.withColumn("q", F.from_json("value", BATCH + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    good = F.col("q").isNotNull() & F.col("q._corrupt_record").isNull() & whole.startswith("{") & whole.endswith("}")
    get = lambda c, d: F.when(good, F.coalesce(f"q.{c}", F.lit(d)))
    return q.select(
        F.col("query_id").cast("long").alias("query_id"), get("question", "").alias("question"), get("top_k", 5).alias("top_k"), get("scope", "engine").alias("scope"),
        F.when(good, F.col("q.filter")).alias("filter"), F.when(good, F.col("q.use_reranker")).alias("use_reranker"), F.when(good, F.coalesce("q.show_reasoning", F.lit(False))).alias("show_reasoning"), F.when(good, F.col("q.model")).alias("model"), F.when(good, "success").otherwise("error").alias("status"), F.when(~good, F.concat(F.lit("Invalid JSON: "), F.col("value"))).alias("error"))


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON-lines file by line number from 0, blank lines counted. A file's text is one row until its lines are
    numbered; a batch is as small as someone's questions."""
    text = spark.read.text(path, wholetext=True)
    return parse_batch(text.select(F.posexplode(F.split("value", "\r?\n")).alias("query_id", "value")))


def batch_of(spark: SparkSession, items: list[dict]) -> DataFrame:
    """The same from dictionaries."""
    import json

    return parse_batch(spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(items)], "query_id int, value string"))


def write_batch(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


# A line of the activity log.
LOG = "timestamp string, event string, details map<string, string>"


def log_events(rows: DataFrame, path: str) -> None:
    """Appends ``rows(timestamp, event, details)`` as JSON lines."""
    rows.select("timestamp", "event", "details").write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).json(path).withColumn("ts", F.try_to_timestamp("timestamp"))
