"""A store of chunks with snapshots.

Chunks are only ever added, by the version that made them, by origin, and in buckets by path; a listing of files, in the same buckets, says which
version of each file holds. A snapshot is a manifest that names its listing and the versions it reads; it holds once the pointer to it is
swapped, the last step of a commit. So a run that fails leaves the snapshot before it, old snapshots can be read, and a new run is compared with the
listing, and chunks are joined with it, without shuffling the store.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import in_scope
from .shared import hadoop_path, remove_folder

#: path's key; the rest of a file's row in the listing.
LISTING = "path string, origin string, sha256 string, version int"
#: With what the commit found: added, edited, unchanged or deleted.
LISTED = [x.split() for x in (LISTING + ", state string").split(", ")]


@dataclass
class Manifest:
    """One snapshot. listing: the folder of its files' listing; parts: the (version, origin) folders of chunks that it reads; columns: names
    and types of the chunks'."""

    version: int
    parent: int
    buckets: int
    listing: str
    columns: list[list[str]] = field(default_factory=list)
    parts: list[list] = field(default_factory=list)
    states: dict[str, int] = field(default_factory=dict)


class Store:
    """The store below ``path``, with the current snapshot or another version of it."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # small files

    def _read(self, name: str) -> str | None:
        fs, path = hadoop_path(self.spark, f"{self.path}/{name}")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        """The file is there whole or not at all: written beside its place, then renamed over it."""
        jvm = self.spark._jvm
        fs, part = hadoop_path(self.spark, f"{self.path}/.{name}-{uuid.uuid4().hex}")
        _, to = hadoop_path(self.spark, f"{self.path}/{name}")
        stream = fs.create(part, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri() if to.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        renames = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        renames[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(part, to, renames)

    # snapshots

    def current(self) -> int:
        """The version that holds; 0: none yet."""
        return int(self._read("CURRENT") or 0)

    def manifest(self, version: int | None = None) -> Manifest | None:
        version = self.current() if version is None else version
        text = self._read(f"manifest-{version}.json") if version else None
        if version and text is None:
            raise ValueError(f"no version {version} below {self.path}")
        return Manifest(**json.loads(text)) if text else None

    def _bucketed(self, df: DataFrame, folder: str, by: list[str], buckets: int) -> None:
        """Writes a file for each bucket and folder: rows are dealt by path as buckets are."""
        name = f"writing_{uuid.uuid4().hex}"
        writer = df.repartition(buckets, "path").write.bucketBy(buckets, "path").sortBy("path").option("path", folder)
        (writer.partitionBy(*by) if by else writer).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay

    def _table(self, kind: str, m: Manifest, columns: list[list[str]], parts: list[list] | None) -> DataFrame:
        """A table of the session's catalog, for its buckets and folders alone."""
        name = "store_" + uuid.uuid5(uuid.NAMESPACE_URL, f"{self.path}/{kind}/{m.listing}/{parts}").hex
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{name}` {kind_}" for name, kind_ in columns)
            buckets = f"CLUSTERED BY (path) SORTED BY (path) INTO {m.buckets} BUCKETS"
            if parts is None:
                self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {buckets} LOCATION '{self.path}/{m.listing}'")
            else:
                self.spark.sql(f"CREATE TABLE {name} ({columns}, version int, origin string) USING parquet PARTITIONED BY (version, origin) {buckets} LOCATION '{self.path}/{kind}'")
                if parts:
                    adds = " ".join(f"PARTITION (version={v}, origin='{o}') LOCATION '{self.path}/{kind}/version={v}/origin={o}'" for v, o in parts)
                    self.spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {adds}")
        return self.spark.table(name)

    def listing(self, version: int | None = None) -> DataFrame:
        """path, origin, sha256 and version of each file of a snapshot."""
        m = self.manifest(version)
        if m is None:
            return self.spark.createDataFrame([], LISTING)
        return self._table("files", m, LISTED, None).where("state <> 'deleted'").drop("state")

    def read(self, scope: str = "all", version: int | None = None) -> DataFrame:
        """The chunks of a snapshot, with origin and the version that made them. A scope reads only its origins' folders."""
        m = self.manifest(version)
        if m is None:
            raise ValueError(f"nothing was committed below {self.path}")
        chunks = self._table("chunks", m, m.columns, m.parts).where(in_scope(scope))
        holds = self.listing(m.version).where(in_scope(scope)).select(F.col("path").alias("__path"), F.col("version").alias("__version"))
        # path alone is a key of the join, as buckets are by path; an equal version is a condition besides
        return chunks.join(holds, (F.col("path") == F.col("__path")) & (F.col("version") - F.col("__version") == 0), "left_semi")

    def changes(self, files: DataFrame, version: int | None = None) -> DataFrame:
        """(path, origin, sha256, old_version, state) of ``files(path, origin, sha256)`` against a snapshot: added, edited (by content or origin), unchanged or deleted.
        The listing stays in its buckets; of rows with one path the largest content counts."""
        m = self.manifest(version)
        new = files.repartition(m.buckets if m else self.buckets, "path").groupBy("path").agg(F.max_by("origin", "sha256").alias("origin"), F.max("sha256").alias("sha256"))
        old = self.listing(version).select("path", F.col("origin").alias("old_origin"), F.col("sha256").alias("old_sha256"), F.col("version").alias("old_version"))
        same = (F.col("sha256") == F.col("old_sha256")) & (F.col("origin") == F.col("old_origin"))
        state = F.when(F.col("old_sha256").isNull(), "added").when(F.col("sha256").isNull(), "deleted").when(same, "unchanged").otherwise("edited")
        j = new.join(old, "path", "full")
        return j.select("path", F.coalesce("origin", "old_origin").alias("origin"), F.coalesce("sha256", "old_sha256").alias("sha256"), "old_version", state.alias("state"))

    def commit(self, files: DataFrame, make_chunks: Callable[[DataFrame], DataFrame], force: bool = False, brake: int = 100) -> Manifest:
        """A snapshot of ``files(path, origin, text)``: chunks of what was added or edited are made and added, what is unchanged is kept, deleted files
        go. make_chunks gets files with sha256 and keeps path and origin; other columns are its own, the same in each run. Files without path go; a null origin is engine.
        RuntimeError, and no snapshot, if no engine file is left while the snapshot before has over ``brake`` of them, unless ``force``."""
        before = self.manifest()
        version, buckets = (before.version if before else 0) + 1, before.buckets if before else self.buckets
        remove_folder(self.spark, f"{self.path}/chunks/version={version}")  # of a run that failed
        hashed = files.where("path IS NOT NULL").withColumns({"origin": F.coalesce("origin", F.lit("engine")), "sha256": F.sha2(F.coalesce("text", F.lit("")), 256)})
        changed = self.changes(hashed.select("path", "origin", "sha256"))
        listing = changed.select("path", "origin", "sha256", F.when(F.col("state") == "unchanged", F.col("old_version")).otherwise(F.lit(version)).cast("int").alias("version"), "state")
        m = Manifest(version, before.version if before else 0, buckets, f"files/{version}-{uuid.uuid4().hex}")
        self._bucketed(listing, f"{self.path}/{m.listing}", [], buckets)
        listed = self._table("files", m, LISTED, None)
        m.states = dict(listed.groupBy("state").count().collect())
        if not force and before:
            old, new = listed.where(in_scope("engine")).agg(F.count_if(F.col("state") != "added"), F.count_if(F.col("state") != "deleted")).first()
            if old > brake and not new:
                raise RuntimeError("no engine file was found, but the store has some; use force to drop them")
        todo = hashed.join(listed.where("state IN ('added', 'edited')").select("path", "origin", "sha256"), ["path", "origin", "sha256"], "left_semi").dropDuplicates(["path"])
        chunks = make_chunks(todo)
        m.columns = [[f.name, f.dataType.simpleString()] for f in chunks.schema if f.name not in ("version", "origin")]
        if before and before.columns != m.columns:
            raise ValueError("the chunks have other columns than those of the store")
        made = chunks.select(*(name for name, _ in m.columns), "origin")
        self._bucketed(made, f"{self.path}/chunks/version={version}", ["origin"], buckets)
        there = lambda v, o: (p := hadoop_path(self.spark, f"{self.path}/chunks/version={v}/origin={o}"))[0].exists(p[1])
        read = listed.where("state <> 'deleted'").select("version", "origin").distinct().collect()  # a row for each version and origin
        m.parts = sorted([r.version, r.origin] for r in read if there(r.version, r.origin))
        self._write(f"manifest-{version}.json", json.dumps(asdict(m)))
        self._write("CURRENT", str(version))
        return m

    def expire(self, keep: int = 2) -> list[int]:
        """Removes snapshots older than the last ``keep``, and chunks that none of those reads. The versions whose chunks went."""
        now = self.current()
        kept = [self.manifest(v) for v in range(max(1, now - keep + 1), now + 1)]
        used = {v for m in kept for v, _ in m.parts}
        gone = []
        for v in range(1, now - keep + 1):
            if (m := self._read(f"manifest-{v}.json")) is not None:
                remove_folder(self.spark, f"{self.path}/{json.loads(m)['listing']}")
                remove_folder(self.spark, f"{self.path}/manifest-{v}.json")
            if v not in used:
                remove_folder(self.spark, f"{self.path}/chunks/version={v}")
                gone.append(v)
        return gone

    def forget(self) -> None:
        """Drops this session's tables of the store; its files stay."""
        for t in self.spark.catalog.listTables():
            if t.name.startswith("store_") and self.path in str(self.spark.sql(f"DESCRIBE EXTENDED {t.name}").where("col_name = 'Location'").first()):
                self.spark.sql(f"DROP TABLE {t.name}")
