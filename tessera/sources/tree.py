"""File trees as a partitioned source: executors walk subtrees and never enter what is ignored.

The driver lists a few upper folders, only as many as there are to be partitions; everything below is listed where it is read. A folder
that is excluded, by name or by an ignore file at or above it, is not listed at all. Ignore files may stand in any folder and hold for what is below it.
"""

from __future__ import annotations

import fnmatch
import json
import os
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.naming import category, suffix
from ..operators.filters import EXCLUDED, EXTENSIONS
from .files import decode

IGNORE_FILE = ".indexignore"
#: Rows, and bytes of content, of a batch.
ROWS, BYTES = 1000, 2 << 20
SCHEMA = "path string, origin string, bytes long, modified timestamp, content binary"
IS_GLOB = re.compile(r"[*?\[]")


@dataclass(frozen=True)
class Rules:
    """What isn't indexed: folders by name (one with slashes never matches, as a part of a path has none), and file names by shell globs, case counting."""

    folders: frozenset[str] = frozenset()
    globs: tuple[str, ...] = ()

    def plus(self, text: str) -> Rules:
        """With the lines of an ignore file: one with *, ? or [ is a glob, # begins a comment."""
        lines = [x.rstrip("/") for x in map(str.strip, text.splitlines()) if x and not x.startswith("#")]
        return Rules(self.folders | {x for x in lines if not IS_GLOB.search(x)}, (*self.globs, *(x for x in lines if IS_GLOB.search(x))))


@dataclass(frozen=True)
class Walk(InputPartition):
    """A folder, to be listed with all below it or (``deep`` false) alone."""

    folder: str
    origin: str
    rules: Rules
    deep: bool = True


@dataclass
class Walker:
    """``uri``: any folder of the store. Roots below other roots are walked by themselves alone."""

    uri: str
    roots: dict[str, str]
    extensions: tuple[str, ...]
    include: tuple[str, ...] = ()
    listed: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.fs = pafs.FileSystem.from_uri(self.uri)[0] if re.match(r"[a-z0-9]+://", self.uri) else pafs.LocalFileSystem()

    def list(self, walk: Walk) -> tuple[list, list[Walk]]:
        """(files, subfolders) of a folder by its rules and those of its own ignore file."""
        self.listed.append(walk.folder)
        rules, files, below = walk.rules, [], []
        found = sorted(self.fs.get_file_info(pafs.FileSelector(walk.folder, allow_not_found=True)), key=lambda x: x.path)
        if any(x.base_name == IGNORE_FILE and x.is_file for x in found):
            with self.fs.open_input_stream(posixpath.join(walk.folder, IGNORE_FILE)) as f:
                rules = rules.plus(f.read().decode("utf-8-sig", "ignore"))
        for x in found:
            name = x.base_name
            if name in rules.folders:  # a part of a path is a folder or the file's own name
                continue
            if x.type == pafs.FileType.Directory:
                if x.path not in self.roots and not (isinstance(self.fs, pafs.LocalFileSystem) and os.path.islink(x.path)):
                    below.append(replace(walk, folder=x.path, rules=rules))
            elif x.is_file and posixpath.splitext(name)[1].lower() in self.extensions and not any(fnmatch.fnmatchcase(name, g) for g in rules.globs):
                if not self.include or any(fnmatch.fnmatchcase(name, g) for g in self.include):
                    files.append(x)
        return files, below

    def partitions(self, rules: Rules, most: int) -> list[Walk]:
        """Subtrees of all roots: upper folders are opened, those with most below them first seen first, until there are ``most``."""
        outer = {r: min(o for x, o in self.roots.items() if r == x or r.startswith(x.rstrip("/") + "/")) for r in self.roots}
        todo = [Walk(r, o, rules) for r, o in sorted(outer.items()) if not rules.folders & set(r.split("/"))]
        done: list[Walk] = []
        while todo and len(todo) + len(done) < most:
            level, todo = todo, []
            for i, walk in enumerate(level):
                if len(todo) + len(done) + len(level) - i >= most:
                    return done + todo + level[i:]
                _, below = self.list(walk)
                done.append(replace(walk, deep=False))
                todo += below
        return done + todo

    def files(self, walk: Walk) -> Iterator[tuple[str, object]]:
        todo = [walk]
        while todo:
            files, below = self.list(todo.pop())
            yield from files
            todo += reversed(below) if walk.deep else []


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        given = lambda name, default="[]": json.loads(options.get(name, default))
        self.uri, self.walk_roots, self.extensions, self.include = options["uri"], given("roots"), tuple(given("extensions")), tuple(given("include"))
        self.rules = Rules(frozenset(given("folders")), tuple(given("exclude")))
        self.most, self.content = int(options.get("partitions", "64")), options.get("content", "true") == "true"

    def walker(self) -> Walker:
        return Walker(self.uri, dict(self.walk_roots), self.extensions, self.include)

    def partitions(self) -> list[Walk]:
        return self.walker().partitions(self.rules, self.most)

    def read(self, partition: Walk) -> Iterator[pa.RecordBatch]:
        walker, rows, size = self.walker(), [], 0
        for x in walker.files(partition):
            data = None
            if self.content:
                with walker.fs.open_input_stream(x.path) as f:
                    data = f.read()
            rows.append((x.path, partition.origin, x.size, x.mtime, data))
            size += len(data or b"")
            if len(rows) >= ROWS or size >= BYTES:
                yield batch_of(rows)
                rows, size = [], 0
        yield batch_of(rows)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.binary()]
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["path", "origin", "bytes", "modified", "content"])


class TreeSource(DataSource):
    """``spark.read.format("source_tree")``; ``walk`` sets its options."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


def walk(spark: SparkSession, roots: dict[str, list[str]], extensions=EXTENSIONS, folders=EXCLUDED, include: list[str] | None = None, exclude: list[str] | None = None, text: bool = True, partitions: int | None = None) -> DataFrame:
    """Files below ``roots`` (origin -> folders, all in one store that driver and executors reach) as ``files.scan`` gives them: path, origin, ext,
    category, bytes, modified and, with ``text``, text, n_chars and sha256. folders: names that are never entered; exclude and include: globs of file
    names. An ignore file below a root adds to both for its own folder and what is below it. A folder under two roots is walked once, for the first origin
    by name; links to folders aren't followed; a root that isn't there has no files."""
    tops = [(origin, top) for origin, xs in roots.items() for top in xs]
    if not tops:
        raise ValueError("no roots")
    plain = lambda top: (pafs.FileSystem.from_uri(top)[1] if re.match(r"[a-z0-9]+:/", top) else os.path.abspath(top)).rstrip("/") or "/"
    best: dict[str, str] = {}
    for origin, top in tops:
        best[plain(top)] = min(origin, best.get(plain(top), origin))
    spark.dataSource.register(TreeSource)
    options = {"uri": tops[0][1], "roots": json.dumps(sorted(best.items())), "extensions": json.dumps([*extensions]), "folders": json.dumps([*folders]), "include": json.dumps(include or []), "exclude": json.dumps(exclude or [])}
    n = partitions or 4 * spark.sparkContext.defaultParallelism
    raw = spark.read.format("source_tree").options(**options, partitions=str(n), content=str(text).lower()).load()
    path = F.col("path")
    out = raw.select("path", "origin", suffix(path).alias("ext"), category(path).alias("category"), "bytes", "modified", *(["content"] if text else []))
    return decode(out) if text else out


def write_tree(files: DataFrame, root: str) -> int:
    """Writes ``files(path, text)`` below ``root``, a file at a time, each by a temporary name first, so that a file is there whole or not at all; a repeated task
    writes the same again. How many were written."""

    def run(batches):
        store, top = pafs.FileSystem.from_uri(root) if re.match(r"[a-z0-9]+:/", root) else (pafs.LocalFileSystem(), root)
        made = set()
        for b in batches:
            for path, text in zip(b.column(0), b.column(1), strict=True):
                to = posixpath.join(top, path.as_py())
                folder, name = posixpath.split(to)
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                part = posixpath.join(folder, f".{name}.part")
                with store.open_output_stream(part) as f:
                    f.write(text.as_buffer() if text.is_valid else b"")
                store.move(part, to)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    return files.select("path", "text").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
