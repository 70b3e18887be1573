"""A source tree as a DataFrame: spark.read.format("repo").option(...).load(root), or a stream by readStream.

The driver enters only as many folders as it takes to have some for every task; each task then walks its own, so no list of
all paths stands anywhere. Path predicates come before anything is read: pruned folders are never entered, the size gate
and the filters that Spark pushes look at names and metadata only, and without a column that needs bytes no file is opened.
Files that read_repo opens are dealt by size.

A root with a scheme is reached through the file systems of Arrow (object stores, HDFS), any other as a folder that is mounted
under one path on every machine. Links are known for folders only; a link to a folder above itself is not entered.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as D
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.decode import ENCODINGS, decode_bytes
from ..functions.globs import PathFilter
from ..functions.text import lang_from_path
from ..operators.scratch import materialize
from ..shipping import ship

LISTED = "path string, relpath string, realpath string, is_symlink boolean, size_bytes long, mtime double"
READ = LISTED + ", sha256 string, content_sha string, content string, error string"


def most_bytes(max_file_mb: float | None) -> int | None:
    return int(max_file_mb * 1024 * 1024) if max_file_mb else None


def within(size_bytes: Column, max_file_mb: float | None) -> Column:
    """The walker's size gate as a column."""
    most = most_bytes(max_file_mb)
    return F.lit(True) if most is None else size_bytes <= most


@dataclass(frozen=True)
class Folder:
    """A folder of the tree: its path below the root, and the real paths of it and of those above it."""

    rel: str
    above: tuple[str, ...] = ()


class Tree:
    """Folders and files of a root by the rules of a path filter."""

    def __init__(self, root: str, include: list[str], exclude: list[str], max_file_mb: float | None = None, follow_symlinks: bool = False, include_hidden: bool = True) -> None:
        self.chosen, self.most, self.follow = PathFilter(include, exclude, include_hidden), most_bytes(max_file_mb), follow_symlinks
        self.remote = "://" in root
        self.root = root.rstrip("/") if self.remote else os.path.abspath(root)

    def _store(self):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.root)

    def start(self) -> list[Folder]:
        if self.remote:
            store, base = self._store()
            return [Folder("")] if store.get_file_info(base).is_file is False else []
        return [Folder("", (os.path.realpath(self.root),))] if os.path.isdir(self.root) else []

    def enter(self, folder: Folder) -> tuple[list[Folder], list[str]]:
        """The folders to enter and the relative paths of the files that pass, both in order of name."""
        folders, files = [], []
        for name, is_folder, is_link in self._entries(folder.rel):
            rel = f"{folder.rel}/{name}" if folder.rel else name
            if is_folder:
                if not self.chosen.enters(name) or (is_link and not self.follow):
                    continue
                real = os.path.realpath(os.path.join(self.root, rel)) if not self.remote else rel
                if real not in folder.above:
                    folders.append(Folder(rel, (*folder.above, real)))
            elif self.chosen.takes(rel) and (self.follow or not is_link):
                files.append(rel)
        return folders, files

    def _entries(self, rel: str) -> list[tuple[str, bool, bool]]:
        try:
            if self.remote:
                from pyarrow.fs import FileSelector, FileType

                store, base = self._store()
                found = store.get_file_info(FileSelector(f"{base}/{rel}" if rel else base))
                return sorted((f.base_name, f.type == FileType.Directory, False) for f in found)
            with os.scandir(os.path.join(self.root, rel)) as entries:
                return sorted((e.name, e.is_dir(), e.is_symlink()) for e in entries)
        except OSError:
            return []

    def files(self, folder: Folder) -> Iterator[str]:
        """Relative paths below a folder, in order of folders as they are entered."""
        folders, files = self.enter(folder)
        yield from files
        for inner in folders:
            yield from self.files(inner)

    def listed(self, rel: str) -> tuple | None:
        """The listed columns of a file; None if it is gone or over the size gate."""
        try:
            if self.remote:
                store, base = self._store()
                info = store.get_file_info(f"{base}/{rel}")
                path = f"{self.root}/{rel}"
                row = (path, rel, path, False, info.size, info.mtime.timestamp() if info.mtime else 0.0)
                if not info.is_file:
                    return None
            else:
                row = file_row(os.path.join(self.root, rel), self.root)
        except OSError:
            return None
        return None if self.most is not None and row[4] > self.most else row

    def read(self, rel: str, encodings: list[str] | tuple[str, ...]) -> tuple:
        """sha256, content_sha, content and error of a file."""
        try:
            if self.remote:
                store, base = self._store()
                with store.open_input_stream(f"{base}/{rel}") as f:
                    data = f.read()
            else:
                with open(os.path.join(self.root, rel), "rb") as f:
                    data = f.read()
        except OSError as e:
            return None, None, None, str(e)
        return _contents(data, encodings)


def _contents(data: bytes, encodings: list[str] | tuple[str, ...]) -> tuple:
    content = decode_bytes(data, encodings)
    sha = None if content is None else hashlib.sha256(content.encode("utf-8", "replace")).hexdigest()
    return hashlib.sha256(data).hexdigest(), sha, content, None if content is not None else "no encoding fits"


def iter_files(root: str, include: list[str], exclude: list[str], max_file_mb: float | None = None, follow_symlinks: bool = False, include_hidden: bool = True) -> Iterator[str]:
    """Absolute paths under root that pass, folder by folder in order of name; nothing if root is no folder."""
    tree = Tree(root, include, exclude, max_file_mb, follow_symlinks, include_hidden)
    for folder in tree.start():
        for rel in tree.files(folder):
            if tree.listed(rel) is not None:
                yield f"{tree.root}/{rel}"


def file_row(path: str, root: str) -> tuple:
    """The listed columns of one file; path and realpath are both resolved."""
    real = os.path.realpath(path)
    stat = os.stat(real)
    return real, os.path.relpath(os.path.abspath(path), os.path.abspath(root)).replace(os.sep, "/"), real, os.path.islink(path), stat.st_size, stat.st_mtime


def index_file(path: str, root: str, max_file_mb: float | None = None, encodings: list[str] | tuple[str, ...] = ENCODINGS) -> dict | None:
    """One file as a record of the read columns; None if it is gone or its real size is over the limit."""
    try:
        row = file_row(path, root)
        if max_file_mb and row[4] > most_bytes(max_file_mb):
            return None
        with open(path, "rb") as f:
            data = f.read()
    except FileNotFoundError:
        return None
    names = [c.split()[0] for c in READ.split(", ")]
    return dict(zip(names, (*row, *_contents(data, encodings))))


#: Folders to walk for each task that the driver looks for, and entries that it looks at for them, at most.
FOLDERS, LOOKED_AT = 256, 20_000
#: Bytes of files that a task of read_repo opens.
TASK_BYTES = 64 << 20

_COMPARED = {"EqualTo": lambda a, b: a == b, "GreaterThan": lambda a, b: a > b, "GreaterThanOrEqual": lambda a, b: a >= b, "LessThan": lambda a, b: a < b, "LessThanOrEqual": lambda a, b: a <= b}
_MATCHED = {"StringStartsWith": str.startswith, "StringEndsWith": str.endswith, "StringContains": str.__contains__}
_NAMES = [c.split()[0] for c in LISTED.split(", ")]


def accepted(filter_: D.Filter) -> bool:
    """Can the listing decide it: a comparison of a listed column with values?"""
    kind = type(filter_).__name__
    return getattr(filter_, "attribute", ())[:1] in [(n,) for n in _NAMES] and len(filter_.attribute) == 1 and (kind in _COMPARED or kind in _MATCHED or kind in ("In", "IsNotNull"))


def holds(filter_: D.Filter, row: tuple) -> bool:
    kind, value = type(filter_).__name__, row[_NAMES.index(filter_.attribute[0])]
    if value is None or kind == "IsNotNull":
        return value is not None
    if kind == "In":
        return value in filter_.value
    return (_COMPARED.get(kind) or _MATCHED[kind])(value, filter_.value)


@dataclass
class _Work(InputPartition):
    """Folders to walk, and files that lie in folders which the driver has entered."""

    folders: list[Folder]
    files: list[str]


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.tree = Tree(
            options["path"], json.loads(options.get("include_globs", '["*"]')), json.loads(options.get("exclude_globs", "[]")), float(options.get("max_file_mb", 0)) or None,
            str(options.get("follow_symlinks", "false")).lower() == "true", str(options.get("include_hidden", "true")).lower() == "true",
        )
        self.per_task = int(options.get("files_per_task", 500))
        self.encodings = json.loads(options.get("encodings", json.dumps(ENCODINGS)))
        self.columns = [f.name for f in schema]
        self.filters: list[D.Filter] = []

    def partitions(self) -> list[InputPartition]:
        """Folders are entered level by level until there are enough to deal out."""
        todo, files, seen = deque(self.tree.start()), [], 0
        while todo and len(todo) < FOLDERS and seen < LOOKED_AT:
            folders, here = self.tree.enter(todo.popleft())
            todo.extend(folders)
            files += here
            seen += len(folders) + len(here)
        work = [_Work([f], []) for f in todo]
        return work + [_Work([], files[i : i + self.per_task]) for i in range(0, len(files), self.per_task)] or [_Work([], [])]

    def listed(self, work: _Work) -> Iterator[tuple]:
        for rel in (*work.files, *(rel for folder in work.folders for rel in self.tree.files(folder))):
            row = self.tree.listed(rel)
            if row is not None and all(holds(f, row) for f in self.filters):
                yield row

    def rows(self, listed: Iterator[tuple]) -> Iterator[tuple]:
        names = [c.split()[0] for c in READ.split(", ")]
        at = [names.index(c) for c in self.columns]
        opens = max(at, default=0) >= len(_NAMES)
        for row in listed:
            whole = (*row, *(self.tree.read(row[1], self.encodings) if opens else ()))
            yield tuple(whole[i] for i in at)

    def read(self, partition: _Work) -> Iterator[tuple]:
        return self.rows(self.listed(partition))


class _Filtered(_Reader):
    """For sessions that push filters to Python sources: Spark refuses such a reader in any other."""

    def pushFilters(self, filters):
        for f in filters:
            if accepted(f):
                self.filters.append(f)
            else:
                yield f


class _Stream(DataSourceStreamReader):
    """Files in order of (mtime, relpath): a batch is what lies between two such offsets, so a file that changes comes again,
    one that does not never does, and a batch that is replayed is the same. A file counts once it is `settle` seconds old;
    one that is put in later with an older time than the last batch's is not seen."""

    def __init__(self, options: dict, schema: StructType) -> None:
        self.reader, self.settle = _Reader(options, schema), float(options.get("settle", 1.0))

    def initialOffset(self) -> dict:
        return {"mtime": -1.0, "relpath": ""}

    def latestOffset(self) -> dict:
        until = time.time() - self.settle
        last = max(((row[5], row[1]) for work in self.reader.partitions() for row in self.reader.listed(work) if row[5] <= until), default=(-1.0, ""))
        return {"mtime": last[0], "relpath": last[1]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = ((x["mtime"], x["relpath"]) for x in (start, end))
        return [_Between(w.folders, w.files, low, high) for w in self.reader.partitions()]

    def read(self, partition: _Between) -> Iterator[tuple]:
        return self.reader.rows(row for row in self.reader.listed(partition) if partition.low < (row[5], row[1]) <= partition.high)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


@dataclass
class _Between(_Work):
    low: tuple[float, str]
    high: tuple[float, str]


class RepoDataSource(DataSource):
    """Python data source `repo`. A schema that names some of its columns reads only these."""

    @classmethod
    def name(cls) -> str:
        return "repo"

    def schema(self) -> str:
        return READ

    def reader(self, schema: StructType) -> DataSourceReader:
        pushed = str(self.options.get("push_filters", "false")).lower() == "true"
        return (_Filtered if pushed else _Reader)(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(dict(self.options), schema)


#: Spark asks Python sources about filters only if this is set; the option push_filters says so to the source.
PUSH = "spark.sql.python.filterPushdown.enabled"


def _source(spark: SparkSession, reader, indexing: dict, over: dict):
    ship(spark)
    spark.dataSource.register(RepoDataSource)
    cfg = {**indexing, **{k: v for k, v in over.items() if v is not None}}
    reader = reader.format("repo")
    for key in ("include_globs", "exclude_globs", "encodings"):
        reader = reader.option(key, json.dumps(cfg[key]))
    for key in ("max_file_mb", "follow_symlinks", "include_hidden"):
        reader = reader.option(key, str(cfg[key]))
    return reader, cfg


def list_repo(spark: SparkSession, root: str, indexing: dict, **over) -> DataFrame:
    """The listed columns of a tree's files with language; no file is opened."""
    reader, _ = _source(spark, spark.read, indexing, over)
    reader = reader.option("push_filters", spark.conf.get(PUSH, "false"))
    return reader.schema(LISTED).load(root).withColumn("lang", lang_from_path("relpath"))


def read_repo(spark: SparkSession, root: str, indexing: dict, keep_errors: bool = False, **over) -> DataFrame:
    """Files of a tree with language; indexing is that section of the configuration, keywords override it.

    The listing is written once; files are then opened in tasks of about TASK_BYTES.
    """
    _, cfg = _source(spark, spark.read, indexing, over)
    listed = materialize(list_repo(spark, root, indexing, **over), "listed")
    total = listed.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]
    tree, encodings = Tree(root, ["*"], []), cfg["encodings"]

    def run(batches):
        for batch in batches:
            found = [tree.read(rel, encodings) for rel in batch.column("relpath").to_pylist()]
            more = [pa.array(c, pa.string()) for c in (zip(*found) if found else [[]] * 4)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "sha256", "content_sha", "content", "error"])

    dealt = listed.repartition(max(1, -(-total // TASK_BYTES)), "relpath")
    schema = f"{LISTED}, lang string, sha256 string, content_sha string, content string, error string"
    files = dealt.mapInArrow(run, schema)
    # Unreadable files are skipped, but can be asked for with their error.
    return files if keep_errors else files.filter(F.col("error").isNull()).drop("error")


def stream_repo(spark: SparkSession, root: str, indexing: dict, settle: float = 1.0, **over) -> DataFrame:
    """New and changed files of a tree, as a stream of read_repo's columns."""
    reader, _ = _source(spark, spark.readStream, indexing, over)
    files = reader.option("settle", str(settle)).load(root).withColumn("lang", lang_from_path("relpath"))
    return files.filter(F.col("error").isNull()).drop("error")
