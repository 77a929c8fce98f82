"""Objects below a root as a Spark data source: a lazy scan that takes filters on the key, and a sink that commits.

``spark.read.format(NAME)`` gives ``key, size`` of every object, or with ``content`` its bytes too.  Nothing is listed before an
action; a prefix, an ending or a set of keys in the query's filters reaches the scan, which then lists only the folder that can
hold them, or asks for just those keys.  ``df.write.format(NAME)`` stores rows of ``key, content`` as objects: once for each write,
however often the rows are evaluated elsewhere, and with nothing left of a write that fails.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from folioflow.sources.objects import RowBatcher, _open_root, persistently, read_object

NAME = "folioflow_objects"
#: Planning goes down until there are this many folders for each task; keys that one task looks up.
SHARE, KEYS = 4, 500
_COLUMNS = [StructField("key", StringType()), StructField("size", LongType())]
_CONTENT = [StructField("content", BinaryType()), StructField("fetch_error", StringType())]


@dataclass
class Part(InputPartition):
    """What one task lists: folders with all below them, or (not ``deep``) their own objects alone, or some ``keys``."""

    folders: tuple[tuple[str, bool], ...] = ()
    keys: tuple[str, ...] | None = None


class ObjectReader(DataSourceReader):
    def __init__(self, schema: StructType, root: str, tasks: int) -> None:
        self.schema, self.root, self.tasks = schema, root, tasks
        self.prefix, self.endings, self.keys, self.nothing = "", [], None, False

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            if getattr(one, "attribute", None) != ("key",):
                yield one
            elif isinstance(one, StringStartsWith):
                longer, shorter = sorted((self.prefix, one.value), key=len, reverse=True)
                self.prefix, self.nothing = longer, self.nothing or not longer.startswith(shorter)
            elif isinstance(one, StringEndsWith):
                self.endings.append(one.value)
            elif isinstance(one, (EqualTo, In)):
                named = {one.value} if isinstance(one, EqualTo) else set(one.value)
                self.keys = named if self.keys is None else self.keys & named
            elif not isinstance(one, IsNotNull):
                yield one

    def _wanted(self, key: str) -> bool:
        return key.startswith(self.prefix) and all(key.endswith(e) for e in self.endings)

    def partitions(self) -> list[Part]:
        """Folders below that of the prefix, level by level, until there are enough; a folder gone through is left its own objects."""
        from pyarrow import fs

        filesystem, base = _open_root(self.root)
        if filesystem.get_file_info(base).type == fs.FileType.NotFound:
            raise FileNotFoundError(f"no such root: {self.root}")
        if self.nothing:
            return [Part(keys=())]
        if self.keys is not None:
            named = sorted(k for k in self.keys if k is not None and self._wanted(k))
            return [Part(keys=tuple(named[i : i + KEYS])) for i in range(0, len(named), KEYS)] or [Part(keys=())]
        shallow, front = [], [self.prefix.rpartition("/")[0]]
        while front and len(front) < SHARE * self.tasks:
            below = []
            for folder in front:
                found = filesystem.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"), allow_not_found=True))
                names = [info.path[len(base) + 1 :] for info in found if info.type == fs.FileType.Directory]
                below += [n for n in names if f"{n}/".startswith(self.prefix) or self.prefix.startswith(f"{n}/")]
            shallow, front = shallow + front, below
        every = [*((folder, False) for folder in shallow), *((folder, True) for folder in front)]
        return [Part(tuple(every[i :: self.tasks])) for i in range(min(self.tasks, len(every)))]

    def _listed(self, part: Part) -> Iterator[tuple[str, int]]:
        from pyarrow import fs

        filesystem, base = _open_root(self.root)
        if part.keys is not None:
            for info in filesystem.get_file_info([f"{base}/{k}" for k in part.keys]):
                if info.type == fs.FileType.File:
                    yield info.path[len(base) + 1 :], info.size
            return
        pending = [(f"{base}/{folder}".rstrip("/"), deep) for folder, deep in part.folders]
        while pending:
            folder, deep = pending.pop()
            for info in filesystem.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if info.type == fs.FileType.Directory:
                    if deep:
                        pending.append((info.path, True))
                elif self._wanted(key := info.path[len(base) + 1 :]):
                    yield key, info.size

    def read(self, partition: Part):
        out = RowBatcher(self.schema)
        read = read_object(self.root) if "content" in self.schema.names else None
        for key, size in self._listed(partition):
            row, content, error = {"key": key, "size": size}, None, None
            if read:
                try:
                    content = read(key)
                except Exception as problem:
                    error = str(problem) or type(problem).__name__
                row |= {"content": content, "fetch_error": error}
            yield from out.add(row, 64 + len(content or b""))
        yield from out.flush()


@dataclass
class Stored(WriterCommitMessage):
    """What one task has stored."""

    objects: int
    size: int


class ObjectWriter(DataSourceArrowWriter):
    """Each task stores its rows in a staging folder beside the root, writes down their keys and what it is about to replace, and
    only then moves them to their places.  A write that fails takes back all that is written down."""

    def __init__(self, root: str) -> None:
        self.root = root
        filesystem, base = _open_root(root)
        above, _, own = base.rpartition("/")
        self.stage = f"{above}/.{own}.{uuid.uuid4().hex}"

    def write(self, iterator) -> Stored:
        filesystem, base = _open_root(self.root)
        task, rows, total = f"{self.stage}/{uuid.uuid4().hex}", [], 0
        filesystem.create_dir(task, recursive=True)
        filesystem.create_dir(base, recursive=True)
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(n)) if n in batch.schema.names else None for n in ("key", "content", "content_type")]
            for i in range(batch.num_rows):
                key, content, kind = (None if c is None else c[i].as_py() for c in columns)
                if not key or content is None:
                    raise ValueError(f"an object without key or content: {key!r}")
                body = content.encode() if isinstance(content, str) else content
                metadata = {"Content-Type": kind} if kind and filesystem.type_name not in ("local", "hdfs") else None
                place = f"{task}/{len(rows)}"
                persistently(lambda: self._put(filesystem, place, body, metadata), 3, 1.0)
                rows.append(key)
                total += len(body)
        last = {key: n for n, key in enumerate(rows)}  # of rows with one key the last one counts
        held = {info.path for k in range(0, len(rows), 1000) for info in filesystem.get_file_info([f"{base}/{key}" for key in rows[k : k + 1000]]) if info.is_file}
        moves = [(n, key, f"{base}/{key}" in held) for key, n in last.items()]
        self._put(filesystem, f"{task}.moves", json.dumps(moves).encode(), None)
        for folder in {posixpath.dirname(f"{base}/{key}") for key in last}:
            filesystem.create_dir(folder, recursive=True)
        for n, key, replaces in moves:
            if replaces:
                filesystem.move(f"{base}/{key}", f"{task}/{n}.before")
            filesystem.move(f"{task}/{n}", f"{base}/{key}")
        return Stored(len(moves), total)

    @staticmethod
    def _put(filesystem, path: str, body: bytes, metadata) -> None:
        with filesystem.open_output_stream(path, metadata=metadata) as stream:
            stream.write(body)

    def commit(self, messages) -> None:
        self._clear()

    def abort(self, messages) -> None:
        from pyarrow import fs

        filesystem, base = _open_root(self.root)
        for info in filesystem.get_file_info(fs.FileSelector(self.stage, allow_not_found=True)):
            if not info.path.endswith(".moves"):
                continue
            task = info.path.removesuffix(".moves")
            with filesystem.open_input_stream(info.path) as stream:
                moves = json.loads(stream.read())
            for n, key, _ in moves:
                if filesystem.get_file_info(f"{task}/{n}").type == fs.FileType.NotFound:  # moved to its place
                    filesystem.delete_file(f"{base}/{key}")
                if filesystem.get_file_info(f"{task}/{n}.before").is_file:
                    filesystem.move(f"{task}/{n}.before", f"{base}/{key}")
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        filesystem, _ = _open_root(self.root)
        if filesystem.get_file_info(self.stage).type == fs.FileType.Directory:
            filesystem.delete_dir(self.stage)


class ObjectStore(DataSource):
    """Options: ``root``; ``content`` (``true``: the bytes too, or ``fetch_error``); ``tasks`` among which folders are dealt."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        content = self.options.get("content", "false").lower() == "true"
        return StructType([*_COLUMNS, *(_CONTENT if content else ())])

    def reader(self, schema: StructType) -> ObjectReader:
        return ObjectReader(schema, self.options["root"], max(1, int(self.options.get("tasks", 64))))

    def writer(self, schema: StructType, overwrite: bool) -> ObjectWriter:
        if overwrite:
            raise ValueError("objects are added or replaced by key: write in mode append")
        return ObjectWriter(self.options["root"])


def registered(spark: SparkSession) -> SparkSession:
    """``spark`` with this source and with filters reaching sources like it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ObjectStore)
    return spark


def objects(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """``key, size`` (and ``content, fetch_error``) of every object below ``root``, listed when an action runs."""
    tasks = 2 * spark.sparkContext.defaultParallelism
    return registered(spark).read.format(NAME).option("root", root).option("tasks", tasks).option("content", str(content).lower()).load()


def store(rows: DataFrame, root: str) -> None:
    """Store rows of ``key``, ``content`` (text or bytes) and, if there is one, ``content_type`` as objects, all or none."""
    registered(rows.sparkSession)
    rows.write.format(NAME).option("root", root).mode("append").save()
