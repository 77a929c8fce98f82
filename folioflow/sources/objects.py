"""Object reads, writes and listing by key, done inside tasks.

Spark's own file sources list a whole tree on the driver and leave out names that begin with ``_``
or ``.``.  The functions here list inside tasks, every name, and otherwise take a *table of keys*:
the keys may first be joined, filtered and repartitioned like any other table, and only the objects
left are touched, each by the task that holds its key.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folioflow.session import bounded, materialise

#: What one task of :func:`spread` gets at most on average.
ROWS_PER_TASK = 1000
BYTES_PER_TASK = 128 * 1024 * 1024

#: Further tries of a read or write that failed for a passing reason, and seconds between them.
RETRIES, PAUSE = 3, 5.0

#: Folders that are enough to keep every core busy with whole sub-trees, per core.
FOLDERS_PER_CORE = 4

#: Output batches are handed over once they hold this many bytes.
FLUSH_BYTES = 4 * 1024 * 1024

#: A writer remembers so many folders that it has made.
FOLDERS_HELD = 10_000


class RowBatcher:
    """Collects output rows of a task and turns them into record batches of bounded size."""

    def __init__(self, schema: T.StructType) -> None:
        self.schema = to_arrow_schema(schema)
        self.rows: list[dict] = []
        self.size = 0

    def add(self, row: dict, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size
        if self.size >= FLUSH_BYTES or len(self.rows) >= 10_000:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_pylist(self.rows, schema=self.schema)
            self.rows, self.size = [], 0


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch one at a time, so that only one document is a Python object at once."""
    names, columns = batch.schema.names, batch.columns
    for i in range(batch.num_rows):
        yield {name: column[i].as_py() for name, column in zip(names, columns)}


def _open_root(root: str):
    from pyarrow import fs

    if root.startswith(("s3a://", "s3n://")):
        root = "s3" + root[3:]
    filesystem, base = fs.FileSystem.from_uri(root if "://" in root else "file://" + root.removeprefix("file:"))
    return filesystem, base.rstrip("/")


def persistently(action: Callable[[], object], retries: int, pause: float):
    """Result of ``action``, tried again after failures of the store that may pass; a missing object does not."""
    lasting = (FileNotFoundError, NotADirectoryError, IsADirectoryError, PermissionError)
    for left in reversed(range(retries + 1)):
        try:
            return action()
        except OSError as problem:
            if not left or isinstance(problem, lasting):
                raise
            time.sleep(pause)


def read_object(root: str, retries: int = RETRIES, pause: float = PAUSE):
    """A ``key -> bytes`` reader bound to ``root``, to be made once per task."""
    filesystem, base = _open_root(root)

    def once(key: str) -> bytes:
        with filesystem.open_input_stream(f"{base}/{key}") as stream:
            return stream.read()

    return lambda key: persistently(lambda: once(key), retries, pause)


def write_object(root: str, retries: int = RETRIES, pause: float = PAUSE):
    """A ``(key, bytes, content type)`` writer bound to ``root``, to be made once per task.

    On file systems with rename the object appears whole or not at all; it grows in a folder beside the root, so that a
    listing never meets it.  Each writer has a folder there of its own, as tasks that make files in one folder wait for each
    other.  A store with object metadata gets the content type.

    In place of the bytes there may be a whole number: that many zero bytes, which take no room on a local file system.
    """
    import uuid

    filesystem, base = _open_root(root)
    renames = filesystem.type_name in ("local", "hdfs")
    above, _, own = base.rpartition("/")
    parts, made = f"{above}/.{own}.parts/{uuid.uuid4().hex}", set()
    zeros = bytes(1024 * 1024)

    def fill(place: str, body: bytes | int, metadata: dict | None) -> None:
        if isinstance(body, int) and filesystem.type_name == "local":
            with open(place, "wb") as file:
                file.truncate(body)
            return
        with filesystem.open_output_stream(place, metadata=metadata) as stream:
            if not isinstance(body, int):
                stream.write(body)
                return
            for begin in range(0, body, len(zeros)):
                stream.write(zeros[: body - begin])

    def once(key: str, body: bytes | int, content_type: str | None) -> None:
        path = f"{base}/{key}"
        parent = path.rpartition("/")[0]
        if renames:
            if len(made) > FOLDERS_HELD:
                made.clear()
            for folder in {parent, parts} - made:
                filesystem.create_dir(folder, recursive=True)
                made.add(folder)
        place = f"{parts}/{uuid.uuid4().hex}" if renames else path
        metadata = {"Content-Type": content_type} if content_type and not renames else None
        fill(place, body, metadata)
        if renames:
            filesystem.move(place, path)

    return lambda key, body, content_type=None: persistently(lambda: once(key, body, content_type), retries, pause)


def spread(keys: DataFrame, tasks: int | None = None) -> DataFrame:
    """Hash the rows of a small table over ``tasks`` tasks, because each row stands for large work.

    Adaptive execution would merge partitions by the bytes of the keys, not of the objects behind
    them; an explicit number is left alone.  Without one it follows from the number of rows, from
    the ``size`` column and from the cores at hand, which costs one pass over the keys.
    """
    if tasks is None:
        size = F.sum("size") if "size" in keys.columns else F.lit(0)
        total = keys.agg(F.count("*").alias("n"), size.alias("b")).first()
        cores = keys.sparkSession.sparkContext.defaultParallelism
        wanted = max(cores, -(-total["n"] // ROWS_PER_TASK), -(-(total["b"] or 0) // BYTES_PER_TASK))
        tasks = max(1, min(wanted, total["n"]))
    return keys.repartition(tasks, keys.columns[0])


def fetch_objects(
    keys: DataFrame, root: str, key: str = "key", tasks: int | None = None, retries: int = RETRIES, pause: float = PAUSE
) -> DataFrame:
    """Add ``content`` and ``fetch_error`` to a table of keys.  A missing object is a row, not a crash."""
    bounded(keys.sparkSession)
    keys = spread(keys, tasks)
    schema = T.StructType(
        [*keys.schema.fields, T.StructField("content", T.BinaryType()), T.StructField("fetch_error", T.StringType())]
    )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, out = read_object(root, retries, pause), RowBatcher(schema)
        for batch in batches:
            for row in rows_of(batch):
                content, error = None, None
                try:
                    content = read(row[key])
                except Exception as problem:
                    error = str(problem) or type(problem).__name__
                yield from out.add({**row, "content": content, "fetch_error": error}, len(content or b""))
        yield from out.flush()

    return keys.mapInArrow(fetch, schema)


def fetch_parts(keys: DataFrame, root: str, part_bytes: int, tasks: int | None = None, retries: int = RETRIES, pause: float = PAUSE) -> DataFrame:
    """``key, part, offset, content, fetch_error`` of the objects in ``keys`` (``key``, ``size``), ``part_bytes`` a row.

    Parts of one object are read by several tasks, each asking the store for its range only, so an object may be larger than
    a row or a task's memory.  An empty object has one empty part; a missing one has rows with an error.
    """
    last = F.greatest(F.ceil(F.col("size") / part_bytes) - 1, F.lit(0))
    parts = keys.select(F.col("key"), F.col("size").alias("__size"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    parts = parts.select("key", "part", (F.col("part") * part_bytes).alias("offset"), F.least(F.lit(part_bytes), F.col("__size") - F.col("part") * part_bytes).alias("size"))
    if tasks is None:
        total = parts.agg(F.count("*").alias("n"), F.sum("size").alias("b")).first()
        tasks = max(1, min(total["n"], max(parts.sparkSession.sparkContext.defaultParallelism, -(-(total["b"] or 0) // BYTES_PER_TASK))))
    schema = T.StructType([*parts.schema.fields[:3], T.StructField("content", T.BinaryType()), T.StructField("fetch_error", T.StringType())])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _open_root(root)
        out = RowBatcher(schema)

        def read(row: dict) -> bytes:
            with filesystem.open_input_file(f"{base}/{row['key']}") as file:
                return file.read_at(row["size"], row["offset"])

        for batch in batches:
            for row in batch.to_pylist():
                content, error = None, None
                try:
                    content = persistently(lambda: read(row), retries, pause)
                except Exception as problem:
                    error = str(problem) or type(problem).__name__
                made = {"key": row["key"], "part": row["part"], "offset": row["offset"], "content": content, "fetch_error": error}
                yield from out.add(made, len(content or b""))
        yield from out.flush()

    return parts.repartition(tasks, "key", "part").mapInArrow(fetch, schema)


def put_objects(
    objects: DataFrame,
    root: str,
    key: str = "key",
    content: str = "content",
    content_type: Column | None = None,
    retries: int = RETRIES,
    pause: float = PAUSE,
) -> DataFrame:
    """Write each row's bytes (or text, or as many zero bytes as a whole number says) to ``root/key`` and report ``key, size, error`` per object.

    Writing the same key again gives the same object, so a retried or doubled task does no harm.
    One failed object does not fail the others; see :func:`write_object`.  The writes happen when the
    returned table is evaluated.
    """
    schema = T.StructType(
        [
            T.StructField("key", T.StringType()),
            T.StructField("size", T.LongType()),
            T.StructField("error", T.StringType()),
        ]
    )

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write, out = write_object(root, retries, pause), RowBatcher(schema)
        for batch in batches:
            for row in rows_of(batch):
                name, body, error = row["key"], row["body"], None
                try:
                    write(name, body, row["content_type"])
                except Exception as problem:
                    error = str(problem) or type(problem).__name__
                size = body if isinstance(body, int) else len(body or b"")
                yield from out.add({"key": name, "size": size, "error": error}, 64)
        yield from out.flush()

    bounded(objects.sparkSession)
    body = F.col(content)
    if isinstance(objects.schema[content].dataType, T.StringType):
        body = F.encode(body, "UTF-8")
    kind = (F.lit(None) if content_type is None else content_type).cast("string")
    return objects.select(F.col(key).alias("key"), body.alias("body"), kind.alias("content_type")).mapInArrow(put, schema)


_LISTED = T.StructType(
    [T.StructField("key", T.StringType()), T.StructField("size", T.LongType()), T.StructField("folder", T.BooleanType())]
)


def _entries(folders: DataFrame, root: str, tasks: int | None, deep: bool) -> DataFrame:
    """What lies in the given relative folders: one level, with its folders, or everything below."""

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        filesystem, base = _open_root(root)
        out = RowBatcher(_LISTED)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                pending = [f"{base}/{folder}".rstrip("/")]
                while pending:
                    for info in filesystem.get_file_info(fs.FileSelector(pending.pop(), allow_not_found=True)):
                        down = info.type == fs.FileType.Directory
                        if down and deep:
                            pending.append(info.path)
                        else:
                            key = info.path[len(base) + 1 :]
                            yield from out.add({"key": key, "size": None if down else info.size, "folder": down}, 64)
        yield from out.flush()

    return spread(folders.select(folders.columns[0]), tasks).mapInArrow(listing, _LISTED)


def list_objects(
    spark: SparkSession, root: str, folders: DataFrame | list[str] | None = None, tasks: int | None = None, below: str = ""
) -> DataFrame:
    """``key, size`` of every object below ``root``, whatever its name, listed inside tasks.

    ``folders`` holds relative folders that do not overlap, each listed by one task.  Without it the
    folder ``below`` is listed level by level, each level's folders spread over tasks and kept below
    the shared folder, until there are enough of them to give every core whole sub-trees.  Keys never
    reach the driver, only a number of folders for each level.  One flat folder is one task; where a
    store writes inventories of it, :func:`from_inventory` takes its place.
    """
    if folders is not None:
        if isinstance(folders, list):
            folders = spark.createDataFrame([(f,) for f in folders], "folder string")
        return _entries(folders, root, tasks, deep=True).select("key", "size")
    enough = FOLDERS_PER_CORE * spark.sparkContext.defaultParallelism
    found, front = None, spark.createDataFrame([(below,)], "folder string")
    filesystem, base = _open_root(root)
    if filesystem.get_file_info(base).type.name == "NotFound":
        # An absent folder holds nothing, an absent root is an error.
        raise AnalysisException(f"[PATH_NOT_FOUND] Path does not exist: {root}")
    while True:
        level = materialise(_entries(front, root, tasks, deep=False), "listing")
        files = level.where("not folder").select("key", "size")
        found = files if found is None else found.union(files)
        front = level.where("folder").select(F.col("key").alias("folder"))
        wide = front.count()
        if not wide:
            return found
        if wide >= enough:
            return found.union(_entries(front, root, tasks, deep=True).select("key", "size"))


def remove_folders(folders: DataFrame, root: str, tasks: int | None = None) -> None:
    """Remove relative folders with all that lies below them, inside tasks.  One that is not there is no error, so a second try is none either.

    Rows without a name are left out: they would stand for the root.
    """

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _open_root(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                with suppress(FileNotFoundError):
                    persistently(lambda: filesystem.delete_dir(f"{base}/{folder}"), RETRIES, PAUSE)
            yield batch

    named = folders.select(F.col(folders.columns[0]).alias("folder")).where(F.col("folder") != "")
    spread(named, tasks).mapInArrow(remove, named.schema).write.format("noop").mode("overwrite").save()


def from_inventory(inventory: DataFrame, prefix: str = "") -> DataFrame:
    """The same table from a store's own inventory (``key``, ``size``)."""
    rows = inventory.select("key", F.col("size").cast("long").alias("size"))
    return rows.where(F.col("key").startswith(prefix)) if prefix else rows
