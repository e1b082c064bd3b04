"""Small tables kept in the folder every executor can reach."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Spark's switch for deleting a command's shuffle files as soon as it has ended, instead of when the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_LOCAL_FALLBACK: dict[str, str] = {}
_WRITTEN: dict[tuple, str] = {}
_DELETED_AT_EXIT: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = context.applicationId
    if app not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[app] = tempfile.mkdtemp(prefix="rainledger-")
    return _LOCAL_FALLBACK[app]


def file_system(spark: SparkSession, path: str):
    """The path as Hadoop sees it, and the file system it lies in."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder of this application; all of them are deleted when the application ends."""
    own = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    if own not in _DELETED_AT_EXIT:
        path, files = file_system(spark, own)
        files.mkdirs(path)
        files.deleteOnExit(path)
        _DELETED_AT_EXIT.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """While it lasts, each command deletes its shuffle files when it ends, so that those of one write don't lie beside the next one's."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def file_bytes(spark: SparkSession, *tables: str) -> int:
    """Bytes of all files of the tables."""
    found = [file_system(spark, table) for table in tables]
    return sum(files.getContentSummary(path).getLength() for path, files in found)


def file_state(spark: SparkSession, *tables: str) -> tuple:
    """Name, size and time of every file of the tables: what tells that an input has changed."""
    state = []
    for table in tables:
        path, files = file_system(spark, table)
        found = files.listStatus(path) if files.exists(path) else []
        state += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found]
    return tuple(sorted(state))


def stored(
    spark: SparkSession,
    source: str,
    name: str,
    schema: StructType,
    build: Callable[[], DataFrame],
    state: tuple = (),
) -> DataFrame:
    """Write ``build()`` once per application and state of its source, then read it back.

    The written table cuts the lineage and gives Catalyst the true size of the files,
    so every later query on it plans from facts instead of join estimates. ``state`` is the
    ``file_state`` of the input: other files, sizes or times make a new table.
    """
    key = (spark.sparkContext.applicationId, source, name, state)
    if key not in _WRITTEN:
        path = new_folder(spark, name)
        build().select(*schema.fieldNames()).write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.schema(schema).parquet(_WRITTEN[key])


def kept(table: DataFrame, name: str) -> DataFrame:
    """Write a table to a new folder and read it back."""
    path = new_folder(table.sparkSession, name)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)
