"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import weakref

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: set[str] = set()
_tables: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes that one batch for Python has (a single longer row is a batch).
BYTES_AT_ONCE = 8 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one of our own only where that is unset.

    The fallback serves a local master alone: on a cluster a machine-local folder would be invisible to
    other machines, so there the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="vexel-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table in the shared folder, under one folder per application that is removed
    when the driver's JVM ends."""
    app = spark.sparkContext.applicationId
    folder = f"{shared_root(spark)}/vexel-{app}"
    if folder not in _made:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(at)
        files.deleteOnExit(at)
        _made.add(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, compression: str | None = None, folders: str | None = None) -> DataFrame:
    """Write df to a table in the shared folder and read it again: lineage is cut, and a lost executor costs
    no recomputation of what lies before. folders names a column by whose values the table is laid in folders."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path, compression=compression, partitionBy=folders)
    table = spark.read.schema(schema).parquet(path)
    _tables[table] = path
    return table


def written_at(table: DataFrame) -> str:
    """Where materialise has written a table."""
    return _tables[table]


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("/"):
        uri = "file://" + uri
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def files_of(table: DataFrame) -> list[str]:
    """The files of a table that materialise has written, for tasks that read them by themselves."""
    spark = table.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(written_at(table))
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True)
    out = []
    while found.hasNext():
        at = found.next().getPath().toString()
        if at.endswith(".parquet"):
            out.append(at)
    return sorted(out)


def discard(*tables: DataFrame) -> None:
    """Remove tables that materialise has written and nothing reads any more."""
    for t in tables:
        path = _tables.pop(t, None)
        if path is not None:
            spark = t.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes that are handed to Python at a time, unless the session sets that itself."""
    if not spark.conf._jconf.contains(BATCH_BYTES):
        spark.conf.set(BATCH_BYTES, str(BYTES_AT_ONCE))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
