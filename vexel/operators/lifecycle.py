"""Deletes, compaction, snapshots and the operation log of a vector table.

Ids may repeat. A delete marks the first slot of an id, marked before or not; another slot of the id stays.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexel.schema import VECTORS, numbered

OPLOG = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("metadata", T.StringType()),
    ]
)
INSERT, DELETE = "insert", "delete"
POINTER = "CURRENT"


def delete(table: DataFrame, ids: DataFrame) -> DataFrame:
    """table with the first slot of every id of ids (id) marked; unknown ids are ignored."""
    first = first_slots(table, ids).withColumn("__gone", F.lit(True))
    marked = table.join(first, "slot", "left")
    return marked.select(*[(F.col("deleted") | F.coalesce("__gone", F.lit(False))).alias("deleted") if c == "deleted" else F.col(c) for c in table.columns])


def first_slots(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The first slot of every id of ids (id) that table has."""
    return table.select("id", "slot").join(ids.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("slot").alias("slot")).select("slot")


def is_deleted(table: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, deleted) for every id of ids: the flag of its first slot; false for an unknown id."""
    asked = ids.select("id").distinct()
    flags = table.select("id", "slot", "deleted").join(asked, "id", "left_semi").groupBy("id").agg(F.min_by("deleted", "slot").alias("deleted"))
    return asked.join(flags, "id", "left").select("id", F.coalesce("deleted", F.lit(False)).alias("deleted"))


def sizes(table: DataFrame) -> DataFrame:
    """One row: size, with marked rows, and live_size."""
    return table.agg(F.count("*").alias("size"), F.count_if(~F.col("deleted")).alias("live_size"))


def compact(table: DataFrame) -> DataFrame:
    """The live rows in their order, with dense slots."""
    return numbered(table.where(~F.col("deleted")).withColumnRenamed("slot", "__slot"), "__slot").select(*VECTORS.fieldNames())


def _files(spark: SparkSession, path: str):
    """Hadoop's file interface for path's store."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop.Path


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file by one rename."""
    fs, at = _files(spark, path)
    hidden = at(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(hidden, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(hidden), fs.makeQualified(at(path)), overwrite)


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, at = _files(spark, path)
    if not fs.exists(at(path)):
        return None
    data = fs.open(at(path))
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8")
    data.close()
    return text


def save(table: DataFrame, path: str, checkpoint_seq: int = -1, **properties) -> None:
    """Write a snapshot: a new version folder, then the pointer to it, replaced by one rename. A reader sees the old
    version or the new one."""
    spark, version = table.sparkSession, f"v-{uuid.uuid4().hex}"
    table.select(*VECTORS.fieldNames()).write.parquet(f"{path}/{version}")
    _write_text(spark, f"{path}/{POINTER}", json.dumps({"version": version, "checkpoint_seq": checkpoint_seq, **properties}))


def properties(spark: SparkSession, path: str) -> dict:
    text = _read_text(spark, f"{path}/{POINTER}")
    if text is None:
        raise FileNotFoundError(f"no snapshot at {path}")
    return json.loads(text)


def load(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """The current snapshot; its dimension must be dim, if both are known."""
    own = properties(spark, path)
    if dim is not None and own.get("dim") not in (None, dim):
        raise ValueError(f"the snapshot has {own['dim']} dimensions, not {dim}")
    return spark.read.schema(VECTORS).parquet(f"{path}/{own['version']}")


def insert_ops(rows: DataFrame, start: int, order: str = "id") -> DataFrame:
    """Log lines that insert rows (id, embedding, optional metadata), numbered from start."""
    lines = rows.select(F.col(order).alias("__order"), F.lit(INSERT).alias("op"), "id", F.col("embedding").cast("array<float>").alias("embedding"), (F.col("metadata") if "metadata" in rows.columns else F.lit("")).alias("metadata"))
    return numbered(lines, "__order", name="seq", start=start).select(*OPLOG.fieldNames())


def delete_ops(ids: DataFrame, start: int) -> DataFrame:
    lines = ids.select(F.col("id").alias("__order"), F.lit(DELETE).alias("op"), "id", F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("metadata"))
    return numbered(lines, "__order", name="seq", start=start).select(*OPLOG.fieldNames())


def append(lines: DataFrame, path: str) -> None:
    """Add log lines; each call's files appear together."""
    lines.select(*OPLOG.fieldNames()).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, after: int = -1) -> DataFrame:
    """Lines with seq above after; no log yet is an empty one."""
    fs, at = _files(spark, path)
    if not fs.exists(at(path)):
        return spark.createDataFrame([], OPLOG)
    return spark.read.schema(OPLOG).parquet(path).where(F.col("seq") > after)


def _bounds(log: DataFrame, inserted: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = log.where(F.col("op") == DELETE).groupBy("id").agg(F.max("seq").alias("__last"))
    first = inserted.join(gone.select("id"), "id", "left_semi").groupBy("id").agg(F.min(F.struct("__seq", "__slot")).alias("__first"))
    return gone, first


def replay(log: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """The table after all lines in order of seq, on top of base. Lines of other operations are skipped.

    An insert makes a slot. A slot is marked if it is the first of its id and a delete of the id came after it. That
    needs a minimum and a maximum per deleted id, and no walk through the log.
    """
    inserted = log.where(F.col("op") == INSERT).select(F.col("seq").alias("__seq"), F.lit(-1).cast("long").alias("__slot"), "id", "embedding", "metadata", F.lit(False).alias("deleted"))
    if base is not None:
        inserted = base.select(F.lit(-1).cast("long").alias("__seq"), F.col("slot").alias("__slot"), "id", "embedding", "metadata", "deleted").unionByName(inserted)
    gone, first = _bounds(log, inserted)
    marks = first.join(gone, "id").where(F.col("__first.__seq") < F.col("__last")).select(F.col("__first.__seq").alias("__seq"), F.col("__first.__slot").alias("__slot"), F.lit(True).alias("__gone"))
    out = inserted.join(marks, ["__seq", "__slot"], "left").withColumn("deleted", F.col("deleted") | F.coalesce("__gone", F.lit(False)))
    # rows of the base come first by slot, then inserts by seq
    offset = F.lit(0) if base is None else F.lit((base.agg(F.max("slot")).first()[0] or 0) + 1)
    place: Column = F.when(F.col("__seq") < 0, F.col("__slot")).otherwise(F.col("__seq") + offset)
    return numbered(out.withColumn("__place", place), "__place").select(*VECTORS.fieldNames())


def checkpoint(spark: SparkSession, snapshot: str, log: str, **more) -> DataFrame:
    """Fold the log into a new snapshot, record the last seq it holds, and drop the log files that are covered.

    A failure in between leaves the old snapshot with the log, or the new one with lines that it no longer reads.
    """
    try:
        own = properties(spark, snapshot)
        base, after = load(spark, snapshot), own.get("checkpoint_seq", -1)
    except FileNotFoundError:
        own, base, after = {}, None, -1
    lines = read_log(spark, log, after)
    last = lines.agg(F.max("seq")).first()[0]
    if last is None and base is not None:
        return base
    table = replay(lines, base)
    kept = {k: v for k, v in own.items() if k not in ("version", "checkpoint_seq")}
    save(table, snapshot, -1 if last is None else last, **(kept | more))
    truncate(spark, log, -1 if last is None else last)
    return load(spark, snapshot)


def truncate(spark: SparkSession, log: str, last: int) -> None:
    """Remove the log files whose lines all have a seq up to last."""
    fs, at = _files(spark, log)
    if fs.exists(at(log)):
        covered = read_log(spark, log).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.max("seq").alias("last")).where(F.col("last") <= last)
        for r in covered.toLocalIterator():
            fs.delete(at(r.f), False)


def recover(spark: SparkSession, snapshot: str, log: str) -> DataFrame:
    """The table as it was last: the snapshot, if there is one, and the lines after it."""
    try:
        own = properties(spark, snapshot)
    except FileNotFoundError:
        return replay(read_log(spark, log))
    return replay(read_log(spark, log, own.get("checkpoint_seq", -1)), load(spark, snapshot))
