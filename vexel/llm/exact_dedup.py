"""Exact deduplication by a stateful stream.

The stream's state is keyed by content digest, lives in RocksDB (on disk, checkpointed to the shared folder) and never
expires. For each digest it retains the stable identifier of the row that stays (the smallest), a locator that leads
to that row's content, and the number of rows. The stream reads a table with a line per row: identifier, digest,
locator and, in a column of its own that the stream leaves aside, the content. Every hit on a known digest is then checked
against the full bytes of the row that stays, which its locator finds in that table; rows that differ in spite of an
equal digest go round again under the next digest, so a weak digest costs passes but never merges different texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vexel.llm.components import rows_of
from vexel.plans.storage import discard, materialise, shared_path, written_at

#: State on disk. Files aren't allocated ahead, as each of many small stores would hold room for large ones; a process's
#: stores share one bounded memory, and a store is closed when its batch is written.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: Files of the line table that one micro-batch takes.
FILES_PER_BATCH = 1000
#: Digests of groups up to which their 8-byte hashes are broadcast (some 50 MB as a hash table).
BROADCAST_ROWS = 1_000_000


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def keyed_state(lines: DataFrame) -> DataFrame:
    """Streaming or static: per digest, the row that stays and the rows so far.

    lines has digest, id and locator. The aggregation has no watermark, so its state never expires; null
    identifiers come last.
    """
    best = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("locator")))
    return lines.groupBy("digest").agg(best.alias("kept"), F.count("*").alias("n"))


def run_stream(spark: SparkSession, path: str, schema, checkpoint: str, out: str, files_per_batch: int = FILES_PER_BATCH) -> StreamingQuery:
    """Feed the line files at path that the checkpoint hasn't seen yet through the keyed state, batch by batch.

    Each batch appends the changed states to out. May be called again when files have been added: it goes on from
    the checkpointed state.
    """
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)

        def put(changed: DataFrame, batch: int) -> None:
            # a batch that is run again after a failure overwrites its own folder
            changed.select("digest", "kept.id", "kept.locator", "n").write.mode("overwrite").parquet(f"{out}/batch={batch}")

        query = keyed_state(lines).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


STATE = "digest string, id {id}, locator long, n long, batch int"


def latest_state(spark: SparkSession, out: str, id_type: str) -> DataFrame:
    """One row per digest: of the states that the batches left, the one with the most rows."""
    states = spark.read.schema(STATE.format(id=id_type)).option("ignoreMissingFiles", True).parquet(out)
    newest = F.max(F.struct("n", F.struct("id", "locator").alias("kept")))
    return states.groupBy("digest").agg(newest.alias("s")).select("digest", F.col("s.kept.id").alias("keep_id"), F.col("s.kept.locator").alias("keep_at"), F.col("s.n").alias("group_size"))


def _of_digests(texts: DataFrame, digests: DataFrame, broadcast_rows: int) -> DataFrame:
    """The rows of texts whose digest is in digests; a hash of 8 bytes a digest is broadcast up to broadcast_rows of
    them, beyond that the two are joined by shuffle."""
    if digests.count() <= broadcast_rows:
        short = digests.select(F.xxhash64("digest").alias("h")).distinct()
        return texts.join(F.broadcast(short), F.xxhash64("digest") == F.col("h"), "left_semi")
    return texts.join(digests.select("digest"), "digest", "left_semi")


def group(docs: DataFrame, digest: Callable[[Column], Column] | None = None, key: str = "doc_id", text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One line per row of docs: id, digest, text_sha256, locator, keep_id, keep_at, group_size.

    digest maps the normalised text to a string (SHA-256 by default). keep_at is the locator of the one row that
    stays.
    """
    spark = docs.sparkSession
    digest = digest or (lambda t: F.sha2(t, 256))
    texts = docs.select(F.col(f"`{key}`").alias("id"), normalised(F.col(f"`{text}`")).alias("t")).withColumn("digest", digest(F.col("t")))
    while True:
        # written once, so that a row's locator is the same in all that follows and leads to its text
        lines = materialise(texts.select("id", "digest", F.sha2("t", 256).alias("text_sha256"), "t").withColumn("locator", F.monotonically_increasing_id()), "dedup-lines")
        path = shared_path(spark, "dedup-state")
        run_stream(spark, written_at(lines), lines.schema, f"{path}/checkpoint", f"{path}/states")
        # written, so that its joins are with a plain table and Spark can split a digest that very many rows share
        state = materialise(latest_state(spark, f"{path}/states", lines.schema["id"].dataType.simpleString()), "dedup-kept")
        mixed = materialise(_mixed(lines, state.where("group_size > 1"), broadcast_rows), "dedup-mixed")
        if mixed.isEmpty():
            whole = materialise(lines.drop("t").join(state, "digest"), "dedup-groups")
            discard(lines, state, mixed)
            return whole
        # different texts met under one digest: those digests get a second part
        mark = mixed.select("digest", F.lit(True).alias("mixed"))
        longer = F.when(F.col("mixed"), F.concat("digest", F.lit(":"), F.sha2("t", 512))).otherwise(F.col("digest"))
        texts = lines.select("id", "t", "digest").join(mark, "digest", "left").select("id", "t", longer.alias("digest"))


def _mixed(lines: DataFrame, state: DataFrame, broadcast_rows: int) -> DataFrame:
    """Digests of which some row's full text differs from that of the row that stays. That row is the one at the state's
    locator; locators are unique, so this meets no large group, and Spark can split the join that brings it the hits."""
    texts = lines.select("digest", "locator", "t")
    hits = _of_digests(texts, state, broadcast_rows)
    stays = hits.join(state.select(F.col("keep_at").alias("locator")), "locator").select("digest", F.col("t").alias("stays"))
    differ = hits.join(stays, "digest").where(F.col("t") != F.col("stays"))
    # an expression, so that the distinct shuffles what differs and the join before it may be split where it is skewed
    return differ.select(F.concat("digest", F.lit("")).alias("digest")).distinct()


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest key stays; null keys come last; of repeated rows of that key one stays.
    Null texts equal empty ones. Texts are read whole. Empty table: no rows. Columns other than key and text are
    not read.
    """
    return group(docs, key=key, text=text).select(
        F.col("id").alias(key), "keep_id", F.col("group_size").cast("long").alias("group_size"),
        (F.col("locator") == F.col("keep_at")).alias("kept"), "text_sha256",
    )


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts, with their own columns of any names.

    It is a row with the group's smallest key (null keys last); null texts equal empty ones. Of rows alike in key and text,
    the first by their other columns stays. Empty table: no rows.
    """
    stays = group(docs, key=key, text=text).where(F.col("locator") == F.col("keep_at")).select("id", F.col("text_sha256").alias("own"))
    return rows_of(docs, stays, F.sha2(normalised(F.col(f"`{text}`")), 256), key, text)
