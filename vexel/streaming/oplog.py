"""The operation log as a stream: every batch of new lines is folded into the snapshot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vexel.operators import lifecycle


def apply_log(
    spark: SparkSession,
    log: str,
    snapshot: str,
    checkpoint_dir: str,
    files_per_batch: int = 1,
    available_now: bool = True,
    on_insert: Callable[[DataFrame], None] | None = None,
    on_delete: Callable[[DataFrame], None] | None = None,
) -> StreamingQuery:
    """Start a query that folds log files into the snapshot, batch by batch; deletes show at the next batch.

    A batch that is run again after a failure changes nothing: lines up to the snapshot's checkpoint_seq are left out.
    Lines must reach the log in order of seq. The callbacks get each batch's new inserts and deletes.
    """

    def fold(batch: DataFrame, _: int) -> None:
        try:
            own = lifecycle.properties(spark, snapshot)
            base, after = lifecycle.load(spark, snapshot), own.get("checkpoint_seq", -1)
        except FileNotFoundError:
            own, base, after = {}, None, -1
        lines = batch.where(F.col("seq") > after)
        last = lines.agg(F.max("seq")).first()[0]
        if last is None:
            return
        if on_insert is not None:
            on_insert(lines.where(F.col("op") == lifecycle.INSERT))
        if on_delete is not None:
            on_delete(lines.where(F.col("op") == lifecycle.DELETE))
        kept = {k: v for k, v in own.items() if k not in ("version", "checkpoint_seq")}
        lifecycle.save(lifecycle.replay(lines, base), snapshot, last, **kept)

    lines = spark.readStream.schema(lifecycle.OPLOG).option("maxFilesPerTrigger", files_per_batch).parquet(log)
    writer = lines.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint_dir)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
