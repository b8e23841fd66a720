"""The vector table: slot, id, embedding, metadata, deleted. Slots are dense and follow insertion order; ids may repeat."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vexel.plans.storage import materialise

METRICS = ("cosine", "l2")

VECTORS = T.StructType(
    [
        T.StructField("slot", T.LongType()),
        T.StructField("id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("metadata", T.StringType()),
        T.StructField("deleted", T.BooleanType()),
    ]
)


@dataclass(frozen=True)
class Config:
    """Of the neighbour graph: links per node and layer, breadth while building, breadth while searching."""

    M: int = 16
    ef_construction: int = 200
    ef_search: int = 50

    def __post_init__(self):
        if self.M < 2 or self.ef_construction < 1 or self.ef_search < 1:
            raise ValueError("M must be at least 2, and both breadths at least 1")


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}")
    return metric


def check_query(values: Sequence[float], dim: int | None) -> list[float]:
    out = [float(x) for x in values]
    if dim is not None and len(out) != dim:
        raise ValueError(f"the query has {len(out)} dimensions, the table {dim}")
    return out


def check_k(k: int) -> int:
    if k < 0:
        raise ValueError("k must not be negative")
    return int(k)


def vector_table(rows: DataFrame, dim: int | None = None, order: str = "id", start: int = 0, slot: str | None = None) -> DataFrame:
    """rows (id, embedding, optional metadata and deleted) as a vector table, slots numbered in the order given.

    With dim, a row of another length fails the query that reads it. Slots are given in two levels (ranges of the
    order, then rows of a range), so no task numbers the whole table. Where a column already holds unique numbers in
    insertion order, name it as slot: then nothing is shuffled.
    """
    e = F.col("embedding").cast("array<float>")
    if dim is not None:
        e = F.when(F.size(e) == dim, e).otherwise(F.raise_error(F.lit(f"an embedding hasn't {dim} dimensions")).cast("array<float>"))
    out = rows.select(
        F.col(slot or order).alias("__order"),
        F.col("id").cast("long").alias("id"),
        e.alias("embedding"),
        (F.col("metadata") if "metadata" in rows.columns else F.lit("")).alias("metadata"),
        (F.col("deleted") if "deleted" in rows.columns else F.lit(False)).alias("deleted"),
    )
    if slot is not None:
        return out.withColumn("slot", F.col("__order").cast("long")).select(*VECTORS.fieldNames())
    return numbered(out, "__order", start=start).drop("__order").select(*VECTORS.fieldNames())


def numbered(rows: DataFrame, *order: str, name: str = "slot", start: int = 0) -> DataFrame:
    """rows with dense numbers from start in the given order, which should be total.

    Rows are dealt into ranges of the order, of whatever type its columns are, and written once; they are counted there
    and numbered inside their range.
    """
    dealt = materialise(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "numbered")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over one count a range
    starts = dealt.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__part").orderBy(*order)
    out = dealt.withColumn("__nth", F.row_number().over(inside)).join(F.broadcast(starts), "__part")
    return out.withColumn(name, (F.col("__start") + F.col("__nth") - 1 + F.lit(start)).cast("long")).drop("__part", "__nth", "__start")
