"""Connected components by contraction, and picking rows by their identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vexel.plans.storage import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every end of an edge (a, b), bigint; label is one of the component's nodes.

    Each round every node moves to its smallest neighbour, if that is smaller, and edges are redrawn between the new
    places; at most half of a component's places survive, so rounds are logarithmic in its size. Minima are
    combined before they are shuffled and no neighbour list is gathered, so a node with very many edges costs no more
    than others. Every round's tables are written to the shared folder.
    """
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node"))
    while not edges.isEmpty():
        lower = edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("to"))  # a < b: only b can move down
        labels = materialise(labels.join(lower, F.col("label") == F.col("v"), "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        moved = edges.join(lower, F.col("b") == F.col("v")).select("a", F.col("to").alias("b"))
        below = lower.select(F.col("v").alias("w"), F.col("to").alias("at"))
        moved = moved.join(below, F.col("a") == F.col("w"), "left").select(F.coalesce("at", "a").alias("a"), "b").where("a <> b")
        edges = materialise(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return labels


def whole(docs: DataFrame) -> Column:
    """A row of docs as one value, so that no column made beside it can clash with its columns."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def beside(docs: DataFrame, *named: str) -> Column:
    """What a row has besides the named columns, as text: orders rows that are alike in those."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in named]
    return F.to_json(F.struct(*rest)) if rest else F.lit("")


def rows_of(docs: DataFrame, chosen: DataFrame, own: Column, key: str, text: str) -> DataFrame:
    """The rows of docs whose key and content digest (own) are in chosen (id, own). Of rows alike in both, one: the first
    by its other columns, then its text, so the choice doesn't depend on how rows are dealt."""
    held = docs.select(whole(docs).alias("row"), F.col(f"`{key}`").alias("k"), own.alias("own"), beside(docs, key, text).alias("rest"))
    stays = chosen.select(F.col("id"), F.col("own").alias("sha"))
    met = held.join(stays, F.col("k").eqNullSafe(F.col("id")) & (F.col("own") == F.col("sha")), "left_semi")
    first = Window.partitionBy("k", "own").orderBy("rest", F.col("row").getField(text))
    return met.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("row.*")
