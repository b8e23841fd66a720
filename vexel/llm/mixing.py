"""Mixing sources to target weights by fitting word budgets exactly.

Documents are counted by source and exact length. A source's budget is its target; as many whole copies of the source
as fit are taken, and the rest is filled from the counts: an even share of every length, then by bounded-knapsack
dynamic programming over the counts that are left, which finds the sum nearest to the remainder. The programme works on
a window of the remainder, long lengths having been taken up to there; while it doesn't meet the remainder as nearly
as the lengths' divisor allows, the window grows, at last to the whole remainder, so the sum is always the nearest.
Which documents of a length are taken follows from a seeded hash of their identifiers.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vexel.llm.components import beside, whole
from vexel.plans.storage import materialise

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: A source is repeated this many times at most.
MOST = 3
#: Words of the remainder that the dynamic programme's first window has.
WINDOW_WORDS = 1 << 13
#: Hash ranges in which the documents of one source and length are ranked apart.
RANGES = 1024


def n_words(text: Column) -> Column:
    """Runs of anything but ASCII white space; null has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(plain, " +"), lambda w: w != "")).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, most: float = MOST) -> list[float]:
    """Each source's share of all words by its weight, none above most times its size; what is cut off goes to the
    others by weight until none is above."""
    n = len(sizes)
    w = np.array([weights[i % len(weights)] for i in range(n)], float)
    cap = np.array(sizes, float) * most
    out = np.zeros(n)
    free = np.ones(n, bool)
    left = float(sum(sizes))
    while free.any():
        share = np.where(free, w * left / w[free].sum(), 0.0)
        above = free & (share > cap)
        if not above.any():
            out[free] = share[free]
            break
        out[above] = cap[above]
        left -= cap[above].sum()
        free &= ~above
    return [float(x) for x in out]


def knapsack(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many of each length to take so that the sum is the nearest to budget that is reachable.

    Sums are bits of an integer. Counts are split into powers of two, so a length with count c costs log c shifts;
    sums up to budget plus the largest length are kept, which includes the nearest from above.
    """
    if budget <= 0 or not lengths:
        return [0] * len(lengths)
    top = budget + max(lengths)
    mask = (1 << (top + 1)) - 1
    items: list[tuple[int, int]] = []  # (index of the length, how many at once)
    for i, (length, c) in enumerate(zip(lengths, counts, strict=True)):
        c = min(c, top // length) if length > 0 else 0
        k = 1
        while c > 0:
            items.append((i, min(k, c)))
            c -= min(k, c)
            k *= 2
    reached = [1]
    for i, k in items:
        now = reached[-1]
        reached.append((now | (now << (lengths[i] * k))) & mask)
        if (reached[-1] >> budget) & 1:
            break
    sums = reached[-1]
    below = (sums & ((1 << (budget + 1)) - 1)).bit_length() - 1
    above = sums >> budget
    over = budget + ((above & -above).bit_length() - 1) if above else None
    at = over if over is not None and over - budget < budget - below else below
    taken = [0] * len(lengths)
    for step in range(len(reached) - 1, 0, -1):
        if not (reached[step - 1] >> at) & 1:
            i, k = items[step - 1]
            taken[i] += k
            at -= lengths[i] * k
    return taken


def fill(lengths: Sequence[int], counts: Sequence[int], target: float) -> tuple[int, list[int]]:
    """Whole copies of all documents, and of each length how many documents get one copy more."""
    size = sum(a * b for a, b in zip(lengths, counts, strict=True))
    if size <= 0:
        return 0, [0] * len(lengths)
    budget = int(round(target))
    copies, left = divmod(budget, size)
    extra = [0] * len(lengths)
    if left <= 0:
        return copies, extra
    # An even share of every length, rounded down, so that the mix keeps the source's lengths ...
    for i, (length, c) in enumerate(zip(lengths, counts, strict=True)):
        if length > 0:
            extra[i] = c * left // size
    rest = left - sum(a * b for a, b in zip(lengths, extra, strict=True))
    # ... and the remainder from what is left of the counts.
    more = _approach(lengths, [c - e for c, e in zip(counts, extra, strict=True)], rest)
    extra = [a + b for a, b in zip(extra, more, strict=True)]
    over = sum(a * b for a, b in zip(lengths, extra, strict=True)) - left
    if over > 0:  # a very long document came in: others may go for it
        less = _approach(lengths, extra, over)
        if abs(over - sum(a * b for a, b in zip(lengths, less, strict=True))) < over:
            extra = [a - b for a, b in zip(extra, less, strict=True)]
    return copies, extra


def _approach(lengths: Sequence[int], counts: Sequence[int], rest: int) -> list[int]:
    """How many of each length bring the sum as near to rest as any do."""
    divisor = gcd(*[x for x, c in zip(lengths, counts, strict=True) if c > 0])
    least = min(rest % divisor, -rest % divisor) if divisor else rest  # no sum is nearer than that
    width = WINDOW_WORDS
    while True:
        taken = _windowed(lengths, counts, rest, width)
        if width >= rest or abs(rest - sum(a * b for a, b in zip(lengths, taken, strict=True))) == least:
            return taken
        width *= 8


def _windowed(lengths: Sequence[int], counts: Sequence[int], rest: int, width: int) -> list[int]:
    """Long lengths until width words are left, then the programme."""
    taken = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if rest <= width:
            break
        if lengths[i] > 0:
            taken[i] = min(counts[i], max(0, rest - width // 2) // lengths[i])
            rest -= taken[i] * lengths[i]
    # a length of twice the remainder or more is no nearer than none
    open_ = [i for i in range(len(lengths)) if 0 < lengths[i] < 2 * rest and counts[i] > taken[i]]
    for i, k in zip(open_, knapsack([lengths[i] for i in open_], [counts[i] - taken[i] for i in open_], rest), strict=True):
        taken[i] += k
    return taken


def mix(docs: DataFrame, seed: int = 0, weights: Sequence[float] = WEIGHTS, most: int = MOST, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of docs: key, size, source_size, target, taken.

    Sources are ordered by code point, null last, and get the weights in turn. taken is the document's size times
    its copies; it is 0, or at most most times the size. What leaves the executors is one row per source, and the
    lengths' counts stay on them: a task holds one source's distinct lengths. The documents of one source and length
    are ranked within ranges of their hash, so that a source and length with a third of all rows is no single task.

    Null text: size 0, never taken. Null source: a source of its own. Null keys and repeated rows are documents like
    others; equal keys rank as they come, with equal result. Empty table: no rows. Other columns are not read.
    """
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{source}`").cast("string").alias("s"), n_words(F.col(f"`{text}`")).alias("size"))
    return _plan(materialise(rows, "mix-sizes"), seed, weights, most).select(
        F.col("k").alias(key), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def _plan(rows: DataFrame, seed: int, weights: Sequence[float], most: int) -> DataFrame:
    """rows (k, s, size and any others) with source_size, target and copies."""
    spark = rows.sparkSession
    light = rows.select("k", "s", "size")
    counts = light.groupBy("s", "size").agg(F.count("*").alias("n"))
    sources = sorted(counts.groupBy("s").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect(), key=lambda r: (r.s is None, (r.s or "").encode()))
    goal = targets([int(r.words) for r in sources], weights, most)
    budgets = spark.createDataFrame(
        [(r.s, int(r.words), t) for r, t in zip(sources, goal, strict=True)],
        T.StructType([T.StructField("s", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())]),
    )

    def chosen(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size", ascending=False)
        copies, extra = fill([int(x) for x in group["size"]], [int(x) for x in group["n"]], float(group["target"].iloc[0]))
        return pd.DataFrame({"s": group["s"], "size": group["size"], "source_size": group["source_size"], "target": group["target"], "whole": copies, "extra": extra})

    with_goal = counts.join(budgets, counts.s.eqNullSafe(budgets.s)).select(counts.s, "size", "n", "source_size", "target")
    quota = with_goal.groupBy("s").applyInPandas(chosen, "s string, size long, source_size long, target double, whole long, extra long")
    hashed = F.xxhash64(F.col("k").cast("string"), F.lit(seed))
    part = F.pmod(hashed, F.lit(RANGES)).cast("int")
    # Ranks: those of a range start after the rows of the ranges before it.
    held = light.select("s", "size", part.alias("part")).groupBy("s", "size", "part").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("s", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = held.select("s", "size", "part", "m", before.alias("start"))
    q = quota.select(F.col("s").alias("qs"), F.col("size").alias("qz"), "source_size", "target", "whole", "extra")
    limits = starts.join(q, F.col("s").eqNullSafe(F.col("qs")) & (F.col("size") == F.col("qz"))).select(
        F.col("s").alias("ls"), F.col("size").alias("lz"), F.col("part").alias("lp"), "source_size", "target", "whole", F.greatest(F.lit(0), F.col("extra") - F.col("start")).alias("room")
    )
    ranked = rows.withColumn("part", part).withColumn("nth", F.row_number().over(Window.partitionBy("s", "size", "part").orderBy(hashed, F.col("k"))))
    met = ranked.join(limits, F.col("s").eqNullSafe(F.col("ls")) & (F.col("size") == F.col("lz")) & (F.col("part") == F.col("lp")))
    copies = F.col("whole") + (F.col("nth") <= F.col("room")).cast("long")
    # a target of exactly most copies may round up; the limit holds for every document
    return met.select(*rows.columns, "source_size", "target", F.when(F.col("size") > 0, F.least(copies, F.lit(most).cast("long"))).otherwise(F.lit(0).cast("long")).alias("copies"))


def take(docs: DataFrame, seed: int = 0, weights: Sequence[float] = WEIGHTS, most: int = MOST, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, with their own columns of any names.

    Null and empty texts are never taken. Rows alike in key, source and size share their copies; which of them get one more
    follows from their texts and other columns. Empty table: no rows.
    """
    k, s, size = F.col(f"`{key}`"), F.col(f"`{source}`").cast("string"), n_words(F.col(f"`{text}`"))
    light = materialise(docs.select(k.alias("k"), s.alias("s"), size.alias("size")), "mix-sizes")

    def ident(k: Column, s: Column, size: Column) -> Column:
        return F.to_json(F.struct(k.alias("k"), s.alias("s"), size.alias("n")))

    plan = _plan(light, seed, weights, most).groupBy(ident(F.col("k"), F.col("s"), F.col("size")).alias("ident")).agg(F.sum("copies").alias("copies"), F.count("*").alias("same"))
    held = docs.select(whole(docs).alias("row"), ident(k, s, size).alias("ident"), beside(docs, key, source, text).alias("rest"))
    met = held.join(plan.where("copies > 0"), "ident")
    # the join has already brought rows alike together
    nth = F.row_number().over(Window.partitionBy("ident").orderBy(F.col("row").getField(text), "rest"))
    times = F.floor(F.col("copies") / F.col("same")) + (F.col("nth") <= F.col("copies") % F.col("same")).cast("long")
    each = met.withColumn("nth", nth).withColumn("times", times).where("times > 0")
    return each.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy")).select("row.*")
