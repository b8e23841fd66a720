"""Jump consistent hashing of stable keys to shards, in column expressions only.

The walk is that of Lamping and Veach (2014): a 64-bit linear congruential generator, seeded by the key, yields
the next shard count at which the key would move; the last such count under the number of shards is its shard.
There is no ring table, and one more shard takes rows only into itself (a share of 1 / (n + 1)).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values of the published algorithm.
MULTIPLIER = 2862933555777941757
LOW32 = 0xFFFFFFFF
LOW16 = 0xFFFF

#: Blocks of rows inside a shard that are numbered apart: bounds the table of block offsets at n_shards x BLOCKS rows.
BLOCKS = 4096


def _times32(a: Column, b: int) -> Column:
    """a * b modulo 2**32 for 0 <= a, b < 2**32, with no intermediate above 2**49 (ANSI mode forbids wrapping)."""
    low = a.bitwiseAND(LOW16) * F.lit(b)
    high = (F.shiftright(a, 16) * F.lit(b)).bitwiseAND(LOW16)
    return (low + F.shiftleft(high, 16)).bitwiseAND(LOW32)


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """One step of the generator on a 64-bit state held as two 32-bit halves."""
    mh, ml = MULTIPLIER >> 32, MULTIPLIER & LOW32
    p0 = lo.bitwiseAND(LOW16) * F.lit(ml)
    p1 = F.shiftright(lo, 16) * F.lit(ml) + F.shiftright(p0, 16)
    low = F.shiftleft(p1.bitwiseAND(LOW16), 16) + p0.bitwiseAND(LOW16) + F.lit(1)
    carry = F.shiftright(p1, 16) + F.shiftright(low, 32)
    high = carry + _times32(hi, ml) + _times32(lo, mh)
    return high.bitwiseAND(LOW32), low.bitwiseAND(LOW32)


def jump_hash(key: Column, n_shards: int) -> Column:
    """Shard of a bigint key among n_shards (an int column); a null key goes where key 0 goes."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"),
        F.shiftrightunsigned(key, 32).bitwiseAND(LOW32).alias("hi"), key.bitwiseAND(LOW32).alias("lo"),
    )

    def walk(s: Column, _: Column) -> Column:
        hi, lo = _step(s["hi"], s["lo"])
        scale = F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + F.lit(1)).cast("double")
        ahead = F.floor((s["j"] + F.lit(1)).cast("double") * scale).cast("long")
        moved = F.struct(s["j"].alias("b"), ahead.alias("j"), hi.alias("hi"), lo.alias("lo"))
        return F.when(s["j"] < F.lit(n_shards), moved).otherwise(s)

    # each step advances j by one at least, so n_shards steps are enough
    return F.aggregate(F.sequence(F.lit(1), F.lit(n_shards)), start, walk, lambda s: s["b"].cast("int"))


def shard_by_key(docs: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text", blocks: int = BLOCKS) -> DataFrame:
    """One row per row of docs: key, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 length plus 1. The key and the shard count alone decide the shard; grown_shard is the shard
    with one more. Slots count from 0 without gaps in each shard. They are dealt in two levels so that no task
    holds a shard: rows are numbered inside (shard, block of hashed keys), and a block starts after the rows of
    the blocks before it. The table of block starts has at most n_shards x blocks rows, whatever the input.

    Null text: size 1, checksum 0. Null key: as key 0. Repeated rows: each gets a slot. Empty table: no rows.
    Columns other than key and text are not read.
    """
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    block = F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")
    placed = rows.select(
        "k",
        (F.octet_length(F.coalesce("t", F.lit(""))).cast("long") + F.lit(1)).alias("size"),
        F.crc32(F.coalesce("t", F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        jump_hash(F.col("k"), n_shards).alias("shard"), jump_hash(F.col("k"), n_shards + 1).alias("grown_shard"),
        block.alias("block"),
    )
    counts = rows.select(jump_hash(F.col("k"), n_shards).alias("shard"), block.alias("block")).groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "block").orderBy("k", "text_crc32", "size")
    numbered = placed.withColumn("nth", F.row_number().over(inside))
    return numbered.join(F.broadcast(starts), ["shard", "block"]).select(
        F.col("k").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("nth") - F.lit(1)).cast("long").alias("slot"), "grown_shard",
    )
