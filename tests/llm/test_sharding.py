import zlib

from pyspark.sql import functions as F

from vexel.llm.sharding import jump_hash, shard_by_key

SCHEMA = "doc_id long, text string, shard int, k string"


def reference(key: int, n: int) -> int:
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_equals_published_walk(spark):
    keys = [0, 1, 2, 42, 0xDEAD10CC, 2**31, 2**32 + 5, 2**63 - 1, -1, -(2**63), -12345, *range(100, 400)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 8, 9, 57):
        got = {r.k: r.s for r in df.select("k", jump_hash(F.col("k"), n).alias("s")).collect()}
        assert got == {k: reference(k, n) for k in keys}
    assert reference(42, 57) == 43 and reference(0xDEAD10CC, 666) == 361


def test_slots_and_odd_rows(spark):
    rows = [(i, "x" * (i % 7), 0, "a") for i in range(500)] + [(3, None, 1, None), (None, "é", 2, "b"), (None, None, 3, "c"), (3, "", 4, "d"), (3, "", 4, "d")]
    got = shard_by_key(spark.createDataFrame(rows, SCHEMA), 8).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 8) and r.shard == reference(r.doc_id or 0, 8) and r.law == "key"
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    key = lambda d, z, c: (d is None, d or 0, z, c)
    want = sorted(key(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert sorted(key(r.doc_id, r.size, r.text_crc32) for r in got) == want


def test_empty(spark):
    assert shard_by_key(spark.createDataFrame([], SCHEMA), 8).count() == 0
