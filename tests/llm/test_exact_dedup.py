import hashlib
import re

from pyspark.sql import functions as F

from vexel.llm import exact_dedup as ed

SCHEMA = "doc_id long, text string, digest string, id int"


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for d, t in rows:
        groups.setdefault(norm(t), []).append(d)
    out = []
    for d, t in rows:
        g = groups[norm(t)]
        keep = min((x for x in g if x is not None), default=None)
        out.append((d, keep, len(g), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str), len(groups)


ROWS = [(5, "a  b"), (3, "a b"), (9, "a\t\nb"), (9, "a\t\nb"), (4, " a b"), (1, None), (2, ""), (7, "\u00a0"), (8, " "), (None, "x"), (None, "x"), (6, "long " * 100_000), (10, "long " * 100_000), (11, "a\x1cb"), (3, "other"), (3, "a b")]


def check(spark, got, rows):
    want, n = brute(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == n == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_equals_brute_force(spark):
    df = spark.createDataFrame([(*r, "d", 1) for r in ROWS], SCHEMA)
    check(spark, ed.dedup(df).collect(), ROWS)
    kept = ed.keep_first(df)
    assert kept.columns == df.columns and kept.count() == brute(ROWS)[1]
    assert ed.dedup(df.limit(0)).count() == 0 and ed.keep_first(df.limit(0)).count() == 0


def test_weak_digest_never_merges(spark):
    df = spark.createDataFrame([(*r, "d", 1) for r in ROWS], SCHEMA)
    for limit in (10**6, 0):
        got = ed.group(df, lambda t: F.lit("same"), broadcast_rows=limit)
        out = got.select(F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("locator") == F.col("keep_at")).alias("kept"), "text_sha256").collect()
        check(spark, out, ROWS)


def test_state_goes_on_over_batches(spark, tmp_path):
    lines = [(d, "k" + str(d % 3), d) for d in range(20, 0, -1)]
    path = f"{tmp_path}/lines"
    df = spark.createDataFrame(lines, "id long, digest string, locator long")
    df.limit(12).repartition(4).write.parquet(path)
    ed.run_stream(spark, path, df.schema, f"{tmp_path}/c", f"{tmp_path}/s", files_per_batch=1)
    df.exceptAll(df.limit(12)).coalesce(2).write.mode("append").parquet(path)
    ed.run_stream(spark, path, df.schema, f"{tmp_path}/c", f"{tmp_path}/s", files_per_batch=1)
    got = sorted((r.digest, r.keep_id, r.group_size) for r in ed.latest_state(spark, f"{tmp_path}/s", "long").collect())
    assert got == [("k0", 3, 6), ("k1", 1, 7), ("k2", 2, 7)]


def test_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, ed.dedup(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])
