"""The registered queries of the vector engine and their SQL equivalents.

Metadata is derived from vec_id i: year 2018 + i % 7, one of five categories by i % 5, score 0.1 * (i % 10); Spark makes
JSON of it and filters through the predicate compiler, the SQL uses typed columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vexel.functions import vectors as V
from vexel.functions import table as table_function
from vexel.index import Index
from vexel.operators import graph, lifecycle
from vexel.operators.graph import GraphIndex
from vexel.operators.ivf import IvfIndex
from vexel.operators.search import knn, knn_join
from vexel.plans import metrics
from vexel.plans.predicate import compile_where
from vexel.plans.storage import materialise, read_table, shared_path
from vexel.schema import Config, vector_table
from vexel.sources import files
from vexel.streaming.oplog import apply_log

Query = Callable[[SparkSession, str], DataFrame]

CATEGORIES = ("science", "tech", "art", "history", "sports")
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BASE = """WITH t AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, 2018 + vec_id % 7 AS year, 0.1::DOUBLE * (vec_id % 10) AS points,
         ['science', 'tech', 'art', 'history', 'sports'][CAST(vec_id % 5 + 1 AS BIGINT)] AS category
  FROM embeddings
)"""


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    meta = F.struct(
        (F.lit(2018) + i % 7).alias("year"),
        F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (i % 5 + 1).cast("int")).alias("category"),
        (F.lit(0.1) * (i % 10)).alias("score"),
    )
    return vector_table(read_table(spark, sf_dir, "embeddings").select(i.alias("id"), "embedding", F.to_json(meta).alias("metadata")), slot="id")


def vector(spark: SparkSession, sf_dir: str, i: int = 0) -> list[float]:
    found = read_table(spark, sf_dir, "embeddings").where(F.col("vec_id") == i).select("embedding").first()
    return [float(x) for x in found.embedding]


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set: every row whose id is divisible by 100."""
    return _asked(spark, sf_dir, F.col("vec_id") % 100 == 0)


def asked_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a recall gate: every row whose id is divisible by 10."""
    return _asked(spark, sf_dir, F.col("vec_id") % 10 == 0)


def _asked(spark: SparkSession, sf_dir: str, which: F.Column) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").where(which).select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("v"))


def r6(c) -> F.Column:
    return (F.round(c, 6) + F.lit(0.0)).alias("score")


def listed(hits: DataFrame) -> DataFrame:
    """rank, id, score of one query's few hits."""
    order = Window.orderBy(F.desc("score"), "slot")
    return hits.withColumn("rank", F.row_number().over(order).cast("long")).select("rank", "id", r6(F.col("score")))


def per_query(hits: DataFrame) -> DataFrame:
    return hits.select("qid", "rank", "id", r6(F.col("score")))


COS = "list_cosine_similarity(t.e, q.e)"


def knn_sql(where: str = "true", k: int = 10, score: str = COS, query: int = 0) -> str:
    return f"""{BASE}, s AS (
  SELECT t.id, {score} AS s FROM t, (SELECT e FROM t WHERE id = {query}) q WHERE {where}
)
SELECT row_number() OVER (ORDER BY s DESC, id) AS rank, id, round(s, 6) + 0.0 AS score FROM s ORDER BY s DESC, id LIMIT {k}"""


def join_sql(k: int, where: str = "true", score: str = COS) -> str:
    return f"""{BASE}, s AS (
  SELECT q.id AS qid, t.id, {score} AS s FROM t, t q WHERE q.id % 100 = 0 AND {where}
), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM s)
SELECT qid, rank, id, round(s, 6) + 0.0 AS score FROM r WHERE rank <= {k}"""


L2 = "-list_sum(list_transform(list_zip(t.e, q.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"

# Vector functions, on pairs of neighbouring ids.


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("a"))
    b = read_table(spark, sf_dir, "embeddings").select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("b"))
    return a.join(b, "id")


PAIRS = f"{BASE} SELECT t.id, round({{}}, 6) + 0.0 AS score FROM t JOIN t q ON q.id = t.id + 1"


@register("cosine_pairs", PAIRS.format(COS))
def cosine_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", r6(V.cosine_similarity(F.col("a"), F.col("b"))))


@register("l2_squared_pairs", PAIRS.format(f"-({L2})"))
def l2_squared_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", r6(V.l2_squared(F.col("a"), F.col("b"))))


@register("inner_product_pairs", PAIRS.format("list_inner_product(t.e, q.e)"))
def inner_product_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", r6(V.inner_product(F.col("a"), F.col("b"))))


@register("l2_norms", f"{BASE} SELECT id, round(sqrt(list_inner_product(e, e)), 6) + 0.0 AS score FROM t")
def l2_norms(spark, sf_dir):
    return base(spark, sf_dir).select("id", r6(V.l2_norm(F.col("embedding"))))


@register("normalize_vectors", f"{BASE} SELECT id, i AS place, round(3 * e[i] / sqrt(list_inner_product(list_transform(e, lambda x: 3 * x), list_transform(e, lambda x: 3 * x))), 6) + 0.0 AS score FROM t, range(1, 65) r(i)")
def normalize_vectors(spark, sf_dir):
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3)
    out = base(spark, sf_dir).select("id", F.posexplode(V.normalize(scaled)).alias("place", "x"))
    return out.select("id", (F.col("place") + 1).cast("long").alias("place"), r6(F.col("x")))


@register("cosine_zero_vector", """SELECT vec_id AS id, 0.0::DOUBLE AS score FROM embeddings""")
def cosine_zero_vector(spark, sf_dir):
    zero = F.transform(F.col("embedding"), lambda x: x * 0)
    return base(spark, sf_dir).select("id", r6(V.cosine_similarity(F.col("embedding"), zero)))


@register("sql_functions", PAIRS.format(f"{COS} + list_inner_product(t.e, q.e) - ({L2})"))
def sql_functions(spark, sf_dir):
    V.register(spark)
    return _pairs(spark, sf_dir).select("id", r6(F.expr("cosine_similarity(a, b) + inner_product(a, b) + l2_squared(a, b)")))


# Search with one query.


@register("knn_exact_top10", knn_sql())
def knn_exact_top10(spark, sf_dir):
    return listed(knn(base(spark, sf_dir), vector(spark, sf_dir), 10))


@register("knn_l2_top10", knn_sql(score=L2))
def knn_l2_top10(spark, sf_dir):
    return listed(knn(base(spark, sf_dir), vector(spark, sf_dir), 10, metric="l2"))


@register("knn_k_exceeds_n", knn_sql(where="t.id < 7", k=10))
def knn_k_exceeds_n(spark, sf_dir):
    return listed(knn(base(spark, sf_dir).where("id < 7"), vector(spark, sf_dir), 10))


@register("knn_k0", knn_sql(k=0))
def knn_k0(spark, sf_dir):
    return listed(knn(base(spark, sf_dir), vector(spark, sf_dir), 0))


@register("knn_table_function", knn_sql(k=5))
def knn_table_function(spark, sf_dir):
    table_function.register(spark)
    base(spark, sf_dir).createOrReplaceTempView("vexel_table")
    query = ", ".join(f"{x!r}D" for x in vector(spark, sf_dir))
    return listed(spark.sql(f"SELECT * FROM knn(TABLE(vexel_table) WITH SINGLE PARTITION, array({query}), 5)"))


# Filters.


def _filtered(where: dict) -> Query:
    return lambda spark, sf_dir: base(spark, sf_dir).where(compile_where(where, F.col("metadata"))).select("id")


for _name, _where, _sql in (
    ("eq", {"category": {"$eq": "science"}}, "category = 'science'"),
    ("ne", {"category": {"$ne": "science"}}, "category <> 'science'"),
    ("gt", {"score": {"$gt": 0.5}}, "points > 0.5::DOUBLE"),
    ("gte", {"year": {"$gte": 2022}}, "year >= 2022"),
    ("lt", {"score": {"$lt": 0.3}}, "points < 0.3::DOUBLE"),
    ("lte", {"year": {"$lte": 2019}}, "year <= 2019"),
    ("in", {"category": {"$in": ["art", "tech"]}, "year": {"$in": [2018, 2020.0]}}, "category IN ('art', 'tech') AND year IN (2018, 2020)"),
    ("nin", {"category": {"$nin": ["art", 5]}}, "category <> 'art'"),
    ("bare", {"year": 2020}, "year = 2020"),
    ("exists", {"year": {}}, "true"),
    ("missing_field", {"absent": {"$ne": 1}}, "false"),
    ("composite", {"year": {"$gte": 2019, "$lt": 2022}, "category": {"$nin": ["art"]}, "score": {"$lte": 0.6}}, "year >= 2019 AND year < 2022 AND category <> 'art' AND points <= 0.6::DOUBLE"),
    ("type_mismatch", {"category": {"$lt": 5}, "year": {"$ne": "2020"}}, "true"),
):
    register(f"filter_{_name}", f"{BASE} SELECT id FROM t WHERE {_sql}")(_filtered(_where))

# Verdicts by hand, one row per metadata and clause: types that don't match, booleans and null, and texts that aren't
# JSON objects.
VERDICTS: dict[str, list[tuple[str | None, dict, bool]]] = {
    "filter_mixed_types": [
        ('{"v": 1}', {"v": 1.0}, True), ('{"v": 1.0}', {"v": {"$gte": 1}}, True), ('{"v": "1"}', {"v": 1}, False),
        ('{"v": "1"}', {"v": {"$ne": 1}}, True), ('{"v": "1"}', {"v": {"$lt": 1}}, True), ('{"v": "1"}', {"v": {"$gt": 1}}, False),
        ('{"v": "2022"}', {"v": {"$gte": 2000}}, False), ('{"v": [1, 2]}', {"v": [1, 2]}, True), ('{"v": [1, 2]}', {"v": {"$lte": [2]}}, True),
        ('{"v": {"a": 1}}', {"v": {"$in": [{"a": 1}]}}, True), ('{"v": "b"}', {"v": {"$gt": "a"}}, True), ('{"v": 5}', {"v": {"$in": 5}}, False),
        ('{"v": 5}', {"v": {"$nin": 5}}, True), ('{"v": 5}', {"v": {"$in": ["5", 5.0]}}, True), ('{"a.b": 3}', {"a.b": 3}, True), ('{"a": {"b": 3}}', {"a.b": 3}, False),
    ],
    "filter_bool_null": [
        ('{"v": true}', {"v": True}, True), ('{"v": true}', {"v": {"$lt": False}}, True), ('{"v": false}', {"v": {"$lt": True}}, True),
        ('{"v": true}', {"v": {"$gte": True}}, True), ('{"v": true}', {"v": {"$gt": False}}, False), ('{"v": true}', {"v": 1}, False),
        ('{"v": null}', {"v": None}, True), ('{"v": null}', {"v": {"$lt": 5}}, True), ('{"v": null}', {"v": {"$ne": None}}, False),
        ('{"v": null}', {"v": {}}, True), ("{}", {"v": {}}, False), ("{}", {"v": None}, False), ("{}", {"v": {"$nin": [1]}}, False),
    ],
    "filter_bad_json": [
        ("", {"v": {}}, False), ("not json", {"v": {"$ne": 1}}, False), ("[1]", {"v": {}}, False), ("5", {"v": {}}, False), (None, {"v": {}}, False), ('{"v": 1', {"v": 1}, False),
    ],
}


def _verdicts(cases: list[tuple[str | None, dict, bool]]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.createDataFrame([(i, m) for i, (m, _, _) in enumerate(cases)], "case_id long, metadata string")
        verdict = F.lit(False)
        for i, (_, where, _) in enumerate(cases):
            verdict = F.when(F.col("case_id") == i, compile_where(where, F.col("metadata"))).otherwise(verdict)
        return rows.select("case_id", verdict.cast("int").alias("passes"))

    return run


for _name, _cases in VERDICTS.items():
    register(_name, "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {int(v)})" for i, (_, _, v) in enumerate(_cases)) + ") v(case_id, passes)")(_verdicts(_cases))


@register("filter_events_props", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k')::DOUBLE >= 10 AND json_extract_string(props, '$.k')::DOUBLE < 50")
def filter_events_props(spark, sf_dir):
    return read_table(spark, sf_dir, "events").where(compile_where({"k": {"$gte": 10, "$lt": 50}}, F.col("props"))).select("event_id")


FILTER = {"category": {"$in": ["science", "tech"]}, "year": {"$gte": 2020}}
FILTER_SQL = "t.category IN ('science', 'tech') AND t.year >= 2020"


@register("knn_prefilter", knn_sql(where=FILTER_SQL))
def knn_prefilter(spark, sf_dir):
    return listed(knn(base(spark, sf_dir), vector(spark, sf_dir), 10, FILTER))


@register("knn_postfilter_4x", f"""{BASE}, s AS (
  SELECT t.*, {COS} AS s FROM t, (SELECT e FROM t WHERE id = 0) q ORDER BY s DESC, id LIMIT 40
)
SELECT row_number() OVER (ORDER BY s DESC, id) AS rank, id, round(s, 6) + 0.0 AS score FROM s t WHERE {FILTER_SQL} ORDER BY s DESC, id LIMIT 10""")
def knn_postfilter_4x(spark, sf_dir):
    return listed(knn(base(spark, sf_dir), vector(spark, sf_dir), 10, FILTER, mode="postfilter"))


@register("knn_udf_filter", knn_sql(where="t.category = 'art'"))
def knn_udf_filter(spark, sf_dir):
    return listed(knn(base(spark, sf_dir), vector(spark, sf_dir), 10, predicate=lambda text: '"art"' in (text or "")))


# Joins of queries with their nearest rows.


@register("knn_join_hof", join_sql(10))
def knn_join_hof(spark, sf_dir):
    return per_query(knn_join(asked(spark, sf_dir), base(spark, sf_dir), 10, method="expression"))


@register("knn_join_gemm", join_sql(10))
def knn_join_gemm(spark, sf_dir):
    return per_query(knn_join(asked(spark, sf_dir), base(spark, sf_dir), 10))


@register("knn_join_l2", join_sql(5, score=L2))
def knn_join_l2(spark, sf_dir):
    return per_query(knn_join(asked(spark, sf_dir), base(spark, sf_dir), 5, metric="l2"))


@register("knn_join_filtered", join_sql(5, where=FILTER_SQL))
def knn_join_filtered(spark, sf_dir):
    return per_query(knn_join(asked(spark, sf_dir), base(spark, sf_dir), 5, where=FILTER))


# Deletes and compaction: even ids go.


def _halved(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = base(spark, sf_dir)
    return lifecycle.delete(t, t.where("id % 2 = 0").select("id"))


@register("soft_delete_flags", "SELECT vec_id AS slot, vec_id AS id, CAST(vec_id % 2 = 0 AS INT) AS deleted FROM embeddings")
def soft_delete_flags(spark, sf_dir):
    return _halved(spark, sf_dir).select("slot", "id", F.col("deleted").cast("int").alias("deleted"))


@register("soft_delete_duplicate_ids", "SELECT vec_id AS slot, vec_id % 100 AS id, CAST(vec_id < 50 AS INT) AS deleted FROM embeddings")
def soft_delete_duplicate_ids(spark, sf_dir):
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 100).alias("id"), "embedding")
    t = vector_table(rows, order="vec_id")
    gone = t.where("id < 50").select("id")
    return lifecycle.delete(lifecycle.delete(t, gone), gone).select("slot", "id", F.col("deleted").cast("int").alias("deleted"))


@register("knn_after_delete", knn_sql(where="t.id % 2 = 1"))
def knn_after_delete(spark, sf_dir):
    return listed(knn(_halved(spark, sf_dir), vector(spark, sf_dir), 10))


@register("is_deleted_lookup", "SELECT i AS id, CAST(i % 2 = 0 AND i IN (SELECT vec_id FROM embeddings) AS INT) AS deleted FROM (SELECT 7 * i AS i FROM range(400) r(i))")
def is_deleted_lookup(spark, sf_dir):
    return lifecycle.is_deleted(_halved(spark, sf_dir), spark.range(400).select((F.col("id") * 7).alias("id"))).select("id", F.col("deleted").cast("int").alias("deleted"))


@register("live_size", "SELECT count(*) AS size, count(*) FILTER (vec_id % 2 = 1) AS live_size FROM embeddings")
def live_size(spark, sf_dir):
    return lifecycle.sizes(_halved(spark, sf_dir))


@register("compact_slots", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS slot, vec_id AS id FROM embeddings WHERE vec_id % 2 = 1")
def compact_slots(spark, sf_dir):
    return lifecycle.compact(_halved(spark, sf_dir)).select("slot", "id")


# The operation log: all vectors in order, ids divisible by 3 deleted, ids divisible by 9 inserted again.

LOG_SQL = """WITH n AS (SELECT count(*) AS n FROM embeddings), a AS (
  SELECT vec_id AS slot, vec_id AS id, CAST(vec_id % 3 = 0 AS INT) AS deleted FROM embeddings
  UNION ALL
  SELECT n + row_number() OVER (ORDER BY vec_id) - 1, vec_id, 0 FROM embeddings, n WHERE vec_id % 9 = 0
)"""


def _log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    n = rows.count()
    lines = lifecycle.insert_ops(rows, 0).unionByName(lifecycle.delete_ops(rows.where("id % 3 = 0"), n)).unionByName(lifecycle.insert_ops(rows.where("id % 9 = 0"), 2 * n))
    return materialise(lines, "query-lines"), n  # a log is a stored table


def _flags(t: DataFrame) -> DataFrame:
    return t.select("slot", "id", F.col("deleted").cast("int").alias("deleted"))


@register("oplog_replay", f"{LOG_SQL} SELECT * FROM a")
def oplog_replay(spark, sf_dir):
    return _flags(lifecycle.replay(_log(spark, sf_dir)[0]))


@register("oplog_replay_duplicates", "SELECT * FROM (VALUES (0::BIGINT, 1::BIGINT, 1), (1, 2, 0), (2, 1, 0), (3, 3, 0)) v(slot, id, deleted)")
def oplog_replay_duplicates(spark, sf_dir):
    v = [1.0, 0.0]
    lines = [(0, "insert", 1, v, "{}"), (1, "insert", 2, v, "{}"), (2, "delete", 1, None, None), (3, "insert", 1, v, "{}"), (4, "delete", 1, None, None), (5, "delete", 9, None, None), (6, "other", 2, None, None), (7, "delete", 3, None, None), (8, "insert", 3, v, "{}")]
    return _flags(lifecycle.replay(spark.createDataFrame(lines, lifecycle.OPLOG)))


@register("checkpoint_roundtrip", f"{LOG_SQL} SELECT * FROM a")
def checkpoint_roundtrip(spark, sf_dir):
    lines, n = _log(spark, sf_dir)
    path = shared_path(spark, "query-log")
    lifecycle.append(lines.where(F.col("seq") < n + 5), f"{path}/log")
    lifecycle.checkpoint(spark, f"{path}/snapshot", f"{path}/log")
    lifecycle.append(lines.where(F.col("seq") >= n + 5), f"{path}/log")
    return _flags(lifecycle.recover(spark, f"{path}/snapshot", f"{path}/log"))


@register("snapshot_roundtrip", f"{BASE} SELECT id AS slot, id, year, category, round(e[1], 6) + 0.0 AS score FROM t")
def snapshot_roundtrip(spark, sf_dir):
    path = shared_path(spark, "query-snapshot")
    lifecycle.save(base(spark, sf_dir).where("id < 3"), path)
    lifecycle.save(base(spark, sf_dir), path, dim=64)
    meta = F.from_json("metadata", "year long, category string")
    return lifecycle.load(spark, path, 64).select("slot", "id", meta["year"].alias("year"), meta["category"].alias("category"), r6(F.col("embedding")[0].cast("double")))


@register("oplog_stream", f"{LOG_SQL} SELECT * FROM a")
def oplog_stream(spark, sf_dir):
    lines, n = _log(spark, sf_dir)
    path = shared_path(spark, "query-stream")
    for low, high in ((0, n // 2), (n // 2, n + 3), (n + 3, 10 * n)):
        lifecycle.append(lines.where((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1), f"{path}/log")
        apply_log(spark, f"{path}/log", f"{path}/snapshot", f"{path}/checkpoint", files_per_batch=1000).awaitTermination()
    return _flags(lifecycle.load(spark, f"{path}/snapshot"))


# Graph and cells.


@register("graph_levels", """WITH h AS (
  SELECT vec_id AS id, md5(CAST(vec_id AS VARCHAR)) AS m FROM embeddings
), u AS (
  SELECT id, list_sum(list_transform(range(8), lambda i: (strpos('0123456789abcdef', m[CAST(i + 1 AS BIGINT)]) - 1) * CAST(pow(16, 7 - i) AS BIGINT))) AS h FROM h
)
SELECT id, CAST(floor(-ln((h + 1) / 4294967297.0::DOUBLE) / ln(16)) AS INT) AS level FROM u""")
def graph_levels(spark, sf_dir):
    return base(spark, sf_dir).select("id", graph.level_of(F.col("id"), 16).alias("level"))


EDGES_SQL = f"""{BASE}, e AS (
  SELECT a.id AS src, b.id AS dst, list_cosine_similarity(a.e, b.e) AS sim FROM t a, t b WHERE a.id <> b.id
), f AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS n FROM e)"""


@register("knn_graph_layer0_edges", f"{EDGES_SQL} SELECT src, dst, round(sim, 6) + 0.0 AS score FROM f WHERE n <= 8")
def knn_graph_layer0_edges(spark, sf_dir):
    return graph.nearest_edges(base(spark, sf_dir), 8).select("src", "dst", r6(F.col("sim")))


@register("graph_reverse_shrink", f"""{EDGES_SQL}, d AS (
  SELECT src, dst, sim FROM f WHERE n <= 8 UNION SELECT dst, src, sim FROM f WHERE n <= 8
), g AS (SELECT src, dst, max(sim) AS sim FROM d GROUP BY src, dst), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS n FROM g)
SELECT src, dst, round(sim, 6) + 0.0 AS score FROM r WHERE n <= 10""")
def graph_reverse_shrink(spark, sf_dir):
    near = graph.nearest_edges(base(spark, sf_dir), 8)
    return graph.with_reverse(near, 10).select("src", "dst", r6(F.col("sim")))


# Approximate search. A gate's rows are the exact hits of every query and whether the approximate ones reach the recall.


def gate_sql(where: str = "true") -> str:
    return f"""{BASE}, s AS (
  SELECT q.id AS qid, t.id, {COS} AS s FROM t, t q WHERE q.id % 10 = 0 AND {where}
), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM s)
SELECT qid, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY rank) AS nearest, true AS reached FROM r WHERE rank <= 10 GROUP BY qid"""


def gated(found: DataFrame, exact: DataFrame, least: float) -> DataFrame:
    exact = materialise(exact, "gate-exact")
    recall = metrics.mean_recall(found, exact, 10)
    lists = exact.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "id")))["id"].alias("ids"))  # 10 a query
    return lists.select("qid", F.array_join(F.col("ids").cast("array<string>"), " ").alias("nearest")).crossJoin(F.broadcast(recall.select((F.col("recall") >= least).alias("reached"))))


@register("graph_recall_gate", gate_sql())
def graph_recall_gate(spark, sf_dir):
    t = materialise(base(spark, sf_dir), "gate")
    found = GraphIndex.build(t, Config(M=16)).search(asked_gate(spark, sf_dir), 10, ef=100)
    return gated(found, knn_join(asked_gate(spark, sf_dir), t, 10), 0.9)


@register("graph_after_delete", gate_sql("t.id % 2 = 1"))
def graph_after_delete(spark, sf_dir):
    """Even ids are deleted after the build."""
    t = materialise(base(spark, sf_dir), "gate")
    found = GraphIndex.build(t, Config(M=16)).search(asked_gate(spark, sf_dir), 10, ef=200, gone=t.where("id % 2 = 0"))
    found = materialise(found, "gate-found")
    return gated(found, knn_join(asked_gate(spark, sf_dir), t.where("id % 2 = 1"), 10), 0.9).crossJoin(F.broadcast(found.agg((F.count_if(F.col("id") % 2 == 0) == 0).alias("none")))).where("none").drop("none")


@register("graph_filtered", gate_sql(FILTER_SQL))
def graph_filtered(spark, sf_dir):
    t = materialise(base(spark, sf_dir), "gate")
    found = GraphIndex.build(t, Config(M=16)).search(asked_gate(spark, sf_dir), 10, ef=250, where=FILTER)
    return gated(found, knn_join(asked_gate(spark, sf_dir), t, 10, where=FILTER), 0.9)


@register("graph_insert", gate_sql())
def graph_insert(spark, sf_dir):
    """A third of the rows is linked after the build."""
    t = materialise(base(spark, sf_dir), "gate")
    g = GraphIndex.build(t.where("id % 3 <> 0"), Config(M=16)).insert(t.where("id % 3 = 0"))
    return gated(g.search(asked_gate(spark, sf_dir), 10, ef=100), knn_join(asked_gate(spark, sf_dir), t, 10), 0.9)


@register("paged_graph_search", gate_sql())
def paged_graph_search(spark, sf_dir):
    """The vectors are in a page store, to which a part was appended."""
    files.register(spark)
    t = base(spark, sf_dir).select("slot", "embedding")
    path, n = shared_path(spark, "query-pages"), t.count()
    files.append_pages(t.where(F.col("slot") < n // 2), path, 64)
    files.append_pages(t.where(F.col("slot") >= n // 2), path, 64)
    pages = materialise(files.page_table(spark, path, 64), "gate")
    found = GraphIndex.build(pages, Config(M=16)).search(asked_gate(spark, sf_dir), 10, ef=100)
    return gated(found, knn_join(asked_gate(spark, sf_dir), pages, 10), 0.9)


@register("ivf_after_delete", knn_sql(where="t.id % 2 = 1"))
def ivf_after_delete(spark, sf_dir):
    t = base(spark, sf_dir)
    index = IvfIndex.build(t, shared_path(spark, "ivf"), 8)
    return listed(index.search(vector(spark, sf_dir), 10, 8, gone=t.where("id % 2 = 0")))


@register("ivf_insert", knn_sql())
def ivf_insert(spark, sf_dir):
    t = base(spark, sf_dir)
    index = IvfIndex.build(t.where("id % 3 <> 0"), shared_path(spark, "ivf"), 8)
    index.insert(t.where("id % 3 = 0"))
    return listed(index.search(vector(spark, sf_dir), 10, 8))


@register("index_object", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS slot, vec_id AS id, 0::BIGINT AS log_lines FROM embeddings WHERE vec_id % 7 <> 0")
def index_object(spark, sf_dir):
    """Through an index with a log: insert, delete, compact, load. The compacted log is empty."""
    path = shared_path(spark, "query-index")
    index = Index(spark, 64, log=f"{path}/log")
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index.insert_rows(rows)
    index.delete_ids(rows.where("id % 7 = 0").select("id"))
    index.compact(f"{path}/snapshot")
    again = Index(spark, 64, log=f"{path}/log")
    again.load(f"{path}/snapshot")
    lines = lifecycle.read_log(spark, f"{path}/log").agg(F.count("*").alias("log_lines"))
    return again.table.select("slot", "id").crossJoin(F.broadcast(lines))


@register("ivf_full_probe", knn_sql())
def ivf_full_probe(spark, sf_dir):
    index = IvfIndex.build(base(spark, sf_dir), shared_path(spark, "ivf"), 8)
    return listed(index.search(vector(spark, sf_dir), 10, nprobe=8))


@register("ivf_knn_join_full_probe", join_sql(10))
def ivf_knn_join_full_probe(spark, sf_dir):
    index = IvfIndex.build(base(spark, sf_dir), shared_path(spark, "ivf"), 8)
    return per_query(index.knn_join(asked(spark, sf_dir), 10, nprobe=8))


@register("ann_recall_gate", gate_sql())
def ann_recall_gate(spark, sf_dir):
    t = materialise(base(spark, sf_dir), "gate")
    index = IvfIndex.build(t, shared_path(spark, "ivf"), 16)
    return gated(index.knn_join(asked_gate(spark, sf_dir), 10, nprobe=13), knn_join(asked_gate(spark, sf_dir), t, 10), 0.9)


@register("kmeans_cell_counts", "SELECT 8 AS cells, count(*) AS n FROM embeddings")
def kmeans_cell_counts(spark, sf_dir):
    index = IvfIndex.build(base(spark, sf_dir), shared_path(spark, "ivf"), 8)
    return index.rows.groupBy("cell").agg(F.count("*").alias("n")).agg(F.count("*").cast("int").alias("cells"), F.sum("n").alias("n"))


@register("recall_at_k", join_sql(10)[:-len("SELECT qid, rank, id, round(s, 6) + 0.0 AS score FROM r WHERE rank <= 10")] + """, c AS (
  SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM s WHERE id % 4 <> 1
)
SELECT r.qid, count(c.id) / 10.0::DOUBLE AS recall FROM r LEFT JOIN c ON c.qid = r.qid AND c.id = r.id AND c.rank <= 10 WHERE r.rank <= 10 GROUP BY r.qid""")
def recall_at_k(spark, sf_dir):
    t = base(spark, sf_dir)
    return metrics.recall_at_k(knn_join(asked(spark, sf_dir), t.where("id % 4 <> 1"), 10), knn_join(asked(spark, sf_dir), t, 10), 10)


# Files of other programs.


@register("file_roundtrips", f"{BASE} SELECT id, id AS slot, CAST(id % 2 = 0 AS INT) AS deleted, year, round(3 * e[64], 6) + 0.0 AS score FROM t")
def file_roundtrips(spark, sf_dir):
    """Through an array, an index, and a page file, joined by slot."""
    files.register(spark)
    path = shared_path(spark, "query-files")
    t = _halved(spark, sf_dir).withColumn("level", F.lit(0))
    store, root = files.opened(path)
    store.create_dir(root, recursive=True)
    files.write_npy(t, f"{path}/a.npy", 64)
    files.write_pages(t, f"{path}/p.pages", 64)
    links = t.select(F.lit(0).alias("layer"), F.col("slot").alias("src"), F.when(F.col("slot") > 0, F.col("slot") - 1).otherwise(F.lit(0)).alias("dst"))
    files.write_index(t, links, f"{path}/i.idx", 64, 0, 0)
    n = t.count()
    a = spark.read.format("npy").load(f"{path}/a.npy").select(F.col("id").alias("slot"), F.col("embedding")[63].cast("double").alias("a"))
    p = spark.read.format("vector_pages").option("dim", 64).option("count", n).load(f"{path}/p.pages").select("slot", F.col("embedding")[63].cast("double").alias("p"))
    i = spark.read.format("vector_index").load(f"{path}/i.idx")
    year = F.from_json("metadata", "year long")["year"]
    out = i.join(a, "slot").join(p, "slot")
    return out.select("id", "slot", F.col("deleted").cast("int").alias("deleted"), year.alias("year"), r6(F.col("a") + F.col("p") + F.col("embedding")[63].cast("double")))


@register("log_file_roundtrip", f"{LOG_SQL} SELECT * FROM a")
def log_file_roundtrip(spark, sf_dir):
    files.register(spark)
    path = shared_path(spark, "query-wal")
    store, root = files.opened(path)
    store.create_dir(root, recursive=True)
    files.write_log(_log(spark, sf_dir)[0], f"{path}/log.bin")
    return _flags(lifecycle.replay(spark.read.format("vector_log").load(f"{path}/log.bin")))


@register("synthetic_vectors", "SELECT i AS id, 1.0::DOUBLE AS score FROM range(200) r(i)")
def synthetic_vectors(spark, sf_dir):
    return files.generate(spark, 200, 32).select("id", r6(F.round(V.l2_norm(F.col("embedding")), 5)))
