"""An index object over the operators: insert, delete, search, compact, save, load, with an operation log if wanted.

Inserts add files to a folder of rows and deletes add slots to another, so neither rewrites what is there; compaction
makes one table of both. Approximate structures are of the rows at the time of their build. Rows inserted since are
searched exactly beside them until update() or the next build takes them in, and deletes show at once.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.operators import blocks, lifecycle
from vexel.operators.graph import GraphIndex
from vexel.operators.ivf import IvfIndex
from vexel.operators.search import knn, knn_join
from vexel.plans.storage import materialise, shared_path, written_at
from vexel.schema import VECTORS, Config, check_metric, vector_table

#: Single inserts that are held before they become files together.
HELD = 10_000


class Index:
    """Vectors of one dimension with JSON metadata.

    Search is exact by default; ``build("ivf")`` or ``build("graph")`` make an approximate structure, which ``method``
    selects.
    """

    def __init__(self, spark: SparkSession, dim: int, metric: str = "cosine", M: int = 16, ef_construction: int = 200, ef_search: int = 50, log: str | None = None):
        if dim < 1:
            raise ValueError("dim must be at least 1")
        self.spark, self.dim, self.metric = spark, dim, check_metric(metric)
        self.config, self.log, self.seq = Config(M, ef_construction, ef_search), log, 0
        self.ef_search = ef_search
        self._held: list[tuple[int, Sequence[float], str]] = []
        self._begin([], 0)

    def _begin(self, parts: list[str], n: int) -> None:
        """Rows in these folders, numbered up to n; nothing deleted since."""
        self._parts, self._next = parts, n
        self._rows_at, self._gone_at = shared_path(self.spark, "index-rows"), shared_path(self.spark, "index-gone")
        self._any_gone = False
        self._ivf: IvfIndex | None = None
        self._graph: GraphIndex | None = None
        self._built: dict[str, int] = {}

    def _rows(self) -> DataFrame:
        if not self._parts:
            return self.spark.createDataFrame([], VECTORS)
        return self.spark.read.schema(VECTORS).parquet(*self._parts)

    def _gone(self) -> DataFrame:
        """Slots that were deleted since the rows' own marks."""
        if not self._any_gone:
            return self.spark.createDataFrame([], "slot long")
        return self.spark.read.schema("slot long").parquet(self._gone_at).distinct()

    @property
    def table(self) -> DataFrame:
        self._flush()
        if not self._any_gone:
            return self._rows()
        marked = self._rows().join(self._gone().withColumn("gone", F.lit(True)), "slot", "left")
        return marked.withColumn("deleted", F.col("deleted") | F.coalesce("gone", F.lit(False))).select(*VECTORS.fieldNames())

    def _vector(self, values: Sequence[float]) -> list[float]:
        out = [float(x) for x in values]
        if len(out) != self.dim:
            raise ValueError(f"a vector of {self.dim} dimensions is expected, not {len(out)}")
        return out

    def insert(self, id: int, vector: Sequence[float], metadata: dict[str, Any] | str | None = None) -> None:
        if not 0 <= int(id) < 1 << 63:
            raise ValueError("ids must fit into 63 bits")
        text = metadata if isinstance(metadata, str) else json.dumps({} if metadata is None else metadata)
        self._held.append((int(id), self._vector(vector), text))
        if len(self._held) >= HELD:
            self._flush()

    def insert_rows(self, rows: DataFrame, order: str = "id") -> None:
        """Many at once: rows (id, embedding, optional metadata), slots in the given order."""
        self._flush()
        first = self._next
        vector_table(rows, self.dim, order, first).write.mode("append").parquet(self._rows_at)
        if self._rows_at not in self._parts:
            self._parts.append(self._rows_at)
        n = self._rows().where(F.col("slot") >= first).count()
        if self.log is not None:
            lifecycle.append(lifecycle.insert_ops(rows, self.seq, order), self.log)
            self.seq += n
        self._next += n

    def _flush(self) -> None:
        if self._held:
            held, self._held = self._held, []
            self.insert_rows(self.spark.createDataFrame([(i, *h) for i, h in enumerate(held)], "place long, id long, embedding array<float>, metadata string"), "place")

    def delete(self, id: int) -> None:
        self.delete_ids(self.spark.createDataFrame([(int(id),)], "id long"))

    def delete_ids(self, ids: DataFrame) -> None:
        """Mark the first slot of each id. What is written is those slots alone."""
        self._flush()
        if self.log is not None:
            lifecycle.append(lifecycle.delete_ops(ids, self.seq), self.log)
            self.seq += ids.count()
        lifecycle.first_slots(self._rows(), ids).write.mode("append").parquet(self._gone_at)
        self._any_gone = True

    def is_deleted(self, id: int) -> bool:
        return bool(lifecycle.is_deleted(self.table, self.spark.createDataFrame([(int(id),)], "id long")).first().deleted)

    def __len__(self) -> int:
        self._flush()
        return self._next

    def live_size(self) -> int:
        return int(lifecycle.sizes(self.table).first().live_size)

    def set_ef_search(self, ef: int) -> None:
        if ef < 1:
            raise ValueError("the breadth must be at least 1")
        self.ef_search = ef

    def build(self, method: str, cells: int = 16) -> None:
        table = self.table
        if method == "ivf":
            self._ivf = IvfIndex.build(table, shared_path(self.spark, "ivf"), cells, self.metric)
        elif method == "graph":
            self._graph = GraphIndex.build(table, self.config, self.metric)
        else:
            raise ValueError("method must be ivf or graph")
        self._built[method] = self._next

    def update(self) -> None:
        """Take the rows that were inserted since into what has been built."""
        table = self.table
        for method, built in self._built.items():
            new = table.where(F.col("slot") >= built)
            if method == "ivf":
                self._ivf.insert(new)
            else:
                self._graph = self._graph.insert(new)
            self._built[method] = self._next

    def _check(self, method: str) -> None:
        if method != "exact" and method not in self._built:
            raise ValueError(f"build({method!r}) first")

    def search(self, query: Sequence[float], k: int = 10, where: dict | None = None, method: str = "exact", mode: str = "prefilter", nprobe: int = 8) -> list[dict[str, Any]]:
        """The hits as dicts of id, score and metadata; metadata that isn't JSON comes back under _raw."""
        values, table = self._vector(query), self.table
        self._check(method)
        if method == "exact":
            hits = knn(table, values, k, where, self.metric, mode, dim=self.dim)
        else:
            if method == "ivf":
                found = self._ivf.search(values, k, nprobe, where, self._gone())
            else:
                asked = self.spark.createDataFrame([(0, values)], "qid long, v array<double>")
                found = self._graph.search(asked, k, self.ef_search, where=where, gone=self._gone()).join(self._graph.nodes.select("slot", "metadata"), "slot").select("slot", "id", "score", "metadata")
            new = knn(table.where(F.col("slot") >= self._built[method]), values, k, where, self.metric)
            hits = found.unionByName(new).orderBy(F.desc("score"), "slot").limit(k)
        return [{"id": r.id, "score": r.score, "metadata": _decoded(r.metadata)} for r in hits.collect()]

    def search_many(self, queries: DataFrame, k: int = 10, where: dict | None = None, method: str = "exact", nprobe: int = 8) -> DataFrame:
        """qid, rank, slot, id, score for a table of queries (qid, v)."""
        table = self.table
        self._check(method)
        if method == "exact":
            return knn_join(queries, table, k, self.metric, where)
        if method == "ivf":
            found = self._ivf.knn_join(queries, k, nprobe, where, self._gone())
        else:
            found = self._graph.search(queries, k, self.ef_search, where=where, gone=self._gone())
        new = knn_join(queries, table.where(F.col("slot") >= self._built[method]), k, self.metric, where)
        return blocks.ranked(found.unionByName(new).drop("rank"), k).select("qid", "rank", "slot", "id", "score")

    def compact(self, index_path: str | None = None) -> None:
        """Drop deleted rows here; with a path, also save, and remove the log's files, which the snapshot then covers.

        Slots change, so lines of the log would no longer fit: with a log, a path is needed.
        """
        if self.log is not None and index_path is None:
            raise ValueError("with a log, compact needs the path of the snapshot that replaces it")
        table = materialise(lifecycle.compact(self.table), "index")
        self._begin([written_at(table)], table.count())
        if index_path is not None:
            self.save(index_path)
        if self.log is not None:
            lifecycle.truncate(self.spark, self.log, self.seq - 1)

    def save(self, path: str) -> None:
        lifecycle.save(self.table, path, self.seq - 1, dim=self.dim, metric=self.metric)

    def load(self, path: str) -> None:
        own = lifecycle.properties(self.spark, path)
        lifecycle.load(self.spark, path, self.dim)
        if own.get("metric"):
            self.metric = own["metric"]
        self._held = []
        parts = [f"{path}/{own['version']}"]
        if self.log is not None:
            last = lifecycle.read_log(self.spark, self.log).agg(F.max("seq")).first()[0]
            after = own.get("checkpoint_seq", -1)
            if last is not None and last > after:
                parts = [written_at(materialise(lifecycle.recover(self.spark, path, self.log), "index"))]
            self.seq = max(after, -1 if last is None else last) + 1
        self._begin(parts, self.spark.read.schema(VECTORS).parquet(*parts).count())


def _decoded(text: str | None) -> Any:
    try:
        found = json.loads(text or "{}")
    except ValueError:
        return {"_raw": text}
    return found if isinstance(found, dict) else {"_raw": text}
