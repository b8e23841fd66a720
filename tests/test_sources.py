import struct

import numpy as np
import pytest

from vexel import cli
from vexel.functions import table as table_function
from vexel.index import Index
from vexel.operators import lifecycle as lc
from vexel.operators.graph import GraphIndex
from vexel.operators.search import knn
from vexel.schema import Config, vector_table
from vexel.sources import files


@pytest.fixture(scope="module", autouse=True)
def sources(spark):
    files.register(spark)


def test_npy(spark, tmp_path):
    x = np.random.default_rng(1).standard_normal((130, 7))
    for kind in ("<f4", "<f8", ">f4"):
        np.save(tmp_path / "x.npy", x.astype(kind))
        got = spark.read.format("npy").option("partRows", 50).load(f"file://{tmp_path}/x.npy")
        assert got.rdd.getNumPartitions() == 3
        assert np.allclose([r.embedding for r in got.orderBy("id").collect()], x, atol=1e-6)
    np.save(tmp_path / "i.npy", np.arange(6).reshape(2, 3))
    with pytest.raises(Exception, match="floats"):
        spark.read.format("npy").option("partRows", 50).load(f"file://{tmp_path}/i.npy").collect()
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    files.write_npy(rows, f"{tmp_path}/y.npy", 7)
    assert np.allclose(np.load(tmp_path / "y.npy"), x, atol=1e-6)


def index_bytes(version, n=130, dim=3):
    """An index file put together by hand."""
    out = struct.pack("<IIIIQ", 0x4E444220, version, dim, 0, n) + struct.pack(f"<{n}Q", *[2 * i for i in range(n)])
    out += np.arange(n * dim, dtype="<f4").tobytes()
    out += b"".join(struct.pack("<I", len(t)) + t for t in (b"{}" if i % 2 else '{"é": 1}'.encode() for i in range(n)))
    out += struct.pack("<iI", 1, 0)
    if version == 2:
        bits = [i % 5 == 0 for i in range(n)] + [False] * (-n % 64)
        out += np.packbits(bits, bitorder="little").tobytes()
    for i in range(n):
        layers = [[(i + 1) % n, (i + 2) % n], [0]][: 2 if i % 10 == 0 else 1]
        out += struct.pack("<I", len(layers)) + b"".join(struct.pack(f"<I{len(to)}I", len(to), *to) for to in layers)
    return out


@pytest.mark.parametrize("version", [1, 2])
def test_index_file(spark, tmp_path, version):
    (tmp_path / "i").write_bytes(index_bytes(version))
    got = spark.read.format("vector_index").option("partRows", 50).load(f"file://{tmp_path}/i").orderBy("slot").collect()
    assert [(r.slot, r.id, list(r.embedding), r.metadata, r.deleted, r.level) for r in got] == [
        (i, 2 * i, [3.0 * i, 3.0 * i + 1, 3.0 * i + 2], "{}" if i % 2 else '{"é": 1}', version == 2 and i % 5 == 0, int(i % 10 == 0)) for i in range(130)
    ]
    links = spark.read.format("vector_index").option("partRows", 50).option("part", "edges").load(f"file://{tmp_path}/i")
    want = {(0, i, (i + d) % 130) for i in range(130) for d in (1, 2)} | {(1, i, 0) for i in range(0, 130, 10)}
    assert {tuple(r) for r in links.collect()} == want
    if version == 2:
        nodes = spark.read.format("vector_index").option("partRows", 50).load(f"file://{tmp_path}/i")
        files.write_index(nodes, links, f"{tmp_path}/o", 3, 1, 0)
        again = spark.read.format("vector_index").option("partRows", 50).load(f"file://{tmp_path}/o")
        assert again.orderBy("slot").collect() == got
        assert {tuple(r) for r in spark.read.format("vector_index").option("partRows", 50).option("part", "edges").load(f"{tmp_path}/o").collect()} == want
    (tmp_path / "bad").write_bytes(b"\0" * 64)
    (tmp_path / "cut").write_bytes(index_bytes(version)[:900])
    for name in ("bad", "cut"):
        with pytest.raises(Exception, match="index file|ends early"):
            spark.read.format("vector_index").option("partRows", 50).load(f"file://{tmp_path}/{name}").collect()


def test_log_file(spark, tmp_path):
    lines = [(i, "insert" if i % 3 else "delete", i % 7, [1.0 * i, 2.0] if i % 3 else None, f'{{"i": {i}}}' if i % 3 else None) for i in range(120)]
    files.write_log(spark.createDataFrame(lines, lc.OPLOG), f"{tmp_path}/log")
    read = lambda: [(r.seq, r.op, r.id, None if r.embedding is None else list(r.embedding), r.metadata) for r in spark.read.format("vector_log").option("partRows", 50).load(f"{tmp_path}/log").orderBy("seq").collect()]
    assert read() == lines
    data = (tmp_path / "log").read_bytes()
    last = struct.pack("<BQI", 1, 5, 2) + b"\0" * 8 + struct.pack("<I", 3) + b"abc"
    for cut in range(len(last)):  # a record that isn't whole is left out
        if cut in (0, 1, 12, 13, 20, 24, 25, 27):
            (tmp_path / "log").write_bytes(data + last[:cut])
            assert read() == lines
    (tmp_path / "log").write_bytes(data + struct.pack("<BQII", 9, 1, 0, 0) + last)
    assert len(read()) == 121 and read()[-1][0] == 121
    assert spark.read.format("vector_log").option("partRows", 50).load(f"{tmp_path}/none").count() == 0


def test_page_file(spark, tmp_path):
    x = np.random.default_rng(2).standard_normal((150, 64)).astype("<f4")
    rows = vector_table(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>"))
    files.write_pages(rows, f"{tmp_path}/p", 64)
    assert (tmp_path / "p").stat().st_size == 10 * 4096
    got = spark.read.format("vector_pages").option("partRows", 50).option("dim", 64).option("count", 150).load(f"{tmp_path}/p").orderBy("slot").collect()
    assert np.array_equal(np.array([r.embedding for r in got], "<f4"), x)
    assert spark.read.format("vector_pages").option("partRows", 50).option("dim", 64).load(f"{tmp_path}/p").count() == 150
    with pytest.raises(ValueError):
        files.per_page(1023)


def test_index_object(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((80, 16))
    index = Index(spark, 16, log=f"file://{tmp_path}/log")
    for i, v in enumerate(x):
        index.insert(i, v, {"parity": i % 2, "tag": ["even", "odd"][i % 2]})
    index.insert(500, x[3], "not json")
    assert len(index) == 81 and index.live_size() == 81
    hits = index.search(x[3], 3)
    assert [h["id"] for h in hits][:2] == [3, 500] and hits[1]["metadata"] == {"_raw": "not json"} and hits[0]["metadata"] == {"parity": 1, "tag": "odd"}
    assert all(h["metadata"]["tag"] == "even" for h in index.search(x[3], 5, {"tag": "even"}))
    index.delete(3)
    assert index.is_deleted(3) and not index.is_deleted(4) and not index.is_deleted(999) and index.live_size() == 80
    assert index.search(x[3], 1)[0]["id"] == 500
    for method in ("ivf", "graph"):
        with pytest.raises(ValueError):
            index.search(x[3], 1, method=method)
        index.build(method, cells=4)
        assert [h["id"] for h in index.search(x[3], 5, method=method, nprobe=4)] == [h["id"] for h in index.search(x[3], 5)]
    index.set_ef_search(30)
    q = spark.createDataFrame([(0, x[7].tolist())], "qid long, v array<double>")
    assert index.search_many(q, 1).first().id == index.search_many(q, 1, method="graph").first().id == index.search_many(q, 1, method="ivf", nprobe=4).first().id == 7
    index.save(f"file://{tmp_path}/s")
    index.insert(600, -x[5])
    index.delete(7)
    other = Index(spark, 16, log=f"file://{tmp_path}/log")
    other.load(f"file://{tmp_path}/s")  # the snapshot, and what the log has after it
    assert len(other) == 82 and other.is_deleted(7) and other.search(-x[5], 1)[0]["id"] == 600
    other.compact(f"file://{tmp_path}/s")
    assert len(other) == other.live_size() == 80
    for bad in (lambda: Index(spark, 16, "dot"), lambda: index.insert(1, [1.0]), lambda: index.insert(-1, x[0]), lambda: index.search([1.0], 1), lambda: index.set_ef_search(0), lambda: Index(spark, 0)):
        with pytest.raises(ValueError):
            bad()


def test_index_after_the_build(spark, tmp_path):
    """Deletes show at once in what has been built, and rows inserted since are found."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 8))
    index = Index(spark, 8, log=f"file://{tmp_path}/log")
    for i, v in enumerate(x):
        index.insert(i, v, {"even": i % 2 == 0})
    for method in ("ivf", "graph"):
        index.build(method, cells=4)
    ids = lambda method, **more: [h["id"] for h in index.search(x[10], 8, method=method, nprobe=4, **more)]
    index.delete(10)
    index.insert(100, x[10] * 2, {"even": True})
    index.insert(101, x[10] + 0.01, {"even": False})
    for method in ("ivf", "graph", "exact"):
        assert ids(method)[:2] == [100, 101] and 10 not in ids(method) and ids(method) == ids("exact"), method
        assert ids(method, where={"even": True}) == ids("exact", where={"even": True})
    q = spark.createDataFrame([(0, x[10].tolist())], "qid long, v array<double>")
    many = [[r.id for r in index.search_many(q, 8, {"even": True}, method, nprobe=4).orderBy("rank").collect()] for method in ("ivf", "graph", "exact")]
    assert many[0] == many[1] == many[2] == ids("exact", where={"even": True})
    index.update()
    index.delete(101)
    for method in ("ivf", "graph"):
        assert ids(method) == ids("exact") and ids(method)[0] == 100
    parts = lambda: sorted(p.name for p in (tmp_path / "log").glob("*.parquet"))
    assert parts() and index.live_size() == 60 and len(index) == 62
    with pytest.raises(ValueError):
        index.compact()
    index.compact(f"file://{tmp_path}/s")
    assert not parts() and len(index) == index.live_size() == 60
    other = Index(spark, 8, log=f"file://{tmp_path}/log")
    other.load(f"file://{tmp_path}/s")
    assert len(other) == 60 and not other.is_deleted(10) and ids("exact") == [h["id"] for h in other.search(x[10], 8)]


def test_page_store(spark, tmp_path):
    x = np.random.default_rng(2).standard_normal((230, 64)).astype("<f4")
    rows = vector_table(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>"))
    assert files.append_pages(rows.where("slot < 100"), f"{tmp_path}/p", 64) == (0, 100)
    assert files.append_pages(rows.where("slot < 0"), f"{tmp_path}/p", 64) == (100, 0)
    assert files.append_pages(rows.where("slot >= 100"), f"{tmp_path}/p", 64) == (100, 130)
    got = spark.read.format("vector_pages").option("partRows", 7).option("dim", 64).load(f"{tmp_path}/p").orderBy("slot").collect()
    assert [r.slot for r in got] == list(range(230)) and np.array_equal(np.array([r.embedding for r in got], "<f4"), x)
    table = files.page_table(spark, f"{tmp_path}/p", 64)
    assert [r.id for r in knn(table, x[150].tolist(), 1).collect()] == [150]
    g = GraphIndex.build(table, Config(M=8))
    q = spark.createDataFrame([(i, x[i].tolist()) for i in (3, 120)], "qid long, v array<double>")
    assert {(r.qid, r.id) for r in g.search(q, 1).collect()} == {(3, 3), (120, 120)}


def test_table_function(spark):
    table_function.register(spark)
    t = vector_table(files.generate(spark, 100, 4))
    t.createOrReplaceTempView("t_knn")
    v = ", ".join(f"{x!r}D" for x in t.where("slot = 9").first().embedding)
    got = spark.sql(f"SELECT * FROM knn(TABLE(t_knn) WITH SINGLE PARTITION, array({v}), 3)").collect()
    assert got[0].id == 9 and got[0].score == pytest.approx(1.0) and len(got) == 3


def test_command(spark, tmp_path, capsys):
    assert cli.main([]) == 1
    assert cli.main(["bench", "--n", "300", "--dim=16", "--k", "5", "--cells", "4", "--sweep", "20"], spark) == 0
    out = capsys.readouterr().out
    assert "| ivf | 4 |" in out and "| graph | 20 |" in out and "| exact |" in out
    np.save(tmp_path / "e.npy", np.random.default_rng(1).standard_normal((200, 8)).astype("f4"))
    assert cli.main(["bench", f"--embeddings={tmp_path}/e.npy", f"--queries={tmp_path}/e.npy", "--k=1", "--cells=2", "--methods", "ivf"], spark) == 0
    capsys.readouterr()
    assert cli.main(["kernels", "--n", "200", "--dims", "8"], spark) == 0
    out = capsys.readouterr().out
    assert "| cosine | 8 |" in out and "| blocks l2 | 8 |" in out
