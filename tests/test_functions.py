import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.functions import vectors as V

DIMS = (1, 7, 8, 9, 16, 31, 32, 63, 64, 128, 256, 768, 1536)


@pytest.mark.parametrize("dim", DIMS)
def test_equal_to_numpy(spark, dim):
    rng = np.random.default_rng(dim)
    pairs = [(i, rng.uniform(-1, 1, dim).tolist(), rng.uniform(-1, 1, dim).tolist()) for i in range(20)]
    df = spark.createDataFrame(pairs, "i int, a array<double>, b array<double>")
    V.register(spark)
    a, b = F.col("a"), F.col("b")
    got = df.select("i", V.cosine_similarity(a, b), V.l2_squared(a, b), V.inner_product(a, b), V.l2_norm(a), F.expr("cosine_similarity(a, b)"), F.expr("l2_squared(a, b)"), F.expr("inner_product(a, b)"), F.expr("l2_norm(a)")).collect()
    for (i, x, y), r in zip(pairs, sorted(got), strict=True):
        x, y = np.array(x), np.array(y)
        want = [x @ y / np.linalg.norm(x) / np.linalg.norm(y), ((x - y) ** 2).sum(), x @ y, np.linalg.norm(x)]
        assert np.allclose(r[1:5], want, atol=1e-9) and np.allclose(r[5:], want, atol=1e-9)


def test_special_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 2.0], [1.0, 2.0]), (None, [1.0, 2.0]), ([3.0, 4.0], [1.0])], "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    got = df.select(V.cosine_similarity(a, b).alias("c"), V.l2_squared(a, b).alias("d"), V.normalize(a).alias("n")).collect()
    assert got[0].c == 0.0 and list(got[0].n) == [0.0, 0.0] and got[1].c == pytest.approx(1.0) and got[1].d == 0.0
    assert got[2].c is None and got[2].d is None and got[3].c is None
    assert list(got[3].n) == pytest.approx([0.6, 0.8])
    assert math.isclose(df.select(V.cosine_similarity(V.vector_literal([1, 2]), b, norm_a=F.lit(math.sqrt(5))).alias("c")).collect()[1].c, 1.0)


def test_plan_stays_in_the_jvm(spark):
    df = spark.range(5).select(F.array(F.lit(1.0)).alias("a"))
    plan = df.select(V.cosine_similarity(F.col("a"), F.col("a")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
