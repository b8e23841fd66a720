import json
import random

import pytest
from pyspark.sql import functions as F

from vexel.plans.predicate import compile_where, parse_where


def verdicts(spark, rows, where):
    df = spark.createDataFrame([(i, m) for i, m in enumerate(rows)], "i int, m string")
    c = compile_where(where, F.col("m"))
    return [r.v for r in df.select("i", (F.lit(True) if c is None else c).alias("v")).orderBy("i").collect()]


def order(a, b):
    """The comparison, from its definition: 0 equal, 1 above, -1 below or not comparable."""
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    if number(a) and number(b) or isinstance(a, str) and isinstance(b, str):
        a, b = (a.encode(), b.encode()) if isinstance(a, str) else (float(a), float(b))
        return (a > b) - (a < b)
    return 0 if json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True) else -1


def brute(text, where):
    if not where:
        return True
    try:
        doc = json.loads(text)
    except (TypeError, ValueError):
        return False
    if not isinstance(doc, dict):
        return False
    for f, spec in where.items():
        if f not in doc:
            return False
        for op, x in (spec if isinstance(spec, dict) else {"$eq": spec}).items():
            if op in ("$in", "$nin"):
                found = isinstance(x, list) and any(order(doc[f], y) == 0 for y in x)
                if found != (op == "$in"):
                    return False
                continue
            c = order(doc[f], x)
            if not {"$eq": c == 0, "$ne": c != 0, "$gt": c > 0, "$gte": c >= 0, "$lt": c < 0, "$lte": c <= 0}[op]:
                return False
    return True


VALUES = [None, True, False, 0, 1, 1.0, -2.5, 10**12, "", "a", "b", "1", "é", "Z", [], [1], [1, "a"], {"a": 1}, {"a": [True]}]


@pytest.mark.parametrize("op", ["$eq", "$ne", "$gt", "$gte", "$lt", "$lte"])
def test_every_pair_of_values(spark, op):
    rows = [json.dumps({"v": v}) for v in VALUES]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, m string")
    got = df.select("i", *[compile_where({"v": {op: x}}, F.col("m")).alias(f"c{j}") for j, x in enumerate(VALUES)]).orderBy("i").collect()
    for m, r in zip(rows, got, strict=True):
        assert [r[f"c{j}"] for j in range(len(VALUES))] == [brute(m, {"v": {op: x}}) for x in VALUES], m


def test_random_clauses(spark):
    rnd = random.Random(3)
    rows = [json.dumps({k: rnd.choice(VALUES) for k in "abc" if rnd.random() < 0.8}) for _ in range(30)] + ["", "x", "[1]", "3", None]
    ops = ["$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin"]
    for _ in range(12):
        where = {}
        for k in rnd.sample("abc", rnd.randint(1, 3)):
            spec = {}
            for op in rnd.sample(ops, rnd.randint(0, 2)):
                spec[op] = [rnd.choice(VALUES) for _ in range(rnd.randint(0, 3))] if op in ("$in", "$nin") and rnd.random() < 0.9 else rnd.choice(VALUES)
            where[k] = spec if rnd.random() < 0.8 else rnd.choice([v for v in VALUES if not isinstance(v, dict)])
        assert verdicts(spark, rows, where) == [brute(m, where) for m in rows], where


def test_parsing():
    assert parse_where(None) == {} and parse_where([1]) == {} and compile_where({}, F.col) is None
    assert parse_where({"a": 3, "b": {"$gt": 1, "$lt": 2}, "c": {}}) == {"a": [("$eq", 3)], "b": [("$gt", 1), ("$lt", 2)], "c": []}
    for bad in ({"a": {"$regex": "x"}}, {"a": {"$gt": float("nan")}}, {"a": {"$in": [float("inf")]}}, {"a": {"$eq": object()}}):
        with pytest.raises(ValueError):
            parse_where(bad)


def test_names_are_literal(spark):
    rows = ['{"a.b": 1}', '{"a": {"b": 1}}', "{\"it's\": 2}", '{"q\\"x": 3}']
    assert verdicts(spark, rows, {"a.b": 1}) == [True, False, False, False]
    assert verdicts(spark, rows, {"it's": {}}) == [False, False, True, False]
    assert verdicts(spark, rows, {'q"x': 3}) == [False, False, False, True]
    assert verdicts(spark, ["{\"'\\\"\\\\\": 7}", "{}"], {"'\"\\": 7}) == [True, False]
    assert verdicts(spark, rows, {}) == [True] * 4
