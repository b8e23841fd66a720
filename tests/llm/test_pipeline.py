import re
from collections import Counter

import corpus_pipeline as cp
from test_mixing import mx
from test_near_dedup import brute as near_groups
from test_packing import check

from vexel.llm import toxicity

DIR = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    stages = dict(cp.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    model = toxicity.learn(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    rows = [r for r in docs.collect() if model.score(r.text) < 0.5]
    clean = stages["toxicity"](spark, docs, DIR)
    assert clean.columns == docs.columns and Counter(clean.collect()) == Counter(rows)

    first = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r)
    single = stages["exact_dedup"](spark, clean, DIR)
    assert single.columns == docs.columns and Counter(single.collect()) == Counter(first.values())

    groups = near_groups([(r.doc_id, r.text) for r in first.values()])
    apart = stages["near_dedup"](spark, single, DIR)
    assert apart.columns == docs.columns and sorted(r.doc_id for r in apart.collect()) == sorted(min(g) for g in groups)

    mixed = stages["mixing"](spark, apart, DIR)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by, taken = Counter(), Counter()
    for r in apart.collect():
        by[r.source] += size(r.text)
    for r in mixed.collect():
        taken[r.source] += size(r.text)
    order = sorted(by, key=str.encode)
    assert mixed.columns == docs.columns and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 3
    for s, goal in zip(order, mx.targets([by[s] for s in order]), strict=True):
        longest = max(size(r.text) for r in apart.collect() if r.source == s)
        assert abs(taken[s] - goal) <= longest / 2 + 1

    packed = stages["packing"](spark, mixed, DIR).collect()
    assert check(packed, [(r.doc_id, r.text) for r in mixed.collect()]) < 0.03


def test_run_is_the_stages(spark):
    out = cp.run(spark, DIR)
    assert out.columns[0] == "doc_id" and out.count() > 0
    totals = {r.doc_id: r.doc_tokens for r in out.collect()}
    covered = Counter()
    for r in out.collect():
        covered[r.doc_id] += r.length
    assert all(covered[d] % n == 0 and covered[d] <= 3 * n for d, n in totals.items())


CLASHING = "doc_id long, text string, lang string, source string, n_chars int, row string, rest string, own string, k string, nth string, ident string, copies string, same string, times string, copy string, __own string, __nth string, __toxicity string, __ident string, __times string, __copy string"


def odd_rows():
    more = lambda i: [f"c{i}"] * (len(CLASHING.split(",")) - 5)
    calm = "the quiet river ran past the mill and the old stone bridge near the village"
    texts = [(1, calm), (2, calm), (1, calm), (None, calm), (None, calm), (3, None), (4, ""), (5, " "), (None, None), (6, "!!"), (7, calm + " today"), (8, "word " * 30_000), (9, "other words in this one are not like those at all"), (9, "a text of the same number but with other words in it")]
    return [(d, t, f"l{i}", ["a", "b", None][i % 3], i, *more(i)) for i, (d, t) in enumerate(texts)]


def test_stages_keep_odd_rows_and_clashing_columns(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, CLASHING)
    stages = dict(cp.STAGES)
    plain = lambda df: Counter(map(tuple, df.collect()))
    every = Counter(rows)
    clean = stages["toxicity"](spark, docs, DIR)
    assert clean.columns == docs.columns and plain(clean) == every

    for parts in (1, 5):  # however the rows are dealt
        single = stages["exact_dedup"](spark, docs.repartition(parts), DIR)
        got = plain(single)
        norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        best = {}
        for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2])):
            best.setdefault(norm(r[1]), r)
        assert single.columns == docs.columns and got == Counter(best.values())

        apart = stages["near_dedup"](spark, docs.repartition(parts), DIR)
        kept = plain(apart)
        assert apart.columns == docs.columns and all(every[r] >= n for r, n in kept.items())
        groups = near_groups([(i, r[1]) for i, r in enumerate(rows)])
        assert len(groups) == sum(kept.values()) and sum(r[1] == rows[0][1] for r in kept) == 1 and rows[0] in kept

        mixed = stages["mixing"](spark, docs.repartition(parts), DIR)
        taken = plain(mixed)
        assert mixed.columns == docs.columns and all(r in every and n <= 3 for r, n in taken.items()) and all((r[1] or "").strip() for r in taken)
        first = taken if parts == 1 else first
        assert taken == first

    assert stages["packing"](spark, docs, DIR).select("doc_id").distinct().count() == len({r[0] for r in rows})


def test_stages_take_empty_tables(spark):
    docs = spark.createDataFrame([], CLASHING)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, DIR)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
