"""Neighbours against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionlake.llm import ann
from motionlake.llm.ann import scan, search


def brute(rows, is_query, k):
    ok = [(i, v) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in ok:
        if is_query(q):
            best = {}
            for j, b in ok:
                if j != q:
                    best[j] = min(best.get(j, math.inf), float(np.sqrt(((np.array(b) - np.array(a)) ** 2).sum())))
            out[q] = sorted((s, j) for j, s in best.items())[:k]
    return out


def test_recall_ties_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 50)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 4)
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(900)]
    rows += [(1000 + i, [1.0] * 8) for i in range(300)]  # copies: ties go to the smaller id
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] + [1.0] * 7), (2060, [None] + [1.0] * 7), (2080, [1.0] * 3), (None, [1.0] * 8), (2100, [float("inf")] * 8), (1001, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, v string")
    got = {}
    for x in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    want = brute(rows, lambda i: i % 20 == 0, 10)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, 11)) and [(s, j) for _, j, s in found] == sorted((s, j) for _, j, s in found)
        hits += len({j for _, j, _ in found} & {j for _, j in want[q]})
    assert hits >= 0.9 * 10 * len(want)
    assert [j for _, j, _ in got[1000]] == list(range(1001, 1011))


def test_few_rows_are_all_found(spark):
    r = random.Random(6)
    for n in (6, 11, 30):
        df = spark.createDataFrame([(i, [r.gauss(0, 1) * (1 + 50 * (i % 3)) for _ in range(4)]) for i in range(n)], "vec_id long, embedding array<double>")
        got = ann.search(df, F.col("vec_id") % 5 == 0).groupBy("query_id").count().collect()
        assert {x["count"] for x in got} == {min(10, n - 1)} and len(got) == (n + 4) // 5


def test_small_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (100, [4.0, 6.0]), (7, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [tuple(x) for x in got] == [(0, 1, 7, 0.0), (0, 2, 100, 5.0), (100, 1, 0, 5.0), (100, 2, 7, 5.0)]
    assert ann.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.search(df.limit(1), F.col("vec_id") % 100 == 0).count() == 0


def test_an_id_of_many_rows_hides_no_other(spark, monkeypatch):
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(0, 0.01, (600, 32)), r.normal(0, 1, (900, 32))])
    ids = np.concatenate([np.full(600, 7), 100 + np.arange(900)])  # id 7 fills the first rows near the query
    query = np.zeros(32)
    d = np.sqrt((x**2).sum(axis=1))
    want = [7, *(100 + np.argsort(d[600:])[:9]).tolist()]
    assert [i for i, _ in ann.scan(query, query, x, x, ids, -1, 10)] == want
    # through the whole search: one id with a third of the rows, others repeated ten times
    rows = [(0, [0.0] * 7 + [0.001])] + [(7, r.normal(0, 0.01, 8).tolist()) for _ in range(600)]
    for i in range(1, 121):
        rows += [(20 * i + 1, r.normal(0, 1, 8).tolist())] * 10
    monkeypatch.setattr(ann, "SAMPLE", 300)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = [(x.score, x.vec_id) for x in ann.search(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    want = brute(rows, lambda i: i == 0, 10)[0]
    assert len(got) == 10 and len({j for _, j in got} & {j for _, j in want}) >= 9 and got[0][1] == 7


def test_scan_abandons_candidates_and_keeps_the_nearest():
    """Many column blocks: most components are never looked at, and hardly a neighbour is lost."""
    rng = np.random.default_rng(6)
    d, n, k = 128, 4000, 10
    middle = rng.standard_normal((40, d)) * 2
    x = middle[rng.integers(0, 40, n)] + rng.standard_normal((n, d))
    turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
    work, kept = [0], 0
    for q in range(60):
        got = scan(x[q], x[q] @ turn, x, x @ turn, np.arange(n), q, k, work)
        exact = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        exact[q] = np.inf
        want = np.argsort(exact)[:k]
        kept += len({i for i, _ in got} & set(want.tolist()))
        assert all(abs(s - exact[i]) < 1e-9 for i, s in got) and [s for _, s in got] == sorted(s for _, s in got)
    assert work[0] < 0.5 * 60 * n * d and kept >= 0.99 * 60 * k


@pytest.mark.parametrize("d,clusters", [(64, 0), (96, 25)])
def test_recall_of_every_twentieth_row(spark, d, clusters):
    """The whole operator at production parameters against brute force over all rows."""
    rng = np.random.default_rng(d)
    n = 3000
    x = rng.standard_normal((n, d))
    if clusters:
        x += (rng.standard_normal((clusters, d)) * 3)[rng.integers(0, clusters, n)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in search(df, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    hits = 0
    for q in range(0, n, 20):
        exact = ((x - x[q]) ** 2).sum(axis=1)
        exact[q] = np.inf
        assert len(found[q]) == 10
        hits += len(set(found[q]) & set(np.argsort(exact)[:10].tolist()))
    assert hits / (10 * n / 20) >= 0.9


def test_ids_that_are_no_numbers(spark):
    rows = [(f"v{k:03}", [float(k), 1.0]) for k in range(60)] + [(None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in search(df, F.col("vec_id") == "v010", k=3, recall=1.0).collect()}
    assert got == {("v010", 1): "v009", ("v010", 2): "v011", ("v010", 3): "v008"}


def test_blocks_are_even_where_rows_recur(spark, monkeypatch):
    """Vectors of a list in every seventh row: blocks dealt by row number would put them all in one."""
    monkeypatch.setattr(ann, "BLOCK", 70)
    seen = []
    keep = ann.cut
    monkeypatch.setattr(ann, "cut", lambda df: seen.append(keep(df)) or seen[-1])
    r = random.Random(3)
    middle = [[10.0 * (k == j) for j in range(4)] for k in range(7)]
    rows = [(i, [c + r.gauss(0, 0.1) for c in middle[i % 7 % 4]]) for i in range(2100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = ann.search(df, F.col("vec_id") % 100 == 0)
    assert got.groupBy("query_id").count().where("count = 10").count() == 21
    stored = seen[0].groupBy("list").agg(F.ceil(F.count(F.lit(1)) / 70).cast("int").alias("blocks"), F.collect_list("row").alias("rows")).select("list", "blocks", F.explode("rows").alias("row"))
    sizes = [x["count"] for x in stored.groupBy("list", F.pmod(F.xxhash64("row"), "blocks").alias("b")).count().collect()]
    assert max(sizes) < 2.5 * 70
