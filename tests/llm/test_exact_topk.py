"""Exact inner products against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionlake.llm import exact_topk
from motionlake.llm.exact_topk import Side, meet, search


def brute(rows, is_query, k=10, d=8):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    scores = {}
    for q, a in ok:
        if is_query(q):
            for j, b in ok:
                if j != q:
                    s = max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True))))
                    scores.setdefault(q, {})[j] = max(scores.get(q, {}).get(j, -math.inf), s)
    return sorted((q, r + 1, j, s) for q, of in scores.items() for r, (j, s) in enumerate(sorted(of.items(), key=lambda x: (-x[1], x[0]))[:k]))


@pytest.mark.parametrize("spread", ["sphere", "lengths", "decay"])
def test_all_rows_against_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(exact_topk, "BLOCK", 40)
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(exact_topk, "CHUNK", 16)
    monkeypatch.setattr(exact_topk, "COLUMNS", 3)
    monkeypatch.setattr(exact_topk, "ROUNDS", (1, 5))
    r = random.Random(4)

    def vector():
        v = np.array([r.gauss(0, 1) for _ in range(8)])
        return {"sphere": v / np.linalg.norm(v), "lengths": v * r.choice([0.1, 1, 6]), "decay": v * 0.5 ** np.arange(8)}[spread].tolist()

    rows = [(i, vector()) for i in range(900)]
    rows += [(1000 + i, [0.5] * 8) for i in range(300)]  # copies: ties go to the smaller id
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] + [1.0] * 7), (2060, [None] + [1.0] * 7), (2080, [1.0] * 3), (2081, []), (None, [1.0] * 8), (2100, [float("inf")] * 8)]
    rows += [(1001, [1.0] * 8), (40, vector()), (41, vector()), (41, rows[41][1])]  # ids again
    df = spark.createDataFrame([(i, v, 1.0, -1) for i, v in rows], "vec_id long, embedding array<double>, score double, level int").repartition(5)
    got = sorted(tuple(x) for x in search(df, F.col("vec_id") % 20 == 0).collect())
    assert got == brute(rows, lambda i: i % 20 == 0)


def test_few_rows_and_no_rows(spark):
    for n in (1, 2, 12):
        rows = [(i, [float(i), -1.0, 0.25]) for i in range(n)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        assert sorted(tuple(x) for x in search(df, F.col("vec_id") % 5 == 0).collect()) == brute(rows, lambda i: i % 5 == 0, d=3)
    assert search(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    assert search(df, F.lit(False)).count() == 0


def test_components_that_doubles_do_not_hold(spark):
    r = random.Random(8)
    rows = [(i, [r.gauss(0, 1) * 10 ** r.choice([0, 5, 6]) for _ in range(4)]) for i in range(60)] + [(100, [1e300, 0.0, 0.0, -1e304])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(x) for x in search(df, F.col("vec_id") % 10 == 0, k=4).collect())
    assert got == brute(rows, lambda i: i % 10 == 0, 4, 4)


def test_ids_that_are_texts(spark):
    rows = [(f"v{i:02}", [math.sin(i), math.cos(3 * i)]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    got = sorted(tuple(x) for x in search(df, F.col("vec_id").endswith("0"), k=3).collect())
    assert got == brute(rows, lambda i: i.endswith("0"), 3, 2)


def test_bounds_leave_most_products_out():
    rng = np.random.default_rng(5)
    x = np.floor(1024 * rng.standard_normal((4096, 64)) * 0.85 ** np.arange(64) @ np.linalg.qr(rng.standard_normal((64, 64)))[0])
    turn = np.linalg.svd(x.T @ x)[0]
    side = Side(np.arange(4096), x, turn)
    side = side.take(np.argsort(-side.length, kind="stable"))
    work = [0]
    who, ids, scores = meet(Side(np.arange(64), x[:64], turn), side, np.full(64, -np.inf), 10, work)
    exact = x[:64] @ x.T
    exact[np.arange(64), np.arange(64)] = -np.inf
    want = np.argsort(-exact, axis=1, kind="stable")[:, :10]
    assert (ids.reshape(64, 10) == want).all() and (scores == exact[who, ids]).all()
    assert work[0] < 0.35 * 64 * 4096 * 64


def test_query_and_sql(spark, tmp_path):
    import duckdb

    from motionlake.llm.queries import ORACLES, QUERIES

    r = random.Random(2)
    rows = [(i, [r.gauss(0, 0.1) for _ in range(16)]) for i in range(450)] + [(500, None), (600, [0.0] * 16), (700, [None] * 16)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op11_exact_topk"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(ORACLES["op11_exact_topk"])
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(tuple(x) for x in got.collect()) == sorted(tuple(x[k] for k in order) for x in want.fetchall())
