"""Fill-in-middle against a plain reading and its own way back."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from motionlake.llm import infill
from motionlake.llm.infill import fill_in_middle, restore

UNITS = {"code_points": lambda t: list(t), "words": lambda t: re.findall(r"^[ \t-\r]+|[^ \t-\r]+[ \t-\r]*", t), "lines": lambda t: re.findall(r"[^\n]*\n|[^\n]+$", t)}


def slow(doc_id, text, units="code_points", cut_percent=90, suffix_first_percent=20):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * j : 8 * j + 8], 16) for j in range(4)]
    parts = UNITS[units](text)
    n = len(parts)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= cut_percent:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
    if h[3] % 100 < suffix_first_percent:
        return doc_id, n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def odd_texts():
    r = random.Random(3)
    signs = "ab <>PSM\n\té中\U0001f600é‍\x00"
    rows = [(i, "".join(r.choice(signs) for _ in range(r.choice([0, 1, 2, 3, 9, 40])))) for i in range(600)]
    rows += [(1000, None), (1001, ""), (None, "no id here"), (None, None), (1002, "x<P>y"), (1003, "<M>"), (1004, "<S"), (7, "again"), (7, "again"), (1005, "\n\n"), (1006, "  lead"), (-5, "negative")]
    return rows + [(2000 + i, "éw " * 40_000) for i in range(3)]


@pytest.mark.parametrize("units", sorted(UNITS))
def test_odd_texts_and_way_back(spark, monkeypatch, units):
    monkeypatch.setattr(infill, "SLICE", 300)
    rows = odd_texts()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, output string, n int").repartition(3)
    got = fill_in_middle(df, units=units).withColumn("back", restore(F.col("output"), F.col("form"))).collect()
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted((tuple(x)[:6] for x in got), key=key) == sorted((slow(i, t, units) for i, t in rows), key=key)
    assert sorted((x.id or 0, x.back) for x in got) == sorted((i or 0, t or "") for i, t in rows)
    assert {x.form for x in got} == {"plain", "psm", "spm"}


def test_rates_sentinels_and_string_ids(spark):
    df = spark.createDataFrame([(f"d{i}", f"text number {i} of many") for i in range(3000)], "name string, body string")
    got = fill_in_middle(df, "name", "body", sentinels=("[pre]", "[suf]", "|"), cut_percent=50, suffix_first_percent=50)
    got = got.withColumn("back", restore(F.col("output"), F.col("form"), ("[pre]", "[suf]", "|"))).collect()
    assert all(x.back == f"text number {x.id[1:]} of many" for x in got)
    share = {f: sum(x.form == f for x in got) / 3000 for f in ("plain", "psm", "spm")}
    assert abs(share["plain"] - 0.5) < 0.05 and abs(share["psm"] - 0.25) < 0.05
    assert any(x.output.startswith("[pre]") for x in got) and any(x.output.startswith("[suf]") for x in got)
    again = {x.id: x.output for x in fill_in_middle(df.repartition(7), "name", "body", sentinels=("[pre]", "[suf]", "|"), cut_percent=50, suffix_first_percent=50).collect()}
    assert again == {x.id: x.output for x in got}
    other = {x.id: x.output for x in fill_in_middle(df, "name", "body", seed="2").collect()}
    assert sum(other[i] != again[i] for i in again) > 2000


def test_empty_table(spark):
    got = fill_in_middle(spark.createDataFrame([], "doc_id long, text string"))
    assert got.count() == 0 and got.columns == ["id", "n", "form", "prefix_units", "middle_units", "output"]
    with pytest.raises(ValueError):
        fill_in_middle(spark.createDataFrame([], "doc_id long, text string"), units="pages")


def test_query_and_sql(spark, tmp_path):
    import duckdb

    from motionlake.llm.queries import ORACLES, QUERIES

    rows = odd_texts()[:612]
    spark.createDataFrame([r for r in rows if "\x00" not in (r[1] or "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_fill_in_middle"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(ORACLES["op13_fill_in_middle"])
    order = [want.columns.index(c) for c in got.columns]
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted((tuple(x) for x in got.collect()), key=key) == sorted((tuple(x[k] for k in order) for x in want.fetchall()), key=key)
