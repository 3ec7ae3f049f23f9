"""The manifest against a plain tree."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from motionlake.llm.merkle import leaf, prove

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, fanout):
    """The levels from the leaves to one node."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + fanout]) for k in range(0, len(out[-1]), fanout)])
    return out


def around(tree, k, fanout):
    """Before and after of a leaf's node in its run, level by level."""
    out = []
    for level in tree[:-1]:
        lo = k // fanout * fanout
        out.append((level[lo:k], level[k + 1 : lo + fanout]))
        k //= fanout
    return out


def slow(rows, claim, fanout=8):
    """(id, leaf, subroot, root, proof, folded, verified, siblings) per row; rows as doc_id, text, lang, source, n_chars."""
    groups = {}
    for i, text, lang, source, n in rows:
        made = lambda t: plain_leaf((i, source, lang, n, t))  # noqa: B023, E731
        groups.setdefault(lang, []).append(((i is not None, i or 0), made(text), claim(i, text, made) or made(text), i))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = climb([x[1] for x in groups[g]], fanout)
    top = climb([trees[g][-1][0] for g in names], fanout)
    out = []
    for k, g in enumerate(names):
        for j, (_, own, claimed, i) in enumerate(groups[g]):
            path = around(trees[g], j, fanout) + around(top, k, fanout)
            folded = claimed
            for a, b in path:
                folded = H(*a, folded, *b)
            siblings = [x for a, b in path for x in (*a, *b)]
            out.append((i, own, trees[g][-1][0], top[-1][0], H(*siblings), folded, folded == top[-1][0], siblings))
    return out


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tampering(i, text, made):
    return made(lowered(text)) if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 else None


def claimed():
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    made = leaf(*(low if c == "text" else F.col(c) for c in FIELDS))
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, made)


def some_rows(n, seed=5):
    r = random.Random(seed)
    rows = [(i, "".join(r.choice("aB É中\n") for _ in range(r.choice([0, 3, 20]))), r.choice(["en", "en", "en", "de", "é", None]), r.choice(["s", None]), r.choice([None, 3])) for i in r.sample(range(10 * n), n)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*x, "clash", 9) for x in rows], SCHEMA).repartition(5)


key = lambda x: tuple((v is not None, v) for v in x[:7])


@pytest.mark.parametrize(("fanout", "height"), [(8, 1), (2, 2), (3, 1), (8, 3)])
def test_every_row_against_a_plain_tree(spark, fanout, height):
    rows = some_rows(400)
    rows += [(None, "Null", "en", "s", 1), (None, None, None, None, None), rows[0], rows[0], (rows[1][0], "Other", *rows[1][2:]), (5001, "Lone", "zz", "s", 4), (5002, "X" * 200_000, "en", "s", 1)]
    got = prove(frame(spark, rows), FIELDS, "lang", "doc_id", claimed(), fanout, height, siblings=True).collect()
    want = slow(rows, tampering, fanout)
    assert sorted((tuple(x) for x in got), key=key) == sorted(want, key=key)
    assert {x.verified for x in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_sizes_around_whole_runs(spark, n):
    rows = [(i, f"T{i}", "en", "s", 2) for i in range(n)]
    got = prove(frame(spark, rows), FIELDS, "lang", "doc_id", claimed(), height=1, siblings=True).collect()
    assert sorted((tuple(x) for x in got), key=key) == sorted(slow(rows, tampering), key=key)


def test_many_groups_and_no_claims(spark):
    rows = [(i, "t", f"g{i % 90}", "s", 1) for i in range(200)]
    got = prove(frame(spark, rows), FIELDS, "lang", "doc_id", height=1).collect()
    want = slow(rows, lambda i, t, made: None)
    assert sorted((tuple(x) for x in got), key=key) == sorted((x[:7] for x in want), key=key) and all(x.verified for x in got)


def test_one_row_repeated(spark):
    rows = [(7, "Same", "en", "s", 4)] * 300
    got = prove(frame(spark, rows), FIELDS, "lang", "doc_id", claimed(), height=1).collect()
    want = slow(rows, tampering)
    assert sorted((tuple(x) for x in got), key=key) == sorted((x[:7] for x in want), key=key)


def test_empty_table(spark):
    assert prove(frame(spark, []), FIELDS, "lang", "doc_id", claimed()).count() == 0


def test_query_and_sql(spark, tmp_path):
    import duckdb

    from motionlake.llm.queries import ORACLES, QUERIES

    rows = some_rows(700, seed=8)
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_merkle_manifest"](spark, str(tmp_path))
    found = sorted((tuple(x) for x in got.collect()), key=key)
    assert found == sorted((x[:7] for x in slow(rows, tampering)), key=key)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(ORACLES["op12_merkle_manifest"])
    order = [want.columns.index(c) for c in got.columns]
    assert found == sorted((tuple(x[k] for k in order) for x in want.fetchall()), key=key)
