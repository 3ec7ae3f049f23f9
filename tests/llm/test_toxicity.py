"""The label model on votes with known accuracies, and held-out accuracy of the whole operator."""

import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from motionlake.llm import toxicity


def test_label_model_discounts_copies_of_a_voter():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    good = [np.where(rng.random(4000) < 0.85, y, ~y).astype(int) for _ in range(4)]
    bad = np.where(rng.random(4000) < 0.6, y, ~y).astype(int)
    votes = np.column_stack([*good, *[bad] * 6])  # six copies of one poor voter
    none = np.full(4000, -1)
    posterior, accuracy, tree, _ = toxicity.label_model(votes, none)
    assert ((posterior > 0.5) == y).mean() > 0.9
    # the copies hang together, the good voters are independent given the label
    assert sum(j >= 4 and i >= 4 for j, i in tree) == 5 and not any(j < 4 and i >= 0 or 0 <= i < 4 for j, i in tree)
    assert accuracy[0] > 0.8 and accuracy[4] < 0.7
    # a label that errs in a tenth of the rows is one more voter, whose chances are learned
    given = np.where(rng.random(4000) < 0.5, np.where(rng.random(4000) < 0.9, y, ~y).astype(int), -1)
    posterior, _, _, says = toxicity.label_model(votes, given, trust=0.01)
    assert ((posterior > 0.5) == y)[given >= 0].mean() > 0.94 and 0.83 < says[0, 0] < 0.96 and 0.83 < says[1, 1] < 0.96


def slow_model(votes, given, rounds, trust, unlabelled):
    """The same, a row and a voter at a time."""
    n, m = len(votes), len(votes[0])
    p = []
    for row, g in zip(votes, given):
        fired = [v for v in row if v >= 0]
        s = 0.05 + 0.9 * g if g >= 0 else (sum(fired) + 0.2) / (len(fired) + 1)
        p.append(min(0.98, max(0.02, s)))
    for _ in range(rounds):
        own = [1.0 if g >= 0 else unlabelled for g in given]
        w = [[(1 - x) * o for x, o in zip(p, own)], [x * o for x, o in zip(p, own)]]
        alone = [[[(sum(w[y][r] for r in range(n) if votes[r][j] == v) + (1.0, 0.5, 0.5)[v + 1]) / (sum(w[y]) + 2) for v in (-1, 0, 1)] for j in range(m)] for y in (0, 1)]
        pair = lambda y, i, a, j, b: sum(w[y][r] for r in range(n) if votes[r][i] == a and votes[r][j] == b) + alone[y][i][a + 1] * alone[y][j][b + 1]
        table = {(y, i, a, j, b): pair(y, i, a, j, b) for y in (0, 1) for i in range(m) for j in range(m) for a in (-1, 0, 1) for b in (-1, 0, 1)}
        label = [sum(table[y, 0, a, 0, b] for a in (-1, 0, 1) for b in (-1, 0, 1)) for y in (0, 1)]
        every = sum(label)

        def info(i, j):
            out = 0.0
            for y in (0, 1):
                total = sum(table[y, i, a, j, b] for a in (-1, 0, 1) for b in (-1, 0, 1))
                of_i = {a: table[y, i, a, i, a] / sum(table[y, i, c, i, d] for c in (-1, 0, 1) for d in (-1, 0, 1)) for a in (-1, 0, 1)}
                of_j = {b: table[y, j, b, j, b] / sum(table[y, j, c, j, d] for c in (-1, 0, 1) for d in (-1, 0, 1)) for b in (-1, 0, 1)}
                for a in (-1, 0, 1):
                    for b in (-1, 0, 1):
                        out += table[y, i, a, j, b] / every * math.log(table[y, i, a, j, b] / total / (of_i[a] * of_j[b]))
            return out

        order, left = [(0, -1)], set(range(1, m))
        while left:
            value, j, i = max(((info(i, j), j, i) for j in left for i, _ in order), key=lambda t: (t[0], -t[1], t[2] == 0))
            i = max((i for i, _ in order), key=lambda i: info(i, j))
            order.append((j, i if value > 4 * math.log(n + 1) / n else -1))
            left.discard(j)
        says = [[sum(w[y][r] for r in range(n) if given[r] == v) + trust * (1 + sum(g >= 0 for g in given)) * (0.99 if v == y else 0.01) for v in (0, 1)] for y in (0, 1)]
        says = [[x / sum(row) for x in row] for row in says]
        new = []
        for r in range(n):
            same = [k for k in range(n) if (given[k] >= 0) == (given[r] >= 0)]
            prior = (sum(p[k] for k in same) + 0.5) / (len(same) + 1)
            like = [1 - prior, prior]
            for y in (0, 1):
                if given[r] >= 0:
                    like[y] *= says[y][given[r]]
                for j, i in order:
                    v = votes[r][j]
                    like[y] *= alone[y][j][v + 1] if i < 0 else table[y, i, votes[r][i], j, v] / sum(table[y, i, votes[r][i], j, b] for b in (-1, 0, 1))
            new.append(like[1] / sum(like))
        p = new
    return p


def test_label_model_against_a_slow_version():
    r = random.Random(4)
    truth = [r.random() < 0.4 for _ in range(120)]
    votes = []
    for y in truth:
        a = int(y if r.random() < 0.8 else not y)
        votes.append([a, a if r.random() < 0.95 else 1 - a, r.choice([-1, int(y), int(y), 1 - int(y)]), r.choice([-1, 1 if y else -1])])
    given = [r.choice([-1, int(y)]) for y in truth]
    for rounds in (1, 3):
        for trust, unlabelled in ((1.0, 0.1), (0.01, 1.0)):
            got = toxicity.label_model(np.array(votes), np.array(given), rounds, trust, unlabelled)[0]
            assert np.allclose(got, slow_model(votes, given, rounds, trust, unlabelled), atol=1e-6)


def slow_features(text):
    """Features of a text, a word at a time: whole words and beginnings of longer ones."""
    one = lambda word: toxicity.features(*toxicity.text_buffers(pa.array([word])))[1]
    found = set()
    for word in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode()):
        keys = one(pa.array([word], pa.binary()).cast(pa.string())[0].as_py())
        found.add(int(keys[0]))
        found |= {int(one(word.decode()[:n] + "zzzz")[1 + k]) for k, n in enumerate((4, 5, 6, 7)) if len(word) > n}
    return found


def test_scores_against_a_slow_version(spark):
    rows, labels = corpus(500, 3)
    rows = [(i, t.replace("w1", "W1-")) for i, t in rows] + [(9000, ""), (9001, None), (9002, "zorgilaxes " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scorer = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    weight = dict(zip(scorer.keys.tolist(), scorer.weights.tolist()))
    for x in toxicity.score_documents(docs, scorer).collect():
        z = scorer.bias + sum(weight.get(f, 0) for f in slow_features(dict(rows)[x.id]))
        assert abs(x.score - 1 / (1 + math.exp(-z))) < 1e-9


def test_rows_without_a_label_train_the_classifier(spark):
    """A word that no labelled row has gets its weight from posteriors of rows without a label."""
    rows, labels = corpus(900, 5)
    marked = {i for i, _ in labels[:450]}
    truth = dict(labels)
    rows = [(i, t + " quuxly" if truth[i] and i not in marked else t) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scorer = toxicity.fit(docs, spark.createDataFrame(labels[:450], "doc_id long, toxic int"))
    fresh = spark.createDataFrame([(1, "w1 w2 w3 quuxly w4"), (2, "w1 w2 w3 w4")], "doc_id long, text string")
    got = {x.id: x.score for x in toxicity.score_documents(fresh, scorer).collect()}
    own = slow_features("quuxly")
    assert own <= set(scorer.keys.tolist()) and all(scorer.weights[scorer.keys == np.uint64(f)] > 0 for f in own)
    assert got[1] / (1 - got[1]) > 3 * got[2] / (1 - got[2]) and got[2] < 0.5


def test_many_rows_of_one_id(spark):
    rows, labels = corpus(300, 6)
    toxic = next(i for i, y in labels if y)
    docs = spark.createDataFrame(rows + [(toxic, "scumm zorgil")] * 3000, "doc_id long, text string")
    scorer = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), sample_rows=60)
    assert toxicity.score_documents(docs, scorer).count() == 3300
    named = docs.selectExpr("concat('d', doc_id) AS doc_id", "text")
    again = toxicity.fit(named, spark.createDataFrame([(f"d{i}", y) for i, y in labels], "doc_id string, toxic int"))
    assert dict(toxicity.score_documents(named, again).dtypes)["id"] == "string"


def corpus(n, seed):
    r = random.Random(seed)
    clean = ["w%d" % k for k in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [r.choice(clean) for _ in range(r.choice([5, 30, 300]))]
        toxic = r.random() < 0.2
        if toxic:
            for _ in range(r.choice([1, 3])):
                text.insert(r.randrange(len(text)), r.choice(["Scumm", "zorgil", "zorgilen", "zorgilax", "vroxy"]) + r.choice(["", ",", "!"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_and_leakage(spark):
    rows, labels = corpus(900, 2)
    extra = [(5000, None), (5001, ""), (None, "scumm zorgil"), (7, rows[7][1])]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string").selectExpr("*", "'x' AS score", "1 AS toxic")
    marks = spark.createDataFrame(labels + [(3, labels[3][1]), (None, 1), (8, 7)], "doc_id long, toxic int")
    scorer = toxicity.fit(docs, marks, learn=toxicity.learnable)
    got = toxicity.score_documents(docs.select("doc_id", "text"), scorer).withColumn("held", toxicity.held_out(F.col("id"))).collect()
    assert len(got) == 904 and all(0 <= x.score <= 1 for x in got)
    truth = dict(labels)
    held = [(x.score >= 0.5, bool(truth[x.id])) for x in got if x.held and x.id in truth]
    assert len(held) > 120 and sum(a == b for a, b in held) / len(held) > 0.95
    by_id = {x.id: x.score for x in got}
    assert by_id[5000] == by_id[5001] < 0.5
    # labels that are held out change nothing
    flipped = spark.createDataFrame([(i, 1 - y if x else y) for (i, y), x in zip(labels, [r.h for r in spark.createDataFrame(labels, "doc_id long, y int").select(toxicity.held_out(F.col("doc_id")).alias("h")).collect()])], "doc_id long, toxic int")
    again = toxicity.fit(docs, flipped, learn=toxicity.learnable)
    assert np.array_equal(again.keys, scorer.keys) and np.allclose(again.weights, scorer.weights)


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "you idiot moron"), (2, "a fine day")], "doc_id long, text string")
    scorer = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    got = {x.id: x.score for x in toxicity.score_documents(docs, scorer).collect()}
    assert got[1] > 0.5 > got[2]
    assert toxicity.score_documents(docs.limit(0), scorer).count() == 0
