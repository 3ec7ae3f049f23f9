"""Alignment, decontamination and license scan against slow versions."""

import random
import re

import numpy as np

from motionlake.llm import decontamination
from motionlake.llm.alignment import local_alignment
from motionlake.llm.decontamination import contaminated
from motionlake.llm.licenses import GRAM, TEMPLATES, WINDOW, find_licenses, winnow


def smith_waterman(item, text):
    h = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item):
        for j, b in enumerate(text):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if a == b else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    return max(max(r) for r in h)


def test_alignment():
    r = random.Random(1)
    for _ in range(300):
        item, text = ([r.randrange(5) for _ in range(r.randrange(0, 12))] for _ in range(2))
        score, matched, s, e = local_alignment(np.array(item, np.uint64), np.array(text, np.uint64))
        assert score == smith_waterman(item, text)
        assert smith_waterman(item, text[s:e]) == score and matched * 2 >= score
        wide = local_alignment(np.array(item, np.uint64), np.array(text, np.uint64), 0, 40)
        assert wide[0] == score


def test_contaminated_equals_all_pairs(spark):
    r = random.Random(2)
    word = lambda: "w" + str(r.randrange(400))
    items = [(k, " ".join(word() for _ in range(r.choice([2, 8, 30])))) for k in range(12)] + [(90, None), (91, "")]
    rows = [(k, " ".join(word() for _ in range(60))) for k in range(40)]
    for k in range(40, 60):
        w = items[k % 12][1].split()
        if len(w) > 5 and k % 2:
            w[3] = "Changed"
            w.insert(6, "more")
        rows.append((k, " ".join(word() for _ in range(20)) + ". " + ", ".join(w).upper() + " é " + " ".join(word() for _ in range(20))))
    rows += [(70, None), (71, ""), (50, rows[50][1]), (None, items[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "id")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((x.id, x.item_id, round(x.score, 9)) for x in contaminated(docs, bench, id_col="id").collect()), key=str)
    want = []
    for i, t in rows:
        for j, s in items:
            a, b = ([w for w in re.split(r"[\x00-/:-@\[-`{-\x7f]+", (x or "").lower()) if w] for x in (s, t))
            n = min(3, len(a))
            seeds = {tuple(a[x : x + n]) for x in range(len(a) - n + 1)} & {tuple(b[x : x + n]) for x in range(len(b) - n + 1)}
            if a and seeds and smith_waterman(a, b) >= len(a):
                want.append((i, j, round(smith_waterman(a, b) / 2 / len(a), 9)))
    assert got == sorted(want, key=str) and len(want) > 20
    blocks = contaminated(docs, bench, id_col="id", block_bytes=200)
    assert sorted(((x.id, x.item_id, round(x.score, 9)) for x in blocks.collect()), key=str) == got
    assert contaminated(docs.limit(0), bench, id_col="id").count() == 0 and contaminated(docs, bench.limit(0), id_col="id").count() == 0


def test_spans(spark):
    docs = spark.createDataFrame([(1, "é alpha beta gamma delta epsilon zeta eta theta tail")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "beta gamma delta epsilon zeta eta")], "item_id long, text string")
    (x,) = contaminated(docs, bench).collect()
    assert "é alpha beta gamma delta epsilon zeta eta theta tail"[x.start : x.end] == "beta gamma delta epsilon zeta eta" and x.score == 1.0


def test_licenses(spark):
    r = random.Random(3)
    prose = lambda n: " ".join("t" + str(r.randrange(900)) for _ in range(n))
    rows, want = [(0, None), (1, ""), (2, prose(300))], set()
    for k, (name, text) in enumerate(TEMPLATES):
        edited = text.split()
        if len(edited) > 20:
            edited[7] = "changed"
        rows.append((10 + k, prose(30) + " Ünïcode\n# " + " ".join(edited).upper() + "\n" + prose(30)))
        want.add((10 + k, name))
    rows.append((99, TEMPLATES[0][1] + " " + prose(40) + " " + TEMPLATES[3][1]))
    want |= {(99, "MIT"), (99, "Apache-2.0")}
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id")
    got = find_licenses(df).collect()
    assert {(x.id, x.license) for x in got} == want
    texts = dict(rows)
    for x in got:
        found = texts[x.id][x.start : x.end].lower()
        assert found.split()[-1].strip("./") == TEMPLATES[x.template][1].lower().split()[-1].strip("./") and x.coverage >= 0.8
    assert find_licenses(df.limit(0)).count() == 0


def test_adjacent_copies_of_a_license_are_all_found(spark):
    rows, want = [], {}
    for k, (name, text) in enumerate(TEMPLATES):
        for gap in (0, 1, 3):
            lines = [text + " and" * gap for _ in range(7)]
            lines[3:3] = ["By others."] * (gap == 3)
            rows.append((10 * k + gap, "\n".join(lines)))
            want[10 * k + gap] = [(name, 1.0)] * 7
    rows.append((999, "\n".join(TEMPLATES[k % 2 * 14][1] for k in range(400))))
    want[999] = [(TEMPLATES[k % 2 * 14][0], 1.0) for k in range(400)]
    got = {}
    for x in sorted(find_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda x: x.start):
        got.setdefault(x.id, []).append((x.license, x.coverage))
    assert got == want


def test_common_seeds_find_copies_too(spark):
    item = [f"w{k}" for k in range(40)]
    copy = item[:11] + [w if k % 3 else "changed" for k, w in enumerate(item[11:])]  # intact 3-grams: those of the first 11 words
    rows = [(k, " ".join(item[:11]) + f" and no more of it in {k}") for k in range(30)] + [(99, " ".join(copy))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    (x,) = contaminated(docs, bench).collect()
    assert (x.id, x.matched_words, x.score) == (99, 30, smith_waterman(item, copy) / 80)


def test_many_items_without_an_id(spark, monkeypatch):
    """Blocks are dealt by item and text, whatever the ids; repeated rows count once, ids keep their type."""
    monkeypatch.setattr(decontamination, "BLOCK_ROWS", 50)
    items = [(None, f"quite special words number {k} of this benchmark") for k in range(120)] * 2 + [("q", "other words that stand here alone"), ("r", "Other words that stand here: alone")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = spark.createDataFrame([("d", "x quite special words number 7 of this benchmark y"), ("e", "some other words that stand here alone")], "doc_id string, text string")
    got = [(x.id, x.item_id) for x in contaminated(docs, bench).collect() if x.score == 1.0]
    assert sorted(got, key=str) == [("d", None), ("e", "q"), ("e", "r")]


def test_rare_seeds(spark, monkeypatch):
    """What is dropped are common grams beyond the rarer half; an item that all documents copy is still found in all."""
    monkeypatch.setattr(decontamination, "_HITS_AT_A_TIME", 3)
    r = random.Random(9)
    item = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(r.choice(item) if r.random() < 0.1 else w for w in item)) for k in range(60)] + [(100 + k, " ".join(item[:12]) + f" t{k}") for k in range(60)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(5, " ".join(item))], "item_id int, text string")
    every = {x.id: round(x.score, 9) for x in contaminated(docs, bench, rare_documents=10**9).collect()}
    rare = {x.id: round(x.score, 9) for x in contaminated(docs, bench, rare_documents=0).collect()}
    assert every == rare == {k: round(smith_waterman(item, t.split()) / 80, 9) for k, t in rows if k < 100}
    assert dict(contaminated(docs, bench).dtypes)["item_id"] == "int"


def slow_alignment(item, text, diagonal=None, band=0):
    """(score, matched, start, end) cell by cell: the best score, then the most matches, then the latest start; of equal ends the first."""
    best, zero = (0, 0, 0, 0), lambda j: (0, 0, j)
    prev = [zero(j) for j in range(len(text) + 1)]
    for i, a in enumerate(item):
        now = [zero(0)]
        for j, b in enumerate(text):
            s, m, at = prev[j]
            diag = (s + 2, m + 1, at) if a == b else (s - 1, m, at)
            up, left = prev[j + 1], now[j]
            cell = max(zero(j + 1), diag, (up[0] - 1, *up[1:]), (left[0] - 1, *left[1:]))
            if diagonal is not None and abs(j - i - diagonal) > band:
                cell = zero(j + 1)
            now.append(cell)
        for j, (s, m, at) in enumerate(now):
            if (s, m) > best[:2]:
                best = s, m, at, j
        prev = now
    return best


def test_winnowing_against_a_slow_version():
    r = random.Random(11)
    for _ in range(300):
        sizes = [r.randrange(0, 9) for _ in range(r.randrange(1, 5))]
        ptr = np.cumsum([0, *sizes])
        h = np.array([r.randrange(6) for _ in range(ptr[-1])], np.uint64)
        grams = np.array([int("".join(map(str, h[k : k + GRAM]))) for k in range(max(0, len(h) - GRAM + 1))], np.uint64)
        inside = np.array([any(a <= k and k + GRAM <= b for a, b in zip(ptr, ptr[1:])) for k in range(len(grams))], bool)
        want = set()
        for a, b in zip(ptr.tolist(), ptr[1:].tolist()):
            own = list(range(a, b - GRAM + 1))
            windows = [own[k : k + WINDOW] for k in range(len(own) - WINDOW + 1)] or [[k] for k in own]
            for window in windows:
                least = min(grams[k] for k in window)
                want |= {k for k in window if grams[k] == least}
        assert set(winnow(grams, inside).tolist()) == want


def test_licenses_against_slow_alignments(spark):
    """One edited copy in a document: coverage and span are those of the best alignment of its template."""
    r = random.Random(12)
    rows, want = [], {}
    for k, (name, text) in enumerate(TEMPLATES):
        words_ = [w for w in re.split(r"[^0-9A-Za-z]+", text.lower()) if w]
        edited = list(words_)
        for _ in range(len(words_) // 12):
            at = r.randrange(len(edited))
            edited[at : at + 1] = r.choice([[], ["edit"], [edited[at], "more"]])
        doc = [f"t{r.randrange(500)}" for _ in range(15)] + edited + [f"t{r.randrange(500)}" for _ in range(15)]
        score, matched, s, e = slow_alignment(words_, doc)
        rows.append((k, " ".join(doc)))
        want[k] = (round(matched / len(words_), 9), len(" ".join(doc[:s])) + 1, len(" ".join(doc[:e])), matched)
    got = {}
    for x in find_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert x.id not in got
        got[x.id] = x
    assert set(got) == set(want)
    for k, x in got.items():
        # another template with as many matched words may win; it is the same license or a longer one
        assert x.template == k and (round(x.coverage, 9), x.start, x.end) == want[k][:3] or x.coverage * len(re.split(r"[^0-9A-Za-z]+", TEMPLATES[x.template][1].strip(".\""))) > want[k][3] - 2, (k, x, want[k])
