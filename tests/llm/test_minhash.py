"""Near duplicates against a brute-force version on exact string sets."""

import random

import pytest

from motionlake.llm.minhash import near_duplicates


def brute(rows, n, percent):
    def grams(text):
        w = [x for x in bytes(text or "", "utf-8").lower().split()]
        if not w:
            return frozenset()
        return frozenset([tuple(w)]) if len(w) < n else frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1))

    sets = [(i, grams(t)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted((i, len(x), find(i) if x else i, x != 0 and (find(i) if x else i) == i) for i, x in sets if i is not None)


def corpus(seed, groups=12):
    r = random.Random(seed)
    words = ["Ab", "ab", "ça", "x y", "the", "of", "zeta", "İ", "q", "w1", "w2", "w3", "w4", "w5", "w6", "w7", "w8"]
    rows = [(0, ""), (1, None), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "a b\x1cc d")]
    for _ in range(groups):
        base = [r.choice(words) + str(r.randrange(40)) for _ in range(r.choice([3, 8, 40, 200]))]
        for _ in range(r.randrange(1, 9)):
            copy = list(base)
            for _ in range(r.randrange(0, max(2, len(base) // 12))):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((len(rows) * 3, r.choice([" ", "\n", "  "]).join(copy)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("n,listed", [(2, 4096), (5, 4096), (2, 0)])
def test_against_brute_force(spark, n, listed):
    rows = corpus(n)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(df, shingle_words=n, bands=14, listed=listed).collect()
    assert sorted(map(tuple, got)) == brute(rows, n, 80)


def test_repeats_null_ids_clashing_columns_and_empty(spark):
    rows = [(5, "a b c d", "x"), (5, "a b c d", "y"), (5, "k l m n", "z"), (9, "k l m n", None), (None, "a b c d", "n"), (2, "zz yy", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string").withColumnRenamed("id", "n_shingles")
    got = sorted(map(tuple, near_duplicates(df, shingle_words=2).collect()), key=str)
    assert got == sorted([(5, 3, 5, True)] * 3 + [(9, 3, 5, False), (None, 3, None, False), (2, 1, 2, True)], key=str)
    assert near_duplicates(df.limit(0)).count() == 0


def test_large_bucket_goes_by_rare_shingles(spark):
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(base[:59] + [f"t{k}"])) for k in range(80)] + [(200 + k, " ".join(base[:45] + [f"u{k}{j}" for j in range(15)])) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(df, shingle_words=2, listed=3).collect())) == brute(rows, 2, 80)


def test_default_bands_miss_what_the_readme_states(spark):
    """Pairs at 0.8 exactly, none tied by a third: each is missed with probability 0.0015."""
    rows = []
    for k in range(2000):
        base = [f"p{k}w{j}" for j in range(9)]
        rows += [(2 * k, " ".join([*base, "a"])), (2 * k + 1, " ".join([*base, "b"]))]
    got = {x.id: x.component_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2).collect()}
    missed = sum(got[2 * k + 1] != 2 * k for k in range(2000))
    assert missed <= 12 and all(got[2 * k] == 2 * k for k in range(2000))  # 3 expected


@pytest.mark.parametrize("n", [2, 5])
def test_default_bands_against_brute_force(spark, n):
    rows = corpus(n)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(df, shingle_words=n).collect())) == brute(rows, n, 80)


def test_ids_that_are_no_numbers(spark):
    rows = corpus(4)
    df = spark.createDataFrame([(f"d{i:05}", t) for i, t in rows] + [(None, "a b c")], "doc_id string, text string")
    got = near_duplicates(df, shingle_words=2, bands=14).collect()
    want = [(f"d{i:05}", n, f"d{c:05}", k) for i, n, c, k in brute(rows, 2, 80)] + [(None, 2, None, False)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_components_do_not_depend_on_how_candidates_are_listed(spark):
    rows = corpus(6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(df, shingle_words=2, listed=0).collect())) == sorted(map(tuple, near_duplicates(df, shingle_words=2, listed=4096).collect()))
