"""Toxicity by weak supervision.

Many voters look at a bounded sample of documents, with and without a label: lexicons mined from the
labelled ones and dealt into groups for either side, fixed lexicons, patterns, what is absent, and
the given label as one more voter that may err.  A generative model with a tree of dependences
between voters estimates how each votes given the hidden label; its posteriors, of rows with and
without a label, choose the features of a linear classifier and train it.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collect_bounded, cut, id_type
from .textvec import _powers, byte_table, mix, slices, text_buffers, words

#: Letters, digits and bytes of other alphabets make words; a word is one feature.
_WORDS = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))
#: Bytes of a word's beginning that are features of their own.
PREFIXES = (4, 5, 6, 7)
#: Features mined for voters, and kept for the linear model; voters of either side that the mined ones are dealt into.
FEATURES, GROUPS = 4096, 12
#: For voters, then for the linear model: log-odds of a toxic and of a clean feature at least, and its
#: root likelihood ratio, which is as rarely so great by chance as a normal deviate.
VOTERS, MODEL = (3.0, 0.7, 4.5), (1.5, 0.7, 2.5)
#: What the prior that a given label errs in a hundredth of the rows weighs, in labelled rows, and what
#: a row without a label weighs beside one with a label.
TRUST, UNLABELLED = 1.0, 0.1

#: Plain insults in four languages, a voter for each line.
LEXICONS = (
    "idiot moron stupid dumb imbecile fool cretin halfwit dimwit",
    "scum trash garbage vermin filth worthless pathetic disgusting loser clown",
    "idiota estúpido estúpida imbécil basura asqueroso patético inútil payaso",
    "idiote stupide imbécile ordure dégoûtant minable pathétique crétin abruti",
    "idiotisch dumm blöd trottel abschaum müll ekelhaft erbärmlich wertlos versager",
    "hate kill die hasse odio haine tod muerte mort",
)
#: Patterns and what they vote.
PATTERNS = (
    (re.compile(r"\b(?:you|you're|youre|du|tu|eres|bist)\b[^.!?\n]{0,24}\b(?:idiot\w*|moron|stupid\w*|scum|trash|clown|loser|dumm\w*|imb[eé]cil\w*)", re.I), 1),
    (re.compile(r"[!?]{3,}"), 1),
    (re.compile(r"\b(?:i[d1]i0t|m0ron|stup[1!]d|tr[@4]sh|sh[1!*]t|f[*u]ck\w*)\b", re.I), 1),
    (re.compile(r"\b[A-Z]{4,}(?:\W+[A-Z]{4,}){3,}"), 1),
)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, 64-bit feature) of all words and word beginnings, with repeats."""
    w = words(data, offsets, _WORDS)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(w.ptr))
    docs, found = [doc], [w.h]
    size = w.end - w.start
    for n in PREFIXES:
        long = np.flatnonzero(size > n)
        p, _ = _powers(n)
        h = np.zeros(len(long), np.uint64)
        for k in range(n):
            h += _WORDS[data[w.start[long] + k]] * p[k]
        docs.append(doc[long])
        found.append(mix(h + np.uint64(977 * n)) ^ np.uint64(n))
    return np.concatenate(docs), np.concatenate(found)


def _distinct(doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((feature, doc))
    doc, feature = doc[order], feature[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1])
    return doc[fresh], feature[fresh]


class Lookup:
    """Which of a sorted set of features others are, by a bitmap and then a search."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = np.zeros(1 << 22, bool)
        self.bits[keys >> np.uint64(42)] = True

    def find(self, doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, index of key)."""
        at = np.flatnonzero(self.bits[feature >> np.uint64(42)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.keys, feature[at]), len(self.keys) - 1)
        same = self.keys[k] == feature[at]
        pairs = np.unique(doc[at[same]] * len(self.keys) + k[same])
        return pairs // len(self.keys), pairs % len(self.keys)


def dependences(joint: np.ndarray, rows: int) -> list[tuple[int, int]]:
    """(voter, voter it depends on or -1) in an order in which the latter come first.

    The tree of the greatest mutual information given the hidden label (Chow and Liu), without edges
    that do not pay for their parameters.  ``joint`` has P(y, a of voter i, b of voter j) as [y, i, a, j, b].
    """
    m = joint.shape[1]
    share = joint.sum(axis=(2, 4), keepdims=True)
    given = joint / share
    lone = np.einsum("yiaib->yia", given * np.eye(3)[None, None, :, None, :])
    info = (joint * np.log(given / (lone[:, :, :, None, None] * lone[:, None, None, :, :]))).sum(axis=(0, 2, 4))
    np.fill_diagonal(info, -np.inf)
    left, order = set(range(m)), []
    best = {j: (-np.inf, -1) for j in left}
    while left:
        j = max(left, key=lambda j: (best[j][0], -j))
        left.discard(j)
        order.append((j, best[j][1] if best[j][0] > 4 * math.log(rows + 1) / rows else -1))
        for k in left:
            if info[j, k] > best[k][0]:
                best[k] = info[j, k], j
    return order


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = 40, trust: float = TRUST, unlabelled: float = UNLABELLED) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]], np.ndarray]:
    """Posterior of each row, accuracy of each voter, the tree of dependences, chances of the label given.

    ``votes`` holds 1, 0 or -1 (abstains) of each voter, ``given`` the label, -1 where there is none.
    Expectation maximisation over a hidden label y: a voter votes by chances of its own that depend on
    y and on the vote of one other voter, so that voters which say the same thing count once; the
    given label errs with a chance that is learned too, from a prior that it seldom does, and says
    nothing where it is missing.  Rows
    with and without a label have a prior each.  It starts from the given label, elsewhere from the
    share of votes for 1.
    """
    n, m = votes.shape
    x = (votes[:, :, None] == np.array([-1, 0, 1])).astype(float).reshape(n, 3 * m)
    fired = votes >= 0
    p = (np.where(fired, votes, 0).sum(axis=1) + 0.2) / (fired.sum(axis=1) + 1.0)
    p = np.clip(np.where(given >= 0, 0.05 + 0.9 * given, p), 0.02, 0.98)
    tree, says, weight = [], np.zeros((2, 2)), np.where(given >= 0, 1.0, unlabelled)
    for _ in range(rounds):
        both = np.stack([1 - p, p]) * weight
        joint = np.stack([(x * w[:, None]).T @ x for w in both]).reshape(2, m, 3, m, 3)
        # one row's worth of independent votes under each label
        lone = (np.einsum("yiaia->yia", joint) + np.array([1.0, 0.5, 0.5])) / (both.sum(axis=1) + 2.0)[:, None, None]
        soft = joint + lone[:, :, :, None, None] * lone[:, None, None, :, :]
        tree = dependences(soft / soft[:, :1, :, :1, :].sum(), n)
        says = np.array([[(w * (given == v)).sum() for v in (0, 1)] for w in both]) + trust * (1 + (given >= 0).sum()) * np.array([[0.99, 0.01], [0.01, 0.99]])
        says /= says.sum(axis=1, keepdims=True)
        logit = np.zeros(n)
        for rows in (given >= 0, given < 0):
            prior = np.clip((p[rows].sum() + 0.5) / (rows.sum() + 1), 1e-4, 1 - 1e-4)
            logit[rows] = np.log(prior / (1 - prior))
        for v in (0, 1):
            logit[given == v] += np.log(says[1, v] / says[0, v])
        for j, i in tree:
            if i < 0:
                logit += (np.log(lone[1, j]) - np.log(lone[0, j]))[votes[:, j] + 1]
            else:
                chance = soft[:, i, :, j, :] / soft[:, i, :, j, :].sum(axis=2, keepdims=True)
                logit += (np.log(chance[1]) - np.log(chance[0]))[votes[:, i] + 1, votes[:, j] + 1]
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        done = np.abs(new - p).max() < 1e-6
        p = new
        if done:
            break
    hit = p[:, None] * (votes == 1) + (1 - p)[:, None] * (votes == 0)
    return p, hit.sum(axis=0) / np.maximum(fired.sum(axis=0), 1), tree, says


def logistic(rows: np.ndarray, cols: np.ndarray, size: tuple[int, int], target: np.ndarray, weight: np.ndarray, l2: float, steps: int = 800, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on a sparse 0/1 matrix, by Adam on all rows."""
    n, m = size
    x = np.append(np.zeros(m), np.log((weight @ target + 0.5) / (weight @ (1 - target) + 0.5)))
    first, second, total = np.zeros(m + 1), np.zeros(m + 1), weight.sum()
    for t in range(1, steps + 1):
        z = np.bincount(rows, x[cols], minlength=n) + x[-1]
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / total
        grad = np.append(np.bincount(cols, g[rows], minlength=m) + l2 * x[:-1], g.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        x = x - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-10)
    return x[:-1], float(x[-1])


def _clean(labels: DataFrame, id_col: str, label_col: str, learn) -> DataFrame:
    """(__id, y): one usable label for each id."""
    return labels.where(learn(F.col(id_col)) & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("y"))


def _sample(docs: DataFrame, clean: DataFrame, learn, most: int) -> DataFrame:
    """(id, text, y): at most ``most`` ids of each label and as many without, y -1, picked by a hash of the id; a row for each id."""
    order = lambda c: (F.xxhash64(c, F.lit(11)), c)
    parts = [clean.where(F.col("y") == y).orderBy(*order("__id")).limit(most) for y in (0, 1)]
    # of ids with small hashes, eight times as many as wanted, those that no label names
    rows = max(1, docs.count())
    some = docs.where(learn(F.col("__doc")) & (F.xxhash64("__doc", F.lit(11)) <= min(2**63 - 1, -(2**63) + 8 * most * 2**64 // rows)))
    some = some.select(F.col("__doc").alias("__id")).distinct().join(clean.select("__id"), "__id", "left_anti")
    parts.append(some.orderBy(*order("__id")).limit(most).withColumn("y", F.lit(-1)))
    picked = parts[0].unionByName(parts[1]).unionByName(parts[2])
    # bounded by 3 * most rows of two numbers
    joined = docs.join(F.broadcast(picked), F.col("__doc") == F.col("__id")).where("text is not null")
    return joined.groupBy(F.col("__doc").alias("id")).agg(F.min("text").alias("text"), F.first("y").alias("y"))


class Scorer:
    """The fitted classifier: sorted features, their weights, bias, and what the label model found."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float, accuracy: np.ndarray, tree: list, says: np.ndarray):
        self.keys, self.weights, self.bias, self.accuracy, self.tree, self.says = keys, weights, bias, accuracy, tree, says

    def score(self, column: pa.Array, lookup: Lookup) -> np.ndarray:
        data, offsets = text_buffers(column)
        d, k = lookup.find(*features(data, offsets))
        z = np.bincount(d, self.weights[k], minlength=len(offsets) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _mined(sample: DataFrame, share_of, least: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted features and log-odds of those that speak for a side (1 or -1) with odds and likelihood ratio of ``least`` at least.

    ``share_of`` gives each row's share of being toxic from its id and label, nan for rows that do not
    count.  At most FEATURES for each side, those first whose likelihood ratio is greatest.
    """

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                share = share_of(part)
                held = ~np.isnan(share)
                d, f = _distinct(*features(*text_buffers(part.column("text"))))
                d, f = d[held[d]], f[held[d]]
                keys, inverse = np.unique(f, return_inverse=True)
                pos = np.bincount(inverse, share[d], minlength=len(keys))
                neg = np.bincount(inverse, 1 - share[d], minlength=len(keys))
                f = pa.array(np.append(0, keys.view(np.int64)), mask=np.arange(len(keys) + 1) == 0)
                yield pa.RecordBatch.from_arrays([f, pa.array(np.append(share[held].sum(), pos)), pa.array(np.append((1 - share[held]).sum(), neg))], names=["f", "pos", "neg"])

    # in thousandths, so that sums do not depend on their order; the row without a feature has the totals
    per = sample.mapInArrow(count, "f long, pos double, neg double").groupBy("f").agg(*(F.sum(F.round(F.col(c) * 1000).cast("long")).alias(c) for c in ("pos", "neg")))
    per = cut(per.select("f", F.col("pos") / 1000 + 0.25, F.col("neg") / 1000 + 0.25).toDF("f", "pos", "neg"))
    totals = per.where("f is null").first()
    found: dict[int, float] = {}
    if totals:
        odds = F.log(F.col("pos") / totals.pos) - F.log(F.col("neg") / totals.neg)
        every, rows = F.col("pos") + F.col("neg"), totals.pos + totals.neg
        fits = lambda seen, expected: seen * F.log(seen / expected)
        ratio = sum(fits(F.col(c), every * n / rows) + fits(F.greatest(n - F.col(c), F.lit(0.25)), F.greatest(rows - every, F.lit(0.25)) * n / rows) for c, n in (("pos", totals.pos), ("neg", totals.neg)))
        scaled = per.where("f is not null").select("f", odds.alias("odds"), F.sqrt(F.greatest(2 * ratio, F.lit(0.0))).alias("z")).where(f"z >= {least[2]}")
        for side, odds in ((1, least[0]), (-1, least[1])):
            chosen = scaled.where(F.col("odds") * side >= odds).orderBy(F.desc("z"), "f").limit(FEATURES)
            found |= {r.f: r.odds for r in collect_bounded(chosen, FEATURES)}
    keys = np.array(list(found), np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array(list(found.values()))[order]


def _seen(sample: DataFrame, keys: np.ndarray, rows: int) -> tuple[list, np.ndarray, np.ndarray]:
    """Rows (id, y, rules) in the order of ids, and row and feature of what they hold."""
    shared = sample.sparkSession.sparkContext.broadcast(keys)

    def look(batches):
        lookup = Lookup(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                d, k = lookup.find(*features(*text_buffers(part.column("text"))))
                at = np.searchsorted(d, np.arange(part.num_rows + 1))
                seen = [k[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
                rules = [[v if p.search(t) else -1 for p, v in PATTERNS] for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), pa.array(seen, pa.list_(pa.int32())), pa.array(rules, pa.list_(pa.int32()))], names=["id", "y", "seen", "rules"])

    found = sample.mapInArrow(look, f"id {id_type(sample, 'id')}, y int, seen array<int>, rules array<int>")
    found = sorted(collect_bounded(found, rows), key=lambda r: r.id)
    r_at = np.repeat(np.arange(len(found)), [len(r.seen) for r in found])
    c_at = np.concatenate([np.array(r.seen, np.int64) for r in found]) if found else np.zeros(0, np.int64)
    return found, r_at, c_at


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn=None, sample_rows: int = 4000) -> Scorer:
    """Fits on at most ``sample_rows`` rows of each label and as many without a label (bounded and documented here).

    ``learn`` maps the id column to the condition of rows that may be used at all.  Labels other
    than 0 and 1, null ids and ids without text count for nothing; of labels that contradict each
    other under one id, toxic wins; of texts under one id, the least.  Without labelled rows of both
    kinds, the fixed lexicons alone weigh the features that a default model knows.
    """
    learn = learn or (lambda c: F.lit(True))
    plain = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("text")).where(F.col(id_col).isNotNull())
    clean = cut(_clean(labels.where(F.col(id_col).isNotNull()), id_col, label_col, learn))
    counts = {r.y: r["count"] for r in clean.groupBy("y").count().collect()}
    fixed = [np.unique(features(*text_buffers(pa.array([w])))[1][:1]) for line in LEXICONS for w in line.split()]
    line_of = np.repeat(np.arange(len(LEXICONS)), [len(x.split()) for x in LEXICONS])
    fixed_keys = np.concatenate(fixed)
    default = np.unique(fixed_keys)
    sample = cut(_sample(plain, clean, learn, sample_rows))
    found = {r.y for r in sample.select("y").distinct().collect()}
    if not {0, 1} <= found:
        return Scorer(default, np.full(len(default), 4.0), -2.5, np.zeros(0), [], np.eye(2))

    def labelled(part):
        y = part.column("y").to_numpy().astype(float)
        return np.where(y < 0, np.nan, y)

    mined, odds = _mined(sample, labelled, VOTERS)
    every = np.unique(np.concatenate([mined, fixed_keys]))
    odds_of = np.zeros(len(every))
    odds_of[np.searchsorted(every, mined)] = odds
    rows, r_at, c_at = _seen(sample, every, 3 * sample_rows)
    y = np.array([r.y for r in rows])
    holds = lambda member: np.bincount(r_at, member[c_at], minlength=len(rows)) > 0
    votes = []
    for side, vote in ((1, 1), (-1, 0)):
        ranked = [k for k in np.argsort(-side * odds_of, kind="stable") if odds_of[k] * side > 0]
        for g in range(GROUPS):
            member = np.zeros(len(every), bool)
            member[ranked[g::GROUPS]] = True
            votes.append(np.where(holds(member), vote, -1))
    for line in range(len(LEXICONS)):
        votes.append(np.where(holds(np.isin(every, fixed_keys[line_of == line])), 1, -1))
    votes.append(np.where(holds((odds_of > 0) | np.isin(every, fixed_keys)), -1, 0))
    votes = np.column_stack([*votes, np.array([r.rules for r in rows])])
    votes = votes[:, (votes >= 0).any(axis=0)]
    posterior, accuracy, tree, says = label_model(votes, y)

    # what speaks for either side among all rows of the sample, by their posteriors
    share = sample.sparkSession.sparkContext.broadcast(dict(zip([r.id for r in rows], posterior.tolist(), strict=True)))

    def by_posterior(part):
        return np.array([share.value[i] for i in part.column("id").to_pylist()])

    chosen, _ = _mined(sample, by_posterior, MODEL)
    chosen = np.unique(np.concatenate([chosen, fixed_keys]))
    rows, r_at, c_at = _seen(sample, chosen, 3 * sample_rows)
    # the sample is dealt by label; weights bring back the share of each among the labelled rows
    weight = np.where(y == 1, counts[1] / max(1, (y == 1).sum()), counts[0] / max(1, (y == 0).sum()))
    weight[y < 0] = weight[y >= 0].mean() * UNLABELLED
    w, b = logistic(r_at, c_at, (len(rows), len(chosen)), posterior, weight / weight.mean(), 1e-4)
    return Scorer(chosen, w, b, accuracy, tree, says)


def score_documents(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, score) for each row: 0 to 1, higher where toxic is likelier.

    Scores depend on the text alone.  Null and empty texts have the score of a text without any
    known feature.  Rows are independent; repeated ids give repeated rows; an empty table none.
    The model is at most FEATURES weights and the fixed lexicons.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    types = dict(docs.dtypes)

    def run(batches):
        lookup = Lookup(shared.value.keys)
        for batch in batches:
            for part in slices(batch, "__text"):
                yield pa.RecordBatch.from_arrays([part.column(0), *(part.column(k) for k in range(2, part.num_columns)), pa.array(shared.value.score(part.column("__text"), lookup))], names=["id", *keep, "score"])

    plain = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"), *(F.col(c) for c in keep))
    return plain.mapInArrow(run, ", ".join([f"id {types[id_col]}", *(f"`{c}` {types[c]}" for c in keep), "score double"]))


def held_out(id_col):
    """Column: rows whose labels are never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def learnable(id_col):
    """Column: rows whose labels may be learned from."""
    return F.crc32(id_col.cast("string")) % 5 != 0
