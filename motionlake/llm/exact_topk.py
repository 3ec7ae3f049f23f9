"""Exact largest inner products: long vectors first, rotated partial sums, Cauchy-Schwarz bounds.

Vectors are integers.  They are dealt to levels by descending length, and levels are met in rounds:
a query leaves out every level whose longest vector cannot reach its k-th best score of the rounds
before.  Within a block, dimensions are rotated so that the first ones hold most of the length; a
partial sum over these, plus the product of the two remaining lengths, bounds the whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import INTEGERS, collect_bounded, cut, drop, id_type, numbered

#: Rows and bytes (as doubles) of a block of vectors, queries in a block, levels at most.
BLOCK, BLOCK_BYTES, QUERY_BLOCK, LEVELS = 4096, 8 << 20, 512, 256
#: Levels of the first rounds; the last has the rest.
ROUNDS = (1, 15)
#: Rotated dimensions that are added between two looks at the bounds, and rows of a block that are met at once.
COLUMNS, CHUNK = 16, 512
#: Share of pairs still alive over which products of whole matrices go on.
DENSE = 0.2
#: Query blocks whose thresholds a task remembers from block to block.
REMEMBERED = 1024


def finite(vector: Column) -> Column:
    """Vectors with components, none of them null or non-finite."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


class Side:
    """Integer vectors with their ids, rotated, and the lengths that are left after each look."""

    def __init__(self, ids: np.ndarray, whole: np.ndarray, turn: np.ndarray):
        self.ids, self.whole = ids, whole
        self.turned = whole @ turn
        looks = range(COLUMNS, whole.shape[1], COLUMNS)
        left = np.cumsum((self.turned**2)[:, ::-1], axis=1)[:, ::-1]
        self.length = np.sqrt((whole**2).sum(axis=1))
        self.rest = [np.sqrt(left[:, b]) for b in looks]

    def take(self, order: np.ndarray) -> Side:
        out = Side.__new__(Side)
        out.ids, out.whole, out.turned, out.length, out.rest = self.ids[order], self.whole[order], self.turned[order], self.length[order], [r[order] for r in self.rest]
        return out


def best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k highest scores over distinct ids, ties to the smaller id, by query and rank."""
    order = np.lexsort((-scores, ids, query))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (query[order][1:] != query[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    order = order[fresh]
    order = order[np.lexsort((ids[order], -scores[order], query[order]))]
    q = query[order]
    rank = np.arange(len(order)) - np.searchsorted(q, q)
    return order[rank < k]


def meet(queries: Side, vectors: Side, least: np.ndarray, k: int, work: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the query, id, score) of at most k pairs a query, among them all that may be in its k best.

    ``vectors`` are in descending length, those of equal length by id; ``least`` has the score that each query's k-th best has already,
    and is raised.  ``work`` gathers how many products of components are made in the rotated space.
    """
    d = vectors.whole.shape[1]
    found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    edge = np.full(len(least), np.iinfo(np.int64).max)  # the id of the k-th best, if that is what ``least`` is
    for lo in range(0, len(vectors.ids), CHUNK):
        # scores are integers: half a one and a share of the lengths cover rounding
        far = queries.length * vectors.length[lo]
        alive = np.flatnonzero(far * (1 + 1e-9) + 0.5 >= least)
        if not len(alive):
            break
        at = slice(lo, lo + CHUNK)
        floor = (least[alive] - 0.5 - 1e-9 * far[alive])[:, None]
        part = np.zeros((len(alive), len(vectors.ids[at])))
        ok = queries.ids[alive][:, None] != vectors.ids[at][None, :]
        q = x = None
        for step, a in enumerate(range(0, d, COLUMNS)):
            b = min(d, a + COLUMNS)
            if q is None:
                if work is not None:
                    work[0] += part.size * (b - a)
                part += queries.turned[alive, a:b] @ vectors.turned[at, a:b].T
                if b < d:
                    ok &= part + queries.rest[step][alive][:, None] * vectors.rest[step][at] >= floor
                    if ok.mean() < DENSE:
                        q, x = np.nonzero(ok)
                        part = part[q, x]
            else:
                if work is not None:
                    work[0] += len(q) * (b - a)
                part += np.einsum("pi,pi->p", queries.turned[alive[q], a:b], vectors.turned[lo + x, a:b])
                if b < d:
                    near = part + queries.rest[step][alive[q]] * vectors.rest[step][lo + x] >= floor[q, 0]
                    q, x, part = q[near], x[near], part[near]
        if q is None:
            q, x = np.nonzero(ok & (part >= floor))
        else:
            near = part >= floor[q, 0]
            q, x = q[near], x[near]
        if not len(q):
            continue
        if len(q) > DENSE * len(alive) * len(vectors.ids[at]):
            exact = (queries.whole[alive] @ vectors.whole[at].T)[q, x]
        else:
            exact = np.concatenate([np.einsum("pi,pi->p", queries.whole[alive[q[j : j + 65536]]], vectors.whole[lo + x[j : j + 65536]]) for j in range(0, len(q), 65536)])
        near = (exact > least[alive[q]]) | (exact == least[alive[q]]) & (vectors.ids[lo + x] <= edge[alive[q]])
        q, x, exact = q[near], x[near], exact[near]
        merged = [np.concatenate(pair) for pair in zip(found, (alive[q], vectors.ids[lo + x], exact), strict=True)]
        keep = best(*merged, k)
        found = [c[keep] for c in merged]
        counts = np.bincount(found[0], minlength=len(least))
        full = np.flatnonzero(counts >= k)
        last = np.cumsum(counts)[full] - 1
        raised = found[2][last] >= least[full]
        full, last = full[raised], last[raised]
        least[full], edge[full] = found[2][last], found[1][last]
    return tuple(found)


def _large(query: np.ndarray, own: int, vectors: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best of a block by integers of any size, for components whose products doubles do not hold; held to the range of a long."""
    a = [int(c) for c in query]
    scored: dict[int, int] = {}
    for i, v in zip(ids.tolist(), vectors, strict=True):
        if i != own:
            score = max(-(2**63), min(2**63 - 1, sum(c * int(e) for c, e in zip(a, v, strict=True))))
            scored[i] = max(scored.get(i, score), score)
    return sorted(((s, i) for i, s in scored.items()), key=lambda x: (-x[0], x[1]))[:k]


def search(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each row that ``queries`` picks, exactly.

    Components are floor(scale * x) with x as double, and scores are integers; rank starts at 1, ties go
    to the smaller id.  A query's own id is no candidate of it; rows that repeat an id count as one query
    and as one candidate, at the highest score.  Vectors that are null or empty, hold null or non-finite
    components, have a null id or another length than the commonest take no part; zero ones do.  Ids that
    are no integers are numbered in their order first.  An empty table gives no rows.  Where products
    leave the range in which doubles are exact, integers of any size are used without bounds, and
    scores beyond a long count as the nearest long.

    Levels are quantiles of the length over all rows, blocks of a level have about BLOCK rows, however
    many vectors have the same length, and each block is met by the query blocks that can find something
    there.  The rotation is the singular vectors of at most BLOCK of the longest vectors; it only decides how
    early candidates are left behind.
    """
    session = vectors.sparkSession
    kind = id_type(vectors, id_col)
    if kind not in INTEGERS:
        names = numbered(vectors, id_col)
        own = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), queries.alias("q")).join(names, "id").select("number", "v", "q")
        found = search(own, F.col("q"), "number", "v", k, scale)
        for c in ("query_id", "vec_id"):
            found = found.join(names.select(F.col("number").alias(c), F.col("id").alias(f"own_{c}")), c)
        return found.select(F.col("own_query_id").alias("query_id"), "rank", F.col("own_vec_id").alias("vec_id"), "score")
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), queries.cast("boolean").alias("q")).where(F.col("id").isNotNull() & finite(F.col("v")))
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("double"))
    length = F.sqrt(F.aggregate(whole, F.lit(0.0), lambda s, x: s + x * x))
    peak = F.array_max(F.transform("v", lambda x: F.abs(x * scale))) + 1
    shares = [j / LEVELS for j in range(1, LEVELS)]
    sizes = plain.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(peak).alias("peak"), F.percentile_approx(length, shares).alias("lengths")).orderBy(F.desc("n"), "d").limit(1).collect()
    schema = f"query_id {kind}, rank int, vec_id {kind}, score long"
    if not sizes:
        return session.createDataFrame([], schema)
    d, n, highest, lengths = sizes[0]
    plain = plain.where(F.size("v") == d)
    block = max(1, min(BLOCK, BLOCK_BYTES // (8 * d)))
    count = min(LEVELS, max(1, math.ceil(n / block)))
    bounds = np.array([lengths[math.ceil(j * LEVELS / count) - 1] for j in range(1, count)])  # the shortest vectors are level 0
    # a bound that recurs holds as many shares of the rows
    weights = np.concatenate([[1.0], (bounds[:, None] == bounds[None, :]).sum(axis=1)]) if count > 1 else np.ones(1)
    parts = np.maximum(1, np.ceil(weights * n / count / block)).astype(np.int64)
    exact = highest * highest * d < 2.0**53
    packed = np.dtype(np.int16 if highest < 2**15 else np.int32 if highest < 2**31 else np.float64)

    def deal(batches):
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(x * scale), -np.finfo(float).max, np.finfo(float).max)
                norms = np.sqrt((x * x).sum(axis=1))
            level = np.searchsorted(bounds, norms, "right")
            cells = pa.array([r.tobytes() for r in np.ascontiguousarray(x.astype(packed))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), cells, pa.array(norms), pa.array(level.astype(np.int32)), pa.array(parts[level])], names=["id", "v", "length", "level", "parts"])

    dealt = "id long, v binary, length double, level int, parts long"
    chosen = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("parts"))
    stored = plain.select("id", "v").mapInArrow(deal, dealt).withColumn("block", chosen.cast("int"))
    stored = cut(stored.groupBy("level", "block").agg(F.max("length").alias("longest"), F.collect_list(F.struct("id", "v")).alias("rows")))
    # an int and a double for each of the blocks of a level: LEVELS rows
    levels = collect_bounded(stored.groupBy("level").agg(F.max("longest").alias("longest"), F.sort_array(F.collect_set("block")).alias("blocks")).select("level", "longest", F.element_at("blocks", 1).alias("first")).orderBy(F.desc("level")), LEVELS)
    longest = np.full(count, -1.0)
    for r in levels:
        longest[r.level] = r.longest
    reachable = np.maximum.accumulate(longest).tolist()
    top = stored.where((F.col("level") == levels[0].level) & (F.col("block") == levels[0].first)).select(F.explode(F.slice("rows", 1, block)).alias("r")).select("r.v").toArrow()
    sample = np.frombuffer(b"".join(top.column("v").to_pylist()), packed).reshape(-1, d).astype(float)
    turn = np.linalg.svd(sample.T @ sample / max(1.0, float(np.abs(sample).max()) ** 2))[0] if exact else np.eye(d)
    shared = session.sparkContext.broadcast(turn)
    asked = cut(plain.where("q").select("id", "v").mapInArrow(deal, dealt).select("id", "v", "length"))

    def measure(batches):
        turn = shared.value
        known: dict = {}
        last, vectors = None, None

        def side(cell) -> tuple[np.ndarray, np.ndarray]:
            ids = cell.values.field("id").to_numpy()
            return ids, np.frombuffer(b"".join(cell.values.field("v").to_pylist()), packed).reshape(-1, d).astype(float)

        for batch in batches:
            for r in range(batch.num_rows):
                cell, group = batch.column("asked")[r], (batch.column("reach")[r].as_py(), batch.column("part")[r].as_py())
                at = (batch.column("level")[r].as_py(), batch.column("block")[r].as_py())
                if at != last:
                    last, (ids, x) = at, side(batch.column("rows")[r])
                    if exact:
                        vectors = Side(ids, x, turn)
                        vectors = vectors.take(np.lexsort((ids, -vectors.length)))
                qids, q = side(cell)
                least = cell.values.field("least").to_numpy().copy()
                if exact:
                    if group in known:
                        least = np.maximum(least, known[group])
                    elif len(known) >= REMEMBERED:
                        known.pop(next(iter(known)))
                    who, vec, score = meet(Side(qids, q, turn), vectors, least, k)
                    known[group] = least
                    who, score = qids[who], score.astype(np.int64)
                else:
                    rows = [(i, v, s) for i, a in zip(qids.tolist(), q, strict=True) for s, v in _large(a, i, x, ids, k)]
                    who, vec, score = (np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else ((), (), ())))
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(vec), pa.array(score)], names=["query_id", "vec_id", "score"])

    def ranked(found: DataFrame) -> DataFrame:
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")).where(F.col("rank") <= k)

    found, high, spent = None, count, []
    for width in (*ROUNDS, count):
        low = max(0, high - width)
        if low == high or not (longest[low:high] >= 0).any():
            high = low
            continue
        here = asked.withColumn("least", F.lit(-math.inf))
        if found is not None and exact:
            least = ranked(found).groupBy("query_id").agg(F.min("score").cast("double").alias("kth"), F.count(F.lit(1)).alias("held"))
            least = least.select(F.col("query_id").alias("id"), F.when(F.col("held") >= k, F.col("kth")).otherwise(-math.inf).alias("kth"))
            here = asked.join(least, "id", "left").withColumn("least", F.coalesce("kth", F.lit(-math.inf))).drop("kth")
        # levels of this round whose longest vector cannot reach the query's k-th best, the lowest ones
        short = F.filter(F.lit(reachable[low:high]), lambda m: F.col("length") * m * (1 + 1e-9) + 0.5 < F.col("least"))
        reach = low + F.size(short) if exact else F.lit(low)
        here = cut(here.withColumn("reach", reach).where(F.col("reach") < high))
        per = here.groupBy("reach").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("parts"))
        spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("parts")).cast("int")
        groups = here.join(F.broadcast(per), "reach").withColumn("part", spread)  # a row for each level of the round
        groups = groups.groupBy("reach", "part").agg(F.sort_array(F.collect_list(F.struct("id", "v", "least"))).alias("asked"))
        groups = groups.withColumn("level", F.explode(F.sequence("reach", F.lit(high - 1))))
        blocks = F.sequence(F.lit(0), F.element_at(F.lit(parts.tolist()), F.col("level") + 1).cast("int") - 1)
        met = groups.select("reach", "part", "asked", "level", F.explode(blocks).alias("block")).join(stored.select("level", "block", "rows"), ["level", "block"])
        got = cut(met.mapInArrow(measure, "query_id long, vec_id long, score long"))
        found = got if found is None else found.unionByName(got)
        spent += [here]
        high = low
    out = ranked(found).select(F.col("query_id").cast(kind).alias("query_id"), "rank", F.col("vec_id").cast(kind).alias("vec_id"), "score")
    drop(*spent, asked, stored)
    return out
