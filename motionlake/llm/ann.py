"""Nearest neighbours by inverted lists and an adaptive scan of rotated dimensions.

Vectors are dealt to lists by the nearest of some centres.  Within a probed list, rotated vectors
are scanned column block by column block; after each block the partial distance is tested against
the k-th distance so far, and candidates that are too far with high confidence are left behind.
What is left is measured exactly, on the original vectors, in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import INTEGERS, cut, id_type, numbered

#: Rows and bytes that centres and probes are fitted on at most, centres at most, vectors and queries in a block.
SAMPLE, SAMPLE_BYTES, LISTS, BLOCK, QUERY_BLOCK = 20_000, 128 << 20, 4096, 4096, 256
#: Dimensions of a column block, and the confidence parameter of the test.
COLUMNS, EPSILON = 16, 2.1


def usable(vector: Column) -> Column:
    """Vectors without null or non-finite components that are not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def centres(sample: np.ndarray, count: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Lloyd's method from distinct sample rows."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    c = distinct[rng.permutation(len(distinct))[:count]].copy()
    for _ in range(rounds):
        near = nearest(sample, c, 1)[:, 0]
        size = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Indexes of the n nearest centres of each row, nearest first."""
    out = []
    for lo in range(0, len(x), 2048):
        d = (c**2).sum(axis=1) - 2 * x[lo : lo + 2048] @ c.T
        out.append(np.argmin(d, axis=1)[:, None] if n == 1 else np.argsort(d, axis=1, kind="stable")[:, :n])
    return np.concatenate(out) if out else np.zeros((0, n), np.int64)


def probes_for(sample: np.ndarray, c: np.ndarray, k: int, recall: float, queries: int = 300) -> int:
    """The fewest lists that hold ``recall`` of the k nearest, for some rows of the sample."""
    q = sample[:queries]
    if len(sample) < 2:
        return len(c)
    d = (sample**2).sum(axis=1) - 2 * q @ sample.T
    d[np.arange(len(q)), np.arange(len(q))] = np.inf
    best = np.argsort(d, axis=1)[:, : min(k, len(sample) - 1)]
    order = nearest(q, c, len(c))
    rank = np.empty_like(order)
    rank[np.arange(len(q))[:, None], order] = np.arange(len(c))
    ranks = np.sort(rank[np.arange(len(q))[:, None], nearest(sample, c, 1)[:, 0][best]].ravel())
    return int(ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)))]) + 1


def scan(query: np.ndarray, rotated_query: np.ndarray, vectors: np.ndarray, rotated: np.ndarray, ids: np.ndarray, own: int, k: int, work: list[int] | None = None) -> list[tuple[int, float]]:
    """The k nearest ids of a block with their exact distances, nearest first, ties to the smaller id.

    The bound is the k-th distance over distinct ids, each at its nearest row so far, so that rows
    which repeat an id do not tighten it.  ``work`` gathers how many components are looked at.
    """
    n, d = rotated.shape
    bound, kept, held, holds = np.inf, [], np.zeros(0), ids[:0]
    first = max(4 * k, 64)
    for lo in range(0, n, first if n <= first else 512):
        at = np.arange(lo, min(n, lo + (first if n <= first else 512)))
        at = at[ids[at] != own]
        part = np.zeros(len(at))
        for a in range(0, d, COLUMNS):
            b = min(d, a + COLUMNS)
            if work is not None:
                work[0] += len(at) * (b - a)
            part += ((rotated[at, a:b] - rotated_query[a:b]) ** 2).sum(axis=1)
            if b < d and np.isfinite(bound):
                near = part <= bound * (b / d) * (1 + EPSILON / math.sqrt(b)) ** 2
                at, part = at[near], part[near]
        kept.append(at)
        held, holds = np.concatenate([held, part]), np.concatenate([holds, ids[at]])
        order = np.argsort(held, kind="stable")
        order = order[np.sort(np.unique(holds[order], return_index=True)[1])[:k]]
        held, holds = held[order], holds[order]
        if len(held) == k:
            bound = held[-1] * (1 + 1e-9) + 1e-300
    at = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    exact = np.sqrt(((vectors[at] - query) ** 2).sum(axis=1))
    order = np.lexsort((ids[at], exact))
    out, seen = [], set()
    for o in order:
        i = int(ids[at[o]])
        if i not in seen:
            seen.add(i)
            out.append((i, float(exact[o])))
            if len(out) == k:
                break
    return out


def search(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, recall: float = 0.98, seed: int = 3) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that ``queries`` picks.

    Score is the Euclidean distance of the original vectors in double precision; rank starts at 1,
    ties go to the smaller id.  A query's own id is no candidate of it; rows that repeat an id count
    as one candidate, at the nearest of them.  Vectors that are null or zero, hold null or non-finite
    components, have a null id or another length than the commonest take no part.

    Centres (the root of the row count, at most LISTS) and the number of probed lists, the fewest
    that reach ``recall`` there, come from at most SAMPLE ids and SAMPLE_BYTES, one row of each; every row is indexed.  Lists are cut
    into blocks of about BLOCK rows and queries into blocks of QUERY_BLOCK, and blocks meet blocks,
    so that no list, however large, is gathered in one task.  An empty table gives no rows.  Ids that
    are no integers are numbered in their order first.
    """
    session = vectors.sparkSession
    kind = id_type(vectors, id_col)
    if kind not in INTEGERS:
        names = numbered(vectors, id_col)
        own = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), queries.alias("q")).join(names, "id").select("number", "v", "q")
        found = search(own, F.col("q"), "number", "v", k, recall, seed)
        for c in ("query_id", "vec_id"):
            found = found.join(names.select(F.col("number").alias(c), F.col("id").alias(f"own_{c}")), c)
        return found.select(F.col("own_query_id").alias("query_id"), "rank", F.col("own_vec_id").alias("vec_id"), "score")
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), queries.cast("boolean").alias("q")).where(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = plain.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    schema = f"query_id {kind}, rank int, vec_id {kind}, score double"
    if not sizes:
        return session.createDataFrame([], schema)
    d, n = sizes[0]
    plain = plain.where(F.size("v") == d)
    # of the ids with the least hashes one row each: half as many again as SAMPLE if no id repeats
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * d)))
    hashed = plain.select("v", F.xxhash64("id", F.lit(seed)).alias("h"), "id").where(F.col("h") <= min(2**63 - 1, -(2**63) + 3 * most * 2**63 // n))
    sample = hashed.groupBy("h", "id").agg(F.min("v").alias("v")).orderBy("h", "id").limit(most).select("v").toArrow()
    if not sample.num_rows:  # few ids, all with greater hashes
        sample = plain.select(F.min("v").alias("v")).toArrow()
    sample = np.concatenate([x.flatten().to_numpy() for x in sample.column("v").chunks if len(x)]).reshape(-1, d)
    middle = centres(sample, min(LISTS, max(1, math.isqrt(n))), seed=seed)
    # even the smallest lists together hold k others, so that no query goes short
    held = np.cumsum(np.sort(np.bincount(nearest(sample, middle, 1)[:, 0], minlength=len(middle))))
    probes = min(len(middle), max(probes_for(sample, middle, k, recall), int(np.searchsorted(held, k, "right")) + 1))
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
    shared = session.sparkContext.broadcast((middle, rotation))

    def deal(batches):
        c, _ = shared.value
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            near = nearest(x, c, 1)[:, 0]
            ask = batch.column("q").fill_null(False).to_numpy(zero_copy_only=False)
            probe: list = [[]] * len(x)
            for row, lists in zip(np.flatnonzero(ask).tolist(), nearest(x[ask], c, probes).tolist(), strict=True):
                probe[row] = lists
            packed = pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), packed, pa.array(near.astype(np.int32)), pa.array(probe, pa.list_(pa.int32()))], names=["id", "v", "list", "probes"])

    dealt = cut(plain.mapInArrow(deal, "id long, v binary, list int, probes array<int>").withColumn("row", F.monotonically_increasing_id()))
    counts = dealt.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    stored = dealt.join(F.broadcast(counts), "list").select("list", F.pmod(F.xxhash64("row"), "blocks").cast("int").alias("block"), "id", "v")  # at most LISTS rows
    stored = stored.groupBy("list", "block").agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    asked = dealt.where(F.size("probes") > 0).select("id", "v", "row", F.explode("probes").alias("list"))
    asks = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("parts"))
    asked = asked.join(F.broadcast(asks), "list").join(F.broadcast(counts), "list")
    # a query meets each block of a probed list
    asked = asked.groupBy("list", F.pmod(F.xxhash64("row"), "parts").alias("part"), "blocks").agg(F.collect_list(F.struct("id", "v")).alias("asked"))
    asked = asked.select("list", "asked", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def measure(batches):
        _, turn = shared.value
        for batch in batches:
            for r in range(batch.num_rows):
                found = []
                sides = []
                for name in ("rows", "asked"):
                    cell = batch.column(name)[r].values
                    sides.append((cell.field("id").to_numpy(), np.frombuffer(b"".join(cell.field("v").to_pylist()), np.float64).reshape(-1, d)))
                (ids, x), (qids, q) = sides
                xr, qr = x @ turn, q @ turn
                for i, a, b in zip(qids.tolist(), q, qr, strict=True):
                    found += [(i, j, s) for j, s in scan(a, b, x, xr, ids, i, k)]
                cols = list(zip(*found, strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    met = asked.join(stored, ["list", "block"]).select("rows", "asked")
    found = met.mapInArrow(measure, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select(F.col("query_id").cast(kind).alias("query_id"), "rank", F.col("vec_id").cast(kind).alias("vec_id"), "score")
