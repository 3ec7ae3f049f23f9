"""Merkle manifest of a dataset: a digest tree for each group of rows, a root over all, a proof for every row.

Leaves of a group stand in the order of their ids.  They are cut into aligned blocks that hold some
whole levels of the tree; a block is a contiguous matrix of hex digests, a row a node, so that a run
of siblings is a row of the reshaped matrix.  The roots of the blocks are the leaves of the next
tier, until each group has one node; the groups' nodes form the last tree in the same way.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, id_type, ordered

#: Children of a node, and levels in a block: a block has at most FANOUT ** LEVELS leaves.
FANOUT, LEVELS = 8, 3
_HEX = 64
_PATH = "array<struct<before: string, after: string>>"


def leaf(*values: Column) -> Column:
    """sha256 in hex of the values, each as its byte count, a colon and its text in UTF-8; a hyphen if null."""
    parts = []
    for v in values:
        text = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _digest(*parts) -> bytes:
    h = hashlib.sha256()
    for p in parts:
        h.update(p)
    return h.hexdigest().encode()


def _matrix(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint8).reshape(-1, _HEX)


def levels(leaves: np.ndarray, fanout: int, up: int | None) -> list[np.ndarray]:
    """The levels above contiguous (n, 64) leaves, themselves first: ``up`` of them, or if None up to one node."""
    out = [leaves]
    while len(out[-1]) > 1 if up is None else len(out) <= up:
        below = out[-1]
        whole = len(below) // fanout
        found = [_digest(run) for run in below[: whole * fanout].reshape(whole, fanout * _HEX)]
        if whole * fanout < len(below):
            found.append(_digest(np.ascontiguousarray(below[whole * fanout :])))
        out.append(_matrix(found))
    return out


def walk(tree: list[np.ndarray], fanout: int, nodes: np.ndarray):
    """Per level, for all ``nodes`` (indexes of leaves): their runs as rows, the own slot in bytes, the run's size in bytes."""
    for k, level in enumerate(tree[:-1]):
        own = nodes // fanout**k
        runs = own // fanout
        padded = np.zeros((-(-len(level) // fanout) * fanout, _HEX), np.uint8)
        padded[: len(level)] = level
        yield padded.reshape(-1, fanout * _HEX)[runs], own % fanout * _HEX, np.minimum(fanout, len(level) - runs * fanout) * _HEX


def _positions(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``at``, the place within the group from 0, and ``total``, the group's size.

    Rows are sorted as a whole by ranges; a range has at most one stretch of a group, so that counts
    of the stretches give their starts.  Rows alike in every column are told apart by their place in
    the input, so that ranges may cut through them.
    """
    shuffled = rows.withColumn("__tie", F.monotonically_increasing_id())
    placed = ordered(shuffled.orderBy(group, *order, "__tie").drop("__tie")).withColumn("__row", F.monotonically_increasing_id())
    placed = placed.withColumn("__range", F.shiftright("__row", 33))
    stretches = placed.groupBy(group, "__range").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("n"))
    each = Window.partitionBy(group)  # a row for each range of a group
    before = F.coalesce(F.sum("n").over(each.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretches = stretches.withColumn("__before", before).withColumn("total", F.sum("n").over(each)).drop("n")
    return placed.join(stretches, [group, "__range"]).withColumn("at", F.col("__row") - F.col("__first") + F.col("__before")).drop("__row", "__range", "__first", "__before")


def _tiers(nodes: DataFrame, fanout: int, height: int) -> tuple[list[DataFrame], DataFrame]:
    """Tables of blocks, lowest tier first, and (group, total, at, node) with one node a group."""
    width, tiers = fanout**height, []

    def top(batches):
        for batch in batches:
            found = []
            for cell, total in zip(batch.column("items"), batch.column("total").to_pylist(), strict=True):
                found.append(levels(_leaves(cell), fanout, height if total > width else None)[-1].tobytes().decode())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("group", "total", "block", "items")), pa.array(found, pa.string())], names=["group", "total", "block", "items", "top"])

    while True:
        payload = [c for c in nodes.columns if c not in ("group", "total", "at")]
        grouped = nodes.groupBy("group", "total", F.floor(F.col("at") / width).alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", *payload))).alias("items"))
        kind = grouped.schema["items"].dataType.simpleString()
        blocks = cut(grouped.mapInArrow(top, f"group string, total long, block long, items {kind}, top string"))
        tiers.append(blocks)
        nodes = blocks.select("group", F.ceil(F.col("total") / width).alias("total"), F.col("block").alias("at"), F.col("top").alias("node"))
        if nodes.where("total > 1").isEmpty():
            return tiers, nodes


def _leaves(cell) -> np.ndarray:
    """The digests of a block's items as one matrix."""
    nodes = cell.values.field("node")
    ends = np.frombuffer(nodes.buffers()[1], np.int64 if pa.types.is_large_string(nodes.type) else np.int32)
    return np.frombuffer(nodes.buffers()[2], np.uint8)[ends[nodes.offset] : ends[nodes.offset + len(nodes)]].reshape(-1, _HEX)


def _down(tier: DataFrame, above: DataFrame, fanout: int, height: int) -> DataFrame:
    """(group, at, path, subroot, root) of a tier's items, from the paths of its blocks (group, at, ...) in ``above``."""
    width = fanout**height
    met = tier.select("group", "total", "block", F.col("items.at").alias("places"), F.transform("items", lambda x: F.struct(x["node"].alias("node"))).alias("items")).join(above.withColumnRenamed("at", "block"), ["group", "block"])

    def paths(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                cell = batch.column("items")[r]
                nodes = np.arange(len(cell.values))
                tree = levels(_leaves(cell), fanout, height if batch.column("total")[r].as_py() > width else None)
                upper = batch.column("path")[r].as_py()
                own: list[list] = [[] for _ in nodes]
                for runs, slot, size in walk(tree, fanout, nodes):
                    for k, (run, s, z) in enumerate(zip(runs, slot.tolist(), size.tolist(), strict=True)):
                        own[k].append({"before": run[:s].tobytes().decode(), "after": run[s + _HEX : z].tobytes().decode()})
                n = len(nodes)
                same = lambda c: pa.array([batch.column(c)[r].as_py()] * n, pa.string())  # noqa: B023, E731
                path = pa.array([o + upper for o in own], pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))
                yield pa.RecordBatch.from_arrays([same("group"), batch.column("places")[r].values, path, same("subroot"), same("root")], names=["group", "at", "path", "subroot", "root"])

    return met.mapInArrow(paths, f"group string, at long, path {_PATH}, subroot string, root string")


def prove(rows: DataFrame, fields: list[str], group_col: str, id_col: str, claimed: Column | None = None, fanout: int = FANOUT, height: int = LEVELS, siblings: bool = False) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified), and with ``siblings`` they themselves, for every row.

    A row's leaf is the digest of ``fields``.  The leaves of a group ascend by id, a null one first, equal
    ids by their leaves; while a level has several nodes, every ``fanout`` consecutive ones, of which the
    last may be fewer or one, become their digest, and what remains is the group's subroot.  Subroots,
    ordered bytewise by the group as text, null first, give the root likewise.  A proof is the digest of
    the siblings from the leaf's level to the root's, each run's without the own node, left to right; of
    nothing where there are none.  ``claimed`` is the leaf to be checked, as a column over ``rows``, its own
    where null or not given: folded_root is made of it and the siblings, and verified says whether that is
    the root.  Rows alike in every column are leaves of their own.  An empty table gives no rows.

    The texts are read once and never shuffled: only ids and digests are.  Sorting is by ranges, blocks
    hold at most fanout ** height leaves, and a tier is a table in the shared folder, so no group is in
    one task, however large.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))  # in the order of the groups, null first
    own = leaf(*(F.col(c) for c in fields))
    other = F.lit(None).cast("string") if claimed is None else claimed
    kind = id_type(rows, id_col)
    leaves = rows.select(key.alias("group"), F.col(id_col).alias("id"), own.alias("node"), other.alias("claimed"))
    tiers, tops = _tiers(_positions(leaves, "group", ["id", "node", "claimed"]), fanout, height)
    # the tree over the groups: one more of the same kind, of a single group
    subroots = _positions(tops.select(F.lit("").alias("group"), F.col("group").alias("of"), "node"), "group", ["of"])
    over, root = _tiers(subroots, fanout, height)
    nothing = F.array().cast(_PATH)
    above = root.select("group", "at", nothing.alias("path"), F.lit("").alias("subroot"), F.col("node").alias("root"))
    for tier in reversed(over):
        above = _down(tier, above, fanout, height)
    named = over[0].select("group", F.explode("items").alias("x")).select("group", "x.at", F.col("x.of").alias("of"), F.col("x.node").alias("own"))
    above = cut(named.join(above, ["group", "at"]).select(F.col("of").alias("group"), F.lit(0).cast("long").alias("at"), "path", F.col("own").alias("subroot"), "root"))
    spent = [*over, above]
    for tier in reversed(tiers[1:]):
        above = cut(_down(tier, above, fanout, height))
        spent.append(above)
    width = fanout**height
    met = tiers[0].join(above.withColumnRenamed("at", "block"), ["group", "block"])
    listed = ", siblings array<string>" if siblings else ""

    def fold(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                cell, upper = batch.column("items")[r], batch.column("path")[r].as_py()
                upper = [(x["before"].encode(), x["after"].encode()) for x in upper]
                matrix = _leaves(cell)
                n, nodes = len(matrix), np.arange(len(matrix))
                tree = levels(matrix, fanout, height if batch.column("total")[r].as_py() > width else None)
                proofs, met_by = [hashlib.sha256() for _ in nodes], [[] for _ in nodes]
                claims = cell.values.field("claimed").to_pylist()
                node = matrix.copy()
                for k, c in enumerate(claims):
                    if c is not None:
                        node[k] = np.frombuffer(c.encode(), np.uint8)
                for runs, slot, size in walk(tree, fanout, nodes):
                    for run, s, z, proof, seen in zip(runs, slot.tolist(), size.tolist(), proofs, met_by, strict=True):
                        proof.update(run[:s])
                        proof.update(run[s + _HEX : z])
                        if siblings:
                            around = run[:s].tobytes() + run[s + _HEX : z].tobytes()
                            seen += [around[x : x + _HEX].decode() for x in range(0, len(around), _HEX)]
                    # the run again, with the folded node in its slot
                    runs.reshape(n, fanout, _HEX)[nodes, slot // _HEX] = node
                    node = _matrix([_digest(run[:z]) for run, z in zip(runs, size.tolist(), strict=True)])
                folded = [x.tobytes() for x in node]
                for before, after in upper:
                    folded = [_digest(before, x, after) for x in folded]
                    for proof in proofs:
                        proof.update(before + after)
                if siblings:
                    rest = [x[j : j + _HEX].decode() for pair in upper for x in pair for j in range(0, len(x), _HEX)]
                    met_by = [x + rest for x in met_by]
                same = lambda c: pa.array([batch.column(c)[r].as_py()] * n, pa.string())  # noqa: B023, E731
                root = batch.column("root")[r].as_py()
                folded = [x.decode() for x in folded]
                columns = [cell.values.field("id"), cell.values.field("node"), same("subroot"), same("root"), pa.array([p.hexdigest() for p in proofs]), pa.array(folded), pa.array([x == root for x in folded])]
                names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
                if siblings:
                    columns.append(pa.array(met_by, pa.list_(pa.string())))
                    names.append("siblings")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    found = cut(met.select("total", "items", "path", "subroot", "root").mapInArrow(fold, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean{listed}"))
    drop(*tiers, *spent)
    return found
