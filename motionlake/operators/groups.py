"""Functions over one key at a time, on rows that are dealt by key and sorted.

Many small keys share an Arrow batch, so that a key costs no round of its own between Spark and Python.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def dealt(df: DataFrame, key: str, *order) -> DataFrame:
    """The rows, a key's in one task and in order.

    They go to spark.sql.shuffle.partitions tasks, however few bytes they have: the hash of the key is
    not the key, so that neither an earlier shuffle by it nor the joining of small partitions, which
    count bytes and not work, comes in between.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, F.xxhash64(key)).sortWithinPartitions(key, *order)


#: Rows whose keys are folded together, if these are smaller.
GATHERED = 50_000


def by_key(df: DataFrame, key: str, order: list, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """The rows that ``f`` makes of each key's rows, which come in order; rows with a null key are left out."""
    return by_keys(df, key, order, lambda parts: [f(p) for p in parts], schema, gathered=0)


def by_keys(df: DataFrame, key: str, order: list, f: Callable[[list], list], schema: str, gathered: int = GATHERED, arrays: bool = False) -> DataFrame:
    """The same for functions that take the rows of several keys, each whole and of its own, for work that arrays share.

    What they return are frames, or columns as lists by their names.  With ``arrays`` they take columns as arrays by
    their names, which costs less than frames where keys are many and small.
    """

    def together(parts: list) -> dict[str, list]:
        parts = [p if isinstance(p, dict) else {c: p[c].tolist() for c in p.columns} for p in parts]
        parts = [p for p in parts if any(map(len, p.values()))]
        return {c: [v for p in parts for v in p[c]] for c in parts[0]} if parts else {}

    def whole(held: list):
        if arrays:
            return {c: np.concatenate([h[c] for h in held]) for c in held[0]} if len(held) > 1 else held[0]
        return pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)

    def stream(batches):
        held: list = []  # of the last key, which may go on
        ready: list = []
        rows, last = 0, None
        for batch in batches:
            if not len(batch):
                continue
            if arrays:
                columns = {c: v.to_numpy(zero_copy_only=False) for c, v in zip(batch.schema.names, batch.columns, strict=True)}
                keys = columns[key]
            else:
                keys = batch[key].to_numpy()
            begins = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(begins, begins[1:], strict=False):
                if held and last != keys[a]:
                    ready.append(whole(held))
                    held = []
                last = keys[a]
                held.append({c: v[a:b] for c, v in columns.items()} if arrays else batch.iloc[a:b])
                rows += b - a
            if ready and rows >= gathered:
                found, ready, rows = together(f(ready)), [], 0
                if found:
                    yield made(found)
        if held:
            ready.append(whole(held))
        if ready and (found := together(f(ready))):
            yield made(found)

    def made(found: dict[str, list]):
        if not arrays:
            return pd.DataFrame(found)
        return pa.RecordBatch.from_arrays([pa.array(found[x.name], x.type, from_pandas=True) for x in to_arrow_schema(kinds)], schema=to_arrow_schema(kinds))

    kinds = StructType.fromDDL(schema) if arrays else None
    rows = dealt(df.where(F.col(key).isNotNull()), key, *order)
    return rows.mapInArrow(stream, schema) if arrays else rows.mapInPandas(stream, schema)
