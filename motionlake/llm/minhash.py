"""Near-duplicate documents by tensored MinHash banding with exact confirmation.

Two small collections of ``bands`` sub-keys, each folded from ``rows`` minhashes, are combined pair by
pair into ``bands`` squared table keys of ``2 * rows`` minhashes: 2 * bands * rows hash functions do
the work of 2 * bands**2 * rows.  A pair of similarity s shares a table unless it misses all of one
collection, so it is found with probability (1 - (1 - s**rows)**bands)**2: 0.9985 at s = 0.8, 0.99998
at 0.9 with the defaults.  Candidates are confirmed on the full shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import INTEGERS, cut, drop, id_type, join_hot, numbered
from .components import connected_components
from .textvec import SPACE_WORDS, mix, ngrams, slices, text_buffers, words

#: Cross-component pairs of one bucket that are listed; larger buckets go by rare shingles.
LISTED = 4096
#: Bits of a set's parity sketch.
SKETCH = 1024
_BLOCK = 2048


def shingle_sets(column: pa.Array, n: int):
    """Sorted 64-bit hashes of the distinct n-word shingles of each text, in order.

    A text of fewer words is one shingle; null, empty and blank texts have none.
    """
    data, offsets = text_buffers(column)
    found = words(data, offsets, SPACE_WORDS)
    grams, _ = ngrams(found.h, found.ptr, n)
    for a, b in zip(found.ptr[:-1].tolist(), found.ptr[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            whole, _ = ngrams(found.h[a:b], np.array([0, b - a]), b - a)
            yield mix(whole + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def _functions(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, size=count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a[:, None], rng.integers(0, 1 << 63, size=count, dtype=np.uint64)[:, None]


def _minhashes(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    least = (a * x[:_BLOCK] + b).min(axis=1)
    for lo in range(_BLOCK, len(x), _BLOCK):
        np.minimum(least, (a * x[lo : lo + _BLOCK] + b).min(axis=1), out=least)
    return least


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int, seed: int) -> DataFrame:
    """(id, n, hi, lo, a, b, sketch): set size, 128-bit digest of the set, the two collections of
    sub-keys, and for SKETCH bits whether an odd number of the set's members fall there."""
    count = 2 * bands * rows

    def sign(batches):
        a, b = _functions(count, seed)
        odd = np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            for part in slices(batch, "text"):
                size, digest, keys, sketch = [], [], [], []
                for x in shingle_sets(part.column("text"), n):
                    size.append(len(x))
                    digest.append((int(mix(x ^ odd).sum(dtype=np.uint64)), int(mix(x + odd).sum(dtype=np.uint64))) if len(x) else (0, 0))
                    keys.append(_minhashes(x, a, b) if len(x) else np.zeros(count, np.uint64))
                    sketch.append(np.packbits((np.bincount((x & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).astype(np.uint8)))
                m = np.stack(keys).reshape(len(keys), 2 * bands, rows)
                folded = m[:, :, 0]
                for k in range(1, rows):
                    folded = mix(folded * odd + m[:, :, k])
                as_list = lambda v: pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(v).view(np.int64).ravel()), v.shape[1] * v.itemsize // 8).cast(pa.list_(pa.int64()))
                d = np.array(digest, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(size, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), as_list(folded[:, :bands]), as_list(folded[:, bands:]), as_list(np.stack(sketch))],
                    names=["id", "n", "hi", "lo", "a", "b", "sketch"],
                )

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(sign, "id long, n long, hi long, lo long, a array<long>, b array<long>, sketch array<long>")


def _may_link(x: str, y: str, percent: int) -> Column:
    """Necessary for a link: sketches differ in as many bits at most as sets of these sizes may.

    Each bit that differs needs a member of its own in the symmetric difference, which for a link
    is at most (100 - percent) / (100 + percent) of the sum of both sizes.
    """
    apart = f"aggregate(zip_with({x}.sketch, {y}.sketch, (p, q) -> bit_count(p ^ q)), 0, (t, v) -> t + v)"
    return F.expr(f"greatest(abs({x}.n - {y}.n), {apart}) * {100 + percent} <= {100 - percent} * ({x}.n + {y}.n)")


def _confirm(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (x, y) whose full shingle sets have 100 * |common| >= percent * |union|."""

    def check(batches):
        for batch in batches:
            for part in slices(batch, "tx", 2 << 20):
                sets = {}

                def of(side, part=part, sets=sets):
                    ids = part.column(side).to_pylist()
                    column = part.column("t" + side)
                    rows = [k for k, i in enumerate(ids) if (side, i) not in sets or side == "x"]
                    fresh = dict(zip(rows, shingle_sets(column.take(pa.array(rows, pa.int64())), n), strict=True)) if rows else {}
                    return [fresh[k] if k in fresh else sets[(side, ids[k])] for k in range(len(ids))]

                good = []
                for p, q in zip(of("x"), of("y"), strict=True):
                    common = len(np.intersect1d(p, q, assume_unique=True)) if 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)) else 0
                    good.append(common > 0 and 100 * common >= percent * (len(p) + len(q) - common))
                yield pa.RecordBatch.from_arrays([part.column("x"), part.column("y")], names=["x", "y"]).filter(pa.array(good, pa.bool_()))

    left = texts.select(F.col("id").alias("x"), F.col("text").alias("tx"))
    right = texts.select(F.col("id").alias("y"), F.col("text").alias("ty"))
    held = pairs.join(left, "x").join(right, "y").select("x", "y", "tx", "ty")
    return held.mapInArrow(check, "x long, y long").distinct()


def _sifted(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) that may be linked for all their sketches say."""
    side = lambda c: sketches.select(F.col("id").alias(c), F.struct("n", "sketch").alias(f"s{c}"))
    return pairs.join(side("x"), "x").join(side("y"), "y").where(_may_link("sx", "sy", percent)).select("x", "y").distinct()


def _cross_pairs(rows: DataFrame, sketches: DataFrame, listed: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of ids under one key, in different components, that may be linked; the rows of keys with too many.

    The commonest component of a key is never paired with itself: its rows meet only those of the
    others, so a large group of copies under a key adds one pair for each outsider and copy.
    """
    per = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    keys = per.groupBy("key").agg(F.max("c").alias("top"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    doms = join_hot(per, keys, "key").where("c = top").groupBy("key", "top", "all").agg(F.min("comp").alias("dom"))
    rows = cut(join_hot(rows, doms, "key"))
    few, many = rows.where(F.expr(f"(all - top) * all <= {listed}")), rows.where(F.expr(f"(all - top) * all > {listed}"))
    few = few.join(sketches.select("id", F.struct("n", "sketch").alias("s")), "id")
    x = few.where("comp <> dom").select("key", F.col("id").alias("x"), F.col("comp").alias("cx"), F.col("s").alias("sx"))
    y = few.select("key", F.col("id").alias("y"), F.col("comp").alias("cy"), "dom", F.col("s").alias("sy"))
    pairs = x.join(y, (x["key"] == y["key"]) & F.expr("cx <> cy and (cy = dom or x < y)") & _may_link("sx", "sy", percent))
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), many.select("key", "id", "comp")


def _rare_shingle_rows(ids: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(key, id): the shingles of each id of which two similar sets share one at least.

    Shingles are ordered by their count among the ids, rarest first; of a set of size s, all but
    the last ceil(percent * s / 100) - 1 are kept.  Sharing none proves the similarity too low.
    """

    def explode(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                for i, x in zip(part.column("id").to_pylist(), shingle_sets(part.column("text"), n), strict=True):
                    for lo in range(0, len(x), 1 << 16):
                        k = x[lo : lo + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), i)), pa.array(k.view(np.int64)), pa.array(np.full(len(k), len(x)))], names=["id", "key", "n"])

    grams = cut(ids.join(texts, "id").select("id", "text").mapInArrow(explode, "id long, key long, n long").distinct())
    counts = grams.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    ranked = join_hot(grams, counts, "key").where("df > 1")
    # a shingle that only one id has never joins, but takes its place in the prefix
    lone = join_hot(grams, counts.where("df = 1"), "key").groupBy("id").agg(F.count(F.lit(1)).alias("lone"))
    ranked = ranked.join(lone, "id", "left").withColumn("lone", F.coalesce("lone", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "key")) + F.col("lone")
    keep = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return ranked.withColumn("place", place).where(F.col("place") <= keep).select("key", "id")


def _joined(comps: DataFrame, extra: DataFrame) -> DataFrame:
    """Components (id, component) once the links ``extra`` tie them together: only these links are contracted again."""
    ends = extra.select(F.col("u").alias("id")).unionByName(extra.select(F.col("v").alias("id"))).distinct()
    every = comps.unionByName(ends.join(comps, "id", "left_anti").select("id", F.col("id").alias("component")))
    mapped = extra
    for c in ("u", "v"):
        mapped = mapped.join(every.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")), c)
    merged = connected_components(mapped.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
    merged = merged.select(F.col("id").alias("component"), F.col("component").alias("least"))
    return join_hot(every, merged, "component", "left").select("id", F.coalesce("least", "component").alias("component"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    percent: int = 80,
    bands: int = 10,
    rows: int = 3,
    seed: int = 7,
    listed: int = LISTED,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of ``docs``.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a document's set holds its
    distinct ``shingle_words``-word shingles, or its whole sequence as one if it has fewer words.
    Two ids are linked if rows of theirs have sets with 100 * common >= ``percent`` * union.

    * Equal sets are one class, named by its smallest id: copies are never paired.
    * Table keys are grouped with pre-aggregation; each class is confirmed against one class under
      each of its keys, and components follow from those links.
    * Parity sketches of the sets rule out pairs that cannot be linked before any text moves.
    * Only pairs whose components still differ can change the result.  They are listed key by key,
      or, where a key has more than ``listed``, by an exact prefix filter on rare shingles.

    Null, empty and blank texts have no shingles and are linked with nothing.  Rows that repeat an
    id are one vertex.  A null id keeps its own row: n_shingles is counted, component_id is null and
    kept false.  Other columns are ignored; an empty table gives no rows.  Ids keep their type; those
    that are no integers are numbered in their order first.
    """
    kind = id_type(docs, id_col)
    if kind not in INTEGERS:
        names = numbered(docs, id_col)
        plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(names, "id", "left").select("number", "text")
        found = near_duplicates(plain, "number", "text", shingle_words, percent, bands, rows, seed, listed)
        found = found.join(names.select(F.col("number").alias("id"), F.col("id").alias("own")), "id", "left")
        found = found.join(names.select(F.col("number").alias("component_id"), F.col("id").alias("least")), "component_id", "left")
        return found.select(F.col("own").alias("id"), "n_shingles", F.col("least").alias("component_id"), "kept")
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signs = cut(signatures(docs, id_col, text_col, shingle_words, bands, rows, seed))
    real = signs.where("n > 0 and id is not null")
    classes = cut(real.groupBy("hi", "lo").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"), F.first("sketch").alias("sketch")))
    # a table key that two classes share has both halves shared: the others never make a key
    halves = classes.select("rep", F.posexplode(F.concat("a", "b")).alias("t", "p")).select("rep", "t", F.xxhash64("t", "p").alias("half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("half")
    halves = join_hot(halves, shared, "half").groupBy("rep").agg(F.collect_list(F.struct("t", "half")).alias("halves"))
    side = lambda low: F.filter("halves", lambda h: (h["t"] < bands) if low else (h["t"] >= bands))
    keyed = halves.select("rep", side(False).alias("b"), F.explode(side(True)).alias("x")).select("rep", "x", F.explode("b").alias("y"))
    # each band ranks ids in an order of its own, so that a class meets several heads of its group
    order = np.random.default_rng(seed).integers(-(1 << 63), 1 << 63, size=bands).tolist()
    salt = F.element_at(F.array(*map(F.lit, order)), F.col("x.t") + 1)
    keyed = keyed.select(F.xxhash64("x.half", "y.half").alias("key"), F.col("rep").bitwiseXOR(salt).alias("rank"), F.col("rep").alias("id"))
    heads = keyed.groupBy("key").agg(F.min("rank").alias("least"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = cut(join_hot(keyed, heads, "key").select("key", "id", F.col("least").bitwiseXOR(F.col("rank")).bitwiseXOR(F.col("id")).alias("head"), "size"))
    sketches = classes.select(F.col("rep").alias("id"), "n", "sketch")
    # only these may be linked, and only their texts move on
    texts = cut(texts.join(members.select("id").distinct().hint("merge"), "id", "left_semi"))
    star = members.where("id <> head").select(F.least("id", "head").alias("x"), F.greatest("id", "head").alias("y")).distinct()
    star = _sifted(star, sketches, percent)
    links = cut(_confirm(star, texts, shingle_words, percent).select(F.col("x").alias("u"), F.col("y").alias("v")))


    # ids with rows of several classes tie these together
    own = real.join(classes.select("hi", "lo", "rep"), ["hi", "lo"]).select("id", "rep")
    several = own.groupBy("id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    ties = own.join(several, "id").where("rep <> low").select(F.col("rep").alias("u"), F.col("low").alias("v"))
    confirmed, links = links, cut(links.unionByName(ties))
    comps = cut(connected_components(links))

    def placed(rows_: DataFrame) -> DataFrame:
        # a component is one row beside the keys of its id, as many as there are tables at most
        both = rows_.select("key", "id", F.lit(None).cast("long").alias("c")).unionByName(comps.select(F.lit(None).cast("long").alias("key"), "id", F.col("component").alias("c")))
        return both.withColumn("comp", F.coalesce(F.max("c").over(Window.partitionBy("id")), "id")).where("key is not null").drop("c")

    inner = placed(members.where("size > 2 and id <> head").select("key", "id"))
    pairs, crowded = _cross_pairs(inner, sketches, listed, percent)
    more = [_confirm(pairs, texts, shingle_words, percent)]
    crowded_ids = cut(crowded.select("id").distinct())
    if not crowded_ids.isEmpty():
        rare = placed(_rare_shingle_rows(crowded_ids, texts, shingle_words, percent))
        pairs, _ = _cross_pairs(rare, sketches, 1 << 62, percent)
        more.append(_confirm(pairs, texts, shingle_words, percent))
    extra = more[0] if len(more) == 1 else more[0].unionByName(more[1])
    extra = cut(extra.select(F.col("x").alias("u"), F.col("y").alias("v")))
    if not extra.isEmpty():
        first, comps = comps, cut(_joined(comps, extra))
        drop(first)
    drop(members, texts, confirmed, links, extra, crowded_ids)
    of_rep = classes.select("hi", "lo", "rep").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    of_rep = of_rep.select("hi", "lo", F.coalesce("component", "rep").alias("c"))
    joined = signs.select("id", "n", "hi", "lo").join(of_rep, ["hi", "lo"], "left")
    component = F.when(F.col("id").isNull(), F.lit(None).cast("long")).when(F.col("n") == 0, F.col("id")).otherwise(F.col("c"))
    out = joined.select(F.col("id").cast(kind).alias("id"), F.col("n").alias("n_shingles"), component.cast(kind).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))

