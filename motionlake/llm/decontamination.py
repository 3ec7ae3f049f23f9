"""Benchmark passages in training documents: n-gram seeds, then Smith-Waterman alignment."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .alignment import MATCH, GramIndex, code_points, local_alignment
from .common import TooLarge, collect_bounded, id_type
from .textvec import PLAIN_WORDS, ngrams, slices, text_buffers, words

#: Bytes of benchmark text that are broadcast at a time; more are searched in blocks, a pass each.
BLOCK_BYTES = 16 << 20
#: Rows of benchmark in a block, and bytes of an item, at most.
BLOCK_ROWS, ITEM_BYTES = 200_000, 256 << 20
#: A gram is rare that at most so many documents have, or this share of all.
RARE_DOCUMENTS, RARE_SHARE = 1000, 0.001
#: Seed hits that are expanded to items at a time.
_HITS_AT_A_TIME = 4_000_000


def _hashed(items: list[tuple[int, str]], n: int):
    data, offsets = text_buffers(pa.array([t for _, t in items], pa.string()))
    w = words(data, offsets, PLAIN_WORDS)
    return [(i, w.h[a:b]) for (i, _), a, b in zip(items, w.ptr[:-1].tolist(), w.ptr[1:].tolist(), strict=True) if b > a]


def _grams(item: np.ndarray, n: int) -> np.ndarray:
    """n-gram hashes of an item; one shorter than n words is a single gram of its own length."""
    n = min(n, len(item))
    return ngrams(item, np.array([0, len(item)]), n)[0]


def _blocks(benchmark: DataFrame, block_bytes: int):
    """Lists of (item, text): all of ``benchmark``, dealt by item and text, each list of a checked size."""
    size = F.octet_length("text")
    total, rows, most = benchmark.agg(F.coalesce(F.sum(size), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max(size), F.lit(0))).first()
    if most > ITEM_BYTES:
        raise TooLarge(f"an item has over {ITEM_BYTES} bytes")
    count = max(1, math.ceil(total / block_bytes), math.ceil(rows / BLOCK_ROWS))
    part = lambda n: F.pmod(F.xxhash64("item", "text"), F.lit(n))
    while count > 1:
        heavy = benchmark.groupBy(part(count)).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n")).where(f"n > {BLOCK_ROWS} or bytes > {2 * block_bytes + most}")
        if heavy.isEmpty():
            break
        count *= 2
    for k in range(count):
        block = benchmark if count == 1 else benchmark.where(part(count) == k)
        yield [(r.item, r.text) for r in collect_bounded(block.select("item", "text"), BLOCK_ROWS)]


def _ranges(doc: np.ndarray, item: np.ndarray, first: np.ndarray, last: np.ndarray, size: np.ndarray):
    """Hits, or ranges of hits, of one document and item put together where they are less than two lengths of the item apart."""
    order = np.lexsort((first, item, doc))
    doc, item, first, last = doc[order], item[order], first[order], last[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (first[1:] - last[:-1] > 2 * size[item[1:]])
    at = np.flatnonzero(fresh)
    end = np.append(at, len(doc))[1:] - 1
    return doc[at], item[at], first[at], last[end]


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    seed_words: int = 3,
    rare_documents: int | None = None,
    min_score: float = 0.5,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(id, item_id, score, matched_words, start, end): the best alignment of an item with a document.

    Words are runs of letters and digits, with A-Z lower-cased.  An item's ``seed_words``-grams are
    seeds if they are rare, that is in at most ``rare_documents`` documents of the corpus (by default
    the greater of RARE_DOCUMENTS and RARE_SHARE of all), counted over all of it, and the rarer half
    of them, eight at least, whatever their counts, so that an item that very many documents copy keeps
    its seeds.  A copy without any intact seed is not found.  Where seeds hit, the document's words around them are
    aligned with the item's; score is the alignment score over that of a full match.  Rows have
    score >= ``min_score``; start and end are code points.

    Items shorter than ``seed_words`` words are their own seed.  Null and empty texts have no
    passage.  Rows are independent: repeated ids give repeated rows, a null id stays null; items
    with a null id are found too, and rows that repeat item and text count once; items of equal words
    are aligned once.  Empty tables give no rows.  The benchmark is searched in blocks
    of checked size, each broadcast; documents are never shuffled, so no key can be hot.
    """
    session = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    bench = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text is not null").distinct()
    found, kind = None, bench.schema["item"].dataType
    if rare_documents is None:
        rare_documents = max(RARE_DOCUMENTS, int(RARE_SHARE * docs.count()))
    for rows in _blocks(bench, block_bytes):
        same: dict[bytes, tuple[list, np.ndarray]] = {}
        for name, w in _hashed(rows, seed_words):
            same.setdefault(w.tobytes(), ([], w))[0].append(name)
        items = list(same.values())
        lengths = sorted({min(seed_words, len(w)) for _, w in items})
        every = [_grams(w, seed_words) for _, w in items]
        keys = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
        counts = _document_counts(session, plain, keys, lengths)
        rare = []
        for g in every:
            own = counts[np.searchsorted(keys, g)]
            order = np.lexsort((g, own))
            rare.append(np.sort(order[: max(8, (len(g) + 1) // 2, int((own <= rare_documents).sum()))]))
        index = GramIndex(
            np.concatenate([g[r] for g, r in zip(every, rare, strict=True)]) if every else keys,
            np.repeat(np.arange(len(items)), [len(r) for r in rare]),
            np.concatenate(rare) if rare else np.zeros(0, np.int64),
        )
        part = _align(session, plain, kind, items, index, lengths, min_score)
        found = part if found is None else found.unionByName(part)
    return found


def _document_counts(session, plain: DataFrame, keys: np.ndarray, lengths: list[int]) -> np.ndarray:
    """In how many documents each gram occurs."""
    shared = session.sparkContext.broadcast(keys)

    def count(batches):
        index = GramIndex(shared.value, np.arange(len(shared.value)), np.zeros(len(shared.value), np.int64))
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(*text_buffers(part.column("text")), PLAIN_WORDS)
                doc = np.repeat(np.arange(part.num_rows), np.diff(w.ptr))
                for n in lengths:
                    grams, inside = w.shingles(n)
                    at, key = index.find(grams)
                    at, key = at[inside[at]], key[inside[at]]
                    pairs = np.unique(doc[at] * len(total) + key)
                    total += np.bincount(pairs % len(total), minlength=len(total)) if len(total) else 0
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["key", "docs"])

    out = np.zeros(len(keys), np.int64)
    counted = plain.select("text").mapInArrow(count, "key long, docs long").groupBy("key").agg(F.sum("docs").alias("docs"))
    rows = counted.toArrow()  # two numbers for each gram of a block at most
    out[rows.column("key").to_numpy()] = rows.column("docs").to_numpy()
    return out


def _align(session, plain: DataFrame, kind: DataType, items, index: GramIndex, lengths: list[int], min_score: float) -> DataFrame:
    shared, names = session.sparkContext.broadcast((items, index)), to_arrow_type(kind)

    def align(batches):
        items, index = shared.value
        size = np.array([len(w) for _, w in items], np.int64)
        vocabulary: dict[int, tuple] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_buffers(part.column("text"))
                w = words(data, offsets, PLAIN_WORDS)
                hits = [(np.zeros(0, np.int64),) * 2]
                for n in lengths:
                    grams, inside = w.shingles(n)
                    at, key = index.find(grams)
                    hits.append((at[inside[at]], key[inside[at]]))
                at, key = (np.concatenate(x) for x in zip(*hits, strict=True))
                order = np.argsort(at, kind="stable")
                at, key = at[order], key[order]
                # so many hits at a time, from left to right
                total, lo, found = np.cumsum(index.last[key] - index.first[key]), 0, [(np.zeros(0, np.int64),) * 4]
                while lo < len(at):
                    hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + _HITS_AT_A_TIME, "right")))
                    place, item, _ = index.expand(at[lo:hi], key[lo:hi])
                    found.append(_ranges(np.searchsorted(w.ptr, place, "right") - 1, item, place, place, size))
                    lo = hi
                doc, item, first, last = _ranges(*(np.concatenate(x) for x in zip(*found, strict=True)), size)
                best: dict[tuple[int, int], tuple] = {}
                for d, k, a, b in zip(doc.tolist(), item.tolist(), first.tolist(), last.tolist(), strict=True):
                    reach = 2 * int(size[k])
                    lo, hi = max(int(w.ptr[d]), a - reach), min(int(w.ptr[d + 1]), b + reach)
                    # no alignment matches more words than item and text have in common
                    if k not in vocabulary:
                        vocabulary[k] = np.unique(items[k][1], return_counts=True)
                    known, count = vocabulary[k]
                    key = np.minimum(np.searchsorted(known, w.h[lo:hi]), len(known) - 1)
                    common = np.bincount(key[known[key] == w.h[lo:hi]], minlength=len(known))
                    if np.minimum(common, count).sum() < min_score * size[k]:
                        continue
                    score, matched, s, e = local_alignment(items[k][1], w.h[lo:hi])
                    if score >= min_score * MATCH * size[k] and score > best.get((d, k), (0,))[0]:
                        best[d, k] = score, matched, lo + s, lo + e
                ids = part.column("id").to_pylist()
                out = []
                for (d, k), (score, matched, s, e) in sorted(best.items()):
                    text = data[offsets[d] : offsets[d + 1]]
                    start, end = code_points(text, [int(w.start[s] - offsets[d]), int(w.end[e - 1] - offsets[d])])
                    out += [(ids[d], name, score / (MATCH * int(size[k])), matched, start, end) for name in items[k][0]]
                cols = list(zip(*out, strict=True)) or [()] * 6
                kinds = [part.column("id").type, names, pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["id", "item_id", "score", "matched_words", "start", "end"])

    return plain.mapInArrow(align, f"id {id_type(plain, 'id')}, item_id {kind.simpleString()}, score double, matched_words long, start long, end long")
