"""Token counts by section, field or span: one encoding of the whole document, attributed by token spans.

A byte-level vocabulary spells the text without loss, so the lengths of its tokens give the span of
each.  Spans are joined as intervals to sections of the text, to the fields that it is put together
from, or to a table of spans, and a token that crosses a boundary goes where an explicit rule says.
"""

from __future__ import annotations

import base64
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TooLarge, id_type, join_hot
from .textvec import slices

#: Bytes of a vocabulary file that are broadcast at most; segments cached in each of two generations.
VOCABULARY_BYTES, CACHED = 64 << 20, 400_000
#: What becomes of a token that crosses a boundary.
RULES = ("first", "last", "most", "share")

#: Patterns under which a space between two other characters always begins a token, so
#: that what lies between such spaces may be encoded by itself and cached.
SEGMENTED = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",)
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Spans of a document that are attributed at a time.
SPANS = 1000


class Encoder:
    """Byte length of each token of a text.

    Under a pattern of SEGMENTED the text is encoded in segments, which are cached and give the same
    tokens as the whole; under any other as a whole.
    """

    def __init__(self, blob: bytes, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines())}
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.by_segment = pattern in SEGMENTED
        self.size = [0] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.size[rank] = len(piece)
        self.young: dict[str, np.ndarray] = {}
        self.old: dict[str, np.ndarray] = {}
        self.same: dict[bytes, bytes] = {}

    def lengths(self, text: str) -> np.ndarray:
        if not self.by_segment:
            return np.array([self.size[t] for t in self.library.encode_ordinary(text)], np.int64)
        segments = _CUT.split(text) if text else []
        got = list(map(self.young.get, segments))
        if None in got:
            if len(self.young) > CACHED:
                self.old, self.young = self.young, {}
            for s in {s for s, v in zip(segments, got, strict=True) if v is None}:
                if (v := self.old.get(s)) is None:
                    size = np.array([self.size[t] for t in self.library.encode_ordinary(s)], np.uint16).tobytes()
                    v = self.same.setdefault(size, size) if len(self.same) < CACHED else size
                self.young[s] = v
            young = self.young
            got = [young[s] if v is None else v for s, v in zip(segments, got, strict=True)]
        return np.frombuffer(b"".join(got), np.uint16)


def attribute(sizes: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross one of its boundaries, by ``rule``.

    Sections are byte ranges in order that do not overlap; bytes may lie in none.  ``first`` and
    ``last`` give a token to the section of its first or last byte, ``most`` to that with most of
    its bytes (of equals the earlier), ``share`` to each by its share of the bytes in sections.
    Tokens, or shares, of bytes in no section go to none; an empty section has none.
    """
    some = np.flatnonzero(ends > starts)
    if len(some) < len(starts):
        total, crossing = np.zeros(len(starts)), np.zeros(len(starts), np.int64)
        total[some], crossing[some] = attribute(sizes, starts[some], ends[some], rule)
        return total, crossing
    end = np.cumsum(sizes, dtype=np.int64)
    begin = end - sizes
    total, crossing = np.zeros(len(starts)), np.zeros(len(starts), np.int64)
    if not len(starts) or not len(sizes):
        return total, crossing
    # the sections that a token meets are lo, lo + 1, ... hi - 1
    lo, hi = np.searchsorted(ends, begin, "right"), np.searchsorted(starts, end, "left")
    inside = (hi - lo == 1) & (begin >= starts[np.minimum(lo, len(starts) - 1)]) & (end <= ends[np.minimum(lo, len(starts) - 1)])
    np.add.at(total, lo[inside], 1.0)
    for t in np.flatnonzero(~inside & (hi > lo)).tolist():
        s = np.arange(lo[t], hi[t])
        held = np.minimum(end[t], ends[s]) - np.maximum(begin[t], starts[s])
        if rule == "share":
            total[s] += held / sizes[t]
            crossing[s] += 1
            continue
        if rule == "first":
            k = 0 if starts[s[0]] <= begin[t] else None
        elif rule == "last":
            k = len(s) - 1 if ends[s[-1]] >= end[t] else None
        else:
            k = int(np.argmax(held))
        if k is not None:
            total[s[k]] += 1
            crossing[s[k]] += 1
    return total, crossing


def lines(text: bytes) -> list[tuple[int, int]]:
    """Byte ranges of the lines of a text, each with its newline."""
    at = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    cuts = [0, *at.tolist(), *([len(text)] if not len(at) or at[-1] != len(text) else [])]
    return list(zip(cuts[:-1], cuts[1:], strict=True)) if text else []


def read_vocabulary(path: str) -> bytes:
    """The vocabulary file's bytes; raises TooLarge above VOCABULARY_BYTES."""
    with open(path, "rb") as f:
        blob = f.read(VOCABULARY_BYTES + 1)
    if len(blob) > VOCABULARY_BYTES:
        raise TooLarge(f"{path} has over {VOCABULARY_BYTES} bytes")
    return blob


def _attributed(encoder: Encoder, text: str, sections: list[tuple[int, int]], rule: str) -> tuple[np.ndarray, ...]:
    """(start, end, n_tokens, n_crossing, char_start, char_end) of each section, given as byte ranges in order."""
    own = np.array(sections, np.int64).reshape(-1, 2)
    raw = np.frombuffer(text.encode(), np.uint8)
    chars = np.concatenate([np.zeros(1, np.int64), np.cumsum(raw & 0xC0 != 0x80)])
    total, crossing = attribute(encoder.lengths(text), own[:, 0], own[:, 1], rule)
    return own[:, 0], own[:, 1], total, crossing, chars[own[:, 0]], chars[own[:, 1]]


_COUNTS = "start long, end long, n_tokens double, n_crossing long, char_start long, char_end long"


def _batch(part, ids: list, names: pa.Array, columns: list[tuple[np.ndarray, ...]], name: str) -> pa.RecordBatch:
    arrays = [pa.array(np.concatenate(c)) for c in zip(*columns, strict=True)]
    return pa.RecordBatch.from_arrays([part.column("id").take(pa.array(ids, pa.int64())), names, *arrays], names=["id", name, *(x.split()[0] for x in _COUNTS.split(", "))])


def section_tokens(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "most", sections_of=lines) -> DataFrame:
    """(id, section, start, end, n_tokens, n_crossing, char_start, char_end): one row for each section of each document.

    ``sections_of`` gives the ordered byte ranges of a text's sections, by default its lines;
    sections are numbered from 0; start and end are bytes, char_start and char_end code points.  The
    document is encoded once, as a whole, without special tokens; ``rule`` is one of RULES, and
    n_crossing counts the tokens of the section that cross a boundary.  With every rule the sections
    of a document that they cover add up to its tokens.  Null and empty texts have no sections.  Rows are independent; repeated ids give repeated rows; an empty table gives none.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    blob = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches):
        encoder = Encoder(blob.value, pattern)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                ids, numbers, columns = [], [], []
                for k, text in enumerate(part.column("text").to_pylist()):
                    if not text:
                        continue
                    columns.append(_attributed(encoder, text, sections_of(text.encode()), rule))
                    ids += [k] * len(columns[-1][0])
                    numbers.append(np.arange(len(columns[-1][0]), dtype=np.int32))
                if ids:
                    yield _batch(part, ids, pa.array(np.concatenate(numbers)), columns, "section")

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, f"id {id_type(plain, 'id')}, section int, {_COUNTS}")


def field_tokens(docs: DataFrame, fields: tuple[str, ...], vocabulary_path: str, pattern: str, id_col: str = "doc_id", rule: str = "most", separator: str = "\n") -> DataFrame:
    """(id, field, start, end, n_tokens, n_crossing, char_start, char_end): one row for each of ``fields`` of each row.

    The document is the fields in order with ``separator`` between them; it is encoded once, as a
    whole, and its tokens are given to fields by ``rule``.  A separator belongs to no field; null
    fields are empty.  Rows are independent; an empty table gives none.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    blob = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    gap = len(separator.encode())

    def run(batches):
        encoder = Encoder(blob.value, pattern)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                columns = []
                for text, sizes in zip(part.column("text").to_pylist(), part.column("sizes").to_pylist(), strict=True):
                    ends = np.cumsum(np.array(sizes) + gap) - gap
                    columns.append(_attributed(encoder, text, list(zip((ends - sizes).tolist(), ends.tolist())), rule))
                ids = np.repeat(np.arange(part.num_rows), len(fields)).tolist()
                yield _batch(part, ids, pa.array(list(fields) * part.num_rows), columns, "field")

    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]
    plain = docs.select(F.col(id_col).alias("id"), F.concat_ws(separator, *filled).alias("text"), F.array(*map(F.octet_length, filled)).alias("sizes"))
    return plain.mapInArrow(run, f"id {id_type(plain, 'id')}, field string, {_COUNTS}")


def layers(starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Indexes of spans, put into as few lists as it takes that those of one list, in order, do not overlap."""
    out: list[list[int]] = []
    free: list[tuple[int, int]] = []  # when each list ends
    for k in np.lexsort((ends, starts)).tolist():
        if free and free[0][0] <= starts[k]:
            _, at = heapq.heappop(free)
        else:
            at = len(out)
            out.append([])
        out[at].append(k)
        heapq.heappush(free, (int(ends[k]), at))
    return [np.array(x) for x in out]


def span_tokens(docs: DataFrame, spans: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "most") -> DataFrame:
    """(id, name, start, end, n_tokens, n_crossing) for each row (id, name, start, end) of ``spans``; code points, end exclusive.

    Every document with spans is encoded once, as a whole, before the join.  A span's tokens follow
    from ``rule`` and the spans that it does not overlap: of overlapping ones each is counted as if
    the other were not there.  Spans are cut to the text; null and reversed ones are empty.  Rows that
    repeat a span count once; a span without a document and a document without spans give no row.
    Spans of one document are dealt to groups of about SPANS by a hash, so a document may have any number.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    blob = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    kind = id_type(docs, id_col)

    def encode(batches):
        encoder = Encoder(blob.value, pattern)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sizes = [encoder.lengths(t or "").astype(np.uint32).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sizes, pa.binary())], names=["id", "text", "sizes"])

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                rows = []
                for k, (text, sizes, own) in enumerate(zip(part.column("text").to_pylist(), part.column("sizes").to_pylist(), part.column("spans").to_pylist(), strict=True)):
                    raw = np.frombuffer((text or "").encode(), np.uint8)
                    at = np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw))  # byte of each code point
                    start, end = (np.array([min(max(s[c] or 0, 0), len(at) - 1) for s in own], np.int64) for c in ("start", "end"))
                    end = np.where([s["start"] is None or s["end"] is None for s in own], start, np.maximum(start, end))
                    sized = np.frombuffer(sizes, np.uint32).astype(np.int64)
                    for some in layers(start, end):
                        total, crossing = attribute(sized, at[start[some]], at[end[some]], rule)
                        rows += [(k, own[i]["name"], own[i]["start"], own[i]["end"], float(t), int(c)) for i, t, c in zip(some.tolist(), total, crossing, strict=True)]
                cols = list(zip(*rows, strict=True)) or [()] * 6
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
                arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id").take(arrays[0]), *arrays[1:]], names=["id", "name", "start", "end", "n_tokens", "n_crossing"])

    own = spans.where(F.col("id").isNotNull()).select("id", F.col("name").cast("string").alias("name"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).distinct()
    sizes = own.groupBy("id").agg(F.ceil(F.count(F.lit(1)) / SPANS).alias("groups"))
    dealt = join_hot(own, sizes, "id").groupBy("id", F.pmod(F.xxhash64("name", "start", "end"), F.col("groups")).alias("group"))
    dealt = dealt.agg(F.collect_list(F.struct("name", "start", "end")).alias("spans")).drop("group")
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(sizes.select("id"), "id", "left_semi")
    encoded = plain.mapInArrow(encode, f"id {kind}, text string, sizes binary")
    return dealt.join(encoded, "id").select("id", "text", "sizes", "spans").mapInArrow(count, f"id {kind}, name string, start long, end long, n_tokens double, n_crossing long")
