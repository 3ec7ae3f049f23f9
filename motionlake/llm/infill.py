"""Fill-in-middle: texts are cut into prefix, middle and suffix, and the middle moves to the end.

A batch is one UTF-8 buffer.  Every byte has a class, a matrix over the classes of two adjacent
bytes says where a unit begins, and cumulative sums that start anew with each text number the
units, so that one search finds the cuts of all texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_type

#: Bytes of text that are looked at together, but for a longer text.
SLICE = 4 << 20
#: What stands before prefix, suffix and middle, and percents of texts cut and of these with the suffix first.
SENTINELS, CUT_PERCENT, SUFFIX_FIRST_PERCENT = ("<P>", "<S>", "<M>"), 90, 20

_INNER, _OTHER, _SPACE, _NEWLINE = range(4)


def byte_classes() -> np.ndarray:
    """The class of each byte: inside a code point, ASCII white space, line feed or any other."""
    classes = np.full(256, _OTHER, np.uint8)
    classes[0x80:0xC0] = _INNER
    classes[[0x20, *range(0x09, 0x0E)]] = _SPACE
    classes[0x0A] = _NEWLINE
    return classes


def boundaries(units: str) -> np.ndarray:
    """Whether a unit begins between a byte of the one class and a byte of the other."""
    begins = np.zeros((4, 4), bool)
    if units == "code_points":
        begins[:, _OTHER:] = True
    elif units == "words":  # a word holds the white space after it
        begins[_SPACE, _OTHER] = begins[_NEWLINE, _OTHER] = True
    elif units == "lines":
        begins[_NEWLINE, :] = True
    else:
        raise ValueError(f"no such units: {units}")
    return begins


def unit_cuts(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, begins: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, and per text the units and the bytes before its two cuts.

    ``first`` and ``second`` are hashes: a cut stands after hash % (units + 1) units, the smaller first.
    """
    kind = classes[data]
    fresh = np.empty(len(data), bool)
    fresh[1:] = begins[kind[:-1], kind[1:]]
    fresh[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    running = np.concatenate([np.zeros(1, np.int32), np.cumsum(fresh, dtype=np.int32)])
    base = running[offsets[:-1]].astype(np.int64)
    units = running[offsets[1:]] - base
    cuts = np.sort(np.stack([first % (units + 1), second % (units + 1)], axis=1), axis=1)
    # the byte where a text's next unit begins; after its last unit that is the begin of the next text, its own end
    places = np.searchsorted(running[1:], (base[:, None] + cuts + 1).astype(np.int32))
    return units, cuts, places


def _text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and where each text begins in them."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _slices(offsets: np.ndarray) -> list[tuple[int, int]]:
    """Runs of rows with at most SLICE bytes, or one row with more."""
    out, lo, rows = [], 0, len(offsets) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
        out.append((lo, min(hi, rows)))
        lo = out[-1][1]
    return out


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: str = "code_points", seed: str = "1", sentinels: tuple[str, str, str] = SENTINELS, cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT
) -> DataFrame:
    """(id, n, form, prefix_units, middle_units, output): each text with its middle at the end, or as it is.

    Draws come from the sha256 of ``seed``, a colon and the id, so that a text is cut alike wherever and
    however often it is met; a null id counts as empty there.  ``units`` are code_points, words or lines,
    and n is their number.  Form is plain (output is the text, the unit columns are null) for empty and
    null texts, texts that hold a sentinel, and all but ``cut_percent`` of the rest; else spm (suffix,
    prefix, middle) for ``suffix_first_percent`` of them, psm otherwise, each part behind its sentinel.
    Rows that repeat an id are each transformed.  Nothing is shuffled; a text takes some eight bytes of
    memory for each of its own, and shorter ones are taken SLICE bytes at a time.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring("digest", 8 * j + 1, 8), 16, 10).cast("long").alias(f"h{j + 1}") for j in range(4)]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), digest.alias("digest")).select("id", "text", *draws)
    classes, begins = byte_classes(), boundaries(units)
    marks = [s.encode() for s in sentinels]

    def transform(batches):
        for batch in batches:
            texts = batch.column("text")
            data, offsets = _text_buffer(texts)
            held = np.zeros(len(texts), bool)
            for s in sentinels:
                held |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
            draw = [batch.column(f"h{j}").to_numpy() for j in range(1, 5)]
            for lo, hi in _slices(offsets):
                at, own = offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
                n, cuts, (a, b) = (x.T if x.ndim == 2 else x for x in unit_cuts(own, at, classes, begins, draw[0][lo:hi], draw[1][lo:hi]))
                plain = (n == 0) | held[lo:hi] | (draw[2][lo:hi] % 100 >= cut_percent)
                swapped = draw[3][lo:hi] % 100 < suffix_first_percent
                form = np.where(plain, "plain", np.where(swapped, "spm", "psm"))
                # segments of each output: places in the texts followed by the sentinels
                start, end = at[:-1], at[1:]
                p, s, m = np.cumsum([len(own), *map(len, marks)])[:3]
                size = [np.where(plain, 0, len(x)) for x in marks]
                prefix, suffix = (np.where(plain, start, p), size[0], start, np.where(plain, end, a) - start), (np.full(len(n), s), size[1], b, np.where(plain, 0, end - b))
                lead, follow = ([np.where(swapped & ~plain, y, x) for x, y in zip(*sides, strict=True)] for sides in ((prefix, suffix), (suffix, prefix)))
                segments = np.stack([*lead, *follow, np.full(len(n), m), size[2], a, np.where(plain, 0, b - a)], axis=1).reshape(len(n), 6, 2)
                view = memoryview(own.tobytes() + b"".join(marks))
                joined = b"".join([view[x : x + k] for x, k in segments.reshape(-1, 2).tolist() if k])
                ends = np.concatenate([[0], np.cumsum(segments[:, :, 1].sum(axis=1))]).astype(np.int32)
                output = pa.StringArray.from_buffers(len(n), pa.py_buffer(ends), pa.py_buffer(joined))
                counts = [pa.array(x.astype(np.int64), mask=plain) for x in (cuts[0], cuts[1] - cuts[0])]
                yield pa.RecordBatch.from_arrays([batch.column("id")[lo:hi], pa.array(n.astype(np.int64)), pa.array(form, pa.string()), *counts, output], names=["id", "n", "form", "prefix_units", "middle_units", "output"])

    return rows.mapInArrow(transform, f"id {id_type(docs, id_col)}, n long, form string, prefix_units long, middle_units long, output string")


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text behind an output of fill_in_middle; null for null."""
    p, s, m = sentinels

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(rest, second, 1)
        rest = F.substr(rest, F.char_length(one) + len(second) + 1)
        two = F.substring_index(rest, m, 1)
        return one, two, F.substr(rest, F.char_length(two) + len(m) + 1)

    prefix, suffix, middle = parts(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)
