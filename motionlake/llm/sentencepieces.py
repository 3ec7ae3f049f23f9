"""SentencePiece encoding and decoding with every piece projected to the original bytes.

``Normaliser`` reads the compiled character map out of the model file and replaces, from each place
on, the longest prefix that the map has; each normalised byte keeps the original byte it came from.
Pieces are laid over the normalised bytes and projected back through that record.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TooLarge, id_type
from .textvec import slices

#: Bytes of a model file that are broadcast at most.
MODEL_BYTES = 64 << 20
#: Segments kept in each of a worker's two cache generations (about 280 bytes each).
CACHED = 400_000

BAR = "▁".encode()
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """(field number, value) of a protocol buffer message; varints as int, the rest as bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + size]
            at += size


@dataclass
class Model:
    """What a model file says of its pieces and its normaliser."""

    pieces: list[bytes] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True
    suffix: bool = False

    @classmethod
    def parse(cls, blob: bytes) -> Model:
        model = cls()
        for number, value in _fields(blob):
            if number == 1:
                piece = dict(_fields(value))
                model.pieces.append(piece.get(1, b""))
                model.types.append(piece.get(3, NORMAL))
            elif number == 2:
                model.suffix = bool(dict(_fields(value)).get(24, 0))
            elif number == 3:
                spec = dict(_fields(value))
                model.charsmap = spec.get(2, b"")
                model.dummy_prefix, model.remove_extra, model.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        return model


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 and a pool of replacements ended by NUL."""

    def __init__(self, blob: bytes):
        (size,) = struct.unpack_from("<I", blob) if blob else (0,)
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.pool = blob[4 + size :]

    def leads(self) -> set[int]:
        """Bytes that a key begins with."""
        root = self._child(self.units[0]) if self.units else 0
        return {b for b in range(256) if self.units and root ^ b < len(self.units) and self.units[root ^ b] & 0x800000FF == b}

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that ``text`` has at ``at``."""
        units, found = self.units, None
        if not units:
            return None
        node = self._child(units[0])
        for k in range(at, len(text)):
            node ^= text[k]
            unit = units[node]
            if unit & 0x800000FF != text[k]:
                break
            node ^= self._child(unit)
            if unit >> 8 & 1:
                found = k + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.pool[found[1] : self.pool.index(b"\0", found[1])]

    @staticmethod
    def _child(unit: int) -> int:
        return unit >> 10 << ((unit & 0x200) >> 6)


class Normaliser:
    """Text to normalised bytes, with the original byte offset of each."""

    def __init__(self, model: Model):
        self.model, self.map = model, CharacterMap(model.charsmap)
        own = sorted((p for p, t in zip(model.pieces, model.types, strict=True) if t == USER_DEFINED), key=len, reverse=True)
        self.own = re.compile(b"|".join(map(re.escape, own))) if own else None
        # ASCII that begins no key of the map and no piece of its own stands for itself
        taken = self.map.leads() | {p[0] for p in own}
        plain = set(range(1, 128)) - {32} - taken
        # as does a space that is neither dropped nor the beginning of a key
        self.spaces = not model.remove_extra and 32 not in taken
        plain |= {32} if self.spaces else set()
        self.plain = re.compile(b"[" + b"".join(re.escape(bytes([b])) for b in sorted(plain)) + b"]+") if plain else None

    def _next(self, text: bytes, at: int) -> tuple[int, bytes]:
        if self.own and (m := self.own.match(text, at)):
            return m.end() - at, m[0]
        if hit := self.map.longest(text, at):
            return hit
        lead = text[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return size, text[at : at + size]

    def normalise(self, text: bytes, prefix: bool = True) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and, for each and for the end, where in ``text`` they come from.

        Without ``prefix``, as for what follows other text, no dummy prefix is put in.
        """
        model, out, source, at = self.model, bytearray(), [], 0
        bar = BAR if model.escape else b" "
        if model.remove_extra:
            while at < len(text):
                size, new = self._next(text, at)
                if new != b" ":
                    break
                at += size
        if at >= len(text):
            return b"", np.zeros(1, np.int64)

        def put(new: bytes, origin: int) -> None:
            out.extend(new)
            source.extend([origin] * len(new))

        if prefix and model.dummy_prefix and not model.suffix:
            put(bar, at)
        spaced = model.remove_extra
        while at < len(text):
            if self.plain and (run := self.plain.match(text, at)):
                if self.spaces and b" " in run[0]:
                    out.extend(run[0].replace(b" ", bar))
                    wide = np.where(np.frombuffer(run[0], np.uint8) == 32, len(bar), 1)
                    source.extend(np.repeat(np.arange(at, run.end()), wide).tolist())
                else:
                    out.extend(run[0])
                    source.extend(range(at, run.end()))
                at, spaced = run.end(), False
                continue
            size, new = self._next(text, at)
            if spaced:
                new = new.lstrip(b" ")
            if new:
                put(new.replace(b" ", bar), at)
                spaced = new.endswith(b" ")
            at += size
            spaced = spaced and model.remove_extra
        if model.remove_extra:
            while out.endswith(bar):
                at = source[len(out) - len(bar)]
                del out[-len(bar) :], source[-len(bar) :]
        if model.dummy_prefix and model.suffix:
            put(bar, at)
        source.append(at)
        return bytes(out), np.array(source)


class Codec:
    """Encodes and decodes as the library does, and gives each piece's original byte span."""

    def __init__(self, blob: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.model = Model.parse(blob)
        self.normaliser = Normaliser(self.model)
        bytes_ = {p: k for k, (p, t) in enumerate(zip(self.model.pieces, self.model.types, strict=True)) if t == BYTE}
        self.byte_of = {k: int(p[1:-1], 16) for p, k in bytes_.items()}
        plain = [p for p, t in zip(self.model.pieces, self.model.types, strict=True) if t == NORMAL]
        self.newline = bytes_.get(b"<0x0A>")
        # Segments end where no piece can go on: before a bar after another character, and around \n.
        # Then each may be encoded by itself.
        whole = len(bytes_) == 256 and not (self.model.charsmap or self.model.remove_extra or self.model.suffix or USER_DEFINED in self.model.types)
        local = not any(re.search("[^▁]▁|\n", p.decode()) for p in plain)
        self.by_segment = whole and local and self.model.dummy_prefix and self.model.escape and self.newline is not None
        self.surface = [bytes([self.byte_of[k]]) if k in self.byte_of else p.replace(BAR, b" ") for k, p in enumerate(self.model.pieces)]
        self.names, self.bytes_ = [str(k) for k in range(len(self.surface))], frozenset(self.byte_of)
        self.sizes: dict[bytes, bytes] = {}
        self.young: dict[str, tuple[str, bytes, str]] = {}
        self.old: dict[str, tuple[str, bytes, str]] = {}

    def lengths(self, ids: list[int], pieces: list[bytes]) -> list[int]:
        """Normalised bytes of each piece; of bytes that spell a character, the last has them all."""
        if self.bytes_.isdisjoint(ids):
            return list(map(len, pieces))
        out, left = [], 0
        for i, piece in zip(ids, pieces, strict=True):
            if i in self.byte_of:
                b = self.byte_of[i]
                if not left:
                    left = size = 1 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                left -= 1
                out.append(0 if left else size)
            else:
                out.append(len(piece))
        return out

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids and original byte spans of a whole text, by the general way."""
        ids = self.library.encode(text)
        pieces = [self.model.pieces[i] for i in ids]
        if any(self.model.types[i] == UNKNOWN for i in ids):  # these pieces' text isn't in the model
            pieces = [p.piece.encode() for p in self.library.encode(text, return_type="proto").pieces]
        _, source = self.normaliser.normalise(text.encode())
        ends = np.cumsum([0, *self.lengths(ids, pieces)])
        at = source[np.minimum(ends, len(source) - 1)].tolist()
        return ids, list(zip(at[:-1], at[1:], strict=True))

    def _learn(self, segments: list[str]) -> None:
        """Caches for each segment the ids as text, the original bytes of each piece, and the decoded text.

        They are encoded many at a time, set apart by newlines, which no piece crosses.  Original bytes
        come from the source alignment of the normaliser, which has seen every segment.
        """
        if len(self.young) > CACHED:
            self.old, self.young = self.young, {}
        young, old, surface, names, sizes, pieces = self.young, self.old, self.surface, self.names, self.sizes, self.model.pieces
        fresh = []
        for s in segments:
            if v := old.get(s):
                young[s] = v
            elif s == "\n":
                young[s] = names[self.newline], b"\1", s
            else:
                fresh.append(s)
        for lo in range(0, len(fresh), 256):
            some = fresh[lo : lo + 256]
            text = "\n" + "\n".join(some)
            ids = self.library.encode(text)
            _, source = self.normaliser.normalise(text.encode())
            ends = np.cumsum(self.lengths(ids, [pieces[i] for i in ids]))
            size = np.diff(source[ends], prepend=0).astype(np.uint8).tobytes()
            ids.append(self.newline)
            at = ids.index(self.newline) + 1
            for s in some:
                end = ids.index(self.newline, at)
                own = ids[at:end]
                decoded = b"".join([surface[i] for i in own]).decode("utf-8", "replace")
                part = size[at:end]
                young[s] = ",".join([names[i] for i in own]), sizes.setdefault(part, part) if len(sizes) < CACHED else part, s if decoded == s else decoded
                at = end + 1

    def encode_all(self, texts: list[str]) -> list[tuple[str, int, np.ndarray, str]]:
        """For each text: ids as decimal text, their number, span bounds (n + 1), decoded text."""
        out = []
        for text in texts:
            if not self.by_segment or "▁" in text or not text:
                ids, spans = self.encode(text)
                bounds = np.array([spans[0][0] if spans else 0, *(e for _, e in spans)], np.int64)
                out.append((",".join(map(str, ids)), len(ids), bounds, self.library.decode(ids)))
                continue
            segments = _SEGMENTS.findall(" " + text)
            got = list(map(self.young.get, segments))
            if None in got:
                self._learn(list({s for s, v in zip(segments, got, strict=True) if v is None}))
                young = self.young
                got = [v or young[s] for s, v in zip(segments, got, strict=True)]
            sizes = np.frombuffer(b"".join([v[1] for v in got]), np.uint8)
            bounds = np.zeros(len(sizes) + 1, np.int64)
            np.cumsum(sizes, out=bounds[1:])
            # the dummy prefix stands for no byte of the text, and decoding drops it again
            out.append((",".join([v[0] for v in got]), len(sizes), np.maximum(bounds - 1, 0), "".join([v[2] for v in got])[1:]))
        return out


_SEGMENTS = re.compile(r" *[^ \n]+|\n| +")


def read_model(path: str) -> bytes:
    """The model file's bytes; raises TooLarge above MODEL_BYTES."""
    with open(path, "rb") as f:
        blob = f.read(MODEL_BYTES + 1)
    if len(blob) > MODEL_BYTES:
        raise TooLarge(f"{path} has over {MODEL_BYTES} bytes")
    return blob


#: Spark types of the outputs of encode_documents.
OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "id_text": "string", "starts": "array<int>", "ends": "array<int>", "covered": "long", "decoded": "string"}


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids", "starts", "ends", "decoded")) -> DataFrame:
    """(id, *outputs) for each row: ids as the library's, byte spans [start, end), decoded text.

    ``id_text`` is the ids in decimal, joined by commas; ``covered`` the bytes under the pieces'
    spans.  No begin or end id is added and nothing is sampled.  Null and empty texts give no
    pieces and an empty decoded text.  Spans rise and never overlap; a piece that normalisation
    made out of nothing has an empty span, as has all but the last of the byte pieces that spell
    one character.  Rows are independent: repeated ids give repeated rows, other columns are
    ignored, and an empty table gives no rows.  The model is broadcast after a check of its size.
    """
    session = docs.sparkSession
    blob = session.sparkContext.broadcast(read_model(model_path))
    wanted = tuple(outputs)
    types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "id_text": pa.string(), "starts": pa.list_(pa.int32()), "ends": pa.list_(pa.int32()), "covered": pa.int64(), "decoded": pa.string()}

    def run(batches):
        codec = Codec(blob.value)
        pick = {
            "n_tokens": lambda x: x[1],
            "ids": lambda x: np.array(x[0].split(",") if x[1] else [], np.int32),
            "id_text": lambda x: x[0],
            "starts": lambda x: x[2][:-1].astype(np.int32),
            "ends": lambda x: x[2][1:].astype(np.int32),
            "covered": lambda x: int(x[2][-1] - x[2][0]),
            "decoded": lambda x: x[3],
        }
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                rows = codec.encode_all([x or "" for x in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(list(map(pick[k], rows)), types[k]) for k in wanted)], names=["id", *wanted])

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, ", ".join([f"id {id_type(docs, id_col)}", *(f"{k} {OUTPUTS[k]}" for k in wanted)]))


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the library's decoding of each row's ids; null or empty ids give an empty text."""
    blob = encoded.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches):
        library = Codec(blob.value).library
        for batch in batches:
            texts = [library.decode(ids) if ids else "" for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, f"id {id_type(encoded, id_col)}, text string")
