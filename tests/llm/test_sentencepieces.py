"""Encoding, spans and decoding against the library itself."""

import random

import pytest
import sentencepiece

from motionlake.llm.sentencepieces import Codec, Model, Normaliser, decode_documents, encode_documents, read_model

P = pytest.importorskip("public_tokenizers")
PATH = P.path("piece_bpe_32k.model")
PARTS = ["a", "b", "the", "▁", " ", "  ", "\n", "\t", "é", "日", "😀", "́", "\x00", "<s>", "<0x0A>", "ing", "tion", " and", " ", "\r\n", "1", "22", "​", "ﬁ", "\x1c", "　", "�", "ｱ", "ﾞ", "Å", "①", "ẛ̣", "가"]


def texts(seed, count):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randrange(14))) for _ in range(count)]


def test_codec_equals_library():
    codec = Codec(read_model(PATH))
    assert codec.by_segment
    for t in texts(1, 4000):
        ids = codec.library.encode(t)
        spans = [(p.begin, p.end) for p in codec.library.encode(t, return_type="proto").pieces]
        names, n, bounds, decoded = codec.encode_all([t])[0]
        assert (names, n, decoded) == (",".join(map(str, ids)), len(ids), codec.library.decode(ids)), t
        assert list(zip(bounds[:-1].tolist(), bounds[1:].tolist())) == spans == codec.encode(t)[1], t


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
def test_character_maps_equal_library(rule):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    ours = Normaliser(Model.parse(library.serialized_model_proto()))
    for t in texts(2, 2000):
        got, source = ours.normalise(t.encode())
        assert got.decode() == library.normalize(t), t
        assert len(source) == len(got) + 1 and all(a <= b for a, b in zip(source, source[1:])) and source[-1] <= len(t.encode())


def test_documents_and_round_trip(spark):
    rows = [(1, None, "x"), (2, "", "y"), (2, "a  b", None), (None, "née\n日本", "z"), (5, "word " * 40000, "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    every = ("n_tokens", "ids", "id_text", "starts", "ends", "covered", "decoded")
    out = encode_documents(df, PATH, outputs=every).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for (i, t, _), r in zip(rows, out):
        ids = library.encode(t or "")
        assert (r.id, r.n_tokens, r.ids, r.id_text, r.decoded) == (i, len(ids), ids, ",".join(map(str, ids)), t or "")
        raw = (t or "").encode()
        assert b"".join(raw[a:b] for a, b in zip(r.starts, r.ends)) == raw and r.covered == len(raw)
    back = decode_documents(encode_documents(df, PATH, outputs=("ids",)), PATH).collect()
    assert [x.text for x in back] == [t or "" for _, t, _ in rows]
    assert encode_documents(df.limit(0), PATH).count() == 0
