"""Token spans against an independent library's offsets, rules against a slow reading."""

import random

import numpy as np
import pytest

from motionlake.llm.tokencounts import RULES, Encoder, attribute, field_tokens, read_vocabulary, section_tokens, span_tokens

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.tiktoken")


def texts(seed, count):
    r = random.Random(seed)
    parts = ["a", "the", " ", "  ", "\n", "\n\n", "\t", "é", "日本", "😀", "'s", "ing", " and", "\xa0", " ", "\x1c", "12", "!?", "\r\n", "'", "word"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(16))) for _ in range(count)]


def test_segments_encode_as_the_whole():
    e = Encoder(read_vocabulary(PATH), P.PATTERN)
    for t in texts(1, 4000):
        assert e.lengths(t).tolist() == [e.size[i] for i in e.library.encode_ordinary(t)], t


def test_spans_equal_other_library():
    from tokenizers import Tokenizer

    e, other = Encoder(read_vocabulary(PATH), P.PATTERN), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    for t in texts(2, 1000):
        raw, spans = t.encode(), other.encode(t, add_special_tokens=False).offsets
        ends = np.cumsum(e.lengths(t))
        assert len(spans) == len(ends), t
        # a token that splits a character has that whole character there
        assert all(len(t[:b].encode()) >= z and len(raw[:z].decode("utf-8", "ignore")) <= b for (a, b), z in zip(spans, ends)), t


@pytest.mark.parametrize("rule", RULES)
def test_rules(rule):
    r = random.Random(3)
    for _ in range(400):
        sizes = np.array([r.randrange(1, 6) for _ in range(r.randrange(0, 8))], np.uint16)
        cuts = sorted(r.sample(range(0, 30), r.choice([0, 2, 4, 6])))
        own = list(zip(cuts[::2], cuts[1::2])) if r.random() < 0.5 else list(zip(cuts[:-1], cuts[1:]))
        total, crossing = attribute(sizes, np.array([a for a, _ in own], np.int64), np.array([b for _, b in own], np.int64), rule)
        want, cross, at = [0.0] * len(own), [0] * len(own), 0
        for n in sizes.tolist():
            held = [len(set(range(at, at + n)) & set(range(a, b))) for a, b in own]
            if rule == "share":
                give = {k: h / n for k, h in enumerate(held) if h}
            elif rule == "most":
                give = {held.index(max(held)): 1} if held and max(held) else {}
            else:
                spot = at if rule == "first" else at + n - 1
                give = {k: 1 for k, (a, b) in enumerate(own) if a <= spot < b}
            for k, v in give.items():
                want[k] += v
                cross[k] += held[k] < n
            at += n
        assert np.allclose(total, want) and crossing.tolist() == cross


def test_frames(spark):
    rows = [(1, None, 1), (2, "", 1), (2, "one\n\ntwo three", 2), (None, "x " * 50000, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, section int")
    got = [tuple(r) for r in section_tokens(df, PATH, P.PATTERN).collect()]
    e = Encoder(read_vocabulary(PATH), P.PATTERN)
    assert [r[:4] for r in got] == [(2, 0, 0, 4), (2, 1, 4, 5), (2, 2, 5, 14), (None, 0, 0, 100000)]
    assert sum(r[4] for r in got[:3]) == len(e.library.encode_ordinary(rows[2][1])) and got[3][4] == len(e.library.encode_ordinary(rows[3][1]))
    assert section_tokens(df.limit(0), PATH, P.PATTERN).count() == 0


OTHER = r"\p{L}+| \p{N}|\s+|[^\s\p{L}]+"


def test_other_patterns_encode_the_whole():
    e = Encoder(read_vocabulary(PATH), OTHER)
    assert not e.by_segment
    for t in texts(4, 300):
        assert e.lengths(t).tolist() == [e.size[i] for i in e.library.encode_ordinary(t)], t


def plain_counts(e, text, spans, rule):
    """Tokens of byte ranges, byte by byte; of ranges that overlap each by itself."""
    sizes = [e.size[i] for i in e.library.encode_ordinary(text)]
    out = []
    for a, b in spans:
        others = [(x, y) for x, y in spans if (x, y) != (a, b) and x < y and (y <= a or b <= x)]
        total, at = 0.0, 0
        for n in sizes:
            own = max(0, min(at + n, b) - max(at, a))
            rest = [max(0, min(at + n, y) - max(at, x)) for x, y in others]
            if rule == "share":
                total += own / n
            elif rule == "first":
                total += a <= at < b
            elif rule == "last":
                total += a <= at + n - 1 < b
            at += n
        out.append(total)
    return out


@pytest.mark.parametrize("rule", ["first", "last", "share"])
def test_fields_and_spans(spark, rule, monkeypatch):
    e = Encoder(read_vocabulary(PATH), P.PATTERN)
    rows = [(k, t, None if k % 5 == 0 else t[::-1], k) for k, t in enumerate(texts(5, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, title string, body string, id int")
    got = {}
    for x in field_tokens(docs, ("title", "body", "title"), PATH, P.PATTERN, rule=rule, separator=" é ").collect():
        got.setdefault(x.id, []).append(x)
    gap = len(" é ".encode())
    for i, a, b, _ in rows:
        parts = [a, b or "", a]
        text, at, spans = " é ".join(parts), 0, []
        for p in parts:
            spans.append((at, at + len(p.encode())))
            at = spans[-1][1] + gap
        assert [(x.start, x.end) for x in got[i]] == spans and [x.field for x in got[i]] == ["title", "body", "title"]
        assert np.allclose([x.n_tokens for x in got[i]], plain_counts(e, text, spans, rule))
        assert [text[x.char_start : x.char_end] for x in got[i]] == parts
    r = random.Random(7)
    table = [(i, f"s{k}", *sorted((r.randrange(len(a) + 3), r.randrange(len(a) + 3)))) for i, a, _, _ in rows for k in range(6)]
    table = [s for s in table if s[0] % 7] + [(3, "none", None, 4), (999, "gone", 0, 1), (None, "null", 0, 1)]
    monkeypatch.setattr("motionlake.llm.tokencounts.SPANS", 4)
    spans = spark.createDataFrame(table + table[:9], "id long, name string, start long, end long")
    found = span_tokens(docs, spans, PATH, P.PATTERN, text_col="title", rule=rule).collect()
    assert len(found) == len(set(table)) - 2
    texts_ = {i: a for i, a, _, _ in rows}
    for x in found:
        t = texts_[x.id]
        a, b = (len(t[:c].encode()) for c in (x.start or 0, x.end)) if x.start is not None else (0, 0)
        assert abs(x.n_tokens - plain_counts(e, t, [(a, b)], rule)[0]) < 1e-9
    assert span_tokens(docs.limit(0), spans, PATH, P.PATTERN, text_col="title").count() == 0 == span_tokens(docs, spans.limit(0), PATH, P.PATTERN, text_col="title").count()
