"""Token files and pieces: exact round trips, and the libraries' own results."""

from __future__ import annotations

import io
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from heliogable.llm.pieces import MARK, Model, decode_pieces, encode_pieces  # noqa: E402
from heliogable.llm.tokenfile import EliasFano, Shard, ShardWriter, WordEncoder, read_tokens, write_tokens  # noqa: E402

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


@given(st.lists(st.integers(0, 2**40), max_size=700))
@settings(max_examples=60, deadline=None)
def test_elias_fano(steps):
    values = np.cumsum(np.array(steps, np.uint64)).astype(np.int64)
    e = EliasFano.encode(values)
    assert [e[i] for i in range(len(steps))] == values.tolist()
    with pytest.raises(IndexError):
        e[len(steps)]


def test_elias_fano_space():
    values = np.cumsum(np.random.default_rng(1).integers(1, 1000, 100_000))
    e = EliasFano.encode(values)
    assert (e.lows.nbytes + e.highs.nbytes + e.directory.nbytes) * 8 / len(values) < 2.2 + np.log2(500) + 0.2


@pytest.mark.parametrize("width", [2, 4])
def test_shard(width):
    docs = [(None, []), (5, [1, 2, 3]), (7, [65535 if width == 2 else 2**31]), (7, list(range(1000)))]
    out = io.BytesIO()
    w = ShardWriter(out, width)
    for i, ids in docs:
        w.add(i, np.array(ids, f"<u{width}").tobytes())
    w.close()
    s = Shard(io.BytesIO(out.getvalue()))
    assert [s.ids(i).tolist() for i in range(4)] == [d[1] for d in docs] and [s.doc_id(i) for i in range(4)] == [None, 5, 7, 7]
    assert [(i, ids.tolist()) for i, _, ids in s.documents(at_once=2)] == docs
    with pytest.raises(ValueError):
        Shard(io.BytesIO(out.getvalue()[:-3]))


def test_tokens_odd_rows(spark, frame, odd_rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    rows = odd_rows + [(30, "it's I'LL <|endoftext|> x<|endoftext|>y"), (31, "İstanbul ΟΔΟΣ Σ ﬁ é a̸ ≮ ½ ٣ x\x1cy\x85z\xa0q"), (32, "end.,;:!?*#$%&|\"() 'quoted' 12.5% A-B")]
    got = read_tokens(write_tokens(frame(rows), WORDS)).orderBy(F.col("doc_id").asc_nulls_first(), "start").collect()
    start = 0
    for (i, text), r in zip(sorted(rows, key=lambda r: -1 if r[0] is None else r[0]), got, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_shard_is_small():
    """Ends and ids take about 2 + log2(range / number) bits each, and every place is found by select."""
    import io

    from heliogable.llm.tokenfile import Shard, ShardWriter

    rng = random.Random(4)
    out, docs, at = io.BytesIO(), [None, None], -(10**15)
    for _ in range(5000):
        at += rng.choice((0, 1, 3, 1000))
        docs.append(at)
    writer = ShardWriter(out, 2)
    sizes = [rng.randrange(1, 400) for _ in docs]
    for d, n in zip(docs, sizes, strict=True):
        writer.add(d, np.full(n, n, "<u2").tobytes())
    writer.close()
    index = len(out.getvalue()) - 2 * sum(sizes)
    bits = sum(2.3 + max(0, np.log2(u / len(docs))) for u in (sum(sizes), docs[-1] - docs[2]))
    assert index * 8 <= bits * len(docs) + 1600
    shard, start = Shard(out), 0
    for k, (doc, where, ids) in enumerate(shard.documents(at_once=700)):
        assert (doc, where, len(ids)) == (docs[k], start, sizes[k]) and shard.offsets(k) == (start, start + sizes[k]) and (ids == sizes[k]).all()
        start += sizes[k]
    assert k == len(docs) - 1


def test_word_encoder_forgets(monkeypatch):
    from heliogable.llm import tokenfile

    monkeypatch.setattr(tokenfile, "REMEMBER", 5)
    monkeypatch.setattr(tokenfile, "STEMS", 3)
    e = WordEncoder(WORDS, 2)
    texts = [f"word{k % 11} Word{k % 7}. other" for k in range(600)]
    fresh = [np.array(x.ids, "<u2").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert e.by_word and list(e(texts)) == fresh


@pytest.fixture(scope="module")
def model():
    return Model(PIECES)


@given(st.lists(st.text(alphabet="abeth  \n\té日ß▁🙂́<0x>ing", max_size=40), min_size=1, max_size=20))
@settings(max_examples=80, deadline=None)
def test_pieces_as_the_library(texts):
    import sentencepiece

    m = test_pieces_as_the_library.__dict__.setdefault("m", Model(PIECES))
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert [x.tolist() for x in m.encode(texts)] == library.encode(texts)
    assert [m.decode(x) for x in m.encode(texts)] == [t.replace(MARK, " ") for t in texts]


def test_pieces_share_cells(model):
    """Words of one walk need as many new cells as their trie has nodes."""
    made = []
    cells = model._cells

    def count(word, piece, begins, score):
        made.extend(word[:end] for end in range(len(piece), len(word) + 1))
        cells(word, piece, begins, score)

    model._cells = count
    try:
        words = [MARK + w for w in ("the", "them", "then", "thesis", "a")] + [MARK * 3 + "the", MARK * 9 + "them"]
        assert len(list(model.walk(words))) == len(words)
    finally:
        del model._cells
    assert len(made) == len(set(made)) == len({w[:k] for w in words[:5] for k in range(1, len(w) + 1)})


def test_marks_in_front(model):
    """Runs of marks and words behind them, against the library and the definition."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    words = ["the", "x", "日本", "return", "é", "0x", ".", "zzz", "🙂a", "Straße", "ing", "self"]
    texts = [" " * n + w for n in range(40) for w in words] + [f"{w}{' ' * n}{w}\n{' ' * n}{w}" for n in range(18) for w in words] + [" " * n for n in range(70)]
    assert model.marks_last and [x.tolist() for x in model.encode(texts)] == library.encode(texts)
    for w in words:
        for n in (2, 3, 7):
            assert dict(model.walk([MARK * n + w]))[MARK * n + w] == model._as_ids(model.merged(MARK * n + w))


def test_long_words(model):
    """A million characters behind two spaces, and a million spaces, take time in proportion."""
    import time

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ["  " + "abcdefghij" * 100_000, " " * 300_000 + "x"]
    began = time.time()
    got = [x.tolist() for x in model.encode(texts)]
    assert time.time() - began < 60 and got == library.encode(texts)


def test_unigram_is_viterbi(model):
    """With the unigram rule a word's pieces have the best sum of scores of all segmentations."""
    m = object.__new__(Model)
    m.kind, m.ids = 1, {p: i for i, p in enumerate(["a", "b", "ab", "abc", "c", "bc", "ca"])}
    m.scores, m.tails, m.byte, m.worst = [-2.0, -2.1, -3.0, -6.5, -1.5, -2.9, -3.3], {p[k:]: m.ids.get(p[k:], -1) for p in m.ids for k in range(len(p))}, list(range(100, 356)), -20.0
    m.apart = {}
    rng = random.Random(3)
    words = {"".join(rng.choice("abcz") for _ in range(rng.randrange(1, 9))) for _ in range(200)}

    def best(word):
        if not word:
            return 0.0
        options = [m.scores[m.ids[word[:k]]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in m.ids]
        return max(options) if word[0] in m.ids else m.worst + best(word[1:])

    for word, ids in m.walk(list(words)):
        assert sum(m.scores[i] if i < 100 else m.worst for i in ids) == pytest.approx(best(word))


def test_pieces_odd_rows(spark, frame, odd_rows):
    df = encode_pieces(frame(odd_rows), PIECES, carry=["lang"])
    got = {r.doc_id: r for r in df.collect()}
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in got.values()) and got[1].ids == []
    back = {r.doc_id: r.text for r in decode_pieces(df, PIECES).collect()}
    assert back == {i: t or "" for i, t in odd_rows}


def test_empty(frame):
    none = frame([(1, "x")]).filter(F.lit(False))
    assert read_tokens(write_tokens(none, WORDS)).count() == 0 and encode_pieces(none, PIECES).count() == 0
