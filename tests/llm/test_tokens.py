"""Token counts and pieces against the public libraries."""

import hashlib
import os
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as spec
from tokenizers import Tokenizer

from tidefolio.llm import merges, sentencepiece_codec as C, token_counts as T

from .conftest import TOKENIZERS

BYTES, PIECES = (os.path.join(TOKENIZERS, n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [
    "", "  ", "a  b", " a", "a ", "\n\nword", "a\n\n b", "don't they're 're 'r ' ''s", "<|endoftext|>", "a<|endoftext|> b <|endoftext",
    "x" * 300, "\x1c\x1d a\x85b᠎ c　 d", "日本語テスト \U0001f600\U0001f600 é", "\t\tfoo\r\n bar   ", "1234 56 7", "'ll'll 'LL I'm",
    "aaaaaaaaaaaa bbbbbbb  \n  cc", "  leading",
]


def samples(n=150):
    rnd = random.Random(1)
    return ODD + ["".join(rnd.choice(" \n\t'sredlvtm1a<|endoftext|>é!▁") for _ in range(rnd.randint(1, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(BYTES)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def test_counts_at_every_prefix(library):
    counter = T.load(BYTES)
    for text in samples():
        want = [library(text[:i]) for i in range(len(text) + 1)]
        assert counter.prefix_counts(text) == want
        [chunks], [total] = counter.counts([text])
        assert total == want[-1]
        for budget in (0, 1, 2, 3, 5, 8):
            if total > budget:
                assert counter.longest_within(chunks, budget) == max(i for i, n in enumerate(want) if n <= budget)


def test_counted_documents(spark, documents, library):
    texts = [*samples(30), None, "word " * 5000, "é" * 30_000] + ["same text"] * 10
    df = documents(texts).withColumn("n_bytes", F.lit("clash"))
    got = {r.doc_id: r for r in T.count_tokens(df, BYTES, budgets=(4,)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        assert (got[i].n_bytes, got[i].n_tokens) == (len(t.encode()), library(t))
        assert library(t[: got[i].chars_4]) <= 4
    assert T.count_tokens(documents([]), BYTES).count() == 0


def test_caches_start_anew(monkeypatch, library):
    monkeypatch.setattr(T, "CACHE", 5)
    monkeypatch.setattr(merges, "PAIRS", 5)
    counter = T.Counter(BYTES)
    for text in samples(20):
        assert counter.counts([text])[1] == [library(text)]


def unigram_model():
    """The same pieces read as a unigram model, runs of spaces scored like the rarest pieces so that float sums stay exact."""
    m = spec.ModelProto()
    with open(PIECES, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        p.score = max(p.score, -40_000.0)
    return m.SerializeToString()


@pytest.mark.parametrize("kind", ["merges", "unigram"])
def test_pieces_are_the_library_s(kind):
    model = PIECES if kind == "merges" else unigram_model()
    library = sentencepiece.SentencePieceProcessor(**({"model_file": model} if kind == "merges" else {"model_proto": model}))
    codec = C.Codec(model)
    texts = samples(300 if kind == "merges" else 100)
    for text, packed in zip(texts, codec.encode(texts), strict=True):
        ids = np.frombuffer(packed, "<i4").tolist()
        if kind == "merges":
            assert ids == library.encode(text)
        else:  # equal sums may be split differently
            total = lambda x: sum(codec.scores.get(library.id_to_piece(i), 0.0) for i in x)
            assert ids == library.encode(text) or total(ids) >= total(library.encode(text))
        assert codec.decode(packed) == library.decode(ids) == text.replace("▁", " ")


def test_encoded_documents(spark, documents):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [*samples(30), None, "w" * 3000, "many words " * 4000] + ["same text"] * 10
    df = documents(texts).withColumn("row", F.lit("clash")).withColumn("ids", F.lit(1))
    out = C.encode(df, PIECES)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "ids", "n_pieces"]
    back = {r.doc_id: r for r in C.decode(out, PIECES).collect()}
    for i, t in enumerate(texts):
        assert back[i].ids == library.encode(t or "") and back[i].n_pieces == len(back[i].ids)
        assert back[i].decoded == (t or "").replace("▁", " ")
    digests = {r.doc_id: r for r in C.round_trip(df, PIECES).collect()}
    for i in back:
        assert digests[i].ids_sha256 == hashlib.sha256(np.array(back[i].ids, "<i4").tobytes()).hexdigest() and digests[i].round_trip
    assert C.encode(documents([]), PIECES).count() == 0 and C.round_trip(documents([]), PIECES).count() == 0


def test_decoding_other_ids():
    codec, library = C.load(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for ids in ([], [1, 2], [259], [0], [5, 3000, 2, 400]):
        assert codec.decode(np.array(ids, "<i4").tobytes()) == library.decode(ids)


def test_words_share_their_prefixes():
    codec = C.Codec(PIECES)
    words = sorted({"▁there", "▁thereby", "▁the", "▁therein"})
    assert [merges.shared(a, b) for a, b in zip(words, words[1:])] == [4, 6, 6]
    tables = {w: list(last) for w, last, _ in merges.walk(words, codec.vocabulary)}
    alone = {w: list(last) for x in words for w, last, _ in merges.walk([x], codec.vocabulary)}
    assert tables == alone


def test_ids_by_distinct_words_are_the_library_s(monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [*samples(300), "w" * 3000, "many words\n" * 4000, "\n", "\n\n a\tb\r\n", "\x00 \x01"] + ["same text"] * 10
    for cache, together in ((C.CACHE, C.TOGETHER), (3, 2)):
        monkeypatch.setattr(C, "CACHE", cache)
        monkeypatch.setattr(C, "TOGETHER", together)
        encode = C.library_ids(PIECES)()
        for part in (texts[:100], texts[100:], texts[:20]):
            assert [np.frombuffer(x, "<u2").tolist() for x in encode(part)] == library.encode(part)
    with pytest.raises(ValueError, match="do not fit"):
        C.library_ids(PIECES, width=1)()
