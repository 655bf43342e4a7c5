"""Encoding and decoding against the library itself, then the edge cases."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliolink.llm import pieces, queries

tokenizers = pytest.importorskip("public_tokenizers")
library = pytest.importorskip("sentencepiece")
MODEL = tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load_vocabulary(MODEL)


@pytest.fixture(scope="module")
def real():
    return library.SentencePieceProcessor(model_file=MODEL)


def both(vocabulary, texts):
    ids, sizes = pieces.Encoder(vocabulary).encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])], pieces.decode_flat(vocabulary, ids, sizes)


ODD = ["", " ", "  a", "a  b ", "\n\n", "a▁b", "▁", "x\x00y", "é é ﬁ Ⅳ ½ 😀", "\t\r\n \r", "a" * 5000, "ab" * 3000, "<s></s><unk><0x0A>", "⁇", "-" * 1001, " " * 37 + "x"]


def test_odd_texts_equal_the_library(vocabulary, real):
    ids, texts = both(vocabulary, ODD)
    assert ids == [real.encode(t) for t in ODD]
    assert texts == [real.decode(real.encode(t)) for t in ODD]


def test_strings_of_pieces_equal_the_library(vocabulary, real):
    """Words put together from pieces make merges compete, also where a merge opens an earlier one."""
    rng = random.Random(5)
    shown = [real.id_to_piece(k).replace("▁", " ") for k in range(259, real.get_piece_size())]
    texts = ["".join(rng.choice(shown) for _ in range(rng.randrange(1, 40))) for _ in range(2000)]
    texts += ["".join(rng.choice("abcdeirstn -=") for _ in range(rng.randrange(1, 300))) for _ in range(1000)]
    texts += ["".join(rng.choice("aeiortsn") for _ in range(20_000))]
    ids, decoded = both(vocabulary, texts)
    assert ids == [real.encode(t) for t in texts]
    assert decoded == [real.decode(i) for i in ids]
    early = np.flatnonzero(vocabulary.early)
    assert any(set(real.encode(t)) & set(early.tolist()) for t in texts)


@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from(" \n▁abtheingéß<>0x"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text_equals_the_library(vocabulary, real, text):
    ids, decoded = both(vocabulary, [text, "x", text])
    want = real.encode(text)
    assert ids == [want, real.encode("x"), want] and decoded[0] == real.decode(want)


def test_decoding_any_ids_equals_the_library(vocabulary, real):
    """Also bytes that make no character, marks between bytes, and unknown ids."""
    rng = random.Random(2)
    rows = [[rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(260) for _ in range(rng.randrange(0, 12))] for _ in range(3000)]
    flat, sizes = np.array([k for r in rows for k in r], np.int32), np.array([len(r) for r in rows])
    assert pieces.decode_flat(vocabulary, flat, sizes) == [real.decode(r) for r in rows]


def test_a_forgetful_encoder_gives_the_same_ids(vocabulary, monkeypatch):
    texts = ["the quick brown fox", "jumps over", "the lazy dog", "the quick brown fox"]
    plain = pieces.Encoder(vocabulary)
    want = [plain.encode([t])[0].tolist() for t in texts]
    monkeypatch.setattr(pieces, "REMEMBERED", 8)
    forgetful = pieces.Encoder(vocabulary)
    assert [forgetful.encode([t])[0].tolist() for t in texts] == want and len(forgetful.words) < len(plain.words)


def test_small_vocabulary_with_inner_characters():
    """A character that is no piece itself still merges, and is written as bytes where it stays."""
    names = ["<unk>"] + [f"<0x{b:02X}>" for b in range(256)] + ["▁", "a", "aé", "▁a"]
    kinds = [2] + [6] * 256 + [1] * 4
    v = pieces.Vocabulary(names, [0.0] * 257 + [-9.0, -8.0, -1.0, -2.0], kinds)
    ids, texts = both(v, ["aé", "éa é", "a"])
    assert ids[0] == [257, 259] and texts == ["aé", "éa é", "a"]
    assert ids[1][:3] == [257, names.index("<0xC3>"), names.index("<0xA9>")]


def test_unfit_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as form

    model = form.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="as they are"):
        pieces.load_vocabulary(str(tmp_path / "m"))


def test_frames_with_nulls_repeats_and_clashing_names(spark, vocabulary, real):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello  world\n", None), (3, "Hello  world\n", None), (4, "long " * 30_000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    done = pieces.decode(pieces.encode(docs, vocabulary, out="tokens"), vocabulary, "tokens", "again")
    assert done.columns == ["doc_id", "text", "ids", "tokens", "again"]
    for r in done.collect():
        assert r.tokens == real.encode(r.text or "") and r.again == (r.text or "")
    given_ids = spark.createDataFrame([(None,), ([],), ([1, None, 5000, 2],)], "ids array<int>")
    assert [r.decoded for r in pieces.decode(given_ids, vocabulary).collect()] == ["", "", real.decode([1, 5000, 2])]
    assert pieces.decode(pieces.encode(docs.limit(0), vocabulary), vocabulary).count() == 0


def test_query_equals_the_library(spark, sf, real):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op11_sentencepiece(spark, sf).orderBy(F.col("doc_id")).collect()
    assert [r.doc_id for r in got] == sorted(texts)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in got:
        ids = real.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(",".join(map(str, ids))), digest(real.decode(ids)))
