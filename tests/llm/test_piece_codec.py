import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.llm import piece_codec
from tracewright.llm.piece_codec import PieceCodec, PieceTables, default_model, digests, encode_decode


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=default_model())


@pytest.fixture(scope="module")
def codec():
    return PieceCodec(PieceTables(default_model()))


def same(codec, library, texts):
    ids, at = codec.encode(texts)
    decoded = codec.decode(ids, at)
    for i, text in enumerate(texts):
        want = library.encode(text or "")
        assert ids[at[i] : at[i + 1]].tolist() == want, repr(text)
        assert decoded[i].decode() == library.decode(want)


def test_plain_and_odd_texts(codec, library, spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    same(codec, library, texts)
    same(codec, library, ["", None, " ", "   ", "\n", "\t\n ", " a", "a  b   c    d", "x\r\ny", "▁▁a▁", "日本語 ünï 🙂‍", "\x00a", "{ }\r", "  \n  x", "=" * 300, "aaaa" * 300, "<0x0A> <s> </s> <unk>", "é" * 50])


def odd_segments(rng):
    words = ["international", "the", "und", "ation", "▁", "é", "日本語", "aaaa", "==", "0x", "."]
    yield "".join(rng.choice(list("abcdethe_rin#"), 3000))
    yield "".join(rng.choice(words, 1500))
    yield from ("ab" * 2500, "a" * 5001, "=" * 4097, "abc" * 1000, "日本" * 1500, "tion" * 900 + "s")
    yield "".join(chr(c) for c in rng.integers(33, 0x3000, 4000))


def test_long_segments_merge_in_reach(codec, library, monkeypatch):
    rng = np.random.default_rng(5)
    texts = list(odd_segments(rng))
    same(codec, library, texts)
    monkeypatch.setattr(piece_codec, "LONG", 3)
    plain = ["small words too", "thhaen thhaen international", *("".join(rng.choice(list("etaoinshr"), 40)) for _ in range(300))]
    same(PieceCodec(codec.t), library, [*texts, *plain])


def test_megabytes_without_spaces(codec, library):
    rng = np.random.default_rng(6)
    text = "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 5_000_000))
    ids, _ = codec.encode([text])
    want = np.array(library.encode(text))
    assert np.array_equal(ids, want)
    assert codec.decode(ids, np.array([0, len(ids)]))[0].decode() == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("  \n\tabcdehinorst▁.,;:(){}\r=*")), max_size=60), max_size=5))
def test_any_text(codec, library, texts):
    same(codec, library, texts)


def test_query_columns(docs, corpus, empty, library):
    clash = docs.withColumns({"ids": F.lit(1), "decoded": F.lit("x")})
    got = sorted(digests(encode_decode(clash, default_model())).collect(), key=repr)
    want = []
    for r in corpus:
        ids = library.encode(r[1] or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((r[0], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    assert encode_decode(empty, default_model()).collect() == []
