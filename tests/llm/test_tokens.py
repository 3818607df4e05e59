import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from webwarden.llm import tokens as m

pytestmark = pytest.mark.skipif(not os.path.isdir(m.TOKENIZER_DIR), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def encoder():
    return m.SpeculativeEncoder(*m.load_vocabulary("byte_bpe_50k"))


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(os.path.join(m.TOKENIZER_DIR, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60), max_size=5))
def test_equals_library(encoder, reference, texts):
    ids, counts = encoder.encode_batch(texts)
    assert ids.tolist() == [i for t in texts for i in reference(t)] and counts.sum() == len(ids)


def test_long_words_and_special_strings(encoder, reference):
    for text in ["x" * 20000, "ab1" * 3000, " " * 3000 + "a", "<|endoftext|> a", "don't  \n\n stop", "\x00\x07é日本🤣"]:
        assert encoder.encode_batch([text])[0].tolist() == reference(text)


def test_every_token_encodes_itself(encoder):
    assert all(encoder.merge(b) == [i] for b, i in list(encoder.ranks.items())[::37])


def test_frames(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "hello hello", 0), (3, "hello", 0)], "doc_id bigint, text string, ids int")
    got = sorted((r["doc_id"], len(r["ids"])) for r in m.encode_texts(df, "byte_bpe_50k").collect())
    assert got == [(1, 0), (2, 0), (3, 1), (3, 2)]
    assert sorted(r["n_tokens"] for r in m.encode_texts(df, "byte_bpe_50k", count_only=True).collect()) == [0, 0, 1, 2]
    assert m.encode_texts(df.limit(0), "byte_bpe_50k").count() == 0


def test_chunks_cover_everything():
    texts = ["a" * n for n in (5, 0, 9, 1, 30, 2)] + [None]
    assert [i for a, b in m.chunks(texts, 10) for i in range(a, b)] == list(range(7))
    assert list(m.chunks([])) == []


def test_forgetting_pairs_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(m, "PAIR_CACHE", 8)
    small = m.SpeculativeEncoder(*m.load_vocabulary("byte_bpe_50k"))
    texts = ["a tokenizer forgets what it has judged", "unbelievably shortsighted encodings", "a tokenizer judges pairs again"]
    for t in texts * 2:
        assert small.encode_batch([t])[0].tolist() == reference(t)
