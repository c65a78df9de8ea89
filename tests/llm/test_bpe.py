import base64
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomway.llm import bpe
from loomway.llm.encoding import VOCABULARY_PATH, encode_corpus, round_trip


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.parse(open(VOCABULARY_PATH, "rb").read())


@pytest.fixture(scope="module")
def public():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY_PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_against_both_public_libraries(vocabulary, public):
    t = Tokenizer.from_file(VOCABULARY_PATH.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    texts = ["", " ", "  a", "I'll go, it's 5'o'clock'S", "\n\n \t x", "don't''ll", "Ligne n° 12 — état 東京 🚋👩‍🔬", "<|endoftext|>", "a" * 5000, " " * 3000 + "x", " " * 3000, "\n" * 700 + " y", "1" * 2000 + "é" * 900, "!?" * 1500 + "'ll", "x" * 600 + "'s", "é" * 700]
    for x in texts:
        want = public.encode_ordinary(x)
        assert bpe.encode(vocabulary, x) == want == t.encode(x, add_special_tokens=False).ids
        assert bpe.decode(vocabulary, want) == x


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \n\t'abcslletrvdm.,!é東ß12½🚋́ ", max_size=60), st.integers(1, 9))
def test_chunks_do_not_matter(vocabulary, public, text, size):
    e = bpe.StreamEncoder(vocabulary)
    got = [i for k in range(0, len(text), size) for i in e.feed(text[k : k + size])] + e.finish()
    assert got == public.encode_ordinary(text)


def test_long_runs_in_small_chunks(vocabulary, public, monkeypatch):
    monkeypatch.setattr(bpe, "HOLD_CHARS", 16)
    r = random.Random(5)
    for _ in range(40):
        text = "".join(r.choice(["ab", "the", "aaaa", " ", "\n", "12", "!!", "é", "'s", "ing"]) * r.choice([1, 2, 30]) for _ in range(25))
        e, i, got = bpe.StreamEncoder(vocabulary), 0, []
        while i < len(text):
            k = r.randrange(1, 20)
            got += e.feed(text[i : i + k])
            i += k
        assert got + e.finish() == public.encode_ordinary(text)


def test_memory_stays_bounded(vocabulary):
    t = bpe.PieceTransducer(vocabulary)
    word = b"theinternationalizationofwords"
    for _ in range(400):
        t.feed(word)
        assert len(t.data) <= 8 * vocabulary.lookahead


def test_decoder_waits_for_whole_characters(vocabulary, public):
    d = bpe.StreamDecoder(vocabulary)
    ids = public.encode_ordinary("🚋é東")
    assert "".join(d.feed([i]) for i in ids) + d.finish() == "🚋é東"


def test_corpus(spark, public):
    rows = [(1, "a b"), (2, ""), (3, None), (None, "x"), (1, "a b"), (4, "long " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as tokens")
    got = sorted(((r.doc_id, r.ids) for r in encode_corpus(df).collect()), key=repr)
    assert got == sorted(((i, public.encode_ordinary(t or "")) for i, t in rows), key=repr)
    assert all(r.same for r in round_trip(df).collect())
    assert encode_corpus(df.limit(0)).count() == 0


def test_all_documents(spark, public):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: public.encode_ordinary(r.text or "") for r in df.collect()}
    assert {r.doc_id: r.ids for r in encode_corpus(df).collect()} == want
