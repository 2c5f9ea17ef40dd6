import random
from array import array

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from skeinbase.llm import bpe

from .helpers import empty, frame, texts

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as f:
        file = f.read()
    return bpe.TextEncoder(file, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(file), special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text(both, text):
    own, reference = both
    assert ids(own.encode(text)) == reference.encode_ordinary(text)


def test_long_pieces_join_as_if_encoded_whole(both):
    own, reference = both
    rng = random.Random(2)
    for alphabet in ("ab", "the in", "éèà", "aAbBcC01", "日本語ひらがな", "=-_/", "ация"):
        for n in (7, 63, 200, 1500):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert ids(own.encode(text)) == reference.encode_ordinary(text)
    assert ids(own.encode("ab" * 20_000)) == reference.encode_ordinary("ab" * 20_000)


def test_kept_pieces_are_forgotten_within_bounds(both, monkeypatch):
    own, reference = both
    monkeypatch.setattr(bpe, "KEPT", 3)
    text = "several different words that are not kept for long"
    assert ids(own.encode(text)) == reference.encode_ordinary(text) and len(own.known) <= 4


def test_rows_and_round_trip(spark, both):
    rows = texts()
    found = bpe.decode_ids(bpe.encode_texts(frame(spark, rows), PATH, P.PATTERN, keep=("key", "spans")), PATH, P.PATTERN).collect()
    expected = sorted((str(i), t or "", str(both[1].encode_ordinary(t or ""))) for i, t in rows)
    assert sorted((str(r.id), bytes(r.decoded).decode(), str(ids(r.ids))) for r in found) == expected
    assert {(r.key, r.spans) for r in found} == {(2, "y")}
    assert bpe.encode_texts(empty(spark), PATH, P.PATTERN).collect() == []


def test_null_ids_decode_to_nothing(spark):
    tokens = spark.createDataFrame([(1, None)], "id long, ids binary")
    assert bytes(bpe.decode_ids(tokens, PATH, P.PATTERN).first().decoded) == b""


def test_decoding_concatenates_up_the_tree(both, monkeypatch):
    monkeypatch.setattr(bpe, "DECODED_AT_ONCE", 2)
    text = "a text of several tokens, decoded in halves"
    assert both[0].encoder.decode(array("I", both[0].encode(text))) == text.encode()
