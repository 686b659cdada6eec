import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from loomlog.llm import bpe
from loomlog.llm.tokenfiles import public_path, ranks_of
from tests.llm.helpers import AWKWARD, documents


@pytest.fixture(scope="module")
def ranks():
    with open(public_path("byte_bpe_50k.tiktoken"), "rb") as f:
        return ranks_of(f.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_digests_match_the_library(spark, library):
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip_digests(documents(spark)).collect())
    want = []
    for i, t in AWKWARD:
        ids = library.encode_ordinary(t or "")
        want.append((i or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_random_texts(ranks, library):
    encoder, rng = bpe.Encoder(ranks, public_tokenizers.PATTERN), random.Random(3)
    alphabet = ["a", "e", "th", "ing", " ", "  ", "\n", "'s", "'ll", "é", "ß", "𝒳", "日本", "1", "99", "###", "\x1c", "\x85", " ", "​", "\x00", "ñ", "qx", "zz"]
    for _ in range(2000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode_ordinary(text), repr(text)
    for n in (1, 2, 3, 7, 100, 1001):
        for unit in ("a", "ab", "aab", "-", "=", "xyz", "é"):
            assert np.frombuffer(encoder.encode(unit * n), "<u4").tolist() == library.encode_ordinary(unit * n)


def test_full_caches_change_nothing(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 20)
    monkeypatch.setattr(bpe, "MEMO_PIECES", 3)
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    text = "Lazily determinised transducers forget everything now and then, yet the ids stay the same."
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_streaming_decoder_holds_unfinished_characters(ranks, library):
    table = bpe.token_table(ranks)
    text = "né 𝒳 日本"
    ids = library.encode_ordinary(text)
    parts = list(bpe.decode_stream((np.array([i], "<u4").tobytes() for i in ids), table))
    assert "".join(parts) == text and len(parts) > len(text) // 2
    assert "".join(bpe.decode_stream([np.array([10**6], "<u4").tobytes()], table)) == "�"


def test_bytes_that_are_no_utf8(spark, library):
    df = spark.range(1).selectExpr("id doc_id", "cast(unhex('61ff2062') as string) text")
    row = bpe.round_trip_digests(df).first()
    assert row.n_tokens == len(library.encode_ordinary("a\ufffd b")) and row.decoded_sha256 == hashlib.sha256("a\ufffd b".encode()).hexdigest()


def test_steps_alone_give_the_same_digests(spark):
    docs = documents(spark)
    apart = bpe.decode_ids(bpe.encode_texts(docs)).selectExpr("doc_id", "n_tokens", "sha2(ids, 256) ids_sha256", "sha2(cast(text as binary), 256) decoded_sha256")
    assert sorted(map(str, apart.collect())) == sorted(map(str, bpe.round_trip_digests(docs).collect()))


def test_empty_table(spark):
    assert bpe.round_trip_digests(documents(spark, [])).count() == 0
