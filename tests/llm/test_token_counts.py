import random

import pytest
from tokenizers import Tokenizer, models

from loomlog.llm import token_counts
from loomlog.llm.tokenfiles import public_path
from tests.llm.helpers import AWKWARD, documents


@pytest.fixture(scope="module")
def oracle():
    """The tokenizers library's Unigram model over the same pieces, applied to whole texts."""
    pieces = token_counts.pieces_of(public_path("piece_bpe_32k.model"))
    vocab = [("<unk>", 0.0)] + [(f"<0x{i:02X}>", 0.0) for i in range(256)] + pieces
    model = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    return lambda text: len(model.encode("▁" + text.replace(" ", "▁")).ids) if text else 0


def test_counts_match_the_library(spark, oracle):
    got = sorted((r.doc_id or -1, r.n_tokens) for r in token_counts.count_tokens(documents(spark)).collect())
    assert got == sorted((i or -1, oracle(t or "")) for i, t in AWKWARD)


def test_random_texts(oracle):
    counter = token_counts.PieceCounter(token_counts.pieces_of(public_path("piece_bpe_32k.model")))
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice(["the", "ing", " ", "  ", "é", "ß", "𝒳", "\n", "a", "b", "tion", "1", "▁", "梦"]) for _ in range(rng.randrange(60)))
        assert counter.count(text)[0] == oracle(text), text


def test_pieces_across_words():
    counter = token_counts.PieceCounter([("▁", -1.0), ("a", -1.0), ("b", -1.0), ("a▁b", -1.5), ("ab", -2.0)])
    assert counter.count("a b") == (2, -2.5)
    assert counter.count("ab") == (2, -3.0)  # a tie: the longer last piece wins


def test_empty_table(spark):
    assert token_counts.count_tokens(documents(spark, [])).count() == 0
