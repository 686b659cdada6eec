import json
import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from loomlog.llm import token_files
from loomlog.llm.tokenfiles import public_path
from tests.llm.helpers import AWKWARD, documents


def round_trip(ids):
    words, raw = token_files.pack(np.array(ids, np.uint64))
    assert token_files.unpack(words, len(ids), raw.astype(np.int64)).tolist() == list(ids)
    return len(words)


def test_pack_round_trips():
    rng = random.Random(1)
    assert round_trip([]) == 0 and round_trip([0] * 60) == 1 and round_trip([1] * 61) == 2
    assert round_trip([2**60, 5, 2**64 - 1, 0]) == 6
    for _ in range(300):
        round_trip([rng.getrandbits(rng.choice([1, 3, 8, 15, 16, 17, 31, 59, 60, 61, 64])) for _ in range(rng.randrange(200))])
    for bits in range(1, 61):
        assert round_trip([2**bits - 1] * 120) == -(-120 // max(c for c in token_files.COUNTS[1:] if 60 // c >= bits))


def test_files_match_the_library(spark, tmp_path):
    path = str(tmp_path / "ids")
    token_files.write_token_files(documents(spark), path)
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    library = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    at, want = 0, []
    for i, t in sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in got] == want


def test_words_alone_encode_like_whole_texts():
    with open(public_path("word_bpe_49k.json"), "rb") as f:
        words = token_files.WordIds(f.read())
    rng = random.Random(4)
    parts = ["Don't", " ", "\n", "é", "ß", "́", "Σ", "ΣΑΣ", "<|endoftext|>", "12", "!!", "\x1c", "\x85", " ", "日本", "İ", "ing", "THE", "'ll", "\t", "Ab.", "cD,", "À,", "x..", ",", ".", "ÿ."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(500)]
    for _ in range(2):  # the second time from the memo
        assert by_text(words, texts) == [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert words.by_word and words.by_stem


def by_text(words, texts):
    ids, sizes = words.encode(pa.array(texts))
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_tokenizers_of_other_kinds_encode_like_the_library():
    with open(public_path("word_bpe_49k.json")) as f:
        cased = json.load(f)
    cased["normalizer"] = None
    with open(public_path("byte_bpe_50k.json")) as f:
        spaced = json.load(f)
    texts = ["Word word WORD. end,", "  it's  x", "", "Éa É.\n\nb"]
    for made, by_word in ((cased, True), (spaced, False)):
        words = token_files.WordIds(json.dumps(made).encode())
        assert (words.by_word, words.by_stem) == (by_word, False)
        assert by_text(words, texts) == [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_bytes_that_are_no_utf8(spark, tmp_path):
    df = spark.range(1).selectExpr("id doc_id", "cast(unhex('61ff2062') as string) text")
    token_files.write_token_files(df, str(tmp_path / "odd"))
    ids = Tokenizer.from_file(public_path("word_bpe_49k.json")).encode("a\ufffd b", add_special_tokens=False).ids
    assert np.frombuffer(token_files.read_token_files(spark, str(tmp_path / "odd")).first().ids, "<u4").tolist() == [*ids, 1]


def test_empty_table(spark, tmp_path):
    token_files.write_token_files(documents(spark, []), str(tmp_path / "none"))
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0
