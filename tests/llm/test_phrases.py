"""Collocations against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomlog.llm import phrases as m
from tests.llm.helpers import AWKWARD


def brute(rows, least=3, top=2000, longest=5):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda x: x[0].lower(), text or "")):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cands.items():
            inside = any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cands.items())
            if not inside:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string").select("text", "lang", F.lit(1).alias("n"), F.lit("x").alias("phrase"), F.lit(0).alias("words"))


def sample(seed, rows=60):
    rng = random.Random(seed)
    return [("".join(rng.choice(["a", "B", "cc", "é", "\x01", "the"]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "en", "fr", None])) for _ in range(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_collocations_equal_brute_force(spark, seed):
    rows = sample(seed)
    got = sorted(tuple(r) for r in m.collocations(table(spark, rows), least=3).collect())
    assert got == brute(rows)


def test_fewer_rows_than_asked_and_short_top(spark):
    rows = sample(3)
    assert sorted(tuple(r) for r in m.collocations(table(spark, rows), least=4, top=5).collect()) == brute(rows, 4, 5)


def test_wrong_hits_of_the_bit_table_change_nothing(spark, monkeypatch):
    rows = sample(4)
    monkeypatch.setattr(m, "_known", lambda t, h: h == h)
    docs = table(spark, rows).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    counts, _ = m.phrase_counts(docs, least=3)
    want = Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", text.lower()):
            words = piece.split()
            want.update((lang or "und", " ".join(words[i : i + k])) for k in range(1, 6) for i in range(len(words) - k + 1))
    assert {(r.lang, r.phrase): r.a for r in counts.collect()} == {k: v for k, v in want.items() if v >= 3}


def test_texts_longer_than_a_block_and_long_pieces(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(m, "STEP", 64)
    texts = ["one two, " * 50, "word " * 100, "x" * 500, "", None, "ends. with break."]
    batch = pa.record_batch([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])
    words = [w.raw[s:e].decode() for w in m._blocks(iter([batch])) for s, e in zip(w.start, w.end)]
    assert words == re.findall("[^ ,.]+", " ".join(t or "" for t in texts))


def test_exact_scores_of_large_counts(spark):
    a, n, left, right = 10**9 + 7, 10**15 + 37, 10**10 + 19, 3 * 10**11 + 1
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    assert row.select(m._score(F.col("l"), F.col("r"))).first()[0] == 1000 * a * n // (left * right)


def test_awkward_documents(spark):
    rows = [(t, None) for _, t in AWKWARD]
    assert sorted(tuple(r) for r in m.collocations(table(spark, rows), least=2).collect()) == brute(rows, 2)
    assert m.collocations(table(spark, []), least=2).count() == 0


def test_tasks_report_no_texts_of_phrases(spark, monkeypatch):
    made, plain = [], m.map_arrow

    def spied(df, fn, schema, *more):
        made.append(schema)
        return plain(df, fn, schema, *more)

    monkeypatch.setattr(m, "map_arrow", spied)
    docs = spark.createDataFrame([("en", "a b c")] * 6 + [("", "a b c d")] * 5, "lang string, text string").repartition(4)
    counts, totals = m.phrase_counts(docs, least=5)
    assert not [s for s in made if "phrase string" in s]
    assert {tuple(r) for r in totals.collect()} == {("en", 18), ("", 20)}
    got = sorted(tuple(r) for r in counts.collect())
    assert got == sorted((lang, " ".join(x[i:j]), n) for lang, x, n in (("en", "abc", 6), ("", "abcd", 5)) for i in range(len(x)) for j in range(i + 1, len(x) + 1))


def test_words_in_slices(spark, monkeypatch):
    monkeypatch.setattr(m, "SLICE", 3)
    monkeypatch.setattr(m, "HELD", 10)
    monkeypatch.setattr(m, "WORDS_HELD", 2)
    rows = sample(5)
    assert sorted(tuple(r) for r in m.collocations(table(spark, rows), least=3).collect()) == brute(rows)


def test_phrases_of_several_longs(spark):
    texts = [" ".join(f"w{i + j}" for j in range(5)) for i in range(0, 5000, 5)]
    got = m.collocations(table(spark, [(t, "en") for t in texts + texts]), least=2).collect()
    assert [tuple(r) for r in sorted(got)] == [("en", i + 1, t, 2, 2, 2, 10_000, 1000 * 2 * 10_000 // 4) for i, t in enumerate(sorted(texts))]
