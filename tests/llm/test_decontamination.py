import random
import time
from collections import Counter

import numpy as np
import pytest

from loomlog.llm import decontamination as d
from tests.llm.helpers import AWKWARD, documents


def grams(text):
    w = d.words_of(text)
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def similarity(a, b):
    shared = sum((a & b).values())
    return shared / (a.total() + b.total() - shared) if shared else 0.0


def brute(text, item):
    """Best weighted Jaccard similarity of an item and the windows of its length."""
    a, b = grams(text), grams(item)
    if not a or not b:
        return 0.0
    want = Counter(b)
    return max(similarity(Counter(a[i : i + len(b)]), want) for i in range(max(1, len(a) - len(b) + 1)))


def corpus(rng, n):
    return [rng.choice("abcdefghijklmnop") * 2 + str(rng.randrange(400)) for _ in range(n)]


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(11)
    items = [(i, " ".join(corpus(rng, rng.choice([5, 6, 9, 12, 13, 14, 15, 20, 27, 33, 47, 60, 121, 300])))) for i in range(40)]
    texts = []
    for i in range(100):
        words = corpus(rng, rng.randrange(400))
        if i % 2:
            passage = rng.choice(items)[1].split()
            for _ in range(rng.randrange(1 + len(passage) // 12)):
                passage[rng.randrange(len(passage))] = f"edit{rng.randrange(9)}"
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage
        texts.append((1000 + i, " ".join(words).upper() if i % 5 == 1 else " ".join(words)))
    return items, texts + AWKWARD + [(5000, items[3][1]), (5001, items[-1][1]), (5002, items[-1][1] + " tail")]


def test_matches_brute_force(spark, planted):
    items, texts = planted
    bench = spark.createDataFrame([*items, (99, None), (98, ""), (97, "only four words here")], "item_id long, text string").selectExpr("*", "1 doc_id")
    got = {(r.doc_id, r.item_id): r for r in d.find_contamination(documents(spark, texts), bench).collect()}
    want = {(i, k): s for i, t in texts for k, item in items if (s := brute(t, item)) >= 0.8}
    missed = [(k, s) for k, s in want.items() if k not in got]
    assert not [k for k in got if k not in want]
    assert not missed
    assert all(abs(r.similarity - want[k]) < 1e-9 for k, r in got.items())


def test_clean_documents(spark, planted):
    items, texts = planted
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = d.clean_documents(documents(spark, texts), bench)
    assert clean.columns == documents(spark, []).columns
    hit = {i for i, t in texts if any(brute(t, item) == 1.0 for _, item in items)}
    assert not hit & {r.doc_id for r in clean.collect()}
    assert {i for i, t in texts if all(brute(t, item) < 0.8 for _, item in items)} == {r.doc_id for r in clean.collect()} - {i for i, t in texts if any(brute(t, item) >= 0.8 for _, item in items)}


def test_passes(spark, planted, monkeypatch):
    items, texts = planted
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, d.find_contamination(documents(spark, texts[:40]), bench).collect()))
    monkeypatch.setattr(d, "PASS_BYTES", 2000)
    assert sorted(map(tuple, d.find_contamination(documents(spark, texts[:40]), bench).collect())) == whole


def test_block_lists_give_all_within_the_radius():
    rng = np.random.default_rng(2)
    for m in (3, 4000):
        prints = rng.integers(0, 1 << 64, m, np.uint64)
        asked = np.concatenate([prints[:40] ^ np.uint64(sum(1 << int(b) for b in rng.permutation(64)[:k])) for k in range(0, 24)])
        window, member = d.Blocks(np.arange(m), prints).near(asked)
        want = np.nonzero(np.bitwise_count(asked[:, None] ^ prints) <= d.RADIUS)
        assert sorted(zip(window.tolist(), member.tolist())) == sorted(zip(want[0].tolist(), want[1].tolist()))


def test_time_hardly_grows_with_items():
    rng = random.Random(3)
    texts = [" ".join(corpus(rng, 300)) for _ in range(200)]
    taken = []
    for n in (100, 3000):
        items = d.Items([(i, " ".join(corpus(rng, rng.randrange(10, 200)))) for i in range(n)])
        began = time.perf_counter()
        list(d.search(texts, items))
        taken.append(time.perf_counter() - began)
    assert taken[1] < 3 * taken[0] + 1


def test_repeated_passages_in_one_text():
    rng = random.Random(4)
    passage = " ".join(corpus(rng, 40))
    found = list(d.search([" ".join([passage] * 500)], d.Items([(1, passage), (1, passage), (None, passage)])))
    assert sorted(map(str, found)) == sorted(["(0, 1, 1.0, 0, 40)", "(0, None, 1.0, 0, 40)"])


def test_very_long_text():
    rng = random.Random(6)
    passage, words = corpus(rng, 40), corpus(rng, 300_000)
    words[200_000:200_000] = passage
    assert list(d.search([" ".join(words)], d.Items([(1, " ".join(passage))]))) == [(0, 1, 1.0, 200_000, 40)]


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert d.find_contamination(documents(spark, []), bench).count() == 0
    assert d.find_contamination(documents(spark), bench.filter("false")).count() == 0
    assert d.clean_documents(documents(spark), bench.filter("false")).count() == len(AWKWARD)


def test_item_of_any_length_alone_and_at_the_end(spark):
    rng = random.Random(5)
    words = [f"w{i}x{rng.randrange(10**6)}" for i in range(400)]
    texts = [" ".join(words[i : i + i % 90 + 5]) for i in range(5, 95)]
    for text in texts:
        assert [f[2] for f in d.search([text], d.Items([(1, text)]))] == [1.0]
    at_end = [(text, k) for text in texts for k in (4, 8) for _ in range(2)]
    missed = [(len(t.split()), k) for t, k in at_end if not list(d.search(["lead " * 9, " ".join(corpus(rng, k)) + " " + t], d.Items([(1, t)])))]
    assert not missed
    bench = spark.createDataFrame([(1, texts[10])], "item_id long, text string")
    assert d.find_contamination(spark.createDataFrame([(7, texts[10])], "doc_id long, text string"), bench).count() == 1


def test_clean_documents_judges_each_row_by_its_text(spark):
    words = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    rows = [(None, " ".join(words)), (None, "other text of more than five words"), (3, " ".join(words)), (3, "still other text of six words")]
    clean = d.clean_documents(documents(spark, rows), bench)
    assert sorted(r.text for r in clean.collect()) == sorted([rows[1][1], rows[3][1]])
