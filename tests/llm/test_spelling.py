"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from loomlog.llm import spelling as m
from tests.llm.helpers import AWKWARD, documents


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute(rows):
    n = Counter()
    for i, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += len(word) >= 7
    n = {w: c for w, c in n.items() if c >= 2}
    by = {w: [x for x in n if near(w, x)] for w in n}
    form = {w: min(((-n[x], x) for x in by[w] if n[x] >= 10 * n[w]), default=(0, None))[1] for w in n}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted(((w, form[w], root(w), n[w], len(by[w]), n.get(form[w])) for w in n), key=str)


def found(df, **kw):
    return sorted((tuple(r) for r in m.spelling_groups(df, **kw).collect()), key=str)


def sample(seed, docs=30):
    rng, rows = random.Random(seed), []
    common = ["".join(rng.choice("abcdé") for _ in range(rng.randint(7, 10))) for _ in range(12)]
    for i in range(docs):
        words = []
        for _ in range(80):
            w = rng.choice(common[: rng.choice([2, 12])])
            if rng.random() < 0.08:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", "a", "ß" + w[k]]) + w[k + 1 :]
            words.append(w)
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", range(60))
def test_composition_equals_brute_force(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("ab" if seed % 2 else "abc") for _ in range(rng.randint(0, 6))) for _ in range(60)})
    got = sorted(tuple(sorted(x)) for x in m.composed(words).tolist())
    assert got == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if near(words[i], words[j])]


def test_acceptor_is_minimal():
    a = m.Acceptor(["cap", "caps", "map", "maps", "tap", "taps"])
    assert len(a.final) == 5 and a.size[a.start] == 6


def test_words_of_great_length():
    words = sorted(["a" * 5000, "a" * 5001, "b" + "a" * 5000, "a" * 4999 + "b"])
    got = {tuple(sorted(x)) for x in m.composed(words).tolist()}
    assert got == {(i, j) for i in range(4) for j in range(i + 1, 4) if near(words[i], words[j])}


@pytest.mark.parametrize("most", [20_000, 5])
def test_groups_equal_brute_force(spark, most):
    rows = sample(1)
    assert found(documents(spark, rows), most_words=most) == brute(rows)


def test_awkward_documents(spark):
    rows = AWKWARD + [(8, "Straßen straßen ÄPFELCHEN äpfelchen x÷y×zzzzzzz naïveté"), (9, "z" * 20000 + " " + "z" * 20000)]
    assert found(documents(spark, rows)) == brute(rows)
    assert m.spelling_groups(documents(spark, [])).count() == 0
