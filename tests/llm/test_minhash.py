"""Near duplicates by MinHash against brute force."""

import random

import numpy as np
import pytest

from loomlog.llm import minhash as m
from tests.llm.helpers import AWKWARD, documents


def brute(rows, percent=85):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    last = lambda x: (x is None, x or 0)
    least = {x: min((rows[i][0] for i in range(len(rows)) if label[i] == x), key=last) for x in set(label)}
    return sorted(((rows[i][0], len(sets[i]), least[label[i]]) for i in range(len(rows))), key=str)


def found(df, **kw):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in m.near_duplicates(df, **kw).collect()), key=str)


def copies(seed, groups=4, each=14):
    """Groups of texts with a few words replaced, some beyond the threshold of their origin."""
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(30, 120))]
        for k in range(each):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25)) if k else 0):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows) * 3 % 1009, " ".join(words)))
    return rows


def test_awkward_documents(spark):
    assert found(documents(spark)) == brute(AWKWARD)
    assert m.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("block", [256, 3])
def test_links_equal_brute_force_in_short_and_long_lists(spark, block):
    rows = copies(5)
    assert found(documents(spark, rows), block=block) == brute(rows)


def test_short_texts_and_case(spark):
    rows = [(1, "one Two"), (2, "ONE two"), (3, "one two three"), (4, "x"), (5, None), (6, " ")]
    assert [r[2] for r in found(documents(spark, rows))] == [1, 1, 3, 4, 5, 6]


def test_posterior_bound():
    p = 0.85 + 0.15 / 256
    rng = np.random.default_rng(1)
    for n in (64, 320):
        least = m.least_matches(n)
        # Draws from the posterior below the bound do not reach the threshold, those well above it may.
        assert (rng.beta(least, n - least + 2, 200_000) >= p).mean() < 1e-4
        assert (rng.beta(n * p, n * (1 - p), 20_000) >= p).mean() > 0.1


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 1300, dtype=np.uint64)
    f = m.permutations(320)
    a, b = m.signature(pool[:1000], *f), m.signature(pool[300:], *f)
    assert abs((a == b).mean() - 700 / 1300) < 0.1
