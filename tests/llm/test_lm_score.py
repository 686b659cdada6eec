import math
import random
import re
import zlib
from collections import Counter
from urllib.parse import urlparse

import numpy as np
import pyarrow.parquet as pq
import pytest

from loomlog.llm import lm_score as lm
from tests.llm.helpers import AWKWARD, documents


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) + [None]


def brute(rows):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    counts = Counter(t for (_, x), h in zip(rows, held) if not h for t in tokens(x))
    n, v = counts.total(), len(counts)
    return sorted((-1 if i is None else i, h, len(ts := tokens(x)), sum(counts[t] > 0 for t in ts), n, round(sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), 6)) for (i, x), h in zip(rows, held))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    follow = {w: [rng.randrange(60) for _ in range(3)] for w in range(60)}
    out = list(AWKWARD)
    for i in range(400):
        w, words = rng.randrange(60), []
        for _ in range(rng.randrange(5, 60)):
            words.append(f"W{w}")
            w = rng.choice(follow[w]) if rng.random() < 0.8 else rng.randrange(60)
        out.append((100 + i, " ".join(words)))
    return out


def digest(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect())


def test_base_matches_brute_force(spark, rows):
    assert digest(lm.score_texts(documents(spark, rows))) == brute(rows)
    assert digest(lm.score_texts(documents(spark, rows), table_bytes=0)) == brute(rows)


def test_held_out_texts_score_better_than_base(spark, rows):
    got = [r for r in lm.score_texts(documents(spark, rows)).collect() if r.held_out and (r.doc_id or 0) >= 100]
    assert len(got) > 20 and sum(r.score for r in got) > sum(r.base_score for r in got) + 0.2 * sum(r.n_tokens for r in got)


def test_floor_of_a_small_filter(spark, rows, monkeypatch):
    monkeypatch.setattr(lm, "FILTER_BYTES", {"unigram": 400, "bigram": 400})
    got = lm.score_texts(documents(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.score <= 0 and math.isfinite(r.score) for r in got)


@pytest.mark.parametrize("limits", [{"unigram": 1 << 20, "bigram": 400}, {"unigram": 100, "bigram": 400}, {"unigram": 100, "bigram": 1 << 20}])
def test_filters_that_do_not_fit_give_the_same_scores(spark, rows, monkeypatch, limits):
    big = [*rows, (2**62 + 1, "W1 W2 W3 unheard"), (-(2**62) - 1, "W1 W2")]
    key = lambda r: (r[0] is None, r[0] or 0, r)
    want = sorted(map(tuple, lm.score_texts(documents(spark, big)).collect()), key=key)
    monkeypatch.setattr(lm, "FILTER_BYTES", limits)
    monkeypatch.setattr(lm, "BATCH_TOKENS", 500)
    got = sorted(map(tuple, lm.score_texts(documents(spark, big)).collect()), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert max(abs(a - b) for g, w in zip(got, want) for a, b in zip(g[5:], w[5:])) < 1e-6


def test_segments_follow_the_text_and_not_only_the_tasks(spark, rows, monkeypatch):
    docs = lm._rows(documents(spark, rows), "doc_id", "text")
    size, few = lm._segments(docs)
    assert size == sum(len((x or "").encode()) for _, x in rows) and few == 16
    monkeypatch.setattr(lm, "SEGMENT_TEXT_BYTES", 100)
    assert size // 100 < lm._segments(docs)[1] <= 2 * size // 100


def test_batches_are_written_in_small_row_groups(spark, rows, monkeypatch):
    monkeypatch.setattr(lm, "BATCH_TOKENS", 100)
    batches = lm._batches(lm._rows(documents(spark, rows * 3), "doc_id", "text").coalesce(1))
    files = [urlparse(f).path for f in batches.inputFiles()]
    groups = [m.row_group(i).num_rows for f in files for m in [pq.ParquetFile(f).metadata] for i in range(m.num_row_groups)]
    assert sum(groups) == batches.count() > 100 and max(groups) <= 4


def test_no_filter_reaches_the_driver_where_texts_are_large(spark, rows, monkeypatch):
    monkeypatch.setattr(lm, "FILTER_BYTES", {"unigram": 1 << 20, "bigram": 400})
    monkeypatch.setattr(lm, "_filter", lambda *a: pytest.fail("put together on the driver"))
    assert digest(lm.score_texts(documents(spark, rows))) == brute(rows)


def test_filter_recovers_levels():
    rng = np.random.default_rng(3)
    hashes = np.unique(rng.integers(0, 2**64, 5000, np.uint64))
    levels = rng.integers(1, 9, len(hashes))
    segments = 16
    own = lm.segment_of(hashes, segments)
    arrays = [[lm.level_bits(hashes[(own == s) & (levels >= q)], q) for s in range(segments)] for q in range(1, 9)]
    made = lm.LogFilter(2.0, segments, 1, np.array([[8 * len(b) for b in row] for row in arrays]), np.concatenate([b for row in arrays for b in row]))
    assert (made.levels(hashes) >= levels).all() and (made.levels(hashes) == levels).mean() > 0.94
    assert (made.levels(rng.integers(0, 2**64, 20000, np.uint64)) > 0).mean() < 0.05


def test_quantisation():
    counts = np.arange(1, 5000)
    for base in (1.25, 2.0):
        back = lm.count_of(lm.levels_of(counts, base), base)
        assert (np.abs(np.log(back / counts)) <= np.log(base) + 1e-9).all() and back[0] == 1


def test_empty_table(spark):
    assert lm.score_texts(documents(spark, [])).count() == 0
    only = lm.score_texts(documents(spark, [(None, "held out alone")])).first()
    assert (only.n_tokens, only.n_known, only.train_tokens, only.base_score, only.score) == (4, 0, 0, 0.0, 0.0)
