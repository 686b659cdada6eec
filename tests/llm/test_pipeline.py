import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from loomlog.llm.tokenfiles import public_path, ranks_of
from tests.llm.helpers import AWKWARD
from tests.llm.test_decontamination import brute as contained
from tests.llm.test_quality import brute as measures
from tests.llm.test_simhash import brute_components
from loomlog.llm.simhash import fingerprint


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    prose = lambda n: " ".join(rng.choice(["stone", "river", "lamp", "cloud", "green", "over", "seven", "paper"]) + rng.choice("abcdefgh") for _ in range(n))
    items = [(i, prose(30)) for i in range(6)]
    rows = list(AWKWARD) + [(100 + i, prose(rng.randrange(25, 200))) for i in range(40)]
    rows += [(200 + i, rows[-1 - i][1]) for i in range(5)]
    rows += [(300 + i, prose(40) + " " + items[i][1] + " " + prose(20)) for i in range(6)]
    rows += [(400, prose(40) + " mail ann@mail.example.org or 10.2.3.4"), (401, "short text"), (402, " ".join(f"{w}###" for w in prose(50).split()))]
    root = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), rows, items


def test_run_matches_brute_force(spark, tables):
    root, rows, items = tables
    ranks = ranks_of(open(public_path("byte_bpe_50k.tiktoken"), "rb").read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def good(t):
        n, chars, symbols, dup, _, failed = measures(t)
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        return not (failed or 10 * symbols > chars or 10 * dup > 3 * len(lines) or chars < 2 * n or chars > 20 * n)

    kept = [(i, t) for i, t in rows if good(t)]
    least = brute_components([(i, fingerprint(t)) for i, t in kept])
    kept = list({i: (i, t) for (i, t), (_, c) in zip(kept, least) if i == c}.values())
    kept = [(i, t) for i, t in kept if all(contained(t, item) < 0.8 for _, item in items)]
    kept = [(i, t.replace("ann@mail.example.org", "[EMAIL]").replace("10.2.3.4", "[IP]")) for i, t in kept]
    want = []
    for i, t in kept:
        ids = library.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, root).collect()) == sorted(want)
    assert {i for i, *_ in want} >= {400} and not {i for i, *_ in want} & ({401, 402} | set(range(300, 306)))


def test_stages_keep_the_columns(spark, tables):
    root, rows, _ = tables
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, root).dtypes == docs.dtypes
        assert stage(spark, docs.filter("false"), root).count() == 0


def test_columns_named_like_the_stages_own_stay(spark):
    from loomlog.llm import pii, simhash

    names = ["_hash", "_doc", "_text", "_rows", "_spans", "_row", "_id", "c0", "a b"]
    rows = [(1, "Write to ann.lee@example.org today please", *range(70, 70 + len(names))), (1, "Write to ann.lee@example.org today please", *range(70, 70 + len(names))), (2, "Nothing personal is said in this one", *range(len(names)))]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` long" for c in names))
    assert sorted(map(tuple, simhash.one_of_each(df).collect())) == sorted(set(rows))
    got = sorted(map(tuple, pii.redact(df).collect()))
    assert [r[2:] for r in got] == sorted(r[2:] for r in rows)[::-1] and "[EMAIL]" in got[0][1] and pii.redact(df).columns == df.columns
