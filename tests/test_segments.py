import random

from loomlog.operators import search, segments
from loomlog.plans import relations as plans
from loomlog.plans.indexing import index_build
from loomlog.streaming import stream
from tests import logs
from tests.logs import assistant, text, user

SCHEMA = "doc long, part int, content_text string"


def ranked(index, query, **how):
    return sorted((r.doc, round(r.score, 9)) for r in search.bm25(index, query, **how).collect())


def test_updates_rank_as_a_fresh_index(spark, tmp_path):
    rng, out, held = random.Random(5), str(tmp_path / "ix"), {}
    words = ["login", "bug", "form", "page", "the", "the", "the"]
    for step in range(6):
        parts = [0, 1, 2, 3] if step == 0 else [rng.randrange(4)]
        for part in parts:
            for doc in [d for d in held if d % 4 == part and rng.random() < 0.3]:
                del held[doc]
            for doc in range(part, 40, 4):
                if rng.random() < 0.8:
                    held[doc] = None if rng.random() < 0.2 else " ".join(rng.choices(words, k=rng.randrange(12)))
        rows = spark.createDataFrame([(d, d % 4, t) for d, t in held.items()], SCHEMA)
        before = segments.current(spark, out)
        v = segments.sync(rows.filter(rows.part.isin(parts)), out, None if step == 0 else parts)
        assert (v.version, v.n_docs) == (step + 1, len(held)) and v.version == before.version + 1
    assert 0 < len(v.segments) <= 3 * segments.FAN and len(v.segments) < 6  # some were merged
    index, fresh = segments.open_index(spark, out), search.build_index(rows)
    for query, how in (("the bug", {"require_all": True}), ("login form", {}), ("", {})):
        assert ranked(index, query, **how) == ranked(fresh, query, **how)
    assert segments.vacuum_index(spark, out, keep=1) > 0
    assert ranked(segments.open_index(spark, out), "login the") == ranked(fresh, "login the")


def test_nothing_changed_and_everything_gone(spark, tmp_path):
    out = str(tmp_path / "ix")
    rows = spark.createDataFrame([(1, 0, "a b"), (1, 0, "b"), (2, 0, None), (None, 0, "b"), (3, 0, "")], SCHEMA)
    first = segments.sync(rows, out)
    assert (first.n_docs, first.total_len, len(first.segments)) == (3, 3, 1)
    assert segments.sync(rows, out).segments == first.segments
    index = segments.open_index(spark, out)
    assert [(r.doc, r.tf, r.len) for r in index.postings.filter("term = 'b'").collect()] == [(1, 2, 3)]
    empty = segments.sync(rows.filter("false"), out)
    assert (empty.n_docs, empty.total_len) == (0, 0) and ranked(segments.open_index(spark, out), "b") == []
    assert ranked(segments.open_index(spark, str(tmp_path / "none")), "b") == []


def test_only_the_terms_folders_are_read(spark, tmp_path):
    out = str(tmp_path / "ix")
    segments.sync(spark.createDataFrame([(i, 0, f"w{chr(97 + i)} the") for i in range(20)], SCHEMA), out)
    plan = search.bm25(segments.open_index(spark, out), "the")._jdf.queryExecution().executedPlan().toString()
    assert "term_bucket" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]


def test_index_follows_a_build(spark, tmp_path):
    folder, built, out = tmp_path / "log", str(tmp_path / "built"), str(tmp_path / "ix")
    for i in range(12):
        path = logs.write(folder, [user(f"u{i}", f"find bug {i}", session=f"s{i}"), assistant(f"a{i}", [text("the login form")], session=f"s{i}")], f"s{i}.jsonl")
    plans.materialize(spark, path, built)
    index_build(spark, built, out)
    logs.write(folder, [user("u3", "find the page", session="s3"), assistant("a3", [text("a login page")], session="s3"), user("v3", "thanks for the page", session="s3")], "s3.jsonl")
    (folder / "s5.jsonl").unlink()
    assert stream.refresh(spark, path, built)
    v = index_build(spark, built, out)
    assert index_build(spark, built, out) == v
    assert v.version == 2 and v.segments[-1][2] == 3 and v.n_docs == 23
    corpus = plans.read_build(spark, built)["search_corpus"]
    for query in ("login page", "bug"):
        assert ranked(segments.open_index(spark, out), query) == ranked(search.build_index(corpus), query)


def test_terms_of_odd_texts_in_sorted_runs_without_a_shuffle(spark, tmp_path, monkeypatch):
    out, made, plain = str(tmp_path / "ix"), [], segments._write_segment
    monkeypatch.setattr(segments, "RUN", 5)
    monkeypatch.setattr(segments, "_write_segment", lambda postings, docs, path: made.append(postings) or plain(postings, docs, path))
    texts = ["The Key İstanbul A1b2\x00c", "x" * 5000, "été d'ÉTÉ \U0001d54f", "b a b a c", "", None, "ΣΣ zſ", "12 34"]
    rows = spark.createDataFrame([(f"d{9 - i}", 0, t) for i, t in enumerate(texts)], "doc string, part int, content_text string")
    segments.sync(rows.coalesce(1), out)
    want = search.build_index(rows.filter("content_text is not null"))
    expected = sorted(tuple(r) for r in want.postings.join(want.doc_len, "doc").select("term", "doc", "tf", "len").collect())
    assert sorted(tuple(r) for r in segments.open_index(spark, out).postings.select("term", "doc", "tf", "len").collect()) == expected
    assert "Aggregate" not in made[0]._jdf.queryExecution().optimizedPlan().toString()
    keys = [(r.term, r.doc) for r in made[0].collect()]
    assert sum(a > b for a, b in zip(keys, keys[1:])) <= 3 < len(keys) // 2
