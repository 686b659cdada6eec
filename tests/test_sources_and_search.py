import json

import pytest
from pyspark.sql import functions as F

from loomlog.functions.text import clean_title, escape_like, snippet, tool_hint
from loomlog.operators import search
from loomlog.plans import relations as plans
from loomlog.sources import logs as src
from tests import logs
from tests.logs import assistant, result, sample, text, tool, user


def test_bad_lines_are_reported_and_skipped(spark, tmp_path):
    path = logs.write(tmp_path / "p", sample(), extra=["{broken", "not json"])
    logs.write(tmp_path / "p" / "sub", [user("v", "x", session="s2")], name="s2.jsonl")
    log = src.read_log(spark, path)
    assert src.raw_messages(log).count() == 5
    q = src.quarantine(log).collect()
    assert len(q) == 1 and q[0].bad_lines == 2 and q[0].file_path.endswith("s1.jsonl")


def test_empty_folder_has_the_same_columns(spark, tmp_path):
    empty = src.read_log(spark, logs.write(tmp_path / "e", [], name="none.jsonl"))
    full = src.read_log(spark, logs.write(tmp_path / "f", sample()))
    for name in plans.TABLES:
        a, b = getattr(plans.Relations(empty), name), getattr(plans.Relations(full), name)
        assert a.dtypes == b.dtypes and a.count() == 0


def test_raw_records_and_browsing(spark, tmp_path):
    rows = sample() + [{"type": "queue-operation", "sessionId": "s9", "timestamp": "2026-02-01T00:00:00Z", "extra": {"x": 1}}]
    raw = src.raw_records(spark, logs.write(tmp_path / "p", rows))
    assert [r.type for r in src.record_types(raw).collect()] == ["assistant", "queue-operation", "user"]
    page = src.browse_raw(raw, session_prefix="s9").collect()
    assert len(page) == 1 and json.loads(page[0].record)["extra"] == {"x": 1}
    assert src.browse_raw(raw, record_type="user", page=2, page_size=1).count() == 1


def test_within_days(spark):
    df = spark.sql("select timestamp'2026-03-26 09:00:00' - make_dt_interval(id) as timestamp, id from range(40) union all select null, -1")
    assert src.within_days(df, 3, "2026-03-26 10:00:00").count() == 3
    assert src.within_days(df, "month", "2026-03-26 10:00:00").count() == 26
    assert src.within_days(df, 0, "2026-03-26 10:00:00").count() == 41
    with pytest.raises(ValueError):
        src.within_days(df, -1, "2026-03-26 10:00:00")


def test_changed_files(spark):
    was = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "file_path string, modified int")
    now = spark.createDataFrame([("a", 1), ("b", 2), ("d", 1)], "file_path string, modified int")
    assert sorted((r.file_path, r.change) for r in src.changed_files(now, was).collect()) == [("b", "changed"), ("c", "gone"), ("d", "new")]
    assert src.changed_files(was, was).count() == 0


def test_views_and_materialized_tables_agree(spark, tmp_path):
    path = logs.write(tmp_path / "p", sample())
    plans.register_views(spark, src.read_log(spark, path))
    assert plans.ad_hoc(spark, "select count(*) n from tool_calls where tool_name = 'Bash'").first().n == 1
    built = plans.materialize(spark, path, str(tmp_path / "out"))
    lazy = plans.Relations(src.read_log(spark, path))
    for name in ("logical_sessions", "tool_calls", "session_stats", "search_corpus"):
        a, b = getattr(lazy, name), built[name]
        common = [c for c in a.columns if c in b.columns]
        assert sorted(map(str, a.select(common).collect())) == sorted(map(str, b.select(common).collect()))
    assert plans.materialize(spark, path, str(tmp_path / "out"))["tool_calls"].count() == 1
    assert spark.read.parquet(str(tmp_path / "out" / "build_meta")).count() == 1


def corpus(spark, tmp_path):
    rows = [user("u1", "find the Login bug"), assistant("a1", [text("the login page and the login form")]), assistant("a2", [tool("t1", "Bash", command="grep login")], ts="2026-01-01T10:00:02Z"), user("u2", [result("t1", "bug found")], ts="2026-01-01T10:00:03Z"), user("u3", [text("blocks prompt")])]
    return plans.Relations(src.read_log(spark, logs.write(tmp_path / "c", rows)))


def test_search(spark, tmp_path):
    r = corpus(spark, tmp_path)
    c = r.search_corpus
    assert sorted(x.content_text for x in c.collect()) == sorted(["find the Login bug", "the login page and the login form", 'Bash: {"command":"grep login"}', "bug found"])
    assert search.search_corpus(r.raw_messages, all_blocks=True).filter("content_text = 'blocks prompt'").count() == 1
    index = search.build_index(c)
    search.save_index(index, str(tmp_path / "ix"))
    index = search.load_index(spark, str(tmp_path / "ix"))
    assert search.bm25(index, "login").count() == 3 and search.bm25(index, "login bug", require_all=True).count() == 1
    best = c.join(search.bm25(index, "login", limit=1), "doc").first()
    assert best.content_text.startswith("the login page") or best.content_text.startswith("Bash")
    found = search.search_sessions(c, index, r.logical_sessions, r.session_stats, "login bug", cwd="/tmp", role="user", since="2026-01-01")
    assert {x.role for x in found.collect()} == {"user"}
    assert search.search_sessions(c, None, r.logical_sessions, r.session_stats, "login bug", require_all=True).count() == 1
    with pytest.raises(ValueError):
        search.filter_hits(c, r.logical_sessions, role="nobody")


def value(spark, text_, expr):
    return spark.createDataFrame([(text_,)], "x string").select(expr(F.col("x"))).first()[0]


def test_snippets(spark):
    long = "a" * 400 + " needle " + "b\n" * 300
    got = value(spark, long, lambda x: snippet(x, ["needle"]))
    assert got.startswith("…") and got.endswith("…") and "needle" in got and "\n" not in got and len(got) == 242
    assert value(spark, "short text", lambda x: snippet(x, ["text"])) == "short text"
    assert value(spark, "z" * 500, lambda x: snippet(x, ["q"])) == "z" * 240
    assert value(spark, None, lambda x: snippet(x, ["q"])) == ""


def test_titles_hints_and_patterns(spark):
    assert value(spark, "<command-name>go</command-name><command-message>/go</command-message><command-args>a  b</command-args>", clean_title) == "go a b"
    assert value(spark, '{"command":"a\\n b","description":"d"}', lambda x: tool_hint(F.lit("Bash"), x)) == "a b"
    assert value(spark, '{"x":"","y":5}', lambda x: tool_hint(F.lit("Other"), x)) == "5"
    assert value(spark, "plain  text", lambda x: tool_hint(F.lit("Other"), x)) == "plain text"
    assert value(spark, '{"command":"' + "c" * 200 + '"}', lambda x: tool_hint(F.lit("Bash"), x)) == "c" * 119 + "…"
    assert escape_like("50%_\\") == "50\\%\\_\\\\"
