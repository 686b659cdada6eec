import pytest
from pyspark.sql import functions as F

from loomlog.operators import metrics, relations
from loomlog.plans.relations import Relations
from loomlog.sources.logs import read_log
from tests import logs
from tests.logs import assistant, result, sample, text, tool, user


@pytest.fixture
def rel(spark, tmp_path):
    return lambda records, **kw: Relations(read_log(spark, logs.write(tmp_path / "p", records)), **kw)


def test_sample_session(rel):
    r = rel(sample())
    s = r.logical_sessions.first()
    assert (s.user_messages, s.assistant_messages, s.project, s.model, s.git_branch) == (1, 2, "test", "claude-opus-4-7", "main")
    assert s.duration_sec == 5.0 and s.duration.total_seconds() == 5.0
    call = r.tool_calls.collect()
    assert len(call) == 1 and call[0].tool_name == "Bash" and call[0].execution_sec == 2.5 and call[0].is_error is False
    assert call[0].tool_use_result == '{"stdout":"a b"}'
    stats = r.session_stats.first()
    assert stats.tool_count == 1 and stats.files_read == 0 and stats.commands is None and stats.first_prompt == "Please list the files"


def test_project_map(spark, rel):
    names = spark.createDataFrame([("/tmp/test", "my-project")], "cwd string, project_name string")
    assert rel(sample(), project_map=names).logical_sessions.first().project == "my-project"
    assert rel([user("u1", "hi", cwd="/a/b//")]).logical_sessions.first().project == "b"


def test_long_spans_are_elapsed_time(rel):
    r = rel([user("u1", "a", ts="2026-01-31T00:00:00Z"), user("u2", "b", ts="2026-03-05T01:00:01Z")])
    assert r.logical_sessions.first().duration_sec == 33 * 86400 + 3601


def test_bad_time_stamp_is_null(rel):
    assert rel([user("u1", "a", ts="yesterday"), user("u2", "b")]).raw_messages.filter("timestamp is null").count() == 1


def test_earliest_value_that_is_not_null(rel):
    rows = [user("u1", "a", cwd=None), user("u2", "b", ts="2026-01-01T11:00:00Z", cwd="/later"), user("u3", "c", ts="2026-01-01T10:30:00Z", cwd="/first")]
    assert rel(rows).logical_sessions.first().cwd == "/first"


def test_kinds(rel):
    rows = [
        assistant("a1", [{"type": "thinking", "thinking": "hm", "signature": "x"}, text("t"), tool("t1", "Read", file_path="/x")]),
        user("u1", [result("t1")]),
        user("u2", "<command-name>/go</command-name>"),
        user("u3", "<local-command-stdout>"),
        user("u4", "do it", side=True),
        user("u5", "prompt"),
        user("u6", [text("block prompt")]),
        user("u7", []),
    ]
    got = {(b.uuid, b.block_idx): b.kind for b in rel(rows).message_blocks.collect()}
    assert got == {("a1", 0): "agent_thinking", ("a1", 1): "agent_text", ("a1", 2): "agent_tool_call", ("u1", 0): "tool_result", ("u2", 0): "slash_command", ("u3", 0): "slash_command", ("u4", 0): "subagent_prompt", ("u5", 0): "human_prompt", ("u6", 0): "human_prompt"}


def test_turns_titles_and_commands(rel):
    rows = [
        user("u0", "<command-name>/clear</command-name>", ts="2026-01-01T09:00:00Z"),
        user("u1", "<local-command-caveat>x", ts="2026-01-01T09:30:00Z"),
        *sample(),
        user("u8", [text("x <command-name>one</command-name> <command-name>two</command-name>")], ts="2026-01-01T12:00:00Z"),
    ]
    r = rel(rows)
    assert [t.turn_order for t in r.conversation_turns.orderBy("turn_order").collect()] == [1, 2, 3, 4, 5, 6, 7]
    assert r.session_titles.first().first_prompt == "Please list the files"
    assert sorted(c.command for c in r.message_commands.collect()) == ["/clear", "one", "two"]
    assert metrics.command_list(r.message_commands).first().commands == "one, two"


def test_string_error_flag_is_no_error(rel):
    rows = [assistant("a1", [tool("t1", "Bash", command="x"), tool("t2", "Bash", command="y")]), user("u1", [result("t1", error="true"), result("t2", error=True)])]
    assert {c.tool_use_id: c.is_error for c in rel(rows).tool_calls.collect()} == {"t1": None, "t2": True}


def test_copies_of_calls_multiply_unless_deduped(rel):
    twice = [assistant("a1", [tool("t1", "Read", file_path="/x")]), assistant("a1b", [tool("t1", "Read", file_path="/x")]), user("u1", [result("t1")]), user("u1b", [result("t1")])]
    msgs = rel(twice).raw_messages
    assert relations.tool_calls(msgs).count() == 4 and relations.tool_calls(msgs, dedupe=True).count() == 1


def test_file_metrics(rel):
    rows = [assistant("a1", [tool("t1", "Read", file_path="/tmp/test/a"), tool("t2", "Read", file_path="/etc/b"), tool("t3", "Read", file_path="/tmp/test2/c"), tool("t4", "Edit", file_path="/tmp/test/a"), tool("t5", "NotebookEdit", notebook_path="/tmp/test/n")])]
    r = rel(rows)
    m = metrics.file_metrics(r.file_reads, r.file_writes, r.logical_sessions).first()
    assert (m.files_read, m.files_read_only, m.files_outside, m.files_edited) == (3, 2, 1, 2)


def test_timeline(rel):
    r = rel(sample())
    rows = relations.session_timeline(r.message_blocks, r.tool_calls, r.assistant_message_costs).orderBy("timestamp", "block_idx").collect()
    assert [(x.kind, x.is_first_block, x.input_tokens, x.tool_hint) for x in rows] == [("human_prompt", True, None, ""), ("agent_text", True, 100, ""), ("agent_tool_call", False, None, "ls -la && pwd"), ("agent_text", True, 10, "")]


def test_sorting_and_filters(rel):
    rows = sample() + [user("v1", "other", session="s2", cwd="/x/y"), user("v2", "<command-name>/go</command-name>", session="s2", cwd="/x/y")]
    r = rel(rows)
    page = metrics.list_sessions(r.session_stats, "cost", descending=True, page_size=25)
    assert [s.session_id for s in page.collect()] == ["s1", "s2"]
    assert [s.session_id for s in metrics.list_sessions(r.session_stats, "cost", descending=False, page_size=25).collect()] == ["s2", "s1"]
    assert [s.session_id for s in metrics.list_sessions(r.session_stats, page_size=25, commands=r.message_commands, command="/go").collect()] == ["s2"]
    with pytest.raises(ValueError):
        metrics.list_sessions(r.session_stats, "nope")


def test_same_result_on_one_partition(spark, rel):
    r = rel(sample() * 3)
    want = sorted(map(str, r.session_stats.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert sorted(map(str, rel(sample() * 3).session_stats.collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_headline_without_calls(spark, rel):
    r = rel([user("u1", "hi")])
    h = metrics.headline(r.logical_sessions, r.tool_calls.filter(F.lit(False)), "2026-01-01 12:00:00").first()
    assert (h.sessions, h.today, h.this_week, h.success_rate) == (1, 1, 1, 100.0)
