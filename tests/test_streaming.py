import os

import pytest
from pyspark.sql import functions as F

from loomlog.functions.pricing import rates
from loomlog.operators.cost import session_cost
from loomlog.plans import relations as plans
from loomlog.sources.logs import changed_files, list_files, read_log
from loomlog.streaming import stream as st
from tests import logs
from tests.logs import assistant, sample, text, user

USE = {"input_tokens": 10**6}


def run(df, tmp_path, mode="append"):
    name = f"q{abs(hash(str(tmp_path)))}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def messages():
    rows = []
    for h in range(6):
        rows.append(assistant(f"a{h}", [text("x")], ts=f"2026-01-01T{h:02d}:10:00Z", usage=USE))
        rows.append(assistant(f"a{h}b", [text("y")], ts=f"2026-01-01T{h:02d}:10:01Z", mid=f"m-a{h}", usage=USE))
    return rows


def test_stream_costs_and_windows_match_batch(spark, tmp_path):
    path = logs.write(tmp_path / "p", messages())
    deduped = run(st.stream_costs(st.stream_log(spark, path)), tmp_path / "a")
    assert deduped.count() == 6
    batch = plans.Relations(read_log(spark, path)).assistant_message_costs
    want = {(str(r.start), r.messages, r.cost_usd) for r in st.stream_cost_windows(batch, delay=None).collect()}
    got = {(str(r.start), r.messages, r.cost_usd) for r in run(st.stream_cost_windows(st.stream_costs(st.stream_log(spark, path)), delay=None), tmp_path / "b").collect()}
    assert got < want and len(want) - len(got) == 1  # the last window is still open


def test_stream_sessions(spark, tmp_path):
    path = logs.write(tmp_path / "p", [user(f"u{i}", "x", ts=f"2026-01-01T0{h}:{m}:00Z") for i, (h, m) in enumerate([(1, "00"), (1, "20"), (3, "00"), (9, "00")])])
    got = run(st.stream_sessions(st.stream_log(spark, path)), tmp_path)
    assert sorted((r.start.hour, r.records) for r in got.collect()) == [(1, 2), (3, 1)]


def test_stream_into_upserts(spark, tmp_path):
    path = logs.write(tmp_path / "p", messages())
    out = str(tmp_path / "out")
    usage = lambda: st.stream_usage(st.stream_log(spark, path))
    st.stream_into(usage(), out, checkpoint=str(tmp_path / "ck")).awaitTermination()
    logs.write(tmp_path / "p", [assistant("z", [text("z")], ts="2025-12-31T00:00:00Z", mid="m-a0", usage=USE)], name="late.jsonl")
    st.stream_into(usage(), out, checkpoint=str(tmp_path / "ck")).awaitTermination()
    rows = spark.read.parquet(out)
    assert rows.count() == 6 and rows.filter("message_id = 'm-a0'").first().uuid == "z"


def test_refresh(spark, tmp_path):
    out = str(tmp_path / "out")
    path = logs.write(tmp_path / "p", sample())
    logs.write(tmp_path / "p", [assistant("x1", [text("x")], session="s2", ts="2026-01-02T00:00:00Z", mid="shared", usage=USE)], name="s2.jsonl")
    assert st.refresh(spark, path, out) and not st.refresh(spark, path, out)
    first = plans.build_meta(spark, out).first().build_id
    # An earlier copy of s2's message appears in a new session, which takes its cost.
    logs.write(tmp_path / "p", [assistant("y1", [text("y")], session="s3", ts="2026-01-01T00:00:00Z", mid="shared", usage=USE)], name="s3.jsonl")
    assert st.refresh(spark, path, out)
    assert plans.build_meta(spark, out).first().build_id != first
    built, lazy = plans.read_build(spark, out), plans.Relations(read_log(spark, path))
    for name in plans.TABLES:
        a, b = getattr(lazy, name), built[name]
        common = [c for c in a.columns if c in b.columns and c not in ("file_path", "message", "tool_use_result")]
        assert sorted(map(str, a.select(common).collect())) == sorted(map(str, b.select(common).collect())), name
    spent = {r.session_id: r.cost_usd for r in session_cost(built["assistant_message_costs"], rates(spark)).collect()}
    assert spent["s3"] == 5.0 and "s2" not in spent


def only(built, name="logical_sessions"):
    return sorted(r.session_id for r in built[name].collect())


def test_refresh_keeps_window_pattern_and_project_map(spark, tmp_path):
    out, folder = str(tmp_path / "out"), tmp_path / "p"
    old = assistant("o1", [text("x")], session="old", ts="2025-11-01T00:00:00Z")
    new = assistant("n1", [text("x")], session="new", ts="2026-01-02T00:00:00Z")
    path = logs.write(folder, [old, new], name="a.ndj")
    logs.write(folder, [new | {"sessionId": "other"}], name="b.jsonl")
    names = spark.createDataFrame([("/tmp/test", "Named")], "cwd string, project_name string")
    built = plans.materialize(spark, path, out, days=10, as_of="2026-01-05 00:00:00", project_map=names, glob="*.ndj")
    assert only(built) == ["new"]
    assert not st.refresh(spark, path, out)
    logs.write(folder, [old | {"sessionId": "older", "uuid": "o2"}, new | {"sessionId": "next", "uuid": "n2"}], name="c.ndj")
    assert st.refresh(spark, path, out)
    built = plans.read_build(spark, out)
    assert only(built) == ["new", "next"] and {r.project for r in built["logical_sessions"].collect()} == {"Named"}
    stamp = plans.build_meta(spark, out).first()
    assert (stamp.days, stamp.as_of, stamp.glob, stamp.has_map) == ("10", "2026-01-05 00:00:00", "*.ndj", True)
    assert st.refresh(spark, path, out, as_of="2026-01-20 00:00:00") and only(plans.read_build(spark, out)) == []
    renamed = spark.createDataFrame([("/tmp/test", "Other")], "cwd string, project_name string")
    assert st.refresh(spark, path, out, as_of="2026-01-05 00:00:00", project_map=renamed)
    assert {r.project for r in plans.read_build(spark, out)["logical_sessions"].collect()} == {"Other"}


def test_refresh_of_grown_and_deleted_files(spark, tmp_path):
    out, folder = str(tmp_path / "out"), tmp_path / "p"
    path = logs.write(folder, [assistant("a", [text("x")], session="s1")], name="s1.jsonl")
    logs.write(folder, [assistant("b", [text("x")], session="s2")], name="s2.jsonl")
    st.refresh(spark, path, out)
    logs.write(folder, [assistant("a", [text("x")], session="s1"), assistant("c", [text("y")], session="s1")], name="s1.jsonl")
    os.utime(folder / "s1.jsonl", (2_000_000_000, 2_000_000_000))
    (folder / "s2.jsonl").unlink()
    changes = changed_files(list_files(spark, path), spark.read.parquet(f"{out}/build={plans.build_meta(spark, out).first().build_id}/manifest"))
    assert sorted((r.file_path.rpartition("/")[2], r.change) for r in changes.collect()) == [("s1.jsonl", "changed"), ("s2.jsonl", "gone")]
    assert st.refresh(spark, path, out)
    assert [(r.session_id, r.assistant_messages) for r in plans.read_build(spark, out)["logical_sessions"].collect()] == [("s1", 2)]
    (folder / "s1.jsonl").unlink()
    with pytest.raises(FileNotFoundError):
        st.refresh(spark, path, out)
    assert only(plans.read_build(spark, out)) == ["s1"]
