"""Builds as manifests: deltas read and written, folders kept and cleared, files that cannot be read."""

import gzip
import os

import pytest

from loomlog.plans import relations as plans
from loomlog.sources.logs import file_census, read_log
from loomlog.sources.scratch import subfolders
from loomlog.streaming import stream as st
from tests import logs
from tests.logs import assistant, result, text, tool, user

USE = {"input_tokens": 10**6}


def session(i, n=4):
    s = f"s{i}"
    rows = [user(f"{s}-u", f"Prompt {i}", session=s)]
    for k in range(n):
        rows.append(assistant(f"{s}-a{k}", [text("x" * 400), tool(f"{s}-t{k}", "Read", file_path=f"/tmp/test/{k}")], session=s, ts=f"2026-01-02T00:00:{k:02d}Z", usage=USE))
        rows.append(user(f"{s}-r{k}", [result(f"{s}-t{k}")], session=s, ts=f"2026-01-02T00:01:{k:02d}Z"))
    return rows


def later(folder, name, rows):
    logs.write(folder, rows, name=name)
    os.utime(folder / name, (2_000_000_000, 2_000_000_000))


def content(tables, names=plans.TABLES + plans.MAPS):
    out = {}
    for name in names:
        rows = tables[name]
        cols = sorted(c for c in rows.columns if c not in ("session_bucket", "message", "tool_use_result", "duration", "execution_time"))
        out[name] = sorted(map(str, rows.select(cols).collect()))
    return out


def same_as_new(spark, path, out, names=plans.TABLES + plans.MAPS):
    lazy = plans.Relations(read_log(spark, path)).prepared()
    got, want = content(plans.read_build(spark, out, maps=True), names), content({n: getattr(lazy, n) for n in names}, names)
    for name in names:
        assert got[name] == want[name], name


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    """A build of 60 session files of which one has grown, refreshed."""
    folder, out = tmp_path_factory.mktemp("log"), str(tmp_path_factory.mktemp("build") / "out")
    for i in range(60):
        logs.write(folder, session(i), name=f"s{i}.jsonl")
    plans.materialize(spark, str(folder), out)
    later(folder, "s7.jsonl", session(7, 6))
    assert st.refresh(spark, str(folder), out)
    return folder, out


def test_refresh_reads_and_writes_deltas_only(spark, grown):
    folder, out = grown
    stamp = plans.build_meta(spark, out).first()
    total = sum(f.stat().st_size for f in folder.iterdir())
    assert stamp.files_read == 1 and stamp.bytes_read < 0.05 * total
    pointers = spark.read.parquet(f"{out}/build={stamp.build_id}/pointers")
    assert pointers.filter(pointers.written_by == stamp.build_id).select("session_bucket").distinct().count() == 1
    for name in plans.TABLES:
        written = subfolders(spark, f"{out}/data/{name}/written_by={stamp.build_id}")
        assert len(written) <= 1, name
    same_as_new(spark, str(folder), out, ["session_stats", "tool_calls"])


def test_links_between_sessions_and_files_that_go(spark, grown):
    folder, out = grown
    # A result in another session's file, an earlier copy of a message, a file that goes and one that comes.
    later(folder, "s3.jsonl", [*session(3), user("far", [result("s9-t0", error=True)], session="s3", ts="2026-01-03T00:00:00Z")])
    later(folder, "s4.jsonl", [*session(4), assistant("early", [text("x")], session="s4", ts="2025-12-01T00:00:00Z", mid="m-s11-a0", usage=USE)])
    (folder / "s5.jsonl").unlink()
    later(folder, "new.jsonl", [assistant("n", [text("x")], session=None), *session(200)])
    assert st.refresh(spark, str(folder), out)
    assert plans.build_meta(spark, out).first().files_read == 5
    same_as_new(spark, str(folder), out)
    # What was linked is linked no more.
    later(folder, "s3.jsonl", session(3))
    os.utime(folder / "s3.jsonl", (2_000_000_100, 2_000_000_100))
    assert st.refresh(spark, str(folder), out)
    same_as_new(spark, str(folder), out, ["raw_messages", "tool_calls", "session_stats", "session_links"])


def test_vacuum_keeps_what_live_builds_name(spark, grown):
    folder, out = grown
    names = ["raw_messages", "session_stats", "file_sessions"]
    before = content(plans.read_build(spark, out, maps=True), names)
    assert plans.vacuum(spark, out, keep=1) > 0
    assert plans.vacuum(spark, out, keep=1) == 0
    assert content(plans.read_build(spark, out, maps=True), names) == before
    assert len([x for x in subfolders(spark, out) if x.startswith("build=")]) == 1


def test_build_parses_the_log_once(spark, grown, tmp_path, monkeypatch):
    folder, _ = grown
    seen = []
    real = plans.write_table
    monkeypatch.setattr(plans, "write_table", lambda df, name, *a: (seen.append((name, df._jdf.queryExecution().optimizedPlan().toString().count("] json"))), real(df, name, *a))[1])
    plans.materialize(spark, str(folder), str(tmp_path / "out"))
    assert [name for name, n in seen if n] == ["raw_messages"]


def test_census_names_files_that_cannot_be_read(spark, tmp_path):
    folder = tmp_path / "p"
    logs.write(folder, session(1), name="good.jsonl")
    logs.write(folder, session(2), name="bad.jsonl", extra=["{broken", "not json"])
    whole = gzip.compress((folder / "good.jsonl").read_bytes() * 50)
    (folder / "whole.jsonl.gz").write_bytes(whole)
    (folder / "twice.jsonl.gz").write_bytes(whole + whole)
    (folder / "cut.jsonl.gz").write_bytes(whole[: len(whole) // 2])
    (folder / "noise.jsonl.gz").write_bytes(b"no gzip at all")
    rows = {r.file_path.rpartition("/")[2]: r for r in file_census(spark, str(folder), "*.jsonl*").collect()}
    assert {k: r.status for k, r in rows.items() if r.status != "read"} == {"bad.jsonl": "bad lines", "cut.jsonl.gz": rows["cut.jsonl.gz"].status, "noise.jsonl.gz": "unreadable"}
    assert rows["cut.jsonl.gz"].status in ("cut", "unreadable")
    assert (rows["good.jsonl"].lines, rows["bad.jsonl"].lines, rows["bad.jsonl"].bad_lines, rows["twice.jsonl.gz"].lines) == (9, 11, 2, 900)


def test_census_opens_no_plain_file_whole(spark, tmp_path):
    """A file larger than Spark may load into one cell; gzip files are found by names with marks of a pattern too."""
    folder = tmp_path / "logs"
    logs.write(folder, [user(f"u{i}", "hello") for i in range(50)])
    (folder / "s[2].jsonl.gz").write_bytes(gzip.compress(b'{"a": 1}\n')[:-4])
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        rows = {r.file_path.rpartition("/")[2].partition(".")[2]: (r.lines, r.status) for r in file_census(spark, str(folder), "*.jsonl*").collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert rows["jsonl"] == (50, "read") and rows["jsonl.gz"][1] in ("cut", "unreadable")


def test_refresh_writes_touched_sessions_alone(spark, tmp_path, monkeypatch):
    """Sessions that share a bucket with a touched one are not written again; linked sessions elsewhere still count."""
    folder, out = tmp_path / "log", str(tmp_path / "out")
    buckets = {r.session_id: r.b for r in spark.range(500).selectExpr("concat('s', id) as session_id").withColumn("b", plans.session_bucket()).collect()}
    near = [int(s[1:]) for s, b in buckets.items() if b == buckets["s2"]][:4]
    assert len({buckets[s] for s in ("s0", "s1", "s2")}) == 3
    for i in {0, 1, *near}:
        logs.write(folder, session(i, 1), name=f"s{i}.jsonl")
    # s0 has the earlier copy of a message of s1, and s2 the result of a call of s1: s0 is only company when s2 changes.
    logs.write(folder, [*session(0, 1), assistant("early", [text("x")], session="s0", ts="2025-12-01T00:00:00Z", mid="m-s1-a0", usage=USE)], name="s0.jsonl")
    far = user("far", [result("s1-t0", error=True)], session="s2", ts="2026-01-03T00:00:00Z")
    later(folder, "s2.jsonl", [*session(2, 1), far])
    plans.materialize(spark, str(folder), out)
    names = ["raw_messages", "session_stats", "tool_calls", "logical_sessions", "search_corpus", "session_links"]
    for n, most, written in ((2, 4, {"s1", "s2"}), (3, 2, {"s1", *(f"s{i}" for i in near)})):
        monkeypatch.setattr(st, "MAX_FOLDERS", most)
        logs.write(folder, [*session(2, n), far], name="s2.jsonl")
        os.utime(folder / "s2.jsonl", (2_000_000_000 + n, 2_000_000_000 + n))
        assert st.refresh(spark, str(folder), out)
        build = plans.build_meta(spark, out).first().build_id
        assert {r.session_id for r in spark.read.parquet(f"{out}/data/raw_messages/written_by={build}").collect()} == written
        same_as_new(spark, str(folder), out, names)
