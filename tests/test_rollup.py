import random

import pytest
from pyspark.sql import functions as F

from loomlog.operators.relations import logical_sessions, merged_states, session_states, sessions_of_states
from loomlog.plans.relations import Relations
from loomlog.sources.logs import read_log
from loomlog.streaming import rollup
from loomlog.streaming.stream import stream_log
from tests import logs
from tests.logs import assistant, result, text, user


def records(n=60):
    """Sessions that lie in many files, in no order, with null names, times and values."""
    draw, rows = random.Random(3), []
    for i in range(n):
        ts = draw.choice(["2026-01-01T10:00:00Z", f"2026-01-01T{draw.randrange(24):02d}:00:00Z", f"2026-01-02T00:00:{i:02d}Z", "no time"])
        session, cwd = draw.choice(["s1", "s2", "s3", None]), draw.choice(["/a/x", "/b/y", None])
        if i % 2:
            rows.append(assistant(f"a{i:02d}", [text("x")], ts=ts, session=session, cwd=cwd, model=draw.choice(["m1", "m2", None])))
        else:
            rows.append(user(f"u{i:02d}", draw.choice(["hello", [result("t1")]]), ts=ts, session=session, cwd=cwd))
    return rows


def rows(df):
    return sorted(map(str, df.collect()))


def files(folder, recs, n):
    for i in range(n):
        logs.write(folder, recs[i::n], name=f"f{i:02d}.jsonl")
    return str(folder)


def test_states_of_parts_add_up_in_any_order_and_nesting(spark, tmp_path):
    msgs = Relations(read_log(spark, files(tmp_path / "p", records(), 1))).raw_messages
    part = [session_states(msgs.filter(F.crc32("uuid") % 3 == i)) for i in range(3)]
    want = rows(logical_sessions(msgs))
    assert len(want) == 4 and rows(sessions_of_states(part[0].union(part[1]).union(part[2]))) == want
    assert rows(sessions_of_states(part[2].union(merged_states(part[1].union(part[0]))))) == want
    assert rows(sessions_of_states(session_states(msgs.limit(0)))) == []


def test_stream_rollup_equals_a_batch(spark, tmp_path):
    out, folder, marks = str(tmp_path / "out"), tmp_path / "p", str(tmp_path / "ck")
    path = files(folder, records(), 6)
    go = lambda: rollup.stream_rollup(stream_log(spark, path, max_files=1), out, marks, fan_in=2).awaitTermination()
    with pytest.raises(FileNotFoundError):
        rollup.read_rollup(spark, out)
    go()
    whole = lambda: rows(Relations(read_log(spark, path)).logical_sessions)
    assert rows(rollup.read_rollup(spark, out)) == whole()
    assert rollup.live_runs(rollup._complete(spark, out)) == [(0, 3), (4, 5)]
    assert rollup.vacuum_rollup(spark, out) == 8 and rows(rollup.read_rollup(spark, out)) == whole()
    logs.write(folder, records(70)[60:], name="late.jsonl")
    go()
    assert rollup.live_runs(rollup._complete(spark, out)) == [(0, 3), (4, 5), (6, 6)] and rows(rollup.read_rollup(spark, out)) == whole()


def test_a_batch_killed_anywhere_is_neither_lost_nor_doubled(spark, tmp_path, monkeypatch):
    """Writes fail one after the other: each start of the stream gets one write further."""
    path, out, marks = files(tmp_path / "p", records(), 4), str(tmp_path / "out"), str(tmp_path / "ck")
    real, write, failed, seen = rollup._complete, rollup.merged_states, set(), 0

    def once(name):
        if name not in failed:
            failed.add(name)
            raise OSError("lost")

    def complete(spark_, out_):
        runs = real(spark_, out_)
        once(f"before {sorted(runs)}")
        return runs

    def merged(states):
        once(f"merge {sorted(real(spark, out))}")
        return write(states)

    monkeypatch.setattr(rollup, "_complete", complete)
    monkeypatch.setattr(rollup, "merged_states", merged)
    for _ in range(20):
        try:
            rollup.stream_rollup(stream_log(spark, path, max_files=1), out, marks, fan_in=2).awaitTermination()
            break
        except Exception:
            seen += 1
            (tmp_path / "out" / "run=9-9").mkdir(parents=True, exist_ok=True)  # begun, never committed
    monkeypatch.undo()
    want = rows(Relations(read_log(spark, path)).logical_sessions)
    assert seen >= 5 and rows(rollup.read_rollup(spark, out)) == want


def test_runs_that_cross_are_read_once():
    assert rollup.live_runs([(0, 0), (0, 3), (2, 2), (3, 5), (4, 4), (6, 6)]) == [(0, 3), (3, 5), (6, 6)]
