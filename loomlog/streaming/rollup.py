"""A session rollup kept by a stream: states of each batch as runs on disk, merged by size and read together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from loomlog.operators.relations import merged_states, session_states, sessions_of_states
from loomlog.sources.logs import raw_messages
from loomlog.sources.scratch import exists, remove_folder, subfolders

#: So many runs of a size become one of the next size.
FAN_IN = 4
Run = tuple[int, int]


def _folder(out: str, run: Run) -> str:
    return f"{out}/run={run[0]}-{run[1]}"


def _complete(spark: SparkSession, out: str) -> list[Run]:
    """(first, last batch) of the runs whose write was committed."""
    runs = [tuple(map(int, name[4:].split("-"))) for name in subfolders(spark, out) if name.startswith("run=")]
    return [r for r in runs if exists(spark, f"{_folder(out, r)}/_SUCCESS")]


def live_runs(runs: list[Run]) -> list[Run]:
    """Those that no other run contains. Runs are nested or apart, so each batch is in one of them."""
    return sorted(r for r in runs if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in runs))


def _states(spark: SparkSession, out: str, runs: list[Run]) -> DataFrame:
    return spark.read.parquet(*[_folder(out, r) for r in runs])


def stream_rollup(stream: DataFrame, out: str, checkpoint: str, fan_in: int = FAN_IN) -> StreamingQuery:
    """Keep the session states of a log stream below out; read_rollup gives the sessions.

    A batch writes the states of its own sessions as a run and reads nothing; every fan_in-th batch
    merges the last runs of a size, every fan_in**2-th those of the next size, so a state is written
    anew as often as the logarithm of the number of batches. A run counts once its write is
    committed and is never changed: a batch that is run again after a failure finds its run
    complete, or overwrites one that no reader has seen. Readers see whole batches only.
    """

    def add(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        there = set(_complete(spark, out))
        if not any(first <= n <= last for first, last in there):
            session_states(raw_messages(batch)).write.mode("overwrite").parquet(_folder(out, (n, n)))
            there.add((n, n))
        size = fan_in
        while (n + 1) % size == 0:
            run = (n + 1 - size, n)
            if run not in there:
                parts = [r for r in live_runs(list(there)) if run[0] <= r[0] and r[1] <= run[1]]
                merged_states(_states(spark, out, parts)).write.mode("overwrite").parquet(_folder(out, run))
                there.add(run)
            size *= fan_in

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_rollup(spark: SparkSession, out: str, project_map: DataFrame | None = None) -> DataFrame:
    """The sessions, as logical_sessions gives them, of all batches whose runs are complete."""
    runs = live_runs(_complete(spark, out))
    if not runs:
        raise FileNotFoundError(f"no complete run below {out}")
    return sessions_of_states(_states(spark, out, runs), project_map)


def vacuum_rollup(spark: SparkSession, out: str) -> int:
    """Delete the runs that a larger one contains, and tell how many; a reader that still uses them must be done."""
    runs = _complete(spark, out)
    gone = set(runs) - set(live_runs(runs))
    for run in gone:
        remove_folder(spark, _folder(out, run))
    return len(gone)
