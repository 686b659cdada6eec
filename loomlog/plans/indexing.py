"""A search index that follows a build."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomlog.operators.segments import Version, current, sync
from loomlog.plans.relations import TOUCHED, build_meta, read_build, read_pointers
from loomlog.sources.scratch import subfolders


def index_build(spark: SparkSession, built: str, out: str) -> Version:
    """Bring the index at `out` up to date with the newest build below `built`.

    Only session buckets that the build does not share with the one indexed before are read and
    compared; if that one was vacuumed, all are.
    """
    meta = build_meta(spark, built)
    if meta is None:
        raise FileNotFoundError(f"{built} has no published build")
    build, v = meta.first()["build_id"], current(spark, out)
    if v.source == build:
        return v

    def folders(name: str) -> set:
        """(bucket, table, folder) of the corpus, and of the sessions that hide rows of it."""
        rows = read_pointers(spark, built, name).filter(F.col("table_name").isin("search_corpus", TOUCHED)).collect()
        return {(r["session_bucket"], r["table_name"], r["written_by"]) for r in rows}

    known = v.source is not None and f"build={v.source}" in subfolders(spark, built)
    parts = sorted({bucket for bucket, _, _ in folders(build) ^ folders(v.source)}) if known else None
    corpus = read_build(spark, built)["search_corpus"].withColumnRenamed("session_bucket", "part")
    return sync(corpus if parts is None else corpus.filter(corpus["part"].isin(parts)), out, parts, build)
