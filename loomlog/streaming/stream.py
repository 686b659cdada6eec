"""Logs as streams, and incremental refresh of written relations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomlog.functions.pricing import rates as default_rates
from loomlog.functions.pricing import cost_expr, with_rates
from loomlog.operators.relations import session_key, session_links
from loomlog.plans.relations import BUCKETS, MAX_FOLDERS, Relations, build_meta, materialize, publish, read_build, read_pointers, session_bucket, windowed, write_tables, write_touched
from loomlog.sources.logs import GLOB, changed_files, listing, raw_messages, read_log
from loomlog.sources.schemas import READ_SCHEMA
from loomlog.sources.scratch import remove_folder, stored


def stream_log(spark: SparkSession, path: str, schema: str = READ_SCHEMA, max_files: int = 1000, glob: str = GLOB) -> DataFrame:
    """New log files as a stream. A file that grows after it was seen is not read again: use refresh for those."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("columnNameOfCorruptRecord", "_corrupt").option("maxFilesPerTrigger", max_files).json(path)


def stream_usage(stream: DataFrame) -> DataFrame:
    """Token usage of assistant records, with an event time."""
    tokens = lambda p: F.coalesce(F.col(f"message.usage.{p}"), F.lit(0).cast("long"))
    rows = stream.filter((F.col("type") == "assistant") & F.col("message.id").isNotNull())
    return rows.select(
        F.col("sessionId").alias("session_id"), "uuid", F.col("timestamp").try_cast("timestamp").alias("timestamp"), F.col("isSidechain").alias("is_sidechain"), F.col("message.model").alias("model"), F.col("message.id").alias("message_id"),
        tokens("input_tokens").alias("input_tokens"), tokens("output_tokens").alias("output_tokens"), tokens("cache_read_input_tokens").alias("cache_read_tokens"), tokens("cache_creation_input_tokens").alias("cache_creation_tokens"),
        tokens("cache_creation.ephemeral_5m_input_tokens").alias("cache_creation_5m"), tokens("cache_creation.ephemeral_1h_input_tokens").alias("cache_creation_1h"),
    )


def stream_costs(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Usage without repeated message ids: the copy that arrives first counts, copies later than the delay count again."""
    return stream_usage(stream).withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["message_id"])


def stream_cost_windows(usage: DataFrame, size: str = "1 hour", rate_table: DataFrame | None = None, delay: str | None = "10 minutes") -> DataFrame:
    """Cost by tumbling window and model, of a stream or a batch. delay sets a watermark unless the stream has one (None)."""
    rows = usage.withWatermark("timestamp", delay) if delay else usage
    cost = with_rates(rows, rate_table if rate_table is not None else default_rates(usage.sparkSession)).withColumn("cost_usd", cost_expr())
    windowed = cost.groupBy(F.window("timestamp", size).alias("w"), "model").agg(F.count("*").alias("messages"), F.sum("cost_usd").alias("cost_usd"))
    return windowed.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "model", "messages", "cost_usd")


def stream_sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """(session_id, start, end, records): stretches of a session's activity without a gap."""
    rows = stream.select(F.col("sessionId").alias("session_id"), F.col("timestamp").try_cast("timestamp").alias("timestamp"))
    grouped = rows.withWatermark("timestamp", delay).groupBy("session_id", F.session_window("timestamp", gap).alias("w")).agg(F.count("*").alias("records"))
    return grouped.select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "records")


def stream_into(stream: DataFrame, out: str, key: str = "message_id", order: str = "timestamp", checkpoint: str | None = None) -> StreamingQuery:
    """Upsert a stream into Parquet by key, the row of least order staying, null order last; only touched key buckets are rewritten.

    A batch that is run again writes the same rows.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("key_bucket", F.pmod(F.hash(key), F.lit(BUCKETS)))
        touched = [r[0] for r in new.select("key_bucket").distinct().collect()]
        if not touched:
            return
        try:
            old = spark.read.parquet(out).filter(F.col("key_bucket").isin(touched)).select(*new.columns)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            old = new.limit(0)
        rest = [c for c in new.columns if c not in (key, "key_bucket")]
        merged = old.unionByName(new).groupBy(key, "key_bucket").agg(F.min_by(F.struct(*rest), F.struct(F.col(order).isNull().alias("last"), order, *[c for c in rest if c == "uuid"])).alias("r")).select(key, "r.*", "key_bucket").select(*new.columns)
        staged = f"{out}.staged/{batch_id}-{uuid.uuid4().hex}"  # a table that is read cannot be overwritten in the same job
        merged.write.parquet(staged)
        spark.read.parquet(staged).repartition("key_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key_bucket").parquet(out)
        remove_folder(spark, staged)

    writer = stream.writeStream.foreachBatch(upsert).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def _window(stamp) -> int | str:
    """The retention window that a build was made with."""
    return int(stamp["days"]) if stamp["days"].lstrip("-").isdigit() else stamp["days"]


def refresh(spark: SparkSession, path: str, out: str, project_map: DataFrame | None = None, as_of: str | None = None) -> bool:
    """Bring the relations below out up to date with the logs below path; False if there was nothing to do.

    Only changed files, and the files of sessions that share a message or tool id with them, are
    read: the build's maps of files and ids to sessions tell which. Such sessions alone are written
    anew, beside the folders of the old build, in which their names hide their rows; only a bucket
    that has come to many folders is written as a whole. The new build is published as a whole by
    its stamp, which keeps the number and bytes of the files read. The build's own file pattern, retention window and project map hold
    on; a later as_of of a build with a window, or another project map, touches any session: then
    all is built anew. If the pattern matches no file any more though the build had some,
    FileNotFoundError is raised and the old build stays.
    """
    meta = build_meta(spark, out)
    if meta is None:
        materialize(spark, path, out, as_of=as_of, project_map=project_map)
        return True
    stamp = meta.first()
    days, glob, held = _window(stamp), stamp["glob"], f"{out}/build={stamp['build_id']}"
    files, manifest = stored(listing(spark, path, glob)), spark.read.parquet(f"{held}/manifest")
    if files.isEmpty() and not manifest.isEmpty():
        raise FileNotFoundError(f"no file below {path} matches {glob}; the build stays as it is")
    known_map = spark.read.parquet(f"{held}/project_map") if stamp["has_map"] else None
    new_map = project_map is not None and (known_map is None or _differ(project_map.select("cwd", "project_name"), known_map))
    if new_map or days != 0 and as_of is not None and as_of != stamp["as_of"]:
        materialize(spark, path, out, days, as_of or stamp["as_of"], project_map if new_map else known_map, reuse=False, glob=glob)
        return True
    changes = stored(changed_files(files, manifest))
    if changes.isEmpty():
        return False
    old = read_build(spark, out, maps=True)

    def parsed(names: DataFrame) -> tuple[DataFrame, int, int]:
        """Messages of the named files that are there, with the number of those and their bytes."""
        # One path for each file that is read, as a scan's own listing holds on the driver anyway.
        found = files.join(names, "file_path", "left_semi").select("path", "size").collect()
        log = read_log(spark, [r["path"] for r in found], glob=glob) if found else read_log(spark, path, glob=glob).limit(0)
        return raw_messages(windowed(log, days, stamp["as_of"])), len(found), sum(r["size"] for r in found)

    own = lambda df: df.withColumn("_session", session_key())
    news, n_changed, changed_bytes = parsed(changes.filter("change <> 'gone'").select("file_path"))
    news = stored(news)
    links = stored(session_links(news).unionByName(old["session_links"].select("kind", "id", "session_id")))

    def linked(sessions: DataFrame) -> DataFrame:
        """The sessions, and those that share an id with one of them."""
        ids = own(links).join(sessions, "_session", "left_semi").select("kind", "id").distinct()
        return stored(own(links.join(ids, ["kind", "id"], "left_semi")).select("_session").union(sessions).distinct())

    # Sessions of changed files, before and after; those whose rows may change with them; those that their rows depend on.
    before = old["file_sessions"].join(changes, "file_path", "left_semi").select("session_id")
    touched = linked(stored(own(before.union(news.select("session_id"))).select("_session").distinct()))
    around = linked(touched)
    rest = own(old["file_sessions"]).join(around, "_session", "left_semi").select("file_path").distinct().join(changes, "file_path", "left_anti")
    others, n_rest, rest_bytes = parsed(rest)
    context = stored(own(news.unionByName(others)).join(around, "_session", "left_semi").drop("_session"))
    touched = stored(touched.select("_session", F.expr("nullif(_session, '\0')").alias("session_id")).withColumn("session_bucket", session_bucket()).select("_session", "session_bucket"))
    buckets = {r[0] for r in touched.select("session_bucket").distinct().collect()}  # at most BUCKETS numbers
    # Touched sessions are written beside the folders of their bucket, whose rows of them are gone then. A bucket of many
    # folders, or one that would lose half of its sessions, is written as a whole.
    pointers = read_pointers(spark, out, stamp["build_id"])
    held_by = pointers.groupBy("session_bucket").agg(F.count_distinct("written_by").alias("n"), F.max("seq").alias("seq")).collect()
    known = own(old["logical_sessions"]).join(touched.select("_session", F.lit(1).alias("_t")), "_session", "left").groupBy("session_bucket").agg((2 * F.count("_t") > F.count("*")).alias("most")).filter("most").collect()
    whole = sorted(buckets & ({r["session_bucket"] for r in held_by if r["n"] >= MAX_FOLDERS} | {r["session_bucket"] for r in known}))
    seq = max((r["seq"] for r in held_by), default=0) + 1

    # What depends on other sessions is computed in their company; the remaining tables follow from these.
    fresh, given = Relations(context, known_map), {}
    fresh.__dict__["raw_messages"] = context
    for name in ("raw_messages", "assistant_message_costs", "tool_calls"):
        rows = own(getattr(fresh, name)).join(touched, "_session", "left_semi").drop("_session")
        if whole:
            stays = own(old[name].filter(F.col("session_bucket").isin(whole))).join(touched, "_session", "left_anti").drop("_session", "session_bucket")
            rows = stays.unionByName(rows.select(*stays.columns))
        given[name] = rows
    build = uuid.uuid4().hex
    schemas = write_tables(Relations(context, known_map), out, build, given)
    beside = touched.filter(~F.col("session_bucket").isin(whole))
    if len(whole) < len(buckets):
        write_touched(beside, seq, out, build)
    kept = pointers.filter(~F.col("session_bucket").isin(whole))
    publish(spark, out, build, files, {"source": path, "schemas": schemas, "days": str(days), "as_of": stamp["as_of"], "glob": glob, "files_read": n_changed + n_rest, "bytes_read": changed_bytes + rest_bytes}, kept, known_map, seq)
    return True


def _differ(a: DataFrame, b: DataFrame) -> bool:
    return not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty())

