"""All relations of one log, as plans, as views, or as written tables with a build stamp."""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from loomlog.functions.pricing import rates
from loomlog.operators import cost, relations, search
from loomlog.sources.logs import GLOB, listing, raw_messages, read_log, within_days
from loomlog.sources.scratch import remove_folder, stored, subfolders

BUCKETS = 64


class Relations:
    """Lazy relations over a log; each is a DataFrame built once from those it needs."""

    def __init__(self, log: DataFrame, project_map: DataFrame | None = None, rate_table: DataFrame | None = None):
        self.log, self.project_map = log, project_map
        self.rates = rate_table if rate_table is not None else rates(log.sparkSession)

    def prepared(self) -> Relations:
        """The same relations over messages that are parsed once and written to the shared folder.

        For questions that read the messages several times; a build derives from its written messages in the same way.
        """
        out = Relations(self.log, self.project_map, self.rates)
        out.__dict__["raw_messages"] = stored(self.raw_messages)
        return out

    @functools.cached_property
    def raw_messages(self) -> DataFrame:
        return raw_messages(self.log)

    @functools.cached_property
    def logical_sessions(self) -> DataFrame:
        return relations.logical_sessions(self.raw_messages, self.project_map)

    @functools.cached_property
    def assistant_message_costs(self) -> DataFrame:
        return relations.message_costs(self.raw_messages)

    @functools.cached_property
    def tool_calls(self) -> DataFrame:
        return relations.tool_calls(self.raw_messages)

    @functools.cached_property
    def message_blocks(self) -> DataFrame:
        return relations.message_blocks(self.raw_messages)

    @functools.cached_property
    def conversation_turns(self) -> DataFrame:
        return relations.conversation_turns(self.raw_messages)

    @functools.cached_property
    def session_titles(self) -> DataFrame:
        return relations.session_titles(self.raw_messages)

    @functools.cached_property
    def message_commands(self) -> DataFrame:
        return relations.message_commands(self.raw_messages)

    @functools.cached_property
    def file_reads(self) -> DataFrame:
        return relations.file_reads(self.tool_calls)

    @functools.cached_property
    def file_writes(self) -> DataFrame:
        return relations.file_writes(self.tool_calls)

    @functools.cached_property
    def session_stats(self) -> DataFrame:
        return relations.session_stats(self.raw_messages, self.rates, self.project_map)

    @functools.cached_property
    def file_sessions(self) -> DataFrame:
        return relations.file_sessions(self.raw_messages)

    @functools.cached_property
    def session_links(self) -> DataFrame:
        return relations.session_links(self.raw_messages)

    @functools.cached_property
    def search_corpus(self) -> DataFrame:
        return search.search_corpus(self.raw_messages)

    @functools.cached_property
    def cost_attribution(self) -> DataFrame:
        return cost.cost_attribution(self.assistant_message_costs, self.raw_messages, self.tool_calls)


TABLES = ["raw_messages", "logical_sessions", "assistant_message_costs", "tool_calls", "message_blocks", "conversation_turns", "session_titles", "message_commands", "file_reads", "file_writes", "session_stats", "search_corpus"]
#: Written beside the tables of a build, for its refresh.
MAPS = ["file_sessions", "session_links"]
#: The sessions that a refresh wrote anew: their rows in folders with a lower number are gone.
TOUCHED = "touched_sessions"
#: With so many folders, a bucket that is touched again is written as a whole.
MAX_FOLDERS = 4
_ORDER = {"raw_messages": "timestamp", "assistant_message_costs": "timestamp", "tool_calls": "called_at", "message_blocks": "timestamp", "conversation_turns": "timestamp"}


#: Rows and characters of a cell that an ad-hoc query shows.
MAX_ROWS, MAX_CELL = 500, 200


def register_views(spark: SparkSession, log: DataFrame, project_map: DataFrame | None = None, prefix: str = "") -> Relations:
    """The relations as temporary views, for ad-hoc SQL."""
    rel = Relations(log, project_map)
    for name in TABLES:
        getattr(rel, name).createOrReplaceTempView(prefix + name)
    return rel


def ad_hoc(spark: SparkSession, sql: str, limit: int = MAX_ROWS, max_chars: int = MAX_CELL) -> DataFrame:
    """Result of a query over the views: at most 500 rows, strings longer than max_chars cut there with "…".

    The text stands as a subquery, so that whatever is no query (a command, an insert, several
    statements) is an error of the parser before anything runs.
    """
    rows = spark.sql(f"SELECT * FROM (\n{sql.strip().rstrip(';')}\n)")
    text = [f.dataType == StringType() for f in rows.schema]
    names = [f"_c{i}" for i in range(len(text))]  # names may repeat
    cut = lambda c: F.when(F.length(c) > max_chars, F.concat(F.substring(c, 1, max_chars), F.lit("…"))).otherwise(F.col(c))
    return rows.toDF(*names).limit(max(1, min(limit, MAX_ROWS))).select(*[cut(n) if t else F.col(n) for n, t in zip(names, text)]).toDF(*rows.columns)


def session_bucket(buckets: int = BUCKETS):
    return F.pmod(F.hash("session_id"), F.lit(buckets))


# A build is a manifest: for each table and session bucket the folders that hold its rows, which may be those of
# earlier builds. A folder's number (seq) is that of the refresh that wrote it; rows of sessions that a later folder
# of touched sessions names are gone. Below `out`:
#   data/<table>/written_by=<build>/session_bucket=<n>   rows, never changed once written
#   data/touched_sessions/written_by=<build>/...           the sessions that a refresh wrote anew
#   build=<build>/pointers, manifest, project_map          what the build consists of and was made from
#   build_meta                                            one row for each build, written last: readers see whole builds only


def _folder(out: str, name: str) -> str:
    return f"{out}/data/{name}"


def _shaped(df: DataFrame, name: str, buckets: int = BUCKETS) -> DataFrame:
    """A relation as it is stored: with its bucket, without intervals, which Parquet doesn't hold."""
    gone = {"logical_sessions": "duration", "session_stats": "duration", "tool_calls": "execution_time"}
    return df.withColumn("session_bucket", session_bucket(buckets)).drop(gone.get(name, ""))


def write_table(df: DataFrame, name: str, out: str, build: str) -> DataFrame:
    """Write a stored relation's rows for a build; they are read back without the bucket."""
    sort = [c for c in ("session_bucket", _ORDER.get(name)) if c]
    path = f"{_folder(out, name)}/written_by={build}"
    # Rebalancing splits the bucket of a giant session over several tasks and files.
    df.hint("rebalance", "session_bucket").sortWithinPartitions(*sort).write.partitionBy("session_bucket").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).drop("session_bucket")


def write_tables(rel: Relations, out: str, build: str, given: dict[str, DataFrame] | None = None) -> str:
    """Write all relations and maps for a build, each derived from those written before it, so that the log is parsed once.

    given: rows to write as they are instead of the relation of that name. Returns the schemas as JSON.
    """
    rel, schemas, given = Relations(rel.log, rel.project_map, rel.rates), {}, given or {}
    # What session_stats says of calls, files and costs stands in other tables, and what logical_sessions says in session_stats.
    first = ["raw_messages", "assistant_message_costs", "tool_calls", "session_stats"]
    for name in first + [n for n in TABLES + MAPS if n not in first]:
        if name in given:
            rows = given[name]
        elif name == "session_stats":
            rows = relations.session_stats_of(rel.raw_messages, rel.tool_calls, rel.assistant_message_costs, rel.rates, rel.project_map)
        elif name == "logical_sessions":
            rows = rel.session_stats.select(*[c for c in relations.SESSION if c in rel.session_stats.columns])
        else:
            rows = getattr(rel, name)
        rows = _shaped(rows, name)
        schemas[name] = json.loads(rows.schema.json())
        rel.__dict__[name] = write_table(rows, name, out, build)
    return json.dumps(schemas)


def build_meta(spark: SparkSession, out: str) -> DataFrame | None:
    """The newest published build of a folder, None if there is none."""
    try:
        return spark.read.parquet(f"{out}/build_meta").orderBy(F.col("built_at").desc(), "build_id").limit(1)
    except Exception as error:  # no build yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


class Build(Mapping):
    """The tables of one build by name; a table's folders are listed when it is first asked for."""

    def __init__(self, spark: SparkSession, out: str, names: list[str], schemas: dict, pointers: list):
        self.spark, self.out, self.names, self.schemas, self.pointers, self.read = spark, out, names, schemas, pointers, {}
        gone = [p for p in pointers if p["table_name"] == TOUCHED]
        self.hidden = _touched(spark, out, gone) if gone else None
        self.last: dict[int, int] = {}
        for p in gone:
            self.last[p["session_bucket"]] = max(p["seq"], self.last.get(p["session_bucket"], 0))

    def __iter__(self):
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(name)
        if name not in self.read:
            self.read[name] = self._table(name, StructType.fromJson(self.schemas[name]))
        return self.read[name]

    def _table(self, name: str, schema: StructType) -> DataFrame:
        own = [p for p in self.pointers if p["table_name"] == name]
        cut = [p for p in own if p["seq"] < self.last.get(p["session_bucket"], 0)]
        whole = _folders(self.spark, self.out, name, schema, [p for p in own if p not in cut])
        if not cut:
            return whole
        seqs = F.create_map(*[F.lit(x) for pair in sorted({(p["written_by"], p["seq"]) for p in cut}) for x in pair])
        older = _folders(self.spark, self.out, name, schema, cut, keep=True).withColumns({"_seq": seqs[F.col("written_by")], "_session": relations.session_key()})
        older = older.join(self.hidden, (F.col("_session") == F.col("_touched")) & (F.col("_seq") < F.col("_before")), "left_anti")
        return whole.unionByName(older.select(*schema.names))


def read_build(spark: SparkSession, out: str, maps: bool = False) -> Build:
    """The tables of the newest build (maps: those of its refresh too), from the folders that its pointers name."""
    meta = build_meta(spark, out)
    if meta is None:
        raise FileNotFoundError(f"{out} has no published build")
    stamp = meta.first()
    # At most MAX_FOLDERS rows for each table and bucket.
    pointers = read_pointers(spark, out, stamp["build_id"]).collect()
    return Build(spark, out, TABLES + (MAPS if maps else []), json.loads(stamp["schemas"]), pointers)


def _folders(spark: SparkSession, out: str, name: str, schema: StructType, pointers: list, keep: bool = False) -> DataFrame:
    """Rows of a table in the folders of some pointers; keep: with written_by."""
    if not pointers:
        return spark.createDataFrame([], schema)
    paths = [f"{_folder(out, name)}/written_by={p['written_by']}/session_bucket={p['session_bucket']}" for p in pointers]
    rows = spark.read.schema(StructType([*schema.fields]).add("written_by", "string")).option("basePath", _folder(out, name)).parquet(*paths)
    return rows if keep else rows.drop("written_by")


def _touched(spark: SparkSession, out: str, pointers: list) -> DataFrame:
    """(_touched, _before): a session and the number below which its rows are gone."""
    rows = _folders(spark, out, TOUCHED, StructType.fromDDL("_session string, seq long, session_bucket int"), pointers)
    return rows.groupBy(F.col("_session").alias("_touched")).agg(F.max("seq").alias("_before"))


def write_touched(sessions: DataFrame, seq: int, out: str, build: str) -> None:
    """(_session, session_bucket) of the sessions that a refresh wrote anew beside older folders."""
    sessions.select("_session", F.lit(seq).cast("long").alias("seq"), "session_bucket").repartition("session_bucket").write.partitionBy("session_bucket").parquet(f"{_folder(out, TOUCHED)}/written_by={build}")


def read_pointers(spark: SparkSession, out: str, build: str) -> DataFrame:
    """(table_name, session_bucket, written_by, seq) of a build."""
    rows = spark.read.schema("table_name string, session_bucket int, written_by string, seq long").parquet(f"{out}/build={build}/pointers")
    return rows.fillna(0, ["seq"])


def _pointers(spark: SparkSession, out: str, build: str, seq: int) -> DataFrame:
    """Pointers to what a build wrote itself: the folders below its own, at most one for each table and bucket."""
    own = [(name, int(x.rpartition("=")[2]), build, seq) for name in TABLES + MAPS + [TOUCHED] for x in subfolders(spark, f"{_folder(out, name)}/written_by={build}") if x.startswith("session_bucket=")]
    return spark.createDataFrame(own, "table_name string, session_bucket int, written_by string, seq long")


STAMP = "build_id string, source string, schemas string, days string, as_of string, glob string, has_map boolean, files_read long, bytes_read long"


def publish(spark: SparkSession, out: str, build: str, files: DataFrame, stamp: dict, kept: DataFrame | None = None, project_map: DataFrame | None = None, seq: int = 0) -> None:
    """The manifest of files, the project map and the pointers, `kept` ones to earlier builds, then the stamp."""
    files.select("file_path", "modified", "size").write.parquet(f"{out}/build={build}/manifest")
    if project_map is not None:
        project_map.select("cwd", "project_name").write.parquet(f"{out}/build={build}/project_map")
    pointers = _pointers(spark, out, build, seq)
    (pointers if kept is None else pointers.unionByName(kept)).coalesce(1).write.parquet(f"{out}/build={build}/pointers")
    row = stamp | {"build_id": build, "has_map": project_map is not None}
    names = [f.split()[0] for f in STAMP.split(", ")]
    spark.createDataFrame([tuple(row[n] for n in names)], STAMP).withColumn("built_at", F.current_timestamp()).write.mode("append").parquet(f"{out}/build_meta")


def vacuum(spark: SparkSession, out: str, keep: int = 2) -> int:
    """Delete what none of the `keep` newest builds names; returns the number of folders deleted.

    A reader of an older build loses its files, so keep as many builds as readers may hold.
    """
    builds = [r["build_id"] for r in spark.read.parquet(f"{out}/build_meta").orderBy(F.col("built_at").desc(), "build_id").select("build_id").limit(keep).collect()]
    named = [p for b in builds for p in read_pointers(spark, out, b).collect()]
    live = {f"{p['table_name']}/written_by={p['written_by']}/session_bucket={p['session_bucket']}" for p in named}
    whole = {x.rpartition("/")[0] for x in live}
    gone = [f"{out}/{x}" for x in subfolders(spark, out) if x.startswith("build=") and x[6:] not in builds]
    for name in subfolders(spark, f"{out}/data"):
        for build in subfolders(spark, f"{out}/data/{name}"):
            if f"{name}/{build}" not in whole:
                gone.append(f"{out}/data/{name}/{build}")
            else:
                gone += [f"{out}/data/{name}/{build}/{b}" for b in subfolders(spark, f"{out}/data/{name}/{build}") if f"{name}/{build}/{b}" not in live]
    for path in gone:
        remove_folder(spark, path)
    return len(gone)


def windowed(log: DataFrame, days: int | str, as_of: str | None) -> DataFrame:
    """Records within a retention window."""
    if days == 0:
        return log
    return within_days(log.withColumn("_ts", F.col("timestamp").try_cast("timestamp")), days, as_of, "_ts").drop("_ts")


def materialize(spark: SparkSession, path: str, out: str, days: int | str = 0, as_of: str | None = None, project_map: DataFrame | None = None, reuse: bool = True, glob: str = GLOB) -> Build:
    """Write all relations of the logs below path to a new build and publish it; an existing build is reused.

    A window without as_of counts from now; the stamp keeps that time.
    """
    if not (reuse and build_meta(spark, out) is not None):
        if days != 0 and as_of is None:
            as_of = str(spark.sql("SELECT current_timestamp()").first()[0])
        build, files = uuid.uuid4().hex, stored(listing(spark, path, glob))
        schemas = write_tables(Relations(windowed(read_log(spark, path, glob=glob), days, as_of), project_map), out, build)
        read = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0).cast("long"))).first()
        publish(spark, out, build, files, {"source": path, "schemas": schemas, "days": str(days), "as_of": as_of, "glob": glob, "files_read": read[0], "bytes_read": read[1]}, project_map=project_map)
    return read_build(spark, out)
