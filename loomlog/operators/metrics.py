"""Counts, rates, histograms and listings over sessions and tool calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.functions.text import BUILT_IN_COMMANDS, command_of, escape_like, first_two_words, first_word

def failed() -> Column:
    """A call whose result reports an error; calls without a result did not fail."""
    return F.coalesce(F.col("is_error"), F.lit(False))


def _success() -> Column:
    return 100.0 * F.count_if(~failed()) / F.count("*")


def tool_counts(calls: DataFrame) -> DataFrame:
    return calls.groupBy("session_id").agg(F.count("*").alias("tool_count"), F.count_if(failed()).alias("failed_count"))


def file_metrics(reads: DataFrame, writes: DataFrame, sessions: DataFrame) -> DataFrame:
    """Distinct files of each session: read, read but never written, read outside its directory (by plain prefix), edited."""
    wrote = writes.select("session_id", "file_path").distinct().withColumn("_w", F.lit(True))
    read = reads.select("session_id", "file_path").distinct().join(sessions.select("session_id", "cwd"), "session_id").join(wrote, ["session_id", "file_path"], "left")
    outside = ~F.col("file_path").startswith(F.coalesce("cwd", F.lit("")))
    by_read = read.groupBy("session_id").agg(F.count("*").alias("files_read"), F.count_if(F.col("_w").isNull()).alias("files_read_only"), F.count_if(outside).alias("files_outside"))
    by_write = wrote.groupBy("session_id").agg(F.count("*").alias("files_edited"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return by_read.join(by_write, "session_id", "full").select("session_id", *[zero(c) for c in ("files_read", "files_read_only", "files_outside", "files_edited")])


def command_list(commands: DataFrame) -> DataFrame:
    """Distinct commands of each session but built-in ones, sorted and joined by commas."""
    own = commands.filter(~F.col("command").isin(BUILT_IN_COMMANDS)).select("session_id", "command").distinct()
    return own.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list("command")), ", ").alias("commands"))


def tool_breakdown(calls: DataFrame, mcp: bool = False) -> DataFrame:
    """Calls, success and share of all calls by tool, either built-in or server tools (LIKE wildcards as in the log's rule)."""
    grouped = calls.groupBy("tool_name").agg(F.count("*").alias("cnt"), _success().alias("success_rate"))
    # The total of all calls, from the few groups of one pass.
    grouped = grouped.withColumn("pct_of_total", 100.0 * F.col("cnt") / F.sum("cnt").over(Window.partitionBy(F.lit(0))))
    server = F.col("tool_name").like("mcp__%")
    return grouped.filter(server if mcp else F.col("tool_name").isNotNull() & ~server).select("tool_name", "cnt", "success_rate", "pct_of_total")


def _servers(calls: DataFrame) -> DataFrame:
    part = lambda i: F.split_part("tool_name", F.lit("__"), F.lit(i))
    return calls.filter(F.col("tool_name").like("mcp__%")).select("*", part(2).alias("server_name"), part(3).alias("command_name"))


def server_breakdown(calls: DataFrame) -> DataFrame:
    return _servers(calls).groupBy("server_name").agg(F.count("*").alias("cnt"), F.count_distinct("command_name").alias("command_count"), F.count_if(failed()).alias("failed_count"))


def server_commands(calls: DataFrame, server: str = "") -> DataFrame:
    rows = _servers(calls)
    if server:
        rows = rows.filter(F.col("server_name") == server)
    return rows.groupBy("server_name", "command_name").agg(F.count("*").alias("cnt"), F.count_if(failed()).alias("failed_count"))


def _with_sessions(calls: DataFrame, sessions: DataFrame, titles: DataFrame) -> DataFrame:
    return calls.join(titles, "session_id", "left").join(sessions.select("session_id", "project"), "session_id", "left")


def _filtered(rows: DataFrame, only_failed: bool, session: str, project: str) -> DataFrame:
    if only_failed:
        rows = rows.filter(failed())
    if session:
        rows = rows.filter(F.col("session_id") == session)
    if project:
        rows = rows.filter(F.col("project") == project)
    return rows


def search_calls(calls: DataFrame, sessions: DataFrame, titles: DataFrame, *, only_failed: bool = False, name: str = "", session: str = "", project: str = "", text: str = "", mcp: bool = False) -> DataFrame:
    """Calls by failure, name prefix, session, project and text in their input, with title and project."""
    rows = calls.filter(F.col("tool_name").like("mcp__%")) if mcp else calls
    if name:
        rows = rows.filter(F.col("tool_name") == name)
    if text:
        pattern = f"%{escape_like(text)}%"
        rows = rows.filter(F.col("tool_input").ilike(pattern) | F.get_json_object("tool_input", "$.description").ilike(pattern))
    return _filtered(_with_sessions(rows, sessions, titles), only_failed, session, project)


def call_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count_if(failed()).alias("failed_total"))


def newest_calls(rows: DataFrame, page: int = 1, page_size: int = 50) -> DataFrame:
    return rows.orderBy(F.col("called_at").desc_nulls_last(), "tool_use_id").offset((page - 1) * page_size).limit(page_size)


def tool_success(calls: DataFrame, session: str = "") -> DataFrame:
    rows = calls.filter(F.col("session_id") == session) if session else calls
    return rows.groupBy("tool_name").agg(F.count("*").alias("cnt"), _success().alias("success_rate"))


def tool_failures(calls: DataFrame, prefix: str = "", limit: int = 20) -> DataFrame:
    """The newest failed calls whose tool's name is LIKE prefix%."""
    rows = calls.filter(failed() & F.col("tool_name").like(prefix + "%"))
    return rows.orderBy(F.col("called_at").desc_nulls_last(), "tool_use_id").limit(limit)


def _shell(calls: DataFrame) -> DataFrame:
    return calls.filter("tool_name = 'Bash'").withColumn("command", command_of(F.col("tool_input"))).filter("command <> ''")


def command_prefixes(calls: DataFrame, limit: int = 40) -> DataFrame:
    """The most used two-word beginnings of shell commands."""
    grouped = _shell(calls).groupBy(first_two_words(F.col("command")).alias("prefix")).agg(F.count("*").alias("cnt"), _success().alias("success_rate"))
    return grouped.orderBy(F.col("cnt").desc(), "prefix").limit(limit)


def command_first_word(calls: DataFrame, limit: int = 30) -> DataFrame:
    grouped = _shell(calls).groupBy(first_word(F.col("command")).alias("word")).agg(F.count("*").alias("cnt"), _success().alias("success_rate"))
    return grouped.orderBy(F.col("cnt").desc(), "word").limit(limit)


def chained_share(calls: DataFrame) -> DataFrame:
    chained = F.count_if(F.contains("command", F.lit("&&")))
    return _shell(calls).agg(F.count("*").alias("total"), chained.alias("chained"), F.when(F.count("*") > 0, 100.0 * chained / F.count("*")).otherwise(0.0).alias("pct_chained"))


def search_commands(calls: DataFrame, sessions: DataFrame, titles: DataFrame, *, only_failed: bool = False, prefix: str = "", session: str = "", project: str = "", text: str = "") -> DataFrame:
    """Shell calls by two-word beginning, session, project and text in command or description."""
    rows = _shell(calls).withColumn("description", F.get_json_object("tool_input", "$.description"))
    if prefix:
        rows = rows.filter(first_two_words(F.col("command")) == prefix)
    if text:
        pattern = f"%{escape_like(text)}%"
        rows = rows.filter(F.col("command").ilike(pattern) | F.col("description").ilike(pattern))
    return _filtered(_with_sessions(rows, sessions, titles), only_failed, session, project)


def headline(sessions: DataFrame, calls: DataFrame, as_of: str) -> DataFrame:
    """One row: sessions, projects, mean duration, sessions of the day and week of as_of, tool success."""
    day = F.to_date(F.lit(as_of).cast("timestamp"))
    about = sessions.agg(
        F.count("*").alias("sessions"),
        F.count_distinct("project").alias("projects"),
        F.avg("duration_sec").alias("avg_duration_sec"),
        F.count_if(F.to_date("started_at") == day).alias("today"),
        F.count_if(F.col("started_at") >= F.date_trunc("week", day)).alias("this_week"),
    )
    n, bad = F.count("*"), F.count_if(failed())
    tools = calls.agg(n.alias("tool_calls"), bad.alias("failed_calls"), F.when(n > 0, F.round(100 * (1 - bad / n), 1)).otherwise(100.0).alias("success_rate"))
    return about.crossJoin(F.broadcast(tools))


def summary(sessions: DataFrame, calls: DataFrame) -> DataFrame:
    turns = F.col("user_messages") + F.col("assistant_messages")
    about = sessions.agg(F.count("*").alias("sessions"), F.min("started_at").alias("earliest"), F.coalesce(F.sum("user_messages"), F.lit(0)).alias("user_messages"), F.coalesce(F.sum(turns), F.lit(0)).alias("turns"), F.avg(turns).alias("avg_turns"))
    tools = calls.agg(F.count("*").alias("tool_calls"), F.count_if(failed()).alias("failed_calls"))
    return about.crossJoin(F.broadcast(tools))


def _histogram(df: DataFrame, value: Column, edges: list[tuple[float, str]], last: str, strict: bool) -> DataFrame:
    """(rank, bucket, cnt) of a value against rising edges; nulls and what is beyond fall in the last bucket."""
    rank, name = F.lit(len(edges) + 1), F.lit(last)
    for i, (edge, label) in reversed(list(enumerate(edges, 1))):
        inside = value < edge if strict else value <= edge
        rank, name = F.when(inside, i).otherwise(rank), F.when(inside, label).otherwise(name)
    return df.select(rank.alias("rank"), name.alias("bucket")).groupBy("rank", "bucket").agg(F.count("*").alias("cnt")).orderBy("rank")


def duration_histogram(sessions: DataFrame) -> DataFrame:
    edges = [(60, "< 1 min"), (300, "1-5 min"), (900, "5-15 min"), (1800, "15-30 min")]
    return _histogram(sessions, F.col("duration_sec"), edges, "30+ min", strict=True)


def turns_histogram(sessions: DataFrame) -> DataFrame:
    edges = [(2, "1-2 turns"), (5, "3-5 turns"), (10, "6-10 turns"), (20, "11-20 turns"), (50, "21-50 turns"), (100, "51-100 turns")]
    return _histogram(sessions, F.col("user_messages") + F.col("assistant_messages"), edges, "100+ turns", strict=False)


def sessions_per_day(sessions: DataFrame, days: int = 30) -> DataFrame:
    """Sessions by day of start, the newest `days` days that have any."""
    return sessions.filter("started_at is not null").groupBy(F.to_date("started_at").alias("day")).agg(F.count("*").alias("cnt")).orderBy(F.col("day").desc()).limit(days)


def model_breakdown(sessions: DataFrame, counts: DataFrame) -> DataFrame:
    rows = sessions.filter("model is not null").join(counts.select("session_id", "tool_count"), "session_id", "left")
    return rows.groupBy("model").agg(F.count("*").alias("sessions"), F.avg("duration_sec").alias("avg_duration_sec"), F.avg(F.coalesce("tool_count", F.lit(0))).alias("avg_tool_calls"))


def session_tool_summary(calls: DataFrame) -> DataFrame:
    """Calls, failures and the most used tool of each session (of equal ones the first by name)."""
    return calls.groupBy("session_id").agg(F.count("*").alias("tool_count"), F.count_if(failed()).alias("failed_count"), F.mode("tool_name", True).alias("top_tool"))


def dimension_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column that are not null, in order."""
    return df.select(F.col(column).alias("value")).filter("value is not null").distinct().orderBy("value")


#: Sort keys of session listings and the columns they stand for.
SESSION_SORTS = {"started_at": "started_at", "duration": "duration_sec", "user_msgs": "user_messages", "asst_msgs": "assistant_messages", "tool_calls": "tool_count", "model": "model", "project": "project", "branch": "git_branch", "title": "first_prompt", "files_read": "files_read", "files_edited": "files_edited", "files_read_only": "files_read_only", "files_outside": "files_outside", "cost": "cost_usd"}


def filter_sessions(stats: DataFrame, *, model: str = "", project: str = "", branch: str = "", commands: DataFrame | None = None, command: str = "", hits: DataFrame | None = None) -> DataFrame:
    """Sessions by model, project, branch, use of a command, and membership in search hits."""
    out = stats
    for column, value in (("model", model), ("project", project), ("git_branch", branch)):
        if value:
            out = out.filter(F.col(column) == value)
    if command and commands is not None:
        out = out.join(commands.filter(F.col("command") == command).select("session_id").distinct(), "session_id", "left_semi")
    if hits is not None:
        out = out.join(hits.select("session_id").distinct(), "session_id", "left_semi")
    return out


def list_sessions(stats: DataFrame, sort: str = "started_at", descending: bool = True, page: int = 1, page_size: int = 50, **filters) -> DataFrame:
    """One page of filtered sessions; nulls come last when descending, first when ascending."""
    if sort not in SESSION_SORTS or page_size not in (25, 50, 100, 200) or page < 1:
        raise ValueError("unknown sort key, page size or page")
    key = F.col(SESSION_SORTS[sort])
    return filter_sessions(stats, **filters).orderBy(key.desc_nulls_last() if descending else key.asc_nulls_first(), "session_id").offset((page - 1) * page_size).limit(page_size)


def top_sessions(stats: DataFrame, by: str, k: int = 15) -> DataFrame:
    """The k sessions with most of a column, nulls last."""
    return stats.orderBy(F.col(by).desc_nulls_last(), "session_id").limit(k)
