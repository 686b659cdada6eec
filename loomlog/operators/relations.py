"""Relations derived from messages; each takes and returns DataFrames and stays lazy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.functions.pricing import cost_expr, with_rates
from loomlog.functions.text import BUILT_IN_COMMANDS, WRITE_TOOLS, last_segment, tool_hint
from loomlog.operators.joins import spread_left_join

SESSION = ["session_id", "started_at", "ended_at", "duration", "duration_sec", "user_messages", "assistant_messages", "model", "cwd", "project", "git_branch", "entrypoint"]
#: Columns of which a session takes the earliest value.
_FIRSTS = ["model", "cwd", "git_branch", "entrypoint"]


def _content(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("message.content", path, kind)


def _json_text(v: Column) -> Column:
    """A VARIANT as text: strings bare, anything else as JSON."""
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))


def session_key() -> Column:
    """A session's name, null sessions under one of their own, for joins on it."""
    return F.coalesce("session_id", F.lit("\0"))


def first_filled(column: str) -> Column:
    """The earliest value that is not null."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.struct("timestamp", "uuid"))).alias(column)


def with_project(df: DataFrame, project_map: DataFrame | None) -> DataFrame:
    """Add project: its name in the map of (cwd, project_name), else the last segment of cwd."""
    fallback = last_segment(F.col("cwd"))
    if project_map is None:
        return df.withColumn("project", fallback)
    names = project_map.groupBy("cwd").agg(F.min("project_name").alias("_name"))
    return df.join(names, "cwd", "left").withColumn("project", F.coalesce("_name", fallback)).select(*df.columns, "project")


def _counted(msgs: DataFrame, firsts: list[Column]) -> DataFrame:
    """Span and message counts of each session, and what `firsts` make of its rows."""
    typed = (F.col("type") == "user") & (F.col("role") == "user")
    rows = msgs.select("session_id", "timestamp", "uuid", "type", "role", "model", "cwd", "git_branch", "entrypoint", _content("$[0].type").alias("_block"))
    return rows.groupBy("session_id").agg(
        F.min("timestamp").alias("started_at"),
        F.max("timestamp").alias("ended_at"),
        F.count_if(typed & ~F.col("_block").eqNullSafe(F.lit("tool_result"))).alias("user_messages"),
        F.count_if(F.col("type") == "assistant").alias("assistant_messages"),
        *firsts,
    )


def _with_durations(sessions: DataFrame, project_map: DataFrame | None) -> DataFrame:
    out = sessions.withColumn("duration", F.col("ended_at") - F.col("started_at"))
    out = out.withColumn("duration_sec", (F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1e6)
    return with_project(out, project_map).select(*SESSION)


def logical_sessions(msgs: DataFrame, project_map: DataFrame | None = None) -> DataFrame:
    """One row per session: span, message counts, and its earliest model, directory, branch and entry point.

    A user message counts unless its first block is a tool result. Durations are elapsed time.
    """
    return _with_durations(_counted(msgs, [first_filled(c) for c in _FIRSTS]), project_map)


def session_states(msgs: DataFrame) -> DataFrame:
    """What some messages tell of their sessions, so that states of several parts of a log can be added up.

    An earliest value stands with its place (timestamp, uuid), which decides between parts.
    """
    placed = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("timestamp", "uuid", F.col(c).alias("value")))).alias(c)
    return _counted(msgs, [placed(c) for c in _FIRSTS])


def merged_states(states: DataFrame) -> DataFrame:
    """One state per session from the states of parts that have no message in common, in any order."""
    sums = [F.sum(c).alias(c) for c in ("user_messages", "assistant_messages")]
    return states.groupBy("session_id").agg(F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"), *sums, *[F.min(c).alias(c) for c in _FIRSTS])


def sessions_of_states(states: DataFrame, project_map: DataFrame | None = None) -> DataFrame:
    """The rows of logical_sessions from session states."""
    return _with_durations(merged_states(states).withColumns({c: F.col(f"{c}.value") for c in _FIRSTS}), project_map)


def message_costs(msgs: DataFrame) -> DataFrame:
    """Token usage, one row per message id: of its copies the earliest counts. Rows without an id are dropped."""
    tokens = lambda path: F.coalesce(F.col(f"message.usage.{path}"), F.lit(0).cast("long"))
    rows = msgs.filter((F.col("type") == "assistant") & F.col("message.id").isNotNull()).select(
        F.col("message.id").alias("message_id"),
        "timestamp",
        "uuid",
        F.struct(
            "session_id",
            "uuid",
            "parent_uuid",
            "timestamp",
            "is_sidechain",
            "model",
            tokens("input_tokens").alias("input_tokens"),
            tokens("output_tokens").alias("output_tokens"),
            tokens("cache_read_input_tokens").alias("cache_read_tokens"),
            tokens("cache_creation_input_tokens").alias("cache_creation_tokens"),
            tokens("cache_creation.ephemeral_5m_input_tokens").alias("cache_creation_5m"),
            tokens("cache_creation.ephemeral_1h_input_tokens").alias("cache_creation_1h"),
        ).alias("row"),
    )
    first = rows.groupBy("message_id").agg(F.min_by("row", F.struct(F.coalesce("timestamp", F.lit("9999-12-31").cast("timestamp")), "uuid")).alias("row"))
    return first.select("row.session_id", "row.uuid", "row.parent_uuid", "row.timestamp", "row.is_sidechain", "row.model", "message_id", "row.input_tokens", "row.output_tokens", "row.cache_read_tokens", "row.cache_creation_tokens", "row.cache_creation_5m", "row.cache_creation_1h")


def blocks(msgs: DataFrame) -> DataFrame:
    """Messages with array content, a row for each block: block_idx and block (VARIANT)."""
    listed = msgs.withColumn("_list", _content("$", "array<variant>")).filter(F.size("_list") > 0)
    return listed.select("*", F.posexplode("_list").alias("block_idx", "block")).drop("_list")


def _field(name: str) -> Column:
    return F.try_variant_get("block", f"$.{name}", "string")


def _flag(name: str) -> Column:
    """A boolean field; text that reads like one is none."""
    value = F.try_variant_get("block", f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))


def tool_calls(msgs: DataFrame, dedupe: bool = False) -> DataFrame:
    """Calls of tools with their results and execution time.

    Calls and results meet on tool_use_id over the whole log; repeated copies multiply unless
    dedupe keeps the earliest call and result of an id. is_error is null without a result, and
    false where the result does not say true.
    """
    use = blocks(msgs.filter("type = 'assistant'")).filter(_field("type") == "tool_use")
    calls = use.select("session_id", F.col("timestamp").alias("called_at"), F.col("uuid").alias("assistant_uuid"), _field("name").alias("tool_name"), _field("id").alias("tool_use_id"), _json_text(F.try_variant_get("block", "$.input", "variant")).alias("tool_input"))
    done = blocks(msgs.filter("type = 'user'")).filter(_field("type") == "tool_result")
    results = done.select(_field("tool_use_id").alias("tool_use_id"), _flag("is_error").alias("is_error"), _json_text(F.col("tool_use_result")).alias("tool_use_result"), F.col("timestamp").alias("result_at"), F.col("uuid").alias("_uuid"))
    if dedupe:
        calls = calls.groupBy("tool_use_id").agg(F.min_by(F.struct(*[c for c in calls.columns if c != "tool_use_id"]), F.struct("called_at", "assistant_uuid")).alias("_r")).select("tool_use_id", "_r.*")
        results = results.groupBy("tool_use_id").agg(F.min_by(F.struct("is_error", "tool_use_result", "result_at", "_uuid"), F.struct("result_at", "_uuid")).alias("_r")).select("tool_use_id", "_r.*")
    joined = spread_left_join(calls, results.drop("_uuid"), "tool_use_id", ["assistant_uuid", "called_at"])
    return joined.select("session_id", "called_at", "tool_name", "tool_use_id", "tool_input", "is_error", "tool_use_result", "result_at", (F.col("result_at") - F.col("called_at")).alias("execution_time"), ((F.unix_micros("result_at") - F.unix_micros("called_at")) / 1e6).alias("execution_sec"))


def kind_expr() -> Column:
    """Kind of a block from block_type, type, role, is_sidechain and text; the order of the rules matters."""
    typed = (F.col("type") == "user") & (F.col("role") == "user")
    text = F.coalesce("text", F.lit(""))
    return (
        F.when(F.col("block_type") == "thinking", "agent_thinking")
        .when(F.col("block_type") == "tool_use", "agent_tool_call")
        .when(F.col("block_type") == "tool_result", "tool_result")
        .when(F.col("type") == "assistant", "agent_text")
        .when(typed & (text.like("<command-name>%") | text.like("<local-command-%")), "slash_command")
        .when(typed & F.col("is_sidechain"), "subagent_prompt")
        .when(typed, "human_prompt")
        .otherwise("agent_text")
    )


def message_blocks(msgs: DataFrame) -> DataFrame:
    """A row for each content block, or one for string content, classified into seven kinds."""
    head = ["session_id", "uuid", "parent_uuid", "timestamp", "type", "role", "is_sidechain", "model"]
    listed = blocks(msgs).select(*head, "block_idx", _field("type").alias("block_type"), _field("text").alias("text"), _field("thinking").alias("thinking_text"), _field("name").alias("tool_name"), _field("id").alias("tool_use_id"), _json_text(F.try_variant_get("block", "$.input", "variant")).alias("tool_input"))
    none = F.lit(None).cast("string")
    plain = msgs.filter(F.schema_of_variant("message.content") == "STRING").select(*head, F.lit(0).alias("block_idx"), F.lit("text").alias("block_type"), _content("$").alias("text"), none.alias("thinking_text"), none.alias("tool_name"), none.alias("tool_use_id"), none.alias("tool_input"))
    both = listed.unionByName(plain).withColumn("kind", kind_expr())
    return both.select("session_id", "uuid", "parent_uuid", "timestamp", "block_idx", "is_sidechain", "model", "kind", "text", "thinking_text", "tool_name", "tool_use_id", "tool_input")


def _whole_text() -> Column:
    return _json_text(F.col("message.content"))


def _prompt_text() -> Column:
    return F.coalesce(_content("$[0].text"), _whole_text())


def conversation_turns(msgs: DataFrame) -> DataFrame:
    """User messages and assistant messages that begin with text, numbered in each session by time, then uuid."""
    turn = ((F.col("type") == "user") & (F.col("role") == "user")) | ((F.col("type") == "assistant") & (_content("$[0].type") == "text"))
    rows = msgs.filter(turn).select("session_id", "timestamp", "type", "role", "uuid", F.when(F.col("type") == "user", _whole_text()).otherwise(_content("$[0].text")).alias("content_text"))
    order = F.row_number().over(Window.partitionBy("session_id").orderBy("timestamp", "uuid"))
    return rows.withColumn("turn_order", order.cast("long")).select("session_id", "timestamp", "type", "role", "uuid", "turn_order", "content_text")


def session_titles(msgs: DataFrame) -> DataFrame:
    """(session_id, first_prompt): the first user prompt that is no tool result, clear command or caveat."""
    rows = msgs.filter((F.col("type") == "user") & (F.col("role") == "user")).select("session_id", "timestamp", "uuid", _content("$[0].type").alias("block"), _prompt_text().alias("prompt"))
    text = F.coalesce("prompt", F.lit(""))
    real = rows.filter(~F.col("block").eqNullSafe(F.lit("tool_result")) & ~text.like("/clear%") & ~text.like("<command-name>/clear%") & ~text.like("<local-command-caveat>%"))
    return real.groupBy("session_id").agg(F.min_by("prompt", F.struct("timestamp", "uuid")).alias("first_prompt"))


def message_commands(msgs: DataFrame) -> DataFrame:
    """A row for each command tag in a user message."""
    rows = msgs.filter((F.col("type") == "user") & (F.col("role") == "user"))
    return rows.select("session_id", "uuid", "timestamp", F.explode(F.regexp_extract_all(_prompt_text(), F.lit("<command-name>([^<]+)</command-name>"), 1)).alias("command"))


def file_reads(calls: DataFrame) -> DataFrame:
    path = F.get_json_object("tool_input", "$.file_path")
    return calls.filter("tool_name = 'Read'").select("session_id", "tool_use_id", "called_at", path.alias("file_path")).filter("file_path is not null")


def file_writes(calls: DataFrame) -> DataFrame:
    path = F.coalesce(F.get_json_object("tool_input", "$.file_path"), F.get_json_object("tool_input", "$.notebook_path"))
    return calls.filter(F.col("tool_name").isin(WRITE_TOOLS)).select("session_id", "tool_use_id", "called_at", "tool_name", path.alias("file_path")).filter("file_path is not null")


def _sessions_with_titles(msgs: DataFrame) -> DataFrame:
    """logical_sessions without project and duration, with first_prompt and commands, in one aggregation."""
    typed = (F.col("type") == "user") & (F.col("role") == "user")
    # Columns of their own, so that each is computed once for a message.
    rows = msgs.select("session_id", "timestamp", "uuid", "type", "model", "cwd", "git_branch", "entrypoint", typed.alias("_typed"), _content("$[0].type").alias("_block"), F.when(typed, _prompt_text()).alias("_prompt"))
    named = F.regexp_extract_all("_prompt", F.lit("<command-name>([^<]+)</command-name>"), 1)
    rows = rows.withColumn("_commands", F.when(F.contains("_prompt", F.lit("<command-name>")), F.filter(named, lambda c: ~c.isin(BUILT_IN_COMMANDS))))
    text, at = F.coalesce("_prompt", F.lit("")), F.struct("timestamp", "uuid")
    result = F.col("_block").eqNullSafe(F.lit("tool_result"))
    titled = F.col("_typed") & ~result & ~text.like("/clear%") & ~text.like("<command-name>/clear%") & ~text.like("<local-command-caveat>%")
    return rows.groupBy("session_id").agg(
        F.min("timestamp").alias("started_at"),
        F.max("timestamp").alias("ended_at"),
        F.count_if(F.col("_typed") & ~result).alias("user_messages"),
        F.count_if(F.col("type") == "assistant").alias("assistant_messages"),
        *[first_filled(c) for c in ("model", "cwd", "git_branch", "entrypoint")],
        F.min_by("_prompt", F.when(titled, at)).alias("first_prompt"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_commands")))).alias("_commands"),
    )


def _usage_and_calls(msgs: DataFrame) -> DataFrame:
    """Slim rows of one scan, told apart by kind: a usage record (m), a call (c), a result (r).

    key is the message or tool id; calls without an id get one of their own, as no result meets them.
    """
    tokens = lambda path: F.coalesce(F.col(f"message.usage.{path}"), F.lit(0).cast("long"))
    usage = F.struct(
        F.struct(F.coalesce("timestamp", F.lit("9999-12-31").cast("timestamp")).alias("t"), "uuid").alias("at"), "session_id", "model", tokens("input_tokens").alias("input_tokens"), tokens("output_tokens").alias("output_tokens"),
        tokens("cache_read_input_tokens").alias("cache_read_tokens"), tokens("cache_creation_input_tokens").alias("cache_creation_tokens"), tokens("cache_creation.ephemeral_5m_input_tokens").alias("cache_creation_5m"), tokens("cache_creation.ephemeral_1h_input_tokens").alias("cache_creation_1h"),
    )
    is_call = F.col("type") == "assistant"
    is_usage = is_call & F.col("message.id").isNotNull()
    slim = msgs.select("session_id", is_call.alias("_call"), F.when(is_usage, F.col("message.id")).alias("_id"), F.when(is_usage, usage).alias("m"), F.when(F.col("type").isin("user", "assistant"), _content("$", "array<variant>")).alias("_list"), F.xxhash64("session_id", "uuid", "timestamp").alias("_row"))
    m_type = slim.schema["m"].dataType.simpleString()
    # Every block, and the usage record as one more.
    rows = slim.filter("_id is not null or size(_list) > 0").select("session_id", "_call", "_id", "m", "_row", F.posexplode(F.concat(F.array(F.lit(None).cast("variant")), F.coalesce("_list", F.array().cast("array<variant>")))).alias("_i", "block"))
    rows = rows.withColumn("_type", _field("type")).filter(F.when(F.col("_i") == 0, F.col("_id").isNotNull()).otherwise(F.col("_type") == F.when(F.col("_call"), "tool_use").otherwise("tool_result")))
    rows = rows.withColumn("kind", F.when(F.col("_i") == 0, "m").when(F.col("_call"), "c").otherwise("r"))
    rows = rows.withColumn("_name", F.when(F.col("kind") == "c", _field("name")))
    rows = rows.withColumn("reads", F.coalesce(F.col("_name") == "Read", F.lit(False))).withColumn("writes", F.coalesce(F.col("_name").isin(WRITE_TOOLS), F.lit(False)))
    rows = rows.withColumn("_input", F.when(F.col("reads") | F.col("writes"), _json_text(F.try_variant_get("block", "$.input", "variant"))))
    path = F.coalesce(F.get_json_object("_input", "$.file_path"), F.when(F.col("writes"), F.get_json_object("_input", "$.notebook_path")))
    alone = F.concat_ws("\0", F.lit(""), F.col("_row").cast("string"), F.col("_i").cast("string"))
    key = F.when(F.col("kind") == "m", F.col("_id")).when(F.col("kind") == "c", F.coalesce(_field("id"), alone)).otherwise(_field("tool_use_id"))
    return rows.select("kind", key.alias("key"), F.when(F.col("kind") == "c", F.col("session_id")).alias("session_id"), path.alias("path"), "reads", "writes", F.when(F.col("kind") == "m", F.col("m")).cast(m_type).alias("m"))


def session_stats(msgs: DataFrame, rate_table: DataFrame, project_map: DataFrame | None = None) -> DataFrame:
    """Sessions with title, tool and file counts, command list and cost, from two scans of the messages.

    One aggregation by session gives what its messages tell. Usage, calls and results are aggregated
    together by message or tool id; results then meet their calls, and files are told apart in each
    session. Sessions, titles, commands, counts and costs agree with the relations of those names;
    missing counts are zero, a missing title, command list or cost null. A null session counts like
    any other.
    """
    sessions = _sessions_with_titles(msgs).withColumn("_session", session_key())
    first = _usage_and_calls(msgs).groupBy("kind", "key", "session_id", "path", "reads", "writes").agg(F.count("*").alias("n"), F.min_by("m", "m.at").alias("m"))
    # A result counts for every call of its id.
    results = F.sum(F.when(F.col("kind") == "r", F.col("n"))).over(Window.partitionBy("key", F.col("kind") == "m"))
    met = first.withColumn("calls", F.when(F.col("kind") == "c", F.col("n") * F.greatest(F.lit(1), F.coalesce(results, F.lit(0))))).filter("kind <> 'r'")
    tokens = ("model", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "cache_creation_5m", "cache_creation_1h")
    used = met.select(F.coalesce("session_id", "m.session_id").alias("session_id"), "path", "reads", "writes", "calls", "kind", *[F.col(f"m.{c}") for c in tokens])
    billed = with_rates(used, rate_table).withColumn("cost", F.when(F.col("kind") == "m", cost_expr())).withColumn("_session", session_key())
    by_file = billed.groupBy("_session", "path").agg(F.sum("calls").alias("calls"), (F.bool_or("reads") & F.col("path").isNotNull()).alias("reads"), (F.bool_or("writes") & F.col("path").isNotNull()).alias("writes"), F.sum("cost").alias("cost"))
    return _with_counts(sessions, by_file.join(sessions.select("_session", "cwd"), "_session"), project_map)


def _with_counts(sessions: DataFrame, by_file: DataFrame, project_map: DataFrame | None) -> DataFrame:
    """session_stats from sessions with titles and, for each session and path, its cwd, calls, cost and whether it was read or written."""
    outside = ~F.col("path").startswith(F.coalesce("cwd", F.lit("")))
    counted = by_file.groupBy("_session").agg(
        F.sum("calls").alias("tool_count"), F.count_if("reads").alias("files_read"), F.count_if("writes").alias("files_edited"), F.count_if(F.col("reads") & ~F.col("writes")).alias("files_read_only"), F.count_if(F.col("reads") & outside).alias("files_outside"), F.sum("cost").alias("cost_usd"),
    )
    out = sessions.join(counted, "_session", "left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("tool_count", "files_read", "files_edited", "files_read_only", "files_outside")})
    out = out.withColumn("duration", F.col("ended_at") - F.col("started_at")).withColumn("duration_sec", (F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1e6)
    out = with_project(out.withColumn("commands", F.when(F.size("_commands") > 0, F.array_join("_commands", ", "))), project_map)
    return out.select(*SESSION, "tool_count", "files_read", "files_edited", "files_read_only", "files_outside", "first_prompt", "commands", "cost_usd")


def session_stats_of(msgs: DataFrame, calls: DataFrame, costs: DataFrame, rate_table: DataFrame, project_map: DataFrame | None = None) -> DataFrame:
    """The rows of session_stats where tool_calls and message_costs are tables already, which know of other sessions' copies and results."""
    sessions = _sessions_with_titles(msgs).withColumn("_session", session_key())
    reads, writes = F.coalesce(F.col("tool_name") == "Read", F.lit(False)), F.coalesce(F.col("tool_name").isin(WRITE_TOOLS), F.lit(False))
    path = F.when(reads | writes, F.coalesce(F.get_json_object("tool_input", "$.file_path"), F.when(writes, F.get_json_object("tool_input", "$.notebook_path"))))
    called = calls.select(session_key().alias("_session"), path.alias("path"), F.lit(1).cast("long").alias("calls"), reads.alias("reads"), writes.alias("writes"), F.lit(None).cast("double").alias("cost"))
    spent = with_rates(costs, rate_table).select(session_key().alias("_session"), F.lit(None).cast("string").alias("path"), F.lit(0).cast("long").alias("calls"), F.lit(False).alias("reads"), F.lit(False).alias("writes"), cost_expr().alias("cost"))
    by_file = called.unionByName(spent).groupBy("_session", "path").agg(F.sum("calls").alias("calls"), (F.bool_or("reads") & F.col("path").isNotNull()).alias("reads"), (F.bool_or("writes") & F.col("path").isNotNull()).alias("writes"), F.sum("cost").alias("cost"))
    return _with_counts(sessions, by_file.join(sessions.select("_session", "cwd"), "_session"), project_map)


def session_timeline(msg_blocks: DataFrame, calls: DataFrame, costs: DataFrame) -> DataFrame:
    """Blocks but tool results, with their call's result and their message's usage.

    Usage stands only on the first block of a message, if that is text or thinking.
    """
    shown = msg_blocks.filter("kind <> 'tool_result'")
    call = calls.select("tool_use_id", "tool_use_result", "is_error", "execution_sec")
    usage = costs.select("uuid", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")
    # Blocks without a uuid have no first one; they are dealt by other columns, not as one group.
    known = F.coalesce("uuid", F.lit("")) != ""
    first = F.row_number().over(Window.partitionBy("uuid", F.when(~known, F.xxhash64("session_id", "timestamp", "block_idx"))).orderBy("timestamp", "block_idx")) == 1
    rows = spread_left_join(shown.withColumn("is_first_block", first & known), call, "tool_use_id", ["uuid", "timestamp", "block_idx"])
    rows = spread_left_join(rows, usage, "uuid", ["session_id", "timestamp", "block_idx"])
    badge = F.col("is_first_block") & F.col("kind").isin("agent_text", "agent_thinking")
    return rows.select(
        "session_id", "timestamp", "block_idx", "uuid", "kind", "is_first_block", F.coalesce("is_sidechain", F.lit(False)).alias("is_sidechain"), "text", "thinking_text", "tool_name", "tool_use_id", tool_hint(F.coalesce("tool_name", F.lit("")), F.col("tool_input")).alias("tool_hint"),
        "tool_use_result", F.coalesce("is_error", F.lit(False)).alias("is_error"), "execution_sec", *[F.when(badge, F.coalesce(F.col(c), F.lit(0).cast("long"))).alias(c) for c in usage.columns[1:]],
    )


def file_sessions(msgs: DataFrame) -> DataFrame:
    """(file_path, session_id): which sessions have messages in which files."""
    return msgs.select("file_path", "session_id").distinct()


def session_links(msgs: DataFrame) -> DataFrame:
    """(kind, id, session_id): the message ids and tool call ids of each session, in calls and results alike.

    What relations make of a session depends on those sessions alone that share an id with it.
    """
    messages = msgs.select(F.lit("message").alias("kind"), F.col("message.id").alias("id"), "session_id")
    tools = blocks(msgs.select("session_id", "message")).filter(_field("type").isin("tool_use", "tool_result"))
    both = messages.unionByName(tools.select(F.lit("tool").alias("kind"), F.when(_field("type") == "tool_use", _field("id")).otherwise(_field("tool_use_id")).alias("id"), "session_id"))
    return both.filter("id is not null").distinct()


def get_session(sessions: DataFrame, turns: DataFrame, session_id: str, text_chars: int = 500) -> tuple[DataFrame, DataFrame]:
    """Metadata of one session and its turns in order, texts cut."""
    own = turns.filter(F.col("session_id") == session_id).orderBy("turn_order")
    return sessions.filter(F.col("session_id") == session_id), own.withColumn("content_text", F.substring("content_text", 1, text_chars))
