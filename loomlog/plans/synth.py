"""Log records derived from an `events` table, for demonstration, tests and benchmarks.

A session is a user; each event is an assistant message with a tool call, answered by a user
message with the result a second later, except every tenth. Every seventh is logged a second
time under the same message id, every eleventh stands on a sidechain, every fiftieth starts a
sub-agent, every fortieth follows a prompt with a command tag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MODELS = ["claude-opus-4-7-20260101", "claude-sonnet-4-5-20250929", "claude-haiku-4-5-20251001", "claude-opus-4-1", "house-model"]
_HEAD = ["type", "timestamp", "sessionId", "uuid", "parentUuid", "isSidechain", "cwd", "version", "entrypoint", "gitBranch", "requestId"]


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def _json(fields: dict[str, Column]) -> Column:
    """JSON text of an object; fields given as columns of JSON text."""
    parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _str(c: Column | str) -> Column:
    c = F.lit(c) if isinstance(c, str) else c
    return F.concat(F.lit('"'), c, F.lit('"'))


def _usage(e: dict[str, Column]) -> Column:
    split = F.col("event_id") % 3 != 0
    zero = F.lit(0).cast("long")
    return F.struct(
        e["input"].alias("input_tokens"),
        e["output"].alias("output_tokens"),
        e["read"].alias("cache_read_input_tokens"),
        e["write"].alias("cache_creation_input_tokens"),
        F.struct(F.when(split, e["write"]).otherwise(zero).alias("ephemeral_5m_input_tokens"), F.when(split, e["input"]).otherwise(zero).alias("ephemeral_1h_input_tokens")).alias("cache_creation"),
    )


def log_records(events: DataFrame) -> DataFrame:
    """Records with the columns of a read log."""
    tokens = lambda k: F.floor(F.col("value") * k).cast("long")
    k = F.get_json_object("props", "$.k")
    base = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", k.alias("k"))
    base = base.withColumn("prev", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    eid, uid = F.col("event_id").cast("string"), F.col("user_id")
    usage = _usage({"input": tokens(1000), "output": tokens(100), "read": tokens(300), "write": tokens(5000)})
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (uid % 5 + 1).cast("int"))
    cwd = F.concat(F.lit("/home/u"), (uid % 7).cast("string"), F.lit("/proj"), (uid % 3).cast("string"))
    path = F.concat(F.when(F.col("event_id") % 5 == 0, F.lit("/etc")).otherwise(cwd), F.lit("/src/f"), F.col("k"), F.lit(".py"))
    kind = F.col("event_type")
    name = F.when(kind == "view", "Read").when(kind == "purchase", "Edit").when(kind == "signup", "mcp__crm__signup").otherwise("Bash")
    given = (
        F.when(kind.isin("view", "purchase"), _json({"file_path": _str(path)}))
        .when(kind == "signup", _json({"k": F.col("k")}))
        .when(kind == "click", _json({"command": _str(F.concat(F.lit("git log -n "), F.col("k"))), "description": _str("history")}))
        .otherwise(_json({"command": _str(F.concat(F.lit("make test && echo "), F.col("k")))}))
    )

    # What an event's records are made of stands in columns before they are told apart: once for each event, and in
    # pieces of code small enough for the JVM to compile. One pass makes all; columns that are not read are never made.
    made = base.withColumns({"_cwd": cwd, "_given": given, "_session": F.concat(F.lit("s"), uid.cast("string")), "_model": model, "_usage": usage, "_eid": eid})
    eid, cwd, given = F.col("_eid"), F.col("_cwd"), F.col("_given")
    call = _json({"type": _str("tool_use"), "id": _str(F.concat(F.lit("t"), eid)), "name": _str(name), "input": given})
    task = F.when(F.col("event_id") % 50 == 0, _json({"type": _str("tool_use"), "id": _str(F.concat(F.lit("k"), eid)), "name": _str("Task"), "input": _json({"subagent_type": _str("explorer"), "description": _str("look around")})}))
    content = F.concat(F.lit("["), F.concat_ws(",", call, task), F.lit("]"))
    copy = F.concat(F.lit("["), _json({"type": _str("text"), "text": _str(F.concat(F.lit("copy "), F.col("k")))}), F.lit("]"))
    done = F.concat(F.lit("["), _json({"type": _str("tool_result"), "tool_use_id": _str(F.concat(F.lit("t"), eid)), "is_error": F.when(kind == "error", "true").otherwise("false"), "content": _str(F.concat(F.lit("out "), F.col("k")))}), F.lit("]"))
    command = F.when(F.col("event_id") % 120 == 0, "/clear").otherwise(F.concat(F.lit("/cmd"), (F.col("event_id") % 3).cast("string"), F.lit("x"), (uid % 4).cast("string")))
    prompt = _str(F.concat(F.lit("<command-name>"), command, F.lit("</command-name>")))
    places = {"asked": F.lit(True), "again": F.col("event_id") % 7 == 0, "answered": F.col("event_id") % 10 != 0, "prompted": F.col("event_id") % 40 == 0}
    made = made.withColumns({f"_text{i}": F.when(c, text) for i, (c, text) in enumerate(zip(places.values(), (content, copy, done, prompt)))})
    numbered = made.withColumn("_record", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(places.values())]))))
    by = lambda *values: F.element_at(F.array(*values), F.col("_record") + 1)
    is_call, is_result = F.col("_record") <= 1, F.col("_record") == 2
    later = by(*[F.expr(f"INTERVAL '{x}' SECOND") for x in ("0", "0.5", "1", "0.25")])
    text, model, usage = by(*[F.col(f"_text{i}") for i in range(4)]), F.col("_model"), F.col("_usage")
    message = F.struct(
        F.when(is_call, "assistant").otherwise("user").alias("role"),
        F.when(is_call, F.concat(F.lit("m"), eid)).alias("id"),
        F.when(is_call, model).alias("model"),
        F.when(is_call, usage).alias("usage"),
        F.parse_json(text).alias("content"),
    )
    previous = F.concat(F.lit("u"), F.col("prev").cast("string"))
    head = [
        F.when(is_call, "assistant").otherwise("user"),
        _iso(F.col("ts") + later),
        F.col("_session"),
        F.concat(by(F.lit("a"), F.lit("a"), F.lit("u"), F.lit("p")), eid, F.when(F.col("_record") == 1, "-dup").otherwise("")),
        F.when(is_call, previous).when(is_result, F.concat(F.lit("a"), eid)),
        F.col("event_id") % 11 == 0,
        cwd,
        F.lit("2.1.0"),
        F.lit("cli"),
        F.when(uid % 2 == 0, "main").otherwise("dev"),
        F.concat(F.lit("r"), eid),
    ]
    result = F.parse_json(F.when(is_result, _json({"stdout": _str(F.concat(F.lit("out "), F.col("k")))})))
    return numbered.select(*[c.alias(n) for c, n in zip(head, _HEAD)], message.alias("message"), result.alias("toolUseResult"))


def usage_type() -> str:
    return "struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint,cache_creation:struct<ephemeral_5m_input_tokens:bigint,ephemeral_1h_input_tokens:bigint>>"


def chat_records(conversations: DataFrame, thinking: bool = False) -> DataFrame:
    """Records of plain conversations: string prompts of users, text blocks of assistants; other roles keep their type.

    thinking: every third message of an assistant begins with a block of thinking, and every fifth turn stands on a sidechain.
    """
    ts = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    is_assistant = F.col("role") == "assistant"
    said = F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("thinking"), F.col("text").alias("text"))
    thought = F.struct(F.lit("thinking").alias("type"), F.col("text").alias("thinking"), F.lit(None).cast("string").alias("text"))
    listed = F.when(F.col("turn") % 3 == 0, F.array(thought, said)).otherwise(F.array(said)) if thinking else F.array(said)
    side = F.col("turn") % 5 == 0 if thinking else F.lit(False)
    text = F.when(is_assistant, F.to_json(listed)).otherwise(F.to_json(F.struct(F.col("text").alias("t"))))
    content = F.when(is_assistant, F.parse_json(text)).otherwise(F.try_variant_get(F.parse_json(text), "$.t", "variant"))
    none = F.lit(None).cast("string")
    message = F.struct(F.col("role").alias("role"), none.alias("id"), none.alias("model"), F.lit(None).cast(usage_type()).alias("usage"), content.alias("content"))
    head = [F.col("role"), _iso(ts), F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")), none, side, F.lit("/tmp/chat"), F.lit("1"), F.lit("cli"), F.lit("main"), none]
    return conversations.select(*[c.alias(n) for c, n in zip(head, _HEAD)], message.alias("message"), F.parse_json(none).alias("toolUseResult"))


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_records(spark.read.parquet(f"{sf_dir}/events.parquet"))


def chat_log(spark: SparkSession, sf_dir: str, thinking: bool = False) -> DataFrame:
    return chat_records(spark.read.parquet(f"{sf_dir}/conversations.parquet"), thinking)
