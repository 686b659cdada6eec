"""Registered queries over records derived from the given tables, and their oracle SQL on the tables themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions.pricing import unpriced_models
from loomlog.functions.text import clean_title, snippet
from loomlog.operators import cost, metrics, relations, search, segments, series
from loomlog.plans.relations import Relations, ad_hoc, materialize, read_build, register_views
from loomlog.plans.synth import chat_log, events_log
from loomlog.sources.logs import browse_raw, changed_files, file_census, list_files, quarantine, raw_messages, raw_records, read_log, record_types, within_days
from loomlog.sources.scratch import remove_folder, scratch_folder, stored
from loomlog.streaming import rollup
from loomlog.streaming import stream as streams

AS_OF = "2024-01-25 12:00:00"
DAY = ("2024-01-15 00:00:00", "2024-01-16 00:00:00")
PICK = "s3"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# What the oracle knows of the records: one row for each event, its call, and who caused it.
_EV = """
WITH ev0 AS (
  SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, 's' || CAST(user_id AS VARCHAR) AS session_id, event_type,
    json_extract_string(props, '$.k') AS k, CAST(floor(value * 1000) AS BIGINT) AS inp, CAST(floor(value * 100) AS BIGINT) AS outp,
    CAST(floor(value * 300) AS BIGINT) AS rd, CAST(floor(value * 5000) AS BIGINT) AS wr,
    CASE WHEN event_id % 3 <> 0 THEN CAST(floor(value * 5000) AS BIGINT) ELSE 0 END AS w5,
    CASE WHEN event_id % 3 <> 0 THEN CAST(floor(value * 1000) AS BIGINT) ELSE 0 END AS w1,
    CASE user_id % 5 WHEN 0 THEN 'claude-opus-4-7-20260101' WHEN 1 THEN 'claude-sonnet-4-5-20250929' WHEN 2 THEN 'claude-haiku-4-5-20251001' WHEN 3 THEN 'claude-opus-4-1' ELSE 'house-model' END AS model,
    CASE user_id % 5 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 3.0::DOUBLE WHEN 2 THEN 1.0::DOUBLE WHEN 3 THEN 15.0::DOUBLE ELSE 0.0::DOUBLE END AS rate,
    event_id % 11 = 0 AS side, '/home/u' || CAST(user_id % 7 AS VARCHAR) || '/proj' || CAST(user_id % 3 AS VARCHAR) AS cwd,
    'proj' || CAST(user_id % 3 AS VARCHAR) AS project, CASE WHEN user_id % 2 = 0 THEN 'main' ELSE 'dev' END AS branch,
    CASE event_type WHEN 'view' THEN 'Read' WHEN 'purchase' THEN 'Edit' WHEN 'signup' THEN 'mcp__crm__signup' ELSE 'Bash' END AS tool,
    event_id % 10 <> 0 AS answered
  FROM events),
ev1 AS (
  SELECT *, (CASE WHEN event_id % 5 = 0 THEN '/etc' ELSE cwd END) || '/src/f' || k || '.py' AS path,
    CASE WHEN event_id % 3 <> 0 THEN w5 ELSE wr END AS b5,
    lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_id,
    answered AND event_type = 'error' AS bad
  FROM ev0),
ev2 AS (
  SELECT *, (b5 * 1.25 * rate + w1 * 2.0 * rate) / 1000000.0 AS wcost,
    (inp * rate + outp * 5.0 * rate + rd * 0.1 * rate + b5 * 1.25 * rate + w1 * 2.0 * rate) / 1000000.0 AS cost,
    CASE event_type WHEN 'view' THEN 'file read: f' || k || '.py' WHEN 'purchase' THEN 'file write: f' || k || '.py' WHEN 'signup' THEN 'mcp: crm__signup' WHEN 'click' THEN 'bash: git log' ELSE 'bash: make test' END AS own_bucket
  FROM ev1),
ev AS (
  SELECT e.*, p.own_bucket AS prev_bucket, p.tool AS prev_tool,
    CASE WHEN p.answered THEN p.own_bucket ELSE 'human input' END AS bucket,
    CASE WHEN NOT coalesce(p.answered, false) THEN 'Conversation' WHEN p.tool = 'Edit' THEN 'Created' ELSE 'Read' END AS category,
    CASE WHEN e.side THEN 'Subagent' ELSE 'Main' END AS agent
  FROM ev2 e LEFT JOIN ev2 p ON p.event_id = e.prev_id),
calls AS (
  SELECT session_id, user_id, project, ts, tool, 't' || CAST(event_id AS VARCHAR) AS id, bad, answered, event_type, k, path, event_id FROM ev
  UNION ALL
  SELECT session_id, user_id, project, ts, 'Task', 'k' || CAST(event_id AS VARCHAR), false, false, 'task', k, NULL, event_id FROM ev WHERE event_id % 50 = 0),
cmds AS (
  SELECT session_id, event_id, ts, CASE WHEN event_id % 120 = 0 THEN '/clear' ELSE '/cmd' || CAST(event_id % 3 AS VARCHAR) || 'x' || CAST(user_id % 4 AS VARCHAR) END AS command
  FROM ev WHERE event_id % 40 = 0),
ses AS (
  SELECT session_id, min(ts) AS started_at,
    max(ts + CASE WHEN answered THEN INTERVAL '1 second' WHEN event_id % 7 = 0 THEN INTERVAL '500 milliseconds' WHEN event_id % 40 = 0 THEN INTERVAL '250 milliseconds' ELSE INTERVAL '0 seconds' END) AS ended_at,
    CAST(count(*) FILTER (WHERE event_id % 40 = 0) AS BIGINT) AS user_messages, CAST(count(*) + count(*) FILTER (WHERE event_id % 7 = 0) AS BIGINT) AS assistant_messages,
    min(model) AS model, min(cwd) AS cwd, min(project) AS project, min(branch) AS branch, sum(cost) AS cost
  FROM ev GROUP BY session_id),
sesd AS (SELECT *, (epoch_us(ended_at) - epoch_us(started_at)) / 1000000.0 AS dur, user_messages + assistant_messages AS turns FROM ses)
"""


def query(sql: str | None = None, cte: bool = True):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = (_EV if cte else "") + sql
        return fn

    return keep


def _rel(spark: SparkSession, sf_dir: str) -> Relations:
    return Relations(events_log(spark, sf_dir))


def _prep(spark: SparkSession, sf_dir: str) -> Relations:
    """For queries that read the messages several times."""
    return _rel(spark, sf_dir).prepared()


def _us(c: str):
    return F.unix_micros(c)


def _r(c, places: int = 8):
    return F.round(c, places)


# --- relations ---


_SESSIONS_SQL = "SELECT session_id, epoch_us(started_at) AS started_us, epoch_us(ended_at) AS ended_us, round(dur, 8) AS duration_sec, user_messages, assistant_messages, model, cwd, project, branch AS git_branch, 'cli' AS entrypoint FROM sesd"


def _session_rows(s: DataFrame) -> DataFrame:
    return s.select("session_id", _us("started_at").alias("started_us"), _us("ended_at").alias("ended_us"), _r("duration_sec").alias("duration_sec"), "user_messages", "assistant_messages", "model", "cwd", "project", "git_branch", "entrypoint")


@query(_SESSIONS_SQL)
def logical_sessions(spark, sf_dir):
    return _session_rows(_rel(spark, sf_dir).logical_sessions)


@query("SELECT session_id, 'a' || CAST(event_id AS VARCHAR) AS uuid, 'u' || CAST(prev_id AS VARCHAR) AS parent_uuid, epoch_us(ts) AS ts_us, side AS is_sidechain, model, 'm' || CAST(event_id AS VARCHAR) AS message_id, inp AS input_tokens, outp AS output_tokens, rd AS cache_read_tokens, wr AS cache_creation_tokens, w5 AS cache_creation_5m, w1 AS cache_creation_1h FROM ev")
def message_costs(spark, sf_dir):
    c = _rel(spark, sf_dir).assistant_message_costs
    return c.withColumn("ts_us", _us("timestamp")).drop("timestamp")


@query("SELECT session_id, epoch_us(ts) AS called_us, tool AS tool_name, id AS tool_use_id, CASE event_type WHEN 'view' THEN path WHEN 'purchase' THEN path END AS file_path, CASE event_type WHEN 'click' THEN 'git log -n ' || k WHEN 'error' THEN 'make test && echo ' || k END AS command, CASE WHEN answered THEN bad END AS is_error, CASE WHEN answered THEN 1.0::DOUBLE END AS execution_sec FROM calls")
def tool_calls(spark, sf_dir):
    c = _rel(spark, sf_dir).tool_calls
    return c.select("session_id", _us("called_at").alias("called_us"), "tool_name", "tool_use_id", F.get_json_object("tool_input", "$.file_path").alias("file_path"), F.get_json_object("tool_input", "$.command").alias("command"), "is_error", "execution_sec")


@query("""SELECT session_id, kind, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT session_id, 'agent_tool_call' AS kind FROM calls UNION ALL SELECT session_id, 'agent_text' FROM ev WHERE event_id % 7 = 0
  UNION ALL SELECT session_id, 'tool_result' FROM ev WHERE answered UNION ALL SELECT session_id, 'slash_command' FROM cmds) GROUP BY session_id, kind""")
def message_block_kinds(spark, sf_dir):
    return _rel(spark, sf_dir).message_blocks.groupBy("session_id", "kind").agg(F.count("*").alias("n"))


@query("""SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (
  SELECT CASE WHEN role = 'assistant' THEN 'agent_text' WHEN turn % 5 = 0 THEN 'subagent_prompt' ELSE 'human_prompt' END AS kind, text FROM conversations WHERE role IN ('user', 'assistant')
  UNION ALL SELECT 'agent_thinking', text FROM conversations WHERE role = 'assistant' AND turn % 3 = 0) GROUP BY kind""", cte=False)
def chat_block_kinds(spark, sf_dir):
    rows = chat_log(spark, sf_dir, thinking=True)
    text = F.length(F.coalesce("text", "thinking_text"))
    return Relations(rows).message_blocks.groupBy("kind").agg(F.count("*").alias("n"), F.sum(text.cast("long")).alias("chars"))


@query("""SELECT 'c' || CAST(conv_id AS VARCHAR) AS session_id, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS turn_order, text AS content_text
FROM conversations WHERE role IN ('user', 'assistant')""", cte=False)
def conversation_turns(spark, sf_dir):
    return Relations(chat_log(spark, sf_dir)).conversation_turns.select("session_id", "role", "turn_order", "content_text")


@query("SELECT 'c' || CAST(conv_id AS VARCHAR) AS session_id, arg_min(text, turn) AS first_prompt FROM conversations WHERE role = 'user' GROUP BY conv_id", cte=False)
def session_titles(spark, sf_dir):
    return Relations(chat_log(spark, sf_dir)).session_titles


@query("SELECT session_id, arg_min('<command-name>' || command || '</command-name>', ts) AS first_prompt, arg_min(command, ts) AS title FROM cmds WHERE command <> '/clear' GROUP BY session_id")
def command_titles(spark, sf_dir):
    return _rel(spark, sf_dir).session_titles.withColumn("title", clean_title(F.col("first_prompt")))


@query("SELECT session_id, 'p' || CAST(event_id AS VARCHAR) AS uuid, command FROM cmds")
def message_commands(spark, sf_dir):
    return _rel(spark, sf_dir).message_commands.select("session_id", "uuid", "command")


@query("SELECT session_id, id AS tool_use_id, path AS file_path FROM calls WHERE tool = 'Read'")
def file_reads(spark, sf_dir):
    return _rel(spark, sf_dir).file_reads.select("session_id", "tool_use_id", "file_path")


@query("SELECT session_id, id AS tool_use_id, tool AS tool_name, path AS file_path FROM calls WHERE tool = 'Edit'")
def file_writes(spark, sf_dir):
    return _rel(spark, sf_dir).file_writes.select("session_id", "tool_use_id", "tool_name", "file_path")


@query("SELECT session_id, 'mapped ' || CAST(user_id % 3 AS VARCHAR) AS project FROM (SELECT DISTINCT session_id, user_id FROM ev WHERE user_id % 7 = 2) UNION ALL SELECT DISTINCT session_id, project FROM ev WHERE user_id % 7 <> 2")
def project_mapping(spark, sf_dir):
    names = spark.createDataFrame([(f"/home/u2/proj{i}", f"mapped {i}") for i in range(3)], "cwd string, project_name string")
    return Relations(events_log(spark, sf_dir), names).logical_sessions.select("session_id", "project")


_FILES = """files AS (
  SELECT r.session_id, count(*) AS files_read, count(*) FILTER (WHERE w.path IS NULL) AS files_read_only, count(*) FILTER (WHERE r.path LIKE '/etc%') AS files_outside
  FROM (SELECT DISTINCT session_id, path FROM calls WHERE tool = 'Read') r
  LEFT JOIN (SELECT DISTINCT session_id, path FROM calls WHERE tool = 'Edit') w ON w.session_id = r.session_id AND w.path = r.path GROUP BY r.session_id),
edits AS (SELECT session_id, count(DISTINCT path) AS files_edited FROM calls WHERE tool = 'Edit' GROUP BY session_id)"""


@query(f""", {_FILES}, cl AS (SELECT session_id, string_agg(DISTINCT command, ', ' ORDER BY command) AS commands FROM cmds WHERE command <> '/clear' GROUP BY session_id),
tt AS (SELECT session_id, arg_min('<command-name>' || command || '</command-name>', ts) AS first_prompt FROM cmds WHERE command <> '/clear' GROUP BY session_id),
tc AS (SELECT session_id, count(*) AS n FROM calls GROUP BY session_id)
SELECT s.session_id, s.user_messages, s.assistant_messages, s.model, s.project, CAST(coalesce(tc.n, 0) AS BIGINT) AS tool_count, CAST(coalesce(f.files_read, 0) AS BIGINT) AS files_read, CAST(coalesce(e.files_edited, 0) AS BIGINT) AS files_edited,
  CAST(coalesce(f.files_read_only, 0) AS BIGINT) AS files_read_only, CAST(coalesce(f.files_outside, 0) AS BIGINT) AS files_outside, tt.first_prompt, cl.commands, round(s.cost, 8) AS cost_usd
FROM sesd s LEFT JOIN tc ON tc.session_id = s.session_id LEFT JOIN files f ON f.session_id = s.session_id LEFT JOIN edits e ON e.session_id = s.session_id LEFT JOIN cl ON cl.session_id = s.session_id LEFT JOIN tt ON tt.session_id = s.session_id""")
def session_stats(spark, sf_dir):
    s = _prep(spark, sf_dir).session_stats
    return s.select("session_id", "user_messages", "assistant_messages", "model", "project", "tool_count", "files_read", "files_edited", "files_read_only", "files_outside", "first_prompt", "commands", _r("cost_usd").alias("cost_usd"))


@query("""SELECT session_id, kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(first) AS BIGINT) AS firsts, CAST(sum(tok) AS BIGINT) AS input_tokens, CAST(sum(err) AS BIGINT) AS errors, max(hint) AS hint FROM (
  SELECT session_id, 'agent_tool_call' AS kind, CASE WHEN tool <> 'Task' THEN 1 ELSE 0 END AS first, NULL::BIGINT AS tok, CAST(bad AS INT) AS err,
    CASE event_type WHEN 'view' THEN path WHEN 'purchase' THEN path WHEN 'signup' THEN k WHEN 'click' THEN 'git log -n ' || k WHEN 'error' THEN 'make test && echo ' || k ELSE 'look around' END AS hint FROM calls
  UNION ALL SELECT session_id, 'agent_text', 1, 0, 0, '' FROM ev WHERE event_id % 7 = 0
  UNION ALL SELECT session_id, 'slash_command', 1, NULL, 0, '' FROM cmds) GROUP BY session_id, kind""")
def session_timeline(spark, sf_dir):
    r = _prep(spark, sf_dir)
    t = relations.session_timeline(r.message_blocks, r.tool_calls, r.assistant_message_costs)
    return t.groupBy("session_id", "kind").agg(F.count("*").alias("n"), F.sum(F.col("is_first_block").cast("long")).alias("firsts"), F.sum("input_tokens").alias("input_tokens"), F.sum(F.col("is_error").cast("long")).alias("errors"), F.max("tool_hint").alias("hint"))


@query("SELECT 'c' || CAST(conv_id AS VARCHAR) AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS turn_order, left(text, 500) AS content_text FROM conversations WHERE role IN ('user', 'assistant') AND conv_id = 5", cte=False)
def get_session(spark, sf_dir):
    r = Relations(chat_log(spark, sf_dir))
    return relations.get_session(r.logical_sessions, r.conversation_turns, "c5")[1].select("session_id", "turn_order", "content_text")


# --- counts and listings ---


@query("SELECT session_id, CAST(count(*) AS BIGINT) AS tool_count, CAST(count(*) FILTER (WHERE bad) AS BIGINT) AS failed_count FROM calls GROUP BY session_id")
def tool_counts(spark, sf_dir):
    return metrics.tool_counts(_rel(spark, sf_dir).tool_calls)


@query(f""", {_FILES} SELECT coalesce(f.session_id, e.session_id) AS session_id, CAST(coalesce(files_read, 0) AS BIGINT) AS files_read, CAST(coalesce(files_read_only, 0) AS BIGINT) AS files_read_only, CAST(coalesce(files_outside, 0) AS BIGINT) AS files_outside, CAST(coalesce(files_edited, 0) AS BIGINT) AS files_edited FROM files f FULL JOIN edits e ON e.session_id = f.session_id""")
def file_metrics(spark, sf_dir):
    r = _rel(spark, sf_dir)
    return metrics.file_metrics(r.file_reads, r.file_writes, r.logical_sessions)


@query("SELECT session_id, string_agg(DISTINCT command, ', ' ORDER BY command) AS commands FROM cmds WHERE command <> '/clear' GROUP BY session_id")
def command_list(spark, sf_dir):
    return metrics.command_list(_rel(spark, sf_dir).message_commands)


_BREAKDOWN = "SELECT tool AS tool_name, CAST(count(*) AS BIGINT) AS cnt, round(100.0 * count(*) FILTER (WHERE NOT bad) / count(*), 8) AS success_rate, round(100.0 * count(*) / (SELECT count(*) FROM calls), 8) AS pct_of_total FROM calls WHERE tool {0} LIKE 'mcp__%' GROUP BY tool"


def _breakdown(df: DataFrame) -> DataFrame:
    return df.select("tool_name", "cnt", _r("success_rate").alias("success_rate"), _r("pct_of_total").alias("pct_of_total"))


@query(_BREAKDOWN.format("NOT"))
def tool_breakdown(spark, sf_dir):
    return _breakdown(metrics.tool_breakdown(_rel(spark, sf_dir).tool_calls))


@query(_BREAKDOWN.format(""))
def mcp_breakdown(spark, sf_dir):
    return _breakdown(metrics.tool_breakdown(_rel(spark, sf_dir).tool_calls, mcp=True))


@query("SELECT 'crm' AS server_name, CAST(count(*) AS BIGINT) AS cnt, CAST(1 AS BIGINT) AS command_count, CAST(0 AS BIGINT) AS failed_count FROM calls WHERE event_type = 'signup'")
def server_breakdown(spark, sf_dir):
    return metrics.server_breakdown(_rel(spark, sf_dir).tool_calls)


@query("SELECT 'crm' AS server_name, 'signup' AS command_name, CAST(count(*) AS BIGINT) AS cnt, CAST(0 AS BIGINT) AS failed_count FROM calls WHERE event_type = 'signup'")
def server_commands(spark, sf_dir):
    return metrics.server_commands(_rel(spark, sf_dir).tool_calls, "crm")


@query("SELECT session_id, id AS tool_use_id, project FROM calls WHERE bad AND tool = 'Bash' AND project = 'proj1' AND k LIKE '%7%'")
def search_calls(spark, sf_dir):
    r = _rel(spark, sf_dir)
    found = metrics.search_calls(r.tool_calls, r.logical_sessions, r.session_titles, only_failed=True, name="Bash", project="proj1", text="7")
    return found.select("session_id", "tool_use_id", "project")


@query("SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE bad) AS BIGINT) AS failed_total FROM calls WHERE project = 'proj1'")
def search_call_totals(spark, sf_dir):
    r = _rel(spark, sf_dir)
    return metrics.call_totals(metrics.search_calls(r.tool_calls, r.logical_sessions, r.session_titles, project="proj1"))


@query("SELECT session_id, id AS tool_use_id, epoch_us(ts) AS called_us, bad AS is_error FROM calls WHERE bad AND project = 'proj1' ORDER BY ts DESC, id LIMIT 20 OFFSET 40")
def search_calls_third_page(spark, sf_dir):
    r = _rel(spark, sf_dir)
    page = metrics.newest_calls(metrics.search_calls(r.tool_calls, r.logical_sessions, r.session_titles, only_failed=True, project="proj1"), page=3, page_size=20)
    return page.select("session_id", "tool_use_id", _us("called_at").alias("called_us"), "is_error")


@query("SELECT tool AS tool_name, CAST(count(*) AS BIGINT) AS cnt, round(100.0 * count(*) FILTER (WHERE NOT bad) / count(*), 8) AS success_rate FROM calls GROUP BY tool")
def tool_success(spark, sf_dir):
    return metrics.tool_success(_rel(spark, sf_dir).tool_calls).withColumn("success_rate", _r("success_rate"))


@query("SELECT session_id, id AS tool_use_id, epoch_us(ts) AS called_us FROM calls WHERE bad AND tool LIKE 'Ba%' ORDER BY ts DESC, id LIMIT 20")
def tool_failures(spark, sf_dir):
    return metrics.tool_failures(_rel(spark, sf_dir).tool_calls, "Ba").select("session_id", "tool_use_id", _us("called_at").alias("called_us"))


_SHELL = "(SELECT *, CASE event_type WHEN 'click' THEN 'git log' ELSE 'make test' END AS two, CASE event_type WHEN 'click' THEN 'git' ELSE 'make' END AS one FROM calls WHERE tool = 'Bash')"


@query(f"SELECT two AS prefix, CAST(count(*) AS BIGINT) AS cnt, round(100.0 * count(*) FILTER (WHERE NOT bad) / count(*), 8) AS success_rate FROM {_SHELL} GROUP BY two")
def command_prefixes(spark, sf_dir):
    return metrics.command_prefixes(_rel(spark, sf_dir).tool_calls).withColumn("success_rate", _r("success_rate"))


@query(f"SELECT one AS word, CAST(count(*) AS BIGINT) AS cnt, round(100.0 * count(*) FILTER (WHERE NOT bad) / count(*), 8) AS success_rate FROM {_SHELL} GROUP BY one")
def command_first_word(spark, sf_dir):
    return metrics.command_first_word(_rel(spark, sf_dir).tool_calls).withColumn("success_rate", _r("success_rate"))


@query(f"SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS chained, round(100.0 * count(*) FILTER (WHERE event_type = 'error') / count(*), 8) AS pct_chained FROM {_SHELL}")
def chained_share(spark, sf_dir):
    return metrics.chained_share(_rel(spark, sf_dir).tool_calls).withColumn("pct_chained", _r("pct_chained"))


@query("SELECT session_id, id AS tool_use_id FROM calls WHERE event_type = 'click' AND project = 'proj2'")
def search_commands(spark, sf_dir):
    r = _rel(spark, sf_dir)
    return metrics.search_commands(r.tool_calls, r.logical_sessions, r.session_titles, prefix="git log", project="proj2", text="HIST").select("session_id", "tool_use_id")


@query(f"""SELECT s.*, t.* FROM (SELECT CAST(count(*) AS BIGINT) AS sessions, CAST(count(DISTINCT project) AS BIGINT) AS projects, round(avg(dur), 3) AS avg_duration_sec, CAST(count(*) FILTER (WHERE CAST(started_at AS DATE) = DATE '2024-01-25') AS BIGINT) AS today,
  CAST(count(*) FILTER (WHERE started_at >= date_trunc('week', TIMESTAMP '{AS_OF}')) AS BIGINT) AS this_week FROM sesd) s,
  (SELECT CAST(count(*) AS BIGINT) AS tool_calls, CAST(count(*) FILTER (WHERE bad) AS BIGINT) AS failed_calls, round(100.0 * (1 - count(*) FILTER (WHERE bad) / CAST(count(*) AS DOUBLE)), 1) AS success_rate FROM calls) t""")
def headline(spark, sf_dir):
    r = _rel(spark, sf_dir)
    return metrics.headline(r.logical_sessions, r.tool_calls, AS_OF).withColumn("avg_duration_sec", _r("avg_duration_sec", 3))


@query("""SELECT s.*, t.* FROM (SELECT CAST(count(*) AS BIGINT) AS sessions, epoch_us(min(started_at)) AS earliest_us, CAST(sum(user_messages) AS BIGINT) AS user_messages, CAST(sum(turns) AS BIGINT) AS turns, round(avg(turns), 8) AS avg_turns FROM sesd) s,
  (SELECT CAST(count(*) AS BIGINT) AS tool_calls, CAST(count(*) FILTER (WHERE bad) AS BIGINT) AS failed_calls FROM calls) t""")
def summary(spark, sf_dir):
    r = _rel(spark, sf_dir)
    return metrics.summary(r.logical_sessions, r.tool_calls).withColumn("earliest_us", _us("earliest")).withColumn("avg_turns", _r("avg_turns")).drop("earliest")


@query("""SELECT CAST(CASE WHEN dur < 60 THEN 1 WHEN dur < 300 THEN 2 WHEN dur < 900 THEN 3 WHEN dur < 1800 THEN 4 ELSE 5 END AS INT) AS rank,
  CASE WHEN dur < 60 THEN '< 1 min' WHEN dur < 300 THEN '1-5 min' WHEN dur < 900 THEN '5-15 min' WHEN dur < 1800 THEN '15-30 min' ELSE '30+ min' END AS bucket, CAST(count(*) AS BIGINT) AS cnt FROM (
  SELECT CAST(count(*) - 1 AS DOUBLE) * 60 AS dur FROM conversations WHERE role IN ('user', 'assistant') AND conv_id IS NOT NULL GROUP BY conv_id HAVING min(turn) = 0 AND max(turn) = count(*) - 1
  UNION ALL SELECT CAST(max(turn) - min(turn) AS DOUBLE) * 60 FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id HAVING NOT (min(turn) = 0 AND max(turn) = count(*) - 1)) GROUP BY 1, 2""", cte=False)
def duration_histogram(spark, sf_dir):
    return metrics.duration_histogram(Relations(chat_log(spark, sf_dir)).logical_sessions)


@query("""SELECT CAST(CASE WHEN n <= 2 THEN 1 WHEN n <= 5 THEN 2 WHEN n <= 10 THEN 3 WHEN n <= 20 THEN 4 WHEN n <= 50 THEN 5 WHEN n <= 100 THEN 6 ELSE 7 END AS INT) AS rank,
  CASE WHEN n <= 2 THEN '1-2 turns' WHEN n <= 5 THEN '3-5 turns' WHEN n <= 10 THEN '6-10 turns' WHEN n <= 20 THEN '11-20 turns' WHEN n <= 50 THEN '21-50 turns' WHEN n <= 100 THEN '51-100 turns' ELSE '100+ turns' END AS bucket, CAST(count(*) AS BIGINT) AS cnt
FROM (SELECT count(*) AS n FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id) GROUP BY 1, 2""", cte=False)
def turns_histogram(spark, sf_dir):
    return metrics.turns_histogram(Relations(chat_log(spark, sf_dir)).logical_sessions)


@query("SELECT strftime(CAST(started_at AS DATE), '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS cnt FROM sesd GROUP BY 1 ORDER BY 1 DESC LIMIT 30")
def sessions_per_day(spark, sf_dir):
    return metrics.sessions_per_day(_rel(spark, sf_dir).logical_sessions).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(", tc AS (SELECT session_id, count(*) AS n FROM calls GROUP BY session_id) SELECT s.model, CAST(count(*) AS BIGINT) AS sessions, round(avg(dur), 3) AS avg_duration_sec, round(avg(coalesce(tc.n, 0)), 8) AS avg_tool_calls FROM sesd s LEFT JOIN tc ON tc.session_id = s.session_id GROUP BY s.model")
def model_breakdown(spark, sf_dir):
    r = _rel(spark, sf_dir)
    m = metrics.model_breakdown(r.logical_sessions, metrics.tool_counts(r.tool_calls))
    return m.select("model", "sessions", _r("avg_duration_sec", 3).alias("avg_duration_sec"), _r("avg_tool_calls").alias("avg_tool_calls"))


@query(", n AS (SELECT session_id, tool, count(*) AS c, count(*) FILTER (WHERE bad) AS f FROM calls GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY c DESC, tool) AS p FROM n) SELECT session_id, CAST(sum(c) AS BIGINT) AS tool_count, CAST(sum(f) AS BIGINT) AS failed_count, max(CASE WHEN p = 1 THEN tool END) AS top_tool FROM r GROUP BY session_id")
def session_tool_summary(spark, sf_dir):
    return metrics.session_tool_summary(_rel(spark, sf_dir).tool_calls)


@query("SELECT DISTINCT model AS value FROM ev")
def dimension_values(spark, sf_dir):
    return metrics.dimension_values(_rel(spark, sf_dir).logical_sessions, "model")


@query("SELECT session_id, round(cost, 8) AS cost_usd FROM sesd WHERE project = 'proj1' AND branch = 'dev' AND session_id IN (SELECT session_id FROM cmds WHERE command <> '/clear' AND command LIKE '/cmd1x%') ORDER BY cost DESC, session_id LIMIT 25")
def list_sessions(spark, sf_dir):
    r = _prep(spark, sf_dir)
    commands = r.message_commands.withColumn("command", F.substring("command", 1, 6))
    page = metrics.list_sessions(r.session_stats, "cost", page_size=25, project="proj1", branch="dev", commands=commands, command="/cmd1x")
    return page.select("session_id", _r("cost_usd").alias("cost_usd"))


@query("SELECT session_id, round(dur, 8) AS duration_sec FROM sesd ORDER BY dur DESC, session_id LIMIT 15")
def top_sessions(spark, sf_dir):
    return metrics.top_sessions(_prep(spark, sf_dir).session_stats, "duration_sec").select("session_id", _r("duration_sec").alias("duration_sec"))


@query(f"SELECT 'a' || CAST(event_id AS VARCHAR) AS uuid FROM ev WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL '3 days' UNION ALL SELECT 'a' || CAST(event_id AS VARCHAR) || '-dup' FROM ev WHERE event_id % 7 = 0 AND ts + INTERVAL '500 milliseconds' >= TIMESTAMP '{AS_OF}' - INTERVAL '3 days'")
def retained_messages(spark, sf_dir):
    return within_days(_rel(spark, sf_dir).raw_messages, 3, AS_OF).filter("type = 'assistant'").select("uuid")


# --- cost ---


@query("SELECT session_id, round(sum(cost), 8) AS cost_usd FROM ev GROUP BY session_id")
def session_cost(spark, sf_dir):
    r = _rel(spark, sf_dir)
    return cost.session_cost(r.assistant_message_costs, r.rates).withColumn("cost_usd", _r("cost_usd"))


_BY_MODEL = "SELECT model, CAST(count(*) AS BIGINT) AS messages, CAST(sum(inp) AS BIGINT) AS input_tokens, CAST(sum(outp) AS BIGINT) AS output_tokens, CAST(sum(rd) AS BIGINT) AS cache_read_tokens, CAST(sum(wr) AS BIGINT) AS cache_creation_tokens, CAST(sum(w5) AS BIGINT) AS cache_creation_5m, CAST(sum(w1) AS BIGINT) AS cache_creation_1h, round(sum({0}), 8) AS cost_usd FROM ev GROUP BY model"


@query(_BY_MODEL.format("cost"))
def token_usage(spark, sf_dir):
    r = _rel(spark, sf_dir)
    return cost.token_usage(r.assistant_message_costs, r.rates).withColumn("cost_usd", _r("cost_usd"))


@query(_BY_MODEL.format("cost - CASE WHEN event_id % 3 = 0 THEN wcost ELSE 0 END"))
def token_usage_grouped(spark, sf_dir):
    r = _rel(spark, sf_dir)
    return cost.token_usage(r.assistant_message_costs, r.rates, fallback="group").withColumn("cost_usd", _r("cost_usd"))


@query(_BY_MODEL.format("cost"))
def cost_by_model(spark, sf_dir):
    r = _rel(spark, sf_dir)
    return cost.cost_by_model(r.assistant_message_costs, r.rates).withColumn("cost_usd", _r("cost_usd"))


@query("SELECT model, CAST(count(*) AS BIGINT) AS messages, CAST(sum(inp + outp + rd + wr) AS BIGINT) AS tokens FROM ev WHERE model = 'house-model' GROUP BY model")
def unpriced(spark, sf_dir):
    r = _rel(spark, sf_dir)
    return unpriced_models(r.assistant_message_costs, r.rates)


@query("SELECT strftime(ts, '%Y-%m-%d') AS bucket, model AS grp, round(sum(cost), 8) AS cost_usd FROM ev GROUP BY 1, 2 HAVING sum(cost) > 0")
def cost_by_day_model(spark, sf_dir):
    r = _rel(spark, sf_dir)
    return cost.cost_breakdown(r.assistant_message_costs, r.logical_sessions, r.rates).withColumn("cost_usd", _r("cost_usd"))


@query(f"SELECT strftime(ts, '%H:00') AS bucket, project AS grp, round(sum(cost), 8) AS cost_usd FROM ev WHERE ts >= TIMESTAMP '{DAY[0]}' AND ts < TIMESTAMP '{DAY[1]}' GROUP BY 1, 2 HAVING sum(cost) > 0")
def cost_by_hour_project(spark, sf_dir):
    r = _rel(spark, sf_dir)
    return cost.cost_breakdown(r.assistant_message_costs, r.logical_sessions, r.rates, "hour", "project", DAY).withColumn("cost_usd", _r("cost_usd"))


_TYPES = "SELECT strftime(ts, '%Y-%m-%d') AS bucket, bucket AS grp, sum(wcost) AS cost_usd FROM ev GROUP BY 1, 2"


def _causes(r: Relations) -> DataFrame:
    rows = cost.attributed(r.cost_attribution, r.rates)
    return rows.groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("bucket"), F.col("bucket").alias("grp")).agg(F.sum("write_cost_usd").alias("cost_usd"))


@query(f", d AS ({_TYPES}), t AS (SELECT grp, row_number() OVER (ORDER BY sum(cost_usd) DESC, grp) AS p FROM d GROUP BY grp) SELECT d.bucket, CASE WHEN t.p <= 7 THEN d.grp ELSE 'Other' END AS grp, round(sum(d.cost_usd), 8) AS cost_usd FROM d JOIN t ON t.grp = d.grp GROUP BY 1, 2")
def top_groups_folded(spark, sf_dir):
    return cost.fold_top_groups(_causes(_prep(spark, sf_dir))).withColumn("cost_usd", _r("cost_usd"))


@query(f""", d AS ({_TYPES.replace("bucket AS grp", "prev_tool AS grp").replace("FROM ev", "FROM ev WHERE prev_tool IS NOT NULL")}), t AS (SELECT grp, row_number() OVER (ORDER BY sum(cost_usd) DESC, grp) AS p, sum(sum(cost_usd)) OVER () AS g FROM d GROUP BY grp),
s AS (SELECT d.*, t.p, t.g, coalesce(sum(d.cost_usd) OVER (PARTITION BY d.bucket ORDER BY t.p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS below FROM d JOIN t ON t.grp = d.grp),
f AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY cost_usd DESC, bucket) AS n FROM s WHERE p <= 4)
SELECT grp, bucket, round(cost_usd, 8) AS value, round(below + cost_usd / 2, 9) AS center FROM f WHERE n = 1 AND cost_usd >= 0.001 * g""")
def group_peaks(spark, sf_dir):
    r = _prep(spark, sf_dir)
    msgs = r.assistant_message_costs.withColumn("parent_id", F.regexp_replace("parent_uuid", "^u", "t"))
    named = cost.priced(msgs, r.rates).join(r.tool_calls.select(F.col("tool_use_id").alias("parent_id"), F.col("tool_name").alias("grp")), "parent_id")
    cells = named.groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("bucket"), "grp").agg(F.sum("write_cost_usd").alias("cost_usd"))
    return cost.group_peaks(cells, min_share=0.001).select("grp", "bucket", _r("value").alias("value"), _r("center", 9).alias("center"))


@query("SELECT session_id, 'a' || CAST(event_id AS VARCHAR) AS uuid, bucket, category, agent, round(cost, 8) AS cost_usd, round(wcost, 8) AS write_cost_usd FROM ev")
def cost_attribution(spark, sf_dir):
    r = _prep(spark, sf_dir)
    return cost.attributed(r.cost_attribution, r.rates).select("session_id", "uuid", "bucket", "category", "agent", _r("cost_usd").alias("cost_usd"), _r("write_cost_usd").alias("write_cost_usd"))


@query("""SELECT bucket, category, agent, CAST(sum(wr) AS BIGINT) AS tokens, round(sum(wcost), 8) AS cost_usd, round(max(wcost), 8) AS top_cost_usd, round(100.0 * sum(wr) / (SELECT sum(wr) FROM ev WHERE wr > 0), 8) AS pct FROM ev WHERE wr > 0 GROUP BY bucket, category, agent ORDER BY sum(wcost) DESC, bucket, agent LIMIT 20""")
def context_growth(spark, sf_dir):
    r = _prep(spark, sf_dir)
    return cost.bloat_buckets(r.cost_attribution, r.rates).select("bucket", "category", "agent", "tokens", _r("cost_usd").alias("cost_usd"), _r("top_cost_usd").alias("top_cost_usd"), _r("pct").alias("pct"))


@query("""SELECT coalesce(category, 'Total') AS category, coalesce(agent, 'Total') AS agent, CAST(sum(wr) AS BIGINT) AS tokens, round(sum(wcost), 8) AS cost_usd FROM (
  SELECT category, agent, wr, wcost FROM ev WHERE wr > 0 UNION ALL SELECT c, a, 0, 0 FROM (VALUES ('Read'), ('Created'), ('Conversation')) x(c), (VALUES ('Main'), ('Subagent')) y(a)) GROUP BY CUBE (category, agent)""")
def growth_crosstab(spark, sf_dir):
    r = _prep(spark, sf_dir)
    return cost.bloat_rollup(r.cost_attribution, r.rates).withColumn("cost_usd", _r("cost_usd"))


@query(f", i AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS idx FROM ev WHERE session_id = '{PICK}') SELECT category, agent, CAST(sum(wr) AS BIGINT) AS tokens FROM i WHERE idx BETWEEN 2 AND 9 AND wr > 0 GROUP BY category, agent")
def growth_between(spark, sf_dir):
    r = _prep(spark, sf_dir)
    own = r.cost_attribution.filter(F.col("session_id") == PICK)
    ends = [x["uuid"] for x in cost.message_index(own).filter("idx in (9, 2)").orderBy(F.col("idx").desc()).collect()]
    part = cost.between_messages(own, *ends)
    return cost.attributed(part, r.rates).filter("cache_creation_tokens > 0").groupBy("category", "agent").agg(F.sum("cache_creation_tokens").alias("tokens"))


def _split_sql(flag: str) -> str:
    return f""", fl AS ({flag}), x AS (SELECT s.session_id, s.cost, coalesce(f.flag, false) AS flag FROM sesd s LEFT JOIN fl f ON f.session_id = s.session_id),
g AS (SELECT flag, count(*) AS n, sum(cost) AS c FROM x GROUP BY flag), sides AS (SELECT true AS flag UNION ALL SELECT false)
SELECT sides.flag, CAST(coalesce(n, 0) AS BIGINT) AS sessions, round(coalesce(c, 0), 8) AS cost_usd, round(CASE WHEN n > 0 THEN c / n ELSE 0 END, 8) AS mean_usd, round(coalesce(100.0 * c / (SELECT sum(cost) FROM sesd), 0), 8) AS pct_cost FROM sides LEFT JOIN g ON g.flag = sides.flag"""


def _split(df: DataFrame) -> DataFrame:
    return df.select("flag", "sessions", _r("cost_usd").alias("cost_usd"), _r("mean_usd").alias("mean_usd"), _r("pct_cost").alias("pct_cost"))


@query(_split_sql("SELECT DISTINCT session_id, true AS flag FROM ev WHERE side OR event_id % 50 = 0"))
def split_subagent(spark, sf_dir):
    r = _prep(spark, sf_dir)
    return _split(cost.binary_split(cost.session_cost(r.assistant_message_costs, r.rates), cost.flag_subagent(r.assistant_message_costs, r.tool_calls)))


@query(_split_sql("SELECT e.session_id, sum(wr) >= 100000 AND CASE WHEN max(s.cost) > 0 THEN sum(wcost) / max(s.cost) ELSE 0 END >= 0.10 AS flag FROM ev e JOIN sesd s ON s.session_id = e.session_id WHERE category = 'Read' AND wr <> 0 GROUP BY e.session_id"))
def split_huge_reads(spark, sf_dir):
    r = _prep(spark, sf_dir)
    spent = cost.session_cost(r.assistant_message_costs, r.rates)
    return _split(cost.binary_split(spent, cost.flag_huge_reads(r.cost_attribution, spent, r.rates)))


@query(_split_sql("SELECT DISTINCT session_id, true AS flag FROM cmds WHERE command <> '/clear'"))
def split_skill(spark, sf_dir):
    r = _prep(spark, sf_dir)
    return _split(cost.binary_split(cost.session_cost(r.assistant_message_costs, r.rates), cost.flag_skill(r.message_commands)))


@query(f""", w AS (SELECT * FROM ev WHERE ts >= TIMESTAMP '{DAY[0]}' AND ts < TIMESTAMP '{DAY[1]}'), sc AS (SELECT session_id, sum(cost) AS cost FROM w GROUP BY session_id),
fl AS (SELECT 'subagent' AS split, session_id, true AS flag FROM (SELECT DISTINCT session_id FROM ev WHERE side OR event_id % 50 = 0)
  UNION ALL SELECT 'skill', session_id, true FROM (SELECT DISTINCT session_id FROM cmds WHERE command <> '/clear')
  UNION ALL SELECT 'huge_reads', w.session_id, sum(wr) >= 100000 AND CASE WHEN max(sc.cost) > 0 THEN sum(wcost) / max(sc.cost) ELSE 0 END >= 0.10 FROM w JOIN sc ON sc.session_id = w.session_id WHERE category = 'Read' AND wr <> 0 GROUP BY w.session_id),
cells AS (SELECT split, flag FROM (VALUES ('subagent'), ('skill'), ('huge_reads')) x(split), (VALUES (true), (false)) y(flag)),
x AS (SELECT n.split, sc.cost, coalesce(f.flag, false) AS flag FROM sc CROSS JOIN (SELECT DISTINCT split FROM cells) n LEFT JOIN fl f ON f.split = n.split AND f.session_id = sc.session_id)
SELECT c.split, c.flag, CAST(count(x.cost) AS BIGINT) AS sessions, round(coalesce(sum(x.cost), 0), 8) AS cost_usd FROM cells c LEFT JOIN x ON x.split = c.split AND x.flag = c.flag GROUP BY c.split, c.flag""")
def portfolio_of_day(spark, sf_dir):
    r = _prep(spark, sf_dir)
    p = cost.cost_portfolio(r.assistant_message_costs, r.raw_messages, r.tool_calls, r.message_commands, r.rates, DAY)
    return p.select("split", "flag", "sessions", _r("cost_usd").alias("cost_usd"))


@query(""", p AS (SELECT session_id, cost, sum(cost) OVER () AS g, sum(cost) OVER (ORDER BY cost DESC, session_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM sesd WHERE cost > 0)
SELECT session_id, round(cost, 8) AS cost_usd, round(c, 8) AS cumulative, round(c / g, 6) AS cum_frac, (c - cost) / g < 0.8 - 1e-12 AS in_pareto, (c - cost) / g < 0.8 - 1e-12 AND c / g >= 0.8 - 1e-12 AS is_cutoff FROM p""")
def pareto(spark, sf_dir):
    r = _prep(spark, sf_dir)
    p = cost.pareto(cost.session_cost(r.assistant_message_costs, r.rates))
    return p.select("session_id", _r("cost_usd").alias("cost_usd"), _r("cumulative").alias("cumulative"), _r("cum_frac", 6).alias("cum_frac"), "in_pareto", "is_cutoff")


_INV = """, inv AS (SELECT session_id, ts AS at, 'k' || CAST(event_id AS VARCHAR) AS id, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) - 1 AS inv FROM ev WHERE event_id % 50 = 0),
hit AS (SELECT e.session_id, e.event_id, e.ts, e.cost, max(i.inv) AS inv FROM ev e JOIN inv i ON i.session_id = e.session_id AND i.at <= e.ts WHERE e.side GROUP BY e.session_id, e.event_id, e.ts, e.cost),
per AS (SELECT session_id, inv, sum(cost) AS cost, count(*) AS n, arg_min('a' || CAST(event_id AS VARCHAR), ts) AS first_uuid FROM hit GROUP BY session_id, inv),
rk AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY cost DESC, inv) AS p FROM per)
SELECT session_id, CAST(least(p, 13) AS INT) AS rank, CASE WHEN p <= 12 THEN '#' || CAST(p AS VARCHAR) || ' explorer' ELSE 'Other' END AS label, round(sum(cost), 8) AS cost_usd, CAST(sum(n) AS BIGINT) AS messages, CAST(count(*) AS BIGINT) AS invocations, min(CASE WHEN p <= 12 THEN first_uuid END) AS first_uuid FROM rk GROUP BY 1, 2, 3"""


@query(_INV)
def invocation_costs(spark, sf_dir):
    r = _prep(spark, sf_dir)
    return cost.invocation_costs(r.cost_attribution, r.tool_calls, r.rates).withColumn("cost_usd", _r("cost_usd"))


# --- series ---

_SER = ", ser AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) - 1 AS idx, 'a' || CAST(event_id AS VARCHAR) AS uuid, cost AS inc, sum(cost) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cum, category, agent, count(*) OVER (PARTITION BY session_id) AS n FROM ev)"


def _series(spark, sf_dir) -> DataFrame:
    r = _prep(spark, sf_dir)
    return series.cost_series(r.cost_attribution, r.rates)


@query(_SER + " SELECT session_id, CAST(idx AS INT) AS idx, uuid, agent AS series, round(inc, 8) AS inc_usd, round(sum(inc) OVER (PARTITION BY session_id, agent ORDER BY idx ROWS UNBOUNDED PRECEDING), 8) AS cum_usd FROM ser")
def cumulative_by_agent(spark, sf_dir):
    r = _prep(spark, sf_dir)
    c = series.cumulative_cost(r.cost_attribution, r.rates, "agent")
    return c.select("session_id", "idx", "uuid", "series", _r("inc_usd").alias("inc_usd"), _r("cum_usd").alias("cum_usd"))


@query(_SER + " SELECT session_id, CAST(idx AS INT) AS idx, uuid, category AS series, round(inc, 8) AS inc_usd, round(sum(inc) OVER (PARTITION BY session_id, category ORDER BY idx ROWS UNBOUNDED PRECEDING), 8) AS cum_usd FROM ser")
def cumulative_by_category(spark, sf_dir):
    r = _prep(spark, sf_dir)
    c = series.cumulative_cost(r.cost_attribution, r.rates, "category")
    return c.select("session_id", "idx", "uuid", "series", _r("inc_usd").alias("inc_usd"), _r("cum_usd").alias("cum_usd"))


@query(_SER + """, inv AS (SELECT session_id, ts AS at, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) - 1 AS inv FROM ev WHERE event_id % 50 = 0),
hit AS (SELECT e.event_id, max(i.inv) AS inv FROM ev e JOIN inv i ON i.session_id = e.session_id AND i.at <= e.ts WHERE e.side GROUP BY e.event_id)
SELECT session_id, CAST(idx AS INT) AS idx, uuid, CAST(inv AS VARCHAR) AS series, round(inc, 8) AS inc_usd, round(sum(inc) OVER (PARTITION BY session_id, inv ORDER BY idx ROWS UNBOUNDED PRECEDING), 8) AS cum_usd
FROM ser JOIN hit ON uuid = 'a' || CAST(event_id AS VARCHAR)""")
def cumulative_by_invocation(spark, sf_dir):
    r = _prep(spark, sf_dir)
    c = series.cumulative_cost(r.cost_attribution, r.rates, "invocation", r.tool_calls)
    return c.select("session_id", "idx", "uuid", "series", _r("inc_usd").alias("inc_usd"), _r("cum_usd").alias("cum_usd"))


_DOWN = _SER + ", dn AS (SELECT *, CASE WHEN n > 20 THEN CAST(ceil(n / 12.0) AS INT) ELSE 1 END AS size FROM ser)"


@query(_DOWN + ", pt AS (SELECT session_id, CAST(floor(idx / size) AS INT) AS point, size, count(*) AS messages, arg_min(uuid, idx) AS first_uuid, arg_max(uuid, idx) AS last_uuid, sum(inc) AS inc FROM dn GROUP BY 1, 2, 3) SELECT session_id, point, size, CAST(messages AS BIGINT) AS messages, first_uuid, last_uuid, round(inc, 8) AS inc_usd, round(sum(inc) OVER (PARTITION BY session_id ORDER BY point ROWS UNBOUNDED PRECEDING), 8) AS cum_usd FROM pt")
def downsampled(spark, sf_dir):
    d = series.downsample(_series(spark, sf_dir), raw_limit=20, max_buckets=12)
    return d.select("session_id", "point", "size", "messages", "first_uuid", "last_uuid", _r("inc_usd").alias("inc_usd"), _r("cum_usd").alias("cum_usd"))


_SPIKE = """, md AS (SELECT session_id, median(inc) AS m FROM ser GROUP BY session_id),
sp0 AS (SELECT s.*, row_number() OVER (PARTITION BY s.session_id ORDER BY s.inc DESC, s.idx) AS p FROM ser s JOIN md ON md.session_id = s.session_id WHERE s.n >= 6 AND s.inc >= greatest(0.02, 1.5 * md.m)), sp AS (SELECT * FROM sp0 WHERE p <= 6)"""
_SLOPE = """, dl AS (SELECT *, cum - lag(cum, 5) OVER (PARTITION BY session_id ORDER BY idx) AS d FROM ser),
sd AS (SELECT session_id, stddev_pop(d) AS sd, count(*) AS kk FROM dl WHERE d > 0 GROUP BY session_id),
sl0 AS (SELECT dl.* FROM dl JOIN sd ON sd.session_id = dl.session_id WHERE dl.n >= 10 AND kk >= 2 AND sd.sd > 0 AND dl.d >= greatest(1.5 * sd.sd, 0.02) AND NOT EXISTS (SELECT 1 FROM sp WHERE sp.session_id = dl.session_id AND abs(sp.idx - dl.idx) <= 5)),
sl AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY d DESC, idx) AS p FROM sl0)"""


@query(_SER + _SPIKE + " SELECT session_id, CAST(idx AS INT) AS idx, uuid, round(inc, 8) AS inc_usd FROM sp")
def spikes(spark, sf_dir):
    return series.spikes(_series(spark, sf_dir)).select("session_id", "idx", "uuid", _r("inc_usd").alias("inc_usd"))


@query(_SER + _SPIKE + _SLOPE + " SELECT session_id, CAST(idx AS INT) AS idx, uuid FROM sl WHERE p <= 8")
def slopes(spark, sf_dir):
    s = _series(spark, sf_dir)
    return series.slopes(s, series.spikes(s)).select("session_id", "idx", "uuid")


@query(_DOWN + _SPIKE + ", sz AS (SELECT session_id, max(size) AS size, max(CAST(floor(idx / size) AS INT)) AS last FROM dn GROUP BY session_id) SELECT sp.session_id, sp.uuid, least(CAST(floor(sp.idx / sz.size) AS INT), sz.last) AS point FROM sp JOIN sz ON sz.session_id = sp.session_id")
def placed_markers(spark, sf_dir):
    s = _series(spark, sf_dir)
    return series.place_markers(series.spikes(s), series.downsample(s, raw_limit=20, max_buckets=12)).select("session_id", "uuid", "point")


# --- search ---


def _docs(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("doc"), F.col("text").alias("content_text"))


@query("SELECT role, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations WHERE role IN ('user', 'assistant') AND text <> '' GROUP BY role", cte=False)
def search_corpus(spark, sf_dir):
    c = Relations(chat_log(spark, sf_dir)).search_corpus
    return c.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("content_text")).alias("chars"))


_TERMS = "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents), po AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY 1, 2), dl AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z]+')) AS len FROM documents)"


@query(_TERMS + " SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM po GROUP BY term", cte=False)
def inverted_index(spark, sf_dir):
    return search.build_index(_docs(spark, sf_dir)).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _bm25_sql(having: str, terms: str = "'thering', 'stone', 'keit'") -> str:
    return _TERMS + f""", n AS (SELECT count(*) AS n, avg(len) AS a FROM dl), df AS (SELECT term, count(*) AS df FROM po WHERE term IN ({terms}) GROUP BY term)
SELECT po.doc_id AS doc, round(sum(ln((n.n - df.df + 0.5) / (df.df + 0.5) + 1) * po.tf * 2.2 / (po.tf + 1.2 * (0.25 + 0.75 * dl.len / n.a))), 6) AS score FROM po JOIN df ON df.term = po.term JOIN dl ON dl.doc_id = po.doc_id CROSS JOIN n GROUP BY po.doc_id {having}"""


@query(_bm25_sql(""), cte=False)
def bm25_any(spark, sf_dir):
    return search.bm25(search.build_index(_docs(spark, sf_dir)), "Thering, keit stone").withColumn("score", _r("score", 6))


@query(_bm25_sql("HAVING count(*) = 3", "'the', 'of', 'and'"), cte=False)
def bm25_all(spark, sf_dir):
    return search.bm25(search.build_index(_docs(spark, sf_dir)), "the of and", require_all=True).withColumn("score", _r("score", 6))


_MATCH = "SELECT 'c' || CAST(conv_id AS VARCHAR) AS session_id, text, conv_id, turn, CAST(CAST(contains(lower(text), 'then') AS INT) + CAST(contains(lower(text), 'la') AS INT) AS INT) AS score FROM conversations WHERE role IN ('user', 'assistant')"


@query(f"SELECT session_id, score, CAST(count(*) AS BIGINT) AS n FROM ({_MATCH}) WHERE score > 0 GROUP BY 1, 2", cte=False)
def term_match(spark, sf_dir):
    c = Relations(chat_log(spark, sf_dir)).search_corpus
    return search.term_match(c, "Then LA").groupBy("session_id", "score").agg(F.count("*").alias("n"))


@query(
    f"""WITH m AS (SELECT *, CASE WHEN instr(f, 'then') > 0 AND (instr(f, 'la') = 0 OR instr(f, 'then') < instr(f, 'la')) THEN instr(f, 'then') ELSE instr(f, 'la') END AS pos, length(text) AS n FROM (SELECT *, lower(text) AS f, replace(text, chr(10), ' ') AS flat FROM ({_MATCH})) WHERE score > 0),
w AS (SELECT *, least(n, greatest(0, pos - 1 - 120) + 240) AS e FROM m)
SELECT session_id, turn, (CASE WHEN greatest(0, e - 240) > 0 THEN '…' ELSE '' END) || substr(flat, CAST(greatest(0, e - 240) + 1 AS INT), CAST(e - greatest(0, e - 240) AS INT)) || (CASE WHEN e < n THEN '…' ELSE '' END) AS snippet FROM w""",
    cte=False,
)
def snippets(spark, sf_dir):
    c = Relations(chat_log(spark, sf_dir)).raw_messages.withColumn("content_text", relations._prompt_text()).select("session_id", F.split_part("uuid", F.lit("-"), F.lit(2)).cast("long").alias("turn"), "content_text")
    return search.term_match(c, "then la").select("session_id", "turn", snippet(F.col("content_text"), ["then", "la"]).alias("snippet"))


_FOUND = _MATCH.replace("'then'", "'the'").replace("'la'", "'an'")


@query(f"SELECT session_id, score, epoch_us(TIMESTAMP '2024-01-01 00:00:00') + (conv_id * 3600 + turn * 60) * 1000000 AS ts_us FROM ({_FOUND}) WHERE score = 2 ORDER BY ts_us DESC LIMIT 20", cte=False)
def search_sessions(spark, sf_dir):
    r = Relations(chat_log(spark, sf_dir)).prepared()
    hits = search.search_sessions(r.search_corpus, None, r.logical_sessions, r.session_stats, "the an", require_all=True)
    return hits.select("session_id", "score", _us("timestamp").alias("ts_us"))


@query(f"""SELECT session_id, score, epoch_us(TIMESTAMP '2024-01-01 00:00:00') + (conv_id * 3600 + turn * 60) * 1000000 AS ts_us FROM ({_FOUND.replace("role IN ('user', 'assistant')", "role = 'assistant'")})
WHERE score > 0 AND conv_id * 3600 + turn * 60 >= 86400 ORDER BY score DESC, ts_us DESC LIMIT 30""", cte=False)
def search_with_filters(spark, sf_dir):
    r = Relations(chat_log(spark, sf_dir)).prepared()
    hits = search.search_sessions(r.search_corpus, None, r.logical_sessions, r.session_stats, "the an", limit=30, cwd="/tmp/ch", role="assistant", since="2024-01-02 00:00:00")
    return hits.select("session_id", "score", _us("timestamp").alias("ts_us"))


@query(_bm25_sql(""), cte=False)
def bm25_refreshed_index(spark, sf_dir):
    """All documents in an index that began with other texts in some parts, without others, and with a part that goes later."""
    out = scratch_folder(spark)
    docs = _docs(spark, sf_dir).withColumn("part", F.pmod("doc", F.lit(8)))
    other = F.when(F.col("part") < 3, F.concat(F.coalesce("content_text", F.lit("")), F.lit(" stone keit"))).otherwise(F.col("content_text"))
    stale = docs.select((-1 - F.col("doc")).alias("doc"), F.lit(8).alias("part"), "content_text")
    segments.sync(docs.filter("part < 6").withColumn("content_text", other).unionByName(stale), out)
    for parts in ([0, 6], [1], [2, 7], [8]):
        segments.sync(docs.filter(F.col("part").isin(parts)), out, parts)
    return search.bm25(segments.open_index(spark, out), "Thering, keit stone").withColumn("score", _r("score", 6))


# --- files and streams: the records are written as JSON lines first ---

GLOB = "part-*"


def _files(spark, sf_dir: str, bad: bool = False) -> str:
    """The records as text files below a fresh folder; bad: every thousandth event leaves a broken line too."""
    path = scratch_folder(spark)
    lines = events_log(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value"))
    if bad:
        lines = lines.unionByName(spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_id % 1000 = 0").select(F.concat(F.lit('{"type": broken '), F.col("event_id").cast("string")).alias("value")))
    lines.write.text(path)
    return path


_RECORDS = "SELECT user_id, event_id, 'assistant' AS type FROM ev UNION ALL SELECT user_id, event_id, 'assistant' FROM ev WHERE event_id % 7 = 0 UNION ALL SELECT user_id, event_id, 'user' FROM ev WHERE answered UNION ALL SELECT user_id, event_id, 'user' FROM ev WHERE event_id % 40 = 0"


@query(f"SELECT 's' || CAST(user_id AS VARCHAR) AS session_id, type, CAST(count(*) AS BIGINT) AS n FROM ({_RECORDS}) GROUP BY 1, 2")
def log_scan(spark, sf_dir):
    return raw_messages(read_log(spark, _files(spark, sf_dir, bad=True), glob=GLOB)).groupBy("session_id", "type").agg(F.count("*").alias("n"))


@query("SELECT CAST(count(*) AS BIGINT) AS bad_lines FROM events WHERE event_id % 1000 = 0", cte=False)
def quarantined_lines(spark, sf_dir):
    return quarantine(read_log(spark, _files(spark, sf_dir, bad=True), glob=GLOB)).agg(F.sum("bad_lines").alias("bad_lines"))


@query(f"SELECT type, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS sessions FROM ({_RECORDS}) GROUP BY type")
def raw_scan(spark, sf_dir):
    field = lambda f: F.try_variant_get("rec", f"$.{f}", "string")
    return raw_records(spark, _files(spark, sf_dir), GLOB).groupBy(field("type").alias("type")).agg(F.count("*").alias("n"), F.count_distinct(field("sessionId")).alias("sessions"))


@query("SELECT 'u' || CAST(event_id AS VARCHAR) AS uuid FROM ev WHERE answered AND session_id LIKE 's1%' AND event_id % 40 <> 0 ORDER BY ts DESC LIMIT 20")
def raw_page(spark, sf_dir):
    raw = raw_records(spark, _files(spark, sf_dir), GLOB).filter(~F.try_variant_get("rec", "$.uuid", "string").startswith("p"))
    return browse_raw(raw, "s1", "user").select("uuid")


@query(f"SELECT DISTINCT type FROM ({_RECORDS})")
def raw_record_types(spark, sf_dir):
    return record_types(raw_records(spark, _files(spark, sf_dir), GLOB))


_GROUPS = 8


def _group_files(lines: DataFrame, groups: int, path: str) -> None:
    """(g, value) as one text file for each group right below path; rows go from the shuffle to the file, so that no task sorts a group."""
    lines.repartitionById(groups, F.col("g").cast("int")).select("value").write.mode("append").text(path)


def _grown_files(spark, sf_dir: str, late: bool, path: str) -> None:
    """Records in one file for each group of sessions; late: those of the last group alone, which are added to the others."""
    number = F.regexp_extract("sessionId", "[0-9]+", 0).cast("long") % _GROUPS
    own = number == _GROUPS - 1 if late else number != _GROUPS - 1
    lines = events_log(spark, sf_dir).filter(own).select(number.alias("g"), F.to_json(F.struct(*events_log(spark, sf_dir).columns)).alias("value"))
    _group_files(lines, 1 if late else _GROUPS, path)


@query(f"SELECT 'new' AS change, CAST(count(DISTINCT user_id % {_GROUPS}) AS BIGINT) AS files FROM events WHERE user_id % {_GROUPS} = {_GROUPS - 1} HAVING count(*) > 0", cte=False)
def changed_log_files(spark, sf_dir):
    path = scratch_folder(spark)
    _grown_files(spark, sf_dir, False, path)
    manifest = stored(list_files(spark, path, GLOB).select("file_path", "modified"))
    _grown_files(spark, sf_dir, True, path)
    return changed_files(list_files(spark, path, GLOB), manifest).groupBy("change").agg(F.count("*").alias("files"))


@query("SELECT session_id, epoch_us(started_at) AS started_us, user_messages, assistant_messages, round(cost, 8) AS cost_usd FROM sesd")
def refreshed_sessions(spark, sf_dir):
    path, out = scratch_folder(spark), scratch_folder(spark)
    _grown_files(spark, sf_dir, False, path)
    materialize(spark, path, out, glob=GLOB)
    _grown_files(spark, sf_dir, True, path)
    streams.refresh(spark, path, out)
    return read_build(spark, out)["session_stats"].select("session_id", _us("started_at").alias("started_us"), "user_messages", "assistant_messages", _r("cost_usd").alias("cost_usd"))


@query(f"SELECT session_id, epoch_us(started_at) AS started_us, user_messages, assistant_messages, round(cost, 8) AS cost_usd FROM sesd WHERE CAST(substr(session_id, 2) AS BIGINT) % {_GROUPS} <> 5")
def refreshed_changed_files(spark, sf_dir):
    """A build is refreshed after one group's file grew by its later half, and another's went."""
    path, out = scratch_folder(spark), scratch_folder(spark)
    log = events_log(spark, sf_dir)
    number = F.regexp_extract("sessionId", "[0-9]+", 0).cast("long") % _GROUPS
    lines = log.select(number.alias("g"), (F.crc32("uuid") % 2).alias("late"), F.to_json(F.struct(*log.columns)).alias("value"))
    put = lambda rows: rows.select("g", "value").repartition("g").write.mode("append").partitionBy("g").text(path)
    put(lines.filter("g <> 3 or late = 0"))
    materialize(spark, path, out, glob=GLOB)
    for gone in (3, 5):
        remove_folder(spark, f"{path}/g={gone}")
    put(lines.filter("g = 3"))
    streams.refresh(spark, path, out)
    return read_build(spark, out)["session_stats"].select("session_id", _us("started_at").alias("started_us"), "user_messages", "assistant_messages", _r("cost_usd").alias("cost_usd"))


@query(f"""SELECT g, lines + bad AS lines, bad AS bad_lines, CASE WHEN bad > 0 THEN 'bad lines' ELSE 'read' END AS status FROM
  (SELECT user_id % {_GROUPS} AS g, CAST(count(*) AS BIGINT) AS lines FROM ({_RECORDS}) GROUP BY 1)
  JOIN (SELECT user_id % {_GROUPS} AS g, CAST(count(*) FILTER (WHERE event_id % 1000 = 0) AS BIGINT) AS bad FROM ev GROUP BY 1) USING (g)""")
def census_of_files(spark, sf_dir):
    path, log = scratch_folder(spark), events_log(spark, sf_dir)
    lines = log.select((F.regexp_extract("sessionId", "[0-9]+", 0).cast("long") % _GROUPS).alias("g"), F.to_json(F.struct(*log.columns)).alias("value"))
    broken = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_id % 1000 = 0").select((F.col("user_id") % _GROUPS).alias("g"), F.lit('{"type": broken').alias("value"))
    _group_files(lines.unionByName(broken), _GROUPS, path)
    return file_census(spark, path, GLOB).select(F.regexp_extract("file_path", "part-([0-9]+)", 1).cast("long").alias("g"), "lines", "bad_lines", "status")


@query("SELECT tool AS tool_name, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE bad) AS BIGINT) AS failed FROM calls GROUP BY tool")
def materialized_calls(spark, sf_dir):
    built = materialize(spark, _files(spark, sf_dir), scratch_folder(spark), glob=GLOB)
    return built["tool_calls"].groupBy("tool_name").agg(F.count("*").alias("n"), F.count_if(F.coalesce("is_error", F.lit(False))).alias("failed"))


@query("SELECT project, CAST(count(*) AS BIGINT) AS sessions FROM sesd GROUP BY project ORDER BY project LIMIT 500")
def ad_hoc_sql(spark, sf_dir):
    register_views(spark, events_log(spark, sf_dir), prefix="log_")
    return ad_hoc(spark, "SELECT project, count(*) AS sessions FROM log_logical_sessions GROUP BY project ORDER BY project")


def _drained(stream: DataFrame, spark) -> DataFrame:
    """A stream's appended rows, run until its source is exhausted."""
    out, marks = scratch_folder(spark), scratch_folder(spark)
    stream.writeStream.format("parquet").option("checkpointLocation", marks).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _stream(spark, sf_dir) -> DataFrame:
    return streams.stream_log(spark, _files(spark, sf_dir), max_files=10_000, glob=GLOB)


@query("SELECT model, CAST(count(*) AS BIGINT) AS messages, CAST(sum(inp) AS BIGINT) AS input_tokens FROM ev GROUP BY model")
def streamed_costs(spark, sf_dir):
    return _drained(streams.stream_costs(_stream(spark, sf_dir)), spark).groupBy("model").agg(F.count("*").alias("messages"), F.sum("input_tokens").alias("input_tokens"))


@query("""SELECT epoch_us(date_trunc('day', ts)) AS start_us, model, CAST(count(*) AS BIGINT) AS messages, round(sum(cost), 8) AS cost_usd FROM ev
GROUP BY 1, 2, date_trunc('day', ts) HAVING date_trunc('day', ts) + INTERVAL '1 day' <= (SELECT max(ts + CASE WHEN event_id % 7 = 0 THEN INTERVAL '500 milliseconds' ELSE INTERVAL '0 seconds' END) - INTERVAL '10 minutes' FROM ev)""")
def streamed_cost_windows(spark, sf_dir):
    windows = streams.stream_cost_windows(streams.stream_costs(_stream(spark, sf_dir)), "1 day", delay=None)
    return _drained(windows, spark).select(_us("start").alias("start_us"), "model", "messages", _r("cost_usd").alias("cost_usd"))


@query("""
, rec AS (SELECT session_id, epoch_us(ts) AS t FROM ev UNION ALL SELECT session_id, epoch_us(ts) + 500000 FROM ev WHERE event_id % 7 = 0
  UNION ALL SELECT session_id, epoch_us(ts) + 1000000 FROM ev WHERE answered UNION ALL SELECT session_id, epoch_us(ts) + 250000 FROM ev WHERE event_id % 40 = 0),
m AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY session_id ORDER BY t) <= 21600000000 THEN 0 ELSE 1 END AS head FROM rec),
w AS (SELECT *, sum(head) OVER (PARTITION BY session_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS stretch FROM m)
SELECT session_id, CAST(min(t) AS BIGINT) AS start_us, CAST(max(t) + 21600000000 AS BIGINT) AS end_us, CAST(count(*) AS BIGINT) AS records FROM w GROUP BY session_id, stretch HAVING max(t) + 21600000000 <= (SELECT max(t) FROM rec) - 600000000""")
def streamed_activity(spark, sf_dir):
    closed = _drained(streams.stream_sessions(_stream(spark, sf_dir), "6 hours"), spark)
    return closed.select("session_id", _us("start").alias("start_us"), _us("end").alias("end_us"), "records")


@query("SELECT model, CAST(count(*) AS BIGINT) AS messages, CAST(sum(outp) AS BIGINT) AS output_tokens FROM ev GROUP BY model")
def streamed_upsert(spark, sf_dir):
    out = scratch_folder(spark)
    streams.stream_into(streams.stream_usage(_stream(spark, sf_dir)), out, checkpoint=scratch_folder(spark)).awaitTermination()
    return spark.read.parquet(out).groupBy("model").agg(F.count("*").alias("messages"), F.sum("output_tokens").alias("output_tokens"))


@query(_SESSIONS_SQL)
def streamed_sessions(spark, sf_dir):
    """Ten micro-batches, each with a part of the records of every session; eight of them are merged on the way."""
    path, out, log = scratch_folder(spark), scratch_folder(spark), events_log(spark, sf_dir)
    lines = log.select((F.crc32("uuid") % 10).alias("g"), F.to_json(F.struct(*log.columns)).alias("value"))
    _group_files(lines, 10, path)
    rollup.stream_rollup(streams.stream_log(spark, path, max_files=1, glob=GLOB), out, scratch_folder(spark)).awaitTermination()
    return _session_rows(rollup.read_rollup(spark, out))
