"""Column expressions on commands, paths, titles and tool inputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Commands of the client itself, which show no work.
BUILT_IN_COMMANDS = ["/clear", "/compact", "/config", "/cost", "/doctor", "/exit", "/fast", "/help", "/init", "/listen", "/login", "/logout", "/model", "/quit", "/status", "/terminal-setup", "/vim"]
# The input field that says most about a call, by tool.
HINT_KEYS = {
    "Read": ["file_path"],
    "Edit": ["file_path"],
    "MultiEdit": ["file_path"],
    "Write": ["file_path"],
    "NotebookEdit": ["notebook_path"],
    "Bash": ["command"],
    "Glob": ["pattern"],
    "Grep": ["pattern"],
    "WebFetch": ["url"],
    "WebSearch": ["query"],
    "Task": ["description", "subagent_type"],
    "Agent": ["description", "subagent_type"],
    "TaskCreate": ["subject"],
    "TaskUpdate": ["taskId", "status"],
    "Skill": ["skill", "args"],
    "ScheduleWakeup": ["reason"],
}
WRITE_TOOLS = ["Edit", "Write", "MultiEdit", "NotebookEdit"]
# Programs whose second word tells what runs.
DISPATCHERS = ["uv", "git", "npm", "cargo", "make", "pnpm", "yarn", "poetry", "uvx", "pipx"]
HINT_CHARS, BASH_CHARS, SNIPPET_CHARS = 120, 32, 240


def last_segment(path: Column) -> Column:
    """Last path segment without trailing slashes."""
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)


def basename(path: Column) -> Column:
    """POSIX name of a path; "(unknown)" for none, the path itself if it has no name."""
    name = last_segment(path)
    return F.when(path.isNull() | (path == ""), "(unknown)").when(name == "", path).otherwise(name)


def escape_like(text: str) -> str:
    """The text as a literal inside a LIKE pattern."""
    return "".join("\\" + c if c in "\\%_" else c for c in text)


def clean_title(raw: Column) -> Column:
    """A title without tags: command messages dropped, other tags as spaces, white space squeezed."""
    bare = F.regexp_replace(F.regexp_replace(raw, r"(?s)<command-message>.*?</command-message>", ""), r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def single_line(value: Column, limit: int = HINT_CHARS) -> Column:
    line = F.trim(F.regexp_replace(value, r"\s+", " "))
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(F.substring(line, 1, limit - 1), F.lit("…")))


def tool_hint(tool: Column, raw: Column) -> Column:
    """One line about a call's input: the tool's own key, else the first value that is not empty."""
    fields = F.from_json(raw, "map<string,string>")
    filled = lambda v: F.when(v.isNotNull() & (v != ""), v)
    preferred = F.coalesce(*[F.when(tool == name, F.coalesce(*[filled(F.get_json_object(raw, f"$.{k}")) for k in keys])) for name, keys in HINT_KEYS.items()])
    first = F.get(F.filter(F.map_values(fields), lambda v: v.isNotNull() & (v != "")), 0)
    return F.when(raw.isNull() | (raw == ""), "").when(F.ltrim(raw).startswith("{"), F.coalesce(single_line(F.coalesce(preferred, first)), F.lit(""))).otherwise(single_line(raw))


def command_of(raw: Column) -> Column:
    return F.trim(F.get_json_object(raw, "$.command"))


def first_word(command: Column) -> Column:
    """First word between single spaces."""
    return F.split_part(command, F.lit(" "), F.lit(1))


def first_two_words(command: Column) -> Column:
    return F.trim(F.concat_ws(" ", F.split_part(command, F.lit(" "), F.lit(1)), F.split_part(command, F.lit(" "), F.lit(2))))


def _bash_head(raw: Column) -> Column:
    words = F.filter(F.split(F.coalesce(F.get_json_object(raw, "$.command"), F.lit("")), r"\s+"), lambda w: w != "")
    head = F.get(words, 0)
    two = F.when(head.isin(DISPATCHERS) & (F.size(words) > 1), F.concat_ws(" ", head, F.get(words, 1))).otherwise(head)
    return F.when(F.size(words) == 0, "(empty)").otherwise(F.substring(two, 1, BASH_CHARS))


def _not_empty(value: Column) -> Column:
    return F.when(value != "", value)


def bucket_expr(tool: Column, raw: Column, block_type: Column) -> Column:
    """What made a context grow, in words, from the tool (if any) or the kind of the parent's block."""
    written = F.coalesce(_not_empty(F.get_json_object(raw, "$.file_path")), _not_empty(F.get_json_object(raw, "$.notebook_path")))
    by_tool = (
        F.when(tool == "Read", F.concat(F.lit("file read: "), basename(F.get_json_object(raw, "$.file_path"))))
        .when(tool.isin("Grep", "Glob"), F.lower(tool))
        .when(tool.isin("WebFetch", "WebSearch"), tool)
        .when(tool == "Bash", F.concat(F.lit("bash: "), _bash_head(raw)))
        .when(tool.isin(WRITE_TOOLS), F.concat(F.lit("file write: "), basename(written)))
        .when(tool.startswith("mcp__"), F.concat(F.lit("mcp: "), F.substring(tool, 6, 1 << 20)))
        .otherwise(F.concat(F.lit("tool: "), tool))
    )
    by_block = F.when(block_type == "tool_result", "tool result (unknown)").when(block_type.isNull() | (block_type == "text"), "human input").otherwise("agent context")
    return F.when(F.coalesce(tool, F.lit("")) != "", by_tool).otherwise(by_block)


def category_expr(tool: Column, block_type: Column) -> Column:
    """Read, Created or Conversation."""
    named = F.coalesce(tool, F.lit("")) != ""
    return F.when(named & tool.isin(WRITE_TOOLS), "Created").when(named | (block_type == "tool_result"), "Read").otherwise("Conversation")


def snippet(text: Column, terms: list[str], width: int = SNIPPET_CHARS) -> Column:
    """About `width` characters around the earliest term, on one line, with … on cut sides; the head if no term occurs."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\n\r", "  ")
    hits = F.filter(F.array(*[F.instr(F.lower(flat), t) for t in terms]), lambda p: p > 0) if terms else F.array().cast("array<int>")
    at, n = F.array_min(hits) - 1, F.length(flat)
    end = F.least(n, F.greatest(F.lit(0), at - width // 2) + width)
    start = F.greatest(F.lit(0), end - width)
    core = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(flat, start + 1, end - start), F.when(end < n, "…").otherwise(""))
    return F.when(at.isNull(), F.substring(flat, 1, width)).otherwise(core)
