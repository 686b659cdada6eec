"""Log records for tests, in the shape of session files."""

import json


def user(uuid, content, ts="2026-01-01T10:00:00Z", session="s1", parent=None, side=False, cwd="/tmp/test", result=None):
    out = {"type": "user", "timestamp": ts, "sessionId": session, "uuid": uuid, "parentUuid": parent, "isSidechain": side, "cwd": cwd, "version": "2.1.0", "entrypoint": "cli", "gitBranch": "main", "message": {"role": "user", "content": content}}
    return out | ({"toolUseResult": result} if result is not None else {})


def assistant(uuid, content, ts="2026-01-01T10:00:01Z", session="s1", parent=None, side=False, mid=None, model="claude-opus-4-7", usage=None, cwd="/tmp/test"):
    message = {"role": "assistant", "model": model, "id": mid or f"m-{uuid}", "content": content}
    return {"type": "assistant", "timestamp": ts, "sessionId": session, "uuid": uuid, "parentUuid": parent, "isSidechain": side, "cwd": cwd, "version": "2.1.0", "entrypoint": "cli", "gitBranch": "main", "requestId": "r", "message": message | ({"usage": usage} if usage else {})}


def tool(id_, name, **given):
    return {"type": "tool_use", "id": id_, "name": name, "input": given}


def result(id_, content="ok", error=False):
    return {"type": "tool_result", "tool_use_id": id_, "content": content, "is_error": error}


def text(t):
    return {"type": "text", "text": t}


def write(folder, records, name="s1.jsonl", extra=()):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in records) + "".join(f"{x}\n" for x in extra))
    return str(folder)


def sample():
    return [
        user("u1", "Please list the files"),
        assistant("a1", [text("Sure"), tool("t1", "Bash", command="ls -la && pwd")], parent="u1", usage={"input_tokens": 100, "output_tokens": 50}),
        user("u2", [result("t1", "a b")], ts="2026-01-01T10:00:03.5Z", parent="a1", result={"stdout": "a b"}),
        assistant("a2", [text("Done")], ts="2026-01-01T10:00:05Z", parent="u2", usage={"input_tokens": 10, "output_tokens": 5}),
    ]
