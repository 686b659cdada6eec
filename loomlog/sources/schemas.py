"""Fixed schemas: an explicit schema reads any log alike, whichever fields its records happen to carry."""

LOG_FIELDS = """type string, timestamp string, sessionId string, uuid string, parentUuid string,
isSidechain boolean, cwd string, version string, entrypoint string, gitBranch string, requestId string,
message struct<role:string, id:string, model:string,
  usage:struct<input_tokens:bigint, output_tokens:bigint, cache_read_input_tokens:bigint,
    cache_creation_input_tokens:bigint,
    cache_creation:struct<ephemeral_5m_input_tokens:bigint, ephemeral_1h_input_tokens:bigint>>,
  content:variant>,
toolUseResult variant"""

#: What a JSON scan reads; a line that does not parse is kept in _corrupt.
READ_SCHEMA = f"{LOG_FIELDS}, _corrupt string"

COST_COLUMNS = ["session_id", "uuid", "parent_uuid", "timestamp", "is_sidechain", "model", "message_id", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "cache_creation_5m", "cache_creation_1h"]
