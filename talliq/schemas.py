"""Schemas of transcript lines, status payloads and ledger tables."""

from __future__ import annotations

#: A transcript line. Text fields are variants, so that a wrong type can be told from text; unknown fields are ignored.
LINE = """
type VARIANT, sessionId VARIANT, cwd VARIANT, timestamp VARIANT, isSidechain BOOLEAN,
message STRUCT<id: VARIANT, model: VARIANT, usage: STRUCT<
  input_tokens: BIGINT, output_tokens: BIGINT, cache_creation_input_tokens: BIGINT, cache_read_input_tokens: BIGINT,
  output_tokens_details: STRUCT<thinking_tokens: BIGINT>,
  cache_creation: STRUCT<ephemeral_1h_input_tokens: BIGINT, ephemeral_5m_input_tokens: BIGINT>,
  speed: VARIANT, inference_geo: VARIANT>>,
totalCostUSD DOUBLE,
modelUsage MAP<STRING, STRUCT<inputTokens: BIGINT, outputTokens: BIGINT, thinkingTokens: BIGINT,
  cacheReadInputTokens: BIGINT, cacheCreationInputTokens: BIGINT>>,
_corrupt STRING
"""
LINE_TEXTS = ("type", "sessionId", "cwd", "timestamp", "message.id", "message.model", "message.usage.speed", "message.usage.inference_geo")

#: A status payload; counts that can't be negative are checked after decoding.
PAYLOAD = """
session_id VARIANT, transcript_path VARIANT, cwd VARIANT,
model STRUCT<id: VARIANT, display_name: VARIANT>, workspace STRUCT<current_dir: VARIANT, project_dir: VARIANT>,
cost STRUCT<total_cost_usd: DOUBLE, total_lines_added: BIGINT, total_lines_removed: BIGINT>,
context_window STRUCT<context_window_size: BIGINT, used_percentage: DOUBLE>, effort STRUCT<level: VARIANT>,
rate_limits STRUCT<five_hour: STRUCT<used_percentage: DOUBLE, resets_at: BIGINT>, seven_day: STRUCT<used_percentage: DOUBLE, resets_at: BIGINT>>,
_corrupt STRING
"""
PAYLOAD_TEXTS = ("session_id", "transcript_path", "cwd", "model.id", "model.display_name", "workspace.current_dir", "workspace.project_dir", "effort.level")
PAYLOAD_COUNTS = ("cost.total_lines_added", "cost.total_lines_removed", "context_window.context_window_size")

#: Raw lines as the sources give them: where a line starts and ends, and the file's identity. too_long: a line beyond
#: the limit, without its text.
RAW = "path STRING, offset BIGINT, end BIGINT, line STRING, too_long BOOLEAN, file_id BIGINT, head_hash BIGINT"

TOKENS = ("input", "output", "cache_create", "cache_read", "thinking", "cache_1h", "cache_5m")
#: Parsed lines with usage, in the order in which they arrived: batch, then path, then byte offset.
USAGE = (
    "batch_id BIGINT, path STRING, offset BIGINT, dedupe_key STRING, session_id STRING, project_dir STRING, model STRING, ts BIGINT, "
    + ", ".join(f"{t} BIGINT" for t in TOKENS)
    + ", source STRING, speed STRING, inference_geo STRING"
)
REQUESTS = USAGE
SESSIONS = "session_id STRING, project_dir STRING, first_seen BIGINT, last_seen BIGINT, batch_id BIGINT, path STRING, offset BIGINT"
COST_STATE = (
    "session_id STRING, cost_usd DOUBLE, input BIGINT, output BIGINT, thinking BIGINT, cache_read BIGINT, cache_create BIGINT, "
    "models STRING, captured_at BIGINT, batch_id BIGINT, path STRING, offset BIGINT"
)
LIMITS = "ts BIGINT, five_hour_pct DOUBLE, five_hour_resets_at BIGINT, seven_day_pct DOUBLE, seven_day_resets_at BIGINT, batch_id BIGINT"
CURSORS = "path STRING, byte_offset BIGINT, file_id BIGINT, head_hash BIGINT, last_seen BIGINT, batch_id BIGINT"
#: Paths that usage came from, each with a number that follows from it.
PATHS = "id BIGINT, path STRING"
TABLES = {"usage": USAGE, "sessions": SESSIONS, "cost_state": COST_STATE, "limits": LIMITS, "cursors": CURSORS, "paths": PATHS}
#: Columns of usage that older stores lack, and what stands for them.
ADDED = {"thinking": "0", "cache_1h": "0", "cache_5m": "0", "source": "'main'", "speed": "NULL", "inference_geo": "NULL", "path": "NULL"}


def names(schema: str) -> list[str]:
    """Columns of a table."""
    return [part.strip().split(" ")[0] for part in schema.split(",")]
