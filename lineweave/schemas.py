"""Schemas of the input tables and documents. Documents are read with these, never with inferred ones."""

from __future__ import annotations

EDIT_EVENT = (
    "repo_path string, file_path string, tool string, confidence string, gen_type string, model string, branch string, session_id string, raw_meta string, "
    "hash_before string, hash_after string, suggested_lines bigint, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_write_tokens bigint, ts_ns bigint, "
    "lines array<struct<start: int, end: int, content_sha: string, content_sha_norm: string>>, removed array<struct<content_sha: string, content_sha_norm: string>>"
)
NOTE = (
    "totals struct<added_lines: bigint, ai_lines: bigint, human_lines: bigint, added: bigint, deleted: bigint, deleted_lines: bigint>, "
    "by_tool map<string, struct<lines: bigint, ai_lines: bigint, accepted_lines: bigint, deleted_lines: bigint>>, "
    "files array<struct<path: string, lines: array<struct<start: int, end: int, type: string, author_type: string, tool: string, model: string, gen_type: string>>>>"
)
WORKING_LOG = "schema string, file string, base_sha string, blob_sha string, updated_ms bigint, lines array<struct<start: int, end: int, author: string, tool: string, model: string, gen_type: string, session: string>>"
DELETION = "file string, content string, author struct<author: string, tool: string, model: string, gen_type: string, session: string>"
TRANSCRIPT = (
    "type string, role string, entrypoint string, timestamp string, content string, "
    "message struct<role: string, model: string, content: string, usage: struct<input_tokens: bigint, output_tokens: bigint, cache_read_input_tokens: bigint, cache_creation_input_tokens: bigint>>"
)
BLOCKS = "array<struct<type: string, text: string>>"
SESSION_LINE = "timestamp string, type string, payload string, model string, usage struct<input_tokens: bigint, output_tokens: bigint>"
USAGE_EVENT = "type string, data struct<model: string, outputTokens: bigint, modelMetrics: map<string, struct<inputTokens: bigint, outputTokens: bigint>>>"
CHAT_DELTA = "kind int, k array<string>, v string"
AGENT_STEP = "step_index int, source string, type string, created_at string, content string, tool_calls array<struct<name: string, args: struct<CommandLine: string, Cwd: string, TargetFile: string, CodeContent: string>>>"
FILE_EVENT = "kind string, repo_path string, path string, old_path string, new_path string, src_path string, dst_path string"
