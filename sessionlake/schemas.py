"""Fixed schemas of the relational tables and the literal values of their enumerated columns."""

from __future__ import annotations

# Literals of the session model.
PROVIDERS = ("codex", "claude", "opencode", "grok", "hermes", "kimi", "antigravity", "omp", "pi", "prime", "cursor", "devin", "amp")
MESSAGE_ROLES = ("user", "assistant", "reasoning")
SESSION_ROLES = ("user", "assistant", "developer", "system", "tool", "thinking", "unknown")
EVENT_KINDS = ("message", "tool_call", "tool_result", "reasoning", "preamble", "system", "summary", "edit", "snapshot", "lifecycle", "usage", "unknown")
BLOCK_KINDS = ("text", "markdown", "thinking", "image", "file", "json")
EDGE_KINDS = ("next", "parent", "tool_result_for", "forked_from", "subagent_of", "compacted_into", "artifact_of")


#: Columns of each table, as DDL.
TABLES: dict[str, str] = {
    "projects": "project_key string, display_name string, raw_path string",
    "sessions": (
        "session_id string, project_key string, provider string, agent_name string, title string, started_at string, updated_at string, source_path string, source_fingerprint string, host string, "
        "identity_scheme_version int, normalization_version int, model string, model_provider string, assignment_role string, parent_session_id string, message_count bigint, tool_call_count bigint, ingested_at timestamp"
    ),
    "messages": (
        "session_id string, event_id string, seq bigint, role string, text string, ts string, project_key string, content_hash string, execution_context_id string, model string, model_provider string, reasoning_effort string, ingested_at timestamp"
    ),
    "tool_calls": (
        "id string, session_id string, event_id string, seq bigint, tool_name string, status string, input_text string, output_text string, output_bytes bigint, input_hash string, output_hash string, started_at string, "
        "completed_at string, project_key string, provider string, execution_context_id string, model string, model_provider string, reasoning_effort string, ingested_at timestamp"
    ),
    "message_vectors": (
        "vec_rowid bigint, model string, modality string, session_id string, seq bigint, role string, project_key string, provider string, content_hash string, document_hash string, dimensions int, encoding string, vector array<float>, created_at string, updated_at string, ingested_at timestamp"
    ),
    "session_events": "session_id string, id string, sequence bigint, fact_hash string, event_json string",
    "usage_records": "session_id string, id string, order_index bigint, timestamp string, fact_hash string, record_json string",
    "session_edges": "session_id string, id string, order_index bigint, fact_hash string, edge_json string",
    "session_artifacts": "session_id string, id string, order_index bigint, fact_hash string, artifact_json string",
    "execution_contexts": "session_id string, id string, sequence bigint, fact_hash string, context_json string",
    "session_enrichments": "session_id string, namespace string, protocol_version string, schema_version int, producer string, input_hash string, payload_json string, updated_at string",
    "embedding_cache": "model string, content_hash string, dimensions int, text_bytes bigint, encoding string, vector array<float>",
    "queue_jobs": (
        "job_id string, idempotency_key string, kind string, payload_json string, status string, attempts int, max_attempts int, leased_by string, lease_until timestamp, next_run_at timestamp, last_error string, updated_at timestamp"
    ),
    "ingest_runs": "run_id string, provider string, status string, started_at string, completed_at string, seen bigint, written bigint, skipped bigint, failed bigint",
}

#: A block of an event's content.
BLOCK = "struct<id:string,sequence:bigint,kind:string,text:string,markdown:string,thinking:string,metadata:string>"
#: An event of a normalised session.
EVENT = (
    f"struct<id:string,sequence:bigint,timestamp:string,role:string,kind:string,contentText:string,contentBlocks:array<{BLOCK}>,toolCallId:string,parentEventId:string,nativeEventId:string>"
)
