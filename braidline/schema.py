"""Names of the trace model and the shapes of its tables."""

from __future__ import annotations

# The names that stored traces use.
NODE_TYPES = ("goal", "subgoal", "constraint", "decision", "tool_call", "mcp_call", "observation", "error", "summary", "archive_handle")
CALLS = ("tool_call", "mcp_call")
RESULTS = ("observation", "error")
#: Edge type: (types of its source, types of its target).
EDGE_SIGNATURES = {
    "produces": (CALLS, ("observation",)),
    "failed_with": (CALLS, ("error",)),
    "uses": ((*CALLS, "decision"), (*RESULTS, "summary", "archive_handle")),
    "supports": (("observation", "summary", "constraint"), ("decision",)),
    "blocks": ((*RESULTS, "constraint"), (*CALLS, "decision")),
    "resolves": (("observation", "decision"), ("error",)),
    "supersedes": (("observation",), ("observation",)),
    "compresses": (("summary",), (*RESULTS, "constraint")),
    "retries": (CALLS, CALLS),
    "leads_to": (("decision",), CALLS),
    "provides_input": ((*RESULTS, "summary", "archive_handle"), ("decision",)),
    "retried_by": (CALLS, CALLS),
    "resolved_by": (RESULTS, ("observation", "decision")),
    "superseded_by": (RESULTS, RESULTS),
    "summarized_by": ((*RESULTS, "constraint"), ("summary",)),
}
FORWARD_EDGES = ("provides_input", "retried_by", "resolved_by", "superseded_by", "summarized_by")
#: Edges of older traces and the forward edge that each stands for, with source and target exchanged.
LEGACY_EDGES = {"resolves": "resolved_by", "supersedes": "superseded_by", "compresses": "summarized_by", "retries": "retried_by"}
LIFECYCLE_STATES = ("active", "consumed", "critical_evidence", "unresolved_failure", "resolved_failure", "superseded", "audit_required", "archived", "ephemeral")
NEGATIVE_OUTCOMES = ("negative", "policy_denied", "test_failed")

NODES = "session_id bigint, node_id string, node_type string, content string, step_id bigint, ordinal bigint, token_count bigint, tool_name string, operation_key string, call_id string, semantic_outcome string, side_effect boolean, final boolean, active boolean, raw_ref string"
EDGES = "session_id bigint, source string, target string, edge_type string, confidence double, match_type string"
