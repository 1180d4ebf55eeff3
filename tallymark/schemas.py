"""Fixed schemas of the data model. Types are stated, never inferred."""

from __future__ import annotations

VERDICT = (
    "policy_breach boolean, reason string, risk_score int, decision string, rules array<string>, "
    "judge_provider string, judge_model string, graded_by string, evaluator_unavailable_reason string"
)
LEDGER = (
    "org_id string, seq long, event_id string, client_id string, client_seq long, event_type string, event_metadata string, "
    "occurred_at timestamp, chain_version int, prompt_hash string, response_hash string, token_count int, policy_tag string, "
    "agent string, pii_signals array<string>, commitment_alg string, prev_hash string, chain_hash string, local_verdict string, "
    "verdict_hash string, gemini_verdict string, grading_status string, graded_at timestamp, created_at timestamp"
)
#: The verdict's column name in exports is part of the wire format.
EXPORT_ROW = (
    "seq long, event_id string, client_id string, client_seq long, event_type string, commitment_alg string, event_metadata string, "
    "chain_version int, occurred_at string, created_at string, policy_tag string, agent string, token_count int, prompt_hash string, "
    "response_hash string, pii_signals array<string>, prev_hash string, chain_hash string, verdict_hash string, local_verdict string, "
    "gemini_verdict string, grading_status string, graded_at string"
)
EXPORT_COLUMNS = [f.split()[0] for f in EXPORT_ROW.split(", ")]
PAGE = "from_seq long, to_seq long, prev_chain_hash string, complete boolean, next_after_seq long"
ANCHOR = "chain string, status string, root_hash string, last_seq long"
USAGE_DAILY = "org_id string, day date, logs_count long, tokens_sum long, breach_count long, graded_count long, failed_count long, pending_count long"
TRAFFIC = "site string, path string, method string, status_code int, latency_ms int, org_id string, visitor_id string, session_id string, created_at timestamp"
SIDECAR = "event_id string, prompt string, response string, salt string"
GENESIS = "0" * 64
