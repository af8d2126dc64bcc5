"""Schemas of the files that come and go."""

from __future__ import annotations

LINKS = "array<struct<target_id: string, link_type: string>>"
CHUNK = f"id string, module string, heading string, level int, object_type string, full_text string, text string, is_heading boolean, module_path string, attributes map<string,string>, outgoing_links {LINKS}, incoming_links {LINKS}"
EDGE = "source string, target string, rel_type string"
MANIFEST = (
    "query string, type string, hop_count int, rel_path array<string>, expected_ids array<string>, source_id string, target_id string, "
    "source_module string, target_module string, is_cross_module boolean, notes string"
)
PARAGRAPH = "id string, text string, title string, is_supporting boolean, mq_query_id string, mq_query_idx int"
RUN = (
    "query string, query_type string, pipeline string, embedder string, reranker string, repeat int, latency_ms long, prompt_tokens long, "
    "completion_tokens long, total_tokens long, cited_ids string, source_ids string, n_sources int, iter_count int, verdict string, intent string, routed_to string, route_reason string, answer string"
)
RUN_KEY = ["pipeline", "embedder", "reranker", "query", "repeat"]
JUDGMENT = "query string, pipeline string, repeat int, judge string, judged_on date, faithful boolean, reason string, tokens long"

#: Link types that are loaded, and those that a walk may use.
LINK_TYPES = ("REFERENCES", "DERIVES_FROM", "SATISFIES", "VERIFIES", "REFINES", "TRACES_TO", "IMPLEMENTS", "TESTS", "ALLOCATES_TO")
WALK_TYPES = ("DERIVES_FROM", "SATISFIES", "REFERENCES", "VERIFIES", "REFINES")
#: Run-log names.
STRATA = ("1-hop", "2-hop", "3+-hop")
PIPELINES = ("vanilla", "agentic", "graphrag", "agentic-graph", "adaptive")
BASE_PIPELINES = PIPELINES[:4]
