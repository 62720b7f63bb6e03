"""Schemas of the canonical tables and the fixed vocabularies they use."""

from __future__ import annotations

from pyspark.sql import types as T

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"

#: Column definitions of every canonical table, as DDL.
TABLES: dict[str, str] = {
    "papers": "paper_id string, canonical_title string, normalized_title string, doi string,"
    " paper_type string, created_at timestamp",
    "assets": "asset_id string, kind string, sha256 string, storage_key string,"
    " size_bytes bigint, retention_class string",
    "paper_versions": "paper_version_id string, paper_id string, version_label string,"
    " asset_id string, page_count int, publication_date timestamp, content_sha256 string,"
    " created_at timestamp",
    "evidence": "evidence_id string, paper_version_id string, evidence_type string,"
    f" page_start int, page_end int, bbox {BOX}, section_id string, text string,"
    " asset_id string, source_method string, ocr_confidence double, quality_state string,"
    " content_sha256 string, extraction_run_id string, supersedes_evidence_id string",
    "sections": "section_id string, paper_version_id string, parent_section_id string,"
    " ordinal int, original_heading string, normalized_class string, page_start int, page_end int",
    "analysis_runs": "run_id string, paper_id string, paper_version_id string,"
    " collection_id string, agent_type string, config_hash string, model_id string,"
    " provider_id string, status string, started_at timestamp, finished_at timestamp,"
    " trace_id string",
    "claims": "claim_id string, paper_id string, paper_version_id string, claim_type string,"
    " category string, statement string, normalized_statement string, support_state string,"
    " analysis_confidence double, system_confidence_components map<string,double>,"
    " created_by_run_id string, created_at timestamp, superseded_by_claim_id string",
    "claim_evidence": "claim_id string, evidence_id string, role string",
    "external_provenances": "provenance_id string, claim_id string, source_provider string,"
    " source_identifier string, source_url string, retrieved_at timestamp, content_hash string,"
    " citation_text string",
    "verifications": "verification_id string, claim_id string, verifier_type string,"
    " verdict string, reason_summary string, details map<string,string>,"
    " created_by_run_id string, created_at timestamp",
    "model_calls": "model_call_id string, provider_id string, model_id string, run_id string,"
    " trace_id string, transport_status string, schema_status string, latency_ms double,"
    " input_tokens bigint, output_tokens bigint, created_at timestamp",
    "jobs": "job_id string, state string, stage string, tier string, priority int,"
    " created_at timestamp",
    "tasks": "task_id string, job_id string, task_type string, stage string, state string,"
    " attempt int, max_attempts int, idempotency_key string, next_retry_at timestamp,"
    " created_at timestamp, started_at timestamp, finished_at timestamp",
    "trace_events": "event_id string, trace_id string, occurred_at timestamp, kind string,"
    " level string, message string, data map<string,string>",
    "search_documents": "document_id string, document_type string, paper_id string,"
    " paper_version_id string, section_id string, evidence_type string, claim_type string,"
    " category string, support_state string, page_start int, content string, index_text string,"
    " content_sha256 string,"
    " embedding array<float>, embedding_model_id string",
    "entities": "entity_id string, entity_type string, canonical_name string,"
    " normalized_name string, aliases array<string>",
    "relations": "relation_id string, source_entity_id string, relation_type string,"
    " target_entity_id string, paper_id string, evidence_ids array<string>, confidence double",
    "tags": "tag_id string, namespace string, canonical_name string, normalized_name string",
    "tag_aliases": "tag_id string, namespace string, normalized_alias string",
    "paper_tags": "paper_id string, tag_id string, is_candidate boolean",
    "collections": "collection_id string, name string",
    "collection_papers": "collection_id string, paper_id string, pinned boolean,"
    " priority_override_tier string, note string, added_at timestamp",
    "triage_results": "triage_id string, paper_id string, recommended_tier string,"
    " effective_tier string, manual_override boolean, signals map<string,double>,"
    " reason_codes array<string>, created_at timestamp",
    "evidence_locators": "evidence_id string, page_number int,"
    f" rect_norm {BOX}, precision string, reason string",
    "notes": "note_id string, owner_id string, paper_id string, paper_version_id string,"
    " body string, updated_at timestamp",
    "review_decisions": "decision_id string, claim_id string, decision string,"
    " created_at timestamp",
    "import_items": "item_id string, batch_id string, sha256 string, size_bytes bigint,"
    " state string, error_code string",
    "provider_events": "event_id string, provider string, model string, kind string,"
    " occurred timestamp, status string, success boolean, latency_ms double, canary_state string,"
    " circuit_breaker_state string",
}

#: Shape of one extraction report.
REPORT = (
    "run_id string, paper_version_id string, page_count int, quality_state string,"
    " warnings array<string>,"
    " pages array<struct<page_number:int, mode:string, width_pt:double, height_pt:double,"
    " warnings:array<string>,"
    f" units:array<struct<unit_type:string, page_number:int, ordinal:int, bbox:{BOX},"
    " text:string, source_method:string, ocr_confidence:double, asset_sha256:string,"
    " content_sha256:string, flags:array<string>>>>>"
)


def schema_of(name: str) -> T.StructType:
    """The declared schema of a canonical table."""
    return T.StructType.fromDDL(TABLES[name])


# Vocabularies below must equal the ones stored data uses.

STAGES = (
    "IMPORTED",
    "FINGERPRINTED",
    "METADATA_RESOLVED",
    "PDF_INSPECTED",
    "EXTRACTED",
    "STRUCTURED",
    "EVIDENCE_INDEXED",
    "TRIAGED",
    "ANALYZED",
    "VERIFIED",
    "SYNTHESIZED",
    "LINKED",
    "SEARCH_INDEXED",
    "CORPUS_READY",
)

TASK_TRANSITIONS = {
    "PENDING": ("QUEUED", "CANCELLED", "SKIPPED"),
    "QUEUED": ("RUNNING", "CANCELLED"),
    "RUNNING": (
        "SUCCEEDED",
        "SUCCEEDED_WITH_WARNINGS",
        "RETRYING",
        "WAITING",
        "BLOCKED",
        "FAILED",
        "CANCELLED",
    ),
    "WAITING": ("QUEUED", "FAILED", "CANCELLED"),
    "RETRYING": ("QUEUED", "FAILED"),
    "BLOCKED": ("QUEUED", "FAILED", "CANCELLED"),
}
TERMINAL_STATES = ("SUCCEEDED", "SUCCEEDED_WITH_WARNINGS", "FAILED", "CANCELLED", "SKIPPED")

TIERS = ("T0_INDEX", "T1_SCAN", "T2_FULL", "T3_DEEP")

#: Stages each tier runs, claim limit and context limit.
_INGEST = (
    "IMPORTED",
    "FINGERPRINTED",
    "PDF_INSPECTED",
    "EXTRACTED",
    "STRUCTURED",
    "EVIDENCE_INDEXED",
    "SEARCH_INDEXED",
)
_SCAN = (*_INGEST, "TRIAGED", "ANALYZED")
_FULL = (*_SCAN, "METADATA_RESOLVED", "VERIFIED", "SYNTHESIZED", "LINKED")
TIER_STAGES = {"T0_INDEX": _INGEST, "T1_SCAN": _SCAN, "T2_FULL": _FULL, "T3_DEEP": STAGES}
TIER_MAX_CLAIMS = {"T0_INDEX": 0, "T1_SCAN": 20, "T2_FULL": 60, "T3_DEEP": 120}
TIER_CONTEXT_UNITS = {"T0_INDEX": 0, "T1_SCAN": 30, "T2_FULL": 60, "T3_DEEP": 120}
SCAN_AGENTS = (
    "agents.structural",
    "agents.research_question",
    "agents.contribution",
    "agents.method",
    "agents.result",
    "agents.reliability",
)

VERIFIERS = (
    "verification.evidence_existence",
    "verification.citation",
    "verification.numeric",
    "verification.claim_scope",
    "verification.contradiction",
    "verification.independent_consensus",
    "verification.falsification",
    "verification.ocr_sensitivity",
    "verification.external_novelty",
)
#: How many of VERIFIERS (from the front) each tier runs.
TIER_VERIFIER_COUNT = {"T0_INDEX": 1, "T1_SCAN": 1, "T2_FULL": 4, "T3_DEEP": 9}
DISPUTE_VERIFIERS = ("verification.contradiction", "verification.independent_consensus")

REVIEW_GROUPS = {
    "verification.numeric": "NUMERIC_OR_OCR",
    "verification.ocr_sensitivity": "NUMERIC_OR_OCR",
    "verification.evidence_existence": "EVIDENCE_UNSUPPORTED",
    "verification.citation": "EVIDENCE_UNSUPPORTED",
    "verification.contradiction": "CONTRADICTION",
    "verification.falsification": "CONTRADICTION",
    "verification.claim_scope": "SCOPE",
    "verification.external_novelty": "NOVELTY_UNVERIFIED",
    "verification.independent_consensus": "EVIDENCE_UNSUPPORTED",
}
RISKY_STATES = ("DISPUTED", "UNSUPPORTED", "PARTIALLY_SUPPORTED", "INSUFFICIENT_EVIDENCE")

TOPIC_NAMESPACES = ("domain", "task", "modality", "application", "method")
TAG_NAMESPACES = (
    "domain",
    "task",
    "modality",
    "method",
    "architecture",
    "training",
    "inference",
    "dataset",
    "metric",
    "experimental-trick",
    "hardware",
    "efficiency",
    "novelty",
    "reliability-risk",
    "venue",
    "author",
    "affiliation",
    "application",
    "project",
)

#: Claim category prefix to entity type, first match wins.
CATEGORY_ENTITY = (
    ("method.", "METHOD"),
    ("experiment.dataset", "DATASET"),
    ("experiment.metric", "METRIC"),
    ("technique.", "TECHNIQUE"),
    ("people.author", "AUTHOR"),
    ("people.affiliation", "AFFILIATION"),
    ("contribution.", "METHOD"),
    ("research.question", "TASK"),
)
#: Claim category prefix to relation type, first match wins, else RELATED_TO.
CATEGORY_RELATION = (
    ("method.", "USES_METHOD"),
    ("technique.", "USES_METHOD"),
    ("experiment.dataset", "USES_DATASET"),
    ("experiment.metric", "REPORTS_METRIC"),
    ("people.", "AUTHORED_BY"),
    ("critique.", "CONTRADICTS"),
)

TEXT_UNIT_TYPES = ("PARAGRAPH", "HEADING", "CAPTION", "REFERENCE", "EQUATION")

STOP_WORDS = [
    "that",
    "this",
    "with",
    "from",
    "have",
    "been",
    "were",
    "which",
    "their",
    "there",
    "than",
    "then",
    "them",
    "into",
    "such",
    "some",
    "more",
    "most",
    "over",
    "under",
    "about",
    "after",
    "before",
    "between",
    "during",
    "through",
    "against",
    "without",
    "within",
    "also",
    "both",
    "each",
    "other",
    "because",
    "while",
    "where",
    "these",
    "those",
    "very",
    "just",
    "only",
    "using",
    "used",
    "based",
]

GENERIC_CLAIM_TOKENS = [
    "reaches",
    "reach",
    "reached",
    "accuracy",
    "accuracies",
    "performance",
    "result",
    "results",
    "method",
    "methods",
    "achieves",
    "achieve",
    "achieved",
    "improves",
    "improve",
    "improved",
    "improvement",
    "better",
    "higher",
    "lower",
    "using",
    "used",
    "based",
    "show",
    "shows",
    "shown",
    "report",
    "reports",
    "reported",
    "significant",
    "significantly",
    "substantial",
    "substantially",
    "average",
    "overall",
    "score",
    "scores",
    "value",
    "values",
    "metric",
    "metrics",
    "evaluation",
    "evaluate",
    "test",
    "tests",
    "training",
    "trained",
    "model",
    "models",
    "data",
]
