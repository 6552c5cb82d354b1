"""Schemas of the node and edge tables, and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Node tables as Spark DDL; JSON columns are strings.
NODES = {
    "MetaType": "id string, namespace string, name string, category string, schema_version bigint, property_schema string, validation_rules string, renderer_hints string, description string",
    "Predicate": "id string, namespace string, name string, category string, directed boolean, transitive boolean, symmetric boolean, allowed_pairs string, schema_version bigint, description string",
    "Element": "id string, kind_id string, category string, canonical_key string, current_version_id string, current_name string, current_status string, current_origin string, current_confidence double, current_order_key string, created_at timestamp, updated_at timestamp",
    "ElementVersion": "id string, element_id string, name string, description string, status string, origin string, confidence double, order_key string, content_hash string, props string, created_at timestamp",
    "SemanticRelation": "id string, predicate_id string, source_id string, target_id string, canonical_key string, current_version_id string, current_status string, current_confidence double",
    "RelationVersion": "id string, relation_id string, description string, status string, origin string, confidence double, order_key string, content_hash string, props string, created_at timestamp",
    "Snapshot": "id string, sequence bigint, kind string, commit_hash string, worktree_id string, schema_version bigint, created_at timestamp, props string",
    "Evidence": "id string, kind string, classification string, claim string, confidence double, path string, start_line bigint, end_line bigint, commit_hash string, content_hash string, tool_name string, tool_version string, rule_id string, props string, observed_at timestamp",
    "SourceArtifact": "id string, kind string, relative_path string, language string, content_hash string, commit_hash string, generated boolean, props string",
    "ToolRun": "id string, tool_name string, tool_version string, started_at timestamp, props string",
    "Artifact": "id string, kind string, path string, content_hash string, props string",
    "AnalysisRun": "id string, kind string, started_at timestamp, props string",
    "Evaluation": "id string, target_evidence_id string, criterion string, passed boolean, evaluator string, evaluated_at timestamp, props string",
    "Diagram": "id string, revision string, selector string, props string, created_at timestamp, updated_at timestamp",
    "ViewMember": "id string, diagram_id string, element_id string, label string, x bigint, y bigint, collapsed boolean, props string, created_at timestamp, updated_at timestamp",
    "ViewEdge": "id string, diagram_id string, source_member_id string, target_member_id string, edge_label string, props string, created_at timestamp, updated_at timestamp",
    "ViewGroup": "id string, diagram_id string, label string, collapsed boolean, props string, created_at timestamp, updated_at timestamp",
}

#: Relationship tables: label -> ((from, to) pairs, extra columns).
RELS = {
    "OF_TYPE": ((("Element", "MetaType"),), ""),
    "RELATION_TYPE": ((("SemanticRelation", "Predicate"),), ""),
    "VERSION_OF": ((("ElementVersion", "Element"),), ""),
    "CURRENT_VERSION": ((("Element", "ElementVersion"),), ""),
    "RELATION_VERSION_OF": ((("RelationVersion", "SemanticRelation"),), ""),
    "CURRENT_RELATION_VERSION": ((("SemanticRelation", "RelationVersion"),), ""),
    "AT_SNAPSHOT": ((("ElementVersion", "Snapshot"), ("RelationVersion", "Snapshot"), ("Evidence", "Snapshot"), ("Artifact", "Snapshot")), ""),
    "PARENT_SNAPSHOT": ((("Snapshot", "Snapshot"),), ""),
    "REL_SOURCE": ((("Element", "SemanticRelation"),), ""),
    "REL_TARGET": ((("SemanticRelation", "Element"),), ""),
    "SEMANTIC_EDGE": ((("Element", "Element"),), "relation_id string, relation_version_id string, predicate_id string, active boolean, order_key string, props string"),
    "SUPPORTED_BY": ((("ElementVersion", "Evidence"), ("RelationVersion", "Evidence"), ("Artifact", "Evidence")), "role string"),
    "CONTRADICTED_BY": ((("ElementVersion", "Evidence"), ("RelationVersion", "Evidence")), "role string"),
    "EXTRACTED_FROM": ((("Evidence", "SourceArtifact"),), ""),
    "PRODUCED_BY": ((("Evidence", "ToolRun"), ("Artifact", "ToolRun")), ""),
    "DERIVED_FROM_EVIDENCE": ((("Evidence", "Evidence"),), ""),
    "GENERATED_FROM": ((("Artifact", "Element"),), ""),
    "GENERATED_FROM_RELATION": ((("Artifact", "SemanticRelation"),), ""),
    "DERIVED_ARTIFACT": ((("Artifact", "Artifact"),), ""),
    "RUN_INPUT_SNAPSHOT": ((("AnalysisRun", "Snapshot"),), ""),
    "RUN_OUTPUT_SNAPSHOT": ((("AnalysisRun", "Snapshot"),), ""),
    "RUN_USED_TOOL": ((("AnalysisRun", "ToolRun"),), ""),
    "RUN_PRODUCED_ARTIFACT": ((("AnalysisRun", "Artifact"),), ""),
    "EVALUATES": ((("Evaluation", "Evidence"),), ""),
    "MEMBER_OF": ((("ViewMember", "Diagram"),), ""),
    "RENDERS": ((("ViewMember", "Element"),), ""),
    "GROUP_CONTAINS": ((("ViewGroup", "ViewMember"),), ""),
}

#: Between the fields of an id, so that ("ab", "c") and ("a", "bc") differ.
SEPARATOR = "\x1f"


def rel_schema(label: str) -> str:
    """DDL of a relationship table: its end points and properties."""
    extra = RELS[label][1]
    return "src_label string, src string, dst_label string, dst string" + (f", {extra}" if extra else "")


def content_id(prefix: str, *fields: Column, length: int = 16) -> Column:
    """A prefixed identifier from the SHA-256 of the fields; nulls count as empty."""
    joined = F.concat_ws(SEPARATOR, *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, length))


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))
