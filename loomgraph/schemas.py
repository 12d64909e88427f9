"""Schemas of the tables that stages hand over, and the graph they make."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

MENTION = "struct<source_document:string,confidence:double,evidence:string,relation_id:string>"
ENTITY = "struct<name:string,entity_type:string,attributes:map<string,string>,confidence:double,context:string>"
RELATION = "struct<relation_type:string,source_entity:string,target_entity:string,confidence:double,evidence:string>"
NODES = "id string, entity_type string, name string, confidence double, source_documents array<string>, attributes map<string,string>, context string"
EDGES = (
    "edge_key string, source string, target string, relation_type string, relation_id string, canonical_key string, confidence double, "
    f"evidence string, source_document string, support_count int, support_documents array<string>, support_doc_count int, mentions array<{MENTION}>"
)
EXTRACTIONS = (
    f"document_id string, document_path string, chunks_processed int, entities array<{ENTITY}>, relations array<{RELATION}>, "
    "cost_usd double, model_used string, error string, domain_name string, chunk_size int, extracted_at string"
)
PROPOSALS = "canonical_id string, canonical_name string, entity_type string, status string, members array<struct<id:string,name:string,confidence:double>>, reason string"
REVIEWS = "source_id string, source_name string, target_id string, target_name string, relation_type string, confidence double, evidence string, source_document string, status string, flag_reason string"
CHUNKS = "doc_id string, text string, start_char int, end_char int, chunk_index int, total_chunks int"

DOCUMENT = "DOCUMENT"
MENTIONED_IN = "MENTIONED_IN"
FALLBACK_RELATION = "ASSOCIATED_WITH"


@dataclass(frozen=True)
class Graph:
    """Nodes and directed, keyed edges; operators return a new one."""

    nodes: DataFrame
    edges: DataFrame

    def with_(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> Graph:
        return replace(self, nodes=self.nodes if nodes is None else nodes, edges=self.edges if edges is None else edges)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
