"""Extractions, graphs, communities and review queues from and to files."""

from __future__ import annotations

import os

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import canonical_key
from ..functions.texts import clamped
from ..operators.aggregate import refilled_support
from ..schemas import EDGES, EXTRACTIONS, MENTION, NODES, PROPOSALS, REVIEWS, Graph, empty


def extractions(spark: SparkSession, folder: str) -> DataFrame:
    """All extraction files of a folder; a file that isn't valid is left out."""
    found = spark.read.schema(EXTRACTIONS).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json").json(folder)
    return found.where("document_id is not null")


def save_extractions(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def stale(manifest: DataFrame, model: str, domain: str, chunk_size: int) -> DataFrame:
    """``manifest`` with the first reason for which a document must be extracted again, null where it is fresh."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    size = F.coalesce("chunk_size", F.lit(0))
    missing = blank("model_used") | (blank("domain_name") & (size == 0))
    reason = F.when(missing, "no metadata").when(F.col("model_used") != model, "model changed").when(F.coalesce("domain_name", F.lit("")) != domain, "domain changed").when(size != chunk_size, "chunk size changed")
    return manifest.withColumn("stale_reason", reason)


def graph(spark: SparkSession, path: str) -> Graph:
    """A node-link JSON file; nodes without an id and edges without ends are left out, support is rebuilt from the mentions."""
    node = "id string, entity_type string, name string, confidence double, source_documents array<string>, attributes map<string,string>, context string"
    edge = (
        "source string, target string, relation_type string, relation_id string, canonical_key string, confidence double, evidence string, source_document string, "
        f"support_count int, support_documents array<string>, support_doc_count int, mentions array<{MENTION}>"
    )
    schema = ", ".join([f"nodes array<struct<{_ddl(node)}>>", *(f"{k} array<struct<{_ddl(edge)}>>" for k in ("links", "edges"))])
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    n = raw.select(F.explode("nodes").alias("n")).select("n.*").where("id is not null and id <> ''")
    n = n.select("id", F.coalesce("entity_type", F.lit("UNKNOWN")).alias("entity_type"), F.coalesce("name", "id").alias("name"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
                 F.coalesce("source_documents", F.array().cast("array<string>")).alias("source_documents"), F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"), F.coalesce("context", F.lit("")).alias("context"))
    e = raw.select(F.explode(F.coalesce("links", "edges")).alias("e")).select("e.*").where("source is not null and target is not null")
    key = canonical_key(F.col("source"), F.col("relation_type"), F.col("target"))
    e = e.withColumn("edge_key", F.coalesce(F.when(F.col("canonical_key").isNull(), F.nullif("relation_id", F.lit(""))), F.nullif("canonical_key", F.lit("")), key))
    e = refilled_support(e.withColumn("confidence", clamped(F.col("confidence"))))
    return Graph(n, e.select(*_columns(EDGES, e)))


def _ddl(schema: str) -> str:
    return ", ".join(f"{c.split(' ', 1)[0]}:{c.split(' ', 1)[1]}" for c in schema.split(", "))


def _columns(schema: str, df: DataFrame) -> list[str]:
    return [f.name for f in empty(df.sparkSession, schema).schema]


def tables(spark: SparkSession, folder: str) -> Graph:
    return Graph(spark.read.schema(NODES).parquet(f"{folder}/nodes"), spark.read.schema(EDGES).parquet(f"{folder}/edges"))


def save_tables(g: Graph, folder: str) -> None:
    # keys and ids repeat each other's text, which zstd finds
    g.nodes.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/nodes")
    g.edges.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/edges")


def communities(spark: SparkSession, path: str) -> DataFrame:
    """(entity_id, community) of a JSON object; none where the file is missing."""
    if not os.path.exists(path):
        return empty(spark, "entity_id string, community string")
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return raw.select(F.explode("m").alias("entity_id", "community"))


def _yaml(path: str) -> dict:
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def proposals(spark: SparkSession, path: str) -> DataFrame:
    """Merge proposals of a hand-edited YAML file, with ``seq``; none where it is missing or empty."""
    rows = [(p["canonical_id"], p.get("canonical_name", ""), p.get("entity_type", ""), p.get("status", "DRAFT"), [(m["id"], m.get("name", ""), float(m.get("confidence", 0.0))) for m in p.get("members", [])], p.get("reason", ""), i) for i, p in enumerate(_yaml(path).get("proposals") or [])]
    return spark.createDataFrame(rows, PROPOSALS + ", seq int")


def reviews(spark: SparkSession, path: str) -> DataFrame:
    names = [c.split()[0] for c in REVIEWS.split(", ")]
    rows = [tuple(float(r.get(n, 0)) if n == "confidence" else r.get(n) or ("DRAFT" if n == "status" else "") for n in names) for r in _yaml(path).get("relations") or []]
    return spark.createDataFrame(rows, REVIEWS)


def save_yaml(df: DataFrame, key: str, path: str, **head) -> None:
    """A review queue for people to edit, so of a size for them."""
    rows = [r.asDict(recursive=True) for r in df.drop("seq").toLocalIterator()]
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(head | {key: rows}, f, sort_keys=False, allow_unicode=True)
