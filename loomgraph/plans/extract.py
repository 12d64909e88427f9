"""Documents to extractions: chunks, a provider's answers, one row for each document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.chunks import CHUNK_SIZE, chunked
from ..operators.aggregate import deduplicated_mentions, in_order
from ..schemas import ENTITY, RELATION
from ..sources.domains import Domain
from ..sources.providers import Provider, Rules, extraction_prompt, read_answer

#: Chunks that a task has as Python objects at once.
SLICE = 32
_FOUND = f"doc_id string, chunk_index int, total_chunks int, entities array<{ENTITY}>, relations array<{RELATION}>, failed boolean"


def found_in_chunks(chunks: DataFrame, domain: Domain, make: Callable[[], Provider] = Rules) -> DataFrame:
    """What the provider finds in each chunk; a chunk on which it fails has nothing. ``make`` runs in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        for b in batches:
            # a batch has thousands of chunks: a few at a time are Python's, with what is found in them
            for part in (b.slice(at, SLICE) for at in range(0, b.num_rows, SLICE)):
                rows = []
                for doc, text, i, n in zip(*(c.to_pylist() for c in part.columns)):
                    try:
                        entities, relations = read_answer(provider.answer(extraction_prompt(text, domain)))
                        failed = False
                    except Exception:  # noqa: BLE001 - one chunk must not end the job
                        entities, relations, failed = [], [], True
                    rows.append({"doc_id": doc, "chunk_index": i, "total_chunks": n, "entities": [_entity(e) for e in entities], "relations": [_relation(r) for r in relations], "failed": failed})
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    kinds = to_arrow_schema(StructType.fromDDL(_FOUND))
    return chunks.select("doc_id", "text", "chunk_index", "total_chunks").mapInArrow(run, _FOUND)


def _entity(e: tuple) -> dict:
    return dict(zip(("name", "entity_type", "attributes", "confidence", "context"), e))


def _relation(r: tuple) -> dict:
    return dict(zip(("relation_type", "source_entity", "target_entity", "confidence", "evidence"), r))


def extracted(docs: DataFrame, domain: Domain, make: Callable[[], Provider] = Rules, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """``EXTRACTIONS`` of (doc_id, text, path): entities of one document united by type and name, relations as found.

    The provider's answers may differ from run to run, so write the result before more than one use of it.
    """
    found = found_in_chunks(chunked(docs, chunk_size), domain, make)
    e = found.select(F.col("doc_id").alias("document_id"), "chunk_index", F.posexplode("entities").alias("i", "e")).select("document_id", (F.col("chunk_index").cast("long") * 1_000_000 + F.col("i")).alias("seq"), "e.*")
    entities = deduplicated_mentions(e).groupBy("document_id").agg(in_order(F.col("seq"), F.struct("name", "entity_type", "attributes", "confidence", "context").cast(ENTITY)).alias("entities"))
    by = found.groupBy(F.col("doc_id").alias("document_id")).agg(F.first("total_chunks").alias("chunks_processed"), F.flatten(in_order(F.col("chunk_index"), F.col("relations"))).alias("relations"), F.bool_and("failed").alias("all_failed"))
    path = F.col("path") if "path" in docs.columns else F.lit("")
    meta = docs.select(F.col("doc_id").cast("string").alias("document_id"), path.alias("document_path"))
    out = meta.join(by, "document_id", "left").join(entities, "document_id", "left")
    model = make().model
    return out.select(
        "document_id", "document_path", F.coalesce("chunks_processed", F.lit(0)).alias("chunks_processed"), F.coalesce("entities", F.array().cast(f"array<{ENTITY}>")).alias("entities"),
        F.coalesce("relations", F.array().cast(f"array<{RELATION}>")).alias("relations"), F.lit(0.0).alias("cost_usd"), F.lit(model).alias("model_used"), F.when(F.col("all_failed"), "no chunk could be read").alias("error"),
        F.lit(domain.name).alias("domain_name"), F.lit(chunk_size).alias("chunk_size"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("extracted_at"),
    )
