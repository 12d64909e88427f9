"""Documents as they arrive: extractions appended batch by batch, and graph support kept by event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.extract import extracted
from ..sources.domains import Domain
from ..sources.providers import Provider, Rules


def extract_stream(docs: DataFrame, domain: Domain, folder: str, checkpoint: str, make: Callable[[], Provider] = Rules) -> StreamingQuery:
    """Each micro-batch of ``docs(doc_id, text)`` becomes its own folder of extractions, so a batch run twice replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        extracted(df, domain, make).write.mode("overwrite").json(f"{folder}/batch={number:09d}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def relation_counts(mentions: DataFrame, time: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, relation_type, n, confidence): mentions by window of event time; those later than ``late`` are left out."""
    w = F.window(time, window)
    return mentions.withWatermark(time, late).groupBy(w, "relation_type").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence")).select(F.col("window.start").alias("start"), "relation_type", "n", "confidence")
