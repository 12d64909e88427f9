"""Overlapping chunks of texts, cut where sentences or words end."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import CHUNKS

CHUNK_SIZE = 10_000
OVERLAP = 0.1
#: Texts that a task has as Python objects at once.
SLICE = 64
_END = re.compile(r"\n\n|[.!?]\s+|\n(?=[A-Z])")


def _cut(text: str, low: int, high: int) -> int:
    """Where to end a chunk between ``low`` and ``high``: after the last sentence end, else after the last blank."""
    end = None
    for end in _END.finditer(text, low, high):
        pass
    if end:
        return end.end()
    blank = text.rfind(" ", low, high)
    return blank + 1 if blank > low else high


def chunk_spans(text: str, size: int = CHUNK_SIZE, overlap: float = OVERLAP) -> list[tuple[int, int]]:
    """Spans of at most ``size`` characters; each begins ``overlap`` of it before the last one's end."""
    if not 0 <= overlap <= 0.5:
        raise ValueError("overlap must lie between 0 and 0.5")
    if len(text) <= size:
        return [(0, len(text))]
    spans, at, back = [], 0, int(size * overlap)
    while True:
        end = at + size
        if end < len(text):
            end = _cut(text, max(at, end - int(size * 0.2)), end)
        else:
            end = len(text)
        spans.append((at, end))
        if end == len(text):
            return spans
        at = max(end - back, at + 1)


def chunked(docs: DataFrame, size: int = CHUNK_SIZE, overlap: float = OVERLAP) -> DataFrame:
    """``CHUNKS`` rows of (doc_id, text); a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), *[pa.int32()] * 4]
        # a batch has thousands of texts: a few at a time are Python's, with their chunks
        for part in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            rows = []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if text is not None:
                    spans = chunk_spans(text, size, overlap)
                    rows += [(doc, text[a:e], a, e, i, len(spans)) for i, (a, e) in enumerate(spans)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "text", "start_char", "end_char", "chunk_index", "total_chunks"])

    return docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, CHUNKS)
