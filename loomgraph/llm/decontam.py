"""Benchmark passages in documents: SimHash of item-sized windows, then exact weighted-shingle similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import without
from .textkit import U64, HashTable, Words, ragged, slices, text_column

SHINGLE = 2
RADIUS = 26
SIMILARITY = 0.5
#: Bytes of benchmark text up to which its index is built once and sent to every task; a larger benchmark goes in parts.
PART_BYTES = 16_000_000

#: Shingles whose votes a task holds at a time, beside those of one window.
VOTES = 32_768

_BITS = np.arange(64, dtype=U64)


def weighted_shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash and weight of each shingle, shingles per document); a shingle weighs the bytes of its words."""
    h, per = words.shingles(k)
    size = words.end - words.start
    total = np.concatenate(([0], np.cumsum(size), np.full(k, size.sum())))
    place = np.repeat(words.first, per) + ragged(per)
    span = np.repeat(np.minimum(words.count, k), per)
    return h, total[place + span] - total[place], per


def _signed(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Cumulative weighted votes of shingles for each of 64 bits."""
    votes = np.zeros((len(h) + 1, 64), np.int32)
    np.cumsum((((h[:, None] >> _BITS) & U64(1)).astype(np.int32) * 2 - 1) * w[:, None].astype(np.int32), axis=0, out=votes[1:])
    return votes


def _pack(votes: np.ndarray) -> np.ndarray:
    return ((votes > 0).astype(U64) << _BITS).sum(1, dtype=U64)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def similarity(h: np.ndarray, w: np.ndarray, other: dict[int, int]) -> float:
    """Weighted Jaccard of a window's shingles, each occurrence adding its weight, and an item's."""
    own: dict[int, int] = {}
    for x, y in zip(h.tolist(), w.tolist()):
        own[x] = own.get(x, 0) + y
    both = sum(min(y, other[x]) for x, y in own.items() if x in other)
    return both / (sum(own.values()) + sum(other.values()) - both)


class Benchmark:
    """Items by size in words, with fingerprints, multi-index blocks and shingle weights."""

    def __init__(self, ids: list[int], texts: list[str | None], k: int = SHINGLE, radius: int = RADIUS) -> None:
        self.k, self.radius = k, radius
        words = Words([t or "" for t in texts])
        h, weight, per = weighted_shingles(words, k)
        at = np.cumsum(per) - per
        self.items = []
        for i, (a, n) in enumerate(zip(at.tolist(), per.tolist())):
            if not n:
                continue
            hh, w = h[a : a + n], weight[a : a + n]
            bag: dict[int, int] = {}
            for x, y in zip(hh.tolist(), w.tolist()):
                bag[x] = bag.get(x, 0) + y
            self.items.append((ids[i], int(words.count[i]), int(_pack(_signed(hh, w)[-1:])[0]), bag))
        self.sizes = sorted({s for _, s, _, _ in self.items})
        self.by_size = {s: [j for j, it in enumerate(self.items) if it[1] == s] for s in self.sizes}
        # Split into radius + 1 blocks, two fingerprints within the radius agree on one block at least.
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = [(U64(a), U64((1 << int(b - a)) - 1)) for a, b in zip(edges[:-1], edges[1:])]
        self.index: dict[int, list[dict[int, list[int]]]] = {}
        for s, members in self.by_size.items():
            tables: list[dict[int, list[int]]] = []
            for shift, mask in self.blocks:
                table: dict[int, list[int]] = {}
                for j in members:
                    table.setdefault(self.items[j][2] >> int(shift) & int(mask), []).append(j)
                tables.append(table)
            self.index[s] = tables
        owners: dict[int, set[int]] = {}
        for it in self.items:
            for x in it[3]:
                owners.setdefault(x, set()).add(it[1])
        self.owner_sizes = [np.array(sorted(v)) for v in owners.values()]
        self.shingles = HashTable(np.array(list(owners), U64), np.arange(len(owners))) if owners else None

    def find(self, texts: list[str], least: float) -> list[tuple[int, int, float]]:
        """(row, item, best similarity) of every pair with a window of at least ``least``.

        What a window shares with an item of its size weighs no more than those of its shingles that any item of
        that size has; where this is under ``least`` of the window it can't pass, and no fingerprint is made.
        """
        if self.shingles is None:
            return []
        words = Words(texts)
        h, w, per = weighted_shingles(words, self.k)
        value = self.shingles.get(h)
        hits = np.flatnonzero(value >= 0)
        if not len(hits):
            return []
        doc_end = np.cumsum(per)
        doc_at = doc_end - per
        total = np.concatenate(([0], np.cumsum(w)))
        counts = np.fromiter(map(len, self.owner_sizes), np.int64, len(self.owner_sizes))[value[hits]]
        place = np.repeat(hits, counts)
        size = np.concatenate([self.owner_sizes[v] for v in value[hits].tolist()])
        order = np.argsort(size, kind="stable")
        place, size = place[order], size[order]
        best: dict[tuple[int, int], float] = {}
        for s in self.sizes:
            p = place[np.searchsorted(size, s) : np.searchsorted(size, s, side="right")]
            if not len(p):
                continue
            width = max(s - self.k + 1, 1)
            shared = np.zeros(len(h) + 1, np.int64)
            shared[p + 1] = w[p]
            np.cumsum(shared, out=shared)
            # every window that holds a hit, and the whole of documents shorter than the item
            p = np.unique(p)
            marks = np.zeros(len(h) + 1, np.int32)
            marks[p + 1] -= 1
            marks += np.bincount(np.maximum(p - width + 1, 0), minlength=len(h) + 1).astype(np.int32)
            starts = np.flatnonzero(np.cumsum(marks[:-1]))
            row = np.searchsorted(doc_end, starts, side="right")
            starts = starts[starts + width <= doc_end[row]]
            short = np.unique(np.searchsorted(doc_end, p, side="right"))
            short = short[words.count[short] < s]
            starts = np.concatenate((starts, doc_at[short]))
            ends = np.concatenate((starts[: len(starts) - len(short)] + width, doc_end[short]))
            pass_ = shared[ends] - shared[starts] >= least * (total[ends] - total[starts])
            starts, ends = starts[pass_], ends[pass_]
            if len(starts):
                self._candidates(s, starts, ends, np.searchsorted(doc_end, starts, side="right"), h, w, least, best)
        return [(row, item, sim) for (row, item), sim in best.items()]

    def _candidates(self, s, starts, ends, rows, h, w, least, best) -> None:
        prints = np.empty(len(starts), U64)
        order = np.argsort(starts, kind="stable")
        starts, ends, rows = starts[order], ends[order], rows[order]
        # votes are held for one row at a time, and for so many of its shingles
        edge = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (starts[1:] // VOTES != starts[:-1] // VOTES))))
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(rows)]):
            low, high = starts[a], ends[a:b].max()
            votes = _signed(h[low:high], w[low:high])
            prints[a:b] = _pack(votes[ends[a:b] - low] - votes[starts[a:b] - low])
        found: dict[int, np.ndarray] = {}
        for (shift, mask), table in zip(self.blocks, self.index[s]):
            part = (prints >> shift) & mask
            for key, members in table.items():
                same = part == U64(key)
                if same.any():
                    for j in members:
                        found[j] = found[j] | same if j in found else same
        for j, candidate in found.items():
            item, _, fingerprint, bag = self.items[j]
            near = np.flatnonzero(candidate)
            near = near[popcount(prints[near] ^ U64(fingerprint)) <= self.radius]
            for c in near.tolist():
                sim = similarity(h[starts[c] : ends[c]], w[starts[c] : ends[c]], bag)
                if sim >= least and sim > best.get((int(rows[c]), item), -1.0):
                    best[int(rows[c]), item] = sim


def _find(benchmark: Benchmark, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            out = [(ids[first + row], item, sim) for first, texts in slices(text_column(b)) for row, item, sim in benchmark.find(texts, least)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "item_id", "similarity"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, similarity) of every document with a window like a benchmark item.

    Windows are as many words as the item (the whole of a shorter document), at every place. A window is
    a candidate where its 64-bit SimHash over weighted word pairs lies within ``radius`` bits of the
    item's, found by ``radius + 1`` blocks of which one must agree, and passes where the exact weighted
    Jaccard of the word pairs, a pair weighing its bytes, is ``least`` or more. The best window counts.

    Reads doc_id, text, item_id alone. Null ids are left out; null texts and texts without words match nothing; rows of
    one doc_id give one row, as do rows of one item_id; empty tables on either side give no rows.
    A benchmark above ``PART_BYTES`` is indexed in parts, each sent to the tasks and run over the documents in turn.
    """
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text")).where("item_id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // PART_BYTES))
    source = docs.select(F.col("doc_id").cast("long"), F.col("text")).where("doc_id is not null")
    found = None
    for p in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p).collect()
        index = Benchmark([r.item_id for r in rows], [r.text for r in rows], radius=radius)
        part = source.mapInArrow(_find(index, least), "doc_id long, item_id long, similarity double")
        found = part if found is None else found.union(part)
    return found.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """``docs`` without those in which ``contaminated`` finds an item; rows without a doc_id stay."""
    return without(docs, contaminated(docs, benchmark, **kw).select("doc_id").distinct())


def op5_decontam(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
