"""Quality rules: boosted trees over document statistics, scored from flat node arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import without, written
from .textkit import U64, Words, slices, text_column

#: The most labelled rows that training reads; a larger table is cut to the least hashes of doc_id.
MAX_LABELLED = 20_000
WORD_BYTES = 4
#: A word is listed where at least this share of the toxic rows has it, and of the rows that have it this share is toxic.
LEXICON_SUPPORT = 0.01
LEXICON_RATE = 0.75

STATISTICS = [
    "log_bytes", "letters", "upper", "digits", "blank", "symbols", "punctuation", "exclamation", "bars", "non_ascii",
    "log_words", "word_bytes", "distinct_words", "log_lines", "log_line_bytes", "lexicon_share", "log_lexicon",
]
#: +1: the score may only rise with the statistic, -1: only fall.
MONOTONE = {"quality": {"symbols": -1, "bars": -1, "exclamation": -1}, "toxic": {"lexicon_share": 1, "log_lexicon": 1}}

_CLASS = np.full(256, 5, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[48:58] = 3
_CLASS[65:91] = 2
_CLASS[97:123] = 1
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 6
_CLASS[ord("!")] = 7
_CLASS[ord("|")] = 8
_CLASS[128:] = 9


def word_keys(words: Words) -> np.ndarray:
    """Key of each word by its hash; words under ``WORD_BYTES`` don't count (-1)."""
    return np.where(words.end - words.start >= WORD_BYTES, (words.hash >> U64(1)).astype(np.int64), -1)


def statistics(texts: list[str], lexicon: np.ndarray) -> np.ndarray:
    """(texts, statistics) of one slice; shares of an empty text are 0."""
    docs = [t.encode("utf-8", "surrogatepass") for t in texts]
    n = len(docs)
    size = np.fromiter(map(len, docs), np.int64, n)
    buf = np.frombuffer(b"".join(docs), np.uint8)
    doc = np.repeat(np.arange(n, dtype=np.int32), size)
    by = np.bincount(doc * np.int32(10) + _CLASS[buf], minlength=10 * n).reshape(n, 10).astype(float)
    lines = np.bincount(doc[buf == 10], minlength=n) + 1.0
    words = Words(texts)
    owner = np.repeat(np.arange(n), words.count)
    key = np.sort((owner.astype(U64) << U64(40)) | (words.hash >> U64(24)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[new] >> U64(40)).astype(np.int64), minlength=n)
    word_bytes = np.bincount(owner, weights=words.end - words.start, minlength=n)
    bins = word_keys(words)
    listed = np.isin(bins, lexicon) if len(lexicon) else np.zeros(len(bins), bool)
    hits = np.bincount(owner[listed], minlength=n)
    total, count = np.maximum(size, 1), np.maximum(words.count, 1)
    letters = by[:, 1] + by[:, 2]
    return np.stack([
        np.log1p(size), letters / total, by[:, 2] / np.maximum(letters, 1), by[:, 3] / total, by[:, 4] / total, by[:, 5] / total, by[:, 6] / total, by[:, 7] / total, by[:, 8] / total, by[:, 9] / total,
        np.log1p(words.count), word_bytes / count, distinct / count, np.log(lines), np.log1p(size / lines), hits / count, np.log1p(hits),
    ], 1)


@dataclass
class Trees:
    """Boosted trees laid end to end: node i tests ``feature[i] <= threshold[i]``; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        out = np.full(len(x), self.bias)
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Newton boosting of the log loss on quantile bins.

    A split on a constrained feature must order its children's values, and passes their middle on as a
    bound to both, so that no deeper leaf can undo the order.
    """
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    margin = np.full(len(y), bias)
    nodes: list[list] = []
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)

        def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
            me = len(nodes)
            G, H = g[rows].sum(), h[rows].sum()
            nodes.append([0, np.inf, me, me, float(np.clip(G / (H + ridge), low, high)) * rate])
            if level == depth or len(rows) < 2:
                margin[rows] += nodes[me][4]
                return me
            best, pick = 1e-6, None
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                c = code[rows, f]
                gl = np.cumsum(np.bincount(c, g[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(c, h[rows], len(e) + 1))[:-1]
                vl, vr = np.clip(gl / (hl + ridge), low, high), np.clip((G - gl) / (H - hl + ridge), low, high)
                gain = gl**2 / (hl + ridge) + (G - gl) ** 2 / (H - hl + ridge) - G**2 / (H + ridge)
                gain[(hl < least) | (H - hl < least) | (monotone[f] * (vr - vl) < 0)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, pick = gain[k], (f, k, vl[k], vr[k])
            if pick is None:
                margin[rows] += nodes[me][4]
                return me
            f, k, vl, vr = pick
            middle = (vl + vr) / 2
            a, b = ((low, middle), (middle, high)) if monotone[f] > 0 else ((middle, high), (low, middle)) if monotone[f] < 0 else ((low, high), (low, high))
            goes = code[rows, f] <= k
            nodes[me][:2] = [f, float(edges[f][k])]
            nodes[me][2] = grow(rows[goes], level + 1, *a)
            nodes[me][3] = grow(rows[~goes], level + 1, *b)
            return me

        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
    columns = list(zip(*nodes))
    return Trees(np.array(columns[0], np.int32), np.array(columns[1]), np.array(columns[2], np.int32), np.array(columns[3], np.int32), np.array(columns[4]), np.array(roots, np.int32), depth, bias)


@dataclass
class Rules:
    """Trees for either label, None where the labels hold one class only, and the lexicon they rest on."""

    quality: Trees | None
    toxic: Trees | None
    lexicon: np.ndarray

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        x = statistics(texts, self.lexicon)
        return (self.quality.probability(x) if self.quality else np.ones(len(x))), (self.toxic.probability(x) if self.toxic else np.zeros(len(x)))


def _bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        toxic = b.column(1).to_numpy(zero_copy_only=False)
        for first, run in slices(text_column(b)):
            words = Words(run)
            bins = word_keys(words)
            owner = np.repeat(np.arange(len(run)), words.count)
            keys = np.unique(np.stack((owner[bins >= 0], bins[bins >= 0]), 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 1]), pa.array(toxic[first + keys[:, 0]].astype(np.int64))], ["bin", "toxic"])


def _measure(lexicon: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in slices(text_column(b)):
                x = statistics(texts, lexicon)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), b.column(1).slice(first, len(texts)), lists], ["quality", "toxic", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Rules:
    """Rules from the labelled rows among ``docs``, at most ``most`` of them, taken by the hash of doc_id.

    Labels with a null, and those whose document is not there or has a null text, don't count.
    """
    pick = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).dropna().dropDuplicates(["doc_id"])
    pick = pick.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).where("text is not null")
    known = written(texts.join(pick, "doc_id").select("quality", "toxic", "text", "doc_id"), "labelled")
    toxic = known.where("toxic = 1").count()
    odd = known.select("text", "toxic").mapInArrow(_bins, "bin long, toxic long")
    lexicon = odd.groupBy("bin").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).where((F.col("t") >= max(3.0, LEXICON_SUPPORT * toxic)) & (F.col("t") >= LEXICON_RATE * F.col("n")))
    lexicon = np.sort(np.array([r.bin for r in lexicon.select("bin").collect()], np.int64))
    rows = known.select("quality", "toxic", "text").orderBy("doc_id").mapInArrow(_measure(lexicon), "quality int, toxic int, x array<double>").toPandas()
    if not len(rows):
        return Rules(None, None, lexicon)
    x = np.array(rows["x"].tolist()).reshape(len(rows), len(STATISTICS))
    heads = {}
    for name in ("quality", "toxic"):
        y = rows[name].to_numpy().astype(float)
        sign = np.array([MONOTONE[name].get(s, 0) for s in STATISTICS])
        heads[name] = fit(x, y, sign) if 0 < y.sum() < len(y) else None
    return Rules(heads["quality"], heads["toxic"], lexicon)


def _apply(rules: Rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in slices(text_column(b)):
                q, t = rules.score(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), pa.array(q), pa.array(t)], ["doc_id", "quality", "toxic"])

    return run


def scored(docs: DataFrame, rules: Rules) -> DataFrame:
    """(doc_id, quality, toxic): probabilities for every row; a null text scores as an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(_apply(rules), "doc_id long, quality double, toxic double")


def kept(docs: DataFrame, labels: DataFrame, least: float = 0.5, most_toxic: float = 0.5) -> DataFrame:
    """(doc_id, quality, toxic) of the documents the rules keep: quality ``least`` or more and toxic under ``most_toxic``.

    The trees are trained on at most ``MAX_LABELLED`` labelled rows; every row of ``docs`` is scored.
    Without labels of both classes a head rejects nothing. Repeated rows are scored alike and all returned, as are rows
    with a null doc_id; other columns are not read; an empty table gives no rows.
    """
    return scored(docs, train(docs, labels)).where((F.col("quality") >= least) & (F.col("toxic") < most_toxic))


def filtered(docs: DataFrame, labels: DataFrame, train_on: DataFrame | None = None, **kw) -> DataFrame:
    """``docs`` without those the rules reject; rows without a doc_id stay.

    Training may read another table of documents than the one it filters.
    """
    rules = train(docs if train_on is None else train_on, labels)
    limit, toxic = kw.get("least", 0.5), kw.get("most_toxic", 0.5)
    bad = scored(docs.where("doc_id is not null"), rules).where(~((F.col("quality") >= limit) & (F.col("toxic") < toxic))).select("doc_id").distinct()
    return without(docs, bad)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    return kept(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
