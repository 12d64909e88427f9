"""Near-duplicate groups by a signature-coordinate inverted join with prefix and skip merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import without, written
from .textkit import U64, Words, give_back, mix, slices, text_column

COORDINATES = 128
MATCHES = 70
SHINGLE = 3
#: Documents of a posting list that one task compares; a longer list is cut into such blocks, and each two blocks are a list of their own.
BLOCK = 4_096


def _family(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 64, k, U64), rng.integers(0, 1 << 63, k, U64) * U64(2) + U64(1)


def signatures(texts: list[str | None], k: int = COORDINATES, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(rows with at least one word, their k coordinates).

    A coordinate is the middle 48 bits of the least of the 64-bit hashes of a document's word shingles: the
    least itself has many leading zeros in a long document, those bits are even, so that a value is shared by chance
    by one in 2**48 documents whatever their length.
    """
    flip, odd = _family(k)
    rows, sigs = [], []
    for first, run in slices(texts):
        h, per = Words(run).shingles(shingle)
        if not len(h):
            continue
        has = np.flatnonzero(per)
        starts = (np.cumsum(per) - per)[has]
        sig = np.empty((len(has), k), U64)
        work = np.empty_like(h)
        for j in range(k):
            np.bitwise_xor(h, flip[j], out=work)
            work *= odd[j]
            sig[:, j] = np.minimum.reduceat(work, starts)
        rows.append(has + first)
        sigs.append(mix(sig) >> U64(16))
    if not rows:
        return np.zeros(0, np.int64), np.zeros((0, k), U64)
    return np.concatenate(rows), np.concatenate(sigs)


def _fixed(data: np.ndarray) -> pa.Array:
    """Rows of a byte matrix as binary values."""
    n, size = data.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, size * n + 1, size, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _sign(k: int, shingle: int):
    """(doc_id, sig): of each coordinate the low 32 bits, and after all of these the 16 above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, sig = signatures(text_column(b), k, shingle)
            low, high = sig.astype(np.uint32), (sig >> U64(32)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), _fixed(np.concatenate((low.view(np.uint8), high.view(np.uint8)), axis=1))], ["doc_id", "sig"])

    return run


def _unpack(column: pa.Array, size: int) -> np.ndarray:
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) else np.zeros(0, np.uint8)
    return np.ascontiguousarray(data[column.offset * size : (column.offset + len(column)) * size].reshape(-1, size))


def _post(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coordinate = mix(np.arange(1, k + 1, dtype=U64))
        for b in batches:
            sig = _unpack(b.column(1), 6 * k)
            low, high = np.ascontiguousarray(sig[:, : 4 * k]).view(np.uint32), np.ascontiguousarray(sig[:, 4 * k :]).view(np.uint16)
            key = mix((high.astype(U64) << U64(32) | low) ^ coordinate)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), k)), pa.array(key.ravel().view(np.int64))], ["rep", "key"])

    return run


def forest(ids: np.ndarray, sig: np.ndarray, matches: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of one posting list that agree on ``matches`` coordinates or more.

    Breadth first: each document reached is compared with those not yet reached, so that a list of
    copies takes one pass and components come out exactly as from all pairs.
    """
    left = np.arange(len(ids))
    edges = []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            f = queue.pop()
            same = (sig[left] == sig[f]).sum(1) >= matches
            hit = left[same]
            edges += [(ids[f], ids[h]) for h in hit]
            queue += hit.tolist()
            left = left[~same]
    return edges


def _collide(k: int, matches: int):
    def lists(key: np.ndarray, ids: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(key)])))
        two = starts[sizes == 2]
        two = two[(sig[two] == sig[two + 1]).sum(1) >= matches]
        a, b = [ids[two]], [ids[two + 1]]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            edges = forest(ids[s : s + n], sig[s : s + n], matches)
            if edges:
                pairs = np.array(edges, np.int64)
                a.append(pairs[:, 0])
                b.append(pairs[:, 1])
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), _unpack(batch.column(2), 4 * k).view(np.uint32)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            cut = np.searchsorted(now[0], now[0][-1])  # the last list may go on in the next batch
            held = [x[cut:].copy() for x in now]
            if cut:
                yield lists(*(x[:cut] for x in now))
        if held is not None:
            yield lists(*held)
        give_back()

    return run


def near_duplicates(docs: DataFrame, coordinates: int = COORDINATES, matches: int = MATCHES, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, group_id) of every document that has a near duplicate; group_id is the least doc_id of its group.

    Documents are posted under each (coordinate, value) of a MinHash signature over word shingles. Two
    documents match where they agree on ``matches`` coordinates or more; groups are the connected
    components of all matching pairs. Of a document's postings in the global order (rarest first) only the
    first ``coordinates - matches + 1`` can be needed to meet every partner (prefix); longer lists are skipped
    and only count in the comparison of whole signatures. Documents of equal signature are one posting, and
    lists of the same documents (those of a group's common coordinates) are compared once. A list of over ``BLOCK`` documents
    is compared block by block, each two blocks in a task of their own.

    Reads doc_id and text alone, so other columns may have any name. A null doc_id is left out; a null
    text, or one without words, matches nothing; rows of one doc_id are one document and never match
    themselves; an empty table gives no rows. A long text counts whole.
    """
    sigs = docs.select(F.col("doc_id").cast("long"), F.col("text")).where("doc_id is not null").mapInArrow(_sign(coordinates, shingle), "doc_id long, sig binary")
    sigs = written(sigs.select("doc_id", F.unhex(F.md5("sig")).alias("same"), "sig"), "mh-sigs")
    reps = written(sigs.groupBy("same", "sig").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")), "mh-reps")
    posts = reps.select("rep", "sig").mapInArrow(_post(coordinates), "rep long, key long")
    # a list is known by its size, its least member and the hashes of all, xored: nothing holds it whole
    lists = posts.groupBy("key").agg(F.count("*").alias("df"), F.min("rep").alias("least"), F.bit_xor(F.xxhash64("rep")).alias("sum")).where("df > 1")
    lists = lists.select("key", "df", F.xxhash64("df", "least", "sum").alias("list"))
    shared = posts.join(lists, "key").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "list"))).alias("post"))
    prefix = shared.where(F.size("post") >= matches).select("rep", F.explode(F.array_distinct(F.expr(f"slice(post, 1, size(post) - {matches - 1})"))).alias("p")).select("rep", "p.list", "p.df")
    blocks, own = F.expr(f"cast(ceil(df / {BLOCK}) as int)"), F.expr("pmod(xxhash64(rep), blocks)")
    prefix = prefix.withColumn("blocks", blocks).select("rep", "list", "blocks", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    prefix = prefix.select("rep", F.when(F.col("blocks") == 1, F.col("list")).otherwise(F.xxhash64("list", F.least("own", "other"), F.greatest("own", "other"))).alias("list"))
    met = prefix.join(reps.select("rep", F.substring("sig", 1, 4 * coordinates).alias("sig")), "rep").select("list", "rep", "sig").repartition("list").sortWithinPartitions("list", "rep")
    edges = met.mapInArrow(_collide(coordinates, matches), "a long, b long").distinct()
    labels = components(edges)
    groups = reps.drop("sig").join(labels.withColumnRenamed("v", "rep"), "rep", "left").where("last > rep or label is not null").select("same", F.coalesce("label", "rep").alias("group_id"))
    return sigs.select("doc_id", "same").join(groups, "same").select("doc_id", "group_id").distinct()


def deduplicated(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` with one document, the one of the least doc_id, of each near-duplicate group; rows without a group stay."""
    return without(docs, near_duplicates(docs, **kw).where("doc_id <> group_id").select("doc_id"))


def op1_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
