"""Byte n-gram scores from Elias-Fano tries: counted over all documents, written in shards, memory-mapped by the scorers."""

from __future__ import annotations

import json
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh_path, written
from .textkit import SLICE_UNITS, U64, slices, text_column
from .warc import _open

ORDER = 7
#: Grams of all orders that one shard of the trie should hold; the number of shards follows the counts.
SHARD_GRAMS = 500_000
HELD_GRAMS = 4_000_000
#: Bytes of shards that a scorer keeps where the file system can't map them.
OPEN_BYTES = 256_000_000
FLOOR = -30.0
STEPS = 65_535
#: A scorer keeps the scores of so many grams, one in each place: the rest of the spread key, the steps, and whether the byte was never seen.
MEMO_BITS, STEP_BITS = 22, 20
ODD, BLOCK = 0x9E3779B97F4A7C15, 1 << 16


def padded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, places of real bytes, bytes per text); ORDER - 1 zero bytes stand before each text, a zero byte within reads as 1."""
    docs = [t.encode("utf-8", "surrogatepass") for t in texts]
    lead = b"\0" * (ORDER - 1)
    size = np.fromiter(map(len, docs), np.int64, len(docs))
    buf = np.frombuffer(lead + lead.join(docs), np.uint8).copy()
    real = np.ones(len(buf), bool)
    start = np.cumsum(size + ORDER - 1) - size - (ORDER - 1)
    real[(start[:, None] + np.arange(ORDER - 1)).ravel()[: len(buf)]] = False
    at = np.flatnonzero(real)
    buf[at[buf[at] == 0]] = 1
    return buf, at, size


def grams(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ORDER bytes that end at each place, the earliest as the highest byte of a key."""
    wide = np.concatenate((np.zeros(8 - 1, np.uint8), buf))
    every = np.ndarray(len(buf), ">u8", wide, 0, (1,)).astype(U64)
    return every[at] & U64((1 << 8 * ORDER) - 1)


def _runs(key: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if count is None:
        key = np.sort(key)
        edge = np.flatnonzero(np.concatenate((key[1:] != key[:-1], [True])))
        return key[edge], np.diff(np.concatenate(([-1], edge)))
    order = np.argsort(key, kind="stable")
    key, count = key[order], np.cumsum(count[order])
    edge = np.flatnonzero(np.concatenate((key[1:] != key[:-1], [True])))
    return key[edge], np.diff(np.concatenate(([0], count[edge])))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        key, n = _runs(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    for b in batches:
        for _, texts in slices(text_column(b)):
            buf, at, _ = padded(texts)
            if len(at):
                held.append(_runs(grams(buf, at)))
                if sum(len(k) for k, _ in held) > HELD_GRAMS:
                    yield out()
    if held:
        yield out()


def smoothed(counts: DataFrame) -> DataFrame:
    """(k, key, logp, logb) of every gram of up to ORDER bytes, the empty one too, from (key, n) of those of ORDER bytes.

    Witten-Bell: with c and t the uses and the distinct followers of a context, a gram has probability
    (n + t * p of the shorter gram) / (c + t), down to the uniform 1/256; an unseen follower gets
    t / (c + t) times its probability in the shorter context, whose logarithm is ``logb`` of the context.
    """
    by = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        by[k] = written(by[k + 1].groupBy(F.expr(f"key & {(1 << 8 * k) - 1}L").alias("key")).agg(F.sum("n").alias("n")), f"ngram-counts-{k}")
    contexts = {k: written(by[k].groupBy(F.expr("shiftright(key, 8)").alias("h")).agg(F.sum("n").alias("c"), F.count("*").alias("t")), f"ngram-contexts-{k}") for k in by}
    shorter, rows = None, None
    for k in range(1, ORDER + 1):
        joined = by[k].withColumn("h", F.expr("shiftright(key, 8)")).join(contexts[k], "h")
        if shorter is None:
            joined = joined.withColumn("q", F.lit(1 / 256))
        else:
            joined = joined.withColumn("s", F.expr(f"key & {(1 << 8 * (k - 1)) - 1}L")).join(shorter.select(F.col("key").alias("s"), F.col("p").alias("q")), "s")
        shorter = written(joined.select("key", ((F.col("n") + F.col("t") * F.col("q")) / (F.col("c") + F.col("t"))).alias("p")), f"ngram-{k}")
        part = shorter.select("key", F.log("p").alias("logp"))
        if k < ORDER:
            # full: a context that reaches back before a text's first byte is no gram itself, but has followers
            back = contexts[k + 1].select(F.col("h").alias("key"), F.log(F.col("t") / (F.col("c") + F.col("t"))).alias("logb"))
            part = part.join(back, "key", "full")
        else:
            part = part.withColumn("logb", F.lit(0.0))
        part = part.select(F.lit(k).alias("k"), "key", F.coalesce("logp", F.lit(FLOOR)).alias("logp"), F.coalesce("logb", F.lit(0.0)).alias("logb"))
        rows = part if rows is None else rows.union(part)
    nothing = contexts[1].select(F.lit(0).alias("k"), F.col("h").alias("key"), F.lit(0.0).alias("logp"), F.log(F.col("t") / (F.col("c") + F.col("t"))).alias("logb"))
    return rows.union(nothing)


_PAIRS, _FOURS, _EIGHTS, _EACH, _TOPS = (U64(x) for x in (0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F, 0x0101010101010101, 0x8080808080808080))
#: Place of one number r (of 8) of a byte b, at 256 * r + b.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[r] for r in range(8) for b in range(256)], np.int64)


def _nth_one(word: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Place of one number ``nth``, from 0, of each 64-bit word: the byte by ones up to each byte, then a table."""
    nth = nth.astype(U64)
    ones = word - (word >> U64(1) & _PAIRS)
    ones = (ones & _FOURS) + (ones >> U64(2) & _FOURS)
    ones = (ones + (ones >> U64(4)) & _EIGHTS) * _EACH
    shift = np.bitwise_count((nth * _EACH | _TOPS) - ones & _TOPS).astype(U64) << U64(3)
    nth -= ones << U64(8) >> shift & U64(255)
    return shift.view(np.int64) + _IN_BYTE.take((nth << U64(8) | word >> shift & U64(255)).view(np.int64))


class EliasFano:
    """A non-decreasing sequence: low bits side by side, high bits in unary, places of ones by counts per word."""

    def __init__(self, values: np.ndarray | None = None, parts: dict[str, np.ndarray] | None = None) -> None:
        if parts is not None:
            self.parts = parts
        else:
            n = len(values)
            top = int(values[-1]) + 1 if n else 1
            bits = max(0, (top // max(n, 1)).bit_length() - 1)
            low = np.zeros((n * bits + 63) // 64 + 2, U64)
            v = values.astype(U64)
            if bits:
                at = np.arange(n) * bits
                part = v & U64((1 << bits) - 1)
                np.bitwise_or.at(low, at >> 6, part << (at & 63).astype(U64))
                over = (at & 63) + bits > 64
                np.bitwise_or.at(low, (at[over] >> 6) + 1, part[over] >> (64 - (at[over] & 63)).astype(U64))
            ones = (v >> U64(bits)).astype(np.int64) + np.arange(n)
            high = np.zeros((int(ones[-1]) >> 6) + 2 if n else 1, U64)
            np.bitwise_or.at(high, ones >> 6, U64(1) << (ones & 63).astype(U64))
            rank = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.uint32)))[:-1].astype(np.uint32)
            self.parts = {"bits": np.array([bits], np.int64), "low": low, "high": high, "rank": rank}
        self.bits = int(self.parts["bits"][0])
        self.low, self.high, self.rank = self.parts["low"], self.parts["high"], self.parts["rank"]

    def get(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.rank, i.astype(np.uint32), side="right") - 1
        place = _nth_one(self.high[word], i - self.rank[word])
        out = ((word << 6) + place - i).astype(np.int64)
        if self.bits:
            at = i * self.bits
            shift = (at & 63).astype(U64)
            part = np.asarray(self.low[at >> 6]) >> shift
            over = (at & 63) + self.bits > 64
            part = np.where(over, part | (np.asarray(self.low[(at >> 6) + 1]) << ((U64(64) - shift) & U64(63))), part) & U64((1 << self.bits) - 1)
            out = (out << self.bits) | part.astype(np.int64)
        return out


def quantised(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x / FLOOR * STEPS), 0, STEPS).astype(np.uint16)


def restored(q: np.ndarray) -> np.ndarray:
    return q.astype(np.float64) * (FLOOR / STEPS)


class Trie:
    """Levels of grams sorted by key. Of level k: the last bytes, as offsets from the last value of the range
    before (which makes one rising sequence), where each parent's range starts, and quantised scores."""

    def __init__(self, parts: dict[str, np.ndarray]) -> None:
        self.parts, self.held = parts, 0
        pick = lambda name: EliasFano(parts={k.split("/")[1]: v for k, v in parts.items() if k.startswith(name + "/")})
        self.value = {k: pick(f"value{k}") for k in range(2, ORDER + 1) if f"value{k}/bits" in parts}
        self.start = {k: pick(f"start{k}") for k in self.value}
        self.first = np.asarray(parts["first"])

    @staticmethod
    def build(level: np.ndarray, key: np.ndarray, logp: np.ndarray, logb: np.ndarray) -> dict[str, np.ndarray]:
        """Parts of the trie of (level, key)-sorted grams; every gram's prefixes are among them."""
        parts: dict[str, np.ndarray] = {}
        parents = key[level == 1]
        first = np.full(256, -1, np.int32)
        first[parents] = np.arange(len(parents))
        parts["first"] = first
        parts["nothing"] = logb[level == 0]
        for k in range(1, ORDER + 1):
            mine = level == k
            parts[f"logp{k}"], parts[f"logb{k}"] = quantised(logp[mine]), quantised(logb[mine])
            if k == 1:
                continue
            own = key[mine]
            if not len(own):
                break
            parent = np.searchsorted(parents, own >> 8)
            starts = np.searchsorted(parent, np.arange(len(parents) + 1))
            symbol = (own & 255) + 1
            last = np.zeros(len(parents), np.int64)
            full = np.diff(starts) > 0
            last[full] = symbol[starts[1:][full] - 1]
            base = np.cumsum(last) - last
            for name, ef in ((f"value{k}", EliasFano(base[parent] + symbol)), (f"start{k}", EliasFano(starts))):
                parts |= {f"{name}/{p}": v for p, v in ef.parts.items()}
            parents = own
        return parts

    def descend(self, key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(place at level k or -1, place of the first k - 1 bytes at their level or -1) of grams of k bytes.

        Grams go in order, so that each prefix they share is looked up once.
        """
        order = None
        if len(key) > 1 and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key = key[order]
        head = key >> U64(8 * (k - 1))
        group, node, before = np.arange(len(key)), self.first[head.astype(np.int64) & 255].astype(np.int64), np.full(len(key), -1, np.int64)
        for d in range(2, k + 1):
            part = key >> U64(8 * (k - d))
            new = np.concatenate(([True], part[1:] != part[:-1]))[: len(part)]
            at = np.flatnonzero(new)
            parent = node[group[at]]
            group = np.cumsum(new) - 1
            if d == k:
                before = parent[group]
            node = self._child(d, parent, (part[at] & U64(255)).astype(np.int64))
        node = node[group]
        if order is not None:
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            node, before = node[back], before[back]
        return node, before

    def _child(self, d: int, parent: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Place at level d of each parent's gram with one more byte, or -1: the successor within the parent's range."""
        node = np.full(len(parent), -1, np.int64)
        if d not in self.value:
            return node
        live = np.flatnonzero(parent >= 0)
        low, high = self.start[d].get(parent[live]), self.start[d].get(parent[live] + 1)
        ef = self.value[d]
        base = np.zeros(len(live), np.int64)
        some = low > 0
        base[some] = ef.get(low[some] - 1)
        want = base + symbol[live] + 1
        left = np.flatnonzero(low < high)
        a, b, want, live = low[left], high[left], want[left], live[left]
        while len(live):
            middle = (a + b) >> 1
            value = ef.get(middle)
            equal = value == want
            node[live[equal]] = middle[equal]
            less = value < want
            a, b = np.where(less, middle + 1, a), np.where(less, b, middle)
            left = np.flatnonzero(~equal & (a < b))
            a, b, want, live = a[left], b[left], want[left], live[left]
        return node


def _pack_file(parts: dict[str, np.ndarray]) -> bytes:
    head, blobs, at = {}, [], 0
    for name, v in parts.items():
        raw = np.ascontiguousarray(v).tobytes()
        raw += b"\0" * (-len(raw) % 8)
        head[name] = [v.dtype.str, len(v), at]
        blobs.append(raw)
        at += len(raw)
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return np.int64(len(text)).tobytes() + text + b"".join(blobs)


def _map_file(uri: str) -> Trie:
    system, place = _open(uri)
    raw = np.memmap(place, np.uint8, "r") if isinstance(system, fs.LocalFileSystem) else np.frombuffer(system.open_input_file(place).read(), np.uint8)
    n = int(raw[:8].view(np.int64)[0])
    head = json.loads(bytes(raw[8 : 8 + n]))
    trie = Trie({name: raw[8 + n + at : 8 + n + at + size * np.dtype(kind).itemsize].view(kind) for name, (kind, size, at) in head.items()})
    trie.held = 0 if isinstance(raw, np.memmap) else len(raw)
    return trie


def _shard_of(head: np.ndarray, shards: int) -> np.ndarray:
    return (head.astype(np.int64) * 40503 % 65521) % shards


def build_model(docs: DataFrame) -> list[str]:
    """Paths of the trie's shards in the shared folder; grams of one first pair of bytes are in one shard, single bytes in all."""
    counts = docs.select("text").mapInArrow(_count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    rows = written(smoothed(written(counts, "ngram-counts")), "ngram-scores")
    shards = max(1, -(-rows.count() // SHARD_GRAMS))
    pair = F.when(F.col("k") > 1, F.expr("cast(shiftright(key, 8 * (k - 2)) as int)"))
    spread = rows.withColumn("shard", F.when(F.col("k") > 1, F.array(((pair.cast("long") * 40503) % 65521 % shards).cast("int"))).otherwise(F.sequence(F.lit(0), F.lit(shards - 1)))).select(F.explode("shard").alias("shard"), "k", "key", "logp", "logb")
    folder = fresh_path(docs.sparkSession, "ngram-trie")

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "key"])
        blob = _pack_file(Trie.build(pdf["k"].to_numpy(), pdf["key"].to_numpy(), pdf["logp"].to_numpy(), pdf["logb"].to_numpy()))
        path = f"{folder}/{uuid.uuid4().hex}.trie"
        system, place = _open(path)
        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(place, compression=None) as out:
            out.write(blob)
        return pd.DataFrame({"shard": [key[0]], "path": [path]})

    files = written(spread.groupBy("shard").applyInPandas(build, "shard int, path string"), "ngram-manifest").collect()
    paths = {r.shard: r.path for r in files}
    return [paths.get(s, "") for s in range(shards)]


class Scorer:
    def __init__(self, paths: tuple[str, ...]) -> None:
        self.paths = paths
        self.open: OrderedDict[int, Trie] = OrderedDict()
        self.memo = np.full(1 << MEMO_BITS, 0xFFFFFFFFFFFFFFFF, U64)

    def trie(self, shard: int) -> Trie | None:
        """A shard, opened where it is first asked for; of those that can't be mapped, ``OPEN_BYTES`` stay, the last used."""
        if not self.paths[shard]:
            return None
        if shard not in self.open:
            self.open[shard] = _map_file(self.paths[shard])
        self.open.move_to_end(shard)
        while len(self.open) > 1 and sum(t.held for t in self.open.values()) > OPEN_BYTES:
            self.open.popitem(last=False)
        return self.open[shard]

    def steps(self, key: np.ndarray) -> np.ndarray:
        """Log probability of the last byte of each gram given those before, from the longest gram that was seen: twice its steps, and 1 more where the byte was never seen."""
        out = np.zeros(len(key), np.int64)
        live = np.arange(len(key))
        for k in range(ORDER, 0, -1):
            part = key[live] & U64((1 << 8 * k) - 1)
            head = (part >> U64(8 * (k - 2))) if k > 1 else np.zeros(len(part), U64)
            shard = _shard_of(head, len(self.paths)) if k > 1 else np.zeros(len(part), np.int64)
            done = np.zeros(len(live), bool)
            for s in np.unique(shard):
                trie = self.trie(s)
                at = np.flatnonzero(shard == s)
                if trie is None:
                    continue
                node, before = trie.descend(part[at], k)
                hit = node >= 0
                out[live[at[hit]]] += trie.parts[f"logp{k}"][node[hit]]
                done[at[hit]] = True
                miss = ~hit & (before >= 0)
                if k > 1:
                    out[live[at[miss]]] += trie.parts[f"logb{k - 1}"][before[miss]]
            live = live[~done]
        out <<= 1
        out[live] |= 1
        return out

    def unseen(self) -> float:
        """Log probability of a byte that was never seen, but for the steps."""
        nothing = next((t.parts["nothing"][0] for t in map(self.trie, range(len(self.paths))) if t is not None), 0.0)
        return nothing + np.log(1 / 256)

    def score_keys(self, key: np.ndarray) -> np.ndarray:
        steps = self.steps(key)
        out = restored(steps >> 1)
        if (steps & 1).any():
            out += (steps & 1) * self.unseen()
        return out

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, log probability) of each text."""
        buf, at, size = padded(texts)
        key = grams(buf, at)
        rest, low = U64(8 * ORDER - MEMO_BITS), U64((1 << 8 * ORDER - MEMO_BITS) - 1)
        key *= U64(ODD)
        key &= U64((1 << 8 * ORDER) - 1)
        value = np.empty(len(key), np.int64)
        missed = []
        for a in range(0, len(key), BLOCK):
            k = key[a : a + BLOCK]
            word = self.memo[k >> rest]
            value[a : a + BLOCK] = word & U64((1 << STEP_BITS) - 1)
            missed.append(np.flatnonzero(word >> U64(STEP_BITS) != k & low) + a)
        miss = np.concatenate(missed) if missed else np.zeros(0, np.int64)
        if len(miss):
            new, of = np.unique(key[miss] * U64(pow(ODD, -1, 1 << 64)) & U64((1 << 8 * ORDER) - 1), return_inverse=True)
            found = self.steps(new)
            value[miss] = found[of]
            new = new * U64(ODD) & U64((1 << 8 * ORDER) - 1)
            self.memo[new >> rest] = (new & low) << U64(STEP_BITS) | found.astype(U64)
        ends = np.cumsum(size)
        total = np.concatenate(([0], np.cumsum(value >> 1)))
        logp = restored(total[ends] - total[ends - size])
        odd = np.flatnonzero(value & 1)
        if len(odd):
            logp += np.bincount(np.searchsorted(ends, odd, side="right"), minlength=len(texts)) * self.unseen()
        return size, logp


@lru_cache(maxsize=1)
def scorer(paths: tuple[str, ...]) -> Scorer:
    return Scorer(paths)


def _score(paths: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in slices(text_column(b), 2 * SLICE_UNITS):
                size, logp = scorer(paths).score(texts)
                per = np.exp(-logp / np.maximum(size, 1))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), pa.array(size), pa.array(logp), pa.array(np.where(size > 0, per, np.nan), from_pandas=True)], ["doc_id", "n_bytes", "log_prob", "perplexity"])

    return run


def lm_scores(docs: DataFrame, train_on: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_bytes, log_prob, perplexity) of every row of ``docs`` under a byte model of ``train_on``, by default ``docs``.

    The model counts the grams of ``ORDER`` bytes of all its documents, so its contexts reach back over a word, and it grows with them. Scores are quantised to 16 bits (steps
    of 0.0005). A null or empty text has 0 bytes, log_prob 0 and a null perplexity; repeated rows count and
    are scored each; a null doc_id stays null; other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    model = tuple(build_model(rows if train_on is None else train_on))
    return rows.mapInArrow(_score(model), "doc_id long, n_bytes long, log_prob double, perplexity double")


def op7_lmscore(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
