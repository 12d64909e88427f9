"""Near-duplicate lines by a segment-partition edit join, and documents without the lines that repeat."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .textkit import _WORD, U64, PrefixHash, give_back, mix, ragged, slices, text_column

_ALL = (1 << 64) - 1

THRESHOLD = 2
MIN_BYTES = 40
#: Of this many words of the longer line, one may be edited.
WORDS_AN_EDIT = 10
RUN = 3
#: Pairs that a task holds before it writes them.
HELD_PAIRS = 200_000
#: A part of the documents by which frequent word runs are known, how often they stand in it, and how many are kept; these only set an order.
SAMPLE, FREQUENT, MOST_FREQUENT = 16, 8, 200_000
#: Lines under one key that one task compares; a key that holds more by the same sample is cut into such blocks, and each two blocks are a key of their own.
BLOCK, MOST_HOT = 2_000, 100_000
#: Earlier lines that a line is first paired with under a key; the rest follow where none of these is near. Lines looked at in one step.
FEW, STEP = 8, 64
#: A row's place: words of the line, place of the run in it, and a code of 16 bits that rises with the document. A count at its bound is not compared.
WORDS_AT, RUN_AT, MOST_WORDS, CODES = 40, 16, (1 << 23) - 1, 256


def _cuts(length: np.ndarray, segments: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, size) of segment i of lines of ``length`` bytes: sizes differ by one at most, the longer ones last."""
    base, longer = length // segments, length % segments
    short = segments - longer
    return i * base + np.maximum(i - short, 0), base + (i >= short)


def _keys(p: PrefixHash, start: np.ndarray, size: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys (lines, tau+1) of each line's own segments, and the keys to probe.

    Two lines within ``tau`` edits share a segment of the shorter one, unmoved by more than the edits on
    either side of it allow (the multi-match-aware window). Keys hold the indexed line's length and the segment's number.
    """
    own, probe = [], []
    for delta in range(tau + 1):
        length = size - delta
        for i in range(tau + 1):
            place, n = _cuts(length, tau + 1, i)
            label = mix(length.astype(U64) * U64(64) + U64(i))
            low, high = max(-i, delta - (tau - i)), min(i, delta + (tau - i))
            for shift in range(low, high + 1):
                at = place + shift
                fits = (at >= 0) & (at + n <= size)
                key = mix(p.span(start + np.where(fits, at, 0), start + np.where(fits, at + n, 0)) ^ label)
                if delta == 0 and shift == 0:
                    own.append(key)
                else:
                    probe.append(np.where(fits, key, U64(0)))
    return np.stack(own, 1).view(np.int64), np.stack(probe, 1).view(np.int64)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of a buffer, ASCII capitals lowered; a newline ends a word."""
    low = _LOWER[buf]
    inside = np.concatenate(([False], _WORD[low], [False]))
    change = np.flatnonzero(inside[1:] != inside[:-1])
    return change[0::2], PrefixHash(low).span(change[0::2], change[1::2])


def _word_runs(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words and sketch of each line, line of each run of RUN neighbouring words, its place in words, its hash).

    Each word turns one of the sketch's 64 bits, so a word edit turns two at most.
    """
    at, word = _words(buf)
    first, last = np.searchsorted(at, start), np.searchsorted(at, start + size)
    runs = np.maximum(last - first - RUN + 1, 0)
    line, place = np.repeat(np.arange(len(start)), runs), ragged(runs)
    i = np.repeat(first, runs) + place
    run = np.zeros(len(i), U64)
    for j in range(RUN):
        run = run * U64(0x9E3779B97F4A7C15) + word[i + j]
    bits = np.concatenate(([U64(0)], np.bitwise_xor.accumulate(U64(1) << (word >> U64(58)))))
    return last - first, (bits[last] ^ bits[first]).view(np.int64), line, place, mix(run)


def _word_keys(buf: np.ndarray, start: np.ndarray, size: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(line, key, words and place, sketch; words of every line): the rarest word runs of each line, so many that two lines within the allowed word edits share one.

    A word edit changes RUN runs of either line at most. Of the first ``RUN * edits + 1`` in one order of all runs
    (with all that equal the last), both lines thus hold the first run that the edits leave alone (prefix filter),
    at places that differ by the edits at most. A line of n words may have a longer partner, with n // 9 edits.
    """
    n, sketch, line, place, run = _word_runs(buf, start, size)
    edits = n // (WORDS_AN_EDIT - 1)
    use = edits[line] > 0
    line, place, run = line[use], place[use], run[use]
    known, count = frequent
    weight = np.zeros(len(line), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, run), len(known) - 1)
        weight = np.where(known[at] == run, count[at], 0)
    order = np.lexsort((run, weight, line))
    line, place, run = line[order], place[order], run[order]
    every = np.arange(len(line))
    rank = every - np.maximum.accumulate(np.where(np.concatenate(([True], line[1:] != line[:-1]))[: len(line)], every, 0))
    new = np.concatenate(([True], (line[1:] != line[:-1]) | (run[1:] != run[:-1])))[: len(line)]
    rank = rank[np.maximum.accumulate(np.where(new, every, 0))]  # equal runs go together
    first = rank <= RUN * edits[line]
    line = line[first]
    return line, mix(run[first]).view(np.int64), np.minimum(n[line], MOST_WORDS) << WORDS_AT | np.minimum(place[first], MOST_WORDS) << RUN_AT, sketch[line], n


def frequent_runs(source: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(word run, uses) of those frequent in a sample of the documents, by hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, run_ in slices(text_column(b)):
                buf, _, _, start, size = split_lines(run_)
                run, n = np.unique(_word_runs(buf, start, size)[4], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(run.view(np.int64)), pa.array(n)], ["run", "n"])

    sample = source.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    found = sample.mapInArrow(count, "run long, n long").groupBy("run").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    rows = found.orderBy(F.desc("n"), "run").limit(MOST_FREQUENT).toArrow()
    run, n = rows.column(0).to_numpy().view(U64), rows.column(1).to_numpy()
    order = np.argsort(run)
    return run[order], n[order]


def hot_keys(source: DataFrame, least: int, tau: int, min_bytes: int, frequent) -> tuple[np.ndarray, np.ndarray]:
    """(key >> 2, blocks) of the keys that hold more than ``BLOCK`` distinct lines by a sample; it only spreads the comparisons."""
    sample = source.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    keys = sample.mapInArrow(_lines(least, _segments(tau, min_bytes, frequent)), "key long, h long, place long, sketch long").select(F.shiftright("key", 2).alias("key"), "h").distinct()
    rows = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * SAMPLE > BLOCK).orderBy(F.desc("n"), "key").limit(MOST_HOT).toArrow()
    key, n = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    order = np.argsort(key)
    return key[order], np.minimum(-(-n[order] * SAMPLE // BLOCK), 1 << 20)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def split_lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, row, line number, start, size) of each line; ends at ``\\n``, without blanks at either end."""
    docs = [t.encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n".join(docs) + b"\n", np.uint8)
    ends = np.flatnonzero(buf == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    doc_end = np.cumsum(np.fromiter(map(len, docs), np.int64, len(docs)) + 1)
    row = np.searchsorted(doc_end, starts, side="right")
    first = np.searchsorted(row, np.arange(len(docs)))
    number = np.arange(len(starts)) - first[row]
    inked = np.flatnonzero(~_SPACE[buf])
    a, b = np.searchsorted(inked, starts), np.searchsorted(inked, ends)
    blank = a == b
    inked = np.concatenate((inked, [0]))
    begin = np.where(blank, starts, inked[np.minimum(a, len(inked) - 1)])
    end = np.where(blank, starts, inked[b - 1] + 1)
    return buf, row, number, begin, end - begin


def _lines(least: int, emit):
    """A task over batches of (doc_id, text, hash of the text): ``emit`` gets where they stand and split lines of ``least`` bytes or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for b in batches:
            ids, of = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            for first, run_ in slices(text_column(b)):
                buf, row, number, start, size = split_lines(run_)
                use = size >= least
                start, size = start[use], size[use]
                p = PrefixHash(buf)
                row = first + row[use]
                yield emit((ids[row], number[use], of[row]), p, start, size, p.span(start, start + size).view(np.int64), state)

    return run


def _places(where, p, start, size, h, state) -> pa.RecordBatch:
    ids, number, of = where
    return pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids), pa.array(number.astype(np.int32)), pa.array(of)], ["h", "doc_id", "line_no", "of"])


def _spread(key: np.ndarray, rows: list[np.ndarray], hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows under hot keys once for each pair of blocks with their own; the second bit of a key tells which of the two a row is of."""
    known, blocks = hot
    if not len(known) or not len(key):
        return key, rows
    at = np.minimum(np.searchsorted(known, key >> 2), len(known) - 1)
    m = np.where(known[at] == key >> 2, blocks[at], 1)
    i = np.repeat(np.arange(len(key)), m)
    other, cut = ragged(m), m[i] > 1
    own = ((mix(rows[0].view(U64))[i] >> U64(32)) % m[i].astype(U64)).astype(np.int64)
    pair = (np.minimum(own, other) << 20 | np.maximum(own, other)).astype(U64)
    moved = mix((key[i] >> 2).astype(U64) ^ mix(pair + U64(1))).view(np.int64) & ~3 | (own > other).astype(np.int64) << 1 | key[i] & 1
    return np.where(cut, moved, key[i]), [r[i] for r in rows]


def _segments(tau: int, least: int, frequent: tuple[np.ndarray, np.ndarray] | None = None, hot: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64),) * 2, bounds: np.ndarray = np.zeros(0, np.int64)):
    """(key, h, place, sketch) of each line that the task has not met yet, or not in so early a document by ``bounds``; the lowest bit of a key tells the line's own segments, the next is for ``_spread``.

    Lines under ``least`` bytes have no segments. With ``frequent``, keys of word runs come too, all of them own and
    with their place and sketch; those of segments are 0, but for the document's code.
    """

    def emit(where, p, start, size, h, state) -> pa.RecordBatch:
        code = np.searchsorted(bounds, where[0], side="right")
        order = np.argsort(code, kind="stable")
        h, at = np.unique(h[order], return_index=True)
        at = order[at]
        code = code[at]
        seen, least_code = state.get("seen", (np.zeros(0, np.int64),) * 2)
        to = np.searchsorted(seen, h)
        known = seen[np.minimum(to, len(seen) - 1)] == h if len(seen) else np.zeros(len(h), bool)
        new = ~known
        known[known] = code[known] < least_code[to[known]]
        least_code[to[known]] = code[known]
        state["seen"] = np.insert(seen, to[new], h[new]), np.insert(least_code, to[new], code[new])
        new |= known
        h, at, code = h[new], at[new], code[new]
        long = size[at] >= least
        if frequent is not None:
            whose, word_key, word_place, word_sketch, words = _word_keys(p.units, start[at], size[at], frequent)
            # a byte edit is two word edits at most (a word is cut, or two become one): lines of so many words meet by their runs, with partners shorter by all these edits too
            long &= words < (WORDS_AN_EDIT + 1) * 2 * tau
        own, probe = _keys(p, start[at[long]], size[at[long]], tau)
        fits = probe != 0
        key = [(own & ~3 | 1).ravel(), (probe & ~3)[fits]]
        line = [np.repeat(h[long], own.shape[1]), np.repeat(h[long], probe.shape[1]).reshape(probe.shape)[fits]]
        place = [np.repeat(code[long], own.shape[1]), np.repeat(code[long], probe.shape[1]).reshape(probe.shape)[fits]]
        sketch = [np.zeros(len(key[0]) + len(key[1]), np.int64)]
        if frequent is not None:
            key.append(word_key & ~3 | 1)
            line.append(h[whose])
            place.append(word_place | code[whose])
            sketch.append(word_sketch)
        key, (line, place, sketch) = _spread(np.concatenate(key), [np.concatenate(x) for x in (line, place, sketch)], hot)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(line), pa.array(place), pa.array(sketch)], ["key", "h", "place", "sketch"])

    return emit


def _meet(few: int | None = None, only: bool = False):
    """Pairs of different lines under one key, one of which has it as its own; rows come in order of key.

    Where a key is a word run, the words before it and those after it may differ by the allowed edits in all,
    and the sketches by twice as many bits. With ``few``, a line is paired with so many lines under a key at most, the earliest
    by code; where there may be more, a row (line, key >> 2, true) tells so. With ``only``, lines of code 1 alone are paired with all others.
    """

    def pairs(key: np.ndarray, h: np.ndarray, place: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = _sizes(key >> 2)
        size = np.repeat(n, n)
        key, h, place, sketch, own = (x[size > 1] for x in (key, h, place, sketch, key & 1))
        many = size[size > 1] > 2
        if many.any():  # a line comes from each task that met it
            k, x, p, b, o = (v[many] for v in (key >> 1, h, place, sketch, own))
            order = np.lexsort((p, x, k))
            k, x, p, b, o = (v[order] for v in (k, x, p, b, o))
            new = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (x[1:] != x[:-1]) | (p[1:] >> RUN_AT != p[:-1] >> RUN_AT))))
            o = np.maximum.reduceat(o, new)
            whole = (k[new] << 1, x[new], p[new], b[new], o)  # the lowest code of equals
            key, h, place, sketch, own = (np.concatenate((v[~many], w)) for v, w in zip((key, h, place, sketch, own), whole))
        side, code, words, before = key & 2, place & 0xFFFF, place >> WORDS_AT, place >> RUN_AT & 0xFFFFFF
        key = key >> 2
        n = _sizes(key)
        start = np.cumsum(n) - n
        a, b, more, held = [], [], [], 0

        def meet(x: np.ndarray, other: np.ndarray) -> bool:
            nonlocal held
            a.append(np.minimum(x, other))
            b.append(np.maximum(x, other))
            held += len(other)
            return held > HELD_PAIRS

        def out() -> pa.RecordBatch:
            nonlocal held
            found = _distinct(a, b, more if few else None)
            a.clear(), b.clear(), more.clear()
            held = 0
            return found

        def near(i, j) -> np.ndarray:
            widest = np.maximum(words[i], words[j])
            most = widest // WORDS_AN_EDIT
            ahead = before[i] - before[j]
            apart = np.abs(ahead) + np.abs(words[i] - words[j] - ahead)
            alike = ((apart <= most) | (widest == MOST_WORDS)) & (np.bitwise_count((sketch[i] ^ sketch[j]).view(U64)) <= 2 * most)
            return (h[i] != h[j]) & np.where(widest > 0, alike, (own[i] | own[j]) > 0)

        two = start[n == 2]
        two = two[near(two, two + 1) & ((side[two] != side[two + 1]) | (side[two] == 0))]
        if len(two) and meet(h[two], h[two + 1]):
            yield out()
        for s, k in zip(start[n > 2].tolist(), n[n > 2].tolist()):
            if h[s] == h[s + k - 1] and (h[s : s + k] == h[s]).all():
                continue
            every = s + np.argsort(code[s : s + k], kind="stable") if few else np.arange(s, s + k)
            cross = side[s : s + k].any()  # two blocks of a hot key, each compared with itself elsewhere
            ends = np.searchsorted(code[every], code[every], side="right").tolist() if few else [k] * k if only else range(k)
            for i, end in zip(every.tolist(), ends):
                if only and code[i] != 1:
                    continue
                left = few
                for first in range(0, end, STEP if few else k):
                    j = every[first : min(end, first + STEP) if few else end]
                    fits = near(np.full(len(j), i), j)
                    if cross:
                        fits &= side[j] != side[i]
                    other = h[j[fits]]
                    full = few and (len(other) > left or len(other) == left and first + STEP < end)
                    if full:
                        other = other[:left]
                        more.append((h[i], key[i]))
                        held += 1
                    if len(other) and meet(np.full(len(other), h[i]), other):
                        yield out()
                    if full:
                        break
                    if few:
                        left -= len(other)
        if a or more:
            yield out()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy() for i in range(4)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            cut = np.searchsorted(now[0], now[0][-1] & ~3)  # the last key may go on in the next batch
            held = [x[cut:].copy() for x in now]
            if cut:
                yield from pairs(*(x[:cut] for x in now))
        if held is not None:
            yield from pairs(*held)
        give_back()

    return run


def _sizes(key: np.ndarray) -> np.ndarray:
    """Rows of each run of equal keys."""
    return np.diff(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))) if len(key) else np.zeros(0, np.int64)


def _distinct(a: list[np.ndarray], b: list[np.ndarray], more: list[tuple[int, int]] | None = None) -> pa.RecordBatch:
    both = np.unique(np.stack((np.concatenate(a), np.concatenate(b)), 1), axis=0) if a else np.zeros((0, 2), np.int64)
    if more is None:
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["h", "other"])
    marks = np.unique(np.array(more, np.int64).reshape(-1, 2), axis=0)
    kind = np.repeat([False, True], [len(both), len(marks)])
    both = np.concatenate((both, marks))
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(kind)], ["h", "other", "more"])


def within(a: bytes, b: bytes, most: int) -> int:
    """Edit distance of two byte strings by bit vectors over the diagonal band; ``most + 1`` beyond it."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    head = 0
    for x, y in zip(a, b):
        if x != y:
            break
        head += 1
    a, b = a[head:], b[head:]
    tail = 0
    while tail < len(a) and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a:
        return len(b)
    if len(a) <= most:
        return _small(a, b, most)
    # One word holds the vertical differences of the 64 rows that end ``most`` below the diagonal. The distance
    # is followed down that edge of the band to the last row, then along it.
    where: dict[int, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    plus, minus, distance, edge, along = _ALL & ~((1 << 63 - most) - 1), 0, most, 1 << 63, 1 << 62
    for j, c in enumerate(b):
        shift = j + most - 63
        places = where.get(c, 0)
        match = (places >> shift if shift >= 0 else places << -shift) & _ALL
        diagonal = ((((match & plus) + plus) ^ plus) | match | minus) & _ALL
        right = (minus | ~(diagonal | plus)) & _ALL
        left = diagonal & plus
        if j < len(a) - most:
            distance += not diagonal & edge
        else:
            distance += bool(right & along) - bool(left & along)
            along >>= 1
        if distance > 2 * most + len(b) - len(a):
            return most + 1
        plus = (left | ~((diagonal >> 1) | right)) & _ALL
        minus = (diagonal >> 1) & right
    return min(distance, most + 1)


def _small(a: bytes, b: bytes, most: int) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return min(row[-1], most + 1)


def sequence_edits(a: list, b: list) -> int:
    """Edit distance of two lists by bit vectors as long as the first."""
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[head:], b[head:]
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a or not b:
        return len(a) + len(b)
    where: dict = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    every, edge = (1 << len(a)) - 1, len(a) - 1
    plus, minus, distance = every, 0, len(a)
    for c in b:
        match = where.get(c, 0)
        down = match | minus
        diagonal = (((match & plus) + plus) ^ plus) | match
        right, left = minus | (every & ~(diagonal | plus)), plus & diagonal
        distance += (right >> edge & 1) - (left >> edge & 1)
        right, left = (right << 1 | 1) & every, (left << 1) & every
        plus, minus = left | (every & ~(down | right)), right & down
    return distance


def near_by_words(a: bytes, b: bytes) -> int | None:
    """Word edits between two lines; None where they are more than one in ``WORDS_AN_EDIT`` words of the longer."""
    x, y = (_words(np.frombuffer(v, np.uint8))[1] for v in (a, b))
    most = max(len(x), len(y)) // WORDS_AN_EDIT
    if not most or abs(len(x) - len(y)) > most:
        return None
    d = sequence_edits(x.tolist(), y.tolist())
    return d if d <= most else None


def _verify(tau: int, least: int, words: bool):
    """Pairs within ``tau`` byte edits where both have ``least`` bytes; others near by words are ``tau`` and their word edits (1 at least) apart."""

    def distance(x: bytes, y: bytes) -> int:
        d = within(x, y, tau) if min(len(x), len(y)) >= least else tau + 1
        if d > tau and words:
            w = near_by_words(x, y)
            return -1 if w is None else tau + max(w, 1)
        return d if d <= tau else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = np.empty(b.num_rows, np.int32)
            for i in range(0, b.num_rows, 256):  # lines may be long
                pairs = zip(b.column(1).slice(i, 256).to_pylist(), b.column(3).slice(i, 256).to_pylist())
                d[i : i + 256] = [distance(x.encode("utf-8", "surrogatepass"), y.encode("utf-8", "surrogatepass")) for x, y in pairs]
            keep = pa.array(d >= 0)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(2).filter(keep), pa.array(d).filter(keep)], ["h", "to", "distance"])
        give_back()

    return run


def _trimmed(line: str) -> F.Column:
    return F.expr(rf"regexp_replace({line}, '^[ \\t\\x0b\\f\\r]+|[ \\t\\x0b\\f\\r]+$', '')")


def _read(docs: DataFrame, threshold: int, min_bytes: int, whole: bool, bounds: np.ndarray = np.zeros(0, np.int64)) -> tuple[DataFrame, ...]:
    """(documents, places of all lines, distinct lines with the first place of each, rows of keys)."""
    source = docs.select(F.col("doc_id").cast("long"), F.col("text"), F.xxhash64("text").alias("of")).where("doc_id is not null")
    least = 1 if whole else min_bytes
    frequent = frequent_runs(source) if whole else None
    raw = written(source.mapInArrow(_lines(least, _places), "h long, doc_id long, line_no int, of long"), "lines")
    lines = raw.groupBy("h").agg(F.min(F.struct("doc_id", "line_no", "of")).alias("first"), F.count("*").alias("n"))
    lines = written(lines.select("h", F.struct("first.doc_id", "first.line_no").alias("first"), "first.of", "n"), "distinct-lines")
    hot = hot_keys(source, least, threshold, min_bytes, frequent)
    keys = source.mapInArrow(_lines(least, _segments(threshold, min_bytes, frequent, hot, bounds)), "key long, h long, place long, sketch long")
    return source, raw, lines, keys


def _together(keys: DataFrame) -> DataFrame:
    return keys.repartition(F.shiftright("key", 2)).sortWithinPartitions("key")


def _texts(source: DataFrame, lines: DataFrame, met: DataFrame) -> DataFrame:
    """(h, line) of the lines in the pairs ``met``."""
    needed = met.select("h").union(met.select("other")).distinct().join(lines.select("h", "first", "of"), "h").select("h", F.col("first.doc_id").alias("doc_id"), F.col("first.line_no").alias("line_no"), "of")
    wanted = needed.groupBy("doc_id", "of").agg(F.collect_list(F.struct("line_no", "h")).alias("w"))
    texts = (
        source.join(wanted, ["doc_id", "of"]).select(F.split("text", "\n").alias("l"), F.explode("w").alias("w")).where("w.line_no < size(l)")
        .select("w.h", _trimmed("element_at(l, w.line_no + 1)").alias("line")).groupBy("h").agg(F.max("line").alias("line"))
    )
    return written(texts, "line-texts")


def _near(met: DataFrame, texts: DataFrame, threshold: int, min_bytes: int, whole: bool) -> DataFrame:
    pairs = met.join(texts, "h").join(texts.select(F.col("h").alias("other"), F.col("line").alias("other_line")), "other").select("h", "line", "other", "other_line")
    return pairs.mapInArrow(_verify(threshold, min_bytes, whole), "h long, to long, distance int")


def gone_lines(docs: DataFrame, threshold: int = THRESHOLD, min_bytes: int = MIN_BYTES, whole: bool = True) -> DataFrame:
    """(doc_id, line_no) of the lines that ``repeated_lines`` names, without their keepers.

    One near earlier line is enough for that, so a line is compared with the earliest of its candidates, then with the others, then
    with those beyond ``FEW`` under a key, and only while none is near: in a class of k near lines about k pairs are compared, not k * k / 2.
    """
    cuts = docs.select(F.col("doc_id").cast("long").cast("double").alias("doc_id")).where("doc_id is not null").approxQuantile("doc_id", [i / CODES for i in range(1, CODES)], 0.5 / CODES)
    bounds = np.unique(np.clip(np.array(cuts, float), -(2.0**62), 2.0**62).astype(np.int64))
    source, raw, lines, keys = _read(docs, threshold, min_bytes, whole, bounds)
    firsts = lines.select("h", "first")

    def later(met: DataFrame) -> DataFrame:
        """Each pair of lines as (h, other, keeper), h being the later one."""
        both = met.join(firsts, "h").join(firsts.select(F.col("h").alias("other"), F.col("first").alias("keeper")), "other").where("first <> keeper")
        turn = F.col("keeper") < F.col("first")
        return both.select(F.when(turn, F.col("h")).otherwise(F.col("other")).alias("h"), F.when(turn, F.col("other")).otherwise(F.col("h")).alias("other"), F.least("first", "keeper").alias("keeper"))

    def found(met: DataFrame, texts: DataFrame, name: str) -> DataFrame:
        return written(_near(met.select("h", "other"), texts, threshold, min_bytes, whole).select("h").distinct(), name)

    met = written(_together(keys).mapInArrow(_meet(FEW), "h long, other long, more boolean").distinct(), "line-pairs")
    pairs = written(later(met.where("not more").select("h", "other")), "later-lines")
    texts = _texts(source, lines, pairs)
    best = pairs.groupBy("h").agg(F.min(F.struct("keeper", "other")).alias("best")).select("h", "best.other")
    near = found(best, texts, "near-earliest")
    near = near.union(found(pairs.join(near, "h", "left_anti").join(best, ["h", "other"], "left_anti"), texts, "near-others"))
    open_ = written(met.where("more").select("h", F.col("other").alias("at")).join(near, "h", "left_anti"), "open-lines")
    if not open_.isEmpty():
        keyed = keys.withColumn("at", F.shiftright("key", 2)).join(open_.select("at").distinct(), "at", "left_semi").join(open_.withColumn("open", F.lit(1)), ["at", "h"], "left")
        under = keyed.select("key", "h", F.expr(f"place & ~{(1 << RUN_AT) - 1}L | coalesce(open, 0)").alias("place"), "sketch")
        rest = _together(under).mapInArrow(_meet(only=True), "h long, other long").distinct()
        rest = later(rest).join(open_.select("h").distinct(), "h", "left_semi").join(pairs, ["h", "other"], "left_anti")
        rest = written(rest, "further-pairs")
        near = near.union(found(rest, _texts(source, lines, rest), "near-further"))
    some = lines.select("h", "first", "n").join(near.distinct().withColumn("near", F.lit(True)), "h", "left").where("n > 1 or near")
    return raw.select("h", "doc_id", "line_no").join(some, "h").where((F.struct("doc_id", "line_no") > F.col("first")) | F.col("near").isNotNull()).select("doc_id", "line_no").distinct()


def repeated_lines(docs: DataFrame, threshold: int = THRESHOLD, min_bytes: int = MIN_BYTES, whole: bool = False) -> DataFrame:
    """(doc_id, line_no, keeper_doc_id, keeper_line_no, distance) of every line that repeats an earlier one.

    Lines end at a newline and count from 0; blanks at their ends don't count, and those under ``min_bytes``
    bytes of UTF-8 are left alone. Order is by (doc_id, line_no). A line is dropped where its first occurrence lies
    elsewhere, or where the text first occurs later than some line within ``threshold`` byte edits; the keeper is
    the earliest line, or its nearest such neighbour (ties: the earliest). Identical lines meet by hash. Others meet
    where one's segment, of ``threshold + 1``, is found in the other near its place; every candidate's distance is computed.
    The texts are read once for the lines and once for their segments, so that segments are never stored with lines.

    With ``whole``, beyond what the SQL has, lines of any length with ink repeat where they are equal, and one word in
    ``WORDS_AN_EDIT`` of the longer line may be edited; ``distance`` is then ``threshold`` and the word edits.

    Reads doc_id and text alone. A null doc_id is left out, a null or empty text has no lines; rows of one
    doc_id with equal lines are one document, those with other lines count beside each other; an empty table gives no rows.
    Keys of very many lines are compared in blocks by several tasks; a long text is split like any.
    """
    source, raw, lines, keys = _read(docs, threshold, min_bytes, whole)
    met = _together(keys).mapInArrow(_meet(), "h long, other long").distinct()
    met = written(met, "line-pairs")
    near = written(_near(met, _texts(source, lines, met), threshold, min_bytes, whole), "near-lines")
    both = near.union(near.select("to", "h", "distance"))
    firsts = lines.select("h", "first")
    ranked = both.join(firsts, "h").join(firsts.select(F.col("h").alias("to"), F.col("first").alias("keeper")), "to").where("keeper < first")
    nearest = ranked.groupBy("h").agg(F.min(F.struct("distance", "keeper")).alias("near"))
    repeats = raw.select("h", "doc_id", "line_no").join(firsts.join(nearest, "h", "left").join(lines.where("n > 1").select("h", F.lit(True).alias("many")), "h", "left").where("many or near is not null"), "h")
    exact = F.struct("doc_id", "line_no") > F.col("first")
    return repeats.where(exact | F.col("near").isNotNull()).select(
        "h", "doc_id", "line_no",
        F.when(F.col("near").isNotNull(), F.col("near.keeper.doc_id")).otherwise(F.col("first.doc_id")).alias("keeper_doc_id"),
        F.when(F.col("near").isNotNull(), F.col("near.keeper.line_no")).otherwise(F.col("first.line_no")).alias("keeper_line_no"),
        F.coalesce("near.distance", F.lit(0)).alias("distance"),
    ).distinct().drop("h")


def without_repeats(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` without the lines that ``repeated_lines`` names, of all lengths and those near by words too; a document left without any ink goes.

    n_chars, where it is a column, is counted anew for the documents that lost lines. Rows without a doc_id and
    texts that lose nothing stay as they are, empty ones too.
    """
    doc, lines, rest = (f"_{uuid.uuid4().hex}" for _ in range(3))
    gone = gone_lines(docs, **kw).groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set("line_no").alias(lines))
    joined = docs.join(gone, docs["doc_id"].cast("long") == F.col(doc), "left")
    left = F.array_join(F.filter(F.split(docs["text"], "\n"), lambda x, i: ~F.array_contains(F.col(lines), i)), "\n")
    untouched = F.col(lines).isNull()
    joined = joined.withColumn(rest, F.when(untouched, docs["text"]).otherwise(left))
    kept = joined.where(untouched | (F.trim(rest) != ""))
    out = {"text": F.col(rest)}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(untouched, F.col("n_chars")).otherwise(F.length(rest).cast("long"))
    return kept.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in docs.columns])


def op8_linededup(spark, sf_dir: str) -> DataFrame:
    return repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Blanks at a line's ends are those of ``_SPACE``; DuckDB's levenshtein counts bytes.
SQL = f"""
with lines as (
  select doc_id, line_no, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as line
  from (select doc_id, unnest(range(len(l))) as line_no, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from documents where doc_id is not null and text is not null))
), eligible as (select distinct doc_id, line_no, line, strlen(line) as n from lines where strlen(line) >= {MIN_BYTES}),
firsts as (select line, n, min(row(doc_id, line_no)) as first from eligible group by line, n),
spread as (select line, n, first, unnest([n - 2, n - 1, n, n + 1, n + 2]) as other_n from firsts),
near as (
  select a.line, min(row(levenshtein(a.line, b.line), b.first)) as best
  from spread a join firsts b on a.other_n = b.n and b.first < a.first
  where levenshtein(a.line, b.line) <= {THRESHOLD} group by a.line
)
select e.doc_id, cast(e.line_no as integer) as line_no,
  case when best is not null then best[2][1] else first[1] end as keeper_doc_id,
  cast(case when best is not null then best[2][2] else first[2] end as integer) as keeper_line_no,
  cast(case when best is not null then best[1] else 0 end as integer) as distance
from eligible e join firsts f on e.line = f.line left join near x on e.line = x.line
where best is not null or row(e.doc_id, e.line_no) > f.first
"""
