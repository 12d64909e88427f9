"""Token ids as compressed blocks: id predictions of order 0 to 2, mixed in fixed point, drive a range coder."""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import TOKENIZER, TOKENIZER_DIR, Encoder
from .textkit import SLICE_UNITS, U64, ragged, slices, text_column

#: Ids in a block, but for the last of a row.
BLOCK_TOKENS = 16_384
#: Documents fill a row until it holds this many ids; a longer document is a row of its own.
ROW_TOKENS = 65_536
#: Hit rates and weights change after this many ids of a block, at a fixed step.
LEARN = 128
#: Frequencies are those before the last multiple of this many ids (128 at first).
SNAPSHOT = 256
#: Ids that one worker gathers before it codes their blocks side by side, and of these, ids whose models it holds at a time.
GROUP_TOKENS = 3_000_000
MODEL_TOKENS = 1_000_000
#: Range coders side by side in a block.
STREAMS = 8

STATES = 5  # of a context: never seen, then the outcomes of its last two predictions
ONE = 65536
LIMIT = 255
#: Width of the step that tells which prediction was right: with probabilities within 32 of 2**16, and these for an id new to the block, no part is empty.
TOTAL, FRESH = 1 << 26, (4096, 61440)
STEP_SHIFT = 15
#: Starting weights of the inputs: hit rate of the order, that of the other order, frequency.
WEIGHTS = ([0.7, 0.3, 0.1], [0.8, 0.0, 0.2])
_LOW32 = U64(0xFFFFFFFF)
_ALL = (1 << 64) - 1

_SQUASH = np.clip(np.rint(65536 / (1 + np.exp(-np.arange(-2047, 2048) / 256))), 32, 65504).astype(np.int64)
_STRETCH = np.clip(np.rint(np.log((np.arange(4096) + 0.5) / (4095.5 - np.arange(4096))) * 256), -2047, 2047).astype(np.int64)


_SQUASHED = _SQUASH.astype(float)
#: What makes a mixed sum's place in that table.
MIDDLE = 2047 << 16
#: Pairs of states and whether the predictions agree, by block.
KEYS = 2 * STATES * STATES
#: Courses of an id through a step of ``_events``, and the first of each: order 2 is right; it fails, and order 1 agrees, so the id is known or new;
#: order 1 fails too, the id is new or known; order 1 is right; order 1 alone is right, fails, id known or new; no order has a prediction, id new or known.
COURSES = 11


def _course(flags: int) -> int:
    right2, right1, agree, tried2, tried1, new = (flags >> k & 1 for k in range(6))
    if right2:
        return 0
    if tried2:
        return 1 + new if agree else 5 if right1 else 4 - new
    return (6 if right1 else 7 + new) if tried1 else 10 - new


_COURSE = np.array([_course(flags) for flags in range(64)], np.int8)


def is_snapshot(place: int) -> bool:
    return place % SNAPSHOT == 0 or place == 128


def prior(size: int) -> np.ndarray:
    """Cumulative widths by which an id is coded that its block has not had: they fall with the id, as ids are ranks of merges."""
    if size >= 1 << 31:
        raise ValueError("ids must be below 2**31")
    return np.concatenate(([0], np.cumsum(1 + (1 << 20) // (np.arange(size, dtype=np.int64) + 256))))


def _sorted(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(places by key then place, whether a key begins there)."""
    both = key.astype(U64)
    both <<= U64(bits)
    both |= np.arange(len(key), dtype=U64)
    both.sort()
    order = (both & U64((1 << bits) - 1)).astype(np.int32)
    both >>= U64(bits)
    new = np.ones(len(key), bool)
    np.not_equal(both[1:], both[:-1], out=new[1:])
    return order, new


def _context(own: np.ndarray, order: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, ...]:
    """(what came last in the same context, whether it comes again, state) from the order of the contexts."""
    sorted_ = own[order]
    known = ~new
    right = np.zeros(len(own), bool)
    np.equal(sorted_[1:], sorted_[:-1], out=right[1:])
    right &= known
    # the outcomes of the last two predictions stand before a place, where its context has begun by then
    state = known.astype(np.int8)
    state[1:] += 2 * (right[:-1] & known[1:]).view(np.int8)
    state[2:] += (right[:-2] & known[1:-1] & known[2:]).view(np.int8)
    both = np.empty(len(own), np.int8)
    both[order] = 2 * state + right
    guess = np.empty(len(own), np.int32)
    guess[order[1:]] = sorted_[:-1]
    guess[order[:1]] = 0
    return guess, (both & 1).view(bool), both >> 1


def _mixed(fixed: np.ndarray, weight: np.ndarray, key: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Mixed probabilities: the inputs that a key settles, ``fixed``, and the frequency; ``take`` cuts off what is beyond the table."""
    total = weight.take(key)
    total *= f
    total += fixed.take(key)
    total *= 1 / ONE
    return _SQUASHED.take(total.astype(np.intp), mode="clip")


def _narrow(low: np.ndarray, width: np.ndarray, p: np.ndarray, yes: int, no: int) -> None:
    """Narrows the intervals from ``yes`` to ``no`` to the lower ``p`` of 2**16, the others to what is above; whole numbers held as floats."""
    part = width * p
    part *= 1 / ONE
    np.floor(part, out=part)
    low[:yes] += part[:yes]
    width[:yes] -= part[:yes]
    low[no:] += part[no:]
    width[no:] -= part[no:]
    width[yes:no] = part[yes:no]


def _events(ids: np.ndarray, sizes: np.ndarray, size: int, pairs: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Puts low and width, in one word, and total of each coding step into ``pairs`` and ``totals``, block by block; gives the steps of each block, filled up with idle ones to share out among its streams.

    Sums are of whole numbers below 2**53, so floats hold them exactly.
    """
    n, blocks = len(ids), len(sizes)
    bits = (n + 1).bit_length()
    if 3 * bits > 64:
        raise ValueError("too many ids at a time")
    start = np.cumsum(sizes) - sizes
    block = np.repeat(np.arange(blocks, dtype=np.int32), sizes)
    place = ragged(sizes).astype(np.int32)
    seen = np.zeros(size, np.int32)
    seen[ids] = 1
    names = int(seen.sum())
    order, new = _sorted(block * np.int64(names) + (np.cumsum(seen) - 1)[ids], bits)
    first = np.empty(n, np.int32)
    heads = np.flatnonzero(new)
    first[order] = np.repeat(order[heads], np.diff(heads, append=n))
    fresh = np.cumsum(first == np.arange(n, dtype=np.int32), dtype=np.int32)
    nth = (fresh - np.repeat(fresh[start], sizes))[first]  # ids of a block by first use
    wide = int(nth.max()) + 1
    if blocks * (wide + 1) >= 1 << 31:
        raise ValueError("too many ids and blocks at a time")
    own = block * np.int32(wide) + nth
    key = np.empty(n, np.int64)
    key[1:] = own[:-1]
    key[start] = blocks * wide + np.arange(blocks)  # what precedes a block
    order, new = _sorted(key, bits)
    guess1, right1, s1 = _context(own, order, new)
    key[order] = np.cumsum(new) - 1
    key *= wide + 1
    key[2:] += nth[:-2]
    for early in (start, start[sizes > 1] + 1):
        key[early] += wide - np.where(early > 1, nth[np.maximum(early - 2, 0)], 0)
    order, new = _sorted(key, bits)
    guess2, right2, s2 = _context(own, order, new)
    # What is tried, and whether it is right, does not depend on what was learnt. So ids are put in order of step, then of their
    # course through it, then block, then place: each set of ids that goes through the same is a slice.
    agree = (s2 > 0) & (guess1 == guess2)
    step = place // np.int32(LEARN)
    snaps = np.array([max((p for p in (128, j * LEARN // SNAPSHOT * SNAPSHOT) if p <= j * LEARN), default=0) for j in range(int(step.max()) + 1)], np.int32)
    course = step * np.int32(COURSES)
    known_from = place[first]
    flags = right2 | right1.view(np.int8) << 1 | agree.view(np.int8) << 2 | (s2 > 0).view(np.int8) << 3 | (s1 > 0).view(np.int8) << 4 | (known_from >= snaps[step]).view(np.int8) << 5
    course += _COURSE[flags]
    cuts = np.concatenate(([0], np.cumsum(np.bincount(course, minlength=len(snaps) * COURSES)))).tolist()
    by = np.argsort(course.astype(np.min_scalar_type(len(snaps) * COURSES)), kind="stable").astype(np.int32)
    most = np.maximum.accumulate(np.maximum.reduceat(nth[by], cuts[:-1:COURSES])).tolist()  # ids of a block so far, less one
    own, guess1, guess2, x = own[by], guess1[by], guess2[by], ids[by]
    key = ((s2 * np.int8(2 * STATES) + s1 * np.int8(2) + agree).astype(np.int64) * blocks + block)[by]
    del order, new, fresh, first, known_from, nth, place, step, course, flags, agree, right1, right2, s1, s2, block
    shape = (STATES, STATES, 2, blocks)  # of the keys: state of order 2, of order 1, whether they agree, block
    count, upto = np.zeros((2, blocks, wide), np.int32)
    table, upto_ = count.reshape(-1), upto.reshape(-1)
    # of order 2, order 1 and novelty: adaptive probabilities by context state and block, and weights that mix them with other inputs
    hit, tried = np.zeros((2, 3, STATES, blocks), np.int64)
    weight = np.empty((2, 3, STATES, blocks), np.int64)
    weight[:] = np.array([[int(w * ONE) for w in start_] for start_ in WEIGHTS])[:, :, None, None]
    pair, pair2 = np.empty((2, n), U64)  # low and width of the first coding step, of the second where there is one
    total2 = np.empty(n, np.uint32)
    twice = np.zeros(n, bool)
    prior_at = prior(size)
    taken, keys = 0, KEYS * blocks
    fixed, scale, sums = np.empty((2, *shape)), np.empty((2, *shape)), np.empty((12, *shape))
    rate0, flat = np.empty(shape), sums.reshape(12, keys)
    for j, snap in enumerate(snaps.tolist()):
        a, d1, d2, c1, c2, b, e, f1, f2, g1, g2, end = cuts[j * COURSES : (j + 1) * COURSES + 1]
        if is_snapshot(j * LEARN):
            np.add.at(table, own[taken:a], np.int32(1))
            so_far = most[j - 1] + 1 if j else 0
            taken = a
            np.cumsum(count[:, :so_far], axis=1, dtype=np.int32, out=upto[:, :so_far])
            stretch = _STRETCH[np.minimum((np.arange(snap + 1) << 16) // (snap or ONE), 65535) >> 4].astype(float)
        rate = ((2 * hit + 1) << 16) // (2 * tried + 2)  # from 128 to 65408, as no more than LIMIT are tried
        x2, x1 = _STRETCH.take(rate[:2] >> 4)
        # what the other order gives: order 1 counts against order 2 where they differ; order 2 gives nothing where it has none
        other = np.stack((-x1, x1), axis=1)
        x2_or_0 = x2.copy()
        x2_or_0[0] = 0
        fixed[0] = (weight[0, 0] * x2 + MIDDLE)[:, None, None] + weight[0, 1][:, None, None] * other
        fixed[1] = ((weight[1, 0] * x1 + MIDDLE) + weight[1, 1] * x2_or_0[:, None])[:, :, None]
        scale[0], scale[1] = weight[0, 2][:, None, None], weight[1, 2][:, None]
        rate0[:] = np.clip(rate[2], *FRESH)[:, None]
        lo, w = np.zeros(end - a), np.full(end - a, float(TOTAL))
        for kind, (u, yes, no, v, guess) in enumerate(((a, a, d1, e, guess2), (c1, b, f1, g1, guess1))):
            at, rows = key[u:v], flat[5 * kind :]
            f = stretch.take(table.take(guess[u:v]))
            p = _mixed(fixed[kind].reshape(-1), scale[kind].reshape(-1), at, f)
            _narrow(lo[u - a : v - a], w[u - a : v - a], p, yes - u, no - u)
            error = np.negative(p, out=p)
            error[yes - u : no - u] += ONE
            f *= error
            rows[0], rows[1] = np.bincount(key[yes:no], minlength=keys), np.bincount(at, minlength=keys)
            rows[2], rows[3] = np.bincount(at, error, keys), np.bincount(at, f, keys)
        flat[10:] = 0
        for u, yes, no, v in ((d1, d2, c2, b), (f1, f2, g2, end)):
            at = key[u:v]
            _narrow(lo[u - a : v - a], w[u - a : v - a], rate0.take(at), yes - u, no - u)
            flat[10] += np.bincount(key[yes:no], minlength=keys)
            flat[11] += np.bincount(at, minlength=keys)
            twice[u:v] = True
            low2 = prior_at.take(x[yes:no])
            pair2[yes:no] = low2 | (prior_at.take(x[yes:no] + 1) - low2) << 32
            total2[u:v] = snap
            total2[yes:no] = prior_at[-1]
            for known in (slice(u, yes), slice(no, v)):
                used = table.take(own[known]).astype(np.int64)
                pair2[known] = (upto_.take(own[known]) - used) | used << 32
        pair[a:end] = w
        pair[a:end] <<= U64(32)
        pair[a:end] |= lo.astype(U64)
        np.multiply(sums[2], other, out=sums[4])
        np.multiply(sums[7], x2_or_0[:, None, None], out=sums[9])
        of2, of1 = sums[:5].sum((2, 3)).astype(np.int64), sums[5:].sum((1, 3)).astype(np.int64)
        for kind, (sum_, x_) in enumerate(((of2, x2), (of1, x1))):
            weight[kind] += np.stack((sum_[2] * x_, sum_[4], sum_[3])) >> STEP_SHIFT
        hit += np.stack((of2[0], of1[0], of1[5]))
        tried += np.stack((of2[1], of1[1], of1[6]))
        old = tried > LIMIT
        hit >>= old
        tried >>= old
    del own, guess1, guess2, x, key
    counted = np.ones(n, np.int8)
    counted[by[twice]] = 2
    coded, each = np.add.reduceat(counted, start, dtype=np.int64), streams_of(sizes)
    padded = -(-coded // each) * each
    to = np.cumsum(counted, dtype=np.int32)
    to -= counted
    to += np.repeat((np.cumsum(padded - coded) - (padded - coded)).astype(np.int32), sizes)
    to = to[by]
    idle = padded - coded
    at = np.repeat(np.cumsum(padded) - idle, idle) + ragged(idle)
    totals[: int(padded.sum())] = TOTAL
    pairs[at], totals[at] = U64(1 << 32), 1
    pairs[to] = pair
    to = to[twice] + 1
    pairs[to], totals[to] = pair2[twice], total2[twice]
    return padded


def streams_of(n):
    """Coders that share a block of ``n`` ids, each taking every so manieth step: small blocks have one."""
    return np.where(n >= STREAMS * 512, STREAMS, 1)


def encode_blocks(ids: np.ndarray, sizes: np.ndarray, size: int) -> list[bytes]:
    """Payload of each block of ``sizes`` ids, all below ``size``; the coders run over all streams of all blocks at once."""
    if not len(sizes):
        return []
    # the models run over some blocks at a time, which bounds their memory; the coders over all, which spreads their steps
    ends = np.cumsum(sizes)
    room = 2 * len(ids) + STREAMS * len(sizes)  # of which what isn't needed isn't touched
    pairs, totals = np.empty(room, U64), np.empty(room, np.uint32)
    counts, first, used = [], 0, 0
    while first < len(sizes):
        start = int(ends[first] - sizes[first])
        last = max(first + 1, int(np.searchsorted(ends, start + MODEL_TOKENS, side="right")))
        counts.append(_events(ids[start : ends[last - 1]].astype(np.int64), sizes[first:last], size, pairs[used:], totals[used:]))
        used += int(counts[-1].sum())
        first = last
    n, each = np.concatenate(counts), streams_of(sizes)
    rounds = n // each
    order = np.argsort(-rounds, kind="stable")  # the live coders are always the first ones
    lanes, most = int(each.sum()), int(rounds.max())
    column = np.empty(len(sizes), np.int64)
    column[order] = np.cumsum(each[order]) - each[order]
    at = np.repeat((np.cumsum(n) - n)[order], each[order]) + ragged(each[order])
    jump = np.repeat(each[order], each[order])
    low = np.zeros(lanes, U64)
    span = np.full(lanes, 0xFFFFFFFFFFFFFFFF, U64)
    words = np.zeros((most + 3, lanes), np.uint32)  # the coders' nth words are neighbours
    flat, write = words.reshape(-1), np.arange(lanes)
    live = np.searchsorted(-np.repeat(rounds[order], each[order]), -np.arange(1, most + 1), side="right").tolist()
    limit, half, one = U64(1 << 32), U64(32), U64(1)
    for m in live:
        lo, sp, now = low[:m], span[:m], at[:m]
        pair = pairs.take(now)
        sp //= totals.take(now)
        lo += (pair & _LOW32) * sp
        pair >>= half
        sp *= pair
        now += jump[:m]
        need = (sp < limit).nonzero()[0]
        if len(need):
            a, r = lo.take(need), sp.take(need)
            top = a >> half
            # an interval across a word's edge is cut at the edge, so that the word is settled
            across = (a + r - one) >> half != top
            if across.any():
                r = np.where(across, limit - (a & _LOW32), r)
            to = write.take(need)
            flat[to] = top
            write[need] = to + lanes
            lo[need] = a << half
            sp[need] = r << half
    flat[write] = low >> half
    flat[write + lanes] = low & _LOW32
    filled = write // lanes + 2
    words = words[: int(filled.max())].T.astype(">u4", order="C")
    coded = [words[r, :k].tobytes() for r, k in enumerate(filled.tolist())]
    # the lengths of all streams but the last come first
    return [np.array([len(c) for c in own[:-1]], ">u4").tobytes() + b"".join(own) for own in (coded[c : c + k] for c, k in zip(column.tolist(), each.tolist()))]


class Coder:
    """The reading end of one stream."""

    def __init__(self, payload: bytes) -> None:
        self.words = np.frombuffer(payload, ">u4").tolist() + [0, 0]
        self.code, self.taken = self.words[0] << 32 | self.words[1], 2
        self.low, self.span = 0, _ALL

    def take(self, a: int, w: int, r: int) -> None:
        self.low, self.span = self.low + a * r, w * r
        if self.span < 1 << 32:
            if self.low >> 32 != (self.low + self.span - 1) >> 32:
                self.span = (1 << 32) - (self.low & 0xFFFFFFFF)
            self.low, self.span = (self.low << 32) & _ALL, self.span << 32
            self.code = (self.code << 32 & _ALL) | self.words[self.taken]
            self.taken += 1


def decode_block(payload: bytes, n: int, size: int) -> np.ndarray:
    """The ``n`` ids of one payload: the models of ``_events`` one id at a time, in the same whole numbers."""
    streams = int(streams_of(n))
    head = np.frombuffer(payload[: 4 * (streams - 1)], ">u4").tolist()
    body, coders = payload[4 * (streams - 1) :], []
    for length in [*head, len(body)]:
        coders.append(Coder(body[:length]))
        body = body[length:]
    turn = 0
    squash, stretch, prior_at = _SQUASH.tolist(), _STRETCH.tolist(), prior(size).tolist()
    hit, tried = ([[0] * STATES for _ in range(3)] for _ in range(2))
    weight = [[[int(w * ONE) for w in start] for _ in range(STATES)] for start in WEIGHTS]
    step: list[list] = [[], [], []]
    rate = [[32768] * STATES for _ in range(3)]
    ids: list[int] = []
    memory: list[dict] = [{}, {}]  # context: (predicted id, last outcome, the one before)
    nth: dict[int, int] = {}
    names: list[int] = []
    count: list[int] = []
    table: list[int] = []
    upto: list[int] = []
    snap = v = lo = w = 0

    def coder() -> Coder:
        nonlocal turn
        turn += 1
        return coders[(turn - 1) % streams]

    def split(p: int) -> bool:
        nonlocal lo, w
        part = w * p >> 16
        yes = v < lo + part
        if yes:
            w = part
        else:
            lo, w = lo + part, w - part
        return yes

    def mixed(kind: int, state: int, inputs: list[int]) -> bool:
        a = weight[kind][state]
        p = squash[min(max(sum(x * y for x, y in zip(a, inputs)) >> 16, -2047), 2047) + 2047]
        yes = split(p)
        step[kind].append((state, yes, p, inputs))
        return yes

    def frequency(x: int) -> int:
        at = nth[x]
        return stretch[min(((table[at] if at < len(table) else 0) << 16) // (snap or ONE), 65535) >> 4]

    def learn() -> None:
        for kind in range(3):
            total: dict[int, list[int]] = {}
            for state, yes, p, inputs in step[kind]:
                hit[kind][state] += yes
                tried[kind][state] += 1
                if inputs is not None:
                    t = total.setdefault(state, [0] * 3)
                    error = (yes << 16) - p
                    for i, x in enumerate(inputs):
                        t[i] += error * x
            for state, t in total.items():
                weight[kind][state] = [w + (x >> STEP_SHIFT) for w, x in zip(weight[kind][state], t)]
            for state in range(STATES):
                if tried[kind][state] > LIMIT:
                    hit[kind][state] >>= 1
                    tried[kind][state] >>= 1
                rate[kind][state] = min(max(((2 * hit[kind][state] + 1) << 16) // (2 * tried[kind][state] + 2), 32), 65504)
            step[kind].clear()

    for place in range(n):
        if place % LEARN == 0:
            if place:
                learn()
            if is_snapshot(place):
                table, snap = count[:], place
                upto = [0, *accumulate(table)]
        one = ids[-1] if ids else size
        two = ids[-2] if place > 1 else size
        m1, m2 = memory[0].get(one), memory[1].get((two, one))
        g1, s1 = (m1[0], 1 + 2 * m1[1] + m1[2]) if m1 else (0, 0)
        g2, s2 = (m2[0], 1 + 2 * m2[1] + m2[2]) if m2 else (0, 0)
        x, fresh = None, False
        c = coder()
        r = c.span // TOTAL
        v, lo, w = (c.code - c.low) // r, 0, TOTAL
        if s2:
            below = 0 if not s1 else stretch[rate[1][s1] >> 4] * (1 if g1 == g2 else -1)
            if mixed(0, s2, [stretch[rate[0][s2] >> 4], below, frequency(g2)]):
                x = g2
        if x is None and s1 and not (s2 and g1 == g2):
            if mixed(1, s1, [stretch[rate[1][s1] >> 4], stretch[rate[0][s2] >> 4] if s2 else 0, frequency(g1)]):
                x = g1
        if x is None:
            fresh = split(min(max(rate[2][s1], FRESH[0]), FRESH[1]))
            step[2].append((s1, fresh, 0, None))
        c.take(lo, w, r)
        if x is None:
            steps, c = prior_at if fresh else upto, coder()
            r = c.span // steps[-1]
            at = min(bisect_right(steps, (c.code - c.low) // r) - 1, len(steps) - 2)
            c.take(steps[at], steps[at + 1] - steps[at], r)
            x = at if fresh else names[at]
        for k, key, m in ((0, one, m1), (1, (two, one), m2)):
            memory[k][key] = (x, bool(m and m[0] == x), bool(m and m[1]))
        if x not in nth:
            nth[x] = len(names)
            names.append(x)
            count.append(0)
        count[nth[x]] += 1
        ids.append(x)
    return np.array(ids, np.int32)


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<i4").tobytes())


SCHEMA = "doc_ids array<long>, n_tokens array<int>, crc32 array<long>, block_bytes array<int>, payload binary"


def pack(docs: list[tuple[int | None, np.ndarray]], size: int) -> pa.RecordBatch:
    """Rows of whole documents in order, their ids cut into blocks."""
    rows: list[list[int]] = [[]]
    held = 0
    for i, (_, ids) in enumerate(docs):
        if rows[-1] and held + len(ids) > ROW_TOKENS:
            rows.append([])
            held = 0
        rows[-1].append(i)
        held += len(ids)
    merged = [np.concatenate([docs[i][1] for i in r]) for r in rows]
    cuts = [[m[k : k + BLOCK_TOKENS] for k in range(0, len(m), BLOCK_TOKENS)] for m in merged]
    blocks = [c for row in cuts for c in row]
    payloads = iter(encode_blocks(np.concatenate(merged), np.fromiter(map(len, blocks), np.int64, len(blocks)), size) if blocks else [])
    coded = [[next(payloads) for _ in row] for row in cuts]
    columns = [
        [[docs[i][0] for i in r] for r in rows], [[len(docs[i][1]) for i in r] for r in rows], [[checksum(c) for c in row] for row in cuts],
        [[len(p) for p in row] for row in coded], [b"".join(row) for row in coded],
    ]
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_ids", "n_tokens", "crc32", "block_bytes", "payload"])


def unpack(doc_ids: list[int | None], n_tokens: list[int], crc32: list[int], block_bytes: list[int], payload: bytes, size: int) -> list[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of a row; ValueError where a block's checksum doesn't match."""
    total, parts, at = sum(n_tokens), [], 0
    for k, (crc, n) in enumerate(zip(crc32, block_bytes)):
        ids = decode_block(payload[at : at + n], min(BLOCK_TOKENS, total - k * BLOCK_TOKENS), size)
        if checksum(ids) != crc:
            raise ValueError("block checksum does not match")
        parts.append(ids)
        at += n
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    ends = np.cumsum(n_tokens).tolist()
    return [(d, ids[e - n : e]) for d, n, e in zip(doc_ids, n_tokens, ends)]


def _pack(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        size = encoder.machine.size
        held, count = [], 0
        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for first, texts in slices(text_column(b), 2 * SLICE_UNITS):
                ids, counts, _ = encoder.encode(texts)
                held += zip(doc_ids[first : first + len(texts)], np.split(ids, np.cumsum(counts)[:-1]))
                count += len(ids)
                if count > GROUP_TOKENS:
                    yield pack(held, size)
                    held, count = [], 0
        if held:
            yield pack(held, size)

    return run


def token_blocks(docs: DataFrame, tokenizer_dir: str = TOKENIZER_DIR, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_ids, n_tokens, crc32, block_bytes, payload): the token ids of every document in compressed blocks.

    A row holds whole documents, its ids cut into blocks. A block is coded from a model of its own and can be decoded
    by itself; ``crc32`` is of its ids as little-endian int32. In a block, the ids that last followed the two and the one id before are tried in turn,
    each by a bit whose probability mixes all three orders; an id that neither gives is coded by its frequency, or by a fixed prior where it is new.
    Null and empty texts have no ids but keep their place; repeated rows and null doc_ids are coded like
    any; other columns are not read; an empty table gives no rows.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(_pack(os.path.join(tokenizer_dir, tokenizer)), SCHEMA)


def _unpack(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                docs = unpack(*row, size)
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([i.tolist() for _, i in docs], pa.list_(pa.int32()))], ["doc_id", "token_ids"])

    return run


def token_ids(blocks: DataFrame, size: int) -> DataFrame:
    """(doc_id, token_ids) of the documents in ``token_blocks``' rows, with ids below ``size``."""
    return blocks.select("doc_ids", "n_tokens", "crc32", "block_bytes", "payload").mapInArrow(_unpack(size), "doc_id long, token_ids array<int>")


def op3_tokenblocks(spark, sf_dir: str) -> DataFrame:
    return token_blocks(spark.read.parquet(f"{sf_dir}/documents.parquet"))
