"""Vectorised text primitives: prefix hashes, words, pre-tokens and hashed vocabularies on numpy arrays."""

from __future__ import annotations

import ctypes
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SLICE_UNITS = 1_000_000

_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**j and BASE**-j modulo 2**64 for j < n, kept between calls."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for key, step in (("up", BASE), ("down", INVERSE)):
            table = np.empty(size, U64)
            table[0], filled = 1, 1
            while filled < size:
                jump = U64(pow(step, filled, 1 << 64))
                table[filled : 2 * filled] = table[:filled] * jump
                filled *= 2
            _POWERS[key] = table
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class PrefixHash:
    """Hash of any span of a buffer in constant time (polynomial prefix sums modulo 2**64)."""

    def __init__(self, units: np.ndarray) -> None:
        self.units = units
        up, self.down = _powers(len(units) + 1)
        self.sums = np.zeros(len(units) + 1, U64)
        np.cumsum((units.astype(U64) + U64(1)) * up[:-1], out=self.sums[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def hash_bytes(value: bytes) -> int:
    """The span hash of one byte string, for tables built outside numpy."""
    return int(PrefixHash(np.frombuffer(value, np.uint8)).span(np.array([0]), np.array([len(value)]))[0])


def hash_many(values: list[bytes]) -> np.ndarray:
    lens = np.fromiter(map(len, values), np.int64, len(values))
    ends = np.cumsum(lens)
    return PrefixHash(np.frombuffer(b"".join(values), np.uint8)).span(ends - lens, ends)


def give_back() -> None:
    """Returns freed memory to the system: workers live on after a task, beside those of other stages."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
    pa.default_memory_pool().release_unused()


def slices(texts: list[str | None], units: int = SLICE_UNITS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) for runs of rows of about ``units`` characters; null reads as empty, no row is cut."""
    first, size, run = 0, 0, []
    for row, text in enumerate(texts):
        run.append(text or "")
        size += len(run[-1])
        if size >= units:
            yield first, run
            first, size, run = row + 1, 0, []
    if run:
        yield first, run
    give_back()


def ragged(lens: np.ndarray) -> np.ndarray:
    """0..len-1 for each length, end to end."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lens, lens)


_WORD = np.zeros(256, bool)
for _c in range(256):
    _WORD[_c] = _c >= 128 or chr(_c).isalnum() or _c == 95


class Words:
    """Lower-cased words of a run of texts: maximal runs of ASCII letters, digits, ``_`` and non-ASCII bytes."""

    def __init__(self, texts: list[str]) -> None:
        docs = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
        buf = np.frombuffer(b"\n".join(docs) + b"\n", np.uint8)
        lens = np.fromiter(map(len, docs), np.int64, len(docs))
        self.doc_start = np.concatenate(([0], np.cumsum(lens + 1)))
        inside = _WORD[buf]
        change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            change = np.concatenate(([0], change))
        self.start, self.end = change[0::2], change[1::2]
        self.hash = PrefixHash(buf).span(self.start, self.end)
        at = np.searchsorted(self.start, self.doc_start)
        self.first, self.count = at[:-1], np.diff(at)
        self.buf = buf

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every k consecutive words of each document, and how many each has.

        A document of 1 to k-1 words has one shingle of all its words; one without words has none.
        """
        h = self.hash
        n = len(h)
        padded = np.concatenate((h, np.zeros(k, U64)))
        total = np.zeros(n, U64)
        for j in range(k):
            total = total * U64(0x9E3779B97F4A7C15) + padded[j : j + n]
        per = np.where(self.count >= k, self.count - k + 1, np.minimum(self.count, 1))
        at = np.repeat(self.first, per) + ragged(per)
        out = total[at]
        ends = np.cumsum(per)
        for d in np.flatnonzero((self.count > 0) & (self.count < k)):
            value = int(self.count[d])
            for x in h[self.first[d] : self.first[d] + self.count[d]].tolist():
                value = (value * 0x9E3779B97F4A7C15 + x) % (1 << 64)
            out[ends[d] - 1] = value
        return mix(out), per


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """0 other, 1 letter, 2 number, 3 white space, by code point."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        table[c] = 1 if kind == "L" else 2 if kind == "N" else 0
    for c in (*range(9, 14), *range(0x1C, 0x20), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        if c not in range(0x1C, 0x20):
            table[c] = 3
    return table


_UTF8_LEN = np.ones(0x110000, np.uint8)
_UTF8_LEN[0x80:] = 2
_UTF8_LEN[0x800:] = 3
_UTF8_LEN[0x10000:] = 4


class PreTokens:
    """Spans of the byte-level pre-split pattern (contractions, letters, numbers, other, white space), by byte offset."""

    def __init__(self, texts: list[str]) -> None:
        joined = "".join(texts)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.data = joined.encode("utf-8", "surrogatepass")
        self.buf = np.frombuffer(self.data, np.uint8)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        doc = np.concatenate(([0], np.cumsum(lens)))
        n = len(code)
        kind = _classes()[code]
        start = np.zeros(n + 1, bool)
        start[doc] = True
        bound = start[:n].copy()  # a document begins here
        start[1:n] |= kind[1:] != kind[:-1]
        space = kind == 3
        # The last of a run of white space before something else in the same document stands alone, or
        # joins what follows where it is a plain blank.
        follows = np.zeros(n, bool)
        follows[:-1] = space[:-1] & ~space[1:] & ~bound[1:]
        tail = np.flatnonzero(follows)
        start[tail] = True
        start[tail[code[tail] == 32] + 1] = False
        quote = np.flatnonzero((code == 39) & start[:n])
        if len(quote):
            c = np.concatenate((code, np.zeros(3, np.uint32)))
            end = doc[np.searchsorted(doc, quote, side="right")]
            one, two = c[quote + 1], c[quote + 2]
            short = np.isin(one, [ord(x) for x in "stmd"]) & (quote + 1 < end)
            long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))) & (quote + 2 < end)
            for at, size in ((quote[short], 2), (quote[long], 3)):
                start[at + 1] = False
                inside = at + size < n
                nxt = at[inside] + size
                # what is left of the run of letters begins anew; a run that starts here already does
                start[nxt[(kind[nxt] == 1) | start[nxt]]] = True
        at = np.flatnonzero(start[:n])
        offset = np.concatenate(([0], np.cumsum(_UTF8_LEN[code], dtype=np.int64)))
        self.start = offset[at]
        self.end = np.concatenate((self.start[1:], offset[-1:])) if len(at) else self.start
        where = np.searchsorted(at, doc)
        self.count = np.diff(where)
        self.nbytes = np.diff(offset[doc])
        self.prefix = PrefixHash(self.buf)
        self.hash = self.prefix.span(self.start, self.end)


class HashTable:
    """64-bit keys to int32 values: open addressing, looked up for whole arrays at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys = np.zeros(size, U64)
        self.values = np.full(size, -2, np.int32)
        todo_k, todo_v, step = keys.astype(U64), values.astype(np.int32), 0
        self.probes = 0
        slot = self._slot(todo_k)
        while len(todo_k):
            self.probes += 1
            at = (slot + step) & (size - 1)
            free = self.values[at] == -2
            _, first = np.unique(at, return_index=True)
            take = np.zeros(len(at), bool)
            take[first] = True
            take &= free
            self.keys[at[take]], self.values[at[take]] = todo_k[take], todo_v[take]
            todo_k, todo_v, slot = todo_k[~take], todo_v[~take], slot[~take]
            step += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> U64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key; -2 where it is absent."""
        at = self._slot(keys)
        out = self.values[at]
        hit = (self.keys[at] == keys) | (out == -2)
        todo = np.flatnonzero(~hit)
        step = 1
        while len(todo):
            at2 = (at[todo] + step) & (len(self.keys) - 1)
            v = self.values[at2]
            done = (self.keys[at2] == keys[todo]) | (v == -2)
            out[todo[done]] = v[done]
            todo = todo[~done]
            step += 1
        return out


class SuffixTable(HashTable):
    """Vocabulary strings and all their suffixes by hash: id, or -1 for a suffix that is no entry itself."""

    def __init__(self, entries: dict[bytes, int]) -> None:
        known = dict.fromkeys((e[i:] for e in entries for i in range(len(e))), -1)
        known.update(entries)
        self.longest = max(map(len, entries))
        super().__init__(hash_many(list(known)), np.fromiter(known.values(), np.int64, len(known)))


def text_column(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
