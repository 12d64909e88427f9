"""BPE encoding by a token automaton compiled from the merge list, and decoding by its arc labels."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import U64, PreTokens, SuffixTable, mix, ragged, slices, text_column

TOKENIZER_DIR = os.environ.get("LOOMGRAPH_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_50k.json"
#: Distinct pre-tokens whose ids one worker keeps between batches.
KEPT_WORDS = 400_000
LONG_WORD = 48


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of bytes in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Deterministic automaton over tokens that accepts exactly the token strings BPE produces.

    It starts with one state in which any byte may follow any other. The gadget of a merge (u, v) -> x,
    in order of rank, gives every state that has arcs u then v an arc x to where v led, and gives the
    arcs u a state of their own, without the arc v. Each token's arcs always lead to one state, so a table
    ``state[token]`` and one bit ``allowed[token, state]`` hold the automaton. States that only a later
    gadget will tell apart are laid out beforehand and moved together until then.
    """

    def __init__(self, path: str) -> None:
        model = json.load(open(path, encoding="utf-8"))["model"]
        alphabet, vocab = _byte_alphabet(), model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        text = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items() if all(c in alphabet for c in t)}
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        made = {x for _, _, x in merges}
        self.size = max(vocab.values()) + 1
        self.entries = {t: i for i, t in text.items() if len(t) == 1 or i in made}
        self.bytes = [b""] * self.size
        for t, i in self.entries.items():
            self.bytes[i] = t
        self._compile(merges)
        self.table = SuffixTable(self.entries)
        self.lens = np.fromiter(map(len, self.bytes), np.int64, self.size)
        self.label_at = np.cumsum(self.lens) - self.lens
        self.labels = np.frombuffer(b"".join(self.bytes), np.uint8)

    def _compile(self, merges: list[tuple[int, int, int]]) -> None:
        born = np.full(self.size, -1)  # the merge that makes a token
        right = np.full(self.size, -1)
        splits: list[list[int]] = [[] for _ in range(self.size)]  # merges in which a token is on the left
        for k, (u, v, x) in enumerate(merges):
            born[x], right[x] = k, v
            splits[u].append(k)

        def version(token: int, before: int) -> tuple[int, int]:
            """State that a token's arcs lead to before a merge: (token whose split made it, splits so far)."""
            while True:
                n = int(np.searchsorted(splits[token], before))
                if n:
                    return token, n
                if right[token] < 0:
                    return -1, 0
                before, token = int(born[token]), int(right[token])

        ids: dict[tuple[int, int], int] = {}
        self.state = np.zeros(self.size + 1, np.int32)
        carrier: list[int] = []
        for token in [*self.entries.values()]:
            key = version(token, len(merges))
            if key not in ids:
                ids[key] = len(carrier)
                carrier.append(token)
            self.state[token] = ids[key]
        start = ids.setdefault((-1, 0), len(carrier))
        if start == len(carrier):
            carrier.append(-1)
        self.state[self.size] = start  # before the first token anything may follow
        n = len(carrier)
        self.states = n
        width = (n + 7) // 8
        allowed = np.zeros((self.size, width), np.uint8)
        reach: dict[int, list[int]] = {}  # token: the states that are, from its birth on, reached by its arcs
        for s, token in enumerate(carrier):
            while token >= 0:
                reach.setdefault(token, []).append(s)
                token = int(right[token])
        blank = np.zeros(width, np.uint8)
        now: dict[int, np.ndarray] = {}

        def bits(token: int) -> np.ndarray:
            flags = np.zeros(width * 8, np.uint8)
            flags[reach.get(token, [])] = 1
            return np.packbits(flags)

        for token in self.entries.values():
            if right[token] < 0:
                allowed[token] = 255
                now[token] = bits(token)
        for u, v, x in merges:
            allowed[x] = allowed[u]
            if x in reach:
                now[x] = bits(x)
                now[v] = now[v] & ~now[x]
            gone = now.get(u, blank)
            allowed[v] &= ~gone
            if u == v:
                allowed[x] &= ~gone
        self.allowed = allowed.ravel()
        self.width = width

    def follows(self, token: np.ndarray, previous: np.ndarray) -> np.ndarray:
        s = self.state[previous]
        return (self.allowed[token.astype(np.int64) * self.width + (s >> 3)] >> (7 - (s & 7)).astype(np.uint8)) & 1 == 1

    def encode_words(self, pre: PreTokens, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids) of the pre-tokens ``which``.

        The token that ends a prefix's encoding is the one arc allowed after the encoding of what
        precedes it, so one pass over byte positions finds the path.
        """
        size = (pre.end - pre.start)[which]
        counts = np.zeros(len(which), np.int64)
        parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        low = 0
        for high in (4, 8, 12, 16, 24, 32, LONG_WORD):
            group = np.flatnonzero((size > low) & (size <= high))
            low = high
            if len(group):
                tokens, n = self._batch(pre, which[group], size[group])
                counts[group] = n
                parts[high] = (group, tokens)
        for g in np.flatnonzero(size > LONG_WORD):
            tokens = self._one(pre.data[pre.start[which[g]] : pre.end[which[g]]])
            counts[g] = len(tokens)
            parts[-1 - g] = (np.array([g]), tokens)
        at = np.cumsum(counts) - counts
        out = np.empty(counts.sum(), np.int32)
        for group, tokens in parts.values():
            n = counts[group]
            out[np.repeat(at[group], n) + ragged(n)] = tokens
        return out, counts

    def _batch(self, pre: PreTokens, which: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(-size, kind="stable")
        start, size_o = pre.start[which][order], size[order]
        most, n = int(size_o[0]), len(order)
        last = np.full((most + 1, n), self.size, np.int32)
        # the hash sums of each byte position of the words, side by side: the words themselves lie far apart
        counts = np.searchsorted(-size_o, -np.arange(most + 1), side="right").tolist()
        sums, down = ([table.take(start[:c] + i) for i, c in enumerate(counts)] for table in (pre.prefix.sums, pre.prefix.down))
        for i in range(1, most + 1):
            live, ends = np.arange(counts[i]), sums[i]
            for length in range(1, min(i, self.table.longest) + 1):
                value = self.table.get(mix((ends - sums[i - length].take(live)) * down[i - length].take(live)))
                token = np.flatnonzero(value >= 0)
                to = live.take(token)
                ids = value.take(token)
                found = np.flatnonzero(self.follows(ids, last[i - length].take(to)))
                last[i][to.take(found)] = ids.take(found)
                found = token.take(found)
                keep = value != -2
                keep[found] = False
                if not keep.any():
                    break
                live, ends = live[keep], ends[keep]
        position = size_o.copy()
        steps = []
        column = np.arange(n)
        while len(column):
            token = last[position[column], column]
            steps.append((column, token))
            position[column] -= self.lens[token]
            column = column[position[column] > 0]
        counts = np.zeros(n, np.int64)
        for column, _ in steps:
            counts[column] += 1
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        final = counts[back]
        at = (np.cumsum(final) - final)[order]
        out = np.empty(final.sum(), np.int32)
        for k, (column, token) in enumerate(steps):
            out[at[column] + counts[column] - 1 - k] = token
        return out, final

    def _one(self, word: bytes) -> np.ndarray:
        """The same path for one long word, a byte at a time."""
        last = [self.size]
        entries, state, allowed, width, longest = self.entries, self.state, self.allowed, self.width, self.table.longest
        for i in range(1, len(word) + 1):
            for length in range(1, min(i, longest) + 1):
                token = entries.get(word[i - length : i])
                if token is not None:
                    s = int(state[last[i - length]])
                    if allowed[token * width + (s >> 3)] >> (7 - (s & 7)) & 1:
                        last.append(token)
                        break
        out, i = [], len(word)
        while i:
            out.append(last[i])
            i -= len(self.bytes[last[i]])
        return np.array(out[::-1], np.int32)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the arc labels of ``ids``."""
        n = self.lens[ids]
        return self.labels[np.repeat(self.label_at[ids], n) + ragged(n)]


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(path)


class Encoder:
    """Texts to ids; distinct pre-tokens are encoded once and kept for later texts up to a bounded number."""

    def __init__(self, path: str) -> None:
        self.machine = automaton(path)
        self._forget()

    def _forget(self) -> None:
        self.known, self.place = np.zeros(0, U64), np.zeros(0, np.int64)  # by hash
        self.at, self.n, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, PreTokens]:
        """(ids end to end, ids per text, the pre-tokens)."""
        pre = PreTokens(texts)
        coded = pa.array(pre.hash).dictionary_encode()
        distinct, inverse = coded.dictionary.to_numpy(), coded.indices.to_numpy()  # by first use
        first = np.flatnonzero(np.diff(np.maximum.accumulate(inverse), prepend=-1))
        if len(self.known) + len(distinct) > KEPT_WORDS:
            self._forget()
        place = np.full(len(distinct), -1)
        if len(self.known):
            to = np.minimum(np.searchsorted(self.known, distinct), len(self.known) - 1)
            place = np.where(self.known[to] == distinct, self.place[to], -1)
        new = np.flatnonzero(place < 0)
        if len(new):
            ids, n = self.machine.encode_words(pre, first[new])
            place[new] = len(self.at) + np.arange(len(new))
            known = np.concatenate((self.known, distinct[new]))
            order = np.argsort(known, kind="stable")
            self.known, self.place = known[order], np.concatenate((self.place, place[new]))[order]
            self.at = np.concatenate((self.at, len(self.ids) + np.cumsum(n) - n))
            self.n = np.concatenate((self.n, n))
            self.ids = np.concatenate((self.ids, ids))
        word = place[inverse]
        n = self.n[word]
        out = self.ids[np.repeat(self.at[word], n) + ragged(n)]
        doc = np.repeat(np.arange(len(texts)), pre.count)
        return out, np.bincount(doc, weights=n, minlength=len(texts)).astype(np.int64), pre


def _list_array(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for b in batches:
            for first, run_ in slices(text_column(b)):
                ids, counts, pre = encoder.encode(run_)
                back = encoder.machine.decode(ids)
                size = np.bincount(np.repeat(np.arange(len(run_)), counts), weights=encoder.machine.lens[ids], minlength=len(run_)).astype(np.int64)
                wrong = np.zeros(len(run_), bool)
                if len(back) != len(pre.buf) or (size != pre.nbytes).any() or not np.array_equal(back, pre.buf):
                    at, to = np.cumsum(size) - size, np.cumsum(pre.nbytes) - pre.nbytes
                    wrong = np.array([not np.array_equal(back[a : a + n], pre.buf[c : c + m]) for a, n, c, m in zip(at, size, to, pre.nbytes)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(run_)), _list_array(ids, counts), pa.array(counts.astype(np.int32)), pa.array(~wrong)], ["doc_id", "token_ids", "n_tokens", "lossless"])

    return run


def encode(docs: DataFrame, tokenizer_dir: str = TOKENIZER_DIR, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, token_ids, n_tokens, lossless) of every row of ``docs``.

    ``lossless`` tells that decoding the ids gave the text back byte for byte. A null text is encoded like an
    empty one: no ids, lossless. Repeated rows give repeated rows; a null doc_id stays null; other columns
    are not read, so their names don't matter.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(_encode(os.path.join(tokenizer_dir, tokenizer)), "doc_id long, token_ids array<int>, n_tokens int, lossless boolean")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(path)
        for b in batches:
            texts = [None if ids is None else machine.decode(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(tokens: DataFrame, tokenizer_dir: str = TOKENIZER_DIR, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, text) of (doc_id, token_ids); null ids give null text, an empty list the empty text."""
    return tokens.select(F.col("doc_id").cast("long"), F.col("token_ids")).mapInArrow(_decode(os.path.join(tokenizer_dir, tokenizer)), "doc_id long, text string")


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
