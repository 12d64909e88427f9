"""Token counts under a unigram vocabulary: one forward pass over a trie of the distinct pre-tokens."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import TOKENIZER_DIR
from .textkit import PrefixHash, SuffixTable, mix, slices, text_column

PIECES = "piece_bpe_32k.model"
BYTE_SCORE = -25.0
KEPT_WORDS = 400_000
LONG_WORD = 64
MARK = "▁".encode()


class Unigram:
    """Pieces with log probabilities under a Zipf prior on their rank; a byte that no piece covers costs ``BYTE_SCORE``."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        pieces.sort(key=lambda i: -model.get_score(i))
        weight = 1.0 / np.arange(1, len(pieces) + 1)
        self.score = np.log(weight / weight.sum())
        self.entries = {model.id_to_piece(i).encode(): rank for rank, i in enumerate(pieces)}
        self.table = SuffixTable(self.entries)

    def count_word(self, word: bytes) -> int:
        """Tokens on the best path of one pre-token; of equal scores the path with the shorter last token."""
        best, tokens = [0.0], [0]
        for i in range(1, len(word) + 1):
            top, n = best[i - 1] + BYTE_SCORE, tokens[i - 1] + 1
            for length in range(1, min(i, self.table.longest) + 1):
                piece = self.entries.get(word[i - length : i])
                if piece is not None and best[i - length] + self.score[piece] > top:
                    top, n = best[i - length] + self.score[piece], tokens[i - length] + 1
            best.append(top)
            tokens.append(n)
        return tokens[-1]

    def count_trie(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each of the distinct ``words``.

        Words in order are a trie: what a word shares with the one before it is the path they have in
        common, and only nodes that a word is the first to reach are computed. Depth by depth, a node takes
        the best of its ancestors' scores plus the piece between them; a terminal keeps its token count.
        """
        order = sorted(range(len(words)), key=words.__getitem__)
        size = np.fromiter((len(words[i]) for i in order), np.int64, len(words))
        n, depth = len(words), int(size.max())
        buf = np.frombuffer(b"".join(words[i] for i in order), np.uint8)
        start = np.cumsum(size) - size
        cells = np.zeros((n, depth), np.int16)
        inside = np.arange(depth)[None, :] < size[:, None]
        cells[inside] = buf.astype(np.int16) + 1
        shared = np.zeros(n, np.int64)
        shared[1:] = np.argmin(np.concatenate(((cells[1:] == cells[:-1]) & inside[1:], np.zeros((n - 1, 1), bool)), 1), axis=1)
        prefix = PrefixHash(buf)
        sums, down = prefix.sums, prefix.down
        owner = np.zeros((depth + 1, n), np.int32)
        best = np.zeros((depth + 1, n))
        tokens = np.zeros((depth + 1, n), np.int32)
        words_at = np.arange(n, dtype=np.int32)
        for d in range(1, depth + 1):
            new = (shared < d) & (size >= d)
            owner[d] = np.maximum.accumulate(np.where(new, words_at, 0))
            node = np.flatnonzero(new)
            before = owner[d - 1][node] if d > 1 else np.zeros(len(node), np.int32)
            top = (best[d - 1][before] if d > 1 else np.zeros(len(node))) + BYTE_SCORE
            count = (tokens[d - 1][before] if d > 1 else np.zeros(len(node), np.int32)) + 1
            live = np.arange(len(node))
            ends = sums[start[node] + d]
            for length in range(1, min(d, self.table.longest) + 1):
                begin = start[node[live]] + d - length
                value = self.table.get(mix((ends - sums[begin]) * down[begin]))
                hit = np.flatnonzero(value >= 0)
                if len(hit):
                    at = live[hit]
                    from_ = owner[d - length][node[at]]
                    score = best[d - length][from_] + self.score[value[hit]]
                    better = score > top[at]
                    top[at[better]] = score[better]
                    count[at[better]] = tokens[d - length][from_[better]] + 1
                keep = value != -2
                if not keep.any():
                    break
                live, ends = live[keep], ends[keep]
            best[d][node] = top
            tokens[d][node] = count
        out = np.empty(n, np.int64)
        out[np.array(order)] = tokens[size, owner[size, np.arange(n)]]
        return out

    def count(self, words: list[bytes]) -> np.ndarray:
        size = np.fromiter(map(len, words), np.int64, len(words))
        out = np.zeros(len(words), np.int64)
        low = 0
        for high in (16, 32, LONG_WORD):
            group = np.flatnonzero((size > low) & (size <= high))
            low = high
            if len(group):
                out[group] = self.count_trie([words[i] for i in group])
        for i in np.flatnonzero(size > LONG_WORD):
            out[i] = self.count_word(words[i])
        return out


@lru_cache(maxsize=2)
def unigram(path: str) -> Unigram:
    return Unigram(path)


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


class Counter:
    """Pre-token and token counts of texts; what distinct pre-tokens count is kept up to a bounded number."""

    def __init__(self, path: str) -> None:
        self.model = unigram(path)
        self.known: dict[int, int] = {}

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        docs = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = b"\n".join(docs) + b"\n"
        buf = np.frombuffer(data, np.uint8)
        inked = ~_BLANK[buf]
        change = np.flatnonzero(inked[1:] != inked[:-1]) + 1
        if inked[0]:
            change = np.concatenate(([0], change))
        start, end = change[0::2], change[1::2]
        edge = np.concatenate(([0], np.cumsum(np.fromiter(map(len, docs), np.int64, len(docs)) + 1)))
        per = np.diff(np.searchsorted(start, edge))
        h = PrefixHash(buf).span(start, end)
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > KEPT_WORDS:
            self.known = {}
        tokens = np.fromiter((self.known.get(x, 0) for x in distinct.tolist()), np.int64, len(distinct))
        new = np.flatnonzero(tokens == 0)
        if len(new):
            tokens[new] = self.model.count([MARK + data[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist())])
            self.known.update(zip(distinct[new].tolist(), tokens[new].tolist()))
        doc = np.repeat(np.arange(len(texts)), per)
        return per, np.bincount(doc, weights=tokens[inverse], minlength=len(texts)).astype(np.int64)


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for b in batches:
            for first, run_ in slices(text_column(b)):
                words, tokens = counter.count(run_)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(run_)), pa.array(words), pa.array(tokens)], ["doc_id", "n_pretokens", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer_dir: str = TOKENIZER_DIR, pieces: str = PIECES) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of every row of ``docs``.

    Pre-tokens are the runs between ASCII white space, each with the word mark in front; n_tokens counts the tokens
    on their best unigram paths, a byte that no piece covers being a token of its own. A null or empty
    text counts 0 and 0. Repeated rows give repeated rows, a null doc_id stays null, other columns are not read.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(_count(os.path.join(tokenizer_dir, pieces)), "doc_id long, n_pretokens long, n_tokens long")


def op9_tokcount(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
