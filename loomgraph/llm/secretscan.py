"""Secret findings: candidate strings sorted by a random forest trained from labelled findings."""

from __future__ import annotations

import json
import math
import os
import re
import string
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import TOKENIZER, TOKENIZER_DIR

LEAST_LENGTH = 16
LEAST_GIVEN = 4
CONTEXT = 48
LEAST_SCORE = 0.5

FEATURES = [
    "length", "digits", "upper", "lower", "symbols", "hex", "decimal", "uuid", "class_changes", "entropy", "transitions", "worst_transition", "dictionary",
    "quoted", "assigned", "in_path", "test_path", "secret_words", "other_words", "known_prefix", "placeholder", "repeats",
]

_SECRET = re.compile(r"(?i)(secret|token|passw(or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|private|credential|auth|bearer)")
_OTHER = re.compile(r"(?i)(commit|sha-?\d*\b|md5|checksum|digest|uuid|guid|order|invoice|isbn|card|phone|serial|version|build|revision|etag|example|sample|hash of|license|integrity)")
_PREFIX = re.compile(r"^(AKIA|ASIA|ghp_|gho_|github_pat_|xox[abprs]-|sk_live_|sk-|AIza|glpat-|eyJ)")
_HOLD = re.compile(r"(?i)(x{4,}|0{6,}|1234567|abcdef0?123|your|example|changeme|dummy|placeholder|redacted)")
_UUID = re.compile(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
_TEST = re.compile(r"(?i)(test|example|fixture|sample|mock|demo)")

_GIVEN = re.compile(
    rb"""(?i)(?:secret|token|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth[_-]?key)[a-z0-9_-]*["']?(?:[ \t]*(?::=|=>|=|:)[ \t]*|[ \t]+is[ \t]+)"""
    rb"""(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"'`,;]+))"""
)
_CHAR = np.zeros(256, bool)
_CHAR[[ord(c) for c in string.ascii_letters + string.digits + "_+/-="]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


@dataclass
class Finding:
    """A candidate with the text before and after it, and the path of its document."""

    value: str
    before: str
    after: str
    path: str


def candidates(text: bytes) -> list[tuple[int, int]]:
    """Byte spans of what may be a secret, in order.

    These are the values given to a name like those of secrets, quoted or up to the next blank, of ``LEAST_GIVEN`` bytes or more and
    of whatever characters; and anywhere else runs of ASCII letters, digits and ``_+/-=`` of ``LEAST_LENGTH`` bytes or more that hold a digit.
    """
    given = [next(m.span(g) for g in (1, 2, 3) if m.group(g) is not None) for m in _GIVEN.finditer(text)]
    given = [(a, b) for a, b in given if b - a >= LEAST_GIVEN]
    runs = _runs(text)
    if given and runs:
        starts = [a for a, _ in given]
        runs = [(a, b) for a, b in runs if (k := bisect_right(starts, a)) == 0 or given[k - 1][1] < b]
    return sorted({*given, *runs})


def _runs(text: bytes) -> list[tuple[int, int]]:
    """A ``=`` or ``-`` at either end of a run, and a name with its ``=`` in front, are not part of it."""
    if len(text) < LEAST_LENGTH:
        return []
    buf = np.frombuffer(text, np.uint8)
    inside = np.concatenate(([False], _CHAR[buf], [False]))
    change = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = change[0::2], change[1::2]
    long = end - start >= LEAST_LENGTH
    start, end = start[long], end[long]
    digits = np.concatenate(([0], np.cumsum(_DIGIT[buf])))
    out = []
    for a, b in zip(start.tolist(), end.tolist()):
        if digits[b] == digits[a]:
            continue
        run = text[a:b]
        name = re.match(rb"[A-Za-z_][A-Za-z0-9_-]*=(?=[^=])", run)
        if name:
            a += name.end()
        run = text[a:b]
        tail = len(run.rstrip(b"=-")) if not run.endswith(b"=") or len(run) % 4 else len(run)
        head = len(run) - len(run.lstrip(b"=-"))
        a, b = a + head, a + tail
        if b - a >= LEAST_LENGTH and digits[b] > digits[a]:
            out.append((a, b))
    return out


_KIND = {c: 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in map(chr, range(128))}
_SYMBOL = {c: i for i, c in enumerate(string.ascii_lowercase + string.digits)}


@lru_cache(maxsize=1)
def dictionary(path: str) -> tuple[frozenset[str], np.ndarray]:
    """(words of four letters or more, log probabilities of character pairs in them) from a public vocabulary file."""
    vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
    words = {w.lstrip("Ġ").lower() for w in vocab}
    words = {w for w in words if len(w) >= 4 and w.isascii() and w.isalpha()}
    pairs = np.full((37, 37), 0.5)
    for w in sorted(words):
        for a, b in zip(w, w[1:]):
            pairs[_SYMBOL[a], _SYMBOL[b]] += 1
    return frozenset(words), np.log(pairs / pairs.sum(1, keepdims=True))


def describe(f: Finding, known: tuple[frozenset[str], np.ndarray]) -> list[float]:
    """The forest's features of one candidate, in the order of ``FEATURES``."""
    words, pairs = known
    v, n = f.value, max(len(f.value), 1)
    kinds = [_KIND.get(c, 3) for c in v]
    count = [kinds.count(k) / n for k in range(4)]
    freq = [v.count(c) / n for c in set(v)]
    low = v.lower()
    steps = [pairs[_SYMBOL.get(a, 36), _SYMBOL.get(b, 36)] for a, b in zip(low, low[1:])]
    covered, i = 0, 0
    while i < n:
        size = next((k for k in range(min(14, n - i), 3, -1) if low[i : i + k] in words), 0)
        covered += size
        i += size or 1
    before, after = f.before[-CONTEXT:], f.after[:CONTEXT]
    near = before + " " + after
    ahead = before.rstrip(" \t\"'`")
    return [
        float(n), count[2], count[1], count[0], count[3], float(all(c in "0123456789abcdefABCDEF" for c in v)), float(v.isdigit()), float(bool(_UUID.match(v))),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n, -sum(p * math.log2(p) for p in freq), float(np.mean(steps)) if steps else 0.0, float(min(steps)) if steps else 0.0, covered / n,
        float(before[-1:] in "\"'`" and after[:1] in "\"'`" and bool(before) and bool(after)), float(ahead[-1:] in ("=", ":")), float("/" in v or before.endswith(("/", "://", "\\"))), float(bool(_TEST.search(f.path))),
        float(bool(_SECRET.search(near))), float(bool(_OTHER.search(near))), float(bool(_PREFIX.match(v))), float(bool(_HOLD.search(v))), 1 - len(set(v)) / n,
    ]


def labelled_findings(n: int = 3000, seed: int = 11) -> tuple[list[Finding], list[int]]:
    """Labelled findings by which the forest is trained where the caller has none: made from a seed, half of them real.

    Real: keys, tokens and passwords as they stand in settings, code and prose. False: card and phone
    numbers, checksums, commit ids, UUIDs, paths, identifiers, versions, placeholders.
    """
    import random

    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexa, alnum, b64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    syllables = "the and tion er on in en re an ing st nd es at ou eau ment que der sch lich keit ung ción as os do ra".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    prose = lambda k: " ".join(word() for _ in range(k))
    mark = "!@#$%^&*.?"
    short = lambda: r.choice([lambda: pick(alnum + mark, r.randint(8, 15)), lambda: word() + pick(string.digits, r.randint(1, 4)) + word() + pick(mark, r.randint(0, 2)), lambda: pick(string.ascii_letters, r.randint(9, 20)), lambda: word().capitalize() + pick(mark, 1) + pick(string.digits, 3)])()
    out, labels = [], []
    for i in range(n):
        real = i % 2
        before, after, path = prose(r.randint(0, 5)) + " ", " " + prose(r.randint(0, 5)), r.choice(["src%d" % r.randint(0, 30), "app/main.py", "conf/settings.yml", "docs/readme.md", "deploy.sh"])
        if real:
            value = r.choice([lambda: pick(hexa, r.choice([32, 40, 64])), lambda: "AKIA" + pick(string.ascii_uppercase + "234567", 12) + pick(string.digits, 4), lambda: pick(b64, 40), lambda: "ghp_" + pick(alnum, 36), lambda: "sk_live_" + pick(alnum, 24), lambda: pick(alnum, r.randint(18, 48)), lambda: "xoxb-" + pick(string.digits, 12) + "-" + pick(alnum, 24), short, short, short, lambda: "-".join(word() + word() for _ in range(4)), lambda: "-".join(word() for _ in range(r.randint(4, 6)))])()
            name = r.choice(["token", "secret", "api_key", "password", "access_key", "auth_token", "private_key", "credential", "API_KEY", "TOKEN", "client_secret"])
            quote = r.choice(['"', "'", "", '"'])
            before += name + r.choice([" = ", "=", ": ", " is ", " := "]) + quote
            after = quote + after
        else:
            kind = r.randrange(14)
            value = [
                lambda: pick(string.digits, 16), lambda: pick(hexa, r.choice([32, 40, 64])), lambda: "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), lambda: "/".join(word() for _ in range(4)) + "/v%d" % r.randint(1, 30),
                lambda: "_".join(word() for _ in range(4)) + str(r.randint(0, 99)), lambda: "%d-%d-%d-%s-%s" % (r.randint(1, 9), r.randint(0, 99), r.randint(0, 99), word(), word()), lambda: r.choice(["your_token_here_", "xxxxxxxxxxxxxxxx", "EXAMPLE_KEY_0000", "changeme_"]) + str(r.randint(0, 999)),
                lambda: "+" + pick(string.digits, 16), lambda: word() + word() + word() + word() + word() + str(r.randint(0, 9)), lambda: pick(string.digits, r.randint(16, 24)),
                *[lambda: r.choice(["None", "null", "true", "false", "required", "optional", "string", "missing", "invalid", "expired", "basic", "bearer", "${%s}" % word().upper(), "<%s>" % word(), "*" * r.randint(4, 12), "os.environ[", "get_%s()" % word(), "self.%s" % word(), "{{ %s }}" % word(), word(), word() + word(), prose(r.randint(2, 6))])] * 4,
            ][kind]()
            if kind == 1:
                before += r.choice(["commit ", "sha1: ", "md5sum ", "checksum ", "sha256:", "etag: ", "integrity sha512-", "revision "])
            elif kind == 2:
                before += r.choice(["uuid ", "id: ", "guid=", "", "request "])
            elif kind > 9:
                quote = r.choice(['"', "'", "", ""])
                before += r.choice(["password", "token", "secret", "api_key", "auth_token", "credential", "passwd"]) + r.choice([" = ", "=", ": ", " is ", " := "]) + quote
                after = quote + after
            elif kind == 6:
                before += r.choice(["token = ", "api_key: ", "password="])
                path = r.choice([path, "tests/example.py", "docs/sample.md"])
            elif r.random() < 0.3:
                before += r.choice(["order ", "card ", "path: ", "name = ", "version ", "file "])
        out.append(Finding(value, before, after, path))
        labels.append(real)
    return out, labels


@dataclass
class Forest:
    """Trees laid end to end as in a flat table; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        total = np.zeros(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return total / len(self.roots)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 8, least: int = 3, seed: int = 5) -> Forest:
    """Trees on bootstrap samples; each split is the best by Gini among a random subset of the features."""
    rng = np.random.default_rng(seed)
    tries = max(2, int(math.sqrt(x.shape[1])) + 1)
    nodes: list[list] = []
    roots = []

    def grow(rows: np.ndarray, level: int) -> int:
        me, share = len(nodes), float(y[rows].mean())
        nodes.append([0, np.inf, me, me, share])
        if level == depth or len(rows) < 2 * least or share in (0.0, 1.0):
            return me
        best, pick = 1e-9, None
        for f in rng.choice(x.shape[1], tries, replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, t = x[order, f], np.cumsum(y[order])
            k = np.arange(1, len(rows))
            gain = t[:-1] ** 2 / k + (t[-1] - t[:-1]) ** 2 / (len(rows) - k) - t[-1] ** 2 / len(rows)
            gain[(v[1:] == v[:-1]) | (k < least) | (len(rows) - k < least)] = -1
            j = int(np.argmax(gain))
            if gain[j] > best:
                best, pick = gain[j], (int(f), (v[j] + v[j + 1]) / 2)
        if pick is None:
            return me
        goes = x[rows, pick[0]] <= pick[1]
        nodes[me][:2] = pick
        nodes[me][2] = grow(rows[goes], level + 1)
        nodes[me][3] = grow(rows[~goes], level + 1)
        return me

    for _ in range(trees):
        roots.append(grow(rng.integers(0, len(y), len(y)), 0))
    c = list(zip(*nodes))
    return Forest(np.array(c[0], np.int32), np.array(c[1]), np.array(c[2], np.int32), np.array(c[3], np.int32), np.array(c[4]), np.array(roots, np.int32), depth)


def train(findings: list[Finding] | None = None, labels: list[int] | None = None, vocabulary: str | None = None) -> Forest:
    if findings is None:
        findings, labels = labelled_findings()
    known = dictionary(vocabulary or os.path.join(TOKENIZER_DIR, TOKENIZER))
    return fit(np.array([describe(f, known) for f in findings]), np.array(labels, float))


def _scan(forest: Forest, vocabulary: str, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dictionary(vocabulary)
        for b in batches:
            ids, paths, texts = (b.column(i).to_pylist() for i in range(3))
            rows, found = [], []
            for row, text in enumerate(texts):
                data = (text or "").encode("utf-8", "surrogatepass")
                for s, e in candidates(data):
                    rows.append((row, s, e))
                    found.append(Finding(data[s:e].decode("utf-8", "replace"), data[max(0, s - 4 * CONTEXT) : s].decode("utf-8", "ignore"), data[e : e + 4 * CONTEXT].decode("utf-8", "ignore"), paths[row] or ""))
            score = forest.score(np.array([describe(f, known) for f in found])) if found else np.zeros(0)
            out = [(ids[r], s, e - s, xxhash.xxh64(f.value).hexdigest(), float(p)) for (r, s, e), f, p in zip(rows, found, score.tolist()) if p >= least]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.float64()))], ["doc_id", "start_byte", "n_bytes", "fingerprint", "score"])

    return run


def secrets(docs: DataFrame, forest: Forest | None = None, least: float = LEAST_SCORE, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, start_byte, n_bytes, fingerprint, score) of every finding the forest gives ``least`` or more.

    Candidates are described by length, character classes and transitions, dictionary coverage, the path (column
    ``source``, where there is one) and the words around them. ``candidates`` says what is looked at: values given to names of secrets, and
    long runs with a digit; an unnamed password of under 16 bytes is not. The secret itself is not returned, only its hash.
    Null and empty texts have none. Repeated rows are scanned each; a null doc_id stays null; other columns are not read.
    A long text is scanned whole; equal findings at two places are two rows; an empty table gives none.
    """
    vocabulary = vocabulary or os.path.join(TOKENIZER_DIR, TOKENIZER)
    forest = forest or train(vocabulary=vocabulary)
    path = F.col("source").cast("string") if "source" in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), path.alias("path"), F.col("text").alias("text"))
    return rows.mapInArrow(_scan(forest, vocabulary, least), "doc_id long, start_byte long, n_bytes int, fingerprint string, score double")


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
