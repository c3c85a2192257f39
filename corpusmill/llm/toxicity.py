"""Toxicity: embeddings of a text's words and their character n-grams, averaged into a
linear softmax; both layers are trained together, in numpy on the driver.

A word's vector is the mean of those of its own bucket and of its character
n-grams' buckets, so a misspelt word shares n-gram vectors with the word it
stands for. Words of more than ``LONGEST`` bytes are cut into overlapping blocks, so
that each of their n-grams is in one; in scripts without spaces each character and
the next one are a word. The words of each segment of ``SEGMENT`` words are averaged (a short
one is filled up with zeros) and a text scores as its hottest segment, in
training too: one insult in a long text counts as much as in a short one. Training takes at most
``sample`` labelled rows of ``chars`` characters, those of the smallest md5 of their id, and none whose
crc32(id as text) mod 5 is 0; the model has ``BUCKETS`` x ``DIM`` numbers,
whatever the corpus. As both layers are linear, a word adds one number to its
segment's score, which tasks memoise.

A null or empty text, or one without a word, scores what the bias gives. Rows
with a null id are scored, not held out and never trained on. Without labels of
both classes all texts score 0. Repeated rows get the same row each; an empty
table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BUCKETS, DIM, GRAMS = 1 << 17, 8, (3, 4, 5)
#: The largest numbers of labelled rows to train on, and of their texts' characters.
SAMPLE, SAMPLE_CHARS = 4000, 30_000_000
#: Steps of training at least.
STEPS = 280
EPOCHS, WARM_UP, BATCH, RATE, DECAY, SEED = 14, 2, 200, 0.03, 0.1, 7
#: The share of the training texts that hold a bucket at least, else it stays at zero.
MIN_SHARE = 0.005
#: Words that are averaged at a time; the average is scaled, so that one word can decide.
SEGMENT, SCALE = 3, 4.0
FOLDS = 5
#: A-Z become lower case, all other ASCII characters but letters and digits become spaces.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Longer words (hashtags, base64) are cut into blocks of ``BLOCK`` bytes.
LONGEST, BLOCK = 40, 12
#: Stands before a part of a run of characters: it has no marks of its own. No other word has this byte.
_PART = b"="
#: Thai, Lao, Tibetan, Burmese, Khmer, kana, Han.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]+")


def _spaced(text: str) -> list[bytes]:
    words = text.encode("utf-8", "surrogatepass").translate(_WORDS).split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    out, shared = [], max(GRAMS) - 1
    for w in words:
        marked = b"<" + w + b">"
        out += [w] if len(w) <= LONGEST else [_PART + marked[i : i + BLOCK] for i in range(0, len(marked) - shared, BLOCK - shared)]
    return out


def words_of(text: str) -> list[bytes]:
    if text.isascii():
        return _spaced(text)
    out, end = [], 0
    for m in _UNSPACED.finditer(text):
        out += _spaced(text[end : m.start()])
        run, end = m[0], m.end()
        out += [_PART + run[i : i + 2].encode() for i in range(len(run) - 1)] or [run.encode()]
    return out + _spaced(text[end:])


def features(word: bytes) -> np.ndarray:
    """Buckets of a word and its character n-grams."""
    marked = word[1:] if word.startswith(_PART) else b"<" + word + b">"
    grams = {marked} | {marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)}
    return np.array(sorted(xxhash.xxh32_intdigest(g) % BUCKETS for g in grams), np.int64)


class Model:
    """Embeddings E and a linear softmax (w, b) over two classes."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
        self.w = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
        self.b = np.array([0, -2], np.float32)

    def fit(self, texts: list[str], labels: list[int], epochs: int = EPOCHS) -> Model:
        number: dict[bytes, int] = {}
        rows = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int32) for t in texts]
        buckets, sizes = array("i"), array("i")
        for word in number:
            own = features(word)
            sizes.append(len(own))
            buckets.extend(own.tolist())
        del number, texts
        size = np.array(sizes, np.int64)
        first = np.concatenate([[0], np.cumsum(size)])
        flat = np.frombuffer(buckets, np.int32) if buckets else np.zeros(0, np.int32)
        texts_with = np.zeros(BUCKETS, np.int64)
        for row in rows:
            n = size[own := np.unique(row)]
            texts_with[np.unique(flat[np.repeat(first[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())])] += 1
        # a bucket of a few texts would learn these by heart, and an unseen one would add noise
        frozen = texts_with < max(3, MIN_SHARE * len(rows))
        self.e[frozen] = 0
        y, rng, params = np.array(labels), np.random.default_rng(SEED), [self.e, self.w, self.b]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        step, batches = 0, max(1, len(rows) // BATCH)
        # few rows make few batches, so they come round more often
        epochs = max(epochs, -(-STEPS // batches)) if epochs else 0
        warm_up = epochs * WARM_UP // EPOCHS
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs)
            for take in np.array_split(rng.permutation(len(rows)), batches):
                step += 1
                worth = self.e @ (self.w[:, 1] - self.w[:, 0])
                of_word = (np.add.reduceat(worth[flat], first[:-1]) / size).astype(np.float32) if len(flat) else np.zeros(0)
                words = [self._hottest(rows[i], of_word, None if epoch >= warm_up else rng) for i in take]
                doc = np.repeat(np.arange(len(take)), [len(x) for x in words])
                word = np.concatenate(words)
                # the buckets of the chosen segments' words, each with its share in the segment's mean
                n = size[word]
                f = flat[np.repeat(first[word] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
                x, doc = np.repeat(SCALE / SEGMENT / n, n).astype(np.float32), np.repeat(doc, n)
                part = self.e[f] * x[:, None]
                h = np.stack([np.bincount(doc, part[:, d], len(take)) for d in range(DIM)], 1)
                p = self._softmax(h @ self.w + self.b)
                p[np.arange(len(take)), y[take]] -= 1
                p /= len(take)
                back = (p @ self.w.T)[doc] * x[:, None]
                grads = [np.stack([np.bincount(f, back[:, d], BUCKETS) for d in range(DIM)], 1), h.T @ p, p.sum(0)]
                for q, g, (m, v) in zip(params, grads, moments, strict=True):  # Adam
                    g = g.astype(np.float32)
                    if g.shape == self.e.shape:
                        g[frozen] = 0
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    q -= (rate * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)) * m / (np.sqrt(v) + 1e-6)
                self.e *= 1 - rate * DECAY
        return self

    @staticmethod
    def _hottest(words: np.ndarray, worth: np.ndarray, rng: np.random.Generator | None) -> np.ndarray:
        """The words of the segment that scores highest, or of a random one."""
        if len(words) <= SEGMENT:
            return words
        starts = np.arange(0, len(words), SEGMENT)
        k = rng.integers(len(starts)) if rng else np.argmax(np.add.reduceat(worth[words], starts))
        return words[starts[k] : starts[k] + SEGMENT]

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def weights(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the log odds of class 1 as a segment's only word, and the bias."""
        return self.e @ (self.w[:, 1] - self.w[:, 0]) * (SCALE / SEGMENT), float(self.b[1] - self.b[0])


def log_odds(words: list[bytes], scores: dict[bytes, float], bias: float) -> float:
    """Of the hottest segment."""
    if not words:
        return bias
    worth = np.fromiter(map(scores.__getitem__, words), np.float64, len(words))
    return float(np.add.reduceat(worth, np.arange(0, len(words), SEGMENT)).max()) + bias


class _WordScores(dict):
    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        s = float(self.weights[features(word)].mean())
        if len(self) < C.MEMO_WORDS:
            self[word] = s
        return s


def _held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model | None:
    """Fits on at most ``sample`` labelled rows that aren't held out, in the order of their hashes as long as their texts have ``chars`` characters together; a text that is too long is passed over."""
    ids = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = ids.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)  # at most ``sample`` rows: small enough to broadcast
    text = F.coalesce("text", F.lit(""))
    found = C.cut(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by(text, F.struct(F.md5(text), text)).alias("text"), F.first("toxic").alias("toxic")))  # of several texts of one id the one of the least digest
    sizes = {r.doc_id: r.n for r in found.select("doc_id", F.length("text").alias("n")).collect()}  # ``sample`` numbers
    if sum(sizes.values()) > chars:
        held, fitting = 0, []
        for i in sorted(sizes, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)):
            if held + sizes[i] <= chars:
                held += sizes[i]
                fitting.append(i)
        found = found.filter(F.col("doc_id").isin(fitting))
    got = sorted(found.collect())
    if len({r.toxic for r in got}) < 2:
        return None
    return Model().fit([r.text for r in got], [int(r.toxic == 1) for r in got])


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    model = train(docs, labels, sample)
    weights, bias = model.weights() if model else (np.zeros(BUCKETS, np.float32), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS numbers

    def work():
        scores = _WordScores(shared.value)

        def each(part, texts):
            z = np.clip([log_odds(words_of(t), scores, bias) for t in texts], -60, 60)
            return {"doc_id": C.column(part, "doc_id"), "score": 1 / (1 + np.exp(-z)) if model else np.zeros(len(texts))}

        return each

    out = C.map_texts(docs.select("doc_id", "text"), "doc_id long, score double", work)
    return out.select("doc_id", F.coalesce(_held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that aren't predicted toxic, with all their columns."""
    model = train(docs, labels, sample)
    if model is None:
        return docs
    weights, bias = model.weights()
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS numbers

    C.bound_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def odds(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scores = _WordScores(shared.value)
        for part in texts:
            out = [log_odds(words_of(t or ""), scores, bias) for a, b in C.runs_of(C.sizes_of(part)) for t in part.slice(a, b - a).to_pylist()]
            yield pa.array(out, pa.float64())

    return docs.filter(odds("text") < 0)
