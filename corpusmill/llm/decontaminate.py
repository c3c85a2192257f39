"""Benchmark decontamination: a BM25 inverted index of the test items, asked with every passage by block-max WAND.

A document is cut into overlapping passages, as long as two of the longest
items and half overlapping, so that every item lies whole in one of them. A
passage's score for an item is the share of the item's BM25 weight whose terms
the passage has; all items at ``threshold`` or more are retrieved. WAND with
block maxima skips items that cannot reach it: its postings hold an item's
rarer terms only, the essential ones, as the others together weigh ``LEAVE`` of
the threshold at most; an item whose essential terms reach what is then missing
gets its whole score. What is retrieved is verified:
of the question's and of the answer's word n-grams (of a part of fewer words, the
part itself) a share of ``overlap`` each must stand in the passage. The answer is
what follows an ``Answer:`` line or the last question mark, else the last
sentence; an item of one part is both.

The index is built and broadcast in shards of ``SHARD_ITEMS`` items, so its size
is bounded; each shard is one pass over the documents. Null or empty texts and
items match nothing. Repeated documents and items give a pair each; rows with a
null id are treated alike and give a null id; an empty table on either side
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from . import common as C

#: The usual parameters of BM25.
K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, GRAM = 0.5, 0.5, 3
#: Items of a shard of the index, postings of a block, words of the shortest passage.
SHARD_ITEMS, BLOCK, SHORTEST = 20_000, 32, 64
#: The share of the threshold that an item's commonest terms may weigh to be left out of the postings.
LEAVE = 0.5
#: A-Z become lower case, all other ASCII characters but letters and digits become spaces.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_ANSWER = re.compile(r"\n\s*(?:answer|a)\s*:", re.I)
_SENTENCE = re.compile(r"[.!?]\s+(?=\S)")
_END = 1 << 62
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


def question_and_answer(text: str) -> tuple[str, str]:
    if m := _ANSWER.search(text):
        return text[: m.start()], text[m.end() :]
    if 0 < (at := text.rfind("?") + 1) and words_of(text[at:]):
        return text[:at], text[at:]
    ends = [m.end() for m in _SENTENCE.finditer(text.strip())]
    return (text.strip()[: ends[-1]], text.strip()[ends[-1] :]) if ends else (text, text)


def grams(words: list[bytes], n: int = GRAM) -> set[bytes]:
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def width_of(words: int) -> int:
    """Words of the passages in which an item of so many words is looked for: twice its length, rounded up to a power of two."""
    return max(SHORTEST, 2 << max(0, words - 1).bit_length())


class Postings:
    """Postings of the essential terms of the items of one passage width, and block maxima.

    An impact is the term's share of its item's weight over what the essential
    terms of that item must reach, so that 1 is enough for any item.
    """

    def __init__(self, items: list[tuple[int | None, str]], texts: list[list[bytes]], width: int, threshold: float, df: dict[bytes, int], n_items: int, mean: float):
        self.ids, self.width = [i for i, _ in items], width
        self.parts = []  # of each item the question and the answer: length of the n-grams, n-grams
        for _, t in items:
            q, a = ((min(GRAM, len(ws)), grams(ws)) for ws in map(words_of, question_and_answer(t or "")))
            self.parts.append((q if q[1] else a, a if a[1] else q))
        self.threshold, self.term, self.whole = threshold, {}, []
        postings: list[list[tuple[int, float]]] = []
        for k, ws in enumerate(texts):
            weight = {w: math.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(ws) / mean)) for w, f in Counter(ws).items()}
            total = sum(weight.values()) or 1.0
            share = {w: x / total for w, x in weight.items()}
            left, essential = 0.0, dict(share)
            for w in sorted(share, key=lambda w: (-df[w], w)):
                if left + share[w] > LEAVE * threshold:
                    break
                left += share[w]
                del essential[w]
            self.whole.append(share)
            for w, x in essential.items():
                if (t := self.term.setdefault(w, len(self.term))) == len(postings):
                    postings.append([])
                postings[t].append((k, x / (threshold - left)))
        self.docs = [[k for k, _ in p] for p in postings]
        self.impacts = [[x for _, x in p] for p in postings]
        self.block_last = [[p[min(i + BLOCK, len(p)) - 1][0] for i in range(0, len(p), BLOCK)] for p in postings]
        self.block_max = [[max(x for _, x in p[i : i + BLOCK]) for i in range(0, len(p), BLOCK)] for p in postings]
        self.bound = np.array([max(m) for m in self.block_max] + [0.0])  # the last one is for words of no item

    def search(self, terms: list[int], threshold: float = 1.0) -> list[int]:
        """All items whose impacts at ``terms`` (distinct) add up to ``threshold``: block-max WAND."""
        eps = 1e-9
        # each list: [item it stands at, place in the postings, term]
        lists = [[self.docs[t][0], 0, t] for t in terms]
        out = []
        while True:
            lists = sorted(x for x in lists if x[0] != _END)
            reach, pivot = 0.0, -1
            for i, (_, _, t) in enumerate(lists):
                reach += self.bound[t]
                if reach >= threshold - eps:
                    pivot = i
                    break
            if pivot < 0:
                return out
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            # a shallow look: the blocks that would hold the item
            reach, nearest = 0.0, _END
            for _, _, t in lists[: pivot + 1]:
                if (b := bisect_left(self.block_last[t], item)) < len(self.block_last[t]):
                    reach += self.block_max[t][b]
                    nearest = min(nearest, self.block_last[t][b] + 1)
            if reach < threshold - eps:
                to = max(item + 1, min(nearest, lists[pivot + 1][0] if pivot + 1 < len(lists) else _END))
                for x in lists[: pivot + 1]:
                    self._move(x, to)
            elif lists[0][0] == item:
                score = 0.0
                for x in lists[: pivot + 1]:
                    score += self.impacts[x[2]][x[1]]
                    self._move(x, item + 1)
                if score >= threshold - eps:
                    out.append(item)
            else:
                for x in lists[:pivot]:
                    if x[0] < item:
                        self._move(x, item)

    def _move(self, x: list[int], to: int) -> None:
        """Moves a list to its first item that is ``to`` or more."""
        docs = self.docs[x[2]]
        x[1] = bisect_left(docs, to, x[1])
        x[0] = docs[x[1]] if x[1] < len(docs) else _END

    def matches(self, words: list[list[bytes]], overlap: float = OVERLAP) -> list[tuple[int, int, float, float, float]]:
        """(text's place, item's place, score, question's overlap, answer's overlap) of all verified pairs."""
        width, step = self.width, self.width // 2
        n = np.fromiter(map(len, words), np.int64, len(words))
        get, none = self.term.get, len(self.term)
        ids = np.fromiter((get(w, none) for ws in words for w in ws), np.int64, int(n.sum()))
        sums = np.concatenate([[0.0], np.cumsum(self.bound[ids])])
        passages = np.maximum(1, -(-(n - step) // step))
        text = np.repeat(np.arange(len(words)), passages)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(passages) - passages, passages)
        base = (np.cumsum(n) - n)[text]
        start = base + nth * step
        end = np.minimum(start + width, base + n[text])
        found: dict[tuple[int, int], tuple[float, float, float]] = {}
        # terms that repeat count more than once in this bound, so that no passage is missed
        for i in np.flatnonzero(sums[end] - sums[start] >= 1 - 1e-9):
            items = self.search([int(t) for t in np.unique(ids[start[i] : end[i]]) if t != none])
            if not items:
                continue
            k = int(text[i])
            passage = words[k][start[i] - base[i] : end[i] - base[i]]
            terms, there = set(passage), {}
            for item in items:
                score = sum(x for w, x in self.whole[item].items() if w in terms)
                if score < self.threshold - 1e-9:
                    continue
                for n_words, _ in self.parts[item]:
                    if n_words not in there:
                        there[n_words] = grams(passage, n_words)
                q, a = (len(x & there[n_words]) / len(x) for n_words, x in self.parts[item])
                if q >= overlap and a >= overlap:
                    found[k, item] = max(found.get((k, item), (0.0, 0.0, 0.0)), (score, q, a))
        return [(k, item, *x) for (k, item), x in sorted(found.items())]


class Index:
    """The items by the width of their passages, which an item's own length alone decides; counts of terms are those of all items."""

    def __init__(self, items: list[tuple[int | None, str]], threshold: float = THRESHOLD, df: dict[bytes, int] | None = None, n_items: int = 0, mean: float = 0.0):
        texts = [words_of(t or "") for _, t in items]
        df = Counter(w for ws in texts for w in set(ws)) if df is None else df
        n_items, mean = n_items or len(items), mean or sum(map(len, texts)) / max(1, len(texts)) or 1.0
        by: dict[int, list[int]] = {}
        for k, ws in enumerate(texts):
            by.setdefault(width_of(len(ws)), []).append(k)
        self.groups = [Postings([items[k] for k in own], [texts[k] for k in own], width, threshold, df, n_items, mean) for width, own in sorted(by.items())]

    def matches(self, texts: list[str], overlap: float = OVERLAP) -> list[tuple[int, int | None, float, float, float]]:
        """(text's place, item_id, score, question's overlap, answer's overlap) of all verified pairs."""
        words = [words_of(t) for t in texts]
        return sorted(((k, g.ids[item], *x) for g in self.groups for k, item, *x in g.matches(words, overlap)), key=repr)


def _shards(items: DataFrame, threshold: float, shard_items: int) -> Iterator[Index]:
    """One index after the other; the driver holds one at a time, besides what it has broadcast."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = items.count()
    if n <= shard_items:
        if n:
            yield Index(sorted(map(tuple, items.collect()), key=repr), threshold)
        return
    # counts over all items; of these each shard gets its own terms' only
    word = F.explode(F.array_distinct(F.split(F.btrim(F.regexp_replace(F.translate("text", _CAPITALS, _CAPITALS.lower()), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), " ")))
    terms = C.cut(items.select(word.alias("w")).groupBy("w").agg(F.count("*").alias("df")))
    size = F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    mean = items.agg(F.avg(size)).first()[0]
    shards = -(-n // shard_items) * 2
    for k in range(shards):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k)
        own = part.select(word.alias("w")).distinct().join(terms, "w").collect()
        df = Counter({r.w.encode(): r.df for r in own})
        yield Index(sorted(map(tuple, part.collect()), key=repr), threshold, _AtLeastOne(df), n, mean or 1.0)


class _AtLeastOne(dict):
    def __missing__(self, key: bytes) -> int:
        return 1


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """One row for each document and item that it leaks."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], SCHEMA)
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    for index in _shards(items, threshold, shard_items):
        shared = spark.sparkContext.broadcast(index)  # of at most about shard_items items
        del index

        def work(shared=shared):
            def each(part, texts):
                index, ids = shared.value, C.column(part, "doc_id").to_pylist()
                rows = [(ids[k], *x) for k, *x in index.matches(texts, overlap)]
                return dict(zip(names, zip(*rows, strict=True) if rows else [[]] * len(names), strict=True))

            return each

        out = out.union(C.map_texts(docs.select("doc_id", "text"), SCHEMA, work))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """The rows whose text leaks no item; each row is judged by its own text, whatever its id."""
    C.bound_batches(docs.sparkSession)
    out = docs
    for index in _shards(items, threshold, shard_items):
        shared = docs.sparkSession.sparkContext.broadcast(index)  # of at most about shard_items items
        del index

        def clean(texts: Iterator[pa.Array], shared=shared) -> Iterator[pa.Array]:
            for part in texts:
                good = np.ones(len(part), bool)
                for a, b in C.runs_of(C.sizes_of(part)):
                    found = shared.value.matches([t or "" for t in part.slice(a, b - a).to_pylist()], overlap)
                    good[[a + k for k, *_ in found]] = False
                yield pa.array(good)

        out = out.filter(F.arrow_udf(clean, "boolean", ArrowUDFType.SCALAR_ITER)("text"))
    return out
