"""Quality rules on repetition, by rolling hashes of several n-gram lengths in numpy.

For each length the share of a text's word characters inside duplicated n-grams is
measured (the first copy not counted), as well as the share in the most
frequent short n-gram and in repeated lines. A text is kept if its base rules
hold and no share passes its limit.

A null or empty text has no words and fails the base rules. Repeated rows get
the same row each; an empty table gives an empty result; further columns of the
input are ignored. A very long text is worked off alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import common as C

#: Limits published for web text: share of characters in the most frequent n-gram, in duplicated n-grams, in duplicated lines.
TOP = {2: 0.20, 3: 0.18, 4: 0.16}
DUPLICATED = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
DUP_LINES = 0.30
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_share double, top_share double, dup_share double"


def _covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` words lie in a window of n words that begins at one of ``starts``."""
    step = np.zeros(total + 1, np.int32)
    step[starts] += 1
    np.subtract.at(step, np.minimum(starts + n, total), 1)
    return np.cumsum(step[:-1]) > 0


def _repeated(key: np.ndarray) -> np.ndarray:
    """Places of the keys that occur more than once, by key, then place. Most occur once, so plain sorting finds the others' values first."""
    ranked = np.sort(key)
    values = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if not len(values):
        return np.empty(0, np.int64)
    hit = np.flatnonzero(values[np.minimum(np.searchsorted(values, key), len(values) - 1)] == key)
    return hit[np.argsort(key[hit], kind="stable")]


def repetition(texts: list[str], hashes: C.WordHashes, top: dict[int, float] = TOP, duplicated: dict[int, float] = DUPLICATED) -> dict[str, np.ndarray]:
    """The measures of all texts at once: windows of all of them are sorted together.

    A window's hash rolls from length to length: each adds one word's hash times the
    weight of its place; it is spread, and its text mixed in, before it is compared. Two
    windows of one text are taken for equal if their 64 bits are.
    """
    k = len(texts)
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    n = np.fromiter(map(len, words), np.int64, k)
    flat = [w for ws in words for w in ws]
    total = len(flat)
    ids, doc = hashes.of(flat), np.repeat(np.arange(k), n)
    # characters: bytes that don't go on with one
    ends = np.cumsum(np.fromiter(map(len, flat), np.int64, total))
    begun = np.concatenate([[0], np.cumsum(np.frombuffer(b"".join(flat), np.uint8) & 0xC0 != 0x80)])
    reach = np.concatenate([[0], begun[ends]])
    size = np.diff(reach)
    per_doc = lambda x: np.bincount(doc, weights=x, minlength=k)
    chars = np.maximum(per_doc(size), 1)
    salt = C.mix(doc.astype(np.uint64) + np.uint64(1))
    out = {"n": n, "chars": chars, "top": np.zeros(k), "dup": np.zeros(k), "repeat": np.zeros(k, np.int64)}
    rolled = np.empty(0, np.uint64)
    for length in range(1, max({WINDOW, *top, *duplicated}) + 1):
        if total < length:
            break
        rolled = C.longer(rolled, ids, length)
        if length != WINDOW and length not in top and length not in duplicated:
            continue
        inside = np.flatnonzero(doc[: len(rolled)] == doc[length - 1 :])
        key = C.mix(rolled[inside]) ^ salt[inside]
        order = _repeated(key)
        if not len(order):
            continue
        first = np.flatnonzero(np.concatenate([[True], key[order[1:]] != key[order[:-1]]]))
        at = inside[order]
        if length == WINDOW:
            out["repeat"] = per_doc(_covered(at, length, total)).astype(np.int64)
        if length in duplicated:
            share = per_doc(size * _covered(np.delete(at, first), length, total)) / chars
            out["dup"] = np.maximum(out["dup"], share / duplicated[length])
        if length in top:
            runs = np.diff(np.append(first, len(at)))
            at = at[first]
            most = np.zeros(k)
            np.maximum.at(most, doc[at], runs * (reach[at + length] - reach[at]))
            out["top"] = np.maximum(out["top"], most / chars / top[length])
    return out


def _lines(text: str) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and their characters."""
    if "\n" not in text:
        return 0, 0
    seen, n, chars = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(C.SPACES):
            if line in seen:
                n, chars = n + 1, chars + len(line)
            else:
                seen.add(line)
    return n, chars


def quality_rules(docs: DataFrame, top: dict[int, float] = TOP, duplicated: dict[int, float] = DUPLICATED, dup_lines: float = DUP_LINES) -> DataFrame:
    """One row for each document: its counts, whether the base rules fail, and whether it is kept."""

    def work():
        hashes = C.WordHashes()

        def each(part, texts):
            r = repetition(texts, hashes, top, duplicated)
            lines = np.array([_lines(t) for t in texts], np.int64).reshape(-1, 2)
            chars = np.array([len(t) for t in texts], np.int64)
            line_share = lines[:, 1] / np.maximum(chars, 1)
            failed = (r["n"] < MIN_WORDS) | (100 * r["repeat"] > REPEAT_PERCENT * r["n"])
            kept = ~failed & (r["top"] <= 1) & (r["dup"] <= 1) & (line_share <= dup_lines)
            return {
                "doc_id": C.column(part, "doc_id"), "n_words": r["n"], "word_chars": chars - [sum(map(t.count, C.SPACES)) for t in texts],
                "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts], "n_dup_lines": lines[:, 0], "n_repeat_words": r["repeat"], "base_failed": failed, "kept": kept,
                "dup_line_share": line_share, "top_share": r["top"], "dup_share": r["dup"],
            }

        return each

    return C.map_texts(docs.select("doc_id", "text"), SCHEMA, work)
