"""SentencePiece encoding and decoding with a unigram reading of a piece file.

An Aho-Corasick automaton over the pieces reads a text once; at each position
its output links give all pieces that end there, and each relaxes the best
score of the position (Viterbi). A character that no piece covers is written as
its UTF-8 bytes' pieces. A file of the BPE kind has merge ranks in place of log
probabilities; its pieces get those of a Zipf-Mandelbrot law of the rank.

Texts are cut before each run of spaces and around characters that are in no
piece, where no piece can reach across, and the parts of up to ``MEMO_CHARS``
characters are memoised; a longer part is one pass over it. Decoding gives
back the text, the literal U+2581 included (it is written as bytes).

A null or empty text has no pieces and decodes to the empty text. Repeated rows
get the same row each; an empty table gives an empty result; further columns of
the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Types of pieces and the kind of model in the file's format (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: How much worse than the worst piece an uncovered character scores.
UNKNOWN_PENALTY = 10.0
ZIPF_SHIFT = 2.7
MEMO_CHARS = 48


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        x = shift = 0
        while True:
            b = buf[i]
            i += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while i < len(buf):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = varint() if key & 7 == 2 else 8 if key & 7 == 1 else 4
            yield key >> 3, buf[i : i + n]
            i += n


def read_pieces(path: str = MODEL) -> tuple[list[tuple[str, float, int]], int]:
    """(piece, score, type) of all ids, and the model's kind."""
    pieces, kind = [], UNIGRAM
    with open(path, "rb") as f:
        for number, value in _fields(f.read()):
            if number == 1:
                x = dict(_fields(value))
                pieces.append((x.get(1, b"").decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
    return pieces, kind


def log_probabilities(pieces: list[tuple[str, float, int]], kind: int) -> list[tuple[str, float, int]]:
    """The pieces with log probabilities, made from the ranks if the model is of the BPE kind."""
    if kind != BPE:
        return pieces
    total = math.log(sum(1 / (-s + ZIPF_SHIFT) for _, s, t in pieces if t == NORMAL))
    return [(p, -math.log(-s + ZIPF_SHIFT) - total if t == NORMAL else s, t) for p, s, t in pieces]


class Codec:
    """Encodes and decodes one text after another."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.automaton, self.single, self.bytes_of, byte_ids = ahocorasick.Automaton(), set(), [], {}
        worst, alphabet, self.cuts_at_spaces = 0.0, set(), True
        for i, (piece, score, kind) in enumerate(pieces):
            self.bytes_of.append(b"" if kind == CONTROL else bytes([int(piece[3:5], 16)]) if kind == BYTE else piece.replace(SPACE, " ").encode())
            if kind == BYTE:
                byte_ids[int(piece[3:5], 16)] = i
            if kind not in (NORMAL, USER_DEFINED):
                continue
            text = piece.replace(SPACE, " ")
            if not self.automaton.exists(text):
                self.automaton.add_word(text, (len(text), i, score))
            worst = min(worst, score)
            alphabet.update(text)
            if len(text) == 1:
                self.single.add(text)
            self.cuts_at_spaces &= " " not in text.lstrip(" ")
        self.automaton.make_automaton()
        self.unknown = worst - UNKNOWN_PENALTY
        unk = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.byte_ids = [byte_ids.get(b, unk) for b in range(256)]
        self.newline_alone = "\n" not in alphabet
        self.memo: dict[str, bytes] = {}

    def viterbi(self, text: str) -> tuple[list[int], float]:
        """The ids of the best segmentation and its score."""
        n, single, unknown = len(text), self.single, self.unknown
        best, back = [0.0] + [-math.inf] * n, [(0, -1)] * (n + 1)
        done = 0  # positions up to here have their final score

        def settle(to: int) -> None:
            nonlocal done
            while done < to:
                done += 1
                if text[done - 1] not in single and best[done - 1] + unknown > best[done]:
                    best[done], back[done] = best[done - 1] + unknown, (1, -1)

        for end, (size, i, score) in self.automaton.iter(text):
            if done < end:
                settle(end)
            if (s := best[end + 1 - size] + score) > best[end + 1]:
                best[end + 1], back[end + 1] = s, (size, i)
        settle(n)
        ids, at = [], n
        while at:
            size, i = back[at]
            if i < 0:
                ids.extend(self.byte_ids[b] for b in reversed(text[at - 1].encode("utf-8", "surrogatepass")))
            else:
                ids.append(i)
            at -= size
        return ids[::-1], best[n]

    def _part(self, part: str) -> bytes:
        """Ids (int32) of a part that starts with its spaces."""
        if (known := self.memo.get(part)) is not None:
            return known
        if self.newline_alone and "\n" in part and len(part) > 1:
            head, _, tail = part.partition("\n")
            out = [self._part(head)] if head else []
            out.append(self._part("\n"))
            while tail:
                head, cut, tail = tail.partition("\n")
                if head:
                    out.append(self._part(head))
                if cut:
                    out.append(self._part("\n"))
            return b"".join(out)
        ids = np.array(self.viterbi(part)[0], "<i4").tobytes()
        if len(part) <= MEMO_CHARS and len(self.memo) < C.MEMO_WORDS:
            self.memo[part] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, "<i4")
        if not self.cuts_at_spaces:
            return np.frombuffer(self._part(" " + text), "<i4")
        memo, out, spaces = self.memo, [], 1
        for word in text.split(" "):
            if not word:
                spaces += 1
                continue
            part = " " * spaces + word
            spaces = 1
            out.append(memo[part] if part in memo else self._part(part))
        if spaces > 1:
            out.append(self._part(" " * (spaces - 1)))
        return np.frombuffer(b"".join(out), "<i4")

    def decode(self, ids: np.ndarray | list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")[1:]


def _codec(path: str):
    """Makes a task's codec; the pieces, a fixed number, are read by the driver and go with the task."""
    pieces = log_probabilities(*read_pieces(path))
    return lambda: Codec(pieces)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int32), pa.int32()))


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and ids of every text."""
    make = _codec(model)

    def work():
        codec = make()
        return lambda part, texts: {"doc_id": C.column(part, "doc_id"), "ids": _lists([codec.encode(t) for t in texts])}

    return C.map_texts(docs.select("doc_id", "text"), "doc_id long, ids array<int>", work)


def decode(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of every list of ids (null: empty)."""
    make = _codec(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = make()
        for batch in batches:
            texts = [codec.decode(x or []) for x in C.column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([C.column(batch, "doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str = MODEL, with_ids: bool = False) -> DataFrame:
    """One row for each document: number of ids, of those that stand for bytes, digests of ids and decoded text, and whether that is the text; the ids too if asked for."""
    make = _codec(model)
    schema = "doc_id long, n_ids long, n_byte_ids long, ids_sha256 string, decoded_sha256 string, same boolean" + ", ids array<int>" * with_ids
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def work():
        codec = make()
        byte_ids = np.unique(codec.byte_ids)

        def each(part, texts):
            ids = [codec.encode(t) for t in texts]
            back = [codec.decode(x.tolist()) for x in ids]
            return {
                "doc_id": C.column(part, "doc_id"), "n_ids": [len(x) for x in ids], "n_byte_ids": [int(np.isin(x, byte_ids).sum()) for x in ids],
                "ids_sha256": [sha(x.tobytes()) for x in ids], "decoded_sha256": [sha(t.encode()) for t in back], "same": [a == b for a, b in zip(texts, back, strict=True)],
                "ids": _lists(ids) if with_ids else None,
            }

        return each

    return C.map_texts(docs.select("doc_id", "text"), schema, work)
