"""Token ids of a corpus in files of independent blocks, entropy-coded by a static range asymmetric numeral system.

``write`` makes a folder of two tables. ``table`` holds the frequencies of all ids that occur,
counted over the whole corpus and scaled to a power of two; every block is coded with them.
``blocks`` holds the blocks, each a frame of bytes that stands for itself: whole documents, about
``BLOCK`` ids, with their doc_ids and lengths. A block's ids are dealt in turn to ``lanes`` coder
states, which numpy advances together; a state that leaves its interval gives 32 bits to the one
stream that all lanes share. Every ``EVERY`` steps the states and the place in the stream are
kept as a checkpoint with a checksum of the ids up to the next one, so a reader can start at any
checkpoint, and parts of one block can be decoded side by side. The frame ends with a checksum
of its own; a wrong one is an error.

    magic 4 bytes, shard, first id in the shard, ids, documents, lanes, steps between checkpoints, checkpoints, words of the stream (8 bytes each)
    doc_ids (8 bytes each), nulls (1), lengths (8)
    places in the stream (8), checksums of ids (8), states (8 x lanes) of each checkpoint
    the stream (4 bytes a word), crc32 of all before (4)

Documents are dealt to shards by ranges of doc_id, so ids lie in the files in the order of
doc_id (nulls first), then text digest and place in the input; the id ``END`` follows each
document. A null text is empty, and an empty one still has its END. Repeated rows are documents
of their own. Columns other than doc_id and text aren't looked at. An empty table gives
a table and blocks without rows.

Texts are cut where a byte-level tokenizer always starts anew: before spaces that are followed by
something else, and between Latin letters, ASCII digits, marks and white space. Cuts are found in the
bytes of all texts of a chunk together, equal parts are encoded once and memoised. Texts that hold
a token of the tokenizer's own, and other tokenizers, get whole texts.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain, islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import new_dir, remove
from . import common as C

END = 2
#: Ids of a block (a longer document is a block of its own), lanes at most, ids of a lane at least, steps between checkpoints.
BLOCK, LANES, LEAST, EVERY = 1 << 20, 1024, 64, 256
#: A state lies in [LOW, LOW << 32).
LOW_BITS = 31
LOW = np.uint64(1 << LOW_BITS)
#: Scaled frequencies sum up to 2 to the power of the bits, 4 for each id that occurs at least.
LEAST_BITS, MOST_BITS = 12, 28
MAGIC = b"RANS"
_HEAD = struct.Struct("<4s8q")
#: Parts of texts that a Python worker remembers, and how long they are at most.
MEMO, MEMO_CHARS = 600_000, 48
#: A word that a byte-level tokenizer doesn't take apart before its model does, and the characters that stand for bytes in the model.
_WORD = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
#: Kinds of bytes: the space, other white space, letters, digits, marks, the apostrophe (which contractions begin with), and what is left (no ASCII character that is seen). Letters are those of ASCII here; `cuts` adds Latin ones.
_SPACE, _WHITE, _LETTER, _DIGIT, _MARK, _APOSTROPHE, _OTHER = range(7)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[33:127] = _MARK
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[39], _KIND[32], _KIND[9:14] = _APOSTROPHE, _SPACE, _WHITE
#: By 8 times the kind of the byte before and the kind of a byte: whether a tokenizer starts anew between them, whatever else there is.
_APART = np.zeros(64, bool)
_APART[[8 * a + b for a in (_LETTER, _DIGIT, _MARK) for b in (_LETTER, _DIGIT, _MARK) if a != b]] = True
_APART[[8 * a + _APOSTROPHE for a in (_LETTER, _DIGIT)]] = True
_APART[[8 * a + b for a in (_LETTER, _DIGIT, _MARK, _APOSTROPHE) for b in (_SPACE, _WHITE)]] = True
_APART[[8 * _WHITE + b for b in (_LETTER, _DIGIT, _MARK, _APOSTROPHE)]] = True


def cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where parts of texts begin: the bytes of texts that end at ``ends``, one behind the other."""
    kinds = _KIND[data]
    latin = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))  # À to ſ, all of them letters but × and ÷
    latin = latin[(data[latin] != 0xC3) | ((data[latin + 1] != 0x97) & (data[latin + 1] != 0xB7))]
    kinds[latin] = kinds[latin + 1] = _LETTER
    seen = (kinds >= _LETTER) & (kinds <= _APOSTROPHE)  # whether a character that isn't white space begins there
    far = np.flatnonzero(data > 0xC5)
    pairs = data[far].astype(np.uint16) << 8 | data[np.minimum(far + 1, len(data) - 1)]
    seen[far[~np.isin(pairs, (0xE19A, 0xE280, 0xE281, 0xE380))]] = True  # those begin with bytes that white space has, too
    begins = np.zeros(len(data), bool)
    begins[1:] = _APART[(kinds[:-1] << 3) + kinds[1:]]
    before = kinds == _SPACE
    before[:-1] &= seen[1:]
    some = ends[np.diff(ends, prepend=0) > 0]
    before[some - 1] = False  # what follows is another text
    begins |= before
    begins[0] = True
    begins[some[:-1]] = True
    return np.flatnonzero(begins)


class Table:
    """Frequencies of ids; ids that don't occur have none."""

    def __init__(self, freqs: dict[int, int]) -> None:
        self.bits = max(LEAST_BITS, sum(freqs.values()).bit_length() - 1)
        ids = np.array(sorted(freqs), np.int64)
        size = int(ids[-1]) + 1 if len(ids) else 0
        self.freq = np.zeros(size, np.uint64)
        self.freq[ids] = np.array([freqs[i] for i in ids.tolist()], np.uint64)
        self.start = np.cumsum(self.freq, dtype=np.uint64) - self.freq
        self.of_slot = np.repeat(np.arange(size, dtype=np.uint32), self.freq.astype(np.int64))


def scaled(counts: dict[int, int]) -> dict[int, int]:
    """Counts scaled to a sum that is a power of two, 1 for each id at least; what is left goes to the most frequent."""
    if not counts:
        return {}
    bits = min(MOST_BITS, max(LEAST_BITS, (4 * len(counts) - 1).bit_length()))
    total, room = sum(counts.values()), (1 << bits) - len(counts)
    out = {i: 1 + n * room // total for i, n in counts.items()}
    for i in sorted(counts, key=lambda i: (-counts[i], i))[: (1 << bits) - sum(out.values())]:
        out[i] += 1
    return out


def encode_ids(ids: np.ndarray, table: Table, lanes: int, every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stream, place in it of each checkpoint, states of each checkpoint)."""
    states = np.full(lanes, LOW, np.uint64)
    bits, top, low32 = np.uint64(table.bits), np.uint64(LOW_BITS + 32 - table.bits), np.uint64(0xFFFFFFFF)
    steps, put, written, marks = -(-len(ids) // lanes), [], 0, []
    for t in range(steps - 1, -1, -1):
        now = ids[t * lanes : (t + 1) * lanes]
        x, f = states[: len(now)], table.freq[now]
        full = x >= f << top
        words = x[full]
        if len(words):
            put.append((words & low32).astype("<u4"))
            written += len(words)
            x[full] = words >> np.uint64(32)
        q = x // f
        x[:] = (q << bits) + (x - q * f) + table.start[now]
        if t % every == 0:
            marks.append((written, states.copy()))
    stream = np.concatenate(put[::-1]) if put else np.empty(0, "<u4")
    marks.reverse()
    return stream, np.array([written - w for w, _ in marks], np.int64), np.array([s for _, s in marks], np.uint64).reshape(-1, lanes)


def decode_ids(stream: np.ndarray, place: int, states: np.ndarray, n: int, table: Table) -> np.ndarray:
    """n ids from a checkpoint on."""
    states, lanes, out = states.copy(), len(states), np.empty(n, np.uint32)
    bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    for a in range(0, n, lanes):
        x = states[: min(lanes, n - a)]
        slot = x & mask
        ids = table.of_slot[slot]
        out[a : a + lanes] = ids
        x[:] = table.freq[ids] * (x >> bits) + slot - table.start[ids]
        few = x < LOW
        k = int(np.count_nonzero(few))
        if k:
            x[few] = x[few] << np.uint64(32) | stream[place : place + k]
            place += k
    return out


def crc_ids(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())


def pack(shard: int, first: int, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, table: Table, lanes: int | None = None, every: int = EVERY) -> bytes:
    """A frame."""
    lanes = lanes or max(1, min(LANES, len(ids) // LEAST))
    stream, places, states = encode_ids(ids, table, lanes, every)
    sums = [crc_ids(ids[a : a + every * lanes]) for a in range(0, len(ids), every * lanes)]
    parts = [
        _HEAD.pack(MAGIC, shard, first, len(ids), len(lengths), lanes, every, len(places), len(stream)), np.array([i or 0 for i in doc_ids], "<i8").tobytes(), np.array([i is None for i in doc_ids], np.uint8).tobytes(),
        np.array(lengths, "<i8").tobytes(), places.astype("<i8").tobytes(), np.array(sums, "<i8").tobytes(), states.astype("<u8").tobytes(), stream.astype("<u4", copy=False).tobytes(),
    ]
    body = b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


class Frame:
    """A frame that is read: its documents, and its ids from any checkpoint on."""

    def __init__(self, data: bytes) -> None:
        if len(data) < _HEAD.size + 4 or data[:4] != MAGIC or struct.unpack("<I", data[-4:])[0] != zlib.crc32(memoryview(data)[:-4]):
            raise ValueError("a damaged block")
        _, self.shard, self.first, self.n, docs, self.lanes, self.every, marks, words = _HEAD.unpack_from(data)
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        ids, null = take("<i8", docs), take(np.uint8, docs)
        self.doc_ids = [None if x else i for i, x in zip(ids.tolist(), null.tolist(), strict=True)]
        self.lengths, self.places, self.sums = take("<i8", docs), take("<i8", marks), take("<i8", marks)
        self.states, self.stream = take("<u8", marks * self.lanes).reshape(marks, self.lanes).astype(np.uint64), take("<u4", words)

    def part(self, k: int, table: Table) -> np.ndarray:
        """The ids from checkpoint k up to the next one."""
        size = self.every * self.lanes
        out = decode_ids(self.stream, int(self.places[k]), self.states[k], min(size, self.n - k * size), table)
        if crc_ids(out) != self.sums[k]:
            raise ValueError("ids don't match their checksum")
        return out

    def ids(self, table: Table) -> np.ndarray:
        return np.concatenate([np.empty(0, np.uint32), *[self.part(k, table) for k in range(len(self.places))]])

    def between(self, a: int, b: int, table: Table) -> np.ndarray:
        """Ids a up to b of the block, of which only the parts between checkpoints are decoded that hold them."""
        size = self.every * self.lanes
        k = a // size
        got = np.concatenate([np.empty(0, np.uint32), *[self.part(i, table) for i in range(k, min(len(self.places), -(-b // size)))]])
        return got[a - k * size : b - k * size]


class Encoder:
    """Texts to bytes of ids by a tokenizer file, with END behind each."""

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if max(self.tok.get_vocab_size(), END + 1) <= 1 << 16 else "<u4")
        self.end = np.array([END], self.kind).tobytes()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        pre = file.get("pre_tokenizer") or {}
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not file.get("normalizer")
        self.own = [x.content for x in self.tok.get_added_tokens_decoder().values()]
        self.memo: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        ids = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        data, bounds = np.fromiter(chain.from_iterable(ids), self.kind).tobytes(), [0, *accumulate(len(x) * self.kind.itemsize for x in ids)]
        return [data[a:b] for a, b in pairwise(bounds)]

    def _parts(self, parts: list[bytes]) -> list[bytes]:
        """Ids of parts that differ from each other; what a worker remembers stays, as frequent parts come early."""
        out = list(map(self.memo.get, parts))
        new = [i for i, ids in enumerate(out) if ids is None]
        others, model = [], self.tok.model
        for i in new:
            if _WORD.fullmatch(parts[i].decode()):
                out[i] = np.array([x.id for x in model.tokenize(parts[i].decode("latin-1").translate(_BYTES))], self.kind).tobytes()
            else:
                others.append(i)
        for i, ids in zip(others, self._encode([parts[i].decode() for i in others]), strict=True):
            out[i] = ids
        room = MEMO - len(self.memo)
        self.memo.update((parts[i], out[i]) for i in islice((i for i in new if len(parts[i]) <= MEMO_CHARS), max(0, room)))
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return [x + self.end for x in self._encode(texts)]
        whole = [i for i, t in enumerate(texts) if any(own in t for own in self.own)]
        kept = set(whole)
        raw = [b"" if i in kept else t.encode() for i, t in enumerate(texts)]
        data, ends = b"".join(raw), np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        out = [self.end] * len(texts)
        if data:
            starts = cuts(np.frombuffer(data, np.uint8), ends)
            parts = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
            found, at = self._parts(parts.dictionary.to_pylist()), parts.indices.to_numpy()
            size = self.kind.itemsize
            n = np.fromiter(map(len, found), np.int64, len(found)) // size
            ids, first, each = np.frombuffer(b"".join(found), self.kind), np.cumsum(n) - n, n[at]
            upto = np.append(0, np.cumsum(each))
            ids = ids[np.repeat(first[at] - upto[:-1], each) + np.arange(upto[-1])].tobytes()
            bounds = (size * upto[np.searchsorted(starts, np.append(0, ends))]).tolist()
            out = [ids[a:b] + self.end for a, b in pairwise(bounds)]
        for i, x in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
            out[i] = x + self.end
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each Python worker, whose next tasks find what it remembers."""
    return Encoder(path)


def tokenized(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, shard, seq (number in the shard), start (ids before it in the shard), n_tokens, width (bytes of an id) and ids, in the order of doc_id by shards."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.select("*", F.xxhash64("text").alias("_tie"), F.monotonically_increasing_id().alias("_uid"))
    order = ["doc_id", "_tie", "_uid"]

    def work():
        encode, at = encoder(tokenizer), [0, 0]
        shard, size = TaskContext.get().partitionId(), encode.kind.itemsize

        def each(batch: pa.RecordBatch, texts: list[str]) -> dict:
            ids = encode(texts)
            n = np.array([len(x) // size for x in ids], np.int64)
            start, seq = at[1] + np.cumsum(n) - n, at[0] + np.arange(len(ids))
            at[0], at[1] = at[0] + len(ids), at[1] + int(n.sum())
            return {"doc_id": C.column(batch, "doc_id"), "shard": [shard] * len(ids), "seq": seq, "start": start, "n_tokens": n, "width": [size] * len(ids), "ids": pa.array(ids, pa.binary())}

        return each

    return C.map_texts(keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text"), "doc_id long, shard long, seq long, start long, n_tokens long, width int, ids binary", work)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (id, n) for each id of a task."""
    sums = np.zeros(1, np.int64)
    for batch in batches:
        for a, b in C.runs_of(C.sizes_of(C.column(batch, "ids"))):
            part = batch.slice(a, b - a)
            ids = np.frombuffer(b"".join(C.column(part, "ids").to_pylist()), f"<u{C.column(part, 'width')[0].as_py()}")
            got = np.bincount(ids)
            if len(got) > len(sums):
                got, sums = sums, got
            sums[: len(got)] += got
    ids = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sums[ids])], names=["id", "n"])


def _blocks(freqs: dict[int, int], block: int):
    schema = pa.schema([("shard", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("n_docs", pa.int64()), ("frame", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, size, after = Table(freqs), [], 0, None

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([np.frombuffer(r["ids"], f"<u{r['width']}") for r in held])
            frame = pack(held[0]["shard"], held[0]["start"], [r["doc_id"] for r in held], [r["n_tokens"] for r in held], ids, table)
            return pa.RecordBatch.from_pylist([{"shard": held[0]["shard"], "first": held[0]["start"], "n_tokens": len(ids), "n_docs": len(held), "frame": frame}], schema)

        for batch in batches:
            for r in (r for a, b in C.runs_of(C.sizes_of(C.column(batch, "ids"))) for r in batch.slice(a, b - a).to_pylist()):
                if held and ((r["shard"], r["seq"]) != after or size >= block):
                    yield flush()
                    held, size = [], 0
                held.append(r)
                size += r["n_tokens"]
                after = (r["shard"], r["seq"] + 1)
        if held:
            yield flush()

    return run


def write(docs: DataFrame, tokenizer: str, path: str, block: int = BLOCK) -> None:
    """Writes the ids of all documents into the folder ``path``, which driver and executors share.

    tokenizer: a file of the tokenizers library that every machine has.
    The ids stand in a table of their own until they have been counted and coded; it is removed then.
    """
    spark, raw = docs.sparkSession, new_dir(docs.sparkSession, "ids")
    with C.freed_shuffles(spark), C.bounded_batches(spark):
        tokenized(docs, tokenizer).write.option("compression", "zstd").parquet(raw)
        ids = spark.read.parquet(raw)
        counts = ids.select("ids", "width").mapInArrow(_counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
        freqs = scaled({r.id: r.n for r in counts.collect()})  # as many rows as the vocabulary has ids
        spark.createDataFrame(sorted(freqs.items()), "id long, freq long").coalesce(1).write.parquet(f"{path}/table")
        ids.mapInArrow(_blocks(freqs, block), "shard long, first long, n_tokens long, n_docs long, frame binary").write.option("compression", "none").parquet(f"{path}/blocks")
    remove(spark, raw)


def _read(freqs: dict[int, int], with_ids: bool):
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 5 if with_ids else 4]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(freqs)
        for batch in batches:
            for i in range(batch.num_rows):
                frame = Frame(batch.column(1)[i].as_py())
                ids, ends = frame.ids(table), np.cumsum(frame.lengths)
                if int(ends[-1] if len(ends) else 0) != len(ids):
                    raise ValueError("lengths don't match the ids")
                starts, data = ends - frame.lengths, memoryview(ids.astype("<u4", copy=False).tobytes())
                cuts = [data[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                out = [pa.array(frame.doc_ids, pa.int64()), pa.array(starts + frame.first + batch.column(0)[i].as_py()), pa.array(frame.lengths), pa.array([zlib.crc32(x) for x in cuts], pa.int64())]
                if with_ids:
                    out.append(pa.array([bytes(x) for x in cuts], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, the ids (4 bytes each), from a folder that ``write`` made.

    Blocks are decoded apart from each other; all that they need is how many ids earlier shards hold, a row for each shard.
    """
    freqs = {r.id: r.freq for r in spark.read.parquet(f"{path}/table").collect()}  # the vocabulary
    blocks = spark.read.schema("shard long, first long, n_tokens long, frame binary").parquet(f"{path}/blocks")
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    before = shards.select("shard", (F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")).alias("before"))
    both = blocks.select("shard", "frame").join(F.broadcast(before), "shard").select("before", "frame")  # as many rows as the writer had partitions
    with_schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return both.mapInArrow(_read(freqs, with_ids), with_schema)
