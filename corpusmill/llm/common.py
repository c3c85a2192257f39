"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..shared import shared_dir

#: ASCII white space, the only separator of words here.
SPACES = " \t\n\r\x0b\x0c"
#: Texts are worked off in chunks of about so many characters, whatever an Arrow batch holds.
CHUNK_CHARS = 4_000_000
#: Rows of an Arrow batch at most, where the session has Spark's default: texts are long, and both sides hold batches outside of the heap.
BATCH_ROWS, DEFAULT_BATCH_ROWS = 1000, 10_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Words that a task's memo keeps; beyond it words are worked out anew.
MEMO_WORDS = 150_000

M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_UPPER = bytes(range(65, 91))
LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_shuffles(spark: SparkSession) -> None:
    """From now on Spark deletes a query's shuffle files when the query has ended; one that runs again makes them anew."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


@contextmanager
def settings(spark: SparkSession, **values: str | None) -> Iterator[None]:
    """Settings of the session (dots as double underscores) that hold for a while; None leaves one alone."""
    values = {k.replace("__", "."): v for k, v in values.items() if v is not None}
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def freed_shuffles(spark: SparkSession):
    """Within it, Spark deletes a query's shuffle files when the query has ended."""
    return settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


def bounded_batches(spark: SparkSession):
    """Within it, Arrow batches of texts are small; a setting other than the default is left alone."""
    default = spark.conf.get(_BATCH, str(DEFAULT_BATCH_ROWS)) == str(DEFAULT_BATCH_ROWS)
    return settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(BATCH_ROWS) if default else None)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the shared folder.

    Checkpoints that no table needs any more go when the driver has collected its
    garbage, if the session says so (spark.cleaner.referenceTracking.cleanCheckpoints);
    this asks for it.
    """
    spark = df.sparkSession
    shared_dir(spark)
    out = df.checkpoint(eager=True)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def bound_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of texts small; a setting other than the default is left alone."""
    if int(spark.conf.get(_BATCH, str(DEFAULT_BATCH_ROWS))) == DEFAULT_BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def sizes_of(column: pa.Array) -> np.ndarray:
    """Bytes of each text; a null has none."""
    return np.asarray(pc.fill_null(pc.binary_length(column), 0))


def runs_of(sizes: np.ndarray, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Neighbouring rows of about ``limit`` bytes together, one row at least."""
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with their texts (null: empty), about ``limit`` characters each, one row at least."""
    column = batch.column(batch.schema.get_field_index(text))
    for a, b in runs_of(sizes_of(column), limit):
        yield batch.slice(a, b - a), [t or "" for t in column.slice(a, b - a).to_pylist()]


def map_texts(df: DataFrame, schema: str, work: Callable[[], Callable[[pa.RecordBatch, list[str]], dict]], text: str = "text") -> DataFrame:
    """Runs ``work()`` once a task and what it returns on every chunk of rows.

    The function gets the chunk and its texts and returns the columns of the output by name.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    bound_batches(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = work()
        for batch in batches:
            for part, texts in chunks(batch, text):
                out = each(part, texts)
                yield pa.RecordBatch.from_arrays([x if isinstance(x := out[f.name], pa.Array) else pa.array(x, f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


class WordHashes(dict):
    """64-bit hashes of words, with a bounded memo."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO_WORDS:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finalizer of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * M1
    h = h ^ (h >> np.uint64(33))
    h = h * M2
    return h ^ (h >> np.uint64(33))


_RNG = np.random.default_rng(20240607)
_WINDOW = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def longer(rolled: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Sums for all runs of n words from those for runs of n - 1 (of the first length: nothing): one product more for each."""
    last = ids[n - 1 :] * _WINDOW[n - 1]
    return last if n == 1 else rolled[: len(last)] + last


def windows(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words (64 at most), by their words' hashes: a product with odd numbers by place, then spread."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    h = ids[: len(ids) - n + 1] * _WINDOW[0]
    for k in range(1, n):
        h += ids[k : len(ids) - n + 1 + k] * _WINDOW[k]
    return mix(h)


#: Random numbers for bytes (white space: 0) and for places in a word.
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[list(SPACES.encode())] = 0
_BYTE_LOWER = _BYTE[np.frombuffer(LOWER, np.uint8)]
_PLACES = _RNG.integers(0, 1 << 63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IN_WORD = _BYTE != 0


def word_hashes(data: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words (runs of bytes that aren't ASCII white space) of a text's bytes; with ``lower``, A-Z count as a-z."""
    inside = _IN_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    first = starts[0]
    place = np.arange(first, len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    parts = (_BYTE_LOWER if lower else _BYTE)[data[first:]] * _PLACES[place & 0xFFFF]
    return mix(np.add.reduceat(parts, starts - first)), starts


def crc32_step(text: str = "s", place: str = "k", value: str = "x") -> str:
    """DuckDB SQL: crc32 (before its last inversion) after one more byte of an ASCII text, bit by bit."""
    bit = "xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)"
    return f"list_reduce(list_prepend(xor({value}, ascii(substr({text}, {place}, 1))::BIGINT), [0::BIGINT for i in range(8)]), lambda x, y: {bit})"
