"""Copies of folders that the executors make: no byte passes the driver.

The driver deals out names; each task streams its files, piece by piece, through Arrow's file
systems (local and mounted folders, or any store that they open by its address), hashes what it
reads, writes under another name, reads that back, and renames it when both digests are the
same. What has been copied goes into a manifest, a commit for each of ``rounds`` shares of the
names, so a broken copy goes on where it was, and a file that has changed since is copied anew.
Files of any length take the memory of one piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.commitlog import CommitLog, Hook, _nothing

PIECE = 8 << 20
_MANIFEST = "name string, length long, modified timestamp, sha256 string"


def _opened(uri: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _hashed(source, sink=None) -> str:
    digest = hashlib.sha256()
    while piece := source.read(PIECE):
        digest.update(piece)
        if sink is not None:
            sink.write(piece)
    return digest.hexdigest()


def _copier(target: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, root = _opened(target)
        for batch in batches:
            sums = []
            for name, path in zip(batch.column("name").to_pylist(), batch.column("path").to_pylist(), strict=True):
                here, at = _opened(path)
                final = f"{root.rstrip('/')}/{name}"
                new = f"{final}.copying"
                there.create_dir(final.rpartition("/")[0], recursive=True)
                with here.open_input_stream(at) as source, there.open_output_stream(new) as sink:
                    sums.append(_hashed(source, sink))
                with there.open_input_stream(new) as again:
                    if _hashed(again) != sums[-1]:
                        raise OSError(f"{name} hasn't arrived as it was sent")
                there.move(new, final)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("name", "length", "modified")), pa.array(sums, pa.string())], names=["name", "length", "modified", "sha256"])

    return run


def listed(spark: SparkSession, source: str) -> DataFrame:
    """name (below the source), path, length and time of every file, empty ones too; the driver sees the listing and no content."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root, found, rows = fs.getFileStatus(at).getPath().toString().rstrip("/"), fs.listFiles(at, True), []
    while found.hasNext():
        x = found.next()
        rows.append((x.getPath().toString()[len(root) + 1 :], x.getPath().toString(), x.getLen(), x.getModificationTime()))
    return spark.createDataFrame(rows, "name string, path string, length long, ms long").select("name", "path", "length", F.timestamp_millis("ms").alias("modified"))


def copy_tree(spark: SparkSession, source: str, target: str, rounds: int = 8, hook: Hook = _nothing) -> DataFrame:
    """Copies what the copy's manifest doesn't have yet, and gives the manifest: name, length, modified and sha256 of each file."""
    log, files = CommitLog(spark, f"{target.rstrip('/')}/.manifest", hook), listed(spark, source)
    todo = files.join(log.read(_MANIFEST).select("name", "length", "modified"), ["name", "length", "modified"], "left_anti")
    first = log.progress()[0] + 1
    for k in range(rounds):
        part = todo.filter(F.pmod(F.xxhash64("name"), F.lit(rounds)) == k)
        if not part.select("name").isEmpty():
            log.append(part.repartition(spark.sparkContext.defaultParallelism, "name").select("name", "path", "length", "modified").mapInArrow(_copier(target), _MANIFEST), first + k)
    manifest = log.read(_MANIFEST)
    return manifest.groupBy("name").agg(F.max_by(F.struct("length", "modified", "sha256"), "modified").alias("s")).select("name", "s.*")
