"""Batches that are staged first and committed by one rename, so that readers see each batch once or not at all.

A batch's rows go into a folder of their own. The commit is a small entry, written under
another name and renamed to the batch's number; a rename doesn't replace an entry, so of two
writers of one batch one wins and the other's folder is never read. Readers take the
folders that entries name, and nothing else. The newest entry is the record of progress: at
every moment there is one, as entries are only added. What a broken-off run staged is
removed by ``tidy``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..shared import remove

Hook = Callable[[str], None]


def _nothing(_: str) -> None:
    pass


class CommitLog:
    """A table of committed batches in the folder ``root``. hook: is called at each step by name, for tests that break off there."""

    def __init__(self, spark: SparkSession, root: str, hook: Hook = _nothing):
        self.spark, self.root, self.hook = spark, root.rstrip("/"), hook
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self._conf)

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return sorted(x.getPath().getName() for x in self._fs().listStatus(at)) if self._fs().exists(at) else []

    def numbers(self) -> list[int]:
        """The committed batches."""
        return [int(n) for n in self._names("log") if n.isdigit()]

    def append(self, df: DataFrame, batch: int) -> bool:
        """Writes and commits a batch; False if it has been committed before, and then nothing is written."""
        if batch in self.numbers():
            return False
        folder = f"data/{batch}-{uuid.uuid4().hex}"
        self.hook("begun")
        df.write.parquet(f"{self.root}/{folder}")
        self.hook("staged")
        return self._commit(batch, folder)

    def _commit(self, batch: int, folder: str) -> bool:
        fs = self._fs()
        rows = self.spark.read.parquet(f"{self.root}/{folder}").count()
        fs.mkdirs(self._path(f"{self.root}/log"))
        new, entry = self._path(f"{self.root}/log/.{uuid.uuid4().hex}"), self._path(f"{self.root}/log/{batch:020d}")
        out = fs.create(new, False)
        try:
            out.write(bytearray(json.dumps({"batch": batch, "folder": folder, "rows": rows}).encode()))
            out.hsync()
        finally:
            out.close()
        self.hook("written")
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf).rename(new, entry, self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Exception:
            if not fs.exists(entry):
                raise
            fs.delete(new, False)
            return False
        self.hook("committed")
        return True

    def entries(self) -> DataFrame:
        """batch, folder and rows of each committed batch."""
        schema = "batch long, folder string, rows long"
        if not self.numbers():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json([f"{self.root}/log/{n:020d}" for n in self.numbers()])

    def progress(self) -> tuple[int, int]:
        """(newest batch, rows so far); (-1, 0) before the first."""
        found = self.entries().agg({"batch": "max", "rows": "sum"}).first()
        return (-1, 0) if found[0] is None else (found["max(batch)"], found["sum(rows)"])

    def read(self, schema: str) -> DataFrame:
        """The rows of all committed batches."""
        folders = [f"{self.root}/{r.folder}" for r in self.entries().select("folder").collect()]  # a name for each batch
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def tidy(self) -> int:
        """Removes what no entry names; only while nobody writes."""
        named = {r.folder for r in self.entries().select("folder").collect()}
        gone = [f"data/{n}" for n in self._names("data") if f"data/{n}" not in named] + [f"log/{n}" for n in self._names("log") if not n.isdigit()]
        for x in gone:
            remove(self.spark, f"{self.root}/{x}")
        return len(gone)


def committed(df: DataFrame, log: CommitLog, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda x: x) -> StreamingQuery:
    """A stream into a commit log: a batch that runs again after it has been committed is left out."""

    def step(batch: DataFrame, i: int) -> None:
        log.append(transform(batch), i)

    return df.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
