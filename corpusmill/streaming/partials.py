"""Summaries that grow batch by batch from mergeable states: no batch reads an earlier one's rows.

A state has a row for each key with counts, sums, least and largest values; two states are
merged by key. Batch k reads its own rows and the state behind batch k - 1, and writes the one
behind k. Run again, it starts from the same state and gives the same one.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .commitlog import CommitLog

_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
Spec = Mapping[str, tuple[str, Column]]  # name: (count, sum, min, max or mean; of what)


def _parts(spec: Spec) -> dict[str, tuple[str, Column]]:
    """A mean is kept as a sum and a count."""
    out: dict[str, tuple[str, Column]] = {}
    for name, (kind, x) in spec.items():
        out |= {f"{name}_sum": ("sum", x), f"{name}_count": ("count", x)} if kind == "mean" else {name: (kind, x)}
    return out


def state_of(df: DataFrame, keys: list[str], spec: Spec) -> DataFrame:
    make = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
    return df.groupBy(*keys).agg(*[make[kind](x).alias(k) for k, (kind, x) in _parts(spec).items()])


def merged(states: list[DataFrame], keys: list[str], spec: Spec) -> DataFrame:
    return reduce(DataFrame.unionByName, states).groupBy(*keys).agg(*[_MERGE[kind](k).alias(k) for k, (kind, _) in _parts(spec).items()])


def finished(state: DataFrame, keys: list[str], spec: Spec) -> DataFrame:
    """The summary that a state stands for; a mean of nothing is null."""
    value = lambda name, kind: F.try_divide(F.col(f"{name}_sum").cast("double"), F.col(f"{name}_count").cast("double")) if kind == "mean" else F.col(name)
    return state.select(*keys, *[value(name, kind).alias(name) for name, (kind, _) in spec.items()])


class Summary:
    """The states of a stream in a commit log, one for each batch; each names all that came before it."""

    def __init__(self, log: CommitLog, keys: list[str], spec: Spec):
        self.log, self.keys, self.spec = log, keys, spec

    def _state(self, batch: int) -> DataFrame | None:
        found = self.log.entries().filter(F.col("batch") == batch).select("folder").first()
        return self.log.spark.read.parquet(f"{self.log.root}/{found.folder}") if found else None

    def add(self, df: DataFrame, batch: int) -> None:
        before, own = self._state(batch - 1), state_of(df, self.keys, self.spec)
        self.log.append(own if before is None else merged([before, own], self.keys, self.spec), batch)

    def now(self) -> DataFrame | None:
        """The summary of all batches so far; None before the first."""
        state = self._state(self.log.progress()[0])
        return None if state is None else finished(state, self.keys, self.spec)


def summarised(df: DataFrame, out: CommitLog, summary: Summary, checkpoint: str) -> StreamingQuery:
    """Rows and summary batch by batch, both committed."""

    def step(batch: DataFrame, i: int) -> None:
        batch = batch.persist()
        try:
            out.append(batch, i)
            summary.add(batch, i)
        finally:
            batch.unpersist()

    return df.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
