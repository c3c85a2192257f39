"""Responses of a model: batched calls of a client that the caller brings.

No client is part of the engine. A client is made once a task and called with a
list of prompts; it returns one list of ``n`` responses for each. Calls that fail
are tried again after 1, 2, 4, ... seconds, 30 at most; a prompt whose calls all
fail gets no responses and the error.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Client = Callable[[list[str], int], list[list[str]]]


def backoff(attempt: int, most: float = 30.0) -> float:
    return min(most, 2.0**attempt)


def call(client: Client, prompts: list[str], n: int, tries: int, sleep: Callable[[float], None] = time.sleep) -> tuple[list[list[str]], str | None]:
    error = None
    for attempt in range(tries):
        try:
            return client(prompts, n), None
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            if attempt + 1 < tries:
                sleep(backoff(attempt))
    return [[] for _ in prompts], error


def respond(df: DataFrame, key: str, prompt: str, make: Callable[[], Client], n: int = 1, batch: int = 64, tries: int = 5) -> DataFrame:
    """key, sample (from 1), response and error: a row for each sample, one with a null response where all calls failed."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.iloc[at : at + batch]
                found, error = call(client, part[prompt].tolist(), n, tries)
                out = [(k, i, r, None) for k, rs in zip(part[key], found, strict=True) for i, r in enumerate(rs, 1)]
                yield pd.DataFrame(out or [(k, 0, None, error) for k in part[key]], columns=[key, "sample", "response", "error"])

    return df.select(key, prompt).mapInPandas(run, f"{key} {kind}, sample int, response string, error string")
