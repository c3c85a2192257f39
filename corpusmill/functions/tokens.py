"""Token counts by a tokenizer file, loaded once a worker."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F


def token_count_udf(content: str):
    """Counts the tokens of texts by a tokenizer in the JSON format of the ``tokenizers`` package; ``content`` is the file's text, read by the driver."""

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(content)
        for part in texts:
            yield pd.Series([len(e.ids) for e in tokenizer.encode_batch(part.fillna("").tolist(), add_special_tokens=False)], dtype="int64")

    return count
