"""Token counts of whole texts: batch encoding in an Arrow function that returns lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.llm.tokens import encoder


def token_count(text: Column, tokenizer_path: str) -> Column:
    """Number of tokens without added specials; a null text counts as empty. Batches are balanced by bytes, long texts split."""

    @F.pandas_udf("bigint")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = encoder(tokenizer_path, ids=False)
        for texts in batches:
            yield pd.Series(list(counter.of(t or "" for t in texts)), dtype="int64")

    return of(text)


def counted(docs: DataFrame, tokenizer_path: str, text_col: str = "text", limit: int = 1024) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``; columns of these names are replaced.

    Every row comes back, repeated ones too; null and empty texts have zero of each.
    """
    rows = docs.withColumn("n_tokens", token_count(F.col(text_col), tokenizer_path))
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("bigint")
    return rows.withColumns({"n_bytes": size, "over_limit": F.col("n_tokens") > limit})
