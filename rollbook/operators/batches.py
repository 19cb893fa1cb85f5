"""A function applied to rows in batches (H6), where built-in columns can't express it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def in_batches(df: DataFrame, function: Callable[[pd.DataFrame], pd.Series], result: str | T.DataType, rows: int = 1000) -> DataFrame:
    """df with `result`, what function gives for each row of a batch of up to `rows`, and `failed`. A batch that fails has nulls and its error's text.

    Spark deals the partitions out to cores and repeats lost ones; function must therefore be repeatable.
    """
    kind = T.StructType([*df.schema.fields, T.StructField("result", T._parse_datatype_string(result) if isinstance(result, str) else result), T.StructField("failed", T.StringType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), rows):
                batch = part.iloc[at : at + rows].reset_index(drop=True)
                try:
                    yield batch.assign(result=function(batch), failed=None)
                except Exception as e:  # noqa: BLE001  a bad batch is null results, not a failed job
                    yield batch.assign(result=None, failed=f"{type(e).__name__}: {e}")

    return df.mapInPandas(run, kind)
