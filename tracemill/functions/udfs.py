"""What built-in functions can't express: terminal recordings, and pluggable scorers."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType


@F.pandas_udf(BinaryType())
def terminal_recording(frames: pd.Series, delay: pd.Series) -> pd.Series:
    """Frames (array<string>) as a terminal recording: <seconds, microseconds, length> headers, screen cleared before each frame."""

    def packed(texts, seconds: float) -> bytes:
        out = []
        for k, text in enumerate(texts if texts is not None else ()):
            whole, micro = divmod(round(k * seconds * 1_000_000), 1_000_000)
            payload = ("\x1b[2J\x1b[H" + str(text).replace("\n", "\r\n") + "\r\n").encode()
            out.append(struct.pack("<III", whole, micro, len(payload)) + payload)
        return b"".join(out)

    return pd.Series([packed(x, d) for x, d in zip(frames, delay, strict=True)])


def with_scores(rows: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], column: str, kind: str = "double") -> DataFrame:
    """rows with a column that a model computes batch by batch; models themselves are the caller's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{column: scorer(batch)})

    return rows.mapInPandas(run, StructType(list(rows.schema.fields)).add(column, kind))
