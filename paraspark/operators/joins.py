"""Left joins to narrower tables.

No join carries a broadcast hint. Catalyst broadcasts a table whose file size is
below its threshold, adaptive execution a computed one whose real size turns out to be; any other join
shuffles on its keys, where hot keys of the large side are split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    *,
    null_safe: Sequence[str] = (),
    how: str = "left",
) -> DataFrame:
    """Join ``right``'s non-key columns to ``left``; NULL matches NULL for ``null_safe`` keys."""
    side = right
    if null_safe:
        side = side.withColumnsRenamed({k: f"__{k}" for k in keys})
    if not null_safe:
        return left.join(side, list(keys), how)
    condition = " AND ".join(f"{k} {'<=>' if k in null_safe else '='} __{k}" for k in keys)
    return left.join(side, F.expr(condition), how).drop(*[f"__{k}" for k in keys])


def aggregate(df: DataFrame, keys: Sequence[str], **measures: str) -> DataFrame:
    """``groupBy(keys).agg(...)`` with the measures as SQL text."""
    return df.groupBy(*keys).agg(*[F.expr(f"{sql} AS {name}") for name, sql in measures.items()])
