"""Batches of a given size, of what is at hand and of the keys of a table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def slices(items: Sequence, size: int) -> Iterator[Sequence]:
    """``items`` in runs of ``size``, the last one shorter."""
    if size < 1:
        raise ValueError("a batch holds one item at least")
    for at in range(0, len(items), size):
        yield items[at : at + size]


def key_batches(df: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """``(keys..., batch)``: the distinct keys in their order, ``size`` to a batch. Ordering takes the keys only, in one task."""
    if size < 1:
        raise ValueError("a batch holds one item at least")
    place = F.row_number().over(Window.orderBy(*keys)) - 1
    return df.select(*keys).distinct().select(*keys, F.floor(place / size).cast("int").alias("batch"))
