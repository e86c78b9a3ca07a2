"""Row helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_into(df: DataFrame, items: Column, name: str, *keep, position: str | None = None) -> DataFrame:
    """Explode a computed array of non-null items.

    The plain generators make the optimiser infer ``size(items) > 0``, which evaluates a costly
    array once more per row; the outer form with a null test afterwards evaluates it once.
    """
    if position is None:
        out = df.select(*keep, F.explode_outer(items).alias(name))
    else:
        out = df.select(*keep, F.posexplode_outer(items).alias(position, name))
    return out.where(F.col(name).isNotNull())
