"""Set operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_kinds(kinds: Mapping[str, DataFrame], tag: str = "data_type") -> DataFrame:
    """Stack frames of every kind, union of columns, missing = null."""
    out = None
    for k, df in kinds.items():
        d = df.select("*", F.lit(k).alias(tag))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def union_datasets(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate datasets for training (same schema or superset)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def common_rows(a: DataFrame, b: DataFrame, key: str = "row_id") -> DataFrame:
    """U4: rows of ``a`` whose key also appears in ``b`` (a left-semi join)."""
    return a.join(b.select(key), key, "left_semi")
