"""Order-dependent operators that stay distributed (W4, W5, running totals).

A global ``row_number()`` or a running total over one hot key would put every
row of that key into one task.  Here the rows are range-partitioned on the
ordering (so a hot key spans many partitions), materialised once, counted per
partition, and each row's global position is its partition offset plus its
position inside the partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def dense_row_index(df: DataFrame, order_cols: Sequence[str], name: str = "row_index",
                    num_partitions: int | None = None) -> DataFrame:
    """0..n-1 in ``order_cols`` order (ties broken by all columns)."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = list(df.columns)
    tie = [c for c in cols if c not in order_cols]
    ranked = (df.repartitionByRange(n, *order_cols, *tie).sortWithinPartitions(*order_cols, *tie)
                .select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")))
    ranked = cut_lineage(ranked)
    per = ranked.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"), F.min("_m").alias("_m0"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: a bounded table, so this un-partitioned window is tiny
    offs = per.select("_p", "_m0", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"))
    out = ranked.join(F.broadcast(offs), "_p")
    return out.select(*cols, (F.col("_off") + F.col("_m") - F.col("_m0")).alias(name))


def running_total(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], value: str,
                  name: str = "running_total", num_partitions: int | None = None) -> DataFrame:
    """Cumulative sum of ``value`` per ``keys`` in ``order_cols`` order.

    Range partitioning on (keys, order) splits a hot key; the local running
    sum is a window over (partition, keys) whose groups are bounded by the
    partition size; partition offsets come from a table of one row per
    (partition, key)."""
    keys, order_cols = list(keys), list(order_cols)
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = (df.repartitionByRange(n, *keys, *order_cols).sortWithinPartitions(*keys, *order_cols)
                .select("*", F.spark_partition_id().alias("_p")))
    ranked = cut_lineage(ranked)
    per = ranked.groupBy("_p", *keys).agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offs = per.select("_p", *keys, F.sum("_s").over(before).alias("_off"))
    local_w = Window.partitionBy("_p", *keys).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    local = ranked.select("*", F.sum(value).over(local_w).alias("_local"))
    out = local.join(offs, ["_p", *keys], "left")
    return out.select(*df.columns, (F.col("_local") + F.coalesce(F.col("_off"), F.lit(0))).alias(name))


def latest_per_key(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str],
                   value_cols: Sequence[str]) -> DataFrame:
    """The newest row per key as one partial aggregation (``max_by`` on a
    struct of the ordering) - a hot key is reduced map-side, never gathered."""
    ordering = F.struct(*[F.col(c) for c in order_cols])
    payload = F.struct(*[F.col(c) for c in value_cols])
    agg = df.groupBy(*keys).agg(F.max_by(payload, ordering).alias("_v"))
    return agg.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in value_cols])


def first_per_key(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], value_col: str,
                  name: str) -> DataFrame:
    ordering = F.struct(*[F.col(c) for c in order_cols])
    return df.groupBy(*keys).agg(F.min_by(F.col(value_col), ordering).alias(name))
