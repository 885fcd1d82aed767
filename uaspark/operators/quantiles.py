"""Exact, skew-safe percentiles (linear interpolation, like ``percentile``).

Spark's built-in exact ``percentile`` keeps every distinct value of a group in
one aggregation buffer, so a group holding a third of the table lands in one
task's memory.  This operator keeps the same result (position ``(n-1)*q``,
linear interpolation between the neighbouring order statistics) but never
gathers a group:

1. range-partition ``(keys, value, tiebreak)`` and sort inside partitions, so
   a hot group is spread over many partitions and equal values too;
2. materialise that layout once (reliable checkpoint) so both later passes see
   the same partitioning;
3. count rows per (partition, group) - a table of at most
   ``#groups + #partitions`` rows - and prefix-sum it per group;
4. translate each needed rank into a (partition, row position) pair and fetch
   just those rows with an equi-join on the position.

The big side is scanned twice.  The wanted ranks (two per group and percentile)
are broadcast when they are few, so it is not shuffled after step 1; with very
many groups the last join is a shuffle join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage


def exact_percentiles(df: DataFrame, keys: Sequence[str], value_col: str,
                      probs: Sequence[float], names: Sequence[str] | None = None,
                      num_partitions: int | None = None) -> DataFrame:
    """Return ``keys + names`` with the exact percentile of ``value_col`` per group.

    Null values are ignored (as in SQL); groups with no non-null value are absent.
    """
    keys = list(keys)
    probs = [float(p) for p in probs]
    names = list(names) if names is not None else [f"p{int(round(p * 100))}" for p in probs]
    v = F.col(value_col).cast("double")
    # equal values are spread by a hash of the whole row, the same on a retry
    base = (df.select(*[F.col(k) for k in keys], v.alias("_qv"), F.xxhash64(*df.columns).alias("_qt"))
              .where(F.col("_qv").isNotNull() & ~F.isnan("_qv")))
    layout = [*keys, "_qv", "_qt"]
    ranked = ((base.repartitionByRange(num_partitions, *layout) if num_partitions else base.repartitionByRange(*layout))
                  .sortWithinPartitions(*keys, "_qv", "_qt")
                  .select(*keys, "_qv",
                          F.spark_partition_id().alias("_qp"),
                          F.monotonically_increasing_id().alias("_qm")))
    ranked = cut_lineage(ranked)

    per_part = ranked.groupBy("_qp", *keys).agg(F.count(F.lit(1)).alias("_qc"),
                                                 F.min("_qm").alias("_qm0"))
    grp = Window.partitionBy(*keys) if keys else Window.partitionBy()
    before = grp.orderBy("_qp").rowsBetween(Window.unboundedPreceding, -1)
    per_part = per_part.select(
        *keys, "_qp", "_qc", "_qm0",
        F.coalesce(F.sum("_qc").over(before), F.lit(0)).alias("_qoff"),
        F.sum("_qc").over(grp).alias("_qn"))

    # Needed ranks per group: floor and ceil of (n-1)*q for every q.
    wanted = []
    for i, q in enumerate(probs):
        h = (F.col("_qn") - 1).cast("double") * F.lit(q)
        wanted.append(F.struct(F.lit(i).alias("i"), F.lit("lo").alias("side"),
                               F.floor(h).cast("long").alias("r")))
        wanted.append(F.struct(F.lit(i).alias("i"), F.lit("hi").alias("side"),
                               F.ceil(h).cast("long").alias("r")))
    targets = (per_part.select(*keys, "_qp", "_qc", "_qm0", "_qoff", "_qn",
                               F.explode(F.array(*wanted)).alias("_w"))
                       .where((F.col("_w.r") >= F.col("_qoff")) &
                              (F.col("_w.r") < F.col("_qoff") + F.col("_qc")))
                       .select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)],
                               F.col("_qp").alias("_tp"),
                               (F.col("_qm0") + F.col("_w.r") - F.col("_qoff")).alias("_tm"),
                               F.col("_w.i").alias("_ti"), F.col("_w.side").alias("_ts"),
                               F.col("_qn").alias("_tn")))

    targets = broadcast_if_small(targets)
    picked = ranked.join(targets, (ranked["_qp"] == targets["_tp"]) & (ranked["_qm"] == targets["_tm"]))
    aggs = []
    for i, (q, name) in enumerate(zip(probs, names)):
        lo = F.max(F.when((F.col("_ti") == i) & (F.col("_ts") == "lo"), F.col("_qv")))
        hi = F.max(F.when((F.col("_ti") == i) & (F.col("_ts") == "hi"), F.col("_qv")))
        h = (F.max("_tn") - 1).cast("double") * F.lit(q)
        frac = h - F.floor(h)
        aggs.append((lo + frac * (hi - lo)).alias(name))
    out = picked.groupBy(*[F.col(f"_k{j}").alias(k) for j, k in enumerate(keys)]).agg(*aggs)
    return out
