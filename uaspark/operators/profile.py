"""Profiling, validation and summary aggregates.

Each is a single aggregation pass (partial aggregation map-side, so hot keys
are combined before the shuffle); schema checks read ``df.columns`` only.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .clean import HIERARCHY, NUMERIC_TYPES, numeric_columns

LEVEL_PATTERN = ("level", "events")


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def best_by_mean(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean value per key, best first (ties by key), top 1."""
    return (df.groupBy(key).agg(F.avg(value).alias("mean_" + value))
              .orderBy(F.desc("mean_" + value), F.asc(key)).limit(1))


def table_profile(df: DataFrame, platform_col: str = "platform") -> DataFrame:
    """A1: one row per column with its null count, plus table shape and
    distinct platforms; one aggregation pass, then an unpivot of one row."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("row_count"),
            F.count_distinct(F.col(platform_col)).alias("n_platforms") if platform_col in cols
            else F.lit(0).cast("long").alias("n_platforms"),
            *[(F.count(F.lit(1)) - F.count(F.col(_q(c)))).alias(c) for c in cols]]
    one = df.agg(*aggs).withColumn("n_columns", F.lit(len(cols)))
    return one.unpivot(["row_count", "n_platforms", "n_columns"], cols, "column_name", "null_count")


def null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*[(F.count(F.lit(1)) - F.count(F.col(_q(c)))).alias(c) for c in cols])


def _family_present(cols: Sequence[str], data_type: str) -> tuple[bool, str]:
    if data_type == "retention":
        return any("retention_rate" in c for c in cols), "no_retention_rate_columns"
    if data_type == "roas":
        return any("roas_d" in c for c in cols), "no_roas_columns"
    if data_type == "level_progression":
        return any(LEVEL_PATTERN[0] in c and LEVEL_PATTERN[1] in c for c in cols), "no_level_columns"
    return True, ""


REQUIRED_BY_KIND = {"adspend_revenue": ["platform", "spend", "revenue"],
                    "retention": ["platform", "installs"], "roas": ["platform", "installs"],
                    "level_progression": ["platform", "installs"]}


def validation_report(kinds: Mapping[str, DataFrame]) -> DataFrame:
    """A2: issue rows ``(data_type, issue, n)``.  Missing columns are found on
    the schema; null counts of hierarchy columns come from one aggregate per
    kind and only non-zero counts are kept."""
    spark = next(iter(kinds.values())).sparkSession
    static, dynamic = [], []
    for kind, df in kinds.items():
        cols = df.columns
        for h in HIERARCHY:
            if h not in cols:
                static.append((kind, f"missing_hierarchy:{h}", 1))
        if kind == "adspend_revenue":
            for r in REQUIRED_BY_KIND[kind]:
                if r not in cols:
                    static.append((kind, f"missing_required_column:{r}", 1))
        ok, issue = _family_present(cols, kind)
        if not ok:
            static.append((kind, issue, 1))
        present = [h for h in HIERARCHY if h in cols]
        if present:
            nc = null_counts(df, present)
            long = nc.unpivot([], present, "col", "n").select(
                F.lit(kind).alias("data_type"),
                F.concat(F.lit("missing_"), F.col("col"), F.lit("_values")).alias("issue"),
                F.col("n").cast("long").alias("n"))
            dynamic.append(long.where(F.col("n") > 0))
    schema = "data_type string, issue string, n long"
    out = spark.createDataFrame(static, schema)
    for d in dynamic:
        out = out.unionByName(d)
    return out


def records_by_platform_kind(kinds: Mapping[str, DataFrame]) -> DataFrame:
    """A3: records per platform x data kind."""
    parts = [df.select("platform", F.lit(k).alias("data_type")) for k, df in kinds.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("platform", "data_type").agg(F.count(F.lit(1)).alias("records"))


def data_quality(df: DataFrame) -> DataFrame:
    """A4: rows, columns, missing % = nulls / (rows x cols) x 100."""
    cols = df.columns
    nulls = sum((F.count(F.lit(1)) - F.count(F.col(_q(c))) for c in cols), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(cols)).alias("n_columns"),
                  (F.lit(100.0) * nulls / (F.count(F.lit(1)) * F.lit(len(cols)))).alias("missing_pct"))


def overview(kinds: Mapping[str, DataFrame]) -> DataFrame:
    """A5: non-empty kinds, total rows, distinct platforms, level column count."""
    counts = None
    plats = None
    for k, df in kinds.items():
        c = df.agg(F.count(F.lit(1)).alias("n"))
        counts = c if counts is None else counts.unionByName(c)
        p = df.select("platform")
        plats = p if plats is None else plats.unionByName(p)
    level_cols = sorted({c for df in kinds.values() for c in df.columns
                         if LEVEL_PATTERN[0] in c and LEVEL_PATTERN[1] in c})
    tot = counts.agg(F.sum((F.col("n") > 0).cast("int")).alias("non_empty_kinds"),
                     F.sum("n").alias("total_rows"))
    np_ = plats.agg(F.count_distinct("platform").alias("n_platforms"))
    return tot.crossJoin(np_).select(F.col("non_empty_kinds").cast("int"), "total_rows", "n_platforms",
                                     F.lit(len(level_cols)).alias("level_columns"))


def date_range(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Min / max of parsable dates."""
    d = F.col(date_col)
    return df.where(d.isNotNull()).agg(F.min(d).alias("start_date"), F.max(d).alias("end_date"))


def top_values(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """Most frequent values (ties by value) - a top-k report."""
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.desc("n"), F.asc(col)).limit(n))


def payload_summary(pred: DataFrame, exact_money: bool = False) -> DataFrame:
    """Rows, column flags, total cost, mean p50.  ``exact_money`` sums
    cost as decimal(38,4) (order-independent digits)."""
    cols = pred.columns
    aggs = [F.count(F.lit(1)).alias("num_rows"),
            F.lit(any(c.startswith("predicted_roas_") for c in cols)).alias("has_roas_cols"),
            F.lit("cost" in cols).alias("has_cost"), F.lit("revenue" in cols).alias("has_revenue")]
    if "cost" in cols:
        cost = F.coalesce(F.col("cost").cast("string").try_cast("double"), F.lit(0.0))
        total = F.sum(cost.cast("decimal(38,4)")).cast("double") if exact_money else F.sum(cost)
        aggs.append(total.alias("total_cost"))
    if "predicted_roas_p50" in cols:
        aggs.append(F.avg(F.col("predicted_roas_p50").cast("string").try_cast("double")).alias("mean_roas_p50"))
    return pred.agg(*aggs)


def sample_stats(df: DataFrame) -> DataFrame:
    """Means of cost, revenue, installs."""
    return df.agg(F.avg("cost").alias("mean_cost"), F.avg("revenue").alias("mean_revenue"),
                  F.avg("installs").alias("mean_installs"))


METRIC_FAMILIES = {"roas_columns": "roas_d", "retention_columns": "retention_", "level_columns": "level_"}


def metric_columns(df: DataFrame) -> DataFrame:
    """The ROAS, retention and level columns of a table, in its order, as
    (family, position, column_name); read from the schema."""
    rows = [(family, i, c) for family, start in METRIC_FAMILIES.items()
            for i, c in enumerate(c for c in df.columns if c.startswith(start))]
    return df.sparkSession.createDataFrame(rows, "family string, position int, column_name string")


def target_profile(df: DataFrame, target: str) -> DataFrame:
    """Target mean / sample std / min / max, null count and zero-variance flag."""
    t = F.col(target)
    return df.agg(F.avg(t).alias("mean"), F.stddev_samp(t).alias("std"), F.min(t).alias("min"),
                  F.max(t).alias("max"), (F.count(F.lit(1)) - F.count(t)).alias("n_null"),
                  (F.coalesce(F.stddev_samp(t), F.lit(0.0)) == 0).alias("zero_variance"))


def scope_filter(df: DataFrame, scope: Mapping[str, str]) -> DataFrame:
    """AND of equalities; "All" (or None) adds no predicate.  Plain
    comparisons, so Catalyst pushes them into the parquet scan."""
    out = df
    for k, v in scope.items():
        if v is None or v == "All":
            continue
        out = out.where(F.col(k) == F.lit(v))
    return out


def filter_options(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Distinct non-null values per dimension as ``(dimension, value)``.  The table
    is read once for all dimensions, and reduced to their distinct rows first."""
    rows = df.select(*[F.col(d).cast("string").alias(f"v{i}") for i, d in enumerate(dims)]).distinct()
    options = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(f"v{i}").alias("value")) for i, d in enumerate(dims)])
    return rows.select(F.explode(options).alias("o")).select("o.*").where(F.col("value").isNotNull()).distinct()


def feature_summary(df: DataFrame) -> DataFrame:
    """Feature counts by family and type, read from the schema."""
    fams = {"retention": 0, "roas": 0, "level": 0, "cost": 0, "platform": 0}
    numeric = strings = 0
    for f in df.schema.fields:
        n = f.name.lower()
        for fam in fams:
            if fam in n:
                fams[fam] += 1
        if isinstance(f.dataType, NUMERIC_TYPES):
            numeric += 1
        elif isinstance(f.dataType, T.StringType):
            strings += 1
    rows = [(k + "_features", v) for k, v in fams.items()] + [
        ("total_features", len(df.columns)), ("numeric_features", numeric), ("string_features", strings)]
    return df.sparkSession.createDataFrame(rows, "family string, n long")


def schema_fingerprint(df: DataFrame, row_count: int | None = None) -> str:
    """MD5 of ``{"rows": n, "schema": [[name, type], ...]}`` as compact JSON,
    columns sorted by name.  The row count is the only data-dependent part (one
    ``count()``)."""
    fields = sorted([f.name, f.dataType.simpleString()] for f in df.schema.fields)
    text = json.dumps({"rows": df.count() if row_count is None else row_count, "schema": fields}, separators=(",", ":"))
    return hashlib.md5(text.encode()).hexdigest()


def feature_set_fingerprint(names: Sequence[str]) -> str:
    return hashlib.md5(",".join(sorted(names)).encode()).hexdigest()


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))
