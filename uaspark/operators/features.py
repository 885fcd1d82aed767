"""Feature builders (X1-X13, W1, W2) and the campaign feature joins.

Metric families are found by name pattern on ``df.columns`` (plan time, no
data touched) and each builder emits ONE ``select`` of derived expressions.
Wide arithmetic replaces the window forms: adjacent-day deltas (W1) and
consecutive-level ratios (W2) are column differences / quotients in numeric
day order, which needs no shuffle at all.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8
EPS_PRUNED = 1e-6
RETENTION_EXTRA_DAYS = [2, 4, 5, 6, 10, 14, 18, 21, 24]


def _c(n: str) -> Column:
    return F.col("`" + n + "`")


def day_columns(columns: Sequence[str], prefix: str) -> list[tuple[int, str]]:
    """``prefix<N>`` columns sorted by numeric day (A.19)."""
    pat = re.compile("^" + re.escape(prefix) + r"(\d+)$")
    found = [(int(m.group(1)), c) for c in columns if (m := pat.match(c))]
    return sorted(found)


def level_columns(columns: Sequence[str]) -> list[tuple[int, str]]:
    """Real level columns (``level_10_events``, ``level 10_events``) by level number (A.3)."""
    pat = re.compile(r"^level[ _]?(\d+)_events$", re.I)
    return sorted((int(m.group(1)), c) for c in columns if (m := pat.match(c)))


def retention_features(df: DataFrame, prefix: str = "retention_rate_d") -> DataFrame:
    """dN_retention copies, slopes (d3-d1)/2, (d7-d1)/6, ratios d3/(d1+1e-8), d7/(d1+1e-8)."""
    days = dict((d, c) for d, c in day_columns(df.columns, prefix))
    out = []
    for d in [1, 3, 7] + RETENTION_EXTRA_DAYS:
        if d in days:
            out.append(_c(days[d]).alias(f"d{d}_retention"))
    if 1 in days and 3 in days:
        out += [((_c(days[3]) - _c(days[1])) / 2).alias("retention_slope_d1_d3"),
                (_c(days[3]) / (_c(days[1]) + EPS)).alias("retention_ratio_d3_d1")]
    if 1 in days and 7 in days:
        out += [((_c(days[7]) - _c(days[1])) / 6).alias("retention_slope_d1_d7"),
                (_c(days[7]) / (_c(days[1]) + EPS)).alias("retention_ratio_d7_d1")]
    return df.select("*", *out)


def roas_features(df: DataFrame) -> DataFrame:
    """ROAS slopes and ratios d1->d3, d1->d7 (+1e-8)."""
    cols = set(df.columns)
    out = []
    if {"roas_d1", "roas_d3"} <= cols:
        out += [((F.col("roas_d3") - F.col("roas_d1")) / 2).alias("roas_slope_d1_d3"),
                (F.col("roas_d3") / (F.col("roas_d1") + EPS)).alias("roas_ratio_d3_d1")]
    if {"roas_d1", "roas_d7"} <= cols:
        out += [((F.col("roas_d7") - F.col("roas_d1")) / 6).alias("roas_slope_d1_d7"),
                (F.col("roas_d7") / (F.col("roas_d1") + EPS)).alias("roas_ratio_d7_d1")]
    return df.select("*", *out)


def level_features(df: DataFrame) -> DataFrame:
    """X3 + W2: canonical ``level_N_events`` columns, consecutive progression
    ratios next / (cur + 1e-8), and the row total (nulls count as 0)."""
    levels = level_columns(df.columns)
    canon = [(n, f"level_{n}_events") for n, _ in levels]
    renamed = [(_c(src).alias(dst) if src != dst else _c(src)) for (_, src), (_, dst) in zip(levels, canon)]
    others = [_c(c) for c in df.columns if c not in {s for _, s in levels}]
    base = df.select(*others, *renamed)
    ratios = [(F.col(canon[i + 1][1]) / (F.col(canon[i][1]) + EPS)).alias(
        f"progression_ratio_{canon[i][0]}_{canon[i + 1][0]}") for i in range(len(canon) - 1)]
    total = sum((F.coalesce(F.col(c), F.lit(0)) for _, c in canon), F.lit(0))
    return base.select("*", *ratios, total.alias("total_level_events"))


def cost_features(df: DataFrame) -> DataFrame:
    """total_spend / total_revenue, roi, profit, profit_margin, cpi, arpu (+1e-8)."""
    cols = set(df.columns)
    spend = F.col("spend") if "spend" in cols else (F.col("cost") if "cost" in cols else None)
    rev = F.col("revenue") if "revenue" in cols else (F.col("ad_revenue") if "ad_revenue" in cols else None)
    out = []
    if spend is not None:
        out.append(spend.alias("total_spend"))
    if rev is not None:
        out.append(rev.alias("total_revenue"))
    if spend is not None and rev is not None:
        out += [(rev / (spend + EPS)).alias("roi"), (rev - spend).alias("profit"),
                ((rev - spend) / (rev + EPS)).alias("profit_margin")]
    if "installs" in cols:
        out.append(F.col("installs").alias("total_installs"))
        if spend is not None:
            out.append((spend / (F.col("installs") + EPS)).alias("cpi"))
        if rev is not None:
            out.append((rev / (F.col("installs") + EPS)).alias("arpu"))
    return df.select("*", *out)


def derived_features(df: DataFrame) -> DataFrame:
    """Squares and ln(x + 1e-8) of d1/d3 retention and ROAS, ln cpi/arpu, interactions."""
    cols = set(df.columns)
    out = []
    for c in ["d1_retention", "d3_retention", "roas_d1", "roas_d3"]:
        if c in cols:
            out += [F.pow(F.col(c), 2).alias(f"{c}_squared"), F.ln(F.col(c) + EPS).alias(f"{c}_log")]
    if {"d1_retention", "roas_d1"} <= cols:
        out.append((F.col("d1_retention") * F.col("roas_d1")).alias("retention_roas_interaction"))
    if {"d3_retention", "roas_d3"} <= cols:
        out.append((F.col("d3_retention") * F.col("roas_d3")).alias("retention_roas_interaction_d3"))
    for c in ["cpi", "arpu"]:
        if c in cols:
            out.append(F.ln(F.col(c) + EPS).alias(f"{c}_log"))
    return df.select("*", *out)


def one_hot(df: DataFrame, col: str, prefix: str, values: Sequence[str]) -> DataFrame:
    """0/1 columns for the given vocabulary.  The vocabulary is an
    argument (from ``vocabularies`` or ``top_values``), so the plan's
    column list is fixed before any data is read."""
    return df.select("*", *[(F.col(col) == F.lit(v)).cast("int").alias(f"{prefix}_{v}") for v in values])


def one_hot_rows(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """X6 without a vocabulary: only the ones, as rows (key, feature), ``<column>_<value>``
    each.  Rows grow with the columns and not with the values, of which there may be any
    number; rows don't move."""
    ones = F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}_"), F.col(c).cast("string"))) for c in cols])
    return df.select(key, F.explode(F.array_compact(ones)).alias("feature"))


def vocabularies(df: DataFrame, cols: Sequence[str], max_values: int = 1_000) -> dict[str, list[str]]:
    """Sorted values of low-cardinality dimensions, all in one pass; more than
    ``max_values`` of one are an error (``one_hot_rows`` takes any number)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols])).alias("e"))
    found = long.where("e.v IS NOT NULL").select("e.*").distinct().limit(max_values * len(cols) + 1).collect()
    out = {c: sorted(r["v"] for r in found if r["c"] == c) for c in cols}
    for c, values in out.items():
        if len(values) > max_values or len(found) > max_values * len(cols):
            raise ValueError(f"{c} has more than {max_values} values")
    return out


def g2_basics(df: DataFrame) -> DataFrame:
    """Cpi and roas with zero denominators replaced by 1."""
    one_if_zero = lambda c: F.when(F.col(c) == 0, F.lit(1)).otherwise(F.col(c))
    return df.select("*", (F.col("cost") / one_if_zero("installs")).alias("cpi"),
                     (F.col("cost") / one_if_zero("installs")).alias("cost_per_install"),
                     (F.col("revenue") / one_if_zero("cost")).alias("roas"))


def roas_deltas(df: DataFrame) -> DataFrame:
    """Adjacent-day ROAS deltas ``roas_dB_vs_roas_dA`` in numeric day order."""
    days = day_columns(df.columns, "roas_d")
    out = [(F.col(b) - F.col(a)).alias(f"{b}_vs_{a}") for (_, a), (_, b) in zip(days, days[1:])]
    return df.select("*", *out)


def retention_percent_to_rate(df: DataFrame) -> DataFrame:
    """``retention_dN`` (percent) -> ``retention_dN_rate``."""
    days = day_columns(df.columns, "retention_d")
    return df.select("*", *[(F.col(c) / 100.0).alias(f"{c}_rate") for _, c in days])


def pruned_features(df: DataFrame) -> DataFrame:
    """X11: early_* copies, inverse ratios d1/(d3+1e-6), d3/(d7+1e-6), null-aware
    mean / max over level columns, cost and spend efficiency."""
    cols = set(df.columns)
    out = []
    for d in [1, 3, 7]:
        if f"retention_d{d}" in cols:
            out.append(F.col(f"retention_d{d}").alias(f"early_retention_d{d}"))
    if {"retention_d1", "retention_d3"} <= cols:
        out.append((F.col("retention_d1") / (F.col("retention_d3") + EPS_PRUNED)).alias("retention_d1_to_d3_ratio"))
    if {"retention_d3", "retention_d7"} <= cols:
        out.append((F.col("retention_d3") / (F.col("retention_d7") + EPS_PRUNED)).alias("retention_d3_to_d7_ratio"))
    for d in [0, 1, 3]:
        if f"roas_d{d}" in cols:
            out.append(F.col(f"roas_d{d}").alias(f"early_roas_d{d}"))
    lv = [c for c in df.columns if "level" in c.lower()]
    if lv:
        vals = [F.col(c).cast("double") for c in lv]
        n = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in vals), F.lit(0))
        s = sum((F.coalesce(v, F.lit(0.0)) for v in vals), F.lit(0.0))
        out += [F.when(n > 0, s / n).alias("avg_early_level"), F.greatest(*vals).alias("max_early_level")]
    if {"cost", "revenue"} <= cols:
        out.append((F.col("revenue") / (F.col("cost") + EPS_PRUNED)).alias("cost_efficiency"))
    if {"spend", "revenue"} <= cols:
        out.append((F.col("revenue") / (F.col("spend") + EPS_PRUNED)).alias("spend_efficiency"))
    return df.select("*", *out)


def platform_flags(df: DataFrame, col: str = "platform") -> DataFrame:
    """Equality with Android / iOS; case-insensitive contains Unity / Mistplay."""
    p = F.col(col)
    return df.select("*", (p == "Android").cast("int").alias("is_android"),
                     (p == "iOS").cast("int").alias("is_ios"),
                     F.coalesce(p.ilike("%unity%"), F.lit(False)).cast("int").alias("is_unity_ads"),
                     F.coalesce(p.ilike("%mistplay%"), F.lit(False)).cast("int").alias("is_mistplay"))


def minimal_features(df: DataFrame, col: str = "platform") -> DataFrame:
    """Fallback feature set."""
    cols = set(df.columns)
    out = []
    if col in cols:
        out += [(F.col(col) == "Android").cast("int").alias("is_android"),
                (F.col(col) == "iOS").cast("int").alias("is_ios")]
    for d in [1, 3]:
        if f"retention_d{d}" in cols:
            out.append(F.col(f"retention_d{d}").alias(f"early_retention_d{d}"))
    return df.select("*", *out)


# ---- J1-J4 ------------------------------------------------------------------

def suffix_join(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str,
                how: str = "left") -> DataFrame:
    """Left join with pandas-style suffixes: right columns that clash get ``suffix``."""
    keys = [k for k in keys if k in left.columns and k in right.columns]
    if not keys:
        return left
    lcols = set(left.columns)
    r = right.select(*keys, *[_c(c).alias(c + suffix if c in lcols else c)
                              for c in right.columns if c not in keys])
    return left.join(r, keys, how)


def campaign_features(retention: DataFrame, roas: DataFrame, levels: DataFrame, spend: DataFrame,
                      keys: Sequence[str]) -> DataFrame:
    """J1-J3 + X1-X5: retention features, then ROAS (``_roas``), level
    (``_level``) and pre-aggregated spend (``_cost``) joined on ``keys``.

    The spend side is aggregated to one row per key BEFORE the join, so the
    joins never multiply rows (A.1); each join shuffles only on ``keys``."""
    f = retention_features(retention)
    f = suffix_join(f, roas, keys, "_roas")
    f = roas_features(f)
    f = suffix_join(f, levels, keys, "_level")
    f = level_features(f)
    agg = spend.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in spend.columns
                                     if c not in keys and c in ("cost", "spend", "revenue", "ad_revenue",
                                                                "installs")])
    f = suffix_join(f, agg, keys, "_cost")
    f = cost_features(f)
    return derived_features(f)


def pruned_join(features: DataFrame, other: DataFrame, keys: Sequence[str], keep: Sequence[str],
                suffix: str) -> DataFrame:
    """Cut the right side to the join keys plus ``keep`` first, then left join."""
    cols = [c for c in keep if c in other.columns]
    return suffix_join(features, other.select(*[k for k in keys if k in other.columns], *cols), keys, suffix)
