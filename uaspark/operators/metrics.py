"""Forecast metrics, prediction summaries and campaign actions
(A8-A11, A15-A18, A23, A25, F2-F5, T1, X14-X19, J5-J8).

All statistics are plain aggregates (partial aggregation map-side); exact
quantiles go through ``exact_percentiles`` so no group is gathered in one
task; the only broadcast is the fixed four-row action table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.advice import ACTIONS, campaign_action, clip_prediction, reason_text
from ..session import broadcast_if_small
from .quantiles import exact_percentiles

THRESHOLDS = [0.5, 1.0, 1.5, 2.0]
MAPE_EPS = 1e-8
APE_CAP = 10.0


def _thr_name(t: float) -> str:
    return str(t).replace(".", "_")


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def prediction_summary(pred: DataFrame, p50: str = "p50", width: str = "width",
                       by: str = "target_day") -> DataFrame:
    """Per horizon count, mean, median, sample std, min, max, share >= each
    threshold, mean and median interval width."""
    base = pred.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_campaigns"), F.avg(p50).alias("mean_predicted_roas"),
        F.stddev_samp(p50).alias("std_predicted_roas"), F.min(p50).alias("min_predicted_roas"),
        F.max(p50).alias("max_predicted_roas"),
        *[count_if(F.col(p50) >= t).alias(f"above_roas_{_thr_name(t)}_count") for t in THRESHOLDS],
        F.avg(width).alias("mean_confidence_width"))
    # both medians from one layout: the two columns are stacked and told apart by name
    names = {p50: "median_predicted_roas", width: "median_confidence_width"}
    stacked = pred.select(by, F.explode(F.array(*[F.struct(F.lit(n).alias("what"), F.col(c).cast("double").alias("v"))
                                                  for c, n in names.items()])).alias("_s")).select(by, "_s.*")
    med = exact_percentiles(stacked, [by, "what"], "v", [0.5], ["m"])
    med = med.groupBy(by).agg(*[F.max(F.when(F.col("what") == n, F.col("m"))).alias(n) for n in names.values()])
    out = base.join(med, by, "left")
    pct = [(F.col(f"above_roas_{_thr_name(t)}_count") * 100.0 / F.col("total_campaigns"))
           .alias(f"above_roas_{_thr_name(t)}_pct") for t in THRESHOLDS]
    return out.select("*", *pct)


def action_rollup(pred: DataFrame, p50: str = "p50", width: str = "width", cost: str | None = "cost",
                  by: Sequence[str] = ("target_day",), row_id: str = "row_id") -> DataFrame:
    """Per horizon and action - count, spend share %, and the number of
    campaigns; all four actions are present (left join from a literal table).
    Without a cost column each row spends 1; a zero total gives share 0."""
    by = list(by)
    spend = F.col(cost) if cost else F.lit(1.0)
    acted = pred.select(*by, F.col(row_id), campaign_action(F.col(p50), F.col(width)).alias("action"),
                        spend.cast("decimal(38,4)").alias("_spend"))  # exact, order-free sums
    per = acted.groupBy(*by, "action").agg(F.count(F.lit(1)).alias("count"),
                                           F.sum("_spend").alias("_spend"))
    totals = acted.groupBy(*by).agg(F.sum("_spend").alias("_total"))
    actions = pred.sparkSession.createDataFrame([(a,) for a in ACTIONS], "action string")
    grid = totals.crossJoin(F.broadcast(actions))  # 4-row literal table: bounded broadcast
    out = grid.join(per, [*by, "action"], "left")
    share = F.coalesce(F.try_divide(F.col("_spend").cast("double"), F.col("_total").cast("double")),
                       F.lit(0.0)) * 100.0
    return out.select(*by, "action", F.coalesce(F.col("count"), F.lit(0)).alias("count"),
                      share.alias("spend_share"))


def action_members(pred: DataFrame, p50: str = "p50", width: str = "width", cost: str = "cost",
                   row_id: str = "row_id") -> DataFrame:
    """A9 detail / J8: one row per campaign with its action (the campaign list
    of the roll-up, kept as rows instead of one collected list per action)."""
    return pred.select("*", campaign_action(F.col(p50), F.col(width)).alias("action"))


def quantile_summary(pred: DataFrame, col: str = "p50", by: Sequence[str] = ()) -> DataFrame:
    """A10: mean, p10, p50, p90 of the median forecast (exact, linear)."""
    by = list(by)
    q = exact_percentiles(pred, by, col, [0.1, 0.5, 0.9], ["p10", "p50", "p90"])
    m = pred.groupBy(*by).agg(F.avg(col).alias("mean"))
    return m.crossJoin(q) if not by else m.join(q, by, "left")


def roas_bands(pred: DataFrame, col: str = "p50", lower: str = "p10", upper: str = "p90",
               by: Sequence[str] = ()) -> DataFrame:
    """> 1.0, (0.5, 1.0], <= 0.5 counts and %, plus mean/min/max/std and mean width."""
    p = F.col(col)
    n = F.count(F.lit(1))
    return pred.groupBy(*by).agg(
        n.alias("n"), F.avg(p).alias("mean"), F.min(p).alias("min"), F.max(p).alias("max"),
        F.stddev_samp(p).alias("std"),
        count_if(p > 1.0).alias("high_count"), count_if((p > 0.5) & (p <= 1.0)).alias("medium_count"),
        count_if(p <= 0.5).alias("low_count"),
        (count_if(p > 1.0) * 100.0 / n).alias("high_pct"),
        (count_if((p > 0.5) & (p <= 1.0)) * 100.0 / n).alias("medium_pct"),
        (count_if(p <= 0.5) * 100.0 / n).alias("low_pct"),
        F.avg(F.col(upper) - F.col(lower)).alias("mean_width"))


def evaluation_mask(df: DataFrame, actual: str = "actual", pred: str = "p50") -> DataFrame:
    """finite actual and prediction, actual > 0."""
    a, p = F.col(actual), F.col(pred)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return df.where(finite(a) & finite(p) & (a > 0))


def forecast_metrics(df: DataFrame, actual: str = "actual", pred: str = "p50", lower: str = "p10",
                     upper: str = "p90", by: Sequence[str] = (), mape: str = "fraction") -> DataFrame:
    """MAPE, RMSE, MAE, R2, interval coverage over the F3 mask.

    ``mape``: ``fraction`` (mean |e|/|y|), ``percent`` (x100 with +1e-8), see A.9.
    R2 = 1 - SS_res / SS_tot with SS_tot = var_pop * n (0 when SS_tot is 0)."""
    d = evaluation_mask(df, actual, pred)
    a, p = F.col(actual), F.col(pred)
    err = a - p
    if mape == "percent":
        ape = F.avg(F.abs(err) / (F.abs(a) + MAPE_EPS)) * 100.0
    else:
        ape = F.avg(F.abs(err) / F.abs(a))
    n = F.count(F.lit(1))
    ss_res = F.sum(err * err)
    ss_tot = F.var_pop(a) * n
    r2 = F.when(ss_tot != 0, F.lit(1.0) - ss_res / ss_tot).otherwise(F.lit(0.0))
    cover = F.avg(((a >= F.col(lower)) & (a <= F.col(upper))).cast("double"))
    return d.groupBy(*by).agg(n.alias("n"), ape.alias("mape"), F.sqrt(F.avg(err * err)).alias("rmse"),
                              F.avg(F.abs(err)).alias("mae"), r2.alias("r2"), cover.alias("coverage"))


def scoped_validation(df: DataFrame, actual: str = "actual", pred: str = "p50") -> DataFrame:
    """Abs error and APE = |err| / nullif(actual, 0) capped at 10, then means."""
    a, p = F.col(actual), F.col(pred)
    ae = F.abs(a - p)
    ape = F.least(F.try_divide(ae, F.when(a != 0, a)), F.lit(APE_CAP))
    v = df.select("*", ae.alias("abs_error"), ape.alias("ape"))
    return v.agg(F.count(F.lit(1)).alias("n"), F.avg("abs_error").alias("mean_abs_error"),
                 F.avg("ape").alias("mean_ape"))


def error_histogram(df: DataFrame, actual: str = "actual", pred: str = "p50", bins: int = 30,
                    by: Sequence[str] = ()) -> DataFrame:
    """30 equal-width bins of |error| between its min and max (one
    aggregate for the bounds, cross-joined back as a one-row side)."""
    by = list(by)
    e = df.select(*by, F.abs(F.col(actual) - F.col(pred)).alias("abs_error")).where(F.col("abs_error").isNotNull())
    bounds = e.groupBy(*by).agg(F.min("abs_error").alias("_lo"), F.max("abs_error").alias("_hi"))
    j = e.join(broadcast_if_small(bounds), by) if by else e.crossJoin(F.broadcast(bounds))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("abs_error") - F.col("_lo")) / width).cast("int"), F.lit(bins - 1)))
    return j.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"),
                                                F.min("_lo").alias("lo"), F.min("_hi").alias("hi"))


def correlation_ranking(df: DataFrame, cols: Sequence[str], top: int = 20) -> DataFrame:
    """The ``top`` columns by sum of |Pearson correlation| with all columns
    (nulls count 0).  One pass collects a k x k matrix (``ml.stat.Correlation``),
    so hundreds of columns cost one aggregation."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    cols = list(cols)
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_f{i}") for i, c in enumerate(cols)])
    vectors = VectorAssembler(inputCols=filled.columns, outputCol="v").transform(filled)
    if not cols or vectors.isEmpty():
        return df.sparkSession.createDataFrame([], "feature string, sum_abs_corr double")
    matrix = Correlation.corr(vectors, "v").first()[0].toArray()
    rows = [(c, float(sum(1.0 if i == j else abs(x) if x == x else 0.0 for j, x in enumerate(matrix[i]))))
            for i, c in enumerate(cols)]
    return (df.sparkSession.createDataFrame(rows, "feature string, sum_abs_corr double")
            .orderBy(F.desc("sum_abs_corr"), "feature").limit(top))


def confidence_filter(pred: DataFrame, width: str = "width", threshold: float = 0.8,
                      by: Sequence[str] = ()) -> DataFrame:
    """keep rows whose width <= the (1 - threshold) quantile of width, per ``by``."""
    by = list(by)
    q = broadcast_if_small(exact_percentiles(pred, by, width, [1.0 - threshold], ["_max_width"]))
    joined = pred.join(q, by) if by else pred.crossJoin(F.broadcast(q))
    return joined.where(F.col(width) <= F.col("_max_width")).drop("_max_width")


def recommend(pred: DataFrame, target_roas: float = 0.5, n: int = 10, confidence_threshold: float = 0.8,
              p50: str = "p50", width: str = "width", row_id: str = "row_id", by: Sequence[str] = ()) -> DataFrame:
    """T1 + F5 + X17/X18: top-n campaigns by improvement = predicted - target
    among the confident rows of each ``by``, ties by row id (a top-k report;
    Spark keeps n rows per group and task before the shuffle)."""
    conf = confidence_filter(pred, width, confidence_threshold, by)
    out = conf.select("*", (F.col(p50) - F.lit(target_roas)).alias("roas_improvement"))
    order = [F.desc("roas_improvement"), F.asc(row_id)]
    if by:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        top = out.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")
    else:
        top = out.orderBy(*order).limit(n)
    return top.select("*", reason_text(F.col(p50), F.lit(target_roas), F.col("roas_improvement"))
                      .alias("recommendation_reason"))


def recommendation_summary(rec: DataFrame, p50: str = "p50", by: Sequence[str] = ()) -> DataFrame:
    """Mean / max improvement, mean ROAS, count."""
    return rec.groupBy(*by).agg(F.avg("roas_improvement").alias("avg_improvement"),
                                F.max("roas_improvement").alias("max_improvement"),
                                F.avg(p50).alias("avg_roas"), F.count(F.lit(1)).alias("n"))


def residual_pairs(pred: DataFrame, actual: str = "actual", p50: str = "p50") -> DataFrame:
    """Actual, predicted and residual (actual - predicted) of every row that has both."""
    both = pred.where(F.col(actual).isNotNull() & F.col(p50).isNotNull())
    return both.select("*", (F.col(actual) - F.col(p50)).alias("residual"))


def clipped_predictions(pred: DataFrame, cols: Sequence[str] = ("p10", "p50", "p90")) -> DataFrame:
    """Clip every quantile, then width = upper - lower (also clipped)."""
    c = [clip_prediction(F.col(x)).alias(x) for x in cols]
    keep = [x for x in pred.columns if x not in cols and x != "width"]
    out = pred.select(*keep, *c)
    return out.select("*", clip_prediction(F.col(cols[-1]) - F.col(cols[0])).alias("width"))
