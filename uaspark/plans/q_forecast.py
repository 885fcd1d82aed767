"""Forecast queries: segment baseline (M4), split (T5), training set (M8) and the
pinball booster (M1-M3, M5, M7, T2; rows-only - iterative, no SQL form)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import date_parts, date_parts_sql
from ..operators import booster as BO
from ..operators.clean import numeric_columns
from ..operators.features import g2_basics, one_hot, vocabularies
from ..operators.profile import top_values
from ..session import cut_lineage
from .bridge import COHORT_DAYS, HIERARCHY, TARGET_DAYS, Bridge
from .bridge_sql import split_bucket_sql, with_views
from .catalog import query, r6

# Numeric columns that are no features: keys, the split, and the label's own numerator.
NO_FEATURES = ["row_id", "target_day", "split_bucket", "revenue"]


@query("M4_segment_quantiles", with_views("actuals") + """
SELECT platform, channel, target_day, round(quantile_cont(actual, 0.1), 6) AS p10, round(quantile_cont(actual, 0.5), 6) AS p50,
  round(quantile_cont(actual, 0.9), 6) AS p90
FROM actuals WHERE split_bucket <> 0 GROUP BY platform, channel, target_day""")
def m4(b: Bridge) -> DataFrame:
    p = b.baseline.where(F.col("split_bucket") != 0)
    return p.select("platform", "channel", "target_day", r6("p10").alias("p10"), r6("p50").alias("p50"),
                    r6("p90").alias("p90")).distinct()


@query("T5_train_test_split", with_views("campaign") + f"""
SELECT row_id, CASE WHEN {split_bucket_sql('row_id')} = 0 THEN 'test' ELSE 'train' END AS split FROM campaign""")
def t5(b: Bridge) -> DataFrame:
    c = b.campaign
    return c.select("row_id", BO.split_column(F.col("row_id")).alias("split"))


_M8_KEEP = ["installs", "cost"] + [f"retention_rate_d{d}" for d in COHORT_DAYS if d < 7] + \
           [f"roas_d{d}" for d in COHORT_DAYS if d < 7]


@query("M8_training_set", with_views("cohort_wide") + "SELECT campaign_key, round(roas_d21, 6) AS roas_d21, " +
       ", ".join(f"round(coalesce(CAST({c} AS DOUBLE), 0), 6) AS {c}" for c in _M8_KEEP) +
       " FROM cohort_wide WHERE roas_d21 IS NOT NULL")
def m8(b: Bridge) -> DataFrame:
    d, feats = BO.prepare_training(b.cohort_wide, "roas_d21", 7, exclude=["campaign_key"])
    return d.select("campaign_key", r6("roas_d21").alias("roas_d21"),
                    *[r6(F.col(c).cast("double")).alias(c) for c in feats])


TOP_COUNTRIES = 10


def booster_frame(b: Bridge) -> tuple[DataFrame, list[str]]:
    """Actuals of every horizon with the features of their campaign (X4 cost per install, X10 date
    parts, X6 / X7 one-hot columns, cohort features of the segment); and the names of the features."""
    c = b.campaign_cohorts
    c = g2_basics(c.drop("roas")).drop("roas", "cost_per_install")
    c = c.select("*", F.datediff("last_date", "first_date").alias("days_active"), *date_parts(F.col("first_date")))
    for col, values in vocabularies(b.campaign, ["platform", "channel"]).items():
        c = one_hot(c, col, col, values)
    top = [r[0] for r in top_values(b.campaign, "country", TOP_COUNTRIES).collect()]
    c = one_hot(c, "country", "country", top).drop(*HIERARCHY, "cost", "revenue", "installs", "first_date", "last_date")
    frame = cut_lineage(b.actuals.join(c, "row_id"))
    return frame, [f for f in numeric_columns(frame) if f not in [*NO_FEATURES, "actual"]]


def day_features(features: list[str]) -> dict[str, list[str]]:
    """The features that each horizon may use."""
    return {str(day): BO.leakage_safe_columns(features, day) for day in TARGET_DAYS}


_M8_COLS = ["installs", "cost", "ad_revenue", "cohort_players", "cpi", "days_active", "day_of_week", "month", "quarter", "is_weekend"]


@query("M8_campaign_training_set", with_views("campaign_cohorts", "actuals") + """
SELECT a.row_id, round(a.actual, 6) AS actual, """ + ", ".join(
    f"round(coalesce(CAST({c} AS DOUBLE), 0), 6) AS {c}" for c in [*_M8_COLS, *_M8_KEEP[2:]]) + f"""
FROM actuals a JOIN (SELECT * EXCLUDE (cost, installs, revenue, roas, platform, channel, country, game), cost / CASE WHEN installs = 0 THEN 1 ELSE installs END AS cpi,
  date_diff('day', first_date, last_date) AS days_active, {date_parts_sql('first_date')} FROM campaign_cohorts) c USING (row_id)
WHERE target_day = 7 AND actual IS NOT NULL""")
def m8_campaigns(b: Bridge) -> DataFrame:
    """The booster's frame at day 7: one row a campaign, no column of day 7 or later."""
    frame, _ = booster_frame(b)
    d, feats = BO.prepare_training(frame.where(F.col("target_day") == 7), "actual", 7, exclude=NO_FEATURES)
    shown = [c for c in feats if c in _M8_COLS or c in _M8_KEEP]
    return d.select("row_id", r6("actual").alias("actual"), *[r6(F.col(c).cast("double")).alias(c) for c in shown])


def _specs(features: list[str]) -> list[BO.ModelSpec]:
    """A model for each horizon and quantile, on the training split."""
    return [BO.ModelSpec(f"{day}|{name}", alpha, own, (F.col("target_day") == int(day)) & (F.col("split_bucket") != 0))
            for day, own in day_features(features).items() for name, alpha in BO.QUANTILES.items()]


def _predicted(frame: DataFrame, models: dict[str, BO.QuantileBoosterModel], keep: list[str]) -> DataFrame:
    per_day = {}
    for day in TARGET_DAYS:
        own = {name: models[f"{day}|{name}"] for name in BO.QUANTILES}
        per_day[day] = BO.predict_quantiles(own, frame.where(F.col("target_day") == day).drop("p10", "p50", "p90"))
    return BO.multi_horizon(per_day, keep)


@query("M1_M3_quantile_booster")
def m1(b: Bridge) -> DataFrame:
    frame, features = booster_frame(b)
    return _predicted(frame, BO.fit_models(frame, "actual", _specs(features), **BO.PRESETS["standard"]), ["row_id"])


def _pinball(c: str, alpha: float) -> Column:
    d = F.col("actual") - F.col(c)
    return F.greatest(F.lit(alpha) * d, F.lit(alpha - 1.0) * d)


@query("M1_booster_against_baseline", with_views("actuals") + """
SELECT CAST(target_day AS INTEGER) AS target_day, COUNT(*) AS n, COUNT(DISTINCT row_id) AS campaigns, TRUE AS loss_at_most_baseline, TRUE AS coverage_near_80_percent
FROM actuals WHERE actual IS NOT NULL AND split_bucket <> 0 GROUP BY target_day""")
def m1_quality(b: Bridge) -> DataFrame:
    """The light preset on the rows it learned from, beside M4's segment quantiles: every key has a forecast, the
    pinball loss over the three quantiles isn't above M4's, and p10 to p90 covers 70 to 90 percent."""
    frame, features = booster_frame(b)
    models = BO.fit_models(frame, "actual", _specs(features), **BO.PRESETS["light"])
    own = _predicted(frame, models, ["row_id", "actual", "split_bucket"])
    base = b.baseline.select("row_id", "target_day", *[F.col(c).alias(f"base_{c}") for c in BO.QUANTILES])
    rows = own.join(base, ["row_id", "target_day"]).where((F.col("split_bucket") != 0) & F.col("actual").isNotNull())
    loss = sum(F.avg(_pinball(c, a)) for c, a in BO.QUANTILES.items())
    baseline = sum(F.avg(_pinball(f"base_{c}", a)) for c, a in BO.QUANTILES.items())
    inside = F.avg(F.col("actual").between(F.col("p10"), F.col("p90")).cast("double"))
    return rows.groupBy(F.col("target_day").cast("int").alias("target_day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("campaigns"),
        (loss <= baseline).alias("loss_at_most_baseline"), inside.between(0.7, 0.9).alias("coverage_near_80_percent"))


@query("M5_cross_validation")
def m5(b: Bridge) -> DataFrame:
    frame, features = booster_frame(b)
    return BO.cross_validate_median(frame.where(F.col("actual").isNotNull()), day_features(features), "actual", "row_id", folds=5,
                                    by="target_day", **BO.PRESETS["standard"])


@query("M5_fold_rows", with_views("actuals") + f"""
SELECT target_day, CAST(('0x' || substr(md5(CAST(row_id AS VARCHAR)), 1, 8)) AS BIGINT) % 5 AS fold, COUNT(*) AS n
FROM actuals WHERE actual IS NOT NULL GROUP BY ALL""")
def m5_folds(b: Bridge) -> DataFrame:
    """The folds of M5: every row in one of them."""
    return b.actuals.where(F.col("actual").isNotNull()).groupBy("target_day", BO.fold_of("row_id", 5).alias("fold")).agg(
        F.count(F.lit(1)).alias("n"))


@query("M7_T2_feature_importance")
def m7(b: Bridge) -> DataFrame:
    frame, features = booster_frame(b)
    medians = [s for s in _specs(features) if s.name.endswith("p50")]
    models = BO.fit_models(frame, "actual", medians, **BO.PRESETS["standard"])
    tagged = [BO.importance_frame(b.spark, models[f"{day}|p50"].feature_importances(), top=10).select(F.lit(day).alias("target_day"), "*")
              for day in TARGET_DAYS]
    return reduce(DataFrame.unionByName, tagged)
