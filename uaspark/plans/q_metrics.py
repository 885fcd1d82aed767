"""Metrics, summaries and actions over the segment-quantile predictions.

A8-A11, A15-A18, A23, A25, F2-F5, T1, X14-X19, J5-J8.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import advice as ADV
from ..operators import metrics as M
from .bridge import COHORT_DAYS, HIERARCHY, LEVELS, Bridge
from .bridge_sql import with_views
from .catalog import query, r6

PV = with_views("predictions")
ACTION_SQL = ADV.campaign_action_sql("p50", "width")


def _r(df: DataFrame, keep: list[str], cols: list[str]) -> DataFrame:
    return df.select(*keep, *[r6(c).alias(c) for c in cols])


_A8 = ["mean_predicted_roas", "std_predicted_roas", "min_predicted_roas", "max_predicted_roas",
       "mean_confidence_width", "median_predicted_roas", "median_confidence_width"] + \
      [f"above_roas_{M._thr_name(t)}_pct" for t in M.THRESHOLDS]


@query("A8_prediction_summary", PV + "SELECT target_day, COUNT(*) AS total_campaigns, " + ", ".join(
    [f"COUNT(CASE WHEN p50 >= {t} THEN 1 END) AS above_roas_{M._thr_name(t)}_count" for t in M.THRESHOLDS] +
    [f"round(COUNT(CASE WHEN p50 >= {t} THEN 1 END) * CAST(100 AS DOUBLE) / COUNT(*), 6) AS above_roas_{M._thr_name(t)}_pct"
     for t in M.THRESHOLDS]) + """,
  round(AVG(p50), 6) AS mean_predicted_roas, round(STDDEV_SAMP(p50), 6) AS std_predicted_roas,
  round(MIN(p50), 6) AS min_predicted_roas, round(MAX(p50), 6) AS max_predicted_roas,
  round(AVG(width), 6) AS mean_confidence_width, round(quantile_cont(p50, 0.5), 6) AS median_predicted_roas,
  round(quantile_cont(width, 0.5), 6) AS median_confidence_width
FROM predictions GROUP BY target_day""")
def a8(b: Bridge) -> DataFrame:
    s = M.prediction_summary(b.predictions)
    return _r(s, ["target_day", "total_campaigns"] +
              [f"above_roas_{M._thr_name(t)}_count" for t in M.THRESHOLDS], _A8)


@query("A9_action_rollup", PV + f"""
, acted AS (SELECT target_day, {ACTION_SQL} AS action, CAST(cost AS DECIMAL(38,4)) AS spend FROM predictions),
per AS (SELECT target_day, action, COUNT(*) AS count, SUM(spend) AS spend FROM acted GROUP BY target_day, action),
tot AS (SELECT target_day, SUM(spend) AS total FROM acted GROUP BY target_day),
acts AS (SELECT * FROM (VALUES ('scale'), ('maintain'), ('reduce'), ('cut')) t(action))
SELECT t.target_day, a.action, coalesce(p.count, 0) AS count,
       round(coalesce(CAST(p.spend AS DOUBLE) / NULLIF(CAST(t.total AS DOUBLE), 0), 0.0) * 100.0, 6) AS spend_share
FROM tot t CROSS JOIN acts a LEFT JOIN per p ON p.target_day = t.target_day AND p.action = a.action""")
def a9(b: Bridge) -> DataFrame:
    r = M.action_rollup(b.predictions)
    return r.select("target_day", "action", "count", r6("spend_share").alias("spend_share"))


@query("A10_quantile_summary", PV + """
SELECT target_day, round(AVG(p50), 6) AS mean, round(quantile_cont(p50, 0.1), 6) AS p10,
       round(quantile_cont(p50, 0.5), 6) AS p50, round(quantile_cont(p50, 0.9), 6) AS p90
FROM predictions GROUP BY target_day""")
def a10(b: Bridge) -> DataFrame:
    q = M.quantile_summary(b.predictions, "p50", ["target_day"])
    return _r(q, ["target_day"], ["mean", "p10", "p50", "p90"])


_A11 = ["mean", "min", "max", "std", "high_pct", "medium_pct", "low_pct", "mean_width"]


@query("A11_roas_bands", PV + """
SELECT target_day, COUNT(*) AS n, round(AVG(p50), 6) AS mean, round(MIN(p50), 6) AS min, round(MAX(p50), 6) AS max,
  round(STDDEV_SAMP(p50), 6) AS std, COUNT(CASE WHEN p50 > 1.0 THEN 1 END) AS high_count,
  COUNT(CASE WHEN p50 > 0.5 AND p50 <= 1.0 THEN 1 END) AS medium_count,
  COUNT(CASE WHEN p50 <= 0.5 THEN 1 END) AS low_count,
  round(COUNT(CASE WHEN p50 > 1.0 THEN 1 END) * CAST(100 AS DOUBLE) / COUNT(*), 6) AS high_pct,
  round(COUNT(CASE WHEN p50 > 0.5 AND p50 <= 1.0 THEN 1 END) * CAST(100 AS DOUBLE) / COUNT(*), 6) AS medium_pct,
  round(COUNT(CASE WHEN p50 <= 0.5 THEN 1 END) * CAST(100 AS DOUBLE) / COUNT(*), 6) AS low_pct,
  round(AVG(p90 - p10), 6) AS mean_width
FROM predictions GROUP BY target_day""")
def a11(b: Bridge) -> DataFrame:
    s = M.roas_bands(b.predictions, by=["target_day"])
    return _r(s, ["target_day", "n", "high_count", "medium_count", "low_count"], _A11)


_MASK = "actual IS NOT NULL AND NOT isnan(actual) AND NOT isinf(actual) AND p50 IS NOT NULL AND NOT isnan(p50) AND NOT isinf(p50) AND actual > 0"


def _metrics_sql(pred: str, mape: str, group: str, src: str) -> str:
    ape = (f"AVG(abs(actual - {pred}) / (abs(actual) + 1e-8)) * 100.0" if mape == "percent"
           else f"AVG(abs(actual - {pred}) / abs(actual))")
    return f"""SELECT {group}, COUNT(*) AS n, round({ape}, 6) AS mape,
  round(sqrt(AVG((actual - {pred}) * (actual - {pred}))), 6) AS rmse, round(AVG(abs(actual - {pred})), 6) AS mae,
  round(CASE WHEN var_pop(actual) * COUNT(*) <> 0
             THEN 1.0 - SUM((actual - {pred}) * (actual - {pred})) / (var_pop(actual) * COUNT(*)) ELSE 0.0 END, 6) AS r2,
  round(AVG(CAST(actual >= p10 AND actual <= p90 AS DOUBLE)), 6) AS coverage
FROM {src} GROUP BY {group}"""


_METRICS = ["mape", "rmse", "mae", "r2", "coverage"]


@query("A16_forecast_metrics", PV + _metrics_sql(
    "p50", "fraction", "target_day", f"(SELECT * FROM predictions WHERE split_bucket = 0 AND {_MASK})"))
def a16(b: Bridge) -> DataFrame:
    test = b.predictions.where(F.col("split_bucket") == 0)
    return _r(M.forecast_metrics(test, by=["target_day"]), ["target_day", "n"], _METRICS)


@query("M6_quantile_model_metrics", PV + """
, long AS (SELECT target_day, 'q' || q AS quantile, actual, pred, p10, p90 FROM predictions
           CROSS JOIN (VALUES ('0.1'), ('0.5'), ('0.9')) t(q)
           CROSS JOIN LATERAL (SELECT CASE q WHEN '0.1' THEN p10 WHEN '0.5' THEN p50 ELSE p90 END AS pred)
           WHERE split_bucket = 0)
""" + _metrics_sql("pred", "percent", "target_day, quantile",
                   "(SELECT * FROM long WHERE actual IS NOT NULL AND NOT isnan(actual) AND NOT isinf(actual) "
                   "AND pred IS NOT NULL AND NOT isnan(pred) AND NOT isinf(pred) AND actual > 0)"))
def m6(b: Bridge) -> DataFrame:
    test = b.predictions.where(F.col("split_bucket") == 0)
    long = test.select("target_day", "actual", "p10", "p90",
                       F.explode(F.array(*[F.struct(F.lit(f"q{q}").alias("quantile"), F.col(c).alias("pred"))
                                           for q, c in [("0.1", "p10"), ("0.5", "p50"), ("0.9", "p90")]])).alias("_q"))
    long = long.select("target_day", "actual", "p10", "p90", "_q.quantile", "_q.pred")
    m = M.forecast_metrics(long, pred="pred", by=["target_day", "quantile"], mape="percent")
    return _r(m, ["target_day", "quantile", "n"], _METRICS)


@query("A25_metric_grades", PV + """
, m AS (""" + _metrics_sql("p50", "fraction", "target_day",
                           f"(SELECT * FROM predictions WHERE split_bucket = 0 AND {_MASK})") + """)
SELECT target_day,
  CASE WHEN r2 > 0.8 THEN 'Excellent' WHEN r2 > 0.6 THEN 'Good' WHEN r2 > 0.4 THEN 'Fair' ELSE 'Poor' END AS r2_grade,
  CASE WHEN rmse < 0.1 THEN 'Low' WHEN rmse < 0.3 THEN 'Moderate' ELSE 'High' END AS rmse_grade,
  CASE WHEN mape < 0.1 THEN 'Excellent' WHEN mape < 0.2 THEN 'Good' WHEN mape < 0.3 THEN 'Fair' ELSE 'Poor' END AS mape_grade,
  CASE WHEN coverage > 0.8 THEN 'Good' WHEN coverage > 0.6 THEN 'Fair' ELSE 'Poor' END AS coverage_grade
FROM m""")
def a25(b: Bridge) -> DataFrame:
    m = a16(b)
    return m.select("target_day", ADV.grade_r2(F.col("r2")).alias("r2_grade"),
                    ADV.grade_rmse(F.col("rmse")).alias("rmse_grade"),
                    ADV.grade_mape(F.col("mape")).alias("mape_grade"),
                    ADV.grade_coverage(F.col("coverage")).alias("coverage_grade"))


# relative error and tenths of covered rows of eight made-up forecasts, so that every grade is earned
_ERRORS, _COVERED = [0.01, 0.1, 0.13, 0.15, 0.25, 0.4, 0.05, 0.2], [9, 7, 3, 9, 7, 3, 10, 0]
_MODELS_SQL = f"""(SELECT model, actual, p50, p50 - half AS p10, p50 + half AS p90 FROM (
  SELECT model, actual, actual * (1.0 + e * CASE WHEN k % 2 = 0 THEN 1.0 ELSE -1.0 END) AS p50,
         actual * e * CASE WHEN k % 10 < c THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END AS half
  FROM (SELECT *, {_ERRORS!r}[CAST(model + 1 AS INTEGER)]::DOUBLE AS e, {_COVERED!r}[CAST(model + 1 AS INTEGER)] AS c
        FROM (SELECT row_id % 8 AS model, row_id // 8 AS k, actual FROM actuals WHERE target_day = 30))))"""


@query("A25_grades_of_models", with_views("actuals") + """
, m AS (""" + _metrics_sql("p50", "fraction", "model", f"(SELECT * FROM {_MODELS_SQL} WHERE {_MASK})") + """)
SELECT model, n,
  CASE WHEN r2 > 0.8 THEN 'Excellent' WHEN r2 > 0.6 THEN 'Good' WHEN r2 > 0.4 THEN 'Fair' ELSE 'Poor' END AS r2_grade,
  CASE WHEN rmse < 0.1 THEN 'Low' WHEN rmse < 0.3 THEN 'Moderate' ELSE 'High' END AS rmse_grade,
  CASE WHEN mape < 0.1 THEN 'Excellent' WHEN mape < 0.2 THEN 'Good' WHEN mape < 0.3 THEN 'Fair' ELSE 'Poor' END AS mape_grade,
  CASE WHEN coverage > 0.8 THEN 'Good' WHEN coverage > 0.6 THEN 'Fair' ELSE 'Poor' END AS coverage_grade
FROM m""")
def a25_models(b: Bridge) -> DataFrame:
    """Forecasts of eight kinds of error over the actuals: every grade occurs."""
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("model") + 1).cast("int"))
    rows = b.actuals.where(F.col("target_day") == 30).select(
        (F.col("row_id") % 8).alias("model"), F.expr("row_id div 8").alias("k"), "actual")
    rows = rows.withColumn("p50", F.col("actual") * (1.0 + at(_ERRORS) * F.when(F.col("k") % 2 == 0, 1.0).otherwise(-1.0)))
    half = F.col("actual") * at(_ERRORS) * F.when(F.col("k") % 10 < at(_COVERED), 1.5).otherwise(0.5)
    rows = rows.withColumns({"p10": F.col("p50") - half, "p90": F.col("p50") + half})
    m = M.forecast_metrics(rows, by=["model"])
    return m.select("model", "n", ADV.grade_r2(F.col("r2")).alias("r2_grade"), ADV.grade_rmse(F.col("rmse")).alias("rmse_grade"),
                    ADV.grade_mape(F.col("mape")).alias("mape_grade"), ADV.grade_coverage(F.col("coverage")).alias("coverage_grade"))


@query("A17_scoped_validation", PV + """
SELECT COUNT(*) AS n, round(AVG(abs(actual - p50)), 6) AS mean_abs_error,
  round(AVG(least(abs(actual - p50) / NULLIF(actual, 0), 10.0)), 6) AS mean_ape
FROM predictions WHERE platform = 'BUILDING' AND target_day = 30""")
def a17(b: Bridge) -> DataFrame:
    from ..operators.profile import scope_filter
    s = scope_filter(b.predictions, {"platform": "BUILDING", "game": "All"}).where(F.col("target_day") == 30)
    return _r(M.scoped_validation(s), ["n"], ["mean_abs_error", "mean_ape"])


@query("A18_error_histogram", PV + """
, e AS (SELECT target_day, abs(actual - p50) AS abs_error FROM predictions WHERE abs(actual - p50) IS NOT NULL),
bnd AS (SELECT target_day, MIN(abs_error) AS lo, MAX(abs_error) AS hi FROM e GROUP BY target_day)
SELECT e.target_day, CASE WHEN hi = lo THEN 0 ELSE CAST(least(floor((abs_error - lo) / ((hi - lo) / 30)), 29) AS INTEGER) END AS bin,
  COUNT(*) AS n, round(MIN(lo), 6) AS lo, round(MIN(hi), 6) AS hi
FROM e JOIN bnd ON e.target_day = bnd.target_day GROUP BY e.target_day, bin""")
def a18(b: Bridge) -> DataFrame:
    h = M.error_histogram(b.predictions, by=["target_day"])
    return h.select("target_day", "bin", "n", r6("lo").alias("lo"), r6("hi").alias("hi"))


# every numeric column of the wide cohort and level features: 23, so the top 20 cuts
_CORR = (["cost"] + [f"retention_rate_d{n}" for n in COHORT_DAYS] + [f"roas_d{n}" for n in COHORT_DAYS]
         + [f"level_{n}_events" for n in LEVELS])
_PAIRS = [(a, c) for i, a in enumerate(_CORR) for c in _CORR[i + 1:]]


@query("A15_correlation_ranking", with_views("cohort_wide", "levels_wide") + """
, wide AS (SELECT c.*, """ + ", ".join(f"l.level_{n}_events" for n in LEVELS) + """ FROM cohort_wide c JOIN levels_wide l USING (campaign_key)),
one AS (SELECT """ + ", ".join(f"corr(coalesce({a}, 0), coalesce({c}, 0)) AS \"{a}|{c}\"" for a, c in _PAIRS) + """ FROM wide),
long AS (SELECT pair, abs(v) AS a FROM one UNPIVOT (v FOR pair IN (""" + ", ".join(f'"{a}|{c}"' for a, c in _PAIRS) + """)))
SELECT feature, round(SUM(CASE WHEN a IS NULL OR isnan(a) THEN 0.0 ELSE a END) + 1.0, 6) AS sum_abs_corr FROM (
  SELECT split_part(pair, '|', 1) AS feature, a FROM long UNION ALL SELECT split_part(pair, '|', 2), a FROM long)
GROUP BY feature ORDER BY sum_abs_corr DESC, feature LIMIT 20""")
def a15(b: Bridge) -> DataFrame:
    levels = b.levels_wide.select("campaign_key", *[f"level_{n}_events" for n in LEVELS])
    r = M.correlation_ranking(b.cohort_wide.join(levels, "campaign_key"), _CORR, 20)
    return r.select("feature", r6("sum_abs_corr").alias("sum_abs_corr"))


@query("F2_nonnull_target", with_views("cohort_wide") + """
SELECT campaign_key, round(roas_d21, 6) AS roas_d21 FROM cohort_wide WHERE roas_d21 IS NOT NULL AND campaign_key % 3 <> 0""")
def f2(b: Bridge) -> DataFrame:
    from ..operators.booster import nonnull_target
    some = b.cohort_wide.withColumn("roas_d21", F.when(F.col("campaign_key") % 3 != 0, F.col("roas_d21")))
    return nonnull_target(some, "roas_d21").select("campaign_key", r6("roas_d21").alias("roas_d21"))


@query("F3_evaluation_mask", PV + f"""
SELECT target_day, COUNT(*) AS n FROM (SELECT * REPLACE (CASE WHEN row_id % 5 = 0 THEN NULL WHEN row_id % 5 = 1 THEN 0.0
  WHEN row_id % 5 = 2 THEN 'nan'::DOUBLE ELSE actual END AS actual) FROM predictions) WHERE {_MASK} GROUP BY target_day""")
def f3(b: Bridge) -> DataFrame:
    """Actuals of which some are missing, zero or no number."""
    k = F.col("row_id") % 5
    some = F.when(k == 0, F.lit(None)).when(k == 1, 0.0).when(k == 2, float("nan")).otherwise(F.col("actual"))
    return M.evaluation_mask(b.predictions.withColumn("actual", some)).groupBy("target_day").agg(F.count(F.lit(1)).alias("n"))


_CONF = """, conf AS (SELECT p.* FROM predictions p JOIN (
  SELECT target_day, quantile_cont(width, 0.2) AS w FROM predictions GROUP BY target_day) q
  ON p.target_day = q.target_day AND p.width <= q.w)"""


@query("F5_confidence_filter", PV + _CONF + """
SELECT target_day, row_id, round(width, 6) AS width FROM conf""")
def f5(b: Bridge) -> DataFrame:
    return M.confidence_filter(b.predictions, "width", 0.8, ["target_day"]).select(
        "target_day", "row_id", r6("width").alias("width"))


_T1_SQL = PV + _CONF + """,
top AS (SELECT * FROM (SELECT target_day, row_id, p50, p50 - 0.5 AS roas_improvement,
          ROW_NUMBER() OVER (PARTITION BY target_day ORDER BY p50 - 0.5 DESC, row_id) AS place FROM conf) WHERE place <= 10)"""


@query("T1_top_recommendations", _T1_SQL + """
SELECT target_day, row_id, round(p50, 6) AS p50, round(roas_improvement, 6) AS roas_improvement,
  printf('Predicted ROAS %.3f vs target %.3f (improvement: %.3f)', p50, 0.5, roas_improvement) AS recommendation_reason
FROM top""")
def t1(b: Bridge) -> DataFrame:
    r = M.recommend(b.predictions, 0.5, 10, 0.8, by=["target_day"])
    return r.select("target_day", "row_id", r6("p50").alias("p50"), r6("roas_improvement").alias("roas_improvement"),
                    "recommendation_reason")


@query("A23_recommendation_summary", _T1_SQL + """
SELECT target_day, round(AVG(roas_improvement), 6) AS avg_improvement, round(MAX(roas_improvement), 6) AS max_improvement,
  round(AVG(p50), 6) AS avg_roas, COUNT(*) AS n FROM top GROUP BY target_day""")
def a23(b: Bridge) -> DataFrame:
    r = M.recommend(b.predictions, 0.5, 10, 0.8, by=["target_day"])
    s = M.recommendation_summary(r, by=["target_day"])
    return _r(s, ["target_day", "n"], ["avg_improvement", "max_improvement", "avg_roas"])


@query("X14_X19_campaign_advice", PV + f"""
SELECT row_id, target_day, {ADV.advice_tier_sql('(1.0 - p50)')} AS recommendation,
  {ADV.confidence_level_sql('(p90 - p10)')} AS confidence_level, {ACTION_SQL} AS action,
  round(actual - p50, 6) AS prediction_error, round(p50 - 1.0, 6) AS roas_improvement,
  round(greatest(0.0, least(10.0, p10)), 6) AS p10c, round(greatest(0.0, least(10.0, p50)), 6) AS p50c,
  round(greatest(0.0, least(10.0, p90)), 6) AS p90c,
  round(greatest(0.0, least(10.0, greatest(0.0, least(10.0, p90)) - greatest(0.0, least(10.0, p10)))), 6) AS widthc
FROM predictions""")
def x14(b: Bridge) -> DataFrame:
    p = b.predictions
    adv = p.select("row_id", "target_day", "actual", "p10", "p50", "p90", "width",
                   ADV.advice_tier(F.lit(1.0) - F.col("p50")).alias("recommendation"),
                   ADV.confidence_level(F.col("p90") - F.col("p10")).alias("confidence_level"),
                   ADV.campaign_action(F.col("p50"), F.col("width")).alias("action"),
                   (F.col("actual") - F.col("p50")).alias("prediction_error"),
                   (F.col("p50") - F.lit(1.0)).alias("roas_improvement"))
    c = M.clipped_predictions(adv)
    return c.select("row_id", "target_day", "recommendation", "confidence_level", "action",
                    r6("prediction_error").alias("prediction_error"), r6("roas_improvement").alias("roas_improvement"),
                    r6("p10").alias("p10c"), r6("p50").alias("p50c"), r6("p90").alias("p90c"),
                    r6("width").alias("widthc"))


@query("X16_rule_fallback", with_views("campaign") + """
SELECT row_id, CASE WHEN r >= 1.5 AND 0.8 < 0.5 THEN 'Scale' WHEN r >= 1.0 AND 0.8 < 0.8 THEN 'Maintain'
                    WHEN r >= 0.5 THEN 'Reduce' ELSE 'Cut' END AS action,
  printf('Heuristic: roas~%.2f, conf~%.2f', r, 0.8) AS rationale
FROM (SELECT row_id, coalesce(revenue, 0.0) / (coalesce(cost, 0.0) + 1e-9) AS r FROM campaign)""")
def x16(b: Bridge) -> DataFrame:
    c = b.campaign
    r = ADV.roas_proxy(F.col("cost"), F.col("revenue"))
    act = ADV.campaign_action(r, F.lit(ADV.DEFAULT_WIDTH))
    return c.select("row_id", F.initcap(act).alias("action"),
                    F.format_string("Heuristic: roas~%.2f, conf~%.2f", r, F.lit(ADV.DEFAULT_WIDTH)).alias("rationale"))


@query("J5_actual_vs_predicted", with_views("actuals", "predictions") + """
SELECT a.row_id, a.target_day, round(a.actual, 6) AS actual, round(p.p50, 6) AS p50
FROM actuals a JOIN predictions p ON a.row_id = p.row_id AND a.target_day = p.target_day""")
def j5(b: Bridge) -> DataFrame:
    a = b.actuals.select("row_id", "target_day", "actual")
    p = b.predictions.select("row_id", "target_day", "p50")
    j = a.join(p, ["row_id", "target_day"], "inner")
    return j.select("row_id", "target_day", r6("actual").alias("actual"), r6("p50").alias("p50"))


@query("J6_J7_prediction_context", with_views("campaign", "predictions") + """
SELECT p.row_id, p.target_day, c.first_date AS date, c.platform, c.channel, c.country, c.game,
  round(c.cost, 6) AS cost, round(c.revenue, 6) AS revenue, c.installs,
  round(abs(p.actual - p.p50), 6) AS abs_error
FROM predictions p LEFT JOIN campaign c ON p.row_id = c.row_id""")
def j6(b: Bridge) -> DataFrame:
    p = b.predictions.select("row_id", "target_day", (F.abs(F.col("actual") - F.col("p50"))).alias("abs_error"))
    ctx = b.campaign.select("row_id", F.col("first_date").alias("date"), *HIERARCHY, "cost", "revenue", "installs")
    j = p.join(ctx, "row_id", "left")
    return j.select("row_id", "target_day", "date", *HIERARCHY, r6("cost").alias("cost"),
                    r6("revenue").alias("revenue"), "installs", r6("abs_error").alias("abs_error"))


@query("J8_attach_actions", PV + f"""
SELECT a.row_id, a.target_day, p.action FROM actuals a
LEFT JOIN (SELECT row_id, target_day, {ACTION_SQL} AS action FROM predictions) p
  ON p.row_id = a.row_id AND p.target_day = a.target_day""")
def j8(b: Bridge) -> DataFrame:
    acts = M.action_members(b.predictions).select("row_id", "target_day", "action")
    return b.actuals.select("row_id", "target_day").join(acts, ["row_id", "target_day"], "left")


@query("A9_action_members", PV + f"""
SELECT target_day, {ACTION_SQL} AS action, row_id, game, platform, channel, country, round(cost, 6) AS cost,
  round(p50, 6) AS p50, round(width, 6) AS width FROM predictions""")
def a9_members(b: Bridge) -> DataFrame:
    """The campaign list of every action, as rows."""
    m = M.action_members(b.predictions)
    return m.select("target_day", "action", "row_id", *HIERARCHY, r6("cost").alias("cost"), r6("p50").alias("p50"),
                    r6("width").alias("width"))


@query("A18_residual_pairs", PV + """
SELECT row_id, target_day, round(actual, 6) AS actual, round(p50, 6) AS p50, round(actual - p50, 6) AS residual
FROM predictions WHERE actual IS NOT NULL AND p50 IS NOT NULL""")
def a18_pairs(b: Bridge) -> DataFrame:
    r = M.residual_pairs(b.predictions)
    return r.select("row_id", "target_day", *[r6(c).alias(c) for c in ("actual", "p50", "residual")])
