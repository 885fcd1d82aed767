"""Question routing, question extraction, feature labels and usage cost."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers as A
from ..operators import metrics as M
from ..operators.ordered import running_total
from ..operators.profile import best_by_mean
from .bridge import COHORT_DAYS, LEVELS, Bridge
from .bridge_sql import with_views
from .catalog import query, r6
from .q_curves import roas_curve

# Price per token (USD) by model family.
RATES = {"gpt-5-mini": (Decimal("0.00000025"), Decimal("0.000002"))}
DEFAULT_RATE = (Decimal("0.0000005"), Decimal("0.000003"))


@query("X24_question_intent", with_views("keyed_questions") + f"""
SELECT conv_id, turn, {T.question_intent_sql('text')} AS intent FROM keyed_questions""")
def x24(b: Bridge) -> DataFrame:
    q = b.keyed_questions
    return q.select("conv_id", "turn", T.question_intent(F.col("text")).alias("intent"))


def _strip_ws_sql(e: str) -> str:
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


_STARTS = " OR ".join(f"starts_with(lower(l), '{w}')" for w in T.QUESTION_STARTS)
_PSTARTS = " OR ".join(f"starts_with(lower(p), '{w}')" for w in T.PARAGRAPH_STARTS)
_LINE_QS = (
    "list_filter(list_transform(list_filter("
    "list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '^[ \\-\\t]+|[ \\-\\t]+$', '', 'g')), "
    f"lambda l: l <> '' AND ({_STARTS} OR suffix(l, '?'))), "
    "lambda l: " + _strip_ws_sql("regexp_replace(regexp_replace(l, '^q\\s*[:\\-.]\\s*', '', 'i'), "
                                 "'^question\\s*[:\\-.]\\s*', '', 'i')") + "), "
    f"lambda l: length(l) > {T.MIN_QUESTION_CHARS})")
_PARA_QS = (
    "list_filter(list_transform(list_filter(list_transform(string_split(text, chr(10) || chr(10)), "
    "lambda p: " + _strip_ws_sql("p") + "), "
    f"lambda p: p <> '' AND (contains(p, '?') OR {_PSTARTS})), "
    "lambda p: " + _strip_ws_sql("string_split(p, '.')[1]") + "), "
    f"lambda s: length(s) > {T.MIN_QUESTION_CHARS})")


@query("X25_question_lines", with_views("questions") + f"""
, t AS (SELECT conv_id, turn, CASE WHEN len({_LINE_QS}) > 0 THEN {_LINE_QS} ELSE {_PARA_QS} END AS qs FROM questions)
SELECT conv_id, turn, generate_subscripts(qs, 1) - 1 AS idx, unnest(qs) AS question FROM t""")
def x25(b: Bridge) -> DataFrame:
    q = b.questions.select("conv_id", "turn", T.extract_questions(F.col("text")).alias("qs"))
    return q.select("conv_id", "turn", F.posexplode("qs").alias("idx", "question")).select(
        "conv_id", "turn", F.col("idx").cast("long").alias("idx"), "question")


_DAYS = ", ".join(f"roas_d{d}" for d in COHORT_DAYS)
_X26_SQL = with_views("keyed_questions", "campaign", "cohort_wide", "predictions") + f"""
, curve AS (SELECT CAST(regexp_extract(col, '(\\d+)$', 1) AS INTEGER) AS day, AVG(v) AS value
            FROM cohort_wide UNPIVOT (v FOR col IN ({_DAYS})) GROUP BY 1),
roi AS (SELECT MIN(CASE WHEN value >= 1.0 THEN day END) AS first, MAX(value) AS most, arg_max(day, (value, -day)) AS most_day,
               string_agg('roas_d' || day || ': ' || printf('%.3f', value), ', ' ORDER BY day) AS shown FROM curve),
h AS (SELECT * FROM predictions WHERE target_day = 30),
t AS (SELECT * FROM h WHERE split_bucket = 0 AND actual > 0 AND p50 IS NOT NULL),
m AS (SELECT CASE WHEN var_pop(actual) * COUNT(*) <> 0 THEN 1.0 - SUM((actual - p50) * (actual - p50)) / (var_pop(actual) * COUNT(*)) ELSE 0.0 END AS r2,
             AVG(abs(actual - p50) / abs(actual)) AS mape, sqrt(AVG((actual - p50) * (actual - p50))) AS rmse,
             AVG(abs(actual - p50)) AS mae, AVG(CAST(actual >= p10 AND actual <= p90 AS DOUBLE)) AS cov FROM t),
best AS (SELECT platform FROM campaign GROUP BY platform ORDER BY avg(roas) DESC, platform LIMIT 1),
e AS (SELECT AVG(p50) AS mean, quantile_cont(p50, 0.1) AS p10, quantile_cont(p50, 0.5) AS p50, quantile_cont(p50, 0.9) AS p90 FROM h),
conf AS (SELECT * FROM h WHERE width <= (SELECT quantile_cont(width, 0.2) FROM h)),
top AS (SELECT p50, p50 - 0.5 AS gain, ROW_NUMBER() OVER (ORDER BY p50 - 0.5 DESC, row_id) AS place FROM conf),
n AS (SELECT platform, COUNT(*) AS n FROM campaign GROUP BY platform),
answers AS (
  SELECT 'roi_timeline' AS route, CASE WHEN first IS NOT NULL THEN '{A.ROI_REACHED}roas_d' || first || '{A.ROI_REACHED_TAIL}' || shown
    ELSE '{A.ROI_MISSED}' || printf('%.3f', most) || ' at roas_d' || most_day || '{A.ROI_MISSED_TAIL}' || shown END AS answer FROM roi
  UNION ALL SELECT 'metrics', 'Model performance for D30: R²: ' || printf('%.3f', r2) || ', MAPE: ' || printf('%.3f', mape) || ', RMSE: '
    || printf('%.3f', rmse) || ', MAE: ' || printf('%.3f', mae) || ', CI coverage: ' || printf('%.3f', cov) FROM m
  UNION ALL SELECT 'best_platform', 'Best platform is ' || platform FROM best
  UNION ALL SELECT 'drivers', '{A.NO_DRIVERS}'
  UNION ALL SELECT 'expectation', printf('Expected D30 ROAS — mean: %.3f, p50: %.3f, range ~ p10 %.3f to p90 %.3f.', mean, p50, p10, p90) FROM e
  UNION ALL SELECT 'actions', string_agg('- ' || printf('Predicted ROAS %.3f vs target %.3f (improvement: %.3f)', p50, 0.5, gain)
    || ' (pred ROAS ' || printf('%.3f', p50) || ')', chr(10) ORDER BY place) FROM top WHERE place <= 5
  UNION ALL SELECT 'coverage', 'Data records by platform: ' || string_agg(platform || ': ' || n, ', ' ORDER BY n DESC, platform) FROM n)
SELECT q.conv_id, q.turn, q.route, coalesce(a.answer, '{A.UNSUPPORTED}') AS answer
FROM (SELECT conv_id, turn, {T.question_route_sql('text')} AS route FROM keyed_questions) q LEFT JOIN answers a USING (route)"""


@query("X26_question_routes", _X26_SQL)
def x26(b: Bridge) -> DataFrame:
    horizon = b.predictions.where(F.col("target_day") == 30)
    curve = roas_curve(b.cohort_wide).select("day", F.col("mean_roas").alias("value"))
    top = M.recommend(horizon, 0.5, 5, 0.8).withColumn(
        "place", F.row_number().over(Window.orderBy(F.desc("roas_improvement"), "row_id")))  # five rows
    answers = [A.roi_answer(curve),
               A.metrics_answer(M.forecast_metrics(horizon.where(F.col("split_bucket") == 0)), 30),
               A.best_answer(best_by_mean(b.campaign, "platform", "roas").select("platform")),
               A.drivers_answer(b.spark, []), A.expectation_answer(M.quantile_summary(horizon), 30),
               A.actions_answer(top, "recommendation_reason", "p50", "place"), A.coverage_answer(b.campaign)]
    q = b.keyed_questions.select("conv_id", "turn", T.question_route(F.col("text")).alias("route"))
    return A.answer_questions(q, answers).select("conv_id", "turn", "route", "answer")


_ASKS = ["when is ROI 100%", "should we continue the campaign", "Projected ROAS", "cpi for profitability", "retention rate at D7",
         "ready to scale", "cut immediately", "roi", "campaigns"]
_MODEL = "CASE WHEN k % 5 IN (0, 1) THEN 'm' || turn ELSE '' END"
_DATASET = "CASE WHEN k % 5 IN (0, 2) THEN 'd' || conv_id ELSE '' END"
_ROUTE, _ANSWER = A.fallback_answer_sql("question", "model", "dataset", "has_predictions OR starts_with(lower(mode), 'adaptive ai recommendations')")


@query("X26_fallback_answers", with_views("questions") + f"""
, q AS (SELECT conv_id, turn, text || ' ' || [{', '.join(f"'{a}'" for a in _ASKS)}][CAST((conv_id + turn) % {len(_ASKS)} + 1 AS INTEGER)] AS question,
               conv_id // {len(_ASKS)} AS k FROM questions),
c AS (SELECT *, {_MODEL} AS model, {_DATASET} AS dataset, k % 5 = 3 AS has_predictions,
             CASE WHEN k % 7 = 4 THEN 'Adaptive AI recommendations (beta)' ELSE 'quantile' END AS mode FROM q),
r AS (SELECT *, {_ROUTE} AS route FROM c)
SELECT conv_id, turn, route, {_ANSWER} AS answer FROM r""")
def x26_fallback(b: Bridge) -> DataFrame:
    """Every route in every context: questions end in a phrase picked by key, contexts rotate."""
    asks = F.array(*[F.lit(a) for a in _ASKS])
    pick = F.element_at(asks, ((F.col("conv_id") + F.col("turn")) % len(_ASKS) + 1).cast("int"))
    k = F.floor(F.col("conv_id") / len(_ASKS))
    q = b.questions.select(
        "conv_id", "turn", F.concat("text", F.lit(" "), pick).alias("question"),
        F.when((k % 5).isin(0, 1), F.concat(F.lit("m"), F.col("turn").cast("string"))).alias("model"),
        F.when((k % 5).isin(0, 2), F.concat(F.lit("d"), F.col("conv_id").cast("string"))).alias("dataset"), (k % 5 == 3).alias("has_predictions"),
        F.when(k % 7 == 4, "Adaptive AI recommendations (beta)").otherwise("quantile").alias("mode"))
    return A.fallback_answers(q, "question", "model", "dataset", "has_predictions", "mode").select("conv_id", "turn", "route", "answer")


@query("X28_reply_parsing", with_views("questions") + """
SELECT conv_id, turn, CAST(turn AS INTEGER) AS row_index, 'scale' AS action, 'r' || conv_id AS rationale,
       CAST(10.5 AS DOUBLE) AS budget_change_pct FROM questions WHERE conv_id % 4 <> 3
UNION ALL SELECT conv_id, turn, CAST(turn + 1 AS INTEGER), 'cut', '', NULL FROM questions WHERE conv_id % 4 <> 3""")
def x28(b: Bridge) -> DataFrame:
    return A.parse_replies(b.replies, "reply", ["conv_id", "turn"])


_AMOUNT = "coalesce(TRY_CAST(trim(replace(replace({0}, '$', ''), ',', '')) AS DOUBLE), 0.0)"


@query("X27_campaign_compact", with_views("raw_strings") + f"""
SELECT l_orderkey, l_linenumber, cost, revenue, installs, CASE WHEN installs > 0
  THEN CAST(round(CAST(CAST(cost / installs AS VARCHAR) AS DECIMAL(38, 15)), 2) AS DOUBLE) ELSE 0.0 END AS cpi
FROM (SELECT l_orderkey, l_linenumber, {_AMOUNT.format('money_raw')} AS cost, {_AMOUNT.format('percent_raw')} AS revenue,
             coalesce(TRY_CAST(installs_raw AS DOUBLE), 0.0) AS installs FROM raw_strings)""")
def x27(b: Bridge) -> DataFrame:
    return A.compact_campaigns(b.raw_strings, ["l_orderkey", "l_linenumber"], "money_raw", "percent_raw", "installs_raw")


_CORR = ["installs", "cost", *[f"retention_rate_d{d}" for d in COHORT_DAYS], *[f"roas_d{d}" for d in COHORT_DAYS],
         *[f"level_{n}_events" for n in LEVELS]]
_PAIRS = [(a, c) for i, a in enumerate(_CORR) for c in _CORR[i + 1:]]


@query("X29_feature_labels", with_views("cohort_wide", "levels_wide") + """
, one AS (SELECT """ + ", ".join(f"corr(coalesce({a}, 0), coalesce({c}, 0)) AS \"{a}|{c}\"" for a, c in _PAIRS) + """
          FROM (SELECT c.*, """ + ", ".join(f"l.level_{n}_events" for n in LEVELS) + """
                FROM cohort_wide c JOIN levels_wide l USING (campaign_key))),
long AS (SELECT pair, abs(v) AS a FROM one UNPIVOT (v FOR pair IN (""" + ", ".join(f'"{a}|{c}"' for a, c in _PAIRS) + """))),
rk AS (SELECT feature FROM (SELECT split_part(pair, '|', 1) AS feature, a FROM long
                            UNION ALL SELECT split_part(pair, '|', 2), a FROM long)
       GROUP BY feature ORDER BY round(SUM(CASE WHEN a IS NULL OR isnan(a) THEN 0.0 ELSE a END) + 1.0, 9) DESC, feature LIMIT 20)
SELECT feature, """ + T.feature_label_sql("feature") + """ AS label FROM rk""")
def x29(b: Bridge) -> DataFrame:
    levels = b.levels_wide.select("campaign_key", *[f"level_{n}_events" for n in LEVELS])
    ranked = M.correlation_ranking(b.cohort_wide.join(levels, "campaign_key"), _CORR, 20)
    return ranked.select("feature", T.feature_label(F.col("feature")).alias("label"))


def usage_cost(events: DataFrame) -> Column:
    """Tokens x per-token rate of the model family, rounded to 6 places
    (exact decimal arithmetic)."""
    inp = F.col("input_tokens").cast("decimal(20,0)")
    out = F.col("output_tokens").cast("decimal(20,0)")
    expr = None
    for fam, (ri, ro) in RATES.items():
        c = F.col("model").contains(fam)
        v = inp * F.lit(ri) + out * F.lit(ro)
        expr = F.when(c, v) if expr is None else expr.when(c, v)
    return F.round(expr.otherwise(inp * F.lit(DEFAULT_RATE[0]) + out * F.lit(DEFAULT_RATE[1])), 6)


def _cost_sql() -> str:
    (ri, ro), = RATES.values()
    d = lambda v: f"CAST({v} AS DECIMAL(18,8))"
    i, o = "CAST(input_tokens AS DECIMAL(20,0))", "CAST(output_tokens AS DECIMAL(20,0))"
    return (f"round(CAST(CASE WHEN contains(model, 'gpt-5-mini') THEN {i} * {d(ri)} + {o} * {d(ro)} "
            f"ELSE {i} * {d(DEFAULT_RATE[0])} + {o} * {d(DEFAULT_RATE[1])} END AS DECIMAL(38,8)), 6)")


@query("A22_usage_cost", with_views("usage_events") + f"""
SELECT kind, model, COUNT(*) AS events, SUM(input_tokens) AS input_tokens, SUM(output_tokens) AS output_tokens,
  CAST(SUM({_cost_sql()}) AS DOUBLE) AS cost
FROM usage_events GROUP BY kind, model""")
def a22(b: Bridge) -> DataFrame:
    u = b.usage_events.select("*", usage_cost(b.usage_events).alias("cost"))
    return u.groupBy("kind", "model").agg(F.count(F.lit(1)).alias("events"),
                                          F.sum("input_tokens").alias("input_tokens"),
                                          F.sum("output_tokens").alias("output_tokens"),
                                          F.sum("cost").cast("double").alias("cost"))


@query("A22_running_totals", with_views("usage_events") + f"""
SELECT conv_id, turn, kind, CAST({_cost_sql()} AS DOUBLE) AS cost,
  CAST(SUM({_cost_sql()}) OVER (PARTITION BY kind ORDER BY conv_id, turn
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running_cost
FROM usage_events""")
def a22_running(b: Bridge) -> DataFrame:
    u = b.usage_events.select("conv_id", "turn", "kind", usage_cost(b.usage_events).alias("cost"))
    r = running_total(u, ["kind"], ["conv_id", "turn"], "cost", "running_cost")
    return r.select("conv_id", "turn", "kind", F.col("cost").cast("double").alias("cost"),
                    F.col("running_cost").cast("double").alias("running_cost"))
