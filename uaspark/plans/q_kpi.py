"""KPI queries: last days (R8), segment value (R6), grades (R5), what-if (R4), KPI gap (R2), display sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kpi as K
from ..operators.features import cost_features, retention_features
from .bridge import COHORT_DAYS, Bridge
from .bridge_sql import with_views
from .catalog import query, r6

HIGH_SPEND = 200.0
TARGET, FROM_DAY, FORECAST_DAY = 1.0, 7, 30
RETENTION_UPLIFTS, ARPU_UPLIFTS = (0.0, 0.02, 0.10), (0.0, 0.10, 5000.0)


def _summary_sql(by: list[str]) -> str:
    cols = ", ".join(by)
    total = (1 << len(by)) - 1
    return with_views("campaign_daily") + f"""
, newest AS (SELECT MAX(date) AS d FROM campaign_daily),
g AS (SELECT {cols}, CAST(GROUPING({cols}) AS INTEGER) AS level, SUM(installs) AS installs, SUM(cost) AS spend, SUM(revenue) AS revenue,
             SUM(ad_revenue) AS ad_revenue
      FROM campaign_daily, newest WHERE date > d - 7 GROUP BY ROLLUP ({cols}))
SELECT {cols}, level, d - 6 AS first_day, d AS last_day, CAST(installs AS BIGINT) AS installs, round(spend, 6) AS spend,
  round(revenue, 6) AS revenue, round(revenue / NULLIF(spend, 0), 6) AS roas, round(ad_revenue / NULLIF(revenue, 0), 6) AS ad_share,
  CASE WHEN revenue / NULLIF(spend, 0) >= 1 THEN CASE WHEN level = {total} THEN 'Profitable' ELSE 'Strong' END
       WHEN revenue / NULLIF(spend, 0) < 1 THEN CASE WHEN level = {total} THEN 'Unprofitable' ELSE 'Weak' END END AS flag
FROM g, newest"""


def _summary(b: Bridge, by: list[str]) -> DataFrame:
    s = K.recent_summary(b.campaign_daily, by)
    return s.select(*by, "level", "first_day", "last_day", "installs", *[r6(c).alias(c) for c in ("spend", "revenue", "roas", "ad_share")], "flag")


@query("R8_last_week", _summary_sql(["country"]))
def r8(b: Bridge) -> DataFrame:
    return _summary(b, ["country"])


@query("R8_last_week_by_platform", _summary_sql(["platform", "country"]))
def r8_platform(b: Bridge) -> DataFrame:
    return _summary(b, ["platform", "country"])


@query("R6_segment_ltv", with_views("player_days") + f"""
, seg AS (SELECT player_id, CASE WHEN p >= {HIGH_SPEND} THEN 'high_spender' WHEN p > 0 THEN 'payer' WHEN a > 0 THEN 'ad_only'
                            ELSE 'no_revenue' END AS segment
          FROM (SELECT player_id, coalesce(SUM(purchase), 0) AS p, coalesce(SUM(ad_value), 0) AS a FROM player_days GROUP BY player_id)),
n AS (SELECT segment, COUNT(*) AS players FROM seg GROUP BY segment),
per AS (SELECT segment, age, COUNT(*) AS active_players, SUM(coalesce(purchase, 0) + coalesce(ad_value, 0)) AS value
        FROM player_days JOIN seg USING (player_id) WHERE age <= 30 GROUP BY segment, age)
SELECT segment, CAST(age AS INTEGER) AS age, players, active_players, round(CAST(SUM(value) OVER w AS DOUBLE), 6) AS value,
  round(CAST(SUM(value) OVER w AS DOUBLE) / players, 6) AS ltv
FROM per JOIN n USING (segment) WINDOW w AS (PARTITION BY segment ORDER BY age)""")
def r6_ltv(b: Bridge) -> DataFrame:
    s = K.segment_ltv(b.player_days, HIGH_SPEND)
    return s.select("segment", "age", "players", "active_players", r6("value").alias("value"), r6("ltv").alias("ltv"))


_LETTERS = ", ".join(f"'{g}'" for g in K.GRADES)


@query("R5_campaign_grades", with_views("predictions") + f"""
SELECT row_id, target_day, round(p50, 6) AS p50, [{_LETTERS}][ntile({len(K.GRADES)}) OVER (PARTITION BY target_day ORDER BY p50 DESC, row_id)] AS grade
FROM predictions WHERE p50 IS NOT NULL
UNION ALL SELECT row_id, target_day, NULL, NULL FROM predictions WHERE p50 IS NULL""")
def r5(b: Bridge) -> DataFrame:
    g = K.campaign_grades(b.predictions.select("row_id", "target_day", "p50"))
    return g.select("row_id", "target_day", r6("p50").alias("p50"), "grade")


def _lifetime_sql(rate, from_day: int = 0) -> str:
    """The area under the retention rates; ``rate(day)`` spells one."""
    steps = [f"(({rate(a)}) + ({rate(z)})) * {(z - a) / 2.0}" for a, z in zip(COHORT_DAYS, COHORT_DAYS[1:]) if a >= from_day]
    return "(" + " + ".join(steps) + ")"


def _rate(day: int) -> str:
    return f"coalesce(retention_rate_d{day}, 0.0)"


_LATE = ", ".join(_rate(d) for d in COHORT_DAYS if d >= FROM_DAY)


@query("R2_kpi_gap", with_views("campaign_cohorts") + f"""
, c AS (SELECT *, {_lifetime_sql(_rate, FROM_DAY)} / NULLIF({_lifetime_sql(_rate)}, 0) AS after FROM campaign_cohorts),
f AS (SELECT *, CAST({TARGET} AS DOUBLE) * cost / NULLIF(CASE WHEN cost > 0 THEN installs END, 0) AS arpu,
             CASE WHEN cost > 0 AND revenue > 0 THEN revenue / CAST({TARGET} AS DOUBLE) END AS spend,
             (CAST({TARGET} AS DOUBLE) * cost - revenue * (1 - after)) / NULLIF(revenue * after, 0) AS x FROM c),
k AS (SELECT *, CASE WHEN cost > 0 AND revenue > 0 AND x >= 0 AND x * greatest({_LATE}, 0.0) <= 1 THEN x END AS factor FROM f)
SELECT row_id, floor((revenue / NULLIF(cost, 0)) * 1e4 + 0.5) / 1e4 AS current_roas, floor((spend) * 1e4 + 0.5) / 1e4 AS needed_spend, floor((spend / NULLIF(cost, 0) * 100 - 100) * 1e4 + 0.5) / 1e4 AS spend_change_pct,
  floor((arpu) * 1e4 + 0.5) / 1e4 AS needed_arpu, floor((arpu - revenue / NULLIF(installs, 0)) * 1e4 + 0.5) / 1e4 AS arpu_change,
  floor((factor) * 1e4 + 0.5) / 1e4 AS retention_factor, floor((factor * {_rate(FROM_DAY)}) * 1e4 + 0.5) / 1e4 AS needed_retention FROM k""")
def r2(b: Bridge) -> DataFrame:
    # many values end in an exact half at any digit: rounded by the same steps in both engines
    g = K.kpi_gap(b.campaign_cohorts, TARGET, FROM_DAY)
    return g.select("row_id", *[(F.floor(F.col(c) * 1e4 + 0.5) / 1e4).alias(c) for c in ("current_roas", "needed_spend", "spend_change_pct", "needed_arpu", "arpu_change",
                                                         "retention_factor", "needed_retention")])


def _grown(day: int) -> str:
    if day < 1:
        return _rate(day)
    return f"CASE WHEN retention_rate_d{day} IS NULL THEN 0.0 ELSE least(1.0, retention_rate_d{day} * (1 + u)) END"


_LAST = COHORT_DAYS[-1]
_BEYOND = f"({_grown(_LAST)}) * {FORECAST_DAY - _LAST}"


@query("R4_what_if", with_views("campaign_cohorts") + f"""
, grid AS (SELECT CAST(u AS DOUBLE) AS u, CAST(a AS DOUBLE) AS a FROM (VALUES {', '.join(f'({u})' for u in RETENTION_UPLIFTS)}) x(u),
           (VALUES {', '.join(f'({a})' for a in ARPU_UPLIFTS)}) y(a)),
s AS (SELECT *, CASE WHEN retention_rate_d1 IS NOT NULL THEN least(1.0, retention_rate_d1 * (1 + u)) END AS r1,
             CASE WHEN retention_rate_d7 IS NOT NULL THEN least(1.0, retention_rate_d7 * (1 + u)) END AS r7,
             {_lifetime_sql(_grown)} AS stay,
             revenue * coalesce({_lifetime_sql(_grown)} / NULLIF({_lifetime_sql(_rate)}, 0), 1.0) + installs * a AS rev
      FROM campaign_cohorts CROSS JOIN grid)
SELECT row_id, u AS retention_uplift, a AS arpu_uplift, round(r7 / (r1 + 1e-8), 6) AS retention_ratio_d7_d1,
  round(rev / (installs + 1e-8), 6) AS arpu,
  round(rev / NULLIF(cost, 0) * coalesce((stay + {_BEYOND}) / NULLIF(stay, 0), 1.0), 6) AS forecast_roas FROM s""")
def r4(b: Bridge) -> DataFrame:
    out = K.what_if(b.campaign_cohorts, RETENTION_UPLIFTS, ARPU_UPLIFTS, lambda d: cost_features(retention_features(d)),
                    lambda d: K.rule_forecast(d, FORECAST_DAY))
    return out.select("row_id", "retention_uplift", "arpu_uplift", *[r6(c).alias(c) for c in ("retention_ratio_d7_d1", "arpu", "forecast_roas")])


@query("T6_display_sample", with_views("predictions") + """
SELECT row_id, target_day, round(actual, 6) AS actual, round(p10, 6) AS p10, round(p50, 6) AS p50, round(p90, 6) AS p90
FROM (SELECT * FROM predictions ORDER BY md5('42|' || row_id || '|' || target_day), row_id, target_day LIMIT 20)""")
def t6(b: Bridge) -> DataFrame:
    s = K.stable_sample(b.predictions, ["row_id", "target_day"], 20)
    return s.select("row_id", "target_day", *[r6(c).alias(c) for c in ("actual", "p10", "p50", "p90")])
