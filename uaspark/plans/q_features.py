"""Feature queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import date_parts, date_parts_sql
from ..operators import features as X
from ..operators.profile import top_values
from .bridge import COHORT_DAYS, LEVELS, Bridge
from .bridge_sql import with_views
from .catalog import query, r6

KEYS = ["platform", "channel", "country"]


def _rounded(df: DataFrame, keep: list[str], cols: list[str]) -> DataFrame:
    return df.select(*keep, *[r6(c).alias(c) for c in cols])


_X1 = ["d1_retention", "d3_retention", "d7_retention", "d2_retention", "d14_retention", "d21_retention",
       "retention_slope_d1_d3", "retention_ratio_d3_d1", "retention_slope_d1_d7", "retention_ratio_d7_d1"]


@query("X1_retention_features", with_views("cohort_wide") + """
SELECT campaign_key,
  round(retention_rate_d1, 6) AS d1_retention, round(retention_rate_d3, 6) AS d3_retention,
  round(retention_rate_d7, 6) AS d7_retention, round(retention_rate_d2, 6) AS d2_retention,
  round(retention_rate_d14, 6) AS d14_retention, round(retention_rate_d21, 6) AS d21_retention,
  round((retention_rate_d3 - retention_rate_d1) / 2, 6) AS retention_slope_d1_d3,
  round(retention_rate_d3 / (retention_rate_d1 + 1e-8), 6) AS retention_ratio_d3_d1,
  round((retention_rate_d7 - retention_rate_d1) / 6, 6) AS retention_slope_d1_d7,
  round(retention_rate_d7 / (retention_rate_d1 + 1e-8), 6) AS retention_ratio_d7_d1
FROM cohort_wide""")
def x1(b: Bridge) -> DataFrame:
    return _rounded(X.retention_features(b.cohort_wide), ["campaign_key"], _X1)


_X2 = ["roas_slope_d1_d3", "roas_ratio_d3_d1", "roas_slope_d1_d7", "roas_ratio_d7_d1"]


@query("X2_roas_features", with_views("cohort_wide") + """
SELECT campaign_key, round((roas_d3 - roas_d1) / 2, 6) AS roas_slope_d1_d3,
  round(roas_d3 / (roas_d1 + 1e-8), 6) AS roas_ratio_d3_d1,
  round((roas_d7 - roas_d1) / 6, 6) AS roas_slope_d1_d7, round(roas_d7 / (roas_d1 + 1e-8), 6) AS roas_ratio_d7_d1
FROM cohort_wide""")
def x2(b: Bridge) -> DataFrame:
    return _rounded(X.roas_features(b.cohort_wide), ["campaign_key"], _X2)


_RATIOS = [(LEVELS[i], LEVELS[i + 1]) for i in range(len(LEVELS) - 1)]


@query("X3_W2_level_features", with_views("levels_wide") + f"""
SELECT campaign_key, {', '.join(f'round(level_{y}_events / (level_{x}_events + 1e-8), 6) AS progression_ratio_{x}_{y}' for x, y in _RATIOS)},
  {' + '.join(f'coalesce(level_{lv}_events, 0)' for lv in LEVELS)} AS total_level_events
FROM levels_wide""")
def x3(b: Bridge) -> DataFrame:
    f = X.level_features(b.levels_wide)
    return f.select("campaign_key", *[r6(f"progression_ratio_{a}_{b_}").alias(f"progression_ratio_{a}_{b_}")
                                      for a, b_ in _RATIOS], "total_level_events")


_X4 = ["total_spend", "total_revenue", "roi", "profit", "profit_margin", "cpi", "arpu"]


@query("X4_cost_features", with_views("campaign") + """
SELECT row_id, round(cost, 6) AS total_spend, round(revenue, 6) AS total_revenue,
  round(revenue / (cost + 1e-8), 6) AS roi, round(revenue - cost, 6) AS profit,
  round((revenue - cost) / (revenue + 1e-8), 6) AS profit_margin, installs AS total_installs,
  round(cost / (installs + 1e-8), 6) AS cpi, round(revenue / (installs + 1e-8), 6) AS arpu
FROM campaign""")
def x4(b: Bridge) -> DataFrame:
    c = b.campaign.select("row_id", "cost", "revenue", "installs")
    return _rounded(X.cost_features(c), ["row_id", "total_installs"], _X4)


def _g1_sides(b: Bridge):
    c = b.cohort_wide
    ret = c.select("campaign_key", "game", "platform", "channel", "country", "installs",
                   *[f"retention_rate_d{d}" for d in COHORT_DAYS])
    roas = c.select(*KEYS, "installs", *[f"roas_d{d}" for d in COHORT_DAYS])
    lv = b.levels_wide.select(*KEYS, "installs", *[f"level_{x}_events" for x in LEVELS])
    spend = c.select(*KEYS, "cost", "installs")
    return ret, roas, lv, spend


_J = ["d1_retention", "roas_d3", "progression_ratio_4_8", "total_spend", "cpi", "d1_retention_squared",
      "roas_d1_log", "retention_roas_interaction", "cpi_log"]
_J_SQL = with_views("cohort_wide", "levels_wide") + """
, s AS (SELECT platform, channel, country, SUM(cost) AS cost, SUM(installs) AS installs FROM cohort_wide GROUP BY platform, channel, country)
SELECT c.campaign_key, c.installs AS installs_roas, l.installs AS installs_level, s.installs AS installs_cost,
  l.level_8_events, """ + " + ".join(f"coalesce(l.level_{lv}_events, 0)" for lv in LEVELS) + """ AS total_level_events,
  round(c.retention_rate_d1, 6) AS d1_retention, round(c.roas_d3, 6) AS roas_d3,
  round(l.level_8_events / (l.level_4_events + 1e-8), 6) AS progression_ratio_4_8,
  round(s.cost, 6) AS total_spend, round(s.cost / (s.installs + 1e-8), 6) AS cpi,
  round(pow(c.retention_rate_d1, 2), 6) AS d1_retention_squared, round(ln(c.roas_d1 + 1e-8), 6) AS roas_d1_log,
  round(c.retention_rate_d1 * c.roas_d1, 6) AS retention_roas_interaction,
  round(ln(s.cost / (s.installs + 1e-8) + 1e-8), 6) AS cpi_log
FROM cohort_wide c LEFT JOIN levels_wide l ON c.platform = l.platform AND c.channel = l.channel AND c.country = l.country
LEFT JOIN s ON c.platform = s.platform AND c.channel = s.channel AND c.country = s.country"""


@query("J1_J3_X5_campaign_features", _J_SQL)
def j1(b: Bridge) -> DataFrame:
    f = X.campaign_features(*_g1_sides(b), keys=KEYS)
    return f.select("campaign_key", "installs_roas", "installs_level", "installs_cost", "level_8_events",
                    "total_level_events", *[r6(c).alias(c) for c in _J])


@query("X6_one_hot", with_views("campaign") + """
SELECT row_id, 'platform_' || v.platform AS feature, CAST(c.platform = v.platform AS INTEGER) AS value
FROM campaign c CROSS JOIN (SELECT DISTINCT platform FROM campaign) v
UNION ALL
SELECT row_id, 'channel_' || v.channel, CAST(c.channel = v.channel AS INTEGER)
FROM campaign c CROSS JOIN (SELECT DISTINCT channel FROM campaign) v""")
def x6(b: Bridge) -> DataFrame:
    c = b.campaign.select("row_id", "platform", "channel")
    vocab = X.vocabularies(c, ["platform", "channel"])
    for col, values in vocab.items():
        c = X.one_hot(c, col, col, values)
    feats = [f"{col}_{v}" for col, values in vocab.items() for v in values]
    return c.unpivot(["row_id"], feats, "feature", "value")


@query("X6_one_hot_rows", with_views("campaign") + """
SELECT row_id, unnest(['game_' || game, 'platform_' || platform, 'channel_' || channel, 'country_' || country]) AS feature FROM campaign""")
def x6_rows(b: Bridge) -> DataFrame:
    return X.one_hot_rows(b.campaign, "row_id", ["game", "platform", "channel", "country"])


@query("X7_country_one_hot", with_views("campaign") + """
, top AS (SELECT country FROM campaign GROUP BY country ORDER BY COUNT(*) DESC, country LIMIT 10)
SELECT row_id, 'country_' || t.country AS feature, CAST(c.country = t.country AS INTEGER) AS value
FROM campaign c CROSS JOIN top t""")
def x7(b: Bridge) -> DataFrame:
    c = b.campaign.select("row_id", "country")
    vocab = [r[0] for r in top_values(c, "country", 10).collect()]
    oh = X.one_hot(c, "country", "country", vocab)
    return oh.unpivot(["row_id"], [f"country_{v}" for v in vocab], "feature", "value")


@query("X8_g2_basics", with_views("campaign") + """
SELECT row_id, round(cost / CASE WHEN installs = 0 THEN 1 ELSE installs END, 6) AS cpi,
  round(revenue / CASE WHEN cost = 0 THEN 1 ELSE cost END, 6) AS roas FROM campaign""")
def x8(b: Bridge) -> DataFrame:
    c = b.campaign.select("row_id", "cost", "revenue", "installs")
    return _rounded(X.g2_basics(c), ["row_id"], ["cpi", "roas"])


_DAYS = COHORT_DAYS


@query("W1_roas_deltas", with_views("cohort_wide") + "SELECT campaign_key, " + ", ".join(
    f"round(roas_d{b_} - roas_d{a}, 6) AS roas_d{b_}_vs_roas_d{a}" for a, b_ in zip(_DAYS, _DAYS[1:])) +
    " FROM cohort_wide")
def w1(b: Bridge) -> DataFrame:
    f = X.roas_deltas(b.cohort_wide)
    names = [f"roas_d{b_}_vs_roas_d{a}" for a, b_ in zip(_DAYS, _DAYS[1:])]
    return _rounded(f, ["campaign_key"], names)


@query("X9_retention_rate", with_views("cohort_wide") + "SELECT campaign_key, " + ", ".join(
    f"round(retention_rate_d{d} * 100 / 100.0, 6) AS retention_d{d}_rate" for d in _DAYS) + " FROM cohort_wide")
def x9(b: Bridge) -> DataFrame:
    pct = b.cohort_wide.select("campaign_key", *[(F.col(f"retention_rate_d{d}") * 100).alias(f"retention_d{d}")
                                                 for d in _DAYS])
    return _rounded(X.retention_percent_to_rate(pct), ["campaign_key"], [f"retention_d{d}_rate" for d in _DAYS])


@query("X10_date_parts", with_views("campaign_daily") + f"""
SELECT date, {date_parts_sql('date')} FROM (SELECT DISTINCT date FROM campaign_daily)""")
def x10(b: Bridge) -> DataFrame:
    d = b.campaign_daily.select("date").distinct()
    return d.select("date", *date_parts(F.col("date")))


def _pruned(b: Bridge) -> DataFrame:
    c = b.cohort_wide
    feats = c.select("campaign_key", *KEYS,
                     *[(F.col(f"retention_rate_d{d}") * 100).alias(f"retention_d{d}") for d in [1, 3, 7]])
    roas = c.select(*KEYS, "cost", *[f"roas_d{d}" for d in _DAYS])
    keep_roas = [f"roas_d{d}" for d in _DAYS if str(d)[-1] in "0137"]
    f = X.pruned_join(feats, roas, KEYS, keep_roas, "_roas")
    f = X.pruned_join(f, b.levels_wide, KEYS, [f"level_{x}_events" for x in LEVELS], "_level")
    cost = c.select(*KEYS, "cost", (F.col("roas_d21") * F.col("cost")).alias("revenue"))
    return X.pruned_join(f, cost, KEYS, ["cost", "revenue"], "_cost")


_X11 = ["early_retention_d1", "early_retention_d3", "early_retention_d7", "retention_d1_to_d3_ratio",
        "retention_d3_to_d7_ratio", "early_roas_d0", "early_roas_d1", "early_roas_d3", "avg_early_level",
        "max_early_level", "cost_efficiency"]
_LV_SQL = [f"l.level_{x}_events" for x in LEVELS]


@query("J4_X11_pruned_features", with_views("cohort_wide", "levels_wide") + f"""
SELECT c.campaign_key,
  round(c.retention_rate_d1 * 100, 6) AS early_retention_d1, round(c.retention_rate_d3 * 100, 6) AS early_retention_d3,
  round(c.retention_rate_d7 * 100, 6) AS early_retention_d7,
  round(c.retention_rate_d1 * 100 / (c.retention_rate_d3 * 100 + 1e-6), 6) AS retention_d1_to_d3_ratio,
  round(c.retention_rate_d3 * 100 / (c.retention_rate_d7 * 100 + 1e-6), 6) AS retention_d3_to_d7_ratio,
  round(c.roas_d0, 6) AS early_roas_d0, round(c.roas_d1, 6) AS early_roas_d1, round(c.roas_d3, 6) AS early_roas_d3,
  round(({' + '.join(f'coalesce(CAST({x} AS DOUBLE), 0.0)' for x in _LV_SQL)})
        / ({' + '.join(f'CASE WHEN {x} IS NOT NULL THEN 1 ELSE 0 END' for x in _LV_SQL)}), 6) AS avg_early_level,
  round(greatest({', '.join(f'CAST({x} AS DOUBLE)' for x in _LV_SQL)}), 6) AS max_early_level,
  round((c.roas_d21 * c.cost) / (c.cost + 1e-6), 6) AS cost_efficiency
FROM cohort_wide c LEFT JOIN levels_wide l ON c.platform = l.platform AND c.channel = l.channel AND c.country = l.country""")
def j4(b: Bridge) -> DataFrame:
    return _rounded(X.pruned_features(_pruned(b)), ["campaign_key"], _X11)


_DEVICE = "CASE WHEN records % 40 = 0 THEN 'Android' WHEN records % 40 = 10 THEN 'iOS' ELSE source_platform END"


@query("X12_platform_flags", with_views("registry_dataset") + f"""
SELECT id, CAST(p = 'Android' AS INTEGER) AS is_android, CAST(p = 'iOS' AS INTEGER) AS is_ios,
  CAST(coalesce(p ILIKE '%unity%', false) AS INTEGER) AS is_unity_ads,
  CAST(coalesce(p ILIKE '%mistplay%', false) AS INTEGER) AS is_mistplay
FROM (SELECT id, {_DEVICE} AS p FROM registry_dataset)""")
def x12(b: Bridge) -> DataFrame:
    """Platforms of which some name the device, as the flags expect."""
    f = X.platform_flags(b.registry_dataset.select("id", F.expr(_DEVICE).alias("platform")))
    return f.select("id", "is_android", "is_ios", "is_unity_ads", "is_mistplay")


@query("X13_minimal_features", with_views("cohort_wide") + """
SELECT campaign_key, CAST(channel = 'android' AS INTEGER) AS is_android, CAST(channel = 'ios' AS INTEGER) AS is_ios,
  round(retention_rate_d1 * 100, 6) AS early_retention_d1, round(retention_rate_d3 * 100, 6) AS early_retention_d3
FROM cohort_wide""")
def x13(b: Bridge) -> DataFrame:
    device = F.when(F.col("channel") == "android", "Android").when(F.col("channel") == "ios", "iOS")
    c = b.cohort_wide.select("campaign_key", device.alias("platform"),
                             *[(F.col(f"retention_rate_d{d}") * 100).alias(f"retention_d{d}") for d in [1, 3]])
    f = X.minimal_features(c)
    return f.select("campaign_key", "is_android", "is_ios", r6("early_retention_d1").alias("early_retention_d1"),
                    r6("early_retention_d3").alias("early_retention_d3"))
