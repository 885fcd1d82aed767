"""Bridge views, profiling, validation, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators.sets import union_kinds
from .bridge import COHORT_DAYS, HIERARCHY, LEVELS, Bridge
from .bridge_sql import with_views
from .catalog import query, r6

MONEY = ["cost", "revenue", "ad_revenue"]


def _daily_kinds(b: Bridge) -> dict[str, DataFrame]:
    return {"adspend_revenue": b.campaign_daily, "retention": b.cohort_wide.drop(
        *[c for c in b.cohort_wide.columns if c.startswith("roas_d")]),
        "roas": b.cohort_wide.drop(*[c for c in b.cohort_wide.columns if c.startswith("retention_rate")]),
        "level_progression": b.levels_wide}


@query("B1_campaign_daily", with_views("campaign_daily") + """
SELECT game, platform, channel, country, date, installs,
       round(cost, 6) AS cost, round(revenue, 6) AS revenue, round(ad_revenue, 6) AS ad_revenue
FROM campaign_daily""")
def b1_campaign_daily(b: Bridge) -> DataFrame:
    d = b.campaign_daily
    return d.select(*HIERARCHY, "date", "installs", *[r6(c).alias(c) for c in MONEY])


@query("B1_campaign", with_views("campaign") + """
SELECT row_id, game, platform, channel, country, installs, round(cost, 6) AS cost,
       round(revenue, 6) AS revenue, round(ad_revenue, 6) AS ad_revenue, first_date, last_date,
       round(roas, 6) AS roas
FROM campaign""")
def b1_campaign(b: Bridge) -> DataFrame:
    c = b.campaign
    return c.select("row_id", *HIERARCHY, "installs", *[r6(m).alias(m) for m in MONEY],
                    "first_date", "last_date", r6("roas").alias("roas"))


@query("B2_cohort_wide", with_views("cohort_wide") + "SELECT * FROM cohort_wide")
def b2_cohort_wide(b: Bridge) -> DataFrame:
    return b.cohort_wide


@query("B3_levels_wide", with_views("levels_wide") + "SELECT * FROM levels_wide")
def b3_levels_wide(b: Bridge) -> DataFrame:
    return b.levels_wide


@query("A7_best_platform", with_views("campaign") + """
SELECT platform, round(avg(roas), 6) AS mean_roas FROM campaign
GROUP BY platform ORDER BY avg(roas) DESC, platform LIMIT 1""")
def a7_best_platform(b: Bridge) -> DataFrame:
    return P.best_by_mean(b.campaign, "platform", "roas").select(
        "platform", r6("mean_roas").alias("mean_roas"))


_A1_COLS = ["game", "platform", "channel", "country", "date", "installs", "cost", "revenue", "ad_revenue"]


@query("A1_table_profile", with_views("campaign_daily") + f"""
SELECT column_name, null_count, row_count, n_platforms, n_columns FROM (
  SELECT COUNT(*) AS row_count, COUNT(DISTINCT platform) AS n_platforms, {len(_A1_COLS)} AS n_columns,
         {', '.join(f'COUNT(*) - COUNT({c}) AS "{c}"' for c in _A1_COLS)}
  FROM campaign_daily)
UNPIVOT (null_count FOR column_name IN ({', '.join(f'"{c}"' for c in _A1_COLS)}))""")
def a1_table_profile(b: Bridge) -> DataFrame:
    return P.table_profile(b.campaign_daily.select(*_A1_COLS))


@query("A2_validation_report", with_views("campaign_daily", "cohort_wide", "levels_wide") + """
SELECT 'adspend_revenue' AS data_type, 'missing_required_column:spend' AS issue, CAST(1 AS BIGINT) AS n
UNION ALL
SELECT data_type, 'missing_' || col || '_values', n FROM (
  SELECT data_type, col, CAST(n AS BIGINT) AS n FROM (
    SELECT 'adspend_revenue' AS data_type, COUNT(*) - COUNT(game) AS game, COUNT(*) - COUNT(platform) AS platform,
           COUNT(*) - COUNT(channel) AS channel, COUNT(*) - COUNT(country) AS country FROM campaign_daily
    UNION ALL SELECT 'retention', COUNT(*) - COUNT(game), COUNT(*) - COUNT(platform),
           COUNT(*) - COUNT(channel), COUNT(*) - COUNT(country) FROM cohort_wide
    UNION ALL SELECT 'roas', COUNT(*) - COUNT(game), COUNT(*) - COUNT(platform),
           COUNT(*) - COUNT(channel), COUNT(*) - COUNT(country) FROM cohort_wide
    UNION ALL SELECT 'level_progression', COUNT(*) - COUNT(game), COUNT(*) - COUNT(platform),
           COUNT(*) - COUNT(channel), COUNT(*) - COUNT(country) FROM levels_wide)
  UNPIVOT (n FOR col IN (game, platform, channel, country))) WHERE n > 0""")
def a2_validation_report(b: Bridge) -> DataFrame:
    return P.validation_report(_daily_kinds(b))


@query("A2_validation_gaps", with_views("campaign", "cohort_wide", "levels_wide") + """
SELECT * FROM (VALUES ('adspend_revenue', 'missing_hierarchy:country', CAST(1 AS BIGINT)), ('adspend_revenue', 'missing_required_column:spend', 1),
  ('adspend_revenue', 'missing_required_column:revenue', 1), ('retention', 'no_retention_rate_columns', 1), ('roas', 'no_roas_columns', 1),
  ('level_progression', 'missing_hierarchy:game', 1), ('level_progression', 'no_level_columns', 1)) t(data_type, issue, n)
UNION ALL SELECT 'adspend_revenue', 'missing_platform_values', COUNT(*) FROM campaign WHERE row_id % 3 = 0 HAVING COUNT(*) > 0
UNION ALL SELECT 'adspend_revenue', 'missing_channel_values', COUNT(*) FROM campaign WHERE row_id % 7 = 0 HAVING COUNT(*) > 0
UNION ALL SELECT 'retention', 'missing_country_values', COUNT(*) FROM cohort_wide WHERE campaign_key % 2 = 1 HAVING COUNT(*) > 0
UNION ALL SELECT 'roas', 'missing_game_values', COUNT(*) FROM cohort_wide WHERE cost > 0 HAVING COUNT(*) > 0""")
def a2_validation_gaps(b: Bridge) -> DataFrame:
    """Tables without columns they need and with gaps in those they have: every issue occurs."""
    unless = lambda cond, c: F.when(~cond, F.col(c)).alias(c)
    spend = b.campaign.select("game", unless(F.col("row_id") % 3 == 0, "platform"), unless(F.col("row_id") % 7 == 0, "channel"), "cost")
    wide = b.cohort_wide
    return P.validation_report({
        "adspend_revenue": spend,
        "retention": wide.select("game", "platform", "channel", unless(F.col("campaign_key") % 2 == 1, "country"), "installs", "roas_d0"),
        "roas": wide.select(unless(F.col("cost") > 0, "game"), "platform", "channel", "country", "installs", "retention_rate_d1"),
        "level_progression": b.levels_wide.select("platform", "channel", "country", "installs")})


@query("A3_records_by_platform_kind", with_views("campaign_daily", "cohort_wide", "levels_wide") + """
SELECT platform, data_type, COUNT(*) AS records FROM (
  SELECT platform, 'adspend_revenue' AS data_type FROM campaign_daily
  UNION ALL SELECT platform, 'retention' FROM cohort_wide
  UNION ALL SELECT platform, 'roas' FROM cohort_wide
  UNION ALL SELECT platform, 'level_progression' FROM levels_wide)
GROUP BY platform, data_type""")
def a3_records(b: Bridge) -> DataFrame:
    return P.records_by_platform_kind(_daily_kinds(b))


_A4_COLS = ["id", "source_platform", "country", "ingest_completed_at"]


@query("A4_data_quality", with_views("registry_dataset") + f"""
SELECT COUNT(*) AS n_rows, {len(_A4_COLS)} AS n_columns,
       round(100.0 * ({' + '.join(f'(COUNT(*) - COUNT({c}))' for c in _A4_COLS)})
             / (COUNT(*) * {len(_A4_COLS)}), 6) AS missing_pct
FROM (SELECT * REPLACE (CASE WHEN records % 70 <> 0 THEN country END AS country) FROM registry_dataset)""")
def a4_data_quality(b: Bridge) -> DataFrame:
    """Two of the columns have gaps."""
    d = b.registry_dataset.withColumn("country", F.when(F.col("records") % 70 != 0, F.col("country")))
    out = P.data_quality(d.select(*_A4_COLS))
    return out.select("n_rows", "n_columns", r6("missing_pct").alias("missing_pct"))


@query("A5_overview", with_views("campaign_daily", "cohort_wide", "levels_wide") + f"""
SELECT 4 AS non_empty_kinds,
       (SELECT COUNT(*) FROM campaign_daily) + 2 * (SELECT COUNT(*) FROM cohort_wide)
         + (SELECT COUNT(*) FROM levels_wide) AS total_rows,
       (SELECT COUNT(DISTINCT platform) FROM (SELECT platform FROM campaign_daily UNION ALL
          SELECT platform FROM cohort_wide UNION ALL SELECT platform FROM levels_wide)) AS n_platforms,
       7 AS level_columns""")
def a5_overview(b: Bridge) -> DataFrame:
    return P.overview(_daily_kinds(b))


@query("A6_date_range", with_views("campaign_daily") + """
SELECT MIN(date) AS start_date, MAX(date) AS end_date FROM campaign_daily WHERE date IS NOT NULL""")
def a6_date_range(b: Bridge) -> DataFrame:
    return P.date_range(b.campaign_daily, "date")


@query("A14_top_countries", with_views("campaign_daily") + """
SELECT country, COUNT(*) AS n FROM campaign_daily GROUP BY country ORDER BY n DESC, country LIMIT 10""")
def a14_top_countries(b: Bridge) -> DataFrame:
    return P.top_values(b.campaign_daily, "country", 10)


@query("A20_payload_summary", with_views("predictions") + """
SELECT COUNT(*) AS num_rows, TRUE AS has_roas_cols, TRUE AS has_cost, TRUE AS has_revenue,
       round(CAST(SUM(CAST(coalesce(cost, 0.0) AS DECIMAL(38,4))) AS DOUBLE), 6) AS total_cost, round(AVG(p50), 6) AS mean_roas_p50
FROM predictions""")
def a20_payload_summary(b: Bridge) -> DataFrame:
    pred = b.predictions.withColumnRenamed("p50", "predicted_roas_p50")
    out = P.payload_summary(pred, exact_money=True)
    return out.select("num_rows", "has_roas_cols", "has_cost", "has_revenue",
                      r6("total_cost").alias("total_cost"), r6("mean_roas_p50").alias("mean_roas_p50"))


@query("A21_sample_stats", with_views("campaign_daily") + """
SELECT round(AVG(cost), 6) AS mean_cost, round(AVG(revenue), 6) AS mean_revenue,
       round(AVG(installs), 6) AS mean_installs FROM campaign_daily""")
def a21_sample_stats(b: Bridge) -> DataFrame:
    return P.sample_stats(b.campaign_daily).select(*[r6(c).alias(c) for c in
                                                     ["mean_cost", "mean_revenue", "mean_installs"]])


_A21 = [(family, i, f"{start}{x}{end}") for family, start, values, end in (
    ("roas_columns", "roas_d", COHORT_DAYS, ""), ("retention_columns", "retention_rate_d", COHORT_DAYS, ""),
    ("level_columns", "level_", LEVELS, "_events")) for i, x in enumerate(values)]


@query("A21_metric_columns", f"""
SELECT family, CAST(position AS INTEGER) AS position, column_name FROM (VALUES {', '.join(map(repr, _A21))}) t(family, position, column_name)""")
def a21_metric_columns(b: Bridge) -> DataFrame:
    return P.metric_columns(b.campaign_cohorts)


@query("A24_target_profile", with_views("campaign") + """
SELECT round(AVG(roas), 6) AS mean, round(STDDEV_SAMP(roas), 6) AS std, round(MIN(roas), 6) AS min,
       round(MAX(roas), 6) AS max, COUNT(*) - COUNT(roas) AS n_null,
       coalesce(STDDEV_SAMP(roas), 0) = 0 AS zero_variance FROM campaign""")
def a24_target_profile(b: Bridge) -> DataFrame:
    out = P.target_profile(b.campaign, "roas")
    return out.select(*[r6(c).alias(c) for c in ["mean", "std", "min", "max"]], "n_null", "zero_variance")


@query("F1_scope_filter", with_views("campaign_daily") + """
SELECT game, platform, channel, country, date, installs, round(cost, 6) AS cost
FROM campaign_daily WHERE platform = 'BUILDING' AND channel = 'F'""")
def f1_scope_filter(b: Bridge) -> DataFrame:
    d = P.scope_filter(b.campaign_daily, {"platform": "BUILDING", "channel": "F", "game": "All",
                                         "country": "All"})
    return d.select(*HIERARCHY, "date", "installs", r6("cost").alias("cost"))


@query("F6_filter_options", with_views("campaign_daily") + """
SELECT DISTINCT 'game' AS dimension, game AS value FROM campaign_daily WHERE game IS NOT NULL
UNION SELECT DISTINCT 'platform', platform FROM campaign_daily WHERE platform IS NOT NULL
UNION SELECT DISTINCT 'channel', channel FROM campaign_daily WHERE channel IS NOT NULL
UNION SELECT DISTINCT 'country', country FROM campaign_daily WHERE country IS NOT NULL""")
def f6_filter_options(b: Bridge) -> DataFrame:
    return P.filter_options(b.campaign_days, HIERARCHY)


@query("T4_sorted_distinct", with_views("campaign_daily") + """
SELECT DISTINCT country FROM campaign_daily WHERE country IS NOT NULL ORDER BY country""")
def t4_sorted_distinct(b: Bridge) -> DataFrame:
    return b.campaign_daily.select("country").where(F.col("country").isNotNull()).distinct().orderBy("country")


@query("U1_union_kinds", with_views("campaign_daily", "cohort_wide", "levels_wide") + """
SELECT data_type, platform, channel, COUNT(*) AS n_rows, SUM(installs) AS installs,
       round(SUM(cost), 6) AS cost, COUNT(retention_rate_d1) AS n_retention, COUNT(level_4_events) AS n_level
FROM (
  SELECT 'adspend_revenue' AS data_type, platform, channel, installs, cost,
         NULL::DOUBLE AS retention_rate_d1, NULL::BIGINT AS level_4_events FROM campaign_daily
  UNION ALL SELECT 'retention', platform, channel, installs, cost, retention_rate_d1, NULL FROM cohort_wide
  UNION ALL SELECT 'roas', platform, channel, installs, cost, NULL, NULL FROM cohort_wide
  UNION ALL SELECT 'level_progression', platform, channel, installs, NULL, NULL, level_4_events FROM levels_wide)
GROUP BY data_type, platform, channel""")
def u1_union_kinds(b: Bridge) -> DataFrame:
    u = union_kinds(_daily_kinds(b))
    return (u.groupBy("data_type", "platform", "channel")
             .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("installs").alias("installs"),
                  r6(F.sum("cost")).alias("cost"), F.count("retention_rate_d1").alias("n_retention"),
                  F.count("level_4_events").alias("n_level")))


@query("S2_classify_files", with_views("registry_dataset") + """
SELECT id, raw_filename,
  CASE WHEN contains(lower(raw_filename), 'adspend') OR contains(lower(raw_filename), 'revenue')
            OR contains(lower(raw_filename), 'cost') THEN 'adspend_revenue'
       WHEN contains(lower(raw_filename), 'retention') THEN 'retention'
       WHEN contains(lower(raw_filename), 'roas') THEN 'roas'
       WHEN contains(lower(raw_filename), 'level') OR contains(lower(raw_filename), 'progression')
            THEN 'level_progression'
       ELSE 'unknown' END AS data_type
FROM registry_dataset""")
def s2_classify_files(b: Bridge) -> DataFrame:
    from ..sources.files import classify_data_type
    d = b.registry_dataset
    return d.select("id", "raw_filename", classify_data_type(F.col("raw_filename")).alias("data_type"))
