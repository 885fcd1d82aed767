"""Cleaning and schema-mapping queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_date, parse_date_sql
from ..functions.money import (parse_currency, parse_currency_or_percent, parse_currency_or_percent_sql,
                               parse_currency_sql, to_number, to_number_sql)
from ..functions.text import classify_channel_sql, classify_platform_sql
from ..operators import clean as C
from .bridge import Bridge
from .bridge_sql import with_views
from .catalog import query, r6

KEYS = ["l_orderkey", "l_linenumber"]


@query("P10_parse_currency", with_views("raw_strings") + f"""
SELECT l_orderkey, l_linenumber, money_raw, round({parse_currency_sql('money_raw')}, 6) AS value
FROM raw_strings""")
def p10(b: Bridge) -> DataFrame:
    r = b.raw_strings
    return r.select(*KEYS, "money_raw", r6(parse_currency(F.col("money_raw"))).alias("value"))


@query("P11_parse_currency_percent", with_views("raw_strings") + f"""
SELECT l_orderkey, l_linenumber, round({parse_currency_or_percent_sql('money_raw')}, 6) AS money,
       round({parse_currency_or_percent_sql('percent_raw')}, 6) AS rate
FROM raw_strings""")
def p11(b: Bridge) -> DataFrame:
    r = b.raw_strings
    return r.select(*KEYS, r6(parse_currency_or_percent(F.col("money_raw"))).alias("money"),
                    r6(parse_currency_or_percent(F.col("percent_raw"))).alias("rate"))


@query("P8_parse_dates", with_views("raw_strings") + f"""
SELECT l_orderkey, l_linenumber, date_raw, {parse_date_sql('date_raw')} AS date FROM raw_strings""")
def p8(b: Bridge) -> DataFrame:
    r = b.raw_strings
    return r.select(*KEYS, "date_raw", parse_date(F.col("date_raw")).alias("date"))


@query("P9_numeric_coercion", with_views("raw_strings") + f"""
SELECT l_orderkey, l_linenumber, {to_number_sql('installs_raw')} AS installs,
       {to_number_sql('money_raw')} AS money FROM raw_strings""")
def p9(b: Bridge) -> DataFrame:
    r = b.raw_strings
    return r.select(*KEYS, to_number(F.col("installs_raw")).alias("installs"),
                    to_number(F.col("money_raw")).alias("money"))


@query("P12_fill_zero", with_views("raw_strings") + f"""
SELECT l_orderkey, l_linenumber, coalesce({to_number_sql('installs_raw')}, 0) AS installs,
       coalesce({to_number_sql('money_raw')}, 0) AS money FROM raw_strings""")
def p12(b: Bridge) -> DataFrame:
    return C.fill_numeric_nulls(p9(b), ["installs", "money"], 0)


@query("P13_hydrate_financials", with_views("raw_strings") + f"""
SELECT l_orderkey, l_linenumber,
       CASE WHEN z.s = 0 THEN money_raw END AS cost_raw,
       round({parse_currency_or_percent_sql("CASE WHEN z.s = 0 THEN money_raw ELSE '$-' END")}, 6) AS cost_num,
       round({parse_currency_or_percent_sql("CASE WHEN z.s = 0 THEN money_raw ELSE '$-' END")}, 6) AS cost,
       CASE WHEN z.i = 0 THEN percent_raw END AS revenue_raw,
       round({parse_currency_or_percent_sql("CASE WHEN z.i = 0 THEN percent_raw ELSE installs_raw END")}, 6) AS revenue_num,
       round({parse_currency_or_percent_sql("CASE WHEN z.i = 0 THEN percent_raw ELSE installs_raw END")}, 6) AS revenue
FROM raw_strings CROSS JOIN (SELECT SUM(coalesce({to_number_sql("'$-'")}, 0.0)) AS s,
                                    SUM(coalesce({to_number_sql('installs_raw')}, 0.0)) AS i FROM raw_strings) z""")
def p13(b: Bridge) -> DataFrame:
    """``cost`` sums to 0, so its variants replace it; ``revenue`` doesn't."""
    r = b.raw_strings.select(*KEYS, F.lit("$-").alias("cost"), F.col("money_raw").alias(" cost "),
                             F.col("percent_raw").alias("Revenue "), F.col("installs_raw").alias("revenue"))
    h = C.hydrate_financials(r)
    return h.select(*KEYS, "cost_raw", r6("cost_num").alias("cost_num"), r6("cost").alias("cost"),
                    "revenue_raw", r6("revenue_num").alias("revenue_num"), r6("revenue").alias("revenue"))


@query("S1_normalize_ingest", with_views("raw_strings") + f"""
SELECT l_orderkey, l_linenumber, {parse_date_sql('date_raw')} AS date,
       coalesce({to_number_sql('installs_raw')}, 0.0) AS installs, round({parse_currency_sql('money_raw')}, 6) AS cost,
       round({parse_currency_or_percent_sql('percent_raw')}, 6) AS retention_d1, 'x' AS cost_2, 0 AS revenue
FROM raw_strings""")
def s1_ingest(b: Bridge) -> DataFrame:
    """Messy headers and cells through the whole ingest projection."""
    r = b.raw_strings.select(*KEYS, F.col("date_raw").alias("Report Date"), F.col("installs_raw").alias(" Install-Count"),
                             F.col("money_raw").alias("Cost"), F.lit("x").alias(" cost "),
                             F.col("percent_raw").alias("Retention_Rate D1"))
    n = C.normalize_ingest(r)
    return n.select(*KEYS, "date", "installs", r6("cost").alias("cost"), r6("retention_d1").alias("retention_d1"),
                    "cost_2", F.col("revenue").cast("int").alias("revenue"))


@query("P14_clean_features", with_views("cohort_wide") + """
SELECT campaign_key, installs,
       round(CASE WHEN isnan(x) OR isinf(x) OR x IS NULL THEN 0.0 ELSE x END, 6) AS log_roas_d0,
       round(CASE WHEN isnan(y) OR isinf(y) OR y IS NULL THEN 0.0 ELSE y END, 6) AS roas_ratio_d7_d0
FROM (SELECT campaign_key, installs, CASE WHEN roas_d0 > 0 THEN ln(roas_d0) END AS x,
             roas_d7 / (roas_d0 + 1e-8) AS y FROM cohort_wide)""")
def p14(b: Bridge) -> DataFrame:
    c = b.cohort_wide
    raw = c.select("campaign_key", "installs", "platform",
                   F.log(F.col("roas_d0")).alias("log_roas_d0"),
                   (F.col("roas_d7") / (F.col("roas_d0") + F.lit(1e-8))).alias("roas_ratio_d7_d0"))
    cl = C.clean_features(raw)
    return cl.select("campaign_key", "installs", r6("log_roas_d0").alias("log_roas_d0"),
                     r6("roas_ratio_d7_d0").alias("roas_ratio_d7_d0"))


_P15_COLS = ["data_type", "platform", "installs", "cost", "retention_rate_d1", "level_4_events"]


@query("P15_empty_columns", with_views("campaign_daily", "cohort_wide", "levels_wide") + """
, u AS (SELECT 'adspend_revenue' AS data_type, platform, installs, cost, NULL::DOUBLE AS retention_rate_d1, NULL::BIGINT AS level_4_events FROM campaign_daily
  UNION ALL SELECT 'retention', platform, installs, cost, retention_rate_d1, NULL FROM cohort_wide
  UNION ALL SELECT 'level_progression', platform, installs, NULL, NULL, level_4_events FROM levels_wide),
n AS (SELECT data_type AS kind, COUNT(data_type) AS data_type, COUNT(platform) AS platform, COUNT(installs) AS installs, COUNT(cost) AS cost,
        COUNT(retention_rate_d1) AS retention_rate_d1, COUNT(level_4_events) AS level_4_events FROM u GROUP BY 1)
SELECT kind, column_name FROM n
UNPIVOT (c FOR column_name IN (data_type, platform, installs, cost, retention_rate_d1, level_4_events)) WHERE c > 0""")
def p15(b: Bridge) -> DataFrame:
    """The columns that each kind keeps after the union of all kinds."""
    from ..operators.sets import union_kinds
    u = union_kinds({"adspend_revenue": b.campaign_daily, "retention": b.cohort_wide,
                     "level_progression": b.levels_wide}).select(*_P15_COLS)
    kept = [(kind, c) for kind in ("adspend_revenue", "retention", "level_progression")
            for c in C.drop_empty(u.where(F.col("data_type") == kind)).columns]
    return b.spark.createDataFrame(kept, "kind string, column_name string")


@query("P6_ensure_hierarchy", with_views("cohort_wide", "levels_wide") + """
SELECT campaign_key, 'Unknown Game' AS game, platform, channel, 'Unknown Country' AS country, 'cohort' AS src
FROM cohort_wide
UNION ALL
SELECT campaign_key, game, platform, channel, country, 'levels' FROM levels_wide""")
def p6(b: Bridge) -> DataFrame:
    a = C.ensure_hierarchy(b.cohort_wide.select("campaign_key", "platform", "channel"))
    lv = b.levels_wide.select("campaign_key", "game", "platform", F.col("channel").alias("subdirectory"),
                              "country")
    c = C.ensure_hierarchy(lv)
    return (a.select("campaign_key", *C.HIERARCHY, F.lit("cohort").alias("src"))
             .unionByName(c.select("campaign_key", *C.HIERARCHY, F.lit("levels").alias("src"))))


@query("P7_standardize_adspend", with_views("campaign_daily") + """
SELECT game, platform, channel, country, date, round(ad_revenue, 6) AS revenue,
       round(cost, 6) AS spend, round(cost, 6) AS cost FROM campaign_daily""")
def p7(b: Bridge) -> DataFrame:
    s = C.standardize_kind(b.campaign_daily, "adspend_revenue", revenue_mode="ad")
    return s.select(*C.HIERARCHY, "date", r6("revenue").alias("revenue"), r6("spend").alias("spend"),
                    r6("cost").alias("cost"))


def _p21_input(b: Bridge) -> DataFrame:
    d = b.registry_dataset
    inverted = F.col("records") % 40 == 0
    return d.select((F.col("records") % 70).alias("file_group"), "game", "id", "raw_filename", "country",
                    F.when(inverted, F.col("channel")).otherwise(F.col("source_platform")).alias("platform"),
                    F.when(inverted, F.col("source_platform")).otherwise(F.col("channel")).alias("channel"))


_P21_SRC = """
SELECT records % 70 AS file_group, game, id, raw_filename, country,
       CASE WHEN records % 40 = 0 THEN channel ELSE source_platform END AS platform,
       CASE WHEN records % 40 = 0 THEN source_platform ELSE channel END AS channel
FROM registry_dataset"""


@query("P21_detect_hierarchy", with_views("registry_dataset") + f"""
, src AS ({_P21_SRC}),
g AS (SELECT file_group, arg_min(platform, id) FILTER (WHERE platform IS NOT NULL) AS pv,
             arg_min(channel, id) FILTER (WHERE channel IS NOT NULL) AS cv,
             arg_min(game, id) FILTER (WHERE game IS NOT NULL) AS gv
      FROM src GROUP BY file_group),
c AS (SELECT file_group, list(country ORDER BY first_id, country) AS ctry FROM (
        SELECT file_group, country, MIN(id) AS first_id FROM src WHERE country IS NOT NULL GROUP BY file_group, country)
      GROUP BY file_group)
SELECT file_group,
  CASE WHEN {classify_channel_sql('pv')} IS NOT NULL AND {classify_platform_sql('cv')} IS NOT NULL
       THEN {classify_platform_sql('cv')} ELSE coalesce({classify_platform_sql('pv')}, 'unknown') END AS platform,
  CASE WHEN {classify_channel_sql('pv')} IS NOT NULL AND {classify_platform_sql('cv')} IS NOT NULL
       THEN {classify_channel_sql('pv')} ELSE {classify_channel_sql('cv')} END AS channel,
  coalesce(gv, 'Unknown Game') AS game,
  array_to_string(list_slice(ctry, 1, 5), ',') AS countries
FROM g LEFT JOIN c USING (file_group)""")
def p21(b: Bridge) -> DataFrame:
    d = C.detect_hierarchy(_p21_input(b), ["file_group"], "id", filename_col="raw_filename")
    return d.select("file_group", "platform", "channel", "game",
                    F.array_join("countries", ",").alias("countries"))
