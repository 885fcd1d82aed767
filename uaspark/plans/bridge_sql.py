"""The bridge views of ``bridge.py`` spelled as DuckDB SQL (oracle side).

``with_views("campaign", "predictions")`` returns a ``WITH`` clause that
defines the named views and everything they depend on, in order.
"""

from __future__ import annotations

from ..functions.naming import canonical_name_sql, model_name_sql
from .bridge import (CAMPAIGN_KEYS, COHORT_DAYS, COST_WINDOW_DAYS, D7_SHARE, KIND_WORDS, LEVELS,
                     NETWORKS, QUESTION_WORDS, TARGET_DAYS)


def _dec(e: str) -> str:
    return f"CAST({e} AS DECIMAL(18,2))"


def _key_dims(k: str) -> str:
    nets = " ".join(f"WHEN {k} % 4 = {i} THEN '{n}'" for i, n in enumerate(NETWORKS))
    return (f"'events_game' AS game, CASE {nets} END AS platform, "
            f"CASE WHEN {k} % 2 = 0 THEN 'android' ELSE 'ios' END AS channel, "
            f"CASE WHEN {k} < {CAMPAIGN_KEYS // 2} THEN 'tier_1' ELSE 'tier_2' END AS country")


def stable_id_sql(*cols: str) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws('|', {', '.join(cols)})), 1, 15)) AS BIGINT)"


def split_bucket_sql(e: str) -> str:
    return f"CAST(CAST(('0x' || substr(md5(CAST({e} AS VARCHAR)), 1, 8)) AS BIGINT) % 5 AS INTEGER)"


_MONEY = (f"COUNT(DISTINCT o_custkey) AS installs, CAST(SUM(_cost) AS DOUBLE) AS cost, "
          f"CAST(SUM(_rev) AS DOUBLE) AS revenue, CAST(SUM(_adrev) AS DOUBLE) AS ad_revenue")

VIEWS: dict[str, tuple[list[str], str]] = {}

VIEWS["order_lines"] = ([], f"""
SELECT p.p_type AS game, c.c_mktsegment AS platform, o.o_orderstatus AS channel, n.n_name AS country,
       CAST(o.o_orderdate AS DATE) AS date, o.o_custkey,
       2 * {_dec('l.l_quantity')} * {_dec('p.p_retailprice')} AS _cost,
       {_dec('l.l_extendedprice')} * (1 - {_dec('l.l_discount')}) AS _rev,
       {_dec('l.l_extendedprice')} * {_dec('l.l_tax')} AS _adrev
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN part p ON l.l_partkey = p.p_partkey""")

VIEWS["campaign_daily"] = (["order_lines"], f"""
SELECT game, platform, channel, country, date, {_MONEY}
FROM order_lines GROUP BY game, platform, channel, country, date""")

VIEWS["campaign"] = (["order_lines"], f"""
SELECT {stable_id_sql('game', 'platform', 'channel', 'country')} AS row_id,
       game, platform, channel, country, {_MONEY},
       MIN(date) AS first_date, MAX(date) AS last_date,
       CAST(SUM(_rev) AS DOUBLE) / NULLIF(CAST(SUM(_cost) AS DOUBLE), 0) AS roas
FROM order_lines GROUP BY game, platform, channel, country""")

VIEWS["user_days"] = ([], f"""
SELECT e.user_id, date_diff('day', i.install_date, e.d) AS age,
       SUM(CASE WHEN e.event_type = 'purchase' THEN {_dec('e.value')} END) AS purchase,
       SUM(CASE WHEN e.event_type = 'click' THEN {_dec('e.value')} END) AS click,
       COUNT(CASE WHEN e.event_type = 'view' THEN 1 END) AS views
FROM (SELECT user_id, CAST(ts AS DATE) AS d, event_type, value FROM events) e
JOIN (SELECT user_id, MIN(CAST(ts AS DATE)) AS install_date FROM events GROUP BY user_id) i
  ON e.user_id = i.user_id
GROUP BY e.user_id, date_diff('day', i.install_date, e.d)""")

_r = ", ".join(f"MAX(CAST(age = {n} AS INTEGER)) AS _r{n}" for n in COHORT_DAYS)
_p = ", ".join(f"SUM(CASE WHEN age <= {n} THEN purchase END) AS _p{n}" for n in COHORT_DAYS)
_rs = ", ".join(f"SUM(_r{n}) AS _r{n}" for n in COHORT_DAYS)
_ps = ", ".join(f"SUM(_p{n}) AS _p{n}" for n in COHORT_DAYS)
_ret = ", ".join(f"CAST(_r{n} AS DOUBLE) / installs AS retention_rate_d{n}" for n in COHORT_DAYS)
_roas = ", ".join(f"coalesce(CAST(_p{n} AS DOUBLE), 0.0) / NULLIF(CAST(_c AS DOUBLE), 0) AS roas_d{n}"
                  for n in COHORT_DAYS)
VIEWS["cohort_wide"] = (["user_days"], f"""
SELECT campaign_key, {_key_dims('campaign_key')}, installs, CAST(_c AS DOUBLE) AS cost, {_ret}, {_roas}
FROM (SELECT user_id % {CAMPAIGN_KEYS} AS campaign_key, COUNT(*) AS installs, {_rs}, {_ps}, SUM(_c) AS _c
      FROM (SELECT user_id, {_r}, {_p}, SUM(CASE WHEN age <= {COST_WINDOW_DAYS} THEN click END) AS _c
            FROM user_days GROUP BY user_id) pu
      GROUP BY user_id % {CAMPAIGN_KEYS}) pk""")

_lv = ", ".join(f"COUNT(CASE WHEN views >= {lv} THEN 1 END) AS level_{lv}_events" for lv in LEVELS)
_lvn = ", ".join(f"level_{lv}_events" for lv in LEVELS)
VIEWS["levels_wide"] = (["user_days"], f"""
SELECT campaign_key, {_key_dims('campaign_key')}, installs, {_lvn}
FROM (SELECT user_id % {CAMPAIGN_KEYS} AS campaign_key, COUNT(*) AS installs, {_lv}
      FROM (SELECT user_id, SUM(views) AS views FROM user_days GROUP BY user_id) pu
      GROUP BY user_id % {CAMPAIGN_KEYS}) pk""")

VIEWS["segment_cohorts"] = (["user_days"], f"""
SELECT platform, country, installs AS cohort_players, {_ret}, {_roas}, {_lvn}
FROM (SELECT c_mktsegment AS platform, n_name AS country, COUNT(*) AS installs, {_rs}, {_ps}, SUM(_c) AS _c, {_lv}
      FROM (SELECT user_id, {_r}, {_p}, SUM(CASE WHEN age <= {COST_WINDOW_DAYS} THEN click END) AS _c, SUM(views) AS views
            FROM user_days GROUP BY user_id) pu
      JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey
      GROUP BY c_mktsegment, n_name) ps""")

VIEWS["campaign_cohorts"] = (["campaign", "segment_cohorts"], """
SELECT * FROM campaign LEFT JOIN segment_cohorts USING (platform, country)""")

VIEWS["player_days"] = ([], f"""
SELECT player_id, date_diff('day', MIN(d) OVER (PARTITION BY player_id), d) AS age, purchase, ad_value
FROM (SELECT user_id * 24 + hour(ts) AS player_id, CAST(ts AS DATE) AS d,
             SUM(CASE WHEN event_type = 'purchase' THEN {_dec('value')} END) AS purchase,
             SUM(CASE WHEN event_type = 'click' THEN {_dec('value')} END) AS ad_value
      FROM events GROUP BY ALL)""")

VIEWS["raw_strings"] = ([], """
SELECT l_orderkey, l_linenumber,
  CASE l_linenumber
    WHEN 1 THEN '$' || format('{:,.2f}', l_extendedprice)
    WHEN 2 THEN replace(printf('%.2f', l_quantity + l_discount), '.', ',')
    WHEN 3 THEN '$-'
    WHEN 4 THEN '-$' || format('{:,.2f}', l_extendedprice)
    WHEN 5 THEN format('{:,}', CAST(floor(l_extendedprice) AS BIGINT))
    WHEN 6 THEN ''
    ELSE CASE WHEN l_orderkey % 2 = 1 THEN CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) || 'E3'
         ELSE 'n/a' END END AS money_raw,
  CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR) || '%' AS percent_raw,
  CASE l_linenumber % 3
    WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d') || CASE WHEN l_orderkey % 2 = 1 THEN ' 00:00:00' ELSE '' END
    WHEN 1 THEN CASE WHEN l_orderkey % 2 = 1 THEN strftime(l_shipdate, '%-m/%-d/%Y') ELSE strftime(l_shipdate, '%m/%d/%Y') END
    ELSE strftime(l_shipdate, '%Y') || '-13-45' END AS date_raw,
  CASE WHEN l_linenumber % 4 = 0 THEN 'n/a' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS installs_raw
FROM lineitem""")

_days = ", ".join(f"({d})" for d in TARGET_DAYS)
VIEWS["actuals"] = (["campaign"], f"""
SELECT c.row_id, t.target_day, c.game, c.platform, c.channel, c.country, c.cost, c.revenue, c.installs,
       CASE WHEN t.target_day = 7 THEN c.roas * {D7_SHARE} ELSE c.roas END AS actual,
       {split_bucket_sql('c.row_id')} AS split_bucket
FROM campaign c CROSS JOIN (VALUES {_days}) t(target_day)""")

VIEWS["predictions"] = (["actuals"], """
SELECT *, p90 - p10 AS width FROM (
SELECT a.*, q.p50 * lv * (1.0 - sp) AS p10, q.p50 * lv AS p50, q.p50 * lv * (1.0 + sp) AS p90
FROM (SELECT *, CASE WHEN row_id % 101 = 0 THEN 40::DOUBLE ELSE (row_id % 17 + 1) * 0.25::DOUBLE END AS lv,
      CASE WHEN row_id % 3 = 0 THEN 0.02::DOUBLE ELSE (row_id % 11 + 1) / 12::DOUBLE END AS sp FROM actuals) a LEFT JOIN (
  SELECT platform, channel, target_day, quantile_cont(actual, 0.1) AS p10,
         quantile_cont(actual, 0.5) AS p50, quantile_cont(actual, 0.9) AS p90
  FROM actuals WHERE split_bucket <> 0 GROUP BY platform, channel, target_day) q
ON a.platform = q.platform AND a.channel = q.channel AND a.target_day = q.target_day)""")

_kinds = "CASE " + " ".join(f"WHEN s_suppkey % 6 = {i} THEN '{w}'" for i, w in enumerate(KIND_WORDS)) + " END"
_nets6 = " ".join(f"WHEN s_suppkey % 6 = {i} THEN '{n}'" for i, n in
                  enumerate(["unity_ads", "mistplay", "facebook", "google", "tiktok", "unknown"]))
VIEWS["registry_dataset_base"] = ([], f"""
SELECT 'ds-' || CAST(s_suppkey AS VARCHAR) AS id,
       {_kinds} || ' ' || CAST(s_suppkey AS VARCHAR) || '.csv' AS raw_filename,
       CASE {_nets6} END AS source_platform,
       CASE s_suppkey % 3 WHEN 0 THEN 'android' WHEN 1 THEN 'ios' ELSE 'web' END AS channel,
       'Game ' || CAST(s_suppkey % 7 AS VARCHAR) AS game,
       n_name AS country,
       s_suppkey * 10 AS records,
       CAST('2024-01-01 00:00:00' AS TIMESTAMP) + to_hours(s_suppkey) AS ingest_started_at,
       CASE WHEN s_suppkey % 10 = 0 THEN NULL
            ELSE CAST('2024-01-01 00:00:00' AS TIMESTAMP) + to_hours(s_suppkey) + to_minutes(5) END
         AS ingest_completed_at,
       CAST('2024-01-01' AS DATE) + CAST(s_suppkey % 30 AS INTEGER) AS data_start_date,
       CAST('2024-01-01' AS DATE) + CAST(s_suppkey % 30 AS INTEGER) + 30 AS data_end_date
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")

VIEWS["registry_dataset"] = (["registry_dataset_base"], f"""
SELECT *, {canonical_name_sql('game', 'source_platform', 'channel', '[country]', 'data_start_date', 'data_end_date')}
         AS canonical_name
FROM registry_dataset_base""")

VIEWS["registry_model_version"] = ([], f"""
SELECT 'mv-' || CAST(n_nationkey AS VARCHAR) AS id,
       {model_name_sql('[7, 14, 30, 90][n_regionkey % 4 + 1]', "'multi'")} AS model_name,
       CAST([7, 14, 30, 90][n_regionkey % 4 + 1] AS INTEGER) AS target_day,
       CAST(n_nationkey % 3 + 1 AS INTEGER) AS version_hint,
       CAST('2024-02-01 00:00:00' AS TIMESTAMP) + to_days(n_nationkey) AS created_at,
       'ds-' || CAST(n_nationkey * 4 % 100 + 1 AS VARCHAR) AS train_dataset_id
FROM nation""")

VIEWS["registry_prediction_run"] = ([], """
SELECT 'run-' || CAST(o_orderkey AS VARCHAR) AS id,
       'mv-' || CAST(o_custkey % 25 AS VARCHAR) AS model_version_id,
       'ds-' || CAST(o_orderkey % 100 + 1 AS VARCHAR) AS dataset_id,
       o_orderdate AS requested_at,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate + to_minutes(2) END AS completed_at,
       o_orderkey % 500 AS n_rows
FROM orders""")

VIEWS["questions"] = ([], "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'")

_words = ", ".join(f"'{w}'" for w in QUESTION_WORDS)
VIEWS["keyed_questions"] = (["questions"], f"""
SELECT conv_id, turn, text || ' ' || [{_words}][CAST((conv_id + turn) % {len(QUESTION_WORDS)} + 1 AS INTEGER)] AS text FROM questions""")

VIEWS["usage_events"] = ([], """
SELECT conv_id, turn, role AS kind,
       CASE WHEN conv_id % 2 = 0 THEN 'gpt-5-mini' ELSE 'gpt-4o' END AS model,
       CAST(strlen(text) // 4 AS BIGINT) AS input_tokens,
       CAST(strlen(text) // 10 AS BIGINT) AS output_tokens
FROM conversations""")


def with_views(*names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in order) + "\n"
