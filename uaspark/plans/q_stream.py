"""Threshold alerts (R3) as a batch query over the daily campaign view; the
same operator runs on a stream with a watermark (see ``streaming.ingest``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.ingest import daily_alerts
from .bridge import Bridge
from .bridge_sql import with_views
from .catalog import query, r6

MAX_CPI = 100000.0


@query("R3_daily_alerts", with_views("campaign_daily") + f"""
, d AS (SELECT date AS day, platform, installs, cost, floor(installs * (day(date) % 10) / 10.0) AS active FROM campaign_daily),
a AS (SELECT day, platform, SUM(installs) AS installs, SUM(cost) AS cost, SUM(cost) / NULLIF(SUM(installs), 0) AS cpi,
             CAST(SUM(active) AS DOUBLE) / NULLIF(SUM(installs), 0) AS retention_d1 FROM d GROUP BY day, platform)
SELECT day, platform, installs, round(cost, 6) AS cost, round(cpi, 6) AS cpi, round(retention_d1, 6) AS retention_d1,
  CASE WHEN cpi > {MAX_CPI} THEN 'high_cpi' ELSE 'low_retention' END AS alert
FROM a WHERE cpi > {MAX_CPI} OR retention_d1 < 0.2""")
def r3(b: Bridge) -> DataFrame:
    """The share of active users falls with the last digit of the day."""
    active = F.floor(F.col("installs") * (F.dayofmonth("date") % 10) / 10.0)
    d = b.campaign_daily.select(F.col("date").cast("timestamp").alias("ts"), "platform", "installs", "cost",
                                active.alias("active_d1"))
    a = daily_alerts(d, max_cpi=MAX_CPI)
    return a.select("day", "platform", "installs", r6("cost").alias("cost"), r6("cpi").alias("cpi"),
                    r6("retention_d1").alias("retention_d1"), "alert")
