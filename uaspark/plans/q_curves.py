"""Curves: ROAS progression, level reach, install cohorts, churn by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.quantiles import exact_percentiles
from .bridge import reduce_events, COHORT_DAYS, LEVELS, Bridge, dec
from .bridge_sql import with_views
from .catalog import query, r6


def roas_curve(wide: DataFrame, prefix: str = "roas_d") -> DataFrame:
    """Mean ROAS per day (long form via unpivot), first day with mean >= 1.0
    (break-even) and the peak day - every summary over the per-day curve, a
    table of one row per day."""
    import re
    cols = [c for c in wide.columns if re.match("^" + prefix + r"\d+$", c)]
    long = wide.unpivot([], cols, "col", "v").select(
        F.regexp_extract("col", r"(\d+)$", 1).cast("int").alias("day"), "v")
    curve = long.groupBy("day").agg(F.avg("v").alias("mean_roas"))
    summary = curve.agg(F.min(F.when(F.col("mean_roas") >= 1.0, F.col("day"))).alias("break_even_day"),
                        F.max_by("day", "mean_roas").alias("peak_day"),
                        F.max("mean_roas").alias("peak_mean_roas"))
    return curve.crossJoin(summary)


@query("A12_roas_progression", with_views("cohort_wide") + """
, long AS (SELECT CAST(regexp_extract(col, '(\\d+)$', 1) AS INTEGER) AS day, v
           FROM cohort_wide UNPIVOT (v FOR col IN (""" + ", ".join(f"roas_d{d}" for d in COHORT_DAYS) + """))),
curve AS (SELECT day, AVG(v) AS mean_roas FROM long GROUP BY day)
SELECT day, round(mean_roas, 6) AS mean_roas,
  (SELECT MIN(day) FROM curve WHERE mean_roas >= 1.0) AS break_even_day,
  (SELECT arg_max(day, mean_roas) FROM curve) AS peak_day,
  (SELECT round(MAX(mean_roas), 6) FROM curve) AS peak_mean_roas
FROM curve""")
def a12(b: Bridge) -> DataFrame:
    c = roas_curve(b.cohort_wide)
    return c.select("day", r6("mean_roas").alias("mean_roas"), "break_even_day", "peak_day",
                    r6("peak_mean_roas").alias("peak_mean_roas"))


def user_levels(b: Bridge) -> DataFrame:
    """Per-user level cells: ``level_L`` = views when the user reached L, else null."""
    u = b._user_days.groupBy("user_id").agg(F.sum("views").alias("views"))
    return u.select("user_id", *[F.when(F.col("views") >= lv, F.col("views")).alias(f"level_{lv}")
                                 for lv in LEVELS])


def level_reach(df: DataFrame, levels: list[int], zero_is_reached: bool = True) -> DataFrame:
    """Reach % per level = non-null share; per-row deepest reached level;
    median and p95 of that depth (exact, skew-safe).  With
    ``zero_is_reached=False`` a 0 cell does not count as reached (A.18)."""
    def reached(lv):
        c = F.col(f"level_{lv}")
        return c.isNotNull() if zero_is_reached else (c.isNotNull() & (c != 0))
    n = F.count(F.lit(1))
    reach = df.agg(*[(F.count(F.when(reached(lv), 1)) * 100.0 / n).alias(f"level_{lv}") for lv in levels])
    long = reach.unpivot([], [f"level_{lv}" for lv in levels], "col", "reach_pct").select(
        F.regexp_extract("col", r"(\d+)$", 1).cast("int").alias("level"), "reach_pct")
    depth = df.select(F.array_max(F.array(*[F.when(reached(lv), F.lit(lv)) for lv in levels])).alias("max_level"))
    q = exact_percentiles(depth, [], "max_level", [0.5, 0.95], ["median_max_level", "p95_max_level"])
    return long.crossJoin(q)


_LV = ", ".join(f"level_{lv}" for lv in LEVELS)


@query("A13_level_reach", with_views("user_days") + """
, u AS (SELECT user_id, """ + ", ".join(f"CASE WHEN views >= {lv} THEN views END AS level_{lv}" for lv in LEVELS) + """
        FROM (SELECT user_id, SUM(views) AS views FROM user_days GROUP BY user_id)),
reach AS (SELECT """ + ", ".join(f"COUNT(level_{lv}) * 100.0 / COUNT(*) AS level_{lv}" for lv in LEVELS) + """ FROM u),
long AS (SELECT CAST(regexp_extract(col, '(\\d+)$', 1) AS INTEGER) AS level, reach_pct
         FROM reach UNPIVOT (reach_pct FOR col IN (""" + _LV + """))),
depth AS (SELECT greatest(""" + ", ".join(f"CASE WHEN level_{lv} IS NOT NULL THEN {lv} END" for lv in LEVELS) + """) AS max_level FROM u)
SELECT level, round(reach_pct, 6) AS reach_pct,
  (SELECT round(quantile_cont(max_level, 0.5), 6) FROM depth) AS median_max_level,
  (SELECT round(quantile_cont(max_level, 0.95), 6) FROM depth) AS p95_max_level
FROM long""")
def a13(b: Bridge) -> DataFrame:
    r = level_reach(user_levels(b), LEVELS)
    return r.select("level", r6("reach_pct").alias("reach_pct"), r6("median_max_level").alias("median_max_level"),
                    r6("p95_max_level").alias("p95_max_level"))


def install_cohorts(events: DataFrame, max_age: int = 30) -> DataFrame:
    """Per install day and age, retention = active users / cohort size and
    cumulative ARPU = purchases up to that age / cohort size.

    Events are reduced to (user, day) first; the cohort day is a minimum over a
    user's days, and the cohort size is the number of users of age 0.  The running
    ARPU window is partitioned by cohort day and holds at most ``max_age + 1``
    rows per partition."""
    first = F.min("d").over(Window.partitionBy("user_id"))
    days = reduce_events(events).select("user_id", "d", "purchase", first.alias("cohort_date"))
    ua = days.select("cohort_date", F.datediff("d", "cohort_date").alias("age"), "purchase").where(F.col("age") <= max_age)
    ca = ua.groupBy("cohort_date", "age").agg(F.count(F.lit(1)).alias("active_users"),
                                              F.sum("purchase").alias("purchase"))
    w = Window.partitionBy("cohort_date").orderBy("age").rowsBetween(Window.unboundedPreceding, 0)
    size = F.max(F.when(F.col("age") == 0, F.col("active_users"))).over(Window.partitionBy("cohort_date"))
    j = ca.withColumn("cohort_size", size)
    cum = F.coalesce(F.sum("purchase").over(w), F.lit(0).cast("decimal(28,2)"))
    return j.select("cohort_date", "age", "cohort_size", "active_users",
                    (F.col("active_users") / F.col("cohort_size")).alias("retention"),
                    (cum.cast("double") / F.col("cohort_size")).alias("cum_arpu"))


@query("R1_install_cohorts", """
WITH ev AS (SELECT user_id, CAST(ts AS DATE) AS d, event_type, value FROM events),
inst AS (SELECT user_id, MIN(d) AS cohort_date FROM ev GROUP BY user_id),
ua AS (SELECT e.user_id, i.cohort_date, date_diff('day', i.cohort_date, e.d) AS age,
              SUM(CASE WHEN e.event_type = 'purchase' THEN CAST(e.value AS DECIMAL(18,2)) END) AS purchase
       FROM ev e JOIN inst i ON e.user_id = i.user_id
       WHERE date_diff('day', i.cohort_date, e.d) <= 30 GROUP BY ALL),
size AS (SELECT cohort_date, COUNT(*) AS cohort_size FROM inst GROUP BY cohort_date),
ca AS (SELECT cohort_date, age, COUNT(*) AS active_users, SUM(purchase) AS purchase FROM ua GROUP BY cohort_date, age)
SELECT ca.cohort_date, age, cohort_size, active_users, round(active_users / cohort_size, 6) AS retention,
  round(CAST(coalesce(SUM(purchase) OVER (PARTITION BY ca.cohort_date ORDER BY age ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS DOUBLE)
        / cohort_size, 6) AS cum_arpu
FROM ca JOIN size ON ca.cohort_date = size.cohort_date""")
def r1(b: Bridge) -> DataFrame:
    c = install_cohorts(b.t("events", ["user_id", "ts", "event_type", "value"]))
    return c.select("cohort_date", "age", "cohort_size", "active_users", r6("retention").alias("retention"),
                    r6("cum_arpu").alias("cum_arpu"))


def level_churn(levels_wide: DataFrame, key: str, levels: list[int]) -> DataFrame:
    """R7 / W2 long form: drop % between consecutive levels with ``lead`` over
    the level order inside each campaign (a window of at most len(levels) rows)."""
    long = levels_wide.unpivot([key], [f"level_{lv}_events" for lv in levels], "col", "players").select(
        key, F.regexp_extract("col", r"level_(\d+)_events", 1).cast("int").alias("level"), "players")
    w = Window.partitionBy(key).orderBy("level")
    nxt = F.lead("players").over(w)
    out = long.select(key, "level", "players", F.lead("level").over(w).alias("next_level"),
                      nxt.alias("next_players"))
    return out.where(F.col("next_level").isNotNull()).select(
        key, "level", "next_level", "players", "next_players",
        F.try_divide((F.col("players") - F.col("next_players")) * 100.0, F.col("players")).alias("drop_pct"))


@query("R7_churn_by_level", with_views("levels_wide") + """
, long AS (SELECT campaign_key, CAST(regexp_extract(col, 'level_(\\d+)_events', 1) AS INTEGER) AS level, players
           FROM levels_wide UNPIVOT (players FOR col IN (""" + ", ".join(f"level_{lv}_events" for lv in LEVELS) + """))),
nx AS (SELECT campaign_key, level, players, lead(level) OVER w AS next_level, lead(players) OVER w AS next_players
       FROM long WINDOW w AS (PARTITION BY campaign_key ORDER BY level))
SELECT campaign_key, level, next_level, players, next_players,
  round((players - next_players) * 100.0 / NULLIF(players, 0), 6) AS drop_pct
FROM nx WHERE next_level IS NOT NULL""")
def r7(b: Bridge) -> DataFrame:
    c = level_churn(b.levels_wide, "campaign_key", LEVELS)
    return c.select("campaign_key", "level", "next_level", "players", "next_players", r6("drop_pct").alias("drop_pct"))
