"""KPI operators (R2, R4-R6, R8, T6) on small tables, against plain code."""

import datetime
import hashlib
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from uaspark.operators import kpi

DAILY = "country string, date date, installs long, cost double, revenue double, ad_revenue double"
D = datetime.date


def daily(spark, rows):
    return spark.createDataFrame(rows, DAILY)


# R8 ---------------------------------------------------------------------------

def test_last_days_end_at_the_newest_date(spark):
    rows = [("US", D(2024, 3, 10), 10, 100.0, 130.0, 13.0), ("US", D(2024, 3, 4), 1, 10.0, 10.0, 1.0),
            ("US", D(2024, 3, 3), 99, 999.0, 1.0, 0.0), ("DE", D(2024, 3, 9), 5, 50.0, 20.0, 5.0),
            (None, D(2024, 3, 8), 2, 0.0, 3.0, None)]
    out = {(r.country, r.level): r for r in kpi.recent_summary(daily(spark, rows)).collect()}
    assert set(out) == {("US", 0), ("DE", 0), (None, 0), (None, 1)}
    us, de, nowhere, total = (out[k] for k in (("US", 0), ("DE", 0), (None, 0), (None, 1)))
    assert (us.installs, us.spend, us.revenue, us.flag) == (11, 110.0, 140.0, "Strong")
    assert (de.flag, nowhere.flag, nowhere.roas) == ("Weak", None, None)
    assert (total.installs, total.flag, total.first_day, total.last_day) == (18, "Profitable", D(2024, 3, 4), D(2024, 3, 10))
    assert total.roas == pytest.approx(163 / 160) and us.ad_share == pytest.approx(0.1)


def test_last_days_of_nothing(spark):
    assert kpi.recent_summary(daily(spark, [])).count() == 0


def test_last_days_filter_reaches_the_scan(spark, tmp_path):
    daily(spark, [("US", D(2024, 3, 10), 1, 1.0, 1.0, 0.0)]).write.parquet(str(tmp_path / "d"))
    plan = kpi.recent_summary(spark.read.parquet(str(tmp_path / "d")))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(date), GreaterThan(date,2024-03-03)]" in plan


# R6 ---------------------------------------------------------------------------

def test_segments_follow_the_whole_history(spark):
    d = Decimal
    rows = [(1, 0, None, d("2.00")), (1, 40, d("500.00"), None),                 # a big purchase after the last age
            (2, 0, d("10.00"), None), (2, 3, d("5.00"), d("1.00")),
            (3, 0, None, d("4.00")), (3, 1, None, None), (4, 0, None, None)]
    df = spark.createDataFrame(rows, "player_id long, age int, purchase decimal(18,2), ad_value decimal(18,2)")
    out = {(r.segment, r.age): (r.players, r.active_players, float(r.value), r.ltv) for r in kpi.segment_ltv(df, 100.0).collect()}
    assert out == {("high_spender", 0): (1, 1, 2.0, 2.0), ("payer", 0): (1, 1, 10.0, 10.0), ("payer", 3): (1, 1, 16.0, 16.0),
                   ("ad_only", 0): (1, 1, 4.0, 4.0), ("ad_only", 1): (1, 1, 4.0, 4.0), ("no_revenue", 0): (1, 1, 0.0, 0.0)}
    assert kpi.segment_ltv(df.limit(0), 100.0).count() == 0


def test_segment_value_scans_the_events_once(spark):
    from uaspark.plans.bridge import Bridge
    plan = kpi.segment_ltv(Bridge(spark, "/root/testdata/sf0.001").player_days, 100.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Join" not in plan


# R5 ---------------------------------------------------------------------------

def plain_ntile(n, tiles):
    small, larger = divmod(n, tiles)
    return [i // (small + 1) if i < larger * (small + 1) else larger + (i - larger * (small + 1)) // small for i in range(n)]


@pytest.mark.parametrize("n", [1, 5, 9, 100, 1003])
def test_grades_are_equal_shares_with_ties_by_key(spark, n):
    rng = random.Random(n)
    rows = [(i, day, rng.choice([0.5, 1.0, 1.5, rng.random()])) for i in range(n) for day in (7, 30)] + [(n, 7, None)]
    df = spark.createDataFrame(rows, "row_id long, target_day int, p50 double").repartition(5)
    out = {(r.row_id, r.target_day): r.grade for r in kpi.campaign_grades(df).collect()}
    assert len(out) == len(rows) and out.pop((n, 7)) is None
    for day in (7, 30):
        order = sorted((r for r in rows if r[1] == day and r[2] is not None), key=lambda r: (-r[2], r[0]))
        assert [out[r[0], day] for r in order] == [kpi.GRADES[t] for t in plain_ntile(n, 9)]


def test_ntile_has_no_task_per_group(spark):
    """One group of 20,000 rows: no partition of the layout holds most of it."""
    df = spark.range(20_000).select(F.lit(1).alias("g"), (F.col("id") % 7).alias("v"), "id")
    out = kpi.group_ntile(df.repartition(4), ["g"], ["v", "id"], [], 4)
    assert [r["count"] for r in out.groupBy("tile").count().orderBy("tile").collect()] == [5000] * 4
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.split("Scan ExistingRDD")[0] or "_rows" in plan


# R2, R4 -------------------------------------------------------------------------

RATES = {0: 1.0, 1: 0.5, 3: 0.3, 7: 0.2, 21: 0.1}


def campaigns(spark):
    names = ", ".join(f"retention_rate_d{d} double" for d in RATES)
    rows = [("low", 100.0, 60.0, 10, *RATES.values()), ("high", 100.0, 150.0, 10, *RATES.values()),
            ("far", 100.0, 5.0, 10, *RATES.values()), ("blank", 100.0, 60.0, 10, *[None] * 5),
            ("zero", 0.0, 0.0, 0, *RATES.values()), ("broke", 100.0, 0.0, 10, *RATES.values()), ("none", None, None, None, *[None] * 5)]
    return spark.createDataFrame(rows, f"id string, cost double, revenue double, installs long, {names}")


def area(rates, start=0):
    days = sorted(rates)
    return sum((rates[a] + rates[z]) * (z - a) / 2 for a, z in zip(days, days[1:]) if a >= start)


def test_each_answer_reaches_the_target(spark):
    out = {r.id: r for r in kpi.kpi_gap(campaigns(spark), 1.0, 7).collect()}
    low = out["low"]
    assert low.revenue / low.needed_spend == pytest.approx(1.0) and low.spend_change_pct == pytest.approx(-40.0)
    assert low.needed_arpu * low.installs / low.cost == pytest.approx(1.0) and low.arpu_change == pytest.approx(4.0)
    late = area(RATES, 7) / area(RATES)
    assert low.revenue * (1 - late + late * low.retention_factor) / low.cost == pytest.approx(1.0)
    assert low.needed_retention == pytest.approx(0.2 * low.retention_factor) and 0.2 < low.needed_retention < 1
    assert out["high"].retention_factor is not None and out["high"].retention_factor < 1
    assert out["far"].retention_factor is None and out["far"].needed_retention is None       # a rate would pass 1
    assert out["blank"].retention_factor is None and out["blank"].needed_spend == 60.0
    assert all(out[k].needed_spend is None and out[k].retention_factor is None for k in ("zero", "broke", "none"))
    assert out["broke"].needed_arpu == 10.0 and out["zero"].needed_arpu is None
    early = kpi.kpi_gap(campaigns(spark).where("id = 'high'"), 0.3, 7).first()                # early days alone pay more
    assert early.retention_factor is None


def test_scenarios_equal_a_loop(spark):
    out = {(r.id, r.retention_uplift, r.arpu_uplift): r for r in kpi.scenarios(campaigns(spark), [0.0, 0.5, 9.0], [0.0, 2.0]).collect()}
    assert len(out) == 7 * 6
    for u in (0.0, 0.5, 9.0):
        for a in (0.0, 2.0):
            r = out["low", u, a]
            grown = {d: x if d == 0 else min(1.0, x * (1 + u)) for d, x in RATES.items()}
            assert r.retention_rate_d7 == pytest.approx(grown[7])
            assert r.revenue == pytest.approx(60 * area(grown) / area(RATES) + 10 * a)
            assert out["blank", u, a].revenue == pytest.approx(60 + 10 * a) and out["blank", u, a].retention_rate_d1 is None
            assert out["none", u, a].revenue is None


def test_what_if_scores_every_scenario_anew(spark):
    """A model on recomputed features gives what one call per scenario gives."""
    from uaspark.operators.features import cost_features
    score = lambda d: d.withColumn("s", F.col("arpu") * 2 + F.col("retention_rate_d7"))
    grid = {(r.id, r.retention_uplift, r.arpu_uplift): r.s
            for r in kpi.what_if(campaigns(spark), [0.0, 0.1], [0.0, 1.0], cost_features, score).collect()}
    for u in (0.0, 0.1):
        for a in (0.0, 1.0):
            for r in score(cost_features(kpi.scenarios(campaigns(spark), [u], [a]))).collect():
                assert grid[r.id, u, a] == r.s


def test_rule_forecast(spark):
    r = {x.id: x.forecast_roas for x in kpi.rule_forecast(campaigns(spark), 31).collect()}
    assert r["low"] == pytest.approx(0.6 * (area(RATES) + 0.1 * 10) / area(RATES))
    assert r["blank"] == pytest.approx(0.6) and r["zero"] is None


# T6 ---------------------------------------------------------------------------

@pytest.mark.parametrize("parts", [1, 7])
def test_stable_sample(spark, parts):
    df = spark.range(500).withColumn("day", (F.col("id") % 3)).repartition(parts)
    got = {(r.id, r.day) for r in kpi.stable_sample(df, ["id", "day"], 9).collect()}
    mark = lambda i: hashlib.md5(f"42|{i}|{i % 3}".encode()).hexdigest()
    assert got == {(i, i % 3) for i in sorted(range(500), key=mark)[:9]}
    assert kpi.stable_sample(df.limit(0), ["id"], 9).count() == 0 and kpi.stable_sample(df.limit(4), ["id"], 9).count() == 4
