"""Player and campaign KPIs over campaign tables.

R8 last-days summary, R6 lifetime value by player segment, R5 grades, R2 what is
missing to a target ROAS, R4 what-if grid, T6 sample for display.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage
from .features import day_columns

# The letters, best first, and what a summary calls its rows.
GRADES = ["A+", "A", "A-", "B+", "B", "B-", "C+", "C", "C-"]
PROFITABLE, UNPROFITABLE, STRONG, WEAK = "Profitable", "Unprofitable", "Strong", "Weak"


# ---- R8 -------------------------------------------------------------------

def recent_summary(daily: DataFrame, by: Sequence[str] = ("country",), days: int = 7, bar: float = 1.0,
                   date_col: str = "date") -> DataFrame:
    """Installs, spend, revenue and blended ROAS of the last ``days`` days of the
    data, as a rollup over ``by``.

    The window ends at the newest date in the data.  That date is found first, so the
    second pass filters by a literal, which reaches the scan.  ``level`` is the
    grouping id: 0 for single rows, the largest for the total (its columns are null;
    a null group of the data has a smaller level).  The total is Profitable from ``bar``
    on, a row Strong; both are null without spend.  An empty table gives an empty
    result."""
    newest = daily.agg(F.max(date_col)).first()[0]
    window = daily.where(F.col(date_col) > F.date_sub(F.lit(newest).cast("date"), days))
    sums = window.rollup(*by).agg(
        F.grouping_id().cast("int").alias("level"), F.sum("installs").alias("installs"), F.sum("cost").alias("spend"),
        F.sum("revenue").alias("revenue"), F.sum("ad_revenue").alias("ad_revenue"))
    roas = F.try_divide("revenue", "spend")
    total = F.col("level") == (1 << len(by)) - 1
    good, bad = F.when(total, PROFITABLE).otherwise(STRONG), F.when(total, UNPROFITABLE).otherwise(WEAK)
    return sums.select(*by, "level", F.date_sub(F.lit(newest).cast("date"), days - 1).alias("first_day"),
                       F.lit(newest).cast("date").alias("last_day"), "installs", "spend", "revenue", roas.alias("roas"),
                       F.try_divide("ad_revenue", "revenue").alias("ad_share"),
                       F.when(roas >= bar, good).when(roas < bar, bad).alias("flag"))


# ---- R6 -------------------------------------------------------------------

def player_segment(purchases: Column, ad_value: Column, high_spend: float) -> Column:
    """The segment of a player's whole history."""
    return (F.when(purchases >= high_spend, "high_spender").when(purchases > 0, "payer")
            .when(ad_value > 0, "ad_only").otherwise("no_revenue"))


def segment_ltv(player_days: DataFrame, high_spend: float, max_age: int = 30) -> DataFrame:
    """Cumulative value per player of each segment and age.

    ``player_days`` has one row per player and age: (player_id, age, purchase, ad_value),
    with age 0 for each player.  A player's segment comes from a window over the player's own
    days, however many follow ``max_age``; what then travels is one row per segment and
    age of a task.  The cumulative window holds at most ``max_age`` + 1 rows a segment."""
    own = Window.partitionBy("player_id")
    zero = F.lit(0).cast("decimal(18,2)")
    value = F.coalesce("purchase", zero) + F.coalesce("ad_value", zero)
    tagged = player_days.select(
        player_segment(F.coalesce(F.sum("purchase").over(own), zero), F.coalesce(F.sum("ad_value").over(own), zero), high_spend).alias("segment"),
        "age", value.alias("value"))
    per_age = tagged.where(F.col("age") <= max_age).groupBy("segment", "age").agg(
        F.count(F.lit(1)).alias("active_players"), F.sum("value").alias("value"))
    upto = Window.partitionBy("segment").orderBy("age")
    size = F.max(F.when(F.col("age") == 0, F.col("active_players"))).over(Window.partitionBy("segment"))
    return per_age.select("segment", "age", size.alias("players"), "active_players",
                          F.sum("value").over(upto).alias("value"), (F.sum("value").over(upto).cast("double") / size).alias("ltv"))


# ---- R5 -------------------------------------------------------------------

def group_ntile(df: DataFrame, by: Sequence[str], order: Sequence[str], descending: Sequence[str], tiles: int,
                name: str = "tile") -> DataFrame:
    """``ntile(tiles)`` of each group in the order of ``order`` (those in ``descending``
    from large to small), without a task that holds a group.

    Rows are laid out by range of (group, order), so a large group spans many
    partitions; the rank of a row is its place in the partition plus the rows of its
    group before that partition, a table of one row per group and partition."""
    keys = [F.desc(c) if c in descending else F.asc(c) for c in (*by, *order)]
    laid = cut_lineage(df.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    parts = laid.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    group = Window.partitionBy(*by)
    before = F.sum("_rows").over(group.orderBy("_part")) - F.col("_rows")
    parts = parts.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_part").alias("_in"), "_first",
                         before.alias("_before"), F.sum("_rows").over(group).alias("_all"))
    parts = broadcast_if_small(parts)
    same = reduce(Column.__and__, [laid[c].eqNullSafe(parts[f"_by{i}"]) for i, c in enumerate(by)], laid["_part"] == parts["_in"])
    rank = F.col("_before") + F.col("_at") - F.col("_first")
    # the first (rows mod tiles) tiles have one row more
    small, larger = F.floor(F.col("_all") / tiles), F.col("_all") % tiles
    tile = F.when(rank < larger * (small + 1), F.floor(rank / (small + 1))).otherwise(
        larger + F.floor((rank - larger * (small + 1)) / F.greatest(small, F.lit(1))))
    return laid.join(parts, same).select(*df.columns, (tile + 1).cast("int").alias(name))


def campaign_grades(predictions: DataFrame, by: Sequence[str] = ("target_day",), value: str = "p50",
                    key: str = "row_id") -> DataFrame:
    """Grade A+ to C- of each campaign, equal shares of every horizon by predicted
    ROAS; ties go by ``key``.  Rows without a prediction get no grade."""
    known = group_ntile(predictions.where(F.col(value).isNotNull()), by, [value, key], [value], len(GRADES))
    letters = F.array(*[F.lit(g) for g in GRADES])
    graded = known.select(*predictions.columns, F.element_at(letters, F.col("tile")).alias("grade"))
    rest = predictions.where(F.col(value).isNull()).withColumn("grade", F.lit(None).cast("string"))
    return graded.unionByName(rest)


# ---- retention curves -------------------------------------------------------

def lifetime_days(columns: Sequence[str], prefix: str = "retention_rate_d", from_day: int = 0) -> Column:
    """Days a player stays from ``from_day`` on: the area under the retention columns,
    straight between neighbouring days (day 0 counts as 1 if it has no column).  Null
    retention counts as 0."""
    days = day_columns(columns, prefix)
    points = [(d, F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for d, c in days]
    if not points or points[0][0] > 0:
        points.insert(0, (0, F.lit(1.0)))
    steps = [(r0 + r1) * ((d1 - d0) / 2.0) for (d0, r0), (d1, r1) in zip(points, points[1:]) if d0 >= from_day]
    return reduce(add, steps, F.lit(0.0))


# ---- R2 -------------------------------------------------------------------

def kpi_gap(df: DataFrame, target: float, from_day: int = 7, prefix: str = "retention_rate_d") -> DataFrame:
    """R2: what alone would bring each campaign (cost, revenue, installs, retention
    columns) to the ``target`` ROAS.

    * ``needed_spend`` and its change in percent: revenue / target;
    * ``needed_arpu`` and its change: the revenue per install that pays target * cost;
    * ``retention_factor`` and ``needed_retention``: revenue follows the days that players stay, so
      that of days from ``from_day`` on must grow by (target * cost - revenue before) /
      revenue after; the rates of these days grow by that factor.

    Null where the target can't be reached that way: without revenue, cost or installs, if
    revenue before ``from_day`` alone is over the target, or if a rate would pass 1."""
    cost, revenue, installs = (F.col(c).cast("double") for c in ("cost", "revenue", "installs"))
    able = (cost > 0) & (revenue > 0)
    spend = F.when(able, revenue / target)
    arpu = F.when((cost > 0) & (installs > 0), F.lit(target) * cost / installs)
    after = F.try_divide(lifetime_days(df.columns, prefix, from_day), lifetime_days(df.columns, prefix))
    factor = F.try_divide(F.lit(target) * cost - revenue * (1 - after), revenue * after)
    late = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for d, c in day_columns(df.columns, prefix) if d >= from_day]
    highest = F.greatest(*late, F.lit(0.0)) if late else F.lit(0.0)
    factor = F.when(able & (factor >= 0) & (factor * highest <= 1), factor)
    return df.select("*", F.try_divide(revenue, cost).alias("current_roas"), F.lit(target).alias("target_roas"),
                     spend.alias("needed_spend"), (F.try_divide(spend, cost) * 100 - 100).alias("spend_change_pct"),
                     arpu.alias("needed_arpu"), (arpu - F.try_divide(revenue, installs)).alias("arpu_change"),
                     factor.alias("retention_factor"),
                     (factor * (late[0] if late else F.lit(None).cast("double"))).alias("needed_retention"))


# ---- R4 -------------------------------------------------------------------

def scenarios(df: DataFrame, retention_uplifts: Sequence[float], arpu_uplifts: Sequence[float],
              prefix: str = "retention_rate_d") -> DataFrame:
    """One row per row of ``df`` and pair of uplifts, with the inputs as they would be.

    Retention from day 1 on grows by ``retention_uplift`` (a share), to 1 at most;
    revenue follows the days that players stay and grows by ``arpu_uplift`` per
    install.  The grid is a literal of its size, exploded in place, so rows don't
    move."""
    grid = F.explode(F.array(*[F.struct(F.lit(float(r)).alias("retention_uplift"), F.lit(float(a)).alias("arpu_uplift"))
                               for r in retention_uplifts for a in arpu_uplifts]))
    rates = [c for d, c in day_columns(df.columns, prefix) if d >= 1]
    out = df.withColumns({"_grid": grid, "_stay": lifetime_days(df.columns, prefix)})
    grown = {c: F.when(F.col(c).isNotNull(), F.least(F.lit(1.0), F.col(c).cast("double") * (1 + F.col("_grid.retention_uplift"))))
             for c in rates}
    out = out.withColumns(grown)
    longer = F.coalesce(F.try_divide(lifetime_days(df.columns, prefix), F.col("_stay")), F.lit(1.0))
    revenue = F.col("revenue") * longer + F.col("installs") * F.col("_grid.arpu_uplift")
    return out.withColumn("revenue", revenue).select(*df.columns, "_grid.retention_uplift", "_grid.arpu_uplift")


def what_if(df: DataFrame, retention_uplifts: Sequence[float], arpu_uplifts: Sequence[float],
            features: Callable[[DataFrame], DataFrame], score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``scenarios`` with features computed anew for each and the model applied."""
    return score(features(scenarios(df, retention_uplifts, arpu_uplifts)))


def rule_forecast(df: DataFrame, days: int, prefix: str = "retention_rate_d") -> DataFrame:
    """Forecast without a model: value per day that a player stays, held over ``days`` at the last known
    retention rate, by cost per install.  Adds ``forecast_roas``."""
    known = day_columns(df.columns, prefix)
    last_day, last = known[-1] if known else (0, None)
    stay = lifetime_days(df.columns, prefix)
    beyond = F.coalesce(F.col(last).cast("double"), F.lit(0.0)) * max(0, days - last_day) if last else F.lit(0.0)
    roas = F.try_divide(F.col("revenue"), F.col("cost"))
    return df.withColumn("forecast_roas", roas * F.coalesce(F.try_divide(stay + beyond, stay), F.lit(1.0)))


# ---- T6 -------------------------------------------------------------------

def stable_sample(df: DataFrame, keys: Sequence[str], n: int, seed: str = "42") -> DataFrame:
    """``n`` rows by the least md5 of seed and keys: the same rows on every engine
    and partitioning.  Each task keeps its own ``n``; nothing is sorted as a whole.
    For display only: scoring never samples."""
    mark = F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))
    return df.withColumn("_mark", mark).orderBy("_mark", *keys).limit(n).drop("_mark")
