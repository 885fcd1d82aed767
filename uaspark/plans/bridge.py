"""Campaign-shaped views over the shared test tables (Spark side).

The test tables hold no ad campaigns, so these views give every operator a
real input whose size grows with the tables.  ``bridge_sql`` spells the same
views for DuckDB; the two must stay in step.

B1 campaign_daily / campaign   lineitem x orders x customer x nation x part
B2 cohort_wide                 events, per-user install day and age
B3 levels_wide                 events, view counts per user
B4 raw_strings                 lineitem rendered as messy export text
B5 predictions                 B1 + segment-quantile baseline (M4)
B6 registry_*                  supplier / nation / orders keys
B7 questions, B8 usage_events  conversations
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage
from ..sources.tables import read_table

HIERARCHY = ["game", "platform", "channel", "country"]

# Fixed values of the bridge (shared with bridge_sql).
COHORT_DAYS = [0, 1, 2, 3, 7, 14, 21]
LEVELS = [4, 8, 10, 12, 14, 16, 20]
CAMPAIGN_KEYS = 8
COST_WINDOW_DAYS = 13
QUESTION_WORDS = ["break-even", "r2", "best platform", "driver", "expected roas", "budget", "volume", "retention", "payback",
                  "projection", "compare", "hm"]
NETWORKS = ["unity_ads", "mistplay", "facebook", "google"]
TARGET_DAYS = [7, 30]
KIND_WORDS = ["Adspend and Revenue data", "retention", "ROAS data", "Level Progression", "cost report",
              "summary"]
D7_SHARE = 0.5

#: Order lines that a task joins or groups, about: what it holds in memory doesn't grow with the table.
LINES_PER_TASK = 500_000
#: Up to so many parts it is left to Spark to broadcast them; more are dealt out as the lines are.
FEW_PARTS = 2_000_000


def dec(c: str | Column) -> Column:
    """Exact money arithmetic: the test values carry two decimals."""
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("decimal(18,2)")


def stable_id(*cols: Column) -> Column:
    """60-bit id from md5 of the natural key; same digits as the oracle's hex cast."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 15), 16, 10).cast("long")


def split_bucket(c: Column) -> Column:
    """Engine-independent 0..4 bucket for the 80/20 split (T5)."""
    return (F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long") % 5).cast("int")


def reduce_events(events: DataFrame) -> DataFrame:
    """One row per (user, day): purchase and click value, views."""
    return events.groupBy("user_id", F.to_date("ts").alias("d")).agg(
        F.sum(F.when(F.col("event_type") == "purchase", dec("value"))).alias("purchase"),
        F.sum(F.when(F.col("event_type") == "click", dec("value"))).alias("click"),
        F.count(F.when(F.col("event_type") == "view", 1)).alias("views"))


class Bridge:
    """Lazily-built campaign views over one test-data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def t(self, name: str, cols: list[str]) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name, cols)

    # ---- B1 -------------------------------------------------------------
    @cached_property
    def _line_parts(self) -> int:
        """Partitions of the order lines, by their number; 0 where the cores alone give as many."""
        parts = -(-self.t("lineitem", ["l_orderkey"]).count() // LINES_PER_TASK)
        return parts if parts > self.spark.sparkContext.defaultParallelism else 0

    def _spread(self, df: DataFrame, *keys: str) -> DataFrame:
        """``df`` in as many partitions as the order lines need.  The shuffle that a join or
        group on ``keys`` takes anyway, but in a number that follows the table."""
        return df.repartition(self._line_parts, *keys) if self._line_parts else df

    def _order_lines(self) -> DataFrame:
        # orders x customer x nation first (the order side is ~4x smaller than
        # lineitem); nation is a fixed 25-row dimension, so its broadcast is bounded.
        o = self.t("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"])
        c = self.t("customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
        n = self.t("nation", ["n_nationkey", "n_name"])
        oc = (o.join(c, o.o_custkey == c.c_custkey)
               .join(F.broadcast(n), F.col("c_nationkey") == n.n_nationkey)
               .select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate",
                       "c_mktsegment", "n_name"))
        li = self.t("lineitem", ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice",
                                 "l_discount", "l_tax"])
        p = self.t("part", ["p_partkey", "p_type", "p_retailprice"])
        lines = self._spread(li, "l_orderkey").join(self._spread(oc, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        if self._line_parts and p.count() > FEW_PARTS:
            lines, p = self._spread(lines, "l_partkey"), self._spread(p, "p_partkey")
        return (lines.join(p, F.col("l_partkey") == F.col("p_partkey"))
                  .select(F.col("p_type").alias("game"), F.col("c_mktsegment").alias("platform"),
                          F.col("o_orderstatus").alias("channel"), F.col("n_name").alias("country"),
                          F.to_date("o_orderdate").alias("date"), "o_custkey",
                          (F.lit(2) * dec("l_quantity") * dec("p_retailprice")).alias("_cost"),
                          (dec("l_extendedprice") * (F.lit(1) - dec("l_discount"))).alias("_rev"),
                          (dec("l_extendedprice") * dec("l_tax")).alias("_adrev")))

    @staticmethod
    def _money_aggs() -> list[Column]:
        return [F.count_distinct("o_custkey").alias("installs"),
                F.sum("_cost").cast("double").alias("cost"),
                F.sum("_rev").cast("double").alias("revenue"),
                F.sum("_adrev").cast("double").alias("ad_revenue")]

    @cached_property
    def campaign_daily(self) -> DataFrame:
        return self._by_customer(*HIERARCHY, "date").groupBy(*HIERARCHY, "date").agg(*self._money_aggs())

    @cached_property
    def campaign_days(self) -> DataFrame:
        """The rows of ``campaign_daily`` without its sums: no customer is counted, so the order
        lines needn't be dealt out by customer."""
        return self._order_lines().select(*HIERARCHY, "date").distinct()

    def _by_customer(self, *keys: str) -> DataFrame:
        """The order lines, dealt out for distinct customers of each of ``keys``."""
        return self._spread(self._order_lines(), *keys, "o_custkey")

    @cached_property
    def campaign(self) -> DataFrame:
        agg = self._by_customer(*HIERARCHY).groupBy(*HIERARCHY).agg(
            *self._money_aggs(), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
        # computed once: everything of B1 and B5 reads this small table
        return cut_lineage(agg.select(stable_id(*[F.col(h) for h in HIERARCHY]).alias("row_id"), "*",
                          F.try_divide("revenue", "cost").alias("roas")))

    # ---- B2 / B3 ---------------------------------------------------------
    @cached_property
    def _user_days(self) -> DataFrame:
        """One row per (user, age): install day = first event day of the user.
        Events are reduced to (user, day) before anything else; the install day
        is a minimum over a user's days."""
        days = reduce_events(self.t("events", ["user_id", "ts", "event_type", "value"]))
        first = F.min("d").over(Window.partitionBy("user_id"))
        return days.select("user_id", F.datediff("d", first).alias("age"), "purchase", "click", "views")

    @cached_property
    def _per_key(self) -> DataFrame:
        """Cohort and level sums of every campaign key in one pass, computed once."""
        k = (F.col("user_id") % CAMPAIGN_KEYS)
        return cut_lineage(self._per_user.groupBy(k.alias("campaign_key")).agg(*self._cohort_sums()))

    @cached_property
    def _per_user(self) -> DataFrame:
        return self._user_days.groupBy("user_id").agg(
            *[F.max((F.col("age") == n).cast("int")).alias(f"_r{n}") for n in COHORT_DAYS],
            *[F.sum(F.when(F.col("age") <= n, F.col("purchase"))).alias(f"_p{n}") for n in COHORT_DAYS],
            F.sum(F.when(F.col("age") <= COST_WINDOW_DAYS, F.col("click"))).alias("_c"),
            F.sum("views").alias("views"))

    @staticmethod
    def _cohort_sums() -> list[Column]:
        return [F.count(F.lit(1)).alias("installs"),
                *[F.sum(f"_r{n}").alias(f"_r{n}") for n in COHORT_DAYS],
                *[F.sum(f"_p{n}").alias(f"_p{n}") for n in COHORT_DAYS],
                F.sum("_c").alias("_c"),
                *[F.count(F.when(F.col("views") >= lv, 1)).alias(f"level_{lv}_events") for lv in LEVELS]]

    @staticmethod
    def _cohort_rates() -> list[Column]:
        cost = F.col("_c").cast("double")
        return [*[(F.col(f"_r{n}") / F.col("installs")).alias(f"retention_rate_d{n}") for n in COHORT_DAYS],
                *[F.try_divide(F.coalesce(F.col(f"_p{n}").cast("double"), F.lit(0.0)), cost).alias(f"roas_d{n}")
                  for n in COHORT_DAYS]]

    @cached_property
    def segment_cohorts(self) -> DataFrame:
        """Cohort features of each (platform, country), from the events of its customers."""
        c = self.t("customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
        n = self.t("nation", ["n_nationkey", "n_name"])
        users = (self._per_user.join(c, F.col("user_id") == F.col("c_custkey"))
                 .join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")))
        sums = users.groupBy(F.col("c_mktsegment").alias("platform"), F.col("n_name").alias("country")).agg(*self._cohort_sums())
        return cut_lineage(sums.select("platform", "country", F.col("installs").alias("cohort_players"), *self._cohort_rates(),
                                       *[f"level_{lv}_events" for lv in LEVELS]))

    @cached_property
    def campaign_cohorts(self) -> DataFrame:
        """Campaigns with the cohort features of their segment (one row per platform and
        country, broadcast after a count); null where a segment has no player."""
        return cut_lineage(self.campaign.join(broadcast_if_small(self.segment_cohorts), ["platform", "country"], "left"))

    # ---- players ---------------------------------------------------------
    @cached_property
    def player_days(self) -> DataFrame:
        """(player_id, age, purchase, ad_value): a player is a user at one hour of the day, so
        that players without a purchase, or with no value at all, occur."""
        ev = self.t("events", ["user_id", "ts", "event_type", "value"])
        player = (F.col("user_id") * 24 + F.hour("ts")).alias("player_id")
        days = ev.groupBy(player, F.to_date("ts").alias("d")).agg(
            F.sum(F.when(F.col("event_type") == "purchase", dec("value"))).alias("purchase"),
            F.sum(F.when(F.col("event_type") == "click", dec("value"))).alias("ad_value"))
        first = F.min("d").over(Window.partitionBy("player_id"))
        return days.select("player_id", F.datediff("d", first).alias("age"), "purchase", "ad_value")

    @staticmethod
    def _key_dims(k: Column) -> list[Column]:
        net = F.element_at(F.array(*[F.lit(x) for x in NETWORKS]), (k % 4 + 1).cast("int"))
        return [F.lit("events_game").alias("game"), net.alias("platform"),
                F.when(k % 2 == 0, "android").otherwise("ios").alias("channel"),
                F.when(k < CAMPAIGN_KEYS // 2, "tier_1").otherwise("tier_2").alias("country")]

    @cached_property
    def cohort_wide(self) -> DataFrame:
        kc = F.col("campaign_key")
        return self._per_key.select(
            kc, *self._key_dims(kc), "installs", (F.col("_c").cast("double")).alias("cost"), *self._cohort_rates())

    @cached_property
    def levels_wide(self) -> DataFrame:
        kc = F.col("campaign_key")
        return self._per_key.select(kc, *self._key_dims(kc), "installs",
                                    *[f"level_{lv}_events" for lv in LEVELS])

    # ---- B4 --------------------------------------------------------------
    @cached_property
    def raw_strings(self) -> DataFrame:
        li = self.t("lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity",
                                 "l_discount", "l_shipdate"])
        ln = F.col("l_linenumber")
        price = F.col("l_extendedprice")
        odd = F.col("l_orderkey") % 2 == 1
        money = (F.when(ln == 1, F.concat(F.lit("$"), F.format_number(price, 2)))
                  .when(ln == 2, F.regexp_replace(F.format_string("%.2f", F.col("l_quantity") + F.col("l_discount")), r"\.", ","))
                  .when(ln == 3, F.lit("$-"))
                  .when(ln == 4, F.concat(F.lit("-$"), F.format_number(price, 2)))
                  .when(ln == 5, F.format_number(F.floor(price).cast("long"), 0))
                  .when(ln == 6, F.lit(""))
                  .when(odd, F.concat(F.floor(price).cast("long").cast("string"), F.lit("E3")))
                  .otherwise(F.lit("n/a")))
        pct = F.concat(F.round(F.col("l_discount") * 100).cast("long").cast("string"), F.lit("%"))
        m3 = ln % 3
        date_raw = (F.when((m3 == 0) & odd, F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))
                     .when(m3 == 0, F.date_format("l_shipdate", "yyyy-MM-dd"))
                     .when((m3 == 1) & odd, F.date_format("l_shipdate", "M/d/yyyy"))
                     .when(m3 == 1, F.date_format("l_shipdate", "MM/dd/yyyy"))
                     .otherwise(F.concat(F.date_format("l_shipdate", "yyyy"), F.lit("-13-45"))))
        installs = F.when(ln % 4 == 0, F.lit("n/a")).otherwise(
            F.col("l_quantity").cast("long").cast("string"))
        return li.select("l_orderkey", "l_linenumber", money.alias("money_raw"),
                         pct.alias("percent_raw"), date_raw.alias("date_raw"),
                         installs.alias("installs_raw"))

    # ---- B5 --------------------------------------------------------------
    @cached_property
    def actuals(self) -> DataFrame:
        """One row per (campaign, horizon) with the realised ROAS."""
        c = self.campaign
        horizons = F.explode(F.array(*[F.lit(d) for d in TARGET_DAYS])).alias("target_day")
        a = c.select("row_id", *HIERARCHY, "cost", "revenue", "installs", "roas", horizons)
        actual = F.when(F.col("target_day") == 7, F.col("roas") * F.lit(D7_SHARE)).otherwise(F.col("roas"))
        return a.select("row_id", "target_day", *HIERARCHY, "cost", "revenue", "installs",
                        actual.alias("actual"),
                        split_bucket(F.col("row_id")).alias("split_bucket"))

    @cached_property
    def baseline(self) -> DataFrame:
        from ..operators.forecast import segment_quantile_forecast
        return segment_quantile_forecast(self.actuals, ["platform", "channel", "target_day"],
                                         "actual", train_col="split_bucket")

    @cached_property
    def predictions(self) -> DataFrame:
        """Segment quantiles, moved per row by key arithmetic so that every tier,
        action, confidence level and clip occurs."""
        q = self.baseline
        key = F.col("row_id")
        level = F.when(key % 101 == 0, 40.0).otherwise((key % 17 + 1) * 0.25)
        spread = F.when(key % 3 == 0, 0.02).otherwise((key % 11 + 1) / 12.0)
        moved = q.select(*self.actuals.columns, (F.col("p50") * level * (1.0 - spread)).alias("p10"),
                         (F.col("p50") * level).alias("p50"), (F.col("p50") * level * (1.0 + spread)).alias("p90"))
        return cut_lineage(moved.withColumn("width", F.col("p90") - F.col("p10")))

    # ---- B6 --------------------------------------------------------------
    @cached_property
    def registry_dataset(self) -> DataFrame:
        from ..functions.naming import canonical_name
        s = self.t("supplier", ["s_suppkey", "s_nationkey"])
        n = self.t("nation", ["n_nationkey", "n_name"])
        nets = ["unity_ads", "mistplay", "facebook", "google", "tiktok", "unknown"]
        j = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)
        key = F.col("s_suppkey")
        start = F.date_add(F.lit("2024-01-01").cast("date"), (key % 30).cast("int"))
        started = F.timestamp_add("HOUR", key, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
        base = j.select(
            F.concat(F.lit("ds-"), key.cast("string")).alias("id"),
            F.concat(F.element_at(F.array(*[F.lit(x) for x in KIND_WORDS]), (key % 6 + 1).cast("int")),
                     F.lit(" "), key.cast("string"), F.lit(".csv")).alias("raw_filename"),
            F.element_at(F.array(*[F.lit(x) for x in nets]), (key % 6 + 1).cast("int")).alias("source_platform"),
            F.element_at(F.array(F.lit("android"), F.lit("ios"), F.lit("web")), (key % 3 + 1).cast("int")).alias("channel"),
            F.concat(F.lit("Game "), (key % 7).cast("string")).alias("game"),
            F.col("n_name").alias("country"),
            (key * 10).alias("records"),
            started.alias("ingest_started_at"),
            F.when(key % 10 == 0, F.lit(None).cast("timestamp_ntz"))
             .otherwise(F.timestamp_add("MINUTE", F.lit(5), started)).alias("ingest_completed_at"),
            start.alias("data_start_date"),
            F.date_add(start, 30).alias("data_end_date"))
        return base.select("*", canonical_name(F.col("game"), F.col("source_platform"), F.col("channel"),
                                               F.array(F.col("country")), F.col("data_start_date"),
                                               F.col("data_end_date")).alias("canonical_name"))

    @cached_property
    def registry_model_version(self) -> DataFrame:
        n = self.t("nation", ["n_nationkey", "n_regionkey"])
        key = F.col("n_nationkey")
        day = F.element_at(F.array(F.lit(7), F.lit(14), F.lit(30), F.lit(90)), (F.col("n_regionkey") % 4 + 1).cast("int"))
        from ..functions.naming import model_name
        name = model_name(day, F.lit("multi"))
        return n.select(
            F.concat(F.lit("mv-"), key.cast("string")).alias("id"),
            name.alias("model_name"),
            day.alias("target_day"),
            (key % 3 + 1).cast("int").alias("version_hint"),
            F.timestamp_add("DAY", key, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).alias("created_at"),
            F.concat(F.lit("ds-"), (key * 4 % 100 + 1).cast("string")).alias("train_dataset_id"))

    @cached_property
    def registry_prediction_run(self) -> DataFrame:
        o = self.t("orders", ["o_orderkey", "o_custkey", "o_orderdate"])
        key = F.col("o_orderkey")
        return o.select(
            F.concat(F.lit("run-"), key.cast("string")).alias("id"),
            F.concat(F.lit("mv-"), (F.col("o_custkey") % 25).cast("string")).alias("model_version_id"),
            F.concat(F.lit("ds-"), (key % 100 + 1).cast("string")).alias("dataset_id"),
            F.col("o_orderdate").alias("requested_at"),
            F.when(key % 7 == 0, F.lit(None).cast("timestamp_ntz"))
             .otherwise(F.timestamp_add("MINUTE", F.lit(2), F.col("o_orderdate"))).alias("completed_at"),
            (key % 500).alias("n_rows"))

    # ---- B7 / B8 ---------------------------------------------------------
    @cached_property
    def questions(self) -> DataFrame:
        return (self.t("conversations", ["conv_id", "turn", "role", "text"])
                    .where(F.col("role") == "user").select("conv_id", "turn", "text"))

    @cached_property
    def keyed_questions(self) -> DataFrame:
        """Questions with a keyword picked by key, so that every route occurs."""
        words = F.array(*[F.lit(w) for w in QUESTION_WORDS])
        pick = F.element_at(words, ((F.col("conv_id") + F.col("turn")) % len(QUESTION_WORDS) + 1).cast("int"))
        return self.questions.select("conv_id", "turn", F.concat("text", F.lit(" "), pick).alias("text"))

    @cached_property
    def replies(self) -> DataFrame:
        """Model replies about each question: fenced in two ways, plain, or no JSON,
        with entries that must be skipped."""
        t = F.col("turn").cast("string")
        body = F.concat(F.lit('{"recommendations": [{"row_index": '), t, F.lit(', "action": " scale ", "rationale": "r'),
                        F.col("conv_id").cast("string"), F.lit('", "budget_change_pct": 10.5},\n{"row_index": "x", "action": "cut"},'
                        ' {"row_index": "'), (F.col("turn") + 1).cast("string"),
                        F.lit('", "action": "cut", "budget_change_pct": "much"}]}'))
        k = F.col("conv_id") % 4
        text = (F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```\nThanks")))
                 .when(k == 1, F.concat(F.lit("  ```\n"), body, F.lit("\n```"))).when(k == 2, body)
                 .otherwise(F.concat(F.lit("no advice: "), F.col("text"))))
        return self.questions.select("conv_id", "turn", text.alias("reply"))

    @cached_property
    def usage_events(self) -> DataFrame:
        cv = self.t("conversations", ["conv_id", "turn", "role", "text"])
        return cv.select(
            "conv_id", "turn", F.col("role").alias("kind"),
            F.when(F.col("conv_id") % 2 == 0, "gpt-5-mini").otherwise("gpt-4o").alias("model"),
            F.floor(F.octet_length("text") / 4).cast("long").alias("input_tokens"),
            F.floor(F.octet_length("text") / 10).cast("long").alias("output_tokens"))
