"""Header, payload, alignment and storage operators as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators import booster as BO
from ..operators import clean as C
from ..operators import profile as P
from ..operators.sets import union_datasets, union_kinds
from ..session import ensure_checkpoint_dir
from ..sources import files as SRC
from ..sources import registry as R
from ..streaming.ingest import ingest_to_registry
from .bridge import HIERARCHY, Bridge
from .bridge_sql import with_views
from .catalog import query, r6


def _store(b: Bridge) -> str:
    """A new folder in the shared folder."""
    return f"{ensure_checkpoint_dir(b.spark)}/store-{uuid.uuid4().hex}"


@query("P1_normalize_headers", with_views("raw_strings") + """
SELECT l_orderkey, l_linenumber, money_raw AS money, date_raw AS date FROM raw_strings""")
def p1(b: Bridge) -> DataFrame:
    """Padded and mixed-case headers; of two headers for one name the first counts."""
    r = b.raw_strings
    return C.normalize_headers(r.select(F.col("l_orderkey").alias(" L_OrderKey"), "l_linenumber", F.col("money_raw").alias("Money "),
                                        F.col("date_raw").alias("DATE"), F.col("percent_raw").alias("money")))


@query("P3_P5_synonyms", with_views("raw_strings") + """
SELECT l_orderkey, l_linenumber, date_raw AS date, coalesce(money_raw, percent_raw) AS cost, percent_raw AS retention_d7,
       installs_raw AS roas_d30, 0 AS installs, 0 AS revenue FROM raw_strings""")
def p3(b: Bridge) -> DataFrame:
    r = b.raw_strings.select("l_orderkey", "l_linenumber", F.col("date_raw").alias("report_date"), F.col("money_raw").alias("spend"),
                             F.col("percent_raw").alias("adspend"), F.col("percent_raw").alias("retention_rate_d7"),
                             F.col("installs_raw").alias("ROAS d 30"))
    return C.map_synonyms(r)


@query("P17_top_features", with_views("cohort_wide") + """
SELECT platform, round(roas_d7, 6) AS roas_d7, round(cost, 6) AS cost FROM cohort_wide""")
def p17(b: Bridge) -> DataFrame:
    top = C.top_features(b.cohort_wide, ["roas_d7", "not_there", "cost", "roas_d0"], 3)
    return top.select("platform", r6("roas_d7").alias("roas_d7"), r6("cost").alias("cost"))


@query("P18_P19_first_values", with_views("registry_dataset") + """
SELECT id, source_platform AS platform, country FROM registry_dataset""")
def p18(b: Bridge) -> DataFrame:
    d = b.registry_dataset.withColumn("countries", F.array("country", F.lit("other")))
    found = C.first_existing_column(d, ["platform", "source_platform", "network"])
    return d.select("id", F.col(found).alias("platform"), C.first_element(F.col("countries")).alias("country"))


@query("P20_compact_payload", with_views("campaign") + """
SELECT to_json({'row_id': CAST(row_id AS VARCHAR), 'platform': platform, 'channel': CASE WHEN row_id % 2 = 0 THEN channel END,
                'installs': CAST(installs AS VARCHAR)})::VARCHAR AS payload
FROM (SELECT * FROM campaign ORDER BY row_id LIMIT 200)""")
def p20(b: Bridge) -> DataFrame:
    c = b.campaign.select("row_id", "platform", F.when(F.col("row_id") % 2 == 0, F.col("channel")).alias("channel"), "installs")
    return C.compact_payload(c, ["row_id"], 200)


@query("P22_align_features", with_views("cohort_wide") + """
SELECT campaign_key, round(roas_d7, 6) AS roas_d7, 0.0::DOUBLE AS unseen, installs FROM cohort_wide""")
def p22(b: Bridge) -> DataFrame:
    a = C.align_features(b.cohort_wide, ["roas_d7", "unseen", "installs"], keep=["campaign_key"])
    return a.select("campaign_key", r6("roas_d7").alias("roas_d7"), "unseen", "installs")


@query("S5_S6_dataset_store", with_views("campaign_daily") + """
SELECT game, platform, channel, country, date, installs, round(cost, 6) AS cost, 'ds-BUILDING' AS dataset_id
FROM campaign_daily WHERE platform = 'BUILDING'""")
def s5(b: Bridge) -> DataFrame:
    """Two datasets written to one store in the shared folder; one read back by its partition."""
    root = _store(b)
    daily = b.campaign_daily.select(*HIERARCHY, "date", "installs", r6("cost").alias("cost")).where(
        F.col("platform").isin("BUILDING", "MACHINERY"))
    for platform in ("BUILDING", "MACHINERY"):
        R.write_dataset_data(daily.where(F.col("platform") == platform), root, f"ds-{platform}")
    return R.read_dataset_data(b.spark, root, "ds-BUILDING")


@query("S7_S8_prediction_store", with_views("predictions") + """
SELECT row_id, target_day, round(p50, 6) AS p50, 'run-30' AS run_id FROM predictions WHERE target_day = 30""")
def s7(b: Bridge) -> DataFrame:
    root = _store(b)
    p = b.predictions.select("row_id", "target_day", r6("p50").alias("p50"))
    for day in (7, 30):
        R.write_prediction_run(p.where(F.col("target_day") == day), root, f"run-{day}")
    return R.read_prediction_run(b.spark, root, "run-30")


@query("U2_concat_datasets", with_views("cohort_wide", "levels_wide") + """
SELECT campaign_key, platform, installs, round(roas_d7, 6) AS roas_d7, NULL::BIGINT AS level_8_events FROM cohort_wide
UNION ALL SELECT campaign_key, platform, installs, NULL, level_8_events FROM levels_wide""")
def u2_concat(b: Bridge) -> DataFrame:
    keys = ["campaign_key", "platform", "installs"]
    return union_datasets([b.cohort_wide.select(*keys, r6("roas_d7").alias("roas_d7")),
                           b.levels_wide.select(*keys, "level_8_events")])


@query("U3_all_kinds", with_views("campaign_daily", "cohort_wide", "levels_wide") + """
SELECT data_type, platform, COUNT(*) AS n, COUNT(cost) AS n_cost, COUNT(level) AS n_level FROM (
  SELECT 'adspend_revenue' AS data_type, platform, cost, NULL AS level FROM campaign_daily
  UNION ALL SELECT 'retention', platform, cost, NULL FROM cohort_wide
  UNION ALL SELECT 'level_progression', platform, NULL, level_8_events FROM levels_wide) GROUP BY ALL""")
def u3(b: Bridge) -> DataFrame:
    u = union_kinds({"adspend_revenue": b.campaign_daily, "retention": b.cohort_wide, "level_progression": b.levels_wide})
    return u.groupBy("data_type", "platform").agg(F.count(F.lit(1)).alias("n"), F.count("cost").alias("n_cost"),
                                                  F.count("level_8_events").alias("n_level"))


_CSV_COLS = ["date", "platform", "channel", "game", "country", "installs", "cost"]


@query("S3_S9_csv_export", with_views("campaign") + """
SELECT CAST(row_id AS VARCHAR) AS row_id, platform, CAST(installs AS VARCHAR) AS installs FROM campaign""")
def s9(b: Bridge) -> DataFrame:
    """Exported as CSV with a header and read back as text."""
    path = f"{_store(b)}/export"
    R.export_csv(b.campaign.select("row_id", "platform", "installs"), path)
    return SRC.read_csv_file(b.spark, path)


@query("S4_data_files", with_views("registry_dataset") + """
, f AS (SELECT id, CASE WHEN records % 110 = 0 THEN '~$' || raw_filename WHEN records % 70 = 0 THEN 'Demo_' || raw_filename
                        WHEN records % 130 = 0 THEN 'my TEMPLATE ' || raw_filename ELSE raw_filename END AS name FROM registry_dataset)
SELECT id, name FROM f WHERE NOT (starts_with(lower(name), '~$') OR contains(lower(name), 'template') OR contains(lower(name), 'demo_')
                                  OR contains(lower(name), 'feature_importance'))""")
def s4(b: Bridge) -> DataFrame:
    k, name = F.col("records"), F.col("raw_filename")
    files = b.registry_dataset.select("id", F.when(k % 110 == 0, F.concat(F.lit("~$"), name)).when(k % 70 == 0, F.concat(F.lit("Demo_"), name))
                                      .when(k % 130 == 0, F.concat(F.lit("my TEMPLATE "), name)).otherwise(name).alias("name"))
    return files.where(SRC.is_data_file(F.col("name")))


@query("S4_best_name_match", with_views("registry_dataset") + """
SELECT id, raw_filename FROM registry_dataset WHERE lower(raw_filename) = 'roas data 8.csv'""")
def s4_match(b: Bridge) -> DataFrame:
    """No file has this name; one differs in case and extension."""
    return SRC.best_name_match(b.registry_dataset.select("id", "raw_filename"), "roas DATA 8.xlsx", "raw_filename")


@query("S10_registry_records", with_views("registry_model_version") + """
SELECT id, model_name, target_day FROM registry_model_version""")
def s10(b: Bridge) -> DataFrame:
    """Every model version (one per nation) added as a record, some of them twice, and the table read back."""
    root = _store(b)
    for i, r in enumerate(b.registry_model_version.select("id", "model_name", "target_day").collect()):
        for _ in range(1 + i % 2):
            R.append_record(b.spark, root, R.MODEL_VERSION, r.asDict(), "id string, model_name string, target_day int")
    return R.read_registry(b.spark, root, R.MODEL_VERSION)


@query("S16_preview", with_views("campaign") + """
SELECT row_id, platform, round(cost, 6) AS cost FROM campaign ORDER BY row_id LIMIT 20""")
def s16(b: Bridge) -> DataFrame:
    return SRC.preview(b.campaign.select("row_id", "platform", r6("cost").alias("cost")), ["row_id"], 20)


@query("S17_M9_model_bundle", with_views("actuals") + """
SELECT 2 AS version, COUNT(*) AS n, COUNT(*) AS alike FROM actuals WHERE target_day = 30""")
def s17(b: Bridge) -> DataFrame:
    """Two registered versions of a small bundle; the one read back scores as the one saved."""
    root, rows = _store(b), b.actuals.where(F.col("target_day") == 30)
    models = BO.fit_quantile_triple(rows, ["cost", "installs"], "actual", n_rounds=2, max_depth=3)
    ends = b.registry_dataset.select("id", "data_end_date")
    R.register_model(b.spark, root, models, "m", 30, ends)
    record = R.register_model(b.spark, root, models, "m", 30, ends)
    loaded, _ = BO.load_models(b.spark, record["artifact_path"])
    both = BO.score_all(models | {f"{n}_again": m for n, m in loaded.items()}, rows)
    alike = (F.col("p10") == F.col("p10_again")) & (F.col("p50") == F.col("p50_again")) & (F.col("p90") == F.col("p90_again"))
    return both.agg(F.lit(record["version"]).alias("version"), F.count(F.lit(1)).alias("n"), F.count_if(alike).alias("alike"))


@query("R9_registry_ingest", with_views("campaign_daily") + """
SELECT 'daily-0' AS dataset_id, COUNT(*) AS n, COUNT(*) AS records, MIN(date) AS data_start_date, MAX(date) AS data_end_date, CAST(SUM(installs) AS DOUBLE) AS installs,
  COUNT(DISTINCT country) AS countries FROM campaign_daily""")
def r9(b: Bridge) -> DataFrame:
    """Daily rows dropped as CSV files, taken in by the stream, one dataset for the batch; then run again without news."""
    root = _store(b)
    daily = b.campaign_daily.select(*[F.col(c).cast("string").alias(c) for c in _CSV_COLS])
    daily.write.option("header", True).csv(f"{root}/in")
    schema = StructType([StructField(c, StringType()) for c in _CSV_COLS])
    for _ in range(2):
        ingest_to_registry(b.spark, f"{root}/in", schema, root, f"{root}/checkpoint", "daily").awaitTermination()
    kept = R.read_dataset_data(b.spark, root, "daily-0").groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("installs").cast("double").alias("installs"), F.count_distinct("country").alias("countries"))
    listed = R.read_registry(b.spark, root, R.DATASET).select(F.col("id").alias("dataset_id"), "records", "data_start_date", "data_end_date")
    return kept.join(listed, "dataset_id").select("dataset_id", "n", "records", "data_start_date", "data_end_date", "installs", "countries")


@query("A19_feature_summary", """
SELECT family, CAST(n AS BIGINT) AS n FROM (VALUES ('retention_features', 7), ('roas_features', 8), ('level_features', 7), ('cost_features', 1),
  ('platform_features', 1), ('total_features', 34), ('numeric_features', 28), ('string_features', 4)) t(family, n)""")
def a19(b: Bridge) -> DataFrame:
    return P.feature_summary(b.campaign_cohorts)


@query("A26_schema_fingerprint", with_views("campaign") + """
SELECT md5('{"rows":' || COUNT(*) || ',"schema":[["country","string"],["installs","bigint"],["row_id","bigint"]]}') AS fingerprint FROM campaign""")
def a26(b: Bridge) -> DataFrame:
    mark = P.schema_fingerprint(b.campaign.select("row_id", "country", "installs"))
    return b.spark.createDataFrame([(mark,)], "fingerprint string")
