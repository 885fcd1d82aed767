"""Registry reads, versions, names and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import artifact_path, is_valid_name, is_valid_name_sql
from ..operators.ordered import dense_row_index, latest_per_key
from ..operators.sets import common_rows
from ..sources import registry as R
from .bridge import HIERARCHY, Bridge
from .bridge_sql import with_views
from .catalog import query


@query("S11_datasets_by_platform_game", with_views("registry_dataset") + """
SELECT id, canonical_name, ingest_started_at FROM registry_dataset
WHERE source_platform = 'unity_ads' AND game ILIKE '%game 1%' ORDER BY ingest_started_at DESC""")
def s11(b: Bridge) -> DataFrame:
    d = R.get_datasets(b.registry_dataset, platform="unity_ads", game="game 1")
    return d.select("id", "canonical_name", "ingest_started_at")


@query("S12_dataset_by_id", with_views("registry_dataset") + """
SELECT id, canonical_name, records FROM registry_dataset WHERE id = 'ds-7'""")
def s12(b: Bridge) -> DataFrame:
    return R.get_by_id(b.registry_dataset, "ds-7").select("id", "canonical_name", "records")


@query("S13_versions_and_runs", with_views("registry_model_version", "registry_prediction_run") + """
SELECT 'model_version' AS kind, id, created_at AS ts FROM registry_model_version
WHERE model_name = 'lgbm_roas_d30_multi_quantile'
UNION ALL
SELECT 'prediction_run', id, requested_at FROM registry_prediction_run
WHERE model_version_id = 'mv-3' AND dataset_id = 'ds-4'""")
def s13(b: Bridge) -> DataFrame:
    mv = R.model_versions_of(b.registry_model_version, "lgbm_roas_d30_multi_quantile")
    runs = R.prediction_runs_of(b.registry_prediction_run, model_version_id="mv-3", dataset_id="ds-4")
    return (mv.select(F.lit("model_version").alias("kind"), "id", F.col("created_at").alias("ts"))
              .unionByName(runs.select(F.lit("prediction_run").alias("kind"), "id",
                                       F.col("requested_at").alias("ts"))))


@query("S14_recent_activity", with_views("registry_dataset", "registry_model_version", "registry_prediction_run") + """
SELECT * FROM (SELECT 'dataset' AS kind, id FROM registry_dataset WHERE ingest_completed_at IS NOT NULL
               ORDER BY ingest_completed_at DESC, id LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'model_version', id FROM registry_model_version ORDER BY created_at DESC, id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'prediction_run', id FROM registry_prediction_run ORDER BY requested_at DESC, id LIMIT 5)""")
def s14(b: Bridge) -> DataFrame:
    return R.recent_activity(b.registry_dataset, b.registry_model_version, b.registry_prediction_run)


@query("W3_next_version", with_views("registry_model_version") + """
SELECT model_name, MAX(version_hint) + 1 AS next_version FROM registry_model_version GROUP BY model_name""")
def w3(b: Bridge) -> DataFrame:
    return R.next_versions(b.registry_model_version, "model_name", "version_hint")


@query("W4_latest_run", with_views("registry_prediction_run") + """
SELECT model_version_id, dataset_id, id, requested_at FROM (
  SELECT *, row_number() OVER (PARTITION BY model_version_id, dataset_id ORDER BY requested_at DESC, id DESC) AS rn
  FROM registry_prediction_run) WHERE rn = 1""")
def w4(b: Bridge) -> DataFrame:
    return latest_per_key(b.registry_prediction_run, ["model_version_id", "dataset_id"],
                          ["requested_at", "id"], ["id", "requested_at"])


@query("W5_stable_row_index", with_views("campaign") + """
SELECT row_id, row_number() OVER (ORDER BY game, platform, channel, country) - 1 AS row_index FROM campaign""")
def w5(b: Bridge) -> DataFrame:
    c = b.campaign.select("row_id", *HIERARCHY)
    return dense_row_index(c, HIERARCHY).select("row_id", "row_index")


@query("J9_runs_with_model_and_dataset", with_views("registry_dataset", "registry_model_version",
                                                     "registry_prediction_run") + """
SELECT r.id, m.model_name, d.canonical_name FROM registry_prediction_run r
LEFT JOIN registry_model_version m ON r.model_version_id = m.id
LEFT JOIN registry_dataset d ON r.dataset_id = d.id""")
def j9(b: Bridge) -> DataFrame:
    return R.runs_with_parents(b.registry_prediction_run, b.registry_model_version, b.registry_dataset)


@query("J10_unique_names", with_views("registry_dataset") + """
, d AS (SELECT id, ingest_started_at, substr(canonical_name, 1, 6) AS name FROM registry_dataset),
f AS (SELECT name, arg_min(id, (ingest_started_at, id)) AS first_id FROM d GROUP BY name)
SELECT d.id, CASE WHEN d.id = f.first_id THEN d.name
                  ELSE d.name || '_' || substr(md5(d.id), 1, 6) END AS unique_name
FROM d JOIN f ON d.name = f.name""")
def j10(b: Bridge) -> DataFrame:
    """Names cut to the game, so that many datasets share one."""
    return R.unique_names(b.registry_dataset.withColumn("canonical_name", F.substring("canonical_name", 1, 6)))


@query("X20_X21_canonical_names", with_views("registry_dataset") + f"""
SELECT id, canonical_name, length(canonical_name) AS name_length, {is_valid_name_sql('canonical_name')} AS is_valid
FROM registry_dataset""")
def x20(b: Bridge) -> DataFrame:
    d = b.registry_dataset
    return d.select("id", "canonical_name", F.length("canonical_name").alias("name_length"),
                    is_valid_name(F.col("canonical_name")).alias("is_valid"))


@query("X22_model_names", with_views("registry_model_version") + """
SELECT id, model_name, 'artifacts/' || model_name || '/v' || CAST(version_hint AS VARCHAR) AS artifact_path
FROM registry_model_version""")
def x22(b: Bridge) -> DataFrame:
    m = b.registry_model_version
    return m.select("id", "model_name", artifact_path(F.col("model_name"), F.col("version_hint")).alias("artifact_path"))


@query("U2_training_datasets", with_views("registry_dataset") + """
SELECT COUNT(*) AS n_datasets, SUM(records) AS records, MAX(data_end_date) AS train_end_date
FROM registry_dataset WHERE source_platform = 'unity_ads' AND ingest_completed_at IS NOT NULL""")
def u2(b: Bridge) -> DataFrame:
    return R.training_scope(b.registry_dataset, "unity_ads")


@query("U4_common_rows", with_views("actuals", "predictions") + """
SELECT target_day, COUNT(*) AS n FROM actuals a
WHERE EXISTS (SELECT 1 FROM predictions p WHERE p.row_id = a.row_id AND p.split_bucket = 0)
GROUP BY target_day""")
def u4(b: Bridge) -> DataFrame:
    test = b.predictions.where(F.col("split_bucket") == 0).select("row_id").distinct()
    return common_rows(b.actuals, test).groupBy("target_day").agg(F.count(F.lit(1)).alias("n"))

