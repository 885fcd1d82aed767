"""Registry tables and dataset / prediction storage.

The registry is three append-only parquet tables (dataset, model_version,
prediction_run) under one root; normalised data and prediction runs are
parquet folders partitioned by their id, so a read by id prunes partitions.
Writes happen on the driver after the producing action succeeded.

Every write is keyed: a dataset, a run or a record that is written again under its id
takes the place of the first, so a job or a stream batch that is repeated changes
nothing.  Versions are taken by creating a marker file that must not exist, so two
writers never get the same one (on stores that can create a file exclusively, as HDFS
and local disks do).
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Mapping
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

DATASET = "dataset"
MODEL_VERSION = "model_version"
PREDICTION_RUN = "prediction_run"
_RECORD = "record_key"


# ---- writes ---------------------------------------------------------------

def write_dataset_data(df: DataFrame, root: str, dataset_id: str) -> str:
    """The normalised table, one partition folder per dataset; a second write of an
    id replaces its rows and leaves other datasets alone."""
    return _write_part(df, os.path.join(root, "data"), "dataset_id", dataset_id)


def _write_part(df: DataFrame, path: str, key: str, value: str) -> str:
    (df.withColumn(key, F.lit(value)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(key).parquet(path))
    return path


def read_dataset_data(spark: SparkSession, root: str, dataset_id: str) -> DataFrame:
    """Read back one dataset (partition pruning on ``dataset_id``)."""
    return spark.read.parquet(os.path.join(root, "data")).where(F.col("dataset_id") == dataset_id)


def write_prediction_run(pred: DataFrame, root: str, run_id: str) -> str:
    """Predictions with their context columns, partitioned by run id (as S5)."""
    return _write_part(pred, os.path.join(root, "predictions"), "run_id", run_id)


def read_prediction_run(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """S8."""
    return spark.read.parquet(os.path.join(root, "predictions")).where(F.col("run_id") == run_id)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV export with header (recommendations, validation, importances)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def append_record(spark: SparkSession, root: str, table: str, record: Mapping, schema: str | None = None) -> str:
    """Add one registry row (a new uuid when ``id`` is absent); a row with the same
    id is replaced.  Each row is a folder of its own, so writers don't meet."""
    rec = dict(record)
    rec.setdefault("id", str(uuid.uuid4()))
    df = spark.createDataFrame([rec], schema) if schema else spark.createDataFrame([rec])
    df.coalesce(1).write.mode("overwrite").parquet(os.path.join(root, table, f"{_RECORD}={quote(rec['id'], safe='')}"))
    return rec["id"]


def read_registry(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(root, table)).drop(_RECORD)


def take_version(spark: SparkSession, root: str, name: str, after: int = 0) -> int:
    """W3 for writers: the least version above ``after`` that no writer has taken, now
    taken by this one."""
    version = after + 1
    while not _create_exclusively(spark, f"{root}/versions/{quote(name, safe='')}/v{version}"):
        version += 1
    return version


def _create_exclusively(spark: SparkSession, path: str) -> bool:
    """Creates an empty file; false if it is there, also when another writer was faster."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(at.getParent())
    if fs.getScheme() == "file":                              # Hadoop's local file system looks first and creates then
        try:
            os.close(os.open(fs.makeQualified(at).toUri().getPath(), os.O_CREAT | os.O_EXCL))
            return True
        except FileExistsError:
            return False
    try:
        return fs.createNewFile(at)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise


# ---- reads (S11-S14) -------------------------------------------------------

def get_datasets(datasets: DataFrame, platform: str | None = None, game: str | None = None,
                 platform_col: str = "source_platform") -> DataFrame:
    """Platform equality and case-insensitive game substring, newest first."""
    d = datasets
    if platform:
        d = d.where(F.col(platform_col) == platform)
    if game:
        d = d.where(F.col("game").ilike(f"%{game}%"))
    return d.orderBy(F.desc("ingest_started_at"), "id")


def get_by_id(table: DataFrame, id_: str) -> DataFrame:
    """S12."""
    return table.where(F.col("id") == id_)


def model_versions_of(mv: DataFrame, model_name: str | None = None) -> DataFrame:
    return mv.where(F.col("model_name") == model_name) if model_name else mv


def get_model_versions(mv: DataFrame, model_name: str | None = None) -> DataFrame:
    """Model versions by name, newest first, ties by id."""
    return model_versions_of(mv, model_name).orderBy(F.desc("created_at"), "id")


def prediction_runs_of(runs: DataFrame, model_version_id: str | None = None, dataset_id: str | None = None) -> DataFrame:
    d = runs
    if model_version_id:
        d = d.where(F.col("model_version_id") == model_version_id)
    if dataset_id:
        d = d.where(F.col("dataset_id") == dataset_id)
    return d


def get_prediction_runs(runs: DataFrame, model_version_id: str | None = None,
                        dataset_id: str | None = None) -> DataFrame:
    """Runs by model and dataset, newest first, ties by id."""
    return prediction_runs_of(runs, model_version_id, dataset_id).orderBy(F.desc("requested_at"), "id")


def recent_activity(datasets: DataFrame, mv: DataFrame, runs: DataFrame, n_datasets: int = 10,
                    n_models: int = 5, n_runs: int = 5) -> DataFrame:
    """Completed datasets, newest models and runs (top-k reports, ties by id)."""
    d = (datasets.where(F.col("ingest_completed_at").isNotNull())
                 .orderBy(F.desc("ingest_completed_at"), "id").limit(n_datasets)
                 .select(F.lit("dataset").alias("kind"), "id"))
    m = mv.orderBy(F.desc("created_at"), "id").limit(n_models).select(F.lit("model_version").alias("kind"), "id")
    r = runs.orderBy(F.desc("requested_at"), "id").limit(n_runs).select(F.lit("prediction_run").alias("kind"), "id")
    return d.unionByName(m).unionByName(r)


def next_versions(mv: DataFrame, name_col: str = "model_name", version_col: str = "version") -> DataFrame:
    """Next version = max(version) + 1 per model name."""
    return mv.groupBy(name_col).agg((F.max(version_col) + 1).alias("next_version"))


def runs_with_parents(runs: DataFrame, mv: DataFrame, datasets: DataFrame) -> DataFrame:
    """Each run with its model and dataset (foreign-key left joins)."""
    m = mv.select(F.col("id").alias("model_version_id"), "model_name")
    d = datasets.select(F.col("id").alias("dataset_id"), "canonical_name")
    return (runs.select("id", "model_version_id", "dataset_id")
                .join(m, "model_version_id", "left").join(d, "dataset_id", "left")
                .select("id", "model_name", "canonical_name"))


def unique_names(datasets: DataFrame, suffix_len: int = 6, max_length: int = 80, max_rounds: int = 8) -> DataFrame:
    """The earliest dataset keeps its canonical name; later ones with the same
    name get ``_<short id>`` (a digest of the id), cut to ``max_length`` before the
    suffix.  While two names still agree, the later ones get a longer digest.  The
    earliest per name is one partial aggregation (``min_by``), joined on the name."""
    rows = datasets.select("id", "ingest_started_at", F.col("canonical_name").alias("_base"), F.col("canonical_name").alias("_name"))
    for step in range(max_rounds):
        first = rows.groupBy("_name").agg(F.min_by("id", F.struct("ingest_started_at", "id")).alias("_first"),
                                          F.count(F.lit(1)).alias("_n"))
        size = min(32, suffix_len * (step + 1))
        suffix = F.concat(F.lit("_"), F.substring(F.md5("id"), 1, size))
        renamed = F.concat(F.substring("_base", 1, max_length - size - 1), suffix)
        rows = rows.join(first, "_name").select(
            "id", "ingest_started_at", "_base",
            F.when(F.col("id") == F.col("_first"), F.col("_name")).otherwise(renamed).alias("_name"))
        rows = cut_lineage(rows)
        if rows.groupBy("_name").count().where("count > 1").isEmpty():
            break
    return rows.select("id", F.col("_name").alias("unique_name"))


def register_model(spark: SparkSession, root: str, models: Mapping, model_name: str, target_day: int,
                   datasets: DataFrame, metrics: Mapping | None = None) -> dict:
    """M9: save the bundle as the next version of ``model_name`` and add its registry
    row; ``train_end_date`` is the latest end of the training datasets.  The version is
    taken before anything is written (``take_version``)."""
    from ..operators.booster import save_models

    try:
        have = read_registry(spark, root, MODEL_VERSION).where(F.col("model_name") == model_name)
        last = have.agg(F.max("version")).first()[0] or 0
    except AnalysisException:       # no registry yet
        last = 0
    end = datasets.agg(F.max("data_end_date")).first()[0]
    version = take_version(spark, root, model_name, last)
    record = {"id": str(uuid.uuid4()), "model_name": model_name, "version": version, "target_day": target_day,
              "train_end_date": str(end), "artifact_path": f"{root}/artifacts/{model_name}/v{version}",
              "metrics_json": json.dumps(dict(metrics or {}), sort_keys=True)}
    save_models(dict(models), record["artifact_path"], spark, {"metrics": dict(metrics or {}), "train_end_date": str(end)})
    append_record(spark, root, MODEL_VERSION, record, "id string, model_name string, version int, target_day int, "
                  "train_end_date string, artifact_path string, metrics_json string")
    return record


def training_scope(datasets: DataFrame, platform: str) -> DataFrame:
    """Datasets joined for training and their max end date."""
    d = datasets.where((F.col("source_platform") == platform) & F.col("ingest_completed_at").isNotNull())
    return d.agg(F.count(F.lit(1)).alias("n_datasets"), F.sum("records").alias("records"),
                 F.max("data_end_date").alias("train_end_date"))
