"""Incremental ingest and threshold alerts with Structured Streaming.

R9: new campaign CSVs dropped into a folder are normalised (the same
projection as batch ingest) and appended to a parquet table; the file-source
checkpoint makes every file count exactly once, ``availableNow`` processes
the backlog and stops (a daily job).

R3: daily CPI / retention alerts over an event stream - event-time
watermark, one-day tumbling windows, a filter on the window aggregates,
append mode (a window is emitted once the watermark passes it).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.clean import normalize_ingest
from ..sources import registry


def ingest_stream(spark: SparkSession, source_dir: str, schema: StructType, sink_dir: str,
                  checkpoint_dir: str, date_formats: list[str] | None = None) -> StreamingQuery:
    """``readStream`` CSV -> normalise -> append parquet, trigger availableNow."""
    raw = (spark.readStream.schema(schema).option("header", True)
                .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
                .csv(source_dir))
    tagged = raw.withColumn("source_file", F.col("_metadata.file_name"))
    norm = normalize_ingest(tagged, date_formats)
    return (norm.writeStream.format("parquet").option("path", sink_dir)
                .option("checkpointLocation", checkpoint_dir).outputMode("append")
                .trigger(availableNow=True).start())


def ingest_to_registry(spark: SparkSession, source_dir: str, schema: StructType, root: str, checkpoint_dir: str,
                       stream: str, date_formats: list[str] | None = None, date_col: str = "date") -> StreamingQuery:
    """R9 with S5 and S10: each batch of new files becomes one dataset of the registry.

    The id of a dataset is the stream's name and the batch number, which the checkpoint keeps
    across restarts.  Its rows and its record are written under that id and replace what an
    earlier try of the same batch has written, so a replayed batch changes nothing.  The
    record comes last: a dataset is listed once its rows are complete."""
    raw = (spark.readStream.schema(schema).option("header", True)
                .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
                .csv(source_dir))
    tagged = raw.withColumn("source_file", F.col("_metadata.file_name"))
    norm = normalize_ingest(tagged, date_formats)

    def keep(batch: DataFrame, number: int) -> None:
        store_batch(batch, number, root, stream, date_col)

    return (norm.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint_dir)
                .trigger(availableNow=True).start())


def store_batch(batch: DataFrame, number: int, root: str, stream: str, date_col: str = "date") -> str | None:
    """One batch as the dataset ``<stream>-<number>``; an empty one leaves no dataset."""
    spark = batch.sparkSession
    dataset_id = f"{stream}-{number}"
    registry.write_dataset_data(batch, root, dataset_id)
    try:
        stored = registry.read_dataset_data(spark, root, dataset_id)
    except AnalysisException:                                 # no dataset yet, and this batch is empty
        return None
    n, first, last = stored.agg(F.count(F.lit(1)), F.min(date_col), F.max(date_col)).first()
    if not n:
        return None
    registry.append_record(spark, root, registry.DATASET, {
        "id": dataset_id, "raw_filename": stream, "records": n, "data_start_date": first, "data_end_date": last,
        "storage_path": f"{root}/data/dataset_id={dataset_id}"},
        "id string, raw_filename string, records long, data_start_date date, data_end_date date, storage_path string")
    return dataset_id


def daily_alerts(events: DataFrame, ts_col: str = "ts", key_cols: tuple[str, ...] = ("platform",),
                 watermark: str = "1 day", max_cpi: float = 2.0, min_retention: float = 0.2) -> DataFrame:
    """Per key and day - installs, spend, CPI, next-day-active share; keep
    the windows that breach a threshold.  Works on batch and streaming frames.

    Expected columns: ``ts``, keys, ``installs`` (0/1 or counts), ``cost`` and
    ``active_d1`` (0/1)."""
    w = events.withWatermark(ts_col, watermark) if events.isStreaming else events
    agg = (w.groupBy(F.window(ts_col, "1 day"), *key_cols)
            .agg(F.sum("installs").alias("installs"), F.sum("cost").alias("cost"),
                 F.sum("active_d1").alias("active_d1")))
    out = agg.select(F.to_date(F.col("window.start")).alias("day"), *key_cols, "installs", "cost",
                     F.try_divide("cost", "installs").alias("cpi"),
                     F.try_divide(F.col("active_d1").cast("double"), F.col("installs")).alias("retention_d1"))
    return out.where((F.col("cpi") > max_cpi) | (F.col("retention_d1") < min_retention)).select(
        "*", F.when(F.col("cpi") > max_cpi, "high_cpi").otherwise("low_retention").alias("alert"))
