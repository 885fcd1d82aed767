"""Intermediate tables in the shared checkpoint folder, and connected components.

Tables stay until their reader is done: an operator returns a table that reads them.  A
caller who has written an operator's result can drop them with ``Scratch``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


_OPEN: ContextVar[tuple[Scratch, ...]] = ContextVar("open scratches", default=())


class Scratch:
    """Deletes the tables that are stored inside its block when the block ends, but for
    those given to ``keep``.  What the block returns must not read the others any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        self._token = _OPEN.set((*_OPEN.get(), self))
        return self

    def __exit__(self, *_) -> None:
        _OPEN.reset(self._token)
        for path in self.paths:
            drop(self.spark, path)

    def keep(self, path: str) -> str:
        self.paths.remove(path)
        return path

    def hand_on(self, path: str) -> str:
        """Leaves a table to the block around this one, if there is one."""
        for outer in _OPEN.get()[:-1][-1:]:
            outer.paths.append(path)
        return self.keep(path)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside the block, the shuffle files of a query go when it ends; else they stay until
    the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table, through the session's file systems."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def write_table(df: DataFrame) -> str:
    """Writes ``df`` as Parquet under ``spark.checkpoint.dir``; its path."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    for scratch in _OPEN.get()[-1:]:
        scratch.paths.append(path)
    df.write.parquet(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet under ``spark.checkpoint.dir`` and read again:
    computed once, and still there when executors are lost."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df))


#: Up to so many edges the minima of a step are broadcast (16 bytes each).
FEW_EDGES = 200_000


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the connected components of ``edges`` (a, b), both long;
    the root is the smallest node.  Nodes without an edge are not returned.

    Alternating large-star and small-star steps: each hangs neighbours on the
    smallest node seen so far until every component is a star.  A hub is reduced
    to its minimum before the shuffle; its edges are joined, where adaptive
    execution splits them.
    """
    now = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    few = now.count() <= FEW_EDGES
    joinable = F.broadcast if few else (lambda df: df)      # the minima have at most two rows an edge
    mark = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(joinable(least), "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(joinable(low), "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                              F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
        now = stored(small.coalesce(8) if few else small)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark:
            break
        mark = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
