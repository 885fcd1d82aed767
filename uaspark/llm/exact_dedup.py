"""Exact dedup by skew-safe combining (DataFrame functions only).

Copies are combined in three steps, and every step groups on the digest *and*
the full text, so a digest collision can never merge two texts:

1. each map task combines its own rows (the partial aggregate of step 2);
2. rows meet by (digest, salt, text); the salt is the map task modulo
   ``salts``, so a text held by a third of all rows arrives at up to ``salts``
   reducers as one row per map task, never as its copies;
3. the winners of the salts meet by (digest, text): at most ``salts`` rows each.

The class table that results has no text.  Rows find their class by digest
alone unless a digest names more than one text; rows of such digests are joined
on the text as well.

Defined results: a null text counts as empty.  Of equal texts the row with the
largest id stays; null ids lose to any id.  Rows that share both id and text
share one decision; ``survivors`` returns the one with the greatest other
columns.  An empty table gives an empty result.  Other columns pass through
``survivors``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _rows(docs: DataFrame, id_col: str, text_col: str,
          digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text")) \
        .withColumn("digest", digest(F.col("text")))


def _combine(rows: DataFrame, salts: int) -> DataFrame:
    """(digest, text, keep_id, group_size), one row per distinct text."""
    salted = (rows.withColumn("salt", F.spark_partition_id() % salts)
              .groupBy("digest", "salt", "text")
              .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    return (salted.groupBy("digest", "text")
            .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")))


def copy_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16,
                 digest: Callable[[Column], Column] = sha256_digest) -> DataFrame:
    """One row per input row: (id, digest, keep_id, group_size, kept).

    ``digest`` may be any function of the text; a weak one costs time, not
    correctness.
    """
    rows = _rows(docs, id_col, text_col, digest)
    combined = _combine(rows, salts)
    classes = cut_lineage(combined.select("digest", "keep_id", "group_size"))
    shared = classes.groupBy("digest").count().filter("count > 1").select("digest")
    narrow = rows.select("id", "digest")
    if shared.isEmpty():
        found = narrow.join(classes, "digest")
    else:
        shared = cut_lineage(shared)
        plain = narrow.join(classes.join(shared, "digest", "left_anti"), "digest")
        by_text = rows.join(shared, "digest", "left_semi").join(
            _combine(rows.join(shared, "digest", "left_semi"), salts), ["digest", "text"])
        found = plain.unionByName(by_text.select(*plain.columns))
    return found.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              salts: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; one row per distinct text.

    The rest of a row travels with its text through the same steps, as a struct
    that starts with the id; its columns must be orderable."""
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    row = F.struct(F.col(id_col).alias("id"), F.col(text_col).isNull().alias("blank"),
                   *[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)])
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(text.alias("text"), row.alias("row")).withColumn("digest", sha256_digest(F.col("text")))
    salted = (rows.withColumn("salt", F.spark_partition_id() % salts)
              .groupBy("digest", "salt", "text").agg(F.max("row").alias("row")))
    best = salted.groupBy("digest", "text").agg(F.max("row").alias("row"))
    back = {id_col: F.col("row.id"), text_col: F.when(~F.col("row.blank"), F.col("text"))}
    back |= {c: F.col(f"row.c{i}") for i, c in enumerate(rest)}
    return best.select(*[back[c].alias(c) for c in docs.columns])
