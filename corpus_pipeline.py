"""From raw documents to token ids: language ID, exact dedup, near dedup, mixing, BPE.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept.  ``run`` writes each stage as Parquet into the shared checkpoint folder
and reads it again, so a lost executor costs one stage at most; a stage's tables are
deleted once the next stage is written.  Stages with Python steps bound the bytes of an
Arrow batch for the session (``bound_batches``).

Rows with nulls in any column, empty and very long texts and repeated rows pass through
as each stage defines: without text or letter a row goes (language ID); of equal rows one
stays (exact dedup), a row without an id only where no equal text has one; near copies
are judged row by row; a null source is a source of its own; an empty table gives an empty
result.  Columns besides those of ``documents`` pass through all stages but the last,
which returns id, language, source and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uaspark.llm import bpe, exact_dedup, langid, mixing, ngram_join
from uaspark.llm.columns import only_given
from uaspark.llm.store import Scratch, drop, write_table
from uaspark.session import bound_batches

#: Posterior below which a document's language counts as unknown.
MIN_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; those without a letter, without text
    or of no clear language go."""
    bound_batches(spark)
    model = langid.train(docs.filter(langid.fold() != 2))
    found = langid.predict(docs, model)
    return only_given(found.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)), docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact_dedup.survivors(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by similar five-word shingles, the smallest doc_id."""
    bound_batches(spark)
    return ngram_join.survivors(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, small sources repeated to their weights, in
    the order of the blocks."""
    # a block lies in one partition since its slots were given; only its order is left
    return only_given(mixing.mix(docs).sortWithinPartitions("block", "slot"), docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the whole texts, and digests of ids and decoded text."""
    bound_batches(spark)
    import public_tokenizers  # describes where the vocabularies lie on this machine

    vocabulary = bpe.Vocabulary.from_file(spark, public_tokenizers.path("byte_bpe_50k.json"))
    return bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), vocabulary, keep_ids=True)


STAGES = [("language_id", language_id), ("exact_dedup", exact_copies), ("ngram_join", near_copies),
          ("mixing", mix_sources), ("bpe", tokenise)]

#: The tokeniser can't be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with Scratch(spark) as scratch:               # a stage's own tables go once its result is written
            result = stage(spark, docs, sf_dir)
            path = scratch.keep(write_table(result))
        docs = spark.read.schema(result.schema).parquet(path)
        if before:                                    # and so does the result it has read
            drop(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
