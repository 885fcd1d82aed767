"""The corpus pipeline on a small table, stage by stage."""

import json
import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from .test_llm_ops import brute_components, corpus, DOCS
from uaspark.llm import mixing


def test_pipeline_stages_and_result(spark, tmp_path):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    rows = [(i, t, lang or "en", s, n) for i, t, lang, s, n in corpus(80)] + [(500, "12 34", "en", "s1", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    out, frames = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, str(tmp_path))
        if name != "bpe":
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / name))
            out = spark.read.parquet(str(tmp_path / name))
        frames[name] = [tuple(r) for r in out.collect()] if name != "bpe" else out.collect()
    letters = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert sorted(r[0] for r in frames["language_id"]) == sorted(r[0] for r in letters)
    keep = {}
    for r in letters:
        keep[r[1]] = max(r[0], keep.get(r[1], -1))
    assert sorted(r[0] for r in frames["exact_dedup"]) == sorted(keep.values())
    found = brute_components(frames["exact_dedup"])
    assert sorted(r[0] for r in frames["ngram_join"]) == sorted({c for _, c in found.values()})
    assert {r[0] for r in frames["mixing"]} == {r[0] for r in frames["ngram_join"]}
    library = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    texts = {r[0]: r[1] for r in rows}
    assert sorted(r.doc_id for r in frames["bpe"]) == sorted(r[0] for r in frames["mixing"])
    for r in frames["bpe"]:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.ids_sha256 for r in whole) == sorted(r.ids_sha256 for r in frames["bpe"])
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES]) and mixing.plan({"a": 1}).budget == 1


def test_pipeline_over_an_empty_table(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "ids_sha256" in out.columns


def test_pipeline_over_gaps_repeats_and_clashing_columns(spark, tmp_path):
    """Nulls in every column, a very long text, repeated rows and ids, columns named like those of the stages."""
    pytest.importorskip("public_tokenizers")
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(None, None, None, None, None), (1, "plain words of some text here", "en", "a", 1), (1, "plain words of some text here", "en", "a", 1),
            (1, "another text under the same id", "en", None, 2), (None, "no id and no near copy of it", "en", "b", None),
            (5, "", "en", "a", 0), (6, "½ ² 12", "en", "a", 0), (7, long, "en", "a", 9), (8, long + " end", "en", "b", 9), (9, long, "en", "a", 9)]
    clash = ["epoch", "Block", "slot", "lang_pred", "score", "digest", "tag", "root", "_key", "ids"]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in clash])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        for r in now.collect():
            assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for c in clash), name
    kept = {(r.doc_id, r.text) for r in now.collect()}
    assert kept == {rows[1][:2], rows[3][:2], rows[4][:2], (8, long + " end")} or kept == {rows[1][:2], rows[3][:2], rows[4][:2], (9, long)}
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in final.collect()} == {i for i, _ in kept}


@pytest.mark.parametrize("stage", ["language_id", "ngram_join", "bpe"])
def test_stages_bound_the_bytes_of_a_batch(spark, stage):
    """Ten thousand long texts are no single batch for a Python worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(1, "en", "web", "some words of a text")], "doc_id long, lang string, source string, text string")
    long = spark.range(0, 12, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    try:
        spark.conf.unset(key)
        dict(corpus_pipeline.STAGES)[stage](spark, docs, "")
        found = [r.n for r in long.mapInArrow(sizes, "n long").collect()]
        assert len(found) > 1 and max(found) < 6 << 20
        spark.conf.set(key, "2m")                       # the caller's own bound stays
        dict(corpus_pipeline.STAGES)[stage](spark, docs, "")
        assert spark.conf.get(key) == "2m"
    finally:
        spark.conf.unset(key)
