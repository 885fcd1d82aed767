"""Importance resampling, toxicity and fill-in-middle, against plain code."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from uaspark.llm import fim, resample, toxicity
from uaspark.llm.columns import set_apart
from .test_llm_ops import DOCS, corpus, empty, frame

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def odd_texts(n=300, seed=3):
    rng = random.Random(seed)
    return ["", None, " ", "a", " a ", "é ü\tb  ", "漢字 かな  x", "<P> in it", "ends <", "<S", "x" * 70 + " " + "y" * 500 + " z Zé9-_",
            *("".join(rng.choices(" \t\nAbé漢😀<>SPM", k=rng.randint(0, 120))) for _ in range(n))]


# columns --------------------------------------------------------------------

def test_clashing_columns_are_renamed_not_lost(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Form long, form_in long, n long")
    assert set_apart(df, "form", "n").columns == ["Form_in_in", "form_in", "n_in"]
    assert set_apart(df, "other") is df


# 11 importance resampling -----------------------------------------------------

def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def test_feature_buckets_equal_plain_crc32():
    texts = odd_texts()
    bucket, doc, words = resample.features(pa.array(texts), 10_000)
    for i, text in enumerate(texts):
        own, every = plain_features(text)
        assert words[i] == len(own)
        assert Counter(bucket[doc == i].tolist()) == Counter(zlib.crc32(f.encode()) % 10_000 for f in every), text
    assert [len(x) for x in resample.features(pa.array([], pa.string()), 10)] == [0, 0, 0]


def plain_resample(rows, target, percent=25, least=20, buckets=10_000, seed=7):
    def count(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in plain_features(t)[1])
    s, t = count(r[1] for r in rows), count(target)
    all_s, all_t = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out, able = {}, []
    for i, text, *_ in rows:
        words, every = plain_features(text)
        weight = sum(gain(zlib.crc32(f.encode()) % buckets) for f in every) // len(every) if every else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = [len(every), weight, score, None]
        if len(words) >= least:
            able.append((-score, i is None, i or 0, i))
    for rank, (*_, i) in enumerate(sorted(able)[:percent * len(able) // 100], 1):
        out[i][3] = rank
    return out


@pytest.mark.parametrize("base", [0, -(1 << 63)])
def test_resampling_equals_plain_code(spark, base):
    rows = [(i + base, *r) for i, *r in corpus(400, seed=8)] + [(None, "no id " * 30, "en", "s", 0), ((1 << 63) - 1 if base else -5, "far " * 25, "en", "s", 0)]
    target = [" ".join(r[1].split()[:9]) for r in rows[:40] if r[1]] + [None, "", "Ünlike ANY"]
    got = resample.resample(frame(spark, rows), spark.createDataFrame([(t,) for t in target], "text string")).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in got} == plain_resample(rows, target)


def test_resampling_edge_cases(spark):
    target = spark.createDataFrame([], "text string")
    assert resample.resample(empty(spark), target).count() == 0
    out = resample.resample(frame(spark, [(1, None, None, None, 0), (2, "", None, None, 0)]), target).collect()
    assert all(r.n_features == 0 and r.weight == 0 and r["rank"] is None for r in out)
    same = [(7, "one two " * 20, "en", "s", 0)] * 40            # repeated rows draw the same noise
    out = resample.resample(frame(spark, same), target).collect()
    assert sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 11)) and len(out) == 40


def test_radix_sort_places_every_row(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0, 5, 5, 5, 70_000, rng.randrange(1 << 20)]), rng.randrange(1 << 12), i) for i in range(5_000)]
    df = spark.createDataFrame(rows, "a long, b long, i long").repartition(7)
    out = resample.radix_ranks(df, [("a", 20), ("b", 12)], len(rows), rows_per_part=300, least_parts=4).collect()
    out.sort(key=lambda r: r.place)
    assert [r.place for r in out] == list(range(len(rows)))
    assert [(r.a, r.b) for r in out] == sorted((a, b) for a, b, _ in rows)


def test_counting_pass_is_stable():
    rows = pa.table({"place": [4, 5, 6, 7], "part": pa.array([1] * 4, pa.int32()), "k": [3, 1, 3, 1]})
    starts = pa.table({"digit": [1, 3], "start": [10, 20]})
    assert resample._deal(rows, starts, 8, "k", 0).column("place").to_pylist() == [20, 10, 21, 11]


# 12 toxicity ------------------------------------------------------------------

HARSH = ["vermin", "halfwit", "blighter"]


def toxic_corpus(n=600, seed=4):
    rng = random.Random(seed)
    plain = ["".join(rng.choices("bdfgklmnprstaeiou", k=rng.randint(3, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(15, 90))
        toxic = i % 6 == 0
        for _ in range(3 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice([*HARSH, "zork" + rng.choice(plain)])
        if not toxic and i % 20 == 1:                           # harmless use of a harsh word
            words[5:7] = ["vermin", "control"]
        rows.append((i, " ".join(words), None, None, 0))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def lexicon(spark):
    rows, labels = toxic_corpus()
    df = spark.createDataFrame(labels + [(None, 1), (3, None), (6, 1)], "doc_id long, toxic int")
    return toxicity.train(frame(spark, rows), df.filter(toxicity.fold() != 1))


def test_lexicon_learns_words_stems_and_exceptions(lexicon):
    assert set(lexicon.weights) == {" vermin ", " halfwit ", " blighter ", " zork"}
    assert "vermin control" in lexicon.exceptions


def test_toxicity_on_held_out_rows(spark, lexicon):
    rows, labels = toxic_corpus()
    truth = dict(labels)
    out = toxicity.score(frame(spark, rows).filter(toxicity.fold() == 1), lexicon).collect()
    assert len(out) > 150
    assert all(r.predicted == truth[r.doc_id] and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)


def test_matches_equal_a_plain_search(lexicon):
    automaton = lexicon.automaton()
    for _, text, *_ in toxic_corpus(200, seed=9)[0]:
        words = toxicity.words_of(text)
        weights = [max((w for p, w in lexicon.weights.items() if f" {x} ".startswith(p)), default=0.0) for x in words]
        for phrase in lexicon.exceptions:
            for i in range(len(words) - 1):
                if " ".join(words[i:i + len(phrase.split())]) == phrase:
                    weights[i:i + len(phrase.split())] = [0.0] * len(phrase.split())
        load, hits = lexicon.load(text, automaton)
        assert hits == sum(w > 0 for w in weights)
        assert load == pytest.approx(100 * sum(weights) / (len(words) + lexicon.calm))


def test_folding():
    assert toxicity.words_of("An 1d10t, a ѕсum-bag & ＨＡＬＦＷＩＴ h@lf​w!t") == ["an", "idiot", "a", "scum", "bag", "halfwit", "halfwit"]
    assert toxicity.words_of("1234 5.0 $12") == [] and toxicity.words_of("весь мир") == ["весь", "мир"]
    assert toxicity.words_of("Größe ist gut!") == ["größe", "ist", "gut"]


def test_l_and_i_behind_a_one(lexicon):
    automaton = lexicon.automaton()
    assert lexicon.load("ha1fw1t b1ighter", automaton)[1] == 2


def test_toxicity_edge_cases(spark, lexicon):
    assert toxicity.score(empty(spark), lexicon).count() == 0
    rows = [(1, None, None, None, 0), (2, "", None, None, 0), (2, " \n", None, None, 0), (3, "vermin", None, None, 0),
            (None, "word " * 200_000 + "vermin " * 20_000, None, None, 0)]
    out = {r.doc_id: r for r in toxicity.score(frame(spark, rows).withColumn("Score", F.lit("mine")), lexicon).collect()}
    assert out[1].score == out[2].score < 0.5 and out[1].matches == 0
    assert out[3].predicted == 1 and out[None].matches == 20_000 and out[None]["Score_in"] == "mine"
    none = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    bare = toxicity.train(frame(spark, toxic_corpus(20)[0]), none)
    assert bare.weights == {} and toxicity.score(frame(spark, rows), bare).filter("score <> 0").count() == 0
    assert toxicity.train(empty(spark), none.filter("false")).weights == {}


# 13 fill-in-middle --------------------------------------------------------------

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_fim(i, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_skip_list_finds_every_rank():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 17, 1000, 5000):
        widths = rng.integers(1, 30, n)
        units = fim.SkipList(widths)
        assert len(units) == n
        place = np.append(0, np.cumsum(widths))
        for r in {0, n, *rng.integers(0, n + 1, 50).tolist()}:
            assert units.place(r) == place[r]
        with pytest.raises(IndexError):
            units.place(n + 1)
    lanes = fim.SkipList(np.full(200_000, 2)).lanes
    assert len(lanes) > 4 and all(a[0].sum() == 200_000 or len(b[0]) for a, b in zip(lanes, lanes[1:]))


def test_unit_widths_equal_the_pattern():
    texts = pa.array(odd_texts())
    for part in (texts, texts.slice(3, 40)):
        assert [w.tolist() for w in fim.unit_widths(part)] == [[len(u) for u in UNIT.findall(t or "")] for t in part.to_pylist()]


def test_fill_in_middle_equals_plain_code(spark):
    rows = [(i, t, None, None, 0) for i, t in enumerate(odd_texts())] + corpus(80)[10:] + [(None, "no id here", None, None, 0)]
    out = fim.transform(frame(spark, rows).withColumns({"form": F.lit(1), "N": F.col("text")}))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "form_in", "N_in", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", fim.restored(F.col("form"), F.col("output"))).collect()
    assert Counter((r.doc_id, r.text, r["n"], r["form"], r.prefix_chars, r.middle_chars, r.output) for r in got) == Counter(
        (i, t, *plain_fim(i, t)) for i, t, *_ in rows)
    assert all(r.back == (r.text or "") for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_edge_cases(spark):
    assert fim.transform(empty(spark)).count() == 0
    long = "ä b" * 400_000
    out = fim.transform(frame(spark, [(i, long, None, None, 0) for i in range(4)])).collect()
    assert all((r["n"], r["form"], r.prefix_chars, r.middle_chars, r.output) == plain_fim(r.doc_id, long) for r in out)
