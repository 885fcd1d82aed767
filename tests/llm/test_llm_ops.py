"""The ten training-data operators on small tables, against brute force."""

import functools
import hashlib
import inspect
import itertools
import json
import math
import operator
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from uaspark.llm import (ann, bpe, exact_dedup, langid, lm_score, mixing, ngram_join, pii, quality,
                         sharding)
from uaspark.llm.store import Scratch, components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()


def frame(spark, rows, schema=DOCS, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def corpus(n=60, seed=1):
    """Random texts with exact copies, near copies, nulls, empties and one long text."""
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 60))) for _ in range(n)]
    for i in range(0, n, 7):
        texts[i] = texts[3]
    for i in range(1, n, 9):
        words = texts[4].split() + ["tail"] * 30 + WORDS
        words[rng.randrange(len(words))] = "changed"
        texts[i] = " ".join(words)
    texts[5], texts[6], texts[8], texts[10] = None, "", " \t\n", " ".join(rng.choices(WORDS, k=5000))
    return [(i, t, ["en", "fr", None][i % 3], ["s0", "s0", "s0", "s1", None, ""][i % 6], 0) for i, t in enumerate(texts)]


def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1 sharding ---------------------------------------------------------------

@pytest.mark.parametrize("block", [7, 50_000])
def test_shards_are_even_and_slots_gapless(spark, block):
    rows = [*corpus(), (None, "no id", "en", "s0", 1)]
    out = sharding.shard_by_bytes(frame(spark, rows).withColumn("_key2", F.lit(1)), shards=4, rows_per_block=block).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r[0], r[1]) for r in rows)
    assert all(r["size"] == len((r.text or "").encode()) + 1 for r in out)
    largest = max(r["size"] for r in out)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r)
    total = sum(r["size"] for r in out)
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
        assert abs(sum(r["size"] for r in rs) - total / 4) <= largest + 4


@pytest.mark.parametrize("max_blocks", [1, 2, 256])
def test_shards_equal_independent_cuts(spark, max_blocks):
    """The order is (hash, id): plain cuts at the nearest byte sums, slots by plain ranks."""
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i} " * (i % 7), "en", "s", 0) for i in range(3000)]
    df = frame(spark, rows).withColumn("h", F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2))
    out = sharding.shard_by_bytes(df, shards=4, tolerance=1e-9, rows_per_block=40, max_blocks=max_blocks).collect()
    ordered = sorted(out, key=lambda r: (r.h, r.doc_id))
    total, below, slots = sum(r["size"] for r in out), 0, Counter()
    for r in ordered:
        # the cut nearest to each quarter: this row lies behind it if most of it does
        want = sum(below + r["size"] / 2 > total * i / 4 for i in (1, 2, 3))
        assert r.shard == want or abs(below - total * max(r.shard, want) / 4) <= r["size"]
        assert r.slot == slots[r.shard]
        slots[r.shard] += 1
        below += r["size"]


def test_shard_columns_may_clash(spark):
    df = frame(spark, corpus(30)).withColumns({"size": F.lit("a"), "_key": F.lit("b"), "_block": F.lit("c"), "slot": F.lit("d")})
    out = sharding.shard_by_bytes(df, shards=2)
    assert out.columns[-7:] == ["size_in", "_key", "_block", "slot_in", "size", "shard", "slot"]
    assert {(r.size_in, r["_key"], r["_block"], r.slot_in) for r in out.collect()} == {tuple("abcd")}


def test_one_text_is_split_by_id(spark):
    out = sharding.shard_by_bytes(frame(spark, [(i, "same", "en", "s", 4) for i in range(200)]), shards=4).collect()
    assert set(Counter(r.shard for r in out).values()) == {50}


def test_copies_share_a_shard_when_tolerance_allows(spark):
    rows = [(i, f"text {i // 2} " * 3, "en", "s", 0) for i in range(2000)]
    out = sharding.shard_by_bytes(frame(spark, rows), shards=4, tolerance=0.01).collect()
    shards = {}
    for r in out:
        shards.setdefault(r.text, set()).add(r.shard)
    assert all(len(s) == 1 for s in shards.values())


def test_shard_edge_cases(spark):
    assert sharding.shard_by_bytes(empty(spark)).count() == 0
    out = sharding.shard_by_bytes(frame(spark, [(1, None, None, None, None)] * 3)).collect()
    assert len({r.shard for r in out}) == 1 and sorted(r.slot for r in out) == [0, 1, 2]


# 2 BPE --------------------------------------------------------------------

@pytest.fixture(scope="session")
def vocabulary():
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer
    with open(path, encoding="utf-8") as f:
        return bpe.Vocabulary.from_json(json.load(f)), Tokenizer.from_file(path)


def odd_texts():
    rng = random.Random(5)
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    return ["", "a", "a" * 500, "ab" * 300 + "a" * 301, " " * 40 + "x", "<|endoftext|>", "a<|endoftext|><|endoftext|> b",
            "x\x85y\x1cz  　w", "it's I'll 'twas", "naïve 漢字かな 👩‍👩‍👧 ́a", "\x00\x01", "=" * 999 + "a" * 3000,
            *("".join(map(chr, rng.choices(points, k=200))) for _ in range(100)),
            *("".join(rng.choices(" ab'\n\t1.é", k=150)) for _ in range(200))]


def test_bpe_agrees_with_the_library(vocabulary):
    own, library = vocabulary
    texts = odd_texts() + [r[1] or "" for r in corpus()]
    ids, offsets = bpe.Encoder(own).encode(texts)
    decoder = bpe.Decoder(own)
    for i, (text, ref) in enumerate(zip(texts, library.encode_batch(texts, add_special_tokens=False))):
        got = ids[offsets[i]:offsets[i + 1]].tolist()
        assert got == ref.ids, text
        assert decoder.decode(got) == text
    broken = [128, 5, 200, 50256, 101]
    assert decoder.decode(broken) == library.decode(broken, skip_special_tokens=False)


def test_bpe_refuses_merges_out_of_order():
    letters = {c: b for c, b in bpe.byte_letters().items()}
    vocab = {c: i for i, c in enumerate(letters)} | {"ab": 256, "abc": 257}
    file = {"model": {"vocab": vocab, "merges": ["a b", "ab c"]}, "added_tokens": []}
    assert len(bpe.Vocabulary.from_json(file).merges) == 2
    for merges in (["ab c", "a b"], ["a b", "a b"]):
        with pytest.raises(ValueError):
            bpe.Vocabulary.from_json({"model": {"vocab": vocab, "merges": merges}, "added_tokens": []})


def test_bpe_and_pii_columns_may_clash(spark, vocabulary):
    docs = frame(spark, [(1, "mail a@b.co", "en", "s", 0)]).withColumns({"ids": F.lit("x"), "N_tokens": F.lit("y"), "spans": F.lit("z"), "pii": F.lit("p"), "decoded": F.lit("q")})
    coded = bpe.encode(docs, vocabulary[0])
    row = bpe.decode(coded, vocabulary[0]).first()
    assert (row.ids_in, row.decoded, row.decoded_in) == ("x", "mail a@b.co", "q")
    row = bpe.round_trip(docs, vocabulary[0], keep_ids=True).first()
    assert (row.ids_in, row["N_tokens_in"], row.n_tokens) == ("x", "y", len(row.ids))
    assert pii.report(docs).first().spans_in == "z" and pii.find_pii(docs).first().pii_in == "p"


def test_bpe_forgets_within_its_bound(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_SYMBOLS", 10)
    encoder = bpe.Encoder(vocabulary[0])
    for text in odd_texts()[:20]:
        assert encoder.encode([text])[0].tolist() == vocabulary[1].encode(text, add_special_tokens=False).ids


def test_bpe_holds_little_beside_the_ids(vocabulary):
    import tracemalloc
    encoder = bpe.Encoder(vocabulary[0])
    texts = ["one two three four five " * 100] * 2_000
    encoder.encode(texts[:1])
    tracemalloc.start()
    ids, offsets = encoder.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert offsets[-1] == len(ids) >= 1_000_000 and peak < 32 * len(ids)


def test_bpe_merges_alike_in_slices(vocabulary, monkeypatch):
    texts = [f"slices of {i * i} words {'ab' * (i % 7)}" for i in range(50)]
    whole = bpe.Encoder(vocabulary[0]).encode(texts)
    monkeypatch.setattr(bpe, "SLICE", 3)
    for a, b in zip(whole, bpe.Encoder(vocabulary[0]).encode(texts)):
        assert a.tolist() == b.tolist()


def test_bpe_frames(spark, vocabulary):
    docs = frame(spark, [(1, None, "en", "s", 0), (2, "hello world", "en", "s", 0), (2, "hello world", "en", "s", 0)])
    coded = bpe.encode(docs, vocabulary[0])
    back = bpe.decode(coded, vocabulary[0]).collect()
    assert {(r.doc_id, r.decoded) for r in back} == {(1, ""), (2, "hello world")} and len(back) == 3
    trip = {r.doc_id: r for r in bpe.round_trip(docs, vocabulary[0]).collect()}
    ids = vocabulary[1].encode("hello world", add_special_tokens=False).ids
    assert trip[2].n_tokens == len(ids)
    assert trip[2].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert trip[1].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.round_trip(empty(spark), vocabulary[0]).count() == 0


# 3 PII --------------------------------------------------------------------

BASE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    checks = {"email": lambda m, d: True, "ip": lambda m, d: all(int(x) <= 255 for x in m.split(".")),
              "card": lambda m, d: 16 <= len(d) <= 19 and sum(
                  sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0,
              "phone": lambda m, d: 8 <= len(d) <= 15}
    return [(k, *m.span()) for k, p in BASE_PATTERNS.items() for m in re.finditer(p, text)
            if checks[k](m[0], re.sub("[^0-9]", "", m[0]))]


def test_pii_base_spans_match_the_plain_patterns():
    rng = random.Random(2)
    alphabets = ["ab@.-_+ 1", "0123 -.+()", "a@b.c_%+-é", "19.25 0.", "+1(23) -45678", "4111 "]
    for _ in range(20_000):
        text = "".join(rng.choices(rng.choice(alphabets), k=rng.randint(0, 50)))
        assert base_spans(text) == [tuple(s)[:3] for s in pii.find(text) if s.kind in pii.BASE], text


def test_pii_added_kinds_and_context():
    kinds = lambda t: [s.kind for s in pii.find(t)]
    assert kinds("pay DE89 3704 0044 0532 0130 00 now") == ["iban"]
    assert kinds("pay DE88 3704 0044 0532 0130 00 now") == []
    assert kinds("ssn 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert kinds("amex 378282246310005") == ["card_short"] and kinds("number 378282246310005") == []
    assert kinds("é card 4111 1111 1111 1111") == ["card"]
    near, far = pii.find("call +1 (555) 123-4567")[0], pii.find("order +1 (555) 123-4567")[0]
    assert near.score > far.score


def test_pii_frames(spark):
    docs = frame(spark, [(1, None, "en", "s", 0), (2, "é a@b.co 1.2.3.4", "en", "s", 0), (3, "", None, None, 0)])
    out = {r.doc_id: r for r in pii.report(docs).collect()}
    assert out[2].spans == "email:2:8,ip:9:16" and (out[2].n_email, out[2].n_ip, out[2].n_card, out[2].n_phone) == (1, 1, 0, 0)
    assert out[2].base_sha256 == hashlib.sha256(b"email:2:8,ip:9:16").hexdigest() and out[1].spans == ""
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean == {1: None, 2: "é [EMAIL] [IP]", 3: ""}
    assert [s.kind for s in pii.find_pii(docs).filter("doc_id = 2").first().pii] == ["email", "ip"]
    assert pii.report(empty(spark)).count() == 0


@pytest.mark.parametrize("text", ["a" * 200_000, "1" * 200_000, "+1" + "(" * 200_000, "a@" * 100_000, "1 " * 100_000])
def test_pii_is_linear_on_long_runs(text):
    assert pii.find(text) == []


# 4 quality ----------------------------------------------------------------

def brute_kneser_ney(train, texts):
    pairs = Counter()
    for t in train:
        words = t.split()
        pairs.update(zip([None, *words], words))
    d = quality._discounts(Counter(pairs.values()))
    follows, of = Counter(w for _, w in pairs), lambda n, x: x[min(n, 3) - 1]
    e = quality._discounts(Counter(follows.values()))
    types, ctx = len(pairs), Counter()
    freed = sum(of(k, e) for k in follows.values())
    floor = freed / types / (len(follows) + 1)
    p1 = lambda w: (follows[w] - of(follows[w], e)) / types + floor if w in follows else floor
    left = Counter()
    for (v, _), n in pairs.items():
        ctx[v] += n
        left[v] += of(n, d)
    out = []
    for t in texts:
        words, total = t.split(), 0.0
        for v, w in zip([None, *words], words):
            lower = (left[v] / ctx[v] if v in ctx else 1.0) * p1(w)
            n = pairs.get((v, w), 0)
            total += math.log((n - of(n, d)) / ctx[v] + lower if n else lower)
        out.append(math.exp(-total / len(words)) if words else None)
    return out


@pytest.mark.parametrize("hot, shard, chunk", [(0, 1 << 19, 1 << 21), (3, 5, 200), (100_000, 5, 1)])
def test_perplexity_matches_brute_force(spark, monkeypatch, hot, shard, chunk):
    for name, value in (("HOT", hot), ("SHARD_ENTRIES", shard), ("CHUNK_WORDS", chunk)):
        monkeypatch.setattr(quality, name, value)
    rows = corpus()                                            # with texts that are null, empty and very long
    train = [r for r in rows if r[0] % 2 and r[1]]
    model = quality.train(frame(spark, train).select("text"))
    got = {r.doc_id: r.perplexity for r in quality.perplexity(
        frame(spark, [(r[0], r[2], (r[1] or "") + " unseen" * (r[0] % 4 == 0)) for r in rows],
              "doc_id long, lang string, text string"), model).collect()}
    want = brute_kneser_ney([r[1] for r in train], [(r[1] or "") + " unseen" * (r[0] % 4 == 0) for r in rows])
    for r, w in zip(rows, want):
        assert got[r[0]] == pytest.approx(w) if w is not None else got[r[0]] is None


def test_quality_keeps_clean_and_drops_junk(spark):
    rng = random.Random(4)
    clean = [(i, " ".join(rng.choices(WORDS, k=80)), "en", "s", 0) for i in range(120)]
    junk = [(1000 + i, " ".join(w + "$$$" for w in rng.choices(WORDS, k=80)), "en", "s", 0) for i in range(10)]
    trusted = spark.createDataFrame([(i,) for i in [*range(100), 5, None]], "id long")
    rows = [*clean, *junk, (2000, None, None, None, None), (2001, "", "xx", None, 0), (None, "alpha beta", "en", "s", 0)]
    out = quality.judge(frame(spark, rows), trusted).collect()
    assert len(out) == len(rows)
    kept = {r.doc_id for r in out if r.kept}
    assert not kept & set(range(1000, 2002)) and len(kept & set(range(120))) >= 118
    none = quality.judge(frame(spark, clean[:3]), trusted.filter("id < 0")).collect()
    assert [r.kept for r in none] == [False] * 3
    assert quality.judge(empty(spark), trusted).count() == 0


def test_quality_thresholds_of_a_rare_language(spark):
    """A large language leaves a small one its threshold, taken over all trusted rows that train nothing."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(WORDS if i % 20 else ["uno", "dos", "tres"], k=40)), "en" if i % 20 else "xx", "s", 0)
            for i in range(800)]
    trusted = spark.createDataFrame([(i,) for i in range(800)], "id long")
    out = quality.judge(frame(spark, rows), trusted, max_trusted=60, shrink=0.0).collect()
    slack = math.exp(4 / math.sqrt(40))
    limits = {lang: {round(r.threshold / slack, 9) for r in out if r.lang == lang} for lang in ("en", "xx")}
    assert all(len(x) == 1 for x in limits.values()) and limits["en"] != limits["xx"]
    # some 20 rows of a language train, so few of the large one lie beyond a quantile over the rest
    limit, = limits["en"]
    assert 0 < sum(r.perplexity / slack > limit + 1e-6 for r in out if r.lang == "en") <= 12
    for lang, (limit,) in limits.items():
        assert any(r.perplexity / slack == pytest.approx(limit) for r in out if r.lang == lang)
    # between the language's own quantile and that of all, nearer to the latter the fewer documents there are
    near = {r.lang: r.threshold / slack for r in quality.judge(frame(spark, rows), trusted, max_trusted=60, shrink=50.0).collect()}
    far = {r.lang: r.threshold / slack for r in quality.judge(frame(spark, rows), trusted, max_trusted=60, shrink=1e9).collect()}
    assert far["en"] == pytest.approx(far["xx"])
    own = {lang: limit for lang, (limit,) in limits.items()}
    for lang in own:
        assert min(own[lang], far[lang]) - 1e-9 <= near[lang] <= max(own[lang], far[lang]) + 1e-9
    assert abs(math.log(near["xx"] / far["xx"])) < abs(math.log(own["xx"] / far["xx"])) / 2
    assert quality._quota([(3, 2), (100, 1)], 30) == 24 and quality._quota([(3, 2)], 30) == math.inf


def test_pieces_hand_free_memory_back():
    import pyarrow as pa
    from uaspark.llm import texts
    held = lambda: int(open("/proc/self/statm").read().split()[1]) * 4 // 1024  # noqa: E731, SIM115
    batch = pa.RecordBatch.from_pydict({"text": ["word " * 20] * 1000})
    begun = held()
    for piece in texts.pieces(iter([batch] * 3), "text", 20_000):
        freed = [bytes(1000) for _ in range(100_000)]           # some 100 MB in small parts, with one of them kept above
        kept = bytes(1000)
        del freed
    assert len(piece) and len(kept) == 1000 and held() - begun < 40


def test_quality_query_learns_from_all_trusted_rows(spark, monkeypatch, tmp_dir):
    from uaspark.llm import queries
    docs = spark.range(16_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("alpha beta"), F.col("id") % 50).alias("text"),
                                      F.lit("en").alias("lang"))
    docs.write.parquet(f"{tmp_dir}/documents.parquet")
    docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_dir}/labels.parquet")
    seen, train = [], quality.train
    monkeypatch.setattr(quality, "train", lambda rows: seen.append(rows.count()) or train(rows))
    assert queries.QUERIES["op4_quality"](spark, tmp_dir).count() == 16_000
    fold = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)) < 2).count()
    assert seen == [fold] and fold > 10_000                     # two thirds of all, not of a sample


def test_tables_of_the_training_go_and_the_model_stays(spark):
    with Scratch(spark) as outer:
        model = quality.train(frame(spark, [r for r in corpus() if r[1]]).select("text"))
        assert len(outer.paths) == 1 and model.table.count() == model.entries > 0


def test_scores_come_through_the_sharded_join(spark):
    model = quality.train(frame(spark, [r for r in corpus() if r[1]]).select("text"))
    docs = spark.createDataFrame([(1, "en", "alpha beta")], "doc_id long, lang string, text string")
    plan = quality.perplexity(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and plan.count("hashpartitioning(shard") == plan.count("hashpartitioning(of") == 1
    assert inspect.signature(quality.judge).parameters["max_trusted"].default == 10_000


def test_the_model_travels_packed_and_once_for_short_texts(spark):
    rng = np.random.default_rng(3)
    g, value = rng.integers(-1 << 63, 1 << 63, 40_000), rng.normal(size=40_000)
    cold = spark.createDataFrame(pa.table({"g": g, "value": value})).coalesce(1)
    rows = quality._packed_shards(cold, 3).collect()
    found = {}
    for r in rows:
        keys = quality._unpack_sorted(r.g)
        assert (keys >> np.uint64(61) == r.of).all()
        found.update(zip(keys.view(np.int64).tolist(), quality._unpack(r.value, np.float64).tolist()))
    assert found == dict(zip(g.tolist(), value.tolist()))
    assert sum(len(r.g) + len(r.value) for r in rows) < 15 * len(g)       # single rows of the shuffle took 21 bytes
    model = quality.train(frame(spark, [r for r in corpus() if r[1]]).select("text"))
    docs = spark.range(600_000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("a b").alias("text"))
    assert "sequence(0, 0," in quality.perplexity(docs, model)._jdf.queryExecution().analyzed().toString()


def test_large_tables_are_scored_in_rounds(spark, monkeypatch):
    rows = corpus()
    model = quality.train(frame(spark, [r for r in rows if r[0] % 2 and r[1]]).select("text"))
    docs = frame(spark, [*((r[0], r[2], r[1]) for r in rows), *[(None, None, "alpha beta")] * 3], "doc_id long, lang string, text string")
    columns = lambda df: sorted(((r.doc_id, r.lang, r.n_words, r.perplexity) for r in df.collect()), key=repr)
    once = columns(quality.perplexity(docs, model))
    monkeypatch.setattr(quality, "ROUND_CHARS", 100)
    seen, of_round = [], quality._round
    monkeypatch.setattr(quality, "_round", lambda part, chars, packed: seen.append(part.count()) or of_round(part, chars, packed))
    out = quality.perplexity(docs, model)
    assert len(seen) == quality.ROUNDS and max(seen) < sum(seen) == len(rows) + 3
    assert out.select("row").distinct().count() == len(rows) + 3
    assert [x[:3] for x in columns(out)] == [x[:3] for x in once]
    assert [x[3] for x in columns(out)] == [x[3] if x[3] is None else pytest.approx(x[3]) for x in once]


def test_judging_leaves_one_table_and_the_setting(spark, tmp_dir):
    """The model, its shards and the rounds go; so do the shuffle files, while the judging lasts."""
    from uaspark.llm.store import brief_shuffles
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    docs, trusted = frame(spark, corpus()), spark.range(40)
    with Scratch(spark) as outer:
        out = quality.judge(docs, trusted, max_trusted=None)
        assert len(outer.paths) == 1 and out.count() == len(corpus())
    with pytest.raises(ValueError), brief_shuffles(spark):
        assert spark.conf.get(key) == "true"
        raise ValueError
    assert spark.conf.get(key) == before


def test_bloom_filter_of_whole_tasks(spark):
    from uaspark.llm import bloom
    keys = spark.range(5000).select(F.when(F.col("id") > 0, F.xxhash64("id")).alias("k")).repartition(3)
    assert (bloom.build(keys, "k", 5000) == bloom.build(keys, "k", 5000, whole=True)).all()
    assert len(bloom.build(keys, "k", 5000, 8, whole=True)) * 2 == len(bloom.build(keys, "k", 5000))


def test_pairs_of_several_batches_travel_once():
    part = tuple(np.array(x, np.uint64) for x in ([7, 9], [1, 2], [3, 4])) + (np.array([5, 6]),)
    assert quality._combined([part, part]).to_pydict() == {"v": [1, 2], "w": [3, 4], "n": [10, 12]}
    nothing = tuple(x[:0] for x in part)
    assert quality._combined([nothing]).num_rows == 0


def test_sorted_values_travel_as_differences():
    values = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2))
    for x in (values, values[:1], values[:0]):
        assert quality._unpack_sorted(quality._pack_sorted(x)).tolist() == x.tolist()


# 5 language ID ------------------------------------------------------------

def test_language_id_on_held_out_texts(spark):
    rng = random.Random(6)
    words = {"aa": ["the", "of", "thing", "ing", "ton"], "bb": ["le", "eau", "ère", "été", "eux"]}
    make = lambda lang: " ".join("".join(rng.choices(words[lang], k=rng.choice([1, 1, 2, 3]))) for _ in range(15))
    rows = [(i, make(lang), lang, "s", 0) for i in range(200) for lang in [rng.choice(["aa", "bb"])]]
    odd = [(900, None, "aa", "s", 0), (901, "", "aa", "s", 0), (902, "123 !!", "bb", "s", 0), (903, "éteau", None, "s", 0),
           (None, "le eau", "bb", "s", 0), (904, "語語", "aa", "s", 0)]
    model = langid.train(frame(spark, rows + odd).filter(langid.fold() != 2))
    out = langid.predict(frame(spark, rows + odd).withColumnRenamed("lang", "lang_before"), model, keep_text=False).collect()
    got = {r.doc_id: r for r in out}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert held and all(got[r[0]].lang_pred == r[2] for r in held)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred == "bb"
    assert got[904].lang_pred in ("aa", "bb") and all(0 <= r.score <= 1 for r in out)
    blank = langid.train(empty(spark))
    assert {r.lang_pred for r in langid.predict(frame(spark, rows[:3]), blank).collect()} == {"und"}
    assert langid.predict(empty(spark), model).count() == 0


def test_a_rare_language_keeps_its_words_and_ngrams(spark):
    """Few rows of a script of its own beside large languages that share the bound."""
    rng = random.Random(8)
    words = {lang: ["".join(rng.choices(letters, k=4)) for _ in range(30)]
             for lang, letters in (("aa", "abcdef"), ("bb", "ghijkl"), ("zz", "αβγδεζ"))}
    make = lambda lang: " ".join(rng.choices(words[lang], k=15))
    rows = [(i, make(lang), lang, "s", 0) for i in range(203) for lang in ["zz" if i >= 200 else "aa" if i % 2 else "bb"]]
    model = langid.train(frame(spark, rows), max_words=20, max_grams=40)
    (lang, score), = langid.Scorer(model).predict([make("zz")])
    assert lang == "zz" and score > 0.99
    again = pickle.loads(pickle.dumps(model))
    assert langid.Scorer(again).predict([r[1] for r in rows]) == langid.Scorer(model).predict([r[1] for r in rows])
    of = Counter(model.words.langs.tolist())
    assert all(of[i] >= 18 for i in range(3)) and len(model.words.keys) <= 3 * 24 and len(model.grams.keys) <= 3 * 48


def test_many_languages_keep_their_accuracy(spark):
    """300 labels, one of them of a third of all rows: no model of languages squared."""
    rng = random.Random(5)
    words = [["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(12)] for _ in range(300)]
    make = lambda i: " ".join(rng.choices(words[i], k=12))
    rows = [(k, make(i), f"l{i:03d}", "s", 0) for k, i in enumerate([i for i in range(300) for _ in range(6)] + [0] * 900)]
    model = langid.train(frame(spark, rows).filter(langid.fold() != 2))
    assert len(model.languages) == 300 and len(model.words.langs) < 300 * 20
    out = langid.predict(frame(spark, rows).withColumnRenamed("lang", "truth").filter(langid.fold() == 2), model).collect()
    assert len(out) > 500 and sum(r.lang_pred == r.truth for r in out) / len(out) > 0.98


def brute_language(rows, texts):
    """Word-first backoff with every word and n-gram, counted in plain dictionaries."""
    languages = sorted({r[1] for r in rows})
    words = lambda t: regex.findall(r"\p{L}[\p{L}\p{M}]*", t.lower())
    grams = lambda w, n: list(w) if n == 1 else [f"<{w}>"[i:i + n] for i in range(len(w) + 3 - n)]
    word, gram = Counter(), Counter()
    for text, lang in rows:
        for w in words(text):
            word[w, lang] += 1
            gram.update((g, lang) for n in range(1, 6) for g in grams(w, n))

    def logs(counts):
        items = {k[0] for k in counts}
        total = {x: sum(n for (_, y), n in counts.items() if x == y) for x in languages}
        return lambda item: [math.log((counts[item, x] + 0.5) / (max(1, total[x]) + 0.5 * len(items))) for x in languages], items
    word_log, known_words = logs(word)
    gram_log, known_grams = logs(gram)
    out = []
    for text in texts:
        own, total = words(text or ""), [0.0] * len(languages)
        for w in own:
            add = word_log(w) if w in known_words else None
            for n in range(5, 0, -1):
                hits = [gram_log(g) for g in grams(w, n) if g in known_grams] if add is None else []
                if hits:
                    add = [sum(x) / len(hits) for x in zip(*hits)]
            total = [a + b for a, b in zip(total, add or [0.0] * len(languages))]
        best = max(range(len(languages)), key=lambda i: (total[i], -i))
        out.append((languages[best], 1 / sum(math.exp(t - total[best]) for t in total)) if own else ("und", 0.0))
    return out


def test_language_scores_equal_brute_force(spark):
    rng = random.Random(7)
    letters = ["abcde", "bcdéf", "нсте", "कािनम"]
    make = lambda x: " ".join("".join(rng.choices(x, k=rng.randint(1, 6))) for _ in range(rng.randint(0, 12)))
    rows = [(make(x), lang) for _ in range(40) for lang, x in zip(["a", "b", "c", "d"], letters)]
    model = langid.train(frame(spark, [(i, t, lang, "s", 0) for i, (t, lang) in enumerate(rows)]))
    texts = [make("".join(rng.sample(letters, 2))) for _ in range(120)] + ["½ ² Ⅳ 12", None, "", "zzz qq", "x" * 100_000, "नमस्ते ½"]
    want = brute_language(rows, texts)
    for got, (lang, score) in zip(langid.Scorer(model).predict(texts), want):
        assert got[1] == pytest.approx(score, rel=1e-6) and (got[0] == lang or score < 0.5 + 1e-9)


def test_unseen_words_fall_back_to_shorter_ngrams():
    h = lambda g, n: int(langid.gram_hashes([g], n)[0][0])
    grams = langid.items_of([(h("abcx", 4), 0, 50), (h("x", 1), 1, 9)], [100, 100])      # "<abc" and "x"
    scorer = langid.Scorer(langid.LanguageModel(["a", "b"], langid.items_of([], [0, 0]), grams))
    first, second, none = scorer.totals([["abcx"], ["xy"], ["qq"]])
    assert first[0] - first[1] == pytest.approx(math.log(50.5 / 0.5)) and second[1] - second[0] == pytest.approx(math.log(9.5 / 0.5))
    assert none.tolist() == [0.0, 0.0]


def test_numerals_are_no_letters_and_marks_belong_to_words(spark):
    assert langid.words_of("½ ² Ⅳ नमस्ते x1y") == ["नमस्ते", "x", "y"]
    model = langid.train(frame(spark, [(1, "abc", "en", "s", 0), (2, "नमस्ते", "hi", "s", 0)]))
    out = langid.predict(frame(spark, [(1, "½ ² Ⅳ", "en", "s", 0), (2, "नमस्ते", "x", "s", 0)]).withColumn("LANG_pred", F.lit("mine")), model)
    got = {r.doc_id: r for r in out.collect()}
    assert (got[1].lang_pred, got[1].score, got[2].lang_pred, got[1]["LANG_pred_in"]) == ("und", 0.0, "hi", "mine")


# 6 n-gram join ------------------------------------------------------------

def brute_components(rows):
    sets = {}
    for i, t, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = ({tuple(words[j:j + 5]) for j in range(len(words) - 4)} if len(words) >= 5
                   else {tuple(words)} if words else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_corpus(seed):
    """Families of texts around the threshold, with long chains and a shared passage."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocab, k=12)
    rows = []
    for _ in range(8):
        words = rng.choices(vocab, k=rng.randint(30, 90))
        for _ in range(rng.randint(1, 9)):
            words = list(words)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(words + passage * (rng.random() < 0.5)), "en", "s", 0))
    return rows + [(len(rows) + i, t, "en", "s", 0) for i, t in enumerate(
        [None, "", " \n", "one two", "ONE two", "one two three four five", rows[0][1].upper(), rows[0][1]])]


@pytest.mark.parametrize("seed,hot", [(1, 10_000), (2, 2), (3, 3)])
def test_components_match_brute_force(spark, seed, hot):
    rows = near_corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in ngram_join.near_duplicates(frame(spark, rows).withColumn("h", F.lit(0)), hot_rows=hot).collect()}
    assert got == brute_components(rows)


def test_members_out_of_reach_do_not_meet(spark):
    """A pair is linked at its first common shingle, so of two sets of 100 at most 11 may stand before it."""
    ranges = ngram_join._ranges(np.arange(100, dtype=np.uint64) << np.uint64(57), ngram_join.COARSE)
    nodes = spark.createDataFrame([(i, 100, bytearray(ranges)) for i in range(60)], "node long, n long, coarse binary")
    tried = spark.createDataFrame([(0, 1)], "a long, b long")

    def pairs(pos):
        rest = spark.createDataFrame([(7, i, 100, pos(i), i) for i in range(60)], "h long, node long, n int, pos int, root long")
        return sorted(tuple(r) for r in ngram_join._rest_pairs(rest, tried, nodes, 80).collect())

    assert pairs(lambda i: 12) == []
    assert pairs(lambda i: 11) == [p for p in itertools.combinations(range(60), 2) if p != (0, 1)]
    assert pairs(lambda i: 11 if i < 4 else 12) == [(0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]


@pytest.mark.parametrize("seed,hot", [(4, 10_000), (5, 20)])
def test_a_large_family_matches_brute_force(spark, seed, hot):
    """Copies of one text with few to many changes: linked to each other, to the text, or to none."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(300)}" for _ in range(120)]
    rows = []
    for i in range(120):
        copy = list(words)
        for k in rng.sample(range(120), rng.randint(1, 12)):
            copy[k] = f"v{rng.randrange(5000)}"
        rows.append((i, " ".join(copy), "en", "s", 0))
    expected = brute_components(rows)
    assert 5 < len({c for _, c in expected.values()}) < 115
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(frame(spark, rows), hot_rows=hot).collect()}
    assert got == expected


@pytest.mark.parametrize("counts", [[0, 3, 0, 70_000], [1] * ngram_join.BLOCK, [300] * 9])
def test_block_counts_survive_packing(counts):
    block = np.zeros(ngram_join.BLOCK, np.uint32)
    block[-len(counts):] = counts
    assert ngram_join._unpacked(ngram_join._pack(block)).tolist() == block.tolist()


def test_near_duplicate_edge_cases(spark):
    assert ngram_join.near_duplicates(empty(spark)).count() == 0
    rows = [(7, "a b c d e f", "en", "s", 0)] * 2 + [(None, "a b c d e f", "en", "s", 0), (9, None, None, None, None)]
    out = ngram_join.near_duplicates(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.component_id) for r in out) == Counter({(7, 7): 2, (None, 7): 1, (9, 9): 1})
    assert sorted(r.doc_id for r in ngram_join.survivors(frame(spark, rows[1:])).collect()) == [7, 9]


def test_rows_without_an_id_link_near_copies(spark):
    """a and c are linked only through a text that no row with an id has; two such texts link too."""
    make = lambda *changed: " ".join("x" if i in changed else f"w{i}" for i in range(70))
    other = [" ".join(f"v{i}" for i in range(n)) for n in (60, 61)]
    rows = [(1, make(10), "en", "s", 0), (None, make(), "en", "s", 0), (3, make(35), "en", "s", 0),
            (None, other[0], "en", "s", 0), (None, other[1], "en", "s", 0), (8, "a b c d e f", "en", "s", 0)]
    sets = [{tuple(t.split()[j:j + 5]) for j in range(66)} for t in (make(10), make(), make(35))]
    near = lambda x, y: 100 * len(x & y) >= 80 * len(x | y)
    assert near(sets[0], sets[1]) and near(sets[1], sets[2]) and not near(sets[0], sets[2])
    out = ngram_join.near_duplicates(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.component_id) for r in out) == Counter({(1, 1): 1, (None, 1): 1, (3, 1): 1, (None, None): 2, (8, 8): 1})


def test_survivors_are_judged_row_by_row(spark):
    """Unrelated rows that share an id, or have none, decide nothing."""
    text = " ".join(WORDS * 3)
    near, other = text + " tail", "quite another text of seven words here"
    rows = [(1, text), (None, near), (None, other), (5, near + " again"), (5, "a third text that has its own seven words"),
            (9, "x y z"), (9, "x y z"), (9, "x  y z"), (None, None), (4, " "), (4, "")]
    df = frame(spark, [(i, t, "en", "s", 0) for i, t in rows]).withColumns(
        {"tag": F.lit("a"), "root": F.lit("b"), "ID": F.lit("c"), "m": F.create_map(F.lit(1), F.lit(2))})
    out = ngram_join.survivors(df)
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    alike = [g for g in got if g[0] == 9]
    assert len(alike) == 1 and alike[0][1] in ("x y z", "x  y z")
    assert [g for g in got if g[0] != 9] == sorted([rows[i] for i in (0, 2, 4, 8, 9, 10)], key=str)
    assert out.columns == df.columns and out.first().tag == "a"
    nameless = ngram_join.survivors(frame(spark, [(None, t, "en", "s", 0) for t in (text, near, other)])).collect()
    assert len(nameless) == 2 and other in {r.text for r in nameless}
    assert ngram_join.survivors(empty(spark)).count() == 0


def test_scratch_drops_what_was_stored_inside(spark):
    import os

    from uaspark.llm.store import Scratch, stored, write_table
    with Scratch(spark) as outer:
        first = write_table(spark.range(3))
        with Scratch(spark) as inner:
            gone = stored(spark.range(5))
            assert gone.count() == 5
            kept = inner.keep(write_table(spark.range(7)))
        local = [p.removeprefix("file:") for p in (*inner.paths, kept, first)]
        assert [os.path.exists(p) for p in local] == [False, True, True]
    assert not os.path.exists(first.removeprefix("file:")) and spark.read.parquet(kept).count() == 7 and outer.paths == [first]


def test_connected_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (7, 6)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


# 7 mixing -----------------------------------------------------------------

def test_plan_meets_entropy_and_repetition():
    tokens = {"a": 6400, "b": 1600, "c": 1000, "d": 1000}
    p = mixing.plan(tokens, target_entropy=0.9, max_epochs=100)
    assert mixing.entropy(p.weights) == pytest.approx(0.9 * math.log(4), abs=1e-6) and min(p.epochs.values()) == pytest.approx(1)
    p = mixing.plan(tokens, target_entropy=1.0, max_epochs=2.0)
    assert max(p.epochs.values()) == pytest.approx(2.0, abs=1e-6)
    assert p.weights["a"] / p.weights["c"] == pytest.approx(6.4 ** p.exponent)
    assert mixing.plan({"a": 5}).epochs == {"a": pytest.approx(1.0)}


@pytest.mark.parametrize("budget", [None, 3000.0])
def test_mixture_meets_its_budgets(spark, budget):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 20))), "en", rng.choice(["big"] * 6 + ["x", "y", None, ""]), 0)
            for i in range(1500)]
    docs = frame(spark, rows)
    out = mixing.mix(docs, budget=budget, max_epochs=3.0, rows_per_block=100).collect()
    size = lambda t: len((t or "").split()) + 1
    tokens = Counter()
    for r in rows:
        tokens[r[3]] += size(r[1])
    key = lambda s: "-" if s is None else "+" + s
    chosen = mixing.plan({key(s): n for s, n in tokens.items()}, max_epochs=3.0, budget=budget)
    got = Counter()
    for r in out:
        got[r.source] += size(r.text)
    for s in tokens:
        want = chosen.epochs[key(s)] * tokens[s]
        assert want - 21 <= got[s] <= want + 1e-6 * want
    times = Counter(r.doc_id for r in out)
    assert max(times.values()) <= 3 and (budget or set(times) == set(range(1500)))
    assert len({(r.doc_id, r.epoch) for r in out}) == len(out)
    blocks = {}
    for r in out:
        blocks.setdefault(r.block, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in blocks.values())


def test_mixing_edge_cases(spark):
    assert mixing.mix(empty(spark)).count() == 0
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "s", 0)]
    out = mixing.mix(frame(spark, rows).withColumns({"_other": F.lit(1), "Block": F.lit("mine"), "epoch": F.lit("e")}))
    assert {(r.doc_id, r["Block_in"], r.epoch_in) for r in out.collect()} == {(1, "mine", "e"), (None, "mine", "e")}
    assert out.columns[-3:] == ["epoch", "block", "slot"] and "_other" in out.columns
    long = [(0, "word " * 300_000, "en", "s", 0), (1, "a b", "en", "s", 0), (2, "c", "en", "t", 0)]
    assert {r.doc_id for r in mixing.mix(frame(spark, long), max_epochs=1e6).collect()} == {0, 1, 2}


@pytest.mark.parametrize("few", [100_000, 0])
def test_every_block_carries_every_source_in_proportion(spark, few, monkeypatch):
    """Many blocks, tables joined by broadcast and by shuffle, runs of a few cells."""
    monkeypatch.setattr(mixing, "RUN", 8)
    rng = random.Random(12)
    rows = [(i, "w " * rng.randint(0, 8), "en", rng.choices("abcd", [60, 25, 10, 5])[0], 0) for i in range(12_000)]
    out = mixing.mix(frame(spark, rows), rows_per_block=400, few=few).collect()
    size = lambda t: len(t.split()) + 1
    blocks, overall = {}, Counter()
    for r in out:
        blocks.setdefault(r.block, Counter())[r.source] += size(r.text)
        overall[r.source] += size(r.text)
    assert len(blocks) > 30 and set(blocks) == set(range(len(blocks)))
    for own in blocks.values():
        for s in "abcd":
            share = overall[s] / len(blocks)
            # a cell (1/32 of a share) or a row more or less at either end
            assert abs(own[s] - share) <= share / 16 + 2 * 9 + 9, (s, own[s], share)
    assert {r.doc_id for r in out} == set(range(12_000))
    for s in "abcd":
        passes = Counter(r.doc_id for r in out if r.source == s)
        assert max(passes.values()) - min(passes.values()) <= 1


def test_more_sources_than_a_broadcast_holds(spark):
    rows = [(i, "x y z", "en", f"s{i % 300}" if i % 3 else "hot", 0) for i in range(1500)]
    plain, spread = (sorted(tuple(r) for r in mixing.mix(frame(spark, rows), few=few).collect()) for few in (10_000, 10))
    assert plain == spread and {r[0] for r in plain} == set(range(1500))


def test_exponent_by_aggregates_equals_the_plan(spark):
    rng = random.Random(3)
    for target, most, budget in ((0.9, 100.0, None), (1.0, 2.0, None), (0.7, 3.0, 5000.0)):
        tokens = {f"s{i}": rng.randint(1, 10 ** rng.randint(1, 6)) for i in range(40)}
        chosen = mixing.plan(tokens, target, most, budget)
        a, size, raised = mixing.exponent_for(spark.createDataFrame(list(tokens.items()), "_src string, tokens long"), target, most, budget)
        assert a == pytest.approx(chosen.exponent, abs=1e-9) and size == pytest.approx(chosen.budget)
        weights = {s: (n / sum(tokens.values())) ** a / raised for s, n in tokens.items()}
        assert weights == pytest.approx(chosen.weights, rel=1e-9)


# 8 exact dedup ------------------------------------------------------------

@pytest.mark.parametrize("weak", [False, True])
def test_copy_classes_match_brute_force(spark, weak):
    rows = [*corpus(), (None, "alpha", "en", "s", 0), (500, "alpha", "en", "s", 0), (None, "only null id", "en", "s", 0)]
    kw = {"digest": lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 7), 2, "0"))} if weak else {}
    got = exact_dedup.copy_classes(frame(spark, rows, parts=6), salts=3, **kw).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    want = Counter()
    for ids in groups.values():
        keep = max((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), i == keep) for i in ids)
    assert Counter((r.id, r.keep_id, r.group_size, r.kept) for r in got) == want


def test_exact_survivors(spark):
    rows = [(1, "a", "en", "s", 0), (2, "a", "fr", "s", 0), (3, None, None, None, 0), (4, "", "en", "s", 0),
            (5, "b", "en", "s", 0), (5, "b", "en", "s", 0), (6, "c", "en", "s", 0)]
    docs = frame(spark, rows).withColumn("digest", F.lit("clash"))
    out = exact_dedup.survivors(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [2, 4, 5, 6]
    assert exact_dedup.copy_classes(empty(spark)).count() == 0 and exact_dedup.survivors(empty(spark)).count() == 0


# 9 language-model scores --------------------------------------------------

def brute_backoff(rows, order, exclude):
    texts = {r[0]: re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").lower()) for r in rows}

    def grams(words):
        return Counter(tuple(words[i:i + k]) for k in range(1, order + 1) for i in range(len(words) - k + 1))

    per, n = {i: grams(w) for i, w in texts.items()}, sum(map(len, texts.values()))
    every = sum(per.values(), Counter())
    out = {}
    for i, words in texts.items():
        c = lambda g: every[g] - exclude * per[i][g]  # noqa: B023, E731
        below = max(1, n - exclude * len(words))
        total = 0.0
        for j in range(len(words)):
            for k in range(min(order, j + 1), 0, -1):
                g = tuple(words[j - k + 1:j + 1])
                if c(g) > 0:
                    total += math.log(c(g) / (c(g[:-1]) if k > 1 else below)) + (order - k) * math.log(0.4)
                    break
            else:
                total += order * math.log(0.4) - math.log(below)
        out[i] = (len(words), total)
    return out


@pytest.mark.parametrize("order,exclude", [(1, True), (2, True), (3, True), (2, False)])
def test_backoff_scores_match_brute_force(spark, order, exclude):
    rows = corpus(30) + [(99, "seen nowhere else", "en", "s", 0)]
    want = brute_backoff(rows, order, exclude)
    got = lm_score.score_documents(frame(spark, rows), order=order, exclude_own=exclude, docs_per_chunk=7, words_per_chunk=500).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_tokens == want[r.doc_id][0] and r.log_score == pytest.approx(want[r.doc_id][1])
        assert (r.mean_log_score is None) == (r.n_tokens == 0)
    assert lm_score.score_documents(empty(spark)).count() == 0


def test_a_chunk_is_scored_in_pieces_of_bounded_size(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(WORDS, k=rng.randrange(60))) for _ in range(4_000)] + [None, "", "a " * 500]
    table = pa.table({"chunk": [0] * len(texts), "doc_id": range(len(texts)), "text": texts})
    none = pa.table({"of": pa.array([], pa.int32()), "g": pa.array([], pa.binary()), "n": pa.array([], pa.binary())})
    whole, sizes, ngrams = {}, [], lm_score._own_counts
    monkeypatch.setattr(lm_score, "_own_counts", lambda g, doc: sizes.append(len(g)) or ngrams(g, doc))
    for at_once in (1 << 18, 300):
        monkeypatch.setattr(lm_score, "WORDS_AT_ONCE", at_once)
        sizes.clear()
        whole[at_once] = lm_score._score(table, none, 2, 0.4, 100_000, True)
        assert sum(sizes) == 2 * sum(len((t or "").split()) for t in texts)
    assert max(sizes) <= 500                                    # the one long document; the others 300 at most
    assert whole[300].equals(whole[1 << 18])


# 10 nearest neighbours ----------------------------------------------------

@pytest.mark.parametrize("dims,block", [(8, 16), (1500, 1000)])
def test_nearest_matches_brute_force(spark, monkeypatch, dims, block):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(90, dims)).astype(np.float32)
    base[40:60] = base[0]                      # ties
    base[70] *= 1e-6
    rows = [(i, v.tolist(), 1) for i, v in enumerate(base)]
    rows += [(200, None, 1), (220, [], 1), (240, [0.0] * dims, 1), (260, [float("nan")] * dims, 1),
             (280, [None] + [1.0] * (dims - 1), 1), (None, [1.0] * dims, 1), (300, [1.0, 2.0], 1), (0, rows[0][1], 2)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    for name, value in (("FAN_IN", 2), ("MERGED_QUERIES", 2)):   # several levels of merging
        monkeypatch.setattr(ann, name, value)
    got = ann.nearest(vectors, F.col("id") % 20 == 0, k=5, query_block=3, cand_block=block).collect()
    x = base.astype(float)
    want = []
    for q in range(0, 90, 20):
        # float products added from left to right (sum() compensates)
        scores = [(-functools.reduce(operator.add, (a * b for a, b in zip(x[q].tolist(), x[c].tolist()))), c)
                  for c in range(90) if c != q]
        want += [(q, r, c, -s) for r, (s, c) in enumerate(sorted(scores)[:5], 1)]
    assert sorted(tuple(r) for r in got) == want
    assert ann.nearest(vectors.limit(0), F.col("id") % 20 == 0).count() == 0


def test_merge_groups_are_bounded(spark, monkeypatch):
    """However many tiles there are, a group merges the heaps of FAN_IN of them for some MERGED_QUERIES queries."""
    monkeypatch.setattr(ann, "FAN_IN", 4)
    monkeypatch.setattr(ann, "MERGED_QUERIES", 8)
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 4)))], "vec_id long, embedding array<double>")
    plan = ann.nearest(df, F.col("id") % 2 == 0, k=3, query_block=50, cand_block=10)
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas") == 3     # 40 tiles, 10, 3, 1
    assert plan.count() == 200 * 3 and plan.groupBy("query_id").count().where("count <> 3").isEmpty()
