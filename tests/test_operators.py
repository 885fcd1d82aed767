"""Unit tests for the rows-only operators and the semantic traps (SURVEY Appendix A)."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from uaspark.functions import advice as ADV
from uaspark.functions.dates import parse_date
from uaspark.functions.money import parse_currency, parse_currency_or_percent
from uaspark.functions.naming import artifact_path, canonical_name, is_valid_name, model_name
from uaspark.operators import booster as BO
from uaspark.operators import clean as C
from uaspark.operators.ordered import dense_row_index, latest_per_key, running_total
from uaspark.operators.quantiles import exact_percentiles
from uaspark.sources import files as SRC
from uaspark.sources import registry as R


# ---- headers (P1-P5), fixture T4 -------------------------------------------

def test_padded_headers_keep_values(spark):
    df = spark.createDataFrame([("2024-01-01", 100, 123.45, 222.0), ("2024-01-02", 200, 67.89, 333.0)],
                               [" date ", "Installs", " cost ", " revenue "])
    out = C.normalize_ingest(df).orderBy("installs").collect()
    assert [r["cost"] for r in out] == [123.45, 67.89]
    assert [r["revenue"] for r in out] == [222.0, 333.0]
    assert [r["installs"] for r in out] == [100, 200]
    assert out[0]["date"] == dt.date(2024, 1, 1)


def test_sanitize_collisions_and_blanks():
    assert C.sanitized_names([" cost ", "cost", "", "ROAS D7", "a--b"]) == ["cost", "cost_2", "unnamed_2", "roas_d7", "a_b"]


def test_synonyms_first_wins_and_metric_headers(spark):
    df = spark.createDataFrame([(1.0, None, 3.0, 0.5, 40.0)],
                               "spend double, adspend double, revenue double, ROAS_D30 double, retention_rate_d7 double")
    out = C.map_synonyms(df)
    assert set(out.columns) >= {"cost", "revenue", "roas_d30", "retention_d7", "date", "installs"}
    assert out.columns.count("cost") == 1
    assert out.first()["cost"] == 1.0


def test_normalize_headers_first_duplicate(spark):
    df = spark.createDataFrame([(1, 2)], [" A", "a "])
    out = C.normalize_headers(df)
    assert out.columns == ["a"] and out.first()["a"] == 1


# ---- currency (P10 / P11, trap A.7) ----------------------------------------

@pytest.mark.parametrize("raw,p10,p11", [
    ("$1,234.56", 1234.56, 1234.56), ("12,50", 12.5, 1250.0), ("1,234", 1234.0, 1234.0), ("$-", 0.0, 0.0),
    ("-$5.00", -5.0, -5.0), ("", 0.0, 0.0), (None, 0.0, 0.0), ("31%", 31.0, 0.31), ("abc", 0.0, 0.0),
    ("€7", 7.0, 7.0),
])
def test_currency_dialects(spark, raw, p10, p11):
    df = spark.createDataFrame([(raw,)], "x string")
    r = df.select(parse_currency(F.col("x")).alias("a"), parse_currency_or_percent(F.col("x")).alias("b")).first()
    assert r["a"] == pytest.approx(p10)
    assert r["b"] == pytest.approx(p11)


# ---- naming (X20-X22), fixture T6 ------------------------------------------

def _name(spark, game, platform, channel, countries, start, end):
    df = spark.createDataFrame([(game, platform, channel, countries, start, end)],
                               "g string, p string, c string, k array<string>, s date, e date")
    return df.select(canonical_name(F.col("g"), F.col("p"), F.col("c"), F.col("k"), F.col("s"), F.col("e"))
                     .alias("n")).first()["n"]


def test_canonical_name_pieces(spark):
    n = _name(spark, "Test Game", "unity_ads", "android", ["United States"], dt.date(2024, 1, 1), dt.date(2024, 1, 31))
    assert "test_game" in n and "unity_ads" in n and "android" in n and "20240101-20240131" in n
    assert len(n) <= 80


def test_canonical_name_multi_and_missing(spark):
    n = _name(spark, "G", "unity_ads", "ios", ["US", "CA"], dt.date(2024, 1, 1), dt.date(2024, 1, 2))
    assert "_multi_" in n
    n2 = _name(spark, None, None, None, None, None, None)
    assert n2.endswith("_unknown") and len(n2) <= 80


def test_canonical_name_truncates_long_game(spark):
    n = _name(spark, "x" * 200, "p" * 40, "c" * 30, ["country"], dt.date(2024, 1, 1), dt.date(2024, 1, 2))
    assert len(n) <= 80


def test_name_validation_and_model_name(spark):
    df = spark.createDataFrame([("a_b_c_d",), ("a_b",), ("bad name_x_y_z",), ("",)], "n string")
    got = [r[0] for r in df.select(is_valid_name(F.col("n"))).collect()]
    assert got == [True, False, False, False]
    r = spark.range(1).select(model_name(F.lit(30), F.lit("unity_ads")).alias("m"),
                              artifact_path(F.lit("m"), F.lit(2)).alias("a")).first()
    assert r["m"] == "lgbm_roas_d30_unity_ads_quantile" and r["a"] == "artifacts/m/v2"


# ---- advice (X14 polarity trap A.2, X16) -----------------------------------

def test_advice_polarity_and_actions(spark):
    df = spark.createDataFrame([(0.3,), (-0.3,)], "gap double")
    doc = [r[0] for r in df.select(ADV.advice_tier(F.col("gap"))).collect()]
    flip = [r[0] for r in df.select(ADV.advice_tier(F.col("gap"), "below_target_is_bad")).collect()]
    assert doc[0].startswith("Scale aggressively") and doc[1].startswith("Cut")
    assert flip[0].startswith("Cut") and flip[1].startswith("Scale aggressively")
    acts = spark.createDataFrame([(1.6, 0.4), (1.6, 0.6), (0.7, 0.1), (0.2, 0.0)], "p double, w double")
    got = [r[0] for r in acts.select(ADV.campaign_action(F.col("p"), F.col("w"))).collect()]
    assert got == ["scale", "maintain", "reduce", "cut"]


# ---- distributed order / quantiles -----------------------------------------

def test_exact_percentiles_match_numpy_with_hot_group(spark):
    rng = np.random.default_rng(1)
    hot = [("hot", float(v)) for v in rng.normal(size=3000)]
    cold = [("cold", float(v)) for v in rng.integers(0, 5, size=200)]  # many ties
    df = spark.createDataFrame(hot + cold, "k string, v double")
    got = {r["k"]: r for r in exact_percentiles(df, ["k"], "v", [0.1, 0.5, 0.95], ["a", "b", "c"]).collect()}
    for k, vals in (("hot", [v for _, v in hot]), ("cold", [v for _, v in cold])):
        want = np.quantile(np.array(vals), [0.1, 0.5, 0.95])
        assert [got[k]["a"], got[k]["b"], got[k]["c"]] == pytest.approx(list(want))


def test_dense_row_index_and_running_total(spark):
    df = spark.createDataFrame([(i % 3, i, float(i)) for i in range(500)], "k long, o long, v double")
    idx = dense_row_index(df, ["o"]).orderBy("o").collect()
    assert [r["row_index"] for r in idx] == list(range(500))
    rt = {(r["k"], r["o"]): r["rt"] for r in running_total(df, ["k"], ["o"], "v", "rt").collect()}
    for k in range(3):
        acc = 0.0
        for o in range(k, 500, 3):
            acc += float(o)
            assert rt[(k, o)] == pytest.approx(acc)


def test_latest_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "k string, t long, id string")
    got = {r["k"]: r["id"] for r in latest_per_key(df, ["k"], ["t", "id"], ["id"]).collect()}
    assert got == {"a": "y", "b": "z"}


# ---- booster (M1 property tests) --------------------------------------------

def test_booster_coverage_and_loss(spark):
    rng = np.random.default_rng(7)
    x = rng.uniform(0, 1, size=2000)
    y = 2.0 + x + rng.normal(scale=0.5, size=2000)  # fixture T8 shape
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "feature_0 double, y double")
    base = BO.QuantileBooster(0.9, n_rounds=0).fit(df, ["feature_0"], "y")
    m = BO.QuantileBooster(0.9, n_rounds=4, max_depth=3, learning_rate=0.5).fit(df, ["feature_0"], "y")
    s0 = base.transform(df, "p")
    s = m.transform(df, "p")
    l0 = BO.pinball_loss(s0, "y", "p", 0.9).first()[0]
    l1 = BO.pinball_loss(s, "y", "p", 0.9).first()[0]
    assert l1 <= l0 + 1e-9
    cover = s.agg(F.avg((F.col("y") <= F.col("p")).cast("double"))).first()[0]
    assert 0.85 <= cover <= 0.95
    imp = m.feature_importances()
    assert set(imp) == {"feature_0"}


def test_leakage_guard():
    cols = ["roas_d1", "roas_d30", "retention_d7", "retention_rate_d30", "level_10_events", "cpi"]
    assert BO.leakage_safe_columns(cols, 30) == ["roas_d1", "retention_d7", "level_10_events", "cpi"]
    assert BO.leakage_safe_columns(cols, 30, strict=False) == ["roas_d1", "retention_d7", "retention_rate_d30",
                                                               "level_10_events", "cpi"]


# ---- sources (S1-S4, fixtures T1/T5) and registry (S5-S14) ------------------

def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_campaign_folder_scan(spark, tmp_dir):
    root = os.path.join(tmp_dir, "Campaign Data")
    _write(os.path.join(root, "Unity Ads", "Android", "Adspend and Revenue data.csv"),
           "country,day,installs,cost,ad_revenue,revenue\nUS,2024-01-01,10,5.0,1.0,2.0\n")
    _write(os.path.join(root, "Unity Ads", "iOS", "retention.csv"), "country,installs,retention_rate_d1\nUS,10,0.4\n")
    _write(os.path.join(root, "Mistplay", "Android", "template_demo.csv"), "a\n1\n")
    df = SRC.read_campaign_folder(spark, root)
    got = sorted((r["platform"], r["subdirectory"], r["data_type"]) for r in
                 df.select("platform", "subdirectory", "data_type").collect())
    assert got == [("Unity Ads", "Android", "adspend_revenue"), ("Unity Ads", "iOS", "retention")]


def test_folder_with_several_kinds_and_headers(spark, tmp_dir):
    """Kinds and header families differ; values must land under their own headers."""
    root = os.path.join(tmp_dir, "Campaign Data")
    _write(os.path.join(root, "Unity Ads", "Android", "Adspend and Revenue data.csv"),
           "country,day,installs,cost,ad_revenue,revenue\nUS,2025-01-09 00:00:00,10,$5.00,1.0,2.0\n")
    _write(os.path.join(root, "Mistplay", "Android", "Adspend & Revenue.csv"),
           "channel,day,installs, cost ,cost\nandroid,1/5/2024,3,$7.50,$-\n")
    _write(os.path.join(root, "Unity Ads", "iOS", "retention+ v2 .csv"), "country,installs,Retention_Rate_D1\nFR,10,31%\n")
    _write(os.path.join(root, "Mistplay", "Android", "ROAS data.csv"), "channel,installs,ROAS_D7\nandroid,4,0.25\n")
    _write(os.path.join(root, "Mistplay", "Android", "Level progression.csv"), "installs,level 10_events\n")
    every = SRC.read_campaign_folder(spark, root)
    assert every.count() == 4
    spend = {r["platform"]: r for r in SRC.read_kind(spark, root, "adspend_revenue").collect()}
    assert spend["Unity Ads"]["cost"] == "$5.00" and spend["Unity Ads"]["country"] == "US"
    assert spend["Mistplay"][" cost "] == "$7.50" and spend["Mistplay"]["cost"] == "$-"
    assert spend["Mistplay"]["channel"] == "android"
    kept = C.normalize_ingest(SRC.read_kind(spark, root, "retention")).first()
    assert kept["retention_d1"] == 0.31 and kept["installs"] == 10.0 and kept["country"] == "FR"
    assert C.normalize_ingest(SRC.read_kind(spark, root, "roas")).first()["roas_d7"] == 0.25
    days = {r["platform"]: r["date"] for r in C.normalize_ingest(SRC.read_kind(spark, root, "adspend_revenue")).collect()}
    assert days == {"Unity Ads": dt.date(2025, 1, 9), "Mistplay": dt.date(2024, 1, 5)}
    fin = C.hydrate_financials(SRC.read_kind(spark, root, "adspend_revenue").where("platform = 'Mistplay'")).first()
    assert fin["cost"] == 7.5 and fin["cost_raw"] == "$7.50"
    assert SRC.read_campaign_folder(spark, root, ["level_progression"]).count() == 0


def test_only_heads_of_wanted_files_are_read(spark, tmp_dir, monkeypatch):
    """The header pass reads a bounded head, whatever the length of a file, and only of the wanted kinds."""
    body = "1,2\n" * 200_000
    for name in ("adspend a.csv", "adspend b.csv", "retention.csv"):
        _write(f"{tmp_dir}/Net/ios/{name}", f"country,{name.split('.')[0]}\n" + body)
    _write(f"{tmp_dir}/Net/ios/retention wide.csv", ",".join(["country", "retention", *(f"{i}" + "x" * 8_000 for i in range(10))]) + "\r\n" + body)
    _write(f"{tmp_dir}/Net/ios/retention empty.csv", "")
    asked = []
    monkeypatch.setattr(SRC, "head_line", lambda s, p, _f=SRC.head_line: asked.append(p) or _f(s, p))
    files = {r.source_file: r for r in SRC.list_data_files(spark, tmp_dir, ["retention"]).collect()}
    assert set(files) == {"retention.csv", "retention wide.csv"} and len(asked) == 2 and all("retention" in a for a in asked)
    assert files["retention.csv"].header == "country,retention" and files["retention.csv"].platform == "Net"
    wide = files["retention wide.csv"].header
    assert wide.endswith("9" + "x" * 8_000) and len(wide) > SRC.HEAD_BYTES
    assert SRC.read_kind(spark, tmp_dir, "retention").count() == 400_000


def test_heads_are_all_that_the_header_pass_reads(spark, tmp_dir):
    path = f"{tmp_dir}/n/c/roas.csv"
    _write(path, "a,b\n" + "x" * 5_000_000)
    fs = spark._jvm.org.apache.hadoop.fs.FileSystem
    fs.clearStatistics()
    SRC.list_data_files(spark, tmp_dir).collect()
    read = sum(s.getBytesRead() for s in fs.getAllStatistics())
    assert 0 < read <= 2 * SRC.HEAD_BYTES


def test_header_line_rules():
    assert SRC.header_names('\ufeffa,"b, c",A,a') == ["a", "b, c", "A__2", "a__3"]


def test_file_choice_by_name(spark):
    files = spark.createDataFrame([("Data.csv",), ("data.xlsx",), ("other.csv",)], "source_file string")
    pick = lambda name: sorted(r[0] for r in SRC.best_name_match(files, name).collect())
    assert pick("Data.csv") == ["Data.csv"] and pick("data.csv") == ["data.xlsx"]
    assert pick("OTHER.txt") == ["other.csv"] and pick("none") == []


def test_headers_that_differ_in_case(spark):
    df = spark.createDataFrame([("0", "$1,000", "9"), ("0", "$2,000", "9")], "a string, b string, c string").toDF("cost", "Cost", " x ")
    assert C.normalize_headers(df).columns == ["cost", "x"] and C.normalize_headers(df).first()["cost"] == "0"
    assert C.sanitize_headers(df).columns == ["cost", "cost_2", "x"]
    assert sorted(r["cost"] for r in C.hydrate_financials(df).collect()) == [1000.0, 2000.0]
    assert C.sanitized_names(["a", "a", "a_2"]) == ["a", "a_2", "a_2_2"]


def test_dates_and_numbers_by_type(spark):
    one = spark.createDataFrame([(dt.datetime(2024, 1, 5, 10), dt.date(2024, 1, 6), 2.5e7, 12345678.9, 1e-4)],
                                "ts timestamp, d date, big double, odd double, small double")
    r = one.select(parse_date(F.col("ts")).alias("ts"), parse_date(F.col("d")).alias("d"),
                   *[parse_currency(c).alias(c) for c in ("big", "odd", "small")]).first()
    assert tuple(r) == (dt.date(2024, 1, 5), dt.date(2024, 1, 6), 2.5e7, 12345678.9, 1e-4)
    texts = ["2024-01-05 00:00:00", "2024-01-05T10:00:00", "2024-1-5T10:00:00.123Z", "1/5/2024", " 01/05/2024 ",
             "2024-02-30", "2024-01-05 x", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(parse_date(F.col("t"))).collect()]
    assert got == [dt.date(2024, 1, 5)] * 5 + [None] * 4
    raw = spark.createDataFrame([("2025-01-09 00:00:00", 2.5e7, "31%")], "date string, cost double, retention_rate_d1 string")
    n = C.normalize_ingest(raw).first()
    assert (n["date"], n["cost"], n["retention_d1"]) == (dt.date(2025, 1, 9), 2.5e7, 0.31)
    blank = C.normalize_ingest(raw.select(F.lit(None).cast("string").alias("cost")), fill_zero=False).first()
    assert blank["cost"] is None


def test_hierarchy_aliases_and_first_countries(spark):
    rows = [(1, None, "App1", "ZA"), (2, None, None, "US"), (3, None, None, "ZA"), (4, None, None, "BR"), (5, None, None, "CA"),
            (6, None, None, "DE"), (7, None, None, "AT")]
    df = spark.createDataFrame(rows, "o int, game string, app string, geo string").withColumn("country", F.lit(None).cast("string"))
    r = C.detect_hierarchy(df.withColumn("k", F.lit(1)), ["k"], "o").first()
    assert r["game"] == "App1" and r["countries"] == ["ZA", "US", "BR", "CA", "DE"]


def test_csv_loader_and_empty_file(spark, tmp_dir):
    p = os.path.join(tmp_dir, "raw.csv")
    _write(p, "cost,revenue,date\n10,20,2024-01-01\n")
    assert SRC.read_csv_file(spark, p).count() == 1
    e = os.path.join(tmp_dir, "empty.csv")
    _write(e, "cost,revenue\n")
    with pytest.raises(ValueError):
        SRC.read_csv_file(spark, e)


def test_end_to_end_ingest_and_registry(spark, tmp_dir):
    rows = [("2024-01-01", "unity_ads", "android", "Test Game", "US", 100, "$10.00", "20.5", 0.1, 0.2, 0.3, 0.4, 0.9),
            ("2024-01-02", "unity_ads", "android", "Test Game", "US", 120, "11", "21", 0.1, 0.2, 0.3, 0.4, 1.0),
            ("2024-01-03", "unity_ads", "android", "Test Game", "US", 90, "9,50", "19", 0.1, 0.2, 0.3, 0.4, 1.1)]
    cols = "date platform channel game country installs cost revenue roas_d0 roas_d1 roas_d3 roas_d7 roas_d30".split()
    raw = spark.createDataFrame(rows, cols)
    meta = C.detect_hierarchy(raw.withColumn("_k", F.lit(1)).withColumn("_o", F.col("date")), ["_k"], "_o").first()
    assert meta["platform"] == "unity_ads" and meta["channel"] == "android" and meta["game"] == "Test Game"
    norm = C.normalize_ingest(raw)
    assert norm.count() == 3
    assert norm.agg(F.min("date")).first()[0] == dt.date(2024, 1, 1)
    assert sorted(r["cost"] for r in norm.collect()) == [9.5, 10.0, 11.0]
    R.write_dataset_data(norm, tmp_dir, "ds-1")
    back = R.read_dataset_data(spark, tmp_dir, "ds-1")
    assert back.count() == 3
    R.append_record(spark, tmp_dir, R.DATASET, {"id": "ds-1", "source_platform": "unity_ads", "game": "Test Game",
                                                "records": 3}, "id string, source_platform string, game string, records long")
    reg = R.read_registry(spark, tmp_dir, R.DATASET)
    reg = reg.withColumn("ingest_started_at", F.current_timestamp())
    assert R.get_datasets(reg, platform="unity_ads").count() == 1
    assert R.get_datasets(reg, game="test").count() == 1
    assert R.get_by_id(reg, "ds-1").count() == 1


def test_hydrate_financials_backfills_zero_canonical(spark):
    df = spark.createDataFrame([("0", "$1,000", "31%"), ("0", "$2,000", "5%")], ["cost", " cost ", "Revenue "])
    out = C.hydrate_financials(df).orderBy("cost").collect()
    assert [r["cost"] for r in out] == [1000.0, 2000.0]
    assert [r["cost_raw"] for r in out] == ["$1,000", "$2,000"]
    assert sorted(r["revenue"] for r in out) == pytest.approx([0.05, 0.31])


def test_drop_empty_and_align(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    out = C.drop_empty(df)
    assert out.columns == ["a"] and out.count() == 1
    al = C.align_features(out, ["b", "a"])
    assert al.columns == ["b", "a"] and al.first()["b"] == 0.0


# ---- streaming (R9, R3) -----------------------------------------------------

def test_streaming_ingest_available_now(spark, tmp_dir):
    from pyspark.sql.types import StringType, StructField, StructType
    from uaspark.streaming.ingest import ingest_stream
    src = os.path.join(tmp_dir, "in")
    _write(os.path.join(src, "a.csv"), "date,installs,cost,revenue\n2024-01-01,5,$1.00,2\n")
    schema = StructType([StructField(n, StringType()) for n in ["date", "installs", "cost", "revenue"]])
    q = ingest_stream(spark, src, schema, os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck"))
    q.awaitTermination(120)
    _write(os.path.join(src, "b.csv"), "date,installs,cost,revenue\n2024-01-02,6,$2.00,3\n")
    q = ingest_stream(spark, src, schema, os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck"))
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(tmp_dir, "out"))
    assert sorted(r["cost"] for r in out.collect()) == [1.0, 2.0]  # each file exactly once


def test_a_replayed_batch_changes_nothing(spark, tmp_dir):
    from pyspark.sql.types import StringType, StructField, StructType
    from uaspark.streaming.ingest import ingest_to_registry, store_batch
    src, root = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "reg")
    schema = StructType([StructField(c, StringType()) for c in ("date", "platform", "channel", "game", "country", "installs", "cost")])
    run = lambda: ingest_to_registry(spark, src, schema, root, os.path.join(tmp_dir, "ck"), "daily").awaitTermination(120)
    head = "date,platform,channel,game,country,installs,cost\n"
    _write(os.path.join(src, "a.csv"), head + "2024-01-01,Unity,ios,G,US,5,$1.00\n2024-01-03,Unity,ios,G,US,6,$2.00\n")
    run()
    _write(os.path.join(src, "b.csv"), head + "2024-02-01,Unity,ios,G,US,7,$3.00\n")
    run()
    run()                                                        # nothing new
    ids = {r.id: (r.records, str(r.data_end_date)) for r in R.read_registry(spark, root, R.DATASET).collect()}
    assert ids == {"daily-0": (2, "2024-01-03"), "daily-1": (1, "2024-02-01")}
    first = R.read_dataset_data(spark, root, "daily-0").drop("dataset_id")
    rows = sorted(map(tuple, first.collect()), key=str)
    again = spark.createDataFrame(first.collect(), first.schema)
    assert store_batch(again, 0, root, "daily") == "daily-0"     # the batch fails after its rows were written and is tried again
    assert sorted(map(tuple, R.read_dataset_data(spark, root, "daily-0").drop("dataset_id").collect()), key=str) == rows
    assert {r.id for r in R.read_registry(spark, root, R.DATASET).collect()} == set(ids)
    assert R.read_registry(spark, root, R.DATASET).count() == 2 and R.read_dataset_data(spark, root, "daily-1").count() == 1
    assert store_batch(again.limit(0), 9, root, "daily") is None


def test_keyed_writes_replace_and_leave_others_alone(spark, tmp_dir):
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    R.write_dataset_data(rows(1, 2), tmp_dir, "a")
    R.write_dataset_data(rows(3), tmp_dir, "b")
    R.write_dataset_data(rows(4, 5, 6), tmp_dir, "a")
    assert sorted(r.v for r in R.read_dataset_data(spark, tmp_dir, "a").collect()) == [4, 5, 6]
    assert [r.v for r in R.read_dataset_data(spark, tmp_dir, "b").collect()] == [3]
    R.append_record(spark, tmp_dir, "t", {"id": "x/1", "n": 1}, "id string, n int")
    R.append_record(spark, tmp_dir, "t", {"id": "x/1", "n": 2}, "id string, n int")
    R.append_record(spark, tmp_dir, "t", {"n": 3}, "id string, n int")
    assert sorted(r.n for r in R.read_registry(spark, tmp_dir, "t").collect()) == [2, 3]


def test_two_writers_never_take_one_version(spark, tmp_dir):
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(8) as pool:
        taken = list(pool.map(lambda _: R.take_version(spark, tmp_dir, "model a/b"), range(12)))
    assert sorted(taken) == list(range(1, 13)) and R.take_version(spark, tmp_dir, "model a/b", 40) == 41
    assert R.take_version(spark, tmp_dir, "other") == 1


def test_newest_first_with_ties_by_id(spark):
    mv = spark.createDataFrame([("b", "m", 1), ("a", "m", 1), ("c", "m", 2), ("d", "n", 9)], "id string, model_name string, created_at int")
    assert [r.id for r in R.get_model_versions(mv, "m").collect()] == ["c", "a", "b"]


def test_one_hot_rows_take_any_vocabulary(spark):
    from uaspark.operators import features as X
    df = spark.range(3_000).select("id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("a"),
                                   F.when(F.col("id") % 2 == 0, F.lit("even")).alias("b"))
    out = X.one_hot_rows(df, "id", ["a", "b"])
    assert out.count() == 4_500 and out.where("feature = 'a_v2999'").first().id == 2999
    with pytest.raises(ValueError):
        X.vocabularies(df, ["a"])


# ---- model bundles (S17, M9), answers (X26), replies (X28) ----------------------

def test_saved_models_predict_the_same(spark, tmp_dir):
    rng = np.random.default_rng(5)
    x = rng.uniform(size=(200, 2))
    df = spark.createDataFrame([(i, float(a), float(b), float(3 * a + b)) for i, (a, b) in enumerate(x)],
                               "id long, a double, b double, y double")
    models = BO.fit_quantile_triple(df, ["a", "b"], "y", n_rounds=3, max_depth=3, min_instances=5)
    datasets = spark.createDataFrame([("d1", dt.date(2024, 1, 31)), ("d2", dt.date(2024, 3, 31))], "id string, data_end_date date")
    record = R.register_model(spark, tmp_dir, models, "m", 30, datasets, {"mae": 0.5})
    again = R.register_model(spark, tmp_dir, models, "m", 30, datasets)
    assert (record["version"], again["version"], record["train_end_date"]) == (1, 2, "2024-03-31")
    loaded, info = BO.load_models(spark, record["artifact_path"])
    assert info["metrics"] == {"mae": 0.5}
    show = lambda m: [tuple(r) for r in BO.predict_quantiles(m, df, sort_quantiles=True).orderBy("id").collect()]
    before, after = show(models), show(loaded)
    assert before == after and all(r[-4] <= r[-3] <= r[-2] for r in after)


def test_booster_queries_cover_all_horizons_at_full_rounds(spark, monkeypatch):
    from tests.conftest import SF
    from uaspark.plans import q_forecast
    from uaspark.plans.bridge import TARGET_DAYS, Bridge
    asked, fit = [], BO.fit_models

    def short(df, label, specs, **kw):
        asked.append(({s.name for s in specs}, kw))
        return fit(df, label, specs, n_rounds=1, max_depth=2)

    monkeypatch.setattr(BO, "fit_models", short)
    b = Bridge(spark, SF)
    folds = q_forecast.m5(b).collect()
    assert sorted((r.target_day, r.fold) for r in folds) == [(day, k) for day in TARGET_DAYS for k in range(5)]
    assert sum(r.n for r in folds) == b.actuals.where("actual IS NOT NULL").count()
    ranked = q_forecast.m7(b).collect()
    assert {r.target_day for r in ranked} == set(TARGET_DAYS) and len({r.feature for r in ranked}) >= 10
    assert not any(r.feature in ("revenue", "actual", "row_id", "roas_d7", "retention_rate_d7") for r in ranked if r.target_day == 7)
    assert q_forecast.m1(b).count() == b.actuals.count()
    assert [kw for _, kw in asked] == [BO.PRESETS["standard"]] * 3          # the app's own rounds, depth, leaves and rate
    assert [len(names) for names, _ in asked] == [10, 2, 6]


def regression(spark, n=1500, seed=11):
    rng = np.random.default_rng(seed)
    x = rng.uniform(size=(n, 3))
    y = np.where(x[:, 0] > 0.5, 3.0, 1.0) + x[:, 1] + rng.normal(scale=0.3, size=n)
    rows = [(i, *map(float, x[i]), float(y[i]), i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, half int")


@pytest.mark.parametrize("preset", ["standard", "light", "service"])
def test_presets_limit_the_leaves(spark, preset):
    parameters = BO.PRESETS[preset] | {"n_rounds": 2, "min_instances": 1}
    forest = BO.QuantileBooster(0.5, **parameters).fit(regression(spark), ["a", "b", "c"], "y").forest
    most = BO.PRESETS[preset]["max_leaves"]
    assert len(forest.roots) == 2 and (most == max(forest.leaves()) if preset != "light" else most - 5 < max(forest.leaves()) <= most)


def test_collapse_drops_the_least_gains():
    tree = BO.Tree({0: (0, 0.5, 1, 2, 9.0), 1: (1, 0.2, 3, 4, 1.0), 2: (1, 0.7, 5, 6, 5.0), 5: (2, 0.1, 7, 8, 0.5)}, {3, 4, 6, 7, 8})
    assert tree.collapsed(4).leaves == {3, 4, 5, 6}
    assert tree.collapsed(3).leaves == {1, 5, 6} and tree.collapsed(1).leaves == {0} and tree.collapsed(9).leaves == tree.leaves
    assert tree.collapsed(3).expression(["a", "b", "c"], str) == "IF(a <= 0.5D, 1, IF(b <= 0.7D, 5, 6))"


def test_flat_forest_scores_as_the_training_saw(spark):
    """Steps added round by round in the frame equal the forest's score; missing values count as 0."""
    df = regression(spark)
    df = df.withColumn("c", F.when(F.col("id") % 5 != 0, F.col("c")))
    model = BO.QuantileBooster(0.5, n_rounds=6, max_depth=3, max_leaves=6, learning_rate=0.3, checkpoint_every=2).fit(df, ["a", "b", "c"], "y")
    names = ["a", "b", "c"]
    f = model.forest

    def walk(row, node):
        while f.feature[node] >= 0:
            value = row[names[f.feature[node]]]
            node = f.left[node] if (value or 0.0) <= f.threshold[node] else f.right[node]
        return f.step[node]

    out = model.transform(df, "p").collect()
    assert all(r.p == pytest.approx(model.f0 + sum(walk(r, root) for root in f.roots)) for r in out)
    loss = lambda m: BO.pinball_loss(m.transform(df, "p"), "y", "p", 0.5).first()[0]
    none = BO.QuantileBooster(0.5, n_rounds=0).fit(df, names, "y")
    assert loss(model) < loss(none)
    size = lambda m: len(m.transform(df, "p")._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(model) - size(none)) < 50                   # the plan doesn't grow with the rounds
    assert sum(model.feature_importances().values()) == pytest.approx(1.0) and model.feature_importances()["a"] > 0.5


def test_models_fitted_together_equal_models_fitted_alone(spark):
    df = regression(spark, 800)
    kw = {"n_rounds": 3, "max_depth": 3, "max_leaves": 5}
    specs = [BO.ModelSpec("lo", 0.1, ["a", "b"], F.col("half") == 0), BO.ModelSpec("hi", 0.9, ["b", "c"], F.col("half") == 1),
             BO.ModelSpec("none", 0.5, ["a"], F.col("half") == 7)]
    both = BO.fit_models(df, "y", specs, **kw)
    for s in specs[:2]:
        alone = BO.QuantileBooster(s.alpha, **kw).fit(df.where(s.rows), s.features, "y")
        assert alone.f0 == both[s.name].f0 and len(alone.forest.roots) == 3
        assert alone.forest.feature == both[s.name].forest.feature
        assert alone.forest.step == pytest.approx(both[s.name].forest.step)
    assert both["none"].f0 == 0.0 and both["none"].forest.roots == []


def test_rounds_run_over_as_few_partitions_as_the_rows_need(spark, monkeypatch):
    kept, cut = [], BO.cut_lineage
    monkeypatch.setattr(BO, "cut_lineage", lambda df: kept.append(cut(df)) or kept[-1])
    monkeypatch.setattr(BO, "ROWS_PER_TASK", 700, raising=False)
    kw = {"n_rounds": 3, "max_depth": 3, "max_leaves": 5}
    many = BO.QuantileBooster(0.5, **kw).fit(regression(spark).repartition(12), ["a", "b", "c"], "y")
    assert kept[-1].rdd.getNumPartitions() <= 3                 # 1,500 rows
    one = BO.QuantileBooster(0.5, **kw).fit(regression(spark).coalesce(1), ["a", "b", "c"], "y")
    assert many.forest.feature == one.forest.feature and many.forest.step == pytest.approx(one.forest.step)


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_partitions_of_the_order_lines_follow_their_number(spark, monkeypatch, few):
    from tests.conftest import SF
    from uaspark.plans import bridge
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    columns = lambda b: (b.campaign_daily, b.campaign)
    want = [rows(df) for df in columns(bridge.Bridge(spark, SF))]
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    monkeypatch.setattr(bridge, "LINES_PER_TASK", lines // 12, raising=False)
    monkeypatch.setattr(bridge, "FEW_PARTS", few, raising=False)
    b = bridge.Bridge(spark, SF)
    parts = -(-lines // (lines // 12))
    plan = b.campaign_daily._jdf.queryExecution().optimizedPlan().toString()
    dealt = [line for line in plan.splitlines() if "RepartitionByExpression" in line and f", {parts}" in line]
    assert len(dealt) == (5 if few == 0 else 3)                 # lines and orders by order (and lines and parts by part), lines by customer
    assert [rows(df) for df in columns(b)] == want


def test_what_if_with_the_booster_equals_a_loop(spark):
    from uaspark.operators import kpi
    rows = [(i, 100.0 + i, 80.0 + 3 * (i % 11), 10, 1.0, 0.3 + 0.01 * (i % 7), 0.1 + 0.01 * (i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, cost double, revenue double, installs long, retention_rate_d0 double, retention_rate_d1 double, retention_rate_d7 double")
    features = lambda d: d.withColumn("arpu", F.col("revenue") / F.col("installs"))
    model = BO.QuantileBooster(0.5, n_rounds=3, max_depth=3, min_instances=3).fit(
        features(df).withColumn("y", F.col("revenue") / F.col("cost")), ["arpu", "cost", "retention_rate_d7"], "y")
    score = lambda d: model.transform(d, "p")
    grid = {(r.id, r.retention_uplift, r.arpu_uplift): r.p for r in kpi.what_if(df, [0.0, 0.5], [0.0, 2.0], features, score).collect()}
    for u in (0.0, 0.5):
        for a in (0.0, 2.0):
            for r in score(features(kpi.scenarios(df, [u], [a]))).collect():
                assert grid[r.id, u, a] == r.p
    assert len(grid) == 240


def test_cross_validation_counts_zero_labels(spark):
    df = spark.createDataFrame([(i, float(i % 7), 0.0 if i % 2 else 1.0) for i in range(60)], "id long, a double, y double")
    out = BO.cross_validate_median(df, ["a"], "y", "id", folds=2, n_rounds=1, max_depth=2, min_instances=2).collect()
    assert sum(r["n"] for r in out) == 60


def test_drivers_come_from_the_model(spark):
    from uaspark.operators import answers as A
    model = BO.QuantileBooster(0.5, n_rounds=2, max_depth=2, max_leaves=3).fit(regression(spark, 600), ["a", "b", "c"], "y")
    ranked = BO.importance_frame(spark, model.feature_importances() | {"unused": 0.0})
    assert A.drivers_from_importance(ranked).first().answer.startswith("Top drivers of ROAS include: a, ")
    assert "unused" not in A.drivers_from_importance(ranked).first().answer
    assert A.drivers_from_importance(ranked.limit(0)).first() == ("drivers", A.NO_DRIVERS)
    tied = spark.createDataFrame([(f"f{i}", 0.1) for i in range(9)], "feature string, importance double")
    assert A.drivers_from_importance(tied, 3).first().answer == "Top drivers of ROAS include: f0, f1, f2."


def test_second_router_by_context(spark):
    from uaspark.operators import answers as A
    asks = ["When is ROI 100%?", "continue or pause", "projected ROAS", "CPI profitability D30", "retention rate D7", "ready to scale?",
            "cut immediately", "roi of what", None]
    contexts = [("m", "d", False, "x"), ("m", None, True, "x"), ("", "d", False, "Adaptive AI recommendations v2"), (None, None, False, None)]
    df = spark.createDataFrame([(a, *c) for a in asks for c in contexts], "q string, m string, d string, p boolean, t string")
    out = {(r.q, r.m, r.d): (r.route, r.answer) for r in A.fallback_answers(df, "q", "m", "d", "p", "t").collect()}
    assert [out[a, "m", "d"][0] for a in asks] == ["roi", "continue", "projected", "cpi", "retention", "scale", "cut", "other", "other"]
    assert "model 'm' on dataset 'd'" in out[asks[0], "m", "d"][1] and out["roi of what", "m", "d"][1] == A.FALLBACK_OTHER
    for a in asks:
        left = out[a, None, None][0] in ("roi", "continue", "projected", "other")
        for some in (("m", None), ("", "d")):
            assert (out[a, *some][1] is None) == left           # recommendations leave these to a language model
        assert out[a, None, None][1] is not None and "Please select a model" in out[a, None, None][1]


def test_roi_answers(spark):
    from uaspark.operators import answers as A
    curve = lambda rows: A.roi_answer(spark.createDataFrame(rows, "day int, value double")).first()["answer"]
    assert curve([(7, 1.2), (0, 0.5)]) == ("Based on the data, ROI of 100% (ROAS = 1.0) is achieved at roas_d7. "
                                           "The ROAS progression shows: roas_d0: 0.500, roas_d7: 1.200")
    assert curve([(7, 0.9), (0, 0.5)]).startswith("ROI of 100% is not achieved in the available data. Maximum ROAS is 0.900 at roas_d7.")


def test_reply_parsing(spark):
    from uaspark.operators import answers as A
    replies = [("a", '```json\n{"recommendations": [{"row_index": 1, "action": " cut ", "budget_change_pct": -5},'
                     ' {"row_index": 1, "action": "scale"}, {"action": "x"}]}\n```\nbye'),
               ("b", "```\n{\"recommendations\": [{\"row_index\": \"2\", \"rationale\": \"r\"}]}\n```"), ("c", "sorry"), ("d", None),
               ("e", '{"recommendations": []}'), ("f", "")]
    got = A.parse_replies(spark.createDataFrame(replies, "k string, t string"), "t", ["k"]).collect()
    assert sorted(tuple(r) for r in got) == [("a", 1, "scale", "", None), ("b", 2, "", "r", None)]


def test_names_stay_unique_after_renaming(spark):
    clash = "n_" + __import__("hashlib").md5(b"b").hexdigest()[:6]
    rows = [("a", "n", 1), ("b", "n", 2), ("c", clash, 3), ("d", "x" * 80, 4), ("e", "x" * 80, 5)]
    out = R.unique_names(spark.createDataFrame(rows, "id string, canonical_name string, ingest_started_at int")).collect()
    names = [r["unique_name"] for r in out]
    assert len(set(names)) == 5 and max(map(len, names)) <= 80


def test_keyword_tables_are_the_published_ones():
    from uaspark.functions import text as TX
    assert [k for k, _ in TX.INTENT_KEYWORDS] == ["roi_timeline", "budget_action", "projection_same_spend",
                                                  "level_quality_channels", "forecast_vs_actual"]
    assert ADV.ACTION_RULES == [(1.5, 0.5, "scale"), (1.0, 0.8, "maintain"), (0.5, None, "reduce")]
    assert ADV.CONFIDENCE_RULES == [(0.1, "High"), (0.2, "Medium")]


def test_profile_and_payload_helpers(spark):
    from uaspark.operators import profile as P
    df = spark.createDataFrame([(2, "b", None), (1, "a", 0.5)], "roas_d7 int, platform string, cost double")
    assert {r["family"]: r["n"] for r in P.feature_summary(df).collect()} == {
        "retention_features": 0, "roas_features": 1, "level_features": 0, "cost_features": 1, "platform_features": 1,
        "total_features": 3, "numeric_features": 2, "string_features": 1}
    assert P.schema_fingerprint(df) == P.schema_fingerprint(df.select("cost", "platform", "roas_d7"))
    assert P.schema_fingerprint(df) != P.schema_fingerprint(df.limit(1))
    assert P.feature_set_fingerprint(["b", "a"]) == P.feature_set_fingerprint(["a", "b"])
    assert [r["payload"] for r in C.compact_payload(df, ["roas_d7"], 1).collect()] == ['{"roas_d7":"1","platform":"a","cost":"0.5"}']
    assert C.numeric_only(df, ["cost"]).columns == ["roas_d7"]
    assert C.top_features(df, ["cost", "x", "roas_d7"], 1).columns == ["platform", "cost"]
    assert C.first_existing_column(df, ["x", "cost"]) == "cost"
    assert spark.range(1).select(C.first_element(F.array(F.lit(4), F.lit(5))).alias("x")).first()["x"] == 4
    assert [r["roas_d7"] for r in SRC.preview(df, ["roas_d7"], 1).collect()] == [1]


def test_exports_and_runs(spark, tmp_dir):
    df = spark.createDataFrame([(1, 0.5)], "row_index int, p50 double")
    R.export_csv(df, os.path.join(tmp_dir, "csv"))
    assert SRC.read_csv_file(spark, os.path.join(tmp_dir, "csv")).first()["p50"] == "0.5"
    R.write_prediction_run(df, tmp_dir, "run-1")
    assert R.read_prediction_run(spark, tmp_dir, "run-1").count() == 1 and R.read_prediction_run(spark, tmp_dir, "x").count() == 0


def test_call_logs(spark, tmp_dir):
    logs = os.path.join(tmp_dir, "logs")
    _write(os.path.join(logs, "faq_ask_20240105_101112_000123.json"), '{\n  "question": "why?",\n  "save_raw": true\n}')
    _write(os.path.join(logs, "odd.json"), '{"question": "x"}')
    got = {r["source_file"]: (r["question"], r["kind"], r["logged_at"])
           for r in SRC.read_call_logs(spark, logs, "question string, save_raw boolean").collect()}
    assert got["faq_ask_20240105_101112_000123.json"] == ("why?", "faq_ask", dt.datetime(2024, 1, 5, 10, 11, 12, 123))
    assert got["odd.json"] == ("x", None, None)


def test_streaming_alerts_leave_late_rows_out(spark, tmp_dir):
    from uaspark.streaming.ingest import daily_alerts
    src = os.path.join(tmp_dir, "in")
    _write(os.path.join(src, "1.csv"), "2024-01-01 10:00:00,unity,10,100.0,5\n")
    stream = (spark.readStream.schema("ts timestamp, platform string, installs long, cost double, active_d1 long").csv(src))
    q = (daily_alerts(stream, watermark="1 day").writeStream.format("memory").queryName("alerts_r3").outputMode("append")
         .option("checkpointLocation", os.path.join(tmp_dir, "ck")).start())
    try:
        q.processAllAvailable()
        assert spark.table("alerts_r3").count() == 0            # the day is still open
        _write(os.path.join(src, "2.csv"), "2024-01-05 10:00:00,unity,1,1.0,1\n")
        q.processAllAvailable()
        _write(os.path.join(src, "3.csv"), "2024-01-01 11:00:00,unity,90,1.0,90\n2024-01-09 10:00:00,unity,1,1.0,1\n")
        q.processAllAvailable()
        got = [tuple(r) for r in spark.table("alerts_r3").select("day", "installs", "cpi", "retention_d1", "alert").collect()]
    finally:
        q.stop()
    assert got == [(dt.date(2024, 1, 1), 10, 10.0, 0.5, "high_cpi")]


def test_filter_options_reads_the_table_once(spark, tmp_path):
    from uaspark.operators import profile as P
    spark.createDataFrame([("a", 1, None), ("a", 2, None), (None, 2, None), ("b", None, None)], "x string, y int, z string") \
        .write.parquet(f"{tmp_path}/t")
    out = P.filter_options(spark.read.parquet(f"{tmp_path}/t"), ["x", "y", "z"])
    assert sorted(map(tuple, out.collect())) == [("x", "a"), ("x", "b"), ("y", "1"), ("y", "2")]
    assert out._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1


def test_campaign_days_are_the_keys_of_campaign_daily(spark, tmp_path):
    """Repeated and missing keys too; each table is read once for the options."""
    from uaspark.plans import bridge, q_profile
    day = dt.datetime(2024, 1, 1)
    tables = {
        "nation": ([(1, "FR"), (2, None)], "n_nationkey int, n_name string"),
        "customer": ([(1, 1, "A"), (1, 1, "A"), (2, 2, None), (None, 1, "B")], "c_custkey long, c_nationkey int, c_mktsegment string"),
        "orders": ([(1, 1, "F", day), (2, 2, "O", day), (3, None, "P", day), (None, 1, "P", day), (2, 2, "O", None)],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp"),
        "part": ([(1, "P1", 2.0), (2, None, 3.0), (3, "unused", 1.0)], "p_partkey long, p_type string, p_retailprice double"),
        "lineitem": ([(1, 1, 1.0, 5.0, 0.0, 0.0)] * 2 + [(2, 2, 1.0, 5.0, 0.0, 0.0), (None, 3, 1.0, 1.0, 0.0, 0.0), (1, None, 1.0, 1.0, 0.0, 0.0)],
                     "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    b = bridge.Bridge(spark, str(tmp_path))
    keys = [*bridge.HIERARCHY, "date"]
    rows = lambda df: sorted(map(tuple, df.select(*keys).collect()), key=str)
    assert rows(b.campaign_days) == rows(b.campaign_daily) and len(rows(b.campaign_days)) == 3
    out = q_profile.f6_filter_options(b)
    assert sorted(map(tuple, out.collect())) == [("channel", "F"), ("channel", "O"), ("country", "FR"), ("game", "P1"), ("platform", "A")]
    assert out._jdf.queryExecution().sparkPlan().toString().count("FileScan parquet") == 5
