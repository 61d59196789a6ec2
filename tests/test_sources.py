import json
import zipfile

import pytest
from pyspark.sql import functions as F

from marlstone.operators import daily
from marlstone.sources import documents, sinks, ticks
from marlstone.streaming.ticks import windowed_features


def wide(spark):
    row = {"SecurityID": "603316.SH", "TradeDate": "2026-05-07", "DataTimeStamp": 1778118226000, "TradeTime": 9, "LastPx": 21.2, "TotalVolumeTrade": 100000, "TotalValueTrade": 2120000, "NumTrades": 50, "TotalBidQty": 5000, "TotalOfferQty": 8000, "BigOrderVolume": 1200}
    for i in range(1, 11):
        row |= {f"BidPrice{i}": round(21.2 - 0.01 * i, 2), f"BidOrderQty{i}": 100 * i, f"OfferPrice{i}": round(21.2 + 0.01 * i, 2), f"OfferOrderQty{i}": 90 * i}
    return spark.createDataFrame([row])


def test_wide_rows_become_ticks(spark):
    t = ticks.normalised(wide(spark)).first()
    assert t.symbol == "603316.SH" and t.dt == "20260507" and len(t.bids) == 10 and t.bids[0].price > 0
    day = daily.daily_features(ticks.normalised(wide(spark))).first()
    assert day.n_snapshots == 1 and day.aggression == pytest.approx(0.000943396, abs=1e-8)
    assert day.net_active == pytest.approx(0.0526316, abs=1e-6) and day.depth_slope_bid == pytest.approx(0.1090909, abs=1e-6)


def test_unconfigured_source_raises(spark):
    with pytest.raises(RuntimeError):
        ticks.source(spark, "vendor").load()
    with pytest.raises(RuntimeError):
        ticks.detect(spark)
    with pytest.raises(ValueError):
        ticks.source(spark, "nothing")


def test_exports_filter_after_renaming(spark, tmp_path):
    df = wide(spark)
    df.withColumn("SecurityID", F.lit("other")).unionByName(df).coalesce(1).write.parquet(f"{tmp_path}/x.parquet")
    df.coalesce(1).write.option("header", True).csv(f"{tmp_path}/y.csv")
    got = ticks.source(spark, "VENDOR", path=str(tmp_path)).load(["603316.SH"], ["2026-05-07"])
    assert got.count() == 2 and ticks.source(spark, "file", path=str(tmp_path)).load(None, ["2026-01-01"]).count() == 0
    fetched = ticks.source(spark, "vendor", fetch=lambda s, d: df).load(["603316.SH"])
    assert fetched.count() == 1
    plan = ticks.selected(ticks.renamed(spark.read.parquet(f"{tmp_path}/x.parquet"), ticks.VENDOR_NAMES), ["a"])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(SecurityID), EqualTo(SecurityID,a)]" in plan


def test_dates_are_pushed_into_the_scan(spark, tmp_path):
    days = spark.sql("select id, date_add(date'2026-05-01', int(id)) as d from range(10)").selectExpr("cast(id as string) as symbol", "cast(d as string) as a", "date_format(d, 'yyyyMMdd') as b", "d as c", "cast(d as timestamp) + interval 5 hours as e")
    days.coalesce(1).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    for name in "abce":
        got = ticks.selected(rows, None, ["2026-05-03", "20260505"], date=name)
        assert sorted(r.symbol for r in got.collect()) == ["2", "4"], name
        pushed = got._jdf.queryExecution().executedPlan().toString().split("PushedFilters: [")[1].split("]")[0]
        assert f"({name}," in pushed, pushed


def test_templates_are_bound():
    sql = "select * from t where s in :symbols and d in :dates"
    assert ticks.bound(sql, ["a", "o'b"], ["2026-05-07"]) == "select * from t where s in ('a', 'o''b') and d in ('20260507')"
    with pytest.raises(ValueError):
        ticks.bound(sql, ["a"], None)
    assert ticks.bound("select 1", None, None) == "select 1"


def test_database_source(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = wide(spark).select("SecurityID", "TradeDate", "DataTimeStamp", "LastPx", "BidPrice1", "BidOrderQty1")
    rows = rows.unionAll(rows.withColumn("TradeDate", F.lit("20260508"))).unionAll(rows.withColumn("SecurityID", F.lit("other")))
    rows.write.option("createTableColumnTypes", "SecurityID VARCHAR(20), TradeDate VARCHAR(20)").jdbc(url, "L2", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    load = ticks.source(spark, "vendor", url=url, table="L2").load
    got = load(["603316.SH"], ["2026-05-07", "20260508"])
    assert sorted(r.dt for r in got.collect()) == ["20260507", "20260508"] and got.rdd.getNumPartitions() == 2
    assert load(None, ["2026-05-08"]).count() == 1 and load().count() == 3
    told = ticks.source(spark, "vendor", url=url, template="select * from L2 where \"SecurityID\" in :symbols").load(["other"])
    assert [r.symbol for r in told.collect()] == ["other"]


def test_sources_by_environment(spark, tmp_path, monkeypatch):
    wide(spark).coalesce(1).write.parquet(f"{tmp_path}/x.parquet")
    monkeypatch.setenv(ticks.ENVIRONMENT["path"], str(tmp_path))
    assert ticks.detect(spark).load().count() == 1
    made = ticks.detect(spark, fetch=lambda s, d: wide(spark).limit(0))
    assert made.load().count() == 0 and made.name == "vendor"
    monkeypatch.delenv(ticks.ENVIRONMENT["path"])
    assert ticks.detect(spark, allow_generated=True).name == ticks.GENERATED
    (tmp_path / "vendor_sdk.py").write_text("class Client:\n    @staticmethod\n    def query_l2_snapshot(symbols, dates):\n        return FRAME\n")
    fetch = ticks.fetch_of(f"{tmp_path}/vendor_sdk.py")
    fetch.__globals__["FRAME"] = wide(spark)
    assert ticks.source(spark, "vendor", fetch=fetch).load(["603316.SH"]).count() == 1
    with pytest.warns(UserWarning):
        assert ticks.fetch_of("no_such_module_here") is None and ticks.fetch_of("json") is None


def test_spreadsheets_by_a_reader(spark, tmp_path):
    import io

    import pandas as pd

    (tmp_path / "a.xlsx").write_bytes(b"SecurityID,TradeDate\n1,2026-05-07\n2,2026-05-08\n")
    (tmp_path / "b.xlsx").write_bytes(b"SecurityID,TradeDate\n3,2026-05-07\n")
    read = {"xlsx": lambda raw: pd.read_csv(io.BytesIO(raw))}
    got = ticks.source(spark, "file", path=str(tmp_path), readers=read).load(None, ["2026-05-07"])
    assert sorted(r.symbol for r in got.collect()) == ["1", "3"]


def test_folders_of_many_files_and_layouts(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"{i}.csv").write_text("a,b\n1,2\n" if i % 3 else "b,c\n3,4\n")
    spark.createDataFrame([(1, 2)], "a int, b int").coalesce(1).write.parquet(f"{tmp_path}/p.parquet")
    spark.createDataFrame([("x", 2)], "a string, d int").coalesce(1).write.parquet(f"{tmp_path}/q.parquet")
    got = ticks.read_folder(spark, str(tmp_path))
    assert got.count() == 32 and set(got.columns) == set("abcd")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 4


def test_keys_universe_and_feature_folders(spark, tmp_path):
    got = ticks.keyed(spark.createDataFrame([("1", "2026-05-07")], "code string, trade_date string")).first()
    assert (got.symbol, got.date) == ("1", "20260507")
    (tmp_path / "u.csv").write_text("name,股票代码\na,600000\nb,600001\nb,600001\n", encoding="utf-8")
    assert {r.symbol for r in ticks.read_universe(spark, f"{tmp_path}/u.csv").collect()} == {"600000", "600001"}
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.csv").write_text("stock_code,date,x\n1,2026-05-07,2\n")
    (tmp_path / "f/b.csv").write_text("stock_code,date,y\n2,2026-05-08,3\n")
    rows = ticks.read_features(spark, f"{tmp_path}/f").orderBy("symbol").collect()
    assert [(r.symbol, r.date, r.x, r.y) for r in rows] == [("1", "20260507", "2", None), ("2", "20260508", None, "3")]
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        ticks.read_folder(spark, f"{tmp_path}/empty")


def test_sinks(spark, tmp_path):
    p = spark.createDataFrame([("1", "2026-05-07", "大单吸筹", "x", 1)], "symbol string, date string, pattern_type string, pattern_explanation string, extra int")
    q = spark.createDataFrame([("1", "2026-05-07", "散户", "买入")], "symbol string, date string, capital_type string, capital_intention string")
    a, b = sinks.write_patterns(p, f"{tmp_path}/pattern.csv"), sinks.write_predictions(q, f"{tmp_path}/predict.csv")
    raw = open(a, "rb").read()
    assert raw.startswith(b"\xef\xbb\xbfstock_code,transaction_date,pattern_type,pattern_explanation") and "20260507" in raw.decode()
    assert spark.read.csv(a, header=True).first().stock_code == "1"
    assert zipfile.ZipFile(sinks.pack(a, b, f"{tmp_path}/out.zip")).namelist() == ["pattern.csv", "predict.csv"]
    sinks.write_batches(p, f"{tmp_path}/batches")
    assert spark.read.parquet(f"{tmp_path}/batches").count() == 1
    assert json.load(open(sinks.write_report(f"{tmp_path}/r.json", source="generated", rows=1)))["source"] == "generated"
    questions = spark.createDataFrame([("b", 1), ("a", 0)], "qid string, ordinal int")
    answers = spark.createDataFrame([("a", "A", 1, 2, 3), ("b", "B", 4, 5, 9)], "qid string, answer string, prompt_tokens long, completion_tokens long, total_tokens long")
    assert [(r.qid, r.total_tokens) for r in sinks.answer_table(answers, questions).collect()] == [("summary", 12), ("a", 3), ("b", 9)]


def test_days_with_reports_and_markers(spark, tmp_path):
    p = spark.createDataFrame([("1", d, "大单吸筹", "x") for d in ("2026-05-07", "2026-05-08")], "symbol string, date string, pattern_type string, pattern_explanation string")
    q = spark.createDataFrame([("1", "2026-05-07", "散户", "买入"), ("2", "2026-05-08", "散户", "买入")], "symbol string, date string, capital_type string, capital_intention string")
    report = sinks.write_days(p, q, str(tmp_path), ticks.GENERATED)
    assert report["20260507"]["rows"] == 1 and report["20260507"]["data_provenance"] == "generated" and "error" in report["20260508"]
    assert json.load(open(tmp_path / "batch_report.json")) == report
    assert (tmp_path / "20260507/SYNTHETIC_DO_NOT_SUBMIT.txt").exists() and zipfile.ZipFile(report["20260507"]["zip"]).namelist() == ["pattern_reco.csv", "predict_result.csv"]
    sinks.write_days(p.where("date = '2026-05-07'"), q.where("date = '2026-05-07'"), f"{tmp_path}/real", "vendor")
    assert not (tmp_path / "real/20260507/SYNTHETIC_DO_NOT_SUBMIT.txt").exists()
    with pytest.raises(ValueError):
        sinks.write_days(p, q, str(tmp_path), "vendor", most_days=1)


def test_documents(spark, tmp_path):
    for name, body in (("research/A1.txt", "text body"), ("other/a1.html", "<p>no</p>"), ("regulatory/B2.HTML", "<p>Rule</p>"), ("research/C3.pdf", "%PDF")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    wanted = spark.createDataFrame([("research", "a1"), ("regulatory", "b2"), ("research", "c3"), ("research", "zz")], "domain string, doc_id string")
    got = {r.doc_id: (r.text, r.status) for r in documents.texts(documents.resolve(wanted, documents.files(spark, str(tmp_path)))).collect()}
    tables = [[["h", "k"], ["value one", "value two"]], [["x"]]]
    readers = {"pdf": lambda raw: (raw.decode()[1:], tables)}
    read = {r.doc_id: (r.text, r.tables, r.status) for r in documents.texts(documents.resolve(wanted, documents.files(spark, str(tmp_path))), readers).collect()}
    assert read["c3"] == ("PDF", ["h | k\nvalue one | value two"], "ok") and read["a1"][2] == "ok" and read["zz"][2] == "missing" and len(read) == 4
    failing = documents.texts(documents.resolve(wanted, documents.files(spark, str(tmp_path))), {"pdf": lambda raw: raw.no_such}).collect()
    assert {r.doc_id: r.status for r in failing}["c3"] == "unreadable"
    assert got == {"a1": ("text body", "ok"), "b2": ("Rule", "ok"), "c3": (None, "unsupported"), "zz": (None, "missing")}
    (tmp_path / "q.json").write_text(json.dumps([{"qid": "1", "domain": "research", "question": "?", "options": {"A": "x"}, "answer_format": "mcq", "doc_ids": ["a1"]}]))
    assert documents.read_questions(spark, f"{tmp_path}/q.json", ["research"]).first().options == {"A": "x"}
    (tmp_path / "a.csv").write_text("qid,answer,total_tokens\nsummary,,9\n1,A,9\n")
    assert [r.qid for r in documents.read_answers(spark, f"{tmp_path}/a.csv").collect()] == ["1"]
    built = []
    make = lambda: built.append(1) or spark.createDataFrame([("d", "m", 0, "t", False, "", "r", "prose", 1)], documents.CHUNK_SCHEMA)
    assert [documents.cached_chunks(spark, f"{tmp_path}/cache", 3, make).count() for _ in range(2)] == [1, 1] and len(built) == 1


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", 60 * i, 10.0 + i % 3, float(i), float(i), 5.0 + i, 4.0) for i in range(200)]
    df = spark.createDataFrame(rows, "symbol string, sec long, price double, volume double, amount double, totalbidvolume double, totalaskvolume double").withColumn("ts", F.timestamp_seconds("sec"))
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = windowed_features(stream, "1 hour", "1 day").writeStream.format("memory").queryName("stream_test").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda d: sorted((r.symbol, r.start, r.n_snapshots, round(r.imbalance, 9), r.traded_volume) for r in d.collect())
    assert key(spark.table("stream_test")) == key(windowed_features(df, "1 hour"))
