"""Scans, parsers and sinks on literal fixtures."""

import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from barloom.operators import clean
from barloom.session import shared_dir
from barloom.sources import parse, sinks


def _file(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return p


def test_locale_csv_with_bom_thousands_and_day_first(spark, tmp_path):
    _file(tmp_path, "UKX.csv", '﻿"Date","Price","Open","High","Low","Vol.","Change %"\n'
          '"15/01/2024","14,216.0","14,200.0","14,230.0","14,190.0","1.51M","0.1%"\n'
          '"12/01/2024","14,176.0","14,100.0","14,180.0","14,090.0","900.5K","0.2%"\n'
          '"11/01/2024","14,224.0","14,100.0","14,240.0","14,090.0","2","0.2%"\n')
    out = parse.read_parsed_folder(spark, str(tmp_path))
    got = rows(out.select("code", "date", "close"), "date")
    assert [g[2] for g in got] == [14224.0, 14176.0, 14216.0]
    assert got[0][:2] == ("UKX", dt.date(2024, 1, 11))


def test_bad_price_row_is_dropped_and_last_duplicate_wins(spark):
    raw = spark.createDataFrame([("a", "01/13/2024", "5", 1), ("a", "01/14/2024", "-", 2), ("a", "01/13/2024", "6", 3), ("a", "01/15/2024", "7", 4)], "code string, Date string, Price string, row_id int")
    got = rows(parse.parse_locale_prices(raw), "date")
    assert [(g[1].day, g[2]) for g in got] == [(13, 6.0), (15, 7.0)]


def test_day_first_probe(spark):
    raw = spark.createDataFrame([("a", "13/01/2024"), ("a", "01/02/2024"), ("b", "01/13/2024"), ("b", "02/01/2024")], "code string, Date string")
    assert dict(rows(parse.day_first_flags(raw, "code", "Date"))) == {"a": True, "b": False}


def test_unit_volume(spark):
    raw = spark.createDataFrame([("1.51M",), ("2K",), ("3B",), ("1,234",), ("x",)], "v string")
    from barloom.functions.columns import unit_number

    assert [r[0] for r in raw.select(unit_number("v")).collect()] == [1.51e6, 2e3, 3e9, 1234.0, None]


def test_macro_series_drops_dots(spark):
    raw = spark.createDataFrame([("2024-01-01", "1.5"), ("2024-01-02", "."), ("bad", "2")], "d string, v string")
    assert rows(parse.parse_macro(raw, "d", "v")) == [(dt.date(2024, 1, 1), 1.5)]


def test_statements_use_filing_date_or_lag(spark):
    bs = '{"2020-12-31": {"filing_date": "2021-03-01", "totalAssets": "10"}, "2021-12-31": {"totalAssets": "20"}}'
    inc = '{"2020-12-31": {"totalRevenue": "5"}}'
    raw = spark.createDataFrame([("a", bs, inc)], "code string, b string, i string")
    got = {r["fiscal_date"].year: r for r in parse.parse_statements(raw, "code", "b", "i").collect()}
    assert got[2020]["avail_date"] == dt.date(2021, 3, 1) and got[2020]["sales"] == 5.0
    assert got[2021]["avail_date"] == dt.date(2022, 4, 30) and got[2021]["sales"] is None


def test_file_per_key_scan_and_resume(spark, tmp_path):
    out = str(tmp_path / "p")
    spark.createDataFrame([(1.0,)], "x double").coalesce(1).write.parquet(out)
    got = parse.read_file_per_key(spark, out)
    assert got.count() == 1 and got.head()["code"].startswith("part-")
    uni = spark.createDataFrame([("a",), ("b",)], "code string")
    assert rows(sinks.todo(uni, uni.where("code = 'a'"), ["code"])) == [("b",)]


def test_upsert_is_idempotent_and_touches_only_its_partitions(spark):
    path = shared_dir(spark, "t")
    first = spark.createDataFrame([("a", 1, 1.0, "d1"), ("a", 2, 2.0, "d2")], "code string, ts int, px double, day string")
    fresh = spark.createDataFrame([("a", 2, 9.0, "d2"), ("a", 3, 3.0, "d2")], first.schema)
    sinks.upsert_partitions(spark, first, path, ["code", "ts"], "day")
    for _ in range(2):
        sinks.upsert_partitions(spark, fresh, path, ["code", "ts"], "day")
    assert rows(spark.read.parquet(path).select("ts", "px"), "ts") == [(1, 1.0), (2, 9.0), (3, 3.0)]


def test_csv_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    sinks.write_table(df, str(tmp_path / "c"), fmt="csv")
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).head()["v"] == "1"


def test_wick_repair(spark):
    d = spark.createDataFrame([(461.0, 465.0, 4.7, 462.0), (100.0, 10000.0, 99.0, 101.0), (100.0, 150.0, 60.0, 120.0)], "open double, high double, low double, close double")
    got = [(r["low"], r["high"]) for r in clean.wick_repair(d).collect()]
    assert got == [(461.0, 465.0), (99.0, 101.0), (60.0, 150.0)]


def test_winsorise_keeps_null(spark):
    d = spark.createDataFrame([(None,), (2.0,), (-3.0,), (0.1,)], "x double")
    assert [r[0] for r in d.select(clean.winsorise("x")).collect()] == [None, 0.6, -0.6, 0.1]


def test_keep_last_by_ingest_order(spark):
    d = spark.createDataFrame([("a", 1, 5.0, 2), ("a", 1, 4.0, 1), ("b", 1, 7.0, 1)], "code string, ts int, px double, seq int")
    assert rows(clean.keep_last(d, ["code", "ts"], "seq").select("code", "px"), "code") == [("a", 5.0), ("b", 7.0)]


def test_contiguous_prefix_stops_at_gap(spark):
    d = spark.createDataFrame([("s", x) for x in (5, 6, 7, 9)] + [("t", x) for x in (6, 7, 8, 9)], "session string, slot int")
    got = rows(clean.contiguous_prefix(d, "slot", ["session"], 5, 3).select("session", "slot"), "slot")
    assert got == [("s", 5), ("s", 6), ("s", 7)]


def test_era_and_time_split(spark):
    d = spark.createDataFrame([(dt.date(2024, 1, i),) for i in range(1, 11)], "date date")
    got = clean.time_quantile_split(d, frac=0.6)
    assert got.where("is_train").count() == 6
    e = d.withColumn("e", clean.era_of("date", [("a", "2024-01-01", "2024-01-03")]))
    assert e.where(F.col("e") == "a").count() == 3
