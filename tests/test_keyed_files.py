"""Files by key: round trips, appends and overwrites by manifest, failed writes, foreign folders, pruning."""

import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from barloom.session import shared_dir
from barloom.sources import keyed

ROWS = [("a", 1, 1.5), ("a/b c", 2, None), ("é~", 3, 2.5), ("a", 4, 0.5), ("z", 5, 9.0)]


@pytest.fixture()
def folder(spark):
    keyed.register(spark)
    return shared_dir(spark, "keyed")


def write(df, folder, mode="append"):
    df.write.format("keyed_files").option("key", "code").mode(mode).save(folder)


def read(spark, folder, **options):
    return sorted(map(tuple, spark.read.format("keyed_files").options(**options).load(folder).collect()), key=str)


@pytest.mark.parametrize("parts", [1, 3])
def test_rows_come_back_with_their_key(spark, folder, parts):
    d = spark.createDataFrame(ROWS, "code string, n long, x double")
    write(d.repartition(parts, "code").sortWithinPartitions("code"), folder)
    assert read(spark, folder) == sorted(ROWS, key=str)
    assert len([f for f in os.listdir(folder) if f.endswith(".parquet")]) == 4
    assert read(spark, folder, keys=json.dumps(["a", "é~"])) == sorted((r for r in ROWS if r[0] in ("a", "é~")), key=str)
    assert read(spark, folder, keys="[]") == []
    one = spark.read.format("keyed_files").option("split", 1).schema("x double, code string").load(folder)
    assert one.rdd.getNumPartitions() == 4 and sorted(map(str, map(tuple, one.collect()))) == sorted(str((x, c)) for c, _, x in ROWS)


def test_append_adds_and_overwrite_replaces(spark, folder):
    d = spark.createDataFrame(ROWS, "code string, n long, x double")
    write(d, folder)
    write(d.where("code = 'a'"), folder)
    assert len(read(spark, folder)) == 7
    write(d.where("n = 5"), folder, "overwrite")
    assert read(spark, folder) == [("z", 5, 9.0)]
    assert len(os.listdir(folder)) == 2  # the file and the manifest


def test_a_failed_write_leaves_the_table_as_it_was(spark, folder):
    d = spark.createDataFrame(ROWS, "code string, n long, x double")
    write(d, folder)
    fails = F.udf(lambda n: 1 // (n - 5), "long")
    with pytest.raises(Exception):  # noqa: B017
        write(d.repartition(3, "n").withColumn("n", fails("n")), folder)
    with pytest.raises(Exception):  # noqa: B017
        write(spark.createDataFrame([(None, 1, 1.0)], d.schema), folder)
    assert read(spark, folder) == sorted(ROWS, key=str)


def test_a_folder_of_others_is_listed(spark, folder):
    os.makedirs(folder)
    for name, x in {"AAA": 1.0, "BBB": 2.0, "_combined": 3.0}.items():
        pq.write_table(pa.table({"x": [x, x + 0.5]}), f"{folder}/{name}.parquet")
    assert read(spark, folder, key="ticker") == [("AAA", 1.0), ("AAA", 1.5), ("BBB", 2.0), ("BBB", 2.5)]


def test_no_rows(spark, folder):
    d = spark.createDataFrame([], "code string, n long, x double")
    write(d, folder)
    assert spark.read.format("keyed_files").schema(d.schema).load(folder).collect() == []
