import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from fixtures import rows
from tagrack.functions.ranking import positions, top_k


def test_positions_match_row_number_with_a_hot_group(spark):
    random.seed(7)
    data = [(0 if random.random() < 0.6 else random.randint(1, 5), random.randint(0, 50), i)
            for i in range(3000)]
    df = spark.createDataFrame(data, "g int, v int, id int").repartition(6)
    got = rows(positions(df, ["g"], ["v", "id"]), "g", "v", "id", "position")
    w = Window.partitionBy("g").orderBy("v", "id")
    want = rows(df.withColumn("position", F.row_number().over(w)), "g", "v", "id", "position")
    assert got == want


def test_positions_without_groups_and_with_null_keys(spark):
    df = spark.createDataFrame([(None, "b"), ("x", "a"), (None, "a"), ("x", "c")], "g string, v string")
    got = rows(positions(df, ["g"], ["v"]))
    assert got == [("x", "a", 1), ("x", "c", 2), (None, "a", 1), (None, "b", 2)]
    flat = rows(positions(df.select("v"), [], ["v"]))
    assert [p for _, p in flat] == [1, 2, 3, 4]


def test_top_k_literal_limit(spark):
    df = spark.createDataFrame([(1, i) for i in range(10)] + [(2, 5)], "g int, v int")
    got = rows(top_k(df, ["g"], [F.col("v").desc()], 2))
    assert got == [(1, 8, 2), (1, 9, 1), (2, 5, 1)]
