import random

from pyspark.sql import functions as F

from lattica.operators.ordinals import numbered


def test_ordinals_follow_the_order_over_many_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b", "ä", "𝒳", ""]), i, rng.randint(0, 3)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, id long, pos int").repartition(7)
    got = numbered(df, [F.col("k").asc_nulls_first(), F.col("id").desc()], "pos", 5)
    assert got.columns == ["k", "id", "pos"] and dict(got.dtypes)["pos"] == "bigint"
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", -r[1]))
    assert [(r["k"], r["id"]) for r in sorted(got.collect(), key=lambda r: r["pos"])] == [r[:2] for r in want]
    assert sorted(r["pos"] for r in got.collect()) == list(range(3000))


def test_one_hot_key_is_spread_by_the_rest_of_the_order(spark):
    df = spark.range(4000).select(F.lit("hot").alias("k"), "id")
    got = numbered(df, [F.col("k"), F.col("id")], "n", 4)
    assert got.filter("n <> id").count() == 0
    assert len({f.rsplit("/", 1)[1] for f in got.inputFiles()}) >= 3


def test_empty(spark):
    got = numbered(spark.createDataFrame([], "k string"), [F.col("k")])
    assert got.columns == ["k", "pos"] and got.collect() == []
