import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.operators import ordered
from locusframe.operators.intervals import elementary_intervals, merge_adjacent, mrca_by_age
from helpers import rows


@pytest.fixture(params=["1", "4", "37"])
def ranges(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield int(request.param)
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("shape", ["outlier", "exponential", "ties"])
def test_hot_groups_are_cut_evenly(spark, shape):
    rng = random.Random(3)
    value = {
        "outlier": lambda i: 1e12 if i == 0 else float(i),
        "exponential": lambda i: rng.expovariate(1) ** 5,
        "ties": lambda i: float(i // 50),
    }[shape]
    data = [("hot", value(i)) for i in range(1000)] + [("cold", float(i)) for i in range(20)] + [("hot", None)]
    spark.conf.set("spark.sql.shuffle.partitions", "10")
    cut = ordered.in_order(spark.createDataFrame(data, "g string, v double"), ["g"], ["v"]).withColumn("part", F.spark_partition_id())
    sizes = [r["count"] for r in cut.groupBy("part").count().collect()]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == len(data) and len(sizes) >= 8 and max(sizes) <= 250


def test_merge_is_the_same_for_every_cut(spark, ranges):
    rng = random.Random(4)
    data = [(rng.choice(["a", "b", None]), i / 500, (i + 1) / 500, rng.choice(["x", "y", None])) for i in range(500)]
    data += [("c", i / 90, (i + 1) / 90, "x") for i in range(90)]
    df = spark.createDataFrame(data, "g string, start double, end double, origin string").repartition(7)
    for touching in (False, True):
        want = []
        for g in ("a", "b", None, "c"):
            last = None
            for _, start, end, origin in sorted((x for x in data if x[0] == g), key=lambda x: x[1]):
                if last and last[3] == origin and (not touching or last[2] == start):
                    last[2] = end
                else:
                    last = [g, start, end, origin]
                    want.append(last)
        got = merge_adjacent(df, ["g"], ["origin"], require_touching=touching).select("g", "start", "end", "origin").collect()
        assert sorted(map(repr, map(list, got))) == sorted(map(repr, want))


def test_neighbours_ranks_and_ages_equal_plain_windows(spark, ranges):
    rng = random.Random(6)
    data = [(rng.choice("hhhhhab"), rng.randrange(400) / 8, rng.randrange(1, 4)) for _ in range(700)]
    df = spark.createDataFrame(data, "g string, x double, n int").dropDuplicates(["g", "x"]).repartition(5)
    w = Window.partitionBy("g").orderBy("x")
    plain = df.select("g", "x", F.lead("x").over(w).alias("next")).where("next IS NOT NULL")
    assert rows(ordered.consecutive(df, ["g"], "x", "next")) == rows(plain)
    counted = df.withColumn("rank", F.sum("n").over(w) - F.col("n"))
    assert rows(ordered.rank_in_order(df, ["g"], ["x"], "n"), "g", "x", "rank") == rows(counted, "g", "x", "rank")
    assert rows(ordered.rank_in_order(df, ["g"], ["x"]), "g", "x", "rank") == rows(df.withColumn("rank", F.row_number().over(w) - 1), "g", "x", "rank")
    ends = elementary_intervals(df.select("g", F.col("x").alias("start"), (F.col("x") + 1).alias("end")), ["g"])
    points = {(g, v) for g, x, _ in data for v in (x, x + 1)}
    want = {(g, a, min(b for h, b in points if h == g and b > a)) for g, a in points if any(h == g and b > a for h, b in points)}
    assert {tuple(r) for r in ends.collect()} == want
    laid = df.select(F.col("g").alias("rep"), F.col("x").alias("age"), F.lit(0.0).alias("lower"), F.lit(0.5).alias("upper"))
    close = df.withColumn("fresh", F.when(F.col("x") - F.lag("x").over(w) < 0.3, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(w))
    grouped = close.groupBy("g", "run").agg(F.min("x").alias("age"), F.count("*").alias("n")).select("g", "age", "n")
    assert rows(mrca_by_age(laid, 0.3), "rep", "age", "num_ints") == rows(grouped, "g", "age", "n")
    nothing = df.limit(0)
    assert ordered.consecutive(nothing, ["g"], "x", "next").count() == 0 == ordered.rank_in_order(nothing, ["g"], ["x"]).count()


def test_merge_has_one_exchange_before_its_runs(spark):
    df = spark.range(100).selectExpr("'a' AS g", "id / 100.0 AS start", "(id + 1) / 100.0 AS end", "id % 3 AS origin")
    plan = ordered.in_order(df, ["g"], ["start"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan
