import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.functions import scalars as S
from locusframe.functions.newick import canonical, node_rows
from locusframe.operators import replicates as R
from locusframe.operators import trees as T
from locusframe.plans.topology import topology_report
from helpers import near, rows


@pytest.fixture
def times(spark):
    rng = random.Random(7)
    data = {s: [round(rng.expovariate(1 / 100), 1) for _ in range(n)] for s, n in (("a", 400), ("b", 30))}
    df = spark.createDataFrame([(s, i, v) for s, vs in data.items() for i, v in enumerate(vs)], "scenario string, rep bigint, metric double")
    return data, df


def test_summary(spark, times):
    data, df = times
    expected = spark.createDataFrame([("a", 100.0), ("b", 500.0)], "scenario string, expected double")
    got = {r.scenario: r for r in R.replicate_summary(df, expected).collect()}
    for s, v in data.items():
        r = got[s]
        assert r.n == len(v) and near(r.mean, np.mean(v)) and near(r.sd_pop, np.std(v)) and near(r.sd_samp, np.std(v, ddof=1))
        assert near(r.ci95, 1.96 * np.std(v) / math.sqrt(len(v))) and near(r.cv, np.std(v) / np.mean(v))
    assert got["a"].passed and not got["b"].passed


def test_ks_and_percentiles(times):
    data, df = times
    cdf = R.empirical_cdf(df)
    theta, tau = 100.0, 150.0
    two = {r.scenario: r for r in R.ks_statistic(cdf, F.lit(theta), two_sided=True).collect()}
    below = {s: np.sort([x for x in v if x < tau]) for s, v in data.items()}
    one = {r.scenario: r for r in R.ks_statistic(R.empirical_cdf(df.where(F.col("metric") < tau)), F.lit(theta), F.lit(tau)).collect()}
    pct = {(r.scenario, r.percent): r.value for r in R.percentiles(cdf, [0, 10, 50, 90, 100]).collect()}
    for s, v in data.items():
        x = np.sort(v)
        n = len(x)
        model = 1 - np.exp(-x / theta)
        want = max(np.max(np.arange(1, n + 1) / n - model), np.max(model - np.arange(0, n) / n))
        assert near(two[s].ks, want) and near(two[s].critical_05, 1.36 / math.sqrt(n))
        y = below[s]
        trunc = (1 - np.exp(-y / theta)) / (1 - np.exp(-tau / theta))
        assert near(one[s].ks, np.max(np.abs(np.arange(1, len(y) + 1) / len(y) - trunc)))
        for p in (0, 10, 50, 90, 100):
            assert near(pct[s, float(p)], np.percentile(x, p))


def test_proportion_t_and_invariants(times):
    data, df = times
    prop = {r.scenario: r for r in R.proportion_below(df, F.lit(80.0), F.lit(100.0)).collect()}
    t = {r.scenario: r.t for r in R.t_statistic(df, F.lit(100.0)).collect()}
    bad = {r.scenario: r for r in R.invariant_violations(df, F.lit(5.0)).collect()}
    for s, v in data.items():
        assert near(prop[s].proportion, np.mean(np.array(v) < 80)) and near(prop[s].expected, 1 - math.exp(-0.8))
        assert near(t[s], (np.mean(v) - 100) / (np.std(v, ddof=1) / math.sqrt(len(v))))
        assert bad[s].n_violations == sum(x < 4.99 for x in v) and bad[s].max == max(v)


def test_ratios_and_trend(spark):
    s = spark.createDataFrame([("a", 0.1, 10.0), ("b", 0.2, 19.0), ("c", 0.4, 70.0)], "scenario string, m double, mean double")
    got = {r.scenario: r for r in R.rate_ratios(s, "m").collect()}
    assert got["a"].ratio is None and got["b"].passed and not got["c"].passed
    assert rows(R.scenario_trend(s, "m", "mean"), "scenario", "as_expected") == [("a", True), ("b", True), ("c", True)]
    assert rows(R.scenario_trend(s, "m", "mean", rising=False), "as_expected") == [(False,), (False,), (True,)]


def test_expectations(spark):
    one = spark.range(1)
    n, x = F.lit(10), F.lit(1000.0)
    got = one.select(
        S.expected_tmrca(n, x), S.expected_tmrca_theta(n, x), S.expected_segregating_sites(n, F.lit(2.0)),
        S.truncated_exponential_cdf(S.truncated_exponential_quantile(F.lit(0.3), F.lit(50.0), F.lit(80.0)), F.lit(50.0), F.lit(80.0)),
        S.expected_segregating_sites(F.lit(2), F.lit(3.0)),
    ).first()
    assert [round(v, 9) for v in got] == [3600.0, 1800.0, round(2 * sum(1 / i for i in range(1, 10)), 9), 0.3, 3.0]


def test_newick_nodes():
    nodes = node_rows("((1:1,2:1):1,(3:1,4:1.5):1);")
    assert [n["name"] for n in nodes] == [None, None, "1", "2", None, "3", "4"]
    assert [n["depth"] for n in nodes] == [0, 1, 2, 2, 1, 2, 2.5]
    assert [n["parent"] for n in nodes] == [None, 0, 1, 1, 0, 4, 4]
    assert [n["is_leaf"] for n in nodes] == [False, False, True, True, False, True, True]
    named = node_rows("(A:0.1,B:x)root;")
    assert named[0]["name"] == "root" and named[2]["branch_length"] == 0.0
    assert node_rows("lonely;")[0]["name"] == "lonely"
    deep = "(" * 3000 + "1" + ",2)" * 3000 + ";"
    assert max(n["level"] for n in node_rows(deep)) == 3000


def test_canonical():
    assert canonical("((4,3),(2,1))") == "((1,2),(3,4))"
    assert canonical("(4,((1,3),2))") == "(((1,3),2),4)"
    assert canonical("((10,9),2)") == "((10,9),2)"


def test_tree_tables(spark):
    df = spark.createDataFrame(
        [("r", 1, "((1:1,2:1):1,(3:1,4:1):1);"), ("r", 2, "(((1:1,2:1):1,3:2):1,4:3);"), ("r", 3, "(4:3,(3:2,(2:1,1:1):1):1);")],
        "rep string, tree_no bigint, newick string",
    )
    nodes = T.tree_nodes(df)
    assert rows(T.leaf_counts(nodes), "tree_no", "n_leaves") == [(1, 4), (2, 4), (3, 4)]
    assert rows(T.tree_heights(nodes), "tree_no", "height") == [(1, 2.0), (2, 3.0), (3, 3.0)]
    assert T.max_height(nodes).first()[0] == 3.0
    ages = T.time_from_present(nodes).where("tree_no = 1 AND is_leaf").select("age").distinct()
    assert rows(ages) == [(0.0,)]
    shaped = T.with_topology(df)
    assert rows(shaped, "tree_no", "canonical", "shape") == [
        (1, "((1,2),(3,4))", "balanced"), (2, "(((1,2),3),4)", "caterpillar"), (3, "(((1,2),3),4)", "caterpillar"),
    ]
    classes, topologies, tests = topology_report(df)
    assert rows(classes, "shape", "observed", "expected") == [("balanced", 1, 1.0), ("caterpillar", 2, 2.0)]
    got = {r.test: (round(r.chi2, 6), r.passed) for r in tests.collect()}
    assert got["classes"] == (0.0, True)
    assert got["balanced"][0] == round((1 - 1 / 3) ** 2 / (1 / 3), 6)
    assert got["caterpillar"][0] == round((2 - 1 / 6) ** 2 / (1 / 6), 6)
