"""Registered queries on replicate statistics and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusframe import adapters as A
from locusframe.functions import scalars as S
from locusframe.operators import replicates as R
from locusframe.operators import trees as T
from locusframe.plans.topology import topology_report

THETA, TAU = 80.0, 120.0


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _expected(s, d):
    """Expected TMRCA per scenario, from the length of its name as sample count."""
    n = F.length("scenario")
    return A.replicates(s, d).select("scenario").distinct().withColumn("expected", S.expected_tmrca(n, F.lit(20.0)))


def _summary(s, d):
    return _rounded(
        R.replicate_summary(A.replicates(s, d), _expected(s, d)),
        "mean", "sd_pop", "sd_samp", "cv", "se", "ci95", "expected", "diff_pct",
    )


def _ratios(s, d):
    out = R.rate_ratios(R.replicate_summary(A.replicates(s, d)), "n")
    return _rounded(out.select("scenario", "n", "ratio", "expected_ratio", "passed"), "ratio", "expected_ratio")


def _trend(s, d):
    out = R.scenario_trend(R.replicate_summary(A.replicates(s, d)), "n", "cv", rising=False)
    return out.select("scenario", "n", "as_expected")


def _ks(s, d):
    cdf = R.empirical_cdf(A.replicates(s, d))
    return _rounded(R.ks_statistic(cdf, F.lit(THETA), two_sided=True), "ks", "critical_05", "critical_01")


def _ks_truncated(s, d):
    below = A.replicates(s, d).where(F.col("metric") < TAU)
    return _rounded(
        R.ks_statistic(R.empirical_cdf(below), F.lit(THETA), F.lit(TAU)), "ks", "critical_05", "critical_01"
    )


def _expectations(s, d):
    n = (F.col("c_custkey") % 30 + 2).alias("n")
    theta = F.col("c_nationkey") + 1.0
    x = A.table(s, d, "customer").select("c_custkey", n, theta.alias("theta"), (theta * 1.5).alias("tau"))
    n, theta, tau = F.col("n"), F.col("theta"), F.col("tau")
    return x.select(
        "c_custkey",
        F.round(S.expected_tmrca(n, theta), 6).alias("tmrca"),
        F.round(S.expected_tmrca_theta(n, theta), 6).alias("tmrca_theta"),
        F.round(S.expected_segregating_sites(n, theta), 6).alias("seg_sites"),
        F.round(S.truncated_exponential_mean(theta, tau), 6).alias("trunc_mean"),
        F.round(S.truncated_exponential_cdf(theta, theta, tau), 6).alias("trunc_cdf"),
        F.round(S.truncated_exponential_quantile(F.lit(0.5), theta, tau), 6).alias("trunc_median"),
    )


def _shaped(s, d):
    return T.with_topology(A.trees(s, d)).select("rep", "tree_no", "topology", "canonical", "shape")


QUERIES = {
    "replicate_summary": _summary,
    "rate_ratios": _ratios,
    "scenario_trend": _trend,
    "invariant_violations": lambda s, d: _rounded(
        R.invariant_violations(A.replicates(s, d), F.lit(5.0)), "mean"
    ),
    "empirical_cdf": lambda s, d: _rounded(R.empirical_cdf(A.replicates(s, d)), "cdf"),
    "ks_exponential": _ks,
    "ks_truncated_exponential": _ks_truncated,
    "percentiles": lambda s, d: _rounded(
        R.percentiles(R.empirical_cdf(A.replicates(s, d)), [10, 25, 50, 75, 90]), "value"
    ),
    "proportion_below": lambda s, d: _rounded(
        R.proportion_below(A.replicates(s, d), F.lit(TAU), F.lit(THETA)), "proportion", "expected"
    ),
    "t_statistic": lambda s, d: _rounded(R.t_statistic(A.replicates(s, d), F.lit(THETA)), "mean", "sd", "t"),
    "expectations": _expectations,
    "tree_nodes": lambda s, d: T.tree_nodes(A.trees(s, d)),
    "time_from_present": lambda s, d: T.time_from_present(T.tree_nodes(A.trees(s, d))).select(
        "rep", "tree_no", "node", "age"
    ),
    "leaf_counts": lambda s, d: T.leaf_counts(T.tree_nodes(A.trees(s, d))),
    "tree_heights": lambda s, d: T.tree_heights(T.tree_nodes(A.trees(s, d))),
    "max_height": lambda s, d: T.max_height(T.tree_nodes(A.trees(s, d))),
    "topologies": _shaped,
    "class_frequencies": lambda s, d: _rounded(
        topology_report(A.trees(s, d))[0], "expected", "share", "freq", "chi2"
    ),
    "topology_frequencies": lambda s, d: _rounded(topology_report(A.trees(s, d))[1], "expected", "freq", "chi2"),
    "topology_tests": lambda s, d: _rounded(topology_report(A.trees(s, d))[2], "chi2"),
}

_STATS = """
st AS (SELECT scenario, count(metric) AS n, avg(metric) AS mean, stddev_pop(metric) AS sd_pop,
              stddev_samp(metric) AS sd_samp FROM replicates GROUP BY scenario)"""

_ROWS = """
rw AS (SELECT scenario, metric, row_number() OVER (PARTITION BY scenario ORDER BY metric) AS i,
              count(*) OVER (PARTITION BY scenario) AS n FROM replicates {where})"""

_SHAPES = """
sh AS (SELECT rep, tree_no, balanced, newick,
   CASE WHEN balanced THEN '((' || t0 || ',' || t1 || '),(' || t2 || ',' || t3 || '))'
        ELSE '(((' || t0 || ',' || t1 || '),' || t2 || '),' || t3 || ')' END AS topology,
   '(' || least(t0, t1) || ',' || greatest(t0, t1) || ')' AS c1,
   '(' || least(t2, t3) || ',' || greatest(t2, t3) || ')' AS c2, t2, t3 FROM trees),
tp AS (SELECT rep, tree_no, topology, CASE WHEN balanced THEN 'balanced' ELSE 'caterpillar' END AS shape,
   CASE WHEN balanced THEN '(' || least(c1, c2) || ',' || greatest(c1, c2) || ')'
        ELSE '((' || c1 || ',' || t2 || '),' || t3 || ')' END AS canonical FROM sh)"""

_FREQ = _SHAPES + """,
tot AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM tp),
cl AS (SELECT v.shape, v.share, (SELECT count(*) FROM tp WHERE tp.shape = v.shape) AS observed
       FROM (VALUES ('balanced', 1.0::DOUBLE / 3), ('caterpillar', 2.0::DOUBLE / 3)) AS v(shape, share)),
cf AS (SELECT shape, observed, share * n AS expected, share, observed / n AS freq,
              (observed - share * n) ** 2 / (share * n) AS chi2 FROM cl, tot),
tq AS (SELECT canonical, shape, count(*) AS observed FROM tp GROUP BY canonical, shape),
tf AS (SELECT canonical, shape, observed, e * n AS expected, observed / n AS freq, (observed - e * n) ** 2 / (e * n) AS chi2
       FROM (SELECT *, CASE WHEN shape = 'balanced' THEN 1.0::DOUBLE / 9 ELSE 1.0::DOUBLE / 18 END AS e FROM tq), tot)"""

_NODES = """
nd AS (SELECT rep, tree_no, unnest(CASE WHEN balanced THEN [
    {'node': 0, 'parent': NULL, 'name': NULL, 'bl': 0, 'depth': 0, 'level': 0},
    {'node': 1, 'parent': 0, 'name': NULL, 'bl': h, 'depth': h, 'level': 1},
    {'node': 2, 'parent': 1, 'name': t0, 'bl': 1, 'depth': h + 1, 'level': 2},
    {'node': 3, 'parent': 1, 'name': t1, 'bl': 1, 'depth': h + 1, 'level': 2},
    {'node': 4, 'parent': 0, 'name': NULL, 'bl': h, 'depth': h, 'level': 1},
    {'node': 5, 'parent': 4, 'name': t2, 'bl': 1, 'depth': h + 1, 'level': 2},
    {'node': 6, 'parent': 4, 'name': t3, 'bl': 1, 'depth': h + 1, 'level': 2}]
  ELSE [
    {'node': 0, 'parent': NULL, 'name': NULL, 'bl': 0, 'depth': 0, 'level': 0},
    {'node': 1, 'parent': 0, 'name': NULL, 'bl': h, 'depth': h, 'level': 1},
    {'node': 2, 'parent': 1, 'name': NULL, 'bl': 1, 'depth': h + 1, 'level': 2},
    {'node': 3, 'parent': 2, 'name': t0, 'bl': 1, 'depth': h + 2, 'level': 3},
    {'node': 4, 'parent': 2, 'name': t1, 'bl': 1, 'depth': h + 2, 'level': 3},
    {'node': 5, 'parent': 1, 'name': t2, 'bl': 2, 'depth': h + 2, 'level': 2},
    {'node': 6, 'parent': 0, 'name': t3, 'bl': h + 2, 'depth': h + 2, 'level': 1}] END) AS s FROM trees),
nodes AS (SELECT rep, tree_no, CAST(s.node AS INTEGER) AS node, CAST(s.parent AS INTEGER) AS parent, CAST(s.name AS VARCHAR) AS name,
   CAST(s.bl AS DOUBLE) AS branch_length, CAST(s.depth AS DOUBLE) AS depth, CAST(s.level AS INTEGER) AS level,
   s.name IS NOT NULL AS is_leaf FROM nd)"""


def _ks_sql(where: str, cdf: str, low: str) -> str:
    return f"""
WITH {_ROWS.format(where=where)},
g AS (SELECT scenario, n, greatest(abs(CAST(i AS DOUBLE) / n - {cdf}), {low}) AS gap FROM rw)
SELECT scenario, n, round(max(gap), 6) AS ks, round(1.36 / sqrt(n), 6) AS critical_05, round(1.63 / sqrt(n), 6) AS critical_01,
       max(gap) < 1.36 / sqrt(n) AS passed FROM g GROUP BY scenario, n"""


_EXP = f"(1 - exp(-metric / {THETA}::DOUBLE))"
_TRUNC = f"({_EXP} / (1 - exp(-{TAU}::DOUBLE / {THETA}::DOUBLE)))"

_RAW = {
    "replicate_summary": (
        ["replicates"],
        f"""
WITH {_STATS}, ex AS (SELECT *, 80.0::DOUBLE * (1 - 1.0::DOUBLE / length(scenario)) AS expected FROM st)
SELECT scenario, n, round(mean, 6) AS mean, round(sd_pop, 6) AS sd_pop, round(sd_samp, 6) AS sd_samp,
       round(sd_pop / mean, 6) AS cv, round(sd_pop / sqrt(n), 6) AS se, round(1.96 * sd_pop / sqrt(n), 6) AS ci95,
       round(expected, 6) AS expected, round(100 * (mean - expected) / expected, 6) AS diff_pct,
       abs((mean - expected) / expected) < 0.1 AS passed FROM ex""",
    ),
    "rate_ratios": (
        ["replicates"],
        f"""
WITH {_STATS}, lg AS (SELECT *, lag(mean) OVER (ORDER BY n) AS pm, lag(n) OVER (ORDER BY n) AS pn FROM st)
SELECT scenario, n, round(mean / pm, 6) AS ratio, round(n / CAST(pn AS DOUBLE), 6) AS expected_ratio,
       abs(mean / pm - n / CAST(pn AS DOUBLE)) / (n / CAST(pn AS DOUBLE)) <= 0.3 AS passed FROM lg""",
    ),
    "scenario_trend": (
        ["replicates"],
        f"""
WITH {_STATS} SELECT scenario, n, coalesce(sd_pop / mean <= lag(sd_pop / mean) OVER (ORDER BY n), true) AS as_expected FROM st""",
    ),
    "invariant_violations": (
        ["replicates"],
        """
SELECT scenario, count(*) FILTER (WHERE metric < 5.0 - 0.01) AS n_violations, min(metric) AS min, max(metric) AS max,
       round(avg(metric), 6) AS mean, count(metric) AS n FROM replicates GROUP BY scenario""",
    ),
    "empirical_cdf": (
        ["replicates"],
        """
SELECT scenario, metric, copies, CAST(before - copies AS BIGINT) AS rank, CAST(n AS BIGINT) AS n, round(CAST(before AS DOUBLE) / n, 6) AS cdf
FROM (SELECT scenario, metric, copies, sum(copies) OVER (PARTITION BY scenario ORDER BY metric) AS before,
             sum(copies) OVER (PARTITION BY scenario) AS n
      FROM (SELECT scenario, metric, count(*) AS copies FROM replicates GROUP BY scenario, metric))""",
    ),
    "ks_exponential": (["replicates"], _ks_sql("", _EXP, f"abs(CAST(i - 1 AS DOUBLE) / n - {_EXP})")),
    "ks_truncated_exponential": (["replicates"], _ks_sql(f"WHERE metric < {TAU}", _TRUNC, "0.0::DOUBLE")),
    "percentiles": (
        ["replicates"],
        """
SELECT scenario, CAST(p AS DOUBLE) AS percent,
       round(CASE p WHEN 10 THEN quantile_cont(metric, 0.10) WHEN 25 THEN quantile_cont(metric, 0.25)
             WHEN 50 THEN quantile_cont(metric, 0.50) WHEN 75 THEN quantile_cont(metric, 0.75)
             ELSE quantile_cont(metric, 0.90) END, 6) AS value
FROM replicates, (VALUES (10), (25), (50), (75), (90)) AS v(p) GROUP BY scenario, p""",
    ),
    "proportion_below": (
        ["replicates"],
        f"""
SELECT scenario, count(*) FILTER (WHERE metric < {TAU}) AS n_below, count(*) AS n,
       round(count(*) FILTER (WHERE metric < {TAU}) / CAST(count(*) AS DOUBLE), 6) AS proportion,
       round(1 - exp(-{TAU}::DOUBLE / {THETA}::DOUBLE), 6) AS expected FROM replicates GROUP BY scenario""",
    ),
    "t_statistic": (
        ["replicates"],
        f"""
WITH {_STATS} SELECT scenario, n, round(mean, 6) AS mean, round(sd_samp, 6) AS sd,
       round((mean - {THETA}::DOUBLE) / (sd_samp / sqrt(n)), 6) AS t FROM st""",
    ),
    "expectations": (
        [],
        """
WITH x AS (SELECT c_custkey, c_custkey % 30 + 2 AS n, c_nationkey + 1.0::DOUBLE AS theta, (c_nationkey + 1.0::DOUBLE) * 1.5::DOUBLE AS tau FROM customer)
SELECT c_custkey, round(4 * theta * (1 - 1.0::DOUBLE / n), 6) AS tmrca, round(2 * theta * (1 - 1.0::DOUBLE / n), 6) AS tmrca_theta,
       round(theta * list_sum(list_transform(range(1, n), lambda i: 1.0::DOUBLE / i)), 6) AS seg_sites,
       round(theta * (1 - (tau / theta + 1) * exp(-tau / theta)) / (1 - exp(-tau / theta)), 6) AS trunc_mean,
       round((1 - exp(-1.0::DOUBLE)) / (1 - exp(-tau / theta)), 6) AS trunc_cdf,
       round(-theta * ln(1 - 0.5::DOUBLE * (1 - exp(-tau / theta))), 6) AS trunc_median FROM x""",
    ),
    "tree_nodes": (["trees"], f"WITH {_NODES} SELECT * FROM nodes"),
    "time_from_present": (
        ["trees"],
        f"WITH {_NODES} SELECT rep, tree_no, node, max(depth) OVER (PARTITION BY rep, tree_no) - depth AS age FROM nodes",
    ),
    "leaf_counts": (["trees"], "SELECT rep, tree_no, CAST(4 AS BIGINT) AS n_leaves FROM trees"),
    "tree_heights": (
        ["trees"],
        "SELECT rep, tree_no, CAST(CASE WHEN balanced THEN h + 1 ELSE h + 2 END AS DOUBLE) AS height FROM trees",
    ),
    "max_height": (["trees"], "SELECT CAST(max(CASE WHEN balanced THEN h + 1 ELSE h + 2 END) AS DOUBLE) AS height FROM trees"),
    "topologies": (["trees"], f"WITH {_SHAPES} SELECT * FROM tp"),
    "class_frequencies": (
        ["trees"],
        f"""
WITH {_FREQ} SELECT shape, observed, round(expected, 6) AS expected, round(share, 6) AS share, round(freq, 6) AS freq,
       round(chi2, 6) AS chi2 FROM cf""",
    ),
    "topology_frequencies": (
        ["trees"],
        f"""
WITH {_FREQ} SELECT canonical, shape, observed, round(expected, 6) AS expected, round(freq, 6) AS freq, round(chi2, 6) AS chi2 FROM tf""",
    ),
    "topology_tests": (
        ["trees"],
        f"""
WITH {_FREQ}, ts AS (
  SELECT 'classes' AS test, sum(chi2) AS chi2, 3.841::DOUBLE AS critical FROM cf
  UNION ALL SELECT shape, sum(chi2), CASE WHEN shape = 'balanced' THEN 5.991::DOUBLE ELSE 19.675::DOUBLE END FROM tf GROUP BY shape
  UNION ALL SELECT 'all', sum(chi2), 23.685::DOUBLE FROM tf)
SELECT test, round(chi2, 6) AS chi2, critical, chi2 < critical AS passed FROM ts""",
    ),
}

ORACLES = {name: A.with_tables(tables, body) for name, (tables, body) in _RAW.items()}
