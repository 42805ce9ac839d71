"""Statistics over replicate tables (scenario, rep, metric)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.functions.scalars import Z_95, exponential_cdf, truncated_exponential_cdf
from locusframe.operators.ordered import rank_in_order

# Coefficients of the KS critical value at 5 % and 1 %.
KS_05, KS_01 = 1.36, 1.63


def replicate_summary(
    replicates: DataFrame, expected: DataFrame | None = None, tolerance: float = 0.10
) -> DataFrame:
    """Per scenario: n, mean, deviations, CV, standard error and 95 % interval.

    With ``expected`` (scenario, expected) also the difference in percent and
    whether it is within ``tolerance``.  The standard error uses the population
    deviation.
    """
    stats = replicates.groupBy("scenario").agg(
        F.count("metric").alias("n"),
        F.avg("metric").alias("mean"),
        F.stddev_pop("metric").alias("sd_pop"),
        F.stddev_samp("metric").alias("sd_samp"),
    )
    mean = F.col("mean")
    stats = stats.withColumns(
        {
            "cv": F.when(mean > 0, F.col("sd_pop") / mean).otherwise(0.0),
            "se": F.col("sd_pop") / F.sqrt("n"),
        }
    ).withColumn("ci95", F.lit(Z_95) * F.col("se"))
    if expected is None:
        return stats
    diff = (mean - F.col("expected")) / F.nullif(F.col("expected"), F.lit(0.0))
    return stats.join(expected, "scenario", "left").withColumns(
        {"diff_pct": 100.0 * diff, "passed": F.abs(diff) < tolerance}
    )


def scenario_trend(summary: DataFrame, parameter: str, value: str, rising: bool = True) -> DataFrame:
    """Whether ``value`` never falls (or never rises) as ``parameter`` grows."""
    order = Window.partitionBy().orderBy(parameter)
    previous = F.lag(value).over(order)
    ok = (F.col(value) >= previous) if rising else (F.col(value) <= previous)
    return summary.withColumn("as_expected", F.coalesce(ok, F.lit(True)))


def rate_ratios(summary: DataFrame, parameter: str, tolerance: float = 0.30) -> DataFrame:
    """Mean over the previous scenario's mean, against the ratio of parameters.

    ``summary`` has one row per scenario.
    """
    order = Window.partitionBy().orderBy(parameter)
    prev_mean, prev_par = F.lag("mean").over(order), F.lag(parameter).over(order)
    ratio = F.when(prev_mean > 0, F.col("mean") / prev_mean)
    expected = F.when(prev_mean > 0, F.col(parameter) / prev_par)
    return summary.withColumns({"ratio": ratio, "expected_ratio": expected}).withColumn(
        "passed", F.abs(F.col("ratio") - F.col("expected_ratio")) / F.col("expected_ratio") <= tolerance
    )


def invariant_violations(replicates: DataFrame, floor: Column, slack: float = 0.01) -> DataFrame:
    """Rows whose metric is below ``floor`` by more than ``slack``, with extremes."""
    return replicates.groupBy("scenario").agg(
        F.count_if(F.col("metric") < floor - slack).alias("n_violations"),
        F.min("metric").alias("min"),
        F.max("metric").alias("max"),
        F.avg("metric").alias("mean"),
        F.count("metric").alias("n"),
    )


def empirical_cdf(replicates: DataFrame) -> DataFrame:
    """(scenario, metric, copies, rank, n, cdf) with one row per distinct value.

    Equal values are counted before anything is sorted, and values are ranked in ranges.
    """
    values = replicates.where("metric IS NOT NULL").groupBy("scenario", "metric").agg(F.count(F.lit(1)).alias("copies"))
    placed = rank_in_order(values, ["scenario"], ["metric"], weight="copies")
    sizes = placed.groupBy("scenario").agg(F.sum("copies").alias("n"))
    return placed.join(sizes, "scenario").withColumn("cdf", (F.col("rank") + F.col("copies")) / F.col("n"))


def ks_statistic(cdf: DataFrame, theta: Column, tau: Column | None = None, two_sided: bool = False) -> DataFrame:
    """Largest |i/n - F(t)| over the sorted values, with the critical values.

    F is exponential with mean ``theta``, truncated at ``tau`` when given.
    ``two_sided`` also looks at the foot of each step, (i-1)/n.
    """
    t = F.col("metric")
    model = exponential_cdf(t, theta) if tau is None else truncated_exponential_cdf(t, theta, tau)
    low_step = F.col("rank") / F.col("n") if two_sided else (F.col("rank") + 1) / F.col("n")
    gap = F.greatest(F.abs(F.col("cdf") - model), F.abs(low_step - model))
    n = F.sqrt(F.col("n").cast("double"))
    return cdf.groupBy("scenario", "n").agg(F.max(gap).alias("ks")).withColumns(
        {
            "critical_05": F.lit(KS_05) / n,
            "critical_01": F.lit(KS_01) / n,
            "passed": F.col("ks") < F.lit(KS_05) / n,
        }
    )


def percentiles(cdf: DataFrame, percents: Sequence[int]) -> DataFrame:
    """Exact percentiles by linear interpolation between order statistics."""
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in percents]))
    spot = F.col("percent") / 100.0 * (F.col("n") - 1)
    near = cdf.withColumn("percent", wanted).withColumn("spot", spot)
    holds = lambda r: (F.col("rank") <= r) & (r < F.col("rank") + F.col("copies"))
    below, above = F.floor("spot"), F.ceil("spot")
    return (
        near.where(holds(below) | holds(above))
        .groupBy("scenario", "percent", "spot")
        .agg(F.max(F.when(holds(below), F.col("metric"))).alias("lo"), F.max(F.when(holds(above), F.col("metric"))).alias("hi"))
        .select("scenario", "percent", (F.expr("lo + (hi - lo) * (spot - floor(spot))")).alias("value"))
    )


def proportion_below(replicates: DataFrame, tau: Column, theta: Column) -> DataFrame:
    """Share of values below ``tau`` beside 1 - exp(-tau/theta)."""
    return replicates.groupBy("scenario").agg(
        F.count_if(F.col("metric") < tau).alias("n_below"), F.count("metric").alias("n")
    ).withColumns(
        {"proportion": F.col("n_below") / F.col("n"), "expected": 1 - F.exp(-tau / theta)}
    )


def t_statistic(replicates: DataFrame, expected: Column) -> DataFrame:
    """One-sample t of the scenario mean against ``expected``."""
    return replicates.groupBy("scenario").agg(
        F.count("metric").alias("n"), F.avg("metric").alias("mean"), F.stddev_samp("metric").alias("sd")
    ).withColumn(
        "t", (F.col("mean") - expected) / F.nullif(F.col("sd") / F.sqrt("n"), F.lit(0.0))
    )
