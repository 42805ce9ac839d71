"""Gene trees, their intervals and the logs of replicate runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.sources.text import Paths, blank_or_comment, lines, numbered_lines

INTERVAL = r"\[([0-9.]+),([0-9.]+)\]"

# Log labels and the columns they fill.
LOG_METRICS = {
    "tmrca": (r"Oldest_TMRCA:\s+([\d.]+)", "double"),
    "recomb": (r"No_Recombinations:\s+(\d+)", "bigint"),
    "mutations": (r"No_Mutations:\s+(\d+)", "bigint"),
    "num_mrcas": (r"No_MRCAs:\s+(\d+)", "bigint"),
    "youngest_tmrca": (r"Youngest_TMRCA:\s+([\d.]+)", "double"),
    "final_time": (r"Final time:\s+([\d.]+)", "double"),
}


def read_trees(spark: SparkSession, path: Paths) -> DataFrame:
    """(rep, tree_no, newick): one tree per line that is not blank or a comment."""
    return numbered_lines(spark, path, ~blank_or_comment(F.col("value"))).select(
        F.col("file").alias("rep"), F.col("line_no").alias("tree_no"), F.trim("value").alias("newick")
    )


def read_tree_intervals(spark: SparkSession, path: Paths) -> DataFrame:
    """(tree_no, lower, upper): the n-th interval belongs to the n-th tree."""
    bound = lambda i: F.regexp_extract("value", INTERVAL, i).try_cast("double")
    return numbered_lines(spark, path, F.col("value").rlike(INTERVAL)).select(
        F.col("line_no").alias("tree_no"), bound(1).alias("lower"), bound(2).alias("upper")
    )


def read_trees_with_intervals(spark: SparkSession, trees: str, intervals: str) -> DataFrame:
    """Trees beside the interval of the same order number."""
    return read_trees(spark, trees).join(read_tree_intervals(spark, intervals), "tree_no", "left").select(
        "rep", "tree_no", "lower", "upper", "newick"
    )


def read_interval_trees(spark: SparkSession, path: Paths) -> DataFrame:
    """(rep, lower, upper, newick) from ``[a,b] tree`` lines."""
    whole = rf"^{INTERVAL}\s+(.+)$"
    part = lambda i: F.regexp_extract("value", whole, i)
    return lines(spark, path).where(F.col("value").rlike(whole)).select(
        F.col("file").alias("rep"), part(1).try_cast("double").alias("lower"), part(2).try_cast("double").alias("upper"),
        F.trim(part(3)).alias("newick"),
    )


def read_replicate_logs(spark: SparkSession, path: Paths) -> DataFrame:
    """One row per log file; a metric that the log does not show is NULL.

    Lines are matched where they are read; the files are never read whole.
    """
    rows = lines(spark, path)
    found = [
        F.max(F.regexp_extract("value", pattern, 1).try_cast(kind)).alias(name)
        for name, (pattern, kind) in LOG_METRICS.items()
    ]
    return rows.groupBy(F.col("file").alias("log")).agg(*found)


def read_time_rows(spark: SparkSession, path: Paths) -> DataFrame:
    """(log, tmrca, tree_length) from ``time:`` rows."""
    number = lambda i: F.get(F.split("value", "\t"), F.lit(i)).try_cast("double")
    return lines(spark, path).where(F.col("value").startswith("time:")).select(
        F.col("file").alias("log"), number(1).alias("tmrca"), number(2).alias("tree_length")
    )
