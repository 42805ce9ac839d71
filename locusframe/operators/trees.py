"""Gene-tree operators over a table of Newick strings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions.newick import canonical_topology, parse_nodes

# Fixed values for four tips: expected shares of classes and of single
# topologies, and the 5 % critical values of chi-square by degrees of freedom.
CLASS_SHARE = {"balanced": 1 / 3, "caterpillar": 2 / 3}
TOPOLOGY_SHARE = {"balanced": 1 / 9, "caterpillar": 1 / 18}
CRITICAL_CLASS = 3.841
CRITICAL_BALANCED = 5.991
CRITICAL_CATERPILLAR = 19.675
CRITICAL_ALL = 23.685


def strip_lengths(newick: Column) -> Column:
    """The topology: branch lengths and the closing semicolon removed."""
    return F.trim(F.regexp_replace(F.regexp_replace(newick, r":\d+\.?\d*", ""), r";+\s*$", ""))


def tree_nodes(trees: DataFrame, keys: Sequence[str] = ("rep", "tree_no")) -> DataFrame:
    """One row per node: node, parent, name, branch_length, depth, level, is_leaf."""
    return trees.select(*keys, F.explode(parse_nodes("newick")).alias("n")).select(*keys, "n.*")


def leaf_counts(nodes: DataFrame, keys: Sequence[str] = ("rep", "tree_no")) -> DataFrame:
    return nodes.groupBy(*keys).agg(F.count_if("is_leaf").alias("n_leaves"))


def tree_heights(nodes: DataFrame, keys: Sequence[str] = ("rep", "tree_no")) -> DataFrame:
    """Longest root-to-tip path of each tree."""
    return nodes.groupBy(*keys).agg(F.max("depth").alias("height"))


def max_height(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.max("depth").alias("height"))


def time_from_present(nodes: DataFrame, keys: Sequence[str] = ("rep", "tree_no")) -> DataFrame:
    """Node ages: tree height less the depth of the node."""
    return nodes.join(tree_heights(nodes, keys), list(keys)).withColumn("age", F.col("height") - F.col("depth"))


def with_topology(trees: DataFrame) -> DataFrame:
    """Add ``topology``, its canonical form and its class.

    All tips at one level: balanced; otherwise caterpillar.
    """
    shaped = trees.withColumn("topology", strip_lengths(F.col("newick"))).withColumns(
        {"canonical": canonical_topology("topology"), "_nodes": parse_nodes("topology")}
    )
    tips = F.transform(F.filter("_nodes", lambda n: n["is_leaf"]), lambda n: n["level"])
    return shaped.withColumn(
        "shape", F.when(F.array_min(tips) == F.array_max(tips), "balanced").otherwise("caterpillar")
    ).drop("_nodes")


def _chi2(observed: Column, expected: Column) -> Column:
    return (observed - expected) * (observed - expected) / expected


def topology_counts(shaped: DataFrame) -> DataFrame:
    """(canonical, shape, observed): trees per canonical topology."""
    return shaped.groupBy("canonical", "shape").agg(F.count(F.lit(1)).alias("observed"))


def class_frequencies(counts: DataFrame) -> DataFrame:
    """Observed and expected trees per class, from topology counts."""
    total = counts.agg(F.sum("observed")).scalar()
    seen = counts.groupBy("shape").agg(F.sum("observed").alias("seen"))
    classes = counts.sparkSession.createDataFrame(list(CLASS_SHARE.items()), "shape string, share double")
    observed = F.coalesce("seen", F.lit(0).cast("bigint"))
    return (
        classes.join(seen, "shape", "left")
        .select(
            "shape", observed.alias("observed"), (F.col("share") * total).alias("expected"),
            "share", (observed / total).alias("freq"),
        )
        .withColumn("chi2", _chi2(F.col("observed"), F.col("expected")))
    )


def topology_frequencies(counts: DataFrame) -> DataFrame:
    """Observed and expected trees per canonical topology, from topology counts."""
    total = counts.agg(F.sum("observed")).scalar()
    share = F.when(F.col("shape") == "balanced", TOPOLOGY_SHARE["balanced"]).otherwise(TOPOLOGY_SHARE["caterpillar"])
    return counts.select(
        "canonical", "shape", "observed", (share * total).alias("expected"), (F.col("observed") / total).alias("freq")
    ).withColumn("chi2", _chi2(F.col("observed"), F.col("expected")))


def frequency_tests(classes: DataFrame, topologies: DataFrame) -> DataFrame:
    """Chi-square totals with their critical values: classes, each class, all."""
    by_class = classes.agg(F.sum("chi2").alias("chi2")).select(F.lit("classes").alias("test"), "chi2")
    within = topologies.groupBy("shape").agg(F.sum("chi2").alias("chi2")).select(F.col("shape").alias("test"), "chi2")
    overall = topologies.agg(F.sum("chi2").alias("chi2")).select(F.lit("all").alias("test"), "chi2")
    critical = (
        F.when(F.col("test") == "classes", CRITICAL_CLASS)
        .when(F.col("test") == "balanced", CRITICAL_BALANCED)
        .when(F.col("test") == "caterpillar", CRITICAL_CATERPILLAR)
        .otherwise(CRITICAL_ALL)
    )
    return (
        by_class.unionByName(within)
        .unionByName(overall)
        .withColumn("critical", critical)
        .withColumn("passed", F.col("chi2") < F.col("critical"))
    )
