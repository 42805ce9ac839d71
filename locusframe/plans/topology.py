"""Topology report over a table of trees."""

from __future__ import annotations

from pyspark.sql import DataFrame

from locusframe.operators import trees as T
from locusframe.session import materialize


def topology_report(trees: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, topologies, tests); the trees are parsed once."""
    counts = materialize(T.topology_counts(T.with_topology(trees)), "topologies")
    classes, topologies = T.class_frequencies(counts), T.topology_frequencies(counts)
    return classes, topologies, T.frequency_tests(classes, topologies)
