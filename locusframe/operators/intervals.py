"""Interval operators: clipping, merging, overlaying and region filters."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.operators.ordered import collapse_runs, consecutive, rank_in_order
from locusframe.session import materialize

# Most bins of a region filter; they only steer how the work is dealt out.
TARGET_BINS = 4096
# Elementary intervals are looked up in chunks of 2 ** CHUNK_LEVEL.
CHUNK_LEVEL = 10


def clip(df: DataFrame, low: float, high: float) -> DataFrame:
    """Rows overlapping [low, high), cut to it."""
    return df.where((F.col("end") > low) & (F.col("start") < high)).withColumns(
        {"start": F.greatest("start", F.lit(low)), "end": F.least("end", F.lit(high))}
    )


def merge_adjacent(
    df: DataFrame,
    group: Sequence[str],
    origin: Sequence[str],
    order: Sequence[str] = ("start",),
    require_touching: bool = False,
) -> DataFrame:
    """Collapse runs of consecutive rows with one origin; gaps are bridged.

    ``require_touching`` merges only rows that meet end to start.
    """
    touch = (lambda before, after: pc.equal(before.column("end").combine_chunks(), after.column("start").combine_chunks())) if require_touching else None
    order = [*order, *[c for c in ("end", *origin) if c not in order]]
    return collapse_runs(df, group, order, origin, {"start": "min", "end": "last"}, touch)


def elementary_intervals(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """[p, next p) between consecutive distinct endpoints of each group."""
    points = df.select(*group, F.explode(F.array("start", "end")).alias("start")).distinct()
    return consecutive(points, group, "start", "end")


def _cover(first: Column, last: Column) -> Column:
    """Dyadic blocks (level, block) that tile the integer range [first, last)."""

    def at(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), level)
        low = F.floor((first + size - 1) / size).cast("bigint")
        high = F.floor(last / size).cast("bigint")
        left = F.when((low < high) & (low % 2 == 1), F.struct(level.alias("level"), low.alias("block")))
        right = F.when((low < high) & (high % 2 == 1), F.struct(level.alias("level"), (high - 1).alias("block")))
        return F.array(left, right)

    levels = F.sequence(F.lit(0), F.ceil(F.log2(last + 1)).cast("int"))
    return F.array_compact(F.flatten(F.transform(levels, at)))


def overlay(
    df: DataFrame, group: Sequence[str], priority: str, payload: Sequence[str], keep: str = "first"
) -> DataFrame:
    """Non-overlapping intervals in which each point keeps one row of ``df``.

    ``keep='first'``: the covering row with the lowest ``priority``, so later
    rows only fill space not yet covered.  ``keep='last'``: the highest, so
    later rows overwrite.

    Work is (rows + endpoints) x log(endpoints) whatever the overlap: rows with
    equal extents are reduced first, each remaining row is written as a few
    dyadic blocks of endpoint ranks, and each elementary interval looks up the
    blocks above it.  Blocks larger than a chunk are handed down to chunks
    beforehand, so no lookup key is shared by more than one chunk of rows.
    """
    best = F.min if keep == "first" else F.max
    entry = F.struct(priority, *payload).alias("entry")
    rows = materialize(
        df.where("end > start").groupBy(*group, "start", "end").agg(best(entry).alias("entry")), "overlay-rows"
    )
    points = rows.select(*group, F.explode(F.array("start", "end")).alias("point")).distinct()
    points = materialize(rank_in_order(points, group, ["point"]), "overlay-points")
    low = points.select(*group, F.col("point").alias("start"), F.col("rank").alias("first"))
    high = points.select(*group, F.col("point").alias("end"), F.col("rank").alias("last"))
    blocks = (
        rows.join(low, [*group, "start"])
        .join(high, [*group, "end"])
        .select(*group, "entry", F.explode(_cover(F.col("first"), F.col("last"))).alias("b"))
        .groupBy(*group, F.col("b.level").alias("level"), F.col("b.block").alias("block"))
        .agg(best("entry").alias("entry"))
    )
    up = F.greatest(F.col("level") - CHUNK_LEVEL, F.lit(0))
    width = F.call_function("shiftleft", F.lit(1).cast("bigint"), up)
    spread = F.sequence(F.col("block") * width, (F.col("block") + 1) * width - 1)
    nodes = (
        blocks.withColumn("node", F.explode(spread))
        .groupBy(*group, F.least("level", F.lit(CHUNK_LEVEL)).alias("level"), "node")
        .agg(best("entry").alias("entry"))
    )
    ahead = points.select(*group, (F.col("rank") - 1).alias("rank"), F.col("point").alias("end"))
    pieces = points.withColumnRenamed("point", "start").join(ahead, [*group, "rank"])
    level = F.col("level")
    lookups = pieces.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(CHUNK_LEVEL)))).withColumn(
        "node", F.floor(F.col("rank") / F.call_function("shiftleft", F.lit(1).cast("bigint"), level)).cast("bigint")
    )
    painted = (
        lookups.join(nodes, [*group, "level", "node"])
        .groupBy(*group, "start", "end")
        .agg(best("entry").alias("entry"))
        .select(*group, "start", "end", f"entry.{priority}", *[f"entry.{c}" for c in payload])
    )
    return merge_adjacent(
        materialize(painted, "overlay-painted"), group, [priority, *payload], require_touching=True
    )


# ------------------------------------------------------------ region filters

def _region_cuts(regions: DataFrame, bins: int) -> list[float]:
    """Splits at quantiles of the region starts, so dense places have narrow bins, whatever the unit."""
    cuts = regions.select(F.col("start").cast("double").alias("start")).approxQuantile(
        "start", [i / bins for i in range(1, bins)] or [0.5], 1.0 / (4 * bins)
    )
    inner = sorted({c for c in cuts if math.isfinite(c)}) or [0.0]
    return [float("-inf"), *inner, float("inf")]


def _binned(df: DataFrame, value: str, cuts: list[float], name: str) -> DataFrame:
    """``df`` with the number of the split that holds ``value``; nulls and NaN have one of their own."""
    deal = Bucketizer(splits=cuts, inputCol="_cut_value", outputCol="_cut", handleInvalid="keep")
    dealt = deal.transform(df.withColumn("_cut_value", F.col(value).cast("double")))
    return dealt.withColumn(name, F.col("_cut").cast("bigint")).drop("_cut_value", "_cut")


def _regions_by_start(regions: DataFrame, cuts: list[float]) -> DataFrame:
    """Regions keyed by the bin of their start, plus one row per later bin.

    The extra row of bin b stands for every region that starts in an earlier
    bin and carries their largest end.  A point then needs its own bin only.
    """
    own = _binned(regions, "start", cuts, "bin").select("bin", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    own = materialize(own.groupBy("bin", "r_start").agg(F.max("r_end").alias("r_end")), "regions")
    ends = own.groupBy("bin").agg(F.max("r_end").alias("r_end"))
    every = regions.sparkSession.range(len(cuts) - 1).withColumnRenamed("id", "bin")
    earlier = Window.partitionBy().orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        every.join(ends, "bin", "left")
        .withColumn("r_end", F.max("r_end").over(earlier))
        .where("r_end IS NOT NULL")
        .select("bin", F.lit(float("-inf")).alias("r_start"), "r_end")
    )
    return materialize(own.unionByName(before), "regions-by-start")


def in_target_regions(df: DataFrame, regions: DataFrame, pos: str = "frac", bins: int = TARGET_BINS) -> DataFrame:
    """Rows whose position lies in a region, both ends included.

    Positions may be fractions or base pairs.  A table without regions keeps
    everything.  Neither side is expanded: each row has one bin, and a region
    set too large to broadcast is shuffled by bin.
    """
    if regions.isEmpty():
        return df
    cuts = _region_cuts(regions, bins)
    keyed = _regions_by_start(regions, cuts)
    p = F.col(pos)
    on = (F.col("_bin") == F.col("bin")) & (F.col("r_start") <= p) & (F.col("r_end") >= p)
    return _binned(df, pos, cuts, "_bin").join(keyed, on, "left_semi").drop("_bin")


def overlaps_targets(df: DataFrame, regions: DataFrame, bins: int = TARGET_BINS) -> DataFrame:
    """Half-open rows [start, end) that overlap a half-open region."""
    if regions.isEmpty():
        return df
    cuts = _region_cuts(regions, bins)
    keyed = _regions_by_start(regions, cuts)
    on = (F.col("_bin") == F.col("bin")) & (F.col("r_start") < F.col("end")) & (F.col("r_end") > F.col("start"))
    return _binned(df, "end", cuts, "_bin").join(keyed, on, "left_semi").drop("_bin")


def groups_overlapping(df: DataFrame, regions: DataFrame, group: Sequence[str]) -> DataFrame:
    """All rows of every group that has at least one overlapping row."""
    touched = overlaps_targets(df, regions).select(*group).distinct()
    return df.join(touched, list(group), "left_semi")


# ------------------------------------------------------------ MRCA summaries

def mrca_by_age(intervals: DataFrame, eps: float = 1e-8) -> DataFrame:
    """(rep, age, length, num_ints); ages closer than ``eps`` count as one."""
    ages = intervals.groupBy("rep", "age").agg(
        F.sum(F.col("upper") - F.col("lower")).alias("length"), F.count(F.lit(1)).alias("n")
    )
    close = lambda before, after: pc.less(
        pc.subtract(after.column("age").combine_chunks(), before.column("last").combine_chunks()), eps
    )
    ages = materialize(ages.select("rep", "age", F.col("age").alias("last"), "length", "n"), "ages")
    runs = collapse_runs(ages, ["rep"], ["age"], [], {"age": "min", "last": "last", "length": "sum", "n": "sum"}, close)
    return runs.select("rep", "age", "length", F.col("n").alias("num_ints"))


def mrca_summary(by_age: DataFrame) -> DataFrame:
    """Per replicate: youngest and mean age over distinct ages, extremes of length.

    The mean gives every distinct age one vote; ``weighted_tmrca`` weighs by length.
    """
    return by_age.groupBy("rep").agg(
        F.min("age").alias("youngest_tmrca"),
        F.avg("age").alias("avg_tmrca"),
        F.count(F.lit(1)).alias("n_mrcas"),
        F.max("length").alias("largest_mrca"),
        F.min("length").alias("smallest_mrca"),
        (F.sum(F.col("age") * F.col("length")) / F.nullif(F.sum("length"), F.lit(0.0))).alias("weighted_tmrca"),
    )


def mrca_regions(intervals: DataFrame) -> DataFrame:
    return intervals.select("rep", "lower", "upper", "age").orderBy("rep", "lower")


def mrca_overlay(intervals: DataFrame) -> DataFrame:
    """Intervals in insertion order, each filling only what is still empty."""
    named = intervals.select("rep", "ins_no", F.col("lower").alias("start"), F.col("upper").alias("end"), "age")
    return overlay(named, ["rep"], "ins_no", ["age"], "first").select(
        "rep", F.col("start").alias("lower"), F.col("end").alias("upper"), "age", "ins_no"
    )
