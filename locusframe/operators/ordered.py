"""Ordered operators that stay distributed when one group holds most rows.

A plain window sorts a whole group in one task.  Here the rows move once, into
ranges of (group, order) of about equal size; each range is swept in order, and
a row or two per range carry the state across its ends.  Where a source brings
its own buckets (blocks of lines, base ranges), the window runs inside each
bucket and one small row per bucket carries the state.  The results equal the
plain window for every layout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from locusframe.session import materialize

EDGES = "_part int, _edge int"


# One range exchange: the rows in order, whatever the groups look like


def in_order(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` sorted by (group, order) across partitions of about equal size, by one range exchange.

    The number of partitions is fixed, so they are not joined or split later.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *group, *order).sortWithinPartitions(*group, *order)


def _alike(before: pa.Table, after: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Whether rows agree in the named columns; nulls are alike."""
    same = np.ones(len(after), dtype=bool)
    for c in names:
        x, y = before.column(c).combine_chunks(), after.column(c).combine_chunks()
        equal = pc.or_(pc.fill_null(pc.equal(x, y), False), pc.and_(x.is_null(), y.is_null()))
        same &= equal.to_numpy(zero_copy_only=False)
    return same


def _runs(rows: pa.Table, same: Sequence[str], reduce: dict[str, str], meets: Callable | None) -> pa.Table:
    """Consecutive rows that belong together, reduced to one row each."""
    joined = np.zeros(len(rows), dtype=bool)
    before, after = rows.slice(0, len(rows) - 1), rows.slice(1)
    joined[1:] = _alike(before, after, same)
    if meets is not None:
        joined[1:] &= pc.fill_null(meets(before, after), False).to_numpy(zero_copy_only=False)
    numbered = rows.append_column("_run", pa.array(np.cumsum(~joined)))
    how = {c: reduce.get(c, "first") for c in rows.column_names}
    out = numbered.group_by("_run", use_threads=False).aggregate(list(how.items()))
    return pa.table([out.column(f"{c}_{h}") for c, h in how.items()], names=list(how)).cast(rows.schema)


def _folded(same: Sequence[str], reduce: dict[str, str], meets: Callable | None, edges: bool) -> Callable:
    """A sweep over a partition's rows in order; its first and last run are marked where ``edges``."""
    names = [*same, *reduce]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, first = None, True

        def out(runs: pa.Table, edge: list[int | None]) -> Iterator[pa.RecordBatch]:
            if edges:
                runs = runs.append_column("_part", pa.array([part] * len(runs), pa.int32())).append_column("_edge", pa.array(edge, pa.int32()))
            return runs.to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]).select(names)
            # The open run goes on as the first row of the next batch.
            runs = _runs(pa.concat_tables([held, rows]) if held else rows, same, reduce, meets)
            done, held = runs.slice(0, len(runs) - 1), runs.slice(len(runs) - 1)
            if len(done):
                yield from out(done, [0 if first else None, *[None] * (len(done) - 1)])
                first = False
        if held:
            yield from out(held, [1])

    return sweep


def collapse_runs(
    df: DataFrame, group: Sequence[str], order: Sequence[str], same: Sequence[str], reduce: dict[str, str], meets: Callable | None = None
) -> DataFrame:
    """Consecutive rows of a group, in ``order``, that agree in ``same`` become one row.

    ``reduce`` says how the other columns are reduced (min, max, sum, last).
    ``meets(before, after)``, on Arrow tables, may ask more of two neighbours.
    The rows move once, into ranges of (group, order); each range is swept, and
    the runs at its ends (two rows a range) are joined to those of its neighbours.
    """
    same = [*group, *[c for c in same if c not in group]]
    kept = df.select(*same, *reduce, *[c for c in order if c not in same and c not in reduce])
    schema = kept.select(*same, *reduce).schema
    marked = StructType([*schema.fields, *StructType.fromDDL(EDGES).fields])
    runs = materialize(in_order(kept, group, order).mapInArrow(_folded(same, reduce, meets, True), marked), "runs")
    ends = runs.where("_edge IS NOT NULL").repartition(1).sortWithinPartitions("_part", "_edge")

    def meets_across(before: pa.Table, after: pa.Table) -> pa.Array:
        # The first and the last run of one range have others between them.
        other = pc.not_equal(before.column("_part").combine_chunks(), after.column("_part").combine_chunks())
        return other if meets is None else pc.and_(other, meets(before, after))

    joined = StructType([*schema.fields, *StructType.fromDDL("_part int").fields])
    whole = ends.mapInArrow(_folded(same, {**reduce, "_part": "last"}, meets_across, False), joined)
    return runs.where("_edge IS NULL").select(*same, *reduce).unionByName(whole.drop("_part"))


def consecutive(df: DataFrame, group: Sequence[str], value: str, following: str) -> DataFrame:
    """(group, value, following) for every two neighbours of a group's sorted values; one range exchange."""
    schema = df.select(*group, value, F.col(value).alias(following)).schema
    marked = StructType([*schema.fields, *StructType.fromDDL(EDGES).fields])
    names = [*group, value]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = None

        def out(rows: pa.Table, ahead: pa.Array, edge: int | None) -> Iterator[pa.RecordBatch]:
            marks = [pa.array([x] * len(rows), pa.int32()) for x in (part, edge)]
            return pa.table([*rows.columns, ahead, *marks], names=[*names, following, "_part", "_edge"]).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]).select(names)
            if held is None:
                yield from out(rows.slice(0, 1), pa.nulls(1, rows.column(value).type), 0)
            else:
                rows = pa.concat_tables([held, rows])
            before, after = rows.slice(0, len(rows) - 1), rows.slice(1)
            pair = pa.array(_alike(before, after, group))
            yield from out(before.filter(pair), after.column(value).filter(pair), None)
            held = rows.slice(len(rows) - 1)
        if held is not None:
            yield from out(held, pa.nulls(1, held.column(value).type), 1)

    pairs = materialize(in_order(df.select(*names), group, [value]).mapInArrow(sweep, marked), "neighbours")
    # Two rows a range: the last value of one and the first of the next.
    across = Window.orderBy("_part", "_edge")
    ends = pairs.where("_edge IS NOT NULL").withColumn("_next", F.lead(F.struct(*names)).over(across))
    alike = F.lit(True)
    for c in group:
        alike = alike & F.col(c).eqNullSafe(F.col(f"_next.{c}"))
    met = ends.where((F.col("_edge") == 1) & F.col("_next").isNotNull() & alike).select(*names, F.col(f"_next.{value}").alias(following))
    return pairs.where("_edge IS NULL").select(*names, following).unionByName(met)


def rank_in_order(df: DataFrame, group: Sequence[str], order: Sequence[str], weight: str | None = None) -> DataFrame:
    """Add ``rank``, 0-based within the group; with ``weight`` a row stands for that many. One range exchange.

    Ranks are counted within a range; only groups that reach over its end, at
    most two a range, get the rows before it added.
    """
    schema = StructType([*df.schema.fields, *StructType.fromDDL("_inside bigint, _part int").fields])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, upto = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            w = rows.column(weight).to_numpy().astype(np.int64) if weight else np.ones(len(rows), dtype=np.int64)
            keys = rows.select(list(group))
            fresh = np.ones(len(rows), dtype=bool)
            fresh[1:] = ~_alike(keys.slice(0, len(rows) - 1), keys.slice(1), group)
            if last is not None:
                fresh[0] = not _alike(last, keys.slice(0, 1), group)[0]
            total = np.cumsum(w) + upto
            starts = np.flatnonzero(fresh)
            at = np.cumsum(fresh) - 1
            base = np.append((total - w)[starts], 0)[at]
            total = total - base
            yield from rows.append_column("_inside", pa.array(total - w)).append_column("_part", pa.array([part] * len(rows), pa.int32())).to_batches()
            last, upto = keys.slice(len(rows) - 1), int(total[-1])

    placed = materialize(in_order(df, group, order).mapInArrow(sweep, schema), "ranked")
    n = F.sum(weight) if weight else F.count(F.lit(1))
    sizes = placed.groupBy(*group, "_part").agg(n.alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = materialize(sizes.withColumn("_before", F.sum("_n").over(earlier)).where("_before > 0").select(*group, "_part", "_before"), "ranks-before")
    joined = placed.join(before, [*group, "_part"], "left")
    return joined.select(*df.columns, (F.col("_inside") + F.coalesce("_before", F.lit(0))).cast("bigint").alias("rank"))


# Windows over given buckets


def bucket_offsets(
    df: DataFrame, group: Sequence[str], bucket: str, weight: Column | None = None
) -> DataFrame:
    """One row per (group, bucket): rows in it, rows before it, rows in the group."""
    sizes = df.groupBy(*group, bucket).agg(
        F.sum(weight if weight is not None else F.lit(1).cast("bigint")).alias("in_bucket")
    )
    by_group = Window.partitionBy(*group)
    before = by_group.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        *group,
        bucket,
        "in_bucket",
        F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("before"),
        F.sum("in_bucket").over(by_group).alias("group_size"),
    )


def ranked(
    df: DataFrame,
    group: Sequence[str],
    bucket: str,
    order: Sequence[str],
    weight: str | None = None,
    keep_bucket: Callable[[Column, Column, Column], Column] | None = None,
) -> DataFrame:
    """Add ``rank`` (0-based, ties broken by ``order``) and ``group_size``.

    With ``weight`` a row stands for that many rows and ``rank`` is the rank of
    its first one.  ``keep_bucket(before, in_bucket, group_size)`` may drop
    whole buckets that cannot matter before anything is sorted.
    """
    offsets = bucket_offsets(df, group, bucket, F.col(weight) if weight else None)
    if keep_bucket is not None:
        offsets = offsets.where(keep_bucket(F.col("before"), F.col("in_bucket"), F.col("group_size")))
    keys = [*group, bucket]
    inside = Window.partitionBy(*keys).orderBy(*order)
    if weight:
        first = F.coalesce(
            F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        )
    else:
        first = F.row_number().over(inside) - 1
    return (
        df.join(offsets, keys)
        .withColumn("rank", (F.col("before") + first).cast("bigint"))
        .drop("before", "in_bucket", bucket)
    )


def with_neighbour(
    df: DataFrame,
    group: Sequence[str],
    bucket: str,
    order: Sequence[str],
    columns: Sequence[str],
    name: str,
    ahead: bool = False,
) -> DataFrame:
    """Add struct ``name`` holding ``columns`` of the previous (or next) row.

    NULL at the edge of the group.
    """
    keys = [*group, bucket]
    inside = Window.partitionBy(*keys).orderBy(*order)
    payload = F.struct(*columns)
    shift = F.lead if ahead else F.lag
    pick = F.min_by if ahead else F.max_by
    across = Window.partitionBy(*group).orderBy(bucket)
    carry = (
        df.groupBy(*keys)
        .agg(pick(payload, F.struct(*order)).alias("_edge"))
        .withColumn("_carry", shift("_edge").over(across))
        .drop("_edge")
    )
    return (
        df.withColumn(name, shift(payload).over(inside))
        .join(carry, keys)
        .withColumn(name, F.coalesce(F.col(name), F.col("_carry")))
        .drop("_carry")
    )


def with_running_sum(
    df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Add the running sum of ``value`` up to and including each row."""
    keys = [*group, bucket]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = bucket_offsets(df, group, bucket, F.col(value)).select(*keys, "before")
    return (
        df.withColumn("_inside", F.sum(value).over(inside))
        .join(before, keys)
        .withColumn(name, F.col("before") + F.col("_inside"))
        .drop("before", "_inside")
    )


def with_running_last(
    df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[str], values: dict[str, str]
) -> DataFrame:
    """Add, for each ``{value: name}``, the last non-NULL value at or before each row."""
    keys = [*group, bucket]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    edges = [
        F.max_by(F.col(v), F.when(F.col(v).isNotNull(), place)).alias(f"_edge_{name}") for v, name in values.items()
    ]
    carry = df.groupBy(*keys).agg(*edges).select(
        *keys, *[F.last(f"_edge_{name}", ignorenulls=True).over(across).alias(f"_carry_{name}") for name in values.values()]
    )
    seen = df.withColumns({name: F.last(v, ignorenulls=True).over(inside) for v, name in values.items()})
    return (
        seen.join(carry, keys)
        .withColumns({name: F.coalesce(name, f"_carry_{name}") for name in values.values()})
        .drop(*[f"_carry_{name}" for name in values.values()])
    )
