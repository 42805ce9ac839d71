"""Line-level helpers shared by the text readers and writers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from locusframe.session import materialize

Paths = str | list[str]


def logical_file(path: Column) -> Column:
    """The path, or for a part file that Spark wrote the folder it belongs to.

    Part files of one folder, in name order, are one text. Other files whose
    names begin with ``part-`` stay files of their own.
    """
    return F.regexp_replace(path, r"/part-\d{5}-[0-9a-f]{8}-[^/]*$", "")


def lines(spark: SparkSession, path: Paths) -> DataFrame:
    """(value, file): one row per line, without a trailing carriage return."""
    return spark.read.text(path).select(
        F.regexp_replace("value", r"\r$", "").alias("value"),
        logical_file(F.col("_metadata.file_path")).alias("file"),
    )


def numbered_lines(
    spark: SparkSession,
    path: Paths,
    keep: Column | None = None,
    sums: dict[str, Column] | None = None,
    last: dict[str, Column] | None = None,
) -> DataFrame:
    """(value, file, file_no, block, line_no): 1-based numbers of the kept lines per file.

    ``sums`` adds running sums over a file's kept lines up to and including each
    line. ``last`` adds, for each name, struct(is, line_no, the sums) of the last
    line at or before it whose value is not NULL. Both may use ``value``.

    Each file split is swept once, in the order it is read, while its lines are
    stored; one row per split carries numbers, sums and last values across the
    ends. No line is shuffled or sorted, and a sweep holds one batch.
    """
    sums, last = sums or {}, last or {}
    rows = spark.read.text(path).select(
        F.regexp_replace("value", r"\r$", "").alias("value"),
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
    )
    rows = rows if keep is None else rows.where(keep)
    rows = rows.select(
        "value", "_path", "_start", *[c.cast("bigint").alias(f"_sum_{n}") for n, c in sums.items()], *[c.alias(f"_is_{n}") for n, c in last.items()]
    )
    places = "".join(f", `_at_{n}` bigint" + "".join(f", `_at_{n}_{x}` bigint" for x in sums) for n in last)
    schema = StructType([*rows.schema.fields, *StructType.fromDDL("_split bigint, _line bigint" + places).fields])
    stored = materialize(rows.mapInArrow(_sweep(list(sums), list(last), schema), schema), "lines")

    mark = lambda n, line, of: F.struct(
        F.col(f"_is_{n}").alias("is"), (line + F.col(f"_at_{n}")).alias("line_no"), *[(of[x] + F.col(f"_at_{n}_{x}")).alias(x) for x in sums]
    )
    own = {n: F.when(F.col(f"_at_{n}").isNotNull(), mark(n, F.lit(0), dict.fromkeys(sums, F.lit(0)))) for n in last}
    splits = stored.groupBy("_split").agg(
        F.first("_path").alias("_path"),
        F.first("_start").alias("_start"),
        F.max("_line").alias("_lines"),
        *[F.max_by(F.col(f"_sum_{x}"), F.col("_line")).alias(f"_total_{x}") for x in sums],
        *[F.max_by(own[n], F.col("_line")).alias(f"_end_{n}") for n in last],
    )
    splits = splits.withColumn("file", logical_file(F.col("_path")))
    in_file = Window.partitionBy("file").orderBy("_path", "_start", "_split")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("bigint")
    splits = splits.select(
        "*", F.dense_rank().over(Window.orderBy("file")).alias("file_no"), F.row_number().over(in_file).alias("block"),
        upto("_lines").alias("_before"), *[upto(f"_total_{x}").alias(f"_before_{x}") for x in sums],
    )
    # The last lines of a split, in the numbers and sums of the file.
    shifted = lambda n: F.when(
        F.col(f"_end_{n}").isNotNull(),
        F.struct(
            F.col(f"_end_{n}.is").alias("is"),
            (F.col("_before") + F.col(f"_end_{n}.line_no")).alias("line_no"),
            *[(F.col(f"_before_{x}") + F.col(f"_end_{n}.{x}")).alias(x) for x in sums],
        ),
    )
    splits = splits.withColumns({f"_end_{n}": shifted(n) for n in last})
    splits = splits.withColumns({f"_carry_{n}": F.last(f"_end_{n}", ignorenulls=True).over(before) for n in last})
    carried = ["_before", *[f"_before_{x}" for x in sums], *[f"_carry_{n}" for n in last]]
    splits = materialize(splits.select("_split", "file", "file_no", "block", *carried), "line-splits")
    at = {x: F.col(f"_before_{x}") for x in sums}
    return stored.join(splits, "_split").select(
        "value",
        "file",
        "file_no",
        "block",
        (F.col("_before") + F.col("_line")).alias("line_no"),
        *[(F.col(f"_before_{x}") + F.col(f"_sum_{x}")).alias(x) for x in sums],
        *[F.when(F.col(f"_at_{n}").isNotNull(), mark(n, F.col("_before"), at)).otherwise(F.col(f"_carry_{n}")).alias(n) for n in last],
    )


def _sweep(sums: list[str], last: list[str], schema: StructType) -> Callable:
    """Numbers lines within their split and carries sums and last values along them."""
    out = to_arrow_schema(schema)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, key, line = TaskContext.get().partitionId() << 32, None, 0
        total, seen = {}, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            paths = batch.column("_path").dictionary_encode()
            codes, starts = paths.indices.to_numpy(), batch.column("_start").to_numpy()
            fresh = np.flatnonzero((codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])) + 1
            for low, high in zip([0, *fresh], [*fresh, batch.num_rows], strict=True):
                rows, n = batch.slice(low, high - low), high - low
                here = paths.dictionary[codes[low]].as_py(), int(starts[low])
                if here != key:
                    key, split, line = here, split + 1, 0
                    total = dict.fromkeys(sums, 0)
                    # The last value before the rows, its line (0: none) and the sums there.
                    seen = {c: (pa.nulls(1, batch.column(f"_is_{c}").type), 0, dict.fromkeys(sums, 0)) for c in last}
                columns = {c: rows.column(c) for c in rows.schema.names}
                lines = line + np.arange(1, n + 1)
                running = {x: total[x] + np.cumsum(columns[f"_sum_{x}"].fill_null(0).to_numpy()) for x in sums}
                for c in last:
                    value, at, of = seen[c]
                    own = columns[f"_is_{c}"]
                    index = np.maximum.accumulate(np.where(own.is_valid().to_numpy(zero_copy_only=False), np.arange(1, n + 1), 0))
                    filled = pa.concat_arrays([value, own]).take(pa.array(index))
                    at = np.append([at], lines)[index]
                    of = {x: np.append([of[x]], running[x])[index] for x in sums}
                    columns[f"_is_{c}"], columns[f"_at_{c}"] = filled, pa.array(at, mask=at == 0)
                    columns |= {f"_at_{c}_{x}": pa.array(of[x], mask=at == 0) for x in sums}
                    seen[c] = filled.slice(n - 1, 1), int(at[-1]), {x: int(of[x][-1]) for x in sums}
                columns |= {f"_sum_{x}": pa.array(running[x]) for x in sums}
                line, total = line + n, {x: int(running[x][-1]) for x in sums}
                columns |= {"_split": pa.array(np.full(n, split)), "_line": pa.array(lines)}
                yield pa.RecordBatch.from_arrays([columns[c].cast(out.field(c).type) for c in out.names], schema=out)

    return sweep


def tokens(value: Column) -> Column:
    """Fields between blanks; none for a blank line."""
    return F.filter(F.split(F.trim(F.regexp_replace(value, r"\s+", " ")), " "), lambda t: t != "")


def blank_or_comment(value: Column) -> Column:
    return value.rlike(r"^\s*(#|$)")


def write_sorted(rows: DataFrame, path: str, keys: list[str], partition: str | None = None) -> None:
    """Write the column ``value`` as text in key order.

    Rows are range-partitioned, so part files read in name order give the
    whole order and no task holds more than its range.
    """
    ordered = rows.repartitionByRange(*([partition] if partition else []), *keys).sortWithinPartitions(
        *([partition] if partition else []), *keys
    )
    columns = [partition, "value"] if partition else ["value"]
    writer = ordered.select(*columns).write
    if partition:
        writer = writer.partitionBy(partition)
    writer.text(path)
