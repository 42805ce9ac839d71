"""Pedigree text: strict, relaxed and extended forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.operators.pedigree import generation_levels
from locusframe.sources.text import Paths, blank_or_comment, numbered_lines, tokens, write_sorted

NAME = r"[A-Za-z0-9_]+"
STRICT_LINE = rf"^[ \t]*{NAME}[ \t]+{NAME}[ \t]+{NAME}[ \t]*$"


def _known(name):
    return F.when(name != "0", name)


def read_pedigree(spark: SparkSession, path: Paths, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(pedigree, format errors).

    Strict: three alphanumeric names per line; blank lines pass and comments
    are errors.  Relaxed: blank and ``#`` lines are skipped, and a whole number
    in a fourth field is the population.  A parent ``0`` becomes NULL.  Errors
    carry the line number and the number of columns seen.
    """
    rows = numbered_lines(spark, path)
    value = F.col("value")
    t = tokens(value)
    if strict:
        skip, ok = value.rlike(r"^[ \t]*$"), value.rlike(STRICT_LINE)
        pop = F.lit(None).cast("int")
    else:
        skip, ok = blank_or_comment(value), F.size(t) >= 3
        pop = F.regexp_extract(F.coalesce(F.get(t, F.lit(3)), F.lit("")), r"^([+-]?\d+)", 1).try_cast("int")
    good = rows.where(~skip & ok).select(
        t[0].alias("ind"), _known(t[1]).alias("father"), _known(t[2]).alias("mother"), pop.alias("pop"), "line_no"
    )
    bad = rows.where(~skip & ~ok).select("file", "line_no", F.size(t).alias("n_columns"), "value")
    return good, bad


def write_pedigree(ped: DataFrame, path: str) -> None:
    """Parents before children; the population is written when there is one."""
    levels = generation_levels(ped).select("ind", "level")
    text = F.concat_ws(
        " ", "ind", F.coalesce("father", F.lit("0")), F.coalesce("mother", F.lit("0")), F.col("pop").cast("string")
    )
    rows = ped.join(levels, "ind").select("level", F.coalesce("pop", F.lit(-1)).alias("pop_key"), "ind", text.alias("value"))
    write_sorted(rows, path, ["level", "pop_key", "ind"])
