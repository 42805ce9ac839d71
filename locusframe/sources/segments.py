"""Founder-segment text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.sources.text import Paths, blank_or_comment, numbered_lines, tokens, write_sorted

FOUNDERS_PREFIX = "# Founders:"
CHROMOSOMES_PREFIX = "# Chromosomes:"
# A chromosome heading without a number.
NO_NUMBER = -1
SEGMENT = r"^\s*([0-9.eE+-]+)\s+([0-9.eE+-]+)\s+(\S+)"


def read_founders(spark: SparkSession, path: Paths) -> DataFrame:
    """(founder, ord) from the founders lines, the first one of each file.

    The lists of several files follow each other in file order; a founder has
    the place where it is first named. The lists are header lines, so numbering
    them orders a small table.
    """
    named = numbered_lines(spark, path, F.col("value").startswith(FOUNDERS_PREFIX))
    heads = named.groupBy("file").agg(F.min_by("value", "line_no").alias("value"))
    names = tokens(F.substring_index("value", FOUNDERS_PREFIX, -1))
    listed = heads.select("file", F.posexplode(names).alias("at", "founder"))
    first = listed.groupBy("founder").agg(F.min(F.struct("file", "at")).alias("place"))
    return first.select("founder", (F.row_number().over(Window.orderBy("place")) - 1).alias("ord"))


def read_segment_header(spark: SparkSession, path: Paths) -> DataFrame:
    """(file, n_chroms, rec_rate, seed) from the first chromosomes line of each file; a part that is not there is null."""
    named = numbered_lines(spark, path, F.col("value").startswith(CHROMOSOMES_PREFIX))
    heads = named.groupBy("file").agg(F.min_by("value", "line_no").alias("value"))
    part = lambda label, kind: F.regexp_extract("value", label + r":\s*([0-9.eE+-]+)", 1).try_cast(kind)
    return heads.select(
        "file", part("Chromosomes", "int").alias("n_chroms"), part("RecRate", "double").alias("rec_rate"), part("Seed", "bigint").alias("seed")
    )


def read_segments(spark: SparkSession, path: Paths) -> DataFrame:
    """One row per segment line, numbered within its homolog.

    The individual, chromosome and homolog of a line come from the headings
    above it, carried across file splits, so neither a file nor an individual
    is gathered.  Segments before any chromosome heading belong to chromosome 1.
    """
    placed, homolog_here, chrom_here = _under_headings(spark, path)
    field = lambda n: F.regexp_extract("value", SEGMENT, n)
    origin = field(3)
    return placed.where(homolog_here & _readable()).select(
        F.col("ind.is").alias("ind"),
        F.when(chrom_here, F.nullif(F.col("chrom.is"), F.lit(NO_NUMBER))).otherwise(1).alias("chrom"),
        F.col("homolog.is").alias("homolog"),
        (F.col("line_no") - F.col("homolog.line_no")).cast("int").alias("seq"),
        field(1).try_cast("double").alias("start"),
        field(2).try_cast("double").alias("end"),
        F.substring_index(origin, ":", 1).alias("founder"),
        F.when(F.substring_index(origin, ":", -1) == "mat", 1).otherwise(0).alias("f_homolog"),
    )


def segment_rejects(spark: SparkSession, path: Paths) -> DataFrame:
    """(file, value) of the lines that ``read_segments`` leaves out.

    These are lines that are neither heading nor segment, segments whose bounds
    are no numbers, and segments that stand under no individual and homolog.
    """
    placed, homolog_here, _ = _under_headings(spark, path)
    heading = F.col("value").rlike(r"^Individual:|^\s*(Chromosome|Paternal|Maternal):")
    return placed.where(~heading & ~(F.coalesce(homolog_here, F.lit(False)) & _readable())).select("file", "value")


def _readable() -> Column:
    bound = lambda n: F.regexp_extract("value", SEGMENT, n).try_cast("double").isNotNull()
    return F.col("value").rlike(SEGMENT) & bound(1) & bound(2)


def _under_headings(spark: SparkSession, path: Paths) -> tuple[DataFrame, Column, Column]:
    """Lines with the headings above them; whether a homolog and a chromosome heading hold for a line."""
    value = F.col("value")
    placed = numbered_lines(
        spark,
        path,
        ~blank_or_comment(value),
        last={
            "ind": F.when(value.rlike(r"^Individual:"), F.regexp_extract("value", r"^Individual:\s*(\S+)", 1)),
            "chrom": F.when(
                value.rlike(r"^\s*Chromosome:"), F.coalesce(F.regexp_extract("value", r"Chromosome:\s*(\d+)", 1).try_cast("int"), F.lit(NO_NUMBER))
            ),
            "homolog": F.when(value.rlike(r"^\s*Paternal:"), 0).when(value.rlike(r"^\s*Maternal:"), 1),
        },
    )
    chrom_here = F.coalesce(F.col("chrom.line_no") > F.col("ind.line_no"), F.lit(False))
    homolog_here = F.col("homolog.line_no") > F.when(chrom_here, F.col("chrom.line_no")).otherwise(F.col("ind.line_no"))
    return placed, homolog_here, chrom_here


def write_segments(
    segments: DataFrame, founders: DataFrame, path: str, n_chroms: int | None = None, rec_rate: float | None = None, seed: int | None = None
) -> None:
    """The same layout, one row per output line and no grouping by individual.

    The header names the founders and, if any of the last three is given, the
    number of chromosomes (the highest one of ``segments`` if not given), the
    rate and the seed.
    """
    i = lambda n: F.lit(n)
    keys = ["part", "ind", "chrom", "homolog", "seq"]
    named = founders.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "founder"))), lambda f: f["founder"]).alias("names")
    )
    head = named.select(
        i(0).alias("part"), i("").alias("ind"), i(0).alias("chrom"), i(0).alias("homolog"), i(0).alias("seq"),
        F.concat_ws(" ", i(FOUNDERS_PREFIX), F.col("names")).alias("value"),
    )
    known = [f"RecRate: {rec_rate:.6f}"] if rec_rate is not None else []
    known += [f"Seed: {seed}"] if seed is not None else []
    count = segments.agg(F.coalesce(F.lit(n_chroms).cast("int"), F.max("chrom").cast("int"), F.lit(0)).alias("n"))
    chromosomes = count.select(
        i(0).alias("part"), i("").alias("ind"), i(0).alias("chrom"), i(0).alias("homolog"), i(-1).alias("seq"),
        F.concat_ws(" ", i(CHROMOSOMES_PREFIX), F.col("n").cast("string"), *[i(x) for x in known]).alias("value"),
    )
    people = segments.select("ind").distinct().select(
        i(1).alias("part"), "ind", i(-1).alias("chrom"), i(-1).alias("homolog"), i(-1).alias("seq"),
        F.concat(i("Individual: "), F.col("ind")).alias("value"),
    )
    chroms = segments.select("ind", "chrom").distinct().select(
        i(1).alias("part"), "ind", "chrom", i(-1).alias("homolog"), i(-1).alias("seq"),
        F.concat(i("  Chromosome: "), F.col("chrom")).alias("value"),
    )
    sides = segments.select("ind", "chrom", "homolog").distinct().select(
        i(1).alias("part"), "ind", "chrom", "homolog", i(-1).alias("seq"),
        F.when(F.col("homolog") == 0, "    Paternal:").otherwise("    Maternal:").alias("value"),
    )
    body = segments.select(
        i(1).alias("part"), "ind", "chrom", "homolog", "seq",
        F.format_string(
            "    %.6f %.6f %s:%s", "start", "end", "founder", F.when(F.col("f_homolog") == 1, "mat").otherwise("pat")
        ).alias("value"),
    )
    if known or n_chroms is not None:
        head = chromosomes.unionByName(head)
    rows = head.unionByName(people).unionByName(chroms).unionByName(sides).unionByName(body)
    write_sorted(rows, path, keys)
