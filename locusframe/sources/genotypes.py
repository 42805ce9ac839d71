"""BA3 / Immanc genotype text, id lists and population maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.sources.text import Paths, blank_or_comment, lines, numbered_lines, tokens

# Characters allowed in labels and in alleles.
LABEL = r"[A-Za-z0-9,._-]+"
ALLELE = r"[A-Za-z0-9,.?]+"
GENOTYPE_LINE = rf"^\s*(?:{LABEL}\s+){{3}}{ALLELE}\s+{ALLELE}\s*$"


def read_genotypes(spark: SparkSession, path: Paths) -> tuple[DataFrame, DataFrame]:
    """(good, bad): individual, population, locus and two alleles per line.

    Lines that break the grammar are returned with their file, not dropped.
    """
    rows = lines(spark, path)
    ok = F.col("value").rlike(GENOTYPE_LINE)
    t = tokens(F.col("value"))
    good = rows.where(ok).select(
        t[1].alias("pop"), t[0].alias("ind"), t[2].alias("locus"), t[3].alias("allele1"), t[4].alias("allele2")
    )
    bad = rows.where(~ok).select("file", "value", F.size(t).alias("n_columns"))
    return good, bad


def write_genotypes(geno: DataFrame, path: str) -> None:
    """Tab-separated BA3 lines; NULL alleles are written as 0."""
    allele = lambda c: F.coalesce(F.col(c), F.lit("0"))
    geno.select(
        F.concat_ws("\t", "ind", "pop", "locus", allele("allele1"), allele("allele2")).alias("value")
    ).write.text(path)


def read_id_list(spark: SparkSession, path: Paths) -> DataFrame:
    """One id per line; blank lines are skipped and trailing blanks removed."""
    return (
        lines(spark, path)
        .select(F.regexp_replace("value", r"\s+$", "").alias("sample_id"))
        .where("sample_id <> ''")
    )


def read_pop_map(spark: SparkSession, path: Paths) -> DataFrame:
    """(line_no, pattern, pop) from ``regex population`` lines."""
    t = tokens(F.col("value"))
    return numbered_lines(spark, path, F.col("value").rlike(r"\S")).select(
        "line_no", t[0].alias("pattern"), F.get(t, F.lit(1)).alias("pop")
    )


def _bound(i: int) -> Column:
    return F.get(tokens(F.col("value")), F.lit(i)).try_cast("double")


def target_region_rejects(spark: SparkSession, path: Paths) -> DataFrame:
    """(file, value) of the lines that ``read_target_regions`` cannot read; comments and blank lines are none."""
    return lines(spark, path).where(~blank_or_comment(F.col("value")) & (_bound(0).isNull() | _bound(1).isNull())).select("file", "value")


def read_target_regions(spark: SparkSession, path: Paths) -> DataFrame:
    """(region_id, start, end) on the 0-1 scale; comments and blank lines are skipped, unreadable ones are rejects."""
    keep = ~blank_or_comment(F.col("value")) & _bound(0).isNotNull() & _bound(1).isNotNull()
    return numbered_lines(spark, path, keep).select(
        F.col("line_no").alias("region_id"), _bound(0).alias("start"), _bound(1).alias("end")
    )
