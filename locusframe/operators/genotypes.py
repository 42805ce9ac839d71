"""Operators on the long genotype table (pop, ind, locus, allele1, allele2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.functions.scalars import MISSING_ALLELES, Z_95, called, is_het, null_missing, proportion_interval
from locusframe.session import materialize


def _alleles() -> tuple[Column, Column]:
    return F.col("allele1"), F.col("allele2")


def with_missing_as_null(geno: DataFrame) -> DataFrame:
    a1, a2 = _alleles()
    return geno.withColumns({"allele1": null_missing(a1), "allele2": null_missing(a2)})


def typed(geno: DataFrame) -> DataFrame:
    """Rows with both alleles called, plus an ``is_het`` flag."""
    a1, a2 = _alleles()
    clean = with_missing_as_null(geno)
    return clean.where(called(a1, a2)).withColumn("is_het", a1 != a2)


def duplicate_genotypes(geno: DataFrame) -> DataFrame:
    """Every (pop, ind, locus) that occurs more than once."""
    return (
        geno.groupBy("pop", "ind", "locus")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .where(F.col("n_rows") > 1)
    )


def population_list(geno: DataFrame) -> DataFrame:
    return geno.select("pop").distinct().orderBy("pop")


def individual_list(geno: DataFrame) -> DataFrame:
    """Individuals are labelled within a population."""
    return geno.select("pop", "ind").distinct().orderBy("pop", "ind")


def locus_list(geno: DataFrame) -> DataFrame:
    return geno.select("locus").distinct().orderBy("locus")


def dataset_summary(geno: DataFrame) -> DataFrame:
    """Per population: individuals; beside it the data-set totals.

    Distinct (pop, ind) pairs are found before anything is grouped by ``pop``,
    so a dominant population is counted by many tasks.
    """
    n_loci = geno.agg(F.count_distinct("locus")).scalar()
    everything = Window.partitionBy()
    return (
        geno.groupBy("pop")
        .agg(F.count_distinct("ind").alias("n_ind"))
        .withColumns(
            {
                "n_loci": n_loci,
                "n_pop": F.count(F.lit(1)).over(everything),
                "tot_ind": F.sum("n_ind").over(everything),
            }
        )
    )


def locus_summary(geno: DataFrame) -> DataFrame:
    """Alleles per locus, on raw symbols.

    The list shows the missing symbols that occurred as well, and is empty when
    the locus has no called allele.
    """
    a1, a2 = _alleles()
    symbols = (
        geno.select("locus", F.explode(F.array(a1, a2)).alias("allele"))
        .groupBy("locus", "allele")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    missing = F.col("allele").isin(*MISSING_ALLELES)
    return (
        symbols.groupBy("locus")
        .agg(
            F.count_if(~missing).alias("n_alleles"),
            F.bool_or(missing).alias("has_missing"),
            F.sort_array(F.collect_list("allele")).alias("alleles"),
        )
        .withColumn("alleles", F.when(F.col("n_alleles") > 0, F.col("alleles")).otherwise(F.array().cast("array<string>")))
    )


def drop_empty_loci(geno: DataFrame) -> DataFrame:
    """Drop the loci at which no allele was called in any individual."""
    a1, a2 = _alleles()
    empty = (
        geno.groupBy("locus")
        .agg(F.count(F.coalesce(null_missing(a1), null_missing(a2))).alias("n"))
        .where("n = 0")
        .select("locus")
    )
    return geno.join(materialize(empty, "empty-loci"), "locus", "left_anti")


def complete_grid(cells: DataFrame, row: str = "locus", across: str = "pop") -> DataFrame:
    """Every ``across`` value at every ``row`` value; absent cells are NULL.

    ``cells`` must already be aggregated to one row per cell and is read from
    the shared folder, so the raw table behind it is scanned once.
    """
    labels = cells.select(across).distinct().agg(F.sort_array(F.collect_list(across))).scalar()
    grid = cells.select(row).distinct().withColumn(across, F.explode(labels))
    return grid.join(cells, [across, row], "left")


def heterozygosity(geno: DataFrame, by: str = "ind") -> DataFrame:
    """Observed heterozygosity with its 95 % half width; NULL when untyped.

    ``by='ind'``: per individual over loci.  ``by='locus'``: per population and
    locus, on the full population x locus grid.
    """
    a1, a2 = _alleles()
    clean = with_missing_as_null(geno)
    counts = clean.groupBy("pop", by).agg(
        F.count_if(called(a1, a2)).alias("n_typed"), F.count_if(is_het(a1, a2)).alias("n_het")
    )
    if by == "locus":
        counts = complete_grid(materialize(counts, "het-cells")).fillna(0, ["n_typed", "n_het"])
    share, half = proportion_interval(F.col("n_het"), F.col("n_typed"))
    return counts.select("pop", by, "n_typed", share.alias("het"), half.alias("half_width"))


def _copies(entries: Column, wanted) -> Column:
    picked = F.filter(entries, wanted)
    return F.aggregate(picked, F.lit(0).cast("bigint"), lambda acc, e: acc + e["n"])


def hwe_disequilibrium(geno: DataFrame, min_count: int = 5) -> DataFrame:
    """Additive disequilibrium D of one target allele per population and locus.

    The target is the first allele of the population's first individual in byte
    order; when that individual has no such row or allele the cell is NULL, as
    it is when either genotype class has fewer than ``min_count`` members.

    The raw table is reduced once, to counts per distinct genotype; the target
    is applied to those counts.
    """
    clean = with_missing_as_null(geno)
    kinds = clean.groupBy("pop", "locus", "allele1", "allele2").agg(
        F.count(F.lit(1)).alias("n"), F.min("ind").alias("first_ind")
    )
    cells = materialize(
        kinds.groupBy("pop", "locus").agg(
            F.min(F.struct("first_ind", "allele1")).alias("lead"),
            F.collect_list(F.struct("allele1", "allele2", "n")).alias("entries"),
        ),
        "hwe-cells",
    )
    first = cells.groupBy("pop").agg(F.min("lead.first_ind").alias("pop_first"))
    target = F.when(F.col("lead.first_ind") == F.col("pop_first"), F.col("lead.allele1"))
    e = F.col("entries")
    t = F.col("target")
    both = lambda x: x["allele1"].isNotNull() & x["allele2"].isNotNull()
    counted = (
        complete_grid(cells)
        .join(first, "pop")
        .withColumn("target", target)
        .withColumns(
            {
                "n_typed": F.coalesce(_copies(e, both), F.lit(0).cast("bigint")),
                "n11": _copies(e, lambda x: both(x) & (x["allele1"] == t) & (x["allele2"] == t)),
                "n12": _copies(e, lambda x: both(x) & ((x["allele1"] == t) != (x["allele2"] == t))),
            }
        )
    )
    n = F.nullif(F.col("n_typed").cast("double"), F.lit(0.0))
    usable = t.isNotNull() & (F.col("n11") >= min_count) & (F.col("n_typed") - F.col("n11") >= min_count)
    stats = counted.withColumn("p", F.when(usable, (2.0 * F.col("n11") + F.col("n12")) / (2.0 * n)))
    p = F.col("p")
    stats = stats.withColumns(
        {
            "d": F.when(usable, F.col("n11") / n - p * p),
            "half_width": F.lit(Z_95) * F.sqrt(p * p * (1 - p) * (1 - p) / n),
        }
    )
    d, half = F.col("d"), F.col("half_width")
    significant = F.when(d >= 0, d - half >= 0).when(d < 0, d + half <= 0)
    return stats.select("pop", "locus", "n_typed", "d", "half_width", significant.alias("significant"))

