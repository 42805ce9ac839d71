"""Region, sample and marker operators on variant tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusframe.functions.patterns import candidates
from locusframe.functions.scalars import call_fields, plain_symbol
from locusframe.operators.ordered import ranked
from locusframe.session import materialize

# A bucket of this many base positions holds at most this many distinct markers.
BUCKET_BASES = 65_536
# Lines of a population map whose literals are looked for in one pass.
MAP_PART = 100_000


@dataclass(frozen=True)
class Region:
    """1-based inclusive range on one chromosome; 0 leaves a side open."""

    chrom: str
    start: int = 0
    end: int = 0

    @classmethod
    def parse(cls, text: str) -> "Region":
        """``chr``, ``chr:start`` or ``chr:start-end``."""
        chrom, _, span = text.partition(":")
        start, _, end = span.partition("-")
        return cls(chrom, int(start or 0), int(end or 0))


def filter_region(df: DataFrame, region: Region | str | None) -> DataFrame:
    """Keep rows in the region; literal bounds reach the parquet scan."""
    if region is None:
        return df
    if isinstance(region, str):
        region = Region.parse(region)
    kept = df.where(F.col("chrom") == region.chrom)
    if region.start > 0:
        kept = kept.where(F.col("pos") >= region.start)
    if region.end > 0:
        kept = kept.where(F.col("pos") <= region.end)
    return kept


def marker_counts(variants: DataFrame, *keys: str) -> DataFrame:
    """Records per file and chromosome, or per ``keys``."""
    return variants.groupBy(*(keys or ("file_id", "chrom"))).agg(F.count(F.lit(1)).alias("n_markers"))


def distinct_markers(variants: DataFrame) -> DataFrame:
    return variants.select("chrom", "pos").distinct()


def sort_markers(markers: DataFrame) -> DataFrame:
    return markers.orderBy("chrom", "pos")


def shared_markers(variants: DataFrame, n_files: int) -> DataFrame:
    """Markers present in each of ``n_files`` files.

    One aggregation for any number of files.  Each (file, marker) is reduced
    map-side first, so a marker repeated in one file costs nothing extra.
    """
    return (
        variants.groupBy("chrom", "pos")
        .agg(F.count_distinct("file_id").alias("in_files"))
        .where(F.col("in_files") == n_files)
        .select("chrom", "pos")
    )


def _counted(markers: DataFrame, count_records: bool) -> DataFrame:
    n = F.count(F.lit(1)) if count_records else F.lit(1).cast("bigint")
    return markers.groupBy("chrom", "pos").agg(n.alias("n"))


def thin_uniform(markers: DataFrame, k: int, count_records: bool = False) -> DataFrame:
    """Per chromosome, the markers whose rank is an evenly spaced index.

    With m markers on a chromosome the indices are floor(i (m-1)/(k-1) + 1/2)
    for i = 0 .. k-1; every marker is kept when k >= m, and the first when
    k = 1.  ``count_records`` ranks records instead of distinct positions; a
    position is then kept when any of its records is picked.

    Positions are ranked inside fixed base ranges and only small per-range
    counts are summed over a chromosome, so no task ever sorts a chromosome.
    Ranges without a wanted index are never sorted at all.
    """
    if k < 1:
        raise ValueError("k must be at least 1")

    def hit(first: Column, n: Column, m: Column) -> Column:
        """Whether an index lies in [first, first + n)."""
        if k == 1:
            return first == 0
        step = (m - 1).cast("double") / F.lit(float(k - 1))
        near = F.ceil((first - F.lit(0.5)) / step).cast("bigint")
        picks = [F.least(F.greatest(near + d, F.lit(0)), F.lit(k - 1)) for d in (-1, 0, 1)]
        index = [F.least(F.floor(i * step + 0.5).cast("bigint"), m - 1) for i in picks]
        some = F.lit(False)
        for i in index:
            some = some | ((i >= first) & (i < first + n))
        return (m <= k) | some

    counts = _counted(markers, count_records).withColumn("bucket", F.floor(F.col("pos") / BUCKET_BASES))
    return (
        ranked(counts, ["chrom"], "bucket", ["pos"], weight="n", keep_bucket=hit)
        .where(hit(F.col("rank"), F.col("n"), F.col("group_size")))
        .select("chrom", "pos")
    )


def thin_random(markers: DataFrame, k: int, seed: int, count_records: bool = False) -> DataFrame:
    """Per chromosome, k markers without replacement, each set equally likely.

    Markers are ordered by a seeded hash, so the pick does not depend on the
    partitioning.  Only the leading hash ranges that can hold the first k are
    sorted; the rest are dropped by their counts.
    """
    counts = _counted(markers, count_records)
    rows = counts.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    draw = F.xxhash64(F.lit(seed), "chrom", "pos", "copy")
    rows = rows.withColumn("draw", draw).withColumn("bucket", F.shiftright(draw, 48))
    return (
        ranked(
            rows, ["chrom"], "bucket", ["draw", "pos", "copy"],
            keep_bucket=lambda before, n, size: before < k,
        )
        .where(F.col("rank") < k)
        .select("chrom", "pos")
        .distinct()
    )


def pick_markers(
    markers: DataFrame, k: int, method: str = "uniform", seed: int = 0, count_records: bool = False
) -> DataFrame:
    if method == "uniform":
        return thin_uniform(markers, k, count_records)
    if method == "random":
        return thin_random(markers, k, seed, count_records)
    raise ValueError(f"unknown method {method!r}")


def filter_markers(variants: DataFrame, markers: DataFrame) -> DataFrame:
    """Every record at a selected position passes."""
    return variants.join(markers, ["chrom", "pos"], "left_semi")


def prune_contigs(contigs: DataFrame, markers: DataFrame) -> DataFrame:
    """Contigs that still have a selected marker."""
    return contigs.join(markers.select("chrom").distinct(), "chrom", "left_semi")


def keep_samples(samples: DataFrame, ids: DataFrame) -> DataFrame:
    """Listed samples in file order, renumbered; unknown ids are ignored."""
    kept = samples.join(ids.select("sample_id").distinct(), "sample_id", "left_semi")
    by_file = kept.groupBy("file_id").agg(
        F.array_sort(F.collect_list(F.struct("sample_idx", "sample_id"))).alias("s")
    )
    return by_file.select("file_id", F.posexplode("s").alias("sample_idx", "s")).select(
        "file_id", "sample_idx", F.col("s.sample_id"), F.col("s.sample_idx").alias("old_idx")
    )


def select_samples(variants: DataFrame, samples: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keep the listed sample columns of each file; returns (variants, samples).

    The kept column numbers, one row per file, are written once; the planner
    broadcasts them while that table is small, so the records are not shuffled.
    """
    kept = materialize(keep_samples(samples, ids), "kept-samples")
    columns = kept.groupBy("file_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", "old_idx"))), lambda s: s["old_idx"]).alias("keep")
    )
    columns = materialize(columns, "kept-columns")
    narrowed = (
        variants.join(columns, "file_id", "left")
        .withColumn("gts", F.transform(F.coalesce("keep", F.array().cast("array<int>")), lambda i: F.get("gts", i)))
        .drop("keep")
    )
    return narrowed.select(variants.columns), kept.select("file_id", "sample_idx", "sample_id")


def union_relabelled(parts: list[tuple[int, DataFrame]]) -> DataFrame:
    """One variant table from per-chromosome tables, renamed ``chrN``."""
    named = [df.withColumn("chrom", F.lit(f"chr{number}")) for number, df in parts]
    merged = named[0]
    for df in named[1:]:
        merged = merged.unionByName(df)
    return merged


# ------------------------------------------------------------ genotype calls

def _haplotypes(gts: Column) -> Column:
    """All allele symbols of a record, across samples and homologs."""
    return F.flatten(F.transform(gts, call_fields))


def _carries(allele: Column) -> Column:
    return ~allele.isin("0", ".", "")


def _any_haplotype(gts: Column, test: Callable[[Column], Column]) -> Column:
    """Whether an allele symbol of a record passes; looks no further than the first. NULL where a call is NULL."""
    in_call = lambda g: F.when(plain_symbol(g), test(g)).otherwise(F.exists(call_fields(g), test))
    of = lambda calls: F.when(~F.exists(calls, lambda g: g.isNull()), F.exists(calls, in_call))
    return F.exists(F.array(gts), of)  # the calls are computed once, whatever they are computed from


def segregating(variants: DataFrame) -> DataFrame:
    """Drop the sites at which every haplotype carries a derived allele."""
    return variants.where(_any_haplotype(F.col("gts"), lambda a: ~_carries(a)))


def polymorphic(variants: DataFrame) -> DataFrame:
    """Drop the sites at which no output genotype carries a derived allele; other fields of a call do not count."""
    return variants.where(_any_haplotype(F.col("gts"), _carries))


def mutation_list(variants: DataFrame) -> DataFrame:
    """Position, age and carrier columns of every mutation that is not fixed.

    Carriers are 0-based haplotype columns; ``first_carrier`` is the 1-based
    label of the first.
    """
    haps = _haplotypes(F.col("gts"))
    marks = F.transform(haps, lambda a, i: F.when(_carries(a), i))
    return segregating(variants).select(
        "chrom",
        "pos",
        F.regexp_extract("info", r"AGE=([0-9.]+)", 1).try_cast("double").alias("age"),
        F.array_compact(marks).alias("carriers"),
        (F.coalesce(F.array_min(marks), F.lit(-1)) + 1).alias("first_carrier"),
    )


def vcf_to_genotypes(variants: DataFrame, samples: DataFrame, pop: str = "proxypop") -> DataFrame:
    """Wide calls to the long genotype table, with bases for allele numbers.

    Sample names travel as one array per file, so each record is expanded once
    and joined before it is expanded.
    """
    names = materialize(
        samples.groupBy("file_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", "sample_id"))), lambda s: s["sample_id"]).alias("names")
        ),
        "sample-names",
    )
    alleles = F.concat(F.array("ref"), F.split("alt", ","))
    base = lambda i: F.coalesce(F.get(alleles, i.try_cast("int")), F.lit("0"))
    calls = variants.join(names, "file_id").select(
        "chrom", "pos", "ref", "alt", F.explode(F.arrays_zip("names", "gts")).alias("call")
    )
    parts = F.split(F.split_part(F.col("call.gts"), F.lit(":"), F.lit(1)), r"[|/]")
    calls = calls.withColumn("gt", parts)
    return calls.select(
        F.lit(pop).alias("pop"),
        F.col("call.names").alias("ind"),
        F.concat_ws("-", "chrom", "pos").alias("locus"),
        base(F.get("gt", F.lit(0))).alias("allele1"),
        base(F.get("gt", F.lit(1))).alias("allele2"),
    )


def relabel_population(geno: DataFrame, pop_map: DataFrame) -> DataFrame:
    """New population for every (row, matching pattern) pair.

    A pattern is matched against the whole tab-joined row.  Rows without a
    match vanish, rows with several repeat, and ``map_line`` tells which line
    of the map matched.  One pass over the rows finds the literals that the
    patterns cannot match without, all at once; only those (row, pattern) pairs
    are joined by the map's line and put to the regular expression.  A pattern
    without such a literal is put to every row; a null pattern matches none.
    Maps beyond ``MAP_PART`` lines take a pass for each part of that size.
    """
    patterns = materialize(
        pop_map.where("pattern IS NOT NULL").select(
            F.col("line_no").cast("bigint").alias("map_line"), "pattern", F.col("pop").alias("new_pop")
        ),
        "pop-map",
    )
    lines = geno.select(
        "ind", "locus", "allele1", "allele2", F.concat_ws("\t", "ind", "pop", "locus", "allele1", "allele2").alias("line")
    )
    schema = T.StructType(lines.schema.fields + [T.StructField("candidates", T.ArrayType(T.LongType()))])
    parts = -(-patterns.count() // MAP_PART) or 1
    pairs = None
    for part in range(parts):
        listed = patterns.where(F.pmod(F.xxhash64("map_line"), F.lit(parts)) == part).select("map_line", "pattern")
        finder = candidates([(r.map_line, r.pattern) for r in listed.collect()], "line")
        found = lines.mapInArrow(finder, schema).withColumn("map_line", F.explode("candidates")).drop("candidates")
        pairs = found if pairs is None else pairs.unionByName(found)
    return pairs.join(patterns, "map_line").where(F.expr("line rlike pattern")).select(
        "map_line", F.col("new_pop").alias("pop"), "ind", "locus", "allele1", "allele2"
    )
