"""VCF text to tables and back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.plans.sampling import VariantSet
from locusframe.session import materialize
from locusframe.sources.text import Paths, lines, logical_file, write_sorted

FIXED = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format")

# Header lines of a file made without meta lines of its own.
DEFAULT_META = (
    "##fileformat=VCFv4.2",
    "##source=locusframe",
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
)
CONTIG_ID = r"ID=([^,>]+)"


def read_vcf(spark: SparkSession, paths: Paths) -> VariantSet:
    """Meta lines, contigs, sample columns and records of one or more files.

    ``file_id`` is the path, or the folder of a file written in parts.  Lines are split by tabs where a column is used:
    a query on (chrom, pos) only cuts the first two fields out of each line.
    """
    rows = lines(spark, paths).withColumnRenamed("file", "file_id")
    value = F.col("value")
    head = spark.read.text(paths).select(
        F.regexp_replace("value", r"\r$", "").alias("value"),
        logical_file(F.col("_metadata.file_path")).alias("file_id"),
        F.struct("_metadata.file_path", "_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
    )
    head = materialize(head.where(value.startswith("#")), "vcf-header")
    in_file = Window.partitionBy("file_id").orderBy("block", "id")
    meta = head.where(value.startswith("##")).select(
        "file_id", F.row_number().over(in_file).cast("bigint").alias("line_no"), F.col("value").alias("line")
    )
    named = head.where(value.startswith("#") & ~value.startswith("##")).select(
        "file_id", F.split("value", "\t").alias("c")
    )
    samples = named.select(
        "file_id",
        F.posexplode(F.slice("c", 10, F.greatest(F.size("c") - 9, F.lit(0)))).alias("sample_idx", "sample_id"),
    )
    contigs = (
        meta.where(F.col("line").startswith("##contig="))
        .select(
            "file_id",
            F.regexp_extract("line", CONTIG_ID, 1).alias("chrom"),
            F.regexp_extract("line", r"length=(\d+)", 1).try_cast("bigint").alias("length"),
        )
        .where("chrom <> ''")
    )
    fields = F.split("value", "\t")
    pos = F.substring_index(F.substring_index("value", "\t", 2), "\t", -1).try_cast("bigint")
    variants = (
        rows.where(~value.startswith("#"))
        .select(
            "file_id",
            F.substring_index("value", "\t", 1).alias("chrom"),
            pos.alias("pos"),
            *[F.get(fields, F.lit(i)).alias(name) for i, name in enumerate(FIXED) if i >= 2],
            F.slice(fields, 10, F.greatest(F.size(fields) - 9, F.lit(0))).alias("gts"),
        )
        .where("pos IS NOT NULL")
    )
    return VariantSet(variants, samples, contigs, meta)


def vcf_rejects(spark: SparkSession, paths: Paths) -> DataFrame:
    """(file_id, value, n_columns) of the record lines that ``read_vcf`` leaves out.

    They have no whole number as position; blank lines are no records.
    """
    value = F.col("value")
    pos = F.substring_index(F.substring_index("value", "\t", 2), "\t", -1).try_cast("bigint")
    records = lines(spark, paths).where(~value.startswith("#") & value.rlike(r"\S"))
    return records.where(pos.isNull()).select(F.col("file").alias("file_id"), "value", F.size(F.split("value", "\t")).alias("n_columns"))


def vcf_rows(cohort: VariantSet) -> DataFrame:
    """(file_id, section, line_no, chrom, pos, value): every line of the output.

    Meta lines keep their order; a contig line stays only while its contig is
    in ``cohort.contigs``.
    """
    samples = cohort.samples
    files = samples.select("file_id").distinct()
    none = F.lit("")
    zero = F.lit(0).cast("bigint")
    if cohort.meta is not None:
        meta = cohort.meta
        if cohort.contigs is not None:
            contig = meta.withColumn("chrom", F.regexp_extract("line", CONTIG_ID, 1))
            is_contig = F.col("line").startswith("##contig=")
            kept = contig.where(is_contig).join(cohort.contigs.select("file_id", "chrom"), ["file_id", "chrom"], "left_semi")
            meta = meta.where(~is_contig).unionByName(kept.select("file_id", "line_no", "line"))
        head = meta.select("file_id", F.lit(0).alias("section"), "line_no", none.alias("chrom"), zero.alias("pos"), F.col("line").alias("value"))
    else:
        fixed = F.posexplode(F.array(*[F.lit(x) for x in DEFAULT_META])).alias("line_no", "value")
        head = files.select("file_id", fixed).select(
            "file_id", F.lit(0).alias("section"), F.col("line_no").cast("bigint").alias("line_no"), none.alias("chrom"), zero.alias("pos"), "value"
        )
        if cohort.contigs is not None:
            text = F.concat(F.lit("##contig=<ID="), F.col("chrom"), F.lit(",length="), F.col("length"), F.lit(">"))
            head = head.unionByName(
                cohort.contigs.select(
                    "file_id", F.lit(0).alias("section"), F.lit(100).cast("bigint").alias("line_no"), "chrom", zero.alias("pos"), text.alias("value")
                )
            )
    names = F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", "sample_id"))), lambda s: s["sample_id"])
    title = samples.groupBy("file_id").agg(names.alias("names")).select(
        "file_id", F.lit(1).alias("section"), zero.alias("line_no"), none.alias("chrom"), zero.alias("pos"),
        F.concat_ws("\t", F.lit("#" + "\t".join(c.upper() for c in FIXED)), F.col("names")).alias("value"),
    )
    defaults = {"id": ".", "qual": ".", "filter": "PASS", "info": ".", "format": "GT"}
    fields = [
        F.coalesce(F.col(c), F.lit(defaults.get(c, "."))) if c in cohort.variants.columns else F.lit(defaults.get(c, "."))
        for c in FIXED
        if c != "pos"
    ]
    fields.insert(1, F.col("pos").cast("string"))
    file_id = F.col("file_id") if "file_id" in cohort.variants.columns else F.lit("a")
    body = cohort.variants.select(
        file_id.alias("file_id"), F.lit(2).alias("section"), zero.alias("line_no"), "chrom", "pos",
        F.concat_ws("\t", *fields, F.array_join("gts", "\t")).alias("value"),
    )
    return head.unionByName(title).unionByName(body)


def write_vcf(cohort: VariantSet, path: str) -> None:
    """One folder per file; its part files in name order are the whole VCF.

    The folder has the base name of the file. Where files share a base name,
    the second and later ones, in order of their ids, add ``-2``, ``-3`` and so on.
    """
    same_name = Window.partitionBy("name").orderBy("file_id")
    tables = [t.select("file_id") for t in (cohort.samples, cohort.meta, cohort.contigs) if t is not None]
    base_name = F.regexp_extract("file_id", r"(?:^|[/=])([^/=]*)$", 1)
    files = (
        reduce(DataFrame.unionByName, tables).distinct()
        .withColumn("name", base_name)
        .withColumn("nth", F.row_number().over(same_name))
        .select("file_id", F.when(F.col("nth") == 1, F.col("name")).otherwise(F.concat_ws("-", "name", "nth")).alias("folder"))
    )
    named = vcf_rows(cohort).join(materialize(files, "vcf-files"), "file_id", "left")
    named = named.withColumn("file_id", F.coalesce("folder", base_name)).drop("folder")
    write_sorted(named, path, ["section", "line_no", "chrom", "pos"], partition="file_id")
