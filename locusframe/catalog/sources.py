"""Registered queries that go through the text readers and writers.

Each writes the domain table as text into the shared folder and reads it back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from locusframe import adapters as A
from locusframe.plans.sampling import VariantSet
from locusframe.session import shared_folder
from locusframe.sources import fasta as FA
from locusframe.sources import genotypes as GT
from locusframe.sources import pedigree as PD
from locusframe.sources import segments as SG
from locusframe.sources import trees as TR
from locusframe.sources import vcf as VC
from locusframe.sources.text import write_sorted


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/locusframe/text-{name}-{uuid.uuid4().hex}"


def _lines(spark, df, name: str) -> str:
    path = _folder(spark, name)
    df.write.text(path)
    return path


def _genotype_lines(s, d):
    """Genotype text in which the rows of locus l7 lost their last allele."""
    last = F.when(F.col("locus") != "l7", F.col("allele2"))
    text = F.concat_ws("\t", "ind", "pop_id", "locus", "allele1", last)
    geno = A.genotypes(s, d).withColumn("pop_id", F.regexp_replace("pop", " ", "_"))
    return _lines(s, geno.select(text.alias("value")), "genotypes")


def _bad_lines(s, d):
    _, bad = GT.read_genotypes(s, _genotype_lines(s, d))
    return bad.groupBy("n_columns").agg(F.count(F.lit(1)).alias("n_lines"))


def _genotype_round_trip(s, d):
    path = _folder(s, "ba3")
    GT.write_genotypes(A.genotypes(s, d).withColumn("pop", F.regexp_replace("pop", " ", "_")), path)
    return GT.read_genotypes(s, path)[0]


def _pedigree(s, d, strict):
    path = _folder(s, "pedigree")
    PD.write_pedigree(A.pedigree(s, d).drop("pop").withColumn("pop", F.lit(None).cast("int")) if strict else A.pedigree(s, d), path)
    good, _ = PD.read_pedigree(s, path, strict=strict)
    return good.select("ind", "father", "mother", *([] if strict else ["pop"]))


def _pedigree_errors(s, d):
    """The extended form is a format error on every line of a strict read."""
    path = _folder(s, "pedigree")
    PD.write_pedigree(A.pedigree(s, d), path)
    _, bad = PD.read_pedigree(s, path)
    return bad.groupBy("n_columns").agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("file", "line_no").alias("n_places"))


def _cohort(s, d):
    path = _folder(s, "vcf")
    VC.write_vcf(VariantSet(A.phased_variants(s, d), A.panel_samples(s, d), A.contigs(s, d)), path)
    return VC.read_vcf(s, f"{path}/file_id=a")


def _vcf_samples(s, d):
    return _cohort(s, d).samples.select("sample_idx", "sample_id")


def _segments(s, d):
    path = _folder(s, "segments")
    SG.write_segments(A.segments(s, d), A.founders(s, d), path)
    return SG.read_segments(s, path)


def _two_files(s, d):
    """Two files of one base name, written and read back."""
    named = lambda df: df.drop("file_id").withColumn("file_id", F.explode(F.array(F.lit("x/d.vcf"), F.lit("y/d.vcf"))))
    path = _folder(s, "vcf")
    cohort = VariantSet(named(A.phased_variants(s, d)), named(A.panel_samples(s, d)), named(A.contigs(s, d)))
    VC.write_vcf(cohort, path)
    again = VC.read_vcf(s, [f"{path}/file_id=d.vcf", f"{path}/file_id=d.vcf-2"]).variants
    return again.select(F.regexp_extract("file_id", "file_id=(.*)$", 1).alias("file"), "chrom", "pos", "ref", "alt")


def _vcf_rejects(s, d):
    """Records of which some have no whole number as position."""
    pos = F.when(F.col("pos") % 7 == 0, "NA").otherwise(F.col("pos").cast("string"))
    path = _lines(s, A.variants(s, d).select(F.concat_ws("\t", "chrom", pos, "ref", "alt").alias("value")), "vcf")
    return VC.vcf_rejects(s, path).groupBy("value", "n_columns").agg(F.count(F.lit(1)).alias("n_lines"))


def _segment_rejects(s, d):
    """A good file beside one whose lines lack a bound."""
    path = _folder(s, "segments")
    SG.write_segments(A.segments(s, d), A.founders(s, d), path)
    broken = _lines(s, A.segments(s, d).select(F.concat(F.lit("0.5 "), "founder").alias("value")), "segments")
    return SG.segment_rejects(s, [path, broken]).groupBy("value").agg(F.count(F.lit(1)).alias("n_lines"))


def _region_rejects(s, d):
    end = F.when(F.col("region_id") % 5 == 0, "far").otherwise(F.col("end").cast("string"))
    path = _lines(s, A.target_regions(s, d).select(F.concat_ws(" ", F.lit("0.5"), end).alias("value")), "regions")
    return GT.target_region_rejects(s, path).groupBy("value").agg(F.count(F.lit(1)).alias("n_lines"))


def _founders_of_files(s, d):
    """The founder lists of two segment files."""
    path = _folder(s, "segments")
    SG.write_segments(A.segments(s, d), A.founders(s, d), f"{path}/1")
    SG.write_segments(A.segments(s, d), A.founders(s, d).withColumn("founder", F.concat(F.lit("M"), "founder")), f"{path}/2")
    return SG.read_founders(s, [f"{path}/1", f"{path}/2"])


def _fasta(s, d):
    path = _folder(s, "fasta")
    FA.write_fasta(A.haplotype_chunks(s, d), path, name="founder")
    return FA.read_fasta(s, path, A.founders(s, d), A.CHUNK)


def _regions(s, d):
    text = F.concat_ws(" ", "start", "end")
    path = _lines(s, A.target_regions(s, d).select(text.alias("value")), "regions")
    return GT.read_target_regions(s, path).select("start", "end")


def _times(s, d):
    text = F.concat_ws("\t", F.lit("time:"), F.col("metric"), F.col("metric") * 2)
    return TR.read_time_rows(s, _lines(s, A.replicates(s, d).select(text.alias("value")), "times")).select("tmrca", "tree_length")


def _trees(s, d):
    path = _lines(s, A.trees(s, d).select(F.col("newick").alias("value")), "trees")
    return TR.read_trees(s, path).groupBy("newick").agg(F.count(F.lit(1)).alias("n_trees"))


def _numbered_trees(s, d, value, name: str) -> str:
    """Text of the trees' rows in the order of their numbers."""
    path = _folder(s, name)
    write_sorted(A.trees(s, d).select("tree_no", value.alias("value")), path, ["tree_no"])
    return path


def _interval_text():
    """[n, n + 1) for tree n."""
    return F.concat(F.lit("["), F.col("tree_no"), F.lit(","), F.col("tree_no") + 1, F.lit("]"))


def _tree_intervals(s, d):
    return TR.read_tree_intervals(s, _numbered_trees(s, d, _interval_text(), "intervals"))


def _trees_with_intervals(s, d):
    trees = _numbered_trees(s, d, F.col("newick"), "numbered-trees")
    intervals = _numbered_trees(s, d, _interval_text(), "numbered-intervals")
    return TR.read_trees_with_intervals(s, trees, intervals).drop("rep")


def _interval_trees(s, d):
    path = _numbered_trees(s, d, F.concat_ws(" ", _interval_text(), "newick"), "interval-trees")
    return TR.read_interval_trees(s, path).drop("rep")


def _replicate_logs(s, d):
    """One log per scenario; its largest values count, and what it does not show is NULL."""
    path = _folder(s, "logs")
    oldest = F.concat(F.lit("Oldest_TMRCA: "), F.abs("metric").cast("decimal(18,6)"))
    recombinations = F.concat(F.lit("No_Recombinations:  "), F.col("rep"))
    text = A.replicates(s, d).select("scenario", F.explode(F.array(oldest, recombinations)).alias("value"))
    text.write.partitionBy("scenario").text(path)
    logs = TR.read_replicate_logs(s, path)
    return logs.select(
        F.regexp_extract("log", "scenario=([^/]+)", 1).alias("scenario"), "tmrca", "recomb",
        F.col("mutations").isNull().alias("no_mutations"),
    )


def _ids(s, d):
    path = _lines(s, A.pedigree(s, d).select(F.concat("ind", F.lit("  ")).alias("value")), "ids")
    return GT.read_id_list(s, path)


def _pop_map(s, d):
    text = F.concat(F.lit("^i"), F.col("n_nationkey"), F.lit(" "), F.col("n_name"))
    path = _lines(s, A.table(s, d, "nation").select(F.regexp_replace(text, r"(\S+ \S+).*", "$1").alias("value")), "pop-map")
    return GT.read_pop_map(s, path).select("pattern", "pop")


QUERIES = {
    "read_genotypes": lambda s, d: GT.read_genotypes(s, _genotype_lines(s, d))[0],
    "read_genotypes_rejects": _bad_lines,
    "write_genotypes": _genotype_round_trip,
    "read_pedigree_strict": lambda s, d: _pedigree(s, d, True),
    "read_pedigree_relaxed": lambda s, d: _pedigree(s, d, False),
    "read_pedigree_errors": _pedigree_errors,
    "read_vcf": lambda s, d: _cohort(s, d).variants.select("chrom", "pos", "ref", "alt", "info", F.array_join("gts", " ").alias("gts")),
    "read_vcf_samples": _vcf_samples,
    "read_vcf_contigs": lambda s, d: _cohort(s, d).contigs.select("chrom", "length"),
    "read_vcf_rejects": _vcf_rejects,
    "write_vcf_two_files": _two_files,
    "read_segments": _segments,
    "read_segments_rejects": _segment_rejects,
    "read_founders_many_files": _founders_of_files,
    "read_target_regions_rejects": _region_rejects,
    "read_fasta": lambda s, d: _fasta(s, d)[1],
    "read_fasta_lengths": lambda s, d: _fasta(s, d)[0],
    "read_target_regions": _regions,
    "read_time_rows": _times,
    "read_trees": _trees,
    "read_tree_intervals": _tree_intervals,
    "read_trees_with_intervals": _trees_with_intervals,
    "read_interval_trees": _interval_trees,
    "read_replicate_logs": _replicate_logs,
    "read_id_list": _ids,
    "read_pop_map": _pop_map,
}

_RAW = {
    "read_genotypes": (
        ["genotypes"],
        "SELECT replace(pop, ' ', '_') AS pop, ind, locus, allele1, allele2 FROM genotypes WHERE locus <> 'l7'",
    ),
    "read_genotypes_rejects": (
        ["genotypes"], "SELECT 4 AS n_columns, count(*) AS n_lines FROM genotypes WHERE locus = 'l7'",
    ),
    "write_genotypes": (
        ["genotypes"], "SELECT replace(pop, ' ', '_') AS pop, ind, locus, allele1, allele2 FROM genotypes",
    ),
    "read_pedigree_strict": (["pedigree"], "SELECT ind, father, mother FROM pedigree"),
    "read_pedigree_relaxed": (["pedigree"], "SELECT ind, father, mother, pop FROM pedigree"),
    "read_pedigree_errors": (
        ["pedigree"], "SELECT 4 AS n_columns, count(*) AS n_lines, count(*) AS n_places FROM pedigree",
    ),
    "read_vcf": (
        ["variants", "phased"],
        """
SELECT p.chrom, p.pos, p.ref, p.alt, v.info, string_agg(p.gt, ' ' ORDER BY p.sample_idx) AS gts
FROM phased p JOIN variants v ON v.chrom = p.chrom AND v.pos = p.pos GROUP BY ALL""",
    ),
    "read_vcf_samples": ([], "SELECT n_nationkey AS sample_idx, 'N' || n_nationkey AS sample_id FROM nation"),
    "read_vcf_contigs": (["contigs"], "SELECT chrom, length FROM contigs"),
    "read_vcf_rejects": (
        ["variants"],
        """
SELECT chrom || chr(9) || 'NA' || chr(9) || ref || chr(9) || alt AS value, 4 AS n_columns, count(*) AS n_lines
FROM variants WHERE pos % 7 = 0 GROUP BY ALL""",
    ),
    "write_vcf_two_files": (
        ["phased"],
        """
SELECT file, chrom, pos, ref, alt FROM (SELECT chrom, pos, ref, alt FROM phased GROUP BY ALL), (VALUES ('d.vcf'), ('d.vcf-2')) AS f(file)""",
    ),
    "read_segments": (["segments"], "SELECT * FROM segments"),
    "read_segments_rejects": (["segments"], "SELECT '0.5 ' || founder AS value, count(*) AS n_lines FROM segments GROUP BY ALL"),
    "read_founders_many_files": (
        ["founders"],
        "SELECT founder, ord FROM founders UNION ALL SELECT 'M' || founder, CAST(ord + (SELECT count(*) FROM founders) AS INTEGER) FROM founders",
    ),
    "read_target_regions_rejects": (
        ["target_regions"], "SELECT '0.5 far' AS value, count(*) AS n_lines FROM target_regions WHERE region_id % 5 = 0",
    ),
    "read_fasta": (["haplotype_chunks"], "SELECT * FROM haplotype_chunks"),
    "read_fasta_lengths": (
        ["haplotype_chunks"],
        "SELECT founder, homolog, CAST(sum(length(bases)) AS BIGINT) AS seq_len FROM haplotype_chunks GROUP BY founder, homolog",
    ),
    "read_target_regions": (["target_regions"], 'SELECT start, "end" FROM target_regions'),
    "read_time_rows": (["replicates"], "SELECT metric AS tmrca, metric * 2 AS tree_length FROM replicates"),
    "read_trees": (["trees"], "SELECT newick, count(*) AS n_trees FROM trees GROUP BY newick"),
    "read_tree_intervals": (
        ["trees"],
        """
SELECT row_number() OVER (ORDER BY tree_no) AS tree_no, CAST(tree_no AS DOUBLE) AS lower, CAST(tree_no + 1 AS DOUBLE) AS upper
FROM trees""",
    ),
    "read_trees_with_intervals": (
        ["trees"],
        """
SELECT row_number() OVER (ORDER BY tree_no) AS tree_no, CAST(tree_no AS DOUBLE) AS lower, CAST(tree_no + 1 AS DOUBLE) AS upper,
       newick FROM trees""",
    ),
    "read_interval_trees": (
        ["trees"], "SELECT CAST(tree_no AS DOUBLE) AS lower, CAST(tree_no + 1 AS DOUBLE) AS upper, newick FROM trees",
    ),
    "read_replicate_logs": (
        ["replicates"],
        """
SELECT scenario, max(CAST(CAST(abs(metric) AS DECIMAL(18, 6)) AS DOUBLE)) AS tmrca, max(rep) AS recomb, true AS no_mutations
FROM replicates GROUP BY scenario""",
    ),
    "read_id_list": (["pedigree"], "SELECT ind AS sample_id FROM pedigree"),
    "read_pop_map": ([], "SELECT '^i' || n_nationkey AS pattern, split_part(n_name, ' ', 1) AS pop FROM nation"),
}

ORACLES = {name: A.with_tables(tables, body) for name, (tables, body) in _RAW.items()}
