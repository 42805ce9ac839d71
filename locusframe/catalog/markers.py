"""Registered queries on variant tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusframe import adapters as A
from locusframe.functions import scalars as S
from locusframe.operators import markers as M
from locusframe.plans import sampling as P

K = 12


def _listed(spark, sf):
    """Ids to keep: the nations' sample names as they occur among customers."""
    return A.table(spark, sf, "customer").select(
        F.concat(F.lit("N"), F.col("c_nationkey") * 2).alias("sample_id")
    )


def _wide(df):
    return df.select("chrom", "pos", "ref", "alt", F.array_join("gts", " ").alias("gts"))


def _selected(s, d):
    kept, _ = M.select_samples(A.phased_variants(s, d), A.panel_samples(s, d), _listed(s, d))
    return _wide(kept)


def _random(s, d):
    picked = M.thin_random(A.three_files(s, d), K, seed=7, count_records=False)
    return picked.groupBy("chrom").agg(F.count(F.lit(1)).alias("n_picked"))


def _sample_one(s, d):
    cohort = P.VariantSet(A.variants_repeated(s, d), A.panel_samples(s, d).withColumn("file_id", F.lit("b")), A.contigs(s, d))
    out = P.sample_vcf(cohort, k=K, method="uniform")
    return _wide(out.variants)


def _sample_shared(s, d, region=None):
    cohort = P.VariantSet(A.three_files(s, d), A.panel_samples(s, d), A.contigs(s, d))
    out = P.sample_vcfs_shared(cohort, n_files=3, k=K, method="uniform", region=region)
    return out.variants.select("file_id", "chrom", "pos", F.array_join("gts", " ").alias("gts"))


def _sample_narrowed(s, d):
    """Listed samples, a region and a marker count at once."""
    cohort = P.VariantSet(A.phased_variants(s, d), A.panel_samples(s, d), A.contigs(s, d))
    return P.sample_vcf(cohort, ids=_listed(s, d), k=K, method="uniform", region="chr2:100")


def _sample_random(s, d):
    cohort = P.VariantSet(A.variants(s, d), A.panel_samples(s, d), A.contigs(s, d))
    out = P.sample_vcf(cohort, k=K, method="random", seed=11)
    return out.variants.groupBy("chrom").agg(F.count_distinct("pos").alias("n_picked"))


def _polymorphic_with_depth(s, d):
    """Calls that carry a depth; the depth is no allele."""
    deep = F.transform("gts", lambda g: F.concat(g, F.lit(":12")))
    return _wide(M.polymorphic(A.variants_repeated(s, d).withColumn("gts", deep)))


def _pop_map(s, d):
    return A.table(s, d, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("line_no"),
        F.concat(F.lit("^i"), F.col("n_nationkey"), F.lit(r"[0-9]*\s")).alias("pattern"),
        F.col("n_name").alias("pop"),
    )


def _two_chromosomes(s, d):
    first = A.variants(s, d).select("file_id", "chrom", "pos", "ref", "alt")
    second = A.variants_third(s, d).select("file_id", "chrom", "pos", "ref", "alt")
    return M.union_relabelled([(1, first), (2, second)]).select("chrom", "pos", "ref", "alt")


def _coordinates(s, d):
    joined = A.variants(s, d).join(A.contigs(s, d).select("chrom", "length"), "chrom")
    frac = S.bp_to_frac(F.col("pos"), F.col("length"))
    return joined.select(
        "chrom",
        "pos",
        S.chrom_id(F.col("chrom")).alias("chrom_no"),
        F.round(frac, 6).alias("frac"),
        S.frac_to_bp(frac, F.lit(1000)).alias("bp1000"),
        S.frac_to_vcf_pos(frac, F.lit(1000)).alias("vcf1000"),
        S.to_units(frac, F.col("length"), "kb").alias("kb"),
        S.frac_to_site(frac, F.lit(1000)).alias("site1000"),
    )


QUERIES = {
    "filter_region": lambda s, d: M.filter_region(A.three_files(s, d), "chr2:500-40000").select("file_id", "chrom", "pos"),
    "marker_counts": lambda s, d: M.marker_counts(A.three_files(s, d)),
    "marker_counts_by_file": lambda s, d: M.marker_counts(A.three_files(s, d), "file_id"),
    "distinct_markers": lambda s, d: M.distinct_markers(A.three_files(s, d)),
    "sort_markers": lambda s, d: M.sort_markers(M.distinct_markers(A.three_files(s, d))),
    "shared_markers": lambda s, d: M.shared_markers(A.three_files(s, d), 3),
    "thin_uniform_distinct": lambda s, d: M.thin_uniform(A.three_files(s, d), K),
    "thin_uniform_records": lambda s, d: M.thin_uniform(A.three_files(s, d), K, count_records=True),
    "thin_uniform_single": lambda s, d: M.thin_uniform(A.three_files(s, d), 1),
    "thin_random": _random,
    "filter_markers": lambda s, d: M.filter_markers(
        A.variants_repeated(s, d), M.distinct_markers(A.variants_third(s, d))
    ).select("chrom", "pos", "info"),
    "prune_contigs": lambda s, d: M.prune_contigs(
        A.contigs(s, d), M.filter_region(A.variants_third(s, d), "chr3")
    ),
    "select_samples": _selected,
    "segregating_sites": lambda s, d: _wide(M.segregating(A.variants_repeated(s, d))),
    "polymorphic_sites": lambda s, d: _wide(M.polymorphic(A.variants_repeated(s, d))),
    "polymorphic_sites_with_depth": _polymorphic_with_depth,
    "mutation_list": lambda s, d: M.mutation_list(A.variants(s, d)).withColumn(
        "carriers", F.array_join("carriers", " ")
    ),
    "vcf_to_genotypes": lambda s, d: M.vcf_to_genotypes(A.phased_variants(s, d), A.panel_samples(s, d)),
    "relabel_population": lambda s, d: M.relabel_population(A.genotypes(s, d), _pop_map(s, d)),
    "union_relabelled": _two_chromosomes,
    "coordinates": _coordinates,
    "sample_vcf": _sample_one,
    "sample_vcf_narrowed": lambda s, d: _wide(_sample_narrowed(s, d).variants),
    "sample_vcf_samples": lambda s, d: _sample_narrowed(s, d).samples,
    "sample_vcf_contigs": lambda s, d: _sample_narrowed(s, d).contigs,
    "sample_vcf_random": _sample_random,
    "sample_vcfs_shared": lambda s, d: _sample_shared(s, d, "chr2:100"),
    "sample_vcfs_shared_all": _sample_shared,
}

_UNIFORM = f"""
rk AS (SELECT chrom, pos, row_number() OVER (PARTITION BY chrom ORDER BY pos) - 1 AS idx,
              count(*) OVER (PARTITION BY chrom) AS m FROM src),
want AS (SELECT DISTINCT chrom, m, CAST(floor(i * (CAST(m - 1 AS DOUBLE) / {K - 1}) + 0.5) AS BIGINT) AS idx
         FROM (SELECT DISTINCT chrom, m FROM rk), range(0, {K}) AS r(i)),
sel AS (SELECT DISTINCT rk.chrom, rk.pos FROM rk LEFT JOIN want USING (chrom, idx) WHERE rk.m <= {K} OR want.idx IS NOT NULL)"""

_RAW = {
    "filter_region": (
        ["three_files"],
        "SELECT file_id, chrom, pos FROM three_files WHERE chrom = 'chr2' AND pos BETWEEN 500 AND 40000",
    ),
    "marker_counts": (["three_files"], "SELECT file_id, chrom, count(*) AS n_markers FROM three_files GROUP BY ALL"),
    "marker_counts_by_file": (["three_files"], "SELECT file_id, count(*) AS n_markers FROM three_files GROUP BY ALL"),
    "distinct_markers": (["three_files"], "SELECT DISTINCT chrom, pos FROM three_files"),
    "sort_markers": (["three_files"], "SELECT DISTINCT chrom, pos FROM three_files ORDER BY chrom, pos"),
    "shared_markers": (
        ["variants", "variants_repeated", "variants_third"],
        """SELECT chrom, pos FROM variants INTERSECT SELECT chrom, pos FROM variants_repeated
           INTERSECT SELECT chrom, pos FROM variants_third""",
    ),
    "thin_uniform_distinct": (
        ["three_files"],
        f"WITH src AS (SELECT DISTINCT chrom, pos FROM three_files), {_UNIFORM} SELECT * FROM sel",
    ),
    "thin_uniform_records": (
        ["three_files"],
        f"WITH src AS (SELECT chrom, pos FROM three_files), {_UNIFORM} SELECT * FROM sel",
    ),
    "thin_uniform_single": (["three_files"], "SELECT chrom, min(pos) AS pos FROM three_files GROUP BY chrom"),
    "thin_random": (
        ["three_files"],
        f"SELECT chrom, least({K}, count(DISTINCT pos)) AS n_picked FROM three_files GROUP BY chrom",
    ),
    "filter_markers": (
        ["variants_repeated", "variants_third"],
        "SELECT chrom, pos, info FROM variants_repeated WHERE (chrom, pos) IN (SELECT chrom, pos FROM variants_third)",
    ),
    "prune_contigs": (["contigs"], "SELECT 'a' AS file_id, chrom, length FROM contigs WHERE chrom = 'chr3'"),
    "select_samples": (
        ["phased"],
        """
SELECT chrom, pos, ref, alt, string_agg(gt, ' ' ORDER BY sample_idx) AS gts FROM phased
WHERE sample_idx IN (SELECT c_nationkey * 2 FROM customer) GROUP BY chrom, pos, ref, alt""",
    ),
    "segregating_sites": (
        ["variants_repeated"],
        "SELECT chrom, pos, ref, alt, array_to_string(gts, ' ') AS gts FROM variants_repeated WHERE list_contains(gts, '0')",
    ),
    "polymorphic_sites": (
        ["variants_repeated"],
        "SELECT chrom, pos, ref, alt, array_to_string(gts, ' ') AS gts FROM variants_repeated WHERE list_contains(gts, '1')",
    ),
    "polymorphic_sites_with_depth": (
        ["variants_repeated"],
        """
SELECT chrom, pos, ref, alt, array_to_string(list_transform(gts, lambda g: g || ':12'), ' ') AS gts
FROM variants_repeated WHERE list_contains(gts, '1')""",
    ),
    "mutation_list": (
        ["variants"],
        """
SELECT chrom, pos, CAST(replace(info, 'AGE=', '') AS DOUBLE) AS age,
       coalesce(string_agg(CAST(i AS VARCHAR), ' ' ORDER BY i) FILTER (WHERE g = '1'), '') AS carriers,
       coalesce(min(i) FILTER (WHERE g = '1') + 1, 0) AS first_carrier
FROM (SELECT chrom, pos, info, unnest(gts) AS g, unnest(range(0, 50)) AS i FROM variants)
GROUP BY chrom, pos, info HAVING bool_or(g = '0')""",
    ),
    "vcf_to_genotypes": (
        ["phased"],
        """
SELECT 'proxypop' AS pop, 'N' || sample_idx AS ind, chrom || '-' || pos AS locus,
       CASE WHEN gt[1] = '0' THEN ref ELSE alt END AS allele1,
       CASE WHEN gt[3] = '0' THEN ref ELSE alt END AS allele2 FROM phased""",
    ),
    "relabel_population": (
        ["genotypes"],
        """
SELECT n_nationkey AS map_line, n_name AS pop, ind, locus, allele1, allele2
FROM genotypes JOIN nation ON starts_with(ind, 'i' || n_nationkey)""",
    ),
    "union_relabelled": (
        ["variants", "variants_third"],
        "SELECT 'chr1' AS chrom, pos, ref, alt FROM variants UNION ALL SELECT 'chr2', pos, ref, alt FROM variants_third",
    ),
    "coordinates": (
        ["variants", "contigs"],
        """
WITH f AS (SELECT chrom, pos, length, CAST(pos AS DOUBLE) * (1.0::DOUBLE / length) AS x FROM variants JOIN contigs USING (chrom))
SELECT chrom, pos, CAST(substr(chrom, 4) AS INTEGER) AS chrom_no, round(x, 6) AS frac,
       CAST(floor(x * 1000) AS BIGINT) AS bp1000,
       greatest(1, least(CAST(floor(x * 1000) AS BIGINT) + 1, 1000)) AS vcf1000,
       CAST(ceil(CAST(length AS DOUBLE) * x / 1000.0::DOUBLE) AS BIGINT) AS kb,
       CAST(ceil(x * 1000) AS BIGINT) - 1 AS site1000 FROM f""",
    ),
    "sample_vcf": (
        ["variants_repeated"],
        f"""
WITH src AS (SELECT chrom, pos FROM variants_repeated), {_UNIFORM}
SELECT chrom, pos, ref, alt, array_to_string(gts, ' ') AS gts FROM variants_repeated JOIN sel USING (chrom, pos)""",
    ),
    "sample_vcf_narrowed": (
        ["variants", "phased"],
        f"""
WITH src AS (SELECT chrom, pos FROM variants WHERE chrom = 'chr2' AND pos >= 100), {_UNIFORM}
SELECT chrom, pos, ref, alt, string_agg(gt, ' ' ORDER BY sample_idx) AS gts FROM phased JOIN sel USING (chrom, pos)
WHERE sample_idx IN (SELECT c_nationkey * 2 FROM customer) GROUP BY chrom, pos, ref, alt""",
    ),
    "sample_vcf_samples": (
        [],
        """
SELECT 'a' AS file_id, row_number() OVER (ORDER BY n_nationkey) - 1 AS sample_idx, 'N' || n_nationkey AS sample_id
FROM nation WHERE n_nationkey IN (SELECT c_nationkey * 2 FROM customer)""",
    ),
    "sample_vcf_contigs": (
        ["variants", "contigs"],
        """
SELECT 'a' AS file_id, chrom, length FROM contigs
WHERE chrom IN (SELECT chrom FROM variants WHERE chrom = 'chr2' AND pos >= 100)""",
    ),
    "sample_vcf_random": (
        ["variants"], f"SELECT chrom, least({K}, count(DISTINCT pos)) AS n_picked FROM variants GROUP BY chrom",
    ),
    "sample_vcfs_shared": (
        ["three_files"],
        f"""
WITH src AS (SELECT chrom, pos FROM three_files WHERE chrom = 'chr2' AND pos >= 100
             GROUP BY chrom, pos HAVING count(DISTINCT file_id) = 3), {_UNIFORM}
SELECT file_id, chrom, pos, array_to_string(gts, ' ') AS gts FROM three_files JOIN sel USING (chrom, pos)""",
    ),
    "sample_vcfs_shared_all": (
        ["three_files"],
        f"""
WITH src AS (SELECT chrom, pos FROM three_files GROUP BY chrom, pos HAVING count(DISTINCT file_id) = 3), {_UNIFORM}
SELECT file_id, chrom, pos, array_to_string(gts, ' ') AS gts FROM three_files JOIN sel USING (chrom, pos)""",
    ),
}

ORACLES = {name: A.with_tables(tables, body) for name, (tables, body) in _RAW.items()}
