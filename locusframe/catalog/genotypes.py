"""Registered queries on the genotype table."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusframe import adapters as A
from locusframe.operators import genotypes as G

R6 = 6


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, R6) for c in columns})


def _het_ind(spark, sf):
    return rounded(G.heterozygosity(A.genotypes(spark, sf), "ind"), "het", "half_width")


def _het_locus(spark, sf):
    return rounded(G.heterozygosity(A.genotypes(spark, sf), "locus"), "het", "half_width")


def _hwe(spark, sf):
    return rounded(G.hwe_disequilibrium(A.genotypes(spark, sf)), "d", "half_width")


QUERIES = {
    "dataset_summary": lambda s, d: G.dataset_summary(A.genotypes(s, d)),
    "population_list": lambda s, d: G.population_list(A.genotypes(s, d)),
    "individual_list": lambda s, d: G.individual_list(A.genotypes(s, d)),
    "locus_list": lambda s, d: G.locus_list(A.genotypes(s, d)),
    "locus_summary": lambda s, d: G.locus_summary(A.genotypes(s, d)).withColumn(
        "alleles", F.array_join("alleles", " ")
    ),
    "typed_genotypes": lambda s, d: G.typed(A.genotypes(s, d)),
    "missing_as_null": lambda s, d: G.with_missing_as_null(A.genotypes(s, d)),
    "duplicate_genotypes": lambda s, d: G.duplicate_genotypes(A.raw_genotypes(s, d)),
    "drop_empty_loci": lambda s, d: G.drop_empty_loci(
        A.genotypes(s, d).withColumn("locus", F.concat("locus", F.lit("_"), "allele1", "allele2"))
    ),
    "heterozygosity_by_individual": _het_ind,
    "heterozygosity_by_locus": _het_locus,
    "hwe_disequilibrium": _hwe,
}

_HET_TAIL = """
       CASE WHEN n_typed > 0 THEN round(n_het / CAST(n_typed AS DOUBLE), 6) END AS het,
       CASE WHEN n_typed > 0 THEN round(1.96 * sqrt((n_het / CAST(n_typed AS DOUBLE))
            * (1 - n_het / CAST(n_typed AS DOUBLE)) / n_typed), 6) END AS half_width"""

_RAW = {
    "dataset_summary": (
        ["genotypes"],
        """
SELECT pop, CAST(count(DISTINCT ind) AS BIGINT) AS n_ind,
       (SELECT count(DISTINCT locus) FROM genotypes) AS n_loci,
       (SELECT count(DISTINCT pop) FROM genotypes) AS n_pop,
       (SELECT count(*) FROM (SELECT DISTINCT pop, ind FROM genotypes)) AS tot_ind
FROM genotypes GROUP BY pop""",
    ),
    "population_list": (["genotypes"], "SELECT DISTINCT pop FROM genotypes ORDER BY pop"),
    "individual_list": (["genotypes"], "SELECT DISTINCT pop, ind FROM genotypes ORDER BY pop, ind"),
    "locus_list": (["genotypes"], "SELECT DISTINCT locus FROM genotypes ORDER BY locus"),
    "locus_summary": (
        ["genotypes"],
        """
WITH symbols AS (SELECT DISTINCT locus, allele FROM (
       SELECT locus, allele1 AS allele FROM genotypes UNION ALL SELECT locus, allele2 FROM genotypes))
SELECT locus, count(*) FILTER (WHERE allele NOT IN ('0', '?', '.')) AS n_alleles,
       bool_or(allele IN ('0', '?', '.')) AS has_missing,
       CASE WHEN count(*) FILTER (WHERE allele NOT IN ('0', '?', '.')) > 0
            THEN string_agg(allele, ' ' ORDER BY allele) ELSE '' END AS alleles
FROM symbols GROUP BY locus""",
    ),
    "typed_genotypes": (
        ["clean"],
        "SELECT pop, ind, locus, a1 AS allele1, a2 AS allele2, a1 <> a2 AS is_het FROM clean WHERE a1 IS NOT NULL AND a2 IS NOT NULL",
    ),
    "missing_as_null": (["clean"], "SELECT pop, ind, locus, a1 AS allele1, a2 AS allele2 FROM clean"),
    "duplicate_genotypes": (
        ["raw_genotypes"],
        "SELECT pop, ind, locus, count(*) AS n_rows FROM raw_genotypes GROUP BY pop, ind, locus HAVING count(*) > 1",
    ),
    "drop_empty_loci": (
        ["genotypes"],
        """
SELECT locus || '_' || allele1 || allele2 AS locus, pop, ind, allele1, allele2 FROM genotypes
WHERE NOT (allele1 = '0' AND allele2 = '0')""",
    ),
    "heterozygosity_by_individual": (
        ["clean"],
        f"""
WITH c AS (SELECT pop, ind, count(*) FILTER (WHERE a1 IS NOT NULL AND a2 IS NOT NULL) AS n_typed,
       count(*) FILTER (WHERE a1 <> a2) AS n_het FROM clean GROUP BY pop, ind)
SELECT pop, ind, n_typed, {_HET_TAIL} FROM c""",
    ),
    "heterozygosity_by_locus": (
        ["clean"],
        f"""
WITH c AS (SELECT p.pop, l.locus, count(*) FILTER (WHERE a1 IS NOT NULL AND a2 IS NOT NULL) AS n_typed,
       count(*) FILTER (WHERE a1 <> a2) AS n_het
     FROM (SELECT DISTINCT pop FROM clean) p CROSS JOIN (SELECT DISTINCT locus FROM clean) l
     LEFT JOIN clean g ON g.pop = p.pop AND g.locus = l.locus GROUP BY p.pop, l.locus)
SELECT pop, locus, n_typed, {_HET_TAIL} FROM c""",
    ),
    "hwe_disequilibrium": (
        ["clean"],
        """
WITH grid AS (SELECT p.pop, p.first_ind, l.locus FROM (SELECT pop, min(ind) AS first_ind FROM clean GROUP BY pop) p
              CROSS JOIN (SELECT DISTINCT locus FROM clean) l),
tgt AS (SELECT grid.pop, grid.locus, c.a1 AS t FROM grid LEFT JOIN clean c
        ON c.pop = grid.pop AND c.locus = grid.locus AND c.ind = grid.first_ind),
cnt AS (SELECT tgt.pop, tgt.locus, t,
          count(*) FILTER (WHERE a1 IS NOT NULL AND a2 IS NOT NULL) AS n,
          count(*) FILTER (WHERE a1 = t AND a2 = t) AS n11,
          count(*) FILTER (WHERE (a1 = t AND a2 <> t) OR (a2 = t AND a1 <> t)) AS n12
        FROM tgt LEFT JOIN clean c ON c.pop = tgt.pop AND c.locus = tgt.locus GROUP BY tgt.pop, tgt.locus, t),
st AS (SELECT *, t IS NOT NULL AND n11 >= 5 AND n - n11 >= 5 AS ok,
          (2.0::DOUBLE * n11 + n12) / nullif(2.0::DOUBLE * n, 0) AS p FROM cnt),
dd AS (SELECT *, n11 / CAST(nullif(n, 0) AS DOUBLE) - p * p AS d0,
          1.96::DOUBLE * sqrt(p * p * (1 - p) * (1 - p) / nullif(n, 0)) AS h0 FROM st)
SELECT pop, locus, n AS n_typed, CASE WHEN ok THEN round(d0, 6) END AS d,
       CASE WHEN ok THEN round(h0, 6) END AS half_width,
       CASE WHEN ok THEN (CASE WHEN d0 >= 0 THEN d0 - h0 >= 0 ELSE d0 + h0 <= 0 END) END AS significant
FROM dd""",
    ),
}

ORACLES = {name: A.with_tables(tables, body) for name, (tables, body) in _RAW.items()}
