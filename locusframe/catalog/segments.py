"""Registered queries on segments, intervals and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusframe import adapters as A
from locusframe.functions import scalars as S
from locusframe.operators import intervals as I
from locusframe.operators import segments as G
from locusframe.operators import sequences as Q
from locusframe.plans import assembly as P

HOMOLOG = ["ind", "chrom", "homolog"]


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _spans(s, d):
    """MRCA intervals as plain spans with a group of their own."""
    iv = A.mrca_intervals(s, d)
    return iv.select("ins_no", F.col("lower").alias("start"), F.col("upper").alias("end"), (F.col("ins_no") % 997).alias("g"))


def _points(s, d):
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    return A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (k % 1000 / F.lit(1000.0)).alias("frac"))


def _last_writer(s, d):
    laid = I.overlay(A.supplier_segments(s, d), HOMOLOG, "seq", ["founder", "f_homolog"], "last")
    return _rounded(laid, "start", "end")


def _assembled_vcf(s, d):
    records, samples = P.assemble_vcf(
        A.variants(s, d), A.segments(s, d), A.founders(s, d), A.contigs(s, d), between=" "
    )
    return records.select(
        "chrom", "pos", "ref", "alt",
        samples.agg(F.count(F.lit(1))).scalar().alias("n_samples"),
        F.md5("calls").alias("gts_md5"),
    )


def _calls_by_individual(s, d):
    """Assembled calls per descendant: sites, heterozygous sites, derived alleles."""
    descendants = G.drop_founders(
        A.segments(s, d),
        A.pedigree(s, d).where("father IS NULL").select(F.col("ind").alias("founder")),
    )
    samples = G.sample_columns(descendants)
    records = G.project_variants(A.variants(s, d), descendants, A.founders(s, d), A.contigs(s, d), samples, counted=True)
    return G.calls_by_sample(records, samples)


def _sequences(s, d, laid=False):
    return P.assemble_sequences(
        A.supplier_segments(s, d), A.haplotype_chunks(s, d), A.founders(s, d),
        A.sequence_length(s, d), chunk_bases=A.CHUNK, laid=laid,
    )


def _called(s, d):
    sites = P.call_assembled_sites(_sequences(s, d, laid=True), A.CHUNK, between=" ")
    return sites.select("chrom", "pos", "ref", "alt", F.col("calls").alias("gts"))


def _range(s, d):
    return Q.read_range(A.haplotype_chunks(s, d), "N3", 1, 50, A.sequence_length(s, d) - 70, A.CHUNK)


def _relationship(s, d):
    pairs = A.relatives(s, d).withColumn("relationship", F.concat(F.lit("d"), F.length("a")))
    expected = pairs.select("relationship").distinct().withColumn("expected", F.lit(0.25))
    return _rounded(
        P.realized_kinship_report(A.segments(s, d), pairs, A.N_CHROMS, expected),
        "mean", "sd_pop", "sd_samp", "cv", "se", "ci95", "expected", "diff_pct",
    )


QUERIES = {
    "clip_segments": lambda s, d: _rounded(I.clip(A.segments(s, d), 0.25, 0.75), "start", "end"),
    "merge_segments": lambda s, d: G.merge_segments(A.segments(s, d)),
    "elementary_intervals": lambda s, d: I.elementary_intervals(A.segments(s, d), ["ind", "chrom"]),
    "overlay_first_writer": lambda s, d: I.mrca_overlay(A.mrca_intervals(s, d)),
    "overlay_last_writer": _last_writer,
    "drop_founders": lambda s, d: G.drop_founders(
        A.segments(s, d), A.pedigree(s, d).where("father IS NULL").select(F.col("ind").alias("founder"))
    ).select("ind", "chrom", "homolog", "seq"),
    "haplotype_index": lambda s, d: G.haplotype_index(A.segments(s, d), A.founders(s, d)).select(*HOMOLOG, "seq", "hap"),
    "founder_calls": lambda s, d: G.founder_calls(A.variants(s, d)),
    "realized_kinship": lambda s, d: _rounded(G.realized_kinship(A.segments(s, d), A.relatives(s, d), A.N_CHROMS), "phi"),
    "realized_kinship_report": _relationship,
    "in_target_regions": lambda s, d: I.in_target_regions(_points(s, d), A.target_regions(s, d)),
    "overlaps_targets": lambda s, d: I.overlaps_targets(_spans(s, d), A.target_regions(s, d)),
    "groups_overlapping": lambda s, d: I.groups_overlapping(_spans(s, d), A.target_regions(s, d), ["g"]),
    "mrca_by_age": lambda s, d: _rounded(I.mrca_by_age(A.mrca_intervals(s, d)), "length"),
    "mrca_summary": lambda s, d: _rounded(
        P.mrca_report(A.mrca_intervals(s, d))[0],
        "youngest_tmrca", "avg_tmrca", "largest_mrca", "smallest_mrca", "weighted_tmrca",
    ),
    "mrca_regions": lambda s, d: I.mrca_regions(A.mrca_intervals(s, d)),
    "mrca_report_by_age": lambda s, d: _rounded(P.mrca_report(A.mrca_intervals(s, d))[1].drop("num_ints"), "length"),
    "mrca_report_by_region": lambda s, d: P.mrca_report(A.mrca_intervals(s, d))[2],
    "assemble_vcf": _assembled_vcf,
    "assembled_calls_by_individual": _calls_by_individual,
    "assemble_sequences": _sequences,
    "base_counts": lambda s, d: Q.base_counts(_sequences(s, d, laid=True), A.CHUNK),
    "call_assembled_sites": _called,
    "read_range": _range,
}

_OVERLAY = """
pt AS (SELECT DISTINCT rep, unnest([lower, upper]) AS p FROM mrca_intervals),
el AS (SELECT rep, p AS lo, lead(p) OVER (PARTITION BY rep ORDER BY p) AS hi FROM pt),
win AS (SELECT el.rep, el.lo, el.hi, min(i.ins_no) AS ins_no FROM el JOIN mrca_intervals i
        ON i.rep = el.rep AND i.lower <= el.lo AND i.upper >= el.hi WHERE el.hi IS NOT NULL GROUP BY el.rep, el.lo, el.hi),
fl AS (SELECT *, CASE WHEN lag(ins_no) OVER w = ins_no AND lag(hi) OVER w = lo THEN 0 ELSE 1 END AS fresh
       FROM win WINDOW w AS (PARTITION BY rep ORDER BY lo)),
gr AS (SELECT *, sum(fresh) OVER (PARTITION BY rep ORDER BY lo) AS run FROM fl),
laid AS (SELECT g.rep, min(g.lo) AS lower, max(g.hi) AS upper, g.ins_no, i.age FROM gr g
         JOIN mrca_intervals i ON i.rep = g.rep AND i.ins_no = g.ins_no GROUP BY g.rep, g.run, g.ins_no, i.age)"""

_PROJECT = """
fr AS (SELECT v.chrom, pos, ref, alt, gts, CAST(substr(v.chrom, 4) AS INTEGER) AS c,
              CAST(pos AS DOUBLE) * (1.0::DOUBLE / length) AS x FROM variants v JOIN contigs USING (chrom)),
sg AS (SELECT s.*, 2 * ord + f_homolog AS hap FROM segments s JOIN founders USING (founder)),
one AS (SELECT fr.chrom, fr.pos, fr.ref, fr.alt, sg.ind, sg.homolog, fr.gts[sg.hap + 1] AS g
        FROM fr JOIN sg ON fr.c = sg.chrom AND fr.x >= sg.start AND fr.x < sg."end"),
gt AS (SELECT chrom, pos, ref, alt, ind,
              coalesce(max(g) FILTER (WHERE homolog = 0), '0') AS p, coalesce(max(g) FILTER (WHERE homolog = 1), '0') AS m
       FROM one GROUP BY chrom, pos, ref, alt, ind)"""

_BASES = f"""
len AS (SELECT {A.CHUNK} * count(*) AS l FROM part),
sp AS (SELECT ind, homolog, seq, founder, f_homolog, CAST(floor(start * l) AS BIGINT) AS lo,
              CAST(floor("end" * l) AS BIGINT) AS hi FROM supplier_segments, len),
ids AS (SELECT DISTINCT ind, homolog FROM sp),
cv AS (SELECT i.ind, i.homolog, c.chunk_no, o, max(sp.seq) AS seq
       FROM ids i CROSS JOIN (SELECT p_partkey AS chunk_no FROM part) c CROSS JOIN range(0, {A.CHUNK}) AS r(o)
       LEFT JOIN sp ON sp.ind = i.ind AND sp.homolog = i.homolog
            AND sp.lo <= c.chunk_no * {A.CHUNK} + o AND sp.hi > c.chunk_no * {A.CHUNK} + o
       GROUP BY i.ind, i.homolog, c.chunk_no, o),
bs AS (SELECT cv.ind, cv.homolog, cv.chunk_no, cv.o,
              coalesce(substr(h.bases, CAST(cv.o + 1 AS INTEGER), 1), 'N') AS b
       FROM cv LEFT JOIN sp ON sp.ind = cv.ind AND sp.homolog = cv.homolog AND sp.seq = cv.seq
       LEFT JOIN haplotype_chunks h ON h.founder = sp.founder AND h.homolog = sp.f_homolog AND h.chunk_no = cv.chunk_no),
cnt AS (SELECT 1 AS chrom, chunk_no * {A.CHUNK} + o + 1 AS pos, count(*) FILTER (WHERE b = 'A') AS n_a,
               count(*) FILTER (WHERE b = 'C') AS n_c, count(*) FILTER (WHERE b = 'G') AS n_g,
               count(*) FILTER (WHERE b = 'T') AS n_t FROM bs WHERE b <> 'N' GROUP BY chunk_no, o)"""

_RAW = {
    "clip_segments": (
        ["segments"],
        """
SELECT ind, chrom, homolog, seq, founder, f_homolog, round(greatest(start, 0.25), 6) AS start,
       round(least("end", 0.75), 6) AS "end" FROM segments WHERE "end" > 0.25 AND start < 0.75""",
    ),
    "merge_segments": (
        ["segments"],
        """
WITH fl AS (SELECT *, CASE WHEN lag(founder) OVER w = founder AND lag(f_homolog) OVER w = f_homolog THEN 0 ELSE 1 END AS fresh
            FROM segments WINDOW w AS (PARTITION BY ind, chrom, homolog ORDER BY start, seq)),
gr AS (SELECT *, sum(fresh) OVER (PARTITION BY ind, chrom, homolog ORDER BY start, seq) AS run FROM fl)
SELECT ind, chrom, homolog, founder, f_homolog, min(start) AS start, arg_max("end", seq) AS "end"
FROM gr GROUP BY ind, chrom, homolog, run, founder, f_homolog""",
    ),
    "elementary_intervals": (
        ["segments"],
        """
WITH pt AS (SELECT DISTINCT ind, chrom, unnest([start, "end"]) AS p FROM segments),
el AS (SELECT ind, chrom, p AS start, lead(p) OVER (PARTITION BY ind, chrom ORDER BY p) AS "end" FROM pt)
SELECT * FROM el WHERE "end" IS NOT NULL""",
    ),
    "overlay_first_writer": (["mrca_intervals"], f"WITH {_OVERLAY} SELECT rep, lower, upper, age, ins_no FROM laid"),
    "overlay_last_writer": (
        ["supplier_segments"],
        """
WITH pt AS (SELECT DISTINCT ind, chrom, homolog, unnest([start, "end"]) AS p FROM supplier_segments),
el AS (SELECT *, lead(p) OVER (PARTITION BY ind, chrom, homolog ORDER BY p) AS hi FROM pt),
win AS (SELECT el.ind, el.chrom, el.homolog, el.p, el.hi, max(s.seq) AS seq FROM el JOIN supplier_segments s
        ON s.ind = el.ind AND s.homolog = el.homolog AND s.start <= el.p AND s."end" >= el.hi
        WHERE el.hi IS NOT NULL GROUP BY ALL),
fl AS (SELECT *, CASE WHEN lag(seq) OVER w = seq AND lag(hi) OVER w = p THEN 0 ELSE 1 END AS fresh
       FROM win WINDOW w AS (PARTITION BY ind, chrom, homolog ORDER BY p)),
gr AS (SELECT *, sum(fresh) OVER (PARTITION BY ind, chrom, homolog ORDER BY p) AS run FROM fl)
SELECT g.ind, g.chrom, g.homolog, round(min(g.p), 6) AS start, round(max(g.hi), 6) AS "end", g.seq, s.founder, s.f_homolog
FROM gr g JOIN supplier_segments s ON s.ind = g.ind AND s.homolog = g.homolog AND s.seq = g.seq
GROUP BY g.ind, g.chrom, g.homolog, g.run, g.seq, s.founder, s.f_homolog""",
    ),
    "drop_founders": (
        ["segments", "pedigree"],
        """
SELECT ind, chrom, homolog, seq FROM segments
WHERE ind NOT IN (SELECT ind FROM pedigree WHERE father IS NULL)""",
    ),
    "haplotype_index": (
        ["segments", "founders"],
        "SELECT ind, chrom, homolog, seq, 2 * ord + f_homolog AS hap FROM segments JOIN founders USING (founder)",
    ),
    "founder_calls": (
        ["variants"],
        """
SELECT chrom, pos, ref, alt, i AS hap, CAST(g AS INTEGER) AS allele
FROM (SELECT chrom, pos, ref, alt, unnest(gts) AS g, unnest(range(0, 50)) AS i FROM variants)""",
    ),
    "realized_kinship": (
        ["segments", "relatives"],
        """
WITH cell AS (SELECT ind, chrom, homolog, t, founder, f_homolog FROM segments, range(0, 10) AS r(t)
              WHERE start <= (t + 0.5) / 10 AND (t + 0.5) / 10 < "end")
SELECT p.a, p.b, round(count(y.ind) * 0.1 / 4 / 5, 6) AS phi FROM relatives p JOIN cell x ON x.ind = p.a
LEFT JOIN cell y ON y.ind = p.b AND y.chrom = x.chrom AND y.t = x.t AND y.founder = x.founder AND y.f_homolog = x.f_homolog
GROUP BY p.a, p.b""",
    ),
    "realized_kinship_report": (
        ["segments", "relatives"],
        """
WITH cell AS (SELECT ind, chrom, homolog, t, founder, f_homolog FROM segments, range(0, 10) AS r(t)
              WHERE start <= (t + 0.5) / 10 AND (t + 0.5) / 10 < "end"),
k AS (SELECT p.a, p.b, count(y.ind) * 0.1::DOUBLE / 4 / 5 AS phi FROM relatives p JOIN cell x ON x.ind = p.a
LEFT JOIN cell y ON y.ind = p.b AND y.chrom = x.chrom AND y.t = x.t AND y.founder = x.founder AND y.f_homolog = x.f_homolog
GROUP BY p.a, p.b),
st AS (SELECT 'd' || length(a) AS scenario, count(*) AS n, avg(phi) AS mean, stddev_pop(phi) AS sd_pop,
              stddev_samp(phi) AS sd_samp FROM k GROUP BY 1)
SELECT scenario, n, round(mean, 6) AS mean, round(sd_pop, 6) AS sd_pop, round(sd_samp, 6) AS sd_samp,
       round(sd_pop / mean, 6) AS cv, round(sd_pop / sqrt(n), 6) AS se, round(1.96 * sd_pop / sqrt(n), 6) AS ci95,
       CAST(0.25 AS DOUBLE) AS expected, round(100 * (mean - 0.25) / 0.25, 6) AS diff_pct, abs((mean - 0.25) / 0.25) < 0.1 AS passed FROM st""",
    ),
    "in_target_regions": (
        ["target_regions"],
        """
SELECT l_orderkey, l_linenumber, frac FROM (
  SELECT l_orderkey, l_linenumber, ((l_orderkey * 7 + l_linenumber) % 1000) / 1000.0::DOUBLE AS frac FROM lineitem) p
WHERE EXISTS (SELECT 1 FROM target_regions r WHERE r.start <= p.frac AND p.frac <= r."end")""",
    ),
    "overlaps_targets": (
        ["mrca_intervals", "target_regions"],
        """
SELECT ins_no, lower AS start, upper AS "end", ins_no % 997 AS g FROM mrca_intervals i
WHERE EXISTS (SELECT 1 FROM target_regions r WHERE i.lower < r."end" AND i.upper > r.start)""",
    ),
    "groups_overlapping": (
        ["mrca_intervals", "target_regions"],
        """
WITH hit AS (SELECT DISTINCT ins_no % 997 AS g FROM mrca_intervals i
  WHERE EXISTS (SELECT 1 FROM target_regions r WHERE i.lower < r."end" AND i.upper > r.start))
SELECT ins_no, lower AS start, upper AS "end", ins_no % 997 AS g FROM mrca_intervals WHERE ins_no % 997 IN (SELECT g FROM hit)""",
    ),
    "mrca_by_age": (
        ["mrca_intervals"],
        "SELECT rep, age, round(sum(upper - lower), 6) AS length, count(*) AS num_ints FROM mrca_intervals GROUP BY rep, age",
    ),
    "mrca_summary": (
        ["mrca_intervals"],
        f"""
WITH {_OVERLAY},
ba AS (SELECT rep, age, sum(upper - lower) AS length FROM laid GROUP BY rep, age)
SELECT rep, round(min(age), 6) AS youngest_tmrca, round(avg(age), 6) AS avg_tmrca, count(*) AS n_mrcas,
       round(max(length), 6) AS largest_mrca, round(min(length), 6) AS smallest_mrca,
       round(sum(age * length) / sum(length), 6) AS weighted_tmrca FROM ba GROUP BY rep""",
    ),
    "mrca_report_by_age": (
        ["mrca_intervals"],
        f"WITH {_OVERLAY} SELECT rep, age, round(sum(upper - lower), 6) AS length FROM laid GROUP BY rep, age",
    ),
    "mrca_report_by_region": (["mrca_intervals"], f"WITH {_OVERLAY} SELECT rep, lower, upper, age FROM laid"),
    "mrca_regions": (["mrca_intervals"], "SELECT rep, lower, upper, age FROM mrca_intervals ORDER BY rep, lower"),
    "assemble_vcf": (
        ["variants", "contigs", "segments", "founders"],
        f"""
WITH {_PROJECT}
SELECT chrom, pos, ref, alt, count(*) AS n_samples, md5(string_agg(p || '|' || m, ' ' ORDER BY ind)) AS gts_md5
FROM gt GROUP BY chrom, pos, ref, alt HAVING bool_or(p = '1' OR m = '1')""",
    ),
    "assembled_calls_by_individual": (
        ["variants", "contigs", "segments", "founders", "pedigree"],
        f"""
WITH {_PROJECT}
SELECT ind, count(*) AS n_sites, count(*) FILTER (WHERE p <> m) AS n_het,
       CAST(sum(CAST(p AS INTEGER) + CAST(m AS INTEGER)) AS BIGINT) AS n_derived
FROM gt WHERE ind NOT IN (SELECT ind FROM pedigree WHERE father IS NULL) GROUP BY ind""",
    ),
    "assemble_sequences": (
        ["supplier_segments", "haplotype_chunks"],
        f"WITH {_BASES} SELECT ind, 1 AS chrom, homolog, chunk_no, string_agg(b, '' ORDER BY o) AS bases FROM bs GROUP BY ind, homolog, chunk_no",
    ),
    "base_counts": (["supplier_segments", "haplotype_chunks"], f"WITH {_BASES} SELECT * FROM cnt"),
    "call_assembled_sites": (
        ["supplier_segments", "haplotype_chunks"],
        f"""
WITH {_BASES},
rf AS (SELECT *, CASE greatest(n_a, n_c, n_g, n_t) WHEN n_a THEN 'A' WHEN n_c THEN 'C' WHEN n_g THEN 'G' ELSE 'T' END AS ref FROM cnt),
st AS (SELECT pos, ref, CASE WHEN ref <> 'A' AND n_a > 0 THEN 'A' WHEN ref <> 'C' AND n_c > 0 THEN 'C'
              WHEN ref <> 'G' AND n_g > 0 THEN 'G' WHEN ref <> 'T' AND n_t > 0 THEN 'T' END AS alt FROM rf),
cl AS (SELECT st.pos, st.ref, st.alt, bs.ind,
              max(CASE WHEN homolog = 0 AND b = alt THEN 1 ELSE 0 END) || '|' || max(CASE WHEN homolog = 1 AND b = alt THEN 1 ELSE 0 END) AS gt
       FROM st JOIN bs ON bs.chunk_no * {A.CHUNK} + bs.o + 1 = st.pos WHERE st.alt IS NOT NULL GROUP BY ALL)
SELECT 1 AS chrom, pos, ref, alt, string_agg(gt, ' ' ORDER BY ind) AS gts FROM cl GROUP BY pos, ref, alt""",
    ),
    "read_range": (
        ["haplotype_chunks"],
        f"""
WITH lim AS (SELECT {A.CHUNK} * count(*) - 70 AS e FROM part)
SELECT greatest(50, chunk_no * {A.CHUNK}) AS "offset",
       substr(bases, CAST(greatest(50 - chunk_no * {A.CHUNK}, 0) + 1 AS INTEGER),
              CAST(least(e, (chunk_no + 1) * {A.CHUNK}) - greatest(50, chunk_no * {A.CHUNK}) AS INTEGER)) AS bases
FROM haplotype_chunks, lim WHERE founder = 'N3' AND homolog = 1
  AND chunk_no * {A.CHUNK} < e AND (chunk_no + 1) * {A.CHUNK} > 50""",
    ),
}

ORACLES = {name: A.with_tables(tables, body) for name, (tables, body) in _RAW.items()}
