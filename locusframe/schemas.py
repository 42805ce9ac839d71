"""Explicit schemas of the domain tables; readers never infer."""

from __future__ import annotations

GENOTYPES = "pop string, ind string, locus string, allele1 string, allele2 string"
PEDIGREE = "ind string, father string, mother string, pop int, line_no bigint"
VARIANTS = (
    "file_id string, chrom string, pos bigint, id string, ref string, alt string, qual string, "
    "filter string, info string, format string, gts array<string>"
)
SAMPLES = "file_id string, sample_idx int, sample_id string"
CONTIGS = "file_id string, chrom string, length bigint"
META = "file_id string, line_no bigint, line string"
MARKERS = "chrom string, pos bigint"
SEGMENTS = (
    "ind string, chrom int, homolog int, seq int, start double, end double, "
    "founder string, f_homolog int"
)
FOUNDERS = "founder string, ord int"
HAPLOTYPES = "founder string, homolog int, seq_len bigint"
HAPLOTYPE_CHUNKS = "founder string, homolog int, chunk_no bigint, bases string"
TARGET_REGIONS = "region_id bigint, start double, end double"
MRCA_INTERVALS = "rep string, ins_no bigint, lower double, upper double, age double"
TREES = "rep string, tree_no bigint, lower double, upper double, newick string"
REPLICATES = "scenario string, rep bigint, metric double"
POP_MAP = "line_no bigint, pattern string, pop string"
