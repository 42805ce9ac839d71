"""Subsampling of variant sets by region, individual and marker."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from locusframe.operators import markers as M
from locusframe.session import materialize


@dataclass(frozen=True)
class VariantSet:
    """One or more variant files as tables; ``file_id`` tells them apart."""

    variants: DataFrame
    samples: DataFrame
    contigs: DataFrame | None = None
    meta: DataFrame | None = None


def _narrow(cohort: VariantSet, picked: DataFrame | None, ids: DataFrame | None) -> VariantSet:
    variants, samples = cohort.variants, cohort.samples
    if picked is not None:
        variants = M.filter_markers(variants, picked)
    if ids is not None:
        variants, samples = M.select_samples(variants, samples, ids)
    return replace(cohort, variants=variants, samples=samples)


def sample_vcf(
    cohort: VariantSet,
    ids: DataFrame | None = None,
    k: int | None = None,
    method: str = "uniform",
    region: str | None = None,
    seed: int = 0,
) -> VariantSet:
    """Subsample one file; markers are counted per record.

    The selected markers are written once, so the records are joined with a
    table of known size and the contig list reuses it.
    """
    cohort = replace(cohort, variants=M.filter_region(cohort.variants, region))
    if k is None:
        return _narrow(cohort, None, ids)
    markers = cohort.variants.select("chrom", "pos")
    picked = materialize(M.pick_markers(markers, k, method, seed, count_records=True), "picked-markers")
    out = _narrow(cohort, picked, ids)
    if cohort.contigs is not None:
        out = replace(out, contigs=M.prune_contigs(cohort.contigs, picked))
    return out


def sample_vcfs_shared(
    cohort: VariantSet,
    n_files: int,
    k: int,
    ids: DataFrame | None = None,
    method: str = "uniform",
    region: str | None = None,
    seed: int = 0,
) -> VariantSet:
    """Subsample several files at the same markers, chosen among the shared ones."""
    cohort = replace(cohort, variants=M.filter_region(cohort.variants, region))
    inside = cohort.variants.select("file_id", "chrom", "pos")
    shared = M.shared_markers(inside, n_files)
    picked = materialize(M.pick_markers(shared, k, method, seed), "picked-markers")
    if picked.isEmpty():
        raise ValueError("no marker is shared by all input files")
    return _narrow(cohort, picked, ids)
