"""Column functions: all native expressions, nothing per-row in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Allele symbols that mean "not typed".
MISSING_ALLELES = ("0", "?", ".")

# Normal quantile of the reported intervals, base units of to_units.
Z_95 = 1.96
UNIT_BASES = {"b": 1.0, "kb": 1_000.0, "mb": 1_000_000.0}

DEFAULT_CONTIG_LENGTH = 10_000_000


def null_missing(allele: Column) -> Column:
    """The allele, or NULL for a missing symbol."""
    return F.when(~allele.isin(*MISSING_ALLELES), allele)


def plain_symbol(call: Column) -> Column:
    """A call of one character, which is its only allele symbol."""
    return (F.length(call) == 1) & ~call.isin(":", "|", "/")


def call_fields(call: Column) -> Column:
    """Allele symbols of one call; a call of one character is not taken apart."""
    apart = F.split(F.split_part(call, F.lit(":"), F.lit(1)), r"[|/]")
    return F.when(plain_symbol(call), F.array(call)).otherwise(apart)


def called(allele1: Column, allele2: Column) -> Column:
    """Both alleles typed."""
    return allele1.isNotNull() & allele2.isNotNull()


def is_het(allele1: Column, allele2: Column) -> Column:
    return called(allele1, allele2) & (allele1 != allele2)


def proportion_interval(hits: Column, total: Column) -> tuple[Column, Column]:
    """Proportion and the half width of its 95 % interval; NULL when total is 0."""
    share = hits.cast("double") / F.nullif(total.cast("double"), F.lit(0.0))
    half = F.lit(Z_95) * F.sqrt(share * (1 - share) / F.nullif(total.cast("double"), F.lit(0.0)))
    return share, half


def chrom_id(chrom: Column) -> Column:
    """Integer prefix of the name without a leading ``chr``; 0 when there is none."""
    digits = F.regexp_extract(chrom, r"^(?:chr)?\s*([+-]?\d+)", 1)
    return F.coalesce(digits.try_cast("int"), F.lit(0))


def frac_to_bp(frac: Column, length: Column) -> Column:
    """floor(frac * length), clipped to [0, length]."""
    bp = F.floor(frac * length.cast("double")).cast("bigint")
    return F.greatest(F.lit(0).cast("bigint"), F.least(bp, length.cast("bigint")))


def frac_to_vcf_pos(frac: Column, length: Column) -> Column:
    """1-based position of a 0-1 location, clamped to [1, length]."""
    bp = F.floor(frac * length.cast("double")).cast("bigint") + 1
    return F.greatest(F.lit(1).cast("bigint"), F.least(bp, length.cast("bigint")))


def bp_to_frac(pos: Column, length: Column, default_length: int = DEFAULT_CONTIG_LENGTH) -> Column:
    """pos * (1 / length); an unknown or zero length counts as ``default_length``."""
    known = F.coalesce(F.nullif(length.cast("double"), F.lit(0.0)), F.lit(float(default_length)))
    return pos.cast("double") * (F.lit(1.0) / known)


def to_units(frac: Column, length: Column, unit: str = "b") -> Column:
    """Length fraction in whole bases, kilobases or megabases, rounded up."""
    return F.ceil(length.cast("double") * frac / F.lit(UNIT_BASES[unit])).cast("bigint")


def frac_to_site(frac: Column, length: Column) -> Column:
    """0-based site index of a 0-1 location: ceil(frac * length) - 1."""
    return F.ceil(frac * length.cast("double")).cast("bigint") - 1


def haplotype_code(ord_: Column, homolog: Column) -> Column:
    """Column of a founder haplotype: two columns per founder, paternal first."""
    return ord_ * 2 + F.when(homolog == 1, 1).otherwise(0)


def expected_tmrca(samples: Column, size: Column) -> Column:
    """4N(1 - 1/n)."""
    return F.lit(4.0) * size * (1 - F.lit(1.0) / samples)


def expected_tmrca_theta(samples: Column, theta: Column) -> Column:
    """2 theta (1 - 1/n)."""
    return F.lit(2.0) * theta * (1 - F.lit(1.0) / samples)


def expected_segregating_sites(samples: Column, theta: Column) -> Column:
    """theta times the (n-1)-th harmonic number."""
    terms = F.transform(F.sequence(F.lit(1), samples.cast("int") - 1), lambda i: F.lit(1.0) / i)
    return theta * F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def exponential_cdf(t: Column, theta: Column) -> Column:
    return F.when(t <= 0, 0.0).otherwise(1 - F.exp(-t / theta))


def truncated_exponential_cdf(t: Column, theta: Column, tau: Column) -> Column:
    """P(T <= t | T < tau) for an exponential of mean theta."""
    inner = (1 - F.exp(-t / theta)) / (1 - F.exp(-tau / theta))
    return F.when(t <= 0, 0.0).when(t >= tau, 1.0).otherwise(inner)


def truncated_exponential_mean(theta: Column, tau: Column) -> Column:
    tail = F.exp(-tau / theta)
    return theta * (1 - (tau / theta + 1) * tail) / (1 - tail)


def truncated_exponential_quantile(p: Column, theta: Column, tau: Column) -> Column:
    return -theta * F.log(1 - p * (1 - F.exp(-tau / theta)))
