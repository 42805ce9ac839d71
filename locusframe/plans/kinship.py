"""Kinship report: validation, then the asked measure."""

from __future__ import annotations

from pyspark.sql import DataFrame

from locusframe.operators import kinship as K
from locusframe.operators.pedigree import settled_levels, validate_pedigree


class PedigreeError(ValueError):
    """The pedigree has errors; ``errors`` is the table of all of them."""

    def __init__(self, errors: DataFrame):
        super().__init__("the pedigree has errors; see .errors")
        self.errors = errors


def kinship_report(
    ped: DataFrame,
    measure: str = "kinship",
    pairs: DataFrame | None = None,
    validate: bool = True,
    ids: DataFrame | None = None,
) -> DataFrame:
    """``kinship``, ``inbreeding`` or ``relatedness``.

    ``pairs`` (a, b) limits kinship to those pairs, ``ids`` (one column) to the
    listed individuals against all.  The generation levels are settled once,
    for the validation and the measure.
    """
    levels = None
    if validate:
        levels, unsettled = settled_levels(ped)
        errors = validate_pedigree(ped, unsettled=unsettled)
        if not errors.isEmpty():
            raise PedigreeError(errors)
    if measure == "inbreeding":
        return K.inbreeding(ped, levels)
    if measure == "kinship":
        if pairs is not None:
            return K.kinship_of(ped, pairs, levels)
        return K.kinship_pairs(ped, levels) if ids is None else K.kinship_columns(ped, ids, levels)
    if measure == "relatedness":
        return K.relatedness(K.kinship_pairs(ped, levels))
    raise ValueError(f"unknown measure {measure!r}")
