"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the five ASCII line and tab controls.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
#: A-Z to a-z and nothing else: other letters keep their case.
LOWER = {c: c + 32 for c in range(65, 91)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text as a native expression; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def slices(batch, rows: int):
    """Parts of an Arrow batch of at most ``rows`` rows, so that long texts do not add up."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def let(value: Column, body) -> Column:
    """``body(x)`` with ``x`` bound to ``value``, computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
