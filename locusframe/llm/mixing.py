"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import word_count
from locusframe.session import materialize

AXES = ("source", "lang", "topic")
#: Cells that are raked on the driver; more of them are raked by Spark.
DRIVER_CELLS = 200_000
NEW = ("n_tokens", "topic", "probability", "weight", "selected")


def topic_of(text: Column) -> Column:
    """The form of a text as its topic: empty, tabular, licence, personal, numeric or prose; the first that fits."""
    return (
        F.when(F.coalesce(F.length(F.trim(text)), F.lit(0)) == 0, "empty")
        .when(text.contains(" | "), "tabular")
        .when(F.lower(text).contains("licensed under") | text.contains("Copyright"), "licence")
        .when(text.rlike(r"@|\d{4}"), "numeric")
        .otherwise("prose")
    )


def rake(mass: np.ndarray, targets: list[np.ndarray], rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """``mass`` (one axis a target) scaled until each axis sums to its target share.

    Each round scales the axes in turn. Cells without mass stay empty, and a
    category without mass gives its share to the others.
    """
    return rake_cells(np.indices(mass.shape).reshape(mass.ndim, -1), mass.ravel(), targets, rounds, tolerance).reshape(mass.shape)


def rake_cells(place: np.ndarray, mass: np.ndarray, targets: list[np.ndarray], rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """``rake`` of listed cells; ``place`` has the category number of each cell, a row an axis."""
    out = mass / max(mass.sum(), 1e-300)
    want = []
    for at, t in zip(place, targets, strict=True):
        t = np.where(np.bincount(at, out, len(t)) > 0, t, 0.0)
        want.append(t / t.sum() if t.sum() > 0 else t)
    for _ in range(rounds):
        worst = 0.0
        for at, t in zip(place, want, strict=True):
            sums = np.bincount(at, out, len(t))
            factor = np.divide(t, sums, out=np.zeros_like(t), where=sums > 0)
            worst = max(worst, float(np.abs(sums - t).max(initial=0)))
            out = out * factor[at]
        if worst < tolerance:
            break
    return out


def _rake_on_driver(cells: DataFrame, targets: dict[str, dict[str, float]], power: float) -> DataFrame:
    rows = cells.collect()
    mass = np.array([r["n"] for r in rows], dtype=float)
    place, wanted = [], []
    for a in AXES:
        names = {c: i for i, c in enumerate(dict.fromkeys(r[f"_{a}"] for r in rows))}
        place.append(np.array([names[r[f"_{a}"]] for r in rows], dtype=np.int64))
        given = targets.get(a)
        wanted.append(np.array([given.get(c, 0.0) for c in names]) if given else tempered(np.bincount(place[-1], mass, len(names)), power))
    raked = rake_cells(np.array(place), mass, wanted)
    return cells.sparkSession.createDataFrame([(*r, float(x)) for r, x in zip(rows, raked, strict=True)], f"{cells.schema.simpleString()[7:-1]},raked:double".replace(":", " "))


def _rake_in_spark(cells: DataFrame, targets: dict[str, dict[str, float]], power: float, rounds: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """The same as jobs: each axis sums its categories and joins the factors back, as a written table."""
    total = float(max(cells.agg(F.sum("n")).first()[0] or 0, 1e-300))
    out, want = cells.withColumn("raked", F.col("n") / total), {}
    for a in AXES:
        seen = cells.groupBy(f"_{a}").agg(F.sum("n").cast("double").alias("n")).where("n > 0")
        if given := targets.get(a):
            named = cells.sparkSession.createDataFrame([(c, float(t)) for c, t in given.items()], f"_{a} string, t double")
            seen = seen.join(named, f"_{a}").select(f"_{a}", "t")
        else:
            seen = seen.select(f"_{a}", F.pow("n", F.lit(power)).alias("t"))
        of_all = float(seen.agg(F.sum("t")).first()[0] or 0) or 1.0
        want[a] = materialize(seen.withColumn("t", F.col("t") / of_all), "wanted")
    for _ in range(rounds):
        worst = 0.0
        for a in AXES:
            sums = out.groupBy(f"_{a}").agg(F.sum("raked").alias("s")).join(want[a], f"_{a}", "left").withColumn("t", F.coalesce("t", F.lit(0.0)))
            factors = materialize(sums.select(f"_{a}", F.when(F.col("s") > 0, F.col("t") / F.col("s")).otherwise(0.0).alias("factor"), F.abs(F.col("s") - F.col("t")).alias("gap")), "factors")
            worst = max(worst, factors.agg(F.max("gap")).first()[0] or 0.0)
            out = materialize(out.join(factors, f"_{a}").select(*cells.columns, (F.col("raked") * F.col("factor")).alias("raked")), "raked")
        if worst < tolerance:
            break
    return out


def tempered(sums: np.ndarray, power: float) -> np.ndarray:
    """Shares in proportion to mass to a power below one: large categories shrink, small ones grow."""
    t = np.where(sums > 0, np.maximum(sums, 1e-300) ** power, 0.0)
    return t / t.sum() if t.sum() > 0 else t


def mix_probabilities(
    docs: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    power: float = 0.95,
    topic: Column | None = None,
    seed: int = 17,
    driver_cells: int = DRIVER_CELLS,
) -> DataFrame:
    """``docs`` with n_tokens, source, lang and topic categories, ``probability``, ``weight`` and ``selected``.

    Tokens are words. ``targets`` gives the wanted token share of categories per
    axis; an axis without targets gets the observed shares to ``power``. Cell
    weights are raked to all marginals, and a document of a cell is selected
    with the probability that makes the expected tokens of every cell
    proportional to its raked weight, 1 in the cell that lacks most. A seeded
    hash of id and text decides, so a rerun selects the same rows and equal rows
    share their fate. ``weight`` is the raked share over the observed one.

    One scan with map-side sums gives the cells, every category by its own name.
    Up to ``driver_cells`` of them are raked on the driver, more by Spark jobs
    with a written table a step. The planner broadcasts the raked cells where
    they are small, so documents are then not shuffled.

    Null categories count as "". Null or blank texts have no tokens; their cell
    decides like any other, with probability 1 where the cell has no tokens.
    Repeated rows are sampled alike; an empty table gives no rows; columns of
    ``docs`` named like the new ones (n_tokens, topic, probability, weight,
    selected) are replaced, source and lang are kept as they are.
    """
    topic = topic_of(F.col("text")) if topic is None else topic
    base = docs.withColumns({"_topic": topic, "_tokens": word_count(F.col("text"))}).drop(*NEW).withColumnsRenamed({"_topic": "topic", "_tokens": "n_tokens"})
    named = base.withColumns({f"_{a}": F.coalesce(F.col(a).cast("string"), F.lit("")) for a in AXES})
    keys = [f"_{a}" for a in AXES]
    cells = materialize(named.groupBy(*keys).agg(F.sum("n_tokens").alias("n")), "cells")
    raked = (_rake_on_driver if cells.count() <= driver_cells else _rake_in_spark)(cells, targets or {}, power)
    total = max(float(cells.agg(F.sum("n")).first()[0] or 0), 1e-300)
    weighed = materialize(raked.select(*keys, "n", F.when(F.col("n") > 0, F.col("raked") / (F.col("n") / total)).otherwise(0.0).alias("weight")), "weights")
    highest = max(float(weighed.agg(F.max("weight")).first()[0] or 0), 1e-300)
    cell = weighed.select(*keys, "weight", F.when(F.col("n") > 0, F.col("weight") / highest).otherwise(1.0).alias("probability"))
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return named.join(cell, keys).withColumn("selected", draw < F.col("probability")).drop(*keys)


def mix(docs: DataFrame, **how) -> DataFrame:
    """The selected rows of ``docs`` with all their own columns, whatever their names."""
    own = {c: f"_own_{c}" for c in docs.columns if c in NEW}
    kept = docs.withColumns({to: F.col(c) for c, to in own.items()})
    picked = mix_probabilities(kept, **how).where("selected")
    return picked.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))
