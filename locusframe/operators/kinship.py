"""Kinship, inbreeding and relatedness as level-by-level joins.

Three routes.  ``kinship_pairs`` holds every non-zero pair once and grows with
the number of related pairs, which is what an all-pairs answer asks for.
``kinship_columns`` answers for listed individuals against all, by two sweeps.
``gene_flow`` holds the expected share of each ancestor in each individual and
grows with individuals x ancestors; inbreeding and the kinship of given pairs
come from it without ever forming other pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.operators.pedigree import generation_levels, parent_links
from locusframe.session import Ledger, materialize


def _levels(ped: DataFrame, levels: DataFrame | None) -> tuple[DataFrame, int]:
    levels = generation_levels(ped) if levels is None else levels
    return levels, levels.agg(F.max("level")).first()[0] or 0


def _couples(born: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Children with a couple key, and one (couple, parent) row per known parent.

    Full sibs share all their older relatives, so pair work is done per couple
    and handed to the children at the end.
    """
    key = F.struct("father", "mother")
    children = born.select("ind", key.alias("couple"))
    couples = born.select(key.alias("couple")).distinct()
    parents = couples.select("couple", F.explode(F.array("couple.father", "couple.mother")).alias("parent"))
    return children, parents.where("parent IS NOT NULL")


class Mailbox:
    """Rows posted in one round for a later one, which they name in ``use``.

    Each round is written once, split by ``use``, and each part is read once.
    """

    def __init__(self, spark: SparkSession, label: str, schema: str):
        self.spark, self.schema = spark, schema
        self.root = Ledger(spark, label).root
        self.rounds = 0

    def post(self, rows: DataFrame) -> None:
        rows.write.partitionBy("use").parquet(f"{self.root}/round={self.rounds}")
        self.rounds += 1

    def take(self, use: int) -> DataFrame:
        posted = self.spark.read.schema(f"{self.schema}, round int, use int").parquet(self.root)
        return posted.where(F.col("use") == use).drop("round", "use")


def _child_levels(levels: DataFrame) -> DataFrame:
    """(member, use): the levels at which an individual has children."""
    links = parent_links(levels.select("ind", "father", "mother", F.col("level").alias("line_no")))
    return links.select(F.col("parent").alias("member"), F.col("line_no").alias("use")).distinct()


def kinship_pairs(ped: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """(a, b, phi) for every related pair once, a <= b in byte order, and every individual with itself.

    phi(j, i) is the mean of i's kinship with j's parents for every i not
    younger than j; phi(j, j) = 1/2 + phi(father, mother)/2.  Unrelated pairs
    have no row.  A level needs only the pairs of its children's parents, so a
    new pair is posted to the levels at which one of the two has children and
    forgotten after them; a pair without later children is only a result.
    """
    levels, top = _levels(ped, levels)
    spark = ped.sparkSession
    found = Ledger(spark, "kinship")
    later = Mailbox(spark, "kinship-later", "a string, b string, phi double")
    uses = materialize(_child_levels(levels), "child-levels")

    def settle(level: int, rows: DataFrame) -> None:
        new = found.append(rows)
        if level == top:
            return
        sides = new.unionByName(
            new.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "phi")
        )
        ahead = uses.where(F.col("use") > level).withColumnRenamed("member", "a")
        later.post(sides.join(ahead, "a").select("a", "b", "phi", "use"))

    own = levels.where("level = 0").select(F.col("ind").alias("a"), F.col("ind").alias("b"), F.lit(0.5).alias("phi"))
    settle(0, own)
    for level in range(1, top + 1):
        children, parents = _couples(levels.where(F.col("level") == level).select("ind", "father", "mother"))
        known = later.take(level)
        kin = materialize(
            parents.join(known.withColumnRenamed("a", "parent"), "parent")
            .groupBy("couple", F.col("b").alias("other"))
            .agg((F.sum("phi") * 0.5).alias("phi")),
            "couple-kin",
        )
        older = children.join(kin, "couple").select("ind", "other", "phi")
        between = (
            kin.join(parents.withColumnRenamed("couple", "couple2"), F.col("other") == F.col("parent"))
            .groupBy("couple", "couple2")
            .agg((F.sum("phi") * 0.5).alias("phi"))
        )
        same_level = (
            children.join(between, "couple")
            .join(children.select(F.col("ind").alias("other"), F.col("couple").alias("couple2")), "couple2")
            .where("ind < other")
            .select("ind", "other", "phi")
        )
        mates = known.select(F.struct(F.col("a").alias("father"), F.col("b").alias("mother")).alias("couple"), "phi")
        selves = children.join(mates, "couple", "left").select(
            "ind", F.col("ind").alias("other"), (0.5 + 0.5 * F.coalesce("phi", F.lit(0.0))).alias("phi")
        )
        rows = older.unionByName(same_level).unionByName(selves)
        settle(level, rows.select(F.least("ind", "other").alias("a"), F.greatest("ind", "other").alias("b"), "phi"))
    return found.read()


def kinship_table(ped: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """``kinship_pairs`` in both orders, for lookups by either individual."""
    pairs = kinship_pairs(ped, levels)
    return pairs.unionByName(pairs.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "phi"))


def relatedness(kinship: DataFrame) -> DataFrame:
    """r = 2 phi / sqrt((1 + f_a)(1 + f_b)), with 1 + f_x = 2 phi(x, x)."""
    selves = kinship.where("a = b").select(F.col("a").alias("x"), (2 * F.col("phi")).alias("own"))
    return (
        kinship.join(selves.select(F.col("x").alias("a"), F.col("own").alias("own_a")), "a")
        .join(selves.select(F.col("x").alias("b"), F.col("own").alias("own_b")), "b")
        .select("a", "b", "phi", (2 * F.col("phi") / F.sqrt(F.col("own_a") * F.col("own_b"))).alias("r"))
    )


def inbreeding_from_kinship(ped: DataFrame, kinship: DataFrame) -> DataFrame:
    """f(j) = phi(father, mother); 0 for founders and unrelated parents."""
    return (
        ped.select("ind", F.col("father").alias("a"), F.col("mother").alias("b"))
        .join(kinship, ["a", "b"], "left")
        .select("ind", F.coalesce("phi", F.lit(0.0)).alias("f"))
    )


# ---------------------------------------------------------------- gene flow

def gene_flow(ped: DataFrame, levels: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(ind, ancestor, share) and (ind, f).

    ``share`` is the expected fraction of the individual's genes that passed
    through the ancestor (1 for itself).  With d the part of an individual's
    variance that its parents do not explain,
    2 phi(a, b) = sum over shared ancestors x of share(a, x) share(b, x) d(x).
    Level by level: shares of the new individuals from their parents' shares,
    then their parents' kinship from the same rows.
    """
    levels, top = _levels(ped, levels)
    spark = ped.sparkSession
    shares, values = Ledger(spark, "gene-flow"), Ledger(spark, "inbreeding")
    first = levels.where("level = 0").select("ind")
    shares.append(first.select("ind", F.col("ind").alias("ancestor"), F.lit(1.0).alias("share")))
    values.append(first.select("ind", F.lit(0.0).alias("f"), F.lit(1.0).alias("d")))
    for level in range(1, top + 1):
        born = levels.where(F.col("level") == level).select("ind", "father", "mother")
        children, parents = _couples(born)
        known = shares.read()
        passed = materialize(
            parents.join(known.withColumnRenamed("ind", "parent").hint("merge"), "parent")
            .groupBy("couple", "ancestor")
            .agg(
                (F.sum("share") * 0.5).alias("share"),
                F.max(F.when(F.col("parent") == F.col("couple.father"), F.col("share"))).alias("by_father"),
                F.max(F.when(F.col("parent") == F.col("couple.mother"), F.col("share"))).alias("by_mother"),
            ),
            "passed-shares",
        )
        shares.append(
            children.join(passed.hint("merge"), "couple")
            .select("ind", "ancestor", "share")
            .unionByName(children.select("ind", F.col("ind").alias("ancestor"), F.lit(1.0).alias("share")))
        )
        earlier = values.read()
        related = (
            passed.where("by_father IS NOT NULL AND by_mother IS NOT NULL")
            .join(earlier.select(F.col("ind").alias("ancestor"), "d").hint("merge"), "ancestor")
            .groupBy("couple")
            .agg((F.sum(F.expr("by_father * by_mother * d")) * 0.5).alias("f"))
        )
        left_out = (
            parents.join(earlier.select(F.col("ind").alias("parent"), F.col("f").alias("fp")).hint("merge"), "parent")
            .groupBy("couple")
            .agg(F.sum((1 + F.col("fp")) * 0.25).alias("explained"))
        )
        values.append(
            children.join(related.hint("merge"), "couple", "left")
            .join(left_out.hint("merge"), "couple", "left")
            .select(
                "ind",
                F.coalesce("f", F.lit(0.0)).alias("f"),
                (1.0 - F.coalesce("explained", F.lit(0.0))).alias("d"),
            )
        )
    return shares.read(), values.read()


def inbreeding(ped: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """(ind, f) for everyone, without forming unrelated or unneeded pairs."""
    _, values = gene_flow(ped, levels)
    return values.select("ind", "f")


def kinship_columns(
    ped: DataFrame, ids: DataFrame, levels: DataFrame | None = None, values: DataFrame | None = None
) -> DataFrame:
    """(a, b, phi): kinship of each listed individual ``a`` with every individual ``b`` it is related to.

    The indirect method: a unit weight on ``a`` is swept up the pedigree, half
    to each parent, which gives a's expected share of every ancestor; weighted
    by the ancestors' within-family variance d it is swept down again, half
    from each parent, and halved.  Each sweep reads a level's rows once, so the
    work is listed individuals x their relatives, not all pairs.  ``values`` is
    (ind, f, d) of ``gene_flow`` where it is known.  Listed names without a row
    in the pedigree, nulls and repeated names give no further rows.
    """
    levels, top = _levels(ped, levels)
    spark = ped.sparkSession
    if values is None:
        values = gene_flow(ped, levels)[1]
    people = materialize(levels.select("ind", "father", "mother", "level"), "people")
    # One row per parent with a row of its own, so a weight has a level to go to.
    links = materialize(
        parent_links(people.withColumnRenamed("level", "line_no"))
        .select("ind", "parent", F.col("line_no").alias("child_level"))
        .join(people.select(F.col("ind").alias("parent"), F.col("level").alias("parent_level")), "parent"),
        "people-links",
    )

    def weights(posted: DataFrame) -> DataFrame:
        return posted.groupBy("a", "ind").agg(F.sum("w").alias("w"))

    fields = "a string, ind string, w double"
    start = people.join(ids.select(F.col(ids.columns[0]).alias("ind")).distinct(), "ind", "left_semi")
    up, down = Mailbox(spark, "columns-up", fields), Mailbox(spark, "columns-down", fields)
    up.post(start.select(F.col("ind").alias("a"), "ind", F.lit(1.0).alias("w"), F.col("level").alias("use")))
    shares = Ledger(spark, "columns-shares")
    for level in range(top, -1, -1):
        here = shares.append(weights(up.take(level)))
        if level:
            own = links.where(F.col("child_level") == level)
            up.post(
                here.join(own, "ind").select("a", F.col("parent").alias("ind"), (F.col("w") * 0.5).alias("w"), F.col("parent_level").alias("use"))
            )
    of_level = people.select("ind", F.col("level").alias("use"))
    down.post(
        shares.read()
        .join(values.select("ind", "d"), "ind")
        .join(of_level, "ind")
        .select("a", "ind", (F.col("w") * F.col("d")).alias("w"), "use")
    )
    result = Ledger(spark, "columns")
    for level in range(top + 1):
        here = result.append(weights(down.take(level)))
        if level < top:
            below = links.select(F.col("parent").alias("ind"), F.col("ind").alias("child"), F.col("child_level").alias("use"))
            down.post(
                here.join(below, "ind").select("a", F.col("child").alias("ind"), (F.col("w") * 0.5).alias("w"), "use")
            )
    return result.read().select("a", F.col("ind").alias("b"), (F.col("w") * 0.5).alias("phi"))


def ancestor_closure(ped: DataFrame, ids: DataFrame) -> DataFrame:
    """The pedigree rows of ``ids`` and of all their ancestors."""
    ledger = Ledger(ped.sparkSession, "closure")
    newest = ledger.append(ids.select("ind").distinct())
    links = parent_links(ped).select("ind", "parent")
    while not newest.isEmpty():
        parents = links.join(newest.hint("merge"), "ind", "left_semi").select(F.col("parent").alias("ind")).distinct()
        newest = ledger.append(parents.join(ledger.read().hint("merge"), "ind", "left_anti"))
    return ped.join(ledger.read().hint("merge"), "ind", "left_semi")


def kinship_of(ped: DataFrame, pairs: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """phi of the listed pairs (a, b) only; 0 for an unrelated pair.

    Only ancestors of the listed individuals take part. Tables of individuals
    and shares, which compress well, meet by merge joins: none is sent to the
    driver because its files are small.
    """
    pairs = materialize(pairs.select("a", "b").distinct(), "pairs")
    members = pairs.select(F.col("a").alias("ind")).union(pairs.select("b"))
    kept = ancestor_closure(ped, members)
    if levels is not None:
        levels = levels.join(kept.select("ind").hint("merge"), "ind", "left_semi")
    shares, values = gene_flow(kept, levels)
    weighted = shares.join(values.select(F.col("ind").alias("ancestor"), "d").hint("merge"), "ancestor")
    of_a = weighted.select(F.col("ind").alias("a"), "ancestor", (F.col("share") * F.col("d")).alias("wa"))
    of_b = shares.select(F.col("ind").alias("b"), "ancestor", F.col("share").alias("wb"))
    phi = (
        pairs.join(of_a.hint("merge"), "a")
        .join(of_b.hint("merge"), ["b", "ancestor"])
        .groupBy("a", "b")
        .agg((F.sum(F.col("wa") * F.col("wb")) * 0.5).alias("phi"))
    )
    return pairs.join(phi.hint("merge"), ["a", "b"], "left").select("a", "b", F.coalesce("phi", F.lit(0.0)).alias("phi"))
