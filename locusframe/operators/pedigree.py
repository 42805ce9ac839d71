"""Pedigree operators: lookups, validation and generation levels.

A pedigree is (ind, father, mother, pop, line_no); an unknown parent is NULL
and a founder has two of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.operators.ordered import ranked
from locusframe.session import Ledger, materialize

LINE_BUCKET = 65_536


def founders_of(ped: DataFrame) -> DataFrame:
    return ped.where("father IS NULL AND mother IS NULL")


def founder_count(ped: DataFrame) -> DataFrame:
    return ped.agg(
        F.count_if(F.col("father").isNull() & F.col("mother").isNull()).alias("n_founders"),
        F.count(F.lit(1)).alias("n_individuals"),
    )


def parent_links(ped: DataFrame) -> DataFrame:
    """One row per known parent: (ind, role, parent, line_no)."""
    links = F.array(
        F.struct(F.lit("father").alias("role"), F.col("father").alias("parent")),
        F.struct(F.lit("mother").alias("role"), F.col("mother").alias("parent")),
    )
    return (
        ped.select("ind", "line_no", F.explode(links).alias("l"))
        .select("ind", "l.role", "l.parent", "line_no")
        .where("parent IS NOT NULL")
    )


def parent_lookup(ped: DataFrame, columns: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """The pedigree with the named columns of each parent beside it."""

    def side(role: str) -> DataFrame:
        return ped.select(
            F.col("ind").alias(role), *[F.col(c).alias(f"{role}_{c}") for c in columns]
        )

    return ped.join(side("father"), "father", "left").join(side("mother"), "mother", "left").select(
        *ped.columns, *[f"{role}_{c}" for role in ("father", "mother") for c in columns]
    )


def children_counts(ped: DataFrame) -> DataFrame:
    """Children per parent; counted map-side, so a prolific parent is cheap."""
    return parent_links(ped).groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))


def children_lists(ped: DataFrame) -> DataFrame:
    """Adjacency in rows: (parent, child, n_children).

    One row per child rather than one array per parent, so the size of a row
    does not grow with the number of children.
    """
    links = parent_links(ped)
    return links.select("parent", F.col("ind").alias("child"), "role").join(children_counts(ped), "parent")


def children_of_founders(ped: DataFrame) -> DataFrame:
    """Individuals both of whose parents are founders."""
    first = founders_of(ped).select("ind")
    return ped.join(first.withColumnRenamed("ind", "father"), "father", "left_semi").join(
        first.withColumnRenamed("ind", "mother"), "mother", "left_semi"
    )


# --------------------------------------------------------------- validation

def missing_parents(ped: DataFrame) -> DataFrame:
    """Known parents that are not individuals of the pedigree."""
    everyone = ped.select(F.col("ind").alias("parent"))
    return parent_links(ped).join(everyone, "parent", "left_anti").select("ind", "role", "parent", "line_no")


def duplicate_individuals(ped: DataFrame) -> DataFrame:
    """Second and later rows of an individual.

    The first row is found by a map-side aggregate, not by sorting all rows of
    one label in one task.
    """
    first = ped.groupBy("ind").agg(F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n"))
    again = first.where("n > 1").select("ind", "first_line")
    return ped.join(again, "ind").where("line_no > first_line").select("ind", "line_no", "first_line")


def child_is_parent_of_parent(ped: DataFrame) -> DataFrame:
    """Row pairs that are each other's father, or each other's mother."""

    def mutual(role: str) -> DataFrame:
        a = ped.select("ind", F.col(role).alias("parent"), "line_no").where("parent IS NOT NULL")
        b = ped.select(
            F.col("ind").alias("parent"), F.col(role).alias("ind"), F.col("line_no").alias("parent_line")
        ).where("ind IS NOT NULL")
        pairs = a.join(b, ["parent", "ind"]).where("line_no < parent_line")
        return pairs.select("ind", F.lit(role).alias("role"), "parent", "line_no", "parent_line")

    return mutual("father").unionByName(mutual("mother"))


def half_founders(ped: DataFrame) -> DataFrame:
    """Individuals with exactly one known parent."""
    return ped.where("(father IS NULL) <> (mother IS NULL)").select("ind", "line_no")


# -------------------------------------------------------------------- levels

def _settle(ped: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Round r settles the rows whose defined parents are all settled.

    Each round joins the open rows with the newest settled round only and
    writes them once, split into settled and open; the settled parts of all
    rounds read as one table partitioned by level.
    Returns (settled with ``level``, never settled).
    """
    people = ped.groupBy("ind").agg(F.min_by(F.struct("father", "mother"), "line_no").alias("p"))
    people = people.select("ind", "p.father", "p.mother")
    names = people.select(F.col("ind").alias("name"))
    defined = (
        people.join(names.withColumnRenamed("name", "father"), "father", "left_semi")
        .select("ind", F.lit(True).alias("has_f"))
    )
    defined_m = (
        people.join(names.withColumnRenamed("name", "mother"), "mother", "left_semi")
        .select("ind", F.lit(True).alias("has_m"))
    )
    state = (
        people.join(defined, "ind", "left")
        .join(defined_m, "ind", "left")
        .select("ind", "father", "mother", F.col("has_f").isNotNull().alias("wait_f"), F.col("has_m").isNotNull().alias("wait_m"))
    )
    spark = ped.sparkSession
    root = Ledger(spark, f"{label}-levels").root
    columns = "ind string, father string, mother string, wait_f boolean, wait_m boolean, "
    level = 0
    while True:
        path = f"{root}/level={level}"
        state.withColumn("settled", F.expr("NOT wait_f AND NOT wait_m")).write.partitionBy("settled").parquet(path)
        round_ = spark.read.schema(columns + "settled boolean").parquet(path)
        newest, rest = round_.where("settled"), round_.where("NOT settled").drop("settled")
        if rest.isEmpty() or newest.isEmpty():
            done = spark.read.schema(columns + "level int, settled boolean").parquet(root).where("settled")
            return done.select("ind", "father", "mother", "level"), rest
        done_f = newest.select(F.col("ind").alias("father"), F.lit(True).alias("now_f"))
        done_m = newest.select(F.col("ind").alias("mother"), F.lit(True).alias("now_m"))
        state = (
            rest.join(done_f, "father", "left")
            .join(done_m, "mother", "left")
            .select(
                "ind",
                "father",
                "mother",
                (F.col("wait_f") & F.col("now_f").isNull()).alias("wait_f"),
                (F.col("wait_m") & F.col("now_m").isNull()).alias("wait_m"),
            )
        )
        level += 1


def settled_levels(ped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``generation_levels`` without loops, the rows that have no level)."""
    return _settle(ped, "pedigree")


def generation_levels(ped: DataFrame, on_cycle: str = "raise") -> DataFrame:
    """(ind, father, mother, level): founders 0, others 1 + highest parent level.

    A parent without a row of its own counts as a founder outside the table.
    Members and descendants of a loop have no level; they raise an error, or
    with ``on_cycle='drop'`` are left out.
    """
    settled, rest = _settle(ped, "pedigree")
    if on_cycle == "raise" and not rest.isEmpty():
        raise ValueError("the pedigree has an ancestor loop")
    return settled


def ancestor_loops(ped: DataFrame, unsettled: DataFrame | None = None) -> DataFrame:
    """Individuals that are their own ancestor.

    ``unsettled`` is the part of the pedigree that the level rounds left, where
    it is known.  It is trimmed from above and below, generation by generation.
    Then every individual follows one of its remaining parents, picked by hash,
    and the reach of a step doubles each round, so the loops of these steps are
    found in as many rounds as their length has binary digits, and with them a
    loop above every individual.  Steps to one child each, in the same way, tell
    a loop below; one that is both above and below takes the individual in.  A
    found loop becomes one individual (its smallest label) and the rest is done
    again until no link is left.  Every step moves one row per individual or
    parent link.
    """
    if unsettled is None:
        _, unsettled = _settle(ped, "loops")
    found = Ledger(ped.sparkSession, "loop-members")
    links = materialize(
        parent_links(unsettled.withColumn("line_no", F.lit(0))).select("ind", "parent").distinct(), "loop-links"
    )
    found.append(links.where("ind = parent").select("ind"))
    links = _trim(links.where("ind <> parent"))
    turn = 0
    while not links.isEmpty():
        loops = _merged_loops(links, turn)
        found.append(loops.select("ind"))
        links = _trim(
            links.join(loops.withColumnRenamed("loop", "ind_loop"), "ind", "left")
            .join(loops.select(F.col("ind").alias("parent"), F.col("loop").alias("parent_loop")), "parent", "left")
            .select(F.coalesce("ind_loop", "ind").alias("ind"), F.coalesce("parent_loop", "parent").alias("parent"))
            .where("ind <> parent")
            .distinct()
        )
        turn += 1
    return found.read().distinct()


def _inner_links(links: DataFrame) -> DataFrame:
    """Links whose parent still has a parent and whose child still has a child."""
    has_parent = links.select(F.col("ind").alias("parent")).distinct()
    has_child = links.select(F.col("parent").alias("ind")).distinct()
    return links.join(has_parent, "parent", "left_semi").join(has_child, "ind", "left_semi").select("ind", "parent")


def _trim(links: DataFrame) -> DataFrame:
    links = materialize(links, "loop-links")
    size = links.count()
    while size:
        links = materialize(_inner_links(links), "loop-links")
        left = links.count()
        if left == size:
            break
        size = left
    return links


def _merged_loops(links: DataFrame, turn: int) -> DataFrame:
    """(ind, loop): members of the loops of one step up each, and those between a loop and itself."""
    up = _follow(links.groupBy("ind").agg(F.min_by("parent", F.xxhash64("ind", "parent", F.lit(turn))).alias("next")))
    loops, rest = up.where("on_loop").select("ind", "loop"), up.where("NOT on_loop")
    if rest.isEmpty():
        return loops
    child = links.select(F.col("parent").alias("ind"), F.col("ind").alias("child"))
    down = _follow(
        child.join(loops, "ind", "left_anti")
        .groupBy("ind")
        .agg(F.min_by("child", F.xxhash64("ind", "child", F.lit(turn))).alias("next"))
        .unionByName(loops.select("ind", F.col("ind").alias("next")))
    )
    # A step down ends at a loop's member, which stays where it is.
    below = down.join(loops.select(F.col("ind").alias("end"), F.col("loop").alias("below")), F.col("loop") == F.col("end"))
    between = rest.join(below.select("ind", "below"), "ind").where("loop = below").select("ind", "loop")
    return materialize(loops.unionByName(between), "loops")


def _follow(step: DataFrame) -> DataFrame:
    """(ind, loop, on_loop): the loop to which single steps (ind, next) lead, by its smallest label.

    After k rounds ``next`` is 2^k steps away and ``low`` the smallest label of
    the steps up to it, its own included.  When neither the set reached nor any
    ``low`` changes in a round, that set is the loops and each ``low`` in it the
    smallest of its loop.
    """
    ways = materialize(step.select("ind", "next", F.least("ind", "next").alias("low")), "loop-ways")
    reached = ways.agg(F.count_distinct("next")).first()[0]
    while True:
        ahead = ways.select(F.col("ind").alias("next"), F.col("next").alias("next2"), F.col("low").alias("low2"))
        ways = materialize(
            ways.join(ahead, "next").select(
                "ind", F.col("next2").alias("next"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved")
            ),
            "loop-ways",
        )
        now, moved = ways.agg(F.count_distinct("next"), F.bool_or("moved")).first()
        if now == reached and not moved:
            break
        reached = now
    ends = ways.select(F.col("next").alias("end")).distinct()
    lows = ends.join(ways.select(F.col("ind").alias("end"), F.col("low").alias("loop")), "end")
    members = ends.select(F.col("end").alias("ind"), F.lit(True).alias("on_loop"))
    return materialize(
        ways.select("ind", F.col("next").alias("end"))
        .join(lows, "end")
        .join(members, "ind", "left")
        .select("ind", "loop", F.col("on_loop").isNotNull().alias("on_loop")),
        "loop-ends",
    )


ERROR_COLUMNS = ("error", "ind", "line_no", "detail")


def validate_pedigree(
    ped: DataFrame, format_errors: DataFrame | None = None, unsettled: DataFrame | None = None
) -> DataFrame:
    """Every problem of the pedigree as one table, instead of only the first."""

    def report(df: DataFrame, error: str, detail) -> DataFrame:
        line = F.col("line_no") if "line_no" in df.columns else F.lit(None)
        return df.select(
            F.lit(error).alias("error"), "ind", line.cast("bigint").alias("line_no"), detail.cast("string").alias("detail")
        )

    checks = [
        report(missing_parents(ped), "missing_parent", F.concat_ws(" ", "role", "parent")),
        report(duplicate_individuals(ped), "duplicate_individual", F.col("first_line")),
        report(child_is_parent_of_parent(ped), "child_is_parent_of_parent", F.concat_ws(" ", "role", "parent")),
        report(half_founders(ped), "half_founder", F.lit(None)),
        report(ancestor_loops(ped, unsettled), "ancestor_loop", F.lit(None)),
    ]
    if format_errors is not None:
        checks.append(
            format_errors.select(
                F.lit("format").alias("error"),
                F.lit(None).cast("string").alias("ind"),
                "line_no",
                F.concat(F.lit("columns "), F.col("n_columns")).alias("detail"),
            )
        )
    out = checks[0]
    for check in checks[1:]:
        out = out.unionByName(check)
    return out


def index_individuals(ped: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """1-based numbers, founders first and parents before children.

    Numbered inside (level, line range) buckets of at most 65,536 lines each;
    only the bucket counts meet in one place.
    """
    levels = generation_levels(ped) if levels is None else levels
    numbered = ped.join(levels.select("ind", "level"), "ind")
    bucket = F.struct("level", F.floor(F.col("line_no") / LINE_BUCKET).alias("range"))
    return (
        ranked(numbered.withColumn("bucket", bucket), [], "bucket", ["line_no"])
        .withColumn("idx", F.col("rank") + 1)
        .select("idx", "ind", "father", "mother", "level")
    )


def relationship_listing(ped: DataFrame) -> DataFrame:
    """Index of every individual beside the indexes of its parents (0: unknown)."""
    listed = materialize(index_individuals(ped), "indexed")
    side = lambda role: listed.select(F.col("ind").alias(role), F.col("idx").alias(f"{role}_idx"))
    return (
        listed.join(side("father"), "father", "left")
        .join(side("mother"), "mother", "left")
        .select(
            "idx",
            "ind",
            F.coalesce("father_idx", F.lit(0)).alias("father_idx"),
            F.coalesce("mother_idx", F.lit(0)).alias("mother_idx"),
        )
    )


def pedigree_statistics(ped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(generation, pop) -> males, females, total; generation -> migrants.

    Generations count back from the youngest.  Sex comes from the parental
    role and is unknown for those who are never a parent.  A migrant has a
    parent from another population.
    """
    levels = generation_levels(ped)
    top = levels.agg(F.max("level")).scalar()
    roles = (
        parent_links(ped)
        .groupBy(F.col("parent").alias("ind"))
        .agg(F.bool_or(F.col("role") == "father").alias("sires"), F.bool_or(F.col("role") == "mother").alias("dams"))
    )
    placed = (
        parent_lookup(ped, ("pop",))
        .join(levels.select("ind", (top - F.col("level")).alias("generation")), "ind")
        .join(roles, "ind", "left")
    )
    migrant = F.coalesce(F.col("father_pop") != F.col("pop"), F.lit(False)) | F.coalesce(
        F.col("mother_pop") != F.col("pop"), F.lit(False)
    )
    by_pop = placed.groupBy("generation", "pop").agg(
        F.count_if(F.coalesce("sires", F.lit(False))).alias("n_males"),
        F.count_if(F.coalesce("dams", F.lit(False))).alias("n_females"),
        F.count(F.lit(1)).alias("n_total"),
    )
    migrants = placed.groupBy("generation").agg(F.count_if(migrant).alias("n_migrants"))
    return by_pop, migrants
