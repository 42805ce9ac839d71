"""Document fingerprints from closed syncmers, in native expressions only.

The alphabet of a text is its units: runs of up to three letters or digits of a
word, and single other signs. A unit depends on its own word alone, so a change
in one place leaves all later units as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.common import let

# The units, k units in an anchor, two units in its inner substrings.
UNIT = r"[\p{L}\p{N}]{1,3}|[^\p{L}\p{N}\s]"
K = 6
_LOWEST = -(1 << 63)


def _inner(text: Column) -> Column:
    """Hash of each inner substring of two units; the last unit stands alone."""
    units = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0))
    return let(units, lambda u: F.transform(u, lambda x, i: F.xxhash64(x, F.get(u, i + 1))))


def _edge(inner: Column, h: Column, i: Column) -> Column:
    """Whether the smallest inner substring of the k-mer at ``i`` is its first or its last."""
    between = F.least(*(F.get(inner, i + j) for j in range(1, K - 2)))
    return (i < F.size(inner) - (K - 1)) & (F.least(h, F.get(inner, i + K - 2)) <= between)


def _hash(inner: Column, h: Column, i: Column) -> Column:
    """32 bits for the units of the k-mer at ``i``."""
    return F.shiftrightunsigned(F.xxhash64(h, *(F.get(inner, i + j) for j in range(2, K, 2))), 32)


def _whole(inner: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.array_join(F.transform(inner, lambda h: h.cast("string")), ",")), 32)


def anchors(text: Column) -> Column:
    """Array of (position, hash) of all closed syncmers of a text in order, positions in units.

    A k-mer is chosen when the smallest of its inner substrings is the first or
    the last. That depends on the k-mer alone, so it is chosen wherever it
    stands, and texts match by position through their common anchors. At least
    one of K - 2 neighbouring k-mers is chosen. A text with fewer than k units
    has one anchor, made of all of them; a null text or one without units has none.
    """

    def chosen(inner: Column) -> Column:
        pick = lambda h, i: F.when(_edge(inner, h, i), F.struct(i.cast("int").alias("position"), _hash(inner, h, i).alias("hash")))
        one = F.array(F.struct(F.lit(0).alias("position"), _whole(inner).alias("hash")))
        picked = F.filter(F.transform(inner, pick), lambda x: x.isNotNull())
        return F.when((F.size(inner) > 0) & (F.size(inner) < K), one).otherwise(picked)

    return let(_inner(text), chosen)


def fingerprint(anchored: Column) -> Column:
    """All anchors as a string: for each the distance from the one before, one digit, and eight hexadecimal digits of its hash.

    So positions can be read back from it; its length grows with the text.
    """

    def shown(own: Column) -> Column:
        apart = lambda x, i: x["position"] - F.when(i > 0, F.get(own, i - 1)["position"]).otherwise(0)
        return F.array_join(F.transform(own, lambda x, i: F.concat(apart(x, i).cast("string"), F.lpad(F.hex(x["hash"]), 8, "0"))), "")

    return let(anchored, shown)


def steps(anchored: Column) -> Column:
    """A number for each pair of neighbouring anchors and their distance; a lone anchor gives its own.

    Texts that share a passage share its steps, in its order, wherever it stands
    in them; anchors that recur elsewhere by themselves, or out of order, match nothing.
    """

    def all_of(own: Column) -> Column:
        def step(x: Column, i: Column) -> Column:
            after = F.get(own, i + 1)
            apart = F.when(after.isNotNull(), F.xxhash64(x["hash"], after["hash"], after["position"] - x["position"]))
            return F.when(F.size(own) == 1, x["hash"]).otherwise(apart)

        return F.array_distinct(F.filter(F.transform(own, step), lambda s: s.isNotNull()))

    return let(anchored, all_of)


def likeness(a: Column, b: Column) -> Column:
    """Share of distinct steps that stand in both texts, of all in either; two texts without any are alike."""
    both, all_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(all_ == 0, 1.0).otherwise(both / all_).cast("double")


def containment(a: Column, b: Column) -> Column:
    """Share of the distinct steps of ``a`` that stand in ``b``: 1 for a passage copied whole, whatever the length of ``b``."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a)).cast("double")


def add_fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``; equal texts have equal ones, a null text has the empty one.

    No shuffle. Repeated rows give equal rows; an empty table gives no rows; a
    column ``fingerprint`` is replaced.
    """
    return docs.withColumn("fingerprint", fingerprint(anchors(F.col(text))))


def fingerprint_edits(docs: DataFrame, buckets_a_partition: int = 4) -> DataFrame:
    """Fingerprints of each text and of its edited text, beside those of the next document.

    The edited text replaces the last third of the code points by as many from
    the start of the next document by falling doc_id (all of it where it is
    shorter); the first document follows the last. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The next document needs one shuffle: ids fall into ranges of about equal
    numbers of rows, and each range also gets a copy of the first row of the
    range after it, so a window over a range sees every next row. Ranges are
    sorted and spill.

    A null text is empty. Null ids come last; rows of one doc_id follow each
    other by falling text. A single row is its own next one. An empty table
    gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(_LOWEST)).alias("k"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) * buckets_a_partition
    bounds = sorted(set(base.stat.approxQuantile("k", [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    at = F.lit(0)
    if bounds:
        at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x > F.col("k")))
    base = base.withColumn("bucket", at)
    heads = dict(base.groupBy("bucket").agg(F.max("k")).collect())  # one row a range
    if not heads:
        heads = {0: 0}
    order = sorted(heads)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    to = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))
    ghosts = base.where(F.col("k").isin(sorted(set(heads.values())))).groupBy("bucket").agg(F.max(F.struct("k", "text", "doc_id")).alias("x"))
    ghosts = ghosts.select("x.doc_id", "x.text", "x.k", F.element_at(to, F.col("bucket")).alias("bucket"), F.lit(True).alias("ghost"))
    both = base.withColumn("ghost", F.lit(False)).unionByName(ghosts)

    in_range = Window.partitionBy("bucket").orderBy("ghost", F.col("k").desc(), F.col("text").desc())
    seen = both.withColumn("next_text", F.lead("text").over(in_range))
    n_chars = F.length("text").cast("long")
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), F.length("text") - third), F.coalesce(F.col("next_text").substr(F.lit(1), third), F.lit("")))
    seen = seen.select("doc_id", "bucket", "ghost", "k", "text", n_chars.alias("n_chars"), edited.alias("edited"))
    made = seen.select(
        "doc_id", "bucket", "ghost", "k", "text", "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        anchors(F.col("text")).alias("own"),
        anchors(F.col("edited")).alias("changed"),
    )
    made = made.withColumns({"own_steps": steps(F.col("own")), "changed_steps": steps(F.col("changed"))})
    made = made.withColumn("next_steps", F.lead("own_steps").over(in_range)).where("NOT ghost")
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own_steps"), F.col("changed_steps")).alias("near_edited"),
        likeness(F.col("own_steps"), F.col("next_steps")).alias("near_next"),
    )
