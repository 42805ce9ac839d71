import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.operators import intervals as I
from locusframe.operators import ordered as O
from locusframe.operators import segments as G
from locusframe.schemas import MRCA_INTERVALS, SEGMENTS, TARGET_REGIONS
from helpers import near, rows


@pytest.fixture
def small_buckets(spark, monkeypatch):
    """Cut even tiny groups into many ranges and chunks."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    monkeypatch.setattr(I, "CHUNK_LEVEL", 2)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_bucketed_windows_equal_plain_windows(spark):
    rng = random.Random(1)
    data = [(rng.choice("hhhhab"), rng.random(), rng.choice([None, 1, 2, 3]), i) for i in range(300)]
    df = spark.createDataFrame(data, "g string, x double, v int, id int").repartition(5)
    cut = df.withColumn("bucket", F.floor(F.col("x") * 20))
    assert cut.where("g = 'h'").select("bucket").distinct().count() > 5
    w = Window.partitionBy("g").orderBy("x")
    plain = df.select(
        "id", (F.row_number().over(w) - 1).alias("rank"), F.lag("id").over(w).alias("before"),
        F.lead("id").over(w).alias("after"), F.sum(F.coalesce("v", F.lit(0))).over(w).alias("total"),
        F.last("v", ignorenulls=True).over(w).alias("seen"),
    )
    cut = cut.withColumn("n", F.coalesce("v", F.lit(0)))
    ours = (
        O.ranked(cut, ["g"], "bucket", ["x"]).select("id", "rank")
        .join(O.with_neighbour(cut, ["g"], "bucket", ["x"], ["id"], "p").select("id", F.col("p.id").alias("before")), "id")
        .join(O.with_neighbour(cut, ["g"], "bucket", ["x"], ["id"], "p", ahead=True).select("id", F.col("p.id").alias("after")), "id")
        .join(O.with_running_sum(cut, ["g"], "bucket", ["x"], "n", "total").select("id", "total"), "id")
        .join(O.with_running_last(cut, ["g"], "bucket", ["x"], {"v": "seen"}).select("id", "seen"), "id")
    )
    assert rows(ours) == rows(plain)


def spans(spark, items):
    return spark.createDataFrame(items, "g string, start double, end double, origin int")


def test_merge_and_clip_cases(spark):
    four = spans(spark, [("a", 0.0, 0.25, 3), ("a", 0.25, 0.5, 3), ("a", 0.5, 0.75, 4), ("a", 0.75, 1.0, 4)])
    assert rows(I.merge_adjacent(four, ["g"], ["origin"]), "start", "end", "origin") == [(0.0, 0.5, 3), (0.5, 1.0, 4)]
    three = spans(spark, [("a", 0.0, 0.3, 0), ("a", 0.3, 0.7, 1), ("a", 0.7, 1.0, 2)])
    assert rows(I.clip(three, 0.2, 0.8), "start", "end", "origin") == [(0.2, 0.3, 0), (0.3, 0.7, 1), (0.7, 0.8, 2)]
    gap = spans(spark, [("a", 0.0, 0.2, 1), ("a", 0.4, 0.6, 1)])
    assert rows(I.merge_adjacent(gap, ["g"], ["origin"]), "start", "end") == [(0.0, 0.6)]
    assert I.merge_adjacent(gap, ["g"], ["origin"], require_touching=True).count() == 2


def test_merge_over_buckets(spark, small_buckets):
    rng = random.Random(2)
    cuts = sorted(rng.random() for _ in range(80))
    items = [("a", lo, hi, rng.choice([1, 1, 2])) for lo, hi in zip(cuts, cuts[1:])]
    want = []
    for _, lo, hi, o in items:
        if want and want[-1][2] == o:
            want[-1] = (want[-1][0], hi, o)
        else:
            want.append((lo, hi, o))
    assert rows(I.merge_adjacent(spans(spark, items), ["g"], ["origin"]), "start", "end", "origin") == sorted(want, key=repr)


def painted(items, keep):
    """(start, end, priority) runs by testing every elementary interval."""
    points = sorted({p for _, lo, hi, _ in items for p in (lo, hi)})
    out = []
    for lo, hi in zip(points, points[1:]):
        over = [o for _, a, b, o in items if a <= lo and b >= hi]
        if not over:
            continue
        top = min(over) if keep == "first" else max(over)
        if out and out[-1][2] == top and out[-1][1] == lo:
            out[-1] = (out[-1][0], hi, top)
        else:
            out.append((lo, hi, top))
    return out


@pytest.mark.parametrize("keep", ["first", "last"])
def test_overlay_against_direct_painting(spark, small_buckets, keep):
    rng = random.Random(4)
    items = []
    for g in ("hot", "cold"):
        for n in range(90 if g == "hot" else 7):
            lo = rng.randrange(0, 400)
            items.append((g, lo / 500, (lo + rng.choice([1, 3, 20, 90])) / 500, n))
    df = spans(spark, items).withColumn("tag", F.col("origin") * 2)
    got = I.overlay(df, ["g"], "origin", ["tag"], keep)
    for g in ("hot", "cold"):
        want = painted([x for x in items if x[0] == g], keep)
        assert rows(got.where(F.col("g") == g), "start", "end", "origin") == sorted(want, key=repr)
    assert got.where("tag <> origin * 2").count() == 0


def test_overlay_head_case(spark):
    """A later interval that spans an earlier one keeps both of its free sides."""
    data = [("r", 1, 0.2, 0.4, 5.0), ("r", 2, 0.1, 0.6, 9.0)]
    laid = I.mrca_overlay(spark.createDataFrame(data, MRCA_INTERVALS))
    assert rows(laid, "lower", "upper", "age") == [(0.1, 0.2, 9.0), (0.2, 0.4, 5.0), (0.4, 0.6, 9.0)]


def test_elementary(spark, small_buckets):
    items = [("a", i / 40, (i + 3) / 40, 0) for i in range(30)]
    points = sorted({p for _, lo, hi, _ in items for p in (lo, hi)})
    assert rows(I.elementary_intervals(spans(spark, items), ["g"]), "start", "end") == list(zip(points, points[1:]))


@pytest.mark.parametrize("bins", [1, 7, 1024])
def test_regions_against_direct_test(spark, bins):
    rng = random.Random(bins)
    regions = [(i, lo, lo + rng.choice([0.0, 0.01, 0.2])) for i, lo in enumerate(rng.random() for _ in range(6))]
    regions.append((99, 0.95, 1.3))
    r = spark.createDataFrame(regions, TARGET_REGIONS)
    points = [x / 200 for x in range(-5, 230)] + [p for _, lo, hi in regions for p in (lo, hi)]
    df = spark.createDataFrame([(p,) for p in points], "frac double")
    want = sorted((p,) for p in points if any(lo <= p <= hi for _, lo, hi in regions))
    assert sorted(rows(I.in_target_regions(df, r, bins=bins))) == want
    parts = [(f"g{i % 20}", lo, lo + w) for i, (lo, w) in enumerate((rng.random(), rng.choice([0.001, 0.05])) for _ in range(80))]
    s = spark.createDataFrame(parts, "g string, start double, end double")
    hit = [x for x in parts if any(x[1] < hi and x[2] > lo for _, lo, hi in regions)]
    assert rows(I.overlaps_targets(s, r, bins=bins)) == sorted(hit, key=repr)
    groups = {x[0] for x in hit}
    assert rows(I.groups_overlapping(s, r, ["g"])) == sorted((x for x in parts if x[0] in groups), key=repr)
    assert I.in_target_regions(df, r.limit(0)).count() == len(points)


def test_mrca_summary(spark, small_buckets):
    data = [("r", i, i / 10, (i + 1) / 10, age) for i, age in enumerate([5.0, 7.0, 5.0 + 1e-10, 9.0, 7.0, 30.0])]
    by_age = I.mrca_by_age(spark.createDataFrame(data, MRCA_INTERVALS))
    got = {r.age: (round(r.length, 9), r.num_ints) for r in by_age.collect()}
    assert got == {5.0: (0.2, 2), 7.0: (0.2, 2), 9.0: (0.1, 1), 30.0: (0.1, 1)}
    s = I.mrca_summary(by_age).first()
    assert (s.youngest_tmrca, s.n_mrcas) == (5.0, 4) and near(s.avg_tmrca, 51 / 4)
    assert near(s.largest_mrca, 0.2) and near(s.smallest_mrca, 0.1) and near(s.weighted_tmrca, 6.3 / 0.6)


def seg(spark, items):
    return spark.createDataFrame(items, SEGMENTS)


def test_shared_descent_cases(spark):
    whole = lambda ind, pat, mat: [(ind, 1, 0, 1, 0.0, 1.0, *pat), (ind, 1, 1, 1, 0.0, 1.0, *mat)]
    s = seg(
        spark,
        whole("s1", ("F", 0), ("M", 1)) + whole("s2", ("F", 0), ("M", 0)) + whole("in", ("F", 0), ("F", 0))
        + [("half", 1, 0, 1, 0.0, 0.3, "F", 0), ("half", 1, 0, 2, 0.3, 1.0, "M", 1), ("half", 1, 1, 1, 0.5, 1.0, "F", 0)],
    )
    pairs = [("s1", "s2"), ("s1", "s1"), ("in", "in"), ("in", "s1"), ("half", "s1"), ("s2", "nobody")]
    got = dict(((a, b), p) for a, b, p in rows(G.realized_kinship(s, spark.createDataFrame(pairs, "a string, b string"))))
    want = [0.25, 0.5, 1.0, 0.5, (0.3 + 0.7 + 0.5) / 4, 0.0]
    assert all(near(got[p], w) for p, w in zip(pairs, want))


def test_regions_in_base_pairs_with_a_dense_cluster(spark):
    """100,000 regions of 3 bases within 400,000 bases, and one long region far away."""
    regions = spark.range(100_000).selectExpr("cast(5000000 + id * 4 as double) AS start", "cast(5000002 + id * 4 as double) AS end")
    regions = regions.unionByName(spark.createDataFrame([(10.0, 900.0)], "start double, end double"))
    points = spark.range(4_000).selectExpr("cast(4999000 + id * 103 as double) AS frac").unionByName(
        spark.createDataFrame([(10.0,), (900.0,), (901.0,), (None,), (float("nan"),)], "frac double")
    )
    got = {r.frac for r in I.in_target_regions(points, regions).collect()}
    want = {p for p in (4999000.0 + i * 103 for i in range(4_000)) if 5e6 <= p < 5.4e6 and (p - 5e6) % 4 <= 2}
    assert got == want | {10.0, 900.0}
    cuts = I._region_cuts(regions, I.TARGET_BINS)
    sizes = [r["count"] for r in I._binned(regions, "start", cuts, "bin").groupBy("bin").count().collect()]
    assert len(sizes) > I.TARGET_BINS / 2 and max(sizes) < 8 * 100_000 / I.TARGET_BINS
