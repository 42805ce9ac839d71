import random

import pytest
from pyspark.sql import functions as F

from locusframe.functions import scalars as S
from locusframe.functions.patterns import required_literal
from locusframe.operators import markers as M
from locusframe.plans.sampling import VariantSet, sample_vcf, sample_vcfs_shared
from locusframe.schemas import CONTIGS, POP_MAP, SAMPLES, VARIANTS
from helpers import rows


def variants(spark, items, file_id="a", n=3):
    data = [
        (file_id, c, p, ".", "A", "G", ".", "PASS", "AGE=1.50", "GT", [f"{(p + i) % 2}|{i % 2}" for i in range(n)])
        for c, p in items
    ]
    return spark.createDataFrame(data, VARIANTS)


@pytest.fixture
def three_chroms(spark):
    return variants(spark, [(f"chr{c}", p) for c in (1, 2, 3) for p in range(1, 11)])


@pytest.fixture
def samples(spark):
    return spark.createDataFrame([("a", i, f"s{i}") for i in range(3)], SAMPLES)


@pytest.mark.parametrize(
    "text,count", [("chr1", 10), ("chr1:5", 6), ("chr1:5-9", 5), ("chr1:5-0", 6), ("chr9", 0), (None, 30)]
)
def test_region(three_chroms, text, count):
    assert M.filter_region(three_chroms, text).count() == count


def uniform_by_hand(m, k):
    if k >= m:
        return set(range(m))
    if k == 1:
        return {0}
    step = (m - 1) / (k - 1)
    return {min(int(i * step + 0.5), m - 1) for i in range(k)}


@pytest.mark.parametrize("k", [1, 2, 3, 7, 9, 10, 15])
def test_uniform(three_chroms, k):
    want = sorted((f"chr{c}", i + 1) for c in (1, 2, 3) for i in uniform_by_hand(10, k))
    assert rows(M.thin_uniform(three_chroms, k)) == sorted(want, key=repr)


@pytest.mark.parametrize("k", [2, 5, 40])
def test_uniform_counts_records(spark, k):
    positions = sorted([p * 9_973 for p in range(1, 60)] + [9_973 * 7] * 20 + [9_973 * 30] * 3)
    got = M.thin_uniform(variants(spark, [("c", p) for p in positions]), k, count_records=True)
    want = {("c", positions[i]) for i in uniform_by_hand(len(positions), k)}
    assert set(rows(got)) == want


def test_random_does_not_depend_on_partitions(three_chroms):
    picks = [
        rows(M.thin_random(three_chroms.repartition(n), 4, seed=11)) for n in (1, 4, 32)
    ]
    assert picks[0] == picks[1] == picks[2]
    assert len(picks[0]) == 12
    assert rows(M.thin_random(three_chroms, 4, seed=12)) != picks[0]
    assert M.thin_random(three_chroms, 99, seed=1).count() == 30


def test_shared_markers(spark):
    files = [
        variants(spark, [("c", p) for p in ps], name)
        for name, ps in (("a", [1, 2, 3, 4, 5, 5]), ("b", [2, 3, 4, 5, 6]), ("c", [2, 3, 4, 5, 9, 9, 9]))
    ]
    merged = files[0].union(files[1]).union(files[2])
    assert rows(M.shared_markers(merged, 3)) == [("c", p) for p in (2, 3, 4, 5)]


def test_select_samples_keeps_file_order(spark, three_chroms, samples):
    ids = spark.createDataFrame([("s2",), ("s0",), ("nobody",), ("s2",)], "sample_id string")
    kept, names = M.select_samples(three_chroms, samples, ids)
    assert rows(names, "sample_idx", "sample_id") == [(0, "s0"), (1, "s2")]
    got = kept.where("chrom = 'chr1' AND pos = 1").first()
    assert got.gts == ["1|0", "1|0"]
    nobody, names = M.select_samples(three_chroms, samples, ids.where("sample_id = 'nobody'"))
    assert names.count() == 0 and nobody.count() == 30 and nobody.first().gts == []


def test_sample_vcf_passes_every_record_at_a_position(spark, samples):
    v = variants(spark, [("c", 1), ("c", 5), ("c", 5), ("c", 9), ("d", 3)])
    contigs = spark.createDataFrame([("a", "c", 10), ("a", "d", 10), ("a", "e", 10)], CONTIGS)
    out = sample_vcf(VariantSet(v, samples, contigs), k=3, region="c")
    assert rows(out.variants, "chrom", "pos") == [("c", 1), ("c", 5), ("c", 5), ("c", 9)]
    assert rows(out.contigs, "chrom") == [("c",)]


def test_shared_sampling_needs_a_shared_marker(spark, samples):
    both = variants(spark, [("c", 1)]).union(variants(spark, [("c", 2)], "b"))
    with pytest.raises(ValueError):
        sample_vcfs_shared(VariantSet(both, samples), n_files=2, k=1)


def test_site_filters(spark):
    v = variants(spark, [("c", 1), ("c", 2), ("c", 3)])
    v = v.withColumn(
        "gts", F.when(F.col("pos") == 1, F.array(F.lit("1|1"), F.lit("1|1"))).when(F.col("pos") == 2, F.array(F.lit("0|1"), F.lit("0|0"))).otherwise(F.array(F.lit("0|0"), F.lit(".|0")))
    )
    assert rows(M.segregating(v), "pos") == [(2,), (3,)]
    assert rows(M.polymorphic(v), "pos") == [(1,), (2,)]
    got = M.mutation_list(v).where("pos = 2").first()
    assert (got.age, got.carriers, got.first_carrier) == (1.5, [1], 2)


def test_vcf_to_genotypes(spark, samples):
    v = variants(spark, [("c", 7)]).withColumn("alt", F.lit("G,T")).withColumn(
        "gts", F.array(F.lit("0|2"), F.lit("./1:9"), F.lit("1"))
    )
    assert rows(M.vcf_to_genotypes(v, samples)) == [
        ("proxypop", "s0", "c-7", "A", "T"),
        ("proxypop", "s1", "c-7", "0", "G"),
        ("proxypop", "s2", "c-7", "G", "0"),
    ]


def test_relabel_repeats_and_drops(spark):
    geno = spark.createDataFrame(
        [("p", "9_1", "l", "a", "b"), ("p", "9_22", "l", "a", "a"), ("p", "x", "l", "a", "a")],
        "pop string, ind string, locus string, allele1 string, allele2 string",
    )
    pops = spark.createDataFrame([(1, "^9[0-9_]+", "north"), (2, "22", "south")], POP_MAP)
    assert rows(M.relabel_population(geno, pops), "map_line", "pop", "ind") == [
        (1, "north", "9_1"), (1, "north", "9_22"), (2, "south", "9_22"),
    ]


TRICKY = [
    "^i1[0-9]*\\s", "i2+x?", "(i3|i4)", "i5|zz", "p\\.q", "a{2}", "ab*c", "[ab]c$", "(?i)P", ".", "x\\t", "i1\\x31", "(ab)?q", "nothing here",
    "a+?b", "ab?", "[^p]q", "l7\\b", None,
]


@pytest.mark.parametrize("part", [100_000, 4])
def test_relabel_against_every_pattern(spark, monkeypatch, part):
    monkeypatch.setattr(M, "MAP_PART", part)
    rng = random.Random(3)
    inds = ["i1", "i11", "i2x", "i3", "i5", "zz", "p.q", "pxq", "aab", "abbc", "ac", "bc", "", "x"]
    data = [
        (rng.choice(["p", "q", "ab", None]), rng.choice(inds), rng.choice(["l7", "l", "aa"]), rng.choice("abx"), rng.choice("bc"))
        for _ in range(200)
    ]
    geno = spark.createDataFrame(data, "pop string, ind string, locus string, allele1 string, allele2 string")
    pops = spark.createDataFrame([(i, p, f"new{i}") for i, p in enumerate(TRICKY)], "line_no bigint, pattern string, pop string")
    line = F.concat_ws("\t", "ind", geno["pop"], "locus", "allele1", "allele2")
    want = geno.withColumn("line", line).drop("pop").crossJoin(pops).where("line rlike pattern")
    columns = ["map_line", "pop", "ind", "locus", "allele1", "allele2"]
    got = M.relabel_population(geno, pops)
    assert rows(got, *columns) == rows(want.withColumnRenamed("line_no", "map_line"), *columns)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert M.relabel_population(geno, pops.limit(0)).count() == 0


def test_required_literals():
    wanted = {
        "^i12[0-9]*\\s": "i12", "ab+cde": "cde", "a|b": None, "(x)abc": "abc", "abc?": "ab", "p\\.q": "p.q", "(?i)a": None,
        "a{0,2}bc": "bc", "\\Qa\\E": None, "[a[b]]c": None, ".*": None, "x(y": "x",
    }
    assert {p: required_literal(p) for p in wanted} == wanted


def test_union_relabelled(spark):
    out = M.union_relabelled([(1, variants(spark, [("chr1", 4)])), (7, variants(spark, [("chr1", 5)]))])
    assert rows(out, "chrom", "pos") == [("chr1", 4), ("chr7", 5)]


def test_scalars(spark):
    df = spark.createDataFrame([("chr12",), ("7",), ("chrX",), ("3p",)], "c string")
    assert [r[0] for r in df.select(S.chrom_id(F.col("c"))).collect()] == [12, 7, 0, 3]
    x = spark.createDataFrame([(0.0,), (0.5,), (0.9999,), (1.0,)], "x double")
    got = x.select(
        S.frac_to_bp(F.col("x"), F.lit(10)), S.frac_to_vcf_pos(F.col("x"), F.lit(10)),
        S.to_units(F.col("x"), F.lit(2500), "kb"), S.frac_to_site(F.col("x"), F.lit(10)),
    ).collect()
    assert [tuple(r) for r in got] == [(0, 1, 0, -1), (5, 6, 2, 4), (9, 10, 3, 9), (10, 10, 3, 9)]
    frac = spark.range(1).select(S.bp_to_frac(F.lit(5), F.lit(None)), S.bp_to_frac(F.lit(5), F.lit(0)), S.bp_to_frac(F.lit(5), F.lit(20)))
    assert tuple(frac.first()) == (5e-7, 5e-7, 0.25)


def test_haplotype_tests_stop_early_and_keep_the_odd_calls(spark):
    calls = [["0", "1"], ["1", "1"], ["0|0:1", "./."], ["1|0:9", "."], [":"], ["|"], ["2/1"], ["1", None], [], ["0", None]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(calls)], "i int, gts array<string>")
    assert [i for (i,) in rows(M.segregating(df), "i")] == [0, 2, 3, 4, 5]
    assert [i for (i,) in rows(M.polymorphic(df), "i")] == [0, 1, 3, 6]
    # The symbols of all calls are no longer put into one array first.
    assert "flatten" not in M.segregating(df)._jdf.queryExecution().optimizedPlan().toString()
