import math
import random

import pytest

from locusframe.operators import genotypes as G
from locusframe.schemas import GENOTYPES
from locusframe.sources.genotypes import read_genotypes
from helpers import near, rows

# A small genotype file and its published summaries.
SMALL = """i0 p0 l0 a b
i0 p0 l1 d c
i0 p0 l2 e f
i0 p0 l3 h g
i1 p0 l0 a a
i1 p0 l1 c c
i1 p0 l2 e e
i1 p0 l3 h h
i2 p1 l0 a b
i2 p1 l1 c d
i2 p1 l2 e e
i2 p1 l3 g g
i3 p1 l0 a a
i3 p1 l1 d c
i3 p1 l2 0 0
i3 p1 l3 h h
i4 p1 l0 c c
i4 p1 l1 e e
i4 p1 l2 f f
i4 p1 l3 i j
""".replace(" ", "\t")


@pytest.fixture
def small(spark, text_file):
    good, bad = read_genotypes(spark, text_file("small.inp", SMALL))
    assert bad.count() == 0
    return good


def test_lists_and_totals(small):
    assert rows(G.population_list(small)) == [("p0",), ("p1",)]
    assert rows(G.individual_list(small)) == [("p0", "i0"), ("p0", "i1"), ("p1", "i2"), ("p1", "i3"), ("p1", "i4")]
    assert rows(G.dataset_summary(small), "pop", "n_ind", "n_loci", "n_pop", "tot_ind") == [
        ("p0", 2, 4, 2, 5),
        ("p1", 3, 4, 2, 5),
    ]


def test_locus_summary(small):
    got = {r.locus: (r.n_alleles, r.has_missing, r.alleles) for r in G.locus_summary(small).collect()}
    assert got == {
        "l0": (3, False, ["a", "b", "c"]),
        "l1": (3, False, ["c", "d", "e"]),
        "l2": (2, True, ["0", "e", "f"]),
        "l3": (4, False, ["g", "h", "i", "j"]),
    }


def test_locus_without_alleles(spark):
    geno = spark.createDataFrame([("p", "i", "l", "0", "?"), ("p", "j", "m", "a", "0")], GENOTYPES)
    got = {r.locus: (r.n_alleles, r.alleles) for r in G.locus_summary(geno).collect()}
    assert got == {"l": (0, []), "m": (1, ["0", "a"])}
    assert rows(G.drop_empty_loci(geno), "locus") == [("m",)]


def test_heterozygosity_golden(small):
    by_ind = {r.ind: (round(r.het, 3), round(r.half_width, 3)) for r in G.heterozygosity(small, "ind").collect()}
    assert by_ind == {"i0": (1.0, 0.0), "i1": (0.0, 0.0), "i2": (0.5, 0.49), "i3": (0.333, 0.533), "i4": (0.25, 0.424)}
    by_locus = {(r.pop, r.locus): (round(r.het, 3), round(r.half_width, 3)) for r in G.heterozygosity(small, "locus").collect()}
    assert by_locus == {
        ("p0", "l0"): (0.5, 0.693), ("p0", "l1"): (0.5, 0.693), ("p0", "l2"): (0.5, 0.693), ("p0", "l3"): (0.5, 0.693),
        ("p1", "l0"): (0.333, 0.533), ("p1", "l1"): (0.667, 0.533), ("p1", "l2"): (0.0, 0.0), ("p1", "l3"): (0.333, 0.533),
    }


def test_untyped_cells_are_null(spark):
    geno = spark.createDataFrame(
        [("p", "i", "l", "a", "0"), ("p", "i", "m", "a", "b"), ("q", "i", "m", "a", "a")], GENOTYPES
    )
    got = {(r.pop, r.locus): (r.n_typed, r.het) for r in G.heterozygosity(geno, "locus").collect()}
    assert got == {("p", "l"): (0, None), ("p", "m"): (1, 1.0), ("q", "l"): (0, None), ("q", "m"): (1, 0.0)}


def test_duplicates(spark, text_file):
    good, _ = read_genotypes(spark, text_file("dup.inp", SMALL + "i3\tp1\tl3\th\th"))
    assert rows(G.duplicate_genotypes(good)) == [("p1", "i3", "l3", 2)]


def test_small_hwe_is_all_null(small):
    got = G.hwe_disequilibrium(small).collect()
    assert len(got) == 8 and all(r.d is None and r.significant is None for r in got)


def _hwe_by_hand(data):
    pops = sorted({r[0] for r in data})
    loci = sorted({r[2] for r in data})
    out = {}
    for pop in pops:
        inds = sorted({r[1] for r in data if r[0] == pop})
        for locus in loci:
            cell = {r[1]: (r[3], r[4]) for r in data if r[0] == pop and r[2] == locus}
            miss = lambda a: a in ("0", "?", ".")
            target = cell.get(inds[0], ("0", "0"))[0]
            typed = [g for g in cell.values() if not miss(g[0]) and not miss(g[1])]
            n = len(typed)
            n11 = 0 if miss(target) else sum(g == (target, target) for g in typed)
            n12 = 0 if miss(target) else sum((g[0] == target) != (g[1] == target) for g in typed)
            if n == 0 or n11 < 5 or n - n11 < 5:
                out[pop, locus] = None
                continue
            p = (2 * n11 + n12) / (2 * n)
            d = n11 / n - p * p
            half = 1.96 * math.sqrt(p * p * (1 - p) ** 2 / n)
            out[pop, locus] = (d, half, d - half >= 0 if d >= 0 else d + half <= 0)
    return out


def test_hwe_against_direct_count(spark):
    rng = random.Random(5)
    data = []
    for pop in ("x", "y", "z"):
        for i in range(60):
            for locus in ("a", "b", "c", "d"):
                if rng.random() < 0.05:
                    continue
                if locus == "d" and pop == "y" and i == 0:
                    continue
                alleles = rng.choices(["1", "2", "3", "0"], [6, 3, 1, 0.4], k=2)
                if locus == "c":
                    alleles[1] = alleles[0]
                data.append((pop, f"i{i:03d}", locus, *alleles))
    got = {(r.pop, r.locus): r for r in G.hwe_disequilibrium(spark.createDataFrame(data, GENOTYPES).repartition(7)).collect()}
    want = _hwe_by_hand(data)
    assert got.keys() == want.keys()
    assert any(w is not None and w[2] for w in want.values())
    for key, w in want.items():
        r = got[key]
        if w is None:
            assert r.d is None
        else:
            assert near(r.d, w[0]) and near(r.half_width, w[1]) and r.significant == w[2]


def test_tables_are_dealt_by_their_rows(spark, tmp_path, monkeypatch):
    from locusframe import adapters as A

    monkeypatch.setattr(A, "TASK_ROWS", 100)
    monkeypatch.setattr(A.dealt, "__kwdefaults__", {"size": 100})
    spark.range(1000).selectExpr("id as l_orderkey", "1 as l_linenumber", "id as l_partkey", "id as l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1000).selectExpr("id as o_orderkey", "'p' as o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    plan = A.genotypes(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and ", 10)" in plan
    assert A.genotypes(spark, str(tmp_path)).count() == 1000
