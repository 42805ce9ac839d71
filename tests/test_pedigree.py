import random
from functools import lru_cache

import pytest

from locusframe.operators import kinship as K
from locusframe.operators import pedigree as P
from locusframe.plans.kinship import PedigreeError, kinship_report
from locusframe.schemas import PEDIGREE
from helpers import near, rows


def make(spark, triples, pops=None):
    data = [(i, f, m, pops[n] if pops else None, n + 1) for n, (i, f, m) in enumerate(triples)]
    return spark.createDataFrame(data, PEDIGREE)


THREE = [
    ("GF1", None, None), ("GM1", None, None), ("GF2", None, None), ("GM2", None, None),
    ("Father", "GF1", "GM1"), ("Mother", "GF2", "GM2"), ("Child1", "Father", "Mother"), ("Child2", "Father", "Mother"),
]


def kinship_by_hand(triples):
    order = {}
    parents = {i: (f, m) for i, f, m in triples}

    def level(i):
        if i not in order:
            known = [p for p in parents[i] if p]
            order[i] = 1 + max(map(level, known)) if known else 0
        return order[i]

    for i in parents:
        level(i)

    @lru_cache(None)
    def phi(a, b):
        if a is None or b is None:
            return 0.0
        if a == b:
            f, m = parents[a]
            return 0.5 + 0.5 * phi(f, m)
        if (order[a], a) > (order[b], b):
            a, b = b, a
        f, m = parents[b]
        return 0.5 * (phi(a, f) + phi(a, m))

    return phi


def random_pedigree(seed, founders=5, others=13, half=False):
    rng = random.Random(seed)
    rows_ = [(f"n{i}", None, None) for i in range(founders)]
    for i in range(founders, founders + others):
        f, m = rng.sample(range(max(0, i - 7), i), 2)
        rows_.append((f"n{i}", f"n{f}", None if half and rng.random() < 0.2 else f"n{m}"))
    return rows_


def test_three_generations(spark):
    ped = make(spark, THREE)
    phi = {(r.a, r.b): r.phi for r in K.kinship_table(ped).collect()}
    assert phi["Child1", "Child2"] == 0.25 and phi["Child2", "Child1"] == 0.25
    assert phi["Father", "Child1"] == 0.25 and phi["GF1", "Child1"] == 0.125
    assert ("GF1", "GM1") not in phi and phi["GF1", "GF1"] == 0.5 and phi["Child1", "Child1"] == 0.5
    r = {(x.a, x.b): x.r for x in kinship_report(ped, "relatedness", validate=False).collect()}
    assert near(r["Child1", "Child2"], 0.5)


@pytest.mark.parametrize("seed,half", [(1, False), (2, True)])
def test_kinship_against_recursion(spark, seed, half):
    triples = random_pedigree(seed, half=half)
    phi = kinship_by_hand(triples)
    ped = make(spark, triples)
    levels = P.generation_levels(ped)
    got = {(r.a, r.b): r.phi for r in K.kinship_table(ped, levels).collect()}
    names = [t[0] for t in triples]
    for a in names:
        for b in names:
            assert near(got.get((a, b), 0.0), phi(a, b)), (a, b)
    assert any(v > 0.5 for v in got.values())
    f = {r.ind: r.f for r in K.gene_flow(ped, levels)[1].collect()}
    for i, father, mother in triples:
        assert near(f[i], phi(father, mother))
    pairs = [(names[-1], names[-2]), (names[0], names[1]), (names[-3], names[-3]), (names[3], names[-1])]
    some = {(r.a, r.b): r.phi for r in K.kinship_of(ped, spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert len(some) == 4 and all(near(some[p], phi(*p)) for p in pairs)


def test_inbreeding_from_kinship(spark):
    ped = make(spark, THREE + [("Inbred", "Child1", "Child2")])
    got = dict(rows(K.inbreeding_from_kinship(ped, K.kinship_table(ped))))
    assert got["Inbred"] == 0.25 and got["Child1"] == 0.0 and got["GF1"] == 0.0


def test_levels_and_index(spark):
    triples = random_pedigree(3)
    random.Random(0).shuffle(triples)
    ped = make(spark, triples)
    listed = {r.ind: r for r in P.relationship_listing(ped).collect()}
    assert sorted(r.idx for r in listed.values()) == list(range(1, len(triples) + 1))
    for i, f, m in triples:
        if f:
            assert listed[f].idx == listed[i].father_idx < listed[i].idx
            assert listed[m].idx == listed[i].mother_idx < listed[i].idx


def test_loops_against_reachability(spark):
    rng = random.Random(9)
    names = [f"n{i}" for i in range(30)]
    triples = []
    for i, name in enumerate(names):
        if i < 8:
            triples.append((name, None, None))
        elif rng.random() < 0.3:
            triples.append((name, *rng.sample(names, 2)))
        else:
            triples.append((name, *rng.sample(names[:i], 2)))
    parents = {i: [p for p in (f, m) if p] for i, f, m in triples}

    def loops(x):
        seen, todo = set(), list(parents[x])
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += parents[y]
        return x in seen

    want = sorted((x,) for x in names if loops(x))
    assert want
    assert rows(P.ancestor_loops(make(spark, triples))) == sorted(want, key=repr)
    with pytest.raises(ValueError):
        P.generation_levels(make(spark, triples))


def test_two_loops_joined_by_a_path(spark):
    triples = [
        ("a", "b", None), ("b", "a", None), ("mid", "a", None), ("c", "mid", "d"), ("d", "c", None), ("self", "self", None), ("leaf", "d", "c"),
    ]
    assert rows(P.ancestor_loops(make(spark, triples))) == [("a",), ("b",), ("c",), ("d",), ("self",)]


def test_validation_lists_everything(spark):
    triples = [
        ("f", None, None), ("m", None, None), ("c", "f", "m"), ("c", "f", "m"), ("x", "f", "ghost"),
        ("p", "q", None), ("q", "p", None), ("h", "f", None),
    ]
    got = rows(P.validate_pedigree(make(spark, triples)), "error", "ind")
    assert got == sorted(
        [
            ("missing_parent", "x"), ("duplicate_individual", "c"), ("child_is_parent_of_parent", "p"),
            ("half_founder", "p"), ("half_founder", "q"), ("half_founder", "h"), ("ancestor_loop", "p"), ("ancestor_loop", "q"),
        ],
        key=repr,
    )
    with pytest.raises(PedigreeError):
        kinship_report(make(spark, triples))
    assert P.validate_pedigree(make(spark, THREE)).count() == 0


def test_children_and_statistics(spark):
    ped = make(spark, THREE, pops=[0, 0, 0, 1, 0, 1, 1, 1])
    assert dict(rows(P.children_counts(ped))) == {"GF1": 1, "GM1": 1, "GF2": 1, "GM2": 1, "Father": 2, "Mother": 2}
    assert rows(P.children_of_founders(ped), "ind") == [("Father",), ("Mother",)]
    by_pop, migrants = P.pedigree_statistics(ped)
    assert rows(by_pop, "generation", "pop", "n_males", "n_females", "n_total") == [
        (0, 1, 0, 0, 2), (1, 0, 1, 0, 1), (1, 1, 0, 1, 1), (2, 0, 2, 1, 3), (2, 1, 0, 1, 1),
    ]
    assert rows(migrants) == [(0, 2), (1, 1), (2, 0)]


@pytest.mark.parametrize("seed,half", [(4, False), (5, True)])
def test_kinship_columns_against_recursion(spark, seed, half):
    triples = random_pedigree(seed, half=half)
    phi = kinship_by_hand(triples)
    names = [t[0] for t in triples]
    wanted = [names[0], names[-1], names[len(names) // 2], names[-1], "nobody", None]
    ids = spark.createDataFrame([(w,) for w in wanted], "name string")
    got = {(r.a, r.b): r.phi for r in K.kinship_columns(make(spark, triples), ids).collect()}
    assert {a for a, _ in got} == set(wanted) - {"nobody", None}
    for a in set(wanted) - {"nobody", None}:
        for b in names:
            assert near(got.get((a, b), 0.0), phi(a, b)), (a, b)


def test_kinship_pairs_once_and_parents_of_several_levels(spark):
    triples = THREE + [("Late", "Father", "Child1"), ("Later", "Father", "Late"), ("Selfed", "Later", "Later")]
    phi = kinship_by_hand(triples)
    pairs = K.kinship_pairs(make(spark, triples)).collect()
    got = {(r.a, r.b): r.phi for r in pairs}
    assert len(got) == len(pairs) and all(a <= b for a, b in got)
    names = sorted(t[0] for t in triples)
    for i, a in enumerate(names):
        for b in names[i:]:
            assert near(got.get((a, b), 0.0), phi(a, b)), (a, b)


def test_long_loop_takes_few_rounds(spark, monkeypatch):
    n = 2000
    loop = [f"v{i}" for i in range(n)]
    triples = [(loop[i], loop[(i + 1) % n], "out" if i % 3 else None) for i in range(n)]
    triples += [("out", None, None), ("below", "v5", "out"), ("below2", "below", "v9")]
    written = []
    real = P.materialize
    monkeypatch.setattr(P, "materialize", lambda df, label: written.append(label) or real(df, label))
    got = {r.ind for r in P.ancestor_loops(make(spark, triples)).collect()}
    assert got == set(loop)
    assert len(written) < 40


def test_nested_loops_against_components(spark):
    rng = random.Random(12)
    n = 60
    triples = [(f"n{i}", f"n{(i + 1) % n}" if i % 17 else f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for i in range(n)]
    parents = {i: {f, m} for i, f, m in triples}

    def loops(x):
        seen, todo = set(), list(parents[x])
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += parents[y]
        return x in seen

    assert rows(P.ancestor_loops(make(spark, triples))) == sorted(((x,) for x in parents if loops(x)), key=repr)
