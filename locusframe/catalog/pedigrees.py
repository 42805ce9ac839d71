"""Registered queries on pedigrees."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusframe import adapters as A
from locusframe.operators import kinship as K
from locusframe.operators import pedigree as P
from locusframe.plans.kinship import kinship_report


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _order_check(s, d):
    """Index of each individual with whether both parents come earlier."""
    listed = P.relationship_listing(A.pedigree(s, d))
    return listed.select(
        "ind", "idx", ((F.col("father_idx") < F.col("idx")) & (F.col("mother_idx") < F.col("idx"))).alias("parents_first")
    )


def _column_kinship(s, d):
    """Ordering customers against all individuals."""
    ordering = A.table(s, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("ind"))
    return _rounded(kinship_report(A.pedigree(s, d), "kinship", ids=ordering), "phi")


QUERIES = {
    "founder_count": lambda s, d: P.founder_count(A.pedigree(s, d)),
    "parent_lookup": lambda s, d: P.parent_lookup(A.pedigree(s, d)),
    "children_counts": lambda s, d: P.children_counts(A.pedigree(s, d)),
    "children_lists": lambda s, d: P.children_lists(A.pedigree(s, d)),
    "children_of_founders": lambda s, d: P.children_of_founders(A.pedigree(s, d)).select("ind", "father", "mother"),
    "missing_parents": lambda s, d: P.missing_parents(A.broken_pedigree(s, d)),
    "duplicate_individuals": lambda s, d: P.duplicate_individuals(A.broken_pedigree(s, d)),
    "child_is_parent_of_parent": lambda s, d: P.child_is_parent_of_parent(A.broken_pedigree(s, d)),
    "half_founders": lambda s, d: P.half_founders(A.broken_pedigree(s, d)),
    "generation_levels": lambda s, d: P.generation_levels(A.pedigree(s, d)),
    "ancestor_loops": lambda s, d: P.ancestor_loops(A.broken_pedigree(s, d)),
    "validate_pedigree": lambda s, d: P.validate_pedigree(A.broken_pedigree(s, d))
    .groupBy("error")
    .agg(F.count(F.lit(1)).alias("n_errors")),
    "index_individuals": _order_check,
    "pedigree_statistics": lambda s, d: P.pedigree_statistics(A.pedigree(s, d))[0],
    "pedigree_migrants": lambda s, d: P.pedigree_statistics(A.pedigree(s, d))[1],
    "kinship": lambda s, d: _rounded(K.kinship_pairs(A.pedigree(s, d)), "phi"),
    "inbreeding": lambda s, d: _rounded(kinship_report(A.pedigree(s, d), "inbreeding", validate=False), "f"),
    "relatedness": lambda s, d: _rounded(kinship_report(A.pedigree(s, d), "relatedness", validate=False), "phi", "r"),
    "kinship_of_pairs": lambda s, d: _rounded(
        kinship_report(A.pedigree(s, d), "kinship", A.relatives(s, d)), "phi"
    ),
    "kinship_report": lambda s, d: _rounded(kinship_report(A.pedigree(s, d)), "phi"),
    "inbreeding_report": lambda s, d: _rounded(kinship_report(A.pedigree(s, d), "inbreeding"), "f"),
    "relatedness_report": lambda s, d: _rounded(kinship_report(A.pedigree(s, d), "relatedness"), "phi", "r"),
    "kinship_columns": _column_kinship,
    "validate_pedigree_rows": lambda s, d: P.validate_pedigree(A.broken_pedigree(s, d)),
    "relationship_listing": lambda s, d: P.relationship_listing(A.pedigree(s, d)),
}

_LEVELS = """
lv(ind, level) AS (SELECT ind, 0 FROM pedigree WHERE father IS NULL AND mother IS NULL
  UNION SELECT p.ind, lv.level + 1 FROM pedigree p JOIN lv ON p.father = lv.ind OR p.mother = lv.ind),
levels AS (SELECT ind, max(level) AS level FROM lv GROUP BY ind)"""

# Pair expansion: the later of two family members is replaced by its parents.
_PAIRS = """
num AS (SELECT k, k - r AS fam, r, CAST(replace(father, 'c', '') AS BIGINT) AS f,
               CAST(replace(mother, 'c', '') AS BIGINT) AS m FROM pedigree),
ex(i, j, a, b, w) AS (
  SELECT x.k, y.k, x.k, y.k, 1.0::DOUBLE FROM num x JOIN num y ON x.fam = y.fam AND x.k <= y.k
  UNION ALL
  SELECT i, j, least(s.p, s.q), greatest(s.p, s.q), w / 2
  FROM (SELECT e.i, e.j, e.w, unnest(CASE WHEN e.a = e.b THEN [{'p': n.f, 'q': n.m}]
               ELSE [{'p': e.a, 'q': n.f}, {'p': e.a, 'q': n.m}] END) AS s
        FROM ex e JOIN num n ON e.b = n.k WHERE n.f IS NOT NULL)),
pairs AS (SELECT i, j, sum(CASE WHEN a = b THEN w / 2 ELSE 0 END) AS phi FROM ex GROUP BY i, j),
kin AS (SELECT 'c' || i AS x, 'c' || j AS y, phi FROM pairs WHERE phi > 0),
kin2 AS (SELECT least(x, y) AS a, greatest(x, y) AS b, phi FROM kin)"""

_RAW = {
    "founder_count": (
        ["pedigree"],
        "SELECT count(*) FILTER (WHERE father IS NULL AND mother IS NULL) AS n_founders, count(*) AS n_individuals FROM pedigree",
    ),
    "parent_lookup": (
        ["pedigree"],
        """
SELECT p.ind, p.father, p.mother, p.pop, p.line_no, f.line_no AS father_line_no, m.line_no AS mother_line_no
FROM pedigree p LEFT JOIN pedigree f ON p.father = f.ind LEFT JOIN pedigree m ON p.mother = m.ind""",
    ),
    "children_counts": (
        ["pedigree"],
        """
SELECT parent, count(*) AS n_children FROM (SELECT father AS parent FROM pedigree UNION ALL SELECT mother FROM pedigree)
WHERE parent IS NOT NULL GROUP BY parent""",
    ),
    "children_lists": (
        ["pedigree"],
        """
WITH l AS (SELECT father AS parent, ind AS child, 'father' AS role FROM pedigree WHERE father IS NOT NULL
           UNION ALL SELECT mother, ind, 'mother' FROM pedigree WHERE mother IS NOT NULL)
SELECT parent, child, role, count(*) OVER (PARTITION BY parent) AS n_children FROM l""",
    ),
    "children_of_founders": (
        ["pedigree"],
        """
WITH fo AS (SELECT ind FROM pedigree WHERE father IS NULL AND mother IS NULL)
SELECT ind, father, mother FROM pedigree WHERE father IN (FROM fo) AND mother IN (FROM fo)""",
    ),
    "missing_parents": (
        ["broken_pedigree"],
        """
SELECT ind, role, parent, line_no FROM (
  SELECT ind, 'father' AS role, father AS parent, line_no FROM broken_pedigree
  UNION ALL SELECT ind, 'mother', mother, line_no FROM broken_pedigree)
WHERE parent IS NOT NULL AND parent NOT IN (SELECT ind FROM broken_pedigree)""",
    ),
    "duplicate_individuals": (
        ["broken_pedigree"],
        """
SELECT ind, line_no, first_line FROM (SELECT ind, line_no, min(line_no) OVER (PARTITION BY ind) AS first_line
  FROM broken_pedigree) WHERE line_no > first_line""",
    ),
    "child_is_parent_of_parent": (
        ["broken_pedigree"],
        """
SELECT a.ind, 'father' AS role, a.father AS parent, a.line_no, b.line_no AS parent_line
FROM broken_pedigree a JOIN broken_pedigree b ON a.father = b.ind AND b.father = a.ind WHERE a.line_no < b.line_no
UNION ALL SELECT a.ind, 'mother', a.mother, a.line_no, b.line_no
FROM broken_pedigree a JOIN broken_pedigree b ON a.mother = b.ind AND b.mother = a.ind WHERE a.line_no < b.line_no""",
    ),
    "half_founders": (
        ["broken_pedigree"],
        "SELECT ind, line_no FROM broken_pedigree WHERE (father IS NULL) <> (mother IS NULL)",
    ),
    "generation_levels": (
        ["pedigree"],
        f"WITH RECURSIVE {_LEVELS} SELECT ind, father, mother, level FROM pedigree JOIN levels USING (ind)",
    ),
    "ancestor_loops": (
        ["broken_pedigree"],
        """
WITH RECURSIVE e AS (SELECT ind, father AS p FROM broken_pedigree UNION SELECT ind, mother FROM broken_pedigree),
up(ind, anc) AS (SELECT ind, p FROM e WHERE p IS NOT NULL
  UNION SELECT up.ind, e.p FROM up JOIN e ON up.anc = e.ind WHERE e.p IS NOT NULL)
SELECT ind FROM up WHERE ind = anc""",
    ),
    "index_individuals": (
        ["pedigree"],
        f"""
WITH RECURSIVE {_LEVELS}
SELECT ind, row_number() OVER (ORDER BY level, line_no) AS idx, true AS parents_first FROM pedigree JOIN levels USING (ind)""",
    ),
    "pedigree_statistics": (
        ["pedigree"],
        f"""
WITH RECURSIVE {_LEVELS}
SELECT (SELECT max(level) FROM levels) - level AS generation, pop,
       count(*) FILTER (WHERE ind IN (SELECT father FROM pedigree WHERE father IS NOT NULL)) AS n_males,
       count(*) FILTER (WHERE ind IN (SELECT mother FROM pedigree WHERE mother IS NOT NULL)) AS n_females,
       count(*) AS n_total FROM pedigree JOIN levels USING (ind) GROUP BY ALL""",
    ),
    "pedigree_migrants": (
        ["pedigree"],
        f"""
WITH RECURSIVE {_LEVELS}
SELECT (SELECT max(level) FROM levels) - level AS generation,
       count(*) FILTER (WHERE f.pop <> p.pop OR m.pop <> p.pop) AS n_migrants
FROM pedigree p JOIN levels USING (ind) LEFT JOIN pedigree f ON p.father = f.ind
     LEFT JOIN pedigree m ON p.mother = m.ind GROUP BY ALL""",
    ),
    "kinship": (["pedigree"], f"WITH RECURSIVE {_PAIRS} SELECT a, b, round(phi, 6) AS phi FROM kin2"),
    "inbreeding": (
        ["pedigree"],
        f"""
WITH RECURSIVE {_PAIRS}
SELECT p.ind, round(coalesce(k.phi, 0), 6) AS f FROM pedigree p
LEFT JOIN kin2 k ON k.a = least(p.father, p.mother) AND k.b = greatest(p.father, p.mother) AND p.father IS NOT NULL""",
    ),
    "relatedness": (
        ["pedigree"],
        f"""
WITH RECURSIVE {_PAIRS}
SELECT k.a, k.b, round(k.phi, 6) AS phi, round(2 * k.phi / sqrt(2 * s.phi * 2 * t.phi), 6) AS r
FROM kin2 k JOIN kin2 s ON s.a = k.a AND s.b = k.a JOIN kin2 t ON t.a = k.b AND t.b = k.b""",
    ),
    "kinship_of_pairs": (
        ["pedigree", "relatives"],
        f"""
WITH RECURSIVE {_PAIRS}
SELECT r.a, r.b, round(coalesce(k.phi, 0), 6) AS phi FROM relatives r
LEFT JOIN kin2 k ON k.a = least(r.a, r.b) AND k.b = greatest(r.a, r.b)""",
    ),
    "kinship_columns": (
        ["pedigree"],
        f"""
WITH RECURSIVE {_PAIRS},
both_ways AS (SELECT a, b, phi FROM kin2 UNION ALL SELECT b, a, phi FROM kin2 WHERE a <> b)
SELECT a, b, round(phi, 6) AS phi FROM both_ways WHERE a IN (SELECT 'c' || o_custkey FROM orders)""",
    ),
    "relationship_listing": (
        ["pedigree"],
        f"""
WITH RECURSIVE {_LEVELS},
n AS (SELECT row_number() OVER (ORDER BY level, line_no) AS idx, ind, father, mother FROM pedigree JOIN levels USING (ind))
SELECT n.idx, n.ind, coalesce(f.idx, 0) AS father_idx, coalesce(m.idx, 0) AS mother_idx
FROM n LEFT JOIN n f ON n.father = f.ind LEFT JOIN n m ON n.mother = m.ind""",
    ),
}

ORACLES = {name: A.with_tables(tables, body) for name, (tables, body) in _RAW.items()}

_CHECKS = {
    "missing_parent": "missing_parents",
    "duplicate_individual": "duplicate_individuals",
    "child_is_parent_of_parent": "child_is_parent_of_parent",
    "half_founder": "half_founders",
    "ancestor_loop": "ancestor_loops",
}
ORACLES["validate_pedigree"] = " UNION ALL ".join(
    f"SELECT '{error}' AS error, count(*) AS n_errors FROM ({ORACLES[name]}) HAVING count(*) > 0"
    for error, name in _CHECKS.items()
)

for _measure in ("kinship", "inbreeding", "relatedness"):
    ORACLES[f"{_measure}_report"] = ORACLES[_measure]
_DETAILS = {
    "missing_parent": "line_no, role || ' ' || parent",
    "duplicate_individual": "line_no, CAST(first_line AS VARCHAR)",
    "child_is_parent_of_parent": "line_no, role || ' ' || parent",
    "half_founder": "line_no, NULL",
    "ancestor_loop": "NULL, NULL",
}
ORACLES["validate_pedigree_rows"] = "SELECT error, ind, CAST(line_no AS BIGINT) AS line_no, detail FROM (" + " UNION ALL ".join(
    f"SELECT '{error}', ind, {_DETAILS[error]} FROM ({ORACLES[name]})" for error, name in _CHECKS.items()
) + ") AS found(error, ind, line_no, detail)"
