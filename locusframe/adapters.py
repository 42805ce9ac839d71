"""The driver's star-schema tables seen as domain tables.

Each adapter has a Spark form and, under the same name in ``SQL``, the
equivalent common table expression for the oracle.  Every one reads its whole
input tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the derived tables.
N_CHROMS = 5
FOUNDERS_PER_PANEL = 25
PANEL_HAPLOTYPES = 2 * FOUNDERS_PER_PANEL
FAMILY = 50
COHORT = 10
CHUNK = 32


# Rows that one task is to hold of a table that is joined, grouped or expanded.
TASK_ROWS = 500_000
# Variant records, of 50 calls each, that one task is to make.
TASK_RECORDS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, rows: int, *keys: str, size: int = TASK_ROWS) -> DataFrame:
    """``df`` in partitions of about ``size`` of its ``rows``, so that a task's work and memory do not grow with the input."""
    return df.repartition(-(-rows // size), *keys) if rows > size else df


# ---------------------------------------------------------------- genotypes

def raw_genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item; (order, line) pairs repeat."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.select(
        F.col("o_orderpriority").alias("pop"),
        F.concat(F.lit("i"), F.col("l_orderkey")).alias("ind"),
        F.concat(F.lit("l"), F.col("l_linenumber")).alias("locus"),
        (F.col("l_partkey") % 4).cast("string").alias("allele1"),
        (F.col("l_suppkey") % 4).cast("string").alias("allele2"),
    )


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (order, line); grouping on the join key needs no second shuffle."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    n = lines.count()
    lines, orders = dealt(lines, n, "l_orderkey"), dealt(orders, n, "o_orderkey")
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .groupBy("l_orderkey", "l_linenumber", "o_orderpriority")
        .agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
        .select(
            F.col("o_orderpriority").alias("pop"),
            F.concat(F.lit("i"), F.col("l_orderkey")).alias("ind"),
            F.concat(F.lit("l"), F.col("l_linenumber")).alias("locus"),
            (F.col("p") % 4).cast("string").alias("allele1"),
            (F.col("s") % 4).cast("string").alias("allele2"),
        )
    )


# ----------------------------------------------------------------- variants

def _variant_columns(file_id: str, key: str):
    k = F.col(key)
    hap = lambda h: F.when((k * 7 + h * 5 + F.floor(k / 11) * h) % 4 == 0, "1").otherwise("0")
    return [
        F.lit(file_id).alias("file_id"),
        F.concat(F.lit("chr"), 1 + k % N_CHROMS).alias("chrom"),
        (k * 37 + 1).cast("bigint").alias("pos"),
        F.lit(".").alias("id"),
        F.when(k % 3 == 0, "A").otherwise("C").alias("ref"),
        F.when(k % 3 == 2, "G").otherwise("T").alias("alt"),
        F.lit(".").alias("qual"),
        F.lit("PASS").alias("filter"),
        F.concat(F.lit("AGE="), k % 1000, F.lit(".50")).alias("info"),
        F.lit("GT").alias("format"),
        F.transform(F.sequence(F.lit(0), F.lit(PANEL_HAPLOTYPES - 1)), hap).alias("gts"),
    ]


def _records(spark: SparkSession, sf_dir: str, name: str, file_id: str, key: str) -> DataFrame:
    keys = table(spark, sf_dir, name).select(key)
    return dealt(keys, keys.count(), size=TASK_RECORDS).select(*_variant_columns(file_id, key))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Haploid founder panel: one record per part, one column per founder haplotype."""
    return _records(spark, sf_dir, "part", "a", "p_partkey")


def variants_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second file: one record per line item, so positions repeat."""
    return _records(spark, sf_dir, "lineitem", "b", "l_partkey")


def variants_third(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third file: one record per order, keyed by its customer."""
    return _records(spark, sf_dir, "orders", "c", "o_custkey")


def three_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        variants(spark, sf_dir)
        .unionByName(variants_repeated(spark, sf_dir))
        .unionByName(variants_third(spark, sf_dir))
    )


def phased_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with its two columns per founder joined to one phased call."""
    pair = lambda i: F.concat(F.get("gts", i * 2), F.lit("|"), F.get("gts", i * 2 + 1))
    founders = F.sequence(F.lit(0), F.lit(FOUNDERS_PER_PANEL - 1))
    return variants(spark, sf_dir).withColumn("gts", F.transform(founders, pair))


def panel_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample columns of the phased panel: one per nation."""
    return table(spark, sf_dir, "nation").select(
        F.lit("a").alias("file_id"),
        F.col("n_nationkey").cast("int").alias("sample_idx"),
        F.concat(F.lit("N"), F.col("n_nationkey")).alias("sample_id"),
    )


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contig lengths: one base beyond the last marker of each chromosome."""
    return (
        variants(spark, sf_dir)
        .groupBy("chrom")
        .agg((F.max("pos") + 1).alias("length"))
        .select(F.lit("a").alias("file_id"), "chrom", "length")
    )


def founders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("N"), F.col("n_nationkey")).alias("founder"),
        F.col("n_nationkey").cast("int").alias("ord"),
    )


# ----------------------------------------------------------------- pedigree

def _parent(base, cohort, couple, offset):
    return F.concat(F.lit("c"), base + COHORT * (cohort - 1) + 2 * couple + offset)


def pedigree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of 50 customers: five cohorts of ten, five couples per cohort."""
    k = F.col("c_custkey")
    r = k % FAMILY
    base = k - r
    cohort = F.floor(r / COHORT)
    unknown = F.lit(None).cast("string")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), k).alias("ind"),
        F.when(cohort == 0, unknown).otherwise(_parent(base, cohort, (7 * r) % 5, 0)).alias("father"),
        F.when(cohort == 0, unknown)
        .otherwise(_parent(base, cohort, (3 * r + cohort) % 5, 1))
        .alias("mother"),
        F.col("c_nationkey").cast("int").alias("pop"),
        (k + 1).cast("bigint").alias("line_no"),
    )


def broken_pedigree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pedigree with format-correct mistakes, for the validator.

    The first founder of every family names the family's last member as its
    father (a loop, and one known parent), members 20 and 21 of a family are
    each other's father, member 3 names an undefined mother, and the orders
    table adds a second row for every ordering customer whose key is a multiple
    of its nation number plus 40.
    """
    ped = pedigree(spark, sf_dir)
    k = F.col("line_no") - 1
    r = k % FAMILY
    base = k - r
    label = lambda n: F.concat(F.lit("c"), n)
    changed = ped.withColumns(
        {
            "father": F.when(r == 0, label(base + FAMILY - 1))
            .when(r == 20, label(base + 21))
            .when(r == 21, label(base + 20))
            .otherwise(F.col("father")),
            "mother": F.when(r == 3, label(-1 - base)).otherwise(F.col("mother")),
        }
    )
    ordering = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("ind")).distinct()
    again = (
        ped.join(ordering, "ind", "left_semi")
        .where(k % (F.col("pop") + 40) == 0)
        .withColumn("line_no", F.col("line_no") + 1_000_000_000_000)
    )
    return changed.unionByName(again)


def relatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs to compare: each customer with the next one of its family."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), k).alias("a"),
        F.concat(F.lit("c"), k - k % FAMILY + (k % FAMILY + 1) % FAMILY).alias("b"),
    )


# ----------------------------------------------------------------- segments

def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three founder segments per customer, chromosome and homolog."""
    k = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    base = dealt(customers, customers.count() * N_CHROMS * 6).select(
        k.alias("k"), F.explode(F.sequence(F.lit(1), F.lit(N_CHROMS))).alias("chrom")
    )
    base = base.withColumn("homolog", F.explode(F.array(F.lit(0), F.lit(1))))
    k, c, h = F.col("k"), F.col("chrom"), F.col("homolog")
    cut1 = (13 * k + c + 3 * h) % 4 + 1
    cut2 = (7 * k + 2 * c + h) % 4 + 6
    origin = lambda n: F.concat(F.lit("N"), n % FOUNDERS_PER_PANEL)
    piece = lambda n, lo, hi, f, fh: F.struct(
        F.lit(n).alias("seq"),
        (lo / F.lit(10.0)).alias("start"),
        (hi / F.lit(10.0)).alias("end"),
        origin(f).alias("founder"),
        fh.cast("int").alias("f_homolog"),
    )
    pieces = F.array(
        piece(1, F.lit(0), cut1, F.floor(k / 5) + h, k % 2),
        piece(2, cut1, cut2, F.floor(k / 5) + h + (k % 3), k % 2),
        piece(3, cut2, F.lit(10), F.floor(k / 7) * 3 + c, (k + c) % 2),
    )
    return base.withColumn("s", F.explode(pieces)).select(
        F.concat(F.lit("c"), k).alias("ind"),
        c.cast("int").alias("chrom"),
        h.cast("int").alias("homolog"),
        "s.seq",
        "s.start",
        "s.end",
        "s.founder",
        "s.f_homolog",
    )


def supplier_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment lists of the suppliers on chromosome 1, overlapping and with gaps."""
    k = F.col("s_suppkey")
    base = table(spark, sf_dir, "supplier").select(
        k.alias("k"), F.explode(F.array(F.lit(0), F.lit(1))).alias("homolog")
    )
    k, h = F.col("k"), F.col("homolog")
    origin = lambda n: F.concat(F.lit("N"), n % FOUNDERS_PER_PANEL)
    piece = lambda n, lo, hi, f: F.struct(
        F.lit(n).alias("seq"),
        (lo / F.lit(100.0)).alias("start"),
        (hi / F.lit(100.0)).alias("end"),
        origin(f).alias("founder"),
        ((k + n) % 2).cast("int").alias("f_homolog"),
    )
    pieces = F.array(
        piece(1, F.lit(0), 30 + k % 20, k),
        piece(2, 25 + k % 30, F.lit(70), k + 3 + h),
        piece(3, 75 + k % 7, F.lit(100), k * 3 + 1),
    )
    return base.withColumn("s", F.explode(pieces)).select(
        F.concat(F.lit("s"), k).alias("ind"),
        F.lit(1).alias("chrom"),
        h.cast("int").alias("homolog"),
        "s.seq",
        "s.start",
        "s.end",
        "s.founder",
        "s.f_homolog",
    )


def haplotype_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Founder sequences on chromosome 1: 32 bases per part and haplotype."""
    parts = table(spark, sf_dir, "part").select("p_partkey")
    return (
        dealt(parts, parts.count(), size=TASK_ROWS // PANEL_HAPLOTYPES)
        .select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(PANEL_HAPLOTYPES - 1))).alias("h"))
        .select(
            F.concat(F.lit("N"), F.floor(F.col("h") / 2)).alias("founder"),
            (F.col("h") % 2).cast("int").alias("homolog"),
            F.col("p_partkey").cast("bigint").alias("chunk_no"),
            F.translate(
                F.md5(F.concat(F.col("h") % 7, F.lit("-"), F.col("p_partkey"))),
                "0123456789abcdef",
                "AAAAAAAAAAAAACGT",
            ).alias("bases"),
        )
    )


def sequence_length(spark: SparkSession, sf_dir: str) -> int:
    """Bases of chromosome 1; every part adds one chunk."""
    return CHUNK * table(spark, sf_dir, "part").count()


# ---------------------------------------------------- intervals, replicates

def mrca_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    lower = k * 7919 % 9000
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("rep"),
        k.alias("ins_no"),
        (lower / F.lit(10000.0)).alias("lower"),
        ((lower + k % 7 * 50 + 13) / F.lit(10000.0)).alias("upper"),
        F.col("value").alias("age"),
    )


def target_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping regions of different lengths, one per supplier."""
    k = F.col("s_suppkey")
    start = k * 37 % 950
    return table(spark, sf_dir, "supplier").select(
        k.alias("region_id"),
        (start / F.lit(1000.0)).alias("start"),
        ((start + k % 3) / F.lit(1000.0)).alias("end"),
    )


def replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("scenario"), F.col("event_id").alias("rep"), F.col("value").alias("metric")
    )


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One four-tip tree per customer; a third of them balanced."""
    k = F.col("c_custkey")
    tip = lambda n: ((k + n) % 4 + 1).cast("string")
    height = (k % 9 + 1).cast("string")
    balanced = F.concat(
        F.lit("(("), tip(0), F.lit(":1,"), tip(1), F.lit(":1):"), height,
        F.lit(",("), tip(2), F.lit(":1,"), tip(3), F.lit(":1):"), height, F.lit(");"),
    )
    ladder = F.concat(
        F.lit("((("), tip(0), F.lit(":1,"), tip(1), F.lit(":1):1,"), tip(2),
        F.lit(":2):"), height, F.lit(","), tip(3), F.lit(":"), (k % 9 + 3).cast("string"), F.lit(");"),
    )
    return table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("rep"),
        k.alias("tree_no"),
        F.when(F.floor(k / 4) % 3 == 0, balanced).otherwise(ladder).alias("newick"),
    )


def _variant_sql(file_id: str, key: str, source: str) -> str:
    return f"""
SELECT '{file_id}' AS file_id, 'chr' || (1 + {key} % {N_CHROMS}) AS chrom,
       CAST({key} * 37 + 1 AS BIGINT) AS pos,
       CASE WHEN {key} % 3 = 0 THEN 'A' ELSE 'C' END AS ref,
       CASE WHEN {key} % 3 = 2 THEN 'G' ELSE 'T' END AS alt,
       'AGE=' || ({key} % 1000) || '.50' AS info,
       list_transform(range(0, {PANEL_HAPLOTYPES}),
         lambda h: CASE WHEN ({key} * 7 + h * 5 + ({key} // 11) * h) % 4 = 0 THEN '1' ELSE '0' END) AS gts
FROM {source}"""


SQL: dict[str, str] = {
    "raw_genotypes": """
SELECT o_orderpriority AS pop, 'i' || l_orderkey AS ind, 'l' || l_linenumber AS locus,
       CAST(l_partkey % 4 AS VARCHAR) AS allele1, CAST(l_suppkey % 4 AS VARCHAR) AS allele2
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "genotypes": """
SELECT o_orderpriority AS pop, 'i' || l_orderkey AS ind, 'l' || l_linenumber AS locus,
       CAST(min(l_partkey) % 4 AS VARCHAR) AS allele1, CAST(min(l_suppkey) % 4 AS VARCHAR) AS allele2
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority, l_orderkey, l_linenumber""",
    "clean": """
SELECT pop, ind, locus,
       CASE WHEN allele1 NOT IN ('0', '?', '.') THEN allele1 END AS a1,
       CASE WHEN allele2 NOT IN ('0', '?', '.') THEN allele2 END AS a2
FROM genotypes""",
    "variants": _variant_sql("a", "p_partkey", "part"),
    "variants_repeated": _variant_sql("b", "l_partkey", "lineitem"),
    "variants_third": _variant_sql("c", "o_custkey", "orders"),
    "three_files": """
SELECT * FROM variants UNION ALL SELECT * FROM variants_repeated UNION ALL SELECT * FROM variants_third""",
    "phased": f"""
SELECT chrom, pos, ref, alt, i AS sample_idx, gts[2 * i + 1] || '|' || gts[2 * i + 2] AS gt
FROM variants, range(0, {FOUNDERS_PER_PANEL}) AS r(i)""",
    "contigs": "SELECT chrom, max(pos) + 1 AS length FROM variants GROUP BY chrom",
    "founders": "SELECT 'N' || n_nationkey AS founder, n_nationkey AS ord FROM nation",
    "pedigree": f"""
SELECT 'c' || k AS ind,
       CASE WHEN g > 0 THEN 'c' || (base + {COHORT} * (g - 1) + 2 * ((7 * r) % 5)) END AS father,
       CASE WHEN g > 0 THEN 'c' || (base + {COHORT} * (g - 1) + 2 * ((3 * r + g) % 5) + 1) END AS mother,
       pop, k + 1 AS line_no, k, r, base
FROM (SELECT c_custkey AS k, c_custkey % {FAMILY} AS r, c_custkey - c_custkey % {FAMILY} AS base,
             (c_custkey % {FAMILY}) // {COHORT} AS g, c_nationkey AS pop FROM customer)""",
    "broken_pedigree": f"""
SELECT ind,
       CASE WHEN r = 0 THEN 'c' || (base + {FAMILY - 1}) WHEN r = 20 THEN 'c' || (base + 21)
            WHEN r = 21 THEN 'c' || (base + 20) ELSE father END AS father,
       CASE WHEN r = 3 THEN 'c' || (-1 - base) ELSE mother END AS mother, pop, line_no
FROM pedigree
UNION ALL
SELECT ind, father, mother, pop, line_no + 1000000000000
FROM pedigree WHERE k % (pop + 40) = 0 AND k IN (SELECT o_custkey FROM orders)""",
    "relatives": f"""
SELECT 'c' || c_custkey AS a,
       'c' || (c_custkey - c_custkey % {FAMILY} + (c_custkey % {FAMILY} + 1) % {FAMILY}) AS b FROM customer""",
    "segments": f"""
WITH g AS (SELECT c_custkey AS k, c, h, (13 * c_custkey + c + 3 * h) % 4 + 1 AS cut1,
                  (7 * c_custkey + 2 * c + h) % 4 + 6 AS cut2
           FROM customer, range(1, {N_CHROMS + 1}) AS x(c), range(0, 2) AS y(h))
SELECT 'c' || k AS ind, c AS chrom, h AS homolog, 1 AS seq, 0 / 10.0::DOUBLE AS start, cut1 / 10.0::DOUBLE AS "end",
       'N' || ((k // 5 + h) % {FOUNDERS_PER_PANEL}) AS founder, k % 2 AS f_homolog FROM g
UNION ALL SELECT 'c' || k, c, h, 2, cut1 / 10.0::DOUBLE, cut2 / 10.0::DOUBLE,
       'N' || ((k // 5 + h + k % 3) % {FOUNDERS_PER_PANEL}), k % 2 FROM g
UNION ALL SELECT 'c' || k, c, h, 3, cut2 / 10.0::DOUBLE, 10 / 10.0::DOUBLE,
       'N' || (((k // 7) * 3 + c) % {FOUNDERS_PER_PANEL}), (k + c) % 2 FROM g""",
    "supplier_segments": f"""
WITH g AS (SELECT s_suppkey AS k, h FROM supplier, range(0, 2) AS y(h))
SELECT 's' || k AS ind, 1 AS chrom, h AS homolog, 1 AS seq, 0 / 100.0::DOUBLE AS start,
       (30 + k % 20) / 100.0::DOUBLE AS "end", 'N' || (k % {FOUNDERS_PER_PANEL}) AS founder, (k + 1) % 2 AS f_homolog FROM g
UNION ALL SELECT 's' || k, 1, h, 2, (25 + k % 30) / 100.0::DOUBLE, 70 / 100.0::DOUBLE,
       'N' || ((k + 3 + h) % {FOUNDERS_PER_PANEL}), (k + 2) % 2 FROM g
UNION ALL SELECT 's' || k, 1, h, 3, (75 + k % 7) / 100.0::DOUBLE, 100 / 100.0::DOUBLE,
       'N' || ((k * 3 + 1) % {FOUNDERS_PER_PANEL}), (k + 3) % 2 FROM g""",
    "haplotype_chunks": f"""
SELECT 'N' || (h // 2) AS founder, h % 2 AS homolog, p_partkey AS chunk_no,
       translate(md5((h % 7) || '-' || p_partkey), '0123456789abcdef', 'AAAAAAAAAAAAACGT') AS bases
FROM part, range(0, {PANEL_HAPLOTYPES}) AS r(h)""",
    "mrca_intervals": """
SELECT event_type AS rep, event_id AS ins_no, (event_id * 7919 % 9000) / 10000.0::DOUBLE AS lower,
       (event_id * 7919 % 9000 + event_id % 7 * 50 + 13) / 10000.0::DOUBLE AS upper, value AS age FROM events""",
    "target_regions": """
SELECT s_suppkey AS region_id, (s_suppkey * 37 % 950) / 1000.0::DOUBLE AS start,
       (s_suppkey * 37 % 950 + s_suppkey % 3) / 1000.0::DOUBLE AS "end" FROM supplier""",
    "replicates": "SELECT event_type AS scenario, event_id AS rep, value AS metric FROM events",
    "trees": """
SELECT rep, k AS tree_no, t0, t1, t2, t3, h, balanced,
       CASE WHEN balanced THEN '((' || t0 || ':1,' || t1 || ':1):' || h || ',(' || t2 || ':1,' || t3 || ':1):' || h || ');'
            ELSE '(((' || t0 || ':1,' || t1 || ':1):1,' || t2 || ':2):' || h || ',' || t3 || ':' || (h + 2) || ');' END AS newick
FROM (SELECT c_mktsegment AS rep, c_custkey AS k, c_custkey % 4 + 1 AS t0, (c_custkey + 1) % 4 + 1 AS t1,
             (c_custkey + 2) % 4 + 1 AS t2, (c_custkey + 3) % 4 + 1 AS t3, c_custkey % 9 + 1 AS h,
             (c_custkey // 4) % 3 = 0 AS balanced FROM customer)""",
}

# Which domain tables a domain table is built from, in SQL.
NEEDS = {
    "clean": ["genotypes"],
    "three_files": ["variants", "variants_repeated", "variants_third"],
    "phased": ["variants"],
    "contigs": ["variants"],
    "broken_pedigree": ["pedigree"],
}


def with_tables(names: list[str], body: str, recursive: bool = False) -> str:
    """``body`` preceded by the common table expressions of ``names``."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        add(name)
    ctes = [f"{n} AS ({SQL[n]})" for n in wanted]
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        body = body[5:].lstrip()
        if body.upper().startswith("RECURSIVE "):
            recursive, body = True, body[10:]
        ctes.append(body)
        text = ",\n".join(ctes)
    else:
        text = ",\n".join(ctes) + "\n" + body
    return f"WITH {'RECURSIVE ' if recursive else ''}{text}"
