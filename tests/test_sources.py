import glob
import random

import pytest
from pyspark.sql import functions as F

from locusframe.operators import markers as M
from locusframe.plans.sampling import VariantSet, sample_vcf
from locusframe.schemas import FOUNDERS, SEGMENTS
from locusframe.sources import fasta, genotypes, pedigree, segments, text, trees, vcf
from helpers import rows


def read_back(folder):
    return "".join(open(p).read() for p in sorted(glob.glob(f"{folder}/part-*")))


@pytest.fixture
def tiny_splits(spark):
    """Cut text files into splits of a few hundred bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "300b", "spark.sql.files.openCostInBytes": "1b"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def many_parts(spark):
    """Keep small part files apart."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_part_files_are_one_text(spark, text_file, tmp_path, many_parts):
    cohort = vcf.read_vcf(spark, text_file("parts.vcf", VCF))
    vcf.write_vcf(cohort, str(tmp_path / "v"))
    folder = tmp_path / "v" / "file_id=parts.vcf"
    assert len(glob.glob(f"{folder}/part-*")) > 1
    again = vcf.read_vcf(spark, str(folder))
    assert again.variants.join(again.samples, "file_id").count() == 9
    assert rows(again.meta, "line_no", "line") == rows(cohort.meta, "line_no", "line")
    founders = spark.createDataFrame([("f0", 0)], FOUNDERS)
    chunks = [("f0", h, n, c * 160) for h in (0, 1) for n, c in enumerate("ACGT")]
    df = spark.createDataFrame(chunks, "founder string, homolog int, chunk_no bigint, bases string")
    fasta.write_fasta(df, str(tmp_path / "f"), name="founder")
    assert len(glob.glob(f"{tmp_path}/f/part-*")) > 1
    assert rows(fasta.read_fasta(spark, str(tmp_path / "f"), founders, 160)[1]) == sorted(chunks, key=repr)


def test_line_numbers_over_splits(spark, text_file, tiny_splits):
    content = [f"line {i} " + "x" * (i % 17) if i % 7 else "" for i in range(1, 301)]
    path = text_file("long.txt", "\n".join(content) + "\n")
    numbered = text.numbered_lines(spark, path)
    assert numbered.select("block").distinct().count() > 3
    assert [v for _, v in sorted(rows(numbered, "line_no", "value"))] == content
    kept = text.numbered_lines(spark, path, F.col("value") != "")
    assert [v for _, v in sorted(rows(kept, "line_no", "value"))] == [c for c in content if c]


def test_genotype_errors_and_round_trip(spark, text_file, tmp_path):
    body = "i1 p l1 a b\n i2\tp\tl1\t?\t. \ni3 p l1 a\ni4 p l1 a b c\ni5 p l1 a# b\n"
    good, bad = genotypes.read_genotypes(spark, text_file("g.inp", body))
    assert rows(good, "ind", "allele1", "allele2") == [("i1", "a", "b"), ("i2", "?", ".")]
    assert rows(bad, "n_columns") == [(4,), (5,), (6,)]
    genotypes.write_genotypes(good.withColumn("allele2", F.when(F.col("allele2") != ".", F.col("allele2"))), str(tmp_path / "out"))
    again, bad = genotypes.read_genotypes(spark, str(tmp_path / "out"))
    assert bad.count() == 0 and rows(again, "ind", "pop", "locus", "allele2") == [("i1", "p", "l1", "b"), ("i2", "p", "l1", "0")]


def test_small_lists(spark, text_file):
    assert rows(genotypes.read_id_list(spark, text_file("ids", "a  \n\nb\r\n"))) == [("a",), ("b",)]
    assert rows(genotypes.read_pop_map(spark, text_file("map", "^9_ north\n\n^8 south\n"))) == [(1, "^9_", "north"), (2, "^8", "south")]
    regions = genotypes.read_target_regions(spark, text_file("reg", "# c\n0.1 0.2\n\nbad line\n0.5\t0.75\n"))
    assert rows(regions) == [(1, 0.1, 0.2), (2, 0.5, 0.75)]


def test_pedigree_forms(spark, text_file, tmp_path):
    body = "# note\nA 0 0\n\n  B\t0 0\nC A B\nD A\nE A B 2\n"
    good, bad = pedigree.read_pedigree(spark, text_file("p.ped", body))
    assert rows(good, "ind", "father", "mother", "line_no") == [("A", None, None, 2), ("B", None, None, 4), ("C", "A", "B", 5)]
    assert rows(bad, "line_no", "n_columns") == [(1, 2), (6, 2), (7, 4)]
    good, bad = pedigree.read_pedigree(spark, text_file("q.ped", body), strict=False)
    assert rows(good, "ind", "pop") == [("A", None), ("B", None), ("C", None), ("E", 2)]
    assert rows(bad, "line_no") == [(6,)]
    shuffled = good.where("ind <> 'D'").orderBy(F.desc("ind"))
    pedigree.write_pedigree(shuffled, str(tmp_path / "ped"))
    assert [x.split()[0] for x in read_back(tmp_path / "ped").splitlines()] == ["A", "B", "C", "E"]
    assert "E A B 2" in read_back(tmp_path / "ped")


VCF = """##fileformat=VCFv4.2
##contig=<ID=chr1,length=100>
##contig=<ID=chr2,length=200>
##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tsA\tsB\tsC
chr1\t10\t.\tA\tC\t.\tPASS\tAGE=3.25\tGT\t0|0\t0|1\t1|1
chr1\t20\t.\tA\tG\t.\tPASS\t.\tGT\t0|1\t0|0\t0|0
chr2\t5\trs1\tT\tG\t.\tPASS\t.\tGT\t0|0\t1|0\t0|0
"""


def test_vcf_round_trip(spark, text_file, tmp_path):
    cohort = vcf.read_vcf(spark, text_file("a.vcf", VCF))
    assert rows(cohort.samples, "sample_idx", "sample_id") == [(0, "sA"), (1, "sB"), (2, "sC")]
    assert rows(cohort.contigs, "chrom", "length") == [("chr1", 100), ("chr2", 200)]
    assert rows(cohort.variants, "chrom", "pos", "id", "gts") == [
        ("chr1", 10, ".", ["0|0", "0|1", "1|1"]), ("chr1", 20, ".", ["0|1", "0|0", "0|0"]), ("chr2", 5, "rs1", ["0|0", "1|0", "0|0"]),
    ]
    vcf.write_vcf(cohort, str(tmp_path / "same"))
    assert read_back(tmp_path / "same" / "file_id=a.vcf") == VCF
    ids = spark.createDataFrame([("sC",), ("sA",)], "sample_id string")
    vcf.write_vcf(sample_vcf(cohort, ids, k=1, region="chr1"), str(tmp_path / "less"))
    lines = read_back(tmp_path / "less" / "file_id=a.vcf").splitlines()
    assert "##contig=<ID=chr2,length=200>" not in lines and "##contig=<ID=chr1,length=100>" in lines
    assert lines[-2].endswith("FORMAT\tsA\tsC") and lines[-1] == "chr1\t10\t.\tA\tC\t.\tPASS\tAGE=3.25\tGT\t0|0\t1|1"


def test_vcf_without_meta(spark, text_file, tmp_path):
    cohort = vcf.read_vcf(spark, text_file("b.vcf", VCF))
    bare = VariantSet(cohort.variants.select("file_id", "chrom", "pos", "ref", "alt", "gts"), cohort.samples, cohort.contigs)
    vcf.write_vcf(bare, str(tmp_path / "bare"))
    again = vcf.read_vcf(spark, str(tmp_path / "bare" / "file_id=b.vcf"))
    assert rows(again.contigs, "chrom", "length") == [("chr1", 100), ("chr2", 200)]
    assert rows(again.variants, "chrom", "pos", "filter", "gts") == rows(
        cohort.variants.withColumn("filter", F.lit("PASS")), "chrom", "pos", "filter", "gts"
    )


def test_marker_leg_cuts_two_fields(spark, text_file):
    cohort = vcf.read_vcf(spark, text_file("c.vcf", VCF))
    plan = M.distinct_markers(cohort.variants)._jdf.queryExecution().optimizedPlan().toString()
    assert "substring_index" in plan and "slice" not in plan


SEGMENT_TEXT = """# made by hand
# Chromosomes: 2 RecRate: 1.000000 Seed: 12345
# Founders: F1 F2 F3 F4
#
Individual: child1
  Chromosome: 1
    Paternal:
    0.000000 0.234521 F1:pat
    0.234521 0.567823 F2:mat
    0.567823 1.000000 F1:pat
    Maternal:
    0.000000 0.789012 F3:pat
    0.789012 1.000000 F4:mat
  Chromosome: 2
    Paternal:
    0.000000 1.000000 F2:pat

Individual: old
  Paternal:
    0.000000 1.000000 F1:mat
"""


def test_segments(spark, text_file, tmp_path, many_parts, tiny_splits):
    path = text_file("s.txt", SEGMENT_TEXT)
    founders = segments.read_founders(spark, path)
    assert rows(founders) == [("F1", 0), ("F2", 1), ("F3", 2), ("F4", 3)]
    got = segments.read_segments(spark, path)
    want = [
        ("child1", 1, 0, 1, 0.0, 0.234521, "F1", 0), ("child1", 1, 0, 2, 0.234521, 0.567823, "F2", 1),
        ("child1", 1, 0, 3, 0.567823, 1.0, "F1", 0), ("child1", 1, 1, 1, 0.0, 0.789012, "F3", 0),
        ("child1", 1, 1, 2, 0.789012, 1.0, "F4", 1), ("child1", 2, 0, 1, 0.0, 1.0, "F2", 0), ("old", 1, 0, 1, 0.0, 1.0, "F1", 1),
    ]
    assert rows(got) == sorted(want, key=repr)
    segments.write_segments(got, founders, str(tmp_path / "seg"))
    assert read_back(tmp_path / "seg").startswith("# Founders: F1 F2 F3 F4\nIndividual: child1\n  Chromosome: 1\n    Paternal:\n    0.000000 0.234521 F1:pat\n")
    assert len(glob.glob(f"{tmp_path}/seg/part-*")) > 1
    assert rows(segments.read_segments(spark, str(tmp_path / "seg"))) == sorted(want, key=repr)


def test_fasta(spark, text_file, tmp_path, tiny_splits):
    rng = random.Random(1)
    seqs = {h: "".join(rng.choice("ACGT") for _ in range(413)) for h in ("f0:pat", "f0:mat", "sample2", "sample3", "sample9", "extra")}
    wrap = lambda s, n: "\n".join(s[i:i + n] for i in range(0, len(s), n))
    body = "".join(f">{h}\n# note\n{wrap(s, 60 if i % 2 else 500)}\n\n" for i, (h, s) in enumerate(seqs.items()))
    founders = spark.createDataFrame([("f0", 0), ("f1", 1)], FOUNDERS)
    haps, chunks = fasta.read_fasta(spark, text_file("f.fa", body), founders, chunk_bases=160)
    want = {("f0", 0): "f0:pat", ("f0", 1): "f0:mat", ("f1", 0): "sample2", ("f1", 1): "sample3", ("extra", 0): "extra"}
    assert rows(haps) == sorted(((f, h, 413) for f, h in want), key=repr)
    got = {}
    for r in chunks.orderBy("chunk_no").collect():
        got.setdefault((r.founder, r.homolog), []).append(r.bases)
    assert {k: "".join(v) for k, v in got.items()} == {k: seqs[h] for k, h in want.items()}
    assert all(len(p) == 160 for v in got.values() for p in v[:-1])
    fasta.write_fasta(chunks, str(tmp_path / "fa"), name="founder")
    out = read_back(tmp_path / "fa")
    assert f">f0:mat\n{wrap(seqs['f0:mat'], 80)}\n" in out and max(map(len, out.splitlines())) == 80


def test_fasta_of_several_chromosomes(spark, text_file):
    one, two = text_file("c1.fa", ">f0:pat\nAAAAAAAA\n"), text_file("c2.fa", ">f0:pat\nCCCC\n")
    founders = spark.createDataFrame([("f0", 0)], FOUNDERS)
    number = F.regexp_extract("file", r"c(\d+)\.fa$", 1)
    haps, chunks = fasta.read_fasta(spark, [one, two], founders, chunk_bases=80, chrom=number)
    assert rows(chunks, "chrom", "founder", "bases") == [(1, "f0", "AAAAAAAA"), (2, "f0", "CCCC")]
    assert rows(haps, "chrom", "seq_len") == [(1, 8), (2, 4)]
    with pytest.raises(ValueError, match="more than one sequence"):
        fasta.read_fasta(spark, [one, two], founders, chunk_bases=80)
    with pytest.raises(ValueError, match="more than one sequence"):
        fasta.read_fasta(spark, text_file("twice.fa", ">f0:pat\nAC\n>f0:pat\nGT\n"), founders, chunk_bases=80)


def test_rejects(spark, text_file):
    body = "Individual: a\n  Chromosome: 1\n    Paternal:\n0.0 0.5 F:pat\n0.5 oops\n.. 1.0 F:pat\nIndividual: b\n0.0 1.0 F:mat\n# note\n"
    path = text_file("seg.txt", body)
    assert [r[0] for r in rows(segments.read_segments(spark, path), "founder")] == ["F"]
    assert rows(segments.segment_rejects(spark, path), "value") == sorted([("0.5 oops",), (".. 1.0 F:pat",), ("0.0 1.0 F:mat",)], key=repr)
    lost = text_file("bad.vcf", "#CHROM\tPOS\nchr1\tNA\tx\nchr1\t5\tx\n\nchr1\n")
    assert rows(vcf.vcf_rejects(spark, lost), "value", "n_columns") == sorted([("chr1\tNA\tx", 3), ("chr1", 1)], key=repr)
    regions = text_file("regions", "# c\n0.1 0.2\n\nbad line\n0.5\n")
    assert rows(genotypes.target_region_rejects(spark, regions), "value") == sorted([("bad line",), ("0.5",)], key=repr)


def test_vcf_files_of_one_base_name_stay_apart(spark, text_file, tmp_path):
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "d.vcf").write_text(VCF)
    vcf.write_vcf(vcf.read_vcf(spark, [str(tmp_path / "x" / "d.vcf"), str(tmp_path / "y" / "d.vcf")]), str(tmp_path / "out"))
    for folder in ("file_id=d.vcf", "file_id=d.vcf-2"):
        assert read_back(tmp_path / "out" / folder).count("#CHROM") == 1


def test_trees_and_logs(spark, text_file, tmp_path):
    tree_path = text_file("t.txt", "# trees\n((1:1,2:1):1,3:2);\n\n(1:1,2:1);\n")
    interval_path = text_file("i.txt", "x [0.0,0.25] y\nnothing\n[0.25,1.0]\n")
    assert rows(trees.read_trees_with_intervals(spark, tree_path, interval_path), "tree_no", "lower", "upper", "newick") == [
        (1, 0.0, 0.25, "((1:1,2:1):1,3:2);"), (2, 0.25, 1.0, "(1:1,2:1);"),
    ]
    assert rows(trees.read_interval_trees(spark, text_file("it.txt", "noise\n[0.0,1.0] (1:1,2:1);\n")), "lower", "newick") == [(0.0, "(1:1,2:1);")]
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "1.log").write_text("No_Recombinations: 3 No_Mutations: 14 No_Ancestral_Chromosomes: 9\nOldest_TMRCA: 812.50\nYoungest_TMRCA: 4.00 Avg_TMRCA: 9\nNo_MRCAs: 2 \n")
    (logs / "2.log").write_text("  Final time: 55.25 generations\ntime:\t1.5\t4.25\ntime:\t2.5\t6.0\n")
    got = rows(trees.read_replicate_logs(spark, str(logs)), "tmrca", "recomb", "mutations", "num_mrcas", "youngest_tmrca", "final_time")
    assert got == sorted([(812.5, 3, 14, 2, 4.0, None), (None, None, None, None, None, 55.25)], key=repr)
    assert rows(trees.read_time_rows(spark, str(logs)), "tmrca", "tree_length") == [(1.5, 4.25), (2.5, 6.0)]


def test_segment_header_is_written_and_read(spark, tmp_path):
    rows_in = [("a", 1, 0, 1, 0.0, 1.0, "f", 0), ("a", 3, 1, 1, 0.0, 1.0, "g", 1)]
    table = spark.createDataFrame(rows_in, "ind string, chrom int, homolog int, seq int, start double, end double, founder string, f_homolog int")
    founders = spark.createDataFrame([("f", 0), ("g", 1)], "founder string, ord int")
    cases = {"known": dict(n_chroms=5, rec_rate=1.5, seed=42), "seeded": dict(seed=7), "plain": {}}
    for name, options in cases.items():
        segments.write_segments(table, founders, str(tmp_path / name), **options)
    head = lambda name: [tuple(r)[1:] for r in segments.read_segment_header(spark, str(tmp_path / name)).collect()]
    assert head("known") == [(5, 1.5, 42)] and head("seeded") == [(3, None, 7)] and head("plain") == []
    text = "".join(p.read_text() for p in sorted((tmp_path / "known").glob("part-*"))).splitlines()
    assert text[:2] == ["# Chromosomes: 5 RecRate: 1.500000 Seed: 42", "# Founders: f g"]
    back = segments.read_segments(spark, str(tmp_path / "known"))
    assert sorted(map(tuple, back.collect())) == rows_in
    assert segments.segment_rejects(spark, str(tmp_path / "known")).count() == 0
    assert [r.founder for r in segments.read_founders(spark, str(tmp_path / "known")).orderBy("ord").collect()] == ["f", "g"]


def test_running_sums_and_last_values_of_lines(spark, text_file, tiny_splits):
    content = [f">{i}" if i % 11 == 5 else "#" if i % 5 == 0 else "x" * (i % 17 + 1) for i in range(300)]
    files = [text_file(name, "\n".join(content[k:]) + "\n") for k, name in enumerate(("a.txt", "b.txt"))]
    is_head = F.col("value").startswith(">")
    got = text.numbered_lines(
        spark, files, F.col("value") != "#", sums={"upto": F.when(is_head, 0).otherwise(F.length("value"))}, last={"own": F.when(is_head, F.col("value"))}
    )
    assert got.select("file", "block").distinct().count() > 6
    # Lines are neither shuffled nor sorted, and carry no path beside their file's.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and "hashpartitioning" not in plan
    want = []
    for k in (0, 1):
        upto, own, n = 0, None, 0
        for line in content[k:]:
            if line == "#":
                continue
            n += 1
            upto += 0 if line.startswith(">") else len(line)
            own = (line, n, upto) if line.startswith(">") else own
            want.append((k + 1, n, line, upto, own))
    found = [(r.file_no, r.line_no, r.value, r.upto, tuple(r.own) if r.own else None) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
