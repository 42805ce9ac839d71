"""Shared-folder tables and readers of several files."""

import os

from locusframe.operators.markers import polymorphic
from locusframe.session import materialize, scratch, shared_folder
from locusframe.sources import segments
from locusframe.sources.text import lines


def test_scratch_removes_its_tables(spark):
    with scratch(spark):
        kept = materialize(spark.range(5), "five")
        path = kept.inputFiles()[0].removeprefix("file://")
        assert kept.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path)
    assert shared_folder(spark)


def test_founders_of_all_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# Founders: F1 F2\nIndividual: x\n")
    (tmp_path / "b.txt").write_text("# note\n# Founders: F2 G1\n# Founders: late\n")
    got = segments.read_founders(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")])
    assert sorted(map(tuple, got.collect())) == [("F1", 0), ("F2", 1), ("G1", 2)]


def test_user_files_named_part_stay_apart(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"part-{n}.txt").write_text("x\n")
    assert lines(spark, str(tmp_path)).select("file").distinct().count() == 2


def test_polymorphic_ignores_other_fields(spark):
    df = spark.createDataFrame([(1, ["0|0:12", "0|0:9"]), (2, ["0|1:0", "0|0:0"])], "pos int, gts array<string>")
    assert [r.pos for r in polymorphic(df).collect()] == [2]
