"""Long texts that once ended or held up the pseudonyms, and addresses next to other matches."""

import time

import pytest

from locusframe.llm import pii


@pytest.fixture(scope="module")
def pseudonym(spark):
    def of(*texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return [r.text for r in pii.pseudonymise(rows, "key").orderBy("doc_id").collect()]

    of("warm@up.example")
    return of


def test_long_runs_are_left_in_time(pseudonym):
    def took(*texts):
        began = time.perf_counter()
        assert pseudonym(*texts) == list(texts)
        return time.perf_counter() - began

    # A short text takes as long as the plan takes to compile; four long ones take little more.
    compiling = took("x", "y", "z", "nothing")
    assert took("x@" + "a." * 100_000 + "9", "a1" * 500_000, "a@" * 300_000, "x@" + "a" * 500_000) < compiling + 8


def test_addresses_anywhere_are_found(pseudonym):
    texts = ["a.b@x.org", "(a.b@x.org)", "+49 1234 5678 1234foo@x.com", "a@b.com9x", "a@b..com", "a@b.com...foo", "x@y@z.example", "é@x.org", "ü.b@x.org,c@d.org"]
    got = pseudonym(*texts)
    changed = [a != b for a, b in zip(texts, got, strict=True)]
    assert changed == [True, True, True, True, False, True, True, False, True]
    assert "foo@" not in got[2] and got[0].split("@")[1] != "" and got[3].endswith("9x")
    assert got[8].startswith("ü") and got[8].count("@") == 2
