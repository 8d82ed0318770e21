"""Sequential operators on literal rows."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import sequential as S

D = "/root/testdata/sf0.001"


def test_citations_outside_the_evidence_lose_their_brackets(spark):
    rows = [("a [1] b [3][2] [0].", 2), ("[99999999999999999999] [x] ]", 2), ("[7]", 0), ("[7]", None), (None, 2), ("", 1)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, n int").select(S.valid_cites(F.col("t"), F.col("n"))).collect()]
    assert got == ["a [1] b 3[2] 0.", "99999999999999999999 [x] ]", "[7]", "[7]", None, ""]


def test_a_side_ends_at_its_first_overflow():
    assert S.grown(np.array([1, 9, 2, 3, 4]), 2, 9) == (2, 4)
    assert S.grown(np.array([1, 1, 2, 30, 1]), 2, 9) == (0, 2)
    assert S.grown(np.array([50]), 0, 9) == (0, 0)
    assert S.grown(np.array([2, 2, 2, 2, 2]), 2, 6) == (1, 3)


def test_parent_expansion_keeps_its_hit_and_budget(spark):
    rows = S.parent_expand(spark, D).collect()
    assert rows and all(r["first"] <= r["hit"] <= r["last"] for r in rows)
    assert all(r["n_words"] <= 128 or r["first"] == r["last"] for r in rows)
    odd = spark.createDataFrame([([], 0), (None, 0), ([3], None)], "sizes array<int>, hit int")
    assert [tuple(r)[2:] for r in S.expanded(odd, 5).collect()] == [(None, None)] * 3


def test_brief_skips_near_copies(spark):
    rows = [(1, 0, "abcdefgh"), (1, 1, "abc defgh"), (1, 2, "xyzxyw"), (1, 3, None), (1, 4, "another"), (2, 0, "abcdefgh"), (None, 0, "lost")]
    got = S.brief(spark.createDataFrame(rows, "g int, o int, t string"), "g", "o", "t").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1), (1, 2, 2), (1, 3, 3), (2, 0, 1)]


def test_halves_round_to_even(spark):
    got = spark.createDataFrame([([2049.0, 2051.0, 0.1],), (None,)], "v array<float>").select(S.to_half_and_back("v")).collect()
    assert got[0][0][:2] == [2048.0, 2052.0] and abs(got[0][0][2] - 0.1) < 1e-4 and got[1][0] is None
