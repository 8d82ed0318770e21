"""Mixing where ids are null, repeated or hot: every row is a document of its own."""

import collections

from tessera.llm import mixing, packing


def rows_of(n):
    out = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, "w " * (5 + k * 7919 % 40) + f"u{k}", f"src{k % 4}", k) for k in range(n)]
    return out + [(None, "all the same " * 9, "src1", 0)] * 200 + [(9, "all the same " * 9, "src2", 0)] * 3 + [(None, None, None, 5), (4, "", None, 5)]


def test_targets_are_met_with_null_and_hot_ids(spark):
    rows = rows_of(3000)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies_a int").repartition(4)
    got = mixing.mixed_copies(docs).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter((r["doc_id"], r["source"], r["size"]) for r in got)
    assert sizes == collections.Counter((i, s, len((t or "").split())) for i, t, s, _ in rows)
    taken, target, longest = collections.Counter(), {}, collections.Counter()
    for r in got:
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in target)
    again = mixing.mixed_copies(docs.repartition(7)).collect()
    assert collections.Counter(again) == collections.Counter(got)


def test_mixture_takes_equal_rows_as_often_as_their_copies(spark):
    docs = spark.createDataFrame(rows_of(300), "doc_id long, text string, source string, copies_a int").repartition(4)
    want = collections.Counter()
    for r in mixing.unit_copies(docs).collect():
        want[r["doc_id"], r["source"], r["size"]] += r["copies"]
    mixed = mixing.mixture(docs)
    assert mixed.columns == docs.columns
    got = collections.Counter((r["doc_id"], r["source"], len((r["text"] or "").split())) for r in mixed.collect())
    assert got == +want
    assert mixing.mixture(docs.where("false")).collect() == []


def test_groups_of_packing_are_even_with_null_and_hot_ids(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 200)
    monkeypatch.setattr(packing, "CHUNK", 16)
    rows = rows_of(3000)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies_a int").repartition(4)
    got = packing.packed(docs).collect()
    assert collections.Counter((r["doc_id"], r["length"]) for r in got) == collections.Counter((i, len((t or "").split())) for i, t, _, _ in rows)
    groups = collections.Counter(r["bin_id"] >> 32 for r in got if r["bin_id"] is not None)
    assert len(groups) == 17 and max(groups.values()) < 300
    assert collections.Counter(packing.packed(docs.repartition(7)).collect()) == collections.Counter(got)
