"""Metadata brought in line with changed rules is what computing all of it gives."""

import random

from tessera.operators import renormalise as rn

RAW, RULES = "doc long, title string, people array<string>", "kind string, key string, value string, points long"


def rows(df):
    return sorted(map(str, df.collect()))


def test_replayed_changes_equal_computing_all(spark):
    rng = random.Random(8)
    words, names = [f"w{k}" for k in range(30)], [f"N{k}" for k in range(12)]
    raw = {k: (" ".join(rng.choices(words, k=rng.randrange(6))), rng.choices([*names, "N1 (team)", "n2@x", None, ""], k=rng.randrange(4))) for k in range(80)}
    rules = {("type", rng.choice(words), rng.choice("abc"), rng.randint(1, 3)) for _ in range(12)} | {("alias", f"n{k}", f"m{k % 2}", 0) for k in range(4)}
    frame = lambda: rn.one_each(spark.createDataFrame([(k, *v) for k, v in raw.items()] + [(None, "w1", ["N1"])], RAW))
    table = lambda: spark.createDataFrame(sorted(rules) * 2, RULES)
    meta, people = (spark.createDataFrame(x.collect(), x.schema) for x in rn.normalised(frame(), table()))
    for turn in range(3):
        old = table()
        word, name = rng.choice(words), rng.choice(names).lower()
        if turn != 1:
            rules -= {sorted(rules)[rng.randrange(len(rules))]}
            rules |= {("type", word, "d", 2), ("alias", name, "new", 0)}
        else:
            raw[100] = ("w1 w2", None)
            raw[3] = (None, ["N5"])
            del raw[7]
        meta, people, todo = rn.renormalised_tables(frame(), meta, people, old, table())
        want_meta, want_people = rn.normalised(frame(), table())
        assert rows(meta.select(*rn.META)) == rows(want_meta.select(*rn.META)) and rows(people) == rows(want_people)
        done = {r["doc"] for r in todo.collect()}
        assert 0 < len(done) < len(raw) and (turn != 1 or done == {3, 100})
        meta, people = (spark.createDataFrame(x.collect(), x.schema) for x in (meta, people))


def test_literal_rows(spark):
    raw = spark.createDataFrame([(1, "Report of REPORT x", ["Ann (lead)", "ann@x.org", "Bo"]), (2, None, None), (3, "b a", [])], RAW)
    rules = spark.createDataFrame([("type", "report", "r", 2), ("type", "x", "q", 2), ("type", "a", "tu", 1), ("type", "a", "t", 1), ("alias", "bo", "bob", 0), ("alias", "bo", "bea", 0)], RULES)
    meta, people = rn.normalised(raw, rules)
    assert {r["doc"]: (r["doc_type"], r["points"]) for r in meta.collect()} == {1: ("q", 2), 2: (None, None), 3: ("t", 1)}
    assert sorted((r["doc"], r["person"]) for r in people.collect()) == [(1, "ann"), (1, "bea")]
    assert rn.reached(raw.where("false"), meta, rules, rules).collect() == []
    assert rn.reached(raw, meta, rules, rules).collect() == []
