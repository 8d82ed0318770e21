"""Names in Latin letters and the alias table, against brute force."""

import random
import re

from tessera.functions.people import COMMON, FIRST, LAST, MIDDLE, SURNAMES, name_pairs, upkeep


def brute(name, handle):
    """Most points of a name for a handle, by patterns."""
    if not re.fullmatch("[가-힣]{2,4}", name):
        return 0
    either = lambda s: "(" + "|".join(s.split(" ")) + ")"
    code = lambda c: ord(c) - 0xAC00
    syllable = lambda c: either(FIRST[code(c) // 588]) + either(MIDDLE[code(c) % 588 // 28]) + either(LAST[code(c) % 28])
    start = lambda c: "[" + "".join(x[0] for x in (FIRST[code(c) // 588] or MIDDLE[code(c) % 588 // 28]).split(" ")) + "]"
    family = either(SURNAMES[name[0]]) if name[0] in SURNAMES else syllable(name[0])
    given, first, short = "".join(map(syllable, name[1:])), syllable(name[1]), "".join(map(start, name[1:]))
    words = [w for w in re.split(r"[\s\-_.,]+", handle.lower()) if w]
    flat, letters = "".join(words), re.sub("[^a-z]", "", "".join(words))
    fits = lambda text, *ps: any(re.fullmatch(p, text) for p in ps)
    if re.fullmatch("[a-z]+", flat) and (len(words) > 1 or len(flat) > 5) and fits(flat, family + given, given + family):
        return 5
    if len(words) != 1 or len(letters) < 3:
        return 0
    common = {s for c in COMMON for s in SURNAMES[c].split()}
    if letters not in common and fits(letters, family + given, given + family, given, family + first, first + family, first, family + short, short + family):
        return 3
    return 2 if name[0] in SURNAMES and fits(letters, "[" + "".join(x[0] for x in SURNAMES[name[0]].split()) + "]" + short) else 0


def test_names_meet_handles_as_patterns_do(spark):
    names = ["조강래", "김성수", "최우선", "고봉수", "이민", "허성", "강민호우", "뷁수", "not hangul", "김", "", None, "조강래"]
    handles = ["Cho Kang Lae", "kang-lae cho", "kim-sung-su", "choiwoosun", "bong9", "kobong", "bongsu", "kim", "ckl", "skim", "kimss", "sung", "leemin", "lee min", "min", "x", "12", "", None, "고봉수", "kangminhowoo", "bong9"]
    points = {h: {n: p for n in set(filter(None, names)) if (p := brute(n, h))} for h in set(filter(None, handles))}
    want = set()
    for h, of in points.items():
        top = max(of.values(), default=0)
        held = [n for n in of if of[n] == top]
        want |= {(n, h, top) for n in held if top == 5 or len(held) == 1}
    got = name_pairs(spark.createDataFrame([(n, 1) for n in names], "name string, points int"), spark.createDataFrame([(h,) for h in handles], "handle string"))
    assert {(r["name"], r["handle"], r["points"]) for r in got.collect()} == want
    assert ("조강래", "Cho Kang Lae", 5) in want and ("고봉수", "bong9", 3) in want and ("조강래", "ckl", 2) in want and not points["kim"]
    assert name_pairs(spark.createDataFrame([], "name string"), spark.createDataFrame([], "handle string")).count() == 0


def test_actions_fold_as_they_replay(spark):
    rng = random.Random(3)
    start, refused = [("a", "X"), (" B ", "Y")], [("c", "X")]
    actions = [(k, rng.choice(["approve", "approve", "reject", "remove"]), rng.choice(["a", "A ", "b", "c", "d", "", None]), rng.choice(["X", "Y ", "Z", "", None])) for k in range(60)]
    for n in (0, 1, 5, 13, 60):
        own, off = {"a": "X", "b": "Y"}, {("c", "X")}
        for _, op, alias, name in actions[:n]:
            alias, name = (alias or "").strip().lower(), (name or "").strip()
            if not alias or op != "remove" and not name:
                continue
            if op == "approve":
                own[alias] = name
                off.discard((alias, name))
            elif op == "reject":
                off.add((alias, name))
                own = {a: x for a, x in own.items() if (a, x) != (alias, name)}
            else:
                own.pop(alias, None)
        pairs = "alias string, name string"
        got = upkeep(spark.createDataFrame(start, pairs), spark.createDataFrame(refused, pairs), spark.createDataFrame(actions[:n], f"seq long, op string, {pairs}"))
        assert {tuple(r) for r in got.collect()} == {(a, x, "approved") for a, x in own.items()} | {(a, x, "rejected") for a, x in off}
