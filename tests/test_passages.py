"""Picks of passages against the rule in plain Python."""

import random
import re

from tessera.operators import passages as P


def score(seg):
    n = len(seg)
    letters = sum(c.isalpha() for c in seg)
    if n < 120 or letters < 0.35 * n or re.search(r"\S{61}", seg) or seg.count(" ") < n / 25:
        return 0.0
    return round((2 * len(re.findall("[0-9]+", seg)) + len(re.findall("[A-Z][a-z]+", seg))) / n**0.5, 6)


def picks(text, k):
    found = sorted(((score(text[i : i + 420]), i) for i in range(0, max(1, len(text) - 420), 210)), reverse=True)
    out = []
    for s, i in found:
        if s > 0 and len(out) < k and all(abs(i - j) >= 840 for _, j in out):
            out.append((s, i))
    return [(i, s, " ".join(text[i : i + 420].split())) for s, i in out]


def test_picks(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["the", "Über", "Anna", "12", "3,400", "über", "x" * 30, "is"])
    texts = [" ".join(word() for _ in range(rng.randrange(0, 900))) for _ in range(40)]
    texts += [None, "", "Short 12", "A" * 5000, "12 " * 400, "Anna has 12 of them. " * 40, "Anna has 12 of them.\n" * 6000, "y " * 60 + "z" * 70 + " Anna 12" * 20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for k in (2, 5):
        got = {}
        for r in P.picked(docs, k).collect():
            got[r["doc_id"], r["nth"]] = (r["start"], r["score"], r["passage"])
        want = {(d, n): x for d, t in enumerate(texts) if t for n, x in enumerate(picks(t, k), 1)}
        assert got.keys() == want.keys()
        assert all(got[x][::2] == want[x][::2] and abs(got[x][1] - want[x][1]) < 2e-6 for x in want)
    assert P.picked(docs.where("false")).collect() == []
