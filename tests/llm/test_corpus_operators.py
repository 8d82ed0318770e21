"""Each corpus operator against brute force, on the small documents and on a table of odd rows."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import components, fingerprints, language_id, line_dedup, lm_scoring, mixing, packed, packing, quality, sharding, simhash, token_store
from tessera.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{k % 977} tail{k % 31}" for k in range(30_000))
ODD = [
    (1, None, "en", "a"),
    (2, "", None, "a"),
    (3, " \t\n ", "en", None),
    (4, "one", "en", "a"),
    (5, "The same line of text\nshort\nThe same line of text", "en", "a"),
    (6, "  the SAME line of text \n\nother words stand here", "fr", "b"),
    (7, "Éa ñ ü \x1c \xa0 é" * 30, "fr", "b"),
    (8, LONG, "en", "a"),
    (9, LONG, "en", "a"),
    (10, "the same line of text", "en", None),
    (11, "12345 67890 !!", "en", "a"),
    (-4, "minus words " * 40, "de", "c"),
    (1 << 40, "far away words " * 40, "de", "c"),
]


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing names."""
    rows = [(*x, len(x[1] or ""), "x", "y") for x in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, batch_no string, component_id string").repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(params=["small", "odd"])
def docs(request):
    return request.getfixturevalue(request.param)


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=lambda x: x[0])


def by_id(df):
    out = {r["doc_id"]: r for r in df.collect()}
    return out


def test_fingerprints(docs):
    got, rows = by_id(fingerprints.query(docs)), rows_of(docs)
    assert len(got) == len(rows)
    prints = {}
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(text) // 4
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256((text[: len(text) - q] + after[:q]).encode()).hexdigest()
        assert prints.setdefault(text, got[i]["fingerprint"]) == got[i]["fingerprint"]
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
        if text == after:
            assert got[i]["near_next"] == 1


def test_fingerprints_tell_edited_from_next(small):
    got = fingerprints.query(small).collect()
    assert np.mean([r["near_edited"] > r["near_next"] for r in got]) > 0.95


def spark_hash(values, seed=42):
    """Spark's xxhash64 of strings (str), longs (int) and ints (one-element tuples) in turn."""
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_equal_brute_force(spark):
    """Lexicon, subsets, codes and likeness recomputed."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got, rows = by_id(fingerprints.query(docs)), rows_of(docs)
    terms = lambda t: {w.lower() for w in WORD.findall(t or "")}
    df = collections.Counter(w for _, t in rows for w in terms(t))
    band = {w for w, n in df.items() if fingerprints.IDF_LOW <= math.log(len(rows) / n) <= fingerprints.IDF_HIGH}

    def codes(text):
        out = ["."] * (fingerprints.SUBSETS * fingerprints.TIERS)
        by = collections.defaultdict(list)
        for w in terms(text) & band:
            h = signed(spark_hash([w]))
            for tier, rate in enumerate(fingerprints.RATES):
                k = (spark_hash([h, (fingerprints.SEED + tier,)]) >> 16) % rate
                if k < fingerprints.SUBSETS:
                    by[k + fingerprints.SUBSETS * tier].append(h)
        for k, own in by.items():
            out[k] = f"{spark_hash(sorted(own)):016x}"[:8]
        return out if by else "all:" + f"{spark_hash(sorted(terms(text))):016x}"[:8]

    def like(a, b):
        if a == b:
            return 1.0
        if isinstance(a, str) or isinstance(b, str):
            return 0.0
        share = lambda x, y: (sum(p == q for p, q in zip(x, y, strict=True) if p != "." or q != "."), sum(p != "." or q != "." for p, q in zip(x, y, strict=True)))
        n = fingerprints.SUBSETS
        tiers = [share(a[n * t : n * t + n], b[n * t : n * t + n]) for t in range(fingerprints.TIERS)]
        best = [s / m for s, m in tiers if m >= fingerprints.LEAST]
        s, m = share(a, b)
        return max(best) if best else s / m if m else 0.0

    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(text) // 4
        own, edited, following = codes(text), codes(text[: len(text) - q] + after[:q]), codes(after)
        assert got[i]["fingerprint"] == "".join(own)
        assert got[i]["edited_fingerprint"] == "".join(edited)
        assert got[i]["near_edited"] == pytest.approx(like(own, edited))
        assert got[i]["near_next"] == pytest.approx(like(own, following))


def brute_print(text, words=3):
    w = [x.encode() for x in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    shingles = [b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, most):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= most:
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(docs):
    got, rows = by_id(simhash.query(docs)), rows_of(docs)
    prints = [brute_print(t) for _, t in rows]
    want = brute_components([i for i, _ in rows], prints, 3)
    for (i, _), p in zip(rows, prints, strict=True):
        assert got[i]["fingerprint"] == f"{p:016x}"
        assert got[i]["component_id"] == want[i]


def test_simhash_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (7, "x y z w")], "doc_id long, text string")
    got = sorted(((r["doc_id"] is None, r["component_id"]) for r in simhash.query(df).collect()))
    assert got == [(False, 3), (False, 3), (False, 7), (True, 3)]


def test_links_of_planted_fingerprints(spark):
    rng = random.Random(3)
    prints = []
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 40])):
            p = base
            for b in rng.sample(range(64), rng.randint(0, 4)):
                p ^= 1 << b
            prints.append(p)
    rows = [(k, p.to_bytes(8, "big")) for k, p in enumerate(prints)]
    got = by_id(simhash.grouped(spark.createDataFrame(rows, "doc_id long, fp binary"), 3))
    want = brute_components(list(range(len(prints))), prints, 3)
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_hot_values_split_without_loss(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 1 << 63))
    prints = [base ^ sum(1 << int(b) for b in rng.choice(64, 2, replace=False)) for _ in range(300)]
    rows = [(k, p.to_bytes(8, "big")) for k, p in enumerate(prints)]
    monkeypatch.setattr(simhash, "CELL_ROWS", 40)
    got = by_id(simhash.grouped(spark.createDataFrame(rows, "doc_id long, fp binary"), 3))
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(list(range(300)), prints, 3)


def test_thresholds_spend_the_budget_at_least_cost():
    cost = [[0, 5, 9], [0, 1, 50], [0, 4, 6]]
    assert thresholds_cost(cost, simhash.thresholds(cost, 4)) == 12
    assert sum(t + 1 for t in simhash.thresholds(cost, 4)) == 4


def thresholds_cost(cost, chosen):
    return sum(c[t + 1] for c, t in zip(cost, chosen, strict=True))


def test_components(spark):
    rng = random.Random(5)
    links = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(60)]
    got = {r["node"]: r["root"] for r in components.stars(spark.createDataFrame(links, "u long, v long")).collect()}
    root = {i: i for x in links for i in x}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in root if find(i) != i}


def test_near_duplicates_keep_one(spark):
    words = lambda n, s: [f"w{random.Random(s * 10_000 + k).randint(0, 9999)}" for k in range(n)]
    a = words(300, 1)
    b = [*a[:150], "changed", *a[151:]]  # similarity 0.97
    c = words(300, 2)
    df = spark.createDataFrame([(5, " ".join(a), 1), (2, " ".join(b), 2), (9, " ".join(a), 3), (4, " ".join(c), 4), (4, " ".join(c), 4), (8, None, 5)], "doc_id long, text string, row_no long")
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [2, 4, 8]


def test_keep_one_loses_no_other_text(spark):
    """Null and repeated ids, equal rows, clashing names."""
    words = lambda s: " ".join(f"w{random.Random(s * 10_000 + k).randint(0, 9999)}" for k in range(60))
    rows = [(None, words(1), "x"), (None, words(2), "x"), (None, words(3), "x"), (4, words(4), "x"), (4, words(5), "x"), (4, words(5), "x"), (6, words(1), "y"), (7, "", "z"), (8, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    want = [(6, words(1)), (None, words(2)), (None, words(3)), (4, words(4)), (4, words(5)), (7, "")]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)


def edited_pair(rng, n, similarity):
    """Two texts of n words whose sets of five-word shingles have this resemblance or a little more, and the exact one."""
    a = [f"w{rng.randint(0, 20_000)}" for _ in range(n)]
    b, sets = list(a), lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    likeness = lambda x, y: len(x & y) / len(x | y)
    now = 1.0
    for k in rng.sample(range(n), n):
        last, b[k] = b[k], f"z{rng.randint(0, 20_000)}"
        then = likeness(sets(a), sets(b))
        if then < similarity:
            b[k] = last
            return " ".join(a), " ".join(b), now
        now = then


@pytest.mark.parametrize("width", [None, 20])
def test_near_duplicates_recall(spark, width):
    """Of pairs just at 0.8 or above over nine in ten are found; none below is linked."""
    rng = random.Random(11)
    rows, pairs = [], []
    for level in (0.70, 0.77, 0.80, 0.85, 0.90):
        for _ in range(100):
            a, b, now = edited_pair(rng, 300, level)
            pairs.append((level, now, len(rows)))
            rows += [(len(rows), a), (len(rows) + 1, b)]
    got = by_id(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width=width))
    hits = collections.defaultdict(list)
    for level, now, k in pairs:
        linked = got[k]["component_id"] == got[k + 1]["component_id"]
        if now < 0.8:
            assert not linked
        else:
            hits[level].append(linked)
    found = [x for own in hits.values() for x in own]
    low = hits[0.8]
    print(width, np.mean(found), np.mean(low), len(low))
    assert len(low) == 100 and np.mean(low) > 0.9 and np.mean(found) > 0.95


@pytest.mark.parametrize("chunk", [2048, 7])
def test_links_of_sets_in_chunks(spark, monkeypatch, chunk):
    """Groups whose verified links are few: all links that matter are found, however the chunks fall."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(8)
    sets, own = [], []
    for g in range(6):
        base = [rng.getrandbits(63) for _ in range(60)]
        for _ in range(12):
            x = set(base)
            for _ in range(rng.randint(0, 9)):
                x.discard(rng.choice(base)), x.add(rng.getrandbits(63))
            sets.append(np.array(sorted(x), np.uint64)), own.append(g)
    ids = list(range(100, 100 + len(sets)))
    first = [(ids[k], ids[own.index(own[k])]) for k in range(len(sets)) if k != own.index(own[k])]
    near = [(a, b) for a, b in first if a % 3 == 0]
    near = [(a, b) for a, b in near if len(np.intersect1d(sets[a - 100], sets[b - 100])) >= 0.8 * len(np.union1d(sets[a - 100], sets[b - 100]))]
    frame = lambda x: spark.createDataFrame(x, "u long, v long")
    told = frame(near).union(simhash._apart_links(frame(first), frame(near), spark.createDataFrame([(i, x.tobytes()) for i, x in zip(ids, sets, strict=True)], "node long, own binary")))
    got = {r["node"]: r["root"] for r in components.stars(told).collect()}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and len(np.intersect1d(sets[a - 100], sets[b - 100])) >= 0.8 * len(np.union1d(sets[a - 100], sets[b - 100])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {i: got.get(i, i) for i in ids} == {i: find(i) for i in ids}


def test_near_groups_hang_on_no_failed_link(spark):
    """A chain of texts, each near the next alone, is one group, whatever links the first pass took."""
    rng = random.Random(4)
    text = [f"w{rng.randint(0, 20_000)}" for _ in range(400)]
    rows = []
    for k in range(12):
        rows.append((k, " ".join(text)))
        for _ in range(6):
            text[rng.randrange(400)] = f"z{rng.randint(0, 20_000)}"
    got = by_id(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {r["component_id"] for r in got.values()} == {0}


def brute_counts(text):
    text = text or ""
    w, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    hit = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_quality(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = by_id(quality.query(docs, labels))
    for i, text in rows_of(docs):
        n = brute_counts(text)
        assert tuple(got[i][c] for c in quality.COUNTS) == n
        assert got[i]["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (got[i]["base_failed"] and got[i]["kept"])


def test_quality_rejects_bad_and_keeps_good(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.query(docs, labels).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in got}
    assert kept[1] > 0.98 and kept[0] < 0.05


def test_quality_without_labels(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.query(odd, labels).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in got)
    kept = quality.quality_filter(odd, labels)
    assert kept.columns == odd.columns and kept.count() == sum(not r["base_failed"] for r in got)


def test_quality_learns_from_every_labelled_row(spark):
    """A mildly bad row that comes last by the hash which once picked 20,000 rows of a label sets the threshold; the forest and the threshold are those of brute force over all rows."""
    bad = spark.range(1000, 21_100).select(F.col("id").alias("doc_id")).orderBy(F.xxhash64("doc_id", F.lit(11)).desc(), F.desc("doc_id"))
    mild = {r[0] for r in bad.limit(5).collect()}
    rng = random.Random(3)
    rows = [(k, " ".join(f"{k}x{j}" + "y" * rng.randrange(4) for j in range(60)), 1) for k in range(300)]
    rows += [(k, " ".join(f"5x{j % 100}{j // 100}y" for j in range(600)) + "#" if k in mild else " ".join(f"#{j}" for j in range(60)), 0) for k in range(1000, 21_100)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(5)
    docs, labels = table.select("doc_id", "text"), table.select("doc_id", "quality")
    got = by_id(quality.query(docs, labels))
    assert not any(got[k]["kept"] for k, _, q in rows if not q)
    assert sum(got[k]["kept"] for k, _, q in rows if q) >= 299

    forest, most = quality.fitted(docs, labels)
    x = quality.features(np.array([quality.counts(t.encode()) for _, t, _ in rows]))
    good = np.array([q for _, _, q in rows]) == 1
    ends = np.concatenate([forest.ends(t, x[good]) for t in range(forest.trees)])
    number = np.bincount(ends, minlength=len(forest.feature))
    for node in range(len(number) - 1, -1, -1):  # children lie behind their parents
        if forest.feature[node] >= 0:
            number[node] = number[forest.left[node]] + number[forest.left[node] + 1]
            assert number[node] > 1
    assert (number[: forest.trees] == 300).all()
    depth = np.zeros(len(number))
    for node in np.flatnonzero(forest.feature >= 0):
        depth[forest.left[node]] = depth[forest.left[node] + 1] = depth[node] + 1
    leaves = forest.feature < 0
    assert np.allclose(forest.path[leaves], depth[leaves] + quality._mean_path(number[leaves])) and (depth[leaves & (number > 1)] == 16).all()
    score = forest.score(x)
    limit = np.quantile(score[good], 1 - quality.FALSE_REJECT, method="higher")
    assert most == (limit + score[~good & (score > limit)].min()) / 2


def test_quality_threshold_is_exact(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.random(9000), np.repeat(rng.random(30), 100), 0.5 + 1e-13 * rng.random(3000)])
    frame = spark.createDataFrame([(float(x),) for x in values], "score double").repartition(3)
    for rank in (0, 1, 7000, 9321, len(values) - 1):
        assert quality.value_at(frame, "score", rank) == np.sort(values)[rank]


def brute_backoff(rows, order):
    """log_score, n_backoff, n_words of each row under the counts of the other rows."""
    of = lambda text: [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in WORD.findall(text or "")]
    grams = lambda w: collections.Counter(tuple(w[k : k + n]) for n in range(1, order + 1) for k in range(len(w) - n + 1))
    total, words = collections.Counter(), sum(len(of(t)) for _, t in rows)
    for _, t in rows:
        total.update(grams(of(t)))
    out = {}
    for i, t in rows:
        w = of(t)
        own, score, backed = grams(w), 0.0, 0
        count = lambda g: total[g] - own[g]  # noqa: E731,B023
        for k in range(len(w)):
            n, scale = min(order, k + 1), 1.0
            if n == order and not count(tuple(w[k - n + 1 : k + 1])):
                backed += 1
            while n > 1 and not count(tuple(w[k - n + 1 : k + 1])):
                n, scale = n - 1, scale * 0.4
            g = tuple(w[k - n + 1 : k + 1])
            s = count(g) / count(g[:-1]) if n > 1 else max(count(g), 1) / max(words - len(w), 1)
            score += math.log10(scale * s)
        out[i] = score, backed, len(w)
    return out


def test_keys_packed_and_back():
    rng = np.random.default_rng(2)
    for keys in ([], [0], [7], [1, 2, 3], [0, 2**64 - 1], [5, 2**63, 2**64 - 1], rng.integers(0, 2**64, 5000, np.uint64), rng.integers(2**62, 2**62 + 9000, 3000, np.uint64)):
        keys = np.unique(np.array(keys, np.uint64))
        assert packed.unplanes(packed.planes(keys)).tolist() == keys.tolist()


def test_backoff(docs):
    rows = rows_of(docs)
    want, got = brute_backoff(rows, 3), by_id(lm_scoring.query(docs))
    assert got.keys() == want.keys()
    for i, (score, backed, words) in want.items():
        assert got[i]["log_score"] == pytest.approx(score, abs=1e-6, rel=1e-9)
        assert (got[i]["n_backoff"], got[i]["n_words"]) == (backed, words)
        assert (got[i]["perplexity"] is None) if not words else got[i]["perplexity"] == pytest.approx(10 ** (-score / words))


def test_backoff_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c e"), (4, "a b c d"), (4, "x y")], "doc_id long, text string")
    got = sorted((r["n_words"], r["n_backoff"]) for r in lm_scoring.query(docs).collect())
    assert got == [(2, 0), (4, 0), (4, 0), (4, 1)]


def brute_lines(rows):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(strip))
    held = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())
    return out


def test_line_dedup(docs):
    got = by_id(line_dedup.query(docs))
    assert {i: tuple(r[c] for c in ("n_lines", "n_dropped", "kept_sha256")) for i, r in got.items()} == brute_lines(rows_of(docs))


def test_line_dedup_passes_other_columns(odd):
    got = line_dedup.dedup_lines(odd)
    assert got.columns == [*odd.columns, "n_lines", "n_dropped"]
    one = by_id(got)[10]
    assert (one["text"], one["source"], one["batch_no"]) == ("", None, "x")
    assert by_id(got)[1]["text"] is None


def test_line_dedup_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a line of words"), (1, "a line of words"), (None, "a line of words"), (None, "only null rows here")], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["text"]) for r in line_dedup.dedup_lines(df).collect())
    assert got == [(False, "a line of words"), (False, "a line of words"), (True, ""), (True, "only null rows here")]


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 63, 5000, dtype=np.uint64))
    table = line_dedup.PerfectHash.unpacked(line_dedup.PerfectHash.of(keys).packed())
    assert sorted(table.index(keys).tolist()) == list(range(len(keys)))


def test_packing(docs):
    got, words = packing.query(docs).collect(), {i: len(WORD.findall(t or "")) for i, t in rows_of(docs)}
    of, used = collections.Counter(), collections.defaultdict(list)
    for r in got:
        of[r["doc_id"]] += r["length"]
        if r["length"]:
            used[r["bin_id"], r["bin_size"]].append((r["bin_offset"], r["length"]))
        else:
            assert r["bin_id"] is None
    assert {i: of[i] for i in words} == words
    for (_, size), pieces in used.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size and (size == packing.SIZES[0] or at > packing.SIZES[packing.SIZES.index(size) - 1])


def brute_pack(lengths, sizes):
    """Bins as lists of piece numbers, and their sizes: each step by plain search over all bins and all pieces still to come."""
    order = sorted(range(len(lengths)), key=lambda k: (-lengths[k], k))
    bins, rooms, opened = [], [], []
    for at, k in enumerate(order):
        n = lengths[k]
        fits = [r for r in rooms if r >= n]
        if fits:
            # of the bins of least room, the one opened or filled to it last
            own = max((b for b in range(len(bins)) if rooms[b] == min(fits)), key=lambda b: opened[b])
        else:
            prices = []
            for s in sizes:
                if s >= n:
                    held, rest = n, [lengths[j] for j in order[at + 1 :]]
                    for x in rest:  # descending: the longest that still fits goes in
                        if held + x <= s:
                            held += x
                    prices.append((packing.cost_of(s) / held, s))
            own = len(bins)
            bins.append([]), rooms.append(min(prices)[1]), opened.append(0)
        bins[own].append(k)
        rooms[own] -= n
        opened[own] = at + 1
    return bins, [min(s for s in sizes if s >= sum(lengths[k] for k in own)) for own in bins]


@pytest.mark.parametrize("kind", ["uniform", "short", "same", "skewed"])
def test_packing_equals_brute_force(kind):
    rng = np.random.default_rng(7)
    lengths = {"uniform": rng.integers(1, 4097, 150), "short": rng.integers(1, 300, 200), "same": np.full(60, 600), "skewed": np.clip(rng.lognormal(6, 1.2, 200), 1, 4096).astype(int)}[kind]
    bins, _, final = packing.pack(lengths)
    want, sizes = brute_pack(lengths.tolist(), packing.SIZES)
    assert [np.flatnonzero(bins == b).tolist() for b in range(len(final))] == [sorted(x) for x in want]
    assert final.tolist() == sizes


@pytest.mark.parametrize("kind", ["skewed", "same", "short"])
def test_packing_mixes_sizes_below_the_cost_of_any_one(kind):
    rng = np.random.default_rng(9)
    lengths = {"skewed": np.clip(rng.lognormal(5.8, 1.1, 4000), 1, 4096).astype(int), "same": np.concatenate([np.full(900, 600), np.full(300, 1500)]), "short": rng.integers(100, 900, 4000)}[kind]
    cost = lambda final: sum(packing.cost_of(int(s)) for s in final)
    joint = packing.pack(lengths)[2]
    alone = [cost(packing.pack(lengths, (s,))[2]) for s in packing.SIZES if s >= lengths.max()]
    assert len(set(joint.tolist())) > 1 or kind == "same"
    assert cost(joint) < min(alone)


def test_packing_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "c"), (3, "x"), (3, "x")], "doc_id long, text string")
    got = packing.query(docs).collect()
    assert sorted(r["length"] for r in got) == [1, 1, 1, 2] and len({(r["bin_id"], r["bin_offset"]) for r in got}) == 4


def test_packing_fills_bins():
    lengths = np.random.default_rng(4).integers(1, 4097, 3000)
    bins, _, final = packing.pack(lengths)
    assert lengths.sum() / final.sum() > 0.97


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        open_w = sum(w[s] for s in names if s not in capped)
        t = {s: 3.0 * sizes[s] if s in capped else rest * w[s] / open_w for s in names}
        over = {s for s in names if s not in capped and t[s] > 3 * sizes[s]}
        if not over:
            return t
        capped |= over


def test_mixing(docs):
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    text = dict(rows_of(docs))
    size = {i: len(WORD.findall(text[i] or "")) for i in text}
    sums = collections.Counter()
    for i in size:
        sums[source[i]] += size[i]
    want, taken = brute_targets(dict(sums)), collections.Counter()
    first = mixing.query(docs).collect()
    for r in first:
        i = r["doc_id"]
        assert (r["size"], r["source_size"]) == (size[i], sums[source[i]])
        assert r["target"] == pytest.approx(want[source[i]])
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[source[i]] += r["taken"]
    for s in sums:
        longest = max(size[i] for i in size if source[i] == s)
        assert abs(taken[s] - want[s]) <= longest
    assert sorted(map(tuple, first)) == sorted(map(tuple, mixing.query(docs.repartition(5)).collect()))


def test_mixture_repeats_rows(odd):
    got = mixing.mixture(odd)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixed_copies(odd).collect()}
    assert got.columns == odd.columns
    assert collections.Counter(r["doc_id"] for r in got.collect()) == collections.Counter({i: c for i, c in copies.items() if c})


def test_token_store(docs):
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(tokenizer_path()), 0
    got = by_id(token_store.query(docs, tokenizer_path()))
    rows = rows_of(docs)
    for (i, _), e in zip(rows, tokenizer.encode_batch([t or "" for _, t in rows], add_special_tokens=False), strict=True):
        ids = np.array([*e.ids, 1], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.05, rng.integers(0, 2**32, n), rng.integers(100, 300, n)).astype(np.uint32)
    s = token_store.Segment(token_store.encode(ids, np.array([7]), np.array([0])))
    assert np.array_equal(s.ids(), ids)
    if n > 200:
        assert np.array_equal(s.ids(100, 257), ids[100:257])


def test_token_runs_join_to_whole_texts():
    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_file(tokenizer_path()), token_store.Encoder(tokenizer_path())
    texts = ["It's  I'LL <|endoftext|> x<|startoftext|>y", "Ａ́ é z q", "İSTANBUL ΣΑΣ ß", "'s 't", "\x1c a \x85 b", ""]
    want = [[*e.ids, 1] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode([t.encode() for t in texts])] == want


def test_sharding(docs):
    got, text = sharding.query(docs).collect(), dict(rows_of(docs))
    total = sum(r["size"] for r in got)
    by, most = collections.defaultdict(list), max(r["size"] for r in got)
    for r in got:
        data = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        by[r["shard"]].append(r)
    assert len(got) == len(text)
    for shard, rows in by.items():
        assert 0 <= shard < 24 and sorted(r["slot"] for r in rows) == list(range(len(rows)))
        assert sum(r["size"] for r in rows) <= total / 24 * 1.02 + most


def test_sharding_small_and_repeated(spark):
    """A few rows, null and repeated ids, several groups that hold splitters: few jobs, gapless slots."""
    rows = [(k if k % 5 else None, f"group {k % 3} " * 30) for k in range(47)] + [(3, None), (3, None), (3, "")]
    got = sharding.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    size = collections.Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    keys = collections.Counter()  # equal texts under one id or null stay together
    for i, t in rows:
        keys[i, t] += len((t or "").encode()) + 8
    assert max(size.values()) <= sum(size.values()) / 24 + max(keys.values())


def test_sharding_splits_a_large_group_alone(spark):
    df = spark.createDataFrame([(k, "hot text " * 20 if k % 3 == 0 else f"text {k} " * 20) for k in range(6000)], "doc_id long, text string")
    got = sharding.query(df).collect()
    size = collections.Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    assert max(size.values()) < 1.03 * sum(size.values()) / 24
    assert min(size.values()) > 0.97 * sum(size.values()) / 24


def test_language(small, odd):
    got = by_id(language_id.query(small))
    lang = {r["doc_id"]: r["lang"] for r in small.collect()}
    held = [i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in set(held)) for i in lang)
    assert np.mean([got[i]["lang_pred"] == lang[i] for i in held]) > 0.95
    for r in language_id.query(odd).collect():
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (1, 2, 3, 11):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)


def test_codewords_differ():
    for k in (2, 4, 5, 12, 40):
        code = language_id.codewords(k)
        assert len(np.unique(code, axis=0)) == k


@pytest.mark.parametrize("run", [fingerprints.query, simhash.query, lm_scoring.query, line_dedup.query, packing.query, mixing.query, lambda d: token_store.query(d, tokenizer_path()), sharding.query, language_id.query])
def test_empty_table(empty, run):
    assert run(empty).count() == 0


def test_empty_quality(spark, empty):
    assert quality.query(empty, spark.read.parquet("/root/testdata/sf0.001/labels.parquet")).count() == 0
