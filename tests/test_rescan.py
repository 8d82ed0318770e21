"""A folder's state under lost, late and repeated notices ends as a plain comparison says."""

import random

import pytest

from tessera.sources import manifest
from tessera.streaming import rescan

KINDS = "path string, kind string"


def listed(spark, files):
    return spark.createDataFrame(list(files.items()), rescan.LISTED)


def known(spark, folder):
    return {r["path"]: r["hash"] for r in rescan.state(spark, folder).collect()}


def test_notices_and_comparisons_converge(spark, tmp_path):
    rng, folder = random.Random(2), str(tmp_path / "f")
    files = {f"/a/{k}": f"h{k}" for k in range(30)}
    want = {}
    for number in range(9):
        moved = []
        for _ in range(6):
            path = f"/a/{rng.randrange(40)}"
            files.pop(path) if path in files and rng.random() < 0.4 else files.update({path: f"h{rng.random()}"})
            moved.append(path)
        told = [(p, "changed") for p in moved if rng.random() < 0.5] * 2 + [(None, "changed"), ("/never", "removed")]  # half of them lost, the others twice
        if number == 5:
            told.append((None, "overflow"))
        whole = number in (0, 5, 7)
        said = rescan.apply_batch(spark, folder, listed(spark, files), spark.createDataFrame(told, KINDS), number, 100.0 * number, 200.0 if number == 7 else 1e9)
        paths = set(want) | set(files) if whole else {p for p, _ in told}
        want = {p: h for p, h in {**{p: h for p, h in want.items() if p not in paths}, **{p: h for p, h in files.items() if p in paths}}.items()}
        assert known(spark, folder) == want, number
        assert (len(said["tables"]) == 1) == whole
    assert want != files
    rescan.apply_batch(spark, folder, listed(spark, files), None, 9, 900.0, 0.0)
    assert known(spark, folder) == files
    assert {r["found"] for r in rescan.log(spark, folder).collect()} == {"notice", "rescan"}


def test_a_batch_counts_once_and_a_cut_short_one_not_at_all(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "f")
    rescan.apply_batch(spark, folder, listed(spark, {"a": "1", "b": "1"}), None, 0, 0.0, 0.0)
    told, later = spark.createDataFrame([("a", "changed"), ("c", "new")], KINDS), {"a": "2", "c": "1"}
    with monkeypatch.context() as m:
        m.setattr(manifest, "save", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            rescan.apply_batch(spark, folder, listed(spark, later), told, 1, 1.0, 0.0)
    assert known(spark, folder) == {"a": "1", "b": "1"}
    for _ in range(2):
        rescan.apply_batch(spark, folder, listed(spark, later), told, 1, 1.0, 0.0)
        assert known(spark, folder) == {"a": "2", "b": "1", "c": "1"}
    assert rescan.log(spark, folder).where("turn = 1").count() == 2
    assert rescan.log(spark, folder).where("turn > 1").count() == 0


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    src, folder, files = str(tmp_path / "src"), str(tmp_path / "f"), {"a": "1"}
    put = lambda rows: spark.createDataFrame(rows, KINDS).coalesce(1).write.mode("append").parquet(src)
    stream = lambda: spark.readStream.schema(KINDS).parquet(src)
    run = lambda now: rescan.follow(stream(), lambda: listed(spark, files), folder, str(tmp_path / "c"), lambda: now, 600.0)
    put([("a", "new")])
    run(0.0)
    assert known(spark, folder) == {"a": "1"}
    files.update(b="1", c="1")
    put([("b", "new")])  # the notice of c is lost
    run(60.0)
    assert known(spark, folder) == {"a": "1", "b": "1"}
    run(5000.0)  # nothing new: no batch, and none that compares
    assert known(spark, folder) == {"a": "1", "b": "1"}
    put([("a", "changed")])  # a late one, and the comparison is due
    run(5000.0)
    assert known(spark, folder) == files


def test_empty_listings(spark, tmp_path):
    folder = str(tmp_path / "f")
    assert known(spark, folder) == {} and rescan.log(spark, folder).count() == 0
    rescan.apply_batch(spark, folder, spark.createDataFrame([], rescan.LISTED), None, 0, 0.0, 0.0)
    assert known(spark, folder) == {}
    rows = [("a", None), ("a", "1"), (None, "1"), ("a", "1")]
    rescan.apply_batch(spark, folder, spark.createDataFrame(rows, rescan.LISTED), None, 1, 1.0, 0.0)
    assert known(spark, folder) == {"a": "1"}
