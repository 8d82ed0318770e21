"""What a stored table consists of, in numbered files that are written aside and renamed.

A state is one JSON file `manifest-<number>.json` in the table's folder. It is written under another name and then renamed, and never changed: a reader takes the newest one that
it can read, so that a write cut short leaves the state before it. Files that no state names are not read.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import SparkSession

NAME = re.compile(r"manifest-(\d+)\.json$")


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies at path; nothing if there is no such folder."""
    fs, at = _folder(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def load(spark: SparkSession, path: str, fits=lambda said: True) -> dict | None:
    """The newest state that can be read and fits, with its number; None if there is none."""
    numbers = sorted((int(m[1]) for x in names(spark, path) if (m := NAME.match(x))), reverse=True)
    for n in numbers:
        try:
            said = json.loads(spark.read.text(f"{path}/manifest-{n}.json", wholetext=True).first()[0])
        except Exception:  # noqa: BLE001 - cut short, gone or no JSON: the state before it holds
            continue
        if isinstance(said, dict) and fits(said):
            return said | {"number": n}
    return None


def save(spark: SparkSession, path: str, said: dict) -> dict:
    """Make said the newest state. Another writer that was faster makes this fail, and leaves its own state."""
    fs, at = _folder(spark, path)
    fs.mkdirs(at)
    number = max((int(m[1]) for x in names(spark, path) if (m := NAME.match(x))), default=0) + 1
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/.aside-{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps({k: v for k, v in said.items() if k != "number"}).encode()))
    out.close()
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest-{number}.json")
    if fs.exists(target) or not fs.rename(aside, target):
        fs.delete(aside, False)
        raise RuntimeError(f"state {number} of {path} was written by another")
    return said | {"number": number}
