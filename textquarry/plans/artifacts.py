"""Model artifacts: weights, label map and thresholds as one version, kept by content and given to workers as a file.

A version's name is the hash of what it holds. It is written once, as a table, so any store that Spark writes to will do;
a manifest lists versions in the order in which they were kept. The driver puts a version's file into Spark's files, and
each worker process reads it once, however many tasks it runs.

Defined cases: keeping what is kept already writes nothing but a line in the manifest; a label map must number its labels
from 0 without gaps, and thresholds, where there are any, must be of its labels and within 0 and 1; a version whose content
does not give its name is refused.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import tempfile
from collections.abc import Callable
from datetime import UTC, datetime
from typing import Any, NamedTuple

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Bytes of a row that holds a part of a version.
PART = 1 << 20


class Artifact(NamedTuple):
    """``labels`` in the order of their numbers, a threshold for some of them, arrays of weights, and settings that JSON can hold."""

    name: str
    labels: tuple[str, ...]
    thresholds: dict[str, float]
    arrays: dict[str, np.ndarray]
    settings: dict[str, Any]

    def to_bytes(self) -> bytes:
        """The same bytes for the same content."""
        head = {"name": self.name, "label2id": {x: k for k, x in enumerate(self.labels)}, "thresholds": self.thresholds, "settings": self.settings}
        out = io.BytesIO()
        text = json.dumps(head, sort_keys=True, ensure_ascii=False).encode()
        out.write(len(text).to_bytes(8, "big") + text)
        for key in sorted(self.arrays):
            np.lib.format.write_array(out, np.array([key]), allow_pickle=False)
            np.lib.format.write_array(out, np.ascontiguousarray(self.arrays[key]), allow_pickle=False)
        return out.getvalue()


def checked_labels(label2id: dict[str, int]) -> tuple[str, ...]:
    """Labels in the order of their numbers; a ValueError unless these run from 0 without gaps."""
    if sorted(label2id.values()) != list(range(len(label2id))):
        raise ValueError(f"label map must number its labels from 0 without gaps: {label2id}")
    return tuple(sorted(label2id, key=label2id.get))


def checked_thresholds(thresholds: dict[str, float], labels: tuple[str, ...]) -> dict[str, float]:
    unknown = [x for x in thresholds if x not in labels]
    if unknown or not all(0 <= t <= 1 for t in thresholds.values()):
        raise ValueError(f"thresholds must be of the labels {labels}, within 0 and 1: {thresholds}")
    return thresholds


def from_bytes(data: bytes) -> Artifact:
    source = io.BytesIO(data)
    head = json.loads(source.read(int.from_bytes(source.read(8), "big")))
    arrays = {}
    while source.tell() < len(data):
        key = str(np.lib.format.read_array(source, allow_pickle=False)[0])
        arrays[key] = np.lib.format.read_array(source, allow_pickle=False)
    labels = checked_labels(head["label2id"])
    return Artifact(head["name"], labels, checked_thresholds(head["thresholds"], labels), arrays, head["settings"])


def version_of(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()[:32]


def keep(spark: SparkSession, artifact: Artifact, store: str) -> str:
    """Writes the artifact's version, unless the store has it, and a line of the manifest; returns the version."""
    checked_thresholds(artifact.thresholds, artifact.labels)
    data = artifact.to_bytes()
    version = version_of(data)
    if version not in [v for v, _ in versions(spark, store, artifact.name)]:
        rows = [(k, bytearray(data[at : at + PART])) for k, at in enumerate(range(0, len(data), PART))]
        # A write that broke off leaves no line in the manifest, and is written over.
        spark.createDataFrame(rows, "part int, content binary").coalesce(1).write.mode("overwrite").parquet(f"{store}/{artifact.name}/{version}")
    line = [(version, datetime.now(UTC).isoformat())]
    spark.createDataFrame(line, "version string, at string").coalesce(1).write.mode("append").parquet(f"{store}/{artifact.name}/manifest")
    return version


def versions(spark: SparkSession, store: str, name: str) -> list[tuple[str, str]]:
    """(version, time of the last keeping), the last first."""
    try:
        lines = spark.read.parquet(f"{store}/{name}/manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    rows = lines.groupBy("version").agg(F.max("at").alias("at")).orderBy(F.desc("at")).collect()  # a row a version
    return [(r["version"], r["at"]) for r in rows]


def load(spark: SparkSession, store: str, name: str, version: str | None = None) -> Artifact:
    """A version, the last one kept unless it is named; a ValueError where there is none or its content is not what its name says."""
    found = [v for v, _ in versions(spark, store, name)]
    if not found or (version and version not in found):
        raise ValueError(f"no version {version or ''} of {name} in {store}")
    rows = spark.read.parquet(f"{store}/{name}/{version or found[0]}").orderBy("part").collect()
    data = b"".join(bytes(r["content"]) for r in rows)
    if version_of(data) != (version or found[0]):
        raise ValueError(f"version {version or found[0]} of {name} is damaged")
    return from_bytes(data)


class Shipped:
    """An artifact as workers see it: ``get()`` reads its file once in each process and makes the model of it."""

    _made: dict[tuple[str, str], Any] = {}

    def __init__(self, version: str, make: Callable[[Artifact], Any]):
        self.version, self.make = version, make

    def get(self) -> Any:
        key = (self.version, f"{self.make.__module__}.{self.make.__qualname__}")
        if key not in self._made:
            with open(SparkFiles.get(f"artifact-{self.version}"), "rb") as file:
                self._made[key] = self.make(from_bytes(file.read()))
        return self._made[key]


def ship(spark: SparkSession, artifact: Artifact, make: Callable[[Artifact], Any] = lambda a: a) -> Shipped:
    """Adds the artifact's file to those that Spark brings to every executor."""
    data = artifact.to_bytes()
    version = version_of(data)
    if not any(x.endswith(f"artifact-{version}") for x in spark.sparkContext.listFiles):
        path = os.path.join(tempfile.mkdtemp(prefix="textquarry-"), f"artifact-{version}")
        with open(path, "wb") as file:
            file.write(data)
        spark.sparkContext.addFile(path)
    return Shipped(version, make)
