"""Tables that change by small segments, so that a change writes bytes in proportion to itself.

A table is a folder of Parquet segments and a log of commits.  A commit may add rows, and may say that all earlier rows of some
keys are gone (a tombstone: the key and the commit's number).  Reading is the union of the segments without rows that
a later tombstone names.  Segments of like size are merged four at a time, rows keeping their numbers, and tombstones go when
no segment holds rows that they still have to hide; so there are about log(n) segments, and a row is written again log(n)
times at most.

A commit is one file, written aside and renamed, so a reader sees a commit or not at all, and what a broken-off writer left is never
read.  There is one writer at a time; a second one that commits the same number is an error.  Files that a merge has
replaced stay for KEEP further commits, for readers that began before.

Null keys are never hidden.  Rows of one key may be many (postings of a chunk).  An empty table has no segments.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIER = 4  # segments of one size class that are merged, and the ratio of the classes
SMALLEST = 64 << 10  # bytes: all below are one class
KEEP = 6


class Segments:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, order: tuple[str, ...] = ()):
        """``order``: columns by which segments are range-partitioned and sorted."""
        self.spark, self.path, self.schema, self.key, self.order = spark, path.rstrip("/"), f"{schema}, _seq long", key, order
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    # ---------------------------------------------------------- log of commits
    def _at(self, name: str) -> tuple:
        at = self._hadoop.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at, system = self._at("commits/*.json")
        return sorted(int(s.getPath().getName()[:-5]) for s in system.globStatus(at) or [])

    def state(self, version: int | None = None) -> dict:
        """The table as of a commit (the last): segments, tombstones, and what is to be deleted later."""
        found = self.versions()
        if not found:
            return {"version": 0, "segments": [], "gone": [], "retired": []}
        text = self.spark.read.text(f"{self.path}/commits/{version or found[-1]:020d}.json", wholetext=True).first().value
        return json.loads(text)

    def _commit(self, state: dict) -> None:
        version = state["version"] = state["version"] + 1
        late = [p for v, p in state["retired"] if v + KEEP <= version]
        state["retired"] = [[v, p] for v, p in state["retired"] if v + KEEP > version]
        aside, system = self._at(f"commits/.{uuid.uuid4().hex}")
        out = system.create(aside)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        final = self._at(f"commits/{version:020d}.json")[0]
        if system.exists(final) or not system.rename(aside, final):
            system.delete(aside, False)
            raise RuntimeError(f"{self.path} was changed by another writer (commit {version})")
        for p in late:
            system.delete(self._hadoop.Path(f"{self.path}/{p}"), True)
        for v in self.versions()[:-KEEP]:
            system.delete(self._at(f"commits/{v:020d}.json")[0], False)

    def bytes_of(self, name: str) -> int:
        at, system = self._at(name)
        return system.getContentSummary(at).getLength()

    # ------------------------------------------------------------------ rows
    def _written(self, rows: DataFrame) -> dict | None:
        """A segment of ``rows`` (with ``_seq``); None, and nothing left, without rows."""
        name = f"segment-{uuid.uuid4().hex}"
        if self.order:
            rows = rows.repartitionByRange(*self.order).sortWithinPartitions(*self.order)
        rows.write.parquet(f"{self.path}/{name}")
        if self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}").isEmpty():
            at, system = self._at(name)
            system.delete(at, True)
            return None
        return {"path": name, "bytes": self.bytes_of(name)}

    def _raw(self, segments: list[dict], gone: list[dict]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{s['path']}" for s in segments])
        if not gone:
            return rows
        dead = self.spark.read.parquet(*[f"{self.path}/{g['path']}" for g in gone]).groupBy("_key").agg(F.max("_gone").alias("_gone"))
        return rows.join(dead, (F.col(self.key) == F.col("_key")) & (F.col("_seq") < F.col("_gone")), "left_anti")

    def read(self, version: int | None = None) -> DataFrame:
        state = self.state(version)
        return self._raw(state["segments"], state["gone"]).drop("_seq")

    def add(self, rows: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """One commit: earlier rows whose key is in ``gone`` (a column named as the key) go, then ``rows`` are there."""
        state = self.state()
        seq = state["version"] + 1
        segments, dead = list(state["segments"]), list(state["gone"])
        if gone is not None and segments:
            name = f"gone-{uuid.uuid4().hex}"
            keys = gone.select(F.col(self.key).alias("_key")).filter("_key is not null").distinct().withColumn("_gone", F.lit(seq).cast("long"))
            keys.coalesce(max(1, self.spark.sparkContext.defaultParallelism)).write.parquet(f"{self.path}/{name}")
            if self.spark.read.parquet(f"{self.path}/{name}").isEmpty():
                at, system = self._at(name)
                system.delete(at, True)
            else:
                dead.append({"path": name, "seq": seq})
        made = self._written(rows.withColumn("_seq", F.lit(seq).cast("long"))) if rows is not None else None
        if made:
            segments.append(made | {"clean": seq})
        self._commit(state | {"segments": segments, "gone": dead})
        self._merge()

    def replace(self, rows: DataFrame) -> None:
        """One commit: the table is ``rows`` and nothing else."""
        state = self.state()
        seq = state["version"] + 1
        made = self._written(rows.withColumn("_seq", F.lit(seq).cast("long")))
        old = [[seq, x["path"]] for x in state["segments"] + state["gone"]]
        self._commit(state | {"segments": [made | {"clean": seq}] if made else [], "gone": [], "retired": state["retired"] + old})

    def _merge(self) -> None:
        """Merge size classes that are full, smallest first, and tombstones when there are many; a commit for each."""
        while True:
            state = self.state()
            classes: dict[int, list[dict]] = {}
            for s in state["segments"]:
                classes.setdefault(max(0, math.ceil(math.log(max(s["bytes"], 1) / SMALLEST, TIER))), []).append(s)
            full = next((classes[c] for c in sorted(classes) if len(classes[c]) >= TIER), None)
            if full is None:
                break
            made = self._written(self._raw(full, state["gone"]))
            rest = [s for s in state["segments"] if s not in full]
            segments = rest + ([made | {"clean": state["version"]}] if made else [])
            needed = [g for g in state["gone"] if any(s["clean"] < g["seq"] for s in segments)]
            retired = [[state["version"] + 1, x["path"]] for x in [*full, *(g for g in state["gone"] if g not in needed)]]
            self._commit(state | {"segments": segments, "gone": needed, "retired": state["retired"] + retired})
        if len(state["gone"]) >= 2 * TIER:
            name = f"gone-{uuid.uuid4().hex}"
            dead = self.spark.read.parquet(*[f"{self.path}/{g['path']}" for g in state["gone"]]).groupBy("_key").agg(F.max("_gone").alias("_gone"))
            dead.write.parquet(f"{self.path}/{name}")
            retired = [[state["version"] + 1, g["path"]] for g in state["gone"]]
            self._commit(state | {"gone": [{"path": name, "seq": max(g["seq"] for g in state["gone"])}], "retired": state["retired"] + retired})
