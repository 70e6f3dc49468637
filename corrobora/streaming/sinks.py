"""Sinks of streams that stay short: deltas, snapshots, and a manifest that says which snapshot is current.

A batch is one replaceable delta. From time to time the current snapshot and the deltas after it are merged into a new
snapshot, and only then does a manifest name it, written under another name and renamed. A reader takes the newest manifest,
its snapshot and the deltas beyond, so a crash at any point leaves either the old state or the new one, and a replayed batch
that a snapshot already holds is ignored. What the manifest before the newest still names is kept for readers under way.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from corrobora.streaming.ledgers import composed_segments
from corrobora.sources.tables import upsert_raw

Merge = Callable[[DataFrame], DataFrame]

EVERY = 8               # deltas before a merge is thought of
AT_MOST = 64            # deltas at which one is made in any case


class _Files:
    """The few file operations a manifest needs, on whatever store the path names."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def size(self, folder: str) -> int:
        p = self.path(folder)
        return self.fs.getContentSummary(p).getLength() if self.fs.exists(p) else 0

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def put(self, name: str, text: str) -> None:
        part = self.path(f"_{uuid.uuid4().hex}")
        out = self.fs.create(part)
        out.write(bytearray(text.encode()))
        out.close()
        target = self.path(name)
        self.fs.mkdirs(target.getParent())
        if not self.fs.rename(part, target):
            self.fs.delete(part, False)
            if not self.fs.exists(target):
                raise OSError(f"cannot write {target}")


class CompactedSink:
    """``write`` is a foreachBatch function; ``current`` is the merged state with the batch that last touched each row.

    ``merge`` takes rows with ``batch_id`` and returns the same columns; merging parts and then the whole must equal merging
    the whole. A merge is made when the deltas weigh half of the snapshot, so each row is rewritten a logarithmic number of
    times; ``at_most`` deltas are ever read.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, merge: Merge, every: int = EVERY, at_most: int = AT_MOST):
        self.spark, self.path, self.merge, self.every, self.at_most = spark, path.rstrip("/"), merge, every, at_most
        fields = [f for f in schema.fields if f.name != "batch_id"]
        self.schema = T.StructType([*fields, T.StructField("batch_id", T.LongType())])
        self.files = _Files(spark, path)

    def __getstate__(self):
        raise TypeError("a sink stays with the driver")

    def _manifests(self) -> list[int]:
        return sorted(int(n) for n in self.files.names("manifests"))

    def _deltas(self, after: int) -> list[int]:
        return sorted(b for n in self.files.names("deltas") if not n.startswith("_") and (b := int(n)) > after)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("batch_id", F.lit(batch_id).cast("long")).select(self.schema.fieldNames())
        self.merge(rows).select(self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/deltas/{batch_id}")
        self.compact()

    def _rows(self) -> tuple[DataFrame, int, list[int]]:
        upto = max(self._manifests(), default=-1)
        deltas = self._deltas(upto)
        paths = [f"{self.path}/snapshots/{upto}"] * (upto >= 0) + [f"{self.path}/deltas/{b}" for b in deltas]
        parts = [self.spark.read.schema(self.schema).parquet(p) for p in paths]
        empty = self.spark.createDataFrame([], self.schema)
        return reduce(DataFrame.unionByName, parts) if parts else empty, upto, deltas

    def current(self) -> DataFrame:
        return self.merge(self._rows()[0])

    def compact(self, force: bool = False) -> None:
        rows, upto, deltas = self._rows()
        if not deltas or not force and len(deltas) < self.every:
            return
        weight = sum(self.files.size(f"deltas/{b}") for b in deltas)
        if not force and len(deltas) < self.at_most and 2 * weight < self.files.size(f"snapshots/{upto}"):
            return
        new = deltas[-1]
        self.merge(rows).write.mode("overwrite").parquet(f"{self.path}/snapshots/{new}")
        self.files.put(f"manifests/{new}", json.dumps({"snapshot": new, "deltas": len(deltas)}))
        for old in self._manifests()[:-2]:
            self.files.delete(f"manifests/{old}")
            self.files.delete(f"snapshots/{old}")
        for b in (int(n) for n in self.files.names("deltas")):
            if b <= upto:
                self.files.delete(f"deltas/{b}")


# --- merges ----------------------------------------------------------------------------------------
def latest_by(*keys: str) -> Merge:
    """The row of each key's last batch; of several in one batch the greatest."""
    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
        top = rows.groupBy(*keys).agg(F.max(F.struct("batch_id", *rest)).alias("r"))
        return top.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest], F.col("r.batch_id").alias("batch_id"))
    return merge


def latest_raw(rows: DataFrame) -> DataFrame:
    """Latest text per url and branch, by creation time as in ``upsert_raw``."""
    top = upsert_raw(rows, rows.limit(0))
    when = rows.groupBy("url", "branch_id").agg(F.max("batch_id").alias("batch_id"))
    return top.join(when, ["url", "branch_id"])


def folded(rows: DataFrame) -> DataFrame:
    """Credibility segments of a domain composed to one, in the order of their batches."""
    return composed_segments(rows)
