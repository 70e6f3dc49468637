"""Session helpers: shared scratch space and lineage cuts.

Lineage is cut only with reliable checkpoints or written tables, so a lost executor never loses an
iterative job. Both live in the folder the cluster names in ``spark.checkpoint.dir``.
"""
from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach. A machine-local one is used only for a local master."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="corrobora-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application: their Python workers import it from there."""
    sc, here = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(sc, "_corrobora_shipped", False):
        return
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    folder = Path(tempfile.mkdtemp(prefix="corrobora-ship-"))
    (folder / "corrobora.zip").write_bytes(held.getvalue())
    sc.addPyFile(str(folder / "corrobora.zip"))
    sc._corrobora_shipped = True


def one_row(df: DataFrame) -> Column:
    """A single-row aggregate as a scalar subquery, read by field: no join of any kind."""
    return df.select(F.struct(*df.columns)).scalar()


BROADCAST_ROWS = 500_000


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow join side: broadcast once its counted rows are few, otherwise left to a shuffle join."""
    kept = cut(df)
    if kept.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(kept)
    return kept.hint("shuffle_hash")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly to several tasks a core, for work that is heavy beside what a row weighs: a table may be one file
    of one row group, which no reader can share out."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


TASK_ROWS = 1_000_000


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """Rows brought together by key in as many tasks as ``TASK_ROWS`` asks for, so that what a task holds doesn't grow with the
    table. ``rows`` is their number, if known; steps by the same keys follow without another exchange."""
    sc = df.sparkSession.sparkContext
    rows = df.count() if rows is None else rows
    return df.repartition(max(sc.defaultParallelism, -(-rows // TASK_ROWS)), *keys)


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint: truncates the plan and survives executor loss."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(f"{shared_dir(df.sparkSession)}/lineage")
    return df.checkpoint(eager=eager)
