"""What the training-data operators share: reading, writing and walking texts in Arrow batches."""
from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corrobora.session import scratch_path, ship

ROWS = 2_000            # documents that are taken apart at a time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and outlives any executor."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def discard(kept: DataFrame) -> None:
    """Delete what keep() wrote, once nothing reads it any more."""
    sc = kept.sparkSession.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(kept.kept_at)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) only, a null text as the empty one; other columns, whatever they are called, go."""
    ship(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def renamed(docs: DataFrame, *own: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with names of no meaning for all columns but ``own``, and a function that gives the old names back: what a
    caller's columns are called (a dot, a name used inside) never matters."""
    names = docs.columns
    return docs.toDF(*[c if c in own else f"column{i}" for i, c in enumerate(names)]), lambda out: out.toDF(*names)


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller pieces, so that Python objects of few documents exist at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def crc_mod(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(k).cast("long"))


def crc_mod_py(doc_id, k: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % k
