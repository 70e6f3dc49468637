"""Positions inside groups of any size."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from corrobora.session import cut


def range_chunks(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows range-partitioned by ``keys`` with their chunk number, frozen so the chunks cannot change."""
    parts = df.repartitionByRange(*[F.col(k) for k in keys]).withColumn("_chunk", F.spark_partition_id())
    return cut(parts)


def row_numbers(df: DataFrame, by: list[str], order: list[str], out: str) -> DataFrame:
    """``row_number`` per group without bringing a group into one task.

    A group spans as many range chunks as it needs: rows are numbered inside a chunk and shifted by the
    group's row count in the chunks before it (one small row per group and chunk).
    """
    chunks = range_chunks(df, [*by, *order])
    before = W.partitionBy(*by).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    shift = chunks.groupBy(*by, "_chunk").agg(F.count("*").alias("_n")).withColumn(
        "_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = F.row_number().over(W.partitionBy(*by, "_chunk").orderBy(*order))
    return chunks.withColumn("_local", local).join(shift, [*by, "_chunk"]).withColumn(
        out, F.col("_local") + F.col("_shift")).drop("_chunk", "_local", "_shift")


def running_sum(df: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Prefix sum per group in ``order`` (which must be total), chunked like ``row_numbers``."""
    chunks = range_chunks(df, [*by, *order])
    before = W.partitionBy(*by).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    shift = chunks.groupBy(*by, "_chunk").agg(F.sum(value).alias("_s")).withColumn(
        "_shift", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    local = F.sum(value).over(W.partitionBy(*by, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return chunks.withColumn("_local", local).join(shift, [*by, "_chunk"]).withColumn(
        out, F.col("_local") + F.col("_shift")).drop("_chunk", "_local", "_shift")


def previous(df: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``lag(value)`` per group in ``order``, chunked: a chunk's first row takes the last value before it."""
    chunks = range_chunks(df, [*by, *order])
    ends = chunks.groupBy(*by, "_chunk").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    carry = ends.withColumn("_carry", F.lag("_last").over(W.partitionBy(*by).orderBy("_chunk"))).drop("_last")
    w = W.partitionBy(*by, "_chunk").orderBy(*order)
    rows = chunks.withColumn("_first", F.row_number().over(w) == 1).withColumn("_lag", F.lag(value).over(w))
    return rows.join(carry, [*by, "_chunk"]).withColumn(
        out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag"))).drop("_chunk", "_first", "_lag", "_carry")
