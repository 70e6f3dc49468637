"""Closed-set verdicts that arrive from outside: recovery, validation, defaults."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corrobora import schemas
from corrobora.functions import exprs as X, vocab as V
from corrobora.functions.text import find_all, once, words4
from corrobora.session import ship


def payload_json(c: Column) -> Column:
    """Outermost braces of a reply that may be fenced or wrapped in prose."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)\{.*\}", 0)


def validate_ledger(df: DataFrame) -> DataFrame:
    """Claim-ledger rows from raw payloads: unknown labels defaulted, settled verdicts force the lean."""
    p = df.withColumn("_p", F.from_json(payload_json(F.col("payload")), schemas.LEDGER_PAYLOAD))
    p = p.filter(F.trim("_p.claim") != "")
    verdict = X.within(F.col("_p.verdict"), V.LEDGER_VERDICTS, "unproven")
    lean = X.within(F.col("_p.lean"), V.LEDGER_LEANS, "balanced")
    size = X.within(F.col("_p.magnitude"), V.LEDGER_MAGNITUDES, "slight")
    return (p.withColumn("claim", F.trim("_p.claim")).withColumn("verdict", verdict)
            .withColumn("lean", F.when(F.col("verdict") == "verified", "toward")
                        .when(F.col("verdict") == "debunked", "away").otherwise(lean))
            .withColumn("magnitude", F.when(F.col("verdict").isin("verified", "debunked"), "strong").otherwise(size))
            .withColumn("why", F.trim(F.coalesce("_p.why", F.lit("")))).drop("_p", "payload"))


def response_ok() -> Column:
    return F.col("error").isNull() & (F.trim(F.coalesce("raw_text", F.lit(""))) != "")


def response_summary(df: DataFrame) -> DataFrame:
    ok = response_ok()
    return df.groupBy("source_label").agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"),
                                          F.count_if(~ok).alias("failed"))


def rule_relation(a: Column, b: Column) -> Column:
    """Shipped default: token overlap, with differing numbers ruling out agreement."""
    tx, ty = words4(a), words4(b)
    share = F.size(F.array_intersect(tx, ty)) / F.greatest(F.lit(1), F.least(F.size(tx), F.size(ty)))
    numbers = lambda c: F.array_sort(F.array_distinct(find_all(c, r"\d+")))
    differ = numbers(a) != numbers(b)
    return once(share, lambda s: F.when((s >= 0.6) & differ, "contradicts").when(s >= 0.9, "same").when(s >= 0.6, "collaborative").otherwise("distinct"))


def with_verdicts(pairs: DataFrame, fn: Callable[[pd.Series, pd.Series], pd.Series] | None = None,
                  a: str = "text_a", b: str = "text_b", labels=V.RELATIONS, default: str = "distinct",
                  out: str = "relation") -> DataFrame:
    """Run a batch judge over candidate pairs and validate what it answers; without one, the native rule decides.

    Filter and de-duplicate candidates natively before this step: it is the expensive one.
    """
    if fn is None:
        return pairs.withColumn(out, X.within(rule_relation(F.col(a), F.col(b)), labels, default))
    schema = T.StructType([*pairs.schema.fields, T.StructField("_label", T.StringType())])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(_label=fn(pdf[a], pdf[b]).values)
    ship(pairs.sparkSession)
    judged = pairs.mapInPandas(judge, schema)
    return judged.withColumn(out, X.within(F.col("_label"), labels, default)).drop("_label")
