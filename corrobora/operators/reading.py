"""The one place where claims are read for writing: nothing is cut, every rule of honesty is applied."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corrobora.functions.exprs import standard_label
from corrobora.operators.links import override_tier
from corrobora.operators.people import demote_spoken, mentions, normalize_names, resolve_entities
from corrobora.sources.tables import all_findings


def gather(findings: DataFrame, truth: DataFrame, excluded: DataFrame | None = None, branch: str | None = None,
           resolved: DataFrame | None = None) -> DataFrame:
    """(finding_id, label, claim, source_types, urls, corroboration): every finding under its public label.

    In this order: gaps and blank claims go, excluded ids go, the stored tier wins over the one carried, tiers become labels,
    claims are trimmed, urls lose blanks and placeholders, names take their canonical spelling (``resolved``; without it,
    resolved from these findings), and what is known from speech alone leaves the supported and contested labels. A null count
    or zero counts as one. ``finding_id`` is unique; an id excluded twice or unknown changes nothing.
    """
    rows = all_findings(findings if branch is None else findings.filter(F.col("branch_id") == branch))
    if excluded is not None:
        rows = rows.join(excluded.select("finding_id").distinct(), "finding_id", "left_anti")
    rows = override_tier(rows, truth).select(
        "finding_id", F.trim("claim").alias("claim"), "source_types", standard_label(F.col("confidence_tier")).alias("label"),
        F.filter(F.coalesce("urls", F.array().cast("array<string>")), lambda u: (u != "") & (u != "_")).alias("urls"),
        F.coalesce(F.nullif(F.col("corroboration_count"), F.lit(0)), F.lit(1)).cast("double").alias("corroboration"))
    names = resolve_entities(mentions(rows)) if resolved is None else resolved
    return demote_spoken(normalize_names(rows, names)).select("finding_id", "label", "claim", "source_types", "urls", "corroboration")
