"""Severity estimates: target rows, provenance, and agreement with given grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .enrich import is_dependency

#: Rank of a tier in comparisons; anything else is 0, as is not-eligible.
TIER_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def tier_rank(value: Column) -> Column:
    out = F.lit(0)
    for name, rank in TIER_RANK.items():
        out = F.when(F.lower(value) == name, rank).otherwise(out)
    return out


def is_graded(severity: Column) -> Column:
    return F.coalesce(F.lower(severity).isin(*fixed.RATED), F.lit(False))


def targets(findings: DataFrame, mode: str, platforms: tuple[str, ...] = tuple(fixed.PLATFORM_ALIASES)) -> DataFrame:
    """Rows to estimate. ``validate``: graded ones; ``apply``: ungraded ones of known platforms. Dependencies are in neither."""
    graded = is_graded(F.col("severity"))
    own = ~is_dependency(F.col("title"), F.col("source_url"))
    if mode == "validate":
        return findings.where(own & graded)
    if mode == "apply":
        return findings.where(own & ~graded & F.col("source_platform").isin(*platforms))
    raise ValueError(mode)


def provenance(findings: DataFrame, estimates: DataFrame) -> DataFrame:
    """(id, severity_estimated, severity_source) of every finding.

    Graded rows keep their grade (bounty-graded), dependencies theirs or not-eligible
    (upstream-cvss), others take their estimate (llm-estimated) or are unassessed. Estimates have
    (id, estimate), one row an id.
    """
    rows = findings.select("id", "severity", is_graded(F.col("severity")).alias("graded"), is_dependency(F.col("title"), F.col("source_url")).alias("dependency"))
    rows = rows.join(estimates.select("id", "estimate"), "id", "left")
    told = F.coalesce("estimate", F.lit("")) != ""
    source = (
        F.when(F.col("dependency"), "upstream-cvss").when(F.col("graded"), "bounty-graded").when(told, "llm-estimated").otherwise("unassessed")
    )
    value = F.when(F.col("graded"), F.col("severity")).when(F.col("dependency"), "not-eligible").when(told, F.col("estimate")).otherwise("")
    return rows.select("id", value.alias("severity_estimated"), source.alias("severity_source"))


def agreement(pairs: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """One row: pairs, exact agreements, those within one tier, and predicted not-eligible. Blank and error predictions are skipped."""
    rows = _compared(pairs, truth, predicted)
    a, b = tier_rank(F.col("truth")), tier_rank(F.col("predicted"))
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(a == b).alias("exact"),
        F.count_if(F.abs(a - b) <= 1).alias("near"),
        F.count_if(F.col("predicted") == "not-eligible").alias("not_eligible"),
    )


def confusion_pairs(pairs: DataFrame, truth: str = "truth", predicted: str = "predicted", most: int = 12) -> DataFrame:
    """(truth, predicted, n): the most frequent pairs, ties by name."""
    rows = _compared(pairs, truth, predicted).groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.desc("n"), "truth", "predicted").limit(most)


def _compared(pairs: DataFrame, truth: str, predicted: str) -> DataFrame:
    rows = pairs.select(F.lower(truth).alias("truth"), F.lower(predicted).alias("predicted"))
    return rows.where("truth is not null and predicted is not null and predicted not in ('', 'error')")
