"""Profiles of the curated table: coverage, histograms, channels and impact classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import lookup


def covered() -> dict[str, Column]:
    """Whether a row has each of the profiled columns; ``rated`` stands for the severity."""

    def other_than(name: str, *values: str) -> Column:
        return ~F.coalesce(F.col(name).cast("string"), F.lit(values[0])).isin(*values)

    return {
        "source_url": F.col("source_url").isNotNull(),
        "label": other_than("label", "other"),
        "fix_commit": F.length(F.coalesce("fix_commit", F.lit(""))) > 0,
        "root_cause": other_than("root_cause", "other"),
        "post_fix_code": other_than("post_fix_code", "[]"),
        "cwe_top25": other_than("cwe_top25", "N/A"),
        "silent_fix_prob": F.col("silent_fix_prob").isNotNull(),
        "rated": F.coalesce(F.lower("severity").isin(*fixed.RATED), F.lit(False)),
    }


def coverage(findings: DataFrame) -> DataFrame:
    """One row: percent of the rows that have each column."""
    return findings.agg(*(F.round(100.0 * F.avg(has.cast("double")), 6).alias(name) for name, has in covered().items()))


def completeness(findings: DataFrame) -> DataFrame:
    """One row: whether stride stands in at least 99 % and cwe in at least 80 % of the rows; false for absent columns and no rows."""

    def share(name: str, least: float) -> Column:
        if name not in findings.columns:
            return F.lit(False)
        return F.coalesce(F.avg(F.col(name).isNotNull().cast("double")) >= least, F.lit(False))

    return findings.agg(share("stride", 0.99).alias("stride_complete"), share("cwe_top25", 0.8).alias("cwe_complete"))


def histogram(values: DataFrame, name: str, bins: tuple[int, ...] = fixed.SIZE_BINS) -> DataFrame:
    """(low, high, n) for each bin from low up to but without high, values cut to one below the last border; the last bin has both borders."""
    value = F.least(F.col(name), F.lit(bins[-1] - 1))
    place = F.lit(None).cast("int")
    for k, (low, high) in enumerate(zip(bins, bins[1:])):
        place = F.when((value >= low) & (value < high), k).otherwise(place)
    counts = values.groupBy(place.alias("k")).agg(F.count(F.lit(1)).alias("n")).where("k is not null")
    every = values.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(bins, bins[1:]))], "k int, low int, high int")
    return every.join(counts, "k", "left").select("low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def channels(findings: DataFrame) -> DataFrame:
    """(place, channel, n) of the entry channels that occur, in their defined order; paths without a channel are left out."""
    place = F.array_position(F.array(*map(F.lit, fixed.CHANNEL_ORDER)), F.col("channel")).cast("int")
    rows = findings.select(lookup(F.col("attack_path"), fixed.CHANNELS).alias("channel")).where("channel is not null")
    return rows.groupBy("channel").agg(F.count(F.lit(1)).alias("n")).select(place.alias("place"), "channel", "n")


def impact_class(area: Column) -> Column:
    return (
        F.when(area.startswith("beacon-chain") | area.isin(*fixed.VALUE_AREAS), "consensus / value")
        .when(area.isin(*fixed.AVAILABILITY_AREAS), "availability")
        .otherwise("other")
    )


def language(platform: Column) -> Column:
    """The language of a platform, null for unknown ones."""
    return lookup(platform, fixed.LANGUAGES)
