"""Quality gates of a curated table: each check gives the number of its violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import matches

REQUIRED = (
    "id", "source_platform", "contest", "issue_id", "severity", "title", "description", "source_url", "security_score", "confidence", "n_signals", "authority_tier",
)


def any_signal() -> Column:
    """Whether a row has a signal, derived again from its text and columns; any GHSA counts as an id."""
    title, both = F.coalesce("title", F.lit("")), F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    return (
        matches(both, fixed.ITEM_ID)
        | F.lower(F.coalesce("severity", F.lit(""))).isin(*fixed.RATED)
        | (F.coalesce("security_score", F.lit(0.0)) >= 0.5)
        | ~F.coalesce("stride", F.lit("")).isin("", "nan", "Other")
        | ~F.coalesce("cwe_top25", F.lit("")).isin("", "nan", "N/A")
        | matches(title, fixed.FIX_IMPACT)
        | F.coalesce(F.expr("try_cast(silent_fix_prob AS double)") >= 0.7, F.lit(False))
    )


def violations(curated: DataFrame, raw: DataFrame, least: int = 1000, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """(check, violations): one row a check, 0 where it holds.

    Missing required columns, too few rows, boilerplate left, rows without a signal, values outside
    of their domain, ids that are not in the raw table, and a table that is not smaller than it.
    """
    lacking = [c for c in required if c not in curated.columns]
    both = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    counts = {
        "rows": F.count(F.lit(1)),
        "boilerplate_left": F.count_if(matches(both, fixed.BOILERPLATE)),
        "without_signal": F.count_if(~any_signal()),
        "bad_confidence": F.count_if(~F.coalesce("confidence", F.lit("")).isin("high", "medium", "low")),
        "bad_score": F.count_if(~F.coalesce(F.col("security_score").between(0.0, 1.0), F.lit(False))),
    }
    own = curated.agg(*(n.alias(name) for name, n in counts.items()))
    rows = [F.struct(F.lit(name).alias("check"), F.col(name).alias("violations")) for name in counts if name != "rows"]
    rows.append(F.struct(F.lit("too_few_rows").alias("check"), F.greatest(F.lit(0).cast("long"), F.lit(least) + 1 - F.col("rows")).alias("violations")))
    rows.append(F.struct(F.lit("missing_columns").alias("check"), F.lit(len(lacking)).cast("long").alias("violations")))
    checks = own.select(F.inline(F.array(*rows)))
    ids = curated.select("id", F.lit(1).alias("here")).join(raw.select("id").distinct().withColumn("known", F.lit(1)), "id", "left")
    strange = ids.agg(F.count_if(F.col("known").isNull()).alias("violations")).select(F.lit("not_in_input").alias("check"), "violations")
    sizes = curated.select(F.lit(1).alias("own")).unionByName(raw.select(F.lit(0).alias("own")))
    smaller = sizes.agg((F.sum("own") * 2 >= F.count(F.lit(1))).cast("long").alias("violations")).select(F.lit("not_smaller").alias("check"), F.coalesce("violations", F.lit(0)).alias("violations"))
    return checks.unionByName(strange).unionByName(smaller)


def require(checks: DataFrame) -> None:
    """Raise with the names of the checks that do not hold."""
    failed = {r["check"]: r["violations"] for r in checks.where("violations > 0").collect()}
    if failed:
        raise ValueError(f"quality gates failed: {failed}")


def require_rows(df: DataFrame, what: str = "rows") -> DataFrame:
    """The rows, after making sure that there are any."""
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df
