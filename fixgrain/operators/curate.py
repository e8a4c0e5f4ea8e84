"""The curation gate: denoising, relevance, independent signals, confidence, tier and funnel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import matches, strip
from .dedup import keep_first, richest


#: Columns the gate reads, with their default where a table lacks them.
DEFAULTS = {
    "title": "", "description": "", "severity": "", "stride": "", "cwe_top25": "", "source_platform": "", "contest": "",
    "silent_fix_prob": None, "comment_signal": "", "linked_issue_signal": "", "backport_signal": "",
}


def completed(findings: DataFrame) -> DataFrame:
    """Findings with every column of DEFAULTS."""
    return findings.select("*", *(F.lit(value).cast("string").alias(name) for name, value in DEFAULTS.items() if name not in findings.columns))


def flagged(findings: DataFrame) -> DataFrame:
    """Findings with one boolean a pattern.

    Missing text is the empty string and a probability that is no number counts as 0. Severities,
    stride and cwe are compared as they stand, without trimming. A title that matches makes the
    whole text match, so titles and bodies are searched only where the whole text matches.
    """
    findings = completed(findings)
    title, body, severity = (F.coalesce(F.col(c), F.lit("")) for c in ("title", "description", "severity"))
    both = F.concat_ws(" ", title, body)
    bare = matches(title, fixed.BARE_CVE_TITLE)
    named = reduce(lambda rest, item: F.when(F.col("source_platform") == item[0], matches(body, item[1])).otherwise(rest), fixed.PLATFORM_NAMED.items(), F.lit(False))
    rated = F.lower(severity)
    word = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("stride", "cwe_top25", "comment_signal", "linked_issue_signal", "backport_signal")}
    first = findings.select(
        "*",
        matches(both, fixed.STRONG).alias("strong"),
        matches(both, fixed.MODERATE).alias("moderate"),
        matches(both, fixed.FIX_IMPACT).alias("fix_any"),
        matches(title, fixed.NOISE_TITLE).alias("is_noise"),
    )
    return first.select(
        "*",
        matches(both, fixed.BOILERPLATE).alias("is_boilerplate"),
        (F.col("is_noise") & (matches(both, fixed.ADVISORY_ID) | matches(title, fixed.STRONG) | rated.isin(*fixed.RATED))).alias("is_protected"),
        (bare & ~named).alias("is_misattributed"),
        matches(both, fixed.ID_PATTERN).alias("has_id"),
        rated.isin("critical", "high").alias("is_severe"),
        (rated == "medium").alias("is_medium"),
        rated.isin(*fixed.RATED).alias("is_rated"),
        (F.col("strong") & matches(title, fixed.STRONG)).alias("strong_title"),
        (F.col("strong") & matches(body, fixed.STRONG)).alias("strong_body"),
        (F.col("moderate") & matches(title, fixed.MODERATE)).alias("moderate_title"),
        (F.col("moderate") & matches(body, fixed.MODERATE)).alias("moderate_body"),
        (F.col("fix_any") & matches(title, fixed.FIX_IMPACT)).alias("fix_title"),
        matches(both, fixed.SENSITIVE_AREA).alias("sensitive"),
        (~word["stride"].isin("", "nan", "Other")).alias("has_stride"),
        (~word["cwe_top25"].isin("", "nan", "N/A")).alias("has_cwe"),
        F.coalesce(F.expr("try_cast(silent_fix_prob AS double)") >= 0.7, F.lit(False)).alias("likely_silent"),
        *((strip(word[c]) != "").alias("has_" + c) for c in ("comment_signal", "linked_issue_signal", "backport_signal")),
    )


def relevance() -> Column:
    return (
        F.when(F.col("has_id") | F.col("is_severe"), 1.0)
        .when(F.col("strong_title"), 0.9)
        .when(F.col("strong_body"), 0.8)
        .when(F.col("moderate_title"), 0.5)
        .when(F.col("moderate_body"), 0.3)
        .otherwise(0.0)
    )


def is_noise() -> Column:
    return F.col("is_boilerplate") | (F.col("is_noise") & ~F.col("is_protected")) | F.col("is_misattributed")


def gate() -> Column:
    return F.col("has_id") | F.col("is_rated") | (F.col("score") >= 0.5) | F.col("has_stride") | F.col("has_cwe") | F.col("fix_title") | F.col("likely_silent")


def confidence() -> Column:
    return (
        F.when(F.col("has_id") | F.col("is_severe") | F.col("strong_title"), "high")
        .when(F.col("has_cwe") | F.col("is_medium") | (F.col("score") >= 0.5), "medium")
        .otherwise("low")
    )


SIGNALS = (
    "has_id", "is_rated", "strong", "moderate", "sensitive", "fix_any", "has_stride", "has_cwe", "likely_silent",
    "has_comment_signal", "has_linked_issue_signal", "has_backport_signal",
)


def signal_count() -> Column:
    return reduce(lambda a, b: a + b, (F.col(f).cast("int") for f in SIGNALS))


def tier() -> Column:
    contest = F.lower(F.coalesce("contest", F.lit("")))
    return (
        F.when(F.col("has_id") | F.col("is_rated") | contest.contains("advisory") | contest.contains("cve"), "A_authoritative")
        .when(F.col("signals") >= 2, "B_corroborated")
        .otherwise("C_candidate")
    )


def curate(findings: DataFrame) -> DataFrame:
    """Findings that pass denoising and the gate, with (score, grade, signals, tier) beside the flags.

    The verdict is an inlined array, empty for a dropped row: a filter would be moved below the
    flags and have every pattern evaluated again.
    """
    marked = flagged(findings).withColumn("score", relevance()).withColumn("signals", signal_count())
    verdict = F.struct("score", confidence().alias("grade"), "signals", tier().alias("tier"))
    kept = marked.select("*", F.inline(F.when(~is_noise() & gate(), F.array(verdict))).alias("_score", "_grade", "_signals", "_tier"))
    return kept.drop("score", "signals").withColumnsRenamed({f"_{c}": c for c in ("score", "grade", "signals", "tier")})


def funnel(findings: DataFrame) -> DataFrame:
    """One row: how many rows each stage drops, in a single pass; ``residual`` counts boilerplate among the kept, which must be none."""
    marked = flagged(findings).withColumn("score", relevance())
    first = F.col("is_boilerplate")
    second = ~first & F.col("is_noise") & ~F.col("is_protected")
    third = ~first & ~second & F.col("is_misattributed")
    left = ~first & ~second & ~third
    return marked.agg(
        F.count(F.lit(1)).alias("raw"),
        F.count_if(first).alias("boilerplate"),
        F.count_if(second).alias("meta_work"),
        F.count_if(third).alias("misattributed"),
        F.count_if(left).alias("after_denoise"),
        F.count_if(left & gate()).alias("kept"),
        F.count_if(left & ~gate()).alias("gate_dropped"),
        F.count_if(left & gate() & first).alias("residual"),
    )


def build(findings: DataFrame, silent: DataFrame | None = None, labels: DataFrame | None = None, estimates: DataFrame | None = None) -> DataFrame:
    """The whole curation: silent-fix scores, gate, labels, one survivor a fix commit, severity estimates.

    Side tables are optional; each gives its first row a key. The gate's ``score`` and ``tier``
    become ``security_score`` and ``authority_tier``.
    """
    rows = findings
    if silent is not None:
        rows = silent_scores(rows.drop("silent_fix_prob"), silent)
    rows = curate(rows)
    rows = rows.drop(*FLAGS, "security_score", "authority_tier", "confidence", "n_signals").withColumnsRenamed(
        {"score": "security_score", "tier": "authority_tier", "grade": "confidence", "signals": "n_signals"}
    )
    if labels is not None:
        rows = survivors_by_commit(join_labels(rows, labels))
    if estimates is not None:
        rows = join_estimates(rows, estimates)
    return rows


FLAGS = (
    "strong", "moderate", "fix_any", "is_noise", "is_boilerplate", "is_protected", "is_misattributed", "has_id", "is_severe", "is_medium", "is_rated",
    "strong_title", "strong_body", "moderate_title", "moderate_body", "fix_title", "sensitive", "has_stride", "has_cwe", "likely_silent",
    "has_comment_signal", "has_linked_issue_signal", "has_backport_signal",
)
ESTIMATES = ("severity_estimated", "severity_source", "impact_type", "reachability", "blast_radius", "severity_why")


def silent_scores(findings: DataFrame, silent: DataFrame) -> DataFrame:
    """Findings with the silent-fix score of their address; rows without a key are dropped, of repeats the largest score stands."""
    scores = silent.where("source_url is not null").groupBy("source_url").agg(F.max("silent_fix_prob").alias("silent_fix_prob"))
    return findings.join(scores, "source_url", "left")


def join_labels(findings: DataFrame, labels: DataFrame) -> DataFrame:
    """Findings with the first row of labels of their id.

    Columns of the labels replace those of the same name; a blank or missing cwe is N/A.
    """
    own = [c for c in labels.columns if c != "id"]
    first = keep_first(labels.where("id is not null"), ["id"], own)
    rows = findings.drop(*own).join(first, "id", "left")
    if "cwe_top25" not in own:
        return rows
    return rows.withColumn("cwe_top25", F.when(F.coalesce("cwe_top25", F.lit("")) == "", "N/A").otherwise(F.col("cwe_top25")))


def richness(code: str = "pre_fix_code") -> Column:
    """How much a finding tells: code, then a change's address, then tier, then length of text."""
    told = F.coalesce(F.col(code), F.lit("[]"))
    url, body = (F.coalesce(c, F.lit("")) for c in ("source_url", "description"))
    tier_points = F.when(F.col("authority_tier") == "A_authoritative", 3).when(F.col("authority_tier") == "B_corroborated", 2).when(F.col("authority_tier") == "C_candidate", 1)
    return (
        F.when(~told.isin("", "[]"), 8.0).otherwise(0.0)
        + F.when(url.contains("/pull/") | url.contains("/commit/"), 4).otherwise(0)
        + F.coalesce(tier_points, F.lit(0))
        + F.least(F.length(body), F.lit(2000)) / 1000.0
    )


def survivors_by_commit(findings: DataFrame) -> DataFrame:
    """Of findings of one platform with the same fix commit the richest, the smallest id on ties; all without a commit.

    One pass: rows without a commit are a group each, by their id.
    """
    commit = F.coalesce("fix_commit", F.lit(""))
    key = F.when(commit != "", F.concat_ws("|", F.coalesce("source_platform", F.lit("")), commit))
    rows = findings.withColumn("_key", F.coalesce(key, F.concat(F.lit("\u0001"), F.col("id"))))
    return richest(rows, ["_key"], richness(), "id").drop("_key")


def tier_case(value: Column) -> Column:
    """The four tiers capitalised, every other value as it is."""
    return F.when(F.lower(value).isin(*fixed.RATED), F.initcap(value)).otherwise(value)


def join_estimates(findings: DataFrame, estimates: DataFrame) -> DataFrame:
    """Findings with the first estimate of their id, those of the six columns that exist."""
    own = [c for c in ESTIMATES if c in estimates.columns]
    first = keep_first(estimates.where("id is not null"), ["id"], own).select("id", *own)
    rows = findings.drop(*own).join(first, "id", "left")
    return rows.withColumn("severity_estimated", tier_case(F.col("severity_estimated"))) if "severity_estimated" in own else rows


def funnel_with_stages(findings: DataFrame, labels: DataFrame, estimates: DataFrame) -> DataFrame:
    """(stage, n): rows after the gate, labelled rows, rows after survivor choice, and rows of each severity source."""
    curated = curate(findings).drop(*FLAGS, "authority_tier").withColumnRenamed("tier", "authority_tier")
    named = join_labels(curated, labels)
    before = named.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("label", F.lit("other")) != "other").alias("labelled"))
    counted = before.select(F.inline(F.array(F.struct(F.lit("kept").alias("stage"), "n"), F.struct(F.lit("labelled").alias("stage"), F.col("labelled").alias("n")))))
    after = join_estimates(survivors_by_commit(named), estimates)
    by_source = after.groupBy(F.concat(F.lit("severity:"), F.coalesce("severity_source", F.lit("none"))).alias("stage")).agg(F.count(F.lit(1)).alias("n"))
    by_tier = after.groupBy(F.concat(F.lit("tier:"), "authority_tier").alias("stage")).agg(F.count(F.lit(1)).alias("n"))
    return counted.unionByName(by_source).unionByName(by_tier)
