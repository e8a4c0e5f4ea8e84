"""From a finding to a commit: inline references, advisories by release, and parents by the kind of id.

Repositories come as tables: commits (repo, sha, parent), pulls (repo, number, sha), tags (repo,
tag_name, sha) and the commits between a release and the one before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import matches

KINDS = {"GHSA-": "advisory", "PR#": "pull", "ISSUE#": "issue", "CHANGELOG#": "changelog", "RELEASE#": "release", "COMMIT#": "commit"}
#: Most commits of a release that is taken for a security patch release.
MOST_COMMITS = 6


def inline_reference(text: Column) -> Column:
    """Struct (kind, value): the commit that a text links, else its first pull request number in any of four spellings; null parts where none."""
    sha = F.regexp_extract(text, "/commit/([0-9a-f]{7,40})", 1)
    number = F.coalesce(*(F.nullif(F.regexp_extract(text, fixed.INLINE_PULL, k), F.lit("")) for k in range(1, 5)))
    kind = F.when(sha != "", "commit").when(number.isNotNull(), "pull")
    return F.struct(kind.alias("kind"), F.when(sha != "", sha).otherwise(number).alias("value"))


def resolve_inline(texts: DataFrame, commits: DataFrame, pulls: DataFrame) -> DataFrame:
    """(id, fix_commit): the linked commit if the repository has it, else the commit of the linked pull request.

    Texts have (id, repo, text). A shortened hash stands for itself if it begins a commit.
    """
    number = F.coalesce(*(F.nullif(F.regexp_extract("text", fixed.INLINE_PULL, k), F.lit("")) for k in range(1, 5)))
    sha = F.nullif(F.regexp_extract("text", "/commit/([0-9a-f]{7,40})", 1), F.lit(""))
    rows = texts.select("id", "repo", sha.alias("named"), number.cast("long").alias("number"))
    known = commits.select("repo", F.substring("sha", 1, 7).alias("start"), "sha")
    named = rows.where("named is not null").withColumn("start", F.substring("named", 1, 7))
    found = named.join(known, ["repo", "start"]).where(F.col("sha").startswith(F.col("named"))).groupBy("id").agg(F.min("named").alias("own"))
    pulled = rows.where("number is not null").join(pulls.select("repo", "number", F.col("sha").alias("pulled")), ["repo", "number"]).groupBy("id").agg(F.min("pulled").alias("pulled"))
    return rows.select("id").distinct().join(found, "id", "left").join(pulled, "id", "left").select("id", F.coalesce("own", "pulled").alias("fix_commit"))


def version_parts(tag: Column) -> Column:
    return F.struct(*(F.regexp_extract(tag, r"^v?(\d+)\.(\d+)\.(\d+)$", k).cast("long").alias(f"p{k}") for k in (1, 2, 3)))


def previous_releases(tags: DataFrame) -> DataFrame:
    """(repo, tag_name, previous): the release before each in its repository by version; tags of another shape are left out."""
    rows = tags.where(F.col("tag_name").rlike(r"^v?\d+\.\d+\.\d+$")).select("repo", "tag_name", version_parts(F.col("tag_name")).alias("v")).distinct()
    return rows.select("repo", "tag_name", F.lag("tag_name").over(Window.partitionBy("repo").orderBy("v", "tag_name")).alias("previous"))


def advisory_commits(advisories: DataFrame, tags: DataFrame, release_commits: DataFrame) -> DataFrame:
    """(advisory_id, sha): the fix of each advisory in the release that patches it.

    Advisories have (advisory_id, repo, patched, summary), release commits (repo, tag_name, sha,
    subject, files): those since the release before. Only releases that are not the first of their
    repository and have one to MOST_COMMITS commits that are no housekeeping count; the commit that
    shares most words with the summary stands, the smallest sha on ties.
    """
    version = F.regexp_extract("patched", r"(\d+\.\d+\.\d+)", 1)
    rows = advisories.select("advisory_id", "repo", "summary", version.alias("version")).where("version <> ''")
    known = previous_releases(tags).where("previous is not null").select("repo", "tag_name", F.regexp_replace("tag_name", "^v", "").alias("version"))
    known = known.groupBy("repo", "version").agg(F.max("tag_name").alias("tag_name"))
    work = release_commits.where(~matches(F.coalesce("subject", F.lit("")), fixed.SKIPPED_SUBJECT))
    small = work.groupBy("repo", "tag_name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= MOST_COMMITS).select("repo", "tag_name")

    def words(text: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0)))

    theirs = work.join(small, ["repo", "tag_name"], "left_semi").select("repo", "tag_name", "sha", words(F.concat_ws(" ", "subject", "files")).alias("theirs"))
    pairs = rows.join(known, ["repo", "version"]).join(theirs, ["repo", "tag_name"])
    shared = F.size(F.array_intersect(words(F.col("summary")), "theirs"))
    return pairs.groupBy("advisory_id").agg(F.min(F.struct((-shared).alias("s"), "sha")).alias("best")).select("advisory_id", "best.sha")


def reference(issue_id: Column) -> Column:
    """Struct (kind, value) of a prefixed id; kind unknown and an empty value for any other."""
    kind, value = F.lit("unknown"), F.lit("")
    for prefix, name in KINDS.items():
        kind = F.when(issue_id.startswith(prefix), name).otherwise(kind)
        value = F.when(issue_id.startswith(prefix), issue_id if prefix == "GHSA-" else F.substr(issue_id, F.lit(len(prefix) + 1))).otherwise(value)
    return F.struct(kind.alias("kind"), value.alias("value"))


def parents(findings: DataFrame, commits: DataFrame, pulls: DataFrame, tags: DataFrame) -> DataFrame:
    """(id, kind, introduced_in_commit): the parent of the commit that each finding's id names, empty where none is found.

    Findings have (id, repo, issue_id). Commits are looked up by their first twelve digits, pull
    requests by number, releases by tag; issues, changelog lines and unknown ids name no commit.
    """
    rows = findings.select("id", "repo", reference(F.coalesce("issue_id", F.lit(""))).alias("r")).select("id", "repo", "r.kind", "r.value")
    known = commits.select("repo", "sha", "parent", F.substring("sha", 1, 12).alias("start"))
    by_sha = rows.where("kind = 'commit'").withColumn("start", F.substring("value", 1, 12)).join(known, ["repo", "start"])
    by_pull = rows.where("kind = 'pull'").join(pulls.select("repo", F.col("number").cast("string").alias("value"), "sha"), ["repo", "value"]).join(known.drop("start"), ["repo", "sha"])
    by_tag = rows.where("kind = 'release'").withColumn("tag_name", F.substring_index("value", "#", 1)).join(tags.select("repo", "tag_name", "sha"), ["repo", "tag_name"]).join(known.drop("start"), ["repo", "sha"])
    found = by_sha.select("id", "parent").unionByName(by_pull.select("id", "parent")).unionByName(by_tag.select("id", "parent")).groupBy("id").agg(F.min("parent").alias("parent"))
    return rows.join(found, "id", "left").select("id", "kind", F.coalesce("parent", F.lit("")).alias("introduced_in_commit"))


def resolution_report(resolved: DataFrame, issue: str = "issue_id", sha: str = "introduced_in_commit", samples: int = 10) -> DataFrame:
    """(kind, n, n_resolved, coverage_pct, failed): per kind of id; ``failed`` are the first unresolved ids by name."""
    rows = resolved.select(F.col(issue).alias("issue"), reference(F.coalesce(issue, F.lit("")))["kind"].alias("kind"), (F.coalesce(sha, F.lit("")) != "").alias("ok"))
    counts = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_resolved"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("issue"))
    # Of each kind at most ``samples`` rows reach the list; the rank is cut by a window group limit before the shuffle.
    failed = rows.where("not ok and issue is not null").select("kind", "issue").distinct().withColumn("r", rank).where(F.col("r") <= samples)
    listed = failed.groupBy("kind").agg(F.array_join(F.array_sort(F.collect_list("issue")), ", ").alias("failed"))
    return counts.join(listed, "kind", "left").select("kind", "n", "n_resolved", F.round(100.0 * F.col("n_resolved") / F.col("n"), 2).alias("coverage_pct"), F.coalesce("failed", F.lit("")).alias("failed"))
