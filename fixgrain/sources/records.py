"""Row constructors over captured records: advisories, pull requests, issues, releases, OSV and NVD entries.

Each takes a DataFrame of nested records in the shape that the services return, so the same rows
come from a capture in a file, a table or a test. Absent values are empty strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import capitalised, lines, lookup, matches, strip
from ..operators.enrich import advisory_url, other_platforms, path_hint, urgency, urgency_of_body

ADVISORY = "ghsa_id string, cve_id string, severity string, summary string, description string, html_url string, vulnerabilities array<struct<patched_versions:string>>"
PULL = "number long, title string, body string, html_url string, merged_at string, pull_request string, labels array<string>"
RELEASE = "tag_name string, name string, body string, html_url string, published_at string, draft boolean"
OSV = (
    "id string, aliases array<string>, summary string, details string, severity array<struct<score:string>>, database_specific struct<severity:string,cvss:string>,"
    " affected array<struct<ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string>>>>>>"
)
NVD = "id string, descriptions array<struct<lang:string,value:string>>, v31 string, v30 string, v2 string"


def _text(name: str | Column) -> Column:
    return F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(""))


def _row(source: str, issue: Column, severity: Column, title: Column, body: Column, url: Column) -> list[Column]:
    return [F.lit(source).alias("source"), issue.alias("issue_id"), severity.alias("severity"), title.alias("title"), body.alias("description"), url.alias("source_url")]


def advisory_rows(records: DataFrame, source: str) -> DataFrame:
    """Advisories with an id and some text; the id goes into the title, patched versions into the body."""
    ids = F.concat_ws(" ", *(F.when(_text(c) != "", F.col(c)) for c in ("ghsa_id", "cve_id")))
    patched = F.array_join(F.filter(F.transform(F.coalesce("vulnerabilities", F.array()), lambda v: v["patched_versions"]), lambda x: x != ""), ", ")
    severity = F.lower(_text("severity"))
    body = F.concat(_text("description"), F.when(patched != "", F.concat(F.lit("\npatched_versions: "), patched)).otherwise(""))
    level = F.when(severity == "moderate", "Medium").when(severity.isin(*fixed.RATED), capitalised(severity)).otherwise("Unrated")
    rows = records.where((_text("ghsa_id") != "") & (F.concat(_text("summary"), _text("description")) != ""))
    return rows.select(*_row(source, F.col("ghsa_id"), level, F.substring(F.concat(_text("summary"), F.lit(" ["), ids, F.lit("]")), 1, 500), F.substring(body, 1, 1500), _text("html_url")))


def past_advisory_rows(records: DataFrame, source: str, repo: str) -> DataFrame:
    """Advisories as past fixes, whole texts: critical and high are High, an unknown severity is Info; without an id or any text there is no row."""
    level = lookup(F.lower(strip(_text("severity"))), {"critical": "High", "high": "High", "medium": "Medium", "low": "Low"}, F.lit("Info"))
    rows = records.select(*_row(source, strip(_text("ghsa_id")), level, strip(_text("summary")), strip(_text("description")), strip(_text("html_url"))), F.lit(repo).alias("contest"))
    return rows.where("issue_id <> '' and (title <> '' or description <> '')")


def cross_platform_rows(records: DataFrame, source: str, signals: tuple[str, ...]) -> DataFrame:
    """Pull requests that name other platforms, which go in front of the body; High if a signal stands in the title or the body's first 2,000 characters."""
    title, body = strip(_text("title")), strip(_text("body"))
    blob = F.lower(F.concat_ws(" ", _text("title"), F.substring(_text("body"), 1, 2000)))
    level = F.when(F.exists(F.array(*map(F.lit, signals)), lambda t: blob.contains(F.lower(t))), "High").otherwise("Medium")
    others = other_platforms(F.lit(source), blob)
    text = F.substring(F.concat(F.lit("[cross-client: "), others, F.lit("] "), body), 1, 2000)
    return records.where(((title != "") | (body != "")) & (others != "")).select(
        *_row(source, F.concat(F.lit("PR#"), F.col("number").cast("string")), level, F.substring(title, 1, 300), text, strip(_text("html_url"))), F.lit("cross_client").alias("contest")
    )


def specification_rows(records: DataFrame, patterns: dict[str, tuple[str, ...]], kind: str = "PR") -> DataFrame:
    """Pull requests or issues about specifications; the source is the first platform of ``patterns`` that the text names."""
    title, body = F.substring(_text("title"), 1, 200), F.substring(_text("body"), 1, 500)
    text = F.concat_ws(" ", title, body)
    source = F.lit("ethereum_specs")
    for name, words in reversed(patterns.items()):
        named = F.exists(F.array(*(F.lit(w.lower()) for w in words)), lambda t: F.lower(text).contains(t))
        source = F.when(named, name).otherwise(source)
    level = F.when(matches(text, fixed.SPLIT_TEXT), "High").otherwise("Medium")
    return records.select(
        source.alias("source"), F.concat(F.lit(f"{kind}#"), F.col("number").cast("string")).alias("issue_id"), level.alias("severity"), title.alias("title"),
        body.alias("description"), _text("html_url").alias("source_url"), F.lit("spec_divergence").alias("contest"),
    )


def ticket_id(title: Column, body: Column, number: Column, project: str = "TEKU") -> Column:
    """The first ticket of the project in the title, else in the body, else the pull request's number."""
    found = (F.regexp_extract(_text(t), rf"(?i)\b{project}-(\d+)", 1) for t in (title, body))
    return F.coalesce(*(F.when(f != "", F.concat(F.lit(f"{project}-"), f)) for f in found), F.concat(F.lit("PR#"), number.cast("string")))


def rustsec_id(record_id: Column, aliases: Column) -> Column:
    """The first RUSTSEC alias, else the record's own id."""
    return F.coalesce(_first(F.coalesce(aliases, F.array().cast("array<string>")), lambda x: x.startswith("RUSTSEC-")), record_id, F.lit(""))


def is_security_title(title: Column) -> Column:
    return matches(_text(title), fixed.SECURITY_TITLE)


def latest_releases(records: DataFrame, most: int = 500) -> DataFrame:
    """The ``most`` latest releases that are no drafts; pre-releases stay."""
    return records.where(~F.coalesce("draft", F.lit(False))).orderBy(F.desc_nulls_last("published_at"), "tag_name").limit(most)


def pull_rows(records: DataFrame, source: str, kind: str = "PR", skip_labels: tuple[str, ...] = ()) -> DataFrame:
    """Merged pull requests, or with kind ISSUE the issues that are no pull requests; one row a number."""
    kept = records.where(F.col("merged_at").isNotNull()) if kind == "PR" else records.where(F.col("pull_request").isNull())
    if skip_labels:
        kept = kept.where(~F.arrays_overlap(F.coalesce("labels", F.array()), F.array(*map(F.lit, skip_labels))))
    rows = kept.select(
        *_row(source, F.concat(F.lit(f"{kind}#"), F.col("number").cast("string")), F.lit("Unrated"), F.substring(_text("title"), 1, 300), F.substring(_text("body"), 1, 2000), _text("html_url")),
        path_hint(F.col("title"), F.col("body")).alias("path_hint"),
    )
    return rows.groupBy("issue_id").agg(*(F.min_by(c, F.struct("title", "description", "source_url")).alias(c) for c in rows.columns if c != "issue_id")).select(rows.columns)


def security_relevant(title: Column, body: Column, terms: tuple[str, ...]) -> Column:
    """Whether a term stands in the title or in the first 1,000 characters of the body."""
    blob = F.lower(F.concat_ws(" ", _text(title), F.substring(_text(body), 1, 1000)))
    return F.exists(F.array(*map(F.lit, terms)), lambda t: blob.contains(t))


def urgency_rows(records: DataFrame) -> DataFrame:
    """(tag_name, release_url, urgency_level, severity, published_at, title) of releases that are no drafts."""
    level = F.coalesce(urgency_of_body(F.col("body")), F.lit("Unrated"))
    rows = records.where(~F.coalesce("draft", F.lit(False)))
    title = F.when(_text("name") != "", F.col("name")).otherwise(F.col("tag_name"))
    return rows.select("tag_name", _text("html_url").alias("release_url"), level.alias("urgency_level"), urgency(level).alias("severity"), "published_at", title.alias("title"))


def _first(values: Column, test) -> Column:
    return F.get(F.filter(values, test), F.lit(0))


OSV_LEVELS = {"CRITICAL": "High", "HIGH": "High", "MODERATE": "Medium", "MEDIUM": "Medium", "LOW": "Low"}


def osv_severity() -> Column:
    """The database's severity, else its cvss word, else the first level named in a score, else Unrated."""
    words = (lookup(F.upper(_text(F.col(f"database_specific.{k}"))), OSV_LEVELS) for k in ("severity", "cvss"))
    scores = F.transform(F.coalesce("severity", F.expr("array()")), lambda e: F.upper(F.coalesce(e["score"], F.lit(""))))

    def named(score: Column) -> Column:
        return F.when(score.contains("CRITICAL") | score.contains("HIGH"), "High").when(score.contains("MEDIUM"), "Medium").when(score.contains("LOW"), "Low")

    return F.coalesce(*words, _first(F.transform(scores, named), lambda x: x.isNotNull()), F.lit("Unrated"))


def osv_best_id() -> Column:
    """The first id by kind: CVE, GHSA, RUSTSEC, else the record's own."""
    names = F.concat(F.array("id"), F.coalesce("aliases", F.array()))

    def first(kind: str) -> Column:
        return _first(names, lambda x: x.startswith(kind))

    return F.coalesce(first("CVE-"), first("GHSA-"), first("RUSTSEC-"), F.col("id"))


def osv_fix() -> tuple[Column, Column]:
    """The first commit that introduced the fault, from GIT ranges only, and the first fix of any range; null where there is none."""
    ranges = F.flatten(F.transform(F.coalesce("affected", F.expr("array()")), lambda a: F.coalesce(a["ranges"], F.expr("array()"))))

    def events(of: Column) -> Column:
        return F.flatten(F.transform(of, lambda r: F.coalesce(r["events"], F.expr("array()"))))

    git = events(F.filter(ranges, lambda r: r["type"] == "GIT"))
    introduced = _first(F.transform(git, lambda e: e["introduced"]), lambda x: x.isNotNull() & ~x.isin("0", ""))
    return introduced, _first(F.transform(events(ranges), lambda e: e["fixed"]), lambda x: x.isNotNull() & (x != ""))


def osv_url(best: Column) -> Column:
    known = advisory_url(best)
    return F.when(known != "", known).otherwise(F.concat(F.lit("https://osv.dev/vulnerability/"), best))


def osv_rows(records: DataFrame, source: str) -> DataFrame:
    """OSV entries; the best id by kind, the first fix as a tag: a commit if it is hexadecimal, else a version."""
    best = osv_best_id()
    introduced, fix = osv_fix()
    tag = F.when(fix.rlike("^[0-9a-fA-F]{7,}$"), F.concat(F.lit(" [fix_commit: "), fix, F.lit("]"))).when(fix.isNotNull(), F.concat(F.lit(" [fixed_version: "), fix, F.lit("]"))).otherwise("")
    body = F.when(_text("details") != "", F.col("details")).otherwise(_text("summary"))
    title = F.when(_text("summary") != "", F.col("summary")).otherwise(best)
    return records.select(
        *_row(source, best, osv_severity(), title, F.substring(F.concat(F.substring(body, 1, 500), tag), 1, 600), osv_url(best)),
        _text(introduced).alias("introduced_in_commit"),
    )


def module_vulnerabilities(records: DataFrame, source: str) -> DataFrame:
    """Entries found for the modules of a platform, one row an advisory whichever alias it was found by; without an id or text there is none."""
    best = osv_best_id()
    summary, details = strip(_text("summary")), strip(_text("details"))
    body = F.substring(F.when(details != "", details).otherwise(summary), 1, 500)
    url = F.when(best.startswith("GO-"), F.concat(F.lit("https://pkg.go.dev/vuln/"), best)).otherwise(osv_url(best))
    rows = records.where((_text("id") != "") & ((summary != "") | (body != ""))).select(
        *_row(source, best, osv_severity(), F.when(summary != "", summary).otherwise(best), body, url), F.col("id").alias("found_as")
    )
    return rows.groupBy("issue_id").agg(*(F.min_by(c, F.struct("found_as", "title", "description")).alias(c) for c in ("source", "severity", "title", "description", "source_url")))


def nvd_rows(records: DataFrame, source: str) -> DataFrame:
    """NVD entries whose English description names the platform; the first metric there is gives the severity."""
    english = F.coalesce(_first(F.col("descriptions"), lambda d: d["lang"] == "en")["value"], F.lit(""))
    level = F.coalesce(*(F.when(_text(c) != "", F.col(c)) for c in ("v31", "v30", "v2")), F.lit("Unrated"))
    named = matches(english, fixed.PLATFORM_NAMED[source]) if source in fixed.PLATFORM_NAMED else F.lit(True)
    return records.where(named).select(*_row(source, F.col("id"), capitalised(level), F.col("id"), english, F.concat(F.lit("https://nvd.nist.gov/vuln/detail/"), F.col("id"))))


def diff_summary(diff: Column, most: int = 6000) -> Column:
    """Only file headers, hunk marks and changed lines of a diff, without its ``+++`` and ``---`` lines, at most ``most`` characters."""
    kept = F.filter(lines(diff), lambda s: s.startswith("diff --git") | s.startswith("@@") | (s.rlike(r"^[+-]") & ~s.rlike(r"^(?:\+\+\+|---)")))
    return F.substring(F.array_join(kept, "\n"), 1, most)


def labelled_items(curated: DataFrame, raw: DataFrame) -> DataFrame:
    """(id, label) of rows that suit an evaluation set.

    1 for curated changes whose title names a fixed fault and no dependency, revert or test; 0 for
    raw changes whose title is feature work, without a fault, a dependency or an advisory id.
    """
    title = F.coalesce("title", F.lit(""))
    change = F.coalesce("source_url", F.lit("")).rlike(fixed.CHANGE_URL)
    plain = change & ~matches(title, fixed.BUMP_TITLE)
    positive = curated.where(plain & matches(title, fixed.FIX_TITLE) & ~matches(title, fixed.UNCLEAN_TITLE))
    both = F.concat_ws(" ", title, F.coalesce("description", F.lit("")))
    negative = raw.where(plain & matches(title, fixed.FEATURE_TITLE) & ~matches(title, fixed.FIX_TITLE) & ~matches(both, fixed.ITEM_ID))
    return positive.select("id", F.lit(1).alias("label")).unionByName(negative.select("id", F.lit(0).alias("label")))


def touches_source(diff: Column) -> Column:
    """Whether a source file's extension stands in a diff."""
    return matches(F.coalesce(diff, F.lit("")), fixed.SOURCE_FILE, folded=False)


def sampled_items(items: DataFrame, per_class: int, seed: int = 42) -> DataFrame:
    """Of the items whose diff touches source files the first ``per_class`` of each label, in a random order that the seed fixes."""
    order = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64(F.lit(seed), "item_id"), "item_id"))
    return items.where(touches_source(F.col("diff"))).withColumn("_n", order).where(F.col("_n") <= per_class).drop("_n")


def best_commit(advisories: DataFrame, commits: DataFrame) -> DataFrame:
    """(advisory_id, sha, overlap): of a release's commits the one that shares most words with the advisory.

    Advisories have (advisory_id, release, text), commits (release, sha, subject). Release
    housekeeping is skipped; the smallest sha stands on ties.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(_text(c)), F.lit("[a-z]{4,}"), F.lit(0)))
    work = commits.where(~matches(F.col("subject"), fixed.SKIPPED_SUBJECT)).select("release", "sha", words("subject").alias("theirs"))
    rows = advisories.select("advisory_id", "release", words("text").alias("own")).join(work, "release")
    score = F.struct((-F.size(F.array_intersect("own", "theirs"))).alias("s"), "sha")
    return rows.groupBy("advisory_id").agg(F.min(score).alias("best")).select("advisory_id", "best.sha", (-F.col("best.s")).alias("overlap"))
