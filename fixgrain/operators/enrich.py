"""Row constructors, enrichment joins, classification and text mining."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import all_matches, capitalised, filled, first_match, first_present, lines, lookup, matches, present, slug, strip
from .curate import join_estimates
from .dedup import keep_first

CRAWL = ("source", "contest", "issue_id", "severity", "title", "description", "source_url", "introduced_in_commit")


def conform(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The columns in order, absent and null ones as empty strings, all others dropped."""
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns))


def synthesised_url(platform: Column, contest_slug: Column, issue_id: Column) -> Column:
    """The address that can be told from platform, contest and issue; only one platform's can, others get an empty one."""
    number = F.trim(F.regexp_replace(issue_id, "^#+", ""))
    known = (platform == "code4rena") & (contest_slug != "") & (number != "")
    return F.when(known, F.concat(F.lit("https://github.com/code-423n4/"), contest_slug, F.lit("/issues/"), number)).otherwise("")


def normalise(crawl: DataFrame, domain: str, scraped_at: str, platform_hint: str = "", platforms: tuple[str, ...] = (), severities: tuple[str, ...] = ()) -> DataFrame:
    """Crawl rows as unified findings; rows with neither title nor description are dropped.

    Absent columns are empty. ``platform_hint`` fills a missing source; no platforms or severities
    mean all of them.
    """
    have = {c: F.col(c) if c in crawl.columns else F.lit("") for c in CRAWL}
    issue = F.trim(F.regexp_replace(first_present(have["issue_id"]), "^#+", ""))
    rows = crawl.select(
        first_present(have["source"], F.lit(platform_hint)).alias("source_platform"),
        first_present(have["contest"]).alias("contest"),
        issue.alias("issue_id"),
        capitalised(first_present(have["severity"])).alias("severity"),
        first_present(have["title"]).alias("title"),
        first_present(have["description"]).alias("description"),
        first_present(have["source_url"]).alias("source_url"),
        first_present(have["introduced_in_commit"]).alias("introduced_in_commit"),
    ).where("title <> '' or description <> ''")
    if platforms:
        rows = rows.where(F.col("source_platform").isin(*(p.strip().lower() for p in platforms)))
    if severities:
        rows = rows.where(F.col("severity").isin(*(x.strip().capitalize() for x in severities)))
    platform = F.lower(F.col("source_platform"))
    named = (F.col("source_platform") != "") & (slug(F.col("contest")) != "") & (F.col("issue_id") != "")
    key = F.when(named, F.concat_ws(":", platform, slug(F.col("contest")), F.col("issue_id"))).otherwise(
        F.concat(F.lit("unknown:"), F.substring(F.sha2(F.concat_ws("\n", "title", "description"), 256), 1, 16))
    )
    url = F.when(F.col("source_url") != "", F.col("source_url")).otherwise(synthesised_url(platform, slug(F.col("contest")), F.col("issue_id")))
    return rows.select(key.alias("id"), "*", F.lit(domain).alias("domain"), F.lit(scraped_at).alias("scraped_at")).withColumn("source_url", url)


def merge_severity(severity: Column) -> Column:
    """Listed spellings pass; critical in another case is High, blank or unrated is Unrated, all else Info."""
    bare = F.trim(F.coalesce(severity, F.lit("")))
    return (
        F.when(bare.isin("Critical", "High", "Medium", "Low", "Info", "Unrated"), bare)
        .when(F.lower(bare) == "critical", "High")
        .when(F.lower(bare).isin("", "unrated"), "Unrated")
        .otherwise("Info")
    )


def merge_new(crawl: DataFrame, existing: DataFrame) -> DataFrame:
    """Crawl rows whose merge id is not there yet."""
    rows = crawl.select(
        F.substring(F.md5(F.concat_ws(":", F.coalesce("source", F.lit("")), F.coalesce("issue_id", F.lit("")))), 1, 16).alias("id"),
        F.coalesce("source", F.lit("")).alias("source_platform"),
        F.trim(F.substring(F.coalesce("title", F.lit("")), 1, 500)).alias("title"),
        F.trim(F.substring(F.coalesce("description", F.lit("")), 1, 2000)).alias("description"),
        merge_severity(F.col("severity")).alias("severity"),
    )
    return rows.join(existing.select("id"), "id", "left_anti")


def append_new(existing: DataFrame, crawl: DataFrame) -> DataFrame:
    """The existing table with the crawl's new rows below it; columns that one side lacks are null."""
    return existing.unionByName(merge_new(crawl, existing), allowMissingColumns=True)


def enrich(findings: DataFrame, silent: DataFrame, severities: DataFrame) -> DataFrame:
    """Findings with one row each of the side tables, whose null keys and later repeats are dropped."""
    scores = keep_first(silent.where("source_url is not null"), ["source_url"], [F.col("silent_fix_prob").desc_nulls_last(), "vuln_class", "reason"])
    rows = findings.select("id", "source_platform", "source_url").join(scores.select("source_url", "silent_fix_prob", "vuln_class"), "source_url", "left")
    return join_estimates(rows, severities)


def layer(platform: Column) -> Column:
    return F.when(platform.isin(*fixed.CONSENSUS_PLATFORMS), "consensus").otherwise("execution")


def classify(findings: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """(id, layer, area, root_cause, attack_path) by ordered patterns over files, title and description.

    With predictions (source_url, vuln_class, reason), one row an address, the reason stands before
    the text of cause and path, and the class gives the cause where no pattern does.
    """
    haystack = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("files_changed", "title", "description")))
    rows = findings.select("id", layer(F.col("source_platform")).alias("layer"), haystack.alias("text"), "source_url")
    told, fallback = F.col("text"), F.lit("other")
    if predictions is not None:
        rows = rows.join(predictions.select("source_url", "vuln_class", "reason"), "source_url", "left")
        told, fallback = F.concat_ws(" ", F.coalesce("reason", F.lit("")), "text"), class_cause(F.coalesce("vuln_class", F.lit("")))
    rows = rows.withColumn("told", told).withColumn("fallback", fallback)
    own = F.when(F.col("layer") == "consensus", label_of("text", fixed.CONSENSUS_AREAS)).otherwise(label_of("text", fixed.EXECUTION_AREAS))
    return rows.select(
        "id",
        "layer",
        F.coalesce(own, label_of("text", fixed.COMMON_AREAS), F.lit("other")).alias("area"),
        F.coalesce(label_of("told", fixed.ROOT_CAUSES), "fallback").alias("root_cause"),
        F.coalesce(label_of("told", fixed.ATTACK_PATHS), F.lit("malformed_input")).alias("attack_path"),
    )


def label_of(text: str, rules: tuple[tuple[str, str], ...]) -> Column:
    """The label of the first rule whose pattern occurs, null where none does."""
    return first_match(F.col(text), rules, F.lit(None).cast("string"))


def class_cause(vuln_class: Column) -> Column:
    return lookup(F.lower(vuln_class), fixed.CLASS_CAUSES, F.lit("other"))


def severity_word(text: Column) -> Column:
    """The first severity word, Critical as High, Info where there is none."""
    word = capitalised(F.regexp_extract(text, r"(?iUd)\b(Critical|High|Medium|Low)\b", 1))
    return F.when(word == "", "Info").when(word == "Critical", "High").otherwise(word)


def security_lines(texts: DataFrame, key: str, text: str, context: int = 3) -> DataFrame:
    """(key, line_no, title, severity, issue_id, context): each line with a security word.

    Heading and bullet signs are taken off, lines under 10 characters and urgency templates are
    skipped, and of equal lines of one text the first stands. Context is up to ``context`` lines
    on both sides.
    """
    rows = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), lines(F.col(text)).alias("all"))
    each = rows.select("key", "all", F.posexplode("all").alias("pos", "line"))
    each = each.withColumn("title", strip(F.regexp_replace("line", fixed.LINE_CHROME, "")))
    hit = each.where(matches(F.col("line"), fixed.SECURITY_LINE) & (F.length("title") >= 10)).withColumn("issue_id", F.substring(F.sha2("title", 256), 1, 16))
    first = hit.groupBy("key", "issue_id").agg(F.min(F.struct("pos", "line", "title", "all")).alias("r")).select("key", "issue_id", "r.*")
    start = F.greatest(F.lit(1), F.col("pos") + 1 - context)
    return first.where(~matches(F.col("line"), fixed.URGENCY_TEMPLATE)).select(
        "key",
        (F.col("pos") + 1).alias("line_no"),
        "title",
        severity_word(F.col("line")).alias("severity"),
        "issue_id",
        F.array_join(F.slice("all", start, F.col("pos") + 2 + context - start), "\n").alias("context"),
    )


def commit_rows(commits: DataFrame, sha: str, message: str) -> DataFrame:
    """(sha, issue_id, title, body, severity) of each commit message; empty, merge and revert subjects are dropped."""
    text = F.coalesce(F.col(message), F.lit(""))
    cut = F.when(F.instr(text, "\n\n") > 0, F.instr(text, "\n\n")).otherwise(F.instr(text, "\n"))
    subject = strip(F.when(cut > 0, F.substr(text, F.lit(1), cut - 1)).otherwise(text))
    body = strip(F.when(cut > 0, F.substr(text, cut + 1)).otherwise(F.lit("")))
    return (
        commits.select(F.col(sha).alias("sha"), subject.alias("subject"), body.alias("body"))
        .where((F.col("subject") != "") & ~F.col("subject").startswith("Merge ") & ~F.col("subject").startswith("Revert "))
        .select("sha", F.concat(F.lit("COMMIT#"), F.substring("sha", 1, 12)).alias("issue_id"), F.substring("subject", 1, 120).alias("title"), "body", severity_word(F.col("subject")).alias("severity"))
    )


def path_hint(*texts: Column) -> Column:
    """The sensitive names that occur in the texts, in their defined order."""
    blob = F.lower(F.concat_ws(" ", *(F.coalesce(t, F.lit("")) for t in texts)))
    return F.array_join(F.array_compact(F.array(*(F.when(blob.contains(h), h) for h in fixed.PATH_HINTS))), ",")


def other_platforms(platform: Column, text: Column) -> Column:
    """Names of other platforms that a text mentions, in order of their name."""
    blob = F.lower(F.coalesce(text, F.lit("")))
    hits = [
        F.when((platform != name) & reduce(lambda a, b: a | b, (blob.contains(alias) for alias in aliases)), name)
        for name, aliases in sorted(fixed.PLATFORM_ALIASES.items())
    ]
    return F.array_join(F.array_compact(F.array(*hits)), ", ")


def best_id(*values: Column) -> Column:
    """The first identifier by kind: CVE, then GHSA, then RUSTSEC; else an empty string."""
    found = all_matches(F.concat_ws(" ", *values), fixed.ADVISORY_ID)
    upper = F.transform(found, F.upper)

    def first(kind: str) -> Column:
        return F.get(F.filter(upper, lambda x: x.startswith(kind)), F.lit(0))

    return F.coalesce(first("CVE-"), first("GHSA-"), first("RUSTSEC-"), F.lit(""))


def advisory_url(identifier: Column) -> Column:
    return (
        F.when(identifier.startswith("CVE-"), F.concat(F.lit("https://nvd.nist.gov/vuln/detail/"), identifier))
        .when(identifier.startswith("GHSA-"), F.concat(F.lit("https://github.com/advisories/"), identifier))
        .when(identifier.startswith("RUSTSEC-"), F.concat(F.lit("https://rustsec.org/advisories/"), identifier, F.lit(".html")))
        .otherwise("")
    )


def is_dependency(title: Column, url: Column) -> Column:
    return matches(F.coalesce(title, F.lit("")), fixed.DEPENDENCY_TITLE) | matches(F.coalesce(url, F.lit("")), fixed.DEPENDENCY_URL, folded=False)


def urgency(level: Column) -> Column:
    return lookup(F.lower(F.trim(level)), {"critical": "High", "high": "High", "medium": "Medium", "low": "Low"}, F.lit("Unrated"))


def urgency_of_body(body: Column) -> Column:
    """The level of the first ``<level>-urgency``, else of the first ``Urgency: <level>``, else null."""
    levels = "(critical|high|medium|low)"
    found = (F.regexp_extract(body, f"(?iUd)`?{levels}`?-urgency", 1), F.regexp_extract(body, rf"(?iUd)\burgency(?::|[^\S\n])+{levels}\b", 1))
    return F.lower(F.coalesce(*(F.when(x != "", x) for x in found)))
