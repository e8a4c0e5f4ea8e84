"""Queries over the given tables for the engine's own operators, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import matches, slug, title_key
from ..operators import curate as c
from ..operators import answers, dedup, diffs, enrich, graph, infer, profile, references, validate
from ..operators import severity as sv
from ..runtime import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def _vulns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "ethereum_vulns")


def _spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings for queries of many patterns."""
    return spread(_vulns(spark, sf_dir))


def _rx(text: str, pattern: str, flags: str = "i") -> str:
    return f"regexp_matches({text}, '{pattern}', '{flags}')"


_T, _D = "coalesce(title, '')", "coalesce(description, '')"
_BOTH = f"concat_ws(' ', {_T}, {_D})"
_FILLED = "CASE WHEN lower(trim(coalesce({0}, ''))) IN ('', 'nan') THEN '' ELSE trim({0}) END"
_NAMED = "CASE source_platform " + " ".join(f"WHEN '{k}' THEN {_rx(_D, v)}" for k, v in fixed.PLATFORM_NAMED.items()) + " ELSE false END"
_SEV = "lower(coalesce(severity, ''))"


def _flags(source: str = "ethereum_vulns") -> str:
    """The gate as SQL, from its definition: one scan with every pattern, then score, gate, grade and tier."""
    return f"""f AS (SELECT *, {_rx(_BOTH, fixed.BOILERPLATE)} AS b1, {_rx(_T, fixed.NOISE_TITLE)} AS b2,
  ({_rx(_BOTH, fixed.ADVISORY_ID)} OR {_rx(_T, fixed.STRONG)} OR {_SEV} IN ('critical', 'high', 'medium', 'low')) AS prot,
  ({_rx(_T, fixed.BARE_CVE_TITLE)} AND NOT ({_NAMED})) AS b3, {_rx(_BOTH, fixed.ID_PATTERN)} AS hid, {_SEV} IN ('critical', 'high') AS sev, {_SEV} = 'medium' AS med,
  {_SEV} IN ('critical', 'high', 'medium', 'low') AS rated, {_rx(_T, fixed.STRONG)} AS st, {_rx(_D, fixed.STRONG)} AS sd, {_rx(_BOTH, fixed.STRONG)} AS sa,
  {_rx(_T, fixed.MODERATE)} AS mt, {_rx(_D, fixed.MODERATE)} AS md, {_rx(_BOTH, fixed.MODERATE)} AS ma, {_rx(_T, fixed.FIX_IMPACT)} AS ft, {_rx(_BOTH, fixed.FIX_IMPACT)} AS fa,
  {_rx(_BOTH, fixed.SENSITIVE_AREA)} AS sens, coalesce(stride, '') NOT IN ('', 'nan', 'Other') AS hs, coalesce(cwe_top25, '') NOT IN ('', 'nan', 'N/A') AS hc,
  coalesce(silent_fix_prob >= 0.7, false) AS ls FROM {source}),
s AS (SELECT *, CASE WHEN hid OR sev THEN 1.0::DOUBLE WHEN st THEN 0.9 WHEN sd THEN 0.8 WHEN mt THEN 0.5 WHEN md THEN 0.3 ELSE 0.0 END AS score FROM f),
g AS (SELECT *, (hid OR rated OR score >= 0.5 OR hs OR hc OR ft OR ls) AS ok,
  hid::INT + rated::INT + sa::INT + ma::INT + sens::INT + fa::INT + hs::INT + hc::INT + ls::INT AS signals FROM s),
k AS (SELECT *, CASE WHEN hid OR sev OR st THEN 'high' WHEN hc OR med OR score >= 0.5 THEN 'medium' ELSE 'low' END AS grade,
  CASE WHEN hid OR rated OR contains(lower(coalesce(contest, '')), 'advisory') OR contains(lower(coalesce(contest, '')), 'cve') THEN 'A_authoritative'
    WHEN signals >= 2 THEN 'B_corroborated' ELSE 'C_candidate' END AS tier FROM g WHERE ok AND NOT (b1 OR (b2 AND NOT prot) OR b3))"""


_FLAGS = _flags()


@query(f"WITH {_FLAGS} SELECT id, source_platform, score, grade, signals, tier FROM k")
def curate_gate(spark, sf_dir):
    return c.curate(_spread(spark, sf_dir)).select("id", "source_platform", "score", "grade", "signals", "tier")


@query(
    f"""WITH {_FLAGS}, t AS (SELECT *, (NOT b1 AND b2 AND NOT prot) AS d2 FROM g), u AS (SELECT *, (NOT b1 AND NOT d2 AND b3) AS d3 FROM t)
SELECT count(*) AS raw, count(*) FILTER (b1) AS boilerplate, count(*) FILTER (d2) AS meta_work, count(*) FILTER (d3) AS misattributed,
count(*) FILTER (NOT b1 AND NOT d2 AND NOT d3) AS after_denoise, count(*) FILTER (NOT b1 AND NOT d2 AND NOT d3 AND ok) AS kept,
count(*) FILTER (NOT b1 AND NOT d2 AND NOT d3 AND NOT ok) AS gate_dropped,
count(*) FILTER (NOT b1 AND NOT d2 AND NOT d3 AND ok AND b1) AS residual FROM u"""
)
def funnel_report(spark, sf_dir):
    return c.funnel(_spread(spark, sf_dir))


@query(f"WITH {_FLAGS} SELECT tier, grade, signals, score, count(*) AS n FROM k GROUP BY ALL")
def tier_histogram(spark, sf_dir):
    return c.curate(_spread(spark, sf_dir)).groupBy("tier", "grade", "signals", "score").agg(F.count(F.lit(1)).alias("n"))


_NORM = f"""n AS (SELECT {_FILLED.format("source")} AS source_platform, {_FILLED.format("contest")} AS contest, trim(regexp_replace({_FILLED.format("issue_id")}, '^#+', '')) AS issue_id,
  {_FILLED.format("severity")} AS sv, {_FILLED.format("title")} AS title, {_FILLED.format("description")} AS description, {_FILLED.format("source_url")} AS source_url, introduced_in_commit FROM crawl_findings),
z AS (SELECT *, regexp_replace(regexp_replace(lower(contest), '[^a-z0-9.-]+', '-', 'g'), '^-+|-+$', '', 'g') AS sl FROM n WHERE title <> '' OR description <> '')"""


@query(
    f"""WITH {_NORM} SELECT CASE WHEN source_platform <> '' AND sl <> '' AND issue_id <> '' THEN concat_ws(':', lower(source_platform), sl, issue_id)
ELSE 'unknown:' || substr(sha256(title || chr(10) || description), 1, 16) END AS id, source_platform, contest, issue_id, upper(substr(sv, 1, 1)) || lower(substr(sv, 2)) AS severity, title,
source_url, {_FILLED.format("introduced_in_commit")} AS introduced_in_commit, 'ethereum' AS domain FROM z"""
)
def normalize_unify(spark, sf_dir):
    rows = enrich.normalise(table(spark, sf_dir, "crawl_findings"), "ethereum", "2025-01-01T00:00:00Z")
    return rows.select("id", "source_platform", "contest", "issue_id", "severity", "title", "source_url", "introduced_in_commit", "domain")


_MERGE = """m AS (SELECT substr(md5(coalesce(source, '') || ':' || coalesce(issue_id, '')), 1, 16) AS id, coalesce(source, '') AS source_platform,
  trim(substr(coalesce(title, ''), 1, 500)) AS title, trim(substr(coalesce(description, ''), 1, 2000)) AS description, trim(coalesce(severity, '')) AS sv FROM crawl_findings)"""


@query(
    f"""WITH {_MERGE}, r AS (SELECT id, source_platform, title, CASE WHEN sv IN ('Critical', 'High', 'Medium', 'Low', 'Info', 'Unrated') THEN sv
WHEN lower(sv) = 'critical' THEN 'High' WHEN lower(sv) IN ('', 'unrated') THEN 'Unrated' ELSE 'Info' END AS severity, description FROM m), e AS (SELECT * FROM r WHERE source_platform IN ('geth', 'besu', 'prysm'))
SELECT * FROM e UNION ALL SELECT * FROM r WHERE id NOT IN (SELECT id FROM e)"""
)
def merge_append(spark, sf_dir):
    """A snapshot of three platforms' rows, and the whole crawl appended to it."""
    crawl = table(spark, sf_dir, "crawl_findings")
    snapshot = enrich.merge_new(crawl.where(F.col("source").isin("geth", "besu", "prysm")), crawl.sparkSession.createDataFrame([], "id string"))
    return enrich.append_new(snapshot, crawl).select("id", "source_platform", "title", "severity", "description")


_TIER_CASE = "CASE WHEN lower({0}) IN ('critical', 'high', 'medium', 'low') THEN upper(substr({0}, 1, 1)) || lower(substr({0}, 2)) ELSE {0} END"
_EST = "severity_estimated, severity_source, impact_type, reachability, blast_radius, severity_why"

_FIRST_EST = f"e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {', '.join(x + ' NULLS FIRST' for x in _EST.split(', '))}) AS r FROM severity_est WHERE id IS NOT NULL) WHERE r = 1)"


@query(f"SELECT id, severity_estimated, impact_type FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {', '.join(x + ' NULLS FIRST' for x in _EST.split(', '))}) AS r FROM severity_est) WHERE r = 1")
def keep_first_by_id(spark, sf_dir):
    return dedup.keep_first(table(spark, sf_dir, "severity_est"), ["id"], _EST.split(", ")).select("id", "severity_estimated", "impact_type")


@query(
    f"""WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY silent_fix_prob DESC NULLS LAST, vuln_class NULLS FIRST, reason NULLS FIRST) AS r
  FROM silent_fix WHERE source_url IS NOT NULL) WHERE r = 1), {_FIRST_EST}
SELECT v.id, p.silent_fix_prob, p.vuln_class, {_TIER_CASE.format("e.severity_estimated")} AS severity_estimated, e.severity_source, e.impact_type, e.reachability, e.blast_radius, e.severity_why
FROM ethereum_vulns v LEFT JOIN p ON v.source_url = p.source_url LEFT JOIN e ON v.id = e.id"""
)
def enrich_left_joins(spark, sf_dir):
    rows = enrich.enrich(_vulns(spark, sf_dir), table(spark, sf_dir, "silent_fix"), table(spark, sf_dir, "severity_est"))
    return rows.select("id", "silent_fix_prob", "vuln_class", *c.ESTIMATES)


_URL_COMMIT = "lower(regexp_extract(coalesce(source_url, ''), '(?i)/commit/([0-9a-f]{7,40})', 1))"
_RICH = """CASE WHEN coalesce(pre_fix_code, '[]') NOT IN ('', '[]') THEN 8.0::DOUBLE ELSE 0 END + 4 * (contains(coalesce(source_url, ''), '/pull/') OR contains(coalesce(source_url, ''), '/commit/'))::INT
 + CASE authority_tier WHEN 'A_authoritative' THEN 3 WHEN 'B_corroborated' THEN 2 WHEN 'C_candidate' THEN 1 ELSE 0 END + least(length(coalesce(description, '')), 2000) / 1000.0::DOUBLE"""


@query(f"SELECT id, commit FROM (SELECT id, {_URL_COMMIT} AS commit, row_number() OVER (PARTITION BY source_platform, {_URL_COMMIT} ORDER BY {_RICH} DESC, id) AS r FROM ethereum_vulns) WHERE r = 1 OR commit = ''")
def survivor_dedup(spark, sf_dir):
    """The richest finding of each platform and commit in its address; those without a commit all stay, as groups of their own in the same pass."""
    rows = _vulns(spark, sf_dir).withColumn("commit", F.lower(F.regexp_extract(F.coalesce("source_url", F.lit("")), "(?i)/commit/([0-9a-f]{7,40})", 1)))
    alone = F.when(F.col("commit") == "", F.col("id"))
    return dedup.richest(rows.select("id", "source_platform", "commit", alone.alias("alone"), c.richness().alias("score")), ["source_platform", "commit", "alone"], F.col("score"), "id").select("id", "commit")


_PUNCT = fixed.PUNCTUATION.replace("'", "''")
_KEY = f"trim(substr(regexp_replace(trim(translate(lower(coalesce(title, '')), '{_PUNCT}', '')), '^\\s+|\\s+$', '', 'g'), 1, 60))"


@query(f"SELECT title_key, count(*) AS n, min(id) AS first_id FROM (SELECT id, substr(regexp_replace(translate(lower(coalesce(title, '')), '{_PUNCT}', ''), '^\\s+|\\s+$', '', 'g'), 1, 60) AS title_key FROM ethereum_vulns) WHERE title_key <> '' GROUP BY title_key HAVING count(*) > 1")
def cluster_title_key(spark, sf_dir):
    rows = _vulns(spark, sf_dir).select("id", title_key(F.col("title")).alias("title_key")).where("title_key <> ''")
    return rows.groupBy("title_key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")


_KEYS = f"""kx AS (
 SELECT id, 'cve|' || source_platform || '|' || upper(unnest(regexp_extract_all(concat_ws(' ', coalesce(issue_id, ''), {_D}), 'CVE-\\d{{4}}-\\d{{4,7}}', 0, 'i'))) AS k FROM ethereum_vulns
 UNION SELECT id, 'ghsa|' || source_platform || '|' || upper(unnest(regexp_extract_all(concat_ws(' ', coalesce(issue_id, ''), {_D}), 'GHSA-[0-9a-z]{{4}}-[0-9a-z]{{4}}-[0-9a-z]{{4}}', 0, 'i'))) FROM ethereum_vulns
 UNION SELECT id, 'sha|' || unnest(regexp_extract_all(concat_ws(' ', coalesce(introduced_in_commit, ''), coalesce(source_url, ''), {_D}), '\\b[0-9a-f]{{40}}\\b', 0)) FROM ethereum_vulns
 UNION SELECT id, 'title|' || source_platform || '|' || tk FROM (SELECT id, source_platform, substr(regexp_replace(translate(lower(coalesce(title, '')), '{_PUNCT}', ''), '^\\s+|\\s+$', '', 'g'), 1, 60) AS tk FROM ethereum_vulns) WHERE tk <> ''
), least_of AS (SELECT k, min(id) AS a FROM kx GROUP BY k), star AS (SELECT DISTINCT a, id AS b FROM kx JOIN least_of USING (k) WHERE id <> a),
both_ways AS (SELECT a, b FROM star UNION SELECT b, a FROM star),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
cl AS (SELECT v.id, least(v.id, coalesce(min(r.b), v.id)) AS cluster_id FROM ethereum_vulns v LEFT JOIN reach r ON v.id = r.a GROUP BY v.id)"""


@query(f"WITH RECURSIVE {_KEYS} SELECT id, cluster_id FROM cl")
def cluster_multi_key(spark, sf_dir):
    return graph.clusters(_vulns(spark, sf_dir))


_RANK = "CASE severity WHEN 'Critical' THEN 6 WHEN 'High' THEN 5 WHEN 'Medium' THEN 4 WHEN 'Low' THEN 3 WHEN 'Info' THEN 2 WHEN 'Unrated' THEN 1 ELSE 0 END"


@query(
    f"""WITH RECURSIVE {_KEYS}, m AS (SELECT cl.cluster_id, v.id, {_RANK} AS rk, coalesce(v.source_url, '') AS url FROM cl JOIN ethereum_vulns v USING (id)),
h AS (SELECT cluster_id, count(*) AS size, min(id) AS first_id, arg_min(id, (-rk, id)) AS representative FROM m GROUP BY cluster_id),
u AS (SELECT m.cluster_id, url, min(id) AS f FROM m JOIN h USING (cluster_id) WHERE url <> '' OR size = 1 GROUP BY m.cluster_id, url),
e AS (SELECT cluster_id, to_json(list(url ORDER BY f, url))::VARCHAR AS evidence FROM u GROUP BY cluster_id)
SELECT cluster_id, size, first_id, representative, coalesce(evidence, '[]') AS evidence FROM h LEFT JOIN e USING (cluster_id)"""
)
def cluster_collapse(spark, sf_dir):
    return graph.collapse(_vulns(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {_KEYS}, m AS (SELECT cl.cluster_id, v.id, coalesce(v.source_url, '') AS url, count(*) OVER (PARTITION BY cl.cluster_id) AS n FROM cl JOIN ethereum_vulns v USING (id)),
u AS (SELECT cluster_id, url, min(id) AS f FROM m WHERE url <> '' OR n = 1 GROUP BY cluster_id, url)
SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY f, url)::INT AS place, url AS source_url FROM u"""
)
def cluster_evidence(spark, sf_dir):
    findings = _vulns(spark, sf_dir)
    return graph.evidence(findings, graph.clusters(findings))


@query(
    f"""WITH RECURSIVE {_KEYS}, s AS (SELECT cluster_id, count(*) AS n FROM cl GROUP BY cluster_id),
x AS (SELECT count(*) AS shared_commits FROM (SELECT k FROM kx JOIN ethereum_vulns USING (id) WHERE starts_with(k, 'sha|') GROUP BY k HAVING count(DISTINCT coalesce(source_platform, '')) > 1))
SELECT sum(n)::BIGINT AS input_rows, count(*) AS output_rows, (sum(n) - count(*))::BIGINT AS duplicates, count(*) FILTER (n > 1) AS clusters, max(n) AS largest,
round(100.0::DOUBLE * (sum(n) - count(*)) / sum(n), 2) AS rate_pct, (SELECT shared_commits FROM x) AS shared_commits FROM s"""
)
def cluster_report(spark, sf_dir):
    findings = _vulns(spark, sf_dir)
    return graph.report(findings, graph.clusters(findings))


@query("SELECT id, unnest(list_distinct(regexp_extract_all(concat_ws(' ', fix_commit, introduced_in_commit, source_url), '\\b[0-9a-f]{40}\\b', 0))) AS sha FROM ethereum_vulns")
def sha_extract(spark, sf_dir):
    found = F.regexp_extract_all(F.concat_ws(" ", "fix_commit", "introduced_in_commit", "source_url"), F.lit(r"\b[0-9a-f]{40}\b"), F.lit(0))
    return _vulns(spark, sf_dir).select("id", F.explode(F.array_distinct(found)).alias("sha"))


@query("SELECT id, regexp_extract(source_url, '^https?://([^/]+)', 1) AS host, regexp_extract(source_url, '/(pull|issues|commit)/', 1) AS kind, regexp_extract(source_url, '/(?:pull|issues)/(\\d+)', 1) AS number FROM ethereum_vulns WHERE source_url IS NOT NULL")
def url_parts(spark, sf_dir):
    url = F.col("source_url")
    return _vulns(spark, sf_dir).where(url.isNotNull()).select(
        "id", F.regexp_extract(url, "^https?://([^/]+)", 1).alias("host"), F.regexp_extract(url, "/(pull|issues|commit)/", 1).alias("kind"), F.regexp_extract(url, r"/(?:pull|issues)/(\d+)", 1).alias("number")
    )


@query(
    f"""WITH l0 AS (SELECT id, string_split_regex(description, '\\r\\n|[\\n\\r]') AS a0 FROM ethereum_vulns WHERE description IS NOT NULL), l AS (SELECT id, CASE WHEN a0[len(a0)] = '' THEN a0[1:len(a0) - 1] ELSE a0 END AS al FROM l0),
e AS (SELECT id, al, unnest(al) AS line, generate_subscripts(al, 1) AS pos FROM l), h AS (SELECT *, regexp_replace(regexp_replace(line, '{fixed.LINE_CHROME}', ''), '^\\s+|\\s+$', '', 'g') AS t FROM e WHERE {_rx('line', fixed.SECURITY_LINE)}),
d AS (SELECT *, row_number() OVER (PARTITION BY id, t ORDER BY pos) AS r FROM h WHERE length(t) >= 10)
SELECT id AS key, pos AS line_no, t AS title, substr(sha256(t), 1, 16) AS issue_id, array_to_string(list_slice(al, greatest(1, pos - 3), pos + 3), chr(10)) AS context,
CASE lower(regexp_extract(line, '(?i)\\b(Critical|High|Medium|Low)\\b', 1)) WHEN '' THEN 'Info' WHEN 'critical' THEN 'High' WHEN 'high' THEN 'High' WHEN 'medium' THEN 'Medium' ELSE 'Low' END AS severity
FROM d WHERE r = 1 AND NOT {_rx('line', fixed.URGENCY_TEMPLATE)}"""
)
def security_lines_context(spark, sf_dir):
    return enrich.security_lines(_spread(spark, sf_dir), "id", "description").select("key", "line_no", "title", "issue_id", "context", "severity")


@query(
    """WITH u AS (SELECT tag_name, min(lower(trim(urgency_level))) AS lv FROM urgency WHERE tag_name IS NOT NULL GROUP BY tag_name)
SELECT v.id, CASE u.lv WHEN 'critical' THEN 'High' WHEN 'high' THEN 'High' WHEN 'medium' THEN 'Medium' WHEN 'low' THEN 'Low' ELSE 'Unrated' END AS urgency
FROM (SELECT id, split_part(trim(issue_id), '#', 2) AS tag FROM ethereum_vulns WHERE starts_with(trim(issue_id), 'RELEASE#')) v LEFT JOIN u ON v.tag = u.tag_name"""
)
def urgency_patch(spark, sf_dir):
    levels = table(spark, sf_dir, "urgency").where("tag_name is not null").groupBy("tag_name").agg(F.min(F.lower(F.trim("urgency_level"))).alias("level"))
    issue = F.trim("issue_id")
    releases = _vulns(spark, sf_dir).where(issue.startswith("RELEASE#")).select("id", F.get(F.split(issue, "#"), F.lit(1)).alias("tag_name"))
    return releases.join(levels, "tag_name", "left").select("id", enrich.urgency(F.col("level")).alias("urgency"))

_REPO = "regexp_extract(coalesce(release_url, ''), '^https?://[^/]+/([^/]+)/', 1)"


def _releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The releases with the repository of their address."""
    return table(spark, sf_dir, "urgency").withColumn("repo", F.regexp_extract(F.coalesce("release_url", F.lit("")), "^https?://[^/]+/([^/]+)/", 1))


@query(f"SELECT repo, title, published_at, tag_name FROM (SELECT *, row_number() OVER (PARTITION BY repo, title ORDER BY coalesce(published_at, ''), tag_name NULLS FIRST) AS r FROM (SELECT *, {_REPO} AS repo FROM urgency)) WHERE r = 1")
def earliest_release(spark, sf_dir):
    """The earliest release of each repository and title."""
    rows = _releases(spark, sf_dir)
    return dedup.keep_first(rows, ["repo", "title"], [F.coalesce("published_at", F.lit("")), "tag_name"]).select("repo", "title", "published_at", "tag_name")


_MSG = "CASE WHEN instr({0}, chr(10) || chr(10)) > 0 THEN instr({0}, chr(10) || chr(10)) ELSE instr({0}, chr(10)) END"


@query(
    f"""WITH m AS (SELECT id, {_BOTH.replace("' '", "chr(10)")} AS t FROM ethereum_vulns), p AS (SELECT id, t, {_MSG.format('t')} AS c FROM m),
s AS (SELECT id, regexp_replace(CASE WHEN c > 0 THEN substr(t, 1, c - 1) ELSE t END, '^\\s+|\\s+$', '', 'g') AS subject FROM p)
SELECT id AS sha, 'COMMIT#' || substr(id, 1, 12) AS issue_id, substr(subject, 1, 120) AS title,
CASE lower(regexp_extract(subject, '(?i)\\b(Critical|High|Medium|Low)\\b', 1)) WHEN '' THEN 'Info' WHEN 'critical' THEN 'High' WHEN 'high' THEN 'High' WHEN 'medium' THEN 'Medium' ELSE 'Low' END AS severity
FROM s WHERE subject <> '' AND NOT starts_with(subject, 'Merge ') AND NOT starts_with(subject, 'Revert ')"""
)
def commit_rows(spark, sf_dir):
    rows = _vulns(spark, sf_dir).select("id", F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))).alias("message"))
    return enrich.commit_rows(rows, "id", "message").select("sha", "issue_id", "title", "severity")


_OTHERS = "concat_ws(', ', " + ", ".join(
    f"CASE WHEN source_platform <> '{n}' AND ({' OR '.join(f'''contains(lower({_D}), '{a}')''' for a in al)}) THEN '{n}' END" for n, al in sorted(fixed.PLATFORM_ALIASES.items())
) + ")"


@query(f"SELECT id, {_OTHERS} AS others, concat_ws(',', {', '.join(f'''CASE WHEN contains(lower({_BOTH}), '{h}') THEN '{h}' END''' for h in fixed.PATH_HINTS)}) AS path_hint FROM ethereum_vulns")
def platform_mentions(spark, sf_dir):
    return _spread(spark, sf_dir).select(
        "id", enrich.other_platforms(F.coalesce("source_platform", F.lit("")), F.col("description")).alias("others"), enrich.path_hint(F.col("title"), F.col("description")).alias("path_hint")
    )


def _case(text: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {_rx(text, p)} THEN '{v}'" for p, v in rules) + f" ELSE '{default}' END"


_CONS = "(" + ", ".join(f"'{p}'" for p in fixed.CONSENSUS_PLATFORMS) + ")"
_HAY = "WITH h AS (SELECT *, concat_ws(' ', coalesce(files_changed, ''), coalesce(title, ''), coalesce(description, '')) AS hay FROM ethereum_vulns)"


@query(
    f"""{_HAY} SELECT id, CASE WHEN source_platform IN {_CONS} THEN 'consensus' ELSE 'execution' END AS layer,
CASE WHEN source_platform IN {_CONS} THEN {_case('hay', fixed.CONSENSUS_AREAS + fixed.COMMON_AREAS, 'other')} ELSE {_case('hay', fixed.EXECUTION_AREAS + fixed.COMMON_AREAS, 'other')} END AS area,
{_case('hay', fixed.ROOT_CAUSES, 'other')} AS root_cause, {_case('hay', fixed.ATTACK_PATHS, 'malformed_input')} AS attack_path FROM h"""
)
def classify_findings(spark, sf_dir):
    return enrich.classify(_spread(spark, sf_dir))


@query(
    f"SELECT {_rx(_T, fixed.DEPENDENCY_TITLE)} OR {_rx('''coalesce(source_url, '')''', fixed.DEPENDENCY_URL, 'c')} AS dependency, count(*) AS n FROM ethereum_vulns GROUP BY 1"
)
def dependency_split(spark, sf_dir):
    return _vulns(spark, sf_dir).groupBy(enrich.is_dependency(F.col("title"), F.col("source_url")).alias("dependency")).agg(F.count(F.lit(1)).alias("n"))

_HUNKS = """l AS (SELECT item_id, string_split(diff, chr(10)) AS al FROM eval_items WHERE diff IS NOT NULL), e AS (SELECT item_id, unnest(al) AS line, generate_subscripts(al, 1) AS pos FROM l),
f AS (SELECT *, last_value(CASE WHEN starts_with(line, 'diff --git') THEN regexp_extract(line, ' b/(\\S+)$', 1) END IGNORE NULLS) OVER w AS file,
  sum(regexp_matches(line, '^@@ -\\d+(?:,\\d+)? \\+\\d+(?:,\\d+)? @@')::INT) OVER w AS hunk, try_cast(regexp_extract(line, '^@@ -(\\d+)', 1) AS INT) AS pre_of,
  try_cast(regexp_extract(line, '^@@ -\\d+(?:,\\d+)? \\+(\\d+)', 1) AS INT) AS post_of FROM e WINDOW w AS (PARTITION BY item_id ORDER BY pos)),
g AS (SELECT *, max(pre_of) OVER (PARTITION BY item_id, hunk) AS pre_at, max(post_of) OVER (PARTITION BY item_id, hunk) AS post_at FROM f WHERE hunk > 0),
s AS (SELECT *, unnest(CASE WHEN starts_with(line, '+') AND NOT starts_with(line, '+++') THEN ['post'] WHEN starts_with(line, '-') AND NOT starts_with(line, '---') THEN ['pre']
  WHEN starts_with(line, ' ') THEN ['pre', 'post'] ELSE [] END) AS side FROM g WHERE file <> ''),
u AS (SELECT item_id, file, hunk, side, min(pre_at) AS pre_at, min(post_at) AS post_at, count(*) AS n_lines, string_agg(substr(line, 2), chr(10) ORDER BY pos) AS code FROM s GROUP BY item_id, file, hunk, side)"""


@query(f"WITH {_HUNKS} SELECT item_id AS key, file, hunk::BIGINT AS hunk, side, CASE side WHEN 'pre' THEN pre_at ELSE post_at END AS start_line, n_lines, code FROM u")
def diff_hunks(spark, sf_dir):
    """The SQL has no caps: no hunk of these diffs reaches one, which tests cover."""
    return diffs.hunks(table(spark, sf_dir, "eval_items"), "item_id", "diff").select("key", "file", "hunk", "side", "start_line", "n_lines", "code")


@query(
    f"""WITH {_HUNKS}, b AS (SELECT item_id, side, file, min(hunk) AS first, list({{'start_line': CASE side WHEN 'pre' THEN pre_at ELSE post_at END, 'code': code}} ORDER BY hunk) AS hunks FROM u GROUP BY item_id, side, file),
d AS (SELECT item_id, to_json(list({{'file': file, 'hunks': hunks}} ORDER BY first) FILTER (side = 'pre'))::VARCHAR AS pre, to_json(list({{'file': file, 'hunks': hunks}} ORDER BY first) FILTER (side = 'post'))::VARCHAR AS post FROM b GROUP BY item_id),
n AS (SELECT item_id, to_json(list(file ORDER BY pos))::VARCHAR AS files FROM f WHERE starts_with(line, 'diff --git') AND file <> '' GROUP BY item_id)
SELECT i.item_id AS key, coalesce(files, '[]') AS files_changed, coalesce(pre, '[]') AS pre_fix_code, coalesce(post, '[]') AS post_fix_code FROM eval_items i LEFT JOIN n USING (item_id) LEFT JOIN d USING (item_id)"""
)
def code_documents(spark, sf_dir):
    return diffs.documents(table(spark, sf_dir, "eval_items"), "item_id", "diff")


@query(
    """WITH p AS (SELECT id, try_cast(pre_fix_code AS JSON) AS j FROM ethereum_vulns), f AS (SELECT id, j, unnest(from_json(j, '["JSON"]')) AS x FROM p WHERE json_type(j) = 'ARRAY'),
h AS (SELECT id, unnest(from_json(x->'hunks', '["JSON"]')) AS h FROM f), s AS (SELECT id, sum(len(string_split(h->>'code', chr(10))))::BIGINT AS loc FROM h GROUP BY id),
n AS (SELECT id, count(*) AS nf FROM f GROUP BY id) SELECT count(*) AS n, sum(nf)::BIGINT AS files, sum(loc)::BIGINT AS loc, quantile_cont(loc, 0.5) AS median_loc FROM n JOIN s USING (id)"""
)
def change_size(spark, sf_dir):
    sizes = diffs.change_size(_vulns(spark, sf_dir).where(F.try_parse_json("pre_fix_code").isNotNull()), "pre_fix_code").where("loc > 0")
    return sizes.agg(F.count(F.lit(1)).alias("n"), F.sum("n_files").alias("files"), F.sum("loc").alias("loc"), F.percentile("loc", 0.5).alias("median_loc"))


@query("SELECT source_platform, count(*) FILTER (layer = 'consensus') AS consensus, count(*) FILTER (layer = 'execution') AS execution FROM ethereum_vulns GROUP BY source_platform HAVING count(*) > 5")
def platform_layer_pivot(spark, sf_dir):
    rows = _vulns(spark, sf_dir).groupBy("source_platform").pivot("layer", ["consensus", "execution"]).agg(F.count(F.lit(1))).na.fill(0)
    return rows.where("consensus + execution > 5")


@query(
    "SELECT root_cause, "
    + ", ".join(f"count(*) FILTER (lower(trim(severity)) = '{s}') AS {s}" for s in fixed.RATED)
    + " FROM ethereum_vulns GROUP BY root_cause"
)
def cause_severity_crosstab(spark, sf_dir):
    sev = F.lower(F.trim("severity"))
    return _vulns(spark, sf_dir).groupBy("root_cause").agg(*(F.count_if(F.coalesce(sev == s, F.lit(False))).alias(s) for s in fixed.RATED))


@query("SELECT label, count(*) AS n FROM ethereum_vulns WHERE label IS NOT NULL AND label <> 'other' GROUP BY label ORDER BY n DESC, label LIMIT 10")
def topk_area(spark, sf_dir):
    rows = _vulns(spark, sf_dir).where("label is not null and label <> 'other'").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.desc("n"), "label").limit(10)


@query(
    f"""SELECT round(avg((source_url IS NOT NULL)::INT * 100.0::DOUBLE), 6) AS source_url, round(avg((coalesce(label, 'other') <> 'other')::INT * 100.0::DOUBLE), 6) AS label,
round(avg((length(coalesce(fix_commit, '')) > 0)::INT * 100.0::DOUBLE), 6) AS fix_commit, round(avg((coalesce(root_cause, 'other') <> 'other')::INT * 100.0::DOUBLE), 6) AS root_cause,
round(avg((coalesce(post_fix_code, '[]') <> '[]')::INT * 100.0::DOUBLE), 6) AS post_fix_code, round(avg((coalesce(cwe_top25, 'N/A') <> 'N/A')::INT * 100.0::DOUBLE), 6) AS cwe_top25,
round(avg((silent_fix_prob IS NOT NULL)::INT * 100.0::DOUBLE), 6) AS silent_fix_prob, round(avg(({_SEV} IN ('critical', 'high', 'medium', 'low'))::INT * 100.0::DOUBLE), 6) AS rated FROM ethereum_vulns"""
)
def coverage_pct(spark, sf_dir):
    return profile.coverage(_vulns(spark, sf_dir))


@query("SELECT avg((stride IS NOT NULL)::INT) >= 0.99 AS stride_complete, avg((cwe_top25 IS NOT NULL)::INT) >= 0.8 AS cwe_complete FROM ethereum_vulns")
def completeness(spark, sf_dir):
    return profile.completeness(_vulns(spark, sf_dir))


@query(
    """WITH p AS (SELECT id, try_cast(post_fix_code AS JSON) AS j FROM ethereum_vulns), f AS (SELECT id, unnest(from_json(j, '["JSON"]')) AS x FROM p WHERE json_type(j) = 'ARRAY'),
h AS (SELECT id, unnest(from_json(x->'hunks', '["JSON"]')) AS h FROM f), s AS (SELECT id, least(sum(len(string_split(h->>'code', chr(10)))), 4999) AS loc FROM h GROUP BY id),
b AS (SELECT unnest([0, 5, 10, 20, 30, 50, 100, 200, 500]) AS low, unnest([5, 10, 20, 30, 50, 100, 200, 500, 5000]) AS high)
SELECT low, high, count(loc) AS n FROM b LEFT JOIN s ON loc >= low AND loc < high AND loc > 0 GROUP BY low, high"""
)
def change_histogram(spark, sf_dir):
    rows = _vulns(spark, sf_dir).where(F.try_parse_json("post_fix_code").isNotNull())
    return profile.histogram(diffs.change_size(rows, "post_fix_code").where("loc > 0"), "loc")


@query(
    "WITH c AS (SELECT CASE attack_path " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.CHANNELS.items()) + " END AS channel FROM ethereum_vulns) SELECT CASE channel "
    + " ".join(f"WHEN '{v}' THEN {k}" for k, v in enumerate(fixed.CHANNEL_ORDER, 1))
    + " END AS place, channel, count(*) AS n FROM c WHERE channel IS NOT NULL GROUP BY channel"
)
def channel_rollup(spark, sf_dir):
    return profile.channels(_vulns(spark, sf_dir))


_IN = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"


@query(f"SELECT CASE WHEN starts_with(label, 'beacon-chain') OR label IN {_IN(fixed.VALUE_AREAS)} THEN 'consensus / value' WHEN label IN {_IN(fixed.AVAILABILITY_AREAS)} THEN 'availability' ELSE 'other' END AS impact, count(*) AS n FROM ethereum_vulns WHERE label IS NOT NULL GROUP BY 1")
def impact_classes(spark, sf_dir):
    rows = _vulns(spark, sf_dir).where("label is not null")
    return rows.groupBy(profile.impact_class(F.col("label")).alias("impact")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE source_platform " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.LANGUAGES.items()) + " END AS language, count(*) AS n FROM ethereum_vulns GROUP BY 1")
def languages(spark, sf_dir):
    return _vulns(spark, sf_dir).groupBy(profile.language(F.col("source_platform")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


def _metrics(predicted, truth):
    tp, fp, fn = (F.count_if(x) for x in (predicted & truth, predicted & ~truth, ~predicted & truth))
    tn = F.count_if(~predicted & ~truth)
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 9)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + tn + fp + fn).alias("accuracy")]


_CONFUSION = """count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn, count(*) FILTER (NOT p AND NOT t) AS tn,
round(coalesce(count(*) FILTER (p AND t) / nullif(count(*) FILTER (p), 0), 0.0), 9) AS precision, round(coalesce(count(*) FILTER (p AND t) / nullif(count(*) FILTER (t), 0), 0.0), 9) AS recall,
round(coalesce(2 * count(*) FILTER (p AND t) / nullif(2 * count(*) FILTER (p AND t) + count(*) FILTER (p AND NOT t) + count(*) FILTER (NOT p AND t), 0), 0.0), 9) AS f1,
round(coalesce(count(*) FILTER (p = t) / nullif(count(*), 0), 0.0), 9) AS accuracy"""


@query(f"WITH x AS (SELECT coalesce(silent_fix_prob >= 0.5, false) AS p, is_security_fix = 1 AS t FROM silent_fix WHERE is_security_fix IS NOT NULL) SELECT {_CONFUSION} FROM x")
def confusion_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "silent_fix").where("is_security_fix is not null")
    return rows.select(F.coalesce(F.col("silent_fix_prob") >= 0.5, F.lit(False)).alias("p"), (F.col("is_security_fix") == 1).alias("t")).agg(*_metrics(F.col("p"), F.col("t")))


_VOTES = f"({_rx(_T, fixed.STRONG)})::INT + ({_rx(_T, fixed.MODERATE)})::INT + ({_rx(_T, fixed.FIX_IMPACT)})::INT"


@query(f"WITH v AS (SELECT {_VOTES} AS n, label = 1 AS t FROM eval_items), x AS (SELECT 'any' AS rule, n >= 1 AS p, t FROM v UNION ALL SELECT 'majority', n >= 2, t FROM v UNION ALL SELECT 'all', n = 3, t FROM v) SELECT rule, {_CONFUSION} FROM x GROUP BY rule")
def ensemble_vote(spark, sf_dir):
    title = F.coalesce("title", F.lit(""))
    votes = sum((matches(title, p).cast("int") for p in (fixed.STRONG, fixed.MODERATE, fixed.FIX_IMPACT)), F.lit(0))
    rows = table(spark, sf_dir, "eval_items").select(votes.alias("n"), (F.col("label") == 1).alias("t"))
    rules = F.array(*(F.struct(F.lit(k).alias("rule"), (F.col("n") >= least).alias("p")) for k, least in (("any", 1), ("majority", 2), ("all", 3))))
    return rows.select("t", F.inline(rules)).groupBy("rule").agg(*_metrics(F.col("p"), F.col("t")))


_TIER = "CASE {0} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


@query(
    f"""WITH r AS (SELECT lower(v.severity) AS t, lower(e.severity_estimated) AS p FROM (SELECT * FROM ethereum_vulns WHERE {_SEV} IN ('critical', 'high', 'medium', 'low')) v JOIN (SELECT id, min(severity_estimated) AS severity_estimated FROM severity_est GROUP BY id) e USING (id)),
q AS (SELECT *, {_TIER.format("t")} AS a, {_TIER.format("p")} AS b FROM r WHERE p NOT IN ('', 'error'))
SELECT count(*) AS n, count(*) FILTER (a = b) AS exact, count(*) FILTER (abs(a - b) <= 1) AS near, count(*) FILTER (p = 'not-eligible') AS not_eligible FROM q"""
)
def ordinal_agreement(spark, sf_dir):
    return sv.agreement(_graded_pairs(spark, sf_dir))


@query(
    f"""WITH r AS (SELECT lower(v.severity) AS truth, lower(e.severity_estimated) AS predicted FROM (SELECT * FROM ethereum_vulns WHERE {_SEV} IN ('critical', 'high', 'medium', 'low')) v JOIN (SELECT id, min(severity_estimated) AS severity_estimated FROM severity_est GROUP BY id) e USING (id))
SELECT truth, predicted, count(*) AS n FROM r WHERE predicted NOT IN ('', 'error') GROUP BY ALL ORDER BY n DESC, truth, predicted LIMIT 12"""
)
def severity_confusion(spark, sf_dir):
    return sv.confusion_pairs(_graded_pairs(spark, sf_dir))


def _graded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = _vulns(spark, sf_dir).where(sv.is_graded(F.col("severity"))).select("id", F.col("severity").alias("truth"))
    return graded.join(table(spark, sf_dir, "severity_est").groupBy("id").agg(F.min("severity_estimated").alias("predicted")), "id")


@query(
    """WITH c AS (SELECT source_platform AS repo, fix_commit AS sha, min(introduced_in_commit) AS parent FROM ethereum_vulns WHERE regexp_matches(fix_commit, '^[0-9a-f]{40}$') AND introduced_in_commit <> '' GROUP BY 1, 2),
p AS (SELECT source_platform AS repo, regexp_extract(issue_id, '^PR#(\\d+)$', 1) AS number, min(fix_commit) AS sha FROM ethereum_vulns WHERE regexp_matches(issue_id, '^PR#\\d+$') AND regexp_matches(fix_commit, '^[0-9a-f]{40}$') GROUP BY 1, 2),
t AS (SELECT source_platform AS repo, split_part(substr(issue_id, 9), '#', 1) AS tag, min(fix_commit) AS sha FROM ethereum_vulns WHERE starts_with(issue_id, 'RELEASE#') AND regexp_matches(fix_commit, '^[0-9a-f]{40}$') GROUP BY 1, 2),
v AS (SELECT id, source_platform AS repo, coalesce(issue_id, '') AS i FROM ethereum_vulns),
x AS (SELECT id, parent FROM v JOIN c ON v.repo = c.repo AND starts_with(i, 'COMMIT#') AND substr(i, 8, 12) = substr(sha, 1, 12)
  UNION ALL SELECT id, parent FROM v JOIN p ON v.repo = p.repo AND i = 'PR#' || p.number JOIN c ON c.repo = p.repo AND c.sha = p.sha
  UNION ALL SELECT id, parent FROM v JOIN t ON v.repo = t.repo AND starts_with(i, 'RELEASE#') AND split_part(substr(i, 9), '#', 1) = t.tag JOIN c ON c.repo = t.repo AND c.sha = t.sha)
SELECT v.id, CASE WHEN starts_with(i, 'GHSA-') THEN 'advisory' WHEN starts_with(i, 'PR#') THEN 'pull' WHEN starts_with(i, 'ISSUE#') THEN 'issue' WHEN starts_with(i, 'CHANGELOG#') THEN 'changelog'
WHEN starts_with(i, 'RELEASE#') THEN 'release' WHEN starts_with(i, 'COMMIT#') THEN 'commit' ELSE 'unknown' END AS kind, coalesce(min(parent), '') AS introduced_in_commit FROM v LEFT JOIN x USING (id) GROUP BY v.id, i"""
)
def parent_commit_dispatch(spark, sf_dir):
    """Repository tables are taken from the findings themselves: a platform is a repository, its fixes are commits with their parents."""
    rows = _vulns(spark, sf_dir).withColumn("repo", F.col("source_platform"))
    whole = rows.where(F.col("fix_commit").rlike("^[0-9a-f]{40}$"))
    commits = whole.where("introduced_in_commit <> ''").groupBy("repo", F.col("fix_commit").alias("sha")).agg(F.min("introduced_in_commit").alias("parent"))
    pulls = whole.where(F.col("issue_id").rlike(r"^PR#\d+$")).groupBy("repo", F.substring("issue_id", 4, 40).cast("long").alias("number")).agg(F.min("fix_commit").alias("sha"))
    tags = whole.where(F.col("issue_id").startswith("RELEASE#")).groupBy("repo", F.substring_index(F.expr("substring(issue_id, 9)"), "#", 1).alias("tag_name")).agg(F.min("fix_commit").alias("sha"))
    return references.parents(rows, commits, pulls, tags)


_KIND = """CASE WHEN starts_with(i, 'GHSA-') THEN 'advisory' WHEN starts_with(i, 'PR#') THEN 'pull' WHEN starts_with(i, 'ISSUE#') THEN 'issue' WHEN starts_with(i, 'CHANGELOG#') THEN 'changelog'
WHEN starts_with(i, 'RELEASE#') THEN 'release' WHEN starts_with(i, 'COMMIT#') THEN 'commit' ELSE 'unknown' END"""


@query(
    f"""WITH v AS (SELECT issue_id, coalesce(issue_id, '') AS i, coalesce(introduced_in_commit, '') <> '' AS ok FROM ethereum_vulns), k AS (SELECT *, {_KIND} AS kind FROM v),
c AS (SELECT kind, count(*) AS n, count(*) FILTER (ok) AS n_resolved FROM k GROUP BY kind), d AS (SELECT DISTINCT kind, issue_id FROM k WHERE NOT ok AND issue_id IS NOT NULL),
f AS (SELECT kind, string_agg(issue_id, ', ' ORDER BY issue_id) AS failed FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY issue_id) AS r FROM d) WHERE r <= 10 GROUP BY kind)
SELECT kind, n, n_resolved, round(100.0::DOUBLE * n_resolved / n, 2) AS coverage_pct, coalesce(failed, '') AS failed FROM c LEFT JOIN f USING (kind)"""
)
def resolution_report(spark, sf_dir):
    return references.resolution_report(_vulns(spark, sf_dir))


@query(
    """SELECT id, CASE WHEN sha <> '' THEN 'commit' WHEN num IS NOT NULL THEN 'pull' END AS kind, CASE WHEN sha <> '' THEN sha ELSE num END AS value FROM (SELECT id, regexp_extract(t, '/commit/([0-9a-f]{7,40})', 1) AS sha,
coalesce("""
    + ", ".join(f"nullif(regexp_extract(t, '{fixed.INLINE_PULL}', {k}), '')" for k in range(1, 5))
    + """) AS num FROM (SELECT id, concat_ws(' ', title, description, source_url, evidence) AS t FROM ethereum_vulns))"""
)
def inline_references(spark, sf_dir):
    text = F.concat_ws(" ", "title", "description", "source_url", "evidence")
    return _vulns(spark, sf_dir).select("id", references.inline_reference(text).alias("r")).select("id", "r.kind", "r.value")


@query(f"SELECT repo, tag_name, lag(tag_name) OVER (PARTITION BY repo ORDER BY a, b, c, tag_name) AS previous FROM (SELECT DISTINCT {_REPO} AS repo, tag_name, regexp_extract(tag_name, '(\\d+)\\.(\\d+)\\.(\\d+)', 1)::INT AS a, regexp_extract(tag_name, '(\\d+)\\.(\\d+)\\.(\\d+)', 2)::INT AS b, regexp_extract(tag_name, '(\\d+)\\.(\\d+)\\.(\\d+)', 3)::INT AS c FROM urgency WHERE regexp_matches(tag_name, '^v?\\d+\\.\\d+\\.\\d+$'))")
def previous_release(spark, sf_dir):
    """The release before each one of its repository, by version."""
    return references.previous_releases(_releases(spark, sf_dir))


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY event_type")
def event_props_json(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


@query(
    f"""WITH {_FLAGS}, w AS (SELECT *, {_rx(_BOTH, 'CVE-[0-9]{4}-[0-9]{4,7}|GHSA-')} OR {_SEV} IN ('critical', 'high', 'medium', 'low') OR score >= 0.5 OR hs OR hc OR ft OR ls AS any_signal FROM k),
c AS (SELECT count(*) AS n, count(*) FILTER ({_rx(_BOTH, fixed.BOILERPLATE)}) AS bl, count(*) FILTER (NOT any_signal) AS ws, count(*) FILTER (grade NOT IN ('high', 'medium', 'low')) AS bg,
  count(*) FILTER (NOT score BETWEEN 0 AND 1) AS bs, count(*) FILTER (id NOT IN (SELECT id FROM ethereum_vulns)) AS ni FROM w)
SELECT unnest(['boilerplate_left', 'without_signal', 'bad_confidence', 'bad_score', 'too_few_rows', 'missing_columns', 'not_in_input', 'not_smaller']) AS check,
unnest([bl, ws, bg, bs, greatest(0, 1001 - n), 0, ni, (n >= (SELECT count(*) FROM ethereum_vulns))::BIGINT]) AS violations FROM c"""
)
def quality_gates(spark, sf_dir):
    """Violations of each gate by the curated table, 0 where it holds; planted ones are found in the tests."""
    rows = _spread(spark, sf_dir)
    return validate.violations(c.build(rows), rows)


_LABELS = ("id", "label", "root_cause", "attack_path", "fix_commit", "introduced_in_commit", "cwe_top25", "pre_fix_code")


def _label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings' own label columns as a side table."""
    return _vulns(spark, sf_dir).select(*_LABELS)


_BUILT = f"""p AS (SELECT source_url, max(silent_fix_prob) AS sp FROM silent_fix WHERE source_url IS NOT NULL GROUP BY source_url),
v AS (SELECT e.* REPLACE (p.sp AS silent_fix_prob) FROM ethereum_vulns e LEFT JOIN p ON e.source_url = p.source_url), {_flags("v")},
n AS (SELECT * REPLACE (coalesce(nullif(cwe_top25, ''), 'N/A') AS cwe_top25, tier AS authority_tier) FROM k),
d AS (SELECT *, row_number() OVER (PARTITION BY coalesce(source_platform, ''), CASE WHEN coalesce(fix_commit, '') = '' THEN 'row ' || id ELSE fix_commit END ORDER BY {_RICH} DESC, id) AS rr FROM n),
{_FIRST_EST}, o AS (SELECT d.* EXCLUDE ({_EST}), {_TIER_CASE.format("e.severity_estimated")} AS severity_estimated, e.severity_source, e.impact_type FROM d LEFT JOIN e ON d.id = e.id WHERE rr = 1)"""


@query(f"WITH {_BUILT} SELECT id, score AS security_score, grade AS confidence, signals AS n_signals, authority_tier, silent_fix_prob, label, cwe_top25, fix_commit, severity_estimated, severity_source, impact_type FROM o")
def curated_build(spark, sf_dir):
    """The curation from side tables to survivors and estimates."""
    rows = c.build(_spread(spark, sf_dir), table(spark, sf_dir, "silent_fix"), _label_table(spark, sf_dir), table(spark, sf_dir, "severity_est"))
    return rows.select("id", "security_score", "confidence", "n_signals", "authority_tier", "silent_fix_prob", "label", "cwe_top25", "fix_commit", "severity_estimated", "severity_source", "impact_type")


@query(
    f"""WITH {_FLAGS}, n AS (SELECT * REPLACE (tier AS authority_tier) FROM k),
d AS (SELECT *, row_number() OVER (PARTITION BY coalesce(source_platform, ''), CASE WHEN coalesce(fix_commit, '') = '' THEN 'row ' || id ELSE fix_commit END ORDER BY {_RICH} DESC, id) AS rr FROM n),
{_FIRST_EST}, o AS (SELECT d.id, d.authority_tier, e.severity_source FROM d LEFT JOIN e ON d.id = e.id WHERE rr = 1)
SELECT 'kept' AS stage, count(*) AS n FROM k UNION ALL SELECT 'labelled', count(*) FILTER (coalesce(label, 'other') <> 'other') FROM k
UNION ALL SELECT 'severity:' || coalesce(severity_source, 'none'), count(*) FROM o GROUP BY 1 UNION ALL SELECT 'tier:' || authority_tier, count(*) FROM o GROUP BY 1"""
)
def build_report(spark, sf_dir):
    return c.funnel_with_stages(_spread(spark, sf_dir), _label_table(spark, sf_dir), table(spark, sf_dir, "severity_est"))


_URL = "coalesce(source_url, '')"
_IS_DEP = f"({_rx(_T, fixed.DEPENDENCY_TITLE)} OR {_rx(_URL, fixed.DEPENDENCY_URL, 'c')})"


@query(
    f"""WITH e AS (SELECT id, min(severity_estimated) AS est FROM severity_est GROUP BY id), r AS (SELECT id, severity, {_SEV} IN ('critical', 'high', 'medium', 'low') AS g, {_IS_DEP} AS dep, coalesce(est, '') AS est FROM ethereum_vulns LEFT JOIN e USING (id))
SELECT id, CASE WHEN g THEN severity WHEN dep THEN 'not-eligible' ELSE est END AS severity_estimated, CASE WHEN dep THEN 'upstream-cvss' WHEN g THEN 'bounty-graded' WHEN est <> '' THEN 'llm-estimated' ELSE 'unassessed' END AS severity_source FROM r"""
)
def severity_provenance(spark, sf_dir):
    estimates = table(spark, sf_dir, "severity_est").where("id is not null").groupBy("id").agg(F.min("severity_estimated").alias("estimate"))
    return sv.provenance(_vulns(spark, sf_dir), estimates)


@query(
    f"""WITH r AS (SELECT id, source_platform, {_SEV} IN ('critical', 'high', 'medium', 'low') AS g, {_IS_DEP} AS dep FROM ethereum_vulns)
SELECT id, 'validate' AS mode FROM r WHERE g AND NOT dep UNION ALL SELECT id, 'apply' FROM r WHERE NOT g AND NOT dep AND source_platform IN ({', '.join(f"'{x}'" for x in fixed.PLATFORM_ALIASES)})"""
)
def severity_targets(spark, sf_dir):
    modes = [sv.targets(_vulns(spark, sf_dir), mode).select("id", F.lit(mode).alias("mode")) for mode in ("validate", "apply")]
    return modes[0].unionByName(modes[1])


@query(
    f"""SELECT id, CASE WHEN stride IN ({', '.join(f"'{x}'" for x in fixed.STRIDE)}) THEN stride ELSE 'Other' END AS stride, CASE WHEN cwe_top25 IN ({', '.join(f"'{x}'" for x in fixed.CWE_TOP)}) THEN cwe_top25 ELSE 'N/A' END AS cwe_top25 FROM ethereum_vulns WHERE stride IS NOT NULL
UNION ALL SELECT id, 'Other', 'N/A' FROM ethereum_vulns WHERE stride IS NULL"""
)
def threat_answers(spark, sf_dir):
    """Answers in a code fence, made of the columns, read back; findings without an answer get the defaults."""
    rows = _vulns(spark, sf_dir)
    text = F.concat(F.lit("```json\n"), F.to_json(F.struct("stride", "cwe_top25")), F.lit("\n```\n"))
    return answers.threat_back(rows, rows.where("stride is not null").select("id", text.alias("answer"))).select("id", "stride", "cwe_top25")


_DOMAIN = {k: "(" + ", ".join(f"'{n}'" for n in dict.fromkeys([n for _, n in rules + fixed.COMMON_AREAS] + ["other"])) + ")" for k, rules in (("consensus", fixed.CONSENSUS_AREAS), ("execution", fixed.EXECUTION_AREAS))}


@query(
    f"""WITH t AS (SELECT *, coalesce(label, 'other') = 'other' OR coalesce(fix_commit, '') = '' AS todo, 'area-' || coalesce(layer, '') AS odd, CASE WHEN length(id) % 2 = 0 THEN 'evm' ELSE 'bls' END AS want FROM ethereum_vulns)
SELECT id, CASE WHEN todo AND ((layer = 'consensus' AND want IN {_DOMAIN['consensus']}) OR (layer IS DISTINCT FROM 'consensus' AND want IN {_DOMAIN['execution']})) THEN want ELSE label END AS label,
root_cause, CASE WHEN todo THEN 'peer' ELSE attack_path END AS attack_path, CASE WHEN todo AND want = 'evm' THEN 'CWE-190' ELSE cwe_top25 END AS cwe_top25 FROM t"""
)
def label_merge(spark, sf_dir):
    """Made-up answers over the labels: an area that only one layer has, no cause, a path, and an id that is one or is none."""
    rows = _vulns(spark, sf_dir)
    even = F.length("id") % 2 == 0
    fields = F.struct(F.when(even, "evm").otherwise("bls").alias("label"), F.lit("").alias("root_cause"), F.lit("peer").alias("attack_path"), F.when(even, "CWE-190").otherwise("CWE-x").alias("cwe"))
    told = rows.select("id", F.concat(F.lit("It is this.\n"), F.to_json(fields)).alias("answer"))
    return answers.merge_labels(rows, told).select("id", "label", "root_cause", "attack_path", "cwe_top25")


@query(
    "SELECT item_id::VARCHAR AS source_url, CASE WHEN f THEN 0.8::DOUBLE ELSE 0.4 END AS silent_fix_prob, f::INT AS is_security_fix, '' AS vuln_class, '' AS reason FROM (SELECT item_id, contains(lower(coalesce(title, '')), 'panic') OR contains(lower(coalesce(title, '')), 'overflow') AS f FROM eval_items)"
)
def fix_probability(spark, sf_dir):
    rows = infer.infer(table(spark, sf_dir, "eval_items"), F.coalesce("title", F.lit("")), "item_id", infer.keyword_stub)
    told = rows.select("key", infer.parse_answer(F.col("answer"), "is_security_fix boolean, confidence double, vuln_class string, reason string", "is_security_fix").alias("a"))
    return answers.fix_probability(told.select(F.col("key").alias("source_url"), "a.*"))


@query(
    f"SELECT item_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(concat_ws(' ', coalesce(title, ''), {_D}, coalesce(diff, '')), '{fixed.SUBSYSTEM}', 0, 'i'), lambda x: lower(x))))[1:6], ', ') AS subsystems, regexp_matches(coalesce(diff, ''), '{fixed.SOURCE_FILE}') AS touches_source FROM eval_items"
)
def item_subsystems(spark, sf_dir):
    from ..sources.records import touches_source

    return table(spark, sf_dir, "eval_items").select(
        "item_id", answers.subsystems(F.col("title"), F.col("description"), F.col("diff")).alias("subsystems"), touches_source(F.col("diff")).alias("touches_source")
    )


@query(
    "SELECT item_id, concat('Title: ', substr(coalesce(title, ''), 1, 200), chr(10), 'Text: ', substr(coalesce(description, ''), 1, 600), chr(10), 'Diff: ', substr(coalesce(diff, ''), 1, 2800)) AS prompt FROM eval_items"
)
def prompts(spark, sf_dir):
    text = answers.prompt("Title: {title}\nText: {description}\nDiff: {diff}", "fix", title=F.col("title"), description=F.col("description"), diff=F.col("diff"))
    return table(spark, sf_dir, "eval_items").select("item_id", text.alias("prompt"))


@query("SELECT source_platform = 'prysm' AS capped, least(count(*), (SELECT floor(count(*) * 0.02) FROM ethereum_vulns))::BIGINT AS n FROM ethereum_vulns WHERE source_platform = 'prysm' GROUP BY 1 UNION ALL SELECT false, count(*) FROM ethereum_vulns WHERE source_platform IS DISTINCT FROM 'prysm'")
def capped_sample(spark, sf_dir):
    """One platform cut to a share of the table."""
    rows = dedup.capped_share(_vulns(spark, sf_dir), F.col("source_platform") == "prysm", "id", 0.02)
    return rows.groupBy(F.coalesce(F.col("source_platform") == "prysm", F.lit(False)).alias("capped")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT label, least(count(*), 40) AS n FROM eval_items WHERE regexp_matches(coalesce(diff, ''), '" + fixed.SOURCE_FILE + "') GROUP BY label")
def sampled_items(spark, sf_dir):
    from ..sources.records import sampled_items as sample

    return sample(table(spark, sf_dir, "eval_items"), 40).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(severity, '') AS severity, count(*) AS n FROM crawl_findings GROUP BY 1")
def crawl_severities(spark, sf_dir):
    return table(spark, sf_dir, "crawl_findings").groupBy(F.coalesce("severity", F.lit("")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT id FROM ethereum_vulns WHERE {_rx(_T, fixed.SECURITY_TITLE)}")
def security_titles(spark, sf_dir):
    from ..sources.records import is_security_title

    return _vulns(spark, sf_dir).where(is_security_title(F.col("title"))).select("id")


@query(
    f"""{_HAY}, q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY vuln_class NULLS FIRST, reason NULLS FIRST) AS r FROM silent_fix WHERE source_url IS NOT NULL) WHERE r = 1),
t AS (SELECT h.id, concat_ws(' ', coalesce(q.reason, ''), hay) AS told, lower(coalesce(q.vuln_class, '')) AS vc FROM h LEFT JOIN q ON h.source_url = q.source_url),
c AS (SELECT id, vc, {_case('told', fixed.ROOT_CAUSES, '?')} AS rc, {_case('told', fixed.ATTACK_PATHS, 'malformed_input')} AS attack_path FROM t)
SELECT id, CASE WHEN rc <> '?' THEN rc ELSE CASE vc {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.CLASS_CAUSES.items())} ELSE 'other' END END AS root_cause, attack_path FROM c"""
)
def classify_with_reasons(spark, sf_dir):
    """Cause and path with a classifier's reason before the text, and its class where no pattern fits."""
    told = dedup.keep_first(table(spark, sf_dir, "silent_fix").where("source_url is not null"), ["source_url"], ["vuln_class", "reason"])
    return enrich.classify(_spread(spark, sf_dir), told).select("id", "root_cause", "attack_path")


@query("SELECT id FROM ethereum_vulns WHERE id NOT IN (SELECT id FROM severity_est WHERE id IS NOT NULL)")
def resume_worklist(spark, sf_dir):
    return infer.worklist(_vulns(spark, sf_dir), table(spark, sf_dir, "severity_est"), "id").select("id")


@query("SELECT item_id::VARCHAR AS key, contains(lower(coalesce(title, '')), 'panic') OR contains(lower(coalesce(title, '')), 'overflow') AS is_fix FROM eval_items")
def llm_stub_infer(spark, sf_dir):
    rows = infer.infer(table(spark, sf_dir, "eval_items"), F.coalesce("title", F.lit("")), "item_id", infer.keyword_stub)
    return rows.select("key", infer.parse_answer(F.col("answer"), "is_security_fix boolean, confidence double", "is_security_fix")["is_security_fix"].alias("is_fix"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts)::VARCHAR AS started, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """Extension: the windowed counts of the streaming module over a table."""
    from ..streaming.gate import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "event_type", "n")


@query(f"SELECT id, coalesce(nullif(regexp_extract(upper(concat_ws(' ', coalesce(issue_id, ''), {_D})), 'CVE-\\d{{4}}-\\d{{4,7}}', 0), ''), nullif(regexp_extract(upper(concat_ws(' ', coalesce(issue_id, ''), {_D})), 'GHSA-[0-9A-Z]{{4}}-[0-9A-Z]{{4}}-[0-9A-Z]{{4}}', 0), ''), regexp_extract(upper(concat_ws(' ', coalesce(issue_id, ''), {_D})), 'RUSTSEC-\\d{{4}}-\\d{{4}}', 0)) AS best FROM ethereum_vulns")
def best_identifier(spark, sf_dir):
    return _vulns(spark, sf_dir).select("id", enrich.best_id(F.coalesce("issue_id", F.lit("")), F.coalesce("description", F.lit(""))).alias("best"))


@query("SELECT id, regexp_replace(regexp_replace(lower(trim(coalesce(contest, ''))), '[^a-z0-9.-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, substr(trim(coalesce(title, '')), 1, 70) AS preview FROM ethereum_vulns")
def preview_rows(spark, sf_dir):
    return _vulns(spark, sf_dir).select("id", slug(F.coalesce("contest", F.lit(""))).alias("slug"), F.substring(F.trim(F.coalesce("title", F.lit(""))), 1, 70).alias("preview"))


@query(
    f"""WITH {_FLAGS}, x AS (SELECT id, {_T} AS t, regexp_matches(coalesce(source_url, ''), '{fixed.CHANGE_URL}') AND NOT {_rx(_T, fixed.BUMP_TITLE)} AS plain, {_rx(_T, fixed.FIX_TITLE)} AS fix, {_rx(_T, fixed.UNCLEAN_TITLE)} AS unclean,
  {_rx(_T, fixed.FEATURE_TITLE)} AS feature, {_rx(_BOTH, fixed.ITEM_ID)} AS hid FROM ethereum_vulns)
SELECT id, 1 AS label FROM x WHERE plain AND fix AND NOT unclean AND id IN (SELECT id FROM k) UNION ALL SELECT id, 0 FROM x WHERE plain AND feature AND NOT fix AND NOT hid"""
)
def evaluation_items(spark, sf_dir):
    from ..sources.records import labelled_items

    rows = _spread(spark, sf_dir)
    return labelled_items(c.curate(rows), rows)


@query(
    "SELECT item_id, substr(array_to_string(list_filter(string_split(diff, chr(10)), lambda s: starts_with(s, 'diff --git') OR starts_with(s, '@@') OR ((starts_with(s, '+') OR starts_with(s, '-')) AND NOT starts_with(s, '+++') AND NOT starts_with(s, '---'))), chr(10)), 1, 6000) AS summary FROM eval_items"
)
def diff_summary(spark, sf_dir):
    from ..sources.records import diff_summary as summary

    return table(spark, sf_dir, "eval_items").select("item_id", summary(F.col("diff")).alias("summary"))


@query("SELECT source, count(*) AS n, count(DISTINCT contest) AS contests, round(100.0::DOUBLE * count(*) FILTER (source_url IS NOT NULL AND source_url <> '') / count(*), 2) AS with_url FROM crawl_findings GROUP BY source")
def crawl_profile(spark, sf_dir):
    url = F.coalesce("source_url", F.lit("")) != ""
    return table(spark, sf_dir, "crawl_findings").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("contest").alias("contests"), F.round(100.0 * F.count_if(url) / F.count(F.lit(1)), 2).alias("with_url")
    )


@query("SELECT split_part(trim(issue_id), '#', 1) AS namespace, count(*) AS n FROM ethereum_vulns WHERE contains(issue_id, '#') GROUP BY 1")
def issue_namespaces(spark, sf_dir):
    rows = _vulns(spark, sf_dir).where(F.col("issue_id").contains("#"))
    return rows.groupBy(F.substring_index(F.trim("issue_id"), "#", 1).alias("namespace")).agg(F.count(F.lit(1)).alias("n"))
