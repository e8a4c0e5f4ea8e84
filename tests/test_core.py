"""Small hand-written frames for the engine's own operators."""

import json
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fixgrain.functions import fixed, text
from fixgrain.operators import answers, curate, dedup, diffs, enrich, graph, infer, profile, references, severity, validate
from fixgrain.sources import files

FINDING = "id string, source_platform string, contest string, issue_id string, severity string, title string, description string, stride string, cwe_top25 string, silent_fix_prob string"


def findings(spark, *rows):
    base = dict(id="a", source_platform="geth", contest="", issue_id="", severity="", title="", description="", stride="", cwe_top25="", silent_fix_prob=None)
    names = [c.split()[0] for c in FINDING.split(", ")]
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], FINDING)


def one(df, *columns):
    return tuple(df.select(*columns).first())


def test_text_helpers(spark):
    df = spark.createDataFrame([("  Foo Bar__v1.2! ", "nan", None, "CRITICAL bug")], "a string, b string, c string, d string")
    got = one(df, text.slug(F.col("a")), text.first_present(F.col("b"), F.col("c"), F.col("a")), text.filled(F.col("c")), text.capitalised(F.col("d")))
    assert got == ("foo-bar-v1.2", "Foo Bar__v1.2!", "", "Critical bug")
    assert one(df, text.title_key(F.lit(" Fix: a 'B' (c)! "))) == ("fix a b c",)


@given(st.text(max_size=30))
@settings(max_examples=15, deadline=None)
def test_slug_is_idempotent(spark, value):
    df = spark.createDataFrame([(value,)], "a string").select(text.slug(F.col("a")).alias("a"))
    assert one(df, "a") == one(df, text.slug(F.col("a")))


def test_gate_edges(spark):
    rows = findings(
        spark,
        {"id": "bump", "title": "Bump x"},
        {"id": "kept", "title": "Bump x", "description": "see RUSTSEC-2020-0001", "severity": "Low"},
        {"id": "bare", "title": "CVE-2020-1234", "description": "about gethostbyaddr"},
        {"id": "named", "title": "CVE-2020-1234", "description": "about go-ethereum"},
        {"id": "unknown", "title": "CVE-2020-1234", "source_platform": "other"},
        {"id": "fix", "title": "fix panic on peer"},
        {"id": "silent", "silent_fix_prob": "0.70"},
        {"id": "not", "silent_fix_prob": "0.699"},
        {"id": "text", "silent_fix_prob": "abc"},
        {"id": "nulls", "title": None, "description": None, "severity": None, "stride": None, "cwe_top25": None, "contest": None, "issue_id": None},
    )
    kept = {r["id"]: r for r in curate.curate(rows).collect()}
    assert set(kept) == {"kept", "named", "fix", "silent"}
    assert kept["named"]["score"] == 1.0 and kept["named"]["tier"] == "A_authoritative" and kept["fix"]["score"] == 0.5
    funnel = curate.funnel(rows).first()
    assert funnel["raw"] == 10 and funnel["kept"] == 4 and funnel["meta_work"] == 1 and funnel["misattributed"] == 2
    assert curate.curate(rows.limit(0)).count() == 0


def test_gate_reads_values_as_they_stand(spark):
    rows = findings(
        spark,
        {"id": "padded", "severity": " High "},
        {"id": "case", "severity": "HIGH"},
        {"id": "only-issue", "issue_id": "CVE-2020-1234"},
        {"id": "stride", "stride": "Spoofing"},
        {"id": "nan", "stride": "nan", "cwe_top25": "nan"},
    )
    got = {r["id"]: (r["score"], r["tier"], r["signals"]) for r in curate.curate(rows).collect()}
    assert got == {"case": (1.0, "A_authoritative", 1), "stride": (0.0, "C_candidate", 1)}
    more = rows.withColumn("comment_signal", F.lit("x")).withColumn("backport_signal", F.lit(" ")).withColumn("linked_issue_signal", F.lit(None).cast("string"))
    assert {r["id"]: r["signals"] for r in curate.curate(more).collect()} == {"case": 2, "stride": 2}
    bare = rows.select("id", "severity")
    assert [r["id"] for r in curate.curate(bare).collect()] == ["case"] and curate.funnel(bare).first()["kept"] == 1


def test_patterns_are_evaluated_once(spark):
    plan = curate.curate(findings(spark, {"id": "a"}))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= 27


def test_build_joins_labels_and_keeps_one_survivor(spark):
    url = "description string, source_url string, pre_fix_code string, fix_commit string, "
    base = findings(spark, {"id": "a", "severity": "High"}, {"id": "b", "severity": "High"}, {"id": "c", "severity": "High"}, {"id": "d", "severity": "High"}, {"id": "e"})
    rows = base.withColumn("source_url", F.concat(F.lit("u/"), "id")).withColumn("fix_commit", F.lit("old"))
    labels = spark.createDataFrame([("a", "evm", "s1", "", "[]"), ("b", "rpc", "s1", "CWE-1", "[1]"), ("c", "other", "", None, "[]"), ("a", "zzz", "s9", "", "[]")], "id string, label string, fix_commit string, cwe_top25 string, pre_fix_code string")
    estimates = spark.createDataFrame([("b", "CRITICAL", "x"), ("c", "not-eligible", "y")], "id string, severity_estimated string, severity_source string")
    silent = spark.createDataFrame([("u/e", 0.9), ("u/e", 0.2), (None, 1.0)], "source_url string, silent_fix_prob double")
    got = {r["id"]: r for r in curate.build(rows, silent, labels, estimates).collect()}
    assert set(got) == {"b", "c", "d", "e"}
    assert got["b"]["severity_estimated"] == "Critical" and got["c"]["severity_estimated"] == "not-eligible" and got["d"]["severity_estimated"] is None
    assert got["b"]["cwe_top25"] == "CWE-1" and got["c"]["cwe_top25"] == "N/A" and got["e"]["label"] is None and url


def test_planted_violations_are_found(spark):
    rows = findings(spark, *({"id": f"r{k}", "severity": "High"} for k in range(6)))
    kept = curate.build(rows.where("id < 'r3'").withColumn("source_url", F.lit("")))
    clean = {r["check"]: r["violations"] for r in validate.violations(kept, rows, least=1).collect()}
    assert set(clean.values()) == {0} and len(clean) == 8
    validate.require(validate.violations(kept, rows, least=1))
    broken = (
        kept.withColumn("severity", F.when(F.col("id") != "r0", F.col("severity")))
        .withColumn("confidence", F.when(F.col("id") == "r1", "sure").otherwise(F.col("confidence")))
        .withColumn("security_score", F.when(F.col("id") == "r1", 1.5).otherwise(F.lit(0.0)))
        .withColumn("title", F.when(F.col("id") == "r2", "high-urgency"))
        .withColumn("id", F.when(F.col("id") == "r2", "other").otherwise(F.col("id")))
        .drop("contest")
    )
    found = {r["check"]: r["violations"] for r in validate.violations(broken, rows.limit(2), least=5).collect()}
    assert found == {"boilerplate_left": 1, "without_signal": 1, "bad_confidence": 1, "bad_score": 1, "too_few_rows": 3, "missing_columns": 1, "not_in_input": 1, "not_smaller": 1}
    with pytest.raises(ValueError):
        validate.require(validate.violations(broken, rows))
    with pytest.raises(ValueError):
        validate.require_rows(rows.limit(0))


def test_severity_provenance_and_targets(spark):
    schema = "id string, source_platform string, severity string, title string, source_url string"
    rows = spark.createDataFrame([("a", "geth", "High", "x", None), ("b", "geth", "Low", "bump x", None), ("c", "geth", "", "netty", None), ("d", "geth", None, "x", ""), ("e", "who", None, "x", "")], schema)
    estimates = spark.createDataFrame([("d", "low"), ("e", "")], "id string, estimate string")
    got = {r["id"]: (r["severity_estimated"], r["severity_source"]) for r in severity.provenance(rows, estimates).collect()}
    assert got == {"a": ("High", "bounty-graded"), "b": ("Low", "upstream-cvss"), "c": ("not-eligible", "upstream-cvss"), "d": ("low", "llm-estimated"), "e": ("", "unassessed")}
    assert [r["id"] for r in severity.targets(rows, "validate").collect()] == ["a"] and [r["id"] for r in severity.targets(rows, "apply").collect()] == ["d"]
    pairs = spark.createDataFrame([("High", "high"), ("High", "low"), ("Low", "not-eligible"), ("Low", "error"), ("Low", None)], "truth string, predicted string")
    assert tuple(severity.agreement(pairs).first()) == (3, 1, 2, 1) and severity.confusion_pairs(pairs, most=2).count() == 2


def test_answers(spark):
    df = spark.createDataFrame([('```json\n{"stride": "Spoofing", "cwe_top25": "CWE-1"}\n```',), ('{"stride": "x"}',), ("broken",), (None,)], "a string")
    got = [tuple(r[0]) for r in df.select(answers.threat_answer(F.col("a"))).collect()]
    assert got == [("Spoofing", "N/A"), ("Other", "N/A"), ("Other", "N/A"), ("Other", "N/A")]
    labels = spark.createDataFrame([("1", "consensus", "other", "x", "p", "N/A", "c"), ("2", "execution", "evm", "x", "p", "N/A", "c")], "id string, layer string, label string, root_cause string, attack_path string, cwe_top25 string, fix_commit string")
    told = spark.createDataFrame([("1", 'so {"label": "evm", "root_cause": "r", "cwe": "CWE-20"}'), ("2", '{"label": "rpc"}')], "id string, answer string")
    assert {r["id"]: (r["label"], r["root_cause"], r["cwe_top25"]) for r in answers.merge_labels(labels, told).collect()} == {"1": ("other", "r", "CWE-20"), "2": ("evm", "x", "N/A")}
    text = answers.prompt("T {title} D {diff}", "fix", title=F.lit("t" * 300), diff=F.lit(None).cast("string"))
    assert df.select(text).first()[0] == "T " + "t" * 200 + " D "
    assert df.select(answers.subsystems(F.lit("EVM and the trie"), F.lit("evm"))).first()[0] == "evm, trie"


def test_references(spark):
    sha, parent = "ab12" * 10, "cd34" * 10
    commits = spark.createDataFrame([("geth", sha, parent)], "repo string, sha string, parent string")
    pulls = spark.createDataFrame([("geth", 77, sha)], "repo string, number long, sha string")
    tags = spark.createDataFrame([("geth", t, sha) for t in ("v1.9.0", "v1.10.0", "1.2.3", "nightly")] + [("besu", "v1.9.5", sha)], "repo string, tag_name string, sha string")
    previous = {(r["repo"], r["tag_name"]): r["previous"] for r in references.previous_releases(tags).collect()}
    assert previous == {("geth", "1.2.3"): None, ("geth", "v1.9.0"): "1.2.3", ("geth", "v1.10.0"): "v1.9.0", ("besu", "v1.9.5"): None}
    texts = spark.createDataFrame([("a", "geth", f"x/commit/{sha[:9]} and #77"), ("b", "geth", "fixed (#77)"), ("c", "geth", "[#77]"), ("d", "geth", "nr 77"), ("e", "besu", "/pull/77")], "id string, repo string, text string")
    assert {r["id"]: r["fix_commit"] for r in references.resolve_inline(texts, commits, pulls).collect()} == {"a": sha[:9], "b": sha, "c": sha, "d": None, "e": None}
    found = spark.createDataFrame([("a", "geth", "COMMIT#" + sha[:12]), ("b", "geth", "PR#77"), ("c", "geth", "RELEASE#v1.9.0#x"), ("d", "geth", "ISSUE#1"), ("e", "geth", None)], "id string, repo string, issue_id string")
    got = references.parents(found, commits, pulls, tags)
    assert {r["id"]: (r["kind"], r["introduced_in_commit"]) for r in got.collect()} == {"a": ("commit", parent), "b": ("pull", parent), "c": ("release", parent), "d": ("issue", ""), "e": ("unknown", "")}
    work = [("geth", "v1.9.0", "s1", "build: evm fix", ""), ("geth", "v1.9.0", "s2", "evm memory", "core/evm.go"), ("geth", "v1.9.0", "s3", "rpc", "")] + [("geth", "v1.10.0", f"t{k}", "evm", "") for k in range(7)]
    release_commits = spark.createDataFrame(work, "repo string, tag_name string, sha string, subject string, files string")
    advisories = spark.createDataFrame([("A", "geth", ">= 1.9.0", "evm memory fault"), ("B", "geth", "1.10.0", "evm"), ("C", "geth", "1.2.3", "first"), ("D", "geth", None, "none")], "advisory_id string, repo string, patched string, summary string")
    assert [tuple(r) for r in references.advisory_commits(advisories, tags, release_commits).collect()] == [("A", "s2")]


def test_small_text_functions(spark):
    df = spark.createDataFrame([("~1.0 || ^2", "no (HTTP 422)", "a b/c*", "YWJj\nZA==", "x\ny\n")], "v string, h string, u string, b string, l string")
    got = one(df, text.first_version(F.col("v")), text.http_status(F.col("h")), text.url_quoted(F.col("u")), text.decoded_base64(F.col("b")), text.lines(F.col("l")), text.http_status(F.col("u")))
    assert got == ("1.0", 422, "a%20b%2Fc%2A", "abcd", ["x", "y"], None)
    assert one(df, text.lines(F.lit("")), text.lines(F.lit("a\n\nb"))) == ([], ["a", "", "b"])


def test_profiles_and_capped_share(spark):
    sizes = spark.createDataFrame([(v,) for v in (0, 4, 5, 499, 500, 9999)], "loc int")
    assert [r["n"] for r in profile.histogram(sizes, "loc").orderBy("low").collect()] == [2, 1, 0, 0, 0, 0, 0, 1, 2]
    assert tuple(profile.completeness(sizes).first()) == (False, False)
    rows = spark.createDataFrame([(f"i{k}", "hot" if k < 700 else "x") for k in range(1000)], "id string, p string")
    cut = dedup.capped_share(rows, F.col("p") == "hot", "id", 0.3)
    assert {r["p"]: r["count"] for r in cut.groupBy("p").count().collect()} == {"hot": 300, "x": 300}
    assert dedup.capped_share(rows, F.col("p") == "x", "id", 0.9).count() == 1000
    assert {r["id"] for r in cut.collect()} == {r["id"] for r in dedup.capped_share(rows.repartition(3), F.col("p") == "hot", "id", 0.3).collect()}


def test_nested_code_documents(spark):
    import json

    diff = "diff --git a/y b/y.go\n@@ -1 +1 @@\n-old\n+new\ndiff --git a/x b/x.go\n@@ -3 +4 @@\n same\n@@ -9 +9 @@\n+tail"
    got = {r["key"]: r for r in diffs.documents(spark.createDataFrame([(1, diff), (2, None)], "k int, d string"), "k", "d").collect()}
    assert json.loads(got[1]["files_changed"]) == ["y.go", "x.go"] and got[2]["pre_fix_code"] == "[]"
    assert json.loads(got[1]["post_fix_code"]) == [{"file": "y.go", "hunks": [{"start_line": 1, "code": "new"}]}, {"file": "x.go", "hunks": [{"start_line": 4, "code": "same"}, {"start_line": 9, "code": "tail"}]}]


def test_merge_severity(spark):
    df = spark.createDataFrame([("Critical",), ("critical",), ("HIGH",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(enrich.merge_severity(F.col("s"))).collect()] == ["Critical", "High", "Info", "Unrated", "Unrated"]


def test_normalise_drops_empty_and_names_unknown(spark):
    rows = spark.createDataFrame([("Geth", "A b", "##7", "HIGH", "t", None, "u", None), (None, None, None, None, "only", "nan", None, None), ("x", "y", "1", "", " ", "nan", "", "")], ", ".join(f"{c} string" for c in enrich.CRAWL))
    got = {r["id"]: r for r in enrich.normalise(rows, "d", "t").collect()}
    assert "geth:a-b:7" in got and got["geth:a-b:7"]["severity"] == "High"
    assert len(got) == 2 and any(k.startswith("unknown:") for k in got)


def test_clusters_are_transitive(spark):
    sha = "a" * 39 + "1"
    schema = "id string, source_platform string, issue_id string, title string, description string, source_url string, introduced_in_commit string, severity string"
    rows = spark.createDataFrame(
        [
            ("A", "geth", "CVE-2020-1234", "x one", None, "u1", None, "Low"),
            ("B", "geth", "cve-2020-1234", "same title", None, "u2", None, "High"),
            ("C", "geth", "", "Same, title!", "fix " + sha, "", None, "High"),
            ("D", "besu", "", "other", None, "/commit/" + sha, None, None),
            ("E", "besu", "CVE-2020-1234", None, sha.upper(), None, None, None),
        ],
        schema,
    )
    assert {r["id"]: r["cluster_id"] for r in graph.clusters(rows).collect()} == {"A": "A", "B": "A", "C": "A", "D": "A", "E": "E"}
    top = {r["cluster_id"]: r for r in graph.collapse(rows).collect()}
    assert top["A"]["representative"] == "B" and top["A"]["size"] == 4
    assert graph.clusters(rows.limit(0)).count() == 0


def test_components_match_union_find(spark):
    import random

    rng = random.Random(3)
    edges = [(f"v{rng.randrange(60):02d}", f"v{rng.randrange(60):02d}") for _ in range(45)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {v: find(v) for v in got} and set(got) == {v for e in edges for v in e}


def test_dedup(spark):
    df = spark.createDataFrame([("k", 1, "b"), ("k", 1, "a"), ("k", 0, "c"), (None, 5, "z")], "k string, s int, t string")
    assert sorted(r["t"] for r in dedup.richest(df, ["k"], F.col("s"), "t").collect()) == ["a", "z"]
    assert [r["t"] for r in dedup.keep_first(df.where("k = 'k'"), ["k"], ["t"]).collect()] == ["a"]


def test_diff_hunks(spark):
    diff = "noise\ndiff --git a/x b/x.go\n@@ -3,2 +4 @@\n same\n-old\n--- lost\n+new\n\\ No newline\n@@ -9 +9 @@\n+tail\ndiff --git nothing\n@@ -1 +1 @@\n+ignored"
    got = {(r["file"], r["side"], r["start_line"]): r["code"] for r in diffs.hunks(spark.createDataFrame([(1, diff), (2, None)], "k int, d string"), "k", "d").collect()}
    assert got == {("x.go", "pre", 3): "same\nold", ("x.go", "post", 4): "same\nnew", ("x.go", "post", 9): "tail"}
    long = "diff --git a/y b/y\n@@ -1 +1 @@\n+" + "z" * 16_500 + "\n@@ -2 +2 @@\n" + "\n".join("+l" for _ in range(400)) + "\n@@ -500 +500 @@\n+more\n@@ -600 +600 @@\n+gone"
    codes = [r["code"] for r in diffs.hunks(spark.createDataFrame([(1, long)], "k int, d string"), "k", "d").orderBy("hunk").collect()]
    assert len(codes) == 3 and codes[0].endswith(diffs.CHARS_MARK) and codes[2] == diffs.LINES_MARK


def test_change_size(spark):
    doc = '[{"file":"a","hunks":[{"start_line":1,"code":"x\\ny"},{"start_line":4,"code":"z"}]}]'
    got = diffs.change_size(spark.createDataFrame([("a", doc), ("b", "[]"), ("c", None), ("d", "broken")], "id string, code string"), "code").collect()
    assert [(r["id"], r["n_files"], r["loc"]) for r in got] == [("a", 1, 3)]


def test_commit_rows_and_lines(spark):
    df = spark.createDataFrame([("s1", "Fix critical bug\n\nbody"), ("s2", "Merge x"), ("s3", "Revert y"), ("s4", None), ("s5", "a\nb")], "s string, m string")
    got = {r["sha"]: (r["title"], r["severity"]) for r in enrich.commit_rows(df, "s", "m").collect()}
    assert got == {"s1": ("Fix critical bug", "High"), "s5": ("a", "Info")}
    body = "# intro\n- fix a panic in sync\nrest\nfix a panic in sync\nhigh-urgency: security release"
    lines = enrich.security_lines(spark.createDataFrame([(1, body)], "k int, t string"), "k", "t").collect()
    assert [(r["line_no"], r["title"]) for r in lines] == [(2, "fix a panic in sync")]
    urgent = spark.createDataFrame([("x `medium-urgency`\nlow-urgency",), ("Urgency: High",), ("none",)], "b string")
    assert [r[0] for r in urgent.select(enrich.urgency_of_body(F.col("b"))).collect()] == ["medium", "high", None]


def test_identifiers_and_mentions(spark):
    df = spark.createDataFrame([("ghsa-aaaa-bbbb-cccc CVE-2020-12345", "geth", "Nethermind and go-ethereum fork_choice")], "t string, p string, d string")
    got = one(df, enrich.best_id(F.col("t")), enrich.other_platforms(F.col("p"), F.col("d")), enrich.path_hint(F.col("d")), enrich.class_cause(F.lit("DoS")))
    assert got == ("CVE-2020-12345", "nethermind", "fork_choice", "resource_exhaustion")


def test_inference_resumes_and_parses(spark):
    rows = spark.createDataFrame([("1", "a panic"), ("2", "fine"), ("3", None)], "id string, t string")
    left = infer.worklist(rows, spark.createDataFrame([("2",)], "id string"), "id")
    answers = infer.infer(left, F.col("t"), "id", infer.keyword_stub)
    parsed = answers.select("key", infer.parse_answer(F.col("answer"), "is_security_fix boolean, confidence double", "is_security_fix").alias("v")).collect()
    assert {r["key"]: r["v"] and r["v"]["is_security_fix"] for r in parsed} == {"1": True, "3": None}


def test_files_round_trip(spark, tmp_path: Path):
    rows = spark.createDataFrame([("a", 'say "x"\nthere', "d1"), ("b", None, "d2")], "id string, title string, domain string")
    files.write_csv(rows, str(tmp_path / "csv"), ("id", "title", "extra"))
    back = files.read_csv(spark, str(tmp_path / "csv"), ("id", "title", "extra")).orderBy("id").collect()
    assert back[0]["title"] == 'say "x"\nthere' and back[1]["id"] == "b"
    path = str(tmp_path / "t")
    files.write_parquet(rows, path)
    files.replace_parquet(spark.read.parquet(path).where("id = 'a'"), path)
    assert spark.read.parquet(path).count() == 1
    files.publish(rows, str(tmp_path / "p"))
    files.publish(rows.where("domain = 'd1'").withColumn("id", F.lit("z")), str(tmp_path / "p"))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "p")).collect()) == ["b", "z"]
    assert not Path(path + ".old").exists() and not Path(path + ".new").exists()
    assert files.preview(rows.withColumn("label", F.lit("x")).withColumn("title", F.lit("t" * 90))).first().asDict() == {"label": "x", "title": "t" * 70}
    tree = files.stage(rows, str(tmp_path / "out"), "some-domain", {"kept": 2}, "# read", dry_run=True)
    assert len(tree) == 3 and not (tmp_path / "out").exists()
    files.stage(rows, str(tmp_path / "out"), "some-domain", {"kept": 2}, "# read")
    assert json.loads((tmp_path / "out/some-domain/manifest.json").read_text())["n_rows"] == 2 and spark.read.parquet(tree[0]).count() == 2
    files.valid_names("me/data", "some-domain", ("me",))
    for bad in (("me", "d"), ("you/data", "d"), ("me/data", "Some_Domain")):
        with pytest.raises(ValueError):
            files.valid_names(*bad, ("me",))
    (tmp_path / "j.json").write_text('[{"a": 1}][{"a": 2}]')
    assert files.read_joined_arrays(spark, str(tmp_path / "j.json"), "struct<a:int>").count() == 2
    (tmp_path / "j2.json").write_text('[{"a": "x][y"}] [{"a": "\\"]["}, {"a": "z"}]')
    assert [r["a"] for r in files.read_joined_arrays(spark, str(tmp_path / "j2.json"), "struct<a:string>").collect()] == ["x][y", '"][', "z"]
    for name, value in (("a/z", "1"), ("a/y", "2"), ("b/x", "3")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / f"{name}.csv").write_text(f"id,title\n{value},t\n")
    folders = [str(tmp_path / k) for k in ("a", "none", "b")]
    assert [r["id"] for r in files.read_csv_folders(spark, folders, ("id", "title")).orderBy("_order").collect()] == ["2", "1", "3"]
    assert files.read_csv_folders(spark, folders[1:2], ("id", "title")).count() == 0


def test_stream_equals_batch(spark, tmp_path: Path):
    from fixgrain.streaming.gate import gated

    rows = findings(spark, {"id": "x", "title": "fix panic on peer"}, {"id": "y", "title": "nothing"})
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = gated(stream).select("id", "tier").writeStream.format("memory").queryName("gate_out").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("gate_out").collect()] == [tuple(r) for r in curate.curate(rows).select("id", "tier").collect()]


def test_stream_drops_repeats_and_counts_windows(spark, tmp_path: Path):
    from fixgrain.streaming.gate import new_only, windowed_counts

    rows = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP '2024-01-01 00:10:00', 'x', 1.0D), ('a', TIMESTAMP '2024-01-01 00:11:00', 'x', 1.0D), ('b', TIMESTAMP '2024-01-01 01:10:00', 'y', 2.0D) AS t(k, ts, event_type, value)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = new_only(stream, "k", "ts", "1 hour").writeStream.format("memory").queryName("new_out").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["k"] for r in spark.table("new_out").collect()) == ["a", "b"]
    counts = windowed_counts(stream, delay="10 minutes").writeStream.outputMode("complete").format("memory").queryName("count_out").start()
    counts.processAllAvailable()
    counts.stop()
    batch = {(r["window"]["start"], r["event_type"]): (r["n"], r["total"]) for r in windowed_counts(rows).collect()}
    assert {(r["window"]["start"], r["event_type"]): (r["n"], r["total"]) for r in spark.table("count_out").collect()} == batch and len(batch) == 2


def test_other_readers(spark, tmp_path: Path):
    (tmp_path / "d.json").write_text('[{"a": 1,\n "b": "x"}, {"a": 2}]')
    assert [tuple(r) for r in files.read_json_documents(spark, str(tmp_path / "d.json"), "a int, b string").collect()] == [(1, "x"), (2, None)]
    spark.createDataFrame([("a", "geth")], "id string, source_platform string").write.parquet(str(tmp_path / "f"))
    assert files.load_findings(spark, str(tmp_path / "f")).first()["source"] == "geth" and "source" not in files.load_findings(spark, str(tmp_path / "f"), False).columns
    urls = spark.createDataFrame([("CVE-1",), ("GHSA-1",), ("RUSTSEC-1",), ("x",)], "i string").select(enrich.advisory_url(F.col("i"))).collect()
    assert [r[0][-6:] for r in urls] == ["/CVE-1", "GHSA-1", "1.html", ""]


def test_normalise_with_limits(spark):
    rows = spark.createDataFrame([("code4rena", "A b", "#7", "high", "t"), ("geth", "c", "1", "low", "t"), (None, "c", "2", "HIGH", "t")], "source string, contest string, issue_id string, severity string, title string")
    got = {r["id"]: r["source_url"] for r in enrich.normalise(rows, "d", "t", platform_hint="hint").collect()}
    assert got == {"code4rena:a-b:7": "https://github.com/code-423n4/a-b/issues/7", "geth:c:1": "", "hint:c:2": ""}
    assert enrich.normalise(rows, "d", "t", platforms=("Geth ",)).count() == 1 and enrich.normalise(rows, "d", "t", severities=("high",)).count() == 2


SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_queries_equal_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from fixgrain.plans import catalogue

    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")

    def rows(frame):
        frame = frame[sorted(frame.columns)]
        return sorted(tuple("-" if v is None or v != v else repr(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False, name=None))

    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
    for name in catalogue.SQL:
        assert rows(catalogue.QUERIES[name](spark, str(SF)).toPandas()) == rows(con.sql(catalogue.SQL[name]).df()), name


def test_fixed_patterns_compile_in_both_dialects(spark):
    import re

    for rules in (fixed.CONSENSUS_AREAS, fixed.EXECUTION_AREAS, fixed.COMMON_AREAS, fixed.ROOT_CAUSES, fixed.ATTACK_PATHS):
        for pattern, _ in rules:
            re.compile(pattern)
