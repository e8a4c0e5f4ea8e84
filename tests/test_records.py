"""Row constructors over hand-written records."""

from fixgrain.sources import records as r
from pyspark.sql import functions as F


def test_advisories(spark):
    df = spark.createDataFrame([("GHSA-a", "CVE-1", "moderate", "s", "d", "u", [("1.2",), (None,)]), (None, None, "high", "x", None, None, None), ("GHSA-b", None, None, None, None, None, None)], r.ADVISORY)
    (row,) = r.advisory_rows(df, "geth").collect()
    assert (row["severity"], row["title"], row["description"]) == ("Medium", "s [GHSA-a CVE-1]", "d\npatched_versions: 1.2")


def test_pulls_and_issues(spark):
    df = spark.createDataFrame([(1, "fix trie", "b", "u", "2020", None, ["bug"]), (1, "fix trie", "b", "u", "2020", None, ["bug"]), (2, "t", None, None, None, "x", None), (3, "u", None, None, "2020", None, ["skip"])], r.PULL)
    assert [(x["issue_id"], x["path_hint"]) for x in r.pull_rows(df, "geth", skip_labels=("skip",)).collect()] == [("PR#1", "trie")]
    assert sorted(x["issue_id"] for x in r.pull_rows(df, "geth", "ISSUE").collect()) == ["ISSUE#1", "ISSUE#3"]
    assert df.limit(1).select(r.security_relevant(F.col("title"), F.col("body"), ("trie",))).first()[0]


def test_releases(spark):
    df = spark.createDataFrame([("v1", None, "`high`-urgency", "u", "2020", False), ("v2", "n", None, None, None, True), ("v3", "n", None, None, None, None)], r.RELEASE)
    assert {x["tag_name"]: (x["urgency_level"], x["severity"], x["title"]) for x in r.urgency_rows(df).collect()} == {"v1": ("high", "High", "v1"), "v3": ("Unrated", "Unrated", "n")}


def test_osv_and_nvd(spark):
    df = spark.createDataFrame(
        [("GO-1", ["GHSA-z", "CVE-9"], "sum", "det", None, ("HIGH", None), [([("SEMVER", [("1.0", None)]), ("GIT", [("0", None), ("abc1234", None), (None, "deadbeef1")])],)]), ("RUSTSEC-1", None, None, None, None, None, None)], r.OSV
    )
    got = {x["issue_id"]: x for x in r.osv_rows(df, "reth").collect()}
    assert got["CVE-9"]["description"] == "det [fix_commit: deadbeef1]" and got["CVE-9"]["introduced_in_commit"] == "abc1234" and got["CVE-9"]["severity"] == "High"
    assert got["RUSTSEC-1"]["severity"] == "Unrated"
    nvd = spark.createDataFrame([("CVE-1", [("es", "x"), ("en", "in go-ethereum")], None, "HIGH", "LOW"), ("CVE-2", [("en", "gethostbyname")], None, None, None)], r.NVD)
    assert [(x["issue_id"], x["severity"]) for x in r.nvd_rows(nvd, "geth").collect()] == [("CVE-1", "High")]


def test_diff_summary_items_and_best_commit(spark):
    df = spark.createDataFrame([("diff --git a b\nindex 1\n@@ -1 +1 @@\n--- a\n+++ b\n ctx\n-a\n+b\ndiff else\n",)], "d string")
    assert df.select(r.diff_summary(F.col("d"))).first()[0] == "diff --git a b\n@@ -1 +1 @@\n-a\n+b"
    items = spark.createDataFrame([("1", "fix panic on peer", "", "x/pull/1"), ("2", "refactor names", None, "x/commit/2"), ("3", "refactor", "", "x"), ("4", None, None, None)], "id string, title string, description string, source_url string")
    assert {x["id"]: x["label"] for x in r.labelled_items(items, items).collect()} == {"1": 1, "2": 0}
    adv = spark.createDataFrame([("A", "v1", "overflow in trie decoder")], "advisory_id string, release string, text string")
    com = spark.createDataFrame([("v1", "s1", "build: trie decoder overflow"), ("v1", "s2", "decoder fix"), ("v1", "s3", "trie decoder")], "release string, sha string, subject string")
    assert tuple(r.best_commit(adv, com).first()) == ("A", "s3", 2)


def test_past_advisories_and_specifications(spark):
    df = spark.createDataFrame([(" GHSA-a ", None, "critical", "s ", None, "u", None), ("GHSA-b", None, "odd", "", "d", None, None), ("GHSA-c", None, "low", " ", None, None, None)], r.ADVISORY)
    assert {x["issue_id"]: (x["severity"], x["title"]) for x in r.past_advisory_rows(df, "geth", "a/b").collect()} == {"GHSA-a": ("High", "s"), "GHSA-b": ("Info", "")}
    pulls = spark.createDataFrame([(7, "Besu disagrees", "a consensus  split", "u", None, None, None), (8, None, "nothing named", None, None, None, None)], r.PULL)
    (row,) = r.cross_platform_rows(pulls, "geth", ("consensus",)).collect()
    assert (row["severity"], row["description"]) == ("High", "[cross-client: besu] a consensus  split")
    named = {x["issue_id"]: (x["source"], x["severity"]) for x in r.specification_rows(pulls, {"teku": ("Teku",), "besu": ("BESU",)}, "ISSUE").collect()}
    assert named == {"ISSUE#7": ("besu", "High"), "ISSUE#8": ("ethereum_specs", "Medium")}
    ids = pulls.select(r.ticket_id(F.lit("no"), F.lit("see teku-12, TEKU-9"), F.col("number")), r.ticket_id(F.lit(None), F.lit(""), F.col("number"))).first()
    assert tuple(ids) == ("TEKU-12", "PR#7")
    assert r.latest_releases(spark.createDataFrame([("v1", None, None, None, "2020", False), ("v2", None, None, None, "2021", None), ("v3", None, None, None, "2022", True)], r.RELEASE), 1).first()["tag_name"] == "v2"


def test_modules_count_an_advisory_once(spark):
    rows = [("GO-1", ["CVE-5"], "s", "d", [("CVSS:3.1 LOW",)], None, None), ("GHSA-x", ["CVE-5"], "s", "d", None, (None, "medium"), None), ("GO-2", None, "", "", None, None, None), ("GO-3", None, None, "x" * 600, None, None, None)]
    got = {x["issue_id"]: x for x in r.module_vulnerabilities(spark.createDataFrame(rows, r.OSV), "geth").collect()}
    assert set(got) == {"CVE-5", "GO-3"} and got["CVE-5"]["severity"] == "Medium" and len(got["GO-3"]["description"]) == 500 and got["GO-3"]["source_url"].startswith("https://pkg.go.dev/")
    df = spark.createDataFrame([("A", ["x", "RUSTSEC-1"]), ("B", None)], "id string, aliases array<string>")
    assert [x[0] for x in df.select(r.rustsec_id(F.col("id"), F.col("aliases"))).collect()] == ["RUSTSEC-1", "B"]


def test_sampled_items(spark):
    df = spark.createDataFrame([(k, k % 2, "a.go" if k % 3 else "a.md") for k in range(60)], "item_id long, label int, diff string")
    got = r.sampled_items(df, 5).collect()
    assert sorted(x["label"] for x in got) == [0] * 5 + [1] * 5 and all(x["diff"] == "a.go" for x in got)
    assert {x["item_id"] for x in got} == {x["item_id"] for x in r.sampled_items(df, 5).collect()} and r.sampled_items(df, 100).count() == 40
