"""Edge cases and brute-force comparisons of the training-data operators."""

import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixgrain.llm import commits, groups, leaks, mixing, quality, residue, splits, survivors, truncation
from fixgrain.runtime import Scratch

FULL = "ab12" * 10
OTHER = "cd34" * 10


def find_roots(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {v: find(v) for v in list(parent)}


def random_edges(seed):
    rng = random.Random(seed)
    edges = [(f"v{rng.randrange(50):02d}", f"v{rng.randrange(50):02d}") for _ in range(40)]
    return edges + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(30)] + [("hub", f"x{i:02d}") for i in range(30)]


def partition(pairs):
    out = {}
    for vertex, root in pairs:
        out.setdefault(root, set()).add(vertex)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("seed", [1])
def test_components_by_both_methods(spark, seed):
    edges = random_edges(seed)
    df = spark.createDataFrame([*edges, (None, "q"), edges[0], edges[0][::-1]], "a string, b string")
    want = find_roots(edges)
    got = {r["vertex"]: r["root"] for r in groups.hash_to_min(df).collect()}
    assert got == {v: r for v, r in want.items() if v in got} and all(want[v] == v for v in set(want) - set(got))
    front = partition((r["vertex"], r["root"]) for r in splits.frontier_components(df).collect())
    assert front == partition(want.items())
    assert groups.hash_to_min(df.limit(0)).count() == 0 and splits.frontier_components(df.limit(0)).count() == 0


def test_commit_spellings(spark):
    values = [FULL, FULL.upper(), f" {FULL}\n", f"commit {FULL}", f"https://x.example/a/commit/{FULL}", FULL[:12], "0" * 40, "nan", "N/A", "", None, "zz", FULL[:6]]
    df = spark.createDataFrame([(v,) for v in values], "c string")
    got = [r[0] for r in df.select(commits.commit_hash(F.col("c"))).collect()]
    assert got == [FULL] * 5 + [FULL[:12]] + [None] * 7


def vulns(spark, rows):
    names = "id source_platform fix_commit severity issue_id authority_tier scraped_at title description pre_fix_code post_fix_code".split()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} string" for n in names)).withColumn("unit_id", F.lit("clash"))


def test_units_and_splits(spark):
    rows = vulns(
        spark,
        [
            {"id": "b", "source_platform": "x", "fix_commit": FULL},
            {"id": "a", "source_platform": "y", "fix_commit": FULL[:15].upper()},
            {"id": "c", "source_platform": "y", "fix_commit": FULL[:12]},
            {"id": "c", "source_platform": "y", "fix_commit": FULL[:12]},
            {"id": "d", "source_platform": None, "fix_commit": "0" * 40},
            {"id": "e", "source_platform": "x", "fix_commit": OTHER},
            {"id": None, "fix_commit": FULL},
        ],
    )
    units = {r["id"]: (r["unit_id"], r["unit_size"]) for r in splits.commit_units(rows).collect()}
    assert units == {"a": ("a", 3), "b": ("a", 3), "c": ("a", 3), "d": ("d", 1), "e": ("e", 1)}
    got = splits.split_records(rows, [("train", 0.5), ("test", 0.5)]).collect()
    assert len(got) == 5
    assert len({r["commit_split"] for r in got if r["id"] in "abc"}) == 1 and len({r["platform_split"] for r in got if r["source_platform"] == "y"}) == 1
    assert splits.commit_units(rows.limit(0)).count() == 0


def test_planted_split_violations(spark):
    records = spark.createDataFrame([(k,) for k in "abcd"], "id string")
    good = [("a", "x", "u", "train", "train"), ("b", "x", "u", "train", "train"), ("c", "y", "v", "test", "test"), ("d", "y", "w", "test", "test")]
    schema = "id string, source_platform string, unit_id string, commit_split string, platform_split string"
    targets = [("train", 0.5), ("test", 0.5)]
    check = lambda rows: {r["check"]: r["n"] for r in splits.split_violations(records, spark.createDataFrame(rows, schema), targets).collect()}
    assert set(check(good).values()) == {0}
    bad = [good[0], ("b", "x", "u", "test", "test"), *good[2:3], good[2]]
    assert check(bad) == {"commit_split of one unit_id": 1, "platform_split of one source_platform": 1, "rows of one id": 2, "shares off target": 0}


def test_planted_mix_violations(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    report = spark.createDataFrame([("a", True, 100, 100.0), ("b", True, 5, 100.0)], "source string, can_reach boolean, mix_tokens long, wanted_tokens double")
    mix = spark.createDataFrame([(0, "a", 1, 0, 3), (1, "a", 1, 1, 3), (1, "b", 2, 0, 3), (2, "b", 2, 1, 3), (3, "c", 9, 0, 3)], "slot long, source string, doc_id long, repetition int, n_tokens long")
    assert {r["check"]: r["n"] for r in mixing.mix_violations(docs, targets, mix, report).collect()} == {"repeats": 1, "sources": 1, "slots": 1, "sizes": 1}


def test_split_shares_with_a_hot_unit(spark):
    units = spark.createDataFrame([("hot", 1000)] + [(f"u{i}", 1) for i in range(2000)], "unit_id string, unit_size long")
    sizes = Counter()
    for r in splits.assign_splits(units, [("train", 0.8), ("a", 0.1), ("b", 0.1)]).join(units, F.col("unit") == F.col("unit_id")).collect():
        sizes[r["split"]] += r["unit_size"]
    assert sum(sizes.values()) == 3000 and abs(sizes["train"] - 2400) < 60 and abs(sizes["a"] - 300) < 60


def test_survivors(spark):
    rows = vulns(
        spark,
        [
            {"id": "m2", "source_platform": "x", "fix_commit": FULL[:16], "authority_tier": "a_authoritative", "scraped_at": "2024-01-01T00:00:00Z", "severity": "nan", "issue_id": "PR#1", "title": "one two three"},
            {"id": "m1", "source_platform": "x", "fix_commit": FULL, "authority_tier": "B_corroborated", "scraped_at": "2024-01-01T02:00:00+02:00", "severity": " high ", "issue_id": "ghsa-aaaa-bbbb-cccc", "title": "one two four"},
            {"id": "m0", "source_platform": "x", "fix_commit": FULL, "authority_tier": "B_corroborated", "scraped_at": None, "severity": "Low", "issue_id": " CVE-2020-1234", "title": "one two four"},
            {"id": "n", "source_platform": "y", "fix_commit": FULL, "authority_tier": None},
        ],
    )
    got = {r["field_name"]: (r["group_id"], r["from_id"]) for r in survivors.survivors(rows, (*survivors.RANKED, "title")).collect()}
    # Weight 4 of the best member against 2 + 2 for the other title: on a tie the best member's stays.
    assert got == {"record": ("m0", "m2"), "severity": ("m0", "m1"), "issue_id": ("m0", "m1"), "fix_commit": ("m0", "m1"), "title": ("m0", "m2")}
    assert survivors.survivors(rows.limit(0)).count() == 0


def test_the_survivor_has_every_column(spark):
    rows = vulns(spark, [{"id": k, "source_platform": "x", "fix_commit": FULL, "authority_tier": tier, "post_fix_code": code} for k, tier, code in (("a", "A", "nan"), ("b", "B", "[1]"), ("c", "C", None))])
    rows = rows.withColumn("n_signals", F.when(F.col("id") == "c", 3).cast("int")).withColumn("security_score", F.when(F.col("id") == "b", 0.1))
    (got,) = survivors.whole_survivors(rows).collect()
    assert set(rows.columns) - {"id"} <= set(got.asDict()) and got["record_id"] == "a" and got["n_members"] == 3
    assert (got["post_fix_code"], got["n_signals"], got["security_score"], got["source_platform"], got["title"]) == ("[1]", 3, 0.1, "x", None)
    assert dict(survivors.whole_survivors(rows).dtypes)["n_signals"] == "int"


def test_a_large_group_by_rank(spark):
    rows = vulns(spark, [{"id": f"i{k:04d}", "source_platform": "x", "fix_commit": FULL, "authority_tier": "C", "scraped_at": f"2024-01-01T00:{k // 60:02d}:{k % 60:02d}Z"} for k in range(300)])
    got = {r["field_name"]: r["from_id"] for r in survivors.survivors(rows).collect()}
    assert got == {"record": "i0299", "fix_commit": "i0299"}


def brute_consensus(values):
    """(value, weight) best first -> the winning tokens, by a full table of columns."""
    guide = values[0][0].split()
    votes = {}
    for text, weight in values[1:]:
        for column, slot, token in survivors.changes(guide, text.split()):
            votes.setdefault((column, slot), Counter())[token] += weight
    total = sum(w for _, w in values)
    won = []
    for (column, slot), own in votes.items():
        top = max(own.values())
        if top > total - sum(own.values()):
            won.append((column, slot, max(t or "" for t, w in own.items() if w == top) or None))
    return survivors.apply_changes(guide, won)


def test_consensus_of_planted_groups(spark):
    rng = random.Random(1)
    rows, want, brute = [], {}, 0
    for g in range(60):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(8, 60))]
        n = rng.randrange(4, 9) if g else 300
        clean = rng.randrange(n)
        own = []
        for m in range(n):
            text = base[:]
            for _ in range(rng.randrange(2, 5) if m != clean else 0):
                k, op = rng.randrange(len(text)), rng.random()
                text[k : k + (op < 0.75)] = [] if 0.5 < op < 0.75 else [f"x{rng.randrange(10**6)}"]
            own.append(" ".join(text))
        rows += [(f"g{g}", "title", v, (2, m, f"{g}-{m:03d}")) for m, v in enumerate(own)]
        want[f"g{g}"] = f"{g}-{clean:03d}"
        brute += brute_consensus([(v, 1.0) for v in own]) == " ".join(base)
    cells = spark.createDataFrame(rows, "group_key string, field_name string, value string, trust struct<tier:int,age:long,id:string>")
    got = {r["group_key"]: r["from_id"] for r in survivors.consensus_fields(cells, Scratch(spark, "planted")).collect()}
    assert sum(got[k] == v for k, v in want.items()) >= 57 and brute >= 50 and got["g0"] == want["g0"]


def test_alignment_votes():
    assert brute_consensus([("a b c", 1.0), ("a x c", 1.0), ("a x c d", 1.0)]) == "a x c"
    assert survivors.distance("a b", "a b") == 0.0 and survivors.distance("a", "b") == 1.0
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randrange(12))] for _ in range(2))
        found = survivors.matching(a, b)
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in found) and all(p[0] + p[2] <= q[0] and p[1] + p[2] <= q[1] for p, q in zip(found, found[1:]))
        assert survivors.apply_changes(a, survivors.changes(a, b)) == " ".join(b)


def test_residue_is_decided_by_the_model(spark, monkeypatch):
    cases = ["Please enable JavaScript to go on.", "404 Not Found", "Lorem ipsum dolor", "[object Object]", "## Motivation\n\n- [ ] tests\n- [ ] docs", "Fixed in {{ release }}.", "Thanks to <TEAM> for the report."]
    fine = ["The renderer left {{ .Host }} unescaped in the status page.", "rpc: return 429 instead of 500 for unknown slots", "Stops a panic.\n\n- [x] tests added\n- [ ] docs for it", "nan", "", None]
    assert all(any(residue.weak_labels(residue.segments(c))) for c in cases)
    assert not any(any(residue.weak_labels(residue.segments(c))) for c in fine if not residue.missing(c))
    rows = vulns(spark, [{"id": f"c{k}", "source_platform": f"p{k % 5}", "title": "fix a panic", "description": c} for k, c in enumerate(cases * 5)] + [{"id": f"f{k}", "title": None, "description": c} for k, c in enumerate(fine * 5)])
    got = {(r["id"], r["field_name"]) for r in residue.residue_scores(rows).collect()}
    assert not any(i.startswith("f") for i, _ in got) and len(got) >= 25
    # Nothing but the weights is needed for scoring: without the rules the scores are the same.
    model = residue.train(rows)
    scored = residue.judge(model, cases + fine, False)
    monkeypatch.setattr(residue, "weak_label", None)
    assert (residue.judge(model, cases + fine, False) == scored).all() and (scored[: len(cases)] >= model.threshold).sum() >= 6
    assert residue.residue_scores(rows.limit(0)).count() == 0
    empty = residue.Model(np.zeros(residue.WIDTH + 1), 0.6)
    assert len(residue.judge(empty, ["x " * 200_000, None, ""], False)) == 3


def test_validation_counts_all_records(spark):
    rows = vulns(spark, [{"id": f"v{k}", "source_platform": f"p{k % 30}", "title": "fix a panic", "description": "404 Not Found" if k % 9 == 0 else f"The sync of node {k} stops."} for k in range(600)])
    got = {r["hosts"]: r for r in residue.validation(rows, sample=20).collect()}
    assert got["seen"]["n_segments"] + got["unseen"]["n_segments"] == 1200 and got["seen"]["n_residue"] + got["unseen"]["n_residue"] == 67
    assert all(r["n_segments"] and 0 <= r["precision"] <= 1 and 0 <= r["recall"] <= 1 for r in got.values())
    assert [r["n_segments"] for r in residue.validation(rows.limit(0)).collect()] == [0, 0]


def test_truncation(spark):
    sentences = ["When a slow peer sends a stale frame the queue stops being updated.", "The new version sorts each range before any write.", "It affects most relays upgraded in place."]
    rng = random.Random(2)
    rows = [{"id": f"w{k}", "source_platform": "x", "title": "t", "description": " ".join(rng.sample(sentences, 3))} for k in range(120)]
    code = '[{"file": "a.go", "hunks": [{"start_line": 1, "code": "x = f(1)\\n}"}]}]'
    rows += [
        {"id": "cut1", "description": sentences[0] + " The new version sorts each ran"},
        {"id": "cut2", "description": sentences[0] + " The new version… [truncated]"},
        {"id": "whole", "description": sentences[0] + " It affects most relays upgraded in place"},
        {"id": "code", "pre_fix_code": code[:40], "post_fix_code": code},
        {"id": "open", "pre_fix_code": code.replace("\\n}", "\\nfor a {"), "post_fix_code": "[]"},
        {"id": "inner", "pre_fix_code": code.replace("f(1)\\n}", "f(1"), "post_fix_code": None},
        {"id": "none", "description": None, "pre_fix_code": "nan", "post_fix_code": ""},
    ]
    cases, totals = truncation.cut_values(vulns(spark, rows))
    assert {(r["id"], r["field_name"]) for r in cases.collect()} == {("cut1", "description"), ("cut2", "description"), ("code", "pre_fix_code"), ("inner", "pre_fix_code")}
    assert {r["field_name"]: r["n"] for r in totals.groupBy("field_name").agg(F.sum("n_values").alias("n")).collect()}["pre_fix_code"] == 3
    assert truncation.cut_values(vulns(spark, rows).limit(0))[0].count() == 0


def test_the_tries_decide_on_broken_words(spark):
    rng = random.Random(3)
    sentences = ["The new version sorts each range before any write.", "When a slow peer waits the queue stops.", "We measured every window of the synchroniser."]
    lines = ["buffer := allocate(size);", "synchroniser.run(window);", "if total > limit {", "}", "count += window"]
    rows = []
    for k in range(200):
        code = "\n".join(rng.choices(lines, k=6)) + "\n}"
        rows.append({"id": f"w{k}", "description": " ".join(rng.sample(sentences, 3)), "pre_fix_code": json.dumps([{"file": "a", "hunks": [{"start_line": 1, "code": code}]}])})

    def hunk(last):
        return json.dumps([{"file": "a", "hunks": [{"start_line": 1, "code": "}\n" + last}]}])

    rows += [
        # The ending is one of whole sentences, but the word is only part of one; then a whole word there.
        {"id": "part", "description": sentences[1] + " Odd news about a synch"},
        {"id": "long", "description": "x" * 3000 + " end."},
        {"id": "codepart", "pre_fix_code": hunk("count += win")},
        {"id": "codewhole", "pre_fix_code": hunk("count += window")},
        {"id": "codeopen", "pre_fix_code": hunk("total > limit >")},
    ]
    cases = {(r["id"], r["field_name"]): r["broken_word"] for r in truncation.cut_values(vulns(spark, rows))[0].collect()}
    assert cases == {("part", "description"): True, ("codepart", "pre_fix_code"): True, ("codeopen", "pre_fix_code"): False}


def test_copies_of_a_cut_text_do_not_vouch_for_each_other(spark):
    whole = "The new version sorts each range before any write. When a slow peer waits the queue stops."
    rows = [{"id": f"w{k}", "description": whole + f" Number {k} ends here."} for k in range(60)]
    rows += [{"id": f"c{k}", "description": whole + "\nThe new version sorts each ran"} for k in range(40)]
    got = {r["id"] for r in truncation.cut_values(vulns(spark, rows))[0].collect()}
    assert got == {f"c{k}" for k in range(40)}


def test_consolidate(spark):
    records = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,), ("a",)], "id string")
    matches = spark.createDataFrame(
        [("b", "a", "match"), ("b", "c", "match"), ("c", "b", "Match "), ("d", "d", "match"), ("d", None, "match"), ("d", "zz", "match"), ("d", "a", "no_match")],
        "left_id string, right_id string, verdict string",
    )
    got = {r["id"]: (r["group_id"], r["linked"]) for r in groups.consolidate(records, matches).collect()}
    assert got == {"a": ("a", True), "b": ("a", True), "c": ("a", True), "d": ("d", False)}
    assert groups.consolidate(records, matches.limit(0)).count() == 4


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


def test_leaks_against_what_was_planted(spark):
    rng = random.Random(4)
    items = [(k, prose(rng, 80) + ". All times are given in the common zone and nothing else is meant by that here", "\n".join("+ " + prose(rng, 6) for _ in range(12))) for k in range(20)] + [(99, None, "")]
    docs, want = [], set()
    for k in range(120):
        body = prose(rng, 120).split()
        item = items[k % 20]
        if k % 3 == 0:
            words = item[1].split()[10:45]
            if k % 2:
                words[12] = "changed"
            body[40:40] = [w.upper() + "," for w in words]
            want.add((item[0], k))
        elif k % 3 == 1:
            body[30:30] = item[1].split()[5:20] + ["stop"] + item[1].split()[80:]
        docs.append((k, " ".join(body)))
    docs += [(500, items[3][2].replace("+", "> ")), (501, None), (502, "")]
    want.add((3, 500))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
    i = spark.createDataFrame(items, "item_id long, description string, diff string")
    got = {(r["item_id"], r["doc_id"]) for r in leaks.leaks(d, i).collect()}
    assert len(got & want) >= 0.9 * len(want) and got <= want
    assert leaks.leaks(d.limit(0), i).count() == 0 and leaks.leaks(d, i.limit(0)).count() == 0


def test_a_passage_around_a_phrase_of_several_items_is_found(spark):
    rng = random.Random(5)
    phrase, notice = prose(rng, 10), prose(rng, 40)
    items = [(k, f"{prose(rng, 30)} {phrase} {prose(rng, 30)} {notice}", None) for k in range(6)]
    docs = [(k, f"{prose(rng, 60)} {' '.join(items[k][1].split()[20:50])} {prose(rng, 60)}") for k in range(6)]
    docs += [(9, f"{prose(rng, 60)} {notice} {prose(rng, 60)}")]
    got = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, description string, diff string"))
    assert {(r["item_id"], r["doc_id"]) for r in got.collect()} == {(k, k) for k in range(6)}


def test_short_lines_and_edited_passages_of_least_length_are_found(spark):
    rng = random.Random(6)
    items = [(k, prose(rng, 90), "\n".join("+ " + prose(rng, 2) for _ in range(14))) for k in range(12)]
    docs, want = [], set()
    for k in range(120):
        words = items[k % 12][1].split()[k // 2 : k // 2 + 25]
        words[8], words[16] = "changed", "too"
        docs.append((k, f"{prose(rng, 60)} {' '.join(words)} {prose(rng, 40 + k)}"))
        lines = items[k % 12][2].split("\n")[k % 8 : k % 8 + 6]
        docs.append((k + 1000, prose(rng, 30 + k) + "\n" + "\n".join(lines) + "\n" + prose(rng, 30)))
        want |= {(k % 12, k), (k % 12, k + 1000)}
    got = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, description string, diff string"))
    assert {(r["item_id"], r["doc_id"]) for r in got.collect()} == want


def test_items_beyond_one_index_are_found(spark, monkeypatch):
    rng = random.Random(8)
    items = [(k, prose(rng, 60), None) for k in range(9)]
    docs = [(k, f"{prose(rng, 60)} {' '.join(items[k][1].split()[10:45])} {prose(rng, 60)}") for k in range(9)]
    monkeypatch.setattr(leaks, "SHARD", 150)
    got = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, description string, diff string"))
    assert {(r["item_id"], r["doc_id"]) for r in got.collect()} == {(k, k) for k in range(9)}


def test_a_quotation_does_not_hide_a_passage(spark):
    rng = random.Random(7)
    items = [(k, prose(rng, 60), None) for k in range(6)]
    docs = []
    for k in range(6):
        words = items[k][1].split()
        edited = words[20:45]
        edited[8], edited[17] = "changed", "too"
        docs.append((k, f"{prose(rng, 60)} {' '.join(words[20:44])} {prose(rng, 60)} {' '.join(edited)} {prose(rng, 60)}"))
    got = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, description string, diff string"))
    assert {(r["item_id"], r["doc_id"]) for r in got.collect()} == {(k, k) for k in range(6)}


def searched(items, texts):
    """What the search finds with an index of the items' passages, without a session."""
    known = leaks.Items(items)
    rng = np.random.default_rng(1)
    rows = rng.standard_normal((len(known.vocabulary) + 1, leaks.RANK)).astype(np.float32)
    rows[-1] = 0
    own = [np.array([known.vocabulary.get(w, len(known.vocabulary)) for w in leaks.words_of(t)], np.int32) for t in texts]
    group = [(k, x, leaks.starts(len(x), leaks.STEP)) for k, x in enumerate(own)]
    return {x[:2] for x in leaks._search_group(group, list(range(len(texts))), *leaks._index(known.texts, rows, rng), leaks.COSINE)}


def test_the_latent_search_reaches_all_passages(monkeypatch):
    rng = random.Random(9)
    items = [(k, prose(rng, 80), "\n".join("+ " + prose(rng, 5) for _ in range(12))) for k in range(10)]
    texts = []
    for k in range(40):
        words = items[k % 10][1].split()[k : k + 30]
        words[9], words[20] = "changed", "too"
        texts.append(f"{prose(rng, 40 + k)} {' '.join(words)} {prose(rng, 40)}")
    none = np.empty(0, np.int64)
    monkeypatch.setattr(leaks.Seeds, "candidates", lambda *_: (none, none))
    assert searched(items, texts) == {(k % 10, k) for k in range(40)}


def test_words_that_differ_side_by_side_count_each():
    rng = random.Random(10)
    items = [(k, prose(rng, 27), None) for k in range(10)]
    texts = []
    for k in range(10):
        words = items[k][1].split()
        for place in (9, 18):
            words[place : place + 2] = ["changed", "too"]
        texts.append(f"{prose(rng, 40)} {' '.join(words)} {prose(rng, 40)}")
    assert searched(items, texts) == set()
    assert searched(items, [f"so it is {x[1]} and more" for x in items]) == {(k, k) for k in range(10)}


def test_broken_words_and_markup_are_layout(spark):
    rng = random.Random(11)
    items = [(k, prose(rng, 60), None) for k in range(6)]
    docs = []
    for k in range(6):
        words = items[k][1].split()[20:46]
        for place in (4, 9, 14, 19):
            words[place] = words[place][:3] + " " + words[place][3:]
        words[12] = "<br> &nbsp;" + words[12] + "</p>"
        docs.append((k, f"{prose(rng, 60)} {' '.join(words)} {prose(rng, 60)}"))
    got = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, description string, diff string"))
    assert {(r["item_id"], r["doc_id"]) for r in got.collect()} == {(k, k) for k in range(6)}


def test_pfair_stays_within_one_block():
    weights = {"a": 0.5, "b": 0.3, "c": 0.2, "none": 0.0}
    slots = mixing.pfair(weights, 1000)
    seen = Counter()
    for n, (_, name, block) in enumerate(slots, 1):
        assert block == seen[name]
        seen[name] += 1
        assert all(abs(seen[k] - w * n) <= 1.0 + 1e-6 for k, w in weights.items())


def test_schedule_has_a_slot_for_every_block(spark):
    for shares in ({"a": 3.4, "b": 1.0, "c": 0.2, "none": 0.0}, {"a": 9000.3, "b": 4500.2, "c": 0.5}):
        rows = mixing.schedule(spark, shares).collect()
        assert len({r["slot"] for r in rows}) == len(rows)
        for name, n in shares.items():
            own = {r["block"]: r["slot"] for r in rows if r["source"] == name}
            assert set(range(int(-(-n // 1)))) <= set(own) and [own[k] for k in sorted(own)] == sorted(own.values())
    assert mixing.schedule(spark, {}).count() == 0


def test_smaller_blocks_interleave_more(spark):
    docs = spark.createDataFrame([(i, "word " * 20, "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    mix = mixing.compose(docs, targets)[0].orderBy("slot").collect()
    for n in range(1, len(mix) + 1):
        held = Counter(r["source"] for r in mix[:n])
        assert abs(held["a"] - held["b"]) <= 2
    assert mixing.compose(docs, targets, block=2)[0].count() == len(mix) == 400


def test_mix(spark):
    docs = spark.createDataFrame([(i, "word " * 20, "big" if i % 10 else "small") for i in range(400)] + [(900, None, "big"), (901, "x", None)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.2, 2), ("tiny", 0.3, 3)], "source string, target_share double, max_repeats int")
    mix, report = mixing.compose(docs, targets)
    by = {r["source"]: r for r in report.collect()}
    assert not by["tiny"]["can_reach"] and by["big"]["can_reach"] and by["small"]["can_reach"] == (2 * by["small"]["source_tokens"] >= by["small"]["wanted_tokens"])
    uses = Counter((r["source"], r["doc_id"]) for r in mix.collect())
    assert max(n for (s, _), n in uses.items() if s == "big") == 1 and max(n for (s, _), n in uses.items() if s == "small") <= 2
    assert abs(by["big"]["mix_tokens"] - by["big"]["wanted_tokens"]) <= 40
    assert mixing.compose(docs.limit(0), targets)[1].count() == 3


def test_text_types(spark):
    good = "The function keeps a stale root while others wait, and the node stops in the middle of a sync. It is hard to see that this is so on all of the machines in the test network."
    rng = random.Random(1)
    shuffled = (good * 4).split()
    rng.shuffle(shuffled)
    texts = [good + f" It was number {k} of the series." for k in range(400)]
    junk = ["- item one\n" * 20, "0x" + "ab12" * 200, "a;b;c\n" + "\n".join(f"{k};{k + 1};{k + 2}" for k in range(60)), "test " * 200, " ".join(shuffled), "%$ #@ !! ^& " * 40]
    rows = list(enumerate([*texts, *junk * 3, None, "", "short and sweet"]))
    got = {r["doc_id"]: r for r in quality.text_types(spark.createDataFrame(rows, "doc_id long, text string").withColumn("pattern", F.lit(0))).collect()}
    assert len(got) == len(rows)
    assert all(got[k]["is_prose"] for k in range(400)) and not any(got[k]["is_prose"] for k in range(400, 418))
    assert got[418]["word_count"] == 0 and got[420]["is_prose"]
    assert quality.text_types(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("errs", [0.02, 0.1, 0.2])
def test_functions_that_err_on_prose_are_believed_less(errs):
    rng = np.random.default_rng(1)
    base = quality.prior_rates()
    truth = np.where(rng.random(20_000) < 0.85, 0, rng.integers(1, len(quality.TYPES), 20_000))
    rates = base.copy()
    rates[0] = (0.9 - errs, 0.1, errs)
    said = (rng.random((len(truth), len(quality.FUNCTIONS), 1)) > rates[truth].cumsum(2)).sum(2).clip(0, 2)
    codes = said @ 3 ** np.arange(len(quality.FUNCTIONS))[::-1]
    post, rate = quality.learn(Counter(codes.tolist()))
    assert np.abs(rate[0, :, 2] - errs).max() < 0.02
    once = [p for p in post if (quality.votes(np.array([p])) == quality.AGAINST).sum() == 1]
    assert sum(post[p][0] >= 0.5 for p in once) > 0.5 * len(once)
    assert np.mean([(post[c][0] >= 0.5) == (t == 0) for c, t in zip(codes.tolist(), truth)]) > 0.88
