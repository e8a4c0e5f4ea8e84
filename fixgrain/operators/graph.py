"""Entity resolution: identifier keys, star edges and connected components by label propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import all_matches, title_key
from ..runtime import Scratch


def identity_keys(findings: DataFrame) -> DataFrame:
    """(id, key): every identifier a finding shares with others.

    Advisory ids come from issue_id and description and count within one platform, as does the
    title key; full lower-case commit hashes count across platforms.
    """
    text = F.concat_ws(" ", F.coalesce("issue_id", F.lit("")), F.coalesce("description", F.lit("")))
    hashes = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("introduced_in_commit", "source_url", "description")))
    platform = F.coalesce("source_platform", F.lit(""))

    def prefixed(kind: str, values: Column, within: bool) -> Column:
        head = F.concat(F.lit(kind), platform, F.lit("|")) if within else F.lit(kind)
        return F.transform(values, lambda v: F.concat(head, v))

    key = title_key(F.col("title"))
    arrays = (
        prefixed("cve|", F.transform(all_matches(text, r"CVE-\d{4}-\d{4,7}"), F.upper), True),
        prefixed("ghsa|", F.transform(all_matches(text, r"GHSA-[0-9a-z]{4}-[0-9a-z]{4}-[0-9a-z]{4}"), F.upper), True),
        prefixed("sha|", all_matches(hashes, r"\b[0-9a-f]{40}\b", folded=False), False),
        F.when(key == "", F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("title|"), platform, F.lit("|"), key))),
    )
    return findings.select("id", F.explode(F.array_distinct(F.concat(*arrays))).alias("key"))


def star_edges(keys: DataFrame) -> DataFrame:
    """(a, b): each member of a key's bucket with the smallest member; linear in the bucket, with partial minima."""
    least = keys.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keys.join(least, "key").where("id <> a").select("a", F.col("id").alias("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, component) of every vertex of the edges; the component is its smallest vertex.

    A round takes the least label among the neighbours and then the label of the own label, so
    labels travel at doubling distance. Every round is a table in the shared folder.
    """
    scratch = Scratch(edges.sparkSession, "components")
    both = scratch.cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    first = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component"))
    path = scratch.write(first, "labels")
    labels = scratch.read(path, first)
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("next"))
        jump = step.join(labels.select(F.col("id").alias("next"), F.col("component").alias("far")), "next", "left").select(
            "id", F.col("component").alias("before"), F.least("next", F.coalesce("far", "next")).alias("component")
        )
        after = scratch.write(jump, "labels")
        done = scratch.read(after, jump)
        labels = done.select("id", "component")
        scratch.drop(path)
        path = after
        if done.where("before <> component").isEmpty():
            return labels
    raise RuntimeError(f"labels still changed after {max_rounds} rounds")


def clusters(findings: DataFrame) -> DataFrame:
    """(id, cluster_id) of every finding; one that shares nothing is its own cluster."""
    found = components(star_edges(identity_keys(findings)))
    return findings.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("cluster_id"))


#: Ranks of severities as they stand; anything else is 0, as is blank.
SEVERITY_RANK = {"Critical": 6, "High": 5, "Medium": 4, "Low": 3, "Info": 2, "Unrated": 1}


def severity_rank(severity: Column) -> Column:
    out = F.lit(0)
    for name, rank in SEVERITY_RANK.items():
        out = F.when(severity == name, rank).otherwise(out)
    return out


def evidence(findings: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster_id, place, source_url): the distinct addresses of each cluster in the order of the smallest id that has them.

    A cluster of one keeps its address even if it is empty. One row an address, so that a large
    cluster is no large cell.
    """
    rows = findings.select("id", F.coalesce("source_url", F.lit("")).alias("source_url")).join(members, "id")
    sizes = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    kept = rows.join(sizes, "cluster_id").where("source_url <> '' or n = 1")
    first = kept.groupBy("cluster_id", "source_url").agg(F.min("id").alias("first"))
    return first.select("cluster_id", F.row_number().over(Window.partitionBy("cluster_id").orderBy("first", "source_url")).alias("place"), "source_url")


def collapse(findings: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """One row a cluster: size, the id of the most severe member (smallest id on ties) and the addresses as a JSON list.

    The order of ids stands for the order of rows, also in ``first_id``, by which the output is to be ordered.
    """
    members = clusters(findings) if members is None else members
    rows = findings.select("id", severity_rank(F.col("severity")).alias("rank")).join(members, "id")
    heads = rows.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("size"),
        F.min("id").alias("first_id"),
        F.min(F.struct((-F.col("rank")).alias("r"), F.col("id"))).getField("id").alias("representative"),
    )
    listed = evidence(findings, members).groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("place", "source_url"))).alias("e"))
    return heads.join(listed, "cluster_id", "left").select(
        "cluster_id", "size", "first_id", "representative", F.coalesce(F.to_json(F.transform("e", lambda x: x["source_url"])), F.lit("[]")).alias("evidence")
    )


def report(findings: DataFrame, members: DataFrame) -> DataFrame:
    """One row: rows before and after, duplicates, clusters of several, the largest, the rate in percent, and commits shared across platforms."""
    sizes = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    counts = sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("input_rows"),
        F.count(F.lit(1)).alias("output_rows"),
        F.count_if(F.col("n") > 1).alias("clusters"),
        F.coalesce(F.max("n"), F.lit(0)).alias("largest"),
    )
    shared = identity_keys(findings).where(F.col("key").startswith("sha|")).join(findings.select("id", F.coalesce("source_platform", F.lit("")).alias("p")), "id")
    shared = shared.groupBy("key").agg(F.min("p").alias("a"), F.max("p").alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias("shared_commits"))
    rows = counts.select("*", F.lit(None).cast("long").alias("shared_commits")).unionByName(
        shared.select(*(F.lit(None).cast("long").alias(c) for c in ("input_rows", "output_rows", "clusters", "largest")), "shared_commits")
    )
    whole = rows.agg(*(F.max(c).alias(c) for c in rows.columns))
    duplicates = F.col("input_rows") - F.col("output_rows")
    return whole.select("*", duplicates.alias("duplicates"), F.round(F.coalesce(F.try_divide(100.0 * duplicates, F.col("input_rows")), F.lit(0.0)), 2).alias("rate_pct"))
