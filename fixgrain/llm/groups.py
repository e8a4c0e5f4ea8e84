"""Problem 5: consolidating pairwise matches into groups by hash-to-min."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch, table


def hash_to_min(edges: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None, max_rounds: int = 60) -> DataFrame:
    """(vertex, root): every vertex of the edges and the smallest vertex linked to it, directly or not.

    Each vertex v holds a set of vertices, as rows (v, u) and never as one array. In a round v
    sends its set to the smallest member and that member to all others. The rounds end when no
    set changes; the number of rounds grows with the logarithm of the longest chain. A set that
    holds a third of all vertices is many rows: its minimum is a partial aggregate, and the join
    that sends it is split by adaptive skew handling.

    Null ends and loops link nothing; repeated and reversed edges count once; no edges give no rows.
    """
    spark = edges.sparkSession
    scratch = scratch or Scratch(spark, "hash-to-min")
    x, y = F.col(a), F.col(b)
    pairs = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    start = pairs.distinct().select(
        F.inline(
            F.array(
                F.struct(F.col("a").alias("v"), F.col("a").alias("u")),
                F.struct(F.col("a").alias("v"), F.col("b").alias("u")),
                F.struct(F.col("b").alias("v"), F.col("a").alias("u")),
                F.struct(F.col("b").alias("v"), F.col("b").alias("u")),
            )
        )
    ).distinct()
    path = scratch.write(start, "sets")
    sets = scratch.read(path, start)
    mark = _mark(sets)
    for _ in range(max_rounds):
        least = sets.groupBy("v").agg(F.min("u").alias("m"))
        sent = sets.join(least, "v").select(
            F.inline(F.array(F.struct(F.col("m").alias("v"), F.col("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u"))))
        )
        sent = sent.distinct()
        after = scratch.write(sent, "sets")
        sets = scratch.read(after, sent)
        scratch.drop(path)
        path, before, mark = after, mark, _mark(sets)
        if mark == before:
            break
    else:
        raise RuntimeError(f"hash-to-min did not settle in {max_rounds} rounds")
    return sets.groupBy(F.col("v").alias("vertex")).agg(F.min("u").alias("root"))


def _mark(sets: DataFrame) -> tuple:
    """Count and order-free hash of the rows; equal marks mean equal sets."""
    return tuple(sets.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u")), F.bit_xor(F.xxhash64("u", "v", F.lit(7)))).first())


def consolidate(records: DataFrame, matches: DataFrame, key: str = "id", left: str = "left_id", right: str = "right_id", verdict: str = "verdict") -> DataFrame:
    """(id, group_id, linked): one row for every distinct record id.

    Rows with verdict ``match`` link, in either order; any other verdict does nothing. Ends that
    are no record, null ends and loops count for nothing. ``group_id`` is the smallest id of the
    group, an unlinked record's own id; ``linked`` says whether another record is in the group.
    Null record ids get no row.
    """
    ids = records.select(F.col(key).alias("id")).where(F.col("id").isNotNull()).distinct()
    edges = (
        matches.where(F.lower(F.trim(verdict)) == "match")
        .select(F.col(left).alias("a"), F.col(right).alias("b"))
        .where(F.col("a") != F.col("b"))
        .distinct()
    )
    known = edges.join(ids.select(F.col("id").alias("a")), "a", "left_semi").join(ids.select(F.col("id").alias("b")), "b", "left_semi")
    roots = hash_to_min(known)
    return ids.join(roots, ids["id"] == roots["vertex"], "left").select(
        "id", F.coalesce("root", "id").alias("group_id"), F.col("root").isNotNull().alias("linked")
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_groups(spark, sf_dir).where("linked").select("id", "group_id")


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate(table(spark, sf_dir, "ethereum_vulns"), table(spark, sf_dir, "match_pairs"))


def p5_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups there are of each size."""
    sizes = p5_groups(spark, sf_dir).groupBy("group_id").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n_groups"))


_GROUPS_SQL = """
WITH RECURSIVE link AS (
  SELECT left_id AS a, right_id AS b FROM match_pairs
  WHERE lower(trim(verdict)) = 'match' AND left_id <> right_id
    AND left_id IN (SELECT id FROM ethereum_vulns) AND right_id IN (SELECT id FROM ethereum_vulns)
), both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a
), roots AS (SELECT a AS id, min(b) AS group_id FROM reach GROUP BY a)
"""

QUERIES = {"p5_found": p5_found, "p5_groups": p5_groups, "p5_sizes": p5_sizes}
SQL = {
    "p5_found": _GROUPS_SQL + "SELECT id, group_id FROM roots",
    "p5_groups": _GROUPS_SQL
    + "SELECT v.id, coalesce(r.group_id, v.id) AS group_id, r.id IS NOT NULL AS linked FROM ethereum_vulns v LEFT JOIN roots r ON v.id = r.id",
    "p5_sizes": _GROUPS_SQL
    + ", g AS (SELECT coalesce(r.group_id, v.id) AS gid FROM ethereum_vulns v LEFT JOIN roots r ON v.id = r.id),"
    " s AS (SELECT gid, count(*) AS size FROM g GROUP BY gid) SELECT size, count(*) AS n_groups FROM s GROUP BY size",
}
