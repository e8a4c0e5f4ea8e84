"""Problem 1: splits that keep related records together, by frontier breadth-first components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import Scratch, table
from .commits import commit_hash, hash_chains
from .groups import hash_to_min

#: A unit with at least this share of all records is placed on its own, largest first; there are at
#: most 1 / HEAVY_SHARE of them, so that list has a fixed bound.
HEAVY_SHARE = 0.005
#: Ranges of the hash order over which running totals are taken.
RANGES = 1024


def frontier_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """(vertex, root): connected components of an undirected graph; root is a vertex of each.

    Adjacency lists are hash-partitioned rows. Every vertex that comes first among its neighbours
    (by degree, then hash) is a seed, so each component has at least one, and all seeds expand
    at once, one ring a round. A vertex that two seeds reach keeps the smaller label, and the
    pair of labels goes to a small graph, whose own components merge the labels in the end.

    Null ends count for nothing. Loops make their vertex a component of its own, unless it has
    other edges. Repeated edges count once; no edges give no rows.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "frontier")
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    adjacency = scratch.cut(
        ends.select(F.inline(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))))
        .distinct()
        .repartition("v"),
        "adjacency",
    )
    degree = adjacency.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct(F.col("n"), F.xxhash64("v"), F.col("v"))
    ranked = degree.select("v", rank.alias("rank"))
    best_near = (
        adjacency.where("v <> w")
        .join(ranked.select(F.col("v").alias("w"), F.col("rank").alias("near")), "w")
        .groupBy("v")
        .agg(F.max("near").alias("near"))
    )
    seeds = ranked.join(best_near, "v", "left").where("near is null or rank > near").select("v", F.col("v").alias("label"))

    frontier = scratch.cut(seeds, "ring")
    visited = [frontier]
    collisions: list[DataFrame] = []
    for _ in range(max_rounds):
        seen = _union(visited)
        reached = (
            frontier.join(adjacency, "v")
            .where("v <> w")
            .select(F.col("w").alias("v"), "label")
            .distinct()
            .join(seen.select("v", F.col("label").alias("held")), "v", "left")
            .where("held is null or held <> label")
        )
        met = scratch.cut(reached, "met")
        fresh = met.where("held is null").groupBy("v").agg(F.min("label").alias("label"))
        ring = scratch.cut(fresh, "ring")
        pairs = met.join(ring.select("v", F.col("label").alias("kept")), "v", "left").select(
            F.coalesce("held", "kept").alias("a"), F.col("label").alias("b")
        )
        collisions.append(pairs.where("a <> b").distinct())
        if ring.isEmpty():
            break
        visited.append(ring)
        frontier = ring
    else:
        raise RuntimeError(f"the frontier was not empty after {max_rounds} rounds")
    labels = _union(visited)
    merged = hash_to_min(_union(collisions).distinct(), scratch=scratch)
    return labels.join(merged, labels["label"] == merged["vertex"], "left").select(
        F.col("v").alias("vertex"), F.coalesce("root", "label").alias("root")
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def commit_units(records: DataFrame, key: str = "id", commit: str = "fix_commit") -> DataFrame:
    """(id, unit_id, unit_size): the unit of every record, all records of one commit in one unit.

    Two records are related if their commit values give the same hash in any spelling, or one
    gives the beginning of the other's. ``unit_id`` is the smallest id of the unit. A record whose
    value names no commit is a unit of its own. Repeated ids stay one record; null ids get no row.
    """
    named = records.select(F.col(key).alias("id"), commit_hash(F.col(commit)).alias("hash")).where("id is not null").distinct()
    scratch = Scratch(records.sparkSession, "units")
    named = scratch.cut(named, "named")
    # A hash that one record gives and no other hash begins or continues relates nothing.
    counts = named.where("hash is not null").groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    chains = hash_chains(named)
    linked = chains.where("longer is not null")
    touched = linked.select("hash").union(linked.select(F.col("longer").alias("hash"))).union(counts.where("n > 1").select("hash")).distinct()
    spelled = named.join(touched, "hash", "left_semi").select(F.concat(F.lit("r"), "id").alias("a"), F.concat(F.lit("h"), "hash").alias("b"))
    chained = linked.select(F.concat(F.lit("h"), "hash").alias("a"), F.concat(F.lit("h"), "longer").alias("b"))
    parts = frontier_components(spelled.union(chained))
    members = parts.where(F.col("vertex").startswith("r")).select(F.expr("substring(vertex, 2)").alias("id"), "root")
    units = members.groupBy("root").agg(F.min("id").alias("unit_id"), F.count(F.lit(1)).alias("unit_size"))
    found = members.join(units, "root").select("id", "unit_id", "unit_size")
    return (
        named.select("id")
        .distinct()
        .join(found, "id", "left")
        .select("id", F.coalesce("unit_id", "id").alias("unit_id"), F.coalesce("unit_size", F.lit(1).cast("long")).alias("unit_size"))
    )


def assign_splits(units: DataFrame, targets: list[tuple[str, float]], unit: str = "unit_id", size: str = "unit_size") -> DataFrame:
    """(unit, split): one split for every row of ``units``, near the target shares of the summed sizes.

    ``units`` has one row a unit. Units of HEAVY_SHARE or more go, largest first, to the split
    that lacks most. All others stand in the order of their hash, and the splits cut that order
    by what each still lacks. Running totals are taken per range of the order and offset by
    the totals of the ranges before, of which there are RANGES.

    Targets need not add up to 1. No units give no rows; sizes count as at least one.
    """
    spark = units.sparkSession
    base = units.select(F.col(unit).alias("unit"), F.greatest(F.coalesce(F.col(size), F.lit(1)), F.lit(1)).cast("long").alias("size"))
    total = base.agg(F.sum("size")).first()[0] or 0
    whole = sum(share for _, share in targets)
    lacks = {name: total * share / whole for name, share in targets}
    bar = max(1.0, HEAVY_SHARE * total)
    heavy = base.where(F.col("size") >= bar) if bar > 1 else base.limit(0)
    placed = []
    for row in sorted(heavy.collect(), key=lambda r: (-r["size"], str(r["unit"]))):
        name = max(lacks, key=lambda k: lacks[k])
        lacks[name] -= row["size"]
        placed.append((row["unit"], name))
    order = F.xxhash64(F.col("unit").cast("string"))
    light = base.where(F.col("size") < bar) if bar > 1 else base
    light = light.withColumn("range", F.floor((order / F.lit(2.0**64) + 0.5) * RANGES).cast("int")).withColumn("order", order)
    sums = {r["range"]: r["n"] for r in light.groupBy("range").agg(F.sum("size").alias("n")).collect()}
    offsets, run = [], 0
    for k in range(-1, RANGES + 2):
        offsets.append((k, run))
        run += sums.get(k, 0)
    open_names = [(name, max(0.0, lack)) for name, lack in lacks.items()]
    room = sum(lack for _, lack in open_names) or 1.0
    bounds, edge = [], 0.0
    for name, lack in open_names:
        edge += run * lack / room
        bounds.append((name, edge))
    starts = spark.createDataFrame(offsets, "range int, offset long")
    window = Window.partitionBy("range").orderBy("order", "unit")
    middle = F.col("offset") + F.sum("size").over(window) - F.col("size") / 2
    choice = F.lit(bounds[-1][0])
    for name, edge in reversed(bounds[:-1]):
        choice = F.when(F.col("middle") < edge, name).otherwise(choice)
    cut = light.join(F.broadcast(starts), "range").withColumn("middle", middle).select("unit", choice.alias("split"))
    kind = base.schema["unit"].dataType.simpleString()
    return cut.unionByName(spark.createDataFrame(placed, f"unit {kind}, split string"))


def _targets(spark: SparkSession, sf_dir: str) -> list[tuple[str, float]]:
    """The split table has one row a split; more than 1,000 splits are refused."""
    rows = table(spark, sf_dir, "split_targets").where("split_name is not null").orderBy("split_name").take(1001)
    if not 0 < len(rows) <= 1000:
        raise ValueError("between 1 and 1000 splits are needed")
    return [(r["split_name"], float(r["target_share"] or 0.0)) for r in rows]


def split_records(records: DataFrame, targets: list[tuple[str, float]]) -> DataFrame:
    """(id, source_platform, unit_id, commit_split, platform_split) of every record.

    ``commit_split`` keeps all records of one commit together, ``platform_split`` every
    source_platform (records without one stand for one platform).
    """
    spark = records.sparkSession
    scratch = Scratch(spark, "splits")
    units = scratch.cut(commit_units(records), "units")
    by_commit = assign_splits(units.groupBy("unit_id").agg(F.count(F.lit(1)).alias("unit_size")), targets)
    named = records.select("id", F.coalesce("source_platform", F.lit("")).alias("platform")).where("id is not null").distinct()
    by_platform = assign_splits(named.groupBy("platform").agg(F.count(F.lit(1)).alias("n")), targets, "platform", "n")
    return (
        named.join(units, "id")
        .join(by_commit.select(F.col("unit").alias("unit_id"), F.col("split").alias("commit_split")), "unit_id")
        .join(by_platform.select(F.col("unit").alias("platform"), F.col("split").alias("platform_split")), "platform")
        .select("id", F.col("platform").alias("source_platform"), "unit_id", "commit_split", "platform_split")
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commit_units(table(spark, sf_dir, "ethereum_vulns")).where("unit_size > 1").select("id", "unit_id")


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_records(table(spark, sf_dir, "ethereum_vulns"), _targets(spark, sf_dir))


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and shares that each split got in both assignments, beside its target."""
    records = p1_splits(spark, sf_dir)
    parts = [
        records.groupBy(F.col(f"{kind}_split").alias("split_name")).agg(F.count(F.lit(1)).alias("n_records")).withColumn("kept_whole", F.lit(kind))
        for kind in ("commit", "platform")
    ]
    counts = parts[0].unionByName(parts[1])
    targets = table(spark, sf_dir, "split_targets")
    total = F.sum("n_records").over(Window.partitionBy("kept_whole"))
    return counts.join(targets, "split_name").select(
        "kept_whole", "split_name", "target_share", "n_records", (F.col("n_records") / total).alias("share")
    )


def split_violations(records: DataFrame, split: DataFrame, targets: list[tuple[str, float]]) -> DataFrame:
    """(check, n): units and platforms that stand in two splits, records without or with several rows, and, of the
    splits by commit, those that miss their target by more than the largest unit and one record in a thousand.
    """
    whole = sum(share for _, share in targets)
    parts = [
        split.groupBy(unit).agg(F.count_distinct(part).alias("k")).agg(F.count_if(F.col("k") > 1).alias("n")).select(F.lit(f"{part} of one {unit}").alias("check"), "n")
        for unit, part in (("unit_id", "commit_split"), ("source_platform", "platform_split"))
    ]
    given = records.where("id is not null").select("id").distinct().withColumn("k", F.lit(0)).unionByName(split.select("id", F.lit(1).alias("k")))
    parts.append(given.groupBy("id").agg(F.sum("k").alias("k")).agg(F.count_if(F.col("k") != 1).alias("n")).select(F.lit("rows of one id").alias("check"), "n"))
    largest = split.groupBy("unit_id").agg(F.count(F.lit(1)).alias("k")).agg(F.max("k")).first()[0] or 0
    got = {r["commit_split"]: r["k"] for r in split.groupBy("commit_split").agg(F.count(F.lit(1)).alias("k")).collect()}
    total = sum(got.values())
    off = sum(abs(got.get(name, 0) - total * share / whole) > largest + total / 1000 + 1 for name, share in targets)
    parts.append(split.sparkSession.createDataFrame([("shares off target", off)], "check string, n long"))
    return _union(parts)


def p1_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = _targets(spark, sf_dir)
    records = table(spark, sf_dir, "ethereum_vulns")
    split = Scratch(spark, "violations").cut(split_records(records, targets), "split")
    return split_violations(records, split, targets)


_HASH_SQL = r"""
named AS (
  SELECT id, source_platform, nullif(regexp_extract(lower(regexp_replace(fix_commit, '^\s+|\s+$', '', 'g')),
    '^(?:commit[\s:]+|\S*/commits?/)?([0-9a-f]{7,40})(?:[/?#]\S*)?$', 1), '') AS h FROM ethereum_vulns
), hashes AS (SELECT DISTINCT h FROM named WHERE h IS NOT NULL AND NOT regexp_matches(h, '^0+$')
), steps AS (SELECT h, lag(h) OVER (PARTITION BY substr(h, 1, 7) ORDER BY h) AS b FROM hashes
), runs AS (SELECT h, sum(CASE WHEN b IS NULL OR starts_with(h, b) THEN 0 ELSE 1 END) OVER (PARTITION BY substr(h, 1, 7) ORDER BY h) AS r FROM steps
), keys AS (SELECT h, max(h) OVER (PARTITION BY substr(h, 1, 7), r) AS c FROM runs)
"""

QUERIES = {"p1_found": p1_found, "p1_splits": p1_splits, "p1_shares": p1_shares, "p1_violations": p1_violations}
SQL = {
    "p1_found": "WITH" + _HASH_SQL
    + ", u AS (SELECT id, min(id) OVER (PARTITION BY c) AS unit_id, count(*) OVER (PARTITION BY c) AS n FROM named JOIN keys USING (h))"
    " SELECT id, unit_id FROM u WHERE n > 1",
    # What a right assignment has, whatever it is: the checks themselves are tested with planted violations.
    "p1_violations": "SELECT unnest(['commit_split of one unit_id', 'platform_split of one source_platform', 'rows of one id', 'shares off target']) AS check, 0::BIGINT AS n",
}
