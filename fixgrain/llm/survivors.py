"""Problem 2: one surviving record for each group of duplicates.

Some fields are defined by rank: the best member that can give the field gives it, which one
aggregate of minima finds. All other fields are chosen by token-level consensus. The values of a
group are aligned progressively, starting from its best member's value, each one adding weighted
votes for the tokens it has in the columns; the existing value closest to the winning tokens
survives. Votes add up in any order, so the columns of a group are partial sums and no group is
ever in one task.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from ..runtime import Scratch, table
from .commits import commit_hash, commit_keys

TIER_WEIGHT = {0: 4.0, 1: 2.0, 2: 1.0, 3: 0.5}


def _clean(value: Column) -> Column:
    text = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    return F.when((text != "") & (F.lower(text) != "nan"), text)


def tier_rank(value: Column) -> Column:
    """0, 1, 2 for authority A, B, C in any case, 3 for anything else."""
    first = F.lower(F.substring(_clean(value), 1, 1))
    return F.when(first == "a", 0).when(first == "b", 1).when(first == "c", 2).otherwise(3)


def trust(records: DataFrame) -> Column:
    """A struct that sorts members best first: authority, latest instant, smallest id."""
    instant = F.unix_micros(F.try_to_timestamp(_clean(records["scraped_at"])))
    return F.struct(tier_rank(records["authority_tier"]).alias("tier"), F.coalesce(-instant, F.lit(2**62)).alias("age"), records["id"].alias("id"))


def field_values(records: DataFrame) -> dict[str, Column]:
    """The value each field would give, null where a record cannot give it."""
    severity = F.lower(_clean(records["severity"]))
    issue = F.upper(_clean(records["issue_id"]))
    full = commit_hash(records["fix_commit"])
    return {
        "record": records["id"],
        "severity": F.when(severity.isin("critical", "high", "medium", "low"), severity),
        "issue_id": F.when(issue.rlike(r"^(GHSA(-[0-9A-Z]{4}){3}|CVE-\d{4}-\d{4,}|RUSTSEC-\d{4}-\d{4,})$"), issue),
        "fix_commit": F.when(F.length(full) == 40, full),
    } | {c: _clean(records[c].cast("string")) for c in records.columns if c not in ("id", *RANKED)}


#: Fields defined by the members' rank; all others are chosen by consensus.
RANKED = ("record", "severity", "issue_id", "fix_commit")


def matching(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """(place in a, place in b, size) of equal runs that a and b have in the same order, in order.

    Equal ends are taken off; between them the tokens that stand once in each text are anchors,
    along their longest increasing sequence, and the gaps between anchors are treated alike; in a
    gap without anchors tokens match at equal places.
    The time is n log n, whatever the length.
    """
    out: list[tuple[int, int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        n = 0
        while i + n < i_end and j + n < j_end and a[i + n] == b[j + n]:
            n += 1
        if n:
            out.append((i, j, n))
            i, j = i + n, j + n
        n = 0
        while i_end - n > i and j_end - n > j and a[i_end - n - 1] == b[j_end - n - 1]:
            n += 1
        if n:
            i_end, j_end = i_end - n, j_end - n
            out.append((i_end, j_end, n))
        if i == i_end or j == j_end:
            continue
        once = Counter(b[j:j_end])
        place = {t: k for k, t in enumerate(b[j:j_end], j) if once[t] == 1}
        count = Counter(a[i:i_end])
        pairs = [(k, place[t]) for k, t in enumerate(a[i:i_end], i) if t in place and count[t] == 1]
        chain = _increasing(pairs)
        for x, y in chain:
            todo.append((i, x, j, y))
            out.append((x, y, 1))
            i, j = x + 1, y + 1
        if chain:
            todo.append((i, i_end, j, j_end))
        else:
            out += [(i + k, j + k, 1) for k in range(min(i_end - i, j_end - j)) if a[i + k] == b[j + k]]
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs (sorted by their first part) with increasing second parts."""
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, y) in enumerate(pairs):
        n = bisect_left(tails, y)
        before[k] = at[n - 1] if n else -1
        if n == len(tails):
            tails.append(y)
            at.append(k)
        else:
            tails[n], at[n] = y, k
    chain = []
    k = at[-1] if at else -1
    while k >= 0:
        chain.append(pairs[k])
        k = before[k]
    return chain[::-1]


def changes(guide: list[str], tokens: list[str]) -> list[tuple[int, int, str | None]]:
    """(column, slot, token): where a text differs from the guide it is aligned with.

    Slot 0 is the guide's own column, with None where the text lacks it; slots from 1 on are tokens
    that the text has before that column.
    """
    out: list[tuple[int, int, str | None]] = []
    i = j = 0
    for x, y, n in [*matching(guide, tokens), (len(guide), len(tokens), 0)]:
        while i < x and j < y:
            out.append((i, 0, tokens[j]))
            i, j = i + 1, j + 1
        out += [(k, 0, None) for k in range(i, x)]
        out += [(x, k + 1, t) for k, t in enumerate(tokens[j:y])]
        i, j = x + n, y + n
    return out


def apply_changes(guide: list[str], winners: list[tuple[int, int, str | None]]) -> str:
    """The guide with its winning changes."""
    columns: dict[int, list[tuple[int, str | None]]] = {}
    for column, slot, token in winners:
        columns.setdefault(column, []).append((slot, token))
    out: list[str] = []
    for k in range(len(guide) + 1):
        own = dict(columns.get(k, ()))
        out += [own[s] for s in sorted(own) if s and own[s] is not None]
        token = own.get(0, guide[k]) if k < len(guide) and (0 not in own or own[0] is not None) else None
        if token is not None:
            out.append(token)
    return " ".join(out)


def distance(value: str, consensus: str) -> float:
    """Share of tokens that differ, 0 for equal texts and 1 for texts without a common token."""
    a, b = value.split(), consensus.split()
    if a == b:
        return 0.0
    same = sum(n for _, _, n in matching(a, b))
    return 1.0 - 2.0 * same / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def _distances(values: pd.Series, consensus: pd.Series) -> pd.Series:
    return pd.Series([distance(a, b) for a, b in zip(values, consensus)], dtype=float)


@F.pandas_udf(StringType())
def _applied(guides: pd.Series, winners: pd.Series) -> pd.Series:
    return pd.Series([apply_changes(g.split(), [(w["column"], w["slot"], w["token"]) for w in ws]) for g, ws in zip(guides, winners)], dtype=object)


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["cell", "column", "slot", "token", "weight"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64()]
    for batch in batches:
        rows = []
        for cell, guide, value, weight in zip(*(batch.column(c).to_pylist() for c in ("cell", "guide", "value", "weight"))):
            rows += [(cell, *change, weight) for change in changes(guide.split(), value.split())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def consensus_fields(cells: DataFrame, scratch: Scratch) -> DataFrame:
    """(group_key, field_name, from_id, value) from cells (group_key, field_name, value, trust).

    Equal values of a group are one vote of summed weight before anything else, so copies cost one
    row. The cell chosen is the one closest to the consensus; on a tie the one of the best member.
    Null values give nothing, so a field no member can give has no row. Rows are spread over the
    tasks by their value before they are aligned or compared, so a hot group is everywhere.
    """
    on = ["group_key", "field_name"]
    weight = F.lit(TIER_WEIGHT[3])
    for tier in (2, 1, 0):
        weight = F.when(F.col("trust.tier") == tier, TIER_WEIGHT[tier]).otherwise(weight)
    distinct = scratch.cut(
        cells.where("value is not null and group_key is not null").groupBy(*on, "value").agg(F.min("trust").alias("trust"), F.sum(weight).alias("weight")), "values"
    )
    best = F.min(F.struct("trust", "value")).alias("best")
    heads = scratch.cut(
        distinct.groupBy(*on).agg(best, F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n")).select(*on, F.col("best.trust").alias("trust"), F.col("best.value").alias("guide"), "total", "n").withColumn("cell", F.monotonically_increasing_id()),
        "heads",
    )
    single = heads.where("n = 1").select(*on, F.col("trust.id").alias("from_id"), F.col("guide").alias("value"))
    several = heads.where("n > 1")
    spread = [*on, F.xxhash64("value")]
    votes = (
        distinct.join(several.select(*on, "cell", "guide"), on).where("value <> guide").select("cell", "guide", "value", "weight").repartition("cell", F.xxhash64("value"))
        .mapInArrow(_vote, "cell long, column int, slot int, token string, weight double")
        .groupBy("cell", "column", "slot", "token").agg(F.sum("weight").alias("weight"))
    )
    # Votes go by the number that the written heads give each group and field, which is shorter than both names.
    # The guide's token, or nothing in a slot beside it, has all votes that no other token of the column has.
    columns = votes.groupBy("cell", "column", "slot").agg(F.max(F.struct("weight", "token")).alias("top"), F.sum("weight").alias("against"))
    winners = (
        columns.join(several.select("cell", "total"), "cell").where("top.weight > total - against")
        .groupBy("cell").agg(F.collect_list(F.struct("column", "slot", F.col("top.token").alias("token"))).alias("winners"))
    )
    chosen = several.join(winners, "cell", "left").select(*on, F.when(F.col("winners").isNull(), F.col("guide")).otherwise(_applied("guide", F.coalesce("winners", F.expr("array()")))).alias("consensus"))
    chosen = scratch.cut(chosen, "consensus")
    far = F.when(F.col("value") == F.col("consensus"), F.lit(0.0)).otherwise(_distances("value", "consensus"))
    near = distinct.join(chosen, on).repartition(*spread).select(*on, far.alias("far"), "trust", "value")
    closest = near.groupBy(*on).agg(F.min(F.struct("far", "trust", "value")).alias("best"))
    return single.unionByName(closest.select(*on, F.col("best.trust.id").alias("from_id"), F.col("best.value").alias("value")))


def members(records: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(group_key, trust, and a value for each field) of every record that names a commit."""
    values = field_values(records)
    named = records.where("id is not null").select(
        F.coalesce("source_platform", F.lit("")).alias("platform"),
        commit_hash(records["fix_commit"]).alias("hash"),
        trust(records).alias("trust"),
        *(values[k].alias(f"value_{k}") for k in fields),
    ).where("hash is not null")
    rows = named.join(commit_keys(named), "hash")
    return rows.select(F.concat_ws("\u0001", "platform", "commit").alias("group_key"), "trust", *(f"value_{k}" for k in fields))


def ranked_fields(member: DataFrame, fields: tuple[str, ...] = RANKED) -> DataFrame:
    """(group_key, group_id, n_members, field_name, from_id, value): each field from the best member that can give it.

    One aggregate of minima with partial results: a hot group costs one row a task.
    """
    first = [F.min(F.when(F.col(f"value_{k}").isNotNull(), F.struct("trust", F.col(f"value_{k}").alias("value")))).alias(k) for k in fields]
    groups = member.groupBy("group_key").agg(F.min("trust.id").alias("group_id"), F.count_distinct("trust.id").alias("n_members"), *first).where("n_members > 1")
    rows = F.array(*(F.struct(F.lit(k).alias("field_name"), F.col(k)["trust"]["id"].alias("from_id"), F.col(k)["value"].alias("value")) for k in fields))
    return groups.select("group_key", "group_id", "n_members", F.inline(rows)).where("from_id is not null")


def survivors(records: DataFrame, fields: tuple[str, ...] = RANKED) -> DataFrame:
    """(group_id, n_members, field_name, from_id, value) for every group of two or more records.

    A group is the records of one source_platform (null is a platform of its own) that name one
    commit; ``group_id`` is its smallest id. Records that name no commit are in no group. Repeated
    rows of one id are one member.
    """
    ranked = tuple(k for k in RANKED if k in fields)
    voted = tuple(k for k in fields if k not in RANKED)
    out = ["group_id", "n_members", "field_name", "from_id", "value"]
    if not voted:
        return ranked_fields(members(records, ranked), ranked).select(out)
    scratch = Scratch(records.sparkSession, "survivors")
    member = scratch.cut(members(records, fields), "members")
    groups = member.groupBy("group_key").agg(F.min("trust.id").alias("group_id"), F.count_distinct("trust.id").alias("n_members")).where("n_members > 1")
    groups = scratch.cut(groups, "groups")
    pairs = F.array(*(F.struct(F.lit(k).alias("field_name"), F.col(f"value_{k}").alias("value")) for k in voted))
    cells = member.join(groups.select("group_key"), "group_key", "left_semi").select("group_key", "trust", F.inline(pairs))
    chosen = consensus_fields(cells, scratch).join(groups, "group_key").select(out)
    return chosen.unionByName(ranked_fields(member, ranked).select(out)) if ranked else chosen


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors(table(spark, sf_dir, "ethereum_vulns")).select("group_id", "field_name", "from_id")


def p2_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a group: its size and the surviving values."""
    return whole_survivors(table(spark, sf_dir, "ethereum_vulns"))


def whole_survivors(records: DataFrame) -> DataFrame:
    """One row a group: its size and the surviving value of every column, those beside RANKED by consensus.

    ``record_id`` is the best member's id; numbers vote by their text.
    """
    kinds = dict(records.dtypes)
    fields = (*RANKED, *(c for c in records.columns if c not in ("id", *RANKED)))
    cells = survivors(records, fields).groupBy("group_id", "n_members").pivot("field_name", list(fields)).agg(F.first("value"))
    return cells.select("group_id", "n_members", F.col("record").alias("record_id"), *(F.col(c).cast(kinds[c]).alias(c) for c in fields[1:]))


_RANK = """CASE lower(substr(trim(authority_tier), 1, 1)) WHEN 'a' THEN 0 WHEN 'b' THEN 1 WHEN 'c' THEN 2 ELSE 3 END,
  coalesce(-epoch_us(try_cast(nullif(trim(scraped_at), '') AS TIMESTAMPTZ)), 4611686018427387904), id"""


def _sql() -> str:
    from .splits import _HASH_SQL

    return (
        "WITH"
        + _HASH_SQL
        + r""", m AS (
  SELECT v.*, named.h, concat(coalesce(v.source_platform, ''), '/', c) AS g FROM named JOIN keys USING (h) JOIN ethereum_vulns v USING (id)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY """
        + _RANK
        + r""") AS rk, min(id) OVER (PARTITION BY g) AS group_id, count(*) OVER (PARTITION BY g) AS n FROM m
), cells AS (
  SELECT group_id, 'record' AS field_name, id, rk FROM ranked WHERE n > 1
  UNION ALL SELECT group_id, 'severity', id, rk FROM ranked WHERE n > 1 AND lower(trim(severity)) IN ('critical', 'high', 'medium', 'low')
  UNION ALL SELECT group_id, 'issue_id', id, rk FROM ranked WHERE n > 1
    AND regexp_full_match(upper(trim(issue_id)), 'GHSA(-[0-9A-Z]{4}){3}|CVE-\d{4}-\d{4,}|RUSTSEC-\d{4}-\d{4,}')
  UNION ALL SELECT group_id, 'fix_commit', id, rk FROM ranked WHERE n > 1 AND length(h) = 40
) SELECT group_id, field_name, arg_min(id, rk) AS from_id FROM cells GROUP BY group_id, field_name"""
    )


QUERIES = {"p2_found": p2_found, "p2_survivors": p2_survivors}
SQL = {"p2_found": _sql()}
