"""Commit names of findings: spellings, shortened hashes, and one key for each commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters by which two hash spellings must agree before they are compared at all; the shortest
#: hash that counts as a commit name.
SHORTEST = 7


def commit_hash(value: Column) -> Column:
    """The lower-case hash that a commit value names, else null.

    Accepted: 7 to 40 hexadecimal digits in any case and padding, alone, after the word
    ``commit`` or at the end of a ``/commit/`` address. Zeros only, ``nan``, ``N/A``, blank and
    null name no commit.
    """
    text = F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""))
    found = F.regexp_extract(text, r"^(?:commit[\s:]+|\S*/commits?/)?([0-9a-f]{7,40})(?:[/?#]\S*)?$", 1)
    return F.when((found != "") & ~found.rlike("^0+$"), found)


def hash_chains(hashes: DataFrame) -> DataFrame:
    """(hash, longer): each distinct hash and the next one that it begins, null where there is none.

    In byte order the strings that begin with a hash follow it directly, so one window over the
    hashes that share their first ``SHORTEST`` digits finds them without comparing pairs.
    """
    distinct = hashes.select("hash").where(F.col("hash").isNotNull()).distinct()
    window = Window.partitionBy(F.substring("hash", 1, SHORTEST)).orderBy("hash")
    after = F.lead("hash").over(window)
    return distinct.select("hash", after.alias("after")).select(
        "hash", F.when(F.col("after").startswith(F.col("hash")), F.col("after")).alias("longer")
    )


def commit_keys(hashes: DataFrame) -> DataFrame:
    """(hash, commit): each distinct hash with the longest spelling of the commit it names."""
    distinct = hashes.select("hash").where(F.col("hash").isNotNull()).distinct()
    window = Window.partitionBy(F.substring("hash", 1, SHORTEST)).orderBy("hash")
    runs = distinct.select(
        "hash", F.coalesce((~F.col("hash").startswith(F.lag("hash").over(window))).cast("int"), F.lit(0)).alias("starts")
    ).withColumn("run", F.sum("starts").over(window))
    whole = Window.partitionBy(F.substring("hash", 1, SHORTEST), "run")
    return runs.select("hash", F.max("hash").over(whole).alias("commit"))
