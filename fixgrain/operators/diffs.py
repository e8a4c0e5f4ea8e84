"""Unified diffs as hunks and as nested documents: the lines of each diff as rows, with windows over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a file from which no further hunk is kept; characters of a hunk from which it is cut.
FILE_LINES, HUNK_CHARS = 400, 16_000
LINES_MARK, CHARS_MARK = "… [truncated]", "\n… [truncated]"


def diff_lines(diffs: DataFrame, key: str, diff: str) -> DataFrame:
    """(key, pos, line, file, hunk): every line with the file and hunk it stands in.

    A header that names no file resets the file; lines before the first file or hunk have none.
    """
    rows = diffs.where(F.col(diff).isNotNull()).select(F.col(key).alias("key"), F.posexplode(F.split(diff, r"\r\n|\n")).alias("pos", "line"))
    order = Window.partitionBy("key").orderBy("pos")
    header = F.col("line").startswith("diff --git")
    file = F.when(header, F.regexp_extract("line", r" b/(\S+)$", 1))
    opens = F.col("line").rlike(r"^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@")
    return rows.select(
        "key",
        "pos",
        "line",
        F.last(file, ignorenulls=True).over(order).alias("file"),
        F.sum(opens.cast("int")).over(order).alias("hunk"),
        F.when(opens, F.regexp_extract("line", r"^@@ -(\d+)", 1).cast("int")).alias("pre_at"),
        F.when(opens, F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1).cast("int")).alias("post_at"),
    )


def hunks(diffs: DataFrame, key: str, diff: str) -> DataFrame:
    """(key, file, hunk, side, start_line, n_lines, code): the code before and after of each hunk.

    Added lines are after, removed ones before, lines that begin with a space both; lines that
    begin ``+++`` or ``---`` and all others are ignored, empty sides have no row. Long hunks and
    files are cut with a mark.
    """
    rows = diff_lines(diffs, key, diff).where("file <> '' and hunk > 0")
    body = rows.select(
        "key",
        "file",
        "hunk",
        "pos",
        F.max("pre_at").over(Window.partitionBy("key", "hunk")).alias("pre_at"),
        F.max("post_at").over(Window.partitionBy("key", "hunk")).alias("post_at"),
        F.when(F.col("line").startswith("+") & ~F.col("line").startswith("+++"), F.array(F.lit("post")))
        .when(F.col("line").startswith("-") & ~F.col("line").startswith("---"), F.array(F.lit("pre")))
        .when(F.col("line").startswith(" "), F.array(F.lit("pre"), F.lit("post")))
        .alias("sides"),
        F.expr("substring(line, 2)").alias("text"),
    ).where("sides is not null")
    grouped = (
        body.select("*", F.explode("sides").alias("side"))
        .groupBy("key", "file", "hunk", "side")
        .agg(
            F.when(F.col("side") == "pre", F.max("pre_at")).otherwise(F.max("post_at")).alias("start_line"),
            F.count(F.lit(1)).alias("n_lines"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda r: r["text"]), "\n").alias("code"),
        )
    )
    before = F.coalesce(F.sum("n_lines").over(Window.partitionBy("key", "file", "side").orderBy("hunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    capped = grouped.withColumn("before", before)
    first_over = F.row_number().over(Window.partitionBy("key", "file", "side", F.col("before") >= FILE_LINES).orderBy("hunk"))
    return capped.withColumn("over", F.when(F.col("before") >= FILE_LINES, first_over)).where("over is null or over = 1").select(
        "key",
        "file",
        "hunk",
        "side",
        "start_line",
        "n_lines",
        F.when(F.col("over") == 1, LINES_MARK)
        .when(F.length("code") > HUNK_CHARS, F.concat(F.substring("code", 1, HUNK_CHARS), F.lit(CHARS_MARK)))
        .otherwise(F.col("code"))
        .alias("code"),
    )


def documents(diffs: DataFrame, key: str, diff: str) -> DataFrame:
    """(key, files_changed, pre_fix_code, post_fix_code) as JSON of every diff: its files in order, and by file the hunks of each side.

    A null diff gives empty lists. The lists of one row are bounded by its diff.
    """
    heads = diff_lines(diffs, key, diff).where(F.col("line").startswith("diff --git") & (F.col("file") != ""))
    files = heads.groupBy("key").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pos", "file"))), lambda x: x["file"])).alias("files_changed"))
    by_file = (
        hunks(diffs, key, diff)
        .groupBy("key", "side", "file")
        .agg(F.min("hunk").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("hunk", "start_line", "code"))), lambda h: F.struct(h["start_line"].alias("start_line"), h["code"].alias("code"))).alias("hunks"))
    )
    sides = by_file.groupBy("key").agg(
        *(
            F.to_json(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("first", "file", "hunks")))), lambda f: F.struct(f["file"].alias("file"), f["hunks"].alias("hunks")))).alias(name)
            for side, name in (("pre", "pre_fix_code"), ("post", "post_fix_code"))
        )
    )
    every = diffs.select(F.col(key).alias("key")).distinct().join(files, "key", "left").join(sides, "key", "left")
    return every.select("key", *(F.coalesce(c, F.lit("[]")).alias(c) for c in ("files_changed", "pre_fix_code", "post_fix_code")))


CODE_CHANGE = "array<struct<file:string,hunks:array<struct<start_line:int,code:string>>>>"


def change_size(findings: DataFrame, code: str) -> DataFrame:
    """(id, n_files, loc) of a JSON code change; text that is no such JSON has no row."""
    doc = F.from_json(F.col(code), CODE_CHANGE)
    pieces = F.flatten(F.transform(doc, lambda f: f["hunks"]))
    loc = F.aggregate(pieces, F.lit(0), lambda total, h: total + F.size(F.split(F.coalesce(h["code"], F.lit("")), "\n")))
    return findings.select("id", F.size(doc).alias("n_files"), loc.alias("loc")).where("n_files > 0 and loc is not null")
