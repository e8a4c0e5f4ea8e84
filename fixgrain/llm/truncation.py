"""Problem 3: values that stop before their text does.

The corpus gives a vocabulary trie for texts and one for code (tables of word prefixes), the endings
of whole sentences by how the sentence begins, the endings of whole lines, and the lengths of
values. A value is cut if it says so, if its JSON or a bracket is left open, if its final token is
an unknown proper prefix of known words, if its last sentence or line of code ends as no whole one
does, or if it ends so at a length at which values pile up.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch, spread, table
from .residue import missing, residue_scores

CODE_FIELDS = ("pre_fix_code", "post_fix_code")
#: Share of a prefix's words under which the prefix alone counts as no word; share of a sentence opening's whole sentences
#: under which an ending counts as none; share of all lines that makes the end of a line known.
WORD_SHARE, END_SHARE, LINE_SHARE = 0.01, 1e-3, 8e-5
#: Whole sentences that an opening needs before its endings say anything.
LEAST_STARTS = 20
#: Last words of a line by which lines are compared.
LINE_WORDS = 12

#: What says or shows at the end of a value that it was cut.
MARKER = re.compile(
    r"(?:\[(?:cut|truncated|snip|\.\.\.|…|more)\]?|\((?:cut|truncated|continued)\)?|<(?:snip|cut|truncated)>|/\* ?(?:cut|snip|truncated) ?\*/|\bread more|"
    r"\[…|…|\.\.\.|&#?\w{0,6}|\\u[0-9a-fA-F]{0,4}|\\|�)\s*$"
)
_END = re.compile(r"[.!?][\"”')]*\s*$")
_SENTENCE = re.compile(r"[.!?][\"”')]*\s+")
_TOKEN = re.compile(r"[\w-]+|[^\w\s]")
_MIXED = re.compile(r"[a-z][A-Z]|[a-z]_[a-z]|^\w*_$")
#: Openings that say nothing about how the sentence goes on.
_LEAD = re.compile(r"^(?:(?:\*\*\w+\*\*|[A-Z]\w+(?: \w+)?[,:]|Today|So|Note|Now)\s+(?:[–-]\s+)?(?=[A-Z#*]))+")
_DIGITS = re.compile(r"\d+")
_COMMENT = re.compile(r"^\s*(?://|#|--|/\*)")


def shape(token: str) -> str:
    """Numbers and mixed-case or underscored names are alike."""
    if not token.isalpha() and _DIGITS.search(token):
        token = _DIGITS.sub("9", token)
    return "ID" if _MIXED.search(token) else token


def line_shape(line: str) -> str:
    """The shapes of a line's last LINE_WORDS words."""
    return " ".join(map(shape, _TOKEN.findall(" ".join(line.split()[-LINE_WORDS:]))))


def line_end(line: str) -> str:
    """The shapes of the last two tokens of a line of code."""
    return " ".join(map(shape, _TOKEN.findall(line)[-2:]))


def sentence_key(sentence: str) -> str:
    """How a sentence begins, and its last two tokens."""
    words = [shape(t) for t in _TOKEN.findall(_LEAD.sub("", sentence))]
    return " ".join(words[:2]) + "\u0001" + " ".join(words[-2:])


def read_description(text: str, count: Counter) -> tuple[int, str, str, str]:
    """(state, final token, sentence key, line shape); state 1 is cut, 2 whole, 0 not yet known.

    Adds the words, whole sentences and lines of the text to ``count``.
    """
    body = text.rstrip()
    lines = [s for s in body.split("\n") if s.strip()]
    last_line = lines[-1].strip()
    fenced = body.count("```") % 2
    count.update(("line", line_shape(line)) for line in lines[:-1])
    sentences: list[str] = []
    inside = False
    for line in lines:
        if line.startswith("```"):
            inside = not inside
        elif not inside:
            sentences += _SENTENCE.split(line.strip() + " ") if line is not lines[-1] else _SENTENCE.split(line.strip())
    sentences = [s for s in sentences if s]
    ended = bool(_END.search(body))
    whole = sentences if ended else sentences[:-1]
    for s in whole:
        count["end", sentence_key(s.rstrip(".!?\"”')"))] += 1
    tokens = _TOKEN.findall(body)
    count.update(("word", t) for t in tokens[:-1] if t[0].isalpha())
    if MARKER.search(body) or fenced:
        return 1, "", "", ""
    if ended or last_line == "```":
        return 2, "", "", ""
    return 0, tokens[-1] if tokens else "", sentence_key(sentences[-1]) if sentences else "", line_shape(last_line)


def read_code(text: str, count: Counter) -> tuple[int, list[tuple[str, str, str]]]:
    """(state, (kind, final token, line shape or end) to look up for each last line) of a JSON code value; states as in read_description."""
    try:
        files = json.loads(text)
        hunks = [h["code"] for f in files for h in f["hunks"]]
    except (ValueError, TypeError, KeyError):
        return 1, []
    ask: list[tuple[str, str, str]] = []
    for code in hunks:
        if not isinstance(code, str) or not code.strip():
            continue
        lines = code.rstrip().split("\n")
        if MARKER.search(lines[-1]):
            return 1, []
        for line in lines[:-1]:
            if _COMMENT.match(line):
                count["code", line_shape(line)] += 1
            elif line.strip():
                tokens = _TOKEN.findall(line)
                count.update(("codeword", t) for t in tokens if t[0].isalpha())
                count["codeend", " ".join(map(shape, tokens[-2:]))] += 1
        last = lines[-1].strip()
        if _COMMENT.match(last):
            ask.append(("code", "", line_shape(last)))
        elif code.count("(") > code.count(")"):
            return 1, []
        elif last[-1] not in ";){}":
            ask.append(("codeend", (_TOKEN.findall(last) or [""])[-1], line_end(last)))
    return 0 if ask else 2, ask


_SCHEMA = "kind string, id string, field_name string, a string, b string, c string, n long, platform string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string()] * 6 + [pa.int64(), pa.string()]
    names = ["kind", "id", "field_name", "a", "b", "c", "n", "platform"]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    count: Counter = Counter()
    for batch in batches:
        rows = []
        ids, platforms = batch.column("id").to_pylist(), batch.column("source_platform").to_pylist()
        for key, platform, text in zip(ids, platforms, batch.column("description").to_pylist()):
            if missing(text):
                continue
            state, token, sentence, line = read_description(text, count)
            count["len", f"description\u0001{len(text)}"] += 1
            count["all", f"description\u0001{platform or ''}"] += 1
            if state < 2:
                rows.append(("value", key, "description", token, sentence, f"{line}\u0001{zlib.crc32(text.encode())}", state * 10**9 + len(text), platform))
        for name in CODE_FIELDS:
            for key, platform, text in zip(ids, platforms, batch.column(name).to_pylist()):
                if missing(text) or text.strip() == "[]":
                    continue
                count["all", f"{name}\u0001{platform or ''}"] += 1
                count["len", f"{name}\u0001{len(text)}"] += 1
                state, asked = read_code(text, count)
                if state == 1:
                    rows.append(("value", key, name, "", "", "", 10**9, platform))
                rows.extend((f"last-{kind}", key, name, token, end, "", len(text), platform) for kind, token, end in asked)
        if rows:
            yield out(rows)
        if len(count) > 300_000:
            yield out([(kind, None, None, key, None, None, n, None) for (kind, key), n in count.items()])
            count.clear()
    if count:
        yield out([(kind, None, None, key, None, None, n, None) for (kind, key), n in count.items()])


def cut_values(records: DataFrame, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """((id, field_name, source_platform, broken_word) of every value that is not whole, (field_name, source_platform, n_values)).

    ``broken_word`` says that the trie takes the final token for a part of a word.

    Missing values, ``nan`` and ``[]`` are no values; rows of a null id are left out. A repeated
    record counts once as a case. Whole texts are read. Values that problem 4 takes for residue are
    not cases here. No records give no rows.
    """
    scratch = scratch or Scratch(records.sparkSession, "truncation")
    rows = records.where("id is not null").select("id", "source_platform", "description", *CODE_FIELDS).mapInArrow(_read, _SCHEMA)
    path = scratch.write(rows, "read", partition_by="kind")
    read = records.sparkSession.read.schema(rows.schema).parquet(path)

    def counts(kind: str) -> DataFrame:
        return read.where(F.col("kind") == kind).groupBy("a").agg(F.sum("n").alias("n"))

    values = read.where("kind = 'value'").select(
        "id",
        "field_name",
        "platform",
        F.col("a").alias("token"),
        F.col("b").alias("sentence"),
        F.substring_index("c", "\u0001", 1).alias("line"),
        F.substring_index("c", "\u0001", -1).alias("copy"),
        (F.col("n") % 10**9).alias("length"),
        (F.col("n") >= 10**9).alias("cut"),
    )
    sure = values.where("cut")
    unsure = values.where("not cut")
    asked = read.where("kind = 'last-codeend'").select("id", "field_name", "platform", F.col("a").alias("token"), F.col("b").alias("end"), F.col("n").alias("length"))

    def trie(words: DataFrame, tokens: DataFrame) -> DataFrame:
        """(token, broken): the nodes of the words' trie that final tokens ask for, and whether each is a proper prefix more than a word.

        Prefixes are made only of lengths that some final token has, so a long word costs no more than a short one.
        """
        wanted = tokens.where(F.col("token").rlike("^[A-Za-z]")).select("token").distinct()
        sizes = [r[0] for r in wanted.select(F.length("token")).distinct().collect()]
        lengths = F.filter(F.array(*map(F.lit, sizes)) if sizes else F.expr("array()").cast("array<int>"), lambda k: k <= F.length("a"))
        nodes = words.select(F.explode(F.transform(lengths, lambda k: F.col("a").substr(F.lit(1), k))).alias("token"), "a", "n").join(wanted, "token", "left_semi")
        own = F.col("a") == F.col("token")
        counts = nodes.groupBy("token").agg(F.sum(F.when(own, F.col("n")).otherwise(0)).alias("n_word"), F.sum("n").alias("n_all"))
        return counts.select("token", (F.col("n_word") < WORD_SHARE * F.col("n_all")).alias("broken"))

    def piles(field: str) -> DataFrame:
        """(length, piled): the lengths that many more of a field's values have than is usual."""
        lengths = counts("len").where(F.substring_index("a", "\u0001", 1) == field).select(F.substring_index("a", "\u0001", -1).cast("long").alias("length"), "n")
        usual = lengths.agg(F.percentile_approx("n", 0.9)).first()[0] or 0
        return lengths.select("length", (F.col("n") > max(3 * usual, 8)).alias("piled")).where("piled")

    nodes = trie(counts("word"), unsure)
    ends = counts("end").select(F.col("a").alias("sentence"), F.col("n").alias("n_end"))
    starts = ends.groupBy(F.substring_index("sentence", "\u0001", 1).alias("start")).agg(F.sum("n_end").alias("n_start"))
    # A last line is vouched for by inner lines and by the last lines of other texts: copies of one text count once.
    inner = counts("line").select(F.col("a").alias("line"), F.col("n").alias("n_line"))
    last = unsure.select("line", "copy").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("n_line"))
    shapes = inner.unionByName(last).groupBy("line").agg(F.sum("n_line").alias("n_line"))
    n_lines = shapes.agg(F.sum("n_line")).first()[0] or 0
    # Blank keys are in no table; they stay out of the joins, where they would be one hot key.
    blank = {c: F.when(F.col(c) != "", F.col(c)) for c in ("token", "sentence", "line")}
    judged = (
        unsure.withColumns(blank)
        .withColumn("start", F.substring_index("sentence", "\u0001", 1))
        .join(nodes, "token", "left")
        .join(ends, "sentence", "left")
        .join(starts, "start", "left")
        .join(shapes, "line", "left")
        .join(piles("description"), "length", "left")
        .na.fill(0)
        .na.fill(False)
    )
    known_line = F.col("n_line") >= max(2.0, LINE_SHARE * n_lines)
    unended = F.col("n_end") <= END_SHARE * F.col("n_start")
    told = F.coalesce((F.col("n_start") >= LEAST_STARTS) | F.col("start").rlike(r"^\S+$"), F.lit(False))
    description = judged.where(~known_line & (F.col("broken") | (unended & (told | F.col("piled"))))).select("id", "field_name", "platform", "broken")
    comments = counts("code")
    n_comments = comments.agg(F.sum("n")).first()[0] or 0
    comment_shapes = comments.where(F.col("n") >= max(2.0, LINE_SHARE * n_comments)).select(F.col("a").alias("b"))
    code = read.where("kind = 'last-code'").join(comment_shapes, "b", "left_anti").select("id", "field_name", "platform", F.lit(False).alias("broken"))
    # A last line of code that does not close: cut if its final token is broken, its ending is none of whole lines, or lengths pile up.
    line_ends = counts("codeend")
    n_ends = line_ends.agg(F.sum("n")).first()[0] or 0
    known_ends = line_ends.where(F.col("n") >= max(2.0, LINE_SHARE * n_ends)).select(F.col("a").alias("end"), F.lit(True).alias("known"))
    code_piles = piles(CODE_FIELDS[0]).withColumn("field_name", F.lit(CODE_FIELDS[0])).unionByName(piles(CODE_FIELDS[1]).withColumn("field_name", F.lit(CODE_FIELDS[1])))
    lasts = asked.join(trie(counts("codeword"), asked), "token", "left").join(known_ends, "end", "left").join(code_piles, ["field_name", "length"], "left").na.fill(False)
    open_code = lasts.where(F.col("broken") | ~F.col("known") | F.col("piled")).select("id", "field_name", "platform", "broken")
    found = reduce(DataFrame.unionByName, (sure.select("id", "field_name", "platform", F.lit(False).alias("broken")), description, code, open_code))
    found = found.groupBy("id", "field_name").agg(F.min("platform").alias("platform"), F.max("broken").alias("broken_word"))
    residue = residue_scores(records).select("id", "field_name").distinct()
    cases = found.join(residue, ["id", "field_name"], "left_anti").withColumnRenamed("platform", "source_platform")
    totals = counts("all").select(
        F.substring_index("a", "\u0001", 1).alias("field_name"), F.substring_index("a", "\u0001", -1).alias("source_platform"), F.col("n").alias("n_values")
    )
    return cases, totals


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_values(spread(table(spark, sf_dir, "ethereum_vulns")))[0].select("id", "field_name")


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each platform cuts each field; a platform without a name is the empty one."""
    cases, totals = cut_values(spread(table(spark, sf_dir, "ethereum_vulns")))
    per = cases.groupBy("field_name", F.coalesce("source_platform", F.lit("")).alias("source_platform")).agg(F.count(F.lit(1)).alias("n_cut"))
    return totals.join(per, ["field_name", "source_platform"], "left").select(
        "source_platform", "field_name", "n_values", F.coalesce("n_cut", F.lit(0)).alias("n_cut"), (F.coalesce("n_cut", F.lit(0)) / F.col("n_values")).alias("rate")
    )


def p3_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field_name, broken_word, n_cut): how many of the cut values end in a part of a word."""
    cases = cut_values(spread(table(spark, sf_dir, "ethereum_vulns")))[0]
    return cases.groupBy("field_name", "broken_word").agg(F.count(F.lit(1)).alias("n_cut"))


QUERIES = {"p3_found": p3_found, "p3_rates": p3_rates, "p3_words": p3_words}
SQL: dict[str, str] = {}
