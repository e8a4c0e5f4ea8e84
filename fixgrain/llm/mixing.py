"""Problem 7: mixing sources to target weights, interleaved by Pfair scheduling."""

from __future__ import annotations

import base64
import heapq
import importlib.util
import math
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import Scratch, spread, table

#: Vocabulary file of a public tokenizer; a parameter of every operator here.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Tokens of a block of the mix; a parameter. The schedule is a table of one row a block, made in parts by the executors.
BLOCK = 4_000_000
#: Fewest blocks of a mix, so that a small one is interleaved as finely.
LEAST_BLOCKS = 4096
#: Hash ranges a source's documents are summed over.
RANGES = 256
#: More sources than this are refused: targets are a driver-side table.
MOST_SOURCES = 10_000

_ENCODINGS: dict[tuple, object] = {}


def _read_tokenizer(path: str) -> tuple[str, bytes]:
    """Splitting pattern and vocabulary, read on the driver, so that executors need neither file nor helper package."""
    spec = importlib.util.find_spec("public_tokenizers")
    pattern = importlib.import_module("public_tokenizers").PATTERN if spec else PATTERN
    return pattern, Path(path).read_bytes()


#: Splitting pattern where the helper package is absent: words with one leading space, numbers, signs, spaces.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _encoding(pattern: str, vocabulary: bytes):
    key = (pattern, len(vocabulary), hash(vocabulary))
    if key not in _ENCODINGS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        _ENCODINGS[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) of every row; null texts have no tokens."""

    # A vocabulary file is of a few megabytes at most.
    shared = documents.sparkSession.sparkContext.broadcast(_read_tokenizer(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(*shared.value)
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(sizes, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return documents.select("doc_id", "text", "source").mapInArrow(run, "doc_id long, source string, n_tokens long")


def pfair(weights: dict[str, float], blocks: int) -> list[tuple[int, str, int]]:
    """(slot, source, block) so that each source is within one block of its share at every slot.

    Block j of a source with weight w is released at floor(j / w) and due at ceil((j + 1) / w);
    each slot goes to the released block that is due first, ties by name. Weights are scaled to
    add up to 1, and sources of no weight get no slot.
    """
    whole = sum(w for w in weights.values() if w > 0)
    waiting = [(0, name, 0) for name, w in sorted(weights.items()) if w > 0]
    heapq.heapify(waiting)
    due: list[tuple[int, str, int]] = []
    out = []
    slot = 0
    while len(out) < blocks and (waiting or due):
        while waiting and waiting[0][0] <= slot:
            _, name, j = heapq.heappop(waiting)
            heapq.heappush(due, (math.ceil((j + 1) * whole / weights[name] - 1e-9), name, j))
        if due:
            _, name, j = heapq.heappop(due)
            out.append((slot, name, j))
            heapq.heappush(waiting, (math.floor((j + 1) * whole / weights[name] + 1e-9), name, j + 1))
        slot += 1
    return out


def schedule(spark: SparkSession, shares: dict[str, float]) -> DataFrame:
    """(source, block, slot) of all blocks, given how many blocks each source fills.

    Up to LEAST_BLOCKS blocks the schedule is Pfair as a whole. Beyond, it repeats in rounds of about
    that many slots: each round is Pfair, a source having the same whole number of blocks in all
    of them, so that it is ahead of its share by less than one block a round. The rounds are rows
    made by the executors; the driver schedules one of them.
    """
    whole = sum(shares.values())
    if not whole:
        return spark.createDataFrame([], "source string, block long, slot long")
    rounds = max(1, math.ceil(whole / LEAST_BLOCKS))
    each = {name: max(1, math.ceil(n / rounds - 1e-9)) for name, n in shares.items() if n > 0}
    one = pfair({k: float(n) for k, n in each.items()}, sum(each.values()))
    length = max(slot for slot, _, _ in one) + 1
    base = spark.createDataFrame([(name, j, slot, each[name]) for slot, name, j in one if j < each[name]], "source string, j long, first long, each long")
    every = base.withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rounds - 1).cast("long"))))
    return every.select("source", (F.col("round") * F.col("each") + F.col("j")).alias("block"), (F.col("round") * length + F.col("first")).alias("slot"))


def compose(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, size: int | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    The mix has (slot, source, doc_id, repetition, n_tokens), to be read in slot order. It is as
    large as all documents together unless ``size`` in tokens is given, and is scheduled in blocks of
    ``block`` tokens or, if that makes fewer, in LEAST_BLOCKS. A source gives its
    target_share of that, taking its documents in hash order again and again, but none more than
    max_repeats times; each row counts as one text. The report has (source, target_share,
    max_repeats, source_tokens, wanted_tokens, can_reach, mix_tokens, mix_share) for every source
    of the targets; ``can_reach`` is false where source_tokens times max_repeats is too little.

    Documents of other sources or of none are not in the mix but count in its size. Null shares
    and repeats count as 0; of a source named twice in the targets the larger share stands.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "mix")
    wanted = targets.where("source is not null").groupBy("source").agg(F.max(F.struct(F.coalesce("target_share", F.lit(0.0)), F.coalesce("max_repeats", F.lit(0)))).alias("t"))
    rows = wanted.select("source", "t.*").toDF("source", "target_share", "max_repeats").take(MOST_SOURCES + 1)
    if len(rows) > MOST_SOURCES:
        raise ValueError("too many sources")
    sizes = scratch.cut(token_sizes(documents, tokenizer).withColumn("order", F.xxhash64("doc_id", F.lit(3))), "sizes")
    in_range = sizes.withColumn("range", F.floor((F.col("order") / F.lit(2.0**64) + 0.5) * RANGES).cast("int"))
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    size = total if size is None else size
    names = spark.createDataFrame([(r["source"],) for r in rows], "source string")
    sums: dict[str, dict[int, int]] = {}
    for r in in_range.join(F.broadcast(names), "source").groupBy("source", "range").agg(F.sum("n_tokens").alias("n")).collect():
        sums.setdefault(r["source"], {})[r["range"]] = r["n"]
    plan, starts = [], []
    for r in rows:
        own = sums.get(r["source"], {})
        have, want = sum(own.values()), r["target_share"] * size
        take = min(want, have * r["max_repeats"])
        plan.append((r["source"], float(r["target_share"]), int(r["max_repeats"]), have, want, not have * r["max_repeats"] < want, float(take)))
        run = 0
        for k in sorted(own):
            starts.append((r["source"], k, run, have, float(take)))
            run += own[k]
    mixed = sum(p[6] for p in plan)
    blocks = max(LEAST_BLOCKS, math.ceil(mixed / block))
    length = max(1.0, mixed / blocks)
    # Every source has all blocks that its tokens fill, the last one maybe in part, and each has its slot.
    slots = schedule(spark, {p[0]: p[6] / length for p in plan})
    offsets = spark.createDataFrame(starts, "source string, range int, offset long, have long, take double")
    before = F.sum("n_tokens").over(Window.partitionBy("source", "range").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    placed = (
        in_range.join(F.broadcast(offsets), ["source", "range"])
        .where("take > 0 and n_tokens > 0")
        .withColumn("at", F.col("offset") + F.coalesce(before, F.lit(0)))
        .withColumn("repetition", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("take") / F.col("have")).cast("int") - 1))))
        .withColumn("at", F.col("at") + F.col("repetition") * F.col("have"))
        .where("at < take")
        .withColumn("block", F.floor(F.col("at") / length).cast("long"))
    )
    mix = placed.join(slots, ["source", "block"]).select("slot", "source", "doc_id", "repetition", "n_tokens")
    mix = scratch.cut(mix, "mix")
    reached = mix.groupBy("source").agg(F.sum("n_tokens").alias("mix_tokens"))
    report = spark.createDataFrame(
        [p[:6] for p in plan], "source string, target_share double, max_repeats int, source_tokens long, wanted_tokens double, can_reach boolean"
    ).join(reached, "source", "left")
    report = report.withColumn("mix_tokens", F.coalesce("mix_tokens", F.lit(0).cast("long")))
    return mix, report.withColumn("mix_share", F.col("mix_tokens") / F.greatest(F.sum("mix_tokens").over(Window.partitionBy()), F.lit(1)))


def _compose(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return compose(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compose(spark, sf_dir)[1].where("not can_reach").select("source")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compose(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compose(spark, sf_dir)[1]


def mix_violations(documents: DataFrame, targets: DataFrame, mix: DataFrame, report: DataFrame) -> DataFrame:
    """(check, n): texts repeated more than their source allows, rows of other sources, slots of two sources, and reachable
    sources whose size misses what is wanted by more than a thousandth of it and their longest text.
    """
    limits = targets.where("source is not null").groupBy("source").agg(F.max("max_repeats").alias("most"))
    rows = documents.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    uses = mix.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("k")).join(limits, "source", "left").join(rows, ["source", "doc_id"], "left")
    checks = [
        uses.agg(F.count_if(F.col("most").isNotNull() & (F.col("k") > F.col("most") * F.coalesce("copies", F.lit(0)))).alias("n")).select(F.lit("repeats").alias("check"), "n"),
        uses.agg(F.count_if(F.col("most").isNull() | F.col("copies").isNull()).alias("n")).select(F.lit("sources").alias("check"), "n"),
        mix.groupBy("slot").agg(F.count_distinct("source").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n")).select(F.lit("slots").alias("check"), "n"),
    ]
    longest = mix.groupBy("source").agg(F.max("n_tokens").alias("longest"))
    off = F.abs(F.col("mix_tokens") - F.col("wanted_tokens")) > F.col("wanted_tokens") / 1000 + F.coalesce("longest", F.lit(0))
    checks.append(report.where("can_reach").join(longest, "source", "left").agg(F.count_if(off).alias("n")).select(F.lit("sizes").alias("check"), "n"))
    out = checks[0]
    for check in checks[1:]:
        out = out.unionByName(check)
    return out


def p7_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix, report = _compose(spark, sf_dir)
    return mix_violations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), mix, report)


QUERIES = {"p7_found": p7_found, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_violations": p7_violations}
SQL = {
    # What a right mix has, whatever it is: the checks themselves are tested with planted violations.
    "p7_violations": "SELECT unnest(['repeats', 'sources', 'slots', 'sizes']) AS check, 0::BIGINT AS n",
}
