"""Problem 4: template residue, filler and error-page text instead of content.

A regularised linear classifier over hashed n-grams, length and title features scores every
sentence or line of a value, and its score alone decides. It is trained here, on weak labels from
response-status and phrase rules over a bounded sample (``SAMPLE`` records in all, taken in hash
order). The records of some hosts are held out: the threshold is the one that agrees best there.
The rules take part in the labelling only, never in the scoring.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import spread, table

#: Records in the training sample; half of them are taken among those with a suspicious phrase.
SAMPLE = 8000
#: Records searched for the sample, as a multiple of it.
POOL = 6
#: Hashed features: weights are an array of this fixed size.
WIDTH = 1 << 19
#: Hosts (source platforms here) in this fraction of the hash range are held out of training.
HELD_OUT = 0.2
#: Share of a value's segments with a page phrase from which the whole value is labelled as a page.
PAGE_SHARE = 1 / 3

_FIELD = "[A-Za-z][A-Za-z_]*"
PLACEHOLDER = re.compile(
    r"\{\{\s*" + _FIELD + r"\s*\}\}|<%=?\s*\w+\s*%>|\[\[\s*\w+\s*\]\]|%\(\w+\)[sd]|\$\{\w+\}|@@\w+@@|\b__[A-Z][A-Z_]*__|"
    r"%[A-Z][A-Z_]{2,}%|\$[A-Z][A-Z_]{2,}\$|«\w+»|\[[A-Z][A-Z_]{2,}\]|<[A-Z][A-Z_]{2,}>|(?<![\w{$%])\{(?:\d+|[a-z][a-z_]+)\}(?!\})|"
    r"%[sd]\b|\[x\.y\.z\]|<(?:type|scope|subject)>|[<\[](?:describe|insert|short|your|add|enter)\b[^>\]\n]{0,60}[>\]]|\[[^\]\n]{0,30}\bgoes here\]"
)
FILLER = re.compile(
    r"\blorem\b|\bipsum\b|\basdf\b|^(.)\1{5,}\W*$|^(\w+(?: \w+)?)(?: \2)+\W*$|^(\w+) \3 \w+\W*$|\bTBD\b|^todo\b|\bgoes here\b|"
    r"^(?:sample text|some description|insert text|placeholder text|untitled\b|\(no title\)|enter an? (?:description|title)\b|"
    r"to be (?:written|done|filled in|announced))|^(?:new pull request|bug report template|short summary of the change)\W*$",
    re.I,
)
FORM = re.compile(r"^<!--.*-->$|\breplace this (?:line|text)\b|^\(please fill in\)|^\(empty form\)$|^closes #\W*$|^_[^_]+[?_]_$|^_[^_]+\?_?$", re.I)
RENDERER = re.compile(
    r"^(?:undefined|null|none|nil|NaN|\[object \w+\])(?::? *(?:undefined|null))?\W*$|^<function \w+ at 0x|^template error\b|^render(?:er|ing)? error\b|"
    r"^(?:redirecting|loading|please wait|just a moment)\W*$",
    re.I,
)
_REASON = (
    r"bad request|unauthorized|forbidden|not found|gone|request timeout|too many requests|internal server error|bad gateway|service unavailable|gateway timeout"
)
STATUS = re.compile(
    r"\b[45]\d\d\s*[-–:(]{0,2}\s*(?:" + _REASON + r")\b|^http(?:/\d\S*)? (?:error )?[45]\d\d\W*$|^error [45]\d\d\b|^(?:" + _REASON + r")\s*[|–-]\s*\w+\W*$|"
    r"\bgave status [45]\d\d\b|[\"']status[\"']:\s*[\"']?[45]\d\d|<error><code>|^\s*[\[{].{0,40}[\"'](?:message|error)[\"']\s*:",
    re.I,
)
PAGE = re.compile(
    r"\b(?:enable|turn on|needs|requires) (?:java)?script\b|\bjavascript is disabled\b|\bscripts? (?:are|is|seem to be) (?:needed|required|blocked|disabled)\b|\b(?:run|load) our scripts\b|"
    r"<noscript>|<!doctype|<html\b|"
    r"\b(?:page you are looking for|(?:could not|cannot|can't) find (?:that|the|this) page|(?:could|can) not be displayed|took too long to (?:answer|respond)|down for maintenance|no longer (?:here|available))\b|"
    r"\bsomething went wrong\b|\bunexpected error occurred\b|\b(?:no|any) branch we can show\b|\bserver could not handle the request\b|"
    r"\b(?:verify that you are human|are you a robot|complete the puzzle|unusual traffic|checking your browser)\b|"
    r"\b(?:access (?:to this resource was )?denied|attention required|do not have permission|session has expired|log in again)\b|"
    r"\bsign in to (?:the|view|continue|see)\b|\bwe use cookies\b|^(?:try again later|skip to content)\W*$|^(?:request id|ray) [0-9a-f]{4,}\W*$",
    re.I,
)
#: Words of saying and handling: with them a text more likely speaks about such a thing than is one.
ABOUT = re.compile(
    r"\b(?:used?|uses|using|says?|said|saw|sees|shows?|showed|sends?|sent|returns?|returned|answers?|answered|served|fill(?:s|ed)|replaces?|escapes?|expands?|expanded|unescaped|"
    r"handles?|logs?|logged|prints?|printed|parses?|parsed|variable|string|fixtures?|instead of|whenever|with an?)\b",
    re.I,
)
_PAGES = (STATUS, PAGE, RENDERER)
_SAYABLE = (PLACEHOLDER, FILLER, STATUS, PAGE)
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_UNANSWERED = re.compile(r"#+ .*$|\*\*[^*]+\*\*$|- \[ \]")
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_DELIMITER = re.compile(r"[{<\[%$@«]|__")
#: A delimited name, and how much text beside it is scored with it.
_NAMED = re.compile(
    r"(?:\{\{|\[\[|<%=?|%\(|\$\{|@@|\b__(?=[A-Z])|«|[{<\[%$])\s?\.?(?:\w{2,}?|\d)\s?(?:\}\}|\]\]|%>|\)[sd]|@@|__\b|»|[}>\]%$])|%[sd]\b"
)
BESIDE = 32
_MIXED = re.compile(r"[a-z][A-Z]|[a-z]_[a-z]")
_WORD = re.compile(r"\w{2,}")


def _shape(name: re.Match) -> str:
    return "UPNAME" if name.group().isupper() else "lowname"


def segments(value: str) -> list[str]:
    """Sentences and lines of a text, without fenced code; then each delimited name with the text beside it.

    The name itself is replaced by its case, so that what counts are the signs and words around it.
    """
    if "```" in value:
        value = _FENCE.sub("\n", value)
    for end in ".!?…":
        value = value.replace(end + " ", end + "\n")
    out = [s for s in map(str.strip, value.split("\n")) if s]
    if out and all(map(_UNANSWERED.match, out)) and "\n" in value:
        out.append("(empty form)")
    if _DELIMITER.search(value):
        for part in out[:]:
            if _DELIMITER.search(part):
                for found in _NAMED.finditer(part):
                    a, b = found.span()
                    shape = found.group() if len(found.group()) == 2 else _WORD.sub(_shape, found.group().strip("_"))
                    shape = f"__{shape}__" if found.group().startswith("__") else shape
                    out.append(f"{part[max(0, a - BESIDE) : a]} {shape} {part[b : b + BESIDE]}")
    return out


def weak_label(segment: str) -> bool:
    """What the phrase and response-status rules take the segment for. For training and validation only."""
    return any(p.search(segment) for p in (FORM, RENDERER)) or any(p.search(segment) for p in _SAYABLE) and not ABOUT.search(segment)


def weak_labels(parts: list[str]) -> list[bool]:
    """Labels of a value's segments; where page phrases make up PAGE_SHARE of them, the whole value is a page."""
    out = list(map(weak_label, parts))
    pages = sum(1 for hit, part in zip(out, parts) if hit and any(p.search(part) for p in _PAGES))
    return [True] * len(parts) if pages and pages >= PAGE_SHARE * len(parts) else out


def missing(value: str | None) -> bool:
    return value is None or value.strip().lower() in ("", "nan")


class _Hashes(dict):
    """Hash of each token's shape: numbers and mixed-case names are alike, case is ignored."""

    def __missing__(self, token: str) -> int:
        if len(self) > 400_000:
            self.clear()
        shape = "9" if token.isdigit() else "ID" if _MIXED.search(token) else token.lower()
        found = self[token] = zlib.crc32(shape.encode())
        return found


_HASHES = _Hashes()


def features(parts: list[str], title: list[bool], alone: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """(feature index, segment index) pairs: n-grams of one and two tokens, length, title, sole segment."""
    tokens = [_TOKEN.findall(part) for part in parts]
    counts = np.fromiter(map(len, tokens), np.int64, len(parts))
    h = np.fromiter(map(_HASHES.__getitem__, itertools.chain.from_iterable(tokens)), np.uint32, int(counts.sum()))
    seg = np.repeat(np.arange(len(parts), dtype=np.int32), counts)
    same = seg[1:] == seg[:-1]
    pair = (h[:-1] * np.uint32(0x85EBCA6B) + h[1:] * np.uint32(0x9E3779B1))[same]
    size = np.minimum(np.log2(counts + 1).astype(np.uint32), np.uint32(8))
    flags = np.array(title, np.uint32) * np.uint32(2) + np.array(alone, np.uint32)
    whole = (size * np.uint32(8) + flags + np.uint32(77)) * np.uint32(0x2545F491)
    every = np.concatenate([h, pair ^ (pair >> np.uint32(15)), whole])
    return (every & np.uint32(WIDTH - 1)).astype(np.int32), np.concatenate([seg, seg[1:][same], np.arange(len(parts), dtype=np.int32)])


def scores(weights: np.ndarray, parts: list[str], title: list[bool], alone: list[bool]) -> np.ndarray:
    if not parts:
        return np.empty(0)
    index, owner = features(parts, title, alone)
    z = np.bincount(owner, weights[index], len(parts)) + weights[-1]
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit(parts: list[str], title: list[bool], alone: list[bool], labels: np.ndarray, rounds: int = 150, penalty: float = 5e-6) -> np.ndarray:
    """Weights of a logistic model with an L2 penalty, by full-batch steps of adapted size."""
    weights = np.zeros(WIDTH + 1)
    if not parts:
        return weights
    index, owner = features(parts, title, alone)
    each = np.where(labels > 0, 4.0, 1.0)
    each = each / each.sum()
    squares = np.full(WIDTH + 1, 1e-12)
    for _ in range(rounds):
        z = np.bincount(owner, weights[index], len(parts)) + weights[-1]
        error = (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - labels) * each
        slope = np.append(np.bincount(index, error[owner], WIDTH), error.sum()) + penalty * weights
        squares += slope * slope
        weights -= 0.5 * slope / np.sqrt(squares)
    return weights


class Model(NamedTuple):
    """Weights of the features, the bias last, and the score from which a segment is a case."""

    weights: np.ndarray
    threshold: float


def _examples(rows: list) -> tuple[list[str], list[bool], list[bool], np.ndarray]:
    """Segments of the rows, their flags and their weak labels."""
    parts, title, alone, labels = [], [], [], []
    for row in rows:
        for name in ("title", "description"):
            if not missing(row[name]):
                own = segments(row[name])
                parts += own
                title += [name == "title"] * len(own)
                alone += [len(own) == 1] * len(own)
                labels += weak_labels(own)
    return parts, title, alone, np.array(labels, float)


def best_threshold(p: np.ndarray, labels: np.ndarray) -> float:
    """The score that agrees best with the labels (largest F1, then nearest to one half); one half without cases."""
    if not labels.any():
        return 0.5
    steps = np.arange(0.3, 0.81, 0.05)
    agree = [2 * ((p >= t) & (labels > 0)).sum() / ((p >= t).sum() + labels.sum()) for t in steps]
    return float(max(zip(agree, -np.abs(steps - 0.5), steps))[2])


def held_out(host: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(host, F.lit(""))), 1000) < int(1000 * HELD_OUT)


def suspicious(text: Column) -> Column:
    """Whether a phrase of the weak labels stands in a text, to choose half of the training sample."""
    rules = [F.regexp_like(text, F.lit("(?mUi)" + p.pattern)) for p in (*_SAYABLE, FORM, RENDERER)]
    return reduce(lambda x, y: x | y, rules)


def training_sample(records: DataFrame, host: str = "source_platform", sample: int = SAMPLE) -> list:
    """At most ``sample`` rows (title, description, unseen, odd), half of them with a suspicious phrase.

    They are looked for among POOL times as many records, those in one range of the hash.
    """
    order = F.pmod(F.xxhash64(F.coalesce("id", F.lit("")), F.lit(11)), F.lit(1_000_000))
    part = min(1_000_000, math.ceil(1_000_000 * POOL * sample / max(1, records.count())))
    text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    pool = records.where(order < part).select("title", "description", held_out(F.col(host)).alias("unseen"), suspicious(text).alias("odd"))
    rank = F.row_number().over(Window.partitionBy("odd").orderBy(F.xxhash64("title", "description"), "title", "description"))
    return pool.withColumn("rank", rank).where(F.col("rank") <= sample // 2).drop("rank").collect()


def train(records: DataFrame, host: str = "source_platform", sample: int = SAMPLE) -> Model:
    """Weights fitted on the sample's seen hosts, the threshold on its unseen ones. Without labels all weights are zero."""
    rows = training_sample(records, host, sample)
    weights = fit(*_examples([r for r in rows if not r["unseen"]]))
    parts, title, alone, labels = _examples([r for r in rows if r["unseen"]])
    return Model(weights.astype(np.float32), best_threshold(scores(weights, parts, title, alone), labels))


def judge(model: Model, values: list[str | None], is_title: bool) -> np.ndarray:
    """Residue score of each value, that of its worst segment; -1 for missing values."""
    owner, parts, alone = [], [], []
    out = np.full(len(values), -1.0)
    for k, value in enumerate(values):
        if not missing(value):
            own = segments(value)
            parts += own
            owner += [k] * len(own)
            alone += [len(own) == 1] * len(own)
            out[k] = 0.0
    np.maximum.at(out, np.array(owner, np.int64), scores(model.weights, parts, [is_title] * len(parts), alone))
    return out


_SCHEMA = "id string, field_name string, score double"


def residue_scores(records: DataFrame, model: Model | None = None) -> DataFrame:
    """(id, field_name, score) of every title and description that the model takes for a case.

    Values count whole, whatever their length. Null, blank and ``nan`` values, null ids and an
    empty table give no rows; a repeated record gives its rows again.
    """
    shared = records.sparkSession.sparkContext.broadcast(train(records) if model is None else model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            ids = batch.column("id")
            for name in ("title", "description"):
                got = judge(own, batch.column(name).to_pylist(), name == "title")
                hit = np.flatnonzero(got >= own.threshold)
                if len(hit):
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(hit)), pa.array([name] * len(hit), pa.string()), pa.array(got[hit].astype(float))],
                        names=["id", "field_name", "score"],
                    )

    return records.select("id", "title", "description").where("id is not null").mapInArrow(run, _SCHEMA)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue_scores(spread(table(spark, sf_dir, "ethereum_vulns"))).select("id", "field_name").distinct()


def p4_curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records left after those with residue in title or description are excluded."""
    records = spread(table(spark, sf_dir, "ethereum_vulns"))
    return records.join(residue_scores(records).select("id").distinct(), "id", "left_anti").select("id", "source_platform", "title")


def p4_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the model alone with the weak labels, on hosts seen in training and on hosts held out."""
    return validation(spread(table(spark, sf_dir, "ethereum_vulns")))


def validation(records: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(hosts, n_segments, n_residue, precision, recall) of the model over all segments of all records.

    Only the fitting uses the sample. Hosts without segments have a row of zeros.
    """
    spark = records.sparkSession
    shared = spark.sparkContext.broadcast(train(records, sample=sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        counts = np.zeros((2, 4), np.int64)
        for batch in batches:
            rows = batch.to_pylist()
            for unseen in (False, True):
                parts, title, alone, labels = _examples([r for r in rows if r["unseen"] == unseen])
                truth = labels > 0
                said = scores(model.weights, parts, title, alone) >= model.threshold
                counts[int(unseen)] += [len(parts), truth.sum(), said.sum(), (truth & said).sum()]
        yield pa.RecordBatch.from_arrays([pa.array([False, True]), *map(pa.array, counts.T.copy())], names=["unseen", "n", "residue", "said", "hit"])

    every = records.select("title", "description", held_out(F.col("source_platform")).alias("unseen"))
    counted = every.mapInArrow(run, "unseen boolean, n long, residue long, said long, hit long").groupBy("unseen").agg(*(F.sum(c).alias(c) for c in ("n", "residue", "said", "hit")))
    by = {r["unseen"]: r for r in counted.collect()}
    out = []
    for hosts, unseen in (("seen", False), ("unseen", True)):
        n, residue, said, hit = by[unseen][1:] if unseen in by else (0, 0, 0, 0)
        out.append((hosts, n, residue, hit / max(1, said), hit / max(1, residue)))
    return spark.createDataFrame(out, "hosts string, n_segments long, n_residue long, precision double, recall double")


QUERIES = {"p4_found": p4_found, "p4_curated": p4_curated, "p4_validation": p4_validation}
SQL: dict[str, str] = {}
