"""Problem 8: per-document text statistics, and which texts are natural prose.

Two thresholds on each statistic make a noisy labelling function: it speaks for prose, against it, or
is undecided. The counts of the patterns that the functions make over all documents are all that
expectation-maximisation needs to learn from agreements how often each function says what of each
text type; the posterior type follows from the pattern.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch, spread, table

# Common words of English, German, French and Spanish.
DETERMINERS = frozenset(
    "the a an its our their your dem des ein eine einen einem einer le la les un une ces ses el los las una unos su sus lo".split()
)
LINKS = frozenset(
    "der die das den that this these dieser diese dieses ce cette son sa este esta of in to on at by for with from and or as is are was were be been has have had not but if then than so no it we they "
    "von mit zu im am auf und oder ist sind war wenn dass nicht sich wir es er sie aus bei nach für als auch "
    "de du à au aux en et ou est sont dans sur par pour avec que qui ne pas il elle on nous plus "
    "y o es son con por para del al que se no ha fue como cuando si pero más".split()
)
COMMON = DETERMINERS | LINKS
#: A determiner is not followed by these in any of the languages; there is nothing it could determine.
NOT_AFTER = frozenset("the a an this these its our their of to by for with from and or is are was were der ein eine von mit und oder ist le un une et est el los y es son con".split()) - {"one"}

_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_MARKED = re.compile(r"^\s*(?:[-*•·+]|\d{1,4}[.)])\s|^\s*\||\|\s*$|\(#\d+\)\s*$|^\s*[\w./-]+\s*[:=]\s*\S+\s*$")
_LIST = re.compile(r"^#|(?:\s\|\s|;|,|\t)(?:\S*(?:\s\|\s|;|,|\t)){2,}\S*$")
_ODD = re.compile(r"[^\w\s\x21-\x7e–—…“”‘’„‚«»‹›•·€£§°¡¿]|[¡¿](?=[^\W\d_]?\W)|\w[¿¡¤¶½]")
_SENTENCE = re.compile(r"[.!?…]\s+|\n")

#: The statistics that every document gets.
STATISTICS = ("word_count", "mean_word_length", "symbol_ratio", "punct_line_share", "common_word_share")
TYPES = ("prose", "list", "data", "noise", "repeated", "scrambled")
#: The labelling functions, with the type that each speaks for when it speaks against prose, the value up to which
#: it speaks for prose and the value beyond which it speaks against. All values are small for prose.
FUNCTIONS = {
    "few_common": ("noise", 0.76, 0.87),
    "little_prose": ("list", 0.2, 0.5),
    "symbols": ("data", 0.5, 1.0),
    "word_length": ("data", 0.7, 1.0),
    "repeated_parts": ("repeated", 0.1, 0.5),
    "few_words": ("repeated", 0.7, 1.0),
    "disorder": ("scrambled", 0.03, 0.07),
    "list_lines": ("list", 0.15, 0.5),
    "dense": ("data", 8.0, 12.0),
    "broken_sentences": ("scrambled", 0.1, 0.3),
}
FOR, AGAINST = 0, 2


def measure(text: str | None) -> tuple:
    """The STATISTICS, and the pattern of the FUNCTIONS' votes in base 3. Null and blank texts count as no words."""
    text = text or ""
    solid = len(text) - text.count(" ") - text.count("\n") - text.count("\t")
    tokens = text.split()
    lines = [s for s in text.split("\n") if s.strip()]
    # Lines: how much text stands in those that read as prose, and how much in those of lists; headings are neither.
    words: list[str] = []
    common = prose = listed = enders = 0
    fenced = False
    for line in lines:
        size = len(line)
        own = _WORD.findall(line.lower())
        known = sum(map(COMMON.__contains__, own))
        words += own
        common += known
        enders += line.rstrip().endswith((".", "!", "?", "…", ":", '"', "”"))
        start = line.lstrip()
        if start.startswith("```"):
            fenced = not fenced
            listed += size
        elif fenced:
            listed += size
        elif start.startswith("#"):
            continue
        elif _MARKED.search(line) or (_LIST.search(line) and known < 0.2 * len(own)):
            listed += size
        elif own and sum(map(len, own)) >= 0.72 * (size - line.count(" ")) and (known >= 0.12 * len(own) or len(own) < 5):
            prose += size
    n = len(words)
    letters = sum(map(len, words))
    symbol_ratio = max(0.0, 1.0 - letters / solid) if solid else 0.0
    mean_length = sum(map(len, tokens)) / len(tokens) if tokens else 0.0
    parts = Counter(p.strip().lower() for p in _SENTENCE.split(text))
    again = sum(len(p) * (k - 1) for p, k in parts.items())
    counted = Counter(words)
    determiners = wrong = ends = low = 0
    for a, b in zip(words, words[1:]):
        if a in DETERMINERS:
            determiners += 1
            wrong += b in NOT_AFTER
    for a, b in zip(tokens, tokens[1:]):
        if a[-1] in ".!?":
            ends += 1
            low += b[0].islower()
    whole = sum(map(len, lines)) or 1
    # Constants beside the counts draw the shares of very short texts to an ordinary value, whatever the length.
    values = (
        1.0 - (common + 2) / (n + 8),
        1.0 - prose / whole,
        max(symbol_ratio / 0.3, len(_ODD.findall(text)) / 0.04 / (solid + 1)),
        max(mean_length / 10.5, 2.6 / mean_length) if mean_length else 0.0,
        again / whole,
        max((max(counted.values(), default=0) - 1) / (n + 10) / 0.25, 0.2 * (n + 10) / (len(counted) + 2) - 0.35),
        wrong / (determiners + 4),
        listed / whole,
        solid / (n + 6),
        low / (ends + 2),
    )
    pattern = 0
    for value, (_, good, bad) in zip(values, FUNCTIONS.values()):
        pattern = pattern * 3 + (FOR if value <= good else AGAINST if value > bad else 1)
    return (n, mean_length, symbol_ratio, enders / len(lines) if lines else 0.0, common / n if n else 0.0, pattern)


_SCHEMA = "doc_id long, word_count long, mean_word_length double, symbol_ratio double, punct_line_share double, common_word_share double, pattern int"


def measured(documents: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t) for t in batch.column("text").to_pylist()]
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), *[pa.float64()] * 4, pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", *STATISTICS, "pattern"]
            )

    return documents.select("doc_id", "text").mapInArrow(run, _SCHEMA)


def votes(patterns: np.ndarray) -> np.ndarray:
    """A row of votes, in the order of FUNCTIONS, for each pattern."""
    return patterns[:, None] // 3 ** np.arange(len(FUNCTIONS))[::-1] % 3


#: Weight of the prior on the vote rates, as a share of all documents, so that it means the same at every size.
PRIOR_WEIGHT = 0.005


def prior_rates() -> np.ndarray:
    """Expected rates (type, function, vote): on prose functions seldom speak against, on their own type they mostly do."""
    out = np.tile([0.5, 0.25, 0.25], (len(TYPES), len(FUNCTIONS), 1))
    out[0] = (0.8, 0.15, 0.05)
    for k, (kind, _, _) in enumerate(FUNCTIONS.values()):
        out[TYPES.index(kind), k] = (0.1, 0.2, 0.7)
    return out


def learn(counts: dict[int, int], rounds: int = 300) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Posterior over TYPES of each pattern, and the learned rates, by expectation-maximisation over pattern counts.

    The prior of the types and all rates, those on prose too, are learned under a Dirichlet prior
    of PRIOR_WEIGHT; nothing is clipped, so a function that errs on prose is believed less.
    """
    base = prior_rates()
    if not counts:
        return {}, base
    patterns = np.array(sorted(counts))
    weight = np.array([counts[p] for p in patterns], float)
    said = np.eye(3)[votes(patterns)]
    rate, share = base, np.array([0.8] + [0.2 / (len(TYPES) - 1)] * (len(TYPES) - 1))
    extra = PRIOR_WEIGHT * weight.sum()
    for _ in range(rounds):
        log = np.einsum("pko,tko->pt", said, np.log(rate)) + np.log(share)
        post = np.exp(log - log.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        held = post * weight[:, None]
        mass = held.sum(0)
        share = (mass + 1) / (mass.sum() + len(TYPES))
        before, rate = rate, (np.einsum("pt,pko->tko", held, said) + extra * base) / (mass[:, None, None] + extra)
        if np.abs(rate - before).max() < 1e-7:
            break
    return dict(zip(patterns.tolist(), post)), rate


def _counted(documents: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """The measured rows, and how many have each pattern. There are at most 3 ** len(FUNCTIONS) patterns."""
    rows = Scratch(documents.sparkSession, "quality").cut(measured(documents), "measured")
    return rows, {r["pattern"]: r["n"] for r in rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}


def text_types(documents: DataFrame) -> DataFrame:
    """(doc_id, STATISTICS, text_type, prose_probability, is_prose) for every row.

    Statistics cover whole texts. Null and blank texts have no words and are like the shortest
    prose: nothing in them is a list or junk. Repeated rows get their rows again; no documents give
    no rows.
    """
    rows, counts = _counted(documents)
    found = [(p, TYPES[int(post.argmax())], float(post[0])) for p, post in learn(counts)[0].items()]
    kinds = documents.sparkSession.createDataFrame(found, "pattern int, text_type string, prose_probability double")
    return rows.join(F.broadcast(kinds), "pattern").select(
        "doc_id", *STATISTICS, "text_type", "prose_probability", (F.col("prose_probability") >= 0.5).alias("is_prose")
    )


def accuracies(documents: DataFrame) -> DataFrame:
    """(function, text_type, says_prose, undecided, says_other): the learned rate of each vote of each function on each type."""
    rate = learn(_counted(documents)[1])[1]
    out = [(name, kind, *map(float, rate[t, k])) for k, name in enumerate(FUNCTIONS) for t, kind in enumerate(TYPES)]
    return documents.sparkSession.createDataFrame(out, "function string, text_type string, says_prose double, undecided double, says_other double")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_types(spread(table(spark, sf_dir, "documents"))).where("not is_prose").select("doc_id")


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_types(spread(table(spark, sf_dir, "documents")))


def p8_accuracies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracies(spread(table(spark, sf_dir, "documents")))


def p8_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics alone, shares to nine digits."""
    rows = measured(spread(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "word_count", *(F.round(c, 9).alias(c) for c in STATISTICS[1:]))


_LIST_SQL = ", ".join(f"'{w}'" for w in sorted(COMMON))
_MEASURES_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, t, regexp_extract_all(lower(t), '[\p{{L}}\p{{Nl}}\p{{No}}]+(?:[''’-][\p{{L}}\p{{Nl}}\p{{No}}]+)*') AS w, regexp_extract_all(t, '\S+') AS k,
  list_filter(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '') AS l, length(t) - length(regexp_replace(t, '[ \n\t]', '', 'g')) AS blanks FROM d),
b AS (SELECT *, length(t) - blanks AS solid, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS letters FROM a)
SELECT doc_id, len(w) AS word_count, round(CASE WHEN len(k) > 0 THEN list_sum(list_transform(k, lambda x: length(x))) / len(k) ELSE 0.0 END, 9) AS mean_word_length,
  round(CASE WHEN solid > 0 THEN greatest(0.0, 1.0::DOUBLE - letters / solid) ELSE 0.0 END, 9) AS symbol_ratio,
  round(CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: regexp_matches(rtrim(x, ' ' || chr(9) || chr(13)), '[.!?…:"”]$'))) / len(l) ELSE 0.0 END, 9) AS punct_line_share,
  round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: x IN ({_LIST_SQL}))) / len(w) ELSE 0.0 END, 9) AS common_word_share FROM b"""

QUERIES = {"p8_found": p8_found, "p8_statistics": p8_statistics, "p8_accuracies": p8_accuracies, "p8_measures": p8_measures}
SQL = {"p8_measures": _MEASURES_SQL}
