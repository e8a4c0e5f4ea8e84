"""Problem 6: evaluation texts that leak into training text, by latent semantic retrieval.

Passages of the corpus and of the items become TF-IDF vectors over the items' words, reduced by
a randomised singular value decomposition. A corpus passage whose vector has a large cosine with an
item passage is a candidate. A leak agrees in nine words of ten, so it also holds some run of SEED
words of the item unchanged: such runs with enough equal words around are candidates as well. A
longest common subsequence of the two texts decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch, spread, table

#: Words in a passage; corpus passages start every STEP words, item passages at every word, so that each
#: corpus passage inside a leak has an item passage at its very place.
PASSAGE, STEP = 14, 5
#: Dimensions of the latent space, and passages it is fitted on at most.
RANK, FITTED = 64, 40_000
#: Cosine from which a passage is a candidate; coarse cells of item passages, and cells searched.
COSINE, CELLS, PROBES = 0.7, 128, 5
#: Parts of a cell; of each it is known which words it holds. The eight parts' counts are held in one number.
PARTS = 8
_COUNTS = np.array([sum((k >> i & 1) << 8 * i for i in range(PARTS)) for k in range(256)], np.uint64)
#: Words that candidates must have in common places for an alignment to be tried.
LEAST_SAME = 10
#: The same, counting the words on both sides that a run of WORDS words through the passage may take.
LEAST_BESIDE = 16
#: What makes a leak: words of a description, lines of a diff, and the share that must agree.
WORDS, LINES, AGREE = 25, 6, 0.9
#: Runs of this many words of descriptions, or LINES lines of diffs, that several items share are common wording.
SHARED = 20
#: Words of the shortest run that a leak holds unchanged, in descriptions (27 words in 4 runs of 30) and in diffs (9 in 2 of 10).
SEED = {False: 7, True: 5}
#: Item passages in one broadcast index; more are searched in several passes, each with an index of this size.
SHARD = 200_000

#: Words by which texts may shift against each other in an alignment, and words over AGREE that may differ on the way.
BAND, LEEWAY = 5, 4

_BESIDE = np.full(WORDS - PASSAGE, -2, np.int32)
#: Words on both sides of such a run that are compared, and how far they may be shifted.
_AROUND, _SHIFT = WORDS - 7, 2
_TOKEN = re.compile(r"\w+")
#: The same for texts in ASCII, which are then split at spaces.
_ASCII = {k: None if chr(k) == "_" else chr(k).lower() if chr(k).isalnum() else " " for k in range(128)}
_MARKUP = re.compile(r"</?(?:a|b|blockquote|br|code|div|em|h[1-6]|hr|i|li|ol|p|pre|span|strong|table|td|th|tr|u|ul)\b[^<>\n]*>|&(?:nbsp|amp|lt|gt|quot|apos|#\d+);", re.I)


def words_of(text: str) -> list[str]:
    """Words without case, punctuation, underscores or markup."""
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    if text.isascii():
        return text.translate(_ASCII).split()
    return _TOKEN.findall(text.replace("_", "").lower())


def parts_of(vocabulary: dict[str, int]) -> tuple[set[str], set[str], set[str]]:
    """What the words begin with, what they end with, and both."""
    begin, end = {w[:k] for w in vocabulary for k in range(1, len(w))}, {w[k:] for w in vocabulary for k in range(1, len(w))}
    return begin, end, begin | end


def numbers_of(words: list[str], vocabulary: dict[str, int], parts: tuple[set[str], set[str], set[str]]) -> list[int]:
    """Words as numbers; words of no item are all the same, and a word of an item that a break parts in two is one."""
    unknown = len(vocabulary)
    begin, end, either = parts
    get = vocabulary.get
    ids = list(map(get, words, repeat(unknown)))
    out: list[int] = []
    done = 0
    for k in [k for k, n in enumerate(ids) if n == unknown and words[k] in either]:
        for i, known, own in ((k - 1, end, words[k]), (k, begin, words[k])):
            if own in known and done <= i < len(words) - 1 and (whole := get(words[i] + words[i + 1])) is not None:
                out += ids[done:i]
                out.append(whole)
                done = i + 2
                break
    return out + ids[done:]


def _runs(is_diff: bool, lines: list[int]) -> list[tuple[int, int]]:
    """Places (from, to) of the runs that make common wording if several items have them: LINES lines with words, or SHARED words."""
    if not is_diff:
        return [(i, i + SHARED) for i in range(len(lines) - SHARED + 1)]
    first = [i for i, k in enumerate(lines) if not i or lines[i - 1] != k] + [len(lines)]
    return list(zip(first, first[LINES:]))


class Items:
    """The items' passages with their place, and which words are common wording of several items."""

    def __init__(self, rows: list[tuple[int, str | None, str | None]]):
        self.texts: list[tuple[int, bool, list[int], np.ndarray]] = []
        vocabulary: dict[str, int] = {}
        owners: dict[tuple, set[int]] = {}
        parts: list[tuple[int, bool, list[str], list[int]]] = []
        for item, description, diff in rows:
            for is_diff, text in ((False, description), (True, diff)):
                if not text or text.strip().lower() in ("", "nan"):
                    continue
                words: list[str] = []
                lines: list[int] = []
                for k, line in enumerate(text.split("\n")):
                    own = words_of(line)
                    words += own
                    lines += [k] * len(own)
                parts.append((item, is_diff, words, lines))
                for a, b in _runs(is_diff, lines):
                    owners.setdefault((is_diff, *words[a:b]), set()).add(item)
        for item, is_diff, words, lines in parts:
            own = np.ones(len(words), bool)
            for a, b in _runs(is_diff, lines):
                if len(owners[(is_diff, *words[a:b])]) > 1:
                    own[a:b] = False
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words]
            self.texts.append((item, is_diff, ids, own, np.array(lines)))
        self.vocabulary = vocabulary


class Seeds:
    """The items' runs of SEED words, and what a text must have around one to be aligned."""

    def __init__(self, texts: list[tuple[int, bool, list[int], np.ndarray, np.ndarray]]):
        self.tables: dict[bool, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        width = SEED[False] + 2 * _AROUND
        rows, offset = [], 0
        self.shift, places = [], {False: [], True: []}
        for t, (_, is_diff, ids, own, lines) in enumerate(texts):
            self.shift.append(offset)
            places[is_diff] += [(t, i) for i in range(len(ids) - SEED[is_diff] + 1) if own[i : i + SEED[is_diff]].all()]
            rows += [[-1] * _AROUND, ids, [-1] * width]
            offset += len(ids) + _AROUND + width
        self.flat = np.array([w for r in rows for w in r], np.int32)
        # The run of own words around each place, its text, and whether a line begins or a text ends there.
        self.low, self.high, self.text = (np.zeros(len(self.flat), np.int64) for _ in range(3))
        self.line, self.border = (np.zeros(len(self.flat) + 1, np.int64) for _ in range(2))
        for t, (_, _, ids, own, lines) in enumerate(texts):
            start = self.shift[t] + _AROUND
            cuts = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
            for a, b in zip(cuts[::2].tolist(), cuts[1::2].tolist()):
                self.low[start + a : start + b], self.high[start + a : start + b] = start + a, start + b
            self.text[start : start + len(ids)] = t
            self.line[start + 1 : start + len(ids) + 1] = np.diff(lines, prepend=-1) != 0
            self.border[start : start + len(ids)] = self.line[start + 1 : start + len(ids) + 1]
            self.border[start + len(ids)] = 1
        # Lines that begin before each place.
        self.line = np.cumsum(self.line)
        # Words of the shortest passage through each place: nine in ten of them agree, some beyond the shift.
        need = []
        for _, is_diff, ids, _, lines in texts:
            least = np.full(len(ids), WORDS)
            if is_diff:
                for a, b in _runs(True, lines.tolist()):
                    least[a:b] = np.minimum(least[a:b], b - a)
            need.append(least * 4 // 5)
        for is_diff, own in places.items():
            where = np.array(own, np.int64).reshape(-1, 2)
            at = where[:, 1] + np.array(self.shift, np.int64)[where[:, 0]] if len(where) else np.empty(0, np.int64)
            keys = hashes(self.flat, SEED[is_diff])[at + _AROUND] if len(at) else np.empty(0, np.uint64)
            order = np.argsort(keys, kind="stable")
            least = np.array([need[t][i : i + SEED[is_diff]].min() for t, i in own], np.int64)
            self.tables[is_diff] = keys[order], where[order], at[order], least[order]
        self.bits = {}
        for is_diff, (keys, *_) in self.tables.items():
            self.bits[is_diff] = bits = np.zeros(1 << 20, bool)
            bits[(keys >> np.uint64(44)).astype(np.int64)] = True

    def find(self, flat: np.ndarray, is_diff: bool) -> tuple[np.ndarray, np.ndarray]:
        """(place in flat, row of the table) of every run of an item that stands in the text."""
        keys = self.tables[is_diff][0]
        got = hashes(flat, SEED[is_diff])
        x = np.flatnonzero(self.bits[is_diff][(got >> np.uint64(44)).astype(np.int64)])
        low, high = np.searchsorted(keys, got[x], "left"), np.searchsorted(keys, got[x], "right")
        n = high - low
        return np.repeat(x, n), np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())

    def candidates(self, flat: np.ndarray, is_diff: bool) -> tuple[np.ndarray, np.ndarray]:
        """(place in flat, row of the table) of the first of each unbroken run with enough equal words in WORDS words around it."""
        _, _, at, least = self.tables[is_diff]
        x, row = self.find(flat, is_diff)
        if not len(x):
            return x, row
        # Texts are apart by more than a run, so that place and difference name one text.
        y = at[row]
        line = (y - x + len(flat)) * np.int64(len(flat) + 1) + x
        line, first = np.unique(line, return_index=True)
        start = np.concatenate([[True], np.diff(line) != 1])
        p, q = x[first[start]], row[first[start]]
        width = SEED[False] + 2 * _AROUND
        a = np.lib.stride_tricks.sliding_window_view(flat, width)
        b = np.lib.stride_tricks.sliding_window_view(self.flat, width)
        keep = np.zeros(len(p), bool)
        for k in range(0, len(p), 20_000):
            u, v = a[p[k : k + 20_000] - _AROUND], b[at[q[k : k + 20_000]]]
            same = u == v
            for d in range(1, _SHIFT + 1):
                same[:, d:] |= u[:, :-d] == v[:, d:]
                same[:, :-d] |= u[:, d:] == v[:, :-d]
            run = np.cumsum(same, axis=1, dtype=np.int16)
            most = np.maximum(run[:, WORDS - 1], (run[:, WORDS:] - run[:, :-WORDS]).max(1))
            keep[k : k + 20_000] = most >= least[q[k : k + 20_000]]
        return p[keep], q[keep]


def hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A number for each run of n words."""
    mixed = (ids.astype(np.int64).astype(np.uint64) + np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD1342543DE82EF95) + mixed[k : k + len(out)]
    return out * np.uint64(0x9E3779B97F4A7C15)


def starts(n: int, step: int) -> np.ndarray:
    """Places at which passages of a text of n words start."""
    return np.arange(0, n - PASSAGE + 1, step)


def passages(rows: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the words' latent rows over each passage, by running totals."""
    total = np.vstack([np.zeros((1, rows.shape[1]), np.float32), np.cumsum(rows[ids], axis=0, dtype=np.float32)])
    return total[at + PASSAGE] - total[at]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _grown(a: np.ndarray, at_a: np.ndarray, room: np.ndarray, b: np.ndarray, at_b: np.ndarray, length: np.ndarray, way: int) -> np.ndarray:
    """How many words of a each pair of places reaches to one side with 0, 1, 2, ... words that differ.

    Rows of the table of a longest common subsequence, BAND words to both sides of the diagonal, for
    all pairs at once: a word that is replaced, missing or added counts one, and a reach ends with a common
    word. A pair ends where it has LEEWAY words more that differ than one in ten.
    """
    most = LEEWAY + int(room.max(initial=0) * (1 - AGREE)) + 1
    reach = np.full((len(at_a), most + 1), -1, np.int32)
    reach[:, 0] = 0
    apart = np.arange(-BAND, BAND + 1, dtype=np.int16)
    live = np.arange(len(at_a))
    cost = np.where(apart < 0, 4 * BAND, apart).astype(np.int16)[None].repeat(len(live), 0)
    windows = np.lib.stride_tricks.sliding_window_view(b, 2 * BAND + 1)
    for i in range(int(room.max(initial=0))):
        keep = (room[live] > i) & (length[live] > i - BAND) & (cost.min(1) <= LEEWAY + i * (1 - AGREE))
        if not keep.all():
            live, cost = live[keep], cost[keep]
        if not len(live):
            break
        same = windows[at_b[live] + way * i - BAND][:, ::way] == a[at_a[live] + way * i][:, None]
        if i < BAND:
            same[:, : BAND - i] = False
        errors = np.where(same, cost, most + 1).min(1)
        ends = errors <= most
        reach[live[ends], errors[ends]] = i + 1
        lost = cost[:, 1:] + np.int16(1)
        cost = cost + ~same
        np.minimum(cost[:, :-1], lost, out=cost[:, :-1])
        cost = np.minimum.accumulate(cost - apart, axis=1) + apart
    return reach


def aligned(a: np.ndarray, at_a: np.ndarray, low: np.ndarray, high: np.ndarray, b: np.ndarray, at_b: np.ndarray, first: np.ndarray, last: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, from, to): the longest run of a, between low and high, through each pair of places that agrees with b in AGREE of its words.

    Pairs without a run of ``least`` words are left out.
    """
    right = _grown(a, at_a, high - at_a, b, at_b, last - at_b, 1)
    left = _grown(a, at_a - 1, at_a - low, b, at_b - 1, at_b - first, -1)
    pairs = np.flatnonzero(right.max(1) + left.max(1) >= least)
    right, left, at = right[pairs], left[pairs], at_a[pairs]
    most, start, end = np.zeros(len(pairs), np.int64), at.copy(), at.copy()
    errors = np.arange(right.shape[1])
    rows = np.arange(len(pairs))
    for k in range(left.shape[1]):
        span = left[:, k : k + 1] + right
        good = (left[:, k : k + 1] >= 0) & (right >= 0) & (k + errors <= np.maximum(1, span * (1 - AGREE) + 1e-9))
        span = np.where(good, span, 0)
        n = span.argmax(1)
        better = span[rows, n] > most
        most[better] = span[rows, n][better]
        start[better], end[better] = (at - left[:, k])[better], (at + right[rows, n])[better]
    keep = most >= least[pairs]
    return pairs[keep], start[keep], end[keep]


def leaks(documents: DataFrame, items: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(item_id, doc_id, part, n_words, n_lines, cosine): each document with a passage of an item.

    ``part`` is description or diff. Whole texts are searched, in passages that overlap. Wording
    that several items share does not count as a passage. Null texts have no passages; repeated
    documents are found once per id; without items or documents there are no rows.
    """
    spark = documents.sparkSession
    rows = items.select("item_id", "description", "diff").where("item_id is not null").distinct().collect()
    known = Items(sorted((tuple(r) for r in rows), key=repr))
    schema = "item_id long, doc_id long, part string, n_words long, n_lines long, cosine double"
    if not known.vocabulary:
        return spark.createDataFrame([], schema)
    scratch = Scratch(spark, "leaks")
    size = len(known.vocabulary)
    shared = spark.sparkContext.broadcast(known.vocabulary)

    # Every word of every document as a number; words of no item are all the same.
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        parts = parts_of(vocabulary)
        for batch in batches:
            ids = [np.array(numbers_of(words_of(t), vocabulary, parts) if t else [], np.int32) for t in batch.column("text").to_pylist()]
            ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            column = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int32), *ids])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column], names=["doc_id", "words"])

    numbered = documents.where("doc_id is not null").select("doc_id", "text").mapInArrow(number, "doc_id long, words array<int>")
    numbered = scratch.cut(numbered, "numbered")

    def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list]:
        column = batch.column("words")
        offsets = column.offsets.to_numpy()
        return column.values.to_numpy(zero_copy_only=False), offsets, batch.column("doc_id").to_pylist()

    # Corpus statistics over all documents: in how many each word stands, and how many passages there are.
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, last = np.zeros(size + 1, np.int64), np.empty(size + 1, np.int64)
        docs = words = 0
        for batch in batches:
            values, offsets, _ = unpacked(batch)
            # A word counts where it stands in a document for the last time.
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                own, places = values[a:b], np.arange(b - a)
                last[own] = places
                seen[own[last[own] == places]] += 1
            docs += len(offsets) - 1
            words += int(offsets[-1] - offsets[0])
        yield pa.RecordBatch.from_arrays([pa.array([*range(size + 1), -1, -2]), pa.array([*seen.tolist(), docs, words])], names=["word", "n"])

    counts = {r["word"]: r["n"] for r in numbered.select("doc_id", "words").mapInArrow(tally, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    n_docs, n_words = counts.get(-1, 0), counts.get(-2, 0)
    if not n_words:
        return spark.createDataFrame([], schema)
    frequency = np.array([counts.get(k, 0) for k in range(size)], float)
    idf = np.append(np.log((1.0 + n_docs) / (1.0 + frequency)) + 0.3, np.log(1.0 + n_docs) * 0.5).astype(np.float32)

    # Randomised range finder: each partition sends the product of its passages with a random matrix.
    rng = np.random.default_rng(17)
    wide = RANK + 16
    probe = (rng.standard_normal((size + 1, wide)) / np.sqrt(wide)).astype(np.float32) * idf[:, None]
    part = min(1.0, FITTED * STEP / n_words)
    given = spark.sparkContext.broadcast((probe, idf))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random, weight = given.value
        total = np.zeros((size + 1, wide), np.float32)
        for batch in batches:
            values, offsets, _ = unpacked(batch)
            for a, b in zip(offsets[:-1], offsets[1:]):
                own = values[a:b]
                at = starts(len(own), STEP)
                if len(at):
                    got = passages(random, own, at)
                    for k in range(PASSAGE):
                        np.add.at(total, own[at + k], got)
        total *= weight[:, None]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    sampled = numbered.where(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1_000_000)) < int(1_000_000 * part))
    basis = np.zeros((size + 1, wide), np.float64)
    for r in sampled.coalesce(16).mapInArrow(sketch, "part binary").toLocalIterator():
        basis += np.frombuffer(r["part"], np.float32).reshape(size + 1, wide)
    latent, _ = np.linalg.qr(basis)
    # Rows of the map from words to the latent space.
    turn = np.linalg.svd(latent.T @ basis)[0][:, :RANK]
    rows_of = (idf[:, None] * (latent @ turn)).astype(np.float32)

    # A word of no item says nothing about which item a passage is of.
    rows_of[size] = 0.0
    indexes = [_index(part, rows_of, rng) for part in _shards(known.texts)]

    def searched(own: tuple) -> DataFrame:
        index = spark.sparkContext.broadcast(own)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values, offsets, keys = unpacked(batch)
                out: list[tuple] = []
                group: list[tuple[int, np.ndarray, np.ndarray]] = []
                held = 0
                for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
                    own = values[a:b]
                    if len(own) >= min(SEED.values()):
                        group.append((k, own, starts(len(own), STEP)))
                        held += len(own) // STEP
                    if held > 60_000 or (k == len(offsets) - 2 and group):
                        out += _search_group(group, keys, *index.value, cosine)
                        group, held = [], 0
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["item_id", "doc_id", "part", "n_words", "n_lines", "cosine"])

        return numbered.mapInArrow(search, schema)

    found = reduce(DataFrame.unionByName, map(searched, indexes))
    best = F.max(F.struct("n_words", "n_lines", "cosine")).alias("best")
    return found.groupBy("item_id", "doc_id", "part").agg(best).select("item_id", "doc_id", "part", "best.*")


def _shards(texts: list) -> list[list]:
    """The item texts in parts of about SHARD words."""
    out, held = [[]], 0
    for text in texts:
        if held > SHARD:
            out.append([])
            held = 0
        out[-1].append(text)
        held += len(text[2])
    return out


def _index(texts: list, rows_of: np.ndarray, rng: np.random.Generator) -> tuple:
    """What a search needs of some item texts: latent vectors of their passages in coarse cells, places, words beside them, and runs."""
    own_vectors, places = [np.empty((0, RANK), np.float32)], []
    for t, (_, _, ids, own, _) in enumerate(texts):
        numbers = np.array(ids, np.int32)
        # A run of an item's own words holds passages of own words only; the others are common wording.
        at = np.array([p for p in starts(len(numbers), 1) if own[p : p + PASSAGE].all()], np.int64)
        if len(at):
            own_vectors.append(passages(rows_of, numbers, at))
            places += [(t, int(p)) for p in at]
    if not places:
        places = [(0, 0)]
        own_vectors = [np.zeros((1, RANK), np.float32)]
    vectors = _unit(np.vstack(own_vectors))
    # Coarse cells of the item passages: a few rounds of spherical k-means.
    cells = min(CELLS, len(vectors))
    centres = vectors[rng.choice(len(vectors), cells, replace=False)]
    for _ in range(8):
        near = (vectors @ centres.T).argmax(1)
        centres = _unit(np.vstack([vectors[near == k].sum(0) if (near == k).any() else centres[k] for k in range(cells)]))
    near = (vectors @ centres.T).argmax(1)
    members = [x for k in range(cells) for x in np.array_split(np.flatnonzero(near == k), PARTS)]
    where = np.array(places, np.int64)
    seeds = Seeds(texts)
    where = where[:, 1] + np.array(seeds.shift, np.int64)[where[:, 0]] + _AROUND
    marks = _signs(seeds.flat)[where]
    # The words of each part of a cell as bits of a byte; words of no item are of none.
    words = np.zeros((cells, len(rows_of)), np.uint8)
    for k, own in enumerate(members):
        for i in range(PASSAGE):
            words[k // PARTS, seeds.flat[where[own] + i]] |= 1 << k % PARTS
    words[:, -1] = 0
    return rows_of, vectors.astype(np.float32), centres.astype(np.float32), members, words, where, marks, texts, seeds


def _signs(ids: np.ndarray) -> np.ndarray:
    """The words of the passage at each place as bits of a number."""
    out = np.uint64(1) << ((ids.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58))
    held = 1
    while held < PASSAGE:
        more = min(held, PASSAGE - held)
        out, held = out[:-more] | out[more:], held + more
    return out


def _same(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, beside: int, apart: int) -> np.ndarray:
    """Words in common places of each pair of passages and ``beside`` words around, or up to ``apart`` places from it."""
    out = np.zeros(len(p), np.uint8)
    for i in range(0, len(p), 8192):
        x, y, total = p[i : i + 8192] - beside, q[i : i + 8192] - beside, out[i : i + 8192]
        u, v = ([text[at + k] for k in range(PASSAGE + 2 * beside)] for text, at in ((a, x), (b, y)))
        for k in range(len(u)):
            for d in range(max(0, k - apart), min(len(v), k + apart + 1)):
                total += u[k] == v[d]
    return out


def _search_group(group, keys, latent_rows, queries, middle, inside, words, where, marks, texts, seeds, cosine) -> list[tuple]:
    gap = np.full(SEED[False] + 2 * _AROUND, -2, np.int32)
    flat = np.concatenate([gap] + [x for _, own, _ in group for x in (own, gap)])
    shift = np.concatenate([[0], np.cumsum([len(own) + len(gap) for _, own, _ in group])])[:-1] + len(gap)
    found = [_near(group, flat, shift, latent_rows, queries, middle, inside, words, where, marks, seeds.flat, cosine)]
    for is_diff in SEED:
        p, q = seeds.candidates(flat, is_diff)
        found.append((p, seeds.tables[is_diff][2][q] + _AROUND))
    at_text, at_item = (np.concatenate(x) for x in zip(*found))
    if not len(at_text):
        return []
    at_text, at_item = _anchored(flat, seeds, at_text, at_item)
    ends = shift + [len(own) for _, own, _ in group]
    g = np.searchsorted(shift, at_text, "right") - 1
    is_diff_text = np.array([text[1] for text in texts])
    out: list[tuple] = []
    # The table has a column for each word that may differ, in the longest text of an item.
    size = max(1, 4_000_000 // (LEEWAY + 2 + int((seeds.high - seeds.low).max() * (1 - AGREE))))
    for k in range(0, len(g), size):
        p, q, own = at_text[k : k + size], at_item[k : k + size], g[k : k + size]
        t = seeds.text[q]
        diff = is_diff_text[t]
        pairs, start, end = aligned(seeds.flat, q, seeds.low[q], seeds.high[q], flat, p, shift[own], ends[own], np.where(diff, LINES, WORDS))
        n_lines = np.maximum(0, seeds.line[end] - seeds.line[start] - (1 - seeds.border[end]))
        keep = ~diff[pairs] | (n_lines >= LINES)
        pairs, n_lines, n_words = pairs[keep], n_lines[keep], (end - start)[keep]
        score = _cosines(flat, seeds.flat, latent_rows, p[pairs], q[pairs])
        for j, n, lines, s in zip(pairs.tolist(), n_words.tolist(), n_lines.tolist(), score.tolist()):
            item, is_diff = texts[t[j]][:2]
            out.append((item, keys[group[own[j]][0]], "diff" if is_diff else "description", n, lines, s))
    return out


def _anchored(flat: np.ndarray, seeds: Seeds, at_text: np.ndarray, at_item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The starts of the longest runs of equal words in each pair of passages, once each."""
    longest = np.zeros(len(at_text), np.int64)
    start = np.zeros(len(at_text), np.int64)
    run = np.zeros(len(at_text), np.int64)
    for k in range(PASSAGE):
        run = np.where(flat[at_text + k] == seeds.flat[at_item + k], run + 1, 0)
        better = run > longest
        longest[better], start[better] = run[better], k + 1 - run[better]
    p, q = (at_text + start)[longest > 0], (at_item + start)[longest > 0]
    back = np.arange(len(p))
    while len(back):
        back = back[(q[back] > seeds.low[q[back]]) & (flat[p[back] - 1] == seeds.flat[q[back] - 1])]
        p[back] -= 1
        q[back] -= 1
    both = np.unique(p * np.int64(len(seeds.flat)) + q)
    return both // len(seeds.flat), both % len(seeds.flat)


def _cosines(flat, item_flat, latent_rows, p, q) -> np.ndarray:
    """The cosine of the two passages that start at each pair of places, shorter at the end of a text."""
    own = np.arange(PASSAGE)
    u, v = flat[p[:, None] + own], item_flat[q[:, None] + own]
    # Beyond the end of a text there is no word, which says as little as a word of no item.
    u, v = (latent_rows[np.where((x < 0) | (np.minimum.accumulate(x, axis=1) < 0), -1, x)].sum(1) for x in (u, v))
    return (_unit(u) * _unit(v)).sum(1)


def _near(group, flat, shift, latent_rows, queries, middle, inside, words, where, marks, item_flat, cosine) -> tuple[np.ndarray, np.ndarray]:
    """(place in flat, item place) of all corpus passages that are near an item passage."""
    unknown = len(latent_rows) - 1
    at = np.concatenate([at + s for (_, _, at), s in zip(group, shift)])
    # Passages with too many words of no item cannot reach LEAST_SAME common words.
    strange = np.concatenate([[0], np.cumsum(flat == unknown)])
    at = at[strange[at + PASSAGE] - strange[at] <= PASSAGE - LEAST_SAME]
    none = np.empty(0, np.int64)
    if not len(at):
        return none, none
    windows = np.lib.stride_tricks.sliding_window_view(flat, PASSAGE)[at]
    got = _unit(sum(latent_rows[windows[:, k]] for k in range(PASSAGE)))
    lacks = ~_signs(flat)[at]
    close = got @ middle.T
    cell = np.empty((len(at), min(PROBES, middle.shape[0])), np.int64)
    for k in range(cell.shape[1]):
        cell[:, k] = close.argmax(1)
        close[np.arange(len(at)), cell[:, k]] = -2
    # A passage with fewer words of a part than LEAST_SAME has fewer in common with each passage of it.
    held, of_cells = np.zeros(cell.shape, np.uint64), cell * len(latent_rows)
    for k in range(PASSAGE):
        held += _COUNTS[words.ravel()[of_cells + windows[:, k][:, None]]]
    x, part = np.nonzero(held.astype("<u8").view(np.uint8).reshape(-1, PARTS) >= LEAST_SAME)
    part += cell.ravel()[x] * PARTS
    order = np.argsort(part.astype(np.uint16), kind="stable")
    by_part, bounds = (x // cell.shape[1])[order], np.searchsorted(part[order], np.arange(len(inside) + 1))
    hits = [(none, none)]
    # Blocks of this many pairs stay in a core's own memory.
    block = 1 << 16
    scores, near = np.empty(block, np.float32), np.empty(block, bool)
    for k in range(len(inside)):
        asking = by_part[bounds[k] : bounds[k + 1]]
        if not len(asking) or not len(inside[k]):
            continue
        of_cell, vectors, of_marks, of_lacks = queries[inside[k]].T.copy(), got[asking], marks[inside[k]], lacks[asking]
        width = max(1, block // len(asking)) if len(inside[k]) > block else len(inside[k])
        for c in range(0, len(inside[k]), width):
            for i in range(0, len(asking), max(1, block // width)):
                u, v = vectors[i : i + max(1, block // width)], of_cell[:, c : c + width]
                size = len(u) * v.shape[1]
                np.matmul(u, v, out=scores[:size].reshape(len(u), -1))
                hit = np.flatnonzero(np.greater_equal(scores[:size], cosine, out=near[:size])).astype(np.uint32)
                x = hit // np.uint32(v.shape[1])
                y = hit - x * np.uint32(v.shape[1])
                # Each place takes one word away at most, so passages that lack more words than that are out.
                keep = np.bitwise_count(of_marks[c:][y] & of_lacks[i:][x]) <= PASSAGE - LEAST_SAME
                hits.append((at[asking[i:][x[keep]]], where[inside[k][c:][y[keep]]]))
    p, q = (np.concatenate(x) for x in zip(*hits))
    # Few words in common places, even up to two places apart, leave no common run of
    # WORDS words through the passage; first the passages alone, then with their sides.
    keep = _same(flat, item_flat, p, q, 0, 1) >= LEAST_SAME
    p, q = p[keep], q[keep]
    keep = _same(flat, item_flat, p, q, len(_BESIDE), 2) >= LEAST_BESIDE
    return p[keep], q[keep]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "eval_items")).select("item_id", "doc_id").distinct()


def p6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "eval_items"))


QUERIES = {"p6_found": p6_found, "p6_passages": p6_passages}
SQL: dict[str, str] = {}
