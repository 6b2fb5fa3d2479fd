"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

First it is seen which word n-grams of the benchmark stand in any document, over all documents. All of these are seeds: an edited
copy may share any of them. Where a document has a seed, the words around it, as many as the item's words on either
side and some more, are aligned with the item, unless they have too few of its words for any alignment to count: matches
score 2, other words and gaps cost 1. A passage is a leak if the best local alignment reaches `SHARE` of the score that the whole
item would have, so edited, cut and paraphrased copies count as far as they keep to the item's words in its order and keep
`N` of them in a row. What is left of the words on either side of a passage is aligned again, until nothing more reaches `SHARE`.

The benchmark goes to the tasks in parts of at most `ITEMS` items, so what is sent is bounded; each part is a pass over the documents.
Whole texts are searched; scores are found row by row, so memory grows with a text's length plus the square of an item's. Empty tables have no leaks. Words are as in `textkit.word_spans`, in lower case. Items of fewer words than `N` have one seed, of all
their words, and wordless items none. Null, empty and wordless texts have no leaks. Repeated items report each, repeated
rows too. Positions count words from 0. Other columns are ignored or, in `drop_leaks`, kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import batch_words, clean_text, gram_hashes, map_rows

N = 3
SHARE = 0.5
ITEMS = 20_000
MATCH, MISS, GAP = 2, -1, 1
_BITS = 22
SCHEMA = "doc_id bigint, item_id bigint, start_word int, end_word int, matches int, score double"


@dataclass(frozen=True)
class Index:
    """seeds: sorted hashes. first, last: their rows in item, offset. filter: a bit for the hashes' low bits."""

    ids: np.ndarray
    words: list[np.ndarray]
    seeds: np.ndarray
    first: np.ndarray
    last: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    filter: np.ndarray


def _index(ids: list[int], words: list[np.ndarray], keep: set[int] | None = None) -> Index:
    rows = sorted((int(g), i, k) for i, w in enumerate(words) for k, g in enumerate(gram_hashes(w, N)) if keep is None or int(g) in keep)
    g, item, offset = (np.array([r[k] for r in rows], t) for k, t in enumerate((np.uint64, np.int64, np.int64)))
    seeds, first, count = np.unique(g, return_index=True, return_counts=True)
    there = np.zeros(1 << _BITS, bool)
    there[(seeds & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
    return Index(np.array(ids, np.int64), words, seeds, first, first + count, item, offset, there)


def _hits(index: Index, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in grams, seed) of the grams that are seeds."""
    at = np.flatnonzero(index.filter[(grams & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
    if not len(at) or not len(index.seeds):
        return at[:0], at[:0]
    seed = np.minimum(np.searchsorted(index.seeds, grams[at]), len(index.seeds) - 1)
    same = index.seeds[seed] == grams[at]
    return at[same], seed[same]


def _doc_grams(words: np.ndarray, short: set[int]) -> list[np.ndarray]:
    """The n-grams of a document, and those of fewer words for items that are shorter."""
    out = [gram_hashes(words, N)] if len(words) >= N else []
    return out + [gram_hashes(words, k) for k in short if len(words) >= k]


def _rows(item: np.ndarray, text: np.ndarray) -> Iterator[np.ndarray]:
    """The rows of the matrix of local alignments, one after the other: a row for each word of the item, after one of zeros."""
    ramp = GAP * np.arange(len(text) + 1, dtype=np.int32)
    row = np.zeros(len(text) + 1, np.int32)
    yield row
    for w in item:
        t = np.maximum(row - GAP, 0)
        t[1:] = np.maximum(t[1:], row[:-1] + np.where(text == w, MATCH, MISS))
        row = np.maximum.accumulate(t + ramp) - ramp
        yield row


def align(item: np.ndarray, text: np.ndarray, middle: bool = False) -> tuple[int, int, int, int]:
    """The best local alignment of two word sequences: its score, matches, and start and end in text; of equals the one that ends first, or that in the middle."""
    low, most = 0, np.zeros(len(text) + 1, np.int32)
    for row in _rows(item, text):
        np.maximum(most, row, out=most)
    score = int(most.max())
    ends = np.flatnonzero(most == score)
    end = int(ends[len(ends) // 2 if middle else 0])
    # each word of an alignment beyond its matches costs 1 at least, so it has no more words than this; only they need the whole matrix
    low = max(0, end - ((MATCH + 1) * len(item) - score) - 1)
    text = text[low:end]
    h = np.stack(list(_rows(item, text)))
    j = len(text)
    i, matches = int(h[:, j].argmax()), 0
    while h[i, j] > 0:
        same = i and j and item[i - 1] == text[j - 1]
        if i and j and h[i, j] == h[i - 1, j - 1] + (MATCH if same else MISS):
            matches += bool(same)
            i, j = i - 1, j - 1
        elif j and h[i, j] == h[i, j - 1] - GAP:
            j -= 1
        else:
            i -= 1
    return score, matches, low + j, end


def _leaks(index: Index, words: np.ndarray, short: set[int], share: float) -> list[tuple[int, int, int, int, float]]:
    near: dict[int, list[tuple[int, int]]] = {}
    for grams in _doc_grams(words, short):
        for at, seed in zip(*_hits(index, grams)):
            for r in range(index.first[seed], index.last[seed]):
                i, size = int(index.item[r]), len(index.words[index.item[r]])
                start = int(at) - int(index.offset[r])
                near.setdefault(i, []).append((max(0, start - 8 - size // 4), min(len(words), start + size + 8 + size // 4)))
    out = []
    for i, spans in near.items():
        spans.sort()
        merged = [list(spans[0])]
        for a, b in spans[1:]:
            if a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        item, full = index.words[i], MATCH * len(index.words[i])
        while merged:
            a, b = merged.pop()
            if MATCH * np.isin(item, words[a:b]).sum() < share * full:  # no alignment has more matches than that
                continue
            score, matches, s, e = align(item, words[a:b], b - a > 4 * len(item))  # many copies are halved again and again
            if score >= share * full:
                out.append((i, a + s, a + e, matches, score / full))
                merged += [[x, y] for x, y in ((a, a + s), (a + e, b)) if MATCH * (y - x) >= share * full]
    return out


def seeds(docs: DataFrame, items: list[tuple[int, str]]) -> Index:
    """The items' n-grams that stand in any document of the whole corpus."""
    text = pa.array([t.lower() for _, t in items], pa.large_string())
    words = [w for _, w in batch_words(text)]
    index = _index([i for i, _ in items], words)
    short = {len(w) for w in words if 0 < len(w) < N}
    shared = docs.sparkSession.sparkContext.broadcast(index)  # at most ITEMS items

    def see(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        there = np.zeros(len(shared.value.seeds), bool)
        for _, w in batch_words(batch.column(0)):
            for grams in _doc_grams(w, short):
                there[_hits(shared.value, grams)[1]] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(there).astype(np.int32))], ["seed"])

    found = map_rows(docs, [F.lower(clean_text("text")).alias("text")], "seed int", see).distinct().collect()
    return _index([i for i, _ in items], words, {int(index.seeds[r.seed]) for r in found})


def _parts(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    rows = [F.col("item_id").cast("bigint").alias("item_id"), clean_text("text").alias("text")]
    part: list[tuple[int, str]] = []
    for r in benchmark.where(F.col("item_id").isNotNull()).select(*rows).orderBy("item_id", "text").toLocalIterator():
        part.append((r.item_id, r.text))
        if len(part) == ITEMS:
            yield part
            part = []
    if part:
        yield part


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """A row for each passage that aligns with an item."""
    columns: list[Column] = [F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(clean_text("text")).alias("text")]
    out = None
    for part in _parts(benchmark):
        found = map_rows(docs, columns, SCHEMA, _finder(seeds(docs, part), docs, share))
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def _finder(index: Index, docs: DataFrame, share: float):
    shared = docs.sparkSession.sparkContext.broadcast(index)  # at most ITEMS items
    short = {len(w) for w in index.words if 0 < len(w) < N}

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = shared.value
        rows = [(d, int(x.ids[i]), a, b, m, s) for d, w in batch_words(batch.column(1)) for i, a, b, m, s in _leaks(x, w, short, share)]
        if rows:
            at, *rest = zip(*rows)
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, k) for c, k in zip(rest, types))], ["doc_id", "item_id", "start_word", "end_word", "matches", "score"])

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows without a leak, with all their columns."""
    out = docs
    for part in _parts(benchmark):
        out = out.where(~_leaky(seeds(docs, part), docs, share)(F.lower(clean_text("text"))))
    return out


def _leaky(index: Index, docs: DataFrame, share: float):
    shared = docs.sparkSession.sparkContext.broadcast(index)  # at most ITEMS items
    short = {len(w) for w in index.words if 0 < len(w) < N}

    @F.arrow_udf("boolean")
    def leaky(text: pa.Array) -> pa.Array:
        return pa.array([bool(_leaks(shared.value, w, short, share)) for _, w in batch_words(text)], pa.bool_())

    return leaky
