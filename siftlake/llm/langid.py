"""Language identification: multinomial naive Bayes over hashed character n-grams.

`train` counts the n-grams of a bounded sample of labelled rows (`TRAIN_ROWS`; rows are chosen by a hash of their id,
whole texts are used) and gives a matrix of log probabilities, buckets x languages. `identify` sends it with the tasks and
scores all rows: a batch of texts is a sparse matrix in CSR form (indices of n-gram buckets, one entry an occurrence),
and its product with the matrix gives the scores.

Confidence and margin are rounded to 6 digits. Null, empty and letterless texts have no n-grams: their language is `und` with confidence 0. Ties go to the language that
is first in alphabetical order. Repeated rows are each scored; other columns are ignored, whatever their names. Very long
texts are counted in slices, whole. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import clean_text, map_rows, slices

#: Bound on labelled rows that the model is fitted on.
TRAIN_ROWS = 4000
BITS = 15
#: Characters of a text from which it is scored by counts, in slices of as many.
LONG = 1 << 16
ORDERS = (1, 2, 3)
ALPHA = 0.5
SCHEMA = "doc_id bigint, lang string, confidence double, margin double"

_K = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    prior: np.ndarray
    logp: np.ndarray
    bits: int = BITS


def _characters(text: str) -> np.ndarray:
    """Code points of a text in lower case; runs of characters that aren't letters count as one space. None without a letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = (c >= 97) & (c <= 122) | (c >= 0xAA) & (c != 0xD7) & (c != 0xF7) & ~((c >= 0x2000) & (c <= 0x206F))
    if not letter.any():
        return np.zeros(0, np.uint32)
    c = np.where(letter, c, np.uint32(32))
    return c[np.concatenate([[True], letter[1:] | letter[:-1]])]


def _hashed(c: np.ndarray, bits: int, most: int) -> np.ndarray:
    """Buckets of the n-grams that begin at the first `most` characters."""
    out, shift = [np.zeros(0, np.uint32)], np.uint32(32 - bits)
    with np.errstate(over="ignore"):
        h = np.zeros(len(c), np.uint32)
        for k in ORDERS:
            if len(c) < k:
                break
            h = (h[: len(c) - k + 1] ^ (c[k - 1 :] * _K[0])) * _K[1]
            h ^= h >> np.uint32(15)
            out.append((h[:most] * _K[2] + np.uint32(k)) * _K[0] >> shift)
    return np.concatenate(out)


def buckets(text: str, bits: int = BITS) -> np.ndarray:
    """Buckets of the character n-grams of a text."""
    c = _characters(text)
    return _hashed(c, bits, len(c))


def counts(text: str, bits: int = BITS) -> np.ndarray:
    """How often each bucket stands in a text, of which LONG characters are hashed at once."""
    c, out = _characters(text), np.zeros(1 << bits, np.int64)
    for at in range(0, len(c), LONG):
        out += np.bincount(_hashed(c[at : at + LONG + max(ORDERS) - 1], bits, LONG), minlength=1 << bits)
    return out


def sample(docs: DataFrame, label: str, rows: int) -> DataFrame:
    """About `rows` labelled rows, chosen by a hash of the id: the same ones in each run."""
    labelled = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull())
    share = max(1, -(-docs.count() // rows))
    return labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select("doc_id", F.col(label).alias("label"), "text").limit(2 * rows)


def train(docs: DataFrame, label: str = "lang", rows: int = TRAIN_ROWS, bits: int = BITS) -> Model:
    """Fits the model; a table without labelled rows gives one that answers `und`."""
    taken = sample(docs, label, rows).collect()
    languages = tuple(sorted({r.label for r in taken}))
    at = {x: i for i, x in enumerate(languages)}
    table, n = np.zeros((1 << bits, len(languages))), np.zeros(len(languages))
    for r in taken:
        table[:, at[r.label]] += counts(r.text, bits)
        n[at[r.label]] += 1
    logp = np.log(table + ALPHA) - np.log(table.sum(0) + ALPHA * (1 << bits))
    return Model(languages, np.log(n / max(1, n.sum())), logp, bits)


def score(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log posteriors up to a constant (rows x languages) and the number of n-grams of each row."""
    out = np.tile(model.prior, (len(texts), 1))
    rows = [buckets(t, model.bits) if len(t) <= LONG else np.zeros(0, np.uint32) for t in texts]
    size = np.array([len(r) for r in rows])
    full = np.flatnonzero(size)
    if len(full):
        indices = np.concatenate(rows)
        indptr = np.concatenate([[0], np.cumsum(size[full])[:-1]])
        out[full] += np.add.reduceat(model.logp[indices], indptr, axis=0, dtype=np.float64)
    for i, t in enumerate(texts):
        if len(t) > LONG:  # by counts: memory doesn't grow with text times languages
            n = counts(t, model.bits)
            size[i] = n.sum()
            out[i] += n @ model.logp
    return out, size


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, confidence, margin): the margin is the lead in log probability per n-gram over the next language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages, whatever the size of the input

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m, texts = shared.value, batch.column(1).to_pylist()
        sizes = np.array([len(t) for t in texts])
        lang, conf, lead = [], [], []
        for a, b in slices(sizes, 1 << 19):
            s, n = score(m, texts[a:b])
            if not m.languages:
                lang += ["und"] * (b - a)
                conf += [0.0] * (b - a)
                lead += [0.0] * (b - a)
                continue
            order = np.sort(s, axis=1)
            p = 1 / np.exp(s - order[:, -1:]).sum(1)
            gap = (order[:, -1] - order[:, -2] if s.shape[1] > 1 else np.zeros(b - a)) / np.maximum(n, 1)
            lang += [m.languages[k] if c else "und" for k, c in zip(s.argmax(1), n)]
            conf += np.where(n > 0, p, 0.0).round(6).tolist()
            lead += np.where(n > 0, gap, 0.0).round(6).tolist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(conf, pa.float64()), pa.array(lead, pa.float64())], ["doc_id", "lang", "confidence", "margin"])

    return map_rows(docs, [F.col("doc_id").cast("bigint").alias("doc_id"), clean_text("text").alias("text")], SCHEMA, run)
