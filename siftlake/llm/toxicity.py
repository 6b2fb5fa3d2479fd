"""Toxicity: a cumulative-link ordinal regression over sparse text features.

Grades are 0 (not toxic) to 3. The labels table only says toxic or not; the grade of a toxic row follows from how many
distinct telling features its text has (`grade`). One weight vector serves all thresholds: P(grade <= k) is
sigmoid(theta[k] - w.x) with theta in ascending order, and the severity is the expected grade, the sum over k of P(grade > k).

Features are hashed words and hashed word prefixes of 4 to 6 bytes, present or absent, in lower case, from whole texts. The
model is fitted on at most `TRAIN_ROWS` labelled rows, chosen by a hash of their id; scoring covers all rows.

Null and empty texts have no features and get the severity of the model's intercepts. A table without toxic labels gives a
model that rejects nothing. Repeated rows are each scored; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import clean_text, hash_spans, map_rows, slices, text_bytes, word_slices, word_spans

#: Bound on labelled rows that the model is fitted on.
TRAIN_ROWS = 12_000
BITS = 20
GRADES = 4
#: A feature is kept if it stands in so many toxic rows at least and its log odds are so many standard errors from 0.
MIN_ROWS, MIN_Z = 4, 3.5
#: Expected severity from which a document is rejected.
REJECT = 0.5
SCHEMA = "doc_id bigint, severity double, grade int, toxic boolean"


@dataclass(frozen=True)
class Model:
    weight: np.ndarray  # of each bucket
    theta: np.ndarray

    def severity(self, z: np.ndarray) -> np.ndarray:
        return _sigmoid(z[:, None] - self.theta).sum(1)

    def grades(self, z: np.ndarray) -> np.ndarray:
        """The most probable grade; of equals the lowest."""
        above = np.hstack([np.ones((len(z), 1)), _sigmoid(z[:, None] - self.theta), np.zeros((len(z), 1))])
        return (above[:, :-1] - above[:, 1:]).argmax(1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def _buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, bucket) for words and their prefixes."""
    at, h = [np.arange(len(words))], [words]
    for n in (4, 5, 6):
        k = np.flatnonzero(ends - starts > n)
        at.append(k)
        h.append(hash_spans(data, starts[k], starts[k] + n) + np.uint64(n))
    return np.concatenate(at), (np.concatenate(h) >> np.uint64(64 - BITS)).astype(np.int32)


def features(text: pa.Array, keep: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its distinct buckets); keep: only buckets where it is true."""
    data, offsets = text_bytes(text)
    for a, b in slices(np.diff(offsets)):
        part, cut = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if b - a == 1:
            found = [np.zeros(0, np.int32)]
            for at, to in word_slices(part):
                starts, ends = word_spans(part[at:to])
                h = _buckets(part[at:to], starts, ends, hash_spans(part[at:to], starts, ends))[1]
                found.append(np.unique(h if keep is None else h[keep[h]]))
            yield a, np.unique(np.concatenate(found))
            continue
        spaced = np.zeros(len(part) + b - a, np.uint8)
        spaced[np.arange(len(part)) + np.repeat(np.arange(b - a), np.diff(cut))] = part
        cut = cut + np.arange(b - a + 1)
        starts, ends = word_spans(spaced)
        at, h = _buckets(spaced, starts, ends, hash_spans(spaced, starts, ends))
        if keep is not None:
            at, h = at[keep[h]], h[keep[h]]
        row = np.searchsorted(cut, starts[at], "right") - 1
        pair = np.unique(row.astype(np.int64) << 32 | h)
        row, h = pair >> 32, (pair & 0xFFFFFFFF).astype(np.int32)
        edge = np.searchsorted(row, np.arange(b - a + 1))
        for i in range(b - a):
            yield a + i, h[edge[i] : edge[i + 1]]


def grade(toxic: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """0 for rows that aren't toxic; else 1, 2 or 3 for up to 2, up to 4 or more telling features."""
    return np.where(toxic, 1 + (hits > 2) + (hits > 4), 0)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, steps: int = 300) -> Model:
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = max(1, -(-labels.count() // rows))
    taken = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).join(docs.select("doc_id", F.lower(clean_text("text")).alias("text")), "doc_id").select("toxic", "text").limit(2 * rows).toArrow()
    y = taken.column("toxic").to_numpy().astype(int) > 0
    xs = [x for chunk in taken.column("text").chunks for _, x in features(chunk)]
    del taken
    pa.default_memory_pool().release_unused()  # the driver outlives the training rows
    count = [np.zeros(1 << BITS), np.zeros(1 << BITS)]
    for x, t in zip(xs, y):
        count[int(t)][x] += 1
    clean, bad = count
    n0, n1 = max(1, (~y).sum()), max(1, y.sum())
    odds = np.log((bad + 0.5) / (n1 - bad + 0.5)) - np.log((clean + 0.5) / (n0 - clean + 0.5))
    z = odds / np.sqrt(1 / (bad + 0.5) + 1 / (n1 - bad + 0.5) + 1 / (clean + 0.5) + 1 / (n0 - clean + 0.5))
    keep = (np.abs(z) >= MIN_Z) & (bad >= MIN_ROWS)
    telling = keep & (odds > 3)
    xs = [x[keep[x]] for x in xs]
    return fit(xs, grade(y, np.array([telling[x].sum() for x in xs], int)), steps)


def fit(xs: list[np.ndarray], y: np.ndarray, steps: int = 300, l2: float = 1e-3) -> Model:
    """Maximum likelihood with a ridge penalty by gradient steps (Adam)."""
    used, flat = np.unique(np.concatenate([*xs, np.zeros(0, np.int32)]), return_inverse=True)
    row = np.repeat(np.arange(len(xs)), [len(x) for x in xs])
    w, n = np.zeros(len(used)), max(1, len(xs))
    # theta is theta[0] and logarithms of the gaps, which keeps the thresholds in order
    share = np.clip([(y <= k).mean() if len(y) else 1 for k in range(GRADES - 1)], 0.01, 0.995)
    t = np.log(share / (1 - share))
    p = np.concatenate([w, [t[0]], np.log(np.maximum(np.diff(t), 0.05))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1 if y.any() else 1):
        w, gaps = p[: len(used)], np.exp(p[len(used) + 1 :])
        theta = p[len(used)] + np.concatenate([[0], np.cumsum(gaps)])
        s = np.bincount(row, w[flat], minlength=len(xs))
        c = _sigmoid(np.hstack([np.full((len(xs), 1), -40.0), theta - s[:, None], np.full((len(xs), 1), 40.0)]))
        lo, hi = c[np.arange(len(xs)), y], c[np.arange(len(xs)), y + 1]
        mass = np.maximum(hi - lo, 1e-12)
        dlo, dhi = lo * (1 - lo) / mass, hi * (1 - hi) / mass
        gs = (dhi - dlo) / n  # derivative of the loss by s
        gt = np.array([(np.where(y == k + 1, dlo, 0) - np.where(y == k, dhi, 0)).sum() for k in range(GRADES - 1)]) / n
        g = np.concatenate([np.bincount(flat, gs[row], minlength=len(used)) + l2 / n * w, [gt.sum()], [gt[k + 1 :].sum() * gaps[k] for k in range(GRADES - 2)]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weight = np.zeros(1 << BITS, np.float32)
    weight[used] = p[: len(used)]
    theta = p[len(used)] + np.concatenate([[0], np.cumsum(np.exp(p[len(used) + 1 :]))])
    return Model(weight, theta if y.any() else np.full(GRADES - 1, 40.0))


def margins(model: Model, text: pa.Array) -> np.ndarray:
    out, keep = np.zeros(len(text)), model.weight != 0
    for i, x in features(text, keep):
        out[i] = model.weight[x].sum(dtype=np.float64)
    return out


def score(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """(doc_id, severity, grade, toxic) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights, whatever the size of the input

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        z = margins(shared.value, batch.column(1))
        s = shared.value.severity(z)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array(shared.value.grades(z).astype(np.int32)), pa.array(s >= reject)], ["doc_id", "severity", "grade", "toxic"])

    return map_rows(docs, [F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(clean_text("text")).alias("text")], SCHEMA, run)


def drop_toxic(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """The rows whose expected severity is below `reject`, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def toxic(text: pa.Array) -> pa.Array:
        return pa.array(shared.value.severity(margins(shared.value, text)) >= reject)

    return docs.where(~toxic(F.lower(clean_text("text"))))
