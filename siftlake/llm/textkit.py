"""Shared pieces of the text operators: table access, Arrow mapping, word hashing."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes that are handled at once; temporary arrays are a small multiple of this.
SLICE_BYTES = 1 << 19
#: Rows that are handled at once.
ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a folder of our own only where that is unset and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or os.path.join(os.getcwd(), "spark-warehouse", "checkpoints"))
    return spark.sparkContext.getCheckpointDir()


def persist_shared(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint: its files are in shared storage, so losing an executor loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows as Parquet in the shared folder, read again; the files go when the session ends."""
    spark = df.sparkSession
    at = f"{ensure_checkpoint_dir(spark)}/stage-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def clean_text(column: str) -> Column:
    """Null counts as empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(sizes: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows that together have at most `most` bytes, or one row that is larger."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def map_rows(df: DataFrame, columns: list[Column], schema: str, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> DataFrame:
    """fn over the given columns, at most ROWS rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield from fn(batch.slice(at, ROWS))
        pa.default_memory_pool().release_unused()  # workers outlive their tasks

    return df.select(*columns).mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without nulls, and the rows' offsets into them, without copying."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_M = np.uint64(0x9E3779B97F4A7C15)
_MI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        n = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            for name, base in (("up", _M), ("down", _MI)):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * _A
        x = (x ^ (x >> np.uint64(33))) * _B
        return x ^ (x >> np.uint64(33))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words: runs of ASCII letters, digits, underscores and non-ASCII characters."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _WORD[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal spans have equal hashes wherever they stand."""
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_slices(data: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Starts and ends of slices of one text that end between words; only a longer word makes one longer than `most`."""
    at = 0
    while at < len(data):
        to = min(at + most, len(data))
        while to < len(data) and _WORD[data[to - 1]] and _WORD[data[to]]:
            to += 1
        yield at, to
        at = to


def words_of(data: np.ndarray, most: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of one text of any length."""
    parts = []
    for at, to in word_slices(data, most) if len(data) else [(0, 0)]:
        starts, ends = word_spans(data[at:to])
        parts.append((hash_spans(data[at:to], starts, ends), starts + at, ends + at))
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of words; a text of fewer words has one gram, of all its words; a text without words has none."""
    n = min(n, len(words))
    if not n:
        return words
    with np.errstate(over="ignore"):
        h = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            h = mix(h * _M + words[k : len(words) - n + 1 + k])
        return h + np.uint64(n)


def batch_words(text: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its words) for each row of a string column without nulls."""
    data, offsets = text_bytes(text)
    for a, b in slices(np.diff(offsets), most):
        part = data[offsets[a] : offsets[b]]
        if b - a == 1:
            yield a, words_of(part)[0]
            continue
        # a row's first word never joins the last one of the row before: the rows are laid out with a space between them
        gap = np.zeros(len(part) + b - a, np.uint8)
        where = np.arange(len(part)) + np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))
        gap[where] = part
        starts, ends = word_spans(gap)
        hashes = hash_spans(gap, starts, ends)
        cuts = np.searchsorted(starts, offsets[a : b + 1] - offsets[a] + np.arange(b - a + 1))
        for i in range(b - a):
            yield a + i, hashes[cuts[i] : cuts[i + 1]]
