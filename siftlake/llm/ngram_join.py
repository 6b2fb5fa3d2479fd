"""N-gram Jaccard join: which documents have sets of word n-grams whose Jaccard index is at least a threshold.

The method is a token-group matrix over whole sets; nothing is sampled.

1. Documents with equal sets are one set, known by a 64-bit fingerprint.
2. How many of its n-grams other sets have bounds what a set can have in common with any of them; a set that can't reach the
   threshold so has no partner, and goes. Tasks count within what they hold and send each distinct n-gram once, as its hash's bucket and
   32 more bits: n-grams that are taken for equal wrongly only make the bound wider.
3. The sets that stay are moved once, with whole 64-bit hashes; n-grams that only one of them has are left out (sizes still count
   them), and the others are ordered by how many sets have them, the rarest first.
4. Sets are partitioned into groups of similar ones, by the smallest hashes that they have in common, of `GROUP` sets or
   `GROUP_GRAMS` n-grams at most; larger ones are split by hash. A group's row of the matrix is the union of its members' n-grams.
5. A query meets its own group and those that have one of its first n-grams: two sets that reach the threshold share one among
   each one's first s - ceil(threshold * m) + 1, of s that others have and m in all. It opens a group only if its overlap with
   the union reaches ceil(threshold * m), and there it is compared with all members, exactly.

A family of near copies is in one group or few, so its sets are moved few times, and its pairs are counted where they are found:
a group gives sums and a spanning forest, never a row for each pair.

Texts are taken in lower case; a word is a run of letters, digits, underscores and non-ASCII characters; a text of fewer than n words has one
n-gram. A document is a distinct (doc_id, set): rows that repeat an id with another set are documents of their own, with the same set none.
Null, empty and wordless texts have no partners; rows with null ids are in no result, but `keep_one` keeps them, once for each text.
Very long texts are one set, of 8 bytes an n-gram, in one task's memory. An empty table gives no rows. Ties: a class is named by its least id.
Extra columns are ignored or, in `keep_one`, kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textkit import ROWS, batch_words, clean_text, gram_hashes, map_rows, mix, persist_shared

N = 3
THRESHOLD = 0.5
GROUP = 1024
GROUP_GRAMS = 1 << 20
#: N-grams that a task holds before it sends them on, and about what a bucket has of them.
FLUSH = 1 << 21
#: Smallest hashes of a set by which groups are found.
LOW = 4
#: What is sent to all tasks at most; beyond that, a join.
BROADCAST_BYTES = 8 << 20
CLASSES = "doc_id bigint, class_id bigint, links bigint"
PAIRS = "doc_a bigint, doc_b bigint, jaccard double"


def gram_set(words: np.ndarray, n: int) -> np.ndarray:
    g = np.sort(gram_hashes(words, n).view(np.int64))
    return g[np.concatenate([[True], g[1:] != g[:-1]])] if len(g) > 1 else g


def fingerprint(grams: np.ndarray) -> int:
    """64 bits of a set of hashes."""
    u = grams.view(np.uint64)
    with np.errstate(over="ignore"):
        both = np.array([u.sum(dtype=np.uint64) * np.uint64(len(u)), mix(u ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)])
        return int(mix(mix(both[:1]) + both[1:]).view(np.int64)[0])


def _least(threshold: float, m: Column | np.ndarray) -> Column | np.ndarray:
    """N-grams that a set of m shares with a partner at least."""
    return F.ceil(m * threshold - 1e-9) if isinstance(m, Column) else np.ceil(m * threshold - 1e-9).astype(np.int64)


def _few(df: DataFrame, rows: float, row_bytes: int) -> DataFrame:
    """Marked for a broadcast if so many rows have at most BROADCAST_BYTES. Without it, each side of a join has an exchange, and the driver a thread for each exchange."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def _small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Marked for a broadcast if its rows, counted, have at most BROADCAST_BYTES."""
    return _few(df, df.count(), row_bytes)


def _lower(column: str) -> Column:
    return F.lower(clean_text(column)).alias("text")


def marks(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, text_id, sid, m) of each row with an id: a hash of the text, the fingerprint of its set (null without words) and its size."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sids, ms = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int32)
        for i, words in batch_words(batch.column(2)):
            g = gram_set(words, n)
            if len(g):
                sids[i], ms[i] = fingerprint(g), len(g)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sids, mask=ms == 0), pa.array(ms)], ["doc_id", "text_id", "sid", "m"])

    columns = [F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_id"), _lower("text")]
    return map_rows(docs.where(F.col("doc_id").cast("bigint").isNotNull()), columns, "doc_id bigint, text_id bigint, sid bigint, m int", run)


def _bits(total: int) -> int:
    """Buckets, as a power of two, for so many n-grams."""
    return min(20, max(1, math.ceil(math.log2(max(1, total / FLUSH)))))


def _by_key(rows: DataFrame, key: str, fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """fn of all rows of each key, one key at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts = None, []
        for batch in batches:
            keys = batch.column(key).to_numpy()
            edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for a, b in zip([0, *edges], [*edges, len(keys)]):
                if b > a:
                    if parts and keys[a] != here:
                        yield from fn(pa.Table.from_batches(parts))
                        parts = []
                    here = keys[a]
                    parts.append(batch.slice(a, b - a))
        if parts:
            yield from fn(pa.Table.from_batches(parts))

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def _numbers(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """Numbers of a column of binaries, one after the other."""
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(b, kind) for c in column.chunks for b in c.to_pylist() if b)])


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return starts, np.diff(np.concatenate([starts, [len(x)]]))


def _held(batches: Iterator[pa.RecordBatch], n: int, most: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(fingerprints, sets) of a column of texts, FLUSH n-grams or `most` sets at a time, without those just seen."""
    sids, held, size, seen = [], [], 0, set()
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            for _, words in batch_words(batch.slice(at, ROWS).column(0)):
                g = gram_set(words, n)
                if not len(g) or (sid := fingerprint(g)) in seen:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(sid)
                sids.append(sid)
                held.append(g)
                size += len(g)
                if size >= FLUSH or len(sids) >= most:
                    yield np.array(sids, np.int64), held
                    sids, held, size = [], [], 0
    if sids:
        yield np.array(sids, np.int64), held


_OTHERS = np.uint64(0xFFFFFFFF)


def sharing(docs: DataFrame, n: int, total: int) -> DataFrame:
    """(sid, shared): a bound on how many of a set's n-grams other sets have, `total` being about how many n-grams there are."""
    bits = _bits(total)
    low = np.uint64((1 << (32 - bits)) - 1)  # room for a set's number
    names = ["bucket", "sids", "counts", "grams", "common", "credits"]

    def row(bucket: int, *parts: np.ndarray) -> list:
        return [bucket, *(p.tobytes() for p in parts)]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint32)
        for at, (sids, held) in enumerate(_held(batches, n, 1 << (32 - bits))):
            owner = np.repeat(np.arange(len(sids), dtype=np.uint64), [len(g) for g in held])
            key = (np.concatenate(held).view(np.uint64) & ~low) | owner
            key.sort()
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
            starts, counts = _runs(key >> np.uint64(32 - bits))
            several = np.repeat(counts > 1, counts)
            credit = np.bincount((key[several] & low).astype(np.int64), minlength=len(sids))
            common = key[starts[counts > 1]] >> np.uint64(32 - bits)
            single = key[~several]
            token = single >> np.uint64(32 - bits)
            single = ((token >> np.uint64(32)) << np.uint64(64 - bits)) | ((single & low) << np.uint64(32)) | (token & _OTHERS)
            single.sort()
            rows = [row(at % (1 << bits), sids[credit > 0], none, none, none, credit[credit > 0].astype(np.int32))]
            edges = np.arange(1, 1 << bits, dtype=np.uint64)
            cut, shared = np.searchsorted(single, edges << np.uint64(64 - bits)), np.searchsorted(common, edges << np.uint64(32))
            for b, (s, c) in enumerate(zip(np.split(single, cut) if bits < 12 else _split(single, cut), np.split(common, shared) if bits < 12 else _split(common, shared))):
                if len(s) or len(c):
                    own = ((s >> np.uint64(32)) & low).astype(np.int64)
                    first, count = _runs(own)
                    rows.append(row(b, sids[own[first]], count.astype(np.int32), s.astype(np.uint32), c.astype(np.uint32), none))
            for a in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(zip(*rows[a : a + 4096]))], names)

    def count(bucket: pa.Table) -> Iterator[pa.RecordBatch]:
        counts, grams, common, credits = (_numbers(bucket.column(c), k) for c, k in (("counts", np.int32), ("grams", np.uint32), ("common", np.uint32), ("credits", np.int32)))
        # rows with credits have sids of their own
        ready = pa.compute.greater(pa.compute.binary_length(bucket.column("credits")), 0)
        sids, known = _numbers(bucket.filter(pa.compute.invert(ready)).column("sids"), np.int64), _numbers(bucket.filter(ready).column("sids"), np.int64)
        names, own = np.unique(sids, return_inverse=True)
        key = np.concatenate([(grams.astype(np.uint64) << np.uint64(32)) | np.repeat(own, counts).astype(np.uint64), (common.astype(np.uint64) << np.uint64(32)) | _OTHERS])
        key.sort()
        if len(key):
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        _, size = _runs(key >> np.uint64(32))
        owner = key[np.repeat(size > 1, size)] & _OTHERS
        credit = np.bincount(owner[owner != _OTHERS].astype(np.int64), minlength=len(names))
        there = credit > 0
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([names[there], known])), pa.array(np.concatenate([credit[there], credits]).astype(np.int64))], ["sid", "shared"])

    rows = docs.where(F.col("doc_id").cast("bigint").isNotNull()).select(_lower("text")).mapInArrow(spread, "bucket int, sids binary, counts binary, grams binary, common binary, credits binary")
    return _by_key(rows, "bucket", count, "sid bigint, shared bigint").groupBy("sid").agg(F.sum("shared").alias("shared"))


def _split(x: np.ndarray, cuts: np.ndarray) -> Iterator[np.ndarray]:
    edges = [0, *cuts.tolist(), len(x)]
    return (x[a:b] for a, b in zip(edges, edges[1:]))


def _packed(key: np.ndarray, sids: np.ndarray, rest: list[np.ndarray], name: str, names: list[str], per_sid: int) -> Iterator[pa.RecordBatch]:
    """A row for each key: its sids, how many entries each has, and the entries; the first `per_sid` of `rest` are kept once for a sid. Entries are ordered by key and sid."""
    starts, counts = _runs(key)
    rows = []
    for a, c in zip(starts.tolist(), counts.tolist()):
        first, size = _runs(sids[a : a + c])
        rows.append([int(key[a]), sids[a : a + c][first].tobytes(), size.astype(np.int32).tobytes(), *((x[a : a + c][first] if k < per_sid else x[a : a + c]).tobytes() for k, x in enumerate(rest))])
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(zip(*rows))], [name, "sids", "counts", *names])


def _bucket(x: np.ndarray, bits: int) -> np.ndarray:
    return (x.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int32)


def shared_sets(docs: DataFrame, wanted: DataFrame, n: int, threshold: float, total: int) -> DataFrame:
    """(sid, m, grams, low) of the wanted (doc_id, sid) that can reach the threshold among themselves.

    grams: 64-bit hashes that others of them have too, the rarest first, of equals the least; low: the least ones.
    """
    bits = _bits(total)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(wanted, "doc_id").select(_lower("text"), "sid")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def asked() -> Iterator[tuple[int, np.ndarray]]:
            seen: set[int] = set()
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    sids = part.column(1).to_numpy()
                    for i, words in batch_words(part.column(0)):
                        g = gram_set(words, n)
                        # a row that repeats an id with another text is not what is asked for
                        if len(g) and (sid := fingerprint(g)) == sids[i] and sid not in seen:
                            if len(seen) >= 200_000:
                                seen.clear()
                            seen.add(sid)
                            yield sid, g

        def send(held: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            sids, m = np.array([s for s, _ in held], np.int64), np.array([len(g) for _, g in held], np.int32)
            grams, own = np.concatenate([g for _, g in held]), np.repeat(np.arange(len(held)), m)
            bucket = _bucket(grams, bits)
            order = np.argsort(bucket, kind="stable")
            own = own[order]
            yield from _packed(bucket[order], sids[own], [m[own], grams[order]], "bucket", ["m", "grams"], 1)

        held, size = [], 0
        for x in asked():
            held.append(x)
            size += len(x[1])
            if size >= FLUSH // 2:
                yield from send(held)
                held, size = [], 0
        if held:
            yield from send(held)

    def entries(table: pa.Table, *more: tuple[str, type]) -> tuple[np.ndarray, ...]:
        counts, sids, m = (_numbers(table.column(c), k) for c, k in (("counts", np.int32), ("sids", np.int64), ("m", np.int32)))
        return np.repeat(sids, counts), np.repeat(m, counts), *(_numbers(table.column(c), k) for c, k in more)

    def frequent(table: pa.Table) -> Iterator[pa.RecordBatch]:
        sids, m, grams = entries(table, ("grams", np.int64))
        order = np.lexsort((sids, grams))
        sids, m, grams = sids[order], m[order], grams[order]
        new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (sids[1:] != sids[:-1])])  # a set that more than one row has counts once
        sids, m, grams = sids[new], m[new], grams[new]
        _, size = _runs(grams)
        df = np.repeat(size, size).astype(np.int32)
        sids, m, grams, df = (x[df > 1] for x in (sids, m, grams, df))
        part = _bucket(sids, bits)
        order = np.lexsort((sids, part))
        yield from _packed(part[order], sids[order], [m[order], grams[order], df[order]], "part", ["m", "grams", "df"], 1)

    def gather(table: pa.Table) -> Iterator[pa.RecordBatch]:
        sids, m, grams, df = entries(table, ("grams", np.int64), ("df", np.int32))
        order = np.lexsort((grams, df, sids))
        sids, m, grams = sids[order], m[order], grams[order]
        starts, size = _runs(sids)
        stay = np.flatnonzero(size >= _least(threshold, m[starts]))
        for a in range(0, len(stay), 500):
            own = [grams[starts[i] : starts[i] + size[i]] for i in stay[a : a + 500]]
            at = starts[stay[a : a + 500]]
            yield pa.RecordBatch.from_arrays([pa.array(sids[at]), pa.array(m[at]), pa.array([g.tobytes() for g in own], pa.binary()), pa.array([np.sort(g)[:LOW].tolist() for g in own], pa.list_(pa.int64()))], ["sid", "m", "grams", "low"])

    rows = _by_key(texts.mapInArrow(spread, "bucket int, sids binary, counts binary, m binary, grams binary"), "bucket", frequent, "part int, sids binary, counts binary, m binary, grams binary, df binary")
    return _by_key(rows, "part", gather, "sid bigint, m int, grams binary, low array<bigint>")


def groups(sets: DataFrame, count: int, total: int) -> DataFrame:
    """(sid, m, gid): sets whose least hashes meet, directly or over others, are together, in pieces of bounded size; of so many sets and n-grams at most."""
    size = F.octet_length("grams") / 8
    rows = sets.select("sid", "m", size.alias("size"), F.element_at("low", 1).alias("home"), F.element_at("low", 1).alias("label"), F.explode("low").alias("token"))
    least = lambda by: F.min("label").over(Window.partitionBy(by))
    rows = rows.withColumn("label", least("token")).withColumn("label", least("sid")).withColumn("label", least("token"))
    parts = persist_shared(rows.groupBy("sid").agg(*(F.min(c).alias(c) for c in ("m", "size", "home", "label"))))
    for by in ("home", "sid"):  # what is too large is split by the least hash, and what still is by chance
        pieces = parts.groupBy("label").agg(F.ceil(F.greatest(F.count("*") / GROUP, F.sum("size") / GROUP_GRAMS)).alias("pieces")).where("pieces > 1")
        parts = parts.join(_few(pieces, count / GROUP + total / GROUP_GRAMS, 24), "label", "left").withColumn("label", F.when(F.col("pieces") > 1, F.xxhash64("label", F.pmod(F.xxhash64(by), "pieces"))).otherwise(F.col("label"))).drop("pieces")
    return parts.select("sid", "m", F.col("label").alias("gid"))


def meetings(sets: DataFrame, places: DataFrame, threshold: float, count: int, total: int) -> DataFrame:
    """(sid, gid): the other groups that have one of a set's first n-grams, from sets (sid, gid, m, grams) and as many places (sid, gid, m), if they have lesser sids of fitting size."""
    bits = _bits(total)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, offsets = _flat(batch.column("grams"))
            size = np.diff(offsets)
            first = size - _least(threshold, batch.column("m").to_numpy()) + 1
            take = np.arange(offsets[-1]) - np.repeat(offsets[:-1], size) < np.repeat(first, size)
            own, grams = np.repeat(np.arange(len(size)), size)[take], grams[take]
            bucket = _bucket(grams, bits)
            order = np.argsort(bucket, kind="stable")
            own, sids, gids = own[order], batch.column("sid").to_numpy(), batch.column("gid").to_numpy()
            yield from _packed(bucket[order], sids[own], [gids[own], grams[order]], "bucket", ["gids", "grams"], 1)

    def across(table: pa.Table) -> Iterator[pa.RecordBatch]:
        counts, sids, gids, grams = (_numbers(table.column(c), k) for c, k in (("counts", np.int32), ("sids", np.int64), ("gids", np.int64), ("grams", np.int64)))
        sids, gids = np.repeat(sids, counts), np.repeat(gids, counts)
        order = np.lexsort((gids, grams))
        sids, gids, grams = sids[order], gids[order], grams[order]
        starts, size = _runs(grams)
        several = np.repeat(gids[starts] != gids[starts + size - 1], size) if len(grams) else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays([pa.array(x[several]) for x in (grams, sids, gids)], ["token", "sid", "gid"])

    rows = _by_key(sets.select("sid", "gid", "m", "grams").mapInArrow(spread, "bucket int, sids binary, counts binary, gids binary, grams binary"), "bucket", across, "token bigint, sid bigint, gid bigint")
    rows = persist_shared(rows)
    spans = places.groupBy("gid").agg(F.min("sid").alias("least"), F.min("m").alias("m_low"), F.max("m").alias("m_high"))
    others = rows.select("token", "gid").distinct().join(_few(spans, count, 32), "gid")
    asking = rows.withColumnRenamed("gid", "own").join(_few(places.select("sid", "m"), count, 24), "sid")
    fits = (F.col("gid") != F.col("own")) & (F.col("least") < F.col("sid")) & (F.col("m_high") >= F.col("m") * threshold) & (F.col("m_low") * threshold <= F.col("m"))
    return asking.join(others, "token").where(fits).select("sid", "gid").distinct()


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of 64-bit integers as bytes."""
    offsets = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
    data = lists.buffers()[2]
    return (np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].copy().view(np.int64) if data is not None else np.zeros(0, np.int64)), (offsets - offsets[0]) // 8


class _Members:
    """Members of an opened group, by n-gram."""

    def __init__(self, rows: pa.Table) -> None:
        self.rows = rows
        flat, offsets = _flat(rows.column("grams").combine_chunks())
        self.n = rows.num_rows
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(self.n), np.diff(offsets))[order]
        self.tokens, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)

    def bound(self, lists: pa.Array) -> np.ndarray:
        """N-grams of each query that any member has."""
        flat, offsets = _flat(lists)
        hit = self.tokens[np.minimum(np.searchsorted(self.tokens, flat), len(self.tokens) - 1)] == flat
        return np.diff(np.concatenate([[0], np.cumsum(hit)])[offsets])

    def overlaps(self, lists: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(first query, overlaps of queries and members), some queries at a time."""
        flat, offsets = _flat(lists)
        at = np.minimum(np.searchsorted(self.tokens, flat), len(self.tokens) - 1)
        hit = self.tokens[at] == flat
        n = np.where(hit, self.count[at], 0)
        ends = np.concatenate([[0], np.cumsum(n)])
        a = 0
        while a < len(lists):
            b = a + 1
            while b < len(lists) and ends[offsets[b + 1]] - ends[offsets[a]] <= 1 << 20 and (b - a) * self.n < 1 << 20:
                b += 1
            k = slice(offsets[a], offsets[b])
            total = ends[offsets[b]] - ends[offsets[a]]
            where = np.arange(total) + np.repeat(self.first[at[k]] - (ends[offsets[a] : offsets[b]] - ends[offsets[a]]), n[k])
            query = np.repeat(np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1])), n[k])
            yield a, np.bincount(query * self.n + self.owner[where], minlength=(b - a) * self.n).reshape(b - a, self.n)
            a = b


#: What a row is in a group.
MEMBER, ASKER = 1, 2
Found = Callable[[_Members, pa.Table, np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]


def _opened(rows: DataFrame, threshold: float, found: Found, schema: str) -> DataFrame:
    """found(members, queries, query, member, index) for the pairs that reach the threshold, of rows (gid, role, sid, m, copies, grams).

    Groups follow one another in a partition, members first, so a task holds one group's members and a batch of queries. Members ask too.
    Of two sets the one with the greater sid asks.
    """
    rows = rows.repartition("gid").sortWithinPartitions("gid", "role")

    def ask(group: _Members, queries: pa.Table) -> Iterator[pa.RecordBatch]:
        m, sid = group.rows.column("m").to_numpy().astype(np.int64), group.rows.column("sid").to_numpy()
        lists = queries.column("grams").combine_chunks()
        queries = queries.take(pa.array(np.flatnonzero(group.bound(lists) >= _least(threshold, queries.column("m").to_numpy()))))
        qm, query = queries.column("m").to_numpy().astype(np.int64), queries.column("sid").to_numpy()
        lists = queries.column("grams").combine_chunks()
        for a, both in group.overlaps(lists) if len(query) else ():
            k = slice(a, a + len(both))
            j = both / (m + qm[k, None] - both)
            q, i = np.nonzero((j >= threshold) & (sid < query[k, None]))
            if len(q):
                yield from found(group, queries, a + q, i, j[q, i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts, group = None, [], None

        def close() -> Iterator[pa.RecordBatch]:
            """All members are there."""
            nonlocal parts, group
            if parts:
                group, parts = _Members(pa.concat_tables(parts)), []
                if group.n > 1:
                    yield from ask(group, group.rows)

        for batch in batches:
            gid, late = batch.column("gid").to_numpy(), batch.column("role").to_numpy() == ASKER
            edges = np.flatnonzero((gid[1:] != gid[:-1]) | (late[1:] != late[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, len(gid)]):
                if a == b:
                    continue
                if gid[a] != here:
                    yield from close()
                    here, group = gid[a], None
                part = pa.Table.from_batches([batch.slice(a, b - a)])
                if not late[a]:
                    parts.append(part)
                else:
                    yield from close()
                    yield from ask(group, part)
        yield from close()

    return rows.mapInArrow(run, schema)


def _pair_rows(group: _Members, queries: pa.Table, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array(group.rows.column("sid").to_numpy()[i]), pa.array(queries.column("sid").to_numpy()[q]), pa.array(j)], ["a", "b", "jaccard"])


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least that each number below n hangs together with over edges (a, b)."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while ((up := root[root]) != root).any():
            root = up


def _sums(group: _Members, queries: pa.Table, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(sid, links, root) of each set in pairs: partners' documents, and the least set that it hangs together with here."""
    sids = np.concatenate([group.rows.column("sid").to_numpy()[i], queries.column("sid").to_numpy()[q]])
    weight = np.concatenate([queries.column("copies").to_numpy()[q], group.rows.column("copies").to_numpy()[i]])
    names, at = np.unique(sids, return_inverse=True)
    a, b = at[: len(i)], at[len(i) :]
    root = _roots(a, b, len(names))
    links = np.zeros(len(names), np.int64)
    np.add.at(links, at, weight)
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(links), pa.array(names[root])], ["sid", "links", "root"])


def _grouped(docs: DataFrame, marked: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame | None, int]:
    """Sets (sid, m, rep, copies), and rows for `_opened`, or none if no set can have a partner; how many sets can at most."""
    known = marked.where("sid is not null").select("sid", "m", "doc_id").distinct()
    info = persist_shared(known.groupBy("sid").agg(F.max("m").alias("m"), F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    total = info.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    likely = persist_shared(info.join(sharing(docs, n, total), "sid").where(F.col("shared") >= _least(threshold, F.col("m"))).select("sid", "rep", "m", "copies"))
    total, count = likely.agg(F.coalesce(F.sum("m"), F.lit(0)), F.count("*")).first()
    if not total:
        return info, None, 0
    sets = persist_shared(shared_sets(docs, _few(likely.select(F.col("rep").alias("doc_id"), "sid"), count, 24), n, threshold, total))
    places = persist_shared(groups(sets, count, total).join(_few(likely.select("sid", "copies"), count, 24), "sid"))
    sets = sets.drop("low", "m").join(_few(places, count, 40), "sid")
    met = meetings(sets, places, threshold, count, total)
    columns = ["gid", "role", "sid", "m", "copies", "grams"]
    members = sets.withColumn("role", F.lit(MEMBER)).select(columns)
    return info, members.unionByName(sets.drop("gid").join(met, "sid").withColumn("role", F.lit(ASKER)).select(columns)), count


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, root) of all edges (u, v) together."""
    ends = [np.zeros((2, 0), np.int64), *(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches)]
    ids, at = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    root = _roots(a, b, len(ids))
    under = root != np.arange(len(ids))
    yield pa.RecordBatch.from_arrays([pa.array(ids[under]), pa.array(ids[root[under]])], ["id", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least id that can be reached over edges (a, b), for ids that have a lesser one.

    Edges of at most BROADCAST_BYTES go to one task; of more, large-star and small-star steps until nothing changes.
    """
    e = persist_shared(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if e.count() * 16 <= BROADCAST_BYTES:
        return e.coalesce(1).mapInArrow(_rooted, "id bigint, root bigint")
    before = None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low"))
        # large star: neighbours above u go to the least of u's neighbourhood
        down = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct().where("u <> v")
        # small star: neighbours below u, and u, go to the least of them
        low = down.groupBy("u").agg(F.min("v").alias("low"))
        e = persist_shared(down.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.select("u", F.col("low").alias("v"))).where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38)"))).first()
        if now == before:
            return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = now


def _set_classes(docs: DataFrame, marked: DataFrame, n: int, threshold: float) -> DataFrame:
    """(sid, class_id, links) of each set: the least document of its class, and other documents with this set or a partner."""
    info, rows, count = _grouped(docs, marked, n, threshold)
    if rows is None:
        return info.select("sid", F.col("rep").alias("class_id"), (F.col("copies") - 1).alias("links"))
    sums = persist_shared(_opened(rows, threshold, _sums, "sid bigint, links bigint, root bigint"))
    roots = components(sums.select(F.col("sid").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"id": "sid"})
    near = persist_shared(sums.groupBy("sid").agg(F.sum("links").alias("near")).join(_few(roots, count, 24), "sid", "left").withColumn("root", F.coalesce("root", "sid")))
    least = info.join(_few(near, count, 32), "sid").groupBy("root").agg(F.min("rep").alias("class_id"))
    near = persist_shared(near.join(_few(least, count, 24), "root").select("sid", "near", "class_id"))
    return info.join(_few(near, count, 32), "sid", "left").select("sid", F.coalesce("class_id", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links"))


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links) of each document.

    links: other documents whose index with it is at least the threshold, copies among them. class_id: the least id that can
    be reached over links, the document's own if it has none.
    """
    marked = persist_shared(marks(docs, n))
    found = _set_classes(docs, marked, n, threshold)
    return marked.select("doc_id", "sid").distinct().join(found, "sid", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def similar(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_a, doc_b, jaccard), doc_a < doc_b.

    A document whose set another one has too is in one row, with the least id that has the set, and jaccard 1. The least ids of
    two distinct sets are in a row if their index is at least the threshold; so other pairs follow from these. Where an id has several
    sets, the greatest index counts.
    """
    marked = persist_shared(marks(docs, n))
    info, rows, _ = _grouped(docs, marked, n, threshold)
    copies = marked.join(info.where("copies > 1").select("sid", "rep"), "sid").where("rep < doc_id").select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    if rows is not None:
        named = info.select("sid", "rep")
        pairs = _opened(rows, threshold, _pair_rows, "a bigint, b bigint, jaccard double")
        pairs = pairs.join(named.toDF("a", "rep_a"), "a").join(named.toDF("b", "rep_b"), "b").where("rep_a <> rep_b")
        copies = copies.unionByName(pairs.select(F.least("rep_a", "rep_b").alias("doc_a"), F.greatest("rep_a", "rep_b").alias("doc_b"), "jaccard"))
    return copies.groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of one document of each class, that of the least id, with all their columns.

    Each (doc_id, text) is kept or dropped by itself. Rows that repeat both, or that lack an id and repeat a text, stay once.
    """
    marked = persist_shared(marks(docs, n))
    once, names = "".join(docs.columns) + "_", docs.columns  # no column has this name
    texts = marked.groupBy("doc_id", "text_id").agg(F.count("*").alias("rows"), F.min("sid").alias("sid"))
    named = persist_shared(texts.join(_set_classes(docs, marked, n, threshold), "sid", "left").withColumn("class_id", F.when(F.col("sid").isNotNull(), F.col("class_id"))))
    # of the rows with the class's least id, the least text: an id may have more than one text in a class
    first = named.where("class_id = doc_id").groupBy("class_id").agg(F.min("text_id").alias("first"))
    sorted_out = named.join(first, "class_id", "left").withColumn("gone", F.col("sid").isNotNull() & ~F.coalesce((F.col("doc_id") == F.col("class_id")) & (F.col("text_id") == F.col("first")), F.lit(False)))
    # what is to be done with some rows: drop all, or all but one
    todo = persist_shared(sorted_out.where("gone or rows > 1").select(F.col("doc_id").alias(f"{once}id"), F.col("text_id").alias(f"{once}text"), F.col("gone").alias(f"{once}gone")))
    todo = _small(todo, 32)
    whole = docs.withColumn(f"{once}hash", F.xxhash64("text")).withColumn(f"{once}key", F.col("doc_id").cast("bigint"))
    rows = whole.join(todo, (F.col(f"{once}key") == F.col(f"{once}id")) & (F.col(f"{once}hash") == F.col(f"{once}text")), "left")
    several = F.coalesce(~F.col(f"{once}gone"), F.col(f"{once}key").isNull())
    plain = rows.where(F.col(f"{once}gone").isNull() & F.col(f"{once}key").isNotNull())
    repeated = rows.where(several).dropDuplicates([f"{once}key", f"{once}hash"])
    return plain.unionByName(repeated).select(*(f"`{c}`" for c in names))
