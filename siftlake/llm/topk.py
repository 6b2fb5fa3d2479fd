"""Exact top-k search by inner product: the rows whose id is divisible by `every` are queries, against all rows.

Vectors are rotated by the right singular vectors of the whole table (from its d x d matrix of second moments, summed in Spark), so
the first coordinates carry most of the length. Items are cut into blocks in order of descending length, and runs of blocks; queries
likewise into groups. A task has one tile, a group of queries and a run: it holds the queries, and the run's blocks pass by, one at a
time. First all groups meet the run of the longest items; another tile is only made where some query's length times the
run's greatest length can reach that query's k-th best product so far, and there a block is passed over by the same
bound. In a block, the first coordinates' partial sums come first; an item stays only if its partial sum plus the product of the two residual
lengths (Cauchy-Schwarz) can reach the k-th best, and only what stays gets the full product.

Bounds are widened by what rounding to 32 bits can change in any sum of d products, (d + 8) / 2^23 of the product of lengths, twice what is
proven for the worst case, and products of what stays are in 64 bits, of the unrotated vectors; so results are exact for any d.

Results have k rows a query, fewer if there are fewer other vectors; a vector is no result of its own row. Products are
rounded to 6 digits; equal ones go to the least id. Null ids, null or empty vectors, vectors with null or non-finite entries and those whose
dimension is not the most common one (of equals the greatest) are neither queries nor items. Rows that repeat an id each
count as items; as queries they have one result together. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkit import map_rows, persist_shared

K = 10
BLOCK = 4096
#: Item blocks that one task goes over.
RUN = 32
#: What stands in a packed row: of a group of queries or of a block of items.
ASKED, ITEM = 0, 1
SCHEMA = "vec_id bigint, neighbour bigint, product double, rank int"


def _usable(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0))
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).select("d").collect()
    return rows.where(F.size("v") == (common[0].d if common else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def rotation(rows: DataFrame) -> np.ndarray:
    """Right singular vectors of all rows, the strongest first."""

    def moments(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = _matrix(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array([(x.T @ x).tobytes()], pa.binary())], ["m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for m in batch.column(0).to_pylist():
                total = np.frombuffer(m) if total is None else total + np.frombuffer(m)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    parts = map_rows(rows, [F.col("v")], "m binary", moments).mapInArrow(add, "m binary")  # one d x d matrix a partition
    parts = parts.repartition(16).mapInArrow(add, "m binary").collect()
    if not parts:
        return np.zeros((0, 0))
    total = sum(np.frombuffer(p.m) for p in parts)
    d = int(round(len(total) ** 0.5))
    values, axes = np.linalg.eigh(total.reshape(d, d))
    return axes[:, np.argsort(-values, kind="stable")]


class _Queries:
    """A group of queries and the k best that each has met; `floor` is the k-th best product, less its rounding."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, axes: np.ndarray, k: int) -> None:
        self.ids, self.q, self.floor, self.axes, self.k = ids, q, floor.copy(), axes, k
        self.head = max(1, q.shape[1] // 4)
        self.rq = (q @ axes).astype(np.float32)
        self.length, self.rest = np.sqrt((q * q).sum(1)), np.sqrt((self.rq[:, self.head :].astype(np.float64) ** 2).sum(1)).astype(np.float32)
        self.kept = [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]

    def meet(self, pid: np.ndarray, p: np.ndarray) -> None:
        k, head = self.k, self.head
        norms = np.sqrt((p * p).sum(1))
        slack = (p.shape[1] + 8) * 2.0**-23 * self.length * norms.max() + 2e-6
        live = np.flatnonzero(self.length * norms.max() + slack >= self.floor)
        if not len(live):
            return
        rp = (p @ self.axes).astype(np.float32)
        bound = self.rq[live, :head] @ rp[:, :head].T
        bound += self.rest[live, None] * np.sqrt((rp[:, head:].astype(np.float64) ** 2).sum(1)).astype(np.float32)
        may = bound + slack[live, None] >= self.floor[live, None]
        if may.mean() > 0.05:
            # most stay: their sums are finished in one product, and only near misses of the k-th best go on
            full = self.rq[live] @ rp.T
            if len(pid) > k + 1:  # a query may meet itself
                kth = np.partition(full, len(pid) - k - 1, axis=1)[:, len(pid) - k - 1]
                may &= full + 2 * slack[live, None] >= np.maximum(self.floor[live], kth)[:, None]
            else:
                may &= full + 2 * slack[live, None] >= self.floor[live, None]
        for a in np.flatnonzero(may.any(axis=1)):
            i = live[a]
            at = np.flatnonzero(may[a])
            at = at[pid[at] != self.ids[i]]
            if len(at):
                s = np.round((p[at] * self.q[i]).sum(1), 6)
                s, ids = np.concatenate([self.kept[i][0], s]), np.concatenate([self.kept[i][1], pid[at]])
                best = np.lexsort((ids, -s))[:k]
                self.kept[i] = s[best], ids[best]
                if len(best) == k:
                    self.floor[i] = max(self.floor[i], s[best[-1]] - 1e-6)

    def ratio(self) -> float:
        """Length that an item needs to be among the k best of any of the queries."""
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(self.length > 0, self.floor / self.length, np.where(self.floor > 0, np.inf, -np.inf))
        return float(need.min()) * (1 - 1e-5) - 1e-5 / float(max(self.length.max(), 1e-300)) if len(need) else np.inf


def _packed(rows: DataFrame, block: int) -> DataFrame:
    """(at, longest, ids, v): blocks in order of descending length, which `at` numbers in that order, with gaps."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 24
        for batch in batches:
            for a in range(0, batch.num_rows, block):
                part = batch.slice(a, block)
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([part.column(2)[0].as_py()]), pa.array([part.column(0).to_numpy().tobytes()], pa.binary()), pa.array([_matrix(part.column(1)).tobytes()], pa.binary())], ["at", "longest", "ids", "v"])
                at += 1

    parts = max(1, -(-rows.count() // block))
    ordered = rows.repartitionByRange(parts, F.desc("length"), "vec_id").sortWithinPartitions(F.desc("length"), "vec_id")
    return persist_shared(ordered.select("vec_id", "v", "length").mapInArrow(pack, "at bigint, longest double, ids binary, v binary"))


def search(vectors: DataFrame, k: int = K, every: int = 1, block: int = BLOCK, run: int = RUN) -> DataFrame:
    """(vec_id, neighbour, product, rank): the k other vectors with the greatest inner products, of each query."""
    rows = persist_shared(_usable(vectors).withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))))
    axes = rotation(rows)
    if not len(axes):
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    shared, dims = vectors.sparkSession.sparkContext.broadcast(axes), len(axes)  # d x d
    items = _packed(rows, block).withColumn("run", F.floor(F.shiftright("at", 24) / run))
    no_floor = F.lit(None).cast("binary").alias("floors")
    queries = _packed(rows.where(F.col("vec_id") % every == 0), block).select(F.col("at").alias("group"), "ids", "v")

    def vectors_of(v: bytes) -> np.ndarray:
        return np.frombuffer(v).reshape(-1, dims)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, group, asked = None, None, None

        def close() -> Iterator[pa.RecordBatch]:
            counts = np.array([len(s) for s, _ in asked.kept], np.int32)
            packed = [np.repeat(asked.ids, counts), np.concatenate([i for _, i in asked.kept]), np.concatenate([s for s, _ in asked.kept]), asked.floor]
            yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([asked.ratio()]), *(pa.array([x.tobytes()], pa.binary()) for x in packed)], ["group", "ratio", "vec_id", "neighbour", "product", "floors"])

        for batch in batches:
            for r in range(batch.num_rows):
                g, u, role, ids, v, floors = (batch.column(c)[r].as_py() for c in ("group", "run", "role", "ids", "v", "floors"))
                ids = np.frombuffer(ids, np.int64)
                if role == ASKED:
                    if asked is not None:
                        yield from close()
                    here, group = (g, u), g
                    asked = _Queries(ids, vectors_of(v), np.frombuffer(floors) if floors else np.full(len(ids), -np.inf), shared.value, k)
                elif here == (g, u):
                    asked.meet(ids, vectors_of(v))
        if asked is not None:
            yield from close()

    def tiles(asked: DataFrame, there: DataFrame) -> DataFrame:
        """Packed results of tiles, from groups (group, run, ids, v, floors) and the blocks of their runs."""
        names = ["group", "run", "role", "at", "ids", "v", "floors"]
        both = asked.withColumn("role", F.lit(ASKED)).withColumn("at", F.lit(-1).cast("bigint")).select(names)
        both = both.unionByName(there.join(asked.select("group", "run"), "run").withColumn("role", F.lit(ITEM)).withColumn("floors", no_floor).select(names))
        placed = both.repartition("group", "run").sortWithinPartitions("group", "run", "role", "at")
        return placed.mapInArrow(meet, "group bigint, ratio double, vec_id binary, neighbour binary, product binary, floors binary")

    # the run of the longest items, for all groups; and then what can still change their results
    first = persist_shared(tiles(queries.withColumn("run", F.lit(0).cast("bigint")).withColumn("floors", no_floor), items.where("run = 0")))
    runs = items.where("run > 0").groupBy("run").agg(F.max("longest").alias("longest"))
    reach = F.broadcast(runs)  # one small row for RUN blocks
    left = first.select("group", "ratio", "floors").join(reach, F.col("longest") >= F.col("ratio")).join(queries, "group").select("group", "run", "ids", "v", "floors")
    found = first.unionByName(tiles(left, items.where("run > 0")))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(batch.column(c)[r].as_py(), kind)) for c, kind in (("vec_id", np.int64), ("neighbour", np.int64), ("product", np.float64))], ["vec_id", "neighbour", "product"])

    rows = found.select("vec_id", "neighbour", "product").mapInArrow(unpack, "vec_id bigint, neighbour bigint, product double")
    best = Window.partitionBy("vec_id").orderBy(F.desc("product"), "neighbour")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("vec_id", "neighbour", "product", "rank")
