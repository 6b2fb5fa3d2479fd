"""The store as relations: an operation log is folded into references and objects, and reads are queries over these.

Log: (seq, ts, key, value), value null for a delete. A put that repeats a key's value changes nothing. With garbage
collection an object dies when its last reference goes; a later put of the value is a new incarnation, whose first put
gives bytes and times.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DedupConfig
from ..errors import NotFound
from ..functions import text as T


def changes(log: DataFrame) -> DataFrame:
    """The log with each row's previous value of its key."""
    return log.withColumn("previous", F.lag("value").over(Window.partitionBy("key").orderBy("seq")))


def noop_overwrites(log: DataFrame) -> DataFrame:
    return changes(log).where("value = previous").drop("previous")


def deltas(log: DataFrame) -> DataFrame:
    """(seq, ts, value, delta): references gained and lost; a row that does both gains first."""
    c = changes(log).where(~F.col("value").eqNullSafe(F.col("previous")))
    gain = F.when(F.col("value").isNotNull(), F.struct(F.col("value").alias("value"), F.lit(1).alias("delta")))
    loss = F.when(F.col("previous").isNotNull(), F.struct(F.col("previous").alias("value"), F.lit(-1).alias("delta")))
    return c.select("seq", "ts", F.explode(F.filter(F.array(gain, loss), lambda x: x.isNotNull())).alias("d")).select("seq", "ts", "d.value", "d.delta")


def incarnations(log: DataFrame, enable_gc: bool = True) -> DataFrame:
    """(value, incarnation, created_seq, created_at, references, died_seq) of each object that ever was."""
    w = Window.partitionBy("value").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    counted = deltas(log).withColumn("rc", F.sum("delta").over(w))
    born = (F.col("delta") == 1) & (F.col("rc") == 1) if enable_gc else (F.col("delta") == 1) & (F.sum(F.when(F.col("delta") == 1, 1)).over(w) == 1)
    lives = counted.withColumn("incarnation", F.sum(F.when(born, 1).otherwise(0)).over(w))
    return lives.groupBy("value", "incarnation").agg(
        F.min("seq").alias("created_seq"), F.min_by("ts", "seq").alias("created_at"), F.sum("delta").alias("references"),
        F.max(F.when((F.col("delta") == -1) & (F.col("rc") == 0), F.col("seq")) if enable_gc else F.lit(None).cast("bigint")).alias("died_seq"),
    )


def references(log: DataFrame) -> DataFrame:
    """(key, value, seq) of keys that are set at the end."""
    last = log.groupBy("key").agg(F.max_by(F.struct("value", "seq"), "seq").alias("x"))
    return last.select("key", "x.value", "x.seq").where("value is not null")


def objects(log: DataFrame, enable_gc: bool = True) -> DataFrame:
    """(object_id, value, size_bytes, refcount, created_at, last_accessed); without collection, unreferenced ones stay."""
    live = incarnations(log, enable_gc).withColumn("last", F.max("incarnation").over(Window.partitionBy("value"))).where("incarnation = last")
    live = live.where("references > 0") if enable_gc else live
    return live.select(T.object_id(F.col("value")).alias("object_id"), "value", F.octet_length("value").cast("bigint").alias("size_bytes"), F.col("references").alias("refcount"), "created_at", F.col("created_at").alias("last_accessed"))


def age(now: Column, then: Column) -> Column:
    """Seconds between two timestamps, with or without a time zone."""
    return now.cast("timestamp").cast("double") - then.cast("timestamp").cast("double")


def expired(now: Column, ttl_seconds: int) -> Column:
    """Whether an object is past its time to live, which counts from its creation; 0 is for ever."""
    return age(now, F.col("created_at")) > ttl_seconds if ttl_seconds else F.lit(False)


def get(refs: DataFrame, objs: DataFrame, keys: DataFrame, now: Column, ttl_seconds: int = 0, default: str | None = None) -> DataFrame:
    """(key, value) for each asked key: the live value, or the default."""
    live = objs.where(~expired(now, ttl_seconds)).select("object_id", "value")
    found = refs.select("key", T.object_id(F.col("value")).alias("object_id")).join(live, "object_id").select("key", "value")
    return keys.join(found, "key", "left").select("key", F.coalesce("value", F.lit(default)).alias("value"))


def contains(refs: DataFrame, objs: DataFrame, keys: DataFrame, now: Column, ttl_seconds: int = 0) -> DataFrame:
    live = refs.select("key", T.object_id(F.col("value")).alias("object_id")).join(objs.where(~expired(now, ttl_seconds)), "object_id", "left_semi").select("key").withColumn("there", F.lit(True))
    return keys.join(live, "key", "left").select("key", F.coalesce("there", F.lit(False)).alias("present"))


def list_keys(keys: DataFrame, prefix: str = "", limit: int = 0, key: str = "key") -> DataFrame:
    """Keys with a prefix in byte order; limit 0: all."""
    found = keys.where(F.col(key).startswith(prefix)) if prefix else keys
    return found.select(key).orderBy(key).limit(limit) if limit else found.select(key).orderBy(key)


def is_duplicate_of(refs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: whether two keys have one object."""
    one = lambda k: F.max(F.when(F.col("key") == k, F.col("object_id")))
    return refs.where(F.col("key").isin(a, b)).agg(F.coalesce(one(a) == one(b), F.lit(False)).alias("same"))


def same_objects(refs: DataFrame, asked: DataFrame) -> DataFrame:
    """(key1, key2, same) for asked pairs of keys that are both there."""
    a, b = refs.select(F.col("key").alias("key1"), F.col("object_id").alias("_o1")), refs.select(F.col("key").alias("key2"), F.col("object_id").alias("_o2"))
    return asked.join(a, "key1").join(b, "key2").select("key1", "key2", (F.col("_o1") == F.col("_o2")).alias("same"))


def dangling_keys(refs: DataFrame, objs: DataFrame) -> DataFrame:
    """Keys whose object is gone."""
    return refs.join(objs, "object_id", "left_anti").select("key")


def touch(objs: DataFrame, accesses: DataFrame, interval_seconds: int = 3600) -> DataFrame:
    """objs with last_accessed after reads (object_id, ts); a read within the interval of the last recorded one isn't recorded.

    Without an interval this is the latest read, a plain aggregate; else each object's reads stream by in time order, and only the last recorded one is held.
    """
    if interval_seconds == 0:
        seen = accesses.groupBy("object_id").agg(F.max("ts").alias("_seen"))
        return objs.join(seen, "object_id", "left").withColumn("last_accessed", F.greatest("last_accessed", F.coalesce("_seen", "last_accessed"))).drop("_seen")
    kind = objs.schema["last_accessed"].dataType
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    reads = accesses.select("object_id", micros("ts").alias("t")).distinct()
    rows = objs.select("object_id", micros("last_accessed").alias("last")).join(reads, "object_id").repartition("object_id").sortWithinPartitions("object_id", "t")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, last, out = None, 0, []
        for batch in batches:
            for o, first, t in zip(*(batch.column(c).to_pylist() for c in ("object_id", "last", "t"))):
                if o != here:
                    out += [(here, last)] if here is not None else []
                    here, last = o, first
                if t >= last + interval_seconds * 1_000_000:
                    last = t
            yield pa.RecordBatch.from_arrays([pa.array([o for o, _ in out], pa.string()), pa.array([t for _, t in out], pa.int64())], ["object_id", "t"])
            out = []
        if here is not None:
            yield pa.RecordBatch.from_arrays([pa.array([here], pa.string()), pa.array([last], pa.int64())], ["object_id", "t"])

    seen = rows.mapInArrow(follow, "object_id string, t bigint").withColumn("_seen", F.timestamp_micros("t").cast(kind)).drop("t")
    return objs.join(seen, "object_id", "left").withColumn("last_accessed", F.coalesce("_seen", "last_accessed")).drop("_seen")


def health(refs: DataFrame, objs: DataFrame, now: Column, ttl_seconds: int = 0) -> DataFrame:
    """One row of counts, bytes, ages in whole seconds and total_keys/total_objects; ages and ratio are 0 without objects."""
    whole = lambda c: F.floor(age(now, c)).cast("bigint")
    o = objs.agg(
        F.count("*").alias("total_objects"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"),
        F.count(F.when(expired(now, ttl_seconds), 1)).alias("expired_objects"), F.count(F.when(F.col("refcount") == 0, 1)).alias("orphaned_objects"),
        F.coalesce(F.max(whole(F.col("created_at"))), F.lit(0)).alias("oldest_object_age_s"), F.coalesce(F.min(whole(F.col("last_accessed"))), F.lit(0)).alias("newest_access_age_s"),
    )
    out = refs.agg(F.count("*").alias("total_keys")).crossJoin(o)
    return out.withColumn("dedup_ratio", F.when(F.col("total_objects") > 0, F.col("total_keys") / F.col("total_objects")).otherwise(0.0))


def counts(refs: DataFrame, objs: DataFrame) -> DataFrame:
    return refs.agg(F.count("*").alias("keys")).crossJoin(objs.agg(F.count(F.when(F.col("refcount") > 0, 1)).alias("unique_values"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes")))


def approximate_counts(df: DataFrame, *columns: str) -> DataFrame:
    """HyperLogLog++ estimates of distinct values."""
    return df.agg(*(F.approx_count_distinct(c).alias(c) for c in columns))


@dataclass
class Store:
    """A store over an operation log; each change gives a new one, so reads are of a snapshot."""

    log: DataFrame
    config: DedupConfig = DedupConfig()

    @classmethod
    def from_items(cls, items: DataFrame, config: DedupConfig | None = None) -> Store:
        """Puts of (seq, ts, key, value)."""
        return cls(items.select("seq", "ts", "key", "value"), config or DedupConfig())

    @property
    def refs(self) -> DataFrame:
        return references(self.log).select("key", "value", T.object_id(F.col("value")).alias("object_id"), "seq")

    @property
    def objects(self) -> DataFrame:
        return objects(self.log, self.config.enable_gc)

    def put(self, more: DataFrame) -> Store:
        return Store(self.log.unionByName(more.select("seq", "ts", "key", "value")), self.config)

    def delete(self, more: DataFrame) -> Store:
        return self.put(more.withColumn("value", F.lit(None).cast("string")))

    def get(self, key: str, now: Column, default: str | None = None) -> str:
        keys = self.log.sparkSession.createDataFrame([(key,)], "key string")
        row = get(self.refs, self.objects, keys, now, self.config.default_ttl_seconds, default).first()
        if row.value is None:
            raise NotFound(key)
        return row.value

    def health(self, now: Column) -> DataFrame:
        return health(self.refs, self.objects, now, self.config.default_ttl_seconds)

    def __getitem__(self, key: str) -> str:
        return self.get(key, F.current_timestamp())

    def __contains__(self, key: str) -> bool:
        keys = self.log.sparkSession.createDataFrame([(key,)], "key string")
        return contains(self.refs, self.objects, keys, F.current_timestamp(), self.config.default_ttl_seconds).first().present

    def __len__(self) -> int:
        return self.refs.count()

    def keys(self, prefix: str = "", limit: int = 0) -> DataFrame:
        return list_keys(self.refs, prefix, limit)

    @classmethod
    def read(cls, spark: SparkSession, path: str, config: DedupConfig | None = None) -> Store:
        """A store that `write` left: its log."""
        return cls(spark.read.parquet(f"{path}/log"), config or DedupConfig())

    def write(self, path: str) -> None:
        """In Parquet: the log, from which `read` opens the store again, and references and objects beside it."""
        self.log.write.mode("overwrite").parquet(f"{path}/log")
        self.refs.write.mode("overwrite").parquet(f"{path}/refs")
        self.objects.write.mode("overwrite").parquet(f"{path}/objects")
