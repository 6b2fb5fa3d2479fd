"""Reading tables, and a cache of results that a digest of the options names."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CacheConfig, DedupConfig
from ..errors import InvalidOption

FORMATS = ("parquet", "csv", "json", "orc", "text")


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    if kind not in FORMATS:
        raise InvalidOption(f"no format {kind}; there are {', '.join(FORMATS)}")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def cache_path(cache: CacheConfig, name: str, cfg: DedupConfig) -> str:
    return f"{cache.directory}/{cache.key or f'{name}_{cfg.digest()}'}"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def cached(spark: SparkSession, cache: CacheConfig, name: str, cfg: DedupConfig, make: Callable[[], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(rows, metrics) from the cache, made and written there when they are missing or to be made anew.

    Metrics are written last, so half a cache counts as none.
    """
    path = cache_path(cache, name, cfg)
    fs, p = _fs(spark, f"{path}/metrics/_SUCCESS")
    if cache.overwrite or not fs.exists(p):
        rows, metrics = make()
        rows.write.mode("overwrite").parquet(f"{path}/rows")
        metrics.write.mode("overwrite").json(f"{path}/metrics")
    return spark.read.parquet(f"{path}/rows"), load_metrics(spark, path)


def load_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(f"{path}/metrics")


def clear_cache(spark: SparkSession, cache: CacheConfig, name: str | None = None) -> None:
    """Removes one entry, or all entries whose names this cache gives."""
    fs, root = _fs(spark, cache.directory)
    if fs.exists(root):
        for s in fs.listStatus(root):
            entry = s.getPath().getName()
            if name is None or re.fullmatch(rf"{re.escape(name)}_[0-9a-f]{{8}}", entry) or entry == cache.key:
                fs.delete(s.getPath(), True)


PAIR_COLUMNS = {"mrpc": ("sentence1", "sentence2", "label"), "qqp": ("question1", "question2", "label"), "paws": ("sentence1", "sentence2", "label"), "stsb": ("sentence1", "sentence2", "label")}


def text_pairs(df: DataFrame, kind: str, graded_from: float = 4.0) -> DataFrame:
    """(text1, text2, is_duplicate) from a set of sentence pairs; graded labels count from `graded_from`; rows with nulls go."""
    if kind not in PAIR_COLUMNS:
        raise InvalidOption(f"no pair set {kind}")
    a, b, label = PAIR_COLUMNS[kind]
    truth = F.col(label) >= graded_from if kind == "stsb" else F.col(label).cast("int") == 1
    return df.select(F.col(a).alias("text1"), F.col(b).alias("text2"), truth.alias("is_duplicate")).dropna()


def stratified_sample(df: DataFrame, label: str, key: str, share: float) -> DataFrame:
    """About that share of each class, chosen by a hash of the key: the same rows in each run, in one pass."""
    text = F.concat_ws("|", F.lit("42"), F.coalesce(F.col(label).cast("string"), F.lit("")), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return df.where(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") % 1_000_000 < int(share * 1_000_000))


def embedding_cache_key(model: str, text) -> F.Column:
    return F.concat(F.lit(f"emb:{model}:"), F.substring(F.sha2(text.cast("binary"), 256), 1, 16))


def with_cached_embeddings(texts: DataFrame, cache: DataFrame, model: str, column: str = "text") -> DataFrame:
    """texts with their embedding, null where the cache (key, embedding) has none."""
    return texts.withColumn("key", embedding_cache_key(model, F.col(column))).join(cache.select("key", "embedding"), "key", "left")
