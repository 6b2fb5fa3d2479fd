"""Contamination: which rows of a target have a value that a fixed reference has. Target rows are never compared with each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CrossDatasetConfig, DedupConfig, Mode
from ..errors import NotBuilt
from ..functions import text as T
from . import semantic
from .dedup import value

SEVERITY = ((0.001, "none"), (0.01, "low"), (0.05, "medium"))


def reference(df: DataFrame, cfg: DedupConfig) -> DataFrame:
    return df.select(T.object_id(value(cfg)).alias("_known")).distinct()


def _join(target: DataFrame, known: DataFrame, cfg: DedupConfig, how: str) -> DataFrame:
    return target.join(known, T.object_id(value(cfg)) == F.col("_known"), how)


def detect(target: DataFrame, ref: DataFrame, cfg: DedupConfig) -> DataFrame:
    return _join(target, reference(ref, cfg), cfg, "left_semi")


def clean(target: DataFrame, ref: DataFrame, cfg: DedupConfig) -> DataFrame:
    return _join(target, reference(ref, cfg), cfg, "left_anti")


def severity(rate: Column) -> Column:
    out = None
    for limit, name in SEVERITY:
        out = F.when(rate < limit, name) if out is None else out.when(rate < limit, name)
    return out.otherwise("high")


def rate(target: DataFrame, ref: DataFrame, cfg: DedupConfig) -> DataFrame:
    """contaminated, total, rate, reference_count and severity in one pass over the target."""
    found = _join(target, reference(ref, cfg), cfg, "left").agg(F.count("_known").alias("contaminated"), F.count("*").alias("total"))
    share = F.when(F.col("total") > 0, F.col("contaminated") / F.col("total")).otherwise(0.0)
    return found.crossJoin(ref.agg(F.count("*").alias("reference_count"))).withColumn("rate", share).withColumn("severity", severity(F.col("rate")))


def fold_leakage(df: DataFrame, cfg: DedupConfig, folds: int = 5) -> DataFrame:
    """(fold, test_rows, leaked): rows of each fold whose value another fold has too; folds are by the order column."""
    rows = df.select(F.pmod(F.col(cfg.order_column), F.lit(folds)).cast("int").alias("fold"), T.object_id(value(cfg)).alias("v"))
    sizes = rows.groupBy("v", "fold").agg(F.count("*").alias("n"))
    spread = sizes.groupBy("v").agg(F.count("*").alias("folds"), F.collect_list(F.struct("fold", "n")).alias("x"))
    return spread.select("folds", F.explode("x").alias("y")).groupBy(F.col("y.fold").alias("fold")).agg(F.sum("y.n").alias("test_rows"), F.sum(F.when(F.col("folds") > 1, F.col("y.n")).otherwise(0)).alias("leaked"))


class Detector:
    """Checks of many targets against one reference: by value, or in semantic mode by `contamination_threshold`."""

    def __init__(self, cfg: DedupConfig | CrossDatasetConfig | None = None, embedder=None) -> None:
        across = cfg if isinstance(cfg, CrossDatasetConfig) else CrossDatasetConfig(cfg or DedupConfig())
        self.cfg, self.threshold, self.embedder, self._known = across.dedup, across.contamination_threshold, embedder, None

    def build(self, ref: DataFrame) -> Detector:
        self._known = ref if self.cfg.mode is Mode.SEMANTIC else reference(ref, self.cfg)
        return self

    def check(self, target: DataFrame, how: str = "left_semi") -> DataFrame:
        """Contaminated rows, or clean ones with `left_anti`."""
        if self._known is None:
            raise NotBuilt("build a reference first")
        if self.cfg.mode is Mode.SEMANTIC:
            return target.join(self.matches(target), F.col(self.cfg.order_column) == F.col("item"), how)
        return _join(target, self._known, self.cfg, how)

    def matches(self, target: DataFrame) -> DataFrame:
        """(item, match, cos): in semantic mode the nearest reference row of each contaminated one."""
        if self._known is None:
            raise NotBuilt("build a reference first")
        return semantic.contaminated(target, self._known, self.cfg, self.threshold, self.embedder)

    def result(self, target: DataFrame) -> DataFrame:
        """contaminated, total, rate and severity."""
        counted = self.check(target).agg(F.count("*").alias("contaminated")).crossJoin(target.agg(F.count("*").alias("total")))
        return counted.withColumn("rate", F.when(F.col("total") > 0, F.col("contaminated") / F.col("total")).otherwise(0.0)).withColumn("severity", severity(F.col("rate")))
