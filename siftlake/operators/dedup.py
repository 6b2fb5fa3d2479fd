"""Exact deduplication: equal normalized values share an object; the first row by the order column leads.

Give a unique order column: which of two rows of equal value and order leads is not defined. Null texts count as empty, and so equal
each other. All operators shuffle once, on the digest, and carry only what the result needs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DedupConfig, Mode
from ..errors import InvalidOption
from ..functions import text as T
from ..plans.lineage import cut
from . import semantic


def value(cfg: DedupConfig) -> Column:
    c = T.extract_text(list(cfg.text_columns), cfg.separator) if cfg.text_columns else F.coalesce(F.col(cfg.text_column).cast("string"), F.lit(""))
    return T.normalize(c, cfg.normalization, cfg.normalization_max_bytes)


def _free(df: DataFrame, *names: str) -> None:
    """Columns that an operator adds must not be there."""
    taken = sorted(set(names) & set(df.columns))
    if taken:
        raise InvalidOption(f"rename column {', '.join(taken)}: results have one of that name")


def _fresh(df: DataFrame) -> str:
    return "".join(df.columns) + "_"  # no column has this name


def _order(cfg: DedupConfig) -> Column:
    return F.col(cfg.order_column).asc() if cfg.keep_first else F.col(cfg.order_column).desc()


def flag(df: DataFrame, cfg: DedupConfig) -> DataFrame:
    """All rows with object_id, is_duplicate and original (the leading row's order value)."""
    T.validate_columns(df, [cfg.order_column, *(cfg.text_columns or (cfg.text_column,))])
    _free(df, "object_id", "is_duplicate", "original")
    w = Window.partitionBy("object_id").orderBy(_order(cfg))
    return df.withColumn("object_id", T.object_id(value(cfg))).withColumn("is_duplicate", F.row_number().over(w) > 1).withColumn("original", F.first(cfg.order_column).over(w))


def kept(df: DataFrame, cfg: DedupConfig) -> DataFrame:
    """Leading rows with object_id; a rank of 1 lets Spark drop most duplicates before the shuffle."""
    T.validate_columns(df, [cfg.order_column, *(cfg.text_columns or (cfg.text_column,))])
    _free(df, "object_id")
    w, n = Window.partitionBy("object_id").orderBy(_order(cfg)), _fresh(df)
    return df.withColumn("object_id", T.object_id(value(cfg))).withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).drop(n)


def removed(df: DataFrame, cfg: DedupConfig) -> DataFrame:
    return flag(df, cfg).where("is_duplicate").drop("is_duplicate")


def objects(df: DataFrame, cfg: DedupConfig) -> DataFrame:
    """(object_id, leader, refcount, size_bytes): sizes are of the leading row's own bytes, not the normal form's."""
    raw = df.select(T.object_id(value(cfg)).alias("object_id"), F.col(cfg.order_column).alias("o"), F.octet_length(F.coalesce(F.col(cfg.text_column), F.lit(""))).cast("bigint").alias("b"))
    pick = F.min_by if cfg.keep_first else F.max_by
    lead = F.min if cfg.keep_first else F.max
    return raw.groupBy("object_id").agg(lead("o").alias("leader"), F.count("*").alias("refcount"), pick("b", "o").alias("size_bytes"))


def references(df: DataFrame, cfg: DedupConfig) -> DataFrame:
    return df.select(T.make_key(F.col(cfg.order_column), cfg.key_prefix).alias("key"), T.object_id(value(cfg)).alias("object_id"), F.col(cfg.order_column).cast("bigint").alias("seq"))


def metrics(df: DataFrame, cfg: DedupConfig) -> DataFrame:
    """total_seen, unique_kept, duplicates_removed, dedup_ratio (1 if nothing is kept), removal_rate and keep_rate."""
    return metrics_of(objects(df, cfg).agg(F.coalesce(F.sum("refcount"), F.lit(0)).alias("total_seen"), F.count("*").alias("unique_kept")))


def metrics_of(counts: DataFrame, others: list[str] | None = None) -> DataFrame:
    total, unique = F.col("total_seen"), F.col("unique_kept")
    return counts.select(
        total.cast("bigint").alias("total_seen"),
        unique.cast("bigint").alias("unique_kept"),
        (total - unique).cast("bigint").alias("duplicates_removed"),
        F.when(unique > 0, total / unique).otherwise(1.0).alias("dedup_ratio"),
        F.when(total > 0, (total - unique) / total).otherwise(0.0).alias("removal_rate"),
        F.when(total > 0, unique / total).otherwise(0.0).alias("keep_rate"),
        *(others or []),
    )


def merge_metrics(parts: DataFrame) -> DataFrame:
    """Metrics of several runs in one: counts and times add up, of storage fields the greatest stays; items a second and contamination rate follow from these."""
    added = [c for c in ("contaminated_count", "elapsed_seconds") if c in parts.columns]
    highest = [c for c in ("storage_bytes", "total_objects", "total_keys") if c in parts.columns]
    sums = parts.agg(F.sum("total_seen").alias("total_seen"), F.sum("unique_kept").alias("unique_kept"), *(F.sum(c).alias(c) for c in added), *(F.max(c).alias(c) for c in highest))
    out = metrics_of(sums, [*added, *highest])
    if "contaminated_count" in added:
        out = out.withColumn("contamination_rate", F.when(F.col("total_seen") > 0, F.col("contaminated_count") / F.col("total_seen")).otherwise(0.0))
    return out.withColumn("items_per_second", F.when(F.col("elapsed_seconds") > 0, F.col("total_seen") / F.col("elapsed_seconds")).otherwise(0.0)) if "elapsed_seconds" in added else out


def summary(measured: DataFrame) -> str:
    """A line for each field of one row of metrics."""
    row = measured.first()
    return "\n".join(f"{k}: {v:.4f}" if isinstance(v, float) else f"{k}: {v}" for k, v in row.asDict().items()) if row else ""


def positions(df: DataFrame, cfg: DedupConfig) -> DataFrame:
    """(position, original): the deduplicated index of each kept row. The rank over all rows is taken by ranges, not in one task."""
    return number(kept(df, cfg).select(F.col(cfg.order_column).alias("original")), "original", "position")


def number(df: DataFrame, by: str, name: str) -> DataFrame:
    """Adds the 0-based position by a unique column of any type that sorts: rows are split into ranges by a sample of the column, ranked within, and shifted by what comes before."""
    own = _fresh(df)
    ranged = cut(df.repartitionByRange(by).withColumn(own, F.spark_partition_id()))  # cut: the ranges of a second run may differ
    within = ranged.withColumn(name, F.row_number().over(Window.partitionBy(own).orderBy(by)))
    ends = ranged.groupBy(own).agg(F.count("*").alias(f"{own}n"))
    before = ends.select(own, F.coalesce(F.sum(f"{own}n").over(Window.orderBy(own).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"{own}n"))  # one row a partition
    return within.join(F.broadcast(before), own).withColumn(name, F.col(name) + F.col(f"{own}n") - 1).drop(own, f"{own}n")


def chunks(df: DataFrame, cfg: DedupConfig, size: int) -> DataFrame:
    """(chunk, position, original) of kept rows, so many a chunk; the last may be shorter."""
    return positions(df, cfg).withColumn("chunk", F.floor(F.col("position") / size)).select("chunk", "position", "original")


def shards(df: DataFrame, cfg: DedupConfig, workers: int) -> DataFrame:
    """Rows kept when each of so many workers deduplicates its own share (order modulo workers) alone."""
    _free(df, "shard", "object_id")
    w, n = Window.partitionBy("shard", "object_id").orderBy(_order(cfg)), _fresh(df)
    return df.withColumn("shard", F.pmod(F.col(cfg.order_column), F.lit(workers)).cast("int")).withColumn("object_id", T.object_id(value(cfg))).withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).drop(n)


def cross_split(splits: dict[str, DataFrame], cfg: DedupConfig, primary: str = "train") -> dict[str, DataFrame]:
    """The primary split as it is; the others without rows whose value it has. They keep their own duplicates."""
    if primary not in splits:
        return dict(splits)
    known = splits[primary].select(T.object_id(value(cfg)).alias("_known")).distinct()
    return {name: df if name == primary else df.join(known, T.object_id(value(cfg)) == F.col("_known"), "left_anti") for name, df in splits.items()}


def cross_dataset(datasets: dict[str, DataFrame], cfg: DedupConfig) -> DataFrame:
    """(dataset, order, object_id, is_duplicate): each dataset against itself and all before it, in the given order."""
    out = None
    for i, (name, df) in enumerate(datasets.items()):
        rows = df.select(F.lit(i).alias("_i"), F.lit(name).alias("dataset"), F.col(cfg.order_column).alias("order"), T.object_id(value(cfg)).alias("object_id"))
        out = rows if out is None else out.unionByName(rows)
    w = Window.partitionBy("object_id").orderBy("_i", "order")
    return out.withColumn("is_duplicate", F.row_number().over(w) > 1).drop("_i")


@dataclass(frozen=True)
class DedupResult:
    kept: DataFrame
    removed: DataFrame
    mapping: DataFrame
    metrics: DataFrame


def deduplicate(df: DataFrame, cfg: DedupConfig | None = None, embedder=None, reranker=None, judge=None, **options) -> DedupResult:
    """Either mode in one call. Semantic mode takes vectors from `embedding_column` or an embedder (a function of the text column), and where the
    options ask for them a reranker (a score of two text columns) and a judge (whether two text columns mean the same)."""
    cfg = DedupConfig.of(cfg, **options)
    if cfg.mode is Mode.SEMANTIC:
        return _semantic(df, cfg, embedder, reranker, judge)
    flagged = flag(df, cfg)
    return DedupResult(kept(df, cfg), removed(df, cfg), flagged.select(F.col(cfg.order_column), "object_id", "original", "is_duplicate"), metrics(df, cfg))


def _semantic(df: DataFrame, cfg: DedupConfig, embedder, reranker, judge) -> DedupResult:
    """As in exact mode; the mapping has the leader as `original`, its object's id, and how near and by what a duplicate was found."""
    T.validate_columns(df, [cfg.order_column, *(cfg.text_columns or ([cfg.text_column] if embedder or reranker or judge else []))])
    _free(df, "object_id", "original")
    found = cut(semantic.decisions(df, cfg, embedder, reranker, judge).withColumn("object_id", T.digest(F.col("leader").cast("string")).substr(1, 32)))
    mapping = found.select(F.col("item").alias(cfg.order_column), "object_id", F.col("leader").alias("original"), "is_duplicate", "cos", "by")
    own = mapping.select(cfg.order_column, "object_id", "original", "is_duplicate")
    rows = df.join(own.withColumnRenamed("is_duplicate", name := _fresh(df)), cfg.order_column)
    counted = metrics_of(found.agg(F.count("*").alias("total_seen"), F.count_if(~F.col("is_duplicate")).alias("unique_kept")))
    return DedupResult(rows.where(~F.col(name)).drop(name, "original"), rows.where(F.col(name)).drop(name), mapping, counted)


def deduplicate_splits(splits: dict[str, DataFrame], cfg: DedupConfig | None = None, **options) -> dict[str, DedupResult]:
    """Each split by itself."""
    return {name: deduplicate(df, cfg, **options) for name, df in splits.items()}


@dataclass(frozen=True)
class View:
    """Rows of a deduplicated table by position: `view[3]`, `len(view)`, `view.select([0, 2])`, and batches for a loop that trains."""

    rows: DataFrame  # with their position
    cfg: DedupConfig

    @classmethod
    def of(cls, df: DataFrame, cfg: DedupConfig | None = None, **options) -> View:
        cfg = DedupConfig.of(cfg, **options)
        _free(df, "position")
        led = deduplicate(df, cfg).kept.drop("object_id")
        return cls(cut(number(led, cfg.order_column, "position")), cfg)

    def __len__(self) -> int:
        return self.rows.count()

    def __getitem__(self, at: int) -> dict:
        at = at + len(self) if at < 0 else at
        row = self.rows.where(F.col("position") == at).first()
        if row is None:
            raise IndexError(at)
        return {k: v for k, v in row.asDict().items() if k != "position"}

    def select(self, positions: list[int]) -> View:
        """The rows at some positions, in that order; a position that is asked for twice is there twice."""
        asked = self.rows.sparkSession.createDataFrame(list(enumerate(positions)), "_at bigint, position bigint")
        return View(cut(self.rows.join(F.broadcast(asked), "position").drop("position").withColumnRenamed("_at", "position")), self.cfg)

    def batches(self, size: int | None = None):
        """Lists of rows as dicts, `batch_size` each, in order; one batch's rows come to the driver at a time."""
        size = size or self.cfg.batch_size
        rows = self.rows.orderBy("position").drop("position").toLocalIterator(prefetchPartitions=True)
        batch: list[dict] = []
        for r in rows:
            batch.append(r.asDict())
            if len(batch) == size:
                yield batch
                batch = []
        if batch:
            yield batch


def collate(df: DataFrame, batch: Column) -> DataFrame:
    """A row for each batch with a list of each column; bookkeeping columns go."""
    own = {"is_duplicate", "object_id", "original", "shard"}
    columns = [c for c in df.columns if c not in own]
    rows = df.select(batch.alias("batch"), *columns).groupBy("batch").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows"))
    return rows.select("batch", *(F.col("rows")[c].alias(c) for c in columns))
