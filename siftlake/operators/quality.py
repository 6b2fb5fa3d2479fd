"""Quality of deduplication: confusion counts, sweeps, drift of classes, spread of scores, and comparison of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LATENCY_BUCKETS
from ..functions.stats import t_quantile


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion(df: DataFrame, predicted: Column, truth: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, accuracy and false-positive rate, 0 where a denominator is; null predictions or truths don't count."""
    n = lambda c: F.count_if(c)
    g = df.groupBy(*(by or [])).agg(n(predicted & truth).alias("tp"), n(predicted & ~truth).alias("fp"), n(~predicted & truth).alias("fn"), n(~predicted & ~truth).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    g = g.withColumn("precision", _share(tp, tp + fp)).withColumn("recall", _share(tp, tp + fn))
    return g.withColumn("f1", _share(2 * tp, 2 * tp + fp + fn)).withColumn("accuracy", _share(tp + tn, tp + fp + fn + tn)).withColumn("fpr", _share(fp, fp + tn))


def sweep(df: DataFrame, score: Column, truth: Column, thresholds: list[float]) -> DataFrame:
    """`confusion` at each threshold, in one pass."""
    rows = df.select(F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold"), score.alias("_s"), truth.alias("_t"))
    return confusion(rows, F.col("_s") >= F.col("threshold"), F.col("_t"), ["threshold"])


def best_f1(swept: DataFrame) -> DataFrame:
    """The threshold with the highest f1, of equals the least."""
    return swept.groupBy().agg(F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold"))).alias("x")).select("x.threshold", "x.f1")


def percentiles(df: DataFrame, c: Column, accuracy: int = 0) -> DataFrame:
    """p50, p95 and p99 with linear interpolation, which holds a count of each distinct value; with an accuracy, approximately and in bounded memory."""
    if accuracy:
        return df.agg(*(F.approx_percentile(c, F.lit(p / 100), F.lit(accuracy)).alias(f"p{p}") for p in (50, 95, 99)))
    return df.agg(*(F.percentile(c, F.lit(p / 100)).alias(f"p{p}") for p in (50, 95, 99)))


def histogram(df: DataFrame, c: Column, buckets: tuple[float, ...] = LATENCY_BUCKETS) -> DataFrame:
    """(le, n): cumulative counts up to each bound, and up to infinity."""
    sums = df.agg(*(F.count_if(c <= b).alias(f"b{i}") for i, b in enumerate(buckets)), F.count(c).alias("all"))
    cells = [F.struct(F.lit(str(float(b))).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(buckets)]
    return sums.select(F.explode(F.array(*cells, F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))).alias("x")).select("x.*")


def prometheus(hist: DataFrame, name: str, help: str | None = None, total: float | None = None) -> DataFrame:
    """Lines of text for a scraper, in order with help and type before the buckets, and sum and count after them where `total` is given."""
    lines = hist.select(F.format_string(f'{name}_bucket{{le="%s"}} %d', "le", "n").alias("line"))
    if help is None and total is None:
        return lines
    made = lambda *x: hist.sparkSession.createDataFrame([(t,) for t in x], "line string")
    count = hist.where("le = '+Inf'").select(F.format_string(f"{name}_count %d", "n").alias("line"))
    before = made(f"# HELP {name} {help or name}", f"# TYPE {name} histogram").union(lines)
    return before.union(made(f"{name}_sum {total}")).union(count) if total is not None else before


def distribution(df: DataFrame, label: str) -> DataFrame:
    """(label, n, share)."""
    n = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("_all")))).select("label", "n", (F.col("n") / F.col("_all")).alias("share"))


def kl_divergence(p: DataFrame, q: DataFrame, label: str, epsilon: float = 1e-10) -> DataFrame:
    """The divergence of q's classes from p's in nats; a class that q lacks has share epsilon, negatives count as 0."""
    a, b = distribution(p, label).select("label", F.col("share").alias("p")), distribution(q, label).select("label", F.col("share").alias("q"))
    each = a.join(b, "label", "left").where(F.col("p") > epsilon).select((F.col("p") * F.log(F.col("p") / F.coalesce("q", F.lit(epsilon)))).alias("x"))
    return each.agg(F.greatest(F.lit(0.0), F.coalesce(F.sum("x"), F.lit(0.0))).alias("kl"))


def minority_retention(before: DataFrame, after: DataFrame, label: str, limit: float = 0.1) -> DataFrame:
    """(label, before, after, retention) of classes with a share under the limit."""
    n = after.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("after"))
    rare = distribution(before, label).where(F.col("share") < limit).select("label", F.col("n").alias("before"))
    return rare.join(n, "label", "left").select("label", "before", F.coalesce("after", F.lit(0)).alias("after"), (F.coalesce("after", F.lit(0)) / F.col("before")).alias("retention"))


def spread(df: DataFrame, c: Column, by: list[str]) -> DataFrame:
    """(by, n, mean, std) of a score."""
    return df.groupBy(*by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("std"))


def intervals(spread_: DataFrame, level: float = 0.95) -> DataFrame:
    """Adds low and high of the mean by Student's t; a point for one value."""
    quantile = F.udf(lambda n: t_quantile((1 + level) / 2, n - 1) if n > 1 else 0.0, "double")  # a row for each group, not for each value
    half = quantile(F.col("n")) * F.col("std") / F.sqrt("n")
    return spread_.withColumn("low", F.col("mean") - half).withColumn("high", F.col("mean") + half)


def cohens_d(df: DataFrame, c: Column, second: Column) -> DataFrame:
    """d of the rows where `second` holds against the others, and its band."""
    a, b = F.when(~second, c), F.when(second, c)
    g = df.agg(F.count(a).alias("na"), F.count(b).alias("nb"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"))
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2))
    few = (F.col("na") < 2) | (F.col("nb") < 2)
    g = g.withColumn("d", F.when(few | (pooled == 0), 0.0).otherwise((F.col("mb") - F.col("ma")) / pooled))
    size = F.abs("d")
    return g.select("d", F.when(few, "insufficient").when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large").alias("band"))


def compare(current: DataFrame, baseline: DataFrame, key: list[str]) -> DataFrame:
    """Reports (key, f1, p95) side by side: regressions are f1 5 % down or p95 5 % up, an improvement f1 1 % up."""
    b = baseline.select(*key, F.col("f1").alias("base_f1"), F.col("p95").alias("base_p95"))
    j = current.join(b, key)
    f1, p95 = F.col("f1") / F.col("base_f1") - 1, F.col("p95") / F.col("base_p95") - 1
    return j.withColumn("f1_change", f1).withColumn("p95_change", p95).withColumn("verdict", F.when((f1 < -0.05) | (p95 > 0.05), "regression").when(f1 > 0.01, "improvement").otherwise("same"))


def pair_evaluation(refs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Confusion of pairs (key1, key2, is_duplicate) by whether both keys have one object."""
    a, b = refs.select(F.col("key").alias("key1"), F.col("object_id").alias("_o1")), refs.select(F.col("key").alias("key2"), F.col("object_id").alias("_o2"))
    return confusion(pairs.join(a, "key1").join(b, "key2"), F.col("_o1") == F.col("_o2"), F.col("is_duplicate"))


def seed_summary(scores: DataFrame, by: list[str]) -> DataFrame:
    """Mean and spread of `score` over seeds."""
    return intervals(spread(scores, F.col("score"), by))


def sample_efficiency(df: DataFrame) -> DataFrame:
    """Adds accuracy for each thousand training rows."""
    return df.withColumn("efficiency", _share(F.col("accuracy"), F.col("n_train") / 1000))
