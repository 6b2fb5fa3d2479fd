"""Synthetic sets with known duplicates: (idx, text, label, original_idx, is_duplicate, is_paraphrase, duplicate_group_id).

Rows are computed from their index alone, so any number of them can be made in parallel, and again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOPICS = {
    "markets": ("Shares of {a} rose after {b} reported gains", "{b} expects {a} to slow next quarter", "Traders moved from {a} into {b}", "A weak {a} weighs on {b}"),
    "science": ("Researchers found {a} in samples of {b}", "A new study links {a} with {b}", "{b} may explain the origin of {a}", "The team measured {a} near {b}"),
    "sports": ("{a} beat {b} in extra time", "The coach of {b} praised {a}", "Fans of {a} travelled to {b}", "{b} signed a player from {a}"),
    "travel": ("The road from {a} leads to {b}", "Visitors to {b} often miss {a}", "A night train connects {a} with {b}", "{a} is quieter than {b} in spring"),
    "cooking": ("Add {a} before the {b} is done", "Fresh {a} goes well with {b}", "Simmer {b} and stir in {a}", "Serve the {a} over {b}"),
}
WORDS = ("amber", "basalt", "cedar", "delta", "ember", "fjord", "garnet", "harbor", "indigo", "juniper", "kelp", "lagoon", "meadow", "nectar", "onyx", "prairie", "quartz", "river", "saffron", "tundra")
FILLERS = ("As noted before,", "In short,", "By all accounts,", "This week,")
REWRITES = (("found", "discovered"), ("rose", "climbed"), ("often", "frequently"), ("beat", "defeated"), ("Add", "Mix in"), ("leads", "runs"), ("expects", "predicts"), ("well", "nicely"))


def _draw(idx: Column, salt: str, n: int) -> Column:
    return F.pmod(F.xxhash64(idx, F.lit(salt)), F.lit(n)).cast("int")


def _pick(options, at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in options)), at + 1)


def _sentence(idx: Column, topic: Column, seed: int) -> Column:
    forms = F.array(*(F.lit(f) for forms in TOPICS.values() for f in forms))
    text = F.element_at(forms, topic * 4 + _draw(idx, f"form{seed}", 4) + 1)
    text = F.replace(F.replace(text, F.lit("{a}"), _pick(WORDS, _draw(idx, f"a{seed}", len(WORDS)))), F.lit("{b}"), _pick(WORDS, _draw(idx, f"b{seed}", len(WORDS))))
    return F.when(_draw(idx, f"fill{seed}", 100) < 30, F.concat_ws(" ", _pick(FILLERS, _draw(idx, f"which{seed}", len(FILLERS))), text)).otherwise(text)


def paraphrase(text: Column) -> Column:
    for a, b in REWRITES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def classification(spark: SparkSession, n: int, duplicate_share: float = 0.3, paraphrase_share: float = 0.0, shares: tuple[float, ...] = (0.2,) * 5, seed: int = 42, noise: float = 0.15) -> DataFrame:
    """n rows: the first ones are originals, the rest repeat one of them, some reworded; labels are the topic, some at random."""
    originals = max(1, int(n * (1 - duplicate_share)))
    rows = spark.range(n).withColumnRenamed("id", "idx")
    source = F.when(F.col("idx") < originals, F.col("idx")).otherwise(F.pmod(F.xxhash64("idx", F.lit(f"source{seed}")), F.lit(originals)))
    rows = rows.withColumn("source", source).withColumn("is_duplicate", F.col("idx") >= originals)
    at, topic = _draw(F.col("source"), f"topic{seed}", 1_000_000) / 1_000_000, F.lit(len(shares) - 1)
    for k in range(len(shares) - 1, -1, -1):
        topic = F.when(at < sum(shares[: k + 1]), F.lit(k)).otherwise(topic)
    reworded = F.col("is_duplicate") & (_draw(F.col("idx"), f"reword{seed}", 1_000_000) < int(paraphrase_share * 1_000_000))
    text = F.concat(_sentence(F.col("source"), F.pmod(F.col("topic"), F.lit(5)).cast("int"), seed), F.lit(f" [ref:{seed}:"), F.col("source").cast("string"), F.lit("]"))
    rows = rows.withColumn("topic", topic.cast("int")).withColumn("is_paraphrase", reworded)
    label = F.when(_draw(F.col("source"), f"noise{seed}", 1_000_000) < int(noise * 1_000_000), _draw(F.col("source"), f"label{seed}", len(shares))).otherwise(F.col("topic"))
    return rows.select(
        "idx", F.when(F.col("is_paraphrase"), paraphrase(text)).otherwise(text).alias("text"), label.cast("int").alias("label"), F.when(F.col("is_duplicate"), F.col("source")).alias("original_idx"),
        "is_duplicate", "is_paraphrase", F.when(F.col("is_duplicate"), F.substring(F.md5(F.col("source").cast("string").cast("binary")), 1, 8)).alias("duplicate_group_id"),
    )


def imbalanced(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    return classification(spark, n, shares=(0.90, 0.05, 0.03, 0.015, 0.005), seed=seed, noise=0.0)


def contaminated(spark: SparkSession, n_train: int, n_test: int, rate: float = 0.05, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test): exactly int(n_test * rate) test rows repeat a training row."""
    train = classification(spark, n_train, 0.0, seed=seed)
    clean = classification(spark, n_test, 0.0, seed=seed + 1)
    taken = int(n_test * rate)
    bad = train.where(F.col("idx") < taken).select("idx", F.col("text").alias("_t"), F.col("label").alias("_l"))
    test = clean.join(bad, "idx", "left").withColumn("is_duplicate", F.col("_t").isNotNull()).withColumn("text", F.coalesce("_t", "text")).withColumn("label", F.coalesce("_l", "label")).withColumn("original_idx", F.when(F.col("is_duplicate"), F.col("idx"))).drop("_t", "_l")
    return train, test


def paraphrases(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    return classification(spark, n, 0.4, paraphrase_share=0.5, seed=seed)
