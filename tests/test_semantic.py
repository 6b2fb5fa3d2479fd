"""Semantic mode against a plain sequential pass, and what was added around it."""

import itertools
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlake.config import CrossDatasetConfig, DedupConfig, Mode
from siftlake.errors import InvalidOption, NotBuilt
from siftlake.functions import vectors as V
from siftlake.operators import contamination, dedup, quality, semantic, similarity, store
from siftlake.plans.observe import Observed

BASE = DedupConfig(mode=Mode.SEMANTIC, embedding_column="embedding", semantic_threshold=0.9)


def family(seed, n=60, d=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, d))
    v = centres[rng.integers(0, 8, n)] + rng.normal(size=(n, d)) * 0.35
    texts = ["x" * int(k) for k in rng.integers(1, 40, n)]
    return [(i, t, x.tolist()) for i, (t, x) in enumerate(zip(texts, v.astype(np.float32)))]


def sequential(rows, cfg, floor):
    """The decisions as they are described, one row after the other over all leaders."""
    unit = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, _, v in rows}
    texts = {i: t for i, t, _ in rows}
    cos = {(i, j): round(float(unit[i] @ unit[j]), 6) for i, j in itertools.permutations(unit, 2)}
    leaders, out = [], {}
    width, k = (cfg.reranker_top_k if cfg.reranker else cfg.search_k), cfg.rnn_k or cfg.search_k
    for i in sorted(unit):
        found = sorted(((-cos[i, b], b) for b in leaders if cos[i, b] >= floor))[:width]
        match = None
        if cfg.reranker:
            scores = [(max(0.0, 0.9 - 0.01 * abs(len(texts[i]) - len(texts[b]))), -n, b) for n, (_, b) in enumerate(found)]
            if scores and max(scores)[0] >= cfg.reranker_threshold:
                match = (max(scores)[2], "reranker")
        low = min(cfg.semantic_threshold, cfg.judge_threshold) if cfg.judge else cfg.semantic_threshold
        near = [(-c, b) for c, b in found if -c >= low]
        for n, (c, b) in enumerate(near):
            if match:
                break
            others = sorted((cos[b, x] for x in leaders if x != b and cos[b, x] >= floor), reverse=True)
            if cfg.margin and (round(c - (near[n + 1][0] if n + 1 < len(near) else 0), 6) < cfg.margin_threshold or round(c - (others[1] if len(others) > 1 else 0), 6) < cfg.margin_threshold):
                continue
            if cfg.rnn and others and c < others[min(k, len(others)) - 1]:
                continue
            if c >= cfg.semantic_threshold:
                match = (b, "cosine")
            elif min(len(texts[i]), len(texts[b])) / max(len(texts[i]), len(texts[b])) >= 0.8:
                match = (b, "judge")
        out[i] = match
        if match is None:
            leaders.append(i)
    return out


CASES = {
    "plain": {},
    "one candidate": {"search_k": 1},
    "margin": {"margin": True, "margin_threshold": 0.1},
    "reciprocal": {"rnn": True, "rnn_k": 2, "search_floor": -1.0},
    "judge": {"judge": True, "judge_threshold": 0.7},
    "reranker": {"reranker": True, "reranker_top_k": 3, "reranker_threshold": 0.85},
    "all": {"margin": True, "rnn": True, "judge": True, "judge_threshold": 0.7, "reranker": True, "reranker_threshold": 0.88, "search_floor": -1.0},
}


@pytest.mark.parametrize("name", CASES)
def test_decisions_equal_a_sequential_pass(spark, name):
    rows, cfg = family(3), replace(BASE, **CASES[name])
    df = spark.createDataFrame(rows, "doc_id bigint, text string, embedding array<float>")
    judge = lambda a, b: similarity.length_ratio(a, b) >= 0.8
    got = {r["item"]: (r.leader, r.by) if r.is_duplicate else None for r in semantic.decisions(df, cfg, None, similarity.length_reranker, judge).collect()}
    assert got == sequential(rows, cfg, semantic.floor(cfg)) and any(got.values())


def test_semantic_mode_in_one_call(spark):
    rows = [(3, "a", [1.0, 0.0]), (1, "b", [1.0, 0.01]), (2, None, [0.0, 1.0]), (9, "d", None), (10, "e", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, embedding array<double>").withColumn("position_", F.lit(1))
    r = dedup.deduplicate(df, BASE)
    assert sorted(x.doc_id for x in r.kept.collect()) == [1, 2, 9, 10] and [(x.doc_id, x.original) for x in r.removed.collect()] == [(3, 1)]
    assert r.metrics.first().duplicates_removed == 1 and r.mapping.count() == 5 and "text" in r.kept.columns
    assert dedup.deduplicate(df.limit(0), BASE).kept.count() == 0
    made = dedup.deduplicate(df.drop("embedding"), replace(BASE, embedding_column=""), embedder=lambda c: F.when(F.endswith(c, F.lit("a")), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))
    assert sorted(x.doc_id for x in made.kept.collect()) == [1, 3]
    with pytest.raises(InvalidOption):
        dedup.deduplicate(df, replace(BASE, embedding_column=""))
    for wrong in ({"reranker": True}, {"judge": True}):
        with pytest.raises(InvalidOption):
            dedup.deduplicate(df, replace(BASE, **wrong))
    with pytest.raises(InvalidOption):
        DedupConfig(judge=True)


def test_chains_and_large_families(spark, monkeypatch):
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(300)], "a bigint, b bigint, cos double")
    want = list(range(1, 301, 2))
    assert sorted(r["item"] for r in similarity.leaders(chain).collect()) == want
    monkeypatch.setattr(similarity, "FAMILY_LINKS", 5)
    assert sorted(r["item"] for r in similarity.leaders(chain.where("a < 20")).collect()) == [x for x in want if x <= 20]


@pytest.mark.parametrize("block,run", [(16, 2), (2048, 8)])
def test_tiles_equal_brute_force(spark, monkeypatch, block, run):
    monkeypatch.setattr(similarity, "BLOCK", block)
    monkeypatch.setattr(similarity, "RUN", run)
    rows = family(5, 90) + [(200, "", [1.0, 2.0]), (201, "", [2.0, 4.0])]
    df = spark.createDataFrame([(i, v) for i, _, v in rows], "vec_id bigint, embedding array<float>")
    unit = {i: np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) for i, _, v in rows}
    cos = {(i, j): round(float(unit[i] @ unit[j]), 6) for i, j in itertools.permutations(unit, 2) if len(unit[i]) == len(unit[j])}
    got = {(r.a, r.b): r.cos for r in similarity.pairs(df, 0.5).collect()}
    assert got == {k: pytest.approx(c, abs=2e-6) for k, c in cos.items() if k[0] < k[1] and c >= 0.5}
    near = {}
    for r in similarity.knn(df, 4).orderBy("a", "rank").collect():
        near.setdefault(r.a, []).append(pytest.approx(r.cos, abs=2e-6))
    assert near == {i: sorted((c for (a, _), c in cos.items() if a == i), reverse=True)[:4] for i in unit}


def test_contamination_by_similarity(spark):
    ref = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [0.0, 1.0])], "doc_id bigint, text string, embedding array<double>")
    target = spark.createDataFrame([(7, "c", [1.0, 0.02]), (8, "d", [1.0, 1.0]), (9, "e", None)], ref.schema)
    d = contamination.Detector(CrossDatasetConfig(BASE))
    with pytest.raises(NotBuilt):
        d.check(target)
    d.build(ref)
    assert [r.doc_id for r in d.check(target).collect()] == [7] and sorted(r.doc_id for r in d.check(target, "left_anti").collect()) == [8, 9]
    assert d.matches(target).first().match == 1 and d.result(target).first().severity == "high"
    loose = contamination.Detector(CrossDatasetConfig(BASE, 0.7)).build(ref)
    assert sorted(r.doc_id for r in loose.check(target).collect()) == [7, 8]


def test_views_splits_and_clashes(spark):
    df = spark.createDataFrame([(5, "a"), (2, "b"), (7, "a"), (9, "c")], "doc_id bigint, text string")
    v = dedup.View.of(df, batch_size=2)
    assert len(v) == 3 and [v[i]["text"] for i in (0, 1, -1)] == ["b", "a", "c"]
    assert [[r["text"] for r in b] for b in v.batches()] == [["b", "a"], ["c"]]
    assert [r["text"] for b in v.select([2, 0, 2]).batches(10) for r in b] == ["c", "b", "c"]
    with pytest.raises(IndexError):
        v[3]
    parts = dedup.deduplicate_splits({"train": df, "test": df.limit(0)})
    assert parts["train"].kept.count() == 3 and parts["test"].kept.count() == 0
    for taken in ("object_id", "original", "is_duplicate"):
        with pytest.raises(InvalidOption):
            dedup.flag(df.withColumn(taken, F.lit(1)), DedupConfig())
    assert "_n" in dedup.kept(df.withColumn("_n", F.lit(4)), DedupConfig()).columns
    words = spark.createDataFrame([(x,) for x in "pear fig apple kiwi".split()], "name string")
    assert [r.at for r in dedup.number(words, "name", "at").orderBy("name").collect()] == [0, 1, 2, 3]


def test_a_store_is_opened_again(spark, tmp_path):
    items = spark.sql("select stack(3, 1, timestamp'2024-01-01', 'k1', 'v', 2, timestamp'2024-01-01', 'k2', 'v', 3, timestamp'2024-01-02', 'x', 'w') as (seq, ts, key, value)")
    store.Store.from_items(items).write(str(tmp_path / "s"))
    s = store.Store.read(spark, str(tmp_path / "s"))
    assert len(s) == 3 and s["x"] == "w" and "k2" in s and "no" not in s and [r.key for r in s.keys("k").collect()] == ["k1", "k2"]


def test_reads_are_recorded_by_interval(spark):
    rng = random.Random(4)
    reads = [(f"o{rng.randrange(5)}", rng.randrange(20_000)) for _ in range(400)] + [("gone", 5)]
    objs = spark.createDataFrame([(f"o{i}", 1000 * i) for i in range(6)], "object_id string, s bigint").select("object_id", F.timestamp_seconds("s").alias("last_accessed"))
    seen = spark.createDataFrame(reads, "object_id string, s bigint").select("object_id", F.timestamp_seconds("s").alias("ts"))
    want = {}
    for i in range(6):
        last = 1000 * i
        for t in sorted(t for o, t in reads if o == f"o{i}"):
            last = t if t >= last + 3600 else last
        want[f"o{i}"] = last
    assert {r.object_id: r.s for r in store.touch(objs, seen, 3600).select("object_id", F.unix_seconds("last_accessed").alias("s")).collect()} == want


def test_pooling_metrics_and_observation(spark):
    df = spark.createDataFrame([([[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 1.0]], [0])], "t array<array<double>>, m array<int>")
    mean, cls = ([r.v for r in df.select(V.pooled(F.col("t"), F.col("m"), how).alias("v")).collect()] for how in ("mean", "cls"))
    assert mean[0] == pytest.approx([0.6, 0.8]) and mean[1] is None and cls[0] == [1.0, 0.0]
    parts = spark.createDataFrame([(10, 8, 1, 2.0, 50), (30, 12, 3, 6.0, 40)], "total_seen bigint, unique_kept bigint, contaminated_count bigint, elapsed_seconds double, storage_bytes bigint")
    m = dedup.merge_metrics(parts)
    row = m.first()
    assert (row.total_seen, row.duplicates_removed, row.storage_bytes, row.contamination_rate, row.items_per_second) == (40, 20, 50, 0.1, 5.0) and "total_seen: 40" in dedup.summary(m)
    o, got = Observed(spark.range(7).toDF("i"), "run", rows=F.count(F.lit(1)), top=F.max("i")), {}
    assert o.rows.where("i > 2").count() == 4 and o.emit(got.__setitem__) == got == {"run.rows": 7, "run.top": 6}
    lines = [r.line for r in quality.prometheus(quality.histogram(spark.createDataFrame([(0.2,), (3.0,)], "v double"), F.col("v"), (1.0,)), "t_ms", "times", 3.2).collect()]
    assert lines == ["# HELP t_ms times", "# TYPE t_ms histogram", 't_ms_bucket{le="1.0"} 1', 't_ms_bucket{le="+Inf"} 2', "t_ms_sum 3.2", "t_ms_count 2"]
