import datetime
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftlake.config import DedupConfig, Normalization
from siftlake.errors import InvalidOption, NotBuilt, NotFound, http_status
from siftlake.functions import stats
from siftlake.functions import text as T
from siftlake.functions import vectors as V
from siftlake.operators import contamination, dedup, quality, retention, similarity, store
from siftlake.plans.catalogue import QUERIES
from siftlake.sources import synthetic, tables

CASES = [
    (Normalization.NONE, "  A  b ", "  A  b "),
    (Normalization.WHITESPACE, "  a \t\r\n b\x0b\x0cc ", "a b c"),
    (Normalization.WHITESPACE, "a b", "a b"),
    (Normalization.WHITESPACE, " \n ", ""),
    (Normalization.ASCII, "ÀB  c", "Àb c"),
    (Normalization.UNICODE, "ÀÖØÞ×ßÿ", "àöøþ×ßÿ"),
    (Normalization.UNICODE, "x² H₂O ½ ﬁn", "x2 h2o 1/2 fin"),
    (Normalization.UNICODE, "ＡＢｃ１！～", "abc1!~"),
    (Normalization.UNICODE, "ﬀ ﬂ ﬃ ﬄ ﬅ ﬆ ⁿ⁺₋", "ff fl ffi ffl st st n+-"),
    (Normalization.UNICODE, "日本 ＃", "日本 #"),
]


def test_normalization(spark):
    for mode in Normalization:
        rows = [(i, a, b) for i, (m, a, b) in enumerate(CASES) if m is mode]
        df = spark.createDataFrame(rows, "i int, a string, b string").withColumn("n", T.normalize(F.col("a"), mode))
        assert [(r.i, r.n) for r in df.collect()] == [(r.i, r.b) for r in df.collect()]


def test_normalization_is_idempotent(spark):
    random.seed(3)
    alphabet = "aB \t\nÀ²½ﬁＡ～ß日."
    texts = ["".join(random.choices(alphabet, k=random.randrange(30))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for mode in Normalization:
        once = T.normalize(F.col("t"), mode)
        assert df.where(T.normalize(once, mode) != once).count() == 0


SAMPLE = ["hello", "world", "hello", "spark", "world", "data", "join", "hello"]


def frame(spark, texts, start=0):
    return spark.createDataFrame([(i + start, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


def test_keep_first_and_metrics(spark):
    df = frame(spark, SAMPLE)
    r = dedup.deduplicate(df)
    assert sorted(x.doc_id for x in r.kept.collect()) == [0, 1, 3, 5, 6]
    assert sorted((x.doc_id, x.original) for x in r.removed.collect()) == [(2, 0), (4, 1), (7, 0)]
    m = r.metrics.first()
    assert (m.total_seen, m.unique_kept, m.duplicates_removed) == (8, 5, 3) and m.dedup_ratio == 1.6
    assert sorted(x.doc_id for x in dedup.deduplicate(df, keep_first=False).kept.collect()) == [3, 4, 5, 6, 7]


def test_nulls_empty_tables_and_order(spark):
    df = frame(spark, ["", None, "a"])
    assert sorted(x.doc_id for x in dedup.kept(df, DedupConfig()).collect()) == [0, 2]
    empty = df.limit(0)
    m = dedup.metrics(empty, DedupConfig()).first()
    assert (m.total_seen, m.unique_kept, m.dedup_ratio, m.removal_rate) == (0, 0, 1.0, 0.0)
    assert dedup.positions(empty, DedupConfig()).count() == 0
    random.seed(1)
    shuffled = spark.createDataFrame(random.sample([(i, t) for i, t in enumerate(SAMPLE)], 8), "doc_id bigint, text string").repartition(3)
    assert sorted(x.doc_id for x in dedup.kept(shuffled, DedupConfig()).collect()) == [0, 1, 3, 5, 6]


def test_options():
    with pytest.raises(InvalidOption):
        DedupConfig(semantic_threshold=1.5)
    with pytest.raises(ValueError):
        DedupConfig(batch_size=0)
    with pytest.raises(InvalidOption):
        DedupConfig.of(nonsense=1)
    assert DedupConfig().digest() != DedupConfig(text_column="x").digest()
    assert http_status(NotFound("k")) == 404 and http_status(InvalidOption()) == 400 and http_status(KeyError()) == 500


def test_unknown_column(spark):
    with pytest.raises(InvalidOption, match="no column body"):
        dedup.kept(frame(spark, ["a"]), DedupConfig(text_column="body"))


def test_contamination(spark):
    train, test = frame(spark, ["a", "b", "c", "d", "e"]), frame(spark, ["d", "x", "y"], 100)
    assert [r.doc_id for r in contamination.detect(train, test, DedupConfig()).collect()] == [3]
    assert contamination.clean(train, test, DedupConfig()).count() == 4
    r = contamination.rate(train, test, DedupConfig()).first()
    assert (r.contaminated, r.total, r.rate, r.reference_count, r.severity) == (1, 5, 0.2, 3, "high")
    with pytest.raises(NotBuilt):
        contamination.Detector().check(train)
    assert contamination.Detector().build(test).check(train).count() == 1


def ts(s):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


def oplog(spark, rows):
    return spark.createDataFrame([(i, ts(t), k, v) for i, (t, k, v) in enumerate(rows)], "seq bigint, ts timestamp, key string, value string")


def now(s):
    return F.lit(ts(s))


def test_store_health(spark):
    s = store.Store.from_items(oplog(spark, [(0, "a", "x" * 100), (0, "b", "y" * 200), (0, "c", "y" * 200)]))
    h = s.health(now(10)).first()
    assert (h.total_keys, h.total_objects, h.total_bytes, h.dedup_ratio, h.oldest_object_age_s) == (3, 2, 300, 1.5, 10)
    assert s.get("b", now(0)) == "y" * 200 and s.get("zz", now(0), "other") == "other"
    with pytest.raises(NotFound):
        s.get("zz", now(0))
    assert s.delete(oplog(spark, [(1, "b", None)]).withColumn("seq", F.lit(9).cast("bigint")).drop("value")).objects.count() == 2


def test_ttl_counts_from_creation(spark):
    log = oplog(spark, [(0, "k1", "v"), (0.6, "k2", "w"), (0.9, "k3", "v")])
    refs, objs = store.references(log), store.objects(log)
    keys = log.select("key")
    got = {r.key: r.value for r in store.get(refs, objs, keys, now(1.2), 1).collect()}
    assert got == {"k1": None, "k2": "w", "k3": None}
    assert {r.key for r in store.contains(refs, objs, keys, now(1.0), 1).where("present").collect()} == {"k1", "k2", "k3"}
    assert retention.sweep(objs, now(5), 1).count() == 2


def fold(rows):
    keys, rc, lives = {}, {}, []
    for t, k, v in rows:
        old = keys.get(k)
        if v == old:
            continue
        if v is not None:
            rc[v] = rc.get(v, 0) + 1
            if rc[v] == 1:
                lives.append((v, t))
            keys[k] = v
        else:
            keys.pop(k, None)
        if old is not None:
            rc[old] -= 1
    return keys, {v: n for v, n in rc.items() if n}, lives


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from(["x", "y", "z", None])), min_size=1, max_size=25))
def test_fold_equals_sequential_run(spark, ops):
    rows = [(i, k, v) for i, (k, v) in enumerate(ops)]
    keys, rc, lives = fold(rows)
    log = oplog(spark, rows)
    assert {r.key: r.value for r in store.references(log).collect()} == keys
    assert {r.value: r.refcount for r in store.objects(log).collect()} == rc
    assert sorted((r.value, r.created_seq) for r in store.incarnations(log).collect()) == sorted(lives)


def test_retention(spark):
    log = oplog(spark, [(0, "a", "x" * 12), (1, "b", "y" * 12), (2, "c", "z" * 12)])
    objs = store.objects(log)
    assert retention.evict_lru(objs, 50).count() == 0
    assert [r.value[0] for r in retention.evict_lru(objs, 20).orderBy("created_at").collect()] == ["x", "y"]
    assert retention.prune(objs, now(100)).count() == 0
    assert retention.prune(objs, now(100), max_age_seconds=99).count() == 1
    refs = store.Store(log).refs
    r, o = retention.cascade(refs, objs, retention.evict_lru(objs, 20))
    assert r.count() == o.count() == 1 and store.dangling_keys(r, o).count() == 0
    reads = objs.select("object_id", F.explode(F.array(*(F.lit(ts(t)) for t in (10, 30, 80)))).alias("ts"))
    seen = {r.value[0]: r.last_accessed for r in store.touch(objs, reads, 50).collect()}
    assert seen["x"] == ts(80) and seen["z"] == ts(80)
    assert store.touch(objs, reads.where(F.col("ts") < F.lit(ts(40))), 50).where(F.col("last_accessed") > F.lit(ts(5))).count() == 0


def test_angles(spark):
    angles = [0, 0.1, 0.6435, 1.047]
    rows = [(i, [math.cos(a), math.sin(a)] + [0.0] * 6) for i, a in enumerate(angles)]
    df = spark.createDataFrame(rows + [(9, None), (10, [])], "vec_id bigint, embedding array<float>")
    got = {(r.a, r.b): r.cos for r in similarity.pairs(df, -1.0).collect()}
    for (i, x), (j, y) in [(p, q) for p in enumerate(angles) for q in enumerate(angles) if p[0] < q[0]]:
        assert got[i, j] == pytest.approx(math.cos(y - x), abs=1e-6)
    assert len(got) == 6
    cos = df.where("size(embedding) > 0").select(V.cosine(F.col("embedding"), F.lit([1.0] + [0.0] * 7)).alias("c")).collect()
    assert [round(r.c, 3) for r in cos] == [1.0, 0.995, 0.8, 0.5]
    assert df.where("vec_id = 10").select(V.cosine(F.col("embedding"), F.col("embedding")).alias("c")).first().c == 0.0


def test_leaders_are_greedy_not_transitive(spark):
    random.seed(4)
    for n, p in ((12, 0.2), (30, 0.1), (30, 0.4)):
        edges = [(i, j, round(random.random(), 6)) for i in range(n) for j in range(i + 1, n) if random.random() < p]
        lead = []
        for k in range(n):
            if not any((a, k) in {(x, y) for x, y, _ in edges} for a in lead):
                lead.append(k)
        sims = spark.createDataFrame(edges, "a bigint, b bigint, cos double")
        dup = {r["item"] for r in similarity.leaders(sims).collect()}
        assert dup == set(range(n)) - set(lead)
        rows = spark.range(n).withColumnRenamed("id", "vec_id")
        for r in similarity.assignment(rows, sims).collect():
            best = max(((c, -a) for a, b, c in edges if b == r["item"] and a in lead), default=None)
            assert r.leader == (-best[1] if best and r["item"] not in lead else r["item"])


def test_quality(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False), (True, True)], "p boolean, t boolean")
    r = quality.confusion(df, F.col("p"), F.col("t")).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 1, 1) and r.precision == pytest.approx(2 / 3) and r.accuracy == 0.6
    r = quality.confusion(df.limit(0), F.col("p"), F.col("t")).first()
    assert (r.precision, r.recall, r.f1, r.accuracy, r.fpr) == (0, 0, 0, 0, 0)
    labels = spark.createDataFrame([("a",)] * 9 + [("b",)], "label string")
    assert quality.kl_divergence(labels, labels, "label").first().kl == 0
    assert quality.kl_divergence(labels, labels.where("label = 'a'"), "label").first().kl > 1
    assert [r.label for r in quality.minority_retention(labels, labels, "label", 0.2).collect()] == ["b"]


def test_statistics():
    assert stats.t_quantile(0.975, 4) == pytest.approx(2.776445, abs=1e-5)
    assert stats.t_cdf(2.0, 10) == pytest.approx(0.963306, abs=1e-5)
    assert stats.confidence_interval([]) == (0, 0, 0) and stats.confidence_interval([2.0]) == (2, 2, 2)
    m, lo, hi = stats.confidence_interval([1, 2, 3, 4, 5])
    assert m == 3 and hi - m == pytest.approx(2.776445 * math.sqrt(0.5), abs=1e-4)
    assert stats.cohens_d([1, 2, 3], [2, 3, 4]) == (1.0, "large") and stats.cohens_d([1], [2, 3])[1] == "insufficient"
    assert stats.paired_t([1, 2], [1]) == (0.0, 1.0)
    t, p = stats.independent_t([1, 2, 3, 4], [2, 3, 4, 6])
    assert t == pytest.approx(1.1677, abs=1e-3) and 0.2 < p < 0.4
    assert stats.generalization([0.9, 0.9], [0.7, 0.8], [0.9, 0.9], [0.8, 0.85])["improvement"] == pytest.approx(0.075)


def test_synthetic(spark):
    made = synthetic.classification(spark, 1000).cache()
    assert made.count() == 1000 and made.where("is_duplicate").count() == 300
    assert made.join(made.select(F.col("idx").alias("original_idx"), F.col("text").alias("t")), "original_idx").where("text <> t").count() == 0
    assert made.exceptAll(synthetic.classification(spark, 1000)).count() == 0
    train, test = synthetic.contaminated(spark, 800, 200)
    assert contamination.detect(test, train, DedupConfig(order_column="idx")).count() == 10
    shares = {r.label: r.share for r in quality.distribution(synthetic.imbalanced(spark, 4000), "label").collect()}
    assert abs(shares[0] - 0.9) < 0.04


def test_synthetic_dedup_equals_a_sequential_pass(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    seen, cells = set(), {(said, known): 0 for said in (True, False) for known in (True, False)}
    for r in synthetic.paraphrases(spark, n).orderBy("idx").collect():
        cells[r.text in seen, r.is_duplicate] += 1
        seen.add(r.text)
    got = QUERIES["synthetic_dedup"](spark, sf_dir).first()
    assert (got.tp, got.fp, got.fn, got.tn) == (cells[True, True], cells[True, False], cells[False, True], cells[False, False])
    assert got.tp and got.fn and got.tp + got.fp + got.fn + got.tn == n


def test_cache_and_pairs(spark, tmp_path):
    cache, calls = tables.CacheConfig(str(tmp_path)), []

    def make():
        calls.append(1)
        df = frame(spark, SAMPLE)
        return dedup.kept(df, DedupConfig()), dedup.metrics(df, DedupConfig())

    for _ in range(2):
        rows, m = tables.cached(spark, cache, "s", DedupConfig(), make)
        assert rows.count() == 5 and m.first().unique_kept == 5
    assert len(calls) == 1
    tables.clear_cache(spark, cache, "s")
    tables.cached(spark, cache, "s", DedupConfig(), make)
    assert len(calls) == 2
    graded = spark.createDataFrame([("a", "b", 4.2), ("a", "c", 3.9), ("a", None, 5.0)], "sentence1 string, sentence2 string, label double")
    assert [r.is_duplicate for r in tables.text_pairs(graded, "stsb").orderBy("text2").collect()] == [True, False]


def test_prompts_and_keys(spark):
    one = spark.range(1)
    p = one.select(T.judge_prompt(F.lit("a"), F.lit("b"), F.lit(0.98765)).alias("p")).first().p
    assert "0.988" in p
    for answer, want in [("[SCORE]: 6\n[DUPLICATE]: NO", (True, True, 6, 0.75)), ("[duplicate]: yes", (True, True, 0, 0.0)), ("nothing", (False, False, 0, 0.0)), ("[SCORE]: 2", (True, False, 2, 0.5))]:
        v = one.select(T.judge_verdict(F.lit(answer)).alias("v")).first().v
        assert (v.valid, v.is_duplicate, v.score, v.confidence) == want
    keys = one.select(T.make_key(F.lit(0), "train_").alias("a"), T.proxy_key(F.lit("GET"), F.lit("/x"), F.lit("q=1"), F.lit("body")).alias("b")).first()
    assert keys.a == "train__item_0" and keys.b == "proxy:GET:/x?q=1"


def test_word_pieces(spark):
    encode = V.word_pieces({"[UNK]": 100, "[CLS]": 101, "[SEP]": 102, "un": 1, "##able": 2, "to": 3, ",": 4, "日": 5}, max_length=8)
    got = spark.createDataFrame([("Unable, TO日x",), ("",), (None,), ("to " * 20,)], "t string").select(encode("t").alias("i")).collect()
    assert [r.i for r in got] == [[101, 1, 2, 4, 3, 5, 100, 102], [101, 102], [101, 102], [101] + [3] * 6 + [102]]
    v = spark.createDataFrame([("a",), ("a",), ("b",)], "t string").select(V.seeded_embedder(16)("t").alias("v")).collect()
    assert v[0].v == v[1].v != v[2].v and sum(x * x for x in v[0].v) == pytest.approx(1, abs=1e-5)


def test_command_line(spark, tmp_path, capsys):
    from siftlake.__main__ import main

    def run(*args):
        code = main([str(tmp_path / "s"), *args])
        return code, capsys.readouterr().out.split()

    run("put", "a", "x" * 10)
    run("put", "b", "x" * 10)
    run("put", "c", "other")
    assert run("get", "b") == (0, ["x" * 10]) and run("get", "zz")[0] == 1
    assert run("count")[1] == ["3"] and run("keys", "--prefix", "b")[1] == ["b"]
    run("del", "c")
    assert run("keys")[1] == ["a", "b"]
    assert run("evict", "0")[1] == ["1"] and run("count")[1] == ["0"]
