"""Queries by name, each over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import THRESHOLDS, CrossDatasetConfig, DedupConfig, Mode, Normalization
from ..functions import text as T
from ..functions import vectors as V
from ..operators import contamination, dedup, models, quality, retention, similarity, store
from ..sources import synthetic
from ..sources.tables import embedding_cache_key, stratified_sample, table, with_cached_embeddings
from ..streaming.dedup import distinct, run_to_table, source
from .lineage import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


DOC = DedupConfig()
UNICODE = DedupConfig(normalization=Normalization.UNICODE)
NOW = "2024-01-31 00:00:00"
TTL, AGE, IDLE, TARGET = 86400, 2 * 86400, 6 * 3600, 400
TEST_SOURCE = "src0"
LOW, HIGH = 0.3, 0.4
SEMANTIC = DedupConfig(mode=Mode.SEMANTIC, embedding_column="embedding", order_column="vec_id", semantic_threshold=LOW)


def _q(s: str) -> str:
    return s.replace("'", "''")


SQUEEZE = r"trim(regexp_replace({0}, '[ \t\n\r\x0B\f]+', ' ', 'g'), ' ')"
ASCII = SQUEEZE.format(f"translate({{0}}, '{T.UPPER}', '{T.LOWER}')")
_chain = "{0}"
for _a, _b in T.EXPANSIONS.items():
    _chain = f"replace({_chain}, '{_a}', '{_b}')"
_FOLD = f"translate({_chain}, '{_q(T.SINGLE_FROM)}', '{_q(T.SINGLE_TO)}')".replace("{|}", "{{|}}")
FORMS = {Normalization.WHITESPACE: lambda c: SQUEEZE.format(c), Normalization.ASCII: lambda c: ASCII.format(c), Normalization.UNICODE: lambda c: SQUEEZE.format(_FOLD.format(c))}


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


# exact deduplication

FLAGGED = "flagged as (select *, substr(sha256(text), 1, 32) as object_id, row_number() over (partition by sha256(text) order by doc_id) as n, min(doc_id) over (partition by sha256(text)) as original from documents)"


@query(f"with {FLAGGED} select doc_id, object_id, lang, source from flagged where n = 1")
def exact_dedup_keep_first(spark, d):
    return dedup.kept(docs(spark, d).select("doc_id", "text", "lang", "source"), DOC).select("doc_id", "object_id", "lang", "source")


@query(f"with {FLAGGED} select doc_id, object_id, original from flagged where n > 1")
def exact_dedup_removed(spark, d):
    return dedup.removed(docs(spark, d).select("doc_id", "text"), DOC).select("doc_id", "object_id", "original")


@query(f"with {FLAGGED} select doc_id, object_id, original, n > 1 as is_duplicate from flagged")
def exact_dedup_flagged(spark, d):
    return dedup.flag(docs(spark, d).select("doc_id", "text"), DOC).drop("text")


@query("select max(doc_id) as doc_id, substr(sha256(text), 1, 32) as object_id from documents group by sha256(text)")
def exact_dedup_keep_last(spark, d):
    return dedup.kept(docs(spark, d).select("doc_id", "text"), DedupConfig(keep_first=False)).select("doc_id", "object_id")


METRICS = "count(*) as total_seen, count(distinct {0}) as unique_kept, count(*) - count(distinct {0}) as duplicates_removed, count(*) / count(distinct {0}) as dedup_ratio, (count(*) - count(distinct {0})) / count(*) as removal_rate, count(distinct {0}) / count(*) as keep_rate"


@query(f"select {METRICS.format('text')} from documents")
def dedup_metrics(spark, d):
    return dedup.metrics(docs(spark, d), DOC)


@query(f"with s as (select source, count(*) as t, count(distinct text) as u from documents group by source) select sum(t)::bigint as total_seen, sum(u)::bigint as unique_kept, (sum(t) - sum(u))::bigint as duplicates_removed, sum(t) / sum(u) as dedup_ratio, (sum(t) - sum(u)) / sum(t) as removal_rate, sum(u) / sum(t) as keep_rate from s")
def metrics_merged(spark, d):
    per = docs(spark, d).select("source", T.object_id(F.col("text")).alias("o")).groupBy("source").agg(F.count("*").alias("total_seen"), F.countDistinct("o").alias("unique_kept"))
    return dedup.merge_metrics(per)


@query("select substr(sha256(text), 1, 32) as object_id, min(doc_id) as leader, count(*) as refcount, any_value(strlen(text))::bigint as size_bytes from documents group by sha256(text)")
def object_table(spark, d):
    return dedup.objects(docs(spark, d).select("doc_id", "text"), DOC)


@query("select 'item_' || doc_id as key, substr(sha256(text), 1, 32) as object_id, doc_id as seq from documents")
def ref_mapping(spark, d):
    return dedup.references(docs(spark, d).select("doc_id", "text"), DOC)


def _normal(mode: Normalization, name: str) -> None:
    form = FORMS[mode]("text")

    def normalized(spark, d):
        form = docs(spark, d).select("doc_id", T.normalize(F.col("text"), mode).alias("form"))
        return form.select("doc_id", T.digest(F.col("form")).alias("digest"), F.length("form").cast("bigint").alias("chars"))

    def deduplicated(spark, d):
        return dedup.kept(docs(spark, d).select("doc_id", "text"), DedupConfig(normalization=mode)).select("doc_id", "object_id")

    normalized.__name__, deduplicated.__name__ = f"normalize_{name}", f"dedup_norm_{name}"
    query(f"select doc_id, sha256({form}) as digest, length({form}) as chars from documents")(normalized)
    query(f"select min(doc_id) as doc_id, substr(sha256({form}), 1, 32) as object_id from documents group by sha256({form})")(deduplicated)


for _m, _n in ((Normalization.WHITESPACE, "ws"), (Normalization.ASCII, "ascii"), (Normalization.UNICODE, "unicode")):
    _normal(_m, _n)


@query(f"select doc_id, sha256(case when strlen(text) <= 2000 then {FORMS[Normalization.ASCII]('text')} else text end) as digest from documents")
def normalize_max_bytes(spark, d):
    return docs(spark, d).select("doc_id", T.digest(T.normalize(F.col("text"), Normalization.ASCII, 2000)).alias("digest"))


@query(f"with {FLAGGED} select doc_id as original, row_number() over (order by doc_id) - 1 as position from flagged where n = 1")
def deduped_positions(spark, d):
    return dedup.positions(docs(spark, d).select("doc_id", "text"), DOC)


@query(f"with {FLAGGED} , p as (select doc_id as original, row_number() over (order by doc_id) - 1 as position from flagged where n = 1) select position // 100 as chunk, position, original from p")
def chunk_ids(spark, d):
    return dedup.chunks(docs(spark, d).select("doc_id", "text"), DOC, 100)


@query("select min(doc_id) as doc_id, (doc_id % 4)::int as shard, substr(sha256(text), 1, 32) as object_id from documents group by doc_id % 4, sha256(text)")
def shard_dedup(spark, d):
    return dedup.shards(docs(spark, d).select("doc_id", "text"), DOC, 4).select("doc_id", "shard", "object_id")


@query(f"select doc_id, source from documents where source = '{TEST_SOURCE}' union all select doc_id, source from documents where source <> '{TEST_SOURCE}' and text not in (select text from documents where source = '{TEST_SOURCE}')")
def cross_split_dedup(spark, d):
    df = docs(spark, d).select("doc_id", "source", "text")
    parts = dedup.cross_split({"train": df.where(F.col("source") == TEST_SOURCE), "rest": df.where(F.col("source") != TEST_SOURCE)}, DOC)
    return parts["train"].unionByName(parts["rest"]).select("doc_id", "source")


LANGS = ("en", "de", "fr", "es")
_ORDER = "list_position(['en', 'de', 'fr', 'es'], lang)"


@query(f'select lang as dataset, doc_id as "order", substr(sha256(text), 1, 32) as object_id, row_number() over (partition by sha256(text) order by {_ORDER}, doc_id) > 1 as is_duplicate from documents where {_ORDER} > 0')
def cross_dataset_dedup(spark, d):
    df = docs(spark, d).select("doc_id", "lang", "text")
    return dedup.cross_dataset({x: df.where(F.col("lang") == x) for x in LANGS}, DOC)


@query("select lang, list(doc_id order by doc_id) as doc_id from documents group by lang")
def collate_batches(spark, d):
    return dedup.collate(docs(spark, d).select("doc_id", "lang"), F.col("lang")).select(F.col("batch").alias("lang"), "doc_id")


@query("select doc_id, sha256(coalesce(lang, '') || ' | ' || coalesce(source, '') || ' | ' || coalesce(text, '')) as digest from documents")
def extract_multi_column(spark, d):
    return docs(spark, d).select("doc_id", T.digest(T.extract_text(["lang", "source", "text"], " | ")).alias("digest"))


# the store over an operation log


def log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.struct("ts", "event_id").alias("seq"), "ts", F.col("user_id").cast("string").alias("key"), F.when(F.col("event_type") != "error", F.col("props")).alias("value"))


LOG = """log as (select user_id::varchar as key, ts, event_id, case when event_type <> 'error' then props end as value from events),
ch as (select *, lag(value) over (partition by key order by ts, event_id) as previous from log),
d as (select ts, event_id, value, 1 as delta from ch where value is not null and value is distinct from previous
  union all select ts, event_id, previous, -1 from ch where previous is not null and previous is distinct from value),
c as (select *, sum(delta) over (partition by value order by ts, event_id rows unbounded preceding) as rc from d),
l as (select *, sum(case when delta = 1 and rc = 1 then 1 else 0 end) over (partition by value order by ts, event_id rows unbounded preceding) as incarnation from c),
inc as (select value, incarnation::bigint as incarnation, arg_min(event_id, (ts, event_id)) as created_event, arg_min(ts, (ts, event_id)) as created_at, sum(delta)::bigint as "references",
  arg_max(event_id, (ts, event_id)) filter (where delta = -1 and rc = 0) as died_event from l group by value, incarnation),
refs as (select key, arg_max(value, (ts, event_id)) filter (where true) as v, max((ts, event_id)) as m from log group by key),
lastrow as (select key, value, event_id from (select *, row_number() over (partition by key order by ts desc, event_id desc) as n from log) where n = 1 and value is not null),
objs as (select substr(sha256(value), 1, 32) as object_id, value, strlen(value)::bigint as size_bytes, "references" as refcount, created_at from inc
  qualify incarnation = max(incarnation) over (partition by value) and "references" > 0),
acc as (select substr(sha256(props), 1, 32) as object_id, max(ts) as seen from events where event_type <> 'error' group by all),
live as (select o.*, greatest(o.created_at, coalesce(a.seen, o.created_at)) as last_accessed from objs o left join acc a using (object_id))
"""


@query(f"with {LOG} select key, value, event_id from lastrow")
def oplog_final_state(spark, d):
    return store.references(log(spark, d)).select("key", "value", F.col("seq.event_id").alias("event_id"))


@query(f"with {LOG} select object_id, value, size_bytes, refcount, created_at from objs")
def oplog_objects(spark, d):
    return store.objects(log(spark, d)).drop("last_accessed")


@query(f"with {LOG} select value, sum(delta)::bigint as refcount from d group by value")
def oplog_refcounts(spark, d):
    return store.deltas(log(spark, d)).groupBy("value").agg(F.sum("delta").alias("refcount"))


@query(f"with {LOG} select * from inc")
def oplog_incarnations(spark, d):
    return store.incarnations(log(spark, d)).select("value", "incarnation", F.col("created_seq.event_id").alias("created_event"), "created_at", "references", F.col("died_seq.event_id").alias("died_event"))


@query("with log as (select user_id::varchar as key, ts, event_id, case when event_type <> 'error' then props end as value from events) select key, value, event_id from (select *, lag(value) over (partition by key order by ts, event_id) as previous from log) where value = previous")
def noop_overwrites(spark, d):
    return store.noop_overwrites(log(spark, d)).select("key", "value", F.col("seq.event_id").alias("event_id"))


@query("with log as (select ts, event_id, case when event_type <> 'error' then props end as value from events) select value, min(ts) as created_at from log where value is not null group by value")
def oplog_without_gc(spark, d):
    return store.objects(log(spark, d), enable_gc=False).select("value", "created_at")


def _objects(spark: SparkSession, d: str) -> DataFrame:
    reads = log(spark, d).where("value is not null").select(T.object_id(F.col("value")).alias("object_id"), "ts")
    return store.touch(store.objects(log(spark, d)), reads, 0)


def _now():
    return F.lit(NOW).cast("timestamp")


def _refs(spark: SparkSession, d: str) -> DataFrame:
    return store.Store(log(spark, d)).refs


@query(f"with {LOG} select object_id, last_accessed from live")
def lru_touch_fold(spark, d):
    return _objects(spark, d).select("object_id", "last_accessed")


@query(f"""with recursive {LOG}, reads as (select distinct substr(sha256(value), 1, 32) as object_id, ts from log where value is not null),
recorded(object_id, last) as (select object_id, created_at from objs union select r.object_id, min(x.ts) from recorded r join reads x on x.object_id = r.object_id and x.ts >= r.last + interval 3600 seconds group by r.object_id, r.last)
select object_id, max(last) as last_accessed from recorded group by object_id""")
def lru_touch_throttled(spark, d):
    """Reads within an hour of the last recorded one are not recorded: a fold in time order."""
    reads = log(spark, d).where("value is not null").select(T.object_id(F.col("value")).alias("object_id"), "ts")
    return store.touch(store.objects(log(spark, d)), reads, 3600).select("object_id", "last_accessed")


_AGE = "epoch(timestamp '" + NOW + "') - epoch({0})"


@query(f"with {LOG} select l.key, o.value from (select distinct user_id::varchar as key from events) l left join lastrow r using (key) left join objs o on o.value = r.value")
def get_join(spark, d):
    keys = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key")).distinct()
    return store.get(store.references(log(spark, d)), store.objects(log(spark, d)), keys, _now())


@query(f"with {LOG} select k.key, o.value is not null as present from (select distinct user_id::varchar as key from events) k left join lastrow r using (key) left join objs o on o.value = r.value and {_AGE.format('o.created_at')} <= {TTL}")
def contains(spark, d):
    keys = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key")).distinct()
    return store.contains(store.references(log(spark, d)), store.objects(log(spark, d)), keys, _now(), TTL)


@query("select c_name as key from customer where c_name like 'Customer#00000%' order by 1 limit 25")
def list_keys_prefix_limit(spark, d):
    return store.list_keys(table(spark, d, "customer").select(F.col("c_name").alias("key")), "Customer#00000", 25)


@query(f"with {LOG} select (select count(*) from lastrow) as keys, count(*) filter (where refcount > 0) as unique_values, sum(size_bytes)::bigint as total_bytes from objs")
def store_counts(spark, d):
    return store.counts(_refs(spark, d), store.objects(log(spark, d)))


@query(f"""with {LOG} select (select count(*) from lastrow) as total_keys, count(*) as total_objects, sum(size_bytes)::bigint as total_bytes, count(*) filter (where {_AGE.format('created_at')} > {TTL}) as expired_objects,
    count(*) filter (where refcount = 0) as orphaned_objects, max(floor({_AGE.format('created_at')}))::bigint as oldest_object_age_s, min(floor({_AGE.format('last_accessed')}))::bigint as newest_access_age_s, (select count(*) from lastrow) / count(*) as dedup_ratio from live""")
def health(spark, d):
    return store.health(_refs(spark, d), _objects(spark, d), _now(), TTL)


@query(f"with {LOG} select object_id, created_at from objs where not ({_AGE.format('created_at')} > {TTL})")
def ttl_live(spark, d):
    return store.objects(log(spark, d)).where(~store.expired(_now(), TTL)).select("object_id", "created_at")


@query(f"with {LOG} select object_id from objs where refcount = 0 or {_AGE.format('created_at')} > {TTL}")
def sweep(spark, d):
    return retention.sweep(store.objects(log(spark, d)), _now(), TTL).select("object_id")


@query(f"with {LOG} select object_id from live where {_AGE.format('created_at')} > {AGE} or {_AGE.format('last_accessed')} > {IDLE}")
def prune(spark, d):
    return retention.prune(_objects(spark, d), _now(), AGE, IDLE).select("object_id")


@query(f"with {LOG} select object_id, size_bytes from (select *, sum(size_bytes) over () as total, sum(size_bytes) over (order by last_accessed, object_id rows unbounded preceding) - size_bytes as before from live) where total - before > {TARGET}")
def evict_lru(spark, d):
    return retention.evict_lru(_objects(spark, d), TARGET).select("object_id", "size_bytes")


@query(f"with {LOG} select r.key from lastrow r join live o on r.value = o.value where not ({_AGE.format('created_at')} > {AGE} or {_AGE.format('last_accessed')} > {IDLE})")
def cascade_after_prune(spark, d):
    objs = _objects(spark, d)
    return retention.cascade(_refs(spark, d), objs, retention.prune(objs, _now(), AGE, IDLE))[0].select("key")


@query(f"with {LOG} select r.key from lastrow r left join (select * from live where not ({_AGE.format('created_at')} > {AGE} or {_AGE.format('last_accessed')} > {IDLE})) o on r.value = o.value where o.value is null")
def dangling_keys(spark, d):
    objs = _objects(spark, d)
    left = objs.join(retention.prune(objs, _now(), AGE, IDLE).select("object_id"), "object_id", "left_anti")
    return store.dangling_keys(_refs(spark, d), left)


@query()
def approx_unique(spark, d):
    return store.approximate_counts(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", "l_suppkey")


@query(f"with {LOG} select a.key as key1, b.key as key2, a.value = b.value as same from lastrow a join lastrow b on b.key = (a.key::bigint + 1)::varchar")
def is_duplicate_of(spark, d):
    """Each user's key against the next user's."""
    users = table(spark, d, "events").select("user_id").distinct()
    return store.same_objects(_refs(spark, d), users.select(F.col("user_id").cast("string").alias("key1"), (F.col("user_id") + 1).cast("string").alias("key2")))


# contamination

_TEST, _TRAIN = f"(select * from documents where source = '{TEST_SOURCE}')", f"(select * from documents where source <> '{TEST_SOURCE}')"


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    df = docs(spark, d).select("doc_id", "source", "text")
    return df.where(F.col("source") != TEST_SOURCE), df.where(F.col("source") == TEST_SOURCE)


@query(f"select doc_id, source from {_TRAIN} where text in (select text from {_TEST})")
def contamination_exact(spark, d):
    return contamination.detect(*_split(spark, d), DOC).select("doc_id", "source")


@query(f"select doc_id from {_TRAIN} where text not in (select text from {_TEST})")
def filter_contaminated(spark, d):
    return contamination.clean(*_split(spark, d), DOC).select("doc_id")


_RATE = f"select count(*) filter (where text in (select text from {_TEST})) as contaminated, count(*) as total, (select count(*) from {_TEST}) as reference_count from {_TRAIN}"


@query(f"with r as ({_RATE}) select *, contaminated / total as rate, case when contaminated / total < 0.001 then 'none' when contaminated / total < 0.01 then 'low' when contaminated / total < 0.05 then 'medium' else 'high' end as severity from r")
def contamination_rate(spark, d):
    return contamination.rate(*_split(spark, d), DOC)


@query("with s as (select doc_id % 5 as fold, text from documents) select fold::int as fold, count(*) as test_rows, count(*) filter (where exists (select 1 from s o where o.text = s.text and o.fold <> s.fold)) as leaked from s group by fold")
def cv_fold_leakage(spark, d):
    return contamination.fold_leakage(docs(spark, d).select("doc_id", "text"), DOC)


@query("select doc_id from documents d where exists (select 1 from benchmark b where b.text = d.text)")
def benchmark_exact_overlap(spark, d):
    return contamination.detect(docs(spark, d).select("doc_id", "text"), table(spark, d, "benchmark").select("text"), DOC).select("doc_id")


# similarity

_PAIRS = "p as (select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cos from embeddings a join embeddings b on a.vec_id < b.vec_id)"
_LEADERS = f"""{_PAIRS}, nb as (select v.vec_id, row_number() over (order by v.vec_id) as k, coalesce(x.nb, []) as nb from embeddings v left join (select b, list(a) as nb from p where cos >= {LOW} group by b) x on x.b = v.vec_id),
run(k, leaders) as (select 0::bigint, []::bigint[] union all select nb.k, case when list_has_any(leaders, nb.nb) then leaders else list_append(leaders, nb.vec_id) end from run join nb on nb.k = run.k + 1),
final as (select unnest(leaders) as leader from (select leaders from run order by k desc limit 1))"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


@query(f"with {_PAIRS} select * from p where cos >= {LOW}")
def cosine_pairs(spark, d):
    return similarity.pairs(vectors(spark, d), LOW)


@query("select * from (select *, row_number() over (partition by a order by cos desc, b)::int as rank from (select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cos from embeddings a join embeddings b on a.vec_id <> b.vec_id)) where rank <= 5")
def knn_topk(spark, d):
    return similarity.knn(vectors(spark, d), 5)


@query(f"with recursive {_LEADERS} select leader from final")
def leader_dedup(spark, d):
    v = vectors(spark, d)
    return v.join(similarity.duplicates(v, LOW), F.col("vec_id") == F.col("item"), "left_anti").select(F.col("vec_id").alias("leader"))


@query(f"""with recursive {_LEADERS}, best as (select b, arg_max(a, (cos, -a)) as leader, max(cos) as cos from p where cos >= {LOW} and a in (select leader from final) and b not in (select leader from final) group by b)
select v.vec_id as item, coalesce(best.leader, v.vec_id) as leader, coalesce(best.cos, 1.0)::double as cos, best.b is not null as is_duplicate from embeddings v left join best on best.b = v.vec_id""")
def leader_assignment(spark, d):
    return similarity.nearest_leaders(vectors(spark, d), LOW)


@query(f"""with recursive {_LEADERS}, best as (select b, arg_max(a, (cos, -a)) as leader, max(cos) as cos from p where cos >= {LOW} and a in (select leader from final) and b not in (select leader from final) group by b)
select v.vec_id, coalesce(best.leader, v.vec_id) as original, substr(sha256(coalesce(best.leader, v.vec_id)::varchar), 1, 32) as object_id, coalesce(best.cos, 1.0)::double as cos, best.b is not null as is_duplicate from embeddings v left join best on best.b = v.vec_id""")
def semantic_dedup(spark, d):
    """Semantic mode in one call: what the mapping says."""
    return dedup.deduplicate(vectors(spark, d), SEMANTIC).mapping.drop("by")


@query()
def semantic_gates(spark, d):
    """Semantic mode with reranker, margin, reciprocity and judge together, on the texts of the same ids."""
    v = vectors(spark, d).join(docs(spark, d).select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    cfg = replace(SEMANTIC, semantic_threshold=HIGH, judge=True, judge_threshold=LOW, margin=True, margin_threshold=0.01, rnn=True, rnn_k=10, reranker=True, reranker_threshold=0.85, search_floor=LOW - 0.1)
    return dedup.deduplicate(v, cfg, reranker=similarity.length_reranker, judge=lambda a, b: similarity.length_ratio(a, b) >= 0.8).mapping


@query(f"select b.vec_id as item, arg_max(a.vec_id, (round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6), -a.vec_id)) as match, max(round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6)) as cos from embeddings a join embeddings b on a.label < 5 and b.label >= 5 where round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) >= {HIGH} group by b.vec_id")
def semantic_contamination(spark, d):
    target, ref = _sides(spark, d)
    return contamination.Detector(CrossDatasetConfig(SEMANTIC, HIGH)).build(ref).matches(target)


@query()
def lsh_cosine_pairs(spark, d):
    return similarity.lsh_pairs(vectors(spark, d), HIGH)


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = vectors(spark, d)
    return v.where("label >= 5"), v.where("label < 5")


_SIMS = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"
_GATE = f"""x as (select a.vec_id as a, b.vec_id as b, round({_SIMS}, 6) as cos from embeddings a, embeddings b where a.label >= 5 and b.label < 5),
inn as (select a.vec_id as a, b.vec_id as b, round({_SIMS}, 6) as cos from embeddings a, embeddings b where a.label < 5 and b.label < 5 and a.vec_id <> b.vec_id),
ranked as (select *, row_number() over w as rn, coalesce(lead(cos) over w, 0) as second from x where cos >= {LOW} window w as (partition by a order by cos desc, b)),
own as (select *, row_number() over (partition by a order by cos desc, b) as rn from inn)"""


@query(f"with {_GATE} select r.a, r.b, r.cos, r.second::double as second, coalesce(o.cos, 0)::double as b_second, round(r.cos - r.second, 6) >= 0.05 and round(r.cos - coalesce(o.cos, 0), 6) >= 0.05 as accepted from ranked r left join own o on o.a = r.b and o.rn = 2 where r.rn = 1")
def margin_gate(spark, d):
    target, ref = _sides(spark, d)
    return similarity.margin_gate(similarity.cross_pairs(target, ref, LOW), similarity.knn(ref, 2), 0.05)


@query(f"with {_GATE}, kth as (select a, min(cos) as kth from own where rn <= 10 group by a) select r.a, r.b, r.cos, k.kth, coalesce(r.cos >= k.kth, true) as accepted from ranked r left join kth k on k.a = r.b where r.rn = 1")
def rnn_gate(spark, d):
    target, ref = _sides(spark, d)
    return similarity.rnn_gate(similarity.cross_pairs(target, ref, LOW), similarity.knn(ref, 10), 10)


@query(f"""with {_GATE} select x.a, x.b, x.cos, case when x.cos >= {HIGH} then true else least(length(p.text), length(q.text)) / greatest(length(p.text), length(q.text), 1) >= 0.8 end as accepted
    from x join documents p on p.doc_id = x.a join documents q on q.doc_id = x.b where x.cos >= {LOW}""")
def gray_zone_judge(spark, d):
    n = docs(spark, d).select(F.col("doc_id").alias("vec_id"), F.length("text").alias("n"))
    target, ref = (x.join(n, "vec_id") for x in _sides(spark, d))  # the judge sees lengths only, so these go with the vectors
    s = similarity.valued_pairs(target, ref, LOW, "n")
    return similarity.gray_zone(s, LOW, HIGH, similarity.share(F.col("wa"), F.col("wb")) >= 0.8).select("a", "b", "cos", "accepted")


@query(f"""with {_GATE}, s as (select r.a, r.b, r.rn, greatest(0.0, 0.9 - 0.01 * abs(length(p.text) - length(q.text)))::double as score from ranked r join documents p on p.doc_id = r.a join documents q on q.doc_id = r.b where r.rn <= 100)
    select a, b, round(score, 6) as score from s qualify row_number() over (partition by a order by score desc, rn) = 1 and score >= 0.1""")
def rerank_mock(spark, d):
    target, ref = _sides(spark, d)
    n = docs(spark, d).select("doc_id", F.length("text").alias("n"))
    s = similarity.foremost(similarity.cross_pairs(target, ref, LOW), 100)  # of all, with a text or without
    s = s.join(n.select(F.col("doc_id").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("doc_id").alias("b"), F.col("n").alias("nb")), "b")
    return similarity.rerank(s, similarity.shortfall(F.col("na"), F.col("nb")), 0.1, 100)


@query("select conv_id, turn, list_transform(range(16), lambda k: len(list_filter(w, lambda x: ('0x' || substr(md5(x), 1, 8))::bigint % 16 = k))::float) as embedding from (select conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^0-9a-z]+'), lambda x: x <> '') as w from conversations)")
def hashed_embeddings(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", V.hashed_counts(F.col("text"), 16).alias("embedding"))


@query("select a.vec_id as a, b.vec_id as b, round(sqrt(greatest(0, 2 - 2 * round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6))), 6) as distance from embeddings a join embeddings b on a.vec_id < b.vec_id where round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) >= 0.3")
def cosine_distances(spark, d):
    return similarity.pairs(vectors(spark, d), LOW).select("a", "b", F.round(V.cosine_to_distance(F.col("cos")), 6).alias("distance"))


# quality


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").join(docs(spark, d), "doc_id")


_CONF = "count(*) filter (where {p} and {t}) as tp, count(*) filter (where {p} and not {t}) as fp, count(*) filter (where not {p} and {t}) as fn, count(*) filter (where not {p} and not {t}) as tn"
_RATES = "case when tp + fp > 0 then tp / (tp + fp) else 0 end as precision, case when tp + fn > 0 then tp / (tp + fn) else 0 end as recall, case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end as f1, case when tp + fp + fn + tn > 0 then (tp + tn) / (tp + fp + fn + tn) else 0 end as accuracy, case when fp + tn > 0 then fp / (fp + tn) else 0 end as fpr"


@query(f"with c as (select lang, {_CONF.format(p='(quality = 0)', t='(toxic = 1)')} from labels join documents using (doc_id) group by lang) select *, {_RATES} from c")
def confusion_by_label(spark, d):
    return quality.confusion(labelled(spark, d), F.col("quality") == 0, F.col("toxic") == 1, ["lang"])


_POINTS = "unnest([" + ", ".join(f"{t}::double" for t in THRESHOLDS) + "])"


@query(f"with r as (select {_POINTS} as threshold, 1 - 1 / (1 + n_chars / 100) as s, toxic = 1 as t from labels join documents using (doc_id)), c as (select threshold, {_CONF.format(p='(s >= threshold)', t='t')} from r group by threshold) select *, {_RATES} from c")
def threshold_sweep(spark, d):
    return quality.sweep(labelled(spark, d), 1 - 1 / (1 + F.col("n_chars") / 100), F.col("toxic") == 1, list(THRESHOLDS))


@query(f"with r as (select {_POINTS} as threshold, 1 - 1 / (1 + n_chars / 100) as s, toxic = 1 as t from labels join documents using (doc_id)), c as (select threshold, {_CONF.format(p='(s >= threshold)', t='t')} from r group by threshold) select threshold, f1 from (select *, {_RATES} from c) order by f1 desc, threshold limit 1")
def best_f1(spark, d):
    return quality.best_f1(threshold_sweep(spark, d))


@query("select lang as label, count(*) as n, count(*) / (select count(*) from documents) as share from documents group by lang")
def class_distribution(spark, d):
    return quality.distribution(docs(spark, d), "lang")


_P = "select source, count(*) / sum(count(*)) over () as p from {0} group by source"
_DEDUPED = "(select * from documents qualify row_number() over (partition by sha256(text) order by doc_id) = 1)"


@query(f"with p as ({_P.format('documents')}), q as ({_P.format(_DEDUPED)}) select round(greatest(0, sum(p.p * ln(p.p / coalesce(q.p, 1e-10)))), 10) as kl from p left join q using (source) where p.p > 1e-10")
def kl_divergence(spark, d):
    df = docs(spark, d).select("doc_id", "text", "source")
    return quality.kl_divergence(df, dedup.kept(df, DOC), "source").select(F.round("kl", 10).alias("kl"))


@query(f"with b as (select source as label, count(*) as before from documents group by source), a as (select source as label, count(*) as after from {_DEDUPED} group by source) select label, before, coalesce(after, 0) as after, coalesce(after, 0) / before as retention from b left join a using (label) where before < 0.1 * (select count(*) from documents)")
def minority_retention(spark, d):
    df = docs(spark, d).select("doc_id", "text", "source")
    return quality.minority_retention(df, dedup.kept(df, DOC), "source")


@query("select event_type, count(value) as n, round(avg(value), 6) as mean, round(coalesce(stddev_samp(value), 0), 6) as std from events group by event_type")
def ci_stats(spark, d):
    return quality.spread(table(spark, d, "events"), F.col("value"), ["event_type"]).select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query()
def ci_intervals(spark, d):
    return quality.intervals(quality.spread(table(spark, d, "events"), F.col("value"), ["event_type"]))


@query("""with g as (select count(*) filter (where toxic = 0) as na, count(*) filter (where toxic = 1) as nb, avg(n_chars) filter (where toxic = 0) as ma, avg(n_chars) filter (where toxic = 1) as mb, var_samp(n_chars) filter (where toxic = 0) as va, var_samp(n_chars) filter (where toxic = 1) as vb from labels join documents using (doc_id)),
    x as (select (mb - ma) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) as d from g) select round(d, 6) as d, case when abs(d) < 0.2 then 'negligible' when abs(d) < 0.5 then 'small' when abs(d) < 0.8 then 'medium' else 'large' end as band from x""")
def cohens_d(spark, d):
    return quality.cohens_d(labelled(spark, d), F.col("n_chars"), F.col("toxic") == 1).select(F.round("d", 6).alias("d"), "band")


@query("select round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99 from events")
def percentiles(spark, d):
    p = quality.percentiles(table(spark, d, "events"), F.col("value"))
    return p.select(*(F.round(c, 6).alias(c) for c in p.columns))


_LE = "unnest([0.5, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0, 10000.0])"


@query(f"select b::double::varchar as le, (select count(*) from events where value <= b) as n from (select {_LE} as b) union all select '+Inf', count(value) from events")
def histogram_buckets(spark, d):
    return quality.histogram(table(spark, d, "events"), F.col("value"))


@query("with s as (select source, count(*) / count(distinct text) as f1, quantile_cont(n_chars, 0.95) as p95 from documents group by source), b as (select count(*) / count(distinct text) as base_f1, quantile_cont(n_chars, 0.95) as base_p95 from documents) select source, round(f1 / base_f1 - 1, 6) as f1_change, round(p95 / base_p95 - 1, 6) as p95_change, case when f1 / base_f1 - 1 < -0.05 or p95 / base_p95 - 1 > 0.05 then 'regression' when f1 / base_f1 - 1 > 0.01 then 'improvement' else 'same' end as verdict from s, b")
def report_comparison(spark, d):
    df = docs(spark, d).select("source", T.object_id(F.col("text")).alias("o"), "n_chars")
    one = lambda *by: df.groupBy(*by).agg((F.count("*") / F.countDistinct("o")).alias("f1"), F.percentile("n_chars", F.lit(0.95)).alias("p95"))
    base = df.select("source").distinct().crossJoin(one())
    return quality.compare(one("source"), base, ["source"]).select("source", F.round("f1_change", 6).alias("f1_change"), F.round("p95_change", 6).alias("p95_change"), "verdict")


@query("with pairs as (select a.doc_id as x, b.doc_id as y from documents a join documents b on a.n_chars = b.n_chars and a.lang = b.lang and a.doc_id < b.doc_id), c as (select " + _CONF.format(p="(p.text = q.text)", t="(p.source = q.source)") + " from pairs join documents p on p.doc_id = x join documents q on q.doc_id = y) select *, " + _RATES + " from c")
def pair_evaluation(spark, d):
    df = docs(spark, d)
    n = df.select("doc_id", "lang", "n_chars", "source")
    b = n.select(F.col("doc_id").alias("key2"), "lang", "n_chars", F.col("source").alias("s2"))
    p = n.withColumnRenamed("doc_id", "key1").join(b, ["lang", "n_chars"]).where("key1 < key2").select("key1", "key2", (F.col("source") == F.col("s2")).alias("is_duplicate"))
    return quality.pair_evaluation(df.select(F.col("doc_id").alias("key"), T.object_id(F.col("text")).alias("object_id")), p)


# scalar functions


@query("select doc_id, sha256(text) as sha256, substr(sha256(text), 1, 16) as short, substr(md5(text), 1, 8) as grp from documents")
def hash_text(spark, d):
    t = F.col("text")
    return docs(spark, d).select("doc_id", T.digest(t).alias("sha256"), T.short_digest(t).alias("short"), T.group_digest(t).alias("grp"))


@query("with s as (select count(*) as n, floor(avg(n_chars))::bigint as l from documents) select n * l as text_bytes, n * 30 as key_bytes, n * 16 as object_id_bytes, 0::bigint as hash_bytes, n * 384 * 4 as embedding_bytes, n * 100 as hnsw_bytes, n * l + n * 30 + n * 16 + n * 384 * 4 + n * 100 as total_bytes from s")
def memory_estimate(spark, d):
    s = docs(spark, d).agg(F.count("*").alias("n"), F.floor(F.avg("n_chars")).alias("l"))
    return s.select(*(c.cast("bigint").alias(k) for k, c in T.memory_estimate(F.col("n"), F.col("l"), "semantic").items()))


@query("select page_id, 'proxy:POST:' || url || ':body=' || sha256(html) || ':vary=accept=text/html;' as key from pages where html <> ''")
def proxy_cache_key(spark, d):
    return table(spark, d, "pages").where("html <> ''").select("page_id", T.proxy_key(F.lit("POST"), F.col("url"), body=F.col("html"), vary={"accept": F.lit("text/html")}).alias("key"))


@query("select page_id, 200 as status_code, html as body from pages")
def cached_response_round_trip(spark, d):
    h = F.array(F.struct(F.lit("content-type").alias("name"), F.lit("text/html").alias("value")))
    j = T.response_json(F.lit(200), h, F.col("html"), F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))
    x = table(spark, d, "pages").select("page_id", T.response_parts(j).alias("r"))
    return x.select("page_id", "r.status_code", F.col("r.body").cast("string").alias("body"))


@query("select conv_id, turn, sha256('Represent this sentence for searching relevant passages: ' || text) as digest from conversations")
def instruction_prefix(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.digest(T.instructed(F.col("text"), "bge")).alias("digest"))


@query("select event_id, round(1 / (1 + exp(-value / 100)), 9) as p from events")
def sigmoid_scores(spark, d):
    return table(spark, d, "events").select("event_id", F.round(V.sigmoid(F.col("value") / 100), 9).alias("p"))


@query("with r as (select event_id, (event_id % 9)::int as s, event_type from events) select event_id, s >= 5 as is_duplicate, s as score, case when s >= 4 then (s - 3) / 4.0 else (4 - s) / 4.0 end::double as confidence from r")
def judge_verdicts(spark, d):
    s = F.pmod(F.col("event_id"), F.lit(9)).cast("string")
    answer = F.concat(F.lit("[REASONING]: for "), F.col("event_type"), F.lit("\n[SCORE]: "), s, F.lit("\n[DUPLICATE]: no"))
    x = table(spark, d, "events").select("event_id", T.judge_verdict(answer).alias("v"))
    return x.select("event_id", "v.is_duplicate", "v.score", "v.confidence")


@query("select event_id, case when floor(value)::int < 300 then 'ok' when floor(value)::int = 404 then 'not_found' when floor(value)::int = 400 then 'invalid_argument' when floor(value)::int = 504 then 'timed_out' when floor(value)::int = 503 then 'busy' else 'error' end as kind from events")
def status_labels(spark, d):
    return table(spark, d, "events").select("event_id", T.status_kind(F.floor("value").cast("int")).alias("kind"))


@query("with c as (select 'emb:bge:' || substr(sha256(text), 1, 16) as key from benchmark) select doc_id, 'emb:bge:' || substr(sha256(text), 1, 16) as key, 'emb:bge:' || substr(sha256(text), 1, 16) in (select key from c) as hit from documents")
def embedding_cache_lookup(spark, d):
    cache = table(spark, d, "benchmark").select(embedding_cache_key("bge", F.col("text")).alias("key"), F.lit(1).alias("embedding")).distinct()
    return with_cached_embeddings(docs(spark, d).select("doc_id", "text"), cache, "bge").select("doc_id", "key", F.col("embedding").isNotNull().alias("hit"))


# synthetic sets, sampling and models


@query()
def synthetic_dedup(spark, d):
    """Confusion of exact deduplication on a synthetic set with known duplicates, as large as the documents table."""
    made = synthetic.paraphrases(spark, docs(spark, d).count()).withColumnRenamed("is_duplicate", "known")  # flag() has an is_duplicate of its own
    return quality.confusion(dedup.flag(made, DedupConfig(order_column="idx")), F.col("is_duplicate"), F.col("known"))


@query("select lang, count(*) as count from documents where ('0x' || substr(md5('42|' || coalesce(lang, '') || '|' || doc_id), 1, 8))::bigint % 1000000 < 200000 group by lang")
def stratified_sampling(spark, d):
    return stratified_sample(docs(spark, d), "lang", "doc_id", 0.2).groupBy("lang").count()


@query()
def model_accuracy(spark, d):
    """Accuracy of a language classifier, on whole tables, before and after deduplication of its training rows."""
    df = docs(spark, d).select("doc_id", "text", F.col("lang").alias("label"), "source")
    train, test = df.where(F.col("source") != TEST_SOURCE), df.where(F.col("source") == TEST_SOURCE)
    raw = models.train_test_gap(train, test, features=1024, iterations=10).withColumn("training", F.lit("raw"))
    return raw.unionByName(models.train_test_gap(dedup.kept(train, DOC), test, features=1024, iterations=10).withColumn("training", F.lit("deduplicated")))


@query("select count(distinct text) as kept from documents")
def stream_dedup(spark, d):
    """The documents as a stream that is read to its end, deduplicated with state; the kept rows are counted from what was written."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    whole = docs(spark, d)
    stream = source(spark, f"{d}/documents.parquet", whole.schema).select("doc_id", "text")
    run_to_table(distinct(stream, DOC).select("doc_id", "object_id"), f"{at}/rows", f"{at}/state")
    return spark.read.schema("doc_id bigint, object_id string").parquet(f"{at}/rows").agg(F.count("*").alias("kept"))
