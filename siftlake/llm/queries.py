"""The operators as queries over their whole tables. Spark runs each with (spark, sf_dir); `ORACLE` has SQL where SQL can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, langid, license_scan, ngram_join, pii, secret_scan, token_store, topk, toxicity, viterbi
from .textkit import table


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), every=20)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.encode(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.identify(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_store, op2_language_id, op3_exact_topk, op4_secret_scan, op5_license_scan, op6_sentencepiece, op7_toxicity, op8_ngram_jaccard_join, op9_decontamination, op10_pii)}
_M, _K0, _K1, _K2 = 0xFFFFFFFF, 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D


def _step(before: str) -> str:
    """The hash of one more character."""
    x = f"((xor({before}, (u * {_K0}) & {_M}) * {_K1}) & {_M})"
    return f"xor({x}, {x} >> 15)"


def _bucket(h: str, k: int) -> str:
    return f"((((({h} * {_K2}) & {_M}) + {k}) & {_M}) * {_K0} & {_M}) >> {32 - langid.BITS}"


ORACLE: dict[str, str] = {
    # all rows are training rows here, as for any table of at most langid.TRAIN_ROWS
    "op2_language_id": f"""
        with ch as (select doc_id, lang, unnest(c) as c, generate_subscripts(c, 1) as i from (select doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '(?s).') as c from documents)),
        l as (select doc_id, lang, i, unicode(c)::ubigint as u, unicode(c) between 97 and 122 or (unicode(c) >= 170 and unicode(c) not in (215, 247) and not unicode(c) between 8192 and 8303) as ok from ch),
        p as (select *, lag(ok) over (partition by doc_id order by i) as before, max(ok) over (partition by doc_id) as lettered from l),
        kept as (select doc_id, lang, i, case when ok then u else 32::ubigint end as u from p where lettered and (before is null or ok or before)),
        h1 as (select *, {_step("0::ubigint")} as a from kept),
        l1 as (select *, lag(a) over (partition by doc_id order by i) as a1 from h1),
        h2 as (select *, {_step("a1")} as b from l1),
        l2 as (select *, lag(b) over (partition by doc_id order by i) as b1 from h2),
        h3 as (select *, {_step("b1")} as c from l2),
        grams as (
            select doc_id, lang, {_bucket("a", 1)} as g from h3 union all select doc_id, lang, {_bucket("b", 2)} from h3 where b is not null
            union all select doc_id, lang, {_bucket("c", 3)} from h3 where c is not null),
        counts as (select lang, g, count(*) as n from grams where lang is not null group by lang, g),
        langs as (select lang, ln(count(*) / sum(count(*)) over ()) as prior from documents where lang is not null and text is not null group by lang),
        totals as (select lang, ln(coalesce(sum(n), 0) + {langid.ALPHA * (1 << langid.BITS)}) as total from langs left join counts using (lang) group by lang),
        own as (select doc_id, g, count(*) as n from grams group by doc_id, g),
        scores as (
            select o.doc_id, t.lang, sum(o.n) as n, any_value(l.prior) + sum(o.n * (ln(coalesce(c.n, 0) + {langid.ALPHA}) - t.total)) as s
            from own o cross join totals t join langs l on l.lang = t.lang left join counts c on c.lang = t.lang and c.g = o.g group by o.doc_id, t.lang),
        best as (select doc_id, arg_max(lang, s) as lang, max(s) as s, list(s order by s desc) as ss, any_value(n) as n from scores group by doc_id)
        select d.doc_id, coalesce(b.lang, 'und') as lang, round(coalesce(1 / list_sum(list_transform(ss, lambda x: exp(x - b.s))), 0), 6) as confidence,
            round(coalesce(case when len(ss) > 1 then (ss[1] - ss[2]) / n else 0 end, 0), 6) as margin
        from documents d left join best b using (doc_id)""",
    "op3_exact_topk": """
        with pairs as (
            select a.vec_id, b.vec_id as neighbour, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) as product
            from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
        ranked as (select *, row_number() over (partition by vec_id order by product desc, neighbour) as rank from pairs)
        select vec_id, neighbour, product, rank::int as rank from ranked where rank <= 10""",
    "op8_ngram_jaccard_join": r"""
        with recursive words as (select doc_id, regexp_extract_all(lower(text), '(?:[0-9a-z_]|[^\x00-\x7F])+') as w from documents where doc_id is not null and text is not null),
        grams as (
            select doc_id, list_sort(list_distinct(case when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end)) as g
            from words where len(w) > 0),
        known as (select distinct doc_id, g from grams),
        sets as (select g, min(doc_id) as rep, count(*) as copies, len(any_value(g)) as m, row_number() over (order by min(doc_id), g) as s from known group by g),
        tokens as (select s, m, copies, unnest(g) as token from sets),
        pairs as (select a.s as a, b.s as b, any_value(b.copies) as n from tokens a join tokens b on a.token = b.token and a.s <> b.s group by a.s, b.s having count(*)::double / (any_value(a.m) + any_value(b.m) - count(*)) >= 0.5),
        reach as (select a as s, b as t from pairs union select reach.s, pairs.b from reach join pairs on reach.t = pairs.a),
        class as (select reach.s, min(rep) as least from reach join sets on sets.s = reach.t group by reach.s),
        linked as (select a as s, sum(n) as n from pairs group by a)
        select d.doc_id, case when s.s is null then d.doc_id else least(s.rep, coalesce(c.least, s.rep)) end as class_id, (coalesce(s.copies, 1) - 1 + coalesce(l.n, 0))::bigint as links
        from (select distinct doc_id, g from documents left join grams using (doc_id) where doc_id is not null) d left join sets s on s.g = d.g left join class c on c.s = s.s left join linked l on l.s = s.s""",
}
