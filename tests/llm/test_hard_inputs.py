"""Results over whole tables and of hard inputs, against brute force."""

import random
import string
import time

import numpy as np
import pytest

import corpus_pipeline
from siftlake.llm import decontam, langid, license_scan, ngram_join, pii, secret_scan, textkit, toxicity, viterbi
from siftlake.llm.queries import ORACLE, QUERIES

from .test_operators import ODD, WORD, copies, frame, jaccard_truth, prose


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_queries_without_sql_run_over_their_tables(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir)
    n, docs = rows.count(), textkit.table(spark, sf_dir, "documents").count()
    assert n == docs if name in ("op6_sentencepiece", "op7_toxicity") else n > 0 or name == "op4_secret_scan"  # the small table holds no secret


def test_the_pipeline_equals_its_stages(spark, sf_dir):
    docs = textkit.table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(out.collect(), out.schema)
    key = lambda r: (r.doc_id, list(r.ids))
    assert sorted(map(key, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(key, docs.collect()))


# 8


def classes_truth(texts, ids, threshold):
    """By (id, set): the least id of the component, and the number of partners."""
    nodes = sorted({(i, frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) or frozenset([tuple(w)]) if (w := WORD.findall((t or "").lower())) else frozenset()) for i, t in zip(ids, texts) if i is not None}, key=lambda x: (x[0], len(x[1])))
    par, links = list(range(len(nodes))), [0] * len(nodes)

    def root(x):
        while par[x] != x:
            x = par[x]
        return x

    for x in range(len(nodes)):
        for y in range(x):
            a, b = nodes[x][1], nodes[y][1]
            if a and b and len(a & b) / len(a | b) >= threshold:
                links[x], links[y] = links[x] + 1, links[y] + 1
                p, q = sorted((root(x), root(y)))
                par[q] = p
    return sorted((i, nodes[root(k)][0], links[k]) for k, (i, _) in enumerate(nodes))


@pytest.mark.parametrize("threshold,seed,group,flush", [(0.5, 1, 1024, 1 << 21), (0.5, 2, 3, 500), (0.8, 3, 2, 300), (0.3, 4, 1024, 1000)])
def test_classes_equal_brute_force(spark, monkeypatch, threshold, seed, group, flush):
    monkeypatch.setattr(ngram_join, "GROUP", group)
    monkeypatch.setattr(ngram_join, "FLUSH", flush)
    texts = copies(seed) + ["x x x", "x  x x", "rare words only here"]
    ids = [k // 2 if k % 7 == 0 else k for k in range(len(texts))]  # some ids are repeated, with other texts
    ids[4] = None
    got = sorted((r.doc_id, r.class_id, r.links) for r in ngram_join.classes(frame(spark, texts, ids), threshold=threshold).collect())
    assert got == classes_truth(texts, ids, threshold)


@pytest.mark.parametrize("seed,group", [(5, 1024), (6, 2)])
def test_classes_without_broadcasts_equal_brute_force(spark, monkeypatch, seed, group):
    """What is too many rows for a broadcast or for one task takes joins and steps instead."""
    monkeypatch.setattr(ngram_join, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(ngram_join, "GROUP", group)
    texts = copies(seed)
    got = sorted((r.doc_id, r.class_id, r.links) for r in ngram_join.classes(frame(spark, texts)).collect())
    assert got == classes_truth(texts, range(len(texts)), 0.5)


@pytest.mark.parametrize("most", [0, 8 << 20])
def test_components_of_random_edges(spark, monkeypatch, most):
    monkeypatch.setattr(ngram_join, "BROADCAST_BYTES", most)
    rng = random.Random(9)
    ids = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(300)]
    edges = [tuple(rng.sample(ids, 2)) for _ in range(160)] + list(zip(ids[:40], ids[1:41])) + [(ids[0], ids[0])]
    least = {i: i for e in edges for i in e}
    while any(least[a] != least[b] for a, b in edges):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = sorted((r.id, r.root) for r in ngram_join.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == sorted((i, x) for i, x in least.items() if i != x)


def test_the_join_has_few_exchanges(spark):
    """The driver keeps a thread for each exchange and broadcast of the last minute, which is memory that a small input takes too."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()

    def executions():
        bus.waitUntilEmpty(30_000)
        found = store.executionsList()
        return {found.apply(k).executionId() for k in range(found.size())}

    before = executions()
    assert ngram_join.keep_one(frame(spark, copies(5))).count()
    names = []
    for x in executions() - before:
        nodes = store.planGraph(x).allNodes()
        names += [nodes.apply(k).name() for k in range(nodes.size())]
    assert 0 < sum(n in ("Exchange", "BroadcastExchange") for n in names) <= 70


def test_pairs_at_the_threshold_in_long_sets_are_found(spark):
    """Index just over 0.5 in sets of hundreds of n-grams, of which a few smallest hashes would miss some."""
    rng = random.Random(77)
    texts = []
    for i in range(150):
        base = [f"p{i}w{k}" for k in range(rng.randrange(300, 500))]
        cut = int(len(base) * 0.68)
        texts += [" ".join(base), " ".join(base[:cut] + [f"z{i}q{k}" for k in range(len(base) - cut)])]
    want = jaccard_truth(texts, range(len(texts)), 3, 0.5)
    got = {(r.doc_a, r.doc_b) for r in ngram_join.similar(frame(spark, texts)).collect()}
    assert len(want) == 150 and got == want.keys()


def test_one_stays_of_each_class_and_a_repeated_id_costs_no_text(spark):
    rng = random.Random(6)
    a, other = prose(rng, 60, 5000), prose(rng, 60, 5000)
    rows = [(1, a), (5, a), (5, other), (5, a), (7, other + " end"), (8, None), (8, None), (9, "...")]
    df = frame(spark, [t for _, t in rows], [i for i, _ in rows])
    kept = sorted((r.doc_id, r.text or "") for r in ngram_join.keep_one(df).collect())
    assert kept == sorted([(1, a), (5, other), (8, ""), (9, "...")])


def test_a_family_of_a_thousand_is_counted_and_not_listed(spark):
    rng = random.Random(8)
    base = prose(rng, 80, 5000).split()
    texts = [" ".join(w if k != i % 80 else f"n{i}" for k, w in enumerate(base)) for i in range(1000)]
    got = ngram_join.classes(frame(spark, texts)).collect()
    assert {r.class_id for r in got} == {0} and {r.links for r in got} == {999}
    assert ngram_join.keep_one(frame(spark, texts)).count() == 1


# 4


def test_secrets_equal_a_plain_reading_of_assignments(spark):
    """Lines of a small language, read by rules of their own: what a sensitive name is set to, directly or over other names, is found."""
    rng = random.Random(13)
    names = ["password", "api_key", "client_secret", "label", "title", "colour", "authToken", "note"]
    texts, want = [], set()
    for i in range(300):
        known, lines, at = {}, [], 0
        for _ in range(rng.randrange(1, 8)):
            name, literal = rng.choice(names) + rng.choice(["", "_main", "2"]), "".join(rng.choices(string.ascii_letters + string.digits, k=rng.randrange(14, 300)))
            form = rng.randrange(4)
            if form < 3:
                line = (f'{name} = "{literal}"', f"{name}: '{literal}'", f'"{name}": "{literal}",')[form]
                start = at + line.index(literal) - 1
                known[name] = (literal, start, start + len(literal) + 2)
            elif known:
                used = rng.choice(sorted(known))
                line = f"{name} = {used}"
                known[name] = (known[used][0], at + len(name) + 3, at + len(line))
                if any(w in name.lower() for w in ("password", "api_key", "secret", "token")):
                    want.add((i, known[used][1], known[used][2]))
            else:
                continue
            if any(w in name.lower() for w in ("password", "api_key", "secret", "token")):
                want.add((i, *known[name][1:]))
            lines.append(line)
            at += len(line) + 1
        texts.append("\n".join(lines))
    got = {(r.doc_id, r.start_at, r.end_at) for r in secret_scan.find(frame(spark, texts)).collect()}
    assert len(want) > 300 and got == want


def test_long_secrets_and_names():
    rng = random.Random(2)
    key = lambda n: "".join(rng.choices(string.ascii_letters + string.digits, k=n))
    for literal in (key(20), key(300), key(900), key(9000)):
        for text in (f"mysql://root:{literal}@host/db", f"<password>{literal}</password>", f"{'my_' * 100}token = {literal}", f"my_token={literal}=x" if len(literal) > secret_scan.BARE else f"my_token={literal}"):
            found = secret_scan.scan(text)
            assert [text[f.start : f.end] for f in found] == [literal], text[:60]
    began = time.time()
    for hard in ("a=b:" * 5000, "abc" * 100_000 + "=1", "[a" * 50_000 + "= 3", "x://a:b" * 5000, "--a b " * 20_000):
        secret_scan.scan(hard)
    assert time.time() - began < 60


# 7


def test_severity_equals_a_sum_over_words(spark):
    rng = np.random.default_rng(3)
    weight = np.where(rng.random(1 << toxicity.BITS) < 0.3, rng.normal(size=1 << toxicity.BITS), 0).astype(np.float32)
    model = toxicity.Model(weight, np.array([0.5, 1.5, 3.0]))
    texts = [*ODD, *(prose(random.Random(k), 50) for k in range(20)), "Être ou ne pas être, ÊTRE"]

    def severity(t):
        seen = set()
        for w in WORD.findall((t or "").lower()):
            raw = np.frombuffer(w.encode(), np.uint8)
            one, zero = np.array([len(raw)]), np.array([0])
            seen.add(int(textkit.hash_spans(raw, zero, one)[0] >> np.uint64(64 - toxicity.BITS)))
            for n in (4, 5, 6):
                if len(raw) > n:
                    seen.add(int((textkit.hash_spans(raw, zero, np.array([n])) + np.uint64(n))[0] >> np.uint64(64 - toxicity.BITS)))
        z = sum(float(weight[b]) for b in seen)
        return sum(1 / (1 + np.exp(-(z - t))) for t in model.theta)

    got = {r.doc_id: r.severity for r in toxicity.score(frame(spark, texts), model).collect()}
    assert got == {i: pytest.approx(severity(t), abs=1e-3) for i, t in enumerate(texts)}


# long and hard texts


def test_long_texts_take_linear_time():
    c = viterbi.codec(viterbi.default_model())
    spent = []
    for n in (50_000, 200_000):
        began = time.time()
        ids = c.encode("a" * n)
        spent.append(time.time() - began)
        assert c.decode(ids) == "a" * n
    assert spent[1] < 12 * max(spent[0], 0.05)
    began = time.time()
    assert len(list(pii.candidates("a" * 1_000_000 + "5"))) == 1
    list(pii.candidates("a-" * 200_000 + ".b5 " + "x@" * 50_000 + "5." * 50_000))
    assert time.time() - began < 10
    text = "hello wörld, " * 80_000
    assert (langid.counts(text) == np.bincount(langid.buckets(text), minlength=1 << langid.BITS)).all()
    m = langid.Model(("a", "b"), np.log([0.5, 0.5]), np.random.default_rng(0).normal(size=(1 << langid.BITS, 2)))
    s, n = langid.score(m, [text, "abc"])
    assert n[0] == len(langid.buckets(text)) and np.allclose(s[0], m.prior + m.logp[langid.buckets(text)].sum(0))


def test_whole_addresses_are_covered():
    for local in ("q" * 200, "a.b-c+d" * 40, "1" * 150):
        mail = f"{local}@mail.com"
        assert [s for _, _, s in pii.candidates(f"see {mail}, or 12 34")][0] == mail


def test_containment_equals_brute_force():
    rng = random.Random(1)
    for n in (5, 60, 300):
        found = [license_scan.Detection(a := rng.randrange(50), a + 1 + rng.randrange(30), "x", rng.randrange(9), rng.randrange(4)) for _ in range(n)]
        kept = []
        for d in sorted(found, key=lambda d: (-d.priority, d.start - d.end, d.rule)):
            if not any(k.start <= d.start and d.end <= k.end for k in kept):
                kept.append(d)
        assert license_scan.resolve(found) == sorted(kept)
    began = time.time()
    license_scan.resolve([license_scan.Detection(k, k + rng.randrange(1, 10**6), "x", 0, rng.randrange(9)) for k in range(50_000)])
    assert time.time() - began < 10


def test_rows_of_adjacent_copies(spark):
    item = [f"i{k}" for k in range(25)]
    docs = [(item + ["so"]) * 2000, ["so"] * 50_000 + item + ["so"] * 50_000]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    rows = sorted((r.doc_id, r.start_word, r.end_word, r.matches, r.score) for r in decontam.leaks(frame(spark, [" ".join(w) for w in docs]), bench).collect())
    assert rows == [(0, 26 * k, 26 * k + 25, 25, 1.0) for k in range(2000)] + [(1, 50_000, 50_025, 25, 1.0)]


def test_empty_and_odd_tables(spark):
    odd, none = frame(spark, ODD), frame(spark, ODD).limit(0)
    assert {r.doc_id for r in ngram_join.classes(odd).collect()} == set(range(len(ODD))) and ngram_join.classes(none).count() == 0
    for f in (secret_scan.find, license_scan.scan, pii.identify, viterbi.encode, secret_scan.redact):
        assert f(none).count() == 0 and f(odd).count() >= 0
