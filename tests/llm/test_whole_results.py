"""Results that are easily cut short, against brute force."""

import random
import textwrap
import time

import numpy as np
import pytest

from siftlake.llm import decontam, license_scan, pii, secret_scan

from .test_operators import WORD, frame, prose, smith_waterman


def hashed(text):
    return np.array([abs(hash(w)) for w in WORD.findall(text.lower())], np.uint64)


def edited(rng, words, part):
    return [f"new{rng.randrange(10**6)}" if rng.random() < part else w for w in words]


@pytest.mark.parametrize("exact", [0, 5])
def test_edited_copies_are_found_with_and_without_exact_ones(spark, exact):
    rng = random.Random(21 + exact)
    items = [[f"i{i}q{k}" for k in range(rng.choice([30, 60, 120]))] for i in range(90)]
    texts, near = [], set()
    for i, w in enumerate(items):
        for part in (0.2, 0.25, 0.3):
            copy = edited(rng, w, part)
            if smith_waterman(hashed(" ".join(w)), hashed(" ".join(copy))) >= decontam.SHARE * 2 * len(w):
                near.add((len(texts), i))
            texts.append(" ".join([prose(rng, 40), *copy, prose(rng, 40)]))
        texts += [" ".join([prose(rng, 20), *w])] * exact
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(frame(spark, texts), bench).collect()}
    assert len(near) > 150 and len(near & got) >= 0.99 * len(near)


CARD, OTHER_CARD, SSN, PHONE, OTHER = "4111 1111 1111 1111", "4012-8888-8888-1881", "123-45-6789", "555-234-4567", "(555) 987-6543"
NUMBERS = [
    (f"{CARD} 12/25", [(CARD, "card")]),
    (f"paid 12/25 {CARD} 123 in full", [(CARD, "card")]),
    (f"{SSN} 1990", [(SSN, "ssn")]),
    (f"{PHONE} {OTHER}", [(PHONE, "phone"), (OTHER, "phone")]),
    (f"{PHONE}/{PHONE}", [(PHONE, "phone"), (PHONE, "phone")]),
    (f"{CARD} {SSN} {PHONE}", [(CARD, "card"), (SSN, "ssn"), (PHONE, "phone")]),
    (f"10 20 30 40 {CARD} 50 {OTHER_CARD} 60", [(CARD, "card"), (OTHER_CARD, "card")]),
    (" ".join(["17"] * 500 + [SSN] + ["17"] * 500), [(SSN, "ssn")]),
    ("12-123-45-6789 10/11 2024 15", []),
    (CARD, [(CARD, "card")]),
]


def test_identifiers_with_numbers_beside_them(spark):
    for text, expected in NUMBERS:
        found = list(pii.candidates(text))
        assert [(s, k) for _, _, s in found if (k := pii.seed_kind(s))] == expected, text
        assert all(text[a:b] == s for a, b, s in found) and all(x[1] <= y[0] for x, y in zip(found, found[1:]))
    got = {(r.doc_id, r.start_at, r.end_at, r.kind) for r in pii.identify(frame(spark, [t for t, _ in NUMBERS])).collect() if r.seed}
    assert {(i, t[a:b], k) for i, a, b, k in got for t in [NUMBERS[i][0]]} == {(i, s, k) for i, (_, e) in enumerate(NUMBERS) for s, k in e}


KEY = "Ab3dEf6hIj9kLm"
TYPED = {
    "TypeScript": [f'const apiKey: string = "{KEY}";', f"private readonly apiKey?: string | undefined = '{KEY}'", f'let api_key: Array<string> = "{KEY}"'],
    "Python": [f'API_KEY: str = "{KEY}"', f'def f(host: str, password: Optional[str] = "{KEY}"):', f'password: SecretStr="{KEY}"', f'token: str | None = "{KEY}"'],
    "Go": [f'var apiKey string = "{KEY}"', f'const apiKey Text = "{KEY}"', f'var (\n\tapiKey  string = "{KEY}"\n)'],
    "Rust": [f'const API_KEY: &str = "{KEY}";', f'static API_KEY: &\'static str = "{KEY}";', f'let api_key: Option<std::string::String> = "{KEY}"'],
    "Kotlin": [f'val apiKey: String = "{KEY}"', f'private const val apiKey: String? = "{KEY}"'],
    "Swift": [f'let apiKey: String = "{KEY}"', f'var apiKey: String! = "{KEY}"'],
}


@pytest.mark.parametrize("language", TYPED)
def test_secrets_in_typed_declarations(language):
    for text in TYPED[language]:
        found = [f for f in secret_scan.scan(text) if f.literal == KEY]
        assert len(found) == 1 and secret_scan.sensitivity(found[0].name) >= 0.9 and KEY not in secret_scan.masked(text), text


def test_types_take_no_secret_from_other_names():
    for text in (f'String password = "{KEY}";', f'note: token = "{KEY}"', f'std::string apiKey = "{KEY}";', f"token: {KEY}= x", f'config: base = "{KEY}"\npassword = base', f'const part: string = "{KEY}";\nconst token = part;'):
        assert KEY not in secret_scan.masked(text), text
    for text in (f'const label: string = "{KEY}"', f'const part: string = "{KEY}"\ntoken: string', 'const token: string = getToken();', f'var title string = "{KEY}"'):
        assert secret_scan.scan(text) == [], text


HEADERS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish.",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above notice appears.",
    "GPL-3.0": "You can use it under the terms of the GNU General Public License, version 3.",
}


@pytest.mark.parametrize("lead", [" * ", "# ", "// ", "-- ", ";; ", "% ", "    ## ", "> ", "dnl "])
@pytest.mark.parametrize("name", HEADERS)
def test_licenses_in_wrapped_comments(name, lead):
    for width in range(20, 80, 7):
        lines = textwrap.wrap(HEADERS[name], width)
        plain = [d.license for d in license_scan.detect("\n".join(lines))]
        assert name in plain or width < 60
        text = "x = 1\n" + "\n".join(lead + x for x in lines) + "\ny = 2\n"
        found = license_scan.detect(text)
        assert [d.license for d in found] == plain, text
        for d in found:
            assert text[d.start : d.end].split()[0] in HEADERS[name] and not text[d.start : d.end].endswith("\n")
    boxed = "/***\n" + "\n".join(f" * {x:60} *" for x in textwrap.wrap(HEADERS[name], 60)) + "\n ***/"
    assert [d.license for d in license_scan.detect(boxed)] == plain


def test_copies_beside_each_other_are_a_row_each(spark):
    rng = random.Random(31)
    item = [f"i{k}" for k in range(30)]
    docs = [(item + ["so"]) * 2, item * 3, (item + ["and", "then"]) * 200, item + edited(rng, item, 0.15) + item, item]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    rows = sorted((r.doc_id, r.start_word, r.end_word) for r in decontam.leaks(frame(spark, [" ".join(w) for w in docs]), bench).collect())
    assert [sum(d == i for d, _, _ in rows) for i in range(len(docs))] == [2, 3, 200, 3, 1]
    assert [(a, b) for d, a, b in rows if d == 2] == [(32 * k, 32 * k + 30) for k in range(200)]
    assert all(x[0] < y[0] or x[2] <= y[1] for x, y in zip(rows, rows[1:]))


def test_what_a_worker_remembers_does_not_change_ids(monkeypatch):
    from siftlake.llm import viterbi

    texts = [f"word{i % 7} other{i % 11} thing{i}" for i in range(60)]
    whole = [viterbi.Codec.load(viterbi.default_model()).encode(t).tolist() for t in texts]
    monkeypatch.setattr(viterbi, "REMEMBER", 5)
    codec = viterbi.Codec.load(viterbi.default_model())
    assert [codec.encode(t).tolist() for t in texts] == whole
    assert len(codec.parts) <= 5 and len(codec.parts.old) <= 5


# 6: parts that are not remembered are encoded together


def test_new_words_are_encoded_together():
    from siftlake.llm import viterbi

    c = viterbi.Codec.load(viterbi.default_model())
    rng = random.Random(6)
    text = " ".join("".join(rng.choices(["an", "the", "ñ", "er", "ou", "ß", "keit", "ly", "x", "q", "ción"], k=rng.randrange(2, 7))) for _ in range(40_000))
    c.encode("warm up")
    began = time.process_time()
    ids = c.encode(text).tolist()
    spent, began = time.process_time() - began, time.process_time()
    assert ids == [i for part in c.cuts.findall(c.marked(text)) for i in c.stream(part)]
    assert spent < (time.process_time() - began) / 2


def test_parts_together_are_as_each_alone(monkeypatch):
    from siftlake.llm import viterbi

    rng = random.Random(7)
    codecs = [viterbi.Codec.load(viterbi.default_model()), viterbi.Codec({}, [], 0, [b""])]
    for inner in ("", "▁", "\n"):  # few scores, so many sums are equal
        names = {"".join(rng.choices("abc" + inner, k=rng.randrange(1, 5))) for _ in range(25)} | {"▁", "▁a", "▁▁b"}
        codecs.append(viterbi.Codec({p: (i, -float(rng.randrange(1, 3))) for i, p in enumerate(sorted(names), 1)}, list(range(100, 356)) if inner else [], 0, []))
    texts = ["", " ", "\n", "a" * 70, "日本\ud800é", "b" * 63 + "\U0001f600", "Ω" * 80] + ["".join(rng.choices("aaabbc  \né😀", k=rng.randrange(1, 90))) for _ in range(200)]
    for c in codecs:
        alone = [list(c.stream(c.marked(t))) for t in texts]
        assert [x.tolist() for x in c.encode_all(texts)] == alone
        c.parts = viterbi._Parts(c)
        with monkeypatch.context() as m:
            m.setattr(viterbi, "TOGETHER", 7)
            assert [c.encode(t).tolist() for t in texts] == alone
        parts = sorted({p for t in texts for p in c.cuts.findall(c.marked(t)) if len(p) <= viterbi.REMEMBER_CHARS})
        assert c.together(parts) == [c.alone(p) for p in parts]
