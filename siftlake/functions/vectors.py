"""Vector columns: cosine in double precision, conversions, and embedders that need no model file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors that are empty, of length near 0 or of different sizes."""
    na, nb = norm(a), norm(b)
    good = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (na >= 1e-12) & (nb >= 1e-12)
    return F.when(good, dot(a, b) / (na * nb)).otherwise(0.0)


def cosine_to_distance(c: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * c))


def squared_distance_to_cosine(d2: Column) -> Column:
    return 1 - d2 / 2


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def hashed_counts(c: Column, dimension: int = 64) -> Column:
    """A bag of words as a vector: counts of words by bucket, from 32 bits of their MD5. The same in any engine with MD5."""
    words = F.filter(F.split(F.lower(c), "[^0-9a-z]+"), lambda w: w != "")
    buckets = F.transform(words, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("bigint") % dimension)
    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda k: F.size(F.filter(buckets, lambda b: b == k)).cast("float"))


def seeded_embedder(dimension: int = 384):
    """Unit vectors that a linear congruential generator makes from a 64-bit FNV-1a hash of the text: for tests of plumbing."""

    @F.pandas_udf("array<float>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        mask = (1 << 64) - 1
        for batch in texts:
            out = []
            for t in batch:
                h = 14695981039346656037
                for b in (t or "").encode():
                    h = (h ^ (b if b < 128 else (mask ^ 0xFF) | b)) * 1099511628211 & mask  # bytes count as signed
                v = np.empty(dimension, np.float32)
                for i in range(dimension):
                    h = (h * 6364136223846793005 + 1442695040888963407) & mask
                    v[i] = np.float32(np.float32(h >> 33) / np.float32(1 << 31)) - np.float32(1)
                size = np.sqrt((v * v).sum())
                out.append((v / size if size > 1e-6 else v).tolist())
            yield pd.Series(out)

    return embed


def word_pieces(vocabulary: dict[str, int], max_length: int = 512, max_word: int = 100):
    """Ids by greedy longest match: ASCII lower case, split at white space, ASCII punctuation and CJK characters; `##` goes on a word."""
    unknown, first, last = vocabulary.get("[UNK]", 100), vocabulary.get("[CLS]", 101), vocabulary.get("[SEP]", 102)
    spaces = set(b" \t\n\r")
    marks = {b for b in range(33, 127) if not chr(b).isalnum()}
    han = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0xF900, 0xFAFF))
    table = {k.encode(): v for k, v in vocabulary.items()}

    def split(text: str) -> Iterator[bytes]:
        word = bytearray()
        for ch in text:
            raw = ch.encode("utf-8", "replace")
            alone = len(raw) == 1 and raw[0] in marks or len(raw) == 3 and any(a <= ord(ch) <= b for a, b in han)
            if alone or len(raw) == 1 and raw[0] in spaces:
                if word:
                    yield bytes(word)
                    word = bytearray()
                if alone:
                    yield raw
            else:
                word += raw.lower() if len(raw) == 1 else raw
        if word:
            yield bytes(word)

    def pieces(word: bytes) -> list[int]:
        out, start = [], 0
        if len(word) > max_word:
            return [unknown]
        while start < len(word):
            for end in range(len(word), start, -1):
                found = table.get((b"##" if start else b"") + word[start:end])
                if found is not None:
                    out.append(found)
                    start = end
                    break
            else:
                return [unknown]
        return out

    @F.pandas_udf("array<bigint>")
    def encode(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            ids = [first]
            for w in split(t or ""):
                ids += pieces(w)[: max_length - 1 - len(ids)]
                if len(ids) >= max_length - 1:
                    break
            out.append([*ids, last])
        return pd.Series(out)

    return encode


def pooled(tokens: Column, mask: Column | None = None, how: str = "mean") -> Column:
    """A unit vector from token vectors (an array of arrays): their mean where the mask isn't 0, or the first one with `how="cls"`; null without a token that counts."""
    if how == "cls":
        v = F.get(tokens, 0).cast("array<double>")
    else:
        pairs = F.arrays_zip(tokens.alias("t"), (mask if mask is not None else F.transform(tokens, lambda _: F.lit(1))).alias("m"))
        used = F.transform(F.filter(pairs, lambda x: x["m"] != 0), lambda x: x["t"].cast("array<double>"))
        total = F.aggregate(used, F.array().cast("array<double>"), lambda s, x: F.when(F.size(s) == 0, x).otherwise(F.zip_with(s, x, lambda a, b: a + b)))
        v = F.when(F.size(used) > 0, F.transform(total, lambda x: x / F.size(used)))
    size = norm(v)
    return F.transform(v, lambda x: F.when(size >= 1e-12, x / size).otherwise(x))
