"""Text columns: normal forms, digests, keys and prompts. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import INSTRUCTIONS, Normalization
from ..errors import InvalidOption

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of compatibility forms that become several characters.
EXPANSIONS = {"¼": "1/4", "½": "1/2", "¾": "3/4", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def _single() -> tuple[str, str]:
    """Characters that become one other: superscripts, subscripts, full-width forms and Latin-1 capitals."""
    pairs = dict(zip("²³¹⁰⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿ", "2310456789+-=()n"))
    pairs |= dict(zip("₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎", "0123456789+-=()"))
    pairs |= {chr(0xFF01 + i): chr(0x21 + i).translate(str.maketrans(UPPER, LOWER)) for i in range(94)}
    pairs |= {chr(c): chr(c + 32) for c in range(0xC0, 0xDF) if c != 0xD7}
    pairs |= dict(zip(UPPER, LOWER))
    return "".join(pairs), "".join(pairs.values())


SINGLE_FROM, SINGLE_TO = _single()


def squeeze(c: Column) -> Column:
    """Runs of ASCII white space become one space; none at the ends. Other spaces stay."""
    return F.trim(F.regexp_replace(c, "[ \\t\\n\\r\\x0B\\f]+", " "))


def ascii_fold(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def unicode_fold(c: Column) -> Column:
    """Texts of ASCII only, which are told by their length in bytes, take the short way."""
    plain, short = F.octet_length(c) == F.length(c), ascii_fold(c)
    for a, b in EXPANSIONS.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.when(plain, short).otherwise(F.translate(c, SINGLE_FROM, SINGLE_TO))


def normalize(c: Column, mode: Normalization = Normalization.NONE, max_bytes: int = 1 << 20) -> Column:
    """The form that equality is judged by; texts of more than max_bytes (0: no limit) stay as they are."""
    if mode is Normalization.NONE:
        return c
    out = {Normalization.WHITESPACE: squeeze, Normalization.ASCII: lambda x: squeeze(ascii_fold(x)), Normalization.UNICODE: lambda x: squeeze(unicode_fold(x))}[mode](c)
    return F.when(F.octet_length(c) <= max_bytes, out).otherwise(c) if max_bytes else out


def digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def object_id(c: Column) -> Column:
    """The 128-bit id, in hex, of a value's object: the same on each run."""
    return F.substring(digest(c), 1, 32)


def short_digest(c: Column, n: int = 16) -> Column:
    return F.substring(digest(c), 1, n)


def group_digest(c: Column) -> Column:
    return F.substring(F.md5(c.cast("binary")), 1, 8)


def extract_text(columns: list[str], separator: str = " ") -> Column:
    """One text of several columns; null counts as empty and keeps its separators."""
    return F.concat_ws(separator, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))


def text_extractor(columns: list[str], separator: str = " ", preprocess: Callable[[Column], Column] | None = None) -> Callable[[], Column]:
    return lambda: (preprocess or (lambda c: c))(extract_text(columns, separator))


def validate_columns(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise InvalidOption(f"no column {', '.join(missing)}; there are {', '.join(df.columns)}")


def truncate_bytes(c: Column, n: int = 8192) -> Column:
    """The first n bytes of a text, as binary."""
    return F.substring(c.cast("binary"), 1, n)


def truncate_text(c: Column, n: int) -> Column:
    """The whole characters among the first n bytes of a text; bytes that are no UTF-8 themselves are replaced."""
    cuts = [truncate_bytes(c, n - k).cast("string") for k in range(min(4, n + 1))]  # a character has 4 bytes at most
    return F.coalesce(*(F.try_validate_utf8(x) for x in cuts), F.make_valid_utf8(cuts[0]))


def instructed(c: Column, model: str) -> Column:
    return F.concat(F.lit(INSTRUCTIONS[model]), c)


def make_key(index: Column, prefix: str = "", namespace: str = "") -> Column:
    """`item_<index>` after namespace and prefix, joined by underscores."""
    return F.concat_ws("_", *(F.lit(p) for p in (namespace, prefix) if p), F.lit("item"), index.cast("string"))


def proxy_key(method: Column, path: Column, query: Column | None = None, body: Column | None = None, vary: dict[str, Column] | None = None) -> Column:
    """The cache key of a request; bodies count for POST, PUT and PATCH."""
    parts = [F.lit("proxy:"), method, F.lit(":"), path]
    if query is not None:
        parts.append(F.when(F.coalesce(query, F.lit("")) != "", F.concat(F.lit("?"), query)).otherwise(""))
    if body is not None:
        parts.append(F.when((F.coalesce(F.octet_length(body), F.lit(0)) > 0) & method.isin("POST", "PUT", "PATCH"), F.concat(F.lit(":body="), F.sha2(body.cast("binary"), 256))).otherwise(""))
    if vary:
        joined = F.concat(*(F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}="), v, F.lit(";"))).otherwise("") for k, v in vary.items()))
        parts.append(F.when(joined != "", F.concat(F.lit(":vary="), joined)).otherwise(""))
    return F.concat(*parts)


def response_json(status: Column, headers: Column, body: Column, cached_at_ms: Column, latency_ms: Column) -> Column:
    """A cached response as JSON; the body in base 64. headers: array<struct<name,value>>."""
    return F.to_json(F.struct(status.alias("status_code"), headers.alias("headers"), F.base64(body.cast("binary")).alias("body"), cached_at_ms.alias("cached_at_ms"), latency_ms.alias("upstream_latency_ms")))


def response_parts(json: Column) -> Column:
    kind = "status_code int, headers array<struct<name:string,value:string>>, body string, cached_at_ms bigint, upstream_latency_ms bigint"
    parsed = F.from_json(json, kind)
    return F.struct(parsed["status_code"].alias("status_code"), parsed["headers"].alias("headers"), F.unbase64(parsed["body"]).alias("body"), parsed["cached_at_ms"].alias("cached_at_ms"), parsed["upstream_latency_ms"].alias("upstream_latency_ms"))


def judge_prompt(text1: Column, text2: Column, similarity: Column) -> Column:
    """What a judge of paraphrases is asked; texts are cut to 2048 characters."""
    return F.format_string(
        "Do two texts say the same thing?\nScore 1 (unrelated) to 7 (letter for letter the same); duplicates score 4 or more.\nFirst text: %s\nSecond text: %s\nCosine: %.3f\nAnswer as\n[REASONING]: why\n[SCORE]: 1-7\n[DUPLICATE]: YES or NO\n",
        F.substring(text1, 1, 2048), F.substring(text2, 1, 2048), similarity.cast("double"),
    )


def judge_verdict(response: Column, min_score: int = 5) -> Column:
    """valid, is_duplicate, score, confidence and reasoning of an answer; a score overrides YES or NO."""
    said = F.upper(F.regexp_extract(response, r"(?i)\[DUPLICATE\]:\s*(YES|NO)", 1))
    score = F.regexp_extract(response, r"\[SCORE\]:\s*(\d)", 1)
    number = score.cast("int")
    return F.struct(
        ((said != "") | (score != "")).alias("valid"),
        F.when(score != "", number >= min_score).otherwise(said == "YES").alias("is_duplicate"),
        F.coalesce(F.when(score != "", number), F.lit(0)).alias("score"),
        F.when(score == "", 0.0).when(number >= 4, (number - 3) / 4.0).otherwise((4 - number) / 4.0).alias("confidence"),
        F.trim(F.regexp_replace(F.regexp_extract(response, r"\[REASONING\]:\s*([^\[]+)", 1), r"^[ \t\n\r]+|[ \t\n\r]+$", "")).alias("reasoning"),
    )


def status_kind(code: Column) -> Column:
    """A label of few values for a status code."""
    return F.when(code < 300, "ok").when(code == 404, "not_found").when(code == 400, "invalid_argument").when(code == 504, "timed_out").when(code == 503, "busy").otherwise("error")


def memory_estimate(items: Column, length: Column, mode: str = "exact", dimension: int = 384) -> dict[str, Column]:
    """Bytes by part for so many items of a mean length."""
    exact = mode == "exact"
    parts = {
        "text_bytes": items * length, "key_bytes": items * 30, "object_id_bytes": items * 16, "hash_bytes": items * (32 if exact else 0),
        "embedding_bytes": items * (0 if exact else dimension * 4), "hnsw_bytes": items * (0 if exact else 100),
    }
    total = None
    for c in parts.values():
        total = c if total is None else total + c
    return parts | {"total_bytes": total}
