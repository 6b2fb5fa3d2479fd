"""PII: bootstrapped contextual extraction.

Candidates are a text's number-like and address-like strings (`candidates`). Strict validators give the seeds: mail addresses,
phone numbers, payment cards with a right check digit, social security numbers, IBANs and IP addresses. Each candidate
stands in lexical patterns: its own form with the lengths of its digit runs, the same with the words beside it, and the
words before and after it. Patterns and instances are a bipartite graph that Spark scores in turns:

* a pattern's score for a kind is the confidence of its distinct instances in that kind, summed, over their number plus
  `PRIOR`: patterns that also hold much else, or have few instances, score low;
* patterns that score at least `TRUST` pass their score on; an instance's confidence is one less the product of what its
  trusted patterns leave in doubt, at most `FOUND`; seeds keep 1.

After `ROUNDS` turns, instances of at least `REPORT` are identifiers, in each place where they stand, with the kind that
has most confidence (of equals the first in alphabetical order). So the trusted patterns find identifiers that no validator knows,
such as mail domains that the list lacks, and form-like strings that only stand beside other things are left alone.

Numbers beside each other, with a space or a slash between, are one candidate if a validator accepts them together. Else the
validators try the runs of whole numbers in them: those in a fixed layout first, then the longest, then the first. What is left
between accepted ones is a candidate as it would be alone.

Null, empty and digitless texts without a mail address have no candidates, and an empty table gives no rows. Candidates have any length, and texts are
read whole, in time that is linear in their length. The words beside a candidate are those within `CONTEXT` characters. Repeated rows each report. Offsets count characters.
Counts are over all documents. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkit import clean_text, map_rows, persist_shared

PRIOR = 2.0
TRUST = 0.7
FOUND = 0.95
REPORT = 0.55
ROUNDS = 3
#: Characters on either side of a candidate that the words beside it are taken from.
CONTEXT = 48
SCHEMA = "doc_id bigint, start_at int, end_at int, kind string, confidence double, seed boolean"

_DIGIT = re.compile(r"[0-9]")
_DOMAIN = re.compile(r"@[^\W_][\w\-]*(?:\.[\w\-]+)+")
_CANDIDATE = re.compile(
    r"(?P<address>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))"
    r"|(?P<groups>(?<![\w+])\+?\(?\d{1,5}\)?(?:[ .\-/]\(?\d{2,5}\)?)+(?![\w]))"
    r"|(?P<solid>(?<!\w)\+?\d{3,}(?!\w))"
    r"|(?P<mixed>(?<!\w)(?=[\w\-]*\d)[\w][\w\-]{3,}(?!\w))"
)
_TLDS = {"com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "ai", "dev", "app", "de", "fr", "es", "uk", "it", "nl", "eu", "us", "ca", "au", "ch", "at", "be", "se", "no", "dk", "pl", "pt", "br", "jp", "cn", "in", "ru", "mx"}


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def seed_kind(s: str) -> str | None:
    """The kind of a string that a validator accepts."""
    if "@" in s:
        return "mail" if s.rpartition(".")[2].lower() in _TLDS and ".." not in s else None
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", s):
        return "ip" if all(int(x) < 256 and (x == "0" or x[0] != "0") for x in s.split(".")) else None
    if re.fullmatch(r"(?:\+?1[ .\-]?)?(?:\([2-9]\d\d\) ?|[2-9]\d\d[.\-])[2-9]\d\d[ .\-]\d{4}", s):
        return "phone"
    if re.fullmatch(r"\+[1-9]\d{0,2}(?:[ .\-/]\(?\d{2,5}\)?){2,5}", s) and 9 <= sum(c.isdigit() for c in s) <= 15:
        return "phone"
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", s):
        return "ssn" if s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000" else None
    digits = re.sub(r"[ \-]", "", s)
    if re.fullmatch(r"[3-6]\d{12,18}", digits) and len(set(digits)) > 1 and _luhn(digits):
        return "card"
    if re.fullmatch(r"[A-Z]{2}\d\d[A-Z0-9]{11,30}", s) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1:
        return "iban"
    return None


def form(s: str) -> str:
    """The form of a string: digit runs with their lengths, letter runs without; mail addresses have one."""
    if "@" in s:
        return "w@w." + ".".join("w" for _ in s.rpartition("@")[2].split(".")[1:])
    if re.fullmatch(r"\d+(\.\d+){3}", s):
        return "d.d.d.d"
    return re.sub(r"[^\W\d_]+", lambda m: "A" if m.group().isupper() else "a", re.sub(r"\d+", lambda m: f"<{len(m.group())}>", s))


#: Digits that what a validator accepts has at least and at most; numbers that an unaccepted candidate has at most.
_LEAST, _MOST, _UNITS = 9, 19, 7
_UNIT = re.compile(r"[^ /]+")
_CARD = re.compile(r"\d{4}([ \-])\d{4}\1\d{4}\1\d{4}(?:\1\d{3})?")


def split(s: str) -> list[tuple[int, int]]:
    """The spans in a string of joined numbers that are candidates, in order."""
    units = [m.span() for m in _UNIT.finditer(s)]
    if len(units) < 2 or seed_kind(s):
        return [(0, len(s))]
    sizes = [sum(c.isdigit() for c in s[a:b]) for a, b in units]
    found = []
    for a in range(len(units)):
        digits = 0
        for b in range(a, len(units)):
            digits += sizes[b]
            if digits > _MOST:
                break
            if digits >= _LEAST and (kind := seed_kind(part := s[units[a][0] : units[b][1]])):
                found.append((kind == "card" and b > a and not _CARD.fullmatch(part), a - b, a, b + 1))
    owner = [0] * len(units)
    taken = []
    for _, _, a, b in sorted(found):
        if not any(owner[a:b]):
            owner[a:b] = [1] * (b - a)
            taken.append((a, b))
    at = 0
    for a, b in sorted(taken) + [(len(units), 0)]:
        taken += [(k, min(a, k + _UNITS)) for k in range(at, a, _UNITS)]
        at = b
    return [(units[a][0], units[b - 1][1]) for a, b in sorted(taken)]


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, string) of candidates in text order, without overlaps: mail addresses, and what has digits between them."""
    at = 0
    for s, e in _mails(text):
        yield from _numbers(text, at, s)
        part = text[s:e].rstrip(".-")
        yield s, s + len(part), part
        at = e
    yield from _numbers(text, at, len(text))


def _mails(text: str) -> Iterator[tuple[int, int]]:
    low, at = 0, text.find("@")
    while at >= 0:
        if (m := _DOMAIN.match(text, at)) is not None:
            s = at
            while s > low and (text[s - 1].isalnum() or text[s - 1] in "_.+-"):
                s -= 1
            while s < at and not text[s].isalnum():
                s += 1
            if s < at:
                yield s, m.end()
                low = m.end()
        low = max(low, at + 1)
        at = text.find("@", low)


def _numbers(text: str, at: int, to: int) -> Iterator[tuple[int, int, str]]:
    """The candidates with digits from `at` to `to`. All of them begin at a digit, at a sign or a bracket before it, or where its word does."""
    while (hit := _DIGIT.search(text, at, to)) is not None:
        first = hit.start()
        s = first
        while s > at and (text[s - 1].isalnum() or text[s - 1] in "_-"):
            s -= 1
        while s < first and text[s] == "-":
            s += 1
        found = None
        for start in sorted({s, *range(max(at, first - 2), first + 1)}):
            if (found := _CANDIDATE.match(text, start, to)) is not None and found.end() > first:
                break
            found = None
        at = first + 1
        if found is not None:
            s, e = found.span()
            for a, b in split(found.group()) if found.lastgroup == "groups" else [(0, e - s)]:
                part = text[s + a : s + b].rstrip(".-")
                if len(part) > 3:
                    yield s + a, s + a + len(part), part
            at = e


_WORD = re.compile(r"[^\W\d_]+[:#]?")


def patterns(text: str, start: int, end: int, s: str) -> list[str]:
    left, right = _WORD.findall(text[max(0, start - CONTEXT) : start].lower()), _WORD.findall(text[end : end + CONTEXT].lower())
    f, a, b = form(s), left[-1] if left else "^", right[0] if right else "$"
    out = [f"F {f}", f"L {a} {f}", f"R {f} {b}", f"C {a} _ {b}"]
    return out + [f"LL {left[-2]} {a} _"] if len(left) > 1 else out


def extract(docs: DataFrame) -> DataFrame:
    """(doc_id, start_at, end_at, instance, seed, patterns): each candidate in each place."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [(i, a, b, s.lower(), seed_kind(s), patterns(t, a, b, s)) for i, t in enumerate(batch.column(1).to_pylist()) for a, b, s in candidates(t)]
        if rows:
            at, *rest = zip(*rows)
            types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(at))), *(pa.array(c, k) for c, k in zip(rest, types))], ["doc_id", "start_at", "end_at", "instance", "seed", "patterns"])

    return map_rows(docs, [F.col("doc_id").cast("bigint").alias("doc_id"), clean_text("text").alias("text")], "doc_id bigint, start_at int, end_at int, instance string, seed string, patterns array<string>", run)


def score(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(instance, kind, confidence, seed) after the turns over the graph of patterns and instances."""
    edges = persist_shared(found.select("instance", F.explode("patterns").alias("pattern")).distinct())
    size = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = persist_shared(found.where("seed is not null").groupBy("instance").agg(F.min("seed").alias("kind")).withColumn("confidence", F.lit(1.0)).withColumn("seed", F.lit(True)))
    belief = seeds
    for _ in range(rounds):
        trusted = edges.join(belief.select("instance", "kind", "confidence"), "instance").groupBy("pattern", "kind").agg(F.sum("confidence").alias("mass"))
        trusted = trusted.join(size, "pattern").withColumn("trust", F.col("mass") / (F.col("n") + PRIOR)).where(F.col("trust") >= TRUST)
        doubt = edges.join(trusted, "pattern").groupBy("instance", "kind").agg(F.sum(F.log(1 - F.least("trust", F.lit(FOUND)))).alias("doubt"))
        new = doubt.join(seeds.select("instance"), "instance", "left_anti").select("instance", "kind", F.least(F.lit(FOUND), 1 - F.exp("doubt")).alias("confidence"), F.lit(False).alias("seed"))
        belief = persist_shared(seeds.unionByName(new))
    best = Window.partitionBy("instance").orderBy(F.desc("confidence"), "kind")
    return belief.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


def identify(docs: DataFrame, rounds: int = ROUNDS, report: float = REPORT) -> DataFrame:
    """(doc_id, start_at, end_at, kind, confidence, seed) of each identifier in each place."""
    found = persist_shared(extract(docs))
    sure = score(found, rounds).where(F.col("confidence") >= report)
    return found.drop("seed").join(sure, "instance").select("doc_id", "start_at", "end_at", "kind", F.round("confidence", 6).alias("confidence"), "seed")
