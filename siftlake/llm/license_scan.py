"""License scans: ordered signature rules with a keyword prefilter.

An Aho-Corasick automaton over the rules' keywords says which rules a text can match at all; only their expressions run.
Each match is a detection, an interval with the rule's priority. A detection goes if its interval lies within that of a
detection of higher priority, or of equal priority and greater length, or of equal interval and priority and an earlier rule; so
each place keeps its most specific reading, and overlaps that contain neither one stay.

Both see the text without the comment leaders at line starts (`*`, `//`, `#`, `--`, `;` and the like) and the borders of boxes at line ends, so
text that is wrapped in a comment is read like any other; detections have the offsets of the text itself.

Null, empty and license-free texts have no detections, and an empty table gives no rows. Offsets count characters. Keywords with a space are found across any white
space. Very long texts are read whole; n detections resolve in n log n steps. Repeated rows each report their own detections; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_rules import RULES
from .textkit import clean_text, map_rows

SCHEMA = "doc_id bigint, start_at int, end_at int, license string, rule int, priority int"


class Rule(NamedTuple):
    priority: int
    license: str
    keyword: str
    expression: re.Pattern


class Detection(NamedTuple):
    start: int
    end: int
    license: str
    rule: int
    priority: int


def parse(lines: str) -> list[Rule]:
    rules = []
    for line in filter(None, map(str.strip, lines.split("\n"))):
        priority, name, keyword, expression = line.split(" | ", 3)
        spaced, in_class = [], False
        for i, c in enumerate(expression):  # a space stands for white space, but not within a class or before a repetition
            if c in "[]" and expression[i - 1 : i] != "\\":
                in_class = c == "["
            spaced.append(r"\s+" if c == " " and not in_class and expression[i + 1 : i + 2] not in ("?", "*") else r"\s" if c == " " and not in_class else c)
        rules.append(Rule(int(priority), name, keyword, re.compile("".join(spaced), re.I | re.M)))
    return rules


@cache
def _compiled():
    import ahocorasick

    rules = parse(RULES)
    by: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        by.setdefault(r.keyword, []).append(i)
    automaton = ahocorasick.Automaton()
    for k, v in by.items():
        automaton.add_word(k, tuple(v))
    automaton.make_automaton()
    return rules, automaton


_LEADER = re.compile(r"""^[ \t]*(?:/\*+!?|\*+/?|//+!?|\#+[!:|]?|--+|;+|%+|<!--|\.\.(?!\.)|\.\\"|\(\*+|\{-|!+|>+|(?:dnl|@?rem|REM)\b|["'](?=[ \t\n]))[ \t]*|[ \t]+[*#|]+/?[ \t]*$""", re.M)


def uncommented(text: str) -> tuple[str, list[int], list[int]]:
    """The text without comment leaders; where its pieces start, in it and in the text."""
    pieces, own, there, at, size = [], [0], [0], 0, 0
    for m in _LEADER.finditer(text):
        pieces.append(text[at : m.start()])
        size += m.start() - at
        at = m.end()
        own.append(size)
        there.append(at)
    return ("".join([*pieces, text[at:]]) if pieces else text), own, there


def detect(text: str) -> list[Detection]:
    rules, automaton = _compiled()
    text, own, there = uncommented(text)

    def place(i: int) -> int:
        k = bisect_right(own, i) - 1
        return there[k] + i - own[k]

    low = " ".join(text.lower().split())
    hit: set[int] = set()
    for _, found in automaton.iter(low):
        hit.update(found)
    if not hit:
        return []
    out = [Detection(place(m.start()), place(m.end() - 1) + 1, rules[i].license, i, rules[i].priority) for i in sorted(hit) for m in rules[i].expression.finditer(text) if m.end() > m.start()]
    return resolve(out)


def resolve(found: list[Detection]) -> list[Detection]:
    """Drops contained detections that something more specific explains; the rest in text order."""
    kept: list[Detection] = []
    starts = sorted({d.start for d in found})
    reach = [-1] * (len(starts) + 1)  # a Fenwick tree: the greatest end of what is kept, by how many starts there are up to its own
    for d in sorted(found, key=lambda d: (-d.priority, d.start - d.end, d.rule)):
        own = k = bisect_right(starts, d.start)
        while k and reach[k] < d.end:
            k &= k - 1
        if not k:
            kept.append(d)
            while own <= len(starts):
                reach[own] = max(reach[own], d.end)
                own += own & -own
    return sorted(kept)


def scan(docs: DataFrame) -> DataFrame:
    """A row for each detection that is left."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [(i, *d) for i, t in enumerate(batch.column(1).to_pylist()) for d in detect(t)]
        if rows:
            at, *rest = zip(*rows)
            types = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(at))), *(pa.array(c, k) for c, k in zip(rest, types))], ["doc_id", "start_at", "end_at", "license", "rule", "priority"])

    return map_rows(docs, [F.col("doc_id").cast("bigint").alias("doc_id"), clean_text("text").alias("text")], SCHEMA, run)
