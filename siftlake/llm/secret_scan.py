"""Secret scans: assignment-aware lexing.

`lex` reads source and configuration syntax in a text and gives name-literal pairs: `name = "x"`, `name: x`, `"name": "x"`,
`name: Type = x`, `name Type = x`, `name := x`, `name => x`, `<name>x</name>`, `--name x`, `scheme://name:x@host`, `Bearer x` and PEM blocks.
Constants are propagated in text order: identifiers, `${name}` and `$name` in a value stand for the literal that
was last assigned to the name, and `+` or `.` joins literals. A literal scores by how sensitive its target's name is and
by how much it looks like key material; words, placeholders and references without a value score low. Unnamed
literals in the published shape of a provider's keys score by shape alone.

A type between a name and `=` is read as such if it follows a colon, or if it is a known one or `var`, `const` or the like begins the declaration,
and unless the type's own name is the more sensitive one of the two, as in a message `note: token = x`.

Null, empty and assignment-free texts have no findings, and an empty table gives no rows. Names and literals have any length and texts are read whole; a typed declaration, and a quoted name
with spaces, is read up to `DECLARATION` characters back from its operator, and an unquoted value of more than `BARE` characters ends before the next
operator, if there is one in it. A symbol table is per document. Findings that overlap resolve to the highest score, then the longest, then the first.
Offsets count characters. Repeated rows each report their findings; other columns are ignored or, in `redact`, kept.
"""

from __future__ import annotations

import math
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import clean_text, map_rows

#: Score from which a literal is a finding.
THRESHOLD = 0.5
SCHEMA = "doc_id bigint, start_at int, end_at int, name string, kind string, sha256 string, score double"
MASK = "[SECRET]"
DECLARATION = 128
#: Characters from which an unquoted value ends before the next operator.
BARE = 4096

SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9, "apikey": 1.0, "api_key": 1.0, "access_key": 1.0, "secret_key": 1.0,
    "private_key": 1.0, "privatekey": 1.0, "client_secret": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.7, "authorization": 0.9, "bearer": 0.9, "signing_key": 1.0,
    "encryption_key": 1.0, "connection_string": 0.8, "account_key": 1.0, "webhook": 0.7, "salt": 0.6, "signature": 0.5, "session": 0.5, "cookie": 0.5, "cert": 0.5, "key": 0.6,
}
HARMLESS = {"tokenizer", "max", "min", "count", "num", "len", "length", "limit", "size", "public", "type", "field", "label", "hint", "url", "uri", "path", "file", "policy", "expiry", "ttl", "timeout", "id", "name", "prefix", "header", "format", "reset", "required"}
PLACEHOLDER = re.compile(r"(?i)^(?:|x{3,}|\*+|\.+|-+|none|null|nil|undefined|true|false|yes|no|on|off|todo|tbd|changeme|change_me|example\w*|sample\w*|dummy\w*|test|testing|placeholder|(?:your|my)(?:[-_ ]\w*|[a-z]{0,20})|insert\w*|redacted|secret|password|passwd|token|default|string|str|int|required|optional|\$\{?\w+\}?|<[^>]*>|\{\{.*\}\}|%\(?\w+\)?s?|os\.environ.*|process\.env.*|getenv.*|\[SECRET\])$")
SHAPES = [
    ("aws_access_key", 0.9, re.compile(r"\b(?:AKIA|ASIA|AGPA|AIDA|AROA|ANPA)[A-Z0-9]{16}\b")),
    ("github_token", 0.95, re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,255}\b")),
    ("github_pat", 0.95, re.compile(r"\bgithub_pat_[A-Za-z0-9_]{22,255}\b")),
    ("gitlab_token", 0.95, re.compile(r"\bglpat-[A-Za-z0-9_\-]{20,}")),
    ("slack_token", 0.95, re.compile(r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}")),
    ("stripe_key", 0.95, re.compile(r"\b[sr]k_live_[A-Za-z0-9]{16,}\b")),
    ("google_key", 0.9, re.compile(r"\bAIza[A-Za-z0-9_\-]{35}")),
    ("npm_token", 0.95, re.compile(r"\bnpm_[A-Za-z0-9]{36}\b")),
    ("jwt", 0.8, re.compile(r"\beyJ[A-Za-z0-9_\-]{10,}\.eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}")),
]
# what must be in a text for a shape to be looked for
SHAPE_KEYS = {"aws_access_key": ("AKIA", "ASIA", "AGPA", "AIDA", "AROA", "ANPA"), "github_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "github_pat": ("github_pat_",), "gitlab_token": ("glpat-",), "slack_token": ("xox",), "stripe_key": ("k_live_",), "google_key": ("AIza",), "npm_token": ("npm_",), "jwt": ("eyJ",)}

_OPERATOR = re.compile(r"[:=]")
_NAME = re.compile(r"""(?:(["'`])([^"'`\n]{1,80})\1|([A-Za-z_$][\w.$\-]*)(?:\[["']?([\w.\-]+)["']?\])?)[ \t]*$""")
_TYPE = r"[&*\[\]]*(?:'\w+[ \t]+)?(?:(?:mut|const|dyn|readonly|implicit)[ \t]+)?[A-Za-z_][\w.]*(?:::\w+)*(?:<[^=\"\n;]{0,60}>|\[[^=\"\n;]{0,60}\]|\(\w+\))*[?!*&]?"
_TYPED = re.compile(rf"""(?:(["'`])([^"'`\n]{{1,80}})\1|(?<![\w$.\-])([A-Za-z_$][\w$.\-]*))[ \t]*(?:[?!]?:(?!:)[ \t]*({_TYPE}(?:[ \t]*\|[ \t]*{_TYPE})*)|[ \t]({_TYPE}))[ \t]*$""")
_DECLARES = re.compile(r"\b(?:var|const|let|val|declare)[ \t]+@?$", re.I)
TYPES = {"string", "str", "char", "bytes", "byte", "text", "varchar", "nvarchar", "any", "object", "unicode", "rune", "uint8", "u8", "cstring", "securestring", "secretstr", "nsstring", "optional", "option"}
_STRING = r'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|[rbuf]?"(?:\\.|[^"\\\n])*"|[rbuf]?\'(?:\\.|[^\'\\\n])*\'|`[^`\n]*`'
_TERM = re.compile(rf"(?P<quoted>{_STRING})|(?P<bare>[^\s\"'`,;(){{}}\[\]<>&|#]+)")
_QUOTED = re.compile(r"[rbuf]?[\"'`]")
_JOIN = re.compile(r"[ \t]*(?:\+|\.\.|\.(?=[ \t]*[\"'$]))[ \t]*(?:\\?\n[ \t]*)?")
_REFERENCE = re.compile(r"\$\{(\w+)\}|\$(\w+)|%(\w+)%")
_IDENTIFIER = re.compile(r"^[A-Za-z_$][\w.$]*$")
_TAG = re.compile(r"<([A-Za-z_][\w.\-]{0,80})>([^<>\n]+)</\1>")
_FLAG = re.compile(r"(?<![\w\-])--?([A-Za-z][\w\-]{1,60})[ \t]+(\"[^\"\n]*\"|'[^'\n]*'|[^\s\-\"'][^\s\"']*)")
_URL = re.compile(r"\b([a-z][a-z0-9+.\-]{1,20})://([^\s:@/\"']*):([^\s@/\"']+)@")
_BEARER = re.compile(r"(?i)\b(bearer|basic)[ \t]+([A-Za-z0-9_\-.~+/]{16,}=*)")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----([\s\S]*?)(?:-----END \1-----|$)")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


class Pair(NamedTuple):
    start: int
    end: int
    name: str
    literal: str
    kind: str
    uses: tuple[int, ...] = ()  # the pairs whose constants it took


class Finding(NamedTuple):
    start: int
    end: int
    name: str
    kind: str
    literal: str
    score: float


def sensitivity(name: str) -> float:
    """0 to 1: of the most sensitive word, or two words in a row, in a name; halved if a word says that it's about something else."""
    words = [w.lower() for w in _WORDS.findall(name.replace("-", "_"))]
    best = max([SENSITIVE.get(w, SENSITIVE.get(w.rstrip("s"), 0.0)) for w in words] + [SENSITIVE.get(f"{a}_{b}", SENSITIVE.get(a + b, 0.0)) for a, b in zip(words, words[1:])], default=0.0)
    return best * (0.5 if HARMLESS.intersection(words) else 1.0)


def material(literal: str) -> float:
    """0 to 1: how much a literal looks like key material."""
    if len(literal) < 6 or PLACEHOLDER.match(literal):
        return 0.0
    if " " in literal.strip():
        return 0.25 if len(set(literal)) > 12 else 0.0
    counts = Counter(literal)
    entropy = -sum(v / len(literal) * math.log2(v / len(literal)) for v in counts.values())
    kinds = sum(bool(re.search(p, literal)) for p in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9]"))
    score = min(1.0, entropy / 3.2) * min(1.0, 0.6 + len(literal) / 40)
    if kinds == 1:
        score *= 0.55 if len(literal) < 16 else 0.75
    if re.fullmatch(r"[0-9.,:\-/]+", literal):
        score *= 0.5
    return score


def _unquote(s: str) -> str:
    s = s.lstrip("rbuf") if s[:1] in "rbuf" and s[1:2] in "\"'" else s
    for q in ('"""', "'''", '"', "'", "`"):
        if len(s) >= 2 * len(q) and s.startswith(q) and s.endswith(q):
            return s[len(q) : -len(q)]
    return s


def _typed(text: str, low: int, at: int) -> tuple[str, str] | None:
    """The name and the type, if a typed declaration ends at an equals sign."""
    low = max(low, text.rfind("\n", low, at) + 1)
    line = text[low:at].rstrip(" \t")
    if ":" not in line and " " not in line and "\t" not in line:
        return None
    m = _TYPED.search(line)
    if m is None:
        return None
    name, kind = m.group(2) or m.group(3), m.group(4) or m.group(5)
    if m.group(4) is None and not _DECLARES.search(line, 0, m.start()) and not TYPES.intersection(re.findall(r"\w+", kind.lower())):
        return None
    return (name, kind) if sensitivity(name) >= sensitivity(kind) else None


def _term(text: str, at: int) -> re.Match | None:
    """The term that begins here."""
    if _QUOTED.match(text, at) is None and (term := _TERM.match(text, at, at + BARE + 1)) is not None and term.end() > at + BARE:
        to = _OPERATOR.search(text, at + 1)
        return _TERM.match(text, at, to.start()) if to else _TERM.match(text, at)
    return _TERM.match(text, at)


def _begin(text: str, at: int, near: int) -> int:
    """Where to look for the name before an operator: from `near`, or from where a longer name begins."""
    s = at
    while s and text[s - 1] in " \t":
        s -= 1
    while s and (text[s - 1].isalnum() or text[s - 1] in "_.$-[]\"'"):
        s -= 1
    return s if s < near else near


def lex(text: str) -> list[Pair]:
    """Name-literal pairs in text order, with constants propagated."""
    pairs: list[Pair] = []
    symbols: dict[str, int] = {}
    uses: list[int] = []

    def put(m: re.Match) -> str:
        name = next(g for g in m.groups() if g)
        if name not in symbols:
            return m.group()
        uses.append(symbols[name])
        return pairs[symbols[name]].literal

    done = 0
    for op in _OPERATOR.finditer(text):
        at = op.start()
        if at < done:
            continue
        near = max(0, at - DECLARATION)
        low = _begin(text, at, near)
        name = _NAME.search(text, low, at) if at else None
        if name is None and at and text[at - 1] in ":?+|" and at > 1:  # := ?= += ||=
            name = _NAME.search(text[_begin(text, at - 1, near) : at - 1])
        typed = _typed(text, near, at) if text[at] == "=" and text[at + 1 : at + 2] not in ("=", ">") else None
        if name is None and typed is None:
            continue
        target = name and (name.group(2) or name.group(4) or name.group(3))
        end = at + 1
        if text[end : end + 1] in ("=", ">"):  # == compares, => assigns
            if text[end] == "=" and text[at] == "=":
                continue
            end += 1
        if text[at : at + 3] == "://":
            continue
        while text[end : end + 1] in (" ", "\t"):
            end += 1
        value, first, kind, known = None, end, "assignment", False
        uses.clear()
        while (term := _term(text, end)) is not None:
            if term.group("quoted") is not None:
                piece = _REFERENCE.sub(put, _unquote(term.group("quoted")))
                end, known = term.end(), True
            else:
                piece, end = term.group("bare"), term.end()
                if value is None and piece.lower() in ("bearer", "basic"):
                    break
                plus = piece.find("+")
                if plus > 0 and _IDENTIFIER.match(piece[:plus]):
                    piece, end = piece[:plus], term.start() + plus
                trimmed = piece.rstrip(".,:!?*$%")
                end -= len(piece) - len(trimmed)
                piece = _REFERENCE.sub(put, trimmed)
                if _IDENTIFIER.match(piece) and piece in symbols:
                    uses.append(symbols[piece])
                    piece, kind, known = pairs[symbols[piece]].literal, "propagated", True
            value = (value or "") + piece
            joint = _JOIN.match(text, end)
            if joint is None or joint.end() == end:
                break
            kind, end = "propagated", joint.end()
        if typed and known:  # an unknown word is a reference there
            target = typed[0]
        if value and target:
            symbols[target] = len(pairs)
            if typed and known and name is not None and typed[1].islower() and typed[1].isidentifier() and typed[1] not in TYPES:  # it may have been a name
                symbols[typed[1]] = len(pairs)
            pairs.append(Pair(first, end, target, value, kind, tuple(uses)))
            done = end if kind == "propagated" or text[first : first + 1] in "\"'`" else at + 1
    if "<" in text:
        pairs += [Pair(m.start(2), m.end(2), m.group(1), m.group(2), "tag") for m in _TAG.finditer(text)]
    if "--" in text or " -" in text:
        pairs += [Pair(m.start(2), m.end(2), m.group(1), _unquote(m.group(2)), "flag") for m in _FLAG.finditer(text)]
    if "://" in text:
        pairs += [Pair(m.start(3), m.end(3), "password", m.group(3), "url") for m in _URL.finditer(text)]
    low = text.lower()
    if "bearer" in low or "basic" in low:
        pairs += [Pair(m.start(2), m.end(2), "authorization", m.group(2), "header") for m in _BEARER.finditer(text)]
    if "-----BEGIN" in text:
        pairs += [Pair(m.start(), m.end(), "private_key", m.group(2), "pem") for m in _PEM.finditer(text)]
    return pairs


def scan(text: str, threshold: float = THRESHOLD) -> list[Finding]:
    """The findings of a text in text order, without overlaps."""
    found = []
    if ":" in text or "=" in text or "<" in text or "-" in text or "earer" in text:
        pairs = lex(text)
        for p in pairs:
            if (s := sensitivity(p.name)) and p.kind == "pem":
                found.append(Finding(p.start, p.end, p.name, "pem", p.literal, 1.0))
            elif s and (score := s * material(p.literal)) >= threshold:
                found.append(Finding(p.start, p.end, p.name, p.kind, p.literal, score))
                for q in map(pairs.__getitem__, p.uses):  # the constant that the secret is, or begins with
                    if material(q.literal) > 0:
                        found.append(Finding(q.start, q.end, q.name, "constant", q.literal, score))
    for kind, score, shape in SHAPES:
        if any(k in text for k in SHAPE_KEYS[kind]):
            found += [Finding(m.start(), m.end(), "", kind, m.group(), score) for m in shape.finditer(text)]
    taken: list[Finding] = []
    starts: list[int] = []
    for f in sorted(set(found), key=lambda f: (-f.score, f.start - f.end, f.start)):
        k = bisect(starts, f.start)
        if (not k or taken[k - 1].end <= f.start) and (k == len(taken) or taken[k].start >= f.end):
            starts.insert(k, f.start)
            taken.insert(k, f)
    return taken


def masked(text: str, threshold: float = THRESHOLD) -> str:
    """The text with each finding's characters replaced; quotes stay."""
    out, at = [], 0
    for f in scan(text, threshold):
        inner = text[f.start : f.end]
        q = inner[0] if len(inner) > 1 and inner[0] in "\"'`" and inner[-1] == inner[0] else ""
        out += [text[at : f.start], q, MASK, q]
        at = f.end
    return "".join([*out, text[at:]]) if out else text


def find(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each finding; the literal is given as its SHA-256, never in clear."""
    import hashlib

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for i, t in enumerate(batch.column(1).to_pylist()):
            rows += [(i, f.start, f.end, f.name, f.kind, hashlib.sha256(f.literal.encode("utf-8", "replace")).hexdigest(), round(f.score, 6)) for f in scan(t, threshold)]
        if rows:
            at, *rest = zip(*rows)
            types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(at))), *(pa.array(c, k) for c, k in zip(rest, types))], ["doc_id", "start_at", "end_at", "name", "kind", "sha256", "score"])

    return map_rows(docs, [F.col("doc_id").cast("bigint").alias("doc_id"), clean_text("text").alias("text")], SCHEMA, run)


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns; findings in `text` are masked and `n_chars`, where there is such a column, is counted again for the rows that change."""

    @F.arrow_udf("string")
    def clean(text: pa.Array) -> pa.Array:
        return pa.array([masked(t, threshold) if t is not None else None for t in text.to_pylist()], pa.string())

    columns = docs.columns
    new = "".join(columns) + "_"  # no column has this name
    out = docs.withColumn(new, clean(F.col("text")))
    changed = ~F.col(new).eqNullSafe(F.col("text"))
    pick = {"text": F.col(new), "n_chars": F.when(changed, F.length(new).cast("bigint")).otherwise(F.col("n_chars"))} if "n_chars" in columns else {"text": F.col(new)}
    return out.select(*(pick[c].alias(c) if c in pick else F.col(f"`{c}`") for c in columns))
