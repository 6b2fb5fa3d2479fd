"""SentencePiece encoding and decoding: Viterbi over piece scores, streaming.

`Codec.stream` walks over a text of any length and keeps a window of scores that is bounded by the longest piece: no piece that
begins later reaches further back. When all surviving backpointer paths meet in one boundary, the ids before it are committed and
the backpointers before it go. Only while two paths stay apart do backpointers stay, at 8 bytes a character; whether paths have met is looked for
when their number has doubled, so time is linear in the text, whatever it is. Places that no piece of the vocabulary straddles (such as the one before a word mark, or around a
character that only single-character pieces have) are such boundaries for any text: texts are cut there first and the
parts' ids are remembered by each worker, in a store of bounded size. Short parts of many texts that aren't remembered go through the same steps
together, with the pieces in a trie of arrays; long ones are streamed one at a time.

The result is the segmentation with the highest sum of the model's piece scores (the public model file says BPE: merging
pairs gives other ids, but both decode to the same text). Among equal sums the one wins whose last piece starts first. Characters that no piece covers become their bytes' pieces; if the model has
none, the unknown id.

Null and empty texts have no ids; they decode to empty texts. An empty table gives no rows. Repeated rows are each encoded; other columns are ignored. Decoding is exact, but for the word mark U+2581
in a text, which comes back as a space, and for lone surrogates and ids of control symbols, which give nothing.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from heapq import heapify, heappop, heapreplace
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import clean_text, map_rows, slices

MARK = "▁"
#: Parts of texts in a generation of what a worker remembers; it has two.
REMEMBER = 150_000
#: Longest part that is remembered, and encoded together with others.
REMEMBER_CHARS = 64
#: UTF-8 bytes of texts that are encoded at once; a longer text is taken in windows of so many characters.
TOGETHER = 1 << 20
SCHEMA = "doc_id bigint, n_ids int, ids array<int>, exact boolean"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Parts:
    """Ids of parts, as bytes of 32-bit integers. What a full generation had stays for another one."""

    def __init__(self, codec: Codec) -> None:
        self.codec = codec
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __len__(self) -> int:
        return len(self.young)

    def join(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of texts, given as their parts."""
        distinct = set().union(*texts)
        unseen = distinct.difference(self.young)
        if len(self.young) + len(unseen) > REMEMBER:
            self.old, self.young, unseen = self.young, {}, distinct
        new = list(unseen.difference(self.old))
        for part in unseen.difference(new):
            self.young[part] = self.old[part]
        short = [part for part in new if len(part) <= REMEMBER_CHARS]
        self.young.update(zip(short, self.codec.together(short)))
        long = {part: self.codec.alone(part) for part in new if len(part) > REMEMBER_CHARS} if len(short) < len(new) else {}
        self.young.update(long)
        out = [b"".join(map(self.young.__getitem__, parts)) for parts in texts]
        for part in long:
            del self.young[part]
        if len(self.young) > REMEMBER:
            self.young = {}
        return out


@dataclass
class _Trie:
    """The child of `slot` by a character is base[slot] + its code, if owner has slot there. The root's slot is 0, its base too; code 0 is for characters that no piece has."""

    code: np.ndarray
    base: np.ndarray
    owner: np.ndarray
    piece: np.ndarray  # ids; -2 where no piece ends
    score: np.ndarray

    @classmethod
    def of(cls, starts: dict[str, tuple[int, float] | None]) -> _Trie:
        code = {c: k for k, (c, _) in enumerate(Counter(p[-1] for p in starts).most_common(), 1)}
        children: dict[str, list[int]] = {"": []}
        for p in starts:
            children.setdefault(p[:-1], []).append(code[p[-1]])
        used, at, base = bytearray(len(code) + 1), 1, {"": 0}
        for k in (0, *children.pop("")):
            used[k] = 1
        for p, codes in sorted(children.items(), key=lambda x: -len(x[1])):  # only children fill the gaps that the others leave
            first, *more = sorted(codes)
            slot = max(at, first + 1) - 1 if more else first
            while True:
                slot = used.find(0, slot + 1)
                if slot < 0 or slot + max(codes) - first >= len(used):
                    slot = len(used) - 1 if slot < 0 else slot - 1
                    used += bytes(len(used) + max(codes))
                    continue
                for k in more:
                    if used[slot - first + k]:
                        break
                else:
                    break
            base[p], at = slot - first, slot if more else at
            for k in codes:
                used[base[p] + k] = 1
        slots = {p: base[p[:-1]] + code[p[-1]] for p in starts}
        size = max(slots.values(), default=0) + len(code) + 1
        out = cls(np.zeros(0x110000, np.uint16 if len(code) < 1 << 16 else np.int32), np.zeros(size, np.int64), np.full(size, -1), np.full(size, -2, np.int32), np.full(size, -np.inf))
        for c, k in code.items():
            out.code[ord(c)] = k
        for p, slot in slots.items():
            out.owner[slot] = slots.get(p[:-1], 0)
            out.base[slot] = base.get(p, 0)
            if starts[p] is not None:
                out.piece[slot], out.score[slot] = starts[p]
        return out


@dataclass
class Codec:
    """pieces: normal pieces' id and score. bytes_: ids of the 256 byte pieces, or empty. text: each id's bytes when decoded."""

    pieces: dict[str, tuple[int, float]]
    bytes_: list[int]
    unknown: int
    text: list[bytes]
    dummy_prefix: bool = True
    parts: _Parts = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.parts = _Parts(self)
        self.longest = max(map(len, self.pieces), default=1)
        self.bad = min((s for _, s in self.pieces.values()), default=0.0) - 10.0
        self.starts: dict[str, tuple[int, float] | None] = {}  # pieces, and None for what only pieces start with
        for p in self.pieces:
            for k in range(1, len(p)):
                self.starts.setdefault(p[:k], None)
            self.starts[p] = self.pieces[p]

    @classmethod
    def load(cls, path: str) -> Codec:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        pieces = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in range(n) if not special[i]}
        found = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        text = [sp.id_to_piece(i).replace(MARK, " ").encode() if not special[i] else b"" for i in range(n)]
        for b, i in found.items():
            text[i] = bytes([b])
        return cls(pieces, [found[b] for b in range(256)] if len(found) == 256 else [], sp.unk_id(), text)

    @cached_property
    def trie(self) -> _Trie:
        return _Trie.of(self.starts)

    @cached_property
    def cuts(self) -> re.Pattern:
        """Matches parts of a text; no piece straddles the places between them."""
        inner = any(MARK in p.lstrip(MARK) for p in self.pieces)  # a mark after another character
        lines = any("\n" in p and len(p) > 1 for p in self.pieces)
        if inner:
            return re.compile(r"[\s\S]+")
        return re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if lines else re.compile(f"\\n|{MARK}*[^{MARK}\\n]+|{MARK}+")

    def marked(self, text: str) -> str:
        return (MARK if self.dummy_prefix and text else "") + text.replace(" ", MARK)

    def stream(self, text: str) -> Iterator[int]:
        """Ids of a marked text, each given out as soon as it is certain."""
        starts, n, no = self.starts, len(text), -1e300
        score, first = [0.0], 0  # of the best path to first + k
        begin, piece = array("q", [0]), array("i", [-1])  # the start and id of the last piece of the best path to base + k; -2: an uncovered character
        base, window = 0, 2 * self.longest
        due = window
        for i in range(n):
            if i - first >= window:
                del score[: i - first]
                first = i
            k = i - first
            here, end = score[k], i + 1
            single = False
            while end <= n and (part := text[i:end]) in starts:
                p = starts[part]
                if p is not None:
                    if end == i + 1:
                        single = True
                    s, at = here + p[1], end - first
                    while len(score) <= at:
                        score.append(no)
                        begin.append(i)
                        piece.append(-2)
                    if s > score[at]:
                        score[at], begin[end - base], piece[end - base] = s, i, p[0]
                end += 1
            if not single:
                if len(score) == k + 1:
                    score.append(no)
                    begin.append(i)
                    piece.append(-2)
                if here + self.bad > score[k + 1]:
                    score[k + 1], begin[i + 1 - base], piece[i + 1 - base] = here + self.bad, i, -2
            if i - base >= due and i + 1 < n:
                # survivors: the positions that later pieces can start from
                heads = [-j for j in range(i + 1, first + len(score)) if score[j - first] > no]
                heapify(heads)
                while len(heads) > 1:
                    last = -heads[0]
                    heapreplace(heads, -begin[last - base])
                    while len(heads) > 1 and heads[0] in (heads[1], heads[2] if len(heads) > 2 else None):
                        heappop(heads)
                meet = -heads[0]
                if meet > base:
                    yield from self._path(text, begin, piece, base, meet)
                    del begin[: meet - base], piece[: meet - base]
                    base, due = meet, window
                else:
                    due = 2 * (i - base)
        yield from self._path(text, begin, piece, base, n)

    def _path(self, text: str, begin: array, piece: array, base: int, end: int) -> list[int]:
        out: list[int] = []
        while end > base:
            start, i = begin[end - base], piece[end - base]
            if i >= 0:
                out.append(i)
            elif self.bytes_:
                out += [self.bytes_[b] for b in reversed(text[start:end].encode("utf-8", "replace"))]
            else:
                out.append(self.unknown)
            end = start
        return out[::-1]

    def alone(self, part: str) -> bytes:
        return np.fromiter(self.stream(part), np.int32).tobytes()

    def together(self, parts: list[str]) -> list[bytes]:
        """As alone() for each, by the same sums and comparisons in the same order, but each step takes all parts at once."""
        if not parts:
            return []
        trie, no = self.trie, -1e300
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        order = np.argsort(-size, kind="stable")
        first, size = (np.cumsum(size) - size)[order], size[order]
        codes = trie.code[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        longest = int(size[0])
        wide = np.searchsorted(-size, -np.arange(longest + 1), side="right")  # the longest parts come first: so many have k characters
        char = [codes[first[:w] + k].astype(np.int64) for k, w in enumerate(wide[1:])]
        rows = np.cumsum(wide) - wide
        begin, piece = np.zeros(int(wide.sum()), np.int16), np.full(int(wide.sum()), -2, np.int32)
        score = [np.zeros(len(parts))] + [np.full(w, no) for w in wide[1:]]
        top = trie.owner[: int(trie.code.max()) + 1] == 0  # by code: some piece begins with it
        one = np.where(top & (trie.piece[: len(top)] >= 0), trie.piece[: len(top)], -2)
        one_score = np.where(one >= 0, trie.score[: len(top)], self.bad)
        for i in range(longest):
            slot, w = char[i], wide[i + 1]
            here = score[i][:w]
            s = here + one_score[slot]
            better = np.flatnonzero(s > score[i + 1])
            score[i + 1][better] = s[better]
            begin[rows[i + 1] + better], piece[rows[i + 1] + better] = i, one[slot[better]]
            which = np.flatnonzero(top[slot])
            slot, here = slot[which], here[which]
            for end in range(i + 2, longest + 1):
                n = np.searchsorted(which, wide[end])
                which, slot, here = which[:n], slot[:n], here[:n]
                child = trie.base[slot] + char[end - 1][which]
                there = np.flatnonzero(trie.owner[child] == slot)
                if not len(there):
                    break
                which, slot, here = which[there], child[there], here[there]
                s = here + trie.score[slot]
                better = np.flatnonzero(s > score[end][which])
                if len(better):
                    at = which[better]
                    score[end][at] = s[better]
                    begin[rows[end] + at], piece[rows[end] + at] = i, trie.piece[slot[better]]
        at, left, steps = size.copy(), np.arange(len(parts)), []
        n = np.zeros(len(parts), np.int64)
        while len(left):
            k = rows[at[left]] + left
            steps.append((left, piece[k]))
            n[order[left]] += 1
            at[left] = begin[k]
            left = left[at[left] > 0]
        ends = np.cumsum(n)
        ids = np.empty(int(ends[-1]), np.int32)
        for k, (left, found) in enumerate(steps, 1):
            ids[ends[order[left]] - k] = found
        raw = ids.tobytes()
        out = [raw[a:b] for a, b in pairwise([0, *(4 * ends).tolist()])]
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(ids == -2), side="right")).tolist():  # parts with characters that no piece covers
            out[k] = self.alone(parts[k])
        return out

    def windows(self, text: str) -> Iterator[list[str]]:
        """The parts of a marked text, in runs of at most TOGETHER characters, or one part that is longer."""
        at, most = 0, TOGETHER
        while at < len(text):
            parts, end = self.cuts.findall(text, at, at + most), at + most
            if end < len(text):  # the last part may go on
                end -= len(parts.pop())
            if parts:
                yield parts
                at, most = end, TOGETHER
            else:
                most *= 2

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.parts.join([w])[0] for w in self.windows(self.marked(text))), np.int32)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that together are of a bounded size, or of one of any size."""
        if len(texts) == 1:
            return [self.encode(texts[0])]
        return [np.frombuffer(ids, np.int32) for ids in self.parts.join([self.cuts.findall(self.marked(t)) for t in texts])]

    def decode(self, ids: np.ndarray | list[int]) -> str:
        out = b"".join(map(self.text.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")
        return out[1:] if self.dummy_prefix and out[:1] == " " else out


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each model and worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec.load(path)
    return _CODECS[path]


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_ids, ids, exact) for every row; exact: the ids decode to the text."""
    path = model or default_model()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for a, b in slices(pc.binary_length(batch.column(1)).to_numpy(), TOGETHER):
            part = batch.slice(a, b - a)
            texts = part.column(1).to_pylist()
            ids = c.encode_all(texts)
            same = [c.decode(x) == (t.replace(MARK, " ") if MARK in t else t) for x, t in zip(ids, texts)]
            n = np.array([len(x) for x in ids], np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), lists, pa.array(same)], ["doc_id", "n_ids", "ids", "exact"])

    return map_rows(docs, [F.col("doc_id").cast("bigint").alias("doc_id"), clean_text("text").alias("text")], SCHEMA, run)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""
    path = model or default_model()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        texts = [c.decode(x) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_rows(encoded, [F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids")], "doc_id bigint, text string", run)
