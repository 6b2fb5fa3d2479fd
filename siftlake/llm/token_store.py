"""Token ids in binary blocks: an adaptive context-mixing range coder.

Documents are encoded with a public byte-level tokenizer, and their ids, in the order of a partition, cut into blocks of `BLOCK`. Each
block is coded on its own: all models start anew, and a checksum of the ids tells whether it was read right.

A model of each order predicts ids. Order 2 and order 1 predict the id that last followed the same two or one ids in the
block; order 0 has the frequencies of the block's ids so far, mixed with all ids of the vocabulary. The three are mixed
into one distribution: the weights are the rates at which each order was right before, in the same state (how often the contexts of either order have been
seen, whether they were last right, and whether the two agree). Rates and frequencies are brought up to date at the steps in `steps`, so a
batch of blocks can be modelled with array operations; the range coder itself goes through many blocks side by side. It
has 64 bits, gives 16 at a time and never carries; totals are a power of two.

A row is a block: `pieces` says which ids of which documents it holds. Null and empty texts have no ids and one piece of length 0. Null
document ids are kept as null, repeated rows each as pieces of their own. Very long documents go over many blocks. Other columns are
ignored. Ids must be from 0 up to the vocabulary's size. A block whose ids don't have its checksum raises ValueError.
"""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import clean_text

BLOCK = 8192
#: Blocks that are coded side by side.
LANES = 1024
#: Blocks that are modelled at once; their arrays fit into a processor's cache.
_ROWS = 8
VOCABULARY = 50_257
SCHEMA = "pieces array<struct<doc_id:bigint,start:int,n:int>>, n_ids int, n_bytes int, block binary"

_BITS = 30
_TOTAL = 1 << _BITS
_SPARE = 1 << 22  # part of the total that is spread over the whole vocabulary in any case
_TOP, _LOW = np.uint64(1 << 48), np.uint64(1 << 32)
_HEAD = struct.Struct("<2sHIII")
_MAGIC = b"tb"
#: Counts, as of a quarter event, that each state starts with: order 2 right, only order 1 right, neither.
_PRIOR = (2, 1, 3)


def steps(n: int) -> np.ndarray:
    """Where the models are brought up to date: at powers of two, then each 512 ids."""
    return np.array([0, 16, 32, 64, 128, 256, *range(512, max(n, 1), 512)], np.int64)


def _history(context: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For contexts (rows, positions; negative: none): the id after the last equal context (or -1), and the state 0 to 7."""
    rows, n = ids.shape
    shift = max(1, int(n - 1).bit_length())
    packed = (context << shift | np.arange(n, dtype=np.int64)).reshape(rows, n)
    packed.sort(axis=1)
    at = (packed & ((1 << shift) - 1)) + (np.arange(rows, dtype=np.int64) * n)[:, None]
    packed >>= shift
    at, key = at.reshape(-1), packed.reshape(-1)
    same = np.zeros(rows * n, bool)  # rows go on in one another here
    np.equal(key[1:], key[:-1], out=same[1:])
    same &= key >= 0
    same[::n] = False
    position = np.arange(rows * n, dtype=np.int32)
    begin = np.where(same, 0, position)
    np.maximum.accumulate(begin, out=begin)
    rank = np.minimum(position - begin, 3)
    value = ids.reshape(-1)[at]
    last = np.full(rows * n, -1, np.int32)
    np.copyto(last[1:], value[:-1], where=same[1:])
    before = np.zeros(rows * n, np.int32)
    before[1:] = last[:-1] == value[:-1]
    rank *= 2
    rank += before
    rank *= same
    predicted, states = np.empty(rows * n, np.int32), np.empty(rows * n, np.int32)
    predicted[at], states[at] = last, rank
    return predicted.reshape(rows, n), states.reshape(rows, n)


def _frequencies(ids: np.ndarray, size: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """(cumulative, frequency) of each id under the mixed models, out of 2**_BITS; positions beyond a row's size get the whole."""
    rows, n = ids.shape
    edges = steps(n)
    chunk = np.searchsorted(edges, np.arange(n), "right") - 1
    wide = ids.astype(np.int64)
    one, two = np.full((rows, n), -1, np.int64), np.full((rows, n), -1, np.int64)
    one[:, 1:] = wide[:, :-1]
    two[:, 2:] = wide[:, :-2] << 20 | wide[:, 1:-1]
    p1, s1 = _history(one, ids)
    p2, s2 = _history(two, ids)
    some2 = p2 >= 0
    agree = (p1 == p2) & some2
    some1 = (p1 >= 0) & ~agree
    hit2, hit1 = p2 == ids, (p1 == ids) & some1
    inside = np.arange(n) < size[:, None]
    place = ((s2 << 3 | s1) << 1 | agree) + ((np.arange(rows, dtype=np.int32)[:, None] * len(edges) + chunk.astype(np.int32)) << 7)
    seen = np.bincount((place * 3 + 2 - hit1 - 2 * hit2)[inside], minlength=rows * len(edges) * 384).reshape(rows, len(edges), 384)
    rate = (4 * (np.cumsum(seen, 1) - seen).reshape(-1, 3) + np.array(_PRIOR)).astype(np.int32)
    a2, a1, a0 = rate[:, 0][place] * some2, rate[:, 1][place] * some1, rate[:, 2][place]
    rest, total = _TOTAL - _SPARE, a2 + a1 + a0
    w2, w1 = rest * a2.astype(np.int64) // total, rest * a1.astype(np.int64) // total
    below, count = np.zeros((rows, n), np.int32), np.zeros((rows, n), np.int32)
    new = np.zeros((rows, len(edges)), np.int64)
    rank = np.zeros(vocabulary, np.int32)
    for r in range(rows):
        k = size[r]
        rank[:] = 0
        rank[ids[r, :k]] = 1
        np.cumsum(rank, out=rank)
        local, letters = rank[ids[r, :k]] - 1, int(rank[-1])
        at = chunk[:k] * letters + local
        table = np.bincount(at, minlength=len(edges) * letters).astype(np.int32).reshape(len(edges), -1)
        table = np.cumsum(table, 0, dtype=np.int32) - table
        new[r] = (table > 0).sum(1)
        count[r, :k], below[r, :k] = table.reshape(-1)[at], (np.cumsum(table, 1, dtype=np.int32) - table).reshape(-1)[at]
    n0 = edges[chunk]
    w0 = rest - w2 - w1
    each = w0 * n0 // (n0 + new[:, chunk] + 1) // np.maximum(n0, 1)
    base = (w0 + _SPARE - each * n0) // vocabulary
    frequency = w2 * hit2 + w1 * hit1 + each * count + base
    cumulative = w2 * (some2 & (p2 < ids)) + w1 * (some1 & (p1 < ids)) + each * below + base * ids
    frequency[~inside], cumulative[~inside] = _TOTAL, 0
    return cumulative, frequency


def encode_blocks(blocks: list[np.ndarray], vocabulary: int = VOCABULARY) -> list[bytes]:
    """Codes blocks of ids side by side."""
    if not blocks:
        return []
    size = np.array([len(b) for b in blocks])
    n, rows = int(size.max()), len(blocks)
    cumulative, frequency = np.zeros((n, rows), np.uint32), np.full((n, rows), _TOTAL, np.uint32)
    for r in range(0, rows if n else 0, _ROWS):
        ids = np.zeros((len(blocks[r : r + _ROWS]), n), np.int32)
        for i, b in enumerate(blocks[r : r + _ROWS]):
            ids[i, : len(b)] = b
        c, f = _frequencies(ids, size[r : r + _ROWS], vocabulary)
        cumulative[:, r : r + _ROWS], frequency[:, r : r + _ROWS] = c.T, f.T
    out = np.zeros((3 * n + 8, rows), np.uint16)
    low, span, at = np.zeros(rows, np.uint64), np.full(rows, (1 << 64) - 1, np.uint64), np.zeros(rows, np.int64)
    bits, word, top, keep, flat, lanes = np.uint64(_BITS), np.uint64(16), np.uint64(48), _LOW - np.uint64(1), out.reshape(-1), np.arange(rows)
    with np.errstate(over="ignore"):
        for t in range(n):
            span >>= bits
            low += cumulative[t] * span
            span *= frequency[t]
            go = (low ^ (low + span)) < _TOP
            go |= span < _LOW
            k = go.nonzero()[0]
            while k.size:
                v, s = low.take(k), span.take(k)
                cut = s < _LOW
                if cut.any():
                    cut &= (v ^ (v + s)) >= _TOP
                    s[cut] = (np.uint64(0) - v[cut]) & keep
                where = at.take(k)
                flat[where * rows + k] = v >> top
                at[k] = where + 1
                v <<= word
                s <<= word
                low[k] = v
                span[k] = s
                v ^= v + s
                k = k[(v < _TOP) | (s < _LOW)]
        for _ in range(4):
            flat[at * rows + lanes] = low >> np.uint64(48)
            at += 1
            low <<= word
    return [_HEAD.pack(_MAGIC, 1, len(b), vocabulary, zlib.crc32(b.astype("<i4").tobytes())) + out[: at[r], r].astype("<u2").tobytes() for r, b in enumerate(blocks)]


def decode_block(data: bytes) -> np.ndarray:
    """The ids of a block; ValueError if they don't have its checksum."""
    magic, version, n, vocabulary, check = _HEAD.unpack_from(data)
    if magic != _MAGIC or version != 1:
        raise ValueError("not a block of token ids")
    words = np.frombuffer(data, "<u2", offset=_HEAD.size).tolist()
    words += [0] * 8
    mask, top, tight = (1 << 64) - 1, 1 << 48, 1 << 32
    code = words[0] << 48 | words[1] << 32 | words[2] << 16 | words[3]
    at, low, span = 4, 0, mask
    ids: list[int] = []
    edges = {int(e) for e in steps(n)}
    last: tuple[dict, dict] = ({}, {})  # context -> [id, times, right]
    counts, fresh = np.zeros(vocabulary, np.int64), []
    below: list[int] = [0] * (vocabulary + 1)
    rates: dict[int, list[int]] = {}
    events: list[tuple[int, int]] = []
    n0 = new = 0
    for t in range(n):
        if t in edges and t:
            np.add.at(counts, fresh, 1)
            below, n0, new, fresh = [0, *np.cumsum(counts).tolist()], t, int((counts > 0).sum()), []
            for s, o in events:
                rates.setdefault(s, list(_PRIOR))[o] += 4
            events = []
        contexts = (ids[-1] if t > 0 else None, (ids[-2], ids[-1]) if t > 1 else None)
        p, s = [-1, -1], [0, 0]
        for k in (0, 1):
            h = last[k].get(contexts[k]) if contexts[k] is not None else None
            if h is not None:
                p[k], s[k] = h[0], min(h[1], 3) * 2 + h[2]
        p1, p2 = p
        agree = p1 == p2 >= 0
        state = (s[1] << 3 | s[0]) << 1 | agree
        a = rates.get(state, _PRIOR)
        a2, a1, a0 = a[0] * (p2 >= 0), a[1] * (p1 >= 0 and not agree), a[2]
        rest, total = _TOTAL - _SPARE, a2 + a1 + a0
        w2, w1 = rest * a2 // total, rest * a1 // total
        w0 = rest - w2 - w1
        each = w0 * n0 // (n0 + new + 1) // n0 if n0 else 0
        base = (w0 + _SPARE - each * n0) // vocabulary
        span >>= _BITS
        v = ((code - low) & mask) // span if span else 0
        x, add = -1, 0
        for q, w in sorted([(p2, w2)] * (p2 >= 0) + [(p1, w1)] * (p1 >= 0 and not agree)):
            g = each * below[q] + base * q
            if v - add < g:
                break
            if v - add < g + w + each * (below[q + 1] - below[q]) + base:
                x = q
                start, freq = add + g, w + each * (below[q + 1] - below[q]) + base
                break
            add += w
        if x < 0:
            lo, hi = 0, vocabulary - 1
            while lo < hi:
                mid = (lo + hi + 1) >> 1
                if each * below[mid] + base * mid <= v - add:
                    lo = mid
                else:
                    hi = mid - 1
            x, start, freq = lo, add + each * below[lo] + base * lo, each * (below[lo + 1] - below[lo]) + base
        low, span = (low + start * span) & mask, (span * freq) & mask
        while (low ^ ((low + span) & mask)) < top or span < tight:
            if (low ^ ((low + span) & mask)) >= top:
                span = -low & (tight - 1)
            code = (code << 16 | (words[at] if at < len(words) else 0)) & mask
            at, low, span = at + 1, (low << 16) & mask, (span << 16) & mask
        events.append((state, 0 if x == p2 else 1 if x == p1 and not agree else 2))
        for k in (0, 1):
            if contexts[k] is not None:
                h = last[k].get(contexts[k])
                if h is None:
                    last[k][contexts[k]] = [x, 1, 0]
                else:
                    h[2], h[1], h[0] = int(h[0] == x), h[1] + 1, x
        ids.append(x)
        fresh.append(x)
    out = np.array(ids, np.int32)
    if zlib.crc32(out.astype("<i4").tobytes()) != check:
        raise ValueError("a block's ids don't have its checksum")
    return out


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_TOKENIZERS: dict[str, object] = {}


def tokenizer(path: str):
    """One for each file and worker."""
    if path not in _TOKENIZERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _TOKENIZERS[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _TOKENIZERS[path]


def store(docs: DataFrame, ranks: str | None = None, block: int = BLOCK, lanes: int = LANES) -> DataFrame:
    """A row for each block of a partition's ids."""
    path = ranks or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_ordinary
        full: list[tuple[np.ndarray, list[dict]]] = []
        parts: list[np.ndarray] = []
        pieces: list[dict] = []
        room = block

        def flush() -> pa.RecordBatch:
            coded = encode_blocks([b for b, _ in full])
            out = pa.RecordBatch.from_arrays(
                [pa.array([p for _, p in full], kind), pa.array([len(b) for b, _ in full], pa.int32()), pa.array([len(c) for c in coded], pa.int32()), pa.array(coded, pa.binary())],
                ["pieces", "n_ids", "n_bytes", "block"],
            )
            full.clear()
            return out

        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32())]))
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array(encode(text), np.int32)
                start = 0
                while True:
                    n = min(room, len(ids) - start)
                    parts.append(ids[start : start + n])
                    pieces.append({"doc_id": doc, "start": start, "n": n})
                    start, room = start + n, room - n
                    if not room:
                        full.append((np.concatenate(parts), pieces))
                        parts, pieces, room = [], [], block
                        if len(full) == lanes:
                            yield flush()
                    if start == len(ids):
                        break
        if pieces:
            full.append((np.concatenate(parts), pieces))
        if full:
            yield flush()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), clean_text("text").alias("text")).mapInArrow(run, SCHEMA)


def load(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of each piece of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pieces, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, at, out = decode_block(data), 0, []
                for p in pieces:
                    out.append((p["doc_id"], p["start"], ids[at : at + p["n"]]))
                    at += p["n"]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    return blocks.select("pieces", "block").mapInArrow(run, "doc_id bigint, start int, ids array<int>")
