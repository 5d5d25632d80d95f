"""Removal of byte strings that also start earlier in the corpus, by suffix arrays of Lyndon groups.

Equal 100-byte windows pick the same anchor, the window's least gram by a hash, so every window is a part of the context
of exactly one anchor: the bytes of all windows that pick it. Contexts of equal anchors meet in one task. Equal contexts
are one context with an earliest place; where an anchor has several different contexts, their suffix array is built, and
neighbours that share at least a window's length, byte by byte, are one class. In a class everything but the earliest
start is repeated.

Texts move twice, to meet the requests for context bytes and the spans to remove; never as pairs of documents.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm.lyndon import suffix_order
from weftlink.llm.shared import buffers, dealt, lean, mix, odd_constants, partitions, ranges, slices, stored, text_of

RECORD = np.dtype([("key", "<u8"), ("ctx", "<u8"), ("doc", "<i8"), ("lo", "<u4"), ("hi", "<u4"), ("tag", "<u4")])
REQUEST = np.dtype([("doc", "<i8"), ("key", "<u8"), ("lo", "<u4"), ("hi", "<u4"), ("tag", "<u4")])
SPAN = np.dtype([("doc", "<i8"), ("lo", "<u4"), ("hi", "<u4"), ("tag", "<u4")])
SPANS, REQUESTS, RECORDS, TEXTS = 1, 2, 3, 9
HOT_SHARES = 65_536  # at most so many anchors are treated as frequent: those with at least this share of all
HOT_LEAST = 1024
_GRAM = 24
_TABLE = odd_constants(256, 101)
_STEP = odd_constants(8, 202)
_LAST = (1 << 63) - 1
BUCKET_BYTES, MOST_TASKS = 12 << 20, 8192  # text of a bucket; tasks that buckets are dealt to, each holding one at a time


def _pack(a: np.ndarray) -> bytes:
    """Columns one after another, so that they compress; level 1, few rows as they are."""
    raw = b"".join([np.int64(len(a)).tobytes(), *[np.ascontiguousarray(a[n]).tobytes() for n in a.dtype.names]])
    return b"z" + zstandard.compress(raw, 1) if len(raw) > 1024 else b"-" + raw


def _unpack(raw: bytes, kind: np.dtype) -> np.ndarray:
    data = zstandard.decompress(raw[1:]) if raw[:1] == b"z" else raw[1:]
    n, at = int(np.frombuffer(data, np.int64, 1)[0]), 8
    out = np.empty(n, kind)
    for name in kind.names:
        d = kind[name]
        out[name] = np.frombuffer(data, d, n, at)
        at += n * d.itemsize
    return out


def _grams(raw: np.ndarray) -> np.ndarray:
    """A hash of the 24 bytes from each position on; the last positions' are of no use."""
    h = _TABLE[raw]
    wide = None
    for s, c in zip((1, 2, 4, 8), _STEP, strict=False):
        if s == 8:
            wide = h
        h2 = h * c
        h2[:-s] += h[s:]
        h = h2
    h2 = h * _STEP[5]  # 16 bytes and the next 8
    h2[:-16] += wide[16:]
    return mix(h2)


def _slide_min(a: np.ndarray, w: int) -> np.ndarray:
    """The least of each position and the ``w`` - 1 after it (fewer at the end)."""
    r, s = a, 1
    while s * 2 <= w:
        r = np.concatenate([np.minimum(r[:-s], r[s:]), r[-s:]])
        s *= 2
    if s < w:
        d = w - s
        r = np.concatenate([np.minimum(r[:-d], r[d:]), r[-d:]])
    return r


def anchors(raw: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first window start, last window start, anchor key, context hash), positions in ``raw``.

    Every window of ``length`` bytes inside a text belongs to the leftmost of its least grams.
    """
    none = np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        size = np.diff(off)
        if len(raw) < length or not (size >= length).any():
            return none, none, none, none.view(np.uint64), none.view(np.uint64)
        gram = min(_GRAM, length)
        g = _grams(raw) if gram == _GRAM else _grams_of(raw, gram)
        order = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(raw), dtype=np.uint64)
        least = _slide_min(order, length - gram + 1)
        start = ranges(off[:-1], np.maximum(size - length + 1, 0))
        at = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]))
        lo = start[cut]
        hi = start[np.append(cut[1:], len(start)) - 1]
        anchor = at[cut]
        text = np.searchsorted(off, lo, "right") - 1
        key = g[anchor]
        ctx = np.empty(len(lo), np.uint64)
        width = -(-(2 * length - gram) // 8) * 8
        pad = np.concatenate([raw, np.zeros(width, np.uint8)])
        view = np.lib.stride_tricks.sliding_window_view(pad, width)
        k = odd_constants(width // 8, 303)
        col = np.arange(width)[None]
        for a in range(0, len(lo), 8192):
            b = slice(a, a + 8192)
            m = np.where(col < (hi[b] - lo[b] + length)[:, None], view[lo[b]], 0)
            words = m.view(np.uint64)
            c = np.zeros(len(m), np.uint64)
            for i in range(width // 8):
                c = (c ^ words[:, i]) * k[i]
                c ^= c >> np.uint64(31)
            ctx[b] = mix(c + ((anchor[b] - lo[b]) * 65536 + (hi[b] - lo[b])).astype(np.uint64))
        return text, lo, hi, key, ctx


def _grams_of(raw: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(len(raw), np.uint64)
    for i in range(n):
        h *= _STEP[0]
        h[: len(raw) - i] += _TABLE[raw[i:]]
    return mix(h)


def _window_hashes(raw: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the ``length`` bytes from each start on."""
    out = np.empty((2, len(starts)), np.uint64)
    for a, words in _windows(raw, starts, length):
        with np.errstate(over="ignore"):
            for seed, h in zip((404, 505), out, strict=True):
                c = np.zeros(len(words), np.uint64)
                for i, k in enumerate(odd_constants(words.shape[1], seed)):
                    c = (c ^ words[:, i]) * k
                    c ^= c >> np.uint64(31)
                h[a : a + len(words)] = mix(c)
    return out[0], out[1]


def _same_windows(raw: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes from each start on are those from the next start on."""
    out = np.zeros(max(len(starts) - 1, 0), bool)
    for a, words in _windows(raw, starts, length, 1):
        out[a : a + len(words) - 1] = (words[1:] == words[:-1]).all(1)
    return out


def _windows(raw: np.ndarray, starts: np.ndarray, length: int, more: int = 0, step: int = 16384):
    """(first, 64-bit words of the windows) of blocks of starts, each with ``more`` of the next block."""
    width = -(-length // 8) * 8
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.zeros(width, np.uint8)]), width)
    for a in range(0, len(starts), step):
        m = view[starts[a : a + step + more]].copy()
        m[:, length:] = 0
        yield a, m.view(np.uint64)


def _batches(batch: pa.RecordBatch, most: int = 1 << 20):
    """(ids with null as the last, null flags, tags, bytes, offsets) of slices of a batch. A text longer than a slice
    stands alone; 32-bit positions hold for any string that Spark can."""
    for b in slices(batch, 1, most):
        ids = b.column(0)
        raw, off = buffers(b.column(1))
        data = raw.tobytes()
        tags = np.array([zlib.crc32(data[s:e]) for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], np.uint32)
        yield ids.fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False), tags, raw, off


def _pieces(raw: np.ndarray, off: np.ndarray, length: int, most: int = 6 << 20):
    """The texts, or for one longer than ``most`` overlapping pieces of it: (bytes, offsets, bytes before the piece)."""
    if len(raw) <= most or len(off) != 2:
        yield raw, off, 0
        return
    for a in range(0, len(raw), most):
        part = raw[a : a + most + length - 1]
        yield part, np.array([0, len(part)]), a


def _hot(length: int):
    """Frequent anchors among the sampled texts: (anchor, number of different contexts in this task); 0: of all, and bytes."""

    def run(batches):
        seen, size = [], 0
        for batch in batches:
            for _, _, _, raw, off in _batches(batch):
                size += len(raw)
                for part, po, _ in _pieces(raw, off, length):
                    _, _, _, key, ctx = anchors(part, po, length)
                    seen.append(np.unique(np.stack([key, ctx], 1), axis=0))
        both = np.unique(np.concatenate(seen), axis=0) if seen else np.zeros((0, 2), np.uint64)
        key, n = np.unique(both[:, 0], return_counts=True)
        keep = n >= 4
        key, n = np.append(key[keep], np.uint64(0)), np.append(n[keep], len(both))
        sizes = np.zeros(len(key), np.int64)
        sizes[-1] = size
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(sizes)], names=["k", "n", "size"])

    return run


def _bucket_rows(bucket: np.ndarray, a: np.ndarray, kind: int):
    """One packed row per bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, a = bucket[order], a[order]
    cut = np.flatnonzero(np.diff(bucket)) + 1
    first = np.concatenate([[0], cut])
    if len(a):
        parts = np.split(a, cut)
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[first].astype(np.int32)), pa.array([kind] * len(parts), pa.int32()), pa.array([_pack(p) for p in parts], pa.binary())], names=["bucket", "kind", "blob"]
        )


def _bucket_of(x: np.ndarray, names: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return names[((mix(x.astype(np.uint64)) >> np.uint64(33)) % np.uint64(len(names))).astype(np.int64)].astype(np.int64)


def _doc_bucket(doc: np.ndarray, tag: np.ndarray, names: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _bucket_of(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + tag.astype(np.uint64), names)


def _in_buckets(batches):
    """(bucket, rows of it) of batches sorted by bucket, one bucket at a time."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        at = b.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        for lo, hi in zip(edges, edges[1:]):
            if held and at[lo] != last:
                yield last, held
                held = []
            last = at[lo]
            held.append(b.slice(lo, hi - lo))
    if held:
        yield last, held


def _to_spans(r: np.ndarray, length: int) -> np.ndarray:
    s = np.empty(len(r), SPAN)
    s["doc"], s["tag"], s["lo"], s["hi"] = r["doc"], r["tag"], r["lo"], r["hi"] + np.uint32(length)
    return s


def _merged(s: np.ndarray) -> np.ndarray:
    """Spans of a document that touch or overlap become one."""
    if len(s) < 2:
        return s
    s = s[np.lexsort((s["lo"], s["tag"], s["doc"]))]
    new_doc = np.concatenate([[True], (s["doc"][1:] != s["doc"][:-1]) | (s["tag"][1:] != s["tag"][:-1])])
    block = np.cumsum(new_doc)
    reach = np.maximum.accumulate(s["hi"].astype(np.int64) + block * (1 << 33))
    fresh = np.concatenate([[True], s["lo"][1:].astype(np.int64) + block[1:] * (1 << 33) > reach[:-1]])
    first = np.flatnonzero(fresh)
    out = s[first].copy()
    out["hi"] = (np.maximum.reduceat(reach, first) - block[first] * (1 << 33)).astype(np.uint32)
    return out


def _emit(length: int, hot: np.ndarray, keys: np.ndarray, docs: np.ndarray, flush: int = 400_000):
    """Texts -> records for the anchors' buckets and, for what repeats inside this task, spans."""

    def settle(held):
        r = np.concatenate(held)
        r = r[np.lexsort((r["lo"], r["doc"], r["ctx"], r["key"]))]
        first = np.concatenate([[True], (r["key"][1:] != r["key"][:-1]) | (r["ctx"][1:] != r["ctx"][:-1])])
        yield from _bucket_rows(_bucket_of(r["key"][first], keys), r[first], RECORDS)
        again = ~first
        if again.any():  # rows that repeat an id are equally early: not repeats of one another
            begin = np.flatnonzero(first)[np.cumsum(first) - 1]
            again &= (r["doc"] != r["doc"][begin]) | (r["lo"] != r["lo"][begin])
            s = _merged(_to_spans(r[again], length))
            yield from _bucket_rows(_doc_bucket(s["doc"], s["tag"], docs), s, SPANS)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for doc, _, tag, raw, off in _batches(batch):
                for part, po, shift in _pieces(raw, off, length):
                    text, lo, hi, key, ctx = anchors(part, po, length)
                    is_hot = np.isin(key, hot) if len(hot) else np.zeros(len(key), bool)
                    if is_hot.any():  # each window of a frequent anchor is a context of its own, spread by its hash
                        w = hi[is_hot] - lo[is_hot] + 1
                        starts = ranges(lo[is_hot], w)
                        h, other = _window_hashes(part, starts, length)
                        cold = ~is_hot
                        text = np.concatenate([text[cold], np.repeat(text[is_hot], w)])
                        lo, hi = np.concatenate([lo[cold], starts]), np.concatenate([hi[cold], starts])
                        key, ctx = np.concatenate([key[cold], h]), np.concatenate([ctx[cold], other])
                    r = np.empty(len(key), RECORD)
                    r["key"], r["ctx"], r["doc"], r["tag"] = key, ctx, doc[text], tag[text]
                    r["lo"], r["hi"] = lo - po[text] + shift, hi - po[text] + shift
                    held.append(r)
                    n += len(r)
                if n >= flush:
                    yield from settle(held)
                    held, n = [], 0
        if n:
            yield from settle(held)

    return run


def _settle_keys(length: int, docs: np.ndarray):
    """Records by bucket -> spans of equal contexts, and requests for the bytes of anchors with several contexts."""

    def run(batches):
        for _, part in _in_buckets(batches):
            held = []
            for b in part:
                kinds = b.column(1).to_numpy(zero_copy_only=False)
                for i in np.flatnonzero(kinds == RECORDS).tolist():
                    held.append(_unpack(b.column(2)[i].as_py(), RECORD))
                rest = b.filter(pa.array(kinds != RECORDS))
                if rest.num_rows:
                    yield rest
            if held:
                yield from settle(np.concatenate(held))

    def settle(r):
        r = r[np.argsort(r["key"], kind="stable")]
        same = r["key"][1:] == r["key"][:-1]
        twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        r = r[twice]
        r = r[np.lexsort((r["lo"], r["doc"], r["ctx"], r["key"]))]
        if not len(r):
            return
        new_key = np.concatenate([[True], r["key"][1:] != r["key"][:-1]])
        first = new_key | np.concatenate([[True], r["ctx"][1:] != r["ctx"][:-1]])
        begin = np.flatnonzero(first)[np.cumsum(first) - 1]
        again = ~first & ((r["doc"] != r["doc"][begin]) | (r["lo"] != r["lo"][begin]))
        s = _merged(_to_spans(r[again], length))
        yield from _bucket_rows(_doc_bucket(s["doc"], s["tag"], docs), s, SPANS)
        number = np.cumsum(new_key) - 1
        contexts = np.bincount(number[first])
        ask = r[first & (contexts[number] > 1)]
        q = np.empty(len(ask), REQUEST)
        for name in REQUEST.names:
            q[name] = ask[name]
        yield from _bucket_rows(_doc_bucket(q["doc"], q["tag"], docs), q, REQUESTS)

    return run


def _text_rows(docs: np.ndarray):
    """Texts as packed rows for their buckets: ids, tags, sizes and bytes."""

    def run(batches):
        for batch in batches:
            for doc, null, tag, raw, off in _batches(batch):
                bucket = _doc_bucket(doc, tag, docs)
                size = np.diff(off)
                order = np.argsort(bucket, kind="stable")
                cut = np.flatnonzero(np.diff(bucket[order])) + 1
                rows, names = [], []
                for part in np.split(order, cut):
                    body = raw[ranges(off[:-1][part], size[part])].tobytes()
                    head = [np.int64(len(part)).tobytes(), doc[part].tobytes(), null[part].astype(np.uint8).tobytes(), tag[part].tobytes(), size[part].tobytes()]
                    rows.append(zstandard.compress(b"".join([*head, body]), 1))
                    names.append(int(bucket[part[0]]))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([TEXTS] * len(rows), pa.int32()), pa.array(rows, pa.binary())], names=["bucket", "kind", "blob"])

    return run


def _read_texts(blob: bytes):
    data = zstandard.decompress(blob)
    n, at = int(np.frombuffer(data, np.int64, 1)[0]), 8
    doc = np.frombuffer(data, np.int64, n, at)
    null = np.frombuffer(data, np.uint8, n, at + 8 * n) > 0
    tag = np.frombuffer(data, np.uint32, n, at + 9 * n)
    size = np.frombuffer(data, np.int64, n, at + 13 * n)
    raw = np.frombuffer(data, np.uint8, int(size.sum()), at + 21 * n)
    return doc, null, tag, raw, np.concatenate([[0], np.cumsum(size)])


class _Notes:
    """A bucket's notes, sorted by document, and where each document's begin."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows[np.lexsort((rows["lo"], rows["tag"], rows["doc"]))]
        doc, tag = self.rows["doc"], self.rows["tag"]
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])) if len(doc) else np.zeros(0, np.int64)
        many = np.diff(np.append(first, len(doc)))
        self.of = dict(zip(zip(doc[first].tolist(), tag[first].tolist(), strict=True), zip(first.tolist(), many.tolist(), strict=True), strict=True))

    def on(self, doc: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text number, note) of every note on the given texts."""
        hit = [(k, *self.of[pair]) for k, pair in enumerate(zip(doc.tolist(), tag.tolist(), strict=True)) if pair in self.of]
        k, first, many = np.array(hit, np.int64).reshape(-1, 3).T
        return np.repeat(k, many), self.rows[ranges(first, many)]


def _by_bucket(batches, kind: np.dtype, notes: int):
    """Rows sorted by bucket, notes before texts -> (texts, all notes of their bucket)."""
    bucket, held, ready = None, [], _Notes(np.zeros(0, kind))
    for b in batches:
        for at, what, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if at != bucket:
                bucket, held, ready = at, [], _Notes(np.zeros(0, kind))
            if what == notes:
                held.append(_unpack(blob.as_py(), kind))
                continue
            if held:
                ready, held = _Notes(np.concatenate(held)), []
            yield _read_texts(blob.as_py()), ready


def _contexts(length: int, keys: np.ndarray):
    """Requests and texts of buckets -> the requested contexts, packed for the anchors' buckets."""

    def run(batches):
        for (doc, _, tag, raw, off), asked in _by_bucket(batches, REQUEST, REQUESTS):
            text, q = asked.on(doc, tag)
            if not len(text):
                continue
            size = q["hi"].astype(np.int64) - q["lo"] + length
            bucket = _bucket_of(q["key"], keys)
            order = np.argsort(bucket, kind="stable")
            rows, names = [], []
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                body = raw[ranges(off[:-1][text[part]] + q["lo"][part], size[part])].tobytes()
                rows.append(zstandard.compress(np.int64(len(part)).tobytes() + b"".join(np.ascontiguousarray(q[part][k]).tobytes() for k in REQUEST.names) + body, 1))
                names.append(int(bucket[part[0]]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(rows, pa.binary())], names=["bucket", "blob"])

    return run


def repeated_starts(q: np.ndarray, body: np.ndarray, size: np.ndarray, length: int, most: int = 1_500_000) -> np.ndarray:
    """Spans of windows that also start earlier, from contexts sorted by anchor: the suffix arrays of all anchors'
    contexts, many anchors at a time.

    ``q``: REQUEST rows sorted by key; ``body``: their bytes, one context after another; ``size``: the contexts' lengths.
    """
    begin = np.cumsum(size) - size
    new_key = np.concatenate([[True], q["key"][1:] != q["key"][:-1]])
    number = np.cumsum(new_key) - 1
    heavy = np.bincount(number, weights=size + 1)
    by_size = np.argsort(heavy, kind="stable")
    first = np.flatnonzero(new_key)
    many = np.diff(np.append(first, len(q)))
    out = []
    batch = np.cumsum(heavy[by_size]) // most
    for part in np.split(by_size, np.flatnonzero(np.diff(batch)) + 1):
        rows = ranges(first[part], many[part])  # the contexts of these anchors
        problem = np.repeat(np.arange(len(part)), many[part])
        n = size[rows]
        at = np.cumsum(n + 1) - n  # each context after a 0
        t = np.zeros(int((n + 1).sum()) + 1, np.int64)
        where = ranges(at, n)
        t[where] = body[ranges(begin[rows], n)].astype(np.int64) + 1
        text = np.append(np.repeat(problem, n + 1), len(part) - 1)
        sa = suffix_order(t, text, len(part))
        # what is left of the context from each position on
        left = np.zeros(len(t), np.int64)
        left[where] = np.repeat(n, n) - (where - np.repeat(at, n))
        sa = sa[left[sa] >= length]
        if len(sa) < 2:
            continue
        raw = np.where(t > 0, t - 1, 0).astype(np.uint8)
        same = _same_windows(raw, sa, length) & (text[sa[1:]] == text[sa[:-1]])
        if not same.any():
            continue
        owner = np.zeros(len(t), np.int64)
        owner[where] = np.repeat(rows, n)
        start = np.zeros(len(t), np.int64)
        start[where] = np.repeat(q["lo"][rows].astype(np.int64), n) + (where - np.repeat(at, n))
        cls = np.cumsum(np.concatenate([[True], ~same])) - 1
        doc, pos = q["doc"][owner[sa]], start[sa]
        order = np.lexsort((pos, doc, cls))
        cls, doc, pos, own = cls[order], doc[order], pos[order], owner[sa][order]
        head = np.concatenate([[True], cls[1:] != cls[:-1]])
        at0 = np.flatnonzero(head)[np.cumsum(head) - 1]
        again = ~head & ((doc != doc[at0]) | (pos != pos[at0]))
        s = np.empty(int(again.sum()), SPAN)
        s["doc"], s["lo"], s["hi"], s["tag"] = doc[again], pos[again], pos[again] + length, q["tag"][own[again]]
        out.append(_merged(s))
    return np.concatenate(out) if out else np.zeros(0, SPAN)


def _suffix_spans(length: int, docs: np.ndarray):
    """Contexts by bucket -> spans for the documents' buckets."""

    def run(batches):
        for _, part in _in_buckets(batches):
            qs, bodies, sizes = [], [], []
            for blob in (x for b in part for x in b.column(1).to_pylist()):
                data = zstandard.decompress(blob)
                n, at = int(np.frombuffer(data, np.int64, 1)[0]), 8
                q = np.empty(n, REQUEST)
                for name in REQUEST.names:
                    q[name] = np.frombuffer(data, REQUEST[name], n, at)
                    at += n * REQUEST[name].itemsize
                qs.append(q)
                sizes.append(q["hi"].astype(np.int64) - q["lo"] + length)
                bodies.append(np.frombuffer(data, np.uint8, int(sizes[-1].sum()), at))
            q, size, body = np.concatenate(qs), np.concatenate(sizes), np.concatenate(bodies)
            begin = np.cumsum(size) - size
            order = np.argsort(q["key"], kind="stable")
            s = repeated_starts(q[order], body[ranges(begin[order], size[order])], size[order], length)
            yield from _bucket_rows(_doc_bucket(s["doc"], s["tag"], docs), s, SPANS)

    return run


def _finish(with_bytes: bool):
    """Spans and texts of buckets -> one row per document."""

    def run(batches):
        for (doc, null, tag, raw, off), spans in _by_bucket(batches, SPAN, SPANS):
            text, s = spans.on(doc, tag)
            d = np.zeros(len(raw) + 1, np.int32)
            np.add.at(d, off[:-1][text] + s["lo"], 1)
            np.add.at(d, off[:-1][text] + s["hi"], -1)
            gone = np.cumsum(d[:-1]) > 0
            sums = np.concatenate([[0], np.cumsum(gone)])
            rise = gone.copy()
            rise[1:] &= ~gone[:-1]
            inner = off[:-1][(off[:-1] < len(raw))]
            rise[inner] = gone[inner]
            rises = np.concatenate([[0], np.cumsum(rise)])
            kept, kept_off = raw[~gone].tobytes(), off - sums[off]
            parts = [kept[a:b] for a, b in zip(kept_off[:-1].tolist(), kept_off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc, mask=null),
                    pa.array(np.diff(off)),
                    pa.array(np.diff(sums[off]).astype(np.int64)),
                    pa.array(np.diff(rises[off]).astype(np.int64)),
                    pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string()),
                    *([pa.array(parts, pa.binary())] if with_bytes else []),
                ],
                names=["wl_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_bytes else [])],
            )

    return run


def suffix_dedup(docs: DataFrame, length: int = 100, hot_least: int = HOT_LEAST, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True) -> DataFrame:
    """(``id_col``, n_bytes, n_removed, n_spans, kept_sha256, kept), one row per input row; ``kept``: the bytes left
    (not with ``with_bytes`` off).

    Removed is each byte covered by a ``length``-byte string (at least 9) that also starts earlier: at a smaller id, or
    in the same document further left; overlaps count. Ids must be 64-bit integers. Null text is empty; texts shorter
    than ``length`` lose nothing. Rows that repeat an id with the same text are judged alike, neither earlier than the
    other; null ids come after all others and count as one id. An empty table gives an empty table.

    Frequent anchors - those with at least ``hot_least`` contexts and one ``HOT_SHARES``-th of all - are found on a
    sixteenth of the texts; their windows are spread by hashes of their own and merged in every task first. That evens
    out the tasks and has no part in the result. Windows and contexts are told apart by two independent 64-bit hashes
    before the suffix arrays, and byte by byte in them. The number of buckets follows the bytes of text.
    """
    if length < 9:
        raise ValueError("length must be at least 9")
    spark = docs.sparkSession
    d = text_of(docs, id_col, text_col).withColumn("wl_id", F.col("wl_id").cast("long"))
    sixteenth = d.filter(F.pmod(F.xxhash64("wl_id", F.length("wl_text")), F.lit(16)) == 0)
    counts = stored(sixteenth.mapInArrow(lean(_hot(length)), "k long, n long, size long"), "anchors").groupBy("k").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    total, size = counts.filter("k = 0").agg(F.sum("n"), F.sum("size")).first()
    least = max(hot_least / 16, (total or 0) / HOT_SHARES)
    hot = np.sort(np.array([r[0] for r in counts.filter((F.col("k") != 0) & (F.col("n") >= least)).orderBy(F.desc("n"), "k").limit(HOT_SHARES).collect()], np.int64).view(np.uint64))
    buckets = max(partitions(spark), -(-16 * (size or 0) // BUCKET_BYTES))
    n = min(buckets, max(MOST_TASKS, partitions(spark)))
    names = dealt(spark, n)
    if buckets > n:  # more buckets than tasks: the others are dealt at random
        names = np.concatenate([names, np.arange(1 << 30, (1 << 30) + buckets - n, dtype=np.int32)])
    rows = "bucket int, kind int, blob binary"
    by_bucket = lambda x: x.repartition(n, "bucket").sortWithinPartitions("bucket", *(c for c in x.columns if c == "kind"))
    notes = stored(by_bucket(d.mapInArrow(lean(_emit(length, hot, names, names)), rows)).mapInArrow(lean(_settle_keys(length, names)), rows), "repeats")
    texts = d.mapInArrow(lean(_text_rows(names)), rows)

    def beside_texts(x: DataFrame) -> DataFrame:
        return by_bucket(x.unionByName(texts))

    contexts = beside_texts(notes.filter(F.col("kind") == REQUESTS)).mapInArrow(lean(_contexts(length, names)), "bucket int, blob binary")
    found = by_bucket(contexts).mapInArrow(lean(_suffix_spans(length, names)), rows)
    out = beside_texts(notes.filter(F.col("kind") == SPANS).unionByName(found)).mapInArrow(lean(_finish(with_bytes)), "wl_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes)
    return out.withColumnRenamed("wl_id", id_col)
