"""Concatenate-and-cut packing of tokenised documents into fixed windows.

Pass one tokenises every document once and stores its ids, with the running token total inside its partition. The
partition totals - one row per partition - are summed to global offsets. Pass two cuts the stream of all ids at
multiples of the window: a document that crosses a cut leaves one boundary record (piece) in each window it touches.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlink.llm.shared import buffers, lean, ranges, slices, stored, text_of

_LOADED: dict[str, object] = {}
# Byte-level files split texts into words by a pattern that starts a new word at every space before something that is no
# white space, so what stands before such a space has no part in what follows it.
_CUT = re.compile(r" (?=\S)")
_WORD = re.compile(r"\S+")
SLICE = 16 << 20  # bytes of text whose equal pieces are encoded once


def _blanks() -> np.ndarray:
    """Bytes that white space may begin with."""
    t = np.zeros(256, bool)
    for c in range(0x10000):
        if chr(c).isspace() or c == 0x180E:  # once a space, to some
            t[chr(c).encode()[0]] = True
    return t


_BLANK = _blanks()


def load_tokenizer(path: str):
    """A tokenizers file, loaded once per Python worker. Special tokens' strings in a text are those tokens."""
    if path not in _LOADED:
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


class Encoder:
    """Ids of texts under a tokenizers file, as bytes; every id comes from the tokenizers library.

    A byte-level BPE file without a normaliser encodes words one by one. So texts are cut where such a file always begins
    a new word, and of equal pieces one is encoded. A text that holds an added token's string, and any text under
    another kind of file, is encoded whole.
    """

    def __init__(self, path: str, kind: np.dtype):
        self.tok, self.kind = load_tokenizer(path), kind
        key = f"{path}|{kind.str}"
        if key not in _LOADED:
            spec = json.loads(self.tok.to_str())
            opens = np.zeros(self.tok.get_vocab_size(), bool)
            opens[[i for t, i in self.tok.get_vocab(with_added_tokens=False).items() if t[0] == "\u0120"]] = True  # how such files spell a space
            _LOADED[key] = self._word_by_word(spec), [t["content"] for t in spec.get("added_tokens", [])], opens
        self.by_pieces, self.added, self.opens = _LOADED[key]  # type: ignore[misc]

    @staticmethod
    def _word_by_word(spec: dict) -> bool:
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        plain = not any(spec.get(k) for k in ("normalizer", "truncation", "padding")) and not model.get("dropout")
        return plain and model.get("type") == "BPE" and all(pre.get(k) == v for k, v in usual.items())

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _behind_space(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces behind a space, one after another, and their numbers. Pieces without white space are encoded as one
        text: each is a word of its own there, and its first id, alone among its ids, begins with a space."""
        plain = [k for k, p in enumerate(pieces) if _WORD.fullmatch(p)]
        words = pieces if len(plain) == len(pieces) else [pieces[k] for k in plain]
        ids = [np.array(e.ids, self.kind) for k in range(0, len(words), 4096) for e in self.tok.encode_batch_fast([" " + " ".join(words[k : k + 4096])], add_special_tokens=False)]
        every = np.concatenate(ids) if ids else np.zeros(0, self.kind)
        size = np.diff(np.append(np.flatnonzero(self.opens[every]), len(every)))
        if len(plain) == len(pieces):
            return every, size
        rest = sorted(set(range(len(pieces))) - set(plain))
        raw = self._ids([" " + pieces[k] for k in rest])
        order = np.argsort(np.array(plain + rest), kind="stable")
        every = np.concatenate([every, np.frombuffer(b"".join(raw), self.kind)])
        size = np.append(size, [len(x) // self.kind.itemsize for x in raw]).astype(np.int64)
        return every[ranges((np.cumsum(size) - size)[order], size[order])], size[order]

    def _joined(self, pieces: pa.ListArray) -> list[bytes]:
        """Ids of texts from their pieces; the first of a text has no space before it."""
        off = pieces.offsets.to_numpy().astype(np.int64)
        flat, off = pieces.flatten(), off - off[0]
        table = flat.dictionary_encode()
        code = table.indices.to_numpy(zero_copy_only=False).copy()
        every, size = self._behind_space(table.dictionary.to_pylist())
        heads = self._ids(flat.take(pa.array(off[:-1])).to_pylist())
        code[off[:-1]] = len(size) + np.arange(len(heads))
        del table, flat
        every = np.concatenate([every, np.frombuffer(b"".join(heads), self.kind)])
        size = np.append(size, [len(x) // self.kind.itemsize for x in heads]).astype(np.int64)
        start, cut, parts = np.cumsum(size) - size, [0], []
        for lo in range(0, len(off) - 1, 256):  # some texts at a time, so that places take little memory
            mine = code[off[lo] : off[min(lo + 256, len(off) - 1)]]
            parts.append(every[ranges(start[mine], size[mine])].tobytes())
            sums = np.concatenate([[0], np.cumsum(size[mine])])[off[lo + 1 : lo + 257] - off[lo]]
            cut += (sums * self.kind.itemsize + cut[-1]).tolist()
        ids = b"".join(parts)
        return [ids[a:b] for a, b in zip(cut, cut[1:])]

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Ids of a string column without nulls."""
        if not self.by_pieces:
            return self._ids(texts.to_pylist())
        raw, off = buffers(texts)
        # 0: cut at every space; 1: not every space starts a word; 2: holds an added token
        kind = np.zeros(len(texts), np.int8)
        space = raw == 32
        odd = np.flatnonzero(space & _BLANK[np.append(raw[1:], 32)]) if len(raw) else np.zeros(0, np.int64)
        last = off[1:][np.diff(off) > 0] - 1
        kind[np.searchsorted(off, np.concatenate([odd, last[space[last]]]), "right") - 1] = 1
        for token in self.added:
            kind[pc.match_substring(texts, token).to_numpy(zero_copy_only=False)] = 2
        out: list = [None] * len(texts)
        for k in np.unique(kind).tolist():
            rows = np.flatnonzero(kind == k)
            part = texts.take(pa.array(rows))
            if k == 2:
                found = self._ids(part.to_pylist())
            else:
                found = self._joined(pc.split_pattern(part, " ") if k == 0 else pa.array([_CUT.split(t) for t in part.to_pylist()], pa.list_(pa.string())))
            for row, ids in zip(rows.tolist(), found, strict=True):
                out[row] = ids
        return out


def _tokenise(path: str, end_id: int):
    """(id, text) -> (id, part, start within the part, number of ids, ids as little-endian 16- or 32-bit integers)."""

    def run(batches):
        tok = load_tokenizer(path)
        small = tok.get_vocab_size() <= 1 << 16 and end_id < 1 << 16
        kind = np.dtype("<u2" if small else "<u4")
        encode, end = Encoder(path, kind), np.array([end_id], kind).tobytes()
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for b in slices(batch, 1, SLICE):
                rows = [x + end for x in encode(b.column(1))]
                sizes = np.array([len(x) // kind.itemsize for x in rows], np.int64)
                starts = start + np.cumsum(sizes) - sizes
                start += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(np.full(len(rows), part, np.int32)), pa.array(starts), pa.array(sizes), pa.array(rows, pa.binary())],
                    names=["wl_id", "wl_part", "wl_start", "wl_n", "wl_ids"],
                )

    return run


def _cut(window: int):
    """Boundary records: one row for each window that a document touches."""

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], [], [], [], []]
            ids = b.column(0).to_pylist()
            for i, at, n, raw in zip(ids, b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                lo = 0
                while lo < n:
                    seq, off = divmod(at + lo, window)
                    hi = min(n, lo + window - off)
                    piece = x[lo:hi].tobytes()
                    for col, v in zip(out, (i, lo, hi - lo, zlib.crc32(piece), n, seq, off, piece), strict=True):
                        col.append(v)
                    lo = hi
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, [b.schema.field(0).type] + [pa.int64()] * 6 + [pa.binary()], strict=True)],
                names=["wl_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) per piece; ids: unsigned 32-bit, little-endian.

    Each document's ids and then ``end_id`` lie in the stream once; every sequence but the last is full, so at most
    ``window`` - 1 places are padding in all. Null and empty texts consist of the end id alone. Repeated rows and null
    ids are packed as any other row. A window of one document after another takes a text of any length. An empty table
    gives no pieces. Token ids are stored in the shared folder between the passes, 16 bits each where the vocabulary
    allows, so texts are tokenised once and offsets rest on what was written, whatever executor is lost later.
    """
    if window < 1:
        raise ValueError("window must be positive")
    kind = text_of(docs, id_col, text_col).select("wl_id").dtypes[0][1]
    tokens = stored(
        text_of(docs, id_col, text_col).mapInArrow(lean(_tokenise(tokenizer, end_id)), f"wl_id {kind}, wl_part int, wl_start long, wl_n long, wl_ids binary"),
        "tokens",
    )
    totals = tokens.groupBy("wl_part").agg(F.sum("wl_n").alias("wl_total"))
    before = Window.orderBy("wl_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("wl_part", F.coalesce(F.sum("wl_total").over(before), F.lit(0)).alias("wl_base"))
    placed = tokens.join(F.broadcast(offsets), "wl_part")  # a row per partition of the input: bounded by the task count
    return (
        placed.select("wl_id", (F.col("wl_base") + F.col("wl_start")).alias("wl_at"), "wl_n", "wl_ids")
        .mapInArrow(lean(_cut(window)), f"wl_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
        .withColumnRenamed("wl_id", id_col)
    )
