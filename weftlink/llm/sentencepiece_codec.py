"""SentencePiece encoding and decoding on the tokenizers library.

The model file is read as a protobuf by hand; normaliser, metaspace marker, scores or merges, and byte fallback are
rebuilt as a tokenizers object. Results can be held against the sentencepiece library, text by text.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm.shared import lean, ranges, slices, text_of

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values of the model format
UNIGRAM, BPE = 1, 2


def _fields(data: bytes):
    """(number, value) of each field of a protobuf message: varints as int, the rest as bytes."""
    at, n = 0, len(data)

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            if byte < 128:
                return out
            shift += 7

    while at < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class PieceModel:
    """What a SentencePiece model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    one_space: bool = True

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        m = cls()
        for number, value in _fields(data):
            if number == 1:
                text, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        text = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                m.pieces.append((text, score, kind))
            elif number == 2:
                for n, v in _fields(value):
                    if n == 3:
                        m.kind = v
                    elif n == 35:
                        m.byte_fallback = bool(v)
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2:
                        m.charsmap = v
                    elif n == 3:
                        m.dummy_prefix = bool(v)
                    elif n == 4:
                        m.one_space = bool(v)
        return m

    @property
    def unknown(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)

    def crosses_spaces(self) -> bool:
        """Whether a piece has a marker after another character, so that words can't be encoded one by one."""
        return any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _, k in self.pieces if k in (NORMAL, USER))

    def merges(self) -> list[tuple[str, str]]:
        """Every way to join two pieces to a piece, best score first."""
        ids = {p: i for i, (p, _, k) in enumerate(self.pieces) if k in (NORMAL, USER)}
        found = []
        for p, i in ids.items():
            for cut in range(1, len(p)):
                if p[:cut] in ids and p[cut:] in ids:
                    found.append((-self.pieces[i][1], i, ids[p[:cut]], ids[p[cut:]], p[:cut], p[cut:]))
        return [x[4:] for x in sorted(found)]

    def tokenizer(self):
        """The equivalent tokenizers object, without pre-tokeniser."""
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

        if self.kind == BPE:
            model = models.BPE(
                vocab={p: i for i, (p, _, _) in enumerate(self.pieces)}, merges=self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback, cache_capacity=0
            )
        elif self.kind == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback)
        else:
            raise ValueError(f"model kind {self.kind} is neither unigram nor BPE")
        tok = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.one_space:
            steps += [normalizers.Replace(Regex(" +"), " "), normalizers.Strip()]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(SPACE))
        tok.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", SPACE)])
        tok.add_tokens([AddedToken(p, normalized=False) for p, _, k in self.pieces if k == USER])
        ends = [decoders.Strip(" ", 1, 0)] if self.dummy_prefix else []
        tok.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *ends])
        return tok


class PieceCodec:
    """Batch encoder and decoder. Where no piece crosses a space, each distinct word of a batch is encoded once:
    thousands of words are joined to one text (no merge crosses the marker that starts each), the texts are encoded as a
    multithreaded batch, and their ids are cut where the words' bytes end."""

    def __init__(self, data: bytes, most: int = 500_000):
        self.model = PieceModel.parse(data)
        self.tok = self.model.tokenizer()
        self.by_word = self.model.kind == BPE and self.model.byte_fallback and not self.model.crosses_spaces() and not any(k == USER for _, _, k in self.model.pieces)
        self.bare = self.model.tokenizer()
        self.bare.normalizer = None
        self.units = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+$")
        self.known: dict[str, bytes] = {}
        self.most = most
        spelled = [bytes([int(p[3:-1], 16)]) if k == BYTE else p.encode() for p, _, k in self.model.pieces]
        self.width = np.array([len(x) for x in spelled], np.int64)
        shown = [b"" if k == CONTROL else x if k == BYTE else x.replace(SPACE.encode(), b" ") for x, (_, _, k) in zip(spelled, self.model.pieces, strict=True)]
        self.size = np.array([len(x) for x in shown], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.table = np.frombuffer(b"".join(shown), np.uint8)

    def _normal(self, text: str) -> str:
        if self.model.charsmap or self.model.one_space:
            return self.tok.normalizer.normalize_str(text)
        return (SPACE if self.model.dummy_prefix and text else "") + text.replace(" ", SPACE)

    def _split(self, text: str) -> list[str]:
        """The units of a normalised text: a word with the markers before it, or the markers at the end."""
        if text[:1] == SPACE and SPACE + SPACE not in text and text[-1:] != SPACE:
            return [SPACE + x for x in text[1:].split(SPACE)]
        return self.units.findall(text)

    def _learn(self, units: list[str]) -> None:
        parts = [units[lo : lo + 2048] for lo in range(0, len(units), 2048)]
        for part, e in zip(parts, self.bare.encode_batch_fast(["".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            at = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(u.encode()) for u in part]), "left") + 1
            raw = ids.tobytes()
            self.known.update((u, raw[4 * a : 4 * b]) for u, a, b in zip(part, [0, *at[:-1].tolist()], at.tolist(), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            # texts are normalised whole: a user's piece in the middle starts no new text
            return [np.array(e.ids, np.uint32) for e in self.bare.encode_batch([self._normal(t) for t in texts], add_special_tokens=False)]
        if len(self.known) > self.most:
            self.known = {}
        split = [self._split(self._normal(t)) for t in texts]
        new = set().union(*split).difference(self.known)
        self._learn([u for u in new if u[0] == SPACE != u[-1]])
        for u in new.difference(self.known):  # markers alone, or a text's first word where no marker is set before it
            self.known[u] = np.array(self.bare.encode(u, add_special_tokens=False).ids, np.uint32).tobytes()
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, u)), np.uint32) for u in split]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The texts that ids stand for: markers become spaces, byte pieces bytes; the marker set before a text goes."""
        out = []
        for x in ids:
            x = x.astype(np.int64)
            raw = self.table[ranges(self.start[x], self.size[x])].tobytes()
            text = raw.decode("utf-8", "replace")
            out.append(text[1:] if self.model.dummy_prefix and text[:1] == " " else text)
        return out


_LOADED: dict[bytes, tuple] = {}


def _load(data: bytes) -> tuple:
    """The codec and sentencepiece's own processor, once per Python worker: known words last from task to task."""
    key = hashlib.sha256(data).digest()
    if key not in _LOADED:
        import sentencepiece

        _LOADED.clear()
        _LOADED[key] = PieceCodec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    return _LOADED[key]


def _run(data: bytes, verify: bool, whole: bool):
    def run(batches):
        codec, other = _load(data)
        other = other if verify else None
        for batch in batches:
            for b in slices(batch, 1, 2 << 20):
                texts = b.column(1).to_pylist()
                ids = codec.encode(texts)
                back = codec.decode(ids)
                same = [None] * len(texts)
                if other is not None:
                    same = [x.tolist() == y for x, y in zip(ids, other.encode(texts, num_threads=1), strict=True)]
                raw = [x.astype("<u4").tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        *([pa.array(raw, pa.binary()), pa.array(back, pa.string())] if whole else []),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string()),
                        pa.array([x == y for x, y in zip(back, texts, strict=True)], pa.bool_()),
                        pa.array(same, pa.bool_()),
                    ],
                    names=["wl_id", *(["ids", "decoded"] if whole else []), "n_ids", "ids_crc32", "decoded_sha256", "round_trip", "parity"],
                )

    return run


def piece_codec(docs: DataFrame, model: bytes, verify: bool = True, whole: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, ids, decoded, n_ids, ids_crc32, decoded_sha256, round_trip, parity), one row per input row; without
    ids and decoded where ``whole`` is off.

    ``ids``: little-endian unsigned 32-bit integers; ``decoded``: the text they stand for; ``round_trip``: it is the
    text itself; ``parity``: the sentencepiece library gives the same ids (null with ``verify`` off). Null and empty
    texts have no ids. Repeated rows and null ids pass through; an empty table gives an empty table. Whole texts are
    encoded, in slices of a few MB; ``model`` is the content of the model file, half a MB in the task's closure.
    """
    d = text_of(docs, id_col, text_col)
    kind = d.dtypes[0][1]
    both = "ids binary, decoded string, " * whole
    return d.mapInArrow(
        lean(_run(model, verify, whole)), f"wl_id {kind}, {both}n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean, parity boolean"
    ).withColumnRenamed("wl_id", id_col)


def decode_ids(rows: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(``id_col``, text), one row per input row: the texts of stored ids (little-endian unsigned 32-bit integers).

    Null and empty id lists give the empty text, bytes that are no UTF-8 the replacement character. Repeated rows and null
    keys pass through, other columns are left behind; an empty table gives an empty table.
    """

    def run(batches):
        codec = PieceCodec(model)
        for b in batches:
            ids = [np.frombuffer(x or b"", "<u4") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codec.decode(ids), pa.string())], names=["wl_id", "text"])

    d = rows.select(F.col(id_col).alias("wl_id"), F.col(ids_col))
    return d.mapInArrow(run, f"wl_id {d.dtypes[0][1]}, text string").withColumnRenamed("wl_id", id_col)
