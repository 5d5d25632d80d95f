"""Secret scan: fixed patterns plus a small character convolutional network over every further candidate.

The base patterns' findings always stand. Candidates are all runs of key-like characters; each is scored whole, together
with the characters around it, by a convolutional network in numpy whose pooling takes runs of any length. Of a long run,
parts between / and = and overlapping stretches are scored as well; where one of them is a secret it stands for the run. The network is
trained on labelled findings; its logits are calibrated on held-out ones (Platt scaling), and the threshold is the highest
that keeps the asked recall there.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from dataclasses import dataclass, fields
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm.shared import buffers, slices, text_of

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "model")
BEFORE, AFTER = 24, 8  # bytes of context on either side
LEAST, STRETCH, STEP = 16, 48, 8  # bytes of a candidate at least; of a stretch of a long one, and between stretches
CLASSES = 48  # letters folded to 26, marks kept apart by the table below
CHUNK = 1 << 16  # positions that are convolved at once


def _char_table() -> np.ndarray:
    """Byte -> class: 0 padding, 1-26 letters, 27-36 digits, 37-46 marks of keys and code, 47 everything else."""
    t = np.full(256, 47, np.int64)
    t[0] = 0
    for i in range(26):
        t[65 + i] = t[97 + i] = 1 + i
    t[48:58] = np.arange(27, 37)
    for i, c in enumerate(b" \n=:\"'_-/+"):
        t[c] = 37 + i
    return t


TABLE = _char_table()


def windows(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of character classes for each span (a, b) of a text from ``begin`` to ``end``: what precedes it, all its bytes,
    what follows it; and the rows' lengths. Beyond its length a row is padding."""
    size = b - a
    col = np.arange(BEFORE + int(size.max(initial=0)) + AFTER)
    at = a[:, None] - BEFORE + col[None]
    there = (at >= begin[:, None]) & (at < np.minimum(end, b + AFTER)[:, None])
    return np.where(there, TABLE[raw[np.clip(at, 0, len(raw) - 1)]], 0), BEFORE + size + AFTER


@dataclass
class CharCNN:
    """Embedding, one convolution with ReLU, maximum and mean over positions, one logistic output."""

    emb: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    @classmethod
    def fresh(cls, seed: int, dim: int = 8, filters: int = 24, span: int = 5) -> CharCNN:
        r = np.random.default_rng(seed)
        e = r.normal(0, 0.3, (CLASSES, dim))
        e[0] = 0
        conv, out = r.normal(0, (2 / (dim * span)) ** 0.5, (span * dim, filters)), r.normal(0, 0.1, 2 * filters)
        return cls(*[w.astype(np.float32) for w in (e, conv, np.zeros(filters), out)], 0.0)

    def save(self, path: str) -> None:
        np.savez(path, **{f.name: getattr(self, f.name) for f in fields(self)})

    @classmethod
    def load(cls, path: str) -> CharCNN:
        with np.load(path) as z:
            return cls(**{f.name: z[f.name] if z[f.name].ndim else float(z[f.name]) for f in fields(cls)})

    @property
    def span(self) -> int:
        return self.conv.shape[0] // self.emb.shape[1]

    def _unfold(self, x: np.ndarray) -> np.ndarray:
        e = self.emb[x]
        return np.concatenate([e[:, i : e.shape[1] - self.span + 1 + i] for i in range(self.span)], axis=2)

    def _forward(self, x: np.ndarray, size: np.ndarray):
        """Positions that reach beyond a row's size have no part in its maximum and mean."""
        u = self._unfold(x)
        a = u @ self.conv + self.bias
        count = size - self.span + 1
        inside = np.arange(a.shape[1])[None, :, None] < count[:, None, None]
        best = np.where(inside, a, -np.inf).argmax(1)
        r = np.maximum(a, 0) * inside
        pooled = np.concatenate([np.take_along_axis(r, best[:, None, :], 1)[:, 0], r.sum(1) / count[:, None].astype(r.dtype)], axis=1)
        return u, a, inside, count, best, pooled, pooled @ self.out + self.out_bias

    def _long(self, x: np.ndarray) -> float:
        """The logit of one row, read in pieces."""
        n, f = len(x) - self.span + 1, len(self.bias)
        most, total = np.zeros(f), np.zeros(f)
        for lo in range(0, n, CHUNK):
            a = np.maximum(self._unfold(x[None, lo : lo + CHUNK + self.span - 1])[0] @ self.conv + self.bias, 0)
            most, total = np.maximum(most, a.max(0)), total + a.sum(0)
        return float(np.concatenate([most, total / n]) @ self.out + self.out_bias)

    def logits(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        if x.shape[1] > CHUNK:
            return np.array([self._long(r[:n]) for r, n in zip(x, size.tolist(), strict=True)])
        step = max(1, CHUNK // max(1, x.shape[1]))
        return np.concatenate([self._forward(x[i : i + step], size[i : i + step])[-1] for i in range(0, len(x), step)]) if len(x) else np.zeros(0)

    def scores(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Calibrated probability that a candidate is a secret."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(x, size) + self.shift, -40, 40)))

    def fit(self, x: np.ndarray, size: np.ndarray, y: np.ndarray, epochs: int, seed: int, rate: float = 0.01) -> None:
        """Adam on the balanced logistic loss."""
        r = np.random.default_rng(seed)
        w = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        names = ("emb", "conv", "bias", "out", "out_bias")
        m = {n: 0.0 for n in names}
        v = {n: 0.0 for n in names}
        step, dim, f = 0, self.emb.shape[1], self.conv.shape[1]
        for _ in range(epochs):
            order = r.permutation(len(y))
            for lo in range(0, len(y), 128):
                i = order[lo : lo + 128]
                xi = x[i, : size[i].max()]
                u, a, inside, count, best, pooled, z = self._forward(xi, size[i])
                d = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[i]) * w[i] / len(i)).astype(np.float32)
                dp = d[:, None] * self.out
                da = (dp[:, None, f:] / count[:, None, None].astype(np.float32)) * inside
                da[np.arange(len(i))[:, None], best, np.arange(f)] += dp[:, :f]
                da *= a > 0
                flat = da.reshape(-1, f)
                du = (flat @ self.conv.T).reshape(*a.shape[:2], -1)
                g = {"out": pooled.T @ d, "out_bias": d.sum(), "conv": u.reshape(-1, u.shape[2]).T @ flat, "bias": flat.sum(0), "emb": np.zeros(self.emb.shape)}
                for s in range(self.span):
                    at = xi[:, s : s + a.shape[1]].ravel()
                    for k in range(dim):
                        g["emb"][:, k] += np.bincount(at, du[:, :, s * dim + k].ravel(), CLASSES)
                g["emb"][0] = 0
                step += 1
                for n in names:
                    m[n] = 0.9 * m[n] + 0.1 * g[n]
                    v[n] = 0.999 * v[n] + 0.001 * g[n] ** 2
                    change = rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, n, getattr(self, n) - (change.astype(np.float32) if np.ndim(change) else float(change)))

    def calibrate(self, x: np.ndarray, size: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Platt scaling on held-out findings, then the highest threshold with the asked recall."""
        z = self.logits(x, size)
        a, b = 1.0, 0.0
        hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2)
        t = np.where(y > 0, hi, lo)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
            s = p * (1 - p) + 1e-9
            g = np.array([((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum()])
            h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
            d = np.linalg.solve(h, g)
            a, b = a - np.clip(d[0], -1, 1), b - np.clip(d[1], -2, 2)
        self.slope, self.shift = float(a), float(b)
        good = np.sort(self.scores(x, size)[y > 0])
        self.threshold = float(good[int(np.floor((1 - recall) * len(good)))]) if len(good) else 1.0


def _key(r: np.random.Generator, letters: str, n: int) -> str:
    return "".join(letters[i] for i in r.integers(0, len(letters), n))


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _syllable(r: np.random.Generator) -> str:
    """A pronounceable piece of a word: consonants, vowels, perhaps a consonant."""
    consonants, vowels = "bcdfghjklmnpqrstvwxz", "aeiouy"
    return _key(r, consonants, int(r.integers(0, 3))) + _key(r, vowels, int(r.integers(1, 3))) + _key(r, consonants, int(r.integers(0, 2)))


FORMATS = ("ghp", "sk", "jwt", "base64", "HEX", "xoxb", "AIza", "mixed", "glpat", "npm", "sk_live")


def _secret(r: np.random.Generator, kind: str) -> str:
    """A made key of a public format."""
    mixed = LOWER + UPPER + DIGITS
    return {
        "ghp": lambda: "ghp_" + _key(r, mixed, 36),
        "sk": lambda: "sk-" + _key(r, mixed, 40),
        "jwt": lambda: "eyJ" + _key(r, mixed + "_-", int(r.integers(40, 80))),
        "base64": lambda: _key(r, mixed + "+/", 40),
        "HEX": lambda: _key(r, "0123456789ABCDEF", 40),
        "xoxb": lambda: "xoxb-" + _key(r, DIGITS, 12) + "-" + _key(r, mixed, 24),
        "AIza": lambda: "AIza" + _key(r, mixed + "_-", 35),
        "mixed": lambda: _key(r, mixed, int(r.integers(24, 44))),
        "glpat": lambda: "glpat-" + _key(r, mixed + "_-", 20),
        "npm": lambda: "npm_" + _key(r, mixed, 36),
        "sk_live": lambda: "sk_live_" + _key(r, mixed, 24),
    }[kind]()


def labelled_findings(n: int, seed: int, formats: tuple[str, ...] = FORMATS) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """``n`` labelled candidates in context, half of them secrets, from a rule: key formats of public services against
    long words, paths, identifiers, separators and numbers that only look like keys."""
    r = np.random.default_rng(seed)
    words = ["".join(_key(r, LOWER, 2) for _ in range(r.integers(1, 6))) for _ in range(400)]
    words += ["".join(_syllable(r) for _ in range(r.integers(1, 5))) for _ in range(1200)]
    long_word = lambda: "".join(_syllable(r) for _ in range(int(r.integers(6, 16)))).ljust(16, "a")[: int(r.integers(16, 40))]
    word = lambda: words[r.integers(0, len(words))]
    figures = lambda: "".join(_key(r, DIGITS, int(r.integers(1, 5))) + ".-/ ) ("[r.integers(0, 7)] for _ in range(r.integers(1, 5))).rstrip()
    several = lambda mark: mark.join(word() for _ in range(int(r.integers(4, 14)))).ljust(16, "x")
    harmless = [
        lambda: "".join(word() for _ in range(6))[: int(r.integers(16, 40))].ljust(16, "a"),
        lambda: ("".join(word() for _ in range(6))[: int(r.integers(16, 30))]).ljust(16, "e").capitalize(),
        lambda: "".join(word() for _ in range(6)).upper()[: int(r.integers(16, 30))].ljust(16, "A"),
        lambda: several("/"),
        lambda: several("_"),
        lambda: several("-"),
        lambda: _key(r, DIGITS, int(r.integers(16, 24))),
        lambda: _key(r, DIGITS, 16),
        long_word,
        long_word,
        lambda: long_word().capitalize(),
        lambda: long_word().upper(),
        lambda: "=-_"[r.integers(0, 3)] * int(r.integers(16, 60)),
    ]
    rows, y = [], []
    for k in range(n):
        secret = k % 2 == 0
        if secret:
            v = _secret(r, formats[r.integers(0, len(formats))])
            lead = ["", "key = ", "auth: ", 'client_key="', "export KEY=", "Bearer ", word() + " "][r.integers(0, 7)]
        else:
            v = harmless[r.integers(0, len(harmless))]()
            lead = ["", word() + " ", word() + ", ", "see ", word() + ": ", "url=/", word() + " = "][r.integers(0, 7)]
        near = lambda: figures() if r.random() < 0.3 else word()
        before = " ".join(near() for _ in range(3)) + " " + lead
        after = ['" ', " ", "\n", ". ", ", "][r.integers(0, 5)] + word()
        rows.append((before + v + after, len(before), len(before) + len(v)))
        y.append(1.0 if secret else 0.0)
    return rows, np.array(y)


def rows_of_findings(rows: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The windows of labelled findings, each a text of its own (ASCII) and a span."""
    off = np.cumsum([0, *[len(t) for t, _, _ in rows]])
    a, b = (np.array([r[k] for r in rows], np.int64) + off[:-1] for k in (1, 2))
    return windows(np.frombuffer("".join(t for t, _, _ in rows).encode(), np.uint8), off[:-1], off[1:], a, b)


@lru_cache(maxsize=8)
def train(n: int = 6000, epochs: int = 8, recall: float = 0.99, seed: int = 11, formats: tuple[str, ...] = FORMATS) -> CharCNN:
    """A network trained on ``n`` labelled findings and calibrated on half as many others; once per process."""
    rows, y = labelled_findings(n, seed, formats)
    net = CharCNN.fresh(seed)
    net.fit(*rows_of_findings(rows), y, epochs, seed)
    rows, y = labelled_findings(n // 2, seed + 1, formats)
    net.calibrate(*rows_of_findings(rows), y, recall)
    return net


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, by start, then kind; ends are exclusive, in code points."""
    out = []
    low = text.lower()
    if any(w in low for w in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2]))


HEXISH = np.zeros(256, bool)
HEXISH[[*b"0123456789abcdef"]] = True
KEYISH = np.zeros(256, bool)
KEYISH[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True


def _runs(flags: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of at least ``least`` flags; no run crosses a text's end."""
    inside = flags.copy()
    cut = np.zeros(len(flags) + 1, bool)
    cut[off] = True
    prev = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
    starts = np.flatnonzero(inside & (~prev | cut[:-1]))
    nxt = np.concatenate([inside[1:], [False]]) if len(inside) else inside
    ends = np.flatnonzero(inside & (~nxt | cut[1:])) + 1
    keep = ends - starts >= least
    return starts[keep], ends[keep]


def find_in(texts: list[str], raw: np.ndarray, off: np.ndarray, net: CharCNN | None) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int, int]]]]:
    """Base findings and those the network adds, per text. ``raw`` and ``off``: the texts' bytes."""
    hex_at, _ = _runs(HEXISH[raw], off, 24)
    has_hex = np.zeros(len(texts), bool)
    has_hex[np.searchsorted(off, hex_at, "right") - 1] = True
    base = []
    for k, t in enumerate(texts):
        low = t.lower()
        hit = has_hex[k] or "AKIA" in t or any(w in low for w in ("password", "passwd", "secret", "token", "apikey", "api_key"))
        base.append(base_spans(t) if hit else [])
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if net is None:
        return base, added
    heads = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # where code points begin
    first = np.searchsorted(heads, off)  # the number of each text's first one
    # base findings are blanked out, so what is left of a run beside one is a candidate of its own
    raw = raw.copy()
    for k, found in enumerate(base):
        for x, y, _ in found:
            raw[heads[first[k] + x] : heads[first[k] + y]] = 32
    s, e = _runs(KEYISH[raw], off, LEAST)
    good, long = _scored(s, e, raw, off, net), e - s > STRETCH
    begins, ends = s[long], e[long]
    pieces = np.array([p for a, b in zip(begins.tolist(), ends.tolist(), strict=True) for p in _pieces(raw, a, b)], np.int64).reshape(-1, 2)
    hits: dict[int, list[tuple[int, int]]] = {}
    for a, b in pieces[_scored(pieces[:, 0], pieces[:, 1], raw, off, net)].tolist():
        hits.setdefault(int(np.searchsorted(begins, a, "right")) - 1, []).append((a, b))
    spans = [p for k, found in hits.items() for p in _enclosed(raw, int(begins[k]), int(ends[k]), found)]
    good[np.flatnonzero(long)[list(hits)]] = False  # the parts tell more exactly where it is
    spans += zip(s[good].tolist(), e[good].tolist(), strict=True)
    for a, b in sorted(spans):
        k = int(np.searchsorted(off, a, "right")) - 1
        start = int(np.searchsorted(heads, a) - first[k])
        added[k].append((start, start + b - a, 3))
    return base, added


def _scored(a: np.ndarray, b: np.ndarray, raw: np.ndarray, off: np.ndarray, net: CharCNN) -> np.ndarray:
    """Which of the spans the network takes for secrets; spans of about equal lengths are scored together."""
    out = np.zeros(len(a), bool)
    text = np.searchsorted(off, a, "right") - 1
    order = np.argsort(b - a, kind="stable")
    size = (b - a)[order]
    lo = 0
    while lo < len(order):
        hi = min(len(order), lo + max(1, (1 << 20) // int(size[lo] + BEFORE + AFTER)))
        hi = lo + max(1, int(np.searchsorted(size[lo:hi], size[lo] * 3 // 2 + 8, "right")))
        part = order[lo:hi]
        out[part] = net.scores(*windows(raw, off[text[part]], off[text[part] + 1], a[part], b[part])) >= net.threshold
        lo = hi
    return out


def _cuts(raw: np.ndarray, a: int, b: int) -> np.ndarray:
    """Where / or = stands in a run; its ends count too."""
    return np.concatenate([[a - 1], a + np.flatnonzero((raw[a:b] == 47) | (raw[a:b] == 61)), [b]])


def _pieces(raw: np.ndarray, a: int, b: int):
    """Parts of a long run between / and =, and overlapping stretches; steps are so short that a key of 40 characters stands
    whole in one of them."""
    cuts = _cuts(raw, a, b)
    yield from ((x + 1, y) for x, y in zip(cuts.tolist(), cuts[1:].tolist()) if LEAST <= y - x - 1 < b - a)
    yield from ((x, x + STRETCH) for x in range(a, b - STRETCH, STEP))
    yield b - STRETCH, b


def _enclosed(raw: np.ndarray, a: int, b: int, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of a long run's findings: parts as they are, other stretches out to the next / or =; those that overlap are one."""
    cuts = _cuts(raw, a, b)
    edges = set(cuts.tolist())
    parts = sorted({(x, y) for x, y in found if x - 1 in edges and y in edges})
    ends = [y for _, y in parts]
    spans = list(parts)
    for x, y in found:
        k = bisect_right(ends, x)  # the first part that ends after x
        if k == len(parts) or parts[k][0] >= y:
            spans.append((int(cuts[np.searchsorted(cuts, x) - 1]) + 1, int(cuts[np.searchsorted(cuts, y)])))
    out: list[tuple[int, int]] = []
    for x, y in sorted(spans):
        if out and x < out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def secret_scan(docs: DataFrame, net: CharCNN | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_assign, n_access, n_hex, n_model, base, spans, found, redacted), one row per input row.

    ``base`` and ``spans`` list kind:start:end (code points, end exclusive) by start, then kind; ``spans`` also holds
    what the network adds (kind ``model``; what a base finding leaves of a run is a candidate of its own).
    ``found``: the texts of all spans; ``redacted``: the text with each span replaced by its kind in brackets. Null and
    empty texts have no findings. Repeated rows and null ids pass through; an empty table gives an empty table. Every
    candidate of a whole text is scored, shorter runs than 16 bytes are none; texts are scanned in slices of a few MB.
    """
    net = net or train()

    def run(batches):
        for batch in batches:
            for b in slices(batch, 1):
                texts = b.column(1).to_pylist()
                base, added = find_in(texts, *buffers(b.column(1)), net)
                every = [sorted(x + y, key=lambda s: (s[0], s[2])) for x, y in zip(base, added, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        *[pa.array([sum(s[2] == k for s in x) for x in every], pa.int64()) for k in range(4)],
                        pa.array([listed(x) for x in base], pa.string()),
                        pa.array([listed(x) for x in every], pa.string()),
                        pa.array([[t[s[0] : s[1]] for s in x] for t, x in zip(texts, every, strict=True)], pa.list_(pa.string())),
                        pa.array([redact(t, x) for t, x in zip(texts, every, strict=True)], pa.string()),
                    ],
                    names=["wl_id", "n_assign", "n_access", "n_hex", "n_model", "base", "spans", "found", "redacted"],
                )

    d = text_of(docs, id_col, text_col)
    return d.mapInArrow(
        run, f"wl_id {d.dtypes[0][1]}, n_assign long, n_access long, n_hex long, n_model long, base string, spans string, found array<string>, redacted string"
    ).withColumnRenamed("wl_id", id_col)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every stretch of overlapping spans replaced by its first kind in brackets."""
    out, end = [], 0
    for a, b, k in spans:
        if a >= end:
            out += [text[end:a], f"[{KINDS[k].upper()}]"]
        end = max(end, b)
    return "".join(out) + text[end:] if spans else text


def digest(base: str) -> str:
    """SHA-256 of a list of spans, lowercase hex."""
    return hashlib.sha256(base.encode()).hexdigest()


def redact_rows(docs: DataFrame, net: CharCNN | None = None, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with secrets in ``text_col`` redacted and, where it exists, ``size_col`` counted anew for changed texts.

    Null texts stay null; all other columns and rows pass through untouched. ``size_col`` must be of an integer type.
    """
    net = net or train()
    at = docs.columns.index(text_col)
    sized = docs.columns.index(size_col) if size_col in docs.columns else None

    def run(batches):
        for batch in batches:
            for b in slices(batch, at):
                old = b.column(at).to_pylist()
                texts = [t or "" for t in old]
                base, added = find_in(texts, *buffers(pa.array(texts, pa.string())), net)
                new = [t if t is None else redact(t, sorted(x + y, key=lambda s: (s[0], s[2]))) for t, x, y in zip(old, base, added, strict=True)]
                cols = list(b.columns)
                cols[at] = pa.array(new, b.schema.field(at).type)
                if sized is not None:
                    sizes = [n if o == t else len(t) for n, o, t in zip(cols[sized].to_pylist(), old, new, strict=True)]
                    cols[sized] = pa.array(sizes, b.schema.field(sized).type)
                yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)
