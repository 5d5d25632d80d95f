"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Small trees are grown on the statistics of a bounded sample of labelled texts; every path from a root to a node is a
rule; an L1-penalised logistic regression keeps few of them; the kept rules are compiled to one Spark column expression
that scores every whole text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.llm.shared import buffers, slices, text_of

STATISTICS = (
    "n_bytes", "n_words", "n_lines", "word_bytes", "line_words", "share_upper", "share_digit", "share_symbol",
    "share_repeat", "share_mark", "share_call", "share_high", "share_odd", "distinct_words", "distinct_lines",
)
SAMPLE_ROWS = 12_000  # most labelled rows that a model is fitted on

_UPPER, _LETTER, _DIGIT, _MARK, _CALL, _HIGH, _ODD, _SPACE = (1 << i for i in range(8))


def _byte_classes() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[65:91] = _UPPER | _LETTER
    t[97:123] = _LETTER
    t[48:58] = _DIGIT
    t[128:] = _HIGH
    t[[*b".,"]] = _MARK
    t[[*b"!?"]] = _CALL
    t[[9, 10, 13, 32]] = _SPACE
    t[[*b"#$%&*+/<=>@\\^_`{|}~[]"]] = _ODD
    return t


CLASS = _byte_classes()
_WORD = re.compile(r"[^\t\n\r ]+")


def statistics(texts: list[str], raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of ``STATISTICS`` per text; shares of an empty text are 0. Words are runs without space, tab, line feed or return."""
    n = np.diff(off)
    kind = CLASS[raw]
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[off])
    count = {k: total((kind & k) > 0) for k in (_UPPER, _LETTER, _DIGIT, _MARK, _CALL, _HIGH, _ODD, _SPACE)}
    plain = (kind & (_LETTER | _DIGIT | _HIGH | _SPACE)) == 0
    repeat = np.zeros(len(raw), bool)
    if len(raw):
        repeat[1:] = plain[1:] & (raw[1:] == raw[:-1])
        repeat[off[:-1][n > 0]] = False  # no text repeats the mark that the one before it ends with
    starts = np.zeros(len(raw), bool)
    gap = (kind & _SPACE) > 0
    if len(raw):
        starts[0] = not gap[0]
        starts[1:] = ~gap[1:] & gap[:-1]
        at = off[:-1][n > 0]
        starts[at] = ~gap[at]
    words = total(starts)
    lines = total(raw == 10) + 1
    div = lambda a, b: a / np.maximum(b, 1)
    different = np.array([(len(set(_WORD.findall(t))), len(set(t.split("\n")))) for t in texts], float).reshape(-1, 2)
    return np.stack(
        [
            n, words, lines, div(n - count[_SPACE], words), div(words, lines), div(count[_UPPER], count[_LETTER]), div(count[_DIGIT], n), div(total(plain), n),
            div(total(repeat), n), div(count[_MARK], words), div(count[_CALL], words), div(count[_HIGH], n), div(count[_ODD], words), div(different[:, 0], words), div(different[:, 1], lines),
        ],
        axis=1,
    ).astype(float)


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, one double per statistic) of whole texts; null counts as empty."""

    def run(batches):
        for batch in batches:
            for b in slices(batch, 1):
                x = statistics(b.column(1).to_pylist(), *buffers(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in x.T]], names=["wl_id", *STATISTICS])

    d = text_of(docs, id_col, text_col)
    return d.mapInArrow(run, f"wl_id {d.dtypes[0][1]}, " + ", ".join(f"{s} double" for s in STATISTICS)).withColumnRenamed("wl_id", id_col)


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, whether above, cut), all must hold


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, cut in rule:
        out &= (x[:, f] > cut) if above else (x[:, f] <= cut)
    return out


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, bins: int, rate: float, seed: int, least: int) -> list[Rule]:
    """The distinct path rules of boosted trees on random halves of the rows and statistics."""
    r = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    code = np.stack([np.searchsorted(q, c, "left") for q, c in zip(cuts, x.T, strict=True)], axis=1)  # <= cut i: code <= i
    z = np.zeros(len(y))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p) + 1e-6
        use = np.flatnonzero(r.random(len(y)) < 0.5)
        feats = [f for f in r.permutation(x.shape[1])[: max(3, x.shape[1] // 2)] if len(cuts[f])]
        todo: list[tuple[Rule, np.ndarray, np.ndarray, int]] = [((), use, np.arange(len(y)), depth)]
        while todo:
            rule, rows, every, left = todo.pop()
            best = None
            gs, hs = g[rows].sum(), h[rows].sum()
            for f in feats if left and len(rows) >= 2 * least else []:
                k = len(cuts[f]) + 1
                ga, ha, na = (np.cumsum(np.bincount(code[rows, f], w, k))[:-1] for w in (g[rows], h[rows], None))
                gain = ga**2 / (ha + 1) + (gs - ga) ** 2 / (hs - ha + 1) - gs**2 / (hs + 1)
                gain[(na < least) | (len(rows) - na < least)] = -1
                c = int(gain.argmax())
                if gain[c] > 1e-6 and (best is None or gain[c] > best[0]):
                    best = (gain[c], f, c)
            if best is None:
                z[every] += rate * gs / (hs + 1)
                continue
            _, f, c = best
            low, low_all = code[rows, f] <= c, code[every, f] <= c
            for above, part, part_all in ((False, low, low_all), (True, ~low, ~low_all)):
                path = (*rule, (int(f), above, float(cuts[f][c])))
                rules[tuple(sorted(path))] = None
                todo.append((path, rows[part], every[part_all], left - 1))
    return list(rules)


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of the L1-penalised logistic regression, by accelerated proximal gradient steps."""
    n = len(y)
    mean, sd = a.mean(0), a.std(0) + 1e-9
    s = (a - mean) / sd
    v = np.ones(s.shape[1])
    for _ in range(20):  # largest curvature, by power iteration
        v = s.T @ (s @ v)
        v /= np.linalg.norm(v) + 1e-12
    lip = max(np.linalg.norm(s @ v) ** 2 / (4 * n), 0.25) * 1.05
    rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    w, b, t = np.zeros(s.shape[1]), float(np.log(rate / (1 - rate))), 1.0
    wm, bm = w, b
    for _ in range(steps):
        d = 1 / (1 + np.exp(-np.clip(s @ wm + bm, -40, 40))) - y
        new = wm - (s.T @ d) / n / lip
        new = np.sign(new) * np.maximum(np.abs(new) - penalty / lip, 0)
        nb = bm - d.mean() / lip
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        wm, bm = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    w = w / sd
    return w, float(b - mean @ w)


@dataclass
class RuleEnsemble:
    """Weighted rules and an intercept; the score is the logistic function of their sum."""

    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    intercept: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 0.002, seed: int = 5) -> RuleEnsemble:
        """A model of 0/1 labels. Without rows the score is 0.5 everywhere; with one class, its smoothed share."""
        if not len(y) or y.min() == y.max():
            p = (y.sum() + 1) / (len(y) + 2)
            return cls([], [], float(np.log(p / (1 - p))))
        rules = tree_rules(x, y, trees, depth, 32, 0.3, seed, max(5, len(y) // 400))
        if not rules:
            return cls([], [], float(np.log((y.mean() + 1e-4) / (1 - y.mean() + 1e-4))))
        a = np.stack([_holds(r, x) for r in rules], axis=1).astype(float)
        _, first = np.unique(a, axis=1, return_index=True)  # rules that hold for the same rows count once
        rules, a = [rules[i] for i in sorted(first)], a[:, sorted(first)]
        w, b = lasso_logistic(a, y, penalty)
        keep = np.flatnonzero(np.abs(w) > 1e-6)
        return cls([rules[i] for i in keep], [float(w[i]) for i in keep], b)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for r, w in zip(self.rules, self.weights, strict=True):
            z += w * _holds(r, x)
        return 1 / (1 + np.exp(-z))

    def column(self, of=F.col) -> Column:
        """The score as a Spark expression over the statistics' columns."""
        z = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights, strict=True):
            c = F.lit(True)
            for f, above, cut in rule:
                x = of(STATISTICS[f])
                c = c & ((x > F.lit(cut)) if above else (x <= F.lit(cut)))
            z = z + F.when(c, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose label is never learned from: crc32 of the id as text is a multiple of 5. Null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> RuleEnsemble:
    """Fit on at most ``sample_rows`` labelled rows that are not held out, chosen by a hash of the id.

    Labels other than 0 and 1, null ids, and labels without a document teach nothing. Of rows that repeat an id the one with the
    least statistics counts, once for each of the id's labels. Null texts are empty ones. Without any row (an empty
    table of either kind) the model scores 0.5; with one class, that class's smoothed share. Other columns don't matter.
    """
    chosen = (
        labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
        .select(F.col(id_col).alias("wl_lid"), F.col(label_col).cast("double").alias("wl_y"))
        .orderBy(F.xxhash64("wl_lid", F.lit(17)), "wl_lid", "wl_y")
        .limit(sample_rows)
        .distinct()
    )
    d = docs.select(F.col(id_col).alias("wl_id"), F.col(text_col).alias("wl_text")).join(F.broadcast(chosen), F.col("wl_id") == F.col("wl_lid"))
    d = d.select(F.struct("wl_id", "wl_y").alias("key"), "wl_text")
    rows = with_statistics(d, "key", "wl_text").groupBy("key.wl_id", "key.wl_y").agg(F.min(F.struct(*STATISTICS)).alias("s"))
    got = rows.select("wl_id", "wl_y", "s.*").toPandas()
    got = got.sort_values(["wl_id", "wl_y", *STATISTICS])  # the fit doesn't hang on the order of tasks
    return RuleEnsemble.fit(got[list(STATISTICS)].to_numpy(float), got["wl_y"].to_numpy(float))


def quality_scores(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, held_out, score, predicted), one row per input row.

    The score is a function of the whole text alone: null and empty texts get that of an empty text. Repeated rows and
    null ids are scored as any other; an empty table gives an empty table.
    """
    d = docs.select(F.col(id_col).alias("wl_key"), F.col(text_col).alias("wl_body"))  # the id may be named as a statistic
    s = with_statistics(d, "wl_key", "wl_body")
    score = model.column()
    return s.select(F.col("wl_key").alias(id_col), held_out("wl_key").alias("held_out"), score.alias("score"), F.when(score >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, whose score reaches the threshold.

    Null texts score as empty ones and stay null; repeated rows and null ids are judged as any other; columns of any name
    pass through. An empty table gives an empty table.
    """
    at, schema = docs.columns.index(text_col), docs.schema

    def run(batches):
        for batch in batches:
            for b in slices(batch, at):
                texts = [t or "" for t in b.column(at).to_pylist()]
                x = statistics(texts, *buffers(pa.array(texts, pa.string())))
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(b.columns, names=[f"c{i}" for i in range(b.num_columns)]), *[pa.array(c) for c in x.T]], names=["wl_row", *STATISTICS])

    fields = ", ".join(f"c{i}: {f.dataType.simpleString()}" for i, f in enumerate(schema))
    s = docs.mapInArrow(run, f"wl_row struct<{fields}>, " + ", ".join(f"{c} double" for c in STATISTICS))
    return s.filter(model.column() >= threshold).select(*[F.col("wl_row").getField(f"c{i}").alias(f.name) for i, f in enumerate(schema)])
