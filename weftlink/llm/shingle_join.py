"""N-gram Jaccard join by chosen paths.

A text is the set of its word n-grams. Sets become fixed signatures of minima; a join tree splits all sets on sampled
coordinates of the signature - sets that share the sampled token go down together - until a bucket is small, where all
pairs are compared by signature. Repetitions with fresh samples bring the recall to the target. Candidates are gathered
to candidate groups, and inside each group every pair's exact Jaccard similarity is computed from the whole sets.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm.components import components
from weftlink.llm.shared import buffers, lean, mix, odd_constants, partitions, ranges, slices, stored, text_of

COORDINATES = 64
LEVELS, DEPTH = 6, 12  # of the join tree: by shuffles, and below a node inside a task
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_ALONE = np.uint64(0x5851F42D4C957F2D)


def _byte_table() -> np.ndarray:
    """A random word per byte; A-Z count as a-z."""
    t = odd_constants(256, 3)
    t[65:91] = t[97:123]
    return t


_BYTES = _byte_table()


def shingles(raw: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the word n-grams of texts, repeats included, and their number per text.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. A text with fewer than ``n`` words has one
    shingle, all its words in order; a text without words has none.
    """
    with np.errstate(over="ignore"):
        texts = len(off) - 1
        if not len(raw):
            return np.zeros(0, np.uint64), np.zeros(texts, np.int64)
        space = _SPACES[raw]
        cut = np.zeros(len(raw) + 1, bool)
        cut[off] = True
        starts = np.flatnonzero(~space & (np.concatenate([[True], space[:-1]]) | cut[:-1]))
        if not len(starts):
            return np.zeros(0, np.uint64), np.zeros(texts, np.int64)
        ends = np.flatnonzero(~space & (np.concatenate([space[1:], [True]]) | cut[1:])) + 1
        # a word's hash: the sum of its bytes' words times powers by position in the word
        pos = np.arange(len(raw), dtype=np.int64)
        base = np.repeat(starts, np.diff(np.append(starts, len(raw))))
        inside = np.zeros(len(raw), np.int64)
        inside[starts[0] :] = pos[starts[0] :] - base
        power = odd_constants(256, 9)
        h = _BYTES[raw] * power[inside & 255] + (inside >> 8).astype(np.uint64)
        h[space] = 0
        word = mix(np.add.reduceat(h, starts) + (ends - starts).astype(np.uint64))
        owner = np.searchsorted(off, starts, "right") - 1
        count = np.bincount(owner, minlength=texts)
        first = np.cumsum(count) - count
        k = odd_constants(n, 21)
        full = np.maximum(count - n + 1, 0)
        at = ranges(first, full)
        got = np.zeros(len(at), np.uint64)
        for i in range(n):
            got += word[at + i] * k[i]
        got = mix(got)
        short = np.flatnonzero((count > 0) & (count < n))
        sizes = full.copy()
        if len(short):
            sizes[short] = 1
            one = np.zeros(len(short), np.uint64)
            for i in range(n - 1):
                has = count[short] > i
                one[has] += word[first[short[has]] + i] * k[i]
            one = mix(one ^ _ALONE ^ count[short].astype(np.uint64))
            out = np.zeros(int(sizes.sum()), np.uint64)
            begin = np.cumsum(sizes) - sizes
            out[ranges(begin, full)] = got
            out[begin[short]] = one
            return out, sizes
        return got, sizes


def sets_of(raw: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle sets of texts, sorted, one after another, and their sizes."""
    h, sizes = shingles(raw, off, n)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[keep], np.bincount(owner[keep], minlength=len(sizes))


def signatures(h: np.ndarray, sizes: np.ndarray, coordinates: int = COORDINATES) -> tuple[np.ndarray, np.ndarray]:
    """For each text with shingles: ``coordinates`` minima (32 bits) and two hashes of the whole set (64 bits each)."""
    full = np.flatnonzero(sizes)
    at = (np.cumsum(sizes) - sizes)[full]
    sig = np.zeros((len(full), coordinates), np.uint32)
    with np.errstate(over="ignore"):
        if len(full):
            k = odd_constants(coordinates, 77)
            for lo in range(0, len(full), 64):  # blocks whose shingles stay in the processor's cache
                hi = min(len(full), lo + 64)
                end = at[hi] if hi < len(full) else len(h)
                x = h[at[lo] : end]
                for c in range(coordinates):
                    sig[lo:hi, c] = np.minimum.reduceat(((x * k[c]) >> np.uint64(32)).astype(np.uint32), at[lo:hi] - at[lo])
        size = sizes[full].astype(np.uint64)
        whole = np.stack([mix(np.add.reduceat(mix(h * k ^ _ALONE), at) + size) for k in odd_constants(2, 55)], axis=1) if len(full) else np.zeros((0, 2), np.uint64)
    return sig, whole


def _sketch(n: int):
    def run(batches):
        for batch in batches:
            for b in slices(batch, 1, 2 << 20):
                h, sizes = sets_of(*buffers(b.column(1)), n)
                sig, whole = signatures(h, sizes)
                full = np.flatnonzero(sizes)
                rows: list = [None] * b.num_rows
                keys: list = [None] * b.num_rows
                for i, k in enumerate(full.tolist()):
                    rows[k], keys[k] = sig[i].tobytes(), whole[i].tobytes()
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(rows, pa.binary())], names=["wl_id", "wl_set", "wl_sig"])

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def meeting_chance(threshold: float, depth: int, repeats: int, least: int, coordinates: int = COORDINATES) -> float:
    """The chance that two sets with a similarity of ``threshold`` meet in a bucket ``depth`` levels down in one of the
    repetitions and agree in ``least`` coordinates. Given how many coordinates agree, the nodes that both sets share are a
    branching process, the same in every repetition; its chance to end comes from its generating function."""
    a = np.arange(coordinates + 1)
    p = 1 / (threshold * coordinates)
    none = (1 - p) ** coordinates  # then one coordinate is taken all the same
    ended = np.zeros(len(a))
    for _ in range(depth):
        ended = (1 - p + p * ended) ** a - none + none * (1 - a / coordinates * (1 - ended))
    agree = np.array([comb(coordinates, int(k)) for k in a], float) * threshold**a * (1 - threshold) ** (coordinates - a)
    return float((agree * (1 - ended**repeats))[least:].sum())


def _chosen(path: int, threshold: float, coordinates: int) -> np.ndarray:
    """The coordinates sampled at a node: each with probability 1 / (threshold * coordinates), at least one."""
    with np.errstate(over="ignore"):
        r = _unit(mix(np.arange(1, coordinates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(path & (2**64 - 1))))
    got = np.flatnonzero(r < 1 / (threshold * coordinates))
    return got if len(got) else np.array([int(r.argmin())])


def _down(path: int, c: int, values: np.ndarray) -> np.ndarray:
    """Names of the child nodes for the values of coordinate ``c``."""
    with np.errstate(over="ignore"):
        return mix(mix(values.astype(np.uint64) + np.uint64((c + 1) << 40)) ^ np.uint64(path & (2**64 - 1)))


def _split(threshold: float, repeats: int | None):
    """(node, id, signature) -> (child node, id); with ``repeats`` the rows stand at the roots."""

    def run(batches):
        for b in batches:
            sig = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint32).reshape(b.num_rows, -1)
            ids = b.column(1).to_numpy(zero_copy_only=False)
            nodes = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            jobs = [(r * 0x1000003 + 7, np.arange(len(ids))) for r in range(1, repeats + 1)] if repeats else [(int(v), np.flatnonzero(nodes == v)) for v in np.unique(nodes)]
            for path, rows in jobs:
                for c in _chosen(path, threshold, sig.shape[1]).tolist():
                    kids = _down(path, c, sig[rows, c]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(kids), pa.array(ids[rows])], names=["node", "id"])

    return run


class Forest:
    """Connected sets over positions as an array of labels; ``link`` tells the links that joined two sets."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, i: int, others: np.ndarray) -> list[int]:
        """Link position ``i`` with ``others``: one of them for each set that was not ``i``'s."""
        names, first = np.unique(self.label[others], return_index=True)
        new = names != self.label[i]
        if not new.any():
            return []
        gone = np.append(names, self.label[i])
        self.label[np.isin(self.label, gone)] = gone.min()
        return others[first[new]].tolist()


def _agree(sig: np.ndarray, row: np.ndarray, least: int) -> np.ndarray:
    return (sig == row).sum(1, dtype=np.int16) >= least


def _bucket_edges(path: int, rows: np.ndarray, sig: np.ndarray, least: int, threshold: float, small: int, depth: int, forest: Forest, out: list) -> None:
    """The join tree below a node, inside a task: split on sampled coordinates until a bucket is small, hangs together
    or no longer splits; there all pairs are compared. Links that join two sets are added to ``out``."""
    same = forest.label[rows]
    if (same == same[0]).all():  # all pairs meet again in the candidate group
        return
    if len(rows) > small and depth:
        first = rows[0]
        near = _agree(sig[rows], sig[first], least)
        out += [(first, j) for j in forest.link(first, rows[near])]
        if near.all():
            return
        for c in _chosen(path, threshold, sig.shape[1]).tolist():
            kids = _down(path, c, sig[rows, c])
            order = np.argsort(kids, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(kids[order])) + 1):
                if len(part) > 1:
                    _bucket_edges(int(kids[part[0]]), rows[part], sig, least, threshold, small, depth - 1, forest, out)
        return
    own = sig[rows]
    for k in range(len(rows) - 1):
        near = np.flatnonzero(_agree(own[k + 1 :], own[k], least))
        if len(near):
            out += [(rows[k], j) for j in forest.link(rows[k], rows[k + 1 + near])]


def _edges(least: int, threshold: float, small: int, depth: int):
    """All rows of a partition's nodes -> links of a spanning forest of each node's candidate pairs."""

    def run(batches):
        got = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint32)) for b in batches if b.num_rows]
        if not got:
            return
        nodes, ids = (np.concatenate([g[k] for g in got]).astype(np.int64) for k in (0, 1))
        sig = np.concatenate([g[2] for g in got]).reshape(len(ids), -1)
        del got
        us, vs = [], []
        order = np.argsort(nodes, kind="stable")
        cut = np.append(np.flatnonzero(np.concatenate([[True], np.diff(nodes[order]) != 0])), len(order))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            part = order[a:b]
            out: list = []
            _bucket_edges(int(nodes[part[0]]), np.arange(b - a), sig[part], least, threshold, small, depth, Forest(b - a), out)
            us += [int(ids[part[i]]) for i, _ in out]
            vs += [int(ids[part[j]]) for _, j in out]
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def _overlaps(h: np.ndarray, bounds: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets ``a`` with sets ``b``: products of 0/1 blocks over the shared shingles."""
    rows = np.concatenate([a, b])
    sizes = bounds[rows + 1] - bounds[rows]
    flat = h[ranges(bounds[rows], sizes)]
    words, code = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), sizes)
    left = np.bincount(code[owner < len(a)], minlength=len(words)) > 0
    right = np.bincount(code[owner >= len(a)], minlength=len(words)) > 0
    new = np.cumsum(left & right) - 1
    keep = (left & right)[code]
    code, owner = new[code[keep]], owner[keep]
    total = np.zeros((len(a), len(b)), np.float32)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    for lo in range(0, int(new[-1]) + 1 if len(new) else 0, 2048):
        s, e = np.searchsorted(code, [lo, lo + 2048])
        block = np.zeros((len(rows), 2048), np.float32)
        block[owner[s:e], code[s:e] - lo] = 1
        total += block[: len(a)] @ block[len(a) :].T
    return total


def _exact(threshold: float):
    """Rows (cell, side, id, weight, set) of a partition -> (u, v, n): v null: n links of u; else u and v are linked."""

    def cell(ids, weight, h, bounds, a, b, same):
        nu, fu, fv = np.zeros(len(ids)), [], []
        forest = Forest(len(ids))
        size = np.diff(bounds)
        for lo in range(0, len(a), 256):
            for co in range(0, len(b), 256):
                if same and co + 256 <= lo:
                    continue
                x, y = a[lo : lo + 256], b[co : co + 256]
                inter = _overlaps(h, bounds, x, y)
                union = size[x][:, None] + size[y][None] - inter
                hit = inter >= threshold * union - 1e-6
                if same:
                    hit &= x[:, None] < y[None]
                i, j = np.nonzero(hit)
                np.add.at(nu, x[i], weight[y[j]])
                np.add.at(nu, y[j], weight[x[i]])
                for p, q in zip(x, hit, strict=True):
                    for other in forest.link(int(p), y[q]) if q.any() else ():
                        fu.append(int(ids[p]))
                        fv.append(int(ids[other]))
        return nu, fu, fv

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        cells, side, ids, weight = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in range(4))
        raw = [x for b in held for x in b.column(4).to_pylist()]
        bounds = np.concatenate([[0], np.cumsum([len(x) // 8 for x in raw])])
        h = np.frombuffer(b"".join(raw), np.uint64)
        del raw, held
        us, vs, ns = [], [], []
        order = np.lexsort((ids, cells))
        for part in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1):
            if len(part) == 2 and side[part].max() == 0:
                p, q = part
                x, y = h[bounds[p] : bounds[p + 1]], h[bounds[q] : bounds[q + 1]]
                n = len(np.intersect1d(x, y, assume_unique=True))
                if n >= threshold * (len(x) + len(y) - n) - 1e-6:
                    us += [int(ids[p]), int(ids[q]), int(ids[p])]
                    vs += [None, None, int(ids[q])]
                    ns += [int(weight[q]), int(weight[p]), 0]
                continue
            same = side[part].max() == 0
            sizes = np.diff(bounds)[part]
            own = np.concatenate([[0], np.cumsum(sizes)])
            local = h[ranges(bounds[part], sizes)]
            here = np.arange(len(part))
            a = here if same else here[side[part] == 1]
            b = here if same else here[side[part] == 2]
            n, fu, fv = cell(ids[part], weight[part], local, own, a, b, same)
            some = np.flatnonzero(n)
            us += ids[part][some].tolist() + fu
            vs += [None] * len(some) + fv
            ns += n[some].astype(int).tolist() + [0] * len(fu)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64()), pa.array(ns, pa.int64())], names=["u", "v", "n"])

    return run


def shingle_join(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, small: int = 96, large: int = 4096, group: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(``id_col``, n_links, class_id), one row per input row: the self-join of word n-gram sets at Jaccard >= threshold.

    ``n_links``: other rows linked directly, equal sets included; ``class_id``: the smallest id reachable by links, the
    row's own included. Ids must be 64-bit integers. Texts without words (null, empty, white space) link with nothing: 0
    links, their own class. Texts of fewer than ``n`` words are one shingle. Repeated rows count as rows of their own.
    Rows with a null id link with nothing and have a null class. An empty table gives an empty table.

    Sets that are equal are merged before anything else, so copies are never paired. Buckets over ``small`` are split
    further; nodes over ``large`` rows are split by further shuffles, and what never splits is compared in square cells of
    bounded size. Every pair inside a candidate group - groups over ``group`` rows likewise in cells - is decided exactly
    by its whole sets. ``recall``: the least chance that a pair at the threshold becomes a candidate, at the tree's greatest
    depth; the number of repetitions follows from it (``meeting_chance``). Equal sets are those whose 128 bits of
    hashes agree.
    """
    spark = docs.sparkSession
    d = text_of(docs, id_col, text_col).withColumn("wl_id", F.col("wl_id").cast("long"))
    # chance agreement: a pair at the threshold agrees in fewer coordinates only with a probability of about 1 in 10,000
    least = max(1, int(np.floor(COORDINATES * threshold - 3.7 * (COORDINATES * threshold * (1 - threshold)) ** 0.5)))
    most = meeting_chance(threshold, 0, 1, least)  # what the agreement alone leaves
    repeats = next(r for r in range(1, 1000) if meeting_chance(threshold, LEVELS + DEPTH, r, least) >= min(recall, most - 1e-5))
    rows = stored(d.mapInArrow(lean(_sketch(n)), "wl_id long, wl_set binary, wl_sig binary"), "sketches")
    real = rows.filter("wl_set is not null and wl_id is not null")
    reps = real.groupBy("wl_set").agg(F.min("wl_id").alias("id"), F.count("*").alias("weight"), F.first("wl_sig").alias("sig"))
    # numbers stand for sets from here on: ids may be equal where rows repeat one
    keyed = stored(reps.select(F.monotonically_increasing_id().alias("id"), "sig", "weight", F.col("id").alias("least_id"), "wl_set"), "sets")
    parts = partitions(spark)
    nodes = keyed.select(F.lit(0).cast("long").alias("node"), "id", "sig").mapInArrow(lean(_split(threshold, repeats)), "node long, id long")
    edge_tables = []
    for level in range(LEVELS + 1):
        nodes = stored(nodes, "nodes")
        sizes = nodes.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
        # most nodes hold one set: only the others get their signatures
        shared = nodes.join(sizes, "node").join(keyed.select("id", "sig"), "id").select("node", "id", "sig", "size")
        shared = stored(shared, "shared-nodes")
        if level == LEVELS:  # what sampled coordinates don't split is compared in square cells
            cells = _cells(shared, "node", "size", large // 2).select("cell", "id", "sig")
            edge_tables.append(cells.repartition(parts, "cell").mapInArrow(lean(_edges(least, threshold, large, 0)), "u long, v long"))
            break
        here = shared.filter(F.col("size") <= large).select("node", "id", "sig")
        edge_tables.append(here.repartition(parts, "node").mapInArrow(lean(_edges(least, threshold, small, DEPTH)), "u long, v long"))
        more = shared.filter(F.col("size") > large).select("node", "id", "sig")
        if not more.limit(1).count():
            break
        nodes = more.mapInArrow(lean(_split(threshold, None)), "node long, id long")
    edges = edge_tables[0]
    for e in edge_tables[1:]:
        edges = edges.unionByName(e)
    groups = components(edges)
    member = keyed.join(groups, "id").select("wl_set", F.col("id").alias("set_id"), "weight", F.col("component").alias("grp"), "least_id")
    member = stored(member, "members")
    sizes = member.groupBy("grp").agg(F.count("*").alias("size"))
    # one text per set: the row with the least id (of rows that repeat it, any: their sets are equal)
    first = rows.join(member, "wl_set").filter(F.col("wl_id") == F.col("least_id")).dropDuplicates(["set_id"]).select("wl_id", "wl_set", "set_id", "grp", "weight")
    texts = d.join(first, "wl_id").select(F.struct("wl_set", "set_id", "grp", "weight").alias("key"), "wl_text")

    def whole(batches):
        for batch in batches:
            for b in slices(batch, 1, 2 << 20):
                h, sizes = sets_of(*buffers(b.column(1)), n)
                at = np.cumsum(sizes) - sizes
                sets = [h[s : s + k].tobytes() for s, k in zip(at.tolist(), sizes.tolist(), strict=True)]
                _, hashes = signatures(h, sizes, 0)
                right = np.zeros(len(sizes), bool)
                keys = b.column(0).flatten()
                want = np.frombuffer(b"".join(keys[0].to_pylist()), np.uint64).reshape(-1, 2)
                full = np.flatnonzero(sizes)
                right[full] = (hashes == want[full]).all(1)
                out = pa.RecordBatch.from_arrays([*keys[1:], pa.array(sets, pa.binary())], names=["set_id", "grp", "weight", "shingles"])
                yield out.filter(pa.array(right))

    sets = texts.mapInArrow(lean(whole), "set_id long, grp long, weight long, shingles binary").dropDuplicates(["set_id"]) if _ids_repeat(rows) else texts.mapInArrow(lean(whole), "set_id long, grp long, weight long, shingles binary")
    cells = _cells(sets.withColumnRenamed("set_id", "id").join(sizes, "grp"), "grp", "size", group).select("cell", "side", "id", "weight", "shingles")
    found = stored(cells.repartition(parts * 2, "cell").mapInArrow(lean(_exact(threshold)), "u long, v long, n long"), "links")
    links = found.filter("v is null").groupBy("u").agg(F.sum("n").alias("n"))
    classes = components(found.filter("v is not null").select("u", "v"))
    per_set = (
        keyed.select("wl_set", "id", "weight", "least_id")
        .join(links.withColumnRenamed("u", "id"), "id", "left")
        .join(classes, "id", "left")
        .select("wl_set", "least_id", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("class"))
    )
    per_set = stored(per_set, "set-links")
    named = per_set.groupBy("class").agg(F.min("least_id").alias("class_id"))
    per_set = per_set.join(named, "class").select("wl_set", "n_links", "class_id")
    out = rows.select("wl_id", F.when(F.col("wl_id").isNotNull(), F.col("wl_set")).alias("wl_set")).join(per_set, "wl_set", "left")
    return out.select(F.col("wl_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class_id", "wl_id").alias("class_id"))


def _ids_repeat(rows: DataFrame) -> bool:
    return bool(rows.filter("wl_id is not null").groupBy("wl_id").count().filter("count > 1").limit(1).count())


def _cells(df: DataFrame, key: str, size: str, most: int) -> DataFrame:
    """Rows of groups with at most ``most`` rows get one cell (side 0). Larger groups are dealt by a hash of ``id`` to
    strips; a row goes to the cells of its strip with every strip, so each pair of rows meets in exactly one cell."""
    k = F.ceil(F.col(size) / most).cast("int")
    strip = F.pmod(F.xxhash64("id", F.lit(5)), k).cast("int")
    with_strip = df.withColumn("wl_k", k).withColumn("wl_strip", strip)
    other = F.when(F.col("wl_k") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("wl_k") - 1))
    pairs = with_strip.withColumn("wl_other", F.explode(other))
    lo, hi = F.least("wl_strip", "wl_other"), F.greatest("wl_strip", "wl_other")
    side = F.when(F.col("wl_k") == 1, 0).when(F.col("wl_strip") == F.col("wl_other"), 0).when(F.col("wl_strip") < F.col("wl_other"), 1).otherwise(2)
    cell = F.when(F.col("wl_k") == 1, F.xxhash64(key)).otherwise(F.xxhash64(key, lo, hi))
    return pairs.withColumn("cell", cell).withColumn("side", side.cast("int"))


def keep_one(docs: DataFrame, n: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are not their class's first: of each group of linked rows the least id stays.

    Rows with a null id, and rows without words, stay.
    """
    gone = shingle_join(docs, n, threshold, id_col=id_col, text_col=text_col).filter("class_id is not null").filter(F.col(id_col) != F.col("class_id"))
    name = "wl_gone"
    while name in docs.columns:
        name += "_"
    gone = gone.select(F.col(id_col).cast("long").alias(name)).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone[name], "left_anti")
