"""Near-duplicate embeddings over an inverted multi-index.

Vectors are cut in two halves; each half has a codebook of its own, so the pairs of codewords form a grid of cells. A
vector is stored in one cell and looks for neighbours in the cells that a multi-sequence traversal visits, nearest
first, as many as a bounded sample needed for the target recall. The codebooks grow with the table, so that a cell keeps
its size. In a cell every visitor is verified against every resident by the exact cosine in double precision.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlink.llm.components import components
from weftlink.llm.shared import lean, mix, partitions, stored
from weftlink.llm.shingle_join import Forest

SAMPLE_ROWS = 20_000  # most vectors that codebooks and the number of visits are fitted on
WIDTH = 512  # components of a half that codebooks see; longer halves are folded to it
LEAST_WORDS = 4  # codewords of a half at least; at most an eighth of the sample

def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    r = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[r.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = ((c**2).sum(1)[None] - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def multi_sequence(da: np.ndarray, db: np.ndarray, most: int) -> list[tuple[float, int, int]]:
    """Cells (distance, i, j) of the grid in order of the summed distances, the first ``most``."""
    oa, ob = da.argsort(kind="stable"), db.argsort(kind="stable")
    heap, out, seen = [(da[oa[0]] + db[ob[0]], 0, 0)], [], {(0, 0)}
    while heap and len(out) < most:
        d, i, j = heapq.heappop(heap)
        out.append((float(d), int(oa[i]), int(ob[j])))
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(oa) and b < len(ob) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (da[oa[a]] + db[ob[b]], a, b))
    return out


@dataclass
class MultiIndex:
    """Two codebooks and the number of cells that a search visits."""

    first: np.ndarray
    second: np.ndarray
    visits: int

    @classmethod
    def fit(cls, a: np.ndarray, b: np.ndarray, x: list[np.ndarray], groups: np.ndarray, words: int, threshold: float, recall: float, seed: int = 3) -> MultiIndex:
        """Codebooks from the halves ``a`` and ``b`` of the unit vectors ``x``; visits so that ``recall`` of the sample's
        links (equal group, cosine at or over ``threshold``) are found, measured by brute force, and as much of links
        exactly at the threshold, made from vectors of the sample by a turn in a random direction."""
        index = cls(_kmeans(a, words, seed), _kmeans(b, words, seed + 1), 1)
        r = np.random.default_rng(seed)
        width = a.shape[1]
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        by_group: dict[object, list[int]] = {}
        for k in r.permutation(len(x)).tolist():
            by_group.setdefault(groups[k], []).append(k)
        left = 2000  # vectors whose links are looked up, 20,000 links in all
        for rows in by_group.values():
            part, every = rows[:left], np.array([x[k] for k in rows])
            left -= len(part)
            for lo in range(0, len(part), 256):
                i, j = np.nonzero(every[lo : min(lo + 256, len(part))] @ every.T >= threshold)
                i += lo
                i, j = i[i != j][:20_000], j[i != j][:20_000]
                rows_ = np.array(rows)
                ends.append((rows_[i], rows_[j]))
            if left <= 0:
                break
        need = []
        u, v = (np.concatenate([e[k] for e in ends]) if ends else np.zeros(0, np.int64) for k in (0, 1))
        use = r.permutation(len(u))[:2000]
        if len(use):
            need.append(index._need((a[u[use]], b[u[use]]), (a[v[use]], b[v[use]]), recall))
        some = r.permutation(len(x))[:1000].tolist()
        moved = []
        for k in some:
            noise = r.normal(size=len(x[k]))
            noise -= noise @ x[k] * x[k]
            size = np.linalg.norm(noise)
            moved.append(threshold * x[k] + (1 - threshold**2) ** 0.5 * noise / size if size > 1e-9 else x[k])
        ma, mb = halves(np.concatenate(moved), np.array([len(m) for m in moved]), width)
        need.append(index._need((a[some], b[some]), (ma, mb), recall))
        index.visits = max(need)
        return index

    def _need(self, u: tuple[np.ndarray, np.ndarray], v: tuple[np.ndarray, np.ndarray], recall: float) -> int:
        """Visits after which ``recall`` of the links are found; either end may find one."""
        ranks = np.minimum(self.rank(*u, self.home(*v)), self.rank(*v, self.home(*u)))
        return int(np.quantile(ranks, recall, method="higher")) + 1

    def _far(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple((h**2).sum(1)[:, None] - 2 * h @ c.T + (c**2).sum(1)[None] for h, c in ((a, self.first), (b, self.second)))  # type: ignore[return-value]

    def home(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        da, db = self._far(a, b)
        return da.argmin(1) * len(self.second) + db.argmin(1)

    def rank(self, a: np.ndarray, b: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """How many cells the traversal from each vector visits before ``cell``."""
        out = np.zeros(len(a), np.int64)
        for lo in range(0, len(a), 256):
            da, db = self._far(a[lo : lo + 256], b[lo : lo + 256])
            i, j = np.divmod(cell[lo : lo + 256], len(self.second))
            for k, (p, q) in enumerate(zip(da, db, strict=True)):
                out[lo + k] = np.searchsorted(np.sort(q), p[i[k]] + q[j[k]] - p - 1e-12, "left").sum()
        return out

    def search(self, a: np.ndarray, b: np.ndarray) -> list[list[int]]:
        da, db = self._far(a, b)
        return [[i * len(self.second) + j for _, i, j in multi_sequence(p, q, self.visits)] for p, q in zip(da, db, strict=True)]


def _usable(c: str) -> F.Column:
    """Vectors with components, all finite, not all zero; a vector with a null component is not."""
    ok = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(F.col(c).isNotNull() & (F.size(c) > 0) & ok & F.exists(c, lambda v: v != 0), F.lit(False))


def unit(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Vectors of any lengths, one after another, each scaled to length 1, in double precision."""
    at = np.cumsum(sizes) - sizes
    x = flat.astype(np.float64)
    x /= np.repeat(np.maximum.reduceat(np.abs(x), at), sizes)
    return x / np.repeat(np.sqrt(np.add.reduceat(x * x, at)), sizes)


def halves(flat: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The first and the second half of each vector as rows of ``width``: shorter ones are filled with zeros, of longer ones
    the components beyond are added to the first, with signs by their place."""
    at = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(at, sizes)
    cut = np.repeat(sizes // 2, sizes)
    second = place >= cut
    place = np.where(second, place - cut, place)
    with np.errstate(over="ignore"):
        sign = np.where((place >= width) & (mix(place.astype(np.uint64)) & np.uint64(1) > 0), -1.0, 1.0)
    to, value = row * width + place % width, flat * sign
    return tuple(np.bincount(to[part], value[part], len(sizes) * width).reshape(-1, width) for part in (~second, second))  # type: ignore[return-value]


def _keyed(kind: np.dtype):
    """(id, group, vector or null) -> the vector's bytes and a digest of group and vector; -0.0 counts as 0.0."""

    def run(batches):
        for b in batches:
            vec = b.column(2)
            sizes = vec.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = vec.flatten().to_numpy(zero_copy_only=False).astype(kind) + kind.type(0)
            cuts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            none = vec.is_null().to_pylist()
            raw = [None if z else flat[x:y].tobytes() for z, x, y in zip(none, cuts, cuts[1:])]
            keys = [None if v is None else hashlib.sha256(len(g := group.encode("utf-8", "surrogatepass")).to_bytes(8, "little") + g + v).digest() for group, v in zip(b.column(1).to_pylist(), raw, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), b.column(1), pa.array(sizes, pa.int32()), pa.array(raw, pa.binary())], names=["wl_id", "wl_key", "wl_grp", "wl_dim", "wl_vec"])

    return run


def _visit(index: MultiIndex, kind: np.dtype, width: int):
    """(set, group, length, vector, weight) -> one row per visited cell; the vector's own cell also holds the list of all."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                sizes = b.column(2).to_numpy().astype(np.int64)
                h = halves(unit(np.frombuffer(b"".join(b.column(3).to_pylist()), kind), sizes), sizes, width)
                home, cells = index.home(*h), index.search(*h)
                cells = [[h, *[c for c in v if c != h]] for h, v in zip(home.tolist(), cells, strict=True)]
                many = np.array([len(v) for v in cells])
                at = np.repeat(np.arange(len(cells)), many)
                first = np.cumsum(many) - many
                seen: list = [None] * len(at)
                for k, v in zip(first.tolist(), cells, strict=True):
                    seen[k] = np.array(v, np.int32).tobytes()
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(k).take(take) for k in (0, 1, 2)], pa.array([c for v in cells for c in v], pa.int32()), pa.array(home[at].astype(np.int32)), pa.array(seen, pa.binary()), b.column(3).take(take), b.column(4).take(take)],
                    names=["id", "grp", "dim", "cell", "home", "seen", "vec", "weight"],
                )

    return run


def meet(vec: np.ndarray, ids: np.ndarray, weight: np.ndarray, cell: int, home: np.ndarray, seen: list, role: np.ndarray, threshold: float) -> list[tuple[int, int | None, int]]:
    """Residents and visitors of one cell -> (u, v, n): v null: n links of u; else u and v are linked, enough of those to
    join what hangs together. ``role`` 1: stands as resident here; 2: as visitor; 3: both."""
    res, vis = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    forest, n, out = Forest(len(ids)), np.zeros(len(ids), np.int64), []
    paths = np.frombuffer(b"".join(seen[k] for k in res.tolist()), np.int32)
    cuts = np.cumsum([0, *[len(seen[k]) // 4 for k in res.tolist()]])
    goes: dict[int, np.ndarray] = {}  # whether each resident visits a cell itself
    for lo in range(0, len(vis), 1024):
        a = vis[lo : lo + 1024]
        for co in range(0, len(res), 2048):
            b = res[co : co + 2048]
            hit = (vec[a] @ vec[b].T >= threshold) & (ids[a][:, None] != ids[b][None])
            some = np.flatnonzero(hit.any(1))
            if not len(some):
                continue
            a_, hit = a[some], hit[some]
            n[a_] += hit @ weight[b]  # the visitor comes to the resident's cell once
            # the resident counts a link here unless it visits the visitor's own cell itself
            for other in np.unique(home[a_][home[a_] != cell]).tolist():
                if other not in goes:
                    sums = np.concatenate([[0], np.cumsum(paths == other)])
                    goes[other] = sums[cuts[1:]] > sums[cuts[:-1]]
                rows = home[a_] == other
                n[b] += np.where(goes[other][co : co + 2048], 0, weight[a_[rows]] @ hit[rows])
            for k, i in enumerate(a_.tolist()):
                out += [(int(ids[i]), int(ids[j]), 0) for j in forest.link(i, b[hit[k]])]
    return out + [(int(ids[k]), None, int(n[k])) for k in np.flatnonzero(n).tolist()]


def _verify(kind: np.dtype, threshold: float):
    """Rows sorted by (group, length, cell, strips) -> what ``meet`` finds in each; one cell is held at a time."""

    def run(batches):
        held, last, out = [], None, []

        def settle():
            part = pa.Table.from_batches(held)
            role = part["role"].to_numpy()
            if (role & 1).any() and len(role) > 1:
                ids, weight, home = (part[c].to_numpy() for c in ("id", "weight", "home"))
                sizes = np.full(len(ids), part["dim"][0].as_py())
                vec = unit(np.frombuffer(b"".join(part["vec"].to_pylist()), kind), sizes).reshape(len(ids), -1)
                out.extend(meet(vec, ids, weight, part["cell"][0].as_py(), home, part["seen"].to_pylist(), role, threshold))

        def batch():
            us, vs, ns = zip(*out) if out else ((), (), ())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64()), pa.array(ns, pa.int64())], names=["u", "v", "n"])

        for b in batches:
            if not b.num_rows:
                continue
            grp = b.column(b.schema.get_field_index("grp")).dictionary_encode()
            codes = [grp.indices.to_numpy(), *[b.column(b.schema.get_field_index(c)).to_numpy() for c in ("dim", "cell", "a", "b")]]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1
            edges = [0, *new.tolist(), b.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                key = (grp.dictionary[int(codes[0][lo])].as_py(), *[int(c[lo]) for c in codes[1:]])
                if key != last and held:
                    settle()
                    held = []
                    if len(out) > 50_000:
                        yield batch()
                held.append(b.slice(lo, hi - lo))
                last = key
        if held:
            settle()
        yield batch()

    return run


def vector_dedup(
    vectors: DataFrame, threshold: float = 0.93, recall: float = 0.999, cell: int = 256, strip: int = 4096, sample_rows: int = SAMPLE_ROWS, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str | None = "label"
) -> DataFrame:
    """(``id_col``, n_links, component_id, kept), one row per input row.

    Two vectors are compared when of equal length and, with ``group_col``, of equal groups that aren't null; they are
    linked at a cosine >= ``threshold`` in double precision. ``n_links``: other rows linked directly; ``component_id``:
    the smallest id reachable; ``kept``: the row's id is that. Null, empty and zero vectors, and those
    with null or non-finite components link with nothing. Ids must be 64-bit integers and name a row: repeated rows are
    vectors of their own and links of one another. Rows with a null id link with nothing. An empty table gives an empty
    table. Equal vectors of a group are merged first, by a SHA-256 of group and vector. The codebooks are so large that a
    cell of a group of usual size holds ``cell`` vectors, up to an eighth of the sample; a cell with more than ``strip``
    residents or visitors is dealt to strips, so copies and crowded cells never meet in one task. Codebooks are fitted on
    at most ``sample_rows`` vectors of all lengths; every vector is indexed.
    """
    group = F.lit("") if group_col is None else F.col(group_col).cast("string")
    single = isinstance(vectors.schema[vector_col].dataType, T.ArrayType) and isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    kind = np.dtype("<f4" if single else "<f8")
    d = vectors.select(F.col(id_col).cast("long").alias("wl_id"), group.alias("wl_grp"), F.col(vector_col).cast(T.ArrayType(T.FloatType() if single else T.DoubleType())).alias("wl_vec"))
    good = F.col("wl_id").isNotNull() & F.col("wl_grp").isNotNull() & _usable("wl_vec")
    d = d.select("wl_id", "wl_grp", F.when(good, F.col("wl_vec")).alias("wl_vec"))
    rows = stored(d.mapInArrow(lean(_keyed(kind)), "wl_id long, wl_key binary, wl_grp string, wl_dim int, wl_vec binary"), "vectors")
    sets = rows.filter("wl_key is not null").groupBy("wl_key").agg(F.first("wl_grp").alias("grp"), F.first("wl_dim").alias("dim"), F.first("wl_vec").alias("vec"), F.min("wl_id").alias("least_id"), F.count("*").alias("weight"))
    sets = stored(sets.withColumn("id", F.monotonically_increasing_id()), "distinct-vectors")
    found = stored(_links(sets, kind, threshold, recall, cell, strip, sample_rows), "vector-links")
    links = found.filter("v is null").groupBy("u").agg(F.sum("n").alias("n"))
    classes = components(found.filter("v is not null").select("u", "v"))
    per_set = (
        sets.select("wl_key", "id", "weight", "least_id")
        .join(links.withColumnRenamed("u", "id"), "id", "left")
        .join(classes, "id", "left")
        .select("wl_key", "least_id", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("class"))
    )
    per_set = stored(per_set, "vector-classes")
    named = per_set.groupBy("class").agg(F.min("least_id").alias("component_id"))
    per_set = per_set.join(named, "class").select("wl_key", "n_links", "component_id")
    out = rows.select("wl_id", "wl_key").join(per_set, "wl_key", "left").select("wl_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "wl_id").alias("component_id"))
    return out.select(F.col("wl_id").alias(id_col), "n_links", "component_id", F.col("wl_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _links(sets: DataFrame, kind: np.dtype, threshold: float, recall: float, cell: int, strip: int, sample_rows: int) -> DataFrame:
    """(u, v, n) of distinct vectors: v null: n links of u; else u and v are linked."""
    spark = sets.sparkSession
    usual = sets.groupBy("grp", "dim").agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n")) / F.sum("n"), F.max("dim")).first()
    if usual[0] is None:
        return spark.createDataFrame([], "u long, v long, n long")
    sample = sets.orderBy(F.xxhash64("wl_key", F.lit(9)), "wl_key").limit(sample_rows).select("grp", "dim", "vec").collect()
    sizes = np.array([r.dim for r in sample])
    flat = unit(np.frombuffer(b"".join(bytes(r.vec) for r in sample), kind), sizes)
    width = min(WIDTH, int(usual[1] + 1) // 2)
    words = min(max(LEAST_WORDS, ceil(sqrt(usual[0] / cell))), max(LEAST_WORDS, len(sample) // 8))
    groups = np.empty(len(sample), object)
    groups[:] = [(r.grp, r.dim) for r in sample]
    index = MultiIndex.fit(*halves(flat, sizes, width), np.split(flat, np.cumsum(sizes)[:-1]), groups, words, threshold, recall)
    visits = sets.select("id", "grp", "dim", "vec", "weight").mapInArrow(lean(_visit(index, kind, width)), "id long, grp string, dim int, cell int, home int, seen binary, vec binary, weight long")
    visits = stored(visits, "visits")
    keys = ["grp", "dim", "cell"]
    size = visits.groupBy(*keys).agg(F.count("*").alias("n"), F.count("seen").alias("r")).filter("r > 0 and n > 1")
    size = size.select(*keys, F.ceil(F.col("r") / strip).cast("int").alias("ka"), F.ceil(F.col("n") / strip).cast("int").alias("kb"))
    # strip a of the residents meets strip b of the visitors in a place of its own
    placed = visits.join(size, keys).withColumn("my_a", F.pmod(F.xxhash64("id", F.lit(5)), F.col("ka")).cast("int")).withColumn("my_b", F.pmod(F.xxhash64("id", F.lit(6)), F.col("kb")).cast("int"))
    resident = F.col("seen").isNotNull()
    as_visitor = F.transform(F.sequence(F.lit(0), F.col("ka") - 1), lambda s: F.struct(s.alias("a"), F.col("my_b").alias("b"), F.when(resident & (s == F.col("my_a")), 3).otherwise(2).alias("role")))
    as_resident = F.transform(F.sequence(F.lit(0), F.col("kb") - 1), lambda s: F.struct(F.col("my_a").alias("a"), s.alias("b"), F.lit(1).alias("role")))
    as_resident = F.filter(as_resident, lambda s: resident & (s["b"] != F.col("my_b")))
    spread = placed.withColumn("at", F.explode(F.concat(as_visitor, as_resident)))
    spread = spread.select("grp", "dim", "cell", F.col("at.a").alias("a"), F.col("at.b").alias("b"), "id", "home", "seen", "vec", "weight", F.col("at.role").alias("role"))
    place = ["grp", "dim", "cell", "a", "b"]
    return spread.repartition(partitions(spark) * 2, *place).sortWithinPartitions(*place).mapInArrow(lean(_verify(kind, threshold)), "u long, v long, n long")
