"""Exact deduplication over a cuckoo-filter index of live digests, kept as a table.

A digest (SHA-256 of the text, A-Z lower-cased) belongs to one shard of the index by its leading bits. A shard is a
cuckoo filter - four fingerprints a bucket, two buckets a digest - and, in the order of the filter's slots, the content
that the fingerprints stand for: whole digests with the largest id and the number of rows. A lookup that the filter
refuses needs no content; a hit is verified against the content of the slots that it hit. Digests can be deleted again;
an insertion that finds no place after the allowed evictions doubles the filter, rebuilt from the stored keys.

An update reads the index's table, changes each shard in one task and writes a new table, so an executor lost on the way
costs nothing but its tasks. Shards follow the number of digests; a task holds one shard at a time.
"""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.llm.shared import partitions, stored, text_of

UPPER_TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SHARD_KEYS = 65_536  # digests of a shard, about
FILTER, CONTENT, DELETE, INSERT, LOOKUP = range(5)
_INDEX = "shard int, slot int, fps binary, wl_sha binary, wl_keep long, wl_n long"


class CuckooIndex:
    """One shard: ``add``, ``remove``, ``find``. Each slot of the filter holds a fingerprint and the place of its key."""

    SLOTS, EVICTIONS = 4, 200

    def __init__(self, buckets: int = 8):
        self.keys: list[bytes | None] = []
        self.values: list = []
        self.free: list[int] = []
        self.resizes = self.probes = 0
        self._clear(buckets)

    def _clear(self, n: int) -> None:
        self.mask, self._turn = n - 1, 0
        self.fps, self.refs = array("H", bytes(2 * n * self.SLOTS)), array("i", bytes(4 * n * self.SLOTS))

    def _place(self, key: bytes) -> tuple[int, int, int]:
        fp = int.from_bytes(key[12:14], "big") or 1
        a = int.from_bytes(key[4:12], "big") & self.mask
        return fp, a, self._other(a, fp)

    def _other(self, at: int, fp: int) -> int:
        return (at ^ (fp * 0x5BD1E995)) & self.mask

    def _free_slot(self, at: int) -> int:
        for k in range(at * self.SLOTS, at * self.SLOTS + self.SLOTS):
            if not self.fps[k]:
                return k
        return -1

    def _put(self, key: bytes, ref: int) -> bool:
        fp, a, b = self._place(key)
        for at in (a, b):
            if (k := self._free_slot(at)) >= 0:
                self.fps[k], self.refs[k] = fp, ref
                return True
        at = a
        for _ in range(self.EVICTIONS):
            self._turn = (self._turn + 1) % self.SLOTS
            k = at * self.SLOTS + self._turn
            fp, ref, self.fps[k], self.refs[k] = self.fps[k], self.refs[k], fp, ref
            at = self._other(at, fp)
            if (k := self._free_slot(at)) >= 0:
                self.fps[k], self.refs[k] = fp, ref
                return True
        return False

    def hits(self, key: bytes) -> list[int]:
        """Slots whose fingerprint is the key's: none is certain absence, some is not yet presence."""
        fp, a, b = self._place(key)
        return [k for at in ((a,) if a == b else (a, b)) for k in range(at * self.SLOTS, at * self.SLOTS + self.SLOTS) if self.fps[k] == fp]

    def _slot(self, key: bytes) -> int:
        for k in self.hits(key):
            self.probes += 1
            if self.keys[self.refs[k]] == key:
                return k
        return -1

    def find(self, key: bytes):
        """The value of a live digest, else None; every hit of the filter is verified against the slot's key."""
        k = self._slot(key)
        return self.values[self.refs[k]] if k >= 0 else None

    def add(self, key: bytes, value) -> None:
        """Insert a digest that is not live, or give a live one a new value."""
        k = self._slot(key)
        if k >= 0:
            self.values[self.refs[k]] = value
            return
        if self.free:
            ref = self.free.pop()
            self.keys[ref], self.values[ref] = key, value
        else:
            ref = len(self.keys)
            self.keys.append(key)
            self.values.append(value)
        if not self._put(key, ref):
            self._rebuild((self.mask + 1) * 2)

    def _rebuild(self, n: int) -> None:
        """An eviction found no end: a larger filter from the stored keys."""
        while True:
            self._clear(n)
            self.resizes += 1
            if all(self._put(key, ref) for ref, key in enumerate(self.keys) if key is not None):
                return
            n *= 2

    def remove(self, key: bytes) -> bool:
        """Delete a live digest; False if it is not live."""
        k = self._slot(key)
        if k < 0:
            return False
        ref = self.refs[k]
        self.fps[k] = 0
        self.keys[ref] = self.values[ref] = None
        self.free.append(ref)
        return True

    def __len__(self) -> int:
        return len(self.keys) - len(self.free)

    def dump(self) -> tuple[bytes, list[int]]:
        """The filter, and the places of the keys by slot."""
        return self.fps.tobytes(), [self.refs[k] for k, fp in enumerate(self.fps) if fp]

    @classmethod
    def load(cls, fps: bytes | None, keys: list[bytes], values: list) -> CuckooIndex:
        """From a stored filter and keys in the order of its slots; without a filter it is built from the keys."""
        out = cls()
        out.keys, out.values = list(keys), list(values)
        if fps is None:
            n = 8
            while n * cls.SLOTS * 0.85 < len(keys):
                n *= 2
            out._rebuild(n)
            out.resizes = 0
            return out
        out._clear(len(fps) // 2 // cls.SLOTS)
        out.fps = array("H", fps)
        slots = [k for k, fp in enumerate(out.fps) if fp]
        for ref, k in zip(range(len(keys)), slots, strict=True):
            out.refs[k] = ref
        return out


def digest_of(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass").translate(UPPER_TO_LOWER)).digest()


def _digests(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([digest_of(t) for t in b.column(1).to_pylist()], pa.binary())], names=["wl_id", "wl_sha"])


def _copies_merged(batches):
    """One row per digest of at most 100,000 at a time: largest id (null is least), number of rows."""
    held: dict[bytes, list] = {}

    def out():
        rows = list(held.values())
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["wl_sha", "wl_keep", "wl_n"])

    for b in batches:
        for i, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            row = held.get(k)
            if row is None:
                held[k] = [i, 1]
            else:
                row[1] += 1
                if i is not None and (row[0] is None or i > row[0]):
                    row[0] = i
        if len(held) >= 100_000:
            yield out()
            held.clear()
    yield out()


def _update(batches):
    """Rows (shard, kind, slot, fps, sha, keep, n) sorted by the first three -> the shards' new rows."""
    shard, fps, keys, values, index = None, None, [], [], None

    def rows():
        blob, places = index.dump()
        live = [index.values[r] for r in places]
        n = len(places)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([-1], pa.int32()), pa.array([blob], pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], names=["shard", "slot", "fps", "wl_sha", "wl_keep", "wl_n"])
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.nulls(n, pa.binary()), pa.array([index.keys[r] for r in places], pa.binary()), pa.array([v[0] for v in live], pa.int64()), pa.array([v[1] for v in live], pa.int64())],
            names=["shard", "slot", "fps", "wl_sha", "wl_keep", "wl_n"],
        )

    for b in batches:
        for s, kind, blob, sha, keep, n in zip(*[b.column(c).to_pylist() for c in ("shard", "kind", "fps", "wl_sha", "wl_keep", "wl_n")], strict=True):
            if s != shard:
                if shard is not None:
                    index = CuckooIndex.load(fps, keys, values) if index is None else index
                    yield from rows()
                shard, fps, keys, values, index = s, None, [], [], None
            if kind == FILTER:
                fps = blob
            elif kind == CONTENT:
                keys.append(sha)
                values.append((keep, n))
            else:
                index = CuckooIndex.load(fps, keys, values) if index is None else index
                if kind == DELETE:
                    index.remove(sha)
                elif (held := index.find(sha)) is None:
                    index.add(sha, (keep, n))
                else:
                    index.add(sha, (keep if held[0] is None or keep is not None and keep > held[0] else held[0], held[1] + n))
    if shard is not None:
        index = CuckooIndex.load(fps, keys, values) if index is None else index
        yield from rows()


def _filtered(batches):
    """Filters and looked-up digests, sorted by shard -> those digests that their filter doesn't refuse."""
    shard, index = None, CuckooIndex()
    for b in batches:
        ids, shas = [], []
        for s, kind, blob, sha, i in zip(*[b.column(c).to_pylist() for c in ("shard", "kind", "fps", "wl_sha", "wl_id")], strict=True):
            if s != shard:
                shard, index = s, CuckooIndex()
            if kind == FILTER:
                index._clear(len(blob) // 2 // CuckooIndex.SLOTS)
                index.fps = array("H", blob)
            elif index.hits(sha):
                ids.append(i)
                shas.append(sha)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shas, pa.binary())], names=["wl_id", "wl_sha"])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(wl_id, wl_sha) of every row, stored; null text counts as empty."""
    d = text_of(docs, id_col, text_col).withColumn("wl_id", F.col("wl_id").cast("long"))
    return stored(d.mapInArrow(_digests, "wl_id long, wl_sha binary"), "digests")


@dataclass(frozen=True)
class DigestIndex:
    """Live digests as a table of shards; ``update`` gives a new one, the old stays as it was."""

    table: DataFrame
    bits: int

    @classmethod
    def empty(cls, spark: SparkSession) -> DigestIndex:
        return cls(spark.createDataFrame([], _INDEX), 0)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> DigestIndex:
        """An index that ``save`` wrote, in this session or another."""
        table = spark.read.schema(_INDEX + ", bits int").parquet(path)
        row = table.filter("slot = -1").select("bits").first()
        return cls(table.drop("bits"), row[0] if row else 0)

    def save(self, path: str) -> None:
        self.table.withColumn("bits", F.lit(self.bits)).write.parquet(path)

    def live(self) -> DataFrame:
        """(wl_sha, wl_keep, wl_n): the content."""
        return self.table.filter("slot >= 0").select("wl_sha", "wl_keep", "wl_n")

    def _shard(self, bits: int) -> Column:
        return F.shiftright(F.conv(F.hex(F.substring("wl_sha", 1, 3)), 16, 10).cast("int"), 24 - bits).cast("int")

    def update(self, inserts: DataFrame | None = None, deletes: DataFrame | None = None) -> DigestIndex:
        """Deletes, then inserts digests: tables (wl_id, wl_sha). A digest is deleted with all its rows; one that is not live
        is ignored. Copies are merged in every task first, so a shard gets a digest at most once from each 100,000 rows.
        The number of shards follows the number of digests; where it changes, filters are rebuilt from the keys."""
        spark = self.table.sparkSession
        count = self.table.filter("slot >= 0").count() + (inserts.count() if inserts is not None else 0)
        bits = min(24, max(self.bits, (count // SHARD_KEYS).bit_length()))
        old = self.table if bits == self.bits else self.table.filter("slot >= 0").withColumn("shard", self._shard(bits))
        rows = old.withColumn("kind", F.when(F.col("slot") < 0, FILTER).otherwise(CONTENT))
        empty = {"fps": F.lit(None).cast("binary"), "slot": F.lit(0)}
        for change, kind in ((deletes, DELETE), (inserts, INSERT)):
            if change is not None:
                merged = change.select("wl_id", "wl_sha").mapInArrow(_copies_merged, "wl_sha binary, wl_keep long, wl_n long")
                rows = rows.unionByName(merged.withColumns({"shard": self._shard(bits), "kind": F.lit(kind), **empty}))
        rows = rows.repartition(partitions(spark), "shard").sortWithinPartitions("shard", "kind", "slot")
        return DigestIndex(stored(rows.mapInArrow(_update, _INDEX), "digest-index"), bits)

    def lookup(self, asked: DataFrame) -> DataFrame:
        """(wl_id, wl_sha) -> (wl_id, wl_sha, wl_keep, wl_n) of the rows whose digest is live. The filters alone are read
        first; content only meets what they let through."""
        spark = self.table.sparkSession
        filters = self.table.filter("slot = -1").select("shard", F.lit(FILTER).alias("kind"), "fps", F.lit(None).cast("binary").alias("wl_sha"), F.lit(None).cast("long").alias("wl_id"))
        rows = asked.select(self._shard(self.bits).alias("shard"), F.lit(LOOKUP).alias("kind"), F.lit(None).cast("binary").alias("fps"), "wl_sha", "wl_id")
        rows = filters.unionByName(rows).repartition(partitions(spark), "shard").sortWithinPartitions("shard", "kind")
        return rows.mapInArrow(_filtered, "wl_id long, wl_sha binary").join(self.live(), "wl_sha").select("wl_id", "wl_sha", "wl_keep", "wl_n")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, keep_id, group_size, kept, text_sha256), one row per input row.

    Texts are equal when identical after lower-casing A-Z only, by their SHA-256; null counts as empty, and empty texts
    form a group like any other. Of a group the row with the largest id stays. Ids must be 64-bit integers. Repeated rows
    (same id, same text) count in group_size and, having the kept id, are all marked kept; ``keep_one`` thins those to one
    row. Null ids are least: a row with a null id is kept only if its whole group has null ids (keep_id is then null). An
    empty table gives an empty table. All digests are inserted into an empty index, whose content says what stays.
    """
    found = digests(docs, id_col, text_col)
    live = DigestIndex.empty(docs.sparkSession).update(found).live()
    return found.join(live, "wl_sha").select(
        F.col("wl_id").alias(id_col),
        F.col("wl_keep").alias("keep_id"),
        F.col("wl_n").alias("group_size"),
        F.col("wl_id").eqNullSafe(F.col("wl_keep")).alias("kept"),
        F.lower(F.hex("wl_sha")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one row per class of equal texts (null as empty).

    Repeated rows (same id and text) are thinned to one; rows of a group whose ids are all null likewise. Columns of any
    name pass through. An empty table gives an empty table.
    """
    found = digests(docs, id_col, text_col)
    live = DigestIndex.empty(docs.sparkSession).update(found).live()
    verdict = stored(found.join(live, "wl_sha").filter(F.col("wl_id").eqNullSafe(F.col("wl_keep"))).groupBy("wl_sha", "wl_id").agg(F.count("*").alias("n")), "kept-digests")
    at = docs.columns.index(text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]

    def run(batches):
        for b in batches:
            shas = [digest_of(t or "") for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shas, pa.binary())], names=[*names, "wl_sha"])

    fields = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(names, docs.schema, strict=True))
    d = docs.mapInArrow(run, f"{fields}, wl_sha binary").withColumn("wl_id", F.col(f"c{docs.columns.index(id_col)}").cast("long"))
    stay = verdict.select(F.col("wl_sha").alias("wl_vs"), F.col("wl_id").alias("wl_v"))
    one = d.join(stay, (F.col("wl_sha") == F.col("wl_vs")) & F.col("wl_id").eqNullSafe(F.col("wl_v")), "left_semi")
    if verdict.filter("n > 1").limit(1).count():
        one = one.dropDuplicates(["wl_id", "wl_sha"])
    return one.select(*[F.col(c).alias(name) for c, name in zip(names, docs.columns, strict=True)])
