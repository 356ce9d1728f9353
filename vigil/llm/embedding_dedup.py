"""Near-duplicate vectors by collision counting over sorted one-dimensional projections.

After QALSH (Huang et al. 2015): a vector is projected on many random unit directions, and two vectors collide in a
projection if one lies in the window of half-width ``w`` centred at the other. Vectors at the threshold differ in a
projection by a normal value of known spread, so the number of collisions over ``COUNTED`` projections is binomial, and
the count to pass is the largest that a pair at the threshold reaches with a probability of ``RECALL``. Pairs that pass
are verified by their cosine in double precision.

1. A table has a projection of its own. All vectors are sorted by it, and each one's window is searched in that order.
   On unit vectors a window can hold a third of all, so the order is cut into cells first: only vectors of one label
   that agree in ``g - 1`` more projections, rounded on a randomly shifted grid, are sorted together. ``g`` grows with
   the logarithm of the number of vectors, so cells keep their size; the number of tables is what the recall asks for,
   the window of the table's own projection and the grid counted in.
2. What is shuffled for a table is a vector's id, its place in the order and its ``COUNTED`` projections in a byte each,
   rounded so that no collision is lost. Tasks count collisions on these, and name the vectors of pairs that pass.
3. Only these vectors are fetched and verified. A pair that meets in several tables is counted in the first.

Equal vectors (by 128-bit hash) are collapsed before. A cell of over ``BLOCK`` vectors that holds a ``HEAVY``-th of all
places is dealt out as pairs of blocks. Tasks emit link counts per vector and a spanning forest, never pairs.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import kernel as K
from vigil.llm.components import connected_components
from vigil.llm.minhash_dedup import forest
from vigil.llm.session import bounded_batches, drop, stored

THRESHOLD, RECALL = 0.98, 1 - 1e-6
#: Vectors a cell should hold, and by how much one more projection divides cells of unrelated vectors.
CELL, GAIN = 150, 2.2
#: Width of a grid cell and half-width of a window, in spreads of the difference of a pair at the threshold.
GRID, WINDOW = 8.0, 2.5
#: Projections whose collisions are counted, and steps of their bytes in half a window.
COUNTED, STEPS = 32, 4
BLOCK = 1500
HEAVY = 100_000
PAIRS = 400_000


def allowed_misses(m: int, p: float, recall: float) -> int:
    """The fewest of ``m`` windows to miss, so that a pair that meets each with probability ``p`` misses more with at most 1 - ``recall``."""
    log = lambda k: math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1) + k * math.log1p(-p) + (m - k) * math.log(p)
    tail = 0.0
    for k in range(m, 0, -1):
        tail += math.exp(log(k))
        if tail > 1 - recall:
            return k
    return 0


@dataclass
class Plan:
    """Directions and grid for vectors of one dimension."""

    dim: int
    g: int
    tables: int
    threshold: float

    def __post_init__(self) -> None:
        rng = np.random.default_rng(42 + self.dim)
        m = COUNTED + self.g * self.tables
        d = rng.standard_normal((self.dim, m))
        # orthogonal inside runs of dim directions: then projections of a difference are as independent as can be
        for a in range(0, m, self.dim):
            q, _ = np.linalg.qr(d[:, a : a + self.dim])
            d[:, a : a + self.dim] = q
        self.directions = d
        self.spread = math.sqrt(2 - 2 * self.threshold) / math.sqrt(self.dim)
        self.window = WINDOW * self.spread
        self.shift = rng.random(m - COUNTED)
        self.misses = allowed_misses(COUNTED, math.erf(WINDOW / math.sqrt(2)), RECALL)

    @classmethod
    def of(cls, dim: int, largest: int, threshold: float) -> Plan:
        return cls(dim, *cls.size(largest), threshold)

    @staticmethod
    def size(largest: int) -> tuple[int, int]:
        """Projections of a table and number of tables, for labels of up to ``largest`` vectors."""
        g = 1 + max(0, math.ceil(math.log(max(largest, 1) / CELL) / math.log(GAIN)))
        meet = math.erf(WINDOW / math.sqrt(2)) * (1 - math.sqrt(2 / math.pi) / GRID) ** (g - 1)
        return g, max(1, math.ceil(math.log(1 - RECALL) / math.log1p(-meet)))

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each vector its bytes of counted projections, and for each table its place in the order and the hash of its cell."""
        p = (x @ self.directions).astype(np.float32)
        counted = np.clip(np.floor(p[:, :COUNTED] * np.float32(STEPS / self.window)), -127, 127).astype(np.int8)
        p = p[:, COUNTED:].reshape(len(x), self.tables, self.g)
        at = np.floor(p[:, :, 1:] / np.float32(GRID * self.spread) + self.shift.reshape(self.tables, self.g)[:, 1:]).astype(np.int64).view(np.uint64)
        key = np.repeat(K.mix(np.arange(1, self.tables + 1, dtype=np.uint64))[None, :], len(x), axis=0)
        for j in range(self.g - 1):
            key = K.mix(key ^ at[:, :, j]) * np.uint64(K._BASE)
        return counted, np.ascontiguousarray(p[:, :, 0]), key

    def collisions(self, first: np.ndarray, counted: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a cell, in windows of its order, that collide often enough; vectors of side 2 meet all of it, others those of the other side."""
        order = np.argsort(first, kind="stable")
        keys = first[order].astype(np.float64)
        after = np.searchsorted(keys, keys + self.window, side="right") - np.arange(1, len(keys) + 1)
        cut = np.concatenate(([0], np.cumsum(after)))
        a = 0
        while a < len(keys):
            b = max(a + 1, int(np.searchsorted(cut, cut[a] + PAIRS, side="right")) - 1)
            n = after[a:b]
            i = np.repeat(np.arange(a, b), n)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            i, j = order[i], order[j]
            keep = (side[i] == 2) | (side[i] != side[j])
            i, j = i[keep], j[keep]
            missed = np.zeros(len(i), dtype=np.int16)
            for c in range(0, COUNTED, 8):
                apart = np.abs(counted[i, c : c + 8].astype(np.int16) - counted[j, c : c + 8])
                missed += (apart > STEPS).sum(axis=1, dtype=np.int16)
                keep = missed <= self.misses
                i, j, missed = i[keep], j[keep], missed[keep]
            if len(i):
                yield i, j
            a = b


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors; each is scaled by its largest component first, so no square overflows."""
    x = np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _labels(column: pa.Array) -> np.ndarray:
    return np.asarray(column, dtype=np.int64).view(np.uint64)


_CELLS = pa.schema([("cell", pa.int64())])
_PLACE = pa.schema([("block", pa.int64()), ("side", pa.int8()), ("tab", pa.int16()), ("id", pa.int64()), ("first", pa.float32()), ("counted", pa.binary())])


def _cells(plan: Plan, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counted, first, key = plan.project(_matrix(batch["embedding"], plan.dim))
    return counted, first, K.mix(key ^ K.mix(_labels(batch["mark"]))[:, None])


def _occupy(plan: Plan):
    """The cells of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(_cells(plan, batch)[2].view(np.int64).ravel())], schema=_CELLS)

    return run


def _place(plan: Plan, heavy: np.ndarray, parts: np.ndarray):
    """One row for each table of a vector; in the heavy cells (sorted), of so many parts, one for each pair of parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted, first, cell = _cells(plan, batch)
            n = len(cell)
            ids = np.tile(np.asarray(batch["id"]), plan.tables)
            row = np.tile(np.arange(n), plan.tables)
            tab = np.repeat(np.arange(plan.tables), n)
            place, block = first.T.ravel(), cell.T.ravel()
            side = np.full(len(block), 2)
            if len(heavy):
                at = np.minimum(np.searchsorted(heavy, block), len(heavy) - 1)
                copies = np.where(heavy[at] == block, parts[at], 1)
                own = (K.mix(ids.view(np.uint64)) % copies.astype(np.uint64)).astype(np.int64)
                again = np.repeat(np.arange(len(block)), copies)
                other = np.arange(len(again)) - np.repeat(np.cumsum(copies) - copies, copies)
                ids, row, tab, place, block, own = (x[again] for x in (ids, row, tab, place, block, own))
                low, high = np.minimum(own, other).astype(np.uint64), np.maximum(own, other).astype(np.uint64)
                block = np.where(copies[again] > 1, K.mix(K.mix(block ^ K.mix(low + np.uint64(1))) ^ high), block)
                side = np.where(own == other, 2, np.where(own < other, 0, 1))
            for a in range(0, len(block), 100_000):
                s = slice(a, a + 100_000)
                raw = pa.Array.from_buffers(pa.binary(COUNTED), len(row[s]), [None, pa.py_buffer(np.ascontiguousarray(counted[row[s]]))]).cast(pa.binary())
                yield pa.record_batch([pa.array(block[s].view(np.int64)), pa.array(side[s].astype(np.int8)), pa.array(tab[s].astype(np.int16)), pa.array(ids[s]), pa.array(place[s]), raw], schema=_PLACE)

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each block, in one batch; batches come sorted by block. Blocks of one row are left out."""
    rows: list[pa.RecordBatch] = []
    current = None

    def whole() -> pa.RecordBatch:
        return rows[0] if len(rows) == 1 else pa.Table.from_batches(rows).combine_chunks().to_batches()[0]

    for batch in batches:
        keys = np.asarray(batch["block"])
        cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if e > s:
                if current is not None and keys[s] != current:
                    if len(rows) > 1 or rows[0].num_rows > 1:
                        yield whole()
                    rows = []
                current = keys[s]
                rows.append(batch.slice(s, e - s))
    if rows and (len(rows) > 1 or rows[0].num_rows > 1):
        yield whole()


_MET = pa.schema([("block", pa.int64()), ("side", pa.int8()), ("tab", pa.int16()), ("id", pa.int64())])


def _count(plan: Plan):
    """The vectors of each block that take part in a pair of enough collisions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            counted = _bytes(t["counted"])
            met = np.zeros(len(t), dtype=bool)
            for i, j in plan.collisions(np.asarray(t["first"]), counted, np.asarray(t["side"])):
                met[i] = met[j] = True
            if met.any():
                yield pa.record_batch([t[c].filter(pa.array(met)) for c in _MET.names], schema=_MET)

    return run


def _bytes(column: pa.Array) -> np.ndarray:
    """A column of ``COUNTED`` bytes each as rows of signed numbers."""
    column = column.cast(pa.binary())
    start = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], dtype=np.int8)[start : start + COUNTED * len(column)].reshape(-1, COUNTED)


_OUT = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])


def _verify(plan: Plan):
    """Rows (id, links, null) with weighted link counts, and (id, null, other) for the forest's edges."""

    def block(t: pa.RecordBatch) -> pa.RecordBatch:
        ids, weight, side, tab = np.asarray(t["id"]), np.asarray(t["n"]), np.asarray(t["side"]), int(t["tab"][0].as_py())
        x = _matrix(t["embedding"], plan.dim)
        counted, first, cells = plan.project(x)
        links, edges = np.zeros(len(ids), dtype=np.int64), []
        for i, j in plan.collisions(first[:, tab], counted, side):
            near = np.einsum("ij,ij->i", x[i], x[j]) >= plan.threshold
            i, j = i[near], j[near]
            before = (cells[i, :tab] == cells[j, :tab]) & (np.abs(first[i, :tab].astype(np.float64) - first[j, :tab]) <= plan.window)
            new = ~before.any(axis=1)
            i, j = i[new], j[new]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            edges += forest(np.stack((i, j), axis=1))
        edges = forest(np.array(edges, dtype=np.int64).reshape(-1, 2))
        some = np.flatnonzero(links)
        a, b = (np.array([ids[e[k]] for e in edges], dtype=np.int64) for k in (0, 1))
        none = lambda k: pa.nulls(k, pa.int64())
        return pa.record_batch(
            [pa.concat_arrays([pa.array(ids[some]), pa.array(a)]), pa.concat_arrays([pa.array(links[some]), none(len(a))]), pa.concat_arrays([none(len(some)), pa.array(b)])],
            schema=_OUT,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            yield block(t)

    return run


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int16(): "short", pa.int8(): "byte", pa.float32(): "float"}
    return ", ".join(f"{f.name} {names.get(f.type, 'binary')}" for f in schema)


def _found(own: DataFrame, plan: Plan) -> DataFrame:
    """Link counts and edges among the vectors of one dimension (id, mark of the label, n, embedding)."""
    cells = own.select("mark", "embedding").mapInArrow(_occupy(plan), _ddl(_CELLS)).groupBy("cell").agg(F.count("*").alias("n"))
    # at most HEAVY cells of 16 bytes
    heavy = cells.where(F.col("n") > max(BLOCK, own.count() * plan.tables // HEAVY)).collect()
    heavy = sorted((r["cell"] & K._MASK, r["n"]) for r in heavy)
    split = np.array([c for c, _ in heavy], dtype=np.uint64), np.array([-(-n // BLOCK) for _, n in heavy], dtype=np.int64)
    placed = own.select("id", "mark", "embedding").mapInArrow(_place(plan, *split), _ddl(_PLACE))
    met = placed.repartition("block").sortWithinPartitions("block").mapInArrow(_count(plan), _ddl(_MET))
    near = met.join(own.select("id", "n", "embedding"), "id")
    return near.repartition("block").sortWithinPartitions("block", "id").mapInArrow(_verify(plan), _ddl(_OUT))


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label; others ignored).

    Vectors of one label are linked if their cosine is at least ``threshold``; labels of any type are equal if they read
    the same. Vectors with a null label, without elements, of all zeros or with null or non-finite elements are linked
    with nothing and are their own component, as are rows with a null vec_id (their component is null and they are kept).
    Vectors of different lengths are never linked; components of any finite size count. Repeated rows link with each
    other. No rows give no rows.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    # 0.0 is added to make -0.0 equal to it
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.transform("embedding", lambda x: x + F.lit(0.0).cast("float")).alias("embedding"))
    fine = "vec_id IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)"
    usable = F.coalesce(F.expr(fine), F.lit(False))
    same = ["label", "h1", "h2"]
    good = rows.where(usable).withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(7), "embedding", F.lit(9))})
    classes = good.groupBy(*same).agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.min_by("embedding", "vec_id").alias("embedding"))
    classes = stored(classes.withColumns({"mark": F.xxhash64("label"), "dim": F.size("embedding")}), "vectors")
    sizes = classes.groupBy("dim", "label").agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("n")).collect()
    tables = []
    for dim, largest in sorted((r["dim"], r["n"]) for r in sizes):
        tables.append(stored(_found(classes.where(F.col("dim") == dim), Plan.of(dim, largest, threshold)), "links"))
    if not tables:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = functools.reduce(DataFrame.union, tables)
    counts = found.where("links IS NOT NULL").groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    known = classes.select(*same, "id", "n").join(counts, "id", "left").join(parts.withColumnRenamed("node", "id"), "id", "left")
    known = known.select(*same, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    bad = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    out = good.select("vec_id", *same).join(known, same).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"), (F.col("vec_id") == F.col("component")).alias("kept"))
    out = stored(out.union(bad), "near")
    for x in (classes, parts, *tables):
        drop(x)
    return out
