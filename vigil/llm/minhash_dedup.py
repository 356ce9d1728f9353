"""Near-duplicate documents: fast similarity sketches, banding, and links confirmed on whole shingle sets.

The sketch is the one of Dahlgaard, Knudsen and Thorup (2017): in round i every element is hashed to one of t bins
with value i + fraction, each bin keeps its least value, and the rounds stop once every bin is filled; in rounds t
to 2t-1 all elements go to bin i - t, so even one element fills all. It costs O(t log t + n) instead of O(t n) and
each coordinate agrees between two sets with a probability near their Jaccard similarity.

Equal shingle sets are collapsed first, to the smallest doc_id. The others meet in the buckets of their bands.
No bucket's pairs are listed: each member is compared with the bucket's smallest member (star), components are
taken, and only buckets that still hold several components go on to comparisons of all members of different
components, in blocks of at most ``BLOCK`` x ``BLOCK`` whose intersections are counted by one matrix product.
So a bucket of any size is spread over many tasks, and what a task emits is a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import kernel as K
from vigil.llm.components import connected_components
from vigil.llm.session import bounded_batches, drop, stored

WORDS = 5
#: 24 bands of 6 coordinates: a pair at similarity 0.85 is missed with a probability of (1 - 0.85**6)**24, about 1e-5; at 0.8, 7e-4.
BANDS, ROWS = 24, 6
#: Members of a side of a block.
BLOCK = 64
STAR = 200
_EMPTY = np.uint64(K._MASK)
_VALUES = K.byte_values(7, K.LOWER)


def document_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, distinct shingle hashes, their rows, row bounds) for each piece of a batch."""
    for a, b, data, offsets in K.pieces(column):
        start, end, rows = K.word_spans(data, offsets)
        words = K.SpanHash(data, _VALUES)(start, end)
        h, r = K.shingles(words, rows, b - a, WORDS)
        yield a, b, *K.distinct_in_rows(h, r, b - a)


def sketch(h: np.ndarray, r: np.ndarray, n_rows: int, t: int) -> np.ndarray:
    """One row of ``t`` coordinates for each set; sets without elements keep the empty mark."""
    out = np.full(n_rows * t, _EMPTY)
    open_rows = np.zeros(n_rows, dtype=bool)
    open_rows[r] = True
    base = r * t
    for i in range(2 * t):
        x = K.mix(h ^ np.uint64(K.mix_int(1000 + i)))
        value = np.uint64(i << 54) | (x >> np.uint64(10))
        to = base + (x % np.uint64(t)).astype(np.int64) if i < t else base + (i - t)
        np.minimum.at(out, to, value)
        full = (out.reshape(n_rows, t) != _EMPTY).all(axis=1)
        still = open_rows & ~full
        if not still.any():
            break
        if still.sum() < open_rows.sum():
            keep = still[r]
            h, r, base = h[keep], r[keep], base[keep]
        open_rows = still
    return out.reshape(n_rows, t)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.repeat(K.mix(np.arange(1, bands + 1, dtype=np.uint64))[None, :], len(signature), axis=0)
    for j in range(rows):
        key = K.mix(key ^ signature[:, j::rows][:, :bands])
    return key


def _sketches(bands: int, rows: int):
    kind = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, h, r, bounds in document_sets(batch["text"]):
                n = np.diff(bounds)
                sums = []
                for seed in (11, 12):
                    c = np.concatenate(([np.uint64(0)], np.cumsum(K.mix(h ^ np.uint64(K.mix_int(seed))), dtype=np.uint64)))
                    sums.append((c[bounds[1:]] - c[bounds[:-1]]).view(np.int64))
                keys = band_keys(sketch(h, r, b - a, bands * rows), bands, rows).view(np.int64)
                keys = keys[n > 0].ravel()
                at = np.concatenate(([0], np.cumsum(np.where(n > 0, bands, 0))))
                yield pa.record_batch([batch["doc_id"].slice(a, b - a), pa.array(n), pa.array(sums[0]), pa.array(sums[1]), K.list_column(keys, at, pa.int64())], schema=kind)

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, h, _, bounds in document_sets(batch["text"]):
            raw = [h[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.record_batch([batch["doc_id"].slice(a, b - a), pa.array(raw, pa.binary())], names=["id", "hashes"])


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of 0/1 matrices over runs of the common elements."""
    lo, ro = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    lh, rh = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(lh, rh)
    out = np.zeros((len(left), len(right)))
    if not len(common):
        return out
    places = []
    for owner, h in ((lo, lh), (ro, rh)):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        ok = common[at] == h
        order = np.argsort(at[ok], kind="stable")
        places.append((owner[ok][order], at[ok][order]))
    for s in range(0, len(common), 8192):
        m = []
        for (owner, at), n in zip(places, (len(left), len(right)), strict=True):
            x, y = np.searchsorted(at, (s, s + 8192))
            one = np.zeros((n, 8192), dtype=np.float32)
            one[owner[x:y], at[x:y] - s] = 1
            m.append(one)
        out += m[0] @ m[1].T
    return out


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Of the pairs given, those that join components not yet joined."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    out = []
    for a, b in links.tolist():
        x, y = top(a), top(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _verify(percent: int):
    def block(rows: list[tuple[int, int, bytes]]) -> list[tuple[int, int]]:
        sides = [[x for x in rows if x[1] in wanted] for wanted in ((0, 2), (1, 2))]
        if not all(sides):
            return []
        sets = [[np.frombuffer(x[2], dtype=np.uint64) for x in s] for s in sides]
        both = intersections(*sets)
        sizes = [np.array([len(x) for x in s], dtype=float) for s in sets]
        union = sizes[0][:, None] + sizes[1][None, :] - both
        linked = 100 * both >= percent * union
        ids = [np.array([x[0] for x in s], dtype=np.int64) for s in sides]
        i, j = np.nonzero(linked & (ids[0][:, None] != ids[1][None, :]))
        return forest(np.stack([ids[0][i], ids[1][j]], axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows, found = None, [], []
        for batch in batches:
            for key, i, side, hashes in zip(batch["block"].to_pylist(), batch["id"].to_pylist(), batch["side"].to_pylist(), batch["hashes"], strict=True):
                if key != current:
                    found += block(rows)
                    current, rows = key, []
                rows.append((i, side, hashes.as_py()))
            if found:
                yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in found], schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))
                found = []
        if found := block(rows):
            yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in found], schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def _links(assigned: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the sides of each block; ``assigned``: block, id, side (0, 1, or 2 for both)."""
    return assigned.join(sets, "id").repartition("block").sortWithinPartitions("block").mapInArrow(_verify(percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text; more columns are ignored).

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased; a document's set holds its distinct
    runs of five words, or its whole sequence when shorter. Documents are linked when 100 * intersection is at least
    ``percent`` * union. A null or empty text has an empty set and no links; a row with a null doc_id has no links,
    a null component_id and is kept. Repeated rows and equal texts fall in one component; rows of one doc_id with different
    texts count as one document, of the least text. No rows give no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = stored(texts.mapInArrow(_sketches(bands, rows), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"), "sketches")
    filled = sketches.where("n_shingles > 0 and doc_id is not null")
    same = ["s1", "s2", "n_shingles"]
    # equal sets have equal bands
    classes = stored(filled.groupBy(*same).agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")), "classes")
    entries = classes.select("id", "n_shingles", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("center"), F.min_by("n_shingles", "id").alias("n_center")).where("n > 1")
    entries = stored(entries.join(shared, "key"), "entries")

    fits = lambda x, y: f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})"
    needed = entries.select("id").distinct().withColumnRenamed("id", "doc_id")
    # always by sorting: the list of ids grows with the documents
    wanted = texts.join(needed.hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    sets = stored(wanted.mapInArrow(_sets, "id long, hashes binary"), "sets")

    star = entries.where("id <> center").where(fits("n_shingles", "n_center")).select("center", "id").distinct()
    parts = star.groupBy("center").agg(F.ceil(F.count("*") / STAR).alias("parts"))
    star = star.join(parts, "center").withColumn("block", F.xxhash64("center", F.expr("pmod(xxhash64(id), parts)")))
    middle = parts.select(F.col("center").alias("id"), F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"))
    assigned = star.select("block", "id", F.lit(1).alias("side")).union(middle.select(F.xxhash64("id", "part"), "id", F.lit(0)))
    first = stored(_links(assigned, sets, percent), "links")
    found = connected_components(first)

    part_of = entries.join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    several = part_of.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("members"))
    several = several.where("x <> y").groupBy("n", "members").agg(F.min("key").alias("key"))
    open_ = stored(part_of.join(several.select("key", "members"), "key"), "open")
    if not open_.isEmpty():
        sizes = open_.groupBy("key", "component").agg(F.count("*").alias("n"))
        main = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("n_main"), (F.sum("n") - F.max("n")).alias("n_rest"))
        main = main.select("key", "main", F.ceil(F.col("n_main") / BLOCK).alias("of_main"), F.ceil(F.col("n_rest") / BLOCK).alias("of_rest"))
        m = open_.join(main, "key").withColumn("is_main", F.expr("component = main")).withColumn("chunk", F.expr("pmod(xxhash64(id), if(is_main, of_main, of_rest))"))
        small = m.where("of_main = 1 and of_rest = 1").select(F.xxhash64("key").alias("block"), "id", F.lit(2).alias("side"))
        m = m.where("of_main > 1 or of_rest > 1")
        rest = m.where("not is_main").withColumn("other", F.explode(F.expr("sequence(0L, of_rest - 1)")))
        within = rest.select(F.expr("xxhash64(key, 'r', least(chunk, other), greatest(chunk, other))"), "id", F.expr("if(chunk = other, 2, if(chunk < other, 0, 1))"))
        across = m.withColumn("other", F.explode(F.expr("sequence(0L, if(is_main, of_rest, of_main) - 1)")))
        across = across.select(F.expr("xxhash64(key, 'm', if(is_main, other, chunk), if(is_main, chunk, other))"), "id", F.expr("if(is_main, 1, 0)"))
        more = _links(small.union(within).union(across), sets, percent)
        old = found
        found = connected_components(first.union(more))
        drop(old)
    for x in (entries, sets, first, open_):
        drop(x)
    linked = classes.drop("bands").join(found.withColumnRenamed("node", "id"), "id", "left").select(*same, F.coalesce("component", "id").alias("component"))
    out = sketches.join(linked, same, "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    out = stored(out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")), "near")
    for x in (sketches, classes, found):
        drop(x)
    return out


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``docs``, all columns, with one row of each group of near copies, the one of the smallest doc_id.

    Rows that share a doc_id are documents of their own: an exact repetition goes, another text stays unless it is a
    copy of some row before. Rows without words or without a doc_id all stay. No rows give no rows.
    """
    twice = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if twice.isEmpty():
        gone = near_duplicates(docs, percent).where("not kept").select("doc_id").distinct()
        # always by sorting: the list of ids grows with the documents
        return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    rows = docs.where("doc_id is not null").withColumn("_vigil_mark", F.xxhash64("text")).repartitionByRange("doc_id", "_vigil_mark").sortWithinPartitions("doc_id", "_vigil_mark")
    # numbers follow the order of ids; they are written, so no later run of a task can give others
    rows = stored(rows.withColumn("_vigil_row", F.monotonically_increasing_id()), "rows")
    near = near_duplicates(rows.select(F.col("_vigil_row").alias("doc_id"), "text"), percent)
    gone = near.where("not kept").select(F.col("doc_id").alias("_vigil_row")).distinct()
    return rows.join(gone.hint("merge"), "_vigil_row", "left_anti").select(*docs.columns).union(docs.where("doc_id is null"))
