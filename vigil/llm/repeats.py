"""Removal of byte strings that occur more than once, exactly, by suffix sorting of the places where they can be.

Sorting all suffixes of a corpus would send every byte ``length`` times over the network. Instead:

1. Winnowing (Schleimer, Wilkerson and Aiken 2003) marks anchors: grams of ``GRAM`` bytes whose hash is least in
   some window of ``length`` bytes. Every string of ``length`` bytes holds an anchor at a place that its content
   alone decides, so equal strings share an anchor. Only anchors that occur twice or more are looked at further.
2. An anchor's context is all that strings of ``length`` bytes around it can cover. Equal contexts are collapsed
   before anything is sent: where one occurs twice, it is covered as a whole.
3. Different contexts of an anchor go to one task, which sorts their suffixes in two stages (``suffix_sort``),
   compares neighbours, and marks each string of ``length`` bytes that stands at two places of the corpus.
   An anchor with more than ``HOT`` different contexts is not given to one task: its strings are collapsed by a
   128-bit hash over all tasks first, and so counted by partial aggregates.

Nothing is lost by these steps: they decide where sorting takes place, not what is found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import kernel as K
from vigil.llm.session import bounded_batches, drop, heavy_keys, spread_join, stored
from vigil.llm.suffix_sort import equal_prefix_runs, join_texts, suffix_array

GRAM = 40
HOT = 2000
BATCH_BYTES = 2 << 20
_VALUES = K.byte_values(8)
_TOP = np.uint64(K._MASK)
_ANCHOR = pa.schema([("anchor", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("doc_id", pa.int64()), ("t1", pa.int64()), ("left", pa.int32()), ("len", pa.int32()), ("at", pa.list_(pa.int32())), ("many", pa.bool_())])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of every run of ``w`` (van Herk): minima from both ends of blocks."""
    n = len(x)
    if n < w:
        return x[:0]
    y = np.concatenate((x, np.full(-n % w, x.dtype.type(K._MASK)))).reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, h: K.SpanHash) -> tuple[np.ndarray, np.ndarray]:
    """Positions of anchors and the hashes of their grams; windows that cross rows don't count."""
    grams = h.windows(gram)
    least = sliding_min(grams, length - gram + 1)
    if not len(least):
        return np.empty(0, dtype=np.int64), grams[:0]
    inside = np.zeros(len(least), dtype=bool)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= length:
            inside[a : b - length + 1] = True
    pad = length - gram
    # an anchor equals the largest of the minima of the windows that hold it
    low = np.where(inside, ~least, _TOP)
    low = np.concatenate((np.full(pad, _TOP), low, np.full(pad, _TOP)))
    best = ~sliding_min(low, pad + 1)
    at = np.flatnonzero((best[: len(grams)] == grams) & (best[: len(grams)] > 0))
    return at, grams[at]


def thinned(at: np.ndarray, key: np.ndarray, row: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Which anchors to keep, and for which of them the same gram is an anchor elsewhere in the row.

    In a periodic text one gram is an anchor once in each period. Of its places the first and the last are kept, and
    between them enough that no two neighbours are more than ``w`` apart: each window then still holds one of them.
    """
    order = np.lexsort((at, key, row))
    k, r = key[order], row[order]
    first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (r[1:] != r[:-1]))))
    count = np.diff(np.append(first, len(order)))
    keep, many = np.ones(len(at), dtype=bool), np.zeros(len(at), dtype=bool)
    for f, c in zip(first[count > 1], count[count > 1], strict=True):
        own = order[f : f + c]
        many[own] = True
        if c > 2:
            keep[own] = False
            p, i = at[own], 0
            while True:
                keep[own[i]] = True
                if i == c - 1:
                    break
                i = max(i + 1, int(np.searchsorted(p, p[i] + w, side="right")) - 1)
    return keep, many


def _find(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch["doc_id"], batch["t1"]
            for a, b, data, offsets in K.pieces(batch["text"]):
                h, g = K.SpanHash(data, _VALUES), K.second_hash(data)
                at, key = anchors(data, offsets, length, gram, h)
                if not len(at):
                    continue
                row = K.row_of(at, offsets)
                keep, many = thinned(at, key, row, length - gram + 1)
                at, key, row, many = at[keep], key[keep], row[keep], many[keep]
                begin, end = np.maximum(at - (length - gram), offsets[row]), np.minimum(at + length, offsets[row + 1])
                left = at - begin
                c1, c2 = h(begin, end) + left.astype(np.uint64) * np.uint64(K._BASE), K.mix(g(begin, end) ^ left.astype(np.uint64))
                order = np.lexsort((c2, c1, key, row))
                same = [x[order] for x in (row, key, c1, c2)]
                first = np.flatnonzero(np.concatenate(([True], np.any([x[1:] != x[:-1] for x in same], axis=0))))
                o = order[first]
                place = (at - offsets[row])[order].astype(np.int32)
                yield pa.record_batch(
                    [
                        pa.array(key[o].view(np.int64)), pa.array(c1[o].view(np.int64)), pa.array(c2[o].view(np.int64)),
                        ids.slice(a, b - a).take(pa.array(row[o])), marks.slice(a, b - a).take(pa.array(row[o])),
                        pa.array(left[o].astype(np.int32)), pa.array((end - begin)[o].astype(np.int32)), K.list_column(place, np.append(first, len(order)), pa.int32()), pa.array(many[o]),
                    ],
                    schema=_ANCHOR,
                )

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts asked for: column ``want`` lists (anchor, c1, c2, left, len, at, hot)."""
    for batch in batches:
        raw, offsets = K.buffers(batch["text"])
        out: list[list] = [[] for _ in _CONTEXT]
        size = 0
        for i, (doc, mark, want) in enumerate(zip(batch["doc_id"].to_pylist(), batch["t1"].to_pylist(), batch["want"].to_pylist(), strict=True)):
            for w in want:
                s = offsets[i] + w["at"] - w["left"]
                row = (w["anchor"], w["c1"], w["c2"], doc, mark, w["left"], w["at"], raw[s : s + w["len"]].tobytes(), w["hot"])
                for column, x in zip(out, row, strict=True):
                    column.append(x)
                size += w["len"]
            if size > 4 << 20:
                yield _contexts(out)
                out, size = [[] for _ in _CONTEXT], 0
        if size:
            yield _contexts(out)


_CONTEXT = pa.schema([*((x, pa.int64()) for x in ("anchor", "c1", "c2", "doc_id", "t1")), ("left", pa.int32()), ("at", pa.int32()), ("bytes", pa.binary()), ("hot", pa.bool_())])


def _contexts(out: list[list]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, f.type) for x, f in zip(out, _CONTEXT, strict=True)], schema=_CONTEXT)


_SPANS = pa.schema([("anchor", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("spans", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))])


def _spans_of(marked: np.ndarray, length: int) -> list[dict]:
    """Runs covered by strings of ``length`` that start at the marked places."""
    if not len(marked):
        return []
    breaks = np.flatnonzero(np.diff(marked) > length)
    a = marked[np.concatenate(([0], breaks + 1))]
    b = marked[np.append(breaks, len(marked) - 1)] + length
    return [{"s": int(x), "e": int(y)} for x, y in zip(a, b, strict=True)]


def sorted_repeats(texts: list[np.ndarray], identity: np.ndarray, at: np.ndarray, length: int) -> list[np.ndarray]:
    """For each text, the starts of strings of ``length`` that stand at two places; (identity, at + start) tells places apart."""
    t, starts, ends = join_texts(texts)
    sa = suffix_array(t)
    own = np.searchsorted(starts, sa, side="right") - 1
    keep = ends[own] - sa >= length
    sa, own = sa[keep], own[keep]
    if not len(sa):
        return [np.empty(0, dtype=np.int64) for _ in texts]
    values = np.concatenate((K.mix(np.arange(1, 258, dtype=np.uint64)) | np.uint64(1), [np.uint64(1)]))
    same = equal_prefix_runs(t, sa, K.SpanHash(t, values).windows(length), length)
    run = np.cumsum(~same) - 1
    first = np.flatnonzero(~same)
    place = sa - starts[own] + at[own]
    differs = np.zeros(len(first), dtype=bool)
    for x in (identity[own], place):
        differs |= np.minimum.reduceat(x, first) != np.maximum.reduceat(x, first)
    hit = differs[run]
    sa, own = sa[hit], own[hit]
    order = np.argsort(sa)
    sa, own = sa[order], own[order]
    cut = np.searchsorted(own, np.arange(len(texts) + 1))
    return [sa[x:y] - s for x, y, s in zip(cut[:-1], cut[1:], starts, strict=True)]


def _sort(length: int):
    def flush(rows: list[tuple]) -> pa.RecordBatch:
        _, identity = np.unique(np.array([(r[3], r[4]) for r in rows], dtype=np.int64), axis=0, return_inverse=True)
        at = np.array([r[6] - r[5] for r in rows], dtype=np.int64)
        marks = sorted_repeats([np.frombuffer(r[7], dtype=np.uint8) for r in rows], identity.ravel(), at, length)
        found = [(r[0], r[1], r[2], [{"s": x["s"] - r[5], "e": x["e"] - r[5]} for x in _spans_of(m, length)]) for r, m in zip(rows, marks, strict=True) if len(m)]
        return pa.record_batch([pa.array([f[i] for f in found], k.type) for i, k in enumerate(_SPANS)], schema=_SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= BATCH_BYTES and r[0] != rows[-1][0]:
                    yield flush(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[7])
        if rows:
            yield flush(rows)

    return run


def _windows(length: int):
    """Each string of ``length`` of a context: 128-bit hash and place."""
    names = ["w1", "w2", "doc_id", "t1", "place", "anchor", "c1", "c2", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                anchor, c1, c2, doc, mark, left, at, text = (c[k].as_py() for c in batch.columns)
                data = np.frombuffer(text, dtype=np.uint8)
                w1, w2 = K.SpanHash(data, _VALUES).windows(length), K.second_hash(data).windows(length)
                s = np.arange(len(w1), dtype=np.int64)
                fixed = [np.full(len(w1), x, dtype=np.int64) for x in (doc, mark, anchor, c1, c2)]
                yield pa.record_batch([pa.array(x) for x in (w1.view(np.int64), w2.view(np.int64), fixed[0], fixed[1], s + at - left, *fixed[2:], s - left)], names=names)

    return run


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, t1, spans): byte ranges of each document covered by strings of ``length`` bytes that start anywhere else too.

    ``docs``: doc_id long (no nulls), t1 a hash of text, text (no nulls). Rows of one doc_id and text share one result.
    """
    bounded_batches(docs.sparkSession)
    gram = min(GRAM, length)
    found = stored(docs.mapInArrow(_find(length, gram), "anchor long, c1 long, c2 long, doc_id long, t1 long, left int, len int, at array<int>, many boolean"), "anchors")
    often = found.groupBy("anchor").agg(F.sum(F.size("at") + F.col("many").cast("int")).alias("places"), F.count("*").alias("n"))
    often = stored(often.where("places > 1").select("anchor", "n"), "often")
    again = stored(spread_join(found, often.select("anchor"), ["anchor"], heavy_keys(often, ["anchor"], found.count())), "anchors")
    drop(found)
    drop(often)
    context = ["anchor", "c1", "c2"]
    contexts = again.groupBy(*context).agg(F.sum(F.size("at")).alias("places"), F.count("*").alias("n"), F.max("many").alias("many"), F.min(F.struct("doc_id", "t1", F.col("at")[0].alias("at"), "left", "len")).alias("r"))
    contexts = stored(contexts, "contexts")
    several = stored(contexts.groupBy("anchor").agg(F.count("*").alias("n"), F.max("many").alias("many")).where("n > 1 or many").select("anchor", "n"), "several")
    whole = contexts.where("places > 1").select(*context, F.expr("array(struct(-r.left AS s, r.len - r.left AS e))").alias("spans"))
    heavy = heavy_keys(several, ["anchor"], contexts.count())
    want = spread_join(contexts.select(*context, "r"), several.withColumn("hot", F.col("n") > HOT).select("anchor", "hot"), ["anchor"], heavy).select(*context, "r.*", "hot")
    want = want.groupBy("doc_id", "t1").agg(F.collect_list(F.struct("anchor", "c1", "c2", "left", "len", "at", "hot")).alias("want"))
    fields = "anchor long, c1 long, c2 long, doc_id long, t1 long, left int, at int, bytes binary"
    cut = docs.join(want, ["doc_id", "t1"]).select("doc_id", "t1", "text", "want").mapInArrow(_cut, f"{fields}, hot boolean")
    any_hot = not several.where(F.col("n") > HOT).isEmpty()
    # read twice only where there are hot anchors
    cut = stored(cut, "cut") if any_hot else cut
    kind = "anchor long, c1 long, c2 long, spans array<struct<s:int,e:int>>"
    cool = cut.where("not hot").drop("hot").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sort(length), kind)
    spans = whole.union(cool)
    if any_hot:
        strings = cut.where("hot").drop("hot").mapInArrow(_windows(length), "w1 long, w2 long, doc_id long, t1 long, place long, anchor long, c1 long, c2 long, start long")
        strings = stored(strings, "strings")
        place = F.struct("doc_id", "t1", "place")
        known = strings.groupBy("w1", "w2").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.count("*").alias("n")).where("x <> y").select("w1", "w2", "n")
        known = stored(known, "known")
        known = spread_join(strings, known.select("w1", "w2"), ["w1", "w2"], heavy_keys(known, ["w1", "w2"], strings.count()))
        spans = spans.union(known.groupBy(*context).agg(F.collect_list(F.expr(f"struct(int(start) AS s, int(start + {length}) AS e)"))))
    heavy = heavy_keys(contexts.where("places > 1"), context, again.count())
    # joined twice where there are heavy keys
    spans = stored(spans, "runs") if heavy else spans
    absolute = spread_join(again, spans, context, heavy)
    absolute = absolute.select("doc_id", "t1", F.explode(F.expr("transform(at, p -> transform(spans, x -> struct(x.s + p AS s, x.e + p AS e)))")).alias("x"))
    out = stored(absolute.select("doc_id", "t1", F.explode("x").alias("x")).groupBy("doc_id", "t1").agg(F.collect_set("x").alias("spans")), "spans")
    for x in (again, contexts, several, cut, spans):
        drop(x)
    return out


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = K.buffers(batch["text"])
        out: list[list] = [[] for _ in range(4)]
        for i, spans in enumerate(batch["spans"].to_pylist()):
            text, at, kept = raw[offsets[i] : offsets[i + 1]], 0, []
            runs = merged(spans or [])
            for s, e in runs:
                kept.append(text[at:s].tobytes())
                at = e
            kept.append(text[at:].tobytes())
            for column, x in zip(out, (len(text), sum(e - s for s, e in runs), runs, b"".join(kept)), strict=True):
                column.append(x)
        pairs = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        yield pa.record_batch(
            [batch["doc_id"], pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array([[{"s": s, "e": e} for s, e in r] for r in out[2]], pairs), pa.array(out[3], pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "spans", "kept"],
        )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _remove(batches):
        sha = [hashlib.sha256(x.as_py()).hexdigest() for x in batch["kept"]]
        yield pa.record_batch([batch["doc_id"], batch["n_bytes"], batch["n_removed"], pa.array([len(x) for x in batch["spans"]], pa.int64()), pa.array(sha)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, length: int = 400, digest: bool = False) -> DataFrame:
    """Every row of ``docs`` (doc_id, text; more columns are ignored) without the bytes that repeated strings cover.

    Returns doc_id, n_bytes, n_removed, spans (maximal removed runs, as byte ranges) and kept (binary: a cut may fall
    inside a character); with ``digest``, n_spans and kept_sha256 instead of the last two. A null text counts as empty;
    texts shorter than ``length`` keep all; matches don't cross documents; repeated rows are places of their own, so each
    loses all that is long enough; a null doc_id is kept as null. No rows give no rows.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # the mark tells a null id from the least one
    rows = rows.select("id", F.coalesce("id", F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64("text", F.col("id").isNull()).alias("t1"), "text")
    spans = repeated_spans(rows.select("doc_id", "t1", "text"), length)
    out = rows.join(spans, ["doc_id", "t1"], "left").select(F.col("id").alias("doc_id"), "text", "spans")
    if digest:
        return out.mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, spans array<struct<s:int,e:int>>, kept binary")
