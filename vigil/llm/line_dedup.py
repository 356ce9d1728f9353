"""Removal of multi-line passages that stand elsewhere in the corpus too.

A text is cut into chunks of two or three lines at content-defined places: a rolling hash over the hashes of a line and
the line before ranks the place after it, and places are taken from the lowest rank up unless one beside them, or the
text's begin or end, is a cut already, so that no chunk of a single line is left. Which places are taken depends on the
few lines around them, so a passage is cut alike nearly wherever it stands and whatever precedes it.
Chunks of two lines or more with something on them are counted by 128-bit hashes; only for those that occur again the
bytes are fetched and compared, by grouping on hash and bytes. The first occurrence, by doc_id and line, stays.
Chunks that make up much of the corpus are joined where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import kernel as K
from vigil.llm.session import bounded_batches, drop, heavy_keys, spread_join, stored

#: Places whose rolling hash is divisible by it may be cut; 1: all.
DIVISOR = 1
_VALUES = K.byte_values(3)
_CHUNK = pa.schema([(x, pa.int64()) for x in ("h1", "h2", "doc_id", "t1", "line", "start", "end", "lines")])
_DDL = ", ".join(f"{x.name} long" for x in _CHUNK)


def _cuts(rank: np.ndarray, ends: np.ndarray, may: np.ndarray) -> np.ndarray:
    """Lines after which a cut is made: the ``ends`` of rows, and of places that ``may`` be cut those of lowest rank first, no two side by side.

    Each round takes the places lower than both neighbours left; of a run of equal ones every other, from its first on.
    """
    cut = ends.copy()
    free = may & ~ends
    free[:-1] &= ~ends[1:]
    free[1:] &= ~ends[:-1]
    free[:1] = False
    left = np.flatnonzero(free)
    while len(left):
        r = rank[left]
        beside = left[1:] == left[:-1] + 1
        first = np.flatnonzero(np.concatenate(([True], ~(beside & (r[1:] == r[:-1])))))
        last = np.append(first[1:], len(left)) - 1
        higher = np.concatenate(([True], ~beside | (r[:-1] > r[1:]))), np.concatenate((~beside | (r[1:] > r[:-1]), [True]))
        low = np.repeat(higher[0][first] & higher[1][last], last - first + 1)
        taken = left[low & ((np.arange(len(left)) - np.repeat(first, last - first + 1)) % 2 == 0)]
        cut[taken] = True
        free[taken - 1] = free[taken] = free[taken + 1] = False
        left = left[free[left]]
    return cut


def line_chunks(data: np.ndarray, offsets: np.ndarray, h: K.SpanHash, divisor: int = DIVISOR) -> tuple[np.ndarray, ...]:
    """Row, first line, number of lines, start and end byte (newline at the end not counted) of every chunk."""
    breaks = np.flatnonzero(data == 10)
    ends = np.concatenate((breaks, offsets[1:]))
    starts = np.concatenate((breaks + 1, offsets[:-1]))
    row = np.concatenate((K.row_of(breaks, offsets), np.arange(len(offsets) - 1)))
    starts, r1 = starts[np.lexsort((starts, row))], np.sort(row)
    ends = ends[np.lexsort((ends, row))]
    lines = h(starts, ends)
    before = np.where(np.concatenate(([False], r1[1:] == r1[:-1])), np.concatenate((lines[:1], lines[:-1])), np.uint64(1))
    rolling = K.mix(lines * np.uint64(3) + before)
    to = np.flatnonzero(_cuts(rolling, np.concatenate((r1[1:] != r1[:-1], [True])), rolling % np.uint64(divisor) == 0))
    at = np.concatenate(([0], to[:-1] + 1))
    first_of_row = np.searchsorted(r1, np.arange(len(offsets) - 1))
    return r1[at], at - first_of_row[r1[at]], to - at + 1, starts[at], ends[to]


def _chunks(divisor: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in K.pieces(batch["text"]):
                if not len(data):
                    continue
                h, g = K.SpanHash(data, _VALUES), K.second_hash(data)
                row, line, lines, start, end = line_chunks(data, offsets, h, divisor)
                ink = np.concatenate(([0], np.cumsum(~K.SPACES[data])))
                keep = (lines > 1) & (ink[end] > ink[start])
                row, line, lines, start, end = (x[keep] for x in (row, line, lines, start, end))
                if len(row):
                    low = np.uint64((1 << bits) - 1)
                    at = offsets[row]
                    columns = [(h(start, end) & low).view(np.int64), (g(start, end) & low).view(np.int64), None, None, line, start - at, end - at, lines]
                    where = pa.array(row)
                    columns = [batch[x].slice(a, b - a).take(where) if c is None else pa.array(c, pa.int64()) for x, c in zip(_CHUNK.names, columns, strict=True)]
                    yield pa.record_batch(columns, schema=_CHUNK)

    return run


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = K.buffers(batch["text"])
        out: list[list] = [[] for _ in range(6)]
        for i, (doc, mark, want) in enumerate(zip(batch["doc_id"].to_pylist(), batch["t1"].to_pylist(), batch["want"].to_pylist(), strict=True)):
            for w in want:
                for c, x in zip(out, (w["h1"], w["h2"], doc, mark, w["line"], raw[offsets[i] + w["start"] : offsets[i] + w["end"]].tobytes()), strict=True):
                    c.append(x)
        yield pa.record_batch([pa.array(c, pa.int64()) for c in out[:5]] + [pa.array(out[5], pa.binary())], names=["h1", "h2", "doc_id", "t1", "line", "bytes"])


def _cut(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, removed, chars = [], [], [], []
            for text, spans in zip(batch["text"].to_pylist(), batch["_vigil_spans"].to_pylist(), strict=True):
                gone = {x for s in spans or () for x in range(s["line"], s["line"] + s["lines"])}
                lines = text.split("\n") if text else []
                if gone:
                    text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
                texts.append(text)
                counts.append(len(lines))
                removed.append(len(gone))
                chars.append(None if text is None else len(text))
            new = {"text": pa.array(texts, pa.string()), "n_lines": pa.array(counts, pa.int64()), "n_removed_lines": pa.array(removed, pa.int64()), "n_chars": pa.array(chars, pa.int64())}
            yield pa.record_batch([new[x] if x in new else batch[x] for x in names], names=names)

    return run


def dedup_lines(docs: DataFrame, divisor: int = DIVISOR, hash_bits: int = 64) -> DataFrame:
    """``docs`` (doc_id, text, any others) with repeated multi-line chunks taken out of ``text``.

    Adds (or replaces) n_lines and n_removed_lines, and sets n_chars where there is one. A null text stays null and an
    empty one empty, with no lines. Null doc_ids order first. Rows that agree in doc_id and text are one place: they
    lose the same chunks. Texts whose last chunks go may become empty; no row is dropped. No rows give no rows.
    """
    bounded_batches(docs.sparkSession)
    # the mark tells a null id from the least one
    keyed = docs.withColumns({"_vigil_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "_vigil_t1": F.xxhash64("text", F.col("doc_id").isNull())})
    slim = keyed.select(F.col("_vigil_id").alias("doc_id"), F.col("_vigil_t1").alias("t1"), "text").where("text is not null")
    found = stored(slim.mapInArrow(_chunks(divisor, hash_bits), _DDL), "chunks")
    key = ["h1", "h2"]
    often = stored(found.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), "often")
    heavy = heavy_keys(often, key, found.count())
    again = stored(spread_join(found, often.select(*key), key, heavy), "chunks")
    drop(found)
    drop(often)
    place = ["doc_id", "t1"]
    want = again.groupBy(*place).agg(F.collect_set(F.struct("h1", "h2", "line", "start", "end")).alias("want"))
    # texts are joined by sorting at any size: what is wanted of them grows with the documents
    texts = slim.join(want.hint("merge"), place).mapInArrow(_bytes, "h1 long, h2 long, doc_id long, t1 long, line long, bytes binary")
    first = texts.groupBy("h1", "h2", "bytes").agg(F.min(F.struct("doc_id", "t1", "line")).alias("first"))
    first = first.groupBy("h1", "h2").agg(F.collect_list("first").alias("first"))
    # joined twice where there are heavy keys
    first = stored(first, "first") if heavy else first
    gone = spread_join(again, first, key, heavy).where(~F.expr("array_contains(first, struct(doc_id, t1, line))"))
    gone = gone.groupBy(F.col("doc_id").alias("_vigil_id"), F.col("t1").alias("_vigil_t1")).agg(F.collect_set(F.struct("line", "lines")).alias("_vigil_spans"))
    gone = stored(gone, "gone")
    drop(again)
    drop(first)
    joined = keyed.join(gone.hint("merge"), ["_vigil_id", "_vigil_t1"], "left")
    added = {"n_lines": "long", "n_removed_lines": "long"}
    kinds = {f.name: "string" if f.name == "text" else "long" if f.name == "n_chars" else f.dataType.simpleString() for f in docs.schema} | added
    return joined.mapInArrow(_cut(list(kinds)), ", ".join(f"`{k}` {v}" for k, v in kinds.items()))
