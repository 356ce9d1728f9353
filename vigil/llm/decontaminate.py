"""Finds benchmark items inside documents: size-partitioned MinHash containment search, confirmed on exact shingle sets.

After LSH Ensemble (Zhu et al. 2016): similarity of a short item and a long text is low even where the text holds the
whole item, so items are put in partitions by size, and for each partition a text is seen as windows of about that
size. Windows are runs of blocks of ``GRAIN`` shingles; a block's minima are taken once and serve all partitions. Beside
a window even an item that it holds can be small: items of up to ``SMALL`` shingles are looked up by each of their
shingles instead, which misses none. Larger ones have a similarity of 0.4 or more with a window that holds
``THRESHOLD`` of them, and 32 coordinates with one-row bands miss them there with a probability below 1e-7; one whose
parts stand far apart in the text can have less. A candidate is confirmed if the share of
the item's distinct shingles that the whole text holds is ``THRESHOLD`` or more.

The index goes to every task with the function. It is built from at most ``BLOCK_WORDS`` words of items; a larger
benchmark is searched in several blocks, one pass over the documents each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import kernel as K
from vigil.llm.session import bounded_batches

WORDS, THRESHOLD, COORDINATES, GRAIN, SMALL = 5, 0.8, 32, 8, 16
BLOCK_WORDS = 4_000_000
_VALUES = K.byte_values(9)
_BREAKS = np.ones(256, dtype=bool)
_BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_FACTORS = K.mix(np.arange(500, 500 + COORDINATES, dtype=np.uint64)) | np.uint64(1)


def words_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, word hashes, their rows): words are runs of letters and digits, in lower case."""
    for a, b, data, offsets in K.pieces(pc.utf8_lower(column)):
        start, end, rows = K.word_spans(data, offsets, _BREAKS)
        yield a, b, K.SpanHash(data, _VALUES)(start, end), rows


class Index:
    """Items by the number of words of a shingle (fewer than five for items that are shorter) and by size."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids, self.sets, width = [], [], []
        for a, b, words, rows in words_of(pa.array(texts, pa.string())):
            cut = np.searchsorted(rows, np.arange(b - a + 1))
            for i in range(b - a):
                own = words[cut[i] : cut[i + 1]]
                if len(own):
                    k = min(WORDS, len(own))
                    h, _ = K.shingles(own, np.zeros(len(own), dtype=np.int64), 1, k)
                    self.ids.append(ids[a + i])
                    self.sets.append(np.unique(h))
                    width.append(k)
        self.sizes = sizes = np.array([len(s) for s in self.sets], dtype=np.int64)
        #: for each number of words in a shingle: sorted shingles of small items, their items, filter table, its bits
        self.small = {}
        for k in sorted(set(width)):
            own = [i for i in range(len(sizes)) if width[i] == k and sizes[i] <= SMALL]
            if own:
                keys = np.concatenate([self.sets[i] for i in own])
                order = np.argsort(keys, kind="stable")
                bits = max(12, int(np.ceil(np.log2(64 * len(keys)))))
                table = np.zeros(1 << bits, dtype=bool)
                table[K.mix(keys) >> np.uint64(64 - bits)] = True
                self.small[k] = keys[order], np.repeat(own, sizes[own])[order], table, bits
        #: (words in a shingle, blocks in a window, for each coordinate the sorted minima and their items, filter table)
        self.partitions = []
        classes = np.ceil(np.log(np.maximum(sizes, 1)) / np.log(1.5)).astype(int)
        for k, c in sorted(set(zip(width, classes.tolist(), strict=True))):
            own = [i for i in range(len(sizes)) if width[i] == k and classes[i] == c and sizes[i] > SMALL]
            if not own:
                continue
            low = np.stack([(self.sets[i][None, :] * _FACTORS[:, None]).min(axis=1) for i in own], axis=1)
            order = np.argsort(low, axis=1, kind="stable")
            bits = max(12, int(np.ceil(np.log2(64 * len(own)))))
            table = np.zeros((COORDINATES, 1 << bits), dtype=bool)
            for j in range(COORDINATES):
                table[j, K.mix(low[j]) >> np.uint64(64 - bits)] = True
            blocks = int(np.ceil(max(sizes[own]) / GRAIN)) + 1
            self.partitions.append((k, blocks, np.take_along_axis(low, order, axis=1), np.array(own)[order], table, bits))

    def held(self, h: np.ndarray, r: np.ndarray, k: int, threshold: float) -> set[tuple[int, int]]:
        """(row, item) pairs of the small items that rows hold to ``threshold`` or more, by exact look-up."""
        if not len(h) or k not in self.small:
            return set()
        keys, items, table, bits = self.small[k]
        hit = table[K.mix(h) >> np.uint64(64 - bits)]
        x, o = h[hit], r[hit]
        order = np.lexsort((x, o))
        x, o = x[order], o[order]
        new = np.ones(len(x), dtype=bool)
        new[1:] = (x[1:] != x[:-1]) | (o[1:] != o[:-1])
        x, o = x[new], o[new]
        a, b = np.searchsorted(keys, x), np.searchsorted(keys, x, side="right")
        n = b - a
        found = items[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        pair, shared = np.unique(np.repeat(o, n) * len(self.sizes) + found, return_counts=True)
        row, item = np.divmod(pair, len(self.sizes))
        enough = shared >= threshold * self.sizes[item] - 1e-9
        return set(zip(row[enough].tolist(), item[enough].tolist(), strict=True))

    def candidates(self, h: np.ndarray, r: np.ndarray, k: int) -> set[tuple[int, int]]:
        """(row, item) pairs of larger items that share a minimum in some window."""
        out: set[tuple[int, int]] = set()
        mine = [p for p in self.partitions if p[0] == k]
        if not len(h) or not mine:
            return out
        first = np.concatenate(([0], np.flatnonzero(r[1:] != r[:-1]) + 1))
        n = np.diff(np.append(first, len(r)))
        count = -(-n // GRAIN)
        start = np.repeat(first, count) + GRAIN * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
        owner = r[start]
        for j in range(COORDINATES):
            low = np.minimum.reduceat(h * _FACTORS[j], start)
            for _, blocks, keys, items, table, bits in mine:
                least, have = low, 1
                while have < blocks:
                    step = min(have, blocks - have)
                    least = np.minimum(least, np.concatenate((least[step:], least[-1:].repeat(min(step, len(least))))[: len(least)]))
                    have += step
                new = np.concatenate(([True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])))
                x, o = least[new], owner[new]
                hit = table[j, K.mix(x) >> np.uint64(64 - bits)]
                x, o = x[hit], o[hit]
                a, b = np.searchsorted(keys[j], x), np.searchsorted(keys[j], x, side="right")
                out.update((int(row), int(i)) for row, s, e in zip(o, a, b, strict=True) for i in items[j, s:e])
        return out

    def hits(self, column: pa.Array, threshold: float) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, its shingles, those the row holds)."""
        for a, b, words, rows in words_of(column):
            for k in sorted({p[0] for p in self.partitions} | self.small.keys()):
                h, r = K.shingles(words, rows, b - a, k)
                full = np.bincount(rows, minlength=b - a) >= k
                h, r = h[full[r]], r[full[r]]
                found = sorted(self.held(h, r, k, threshold) | self.candidates(h, r, k))
                if not found:
                    continue
                cut = np.searchsorted(r, np.arange(b - a + 1))
                last, own = -1, h[:0]
                for row, i in found:
                    if row != last:
                        last, own = row, np.sort(h[cut[row] : cut[row + 1]])
                    s = self.sets[i]
                    shared = int((own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s).sum())
                    if shared >= threshold * len(s) - 1e-9:
                        yield a + row, i, len(s), shared


def _indexes(items: DataFrame) -> Iterator[Index]:
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    words = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = int(words // BLOCK_WORDS) + 1
    for k in range(n):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        yield Index([x[0] for x in own], [x[1] for x in own])


_HIT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_item", pa.int64()), ("n_shared", pa.int64()), ("containment", pa.float64())])


def _search(index: Index, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch["doc_id"]
            out = [(docs[row].as_py(), index.ids[i], n, shared, shared / n) for row, i, n, shared in index.hits(batch["text"], threshold)]
            yield pa.record_batch([pa.array([x[c] for x in out], f.type) for c, f in enumerate(_HIT)], schema=_HIT)

    return run


def _clean(index: Index, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for row, *_ in index.hits(batch["text"].cast(pa.string()), threshold):
                keep[row] = False
            yield batch.filter(pa.array(keep))

    return run


def contamination(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment for each item that a document holds to ``threshold`` or more.

    ``docs``: doc_id, text; ``items``: item_id, text; more columns are ignored. Words are runs of letters and digits,
    case ignored; an item's set holds its distinct runs of five words, or for a shorter item all its words as one run.
    Null or empty texts hold and are held by nothing. Repeated rows give a row each; null ids stay null. No documents
    or no items give no rows.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ddl = "doc_id long, item_id long, n_item long, n_shared long, containment double"
    out = None
    for index in _indexes(items):
        found = rows.mapInArrow(_search(index, threshold), ddl)
        out = found if out is None else out.union(found)
    return out


def decontaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item to ``threshold`` or more. Rows with null or empty texts stay."""
    bounded_batches(docs.sparkSession)
    for index in _indexes(items):
        docs = docs.mapInArrow(_clean(index, threshold), docs.schema)
    return docs
