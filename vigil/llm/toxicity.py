"""Toxicity of documents, scored on text restored from obfuscation.

A word written with digits, signs, dots, gaps or repeated letters is a noisy observation of a plain one. Its characters
open a lattice (a letter is itself or a repetition to drop; a digit or sign is one of the letters it looks like, or
nothing; a gap or separator joins or parts), and a Viterbi search over all its states (the last two symbols) finds the
path of least cost under a character trigram model, counted over all documents. What is scored are the plain words and
the restored ones.

A lexicon gives each word and word beginning or ending its log-odds of standing in a toxic document; a document's
score comes from its highest words through a logistic regression. Labels are read only for rows in the training part:
at most ``SAMPLE`` of them, of the smallest hashes of doc_id. The lexicon and the regression use different rows; the
lexicon takes every feature of ``LEAST_DOCS`` toxic rows, so the sample bounds its size.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm import kernel as K
from vigil.llm.logistic import fit, logit, sigmoid
from vigil.llm.session import bounded_batches, smallest

SAMPLE = 50_000
LEAST_DOCS = 3
THRESHOLD = 0.7
#: Letters: 0 for all that is none, a-z, and Latin letters of two bytes by the low five bits of the second.
SYMBOLS = 59
#: The letters that digits and signs are written for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e"}
DROPPED = ".-_*~'^:,/#`"
DOUBLED, REPEATED, LOOKED, SKIPPED, SKIPPED_SIGN, GAP_KEPT, GAP_SIGN = 1.5, 0.2, 0.7, 0.4, 12.0, 0.0, 1.0
#: Stretches of up to so many characters, of all lengths decoded, have their answers kept for the next time.
REMEMBERED = 48
BEGINNINGS, ENDINGS = (4, 5, 6, 8), (5, 7)
_LETTERS = np.zeros(256, dtype=np.int64)
_LETTERS[97:123] = _LETTERS[65:91] = np.arange(1, 27)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOOK = np.zeros(256, dtype=bool)
_LOOK[[ord(c) for c in LOOKS if ord(c) < 128]] = True
_FOLD = dict(K.LOWER)
_VALUES = K.byte_values(10, _FOLD)
_FILTER_BITS = 20


def symbol(c: str) -> int:
    o = ord(c)
    if 97 <= o <= 122:
        return o - 96
    return 27 + (o & 31) if 0xC0 <= o <= 0xFF else 0


def symbols_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all characters, and the row of each."""
    lead = data == 0xC3
    after = np.concatenate(([False], lead[:-1]))
    s = np.where(after, 27 + (data & 31).astype(np.int64), _LETTERS[data])
    s[(data >= 128) & ~after] = 0
    keep = ~lead
    return s[keep], np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[keep]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, dtype=np.int64)
    for batch in batches:
        for _, _, data, offsets in K.pieces(batch["text"]):
            s, row = symbols_of(data, offsets)
            if len(s) > 2:
                code = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
                total += np.bincount(code[row[:-2] == row[2:]], minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["code", "n"])


def language_model(texts: DataFrame) -> np.ndarray:
    """Costs (negative logarithms) of a symbol after two others, from all texts; interpolated with shorter contexts."""
    rows = texts.select("text").mapInArrow(_count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(SYMBOLS**3)
    n[rows["code"].to_numpy()] = rows["n"].to_numpy()
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    one = n.sum(axis=(0, 1)) + 1
    one /= one.sum()
    two = n.sum(axis=0) + 50 * one
    two /= two.sum(axis=1, keepdims=True)
    three = n + 20 * two[None, :, :]
    three /= three.sum(axis=2, keepdims=True)
    return -np.log(three)


class Restorer:
    """Finds the likeliest plain form of obfuscated words; answers for words are kept."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()
        self.word = functools.lru_cache(100_000)(self._decode)

    def _options(self, c: str, run: int) -> list[tuple[str, float]]:
        """What a character may stand for, and at which cost; ``run``: how often it stood just before."""
        again = [("", REPEATED if run > 1 else DOUBLED)] if run else []
        if c == " ":
            return [("", SKIPPED), (" ", GAP_KEPT)]
        if symbol(c) or c.isalpha():
            return [(c, 0.0), *again]
        if c in LOOKS:
            return [(x, LOOKED) for x in LOOKS[c]] + [("", SKIPPED_SIGN if c.isdigit() else 2 * LOOKED), *again]
        return [("", SKIPPED), (" ", GAP_SIGN)] if c in DROPPED else [("", SKIPPED_SIGN)]

    def _decode(self, seen: str) -> str:
        costs = self.costs
        # a state is the last two symbols; its path is linked from the end, and written out where all paths have met
        paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        done: list[str] = []
        last, run = "", 0
        for c in seen:
            run = run + 1 if c == last else 0
            options = [(out, symbol(out) if out else 0, extra) for out, extra in self._options(c, run)]
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in paths.items():
                for out, s, extra in options:
                    if out:
                        key, total, to = (b, s), cost + extra + costs[a][b][s], (path, out)
                    else:
                        key, total, to = (a, b), cost + extra, path
                    if key not in new or total < new[key][0]:
                        new[key] = (total, to)
            if len(new) == 1:
                key, (_, path) = new.popitem()
                done += _written(path)
                new[key] = (0.0, None)
            paths = new
            last = c
        return "".join(done + _written(min(((cost + costs[a][b][0], path) for (a, b), (cost, path) in paths.items()), key=lambda x: x[0])[1]))

    def long(self, seen: str) -> str:
        """Of a run of any length, decoded whole; answers for runs beyond ``REMEMBERED`` aren't kept."""
        return self.word(seen) if len(seen) <= REMEMBERED else self._decode(seen)


def _written(path: tuple | None) -> list[str]:
    out = []
    while path is not None:
        path, c = path
        out.append(c)
    return out[::-1]


def suspects(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, start, end) of stretches that may hide words: words with signs between their letters or letters three times in a row, and runs of four or more single characters."""
    n = len(data)
    if not len(start):
        return []
    total = lambda x: np.concatenate(([0], np.cumsum(x)))
    letter, look = _LETTER[data], _LOOK[data]
    core = letter | look
    at = np.arange(n)
    nxt = np.minimum.accumulate(np.where(core, at, n)[::-1])[::-1]
    s = np.minimum(nxt[start], end)
    prev = np.maximum.accumulate(np.where(letter | (look & (data < 58) & (data > 47)), at, -1))
    e = np.maximum(prev[end - 1] + 1, s)
    # one sign at the end may stand for a letter; a run of signs is decoration
    tail = (e < end) & look[np.minimum(e, n - 1)] & ((e + 1 == end) | ~core[np.minimum(e + 1, n - 1)])
    signs = total(~letter)
    letters = total(letter)
    triple = np.zeros(n, dtype=bool)
    triple[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & letter[2:]
    inside = signs[e] - signs[s]
    many = letters[e] - letters[s]
    odd = (inside > 0) & (many > 0) | (total(triple)[e] - total(triple)[s] > 0) | (tail & (many > 1))
    ends = np.where(tail, e + 1, e)
    size = ends - s
    odd &= size >= 3
    out = [(int(r), int(a), int(b)) for r, a, b in zip(row[odd], s[odd], ends[odd], strict=True)]
    width = total((data & 0xC0) != 0x80)
    single = (width[end] - width[start] == 1) & core[start]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], single.astype(np.int8), [0]))))
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        cuts = [a, *[i for i in range(a + 1, b) if row[i] != row[i - 1]], b]
        out += [(int(row[x]), int(start[x]), int(end[y - 1])) for x, y in zip(cuts[:-1], cuts[1:], strict=True) if y - x >= 4]
    return out


@dataclass
class Words:
    """Feature hashes of the plain and restored words of a piece: for each kind of feature an array aligned with ``row``."""

    row: np.ndarray
    kinds: list[np.ndarray]
    count: np.ndarray


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    h = K.SpanHash(data, _VALUES)
    size = end - start
    out = [h(start, end)]
    for i, k in enumerate(BEGINNINGS):
        out.append(np.where(size >= k, K.mix(h(start, np.minimum(start + k, end)) ^ np.uint64(100 + i)), np.uint64(0)))
    for i, k in enumerate(ENDINGS):
        out.append(np.where(size >= k, K.mix(h(np.maximum(end - k, start), end) ^ np.uint64(200 + i)), np.uint64(0)))
    return out


_NO_LETTERS = ~_LETTER


def words_of(batch_text: pa.Array, restorer: Restorer) -> Iterator[tuple[int, int, Words]]:
    for a, b, data, offsets in K.pieces(batch_text):
        start, end, row = K.word_spans(data, offsets, _NO_LETTERS)
        kinds = _hashes(data, start, end)
        count = np.bincount(row, minlength=b - a)
        found = suspects(data, *K.word_spans(data, offsets))
        plain = [(r, restorer.long(data[s:e].tobytes().decode("utf-8", "ignore").lower().translate(_GAPS)).encode()) for r, s, e in found]
        plain = [(r, x) for r, x in plain if x]
        if plain:
            joined = np.frombuffer(b"".join(x for _, x in plain), dtype=np.uint8)
            cuts = np.concatenate(([0], np.cumsum([len(x) for _, x in plain])))
            s, e, i = K.word_spans(joined, cuts, _NO_LETTERS)
            own = np.array([r for r, _ in plain])[i]
            more = _hashes(joined, s, e)
            row = np.concatenate((row, own))
            kinds = [np.concatenate(x) for x in zip(kinds, more, strict=True)]
        yield a, b, Words(row, kinds, count)


_GAPS = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})


def _seen_in_toxic(costs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(costs)
        for batch in batches:
            for _, _, w in words_of(batch["text"], restorer):
                h, r = np.concatenate(w.kinds), np.tile(w.row, len(w.kinds))
                pair = np.unique(np.stack((h[h > 0], r[h > 0].astype(np.uint64)), axis=1), axis=0)
                f, n = np.unique(pair[:, 0], return_counts=True)
                yield pa.record_batch([pa.array(f.view(np.int64)), pa.array(n)], names=["f", "n"])

    return run


def _seen_among(costs: np.ndarray, features: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, total = Restorer(costs), np.zeros((2, len(features)), dtype=np.int64)
        docs = np.zeros(2, dtype=np.int64)
        table = _table(features)
        for batch in batches:
            toxic = batch["toxic"].to_numpy()
            for a, b, w in words_of(batch["text"], restorer):
                y = toxic[a:b]
                docs += np.bincount(y, minlength=2)
                for h in w.kinds:
                    at, ok = _lookup(features, table, h)
                    pair = np.unique(np.stack((at, w.row[ok]), axis=1), axis=0)
                    for label in (0, 1):
                        total[label] += np.bincount(pair[y[pair[:, 1]] == label, 0], minlength=len(features))
        f = np.concatenate((np.arange(len(features)), [-1]))
        yield pa.record_batch([pa.array(f), pa.array(np.append(total[0], docs[0])), pa.array(np.append(total[1], docs[1]))], names=["f", "n0", "n1"])

    return run


def _table(features: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << _FILTER_BITS, dtype=bool)
    out[features >> np.uint64(64 - _FILTER_BITS)] = True
    return out


def _lookup(features: np.ndarray, table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted ``features`` of those of ``h`` that are there, and where in ``h`` they are."""
    if not len(features):
        e = np.empty(0, dtype=np.int64)
        return e, e
    some = np.flatnonzero(table[h >> np.uint64(64 - _FILTER_BITS)])
    at = np.minimum(np.searchsorted(features, h[some]), len(features) - 1)
    ok = features[at] == h[some]
    return at[ok], some[ok]


@dataclass
class Model:
    costs: np.ndarray
    features: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.uint64))
    odds: np.ndarray = field(default_factory=lambda: np.empty(0))
    weights: np.ndarray | None = None
    base: float = 0.0

    def evidence(self, w: Words, table: np.ndarray) -> np.ndarray:
        """Per row: its three highest different words, how many stand out, their share, its length."""
        n = len(w.count)
        best = np.zeros(len(w.row))
        for h in w.kinds:
            at, where = _lookup(self.features, table, h)
            np.maximum.at(best, where, self.odds[at])
        some = np.flatnonzero(best > 0)
        row, word, value = w.row[some], w.kinds[0][some], best[some]
        order = np.lexsort((word, row))
        row, word, value = row[order], word[order], value[order]
        new = np.concatenate(([True], (word[1:] != word[:-1]) | (row[1:] != row[:-1]))) if len(row) else np.zeros(0, dtype=bool)
        high = np.bincount(row[value > 2], minlength=n)
        kinds = np.bincount(row[new & (value > 2)], minlength=n)
        row, value = row[new], value[new]
        order = np.lexsort((-value, row))
        row, value = row[order], value[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        top = np.zeros((n, 3))
        first = place < 3
        top[row[first], place[first]] = value[first]
        return np.column_stack((top, np.log1p(high), np.log1p(kinds), high / np.maximum(w.count, 1), np.log1p(w.count)))

    def __call__(self, w: Words, table: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(w.count), self.base)
        return sigmoid(logit(self.evidence(w, table), self.weights))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are not read: crc32 of doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _evidence(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, table = Restorer(model.costs), _table(model.features)
        for batch in batches:
            for a, b, w in words_of(batch["text"], restorer):
                yield pa.record_batch([batch["toxic"].slice(a, b - a), pa.array(list(model.evidence(w, table)), pa.list_(pa.float64()))], names=["toxic", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """``labels``: doc_id, toxic (1, 0; nulls don't count; the greatest of several counts); held-out rows are not used."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = Model(language_model(texts))
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.where(~held_out())
    few = smallest(known, F.xxhash64("doc_id"), SAMPLE, known.count(), "doc_id")
    # at most SAMPLE rows of 12 bytes
    rows = texts.join(F.broadcast(few), "doc_id")
    for_lexicon = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) < 2
    own = rows.where(for_lexicon)
    found = own.where("toxic = 1").select("text").mapInArrow(_seen_in_toxic(model.costs), "f long, n long").groupBy("f").agg(F.sum("n").alias("n"))
    found = found.where(F.col("n") >= LEAST_DOCS).select("f").toArrow()
    features = np.sort(found["f"].to_numpy().view(np.uint64)) if found.num_rows else np.empty(0, dtype=np.uint64)
    seen = own.select("text", "toxic").mapInArrow(_seen_among(model.costs, features), "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    f, n0, n1 = (seen[c].to_numpy() for c in ("f", "n0", "n1"))
    d0, d1 = int(n0[f == -1].sum()), int(n1[f == -1].sum())
    model.base = (d1 + 1) / (d0 + d1 + 10)
    if min(d0, d1) < 5:
        return model
    counts = np.zeros((2, len(features)))
    counts[:, f[f >= 0]] = n0[f >= 0], n1[f >= 0]
    share = lambda n, d: (n + 0.2) / (d + 0.4)
    odds = np.log(share(counts[1], d1)) - np.log(share(counts[0], d0))
    # an estimate that one document could have made counts for less
    odds -= 1.0 / np.sqrt(np.maximum(counts[1], 1))
    keep = odds > 1
    model.features, model.odds = features[keep], odds[keep]
    rest = rows.where(~for_lexicon).select("text", "toxic").mapInArrow(_evidence(model), "toxic int, x array<double>").toArrow()
    y = rest["toxic"].to_numpy()
    if min((y == 0).sum(), (y == 1).sum()) >= 5:
        x = np.asarray(rest["x"].combine_chunks().flatten()).reshape(len(y), -1)
        order = np.lexsort((*x.T, y))
        model.weights = fit(x[order], y[order], 0.5)
    return model


def _score(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, table = Restorer(model.costs), _table(model.features)
        for batch in batches:
            for a, b, w in words_of(batch["text"], restorer):
                p = model(w, table)
                yield pa.record_batch([*(batch[c].slice(a, b - a) for c in ("doc_id", "held_out")), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text; more columns are ignored).

    Null and empty texts are scored as texts without words; a null doc_id is not held out. Repeated rows get a row each.
    With too few labels of either kind all rows get one score, the share of toxic ones. No rows give no rows.
    """
    model = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out())
    return rows.mapInArrow(_score(model, threshold), "doc_id long, held_out boolean, score double, predicted int")
