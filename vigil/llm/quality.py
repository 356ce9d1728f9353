"""Quality of documents by co-training (Blum and Mitchell 1998) of two views.

One classifier sees the text (shape of its characters, words and lines, and hashed words), the other what is known
about the page besides (language, source, declared length). In each round either labels the documents of an unlabelled
pool that it is surest about, and these join the other's training rows. Each view is then calibrated on labelled rows
that neither was fitted on, a last regression on those rows weighs the two, and all documents are scored in one pass.

Fitting uses at most ``SAMPLE`` labelled and ``POOL`` unlabelled documents, the ones of the smallest hashes of doc_id;
scoring reads every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import kernel as K
from vigil.llm.logistic import fit, logit, sigmoid
from vigil.llm.session import bounded_batches, smallest

SAMPLE, POOL, ROUNDS, SURE, PER_ROUND = 10_000, 8_000, 4, 0.97, 400
#: The threshold is set so that at most this share of the good calibration documents falls below it, and never above one half.
GOOD_LOST = 0.005
WORD_BUCKETS, SOURCE_BUCKETS, LANG_BUCKETS = 128, 32, 8
_VALUES = K.byte_values(1, K.LOWER)
_KIND = np.zeros(256, dtype=np.int64)
for _k, _c in enumerate((range(97, 123), range(65, 91), range(48, 58), (32, 9, 13), (10,), b".,;:!?'\"()-", range(128, 256)), 1):
    _KIND[list(_c)] = _k


def _distinct(h: np.ndarray, r: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct values in each row."""
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (r[1:] != r[:-1]))) if len(h) else np.zeros(0, dtype=bool)
    return np.bincount(r[new], minlength=n)


def text_view(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    kinds = np.bincount(row * 8 + _KIND[data], minlength=8 * n).reshape(n, 8)
    share = kinds / np.maximum(size, 1)[:, None]
    start, end, of = K.word_spans(data, offsets)
    h = K.SpanHash(data, _VALUES)
    words = h(start, end)
    count = np.bincount(of, minlength=n)
    safe = np.maximum(count, 1)
    mean = lambda x: np.bincount(of, weights=x, minlength=n) / safe
    length = (end - start).astype(float)
    same = np.concatenate(([False], (words[1:] == words[:-1]) & (of[1:] == of[:-1]))) if len(words) else np.zeros(0)
    marked = np.isin(_KIND[data[end - 1]], (0, 3)) if len(words) else np.zeros(0)
    single = (length == 1).astype(float)
    # the second half of words against the first: whole phrases that come again
    pairs, pr = K.shingles(words, of, n, 3)
    lines = kinds[:, 5] + 1
    buckets = np.bincount(of * WORD_BUCKETS + (words % np.uint64(WORD_BUCKETS)).astype(np.int64), minlength=n * WORD_BUCKETS).reshape(n, -1)
    columns = [share, np.log1p(size), np.log1p(count), mean(length), np.sqrt(np.maximum(mean(length**2) - mean(length) ** 2, 0)), mean(same), mean(marked), mean(single)]
    columns += [_distinct(words, of, n) / safe, _distinct(pairs, pr, n) / np.maximum(np.bincount(pr, minlength=n), 1), np.log1p(size / lines), np.log1p(lines)]
    columns += [np.sqrt(buckets / safe[:, None])]
    return np.column_stack(columns).astype(np.float32)


def page_view(lang: list, source: list, n_chars: list) -> np.ndarray:
    n = len(lang)
    out = np.zeros((n, 2 + LANG_BUCKETS + SOURCE_BUCKETS), dtype=np.float32)
    for i, (a, b, c) in enumerate(zip(lang, source, n_chars, strict=True)):
        out[i, 0] = np.log1p(max(c or 0, 0))
        out[i, 1] = c is None
        for x, first, many in ((a, 2, LANG_BUCKETS), (b, 2 + LANG_BUCKETS, SOURCE_BUCKETS)):
            if x is not None:
                out[i, first + zlib.crc32(str(x).encode()) % many] = 1
    return out


def _views(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for a, b, data, offsets in K.pieces(batch["text"]):
        part = batch.slice(a, b - a)
        yield a, b, text_view(data, offsets), page_view(part["lang"].to_pylist(), part["source"].to_pylist(), part["n_chars"].to_pylist())


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, x, z in _views(batch):
            part = batch.slice(a, b - a)
            yield pa.record_batch([part["role"], part["quality"], part["mark"], pa.array(list(x), pa.list_(pa.float32())), pa.array(list(z), pa.list_(pa.float32()))], names=["role", "quality", "mark", "x", "z"])


@dataclass
class View:
    """A standardised logistic classifier and the line that calibrates its logits."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    line: tuple[float, float] = (1.0, 0.0)

    @classmethod
    def fitted(cls, x: np.ndarray, y: np.ndarray, ridge: float) -> View:
        mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        return cls(mean, scale, fit((x - mean) / scale, y, ridge))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return logit(np.clip((x - self.mean) / self.scale, -8, 8), self.weights)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        w = fit(self.raw(x)[:, None], y, 0.1)
        self.line = (max(float(w[0]), 0.0), float(w[1]))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.line[0] * self.raw(x) + self.line[1]


@dataclass
class Model:
    text: View | None
    page: View | None
    mix: np.ndarray | None
    threshold: float

    def __call__(self, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.mix is None:
            half = np.full(len(x), 0.5)
            return half, half, half
        a, b = self.text(x), self.page(z)
        return sigmoid(logit(np.column_stack((a, b)), self.mix)), sigmoid(a), sigmoid(b)


def co_train(x: np.ndarray, z: np.ndarray, y: np.ndarray, held: np.ndarray, px: np.ndarray, pz: np.ndarray) -> Model:
    """``held`` rows calibrate and weigh the views; the others and pseudo-labelled rows of the pool (px, pz) fit them."""
    for part in (y[held], y[~held]):
        if min((part == 0).sum(), (part == 1).sum()) < 5:
            return Model(None, None, None, 0.0)
    own = {"x": (x[~held], y[~held]), "z": (z[~held], y[~held])}
    free = {"x": np.ones(len(px), dtype=bool), "z": np.ones(len(px), dtype=bool)}
    pool = {"x": px, "z": pz}
    base = float(y.mean())
    for _ in range(ROUNDS + 1):
        views = {k: View.fitted(*own[k], 5.0) for k in own}
        if not len(px):
            break
        for k, other in (("x", "z"), ("z", "x")):
            view = views[k]
            view.calibrate(*((x if k == "x" else z)[held], y[held]))
            p = sigmoid(view(pool[k]))
            for label, sure, many in ((1, p, base), (0, 1 - p, 1 - base)):
                best = np.flatnonzero((sure >= SURE) & free[other])
                best = best[np.argsort(-sure[best], kind="stable")][: int(PER_ROUND * many) + 1]
                free[other][best] = False
                own[other] = (np.concatenate((own[other][0], pool[other][best])), np.concatenate((own[other][1], np.full(len(best), label))))
    views["x"].calibrate(x[held], y[held])
    views["z"].calibrate(z[held], y[held])
    both = np.column_stack((views["x"](x[held]), views["z"](z[held])))
    mix = fit(both, y[held], 1.0)
    score = sigmoid(logit(both, mix))
    threshold = min(0.5, float(np.quantile(score[y[held] == 1], GOOD_LOST)))
    return Model(views["x"], views["z"], mix, threshold)


def _standard(docs: DataFrame) -> DataFrame:
    have = set(docs.columns)
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return docs.select(*[(F.col(c) if c in have else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits the model; ``labels``: doc_id, quality (1 good, 0 bad; nulls don't count; the least of several counts)."""
    bounded_batches(docs.sparkSession)
    rows = _standard(docs).withColumn("mark", F.xxhash64("doc_id"))
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    n_known = known.count()
    few = smallest(known, F.xxhash64("doc_id"), SAMPLE, n_known, "doc_id").withColumn("role", F.lit(0))
    free = rows.where("doc_id is not null").select("doc_id").join(known, "doc_id", "left_anti")
    pool = smallest(free, F.xxhash64("doc_id"), POOL, max(docs.count() - n_known, 1), "doc_id")
    chosen = few.unionByName(pool.select("doc_id", F.lit(None).cast("int").alias("quality"), F.lit(1).alias("role")))
    # at most SAMPLE + POOL rows of 16 bytes
    sample = rows.join(F.broadcast(chosen), "doc_id").mapInArrow(_features, "role int, quality int, mark long, x array<float>, z array<float>").toArrow()
    if not sample.num_rows:
        return Model(None, None, None, 0.0)
    role, mark = sample["role"].to_numpy(), sample["mark"].to_numpy()
    order = np.argsort(mark, kind="stable")
    role, mark = role[order], mark[order]
    matrix = lambda c: np.asarray(sample[c].combine_chunks().flatten()).reshape(sample.num_rows, -1)[order].astype(float)
    x, z = matrix("x"), matrix("z")
    mine = role == 0
    y = np.array([q if q is not None else -1 for q in sample["quality"].to_pylist()])[order][mine]
    return co_train(x[mine], z[mine], y, mark[mine] % 4 == 0, x[~mine], z[~mine])


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x, z in _views(batch):
                p, t, m = model(x, z)
                yield pa.record_batch([batch["doc_id"].slice(a, b - a), pa.array(p), pa.array(t), pa.array(m), pa.array(p >= model.threshold)], names=["doc_id", "quality_score", "text_score", "page_score", "kept"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, quality_score, text_score, page_score, kept for every row of ``docs``.

    ``docs``: doc_id, text, and lang, source, n_chars if there; missing or null ones are features of their own and a null
    text counts as empty. Repeated rows get a row each. With too few labels of either kind all scores are 0.5 and all
    rows are kept. No rows give no rows.
    """
    model = train(docs, labels)
    return _standard(docs).mapInArrow(_score(model), "doc_id long, quality_score double, text_score double, page_score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier doesn't reject."""
    model = train(docs, labels)
    have = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = pa.table({c: batch[c] if c in have else pa.nulls(batch.num_rows) for c in ("text", "lang", "source", "n_chars")})
            keep = [model(x, z)[0] >= model.threshold for one in full.combine_chunks().to_batches() for _, _, x, z in _views(one)]
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return docs.mapInArrow(run, docs.schema)
