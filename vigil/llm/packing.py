"""Cost-balanced packing of tokenised documents into training sequences.

A piece of L ids costs ``LINEAR * L + QUADRATIC * L**2``: its matrix products and its own attention. Documents go in
descending cost to the sequence of the lowest cost so far that still holds them; one that fits nowhere whole is cut at
the room left in the lowest-cost sequence, and its rest takes its place among what is still to assign. So each batch
of documents fills just as many sequences as its ids need, and their costs stay close.

Every task packs the documents of its own input split, some ``GROUP_TOKENS`` ids at a time: nothing is shuffled, a
task holds one group, and a lost task gives the same rows again. A group's last, partly filled sequence is opened
as sequences of the powers of two that make up its length, which need no padding.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.session import bounded_batches

CAPACITY = 4096
END_ID = 2
GROUP_TOKENS = 1 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
_CACHE_WORDS = 1_000_000
_BLANKS = "\n\t\r\x0b\x0c"
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in _SCHEMA.split(", ")])


class WordTokens(dict):
    """Ids of texts by a tokenizer whose words never reach over white space.

    The ids of a text are those of its white-space-separated words, joined; those of the first ``_CACHE_WORDS`` words met
    are kept. A word of plain letters, or such a word and a run of plain marks, goes straight to the model, in lower case
    and with its bytes as the characters that stand for them; any other goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.raw = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        #: Runs of marks met after words.
        self.marks: dict[str, bytes] = {}
        self.direct = self._same_as_model()
        self[""] = b""

    def _bytes(self, ids: list[int]) -> bytes:
        raw = self.raw
        return b"".join([raw[i] for i in ids])

    def _same_as_model(self) -> bool:
        probe = ["A", "Straße", "États", "nguyễn", "word", "ÿ", "þorn", "niño", "x.", "Ü!!", "mañana$$$", "c'est"]
        return all(self._encode(w) == self._through(w) for w in probe)

    def _through(self, word: str) -> bytes:
        return self._bytes(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _encode(self, word: str) -> bytes:
        m = _PLAIN.fullmatch(word)
        if not m:
            return self._through(word)
        letters, marks = m.groups()
        letters = letters.lower()
        model = self.model.tokenize
        out = self._bytes([t.id for t in model(letters if letters.isascii() else letters.translate(_AS_BYTES))])
        if marks:
            if marks not in self.marks:
                self.marks[marks] = self._bytes([t.id for t in model(marks)])
            out += self.marks[marks]
        return out

    def __missing__(self, word: str) -> bytes:
        out = self._encode(word) if self.direct else self._through(word)
        if len(self) < _CACHE_WORDS:
            self[word] = out
        return out

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column, one after another, and the place where each text's begin and end.

        Arrow finds the different words of the batch; only these are looked up, and their ids are then copied to where
        the words stand.
        """
        column = pc.fill_null(column.cast(pa.large_string()), "")
        for c in _BLANKS:
            column = pc.replace_substring(column, c, " ")
        split = pc.split_pattern(column, " ")
        words = pc.dictionary_encode(split.flatten())
        ids = [self[w] for w in words.dictionary.to_pylist()]
        size = np.array([len(x) // 4 for x in ids], dtype=np.int64)
        start = np.concatenate(([0], np.cumsum(size)))
        joined = np.frombuffer(b"".join(ids), dtype="<u4")
        at = words.indices.to_numpy(zero_copy_only=False)
        n = size[at]
        ends = np.concatenate(([0], np.cumsum(n)))
        place = np.repeat(start[at] - ends[:-1], n) + np.arange(ends[-1])
        cuts = np.asarray(split.offsets)
        return joined[place], ends[cuts - cuts[0]]

    def text(self, text: str) -> bytes:
        """Ids of one text as little-endian unsigned 32-bit integers."""
        return self.batch(pa.array([text], pa.large_string()))[0].tobytes()


def _stand_ins() -> dict[int, str]:
    """For letters of two bytes, the characters that byte-level tokenizers write for them: printable Latin-1 bytes stand for themselves, others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    of = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}
    return {c: "".join(of[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:$%&*#|()/-]*)")
_AS_BYTES = _stand_ins()


def cost(length: int) -> float:
    return LINEAR * length + QUADRATIC * length * length


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of pieces of documents with the given numbers of ids; each id is in one piece."""
    total = sum(lengths)
    rooms = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if total % capacity >> b & 1]
    n = len(rooms)
    room, used = np.array(rooms, dtype=np.int64), np.zeros(n)
    filled = np.zeros(n, dtype=np.int64)
    todo = [(-x, i, 0) for i, x in enumerate(lengths) if x]
    heapq.heapify(todo)
    out = []
    while todo:
        rest, doc, start = heapq.heappop(todo)
        fits = room >= -rest
        if fits.any():
            s, take = int(np.argmin(np.where(fits, used, np.inf))), -rest
        else:
            s = int(np.argmin(np.where(room > 0, used, np.inf)))
            take = int(room[s])
            heapq.heappush(todo, (rest + take, doc, start + take))
        out.append((doc, start, take, s, int(filled[s])))
        room[s] -= take
        filled[s] += take
        used[s] += cost(take)
    return out


#: Of a Python worker; its later tasks find the words of earlier ones.
_encoders: dict[str, WordTokens] = {}


def encoder(path: str) -> WordTokens:
    if path not in _encoders:
        _encoders[path] = WordTokens(path)
    return _encoders[path]


def _pack(path: str, capacity: int, group_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 33
        end = np.array([END_ID], dtype="<u4").tobytes()
        ids, docs, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal base
            rows = pack([len(x) // 4 for x in docs], capacity)
            columns = [[] for _ in _ARROW]
            for d, start, length, s, offset in rows:
                row = (ids[d], start, length, zlib.crc32(docs[d][4 * start : 4 * (start + length)]), len(docs[d]) // 4, base + s, offset)
                for c, x in zip(columns, row, strict=True):
                    c.append(x)
            base += max(r[3] for r in rows) + 1
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], schema=_ARROW)

        for batch in batches:
            found, cuts = encode.batch(batch["text"])
            for i, a, b in zip(batch["doc_id"].to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                ids.append(i)
                docs.append(found[a:b].tobytes() + end)
                size += b - a + 1
                if size >= group_tokens:
                    yield flush()
                    ids, docs, size = [], [], 0
        if docs:
            yield flush()

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``docs``: doc_id, text; more columns are ignored. A null text counts as empty; an empty text is its end mark alone.
    Repeated rows are packed each; a null doc_id stays null. A document longer than a sequence is cut. No rows give no
    rows. ``tokenizer_path`` is a word-level BPE file that every executor can read.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_pack(tokenizer_path, capacity, group_tokens), _SCHEMA)
