"""Fixed-width little-endian records: the data source "fixedrec", and the layouts of the timelines.

``spark.dataSource.register(FixedRecords)``, then ``spark.read.format("fixedrec").option("layout", name).load(folder)``
and ``df.write.format("fixedrec").option("layout", name).mode("append").save(folder)``. The folder must be on a file
system that driver and executors share under the same path. Files are read in runs of whole records; a file whose size
is no multiple of the record's width is refused. A task writes its file under another name and the commit renames it,
so readers never see a part of one.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Fields of the records, in order, as (name, NumPy type[, length]).
_TAIL = [("signal", "<f4", 3)]
LAYOUTS = {
    "simple_software": [("timestamp_ms", "<u8"), ("shi", "<f4"), ("feature_distance", "<f4"), ("injected_fraction", "<f4"), ("ground_truth", "<f4", 3), ("observed", "<f4", 3)],
    "simple_hardware": [("timestamp_ms", "<u8"), ("shi", "<f4"), ("feature_distance", "<f4"), *_TAIL],
    "model_prediction": [("timestamp_ms", "<u8"), ("shi_rf", "<f4"), ("shi_xgb", "<f4"), ("ground_truth_label", "u1"), ("scenario", "u1"), ("reserved", "<u2"), *_TAIL],
    "reference": [("timestamp_ms", "<u8"), ("shi", "<f4"), ("mahalanobis_health", "<f4"), ("isolation_health", "<f4"), ("ewma_health", "<f4"), ("event_health", "<f4"), ("flags", "u1"), ("reserved", "u1", 7), *_TAIL],
    "reliability_software": [("timestamp_ms", "<u8"), ("shi", "<f4"), ("raw_distance", "<f4"), ("degradation_score", "<f4"), ("injected_fraction", "<f4"), ("ground_truth", "<f4", 3), ("observed", "<f4", 3)],
    "reliability_hardware": [("timestamp_ms", "<u8"), ("shi", "<f4"), ("raw_distance", "<f4"), ("degradation_score", "<f4"), *_TAIL],
    "fused": [("timestamp_ms", "<u8"), ("shi", "<f4"), ("isolation_health", "<f4"), ("mahalanobis_health", "<f4"), ("ewma_health", "<f4"), ("event_health", "<f4"), ("alarm_threshold", "<f4"), ("flags", "u1"), ("reserved", "u1", 3), *_TAIL],
}
BLOCK_BYTES = 64 << 20


def feature_layout(features: int) -> list[tuple]:
    return [("timestamp_ms", "<u8"), ("label", "u1"), ("scenario", "u1"), ("reserved", "<u2"), ("features", "<f4", features)]


def layout_of(options: dict[str, str]) -> np.dtype:
    name = options.get("layout", "")
    if name.startswith("features:"):
        return np.dtype(feature_layout(int(name.split(":")[1])))
    if name not in LAYOUTS:
        raise ValueError(f"layout must be features:N or one of {', '.join(LAYOUTS)}")
    return np.dtype(LAYOUTS[name])


def ddl(dtype: np.dtype) -> str:
    kinds = {"u8": "long", "f4": "float", "u1": "int", "u2": "int"}
    out = []
    for name in dtype.names:
        field, shape = dtype[name].base, dtype[name].shape
        kind = kinds[field.str.lstrip("<|")]
        out.append(f"{name} {f'array<{kind}>' if shape else kind}")
    return ", ".join(out)


@dataclass
class Run(InputPartition):
    path: str
    offset: int
    size: int


class Reader(DataSourceReader):
    def __init__(self, dtype: np.dtype, path: str):
        self.dtype, self.path = dtype, path

    def partitions(self) -> list[Run]:
        top, width, out = Path(self.path), self.dtype.itemsize, []
        files = [top] if top.is_file() else sorted(p for p in top.rglob("*.bin") if not any(x.startswith((".", "_")) for x in p.relative_to(top).parts))
        for p in files:
            size = p.stat().st_size
            if size % width:
                raise ValueError(f"{p}: {size} bytes is no multiple of {width}")
            step = BLOCK_BYTES // width * width
            out += [Run(str(p), at, min(step, size - at)) for at in range(0, size, step)]
        return out

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        with open(run.path, "rb") as f:
            f.seek(run.offset)
            left = run.size
            while left:
                take = min(left, (4 << 20) // self.dtype.itemsize * self.dtype.itemsize)
                rows = np.frombuffer(f.read(take), dtype=self.dtype)
                left -= take
                columns = []
                for name in self.dtype.names:
                    v = rows[name]
                    kind = pa.int64() if v.dtype.itemsize == 8 else pa.float32() if v.dtype.kind == "f" else pa.int32()
                    if v.ndim == 1:
                        columns.append(pa.array(np.ascontiguousarray(v).astype(kind.to_pandas_dtype())))
                    else:
                        flat = pa.array(np.ascontiguousarray(v).ravel().astype(kind.to_pandas_dtype()))
                        columns.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, v.shape[1], dtype=np.int32)), flat))
                yield pa.record_batch(columns, names=list(self.dtype.names))


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str
    rows: int


class Writer(DataSourceWriter):
    def __init__(self, dtype: np.dtype, path: str, overwrite: bool):
        self.dtype, self.path, self.overwrite, self.run = dtype, path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId() if task else 0:05d}-{self.run}.bin"
        folder = Path(self.path)
        folder.mkdir(parents=True, exist_ok=True)
        temporary = folder / f".{name}.{uuid.uuid4().hex}"
        n = 0
        with open(temporary, "wb") as f:
            block: list[tuple] = []
            for row in iterator:
                block.append(tuple(tuple(x) if isinstance(x, list) else 0 if x is None else x for x in (row[k] for k in self.dtype.names)))
                n += 1
                if len(block) == 10_000:
                    f.write(np.array(block, dtype=self.dtype).tobytes())
                    block = []
            f.write(np.array(block, dtype=self.dtype).tobytes())
            f.flush()
            os.fsync(f.fileno())
        return Written(str(temporary), str(folder / name), n)

    def commit(self, messages: list[Written | None]) -> None:
        if self.overwrite:
            for p in Path(self.path).glob("*.bin"):
                p.unlink()
        for m in messages:
            if m and m.rows:
                os.replace(m.temporary, m.final)
            elif m:
                os.unlink(m.temporary)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and os.path.exists(m.temporary):
                os.unlink(m.temporary)


class FixedRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fixedrec"

    def schema(self) -> str:
        return ddl(layout_of(self.options))

    def reader(self, schema: StructType) -> Reader:
        return Reader(layout_of(self.options), self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(layout_of(self.options), self.options["path"], overwrite)
