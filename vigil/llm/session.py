"""Where intermediate tables go and who drops them, joins with very common keys, and how large Arrow batches may be."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.shipping import ship

#: At most so many keys are told to be very common; each has more than that share of the rows.
HEAVY, HEAVY_ROWS = 1000, 500
_scopes: list[list[DataFrame]] = []
_swept: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only on a local master may it be unset: then a temporary one is made, and removed at exit."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = getattr(shared_folder, "own", None)
        if folder is None:
            folder = shared_folder.own = tempfile.mkdtemp(prefix="vigil-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _sweep(spark: SparkSession, path: str) -> None:
    """At exit: what the application stored and no scope dropped. The session may have ended before."""
    with contextlib.suppress(Exception):
        _delete(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: its lineage ends here and any executor can read it.

    The table goes when ``drop`` names it, when the innermost ``scratch`` around this call ends, or else with the application.
    """
    spark = df.sparkSession
    home = f"{shared_folder(spark)}/vigil/{spark.sparkContext.applicationId}"
    if home not in _swept:
        _swept.add(home)
        atexit.register(_sweep, spark, home)
    path = f"{home}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._vigil_path = path
    if _scopes:
        _scopes[-1].append(back)
    return back


def drop(df: DataFrame | None) -> None:
    """Delete what ``stored`` wrote, once nothing reads it any more."""
    path = getattr(df, "_vigil_path", None)
    if path:
        _delete(df.sparkSession, path)
        df._vigil_path = None


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Owns the tables that operators store inside: they are dropped at the end. Results must be read or written before."""
    own: list[DataFrame] = []
    _scopes.append(own)
    try:
        yield
    finally:
        _scopes.remove(own)
        for df in own:
            drop(df)


def keep(df: DataFrame) -> DataFrame:
    """A stored table that outlives the scope it was stored in, for the one around it."""
    if _scopes:
        _scopes[-1].remove(df)
    if len(_scopes) > 1:
        _scopes[-2].append(df)
    return df


def heavy_keys(counts: DataFrame, keys: list[str], rows: int) -> DataFrame | None:
    """Those of ``counts`` (keys, n) that hold more than a ``HEAVY``-th of ``rows`` rows, so ``HEAVY`` of them at most."""
    found = counts.where(F.col("n") > max(rows // HEAVY, HEAVY_ROWS)).select(*keys)
    own = found.collect()
    return counts.sparkSession.createDataFrame(own, found.schema) if own else None


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], heavy: DataFrame | None) -> DataFrame:
    """Inner join of ``big`` with ``small`` (few rows a key). Rows of heavy keys aren't shuffled: their part of ``small``, of at most ``HEAVY`` keys, is broadcast."""
    if heavy is None:
        return big.join(small, keys)
    some = F.broadcast(heavy)
    rest = big.join(some, keys, "left_anti").join(small.join(some, keys, "left_anti"), keys)
    return rest.unionByName(big.join(F.broadcast(small.join(some, keys)), keys))


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows and 16 MB, so that a worker's memory doesn't grow with the length of texts."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)


def smallest(df: DataFrame, by: Column, limit: int, rows: int, *ties: str) -> DataFrame:
    """The ``limit`` rows of the smallest ``by`` (an even 64-bit hash), of about ``rows`` rows.

    Rows that can't be among them are dropped where they are read: about twice as many as asked for are sorted, however
    many there are. A sample may come out smaller if hashes are uneven, as where one row is repeated often.
    """
    return near_smallest(df, by, limit, rows).orderBy("_vigil_place", *ties).limit(limit).drop("_vigil_place")


def near_smallest(df: DataFrame, by: Column, limit: int, rows: int) -> DataFrame:
    """About twice ``limit`` rows, those of ``by`` below a threshold, with _vigil_place to order them by."""
    share = min(1.0, (2 * limit + 1000) / max(rows, 1))
    return df.withColumn("_vigil_place", F.shiftrightunsigned(by, 1)).where(F.col("_vigil_place") <= min(int(share * (1 << 62)) * 2, (1 << 63) - 1))
