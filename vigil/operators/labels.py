"""Labels, sampling, planning and fault injection on ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "recording_id"


def onsets(active: Column, order: str = "seq", key: str = KEY) -> Column:
    """Active here and not in the row before."""
    return active & ~F.coalesce(F.lag(active).over(Window.partitionBy(key).orderBy(order)), F.lit(False))


def horizon_labels(rows: DataFrame, horizon_ms: int, order: str = "seq", key: str = KEY) -> DataFrame:
    """Adds label: 2 where active, 1 up to ``horizon_ms`` before an onset, else 0."""
    marked = rows.withColumn("onset", onsets(F.col("active"), order, key))
    # later rows come first in descending order, so the minimum runs along and no frame is computed anew
    ahead = Window.partitionBy(key).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    soon = F.min(F.when(F.col("onset"), F.col("ts_ms"))).over(ahead) - F.col("ts_ms")
    return marked.withColumn("label", F.when(F.col("active"), 2).when(soon <= horizon_ms, 1).otherwise(0))


def stratified_even_sample(rows: DataFrame, limit: int, label: str = "label", order: str = "seq") -> DataFrame:
    """At most ``limit`` rows, each label in proportion but at least once, evenly spaced in order.

    Shares are rounded down; what is left goes, one by one, to the label with the most rows not yet taken, and what is
    over comes off the largest share. The allocation table has a row per label.
    """
    counts = sorted((r[label], r["n"]) for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in counts)
    if limit <= 0 or total <= limit:
        return rows
    share = {x: max(1, limit * n // total) for x, n in counts}
    room = dict(counts)
    while sum(share.values()) > limit and max(share.values()) > 1:
        share[max(share, key=lambda x: (share[x], -counts.index((x, room[x]))))] -= 1
    while sum(share.values()) < limit:
        share[max(share, key=lambda x: (room[x] - share[x], -counts.index((x, room[x]))))] += 1
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(x, n, share[x]) for x, n in counts], f"{label} {dict(rows.dtypes)[label]}, total long, amount long")
    place = F.row_number().over(Window.partitionBy(label).orderBy(order)) - 1
    numbered = rows.withColumn("place", place).join(wanted, label)
    # row p is taken if it is the whole part of k * (total - 1) / (amount - 1) for some k below amount
    step = (F.col("total") - 1).cast("double") / F.greatest(F.col("amount") - 1, F.lit(1))
    k = F.ceil(F.col("place") / step)
    taken = (F.col("amount") >= F.col("total")) | ((k < F.col("amount")) & (F.floor(k * step) == F.col("place")))
    return numbered.where(taken).drop("place", "total", "amount")


def largest_remainder(groups: DataFrame, limit: int, key: str, size: str = "n") -> DataFrame:
    """(key, allocated): whole parts of proportional shares, the rest by largest remainder, no group beyond its size."""
    shares = groups.withColumn("total", F.sum(size).over(Window.partitionBy()))
    share = F.col(size) * F.lit(limit).cast("double") / F.col("total")
    shares = shares.withColumn("base", F.floor(share)).withColumn("rest", share - F.floor(share))
    w = Window.partitionBy()
    shares = shares.withColumn("left", limit - F.sum("base").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("rest"), key)))
    extra = F.when(F.col("rank") <= F.col("left"), 1).otherwise(0)
    return shares.select(key, F.when(F.col("total") <= limit, F.col(size)).otherwise(F.col("base") + extra).cast("long").alias("allocated"))


def downsample(rows: DataFrame, most: int, order: str = "seq", key: str = KEY) -> DataFrame:
    """Every k-th row of a recording, k being the least that leaves at most ``most``."""
    w = Window.partitionBy(key)
    place = F.row_number().over(w.orderBy(order)) - 1
    counted = rows.withColumn("place", place).withColumn("total", F.count("*").over(w))
    return counted.where(F.col("place") % F.ceil(F.col("total") / most) == 0).drop("place", "total")


def bounded_sample(rows: DataFrame, capacity: int, seed: int, order: str = "seq", key: str = KEY) -> DataFrame:
    """At most ``capacity`` rows of each recording, the ones of the smallest hashes; all of them where there are no more."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(F.col(key), F.col(order), F.lit(seed))))
    return rows.withColumn("rank", rank).where(F.col("rank") <= capacity).drop("rank")


def lpt_plan(jobs: list[tuple[str, int]], batches: int) -> list[tuple[str, int]]:
    """(job, batch): jobs in descending weight go to the lightest batch, the lowest numbered of equals. A plan has as many jobs as files."""
    loads = [0] * batches
    out = []
    for name, weight in sorted(jobs, key=lambda j: (-j[1], j[0])):
        b = loads.index(min(loads))
        loads[b] += weight
        out.append((name, b))
    return out


def inject(rows: DataFrame, kind: str, onset: Column, severity: float, pre: int = 0, seed: int = 0) -> DataFrame:
    """Adds faulty and label (0 healthy, 1 within ``pre`` samples before the onset, 2 from it on) to (recording_id, seq, x).

    ``onset``: number of healthy samples of the recording; seq starts at 1.
    """
    w = Window.partitionBy(KEY).orderBy("seq")
    after = F.col("seq") > onset
    i = F.col("seq") - onset - 1
    n = F.count("*").over(Window.partitionBy(KEY))
    stuck = F.max(F.when(F.col("seq") == onset, F.col("x"))).over(Window.partitionBy(KEY))
    x = F.col("x")
    if kind == "bias_offset":
        y = x + severity
    elif kind == "drift":
        y = x + F.when(n - onset > 1, severity * i / (n - onset - 1)).otherwise(0.0)
    elif kind == "noise_increase":
        # two uniform hashes make a normal value (Box and Muller), the same whenever it is computed
        u = [(F.pmod(F.xxhash64(KEY, "seq", F.lit(seed + k)), F.lit(1 << 52)) + 0.5) / float(1 << 52) for k in (0, 1)]
        y = x + severity * F.sqrt(-2 * F.log(u[0])) * F.cos(2 * F.pi() * u[1])
    elif kind == "dropout":
        period = max(1, int(severity))
        y = F.when(i % period < max(1, period // 4), 0.0).otherwise(x)
    elif kind == "stuck_at":
        y = stuck
    elif kind == "latency":
        delay = int(severity)
        y = F.when(onset + delay >= n, x).when(i < delay, stuck).otherwise(F.lag("x", delay).over(w)) if delay else x
    elif kind == "saturation":
        clip = severity * F.expr("percentile(h, 0.95)").over(Window.partitionBy(KEY))
        y = F.greatest(F.least(x, clip), -clip)
        rows = rows.withColumn("h", F.when(F.col("seq") <= onset, F.abs("x")))
    elif kind == "calibration_shift":
        y = x * severity
    else:
        raise ValueError(f"no fault of kind {kind}")
    label = F.when(after, 2).when(F.col("seq") > onset - pre, 1).otherwise(0)
    out = rows.withColumn("faulty", F.when(after, y).otherwise(x)).withColumn("label", label)
    return out.drop("h")
