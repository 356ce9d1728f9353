"""Which jobs count: those complete in every variant, keys common to all groups, and a fingerprint of what was read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def complete_jobs(jobs: DataFrame, variants: list[DataFrame], key: str) -> DataFrame:
    """The rows of ``jobs`` whose key stands in every variant, in any number of rows. Null keys stand in none."""
    for v in variants:
        jobs = jobs.join(v.select(key), key, "left_semi")
    return jobs


def common_keys(rows: DataFrame, group: str, key: str) -> DataFrame:
    """The keys that stand in every group. Null keys and null groups don't count; no rows give no keys."""
    pairs = rows.select(group, key).where(F.col(group).isNotNull() & F.col(key).isNotNull()).distinct()
    groups = pairs.select(group).distinct().agg(F.count("*").alias("groups"))
    # the number of groups is one row
    return pairs.groupBy(key).agg(F.count("*").alias("n")).join(F.broadcast(groups), F.col("n") == F.col("groups")).select(key)


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """One row, n and fingerprint: a SHA-256 that any change, loss or repeat of a row changes, and no order of rows.

    The rows' own digests are gathered by their first three digits, so that no task holds more than a 4096th of them;
    the digests of these parts, in order, give the fingerprint. Nulls count as the text \\N; no rows give the digest of nothing.
    """
    own = F.sha2(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]), 256)
    parts = rows.select(own.alias("h")).groupBy(F.substring("h", 1, 3).alias("part")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"])
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.array_join(whole, ""), 256).alias("fingerprint"))


def record_count(counted: Column, size: Column, width: Column) -> Column:
    """The count on record, else as many whole records of ``width`` bytes as the size holds."""
    return F.coalesce(counted, F.floor(size / width))
