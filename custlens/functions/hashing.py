"""Repeatable pseudo-random order of rows by the hash of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

HASH_BITS = 60


def key_hash(key: Column | str) -> Column:
    """First 60 bits of the key's MD5 as a non-negative long: uniform, and the same in any engine."""
    key = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(key.cast("string")), 1, HASH_BITS // 4), 16, 10).cast("long")


def in_sample(key: Column | str, fraction: float) -> Column:
    """Whether a key falls in the sample; the same keys at any partitioning, with no shuffle."""
    return key_hash(key) < F.lit(int(fraction * 2**HASH_BITS))


def split_by_hash(
    df: DataFrame, key: str, label: str, fractions: Sequence[float], out: str, bucket_bits: int = 12
) -> DataFrame:
    """Add ``out`` = 0, 1, ...: parts of exactly ``round(cumulative fraction * n)`` rows within each label.

    Rows are ordered by key hash inside their label. Only the hash buckets that hold a boundary
    are ranked (one in ``2 ** bucket_bits`` of the rows each), which yields one boundary row per
    label and part; the rows themselves are then tagged without a shuffle. ``df`` is read three
    times, so materialise it first. ``label`` must have few levels and ``key`` be unique.
    """
    bounds = [sum(fractions[: i + 1]) for i in range(len(fractions) - 1)]
    hashed = df.select(F.col(label), F.col(key).alias("key"), key_hash(key).alias("hash"))
    hashed = hashed.withColumn("bucket", F.shiftright("hash", HASH_BITS - bucket_bits))
    in_label = W.partitionBy(label)
    sizes = (
        hashed.groupBy(label, "bucket")
        .agg(F.count("*").alias("n"))
        .withColumn("up_to", F.sum("n").over(in_label.orderBy("bucket")))
        .withColumn("total", F.sum("n").over(in_label))
        .withColumn("bound", F.explode(F.array(*(F.lit(b) for b in bounds))))
        .withColumn("size", F.round(F.col("bound") * F.col("total")).cast("long"))
        .where((F.col("size") > F.col("up_to") - F.col("n")) & (F.col("size") <= F.col("up_to")))
        .withColumn("place", F.col("size") - F.col("up_to") + F.col("n"))
    )
    # One row per label and bound at most, hence small enough to broadcast.
    boundaries = (
        hashed.join(F.broadcast(sizes.select(label, "bucket", "bound", "place")), [label, "bucket"])
        .withColumn("rank", F.row_number().over(W.partitionBy(label, "bound").orderBy("hash", "key")))
        .where(F.col("rank") == F.col("place"))
        .groupBy(label)
        .agg(F.collect_list(F.struct("hash", "key")).alias("boundaries"))
    )
    here = F.struct(key_hash(key).alias("hash"), F.col(key).alias("key"))
    passed = F.size(F.filter("boundaries", lambda b: b < here))
    # A label whose first parts are empty (rounded to no row) has fewer boundaries than parts.
    empty = F.lit(len(bounds)) - F.coalesce(F.size("boundaries"), F.lit(0))
    return (
        df.join(F.broadcast(boundaries), label, "left")
        .withColumn(out, (F.coalesce(passed, F.lit(0)) + empty).cast("int"))
        .drop("boundaries")
    )
