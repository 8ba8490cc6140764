"""Joins beyond equality: as-of, range and interval joins in forms that shuffle by key or bucket, never cross."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a key and time bucket at about which the time is cut finer, and buckets a key may have at most.
BUCKET_ROWS, BUCKETS = 100_000, 1 << 20


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, values: list[str], buckets: int | None = None) -> DataFrame:
    """Each left row with the values of the latest right row of its key that isn't later (null: none).

    Both sides go in one stream per key and time bucket, in order of time; a right row at the same time comes first. A
    bucket without an earlier mark of its own takes the last mark of the key's buckets before it, found by a window
    over one row a bucket. So a key that holds a third of all rows is spread over the buckets that it reaches.
    buckets: parts of equal length that the time is cut in; by default as many as the rows ask for. A null key or time
    meets nothing; of right rows at the same time any one counts."""
    if buckets is None:
        buckets = max(1, min(BUCKETS, left.count() // BUCKET_ROWS))
    one = F.lit(0).cast("bigint")
    if buckets > 1:
        ends = left.select(_number(left, at).alias("x")).agg(F.min("x").alias("low"), F.max("x").alias("high")).first()
        width = ((ends["high"] or 0) - (ends["low"] or 0)) / buckets
        if width > 0:
            bucket = lambda df: F.greatest(F.lit(-1), F.least(F.lit(buckets), F.floor((_number(df, at) - F.lit(float(ends["low"]))) / F.lit(float(width))))).cast("bigint")
        else:
            bucket = lambda df: one
    else:
        bucket = lambda df: one
    rows = left.select(F.col(by).alias("_k"), F.col(at).alias("_t"), bucket(left).alias("_b"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    marks = right.where(F.col(by).isNotNull() & F.col(at).isNotNull()).select(F.col(by).alias("_k"), F.col(at).alias("_t"), bucket(right).alias("_b"), F.lit(0).alias("_side"), F.struct(*[F.col(v) for v in values]).alias("_m"))
    w = Window.partitionBy("_k", "_b").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.unionByName(marks, allowMissingColumns=True).withColumn("_m", F.last("_m", ignorenulls=True).over(w)).where("_side = 1")
    if buckets > 1:
        last = marks.groupBy("_k", "_b").agg(F.max_by("_m", "_t").alias("_before"))
        held = rows.where("_k IS NOT NULL AND _t IS NOT NULL").select("_k", "_b").distinct()
        before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        carried = held.join(last, ["_k", "_b"], "full").withColumn("_before", F.last("_before", ignorenulls=True).over(before)).where("_before IS NOT NULL")
        met = met.join(carried, ["_k", "_b"], "left").withColumn("_m", F.coalesce("_m", "_before"))
    known = F.col("_k").isNotNull() & F.col("_t").isNotNull()
    return met.select("_row.*", *[F.when(known, F.col(f"_m.{v}")).alias(v) for v in values])


def _number(df: DataFrame, at: str) -> Column:
    kind = df.schema[at].dataType.simpleString()
    x = F.col(at)
    return (F.unix_micros(x.cast("timestamp")) if kind in ("timestamp", "timestamp_ntz", "date") else x).cast("double")


def in_range(points: DataFrame, at: str, ranges: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Points with the ranges that hold them (both ends belong): equality on buckets of `width`, then the exact test."""
    p = points.withColumn("_bucket", F.floor(F.col(at) / width))
    r = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, "_bucket").where((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("_bucket")
