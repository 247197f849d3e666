"""Ordered calculations per key that stay bounded when one key holds most rows.

A window over a whole key would put all its rows in one task. Here rows are cut
into time slices per key; totals of slices (few rows) are carried over, and the
window runs inside (key, slice) only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from amalgam.runtime import cut


def with_running_sums(df: DataFrame, key: str, order: list[str], slice_: Column, values: dict[str, Column]) -> DataFrame:
    """Adds running sums per key in ``order``, one per name in ``values``, over one
    pass; ``slice_`` must not fall as the order rises. Null values count as 0."""
    df = df.withColumns({"_slice": slice_, **{f"_v_{n}": F.coalesce(v, F.lit(0)) for n, v in values.items()}})
    totals = df.groupBy(key, "_slice").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    earlier = W.partitionBy(key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(key, "_slice", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in values])
    inside = W.partitionBy(key, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = df.join(before, [key, "_slice"]).withColumns({n: F.col(f"_b_{n}") + F.sum(f"_v_{n}").over(inside) for n in values})
    return out.drop("_slice", *[f"_{p}_{n}" for n in values for p in "vb"])


def with_running_sum(df: DataFrame, key: str, order: list[str], slice_: Column, value: Column, name: str) -> DataFrame:
    """Adds the running sum of ``value`` per key in ``order``."""
    return with_running_sums(df, key, order, slice_, {name: value})


def with_rank(df: DataFrame, key: str, order: list[str], slice_: Column, name: str) -> DataFrame:
    """Adds the rank (from 1) of each row within its key."""
    return with_running_sum(df, key, order, slice_, F.lit(1), name)


def streaks(df: DataFrame, key: str, order: list[str], slice_: Column, hit: Column, name: str) -> DataFrame:
    """Length of the run of hits that ends at each row, 0 where it is no hit:
    the row's rank less the rank of the last miss. Both are carried from slice to
    slice, so a key that only hits is no more one task than any other."""
    ranked = with_rank(df.withColumn("_hit", F.coalesce(hit, F.lit(False))), key, order, slice_, "_rank").withColumn("_slice", slice_)
    missed = F.when(~F.col("_hit"), F.col("_rank"))
    tops = ranked.groupBy(key, "_slice").agg(F.max(missed).alias("_top"))
    carried = tops.select(key, "_slice", F.max("_top").over(W.partitionBy(key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)).alias("_carried"))
    inside = F.max(missed).over(W.partitionBy(key, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    out = ranked.join(carried, [key, "_slice"]).withColumn("_last", F.coalesce(inside, F.col("_carried"), F.lit(0)))
    return out.withColumn(name, F.when(F.col("_hit"), F.col("_rank") - F.col("_last")).otherwise(0)).drop("_hit", "_rank", "_slice", "_carried", "_last")


def nearest_rank(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles of ``value`` per key: the value at rank
    ceil(share * n), at least 1. Null values are left out.

    Different values are counted first, then range-sorted over all tasks; what
    stands before a task's part is carried over, so no task holds a key's values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    placed = cut(counts.orderBy(key, value).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy(key, "_part").agg(F.sum("_n").alias("_sum"))
    carried = totals.select(
        key, "_part", (F.sum("_sum").over(W.partitionBy(key).orderBy("_part")) - F.col("_sum")).alias("_before"), F.sum("_sum").over(W.partitionBy(key)).alias("_all")
    )  # one row a key and task
    rank = F.col("_before") + F.sum("_n").over(W.partitionBy(key, "_part").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    ranked = placed.join(carried, [key, "_part"]).withColumn("_rank", rank)
    at = lambda p: F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("_all")))
    return ranked.groupBy(key).agg(*[F.min(F.when(F.col("_rank") >= at(p), F.col(value))).alias(name) for name, p in shares.items()])


def rolling_percentiles(df: DataFrame, key: str, order: list[str], slice_: Column, value: str, n: int, shares: dict[str, float], block: int = 4096) -> DataFrame:
    """Nearest-rank percentiles of the last ``n`` values per key, after each row.

    Ranks are cut into blocks; the last n-1 rows of a block also go to the next,
    so that each block is a partition of bounded size."""
    ranked = with_rank(df, key, order, slice_, "_rank").withColumn("_block", F.floor((F.col("_rank") - 1) / block))
    follows = F.col("_rank") > (F.col("_block") + 1) * block - (n - 1)
    spread = ranked.withColumn("_at", F.explode(F.when(follows, F.array("_block", F.col("_block") + 1)).otherwise(F.array("_block"))))
    last = F.sort_array(F.collect_list(value).over(W.partitionBy(key, "_at").orderBy("_rank").rowsBetween(-(n - 1), 0)))
    out = spread.withColumn("_last", last).filter(F.col("_at") == F.col("_block"))
    picked = {name: F.get("_last", F.greatest(F.lit(0), F.ceil(F.lit(p) * F.size("_last")) - 1).cast("int")) for name, p in shares.items()}
    return out.withColumns(picked).drop("_rank", "_block", "_at", "_last")
