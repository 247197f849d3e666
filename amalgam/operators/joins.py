"""Joins on keys of which some may be hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from amalgam.runtime import cut, small

#: Rows of one key that a task may hold of a side.
CHUNK_ROWS = 5_000


def chunked_join(left: DataFrame, right: DataFrame, key: list[str], left_id: str, right_id: str, chunk_rows: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """The inner join of two tables on ``key``, whole whatever the key's rows.

    A key with more than ``chunk_rows`` rows on a side is hot: its rows of either
    side fall to chunks of about that many by a hash of their ids, and every chunk
    of the left meets every chunk of the right in a task of its own. Hot keys are
    at most rows / chunk_rows. ``counts`` (key, n) spares the count where the rows
    of the right are known and a key has few of the left. Null keys join nothing.
    Other columns must differ between the sides."""
    rows = chunk_rows or CHUNK_ROWS
    if counts is None:
        one, none = F.lit(1), F.lit(0)
        both = left.select(*key, one.alias("_l"), none.alias("_r")).unionAll(right.select(*key, none.alias("_l"), one.alias("_r")))
        sizes = both.groupBy(*key).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r")).filter("_l > 0 AND _r > 0")
    else:
        sizes = counts.select(*key, F.lit(1).alias("_l"), F.col("n").alias("_r"))
    chunks = lambda c: F.ceil(F.col(c) / rows).cast("int")
    hot = cut(sizes.filter((F.col("_l") > rows) | (F.col("_r") > rows)).select(*key, chunks("_l").alias("_cl"), chunks("_r").alias("_cr")))
    few = hot.count()
    if not few:
        return left.join(right, key)
    marks = small(hot, few)

    def spread(side: DataFrame, id_: str, own: str, other: str, at: str, along: str) -> DataFrame:
        every: Column = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return side.join(marks, key).withColumn(at, F.pmod(F.xxhash64(id_), F.col(own)).cast("int")).withColumn(along, every).drop("_cl", "_cr")

    met = spread(left, left_id, "_cl", "_cr", "_i", "_j").join(spread(right, right_id, "_cr", "_cl", "_j", "_i"), [*key, "_i", "_j"]).drop("_i", "_j")
    return left.join(marks, key, "left_anti").join(right.join(marks, key, "left_anti"), key).unionByName(met)
