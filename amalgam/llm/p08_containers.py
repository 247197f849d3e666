"""Filling fixed-capacity containers with items.

1. Lengths are counted to one global histogram (at most capacity + 1 numbers).
2. Dynamic programming over it chooses the bucket boundaries of least padding.
3. Items go to shards of a bounded number of items by a hash, so that no bucket
   is ever one task. In a shard, token-budget batches form inside each bucket,
   from the longest bucket down; the space a batch leaves is topped up with the
   longest items that still fit, from its own bucket and then the shorter ones.

An item longer than the capacity is split: its full pieces are containers of
their own and the rest is an item like any other.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from amalgam.llm.tokens import TOKENIZER, with_token_counts
from amalgam.runtime import cut, load

N_BUCKETS, SHARD_ITEMS, SEED = 24, 20_000, 17
_ITEMS = "array<struct<doc_id: long, token_from: long, token_to: long>>"
_RESULT = f"container_name string, container_id long, capacity_tokens int, used_tokens long, n_items int, items {_ITEMS}"


def bucket_boundaries(histogram: dict[int, int], n_buckets: int = N_BUCKETS) -> list[int]:
    """Upper lengths of at most ``n_buckets`` buckets for which the sum of
    (upper length - length) over all items is least."""
    lengths = np.array(sorted(histogram), dtype=np.float64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(x)] for x in lengths], dtype=np.float64)
    n, b = len(lengths), min(n_buckets, len(lengths))
    number = np.concatenate(([0.0], np.cumsum(counts)))
    tokens = np.concatenate(([0.0], np.cumsum(counts * lengths)))
    best = np.full((b + 1, n + 1), np.inf)
    best[0, 0] = 0.0
    choice = np.zeros((b + 1, n + 1), dtype=np.int64)
    for hi in range(1, n + 1):
        # padding of one bucket (lo, hi] for all lo at once, for all numbers of buckets at once
        padding = lengths[hi - 1] * (number[hi] - number[:hi]) - (tokens[hi] - tokens[:hi])
        cost = best[:-1, :hi] + padding
        choice[1:, hi] = cost.argmin(axis=1)
        best[1:, hi] = cost.min(axis=1)
    k, at, out = int(best[:, n].argmin()), n, []
    while at > 0:
        out.append(int(lengths[at - 1]))
        at, k = int(choice[k, at]), k - 1
    return out[::-1]


def fill(lengths: Sequence[int], capacity: int, boundaries: Sequence[int]) -> list[list[int]]:
    """Containers as lists of item indexes. Items have at most ``capacity`` tokens;
    those without tokens go with the last container."""
    waiting: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        waiting.setdefault(int(n), []).append(i)
    nothing = waiting.pop(0, [])
    left = sorted(waiting)

    def take(most: int) -> tuple[int, int] | None:
        at = bisect.bisect_right(left, most) - 1
        if at < 0:
            return None
        n = left[at]
        item = waiting[n].pop()
        if not waiting[n]:
            del left[at]
        return n, item

    out: list[list[int]] = []
    low = [0, *boundaries]
    for lower, upper in reversed(list(zip(low, boundaries))):
        while left and left[-1] > lower:
            room, batch = capacity, []
            for _ in range(max(1, capacity // upper)):  # the batch of this bucket
                if not left or left[-1] <= lower or (got := take(min(room, upper))) is None:
                    break
                if got[0] <= lower:  # nothing of the bucket fits any more: this tops up
                    room -= got[0]
                    batch.append(got[1])
                    break
                room -= got[0]
                batch.append(got[1])
            while room and (got := take(room)):
                room -= got[0]
                batch.append(got[1])
            out.append(batch)
    if nothing:
        out = out or [[]]
        out[-1].extend(nothing)
    return out


def _packer(capacity: int, name: str, boundaries: list[int]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "token_from"], kind="stable", na_position="last")
        length = (pdf["token_to"] - pdf["token_from"]).tolist()
        rows = list(zip(pdf["doc_id"].tolist(), pdf["token_from"].tolist(), pdf["token_to"].tolist()))
        shard = int(pdf["shard"].iloc[0])
        out = []
        for i, batch in enumerate(fill(length, capacity, boundaries)):
            items = [{"doc_id": rows[j][0], "token_from": rows[j][1], "token_to": rows[j][2]} for j in batch]
            used = sum(length[j] for j in batch)
            out.append((name, (shard << 24) + i, capacity, used, len(batch), items))
        return pd.DataFrame(
            out, columns=["container_name", "container_id", "capacity_tokens", "used_tokens", "n_items", "items"]
        )

    return pack


def fill_containers(
    sized: DataFrame,
    containers: Sequence[tuple[str, int]],
    n_buckets: int = N_BUCKETS,
    shard_items: int = SHARD_ITEMS,
    seed: int = SEED,
) -> DataFrame:
    """Containers with their items, for each (name, capacity) of ``containers``.

    ``sized`` has doc_id (int64) and n_tokens (int64); other columns are
    ignored. Every row is an item and stands in exactly one container of each
    kind, or as consecutive pieces [token_from, token_to) if it exceeds the
    capacity. Rows without tokens (null or empty text) take no space and go with
    another container of their shard; rows without doc_id are left out; repeated
    rows are items of their own. An empty table gives no containers; containers
    of null or no capacity are ignored.
    """
    items = cut(
        sized.filter(F.col("doc_id").isNotNull()).select(
            F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n")
        )
    )
    parts = []
    for name, capacity in containers:
        if not capacity or capacity < 1:
            continue
        rest = F.col("n") % capacity
        # What remains of an item after its full pieces; an item of just the capacity is a full piece.
        loose = items.filter((F.col("n") == 0) | (rest > 0)).select(
            "doc_id", (F.col("n") - rest).alias("token_from"), F.col("n").alias("token_to")
        )
        length = F.col("token_to") - F.col("token_from")
        histogram = {r["length"]: r["count"] for r in loose.groupBy(length.alias("length")).count().collect()}
        shards = max(1, -(-sum(histogram.values()) // shard_items))
        boundaries = bucket_boundaries({k: v for k, v in histogram.items() if k > 0}, n_buckets)
        packed = (
            loose.withColumn("shard", F.pmod(F.xxhash64("doc_id", "token_from", F.lit(seed)), F.lit(shards)))
            .groupBy("shard")
            .applyInPandas(_packer(capacity, name, boundaries), _RESULT)
        )
        full = items.filter(F.col("n") >= capacity).select(
            "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / capacity) - 1)).alias("piece")
        )
        piece = F.struct(
            "doc_id",
            (F.col("piece") * capacity).cast("long").alias("token_from"),
            ((F.col("piece") + 1) * capacity).cast("long").alias("token_to"),
        )
        parts.append(packed)
        parts.append(
            full.select(
                F.lit(name).alias("container_name"),
                # negative ids: they never meet those of the shards
                (-F.monotonically_increasing_id() - 1).alias("container_id"),
                F.lit(capacity).alias("capacity_tokens"),
                F.lit(capacity).cast("long").alias("used_tokens"),
                F.lit(1).alias("n_items"),
                F.array(piece).alias("items"),
            )
        )
    if not parts:
        return sized.sparkSession.createDataFrame([], _RESULT)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _containers(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    spec = load(spark, sf_dir, "container_spec").select("container_name", "capacity_tokens")
    return [(r[0], r[1]) for r in spec.orderBy("container_name").collect()]  # a fixed table of three rows


def p8_containers(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    filled = fill_containers(with_token_counts(docs, "text", tokenizer), _containers(spark, sf_dir))
    return filled.withColumn("doc_ids", F.col("items.doc_id"))


def p8_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind of container, what must hold of any filling: documents placed,
    those not whole (their pieces don't join up) and containers overfull."""
    filled = p8_containers(spark, sf_dir).select("container_name", "capacity_tokens", "used_tokens", F.explode("items").alias("i"))
    docs = filled.groupBy("container_name", "i.doc_id").agg(
        F.min("i.token_from").alias("first"), F.max("i.token_to").alias("last"), F.sum(F.col("i.token_to") - F.col("i.token_from")).alias("tokens"),
        F.max((F.col("used_tokens") > F.col("capacity_tokens")).cast("int")).alias("over"),
    )
    broken = (F.col("first") != 0) | (F.col("last") != F.col("tokens"))
    return docs.groupBy("container_name").agg(F.count("*").alias("documents"), F.count_if(broken).alias("not_whole"), F.sum("over").alias("in_overfull"))


def p8_space_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind of container: how many there are and the share of space used."""
    return (
        p8_containers(spark, sf_dir)
        .groupBy("container_name", "capacity_tokens")
        .agg(
            F.count("*").alias("n_containers"),
            F.sum("used_tokens").alias("tokens"),
            F.round(F.sum("used_tokens") / F.sum("capacity_tokens"), 6).alias("share_used"),
        )
    )


QUERIES = {"p8_containers": p8_containers, "p8_space_used": p8_space_used, "p8_placed": p8_placed}
SQL: dict[str, str] = {
    "p8_placed": "SELECT container_name, count(*) AS documents, 0 AS not_whole, 0 AS in_overfull FROM container_spec CROSS JOIN documents GROUP BY 1",
}
