"""Versioned tables: idempotent inserts, upserts, merges of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Per key the row with the latest ``at``; a new row wins ties."""
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, "_new")).alias("r"))
    return newest.select(*keys, "r.*").select(*old.columns)


def insert_once(queue: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Items whose key the queue does not hold yet, one a key."""
    first = items.groupBy(key).agg(F.first(F.struct(*[c for c in items.columns if c != key])).alias("r")).select(key, "r.*")
    return first.select(*items.columns).join(queue.select(key).distinct(), key, "left_anti")


def fresh(cache: DataFrame, as_of: Column) -> DataFrame:
    """Rows that have not expired; a null expiry never does."""
    return cache.filter(F.col("expires_at").isNull() | (F.col("expires_at") >= as_of))


def merge_entities(identities: DataFrame, entities: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Moves the identities of merged entities (source -> target) and marks
    the sources; observations stay where they are."""
    moved = identities.join(merges.select(F.col("source").alias("entity_id"), "target"), "entity_id", "left")
    moved = moved.withColumn("entity_id", F.coalesce("target", "entity_id")).drop("target").select(*identities.columns)
    gone = merges.select(F.col("source").alias("entity_id"), F.lit(True).alias("_gone")).distinct()
    marked = entities.join(gone, "entity_id", "left").withColumn("status", F.when(F.col("_gone"), "MERGED").otherwise(F.col("status"))).drop("_gone")
    return moved, marked.select(*entities.columns)


def relocate(entities: DataFrame, moves: DataFrame) -> DataFrame:
    """The new address of moved entities."""
    out = entities.join(moves.select("entity_id", "new_address"), "entity_id", "left")
    return out.withColumn("canonical_address", F.coalesce("new_address", "canonical_address")).select(*entities.columns)


def assign_entities(records: DataFrame, identities: DataFrame) -> DataFrame:
    """Records keep a known entity; others get a provisional id, a hash of
    their natural key, so that a second run gives the same."""
    known = identities.filter("entity_id IS NOT NULL").groupBy("provider", "provider_record_id").agg(F.min("entity_id").alias("entity_id"))
    provisional = F.concat(F.lit("prov-"), F.substring(F.sha2(F.concat_ws("|", "provider", "provider_record_id"), 256), 1, 16))
    keys = records.select("provider", "provider_record_id").distinct()
    return keys.join(known, ["provider", "provider_record_id"], "left").select(
        "provider", "provider_record_id", F.coalesce("entity_id", provisional).alias("entity_id"), F.col("entity_id").isNull().alias("provisional")
    )
