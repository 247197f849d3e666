"""Fusion: records to candidates, one value per field, conflicts kept.

Everything runs on long tables; no record is a mutable object.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from amalgam.functions.compat import clamp01

# Ranks of provenance for selection, canonical values and upserts.
SELECTION_RANK = {"canonical": 6.0, "verified": 5.0, "discovered": 4.0, "user_provided": 4.0, "identified": 3.0, "inferred": 2.0, "ai_generated": 1.0}
CANONICAL_RANK = {"verified": 4.0, "discovered": 3.0, "user_provided": 3.0, "identified": 2.0, "inferred": 1.0, "ai_generated": 0.5}
UPSERT_RANK = {"verified": 4.0, "discovered": 3.0, "user_provided": 3.0, "identified": 2.0, "inferred": 1.0}
IDENTITY_FIELDS = ["name", "phone", "website", "full_address", "coordinates"]
# Factors by which an observation's confidence follows from its record's.
OBSERVATION_FACTOR = {"name": 0.95, "phone": 0.95, "coordinates": 0.95, "full_address": 0.9, "category": 0.85, "email": 0.8, "website": 0.85, "city": 0.85, "rating": 0.8, "review_count": 0.8}


def rank_of(provenance: Column, table: dict[str, float], default: float = 0.0) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), provenance), F.lit(default))


def unpivot(records: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row (keys, field, value) per field that has a value; '' is none."""
    cells = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]
    return records.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*").filter("value <> ''")


def observations(candidates: DataFrame, confidence: Column) -> DataFrame:
    """Candidates with the confidence their field keeps of the record's."""
    pairs = [F.lit(x) for kv in OBSERVATION_FACTOR.items() for x in kv]
    factor = F.coalesce(F.element_at(F.create_map(*pairs), F.col("field")), F.lit(0.7))
    return candidates.withColumn("confidence", clamp01(confidence * factor))


def best_candidates(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """W1, step (d) of C8: adds status accepted or rejected and the reason; per key
    and field the highest provenance, then confidence, then earliest ``seq``, then
    smallest value is accepted. ``candidates.run_pipeline`` is the whole of C8.

    A maximum of one struct per field, so a field with many candidates is
    combined before the shuffle and never sorted in one task."""
    order = F.struct(rank_of(F.col("provenance"), SELECTION_RANK).alias("p"), F.coalesce("confidence", F.lit(0.0)).alias("c"), (-F.col("seq")).alias("s"))
    best = candidates.groupBy(*keys, "field").agg(F.max(order).alias("best"))
    status = F.when(order == F.col("best"), "accepted").otherwise("rejected")
    return candidates.join(best, [*keys, "field"]).withColumn("status", status).withColumn("reason", F.when(F.col("status") == "rejected", "lower_priority")).drop("best")


def pivot_latest(obs: DataFrame, key: str, fields: list[str], at: str, seq: str) -> DataFrame:
    """The latest value of each field in one row per key; the last wins ties."""
    return obs.groupBy(key).pivot("field", fields).agg(F.max_by("value", F.struct(at, seq)))


def evidence_strength(provenance: Column, authority: Column, confidence: Column) -> Column:
    """M5."""
    return F.lit(0.4) * rank_of(provenance, CANONICAL_RANK, 1.0) + F.lit(0.3) * F.coalesce(authority, F.lit(0.5)) + F.lit(0.3) * F.coalesce(confidence, F.lit(0.5))


def confidence_with_evidence(base: Column, sources: Column, primary: Column, evidence: Column, conflicted: Column) -> Column:
    """M6: clamped after each step."""
    c = clamp01(base + F.when(sources > 1, F.lit(0.1) * F.least(sources, F.lit(3))).otherwise(0.0))
    c = clamp01(c + F.when(primary, 0.05).otherwise(0.0))
    c = clamp01(c + F.when(evidence > 1, F.lit(0.05) * F.least(evidence, F.lit(3))).otherwise(0.0))
    return clamp01(c - F.when(conflicted, 0.15).otherwise(0.0))


def upsert_gate(obs: DataFrame, keys: list[str]) -> DataFrame:
    """W3, C10 without conflicts: a value is replaced by a higher rank, or by the
    same rank with higher confidence. That fold is a maximum, so it needs no
    order: the earliest of the best wins."""
    order = F.struct(rank_of(F.col("provenance"), UPSERT_RANK).alias("r"), F.coalesce("confidence", F.lit(0.0)).alias("c"), (-F.col("seq")).alias("s"))
    return obs.groupBy(*keys).agg(F.max_by("value", order).alias("value"), F.max(order).alias("o"), F.count("*").alias("n_observations")).select(
        *keys, "value", F.col("o.r").alias("tier"), F.col("o.c").alias("confidence"), "n_observations"
    )


def canonical_fold(obs: DataFrame, keys: list[str], identity: Column) -> DataFrame:
    """Folds observations in order of ``seq`` (then value, confidence
    and tier) into the canonical value of a field and counts conflicts.

    Identity fields change only for a strength gain of more than 0.2; descriptive
    fields only if the upsert gate lets them. Observations that can't change the
    result are dropped first, in the JVM. The fold depends on order, so what is left
    of a field streams through one task in batches, sorted by the shuffle, and is
    never held together. Rows without key or value are left out."""
    strength = evidence_strength(F.col("provenance"), F.lit(None).cast("double"), F.col("confidence"))
    ranked = obs.select(
        *keys, "seq", "value", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), rank_of(F.col("provenance"), UPSERT_RANK).alias("tier"), strength.alias("strength"), identity.alias("identity")
    )
    # A value that comes again with no higher tier or confidence than before never changes the result.
    before = W.partitionBy(*keys, "value", "tier").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    fresh = ranked.withColumn("seen", F.max("confidence").over(before)).filter(F.col("seen").isNull() | (F.col("confidence") > F.col("seen")))
    types = dict(obs.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "value string", "tier double", "confidence double", "conflicts int"])
    names = [*keys, "value", "tier", "confidence", "conflicts"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            done = []
            for *key, value, confidence, tier, gain, firm in pdf.itertuples(index=False):
                if key != current:
                    done += [(*current, *state[:4])] if current is not None else []
                    current, state = key, [value, tier, confidence, 0, gain]
                    continue
                differs = value != state[0]
                state[3] += differs
                if gain > state[4] + 0.2 if differs and firm else (tier, confidence) > (state[1], state[2]):
                    state[:3], state[4] = [value, tier, confidence], gain
            if done:
                yield pd.DataFrame(done, columns=names)
        if current is not None:
            yield pd.DataFrame([(*current, *state[:4])], columns=names)

    ordered = fresh.dropna(subset=[*keys, "value"]).repartition(*keys).sortWithinPartitions(*keys, "seq", "value", "confidence", "tier")
    return ordered.select(*keys, "value", "confidence", "tier", "strength", "identity").mapInPandas(fold, schema)


def resolve_conflicts(values: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The winner by authority, recency and confidence; the first wins ties."""
    best = lambda c: F.max_by("value", F.struct(F.coalesce(F.col(c), F.lit(None)), -F.col(seq)))
    return values.groupBy(*keys).agg(
        F.countDistinct("value").alias("n_values"), best("authority").alias("by_authority"), best("observed").alias("by_recency"), best("confidence").alias("by_confidence")
    )


def claims(values: DataFrame, keys: list[str]) -> DataFrame:
    """C14: one claim per key and normalized value with its sources."""
    return values.groupBy(*keys, "value").agg(
        F.count("*").alias("n_observations"), F.countDistinct("source").alias("n_sources"), F.max("confidence").alias("confidence"), F.max(rank_of(F.col("provenance"), CANONICAL_RANK)).alias("tier")
    )


def source_independence(sources: DataFrame, key: str) -> DataFrame:
    """How many sources back a key, how independent they are, how many each
    domain has, and whether they look copied (several sources, one domain). A
    source without domain counts under 'unknown'."""
    per = sources.groupBy(key, F.coalesce("domain", F.lit("unknown")).alias("domain")).agg(F.count("*").alias("n"), F.count_if(F.coalesce("is_primary", F.lit(False))).alias("p"))
    out = per.groupBy(key).agg(
        F.sum("n").alias("total"), F.count("*").alias("domains"), F.sum("p").alias("primaries"), F.map_from_entries(F.collect_list(F.struct("domain", "n"))).alias("histogram")
    )
    return out.withColumn("score", F.least(F.lit(1.0), F.col("primaries") / F.col("total"))).withColumn("copied", (F.col("total") > 1) & (F.col("domains") == 1))
