"""Mixing sources to target weights.

Every document has a hash-seeded uniform number u. Its number of copies is u put
through the inverse of a Poisson distribution function with the repetition rate
of its source as mean, cut off at the source's cap. The rate is calibrated on
the tokens the draw really gives, not on their expectation: the rate at which a
document gains its j-th copy is known in closed form up to a root, tokens are
counted over a histogram of these rates (a fixed number of bins a source), and
one bin is then resolved by a second histogram. So a heavy-tailed or tiny source
reaches its share to within about one document, and caps hold always.

The size of the mixture is asked for, by default as many tokens as the sources
hold; no source decides it for the others. A source that would need more than
all its documents at its cap gives just that (the limit of the Poisson draw for
a growing mean) and falls short; what it lacks goes to the others in proportion.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from amalgam.llm.tokens import TOKENIZER, with_token_counts
from amalgam.runtime import cut, load, scratched

BINS, SEED = 4096, 29


def source_key(c):
    """Source names in one notation: lower case, everything else an underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def rate_limit(cap: int) -> float:
    """A Poisson mean so great that P(X < cap) is below every u that can occur."""
    return cap + 45.0 + 10.0 * cap**0.5


def rate_of_copy(u: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The Poisson mean at which a document with uniform number ``u`` gets its
    ``j``-th copy: the root of P(X < j) = u, found by bisection."""
    most = int(j.max()) if len(j) else 0
    low, high = np.zeros(len(u)), np.full(len(u), rate_limit(most))
    for _ in range(52):
        mean = (low + high) / 2
        term = np.exp(-mean)
        below = np.zeros(len(u))
        for k in range(most):
            below += np.where(k < j, term, 0.0)
            term = term * mean / (k + 1)
        more = below > u  # the distribution function falls with the mean
        low, high = np.where(more, mean, low), np.where(more, high, mean)
    return high


def _with_rates(sized: DataFrame, seed: int) -> DataFrame:
    """Adds the rates that bring the first, second, ... copy of a document, up to its cap."""

    @F.pandas_udf("array<double>")
    def rates(u: pd.Series, cap: pd.Series) -> pd.Series:
        caps = cap.to_numpy()
        ends = np.cumsum(caps)
        flat = np.arange(ends[-1] if len(ends) else 0)
        copy_no = flat - np.repeat(ends - caps, caps) + 1
        return pd.Series(np.split(rate_of_copy(np.repeat(u.to_numpy(), caps), copy_no), ends[:-1]))

    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return sized.withColumn("rates", rates(uniform, F.col("max_repeats")))


def needs(available: dict[str, float], wanted: dict[str, tuple[float, int]], total: float | None) -> dict[str, float]:
    """Tokens each present source is to give: its share of the total, at most its
    tokens times its cap; what capped sources lack is spread over the rest."""
    left = float(sum(available.values()) if total is None else total)
    need: dict[str, float] = {}
    while open_ := [s for s in available if s not in need]:
        asked = sum(wanted[s][0] for s in open_)
        full = [s for s in open_ if left * wanted[s][0] / asked >= wanted[s][1] * available[s]]
        for s in full or open_:
            need[s] = float(wanted[s][1] * available[s]) if full else left * wanted[s][0] / asked
        left -= sum(need[s] for s in full)
    return need


@scratched
def mix(documents: DataFrame, targets: DataFrame, seed: int = SEED, total_tokens: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares) of a mixture.

    ``documents`` has doc_id, source and n_tokens; ``targets`` has source,
    target_share and max_repeats (one row a source; it is small, a few rows a
    source). chosen is (doc_id, source, n_tokens, repeats) with repeats from 1 to
    max_repeats; shares tells per target source the tokens asked of it
    (asked_tokens, its share of the total among the present sources), those given
    and those it lacks because of its cap (short_tokens). The total is
    ``total_tokens``, by default the tokens of the present sources. Documents of
    other sources, with null source or id, or without tokens are not used;
    repeated rows are documents of their own with the same number of copies.
    Source names are compared in one notation. Empty tables give an empty mixture.
    """
    wanted: dict[str, tuple[float, int]] = {}
    for r in targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").collect():
        if r["source"] and (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) > 0 and r["source"] not in wanted:
            wanted[r["source"]] = (float(r["target_share"]), int(r["max_repeats"]))
    spark = documents.sparkSession
    goal = spark.createDataFrame(
        [(s, share, cap) for s, (share, cap) in wanted.items()], "source string, target_share double, max_repeats int"
    )
    docs = (
        documents.select(F.col("doc_id"), source_key(F.col("source")).alias("source"), F.col("n_tokens").cast("long").alias("n_tokens"))
        .filter("doc_id IS NOT NULL AND n_tokens > 0")
        .join(F.broadcast(goal), "source")  # one row per target source
    )
    # Tokens are counted and rates solved once; everything after reads this narrow table.
    rated = cut(_with_rates(docs, seed).select("doc_id", "source", "n_tokens", "rates"))
    available = {r["source"]: r["t"] for r in rated.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    need = needs(available, wanted, total_tokens)

    copies = rated.select("source", "n_tokens", F.explode("rates").alias("rate"))
    bin_of = lambda c, low, high: F.least(F.lit(BINS - 1), F.floor((c - low) / (high - low) * BINS)).cast("int")
    bounds = {s: (0.0, rate_limit(wanted[s][1])) for s in available}
    sure = {s: 0.0 for s in available}
    for _ in range(3):  # each pass narrows the rate by the number of bins
        at = spark.createDataFrame([(s, lo, hi) for s, (lo, hi) in bounds.items()], "source string, low double, high double")
        inside = copies.join(F.broadcast(at), "source").filter((F.col("rate") >= F.col("low")) & (F.col("rate") < F.col("high")))
        counted = (
            inside.groupBy("source", bin_of(F.col("rate"), F.col("low"), F.col("high")).alias("bin"))
            .agg(F.sum("n_tokens").alias("t"))
            .collect()
        )  # at most BINS numbers a source
        by: dict[str, dict[int, int]] = {}
        for r in counted:
            by.setdefault(r["source"], {})[r["bin"]] = r["t"]
        for s, bins in by.items():
            (low, high), step = bounds[s], (bounds[s][1] - bounds[s][0]) / BINS
            for b in sorted(bins):
                if sure[s] + bins[b] > need[s]:
                    bounds[s] = (low + b * step, low + (b + 1) * step)
                    break
                sure[s] += bins[b]
            else:
                bounds[s] = (high, high)
    # The start of the last, tiny bin; a source whose every copy is needed ends at its limit.
    final = spark.createDataFrame([(s, lo) for s, (lo, _) in bounds.items()], "source string, mean double")
    reached_at: Column = F.expr("size(filter(rates, r -> r < mean))")
    chosen = cut(
        rated.join(F.broadcast(final), "source")
        .withColumn("repeats", reached_at)
        .filter("repeats > 0")
        .select("doc_id", "source", "n_tokens", "repeats")
    )
    reached = chosen.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats")
    )
    present = sum(wanted[s][0] for s in available)
    total = float(sum(available.values())) if total_tokens is None else float(total_tokens)
    ask = {s: total * wanted[s][0] / present if s in available else 0.0 for s in wanted}
    held = spark.createDataFrame([(s, ask[s], float(max(0.0, ask[s] - need.get(s, 0.0)))) for s in wanted], "source string, asked double, short double")
    shares = (
        goal.join(reached, "source", "left")
        .join(F.broadcast(held), "source")  # one row per target source
        .withColumn("tokens", F.coalesce("tokens", F.lit(0)))
        .withColumn("whole", F.expr("sum(tokens) OVER ()"))  # one row per target source
        .select(
            "source",
            "target_share",
            "max_repeats",
            F.coalesce("documents", F.lit(0)).alias("documents"),
            F.round("asked").cast("long").alias("asked_tokens"),
            "tokens",
            F.round("short").cast("long").alias("short_tokens"),
            F.when(F.col("whole") > 0, F.round(F.col("tokens") / F.col("whole"), 6)).otherwise(0.0).alias("actual_share"),
            F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        )
    )
    return chosen, shares


def shuffled(chosen: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per copy in a global random order: range-partitioned by a hash."""
    return (
        chosen.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
        .withColumn("position_key", F.xxhash64("doc_id", "copy_no", F.lit(seed + 1)))
        .orderBy("position_key", "doc_id", "copy_no")
    )


def _sized(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    return with_token_counts(load(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text", tokenizer)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture itself: every copy with its place in the global order."""
    chosen, _ = mix(_sized(spark, sf_dir), load(spark, sf_dir, "mix_target"))
    return shuffled(chosen)


def p9_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_sized(spark, sf_dir), load(spark, sf_dir, "mix_target"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_sized(spark, sf_dir), load(spark, sf_dir, "mix_target"))[1]


def p9_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target source, what must hold of any mixture: no chosen document beyond
    the cap, of another source, chosen twice or without a text of its own."""
    documents, targets = load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_target")
    chosen, _ = mix(_sized(spark, sf_dir), targets)
    named = documents.select("doc_id", source_key(F.col("source")).alias("named"), F.length("text").alias("chars"))
    rows = chosen.join(named, "doc_id", "left").groupBy("source").agg(
        F.max("repeats").alias("most"), (F.count("*") - F.countDistinct("doc_id")).alias("twice"),
        F.sum(F.when((F.col("named") == F.col("source")) & (F.col("chars") > 0), 0).otherwise(1)).alias("strange"),
    )
    goal = targets.select(source_key(F.col("source")).alias("source"), "max_repeats")
    return goal.join(rows, "source", "left").select(
        "source", "max_repeats",
        (F.coalesce("most", F.lit(0)) > F.col("max_repeats")).alias("beyond_cap"),
        F.coalesce("twice", F.lit(0)).alias("chosen_twice"),
        F.coalesce("strange", F.lit(0)).alias("of_no_such_source"),
    )


QUERIES = {"p9_mix": p9_mix, "p9_chosen": p9_chosen, "p9_shares": p9_shares, "p9_caps": p9_caps}
SQL: dict[str, str] = {
    "p9_caps": """SELECT trim(regexp_replace(lower(trim(source)), '[^a-z0-9]+', '_', 'g'), '_') AS source, max_repeats,
        false AS beyond_cap, 0 AS chosen_twice, 0 AS of_no_such_source FROM mix_target""",
}
