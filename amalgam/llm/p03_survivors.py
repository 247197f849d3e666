"""Best representative of each duplicate group, field by field.

Every row votes with the trust of its source: authority (brought to 0..1) to the
fourth power, a bonus for primary sources, halved every ``HALF_LIFE`` years since
retrieval. Equal values are summed before any shuffle. Trust only ranks values
and weighs their votes: what is not usable is told by its content, so a group's
lone usable value survives however old or doubtful its source. A directory's page
is told by its listing path, never by how many groups share the host (chains do).

Values of a group are aligned progressively, heaviest first: each is aligned to
the profile of those before by dynamic programming, tokens vote per column with
their value's weight, and the consensus is the heaviest token of every column.
The existing value nearest to the consensus, by edits of tokens, survives.

A value with more than half of a group's weight wins every column of any
alignment, so it is the consensus itself and no alignment is made. The other
groups are aligned in batches of about ``FAN_IN`` values; a batch gives its
profile with all its votes, and profiles are aligned to one another in turn, so
that no task ever holds a whole large group and no vote is lost on the way. A
group of one batch takes the same way.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from amalgam.llm.normal import NO_VALUES, edit_distance, fold, phone_key
from amalgam.runtime import cut, drop, load, scratched

#: LEAST_WEIGHT is the vote of a source of no authority: it still says something.
HALF_LIFE, LEAST_WEIGHT, FAN_IN = 0.5, 1e-12, 64
#: Authority of a source that states none, by its type (fixed values).
TYPICAL_AUTHORITY = {
    "official_website": 0.9, "structured_provider": 0.75, "user_provided": 0.7, "other": 0.5,
    "search_result": 0.4, "directory": 0.3, "ai_inference": 0.2,
}
_UNKNOWN_AGE = 0.5
GAP = ""
Profile = list[dict[str, float]]


def tokens(field: str, value: str) -> list[str]:
    """Digits of a phone and letters of a host; words of names and addresses."""
    return list(value) if field in ("canonical_phone", "canonical_website") else value.split(" ")


def merged(profile: Profile, depth: float, other: Profile, weight: float) -> Profile:
    """Two profiles of columns {token: votes} aligned to one; depth and weight are
    their total votes. A value is a profile of one token a column."""
    n, m = len(profile), len(other)
    gap_a = [c.get(GAP, 0.0) / depth - 1 for c in profile]
    gap_b = [c.get(GAP, 0.0) / weight - 1 for c in other]

    def match(i: int, j: int) -> float:
        a, b = profile[i], other[j]
        if len(b) == 1:
            (t, _), = b.items()
            return 2 * a.get(t, 0.0) / depth - 0.6
        return 2 * sum(a[t] * v for t, v in b.items() if t in a) / (depth * weight) - 0.6

    score = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        score[i][0] = score[i - 1][0] + gap_a[i - 1]
    for j in range(1, m + 1):
        score[0][j] = score[0][j - 1] + gap_b[j - 1]
    for i in range(1, n + 1):
        row, above, skip = score[i], score[i - 1], gap_a[i - 1]
        for j in range(1, m + 1):
            row[j] = max(above[j - 1] + match(i - 1, j - 1), above[j] + skip, row[j - 1] + gap_b[j - 1])
    i, j, out = n, m, []
    while i or j:
        if i and j and score[i][j] == score[i - 1][j - 1] + match(i - 1, j - 1):
            column, added, i, j = profile[i - 1], other[j - 1], i - 1, j - 1
        elif i and score[i][j] == score[i - 1][j] + gap_a[i - 1]:
            column, added, i = profile[i - 1], {GAP: weight}, i - 1
        else:
            column, added, j = {GAP: depth}, other[j - 1], j - 1
        both = dict(column)
        for t, v in added.items():
            both[t] = both.get(t, 0.0) + v
        out.append(both)
    return out[::-1]


def aligned(profiles: list[tuple[str, Profile, float]]) -> Profile:
    """The profile of (order, profile, weight) rows, heaviest first, then by order."""
    first, *rest = sorted(profiles, key=lambda x: (-x[2], x[0]))
    profile, depth = first[1], first[2]
    for _, other, weight in rest:
        profile = merged(profile, depth, other, weight)
        depth += weight
    return profile


def winners(profile: Profile) -> list[str]:
    """The heaviest token of every column, gaps left out."""
    return [t for c in profile if (t := min(c, key=lambda t: (-c[t], t))) != GAP]


def profile_of(field: str, value: str, weight: float) -> Profile:
    return [{t: weight} for t in tokens(field, value)]


def consensus(field: str, values: list[str], weights: list[float]) -> list[str]:
    """The tokens of the consensus of the progressive alignment."""
    return winners(aligned([(v, profile_of(field, v, w), w) for v, w in zip(values, weights)]))


def distance(field: str, value: str, target: list[str]) -> int:
    """Edits of tokens, swaps of neighbours included, however many."""
    own = tokens(field, value)
    return edit_distance(own, target, len(own) + len(target))


def source_weight(as_of: Column) -> Column:
    """Votes of a row from authority, source_type, is_primary and retrieved_at.
    Times later than ``as_of`` by over 60 days or before 2000 are from a broken
    clock: their age is unknown."""
    stated = F.when(F.col("authority") > 1, F.col("authority") / 100).otherwise(F.col("authority"))
    typical = F.coalesce(*[F.when(F.col("source_type") == t, F.lit(a)) for t, a in TYPICAL_AUTHORITY.items()], F.lit(0.5))
    authority = F.when(stated.between(0, 1), F.least(stated, F.when(typical < 0.45, 0.45).otherwise(1.0))).otherwise(typical)
    years = (as_of.cast("double") - F.col("retrieved_at").cast("double")) / F.lit(365.25 * 86400)
    broken = F.col("retrieved_at").isNull() | (F.col("retrieved_at") < F.lit("2000-01-01").cast("timestamp")) | (years < -60 / 365.25)
    recency = F.when(broken, F.lit(_UNKNOWN_AGE)).otherwise(F.pow(F.lit(0.5), F.greatest(years, F.lit(0.0)) / HALF_LIFE))
    primary = F.when(F.coalesce(F.col("is_primary"), F.lit(False)), 1.2).otherwise(1.0)
    return F.greatest(F.pow(authority, F.lit(4.0)) * recency * primary, F.lit(LEAST_WEIGHT))


def usable(field: str, value: str | None) -> str | None:
    """The compared form of a value; None if it says nothing."""
    if value is None or fold(value) in NO_VALUES:
        return None
    if field == "canonical_phone":
        return phone_key(value)
    if field == "canonical_website":
        m = re.match(r"^(?:https?://)?(?:www\.)?([a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9-]+)*\.[a-z]{2,})(?::\d+)?(?:[/?#].*)?$", value.strip().lower())
        return m[1] if m and not re.search(r"/(biz|p|listing|place)/", value.lower()) else None
    return re.sub(r"\s+", " ", value).strip() or None


@scratched
def surviving_values(rows: DataFrame, fields: list[str]) -> DataFrame:
    """One row (group_id, field_name, survivor, votes) per group and field that
    has a usable value.

    ``rows`` has group_id, weight and the fields as strings. Null groups,
    unusable values and weights that are null or not positive are left out;
    repeated rows add their votes; ties go to the heavier, then the smaller
    value; an empty table gives none.
    """

    @F.pandas_udf("string")
    def usable_udf(field: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([usable(f, v) for f, v in zip(field, value)], dtype=object)

    key = ["group_id", "field"]
    long = rows.filter("group_id IS NOT NULL AND weight > 0").select(
        "group_id", "weight", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("raw")) for f in fields])).alias("x")
    )
    votes = cut(
        long.select("group_id", F.col("x.field").alias("field"), usable_udf("x.field", "x.raw").alias("value"), "weight")
        .filter("value IS NOT NULL")
        .groupBy(*key, "value")
        .agg(F.sum("weight").alias("weight"))
    )
    sums = cut(
        votes.groupBy(*key).agg(
            F.count("*").alias("n"), F.sum("weight").alias("total"), F.max(F.struct("weight", "value")).alias("top")
        )
    )
    clear = (F.col("n") == 1) | (F.col("top.weight") > 0.5000001 * F.col("total"))
    known = sums.filter(clear).select(*key, F.col("top.value").alias("survivor"), F.col("total").alias("votes"))
    mixed = cut(votes.join(sums.filter(~clear).select(*key, "n", "total"), key))
    return known.unionByName(_nearest(mixed, _consensus(mixed)))


def _consensus(mixed: DataFrame) -> DataFrame:
    """(group_id, field, target): the tokens of the consensus of each group of votes."""

    @F.pandas_udf("struct<profile string, weight double>")
    def align_values(field: pd.Series, values: pd.Series) -> pd.DataFrame:
        rows = []
        for f, part in zip(field, values):
            found = aligned([(x["value"], profile_of(f, x["value"], x["weight"]), x["weight"]) for x in part])
            rows.append((json.dumps(found), sum(x["weight"] for x in part)))
        return pd.DataFrame(rows, columns=["profile", "weight"])

    @F.pandas_udf("struct<profile string, weight double>")
    def align_profiles(parts: pd.Series) -> pd.DataFrame:
        rows = []
        for part in parts:
            rows.append((json.dumps(aligned([(x["profile"], json.loads(x["profile"]), x["weight"]) for x in part])), sum(x["weight"] for x in part)))
        return pd.DataFrame(rows, columns=["profile", "weight"])

    @F.pandas_udf("array<string>")
    def told(profile: pd.Series) -> pd.Series:
        return pd.Series([winners(json.loads(p)) for p in profile], dtype=object)

    key = ["group_id", "field"]
    batches = lambda n: F.ceil(n * 2 / FAN_IN)
    gathered = mixed.groupBy(*key, F.pmod(F.xxhash64("value"), batches(F.col("n"))).alias("batch")).agg(
        F.collect_list(F.struct("value", "weight")).alias("values")  # FAN_IN / 2 values on average
    )
    left = cut(gathered.select(*key, "batch", align_values("field", "values").alias("p")).select(*key, "batch", "p.*"))
    while True:
        counted = left.groupBy(*key).agg(F.count("*").alias("m")).filter("m > 1")
        if counted.isEmpty():
            break
        several = left.join(counted, key).withColumn("next", F.pmod(F.xxhash64("batch"), batches(F.col("m"))))
        gathered = several.groupBy(*key, "next").agg(F.collect_list(F.struct("profile", "weight")).alias("parts"))
        last, left = left, cut(
            left.join(counted, key, "left_anti").unionByName(
                gathered.select(*key, F.col("next").alias("batch"), align_profiles("parts").alias("p")).select(*key, "batch", "p.*")
            )
        )
        drop(last)
    return left.select(*key, told("profile").alias("target"))


def _nearest(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    @F.pandas_udf("int")
    def away(field: pd.Series, value: pd.Series, target: pd.Series) -> pd.Series:
        return pd.Series([distance(f, v, list(t)) for f, v, t in zip(field, value, target)], dtype="int32")

    found = mixed.join(targets, ["group_id", "field"]).withColumn("d", away("field", "value", "target"))
    best = F.min(F.struct("d", (-F.col("weight")).alias("w"), "value")).alias("m")
    return found.groupBy("group_id", "field").agg(best, F.max("total").alias("votes")).select("group_id", "field", F.col("m.value").alias("survivor"), "votes")


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = load(spark, sf_dir, "source_ref").select("id", "authority", "is_primary", "source_type", "retrieved_at")
    # Now, as far as the sources tell: a late quantile, which broken clocks don't move.
    now = sources.agg(F.percentile_approx(F.col("retrieved_at").cast("double"), 0.9, 10_000).alias("t")).first()["t"]
    rows = load(spark, sf_dir, "business_entity").filter("merge_group IS NOT NULL").withColumnRenamed("source_id", "id")
    as_of = F.lit(float(now or 0.0))
    return rows.join(sources, "id", "left").withColumn("weight", source_weight(as_of)).withColumnRenamed("merge_group", "group_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surviving_values(_weighted(spark, sf_dir), ["canonical_website", "canonical_phone"]).select(
        F.col("group_id").alias("merge_group"), F.col("field").alias("field_name"), "survivor"
    )


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record of every merge group."""
    fields = ["canonical_name", "canonical_phone", "canonical_website", "canonical_address", "category"]
    long = surviving_values(_weighted(spark, sf_dir), fields)
    return long.groupBy(F.col("group_id").alias("merge_group")).pivot("field", fields).agg(F.first("survivor"))


QUERIES = {"p3_found": p3_found, "p3_records": p3_records}
SQL: dict[str, str] = {}
