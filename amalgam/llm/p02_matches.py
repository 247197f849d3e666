"""Matching entities across sources without keys.

Sorted neighbourhood: rows of both sides are sorted together under several
composite keys (name first, reversed name, phone, address, position), in one
global range sort that gives every distinct key its rank. A record is compared with
the entity rows of keys at most ``window`` ranks away, by weighted similarities of name,
phone, address, position and website. Rank blocks make the window an equi-join,
rows of one key always meet, and no pair outside a window is ever made. Equal
readings are compared once, whatever number of rows shares them.

A provider may list one business more than once: its records that are nearest to
the same business, and do not contradict the surest of them, are one listing.
Each provider's listings are then assigned one-to-one to businesses so that the
total confidence is greatest: those without rivals directly, the rest per
connected component, in one task or, where a component is too large for that, by
an auction in rounds that comes within ``EPSILON`` an edge of the greatest total.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from amalgam.llm.normal import name_tokens, phone_key
from amalgam.llm.p06_groups import connected_groups
from amalgam.llm.p07_addresses import with_place
from amalgam.runtime import cut, drop, load, scratched

WINDOW, ACCEPT = 10, 0.3
#: Edges up to which a contested component is solved in one task; larger ones by auction.
EXACT_EDGES, EDGES_PER_TASK, EPSILON = 2000, 1000, 0.01
_FIELDS = ["sig", "phone", "host", "house", "direction", "street", "kind", "town", "zip", "lat", "lon"]


def _readings(df: DataFrame, name: str, phone: str, website: str, address: str, city: Column, lat: str, lon: str, keep: list[str]) -> DataFrame:
    """Canonical readings of the compared fields."""

    @F.pandas_udf("struct<sig string, phone string>")
    def read(names: pd.Series, phones: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "sig": [" ".join(t) if (t := name_tokens(n)) else None for n in names],
                "phone": [phone_key(p) for p in phones],
            }
        )

    host = F.regexp_extract(F.lower(F.trim(F.col(website))), r"^(?:https?://)?(?:www\.)?([a-z0-9.-]+\.[a-z]+)", 1)
    # A zero pair is no position; a pair out of range the one way and in range the other is exchanged.
    # An exchanged pair within range can't be told alone: pairs are compared both ways.
    x, y = F.col(lat), F.col(lon)
    valid = x.isNotNull() & y.isNotNull() & ~((F.abs(x) < 1e-6) & (F.abs(y) < 1e-6))
    swapped = (F.abs(x) > 90) & (F.abs(y) <= 90)
    out = (
        with_place(df, address)
        .withColumn("read", read(F.col(name), F.col(phone)))
        .select(
            *keep,
            "read.sig",
            "read.phone",
            F.when((host != "") & ~F.col(website).rlike(r"/(p|biz)/"), host).alias("host"),
            *[F.coalesce(F.col(f"place.{c}"), F.lit("")).alias(c) for c in ("house", "direction", "street", "kind")],
            F.when(F.coalesce(F.col("place.town"), F.lit("")) != "", F.col("place.town"))
            .otherwise(F.regexp_replace(F.lower(F.coalesce(city, F.lit(""))), "[^a-z]", ""))
            .alias("town"),
            F.coalesce("place.zip", F.lit("")).alias("zip"),
            F.when(valid, F.when(swapped, y).otherwise(x)).alias("lat"),
            F.when(valid, F.when(swapped, x).otherwise(y)).alias("lon"),
        )
    )
    return out


def _sort_keys() -> Column:
    """(pass, key) of each composite key that the row can fill."""
    sep = lambda *c: F.concat_ws("|", *[F.col(x) if isinstance(x, str) else x for x in c])
    back = F.array_join(F.reverse(F.split("sig", " ")), " ")
    # The same cell for a position and its exchange.
    cell = F.concat_ws(",", F.round(F.greatest("lat", "lon"), 2).cast("string"), F.round(F.least("lat", "lon"), 2).cast("string"))
    keys = [
        F.when(F.col("sig").isNotNull(), F.struct(F.lit(1).alias("pass"), sep("sig", "town", "street", "house", "phone").alias("key"))),
        F.when(F.col("sig").isNotNull(), F.struct(F.lit(2).alias("pass"), F.concat_ws("|", back, "town", "street", "house", "phone").alias("key"))),
        F.when(F.col("phone").isNotNull(), F.struct(F.lit(3).alias("pass"), sep("phone", "sig", "street", "house").alias("key"))),
        F.when((F.col("street") != "") & (F.col("house") != ""), F.struct(F.lit(4).alias("pass"), sep("street", "house", "town", "sig", "phone").alias("key"))),
        F.when(F.col("lat").isNotNull(), F.struct(F.lit(5).alias("pass"), sep(cell, "sig", "phone").alias("key"))),
    ]
    return F.explode(F.array_compact(F.array(*keys)))


def window_pairs(rows: DataFrame, window: int = WINDOW, carry: list[str] | None = None, keep: Callable[[], Column] | None = None) -> DataFrame:
    """Distinct pairs (a, b) of row ids, a of side 0 and b of side 1, whose keys
    stand at most ``window`` ranks apart in some pass. Ranks count distinct keys,
    so rows of equal keys always meet, however many there are. ``rows`` has id,
    side and the columns of the keys; the columns ``carry`` travel along, so that
    pairs that fail ``keep`` (over a_* and b_*) are never shuffled."""
    carry = carry or []
    keyed = cut(rows.select("id", "side", *carry, _sort_keys().alias("k")).select("id", "side", *carry, "k.*").withColumn("key_id", F.xxhash64("pass", "key")))
    placed = cut(
        keyed.groupBy("key_id").agg(F.min(F.struct("pass", "key")).alias("k"))
        .select("key_id", "k.*")
        .orderBy("pass", "key")
        .withColumn("part", F.spark_partition_id())
        .withColumn("pos", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
        .select("key_id", "part", "pos")
    )
    counts = dict(placed.groupBy("part").count().collect())  # one number a partition
    offsets, at = [], 0
    for part in sorted(counts):
        offsets.append((part, at))
        at += counts[part]
    where = rows.sparkSession.createDataFrame(offsets, "part int, offset long")
    ranks = placed.join(F.broadcast(where), "part").select("key_id", (F.col("offset") + F.col("pos")).alias("rank"))
    ranked = cut(keyed.select("id", "side", "pass", "key_id", *carry).join(ranks, "key_id").select("id", "side", "pass", "rank", *carry))
    drop(keyed, placed)
    block = F.floor(F.col("rank") / window)
    left = ranked.filter("side = 0").select(
        F.col("id").alias("a"), "pass", F.col("rank").alias("ra"), block.alias("block"), *[F.col(c).alias(f"a_{c}") for c in carry]
    )
    right = ranked.filter("side = 1").select(
        F.col("id").alias("b"), F.col("pass").alias("pass_b"), F.col("rank").alias("rb"), F.explode(F.array(block - 1, block, block + 1)).alias("block"),
        *[F.col(c).alias(f"b_{c}") for c in carry],
    )
    met = left.join(right, "block").filter((F.col("pass") == F.col("pass_b")) & (F.abs(F.col("ra") - F.col("rb")) <= window))
    return (met.filter(keep()) if keep else met).select("a", "b").distinct()


def may_be_one() -> Column:
    """What a pair (a_*, b_*) must meet to be scored at all: names a slip or so
    apart, or, where a side has no name, an equal phone or host."""
    x, y = F.col("a_sig"), F.col("b_sig")
    alike = F.levenshtein(x, y, 3).between(0, F.when(F.length(x) >= 12, 3).otherwise(1))
    reached = F.coalesce(F.col("a_phone") == F.col("b_phone"), F.lit(False)) | F.coalesce(F.col("a_host") == F.col("b_host"), F.lit(False))
    return F.when(x.isNotNull() & y.isNotNull(), alike).otherwise(reached)


def similarity(a: str, b: str) -> dict[str, Column]:
    """Field similarities in [0, 1]; null where a side is missing."""
    x, y = (lambda c: F.col(f"{a}{c}")), (lambda c: F.col(f"{b}{c}"))
    name_edits = F.levenshtein(x("sig"), y("sig"))
    longest = F.greatest(F.length(x("sig")), F.length(y("sig")))
    name = F.greatest(F.lit(0.0), 1 - name_edits / longest)
    phone = F.when(x("phone") == y("phone"), 1.0).when(x("phone").isNotNull() & y("phone").isNotNull(), 0.0)
    housed = (x("house") != "") & (y("house") != "") & (x("street") != "") & (y("street") != "")
    town_known = (x("town") != "") & (y("town") != "")
    zip_known = (x("zip") != "") & (y("zip") != "")
    town_same = F.levenshtein(x("town"), y("town")) <= 2
    zip_same = x("zip") == y("zip")
    where = F.when(town_known & zip_known, town_same | zip_same).when(town_known, town_same).when(zip_known, zip_same)
    street_same = (F.levenshtein(x("street"), y("street")) <= 2) & (x("direction") == y("direction")) & (
        (x("kind") == y("kind")) | (x("kind") == "") | (y("kind") == "")
    )
    address = F.when(
        housed, F.when((x("house") == y("house")) & street_same & F.coalesce(where, F.lit(True)), 1.0).otherwise(0.0)
    )
    town = F.when(where, 1.0).when(~where, 0.0)
    wide = F.greatest(F.cos(F.radians(x("lat"))), F.cos(F.radians(y("lat"))))
    apart = lambda c, d: F.hypot((x("lat") - y(c)) * 111_195, (x("lon") - y(d)) * 111_195 * wide)
    metres = F.least(apart("lat", "lon"), apart("lon", "lat"))  # one side's pair may be exchanged
    geo = F.when(metres <= 150, 1.0).when(metres <= 500, 0.4).when(metres.isNotNull(), 0.0)
    host = F.when(x("host") == y("host"), 1.0).when(x("host").isNotNull() & y("host").isNotNull(), 0.0)
    return {"name": name, "phone": phone, "address": address, "town": town, "geo": geo, "host": host, "edits": name_edits}


#: Weights of the similarities; a field missing on a side gives nothing.
WEIGHTS = {"name": 0.38, "phone": 0.22, "address": 0.28, "town": 0.10, "geo": 0.18, "host": 0.14}


def scored(pairs: DataFrame) -> DataFrame:
    """Adds ``confidence`` to pairs with readings a_* and b_*; keeps those that
    can be one business at one place."""
    s = similarity("a_", "b_")
    df = pairs.withColumns({f"s_{k}": v for k, v in s.items()})
    has = lambda f: F.coalesce(F.col(f"s_{f}"), F.lit(0.0)) >= 1.0
    against = lambda f: F.coalesce(F.col(f"s_{f}") == 0.0, F.lit(False))
    nameless = F.col("s_edits").isNull()
    named = F.col("s_edits") <= F.when(F.length("a_sig") >= 12, 3).otherwise(1)
    placed = has("address") | has("geo")
    elsewhere = against("address") | (F.col("s_address").isNull() & against("town")) | against("geo")
    ok = F.when(
        named,
        (has("address") & ~(against("geo") & against("phone")))
        | (has("geo") & ~against("address"))
        | (~elsewhere & (has("phone") | has("town") | has("host"))),
    ).when(nameless, (has("phone") | has("host")) & (placed | ~elsewhere))
    total = sum((F.coalesce(F.col(f"s_{f}"), F.lit(0.0)) * w for f, w in WEIGHTS.items()), F.lit(0.0))
    # Contradictions count against, evidence on both sides for.
    minus = F.when(against("phone"), 0.06).otherwise(0.0) + F.when(against("host"), 0.06).otherwise(0.0)
    return df.filter(F.coalesce(ok, F.lit(False))).withColumn(
        "confidence", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total - minus)), 6)
    )


def best_assignment(weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a one-to-one assignment of greatest total weight;
    zero means no edge. Shortest augmenting paths with potentials."""
    turned = weights.shape[0] > weights.shape[1]
    cost = -(weights.T if turned else weights)
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        slack, way, done = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while True:
            done[j0] = True
            reduced = cost[owner[j0] - 1] - u[owner[j0]] - v[1:]
            better = ~done[1:] & (reduced < slack[1:])
            slack[1:][better], way[1:][better] = reduced[better], j0
            free = np.where(done[1:], np.inf, slack[1:])
            j1 = int(free.argmin()) + 1
            delta = free[j1 - 1]
            u[owner[done]] += delta
            v[done] -= delta
            slack[~done] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    pairs = [(j, i) if turned else (i, j) for i, j in pairs]
    return [(i, j) for i, j in pairs if weights[i, j] > 0]


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges come sorted by component; components are small and solved exactly."""

    def best(edges: list[tuple[str, str, float]]) -> list[tuple[str, str]]:
        rows = {x: i for i, x in enumerate(dict.fromkeys(e[0] for e in edges))}
        cols = {x: i for i, x in enumerate(dict.fromkeys(e[1] for e in edges))}
        weights = np.zeros((len(rows), len(cols)))
        for a, b, w in edges:
            weights[rows[a], cols[b]] = w
        r, c = list(rows), list(cols)
        return [(r[i], c[j]) for i, j in best_assignment(weights)]

    current, edges, out = None, [], []
    for pdf in batches:
        for group, a, b, w in zip(pdf["group_key"], pdf["left"], pdf["right"], pdf["confidence"]):
            if group != current:
                out += best(edges) if edges else []
                current, edges = group, []
            edges.append((a, b, w))
        if out:
            yield pd.DataFrame(out, columns=["left", "right"])
            out = []
    if edges:
        yield pd.DataFrame(best(edges), columns=["left", "right"])


def _auction(edges: DataFrame) -> DataFrame:
    """For components too large for one task: free lefts bid for the right that is
    worth most to them above its price, by as much as it is worth more than their
    next choice (or than nothing) and EPSILON; a right goes to the highest bid. The
    total is within EPSILON a match of the greatest."""
    spark = edges.sparkSession
    prices = spark.createDataFrame([], "right string, price double, left string")
    retired = spark.createDataFrame([], "left string")
    while True:
        free = edges.join(prices.select("left"), "left", "left_anti").join(retired, "left", "left_anti")
        worth = free.join(prices.select("right", "price"), "right", "left").withColumn("price", F.coalesce("price", F.lit(0.0))).withColumn(
            "gain", F.col("confidence") - F.col("price")
        )
        worth = cut(worth)
        top = worth.groupBy("left").agg(F.max(F.struct("gain", "right", "price")).alias("m")).select("left", "m.gain", "m.right", "m.price")
        beside = worth.join(top.select("left", F.col("right").alias("first")), "left").filter("right <> first").groupBy("left").agg(F.max("gain").alias("next"))
        choice = cut(top.join(beside, "left", "left").withColumn("next", F.greatest(F.coalesce("next", F.lit(0.0)), F.lit(0.0))))
        drop(worth)
        if choice.isEmpty():
            break
        bids = choice.filter("gain > 0").select("right", "left", (F.col("price") + F.col("gain") - F.col("next") + EPSILON).alias("price"))
        won = bids.groupBy("right").agg(F.max(F.struct("price", "left")).alias("m")).select("right", "m.price", "m.left")
        old_prices, old_retired = prices, retired
        prices = cut(prices.join(won.select("right"), "right", "left_anti").unionByName(won))
        retired = cut(retired.unionByName(choice.filter("gain <= 0").select("left")))
        drop(old_prices, old_retired, choice)
    return prices.select("left", "right")


@scratched
def assign_one_to_one(edges: DataFrame) -> DataFrame:
    """The edges (left, right, confidence) of a one-to-one assignment with the
    greatest total confidence. left and right are strings of different spaces."""
    edges = cut(edges)
    lone_left = edges.groupBy("left").count().filter("count = 1").select("left")
    lone_right = edges.groupBy("right").count().filter("count = 1").select("right")
    simple = cut(edges.join(lone_left, "left", "left_semi").join(lone_right, "right", "left_semi"))
    contested = cut(edges.join(simple.select("left"), "left", "left_anti"))
    if contested.isEmpty():
        return simple
    tagged = contested.select(F.concat(F.lit("l:"), "left").alias("x"), F.concat(F.lit("r:"), "right").alias("y"))
    groups = connected_groups(tagged, "x", "y")
    grouped = cut(contested.withColumn("member", F.concat(F.lit("l:"), "left")).join(groups, "member").select("group_key", "left", "right", "confidence"))
    sizes = grouped.groupBy("group_key").count()
    large = sizes.filter(F.col("count") > EXACT_EDGES).select("group_key")
    # Solving takes time, not bytes: tasks are cut by edges, not by size.
    tasks = max(1, min(2048, -(-grouped.count() // EDGES_PER_TASK)))
    solved = (
        grouped.join(large, "group_key", "left_anti")
        .repartition(tasks, "group_key")
        .sortWithinPartitions("group_key")
        .mapInPandas(_solve, "left string, right string")
        .unionByName(_auction(cut(grouped.join(large, "group_key", "left_semi"))))
    )
    return simple.unionByName(contested.join(solved, ["left", "right"]).select(*simple.columns))


def _listings(edges: DataFrame, readings: DataFrame) -> DataFrame:
    """(provider, record_id, listing): records of a provider that are nearest to
    the same cluster as the surest record there, and do not contradict it in name
    or place, take its id as their listing; others are listings of their own."""
    key = ["provider", "record_id"]
    home = edges.groupBy(*key).agg(F.max_by(F.struct("cluster", "confidence"), F.struct("confidence", "cluster")).alias("m")).select(*key, "m.*")
    head = home.groupBy("provider", "cluster").agg(F.max(F.struct("confidence", "record_id")).alias("m"), F.count("*").alias("n"))
    several = home.join(head.filter("n > 1").select("provider", "cluster", F.col("m.record_id").alias("listing")), ["provider", "cluster"])
    a = readings.select(*key, *[F.col(c).alias(f"a_{c}") for c in _FIELDS])
    b = readings.select("provider", F.col("record_id").alias("listing"), *[F.col(c).alias(f"b_{c}") for c in _FIELDS])
    s = similarity("a_", "b_")
    zero = lambda f: F.coalesce(s[f] == 0.0, F.lit(False))
    other_name = F.coalesce(s["edits"] > F.when(F.length("a_sig") >= 12, 3).otherwise(1), F.lit(False))
    against = other_name | zero("address") | (s["address"].isNull() & zero("town")) | (zero("geo") & ~F.coalesce(s["address"] == 1.0, F.lit(False)))
    # A record that came with several readings joins if any of them may.
    joined = (
        several.join(a, key).join(b, ["provider", "listing"]).groupBy(*key, "listing").agg(F.min(against.cast("int")).alias("against"))
        .filter("against = 0").select(*key, "listing")
    )
    return home.select(*key).join(joined, key, "left").select(*key, F.coalesce("listing", "record_id").alias("listing"))


@scratched
def match_entities(records: DataFrame, entities: DataFrame, window: int = WINDOW) -> DataFrame:
    """Matches (provider, record_id, cluster, confidence).

    ``records`` and ``entities`` hold readings (see ``_readings``) with provider
    and record_id, and with cluster. A record has at most one cluster, and a
    provider's listing (see ``_listings``) is the only one of its cluster. Fields
    that are null, placeholders or unreadable are missing and neither support
    nor contradict; rows without any field are matched to nothing; repeated rows
    count once; ties go to the smaller id; empty tables give no matches.
    """
    key = ["provider", "record_id"]
    # Equal readings are compared once, their members joined back after.
    reading = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in _FIELDS])
    left = cut(records.dropDuplicates([*key, *_FIELDS]).withColumn("id", reading))
    right = cut(entities.dropDuplicates(["cluster", *_FIELDS]).withColumn("id", reading))
    said, held = (cut(side.select("id", *_FIELDS).dropDuplicates(["id"])) for side in (left, right))
    both = said.withColumn("side", F.lit(0)).unionByName(held.withColumn("side", F.lit(1)))
    pairs = window_pairs(both, window, ["sig", "phone", "host"], may_be_one)
    a = said.select(F.col("id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in _FIELDS])
    b = held.select(F.col("id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in _FIELDS])
    alike = scored(pairs.join(a, "a").join(b, "b")).filter(F.col("confidence") >= ACCEPT).select("a", "b", "confidence")
    edges = cut(
        alike.join(left.select(F.col("id").alias("a"), *key), "a")
        .join(right.select(F.col("id").alias("b"), "cluster"), "b")
        .groupBy(*key, "cluster")
        .agg(F.max("confidence").alias("confidence"))
    )
    listed = cut(edges.join(_listings(edges, left), key))
    offers = listed.groupBy("provider", "listing", "cluster").agg(F.max("confidence").alias("confidence")).select(
        "provider", "listing", "cluster", "confidence",
        F.concat_ws("|", "provider", "listing").alias("left"), F.concat_ws("|", "provider", "cluster").alias("right"),
    )
    won = assign_one_to_one(offers).select("provider", "listing", "cluster")
    # Each record of a listing keeps the confidence of its own comparison.
    return listed.join(won, ["provider", "listing", "cluster"]).select(*key, "cluster", "confidence")


def unresolved_readings(spark: SparkSession, sf_dir: str, resolved: bool = False) -> DataFrame:
    identities = load(spark, sf_dir, "provider_identity").groupBy("provider", "provider_record_id").agg(F.max("entity_id").alias("entity"))
    wanted = identities.filter("entity IS NOT NULL" if resolved else "entity IS NULL")
    listed = load(spark, sf_dir, "provider_record").join(wanted, ["provider", "provider_record_id"]).withColumnRenamed("provider_record_id", "record_id")
    return _readings(listed, "name", "phone", "website", "full_address", F.col("city"), "latitude", "longitude", ["provider", "record_id"])


def entity_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "business_entity").withColumn("cluster", _cluster())
    return _readings(
        rows, "canonical_name", "canonical_phone", "canonical_website", "canonical_address", F.lit(None).cast("string"),
        "canonical_latitude", "canonical_longitude", ["cluster"],
    )


def _cluster() -> Column:
    return F.coalesce(F.concat(F.lit("g"), F.col("merge_group").cast("string")), F.concat(F.lit("e"), F.col("entity_id")))


def p2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches with their confidence; a merge group is one cluster."""
    return match_entities(unresolved_readings(spark, sf_dir), entity_readings(spark, sf_dir)).withColumnRenamed("record_id", "provider_record_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = load(spark, sf_dir, "business_entity").select("entity_id", _cluster().alias("cluster"))
    return p2_matches(spark, sf_dir).join(members, "cluster").select("provider", "provider_record_id", "entity_id").distinct()


QUERIES = {"p2_found": p2_found, "p2_matches": p2_matches}
SQL: dict[str, str] = {}
