"""Entity resolution between record pairs, batch deduplication and relocation.

Records are flat: name, phone, website, address, city, state, lat, lon, place_id, category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from amalgam.functions.compat import js_round, trim_blank
from amalgam.functions.geo import haversine, valid_position
from amalgam.functions.text import address_tokens, fuzzy_similarity, normalize_domain, normalize_phone
from amalgam.operators.joins import chunked_join

# Weights of the match signals.
WEIGHTS = {
    "name_exact": 0.35, "name_fuzzy": 0.25, "phone_exact": 0.30, "website_exact": 0.25, "coordinates_exact": 0.30,
    "coordinates_same_building": 0.16, "coordinates_near": 0.20, "address_exact": 0.30, "address_partial": 0.15,
    "city_match": 0.10, "state_match": 0.05, "place_id_match": 0.40, "cid_match": 0.35, "category_exact": 0.10,
    "category_similar": 0.05, "name_contradiction": -0.30, "address_contradiction": -0.25, "phone_contradiction": -0.25,
    "category_contradiction": -0.15,
}
COVERAGE_FLOOR = 0.8


def phone_signal(raw: Column, country: Column | None = None) -> Column:
    """Absent, normalized or unresolved."""
    return F.when(raw.isNull() | (trim_blank(raw) == ""), "absent").when(normalize_phone(raw, country).isNotNull(), "normalized").otherwise("unresolved")


def jaccard(a: Column, b: Column) -> Column:
    """U2."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def compare_locations(a: str, b: str) -> Column:
    """Same, different or unknown."""
    x, y = (lambda c: F.col(f"{a}{c}")), (lambda c: F.col(f"{b}{c}"))
    placed = valid_position(x("lat"), x("lon")) & valid_position(y("lat"), y("lon"))
    metres = haversine(x("lat"), x("lon"), y("lat"), y("lon"))
    p, q = address_tokens(x("address")), address_tokens(y("address"))
    similar = jaccard(p, q)
    number = lambda t: F.get(F.filter(t, lambda w: w.rlike("^[0-9]+$")), F.lit(0))
    known = F.coalesce((F.size(p) > 0) & (F.size(q) > 0), F.lit(False))
    return (
        F.when(placed, F.when(metres <= 100, "same").otherwise("different"))
        .when(~known, "unknown")
        .when(similar >= 0.9, "same")
        .when((number(p) == number(q)) & (similar >= 0.5), "same")
        .otherwise("different")
    )


def match_score(pairs: DataFrame, a: str = "a_", b: str = "b_", country: Column | None = None) -> DataFrame:
    """Adds score, coverage, location and match_type to pairs of records."""
    x, y = (lambda c: F.col(f"{a}{c}")), (lambda c: F.col(f"{b}{c}"))
    w = {k: F.lit(v) for k, v in WEIGHTS.items()}
    zero = F.lit(0.0)
    df = pairs.withColumns(
        {
            "_pa": normalize_phone(x("phone"), country), "_pb": normalize_phone(y("phone"), country),
            "_wa": normalize_domain(x("website")), "_wb": normalize_domain(y("website")),
            "_names": fuzzy_similarity(x("name"), y("name")),
            "_addresses": jaccard(address_tokens(x("address")), address_tokens(y("address"))),
            "location": compare_locations(a, b),
        }
    )
    full = lambda c: F.coalesce((x(c) != "") & (y(c) != ""), F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    low_equal = lambda c: yes(F.lower(x(c)) == F.lower(y(c)))
    phones = F.col("_pa").isNotNull() & F.col("_pb").isNotNull()
    phone = F.when(phones, F.when(F.col("_pa") == F.col("_pb"), w["phone_exact"]).otherwise(w["phone_contradiction"])).otherwise(zero)
    sites = F.col("_wa").isNotNull() & F.col("_wb").isNotNull()
    website = F.when(sites & yes(F.col("_wa") == F.col("_wb")), w["website_exact"]).otherwise(zero)
    placed = valid_position(x("lat"), x("lon")) & valid_position(y("lat"), y("lon"))
    metres = haversine(x("lat"), x("lon"), y("lat"), y("lon"))
    position = F.when(placed, F.when(metres <= 10, w["coordinates_exact"]).when(metres <= 50, w["coordinates_same_building"]).when(metres <= 100, w["coordinates_near"]).otherwise(zero)).otherwise(zero)
    s = F.col("_addresses")
    address = F.when(full("address"), F.when(s >= 0.9, w["address_exact"]).when(s >= 0.7, w["address_partial"]).when(s < 0.3, w["address_contradiction"]).otherwise(zero)).otherwise(zero)
    city = F.when(full("city") & low_equal("city"), w["city_match"]).otherwise(zero)
    state = F.when(full("state") & low_equal("state"), w["state_match"]).otherwise(zero)
    n = F.col("_names")
    name = F.when(full("name"), F.when(low_equal("name"), w["name_exact"]).when(n >= 0.8, w["name_fuzzy"]).when(n < 0.3, w["name_contradiction"]).otherwise(zero)).otherwise(zero)
    place = F.when(full("place_id") & yes(x("place_id") == y("place_id")), w["place_id_match"] + F.when(x("place_id").startswith("cid:"), w["cid_match"]).otherwise(zero)).otherwise(zero)
    category = F.when(
        full("category"), F.when(low_equal("category"), w["category_exact"]).when(fuzzy_similarity(x("category"), y("category")) >= 0.7, w["category_similar"]).otherwise(w["category_contradiction"])
    ).otherwise(zero)
    raw = phone + website + position + address + city + state + name + place + category
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    # Present on both sides though not comparable counts half (C1: absent is not unresolved).
    stated = lambda c: F.coalesce(trim_blank(c) != "", F.lit(False))
    half = F.when(stated(x("phone")) & stated(y("phone")) & ~phones, 0.5).otherwise(0.0)
    coverage = (one(full("name")) + one(phones) + one(sites) + one(full("address")) + half) / F.lit(4.0)
    clamped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))
    df = df.withColumn("coverage", coverage).withColumn(
        "score", F.when((clamped > 0) & (F.col("coverage") < 1), clamped * (F.lit(COVERAGE_FLOOR) + F.lit(1 - COVERAGE_FLOOR) * F.col("coverage"))).otherwise(clamped)
    )
    strong = full("name") & (low_equal("name") | (n >= 0.9))
    same_phone, phone_conflict = yes(F.col("_pa") == F.col("_pb")), phones & ~yes(F.col("_pa") == F.col("_pb"))
    same_domain = yes(F.col("_wa") == F.col("_wb"))
    elsewhere = F.col("location") == "different"
    contradicted = (full("name") & (n < 0.3)) | (full("address") & (s < 0.3)) | phone_conflict
    # Exact and near positions identify; the band between them (one building) does not.
    at_place = yes(placed & ((metres <= 10) | ((metres > 50) & (metres <= 100))))
    hard = same_phone | same_domain | at_place | (full("place_id") & yes(x("place_id") == y("place_id")))
    kind = (
        F.when(strong & same_domain & elsewhere & phone_conflict, "same_brand_different_location")
        .when(strong & same_phone & same_domain & elsewhere, "relocated_entity")
        .when(contradicted, "different_entity")
        .when((F.col("score") >= 0.85) & (strong | ~full("name")) & (F.col("location") == "same") & hard, "same_entity")
        .when(F.col("score") >= 0.5, "uncertain")
        .otherwise("different_entity")
    )
    return df.withColumn("match_type", kind).drop("_pa", "_pb", "_wa", "_wb", "_names", "_addresses")


def block_pairs(records: DataFrame, key: str, blocks: list[Column], chunk_rows: int = 200) -> DataFrame:
    """All pairs (a, b) of record keys that share a block key, a < b.

    A block is cut to chunks of about ``chunk_rows`` rows, and every chunk meets
    itself and every other chunk in a join key of its own. So no pair is lost,
    and a task holds two chunks of a block, however large, at a time."""
    keyed = records.select(F.col(key).alias("k"), F.explode(F.array_compact(F.array(*blocks))).alias("block")).distinct()
    counts = keyed.groupBy("block").agg(F.count("*").alias("n")).filter("n > 1")
    placed = (
        keyed.join(counts, "block")
        .withColumn("chunks", F.ceil(F.col("n") / chunk_rows))
        .withColumn("chunk", F.floor(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) * F.col("chunks") / (1 << 20)))
    )
    low = placed.select("block", F.col("k").alias("a"), F.col("chunk").alias("low"), F.explode(F.sequence("chunk", F.col("chunks") - 1)).alias("high"))
    high = placed.select("block", F.col("k").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), "chunk")).alias("low"), F.col("chunk").alias("high"))
    met = low.join(high, ["block", "low", "high"]).filter((F.col("low") < F.col("high")) | (F.col("a") < F.col("b")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def dedupe_and_fill(records: DataFrame, key: Column, seq: list[str], fields: list[str]) -> DataFrame:
    """One row per key: the first record's values, gaps filled by the later
    ones in order. Null keys stay rows of their own."""
    order = F.struct(*seq)
    keyed = records.withColumn("dedupe_key", F.coalesce(key, F.concat(F.lit("row:"), F.concat_ws("|", *[F.unix_micros(c).cast("string") if t == "timestamp" else F.col(c).cast("string") for c, t in ((c, dict(records.dtypes)[c]) for c in seq)]))))
    first = {c: F.min(F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.struct(order.alias("o"), F.col(c).alias("v")))) for c in fields}
    return keyed.groupBy("dedupe_key").agg(F.count("*").alias("n_records"), *[v["v"].alias(c) for c, v in first.items()])


def copy_pairs(sources: DataFrame, key: str, pos: str) -> DataFrame:
    """Pairs of sources of one key of which one copies the other."""
    a = sources.select(key, F.col(pos).alias("pos_a"), F.col("source_type").alias("type_a"), F.col("domain").alias("domain_a"))
    b = sources.select(key, F.col(pos).alias("pos_b"), F.col("source_type").alias("type_b"), F.col("domain").alias("domain_b"))
    # Other types copy nothing: they never meet.
    a, b = (side.filter(F.col(c).isin("directory", "structured_provider")) for side, c in ((a, "type_a"), (b, "type_b")))
    types = F.array_sort(F.array("type_a", "type_b"))
    copied = (types == F.array(F.lit("directory"), F.lit("structured_provider"))) | ((types == F.array(F.lit("directory"), F.lit("directory"))) & (F.col("domain_a") != F.col("domain_b")))
    return chunked_join(a, b, [key], "pos_a", "pos_b").filter((F.col("pos_a") < F.col("pos_b")) & F.coalesce(copied, F.lit(False))).select(key, "pos_a", "pos_b")


def relocation_verdicts(observations: DataFrame) -> DataFrame:
    """Per entity, whether a second address is a move, another branch or unclear.

    ``observations`` has entity_id, record, field (address, phone or website),
    value and observed_at; comparisons of times are in seconds."""
    t = F.col("observed_at").cast("double")
    firsts = observations.groupBy("entity_id", "field", "value").agg(F.min(t).alias("first_at"))
    facts = firsts.groupBy("entity_id").agg(
        F.count_if(F.col("field") == "address").alias("addresses"),
        F.count_if(F.col("field") == "phone").alias("phones"),
        F.count_if(F.col("field") == "website").alias("websites"),
        F.min(F.when(F.col("field") == "address", F.struct("first_at", "value"))).alias("first"),
    )
    # The earliest address that differs from the first; two minima, no list of addresses.
    later = (
        firsts.filter("field = 'address'").join(facts.select("entity_id", "first"), "entity_id").filter(F.col("value") != F.col("first.value"))
        .groupBy("entity_id").agg(F.min("first_at").alias("second_at"))
    )
    spans = observations.filter("field = 'address'").groupBy("entity_id", "record").agg(F.countDistinct("value").alias("n"))
    spanning = spans.groupBy("entity_id").agg(F.max(F.col("n") > 1).alias("spanned"))
    gap = F.col("second_at") - F.col("first.first_at")
    stable = (F.col("phones") == 1) | (F.col("websites") == 1) | F.coalesce("spanned", F.lit(False))
    changed = (F.col("phones") >= 2) | (F.col("websites") >= 2)
    verdict = (
        F.when(F.col("addresses") < 2, "uncertain")
        .when(gap <= 300, F.when(F.col("phones") >= 2, "same_brand_different_location").otherwise("uncertain"))
        .when(stable & ~changed, "relocated_entity")
        .otherwise("uncertain")
    )
    return facts.join(later, "entity_id", "left").join(spanning, "entity_id", "left").select(
        "entity_id", "addresses", "phones", "websites", js_round(gap, 0).alias("gap_seconds"), verdict.alias("verdict")
    )
