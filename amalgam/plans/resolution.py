"""Queries of entity resolution over the business tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from amalgam.operators import resolve as R
from amalgam.operators.validate import record_conflicts
from amalgam.functions import compat as C, geo as G, text as T
from amalgam.operators.joins import chunked_join
from amalgam.plans.scalars import _NANP, _PARTS, _TRIM, _ZIP, _sql_map
from amalgam.runtime import load

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_IDS = "(SELECT DISTINCT provider, provider_record_id, entity_id FROM provider_identity WHERE entity_id IS NOT NULL)"
_RECORD = "SELECT DISTINCT ON (provider, provider_record_id) * FROM provider_record ORDER BY provider, provider_record_id, ingested_at DESC, fetched_at DESC"


def latest_records(spark: SparkSession, sf: str) -> DataFrame:
    """The last delivery of every provider record."""
    rows = load(spark, sf, "provider_record")
    keys = ["provider", "provider_record_id"]
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max(F.struct("ingested_at", "fetched_at", *[c for c in rest if c not in ("ingested_at", "fetched_at")])).alias("m"))
    return newest.select(*keys, "m.*")


def resolved_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every resolved provider record beside its entity row."""
    ids = load(spark, sf, "provider_identity").filter("entity_id IS NOT NULL").select("provider", "provider_record_id", "entity_id").distinct()
    a = load(spark, sf, "provider_record").select(
        "provider", "provider_record_id", "fetched_at", "ingested_at", F.col("name").alias("a_name"), F.col("phone").alias("a_phone"), F.col("website").alias("a_website"),
        F.col("full_address").alias("a_address"), F.col("city").alias("a_city"), F.lit(None).cast("string").alias("a_state"), F.col("latitude").alias("a_lat"), F.col("longitude").alias("a_lon"),
        F.col("category").alias("a_category"), F.col("provider_record_id").alias("a_place_id"),
    )
    b = load(spark, sf, "business_entity").select(
        "entity_id", F.col("canonical_name").alias("b_name"), F.col("canonical_phone").alias("b_phone"), F.col("canonical_website").alias("b_website"), F.col("canonical_address").alias("b_address"),
        F.lit(None).cast("string").alias("b_city"), F.lit(None).cast("string").alias("b_state"), F.col("canonical_latitude").alias("b_lat"), F.col("canonical_longitude").alias("b_lon"),
        F.col("category").alias("b_category"), F.lit(None).cast("string").alias("b_place_id"),
    )
    return a.join(ids, ["provider", "provider_record_id"]).join(b, "entity_id")


def _tokens(x: str) -> str:
    words = f"list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[.,#]|{C.BLANK}', ' ', 'g'), ' +'), lambda x: x <> '')"
    return f"list_transform({words}, lambda x: coalesce({_sql_map(T.STREET_WORDS, 'x')}, x))"


def _e164(t: str) -> str:
    d, s = f"regexp_replace({t}, '[^0-9]', '', 'g')", _TRIM(t)
    return f"""coalesce(CASE WHEN (starts_with({s}, '+') OR starts_with({s}, 'tel:+')) AND starts_with({d}, '1') AND regexp_matches(substr({d}, 2), {_NANP}) THEN '+' || {d} END,
      CASE WHEN starts_with({d}, '00') AND starts_with(substr({d}, 3), '1') AND regexp_matches(substr({d}, 4), {_NANP}) THEN '+' || substr({d}, 3) END,
      CASE WHEN regexp_matches(CASE WHEN length({d}) = 11 THEN regexp_replace({d}, '^1', '') ELSE {d} END, {_NANP}) THEN '+1' || CASE WHEN length({d}) = 11 THEN regexp_replace({d}, '^1', '') ELSE {d} END END)"""


_HOST = lambda x: f"nullif(regexp_replace(regexp_extract(lower({_TRIM(x)}), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@ ]*@)?([^/?#: ]+)', 1), '^www\\.', ''), '')"


def _fuzzy(a: str, b: str) -> str:
    x, y = f"lower({_TRIM(a)})", f"lower({_TRIM(b)})"
    return f"""CASE WHEN {x} IS NULL OR {y} IS NULL OR {x} = '' OR {y} = '' THEN 0.0 WHEN {x} = {y} THEN 1.0
      WHEN substr({x}, 1, least(3, length({x}), length({y}))::BIGINT) = substr({y}, 1, least(3, length({x}), length({y}))::BIGINT) THEN 0.8 + 0.2 * least(length({x}), length({y})) / greatest(length({x}), length({y}))
      ELSE len(list_intersect(list_distinct(string_split({x}, '')), list_distinct(string_split({y}, '')))) / len(list_distinct(list_concat(list_distinct(string_split({x}, '')), list_distinct(string_split({y}, ''))))) END"""


_SCORED = f"""
p AS (SELECT p.provider, p.provider_record_id, p.fetched_at, p.ingested_at, entity_id, name AS na, canonical_name AS nb, p.category AS ca, b.category AS cb, full_address AS aa, canonical_address AS ab,
        {_e164('phone')} AS pa, {_e164('canonical_phone')} AS pb, phone IS NOT NULL AND {_TRIM('phone')} <> '' AS ha, canonical_phone IS NOT NULL AND {_TRIM('canonical_phone')} <> '' AS hb,
        {_HOST('website')} AS wa, {_HOST('canonical_website')} AS wb, {_tokens('full_address')} AS ta, {_tokens('canonical_address')} AS tb,
        {_fuzzy('name', 'canonical_name')} AS ns, {_fuzzy('p.category', 'b.category')} AS cs,
        coalesce(abs(latitude) <= 90 AND abs(longitude) <= 180 AND abs(canonical_latitude) <= 90 AND abs(canonical_longitude) <= 180, false) AS placed,
        pow(sin(radians(canonical_latitude - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(canonical_latitude)) * pow(sin(radians(canonical_longitude - longitude) / 2), 2) AS h
      FROM provider_record p JOIN {_IDS} i USING (provider, provider_record_id) JOIN business_entity b USING (entity_id)),
q AS (SELECT *, CASE WHEN placed THEN 2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)) END AS m,
        CASE WHEN len(list_distinct(list_concat(ta, tb))) > 0 THEN len(list_distinct(list_intersect(ta, tb))) / len(list_distinct(list_concat(ta, tb))) ELSE 0.0 END AS s,
        coalesce(na <> '' AND nb <> '', false) AS fn, coalesce(aa <> '' AND ab <> '', false) AS fa, coalesce(ca <> '' AND cb <> '', false) AS fc, pa IS NOT NULL AND pb IS NOT NULL AS fp, wa IS NOT NULL AND wb IS NOT NULL AS fw FROM p),
r AS (SELECT *, CASE WHEN fp THEN CASE WHEN pa = pb THEN 0.30 ELSE -0.25 END ELSE 0.0 END + CASE WHEN fw AND wa = wb THEN 0.25 ELSE 0.0 END
        + CASE WHEN m <= 10 THEN 0.30 WHEN m <= 50 THEN 0.16 WHEN m <= 100 THEN 0.20 ELSE 0.0 END
        + CASE WHEN fa THEN CASE WHEN s >= 0.9 THEN 0.30 WHEN s >= 0.7 THEN 0.15 WHEN s < 0.3 THEN -0.25 ELSE 0.0 END ELSE 0.0 END
        + CASE WHEN fn THEN CASE WHEN lower(na) = lower(nb) THEN 0.35 WHEN ns >= 0.8 THEN 0.25 WHEN ns < 0.3 THEN -0.30 ELSE 0.0 END ELSE 0.0 END
        + CASE WHEN fc THEN CASE WHEN lower(ca) = lower(cb) THEN 0.10 WHEN cs >= 0.7 THEN 0.05 ELSE -0.15 END ELSE 0.0 END AS raw,
        (CASE WHEN fn THEN 1.0 ELSE 0.0 END + CASE WHEN fp THEN 1.0 ELSE 0.0 END + CASE WHEN fw THEN 1.0 ELSE 0.0 END + CASE WHEN fa THEN 1.0 ELSE 0.0 END + CASE WHEN ha AND hb AND NOT fp THEN 0.5 ELSE 0.0 END) / 4.0 AS coverage,
        CASE WHEN placed THEN CASE WHEN m <= 100 THEN 'same' ELSE 'different' END WHEN NOT coalesce(len(ta) > 0 AND len(tb) > 0, false) THEN 'unknown' WHEN s >= 0.9 THEN 'same'
             WHEN list_filter(ta, lambda x: regexp_matches(x, '^[0-9]+$'))[1] = list_filter(tb, lambda x: regexp_matches(x, '^[0-9]+$'))[1] AND s >= 0.5 THEN 'same' ELSE 'different' END AS location FROM q),
t AS (SELECT *, CASE WHEN greatest(-1.0, least(1.0, raw)) > 0 AND coverage < 1 THEN greatest(-1.0, least(1.0, raw)) * (0.8 + 0.2 * coverage) ELSE greatest(-1.0, least(1.0, raw)) END AS score,
        fn AND (lower(na) = lower(nb) OR ns >= 0.9) AS strong, coalesce(pa = pb, false) AS sp, coalesce(wa = wb, false) AS sw FROM r),
scored AS (SELECT *, CASE WHEN strong AND sw AND location = 'different' AND fp AND NOT sp THEN 'same_brand_different_location' WHEN strong AND sp AND sw AND location = 'different' THEN 'relocated_entity'
        WHEN (fn AND ns < 0.3) OR (fa AND s < 0.3) OR (fp AND NOT sp) THEN 'different_entity' WHEN score >= 0.85 AND (strong OR NOT fn) AND location = 'same' AND (sp OR sw OR coalesce(m <= 10 OR (m > 50 AND m <= 100), false)) THEN 'same_entity'
        WHEN score >= 0.5 THEN 'uncertain' ELSE 'different_entity' END AS match_type FROM t)"""


@query(
    "c01_c05_match_scores",
    f"WITH {_SCORED} SELECT provider, provider_record_id, epoch_us(fetched_at) AS fetched_us, epoch_us(ingested_at) AS ingested_us, entity_id, round(score, 6) AS score, round(coverage, 4) AS coverage, location, match_type FROM scored",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return R.match_score(resolved_pairs(spark, sf), country=F.lit("US")).select(
        "provider", "provider_record_id", F.unix_micros(F.col("fetched_at").cast("timestamp")).alias("fetched_us"), F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("ingested_us"), "entity_id", F.round("score", 6).alias("score"), F.round("coverage", 4).alias("coverage"), "location", "match_type"
    )


@query("c06_merge_policy", f"""WITH {_SCORED} SELECT match_type, count(*) AS pairs, CASE WHEN match_type IN ('same_entity', 'uncertain') THEN 'gaps' WHEN match_type = 'different_entity' THEN 'descriptive_only' ELSE 'none' END AS merge FROM scored GROUP BY 1""")
def _(spark, sf):
    scored = R.match_score(resolved_pairs(spark, sf), country=F.lit("US"))
    merge = F.when(F.col("match_type").isin("same_entity", "uncertain"), "gaps").when(F.col("match_type") == "different_entity", "descriptive_only").otherwise("none")
    return scored.groupBy("match_type").agg(F.count("*").alias("pairs")).withColumn("merge", merge)


@query(
    "c07_batch_dedupe",
    f"""WITH k AS (SELECT *, coalesce(CASE WHEN provider = 'google_maps' AND {_TRIM('provider_record_id')} <> '' THEN 'place:' || {_TRIM('provider_record_id')} WHEN {_TRIM('website')} <> '' THEN 'url:' || {_TRIM('website')}
              WHEN {_TRIM('name')} <> '' AND {_TRIM('full_address')} <> '' THEN 'nameaddr:' || lower({_TRIM('name')}) || '|' || lower({_TRIM('full_address')}) WHEN {_TRIM('name')} <> '' THEN 'name:' || lower({_TRIM('name')}) END,
              'row:' || epoch_us(fetched_at) || '|' || provider || '|' || provider_record_id) AS dedupe_key FROM provider_record)
        SELECT dedupe_key, count(*) AS n_records, arg_min(name, (fetched_at, provider, provider_record_id)) FILTER (WHERE name <> '') AS name,
          arg_min(phone, (fetched_at, provider, provider_record_id)) FILTER (WHERE phone <> '') AS phone, arg_min(website, (fetched_at, provider, provider_record_id)) FILTER (WHERE website <> '') AS website
        FROM k GROUP BY 1""",
)
def _(spark, sf):
    place = F.when(F.col("provider") == "google_maps", F.col("provider_record_id"))
    key = T.dedupe_key(place, F.col("website"), F.col("name"), F.col("full_address"))
    rows = load(spark, sf, "provider_record").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    return R.dedupe_and_fill(rows, key, ["fetched_at", "provider", "provider_record_id"], ["name", "phone", "website"])


@query(
    "j01_blocked_pairs",
    f"""WITH b AS (SELECT entity_id, 'p:' || {_e164('canonical_phone')} AS block FROM business_entity UNION SELECT entity_id, 'd:' || {_HOST('canonical_website')} FROM business_entity)
        SELECT x.entity_id AS a, y.entity_id AS b FROM b x JOIN b y ON x.block = y.block AND x.entity_id < y.entity_id GROUP BY 1, 2""",
)
def _(spark, sf):
    rows = load(spark, sf, "business_entity")
    blocks = [F.concat(F.lit("p:"), T.normalize_phone(F.col("canonical_phone"), F.lit("US"))), F.concat(F.lit("d:"), T.normalize_domain(F.col("canonical_website")))]
    return R.block_pairs(rows, "entity_id", blocks)


_GROUPED = "(SELECT b.entity_id, b.merge_group, s.source_type, s.domain, s.id FROM business_entity b JOIN source_ref s ON b.source_id = s.id WHERE merge_group IS NOT NULL)"


@query(
    "j09_copies",
    f"""SELECT x.merge_group, x.id AS pos_a, y.id AS pos_b FROM {_GROUPED} x JOIN {_GROUPED} y ON x.merge_group = y.merge_group AND x.id < y.id
        WHERE (x.source_type = 'directory' AND y.source_type = 'structured_provider') OR (y.source_type = 'directory' AND x.source_type = 'structured_provider') OR (x.source_type = 'directory' AND y.source_type = 'directory' AND x.domain <> y.domain)""",
)
def _(spark, sf):
    b = load(spark, sf, "business_entity").filter("merge_group IS NOT NULL").select("merge_group", F.col("source_id").alias("id"))
    return R.copy_pairs(b.join(load(spark, sf, "source_ref").select("id", "source_type", "domain"), "id"), "merge_group", "id")


@query(
    "j10_nearest_record",
    f"""SELECT entity_id, arg_min(provider || '|' || provider_record_id, (round(sqrt(pow(latitude - canonical_latitude, 2) + pow(longitude - canonical_longitude, 2)), 9), provider || '|' || provider_record_id)) AS nearest,
          round(min(sqrt(pow(latitude - canonical_latitude, 2) + pow(longitude - canonical_longitude, 2))), 6) AS degrees
        FROM provider_record p JOIN {_IDS} i USING (provider, provider_record_id) JOIN business_entity b USING (entity_id)
        WHERE sqrt(pow(latitude - canonical_latitude, 2) + pow(longitude - canonical_longitude, 2)) <= 0.35 GROUP BY 1""",
)
def _(spark, sf):
    x = resolved_pairs(spark, sf).withColumn("d", G.degree_distance(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))).filter("d <= 0.35")
    rec = F.concat_ws("|", "provider", "provider_record_id")
    return x.groupBy("entity_id").agg(F.min(F.struct(F.round("d", 9).alias("d"), rec.alias("r"))).alias("m"), F.round(F.min("d"), 6).alias("degrees")).select("entity_id", F.col("m.r").alias("nearest"), "degrees")


@query(
    "j11_provider_agreement",
    f"""WITH x AS (SELECT DISTINCT entity_id, provider, {_e164('phone')} AS v FROM provider_record JOIN {_IDS} i USING (provider, provider_record_id) WHERE {_e164('phone')} IS NOT NULL)
        SELECT a.provider AS provider_a, b.provider AS provider_b, count(*) AS compared, count(*) FILTER (WHERE a.v = b.v) AS agreed FROM x a JOIN x b ON a.entity_id = b.entity_id AND a.provider < b.provider GROUP BY 1, 2""",
)
def _(spark, sf):
    x = resolved_pairs(spark, sf).select("entity_id", "provider", T.normalize_phone(F.col("a_phone"), F.lit("US")).alias("v")).filter("v IS NOT NULL").distinct()
    y = x.select("entity_id", F.col("provider").alias("provider_b"), F.col("v").alias("w"))
    return (
        x.withColumnRenamed("provider", "provider_a").join(y, "entity_id").filter("provider_a < provider_b")
        .groupBy("provider_a", "provider_b").agg(F.count("*").alias("compared"), F.count_if(F.col("v") == F.col("w")).alias("agreed"))
    )


_OF_ENTITY = f"""x AS (SELECT DISTINCT entity_id, provider, provider_record_id, lower({_TRIM('city')}) AS city, lower(CASE WHEN regexp_matches(part3, {_ZIP}) THEN regexp_extract(part3, {_ZIP}, 1) ELSE part3 END) AS state,
          lower(CASE WHEN regexp_matches(part3, {_ZIP}) THEN regexp_extract(part3, {_ZIP}, 2) END) AS zip, latitude, longitude, coalesce(abs(latitude) <= 90 AND abs(longitude) <= 180, false) AS placed, regexp_replace(phone, '[^0-9]', '', 'g') AS d, {_TRIM('provider_record_id')} AS pid
        FROM (SELECT *, ({_PARTS})[3] AS part3 FROM provider_record) JOIN {_IDS} i USING (provider, provider_record_id)),
      y AS (SELECT a.*, b.provider AS provider_b, b.provider_record_id AS id_b, b.city AS city_b, b.state AS state_b, b.zip AS zip_b, b.latitude AS lat_b, b.longitude AS lon_b, b.placed AS placed_b, b.d AS d_b, b.pid AS pid_b
        FROM x a JOIN x b ON a.entity_id = b.entity_id AND (a.provider, a.provider_record_id) < (b.provider, b.provider_record_id))"""


def records_of_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct states of the resolved records of each entity."""
    ids = load(spark, sf, "provider_identity").filter("entity_id IS NOT NULL").select("provider", "provider_record_id", "entity_id").distinct()
    place = T.parse_comma_address(F.col("full_address"))
    rows = load(spark, sf, "provider_record").join(ids, ["provider", "provider_record_id"])
    return rows.select(
        "entity_id", "provider", "provider_record_id", F.lower(C.trim_blank(F.col("city"))).alias("city"), F.lower(place["state"]).alias("state"), F.lower(place["postal_code"]).alias("postal_code"),
        "latitude", "longitude", T.digits(F.col("phone")).alias("phone"),
    ).distinct()


@query(
    "f16_hard_conflicts",
    f"""WITH {_OF_ENTITY} SELECT conflict, count(*) AS n FROM (SELECT unnest(list_filter([
            CASE WHEN city <> '' AND city_b <> '' AND city <> city_b THEN 'city' END, CASE WHEN state <> '' AND state_b <> '' AND state <> state_b THEN 'state' END, CASE WHEN zip <> '' AND zip_b <> '' AND zip <> zip_b THEN 'postalCode' END,
            CASE WHEN placed AND placed_b AND sqrt(pow(latitude - lat_b, 2) + pow(longitude - lon_b, 2)) > 0.35 THEN 'coordinates' END, CASE WHEN pid <> '' AND pid_b <> '' AND pid <> pid_b THEN 'providerId' END,
            CASE WHEN length(d) >= 7 AND length(d_b) >= 7 AND d <> d_b THEN 'phone' END], lambda x: x IS NOT NULL)) AS conflict FROM y) GROUP BY 1""",
)
def _(spark, sf):
    rows = records_of_entities(spark, sf)
    named = lambda p: rows.select("entity_id", *[F.col(c).alias(p + c) for c in rows.columns if c != "entity_id"])
    key = lambda p: F.struct(F.col(f"{p}provider"), F.col(f"{p}provider_record_id"))
    pairs = chunked_join(named("a_"), named("b_"), ["entity_id"], "a_provider_record_id", "b_provider_record_id").filter(key("a_") < key("b_"))
    return pairs.select(F.explode(record_conflicts("a_", "b_")).alias("conflict")).groupBy("conflict").agg(F.count("*").alias("n"))


_OBS = """obs AS (SELECT merge_group AS entity_id, s.id AS record, field, value, retrieved_at AS observed_at FROM business_entity b JOIN source_ref s ON b.source_id = s.id
           CROSS JOIN LATERAL (VALUES ('address', lower(trim(canonical_address))), ('phone', right(regexp_replace(canonical_phone, '[^0-9]', '', 'g'), 10)), ('website', """ + _HOST("canonical_website") + """)) v(field, value)
           WHERE merge_group IS NOT NULL AND value <> '' AND retrieved_at IS NOT NULL)"""


@query(
    "e01_relocations",
    f"""WITH {_OBS}, f AS (SELECT entity_id, field, value, min(epoch(observed_at)) AS t FROM obs GROUP BY 1, 2, 3),
        g AS (SELECT entity_id, count(*) FILTER (WHERE field = 'address') AS addresses, count(*) FILTER (WHERE field = 'phone') AS phones, count(*) FILTER (WHERE field = 'website') AS websites,
                list_sort(list(t) FILTER (WHERE field = 'address')) AS seen FROM f GROUP BY 1),
        s AS (SELECT entity_id, max(n) > 1 AS spanned FROM (SELECT entity_id, record, count(DISTINCT value) AS n FROM obs WHERE field = 'address' GROUP BY 1, 2) GROUP BY 1),
        j AS (SELECT *, seen[2] - seen[1] AS gap, phones = 1 OR websites = 1 OR coalesce(spanned, false) AS stable FROM g LEFT JOIN s USING (entity_id))
        SELECT entity_id, addresses, phones, websites, floor(gap + 0.5) AS gap_seconds, CASE WHEN addresses < 2 THEN 'uncertain' WHEN gap <= 300 THEN CASE WHEN phones >= 2 THEN 'same_brand_different_location' ELSE 'uncertain' END
          WHEN stable AND NOT (phones >= 2 OR websites >= 2) THEN 'relocated_entity' ELSE 'uncertain' END AS verdict FROM j""",
)
def _(spark, sf):
    rows = load(spark, sf, "business_entity").filter("merge_group IS NOT NULL").join(load(spark, sf, "source_ref").select(F.col("id").alias("source_id"), "retrieved_at"), "source_id")
    values = F.array(
        F.struct(F.lit("address").alias("field"), F.lower(F.trim("canonical_address")).alias("value")),
        F.struct(F.lit("phone").alias("field"), F.right(T.digits(F.col("canonical_phone")), F.lit(10)).alias("value")),
        F.struct(F.lit("website").alias("field"), T.normalize_domain(F.col("canonical_website")).alias("value")),
    )
    obs = rows.filter("retrieved_at IS NOT NULL").select(F.col("merge_group").alias("entity_id"), F.col("source_id").alias("record"), F.explode(values).alias("v"), F.col("retrieved_at").cast("timestamp").alias("observed_at"))
    return R.relocation_verdicts(obs.select("entity_id", "record", "v.*", "observed_at").filter("value <> ''"))
