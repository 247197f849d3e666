"""Queries of extraction, JSON handling, sets, sorts and the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from amalgam.functions import compat as C, extract as X, hours as H, jsonx as J, text as T
from amalgam.operators import store as S
from amalgam.plans.scalars import _TRIM
from amalgam.runtime import load
from amalgam.sources.tables import feature_records, hydrate, user_records

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _authority() -> F.Column:
    """Authority on the scale from 0 to 1; some sources state it in percent."""
    return F.when(F.col("authority") > 1, F.col("authority") / 100).otherwise(F.col("authority"))


def _page(spark: SparkSession, sf: str) -> DataFrame:
    """Pages made of the business rows: markup around their values."""
    b = load(spark, sf, "business_entity")
    part = lambda c: F.coalesce(F.regexp_replace(F.col(c), "[<>\"'&\\\\\\n]", " "), F.lit(""))
    html = F.concat(
        F.lit("<html><head><style>p {color: red}</style><script>var x = 1;</script><meta property=\"og:title\" content=\""), part("canonical_name"), F.lit("\"></head><!-- shell --><body><h1 itemprop=\"name\">"),
        part("canonical_name"), F.lit("</h1><p>Address: "), part("canonical_address"), F.lit("</p><p itemprop=\"telephone\">"), part("canonical_phone"), F.lit("</p></body></html>"),
    )
    return b.select("entity_id", html.alias("html"))


_PART = lambda c: f"coalesce(regexp_replace({c}, '[<>\"''&\\\\\\n]', ' ', 'g'), '')"
_NORM = lambda x: f"trim(regexp_replace({x}, '{C.BLANK}+', ' ', 'g'))"


@query(
    "x02_x03_x04_pages",
    f"""SELECT entity_id, {_NORM("regexp_replace(" + _PART("canonical_name") + ", '^$', '', 'g')")} AS og_title, {_NORM(_PART("canonical_name"))} AS item_name, {_NORM(_PART("canonical_phone"))} AS item_phone,
          {_NORM(_PART("canonical_name") + " || ' Address: ' || " + _PART("canonical_address") + " || ' ' || " + _PART("canonical_phone"))} AS visible FROM business_entity""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    h = F.col("html")
    og, item = X.open_graph(h), X.microdata(h)
    return _page(spark, sf).select(
        "entity_id", F.try_element_at(og, F.lit("title")).alias("og_title"), F.try_element_at(item, F.lit("name")).alias("item_name"), F.try_element_at(item, F.lit("telephone")).alias("item_phone"), X.visible_text(h).alias("visible")
    )


@query("x01_x05_page_records")
def _(spark, sf):
    ld = F.to_json(F.struct(F.col("canonical_name").alias("name"), F.col("canonical_phone").alias("telephone"), F.struct(F.col("canonical_latitude").alias("latitude"), F.col("canonical_longitude").alias("longitude")).alias("geo")))
    html = F.concat(F.lit("<script type=\"application/ld+json\">"), ld, F.lit("</script><script type=\"application/ld+json\">{bad</script>"))
    return load(spark, sf, "business_entity").select("entity_id", X.page_record(html).alias("r")).select("entity_id", "r.name", "r.phone", "r.latitude", "r.longitude")


@query(
    "x06_x07_map_links",
    """SELECT provider, provider_record_id, 'place' AS kind, CASE WHEN abs(latitude) <= 90 AND abs(longitude) <= 180 THEN round(latitude, 6) END AS lat, CASE WHEN abs(latitude) <= 90 AND abs(longitude) <= 180 THEN round(longitude, 6) END AS lng, CASE WHEN provider_record_id LIKE 'ChIJ%' THEN provider_record_id END AS place_id,
         coalesce(regexp_matches(provider_record_id, '^ChIJ[A-Za-z0-9_-]{23,}$'), false) AS valid_id
       FROM (SELECT DISTINCT provider, provider_record_id, latitude, longitude FROM provider_record WHERE provider = 'google_maps' AND latitude IS NOT NULL AND longitude IS NOT NULL)""",
)
def _(spark, sf):
    rows = load(spark, sf, "provider_record").filter("provider = 'google_maps' AND latitude IS NOT NULL AND longitude IS NOT NULL").select("provider", "provider_record_id", "latitude", "longitude").distinct()
    url = F.concat(F.lit("https://www.google.com/maps/place/Some+Place/@"), F.format_string("%.6f,%.6f", "latitude", "longitude"), F.lit(",17z/data=!1s"), F.col("provider_record_id"))
    m = X.maps_link(url)
    return rows.select("provider", "provider_record_id", m["kind"].alias("kind"), m["lat"].alias("lat"), m["lng"].alias("lng"), m["place_id"].alias("place_id"), X.valid_place_id(F.col("provider_record_id")).alias("valid_id"))


@query(
    "x08_cids",
    """SELECT l_orderkey, l_linenumber, (l_orderkey * 1000003 + l_linenumber)::VARCHAR AS cid FROM lineitem""",
)
def _(spark, sf):
    n = F.col("l_orderkey") * 1000003 + F.col("l_linenumber")
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.hex_cid(F.concat(F.lit("0x1:0x"), F.hex(n))).alias("cid"))


@query(
    "x09_stated_ratings",
    """SELECT provider, provider_record_id, count(*) AS n, round(sum(CASE WHEN floor(rating * 10 + 0.5) / 10 BETWEEN 1 AND 5 THEN floor(rating * 10 + 0.5) / 10 END), 4) AS rating, sum(review_count)::BIGINT AS reviews FROM provider_record WHERE rating BETWEEN 1 AND 5 AND review_count >= 0 GROUP BY 1, 2""",
)
def _(spark, sf):
    rows = load(spark, sf, "provider_record").filter("rating BETWEEN 1 AND 5 AND review_count >= 0")
    text = F.concat(F.lit("Rated "), F.format_string("%.1f", C.js_round(F.col("rating"), 1)), F.lit(" by many, "), F.format_number("review_count", 0), F.lit(" Google reviews"))
    return rows.groupBy("provider", "provider_record_id").agg(F.count("*").alias("n"), F.round(F.sum(X.rating_in_text(text)), 4).alias("rating"), F.sum(X.count_in_text(text)).alias("reviews"))


_SCHEMA = {
    "type": "object", "required": ["name", "phone", "address", "category", "services"],
    "properties": {
        "name": {"type": "string", "minLength": 1}, "phone": {"type": ["string", "null"]}, "address": {"type": ["string", "null"]}, "category": {"type": ["string", "null"]},
        "services": {"type": "array", "items": {"type": "string"}},
    },
    "additionalProperties": False,
}


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    role = F.lower(F.trim("role"))
    return load(spark, sf, "chat_message").filter(role.isin("assistant", "model")).select("conv_id", "turn", "content").distinct()


@query("x14_recovered_json")
def _(spark, sf):
    return _answers(spark, sf).select("conv_id", "turn", J.recovered_json(F.col("content")).alias("json")).filter("json IS NOT NULL")


@query("f18_f19_schema_errors")
def _(spark, sf):
    """Contract errors of recovered JSON by rule."""
    rows = _answers(spark, sf).select(J.recovered_json(F.col("content")).alias("json")).filter("json IS NOT NULL")
    return rows.select(F.coalesce(J.json_schema_error(F.col("json"), _SCHEMA), F.lit("ok")).alias("error")).groupBy("error").agg(F.count("*").alias("n"))


@query(
    "a12_json_answers",
    f"""SELECT count(*) AS answers, count(*) FILTER (WHERE json_valid({_TRIM('content')}) AND regexp_matches({_TRIM('content')}, '^[{{\\[]')) AS valid_json,
          floor(100.0 * count(*) FILTER (WHERE json_valid({_TRIM('content')}) AND regexp_matches({_TRIM('content')}, '^[{{\\[]')) / count(*) * 100.0 + 0.5) / 100.0 AS pct
        FROM (SELECT DISTINCT conv_id, turn, content FROM chat_message WHERE lower(trim(role)) IN ('assistant', 'model') AND content IS NOT NULL)""",
)
def _(spark, sf):
    a = _answers(spark, sf).filter("content IS NOT NULL")
    ok = F.count_if(T.parse_structure(F.col("content")).isNotNull())
    return a.agg(F.count("*").alias("answers"), ok.alias("valid_json"), C.js_round(F.lit(100.0) * ok / F.count("*"), 2).alias("pct"))


@query(
    "d01_d03_hours",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'closed' ELSE printf('%02d:00-%02d:30', p_size % 10 + 1, p_size % 10 + 10) END AS monday,
         CASE WHEN p_size % 3 = 0 THEN 'Monday: closed' ELSE 'Monday: ' || printf('%02d:00-%02d:30', p_size % 10 + 1, p_size % 10 + 10) || ' · Tuesday: ' || printf('%02d:00-%02d:30', p_size % 10 + 1, p_size % 10 + 10) END AS line FROM part""",
)
def _(spark, sf):
    span = F.format_string("%02d:00 - %02d:30", F.col("p_size") % 10 + 1, F.col("p_size") % 10 + 10)
    text = F.when(F.col("p_size") % 3 == 0, F.lit("Mo Closed")).otherwise(F.concat(F.lit("Mo-Tu "), span))
    m = H.hours_map(text)
    return load(spark, sf, "part").select("p_partkey", F.try_element_at(m, F.lit("monday")).alias("monday"), H.hours_text(m).alias("line"))


@query(
    "u01_u05_token_sets",
    """WITH t AS (SELECT entity_id, list_distinct(string_split(lower(canonical_name), ' ')) AS a, list_distinct(string_split(lower(canonical_address), ' ')) AS b FROM business_entity WHERE canonical_name IS NOT NULL AND canonical_address IS NOT NULL)
       SELECT entity_id, len(list_intersect(a, b)) AS shared, len(list_distinct(list_concat(a, b))) AS either, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS name_only FROM t""",
)
def _(spark, sf):
    a, b = F.array_distinct(F.split(F.lower("canonical_name"), " ")), F.array_distinct(F.split(F.lower("canonical_address"), " "))
    return load(spark, sf, "business_entity").filter("canonical_name IS NOT NULL AND canonical_address IS NOT NULL").select(
        "entity_id", F.size(F.array_intersect(a, b)).cast("long").alias("shared"), F.size(F.array_union(a, b)).cast("long").alias("either"), F.size(F.array_except(a, b)).cast("long").alias("name_only")
    )


@query(
    "u03_taxonomies",
    """SELECT merge_group, array_to_string(list_sort(list(DISTINCT category))[1:12], '|') AS taxonomy FROM business_entity WHERE merge_group IS NOT NULL AND category IS NOT NULL GROUP BY 1""",
)
def _(spark, sf):
    b = load(spark, sf, "business_entity").filter("merge_group IS NOT NULL AND category IS NOT NULL")
    return b.groupBy("merge_group").agg(F.array_join(F.slice(F.array_sort(F.collect_set("category")), 1, 12), "|").alias("taxonomy"))


@query("t02_top_sources", "SELECT provider, id, authority FROM (SELECT provider, id, CASE WHEN authority > 1 THEN authority / 100 ELSE authority END AS authority FROM source_ref WHERE authority IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY provider ORDER BY authority DESC, id) <= 3")
def _(spark, sf):
    s = load(spark, sf, "source_ref").filter("authority IS NOT NULL").select("provider", "id", _authority().alias("authority"))
    # Three of each part first: a provider with most rows is not sorted in one task.
    part = W.partitionBy("provider", "salt").orderBy(F.desc("authority"), "id")
    near = s.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(32))).withColumn("r", F.row_number().over(part)).filter("r <= 3")
    return near.withColumn("r", F.row_number().over(W.partitionBy("provider").orderBy(F.desc("authority"), "id"))).filter("r <= 3").select("provider", "id", "authority")


@query("t03_routing", "SELECT entity, arg_min(provider, (tier, -n, provider)) AS first_choice FROM (SELECT merge_group AS entity, s.provider, CASE s.provider WHEN 'official_website' THEN 0 WHEN 'google_maps' THEN 1 WHEN 'geoapify' THEN 1 ELSE 2 END AS tier, count(*) AS n FROM business_entity b JOIN source_ref s ON b.source_id = s.id WHERE merge_group IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1")
def _(spark, sf):
    b = load(spark, sf, "business_entity").filter("merge_group IS NOT NULL").select("merge_group", F.col("source_id").alias("id")).join(load(spark, sf, "source_ref").select("id", "provider"), "id")
    tier = F.when(F.col("provider") == "official_website", 0).when(F.col("provider").isin("google_maps", "geoapify"), 1).otherwise(2)
    n = b.groupBy(F.col("merge_group").alias("entity"), "provider", tier.alias("tier")).agg(F.count("*").alias("n"))
    return n.groupBy("entity").agg(F.min_by("provider", F.struct("tier", -F.col("n"), "provider")).alias("first_choice"))


@query("t04_t05_history", "SELECT id, provider_record_id_a, match_score FROM resolution_record WHERE provider_record_id_a IS NOT NULL ORDER BY recorded_at DESC, id DESC LIMIT 100")
def _(spark, sf):
    return load(spark, sf, "resolution_record").filter("provider_record_id_a IS NOT NULL").orderBy(F.desc("recorded_at"), F.desc("id")).limit(100).select("id", "provider_record_id_a", "match_score")


@query("t08_mapped_order", "SELECT o_orderpriority AS priority, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END AS place, count(*) AS n, round(avg(o_totalprice), 4) AS price FROM orders GROUP BY 1, 2")
def _(spark, sf):
    place = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).when(F.col("o_orderpriority") == "3-MEDIUM", 2).otherwise(3)
    return load(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority"), place.alias("place")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("price"))


@query("a38_weakest", "SELECT provider, arg_min(source_type, (a, source_type)) AS weakest FROM (SELECT provider, source_type, round(avg(CASE WHEN authority > 1 THEN authority / 100 ELSE authority END), 9) AS a FROM source_ref WHERE authority IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def _(spark, sf):
    m = load(spark, sf, "source_ref").filter("authority IS NOT NULL").groupBy("provider", "source_type").agg(F.round(F.avg(_authority()), 9).alias("a"))
    return m.groupBy("provider").agg(F.min_by("source_type", F.struct("a", "source_type")).alias("weakest"))


@query(
    "c15_entities",
    """SELECT provider, provider_record_id, coalesce(max(entity_id), 'prov-' || substr(sha256(provider || '|' || provider_record_id), 1, 16)) AS entity_id, max(entity_id) IS NULL AS provisional
       FROM (SELECT DISTINCT provider, provider_record_id FROM provider_record) LEFT JOIN provider_identity USING (provider, provider_record_id) GROUP BY 1, 2""",
)
def _(spark, sf):
    return S.assign_entities(load(spark, sf, "provider_record"), load(spark, sf, "provider_identity"))


@query(
    "c16_review_queue",
    """SELECT 'pair|' || least(provider_record_id_a, provider_record_id_b) || '|' || greatest(provider_record_id_a, provider_record_id_b) || '|' || match_type AS dedupe_key FROM resolution_record
       WHERE match_type IN ('uncertain', 'same_brand_different_location') AND provider_record_id_a IS NOT NULL AND provider_record_id_b IS NOT NULL GROUP BY 1""",
)
def _(spark, sf):
    rows = load(spark, sf, "resolution_record").filter("match_type IN ('uncertain', 'same_brand_different_location') AND provider_record_id_a IS NOT NULL AND provider_record_id_b IS NOT NULL")
    items = rows.select(T.pair_key(F.col("provider_record_id_a"), F.col("provider_record_id_b"), F.col("match_type")).alias("dedupe_key"), F.col("id").alias("review_id"), "recorded_at")
    # The older half stands in the queue already, and is offered again: inserting it twice changes nothing.
    old = items.filter(F.col("recorded_at") < F.lit("2025-01-01").cast("timestamp"))
    queue = S.insert_once(old.limit(0), old.select("dedupe_key", "review_id"), "dedupe_key")
    return queue.unionByName(S.insert_once(queue, items.select("dedupe_key", "review_id"), "dedupe_key")).select("dedupe_key")


@query(
    "c18_merged_entities",
    """WITH m AS (SELECT entity_id AS source, min(entity_id) OVER (PARTITION BY merge_group) AS target FROM business_entity WHERE merge_group IS NOT NULL)
       SELECT b.entity_id, CASE WHEN m.source <> m.target THEN 'MERGED' ELSE b.status END AS status FROM business_entity b LEFT JOIN m ON b.entity_id = m.source""",
)
def _(spark, sf):
    e = load(spark, sf, "business_entity")
    targets = e.filter("merge_group IS NOT NULL").groupBy("merge_group").agg(F.min("entity_id").alias("target"))
    merges = e.select(F.col("entity_id").alias("source"), "merge_group").join(targets, "merge_group").filter("source <> target").select("source", "target")
    return S.merge_entities(load(spark, sf, "provider_identity"), e, merges)[1].select("entity_id", "status")


@query(
    "s10_upserted",
    """SELECT provider, provider_record_id, arg_max(phone, ingested_at) AS phone FROM (SELECT provider, provider_record_id, coalesce(phone, '') AS phone, max(ingested_at) AS ingested_at FROM provider_record GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)
def _(spark, sf):
    rows = load(spark, sf, "provider_record").groupBy("provider", "provider_record_id", F.coalesce("phone", F.lit("")).alias("phone")).agg(F.max("ingested_at").alias("ingested_at"))
    cutoff = F.lit("2025-01-01").cast("timestamp")
    old, new = rows.filter(F.col("ingested_at") < cutoff), rows.filter((F.col("ingested_at") >= cutoff) | F.col("ingested_at").isNull())
    return S.upsert(old, new, ["provider", "provider_record_id"], "ingested_at").select("provider", "provider_record_id", "phone")


@query(
    "j05_review_details",
    f"""SELECT r.id, count(i.entity_id) AS identities, count(DISTINCT e.canonical_name) AS names FROM (SELECT DISTINCT id, entity_id, provider_a, provider_record_id_a FROM resolution_record WHERE match_type = 'uncertain') r LEFT JOIN business_entity e USING (entity_id)
        LEFT JOIN (SELECT DISTINCT provider, provider_record_id, entity_id FROM provider_identity) i ON i.provider = r.provider_a AND i.provider_record_id = r.provider_record_id_a GROUP BY 1""",
)
def _(spark, sf):
    r = load(spark, sf, "resolution_record").filter("match_type = 'uncertain'").select("id", "entity_id", "provider_a", "provider_record_id_a").distinct()
    e = load(spark, sf, "business_entity").select("entity_id", "canonical_name")
    i = load(spark, sf, "provider_identity").select(F.col("provider").alias("provider_a"), F.col("provider_record_id").alias("provider_record_id_a"), F.col("entity_id").alias("identity")).distinct()
    return r.join(e, "entity_id", "left").join(i, ["provider_a", "provider_record_id_a"], "left").groupBy("id").agg(F.count("identity").alias("identities"), F.countDistinct("canonical_name").alias("names"))


@query(
    "j07_open_corrections",
    """SELECT example_id FROM (SELECT DISTINCT example_id, annotation_status FROM dataset_example) WHERE annotation_status <> 'gold' AND example_id NOT IN (SELECT example_id FROM dataset_example WHERE quality_score >= 0.9)""",
)
def _(spark, sf):
    rows = load(spark, sf, "dataset_example")
    open_ = rows.filter("annotation_status <> 'gold'").select("example_id").distinct()
    return open_.join(rows.filter("quality_score >= 0.9").select("example_id").distinct(), "example_id", "left_anti")


@query(
    "proj10_unknowns",
    """SELECT unknown, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN canonical_phone IS NULL THEN 'phone' END, CASE WHEN canonical_website IS NULL THEN 'website' END, CASE WHEN canonical_address IS NULL THEN 'address' END, CASE WHEN canonical_latitude IS NULL THEN 'coordinates' END, CASE WHEN category IS NULL THEN 'category' END], lambda x: x IS NOT NULL)) AS unknown FROM business_entity) GROUP BY 1""",
)
def _(spark, sf):
    names = {"canonical_phone": "phone", "canonical_website": "website", "canonical_address": "address", "canonical_latitude": "coordinates", "category": "category"}
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), n) for c, n in names.items()]))
    return load(spark, sf, "business_entity").select(F.explode(missing).alias("unknown")).groupBy("unknown").agg(F.count("*").alias("n"))


@query(
    "proj05_proj08_projection",
    """SELECT b.entity_id, coalesce(nullif(canonical_name, ''), 'unnamed') AS name, coalesce(nullif(canonical_website, ''), nullif(s.url, '')) AS website, s.provider FROM business_entity b LEFT JOIN source_ref s ON b.source_id = s.id""",
)
def _(spark, sf):
    s = load(spark, sf, "source_ref").select(F.col("id").alias("source_id"), "url", "provider")
    return load(spark, sf, "business_entity").join(s, "source_id", "left").select(
        "entity_id", C.first_filled(F.col("canonical_name"), F.lit("unnamed")).alias("name"), C.first_filled(F.col("canonical_website"), F.col("url")).alias("website"), "provider"
    )


@query("proj12_allowed_update", "SELECT entity_id, CASE WHEN status = 'DEPRECATED' THEN 'archived' ELSE category END AS category, status FROM business_entity")
def _(spark, sf):
    b = load(spark, sf, "business_entity")
    change = F.create_map(F.lit("category"), F.lit("archived"), F.lit("entity_id"), F.lit("changed"))
    allowed = F.map_filter(change, lambda k, _: k.isin("category"))
    new = F.when(F.col("status") == "DEPRECATED", F.try_element_at(allowed, F.lit("category")))
    return b.select("entity_id", F.coalesce(new, "category").alias("category"), "status")


@query(
    "x10_map_pages",
    """SELECT provider, provider_record_id, '+' || lpad(regexp_replace(provider_record_id, '[^0-9]', '', 'g')[1:4], 11, '7') AS phone, '12 Main, Old Town, Rudim, West State 123456, India' AS address, 'Rudim' AS city, 'West State' AS state, '123456' AS postal_code, 'India' AS country,
         CASE WHEN rating BETWEEN 0 AND 5 THEN floor(rating * 10 + 0.5) / 10 END AS rating, CASE WHEN rating BETWEEN 0 AND 5 THEN 'Bakery' END AS category, '9 AM-5:30 PM' AS tuesday FROM (SELECT DISTINCT provider, provider_record_id, rating FROM provider_record WHERE rating < 9.9 AND rating >= 0)""",
)
def _(spark, sf):
    rows = load(spark, sf, "provider_record").filter("rating < 9.9 AND rating >= 0").select("provider", "provider_record_id", "rating").distinct()
    number = F.lpad(F.substring(F.regexp_replace("provider_record_id", "[^0-9]", ""), 1, 4), 11, "7")
    page = F.concat(
        F.lit("![map](https://x.example/a.png) Save, Directions, 12 Main,  Old Town, Rudim, West State 123456, India\n[call](tel:+"), number, F.lit(") rated "), F.format_string("%.1f", C.js_round(F.col("rating"), 1)), F.lit(" Bakery Tuesday* 9 AM–5:30 PM"),
    )
    f = rows.select("provider", "provider_record_id", X.map_page_fields(page).alias("f"))
    return f.select("provider", "provider_record_id", "f.phone", "f.address", "f.city", "f.state", "f.postal_code", "f.country", "f.rating", "f.category", F.try_element_at("f.hours", F.lit("tuesday")).alias("tuesday"))


@query(
    "x11_raw_pages",
    """SELECT id, CASE WHEN authority >= 0 AND authority < 9.95 THEN floor(authority * 10 + 0.5) / 10 END AS rating, length(url) * 1000 AS review_count, '98765 43210' AS phone, 'Rudim' AS city, 'Bay' AS state, '560001' AS postal_code FROM source_ref WHERE url IS NOT NULL AND (authority IS NULL OR (authority >= 0 AND authority < 9.95))""",
)
def _(spark, sf):
    s = load(spark, sf, "source_ref").filter("url IS NOT NULL AND (authority IS NULL OR (authority >= 0 AND authority < 9.95))")
    html = F.concat(F.lit("<p>call 98765 43210</p><p>Main Road, Rudim, Bay, India 560001</p>"), F.coalesce(F.concat(F.lit("Rating: "), F.format_string("%.1f", C.js_round(F.col("authority"), 1))), F.lit("")), F.lit(" with "), F.format_number(F.length("url") * 1000, 0), F.lit(" Reviews"))
    f = s.select("id", X.raw_page_fields(html).alias("f"))
    return f.select("id", "f.rating", "f.review_count", "f.phone", "f.city", "f.state", "f.postal_code")


@query(
    "x12_x13_reputation",
    """WITH e AS (SELECT DISTINCT example_id, rating, review_count, evidence FROM dataset_example)
       SELECT example_id, CASE WHEN rating BETWEEN 1 AND 5 THEN floor(rating * 10 + 0.5) / 10 END AS rating, CASE WHEN review_count >= 0 THEN review_count END AS review_count, len(list_filter(coalesce(evidence, []), lambda x: trim(x.text) <> '' OR trim(x.source) <> '')) AS reviews,
         CASE WHEN rating BETWEEN 1 AND 5 OR review_count >= 0 THEN 'source_extracted' ELSE 'unavailable' END AS status, CASE WHEN rating BETWEEN 1 AND 5 THEN 0.9 ELSE 0.7 END AS confidence FROM e""",
)
def _(spark, sf):
    e = load(spark, sf, "dataset_example").select("example_id", "rating", "review_count", "evidence").distinct()
    none = F.lit(None).cast("string")
    reviews = F.transform(
        "evidence",
        lambda x: F.struct(
            F.lit(None).cast("double").alias("rating"), x["text"].alias("text"), x["source"].alias("author"), none.alias("author_name"), none.alias("published_at"), none.alias("relative_time"), none.alias("publish_time"), F.lit(1.5).alias("confidence")
        ),
    )
    return e.select("example_id", X.provider_reputation(F.col("rating"), F.col("review_count"), reviews).alias("r")).select("example_id", "r.*")


@query(
    "x15_completeness",
    """SELECT provider, count(*) AS n, round(avg((CASE WHEN name <> '' THEN 1 ELSE 0 END + CASE WHEN phone <> '' THEN 1 ELSE 0 END + CASE WHEN website <> '' THEN 1 ELSE 0 END + CASE WHEN full_address <> '' THEN 1 ELSE 0 END + CASE WHEN latitude IS NOT NULL THEN 1 ELSE 0 END) / 5.0), 6) AS completeness FROM provider_record GROUP BY 1""",
)
def _(spark, sf):
    share = X.acquisition_completeness(*[F.col(c) for c in ("name", "phone", "website", "full_address", "latitude")])
    return load(spark, sf, "provider_record").groupBy("provider").agg(F.count("*").alias("n"), F.round(F.avg(share), 6).alias("completeness"))


@query(
    "x16_error_classes",
    """SELECT CASE WHEN s = 429 THEN 'RATE_LIMITED' WHEN s IN (401, 403) THEN 'ACCESS_DENIED' WHEN s = 404 THEN 'NOT_FOUND' WHEN s = 408 THEN 'TIMEOUT' WHEN s >= 500 THEN 'PROVIDER_UNAVAILABLE' ELSE 'UNKNOWN_ERROR' END AS kind, s IN (408, 429) OR s >= 500 AS retryable, count(*) AS n
       FROM (SELECT [200, 401, 403, 404, 408, 429, 500, 503][event_id % 8 + 1] AS s FROM events) GROUP BY 1, 2""",
)
def _(spark, sf):
    status = F.get(F.array(*[F.lit(x) for x in (200, 401, 403, 404, 408, 429, 500, 503)]), (F.col("event_id") % 8).cast("int"))
    c = X.error_class(status, F.lit(None).cast("string"))
    return load(spark, sf, "events").select(c["kind"].alias("kind"), c["retryable"].alias("retryable")).groupBy("kind", "retryable").agg(F.count("*").alias("n"))


@query(
    "s04_hydrated",
    "SELECT id, json_type(metadata) AS kind FROM source_ref WHERE json_valid(metadata) AND metadata IS NOT NULL AND trim(metadata) <> ''",
)
def _(spark, sf):
    rows = load(spark, sf, "source_ref").select("id", F.col("metadata").alias("payload"))
    return hydrate(rows, "payload", "_none string").select("id", F.lit("OBJECT").alias("kind"))


@query("s06_s07_adapters", "SELECT DISTINCT name, phone, website, full_address, latitude, longitude FROM provider_record WHERE name <> ''")
def _(spark, sf):
    p = load(spark, sf, "provider_record").filter("name <> ''")
    nested = p.select(
        F.struct("name", "phone", "website", F.col("full_address").alias("formatted"), "city", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon")).alias("properties"),
        F.struct(F.array("longitude", "latitude").alias("coordinates")).alias("geometry"),
    )
    f = feature_records(nested)
    empty = lambda c: F.when(F.col(c) != "", F.col(c))
    users = user_records(p.select("name", F.col("phone").alias("phoneNumber"), F.col("website").alias("url"), "full_address")).select("name", "phone", "website", "full_address").distinct()
    keys = ["name", "phone", "website", "full_address"]
    same = [f[c].eqNullSafe(F.col(f"u_{c}")) if c == "name" else F.when(f[c] != "", f[c]).eqNullSafe(F.col(f"u_{c}")) for c in keys]
    both = f.join(users.select(*[F.col(c).alias(f"u_{c}") for c in keys]), same[0] & same[1] & same[2] & same[3], "left_semi")
    return both.select("name", "phone", "website", "full_address", "latitude", "longitude").distinct()
