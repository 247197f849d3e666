"""Queries of the scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from amalgam.functions import compat as C, geo as G, text as T
from amalgam.operators import validate as V
from amalgam.operators.joins import chunked_join
from amalgam.runtime import load

_B = C.BLANK
_TRIM = lambda x: f"regexp_replace({x}, '^{_B}+|{_B}+$', '', 'g')"
_COLLAPSE = lambda x: _TRIM(f"regexp_replace({x}, '{_B}+', ' ', 'g')")


def _sql_map(table: dict[str, str], x: str) -> str:
    return "CASE " + x + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def _sql_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


QUERIES, SQL = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query(
    "n01_n02_structures",
    f"""SELECT conv_id, turn, {_TRIM('content')} NOT IN ('[object Object]', '[object Array]') AS is_text,
         CASE WHEN regexp_matches({_TRIM('content')}, '^[{{\\[]') THEN json_valid(content) ELSE false END AS is_structure
       FROM (SELECT DISTINCT conv_id, turn, content FROM chat_message WHERE content IS NOT NULL)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "chat_message").filter("content IS NOT NULL").select("conv_id", "turn", "content").distinct()
    return rows.select(
        "conv_id", "turn", T.strip_object_text(F.col("content")).isNotNull().alias("is_text"), T.parse_structure(F.col("content")).isNotNull().alias("is_structure")
    )


_LAST = "trim(list_extract(string_split(full_address, ','), -1))"


@query(
    "n03_country_codes",
    f"""SELECT country, count(*) AS n FROM (
          SELECT coalesce({_sql_map(T.COUNTRY_CODES, f"lower({_TRIM(_LAST)})")},
                 CASE WHEN regexp_matches(lower({_TRIM(_LAST)}), '^[a-z]{{2}}$') THEN upper({_TRIM(_LAST)}) END) AS country
          FROM provider_record WHERE full_address IS NOT NULL) GROUP BY 1""",
)
def _(spark, sf):
    last = F.element_at(F.split(F.col("full_address"), ","), -1)
    return load(spark, sf, "provider_record").filter("full_address IS NOT NULL").select(T.country_code(F.trim(last)).alias("country")).groupBy("country").agg(F.count("*").alias("n"))


_D = "regexp_replace(phone, '[^0-9]', '', 'g')"
_NANP = "'^[2-9][0-9]{2}[2-9][0-9]{6}$'"


@query(
    "n04_n05_phones",
    f"""WITH p AS (SELECT phone, {_D} AS d, {_TRIM('phone')} AS t FROM provider_record WHERE phone IS NOT NULL)
        SELECT phone, e164, key, count(*) AS n FROM (
          SELECT phone,
            coalesce(
              CASE WHEN (starts_with(t, '+') OR starts_with(t, 'tel:+')) AND starts_with(d, '1') AND regexp_matches(substr(d, 2), {_NANP}) THEN '+' || d END,
              CASE WHEN starts_with(d, '00') AND starts_with(substr(d, 3), '1') AND regexp_matches(substr(d, 4), {_NANP}) THEN '+' || substr(d, 3) END,
              CASE WHEN regexp_matches(CASE WHEN length(d) = 11 THEN regexp_replace(d, '^1', '') ELSE d END, {_NANP})
                   THEN '+1' || CASE WHEN length(d) = 11 THEN regexp_replace(d, '^1', '') ELSE d END END) AS e164,
            CASE WHEN length(d) = 11 AND starts_with(d, '1') THEN substr(d, 2) ELSE d END AS key
          FROM p) GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    rows = load(spark, sf, "provider_record").filter("phone IS NOT NULL")
    return (
        rows.select("phone", T.normalize_phone(F.col("phone"), F.lit("US")).alias("e164"), T.phone_equivalence_key(F.col("phone")).alias("key"))
        .groupBy("phone", "e164", "key").agg(F.count("*").alias("n"))
    )


_FULL = f"CASE WHEN starts_with(lower({_TRIM('w')}), 'http') THEN {_TRIM('w')} ELSE 'https://' || {_TRIM('w')} END"
_WEB = r"'^([hH][tT][tT][pP][sS]?)://([^/?# ]+)([^# ]*)$'"


@query(
    "n06_n07_websites",
    f"""WITH a AS (SELECT entity_id, canonical_website AS w FROM business_entity WHERE canonical_website IS NOT NULL),
        b AS (SELECT *, regexp_replace({_FULL}, '#.*$', '') AS bare FROM a),
        c AS (SELECT *, regexp_extract(bare, {_WEB}, 3) AS rest FROM b)
        SELECT entity_id,
          CASE WHEN {_TRIM('w')} <> '' AND regexp_matches(bare, {_WEB}) THEN lower(regexp_extract(bare, {_WEB}, 1)) || '://' || lower(regexp_extract(bare, {_WEB}, 2))
               || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END END AS website,
          CASE WHEN regexp_extract(lower({_TRIM('w')}), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@ ]*@)?([^/?#: ]+)', 1) <> ''
               THEN regexp_replace(regexp_extract(lower({_TRIM('w')}), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@ ]*@)?([^/?#: ]+)', 1), '^www\\.', '') END AS domain
        FROM c""",
)
def _(spark, sf):
    w = F.col("canonical_website")
    return load(spark, sf, "business_entity").filter("canonical_website IS NOT NULL").select("entity_id", T.normalize_website(w).alias("website"), T.normalize_domain(w).alias("domain"))


_URL = r"'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]+)([^?]*)\??(.*)$'"


@query(
    "n08_url_keys",
    f"""WITH a AS (SELECT id, {_TRIM('url')} AS t, regexp_replace({_TRIM('url')}, '#.*$', '') AS bare FROM source_ref WHERE url IS NOT NULL),
        b AS (SELECT *, lower(regexp_extract(bare, {_URL}, 1)) AS s, regexp_replace(lower(regexp_extract(bare, {_URL}, 2)), '^www\\.', '') AS h,
                     regexp_extract(bare, {_URL}, 3) AS p, regexp_extract(bare, {_URL}, 4) AS q FROM a),
        c AS (SELECT *, list_sort(list_transform(list_filter(string_split(q, '&'),
                lambda x: x <> '' AND NOT starts_with(lower(string_split(x, '=')[1]), 'utm_') AND lower(string_split(x, '=')[1]) NOT IN ({_sql_list(T.TRACKING)})),
                lambda x: lower(string_split(x, '=')[1]) || '=' || regexp_replace(x, '^[^=]*=?', ''))) AS kept FROM b)
        SELECT id, CASE WHEN regexp_matches(bare, {_URL}) THEN
            s || '://' || CASE WHEN h IN ('maps.google.com', 'google.com') AND regexp_matches(p, '(?i)^/(maps|place|search)(/|$)') THEN 'maps.google.com' ELSE h END
            || CASE WHEN p = '' THEN '/' WHEN length(p) > 1 THEN regexp_replace(p, '/+$', '') ELSE p END
            || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END ELSE t END AS url_key,
          sha256(t) AS url_hash
        FROM c""",
)
def _(spark, sf):
    return load(spark, sf, "source_ref").filter("url IS NOT NULL").select("id", T.normalize_url(F.col("url")).alias("url_key"), F.sha2(C.trim_blank(F.col("url")), 256).alias("url_hash"))


_WORDS = f"list_filter(regexp_split_to_array(regexp_replace(lower(a), '[.,#]|{_B}', ' ', 'g'), ' +'), lambda x: x <> '')"


@query(
    "n09_addresses",
    f"""SELECT record, array_to_string(list_transform({_WORDS}, lambda x: coalesce({_sql_map(T.STREET_WORDS, 'x')}, x)), ' ') AS address
        FROM (SELECT entity_id AS record, canonical_address AS a FROM business_entity UNION ALL
              SELECT DISTINCT example_id, address FROM dataset_example) WHERE trim(a) <> ''""",
)
def _(spark, sf):
    rows = load(spark, sf, "business_entity").select(F.col("entity_id").alias("record"), F.col("canonical_address").alias("a")).unionAll(
        load(spark, sf, "dataset_example").select("example_id", "address").distinct()
    )
    return rows.filter("trim(a) <> ''").select("record", T.normalize_address(F.col("a")).alias("address"))


@query(
    "n10_name_lists",
    f"""SELECT entity_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(canonical_name, '[,;]'), lambda x: {_TRIM('x')}), lambda x: x <> ''))), '|') AS items
        FROM business_entity WHERE canonical_name IS NOT NULL""",
)
def _(spark, sf):
    return load(spark, sf, "business_entity").filter("canonical_name IS NOT NULL").select(
        "entity_id", F.array_join(F.array_sort(T.split_list(F.col("canonical_name"))), "|").alias("items")
    )


@query(
    "n12_n13_equivalence",
    """WITH x AS (SELECT p.provider, p.provider_record_id, p.phone AS a, b.canonical_phone AS b
                  FROM provider_record p JOIN (SELECT DISTINCT provider, provider_record_id, entity_id FROM provider_identity WHERE entity_id IS NOT NULL) i USING (provider, provider_record_id)
                  JOIN business_entity b USING (entity_id)),
        k AS (SELECT *, regexp_replace(a, '[^0-9]', '', 'g') AS da, regexp_replace(b, '[^0-9]', '', 'g') AS db FROM x)
        SELECT count(*) AS pairs, count(*) FILTER (WHERE (a IS NULL AND b IS NULL) OR a = b OR (da <> '' AND
            CASE WHEN length(da) = 11 AND starts_with(da, '1') THEN substr(da, 2) ELSE da END = CASE WHEN length(db) = 11 AND starts_with(db, '1') THEN substr(db, 2) ELSE db END)
            OR (a IS NOT NULL AND b IS NOT NULL AND ("""
    + "coalesce(CASE WHEN (starts_with(a, '+') OR starts_with(a, 'tel:+')) AND starts_with(da, '1') AND regexp_matches(substr(da, 2), " + _NANP + ") THEN '+' || da END, "
    + "CASE WHEN starts_with(da, '00') AND starts_with(substr(da, 3), '1') AND regexp_matches(substr(da, 4), " + _NANP + ") THEN '+' || substr(da, 3) END, "
    + "CASE WHEN length(da) = 11 AND starts_with(da, '1') AND regexp_matches(substr(da, 2), " + _NANP + ") THEN '+' || da END) IS NOT DISTINCT FROM "
    + "coalesce(CASE WHEN (starts_with(b, '+') OR starts_with(b, 'tel:+')) AND starts_with(db, '1') AND regexp_matches(substr(db, 2), " + _NANP + ") THEN '+' || db END, "
    + "CASE WHEN starts_with(db, '00') AND starts_with(substr(db, 3), '1') AND regexp_matches(substr(db, 4), " + _NANP + ") THEN '+' || substr(db, 3) END, "
    + "CASE WHEN length(db) = 11 AND starts_with(db, '1') AND regexp_matches(substr(db, 2), " + _NANP + ") THEN '+' || db END)))) AS equivalent FROM k",
)
def _(spark, sf):
    ids = load(spark, sf, "provider_identity").filter("entity_id IS NOT NULL").select("provider", "provider_record_id", "entity_id").distinct()
    x = load(spark, sf, "provider_record").join(ids, ["provider", "provider_record_id"]).join(load(spark, sf, "business_entity").select("entity_id", "canonical_phone"), "entity_id")
    same = T.values_equivalent(F.lit("contact.phone"), F.col("phone"), F.col("canonical_phone"))
    return x.agg(F.count("*").alias("pairs"), F.count(F.when(same, 1)).alias("equivalent"))


@query(
    "n14_n23_names",
    f"""SELECT entity_id, {_TRIM(f"regexp_replace({_TRIM('canonical_name')}, '{T.LEGAL_SUFFIX}', '')")} AS bare_name,
          coalesce(nullif(substr(regexp_replace(regexp_replace(regexp_replace(lower(canonical_name), '[''’]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), ''), 'business') AS slug
        FROM business_entity WHERE canonical_name IS NOT NULL""",
)
def _(spark, sf):
    n = F.col("canonical_name")
    return load(spark, sf, "business_entity").filter("canonical_name IS NOT NULL").select("entity_id", T.strip_legal_suffix(n).alias("bare_name"), T.slug(n).alias("slug"))


@query(
    "n16_match_forms",
    f"""SELECT doc_id, md5(lower({_COLLAPSE("regexp_replace(text, '[\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}]', '', 'g')")})) AS form_md5,
          CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '…' ELSE text END AS clipped FROM documents""",
)
def _(spark, sf):
    t = F.col("text")
    return load(spark, sf, "documents").select("doc_id", F.md5(T.match_form(t)).alias("form_md5"), T.clip(t).alias("clipped"))


@query("n17_redacted", "SELECT doc_id, md5(" + __import__("functools").reduce(lambda x, p: f"""regexp_replace({x}, '{p[0].replace("'", "''")}', '{p[1]}', 'g')""", T.SECRETS, "text") + ") AS redacted_md5 FROM documents")
def _(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.md5(T.redact_secrets(F.col("text"))).alias("redacted_md5"))


_X, _Y = f"lower({_TRIM('a')})", f"lower({_TRIM('b')})"


@query(
    "n19_name_similarity",
    f"""WITH p AS (SELECT l.entity_id AS id_a, r.entity_id AS id_b, l.canonical_name AS a, r.canonical_name AS b FROM business_entity l JOIN business_entity r
                  ON l.merge_group = r.merge_group AND l.entity_id < r.entity_id),
        q AS (SELECT *, {_X} AS x, {_Y} AS y FROM p),
        s AS (SELECT *, list_distinct(string_split(x, '')) AS p, list_distinct(string_split(y, '')) AS q, least(length(x), length(y)) AS lo, greatest(length(x), length(y)) AS hi FROM q)
        SELECT id_a, id_b, round(CASE WHEN x IS NULL OR y IS NULL OR x = '' OR y = '' THEN 0.0 WHEN x = y THEN 1.0
          WHEN substr(x, 1, least(3, lo)::BIGINT) = substr(y, 1, least(3, lo)::BIGINT) THEN 0.8 + 0.2 * lo / hi
          ELSE len(list_intersect(p, q)) / len(list_distinct(list_concat(p, q))) END, 6) AS similarity FROM s""",
)
def _(spark, sf):
    rows = load(spark, sf, "business_entity").filter("merge_group IS NOT NULL").select("entity_id", "canonical_name", "merge_group")
    a = rows.select("merge_group", F.col("entity_id").alias("id_a"), F.col("canonical_name").alias("a"))
    b = rows.select("merge_group", F.col("entity_id").alias("id_b"), F.col("canonical_name").alias("b"))
    return chunked_join(a, b, ["merge_group"], "id_a", "id_b").filter("id_a < id_b").select("id_a", "id_b", F.round(T.fuzzy_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


_PARTS = f"list_filter(list_transform(string_split(full_address, ','), lambda x: {_TRIM('x')}), lambda x: x <> '')"
_ZIP = "'^([A-Za-z]{2})[ ]+([0-9]{5}(?:-[0-9]{4})?)$'"


@query(
    "n20_address_parts",
    f"""SELECT provider, provider_record_id, p[1] AS street, p[2] AS city,
          CASE WHEN regexp_matches(p[3], {_ZIP}) THEN regexp_extract(p[3], {_ZIP}, 1) ELSE p[3] END AS state,
          CASE WHEN regexp_matches(p[3], {_ZIP}) THEN regexp_extract(p[3], {_ZIP}, 2) END AS postal_code, p[4] AS country
        FROM (SELECT *, {_PARTS} AS p FROM provider_record WHERE full_address IS NOT NULL)""",
)
def _(spark, sf):
    return load(spark, sf, "provider_record").filter("full_address IS NOT NULL").select("provider", "provider_record_id", T.parse_comma_address(F.col("full_address")).alias("p")).select("provider", "provider_record_id", "p.*")


@query(
    "n22_keys",
    f"""SELECT key, count(*) AS n FROM (SELECT CASE WHEN {_TRIM('provider_record_id')} <> '' AND provider = 'google_maps' THEN 'place:' || {_TRIM('provider_record_id')}
          WHEN {_TRIM('website')} <> '' THEN 'url:' || {_TRIM('website')}
          WHEN {_TRIM('name')} <> '' AND {_TRIM('full_address')} <> '' THEN 'nameaddr:' || lower({_TRIM('name')}) || '|' || lower({_TRIM('full_address')})
          WHEN {_TRIM('name')} <> '' THEN 'name:' || lower({_TRIM('name')}) END AS key FROM provider_record) GROUP BY 1""",
)
def _(spark, sf):
    place = F.when(F.col("provider") == "google_maps", F.col("provider_record_id"))
    key = T.dedupe_key(place, F.col("website"), F.col("name"), F.col("full_address"))
    return load(spark, sf, "provider_record").select(key.alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query(
    "m01_m02_distances",
    """SELECT p.provider, p.provider_record_id, epoch_us(p.fetched_at) AS fetched_us, b.entity_id,
          round(2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)), 3) AS metres, round(sqrt(pow(latitude - canonical_latitude, 2) + pow(longitude - canonical_longitude, 2)), 9) AS degrees
        FROM (SELECT *, pow(sin(radians(canonical_latitude - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(canonical_latitude)) * pow(sin(radians(canonical_longitude - longitude) / 2), 2) AS h
              FROM provider_record p JOIN (SELECT DISTINCT provider, provider_record_id, entity_id FROM provider_identity WHERE entity_id IS NOT NULL) i USING (provider, provider_record_id)
              JOIN business_entity b USING (entity_id)
              WHERE abs(latitude) <= 90 AND abs(longitude) <= 180 AND abs(canonical_latitude) <= 90 AND abs(canonical_longitude) <= 180) t
        JOIN LATERAL (SELECT t.provider, t.provider_record_id, t.fetched_at) p ON true JOIN LATERAL (SELECT t.entity_id) b ON true""",
)
def _(spark, sf):
    ids = load(spark, sf, "provider_identity").filter("entity_id IS NOT NULL").select("provider", "provider_record_id", "entity_id").distinct()
    x = load(spark, sf, "provider_record").join(ids, ["provider", "provider_record_id"]).join(
        load(spark, sf, "business_entity").select("entity_id", "canonical_latitude", "canonical_longitude"), "entity_id"
    )
    p = [F.col(c) for c in ("latitude", "longitude", "canonical_latitude", "canonical_longitude")]
    return x.filter(G.valid_position(p[0], p[1]) & G.valid_position(p[2], p[3])).select(
        "provider", "provider_record_id", F.unix_micros(F.col("fetched_at").cast("timestamp")).alias("fetched_us"), "entity_id", F.round(G.haversine(*p), 3).alias("metres"), F.round(G.degree_distance(*p), 9).alias("degrees")
    )


@query(
    "m03_positions",
    """WITH t AS (SELECT entity_id, canonical_latitude AS la, canonical_longitude AS lo FROM business_entity WHERE canonical_latitude IS NOT NULL AND canonical_longitude IS NOT NULL)
       SELECT entity_id, CASE WHEN abs(round(la, 5)) <= 90 AND abs(round(lo, 5)) <= 180 THEN round(la, 5) END AS lat,
              CASE WHEN abs(round(la, 5)) <= 90 AND abs(round(lo, 5)) <= 180 THEN round(lo, 5) END AS lng FROM t""",
)
def _(spark, sf):
    rows = load(spark, sf, "business_entity").filter("canonical_latitude IS NOT NULL AND canonical_longitude IS NOT NULL")
    listed = F.format_string("[%.5f, %.5f]", "canonical_longitude", "canonical_latitude")
    pos = G.parse_position(listed)
    return rows.select("entity_id", pos["lat"].alias("lat"), pos["lng"].alias("lng"))


@query(
    "m04_rounding",
    """SELECT p_partkey, floor(p_retailprice * 10.0 + 0.5) / 10.0 AS price_1, greatest(0.0, least(1.0, p_size / 25.0)) AS size_share FROM part""",
)
def _(spark, sf):
    return load(spark, sf, "part").select("p_partkey", C.js_round(F.col("p_retailprice"), 1).alias("price_1"), C.clamp01(F.col("p_size") / F.lit(25.0)).alias("size_share"))


@query(
    "f04_f05_phone_status",
    f"""WITH p AS (SELECT entity_id, canonical_phone AS raw, {_TRIM('canonical_phone')} AS t, regexp_replace(canonical_phone, '[^0-9]', '', 'g') AS d FROM business_entity),
        s AS (SELECT *, (t = '' OR regexp_matches(t, '^-?\\d+\\.\\d+\\s*,\\s*-?\\d+\\.\\d+$') OR regexp_matches(t, '(?i)^[A-Z0-9]{{4,}}\\+[A-Z0-9]{{2,}}$')
               OR regexp_matches(t, '^\\d{{5,6}}(-\\d{{4}})?$') OR length(d) < 7 OR regexp_matches(d, '^(0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)$')) AS no_phone,
              coalesce(CASE WHEN (starts_with(t, '+') OR starts_with(t, 'tel:+')) AND starts_with(d, '1') AND regexp_matches(substr(d, 2), {_NANP}) THEN d END,
              CASE WHEN starts_with(d, '00') AND starts_with(substr(d, 3), '1') AND regexp_matches(substr(d, 4), {_NANP}) THEN d END,
              CASE WHEN regexp_matches(CASE WHEN length(d) = 11 THEN regexp_replace(d, '^1', '') ELSE d END, {_NANP}) THEN d END) IS NOT NULL AS known FROM p)
        SELECT entity_id, CASE WHEN raw IS NULL OR raw = '' THEN 'missing' WHEN no_phone THEN 'rejected' WHEN known THEN 'valid' ELSE 'unresolved' END AS status,
          CASE WHEN raw IS NULL OR raw = '' THEN 'no_value' WHEN no_phone THEN 'non_phone_signal' WHEN known THEN NULL ELSE 'cannot_normalize' END AS reason FROM s""",
)
def _(spark, sf):
    v = V.phone_status(F.col("canonical_phone"), F.lit("US"))
    return load(spark, sf, "business_entity").select("entity_id", v["status"].alias("status"), v["reason"].alias("reason"))


@query(
    "f06_emails",
    """SELECT provider, provider_record_id, email, (email IS NOT NULL AND trim(email) <> '' AND NOT regexp_matches(trim(email), '(?i)(^|\\s)(test|example|user|someone|yourname|your-name)@')
          AND NOT regexp_matches(trim(email), '(?i)@(example|test|localhost|invalid|yourdomain|your-domain|domain)\\.') AND NOT contains(email, '..') AND NOT contains(email, '@.')
          AND NOT ends_with(trim(email), '.') AND NOT starts_with(trim(email), '.') AND regexp_matches(trim(email), '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$')) AS valid
        FROM (SELECT DISTINCT provider, provider_record_id, email FROM provider_record)""",
)
def _(spark, sf):
    rows = load(spark, sf, "provider_record").select("provider", "provider_record_id", "email").distinct()
    return rows.withColumn("valid", V.valid_email(F.col("email")))


@query(
    "f07_website_status",
    f"""WITH a AS (SELECT entity_id, canonical_website AS w FROM business_entity), b AS (SELECT *, regexp_replace({_FULL}, '#.*$', '') AS bare FROM a),
        c AS (SELECT *, lower(regexp_extract(bare, {_WEB}, 2)) AS host FROM b)
        SELECT entity_id, CASE WHEN w IS NULL OR {_TRIM('w')} = '' THEN 'missing' WHEN NOT regexp_matches(bare, {_WEB}) THEN 'rejected'
          WHEN list_bool_or([{', '.join(f"contains(host, '{s}')" for s in V.DIRECTORY_HOSTS)}]) THEN 'rejected_directory' ELSE 'valid' END AS status FROM c""",
)
def _(spark, sf):
    return load(spark, sf, "business_entity").select("entity_id", V.website_status(F.col("canonical_website")).alias("status"))


@query(
    "f08_f14_names",
    f"""SELECT provider, provider_record_id, name, regexp_matches(trim(name), '(?i)^(no\\.?\\s*|#\\s*)?\\d{{1,5}}[a-z]?([^A-Za-z0-9_]|$)') OR regexp_matches(trim(name), '(?i){V._STREET_WORDS}\\s*(no\\.?\\s*|#\\s*)?\\d{{1,5}}[a-z]?{V._WORD_END}')
            OR regexp_matches(trim(name), '(?i)\\d{{1,5}}[a-z]?\\s+({V._LOCALITIES}|village|township|estate){V._WORD_END}') AS street_like,
          (regexp_matches(trim(name), '(?i)^(unknown business|unknown|n/a|na|unnamed business|unnamed)$') OR regexp_matches(trim(name), '^(ChIJ[A-Za-z0-9_-]+|(?i:cid:?)\\s*\\d+|\\d{{10,20}}|0x[0-9a-fA-F]+:0x[0-9a-fA-F]+)$')) AS no_name
        FROM (SELECT DISTINCT provider, provider_record_id, name FROM provider_record WHERE trim(name) <> '')""",
)
def _(spark, sf):
    rows = load(spark, sf, "provider_record").filter("trim(name) <> ''").select("provider", "provider_record_id", "name").distinct()
    return rows.select("*", V.street_like(F.col("name")).alias("street_like"), V.synthetic_name(F.col("name")).alias("no_name"))


@query(
    "f02_f03_ratings",
    """SELECT provider, count(*) AS n, count(*) FILTER (WHERE rating BETWEEN 0 AND 5) AS in_range, count(*) FILTER (WHERE rating BETWEEN 1 AND 5) AS in_strict_range,
          round(sum(floor(CASE WHEN rating BETWEEN 1 AND 5 THEN rating END * 10.0 + 0.5) / 10.0), 4) AS rounded_sum, count(*) FILTER (WHERE review_count >= 0) AS counted
        FROM provider_record GROUP BY 1""",
)
def _(spark, sf):
    r = F.col("rating")
    return load(spark, sf, "provider_record").groupBy("provider").agg(
        F.count("*").alias("n"), F.count(F.when(V.rating_in_range(r), 1)).alias("in_range"), F.count(F.when(r.between(1, 5), 1)).alias("in_strict_range"),
        F.round(F.sum(V.strict_rating(r)), 4).alias("rounded_sum"), F.count(F.when(V.valid_count(F.col("review_count")), 1)).alias("counted"),
    )


@query(
    "f17_record_issues",
    f"""SELECT issue, count(*) AS n FROM (SELECT unnest(list_filter([
            CASE WHEN name IS NULL OR {_TRIM('name')} = '' THEN 'name' END, CASE WHEN {_TRIM('category')} = '' THEN 'category' END,
            CASE WHEN phone IS NOT NULL AND ({_TRIM('phone')} = '' OR NOT length(regexp_replace(phone, '[^0-9+]', '', 'g')) BETWEEN 7 AND 15) THEN 'phone' END,
            CASE WHEN website IS NOT NULL AND NOT regexp_matches(website, '(?i)^\\s*https?:/*[^\\s/?#]+') THEN 'website' END,
            CASE WHEN full_address IS NOT NULL AND ({_TRIM('full_address')} = '' OR length({_TRIM('full_address')}) > 300 OR NOT regexp_matches({_TRIM('full_address')}, '{V.ADDRESS_WORDS}')) THEN 'address' END,
            CASE WHEN abs(latitude) > 90 THEN 'latitude' END, CASE WHEN abs(longitude) > 180 THEN 'longitude' END,
            CASE WHEN NOT rating BETWEEN 0 AND 5 THEN 'rating' END, CASE WHEN review_count < 0 THEN 'review_count' END], lambda x: x IS NOT NULL)) AS issue FROM provider_record) GROUP BY 1""",
)
def _(spark, sf):
    return load(spark, sf, "provider_record").select(F.explode(V.record_issues()).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))
