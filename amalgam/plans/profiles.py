"""Queries of the candidate pipeline, envelopes, identity, reviews and gap filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from amalgam.functions import compat as C, text as T
from amalgam.operators import candidates as P, fuse as U, validate as V
from amalgam.operators.breaker import backoff_ms
from amalgam.operators.running import nearest_rank
from amalgam.operators.store import relocate
from amalgam.plans.resolution import _IDS, _fuzzy
from amalgam.plans.scalars import _NANP, _TRIM, _WEB
from amalgam.runtime import load
from amalgam.sources.tables import hints, lookup

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_PROVENANCE = {"google_maps": "identified", "geoapify": "discovered", "user_provided": "user_provided", "official_website": "verified", "web_extraction": "ai_generated"}
_CASE = lambda c, table, other: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v if isinstance(v, float) else repr(v)}" for k, v in table.items()) + f" ELSE {other} END"
#: Field path, its column, and the type it comes with.
_FIELDS = [
    ("identity.name", "name", "string"), ("contact.phone", "phone", "string"), ("contact.email", "email", "string"), ("contact.website", "website", "string"), ("location.full_address", "full_address", "string"),
    ("ratings.rating", "rating", "number"), ("ratings.review_count", "review_count", "number"), ("identity.category", "category", "string"), ("location.city", "city", "string"),
]


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def _phone(x: str) -> str:
    """E.164 without a country, as SQL."""
    d, t = _digits(x), _TRIM(x)
    return f"""coalesce(CASE WHEN (starts_with({t}, '+') OR starts_with({t}, 'tel:+')) AND starts_with({d}, '1') AND regexp_matches(substr({d}, 2), {_NANP}) THEN '+' || {d} END,
      CASE WHEN starts_with({d}, '00') AND starts_with(substr({d}, 3), '1') AND regexp_matches(substr({d}, 4), {_NANP}) THEN '+' || substr({d}, 3) END, CASE WHEN length({d}) = 11 AND starts_with({d}, '1') AND regexp_matches(substr({d}, 2), {_NANP}) THEN '+' || {d} END)"""


def _site(x: str) -> str:
    """The URL of a website and its host, as SQL."""
    full = f"regexp_replace(CASE WHEN starts_with(lower({_TRIM(x)}), 'http') THEN {_TRIM(x)} ELSE 'https://' || {_TRIM(x)} END, '#.*$', '')"
    rest = f"regexp_extract({full}, {_WEB}, 3)"
    return f"CASE WHEN {_TRIM(x)} <> '' AND regexp_matches({full}, {_WEB}) THEN lower(regexp_extract({full}, {_WEB}, 1)) || '://' || lower(regexp_extract({full}, {_WEB}, 2)) || CASE WHEN starts_with({rest}, '/') THEN {rest} ELSE '/' || {rest} END END"


_STREET = rf"""(regexp_matches(trim(value), '(?i)^(no\.?\s*|#\s*)?\d{{1,5}}[a-z]?([^A-Za-z0-9_]|$)') OR regexp_matches(trim(value), '(?i){V._STREET_WORDS}\s*(no\.?\s*|#\s*)?\d{{1,5}}[a-z]?{V._WORD_END}')
  OR regexp_matches(trim(value), '(?i)\d{{1,5}}[a-z]?\s+({V._LOCALITIES}|village|township|estate){V._WORD_END}'))"""
_NO_PHONE = rf"""({_TRIM('value')} = '' OR regexp_matches({_TRIM('value')}, '^-?\d+\.\d+\s*,\s*-?\d+\.\d+$') OR regexp_matches({_TRIM('value')}, '(?i)^[A-Z0-9]{{4,}}\+[A-Z0-9]{{2,}}$')
  OR regexp_matches({_TRIM('value')}, '^\d{{5,6}}(-\d{{4}})?$') OR length({_digits('value')}) < 7 OR regexp_matches({_digits('value')}, '^(0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)$'))"""
_EMAIL = r"""(NOT regexp_matches(trim(value), '(?i)(^|\s)(test|example|user|someone|yourname|your-name)@') AND NOT regexp_matches(trim(value), '(?i)@(example|test|localhost|invalid|yourdomain|your-domain|domain)\.')
  AND NOT contains(value, '..') AND NOT contains(value, '@.') AND NOT ends_with(trim(value), '.') AND NOT starts_with(trim(value), '.') AND regexp_matches(trim(value), '^[^\s@]+@[^\s@]+\.[^\s@]+$'))"""
_HOST_OF = f"lower(regexp_extract({_site('value')}, '^https?://([^/?]+)', 1))"
_NUM = "try_cast(value AS DOUBLE)"
_SEMANTIC = f"""CASE WHEN value IS NULL OR value = '' THEN NULL
  WHEN field = 'ratings.rating' THEN CASE WHEN coalesce({_NUM} BETWEEN 0 AND 5, false) THEN NULL ELSE 'semantic' END
  WHEN field = 'ratings.review_count' THEN CASE WHEN coalesce({_NUM} >= 0 AND {_NUM} = floor({_NUM}), false) THEN NULL ELSE 'semantic' END
  WHEN field = 'contact.phone' THEN CASE WHEN {_NO_PHONE} THEN 'semantic' WHEN {_phone('value')} IS NULL THEN 'semantic:warn' END
  WHEN field = 'contact.email' THEN CASE WHEN NOT {_EMAIL} THEN 'semantic' END
  WHEN field = 'contact.website' THEN CASE WHEN {_TRIM('value')} = '' THEN NULL WHEN {_site('value')} IS NULL OR list_bool_or([{', '.join(f"contains({_HOST_OF}, '{s}')" for s in V.DIRECTORY_HOSTS)}]) THEN 'semantic' END
  WHEN field = 'identity.name' THEN CASE WHEN {_STREET} THEN 'semantic' END END"""
_FORM = lambda x: f"CASE WHEN field = 'contact.phone' THEN {_phone(x)} WHEN field = 'contact.website' THEN {_site(x)} ELSE lower({_TRIM(x)}) END"
_KEY = lambda x: f"CASE WHEN length({_digits(x)}) = 11 AND starts_with({_digits(x)}, '1') THEN substr({_digits(x)}, 2) ELSE {_digits(x)} END"
_IDENTITY = "field IN (" + ", ".join(f"'{p}'" for p in P.IDENTITY_PATHS) + ")"
_CAND = f"""cand AS (SELECT entity_id, field, kind, value, max(confidence) AS confidence, provenance, max(snippet) AS snippet, min(seq) AS seq FROM (
    SELECT entity_id, v.field, v.kind, v.value, least(1.0, 0.5 + coalesce(rating, 0) / 10) AS confidence, {_CASE('provider', _PROVENANCE, "'inferred'")} AS provenance, nullif(city, '') AS snippet, epoch_us(coalesce(fetched_at, ingested_at)) AS seq
    FROM provider_record JOIN {_IDS} i USING (provider, provider_record_id)
    CROSS JOIN LATERAL (VALUES {', '.join(f"('{f}', '{k}', {c if k == 'string' else f'CASE WHEN {c} IS NOT NULL THEN printf({chr(39)}%.4f{chr(39)}, {c}::DOUBLE) END'})" for f, c, k in _FIELDS)}) v(field, kind, value) WHERE v.value <> '') GROUP BY entity_id, field, kind, value, provenance),
prof AS (SELECT entity_id, v.field, v.value, length(canonical_name) % 10 / 10.0 AS confidence FROM business_entity CROSS JOIN LATERAL (VALUES ('identity.name', canonical_name), ('contact.phone', canonical_phone), ('contact.website', canonical_website), ('location.full_address', canonical_address), ('identity.category', category)) v(field, value) WHERE v.value <> ''),
judged AS (SELECT *, list_filter([{_SEMANTIC}, CASE WHEN provenance = 'ai_generated' AND field IN ({', '.join(f"'{p}'" for p in V.EVIDENCE_PATHS)}) AND snippet IS NULL THEN 'evidence' END], lambda x: x IS NOT NULL) AS errors FROM cand),
ranked AS (SELECT *, row_number() OVER (PARTITION BY entity_id, field, len(errors) = 0 ORDER BY {_CASE('provenance', U.SELECTION_RANK, 0.0)} DESC, coalesce(confidence, 0.0) DESC, seq, value) AS k, max(CASE WHEN coalesce(confidence, 0.0) >= CASE WHEN {_IDENTITY} THEN 0.8 ELSE 0.7 END THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id, field) AS cleared FROM judged)"""


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    """What the resolved records say about the fields of their entities; equal statements count once."""
    ids = load(spark, sf, "provider_identity").filter("entity_id IS NOT NULL").select("provider", "provider_record_id", "entity_id").distinct()
    rows = load(spark, sf, "provider_record").join(ids, ["provider", "provider_record_id"])
    text = lambda c, k: F.col(c) if k == "string" else F.when(F.col(c).isNotNull(), F.format_string("%.4f", F.col(c).cast("double")))
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(k).alias("kind"), text(c, k).alias("value")) for f, c, k in _FIELDS])
    provenance = F.coalesce(T.lookup(F.col("provider"), _PROVENANCE), F.lit("inferred"))
    at = F.unix_micros(F.coalesce("fetched_at", "ingested_at").cast("timestamp"))
    long = rows.select(
        "entity_id", provenance.alias("provenance"), F.least(F.lit(1.0), F.lit(0.5) + F.coalesce("rating", F.lit(0.0)) / F.lit(10.0)).alias("confidence"), F.nullif(F.col("city"), F.lit("")).alias("snippet"), at.alias("seq"), F.explode(cells).alias("c")
    ).select("*", "c.*").filter("value <> ''")
    return long.groupBy("entity_id", "field", "kind", "value", "provenance").agg(F.max("confidence").alias("confidence"), F.max("snippet").alias("snippet"), F.min("seq").alias("seq")).withColumn("evidence_id", F.lit(None).cast("string"))


def _profile(spark: SparkSession, sf: str) -> DataFrame:
    b = load(spark, sf, "business_entity")
    columns = {"identity.name": "canonical_name", "contact.phone": "canonical_phone", "contact.website": "canonical_website", "location.full_address": "canonical_address", "identity.category": "category"}
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("value")) for f, c in columns.items()])
    return b.select("entity_id", (F.length("canonical_name") % 10 / F.lit(10.0)).alias("confidence"), F.explode(cells).alias("c")).select("entity_id", "c.*", "confidence").filter("value <> ''")


def _decided(only_if_missing: bool, overwrite: bool) -> str:
    """The pipeline's verdicts as SQL."""
    left = f"""CASE WHEN {str(only_if_missing).lower()} AND p.value <> '' AND NOT {'coalesce(p.confidence < 0.5, false)' if overwrite else 'false'} THEN 'field_populated' WHEN {str(only_if_missing).lower()} AND p.value <> '' AND cleared = 0 THEN 'below_confidence_bar' END"""
    same = f"(p.value = t.value OR (field = 'contact.phone' AND {_digits('p.value')} <> '' AND {_KEY('p.value')} = {_KEY('t.value')}) OR {_FORM('p.value')} IS NOT DISTINCT FROM {_FORM('t.value')})"
    allowed = f"coalesce(p.confidence < 0.5 AND t.confidence >= 0.8, false)" if overwrite else "false"  # noqa: F541
    return f"""WITH {_CAND}, tops AS (SELECT entity_id, field, value, confidence FROM ranked WHERE len(errors) = 0 AND k = 1),
      d AS (SELECT r.*, {left} AS lone, coalesce({_IDENTITY} AND p.value <> '' AND t.value IS NOT NULL AND NOT {same} AND NOT {allowed}, false) AS clash FROM ranked r LEFT JOIN prof p USING (entity_id, field) LEFT JOIN tops t USING (entity_id, field)),
      decided AS (SELECT entity_id, field, value, provenance, CASE WHEN lone IS NOT NULL OR len(errors) > 0 THEN 'rejected' WHEN k = 1 THEN CASE WHEN clash THEN 'conflict' ELSE 'accepted' END WHEN clash THEN 'valid' ELSE 'rejected' END AS status,
        CASE WHEN lone IS NOT NULL THEN lone WHEN len(errors) > 0 THEN array_to_string(errors, '; ') WHEN k > 1 AND NOT clash THEN 'lower_priority' END AS reason FROM d)"""


def _pipeline(spark: SparkSession, sf: str, **options) -> DataFrame:
    return P.run_pipeline(_candidates(spark, sf), ["entity_id"], _profile(spark, sf), **options)


@query("c08_pipeline", f"{_decided(False, True)} SELECT * FROM decided")
def _(spark, sf):
    return _pipeline(spark, sf, overwrite_below=0.5).select("entity_id", "field", "value", "provenance", "status", "reason")


@query("c08_only_if_missing", f"{_decided(True, True)} SELECT * FROM decided")
def _(spark, sf):
    return _pipeline(spark, sf, only_if_missing=True, overwrite_below=0.5).select("entity_id", "field", "value", "provenance", "status", "reason")


@query(
    "a01_a02_diagnostics",
    f"{_decided(False, False)} SELECT field, count(*) AS total, count(*) FILTER (WHERE status = 'accepted') AS accepted, count(*) FILTER (WHERE status = 'rejected') AS rejected, count(*) FILTER (WHERE status = 'conflict') AS conflicted FROM decided GROUP BY 1",
)
def _(spark, sf):
    return P.diagnostics(_pipeline(spark, sf))


@query("f01_f11_verdicts", f"WITH {_CAND} SELECT field, CASE WHEN len(errors) = 0 THEN 'valid' ELSE array_to_string(errors, '; ') END AS verdict, count(*) AS n FROM judged GROUP BY 1, 2")
def _(spark, sf):
    judged = P.verdicts(_candidates(spark, sf), ["entity_id"], _profile(spark, sf))
    return judged.groupBy("field", F.when(F.size("errors") == 0, "valid").otherwise(F.array_join("errors", "; ")).alias("verdict")).agg(F.count("*").alias("n"))


_GROUPS = {"identity": ["name", "category"], "contact": ["phone", "website"]}


def _enveloped(spark: SparkSession, sf: str) -> DataFrame:
    wrap = lambda c, s: P.provenance_wrap(F.col(c), F.col("canonical_latitude") / F.lit(50.0), F.lit("discovered"), F.col(s))
    return load(spark, sf, "business_entity").select(
        "entity_id",
        F.struct(wrap("canonical_name", "source_id").alias("name"), wrap("category", "source_id").alias("category")).alias("identity"),
        F.struct(wrap("canonical_phone", "source_id").alias("phone"), wrap("canonical_website", "source_id").alias("website")).alias("contact"),
    )


@query(
    "proj04_proj07_flat",
    """SELECT entity_id, path, value, round(least(1.0, greatest(0.0, canonical_latitude / 50.0)), 6) AS confidence, 'discovered' AS provenance FROM business_entity
       CROSS JOIN LATERAL (VALUES ('identity.name', canonical_name), ('identity.category', category), ('contact.phone', canonical_phone), ('contact.website', canonical_website)) v(path, value) WHERE value <> ''""",
)
def _(spark, sf):
    flat = P.flatten_envelopes(_enveloped(spark, sf), ["entity_id"], _GROUPS)
    return flat.withColumn("confidence", F.round("confidence", 6))


@query(
    "proj06_renested",
    "SELECT entity_id, nullif(canonical_name, '') AS name, nullif(canonical_phone, '') AS phone FROM business_entity WHERE coalesce(nullif(canonical_name, ''), nullif(category, ''), nullif(canonical_phone, ''), nullif(canonical_website, '')) IS NOT NULL",
)
def _(spark, sf):
    nested = P.renest(P.flatten_envelopes(_enveloped(spark, sf), ["entity_id"], _GROUPS), ["entity_id"], _GROUPS)
    return nested.select("entity_id", P.unwrap(F.col("identity.name")).alias("name"), P.unwrap(F.col("contact.phone")).alias("phone"))


@query(
    "proj14_machine_fields",
    """SELECT doc_id, text AS value, round(greatest(0.0, least(1.0, coalesce(align_score, 0.0))), 6) AS confidence, length(substr(coalesce(tgt_text, ''), 1, 400)) AS evidence_chars FROM documents WHERE text NOT IN ('', '[]', 'null')""",
)
def _(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.to_json(F.struct(F.col("text").alias("value"), F.coalesce("align_score", F.lit(0.0)).alias("confidence"), F.coalesce("tgt_text", F.lit("")).alias("evidence"))).alias("j"))
    e = d.select("doc_id", P.unwrap_machine_envelope(F.col("j")).alias("e")).filter("e IS NOT NULL")
    return e.select("doc_id", "e.value", F.round("e.confidence", 6).alias("confidence"), F.length("e.evidence").alias("evidence_chars"))


@query("proj15_site_paths", f"WITH {_CAND} SELECT field, count(*) AS n FROM cand WHERE field IN ({', '.join(repr(p) for p in P.SITE_PATHS)}) GROUP BY 1")
def _(spark, sf):
    return P.allowed_paths(_candidates(spark, sf), P.SITE_PATHS).groupBy("field").agg(F.count("*").alias("n"))


_T = lambda c: f"coalesce({_TRIM(c)} <> '', false)"


@query(
    "m08_f15_identity",
    f"""WITH r AS (SELECT DISTINCT provider, provider_record_id, name, phone, website, full_address, city, latitude, longitude, {_T('name')} AS n, coalesce(length({_TRIM('phone')}) >= 7, false) AS p, {_T('website')} AS w, {_T('full_address')} AS a, {_T('city')} AS c,
            latitude IS NOT NULL AND longitude IS NOT NULL AS g, provider = 'google_maps' AND {_T('provider_record_id')} AS i, coalesce(regexp_matches({_TRIM('name')}, '{P.GENERIC_NAMES}'), false) AS gen,
            coalesce(name <> '' AND NOT regexp_matches({_TRIM('name')}, '(?i)^(unknown\\s*business|unknown|n/a|unnamed business|na)$'), false) AS real FROM provider_record),
          s AS (SELECT *, CASE WHEN (n AND a AND p) OR (i AND n AND (p OR a OR w)) THEN 'very_strong' WHEN n AND (p OR w) THEN 'strong' WHEN (n AND (a OR c)) OR p THEN 'moderate' WHEN (n AND NOT gen) OR w OR g THEN 'weak' ELSE 'insufficient' END AS strength,
            least(1.0, floor((CASE WHEN gen THEN 0.1 WHEN n THEN 0.35 ELSE 0.0 END + CASE WHEN p THEN 0.3 ELSE 0.0 END + CASE WHEN w THEN 0.25 ELSE 0.0 END + CASE WHEN a THEN 0.25 WHEN c THEN 0.1 ELSE 0.0 END + CASE WHEN g THEN 0.2 ELSE 0.0 END + CASE WHEN i THEN 0.3 ELSE 0.0 END) * 100.0 + 0.5) / 100.0) AS score,
            CASE WHEN provider = 'web_extraction' THEN i ELSE real OR coalesce(latitude <> 0, false) OR i OR coalesce(phone <> '', false) OR coalesce(website <> '', false) OR coalesce(full_address <> '' AND NOT regexp_matches({_TRIM('full_address')}, '(?i)^(unknown|n/a)$'), false) END AS sufficient FROM r)
        SELECT strength, sufficient, count(*) AS n, round(sum(score), 4) AS score FROM s GROUP BY 1, 2""",
)
def _(spark, sf):
    r = load(spark, sf, "provider_record").select("provider", "provider_record_id", "name", "phone", "website", "full_address", "city", "latitude", "longitude").distinct()
    place_id, none = F.when(F.col("provider") == "google_maps", F.col("provider_record_id")), F.lit(None).cast("string")
    m = P.identity_strength(*[F.col(c) for c in ("name", "phone", "website", "full_address", "city", "latitude", "longitude")], place_id)
    enough = P.sufficient_identity(F.col("name"), none, F.col("latitude"), F.lit(None).cast("double"), place_id, F.col("phone"), F.col("website"), F.col("full_address"), F.col("provider") == "web_extraction")
    return r.select(m["strength"].alias("strength"), m["score"].alias("score"), enough.alias("sufficient")).groupBy("strength", "sufficient").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("score"))


@query(
    "j12_corroborated",
    f"""WITH x AS (SELECT DISTINCT provider, provider_record_id, entity_id, canonical_name, canonical_phone, name, phone FROM provider_record JOIN {_IDS} i USING (provider, provider_record_id) JOIN business_entity USING (entity_id)),
        y AS (SELECT *, {_phone('canonical_phone')} AS a, {_phone('phone')} AS b, coalesce(canonical_name <> '' AND name <> '', false) AS named, {_fuzzy('canonical_name', 'name')} AS s FROM x)
        SELECT CASE WHEN coalesce(a = b, false) THEN 'phone_exact' WHEN named THEN 'name_similarity' ELSE 'no_corroborating_signal' END AS reason, CASE WHEN coalesce(a = b, false) THEN true WHEN named THEN s >= 0.75 ELSE false END AS matched, count(*) AS n FROM y GROUP BY 1, 2""",
)
def _(spark, sf):
    ids = load(spark, sf, "provider_identity").filter("entity_id IS NOT NULL").select("provider", "provider_record_id", "entity_id").distinct()
    x = load(spark, sf, "provider_record").join(ids, ["provider", "provider_record_id"]).join(load(spark, sf, "business_entity").select("entity_id", "canonical_name", "canonical_phone"), "entity_id")
    x = x.select("provider", "provider_record_id", "entity_id", "canonical_name", "canonical_phone", "name", "phone").distinct()
    c = P.site_corroborates(F.col("canonical_name"), F.col("canonical_phone"), F.col("name"), F.col("phone"))
    return x.select(c["reason"].alias("reason"), c["matched"].alias("matched")).groupBy("reason", "matched").agg(F.count("*").alias("n"))


_FACTS = "CROSS JOIN LATERAL (VALUES ('name', {0}), ('phone', {1}), ('website', {2}), ('address', {3}), ('category', {4})) v(field, value)"


@query(
    "f21_factual_issues",
    f"""WITH m AS (SELECT DISTINCT provider, provider_record_id, entity_id, v.field, v.value FROM provider_record JOIN {_IDS} i USING (provider, provider_record_id) {_FACTS.format('name', 'phone', 'website', 'full_address', 'category')} WHERE v.value <> ''),
        f AS (SELECT entity_id, v.field, v.value AS fact FROM business_entity {_FACTS.format('canonical_name', 'canonical_phone', 'canonical_website', 'canonical_address', 'category')}),
        j AS (SELECT field, CASE WHEN coalesce(fact, '') = '' THEN 'fabricated' WHEN fact <> value THEN 'mismatch' END AS issue FROM m JOIN f USING (entity_id, field))
        SELECT field, issue, field <> 'category' AS fatal, count(*) AS n FROM j WHERE issue IS NOT NULL GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    ids = load(spark, sf, "provider_identity").filter("entity_id IS NOT NULL").select("provider", "provider_record_id", "entity_id").distinct()
    cells = lambda names: F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("value")) for f, c in names.items()])).alias("c")
    made = load(spark, sf, "provider_record").join(ids, ["provider", "provider_record_id"]).select("provider", "provider_record_id", "entity_id", cells({"name": "name", "phone": "phone", "website": "website", "address": "full_address", "category": "category"})).select("provider", "provider_record_id", "entity_id", "c.*").distinct()
    facts = load(spark, sf, "business_entity").select("entity_id", cells({"name": "canonical_name", "phone": "canonical_phone", "website": "canonical_website", "address": "canonical_address", "category": "category"})).select("entity_id", "c.*")
    return P.factual_issues(made, facts, ["entity_id"]).groupBy("field", "issue", "fatal").agg(F.count("*").alias("n"))


_FILL = {"name": 0.9, "phone": 0.85, "website": 0.8, "category": 0.7, "full_address": 0.75}


@query(
    "c24_filled_gaps",
    f"""WITH o AS (SELECT entity_id, v.field, v.value, epoch_us(coalesce(fetched_at, ingested_at)) AS seq, b.canonical_phone, phone FROM provider_record JOIN {_IDS} i USING (provider, provider_record_id) JOIN business_entity b USING (entity_id)
            CROSS JOIN LATERAL (VALUES ('name', name, canonical_name), ('phone', phone, canonical_phone), ('website', website, canonical_website), ('category', provider_record.category, b.category), ('full_address', full_address, canonical_address)) v(field, value, old)
            WHERE v.value <> '' AND coalesce(v.old, '') = '' AND NOT coalesce(length({_digits('phone')}) >= 7 AND length({_digits('canonical_phone')}) >= 7 AND {_digits('phone')} <> {_digits('canonical_phone')}, false)
              AND NOT coalesce(abs(latitude) <= 90 AND abs(longitude) <= 180 AND abs(canonical_latitude) <= 90 AND abs(canonical_longitude) <= 180 AND sqrt(pow(latitude - canonical_latitude, 2) + pow(longitude - canonical_longitude, 2)) > 0.35, false))
        SELECT entity_id, field, arg_min(value, (seq, value)) AS value, {_CASE('field', _FILL, 'NULL')} AS confidence FROM o GROUP BY 1, 2""",
)
def _(spark, sf):
    """Deterministic gap fill behind the record gate: conflicting records offer nothing."""
    ids = load(spark, sf, "provider_identity").filter("entity_id IS NOT NULL").select("provider", "provider_record_id", "entity_id").distinct()
    none = lambda c: F.lit(None).cast("string").alias(c)
    a = load(spark, sf, "provider_record").join(ids, ["provider", "provider_record_id"]).select(
        "entity_id", F.unix_micros(F.coalesce("fetched_at", "ingested_at").cast("timestamp")).alias("seq"), *_FILL,
        F.col("phone").alias("a_phone"), F.col("latitude").alias("a_latitude"), F.col("longitude").alias("a_longitude"), *[none(f"a_{c}") for c in ("city", "state", "postal_code", "provider_record_id")],
    )
    e = load(spark, sf, "business_entity")
    b = e.select("entity_id", F.col("canonical_phone").alias("b_phone"), F.col("canonical_latitude").alias("b_latitude"), F.col("canonical_longitude").alias("b_longitude"), *[none(f"b_{c}") for c in ("city", "state", "postal_code", "provider_record_id")])
    passed = a.join(b, "entity_id").filter(F.size(V.record_conflicts("a_", "b_")) == 0)
    profile = U.unpivot(e.select("entity_id", F.col("canonical_name").alias("name"), F.col("canonical_phone").alias("phone"), F.col("canonical_website").alias("website"), "category", F.col("canonical_address").alias("full_address")), ["entity_id"], list(_FILL))
    return P.fill_gaps(profile, U.unpivot(passed, ["entity_id", "seq"], list(_FILL)), ["entity_id"], _FILL)


@query(
    "c23_machine_values",
    f"""WITH o AS (SELECT DISTINCT e.entity_id, 'contact.phone' AS field, phone AS value FROM dataset_example d JOIN business_entity e ON lower({_TRIM('d.name')}) = lower({_TRIM('e.canonical_name')}) WHERE d.phone <> '' AND coalesce(e.canonical_phone, '') = '' AND d.quality_score >= 0.6
            AND length({_TRIM('phone')}) >= 8 AND contains(lower(array_to_string(list_transform(evidence, lambda x: coalesce(x.text, '')), ' ')), lower({_TRIM('phone')})))
        SELECT * FROM o WHERE NOT {_NO_PHONE} AND {_phone('value')} IS NOT NULL""",
)
def _(spark, sf):
    d = load(spark, sf, "dataset_example").select(F.lower(C.trim_blank(F.col("name"))).alias("k"), F.col("phone").alias("value"), "quality_score", F.array_join(F.transform("evidence", lambda x: F.coalesce(x["text"], F.lit(""))), " ").alias("evidence"))
    e = load(spark, sf, "business_entity").select("entity_id", F.lower(C.trim_blank(F.col("canonical_name"))).alias("k"), "canonical_phone")
    offered = d.join(e, "k").select("entity_id", F.lit("contact.phone").alias("field"), "value", F.col("quality_score").alias("confidence"), F.col("value").alias("snippet"), "evidence")
    profile = e.select("entity_id", F.lit("contact.phone").alias("field"), F.col("canonical_phone").alias("value"))
    return P.accept_machine_values(offered, profile, ["entity_id"]).select("entity_id", "field", "value").distinct()


@query(
    "c17_review_decisions",
    """WITH r AS (SELECT id, CASE WHEN status IN ('dismissed', 'rejected') THEN 'rejected' WHEN status IN ('confirmed', 'approved') THEN 'approved' ELSE 'pending' END AS status, match_type AS kind, CASE WHEN match_score > 0.5 THEN entity_id END AS rel, CASE WHEN confidence >= 0.5 THEN 'approved' WHEN confidence >= 0.1 THEN 'rejected' WHEN confidence IS NOT NULL THEN 'maybe' END AS d
            FROM (SELECT id, max(status) AS status, max(match_type) AS match_type, max(match_score) AS match_score, max(entity_id) AS entity_id, max(confidence) AS confidence FROM resolution_record GROUP BY 1)),
         e AS (SELECT *, CASE WHEN d IS NULL THEN NULL WHEN d = 'maybe' THEN 'invalid_decision' WHEN status <> 'pending' AND status <> d THEN 'already_resolved' WHEN status = 'pending' AND d = 'approved' AND kind = 'relocated_entity' AND rel IS NOT NULL THEN 'ambiguous_merge' END AS error FROM r),
         a AS (SELECT *, status = 'pending' AND error IS NULL AND d IS NOT NULL AS acts FROM e)
       SELECT CASE WHEN acts THEN d ELSE status END AS new_status, CASE WHEN acts AND d = 'approved' THEN CASE WHEN kind IN ('same_entity', 'uncertain') AND rel IS NOT NULL THEN 'merge' WHEN kind = 'relocated_entity' THEN 'relocate' ELSE 'none' END ELSE 'none' END AS action, error, count(*) AS n FROM a GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    status = F.when(F.col("status").isin("dismissed", "rejected"), "rejected").when(F.col("status").isin("confirmed", "approved"), "approved").otherwise("pending")
    whole = load(spark, sf, "resolution_record").groupBy("id").agg(*[F.max(c).alias(c) for c in ("status", "match_type", "match_score", "entity_id", "confidence")])
    rows = whole.select(F.col("id").alias("review_id"), status.alias("status"), "match_type", F.when(F.col("match_score") > 0.5, F.col("entity_id")).alias("related_entity_id"), "confidence")
    d = rows.select("review_id", F.when(F.col("confidence") >= 0.5, "approved").when(F.col("confidence") >= 0.1, "rejected").when(F.col("confidence").isNotNull(), "maybe").alias("decision")).filter("decision IS NOT NULL")
    return P.decide_reviews(rows.drop("confidence"), d).groupBy("new_status", "action", "error").agg(F.count("*").alias("n"))


@query(
    "c20_reloaded",
    f"""WITH f AS (SELECT entity_id, 'identity.name' AS field, canonical_name AS value FROM business_entity UNION ALL SELECT id, 'metadata', metadata FROM source_ref)
        SELECT field, CASE WHEN starts_with({_TRIM('value')}, '{{') AND ends_with({_TRIM('value')}, '}}') AND json_valid(value) THEN 'object' WHEN starts_with({_TRIM('value')}, '[') AND ends_with({_TRIM('value')}, ']') AND json_valid(value) THEN 'array' ELSE 'string' END AS kind, count(*) AS n
        FROM f WHERE NOT coalesce(field = 'identity.name' AND {_STREET}, false) GROUP BY 1, 2""",
)
def _(spark, sf):
    names = load(spark, sf, "business_entity").select("entity_id", F.lit("identity.name").alias("field"), F.col("canonical_name").alias("value"))
    meta = load(spark, sf, "source_ref").select(F.col("id").alias("entity_id"), F.lit("metadata").alias("field"), F.col("metadata").alias("value"))
    return P.reload_canonical(names.unionByName(meta)).groupBy("field", "kind").agg(F.count("*").alias("n"))


@query(
    "c19_relocated",
    """WITH m AS (SELECT entity_id, min(notes) AS new_address FROM resolution_record WHERE match_type = 'relocated_entity' AND notes <> '' GROUP BY 1) SELECT entity_id, coalesce(new_address, canonical_address) AS canonical_address FROM business_entity LEFT JOIN m USING (entity_id)""",
)
def _(spark, sf):
    moves = load(spark, sf, "resolution_record").filter("match_type = 'relocated_entity' AND notes <> ''").groupBy("entity_id").agg(F.min("notes").alias("new_address"))
    return relocate(load(spark, sf, "business_entity"), moves).select("entity_id", "canonical_address")


@query(
    "f08_f09_f10_f12_f13_f20_gates",
    f"""WITH r AS (SELECT DISTINCT provider, provider_record_id, name, rating, review_count, city, email FROM provider_record)
        SELECT provider, count(*) FILTER (WHERE provider = 'web_extraction' AND city IS NULL AND name IS NOT NULL) AS ungated, count(*) FILTER (WHERE coalesce(rating = review_count, false)) AS swapped, count(*) FILTER (WHERE name IS NOT NULL AND name <> '') AS populated,
          count(*) FILTER (WHERE coalesce(rating / 5 < 0.6 AND review_count / 100.0 >= 0.8, false)) AS replaced, count(*) FILTER (WHERE CASE WHEN email IS NULL THEN coalesce(rating, 0) = 0 ELSE rating > 0 END) AS wellformed FROM r GROUP BY 1""",
)
def _(spark, sf):
    r = load(spark, sf, "provider_record").select("provider", "provider_record_id", "name", "rating", "review_count", "city", "email").distinct()
    kind = F.when(F.col("provider") == "web_extraction", "ai_generated").otherwise("discovered")
    gate = V.evidence_gate(kind, F.lit("identity.name"), F.col("city"), F.lit(None).cast("string")) & F.col("name").isNotNull()
    replace = V.may_replace_weak(F.col("rating") / F.lit(5), F.col("review_count") / F.lit(100.0), F.lit(True), 0.6)
    known, score = F.col("email").isNotNull(), F.coalesce("rating", F.lit(0.0))
    sound = V.envelope_wellformed(F.col("email"), F.when(known, "discovered").otherwise("unknown"), F.when(known, "extracted").otherwise("missing"), F.when(known, F.col("rating")).otherwise(score), F.lit(0))
    return r.groupBy("provider").agg(
        F.count_if(gate).alias("ungated"), F.count_if(V.swapped_numbers(F.col("rating"), F.col("review_count"))).alias("swapped"), F.count_if(V.populated(F.col("name"))).alias("populated"),
        F.count_if(replace).alias("replaced"), F.count_if(sound).alias("wellformed"),
    )


@query(
    "f22_f23_pages",
    """SELECT s.provider, count(*) AS n, count(*) FILTER (WHERE NOT regexp_matches(lower(""" + _TRIM("url") + """), '^https://[^/:?#]+') ) AS no_https, count(*) FILTER (WHERE coalesce(contains(lower(metadata), 'server error') AND contains(lower(metadata), 'try again later'), false)) AS noise FROM source_ref s WHERE url IS NOT NULL GROUP BY 1""",
)
def _(spark, sf):
    s = load(spark, sf, "source_ref").filter("url IS NOT NULL")
    return s.groupBy("provider").agg(F.count("*").alias("n"), F.count_if(V.blocked_url(F.col("url"))).alias("no_https"), F.count_if(V.noise_page(F.coalesce("metadata", F.lit("")))).alias("noise"))


@query(
    "n11_n18_links",
    """SELECT id, regexp_matches(trim(url), '(?i)^https?://[^/ ]+') AS kept, trim(regexp_replace(regexp_replace(domain || ' 12 reviews  and 5 reviews', '[0-9]+ reviews', ''), '\\s+', ' ', 'g')) AS text FROM source_ref WHERE url IS NOT NULL AND domain IS NOT NULL""",
)
def _(spark, sf):
    s = load(spark, sf, "source_ref").filter("url IS NOT NULL AND domain IS NOT NULL")
    return s.select("id", (F.size(T.social_links(F.array("url"))) > 0).alias("kept"), T.remove_first(F.concat("domain", F.lit(" 12 reviews  and 5 reviews")), "[0-9]+ reviews").alias("text"))


@query(
    "w12_backoffs",
    "SELECT event_id, least(5000.0, CASE WHEN event_type = 'error' THEN 1000.0 ELSE 250.0 END * pow(2.0, event_id % 6)) AS wait_ms FROM events",
)
def _(spark, sf):
    e = load(spark, sf, "events")
    return e.select("event_id", backoff_ms(F.col("event_id") % 6, F.col("event_type") == "error").alias("wait_ms"))


@query(
    "a26_cache_hits",
    "SELECT event_type, count(*) FILTER (WHERE first) AS misses, count(*) FILTER (WHERE NOT first) AS hits, round(count(*) FILTER (WHERE NOT first) / count(*), 6) AS hit_rate FROM (SELECT event_type, row_number() OVER (PARTITION BY event_type, user_id) = 1 AS first FROM events) GROUP BY 1",
)
def _(spark, sf):
    """A cache of answers by (event type, user): all but the first ask are hits."""
    asked = load(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    hits, n = F.sum(F.col("n") - 1), F.sum("n")
    return asked.groupBy("event_type").agg(F.count("*").alias("misses"), hits.alias("hits"), F.round(hits / n, 6).alias("hit_rate"))


@query(
    "f26_jobs",
    "SELECT event_type AS status, count(*) AS jobs, round(sum(value), 4) AS places FROM events WHERE event_type IN ('error', 'purchase') AND ts >= (SELECT min(ts) + INTERVAL 1 DAY FROM events) GROUP BY 1",
)
def _(spark, sf):
    """Jobs of a status and a time on, and their counts by status."""
    e = load(spark, sf, "events")
    begin = e.agg((F.min(F.col("ts").cast("timestamp")) + F.expr("INTERVAL 1 DAY")).alias("t")).first()["t"]
    jobs = e.filter(F.col("event_type").isin("error", "purchase") & (F.col("ts").cast("timestamp") >= F.lit(begin)))
    return jobs.groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("jobs"), F.round(F.sum("value"), 4).alias("places"))


@query(
    "f28_routable",
    """WITH p AS (SELECT user_id, count(*) AS calls, quantile_disc(value, 0.5) AS p50, count(*) FILTER (WHERE event_type = 'error') AS bad, round(sum(value), 6) AS cost FROM events GROUP BY 1) SELECT user_id, round(cost, 4) AS cost, p50 FROM p WHERE bad < 5 AND cost <= 5000 AND p50 <= 100""",
)
def _(spark, sf):
    e = load(spark, sf, "events")
    p50 = nearest_rank(e, "user_id", "value", {"p50": 0.5})
    p = e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("bad"), F.round(F.sum("value"), 6).alias("cost")).join(p50, "user_id")
    states = p.withColumns({"configured": F.lit(True), "usable": F.lit(True), "cooldown_ms": F.when(F.col("bad") >= 5, 30000.0).otherwise(0.0), "circuit": F.when(F.col("bad") >= 5, "OPEN").otherwise("CLOSED"), "quota_reached": F.lit(False)})
    return P.routable(states, 5000.0, 100.0).select("user_id", F.round("cost", 4).alias("cost"), "p50")


@query("s05_lookups", "SELECT b.entity_id, s.id, s.url FROM business_entity b JOIN source_ref s ON s.id = b.source_id WHERE b.entity_id = (SELECT min(entity_id) FROM business_entity WHERE source_id IS NOT NULL)")
def _(spark, sf):
    """A row by its key, then the one it refers to by another; both filters reach the scans."""
    b = load(spark, sf, "business_entity")
    key = b.filter("source_id IS NOT NULL").agg(F.min("entity_id").alias("k")).first()["k"]
    row = lookup(b, entity_id=key).select("entity_id", "source_id").first()
    source = lookup(load(spark, sf, "source_ref"), id=row["source_id"] if row else None)
    return source.select(F.lit(row["entity_id"] if row else None).cast("string").alias("entity_id"), "id", "url")


@query("s08_hints", "SELECT DISTINCT provider_record_id, name, city, latitude AS lat, longitude AS lng FROM provider_record WHERE provider = 'user_provided' OR provider = 'google_maps'")
def _(spark, sf):
    return hints(load(spark, sf, "provider_record").filter("provider IN ('user_provided', 'google_maps')").select("provider_record_id", "name", "city", "latitude", "longitude")).distinct()


@query("proj11_minimal", "SELECT entity_id AS id, canonical_name AS name, category, status, canonical_phone AS phone, canonical_website AS website, canonical_address AS address, epoch_us(created_at) AS created_us, epoch_us(updated_at) AS updated_us FROM business_entity")
def _(spark, sf):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return load(spark, sf, "business_entity").select(
        F.col("entity_id").alias("id"), F.col("canonical_name").alias("name"), "category", "status", F.col("canonical_phone").alias("phone"), F.col("canonical_website").alias("website"), F.col("canonical_address").alias("address"), us("created_at").alias("created_us"), us("updated_at").alias("updated_us"),
    )


@query(
    "u05_concat_reviews",
    "SELECT example_id, len(list_concat(evidence, list_filter(evidence, lambda x: x.url IS NOT NULL))) AS reviews FROM (SELECT DISTINCT example_id, evidence FROM dataset_example WHERE evidence IS NOT NULL)",
)
def _(spark, sf):
    """Reviews and extended reviews one behind the other; a missing list is empty."""
    d = load(spark, sf, "dataset_example").filter("evidence IS NOT NULL").select("example_id", "evidence").distinct()
    extended = F.filter("evidence", lambda x: x["url"].isNotNull())
    return d.select("example_id", F.size(F.concat(F.coalesce("evidence", F.array()), F.coalesce(extended, F.array()))).cast("long").alias("reviews"))


@query(
    "proj09_intelligence",
    """SELECT b.entity_id, list_filter([canonical_name, category], lambda x: x IS NOT NULL) AS facts, list_filter([CASE WHEN canonical_phone IS NULL THEN 'phone' END, CASE WHEN canonical_website IS NULL THEN 'website' END, CASE WHEN canonical_address IS NULL THEN 'address' END], lambda x: x IS NOT NULL) AS unknowns,
         list_filter([CASE WHEN s.is_primary THEN 'primary_source' END, CASE WHEN s.authority >= 0.8 THEN 'authority' END], lambda x: x IS NOT NULL) AS trust, CASE WHEN s.source_type = 'ai_inference' THEN 'ai_extracted_from_evidence' WHEN s.id IS NOT NULL THEN 'source_extracted' ELSE 'unavailable' END AS reputation
       FROM business_entity b LEFT JOIN source_ref s ON s.id = b.source_id""",
)
def _(spark, sf):
    s = load(spark, sf, "source_ref").select(F.col("id").alias("source_id"), "is_primary", "authority", "source_type", F.lit(True).alias("known"))
    b = load(spark, sf, "business_entity").join(s, "source_id", "left")
    missing = F.array_compact(F.array(*[F.when(F.col(f"canonical_{c}").isNull(), c) for c in ("phone", "website", "address")]))
    reputation = F.when(F.col("source_type") == "ai_inference", "ai_extracted_from_evidence").when(F.col("known"), "source_extracted").otherwise("unavailable")
    return b.select(
        "entity_id", F.array_compact(F.array("canonical_name", "category")).alias("facts"), missing.alias("unknowns"),
        F.array_compact(F.array(F.when(F.col("is_primary"), "primary_source"), F.when(F.col("authority") >= 0.8, "authority"))).alias("trust"), reputation.alias("reputation"),
    )


@query(
    "c21_rerun_reviews",
    f"""WITH r AS (SELECT DISTINCT provider_a AS provider, provider_record_id_a AS provider_record_id FROM resolution_record WHERE match_type = 'uncertain' AND provider_record_id_a IS NOT NULL), a AS (SELECT DISTINCT entity_id FROM r JOIN {_IDS} i USING (provider, provider_record_id)),
        o AS (SELECT entity_id, field, value, fetched_at, (ingested_at, provider, provider_record_id, value) AS seq FROM provider_record JOIN {_IDS} i USING (provider, provider_record_id) JOIN a USING (entity_id) CROSS JOIN LATERAL (VALUES ('name', name), ('phone', phone), ('website', website)) v(field, value) WHERE value <> ''),
        l AS (SELECT entity_id, arg_max(value, (fetched_at, seq)) FILTER (WHERE field = 'name') AS name, arg_max(value, (fetched_at, seq)) FILTER (WHERE field = 'phone') AS phone, arg_max(value, (fetched_at, seq)) FILTER (WHERE field = 'website') AS website FROM o GROUP BY 1)
        SELECT entity_id, coalesce(l.name, nullif(canonical_name, '')) AS name, coalesce(l.phone, nullif(canonical_phone, '')) AS phone, coalesce(l.website, nullif(canonical_website, '')) AS website,
          list_filter([CASE WHEN coalesce(l.phone, nullif(canonical_phone, '')) IS NULL THEN 'phone' END, CASE WHEN coalesce(l.website, nullif(canonical_website, '')) IS NULL THEN 'website' END], lambda x: x IS NOT NULL) AS unknowns
        FROM a JOIN business_entity b USING (entity_id) LEFT JOIN l USING (entity_id)""",
)
def _(spark, sf):
    """The entities that uncertain matches touch, with their profiles made anew: latest
    observations (P3) over the canonical values (C10), and what stays unknown."""
    ids = load(spark, sf, "provider_identity").filter("entity_id IS NOT NULL").select("provider", "provider_record_id", "entity_id").distinct()
    touched = load(spark, sf, "resolution_record").filter("match_type = 'uncertain' AND provider_record_id_a IS NOT NULL").select(F.col("provider_a").alias("provider"), F.col("provider_record_id_a").alias("provider_record_id")).distinct()
    affected = touched.join(ids, ["provider", "provider_record_id"]).select("entity_id").distinct()
    records = load(spark, sf, "provider_record").join(ids.join(affected, "entity_id", "left_semi"), ["provider", "provider_record_id"])
    obs = U.unpivot(records, ["entity_id", "fetched_at", "ingested_at", "provider", "provider_record_id"], ["name", "phone", "website"]).withColumn("seq", F.struct("ingested_at", "provider", "provider_record_id", "value"))
    latest = U.pivot_latest(obs, "entity_id", ["name", "phone", "website"], "fetched_at", "seq")
    b = load(spark, sf, "business_entity").join(affected, "entity_id", "left_semi").join(latest, "entity_id", "left")
    value = lambda c: F.coalesce(c, F.nullif(F.col(f"canonical_{c}"), F.lit("")))
    return b.select(
        "entity_id", value("name").alias("name"), value("phone").alias("phone"), value("website").alias("website"),
        F.array_compact(F.array(*[F.when(value(c).isNull(), c) for c in ("phone", "website")])).alias("unknowns"),
    )


@query(
    "t05_observations",
    "SELECT id, provider_b, recorded_us FROM (SELECT id, provider_b, epoch_us(recorded_at) AS recorded_us FROM resolution_record WHERE recorded_at IS NOT NULL ORDER BY recorded_at, id, provider_b LIMIT 100)",
)
def _(spark, sf):
    """The first hundred in ascending order; the limit is the page asked for."""
    r = load(spark, sf, "resolution_record").filter("recorded_at IS NOT NULL").orderBy("recorded_at", "id", "provider_b").limit(100)
    return r.select("id", "provider_b", F.unix_micros(F.col("recorded_at").cast("timestamp")).alias("recorded_us"))


@query(
    "proj08_canonical",
    f"""WITH p AS (SELECT entity_id, list_sort(list_distinct(list(provider || ':' || provider_record_id))) AS providers, max(CASE WHEN rating BETWEEN 0 AND 5 THEN rating END) AS rating, max(CASE WHEN review_count >= 0 THEN review_count END) AS review_count, bool_or(provider = 'web_extraction') AS machine
          FROM provider_record JOIN {_IDS} i USING (provider, provider_record_id) GROUP BY 1),
        n AS (SELECT *, regexp_matches({_TRIM('canonical_name')}, '(?i)^(unknown business|unknown|n/a|na|unnamed business|unnamed)$') OR regexp_matches({_TRIM('canonical_name')}, '^(ChIJ[A-Za-z0-9_-]+|(?i:cid:?)\\s*\\d+|\\d{{10,20}}|0x[0-9a-fA-F]+:0x[0-9a-fA-F]+)$') AS synthetic,
          nullif(regexp_replace(regexp_extract(lower({_TRIM('canonical_website')}), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@ ]*@)?([^/?#: ]+)', 1), '^www\\.', ''), '') AS domain FROM business_entity)
        SELECT entity_id, CASE WHEN canonical_name <> '' AND NOT synthetic THEN canonical_name END AS name, domain, nullif(canonical_phone, '') AS phone, coalesce(providers, []) AS providers, rating, review_count,
          CASE WHEN rating IS NULL AND review_count IS NULL THEN 'unavailable' WHEN rating IS NULL THEN 'partial' WHEN machine THEN 'ai_extracted_from_evidence' ELSE 'source_extracted' END AS reputation FROM n LEFT JOIN p USING (entity_id)""",
)
def _(spark, sf):
    """One record an entity: persisted fields, names that are none left out, bare
    domain, its distinct provider records, numbers in range, and how its reputation is known."""
    ids = load(spark, sf, "provider_identity").filter("entity_id IS NOT NULL").select("provider", "provider_record_id", "entity_id").distinct()
    p = load(spark, sf, "provider_record").join(ids, ["provider", "provider_record_id"]).groupBy("entity_id").agg(
        F.array_sort(F.collect_set(F.concat_ws(":", "provider", "provider_record_id"))).alias("providers"), F.max(F.when(V.rating_in_range(F.col("rating")), F.col("rating"))).alias("rating"),
        F.max(F.when(F.col("review_count") >= 0, F.col("review_count"))).alias("review_count"), F.bool_or(F.col("provider") == "web_extraction").alias("machine"),
    )
    name = F.col("canonical_name")
    reputation = (
        F.when(F.col("rating").isNull() & F.col("review_count").isNull(), "unavailable").when(F.col("rating").isNull(), "partial").when(F.col("machine"), "ai_extracted_from_evidence").otherwise("source_extracted")
    )
    return load(spark, sf, "business_entity").join(p, "entity_id", "left").select(
        "entity_id", F.when((name != "") & ~V.synthetic_name(name), name).alias("name"), T.normalize_domain(F.col("canonical_website")).alias("domain"), F.nullif(F.col("canonical_phone"), F.lit("")).alias("phone"),
        F.coalesce("providers", F.array().cast("array<string>")).alias("providers"), "rating", "review_count", reputation.alias("reputation"),
    )
