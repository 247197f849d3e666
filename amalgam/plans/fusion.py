"""Queries of fusion over merge groups and provider records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from amalgam.operators import fuse as U
from amalgam.plans.resolution import latest_records
from amalgam.runtime import load

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_FIELDS = ["name", "phone", "website", "full_address", "category"]
_PROVENANCE = {"official_website": "verified", "structured_provider": "discovered", "user_provided": "user_provided", "directory": "identified", "search_result": "inferred", "other": "inferred", "ai_inference": "ai_generated"}
_PROV_SQL = "CASE source_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _PROVENANCE.items()) + " ELSE 'inferred' END"
_RANK_SQL = lambda t: "CASE provenance " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in t.items()) + " ELSE 0.0 END"
_CAND = f"""cand AS (SELECT merge_group, s.id AS source, s.domain, authority, retrieved_at, {_PROV_SQL} AS provenance, CASE WHEN authority > 1 THEN authority / 100 ELSE authority END AS confidence,
      field, value, row_number() OVER (PARTITION BY merge_group ORDER BY b.created_at, b.entity_id) AS seq
    FROM business_entity b JOIN source_ref s ON b.source_id = s.id
    CROSS JOIN LATERAL (VALUES ('name', canonical_name), ('phone', canonical_phone), ('website', canonical_website), ('full_address', canonical_address), ('category', category)) v(field, value)
    WHERE merge_group IS NOT NULL AND value <> '')"""


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Field candidates of every merge group; ``seq`` orders them by arrival."""
    src = load(spark, sf, "source_ref").select(F.col("id").alias("source_id"), "domain", "authority", "retrieved_at", "source_type")
    rows = load(spark, sf, "business_entity").filter("merge_group IS NOT NULL").join(src, "source_id").select(
        "merge_group", F.col("source_id").alias("source"), "domain", "authority", "retrieved_at", "source_type", "created_at", "entity_id",
        F.col("canonical_name").alias("name"), F.col("canonical_phone").alias("phone"), F.col("canonical_website").alias("website"), F.col("canonical_address").alias("full_address"), "category",
    )
    keys = ["merge_group", "source", "domain", "authority", "retrieved_at", "source_type", "created_at", "entity_id"]
    provenance = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _PROVENANCE.items() for x in kv]), F.col("source_type")), F.lit("inferred"))
    confidence = F.when(F.col("authority") > 1, F.col("authority") / 100).otherwise(F.col("authority"))
    long = U.unpivot(rows, keys, _FIELDS)
    return long.withColumns({"provenance": provenance, "confidence": confidence})


def _sequenced(spark: SparkSession, sf: str) -> DataFrame:
    """Arrival as a number that needs no window: microseconds, then a hash of the row's id."""
    c = candidates(spark, sf)
    return c.withColumn("seq", F.unix_micros(F.col("created_at").cast("timestamp")) * 1.0)


_SEQ = _CAND.replace("row_number() OVER (PARTITION BY merge_group ORDER BY b.created_at, b.entity_id)", "epoch_us(b.created_at)::DOUBLE")


@query(
    "proj01_candidates",
    f"WITH {_SEQ} SELECT field, provenance, count(*) AS n, count(DISTINCT merge_group) AS groups, round(avg(confidence), 6) AS confidence FROM cand GROUP BY 1, 2",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _sequenced(spark, sf).groupBy("field", "provenance").agg(
        F.count("*").alias("n"), F.countDistinct("merge_group").alias("groups"), F.round(F.avg("confidence"), 6).alias("confidence")
    )


@query(
    "proj02_observations",
    f"WITH {_SEQ} SELECT merge_group, source, field, value, round(greatest(0.0, least(1.0, confidence * CASE field WHEN 'category' THEN 0.85 WHEN 'website' THEN 0.85 WHEN 'full_address' THEN 0.9 ELSE 0.95 END)), 6) AS confidence FROM cand",
)
def _(spark, sf):
    return U.observations(_sequenced(spark, sf), F.col("confidence")).select("merge_group", "source", "field", "value", F.round("confidence", 6).alias("confidence"))


@query(
    "w01_c08_selected",
    f"""WITH {_SEQ}, r AS (SELECT *, {_RANK_SQL(U.SELECTION_RANK)} AS p, rank() OVER (PARTITION BY merge_group, field ORDER BY {_RANK_SQL(U.SELECTION_RANK)} DESC, coalesce(confidence, 0.0) DESC, seq) AS k FROM cand)
        SELECT merge_group, source, field, value, CASE WHEN k = 1 THEN 'accepted' ELSE 'rejected' END AS status, CASE WHEN k > 1 THEN 'lower_priority' END AS reason FROM r""",
)
def _(spark, sf):
    return U.best_candidates(_sequenced(spark, sf), ["merge_group"]).select("merge_group", "source", "field", "value", "status", "reason")


@query(
    "a02_pipeline_counts",
    f"""WITH {_SEQ}, r AS (SELECT *, rank() OVER (PARTITION BY merge_group, field ORDER BY {_RANK_SQL(U.SELECTION_RANK)} DESC, coalesce(confidence, 0.0) DESC, seq) AS k FROM cand)
        SELECT field, count(*) AS total, count(*) FILTER (WHERE k = 1) AS accepted, count(*) FILTER (WHERE k > 1) AS rejected FROM r GROUP BY 1""",
)
def _(spark, sf):
    b = U.best_candidates(_sequenced(spark, sf), ["merge_group"])
    return b.groupBy("field").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "accepted").alias("accepted"), F.count_if(F.col("status") == "rejected").alias("rejected"))


@query(
    "proj03_w02_profiles",
    """WITH p AS (SELECT provider, provider_record_id, i.entity_id, fetched_at, ingested_at, field, value FROM provider_record JOIN (SELECT DISTINCT provider, provider_record_id, entity_id FROM provider_identity WHERE entity_id IS NOT NULL) i USING (provider, provider_record_id)
          CROSS JOIN LATERAL (VALUES ('name', name), ('phone', phone), ('website', website), ('category', category)) v(field, value) WHERE value <> '')
       SELECT entity_id, arg_max(value, (fetched_at, ingested_at, provider, provider_record_id, value)) FILTER (WHERE field = 'name') AS name, arg_max(value, (fetched_at, ingested_at, provider, provider_record_id, value)) FILTER (WHERE field = 'phone') AS phone,
         arg_max(value, (fetched_at, ingested_at, provider, provider_record_id, value)) FILTER (WHERE field = 'website') AS website, arg_max(value, (fetched_at, ingested_at, provider, provider_record_id, value)) FILTER (WHERE field = 'category') AS category FROM p GROUP BY 1""",
)
def _(spark, sf):
    ids = load(spark, sf, "provider_identity").filter("entity_id IS NOT NULL").select("provider", "provider_record_id", "entity_id").distinct()
    rows = load(spark, sf, "provider_record").join(ids, ["provider", "provider_record_id"])
    obs = U.unpivot(rows, ["entity_id", "fetched_at", "ingested_at", "provider", "provider_record_id"], ["name", "phone", "website", "category"])
    obs = obs.withColumn("seq", F.struct("ingested_at", "provider", "provider_record_id", "value"))
    return U.pivot_latest(obs, "entity_id", ["name", "phone", "website", "category"], "fetched_at", "seq")


@query(
    "w03_c10_upserts",
    f"""WITH {_SEQ}, r AS (SELECT *, {_RANK_SQL(U.UPSERT_RANK)} AS tier FROM cand)
        SELECT merge_group, field, arg_max(value, (tier, coalesce(confidence, 0.0), -seq)) AS value, max(tier) AS tier, count(*) AS n_observations,
          round(max((tier, coalesce(confidence, 0.0)))[2], 6) AS confidence FROM r GROUP BY 1, 2""",
)
def _(spark, sf):
    return U.upsert_gate(_sequenced(spark, sf), ["merge_group", "field"]).withColumn("confidence", F.round("confidence", 6))


@query(
    "c09_c11_canonical",
    f"""WITH RECURSIVE {_SEQ}, t AS (SELECT merge_group, field, value, seq, coalesce(confidence, 0.0) AS confidence, {_RANK_SQL(U.UPSERT_RANK)} AS tier, 0.4 * {_RANK_SQL(U.CANONICAL_RANK).replace('ELSE 0.0', 'ELSE 1.0')} + 0.15 + 0.3 * coalesce(confidence, 0.5) AS strength FROM cand),
        f AS (SELECT *, max(confidence) OVER (PARTITION BY merge_group, field, value, tier ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM t),
        c AS (SELECT *, field IN ('name', 'phone', 'website', 'full_address', 'coordinates') AS firm, row_number() OVER (PARTITION BY merge_group, field ORDER BY seq, value, confidence, tier) AS k FROM f WHERE seen IS NULL OR confidence > seen),
        m(merge_group, field, k, value, tier, confidence, strength, conflicts) AS (
          SELECT merge_group, field, k, value, tier, confidence, strength, 0 FROM c WHERE k = 1
          UNION ALL
          SELECT merge_group, field, k, CASE WHEN change THEN new_value ELSE value END, CASE WHEN change THEN new_tier ELSE tier END, CASE WHEN change THEN new_confidence ELSE confidence END, CASE WHEN change THEN new_strength ELSE strength END, conflicts + CASE WHEN differs THEN 1 ELSE 0 END
          FROM (SELECT m.*, c.k AS next_k, c.value AS new_value, c.tier AS new_tier, c.confidence AS new_confidence, c.strength AS new_strength, m.value <> c.value AS differs,
                  CASE WHEN m.value <> c.value AND c.firm THEN c.strength > m.strength + 0.2 ELSE c.tier > m.tier OR (c.tier = m.tier AND c.confidence > m.confidence) END AS change
                FROM m JOIN c ON c.merge_group = m.merge_group AND c.field = m.field AND c.k = m.k + 1) x(merge_group, field, old_k, value, tier, confidence, strength, conflicts, k, new_value, new_tier, new_confidence, new_strength, differs, change))
        SELECT merge_group, field, arg_max(value, k) AS value, arg_max(tier, k) AS tier, round(arg_max(confidence, k), 6) AS confidence, arg_max(conflicts, k) AS conflicts FROM m GROUP BY 1, 2""",
)
def _(spark, sf):
    return U.canonical_fold(_sequenced(spark, sf), ["merge_group", "field"], F.col("field").isin(*U.IDENTITY_FIELDS)).withColumn("confidence", F.round("confidence", 6))


@query(
    "c13_strategies",
    f"""WITH {_SEQ} SELECT merge_group, field, count(DISTINCT value) AS n_values, arg_max(value, (coalesce(authority, -1e9), -seq)) AS by_authority,
          arg_max(value, (coalesce(retrieved_at, TIMESTAMPTZ '0001-01-01'), -seq)) AS by_recency, arg_max(value, (coalesce(confidence, -1e9), -seq)) AS by_confidence FROM cand GROUP BY 1, 2""",
)
def _(spark, sf):
    v = _sequenced(spark, sf).withColumn("observed", F.col("retrieved_at"))
    return U.resolve_conflicts(v, ["merge_group", "field"], "seq")


@query(
    "c14_claims",
    f"""WITH {_SEQ}, n AS (SELECT *, lower(trim(value)) AS v, {_RANK_SQL(U.CANONICAL_RANK)} AS t FROM cand) SELECT merge_group, field, v AS value, count(*) AS n_observations, count(DISTINCT source) AS n_sources, max(confidence) AS confidence, max(t) AS tier FROM n GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return U.claims(_sequenced(spark, sf).withColumn("value", F.lower(F.trim("value"))), ["merge_group", "field"])


@query(
    "m05_strengths",
    f"""WITH {_SEQ} SELECT provenance, count(*) AS n, round(avg(0.4 * {_RANK_SQL(U.CANONICAL_RANK).replace('ELSE 0.0', 'ELSE 1.0')} + 0.3 * coalesce(CASE WHEN authority > 1 THEN authority / 100 ELSE authority END, 0.5) + 0.3 * coalesce(confidence, 0.5)), 6) AS strength FROM cand GROUP BY 1""",
)
def _(spark, sf):
    c = _sequenced(spark, sf)
    return c.groupBy("provenance").agg(F.count("*").alias("n"), F.round(F.avg(U.evidence_strength(F.col("provenance"), F.col("confidence"), F.col("confidence"))), 6).alias("strength"))


_SRC = "(SELECT merge_group, s.id, s.domain, s.is_primary, s.authority, s.source_type FROM business_entity b JOIN source_ref s ON b.source_id = s.id WHERE merge_group IS NOT NULL)"


def _sources(spark, sf):
    return load(spark, sf, "business_entity").filter("merge_group IS NOT NULL").select("merge_group", F.col("source_id").alias("id")).join(
        load(spark, sf, "source_ref").select("id", "domain", "is_primary", "authority", "source_type"), "id"
    )


@query(
    "a30_independence",
    f"""SELECT merge_group, count(*) AS total, count(DISTINCT coalesce(domain, 'unknown')) AS domains, count(*) FILTER (WHERE is_primary) AS primaries, round(least(1.0, count(*) FILTER (WHERE is_primary) / count(*)), 6) AS score,
          count(*) > 1 AND count(DISTINCT coalesce(domain, 'unknown')) = 1 AS copied, (SELECT string_agg(t || ':' || k, ',' ORDER BY t) FROM (SELECT coalesce(domain, 'unknown') AS t, count(*) AS k FROM {_SRC} i WHERE i.merge_group = o.merge_group GROUP BY 1)) AS histogram FROM {_SRC} o GROUP BY 1""",
)
def _(spark, sf):
    out = U.source_independence(_sources(spark, sf), "merge_group").withColumn("score", F.round("score", 6))
    entries = F.array_sort(F.transform(F.map_entries("histogram"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))))
    return out.withColumn("histogram", F.array_join(entries, ","))


@query(
    "m06_group_confidence",
    f"""WITH g AS (SELECT merge_group, avg(CASE WHEN authority > 1 THEN authority / 100 ELSE authority END) AS base, count(DISTINCT domain) AS n, bool_or(coalesce(is_primary, false)) AS p, count(*) AS e, count(DISTINCT source_type) > 2 AS c FROM {_SRC} GROUP BY 1),
        a AS (SELECT *, greatest(0.0, least(1.0, base + CASE WHEN n > 1 THEN 0.1 * least(n, 3) ELSE 0.0 END)) AS s1 FROM g), b AS (SELECT *, greatest(0.0, least(1.0, s1 + CASE WHEN p THEN 0.05 ELSE 0.0 END)) AS s2 FROM a),
        c AS (SELECT *, greatest(0.0, least(1.0, s2 + CASE WHEN e > 1 THEN 0.05 * least(e, 3) ELSE 0.0 END)) AS s3 FROM b)
        SELECT merge_group, round(greatest(0.0, least(1.0, s3 - CASE WHEN c THEN 0.15 ELSE 0.0 END)), 6) AS confidence FROM c WHERE base IS NOT NULL""",
)
def _(spark, sf):
    a = F.when(F.col("authority") > 1, F.col("authority") / 100).otherwise(F.col("authority"))
    g = _sources(spark, sf).groupBy("merge_group").agg(
        F.avg(a).alias("base"), F.countDistinct("domain").alias("n"), F.bool_or(F.coalesce("is_primary", F.lit(False))).alias("p"), F.count("*").alias("e"), (F.countDistinct("source_type") > 2).alias("c")
    )
    return g.filter("base IS NOT NULL").select("merge_group", F.round(U.confidence_with_evidence(F.col("base"), F.col("n"), F.col("p"), F.col("e"), F.col("c")), 6).alias("confidence"))


@query(
    "a31_a34_completeness",
    """SELECT provider, count(*) AS n, round(avg((CASE WHEN name <> '' THEN 1 ELSE 0 END + CASE WHEN category <> '' THEN 1 ELSE 0 END + CASE WHEN phone <> '' THEN 1 ELSE 0 END + CASE WHEN email <> '' THEN 1 ELSE 0 END + CASE WHEN website <> '' THEN 1 ELSE 0 END
          + CASE WHEN full_address <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(latitude, 0) <> 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(rating, 0) <> 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(review_count, 0) <> 0 THEN 1 ELSE 0 END) / 9.0), 6) AS completeness FROM provider_record GROUP BY 1""",
)
def _(spark, sf):
    text = [F.when(F.col(c) != "", 1).otherwise(0) for c in ("name", "category", "phone", "email", "website", "full_address")]
    numbers = [F.when(F.coalesce(F.col(c), F.lit(0)) != 0, 1).otherwise(0) for c in ("latitude", "rating", "review_count")]
    filled = sum(text + numbers, F.lit(0))
    return load(spark, sf, "provider_record").groupBy("provider").agg(F.count("*").alias("n"), F.round(F.avg(filled / F.lit(9.0)), 6).alias("completeness"))


_SLOTS = sorted({*_PROVENANCE.values()})


@query(
    "a32_provenance_table",
    f"WITH {_SEQ} SELECT field, " + ", ".join(f"count(*) FILTER (WHERE provenance = '{p}') AS {p}" for p in _SLOTS) + " FROM cand GROUP BY 1",
)
def _(spark, sf):
    t = _sequenced(spark, sf).groupBy("field").pivot("provenance", _SLOTS).count()
    return t.select("field", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in _SLOTS])


@query(
    "a34_record_confidence",
    """SELECT provider, provider_record_id, greatest(0.5, least(0.9, (CASE WHEN name <> '' THEN 1 ELSE 0 END + CASE WHEN provider_record_id <> '' THEN 1 ELSE 0 END + CASE WHEN full_address <> '' THEN 1 ELSE 0 END + CASE WHEN phone <> '' THEN 1 ELSE 0 END + CASE WHEN website <> '' THEN 1 ELSE 0 END
         + CASE WHEN coalesce(rating, 0) <> 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(review_count, 0) <> 0 THEN 1 ELSE 0 END + CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN 1 ELSE 0 END) / 8.0)) AS confidence, epoch_us(ingested_at) AS at_us FROM provider_record""",
)
def _(spark, sf):
    p = load(spark, sf, "provider_record")
    filled = [F.when(F.col(c) != "", 1).otherwise(0) for c in ("name", "provider_record_id", "full_address", "phone", "website")] + [F.when(F.coalesce(F.col(c), F.lit(0)) != 0, 1).otherwise(0) for c in ("rating", "review_count")]
    filled.append(F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), 1).otherwise(0))
    share = sum(filled, F.lit(0)) / F.lit(8.0)
    return p.select("provider", "provider_record_id", F.greatest(F.lit(0.5), F.least(F.lit(0.9), share)).alias("confidence"), F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("at_us"))


@query(
    "s10_latest_records",
    """SELECT provider, provider_record_id, name, phone, epoch_us(fetched_at) AS fetched_us FROM provider_record QUALIFY row_number() OVER (PARTITION BY provider, provider_record_id ORDER BY ingested_at DESC, fetched_at DESC, name DESC NULLS LAST) = 1""",
)
def _(spark, sf):
    return latest_records(spark, sf).select("provider", "provider_record_id", "name", "phone", F.unix_micros(F.col("fetched_at").cast("timestamp")).alias("fetched_us"))


@query(
    "j04_fields_with_sources",
    """SELECT b.entity_id, s.provider, s.source_type FROM business_entity b LEFT JOIN source_ref s ON b.source_id = s.id""",
)
def _(spark, sf):
    s = load(spark, sf, "source_ref").select(F.col("id").alias("source_id"), "provider", "source_type")
    return load(spark, sf, "business_entity").select("entity_id", "source_id").join(s, "source_id", "left").select("entity_id", "provider", "source_type")


@query(
    "d06_expired_sources",
    "SELECT count(*) AS n, count(*) FILTER (WHERE retrieved_at + INTERVAL 30 DAY < TIMESTAMPTZ '2025-07-01 00:00:00+00') AS expired FROM source_ref",
)
def _(spark, sf):
    old = F.col("retrieved_at") + F.expr("INTERVAL 30 DAYS") < F.lit("2025-07-01 00:00:00").cast("timestamp")
    return load(spark, sf, "source_ref").agg(F.count("*").alias("n"), F.count_if(old).alias("expired"))
