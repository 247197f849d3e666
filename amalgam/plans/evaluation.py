"""Queries of evaluation: predictions are provider records, gold is the entity row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from amalgam.operators import evaluate as E
from amalgam.plans.resolution import _IDS
from amalgam.runtime import load

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_CELLS = "(VALUES ('name', {0}), ('phone', {1}), ('website', {2}), ('category', {3})) v(field, value)"
_PER = f"""
ids AS {_IDS.replace('SELECT DISTINCT', 'SELECT DISTINCT resolution_confidence AS confidence,')},
pairs AS (SELECT i.provider, i.provider_record_id, i.entity_id, i.confidence, p.fetched_at, p.ingested_at, p.name AS n1, p.phone AS n2, p.website AS n3, p.category AS n4, b.canonical_name AS m1, b.canonical_phone AS m2, b.canonical_website AS m3, b.category AS m4
  FROM provider_record p JOIN ids i USING (provider, provider_record_id) JOIN business_entity b USING (entity_id)),
per AS (SELECT *, a IS NOT NULL AND g IS NOT NULL AND (lower(trim(a)) = lower(trim(g)) OR (field = 'phone' AND regexp_replace(a, '[^0-9]', '', 'g') = regexp_replace(g, '[^0-9]', '', 'g') AND regexp_replace(a, '[^0-9]', '', 'g') <> '')) AS correct
  FROM (SELECT provider, provider_record_id, entity_id, confidence, fetched_at, ingested_at, field, nullif(a, '') AS a, nullif(g, '') AS g FROM pairs CROSS JOIN LATERAL (VALUES ('name', n1, m1), ('phone', n2, m2), ('website', n3, m3), ('category', n4, m4)) v(field, a, g))),
conf AS (SELECT field, provider, count(*) FILTER (WHERE a IS NOT NULL AND g IS NOT NULL AND correct) AS tp, count(*) FILTER (WHERE a IS NOT NULL AND NOT correct) AS fp, count(*) FILTER (WHERE a IS NULL AND g IS NOT NULL) AS fn, count(*) FILTER (WHERE a IS NULL AND g IS NULL) AS tn FROM per GROUP BY 1, 2)"""


def _compared(spark: SparkSession, sf: str) -> DataFrame:
    ids = load(spark, sf, "provider_identity").filter("entity_id IS NOT NULL").select("provider", "provider_record_id", "entity_id", F.col("resolution_confidence").alias("confidence")).distinct()
    keys = ["provider", "provider_record_id", "entity_id", "fetched_at", "ingested_at"]
    rows = load(spark, sf, "provider_record").join(ids, ["provider", "provider_record_id"])
    gold = load(spark, sf, "business_entity").select("entity_id", *[F.col(c).alias(f"g_{f}") for f, c in (("name", "canonical_name"), ("phone", "canonical_phone"), ("website", "canonical_website"), ("category", "category"))])
    fields = ["name", "phone", "website", "category"]
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), F.col(f"g_{f}").alias("gold")) for f in fields])
    long = rows.join(gold, "entity_id").select(*keys, "confidence", F.explode(cells).alias("c")).select(*keys, "confidence", "c.*")
    predicted, expected = F.when(F.col("value") != "", F.col("value")), F.when(F.col("gold") != "", F.col("gold"))
    out = long.select(*keys, "confidence", "field", predicted.alias("predicted"), expected.alias("expected"))
    return out.withColumn("correct", F.col("predicted").isNotNull() & F.col("expected").isNotNull() & E.eval_equivalent(F.col("field"), F.col("predicted"), F.col("expected")))


_RATES = """floor((CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END) * 10000.0 + 0.5) / 10000.0 AS precision, floor((CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END) * 10000.0 + 0.5) / 10000.0 AS recall,
  floor((CASE WHEN (CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END) + (CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END) > 0 THEN 2 * (CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END) * (CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END)
    / ((CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END) + (CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END)) ELSE 0.0 END) * 10000.0 + 0.5) / 10000.0 AS f1,
  floor((CASE WHEN fp + tn > 0 THEN tn / (fp + tn) ELSE 1.0 END) * 10000.0 + 0.5) / 10000.0 AS abstention, floor((CASE WHEN tp + fp > 0 THEN fp / (tp + fp) ELSE 0.0 END) * 10000.0 + 0.5) / 10000.0 AS hallucination,
  floor((CASE WHEN tp + fn > 0 THEN fn / (tp + fn) ELSE 0.0 END) * 10000.0 + 0.5) / 10000.0 AS miss"""


@query("a03_a04_field_metrics", f"WITH {_PER} SELECT *, {_RATES} FROM (SELECT field, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn FROM conf GROUP BY 1)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return E.rates(_compared(spark, sf).groupBy("field").agg(*E.confusion()))


@query("a05_micro_by_provider", f"WITH {_PER} SELECT *, {_RATES} FROM (SELECT provider, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn FROM conf GROUP BY 1)")
def _(spark, sf):
    return E.rates(_compared(spark, sf).groupBy("provider").agg(*E.confusion()))


@query(
    "a16_benchmark_rates",
    f"""WITH {_PER} SELECT provider, field, count(*) AS n, round(avg(CASE WHEN a IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS extracted, round(avg(CASE WHEN correct OR (a IS NULL AND g IS NULL) THEN 1.0 ELSE 0.0 END), 6) AS correct,
          round(avg(CASE WHEN a IS NOT NULL AND g IS NULL THEN 1.0 ELSE 0.0 END), 6) AS invented FROM per GROUP BY GROUPING SETS ((), (provider), (field))""",
)
def _(spark, sf):
    rows = _compared(spark, sf)
    one = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    p, e = F.col("predicted").isNotNull(), F.col("expected").isNotNull()
    return rows.groupingSets([[], ["provider"], ["field"]], "provider", "field").agg(
        F.count("*").alias("n"), one(p).alias("extracted"), one(F.col("correct") | (~p & ~e)).alias("correct"), one(p & ~e).alias("invented")
    )


_BIN = "CASE " + " ".join(f"WHEN confidence >= {k / 10} AND confidence < {(k + 1) / 10} THEN {k}" for k in range(9)) + " WHEN confidence >= 0.9 AND confidence <= 1.0 THEN 9 END"
_CAL = "SELECT confidence, status IN ('merged', 'confirmed') AS correct FROM resolution_record"
_R4 = lambda x: f"floor(({x}) * 10000.0 + 0.5) / 10000.0"


@query(
    "a09_calibration",
    f"""WITH p AS (SELECT confidence, CASE WHEN correct THEN 1.0 ELSE 0.0 END AS y FROM ({_CAL}) WHERE confidence IS NOT NULL AND correct IS NOT NULL),
        b AS (SELECT {_BIN} AS bin, count(*) AS n, sum(y) AS hits, sum(confidence) AS conf, sum(pow(confidence - y, 2)) AS sq, count(*) FILTER (WHERE confidence >= 0.85 AND y = 0) AS bold FROM p GROUP BY 1)
        SELECT sum(n)::BIGINT AS n, {_R4('sum(sq) / sum(n)')} AS brier, {_R4('sum(hits) / sum(n)')} AS accuracy, {_R4('sum(conf) / sum(n)')} AS mean_confidence, {_R4('sum(CASE WHEN bin IS NOT NULL THEN abs(conf - hits) END) / sum(n)')} AS ece, {_R4('sum(bold) / sum(n)')} AS false_confidence FROM b""",
)
def _(spark, sf):
    return E.calibration(load(spark, sf, "resolution_record").select("confidence", F.col("status").isin("merged", "confirmed").alias("correct")))


@query(
    "a10_m07_bands",
    """SELECT CASE WHEN confidence >= 0.85 THEN 'HIGH' WHEN confidence >= 0.65 THEN 'MEDIUM' WHEN confidence >= 0.4 THEN 'LOW' ELSE 'UNSUPPORTED' END AS band, count(*) AS n, round(coalesce(avg(CASE WHEN confidence >= 0.4 THEN confidence END), 0.0), 6) AS overall FROM resolution_record GROUP BY 1""",
)
def _(spark, sf):
    c = F.col("confidence")
    return load(spark, sf, "resolution_record").groupBy(E.confidence_band(c).alias("band")).agg(F.count("*").alias("n"), F.round(E.overall_confidence(c), 6).alias("overall"))


_EV = "(SELECT DISTINCT example_id, name, split, task, evidence FROM dataset_example)"


def _examples(spark: SparkSession, sf: str) -> DataFrame:
    """One row per example: deliveries differ in ingested_at only."""
    rows = load(spark, sf, "dataset_example")
    return rows.drop("ingested_at").distinct()


@query(
    "c22_grounding",
    """WITH e AS (SELECT DISTINCT example_id, task, lower(trim(name)) AS s, lower(array_to_string(list_transform(evidence, lambda x: coalesce(x.text, '')), ' ')) AS t FROM dataset_example)
       SELECT task, count(*) FILTER (WHERE s IS NOT NULL AND length(regexp_replace(s, '\\s+', ' ', 'g')) >= 8 AND contains(t, regexp_replace(s, '\\s+', ' ', 'g'))) AS grounded, count(*) FILTER (WHERE s IS NULL OR length(regexp_replace(s, '\\s+', ' ', 'g')) < 8) AS unverifiable, count(*) AS n
       FROM (SELECT task, regexp_replace(regexp_replace(s, '[\\x{00A0}\\s]+', ' ', 'g'), '^ | $', '', 'g') AS s, regexp_replace(t, '[\\x{00A0}\\s]+', ' ', 'g') AS t, example_id FROM e) GROUP BY 1""",
)
def _(spark, sf):
    rows = _examples(spark, sf)
    text = F.array_join(F.transform("evidence", lambda e: F.coalesce(e["text"], F.lit(""))), " ")
    g = E.grounding(F.col("name"), text)
    return rows.groupBy("task").agg(F.count_if(g == "grounded").alias("grounded"), F.count_if(g == "unverifiable").alias("unverifiable"), F.count("*").alias("n"))


@query(
    "j08_leaked_phones",
    """SELECT k, count(DISTINCT s) AS n_splits, count(*) AS n_rows FROM (SELECT DISTINCT example_id, right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) AS k, lower(trim(split)) AS s FROM dataset_example WHERE phone <> '') GROUP BY 1 HAVING count(DISTINCT s) > 1""",
)
def _(spark, sf):
    rows = _examples(spark, sf).filter("phone <> ''").select("example_id", F.right(F.regexp_replace("phone", "[^0-9]", ""), F.lit(10)).alias("k"), F.lower(F.trim("split")).alias("s")).distinct()
    return E.leaked_keys(rows, "k", "s")


@query("a15_task_by_split", "SELECT task, count(*) FILTER (WHERE s = 'train') AS train, count(*) FILTER (WHERE s = 'validation') AS validation, count(*) FILTER (WHERE s = 'holdout') AS holdout FROM (SELECT DISTINCT example_id, task, lower(trim(split)) AS s FROM dataset_example) GROUP BY 1")
def _(spark, sf):
    splits = ["train", "validation", "holdout"]
    t = _examples(spark, sf).select("example_id", "task", F.lower(F.trim("split")).alias("s")).distinct().groupBy("task").pivot("s", splits).count()
    return t.select("task", *[F.coalesce(F.col(s), F.lit(0)).alias(s) for s in splits])


_COVERED = """x AS (SELECT DISTINCT example_id, task, lower(trim(split)) AS s, category IS NOT NULL AS cats, phone IS NULL OR address IS NULL OR website IS NULL AS abstains, website IS NULL AS no_site FROM dataset_example),
      t AS (SELECT * FROM x WHERE s = 'train'),
      cover AS (SELECT 'schema-nested-generative' AS category, count(*) AS examples, min(example_id) AS first_example FROM t WHERE task IN ('brand.dna', 'strategy.website', 'strategy.landing_page')
        UNION ALL SELECT 'category-list', count(*), min(example_id) FROM t WHERE cats UNION ALL SELECT 'hours-as-string', 0, NULL UNION ALL SELECT 'unknown-abstention', count(*), min(example_id) FROM t WHERE abstains
        UNION ALL SELECT 'website-exists-false', count(*), min(example_id) FROM t WHERE task = 'website.analysis' AND no_site UNION ALL SELECT 'provenance-enum-discipline', count(*), min(example_id) FROM t WHERE task = 'extraction.business_profile')"""


def _covering(spark: SparkSession, sf: str) -> DataFrame:
    return _examples(spark, sf).select(
        "example_id", "task", F.lower(F.trim("split")).alias("split"), F.col("category").isNotNull().alias("has_categories"), F.lit(False).alias("hours_as_text"),
        (F.col("phone").isNull() | F.col("address").isNull() | F.col("website").isNull()).alias("abstains"), F.col("website").isNull().alias("no_website"),
    ).distinct()


@query(
    "a14_dataset_quality",
    """WITH %s, e AS (SELECT DISTINCT example_id, task, lower(trim(split)) AS s, name, address, phone, website, len(evidence) AS n, len(list_filter(evidence, lambda y: y.text <> '')) AS k FROM dataset_example), c AS (SELECT task, count(*) AS k FROM e WHERE s = 'train' GROUP BY 1),
         b AS (SELECT coalesce(1 - (max(k) - min(k)) / sum(k), 1.0) AS balance FROM c), v AS (SELECT avg(CASE WHEN examples > 0 THEN 1.0 ELSE 0.0 END) AS coverage FROM cover),
         q AS (SELECT avg(CASE WHEN name <> '' THEN 1.0 ELSE 0.0 END) AS contract, coalesce(1.0 - avg(CASE WHEN task = 'extraction.business_profile' THEN CASE WHEN k > 0 THEN 0.0 ELSE 1.0 END END), 1.0) AS grounding, avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END) AS evidence,
           least(1.0, avg(CASE WHEN phone IS NULL OR address IS NULL OR website IS NULL THEN 1.0 ELSE 0.0 END) / 0.25) AS unknown, CASE WHEN count(*) FILTER (WHERE s = 'validation') > 0 AND count(*) FILTER (WHERE s = 'holdout') > 0 THEN 1.0 ELSE 0.5 END AS splits FROM e)
       SELECT round(contract, 6) AS contract, round(grounding, 6) AS grounding, round(evidence, 6) AS evidence, round(unknown, 6) AS unknown, round(balance, 6) AS balance, round(coverage, 6) AS coverage, splits,
         floor((0.3 * contract + 0.2 * grounding + 0.1 * evidence + 0.1 * unknown + 0.1 * balance + 0.1 * coverage + 0.1 * splits) * 1000.0 + 0.5) / 1000.0 AS quality FROM q, b, v""" % _COVERED,
)
def _(spark, sf):
    filled = F.size(F.filter("evidence", lambda x: F.coalesce(x["text"] != "", F.lit(False))))
    e = _examples(spark, sf).select("example_id", "task", F.lower(F.trim("split")).alias("s"), "name", "address", "phone", "website", F.size("evidence").alias("n"), filled.alias("k")).distinct()
    per_task = e.groupBy("task").agg(
        F.count("*").alias("all"), F.count_if(F.col("s") == "train").alias("train"), F.count_if(F.col("s") == "validation").alias("validation"), F.count_if(F.col("s") == "holdout").alias("holdout"),
        F.count_if(F.col("name") != "").alias("named"), F.count_if(F.col("n") > 0).alias("backed"), F.count_if(F.col("k") > 0).alias("grounded"),
        F.count_if(F.col("phone").isNull() | F.col("address").isNull() | F.col("website").isNull()).alias("open"),
    )  # a row a task
    n, train = F.sum("all"), F.when(F.col("train") > 0, F.col("train"))
    extracted = F.col("task") == "extraction.business_profile"
    q = per_task.agg(
        (F.sum("named") / n).alias("contract"), F.coalesce(F.sum(F.when(extracted, F.col("grounded"))) / F.sum(F.when(extracted, F.col("all"))), F.lit(1.0)).alias("grounding"), (F.sum("backed") / n).alias("evidence"),
        F.least(F.lit(1.0), F.sum("open") / n / F.lit(0.25)).alias("unknown"), F.coalesce(F.lit(1.0) - (F.max(train) - F.min(train)) / F.sum(train), F.lit(1.0)).alias("balance"),
        F.when((F.sum("validation") > 0) & (F.sum("holdout") > 0), 1.0).otherwise(0.5).alias("splits"),
    )
    covered = E.failure_coverage(_covering(spark, sf)).agg(F.avg(F.when(F.col("examples") > 0, 1.0).otherwise(0.0)).alias("coverage"))
    q = q.crossJoin(F.broadcast(covered))  # one row each
    score = sum((F.lit(w) * F.col(c) for c, w in E.QUALITY_WEIGHTS.items()), F.lit(0.0))
    return q.select(*[F.round(c, 6).alias(c) for c in ("contract", "grounding", "evidence", "unknown", "balance", "coverage")], "splits", E.js_round(score, 3).alias("quality"))


_FAILED = "CASE provider WHEN 'web_extraction' THEN 'no parseable JSON' WHEN 'geoapify' THEN 'post-validation: a name is required' ELSE 'timeout' END"


@query(
    "x17_a11_failures",
    f"""WITH {_PER}, g AS (SELECT provider, provider_record_id, count(*) FILTER (WHERE a IS NOT NULL AND g IS NULL) AS invented, count(*) FILTER (WHERE a IS NOT NULL AND g IS NOT NULL AND NOT correct) AS wrong, count(*) FILTER (WHERE a IS NULL AND g IS NOT NULL) AS missed,
            count(*) FILTER (WHERE a IS NOT NULL AND NOT correct AND confidence BETWEEN 0.85 AND 1) AS bold FROM per GROUP BY 1, 2),
          r AS (SELECT provider, provider_record_id, bool_or(coalesce(email, phone, website) IS NOT NULL) AS ok, {_FAILED} AS error, coalesce(bool_and(rating BETWEEN 0 AND 5 OR rating IS NULL), true) AS compliant, count(*) FILTER (WHERE NOT contains(lower(website), lower(split_part(name, ' ', 1)))) AS unsupported,
            CASE WHEN bool_or(rating > 5) THEN 'ratings.rating.status: value not in enum' END AS errors FROM provider_record GROUP BY 1, 2),
          l AS (SELECT ok, CASE WHEN NOT ok THEN [CASE provider WHEN 'web_extraction' THEN 'FORMAT_ERROR' WHEN 'geoapify' THEN 'SCHEMA_ERROR' ELSE 'OTHER' END] ELSE list_filter([CASE WHEN invented > 0 THEN 'HALLUCINATION' END, CASE WHEN wrong > 0 THEN 'ENTITY_RESOLUTION_ERROR' END, CASE WHEN missed > 0 THEN 'EXTRACTION_ERROR' END,
            CASE WHEN unsupported > 0 THEN 'EVIDENCE_ERROR' END, CASE WHEN NOT compliant THEN 'SCHEMA_ERROR' END, CASE WHEN bold > 0 THEN 'CONFIDENCE_ERROR' END, CASE WHEN errors IS NOT NULL THEN 'UNKNOWN_HANDLING_ERROR' END], lambda x: x IS NOT NULL) END AS labels FROM g JOIN r USING (provider, provider_record_id))
        SELECT label, severity, count(*) AS n FROM (SELECT unnest(labels) AS label, CASE WHEN NOT ok THEN CASE WHEN labels[1] = 'FORMAT_ERROR' THEN 'CRITICAL' ELSE 'HIGH' END WHEN list_contains(labels, 'HALLUCINATION') OR list_contains(labels, 'EVIDENCE_ERROR') THEN 'CRITICAL'
          WHEN list_contains(labels, 'SCHEMA_ERROR') THEN 'HIGH' WHEN list_contains(labels, 'EXTRACTION_ERROR') THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM l) GROUP BY 1, 2""",
)
def _(spark, sf):
    key = F.concat_ws("|", "provider", "provider_record_id").alias("example")
    facts = E.failure_facts(_compared(spark, sf).withColumn("example", key), "example")
    error = F.when(F.col("provider") == "web_extraction", "no parseable JSON").when(F.col("provider") == "geoapify", "post-validation: a name is required").otherwise("timeout")
    elsewhere = ~F.contains(F.lower("website"), F.lower(F.split_part(F.col("name"), F.lit(" "), F.lit(1))))
    records = load(spark, sf, "provider_record").groupBy(key, error.alias("error")).agg(
        F.bool_or(F.coalesce("email", "phone", "website").isNotNull()).alias("ok"), F.bool_and(F.coalesce(F.col("rating").between(0, 5), F.lit(True))).alias("schema_compliant"),
        F.count_if(elsewhere).alias("unsupported"), F.when(F.bool_or(F.col("rating") > 5), "ratings.rating.status: value not in enum").alias("schema_errors"),
    )
    rows = facts.join(records, "example").withColumn("coverage", F.lit(None).cast("double"))
    return E.failure_labels(rows).select(F.explode("labels").alias("label"), "severity").groupBy("label", "severity").agg(F.count("*").alias("n"))


@query("a35_failure_coverage", f"WITH {_COVERED} SELECT * FROM cover")
def _(spark, sf):
    return E.failure_coverage(_covering(spark, sf))


@query(
    "a08_score_gap",
    """SELECT lower(trim(e.split)) AS split, count(*) AS n, round(avg(abs(e.rating - p.rating)), 6) AS mae FROM (SELECT DISTINCT example_id, split, right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) AS k, rating FROM dataset_example WHERE phone <> '' AND rating IS NOT NULL) e
       JOIN (SELECT right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) AS k, avg(rating) AS rating FROM provider_record WHERE phone <> '' AND rating IS NOT NULL GROUP BY 1) p USING (k) GROUP BY 1""",
)
def _(spark, sf):
    key = F.right(F.regexp_replace("phone", "[^0-9]", ""), F.lit(10))
    e = _examples(spark, sf).filter("phone <> '' AND rating IS NOT NULL").select("example_id", "split", key.alias("k"), "rating").distinct()
    p = load(spark, sf, "provider_record").filter("phone <> '' AND rating IS NOT NULL").groupBy(key.alias("k")).agg(F.avg("rating").alias("other"))
    return e.join(p, "k").groupBy(F.lower(F.trim("split")).alias("split")).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("rating") - F.col("other"))), 6).alias("mae"))


@query(
    "s12_chat_rows",
    """SELECT DISTINCT example_id, task, 3 AS n_messages, md5(task || CASE WHEN len(evidence) > 0 THEN chr(10) ELSE chr(10) END || array_to_string(list_transform(evidence, lambda x: coalesce(x.source, '') || ': ' || CASE WHEN length(x.text) > 240 THEN substr(x.text, 1, 240) || '…' ELSE coalesce(x.text, '') END), chr(10))) AS user_md5 FROM dataset_example""",
)
def _(spark, sf):
    c = E.chat_rows(_examples(spark, sf), "Answer from evidence only.")
    return c.select("example_id", "task", F.size("messages").alias("n_messages"), F.md5(F.col("messages")[1]["content"]).alias("user_md5")).distinct()


@query("s02_split_scan", "SELECT example_id, task FROM (SELECT DISTINCT example_id, task, split FROM dataset_example) WHERE lower(trim(split)) = 'holdout'")
def _(spark, sf):
    return load(spark, sf, "dataset_example").filter(F.lower(F.trim("split")) == "holdout").select("example_id", "task").distinct()


@query(
    "a28_sentiment",
    f"""WITH d AS (SELECT source, regexp_matches(text, '{E.POSITIVE}') AS pos, regexp_matches(text, '{E.NEGATIVE}') AS neg FROM (SELECT source, coalesce(text, '') AS text FROM documents))
       SELECT source, count(*) AS n, round(avg(CASE WHEN pos AND NOT neg THEN 1.0 ELSE 0.0 END), 6) AS positive, round(avg(CASE WHEN neg AND NOT pos THEN 1.0 ELSE 0.0 END), 6) AS negative, round(avg(CASE WHEN pos = neg THEN 1.0 ELSE 0.0 END), 6) AS neutral,
         CASE WHEN count(*) FILTER (WHERE pos AND NOT neg) > count(*) FILTER (WHERE neg AND NOT pos) THEN 'positive' WHEN count(*) FILTER (WHERE neg AND NOT pos) > count(*) FILTER (WHERE pos AND NOT neg) THEN 'negative' ELSE 'mixed' END AS label FROM d GROUP BY 1""",
)
def _(spark, sf):
    s = E.sentiment(load(spark, sf, "documents"), ["source"], F.col("text"))
    return s.select("source", "n", *[F.round(c, 6).alias(c) for c in ("positive", "negative", "neutral")], "label")


@query(
    "a29_themes",
    "WITH t(theme, pattern) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in E.THEMES.items()) + """), d AS (SELECT source, doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT source, count(*) AS whole FROM d GROUP BY 1)
       SELECT source, theme, count(*) AS reviews, round(least(1.0, count(*) / any_value(whole) + 0.5), 6) AS confidence, substr(arg_min(text, doc_id), 1, 200) AS example FROM d JOIN t ON regexp_matches(text, pattern) JOIN w USING (source) GROUP BY 1, 2""",
)
def _(spark, sf):
    return E.themes(load(spark, sf, "documents"), ["source"], F.col("text"), F.col("doc_id")).withColumn("confidence", F.round("confidence", 6))


@query(
    "a06_status_accuracy",
    f"""WITH {_PER} SELECT provider, count(*) AS fields, round(avg(CASE WHEN (a IS NULL AND g IS NULL) OR CASE WHEN a IS NULL THEN 'missing' WHEN confidence >= 0.9 THEN 'verified' ELSE 'extracted' END = CASE WHEN g IS NULL THEN 'missing' WHEN length(g) > 20 THEN 'verified' ELSE 'extracted' END THEN 1.0 ELSE 0.0 END), 6) AS status_accuracy FROM per GROUP BY 1""",
)
def _(spark, sf):
    stated, gold = F.when(F.col("confidence") >= 0.9, "verified"), F.when(F.length("expected") > 20, "verified")
    rows = _compared(spark, sf).withColumns({"predicted_status": stated, "expected_status": gold})
    return E.status_accuracy(rows, ["provider"]).withColumn("status_accuracy", F.round("status_accuracy", 6))


@query(
    "j02_compared_fields",
    f"""WITH p AS (SELECT entity_id, field, max(value) AS value FROM provider_record JOIN {_IDS} i USING (provider, provider_record_id) CROSS JOIN LATERAL (VALUES ('name', name), ('phone', phone), ('website', website)) v(field, value) GROUP BY 1, 2),
        e AS (SELECT entity_id, field, value FROM business_entity CROSS JOIN LATERAL (VALUES ('name', canonical_name), ('phone', canonical_phone), ('website', canonical_website)) v(field, value)),
        b AS (SELECT entity_id, field, nullif(p.value, '') AS predicted, nullif(e.value, '') AS expected FROM p FULL JOIN e USING (entity_id, field))
        SELECT field, count(*) AS n, count(*) FILTER (WHERE predicted IS NOT NULL AND expected IS NOT NULL AND (lower(trim(predicted)) = lower(trim(expected)) OR (field = 'phone' AND regexp_replace(predicted, '[^0-9]', '', 'g') = regexp_replace(expected, '[^0-9]', '', 'g') AND regexp_replace(predicted, '[^0-9]', '', 'g') <> ''))) AS correct,
          count(*) FILTER (WHERE predicted IS NULL) AS unpredicted, count(*) FILTER (WHERE expected IS NULL) AS unexpected FROM b GROUP BY 1""",
)
def _(spark, sf):
    ids = load(spark, sf, "provider_identity").filter("entity_id IS NOT NULL").select("provider", "provider_record_id", "entity_id").distinct()
    cells = lambda **c: F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(x).alias("value")) for f, x in c.items()])).alias("c")
    said = load(spark, sf, "provider_record").join(ids, ["provider", "provider_record_id"]).select("entity_id", cells(name="name", phone="phone", website="website")).select("entity_id", "c.*").groupBy("entity_id", "field").agg(F.max("value").alias("value"))
    gold = load(spark, sf, "business_entity").select("entity_id", cells(name="canonical_name", phone="canonical_phone", website="canonical_website")).select("entity_id", "c.*")
    both = E.compare_fields(said, gold, ["entity_id"])
    return both.groupBy("field").agg(F.count("*").alias("n"), F.count_if("correct").alias("correct"), F.count_if(F.col("predicted").isNull()).alias("unpredicted"), F.count_if(F.col("expected").isNull()).alias("unexpected"))


@query(
    "j03_model_deltas",
    """WITH r AS (SELECT task, lower(trim(split)) AS split, dataset_version, dataset, round(avg(quality_score), 6) AS quality, count(DISTINCT example_id) AS n FROM dataset_example WHERE quality_score IS NOT NULL GROUP BY 1, 2, 3, 4),
         v AS (SELECT min(dataset) AS a, max(dataset) AS b FROM r), a AS (SELECT r.* FROM r, v WHERE dataset = v.a), b AS (SELECT r.* FROM r, v WHERE dataset = v.b)
       SELECT a.task, a.split, a.quality AS quality_a, b.quality AS quality_b, floor((b.quality - a.quality) * 10000.0 + 0.5) / 10000.0 AS quality_delta, b.task IS NULL AS skipped FROM a LEFT JOIN (SELECT task, split, arg_max(quality, (n, dataset_version)) AS quality FROM b GROUP BY 1, 2) b ON a.task = b.task AND a.split = b.split""",
)
def _(spark, sf):
    """Mean quality of the first and the last dataset, as if each were a model's run."""
    rows = load(spark, sf, "dataset_example").filter("quality_score IS NOT NULL")
    runs = rows.groupBy("task", F.lower(F.trim("split")).alias("split"), "dataset_version", "dataset").agg(F.round(F.avg("quality_score"), 6).alias("quality"), F.countDistinct("example_id").alias("n"))
    ends = rows.agg(F.min("dataset").alias("a"), F.max("dataset").alias("b")).first()
    a, b = runs.filter(F.col("dataset") == F.lit(ends["a"])), runs.filter(F.col("dataset") == F.lit(ends["b"])).withColumn("at", F.struct("n", "dataset_version"))
    return E.compare_models(a, b, ["task", "split"], ["quality"], "at")


@query(
    "j06_gold_corrections",
    f"WITH {_PER}, f AS (SELECT DISTINCT entity_id, field, a FROM per WHERE a IS NOT NULL AND NOT correct) SELECT f.entity_id, f.field, f.a AS failed, g.value AS gold FROM f JOIN (SELECT entity_id, field, value FROM business_entity CROSS JOIN LATERAL (VALUES ('name', canonical_name), ('phone', canonical_phone), ('website', canonical_website), ('category', category)) v(field, value)) g ON g.entity_id = f.entity_id AND g.field = f.field AND g.value IS NOT NULL",
)
def _(spark, sf):
    failures = _compared(spark, sf).filter("predicted IS NOT NULL AND NOT correct").select("entity_id", "field", F.col("predicted").alias("failed")).distinct()
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("value")) for f, c in (("name", "canonical_name"), ("phone", "canonical_phone"), ("website", "canonical_website"), ("category", "category"))])
    gold = load(spark, sf, "business_entity").select("entity_id", F.explode(cells).alias("c")).select("entity_id", "c.*")
    return E.gold_corrections(failures, gold, ["entity_id"]).select("entity_id", "field", "failed", "gold")


@query(
    "a07_a36_checkpoint",
    """WITH x AS (SELECT DISTINCT example_id, task, name IS NOT NULL AS parseable, list_filter(['name', 'phone', 'website', 'address'], lambda k: CASE k WHEN 'name' THEN name IS NOT NULL WHEN 'phone' THEN phone IS NOT NULL WHEN 'website' THEN website IS NOT NULL ELSE address IS NOT NULL END) AS found,
           CASE WHEN rating IS NULL THEN 1.0 ELSE 0.5 END AS abstained, CASE WHEN review_count > 100 THEN 1 ELSE 0 END AS invented FROM dataset_example)
       SELECT task, count(*) AS rows, round(avg(CASE WHEN parseable THEN 1.0 ELSE 0.0 END), 6) AS json_validity, round(avg(len(found) / 4.0), 6) AS coverage, round(avg(abstained), 6) AS abstention, round(avg(invented), 6) AS hallucinated,
         round(0.4 * avg(CASE WHEN parseable THEN 1.0 ELSE 0.0 END) + 0.3 * avg(len(found) / 4.0) + 0.2 * avg(abstained) - 0.1 * avg(invented), 6) AS composite FROM x GROUP BY 1""",
)
def _(spark, sf):
    keys = ["name", "phone", "website", "address"]
    found = F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), k) for k in keys]))
    x = _examples(spark, sf).select(
        "example_id", "task", F.col("name").isNotNull().alias("parseable"), E.coverage(F.array(*map(F.lit, keys)), found).alias("coverage"),
        F.when(F.col("rating").isNull(), 1.0).otherwise(0.5).alias("abstained"), F.when(F.col("review_count") > 100, 1).otherwise(0).alias("invented"),
    ).distinct()
    out = E.checkpoint_composite(x, ["task"])
    return out.select("task", "rows", *[F.round(c, 6).alias(c) for c in out.columns[2:]])
