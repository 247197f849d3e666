"""Extraction metrics, calibration, grounding, leakage and dataset quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from amalgam.functions.compat import js_round
from amalgam.functions.text import clip, digits, match_form


# Words of praise and complaint, and of the themes of reviews.
POSITIVE = r"(?i)\b(great|excellent|amazing|wonderful|fantastic|good|best|love|loved|recommend|highly|friendly|courteous|top|perfect|impressed|satisfied|happy|beautiful)\b"
NEGATIVE = r"(?i)\b(bad|poor|terrible|worst|awful|horrible|disappoint|disappointed|rude|slow|expensive|dirty|broken|unhappy|lack|lacking|refund|cancel|issue|problem)\b"
THEMES = {
    "Product quality": r"(?i)\b(quality|durable|solid|well-made|finish|material|product)\b",
    "Customer service": r"(?i)\b(service|staff|friendly|courteous|helpful|polite|rude|support)\b",
    "Pricing": r"(?i)\b(price|pricing|expensive|cheap|affordable|value|cost)\b",
    "Delivery/Timeline": r"(?i)\b(deliver|delivery|timeline|time|wait|slow|fast|prompt|on-time)\b",
    "Selection/Variety": r"(?i)\b(selection|variety|range|collection|options|stock|designs)\b",
}
# The terms of the dataset quality and their weights.
QUALITY_WEIGHTS = {"contract": 0.3, "grounding": 0.2, "evidence": 0.1, "unknown": 0.1, "balance": 0.1, "coverage": 0.1, "splits": 0.1}


def sentiment(reviews: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """Shares of reviews that only praise, only complain, or neither, and the
    label of the majority; a tie is mixed. A null text is neutral."""
    d = reviews.select(*keys, F.coalesce(text, F.lit("")).alias("_t")).select(*keys, F.col("_t").rlike(POSITIVE).alias("_p"), F.col("_t").rlike(NEGATIVE).alias("_q"))
    p, q = F.count_if(F.col("_p") & ~F.col("_q")), F.count_if(F.col("_q") & ~F.col("_p"))
    n = F.count("*")
    return d.groupBy(*keys).agg(
        n.alias("n"), (p / n).alias("positive"), (q / n).alias("negative"), (F.count_if(F.col("_p") == F.col("_q")) / n).alias("neutral"),
        F.when(p > q, "positive").when(q > p, "negative").otherwise("mixed").alias("label"),
    )


def themes(reviews: DataFrame, keys: list[str], text: Column, position: Column) -> DataFrame:
    """Per theme the reviews that touch it, min(1, share + 0.5) as confidence
    and the first of them (200 characters) as example. One scan; a review gives a
    row a theme it touches, and the first is a minimum that combines."""
    d = reviews.select(*keys, F.coalesce(text, F.lit("")).alias("_t"), position.alias("_at"))
    whole = d.groupBy(*keys).agg(F.count("*").alias("_n"))
    touched = F.array_compact(F.array(*[F.when(F.col("_t").rlike(p), F.lit(k)) for k, p in THEMES.items()]))
    per = d.select(*keys, "_at", F.substring("_t", 1, 200).alias("_t"), F.explode(touched).alias("theme")).groupBy(*keys, "theme").agg(F.count("*").alias("reviews"), F.min_by("_t", "_at").alias("example"))
    return per.join(whole, keys).select(*keys, "theme", "reviews", F.least(F.lit(1.0), F.col("reviews") / F.col("_n") + F.lit(0.5)).alias("confidence"), "example")


def eval_equivalent(field: Column, a: Column, b: Column) -> Column:
    """Equal without case and outer blanks; phones and coordinates by digits."""
    plain = F.lower(F.trim(a)) == F.lower(F.trim(b))
    return F.coalesce(plain | (field.rlike("phone|coordinates") & (digits(a) == digits(b)) & (digits(a) != "")), F.lit(False))


def compare_fields(predicted: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of (keys, field, value); '' and null are no value."""
    p = predicted.select(*keys, "field", F.when(F.col("value") != "", F.col("value")).alias("predicted"), *[c for c in ("confidence",) if c in predicted.columns])
    e = expected.select(*keys, "field", F.when(F.col("value") != "", F.col("value")).alias("expected"))
    both = p.join(e, [*keys, "field"], "full")
    return both.withColumn("correct", F.col("predicted").isNotNull() & F.col("expected").isNotNull() & eval_equivalent(F.col("field"), F.col("predicted"), F.col("expected")))


def confusion() -> list[Column]:
    """A3: a wrong value is a false positive and no false negative."""
    p, e, ok = F.col("predicted").isNotNull(), F.col("expected").isNotNull(), F.col("correct")
    return [
        F.count_if(p & e & ok).alias("tp"), F.count_if(p & ~ok).alias("fp"), F.count_if(~p & e).alias("fn"), F.count_if(~p & ~e).alias("tn")
    ]


def rates(df: DataFrame) -> DataFrame:
    """A4 from tp, fp, fn, tn: empty denominators count as perfect, rates to 4 places."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    safe = lambda a, b, empty: F.when(b > 0, a / b).otherwise(F.lit(empty))
    precision, recall = safe(tp, tp + fp, 1.0), safe(tp, tp + fn, 1.0)
    f1 = safe(2 * precision * recall, precision + recall, 0.0)
    return df.withColumns(
        {
            "precision": js_round(precision, 4), "recall": js_round(recall, 4), "f1": js_round(f1, 4),
            "abstention": js_round(safe(tn, fp + tn, 1.0), 4), "hallucination": js_round(safe(fp, tp + fp, 0.0), 4), "miss": js_round(safe(fn, tp + fn, 0.0), 4),
        }
    )


def confidence_band(c: Column) -> Column:
    """M7."""
    return F.when(c >= 0.85, "HIGH").when(c >= 0.65, "MEDIUM").when(c >= 0.4, "LOW").otherwise("UNSUPPORTED")


def overall_confidence(c: Column) -> Column:
    """A10: mean over values that are supported at all; 0 if none."""
    return F.coalesce(F.avg(F.when(confidence_band(c) != "UNSUPPORTED", c)), F.lit(0.0))


def calibration_bin(c: Column) -> Column:
    """Ten equal bins by literal edges, the last closed; null outside [0, 1]."""
    out = F.when((c >= 0.9) & (c <= 1.0), F.lit(9))
    for k in range(8, -1, -1):
        out = F.when((c >= k / 10) & (c < (k + 1) / 10), F.lit(k)).otherwise(out)
    return out


def calibration(pairs: DataFrame) -> DataFrame:
    """One row with Brier score, accuracy, mean confidence, expected
    calibration error and the rate of confident errors, over (confidence, correct)."""
    p = pairs.filter("confidence IS NOT NULL AND correct IS NOT NULL").select("confidence", F.col("correct").cast("double").alias("y"))
    bins = p.withColumn("bin", calibration_bin(F.col("confidence"))).groupBy("bin").agg(
        F.count("*").alias("n"), F.sum("y").alias("hits"), F.sum("confidence").alias("conf"), F.sum(F.pow(F.col("confidence") - F.col("y"), 2)).alias("sq"),
        F.count_if((F.col("confidence") >= 0.85) & (F.col("y") == 0)).alias("bold"),
    )
    n = F.sum("n")
    gap = F.sum(F.when(F.col("bin").isNotNull(), F.abs(F.col("conf") - F.col("hits"))))
    return bins.agg(
        n.alias("n"), js_round(F.sum("sq") / n, 4).alias("brier"), js_round(F.sum("hits") / n, 4).alias("accuracy"), js_round(F.sum("conf") / n, 4).alias("mean_confidence"),
        js_round(gap / n, 4).alias("ece"), js_round(F.sum("bold") / n, 4).alias("false_confidence"),
    )


def grounding(snippet: Column, evidence: Column) -> Column:
    """Grounded if the snippet stands in the evidence; too short ones can't be told."""
    s = match_form(snippet)
    return F.when(snippet.isNull() | (F.length(s) < 8), "unverifiable").when(F.contains(match_form(evidence), s), "grounded").otherwise("unsupported")


# Fields whose wrong value is an error of the entity.
ENTITY_FIELDS = "(?i)name|category|business_type|phone|website|email|city|state|coordinates|full_address|postal_code"


def failure_facts(rows: DataFrame, key: str) -> DataFrame:
    """What classifies an example, counted over its compared fields (predicted,
    expected, correct, confidence)."""
    p, e = F.col("predicted").isNotNull(), F.col("expected").isNotNull()
    wrong = p & e & ~F.col("correct")
    entity = F.col("field").rlike(ENTITY_FIELDS)
    return rows.groupBy(key).agg(
        F.count_if(p & ~e).alias("invented"), F.count_if(wrong & entity).alias("entity_wrong"), F.count_if(wrong & ~entity).alias("other_wrong"), F.count_if(~p & e).alias("missed"),
        F.count_if(p & ~F.col("correct") & (F.col("confidence") >= 0.85) & (F.col("confidence") <= 1)).alias("bold"),
    )


def failure_labels(examples: DataFrame) -> DataFrame:
    """Adds labels and severity to examples with ok, error, the counts of
    ``failure_facts``, coverage (of generative output, else null), unsupported,
    schema_compliant and schema_errors (paths and messages as text).

    A failed example has one label from its message; a good one all that apply."""
    error = F.coalesce("error", F.lit(""))
    failed = (
        F.when(error.rlike("(?i)no parseable JSON|unusable output|malformed"), "FORMAT_ERROR")
        .when(error.rlike("(?i)post-validation|contract|schema|required|non-empty array"), "SCHEMA_ERROR")
        .otherwise("OTHER")
    )
    some = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    bad_shape = F.coalesce(F.col("coverage") < 0.9, F.lit(False)) | ~F.coalesce("schema_compliant", F.lit(False))
    labels = F.array_compact(
        F.array(
            F.when(some("invented"), "HALLUCINATION"), F.when(some("entity_wrong"), "ENTITY_RESOLUTION_ERROR"), F.when(some("other_wrong") | some("missed"), "EXTRACTION_ERROR"),
            F.when(some("unsupported"), "EVIDENCE_ERROR"), F.when(bad_shape, "SCHEMA_ERROR"), F.when(some("bold"), "CONFIDENCE_ERROR"),
            F.when(F.coalesce("schema_errors", F.lit("")).rlike("(?i)(provenance|status)[^:]*:\\s*value not in enum"), "UNKNOWN_HANDLING_ERROR"),
        )
    )
    has = lambda x: F.array_contains("labels", x)
    severity = (
        F.when(~F.col("ok"), F.when(has("FORMAT_ERROR"), "CRITICAL").otherwise("HIGH"))
        .when(has("HALLUCINATION") | has("EVIDENCE_ERROR"), "CRITICAL").when(has("SCHEMA_ERROR"), "HIGH").when(has("EXTRACTION_ERROR"), "MEDIUM").otherwise("LOW")
    )
    return examples.withColumn("labels", F.when(F.col("ok"), labels).otherwise(F.array(failed))).withColumn("severity", severity)


def failure_coverage(examples: DataFrame) -> DataFrame:
    """Per category of known failures, how many training examples cover it
    and the first of them. ``examples`` has example_id, task, split and booleans
    has_categories, hours_as_text, abstains, no_website; one row an example."""
    predicates = {
        "schema-nested-generative": F.col("task").isin("brand.dna", "strategy.website", "strategy.landing_page"),
        "category-list": F.col("has_categories"),
        "hours-as-string": F.col("hours_as_text"),
        "unknown-abstention": F.col("abstains"),
        "website-exists-false": (F.col("task") == "website.analysis") & F.col("no_website"),
        "provenance-enum-discipline": F.col("task") == "extraction.business_profile",
    }
    train = examples.filter(F.col("split") == "train")
    counts = train.agg(*[F.struct(F.lit(k).alias("category"), F.count_if(p).alias("examples"), F.min(F.when(p, F.col("example_id"))).alias("first_example")).alias(f"c{i}") for i, (k, p) in enumerate(predicates.items())])
    return counts.select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(predicates))])).alias("c")).select("c.*")


def checkpoint_composite(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of parseable answers, key coverage and right abstentions, mean
    of invented labels, and their weighted sum; (parseable, coverage, abstained, invented) a row."""
    valid, cover, abstain, made = F.avg(F.when(F.col("parseable"), 1.0).otherwise(0.0)), F.avg("coverage"), F.avg("abstained"), F.avg("invented")
    return scores.groupBy(*keys).agg(
        F.count("*").alias("rows"), valid.alias("json_validity"), cover.alias("coverage"), abstain.alias("abstention"), made.alias("hallucinated"),
        (F.lit(0.4) * valid + F.lit(0.3) * cover + F.lit(0.2) * abstain - F.lit(0.1) * made).alias("composite"),
    )


def status_accuracy(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Share of fields in both sides whose status is equal, or that neither
    side has a value for. ``rows`` has predicted, expected, predicted_status and
    expected_status; a value without status counts as extracted, none as missing."""
    p, e = F.col("predicted").isNotNull(), F.col("expected").isNotNull()
    of = lambda has, c: F.when(has, F.coalesce(c, F.lit("extracted"))).otherwise("missing")
    right = (of(p, F.col("predicted_status")) == of(e, F.col("expected_status"))) | (~p & ~e)
    return rows.groupBy(*keys).agg(F.count("*").alias("fields"), F.avg(F.when(right, 1.0).otherwise(0.0)).alias("status_accuracy"))


def compare_models(a: DataFrame, b: DataFrame, key: list[str], metrics: list[str], order: str) -> DataFrame:
    """Runs of two models on one benchmark side by side, delta = b - a to four
    places. The last run of b counts (by ``order``); runs of a without one stay,
    with null deltas, so that they can be counted as skipped."""
    last = b.groupBy(*key).agg(F.max_by(F.struct(*metrics), order).alias("b"))
    both = a.join(last, key, "left")
    return both.select(*key, *[F.col(m).alias(f"{m}_a") for m in metrics], *[F.col(f"b.{m}").alias(f"{m}_b") for m in metrics], *[js_round(F.col(f"b.{m}") - F.col(m), 4).alias(f"{m}_delta") for m in metrics], F.col("b").isNull().alias("skipped"))


def gold_corrections(failures: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Failed fields with the gold value that corrects them; fields gold does not hold are left out."""
    return failures.join(gold.select(*keys, "field", F.col("value").alias("gold")).filter("gold IS NOT NULL"), [*keys, "field"])


def leaked_keys(rows: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that stand in more than one split."""
    return rows.groupBy(key).agg(F.countDistinct(split).alias("n_splits"), F.count("*").alias("n_rows")).filter("n_splits > 1")


def coverage(expected: Column, found: Column) -> Column:
    """Share of expected keys that are there; 1 where none is expected."""
    return F.when(F.size(expected) > 0, F.size(F.array_intersect(expected, found)) / F.size(expected)).otherwise(1.0)


def chat_rows(examples: DataFrame, system: str) -> DataFrame:
    """Examples as chats of three messages; evidence texts are cut to 240."""
    texts = F.array_join(F.transform("evidence", lambda e: F.concat(F.coalesce(e["source"], F.lit("")), F.lit(": "), clip(F.coalesce(e["text"], F.lit("")), 240))), "\n")
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return examples.select(
        "example_id", "task", F.array(message("system", F.lit(system)), message("user", F.concat_ws("\n", F.col("task"), texts)), message("assistant", F.to_json(F.struct("name", "address", "phone", "website", "category")))).alias("messages")
    )
