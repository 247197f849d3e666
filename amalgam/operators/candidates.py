"""The candidate pipeline: what providers state about fields, judged and selected.

Candidates are long rows (keys, field, kind, value, confidence, provenance,
snippet, evidence_id, seq): ``field`` a dotted path, ``value`` its text, ``kind``
the type it came with (string, number, boolean, array or object). The profile
they meet is long too: (keys, field, value, confidence).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from amalgam.functions.compat import js_round, trim_blank
from amalgam.functions.geo import valid_position
from amalgam.functions.text import fuzzy_similarity, normalize_phone, values_equivalent
from amalgam.operators import fuse, validate
from amalgam.operators.evaluate import grounding

# The type a field path must have.
EXPECTED_TYPES = {
    "identity.name": "string", "identity.category": "string", "identity.description": "string", "identity.business_type": "string", "identity.categories": "array", "identity.services": "array",
    "contact.phone": "string", "contact.email": "string", "contact.website": "string",
    "location.full_address": "string", "location.street": "string", "location.city": "string", "location.state": "string", "location.country": "string", "location.postal_code": "string", "location.coordinates": "nested",
    "ratings.rating": "number", "ratings.review_count": "number", "ratings.reviews": "array", "ratings.review_summary": "string", "ratings.sentiment": "string", "ratings.themes": "array",
    "hours": "object", "social_links": "array",
}
# Paths whose accepted value may not simply change.
IDENTITY_PATHS = ["identity.name", "contact.phone", "contact.website", "location.full_address", "location.coordinates"]
#: Confidence an identity value needs to replace a weak one, whatever the caller asks.
IDENTITY_BAR = 0.8


def type_error(field: Column, kind: Column, value: Column) -> Column:
    """true where a value has not the type of its path. Unknown paths pass;
    a missing value of a known path fails."""
    wanted = F.element_at(F.create_map(*[F.lit(x) for kv in EXPECTED_TYPES.items() for x in kv]), field)
    fits = F.when(wanted == "nested", kind.isin("object", "array")).otherwise(kind == wanted)
    return F.coalesce(wanted.isNotNull() & (value.isNull() | ~F.coalesce(fits, F.lit(False))), F.lit(False))


def semantic_error(field: Column, kind: Column, value: Column, country: Column | None = None) -> Column:
    """Semantic verdict of a value: null if it passes, 'warn' for a phone that
    can't be normalized, 'failed' otherwise. Missing values pass."""
    number = value.try_cast("double")
    position = F.split(value, ",")
    at = lambda k: F.try_element_at(position, F.lit(k)).try_cast("double")
    phone = validate.phone_status(value, country)["status"]
    site = validate.website_status(value)
    bad = (
        F.when(field == "ratings.rating", ~F.coalesce(number.between(0, 5), F.lit(False)))
        .when(field == "ratings.review_count", ~F.coalesce((number >= 0) & (number == F.floor(number)), F.lit(False)))
        .when(field == "contact.phone", phone == "rejected")
        .when(field == "contact.email", ~validate.valid_email(value))
        .when(field == "contact.website", site.isin("rejected", "rejected_directory"))
        .when(field == "identity.name", validate.street_like(value))
        .when(field == "location.coordinates", ~F.coalesce(valid_position(at(1), at(2)), F.lit(False)))
        .when(field.isin("identity.categories", "identity.services"), kind != "array")
        .when(field == "hours", ~kind.isin("object", "array"))
        .otherwise(F.lit(False))
    )
    return F.when(value.isNull() | (value == ""), None).when(bad, "failed").when((field == "contact.phone") & (phone == "unresolved"), "warn")


def verdicts(candidates: DataFrame, keys: list[str], profile: DataFrame, country: Column | None = None) -> DataFrame:
    """adds ``errors``, the names of the checks a candidate fails: type,
    semantic, semantic:warn, evidence, cross-field. A candidate is valid iff it
    has none; warnings count as errors.

    The cross-field check (F10) compares rating and review count with the other
    of the two in the profile."""
    numbers = profile.groupBy(*keys).agg(
        F.max(F.when(F.col("field") == "ratings.rating", F.col("value"))).try_cast("double").alias("_rating"),
        F.max(F.when(F.col("field") == "ratings.review_count", F.col("value"))).try_cast("double").alias("_count"),
    )
    f, k, v = F.col("field"), F.col("kind"), F.col("value")
    semantic = semantic_error(f, k, v, country)
    number = v.try_cast("double")
    swapped = F.when((f == "ratings.rating") & (k == "number"), number == F.col("_count")).when((f == "ratings.review_count") & (k == "number"), number == F.col("_rating"))
    bare = validate.evidence_gate(F.col("provenance"), f, F.nullif(F.col("snippet"), F.lit("")), F.nullif(F.col("evidence_id"), F.lit("")))
    errors = F.array_compact(
        F.array(
            F.when(type_error(f, k, v), "type"),
            F.when(semantic == "failed", "semantic"),
            F.when(semantic == "warn", "semantic:warn"),
            F.when(bare, "evidence"),
            F.when(F.coalesce(swapped, F.lit(False)), "cross-field"),
        )
    )
    return candidates.join(numbers, keys, "left").withColumn("errors", errors).drop("_rating", "_count")


def run_pipeline(
    candidates: DataFrame,
    keys: list[str],
    profile: DataFrame,
    only_if_missing: bool = False,
    conservative: bool = False,
    overwrite_below: float | None = None,
    min_incoming: float = 0.7,
    country: Column | None = None,
) -> DataFrame:
    """Adds errors, status (accepted, rejected, conflict or valid) and reason.

    Per key and field, in this order: a populated field is left alone under
    ``only_if_missing``, unless its confidence lies below ``overwrite_below`` and a
    candidate clears the bar; under ``conservative`` identity fields are left
    alone; invalid candidates are rejected; the valid one of highest provenance,
    then confidence, then earliest ``seq`` (then smallest value) is the top; on an
    identity field whose value differs from the top's, the top is a conflict,
    unless the value is weak and the top strong (F13), and the other candidates
    stay valid; else the top is accepted and the others rejected.

    What is decided per field is an aggregate that combines before the shuffle;
    no field's candidates are ever held together. Repeated rows get one verdict;
    a null field matches nothing and is rejected as unknown."""
    judged = verdicts(candidates, keys, profile, country)
    identity = F.col("field").isin(*IDENTITY_PATHS)
    bar = F.when(identity, F.lit(max(min_incoming, IDENTITY_BAR))).otherwise(F.lit(min_incoming))
    own = F.coalesce("confidence", F.lit(0.0))
    valid = F.size("errors") == 0
    order = F.struct(
        fuse.rank_of(F.col("provenance"), fuse.SELECTION_RANK).alias("p"), own.alias("c"), (-F.col("seq")).alias("s"), F.xxhash64("value").alias("h"), F.col("value").alias("v")
    )
    known = profile.groupBy(*keys, "field").agg(F.max(F.struct("value", "confidence")).alias("_known"))
    fields = judged.groupBy(*keys, "field").agg(F.max(F.when(valid, order)).alias("_top"), F.max(F.when(own >= bar, 1).otherwise(0)).alias("_cleared")).join(known, [*keys, "field"], "left")
    old, at = F.col("_known.value"), F.col("_known.confidence")
    populated = validate.populated(old)
    weak = F.lit(False) if overwrite_below is None else F.coalesce(at < overwrite_below, F.lit(False))
    left_alone = (
        F.when(F.lit(only_if_missing) & populated & ~weak, "field_populated")
        .when(F.lit(only_if_missing) & populated & (F.col("_cleared") == 0), "below_confidence_bar")
        .when(F.lit(conservative) & identity, "conservative_identity")
    )
    allowed = F.lit(False) if overwrite_below is None else validate.may_replace_weak(at, F.col("_top.c"), identity, overwrite_below, min_incoming)
    same = values_equivalent(F.col("field"), old, F.col("_top.v"))
    conflict = identity & populated & ~same & ~allowed
    fields = fields.select(*keys, "field", "_top", left_alone.alias("_left"), F.coalesce(conflict, F.lit(False)).alias("_conflict"))
    top = order == F.col("_top")
    status = (
        F.when(F.col("_left").isNotNull() | ~valid, "rejected")
        .when(top, F.when(F.col("_conflict"), "conflict").otherwise("accepted"))
        .when(F.col("_conflict"), "valid")
        .otherwise("rejected")
    )
    reason = F.when(F.col("_left").isNotNull(), F.col("_left")).when(~valid, F.array_join("errors", "; ")).when(F.col("status") == "rejected", "lower_priority")
    # Fields without candidates of a key never match; a null field has no row of its own.
    out = judged.join(fields, [*keys, "field"], "left").withColumn("status", F.when(F.col("field").isNull(), "rejected").otherwise(status))
    return out.withColumn("reason", F.when(F.col("field").isNull(), "unknown_field").otherwise(reason)).drop("_top", "_left", "_conflict")


def diagnostics(decided: DataFrame) -> DataFrame:
    """A1, A2: candidates of each field by what became of them."""
    count = lambda s: F.count_if(F.col("status") == s)
    return decided.groupBy("field").agg(F.count("*").alias("total"), count("accepted").alias("accepted"), count("rejected").alias("rejected"), count("conflict").alias("conflicted"))


def provenance_wrap(value: Column, confidence: Column, provenance: Column, source: Column) -> Column:
    """A value in its envelope, confidence clamped (0 where there is none);
    nothing becomes an inferred null of confidence 0."""
    empty = value.isNull() | (value == "")
    return F.struct(
        F.when(~empty, value).alias("value"),
        F.when(empty, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence))).alias("confidence"),
        F.when(empty, "inferred").otherwise(provenance).alias("provenance"),
        F.when(~empty, source).alias("source"),
    )


def unwrap(envelope: Column) -> Column:
    """The value of an envelope."""
    return envelope["value"]


def flatten_envelopes(record: DataFrame, keys: list[str], envelopes: dict[str, list[str]]) -> DataFrame:
    """Nested groups of envelopes as one row a dotted path; envelopes without value are left out."""
    cells = [
        F.struct(F.lit(f"{group}.{leaf}").alias("path"), F.col(f"{group}.{leaf}.value").cast("string").alias("value"), F.col(f"{group}.{leaf}.confidence").alias("confidence"), F.col(f"{group}.{leaf}.provenance").alias("provenance"))
        for group, leaves in envelopes.items()
        for leaf in leaves
    ]
    return record.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*").filter("value IS NOT NULL")


def renest(flat: DataFrame, keys: list[str], envelopes: dict[str, list[str]]) -> DataFrame:
    """P4 turned round: dotted paths back to groups of envelopes, one row a key."""
    paths = [f"{group}.{leaf}" for group, leaves in envelopes.items() for leaf in leaves]
    cell = F.struct("value", "confidence", "provenance")
    picked = flat.groupBy(*keys).agg(*[F.max(F.when(F.col("path") == p, cell)).alias(p.replace(".", "__")) for p in paths])
    groups = [F.struct(*[F.col(f"{g}__{leaf}").alias(leaf) for leaf in leaves]).alias(g) for g, leaves in envelopes.items()]
    return picked.select(*keys, *groups)


def unwrap_machine_envelope(text: Column) -> Column:
    """Value, confidence (0 to 1, 0 where it states none) and evidence (400
    characters) of a field a model stated as JSON; null, '' and [] are no value."""
    e = F.from_json(text, "value string, confidence double, evidence string")
    value = e["value"]
    return F.when(
        value.isNotNull() & ~value.isin("", "[]", "null"),
        F.struct(value.alias("value"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), e["confidence"])).alias("confidence"), F.substring(e["evidence"], 1, 400).alias("evidence")),
    )


def allowed_paths(flat: DataFrame, paths: list[str]) -> DataFrame:
    """The rows of allowed field paths."""
    return flat.filter(F.col("field").isin(*paths))


# Names that tell no business, and the weights of what identifies a record.
GENERIC_NAMES = "(?i)^(unknown|business|store|restaurant|shop|coffee shop|cafe|unnamed business|n/a)$"
IDENTITY_WEIGHTS = {"name": 0.35, "generic_name": 0.10, "phone": 0.30, "website": 0.25, "address": 0.25, "city": 0.10, "coordinates": 0.20, "place_id": 0.30}


def identity_strength(name: Column, phone: Column, website: Column, address: Column, city: Column, latitude: Column, longitude: Column, place_id: Column) -> Column:
    """M8: struct of strength, score and hard. The tier follows from what stands
    together, not from the score: a name with address and phone is very strong, a
    name with phone or site strong, and so on down to insufficient."""
    has = lambda c: F.coalesce(trim_blank(c) != "", F.lit(False))
    named, sited, housed, towned, placed_id = has(name), has(website), has(address), has(city), has(place_id)
    called = F.coalesce(F.length(trim_blank(phone)) >= 7, F.lit(False))
    generic = named & trim_blank(name).rlike(GENERIC_NAMES)
    placed = latitude.isNotNull() & longitude.isNotNull()
    part = lambda c, k: F.when(c, F.lit(IDENTITY_WEIGHTS[k])).otherwise(0.0)
    score = (
        F.when(generic, F.lit(IDENTITY_WEIGHTS["generic_name"])).otherwise(part(named, "name")) + part(called, "phone") + part(sited, "website")
        + F.when(housed, F.lit(IDENTITY_WEIGHTS["address"])).otherwise(part(towned, "city")) + part(placed, "coordinates") + part(placed_id, "place_id")
    )
    strength = (
        F.when((named & housed & called) | (placed_id & named & (called | housed | sited)), "very_strong")
        .when(named & (called | sited), "strong")
        .when((named & (housed | towned)) | called, "moderate")
        .when((named & ~generic) | sited | placed, "weak")
        .otherwise("insufficient")
    )
    return F.struct(strength.alias("strength"), F.least(F.lit(1.0), js_round(score, 2)).alias("score"), (called | sited | placed | placed_id).alias("hard"))


def sufficient_identity(name: Column, hint_name: Column, latitude: Column, hint_latitude: Column, place_id: Column, phone: Column, website: Column, address: Column, machine_made: Column) -> Column:
    """a record may found an entity if anything identifies it: a real name, a
    position, an id, phone, site or address. What a model made needs an anchor
    that was given: an id, a hinted real name or a hinted position."""
    has = lambda c: F.coalesce(c.cast("string") != "", F.lit(False))
    real = lambda c: has(c) & ~trim_blank(c).rlike(r"(?i)^(unknown\s*business|unknown|n/a|unnamed business|na)$")
    anchored = has(place_id) | real(hint_name) | hint_latitude.isNotNull()
    place = F.coalesce(latitude != 0, F.lit(False))
    known = real(F.coalesce(hint_name, name)) | place | has(place_id) | has(phone) | has(website) | (has(address) & ~trim_blank(address).rlike("(?i)^(unknown|n/a)$"))
    return F.when(F.coalesce(machine_made, F.lit(False)), anchored).otherwise(known)


def site_corroborates(known_name: Column, known_phone: Column, page_name: Column, page_phone: Column, least: float = 0.75) -> Column:
    """Whether a page belongs to a business: equal phones decide, else the
    names' similarity; nothing to compare is a no."""
    a, b = normalize_phone(known_phone), normalize_phone(page_phone)
    named = F.coalesce((known_name != "") & (page_name != ""), F.lit(False))
    alike = fuzzy_similarity(known_name, page_name)
    return (
        F.when(F.coalesce(a == b, F.lit(False)), F.struct(F.lit(True).alias("matched"), F.lit("phone_exact").alias("reason")))
        .when(named, F.struct((alike >= least).alias("matched"), F.lit("name_similarity").alias("reason")))
        .otherwise(F.struct(F.lit(False).alias("matched"), F.lit("no_corroborating_signal").alias("reason")))
    )


# Facts whose invention is fatal, and the paths an official page may fill.
FATAL_FACTS = ["name", "phone", "email", "website", "address"]
SITE_PATHS = [
    "contact.email", "contact.website", "location.full_address", "location.city", "location.state", "location.postal_code", "location.coordinates", "identity.description", "social_links",
]


def factual_issues(made: DataFrame, profile: DataFrame, keys: list[str]) -> DataFrame:
    """what a made text states against the profile: (keys, field, issue,
    fatal). A value the profile lacks is fabricated, another one a mismatch."""
    facts = profile.select(*keys, "field", F.col("value").alias("fact"), F.lit(True).alias("_known"))
    rows = made.filter("value <> ''").join(facts, [*keys, "field"], "left")
    issue = F.when(F.col("_known").isNull(), "missing").when(F.col("fact").isNull() | (F.col("fact") == ""), "fabricated").when(F.col("fact") != F.col("value"), "mismatch")
    found = rows.withColumn("issue", issue).filter("issue IS NOT NULL")
    return found.select(*keys, "field", "issue", (F.col("field").isin(*FATAL_FACTS) & F.col("issue").isin("fabricated", "mismatch")).alias("fatal"))


def fill_gaps(profile: DataFrame, offered: DataFrame, keys: list[str], confidences: dict[str, float]) -> DataFrame:
    """Fields the profile lacks, filled from a record that passed the gate of
    ``record_conflicts``, at fixed confidences. One value a field: the earliest
    ``seq``, then the smallest; what the profile holds is never touched."""
    held = profile.filter("value <> ''").select(*keys, "field").distinct()
    first = offered.filter("value <> ''").groupBy(*keys, "field").agg(F.min(F.struct("seq", "value")).alias("m"))
    confidence = F.element_at(F.create_map(*[F.lit(x) for kv in confidences.items() for x in kv]), F.col("field"))
    return first.join(held, [*keys, "field"], "left_anti").select(*keys, "field", F.col("m.value").alias("value"), confidence.alias("confidence")).filter("confidence IS NOT NULL")


def accept_machine_values(offered: DataFrame, profile: DataFrame, keys: list[str], least: float = 0.6) -> DataFrame:
    """Values a model offers for fields the profile lacks: confident enough,
    with evidence whose text holds the value's snippet, and valid for their field."""
    held = profile.filter("value <> ''").select(*keys, "field").distinct()
    backed = F.coalesce((F.length("snippet") > 0) & (grounding(F.col("snippet"), F.col("evidence")) == "grounded"), F.lit(False))
    valid = semantic_error(F.col("field"), F.lit("string"), F.col("value")).isNull()
    return offered.filter((F.col("value") != "") & (F.col("confidence") >= least) & backed & valid).join(held, [*keys, "field"], "left_anti")


def decide_reviews(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """C17: adds new_status, action and error to reviews (review_id, status,
    match_type, related_entity_id) under decisions (review_id, decision).

    A pending review takes the decision. One already decided stays: the same
    decision changes nothing, another is an error. Approval of a brand's branches
    is status only; of the same or an uncertain entity it merges the related one,
    if there is any; of a relocation it moves the address, but is an error if it
    names a related entity. Rejection changes only the status; other words than
    approved and rejected, and several different decisions, are errors."""
    one = decisions.groupBy("review_id").agg(F.min("decision").alias("decision"), (F.countDistinct("decision") > 1).alias("_torn"))
    r = reviews.join(one, "review_id", "left")
    d, s = F.col("decision"), F.col("status")
    approved, kind = d == "approved", F.col("match_type")
    merges = kind.isin("same_entity", "uncertain") & F.col("related_entity_id").isNotNull()
    error = (
        F.when(d.isNull(), None)
        .when(F.col("_torn") | ~d.isin("approved", "rejected"), "invalid_decision")
        .when((s != "pending") & (s != d), "already_resolved")
        .when((s == "pending") & approved & (kind == "relocated_entity") & F.col("related_entity_id").isNotNull(), "ambiguous_merge")
    )
    acts = (s == "pending") & F.col("error").isNull() & d.isNotNull()
    action = F.when(acts & approved, F.when(merges, "merge").when(kind == "relocated_entity", "relocate").otherwise("none")).otherwise("none")
    return r.withColumn("error", error).withColumns({"new_status": F.when(acts, d).otherwise(s), "action": action}).drop("_torn")


def reload_canonical(fields: DataFrame) -> DataFrame:
    """C20: stored canonical fields (field, value) as they go back to a profile:
    JSON text becomes structure, an address in the place of a name is skipped."""
    kept = fields.filter(~F.coalesce((F.col("field") == "identity.name") & validate.street_like(F.col("value")), F.lit(False)))
    t = trim_blank(F.col("value"))
    looks = (t.startswith("[") & t.endswith("]")) | (t.startswith("{") & t.endswith("}"))
    structure = F.when(looks, F.try_parse_json("value"))
    return kept.withColumn("structure", structure).withColumn("kind", F.when(F.col("structure").isNotNull(), F.when(t.startswith("["), "array").otherwise("object")).otherwise("string"))


def routable(providers: DataFrame, max_cost: float, max_p50: float) -> DataFrame:
    """Providers a call may go to, best first by (tier, free, cost):
    configured, usable, not cooling down, circuit not open, cheap and fast enough, within quota."""
    ok = (
        F.col("configured") & F.col("usable") & (F.col("cooldown_ms") == 0) & (F.col("circuit") != "OPEN") & (F.coalesce("cost", F.lit(0.0)) <= max_cost)
        & (F.coalesce("p50", F.lit(0.0)) <= max_p50) & ~F.coalesce("quota_reached", F.lit(False))
    )
    return providers.filter(F.coalesce(ok, F.lit(False)))
