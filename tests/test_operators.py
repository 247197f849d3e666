import json
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from amalgam.operators import breaker as B, evaluate as E, fuse as U, resolve as R, running as N, store as S
from amalgam.operators.joins import chunked_join
from amalgam.plans import resolution
from amalgam.sources import tables as I
from tests.oracle import assert_same, connect

RECORD = "name string, phone string, website string, address string, city string, state string, lat double, lon double, category string, place_id string"


def pair(spark, a, b):
    base = dict(name="Ada Books", phone="415-555-0134", website="ada.example", address="5 Main St, Town", city="Town", state="CA", lat=1.0, lon=1.0, category="books", place_id=None)
    cols = [c.split()[0] for c in RECORD.split(", ")]
    row = tuple({**base, **a}[c] for c in cols) + tuple({**base, **b}[c] for c in cols)
    schema = ", ".join(f"a_{c}" for c in RECORD.split(", ")) + ", " + ", ".join(f"b_{c}" for c in RECORD.split(", "))
    return R.match_score(spark.createDataFrame([row], schema), country=F.lit("US")).first()


@pytest.mark.parametrize(
    "a, b, kind, location",
    [
        ({}, {}, "same_entity", "same"),
        ({}, {"address": "5 Main Street Town"}, "same_entity", "same"),
        ({}, {"lat": 1.01, "phone": "415-555-9999"}, "same_brand_different_location", "different"),
        ({}, {"lat": 1.01}, "relocated_entity", "different"),
        ({}, {"name": "Zyx"}, "different_entity", "same"),
        ({"phone": None, "website": None, "lat": None}, {}, "uncertain", "same"),
        ({"name": None, "phone": None, "website": None, "address": None, "lat": None, "category": None, "city": None}, {}, "different_entity", "unknown"),
    ],
)
def test_match_types(spark, a, b, kind, location):
    got = pair(spark, a, b)
    assert (got["match_type"], got["location"]) == (kind, location)


def test_missing_is_no_contradiction(spark):
    full, bare = pair(spark, {}, {}), pair(spark, {"phone": None}, {})
    assert full["score"] == 1.0 and 0.5 < bare["score"] <= full["score"] and bare["coverage"] == 0.75


def test_blocks_are_compared_whole_at_any_size(spark, tmp_path):
    rows = [(f"e{i:03}", None, "https://hub.example/biz/x") for i in range(450)] + [("z1", "415-555-0134", "https://z.example"), ("z2", "(415) 555-0134", "z.example"), ("z3", None, None)]
    pd.DataFrame(rows, columns=["entity_id", "canonical_phone", "canonical_website"]).to_parquet(tmp_path / "business_entity.parquet")
    got = resolution.QUERIES["j01_blocked_pairs"](spark, str(tmp_path))
    assert got.count() == 450 * 449 // 2 + 1
    assert_same(got, connect(str(tmp_path)).sql(resolution.SQL["j01_blocked_pairs"]))


def test_dedupe_fills_gaps_from_later_records(spark):
    rows = spark.createDataFrame([("k", 1, "A", None), ("k", 2, "B", "p"), (None, 3, "C", None), (None, 4, "C", None)], "k string, seq int, name string, phone string")
    got = {r["dedupe_key"]: (r["n_records"], r["name"], r["phone"]) for r in R.dedupe_and_fill(rows, F.col("k"), ["seq"], ["name", "phone"]).collect()}
    assert got["k"] == (2, "A", "p") and len(got) == 3


def test_relocations(spark):
    t = datetime(2024, 1, 1)
    day, minute = timedelta(days=1), timedelta(minutes=1)
    rows = [
        ("one", "r", "address", "a", t), ("one", "r", "phone", "1", t),
        ("moved", "r", "address", "a", t), ("moved", "s", "address", "b", t + day), ("moved", "r", "phone", "1", t),
        ("branch", "r", "address", "a", t), ("branch", "s", "address", "b", t + minute), ("branch", "r", "phone", "1", t), ("branch", "s", "phone", "2", t),
        ("five", "r", "address", "a", t), ("five", "s", "address", "b", t + 5 * minute), ("five", "r", "phone", "1", t),
        ("changed", "r", "address", "a", t), ("changed", "s", "address", "b", t + day), ("changed", "r", "phone", "1", t), ("changed", "s", "phone", "2", t),
    ]
    got = {r["entity_id"]: r["verdict"] for r in R.relocation_verdicts(spark.createDataFrame(rows, "entity_id string, record string, field string, value string, observed_at timestamp")).collect()}
    assert got == {"one": "uncertain", "moved": "relocated_entity", "branch": "same_brand_different_location", "five": "uncertain", "changed": "uncertain"}


def sequential_fold(rows, identity):
    acc, conflicts = None, 0
    rank = U.UPSERT_RANK
    strength = lambda p, c: 0.4 * U.CANONICAL_RANK.get(p, 1.0) + 0.15 + 0.3 * c
    for seq, value, prov, conf in rows:
        tier = rank.get(prov, 0.0)
        if acc is None:
            acc = (value, tier, conf, strength(prov, conf))
            continue
        gate = tier > acc[1] or (tier == acc[1] and conf > acc[2])
        if value != acc[0]:
            conflicts += 1
            change = strength(prov, conf) > acc[3] + 0.2 if identity else gate
        else:
            change = gate
        if change:
            acc = (value, tier, conf, strength(prov, conf))
    return acc[0]


def test_fold_and_gate_equal_a_step_by_step_loop(spark):
    rng = random.Random(7)
    rows, want, gate = [], {}, {}
    for g in range(40):
        seq = [(i, rng.choice("abc"), rng.choice(list(U.UPSERT_RANK)), round(rng.random(), 2)) for i in range(rng.randint(1, 8))]
        rows += [(g, "email", *r) for r in seq]
        best = None
        for i, v, p, c in seq:
            k = (U.UPSERT_RANK[p], c)
            if best is None or k > best[0]:
                best = (k, v)
        gate[g] = best[1]
    df = spark.createDataFrame([(g, f, float(i), v, p, c) for g, f, i, v, p, c in rows], "g int, field string, seq double, value string, provenance string, confidence double")
    assert {r["g"]: r["value"] for r in U.upsert_gate(df, ["g", "field"]).collect()} == gate
    got = {r["g"]: r["value"] for r in U.canonical_fold(df, ["g", "field"], F.lit(False)).collect()}
    by = {}
    for g, _, *r in rows:
        by.setdefault(g, []).append(tuple(r))
    assert got == {g: sequential_fold(r, False) for g, r in by.items()}


def test_selection_prefers_rank_then_confidence_then_order(spark):
    rows = [(1, "name", "a", "inferred", 0.9, 1.0), (1, "name", "b", "verified", 0.1, 2.0), (1, "name", "c", "verified", 0.1, 3.0), (1, "phone", "d", "inferred", None, 1.0)]
    got = U.best_candidates(spark.createDataFrame(rows, "g int, field string, value string, provenance string, confidence double, seq double"), ["g"])
    assert {r["value"] for r in got.filter("status = 'accepted'").collect()} == {"b", "d"}


def test_running_windows_equal_plain_ones(spark):
    rng = random.Random(3)
    t = datetime(2024, 1, 1)
    rows = [(1 if rng.random() < 0.7 else rng.randint(2, 4), t + timedelta(minutes=rng.randint(0, 9000)), i, rng.random() < 0.4, float(rng.randint(0, 50))) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, ts timestamp, id int, bad boolean, v double")
    got = {r["id"]: (r["s"], r["p"]) for r in N.rolling_percentiles(N.streaks(df, "k", ["ts", "id"], F.to_date("ts"), F.col("bad"), "s"), "k", ["ts", "id"], F.to_date("ts"), "v", 10, {"p": 0.5}, block=16).collect()}
    want, runs, last = {}, {}, {}
    for k, ts, i, bad, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        runs[k] = runs.get(k, 0) + 1 if bad else 0
        last.setdefault(k, []).append(v)
        window = sorted(last[k][-10:])
        want[i] = (runs[k], window[max(0, -(-len(window) // 2) - 1)])
    assert got == want


def test_breaker_opens_probes_and_closes(spark):
    t = datetime(2024, 1, 1)
    calls = [(1, t + timedelta(seconds=s), i, ok) for i, (s, ok) in enumerate([(0, False), (1, False), (2, False), (3, False), (4, False), (10, True), (70, True), (71, True), (72, False)])]
    got = [r["state"] for r in B.circuit_states(spark.createDataFrame(calls, "k int, ts timestamp, call_id long, ok boolean"), "k").orderBy("call_id").collect()]
    assert got == ["CLOSED"] * 4 + ["OPEN", "OPEN", "HALF_OPEN", "CLOSED", "CLOSED"]


def test_echoed_gold_scores_one(spark):
    gold = spark.createDataFrame([(1, "name", "Ada"), (1, "phone", ""), (2, "name", "Bo")], "id int, field string, value string")
    got = E.rates(E.compare_fields(gold, gold, ["id"]).agg(*E.confusion())).first()
    assert (got["precision"], got["recall"], got["f1"], got["hallucination"]) == (1.0, 1.0, 1.0, 0.0)


def test_wrong_value_is_a_false_positive_only(spark):
    p = spark.createDataFrame([(1, "name", "X"), (1, "city", "Y")], "id int, field string, value string")
    g = spark.createDataFrame([(1, "name", "Ada"), (1, "phone", "1")], "id int, field string, value string")
    got = E.compare_fields(p, g, ["id"]).agg(*E.confusion()).first()
    assert (got["tp"], got["fp"], got["fn"]) == (0, 2, 1)


def test_calibration_edges(spark):
    pairs = spark.createDataFrame([(0.1, True), (0.3, False), (0.7, True), (0.85, False), (1.0, True), (1.5, True), (None, True)], "confidence double, correct boolean")
    bins = [r["b"] for r in pairs.select(E.calibration_bin(F.col("confidence")).alias("b")).collect()]
    assert bins == [1, 3, 7, 8, 9, None, None]
    got = E.calibration(pairs).first()
    assert got["n"] == 6 and got["false_confidence"] == pytest.approx(0.1667)
    assert E.calibration(pairs.limit(0)).first()["n"] is None


def test_grounding(spark):
    rows = [("Ada  Books", "we met ada books here"), ("Ada", "ada"), ("Ada Books", "nothing"), (None, "x")]
    got = [r[0] for r in spark.createDataFrame(rows, "s string, e string").select(E.grounding(F.col("s"), F.col("e"))).collect()]
    assert got == ["grounded", "unverifiable", "unsupported", "unverifiable"]


def test_store(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "k string, at int, v string")
    new = spark.createDataFrame([("a", 1, "z"), ("b", 4, "w"), ("c", 1, "n")], "k string, at int, v string")
    assert {r["k"]: r["v"] for r in S.upsert(old, new, ["k"], "at").collect()} == {"a": "z", "b": "y", "c": "n"}
    queue = spark.createDataFrame([("p", 1)], "key string, n int")
    items = spark.createDataFrame([("p", 2), ("q", 3), ("q", 4)], "key string, n int")
    assert [r["key"] for r in S.insert_once(queue, items, "key").collect()] == ["q"]
    ids = spark.createDataFrame([("g", "1", "e1"), ("g", "2", "e2")], "provider string, provider_record_id string, entity_id string")
    ents = spark.createDataFrame([("e1", "ACTIVE"), ("e2", "ACTIVE")], "entity_id string, status string")
    moved, marked = S.merge_entities(ids, ents, spark.createDataFrame([("e2", "e1")], "source string, target string"))
    assert {r["entity_id"] for r in moved.collect()} == {"e1"} and {r["entity_id"]: r["status"] for r in marked.collect()} == {"e1": "ACTIVE", "e2": "MERGED"}


def test_manifest(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"exampleId": "1", "task": "t", "split": "train"}\n{"exampleId": "2", "task": "t", "split": "train"}\n')
    entry = {"task": "t", "split": "train", "path": "a.jsonl", "examples": 2}
    (tmp_path / "m.json").write_text(json.dumps({"datasets": [entry]}))
    assert I.read_manifest(spark, str(tmp_path / "m.json"), "train").count() == 2
    assert I.read_manifest(spark, str(tmp_path / "m.json"), "holdout").count() == 0
    (tmp_path / "m.json").write_text(json.dumps({"datasets": [{**entry, "examples": 3}]}))
    with pytest.raises(ValueError, match="manifest"):
        I.read_manifest(spark, str(tmp_path / "m.json"))


def test_rows_with_unreadable_payload_are_skipped(spark):
    rows = spark.createDataFrame([(1, '{"name": "A"}'), (2, "{bad"), (3, None)], "id int, payload string")
    assert [tuple(r) for r in I.hydrate(rows, "payload", "name string").collect()] == [(1, "A")]


def test_user_records_need_a_name(spark):
    got = I.user_records(spark.createDataFrame([("Ada", "1", "x.example")], "businessName string, phoneNumber string, url string")).first()
    assert (got["name"], got["phone"], got["website"], got["postal_code"]) == ("Ada", "1", "x.example", None)
    with pytest.raises(Exception, match="without name"):
        I.user_records(spark.createDataFrame([("",)], "name string")).collect()


def test_streams(spark, tmp_path):
    from amalgam.streaming.usage import breaker_stream, usage_by_window

    t = datetime(2024, 1, 1)
    rows = [(t + timedelta(hours=h), 1, "error" if h % 3 else "view", 1.0, h % 3 == 0) for h in range(48)]
    spark.createDataFrame(rows, "ts timestamp, user_id long, event_type string, value double, ok boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, user_id long, event_type string, value double, ok boolean").parquet(str(tmp_path / "in"))
    for name, out, mode in (("usage_out", usage_by_window(stream), "complete"), ("breaker_out", breaker_stream(stream), "update")):
        q = out.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.sql("SELECT sum(n) FROM usage_out").first()[0] == 48
    assert spark.sql("SELECT count(*) FROM breaker_out").first()[0] == 1


# the candidate pipeline


CANDIDATE = "id string, field string, kind string, value string, confidence double, provenance string, snippet string, evidence_id string, seq long"


def decide(spark, candidates, profile=(), **options):
    from amalgam.operators import candidates as P

    rows = spark.createDataFrame(candidates, CANDIDATE).withColumn("status", F.lit("clash"))
    known = spark.createDataFrame(list(profile), "id string, field string, value string, confidence double")
    return {(r["field"], r["value"]): (r["status"], r["reason"]) for r in P.run_pipeline(rows, ["id"], known, **options).collect()}


def candidate(field, value, confidence=0.9, provenance="discovered", kind="string", snippet=None, seq=1):
    return ("e", field, kind, value, confidence, provenance, snippet, None, seq)


def test_pipeline_selects_by_provenance_then_confidence_then_arrival(spark):
    got = decide(spark, [candidate("identity.category", "a", 0.9, "inferred"), candidate("identity.category", "b", 0.5, "verified", seq=3), candidate("identity.category", "c", 0.5, "verified", seq=2), candidate("identity.category", "d", None, "verified")])
    assert got == {("identity.category", "c"): ("accepted", None), **{("identity.category", v): ("rejected", "lower_priority") for v in "abd"}}


def test_pipeline_rejects_what_fails_a_check(spark):
    got = decide(
        spark,
        [
            candidate("contact.phone", "555-0134"), candidate("contact.phone", "+1 415 555 0134", provenance="inferred"), candidate("contact.email", "user@example.com"), candidate("identity.name", "12 Main Street"),
            candidate("identity.name", "Ada Books", provenance="ai_generated"), candidate("ratings.rating", "7", kind="number"), candidate("ratings.review_count", "5", kind="number"), candidate("location.coordinates", "1,2", kind="string"),
            candidate("location.coordinates", "91,2", kind="object"), candidate("contact.website", "https://www.yelp.com/biz/x"), candidate(None, "x"), candidate("identity.category", None),
        ],
        [("e", "ratings.rating", "5", 0.9)],
    )
    assert got["contact.phone", "+1 415 555 0134"] == ("accepted", None)
    reasons = {k: v[1] for k, v in got.items() if v[0] == "rejected"}
    assert reasons == {
        ("contact.phone", "555-0134"): "semantic:warn", ("contact.email", "user@example.com"): "semantic", ("identity.name", "12 Main Street"): "semantic", ("identity.name", "Ada Books"): "evidence", ("ratings.rating", "7"): "semantic",
        ("ratings.review_count", "5"): "cross-field", ("location.coordinates", "1,2"): "type", ("location.coordinates", "91,2"): "semantic", ("contact.website", "https://www.yelp.com/biz/x"): "semantic", (None, "x"): "unknown_field", ("identity.category", None): "type",
    }


def test_pipeline_conflicts_and_weak_values(spark):
    old, new = ("e", "identity.name", "Old Books", 0.4), candidate("identity.name", "New Books", 0.85)
    assert decide(spark, [new, candidate("identity.name", "Third", 0.2)], [old]) == {("identity.name", "New Books"): ("conflict", None), ("identity.name", "Third"): ("valid", None)}
    assert decide(spark, [new], [old], overwrite_below=0.5)["identity.name", "New Books"] == ("accepted", None)
    assert decide(spark, [candidate("identity.name", "New Books", 0.75)], [old], overwrite_below=0.5)["identity.name", "New Books"] == ("conflict", None)
    assert decide(spark, [candidate("identity.name", "OLD books", 0.1)], [old])["identity.name", "OLD books"] == ("accepted", None)
    assert decide(spark, [new], [old], only_if_missing=True)["identity.name", "New Books"] == ("rejected", "field_populated")
    assert decide(spark, [candidate("identity.name", "New Books", 0.75)], [old], only_if_missing=True, overwrite_below=0.5)["identity.name", "New Books"] == ("rejected", "below_confidence_bar")
    assert decide(spark, [new], [old], only_if_missing=True, overwrite_below=0.5)["identity.name", "New Books"] == ("accepted", None)
    assert decide(spark, [new, candidate("identity.category", "books")], [], conservative=True) == {("identity.name", "New Books"): ("rejected", "conservative_identity"), ("identity.category", "books"): ("accepted", None)}
    assert decide(spark, [candidate("identity.category", "new")], [("e", "identity.category", "old", 0.9)])["identity.category", "new"] == ("accepted", None)


def test_streaks_and_breaker_on_one_hot_key(spark):
    rng = random.Random(3)
    at, rows = datetime(2024, 1, 1), []
    for i in range(900):
        at += timedelta(seconds=rng.choice([1, 5, 30, 70, 4000]))
        rows.append(("k", at, i, rng.random() > (0.9 if 300 < i < 330 else 0.3)))
    df = spark.createDataFrame(rows, "k string, ts timestamp, call_id long, ok boolean")
    state, want, run, streak = dict(B.STATE), {}, 0, {}
    for _, ts, i, ok in rows:
        state = B.advance(state, ts.timestamp(), ok)
        want[i] = state["state"]
        run = 0 if ok else run + 1
        streak[i] = run
    assert {r["call_id"]: r["state"] for r in B.circuit_states(df, "k").collect()} == want and "OPEN" in want.values()
    got = N.streaks(df, "k", ["ts", "call_id"], F.to_date("ts"), ~F.col("ok"), "n").collect()
    assert {r["call_id"]: r["n"] for r in got} == streak


def test_nearest_rank_is_carried_over_parts(spark):
    rng = random.Random(4)
    rows = [("a", float(rng.randint(1, 400))) for _ in range(3000)] + [("b", 7.0), ("c", None)]
    got = {r["k"]: (r["lo"], r["hi"]) for r in N.nearest_rank(spark.createDataFrame(rows, "k string, v double").repartition(5), "k", "v", {"lo": 0.5, "hi": 0.95}).collect()}
    a = sorted(v for k, v in rows if k == "a")
    assert got == {"a": (a[1499], a[2849]), "b": (7.0, 7.0)}


def test_exact_and_near_positions_identify(spark):
    bare = {"phone": None, "website": None, "place_id": None}
    kinds = [pair(spark, bare, {**bare, "lat": 1.0 + metres / 111_195})["match_type"] for metres in (5, 30, 80)]
    assert kinds[1] != "same_entity" and kinds == [kinds[0], "uncertain", kinds[2]]


def test_failure_labels(spark):
    schema = "id string, ok boolean, error string, invented int, entity_wrong int, other_wrong int, missed int, bold int, coverage double, unsupported int, schema_compliant boolean, schema_errors string"
    none = (0, 0, 0, 0, 0, None, 0, True, None)
    rows = [
        ("a", True, None, *none), ("b", False, "no parseable JSON", *none), ("c", False, "contract: name is required", *none), ("d", False, None, *none), ("e", True, None, 1, 1, 1, 0, 1, 0.5, 1, False, "x.status: value not in enum"),
        ("f", True, None, 0, 0, 0, 1, 0, None, None, True, None),
    ]
    got = {r["id"]: (r["labels"], r["severity"]) for r in E.failure_labels(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        "a": ([], "LOW"), "b": (["FORMAT_ERROR"], "CRITICAL"), "c": (["SCHEMA_ERROR"], "HIGH"), "d": (["OTHER"], "HIGH"), "f": (["EXTRACTION_ERROR"], "MEDIUM"),
        "e": (["HALLUCINATION", "ENTITY_RESOLUTION_ERROR", "EXTRACTION_ERROR", "EVIDENCE_ERROR", "SCHEMA_ERROR", "CONFIDENCE_ERROR", "UNKNOWN_HANDLING_ERROR"], "CRITICAL"),
    }


def test_review_decisions(spark):
    from amalgam.operators import candidates as P

    reviews = spark.createDataFrame(
        [("a", "pending", "uncertain", "x"), ("b", "pending", "uncertain", None), ("c", "approved", "same_entity", "x"), ("d", "approved", "same_entity", "x"), ("e", "pending", "relocated_entity", None), ("f", "pending", "relocated_entity", "x"),
         ("g", "pending", "same_brand_different_location", "x"), ("h", "pending", "uncertain", "x"), ("i", "pending", "uncertain", "x"), ("j", "pending", "uncertain", "x"), ("k", "pending", None, None)],
        "review_id string, status string, match_type string, related_entity_id string",
    )
    made = [(x, "approved") for x in "abcefgik"] + [("d", "rejected"), ("h", "rejected"), ("i", "rejected"), ("z", "approved")]
    got = {r["review_id"]: (r["new_status"], r["action"], r["error"]) for r in P.decide_reviews(reviews, spark.createDataFrame(made, "review_id string, decision string")).collect()}
    assert got == {
        "a": ("approved", "merge", None), "b": ("approved", "none", None), "c": ("approved", "none", None), "d": ("approved", "none", "already_resolved"), "e": ("approved", "relocate", None), "f": ("pending", "none", "ambiguous_merge"),
        "g": ("approved", "none", None), "h": ("rejected", "none", None), "i": ("pending", "none", "invalid_decision"), "j": ("pending", "none", None), "k": ("approved", "none", None),
    }


def test_manifest_counts_every_file_in_one_read(spark, tmp_path):
    for name, n in (("a b.jsonl", 3), ("c.jsonl", 2)):
        (tmp_path / name).write_text("".join(json.dumps({"exampleId": f"{name}{i}", "split": "train"}) + "\n" for i in range(n)))
    manifest = tmp_path / "manifest.json"
    manifest.write_text(json.dumps({"datasets": [{"path": "a b.jsonl", "split": "train", "examples": 3}, {"path": "c.jsonl", "split": "train", "examples": 2}]}))
    assert sorted(r["path"] for r in I.read_manifest(spark, str(manifest)).collect()) == ["a b.jsonl"] * 3 + ["c.jsonl"] * 2
    manifest.write_text(json.dumps({"datasets": [{"path": "c.jsonl", "split": "train", "examples": 4}]}))
    with pytest.raises(ValueError, match="c.jsonl: 2 rows"):
        I.read_manifest(spark, str(manifest))
    assert I.read_manifest(spark, str(manifest), split="none").count() == 0


@pytest.mark.parametrize("turned", [False, True])
def test_chunked_join_is_the_whole_join(spark, turned):
    """Keys that are hot on one side, on both and on none, and null keys."""
    many = spark.createDataFrame([(None if i % 10 == 3 else 0 if i % 4 else i % 3, i) for i in range(80)], "k int, x int")
    few = spark.createDataFrame([(i % 5, i) for i in range(12)] + [(None, 99)] + [(2, 200 + i) for i in range(20)], "k int, y int")
    rows = lambda df: sorted((r["k"], r["x"], r["y"]) for r in df.collect())
    got = chunked_join(few, many, ["k"], "y", "x", 7) if turned else chunked_join(many, few, ["k"], "x", "y", 7)
    assert rows(got) == rows(many.join(few, "k"))
    assert rows(chunked_join(many, few, ["k"], "x", "y")) == rows(many.join(few, "k"))
    assert chunked_join(many.limit(0), few, ["k"], "x", "y", 7).count() == 0
