import os
import random
from collections import Counter, defaultdict
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from amalgam.llm import registry
from amalgam.llm import normal as N, p01_pairs as P1, p02_matches as P2, p03_survivors as P3, p04_splits as P4, p05_overlaps as P5, p06_groups as P6, p07_addresses as P7, p08_containers as P8, p09_mix as P9, p10_spans as P10
from amalgam.llm.crf import ChainCRF
from tests.oracle import assert_same, connect

FOLDER = "/root/testdata/sf0.001"
with_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@with_tables
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, FOLDER), connect(FOLDER).sql(registry.SQL[name]))


# 6: groups


def components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("rounds, hot", [(12, 3), (12, 1 << 20), (1, 3), (1, 1 << 20)])
def test_groups_equal_union_find(spark, monkeypatch, rounds, hot):
    monkeypatch.setattr(P6, "HOT_LINKS", hot)
    rng = random.Random(5)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(30)]
    star = [("hub", f"s{i}") for i in range(40)] + [("s1", "t1"), ("t1", "t2"), ("t2", "t3")]
    loose = [(f"x{rng.randint(0, 60)}", f"x{rng.randint(0, 60)}") for _ in range(30)]
    edges = chain + star + loose + star[:5] + [(b, a) for a, b in chain[:5]] + [("self", "self")]
    rows = spark.createDataFrame(edges + [(None, "a"), ("a", None)], "l string, r string").withColumn("a", F.lit(1)).withColumn("u", F.lit("clash"))
    got = {r["member"]: r["group_key"] for r in P6.connected_groups(rows, "l", "r", peel_rounds=rounds).collect()}
    assert got == components([(a, b) for a, b in edges if a != b])


def test_no_links_no_groups(spark):
    assert P6.connected_groups(spark.createDataFrame([], "l string, r string"), "l", "r").count() == 0
    assert P6.connected_groups(spark.createDataFrame([("a", "a")], "l string, r string"), "l", "r").count() == 0


# 10: spans


def brute_spans(rows, k):
    seen = defaultdict(set)
    for d, t in rows:
        for i in range(len(t or "") - k + 1):
            seen[t[i : i + k]].add(d)
    out = set()
    for d, t in rows:
        covered = sorted(i for i in range(len(t or "") - k + 1) if len(seen[t[i : i + k]]) > 1)
        spans = []
        for i in covered:
            if spans and i <= spans[-1][1]:
                spans[-1][1] = i + k
            else:
                spans.append([i, i + k])
        out |= {(d, a, b) for a, b in spans}
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_spans_equal_brute_force(spark, hot):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abé漢😀 ") for _ in range(rng.randint(3, 60)))
    parts = [word() for _ in range(12)]
    rows = [(i, "".join(rng.choice(parts) if rng.random() < 0.5 else word() for _ in range(rng.randint(1, 5)))) for i in range(40)]
    rows += [(100, "same text twice in one record " * 3), (101, None), (102, ""), (103, "x" * 500), (104, "x" * 300), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("minimiser", F.lit("clash")).withColumn("packed", F.lit(1))
    got = {tuple(r) for r in P10.shared_spans(df, k=20, m=8, hot_bucket=hot).collect()}
    assert got == brute_spans(rows, 20)


def test_no_documents_no_spans(spark):
    assert P10.shared_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# 8: containers


def test_boundaries_are_optimal():
    rng = random.Random(2)
    hist = Counter(rng.randint(1, 12) for _ in range(60))
    cost = lambda bounds: sum(n * (min(b for b in bounds if b >= x) - x) for x, n in hist.items())
    import itertools

    lengths = sorted(hist)
    best = min(cost((*c, lengths[-1])) for c in itertools.combinations(lengths[:-1], 2))
    assert cost(P8.bucket_boundaries(hist, 3)) == best and P8.bucket_boundaries({}) == []


def test_containers_hold_every_item_once(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([0, None, 1, 5, 17, 63, 64, 65, 128, 200])) for i in range(300)] + [(7, 17), (None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long").withColumn("shard", F.lit("clash"))
    got = P8.fill_containers(df, [("a", 64), ("none", 0)], shard_items=100).collect()
    assert all(r["used_tokens"] <= 64 and r["container_name"] == "a" for r in got) and len({r["container_id"] for r in got}) == len(got)
    pieces = Counter((i["doc_id"], i["token_from"], i["token_to"]) for r in got for i in r["items"])
    want = Counter()
    for d, n in rows:
        if d is not None:
            n = n or 0
            want.update([(d, a, min(a + 64, n)) for a in range(0, n, 64)] or [(d, 0, 0)])
    assert pieces == want
    assert P8.fill_containers(df.limit(0), [("a", 64)]).count() == 0


def test_containers_leave_little_space(spark):
    rng = random.Random(6)
    lengths = [min(256, int(rng.lognormvariate(4, 0.8)) + 1) for _ in range(3000)]
    batches = P8.fill(lengths, 256, P8.bucket_boundaries(Counter(lengths)))
    assert sorted(i for b in batches for i in b) == list(range(3000))
    assert sum(lengths) / (256 * len(batches)) > 0.97


# 9: mixing


def test_rates_invert_the_poisson_distribution():
    u, j = np.array([0.3, 0.9, 0.5]), np.array([1.0, 2.0, 4.0])
    rate = P9.rate_of_copy(u, j)
    for r, p, n in zip(rate, u, j):
        below = sum(np.exp(-r) * r**k / math_factorial(k) for k in range(int(n)))
        assert below == pytest.approx(p, abs=1e-9)


def math_factorial(k):
    return 1 if k < 2 else k * math_factorial(k - 1)


def test_mixture_reaches_shares_within_caps(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["Big-One", "big_one", "mid", "small"] if i % 9 else ["other"]), rng.randint(1, 300)) for i in range(4000)] + [(None, "mid", 5), (9001, None, 5), (9002, "mid", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long").withColumn("rate", F.lit("clash"))
    targets = spark.createDataFrame([("big_one", 0.5, 1), ("mid", 0.2, 2), ("small", 0.2, 3), ("absent", 0.1, 3)], "source string, target_share double, max_repeats int")
    cap = {"big_one": 1, "mid": 2, "small": 3}
    asked = {"big_one": 0.5 / 0.9, "mid": 0.2 / 0.9, "small": 0.2 / 0.9}
    # A total that no cap hinders is shared out as asked.
    chosen, shares = P9.mix(docs, targets, total_tokens=100_000)
    assert all(1 <= r["repeats"] <= cap[r["source"]] for r in chosen.collect())
    rows_ = {r["source"]: r for r in shares.collect()}
    assert rows_["absent"]["actual_share"] == 0 and all(abs(rows_[s]["actual_share"] - w) < 0.004 and rows_[s]["short_tokens"] == 0 for s, w in asked.items())
    assert abs(sum(r["tokens"] for r in rows_.values()) - 100_000) < 1500
    order = [r["doc_id"] for r in P9.shuffled(chosen).collect()]
    assert len(order) == sum(r["repeats"] for r in chosen.collect()) and order != sorted(order)
    # By default all tokens are asked for: the capped source gives all it may and falls short, the others fill up.
    chosen, shares = P9.mix(docs, targets)
    rows_ = {r["source"]: r for r in shares.collect()}
    whole = sum(n for i, s, n in rows if i is not None and n and s and P9_name(s) in cap)
    big = sum(n for _, s, n in rows if s in ("Big-One", "big_one"))
    assert rows_["big_one"]["tokens"] == big and abs(rows_["big_one"]["short_tokens"] - (whole * asked["big_one"] - big)) < 2
    assert abs(sum(r["tokens"] for r in rows_.values()) - whole) < 1500 and abs(rows_["mid"]["tokens"] - rows_["small"]["tokens"]) < 1500
    assert P9.mix(docs.limit(0), targets)[0].count() == 0


def P9_name(source):
    return source.lower().replace("-", "_")


def test_needs_give_the_lack_of_capped_sources_to_the_rest():
    need = P9.needs({"a": 10.0, "b": 100.0, "c": 900.0}, {"a": (0.4, 2), "b": (0.2, 4), "c": (0.4, 4)}, None)
    assert need["a"] == 20 and need["b"] == pytest.approx(990 / 3) and need["c"] == pytest.approx(990 * 2 / 3)
    assert P9.needs({}, {}, None) == {} and sum(P9.needs({"a": 5.0}, {"a": (1.0, 2)}, 1e9).values()) == 10


# 4: splits


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("The Tola Cycles of Rudim, LLC", " tola  CYCLES of Rudim", True), ("Tola &amp; Rudim Cycles | Sandwick", "Tola and Rudim Cycles Ltd", True), ("Tola’s Rudim Cycles", "Tolas Rudim Cycles", True),
        ("Tola and Rudim Cycles", "Tola and Rudim Books", False), ("Tola and Rudim Cycles", "Tola and Vusak Cycles", False),
    ],
)
def test_names(a, b, same):
    assert (N.name_tokens(a) == N.name_tokens(b)) is same


def test_no_names():
    assert [N.name_tokens(x) for x in (None, "", "Unknown business", "n/a", "12 Main Street, Town")] == [None] * 5


def kruskal(edges):
    parent, total = {}, 0
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for w, a, b in sorted((w, a, b) for a, b, w in edges):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            total += w
    return total, {frozenset(y for y in parent if find(y) == find(x)) for x in parent}


def test_forest_is_minimal(spark):
    rng = random.Random(9)
    edges = list({(a, b): (a, b, rng.randint(1, 4) / 4) for a, b in ((f"v{i}", f"v{j}") for i, j in (sorted(rng.sample(range(24), 2)) for _ in range(40)))}.values())
    labels, forest = P4.spanning_forest(spark.createDataFrame(edges + [(None, "v1", 1.0), ("v1", "v1", 1.0)], "a string, b string, weight double"))
    total, parts = kruskal(edges)
    by = defaultdict(set)
    for r in labels.collect():
        by[r["root"]].add(r["vertex"])
    assert {frozenset(s) for s in by.values()} == parts
    assert sum(r["weight"] for r in forest.collect()) == pytest.approx(total)


def test_related_records_share_a_split(spark):
    rng = random.Random(10)
    names = [f"{w} {t}" for w in ("Tolavi", "Rudimo", "Vusake", "Hebrono") for t in ("Cycles", "Books", "Bakery")]
    rows = [(f"e{i:04}", rng.choice(names) + rng.choice(["", " Ltd", " | Town", ", LLC"])) for i in range(600)] + [(f"n{i}", None) for i in range(300)] + [("e0000", None)]
    groups, _ = P4.related_groups(spark.createDataFrame(rows, "id string, nm string").withColumn("root", F.lit("clash")), "id", "nm")
    dealt = P4.deal_splits(groups, [("train", 0.8), ("validation", 0.1), ("holdout", 0.1)]).collect()
    assert len(dealt) == 900 and len({r["record"] for r in dealt}) == 900
    assert len({(r["group_id"], r["split"]) for r in dealt}) == len({r["group_id"] for r in dealt}) == 312
    share = Counter(r["split"] for r in dealt)
    assert abs(share["train"] / 900 - 0.8) < 0.05
    assert P4.related_groups(spark.createDataFrame([], "id string, nm string"), "id", "nm")[0].count() == 0


def test_all_names_of_a_record_relate_it(spark):
    rows = [("r1", "Tola Cycles"), ("r2", "Morton Garage"), ("r3", "Tola Cycles"), ("r3", "Morton Garage"), ("r3", "Zebra Books"), ("r4", "Zebra Books"), ("r5", "Other Books")]
    groups, _ = P4.related_groups(spark.createDataFrame(rows, "id string, nm string"), "id", "nm")
    assert {r["record"]: r["group_id"] for r in groups.collect()} == {"r1": "r1", "r2": "r1", "r3": "r1", "r4": "r1", "r5": "r5"}


@pytest.mark.parametrize("slices", [4, 4096])
def test_splits_meet_their_shares_by_one_rule(spark, monkeypatch, slices):
    """Few roots and many, one of them a third of all rows: the same dealing holds."""
    monkeypatch.setattr(P4, "SLICES", slices)
    sizes = [1000, 60, 40, 40] + [7] * 40 + [1] * 1600
    rows = [(f"r{g}-{k}", f"g{g:04}", n) for g, n in enumerate(sizes) for k in range(n)]
    groups = spark.createDataFrame(rows, "record string, group_id string, records long")
    dealt = P4.deal_splits(groups, [("train", 8.0), ("validation", 1.0), ("holdout", 1.0), ("none", 0.0), (None, 1.0)]).collect()
    share = Counter(r["split"] for r in dealt)
    assert len(dealt) == len(rows) and set(share) == {"train", "validation", "holdout"}
    assert len({(r["group_id"], r["split"]) for r in dealt}) == len(sizes)
    assert abs(share["train"] / len(rows) - 0.8) < (0.005 if slices > 4 else 0.08)
    assert P4.deal_splits(groups.limit(0), [("train", 1.0)]).count() == 0 and P4.deal_splits(groups, []).count() == 0


# 7: addresses


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("12 E. Tolavi Ct, Sandwick, NV 99320, USA", "Sandwick, NV 99320, #12 East Tolavi Court, Suite 5", True), ("Tolavi-Weg 12, 38036 Sandwick", "38036 Sandwick, Tolaviweg 12 EG (Germany)", True),
        ("12 Tolavirudim Street\nSandwick NV", "No. 12 tolavriudim st, sandwick, nv 99320-1234", True), ("12 E Tolavi Ct, Sandwick", "12 W Tolavi Ct, Sandwick", False), ("12 Tolavi Ct, Sandwick", "12 Tolavi Ave, Sandwick", False),
        ("12 Tolavi Ct, Sandwick", "14 Tolavi Ct, Sandwick", False), ("12 Tolavi Ct, Sandwick", "12 Tolavi Ct, Rudimville", False),
    ],
)
def test_addresses(spark, a, b, same):
    rows = spark.createDataFrame([("a", a), ("b", b), ("c", None), ("d", "n/a"), ("e", "Sandwick"), ("a", a)], "id string, adr string").withColumn("place", F.lit("clash"))
    got = {r["record"]: r["place_id"] for r in P7.same_places(rows, "id", "adr").collect()}
    assert set(got) == {"a", "b"} and (got["a"] == got["b"]) is same


def test_prefix_never_loses_a_close_pair():
    rng = random.Random(12)
    words = ["".join(rng.choice("abcde") for _ in range(6)) for _ in range(40)]
    weights = P7.Weights(Counter(g for w in words for g in P7.grams(w, "town")), len(words))
    vecs = [weights.vector(w, "town") for w in words]
    for i in range(40):
        for j in range(i):
            if P7.cosine(vecs[i], vecs[j]) >= 0.5:
                assert set(P7.prefix(vecs[i], 0.5)) & set(P7.prefix(vecs[j], 0.5))


@pytest.mark.parametrize("chunk", [2, 5000])
def test_incomplete_addresses_keep_their_links(spark, monkeypatch, chunk):
    from amalgam.operators import joins

    monkeypatch.setattr(joins, "CHUNK_ROWS", chunk)
    rows = [
        ("a", "12 Wellington, Springfield"), ("b", "12 Wellingtom, Springfield"),  # both without type
        ("c", "17 Wellington Street"), ("d", "17 Welington Street"),  # both without place
        ("e", "19 Wellington St, Springfield"), ("f", "19 Wellington, Springfield"), ("g", "19 Wellingtan, Springfield"),  # through a complete one
        ("h", "21 Wellington St, Springfield"), ("i", "21 Wellington Ave, Springfield"), ("j", "21 Wellington, Springfield"),  # fits two: neither
    ]
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("bdfgklmn") + rng.choice("aeiou") for _ in range(4)).title()
    rows += [(f"n{i}", f"{i} {word()} Rd, {word()}") for i in range(30, 330)]
    got = {r["record"]: r["place_id"] for r in P7.same_places(spark.createDataFrame(rows, "id string, adr string"), "id", "adr").collect()}
    places = defaultdict(set)
    for record, place in got.items():
        places[place].add(record)
    assert sorted(map(sorted, (p for p in places.values() if len(p) > 1))) == [["a", "b"], ["c", "d"], ["e", "f", "g"]] and len(got) == len(rows)


# 2: matches


def test_assignment_is_optimal():
    import itertools

    rng = np.random.default_rng(1)
    for n, m in ((3, 3), (2, 4), (4, 2)):
        w = rng.random((n, m)).round(2)
        got = sum(w[i, j] for i, j in P2.best_assignment(w))
        k = min(n, m)
        best = max(sum(w[i, j] for i, j in zip(r, c)) for r in itertools.permutations(range(n), k) for c in itertools.combinations(range(m), k))
        assert got == pytest.approx(best)


@pytest.mark.parametrize("exact", [2000, 1])
def test_one_to_one(spark, monkeypatch, exact):
    monkeypatch.setattr(P2, "EXACT_EDGES", exact)
    edges = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.8), ("b", "x", 0.85), ("c", "z", 0.5)], "left string, right string, confidence double")
    got = {(r["left"], r["right"]) for r in P2.assign_one_to_one(edges).collect()}
    assert got == {("a", "y"), ("b", "x"), ("c", "z")}
    assert P2.assign_one_to_one(edges.limit(0)).count() == 0


@pytest.mark.parametrize("exact", [2000, 1])
def test_total_confidence_is_greatest_at_any_size(spark, monkeypatch, exact):
    monkeypatch.setattr(P2, "EXACT_EDGES", exact)
    rng = np.random.default_rng(7)
    w = np.where(rng.random((12, 9)) < 0.5, rng.random((12, 9)).round(3), 0.0)
    edges = spark.createDataFrame([(f"l{i}", f"r{j}", float(w[i, j])) for i in range(12) for j in range(9) if w[i, j]], "left string, right string, confidence double")
    got = P2.assign_one_to_one(edges).collect()
    assert len({r["left"] for r in got}) == len({r["right"] for r in got}) == len(got)
    best = sum(w[i, j] for i, j in P2.best_assignment(w))
    assert best - P2.EPSILON * 9 <= sum(r["confidence"] for r in got) <= best + 1e-9


def test_positions_are_compared_both_ways_anywhere(spark):
    """An exchanged position meets its place on any quarter of the globe."""
    kept = "sig string, phone string, host string, house string, direction string, street string, kind string, town string, zip string, lat double, lon double"
    none = (None, None, "", "", "", "", "", "")
    for lat, lon in ((-33.86, 61.2), (40.7, -74.0), (52.5, 13.4), (-22.9, -43.2)):
        records = spark.createDataFrame([("p", "r", "rudim tola", *none, lon, lat), ("p", "s", "vusak cycle", *none, lat, lon)], f"provider string, record_id string, {kept}")
        entities = spark.createDataFrame([("e", "rudim tola", *none, lat, lon), ("f", "vusak cycle", *none, lat, lon)], f"cluster string, {kept}")
        assert {(r["record_id"], r["cluster"]) for r in P2.match_entities(records, entities).collect()} == {("r", "e"), ("s", "f")}


@with_tables
def test_matches_find_known_entities(spark):
    found = P2.match_entities(P2.unresolved_readings(spark, FOLDER, resolved=True), P2.entity_readings(spark, FOLDER))
    truth = spark.read.parquet(f"{FOLDER}/provider_identity.parquet").filter("entity_id IS NOT NULL").select("provider", F.col("provider_record_id").alias("record_id"), "entity_id").distinct()
    cluster = spark.read.parquet(f"{FOLDER}/business_entity.parquet").select("entity_id", P2._cluster().alias("truth"))
    rows = truth.join(cluster, "entity_id").join(found, ["provider", "record_id"], "left").collect()
    right = sum(r["cluster"] == r["truth"] for r in rows)
    wrong = sum(r["cluster"] is not None and r["cluster"] != r["truth"] for r in rows)
    assert right >= 0.9 * len(rows) and wrong <= 0.05 * len(rows)
    nothing = P2.unresolved_readings(spark, FOLDER).limit(0)
    assert P2.match_entities(nothing, P2.entity_readings(spark, FOLDER)).count() == 0


def test_equal_keys_always_meet(spark):
    kept = "sig string, phone string, host string, house string, direction string, street string, kind string, town string, zip string, lat double, lon double"
    one = ("rudim tola", "4155550134", None, "12", "", "tolavi", "ct", "sandwick", "99320")
    rows = [("p", f"r{i:02}", *one, 40.0 + i / 1e5, -120.0) for i in range(25)] + [("p", f"s{i:02}", *one, 40.0, -120.0) for i in range(25)]
    records = spark.createDataFrame(rows, f"provider string, record_id string, {kept}")
    entities = spark.createDataFrame([("e1", *one, 40.0, -120.0)], f"cluster string, {kept}")
    got = {r["record_id"]: r["cluster"] for r in P2.match_entities(records, entities).collect()}
    assert got == {r[1]: "e1" for r in rows}


# 3: survivors


def test_consensus_and_nearest():
    assert "".join(P3.consensus("canonical_website", ["tolavi.example", "tolai.example", "tolavie.example"], [0.4, 0.3, 0.3])) == "tolavi.example"
    assert P3.consensus("canonical_name", ["Ada Book Shop", "Ada Book", "Ada Books Shop"], [1, 1, 0.5])[:2] == ["Ada", "Book"]
    far = [P3.distance("canonical_website", v, list("tolavi.example")) for v in ("tolavi.example", "tolvai.example", "z" * 500, "z" * 501)]
    assert far == [0, 1, 500, 501]
    # A value with most of the weight is the consensus, whatever it is aligned with.
    rng = random.Random(3)
    for _ in range(200):
        values = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(5)]
        weights = [rng.random() for _ in values[1:]]
        assert "".join(P3.consensus("canonical_website", values, [sum(weights) * 1.01, *weights])) == values[0]


def test_profiles_keep_all_votes():
    values, weights = ["abcd", "abd", "xabc", "abcc", "bcd"], [1.0, 0.9, 0.8, 0.7, 0.6]
    rows = [(v, P3.profile_of("canonical_website", v, w), w) for v, w in zip(values, weights)]
    whole = P3.merged(P3.aligned(rows[:2]), 1.9, P3.aligned(rows[2:]), 2.1)
    assert all(sum(c.values()) == pytest.approx(4.0) for c in whole) and "".join(P3.winners(whole)) == "abcd"


@pytest.mark.parametrize("fan_in", [4, 1000])
def test_batches_change_no_survivor(spark, monkeypatch, fan_in):
    """Groups of many values without a majority, on both sides of the batch size."""
    monkeypatch.setattr(P3, "FAN_IN", fan_in)
    rng = random.Random(12)
    rows, want = [], {}
    for g in range(6):
        truth = "".join(rng.choice("abcdefgh") for _ in range(12)) + ".example"
        want[g] = truth
        rows.append((g, 1.0, truth))
        for _ in range(30):
            at = rng.randrange(12)
            rows.append((g, rng.uniform(0.2, 0.4), truth[:at] + rng.choice(["", "x", "yz"]) + truth[at + 1 :]))
    df = spark.createDataFrame(rows, "group_id long, weight double, canonical_website string")
    assert {r["group_id"]: r["survivor"] for r in P3.surviving_values(df, ["canonical_website"]).collect()} == want


def test_survivors(spark, monkeypatch):
    rows = [
        (1, 0.5, "https://www.Tolavi.example/x", "415-555-0134"), (1, 0.4, "tolavi.example", None), (1, 0.3, "old.example", "415 555 0134"), (1, 0.001, "no.example", "999-555-0000"),
        (2, 0.9, None, "n/a"), (3, 0.9, "http://", ""), (None, 0.9, "a.example", "4155550134"), (4, None, "a.example", None),
    ]
    df = spark.createDataFrame(rows, "group_id long, weight double, canonical_website string, canonical_phone string").withColumn("field", F.lit("clash")).withColumn("value", F.lit(1))
    got = {(r["group_id"], r["field"]): r["survivor"] for r in P3.surviving_values(df, ["canonical_website", "canonical_phone"]).collect()}
    assert got == {(1, "canonical_website"): "tolavi.example", (1, "canonical_phone"): "4155550134"}
    assert P3.surviving_values(df.limit(0), ["canonical_website", "canonical_phone"]).count() == 0
    monkeypatch.setattr(P3, "FAN_IN", 4)
    many = spark.createDataFrame([(1, 0.2 if i else 3.0, f"tolavi{'abcdefghij'[i]}.example", None) for i in range(10)] + [(1, 9.0, "tolavi.example", None)], "group_id long, weight double, canonical_website string, canonical_phone string")
    assert [r["survivor"] for r in P3.surviving_values(many, ["canonical_website"]).collect()] == ["tolavi.example"]


def test_a_lone_value_survives_at_any_trust(spark):
    at = datetime(2024, 1, 1)
    rows = [
        (1, 0.9, "official_website", datetime(2016, 1, 1), "old.example", "415-555-0134"), (2, 0.2, "ai_inference", at, "guess.example", None), (3, 0.0, "directory", None, "none.example", None),
        (4, 0.9, "official_website", at, "now.example", None), (4, 0.9, "official_website", datetime(2016, 1, 1), "old.example", None), (5, 0.9, "directory", at, "https://cityfinder.example/biz/x", "n/a"),
    ]
    df = spark.createDataFrame(rows, "group_id long, authority double, source_type string, retrieved_at timestamp, canonical_website string, canonical_phone string").withColumn("is_primary", F.lit(False))
    df = df.withColumn("weight", P3.source_weight(F.lit(at.timestamp())))
    got = {(r["group_id"], r["field"]): r["survivor"] for r in P3.surviving_values(df, ["canonical_website", "canonical_phone"]).collect()}
    site = {1: "old.example", 2: "guess.example", 3: "none.example", 4: "now.example"}
    assert got == {**{(g, "canonical_website"): v for g, v in site.items()}, (1, "canonical_phone"): "4155550134"}


def test_a_chain_keeps_its_website(spark):
    rows = [(g, 1.0, "https://chain.example/") for g in range(12)] + [(g, 1.0, f"https://cityfinder.example/biz/{g}") for g in range(20, 32)]
    df = spark.createDataFrame(rows, "group_id long, weight double, canonical_website string")
    assert {(r["group_id"], r["survivor"]) for r in P3.surviving_values(df, ["canonical_website"]).collect()} == {(g, "chain.example") for g in range(12)}


# 5: overlaps


def test_overlaps(spark):
    rng = random.Random(13)
    voc = ["".join(rng.choice("bdfgklmn") + rng.choice("aeiou") for _ in range(4)) for _ in range(4000)]
    text = lambda: [" ".join(rng.choice(voc) for _ in range(30)) for _ in range(2)]
    notice = "this page uses cookies and partners store small files here"
    rows, want = [], set()
    for i in range(60):
        t = text()
        rows.append((f"t{i:02}", "Train ", f"Tola{voc[i]} Books", [("web", x, None) for x in [*t, notice]]))
        if i < 12:
            words = [x.split() for x in t]
            if i % 3 == 1:
                words = words[::-1]
            if i % 3 == 2:
                for w in words:
                    for k in rng.sample(range(30), 3):
                        w[k] = rng.choice(voc)
            rows.append((f"e{i:02}", "holdout" if i % 2 else "validation", f"Tola{voc[i]} Books", [("web", " ".join(w).upper() + " .", None) for w in words]))
            want.add((f"t{i:02}", f"e{i:02}"))
        else:
            rows.append((f"e{i:02}", "holdout", f"Rudi{voc[i]} Books", [("web", x, None) for x in [*text(), notice]]))
    rows += [("z1", "holdout", None, None), ("z2", None, "x", [("web", "a b c", None)]), ("z3", "holdout", "x", [("web", None, None), ("web", notice, None)]), rows[0]]
    schema = "record string, split string, name string, evidence array<struct<source: string, text: string, url: string>>"
    got = {(r["train_record"], r["eval_record"]) for r in P5.cross_split_pairs(spark.createDataFrame(rows, schema).withColumn("band", F.lit(1))).collect()}
    assert got == want
    assert P5.cross_split_pairs(spark.createDataFrame([], schema)).count() == 0
    # Counts by class say the same as the pairs, with copies of records and one that stands on both sides.
    rows += [(f"{r}+{k}", *rest) for r, *rest in rows[:6] for k in range(3)] + [("t00", "holdout", *rows[0][2:])]
    df = spark.createDataFrame(rows, schema)
    pairs = P5.cross_split_pairs(df).collect()
    links = Counter((r["eval_record"], r["eval_split"]) for r in pairs)
    same = Counter((r["eval_record"], r["eval_split"]) for r in pairs if r["similarity"] == 1.0)
    counts = P5.overlap_counts(df).collect()
    assert {(r["record"], r["split"]): r["links"] for r in counts} == links and links
    assert all(r["same_text"] <= same.get((r["record"], r["split"]), 0) for r in counts)


def test_overlaps_are_all_pairs(spark):
    """Every pair a full comparison finds: also where all that a pair shares are the
    commonest word pairs, at similarities just above the limit, and in the shortest texts."""
    rng = random.Random(3)
    common = [f"w{i}" for i in range(30)]
    base = [[rng.choice(common) for _ in range(k)] for k in [1, 1, 2, 2, 3, 4, 6, *[20] * 10, *[40] * 10]]
    texts = [" ".join(common)] * 3
    for i in range(360):
        w = list(rng.choice(base))
        share = rng.choice([0, 0.1, 0.2, 0.3])
        texts.append(" ".join(f"u{i}x{k}" if rng.random() < share else rng.choice(common) if rng.random() < share else x for k, x in enumerate(w)))
    # Copies that share only the commonest word pairs, each with eight words of its own.
    for i in range(30):
        texts.append(" ".join([*common, *(f"o{i}x{k}" for k in range(8))]))
    texts = [t for t, n in Counter(texts).items() for _ in range(min(n, P5.NOTICE_LEAST - 1))]
    rows = [(f"r{i:03}", ("train", "holdout", "validation")[i % 3], f"Tola{i} Books", [("web", t, None)]) for i, t in enumerate(texts)]
    sets = {r: (split, P5.shingles([e[0][1]], 2)) for r, split, _, e in rows}
    held, tested = ([(r, x) for r, (split, x) in sets.items() if (split == "train") == side] for side in (True, False))
    want = {(a, b): len(x & y) / len(x | y) for a, x in held for b, y in tested}
    want = {pair: round(s, 6) for pair, s in want.items() if s >= P5.SIMILARITY}
    schema = "record string, split string, name string, evidence array<struct<source: string, text: string, url: string>>"
    got = {(r["train_record"], r["eval_record"]): r["similarity"] for r in P5.cross_split_pairs(spark.createDataFrame(rows, schema)).collect()}
    assert want.keys() - got.keys() == set() and got == want and len(want) > 300


def test_overlaps_meet_whatever_the_filter():
    """A full filter of rare shingles, tokens that collide and the share that makes one common change no pair."""
    rng = random.Random(5)
    texts = [[rng.randrange(40) for _ in range(rng.choice([2, 5, 30]))] for _ in range(40)]
    texts += [[rng.randrange(40) if rng.random() < 0.2 else x for x in t] for t in texts]
    sets = [np.array([hash((x, y)) % 97 for x, y in zip(t, t[1:])] or [0], dtype=np.int32) for t in texts]
    multi = [Counter(t.tolist()) for t in sets]
    want = {(i, j) for i in range(40) for j in range(40, 80) if (n := (multi[i] & multi[j]).total()) >= 0.42 * (len(sets[i]) + len(sets[j]) - n) and n}
    counts = Counter(x for t in multi for x in t)
    for least, full in ((0, True), (20, False), (20, True), (1000, True)):
        common = np.array(sorted((x for x, n in counts.items() if n >= least), key=lambda x: (counts[x], x)), dtype=np.int32)
        rare = np.full(16, ~np.uint64(0) if full else np.uint64(0))
        for x in counts:
            rare[x >> 6] |= np.uint64(1) << np.uint64(x & 63)
        meetings = P5.Meetings(0.42, common, rare)
        halves = [meetings.split(t) for t in sets]
        most = Counter()
        for t, (_, ranks) in zip(sets, halves):
            most[len(t)] = max(most[len(t)], len(ranks))
        sizes = np.array(sorted(most)), np.array([most[s] for s in sorted(most)])
        keys = [meetings.keys(len(t), *h, meetings.least_common(len(t), *sizes)) for t, h in zip(sets, halves)]
        for i, j in want:
            a, b = ({k: (int(r), int(t)) for k, r, t in sorted(zip(*x), key=lambda y: y[1:])} for x in (keys[i], keys[j]))
            bounds = [min(a[k][0], b[k][0]) + min(a[k][1], b[k][1]) for k in a.keys() & b.keys()]
            assert bounds and max(bounds) >= (multi[i] & multi[j]).total()


# 1: pairs


def test_field_learns_a_chain():
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(60):
        y = np.array([0, 1, 0, 1]) if rng.random() < 0.5 else np.array([1, 0, 1, 0])
        rows.append([[(int(k), 1.0)] if i < 2 else [(0, 0.5), (1, 0.5)] for i, k in enumerate(y)])  # only the neighbours tell
        labels.append(y)
    sure = [np.eye(2, dtype=bool)[y] for y in labels]
    for m in sure[::2]:
        m[3] = True  # left open
    crf = ChainCRF(2, 2).fit(rows, sure, steps=200)
    assert sum((crf.tag(x) == y).all() for x, y in zip(rows, labels)) == 60
    assert ChainCRF(2, 2).fit([], []).emit.sum() == 0


EN = "When Tola moved to Rudim in June, the tower cost 374 crowns and the bridge was free. Nobody in Vusak remembers who painted the wall."
CASES = [
    ("Who should read the page of Tola about the map?", EN, None), ("Who should read it?", "No.", None), ("Who should read it?", "Musehu & Nokli: the window", None), ("Who should read it?", None, "empty"),
    ("Who should read it?", " ​", "empty"), ("Who should read it?", "...", "empty"), ("Who should read it?", "{}", "empty"), ("Who should read it?", "I'm sorry, but I can't help with that request.", "refusal"),
    ("Fill name (JSON).\nText: Tola.", '{"error": "I must decline to comment on Tola."}', "refusal"), ("Fill name (JSON).\nText: Tola.", '{"name": "Tola", "phone": nu', "truncated"),
    ("Fill name (JSON).\nText: Tola.", '```json\n{"name": "Tola", "services": []}\n```', None), ("Who should read the page of Tola about the map?", "WHO SHOULD READ THE PAGE OF TOLA ABOUT THE MAP", "copy"),
    ("Who should read the page of Tola about the map?", "Who should read the page of Tola about the map?\n\n" + EN, None), ("Who should read the page of Tola about the map?", EN + " On Friday the team from Rud", "truncated"),
    ("Who should read the page of Tola about the map?", "Laut Tola schließt die Bibliothek im Mai, aber die Flasche bleibt für Rudim bis 10 Uhr offen.", "language"),
    ("Translate into German: According to Tola, the library will close in May.", "Laut Tola schließt die Bibliothek im Mai, und die Flasche ist offen.", None),
    ("Tola öffnete das Lied bei Rudim am Montag und bestellte die Uhr.\nWhy did Tola move the map to Rudim?", EN, None),
]


def test_defects(spark):
    rows = []
    for k in range(6):
        for i, (prompt, response, _) in enumerate(CASES):
            c = 100 * k + i
            rows += [(c, 0, "User", prompt, datetime(2024, 1, 1)), (c, 1, " Assistant", response, datetime(2024, 1, 1)), (c, 1, "assistant", response, datetime(2024, 1, 2))]
    rows += [(9000, 0, "user", "unanswered", None), (9001, 0, "assistant", "opens", None), (None, 1, "assistant", "x", None), (9002, 0, None, "x", None), (9003, 0, "user", "Why is it so long?", None), (9003, 1, "model", EN * 400, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, content string, ingested_at timestamp").withColumn("prompt", F.lit("clash"))
    got = {r["conv_id"]: r["defect"] for r in P1.defective_pairs(df).collect()}
    assert got == {100 * k + i: d for k in range(6) for i, (_, _, d) in enumerate(CASES) if d}
    assert P1.defective_pairs(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables here")
def test_refusals_are_found_without_their_phrase(spark):
    """The phrase that labels the commonest refusals is left out of the list."""
    rows = P1.answered(spark.read.parquet("/root/testdata/sf0.1/chat_message.parquet")).dropna().select("prompt", "response").distinct()
    languages, pairs = P1.learn_languages(rows), rows.toPandas()
    sample = list(pairs.sort_values(["prompt", "response"]).sample(4000, random_state=3).itertuples(index=False, name=None))
    for phrase in ("cannot assist", "am comfortable writing"):
        judge = P1.Judge(sample, languages, [x for x in P1.REFUSALS if x != phrase])
        left = [(p, r) for p, r in pairs.itertuples(index=False) if phrase in P1.fold(r) and not any(x in P1.fold(r) for x in P1.REFUSALS if x != phrase)]
        assert left and sum(judge.defect(p, r) == "refusal" for p, r in left) >= 0.9 * len(left)


def test_languages_are_learnt_from_all_pairs(spark):
    ids = [r["id"] for r in spark.range(1000).select("id", F.xxhash64("id", F.lit(1)).alias("h")).orderBy("h").collect()]
    pairs = [(i, p, r) for i, (p, r, _) in zip(ids, CASES * 6)]
    german = ("Warum ist der Zebrastreifen bei dem Gartenzaun?", "Der Zebrastreifen und die Fahrradkette sind bei dem Gartenzaun.")
    pairs += [(i, *german) for i in ids[-5:]] + [(ids[-6], "Who should read the page of Tola about the map?", "Zebrastreifen, Fahrradkette, Gartenzaun.")]
    rows = [(i, t, role, text, None) for i, p, r in pairs for t, role, text in ((0, "user", p), (1, "assistant", r))]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, content string, ingested_at timestamp")
    got = {r["conv_id"]: r["defect"] for r in P1.defective_pairs(df, train_pairs=60).collect()}
    assert got.get(ids[-6]) == "language" and not set(got) & set(ids[-5:])
