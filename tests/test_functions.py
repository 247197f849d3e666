import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from amalgam.functions import compat as C, extract as X, geo as G, hours as H, jsonx as J, text as T
from amalgam.operators import validate as V


def values(spark, rows, *exprs, schema="x string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [tuple(r) for r in df.select(*[e.alias(f"c{i}") for i, e in enumerate(exprs)]).collect()]


def test_rounding_goes_up_at_half(spark):
    got = values(spark, [(0.125,), (-0.125,), (2.5,), (None,)], C.js_round(F.col("x"), 2), C.js_round(F.col("x")), schema="x double")
    assert got == [(0.13, 0.0), (-0.12, 0.0), (2.5, 3.0), (None, None)]


def test_blanks_include_wide_ones(spark):
    assert values(spark, ["  a　b ﻿", "", None], C.collapse_blank(F.col("x"))) == [("a b",), ("",), (None,)]


@pytest.mark.parametrize(
    "raw, country, want",
    [
        ("+1 (415) 555-0134", None, "+14155550134"), ("415-555-0134", "US", "+14155550134"), ("415-555-0134", None, None), ("1 415 555 0134", None, "+14155550134"),
        ("0044 20 7946 0958", None, "+442079460958"), ("98765 43210", "India", "+919876543210"), ("020 7946 0958", "uk", "+442079460958"), ("123", "US", None), ("", "US", None), (None, "US", None),
    ],
)
def test_phones_never_invent_a_country(spark, raw, country, want):
    got = values(spark, [(raw, country)], T.normalize_phone(F.col("x"), F.col("y")), schema="x string, y string")
    assert got == [(want,)]


def test_url_keys(spark):
    rows = ["HTTPS://WWW.Shop.example/a/?utm_source=x&b=2&A=1&ref=y#top", "https://shop.example", "https://www.google.com/maps/place/X/", "not a url", "http://a.example/?b=2&b=1"]
    got = [r[0] for r in values(spark, rows, T.normalize_url(F.col("x")))]
    assert got == ["https://shop.example/a?a=1&b=2", "https://shop.example/", "https://maps.google.com/maps/place/X", "not a url", "http://a.example/?b=1&b=2"]
    assert [r[0] for r in values(spark, got, T.normalize_url(F.col("x")))] == got  # a second pass changes nothing


def test_websites_and_domains(spark):
    got = values(spark, ["Shop.example", "HTTP://WWW.A.example/x#y", "ftp://a.example", "", None], T.normalize_website(F.col("x")), T.normalize_domain(F.col("x")))
    assert got[0] == ("https://shop.example/", "shop.example") and got[1] == ("http://www.a.example/x", "a.example")
    assert got[3] == (None, None) and got[4] == (None, None)


def test_names(spark):
    got = values(spark, ["Sun Store Pvt. Ltd. - Best Market", "Ada Co. Inc.", "O'Brien & Söhne", "!!"], T.search_name(F.col("x")), T.slug(F.col("x")))
    assert [r[0] for r in got[:2]] == ["Sun Store", "Ada"]
    assert got[2][1] == "obrien-s-hne" and got[3][1] == "business"


def test_fuzzy_similarity(spark):
    got = values(spark, [("Cafe Uno", "cafe uno"), ("Cafe Uno", "Cafe"), ("abc", "xyz"), ("", "a"), (None, "a")], T.fuzzy_similarity(F.col("x"), F.col("y")), schema="x string, y string")
    assert [r[0] for r in got] == [1.0, pytest.approx(0.9), 0.0, 0.0, 0.0]


def test_first_match_only(spark):
    assert values(spark, ["call a@b.example or c@d.example"], T.remove_first(F.col("x"), r"[^\s@]+@[^\s@]+")) == [("call or c@d.example",)]


def test_secrets_go(spark):
    got = values(spark, ["Authorization: Bearer abc.def api_key='xyz' sk-abcdefgh12"], T.redact_secrets(F.col("x")))[0][0]
    assert "abc.def" not in got and "xyz" not in got and "sk-abc" not in got


def test_pair_key_has_no_direction(spark):
    got = values(spark, [("a", "b"), ("b", "a")], T.pair_key(F.col("x"), F.col("y"), F.lit("k")), schema="x string, y string")
    assert got[0] == got[1] == ("pair|a|b|k",)


def test_equivalence(spark):
    rows = [("contact.phone", "+1 415 555 0134", "4155550134", True), ("business.name", " Ada ", "ada", True), ("business.name", None, "ada", False), ("business.name", None, None, True)]
    got = values(spark, rows, T.values_equivalent(F.col("p"), F.col("a"), F.col("b")), schema="p string, a string, b string, w boolean")
    assert [r[0] for r in got] == [r[3] for r in rows]


def test_distances(spark):
    got = values(spark, [(0.0, 0.0, 0.0, 1.0), (50.0, 8.0, 50.0, 8.0)], G.haversine(*[F.col(c) for c in "abcd"]), schema="a double, b double, c double, d double")
    assert got[0][0] == pytest.approx(111194.9, abs=0.1) and got[1][0] == 0
    pos = values(spark, ["1.5,2.5", "[2.5, 1.5]", "95,0", "x", None], G.parse_position(F.col("x")))
    assert [tuple(p[0]) if p[0] else None for p in pos] == [(1.5, 2.5), (1.5, 2.5), None, None, None]


def test_hours(spark):
    rows = ["Mo-Fr 08:00-17:00, Sa 09:00 - 12:00", "Sa-Mo 10:00-11:00", "Su closed", "nothing", None]
    got = [r[0] for r in values(spark, rows, H.hours_map(F.col("x")))]
    assert got[0]["monday"] == "08:00-17:00" and got[0]["saturday"] == "09:00-12:00" and "sunday" not in got[0]
    assert set(got[1]) == {"saturday", "sunday", "monday"} and got[2] == {"sunday": "closed"} and got[3] is None and got[4] is None


def test_emails_websites_streets(spark):
    assert values(spark, ["info@shop.example.org", "test@shop.org", "a@example.com", "a..b@c.org", None], V.valid_email(F.col("x"))) == [(True,), (False,), (False,), (False,), (False,)]
    got = values(spark, ["fedex.com", "shop.org", "m.facebook.com/x", "", None], V.website_status(F.col("x")))
    assert [r[0] for r in got] == ["rejected_directory", "valid", "rejected_directory", "missing", "missing"]
    assert [r[0] for r in values(spark, ["5 Main St", "Main Street 5", "Ada Books", None], V.street_like(F.col("x")))] == [True, True, False, False]


def test_private_urls_are_blocked(spark):
    got = values(spark, ["https://shop.org/x", "http://shop.org", "https://localhost/", "https://10.1.2.3/", "https://172.20.0.1", "https://[::1]/", None], V.blocked_url(F.col("x")))
    assert [r[0] for r in got] == [False, True, True, True, True, True, True]


PAGE = """<html><head><script type="application/ld+json">{"name": "Ada Books", "telephone": "415", "geo": {"latitude": 1.5, "longitude": 2}}</script>
<script type="application/ld+json">{bad</script><meta property="og:title" content="Old"><meta property="og:title" content="New"><style>x</style></head>
<body><!-- c --><b itemprop="name">First</b><b itemprop="name">Second</b> Text</body></html>"""


def test_pages(spark):
    record, og, item, text = values(spark, [PAGE], X.page_record(F.col("x")), X.open_graph(F.col("x")), X.microdata(F.col("x")), X.visible_text(F.col("x")))[0]
    assert record["name"] == "Ada Books" and record["phone"] == "415" and record["latitude"] == 1.5
    assert og == {"title": "New"} and item == {"name": "First"} and text == "First Second Text"


def test_map_links(spark):
    rows = ["https://www.google.com/maps/place/Ada+Books/@1.5,2.5,17z/data=!1s0x1:0xff", "https://maps.google.com/?cid=42", "https://maps.app.goo.gl/x", "https://www.google.com/maps/search/book+shop"]
    got = [r[0] for r in values(spark, rows, X.maps_link(F.col("x")))]
    assert got[0]["kind"] == "place" and got[0]["name"] == "Ada Books" and got[0]["cid"] == "255" and got[0]["lat"] == 1.5 and got[0]["zoom"] == 17
    assert got[1]["kind"] == "cid" and got[1]["cid"] == "42" and got[2]["kind"] == "short" and got[3]["query"] == "book shop"


def test_errors(spark):
    got = values(spark, [(429, None), (404, ""), (None, "connect timeout"), (None, None)], X.error_class(F.col("a"), F.col("b")), schema="a int, b string")
    assert [(r[0]["kind"], r[0]["retryable"]) for r in got] == [("RATE_LIMITED", True), ("NOT_FOUND", False), ("TIMEOUT", True), ("UNKNOWN_ERROR", False)]


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=8))
@settings(max_examples=60, deadline=None)
def test_json_is_recovered_from_talk(value):
    import json

    text = "Sure! " + json.dumps({"v": value}) + " Hope it helps."
    assert json.loads(J.recover(text)) == {"v": value}


def test_json_repairs_and_schema():
    assert J.recover('```json\n{"a": [1, 2,],}\n```') == '{"a":[1,2]}'
    assert J.recover("none here") is None and J.recover(None) is None
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": ["integer", "null"], "minimum": 0}}, "additionalProperties": False}
    assert J.schema_error({"a": 1}, schema) is None and J.schema_error({"a": None}, schema) is None
    assert J.schema_error({"a": -1}, schema) == "$.a: range" and J.schema_error({}, schema) == "$.a: required" and J.schema_error({"a": 1, "b": 2}, schema) == "$.b: unknown"
    assert J.semantic_error({"x": [{"confidence": 1.5}]}) == "$.x.0.confidence: range"


# pages and reviews


def test_map_pages(spark):
    page = "![x](https://a.example/y.png)\nSave, Directions, 12 Main,   Old Town, Rudim, West State 123456, India\n(tel:+1 (415) 555-0134), rated 4.5 Bakery Monday 9 AM–5 PM"
    rows = values(spark, [page, "nothing here", "pin 560001 5.9 Directions +44 2079460958", "", None], X.map_page_fields(F.col("x")))
    full = rows[0][0]
    assert (full["city"], full["state"], full["postal_code"], full["country"], full["category"], full["rating"]) == ("Rudim", "West State", "123456", "India", "Bakery", 4.5)
    assert full["address"] == "12 Main, Old Town, Rudim, West State 123456, India" and full["phone"] == "+14155550134" and full["hours"] == {"monday": "9 AM-5 PM"}
    assert all(v in (None, {}) for v in rows[1][0]) and all(v in (None, {}) for v in rows[3][0]) and all(v in (None, {}) for v in rows[4][0])
    assert (rows[2][0]["postal_code"], rows[2][0]["rating"], rows[2][0]["phone"]) == ("560001", None, "+442079460958")


def test_raw_pages(spark):
    html = '<p>98765 43210</p><p>Main Road, Rudim, Bay, India 560001</p>"ratingValue": "4.3" with 1,234 reviews'
    rows = values(spark, [html, "", None], X.raw_page_fields(F.col("x")))
    got = rows[0][0]
    assert (got["phone"], got["city"], got["state"], got["postal_code"], got["rating"], got["review_count"]) == ("98765 43210", "Rudim", "Bay", "560001", 4.3, 1234)
    assert all(v is None for v in rows[1][0]) and all(v is None for v in rows[2][0])


def test_reviews_that_say_nothing_are_dropped(spark):
    schema = "x array<struct<rating: double, text: string, author: string, author_name: string, published_at: string, relative_time: string, publish_time: string, confidence: double>>"
    reviews = [(4.25, " fine ", " ", "Ada", None, " ", "2024", 7.0), (9.0, " ", None, None, None, None, None, None), (None, None, "Bo", None, None, None, None, None)]
    (kept,) = values(spark, [(reviews,)], X.clean_reviews(F.col("x")), schema=schema)[0]
    assert [tuple(r) for r in kept] == [(4.3, "fine", "Ada", "2024", 1.0), (None, None, "Bo", None, 0.5)]


def test_hours_values(spark):
    got = values(spark, ["Closed", " OFF ", "day off", "none", "09:00 - 17:00", "", "[object Object]", None], H.hours_value(F.col("x")))
    assert [g[0] for g in got] == ["closed", "closed", "closed", "none", "09:00 - 17:00", None, None, None]
    rows = values(spark, [(["09:00-12:00", " ", "13:00-17:00 "],), ([],), (None,)], H.hours_list(F.col("x")), schema="x array<string>")
    assert [r[0] for r in rows] == ["09:00-12:00, 13:00-17:00", None, None]
    rows = values(spark, [("9", "17"), ("9", None), ("", "17"), (None, None)], H.interval(F.col("a"), F.col("b")), schema="a string, b string")
    assert [r[0] for r in rows] == ["9-17", "9", None, None]


def test_conflicts_of_records(spark):
    fields = ["city", "state", "postal_code", "latitude", "longitude", "provider_record_id", "phone"]
    schema = ", ".join(f"{p}_{f} {'double' if f in ('latitude', 'longitude') else 'string'}" for p in "ab" for f in fields)
    a = ("Town", "NV", "1", 10.0, 10.0, "p1", "415-555-0134")
    rows = [a + a, a + ("town ", "CA", "2", 10.2, 10.3, "p2", "4155550135"), a + (None, "", None, None, None, None, "555"), (None,) * 14, a + (*a[:3], 95.0, 10.0, *a[5:])]
    got = values(spark, rows, V.record_conflicts("a_", "b_"), schema=schema)
    assert [g[0] for g in got] == [[], ["state", "postalCode", "coordinates", "providerId", "phone"], [], [], []]
