import json
import os

import pytest

from amalgam.plans import registry
from tests.oracle import assert_same, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    assert_same(registry.QUERIES[name](spark, FOLDER), duck.sql(registry.SQL[name]))


def test_queries_without_sql_are_tested_below():
    assert set(registry.QUERIES) - set(registry.SQL) == {"x01_x05_page_records", "x14_recovered_json", "f18_f19_schema_errors"}


def test_page_records_hold_what_their_pages_say(spark):
    want = {r["entity_id"]: r for r in spark.read.parquet(f"{FOLDER}/business_entity.parquet").collect()}
    got = registry.QUERIES["x01_x05_page_records"](spark, FOLDER).collect()
    assert len(got) == len(want)
    flat = lambda t: " ".join(t.split()) if t and t.strip() else None
    for r in got:
        row = want[r["entity_id"]]
        assert flat(r["name"]) == flat(row["canonical_name"]) and flat(r["phone"]) == flat(row["canonical_phone"])
        assert r["latitude"] == row["canonical_latitude"] and r["longitude"] == row["canonical_longitude"]


def _plain_json(text):
    body = text.strip()
    if body.startswith("```"):
        body = body.split("\n", 1)[-1].removesuffix("```")
    try:
        value = json.loads(body)
        return value if isinstance(value, (dict, list)) else None
    except ValueError:
        return None


def test_json_is_recovered_from_answers(spark):
    rows = spark.read.parquet(f"{FOLDER}/chat_message.parquet").collect()
    said = {(r["conv_id"], r["turn"], r["content"]) for r in rows if r["role"].strip().lower() in ("assistant", "model") and r["content"] is not None}
    got = {}
    for r in registry.QUERIES["x14_recovered_json"](spark, FOLDER).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append(json.loads(r["json"]))
    seen = 0
    for conv, turn, text in said:
        if (value := _plain_json(text)) is not None:
            assert value in got[conv, turn]
            seen += 1
        elif "{" not in text and "[" not in text:
            assert not any(t == text for t in got.get((conv, turn), []))
    assert seen > 20 and len(got) >= seen


def test_schema_errors_of_answers(spark):
    """Counts by a second validator, written for this schema only."""

    def sound(v):
        if not isinstance(v, dict) or set(v) != {"name", "phone", "address", "category", "services"}:
            return False
        texts = all(v[k] is None or isinstance(v[k], str) for k in ("phone", "address", "category"))
        return isinstance(v["name"], str) and v["name"] and texts and isinstance(v["services"], list) and all(isinstance(x, str) for x in v["services"])

    values = [json.loads(r["json"]) for r in registry.QUERIES["x14_recovered_json"](spark, FOLDER).collect()]
    got = {r["error"]: r["n"] for r in registry.QUERIES["f18_f19_schema_errors"](spark, FOLDER).collect()}
    assert sum(got.values()) == len(values) and got.get("ok", 0) == sum(map(bool, map(sound, values))) > 0
