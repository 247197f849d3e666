"""Same postal address written differently.

Addresses are parsed to house number, direction, street, type, town and postal
code, and equal readings collapse to one form, however many rows hold it. A form
is a vector of character 3-grams of its street and, with less weight, its town,
weighted by inverse document frequency over all forms. Candidates
come from an inverted index over (house number, gram) that holds only the prefix
of each vector: its rarest grams, up to where the rest could not reach the cosine
threshold; hot postings are split. A candidate pair is verified by the cosine and
by the compatibility of house number, direction, type, town and postal code. Forms
that name no town meet all others in a second index of streets alone.

Pairs of forms that lack the same parts are closed to groups. A group whose type
or place is missing joins the complete place it fits, if there is just one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from amalgam.llm.normal import parse_address, same_slipped, within_one_edit
from amalgam.llm.p06_groups import connected_groups
from amalgam.operators.joins import chunked_join
from amalgam.runtime import cut, load, scratched

#: Thresholds of the cosine of streets with towns and of streets alone, and the weight of a town's grams.
COSINE, STREET_COSINE, TOWN_WEIGHT = 0.5, 0.4, 0.7
#: Share of forms added to a gram's, so that the grams of a slip outweigh no others.
SMOOTHING = 1 / 20
_FORM = ["house", "direction", "street", "kind", "town", "zip"]


def with_place(df: DataFrame, address: str) -> DataFrame:
    """Adds ``place``: the parsed address as a struct of six strings, or null."""

    @F.pandas_udf("struct<house string, direction string, street string, kind string, town string, zip string>")
    def parse(part: pd.Series) -> pd.DataFrame:
        rows = [parse_address(a) for a in part]
        return pd.DataFrame([tuple(r) if r else (None,) * 6 for r in rows], columns=_FORM)

    return df.withColumn("place", parse(F.col(address)))


def grams(street: str, town: str = "") -> dict[str, float]:
    """3-grams of street and town, kept apart by a mark, with their field's weight."""
    out: dict[str, float] = {}
    for mark, text, weight in (("s", f" {street} ", 1.0), ("t", f" {town} ", TOWN_WEIGHT)):
        for i in range(len(text) - 2):
            out[mark + text[i : i + 3]] = weight
    return out


class Weights:
    """Inverse document frequencies of grams."""

    def __init__(self, counts: dict[str, int], n: int):
        self.rarest = math.log(1 + 1 / SMOOTHING)
        self.idf = {g: math.log(1 + 1 / (c / n + SMOOTHING)) for g, c in counts.items()}

    def vector(self, *parts: str) -> dict[str, float]:
        raw = {g: w * self.idf.get(g, self.rarest) for g, w in grams(*parts).items()}
        norm = math.sqrt(sum(w * w for w in raw.values())) or 1.0
        return {g: w / norm for g, w in raw.items()}


def cosine(u: dict[str, float], v: dict[str, float]) -> float:
    return sum(w * v.get(g, 0.0) for g, w in u.items())


def prefix(vec: dict[str, float], threshold: float) -> list[str]:
    """The heaviest grams, until the norm of the rest is below the threshold:
    by Cauchy-Schwarz the rest alone can't reach the cosine."""
    rest, out = 1.0, []
    for g, w in sorted(vec.items(), key=lambda x: (-x[1], x[0])):
        if rest < threshold * threshold - 1e-12:
            break
        out.append(g)
        rest -= w * w
    return out


def compatible(a: tuple, b: tuple) -> bool:
    """Whether two forms (house, direction, street, kind, town, zip) can be one place."""
    if a[0] != b[0] or a[1] != b[1] or (a[3] and b[3] and a[3] != b[3]) or not same_slipped(a[2], b[2]):
        return False
    if a[4] and b[4]:
        if same_slipped(a[4], b[4]):
            return not (a[5] and b[5]) or a[5] == b[5] or within_one_edit(a[5], b[5])
        return bool(a[5]) and a[5] == b[5] and edit_close(a[4], b[4])
    if a[5] and b[5]:
        return a[5] == b[5]
    return True


def edit_close(a: str, b: str) -> bool:
    """Towns at one postal code that overlap by prefix or share most letters."""
    shared = len(set(a) & set(b)) / max(1, len(set(a) | set(b)))
    return a.startswith(b) or b.startswith(a) or shared >= 0.6


def _complete(p: str) -> F.Column:
    return (F.col(f"{p}kind") != "") & ((F.col(f"{p}town") != "") | (F.col(f"{p}zip") != ""))


def place_pairs(forms: DataFrame, threshold: float = COSINE, street_threshold: float = STREET_COSINE) -> DataFrame:
    """Verified pairs (form_a, form_b, similarity) of the distinct forms."""
    n = forms.count()

    def gram_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"gram": [g for s, t in zip(pdf["street"], pdf["town"]) for g in grams(s, t)]})

    # At most two marks times 40^3 grams of folded letters, whatever the input: small enough to send to all.
    counted = forms.select("street", "town").mapInPandas(gram_rows, "gram string").groupBy("gram").count().collect()
    shared = forms.sparkSession.sparkContext.broadcast(Weights({r["gram"]: r["count"] for r in counted}, n))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = shared.value
        for pdf in batches:
            rows = []
            for form, house, street, town in pdf[["form", "house", "street", "town"]].itertuples(index=False):
                if town:
                    rows += [(house, g, form, True) for g in prefix(weights.vector(street, town), threshold)]
                rows += [(house, "o" + g, form, bool(town)) for g in prefix(weights.vector(street), street_threshold)]
            yield pd.DataFrame(rows, columns=["house", "gram", "form", "in_town"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = shared.value
        for pdf in batches:
            rows = []
            for x, y in zip(pdf["form_a"], pdf["form_b"]):
                a, b = tuple(x.split("|")), tuple(y.split("|"))
                if not compatible(a, b):
                    continue
                both = a[4] and b[4]
                alike = cosine(weights.vector(a[2], a[4]), weights.vector(b[2], b[4])) if both else cosine(weights.vector(a[2]), weights.vector(b[2]))
                if alike >= (threshold if both else street_threshold):
                    rows.append((x, y, alike))
            yield pd.DataFrame(rows, columns=["form_a", "form_b", "similarity"])

    entries = cut(forms.select("form", "house", "street", "town").mapInPandas(index, "house string, gram string, form string, in_town boolean"))
    alone = F.col("gram").startswith("o")
    side = lambda df, name: df.select("house", "gram", F.col("form").alias(name))
    whole = entries.filter(~alone)
    near = chunked_join(side(whole, "form_a"), side(whole, "form_b"), ["house", "gram"], "form_a", "form_b").filter(F.col("form_a") < F.col("form_b"))
    # Forms without a town against all.
    streets = entries.filter(alone)
    loose = (
        chunked_join(side(streets.filter("NOT in_town"), "form_a"), side(streets, "form_b"), ["house", "gram"], "form_a", "form_b")
        .filter("form_a <> form_b")
        .select(F.least("form_a", "form_b").alias("form_a"), F.greatest("form_a", "form_b").alias("form_b"))
    )
    return near.select("form_a", "form_b").unionByName(loose).distinct().mapInPandas(verify, "form_a string, form_b string, similarity double")


@scratched
def same_places(rows: DataFrame, record: str, address: str, threshold: float = COSINE) -> DataFrame:
    """One row (record, place_id) per record whose address names a house.

    Records with equal place_id stand at the same place; place_id is an address
    form. Rows with null or placeholder addresses, or without a house number and
    street, have no place; a record with several addresses has several rows;
    repeated rows and other columns change nothing; an empty table gives none.
    Two readings that lack different parts are one place only through a complete one.
    """
    placed = cut(
        with_place(rows.select(F.col(record).alias("record"), F.col(address).alias("address")).dropna().distinct(), "address")
        .filter((F.col("place.house") != "") & (F.col("place.street") != ""))
        .select("record", "place.*", F.concat_ws("|", *[f"place.{c}" for c in _FORM]).alias("form"))
        .distinct()
    )
    forms = cut(placed.select(*_FORM, "form").distinct())
    pairs = cut(place_pairs(forms, threshold))
    parts = lambda c, p: [F.split(c, r"\|")[i].alias(p + n) for i, n in enumerate(_FORM)]
    has = lambda p: (F.col(f"{p}kind") != "", (F.col(f"{p}town") != "") | (F.col(f"{p}zip") != ""))
    marked = pairs.select("form_a", "form_b", *parts("form_a", "a_"), *parts("form_b", "b_"))
    (kind_a, town_a), (kind_b, town_b) = has("a_"), has("b_")
    groups = connected_groups(marked.filter((kind_a == kind_b) & (town_a == town_b)), "form_a", "form_b")
    grouped = cut(forms.join(groups, F.col("form") == F.col("member"), "left").select("form", F.coalesce("group_key", "form").alias("group"), (has("")[0] & has("")[1]).alias("whole")))
    # What a form that lacks a part fits: one place, or none, or several.
    fits = (
        marked.filter((kind_a & town_a) != (kind_b & town_b))
        .select(
            F.when(kind_a & town_a, F.col("form_b")).otherwise(F.col("form_a")).alias("form"),
            F.when(kind_a & town_a, F.col("form_a")).otherwise(F.col("form_b")).alias("known"),
        )
        .join(grouped.filter("whole").select(F.col("form").alias("known"), "group"), "known")
        .groupBy("form").agg(F.min("group").alias("low"), F.max("group").alias("high"))
        .filter("low = high").select("form", F.col("low").alias("place"))
    )
    fitted = cut(grouped.filter("NOT whole").join(fits, "form", "left"))
    # The rest of a group follows those of its forms that fit one place, if they agree on it.
    agreed = fitted.groupBy("group").agg(F.min("place").alias("low"), F.max("place").alias("high")).filter("low = high").select("group", F.col("low").alias("agreed"))
    rest = fitted.join(agreed, "group", "left").select("form", F.coalesce("place", "agreed", "group").alias("place_id"))
    places = grouped.filter("whole").select("form", F.col("group").alias("place_id")).unionAll(rest)
    return placed.select("record", "form").join(places, "form").select("record", "place_id").distinct()


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    business = load(spark, sf_dir, "business_entity").select(F.col("entity_id").alias("record"), F.col("canonical_address").alias("address"))
    examples = load(spark, sf_dir, "dataset_example").select(F.col("example_id").alias("record"), "address")
    return business.unionAll(examples)


def p7_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its place."""
    return same_places(_rows(spark, sf_dir), "record", "address")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = p7_places(spark, sf_dir)
    side = lambda name: places.select("place_id", F.col("record").alias(name))
    return (
        chunked_join(side("record_a"), side("record_b"), ["place_id"], "record_a", "record_b")
        .filter(F.col("record_a") < F.col("record_b"))
        .select("record_a", "record_b")
        .distinct()
    )


QUERIES = {"p7_found": p7_found, "p7_places": p7_places}
SQL: dict[str, str] = {}
