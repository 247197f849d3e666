"""Same or near-same records across splits.

Evidence is read item by item; items that the pages of many businesses carry
(notices) are set aside. Records with the same items in any order form one class.
Every pair of a training and an evaluation class whose word pairs have a Jaccard
similarity of 0.42 or more (three quarters of kept words bring about that) is
found: candidates leave out only pairs that can't reach it.

A pair of sizes m and n must share s / (1 + s) * (m + n) word pairs. Word pairs
that stand in one split only are shared by none. The others are put in one order,
the rarest first. If a pair of classes shares a rare one, it meets at the first of
them; if not, all it shares is common, and it meets at the first two of the common
ones, which stand among the few that either class can spare. Where classes meet,
what is left behind the place of meeting and a bit mask of the common word pairs
bound what they can share; the rest is verified on the words. Hot places are split.
Copies never make pairs: what is counted, is counted by class.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from amalgam.llm.normal import fold, name_tokens
from amalgam.operators.joins import chunked_join
from amalgam.runtime import cut, load, scratched

SHINGLE, SIMILARITY = 2, 0.42
#: A notice or common shingle is carried by at least this share of businesses or texts, and by this many.
COMMON_SHARE, NOTICE_LEAST, WORD_LEAST = 0.002, 4, 20
#: Bits of the filter of rare shingles, at most (16 MB); a full one lets more through and loses none.
_FILTER_BITS = 27
#: Meetings written at once: bounds a batch whatever the texts.
_WRITTEN = 200_000


def words(text: str | None) -> list[str]:
    return re.findall(r"\w+", fold(text)) if text else []


def shingles(items: list[str], size: int) -> set[str]:
    """Word shingles within each item; an item of fewer words is one shingle."""
    out = set()
    for item in items:
        w = item.split(" ")
        out.update(" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))
    return out


def least_shared(similarity: float, size: int, other: np.ndarray | int) -> np.ndarray | int:
    """Shingles that sets of these sizes share at least at this Jaccard similarity."""
    return np.maximum(1, np.ceil(similarity / (1 + similarity) * (size + other) - 1e-9)).astype(np.int64)


class Meetings:
    """The keys at which a text meets the others, with bounds on what they share.

    ``common`` are the tokens of common shingles, the rarest first; ``rare`` has a
    bit for every token (modulo its length) that is rare and stands in both splits.
    Any order and any tokens give the same pairs: they decide the cost alone.
    """

    def __init__(self, similarity: float, common: np.ndarray, rare: np.ndarray):
        self.similarity, self.rare = similarity, rare
        self.order = np.argsort(common, kind="stable").astype(np.int64)
        self.common = common[self.order]

    def split(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rare tokens of both splits and the ranks of the common ones, ascending."""
        at = np.minimum(np.searchsorted(self.common, tokens), max(0, len(self.common) - 1))
        known = self.common[at] == tokens if len(self.common) else np.zeros(len(tokens), dtype=bool)
        low = tokens[~known].astype(np.int64) & (len(self.rare) * 64 - 1)
        both = (self.rare[low >> 6] >> (low & 63).astype(np.uint64)) & np.uint64(1) == 1
        return np.sort(tokens[~known][both]).astype(np.int64), np.sort(self.order[at[known]])

    def least_common(self, size: int, sizes: np.ndarray, most: np.ndarray) -> int | None:
        """Common shingles that a text of this size shares at least with one with which it
        shares no rare one; ``most`` is the greatest number of them in a text of each of ``sizes``."""
        needs = least_shared(self.similarity, size, sizes)
        needs = needs[most >= needs]
        return int(needs.min()) if len(needs) else None

    def keys(self, size: int, rare: np.ndarray, ranks: np.ndarray, least: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, rest, tail): of the rare shingles at most rest and of the common ones at
        most tail are shared with a text first met at the key."""
        n, c = len(rare), len(ranks)
        # No partner shares less than it would at the least size that can be similar.
        single = max(0, min(n, n + c - math.ceil(self.similarity * size - 1e-9) + 1))
        key, rest, tail = [rare[:single]], [n - np.arange(single)], [np.full(single, c)]
        if least is not None and (window := c - least + 2) >= 2:
            window = min(window, c)
            i, j = np.triu_indices(window, 1)
            key.append(((ranks[i] + 1) << 32) | ranks[j])
            rest.append(np.zeros(len(i), dtype=np.int64))
            tail.append(c - j + 1)
        if least_shared(self.similarity, size, 1) == 1:  # one shared shingle may do
            key.append(-(1 << 32) - ranks)
            rest.append(np.zeros(c, dtype=np.int64))
            tail.append(c - np.arange(c))
        return np.concatenate(key), np.concatenate(rest), np.concatenate(tail)


def mask(ranks: np.ndarray) -> np.ndarray:
    """128 bits, as two longs, of which every rank sets one."""
    bits = np.zeros(128, dtype=np.uint8)
    bits[ranks % 128] = 1
    return np.packbits(bits).view(np.int64)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for record, split, name, evidence in pdf[["record", "split", "name", "evidence"]].itertuples(index=False):
            items = [" ".join(w) for e in (evidence if evidence is not None else []) if e is not None and (w := words(e["text"]))]
            rows.append((record, split, " ".join(name_tokens(name) or ()), items))
        yield pd.DataFrame(rows, columns=["record", "split", "business", "items"])


@scratched
def overlapping_classes(rows: DataFrame, train: str = "train", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members is (record, split, class), one row per record and
    split with content; pairs is (a, b, similarity), every class a of training
    records with every class b of evaluation records it overlaps, itself included.

    ``rows`` has record, split, name and evidence (array of structs with text).
    Splits are compared without case and blanks; rows with null record or split,
    and records without content beside notices, overlap with nothing; a record
    delivered several times holds the items of all its deliveries; an empty table
    gives none.
    """
    side = F.lower(F.trim(F.col("split")))
    read = cut(
        rows.select("record", side.alias("split"), "name", "evidence")
        .filter("record IS NOT NULL AND split IS NOT NULL AND split <> ''")
        .mapInPandas(_read, "record string, split string, business string, items array<string>")
    )
    businesses = read.select("business").distinct().count()
    # Items travel as hashes until their notices are out.
    carried = read.select("business", F.explode(F.transform("items", lambda x: F.xxhash64(x))).alias("item")).distinct()
    notices = carried.groupBy("item").count().filter(F.col("count") >= max(NOTICE_LEAST, COMMON_SHARE * businesses)).select("item")
    content = (
        read.select("record", "split", F.explode("items").alias("text"))
        .withColumn("item", F.xxhash64("text"))
        # Bounded: each notice takes COMMON_SHARE of the businesses, so there are at most (items a business) / COMMON_SHARE.
        .join(F.broadcast(notices), "item", "left_anti")
        .groupBy("record", "split")
        .agg(F.array_sort(F.collect_set("text")).alias("items"))
    )
    kept = cut(content.withColumn("key", F.sha2(F.array_join("items", "\n"), 256)))
    classes = cut(
        kept.groupBy("key").agg(F.first("items").alias("items"), F.max(F.col("split") == train).alias("in_train"), F.max(F.col("split") != train).alias("in_eval"))
        .withColumn("class", F.monotonically_increasing_id())
    )
    members = kept.select("record", "split", "key").join(classes.select("key", "class"), "key").select("record", "split", "class")
    n = classes.count()

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tokens = [np.fromiter((xxhash.xxh32_intdigest(s) for s in shingles(list(x), SHINGLE)), dtype=np.uint32).view(np.int32) for x in pdf["items"]]
            yield pdf[["class", "in_train", "in_eval"]].assign(tokens=tokens)

    texts = cut(classes.select("class", "in_train", "in_eval", "items").mapInPandas(hashed, "class long, in_train boolean, in_eval boolean, tokens array<int>"))
    both = cut(
        texts.select("in_train", "in_eval", F.explode("tokens").alias("token"))
        .groupBy("token").agg(F.count("*").alias("n"), F.max("in_train").alias("in_train"), F.max("in_eval").alias("in_eval"))
        .filter("in_train AND in_eval").select("token", "n")
    )
    # Shingles carried by a fixed share of texts are at most (shingles a text) / share, whatever the number of texts.
    often = F.col("n") >= max(WORD_LEAST, COMMON_SHARE * n)
    common = both.filter(often).toPandas().sort_values(["n", "token"])["token"].to_numpy(dtype=np.int32)
    bits = min(_FILTER_BITS, max(10, (32 * both.filter(~often).count()).bit_length()))
    rare = np.zeros((1 << bits) // 64, dtype=np.uint64)
    low = F.col("token").bitwiseAND((1 << bits) - 1)
    words_of = both.filter(~often).groupBy(F.shiftright(low, 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, token & 63))").alias("set")).toPandas()
    rare[words_of["word"].to_numpy(dtype=np.int64)] = words_of["set"].to_numpy(dtype=np.int64).view(np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast(Meetings(similarity, common, rare))

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                found = pd.DataFrame([(len(x), len(shared.value.split(x)[1])) for x in pdf["tokens"]], columns=["size", "most"])
                yield found.groupby("size", as_index=False)["most"].max()

    # One row for each size of a text.
    most = texts.select("tokens").mapInPandas(held, "size int, most int").groupBy("size").agg(F.max("most").alias("most")).toPandas().to_numpy(dtype=np.int64).T

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        meetings, least = shared.value, {}

        def table(found: list[tuple]) -> pd.DataFrame:
            times = [len(x[-1][0]) for x in found]
            out = {name: np.repeat([x[k] for x in found], times) for k, name in enumerate(["class", "in_train", "in_eval", "size", "common", "m1", "m2"])}
            return pd.DataFrame({name: np.concatenate([x[-1][k] for x in found]) for k, name in enumerate(["key", "rest", "tail"])} | out)

        for pdf in batches:
            found, many = [], 0
            for class_, in_train, in_eval, tokens in pdf[["class", "in_train", "in_eval", "tokens"]].itertuples(index=False):
                size, (single, ranks) = len(tokens), meetings.split(tokens)
                if size not in least:
                    least[size] = meetings.least_common(size, *most)
                keys = meetings.keys(size, single, ranks, least[size])
                for at in range(0, len(keys[0]), _WRITTEN):
                    part = [x[at : at + _WRITTEN] for x in keys]
                    found.append((class_, in_train, in_eval, size, len(ranks), *mask(ranks), part))
                    many += len(part[0])
                    if many >= _WRITTEN:
                        yield table(found)
                        found, many = [], 0
            if found:
                yield table(found)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kept, of = [], []
            for x, y in zip(pdf["items_a"], pdf["items_b"]):
                u, v = shingles(list(x), 2), shingles(list(y), 2)
                of.append(len(u & v) / len(u | v))
                kept.append(of[-1] >= similarity)
            out = pdf[["a", "b"]].assign(similarity=of)
            yield out[np.array(kept, dtype=bool)]

    schema = "key long, class long, in_train boolean, in_eval boolean, size int, common int, rest int, tail int, m1 long, m2 long"
    places = cut(texts.mapInPandas(met, schema))
    side = lambda flag, id_, at: places.filter(flag).select("key", F.col("class").alias(id_), *[F.col(c).alias(f"{c}_{at}") for c in ("size", "common", "rest", "tail", "m1", "m2")])
    lacks = lambda x, y: f"common_{x} - bit_count(m1_{x} & ~m1_{y}) - bit_count(m2_{x} & ~m2_{y})"
    most_shared = F.expr(f"least(rest_a, rest_b) + least(tail_a, tail_b, {lacks('a', 'b')}, {lacks('b', 'a')})")
    candidates = (
        chunked_join(side("in_train", "a", "a"), side("in_eval", "b", "b"), ["key"], "a", "b")
        .filter((F.col("a") != F.col("b")) & (most_shared * (1 + similarity) >= similarity * (F.col("size_a") + F.col("size_b")) - 1e-6))
        .select("a", "b").distinct()
    )
    near = (
        candidates.join(classes.select(F.col("class").alias("a"), F.col("items").alias("items_a")), "a")
        .join(classes.select(F.col("class").alias("b"), F.col("items").alias("items_b")), "b")
        .select("a", "b", "items_a", "items_b")
        .mapInPandas(verify, "a long, b long, similarity double")
    )
    same = classes.filter("in_train AND in_eval").select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("similarity"))
    return members, near.unionByName(same)


def cross_split_pairs(rows: DataFrame, train: str = "train", similarity: float = SIMILARITY) -> DataFrame:
    """One row (train_record, eval_record, eval_split, similarity) per overlap: the
    pairs of ``overlapping_classes`` with their members, for callers that want
    every copy named; ``overlap_counts`` counts without naming them."""
    members, pairs = overlapping_classes(rows, train, similarity)
    held = members.filter(F.col("split") == train).select(F.col("class").alias("a"), F.col("record").alias("train_record"))
    tested = members.filter(F.col("split") != train).select(F.col("class").alias("b"), F.col("record").alias("eval_record"), F.col("split").alias("eval_split"))
    return (
        chunked_join(chunked_join(pairs, held, ["a"], "b", "train_record"), tested, ["b"], "train_record", "eval_record")
        .filter(F.col("train_record") != F.col("eval_record"))
        .groupBy("train_record", "eval_record", "eval_split").agg(F.round(F.max("similarity"), 6).alias("similarity"))
    )


@scratched
def overlap_counts(rows: DataFrame, train: str = "train", similarity: float = SIMILARITY) -> DataFrame:
    """One row (record, split, class, links, same_text) per evaluation record that
    overlaps: links is the number of other training records it overlaps with,
    same_text that of those with just its items."""
    members, pairs = overlapping_classes(rows, train, similarity)
    sizes = members.filter(F.col("split") == train).groupBy(F.col("class").alias("a")).agg(F.count("*").alias("n"))
    by_class = pairs.join(sizes, "a").groupBy("b").agg(F.sum("n").alias("links"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    tested = members.filter(F.col("split") != train)
    # A record that stands in train too is no overlap with itself.
    own = tested.select("record", "split", F.col("class").alias("b")).join(members.filter(F.col("split") == train).select("record", F.col("class").alias("a")), "record")
    own = own.join(pairs.select("a", "b"), ["a", "b"]).groupBy("record", "split").agg(F.count("*").alias("own"), F.sum(F.when(F.col("a") == F.col("b"), 1).otherwise(0)).alias("own_same"))
    return (
        tested.join(by_class.withColumnRenamed("b", "class"), "class").join(own, ["record", "split"], "left")
        .select("record", "split", "class", (F.col("links") - F.coalesce("own", F.lit(0))).alias("links"), (F.col("same") - F.coalesce("own_same", F.lit(0))).alias("same_text"))
        .filter("links > 0")
    )


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "dataset_example").select(F.col("example_id").alias("record"), "split", "name", "evidence")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        cross_split_pairs(_rows(spark, sf_dir))
        .select(
            F.least("train_record", "eval_record").alias("example_id_a"), F.greatest("train_record", "eval_record").alias("example_id_b")
        )
        .distinct()
    )


def p5_by_split_and_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per evaluation split and source of the evaluation record's evidence."""
    sources = (
        load(spark, sf_dir, "dataset_example")
        .select(F.col("example_id").alias("record"), F.explode("evidence.source").alias("source"))
        .distinct()
    )
    return (
        overlap_counts(_rows(spark, sf_dir)).join(sources, "record")
        .groupBy(F.col("split").alias("eval_split"), "source")
        .agg(F.sum("links").alias("pairs"), F.countDistinct("record").alias("eval_examples"), F.sum("same_text").alias("same_text"))
    )


QUERIES = {"p5_found": p5_found, "p5_by_split_and_source": p5_by_split_and_source}
SQL: dict[str, str] = {}
