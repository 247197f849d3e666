"""Splits that keep related records together.

1. Names are read to signatures (legal form, notation, town left out); records
   with one signature are related. Signatures within one slip of each other are
   found by deletion neighbourhood: both leave a common string when one
   character is deleted.
2. A Borůvka-style contraction links signatures: every component takes its
   least edge, components are merged along these edges by pointer jumping, and
   edges between the contracted components are reduced to the least each. The
   edges taken are the spanning forest, kept in a written table.
3. Roots are put into bands by the binary logarithm of their size, and the roots
   of a band fall to at most ``SLICES`` slices by a hash. From the band of the
   largest roots down, the slices are dealt systematically: in order they cover
   the band's size, and stretches of it go to the splits in proportion to what
   each still lacks. A band of few roots has one root a slice, so the same rule
   holds at every size; only the sizes of slices ever reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from amalgam.llm.normal import name_tokens, within_one_edit
from amalgam.runtime import cut, drop, load, scratched

#: Slices of a band: each holds about 1 / SLICES of the band, which is how exactly shares are met.
SLICES, SEED = 4096, 41


def with_signature(df: DataFrame, name: str) -> DataFrame:
    """Adds ``signature``: the telling words of a name, null if it is no real name."""

    @F.pandas_udf("string")
    def sign(part: pd.Series) -> pd.Series:
        return part.map(lambda n: " ".join(t) if (t := name_tokens(n)) else None)

    return df.withColumn("signature", sign(F.col(name)))


def slip_edges(signatures: DataFrame) -> DataFrame:
    """Edges (a, b, weight) between signatures one slip apart; a < b. A slip
    weighs less in a longer name."""

    def deletions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for s in pdf["signature"]:
                rows += [(v, s) for v in {s, *(s[:i] + s[i + 1 :] for i in range(len(s)))}]
            yield pd.DataFrame(rows, columns=["variant", "a"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            near = [within_one_edit(a, b) for a, b in zip(pdf["a"], pdf["b"])]
            kept = pdf[near]
            yield kept.assign(weight=1.0 / kept["a"].str.len().clip(lower=1))

    variants = cut(signatures.mapInPandas(deletions, "variant string, a string"))
    # A variant has few signatures: those that differ from it by one inserted character.
    return (
        variants.join(variants.withColumnRenamed("a", "b"), "variant")
        .filter(F.col("a") < F.col("b"))
        .select("a", "b")
        .distinct()
        .mapInPandas(verify, "a string, b string, weight double")
    )


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, forest): labels is (vertex, root) for every vertex of ``edges``
    (a, b, weight), forest the edges of a minimum spanning forest. Ties go to the
    smaller (a, b); loops and null ends are left out."""
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    live = cut(edges.select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.struct("weight", "a", "b").alias("e")))
    labels = cut(live.select(F.col("ca").alias("vertex")).unionAll(live.select("cb")).distinct().withColumn("root", F.col("vertex")))
    chosen: list[DataFrame] = []
    while not live.isEmpty():
        ways = live.select(F.col("ca").alias("c"), F.col("cb").alias("other"), "e").unionAll(
            live.select(F.col("cb").alias("c"), F.col("ca").alias("other"), "e")
        )
        best = cut(ways.groupBy("c").agg(F.min(F.struct("e", "other")).alias("m")).select("c", F.col("m.other").alias("to"), F.col("m.e").alias("e")))
        chosen.append(best.select("e.*").distinct())
        # Least edges under one total order make trees with one pair that point at each other.
        back = best.select(F.col("c").alias("to"), F.col("to").alias("back"))
        parent = cut(
            best.join(back, "to", "left").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("p"))
        )
        while True:
            above = parent.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            up = cut(parent.join(above, "p").select("c", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
            moved = not up.filter("moved").isEmpty()
            drop(parent)
            parent = up.select("c", "p")
            if not moved:
                break
        old_labels, old_live = labels, live
        labels = cut(
            labels.join(parent.withColumnRenamed("c", "root"), "root", "left").select("vertex", F.coalesce("p", "root").alias("root"))
        )
        live = cut(
            live.join(parent.select(F.col("c").alias("ca"), F.col("p").alias("pa")), "ca")
            .join(parent.select(F.col("c").alias("cb"), F.col("p").alias("pb")), "cb")
            .filter(F.col("pa") != F.col("pb"))
            .groupBy(F.least("pa", "pb").alias("ca"), F.greatest("pa", "pb").alias("cb"))
            .agg(F.min("e").alias("e"))
        )
        drop(old_labels, old_live)
    forest = chosen[0] if chosen else edges.select("weight", "a", "b").limit(0)
    for part in chosen[1:]:
        forest = forest.unionAll(part)
    return labels, cut(forest)


@scratched
def related_groups(rows: DataFrame, record: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(groups, forest): one row (record, group_id, records, named) per distinct
    record; group_id is the smallest record of the group, records its number.

    Records whose name is null, a placeholder or an id are groups of their own.
    A record delivered several times counts once; if its names differ, all of
    them relate it. Null records are left out; other columns are ignored; an
    empty table gives empty results.
    """
    named = cut(
        with_signature(rows.select(F.col(record).alias("record"), F.col(name).alias("name")).filter("record IS NOT NULL").distinct(), "name")
        .select("record", "signature")
        .distinct()
    )
    signed = named.filter("signature IS NOT NULL")
    # Records with several signatures tie each to the least, like a slip of no weight.
    several = signed.groupBy("record").agg(F.min("signature").alias("a"), F.max("signature").alias("last")).filter("a < last").select("record", "a")
    ties = (
        signed.join(several, "record").select("a", F.col("signature").alias("b"), F.lit(0.0).alias("weight")).filter("a < b").distinct()
    )
    labels, forest = spanning_forest(slip_edges(signed.select("signature").distinct()).unionAll(ties).groupBy("a", "b").agg(F.min("weight").alias("weight")))
    placed = signed.join(labels.withColumnRenamed("vertex", "signature"), "signature", "left").select(
        "record", F.coalesce("root", "signature").alias("root")
    ).groupBy("record").agg(F.min("root").alias("root"))
    placed = cut(placed)
    sizes = placed.groupBy("root").agg(F.min("record").alias("group_id"), F.count("*").alias("records"))
    alone = named.groupBy("record").agg(F.max("signature").alias("s")).filter("s IS NULL").select(
        "record", F.col("record").alias("group_id"), F.lit(1).cast("long").alias("records"), F.lit(False).alias("named")
    )
    groups = placed.join(sizes, "root").select("record", "group_id", "records", F.lit(True).alias("named")).unionAll(alone)
    return groups, forest


@scratched
def deal_splits(groups: DataFrame, targets: list[tuple[str, float]], seed: int = SEED) -> DataFrame:
    """Adds ``split`` to groups (record, group_id, records): equal within a
    group, in the proportions of ``targets`` over records. Targets without a
    positive share get nothing; no such target, or no group, gives no rows."""
    shares = {n: s for n, s in sorted((t for t in targets if t[0] and t[1] and t[1] > 0), key=lambda t: t[0])}
    spark = groups.sparkSession
    sized = cut(groups.groupBy("group_id").agg(F.max("records").alias("records")).withColumn("band", F.floor(F.log2("records")).cast("int")))
    # At most some 60 bands, and SLICES numbers in each.
    roots = {r["band"]: r["n"] for r in sized.groupBy("band").agg(F.count("*").alias("n")).collect()}
    slices = F.coalesce(*[F.when(F.col("band") == b, F.lit(min(SLICES, 4 * n))) for b, n in roots.items()], F.lit(1))
    placed = sized.withColumn("slice", F.pmod(F.xxhash64("group_id", F.lit(seed)), slices).cast("int"))
    sizes: dict[int, list[tuple[int, int]]] = {}
    for r in placed.groupBy("band", "slice").agg(F.sum("records").alias("size")).collect():
        sizes.setdefault(r["band"], []).append((r["slice"], r["size"]))
    whole = sum(size for rows in sizes.values() for _, size in rows)
    lacking = {name: share / sum(shares.values()) * whole for name, share in shares.items()}
    dealt = [x for band in sorted(sizes, reverse=True) for x in _deal(band, sorted(sizes[band]), lacking)] if shares else []
    where = spark.createDataFrame(dealt, "band int, slice int, split string")
    return groups.join(placed.join(F.broadcast(where), ["band", "slice"]).select("group_id", "split"), "group_id")  # bounded by SLICES a band


def _deal(band: int, sizes: list[tuple[int, int]], lacking: dict[str, float]) -> list[tuple[int, int, str]]:
    """Splits of the slices (number, size) of a band; takes what they get off ``lacking``."""
    total, open_ = sum(size for _, size in sizes), sum(max(0.0, x) for x in lacking.values()) or 1.0
    edges, at = [], 0.0
    for name, x in lacking.items():
        at += max(0.0, x) / open_ * total
        edges.append((at, name))
    out, covered = [], 0.0
    for number, size in sizes:
        middle = covered + size / 2
        name = next((n for edge, n in edges if middle <= edge + 1e-9), max(lacking, key=lambda n: (lacking[n], n)))
        lacking[name] -= size
        covered += size
        out.append((band, number, name))
    return out


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return related_groups(load(spark, sf_dir, "dataset_example"), "example_id", "name")[0]


def _splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = [(r[0], r[1]) for r in load(spark, sf_dir, "split_target").select("split", "target_share").orderBy("split").collect()]
    return deal_splits(_groups(spark, sf_dir), targets)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _groups(spark, sf_dir)
        .filter("named AND records > 1")
        .select(F.col("record").alias("example_id"), F.col("group_id").alias("group_example_id"))
    )


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _splits(spark, sf_dir).select(
        F.col("record").alias("example_id"), F.col("group_id").alias("group_example_id"), "split"
    )


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each split."""
    reached = _splits(spark, sf_dir).groupBy("split").agg(F.count("*").alias("examples"), F.countDistinct("group_id").alias("groups"))
    return (
        load(spark, sf_dir, "split_target").join(reached, "split", "left")
        .withColumn("whole", F.expr("sum(coalesce(examples, 0)) OVER ()"))  # one row a split
        .select("split", "target_share", F.coalesce("examples", F.lit(0)).alias("examples"), F.coalesce("groups", F.lit(0)).alias("groups"),
                F.when(F.col("whole") > 0, F.round(F.coalesce("examples", F.lit(0)) / F.col("whole"), 6)).otherwise(0.0).alias("actual_share"))
    )


QUERIES = {"p4_found": p4_found, "p4_splits": p4_splits, "p4_shares": p4_shares}
SQL: dict[str, str] = {}
