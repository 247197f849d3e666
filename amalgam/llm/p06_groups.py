"""Consolidating pairwise matches into groups.

The graph usually has one component far larger than all others, so it is
peeled first: frontier breadth-first joins run from the vertex of highest
degree, the vertices they reach are anti-joined away, and what is left (many
small components) is labelled by minimum propagation. Propagation alternates
the two star contractions (every vertex hands the least vertex it knows to its
larger, then to its smaller neighbours), which needs about log(diameter)
rounds instead of one per hop. The least neighbour is an aggregate that combines
before its shuffle; vertices of very many links are few, and meet their links by
a broadcast, so no vertex is one task.

All rounds run on numbers: the distinct vertices are sorted once and take their
rank, which keeps their order, as id. So every shuffle carries two longs a link,
every aggregate is a hash aggregate, and the least id is the smallest name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from amalgam.runtime import cut, drop, load, scratched, small

#: Breadth-first rounds before the rest of a long-tailed component is left to
#: propagation; the part reached by then is contracted to one vertex.
PEEL_ROUNDS = 12
#: Links from which a vertex is hot: more than one task should sort. There are at most
#: links / HOT_LINKS hot vertices.
HOT_LINKS = 1_000_000


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )


def _peel(pairs: DataFrame, rounds: int) -> tuple[int | None, DataFrame | None, int, bool]:
    """The vertex of highest degree, all vertices reached from it and their
    number, and whether the component is exhausted."""
    links = _both_ways(pairs)
    top = (
        links.groupBy("u").count().orderBy(F.desc("count"), "u").limit(1).collect()
    )  # one row, whatever the size of the graph
    if not top:
        return None, None, 0, True
    hub = top[0]["u"]
    # The hub's own links are found by a filter: its rows are never hashed to one task.
    frontier = cut(links.filter(F.col("u") == F.lit(hub)).select("v").distinct())
    layers = [frontier]
    reached = frontier.unionAll(pairs.sparkSession.createDataFrame([(hub,)], "v long"))
    new = frontier.count()
    total = new + 1
    for _ in range(rounds):
        # A counted frontier is broadcast while it is small: the links then stay where they are.
        step = (
            links.join(small(frontier.select(F.col("v").alias("u")), new), "u", "left_semi")
            .select("v")
            .join(small(reached, total), "v", "left_anti")
            .distinct()
        )
        frontier = cut(step)
        new = frontier.count()
        if not new:
            return hub, reached, total, True
        layers.append(frontier)
        reached, total = reached.unionAll(frontier), total + new
    return hub, reached, total, False


def _with_least(links: DataFrame, vertex: str, least: F.Column, number: int) -> DataFrame:
    """Adds ``m``, the least of ``least`` over all links of a vertex; number is that of the links."""
    found = links.groupBy(vertex).agg(F.min(least).alias("m"), F.count("*").alias("n"))
    if number < HOT_LINKS:  # so no vertex can be hot
        return links.join(found.select(vertex, "m"), vertex)
    found = cut(found)
    hot = found.filter(F.col("n") >= HOT_LINKS).select(vertex, "m")
    few = hot.count()
    if not few:
        return links.join(found.select(vertex, "m"), vertex)
    mild = links.join(small(hot.select(vertex), few), vertex, "left_anti").join(found.select(vertex, "m"), vertex)
    return mild.unionByName(links.join(small(hot, few), vertex))


def _large_star(pairs: DataFrame, number: int) -> DataFrame:
    ways = _with_least(_both_ways(pairs), "u", F.least("u", "v"), 2 * number)
    return ways.filter(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(pairs: DataFrame, number: int) -> DataFrame:
    ends = F.array(F.struct(F.col("m").alias("a"), F.col("b").alias("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))
    return (
        _with_least(pairs, "b", F.col("a"), number)
        .select(F.explode(ends).alias("e"))
        .select("e.a", "e.b")
        .filter(F.col("a") != F.col("b"))
        .distinct()
    )


def _propagate(pairs: DataFrame) -> DataFrame:
    """Stars (a = least vertex of the component, b = every other vertex)."""
    pairs = cut(pairs)
    before, number = None, pairs.count()
    while number:
        wide = cut(_large_star(pairs, number))
        last, pairs = pairs, cut(_small_star(wide, number))
        drop(last, wide)
        # Count and an order-free fingerprint of the links: unchanged means done.
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, number = now, now[0]
    return pairs


def _numbered(names: DataFrame) -> DataFrame:
    """(name, id) of distinct names: their ranks in byte order, over one range sort."""
    placed = cut(
        names.orderBy("name")
        .withColumn("part", F.spark_partition_id())
        .withColumn("pos", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    )
    offsets, at = [], 0
    for part, n in sorted(placed.groupBy("part").count().collect()):  # one number a partition
        offsets.append((part, at))
        at += n
    where = names.sparkSession.createDataFrame(offsets, "part int, offset long")
    return placed.join(F.broadcast(where), "part").select("name", (F.col("offset") + F.col("pos")).alias("id"))


@scratched
def connected_groups(
    links: DataFrame, left: str, right: str, peel_rounds: int = PEEL_ROUNDS
) -> DataFrame:
    """One row (member, group_key) per vertex of a component of two or more.

    ``links`` holds one link a row between the strings in columns ``left`` and
    ``right``; group_key is the smallest member in byte order. Rows with a null
    end, links of a vertex with itself, repeats and turned rows change nothing.
    No links give an empty result. Other columns are ignored, whatever their names.
    """
    x, y = F.col(left).cast("string"), F.col(right).cast("string")
    named = cut(
        links.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), x.alias("x"), y.alias("y"))
        .filter(F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("a") != F.col("b")))
        .select("a", "b")
        .distinct()
    )
    ids = cut(_numbered(named.select(F.col("a").alias("name")).unionAll(named.select("b")).distinct()))
    # A name with many links is one row of ids: the adaptive skew join splits its links.
    pairs = cut(
        named.join(ids.select(F.col("name").alias("a"), F.col("id").alias("ia")), "a")
        .join(ids.select(F.col("name").alias("b"), F.col("id").alias("ib")), "b")
        .select(F.col("ia").alias("a"), F.col("ib").alias("b"))
    )
    giant, stars = _components(pairs, peel_rounds)
    name_of = lambda c, as_: ids.select(F.col("id").alias(c), F.col("name").alias(as_))
    labelled = stars.select(F.col("b").alias("i"), F.col("a").alias("g")).unionAll(stars.select(F.col("a").alias("i"), F.col("a").alias("g")).distinct())
    found = labelled.join(name_of("g", "group_key"), "g").join(name_of("i", "member"), "i").select("member", "group_key")
    if giant is None:
        return found
    # The giant's members never meet on its one key.
    least = giant.agg(F.min("v").alias("i")).join(name_of("i", "name"), "i").first()["name"]
    return found.unionAll(giant.join(name_of("v", "member"), "v").select("member", F.lit(least).alias("group_key")))


def _components(pairs: DataFrame, peel_rounds: int) -> tuple[DataFrame | None, DataFrame]:
    """The vertices v of the giant component, and stars (a, b) of all others, from links a < b of ids."""
    hub, reached, total, exhausted = _peel(pairs, peel_rounds)
    if hub is None:
        return None, pairs
    if exhausted:
        return reached, _propagate(pairs.join(small(reached.select(F.col("v").alias("a")), total), "a", "left_anti"))
    rest = pairs
    for end in ("a", "b"):
        mark = reached.select(F.col("v").alias(end), F.lit(True).alias(f"in_{end}"))
        rest = rest.join(small(mark, total), end, "left")
    a = F.when(F.col("in_a"), F.lit(hub)).otherwise(F.col("a"))
    b = F.when(F.col("in_b"), F.lit(hub)).otherwise(F.col("b"))
    stars = _propagate(rest.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter(F.col("a") != F.col("b")).distinct())
    with_hub = stars.filter((F.col("a") == F.lit(hub)) | (F.col("b") == F.lit(hub))).select("a")
    centre = with_hub.agg(F.coalesce(F.min("a"), F.lit(hub)).alias("c")).first()["c"]
    whole = cut(
        stars.filter(F.col("a") == F.lit(centre)).select(F.col("b").alias("v"))
        .unionAll(reached).unionAll(stars.sparkSession.createDataFrame([(centre,)], "v long"))
        .distinct()
    )
    return whole, stars.filter(F.col("a") != F.lit(centre))


def confirmed_links(resolutions: DataFrame) -> DataFrame:
    """The rows of resolution_record that link their two records."""
    key = lambda side: F.concat(F.col(f"provider_{side}"), F.lit("|"), F.col(f"provider_record_id_{side}"))
    present = lambda c: F.col(c).isNotNull() & (F.length(F.trim(F.col(c))) > 0)
    return resolutions.filter(
        (F.col("match_type") == "same_entity")
        & F.col("match_score").between(0.85, 1.0)
        & (F.coalesce(F.col("status"), F.lit("")) != "dismissed")
        & present("provider_record_id_a")
        & present("provider_record_id_b")
    ).select(key("a").alias("record_a"), key("b").alias("record_b"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = confirmed_links(load(spark, sf_dir, "resolution_record"))
    return connected_groups(links, "record_a", "record_b").select(
        F.col("member").alias("record_key"), "group_key"
    )


def p6_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups there are of each size."""
    sizes = p6_found(spark, sf_dir).groupBy("group_key").agg(F.count("*").alias("records"))
    return sizes.groupBy("records").agg(F.count("*").alias("n_groups"))


_LINKS = """
links AS (
  SELECT DISTINCT provider_a || '|' || provider_record_id_a AS a, provider_b || '|' || provider_record_id_b AS b
  FROM resolution_record
  WHERE match_type = 'same_entity' AND match_score BETWEEN 0.85 AND 1 AND coalesce(status, '') <> 'dismissed'
    AND trim(provider_record_id_a) <> '' AND trim(provider_record_id_b) <> ''),
hops AS (SELECT a AS u, b AS v FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
reach(k, r) AS (SELECT DISTINCT u, u FROM hops UNION SELECT reach.k, hops.v FROM reach JOIN hops ON hops.u = reach.r),
grouped AS (SELECT k AS record_key, min(r) AS group_key FROM reach GROUP BY k)
"""

QUERIES = {"p6_found": p6_found, "p6_group_sizes": p6_group_sizes}
SQL = {
    "p6_found": f"WITH RECURSIVE {_LINKS} SELECT record_key, group_key FROM grouped",
    "p6_group_sizes": f"""WITH RECURSIVE {_LINKS}, sizes AS (SELECT group_key, count(*) AS records FROM grouped GROUP BY 1)
        SELECT records, count(*) AS n_groups FROM sizes GROUP BY 1""",
}
