"""Long exact spans shared between records.

Every window of ``k`` characters has a minimiser: the m-gram of least hash in
it. Consecutive windows with the same minimiser travel as one packed string
(a super-k-mer, at most 2k - m characters) to the bucket of that minimiser, so
a text is sent about (1 + 2k / (k - m)) times over instead of k times. Equal
windows have equal minimisers, so each bucket can be counted on its own.

1. A light pass sends one 64-bit minimiser a run; only minimisers that occur in
   two documents can hold a shared window.
2. Super-k-mers of those minimisers are collapsed to distinct strings with the
   least and greatest doc_id (combined map-side: a passage in a third of all
   documents is one row a task).
3. In each bucket the windows are sorted by hash, and equal hashes are compared
   as strings, so the counts are exact.
4. The shared offsets of each distinct string return to its occurrences (those of
   a string that stands in very many documents are split) and are merged to
   maximal stretches per document.

A bucket of more than ``hot_bucket`` distinct strings is not processed in one
task: its windows become keys of their own (the longest minimiser there is) and
are counted by an ordinary aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from amalgam.operators.joins import chunked_join
from amalgam.runtime import cut, load, scratched

#: Window and minimiser length in characters; distinct strings in a hot bucket.
WINDOW, MINIMISER, HOT_BUCKET = 120, 48, 20_000
#: Occurrences of one string that a task may hold.
SPLIT_OCCURRENCES = 100_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = 1 << 15


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def gram_hashes(points: np.ndarray, m: int) -> np.ndarray:
    """Mixed 64-bit hashes of all m-grams of a code point array."""
    n = len(points)
    if n < m:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((points + np.uint64(1)) * _powers(_BASE, n), dtype=np.uint64, out=total[1:])
    h = (total[m:] - total[:-m]) * _powers(_BASE_INV, n - m + 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def super_kmers(text: str, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window and last window of each run of windows."""
    h = gram_hashes(code_points(text), m)
    width = k - m + 1
    n = len(h) - width + 1
    if n <= 0:
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    at = np.empty(n, dtype=np.int64)
    for i in range(0, n, _STEP):  # bounded memory on very long texts
        part = np.lib.stride_tricks.sliding_window_view(h[i : i + _STEP + width - 1], width)
        at[i : i + len(part)] = part.argmin(axis=1) + np.arange(i, i + len(part))
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:], [n])) - 1
    return h[at[first]].view(np.int64), first, last


def shared_windows(strings: list[str], lows: np.ndarray, highs: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """For each string of a bucket, the character ranges covered by its windows
    that occur in two documents; lows and highs are the least and greatest
    doc_id in which the string occurs."""
    hashes = [gram_hashes(code_points(s), k) for s in strings]
    owner = np.repeat(np.arange(len(strings)), [len(h) for h in hashes])
    offset = np.concatenate([np.arange(len(h)) for h in hashes])
    flat = np.concatenate(hashes)
    order = np.argsort(flat, kind="stable")
    sorted_hash = flat[order]
    starts = np.flatnonzero(np.concatenate(([True], sorted_hash[1:] != sorted_hash[:-1])))
    low = np.minimum.reduceat(lows[owner[order]], starts)
    high = np.maximum.reduceat(highs[owner[order]], starts)
    ends = np.concatenate((starts[1:], [len(order)]))
    shared = np.zeros(len(flat), dtype=bool)
    for g in np.flatnonzero(low < high):
        rows = order[starts[g] : ends[g]]
        text = {strings[owner[r]][offset[r] : offset[r] + k] for r in rows} if len(rows) > 1 else ()
        if len(text) <= 1:
            shared[rows] = True
            continue
        by: dict[str, list[int]] = {}  # different windows of one hash
        for r in rows:
            by.setdefault(strings[owner[r]][offset[r] : offset[r] + k], []).append(r)
        for same in by.values():
            shared[same] = min(lows[owner[same]]) < max(highs[owner[same]])
    out: list[list[tuple[int, int]]] = []
    at = 0
    for h in hashes:
        where = np.flatnonzero(shared[at : at + len(h)])
        at += len(h)
        if not len(where):
            out.append([])
            continue
        breaks = np.flatnonzero(np.diff(where) > k)
        begin = where[np.concatenate(([0], breaks + 1))]
        end = where[np.concatenate((breaks, [len(where) - 1]))] + k
        out.append([(int(b), int(e)) for b, e in zip(begin, end)])
    return out


def _minimisers(k: int, m: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            docs, keys = [], []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                h = np.unique(super_kmers(text, k, m)[0])
                docs.append(np.full(len(h), doc, dtype=np.int64))
                keys.append(h)
            if docs:
                yield pd.DataFrame({"doc_id": np.concatenate(docs), "minimiser": np.concatenate(keys)})

    return run


def _packed(k: int, m: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                h, first, last = super_kmers(text, k, m)
                rows += [(doc, g, a, text[a : b + k]) for g, a, b in zip(h.tolist(), first.tolist(), last.tolist())]
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=["doc_id", "minimiser", "start", "packed"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "minimiser", "start", "packed"])

    return run


def _count_buckets(k: int):
    """Rows come sorted by minimiser; a bucket may cross batches."""

    def flush(rows: pd.DataFrame) -> pd.DataFrame:
        keys = rows["minimiser"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        strings, lows, highs = rows["packed"].tolist(), rows["low"].to_numpy(), rows["high"].to_numpy()
        out = []
        for a, b in zip(cuts, cuts[1:]):
            for s, ranges in zip(strings[a:b], shared_windows(strings[a:b], lows[a:b], highs[a:b], k)):
                out += [(int(keys[a]), s, x, y) for x, y in ranges]
        return pd.DataFrame(out, columns=["minimiser", "packed", "from", "to"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            keys = pdf["minimiser"].to_numpy()
            cut_at = int(np.searchsorted(keys, keys[-1], "left"))  # the last bucket may go on
            if held and held[0]["minimiser"].iloc[0] != keys[-1]:
                yield flush(pd.concat([*held, pdf.iloc[:cut_at]], ignore_index=True))
                held = []
            elif cut_at:
                yield flush(pdf.iloc[:cut_at])
            held.append(pdf.iloc[cut_at:])
        if held:
            yield flush(pd.concat(held, ignore_index=True))

    return run


def _hot_ranges(distinct: DataFrame, k: int) -> DataFrame:
    """The same result for hot buckets, with every window as its own key."""
    windows = distinct.select(
        "minimiser", "packed", "low", "high",
        F.explode(F.sequence(F.lit(1), F.length("packed") - (k - 1))).alias("at"),
    ).withColumn("window", F.expr(f"substring(packed, at, {k})"))
    shared = (
        windows.groupBy("window")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .filter("low < high")
        .select("window")
    )
    return windows.join(shared, "window", "left_semi").select(
        "minimiser", "packed", (F.col("at") - 1).cast("long").alias("from"), (F.col("at") - 1 + k).cast("long").alias("to")
    )


def _merged(spans: DataFrame) -> DataFrame:
    """Maximal stretches of spans (doc_id, from, to) that touch or overlap."""
    order = W.partitionBy("doc_id").orderBy("from", "to")
    before = F.max("to").over(order.rowsBetween(W.unboundedPreceding, -1))
    return (
        spans.withColumn("new", F.when(F.col("from") <= before, 0).otherwise(1))
        .withColumn("stretch", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("doc_id", "stretch")
        .agg(F.min("from").cast("int").alias("span_start"), F.max("to").cast("int").alias("span_end"))
        .drop("stretch")
    )


@scratched
def shared_spans(
    docs: DataFrame, k: int = WINDOW, m: int = MINIMISER, hot_bucket: int = HOT_BUCKET
) -> DataFrame:
    """One row (doc_id, span_start, span_end) per maximal stretch of text that
    is covered by windows of ``k`` characters standing in another doc_id too.

    ``docs`` has doc_id (int64) and text. Rows with a null id or text, and texts
    shorter than ``k``, have no spans; repeated rows of one doc_id count as one
    document. An empty table gives an empty result. Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(
        F.col("doc_id").isNotNull() & (F.length("text") >= k)
    )
    seen = (
        texts.mapInPandas(_minimisers(k, m), "doc_id long, minimiser long")
        .groupBy("minimiser")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        .filter("low < high")
        .select("minimiser")
    )
    occurrences = cut(
        texts.mapInPandas(_packed(k, m), "doc_id long, minimiser long, start long, packed string").join(
            seen, "minimiser", "left_semi"
        )
    )
    distinct = cut(
        occurrences.groupBy("minimiser", "packed").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))
    )
    hot = distinct.groupBy("minimiser").count().filter(F.col("count") > hot_bucket).select("minimiser")
    schema = "minimiser long, packed string, `from` long, `to` long"
    ranges = (
        distinct.join(hot, "minimiser", "left_anti")
        .repartition("minimiser")
        .sortWithinPartitions("minimiser")
        .mapInPandas(_count_buckets(k), schema)
        .unionByName(_hot_ranges(distinct.join(hot, "minimiser", "left_semi"), k))
    )
    ranges = cut(ranges)
    spans = chunked_join(ranges, occurrences, ["minimiser", "packed"], "from", "doc_id", SPLIT_OCCURRENCES, distinct).select(
        "doc_id", (F.col("start") + F.col("from")).alias("from"), (F.col("start") + F.col("to")).alias("to")
    )
    return _merged(spans.distinct())


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(load(spark, sf_dir, "documents"))


def p10_shared_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its length and how much of it stands elsewhere."""
    docs = load(spark, sf_dir, "documents")
    shared = shared_spans(docs).groupBy("doc_id").agg(
        F.count("*").alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars")
    )
    return (
        docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("text_chars"))
        .join(shared, "doc_id", "left")
        .select(
            "doc_id",
            "text_chars",
            F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
            F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"),
            F.when(F.col("text_chars") > 0, F.round(F.coalesce("shared_chars", F.lit(0)) / F.col("text_chars"), 6))
            .otherwise(0.0)
            .alias("shared_share"),
        )
    )


_SPANS = f"""d AS (SELECT doc_id, text FROM documents WHERE length(text) >= {WINDOW} GROUP BY doc_id, text),
w AS (SELECT doc_id, pos, substr(text, (pos + 1)::BIGINT, {WINDOW}) AS s FROM d, unnest(range(0, length(text) - {WINDOW - 1})) t(pos)),
common AS (SELECT s FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, pos FROM w SEMI JOIN common ON w.s = common.s),
g AS (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + {WINDOW} THEN 0 ELSE 1 END AS fresh FROM c),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS k FROM g),
spans AS (SELECT doc_id, min(pos)::INTEGER AS span_start, (max(pos) + {WINDOW})::INTEGER AS span_end FROM i GROUP BY doc_id, k)"""

QUERIES = {"p10_found": p10_found, "p10_shared_share": p10_shared_share}
#: Every window of every text, compared as it is.
SQL: dict[str, str] = {
    "p10_found": f"WITH {_SPANS} SELECT * FROM spans",
    "p10_shared_share": f"""WITH {_SPANS}, s AS (SELECT doc_id, count(*) AS n_spans, sum(span_end - span_start)::BIGINT AS shared_chars FROM spans GROUP BY 1)
        SELECT doc_id, coalesce(length(text), 0) AS text_chars, coalesce(n_spans, 0) AS n_spans, coalesce(shared_chars, 0) AS shared_chars, CASE WHEN length(text) > 0 THEN round(coalesce(shared_chars, 0) / length(text), 6) ELSE 0.0 END AS shared_share
        FROM documents LEFT JOIN s USING (doc_id)""",
}
