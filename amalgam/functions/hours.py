"""Opening hours in one notation: a map from day to ranges."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from amalgam.functions.compat import trim_blank

# Days in order and the words for closed.
DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
CLOSED = ["closed", "off", "off day", "day off"]


def hours_value(c: Column) -> Column:
    """D1: 'closed' for its synonyms, other text trimmed, null for none."""
    t = trim_blank(c)
    return F.when(t.isNull() | t.isin("", "[object Object]", "[object Array]"), F.lit(None)).when(F.lower(t).isin(*CLOSED), "closed").otherwise(t)


def hours_list(c: Column) -> Column:
    """D1 of an array of ranges: trimmed and joined by ', '; null for none."""
    kept = F.filter(F.transform(c, trim_blank), lambda x: F.coalesce(x != "", F.lit(False)))
    return F.when(F.size(kept) > 0, F.array_join(kept, ", "))


def interval(opens: Column, closes: Column) -> Column:
    """D1 of an interval object: 'open-close', or the opening alone."""
    a, b = trim_blank(opens.cast("string")), trim_blank(closes.cast("string"))
    return F.when(a == "", None).when(F.coalesce(b != "", F.lit(False)), F.concat_ws("-", a, b)).otherwise(a)


def _day_number(word: Column) -> Column:
    short = F.substring(F.lower(word), 1, 2)
    return F.element_at(F.create_map(*[F.lit(x) for i, d in enumerate(DAYS) for x in (d[:2], i)]), short)


def hours_map(c: Column) -> Column:
    """D2: 'Mo-Fr 08:00-17:00, Sa 09:00-12:00' as a map; spans of days may wrap
    over Sunday, and several ranges of a day are joined."""
    pattern = r"(?i)([a-z]{2,9})(?:\s*-\s*([a-z]{2,9}))?:?\s+(closed|off|[0-9]{1,2}:[0-9]{2}\s*-\s*[0-9]{1,2}:[0-9]{2})"
    first, last, value = (F.regexp_extract_all(c, F.lit(pattern), F.lit(k)) for k in (1, 2, 3))
    zipped = F.arrays_zip(first.alias("a"), last.alias("b"), value.alias("v"))

    def spread(x: Column) -> Column:
        a = _day_number(x["a"])
        b = F.when(x["b"] != "", _day_number(x["b"])).otherwise(a)
        days = F.sequence(F.lit(0), F.pmod(b - a, F.lit(7)))
        return F.transform(days, lambda d: F.struct(F.pmod(a + d, F.lit(7)).alias("d"), F.regexp_replace(hours_value(x["v"]), r"\s*-\s*", "-").alias("v")))

    parts = F.flatten(F.transform(zipped, spread))
    entries = F.transform(
        F.sequence(F.lit(0), F.lit(6)),
        lambda i: F.struct(F.get(F.array(*[F.lit(d) for d in DAYS]), i).alias("key"), F.array_join(F.transform(F.filter(parts, lambda p: p["d"] == i), lambda p: p["v"]), ", ").alias("value")),
    )
    return F.when(F.size(zipped) > 0, F.map_from_entries(F.filter(entries, lambda e: e["value"] != "")))


def hours_text(c: Column) -> Column:
    """D3: a map of hours as one line, days in order."""
    lines = F.array(*[F.when(F.try_element_at(c, F.lit(d)).isNotNull(), F.concat(F.lit(f"{d.title()}: "), F.try_element_at(c, F.lit(d)))) for d in DAYS])
    return F.array_join(F.array_compact(lines), " · ")
