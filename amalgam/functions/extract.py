"""Typed facts out of pages and map links."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from amalgam.functions.compat import collapse_blank
from amalgam.functions.geo import valid_position

_LD = r"(?is)<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
_OG = r"(?is)<meta[^>]*property\s*=\s*[\"']og:([a-z_:]+)[\"'][^>]*content\s*=\s*[\"']([^\"']*)[\"']"
_ITEM = r"(?is)<[a-z]+[^>]*itemprop\s*=\s*[\"']([a-z]+)[\"'][^>]*>([^<]*)<"


def json_ld(html: Column) -> Column:
    """All JSON-LD blocks as variants, bad ones left out."""
    return F.array_compact(F.transform(F.regexp_extract_all(html, F.lit(_LD), F.lit(1)), lambda b: F.try_parse_json(b)))


def _pairs(html: Column, pattern: str, last: bool) -> Column:
    names = F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda n: F.lower(n))
    values = F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(2)), collapse_blank)
    zipped = F.arrays_zip(names.alias("k"), values.alias("v"))
    ordered = F.reverse(zipped) if last else zipped
    kept = F.transform(F.array_distinct(F.transform(ordered, lambda e: e["k"])), lambda k: F.struct(k.alias("key"), F.get(F.filter(ordered, lambda e: e["k"] == k), F.lit(0))["v"].alias("value")))
    return F.map_from_entries(kept)


def microdata(html: Column) -> Column:
    """Itemprop values; the first wins."""
    return _pairs(html, _ITEM, last=False)


def open_graph(html: Column) -> Column:
    """Og: properties; the last wins."""
    return _pairs(html, _OG, last=True)


def visible_text(html: Column, most: int = 15_000) -> Column:
    """Text without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]+>", " ")
    return F.substring(collapse_blank(bare), 1, most)


def page_record(html: Column) -> Column:
    """One record of a page; JSON-LD before OpenGraph before microdata."""
    blocks = json_ld(html)
    inside = lambda path: F.array_compact(F.transform(blocks, lambda b: F.coalesce(F.try_variant_get(b, f"$.{path}", "string"), F.try_variant_get(b, f"$['@graph'][0].{path}", "string"))))
    ld = lambda path: F.get(inside(path), F.lit(0))
    og, item = open_graph(html), microdata(html)
    take = lambda path, o, i: F.coalesce(ld(path), *([F.try_element_at(og, F.lit(o))] if o else []), F.try_element_at(item, F.lit(i)))
    return F.struct(
        take("name", "title", "name").alias("name"), take("telephone", None, "telephone").alias("phone"), take("email", None, "email").alias("email"), take("url", "url", "url").alias("website"),
        take("address.streetAddress", None, "streetaddress").alias("street"), take("address.addressLocality", None, "addresslocality").alias("city"),
        ld("geo.latitude").try_cast("double").alias("latitude"), ld("geo.longitude").try_cast("double").alias("longitude"),
        F.coalesce(ld("aggregateRating.ratingValue"), F.try_element_at(item, F.lit("ratingvalue"))).try_cast("double").alias("rating"),
    )


def maps_link(url: Column) -> Column:
    """Kind, name, place id, cid, position, zoom and query of a map link."""
    position = r"@(-?[0-9]+\.[0-9]+),(-?[0-9]+\.[0-9]+)(?:,([0-9.]+)z)?"
    get = lambda pattern, g=1: F.nullif(F.regexp_extract(url, pattern, g), F.lit(""))
    decoded = lambda c: F.url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))
    lat, lon = get(position, 1).try_cast("double"), get(position, 2).try_cast("double")
    name = decoded(get(r"(?i)/maps/place/([^/@?]+)"))
    query = decoded(F.coalesce(get(r"[?&]q(?:uery)?=([^&#]+)"), get(r"(?i)/maps/search/([^/@?]+)")))
    place = F.coalesce(get(r"(?:[?&]query_place_id=|place_id:|!1s)(ChIJ[A-Za-z0-9_-]+)"), get(r"!1s(0x[0-9a-fA-F]+:0x[0-9a-fA-F]+)"))
    cid = F.coalesce(get(r"[?&]cid=([0-9]+)"), hex_cid(get(r"!1s(0x[0-9a-fA-F]+:0x[0-9a-fA-F]+)")))
    kind = (
        F.when(url.rlike(r"(?i)(maps\.app\.goo\.gl|goo\.gl/maps)"), "short").when(name.isNotNull(), "place").when(url.rlike("[?&]cid="), "cid").when(query.isNotNull(), "search").when(lat.isNotNull(), "position").otherwise("unknown")
    )
    return F.struct(
        kind.alias("kind"), name.alias("name"), place.alias("place_id"), cid.alias("cid"), F.when(valid_position(lat, lon), lat).alias("lat"), F.when(valid_position(lat, lon), lon).alias("lng"),
        get(position, 3).try_cast("double").alias("zoom"), query.alias("query"),
    )


def valid_place_id(c: Column) -> Column:
    """X7."""
    return F.coalesce(c.rlike(r"^ChIJ[A-Za-z0-9_-]{23,}$") | c.rlike(r"^0x[0-9a-fA-F]+:0x[0-9a-fA-F]+$"), F.lit(False))


def hex_cid(c: Column) -> Column:
    """The decimal id in the second half of a hexadecimal pair."""
    return F.when(c.rlike("^0x[0-9a-fA-F]+:0x[0-9a-fA-F]+$"), F.conv(F.regexp_extract(c, ":0x([0-9a-fA-F]+)$", 1), 16, 10))


def rating_in_text(c: Column) -> Column:
    """The first rating a text states, from 1 to 5."""
    tried = [r"(?i)rated\s+([0-9](?:\.[0-9])?)", r"(?i)([0-9](?:\.[0-9])?)\s*(?:/|out of)\s*5", r"(?i)([0-9]\.[0-9])\s*(?:stars?|★)"]
    found = [F.nullif(F.regexp_extract(c, p, 1), F.lit("")).try_cast("double") for p in tried]
    return F.coalesce(*[F.when(x.between(1, 5), x) for x in found])


def count_in_text(c: Column) -> Column:
    """The first number of reviews a text states."""
    tried = [r"(?i)([0-9][0-9,]*)\s+(?:google\s+)?reviews?", r"(?i)([0-9][0-9,]*)\s+ratings?", r"\(([0-9][0-9,]*)\)"]
    return F.coalesce(*[F.regexp_replace(F.nullif(F.regexp_extract(c, p, 1), F.lit("")), ",", "").try_cast("long") for p in tried])


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


# Patterns of map pages and the words on them that are no data.
_REGION = r"([A-Z][A-Za-z. ]+?)\s*,\s*([A-Z][A-Za-z. ]+?)\s+(\d{6})\s*,\s*([A-Z][A-Za-z. ]+?)(?=[\s,)]|$)"
_BUTTONS = ["Share", "Directions", "Save", "Nearby", "Send to phone", "See photos"]
_NO_CATEGORY = ["Directions", "Nearby", "Transit", "Search", "Traffic", "Close"]
_DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def map_page_fields(markdown: Column) -> Column:
    """Phone, address, city, state, postal_code, country, rating, category and
    hours of a map page in markdown; null where the page names none.

    The address is the cluster 'City, State 123456, Country' and at most three
    comma parts before it, up to a button's label."""
    text = collapse_blank(F.regexp_replace(F.regexp_replace(markdown, r"!\[[^\]]*\]\([^)]*\)", " "), r"https?://maps\.google\.com/maps[^\s)]+", " "))
    linked = F.regexp_replace(_found(text, r"tel:\+?([\d\s()-]{7,})"), r"[\s()-]", "")
    spoken = F.regexp_replace(F.concat(_found(text, r"\+(\d{1,3})[\s-]?(\d{4,}[\s-]?\d{4,})"), _found(text, r"\+(\d{1,3})[\s-]?(\d{4,}[\s-]?\d{4,})", 2)), r"[\s-]", "")
    long = lambda d: F.when(F.length(d) >= 10, F.concat(F.lit("+"), d))
    region = _found(text, _REGION, 0)
    before = F.filter(F.transform(F.split(F.split(text, _REGION, 2)[0], ","), lambda x: F.trim(x)), lambda x: x != "")
    nearest = F.slice(F.reverse(before), 1, 3)
    stop = F.array_position(F.transform(nearest, lambda x: x.isin(*_BUTTONS)), True)
    kept = F.reverse(F.when(stop > 0, F.slice(nearest, F.lit(1), (stop - 1).cast("int"))).otherwise(nearest))
    rating, category = _found(text, r"\s(\d\.\d)\s([A-Z][A-Za-z]{2,})(?:\s|$)").try_cast("double"), _found(text, r"\s(\d\.\d)\s([A-Z][A-Za-z]{2,})(?:\s|$)", 2)
    rated = rating.between(0, 5) & ~category.isin(*_NO_CATEGORY)
    span = r"(?i)%s\*?\s+([0-9]{1,2}(?::[0-9]{2})?)\s*(AM|PM)\s*[\u2013\u2014-]\s*([0-9]{1,2}(?::[0-9]{2})?)\s*(AM|PM)"
    parts = [[_found(text, span % d, k) for k in (1, 2, 3, 4)] for d in _DAYS]
    days = F.array_compact(
        F.array(*[F.when(h[0].isNotNull(), F.struct(F.lit(d.lower()).alias("key"), F.concat(h[0], F.lit(" "), h[1], F.lit("-"), h[2], F.lit(" "), h[3]).alias("value"))) for d, h in zip(_DAYS, parts)])
    )
    return F.struct(
        F.coalesce(long(linked), long(spoken)).alias("phone"), F.when(region.isNotNull() & (F.size(kept) > 0), F.array_join(F.concat(kept, F.array(region)), ", ")).alias("address"),
        F.trim(_found(text, _REGION)).alias("city"), F.trim(_found(text, _REGION, 2)).alias("state"), F.coalesce(_found(text, _REGION, 3), _found(text, r"\b(\d{6})\b")).alias("postal_code"), F.trim(_found(text, _REGION, 4)).alias("country"),
        F.when(rated, rating).alias("rating"), F.when(rated, category).alias("category"), F.map_from_entries(days).alias("hours"),
    )


# Patterns of phones, addresses, ratings and counts in raw pages, in the order they are tried.
_PAGE_PHONES = [r"(?:\+91[\s-]?)?[6-9]\d{4}[\s-]?\d{5}", r"(?:\+91[\s-]?)?\d{3}[\s-]?\d{3}[\s-]?\d{4}", r"\b\d{10}\b"]
_PAGE_ADDRESS = r"[A-Za-z\s]+,\s*[A-Za-z\s]+,\s*[A-Za-z\s]+,\s*[A-Za-z\s]+\s+\d{6}"
_PAGE_RATINGS = [r"(?:rating|Rating|★)\s*[:]\s*([0-9]\.[0-9])", r'"ratingValue"\s*:\s*"([0-9]\.[0-9])"', r'"rating"\s*:\s*([0-9]\.[0-9])', r"([0-9]\.[0-9])\s*out of\s*5"]
_PAGE_COUNTS = [r'"reviewCount"\s*:\s*"([0-9,]+)"', r"(?i)([0-9,]+)\s*(?:reviews|ratings)", r'"review_count"\s*:\s*([0-9]+)']


def raw_page_fields(html: Column) -> Column:
    """X11: phone, address, city, state, postal_code, rating and review_count of a
    raw page: of each the first pattern that gives a value, null for none."""
    phones = [F.get(F.filter(F.regexp_extract_all(html, F.lit(p), F.lit(0)), lambda m: F.length(F.regexp_replace(m, r"[\s-]", "")) >= 10), F.lit(0)) for p in _PAGE_PHONES]
    address = _found(html, _PAGE_ADDRESS, 0)
    parts = F.transform(F.split(address, ","), collapse_blank)
    return F.struct(
        F.coalesce(*phones).alias("phone"), address.alias("address"), F.try_element_at(parts, F.lit(-3)).alias("city"), F.try_element_at(parts, F.lit(-2)).alias("state"),
        _found(F.try_element_at(parts, F.lit(-1)), r"\d{6}", 0).alias("postal_code"),
        F.coalesce(*[_found(html, p).try_cast("double") for p in _PAGE_RATINGS]).alias("rating"), F.coalesce(*[F.regexp_replace(_found(html, p), ",", "").try_cast("long") for p in _PAGE_COUNTS]).alias("review_count"),
    )


def clean_reviews(reviews: Column) -> Column:
    """Reviews (structs of rating, text, author, author_name, published_at,
    relative_time, publish_time, confidence) that say anything: a text, a rating
    from 1 to 5 or an author. Ratings go to one place, texts are trimmed, the first
    filled author and date count, confidence is clamped and 0.5 where missing."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    cleaned = F.transform(
        reviews,
        lambda r: F.struct(
            F.when(r["rating"].between(1, 5), F.floor(r["rating"] * 10 + 0.5) / 10).alias("rating"), filled(r["text"]).alias("text"), F.coalesce(filled(r["author"]), filled(r["author_name"])).alias("author"),
            F.coalesce(filled(r["published_at"]), filled(r["relative_time"]), filled(r["publish_time"])).alias("published_at"), F.when(r["confidence"].isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), r["confidence"]))).alias("confidence"),
        ),
    )
    return F.filter(cleaned, lambda r: r["text"].isNotNull() | r["rating"].isNotNull() | r["author"].isNotNull())


def provider_reputation(rating: Column, count: Column, reviews: Column) -> Column:
    """What a structured record says about its reputation. It is extracted if
    it holds a valid rating or count, else unavailable; a rating makes it surer."""
    r = F.when(rating.between(1, 5), F.floor(rating * 10 + 0.5) / 10)
    n = F.when((count >= 0) & (count == F.floor(count)), count.cast("long"))
    return F.struct(
        r.alias("rating"), n.alias("review_count"), F.size(F.coalesce(clean_reviews(reviews), F.array())).alias("reviews"),
        F.when(r.isNotNull() | n.isNotNull(), "source_extracted").otherwise("unavailable").alias("status"), F.when(r.isNotNull(), 0.9).otherwise(0.7).alias("confidence"),
    )


def acquisition_completeness(*fields: Column) -> Column:
    """Share of the identity fields (name, phone, website, address, position) that are filled."""
    filled = [F.when(c.isNotNull() & (c.cast("string") != ""), 1.0).otherwise(0.0) for c in fields]
    return sum(filled, F.lit(0.0)) / F.lit(float(len(fields)))


def error_class(status: Column, message: Column) -> Column:
    """Class of a failed acquisition and whether a retry can help."""
    m = F.lower(F.coalesce(message, F.lit("")))
    kind = (
        F.when(status == 429, "RATE_LIMITED").when(status.isin(401, 403), "ACCESS_DENIED").when(status == 404, "NOT_FOUND").when((status == 408) | m.contains("timeout") | m.contains("timed out"), "TIMEOUT")
        .when(status >= 500, "PROVIDER_UNAVAILABLE").when(m.rlike("econn|enotfound|network|socket"), "NETWORK_ERROR").when(m.rlike("json|parse|malformed"), "MALFORMED_RESPONSE").otherwise("UNKNOWN_ERROR")
    )
    return F.struct(kind.alias("kind"), (kind.isin("RATE_LIMITED", "TIMEOUT", "PROVIDER_UNAVAILABLE", "NETWORK_ERROR") | F.coalesce(status.isin(408, 429, 500, 502, 503, 504), F.lit(False))).alias("retryable"))
