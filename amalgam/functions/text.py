"""Canonical forms of names, phones, URLs, addresses, lists and free text, as
column expressions that stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from amalgam.functions.compat import BLANK, collapse_blank, trim_blank

# Names of countries and their codes.
COUNTRY_CODES = {
    "us": "US", "usa": "US", "united states": "US", "united states of america": "US",
    "in": "IN", "ind": "IN", "india": "IN",
    "gb": "GB", "uk": "GB", "gbr": "GB", "united kingdom": "GB", "britain": "GB", "great britain": "GB",
    "ca": "CA", "can": "CA", "canada": "CA",
    "au": "AU", "aus": "AU", "australia": "AU",
    "de": "DE", "deu": "DE", "germany": "DE",
    "fr": "FR", "fra": "FR", "france": "FR",
    "it": "IT", "ita": "IT", "italy": "IT",
    "es": "ES", "esp": "ES", "spain": "ES",
    "mx": "MX", "mex": "MX", "mexico": "MX",
    "br": "BR", "bra": "BR", "brazil": "BR",
    "sg": "SG", "sgp": "SG", "singapore": "SG",
    "ae": "AE", "uae": "AE", "united arab emirates": "AE",
    "jp": "JP", "jpn": "JP", "japan": "JP",
    "nz": "NZ", "nzl": "NZ", "new zealand": "NZ",
}
# Calling code, trunk prefix and national lengths per country.
NUMBERING = {
    "US": ("1", "1", 10, 10), "CA": ("1", "1", 10, 10), "IN": ("91", "0", 10, 10), "GB": ("44", "0", 9, 10),
    "AU": ("61", "0", 9, 9), "DE": ("49", "0", 6, 13), "FR": ("33", "0", 9, 9), "IT": ("39", "", 6, 12),
    "ES": ("34", "", 9, 9), "MX": ("52", "", 10, 10), "BR": ("55", "0", 10, 11), "SG": ("65", "", 8, 8),
    "AE": ("971", "0", 8, 9), "JP": ("81", "0", 9, 10), "NZ": ("64", "0", 8, 10),
}
# Abbreviations of street words.
STREET_WORDS = {
    "st": "street", "str": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "rd": "road",
    "dr": "drive", "ln": "lane", "ct": "court", "pl": "place", "sq": "square", "ste": "suite", "fl": "floor",
    "hwy": "highway", "pkwy": "parkway", "ter": "terrace", "cir": "circle",
}
# Query parameters that only track traffic.
TRACKING = [
    "ref", "fbclid", "gclid", "gclsrc", "dclid", "msclkid", "mc_cid", "mc_eid", "_ga", "_gl", "yclid", "igshid",
    "_openstat", "vero_id", "wickedid", "oly_anon_id", "oly_enc_id", "rb_clickid", "s_cid", "ml_subscriber",
    "ml_subscriber_hash", "entry", "g_ep",
]
# Fixed value: legal designators at the end of a name.
LEGAL_SUFFIX = r"(?i)( +(pvt\.? *ltd\.?|private +limited|ltd\.?|llp|llc|inc\.?|incorporated|corporation|corp\.?|co\.?|limited))+$"
# Secrets and what they are replaced by, in this order.
SECRETS = [
    (r"(?i)Bearer\s+[A-Za-z0-9._-]+", "Bearer [REDACTED]"),
    (r"(?i)Authorization\s*:\s*Bearer\s*[A-Za-z0-9._-]+", "Authorization: Bearer [REDACTED]"),
    (r"(?i)api[_-]?key\s*[:=]\s*['\"]?[A-Za-z0-9._-]+", "api_key=[REDACTED]"),
    (r"(?i)x-api-key\s*[:=]\s*['\"]?[A-Za-z0-9._-]+", "x-api-key=[REDACTED]"),
    (r"(?i)sk-[A-Za-z0-9]{8,}", "[REDACTED]"),
    (r"(?i)cookie\s*[:=]\s*[^;\n]+", "cookie=[REDACTED]"),
    (r"(?i)set-cookie\s*[:=]\s*[^;\n]+", "set-cookie=[REDACTED]"),
]


def lookup(c: Column, table: dict[str, str]) -> Column:
    """The value of a small fixed table, null where it has none."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def strip_object_text(c: Column) -> Column:
    """Text left by a failed conversion is no value."""
    return F.when(~trim_blank(c).isin("[object Object]", "[object Array]"), c)


def parse_structure(c: Column) -> Column:
    """JSON text as a variant, null for other text and bad JSON."""
    return F.when(trim_blank(c).rlike(r"^[{\[]"), F.try_parse_json(c))


def country_code(c: Column) -> Column:
    """Two-letter code of a country name, alias or code."""
    clean = F.lower(trim_blank(c))
    return F.coalesce(lookup(clean, COUNTRY_CODES), F.when(clean.rlike("^[a-z]{2}$"), F.upper(clean)))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _national(number: Column, code: Column) -> Column:
    """+code and national number if its length fits the country's plan."""
    out = F.lit(None).cast("string")
    for country, (calling, trunk, low, high) in NUMBERING.items():
        bare = F.regexp_replace(number, f"^{trunk}", "") if trunk and trunk != "1" else number
        if trunk == "1":
            bare = F.when(F.length(number) == 11, F.regexp_replace(number, "^1", "")).otherwise(number)
        fits = F.length(bare).between(low, high)
        if calling == "1":
            fits = bare.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$")
        out = F.when((code == country) & fits, F.concat(F.lit(f"+{calling}"), bare)).otherwise(out)
    return out


def _international(number: Column) -> Column:
    """+digits if they open with a known calling code and fit its plan."""
    plans = ["1[2-9][0-9]{2}[2-9][0-9]{6}"]
    plans += [f"{calling}[0-9]{{{low},{high}}}" for calling, _, low, high in sorted(set(NUMBERING.values())) if calling != "1"]
    return F.when(number.rlike(f"^({'|'.join(plans)})$"), F.concat(F.lit("+"), number))


def normalize_phone(raw: Column, country: Column | None = None) -> Column:
    """E.164 of a phone. An explicit + or 00 first, then the given country,
    then eleven digits that open with 1; a country is never invented. Numbers are
    checked by the length plan of fifteen countries, not by assigned ranges."""
    t, d = trim_blank(raw), digits(raw)
    explicit = F.when(t.startswith("+") | t.rlike(r"^tel:\+"), _international(d))
    hinted = _national(d, country_code(country)) if country is not None else F.lit(None).cast("string")
    double_zero = F.when(d.startswith("00"), _international(F.substring(d, 3, 20)))
    eleven = F.when((F.length(d) == 11) & d.startswith("1"), _international(d))
    return F.coalesce(explicit, double_zero, hinted, eleven)


def phone_equivalence_key(c: Column) -> Column:
    """Digits, without the leading 1 of eleven."""
    d = digits(c)
    return F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)


def normalize_website(c: Column) -> Column:
    """Https:// added where no scheme stands, fragment dropped; null if it is
    no http(s) URL with a host. Scheme and host are lower-cased and a root path is
    added; percent-encoding is left as it is."""
    t = trim_blank(c)
    full = F.when(F.lower(t).startswith("http"), t).otherwise(F.concat(F.lit("https://"), t))
    bare = F.regexp_replace(full, "#.*$", "")
    parts = r"^([hH][tT][tT][pP][sS]?)://([^/?# ]+)([^# ]*)$"
    rest = F.regexp_extract(bare, parts, 3)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    url = F.concat(F.lower(F.regexp_extract(bare, parts, 1)), F.lit("://"), F.lower(F.regexp_extract(bare, parts, 2)), rest)
    return F.when((t != "") & bare.rlike(parts), url)


def normalize_domain(c: Column) -> Column:
    """Lower-case host without www."""
    host = F.regexp_extract(F.lower(trim_blank(c)), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@ ]*@)?([^/?#: ]+)", 1)
    return F.when(host != "", F.regexp_replace(host, r"^www\.", ""))


def normalize_url(c: Column) -> Column:
    """The cache key of a URL: host in lower case without www, map pages on
    one host, tracking parameters out, the others in lower case and order, no
    fragment, no trailing slash but the root's. Other text is only trimmed.
    Idempotent."""
    t = trim_blank(c)
    bare = F.regexp_replace(t, "#.*$", "")
    parts = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]+)([^?]*)\??(.*)$"
    scheme, path, query = F.lower(F.regexp_extract(bare, parts, 1)), F.regexp_extract(bare, parts, 3), F.regexp_extract(bare, parts, 4)
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, parts, 2)), r"^www\.", "")
    host = F.when(host.isin("maps.google.com", "google.com") & path.rlike("(?i)^/(maps|place|search)(/|$)"), F.lit("maps.google.com")).otherwise(host)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    name = lambda p: F.lower(F.split(p, "=", 2)[0])
    kept = F.filter(pairs, lambda p: ~name(p).startswith("utm_") & ~name(p).isin(*TRACKING))
    lowered = F.transform(kept, lambda p: F.concat(name(p), F.lit("="), F.regexp_replace(p, "^[^=]*=?", "")))
    joined = F.array_join(F.array_sort(lowered), "&")
    path = F.when(path == "", F.lit("/")).when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)
    url = F.concat(scheme, F.lit("://"), host, path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(F.lit("")))
    return F.when(bare.rlike(parts), url).otherwise(t)


def address_tokens(c: Column) -> Column:
    """Lower-case words of an address with street abbreviations written out."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), f"[.,#]|{BLANK}", " "), " +"), lambda w: w != "")
    return F.transform(words, lambda w: F.coalesce(lookup(w, STREET_WORDS), w))


def normalize_address(c: Column) -> Column:
    joined = F.array_join(address_tokens(c), " ")
    return F.when(joined != "", joined)


def split_list(c: Column) -> Column:
    """Trimmed distinct items of a text list, order kept."""
    return F.array_distinct(F.filter(F.transform(F.split(c, "[,;]"), trim_blank), lambda x: x != ""))


def social_links(c: Column) -> Column:
    """Distinct http(s) URLs of an array."""
    return F.array_distinct(F.filter(F.transform(c, trim_blank), lambda x: x.rlike("(?i)^https?://[^/ ]+")))


def comparison_form(path: Column, value: Column) -> Column:
    """The form in which values of a field are compared."""
    items = F.array_join(F.array_sort(split_list(value)), "\u0000")
    return (
        F.when(path.isin("categories", "services", "products", "amenities", "social_links"), items)
        .when(path.contains("phone"), normalize_phone(value))
        .when(path.contains("website"), normalize_website(value))
        .when(path.contains("name") | path.contains("address") | path.contains("category"), F.lower(trim_blank(value)))
        .otherwise(trim_blank(value))
    )


def values_equivalent(path: Column, a: Column, b: Column) -> Column:
    """Equal, or equal phone keys, or equal comparison forms. Null equals
    only null; two values without comparison form are equal."""
    phones = path.contains("phone") & (phone_equivalence_key(a) == phone_equivalence_key(b)) & (digits(a) != "")
    both = a.isNotNull() & b.isNotNull()
    return F.coalesce((a.isNull() & b.isNull()) | (both & ((a == b) | phones | comparison_form(path, a).eqNullSafe(comparison_form(path, b)))), F.lit(False))


def strip_legal_suffix(c: Column) -> Column:
    """A name without legal designators at its end, stacked ones too."""
    return trim_blank(F.regexp_replace(trim_blank(c), LEGAL_SUFFIX, ""))


def search_name(c: Column) -> Column:
    """A name for searching: cut at ' - ', then without legal suffix."""
    return strip_legal_suffix(F.regexp_replace(trim_blank(c), "(?s)^(.+?) - .*$", "$1"))


def match_form(c: Column) -> Column:
    """Zero-width characters out, blanks collapsed, lower case."""
    return F.lower(collapse_blank(F.regexp_replace(c, r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]", "")))


def redact_secrets(c: Column) -> Column:
    """Tokens, keys and cookies out of a text."""
    for pattern, replacement in SECRETS:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def remove_first(c: Column, pattern: str) -> Column:
    """Drops the first match only, then collapses blanks."""
    return collapse_blank(F.regexp_replace(c, f"(?s)^(.*?)(?:{pattern})(.*)$", "$1$2"))


def fuzzy_similarity(a: Column, b: Column) -> Column:
    """1 if equal without case; .8 and up if the first three letters are
    equal; else the share of common letters."""
    x, y = F.lower(trim_blank(a)), F.lower(trim_blank(b))
    shortest, longest = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    p, q = F.array_distinct(F.split(x, "")), F.array_distinct(F.split(y, ""))
    letters = F.size(F.array_intersect(p, q)) / F.size(F.array_union(p, q))
    head = F.least(F.lit(3), shortest)
    return (
        F.when(x.isNull() | y.isNull() | (x == "") | (y == ""), 0.0)
        .when(x == y, 1.0)
        .when(F.expr("true") & (x.substr(F.lit(1), head) == y.substr(F.lit(1), head)), F.lit(0.8) + F.lit(0.2) * shortest / longest)
        .otherwise(letters)
    )


def parse_comma_address(c: Column) -> Column:
    """Street, city, state, postal code and country of 'street, city, ST ZIP, country'."""
    parts = F.filter(F.transform(F.split(c, ","), trim_blank), lambda x: x != "")
    third = F.get(parts, F.lit(2))
    zipped = r"^([A-Za-z]{2})[ ]+([0-9]{5}(?:-[0-9]{4})?)$"
    return F.struct(
        F.get(parts, F.lit(0)).alias("street"),
        F.get(parts, F.lit(1)).alias("city"),
        F.when(third.rlike(zipped), F.regexp_extract(third, zipped, 1)).otherwise(third).alias("state"),
        F.when(third.rlike(zipped), F.regexp_extract(third, zipped, 2)).alias("postal_code"),
        F.get(parts, F.lit(3)).alias("country"),
    )


def clip(c: Column, n: int = 80) -> Column:
    """At most n characters and an ellipsis."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def dedupe_key(place_id: Column, url: Column, name: Column, address: Column) -> Column:
    """The identity a delivered record is known by."""
    low = lambda x: F.lower(trim_blank(x))
    full = lambda x: x.isNotNull() & (trim_blank(x) != "")
    return (
        F.when(full(place_id), F.concat(F.lit("place:"), trim_blank(place_id)))
        .when(full(url), F.concat(F.lit("url:"), trim_blank(url)))
        .when(full(name) & full(address), F.concat(F.lit("nameaddr:"), low(name), F.lit("|"), low(address)))
        .when(full(name), F.concat(F.lit("name:"), low(name)))
    )


def pair_key(a: Column, b: Column, kind: Column) -> Column:
    """The review key of a pair, whichever way it is turned."""
    return F.concat_ws("|", F.lit("pair"), F.least(a, b), F.greatest(a, b), kind)


def slug(c: Column) -> Column:
    """A name as part of a path."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "['’]", ""), "[^a-z0-9]+", "-")
    s = F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, 60)
    return F.when(s != "", s).otherwise(F.lit("business"))
