"""Predicates and verdicts on field values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from amalgam.functions.compat import trim_blank
from amalgam.functions.geo import valid_position
from amalgam.functions.text import digits, normalize_phone, normalize_website

# Hosts that list businesses.
DIRECTORY_HOSTS = [
    "facebook.com", "instagram.com", "twitter.com", "x.com", "linkedin.com", "yelp.com", "yelp.ca", "tripadvisor.com",
    "tripadvisor.in", "google.com", "google.co.in", "googlemaps.com", "maps.google.com", "justdial.com", "sulekha.com",
    "india-mart.com", "indiamart.com", "yellowpages.com", "yellowpages.in", "manta.com", "fourquare.com", "foursquare.com",
    "angieslist.com", "angislist.com",
]
# Locality words.
_LOCALITIES = "nagar|colony|sector|phase|block|chowk|basti|mohalla|gram|gaon"
_STREET_WORDS = rf"(street|st\.?|road|rd\.?|lane|ln\.?|avenue|ave\.?|boulevard|blvd\.?|drive|dr\.?|highway|hwy\.?|{_LOCALITIES})"
_WORD_END = "([^A-Za-z0-9_]|$)"
# Field paths whose machine-made values must carry evidence.
EVIDENCE_PATHS = ["identity.name", "contact.phone", "contact.website", "location.full_address", "location.coordinates", "ratings.rating", "ratings.review_count"]


def rating_in_range(r: Column) -> Column:
    return r.between(0, 5)


def strict_rating(r: Column) -> Column:
    """ratings from 1 to 5, to one place."""
    return F.when(r.between(1, 5), F.floor(r * F.lit(10.0) + F.lit(0.5)) / F.lit(10.0))


def valid_count(c: Column) -> Column:
    """a non-negative whole number, with or without thousands commas."""
    n = F.regexp_replace(c.cast("string"), ",", "").try_cast("double")
    return F.coalesce((n >= 0) & (n == F.floor(n)), F.lit(False))


def non_phone_signal(c: Column) -> Column:
    """positions, plus codes, postal codes, short and one-digit numbers."""
    t, d = trim_blank(c), digits(c)
    return F.coalesce(
        (t == "") | t.rlike(r"^-?\d+\.\d+\s*,\s*-?\d+\.\d+$") | t.rlike(r"(?i)^[A-Z0-9]{4,}\+[A-Z0-9]{2,}$") | t.rlike(r"^\d{5,6}(-\d{4})?$") | (F.length(d) < 7) | d.rlike(r"^(\d)\1+$"),
        F.lit(True),
    )


def phone_status(raw: Column, country: Column | None = None) -> Column:
    """struct of value, status and reason."""
    value = normalize_phone(raw, country)
    empty = raw.isNull() | (raw == "")
    status = F.when(empty, "missing").when(non_phone_signal(raw), "rejected").when(value.isNotNull(), "valid").otherwise("unresolved")
    reason = F.when(empty, "no_value").when(non_phone_signal(raw), "non_phone_signal").when(value.isNull(), "cannot_normalize")
    return F.struct(F.when(status == "valid", value).alias("value"), status.alias("status"), reason.alias("reason"))


def valid_email(c: Column) -> Column:
    """F6."""
    t = trim_blank(c)
    bad = (
        t.rlike(r"(?i)(^|\s)(test|example|user|someone|yourname|your-name)@")
        | t.rlike(r"(?i)@(example|test|localhost|invalid|yourdomain|your-domain|domain)\.")
        | t.contains("..") | t.contains("@.") | t.endswith(".") | t.startswith(".")
    )
    return F.coalesce(~bad & t.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), F.lit(False))


def website_status(c: Column, official: list[str] | None = None) -> Column:
    """a directory's host is matched as a substring; known official hosts pass."""
    url = normalize_website(c)
    host = F.regexp_extract(url, r"^https?://([^/?]+)", 1)
    listed = F.lit(False)
    for s in DIRECTORY_HOSTS:
        listed = listed | host.contains(s)
    known = host.isin(*[h.lower() for h in official]) if official else F.lit(False)
    return F.when(c.isNull() | (trim_blank(c) == ""), "missing").when(url.isNull(), "rejected").when(listed & ~known, "rejected_directory").otherwise("valid")


def opens_like_street(c: Column) -> Column:
    """F8, first form: a house number opens the text."""
    return trim_blank(c).rlike(rf"(?i)^(no\.?\s*|#\s*)?\d{{1,5}}[a-z]?{_WORD_END}")


def street_like(c: Column) -> Column:
    """F8: house number first, street word with number, or number with locality."""
    t = trim_blank(c)
    return F.coalesce(
        opens_like_street(c)
        | t.rlike(rf"(?i){_STREET_WORDS}\s*(no\.?\s*|#\s*)?\d{{1,5}}[a-z]?{_WORD_END}")
        | t.rlike(rf"(?i)\d{{1,5}}[a-z]?\s+({_LOCALITIES}|village|township|estate){_WORD_END}"),
        F.lit(False),
    )


def evidence_gate(kind: Column, path: Column, snippet: Column, evidence_id: Column) -> Column:
    """true where a machine-made identity value carries no evidence."""
    return (kind == "ai_generated") & path.isin(*EVIDENCE_PATHS) & snippet.isNull() & evidence_id.isNull()


def swapped_numbers(rating: Column, reviews: Column) -> Column:
    """rating and review count hold one number."""
    return F.coalesce(rating == reviews.cast("double"), F.lit(False))


def populated(c: Column, kind: str = "string") -> Column:
    """null, '', [] and {} are empty; 0 and false are values."""
    if kind in ("array", "map"):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return c.isNotNull() & (c != "") if kind == "string" else c.isNotNull()


def may_replace_weak(existing: Column, incoming: Column, identity: Column, floor: float, minimum: float = 0.7) -> Column:
    """a weak value gives way to one that clears the bar (0.8 for identity fields)."""
    bar = F.when(identity, F.lit(max(minimum, 0.8))).otherwise(F.lit(minimum))
    return F.coalesce((existing < floor) & (incoming >= bar), F.lit(False))


def synthetic_name(c: Column) -> Column:
    """placeholders and identifiers in the place of a name."""
    t = trim_blank(c)
    return t.rlike("(?i)^(unknown business|unknown|n/a|na|unnamed business|unnamed)$") | t.rlike(
        r"^(ChIJ[A-Za-z0-9_-]+|(?i:cid:?)\s*\d+|\d{10,20}|0x[0-9a-fA-F]+:0x[0-9a-fA-F]+)$"
    )


def record_conflicts(a: str, b: str) -> Column:
    """F16: names of the fields in which two records exclude each other: city,
    state, postal code, coordinates more than 0.35 degrees apart, provider id, and
    phones of seven digits or more. A field missing on a side excludes nothing."""
    x, y = (lambda c: F.col(f"{a}{c}")), (lambda c: F.col(f"{b}{c}"))
    low = lambda c: F.lower(trim_blank(c))
    differ = lambda c: (low(x(c)) != low(y(c))) & (low(x(c)) != "") & (low(y(c)) != "")
    far = F.hypot(x("latitude") - y("latitude"), x("longitude") - y("longitude")) > 0.35
    p, q = digits(x("phone")), digits(y("phone"))
    phones = (F.length(p) >= 7) & (F.length(q) >= 7) & (p != q)
    placed = valid_position(x("latitude"), x("longitude")) & valid_position(y("latitude"), y("longitude"))
    ids = (trim_blank(x("provider_record_id")) != trim_blank(y("provider_record_id"))) & (trim_blank(x("provider_record_id")) != "") & (trim_blank(y("provider_record_id")) != "")
    return F.array_compact(
        F.array(
            F.when(differ("city"), "city"), F.when(differ("state"), "state"), F.when(differ("postal_code"), "postalCode"), F.when(placed & far, "coordinates"),
            F.when(ids, "providerId"), F.when(phones, "phone"),
        )
    )


# Words by which a text without digits is still an address.
ADDRESS_WORDS = "(?i)[0-9]|street|road|ave|avenue|blvd|boulevard|rd|ln|lane|dr|drive|cir|pl|place|way|unit|suite|floor|hwy|highway|north|south|east|west|#"


def record_issues() -> Column:
    """fields of a provider record that can't stand in a final profile: name
    missing; category blank; phone not of 7 to 15 digits and pluses; website no
    http(s) URL; address over 300 characters or without digit and address word;
    position, rating or count out of range. Missing fields but the name pass."""
    blank = lambda c: trim_blank(F.col(c)) == ""
    n = F.length(F.regexp_replace("phone", "[^0-9+]", ""))
    address = F.col("full_address")
    unlike = blank("full_address") | (F.length(trim_blank(address)) > 300) | ~trim_blank(address).rlike(ADDRESS_WORDS)
    return F.array_compact(
        F.array(
            F.when(F.col("name").isNull() | blank("name"), "name"),
            F.when(blank("category"), "category"),
            F.when(blank("phone") | ~n.between(7, 15), "phone"),
            F.when(~F.col("website").rlike(r"(?i)^\s*https?:/*[^\s/?#]+"), "website"),
            F.when(unlike, "address"),
            F.when(F.abs("latitude") > 90, "latitude"),
            F.when(F.abs("longitude") > 180, "longitude"),
            F.when(~F.col("rating").between(0, 5), "rating"),
            F.when(F.col("review_count") < 0, "review_count"),
        )
    )


def envelope_wellformed(value: Column, provenance: Column, status: Column, confidence: Column, n_evidence: Column) -> Column:
    """an unknown fact is wholly unknown, a known one is not."""
    unknown = (provenance == "unknown") & (status == "missing") & (confidence == 0) & (n_evidence == 0)
    return F.when(value.isNull(), unknown).otherwise((provenance != "unknown") & (confidence > 0))


def noise_page(text: Column) -> Column:
    """error pages and shells that need scripts."""
    low = F.lower(text)
    return F.coalesce(
        (low.contains("server error") & low.contains("try again later")) | (low.contains("enable javascript") & (F.length(text) < 300)), F.lit(False)
    )


def blocked_url(c: Column) -> Column:
    """anything but https, local names and private addresses."""
    host = F.regexp_extract(F.lower(trim_blank(c)), r"^https://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]+)", 1)
    private = host.rlike(r"^(localhost|.*\.local(host)?|0\.0\.0\.0|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(1[6-9]|2\d|3[01])\..*|\[(::1|f[cd][0-9a-f]{2}:.*|fe80:.*)\])$")
    return F.coalesce((host == "") | private, F.lit(True))
