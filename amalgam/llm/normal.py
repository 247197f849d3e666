"""Canonical forms of names, phones and postal addresses as people write them."""

from __future__ import annotations

import html
import re
import unicodedata
from typing import NamedTuple

# Words and codes as they stand in names and addresses.
LEGAL_FORMS = {"ltd", "llc", "inc", "co", "corp", "gmbh", "ag", "kg", "plc", "limited", "company", "incorporated"}
LINK_WORDS = {"and", "of", "the", "und", "o", "a"}
NO_NAMES = {"unknown business", "unknown", "unnamed business", "unnamed", "business", "n a", "na", "not stated", "none", "null", ""}
NO_VALUES = {"", "-", "--", ".", "?", "n/a", "na", "none", "null", "unknown", "not stated", "not available", "tbd"}
STREET_TYPES = {
    "street": "st", "st": "st", "str": "st",
    "avenue": "ave", "ave": "ave", "av": "ave",
    "boulevard": "blvd", "blvd": "blvd", "boul": "blvd",
    "drive": "dr", "dr": "dr",
    "lane": "ln", "ln": "ln",
    "road": "rd", "rd": "rd",
    "court": "ct", "ct": "ct",
    "place": "pl", "pl": "pl",
    "square": "sq", "sq": "sq",
    "terrace": "ter", "ter": "ter", "terr": "ter",
    "highway": "hwy", "hwy": "hwy", "parkway": "pkwy", "pkwy": "pkwy", "circle": "cir", "cir": "cir", "way": "way", "alley": "aly",
}
BACK_TYPES = {"weg": "weg", "wg": "weg", "allee": "allee", "all": "allee", "strasse": "strasse", "str": "strasse", "platz": "platz", "pl": "platz", "gasse": "gasse"}
DIRECTIONS = {"n": "n", "north": "n", "no": "n", "s": "s", "south": "s", "so": "s", "e": "e", "east": "e", "w": "w", "west": "w"}
STATES = set(
    "al ak az ar ca co fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa ri sc sd tn tx ut vt va wa wv wi wy".split()
)
_COUNTRY = re.compile(r"\b(?:united states(?: of america)?|u\.s\.a\.?|u\.s\.|usa|us|germany|deutschland|de)(?=$|[\s,;()])")
_UNIT = re.compile(
    r"\b(?:apt|apartment|suite|ste|unit|room|rm)\b\.?\s*#?\s*\d+[a-z]?\b|#\s+\d+[a-z]?\b|\b\d+(?:st|nd|rd|th)\s+(?:floor|fl)\b\.?"
    r"|\b(?:floor|fl)\b\.?\s*\d+\b|\b\d+\.\s?(?:og|ug|stock|etage)\b|\b(?:hinterhaus|vorderhaus|seitenfluegel|eg|dg)\b"
)
_BACK = re.compile(r"^([a-z]{3,}?)(weg|wg|allee|all|strasse|str|platz|pl|gasse)$")
_HOUSE = re.compile(r"^\d{1,4}[a-z]?$")


_MARKS = {c: None for c in range(0x20000) if unicodedata.combining(chr(c))}


def fold(text: str) -> str:
    """Lower case ASCII with single spaces: marks, entities, odd spaces and quotes undone."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = re.sub("[’´‘ʼ]", "'", text).replace("ß", "ss").replace("ẞ", "ss")
        text = unicodedata.normalize("NFKD", text)
        text = text.translate(_MARKS)
    return " ".join(text.replace("`", "'").lower().split())


def name_tokens(name: str | None) -> tuple[str, ...] | None:
    """The words that tell a business: legal form, town after a separator, link
    words, possessive and plural endings left out. None if it is no real name."""
    if name is None:
        return None
    text = fold(name)
    text = re.split(r"\s+[-|–/]\s+|\s*\|\s*", text)[0]
    parts = [p.strip() for p in text.split(",")]
    text = parts[0]
    words = re.findall(r"[a-z0-9]+", re.sub(r"'s?(?![a-z])|'", "", text.replace("'s-", "' ")))
    if " ".join(words) in NO_NAMES or re.fullmatch(r"chij\S+|cid\d*|\d+|0x.*", "".join(words)):
        return None
    if any(w.isdigit() for w in words) and (p := parse_address(name)) and p.house and p.street:
        return None  # an address in the place of a name
    kept = [w for w in words if w not in LINK_WORDS]
    while len(kept) > 1 and (kept[-1] in LEGAL_FORMS or len(kept) > 3 and _near(kept[-1], LEGAL_FORMS)):
        kept.pop()
    if len(kept) > 2:  # link words with a slip stand inside a name
        kept = [w for i, w in enumerate(kept) if not 0 < i < len(kept) - 1 or not _slipped_link(w)]
    kept = [w.rstrip("s") or w if len(w) > 3 else w for w in kept]
    return tuple(kept) or None


def _slipped_link(word: str) -> bool:
    """Whether a short word is one edit from "and" or "the", or has the length of "of" and one edit to it."""
    if len(word) > 4:
        return False
    return any(within_one_edit(word, w) for w in ("and", "the")) or (len(word) <= 3 and within_one_edit(word, "of"))


def _near(word: str, words) -> bool:
    return any(len(w) > 2 and within_one_edit(word, w) for w in words)


def phone_key(phone: str | None) -> str | None:
    """The last ten digits, None for placeholders and shorter numbers."""
    if phone is None:
        return None
    digits = re.sub(r"\D", "", phone)
    if len(digits) < 10 or len(set(digits[-10:])) < 3 or len(digits) > 15:
        return None
    return digits[-10:]


class Place(NamedTuple):
    house: str
    direction: str
    street: str
    kind: str
    town: str
    zip: str


def parse_address(address: str | None) -> Place | None:
    """House number, direction, street, type, town and postal code of an address
    in either order (number first or last). None if it names none of them."""
    if address is None:
        return None
    text = fold(address.replace("\n", " , ").replace("\r", " "))
    if text in NO_VALUES:
        return None
    text = re.sub(r"[()]", " , ", text)
    text = _COUNTRY.sub(" , ", text)
    text = _UNIT.sub(" , ", text)
    text = re.sub(r"(\d{5})-\d{4}\b", r"\1", text)
    text = re.sub(r"(?:\b(?:no|nr|nummer)\b\.?\s*|#)(?=\d)", " ", text)
    text = re.sub(r"\s-\s|[;/|]", " , ", text)
    text = re.sub(r"(?<=[a-z])-(?=[a-z])", " ", text)
    segments = [re.findall(r"[a-z0-9']+", s) for s in text.split(",")]
    tokens: list[str | None] = []
    for s in segments:
        if s:
            tokens += [*s, None]  # None stands for a border
    tokens = tokens[:-1]
    used = [t is None for t in tokens]
    zip_code = state = ""
    for i, t in enumerate(tokens):
        if t and re.fullmatch(r"\d{5}", t) and not zip_code:
            zip_code, used[i] = t, True
    for i, t in enumerate(tokens):
        if not t or used[i] or t not in STATES:
            continue
        after = tokens[i + 1] if i + 1 < len(tokens) else None
        ends = i + 2 >= len(tokens) or tokens[i + 2] is None  # else a short number is the house's
        if after and re.fullmatch(r"\d{5}" if not ends else r"\d{3,5}", after) and (used[i + 1] or not zip_code):
            state, used[i] = t, True
            if not used[i + 1]:
                zip_code, used[i + 1] = after.zfill(5), True
        elif not state and i and (after is None or _HOUSE.match(after)):
            state, used[i] = t, True
    if not zip_code:  # a number alone between borders, where another can be the house's
        for i, t in enumerate(tokens):
            alone = (not i or tokens[i - 1] is None) and (i + 1 == len(tokens) or tokens[i + 1] is None)
            if t and not used[i] and alone and re.fullmatch(r"\d{3,4}", t) and sum(bool(x and _HOUSE.match(x)) for x in tokens) > 1:
                zip_code, used[i] = t.zfill(5), True
                break
    house = direction = street = kind = ""
    # Number last: the street word carries its type.
    for i, t in enumerate(tokens):
        if not t or used[i]:
            continue
        m = _BACK.match(t)
        number = tokens[i + 1] if i + 1 < len(tokens) and not used[i + 1] else None
        before = tokens[i - 1] if i and not used[i - 1] else None
        if number and _HOUSE.match(number):
            if m:
                street, kind, house = m[1], BACK_TYPES[m[2]], number
            elif t in BACK_TYPES and before and before.isalpha() and not (i > 1 and tokens[i - 2] and _HOUSE.match(tokens[i - 2])):
                street, kind, house = before, BACK_TYPES[t], number
                used[i - 1] = True
            else:
                continue
            used[i] = used[i + 1] = True
            break
    if not house:
        for i, t in enumerate(tokens):
            if not t or used[i] or not _HOUSE.match(t):
                continue
            at, words = i + 1, []
            if at < len(tokens) and tokens[at] in DIRECTIONS and at + 1 < len(tokens) and tokens[at + 1] is not None:
                direction, at = DIRECTIONS[tokens[at]], at + 1
            while at < len(tokens) and tokens[at] is not None and not used[at]:
                if words and tokens[at] in STREET_TYPES:
                    kind = STREET_TYPES[tokens[at]]
                    at += 1
                    break
                if words and tokens[at] in DIRECTIONS:
                    break
                words.append(tokens[at])
                at += 1
            if not words:
                direction = ""
                continue
            if at < len(tokens) and tokens[at] in DIRECTIONS and not direction:
                direction, at = DIRECTIONS[tokens[at]], at + 1
            if not kind and len(words) > 1:  # a town may follow without a border, or the type has a slip
                slipped = next((v for k, v in STREET_TYPES.items() if len(k) > 3 and within_one_edit(k, words[1])), "")
                keep = 2 if slipped else 1
                kind, at, words = slipped, at - len(words) + keep, words[:1]
            house, street = t, "".join(words)
            used[i:at] = [True] * (at - i)
            break
    town = "".join(t for i, t in enumerate(tokens) if not used[i] and t and t.isalpha() and t not in STREET_TYPES or (t and not used[i] and "'" in t))
    if not (house or street or town or zip_code):
        return None
    return Place(house.lstrip("0"), direction, street, kind, town, zip_code)


def within_one_edit(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def same_slipped(a: str, b: str) -> bool:
    """Equal but for slips: one edit, two in words of ten letters or more."""
    if within_one_edit(a, b):
        return True
    if min(len(a), len(b)) < 10 or abs(len(a) - len(b)) > 2:
        return False
    return edit_distance(a, b, 2) <= 2


def edit_distance(a: str, b: str, most: int) -> int:
    """Edits incl. swaps of neighbours, most + 1 if more than ``most``."""
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, two[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)
