"""Alternations that filter files name as macros. Dictionaries such as towns, genes or names of people are lists of the caller."""

from __future__ import annotations

import re

_DAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
#: Letters after which the name of a day may end.
_DAY_STEMS = {"Tuesday": 4, "Thursday": 5}
_SEASONS = ("Spring", "Fall", "Autumn", "Winter", "Summer")
_ORDINALS = ("First", "Second", "Third", "Fourth", "Fifth", "Sixth", "Seventh", "Eighth", "Ninth", "Tenth", "Eleventh", "Twelfth", "Thirteenth", "Fourteenth", "Fifteenth", "Sixteenth", "Seventeenth", "Eighteenth", "Nineteenth", "Twentieth")
#: States, the district and Puerto Rico with their codes, by the postal service's table, in alphabetical order.
STATES = {
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR", "California": "CA", "Colorado": "CO", "Connecticut": "CT", "Delaware": "DE", "District of Columbia": "DC", "Florida": "FL",
    "Georgia": "GA", "Hawaii": "HI", "Idaho": "ID", "Illinois": "IL", "Indiana": "IN", "Iowa": "IA", "Kansas": "KS", "Kentucky": "KY", "Louisiana": "LA", "Maine": "ME", "Maryland": "MD",
    "Massachusetts": "MA", "Michigan": "MI", "Minnesota": "MN", "Mississippi": "MS", "Missouri": "MO", "Montana": "MT", "Nebraska": "NE", "Nevada": "NV", "New Hampshire": "NH", "New Jersey": "NJ",
    "New Mexico": "NM", "New York": "NY", "North Carolina": "NC", "North Dakota": "ND", "Ohio": "OH", "Oklahoma": "OK", "Oregon": "OR", "Pennsylvania": "PA", "Puerto Rico": "PR", "Rhode Island": "RI",
    "South Carolina": "SC", "South Dakota": "SD", "Tennessee": "TN", "Texas": "TX", "Utah": "UT", "Vermont": "VT", "Virginia": "VA", "Washington": "WA", "Washington D.C.": "DC", "West Virginia": "WV",
    "Wisconsin": "WI", "Wyoming": "WY",
}
#: Holidays by public calendars: federal ones and other days in the order of the year, then feasts of several faiths; what is in parentheses may be missing, as may apostrophes and full stops.
HOLIDAYS = (
    "New Year's( Day)", "Martin Luther King(, Jr.)( Day)", "MLK( Day)", "Groundhog Day", "Lincoln's Birthday", "Valentine's( Day)", "Presidents' Day", "President's Day", "Washington's Birthday", "Saint Patrick's Day", "St. Patrick's Day",
    "April Fools'( Day)", "April Fool's Day", "Earth Day", "Arbor Day", "Cinco de Mayo", "Mother's Day", "Memorial Day", "Flag Day", "Juneteenth", "Father's Day", "Independence Day", "Fourth of July", "4th of July", "July Fourth",
    "July 4th", "Labor Day", "Columbus Day", "Indigenous Peoples' Day", "Halloween", "Election Day", "Veterans Day", "Veteran's Day", "Armistice Day", "Remembrance Day", "Thanksgiving( Day)", "Black Friday", "Christmas Eve",
    "Christmas( Day)", "Boxing Day", "Kwanzaa", "New Year's Eve", "Epiphany", "Mardi Gras", "Shrove Tuesday", "Ash Wednesday", "Palm Sunday", "Maundy Thursday", "Good Friday", "Easter( Sunday)( Monday)", "Ascension Day", "Pentecost",
    "All Saints' Day", "All Souls' Day", "Purim", "Passover", "Shavuot", "Rosh Hashanah", "Rosh Hashana", "Yom Kippur", "Sukkot", "Simchat Torah", "Hanukkah", "Chanukah", "Ramadan", "Eid al-Fitr", "Eid al-Adha", "Muharram", "Ashura",
    "Diwali", "Holi", "Vesak", "Chinese New Year", "Lunar New Year", "Qingming( Festival)",
)
#: Endings of street names and what the postal service shortens them to, in alphabetical order.
STREETS = {
    "alley": "aly", "avenue": "ave", "bayou": "byu", "beach": "bch", "bend": "bnd", "bluff": "blf", "boulevard": "blvd", "branch": "br", "bridge": "brg", "brook": "brk", "bypass": "byp", "canyon": "cyn", "causeway": "cswy",
    "center": "ctr", "circle": "cir", "cliffs": "clfs", "corner": "cor", "court": "ct", "cove": "cv", "creek": "crk", "crescent": "cres", "crossing": "xing", "drive": "dr", "estates": "ests", "expressway": "expy", "extension": "ext",
    "freeway": "fwy", "garden": "gdn", "gateway": "gtwy", "glen": "gln", "green": "grn", "grove": "grv", "harbor": "hbr", "heights": "hts", "highway": "hwy", "hill": "hl", "hills": "hls", "hollow": "holw", "island": "is",
    "junction": "jct", "knoll": "knl", "lake": "lk", "landing": "lndg", "lane": "ln", "lodge": "ldg", "manor": "mnr", "meadows": "mdws", "mill": "ml", "mountain": "mtn", "orchard": "orch", "parkway": "pkwy", "pine": "pne", "place": "pl",
    "plaza": "plz", "point": "pt", "ranch": "rnch", "ridge": "rdg", "river": "riv", "road": "rd", "route": "rte", "shore": "shr", "springs": "spgs", "square": "sq", "station": "sta", "street": "st", "summit": "smt", "terrace": "ter",
    "trace": "trce", "trail": "trl", "turnpike": "tpke", "valley": "vly", "view": "vw", "village": "vlg", "vista": "vis",
}
_WHOLE_STREETS = ("loop", "oval", "park", "pass", "path", "pike", "row", "run", "walk", "way")
_UNITS = {"apartment": "apt", "building": "bldg", "floor": "fl", "room": "rm", "suite": "ste", "unit": "unit"}


def _holiday(name: str) -> str:
    """A holiday as a regex: parentheses may be missing, as may apostrophes, full stops and commas."""
    out = re.sub(r"\(([^)]*)\)", r"(?:\1)?", name.lower())
    return out.replace("'", "'?").replace(".", "\\.?").replace(",", ",?")


def alternation(words) -> str:
    """Words of a dictionary as an alternation, taken as written, the longest first; none match nothing."""
    return "|".join(re.escape(w) for w in sorted(set(words), key=lambda w: (-len(w), w))) or "(?!)"


def _cased(word: str) -> str:
    """The word with either case of its first letter, or all in capitals; for several words each by itself."""
    return "[ ]".join(f"[{w[0].upper()}{w[0].lower()}]{w[1:]}" for w in word.replace(".", r"\.").split(" ")) + "|" + word.upper().replace(".", r"\.")


def _abbreviated(name: str, stem: int, plural: str = "") -> str:
    """The name or its first letters, with either case of the first letter or all in capitals, longest first."""
    short, rest = name[:stem], name[stem:]
    first = f"[{name[0]}{name[0].lower()}]{short[1:]}"
    end = lambda x, s: (f"(?:{x})?" if x else "") + (f"{s}?" if s else "")
    return f"{first}{end(rest, plural)}|{short.upper()}{end(rest.upper(), plural.upper())}"


def macros(more: dict[str, str] | None = None, words: dict[str, list[str]] | None = None) -> dict[str, str]:
    """Name to alternation, for `patterns.expand`; more adds some or takes their place, words makes some of dictionaries (as town_names or gene_symbols)."""
    from ..functions.dates import _ONES, _TENS

    days = "|".join(_abbreviated(d, _DAY_STEMS.get(d, 3), "s") for d in _DAYS) + "|Tue|Thu"
    months = "|".join(_abbreviated(m, 3) for m in _MONTHS) + "|Sept|SEPT"
    suffix = lambda n: "th" if 10 < n < 14 else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")
    states = "|".join(sorted({x for n, c in STATES.items() for x in (_cased(n).split("|")[0], c)}, key=lambda x: (-len(x), x)))
    street = [x for n, c in (STREETS | _UNITS).items() for x in (n, c)] + [*_WHOLE_STREETS]
    return {
        "day_name": days, "month_name": months, "day_numbering": "|".join(f"{n}{suffix(n)}" for n in range(50, 0, -1)), "seasons": "|".join(map(_cased, _SEASONS)) + "|[Cc]hristmas|[Nn]ew [Yy]ear's [Ee]ve",
        "state_names": states, "state_name": states, "full_numbering": "|".join(sorted(_ORDINALS, key=len, reverse=True)), "address_indicator": alternation(street),
        "holidays": "|".join(sorted(map(_holiday, HOLIDAYS), key=lambda x: (-len(x), x))), "teens": "|".join(_ONES[10:]), "decades_lt_90": "|".join(_TENS[:-1]), "ones": "|".join(_ONES[1:10]),
    } | {name: alternation(w) for name, w in (words or {}).items()} | (more or {})
