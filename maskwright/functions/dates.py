"""Dates with missing parts, shifts and ages as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
_D, _Y, _YY = r"(\d{1,2})", r"(\d{4})", r"'?(\d{2})"
#: Forms of a cleaned text (see _cleaned), in order: its pattern, which parts its groups are, and which parts it lacks.
LADDER = (
    (rf"{_Y}[-/.]{_D}[-/.]{_D}", "ymd", ""),
    (rf"{_D}[-/.]{_D}[-/.]{_Y}", "mdy", ""),
    (rf"{_D}[-/.]{_D}[-/.]{_YY}", "mdy", "century"),
    (rf"{_MONTH}[- ]{_D}[- ]{_Y}", "mdy", ""),
    (rf"{_D}[- ]?{_MONTH}[- ]?{_Y}", "dmy", ""),
    (rf"{_Y}[- ]{_MONTH}[- ]{_D}", "ymd", ""),
    (rf"{_MONTH} {_D} '(\d{{2}})", "mdy", "century"),
    (rf"{_D}[- ]{_MONTH}[- ]{_YY}", "dmy", "century"),
    (rf"{_MONTH}[- ]?{_Y}", "my", "day"),
    (rf"{_Y}[- ]{_MONTH}", "ym", "day"),
    (rf"{_MONTH} '(\d{{2}})", "my", "day century"),
    (rf"{_MONTH} {_D}", "md", "year"),
    (rf"{_D}[- ]?{_MONTH}", "dm", "year"),
    (_MONTH, "m", "year day"),
    (rf"{_D}[/-]{_Y}", "my", "day"),
    (rf"{_Y}[/-]{_D}", "ym", "day"),
    (rf"{_D}[/-]{_D}", "md", "year"),
    (_Y, "y", "month day"),
    (r"'(\d{2})", "y", "month day century"),
)
#: A year that a text lacks is taken to be this one, a leap year, as that of BASE; a month or day the first.
BASE = "2000-02-29"
_PARTS = ("year", "month", "day", "century")
_PARTIAL = "struct<d:date,raw:string,missing_year:boolean,missing_month:boolean,missing_day:boolean,missing_century:boolean>"


def _cleaned(text: Column) -> Column:
    """A written date without the name of its weekday, endings of ordinals, commas, `of` and `the`, and the time of day; spaces single."""
    out = F.regexp_replace(text, r"(?i)^\s*(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\b[.,]*\s*", "")
    out = F.regexp_replace(out, r"(?i)(?<=\d)(?:st|nd|rd|th)\b", "")
    out = F.regexp_replace(out, r"(?i)[\sT]+\d{1,2}:\d{2}(?::\d{2})?(?:\s*[ap]\.?m\.?)?\s*$", "")
    out = F.regexp_replace(out, r"(?i)\b(?:of|the)\b|,", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def _month(x: Column) -> Column:
    place = F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(x, 1, 3)))
    return F.when(x.rlike("^[A-Za-z]"), ((place + 2) / 3).cast("int").cast("string")).otherwise(x)


def parse(text: Column) -> Column:
    """struct(d date, raw, missing_year, missing_month, missing_day, missing_century) of a written date; null if no form fits or there is no such day.

    Month and day in figures are taken in that order, and in the other where the first can't be
    a month. Two figures of a year are of this century and tell no century.
    """
    return let(_cleaned(text), lambda clean: _parsed(clean, text))


def _parsed(clean: Column, raw: Column) -> Column:
    out = F.lit(None).cast(_PARTIAL)
    for form, order, lacks in reversed(LADDER):
        whole = f"(?i)^{form}$"
        part = {c: F.regexp_extract(clean, whole, i) for i, c in enumerate(order, 1)}
        y = F.concat(F.lit("20" if "century" in lacks else ""), part["y"]) if "y" in part else F.lit(BASE[:4])
        day = lambda m, d: F.try_to_timestamp(F.concat_ws("-", y, m, d), F.lit("yyyy-M-d")).cast("date")  # noqa: B023, E731
        m, d = _month(part["m"]) if "m" in part else F.lit("1"), part.get("d", F.lit("1"))
        found = day(m, d)
        if _MONTH not in form and "m" in part and "d" in part:
            found = F.coalesce(found, day(d, m))
        flags = [F.lit(p in lacks.split()).alias(f"missing_{p}") for p in _PARTS]
        out = F.when(clean.rlike(whole), let(found, lambda x: F.when(x.isNotNull(), F.struct(x.alias("d"), raw.alias("raw"), *flags)))).otherwise(out)  # noqa: B023
    return out


def let(value: Column, body) -> Column:
    """body of value, which is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def render(p: Column) -> Column:
    """A partial date by the parts it has."""
    return let(p, _rendered)


def _rendered(p: Column) -> Column:
    y, m, d, c = (p[f"missing_{x}"] for x in ("year", "month", "day", "century"))
    f = lambda fmt: F.date_format(p["d"], fmt)
    return (
        F.when(y & d, f("MMMM")).when(y, f("MMMM dd")).when(m & c, f("yy")).when(m, f("yyyy")).when(d & c, f("MMMM yy")).when(d, f("MMMM yyyy")).when(c, f("MM/dd/yy")).otherwise(f("MM/dd/yyyy"))
    )


def same(a: Column, b: Column) -> Column:
    """Equal in all parts that both have; without a century in either, by two digits."""
    lacks = lambda x: a[f"missing_{x}"] | b[f"missing_{x}"]
    year = F.when(lacks("century"), F.year(a["d"]) % 100 == F.year(b["d"]) % 100).otherwise(F.year(a["d"]) == F.year(b["d"]))
    return (lacks("year") | year) & (lacks("month") | (F.month(a["d"]) == F.month(b["d"]))) & (lacks("day") | (F.day(a["d"]) == F.day(b["d"])))


def complete(p: Column) -> Column:
    """Whether a partial date lacks none of year, month, day and century."""
    return ~(p["missing_year"] | p["missing_month"] | p["missing_day"] | p["missing_century"])


def add_days(p: Column, days: Column) -> Column:
    """A partial date moved by days, lacking the same parts; null if days is."""
    return F.when(days.isNotNull(), F.struct(F.date_add(p["d"], days).alias("d"), p["raw"].alias("raw"), *[p[f"missing_{x}"].alias(f"missing_{x}") for x in ("year", "month", "day", "century")]))


def shift_partial(p: Column, offset: Column, born: Column | None = None, ref: Column | None = None) -> Column:
    """A partial date less offset days; the birth date (with a year) as the shifted birth date whose age on ref is at most 90.

    Null if the date is, or if the offset is zero, null or no integer.
    """
    days = -F.nullif(offset.try_cast("int"), F.lit(0))
    if born is None or ref is None:
        return let(p, lambda q: add_days(q, days))
    return let(p, lambda q: _shifted(q, days, born, ref))


def _shifted(p: Column, days: Column, born: Column, ref: Column) -> Column:
    whole = F.struct(born.alias("d"), *[F.lit(False).alias(f"missing_{x}") for x in ("year", "month", "day", "century")])
    own = F.coalesce(~p["missing_year"] & born.isNotNull() & same(p, whole), F.lit(False))
    return F.when(own, add_days(p, F.date_diff(capped_birth(F.date_add(born, days), ref), p["d"]))).otherwise(add_days(p, days))


def shift_range(text: Column, offset: Column) -> Column:
    """Both dates of a range `a-b` shifted, each with the mark of shifted dates; null unless both are dates after 1900."""
    sides = F.split(text, r"\s*[-\u2013]\s*", 2)
    done = [shift_marked(F.get(sides, F.lit(i)), offset) for i in (0, 1)]
    return F.when(F.size(sides) == 2, F.concat(done[0], F.lit("-"), done[1]))


def shift_marked(text: Column, offset: Column) -> Column:
    """A written date plus offset days by the parts it has, and the mark of shifted dates; null if it is none, lacks its year or lies before 1901."""
    marked = lambda p: F.when(~p["missing_year"] & (F.year(p["d"]) > 1900), F.concat(_rendered(add_days(p, offset.cast("int"))), F.lit(" [SHIFTED DATE]")))
    return let(parse(text), marked)


def shift(d: Column, offset: Column) -> Column:
    """d less offset days; null if the offset is zero, null or no integer."""
    days = F.nullif(offset.try_cast("int"), F.lit(0))
    return F.date_sub(d, days)


def age_on(born: Column, day: Column) -> Column:
    """Whole years from birth to day; who was born on 29 February has their birthday on the 28th in common years."""
    years = F.year(day) - F.year(born)
    return years - F.when(day < F.add_months(born, years * 12), 1).otherwise(0)


def capped_birth(born: Column, day: Column, most: int = 90) -> Column:
    """The birth date, moved later by whole years so that the age on day is at most `most`; 29 February becomes the 28th where it must."""
    years = F.greatest(age_on(born, day) - most, F.lit(0))
    return F.when(years == 0, born).otherwise(F.add_months(born, years * 12))


_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def number_words() -> dict[str, int]:
    """Number words up to 199, made by rule."""
    out = {w: i for i, w in enumerate(_ONES)}
    for i, t in enumerate(_TENS, 2):
        out[t] = 10 * i
        out |= {f"{t} {_ONES[j]}": 10 * i + j for j in range(1, 10)}
    return out | {f"one hundred {w}": 100 + n for w, n in out.items() if n} | {"one hundred": 100}


def parse_age(text: Column) -> Column:
    """An age from digits or number words; null if it is neither."""
    words = F.create_map(*[x for w, n in number_words().items() for x in (F.lit(w), F.lit(n))])
    plain = F.regexp_replace(F.lower(F.trim(text)), "[- ]+", " ")
    return F.coalesce(F.nullif(F.regexp_extract(plain, r"^([0-9]{1,3})$", 1), F.lit("")).cast("int"), words[plain])


def age_substitute(age: Column) -> Column:
    """The age as it is up to 90, ***** above."""
    return F.when(age > 90, "*****").otherwise(age.cast("string"))


def fallback_offset(key: Column, low: int = 730, high: int = 1094) -> Column:
    """A steady offset for notes without metadata, by the digest of their key."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 7), 16, 10).cast("int") % (high - low + 1) + low
