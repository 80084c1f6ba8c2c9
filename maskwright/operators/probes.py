"""Known identifiers of notes, probes(doc_id, kind, value), as words and regexes of the dynamic filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S

#: Words that are never looked for as names by themselves, and as parts of addresses.
NO_NAMES = ("md", "dr", "pt", "no", "in", "none", "of", "by", "ct", "medical", "pathology", "patient", "study", "nan", "per", "contact")
NO_CITIES = ("friend", "cousin", "brother", "normal", "nephew", "likely", "unknown", "rescue", "decline")
#: What may stand between the parts of a phone number, and of an address or workplace.
GAPS = {"phone": "([^0-9A-Za-z]{1,3})?", "address": "([^0-9A-Za-z]{1,5})?", "workplace": "([^0-9A-Za-z]{1,5})?"}
#: Fixed forms: names written with an initial or an apostrophe, numeric dates, and dates with a time.
INITIALS = r"^([A-Z]'[a-zA-Z]+\b|[A-Z]\s[a-zA-Z]+\b|[A-Z]\.[A-Z]\.[A-Z]\.|[A-Z]\.[A-Z]\.)"
NUMERIC_DATE = r"[0-9]+[/.-][0-9]+[/.-][0-9]+"
DATE_TIME = NUMERIC_DATE + r"\s+[0-9]*:[0-9]*"
ANYWHERE, BETWEEN_SPACES = "%s", r"[ ]+\b(%s)(\.|'s\b|\b)?[ ]+"


def _parts(probes: DataFrame) -> DataFrame:
    """doc_id, kind, value, part, form of the runs of letters and digits in each value; null values have none."""
    runs = F.regexp_extract_all("value", F.lit(r"[A-Za-z0-9]+"), F.lit(0))
    return probes.select("doc_id", "kind", "value", F.explode(runs).alias("part")).withColumn("form", F.lower("part"))


def _short(form: Column) -> Column:
    return (F.length(form) < 2) | form.isin(*NO_NAMES)


def words(probes: DataFrame) -> DataFrame:
    """doc_id, word, distinct: parts of names of two or more characters, in lower case, with and without a final s; parts of zips and record numbers as they are."""
    parts = _parts(probes)
    names = parts.where((F.col("kind") == "name") & ~_short(F.col("form"))).select("doc_id", F.explode(F.array("form", F.concat("form", F.lit("s")))).alias("word"))
    return names.union(parts.where("kind in ('zip', 'mrn')").select("doc_id", "part")).distinct()


def regexes(probes: DataFrame, cities: DataFrame | None = None) -> DataFrame:
    """doc_id, regex, distinct, to be matched in either case.

    Names with initials as written, dates glued to a part of a name, dates with a time in notes
    that have a name; phones, addresses and workplaces with gaps between their parts. Parts of
    addresses that are in NO_CITIES or cities(word) don't count.
    """
    parts = _parts(probes).select("doc_id", "kind", "value", "part", "form")
    named = parts.where((F.col("kind") == "name") & ~_short(F.col("form")))
    glued = named.select("doc_id", F.explode(F.array(F.lit(DATE_TIME), F.concat(F.lit(NUMERIC_DATE), "form"), F.concat(F.lit(NUMERIC_DATE), "form", F.lit("s")))).alias("regex"))
    quoted = F.regexp_replace("value", r"([^A-Za-z0-9\s])", r"\\$1")
    initials = probes.where((F.col("kind") == "name") & F.col("value").rlike(INITIALS)).select("doc_id", quoted.alias("regex"))
    runs = F.transform(F.regexp_extract_all("value", F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)
    digits = F.filter(F.transform(runs, lambda x: F.regexp_replace(x, "[^0-9]", "")), lambda x: x != "")
    phones = probes.where("kind = 'phone'").select("doc_id", F.array_join(digits, GAPS["phone"]).alias("regex"))
    works = probes.where("kind = 'workplace'").select("doc_id", F.array_join(runs, GAPS["workplace"]).alias("regex"))
    kept = F.filter(runs, lambda x: ~x.isin(*NO_CITIES))
    places = probes.where("kind = 'address'").select("doc_id", "value", kept.alias("x"))
    if cities is not None:
        rows = places.select("doc_id", "value", F.posexplode("x").alias("i", "part")).join(cities.select(F.lower("word").alias("part")).distinct(), "part", "left_anti")
        places = rows.groupBy("doc_id", "value").agg(F.transform(F.array_sort(F.collect_set(F.struct("i", "part"))), lambda s: s["part"]).alias("x"))
    places = places.select("doc_id", F.array_join("x", GAPS["address"]).alias("regex"))
    return glued.union(initials).union(phones).union(works).union(places).where("regex <> ''").distinct()


def short_words(probes: DataFrame) -> DataFrame:
    """doc_id, regex, distinct: parts of names too short or too common to stand alone, that count between spaces only."""
    return _parts(probes).where((F.col("kind") == "name") & _short(F.col("form")) & ~F.col("form").rlike("^[0-9]+$")).select("doc_id", F.col("form").alias("regex")).distinct()


#: Columns of per_note: words, alternations of regexes and of short words, and the note they belong to.
PER_NOTE = ("_mw_names", "_mw_any", "_mw_short", "_mw_note")


def _any(found: DataFrame, name: str) -> DataFrame:
    ranked = F.array_sort(F.collect_set(F.struct((-F.length("regex")).alias("n"), "regex")))
    return found.groupBy("doc_id").agg(F.array_join(F.transform(ranked, lambda s: s["regex"]), "|").alias(name))


def per_note(probes: DataFrame) -> DataFrame:
    """One row per note with its words, its regexes and its short words, the longest first: what a note's probes bound."""
    names, anywhere, short, note = PER_NOTE
    sides = (words(probes).groupBy("doc_id").agg(F.collect_set("word").alias(names)), _any(regexes(probes), anywhere), _any(short_words(probes), short))
    rows = sides[0].join(sides[1], "doc_id", "full").join(sides[2], "doc_id", "full")
    return rows.where("doc_id is not null").withColumnRenamed("doc_id", note).select(*PER_NOTE)


def pattern(alternatives: Column, template: str = ANYWHERE) -> Column:
    """The regex, in either case, of a template in which %s is any of the alternatives; null without any."""
    head, _, tail = template.partition("%s")
    return F.concat(F.lit(f"(?Ud)(?i){head}(?:"), alternatives, F.lit(f"){tail}"))


def word_spans(docs: DataFrame, probes: DataFrame) -> DataFrame:
    """doc_id, start, stop, token of the tokens that, as written or in lower case, are a word of their own note's probes."""
    forms = S.tokens(docs).withColumn("word", F.explode(F.array_distinct(F.array(F.lower("token"), "token"))))
    return forms.join(words(probes), ["doc_id", "word"], "left_semi").select("doc_id", "start", "stop", "token").distinct()


def template_spans(docs: DataFrame, found: DataFrame, template: str = ANYWHERE) -> DataFrame:
    """doc_id, start, stop, token of the matches of a template in which %s is any of the note's regexes, the longest first.

    A note's regexes are one pattern: their number is bounded by the probes of one note.
    """
    rows = docs.select("doc_id", "text").join(_any(found, "any"), "doc_id").withColumn("pattern", pattern(F.col("any"), template))
    return S.regex_spans(rows, F.col("pattern")).select("doc_id", "start", "stop", "token")


def add_known(docs: DataFrame, spans: DataFrame, known: DataFrame, context: int = 10) -> tuple[DataFrame, DataFrame]:
    """(spans, report) after known(doc_id, phi_type, value): the tokens of a note that equal one of its known names.

    Only types lname and fname count. Such a token is added to spans (doc_id, start, stop), or
    makes the span that starts with it longer. The report has doc_id, start, stop, token,
    phi_type and context of the tokens that spans lacked.
    """
    names = known.where("phi_type in ('lname', 'fname')").groupBy("doc_id", F.lower("value").alias("form")).agg(F.min("phi_type").alias("phi_type"))
    found = S.tokens(docs).withColumn("form", F.lower("token")).join(names, ["doc_id", "form"]).select("doc_id", "start", "stop", "token", "phi_type")
    reach = spans.groupBy("doc_id", "start").agg(F.max("stop").alias("had"))
    new = found.join(reach, ["doc_id", "start"], "left").where("had is null or stop > had").drop("had")
    out = spans.select("doc_id", "start", "stop").unionByName(new.select("doc_id", "start", "stop")).groupBy("doc_id", "start").agg(F.max("stop").alias("stop"))
    return out, S.with_context(new, docs, context)
