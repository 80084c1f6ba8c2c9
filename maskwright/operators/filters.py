"""The filter types as span relations, and relations of what a list of them resolves to."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.patterns import Pattern
from . import probes as P
from . import spans as S
from .resolve import resolved


def heuristic_pos(token):
    """A stand-in part-of-speech tag of a token column: CD, NNP, NNS, VBG, VBD, RB or NN."""
    return (
        F.when(token.rlike("[0-9]"), "CD").when(token.rlike("^[A-Z][a-z]*$"), "NNP").when(token.rlike("ing$"), "VBG")
        .when(token.rlike("ed$"), "VBD").when(token.rlike("ly$"), "RB").when(token.rlike("[a-z]s$"), "NNS").otherwise("NN")
    )


def set_spans(docs: DataFrame, words: DataFrame, pos: tuple[str, ...] = (), tagger=heuristic_pos) -> DataFrame:
    """Tokens whose lower-case or own form is a word; with pos, only those so tagged. words(word) is shuffled or broadcast as its size tells Spark."""
    toks = S.tokens(docs)
    if pos:
        toks = toks.where(tagger(F.col("token")).isin(*pos))
    forms = toks.withColumn("form", F.explode(F.array_distinct(F.array(F.lower("token"), "token"))))
    return forms.join(words.select(F.col("word").alias("form")).distinct(), "form", "left_semi").select("doc_id", "start", "stop", "token").distinct()


def dynamic_set_spans(docs: DataFrame, probes: DataFrame) -> DataFrame:
    """Tokens that are one of their own note's probes(doc_id, kind, value): an equi-join, no set per note."""
    return P.word_spans(docs, probes)


def dynamic_regex_spans(docs: DataFrame, probes: DataFrame, template: str = P.ANYWHERE, short: bool = False) -> DataFrame:
    """Matches of a template in which %s is any regex of the note's probes(doc_id, kind, value); with short, any of its words that are too short to stand alone."""
    return P.template_spans(docs, P.short_words(probes) if short else P.regexes(probes), template)


def beside(matches: DataFrame, protected: DataFrame, context: str) -> DataFrame:
    """Those matches that end or start where a protected span starts or ends, on the side(s) that context names."""
    left = protected.select("doc_id", F.col("stop").alias("start")).distinct()
    right = protected.select("doc_id", F.col("start").alias("stop")).distinct()
    by_left, by_right = matches.join(left, ["doc_id", "start"], "left_semi"), matches.join(right, ["doc_id", "stop"], "left_semi")
    cols = matches.columns
    match context:
        case "left":
            return by_left.select(cols)
        case "right":
            return by_right.select(cols)
        case "left_and_right":
            return by_left.join(right, ["doc_id", "stop"], "left_semi").select(cols)
        case _:
            return by_left.select(cols).union(by_right.select(cols)).distinct()


def ner_spans(docs: DataFrame, tag, tags: tuple[str, ...]) -> DataFrame:
    """Tokens whose tag is one of tags. tag is a list of strings to a list of tags, called once per batch and partition through Arrow."""
    import pyarrow as pa

    toks = S.tokens(docs).select("doc_id", "start", "stop", "token")

    def run(batches):
        for b in batches:
            kinds = tag(b.column("token").to_pylist())
            yield b.append_column("ner", pa.array(kinds, pa.string()))

    from pyspark.sql import types as T

    return toks.mapInArrow(run, T.StructType([*toks.schema.fields, T.StructField("ner", T.StringType())])).where(F.col("ner").isin(*tags)).drop("ner")


def candidates(docs: DataFrame, p: Pattern, probes: DataFrame | None = None, tag=None) -> DataFrame:
    """doc_id, start, stop that pattern p finds by itself, touching matches of a regex joined."""
    return _rows(resolved(docs, [replace(p, exclude=True)], probes, tag), "excludes").select("doc_id", "start", "stop")


def _rows(rows: DataFrame, spans: str) -> DataFrame:
    return rows.select("doc_id", F.inline(spans))


def accepted(docs: DataFrame, patterns: list[Pattern], probes: DataFrame | None = None, tag=None) -> tuple[DataFrame, DataFrame]:
    """(includes, excludes) after priority, merged: doc_id, start, stop and, for excludes, phi_type; see resolve.resolved()."""
    rows = resolved(docs, patterns, probes, tag)
    return _rows(rows, "includes"), _rows(rows, "excludes").drop("token")


def protected(docs: DataFrame, patterns: list[Pattern], probes: DataFrame | None = None, tag=None) -> DataFrame:
    """doc_id, start, stop, phi_type of all that stays protected; OTHER where no exclude pattern names a type.

    To mask texts, mask the rows of resolve.resolved() themselves: that needs no key.
    """
    return _rows(resolved(docs, patterns, probes, tag), "protected").drop("token")
