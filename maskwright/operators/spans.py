"""Spans (doc_id, start, stop) in code points, half-open, as rows; touching spans count as overlapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import let

TOKEN, MASKABLE = "[A-Za-z0-9]+", "[A-Za-z0-9*]+"


def gaps_and_lengths(text: str, pattern: Column) -> Column:
    """struct(g, n) of the lengths of the gaps before (and after) all leftmost non-overlapping matches of a pattern and of the matches; null without one.

    split() gives the gaps and regexp_extract_all() the matches of the same search, which is
    run once; only texts with a match are split. split() drops the gap before an empty match
    at the very start of a text, which is put back.
    """

    def both(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        whole = let(gaps, lambda g: F.when(F.size(g) > F.size(found), g).otherwise(F.concat(F.array(F.lit(0)), g)))
        return F.when(F.size(found) > 0, F.struct(whole.alias("g"), F.transform(found, F.length).alias("n"), found.alias("m")))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), both)


def regex_spans(docs: DataFrame, pattern: str | Column, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, nth, start, stop, token of all leftmost non-overlapping matches of pattern in text, row by row.

    Running sums of gaps and matches are the offsets: no UDF, and no row for a document without
    a match. The sums go over each row of docs by itself, so null and repeated ids have the
    spans of their own texts. Null texts have none; empty matches are spans of length zero.
    """
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    hit = let(gaps_and_lengths("text", p), lambda x: F.arrays_zip(F.slice(x["g"], 1, F.size(x["m"])).alias("gap"), x["m"].alias("m")))
    pairs = docs.select(*keep, F.monotonically_increasing_id().alias("_row"), hit.alias("x"))
    # an inner explode infers a filter on x, which Catalyst pushes down as a second search of every text
    rows = pairs.select(*keep, "_row", F.posexplode_outer("x").alias("nth", "x")).where("x.m is not null").select(*keep, "_row", F.col("nth").cast("long").alias("nth"), F.col("x.gap").alias("gap"), F.col("x.m").alias("token"))
    # the row counts within one stage only: where docs are dealt by keep already, there is no exchange
    stop = F.sum(F.col("gap") + F.length("token")).over(Window.partitionBy(*keep, "_row").orderBy("nth"))
    return rows.withColumn("stop", stop).select(*keep, "nth", (F.col("stop") - F.length("token")).alias("start"), "stop", "token")


def clean_words(docs: DataFrame) -> DataFrame:
    """doc_id, word: runs of letters, digits, _ and apostrophes of any script, cut at the latter two."""
    parts = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_']+"), F.lit(0)), lambda w: F.split(w, "['_]")))
    return docs.select("doc_id", F.explode(F.filter(parts, lambda x: x != "")).alias("word"))


def literal_spans(docs: DataFrame, values: DataFrame) -> DataFrame:
    """doc_id, value, start, stop of the places where values(doc_id, value) stand in their own text, taken as they are written; empty values stand nowhere."""
    rows = docs.select("doc_id", "text").join(values.where("value <> ''").select("doc_id", "value").distinct(), "doc_id")
    quoted = F.concat(F.lit(r"\Q"), F.replace("value", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return regex_spans(rows, quoted, ("doc_id", "value")).select("doc_id", "value", "start", "stop")


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, nth, start, stop, token of runs of letters and digits."""
    return regex_spans(docs, TOKEN)


def merge(spans: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """by, start, stop: islands of spans that overlap or touch."""
    order = Window.partitionBy(*by).orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    rows = spans.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_island")


def apart_from(spans: DataFrame, others: DataFrame) -> DataFrame:
    """Those of spans that touch none of others.

    A sweep instead of a join, so a long document costs n log n: of all others that start no
    later than a span stops, the farthest stop must lie before the span's start.
    """
    a = spans.withColumns({"_at": F.col("stop"), "_kind": F.lit(1), "_stop": F.lit(None).cast("long")})
    b = others.select("doc_id", F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.col("stop").alias("_stop"))
    w = Window.partitionBy("doc_id").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = a.unionByName(b, allowMissingColumns=True).withColumn("_reach", F.max("_stop").over(w))
    return rows.where("_kind = 1 and (_reach is null or _reach < start)").select(*spans.columns)


def removed(spans: DataFrame, others: DataFrame) -> DataFrame:
    """spans without those that start exactly where one of others does."""
    return spans.join(others.select("doc_id", "start"), ["doc_id", "start"], "left_anti")


def binned(spans: DataFrame, width: int = 256) -> DataFrame:
    """spans once per bin of the text, of width code points, that they reach into: with doc_id the key of a join of overlapping spans."""
    bins = F.sequence(F.expr(f"start div {width}"), F.expr(f"greatest(stop - 1, start) div {width}"))
    return spans.withColumn("bin", F.explode(bins))


def overlapping(a: str, b: str, width: int = 256) -> Column:
    """That binned spans under the aliases a and b overlap, true in the one bin where the later of both starts."""
    same = (F.col(f"{a}.doc_id") == F.col(f"{b}.doc_id")) & (F.col(f"{a}.bin") == F.col(f"{b}.bin"))
    first = F.expr(f"{a}.bin = greatest({a}.start, {b}.start) div {width}")
    return same & first & (F.col(f"{a}.start") < F.col(f"{b}.stop")) & (F.col(f"{a}.stop") > F.col(f"{b}.start"))


def intersections(a: DataFrame, b: DataFrame) -> DataFrame:
    """doc_id, start, stop of what spans of a and b have in common."""
    rows = [binned(x.select("doc_id", "start", "stop")).alias(n) for x, n in ((a, "x"), (b, "y"))]
    both = rows[0].join(rows[1], overlapping("x", "y"))
    return both.select(F.col("x.doc_id").alias("doc_id"), F.greatest("x.start", "y.start").alias("start"), F.least("x.stop", "y.stop").alias("stop")).distinct()


def subtract(runs: DataFrame, islands: DataFrame) -> DataFrame:
    """doc_id, start, stop: what islands leave of runs (disjoint); a sweep over the bounds of both, without a join."""

    def bounds(spans: DataFrame, run: int, island: int) -> DataFrame:
        both = F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("by")), F.struct(F.col("stop").alias("at"), F.lit(-1).alias("by")))
        return spans.select("doc_id", F.explode(both).alias("x")).select("doc_id", "x.at", (F.col("x.by") * run).alias("run"), (F.col("x.by") * island).alias("island"))

    order = Window.partitionBy("doc_id").orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = bounds(runs, 1, 0).union(bounds(islands.where("start < stop"), 0, 1))
    # of bounds at one place, only the last has a next bound beyond, and its sums hold them all
    rows = rows.select("doc_id", F.col("at").alias("start"), F.lead("at").over(order).alias("stop"), F.sum("run").over(so_far).alias("run"), F.sum("island").over(so_far).alias("island"))
    return rows.where("start < stop and run > 0 and island = 0").select("doc_id", "start", "stop")


def complement(docs: DataFrame, includes: DataFrame) -> DataFrame:
    """What protected text remains: runs of letters, digits and * that no included span covers."""
    return subtract(regex_spans(docs, MASKABLE), includes)


def with_text(spans: DataFrame, docs: DataFrame, name: str = "token") -> DataFrame:
    return spans.join(docs.select("doc_id", "text"), "doc_id").withColumn(name, F.expr("substring(text, int(start) + 1, int(stop - start))")).drop("text")


def context_of(text: Column, width: int = 10) -> Column:
    """The text around a span of columns start and stop, width code points on either side, line ends and tabs as spaces."""
    first = F.greatest(F.col("start") - width, F.lit(0)).cast("int")
    last = F.least(F.col("stop") + width, F.length(text)).cast("int")
    return F.translate(F.substring(text, first + 1, last - first), "\n\t", "  ")


def marked_context(text: Column, before: int = 16, after: int = 40) -> Column:
    """The text around a span of columns start and stop, the span itself between [[ and ]]."""
    first = F.greatest(F.col("start") - before, F.lit(0)).cast("int")
    start, stop = F.col("start").cast("int"), F.col("stop").cast("int")
    return F.concat(F.substring(text, first + 1, start - first), F.lit("[["), F.substring(text, start + 1, stop - start), F.lit("]]"), F.substring(text, stop + 1, F.lit(after)))


def with_context(spans: DataFrame, docs: DataFrame, width: int = 10) -> DataFrame:
    """spans with the text around each, width code points on either side, line ends and tabs as spaces."""
    return spans.join(docs.select("doc_id", "text"), "doc_id").withColumn("context", context_of(F.col("text"), width)).drop("text")
