"""Rewriting texts by spans: token and character masks, substitutions, tags."""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .resolve import sliced

MARK = "*****"
_PIECES = "_mw_pieces"


def rebuilt(text: str | None, pieces: list[tuple[int, int, str]]) -> str | None:
    """text with each piece (start, stop, put; disjoint, in order) replaced by what is put for it."""
    if text is None or not pieces:
        return text
    out, at = [], 0
    for start, stop, put in pieces:
        out += (text[at:start], put)
        at = stop
    return "".join([*out, text[at:]])


def with_replacements(spans: list[tuple[int, int]], puts: list[tuple[int, int, str]], mark: str = MARK) -> list[tuple[int, int, str]]:
    """Pieces of disjoint spans by the mark, but for puts that start where a span does, which stand for their whole length.

    Of puts that overlap, those stay that start when all that start earlier have stopped (of
    equal starts the longest); what is left of spans beside them is masked as ever.
    """
    starts, kept, reach = {s for s, _ in spans}, [], -1
    for a, b, put in sorted((x for x in puts if x[0] in starts), key=lambda x: (x[0], -x[1])):
        if a >= reach:
            kept.append((a, b, put))
        reach = max(reach, b)
    if not kept:
        return [(a, b, mark) for a, b in spans]
    out, firsts = list(kept), [a for a, _, _ in kept]
    for a, b in spans:
        i = max(bisect_right(firsts, a) - 1, 0)
        while a < b and i < len(kept) and kept[i][0] < b:
            if kept[i][1] > a:
                if a < kept[i][0]:
                    out.append((a, kept[i][0], mark))
                a = max(a, kept[i][1])
            i += 1
        if a < b:
            out.append((a, b, mark))
    return sorted(out)


def _rewrite(rows: DataFrame, columns: list[str], pieces_of) -> DataFrame:
    """columns of rows, the text rebuilt from the pieces that pieces_of gives for the row's lists in _PIECES."""
    kept = rows.select(*[F.col(f"`{c}`") for c in columns], _PIECES)

    def run(batches):
        for batch in batches:
            for b in sliced(batch):
                texts = [rebuilt(t, pieces_of(x)) for t, x in zip(b.column("text").to_pylist(), b.column(_PIECES).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in columns], names=columns)

    return kept.mapInArrow(run, kept.drop(_PIECES).schema)


def _put(pieces) -> list[tuple[int, int, str]]:
    return [(x["start"], x["stop"], x["put"]) for x in pieces or ()]


def token_put(mark: str = MARK):
    return lambda x: F.lit(mark)


def char_put(x: Column) -> Column:
    return F.regexp_replace(x["token"], "[A-Za-z0-9*]", "*")


def tag_put(x: Column) -> Column:
    return F.concat(F.lit("***"), F.when(x["phi_type"] == "OTHER", "PHI").otherwise(x["phi_type"]), F.lit("***"))


def symbol_put(symbol: str = "*"):
    return lambda x: F.concat(F.lit(symbol), F.substring(x["token"], 2, (1 << 31) - 1))


def mask_rows(rows: DataFrame, put=None, columns: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """columns of the rows of resolve.resolved(), their texts rebuilt: put (of a protected span) for each of its spans, by default a mark.

    Each row is masked from its own spans, so null and repeated ids are masked like others.
    char_put and symbol_put need spans with their text (words=True).
    """
    put = put or token_put()
    pieces = F.transform("protected", lambda x: F.struct(x["start"], x["stop"], put(x).alias("put")))
    return _rewrite(rows.withColumn(_PIECES, pieces), list(columns), _put)


def replace_rows(rows: DataFrame, columns: list[str], mark: str = MARK) -> DataFrame:
    """columns of rows with `protected` spans and `norms` (start, stop, replacement): replacements put, the rest masked."""
    span = F.transform("protected", lambda x: F.struct(x["start"], x["stop"]))
    norm = F.transform(F.filter("norms", lambda x: x["replacement"].isNotNull()), lambda x: F.struct(x["start"], x["stop"], x["replacement"].alias("put")))

    def pieces_of(x):
        return with_replacements([(s["start"], s["stop"]) for s in x["spans"] or ()], _put(x["puts"]), mark)

    return _rewrite(rows.withColumn(_PIECES, F.struct(span.alias("spans"), norm.alias("puts"))), columns, pieces_of)


def _rewritten(docs: DataFrame, spans: DataFrame, put: Column) -> DataFrame:
    """docs(doc_id, text) with text rebuilt from a relation of spans (disjoint): put, of columns start, stop and token, for each.

    The ids of docs must be unique and not null, else spans can't be told to belong to a text:
    rows for which that isn't so raise, and no text leaves unmasked.
    """
    empty = F.lit(None).cast("struct<start:bigint,stop:bigint,put:string>")
    both = spans.select("doc_id", F.struct("start", "stop", put.alias("put")).alias("x"), F.lit(0).alias("n")).unionByName(docs.select("doc_id", empty.alias("x"), F.lit(1).alias("n")))
    per_doc = both.groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias(_PIECES), F.sum("n").alias("_mw_n"))
    broken = F.raise_error(F.lit("ids of documents must be unique and not null: mask the rows of resolve.resolved() instead"))
    rows = docs.join(per_doc, "doc_id", "left").withColumn(_PIECES, F.when(F.col("_mw_n") == 1, F.col(_PIECES)).otherwise(broken))
    return _rewrite(rows, docs.columns, _put)


def mask_tokens(docs: DataFrame, spans: DataFrame, mark: str = MARK) -> DataFrame:
    """Each span by the mark, or by its column `replacement` where it has one."""
    put = F.coalesce("replacement", F.lit(mark)) if "replacement" in spans.columns else F.lit(mark)
    return _rewritten(docs, spans, put)


def mask_chars(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Each letter, digit and * of a span by *; lengths stay."""
    return _rewritten(docs, spans, char_put({"token": F.col("token")}))


def obscured(docs: DataFrame, spans: DataFrame, symbol: str = "*") -> DataFrame:
    """The first character of each span by the symbol, the others kept."""
    return _rewritten(docs, spans, symbol_put(symbol)({"token": F.col("token")}))


def tagged(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Each span by its type between stars; OTHER is ***PHI***."""
    return _rewritten(docs, spans, tag_put({"phi_type": F.col("phi_type")}))


def escaped(col: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        col = F.replace(col, F.lit(raw), F.lit(safe))
    return col


def annotation_tag(nth, start, stop, token, kind) -> Column:
    """The tag of one span, escaped."""
    number = lambda c: c.cast("string")
    return F.concat(
        F.lit("<"), kind, F.lit(' id="P'), number(nth), F.lit('" start="'), number(start), F.lit('" end="'), number(stop),
        F.lit('" text="'), escaped(token), F.lit('" TYPE="'), kind, F.lit('" comment="" />'),
    )


def annotation_xml(spans: DataFrame) -> DataFrame:
    """doc_id, xml: the tags of each document's spans (start, stop, token, phi_type), by start, escaped."""
    tag = annotation_tag(*[F.col(c) for c in ("nth", "start", "stop", "token", "phi_type")])
    rows = spans.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "stop")) - 1).select("doc_id", "nth", tag.alias("tag"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "tag"))), lambda x: x["tag"]), "").alias("xml"))


def shape(col: Column) -> Column:
    """Digits to `, letters to ?, the rest as it is."""
    return F.regexp_replace(F.regexp_replace(col, "[0-9]", "`"), "[A-Za-z]", "?")
