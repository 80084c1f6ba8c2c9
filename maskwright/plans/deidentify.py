"""The whole job as one plan: notes in; masked notes, surrogates, logs and evaluation out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import evaluate as E
from ..operators import mask as M
from ..operators import reports as R
from ..operators import spans as S
from ..operators.resolve import resolved
from .patterns import Pattern

PROBE_TYPES = ("PROBEDYNAMICSET", "PROBEREGEX", "PROBEREGEXCONTEXT")
AGES = ("AGE<90", "AGE>=90")


@dataclass
class Deidentified:
    """One run, a row per note: lazy, nothing is computed before a relation of it is written or counted.

    rows has the notes with includes, excludes, protected and probed (see resolve.resolved())
    and norms, the dates and ages that were read. Everything comes from the row itself, so null
    and repeated ids are masked and counted like others.
    """

    rows: DataFrame
    columns: list[str]

    def _each(self, spans: str, *more: str) -> DataFrame:
        return self.rows.select("doc_id", *more, F.inline(spans))

    @property
    def spans(self) -> DataFrame:
        """doc_id, start, stop, phi_type: all that is protected."""
        return self._each("protected").drop("token")

    @property
    def typed(self) -> DataFrame:
        """doc_id, start, stop, phi_type: what exclude filters accepted, per type."""
        return self._each("excludes").drop("token")

    @property
    def norms(self) -> DataFrame:
        """doc_id, start, stop, phi_type, token, date, age, replacement."""
        return self._each("norms")

    @property
    def masked(self) -> DataFrame:
        """The columns of the notes, texts masked."""
        return M.replace_rows(self.rows, self.columns)

    def detail(self) -> DataFrame:
        """doc_id, file_size (bytes), total_tokens, phi_tokens, dates read or not and shifted or not; one row per note."""
        count = lambda cond: F.size(F.filter("norms", cond)).cast("long")
        read, put = lambda x: x["date"].isNotNull(), lambda x: x["replacement"].isNotNull()
        return self.rows.select(
            "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("file_size"), F.coalesce(F.regexp_count("text", F.lit(S.TOKEN)), F.lit(0)).cast("long").alias("total_tokens"), F.size("protected").cast("long").alias("phi_tokens"),
            count(read).alias("successfully_normalized"), count(lambda x: (x["phi_type"] == "DATE") & x["date"].isNull()).alias("failed_normalized"),
            count(lambda x: read(x) & put(x)).alias("successfully_surrogated"), count(lambda x: read(x) & ~put(x)).alias("failed_surrogated"),
        )

    def logs(self) -> dict[str, DataFrame]:
        """phi_count, phi_marked, parsed_dates, failed_dates, normalized_ages, detailed_batch_summary, batch_summary, dynamic_blacklist."""
        day = self.norms.where("phi_type = 'DATE'")
        shown = day.select("doc_id", "start", "stop", "token", D.render(F.col("date")).alias("normalized"), "replacement")
        around = lambda spans: spans.withColumn("context", S.context_of(F.col("text"))).drop("text")
        failed = self._each("norms", "text").where("phi_type = 'DATE' and date is null").select("doc_id", "text", "start", "stop", "token")
        known = self._each("probed", "text").withColumnsRenamed({"phi_type": "types", "token": "probe"})
        return {
            "phi_count": self.spans.groupBy("phi_type").agg(F.count(F.lit(1)).alias("n")), "phi_marked": self._each("protected").withColumnRenamed("token", "word"), "parsed_dates": shown.where("normalized is not null"),
            "failed_dates": around(failed), "normalized_ages": self.norms.where(F.col("phi_type").isin(*AGES)).select("doc_id", "start", "stop", "token", "age", "replacement"),
            "detailed_batch_summary": self.detail(), "batch_summary": R.batch_summary(self.detail()), "dynamic_blacklist": around(known),
        }

    def evaluate(self, gold: DataFrame, tags: DataFrame | None = None) -> dict[str, DataFrame]:
        """tokens (doc_id, start, token, tag, label), by_doc, total and corrected against gold(doc_id, start, stop, phi_type).

        Gold names notes by their note_key, where they have one, else by doc_id; these must be
        unique and not null here, as two notes of one name can't be told apart by it.
        """
        key = "note_key" if "note_key" in self.columns else "doc_id"
        ids = self.rows.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull())
        if not ids.isEmpty():
            raise ValueError(f"{key} must be unique and not null in notes that are evaluated")
        docs = self.rows.select(F.col(key).alias("doc_id"), "text")
        toks = S.tokens(docs).select("doc_id", "start", "stop", "token")
        told, held = E.token_types(toks, gold), E.token_types(toks, self.rows.select(F.col(key).alias("doc_id"), F.inline("protected")))
        labels = E.confusion(toks, told, held).join(toks, ["doc_id", "start"]).join(told.select("doc_id", "start", F.col("types").alias("tag")), ["doc_id", "start"], "left").select("doc_id", "start", "token", "tag", "label")
        tags = E.tag_table(docs.sparkSession) if tags is None else tags
        return {"tokens": labels, "by_doc": E.metrics(labels, "doc_id"), "total": E.metrics(labels), "uncorrected": E.metrics_over_nothing(E.metrics(labels)), "corrected": E.metrics(E.corrected(labels, tags)), "tag_recall": E.tag_recall(labels, tags)}


def normalised(rows: DataFrame, ref_date: str) -> Column:
    """The dates and ages of a row's excludes, read, and what replaces them: array of start, stop, phi_type, token, date, age, replacement.

    With columns _mw_offset, _mw_born and _mw_meta in rows, a date becomes the date less the
    offset, written by the parts it has; an age stays as its number where the shifted birth
    date gives an age of at most 90 on ref_date, and is masked above. What can't be read or
    has no offset has no replacement, nor has what a known identifier touches at its start.
    """
    known = F.transform(F.filter("excludes", lambda x: x["phi_type"].isin(*PROBE_TYPES)), lambda x: x["start"])
    meta = "_mw_offset" in rows.columns
    ref = F.lit(ref_date).cast("date")
    now = D.age_on(D.shift(F.col("_mw_born"), F.col("_mw_offset")), ref) if meta else None

    names = ("start", "stop", "phi_type", "token")

    def read(x: Column) -> Column:
        day = x["phi_type"] == "DATE"
        return F.struct(*[x[c].alias(c) for c in names], F.when(day, D.parse(x["token"])).alias("date"), F.when(~day, D.parse_age(x["token"])).alias("age"))

    def one(x: Column) -> Column:
        shown = F.lit(None).cast("string")
        if meta:
            shifted = D.render(D.shift_partial(x["date"], F.col("_mw_offset"), F.col("_mw_born"), ref))
            put = F.when(x["phi_type"] == "DATE", shifted).when(now >= 91, M.MARK).when(now > 0, x["age"].cast("string"))
            shown = F.when(~F.array_contains(known, x["start"]), put)
        return F.struct(*[x[c].alias(c) for c in (*names, "date", "age")], shown.alias("replacement"))

    # dates are read once, in the inner step, however often the outer one names them
    return F.transform(F.transform(F.filter("excludes", lambda x: x["phi_type"].isin("DATE", *AGES)), read), one)


def deidentify(docs: DataFrame, patterns: list[Pattern], probes: DataFrame | None = None, meta: DataFrame | None = None, ref_date: str = "2020-01-01", tag=None, work: str | None = None) -> Deidentified:
    """docs(doc_id, text, note_key if any) by a filter list, with probes(doc_id, kind, value) and metadata of notes.

    probes and meta(doc_id, date_offset, birth_date) belong to the notes of that note_key, or
    doc_id where docs has no note_key; of several rows of meta for a note the least counts. A
    replacement stands for its whole span where a protected span starts with it; what is left of
    protected spans beside replacements is masked as ever. With work, a path that all executors
    share, resolved notes are written there once, and masks, logs and evaluation read them.
    """
    if probes is not None and not any(p.type == "dynamic_set" for p in patterns):
        patterns = [*patterns, Pattern("known identifiers", "dynamic_set", True, "PROBEDYNAMICSET")]
    docs = docs.select("doc_id", "text", *(["note_key"] if "note_key" in docs.columns else []))
    rows = resolved(docs, patterns, probes, tag, words=True)
    if meta is not None:
        side = meta.where("doc_id is not null").groupBy(F.col("doc_id").alias("_mw_note")).agg(F.min(F.struct("date_offset", F.col("birth_date").try_cast("date").alias("born"))).alias("_mw_meta"))
        rows = rows.join(side, rows["note_key" if "note_key" in docs.columns else "doc_id"] == F.col("_mw_note"), "left").withColumns({"_mw_offset": F.col("_mw_meta.date_offset"), "_mw_born": F.col("_mw_meta.born")})
    rows = rows.withColumn("norms", normalised(rows, ref_date)).select(*docs.columns, "includes", "excludes", "protected", "probed", "norms")
    if work:
        rows.write.mode("overwrite").parquet(work)
        rows = docs.sparkSession.read.schema(rows.schema).parquet(work)
    return Deidentified(rows, docs.columns)
