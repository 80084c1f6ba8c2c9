"""Preparing side inputs: note keys, paths, probes, nicknames, metadata, word lists, gold annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def note_key(path: Column) -> Column:
    """The key of a note's path: its base name without .txt, .xml, _utf8 and leading zeros."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(F.regexp_replace(base, r"(_utf8)?(\.txt|\.xml)?$", ""), "^0+", "")


def shard(key: Column, widths=(2, 3, 3, 3)) -> Column:
    """The directory of a de-identified key: its leading characters, cut by widths, between slashes."""
    parts, at = [], 1
    padded = F.lpad(key, sum(widths), "0")
    for w in widths:
        parts.append(F.substring(padded, at, w))
        at += w
    return F.concat_ws("/", *parts)


def scrub(text: Column) -> Column:
    """Control characters NUL, BEL, 0x15 and 0xF0 by spaces."""
    return F.translate(text, "\x00\x07\x15\xf0", "    ")


def random_key(seed: Column, length: int = 14) -> Column:
    """A steady key of `length` characters of A-Z and 0-9 and a final B, by the digest of seed."""
    digest = F.sha2(seed.cast("string"), 256)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    chars = [F.substring(F.lit(alphabet), F.conv(F.substring(digest, 4 * i + 1, 4), 16, 10).cast("int") % 36 + 1, F.lit(1)) for i in range(length)]
    return F.concat(*chars, F.lit("B"))


#: What a source column of known identifiers holds.
PROBE_KINDS = {
    "name": ("lname", "fname", "mname", "preferred_name"), "zip": ("ZIP",), "mrn": ("MRN",), "phone": ("phone",),
    "address": ("ADDR", "empr_city", "EMERG_CITY", "EMERG_CITY_2", "FATHER_CITY", "MOTHER_CITY"), "workplace": ("empr_id_cmt",),
}


def probe_kind(source: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, names in PROBE_KINDS.items():
        out = F.when(source.isin(*names), kind).otherwise(out)
    return out


def expand_names(values: DataFrame, nicknames: DataFrame) -> DataFrame:
    """values(key, name) with each name's aliases of nicknames(name, alias) besides itself, in capitals, distinct."""
    names = values.select("key", F.upper("name").alias("name"))
    more = names.join(nicknames.select(F.upper("name").alias("name"), F.upper("alias").alias("alias")), "name").select("key", F.col("alias").alias("name"))
    return names.union(more).where("name is not null").distinct()


def first_of(df: DataFrame, *names: str) -> Column:
    """The first of several alias columns that a file has, by row the first that isn't null; null if it has none."""
    there = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def surrogate_meta(df: DataFrame) -> DataFrame:
    """note_key, date_offset, deid_note_key, birth_date, deid_birth_date, deid_turns_91_date from any of the known column names, which are fixed values."""
    return df.select(
        first_of(df, "note_key", "report_id").alias("note_key"), first_of(df, "date_offset", "deid_date_offset_cdw").try_cast("int").alias("date_offset"), first_of(df, "deid_note_key", "deid_report_id").alias("deid_note_key"),
        first_of(df, "BirthDate", "Birthdate").alias("birth_date"), first_of(df, "Deid_BirthDate", "deid_birthdate").alias("deid_birth_date"), first_of(df, "deid_turns_91_date").alias("deid_turns_91_date"),
    )


def edit_words(words: DataFrame, add: DataFrame, drop: DataFrame) -> DataFrame:
    return words.select("word").union(add.select("word")).distinct().join(drop.select("word"), "word", "left_anti")


def curate(gold: DataFrame, keep_out: DataFrame | None = None) -> DataFrame:
    """gold(doc_id, start, stop, token, phi_type) without bare years, seasons, weekdays, short capitals and ages under 90.

    keep_out(phi_type, word) names further words by type that identify nobody, in any case, as
    acronyms of hospitals, countries or professions; a null type means every type.
    """
    drop = (
        ((F.col("phi_type") == "DATE") & (F.col("token").rlike("^[0-9]{4}$") | F.lower("token").isin("spring", "summer", "fall", "autumn", "winter", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")))
        | F.col("token").rlike("^[A-Z]{1,3}$") | ((F.col("phi_type") == "AGE<90") & F.coalesce(F.col("token").try_cast("int") < 90, F.lit(False)))
    )
    kept = gold.where(~drop)
    if keep_out is None:
        return kept
    words = keep_out.select(F.col("phi_type").alias("_type"), F.lower("word").alias("_word")).distinct()
    typed, every = words.where("_type is not null"), words.where("_type is null")
    out = kept.withColumn("_low", F.lower("token"))
    out = out.join(typed, (F.col("_low") == F.col("_word")) & (F.col("phi_type") == F.col("_type")), "left_anti")
    return out.join(every, F.col("_low") == F.col("_word"), "left_anti").drop("_low")


def note_offsets(notes: DataFrame, patients: DataFrame) -> DataFrame:
    """note_key, date_offset: notes(note_key, patient_ID) with their patient's offset; null where a patient has none, the greatest where one has several."""
    offset = patients.groupBy("patient_ID").agg(F.max("date_offset").alias("date_offset"))
    return notes.join(offset, "patient_ID", "left").select("note_key", F.col("date_offset").try_cast("int").alias("date_offset"))


def batch_notes(batch: DataFrame, notes: DataFrame) -> DataFrame:
    """A batch of keys (doc_id, ...) with their notes; keys without a note have no row."""
    return batch.join(notes, "doc_id")


def key_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, side (both, first or second) of the distinct keys of two tables; null keys are no keys."""
    one, two = (x.select(key).where(F.col(key).isNotNull()).distinct().withColumn(n, F.lit(True)) for x, n in ((a, "_a"), (b, "_b")))
    return one.join(two, key, "full").select(key, F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "first").otherwise("second").alias("side"))


def weighted_split(keys: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """keys with `part`, dealt to named parts in proportion to their weights by the digest of the key: steady over reruns."""
    total, up, at = sum(weights.values()), F.lit(None).cast("string"), 0.0
    u = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 7), 16, 10).cast("double") / float(1 << 28)
    bounds = []
    for name, w in weights.items():
        at += w
        bounds.append((name, at / total))
    for name, bound in reversed(bounds):
        up = F.when(u < bound, name).otherwise(up)
    return keys.withColumn("part", F.coalesce(up, F.lit(bounds[-1][0])))
