"""Readers of notes and side inputs, and writers of results."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.mask import annotation_tag
from ..operators.prepare import note_key, note_offsets, probe_kind, shard, surrogate_meta
from ..operators.reports import next_run, surrogate_counts


#: Byte order marks and the charsets they tell; without one, UTF-8 if the bytes are that, else `fallback`.
_MARKS = ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE"))


def decoded(content: Column, fallback: str = "ISO-8859-1") -> Column:
    """Bytes as text by their mark, as UTF-8 where they are that, else in the fallback charset."""
    out = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, fallback))
    for mark, charset in reversed(_MARKS):
        n = len(mark)
        bare = F.substring(content, n + 1, (1 << 31) - 1)
        out = F.when(F.hex(F.substring(content, 1, n)) == mark.hex().upper(), F.decode(bare, charset)).otherwise(out)
    return out


def text_notes(spark: SparkSession, path: str, fallback: str = "ISO-8859-1") -> DataFrame:
    """doc_id (the file's path below `path`), note_key, text of *txt files, but those of meta_data.

    Files of one name in different directories are different notes with one note_key, by which
    side inputs name them. Empty files have no row, as Spark reads none of them.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*txt").load(path).where(~F.contains("path", F.lit("meta_data")))
    return raw.select(below(F.col("path"), path).alias("doc_id"), note_key(F.col("path")).alias("note_key"), decoded(F.col("content"), fallback).alias("text"))


def below(file: Column, root: str) -> Column:
    """A file's path below a root, or its whole path where it doesn't lie there."""
    bare = F.regexp_replace(file, "^[a-z0-9]+:/+", "/")
    head = "/" + re.sub("^[a-z0-9]+:/+", "", root).strip("/") + "/"
    return F.when(F.startswith(bare, F.lit(head)), F.substring(bare, len(head) + 1, (1 << 31) - 1)).otherwise(bare)


def xml_annotations(spark: SparkSession, path: str, row_tag: str, types: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(notes, gold): doc_id, text, and doc_id, phi_type, id, start, stop, token of the tags of annotated XML files.

    doc_id is the note key of the file. Bounds are in `spans` (a~b) or in `start` and `end`.
    Without types, all tags that the files hold are read: their names are gathered first.
    """
    attr = T.StructType([T.StructField(f"_{c}", T.StringType()) for c in ("id", "start", "end", "spans", "text", "TYPE", "comment")])
    if not types:
        body = F.regexp_extract(F.regexp_replace("value", r"(?s)<TEXT>.*</TEXT>", ""), r"(?s)<TAGS>(.*)</TAGS>", 1)
        names = spark.read.text(path, wholetext=True).select(F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit(r"<([A-Za-z][\w.-]*)[\s/>]"), F.lit(1)))).alias("tag")).distinct()
        types = tuple(sorted(r["tag"] for r in names.collect()))  # the tags of one corpus: a fixed, small set of names
    tags = T.StructType([T.StructField(t, T.ArrayType(attr)) for t in types])
    df = spark.read.format("xml").option("rowTag", row_tag).schema(T.StructType([T.StructField("TEXT", T.StringType()), T.StructField("TAGS", tags)])).load(path)
    df = df.select(note_key(F.input_file_name()).alias("doc_id"), F.col("TEXT").alias("text"), "TAGS")
    bound = lambda i, c: F.coalesce(F.expr(f"try_cast(split(x._spans, '~')[{i}] as bigint)"), F.expr(f"try_cast(x._{c} as bigint)"))

    def tagged(t: str) -> Column:
        return F.transform(F.coalesce(F.col("TAGS")[t], F.array().cast(T.ArrayType(attr))), lambda x: F.struct(F.lit(t).alias("tag"), x.alias("x")))

    each = [tagged(t) for t in types]
    if not each:
        return df.select("doc_id", "text"), spark.createDataFrame([], "doc_id string, phi_type string, id string, start long, stop long, token string")
    rows = df.select("doc_id", F.inline(F.concat(*each)))
    return df.select("doc_id", "text"), rows.select("doc_id", F.coalesce("x._TYPE", "tag").alias("phi_type"), F.col("x._id").alias("id"), bound(0, "start").alias("start"), bound(1, "end").alias("stop"), F.col("x._text").alias("token"))


def probes_tsv(spark: SparkSession, path: str) -> DataFrame:
    """note_key, kind, value of a tab-separated file of known identifiers, all strings, latin-1."""
    df = spark.read.csv(path, sep="\t", header=True, encoding="ISO-8859-1", inferSchema=False)
    return df.select(F.regexp_replace("note_key", "^0+", "").alias("note_key"), probe_kind(F.col("phi_type")).alias("kind"), "value").where("kind is not null and value is not null")


def surrogate_tsv(spark: SparkSession, path: str) -> DataFrame:
    return surrogate_meta(spark.read.csv(path, sep="\t", header=True, inferSchema=False))


def word_set(spark: SparkSession, path: str) -> DataFrame:
    """word of a JSON object of words to numbers, or of a JSON list of words."""
    raw = spark.read.text(path, wholetext=True)
    keys = F.coalesce(F.json_object_keys("value"), F.from_json("value", "array<string>"))
    return raw.select(F.explode(keys).alias("word")).distinct()


def phi_notes_json(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text, phi (array of maps) of a JSON object of files."""
    kind = "map<string,struct<text:string,phi:array<map<string,string>>>>"
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("doc_id", "v")).select("doc_id", "v.text", "v.phi")


def nicknames_csv(spark: SparkSession, path: str, least: float = 0.0) -> DataFrame:
    df = spark.read.csv(path, header=True)
    return df.where(F.col("ALIAS FREQ").try_cast("double") >= least).select(F.col("NAME").alias("name"), F.col("ALIAS").alias("alias")).distinct()


def write_notes(notes: DataFrame, path: str) -> None:
    """notes(doc_id, text) below path, in one directory per leading byte of the id's digest; a row holds one note."""
    notes.withColumn("shard", F.substring(F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 256), 1, 2)).write.partitionBy("shard").mode("overwrite").parquet(path)


def write_log(df: DataFrame, path: str, sep: str = "\t") -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=True)


def append_run(df: DataFrame, path: str, runs: DataFrame | None = None) -> int:
    """Append df under the next run number (1 where there is none yet), which is returned."""
    run = int(next_run(runs).first()["next_run"]) if runs is not None else 1
    df.withColumn("run", F.lit(run)).write.mode("append").parquet(path)
    return run


def known_phi_tsv(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (note key), phi_type, value of a tab-separated file of patient_ID, phi_type, clean_value, note_key."""
    df = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    return df.select(F.regexp_replace("note_key", "^0+", "").alias("doc_id"), "phi_type", F.col("clean_value").alias("value")).where("value is not null")


def note_offsets_csv(spark: SparkSession, notes: str, patients: str) -> DataFrame:
    """note_key, date_offset of two files: notes by patient, and patients by offset; null where a patient has none."""
    return note_offsets(*(spark.read.csv(p, header=True, inferSchema=False) for p in (notes, patients)))


def write_note_files(notes: DataFrame, path: str, sharded: bool = True) -> None:
    """notes(doc_id, text) as text files, each in its own directory `note=...`, below the four shards of the id's digest unless sharded is false.

    One small file per note is for exchange; write_notes is the form for large corpora.
    """
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    parts = F.split(shard(F.substring(F.sha2(own, 256), 1, 11)), "/")
    dirs = [f"p{i}" for i in range(4)] if sharded else []
    rows = notes.where("text is not null").select("text", own.alias("note"), *[parts[i].alias(f"p{i}") for i in range(len(dirs))])
    rows.select("text", *dirs, "note").write.partitionBy(*dirs, "note").mode("overwrite").option("lineSep", "\n").text(path)


def annotated_notes(rows: DataFrame, root: str = "note") -> DataFrame:
    """doc_id and text, the XML file, of rows(doc_id, text, protected): TEXT as CDATA and a tag per protected span."""
    safe = F.replace(F.col("text"), F.lit("]]>"), F.lit("]]]]><![CDATA[>"))
    tags = F.array_join(F.transform("protected", lambda x, i: annotation_tag(i, x["start"], x["stop"], x["token"], x["phi_type"])), "\n")
    body = F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8" ?>\n<{root}>\n<TEXT><![CDATA['), safe, F.lit("]]></TEXT>\n<TAGS>\n"), tags, F.lit(f"\n</TAGS>\n</{root}>"))
    return rows.select("doc_id", body.alias("text"))


def upsert_notes(notes: DataFrame, path: str, version: str) -> None:
    """Put notes(doc_id, text) in place of those of their shards' ids in the table at path, with the version and the time of writing.

    Only the shards that notes touch are read and written anew; the table is written beside
    first, so a job that dies leaves a whole table and can be run again.
    """
    spark = notes.sparkSession
    shard_ = F.substring(F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 256), 1, 2)
    new = notes.select("doc_id", "text", F.lit(version).alias("version"), F.current_timestamp().alias("written"), shard_.alias("shard"))
    old = _table(spark, path, new.schema)
    touched = new.select("shard").distinct()
    kept = old.join(F.broadcast(touched), "shard", "left_semi").join(new.select("doc_id"), "doc_id", "left_anti").select(new.columns)
    aside = f"{path.rstrip('/')}.next"
    kept.unionByName(new).write.partitionBy("shard").mode("overwrite").parquet(aside)
    done = spark.read.schema(new.schema).parquet(aside)
    done.write.partitionBy("shard").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def _table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at path, without rows where there is none yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def metadata_of(table: DataFrame, notes: DataFrame) -> DataFrame:
    """Surrogate metadata (see surrogate_meta) of the notes(note_key) only, from a table of all."""
    return surrogate_meta(table).join(notes.select("note_key").distinct(), "note_key", "left_semi")


def write_logs(logs: dict[str, DataFrame], path: str) -> None:
    """Each log as tab-separated files below path."""
    for name, df in logs.items():
        flat = df.select(*[F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, T.StructType) else F.col(c) for c in df.columns])
        write_log(flat, f"{path}/{name}")


def write_evaluation(results: dict[str, DataFrame], path: str) -> None:
    """Token lists per label as tab-separated files, summaries as JSON."""
    tokens = results["tokens"]
    tokens.write.partitionBy("label").mode("overwrite").csv(f"{path}/tokens", sep="\t", header=True)
    for name, df in results.items():
        if name != "tokens":
            df.write.mode("overwrite").json(f"{path}/{name}")


def write_detailed_evaluation(errors: DataFrame, path: str, width: int = 10) -> None:
    """Tables of errors(doc_id, start, label, token, tag, pos, context, exclude_filters, include_filters), `|` between columns.

    fn_tags_context and fp_tags_context have each error, fn_tags and fp_tags the errors that are
    alike in all but place and context, with their number; summary.json the counts by label.
    """
    by = ["token", "tag", "pos", "exclude_filters", "include_filters"]
    for label in ("FN", "FP"):
        rows = errors.where(F.col("label") == label)
        write_log(rows.select("doc_id", "start", *by, "context"), f"{path}/{label.lower()}_tags_context", "|")
        write_log(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("occurrences"), F.min("doc_id").alias("first_doc")), f"{path}/{label.lower()}_tags", "|")
    errors.groupBy("label").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(f"{path}/summary")


def write_surrogate_logs(norms: DataFrame, path: str, evaluation: DataFrame | None = None) -> None:
    """shifted_dates, surrogated_text, counts_by_phi_type, failed_to_parse and, of evaluate.shift_evaluation(), date_shift_eval, `|` between columns, of norms(doc_id, start, stop, phi_type, token, date, age, replacement)."""
    day, shown = norms.where("phi_type = 'DATE'"), ("doc_id", "start", "stop", "token")
    write_log(day.where("date is not null").select(*shown, "replacement"), f"{path}/shifted_dates", "|")
    write_log(norms.where("replacement is not null").select(*shown, "phi_type", "replacement"), f"{path}/surrogated_text", "|")
    write_log(surrogate_counts(norms), f"{path}/counts_by_phi_type", "|")
    write_log(day.where("date is null").select(*shown), f"{path}/failed_to_parse", "|")
    if evaluation is not None:
        write_log(evaluation, f"{path}/date_shift_eval", "|")


def summaries(spark: SparkSession, *paths: str) -> DataFrame:
    """The detailed summaries of several batches as one: by reports.batch_summary, the summary over all."""
    df = spark.read.csv(list(paths), sep="\t", header=True, inferSchema=False)
    return df.select("doc_id", *[F.col(c).try_cast("bigint").alias(c) for c in df.columns if c != "doc_id"])
