"""Command line: python -m maskwright --input notes --config filters.json --output out [--probes p.tsv] [--meta m.tsv] [--gold xml]"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import configure, sources
from .plans.deidentify import deidentify
from .plans.macros import macros
from .plans.patterns import expand, load


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="maskwright", description="De-identify a directory of notes.")
    p.add_argument("--input", required=True, help="directory of *txt notes, or parquet of doc_id and text")
    p.add_argument("--config", required=True, help="JSON list of filters")
    p.add_argument("--output", required=True)
    p.add_argument("--format", choices=("parquet", "text", "xml"), default="parquet")
    p.add_argument("--probes", help="TSV of value, phi_type and note_key")
    p.add_argument("--meta", help="TSV of note keys, date offsets and birth dates")
    p.add_argument("--gold", help="annotated XML files")
    p.add_argument("--gold-types", default="", help="comma-separated tags of the annotated files; all that they hold by default")
    p.add_argument("--gold-row", default="doc", help="root element of the annotated files")
    p.add_argument("--ref-date", default="2020-01-01")
    p.add_argument("--words", action="append", default=[], metavar="NAME=FILE", help="JSON list or object of the words of a macro, such as town_names")
    p.add_argument("--no-logs", action="store_true")
    a = p.parse_args(argv)
    spark = configure(spark or SparkSession.builder.appName("maskwright").getOrCreate())
    base = Path(a.config).parent
    known = macros(words={n: list(json.loads(Path(f).read_text())) for n, f in (x.split("=", 1) for x in a.words)})
    patterns = load(Path(a.config).read_text(), lambda f: _expanded((base / f).read_text(), known))
    notes = spark.read.parquet(a.input) if a.input.endswith(".parquet") else sources.text_notes(spark, a.input)
    notes = notes.select(F.col("doc_id").cast("string").alias("doc_id"), "text", *(["note_key"] if "note_key" in notes.columns else []))
    probes = sources.probes_tsv(spark, a.probes).withColumnRenamed("note_key", "doc_id") if a.probes else None
    meta = sources.surrogate_tsv(spark, a.meta).withColumnRenamed("note_key", "doc_id") if a.meta else None
    out = deidentify(notes, patterns, probes, meta, a.ref_date, work=f"{a.output}/accepted")
    made = sources.annotated_notes(out.rows, a.gold_row) if a.format == "xml" else out.masked
    (sources.write_notes if a.format == "parquet" else sources.write_note_files)(made.select("doc_id", "text"), f"{a.output}/notes")
    if not a.no_logs:
        sources.write_logs(out.logs(), f"{a.output}/log")
    if a.gold:
        _, gold = sources.xml_annotations(spark, a.gold, a.gold_row, tuple(x for x in a.gold_types.split(",") if x))
        sources.write_evaluation(out.evaluate(gold), f"{a.output}/eval")


def _expanded(text: str, known: dict[str, str]) -> str:
    """A filter file with its macros put in; the place of a note's own probes stays."""
    return expand(text, known | {"probe": '"""+probe+r"""'})


if __name__ == "__main__":
    main()
