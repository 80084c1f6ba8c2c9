"""The corpus pipeline: five stages from documents to a mix, each applying one operator to all that its predecessor kept.

Each stage is written as Parquet in the shared folder and read again as the next one's docs;
what a stage wrote for itself, and its predecessor's rows, go once it is done. SQL can't express
boosted trees or components of a Hamming graph, so there is no ORACLE_SQL; tests hold the stages
against brute force. An empty table goes through all stages; null and repeated ids, null and very
long texts are rows like others, as each stage's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskwright.llm import decontamination, mixing, quality_rules, secret_scan, simhash_dedup
from maskwright.llm.common import clear, made, table, written

#: (name, function of spark, docs and sf_dir); all but the last return the columns of documents.
STAGES = [
    ("quality_rules", quality_rules.stage),
    ("simhash_dedup", simhash_dedup.stage),
    ("decontamination", decontamination.stage),
    ("secret_scan", secret_scan.stage),
    ("mixing", mixing.stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES:
        out = written(stage(spark, docs, sf_dir), f"stage-{name}")
        clear(spark, since, keep_last=True)
        docs = out
    return docs
