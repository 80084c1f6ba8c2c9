"""The same masking over a stream of notes: detection needs one note only, so each micro-batch is a whole job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.mask import mask_rows
from ..operators.resolve import resolved


def mask_stream(notes: DataFrame, patterns, path: str, checkpoint: str, once: bool = True, probes: DataFrame | None = None):
    """Mask a stream of notes(doc_id, text) and append doc_id, text to parquet under path, exactly once by the file sink's log.

    Every row is masked by itself, so the stream keeps no state and late or repeated notes are
    masked like others; probes are a table, joined to the stream.
    """
    masked = mask_rows(resolved(notes.select("doc_id", "text"), patterns, probes))
    writer = masked.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def refresh(spark: SparkSession, current: DataFrame, changes: DataFrame) -> DataFrame:
    """current(doc_id, text) after changes(doc_id, text, status): Add and Update replace a note, Delete drops it, Keep leaves it."""
    touched = changes.where("status <> 'Keep'").select("doc_id")
    return current.join(touched, "doc_id", "left_anti").unionByName(changes.where("status in ('Add', 'Update')").select("doc_id", "text"))
