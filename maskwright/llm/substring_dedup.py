"""Substring dedup by content-defined chunking with a gear rolling hash.

The gear hash rolls over words: it shifts by eight bits a word and adds the word's gear
value, so it holds the last four words and nothing before. A word ends a chunk where its
hash is the least within REACH words on either side (the first, of equals), so cuts depend on
nearby words only: an insertion moves no cut but those next to it. Chunks are counted by
digest over all documents; adjoining chunks that occur more than once make a span.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, map_arrow, table, written

#: Words on either side within which a cut's hash is the least (chunks of about 2 * REACH + 1 words).
REACH = 4
#: Spans of fewer words are too short to report.
MIN_WORDS = 16
_CACHE = 1 << 19


def cuts(gear: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Places after which a chunk ends, for the gear values (uint32) of a text's words; the end is always one."""
    n = len(gear)
    if n == 0:
        return np.zeros(0, np.int64)
    h = gear.copy()
    for back in range(1, 4):
        h[back:] += gear[:-back] << np.uint32(8 * back)
    wide = np.concatenate((np.full(reach, 2**32, np.uint64), h.astype(np.uint64), np.full(reach, 2**32, np.uint64)))
    least = np.ones(n, bool)
    mid = wide[reach : reach + n]
    for d in range(1, reach + 1):
        least &= (mid < wide[reach - d : reach - d + n]) & (mid <= wide[reach + d : reach + d + n])
    # Without a cut for long (as where one word repeats), the chunk ends anyway, counted from the last cut.
    at = np.flatnonzero(least) + 1
    bounds = np.unique(np.concatenate(([0], at, [n])))
    gaps = np.flatnonzero(np.diff(bounds) > 16 * reach)
    extra = [np.arange(bounds[i] + 16 * reach, bounds[i + 1], 16 * reach) for i in gaps]
    return np.unique(np.concatenate([bounds[1:], *extra]))


def chunks(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, row (of docs), start, n (words) and the 128-bit digest of each chunk as two longs. Words are lower-cased A-Z."""
    rows = docs.select(F.col(key).alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        gears: dict[bytes, int] = {}
        for b in batches:
            ids, row, start, size, digest = [], [], [], [], []

            def flush(b=b, ids=ids, row=row, start=start, size=size, digest=digest):
                d = np.frombuffer(b"".join(digest), ">i8").astype(np.int64).reshape(-1, 2)
                return pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("doc_id").type), pa.array(row, pa.int64()), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(d[:, 0]), pa.array(d[:, 1])], names=["doc_id", "row", "start", "n", "hi", "lo"])

            for key_, row_, text in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), b.column("text"), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
                if not words:
                    continue
                if len(gears) > _CACHE:
                    gears.clear()
                for w in {w for w in words if w not in gears}:
                    gears[w] = zlib.crc32(w) * 0x9E3779B1 & 0xFFFFFFFF
                ends = cuts(np.fromiter((gears[w] for w in words), np.uint32, len(words))).tolist()
                at = 0
                for e in ends:
                    ids.append(key_)
                    row.append(row_)
                    start.append(at)
                    size.append(e - at)
                    digest.append(xxhash.xxh3_128_digest(b" ".join(words[at:e])))
                    at = e
                if len(ids) > 100_000:
                    yield flush()
                    for x in (ids, row, start, size, digest):
                        x.clear()
            if ids:
                yield flush()

    return map_arrow(rows, run, f"doc_id {kind}, row long, start int, n int, hi long, lo long")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start_word, n_words, n_copies, is_first): maximal runs of repeated chunks of min_words or more.

    n_copies is the number of rows that hold the least repeated chunk of the run; is_first
    tells that all its chunks are the first occurrence, the one to keep, in the order of
    doc_id, then row, then place. Repeats within one text count like others. Null and empty
    texts have no chunks. Rows with a null doc_id come first in that order; repeated rows
    repeat each other. Very long texts are cut whole; an empty table gives no rows, and other
    columns are not read.
    """
    all_chunks = written(chunks(docs), "chunks")
    first = F.min(F.struct("doc_id", "row", "start"))
    twice = written(all_chunks.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("copies"), first.alias("first")).where("copies > 1"), "repeated-chunks")
    hits = all_chunks.join(twice, ["hi", "lo"]).select("doc_id", "row", "start", "n", "copies", F.struct("doc_id", "row", "start").eqNullSafe(F.col("first")).alias("is_first"))
    by_row = Window.partitionBy("row").orderBy("start")
    island = F.sum(F.when(F.lag(F.col("start") + F.col("n")).over(by_row) == F.col("start"), 0).otherwise(1)).over(by_row)
    runs = hits.withColumn("run", island).groupBy("row", "run").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start_word"), F.sum("n").alias("n_words"), F.min("copies").alias("n_copies"), F.every("is_first").alias("is_first"))
    return runs.where(F.col("n_words") >= min_words).select("doc_id", "start_word", "n_words", "n_copies", "is_first")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """One row per span of a document that repeats; see repeated_spans() for null, empty and repeated rows."""
    return repeated_spans(table(spark, sf_dir, "documents"))
