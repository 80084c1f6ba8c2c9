"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame operations only.

1. Texts become lower-case words of letters and digits. A window that reaches the required
   similarity with an item shares one of the item's shingles with it, so windows of the item's
   size are laid out only where a shingle of the document is one of the benchmark's, at the
   offset that the shingle has in the item. This gate loses no pair that step 4 would accept
   at such an offset.
2. Each window, and each item, has a 64-bit SimHash of its words.
3. The fingerprint is cut into blocks. If two fingerprints differ in at most RADIUS bits, some
   block differs in at most BLOCK_RADIUS, so each item is indexed under every value within
   BLOCK_RADIUS of its blocks, and a window looks up its blocks as they are.
4. Pairs within the radius, and each window with the items that it was laid out for, however
   many bits they differ in, are verified by the exact Jaccard similarity of their shingles,
   weighted by how often each occurs.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, table, written

SHINGLE, SIMILARITY = 5, 0.8
#: Widths of the blocks, and the bits by which one block may differ: all within 5 * 3 - 1 = 14 bits are found.
BLOCKS, BLOCK_RADIUS = (13, 13, 13, 13, 12), 2
RADIUS = len(BLOCKS) * (BLOCK_RADIUS + 1) - 1
#: The benchmark's shingles or index entries are broadcast up to so many rows (of about 30 bytes). Beyond, hashes and places
#: (28 bytes a word of the corpus) are shuffled to meet them, with the same rows.
BROADCAST_ROWS = 1_000_000
_WORDS = "filter(split(lower(text), '[^\\\\p{L}\\\\p{N}]+', -1), w -> w <> '')"


def _bounded(df: DataFrame) -> DataFrame:
    """df, to be broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _shingle(words: str, at: str, n: int) -> str:
    """SQL: the hash of n words from a 0-based place."""
    return "xxhash64(" + ", ".join(f"{words}[{at} + {i}]" for i in range(n)) + ")"


def _simhash(words: str) -> str:
    """SQL: the 64-bit SimHash of an array of words, each as often as it occurs; a bit is 1 if it is set in over half."""
    count = "size(filter(h, x -> (shiftright(x, b) & 1L) = 1L))"
    return f"aggregate(array(transform({words}, w -> xxhash64(w))), 0L, (_, h) -> aggregate(sequence(0, 63), 0L, (acc, b) -> acc | shiftleft(if(2 * {count} > size(h), 1L, 0L), b)))"


def _shingles(words: str, n: int) -> str:
    """SQL: the shingles of an array of n words or more, each tagged with how often it occurred before."""
    plain = f"transform(sequence(0, size({words}) - {n}), i -> array_join(slice({words}, i + 1, {n}), ' '))"
    tagged = "transform(s, (x, i) -> concat(x, '#', size(filter(slice(s, 1, i + 1), y -> y = x))))"
    return f"aggregate(array({plain}), cast(array() as array<string>), (_, s) -> if(size(array_distinct(s)) = size(s), transform(s, x -> concat(x, '#1')), {tagged}))"


def _block_values(fp: str):
    """SQL of (block, value) structs of a fingerprint's blocks."""
    out, at = [], 0
    for i, w in enumerate(BLOCKS):
        out.append((i, w, f"cast(shiftrightunsigned({fp}, {at}) & {(1 << w) - 1} as int)"))
        at += w
    return out


def prepare(items: DataFrame) -> DataFrame:
    """item_id, words, n_words, k (words of a shingle: fewer in shorter items), fp, index (its entries). Items without words, or with a null text, match nothing and are left out."""
    rows = items.select("item_id", F.expr(_WORDS).alias("words")).where("size(words) > 0").withColumn("n_words", F.size("words")).withColumn("k", F.least("n_words", F.lit(SHINGLE)))
    rows = rows.withColumn("fp", F.expr(_simhash("words")))
    entries = []
    for i, w, value in _block_values("fp"):
        masks = [sum(1 << b for b in c) for r in range(BLOCK_RADIUS + 1) for c in combinations(range(w), r)]
        entries.append(f"transform(array({', '.join(map(str, masks))}), m -> struct({i} as block, {value} ^ m as value))")
    return rows.withColumn("index", F.expr(f"concat({', '.join(entries)})"))


def matches(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): for each document and item, the best window at or above the similarity.

    Of equals the first window. Null and empty texts have no windows. A shorter item than a
    shingle is one shingle of its own length. Rows of one doc_id count as one document; rows
    of a null id are kept together under it. Tables may be empty.
    """
    ready = written(prepare(items), "items")
    sizes = [r["k"] for r in ready.select("k").distinct().orderBy("k").collect()]
    texts = docs.select("doc_id", row_key("doc_id", "text").alias("key"), "text").where("text is not null")
    laid = None
    for k in sizes:
        at = ready.where(F.col("k") == k).select("item_id", "n_words", F.expr(f"explode(sequence(0, n_words - {k}))").alias("offset"), "words").select(F.expr(_shingle("words", "offset", k)).alias("h"), "offset", F.col("n_words").alias("size"), "item_id")
        gate = _bounded(written(at.distinct(), "gate"))
        # only hashes of shingles and their places meet the gate, whichever way Spark joins them: no text is shuffled for it
        hashes = f"get(transform(array({_WORDS}), words -> if(size(words) >= {k}, transform(sequence(0, size(words) - {k}), i -> {_shingle('words', 'i', k)}), null)), 0)"
        rows = texts.select("key", F.expr(f"posexplode_outer({hashes})").alias("pos", "h"))
        rows = rows.join(gate, "h").select("key", (F.col("pos") - F.col("offset")).alias("start"), "size", F.lit(k).alias("k"), "item_id")
        laid = rows if laid is None else laid.unionByName(rows)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, similarity double, start_word int, n_words int"
    if laid is None:
        return docs.sparkSession.createDataFrame([], schema)
    hits = written(laid.groupBy("key").agg(F.collect_set(F.struct("start", "size", "k", "item_id")).alias("hits")), "hits")
    hit = texts.join(hits, "key").select("doc_id", F.expr(_WORDS).alias("words"), "hits")
    hit = hit.select("doc_id", "words", F.explode("hits").alias("x")).select("doc_id", "words", F.expr("greatest(0, least(x.start, size(words) - x.size))").alias("start"), "x.size", "x.k", "x.item_id")
    laid = written(hit.select("doc_id", "start", "size", F.expr("slice(words, start + 1, size)").alias("window"), "k", "item_id").distinct(), "windows")
    windows = laid.drop("item_id").distinct().withColumn("fp", F.expr(_simhash("window")))
    keys = F.array(*[F.struct(F.lit(i).alias("block"), F.expr(v).alias("value")) for i, _, v in _block_values("fp")])
    keyed = windows.withColumn("key", F.explode(keys))
    index = written(ready.select("item_id", "k", "n_words", F.col("fp").alias("item_fp"), F.explode("index").alias("key")).select("item_id", "k", "n_words", "item_fp", "key.block", "key.value"), "index")
    near = keyed.join(_bounded(index).withColumnRenamed("k", "item_k"), (F.col("key.block") == F.col("block")) & (F.col("key.value") == F.col("value")) & (F.col("k") == F.col("item_k")) & (F.col("size") == F.col("n_words")))
    near = near.where(F.expr(f"bit_count(fp ^ item_fp) <= {RADIUS}")).select("doc_id", "start", "size", "window", "k", "item_id")
    pairs = near.unionByName(laid).distinct().join(_bounded(ready.select("item_id", F.col("words").alias("item_words"))), "item_id")
    both = None
    for k in sizes:
        x = pairs.where(F.col("k") == k).withColumn("a", F.expr(_shingles("window", k))).withColumn("b", F.expr(_shingles("item_words", k)))
        both = x if both is None else both.unionByName(x)
    common = F.size(F.array_intersect("a", "b"))
    scored = both.withColumn("similarity", common / (F.size("a") + F.size("b") - common)).where(F.col("similarity") >= similarity)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("at"), "size"))
    return scored.groupBy("doc_id", "item_id").agg(best.alias("x")).select("doc_id", "item_id", F.round("x.similarity", 6).alias("similarity"), (-F.col("x.at")).alias("start_word"), F.col("x.size").alias("n_words"))


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """The best window of each document and benchmark item that are alike; see matches() for null, empty and repeated rows."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a benchmark passage.

    Rows are judged by their own text: one of a null id goes if it holds a passage, and one
    that shares its id with such a row stays if it holds none. Null and empty texts stay.
    """
    keyed = docs.withColumn("_mw_key", row_key("doc_id", "text"))
    leaks = written(matches(keyed.select(F.col("_mw_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_mw_key")).distinct(), "leaks")
    return keyed.join(leaks, "_mw_key", "left_anti").select(docs.columns)
