"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source's documents are shuffled by the digest of their id; a document's virtual finish
time is the running count of its source's words, itself included, over the source's target,
going through the source a second time where the target asks for it. All are ordered by
that time and taken up to the total budget. Running sums are taken within many small
buckets and lifted by the sums of the buckets before, so no source is in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, row_key, table, written

WEIGHTS, SHARE, EPOCHS = (5, 2, 1), 1.5, 2
#: Leading hex digits of the shuffle digest that name a bucket of a source; buckets of a unit of virtual time.
ORDER_DIGITS, HEAD_DIGITS, TIME_BUCKETS = 4, 2, 8192


#: Documents that the slot in which the budget ends may hold to be ordered in full; larger ones are divided again.
SLOT = 100_000
_KEY = "md5(coalesce(cast(doc_id as string), concat('text:', text), 'null'))"


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = EPOCHS) -> DataFrame:
    """sources(source, skey, source_size) with target: `share` of all words dealt by weight, none above `most` times its source.

    Sources are ordered by code point, null last, and weigh `weights` in turn. Those with the
    least size for their weight fill first; what then remains over the weights that remain is
    the level that the others reach. Needs share <= most. The unpartitioned windows hold one
    row per source. A source of no words has target zero.
    """
    by_name, every = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy(F.lit(0))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    w = sources.withColumn("rank", F.row_number().over(by_name) - 1)
    w = w.withColumn("weight", F.get(F.array(*[F.lit(x) for x in weights]), F.col("rank") % len(weights))).withColumn("cap", F.col("source_size") * most)
    w = w.withColumn("left", F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    w = w.withColumn("level", F.col("left") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))).withColumn("nth", F.row_number().over(fill))
    held = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("nth", "level"))).over(every)["level"]
    return w.withColumn("level", held).select("source", "skey", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def sized(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """carry, doc_id, source, size (words of the whole text), skey (source, never null) and key (the shuffle's digest)."""
    return docs.select(
        *carry, "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")).alias("skey"),
        F.expr(_KEY).alias("key"),
    )


def _starts(rows: DataFrame) -> DataFrame:
    """(skey, bucket, start, source_size, target): words of the source before each bucket of the shuffle's digest.

    Buckets are summed by their leading digits first, so a running sum goes over a source's
    16 ** HEAD_DIGITS heads, or over one head's buckets, and no source's buckets are in one task.
    """
    head = F.substring("bucket", 1, HEAD_DIGITS).alias("head")
    sums = written(rows.groupBy("skey", F.substring("key", 1, ORDER_DIGITS).alias("bucket")).agg(F.first("source").alias("source"), F.sum("size").alias("words")), "mix-sums")
    heads = written(sums.groupBy("skey", head).agg(F.first("source").alias("source"), F.sum("words").alias("words")), "mix-heads")
    goals = targets(heads.groupBy("skey").agg(F.first("source").alias("source"), F.sum("words").alias("source_size")))
    past = lambda order, *by: F.coalesce(F.sum("words").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lifts = written(heads.select("skey", "head", past("head", "skey").alias("lift")).join(goals.drop("source"), "skey"), "mix-lifts")
    within = sums.select("skey", head, "bucket", "words").withColumn("past", past("bucket", "skey", "head"))
    return written(within.join(lifts, ["skey", "head"]).select("skey", "bucket", (F.col("past") + F.col("lift")).alias("start"), "source_size", "target"), "mix-starts")


def _end(queue: DataFrame, budget: float, most: int = SLOT):
    """The first place of queue(at, size) at which the running sum of sizes is over the budget; None if it never is.

    Virtual time is divided into slots whose sums tell in which of them the budget ends; that
    one is divided again while it holds over `most` documents of different times, and only
    what is left is put in order in full.
    """
    place, start, rows = F.col("at.finish") * TIME_BUCKETS, 0, queue
    while True:
        now = rows.select("at", "size", F.least(F.floor(place), F.lit(2 * TIME_BUCKETS)).alias("slot"))
        slots = now.groupBy("slot").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.min("at.finish").alias("low"), F.max("at.finish").alias("high"))
        slots = slots.withColumn("start", F.lit(start) + F.coalesce(F.sum("words").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        last = slots.where((F.col("start") <= budget) & (F.col("start") + F.col("words") > budget)).orderBy("slot").first()
        if last is None:
            return None
        rows, start = now.where(F.col("slot") == last["slot"]).select("at", "size"), last["start"]
        if last["n"] <= most or last["low"] == last["high"]:
            break
        place = (F.col("at.finish") - F.lit(last["low"])) / F.lit(last["high"] - last["low"]) * TIME_BUCKETS
    over = rows.withColumn("cum", F.lit(start) + F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("at").rangeBetween(Window.unboundedPreceding, 0)))
    return over.where(F.col("cum") > budget).agg(F.min("at").alias("at")).first()["at"]


def mix(docs: DataFrame, carry: tuple[str, ...] = (), slot: int = SLOT) -> DataFrame:
    """carry, doc_id, source, size, source_size, target, taken (words taken, repeats counted); one row per row of docs.

    A null text has no words; a null source is a source of its own, after the others. Rows of
    equal id and size tie and are taken or left together; rows of one id and unlike texts have
    their own sizes. Very long texts count whole. Reruns give the same rows; an empty table
    gives none, and columns of docs other than carry, doc_id, text and source are not read.
    """
    rows = written(sized(docs, carry), "mix-sizes")
    starts = _starts(rows)
    within = Window.partitionBy("skey", "bucket").orderBy("key", "doc_id", "size").rangeBetween(Window.unboundedPreceding, 0)
    ran = rows.withColumn("bucket", F.substring("key", 1, ORDER_DIGITS)).join(starts, ["skey", "bucket"]).withColumn("cum", F.col("start") + F.sum("size").over(within))
    ran = written(ran.select(*carry, "doc_id", "key", "source", "skey", "size", "source_size", "target", "cum"), "mix-order")

    def place(epoch):
        finish = F.coalesce((F.col("cum") + epoch * F.col("source_size")) / F.nullif(F.col("target"), F.lit(0.0)), F.lit(0.0))
        return F.struct(finish.alias("finish"), "skey", "key", F.coalesce("doc_id", F.lit(-1)).cast("long").alias("id"), "size")

    budget = float(starts.select("skey", "target").distinct().agg(F.sum("target")).first()[0] or 0.0)
    queue = ran.where("size > 0").select(F.explode(F.array(*[place(F.lit(e)) for e in range(EPOCHS)])).alias("at"), "size")
    cut = _end(queue, budget, slot)
    took = F.lit(EPOCHS)
    if cut is not None:
        end = F.struct(F.lit(cut["finish"]).alias("finish"), F.lit(cut["skey"]).alias("skey"), F.lit(cut["key"]).alias("key"), F.lit(cut["id"]).cast("long").alias("id"), F.lit(cut["size"]).cast("long").alias("size"))
        took = sum((F.when(place(F.lit(e)) < end, 1).otherwise(0) for e in range(EPOCHS)), F.lit(0))
    return ran.select(*carry, "doc_id", "source", "size", "source_size", "target", (F.col("size") * took).cast("long").alias("taken"))


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    """One row per document; see mix() for null, empty, tied and repeated rows."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their words, their source's target, and how often each is taken.

    Rows are told apart by id, source and text, so each has its own size. Columns of docs that
    bear the name of one of these are replaced by it.
    """
    new = ["size", "source_size", "target", "taken"]
    keyed = docs.withColumn("_mw_key", row_key("doc_id", "source", "text"))
    mixed = written(mix(keyed, ("_mw_key",)).where("taken > 0").select("_mw_key", *new).distinct(), "mixed")
    own = keyed.select([c for c in keyed.columns if c not in (*new, "repeats")])
    return own.join(mixed, "_mw_key").drop("_mw_key").withColumn("repeats", (F.col("taken") / F.col("size")).cast("int"))


#: The rows of op4_mix_sources.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce('s' || source, 'null') AS skey,
         md5(coalesce(doc_id::VARCHAR, 'text:' || text, 'null')) AS key
  FROM documents),
src AS (SELECT skey, min(source) AS source, sum(size)::BIGINT AS source_size FROM sized GROUP BY skey),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM src),
weighed AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2 AS cap FROM ranked),
filled AS (
  SELECT *, row_number() OVER fill AS nth,
         ((sum(source_size) OVER ())::DOUBLE * 1.5 - (coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE)
         / ((sum(weight) OVER ())::DOUBLE - (coalesce(sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE) AS level
  FROM weighed WINDOW fill AS (ORDER BY cap::DOUBLE / weight, rank)),
goal AS (SELECT skey, source_size, least(cap::DOUBLE, (SELECT arg_min(level, nth) FROM filled WHERE level * weight <= cap) * weight) AS target FROM filled),
ran AS (
  SELECT s.*, g.source_size, g.target,
         (sum(s.size) OVER (PARTITION BY s.skey ORDER BY s.key, s.doc_id, s.size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS cum
  FROM sized s JOIN goal g USING (skey)),
queue AS (
  SELECT doc_id, skey, key, size, e, coalesce((cum + e * source_size)::DOUBLE / nullif(target, 0), 0) AS finish
  FROM ran, (VALUES (0), (1)) AS epochs(e)),
summed AS (
  SELECT *, sum(size) OVER (ORDER BY finish, skey, key, doc_id, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM queue),
took AS (
  SELECT doc_id, key, skey, size, count(DISTINCT e) FILTER (WHERE total <= (SELECT sum(target) FROM goal)) AS n
  FROM summed GROUP BY doc_id, key, skey, size)
SELECT r.doc_id, r.size, r.source_size, r.target, (r.size * t.n)::BIGINT AS taken
FROM ran r JOIN took t ON r.doc_id IS NOT DISTINCT FROM t.doc_id AND r.key = t.key AND r.skey = t.skey AND r.size = t.size
"""
