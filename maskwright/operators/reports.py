"""Counts and summaries per document, batch, type and word."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def doc_summary(docs: DataFrame, tokens: DataFrame, protected: DataFrame) -> DataFrame:
    """doc_id, file_size (bytes), total_tokens, phi_tokens; one row per document."""
    t = tokens.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_tokens"))
    p = protected.groupBy("doc_id").agg(F.count(F.lit(1)).alias("phi_tokens"))
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("file_size")).join(t, "doc_id", "left").join(p, "doc_id", "left")
    return rows.fillna(0, ["total_tokens", "phi_tokens"])


def batch_summary(summary: DataFrame) -> DataFrame:
    """One row: number, kilobytes, totals, medians and the 2.5 and 97.5 percentiles (linear interpolation)."""
    q = lambda c, p: F.round(F.percentile(c, F.lit(p)), 4)
    return summary.agg(
        F.count(F.lit(1)).alias("n_docs"), F.round(F.sum("file_size") / 1000, 3).alias("kilobytes"), F.sum("total_tokens").alias("tokens"), F.sum("phi_tokens").alias("phi_tokens"),
        q("total_tokens", 0.5).alias("median_tokens"), q("phi_tokens", 0.5).alias("median_phi"), q("phi_tokens", 0.025).alias("low_phi"), q("phi_tokens", 0.975).alias("high_phi"),
    )


def word_counts(tokens: DataFrame) -> DataFrame:
    """word, n, n_phi of tokens(token, phi): how often each word occurs, and how often as a protected one."""
    return tokens.groupBy(F.lower("token").alias("word")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("phi")).alias("n_phi"))


def bigrams(tokens: DataFrame) -> DataFrame:
    """word, next_word, n, n_phi of tokens(doc_id, nth, token, phi) that follow each other in a document; n_phi counts pairs of two protected ones."""
    order = Window.partitionBy("doc_id").orderBy("nth")
    pairs = tokens.select(F.lower("token").alias("word"), F.lower(F.lead("token").over(order)).alias("next_word"), (F.col("phi") & F.lead("phi").over(order)).alias("both"))
    return pairs.where("next_word is not null").groupBy("word", "next_word").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("both")).alias("n_phi"))


def parse_outcomes(norms: DataFrame) -> DataFrame:
    """phi_type, parsed, failed, replaced of norms(phi_type, date, age, replacement): what was read, what not, and what has a replacement."""
    read = F.col("date").isNotNull() | F.col("age").isNotNull()
    return norms.groupBy("phi_type").agg(F.count_if(read).alias("parsed"), F.count_if(~read).alias("failed"), F.count_if(F.col("replacement").isNotNull()).alias("replaced"))


def surrogate_counts(norms: DataFrame) -> DataFrame:
    """phi_type, n: how many spans of each type have a replacement."""
    return norms.where("replacement is not null").groupBy("phi_type").agg(F.count(F.lit(1)).alias("n"))


def distinct_shapes(shapes: DataFrame) -> DataFrame:
    """n_shapes, n: how many shapes there are, and of how many words."""
    return shapes.agg(F.count_distinct("shape").alias("n_shapes"), F.count(F.lit(1)).alias("n"))


def next_run(runs: DataFrame, *by: str) -> DataFrame:
    """by, next_run: the number after the greatest run of each batch; 1 for a table without runs."""
    return runs.groupBy(*by).agg((F.coalesce(F.max("run"), F.lit(0)) + 1).alias("next_run"))


def batches(notes: DataFrame, *by: str) -> DataFrame:
    """The distinct batches of notes."""
    return notes.select(*by).distinct()


def bootstrap(rows: DataFrame, key: str, value: str, replicates: int) -> DataFrame:
    """replicate, n, total of Poisson(1) resamples by the digest of replicate and key: one job, steady over reruns.

    Weights are by inversion of the Poisson distribution at a uniform number of 28 bits.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("replicate").cast("string"), F.col(key).cast("string"))), 1, 7), 16, 10).cast("double") / float(1 << 28)
    weight = sum((F.when(F.col("u") >= x, 1).otherwise(0) for x in POISSON), F.lit(0))
    drawn = rows.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("u", u).withColumn("w", weight)
    return drawn.groupBy("replicate").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col(value)).alias("total"))


#: Cumulative probabilities of 0 to 6 under Poisson(1).
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)
