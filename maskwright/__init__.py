"""maskwright: de-identification of free text as Spark plans."""

#: Bytes of a batch of rows that goes to Python at once; a longer row is a batch of its own.
ARROW_BYTES = 16 << 20


def configure(spark):
    """Settings that results depend on; call it once per session before using the operators.

    Spark 4.1 takes a union of parts dealt by one key to be dealt by it too, and then leaves rows
    of a self-join unmatched; so unions must not pass a partitioning on. Batches that go to
    Python are bounded by bytes, as texts have no bound that rows could stand for.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def spread(df):
    """df, its rows dealt out evenly if its scan has fewer splits than the cluster has cores, as small tables have; large ones are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df
