"""Table input."""


def spread(df, key):
    """Spread a table that arrives in fewer splits than there are cores; larger inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * 4, key)


def read_parquet(spark, path, key=None, columns=None):
    df = spark.read.parquet(path)
    if columns:
        df = df.select(*columns)
    return spread(df, key) if key else df


def piece_count(spark):
    """Pieces that a table is cut into where size-based coalescing would make too few."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def fan_out(df, *keys, pieces=1):
    """Hash-partition rows that are cheap to move but costly to process, past any size-based coalescing."""
    return df.repartition(piece_count(df.sparkSession) * pieces, *keys)
