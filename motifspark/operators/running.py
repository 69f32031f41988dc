"""Running totals and ranks over an ordered value, without putting a whole group into one task.

Rows are first combined per distinct value. The value range is cut at approximate quantiles, totals run
inside each slice, and the (few) slice totals are added on top. A value shared by many rows is one row here.
"""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F


def _slices(spark):
    """Number of slices, as a square: twice the shuffle partitions of the session, 64 at least."""
    wanted = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), 64)
    return math.isqrt(wanted - 1) + 1


def _slice_of(value, edges, step):
    """Number of edges below the value, found in two rounds of about ``step`` comparisons."""
    coarse = F.size(F.filter(edges["coarse"], lambda e: e < value))
    fine = F.slice(edges["fine"], coarse * step + 1, step)
    return coarse * step + F.size(F.filter(fine, lambda e: e < value))


def _edges(df, value, step):
    """Approximate quantiles that cut the values into step * step slices; every step-th one is also coarse."""
    n = step * step
    shares = ", ".join(f"{i / n!r}D" for i in range(1, n))
    picked = df.select(value.alias("_v")).agg(F.sort_array(F.expr(f"percentile_approx(_v, array({shares}), {10 * n})")).alias("fine"))
    coarse = F.transform(F.sequence(F.lit(step), F.lit(n - step), F.lit(step)), lambda i: F.get(F.col("fine"), i - 1))
    return picked.select(F.struct("fine", coarse.alias("coarse")).alias("e")).scalar()


def running_totals(df, keys, value, sums, descending=False, edges_of=None):
    """One row per (keys, value): each total at the value, and ``cum_`` up to and including it.

    ``sums`` maps a name to an aggregate input column. Rows without a value take no part. ``edges_of`` may name a
    smaller table with the same spread of values to place the slices by.
    """
    keys = list(keys)
    known = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    per = known.groupBy(*keys, value).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    step = _slices(df.sparkSession)
    edges = _edges(known if edges_of is None else edges_of, F.col(value).cast("double"), step)
    cut = per.withColumn("_edges", edges).withColumn("_slice", _slice_of(F.col(value).cast("double"), F.col("_edges"), step)).drop("_edges")
    order = F.col(value).desc() if descending else F.col(value)
    inside = Window.partitionBy(*keys, "_slice").orderBy(order)
    out = cut.select("*", *[F.sum(n).over(inside).alias(f"_in_{n}") for n in sums])
    total = cut.groupBy(*keys, "_slice").agg(*[F.sum(n).alias(f"_all_{n}") for n in sums])
    slices = Window.partitionBy(*keys).orderBy(F.col("_slice").desc() if descending else F.col("_slice"))
    before = slices.rowsBetween(Window.unboundedPreceding, -1)
    base = total.select(*keys, "_slice", *[F.coalesce(F.sum(f"_all_{n}").over(before), F.lit(0)).alias(f"_base_{n}") for n in sums])
    return out.join(base, [*keys, "_slice"]).select(
        *keys, value, *sums, *[(F.col(f"_base_{n}") + F.col(f"_in_{n}")).alias(f"cum_{n}") for n in sums]
    )


def average_ranks(df, keys, value):
    """Ascending average rank of each distinct value within its keys."""
    t = running_totals(df, keys, value, {"ties": F.lit(1)})
    return t.withColumn("avg_rank", F.col("cum_ties") - (F.col("ties") - 1) / 2)


def finite_descending(df, keys, value, tie):
    """Finite rows with their place in descending order; ties in order of ``tie``, which is unique per key."""
    finite = df.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf")))
    above = running_totals(finite, keys, value, {"here": F.lit(1)}, descending=True)
    among = running_totals(finite, [*keys, value], tie, {"_one": F.lit(1)})
    first = above.select(*keys, value, (F.col("cum_here") - F.col("here")).alias("_above"))
    return among.join(first, [*keys, value]).select(*keys, value, tie, (F.col("_above") + F.col("cum__one")).alias("place"))


def percentiles(df, col, points=range(1, 100)):
    """Exact linearly interpolated percentiles (percentile, value), one row each; null where there are no values.

    Each distinct value knows which ranks it takes, and the wanted ranks pick their values out; no task sees all values.
    """
    t = running_totals(df, [], col, {"_n": F.lit(1)})
    last = df.filter(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))).agg(F.count("*") - 1).scalar()
    spark = df.sparkSession
    wanted = spark.createDataFrame([(int(p),) for p in points], "percentile int").withColumn("_at", F.col("percentile") / 100 * last)
    ranks = wanted.select("percentile", F.col("_at") - F.floor("_at"), F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("rank"))
    ranks = ranks.toDF("percentile", "_share", "rank").withColumn("_upper", F.row_number().over(Window.partitionBy("percentile").orderBy("rank")) == 2)
    needed = ranks.agg(F.sort_array(F.collect_set("rank"))).scalar()  # two per point at most
    first = F.col("cum__n") - F.col("_n")
    mine = t.withColumn("_need", needed).select(F.col(col).cast("double").alias("_v"), F.explode(F.filter("_need", lambda r: (r >= first) & (r < F.col("cum__n")))).alias("rank"))
    both = ranks.join(mine, "rank", "left").groupBy("percentile").agg(
        F.max("_share").alias("_share"), F.max(F.when(~F.col("_upper"), F.col("_v"))).alias("low"), F.max(F.when(F.col("_upper"), F.col("_v"))).alias("high"))
    return both.select("percentile", (F.col("low") + F.when(F.col("high").isNull(), 0.0).otherwise(F.col("_share") * (F.col("high") - F.col("low")))).alias("value"))
