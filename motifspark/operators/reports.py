"""Aggregates behind the reports."""

from pyspark.sql import functions as F

from motifspark.functions.pvalues import t_pvalue


def class_signals(df, kind="call_type", value="signal"):
    return df.groupBy(kind).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


CALL_TYPES = ("FN", "FP", "TN", "TP")


def pairwise_tests(df, kind="call_type", value="signal", kinds=CALL_TYPES):
    """Pooled-variance t of every two classes, from one pass over the rows."""
    def of(k):
        x = F.when(F.col(kind) == k, F.col(value))
        return F.struct(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_samp(x).alias("v")).alias(k)

    one = df.agg(*[of(k) for k in kinds])
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y"))
             for i, a in enumerate(kinds) for b in kinds[i + 1:]]
    x = one.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").filter("x.n > 0 and y.n > 0")
    freedom = F.col("x.n") + F.col("y.n") - 2
    pooled = ((F.col("x.n") - 1) * F.col("x.v") + (F.col("y.n") - 1) * F.col("y.v")) / freedom
    t = F.try_divide(F.col("x.m") - F.col("y.m"), F.sqrt(pooled * (1 / F.col("x.n") + 1 / F.col("y.n"))))
    return x.select("a", "b", t.alias("t"), freedom.cast("double").alias("df")).withColumn("p", t_pvalue("t", "df"))


def homolog_deltas(df):
    """Homolog minus host for total and binding, by who is called a motif; rows with a homolog only."""
    host, homolog = F.col("host_call"), F.col("homolog_call")
    kind = F.when(host & homolog, "both").when(host, "host_only").when(homolog, "homolog_only").otherwise("neither")
    has = F.col("homolog_id").isNotNull() & (F.col("homolog_id") != "")
    return df.filter(has).groupBy(kind.alias("kind")).agg(
        F.count("*").alias("n"), F.avg(F.col("homolog_total") - F.col("host_total")).alias("delta_total"),
        F.avg(F.col("homolog_binding") - F.col("host_binding")).alias("delta_binding"),
    )
