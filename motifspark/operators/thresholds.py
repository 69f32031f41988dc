"""Threshold statistics: sweeps over every score, rates at fixed thresholds, confusion reports."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from motifspark.operators.running import running_totals

ALL = "_all"
#: Weight combinations of a block of the grid.
GRID = 1 << 14


def sweep(df, score, truth, keys=()):
    """One row per distinct score t with tp, fp, fn, tn of "score >= t". Rows without a score are never positive.

    Scores are compared at nine digits, so that equal sums in another order are equal scores.
    """
    keys = list(keys) or [ALL]
    rows = df if ALL not in keys else df.withColumn(ALL, F.lit(0))
    rows = rows.select(*keys, F.round(score, 9).alias("score"), F.col(truth).cast("int").alias("_p")).withColumn("_n", 1 - F.col("_p"))
    run = running_totals(rows, keys, "score", {"_pos": F.col("_p"), "_neg": F.col("_n")}, descending=True)
    total = rows.groupBy(*keys).agg(F.sum("_p").alias("_P"), F.sum("_n").alias("_N"), F.count("score").alias("_S"))
    at = run.join(total, keys).select(
        *keys, "score", F.col("cum__pos").alias("tp"), F.col("cum__neg").alias("fp"),
        (F.col("_P") - F.col("cum__pos")).alias("fn"), (F.col("_N") - F.col("cum__neg")).alias("tn"),
        (F.col("_pos") + F.col("_neg")).alias("here"), (F.col("cum__pos") + F.col("cum__neg") == F.col("_S")).alias("lowest"),
    )
    return at


def accuracy():
    return (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))


def precision():
    return F.try_divide("tp", F.col("tp") + F.col("fp"))


def recall():
    return F.try_divide("tp", F.col("tp") + F.col("fn"))


def f1():
    return F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))


def mcc():
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    spread = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return F.coalesce(F.try_divide(tp * tn - fp * fn, spread), F.lit(0.0))


METRICS = {"accuracy": accuracy, "precision": precision, "recall": recall, "f1": f1, "mcc": mcc}


def best_cut(df, score, truth, metric="accuracy", keys=(), midpoint=True):
    """The threshold with the highest metric, lowest threshold first.

    With ``midpoint`` the thresholds lie half-way between neighbouring sorted scores, as in accuracy and MCC
    searches; the lowest score itself is then a threshold only if several rows share it.
    """
    own = list(keys) or [ALL]
    s = sweep(df, score, truth, keys)
    if midpoint:
        s = s.filter(~F.col("lowest") | (F.col("here") > 1))
    value = METRICS[metric]()
    best = s.withColumn("value", value).groupBy(*own).agg(
        F.max_by(F.struct("score", "value", "tp", "fp", "fn", "tn", "here"), F.struct(F.round("value", 12), -F.col("score"))).alias("b")
    ).select(*own, "b.*")
    if midpoint:
        rows = df if keys else df.withColumn(ALL, F.lit(0))
        rows = rows.select(*own, F.round(score, 9).alias("_s"))
        cut = best.select(*own, F.col("score").alias("_cut"))
        below = rows.join(cut, own).filter(F.col("_s") < F.col("_cut")).groupBy(*own).agg(F.max("_s").alias("_below"))
        best = best.join(below, own, "left").withColumn(
            "threshold", F.coalesce((F.col("score") + F.col("_below")) / 2, F.col("score"))
        ).drop("_below")
    else:
        best = best.withColumn("threshold", F.col("score"))
    return best.drop("score", "here", *([] if keys else [ALL]))


def confusion(df, call, truth):
    """Counts and the derived rates of one set of calls."""
    c, t = F.coalesce(F.col(call), F.lit(False)), F.col(truth)
    n = df.agg(F.count_if(c & t).alias("tp"), F.count_if(c & ~t).alias("fp"), F.count_if(~c & t).alias("fn"),
               F.count_if(~c & ~t).alias("tn"))
    npv = F.try_divide("tn", F.col("tn") + F.col("fn"))
    return n.select("*", precision().alias("precision"), recall().alias("recall"), npv.alias("npv"), f1().alias("f1"),
                    F.try_divide(2 * precision() * npv, precision() + npv).alias("f1_ppv_npv"), mcc().alias("mcc"),
                    accuracy().alias("accuracy"))


def score_range(df, score, n=100):
    """n equally spaced thresholds from the lowest to the highest score."""
    ends = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    at = ends.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    return at.select("i", _threshold(F.col("lo"), F.col("hi"), F.col("i"), n).alias("threshold"))


def _threshold(lo, hi, i, n):
    return F.when(i == n - 1, hi).otherwise(lo + i * ((hi - lo) / (n - 1)))


def rates(df, score, truth, n=100):
    """PPV, NPV, FDR, FOR, sensitivity and specificity of "score >= threshold" at n spaced thresholds.

    Each row is counted once, in the slot of the highest threshold it reaches; the few slots are then summed up.
    """
    ends = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    x = df.select(F.col(score).alias("_s"), F.col(truth).alias("_t")).withColumn("_e", ends.select(F.struct("lo", "hi")).scalar())
    lo, hi = F.col("_e.lo"), F.col("_e.hi")
    step = (hi - lo) / (n - 1)
    guess = F.least(F.floor(F.try_divide(F.col("_s") - lo, step)), F.lit(n - 1)).cast("int")
    up = (guess < n - 1) & (_threshold(lo, hi, guess + 1, n) <= F.col("_s"))
    down = _threshold(lo, hi, guess, n) > F.col("_s")
    slot = F.when(up, guess + 1).when(down, guess - 1).otherwise(guess)
    counted = x.groupBy(slot.alias("i")).agg(F.count_if("_t").alias("p"), F.count_if(~F.col("_t")).alias("q"))
    every = score_range(df, score, n).join(F.broadcast(counted), "i", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in "pq"})
    w = Window.orderBy(F.col("i").desc())
    whole = Window.partitionBy()
    run = every.select("i", "threshold", F.sum("p").over(w).alias("tp"), F.sum("q").over(w).alias("fp"),
                       F.sum("p").over(whole).alias("P"), F.sum("q").over(whole).alias("Q"))
    tn, fn = F.col("Q") - F.col("fp"), F.col("P") - F.col("tp")
    ppv, npv = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide(tn, tn + fn)
    return run.select("i", "threshold", ppv.alias("ppv"), npv.alias("npv"), (1 - ppv).alias("fdr"), (1 - npv).alias("for_rate"),
                      F.try_divide("tp", F.col("P")).alias("sensitivity"), F.try_divide(tn, F.col("Q")).alias("specificity"))


def balanced_threshold(rate_rows):
    """The threshold where FDR and FOR are closest; first on ties."""
    gap = F.abs(F.col("fdr") - F.col("for_rate"))
    order = F.struct(gap.isNull(), F.round(gap, 12), F.col("i"))
    return rate_rows.agg(F.min_by(F.struct("i", "threshold", "fdr", "for_rate"), order).alias("b")).select("b.*")


def apply_threshold(df, score, truth, threshold):
    call = F.coalesce(F.col(score) >= threshold, F.lit(False))
    t = F.col(truth)
    kind = F.when(call & t, "TP").when(call, "FP").when(t, "FN").otherwise("TN")
    return df.withColumn("call", F.when(call, "Positive").otherwise("-")).withColumn("call_type", kind)


def rate_pair(rate_rows, divergence=0.2, or_none=True):
    """Least mean of FDR and FOR among pairs that differ by at most ``divergence``; else none, or the least mean."""
    mean = (F.col("fdr") + F.col("for_rate")) / 2
    close = F.coalesce(F.abs(F.col("fdr") - F.col("for_rate")) <= divergence, F.lit(False))
    pool = rate_rows.filter(mean.isNotNull()).select("i", "threshold", "fdr", "for_rate", mean.alias("mean"), close.alias("close"))
    if or_none:
        pool = pool.filter("close")
    order = F.struct(~F.col("close"), F.round("mean", 12), F.col("i"))
    best = pool.agg(F.min_by(F.struct("i", "threshold", "fdr", "for_rate", "mean"), order).alias("b")).filter("b is not null")
    return best.select("b.*")


def gray_digits(numbers, radices):
    """Digits of numbers in reflected Gray order, first place slowest: from one number to the next one digit moves by one."""
    numbers = np.asarray(numbers, np.int64)
    digits = np.empty((len(numbers), len(radices)), np.int64)
    for k, radix in enumerate(radices):
        size = math.prod(radices[k + 1 :])
        digit, before = numbers // size % radix, numbers // (size * radix)
        digits[:, k] = np.where(before % 2, radix - 1 - digit, digit)
    return digits


def grid_hits(rows, choices, values, cut, truth="truth", times="n", block=None):
    """(w1, w2, ..., hits) of every weight combination: rows whose weighted sum of `values` reaches `cut` as their truth says.

    Equal rows are combined, with their count in `times`, and packed into blocks; every block meets every block of the
    grid as a row. A block of the grid is walked in Gray order, where one weight changes from one combination to the next:
    the sums are changed by that weight's step, not computed anew. Counts leave a task once per combination and block of rows;
    a block of the grid has `block` combinations at most.
    """
    from motifspark.operators.search import STRIP, packed, unpacked

    radices, n = [len(c) for c in choices], len(choices)
    total = math.prod(radices)
    names = [f"w{i}" for i in range(1, n + 1)]
    n_pos, n_neg = F.when(F.col(truth), F.col(times)).otherwise(0).alias("pos"), F.when(~F.col(truth), F.col(times)).otherwise(0).alias("neg")
    blocks, n_blocks, _ = packed(rows.select(F.array(*[F.col(v).cast("double") for v in values]).alias("points"), n_pos, n_neg), ["pos", "neg"], n)
    spark = rows.sparkSession
    step = max(1, min(block or GRID, -(-total * n_blocks // (2 * spark.sparkContext.defaultParallelism))))
    met = blocks.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(total - 1), F.lit(step)))).repartition(2 * spark.sparkContext.defaultParallelism)

    def sweep(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                points, (pos, neg) = unpacked(batch.column(0).slice(k, 1), n, 2)
                first = batch.column(1)[k].as_py()
                digits = gray_digits(np.arange(first, min(first + step, total)), radices)
                weights = np.stack([np.asarray(c, float)[digits[:, i]] for i, c in enumerate(choices)], axis=1)
                change = np.diff(weights, axis=0)
                moved = np.argmax(np.diff(digits, axis=0) != 0, axis=1) if len(digits) > 1 else np.empty(0, np.int64)
                by = change[np.arange(len(moved)), moved]
                hits = np.full(len(weights), neg.sum())
                for at in range(0, len(points), STRIP):
                    column = np.ascontiguousarray(points[at : at + STRIP].T)
                    gain = (pos - neg)[at : at + STRIP]
                    # nine digits decide, so that sums in another order are equal sums
                    score = weights[0] @ column - (cut - 5e-10)
                    hits[0] += gain[score >= 0].sum()
                    for c, (place, d) in enumerate(zip(moved.tolist(), by.tolist()), start=1):
                        score += d * column[place]
                        hits[c] += gain @ (score >= 0)
                yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(x)) for x in weights.T], pa.array(np.rint(hits).astype(np.int64))], names=[*names, "hits"])

    found = met.select("rows", "first").mapInArrow(sweep, ", ".join(f"{x} double" for x in names) + ", hits long")
    return found.groupBy(*names).agg(F.sum("hits").alias("hits"))


def weight_grid(spark, choices):
    """Every combination of one value per position; a lazily generated grid."""
    out = spark.range(1).drop("id")
    for i, values in enumerate(choices, start=1):
        out = out.select("*", F.explode(F.array(*[F.lit(float(v)) for v in values])).alias(f"w{i}"))
    return out
