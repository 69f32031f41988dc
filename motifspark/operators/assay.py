"""Peptide-array signals: calls, controls, standardization, bait comparisons. Long form: one row per cell."""

from pyspark.sql import functions as F


def drop_coordinates(spots, last=None, dropped=(), col="coord"):
    """Keep spots up to ``last`` in (letter, number) order and not listed."""
    out = spots
    if last is not None:
        letter, number = last[:1], int(last[1:])
        own = F.substring(col, 1, 1)
        digits = F.substring(F.col(col), F.lit(2), F.length(col)).cast("int")
        out = out.filter((own < letter) | ((own == letter) & (digits <= number)))
    return out.filter(~F.col(col).isin(*dropped)) if dropped else out


def widen_spots(cells, baits, copies, values=("raw", "bas", "call_index"), key="peptide_id"):
    """One column per value, bait and copy, ordered by bait, then copy."""
    cols = [
        F.first(F.when((F.col("bait") == b) & (F.col("copy") == c), F.col(v)), ignorenulls=True).alias(f"{b}_Copy-{c}_{v}")
        for b in baits for c in copies for v in values
    ]
    return cells.groupBy(key).agg(*cols)


def order_columns(wide, baits, lead=("peptide_id",)):
    """Lead columns, then signal columns by bait in the given order, then copy."""
    found = [(baits.index(c.split("_")[0]), c) for c in wide.columns if c.split("_")[0] in baits and c not in lead]
    return wide.select(*lead, *[c for _, c in sorted(found)])


def narrow_spots(wide, key="peptide_id", value="bas"):
    """Long cells from wide columns; the bait is the text before the first underscore."""
    cols = [c for c in wide.columns if c.endswith(f"_{value}")]
    long = wide.unpivot([key], cols, "_column", value)
    copy = F.regexp_extract("_column", r"Copy-([^_]+)", 1)
    return long.select(key, F.split("_column", "_")[0].alias("bait"), copy.alias("copy"), value)


def attach_names(cells, names, key="peptide_id"):
    return cells.join(names, key, "left")


def positive_calls(cells, controls, multiple=0.05, index_threshold=1.4, enforce_control=True):
    """Pass if every replicate reaches the call index and a multiple of the positive control of its bait."""
    ok = F.coalesce(F.col("call_index") >= index_threshold, F.lit(False))
    if enforce_control:
        mean = cells.filter(F.col("peptide_id").isin(*controls)).groupBy("dataset", "bait").agg(F.avg("bas").alias("_control"))
        cells = cells.join(mean, ["dataset", "bait"], "left")
        ok = ok & F.coalesce(F.col("bas") >= multiple * F.col("_control"), F.lit(False))
    return cells.groupBy("dataset", "peptide_id", "bait").agg(F.when(F.bool_and(ok), "Pass").otherwise("").alias("call"))


def bait_means(cells):
    return cells.groupBy("dataset", "peptide_id", "bait").agg(F.avg("bas").alias("mean"))


def _wide_means(cells, baits, extra=()):
    """Mean per bait as columns; one shuffle on the peptide, no self-join."""
    return cells.groupBy("dataset", "peptide_id").agg(
        *[F.avg(F.when(F.col("bait") == b, F.col("bas"))).alias(f"mean_{b}") for b in baits], *extra
    )


def exceeds_control(cells, baits, control, multiplier=5):
    m = _wide_means(cells, [*baits])
    rows = F.explode(F.array(*[
        F.struct(F.lit(b).alias("bait"),
                 F.when(F.col(f"mean_{b}") > multiplier * F.col(f"mean_{control}"), "Yes").otherwise("").alias("exceeds"))
        for b in baits if b != control
    ])).alias("r")
    return m.select("dataset", "peptide_id", rows).select("dataset", "peptide_id", "r.*")


def concat_datasets(*frames):
    """Row-wise union; ids are prefixed with the dataset number."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("row_id", F.concat(F.lit(f"{i}-"), F.col("peptide_id").cast("string")))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def standardize_within(cells, controls, control_bait):
    """Divide each bait and copy by the ratio of its control mean to the grand control mean of the dataset."""
    used = cells.filter((F.col("bait") != control_bait) & F.col("peptide_id").isin(*controls))
    own = used.groupBy("dataset", "bait", "copy").agg(F.avg("bas").alias("_own"))
    grand = used.groupBy("dataset").agg(F.avg("bas").alias("_grand"))
    scaled = cells.join(own, ["dataset", "bait", "copy"], "left").join(grand, "dataset", "left")
    ratio = F.col("_own") / F.col("_grand")
    value = F.when(F.col("bait") == control_bait, F.col("bas")).otherwise(F.try_divide("bas", ratio))
    return scaled.withColumn("bas", value).drop("_own", "_grand")


def standardize_between(cells, controls, control_bait):
    """Scale datasets to a common control mean; negative control signals count as zero."""
    mean = cells.filter((F.col("bait") != control_bait) & F.col("peptide_id").isin(*controls)).groupBy("dataset").agg(
        F.avg(F.greatest("bas", F.lit(0.0))).alias("_mean")
    )
    overall = mean.agg(F.avg("_mean")).scalar()
    factor = mean.select("dataset", F.try_divide(overall, F.col("_mean")).alias("multiplier"))
    return cells.join(factor, "dataset", "left").withColumn("standardized", F.col("bas") * F.col("multiplier"))


def log2fc(a, b, increment=0.01):
    zero = F.lit(0.0)
    return F.log2(F.greatest(a, zero) + increment) - F.log2(F.greatest(b, zero) + increment)


def conditional_log2fc(cells, calls, baits, control, multiplier=5):
    """log2 fold change of every ordered bait pair, where either bait passes and exceeds the control."""
    m = _wide_means(cells, baits)
    passed = calls.groupBy("dataset", "peptide_id").agg(
        *[F.max((F.col("bait") == b) & (F.col("call") == "Pass")).alias(f"pass_{b}") for b in baits]
    )
    row = m.join(passed, ["dataset", "peptide_id"], "left")
    limit = multiplier * F.col(f"mean_{control}")
    pairs = []
    tested = [b for b in baits if b != control]
    for a in tested:
        for b in tested:
            if a == b:
                continue
            x, y = F.col(f"mean_{a}"), F.col(f"mean_{b}")
            called = F.coalesce(F.col(f"pass_{a}"), F.lit(False)) | F.coalesce(F.col(f"pass_{b}"), F.lit(False))
            above = F.coalesce(x > limit, F.lit(False)) | F.coalesce(y > limit, F.lit(False))
            value = F.when(called & above & x.isNotNull() & y.isNotNull(), log2fc(x, y))
            pairs.append(F.struct(F.lit(f"{a}_{b}").alias("pair"), value.alias("log2fc")))
    return row.select("dataset", "peptide_id", F.explode(F.array(*pairs)).alias("p")).select("dataset", "peptide_id", "p.*")


def passes(cells, calls, baits, control, multiplier=5):
    """``one_passes`` over all baits (signal and call may come from different baits) and one flag per bait."""
    m = _wide_means(cells, baits)
    tested = [b for b in baits if b != control]
    called = calls.groupBy("dataset", "peptide_id").agg(
        *[F.max((F.col("bait") == b) & (F.col("call") == "Pass")).alias(f"pass_{b}") for b in tested]
    )
    row = m.join(called, ["dataset", "peptide_id"], "left")
    above = {b: F.coalesce(F.col(f"mean_{b}") > multiplier * F.col(f"mean_{control}"), F.lit(False)) for b in tested}
    called = {b: F.coalesce(F.col(f"pass_{b}"), F.lit(False)) for b in tested}

    def any_of(conds):
        out = F.lit(False)
        for c in conds:
            out = out | c
        return out

    def flag(c):
        return F.when(c, "Yes").otherwise("")

    both = flag(any_of(above.values()) & any_of(called.values())).alias("one_passes")
    return row.select("dataset", "peptide_id", both, *[flag(above[b] & called[b]).alias(f"{b}_passes") for b in tested])


def max_bait_signal(cells, baits, control, multiplier=1, subtract_control=False):
    m = _wide_means(cells, baits)

    def value(b):
        x = F.col(f"mean_{b}")
        if not subtract_control:
            return x
        return F.when(x.isNotNull(), F.greatest(x - multiplier * F.coalesce(F.col(f"mean_{control}"), F.lit(0.0)), F.lit(0.0)))

    tested = [value(b) for b in baits if b != control]
    top = F.greatest(*tested) if len(tested) > 1 else tested[0]
    return m.select("dataset", "peptide_id", top.alias("max_signal"))


def least_different(pairs, keys=("dataset", "peptide_id"), chosen=None, signed=False):
    """The pair whose log2 fold change is nearest zero (or lowest, with ``signed``); nulls never win."""
    rows = pairs.filter(F.col("pair").isin(*chosen)) if chosen else pairs
    size = F.col("log2fc") if signed else F.abs("log2fc")
    order = F.struct(F.col("log2fc").isNull().alias("n"), F.coalesce(F.round(size, 9), F.lit(0.0)).alias("v"), F.col("pair").alias("p"))
    best = rows.groupBy(*keys).agg(F.min_by(F.struct("log2fc", "pair"), order).alias("b"))
    return best.select(*keys, F.col("b.log2fc").alias("log2fc"), F.when(F.col("b.log2fc").isNotNull(), F.col("b.pair")).alias("pair"))


def row_mean(*cols):
    """Mean of several columns of one row; null if any is null."""
    return sum((F.col(c) for c in cols[1:]), F.col(cols[0])) / len(cols)
