"""Random search for position weights: exact, and spread over rows and trials alike.

A trial is one random weight vector; what it is worth depends on the best threshold over all rows. Rows are packed into
blocks, trials into groups, and each block meets each group in a row of its own, so a task holds one block, a few
hundred weight vectors and their cells, whatever the numbers. A round bins the scores of every open trial and sums
(trial, bin) cells. Cuts at bin edges bound each trial from both sides; trials whose upper bound is under the best lower
bound are out, and the next round bins the rest finer. Of the last ones only the rows in bins that may hold a better cut
than the edges do are scored again, value by value. Open trials are a table from the first round to the last.
"""

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from motifspark.operators import thresholds as H
from motifspark.session import materialize

#: Rows of a block, trials of a group, and trials and rows that are scored together.
ROWS, GROUP, CHUNK, STRIP = 65_536, 65_536, 256, 4096
#: Cells of trials, bins and measures that are counted together.
HELD = 1 << 21
ROUNDS = (32, 1024, 16_384)
EPS = 1e-12


# ---- trials --------------------------------------------------------------------------------------------------


def _scrambled(x):
    """Thirty-two bits to thirty-two bits, each depending on all; in unsigned 64-bit integers."""
    low = np.uint64(0xFFFFFFFF)
    x = ((x ^ (x >> np.uint64(16))) * np.uint64(0x85EBCA6B)) & low
    x = ((x ^ (x >> np.uint64(13))) * np.uint64(0xC2B2AE35)) & low
    return x ^ (x >> np.uint64(16))


GOLDEN = 0x9E3779B9


def trial_weights(trials, n, low, high, seed, forced=None):
    """Weights of the given trial numbers, one row each; a function of (seed, trial, position) alone."""
    t = np.asarray(list(trials), np.uint64)
    first = _scrambled((t ^ np.uint64(seed * GOLDEN & 0xFFFFFFFF)) & np.uint64(0xFFFFFFFF))
    place = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(GOLDEN)) & np.uint64(0xFFFFFFFF)
    unit = _scrambled((first[:, None] + place[None, :]) & np.uint64(0xFFFFFFFF)).astype(float) / 2.0**32
    out = low + (high - low) * unit
    for p, value in (forced or {}).items():
        out[:, p - 1] = value
    return out


def _scores(points, weights):
    return np.round(points @ weights.T, 9)


def _ends(points, weights):
    """Lowest and highest possible score per trial from the per-position ranges."""
    lo, hi = points
    a, b = weights * lo, weights * hi
    return np.minimum(a, b).sum(axis=1), np.maximum(a, b).sum(axis=1)


def variation(weights):
    """Coefficient of variation of each row; nan where the mean is 0."""
    mean = weights.mean(axis=1)
    return weights.std(axis=1) / np.where(mean == 0, np.nan, mean)


# ---- rows and groups -----------------------------------------------------------------------------------------


@dataclass
class Side:
    """One sweep over the scores: which rows count, which of them are positive, and from which end cuts are made.

    ``share`` is its part of a trial's value. A cut of the upper side is "score >= t", of the lower side "score <= t".
    """

    name: str
    positive: str
    count: str
    sign: int = 1
    share: float = 1.0
    totals: tuple = field(default=(0, 0, 0))  # positive, negative, scored rows


def packed(rows, measures, n):
    """Rows with equal points as one, in blocks of about `ROWS`; (block, rows)."""
    combined = rows.filter("points is not null").groupBy("points").agg(*[F.sum(m).alias(m) for m in measures])
    combined = materialize(combined, "search-points")
    count = combined.count()
    blocks = max(1, -(-count // ROWS))
    point = F.struct("points", *[F.col(m).cast("double").alias(m) for m in measures])
    keyed = combined.select(F.pmod(F.xxhash64("points"), F.lit(blocks)).cast("int").alias("block"), point.alias("row"))
    return materialize(keyed.groupBy("block").agg(F.collect_list("row").alias("rows")), "search-blocks"), blocks, combined


def unpacked(column, n, measures):
    """Points as a matrix and measures as a list of arrays, from one packed block."""
    parts = column.flatten().flatten()
    return parts[0].flatten().to_numpy(zero_copy_only=False).reshape(-1, n), [p.to_numpy(zero_copy_only=False) for p in parts[1 : 1 + measures]]


class Blocks:
    """Rows with ``points`` (array per position) and summed measures, packed for passes with many weight vectors."""

    def __init__(self, rows, measures, n, low, high, seed, forced):
        self.n, self.space, self.measures, self.spark = n, (n, low, high, seed, forced), measures, rows.sparkSession
        self.blocks, self.n_blocks, combined = packed(rows, measures, n)
        p = F.col("points")
        ends = combined.agg(F.array(*[F.min(p[i]) for i in range(n)]).alias("lo"), F.array(*[F.max(p[i]) for i in range(n)]).alias("hi")).first()
        self.ends = tuple(np.array([v or 0.0 for v in ends[e]], float) for e in ("lo", "hi"))

    def every(self, count):
        return self.spark.range(count).withColumnRenamed("id", "trial")

    def _met(self, trials, extra=()):
        """Every block of rows with every group of open trials; ``trials`` has trial and the ``extra`` columns."""
        count = trials.count()
        wide = max(1, -(-2 * self.spark.sparkContext.defaultParallelism // self.n_blocks))
        groups = max(1, -(-count // GROUP), min(wide, -(-count // CHUNK)))
        item = F.struct("trial", *extra)
        grouped = trials.select(F.pmod(F.xxhash64("trial"), F.lit(groups)).cast("int").alias("group"), item.alias("t")).groupBy("group").agg(
            F.sort_array(F.collect_list("t")).alias("trials"))
        spread = self.blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(self.n_blocks * groups)
        return spread.join(grouped, "group").select("rows", "trials")

    def _tallied(self, trials, bins):
        """(trial, bin, measures): how much of each measure the trial's scores have in each bin."""
        n, space, ends, names = self.n, self.space, self.ends, self.measures
        together = max(1, min(CHUNK, HELD // (bins * len(names))))

        def count(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    points, measures = unpacked(batch.column(0).slice(k, 1), n, len(names))
                    every = batch.column(1).slice(k, 1).flatten().flatten()[0].to_numpy(zero_copy_only=False)
                    for at in range(0, len(every), together):
                        trial = every[at : at + together]
                        weights = trial_weights(trial, *space)
                        lo, step = _scale(ends, weights, bins)
                        held = np.zeros((len(names), len(trial) * bins))
                        base = np.arange(len(trial)) * bins
                        for row in range(0, len(points), STRIP):
                            slot = (_bins(_scores(points[row : row + STRIP], weights), lo, step, bins) + base).ravel()
                            for m, values in enumerate(measures):
                                held[m] += np.bincount(slot, np.repeat(values[row : row + STRIP], len(trial)), held.shape[1])
                        cell = np.flatnonzero(held.any(axis=0))
                        yield pa.RecordBatch.from_arrays([pa.array(trial[cell // bins]), pa.array((cell % bins).astype(np.int32)), *map(pa.array, held[:, cell])],
                                                         names=["trial", "bin", *names])

        schema = "trial long, bin int, " + ", ".join(f"`{m}` double" for m in names)
        return self._met(trials).mapInArrow(count, schema).groupBy("trial", "bin").agg(*[F.sum(m).alias(m) for m in names])

    def _described(self, trials):
        """``trials`` with their weights and coefficients of variation."""
        space, names = self.space, trials.columns

        def describe(batches):
            for batch in batches:
                weights = trial_weights(batch.column(names.index("trial")).to_numpy(zero_copy_only=False), *space)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(variation(weights)), pa.array(weights.tolist(), pa.list_(pa.float64()))], names=[*names, "cv", "weights"])

        own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in trials.schema)
        return trials.mapInArrow(describe, f"{own}, cv double, weights array<double>")


class Search(Blocks):
    """``rows`` has ``points`` (array per position, null for rows that no cut ever calls) and the columns of the sides.

    By default one upper side counts the boolean column ``truth``.
    """

    def __init__(self, rows, n, low=0.0, high=10.0, seed=1, forced=None, metric="accuracy", sides=None):
        self.metric, self.midpoint = metric, metric != "f1"
        if sides is None:
            rows = rows.select("points", F.col("truth").cast("int").alias("positive"), F.lit(1).alias("rows"))
            sides = [Side("upper", "positive", "rows")]
        super().__init__(rows, sorted({m for s in sides for m in (s.positive, s.count)}), n, low, high, seed, forced)
        self.sides = sides
        scored = F.col("points").isNotNull()
        sums = [F.sum(m).alias(f"all_{m}") for m in self.measures] + [F.sum(F.when(scored, F.col(m))).alias(f"scored_{m}") for m in self.measures]
        total = rows.agg(*sums).first()
        for s in sides:
            positive = total[f"all_{s.positive}"] or 0
            s.totals = (positive, (total[f"all_{s.count}"] or 0) - positive, total[f"scored_{s.count}"] or 0)

    def _cells(self, trials, bins):
        """Per (trial, side, bin), bins from the end that a side's cuts start at: counts in the bin, and before and in it."""
        tallied = self._tallied(trials, bins)
        each = F.explode(F.array(*[
            F.struct(F.lit(i).alias("side"), (s.sign * F.col("bin")).alias("at"), F.col(s.positive).alias("pos"), (F.col(s.count) - F.col(s.positive)).alias("neg"))
            for i, s in enumerate(self.sides)]))
        cells = tallied.select("trial", "bin", each.alias("c")).select("trial", "bin", "c.*").filter("pos + neg > 0")
        down = Window.partitionBy("trial", "side").orderBy(F.col("at").desc())
        return cells.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down)})

    def _counted(self, df, tp, fp):
        """tp, fp, fn and tn of cuts, in whole numbers."""
        of = F.array(*[F.array(*[F.lit(float(v)) for v in s.totals]) for s in self.sides])[F.col("side")]
        return df.withColumns({"tp": tp, "fp": fp}).withColumns({"fn": of[0] - F.col("tp"), "tn": of[1] - F.col("fp"), "_scored": of[2]})

    def _edges(self, trials, bins):
        """Per (trial, side, bin): the metric at the bin's edge, if that is a cut, and the best that a cut within could reach."""
        metric = H.METRICS[self.metric]()
        cut = self._counted(self._cells(trials, bins), F.col("tp"), F.col("fp"))
        allowed = (F.col("tp") + F.col("fp") < F.col("_scored")) | F.lit(not self.midpoint)
        cut = cut.withColumns({"low": F.when(allowed, metric), "above_tp": F.col("tp") - F.col("pos"), "above_fp": F.col("fp") - F.col("neg")})
        return self._counted(cut, F.col("tp"), F.col("above_fp")).withColumn("high", metric)

    def bounds(self, trials, bins):
        """(trial, one low and high per side): bounds of each side's best metric; no cut at all counts as null."""
        per = self._edges(trials, bins).groupBy("trial", "side").agg(F.max("low").alias("low"), F.max("high").alias("high"))
        picked = [F.max(F.when(F.col("side") == i, F.col(c))).alias(f"{c}_{i}") for i in range(len(self.sides)) for c in ("low", "high")]
        return per.groupBy("trial").agg(*picked)

    def _value(self, prefix):
        return sum((s.share * F.col(f"{prefix}_{i}") for i, s in enumerate(self.sides)), F.lit(0.0))

    def survivors(self, trials, bins):
        """Trials that can still be best."""
        found = materialize(self.bounds(trials, bins).select("trial", self._value("low").alias("low"), self._value("high").alias("high")), "trial-bounds")
        floor = found.agg(F.max("low")).first()[0]
        return found.select("trial") if floor is None else found.filter(F.col("high") >= F.lit(floor) - EPS).select("trial")

    def exact(self, trials, bins):
        """(trial, value_i per side): the exact best metric of every trial on every side.

        A side's value is its best edge, unless a bin that could hold more does; only rows in such bins are scored again.
        """
        n, space, ends, names = self.n, self.space, self.ends, self.measures
        edges = materialize(self._edges(trials, bins), "trial-edges")
        best = edges.groupBy("trial", "side").agg(F.max("low").alias("best"))
        inside = edges.join(best, ["trial", "side"]).filter(F.col("best").isNull() | (F.col("high") > F.col("best") + EPS))
        inside = inside.select("trial", "side", "bin", "above_tp", "above_fp")
        wanted = inside.groupBy("trial").agg(F.collect_set("bin").alias("bins"))

        def pick(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    points, measures = unpacked(batch.column(0).slice(k, 1), n, len(names))
                    every, lists = batch.column(1).slice(k, 1).flatten().flatten()
                    every, sizes, flat = every.to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
                    begin = np.concatenate([[0], np.cumsum(sizes)])
                    for at in range(0, len(every), CHUNK):
                        trial = every[at : at + CHUNK]
                        weights = trial_weights(trial, *space)
                        lo, step = _scale(ends, weights, bins)
                        mask = np.zeros(len(trial) * bins, bool)
                        here = begin[at : at + len(trial) + 1]
                        mask[np.repeat(np.arange(len(trial)), np.diff(here)) * bins + flat[here[0] : here[-1]]] = True
                        base = np.arange(len(trial)) * bins
                        for row in range(0, len(points), STRIP):
                            s = _scores(points[row : row + STRIP], weights)
                            slot = _bins(s, lo, step, bins) + base
                            r, t = np.nonzero(mask[slot])
                            if len(r):
                                yield pa.RecordBatch.from_arrays(
                                    [pa.array(trial[t]), pa.array((slot[r, t] - base[t]).astype(np.int32)), pa.array(s[r, t]), *[pa.array(m[row + r]) for m in measures]],
                                    names=["trial", "bin", "score", *names])

        schema = "trial long, bin int, score double, " + ", ".join(f"`{m}` double" for m in names)
        scored = self._met(wanted, ("bins",)).mapInArrow(pick, schema).groupBy("trial", "bin", "score").agg(*[F.sum(m).alias(m) for m in names])
        each = F.explode(F.array(*[
            F.struct(F.lit(i).alias("side"), (s.sign * F.col("score")).alias("s"), F.col(s.positive).alias("pos"), (F.col(s.count) - F.col(s.positive)).alias("neg"))
            for i, s in enumerate(self.sides)]))
        rows = scored.select("trial", "bin", each.alias("c")).select("trial", "bin", "c.*").filter("pos + neg > 0")
        down = Window.partitionBy("trial", "side", "bin").orderBy(F.col("s").desc())
        x = rows.join(inside, ["trial", "side", "bin"]).withColumns({"_tp": F.sum("pos").over(down) + F.col("above_tp"), "_fp": F.sum("neg").over(down) + F.col("above_fp")})
        x = self._counted(x, F.col("_tp"), F.col("_fp"))
        if self.midpoint:
            x = x.filter((F.col("tp") + F.col("fp") < F.col("_scored")) | (F.col("pos") + F.col("neg") > 1))
        within = x.groupBy("trial", "side").agg(F.max(H.METRICS[self.metric]()).alias("within"))
        value = best.join(within, ["trial", "side"], "left").withColumn("value", F.greatest("best", "within"))
        return value.groupBy("trial").agg(*[F.max(F.when(F.col("side") == i, F.col("value"))).alias(f"value_{i}") for i in range(len(self.sides))])

    def thresholds(self, weights):
        """The best cut of each side under given weights, as :func:`best_cut` gives it."""
        out = {}
        flat = self.blocks.select(F.explode("rows").alias("r")).select("r.*")
        score = F.aggregate(F.zip_with("points", F.array(*[F.lit(float(w)) for w in weights]), lambda p, w: p * w), F.lit(0.0), lambda a, x: a + x)
        scored = materialize(flat.select(F.round(score, 9).alias("score"), *self.measures), "scored-points")
        for s in self.sides:
            cut = cut_of_counts(scored.select((s.sign * F.col("score")).alias("score"), F.col(s.positive).alias("pos"), (F.col(s.count) - F.col(s.positive)).alias("neg")),
                                s.totals, self.metric, self.midpoint)
            out[s.name] = None if cut is None else s.sign * cut
        return out

    def best(self, count, bins=ROUNDS):
        """The best trial: highest metric, then smallest coefficient of variation, then lowest number.

        Columns: trial, value, a threshold per side (of one side: threshold), cv, weights. No row if no trial has a cut.
        """
        left = self.every(count)
        for b in bins:
            left = self.survivors(left, b)
            if left.limit(2).count() < 2:
                break
        value = self.exact(left, b).select("trial", self._value("value").alias("value")).filter("value is not null")
        order = F.struct(F.round("value", 12), -F.coalesce(F.round("cv", 12), F.lit(float("inf"))), -F.col("trial"))
        found = self._described(value).agg(F.max_by(F.struct("trial", "value", "cv", "weights"), order).alias("b")).select("b.*").first()
        names = ["threshold"] if len(self.sides) == 1 else [f"threshold_{s.name}" for s in self.sides]
        schema = "trial long, value double, " + ", ".join(f"{x} double" for x in names) + ", cv double, weights array<double>"
        if found is None or found.trial is None:
            return self.spark.createDataFrame([], schema)
        cuts = self.thresholds(found.weights)
        return self.spark.createDataFrame([(found.trial, found.value, *[cuts[s.name] for s in self.sides], found.cv, found.weights)], schema)

    def records(self, count, bins=1024):
        """Trials that a search in order of their numbers accepts: the mean of two sides rises and their gap does not.

        The gap is the difference of the sides over their mean. A trial can only be accepted if none before it has at
        least its mean and at most its gap, so every block of trials hands on the few that pass among themselves; bounds
        from binned scores leave most trials out before any exact value is needed. The rest is folded in order, with two
        numbers in memory. Columns: ord, trial, the value of each side, mean, gap.
        """
        first, second = (F.col(f"{c}_{i}") for c, i in (("low", 0), ("low", 1)))
        found = self.bounds(self.every(count), bins)
        a, b, c, d = F.coalesce(first, F.lit(-1.0)), F.col("high_0"), F.coalesce(second, F.lit(-1.0)), F.col("high_1")
        most, least = F.greatest(b - c, d - a), F.greatest(F.lit(0.0), a - d, c - b)
        known = found.select("trial", ((a + c) / 2).alias("mean_low"), ((b + d) / 2).alias("mean_high"), most.alias("most"), least.alias("least"))
        known = known.select("trial", "mean_low", "mean_high", F.try_divide("least", F.abs("mean_high")).alias("gap_low"),
                             F.when(F.col("mean_low") > 0, F.col("most") / F.col("mean_low")).otherwise(F.lit(float("inf"))).alias("gap_high"))
        open_ = _undominated(known, ("mean_low", "gap_high"), ("mean_high", "gap_low")).select("trial")
        value = self.exact(materialize(open_, "open-trials"), bins).filter("value_0 is not null and value_1 is not null")
        mean = (F.col("value_0") + F.col("value_1")) / 2
        value = value.withColumns({"mean": F.round(mean, 12), "gap": F.round(F.try_divide(F.abs(F.col("value_0") - F.col("value_1")), F.abs(mean)), 12)}).filter("gap is not null")
        value = materialize(_undominated(materialize(value, "trial-values"), ("mean", "gap"), ("mean", "gap")), "trial-records")
        accepted, top, gap = [], -np.inf, np.inf
        for r in value.orderBy("trial").toLocalIterator():
            if r["mean"] > top and r["gap"] <= gap:
                top, gap = r["mean"], r["gap"]
                accepted.append((len(accepted), r["trial"], r["value_0"], r["value_1"], top, gap))
        one, two = (s.name for s in self.sides)
        return self.spark.createDataFrame(accepted, f"ord int, trial long, {one} double, {two} double, mean double, gap double")


def _scale(ends, weights, bins):
    lo, hi = _ends(ends, weights)
    return lo, np.where(hi > lo, bins / np.where(hi > lo, hi - lo, 1), 0.0)


def _bins(scores, lo, step, bins):
    return np.clip(np.floor((scores - lo) * step), 0, bins - 1).astype(np.int64)


def cut_of_counts(rows, totals, metric, midpoint=True):
    """Threshold of the best cut of (score, pos, neg): as :func:`best_cut`, for rows that are combined by score."""
    from motifspark.operators.running import running_totals

    run = running_totals(rows, [], "score", {"pos": F.col("pos"), "neg": F.col("neg")}, descending=True)
    p, q, scored = (float(t) for t in totals)
    cut = run.select("score", "pos", "neg", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"), (p - F.col("cum_pos")).alias("fn"), (q - F.col("cum_neg")).alias("tn"))
    cut = cut.filter("pos + neg > 0")
    if midpoint:
        cut = cut.filter((F.col("tp") + F.col("fp") < scored) | (F.col("pos") + F.col("neg") > 1))
    found = cut.withColumn("value", H.METRICS[metric]()).agg(F.max_by("score", F.struct(F.round("value", 12), -F.col("score"))).alias("score")).first()["score"]
    if found is None or not midpoint:
        return found
    below = rows.filter((F.col("score") < found) & (F.col("pos") + F.col("neg") > 0)).agg(F.max("score").alias("s")).first()["s"]
    return found if below is None else (found + below) / 2


def _undominated(df, sure, possible, block=65_536):
    """Rows that no earlier trial of their block surely dominates: by ``sure`` (mean, gap) over its ``possible`` (mean, gap)."""
    names = df.columns
    at = [names.index(c) for c in ("trial", *sure, *possible)]

    def fold(batches):
        import bisect

        block_no, means, gaps = None, [], []  # of the trials so far: falling means with falling gaps
        for batch in batches:
            trial, mean, gap, best_mean, best_gap = (batch.column(i).to_numpy(zero_copy_only=False) for i in at)
            keep = np.zeros(len(trial), bool)
            for k in range(len(trial)):
                if trial[k] // block != block_no:
                    block_no, means, gaps = trial[k] // block, [], []
                # means rise along the list and gaps rise too; the first with a mean as high has the smallest gap of these
                i = bisect.bisect_left(means, best_mean[k])
                if i < len(means) and gaps[i] <= best_gap[k]:
                    continue
                keep[k] = True
                i = bisect.bisect_left(means, mean[k])
                if i < len(means) and gaps[i] <= gap[k]:
                    continue
                i = bisect.bisect_right(means, mean[k])
                j = i
                while j and gaps[j - 1] >= gap[k]:
                    j -= 1
                means[j:i], gaps[j:i] = [mean[k]], [gap[k]]
            yield batch.filter(pa.array(keep))

    spread = df.withColumn("_block", F.expr(f"trial div {block}"))
    parts = max(1, spread.select(F.max("_block")).first()[0] or 0) + 1
    return spread.repartition(parts, "_block").sortWithinPartitions("_block", "trial").select(*names).mapInArrow(fold, df.schema)


# ---- fits ----------------------------------------------------------------------------------------------------


class ExponentialSearch(Blocks):
    """Weights whose scores fit a value best by y = a exp(b u) - d, with b of a grid and u the score over its range.

    The range of a trial's scores follows from the least and greatest points per position. For every b the fit is linear
    in exp(b u), so sums of n and y per score bin bound it: within a bin exp(b u) is off its middle by half its step at
    most, D in all, and with R0 and c the residual and slope of the fit to the middles the true residual lies between
    sqrt(R0 (1 - D^2 / See)) - |c| D and sqrt(R0) + |c| D.
    """

    def __init__(self, rows, n, rates, low=0.0, high=10.0, seed=1, forced=None, value="value"):
        known = rows.filter(F.col("points").isNotNull() & F.col(value).isNotNull()).select("points", F.lit(1).alias("rows"), F.col(value).cast("double").alias("y"))
        super().__init__(known, ["rows", "y"], n, low, high, seed, forced)
        self.rates = np.array(list(rates), float)
        total = known.agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.var_pop("y").alias("v")).first()
        self.total = (total["n"], total["y"] or 0.0, (total["v"] or 0.0) * total["n"])

    def bounds(self, trials, bins):
        """(trial, low, high) of the best R2 over the rates."""
        cells = self._tallied(trials, bins).groupBy("trial").agg(F.collect_list(F.struct("bin", "rows", "y")).alias("cells"))
        n, total, spread = self.total
        edge = np.exp(self.rates[:, None] * (np.arange(bins + 1) / bins)[None, :])
        middle, half = (edge[:, 1:] + edge[:, :-1]) / 2, np.abs(edge[:, 1:] - edge[:, :-1]) / 2

        def bound(batches):
            for batch in batches:
                lists = batch.column(1)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                bin_, rows, y = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
                ends = np.concatenate([[0], np.cumsum(sizes)])
                out = np.zeros((2, batch.num_rows))
                for k in range(batch.num_rows):
                    cell = slice(ends[k], ends[k + 1])
                    e, h, m = middle[:, bin_[cell]], half[:, bin_[cell]], rows[cell]
                    mean = e @ m / n
                    see, sey = (e * e) @ m - n * mean**2, e @ y[cell] - total * mean
                    off = np.sqrt((h * h) @ m) * (1 + 1e-9) + 1e-12
                    sure = see > off**2
                    flat = np.where(sure, see, 1.0)
                    slope, rest = np.abs(sey) / flat, np.sqrt(np.maximum(spread - sey**2 / flat, 0.0))
                    least = np.maximum(rest * np.sqrt(np.maximum(1 - off**2 / flat, 0.0)) - slope * off, 0.0)
                    out[1, k] = np.where(sure, 1 - least**2 / spread, 1.0).max()
                    out[0, k] = np.where(sure, 1 - np.minimum((rest + slope * off) ** 2, spread) / spread, 0.0).max()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0]), pa.array(out[1])], names=["trial", "low", "high"])

        return cells.mapInArrow(bound, "trial long, low double, high double")

    def exact(self, trials):
        """(trial, rate, value): R2 of every trial at every rate, from sums over all rows."""
        n, space, ends, rates = self.n, self.space, self.ends, self.rates

        def add(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    points, (m, y) = unpacked(batch.column(0).slice(k, 1), n, 2)
                    every = batch.column(1).slice(k, 1).flatten().flatten()[0].to_numpy(zero_copy_only=False)
                    for at in range(0, len(every), CHUNK):
                        trial = every[at : at + CHUNK]
                        weights = trial_weights(trial, *space)
                        lo, step = _scale(ends, weights, 1)
                        sums = np.zeros((3, len(rates), len(trial)))
                        for row in range(0, len(points), STRIP):
                            u = (_scores(points[row : row + STRIP], weights) - lo) * step
                            for r, rate in enumerate(rates):
                                e = np.exp(rate * u)
                                sums[:, r] += m[row : row + STRIP] @ e, m[row : row + STRIP] @ (e * e), y[row : row + STRIP] @ e
                        yield pa.RecordBatch.from_arrays([pa.array(np.tile(trial, len(rates))), pa.array(np.repeat(rates, len(trial))), *[pa.array(x.ravel()) for x in sums]],
                                                         names=["trial", "rate", "e", "ee", "ey"])

        rows, total, spread = self.total
        sums = self._met(trials).mapInArrow(add, "trial long, rate double, e double, ee double, ey double").groupBy("trial", "rate").agg(*[F.sum(c).alias(c) for c in ("e", "ee", "ey")])
        see, sey = F.col("ee") - F.col("e") * F.col("e") / rows, F.col("ey") - F.col("e") * total / rows
        return sums.select("trial", "rate", F.when((see > 0) & F.lit(spread > 0), sey * sey / see / F.lit(spread)).otherwise(0.0).alias("value"))

    def best(self, count, bins=(64, 512, 4096)):
        """The best trial: highest R2, then smallest coefficient of variation, then lowest number, with its rate.

        Columns: trial, value, rate, cv, weights. No row if the value does not vary.
        """
        schema = "trial long, value double, rate double, cv double, weights array<double>"
        if not self.total[2] > 0:
            return self.spark.createDataFrame([], schema)
        left = self.every(count)
        for b in bins:
            found = materialize(self.bounds(left, b), "fit-bounds")
            left = found.filter(F.col("high") >= F.lit(found.agg(F.max("low")).first()[0]) - EPS).select("trial")
            if left.limit(2).count() < 2:
                break
        rate = F.max_by(F.struct("value", "rate"), F.struct(F.round("value", 9), -F.abs("rate"), -F.col("rate"))).alias("b")
        value = self.exact(left).groupBy("trial").agg(rate).select("trial", "b.*")
        order = F.struct(F.round("value", 9), -F.coalesce(F.round("cv", 12), F.lit(float("inf"))), -F.col("trial"))
        return self._described(value).agg(F.max_by(F.struct("trial", "value", "rate", "cv", "weights"), order).alias("b")).select("b.*")


def best_for_r2(rows, count, n, low=0.0, high=4.0, seed=1, forced=None, value="value"):
    """The trial with the best linear fit of a value. All fits follow from one covariance matrix of the positions."""
    p = [F.col("points")[i] for i in range(n)]
    m = rows.agg(
        F.array(*[F.covar_samp(p[i], p[j]) for i in range(n) for j in range(n)]).alias("c"),
        F.array(*[F.covar_samp(p[i], value) for i in range(n)]).alias("v"), F.var_samp(value).alias("y"),
    ).first()
    c, v, y = np.array(m["c"]).reshape(n, n), np.array(m["v"]), m["y"]

    def fit(batches):
        for b in batches:
            w = trial_weights(b["id"].tolist(), n, low, high, seed, forced)
            spread = np.einsum("ti,ij,tj->t", w, c, w)
            r2 = np.where(spread > 0, (w @ v) ** 2 / np.where(spread > 0, spread, 1) / y, 0.0)
            yield b[["id"]].rename(columns={"id": "trial"}).assign(value=r2, cv=variation(w), weights=w.tolist())

    tried = rows.sparkSession.range(count).mapInPandas(fit, "trial long, value double, cv double, weights array<double>")
    order = F.struct(F.round("value", 12), -F.round("cv", 12), -F.col("trial"))
    return tried.agg(F.max_by(F.struct("trial", "value", "cv", "weights"), order).alias("b")).select("b.*")
