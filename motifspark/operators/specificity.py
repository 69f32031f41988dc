"""Specificity matrices: mean log2 fold change per residue and position, kept where a Welch test finds a difference."""

from pyspark.sql import functions as F

from motifspark import constants as K
from motifspark.functions import sequence as S
from motifspark.functions.pvalues import t_pvalue
from motifspark.operators import thresholds as H
from motifspark.operators.running import percentiles
from motifspark.operators.training import _lookup, collapse_sum


def training_rows(rows, control_id, share=0.3, key="peptide_id"):
    """Passing rows whose signal reaches a share of the control peptide's highest; an error if the control is missing."""
    control = rows.filter(F.col(key) == control_id).agg(F.max("max_signal").alias("limit"))
    missing = F.raise_error(F.lit(f"the control peptide {control_id} has no signal")).cast("double")
    limit = control.select(F.coalesce("limit", missing)).scalar()
    return rows.filter((F.col("one_passes") == "Yes") & (F.col("max_signal") >= share * limit))


def _moments(prefix, n, s, q):
    """Mean and sample variance from count, sum and sum of squares."""
    mean = F.try_divide(s, n)
    var = F.when(n > 1, F.greatest((q - s * mean) / (n - 1), F.lit(0.0)))
    return {f"{prefix}_n": n, f"{prefix}_mean": mean, f"{prefix}_var": var}


def _welch(a, b):
    """t and degrees of freedom of two samples given their moments."""
    c = F.col
    va, vb = F.try_divide(c(f"{a}_var"), c(f"{a}_n")), F.try_divide(c(f"{b}_var"), c(f"{b}_n"))
    t = F.try_divide(c(f"{a}_mean") - c(f"{b}_mean"), F.sqrt(va + vb))
    df = F.try_divide((va + vb) * (va + vb), va * va / (c(f"{a}_n") - 1) + vb * vb / (c(f"{b}_n") - 1))
    return t, df


def residue_sums(rows, value="log2fc"):
    """Count, sum and sum of squares of finite values per (pos, aa): at most 15 x 23 rows."""
    finite = rows.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf")))
    at = finite.select(F.col(value).alias("v"), F.posexplode(S.residues(F.col("seq"))).alias("_i", "aa"))
    return at.groupBy((F.col("_i") + 1).alias("pos"), "aa").agg(
        F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")
    )


def welch_tests(sums):
    """Moments and Welch statistics of each residue against the rest, alone, as a group, and as a group without itself."""
    c = F.col
    total = sums.groupBy("pos").agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"), F.sum("q").alias("all_q"))
    standing, without = {}, {}
    for aa, group in K.EQUIVALENTS.items():
        for e in group:
            standing[e] = standing.get(e, "") + aa
            if e != aa:
                without[e] = without.get(e, "") + aa

    def pooled(mapping, p):
        lent = sums.select("pos", F.explode(_lookup(mapping, c("aa"))).alias("aa"), "n", "s", "q").filter("aa <> ''")
        return lent.groupBy("pos", "aa").agg(*[F.sum(k).alias(f"{p}{k}") for k in "nsq"])

    x = sums.join(total, "pos").join(pooled(standing, "g"), ["pos", "aa"], "left").join(pooled(without, "e"), ["pos", "aa"], "left")
    zero = F.lit(0)
    x = x.withColumns({k: F.coalesce(c(k), zero) for k in ("en", "es", "eq")})
    x = x.withColumns({
        **_moments("own", c("n"), c("s"), c("q")), **_moments("other", c("all_n") - c("n"), c("all_s") - c("s"), c("all_q") - c("q")),
        **_moments("grp", c("gn"), c("gs"), c("gq")), **_moments("out", c("all_n") - c("gn"), c("all_s") - c("gs"), c("all_q") - c("gq")),
        **_moments("exc", c("en"), c("es"), c("eq")),
    })
    tests = {}
    for name, (a, b) in {"own": ("own", "other"), "grp": ("grp", "out"), "exc": ("exc", "out")}.items():
        tests[f"{name}_t"], tests[f"{name}_df"] = _welch(a, b)
    return x.withColumns(tests)


def specificity_matrix(rows, alpha=0.2, standardize=False, include_phospho=False):
    """Residue by position matrix (pos, aa, value), complete over the alphabet."""
    c = F.col
    sums = residue_sums(rows)
    x = welch_tests(sums).withColumns({f"{k}_p": t_pvalue(c(f"{k}_t"), c(f"{k}_df")) for k in ("own", "grp", "exc")})
    side = ((c("grp_mean") < c("out_mean")) & (c("own_mean") < c("other_mean"))) | (
        (c("grp_mean") > c("out_mean")) & (c("own_mean") > c("other_mean")))
    kept = (c("own_p") < alpha) | (side & (c("grp_p") < alpha)) | (side & (c("en") > 0) & (c("exc_p") < alpha))
    seen = x.select("pos", "aa", F.when(F.coalesce(kept, F.lit(False)), c("own_mean")).otherwise(0.0).alias("value"))
    full = complete(fill_unseen(seen, sums), K.RESIDUES_PHOSPHO)
    if not include_phospho:
        full = complete(collapse_sum(full), K.RESIDUES)
    return standardize_columns(full) if standardize else full


def fill_unseen(seen, sums):
    """Residues without any value at a position get the mean over their equivalence group; phospho codes do not."""
    standing = {}
    for aa, group in K.EQUIVALENTS.items():
        if aa in K.PHOSPHO:
            continue
        for e in group:
            standing[e] = standing.get(e, "") + aa
    lent = sums.select("pos", F.explode(_lookup(standing, F.col("aa"))).alias("aa"), "n", "s").filter("aa <> ''")
    mean = lent.groupBy("pos", "aa").agg((F.sum("s") / F.sum("n")).alias("value"))
    return seen.unionByName(mean.join(seen, ["pos", "aa"], "left_anti"))


def complete(matrix, letters, n=K.MOTIF_LENGTH):
    """Every residue at every position, zero where there is no value, in alphabet order."""
    one = matrix.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(a) for a in letters])).alias("aa_no", "aa"))
    grid = one.select("aa_no", "aa", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("pos"))
    return grid.join(matrix, ["pos", "aa"], "left").select("pos", "aa", "aa_no", F.coalesce("value", F.lit(0.0)).alias("value"))


def standardize_columns(matrix):
    top = matrix.groupBy("pos").agg(F.max(F.abs("value")).alias("_top"))
    return matrix.join(top, "pos").withColumn("value", F.col("value") / F.when(F.col("_top") == 0, 1.0).otherwise(F.col("_top"))).drop("_top")


def scaling_values(rows, percentile=25, steepness=5):
    """Signals scaled to 0..1, passed through a sigmoid at a percentile, re-anchored to (0, 0) and (1, 1)."""
    x = rows.withColumn("_s", F.greatest("max_signal", F.lit(0.0)))
    ends = x.agg(F.min("_s").alias("lo"), F.max("_s").alias("hi"))
    middle = F.struct("lo", "hi", percentiles(x, "_s", [percentile]).select("value").scalar().alias("mid"))
    e = x.withColumn("_e", ends.select(middle).scalar())
    span = F.col("_e.hi") - F.col("_e.lo")
    v, x0 = (F.col("_s") - F.col("_e.lo")) / span, (F.col("_e.mid") - F.col("_e.lo")) / span
    k = F.lit(float(steepness))

    def sig(t):
        return 1 / (1 + F.exp(-k * (t - x0)))

    at0 = 1 / (1 + F.exp(k * x0))
    return e.withColumn("scaling", (sig(v) - at0) / (sig(F.lit(1.0)) - at0)).drop("_s", "_e")


def matrix_tables(matrix, weights=None, n=K.MOTIF_LENGTH):
    """The bounded matrix as one lookup literal per position; other letters give null."""
    rows = {(r["pos"], r["aa"]): r["value"] for r in matrix.collect()}
    w = weights or [1.0] * n
    return [{aa: rows.get((p, aa), 0.0) * w[p - 1] for aa in K.RESIDUES} for p in range(1, n + 1)]


def specificity_score(seq, tables):
    """Sum of matrix cells; null for a sequence with a residue outside the alphabet or of another length."""
    known = F.rlike(seq, F.lit(f"^[{K.RESIDUES}]{{{len(tables)}}}$"))
    cells = [S.letter_table(t, 0.0)[S.letter_index(S.residue_at(seq, i))] for i, t in enumerate(tables, start=1)]
    return F.when(known, sum(cells[1:], cells[0]))


def two_sided(scored, metric="f1", plus=1.0, minus=-1.0, score="score", value="log2fc"):
    """Best thresholds for high and low fold changes, their metric, and the ratio-weighted mean of both."""
    known = scored.filter(F.col(score).isNotNull() & F.col(value).isNotNull()).select(F.col(score).alias("_s"), F.col(value).alias("_v"))
    sides = known.select(F.explode(F.array(
        F.struct(F.lit("upper").alias("side"), F.col("_s").alias("s"), (F.col("_v") >= plus).alias("t")),
        F.struct(F.lit("lower").alias("side"), (-F.col("_s")).alias("s"), (F.col("_v") <= minus).alias("t")),
    )).alias("x")).select("x.*")
    best = H.best_cut(sides, "s", "t", metric, keys=("side",), midpoint=metric != "f1")
    best = best.withColumn("threshold", F.when(F.col("side") == "lower", -F.col("threshold")).otherwise(F.col("threshold")))
    return best.withColumn("positives", F.col("tp") + F.col("fn"))


def merged_statistic(sides):
    """(lower + upper * ratio) / (1 + ratio), ratio = number high / number low."""
    def of(side, col):
        return F.max(F.when(F.col("side") == side, F.col(col)))

    g = sides.agg(of("upper", "value").alias("upper"), of("lower", "value").alias("lower"),
                  F.try_divide(of("upper", "positives"), of("lower", "positives")).alias("ratio"))
    return g.withColumn("merged", (F.col("lower") + F.col("upper") * F.col("ratio")) / (1 + F.col("ratio")))


def linear_r2(scored, score="score", value="log2fc"):
    """Regression of the fold change on the score over rows that have both."""
    return scored.filter(F.col(score).isNotNull() & F.col(value).isNotNull()).agg(
        F.regr_r2(value, score).alias("r2"), F.regr_slope(value, score).alias("slope"), F.regr_intercept(value, score).alias("intercept")
    )


def bias_ratio(rows, plus=1.0, minus=-1.0):
    """Passing rows above the upper to those below the lower fold change; both plus one if the latter is none."""
    ok = F.col("one_passes") == "Yes"
    n = rows.agg(F.count_if(ok & (F.col("log2fc") > plus)).alias("above"), F.count_if(ok & (F.col("log2fc") < minus)).alias("below"))
    extra = F.when(F.col("below") == 0, 1).otherwise(0)
    return n.select("above", "below", ((F.col("above") + extra) / (F.col("below") + extra)).alias("ratio"))


def plus_minus(plus_scored, minus_scored, key="peptide_id"):
    """Two optimizations side by side."""
    return plus_scored.select(key, F.col("score").alias("plus_score")).join(
        minus_scored.select(key, F.col("score").alias("minus_score")), key, "full"
    )


def search_weights(rows, metric, side, trials, n=K.MOTIF_LENGTH, plus=1.0, minus=-1.0, low=0.0, high=4.0, seed=1, forced=None):
    """Position weights by random search on the ``upper`` side, the ``lower`` side or the ratio-weighted ``mean`` of both.

    ``rows`` has points (matrix value per position) and value (fold change). One histogram of the scores is swept from
    both ends. A mean needs rows above and below; without them it is of the side that has rows.
    """
    from motifspark.operators.search import Search, Side

    counted = rows.select("points", F.lit(1).alias("rows"), (F.col("value") >= plus).cast("int").alias("above"), (F.col("value") <= minus).cast("int").alias("below"))
    shares = {"upper": (1.0, 0.0), "lower": (0.0, 1.0)}.get(side)
    if shares is None:
        n_above, n_below = counted.agg(F.coalesce(F.sum("above"), F.lit(0)), F.coalesce(F.sum("below"), F.lit(0))).first()
        whole = max(n_above + n_below, 1)
        shares = n_above / whole, n_below / whole
    every = [Side("upper", "above", "rows", 1, shares[0]), Side("lower", "below", "rows", -1, shares[1])]
    best = Search(counted, n, low, high, seed, forced, metric, [s for s in every if s.share > 0] or every[:1]).best(trials)
    return best.withColumnRenamed("threshold", f"threshold_{side}")
