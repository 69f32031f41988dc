from pyspark.sql import functions as F

from motifspark import constants as K
from motifspark import fixtures as fx
from motifspark.functions import sequence as S
from motifspark.operators import assay as A
from motifspark.operators import conditional as C
from motifspark.operators import specificity as X
from motifspark.registry import q6, q9, r6, r9, register
from motifspark.registry.assay import B, MULT, N, PAIRS, calls_of, pairs_of
from motifspark.registry.scoring import best_sql, sweep_sql
from motifspark.registry.training_sql import ALPHA_ROWS, EQUIV_ROWS
from motifspark.session import materialize

CONTROL_ID, PLUS, MINUS = 10, 0.5, -0.5


def rows(spark, sf):
    """Peptides with sequence, fold change of A over R, best signal and pass flag."""
    cells = materialize(fx.assay(spark, sf), "assay")
    calls = calls_of(cells)
    lfc = pairs_of(cells).filter("pair = 'A_R'").select("peptide_id", "log2fc")
    flag = A.passes(cells, calls, B, N, MULT).select("peptide_id", "one_passes")
    top = A.max_bait_signal(cells, B, N).select("peptide_id", "max_signal")
    seqs = fx.peptides(spark, sf).select("peptide_id", "seq")
    return materialize(lfc.join(flag, "peptide_id").join(top, "peptide_id").join(seqs, "peptide_id"), "specificity-rows")


ROWS = f"""{PAIRS}, {fx.PEPTIDE_SQL},
srow AS (SELECT m.peptide_id, seq, q.log2fc, greatest(a, r) AS max_signal,
  CASE WHEN (coalesce(a > n, false) OR coalesce(r > n, false)) AND (pa OR pr) THEN 'Yes' ELSE '' END AS one_passes
  FROM m JOIN c USING (dataset, peptide_id) JOIN pair q ON q.peptide_id = m.peptide_id AND q.pair = 'A_R'
  JOIN peptide p ON p.peptide_id = m.peptide_id),
train AS (SELECT * FROM srow WHERE one_passes = 'Yes' AND max_signal >= 0.3 * (SELECT max_signal FROM srow WHERE peptide_id = {CONTROL_ID}))"""

WELCH = f"""{ROWS}, eqv(aa, e) AS (VALUES {EQUIV_ROWS}), alpha(aa) AS (VALUES {ALPHA_ROWS}),
tx AS (SELECT log2fc AS v, pos, substr(seq, pos, 1) AS aa FROM (SELECT *, unnest(range(1, 16)) AS pos FROM train WHERE log2fc IS NOT NULL)),
own AS (SELECT pos, aa, count(*) AS n, avg(v) AS mean, var_samp(v) AS var FROM tx GROUP BY 1, 2),
oth AS (SELECT o.pos, o.aa, count(t.v) AS n, avg(t.v) AS mean, var_samp(t.v) AS var FROM own o LEFT JOIN tx t ON t.pos = o.pos AND t.aa <> o.aa GROUP BY 1, 2),
grp AS (SELECT o.pos, o.aa, count(t.v) AS n, avg(t.v) AS mean, var_samp(t.v) AS var FROM own o JOIN eqv e ON e.aa = o.aa
  JOIN tx t ON t.pos = o.pos AND t.aa = e.e GROUP BY 1, 2),
outs AS (SELECT o.pos, o.aa, count(t.v) AS n, avg(t.v) AS mean, var_samp(t.v) AS var FROM own o LEFT JOIN tx t ON t.pos = o.pos
  AND NOT EXISTS (SELECT 1 FROM eqv e WHERE e.aa = o.aa AND e.e = t.aa) GROUP BY 1, 2),
exc AS (SELECT o.pos, o.aa, count(t.v) AS n, avg(t.v) AS mean, var_samp(t.v) AS var FROM own o LEFT JOIN eqv e ON e.aa = o.aa AND e.e <> o.aa
  LEFT JOIN tx t ON t.pos = o.pos AND t.aa = e.e GROUP BY 1, 2)"""


def welch_sql(a, b):
    va, vb = f"({a}.var / {a}.n)", f"({b}.var / {b}.n)"
    t = f"(({a}.mean - {b}.mean) / nullif(sqrt({va} + {vb}), 0))"
    df = f"(({va} + {vb}) * ({va} + {vb}) / nullif({va} * {va} / ({a}.n - 1) + {vb} * {vb} / ({b}.n - 1), 0))"
    return t, df


TESTS = f"""{WELCH},
tests AS (SELECT own.pos, own.aa, own.n, own.mean, oth.mean AS o_mean, grp.mean AS g_mean, outs.mean AS x_mean, exc.n AS en,
  {", ".join(f"{welch_sql(a, b)[0]} AS t_{a}, {welch_sql(a, b)[1]} AS df_{a}" for a, b in (("own", "oth"), ("grp", "outs"), ("exc", "outs")))}
  FROM own JOIN oth USING (pos, aa) JOIN grp USING (pos, aa) JOIN outs USING (pos, aa) JOIN exc USING (pos, aa))"""


def p_sql(t, df):
    """Two-sided p of Student's t by Simpson's rule on the angle; the integrand is smooth and its range short."""
    n = 400
    return f"""(SELECT greatest(1 - 2 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi()) * (w / 3.0)
      * sum(CASE WHEN i IN (0, {n}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(cos(i * w), {df} - 1)), 0)
   FROM (SELECT unnest(range(0, {n + 1})) AS i, atan(abs({t}) / sqrt({df})) / {n} AS w) GROUP BY w)"""


MATRIX = f"""{TESTS},
pv AS (SELECT *, {", ".join(f"CASE WHEN t_{a} IS NOT NULL AND df_{a} > 0 THEN {p_sql(f't_{a}', f'df_{a}')} END AS p_{a}" for a in ("own", "grp", "exc"))} FROM tests),
seen AS (SELECT pos, aa, CASE WHEN p_own < 0.2 OR (((g_mean < x_mean AND mean < o_mean) OR (g_mean > x_mean AND mean > o_mean))
  AND (p_grp < 0.2 OR (en > 0 AND p_exc < 0.2))) THEN mean ELSE 0.0 END AS value FROM pv),
lent AS (SELECT t.pos, e.aa, avg(v) AS value FROM tx t JOIN eqv e ON e.e = t.aa WHERE e.aa NOT IN ('B','J','O') GROUP BY 1, 2),
cellv AS (SELECT * FROM seen UNION ALL SELECT l.* FROM lent l ANTI JOIN seen s ON s.pos = l.pos AND s.aa = l.aa),
spec AS (SELECT g.pos, g.aa, coalesce(sum(value), 0.0) AS value FROM (SELECT aa, unnest(range(1, 16)) AS pos FROM alpha WHERE aa NOT IN ('B','J','O')) g
  LEFT JOIN cellv c ON c.pos = g.pos AND translate(c.aa, 'BJO', 'STY') = g.aa GROUP BY 1, 2),
sspec AS (SELECT pos, aa, value / CASE WHEN max(abs(value)) OVER (PARTITION BY pos) = 0 THEN 1 ELSE max(abs(value)) OVER (PARTITION BY pos) END AS value FROM spec),
sc AS (SELECT peptide_id, any_value(log2fc) AS log2fc, any_value(one_passes) AS one_passes, sum(value) AS score
  FROM (SELECT *, unnest(range(1, 16)) AS pos FROM srow) r JOIN sspec s ON s.pos = r.pos AND s.aa = translate(substr(r.seq, r.pos, 1), 'BJO', 'STY') GROUP BY 1)"""


def scored(spark, sf, standardize=True):
    r = rows(spark, sf)
    m = X.specificity_matrix(X.training_rows(r, CONTROL_ID), standardize=standardize)
    return r.withColumn("score", X.specificity_score(S.plain(F.col("seq")), X.matrix_tables(m)))


@register("c01_training_filter", f"WITH {ROWS} SELECT peptide_id, {q6('log2fc')} AS log2fc, {q6('max_signal')} AS max_signal FROM train")
def c01(spark, sf):
    return X.training_rows(rows(spark, sf), CONTROL_ID).select("peptide_id", r6(F.col("log2fc")).alias("log2fc"), r6(F.col("max_signal")).alias("max_signal"))


@register("c02_welch_tests", f"WITH {TESTS} SELECT pos, aa, n, en, {q6('mean')} AS mean, {q6('t_own')} AS t_own, {q6('t_grp')} AS t_grp, {q6('t_exc')} AS t_exc FROM tests")
def c02(spark, sf):
    t = X.welch_tests(X.residue_sums(X.training_rows(rows(spark, sf), CONTROL_ID)))
    return t.select("pos", "aa", "n", "en", r6(F.col("own_mean")).alias("mean"), *[r6(F.col(f"{k}_t")).alias(f"t_{k}") for k in ("own", "grp", "exc")])


@register("c02_specificity_matrix", f"WITH {MATRIX} SELECT pos, aa, {q6('value')} AS value FROM spec")
def c02_matrix(spark, sf):
    m = X.specificity_matrix(X.training_rows(rows(spark, sf), CONTROL_ID))
    return m.select("pos", "aa", r6(F.col("value")).alias("value"))


@register("c03_fill_unseen", f"WITH {MATRIX} SELECT l.pos, l.aa, {q6('l.value')} AS value FROM cellv l ANTI JOIN seen s ON s.pos = l.pos AND s.aa = l.aa")
def c03(spark, sf):
    sums = X.residue_sums(X.training_rows(rows(spark, sf), CONTROL_ID))
    none = sums.select("pos", "aa", F.lit(0.0).alias("value"))
    filled = X.fill_unseen(none, sums).join(none.select("pos", "aa"), ["pos", "aa"], "left_anti")
    return filled.select("pos", "aa", r6(F.col("value")).alias("value"))


@register("c04_collapse_and_complete", f"""WITH {WELCH} SELECT g.pos, g.aa, {q6("coalesce(sum(mean), 0.0)")} AS value
FROM (SELECT aa, unnest(range(1, 16)) AS pos FROM alpha WHERE aa NOT IN ('B','J','O')) g LEFT JOIN own o
  ON o.pos = g.pos AND translate(o.aa, 'BJO', 'STY') = g.aa GROUP BY 1, 2""")
def c04(spark, sf):
    sums = X.residue_sums(X.training_rows(rows(spark, sf), CONTROL_ID))
    m = sums.select("pos", "aa", (F.col("s") / F.col("n")).alias("value"))
    return X.complete(X.collapse_sum(m), K.RESIDUES).select("pos", "aa", r6(F.col("value")).alias("value"))


@register("c05_column_standardization", f"WITH {MATRIX} SELECT pos, aa, {q6('value')} AS value FROM sspec")
def c05(spark, sf):
    m = X.specificity_matrix(X.training_rows(rows(spark, sf), CONTROL_ID), standardize=True)
    return m.select("pos", "aa", r6(F.col("value")).alias("value"))


SIG = "(1 / (1 + exp(-5.0 * ({0} - x0))))"


@register("c06_signal_scaling", f"""WITH {ROWS}, g AS (SELECT peptide_id, greatest(max_signal, 0) AS s FROM train),
e AS (SELECT min(s) AS lo, max(s) AS hi, quantile_cont(s, 0.25) AS mid FROM g),
v AS (SELECT peptide_id, (s - lo) / (hi - lo) AS v, (mid - lo) / (hi - lo) AS x0 FROM g, e)
SELECT peptide_id, {q9(f"({SIG.format('v')} - 1 / (1 + exp(5.0 * x0))) / ({SIG.format('1.0')} - 1 / (1 + exp(5.0 * x0)))")} AS scaling FROM v""")
def c06(spark, sf):
    return X.scaling_values(X.training_rows(rows(spark, sf), CONTROL_ID)).select("peptide_id", r9(F.col("scaling")).alias("scaling"))


@register("c07_specificity_score", f"WITH {MATRIX} SELECT peptide_id, {q6('score')} AS score FROM sc")
def c07(spark, sf):
    return scored(spark, sf).select("peptide_id", r6(F.col("score")).alias("score"))


@register("c08_score_motif_columns", f"""WITH {MATRIX},
cut AS (SELECT peptide_id, CASE WHEN peptide_id % 4 > 0 THEN translate(seq, 'BJO', 'STY') ELSE '' END AS motif FROM peptide)
SELECT k.peptide_id, motif, {q6("any_value(t.score)")} AS score FROM cut k LEFT JOIN (
  SELECT peptide_id, sum(value) AS score FROM (SELECT *, unnest(range(1, 16)) AS pos FROM cut WHERE motif <> '') r
  JOIN sspec s ON s.pos = r.pos AND s.aa = substr(r.motif, r.pos, 1) GROUP BY 1) t USING (peptide_id) GROUP BY 1, 2""")
def c08(spark, sf):
    m = X.specificity_matrix(X.training_rows(rows(spark, sf), CONTROL_ID), standardize=True)
    cut = fx.peptides(spark, sf).select("peptide_id", F.when(F.col("peptide_id") % 4 > 0, S.plain(F.col("seq"))).otherwise("").alias("motif"))
    return cut.withColumn("score", r6(X.specificity_score(F.col("motif"), X.matrix_tables(m))))


SIDES = f"""{MATRIX}, sd AS (SELECT unnest(['upper', 'lower']) AS side, unnest([score, -score]) AS s,
  unnest([log2fc >= {PLUS}, log2fc <= {MINUS}]) AS t FROM sc WHERE log2fc IS NOT NULL)"""
SIDE_OUT = f"side, tp, fp, fn, tn, {q9('value')} AS value, round(CASE WHEN side = 'lower' THEN -threshold ELSE threshold END, 7) + 0.0 AS threshold"


def sides(spark, sf, metric):
    return X.two_sided(materialize(scored(spark, sf), "scored"), metric, PLUS, MINUS)


def sides_out(df):
    return df.select("side", "tp", "fp", "fn", "tn", r9(F.col("value")).alias("value"), (F.round("threshold", 7) + 0.0).alias("threshold"))


@register("c09_best_mcc", f"WITH {SIDES}, {sweep_sql('sd', 's', 't', 'side')}, {best_sql('mcc', 'side')} SELECT {SIDE_OUT} FROM best")
def c09(spark, sf):
    return sides_out(sides(spark, sf, "mcc"))


@register("c10_best_f1", f"WITH {SIDES}, {sweep_sql('sd', 's', 't', 'side')}, {best_sql('f1', 'side', False)} SELECT {SIDE_OUT} FROM best")
def c10(spark, sf):
    return sides_out(sides(spark, sf, "f1"))


@register("c11_best_accuracy", f"WITH {SIDES}, {sweep_sql('sd', 's', 't', 'side')}, {best_sql('accuracy', 'side')} SELECT {SIDE_OUT} FROM best")
def c11(spark, sf):
    return sides_out(sides(spark, sf, "accuracy"))


@register("c12_merged_statistic", f"""WITH {SIDES}, {sweep_sql('sd', 's', 't', 'side')}, {best_sql('f1', 'side', False)},
w AS (SELECT max(value) FILTER (WHERE side = 'upper') AS upper, max(value) FILTER (WHERE side = 'lower') AS lower,
  max(tp + fn) FILTER (WHERE side = 'upper') / max(tp + fn) FILTER (WHERE side = 'lower') AS ratio FROM best)
SELECT {q9("upper")} AS upper, {q9("lower")} AS lower, {q9("ratio")} AS ratio, {q9("(lower + upper * ratio) / (1 + ratio)")} AS merged FROM w""")
def c12(spark, sf):
    out = X.merged_statistic(sides(spark, sf, "f1"))
    return out.select(*[r9(F.col(c)).alias(c) for c in ("upper", "lower", "ratio", "merged")])


@register("c13_linear_r2", f"WITH {MATRIX} SELECT {q6('regr_r2(log2fc, score)')} AS r2, {q6('regr_slope(log2fc, score)')} AS slope, {q6('regr_intercept(log2fc, score)')} AS intercept FROM sc WHERE log2fc IS NOT NULL")
def c13(spark, sf):
    return X.linear_r2(scored(spark, sf)).select(*[r6(F.col(c)).alias(c) for c in ("r2", "slope", "intercept")])


@register("c15_plus_minus_merge", f"""WITH {MATRIX}, raw AS (SELECT peptide_id, sum(value) AS score
  FROM (SELECT *, unnest(range(1, 16)) AS pos FROM srow) r JOIN spec s ON s.pos = r.pos AND s.aa = translate(substr(r.seq, r.pos, 1), 'BJO', 'STY') GROUP BY 1)
SELECT peptide_id, {q6("sc.score")} AS plus_score, {q6("raw.score")} AS minus_score FROM sc FULL JOIN raw USING (peptide_id)""")
def c15(spark, sf):
    out = X.plus_minus(scored(spark, sf), scored(spark, sf, False))
    return out.select("peptide_id", r6(F.col("plus_score")).alias("plus_score"), r6(F.col("minus_score")).alias("minus_score"))


@register("c16_bias_ratio", f"""WITH {ROWS}, n AS (SELECT count(*) FILTER (WHERE one_passes = 'Yes' AND log2fc > {PLUS}) AS above,
  count(*) FILTER (WHERE one_passes = 'Yes' AND log2fc < {MINUS}) AS below FROM srow)
SELECT above, below, {q9("(above + (below = 0)::INT) / (below + (below = 0)::INT)")} AS ratio FROM n""")
def c16(spark, sf):
    return X.bias_ratio(rows(spark, sf), PLUS, MINUS).select("above", "below", r9(F.col("ratio")).alias("ratio"))


STEEP, MIDS = (0.5, 1.0, 2.0, 4.0), (-1.5, -0.5, 0.5, 1.5)


@register("c17_sigmoid_fit", f"""WITH {MATRIX}, f AS (SELECT k, x0, regr_r2(log2fc, y) AS r2, regr_slope(log2fc, y) AS height, regr_intercept(log2fc, y) AS base
  FROM (SELECT log2fc, k, x0, 1 / (1 + exp(-k * (score - x0))) AS y FROM sc, (SELECT unnest({list(STEEP)})::DOUBLE AS k), (SELECT unnest({list(MIDS)})::DOUBLE AS x0)
        WHERE log2fc IS NOT NULL) GROUP BY 1, 2)
SELECT k, x0, round(height, 5) + 0.0 AS height, round(base, 5) + 0.0 AS base, {q6("r2")} AS r2 FROM f ORDER BY round(r2, 9) DESC, k, x0 LIMIT 1""")
def c17(spark, sf):
    out = C.sigmoid_fit(scored(spark, sf).filter("log2fc is not null"), "log2fc", "score", STEEP, MIDS)
    return out.select("k", "x0", (F.round("height", 5) + 0.0).alias("height"), (F.round("base", 5) + 0.0).alias("base"), r6(F.col("r2")).alias("r2"))
