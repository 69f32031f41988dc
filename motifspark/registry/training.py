from pyspark.sql import functions as F

from motifspark import constants as K
from motifspark import fixtures as fx
from motifspark.functions import sequence as S
from motifspark.operators import training as T
from motifspark.registry import q9, r9, register
from motifspark.registry.training_sql import BASE, COUNTS, PWM, STATS

KINDS = ("positive", "suboptimal", "forbidden")
RULE = ("rule_class", "rule_pos")


def rounded(df, keys, cols):
    return df.select(*keys, *[r9(F.col(c)).alias(c) for c in cols])


def sql9(cols):
    return ", ".join(f"{q9(c)} AS {c}" for c in cols)


@register("m01_stratified_split", f"""
WITH {fx.PEPTIDE_SQL},
h AS (SELECT peptide_id, passes, ('0x' || substr(md5(peptide_id || '-1'), 1, 13))::BIGINT AS h FROM peptide),
n AS (SELECT *, row_number() OVER (PARTITION BY passes ORDER BY h) AS k, count(*) OVER (PARTITION BY passes) AS n FROM h)
SELECT peptide_id, passes, k <= ceil(n * 0.2) AS is_test FROM n""")
def m01(spark, sf):
    return T.stratified_split(fx.peptides(spark, sf)).select("peptide_id", "passes", "is_test")


@register("m02_rules", f"WITH {STATS}, {COUNTS} SELECT rule_no, rule_class, rule_pos, n_members FROM cnt")
def m02(spark, sf):
    n = T.memberships(fx.peptides(spark, sf)).groupBy(*RULE).agg(F.count("*").alias("n_members"))
    return T.rules(spark).join(n, list(RULE), "left").select(
        F.col("rule_no").cast("long").alias("rule_no"), *RULE, F.coalesce("n_members", F.lit(0)).alias("n_members")
    )


@register("m03_rule_membership", f"WITH {STATS}, {COUNTS} SELECT rule_class, rule_pos, n_members, n_members < 60 AS all_rows FROM cnt")
def m03(spark, sf):
    return T.member_counts(fx.peptides(spark, sf), 60).select(*RULE, "n_members", "all_rows")


@register("m04_rank_biserial", f"WITH {STATS} SELECT rule_class, rule_pos, pos, aa, n_pass AS n_with, p - n_pass AS n_without, {q9('r_alone')} AS r_alone FROM con WHERE n_pass > 5")
def m04(spark, sf):
    x = T.Training(fx.peptides(spark, sf)).contrasts.filter("n_ranked > 5")
    return x.select(*RULE, "pos", "aa", F.col("n_ranked").alias("n_with"), (F.col("all_ranked") - F.col("n_ranked")).alias("n_without"),
                    r9(F.col("r_alone")).alias("r_alone"))


@register("m05_group_retry", f"WITH {STATS} SELECT rule_class, rule_pos, pos, aa, gp AS group_size, {q9('r_group')} AS r_group FROM con WHERE n_pass BETWEEN 1 AND 5")
def m05(spark, sf):
    x = T.Training(fx.peptides(spark, sf)).contrasts.filter("n_ranked between 1 and 5")
    return x.select(*RULE, "pos", "aa", F.col("g_ranked").alias("group_size"), r9(F.col("r_group")).alias("r_group"))


@register("m06_unseen_positive", f"""WITH {PWM} SELECT c.rule_class, c.rule_pos, c.pos, c.aa, {q9("c.positive")} AS positive
FROM rulem_cell c JOIN con USING (rule_class, rule_pos, pos, aa) WHERE n_pass = 0""")
def m06(spark, sf):
    t = T.Training(fx.peptides(spark, sf))
    return rounded(t.cells(t.baseline).filter("n_ranked = 0"), (*RULE, "pos", "aa"), ("positive",))


@register("m07_yule_q", f"WITH {STATS} SELECT rule_class, rule_pos, pos, aa, n_pass, n_fail, {q9('q')} AS q, {q9('qg')} AS q_group FROM con")
def m07(spark, sf):
    x = T.Training(fx.peptides(spark, sf)).contrasts
    return x.select(*RULE, "pos", "aa", "n_pass", "n_fail", r9(F.col("q_alone")).alias("q"), r9(F.col("q_group")).alias("q_group"))


@register("m08_suboptimal", f"WITH {PWM} SELECT rule_class, rule_pos, pos, aa, {sql9(['suboptimal'])} FROM rulem_raw")
def m08(spark, sf):
    t = T.Training(fx.peptides(spark, sf))
    return rounded(T._cells(t.contrasts, t.baseline, t.params), (*RULE, "pos", "aa"), ("suboptimal",))


@register("m09_forbidden", f"WITH {PWM} SELECT rule_class, rule_pos, pos, aa, {sql9(['forbidden'])} FROM rulem_raw")
def m09(spark, sf):
    t = T.Training(fx.peptides(spark, sf))
    return rounded(T._cells(t.contrasts, t.baseline, t.params), (*RULE, "pos", "aa"), ("forbidden",))


@register("m10_unseen_suboptimal", f"""WITH {PWM} SELECT c.rule_class, c.rule_pos, c.pos, c.aa, {q9("c.suboptimal")} AS suboptimal
FROM rulem_cell c JOIN con USING (rule_class, rule_pos, pos, aa) WHERE n_pass + n_fail = 0""")
def m10(spark, sf):
    t = T.Training(fx.peptides(spark, sf))
    return rounded(t.cells(t.baseline).filter("n_pass + n_fail = 0"), (*RULE, "pos", "aa"), ("suboptimal",))


@register("m11_forced_required", f"WITH {PWM} SELECT rule_class, rule_pos, pos, aa, {sql9(['forbidden'])} FROM rulem_cell")
def m11(spark, sf):
    t = T.Training(fx.peptides(spark, sf))
    return rounded(t.cells(t.baseline), (*RULE, "pos", "aa"), ("forbidden",))


@register("m12_phospho_collapse", f"WITH {PWM} SELECT rule_class, rule_pos, pos, aa, {sql9(KINDS)} FROM rulem")
def m12(spark, sf):
    t = T.Training(fx.peptides(spark, sf))
    return rounded(T.collapse_phospho(t.cells(t.baseline)), (*RULE, "pos", "aa"), KINDS)


@register("m13_baseline", f"WITH {BASE} SELECT pos, aa, {sql9(KINDS)} FROM base")
def m13(spark, sf):
    return rounded(T.Training(fx.peptides(spark, sf)).baseline, ("pos", "aa"), KINDS)


@register("train_conditional_matrices", f"WITH {PWM} SELECT rule_class, rule_pos, pos, aa, {sql9(KINDS)} FROM pwm")
def pwm(spark, sf):
    return rounded(T.Training(fx.peptides(spark, sf)).pwm(), (*RULE, "pos", "aa"), KINDS)


@register("m14_replace_forbidden", f"""
WITH {PWM} SELECT rule_class, rule_pos, bool_or(round(p.positive - b.positive, 9) <> 0 OR round(p.suboptimal - b.suboptimal, 9) <> 0 OR p.forbidden <> b.forbidden) AS differs,
  bool_or(p.forbidden <> b.forbidden) AS forbidden_replaced, {q9("sum(b.forbidden)")} AS forbidden_after
FROM pwm p JOIN (SELECT pos, aa, positive, suboptimal, forbidden FROM base) b USING (pos, aa) GROUP BY 1, 2""")
def m14(spark, sf):
    t = T.Training(fx.peptides(spark, sf))
    out, report = T.replace_forbidden(t.pwm(), t.baseline)
    after = out.groupBy(*RULE).agg(r9(F.sum("forbidden")).alias("forbidden_after"))
    return report.join(after, list(RULE))


WEIGHTS = {"binding": K.POSITION_WEIGHTS, "positive": K.POSITION_WEIGHTS, "suboptimal": [-w for w in K.POSITION_WEIGHTS],
           "forbidden": [0 if i in K.SUPPRESSED_FORBIDDEN else 1 for i in range(1, 16)]}
WLIST = {k: "[" + ",".join(str(float(w)) for w in v) + "]" for k, v in WEIGHTS.items()}
WEIGHTED_SQL = f"""wpwm AS (SELECT rule_class, rule_pos, pos, aa, positive * {WLIST['binding']}[pos] AS binding,
  positive * {WLIST['positive']}[pos] AS positive, suboptimal * abs({WLIST['suboptimal']}[pos]) AS suboptimal,
  forbidden * abs({WLIST['forbidden']}[pos]) AS forbidden FROM pwm)"""


@register("m15_weighting", f"WITH {PWM}, {WEIGHTED_SQL} SELECT rule_class, rule_pos, pos, aa, {sql9(('binding', *KINDS))} FROM wpwm")
def m15(spark, sf):
    w = T.weight_matrices(T.Training(fx.peptides(spark, sf)).pwm(), WEIGHTS)
    return rounded(w, (*RULE, "pos", "aa"), ("binding", *KINDS))


REGRESSION_SQL = f"""WITH {PWM},
x AS (SELECT m.rule_class, m.rule_pos, m.peptide_id, ln(any_value(m.signal) + 1) AS y, sum(c.positive) AS x
  FROM (SELECT *, unnest(range(1, 16)) AS pos FROM mem WHERE passes) m
  JOIN rulem_cell c ON c.rule_class = m.rule_class AND c.rule_pos = m.rule_pos AND c.pos = m.pos AND c.aa = substr(m.seq, m.pos, 1)
  GROUP BY 1, 2, 3)
SELECT rule_class, rule_pos, count(*) AS n_rows, round(regr_slope(y, x), 5) + 0.0 AS slope, round(regr_intercept(y, x), 5) + 0.0 AS intercept,
  round(regr_r2(y, x), 5) + 0.0 AS sum_r2 FROM x GROUP BY 1, 2"""


@register("m16_rule_regressions", REGRESSION_SQL)
def m16(spark, sf):
    p = fx.peptides(spark, sf)
    t = T.Training(p)
    out = T.rule_regressions(p, t.cells(t.baseline))
    return out.select(*RULE, "n_rows", *[(F.round(c, 5) + 0.0).alias(c) for c in ("slope", "intercept", "sum_r2")])


MULTIVARIATE_SQL = f"""WITH RECURSIVE {PWM},
x AS (SELECT m.rule_class, m.rule_pos, m.peptide_id, list(c.positive ORDER BY m.pos) || [ln(any_value(m.signal) + 1)] AS v
  FROM (SELECT *, unnest(range(1, 16)) AS pos FROM mem WHERE passes) m
  JOIN rulem_cell c ON c.rule_class = m.rule_class AND c.rule_pos = m.rule_pos AND c.pos = m.pos AND c.aa = substr(m.seq, m.pos, 1)
  GROUP BY 1, 2, 3),
mom AS (SELECT rule_class, rule_pos, i, j, count(*) AS n, sum(v[i] * v[j]) - sum(v[i]) * sum(v[j]) / count(*) AS s
  FROM x, range(1, 17) a(i), range(1, 17) b(j) GROUP BY 1, 2, 3, 4),
start AS (SELECT rule_class, rule_pos, any_value(n) AS n_rows, list(s ORDER BY i, j) AS m, list(greatest(1e-10 * s, 1e-300) ORDER BY i) FILTER (WHERE i = j) AS least FROM mom GROUP BY 1, 2),
el AS (SELECT rule_class, rule_pos, n_rows, m, least, range(1, 16) AS rest, list_aggregate([{", ".join(f"{{'v': m[{17 * i - 16}], 'i': {-i}}}" for i in range(1, 16))}], 'max') AS best FROM start
  UNION ALL
  SELECT rule_class, rule_pos, n_rows, m, least, rest, list_aggregate(list_transform(rest, lambda i: {{'v': m[17 * i - 16], 'i': -i}}), 'max') FROM (
    SELECT rule_class, rule_pos, n_rows, least, list_filter(rest, lambda i: i <> -best.i) AS rest,
      CASE WHEN best.v > least[-best.i] THEN list_transform(range(0, 256), lambda p: m[p + 1] - m[(p // 16) * 16 - best.i] * m[(-best.i - 1) * 16 + p % 16 + 1] / best.v) ELSE m END AS m
    FROM el WHERE len(rest) > 0))
SELECT rule_class, rule_pos, n_rows, CASE WHEN s.m[256] > 0 THEN round(1 - greatest(el.m[256], 0) / s.m[256], 6) + 0.0 END AS multi_r2
FROM el JOIN start s USING (rule_class, rule_pos, n_rows) WHERE len(rest) = 0"""


@register("m16_rule_regressions_multivariate", MULTIVARIATE_SQL)
def m16_multi(spark, sf):
    p = fx.peptides(spark, sf)
    t = T.Training(p)
    return T.rule_regressions(p, t.cells(t.baseline)).select(*RULE, "n_rows", (F.round("multi_r2", 6) + 0.0).alias("multi_r2"))


@register("m17_column_copy", f"""
WITH {PWM} SELECT p.rule_class, p.rule_pos, p.pos, p.aa,
  {", ".join(f"{q9(f'CASE WHEN p.pos = 8 THEN b.{k} ELSE p.{k} END')} AS {k}" for k in KINDS[:2])}, {q9("p.forbidden")} AS forbidden
FROM pwm p JOIN base b ON b.pos = p.pos AND b.aa = p.aa""")
def m17(spark, sf):
    t = T.Training(fx.peptides(spark, sf))
    return rounded(T.copy_column(t.pwm(), t.baseline, 8, KINDS[:2]), (*RULE, "pos", "aa"), KINDS)


@register("m18_exact_forbidden")
def m18(spark, sf):
    return T.exact_forbidden(fx.peptides(spark, sf).withColumn("passes", F.col("signal") >= 250))


@register("m19_any_forbidden", f"""
WITH {BASE} SELECT peptide_id, bool_or(coalesce(forbidden > 0, false)) AS forbidden
FROM res LEFT JOIN base ON base.pos = res.pos AND base.aa = translate(res.aa, 'BJO', 'STY') GROUP BY 1""")
def m19(spark, sf):
    p = fx.peptides(spark, sf)
    return T.any_forbidden(p.withColumn("seq", S.plain(F.col("seq"))), T.Training(p).baseline)


SIGMOID = "(2 / (1 + exp(-0.05 * (signal - 50))) - 2 / (1 + exp(2.5)))"


@register("m20_additive_matrix", f"""
WITH {STATS} SELECT pos, aa, {q9(f"sum({SIGMOID})")} AS sigmoid, {q9("sum(CASE WHEN signal >= 80 THEN 3 WHEN signal >= 50 THEN 2 WHEN signal >= 20 THEN 1 ELSE 0 END)")} AS steps,
  {q9("sum(1.0)")} AS flat FROM res GROUP BY 1, 2""")
def m20(spark, sf):
    p = fx.peptides(spark, sf)
    s = F.col("signal")
    ways = {"sigmoid": T.signal_points(s, 50.0, 0.05, 2.0), "steps": T.signal_points(s, thresholds=[(20, 1), (50, 2), (80, 3)]),
            "flat": T.signal_points(s, constant=1)}
    out = None
    for name, points in ways.items():
        m = T.additive_matrix(p, points).withColumnRenamed("value", name)
        out = m if out is None else out.join(m, ["pos", "aa"])
    return rounded(out, ("pos", "aa"), tuple(ways))


@register("m21_always_allowed", f"""
WITH {STATS} SELECT pos, aa, {q9("CASE WHEN pos = 8 AND aa IN ('F','Y') THEN 1 WHEN pos = 10 AND aa IN ('D','E') THEN 1 ELSE sum(signal) END")} AS value
FROM res GROUP BY 1, 2""")
def m21(spark, sf):
    m = T.additive_matrix(fx.peptides(spark, sf), F.col("signal"))
    return rounded(T.always_allowed(m, {8: "FY", 10: "DE"}), ("pos", "aa"), ("value",))
