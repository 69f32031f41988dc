from pyspark.sql import functions as F

from motifspark import fixtures as fx
from motifspark.functions import sequence as S
from motifspark.functions.classical import classical_score
from motifspark.operators import reports as R
from motifspark.operators import thresholds as H
from motifspark.registry import q6, q9, r6, r9, register
from motifspark.registry.specificity import p_sql
from motifspark.registry.sql import CLASSICAL, classical_sql

ROWS = f"""{fx.PEPTIDE_SQL}, {CLASSICAL}, pl AS (SELECT peptide_id, signal, passes, translate(seq, 'BJO', 'STY') AS motif FROM peptide),
sp AS (SELECT peptide_id, signal, passes, -{classical_sql("motif")} AS score FROM pl, ctab)"""


def rows(spark, sf):
    p = fx.peptides(spark, sf)
    return p.select("peptide_id", "signal", "passes", (-classical_score(S.plain(F.col("seq")))).alias("score"))


RATES = f"""{ROWS}, e AS (SELECT min(score) AS lo, max(score) AS hi FROM sp),
th AS (SELECT CAST(i AS INT) AS i, CASE WHEN i = 99 THEN hi ELSE lo + i * ((hi - lo) / 99) END AS threshold FROM e, range(0, 100) t(i)),
rc AS (SELECT i, threshold, count(*) FILTER (WHERE score >= threshold AND passes) AS tp, count(*) FILTER (WHERE score >= threshold) AS pos,
  count(*) FILTER (WHERE score < threshold AND NOT passes) AS tn, count(*) FILTER (WHERE score < threshold) AS neg,
  count(*) FILTER (WHERE passes) AS np, count(*) FILTER (WHERE NOT passes) AS nq FROM th, sp GROUP BY 1, 2),
ra AS (SELECT i, threshold, tp / nullif(pos, 0) AS ppv, tn / nullif(neg, 0) AS npv, 1 - tp / nullif(pos, 0) AS fdr, 1 - tn / nullif(neg, 0) AS for_rate,
  tp / np AS sensitivity, tn / nq AS specificity FROM rc)"""


@register("t01_score_range", f"WITH {RATES} SELECT i, {q9('threshold')} AS threshold FROM th")
def t01(spark, sf):
    return H.score_range(rows(spark, sf), "score").select("i", r9(F.col("threshold")).alias("threshold"))


RATE_COLS = ("threshold", "ppv", "npv", "fdr", "for_rate", "sensitivity", "specificity")


@register("t02_rates", f"WITH {RATES} SELECT i, {', '.join(f'{q9(c)} AS {c}' for c in RATE_COLS)} FROM ra")
def t02(spark, sf):
    return H.rates(rows(spark, sf), "score", "passes").select("i", *[r9(F.col(c)).alias(c) for c in RATE_COLS])


@register("t03_balanced_threshold", f"""WITH {RATES} SELECT i, {q9('threshold')} AS threshold, {q9('fdr')} AS fdr, {q9('for_rate')} AS for_rate FROM ra
ORDER BY fdr - for_rate IS NULL, round(abs(fdr - for_rate), 12), i LIMIT 1""")
def t03(spark, sf):
    out = H.balanced_threshold(H.rates(rows(spark, sf), "score", "passes"))
    return out.select("i", *[r9(F.col(c)).alias(c) for c in ("threshold", "fdr", "for_rate")])


CALLS = f"""{ROWS}, ct AS (SELECT *, CASE WHEN score >= -9 THEN 'Positive' ELSE '-' END AS call,
  CASE WHEN score >= -9 AND passes THEN 'TP' WHEN score >= -9 THEN 'FP' WHEN passes THEN 'FN' ELSE 'TN' END AS call_type FROM sp)"""


@register("t04_apply_threshold", f"WITH {CALLS} SELECT peptide_id, call, call_type FROM ct")
def t04(spark, sf):
    return H.apply_threshold(rows(spark, sf), "score", "passes", -9.0).select("peptide_id", "call", "call_type")


@register("t05_rate_pair", f"""WITH {RATES} SELECT i, {q9('threshold')} AS threshold, {q9('(fdr + for_rate) / 2')} AS mean FROM ra
WHERE abs(fdr - for_rate) <= 0.6 ORDER BY round((fdr + for_rate) / 2, 12), i LIMIT 1""")
def t05(spark, sf):
    return H.rate_pair(H.rates(rows(spark, sf), "score", "passes"), 0.6).select(
        "i", r9(F.col("threshold")).alias("threshold"), r9(F.col("mean")).alias("mean")
    )


CHOICES = [[0.0, 1.0, 2.0], [0.5, 1.0], [0.0, 3.0]]


@register("t06_weight_grid", f"""WITH {ROWS}, {", ".join(f"g{i} AS (SELECT unnest({c}::DOUBLE[]) AS w{i})" for i, c in enumerate(CHOICES, 1))},
x AS (SELECT passes, length(replace(motif, 'S', '')) AS s, length(replace(motif, 'L', '')) AS l, length(replace(motif, 'K', '')) AS k FROM pl)
SELECT w1, w2, w3, count(*) FILTER (WHERE (w1 * s + w2 * l + w3 * k >= 50) = passes) AS hits FROM x, g1, g2, g3 GROUP BY 1, 2, 3""")
def t06(spark, sf):
    return grid_rows(spark, sf, CHOICES)


def grid_rows(spark, sf, choices):
    m = S.plain(F.col("seq"))
    lengths = [F.length(F.replace(m, F.lit(a), F.lit(""))).alias(n) for n, a in (("s", "S"), ("l", "L"), ("k", "K"))]
    x = fx.peptides(spark, sf).select("passes", *lengths).groupBy("passes", "s", "l", "k").agg(F.count("*").alias("n"))
    return H.grid_hits(x, choices, ("s", "l", "k"), 50, "passes")


FINE = [[round(0.07 * i, 2) for i in range(100)], [round(0.5 + 0.03 * i, 2) for i in range(100)], [round(3 - 0.05 * i, 2) for i in range(100)]]


@register("t06_fine_weight_grid", f"""WITH {ROWS}, {", ".join(f"g{i} AS (SELECT unnest({c}::DOUBLE[]) AS w{i})" for i, c in enumerate(FINE, 1))},
x AS (SELECT passes, length(replace(motif, 'S', '')) AS s, length(replace(motif, 'L', '')) AS l, length(replace(motif, 'K', '')) AS k, count(*) AS n FROM pl GROUP BY ALL),
h AS (SELECT w1, w2, w3, sum(n) FILTER (WHERE (round(w1 * s + w2 * l + w3 * k, 9) >= 50) = passes)::BIGINT AS hits FROM x, g1, g2, g3 GROUP BY 1, 2, 3)
SELECT hits, count(*) AS combinations, min(w1) AS w1, max(w2) AS w2, min(w3) AS w3 FROM h GROUP BY 1""")
def t06_fine(spark, sf):
    """How many of a million combinations have so many hits, and how far their weights reach."""
    hits = grid_rows(spark, sf, FINE)
    return hits.groupBy("hits").agg(F.count("*").alias("combinations"), F.min("w1").alias("w1"), F.max("w2").alias("w2"), F.min("w3").alias("w3"))


@register("r01_class_signals", f"""WITH {CALLS} SELECT call_type, count(signal) AS n, {q6("avg(signal)")} AS mean, {q6("stddev_samp(signal)")} AS std
FROM ct GROUP BY 1""")
def r01(spark, sf):
    out = R.class_signals(H.apply_threshold(rows(spark, sf), "score", "passes", -9.0))
    return out.select("call_type", "n", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


@register("r02_pairwise_t_tests", f"""WITH {CALLS}, s AS (SELECT call_type AS c, count(*) AS n, avg(signal) AS m, var_samp(signal) AS v FROM ct GROUP BY 1),
p AS (SELECT a.c AS a, b.c AS b, (a.n + b.n - 2)::DOUBLE AS df,
  (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)) AS t FROM s a JOIN s b ON a.c < b.c)
SELECT a, b, {q6("t")} AS t, df, {q6(p_sql("t", "df"))} AS p FROM p""")
def r02(spark, sf):
    out = R.pairwise_tests(H.apply_threshold(rows(spark, sf), "score", "passes", -9.0))
    return out.select("a", "b", r6(F.col("t")).alias("t"), "df", r6(F.col("p")).alias("p"))


@register("r03_homolog_deltas", f"""WITH {fx.MOTIF_ROW_SQL}
SELECT CASE WHEN host_call AND model_call THEN 'both' WHEN host_call THEN 'host_only' WHEN model_call THEN 'homolog_only' ELSE 'neither' END AS kind,
  count(*) AS n, {q6("avg(similarity * 3 - classical)")} AS delta_total, {q6("avg(similarity - binding)")} AS delta_binding
FROM motif_row WHERE homolog_id IS NOT NULL GROUP BY 1""")
def r03(spark, sf):
    rows_ = fx.motif_rows(spark, sf).select(
        "homolog_id", "host_call", F.col("model_call").alias("homolog_call"), (F.col("similarity") * 3).alias("homolog_total"),
        F.col("classical").alias("host_total"), F.col("similarity").alias("homolog_binding"), F.col("binding").alias("host_binding"),
    )
    return R.homolog_deltas(rows_).select("kind", "n", r6(F.col("delta_total")).alias("delta_total"), r6(F.col("delta_binding")).alias("delta_binding"))
