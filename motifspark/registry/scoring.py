from pyspark.sql import functions as F

from motifspark import fixtures as fx
from motifspark.functions import sequence as S
from motifspark.operators import conditional as C
from motifspark.operators import thresholds as H
from motifspark.operators import training as T
from motifspark.plans import training_plan
from motifspark.registry import q6, q9, r6, r9, register
from motifspark.registry.sequences import CLASS_SQL
from motifspark.registry.training import WEIGHTED_SQL, WEIGHTS
from motifspark.registry.training_sql import PWM
from motifspark.session import materialize, scratch_path

UNWEIGHTED = ("positive", "suboptimal", "forbidden")
KINDS = ("binding", *UNWEIGHTED)

PRES = f"""pres AS (SELECT peptide_id, passes, signal, pos, substr(t, pos, 1) AS aa,
  {CLASS_SQL.format("substr(t, greatest(pos - 1, 1), 1)")} AS lc, {CLASS_SQL.format("substr(t, least(pos + 1, 15), 1)")} AS rc
  FROM (SELECT *, translate(seq, 'BJO', 'STY') AS t, unnest(range(1, 16)) AS pos FROM peptide))"""


def cell_sql(table, kinds):
    return f"""SELECT p.peptide_id, p.passes, p.signal, p.pos, {", ".join(f"(l.{k} + r.{k}) / 2 AS {k}" for k in kinds)}
  FROM pres p JOIN {table} l ON l.rule_class = p.lc AND l.rule_pos = greatest(p.pos - 1, 1) AND l.pos = p.pos AND l.aa = p.aa
  JOIN {table} r ON r.rule_class = p.rc AND r.rule_pos = least(p.pos + 1, 15) AND r.pos = p.pos AND r.aa = p.aa"""


SCORES = f"""{PWM}, {WEIGHTED_SQL}, {PRES},
cell AS ({cell_sql("wpwm", KINDS)}),
sums AS (SELECT peptide_id, any_value(passes) AS passes, any_value(signal) AS signal,
  {", ".join(f"sum({k}) AS {k}" for k in KINDS)} FROM cell GROUP BY 1),
tot AS (SELECT *, positive - suboptimal AS ps, binding - suboptimal AS wps, -suboptimal AS sub, forbidden > 0 AS banned FROM sums)"""
SCORES = SCORES.replace("\ntot AS (SELECT *, positive", "\nscored AS (SELECT *, positive")

COEF = """coef AS (SELECT min(CASE WHEN NOT banned THEN ps END) AS ta, max(CASE WHEN NOT banned THEN ps END) - min(CASE WHEN NOT banned THEN ps END) AS tb,
  min(positive) AS pa, max(positive) - min(positive) AS pb, min(suboptimal) AS sa, max(suboptimal) - min(suboptimal) AS sb,
  min(binding) AS ba, max(binding) - min(binding) AS bb FROM scored),
std AS (SELECT peptide_id, passes, signal, banned, forbidden, CASE WHEN NOT banned THEN (ps - ta) / tb END AS total,
  (positive - pa) / pb AS positive, (suboptimal - sa) / sb AS suboptimal, (binding - ba) / bb AS binding FROM scored, coef)"""


def sweep_sql(src, score, truth="passes", keys=""):
    k, part = (f"{keys}, ", f"PARTITION BY {keys}") if keys else ("", "")
    using = f"JOIN sw_t USING ({keys})" if keys else ", sw_t"
    return f"""sw_s AS (SELECT {k}round({score}, 9) AS s, {truth} AS t FROM {src}),
sw_d AS (SELECT {k}s, count(*) FILTER (WHERE t) AS p, count(*) FILTER (WHERE NOT t) AS q FROM sw_s WHERE s IS NOT NULL GROUP BY {k}s),
sw_t AS (SELECT {k}count(*) FILTER (WHERE t) AS np, count(*) FILTER (WHERE NOT t) AS nq FROM sw_s {f"GROUP BY {keys}" if keys else ""}),
sw_c AS (SELECT {k}s, p + q AS here, lag(s) OVER ({part} ORDER BY s) AS below,
  sum(p) OVER ({part} ORDER BY s DESC) AS tp, sum(q) OVER ({part} ORDER BY s DESC) AS fp FROM sw_d),
sw AS (SELECT {k}s AS score, here, below, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(np - tp AS BIGINT) AS fn,
  CAST(nq - fp AS BIGINT) AS tn FROM sw_c {using})"""


METRIC_SQL = {
    "accuracy": "((tp + tn) / (tp + tn + fp + fn))",
    "precision": "(tp / nullif(tp + fp, 0))", "recall": "(tp / nullif(tp + fn, 0))",
    "f1": "(2 * tp / nullif(2 * tp + fp + fn, 0))",
    "mcc": """coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0)""",
}


def best_sql(metric, keys="", midpoint=True):
    part = f"PARTITION BY {keys}" if keys else ""
    where = "WHERE below IS NOT NULL OR here > 1" if midpoint else ""
    cut = "coalesce((score + below) / 2, score)" if midpoint else "score"
    return f"""best AS (SELECT {keys + ", " if keys else ""}tp, fp, fn, tn, value, {cut} AS threshold FROM (
  SELECT *, row_number() OVER ({part} ORDER BY round(value, 12) DESC, score) AS k FROM (SELECT *, {METRIC_SQL[metric]} AS value FROM sw {where}))
  WHERE k = 1)"""


def peptides_plain(spark, sf):
    p = fx.peptides(spark, sf)
    return p.withColumn("motif", S.plain(F.col("seq")))


def weighted_model(peptides):
    t = T.Training(peptides)
    w = materialize(T.weight_matrices(t.pwm(), WEIGHTS), "weighted-matrices")
    return C.ConditionalModel.from_pwm(w, KINDS)


def scored_peptides(spark, sf):
    """Peptides with unstandardized weighted scores, cut off from the training that made them."""
    p = materialize(peptides_plain(spark, sf), "peptides")
    model = weighted_model(p)
    return model, materialize(model.score(p), "scored-peptides")


def standardized_peptides(spark, sf):
    model, raw = scored_peptides(spark, sf)
    coef = {r["kind"]: (r["a"], r["b"]) for r in C.minmax_coefficients(raw).collect()}
    p = raw.select("peptide_id", "seq", "motif", "signal", "passes")
    model.coefficients = coef
    return model, model.score(p)


@register("p01_conditional_score", f"""
WITH {PWM}, {PRES}, cell AS ({cell_sql("pwm", UNWEIGHTED)})
SELECT peptide_id, {", ".join(f"{q9(f'sum({k})')} AS {k}" for k in UNWEIGHTED)} FROM cell GROUP BY 1""")
def p01(spark, sf):
    p = materialize(peptides_plain(spark, sf), "peptides")
    model = C.ConditionalModel.from_pwm(materialize(T.Training(p).pwm(), "matrices"))
    return p.select("peptide_id", *[r9(model.total_score(F.col("motif"), k)).alias(k) for k in UNWEIGHTED])


@register("p14_sum_score", f"""
WITH {PWM}, {PRES}, cell AS ({cell_sql("pwm", UNWEIGHTED)})
SELECT peptide_id, {", ".join(f"{q9(f'2 * sum({k})')} AS {k}" for k in UNWEIGHTED)} FROM cell GROUP BY 1""")
def p14(spark, sf):
    p = materialize(peptides_plain(spark, sf), "peptides")
    model = C.ConditionalModel.from_pwm(materialize(T.Training(p).pwm(), "matrices"), mode="sum")
    return p.select("peptide_id", *[r9(model.total_score(F.col("motif"), k)).alias(k) for k in UNWEIGHTED])


@register("s11_saved_model_scores", f"WITH {SCORES} SELECT peptide_id, CASE WHEN NOT banned THEN {q9('wps')} END AS total FROM scored")
def s11(spark, sf):
    """Train, save, load and score: the method and the weights come back from the files."""
    p = peptides_plain(spark, sf)
    matrices = materialize(T.Training(p).pwm(), "matrices")
    trained = C.ConditionalModel.from_pwm(T.weight_matrices(matrices, WEIGHTS), KINDS, method="wps")
    model = training_plan.load(spark, training_plan.save(scratch_path(spark, "model"), matrices, WEIGHTS, trained))
    return model.score(p).select("peptide_id", r9(F.col("total")).alias("total"))


@register("s11_reused_model", f"""WITH {fx.PEPTIDE_SQL}, p AS (SELECT count(*) AS n FROM peptide)
SELECT unnest(['first', 'again', 'one row more']) AS training, unnest([false, true, false]) AS reused, unnest([n, n, n + 1]) AS n, 0 AS differing FROM p""")
def s11_reused(spark, sf):
    """The second training with equal rows reads the first one's model; a further row trains anew."""
    p, folder = materialize(fx.peptides(spark, sf), "peptides"), scratch_path(spark, "models")
    more = p.unionByName(p.orderBy("peptide_id").limit(1))
    out, first = None, None
    for no, (name, rows) in enumerate((("first", p), ("again", p.repartition(3)), ("one row more", more))):
        model, reused = training_plan.train_or_load(folder, rows, test_share=0.0)
        scores = model.score(p.withColumn("motif", S.plain(F.col("seq")))).select("peptide_id", "total")
        first = scores if first is None else first
        other = F.lit(0) if no != 1 else scores.exceptAll(first).agg(F.count("*").cast("int")).scalar()
        row = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("training"), F.lit(reused).alias("reused"), "n", other.alias("differing"))
        out = row if out is None else out.unionByName(row)
    return out


@register("p02_total_score", f"WITH {SCORES} SELECT peptide_id, {', '.join(f'{q9(k)} AS {k}' for k in ('ps', 'wps', 'sub'))} FROM scored")
def p02(spark, sf):
    p = peptides_plain(spark, sf)
    model = weighted_model(p)
    parts = {k: model.total_score(F.col("motif"), k) for k in ("binding", "positive", "suboptimal")}
    return p.select("peptide_id", r9(parts["positive"] - parts["suboptimal"]).alias("ps"),
                    r9(parts["binding"] - parts["suboptimal"]).alias("wps"), r9(-parts["suboptimal"]).alias("sub"))


STD_COLS = ("total", "positive", "suboptimal", "binding")


@register("p03_standardized_scores", f"WITH {SCORES}, {COEF} SELECT peptide_id, {', '.join(f'{q9(k)} AS {k}' for k in STD_COLS)} FROM std")
def p03(spark, sf):
    _, s = standardized_peptides(spark, sf)
    return s.select("peptide_id", *[r9(F.col(k)).alias(k) for k in STD_COLS])


@register("p04_disqualify_and_call", f"""
WITH {SCORES}, {COEF} SELECT peptide_id, banned, coalesce(round(total, 9) >= 0.5, false) AS call, {q9("forbidden")} AS forbidden FROM std""")
def p04(spark, sf):
    model, s = standardized_peptides(spark, sf)
    model.threshold = 0.5
    out = model.score(s.select("peptide_id", "motif"))
    return out.select("peptide_id", (F.col("forbidden") > 0).alias("banned"), "call", r9(F.col("forbidden")).alias("forbidden"))


@register("p05_minmax_coefficients", f"""
WITH {SCORES}, {COEF} SELECT unnest(['total', 'positive', 'suboptimal', 'binding']) AS kind,
  {q9("unnest([ta, pa, sa, ba])")} AS a, {q9("unnest([tb, pb, sb, bb])")} AS b FROM coef""")
def p05(spark, sf):
    _, s = scored_peptides(spark, sf)
    return C.minmax_coefficients(s).select("kind", r9(F.col("a")).alias("a"), r9(F.col("b")).alias("b"))


BEST_OUT = f"tp, fp, fn, tn, {q9('value')} AS value, round(threshold, 8) + 0.0 AS threshold"


def best_out(df, *keys):
    return df.select(*keys, "tp", "fp", "fn", "tn", r9(F.col("value")).alias("value"), (F.round("threshold", 8) + 0.0).alias("threshold"))


@register("p06_best_accuracy", f"WITH {SCORES}, {COEF}, {sweep_sql('std', 'total')}, {best_sql('accuracy')} SELECT {BEST_OUT} FROM best")
def p06(spark, sf):
    _, s = standardized_peptides(spark, sf)
    return best_out(H.best_cut(materialize(s, "standardized"), "total", "passes"))


RATES = [round(-4 + 0.5 * i, 1) for i in range(17) if i != 8]


@register("p08_exponential_fit", f"""
WITH {SCORES}, {COEF}, fits AS (SELECT b, regr_r2(signal, exp(b * binding)) AS r2, regr_slope(signal, exp(b * binding)) AS a,
  -regr_intercept(signal, exp(b * binding)) AS d FROM std, (SELECT unnest({RATES}) AS b) WHERE passes GROUP BY 1)
SELECT b::DOUBLE AS b, round(a, 4) + 0.0 AS a, round(d, 4) + 0.0 AS d, {q6("r2")} AS r2 FROM fits ORDER BY round(r2, 9) DESC, abs(b) LIMIT 1""")
def p08(spark, sf):
    _, s = standardized_peptides(spark, sf)
    f = C.exponential_fit(s.filter("passes"), "signal", "binding", RATES)
    return f.select("b", (F.round("a", 4) + 0.0).alias("a"), (F.round("d", 4) + 0.0).alias("d"), r6(F.col("r2")).alias("r2"))


@register("p09_predefined_weights", f"""
WITH {SCORES}, {COEF}, {sweep_sql('std', 'total')}, {best_sql('accuracy')},
fit AS (SELECT regr_r2(signal, exp(2 * binding)) AS r2 FROM std WHERE passes)
SELECT {q9("ta")} AS a, {q9("tb")} AS b, round(threshold, 8) + 0.0 AS threshold, {q9("value")} AS accuracy, {q6("r2")} AS r2 FROM coef, best, fit""")
def p09(spark, sf):
    model, s = standardized_peptides(spark, sf)
    s = materialize(s, "standardized")
    a, b = model.coefficients["total"]
    best = H.best_cut(s, "total", "passes")
    r2 = s.filter("passes").agg(F.regr_r2("signal", F.exp(2 * F.col("binding")))).scalar()
    return best.select(r9(F.lit(a)).alias("a"), r9(F.lit(b)).alias("b"), (F.round("threshold", 8) + 0.0).alias("threshold"),
                       r9(F.col("value")).alias("accuracy"), r6(r2).alias("r2"))


@register("p10_method_selection", f"""
WITH {SCORES}, m AS (SELECT passes, unnest(['ps', 'wps', 'suboptimal']) AS method, CASE WHEN NOT banned THEN unnest([ps, wps, sub]) END AS s FROM scored),
{sweep_sql('m', 's', keys='method')}, {best_sql('accuracy', 'method')} SELECT method, {BEST_OUT} FROM best""")
def p10(spark, sf):
    _, s = scored_peptides(spark, sf)
    ways = {"ps": F.col("positive") - F.col("suboptimal"), "wps": F.col("binding") - F.col("suboptimal"), "suboptimal": -F.col("suboptimal")}
    banned = F.col("forbidden") > 0
    rows = s.select("passes", F.explode(F.array(*[
        F.struct(F.lit(m).alias("method"), F.when(~banned, v).alias("s")) for m, v in ways.items()])).alias("m")).select("passes", "m.*")
    return best_out(H.best_cut(rows, "s", "passes", keys=("method",)), "method")


@register("p11_threshold_sweep", f"""
WITH {SCORES}, {sweep_sql('scored', 'CASE WHEN NOT banned THEN ps END')}
SELECT score + 0.0 AS score, tp, fp, {", ".join(f"{q9(METRIC_SQL[m])} AS {m}" for m in ("precision", "recall", "accuracy"))} FROM sw""")
def p11(spark, sf):
    _, s = scored_peptides(spark, sf)
    out = H.sweep(s, "total", "passes")
    return out.select((F.col("score") + 0.0).alias("score"), "tp", "fp", *[r9(H.METRICS[m]()).alias(m) for m in ("precision", "recall", "accuracy")])


@register("p12_confusion_report", f"""
WITH {SCORES}, {COEF}, c AS (SELECT passes, coalesce(round(total, 9) >= 0.5, false) AS call FROM std),
n AS (SELECT count(*) FILTER (WHERE call AND passes) AS tp, count(*) FILTER (WHERE call AND NOT passes) AS fp,
  count(*) FILTER (WHERE NOT call AND passes) AS fn, count(*) FILTER (WHERE NOT call AND NOT passes) AS tn FROM c)
SELECT tp, fp, fn, tn, {q9(METRIC_SQL["precision"])} AS precision, {q9(METRIC_SQL["recall"])} AS recall, {q9("tn / nullif(tn + fn, 0)")} AS npv,
  {q9(METRIC_SQL["f1"])} AS f1, {q9(f"2 * {METRIC_SQL['precision']} * (tn / (tn + fn)) / ({METRIC_SQL['precision']} + tn / (tn + fn))")} AS f1_ppv_npv,
  {q9(METRIC_SQL["mcc"])} AS mcc, {q9(METRIC_SQL["accuracy"])} AS accuracy FROM n""")
def p12(spark, sf):
    model, s = standardized_peptides(spark, sf)
    model.threshold = 0.5
    out = H.confusion(model.score(s.select("motif", "passes")), "call", "passes")
    return out.select("tp", "fp", "fn", "tn", *[r9(F.col(c)).alias(c) for c in ("precision", "recall", "npv", "f1", "f1_ppv_npv", "mcc", "accuracy")])


@register("p13_scored_peptide_table", f"""
WITH {SCORES}, u AS ({cell_sql("pwm", UNWEIGHTED)}),
wide AS (SELECT peptide_id, {", ".join(f"{q9(f'sum({k}) FILTER (WHERE pos = {i})')} AS {k}_{i}" for k in KINDS for i in range(1, 16))} FROM cell GROUP BY 1),
uwide AS (SELECT peptide_id, {", ".join(f"{q9(f'sum({k})')} AS raw_{k}" for k in UNWEIGHTED)} FROM u GROUP BY 1)
SELECT w.*, {", ".join(f"raw_{k}" for k in UNWEIGHTED)}, {", ".join(f"{q9(f's.{k}')} AS {k}" for k in KINDS)}, {q9("s.ps")} AS total, coalesce(NOT banned AND round(ps, 9) >= 0, false) AS call
FROM wide w JOIN uwide USING (peptide_id) JOIN scored s USING (peptide_id)""")
def p13(spark, sf):
    p = materialize(peptides_plain(spark, sf), "peptides")
    pwm = materialize(T.Training(p).pwm(), "matrices")
    raw = C.ConditionalModel.from_pwm(pwm)
    model = C.ConditionalModel.from_pwm(T.weight_matrices(pwm, WEIGHTS), KINDS)
    m = F.col("motif")
    out = model.score(p)
    places = [r9(c).alias(f"{k}_{i}") for k in KINDS for i, c in enumerate(model.position_scores(m, k), start=1)]
    total = model.total_score(m, "positive") - model.total_score(m, "suboptimal")
    return out.select("peptide_id", *places, *[r9(raw.total_score(m, k)).alias(f"raw_{k}") for k in UNWEIGHTED],
                      *[r9(F.col(k)).alias(k) for k in KINDS], r9(total).alias("total"), "call")
