from pyspark.sql import functions as F

from motifspark import constants as K
from motifspark.functions import sequence as S
from motifspark.operators import conditional as C
from motifspark.operators import specificity as X
from motifspark.operators import training as T
from motifspark.operators.search import GOLDEN, ExponentialSearch, Search, Side, best_for_r2
from motifspark.plans.training_plan import search_points
from motifspark.registry import q9, r9, register
from motifspark.registry.scoring import PRES, SCORES, UNWEIGHTED, best_sql, cell_sql, peptides_plain, sweep_sql, weighted_model
from motifspark.registry.specificity import CONTROL_ID, MATRIX, MINUS, PLUS, rows
from motifspark.registry.training import WEIGHTS
from motifspark.registry.training_sql import PWM
from motifspark.session import materialize

TRIALS, FIT_TRIALS, SPEC_TRIALS = 5000, 1000, 1000
RATES = (-4.0, -2.0, -1.0, -0.5, 0.5, 1.0, 2.0, 4.0)
N = K.MOTIF_LENGTH


def scrambled_sql(name, source, x, keep):
    """CTEs that end in ``name`` with h, the scrambled 32 bits of the expression ``x``."""
    steps = [x, "xor(h, h >> 16)", "(h * 2246822507) % 4294967296", "xor(h, h >> 13)", "(h * 3266489909) % 4294967296", "xor(h, h >> 16)"]
    out = []
    for k, step in enumerate(steps):
        out.append(f"{name}{k if k < len(steps) - 1 else ''} AS (SELECT {keep}, {step} AS h FROM {source})")
        source = f"{name}{k}"
    return ", ".join(out)


def trials_sql(count, n, low, high, seed, ignored=()):
    """``tw`` (trial, pos, w) and ``wl`` (trial, w as a list, cv) of trials 0 to count - 1."""
    w = f"CASE WHEN pos IN ({', '.join(map(str, ignored)) or '0'}) THEN 0.0 ELSE {low} + {high - low} * (h / pow(2.0, 32)) END"
    return f"""{scrambled_sql("seeded", f"(SELECT t AS trial FROM range(0, {count}) r(t))", f"xor(trial::UBIGINT, {seed * GOLDEN & 0xFFFFFFFF}::UBIGINT)", "trial")},
{scrambled_sql("placed", f"seeded, range(1, {n + 1}) p(pos)", f"(h + (pos::UBIGINT * {GOLDEN}) % 4294967296) % 4294967296", "trial, pos")},
tw AS (SELECT trial, pos, {w} AS w FROM placed),
wl AS (SELECT trial, list(w ORDER BY pos) AS w, stddev_pop(w) / avg(w) AS cv FROM tw GROUP BY 1)"""


POINTS = f"""{PWM}, {PRES}, cell AS ({cell_sql("pwm", UNWEIGHTED)}),
pts AS (SELECT peptide_id, any_value(passes) AS passes, any_value(signal) AS signal, list(positive ORDER BY pos) AS gain, list(-suboptimal ORDER BY pos) AS lack,
  sum(positive * {[float(w) for w in WEIGHTS["binding"]]}[pos]) AS bound,
  sum(CASE WHEN pos NOT IN {K.SUPPRESSED_FORBIDDEN} THEN forbidden ELSE 0 END) > 0 AS banned FROM cell GROUP BY 1)"""
SPACES = {"ps": (2 * N, "gain || lack"), "wps": (N + 1, f"[bound * {N}] || lack"), "suboptimal": (N, "lack")}


def scores_sql(method, trials, seed):
    n, vector = SPACES[method]
    return f"""{POINTS}, {trials_sql(trials, n, 0.0, 10.0, seed)},
tsc AS (SELECT trial, peptide_id, passes, CASE WHEN NOT banned THEN list_dot_product({vector}, w) END AS s FROM pts, wl)"""


def point_rows(spark, sf, method):
    """Points of all peptides in one of the search spaces; those with forbidden residues have none, but for binding."""
    p = materialize(peptides_plain(spark, sf), "peptides")
    model = C.ConditionalModel.from_pwm(materialize(T.Training(p).pwm(), "matrices"))
    points, banned = search_points(model, F.col("motif"), method, WEIGHTS["binding"])
    called = F.lit(True) if method == "binding" else ~banned
    return materialize(p.select("peptide_id", "signal", F.when(called, points).alias("points"), F.col("passes").alias("truth")), "search-points")


def searched(method, seed):
    def run(spark, sf):
        best = Search(point_rows(spark, sf, method), SPACES[method][0], 0.0, 10.0, seed).best(TRIALS)
        return best.select("trial", r9(F.col("value")).alias("value"), (F.round("threshold", 6) + 0.0).alias("threshold"), r9(F.col("cv")).alias("cv"))

    return run


for _seed, _method in enumerate(SPACES, start=1):
    register(f"p07_search_{_method}", f"""
WITH {scores_sql(_method, TRIALS, _seed)}, {sweep_sql('tsc', 's', keys='trial')}, {best_sql('accuracy', 'trial')}
SELECT trial, {q9("value")} AS value, round(threshold, 6) + 0.0 AS threshold, {q9("cv")} AS cv FROM best JOIN wl USING (trial)
ORDER BY round(value, 12) DESC, round(cv, 12), trial LIMIT 1""")(searched(_method, _seed))


SHARED_TRIALS = 60


@register("p07_weight_search", f"""
WITH {SCORES}, {trials_sql(SHARED_TRIALS, N, 0, 10, 1)},
tsc AS (SELECT trial, peptide_id, any_value(passes) AS passes, sum(w * (c.positive - c.suboptimal)) AS s FROM cell c JOIN tw USING (pos) GROUP BY 1, 2),
{sweep_sql('tsc', 's', keys='trial')}, {best_sql('accuracy', 'trial')}
SELECT trial, {q9("value")} AS value, round(threshold, 6) + 0.0 AS threshold, {q9("cv")} AS cv FROM best JOIN wl USING (trial)
ORDER BY round(value, 12) DESC, round(cv, 12), trial LIMIT 1""")
def p07(spark, sf):
    """One weight per position for the difference of two weighted matrices."""
    p = materialize(peptides_plain(spark, sf), "peptides")
    model = weighted_model(p)
    m = F.col("motif")
    points = F.array(*[a - b for a, b in zip(model.position_scores(m, "positive"), model.position_scores(m, "suboptimal"))])
    data = materialize(p.select(points.alias("points"), F.col("passes").alias("truth")), "search-points")
    best = Search(data, 15, 0.0, 10.0, seed=1).best(SHARED_TRIALS)
    return best.select("trial", r9(F.col("value")).alias("value"), (F.round("threshold", 6) + 0.0).alias("threshold"), r9(F.col("cv")).alias("cv"))


@register("p07_train_test_records", f"""
WITH RECURSIVE {scores_sql('suboptimal', TRIALS, 4)}, part AS (SELECT trial * 2 + (peptide_id % 5 = 0)::INT AS side, s, passes FROM tsc),
{sweep_sql('part', 's', keys='side')}, {best_sql('accuracy', 'side')},
v AS (SELECT side // 2 AS trial, max(value) FILTER (WHERE side % 2 = 0) AS train, max(value) FILTER (WHERE side % 2 = 1) AS test FROM best GROUP BY 1),
m AS (SELECT *, round((train + test) / 2, 12) AS mean, round(abs(train - test) / abs((train + test) / 2), 12) AS gap FROM v),
rec AS (SELECT -1 AS ord, -1::BIGINT AS trial, 0.0::DOUBLE AS train, 0.0::DOUBLE AS test, -1.0::DOUBLE AS mean, 1e9::DOUBLE AS gap
  UNION ALL SELECT n.ord + 1, n.b.trial, n.b.train, n.b.test, n.b.mean, n.b.gap FROM (
    SELECT r.ord, min_by(m, m.trial) AS b FROM rec r JOIN m ON m.trial > r.trial AND m.mean > r.mean AND m.gap <= r.gap GROUP BY r.ord) n)
SELECT ord, trial, {q9("train")} AS train, {q9("test")} AS test, {q9("gap")} AS gap FROM rec WHERE ord >= 0""")
def p07_records(spark, sf):
    p = point_rows(spark, sf, "suboptimal")
    held, one = F.col("peptide_id") % 5 == 0, F.col("truth").cast("int")
    counts = {"p_train": (~held, one), "n_train": (~held, F.lit(1)), "p_test": (held, one), "n_test": (held, F.lit(1))}
    parts = p.select("points", *[F.when(part, value).otherwise(0).alias(name) for name, (part, value) in counts.items()])
    sides = [Side("train", "p_train", "n_train"), Side("test", "p_test", "n_test")]
    out = Search(parts, N, 0.0, 10.0, seed=4, sides=sides).records(TRIALS)
    return out.select("ord", "trial", r9(F.col("train")).alias("train"), r9(F.col("test")).alias("test"), r9(F.col("gap")).alias("gap"))


@register("p08_binding_weight_search", f"""
WITH {POINTS}, {trials_sql(FIT_TRIALS, N, 0.0, 10.0, 5)}, fit AS (SELECT peptide_id, signal, gain FROM pts WHERE passes),
ext AS (SELECT pos, min(gain[pos]) AS lo, max(gain[pos]) AS hi FROM fit, range(1, {N + 1}) r(pos) GROUP BY 1),
ends AS (SELECT trial, sum(least(w * lo, w * hi)) AS lo, sum(greatest(w * lo, w * hi)) AS hi FROM tw JOIN ext USING (pos) GROUP BY 1),
u AS (SELECT trial, signal, (round(list_dot_product(gain, w), 9) - lo) / (hi - lo) AS u FROM fit, wl JOIN ends USING (trial)),
f AS (SELECT trial, rate, regr_r2(signal, exp(rate * u)) AS value FROM u, (SELECT unnest({list(RATES)}) AS rate) GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY round(value, 9) DESC, abs(rate), rate) AS k FROM f)
SELECT trial, rate::DOUBLE AS rate, round(value, 8) + 0.0 AS value, {q9("cv")} AS cv FROM b JOIN wl USING (trial) WHERE k = 1
ORDER BY round(value, 9) DESC, round(cv, 12), trial LIMIT 1""")
def p08_binding(spark, sf):
    passing = point_rows(spark, sf, "binding").filter("truth")
    best = ExponentialSearch(passing, N, RATES, 0.0, 10.0, seed=5, value="signal").best(FIT_TRIALS)
    return best.select("trial", "rate", (F.round("value", 8) + 0.0).alias("value"), r9(F.col("cv")).alias("cv"))


# ---- specificity ---------------------------------------------------------------------------------------------


SPEC = f"""{MATRIX}, {trials_sql(SPEC_TRIALS, N, 0, 4, 2, (15,))},
sp AS (SELECT peptide_id, any_value(log2fc) AS log2fc, list(value ORDER BY pos) AS v FROM (SELECT *, unnest(range(1, 16)) AS pos FROM srow WHERE log2fc IS NOT NULL) r
  JOIN sspec s USING (pos) WHERE s.aa = translate(substr(r.seq, r.pos, 1), 'BJO', 'STY') GROUP BY 1),
tsc AS (SELECT trial, peptide_id, log2fc, list_dot_product(v, w) AS s FROM sp, wl)"""


def specificity_points(spark, sf):
    r = rows(spark, sf)
    m = X.specificity_matrix(X.training_rows(r, CONTROL_ID), standardize=True)
    tables = X.matrix_tables(m)
    t = S.plain(F.col("seq"))
    points = F.array(*[S.letter_table(v, 0.0)[S.letter_index(S.residue_at(t, i))] for i, v in enumerate(tables, start=1)])
    known = r.filter("log2fc is not null")
    return materialize(known.select(points.alias("points"), F.col("log2fc").alias("value")), "specificity-points")


SHARES = {"upper": "upper", "lower": "lower", "mean": "(lower + upper * ratio) / (1 + ratio)"}


def spec_sql(metric, side):
    midpoint = metric != "f1"
    return f"""
WITH {SPEC}, sd AS (SELECT trial * 2 + low AS side, CASE low WHEN 0 THEN s ELSE -s END AS s, CASE low WHEN 0 THEN log2fc >= {PLUS} ELSE log2fc <= {MINUS} END AS t FROM tsc, range(2) l(low)),
{sweep_sql('sd', 's', 't', 'side')}, {best_sql(metric, 'side', midpoint)},
p AS (SELECT side // 2 AS trial, max(value) FILTER (WHERE side % 2 = 0) AS upper, max(value) FILTER (WHERE side % 2 = 1) AS lower,
  max(threshold) FILTER (WHERE side % 2 = 0) AS upper_t, -max(threshold) FILTER (WHERE side % 2 = 1) AS lower_t,
  max(tp + fn) FILTER (WHERE side % 2 = 0) / max(tp + fn) FILTER (WHERE side % 2 = 1) AS ratio FROM best GROUP BY 1),
q AS (SELECT trial, upper_t, lower_t, {SHARES[side]} AS value FROM p)
SELECT trial, {q9("value")} AS value, {", ".join(f"round({s}_t, 5) + 0.0 AS threshold_{s}" for s in ("upper", "lower") if side in (s, "mean"))}, {q9("cv")} AS cv
FROM q JOIN wl USING (trial) ORDER BY round(value, 12) DESC, round(cv, 12), trial LIMIT 1"""


def spec_search(metric, side):
    def run(spark, sf):
        best = X.search_weights(specificity_points(spark, sf), metric, side, SPEC_TRIALS, N, PLUS, MINUS, seed=2, forced={15: 0.0})
        cuts = [c for c in best.columns if c.startswith("threshold")]
        return best.select("trial", r9(F.col("value")).alias("value"), *[(F.round(c, 5) + 0.0).alias(c) for c in cuts], r9(F.col("cv")).alias("cv"))

    return run


for _metric in ("accuracy", "mcc", "f1"):
    for _side in SHARES:
        register(f"c14_search_{_metric}_{_side}", spec_sql(_metric, _side))(spec_search(_metric, _side))


@register("c14_specificity_weight_search", spec_sql("f1", "upper").replace("threshold_upper", "threshold"))
def c14(spark, sf):
    return spec_search("f1", "upper")(spark, sf).withColumnRenamed("threshold_upper", "threshold")


@register("c14_specificity_weight_search_r2", f"""
WITH {SPEC}, f AS (SELECT trial, regr_r2(log2fc, s) AS value FROM tsc GROUP BY 1)
SELECT trial, {q9("value")} AS value, {q9("cv")} AS cv FROM f JOIN wl USING (trial) ORDER BY round(value, 12) DESC, round(cv, 12), trial LIMIT 1""")
def c14_r2(spark, sf):
    best = best_for_r2(specificity_points(spark, sf), SPEC_TRIALS, 15, 0.0, 4.0, seed=2, forced={15: 0.0})
    return best.select("trial", r9(F.col("value")).alias("value"), r9(F.col("cv")).alias("cv"))
