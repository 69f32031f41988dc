"""Program 1: from measured cells to a saved model."""

import hashlib
import inspect
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifspark import constants as K
from motifspark.functions import sequence as S
from motifspark.operators import assay as A
from motifspark.operators import conditional as C
from motifspark.operators import specificity as X
from motifspark.operators import thresholds as H
from motifspark.operators import training as T
from motifspark.operators.search import ExponentialSearch, Search
from motifspark.session import materialize, tune
from motifspark.sources import sinks

KINDS = ("binding", "positive", "suboptimal", "forbidden")
#: Rates of the exponential fits, over the range of the scores.
FIT_RATES = (-4.0, -2.0, -1.0, -0.5, 0.5, 1.0, 2.0, 4.0)


@dataclass
class AssaySettings:
    baits: tuple
    control_bait: str
    control_peptides: tuple
    control_multiplier: float = 5
    index_threshold: float = 1.4
    positive_multiple: float = 0.05
    within: bool = True
    between: bool = True


def process_assay(cells, s):
    """Standardized cells, and per peptide: calls, fold changes, pass flag, best signal."""
    calls = A.positive_calls(cells, s.control_peptides, s.positive_multiple, s.index_threshold)
    if s.within:
        cells = A.standardize_within(cells, s.control_peptides, s.control_bait)
    if s.between:
        cells = A.standardize_between(cells, s.control_peptides, s.control_bait).drop("bas", "multiplier").withColumnRenamed("standardized", "bas")
    cells = materialize(cells, "standardized-cells")
    calls = materialize(calls, "calls")
    args = (cells, calls, list(s.baits), s.control_bait, s.control_multiplier)
    flags = A.passes(*args).select("dataset", "peptide_id", "one_passes")
    top = A.max_bait_signal(cells, list(s.baits), s.control_bait)
    return {"cells": cells, "calls": calls, "log2fc": A.conditional_log2fc(*args),
            "peptides": flags.join(top, ["dataset", "peptide_id"])}


def default_weights():
    w = list(K.POSITION_WEIGHTS)
    return {"binding": w, "positive": w, "suboptimal": w, "forbidden": [0.0 if i in K.SUPPRESSED_FORBIDDEN else 1.0 for i in range(1, K.MOTIF_LENGTH + 1)]}


def train_conditional(peptides: DataFrame, weights=None, trials=0, seed=1, method="ps", test_share=0.2, retrain=True, **params):
    """Split, train, weight, set coefficients and threshold. Returns (model, pwm, weights, report).

    With ``trials`` the position weights come from a random search on the training rows.
    """
    tune(peptides.sparkSession)
    p = T.stratified_split(peptides, test_share, seed).withColumn("motif", S.plain(F.col("seq")))
    p = materialize(p, "split-peptides")
    train = p.filter(~F.col("is_test"))
    matrices = materialize(T.Training(train, **params).pwm(), "matrices")
    weights = dict(weights or default_weights())
    if trials:
        weights = search_weights(train, C.ConditionalModel.from_pwm(matrices), weights, trials, seed, method)
    if retrain and test_share:
        matrices = materialize(T.Training(p, **params).pwm(), "matrices")
    model = C.ConditionalModel.from_pwm(T.weight_matrices(matrices, weights), KINDS, method=method)
    raw = materialize(model.score(p), "scored-peptides")
    model.coefficients = {r["kind"]: (r["a"], r["b"]) for r in C.minmax_coefficients(raw).collect()}
    scored = materialize(model.score(p), "standardized-peptides")
    best = H.best_cut(scored, "total", "passes").first()
    if best is None:
        raise ValueError("no threshold separates the training rows: there are none that can be scored")
    model.threshold = best["threshold"]
    report = H.confusion(model.score(p), "call", "passes")
    return model, matrices, weights, report


def model_key(peptides, settings):
    """Digest of the training rows and of all settings, given or by default."""
    names = inspect.signature(train_conditional).parameters
    known = {k: p.default for k, p in names.items() if p.default is not inspect.Parameter.empty} | settings
    text = json.dumps([sinks.table_digest(peptides), known], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()


def train_or_load(folder, peptides, **settings):
    """(model, whether it was there): the stored model of equal rows and settings, else one trained, saved and listed now."""
    spark, key = peptides.sparkSession, model_key(peptides, settings)
    path = sinks.published(spark, folder, key)
    if path is not None:
        return load(spark, path), True

    def write(path):
        model, matrices, weights, _ = train_conditional(peptides, **settings)
        save(path, matrices, weights, model)

    return load(spark, sinks.publish(spark, folder, key, write)), False


def search_points(unweighted, seq, method, binding):
    """(points, banned): the columns that a method's total is a weighted sum of, and whether a peptide is never called.

    ``ps``: every position of the positive and of the suboptimal matrix; ``wps``: the weighted binding sum, times the motif
    length so that it weighs as much as the positions do, and the suboptimal positions; ``suboptimal``: these alone;
    ``binding``: the positive positions.
    """
    lack = [-x for x in unweighted.position_scores(seq, "suboptimal")]
    gain = unweighted.position_scores(seq, "positive")
    whole = sum((float(w) * x for w, x in zip(binding, gain)), F.lit(0.0))
    points = {"ps": gain + lack, "wps": [K.MOTIF_LENGTH * whole] + lack, "suboptimal": lack, "binding": gain}[method]
    return F.array(*points), F.coalesce(unweighted.total_score(seq, unweighted.disqualifying, unweighted.suppressed) > 0, F.lit(False))


def search_weights(train, unweighted, weights, trials, seed, method="ps"):
    """Weights of a method by random search; disqualified peptides count but are never called.

    Binding weights come first, by the exponential fit of the passing peptides' signals, if there are signals.
    """
    m, n = F.col("motif"), K.MOTIF_LENGTH
    out = dict(weights)
    if "signal" in train.columns:
        points, _ = search_points(unweighted, m, "binding", out["binding"])
        passing = materialize(train.filter("passes").select(points.alias("points"), "signal"), "binding-points")
        fit = ExponentialSearch(passing, n, FIT_RATES, 0.0, 10.0, seed, value="signal").best(trials).first()
        if fit is not None:
            out["binding"] = list(fit["weights"])
    points, banned = search_points(unweighted, m, method, out["binding"])
    rows = materialize(train.select(F.when(~banned, points).alias("points"), F.col("passes").alias("truth")), "search-points")
    size = {"ps": 2 * n, "wps": n + 1, "suboptimal": n}[method]
    best = Search(rows, size, 0.0, 10.0, seed).best(trials).first()
    if best is None:
        return out
    w = list(best["weights"])
    if method == "ps":
        out["positive"], out["suboptimal"] = w[:n], w[n:]
    elif method == "wps":
        out["binding"] = out["positive"] = [n * w[0] * b for b in out["binding"]]
        out["suboptimal"] = w[1:]
    else:
        out["positive"], out["suboptimal"] = [0.0] * n, w
    return out


def train_specificity(rows, control_id, share=0.3, alpha=0.2, standardize=True, weights=None):
    """(matrix, lookup tables, scored rows) from rows with seq, log2fc, max_signal and one_passes."""
    used = X.training_rows(rows, control_id, share)
    matrix = materialize(X.specificity_matrix(used, alpha, standardize), "specificity-matrix")
    tables = X.matrix_tables(matrix, weights)
    return matrix, tables, rows.withColumn("score", X.specificity_score(S.plain(F.col("seq")), tables))


def save(path, matrices, weights, model):
    params = {"threshold": model.threshold, "method": model.method, "disqualifying": model.disqualifying, "mode": model.mode,
              "suppressed": ",".join(map(str, model.suppressed))}
    for kind, (a, b) in model.coefficients.items():
        params[f"{kind}_a"], params[f"{kind}_b"] = a, b
    return sinks.save_model(path, matrices, weights, params)


def load(spark, path):
    """The model as it was saved, with its method, suppressed positions and disqualifying matrix."""
    pwm, weights, params = sinks.load_model(spark, path)
    coef = {k: (params[f"{k}_a"], params[f"{k}_b"]) for k in ("total", "positive", "suboptimal", "binding") if f"{k}_a" in params}
    return C.ConditionalModel.from_pwm(
        T.weight_matrices(pwm, weights), KINDS, method=params["method"], threshold=params["threshold"], coefficients=coef,
        disqualifying=params["disqualifying"], mode=params["mode"],
        suppressed=tuple(int(x) for x in params["suppressed"].split(",") if x))
