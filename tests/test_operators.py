"""Hand-computed cases, brute-force comparisons and skewed inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifspark import constants as K
from motifspark.functions import pvalues, sequence as S
from motifspark.functions.classical import classical_score, core_matrix
from motifspark.operators import (assay as A, assembly as D, conditional as C, consolidate as J, homology as M, scan,
                                  search, specificity as X, spots as P, thresholds as H, topology as O, training as T)
from motifspark.operators.running import average_ranks, finite_descending, running_totals
from motifspark.sources import readers, sinks
from motifspark.session import scratch_path

RNG = random.Random(7)


def words(n, length=15, letters=K.RESIDUES):
    return ["".join(RNG.choice(letters) for _ in range(length)) for _ in range(n)]


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


# ---- running totals and sweeps -------------------------------------------------------------------------------

@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_with_a_value_shared_by_a_third(spark, descending):
    rows = [(RNG.choice("ab"), 5.0 if RNG.random() < 0.34 else round(RNG.random() * 10, 2), RNG.randint(0, 3)) for _ in range(3000)]
    got = running_totals(spark.createDataFrame(rows, "k string, v double, n long"), ["k"], "v", {"s": "n"}, descending).collect()
    for r in got:
        expected = sum(n for k, v, n in rows if k == r["k"] and (v >= r["v"] if descending else v <= r["v"]))
        assert r["cum_s"] == expected
    assert len(got) == len({(k, v) for k, v, _ in rows})


def test_average_ranks_equal_brute_force(spark):
    values = [RNG.choice([1.0, 2.0, 2.0, 3.5, -1.0]) for _ in range(200)]
    got = {r["v"]: r["avg_rank"] for r in average_ranks(spark.createDataFrame([("x", v) for v in values], "k string, v double"), ["k"], "v").collect()}
    for v in set(values):
        below, same = sum(x < v for x in values), sum(x == v for x in values)
        assert got[v] == below + (same + 1) / 2


def test_finite_descending_drops_nan_and_infinity(spark):
    rows = [("u", i, v) for i, v in enumerate([3.0, float("nan"), 5.0, float("inf"), 3.0, None])]
    got = finite_descending(spark.createDataFrame(rows, "k string, i long, v double"), ["k"], "v", "i").collect()
    assert sorted((r["place"], r["i"]) for r in got) == [(1, 2), (2, 0), (3, 4)]


@pytest.mark.parametrize("metric", ["accuracy", "mcc", "f1"])
def test_best_cut_equals_brute_force(spark, metric):
    rows = [(round(RNG.gauss(t, 1.5), 1), bool(t)) for t in (RNG.randint(0, 1) for _ in range(150))]
    got = H.best_cut(spark.createDataFrame(rows, "s double, t boolean"), "s", "t", metric).first()
    s = sorted(r[0] for r in rows)
    cuts = [(a + b) / 2 for a, b in zip(s, s[1:])]

    def value(c):
        tp = sum(v >= c and t for v, t in rows)
        fp = sum(v >= c and not t for v, t in rows)
        fn, tn = sum(t for _, t in rows) - tp, sum(not t for _, t in rows) - fp
        if metric == "accuracy":
            return (tp + tn) / len(rows)
        if metric == "f1":
            return 2 * tp / (2 * tp + fp + fn)
        d = math.sqrt(float(tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
        return (tp * tn - fp * fn) / d if d else 0.0

    best = max(map(value, cuts))
    assert got["value"] == pytest.approx(best)
    assert value(got["threshold"]) == pytest.approx(best)


def test_rows_without_a_score_are_never_positive(spark):
    rows = [(None, True), (1.0, True), (0.0, False), (None, False)]
    top = {r["score"]: r for r in H.sweep(spark.createDataFrame(rows, "s double, t boolean"), "s", "t").collect()}
    assert (top[1.0]["tp"], top[1.0]["fp"], top[1.0]["fn"], top[1.0]["tn"]) == (1, 0, 1, 2)
    assert top[0.0]["lowest"] and not top[1.0]["lowest"]


def test_rates_count_scores_on_a_threshold(spark):
    rows = [(i / 9, i > 4) for i in range(10)]
    got = H.rates(spark.createDataFrame(rows, "s double, t boolean"), "s", "t", n=10).orderBy("i").collect()
    for r in got:
        up = [t for s, t in rows if s >= r["threshold"]]
        assert r["ppv"] == pytest.approx(sum(up) / len(up))


def test_rate_pair_none_or_least_mean(spark):
    rows = spark.createDataFrame([(0, 0.1, 0.9, 0.1), (1, 0.2, 0.5, 0.2)], "i int, threshold double, fdr double, for_rate double")
    assert H.rate_pair(rows).count() == 0
    assert H.rate_pair(rows, or_none=False).first()["i"] == 1


# ---- sequences and scan --------------------------------------------------------------------------------------

def test_windows_and_rules(spark):
    seq = "".join(words(1, 120)) + "FADAKKLU"
    df = one(spark, protein_id=1, seq=seq)
    assert scan.all_windows(df).count() == len(seq) + 8 - 15 + 1
    text = "GGGGGG" + seq + "GG"
    every = [text[i:i + 15] for i in range(len(text) - 14)]
    keep = [w.replace("U", "C") for w in every if all(w[p - 1] in a for p, a in K.POSITION_RULES.items()) and "X" not in w]
    got = [r["motif"] for r in scan.candidate_windows(df).orderBy("ord").collect()]
    assert got == keep


@pytest.mark.parametrize("seq, valid", [("A" * 15, True), ("A" * 14, False), ("A" * 14 + "*", True), ("AA*" + "A" * 20, False), (None, False)])
def test_sequence_validity(spark, seq, valid):
    df = spark.createDataFrame([(1, seq)], "protein_id int, seq string")
    assert (scan.valid_sequences(df).count() == 1) == valid


def test_every_protein_has_exactly_k_rows(spark):
    df = spark.createDataFrame([(1, "A" * 40), (2, "AC"), (3, None)], "protein_id int, seq string")
    got = scan.classical_hits(df).collect()
    assert len(got) == 9
    assert all(r["motif"] == "" and r["score"] == float("inf") for r in got if r["protein_id"] == 2)
    assert all(r["score"] is None for r in got if r["protein_id"] == 3)


def test_windows_dealt_by_protein_move_no_window(spark):
    df = spark.createDataFrame([(i % 7, w) for i, w in enumerate(words(20, 60))], "protein_id int, seq string")
    dealt = scan.all_windows(df, together=("protein_id",))
    found = dealt.groupBy("protein_id").agg(F.min("motif").alias("least"), F.countDistinct("motif").alias("kinds"))
    assert str(found._jdf.queryExecution().executedPlan()).count("Exchange") == 1
    plain = scan.all_windows(df).groupBy("protein_id").agg(F.min("motif").alias("least"), F.countDistinct("motif").alias("kinds"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))


def test_classical_hits_equal_scoring_every_window(spark, monkeypatch):
    monkeypatch.setattr(scan, "TOGETHER", 200)
    seqs = words(30, 90, K.RESIDUES + "UXBJO") + ["X" * 30, "A" * 15, "A" * 10 + "\n" + "DEFYDE" * 6, "DEDEDEFYDEW" * 3 + "*"]
    df = spark.createDataFrame([(i // 2, s) for i, s in enumerate(seqs)], "protein_id int, seq string")
    got = scan.classical_hits(df).filter("motif <> ''")
    scored = scan.all_windows(df).withColumn("score", classical_score(F.col("motif")))
    want = scan.top_k(scored, [F.round("score", 9), F.col("pos")], 3)
    rows = [sorted((r["protein_id"], r["rank"], r["score"]) for r in x.collect()) for x in (got, want)]
    assert sorted(set(rows[0])) == rows[1]
    own = [r for r in got.filter("protein_id = 16").collect()]  # a line end inside, and a stop behind
    assert own and not any("\n" in r["motif"] or "*" in r["motif"] for r in own)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan
    with pytest.raises(Exception, match="(?i)index"):
        scan.classical_hits(one(spark, protein_id=1, seq="DEDEDEFYDEWaaaaa" * 2)).collect()


def test_masking_goes_from_last_to_first(spark):
    df = spark.createDataFrame([(1, "ABCDEFGHIJ"), (2, "KLM")], "protein_id int, seq string")
    tm = spark.createDataFrame([(1, 2, 3), (1, 6, 8)], "protein_id int, begin int, `end` int")
    got = {r["protein_id"]: r["seq"] for r in scan.mask_transmembrane(df, tm).collect()}
    assert got == {1: "AXDEXIJ", 2: "KLM"}


def test_ordinals():
    assert [S.ordinal(i) for i in (1, 2, 3, 4, 11)] == ["1st", "2nd", "3rd", "4th", "11st"]


def test_length_check_raises(spark):
    with pytest.raises(Exception, match="unexpected sequence length"):
        one(spark, seq="ABC").select(S.check_length(F.col("seq"))).collect()


def test_feature_encoding_shape_and_error(spark):
    row = one(spark, seq="DERHKSTNQCGPAVI").select(S.encode(F.col("seq")).alias("f"), S.encode(F.col("seq"), stacked=True).alias("s")).first()
    assert len(row["f"]) == 240 and len(row["s"]) == 16
    assert max(abs(v) for v in row["f"]) <= 1
    with pytest.raises(Exception, match="without chemical scale"):
        one(spark, seq="XX").select(S.encode(F.col("seq"))).collect()


def test_feature_encoding_equals_a_plain_loop(spark):
    scales = list(S.residue_scales().values())
    seqs = [*words(20, 15, K.RESIDUES_PHOSPHO), "ACD", None, "W"]
    df = spark.createDataFrame([(s,) for s in seqs], "seq string").coalesce(1)
    flat, stacked = (df.select("seq", S.encode(F.col("seq"), stacked=k).alias("f")) for k in (False, True))
    assert "transform" not in flat._jdf.queryExecution().optimizedPlan().toString()
    for r in flat.collect():
        assert r["f"] == (None if r["seq"] is None else [v[a] for v in scales for a in r["seq"]])
    for r in stacked.collect():
        assert r["f"] == [None if r["seq"] is None else [v[a] for a in r["seq"]] for v in scales]


def test_classical_score_by_hand(spark):
    m = core_matrix()
    seq = "DDEEKSFFYDEAGGG"
    charge = -4 + 1 - 0.5
    points = 0.5 if charge <= -3 else 1
    want = points + sum(m[p][seq[p - 1]] for p in range(7, 14))
    got = one(spark, m=seq).select(classical_score(F.col("m")).alias("s")).first()["s"]
    assert got == pytest.approx(want)
    assert one(spark, m="AAAAAAAUAAAAAAA").select(classical_score(F.col("m")).alias("s")).first()["s"] == float("inf")
    assert one(spark, m="AAA").select(classical_score(F.col("m")).alias("s")).first()["s"] is None


# ---- training and conditional scores -------------------------------------------------------------------------

@pytest.fixture(scope="module")
def peptides(spark):
    rows = []
    for i, s in enumerate(words(900, letters=K.RESIDUES_PHOSPHO)):
        signal = 10.0 if i % 3 == 0 else round(RNG.random() * 20 + 10 * (s[7] in "FY"), 1)
        rows.append((i, s, signal, signal > 12))
    return spark.createDataFrame(rows, "peptide_id long, seq string, signal double, passes boolean").cache()


def test_rank_biserial_matches_pairs_and_is_antisymmetric(spark, peptides):
    rows = [r for r in peptides.collect() if r["passes"]]
    x = T.Training(peptides).contrasts.filter("rule_class = 'All' and pos = 8").collect()
    for r in x:
        a = [p["signal"] for p in rows if p["seq"][7] == r["aa"]]
        b = [p["signal"] for p in rows if p["seq"][7] != r["aa"]]
        if a and b:
            want = np.mean([np.sign(u - v) for u in a for v in b])
            assert r["r_alone"] == pytest.approx(want)
            assert -1 <= r["r_alone"] <= 1


def test_statistics_equal_counting_by_rule(spark, monkeypatch):
    monkeypatch.setattr(T, "TOGETHER", 37)
    signals = [0.0, -1.0, 2.5, *(round(RNG.random() * 9, 1) for _ in range(20))]
    rows = [(w, RNG.choice(signals) if k % 9 else None, RNG.random() < 0.5) for k, w in enumerate(words(300, letters=K.RESIDUES_PHOSPHO))]
    rows += [("W" * 15, float("nan"), True)]
    for ignore_failed in (True, False):
        want = {}
        used = [(s, max(v or 0.0, 0.0), p) for s, v, p in rows if v is None or v == v]
        for c, pos in [("All", 0)] + [(c, i) for c in K.CHEMICAL_CLASSES for i in range(1, 16)]:
            mine = [r for r in used if not pos or r[0][pos - 1] in K.CHEMICAL_CLASSES[c]]
            ranked = [v for _, v, p in mine if p or not ignore_failed]
            for s, v, p in mine:
                ties = ranked.count(v)
                rank = sum(x < v for x in ranked) + (ties + 1) / 2
                for i, aa in enumerate(s, start=1):
                    n = want.setdefault((c, pos, i, aa), [0, 0, 0, None, None])
                    n[0 if p else 1] += 1
                    if p or not ignore_failed:
                        n[2:] = [n[2] + 1, (n[3] or 0) + rank, (n[4] or 0) + ties * ties - 1]
        df = spark.createDataFrame(rows, "seq string, signal double, passes boolean")
        got = {tuple(r)[:4]: list(tuple(r)[4:]) for r in T.statistics(df, ignore_failed).collect()}
        assert got == want


def test_the_ranks_of_a_signal_that_most_rows_share_hold_no_rows():
    cells = T.RankedCells()
    letters = np.zeros((500, 15), np.int64)
    for _ in range(40):
        cells.add(np.full(500, 3.0), letters, np.ones(500, bool))
    assert cells.open == 3.0 and not cells.count.any()
    cells.close()
    at = (cells.rules - 1) * T.CELLS
    assert cells.count[at] == 20_000 and cells.rank_sum[at] == 20_000 * 10_000.5 and cells.tie_sum[at] == 20_000 * (20_000**2 - 1)


def test_yule_q_is_antisymmetric(spark):
    df = one(spark, a=3, b=5, p=10, f=20)
    c = F.col
    q, r = df.select(T.yule_q(c("a"), c("b"), c("p"), c("f")).alias("q"), T.yule_q(c("b"), c("a"), c("f"), c("p")).alias("r")).first()
    assert q == pytest.approx(-r) and q == pytest.approx((3 * 15 - 7 * 5) / (3 * 15 + 7 * 5))


def test_array_scores_equal_join_scores(spark, peptides):
    pwm = T.Training(peptides, min_members=10).pwm()
    plain = peptides.withColumn("seq", S.plain(F.col("seq")))
    model = C.ConditionalModel.from_pwm(pwm)
    kinds = ("positive", "suboptimal", "forbidden")
    fast = plain.select("peptide_id", *[model.total_score(F.col("seq"), k).alias(f"f_{k}") for k in kinds])
    both = fast.join(C.score_by_join(plain, pwm), "peptide_id").collect()
    assert len(both) == 900
    for r in both:
        for k in kinds:
            assert r[f"f_{k}"] == pytest.approx(r[k])


def test_scores_of_a_batch_are_looked_up_together(spark):
    rng = np.random.default_rng(5)
    model = C.ConditionalModel({k: rng.normal(size=(9, 15, 20, 15)) for k in ("binding", "positive", "suboptimal", "forbidden")})
    rows = words(30) + [None, "X" + "A" * 14, "A" * 15, "AC" * 10, "é" + "A" * 14]
    scored = model.score(spark.createDataFrame([(i, m) for i, m in enumerate(rows)], "i int, motif string"))
    assert scored._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1

    def total(m, kind, suppress=()):
        left, right = model.sides(kind)
        o = [K.RESIDUES.index(aa) for aa in m[:15]]
        return sum(left[j][o[max(j - 1, 0)], o[j]] + right[j][o[min(j + 1, 14)], o[j]] for j in range(15) if j + 1 not in suppress)

    for r in scored.collect():
        m = r["motif"]
        if m is None or set(m) - set(K.RESIDUES):
            assert not r["call"] and all(r[k] is None for k in ("binding", "positive", "suboptimal", "forbidden", "total"))
            continue
        banned = total(m, "forbidden", model.suppressed)
        assert r["forbidden"] == pytest.approx(banned) and r["binding"] == pytest.approx(total(m, "binding"))
        want = total(m, "positive") - total(m, "suboptimal")
        assert (r["total"] is None) if banned > 0 else r["total"] == pytest.approx(want)
        assert r["call"] == (banned <= 0 and want >= 0)
    with pytest.raises(Exception, match="fewer than 15 residues"):
        model.score(one(spark, motif="ACD")).collect()


def test_small_rules_fall_back_to_all_rows(spark, peptides):
    t = T.Training(peptides, min_members=10_000)
    pwm = t.pwm()
    assert pwm.select("rule_class", "rule_pos").distinct().count() == 135
    spread = pwm.groupBy("pos", "aa").agg(F.countDistinct("positive").alias("n")).agg(F.max("n")).first()[0]
    assert spread == 1


def test_alpha_below_one_keeps_fewer_cells(spark, peptides):
    loose = T.Training(peptides).baseline.filter("positive <> 0").count()
    strict = T.Training(peptides, alpha=0.01).baseline.filter("positive <> 0").count()
    assert strict < loose


def test_unknown_residue_is_an_error_only_if_asked(spark, peptides):
    model = C.ConditionalModel.from_pwm(T.Training(peptides).pwm())
    bad = one(spark, motif="A" * 14 + "X")
    assert model.score(bad).first()["total"] is None
    with pytest.raises(Exception, match="without matrix row"):
        model.score(bad, strict=True).collect()


def test_stratified_split_is_exact_and_stable(spark, peptides):
    a = T.stratified_split(peptides).select("peptide_id", "passes", "is_test").collect()
    for flag in (True, False):
        n = [r for r in a if r["passes"] == flag]
        assert sum(r["is_test"] for r in n) == math.ceil(len(n) * 0.2)
    again = T.stratified_split(peptides.repartition(3)).select("peptide_id", "passes", "is_test").collect()
    assert sorted(a) == sorted(again)


def test_multivariate_regression_matches_least_squares(spark, peptides):
    t = T.Training(peptides)
    cells = t.cells(t.baseline)
    got = T.rule_regressions(peptides, cells).filter("rule_class = 'All'").first()
    table = {(r["pos"], r["aa"]): r["positive"] for r in cells.filter("rule_class = 'All'").collect()}
    rows = [r for r in peptides.collect() if r["passes"]]
    x = np.array([[table[i + 1, a] for i, a in enumerate(r["seq"])] for r in rows])
    y = np.log([r["signal"] + 1 for r in rows])
    design = np.c_[np.ones(len(x)), x]
    fit = design @ np.linalg.lstsq(design, y, rcond=None)[0]
    assert got["multi_r2"] == pytest.approx(1 - ((y - fit) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-6)


def test_exact_forbidden_finds_a_residue_that_never_passes(spark):
    rows = [("A" * 15, True)] * 30 + [("W" + "A" * 14, False)] * 12 + [("A" * 15, False)] * 10
    got = T.exact_forbidden(spark.createDataFrame(rows, "seq string, passes boolean")).filter("forbidden").collect()
    assert {(r["pos"], r["aa"]) for r in got} == {(1, "W")}


def test_weight_search_is_exact(spark):
    rows = [([RNG.gauss(0, 1) for _ in range(4)],) for _ in range(400)]
    rows = [(p[0], p[0][0] + 0.5 * p[0][2] + RNG.gauss(0, 0.5) > 0) for p in rows]
    df = spark.createDataFrame(rows, "points array<double>, truth boolean")
    for metric in ("accuracy", "f1", "mcc"):
        got = search.Search(df, 4, -1.0, 1.0, seed=3, metric=metric).best(80, bins=(8, 32)).first()
        w = search.trial_weights(range(80), 4, -1.0, 1.0, 3)
        best = -2.0
        for t in range(80):
            s = np.round(np.array([p for p, _ in rows]) @ w[t], 9)
            truth = np.array([x for _, x in rows])
            for c in np.unique(s) if metric == "f1" else np.unique(s)[1:]:
                up = s >= c
                tp, fp, fn, tn = (up & truth).sum(), (up & ~truth).sum(), (~up & truth).sum(), (~up & ~truth).sum()
                d = math.sqrt(float(tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
                v = {"accuracy": (tp + tn) / 400, "f1": 2 * tp / (2 * tp + fp + fn), "mcc": (tp * tn - fp * fn) / d if d else 0.0}[metric]
                best = max(best, v)
        assert got["value"] == pytest.approx(best)


def best_metric(s, truth, counted, metric, midpoint=True):
    """Best metric over all cuts of the scored rows, by trying each; `counted` rows without a score are never called."""
    best = -2.0
    values = np.unique(s)
    for k, c in enumerate(values):
        if midpoint and k == 0 and (s == c).sum() < 2:
            continue
        up = s >= c
        tp, fp = (up & truth).sum(), (up & ~truth).sum()
        fn, tn = counted[0] - tp, counted[1] - fp
        d = math.sqrt(float(tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
        best = max(best, {"accuracy": (tp + tn) / sum(counted), "f1": 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0, "mcc": (tp * tn - fp * fn) / d if d else 0.0}[metric])
    return best


def search_rows(n, places, seed, banned=0.1):
    rng = random.Random(seed)
    rows = [([round(rng.gauss(0, 1), 1) for _ in range(places)], rng.gauss(0, 1)) for _ in range(n)]
    rows = [(p if rng.random() > banned else None, sum(p[::2]) + e) for p, e in rows]
    return rows + rows[: n // 4]


def test_two_sided_search_is_exact_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "ROWS", 100)
    monkeypatch.setattr(search, "GROUP", 40)
    monkeypatch.setattr(search, "CHUNK", 16)
    rows = [(p, v) for p, v in search_rows(300, 5, 5, banned=0.0)]
    frame = spark.createDataFrame(rows, "points array<double>, value double")
    points, value = np.array([p for p, _ in rows]), np.array([v for _, v in rows])
    w = search.trial_weights(range(90), 5, 0.0, 4.0, 7, {5: 0.0})
    n = [(value >= 1).sum(), (value <= -1).sum()]
    for metric in ("accuracy", "mcc", "f1"):
        up = [best_metric(np.round(points @ x, 9), value >= 1, (n[0], len(rows) - n[0]), metric, metric != "f1") for x in w]
        down = [best_metric(-np.round(points @ x, 9), value <= -1, (n[1], len(rows) - n[1]), metric, metric != "f1") for x in w]
        mean = [(a * n[0] + b * n[1]) / sum(n) for a, b in zip(up, down)]
        for side, want in (("upper", up), ("lower", down), ("mean", mean)):
            got = X.search_weights(frame, metric, side, 90, 5, seed=7, forced={5: 0.0}).first()
            assert got["value"] == pytest.approx(max(want)) and want[got["trial"]] == pytest.approx(max(want)), (metric, side)
            assert got["weights"] == pytest.approx(list(w[got["trial"]]))


def test_records_equal_a_plain_loop(spark):
    """Ten thousand trials, accepted one after the other if the mean rises and the gap does not."""
    trials = 10_000
    rows = search_rows(60, 3, 9)
    test = [k % 3 == 0 for k in range(len(rows))]
    frame = spark.createDataFrame([(p, int(v > 0 and not t), int(not t), int(v > 0 and t), int(t)) for (p, v), t in zip(rows, test)],
                                  "points array<double>, p_train int, n_train int, p_test int, n_test int")
    sides = [search.Side("train", "p_train", "n_train"), search.Side("test", "p_test", "n_test")]
    got = search.Search(frame, 3, 0.0, 10.0, seed=2, sides=sides).records(trials, bins=64).orderBy("ord").collect()
    w = search.trial_weights(range(trials), 3, 0.0, 10.0, 2)
    parts = []
    for part in (False, True):
        all_ = [v > 0 for (p, v), t in zip(rows, test) if t == part]
        known = [(p, v > 0) for (p, v), t in zip(rows, test) if t == part and p is not None]
        parts.append((np.array([p for p, _ in known]), np.array([x for _, x in known]), (sum(all_), len(all_) - sum(all_))))
    want, top, gap = [], -1.0, np.inf
    for k in range(trials):
        a, b = (best_metric(np.round(p @ w[k], 9), t, c, "accuracy") for p, t, c in parts)
        mean, apart = round((a + b) / 2, 12), round(abs(a - b) / abs((a + b) / 2), 12)
        if mean > top and apart <= gap:
            top, gap = mean, apart
            want.append((k, pytest.approx(a), pytest.approx(b)))
    assert [(r["trial"], r["train"], r["test"]) for r in got] == want and len(want) > 2


def test_exponential_search_is_exact(spark):
    rng = random.Random(4)
    rows = [[round(rng.gauss(0, 1), 2) for _ in range(4)] for _ in range(300)]
    rows = [(p, math.exp(0.8 * (p[0] + p[1])) + rng.gauss(0, 1)) for p in rows] + [(None, 5.0)]
    frame = spark.createDataFrame(rows, "points array<double>, value double")
    rates = (-2.0, -0.5, 0.5, 2.0)
    points, value = np.array([p for p, _ in rows if p]), np.array([v for p, v in rows if p])
    w = search.trial_weights(range(200), 4, 0.0, 10.0, 3)
    lo, hi = points.min(0), points.max(0)
    want = []
    for x in w:
        u = (points @ x - np.minimum(x * lo, x * hi).sum()) / (np.maximum(x * lo, x * hi) - np.minimum(x * lo, x * hi)).sum()
        want.append(max(np.corrcoef(np.exp(r * u), value)[0, 1] ** 2 for r in rates))
    run = search.ExponentialSearch(frame, 4, rates, 0.0, 10.0, seed=3)
    for bins in (4, 64):
        for r in run.bounds(run.every(200), bins).collect():
            assert r["low"] - 1e-9 <= want[r["trial"]] <= r["high"] + 1e-9
    got = run.best(200, bins=(8, 64)).first()
    assert got["value"] == pytest.approx(max(want)) and got["trial"] == int(np.argmax(want))
    flat = spark.createDataFrame([([1.0], 2.0)] * 3, "points array<double>, value double")
    assert search.ExponentialSearch(flat, 1, rates).best(5).count() == 0


def test_gray_order_changes_one_digit():
    for radices in ([3, 2, 2], [2, 5, 1, 3], [4], [1, 1]):
        total = math.prod(radices)
        digits = H.gray_digits(np.arange(total), radices)
        assert len({tuple(d) for d in digits}) == total and (digits < radices).all() and (digits >= 0).all()
        assert (np.abs(np.diff(digits, axis=0)).sum(axis=1) == 1).all()
        assert (H.gray_digits(np.arange(total // 2, total), radices) == digits[total // 2 :]).all()


def test_grid_in_blocks_equals_every_combination(spark, monkeypatch):
    monkeypatch.setattr(H, "GRID", 7)
    monkeypatch.setattr(search, "ROWS", 20)
    monkeypatch.setattr(search, "STRIP", 9)
    rng = random.Random(3)
    rows = [(rng.randint(0, 9), rng.randint(0, 9), rng.random() < 0.4, rng.randint(1, 3)) for _ in range(120)]
    choices = [[0.0, 0.7, 1.1, 2.0], [0.1, 0.2, 0.3], [1.0]]
    frame = spark.createDataFrame(rows, "a int, b int, truth boolean, n int").withColumn("c", F.lit(0.3))
    got = {(r.w1, r.w2, r.w3): r.hits for r in H.grid_hits(frame, choices, ("a", "b", "c"), 4.0).collect()}
    want = {(x, y, z): sum(n for a, b, t, n in rows if (round(x * a + y * b + z * 0.3, 9) >= 4.0) == t) for x in choices[0] for y in choices[1] for z in choices[2]}
    assert got == want
    assert H.grid_hits(frame.filter("false"), choices, ("a", "b", "c"), 4.0).count() == 0


def test_a_model_is_trained_once_for_equal_rows_and_settings(spark, peptides, monkeypatch):
    from motifspark.plans import training_plan

    folder, trained = scratch_path(spark, "models"), []
    real = training_plan.train_conditional

    def counted(*a, **k):
        trained.append(1)
        return real(*a, **k)

    counted.__signature__ = __import__("inspect").signature(real)
    monkeypatch.setattr(training_plan, "train_conditional", counted)
    first, was = training_plan.train_or_load(folder, peptides)
    again, now = training_plan.train_or_load(folder, peptides.repartition(5).select(*reversed(peptides.columns)))
    assert (was, now, len(trained)) == (False, True, 1) and again.threshold == first.threshold
    assert all((again.matrices[k] == first.matrices[k]).all() for k in first.matrices)
    assert training_plan.train_or_load(folder, peptides, method="suboptimal")[1] is False
    assert training_plan.train_or_load(folder, peptides.unionByName(peptides.limit(1)))[1] is False
    assert len(trained) == 3
    key = training_plan.model_key(peptides, {"seed": 9})
    with pytest.raises(RuntimeError):  # a training that breaks off lists nothing
        sinks.publish(spark, folder, key, lambda path: (_ for _ in ()).throw(RuntimeError()))
    assert sinks.published(spark, folder, key) is None


def test_table_digest_sees_rows_and_places_of_nulls(spark):
    schema = "a string, b string"
    digest = lambda rows: sinks.table_digest(spark.createDataFrame(rows, schema))
    assert digest([("x", None), ("y", "z")]) == digest([("y", "z"), ("x", None)])
    assert len({digest(r) for r in ([("x", None)], [(None, "x")], [("x", None)] * 2, [("x", "x")], [])}) == 5


def test_bins_are_counted_in_bounded_pieces(spark, monkeypatch):
    data = [([RNG.random() for _ in range(3)], RNG.random() < 0.5) for _ in range(50)]
    rows = spark.createDataFrame(data, "points array<double>, truth boolean")
    want = sorted(map(tuple, search.Search(rows, 3)._tallied(spark.range(40).withColumnRenamed("id", "trial"), 64).collect()))
    monkeypatch.setattr(search, "HELD", 1024)
    small = search.Search(rows, 3)
    assert sorted(map(tuple, small._tallied(spark.range(40).withColumnRenamed("id", "trial"), 64).collect())) == want


def test_search_without_any_cut(spark):
    none = spark.createDataFrame([], "points array<double>, truth boolean")
    assert search.Search(none, 3).best(10).count() == 0
    banned = spark.createDataFrame([(None, True), (None, False)], "points array<double>, truth boolean")
    assert search.Search(banned, 3).best(10).count() == 0


def test_methods_learn_weights_of_their_own(spark, peptides):
    from motifspark.plans import training_plan

    for method in ("ps", "wps", "suboptimal"):
        model, _, weights, report = training_plan.train_conditional(peptides, trials=40, method=method)
        assert model.method == method and report.count() == 1
        assert weights["positive"] != weights["suboptimal"]
        if method == "wps":
            assert weights["positive"] == weights["binding"]
        if method == "suboptimal":
            assert set(weights["positive"]) == {0.0}


# ---- p-values ------------------------------------------------------------------------------------------------

def test_student_p_known_values():
    assert pvalues.student_p(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert pvalues.student_p(0.0, 5) == pytest.approx(1.0)
    assert pvalues.student_p(12.706204736, 1) == pytest.approx(0.05, abs=1e-8)


def test_barnard_is_symmetric_and_small_for_a_clear_table():
    assert pvalues.barnard_p(0, 20, 12, 5) < 0.001
    assert pvalues.barnard_p(5, 5, 5, 5) == pytest.approx(1.0, abs=1e-6)
    assert pvalues.barnard_p(3, 7, 8, 2) == pytest.approx(pvalues.barnard_p(7, 3, 2, 8))


# ---- homology, topology, assembly, consolidation --------------------------------------------------------------

def test_best_match_equals_brute_force(spark):
    scores = M.substitution_scores()
    rows = [(m, t) for m, t in zip(words(20), words(20, 60, K.RESIDUES + "UX"))] + [("", "A" * 30), ("A" * 15, "AC"), ("A" * 15, None)]
    got = M.best_match(spark.createDataFrame(rows, "motif string, target string")).collect()
    for r in got:
        m, t = r["motif"], (r["target"] or "").replace("U", "C")
        if len(m) != 15 or len(t) < 15:
            assert (r["match"], r["similarity"], r["identity"]) == ("", 0.0, 0.0)
            continue
        sims = [round(sum(scores.get((a, b), 0.0) for a, b in zip(m, t[i:i + 15])) / 15, 9) for i in range(len(t) - 14)]
        at = sims.index(max(sims))
        assert r["match"] == t[at:at + 15] and r["similarity"] == pytest.approx(max(sims))
        assert r["identity"] == pytest.approx(sum(a == b for a, b in zip(m, t[at:at + 15])) / 15)


@pytest.mark.parametrize("weights", [None, [1.0, 0.0, 2.5] * 5, [-1.0] * 15])
def test_best_match_of_many_motifs_of_one_target(spark, weights):
    scores, targets = M.substitution_scores(), words(3, 300, K.RESIDUES + "UX")
    rows = [(m, t) for t in targets for m in words(6)] * 2
    w = weights or [1.0] * 15
    found = M.best_match(spark.createDataFrame(rows, "motif string, target string").coalesce(1), weights=weights)
    for r in found.collect():
        t = r["target"].replace("U", "C")
        sims = [round(sum(scores.get((a, b), 0.0) * x for a, b, x in zip(r["motif"], t[i:i + 15], w)) / sum(w), 9) for i in range(len(t) - 14)]
        assert r["similarity"] == pytest.approx(max(sims), abs=1e-9) and r["match"] == t[sims.index(max(sims)):][:15]
    whole = found.select("match", "similarity")._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(target" not in whole  # whole targets are not rewritten once per motif


def test_best_match_in_targets_of_many_strips(spark):
    motif, (target,) = words(1)[0], words(1, 1600, "ADEG")
    at = M.STRIP - 7  # the same window stands over the end of a strip and once more behind
    target = target[:at] + motif + target[at:] + motif
    rows = [(m, target) for m in [motif, *words(40)]]
    got = M.best_match(spark.createDataFrame(rows, "motif string, target string").coalesce(1)).collect()
    scores = M.substitution_scores()
    for r in got:
        sims = [round(sum(scores.get((a, b), 0.0) for a, b in zip(r["motif"], target[i:i + 15])) / 15, 9) for i in range(len(target) - 14)]
        assert r["similarity"] == pytest.approx(max(sims), abs=1e-9) and r["match"] == target[sims.index(max(sims)):][:15]


def test_substitution_table_is_symmetric_with_known_diagonal():
    raw = M.substitution_scores(normalize=False)
    assert all(raw[a, b] == raw[b, a] for a, b in raw)
    assert (raw["W", "W"], raw["C", "C"], raw["A", "A"], raw["D", "E"], raw["I", "V"]) == (11, 9, 4, 2, 3)


def test_topology_stops_at_the_containing_domain(spark):
    motif = "GGGGGGABCDEFGHH"
    seqs = spark.createDataFrame([("p", "KKKK" + "ABCDEFG" + "KKKK")], "accession string, sequence string")
    dom = [("p", 0, "a", None, 1, 6), ("p", 1, "b", "B", 4, 13), ("p", 2, "c", "C", 5, 15)]
    domains = spark.createDataFrame(dom, "accession string, ord int, type string, description string, begin int, `end` int")
    hits = spark.createDataFrame([("p", 1, motif), ("p", 2, "")], "accession string, rank int, motif string")
    got = {r["rank"]: r for r in O.classify(hits, seqs, domains).collect()}
    assert (got[1]["start"], got[1]["type"], got[1]["description"]) == (4, "a;b", ";B")
    assert got[2]["start"] is None and got[2]["type"] == ""


def test_last_accession_wins(spark):
    p = spark.createDataFrame([(1,), (2,)], "protein_id int")
    a = spark.createDataFrame([(1, "x", 0), (1, "y", 5), (1, "z", 3)], "protein_id int, uniprot string, input_ord int")
    assert {r["protein_id"]: r["uniprot"] for r in D.merge_accessions(p, a, "protein_id", ["uniprot"]).collect()} == {1: "y", 2: None}


def test_merge_species_rejects_duplicate_keys(spark):
    one_, two = spark.createDataFrame([(1, "a"), (2, "b")], "protein_id int, x string"), spark.createDataFrame([(1, "c"), (1, "d")], "protein_id int, y string")
    with pytest.raises(Exception, match="not unique"):
        J.merge_species({"one": one_, "two": two}).collect()


def test_first_row_per_key_with_one_key_holding_most_rows(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("gene_id"), F.col("id").alias("protein_id"),
                                  (F.col("id") % 7 == 0).alias("accessible"), (F.col("id") % 5 == 0).alias("host_call"),
                                  (F.col("id") % 11).cast("double").alias("binding"), F.col("id").alias("input_ord"))
    got = J.gene_rows(df, ["protein_id"]).filter("gene_id = 0").first()["protein_id"]
    rows = [i for i in range(5000) if i % 3 > 0 or i == 0]
    assert got == min(rows, key=lambda i: (i % 7 != 0, i % 5 != 0, -(i % 11), i))


# ---- assay, spots, specificity, files -------------------------------------------------------------------------

def test_missing_replicate_fails_the_call(spark):
    cells = spark.createDataFrame([(0, 1, "A", "1", 10.0, 2.0), (0, 1, "A", "2", 10.0, None), (0, 0, "A", "1", 10.0, 2.0)],
                                  "dataset int, peptide_id int, bait string, copy string, bas double, call_index double")
    got = {r["peptide_id"]: r["call"] for r in A.positive_calls(cells, (0,)).collect()}
    assert got == {1: "", 0: "Pass"}


def test_least_different_prefers_values_over_nulls(spark):
    pairs = spark.createDataFrame([(0, 1, "A_B", -3.0), (0, 1, "B_A", 2.0), (0, 2, "A_B", None), (0, 2, "B_A", None)],
                                  "dataset int, peptide_id int, pair string, log2fc double")
    got = {r["peptide_id"]: (r["log2fc"], r["pair"]) for r in A.least_different(pairs).collect()}
    assert got == {1: (2.0, "B_A"), 2: (None, None)}
    signed = {r["peptide_id"]: r["log2fc"] for r in A.least_different(pairs, signed=True).collect()}
    assert signed[1] == -3.0


def test_bright_images_are_rejected(spark):
    px = spark.createDataFrame([("i", 0, 0, 3.0)], "image string, y int, x int, v double")
    with pytest.raises(Exception, match="0 to 1 range"):
        P.linearize(px).collect()


def test_bright_images_can_be_scaled(spark):
    px = spark.createDataFrame([("i", 0, 0, 3.0), ("i", 0, 1, -1.0), ("j", 0, 0, 0.5)], "image string, y int, x int, v double")
    got = {(r["image"], r["x"]): r["v"] for r in P.linearize(px, base=2, bright="scale").collect()}
    assert got == {("i", 0): 2.0, ("i", 1): 1.0, ("j", 0): pytest.approx(2 ** 0.5)}


def test_every_event_table_is_linearized(spark, tmp_path):
    spark.createDataFrame([(k, 900.0 * k) for k in range(3)], "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    from motifspark.registry.spots import a23

    assert [r["v"] for r in a23(spark, str(tmp_path)).orderBy("x").collect()] == [1.0, pytest.approx(2 ** (2.6 / 5.3), abs=1e-6), 2.0]


def test_specificity_is_null_for_unknown_residues(spark):
    tables = [{aa: 1.0 for aa in K.RESIDUES}] * 15
    df = spark.createDataFrame([("A" * 15,), ("A" * 14 + "X",), ("",)], "s string")
    assert [r[0] for r in df.select(X.specificity_score(F.col("s"), tables)).collect()] == [15.0, None, None]


def test_model_round_trip(spark, peptides):
    t = T.Training(peptides)
    path = sinks.save_model(scratch_path(spark, "model"), t.baseline, {"binding": [1.0, 2.0]}, {"threshold": 0.5})
    pwm, weights, params = sinks.load_model(spark, path)
    assert pwm.count() == t.baseline.count() and weights == {"binding": [1.0, 2.0]} and params == {"threshold": 0.5}


def test_fasta_tags_and_wrapped_sequence(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">E1.1 pep gene:G1.2 transcript:T1 gene_symbol:AB:C\nMK\nLV\n>E2 pep\nAA*\n")
    got = {r["id"]: r for r in readers.fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert (got["E1.1"]["gene"], got["E1.1"]["transcript"], got["E1.1"]["gene_symbol"], got["E1.1"]["sequence"]) == ("G1.2", "T1", "AB:C", "MKLV")
    assert (got["E2"]["gene"], got["E2"]["sequence"]) == ("", "AA*")


def test_fasta_marks_inside_headers_line_ends_and_splits(spark, tmp_path):
    rng = random.Random(8)
    want = []
    for end in ("\n", "\r\n"):
        name = "unix" if end == "\n" else "dos"
        rows = [(f"{name}{i}.{i % 3}", f"G{i}", "".join(rng.choices("ACDEFGHIKL", k=rng.randint(0, 300)))) for i in range(400)]
        want += [(i, g, seq) for i, g, seq in rows]
        records = [f">{i} a->b > c gene:{g} >{end}" + end.join(seq[k:k + 60] for k in range(0, len(seq), 60)) for i, g, seq in rows]
        (tmp_path / f"{name}.fa").write_bytes((end.join(records) + end).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "977")
    try:
        frame = readers.fasta(spark, str(tmp_path))
        assert frame.rdd.getNumPartitions() > 20
        got = frame.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.id, r.gene, r.sequence) for r in got) == sorted(want)
    order = [r.id for r in sorted(got, key=lambda r: r.input_ord)]
    assert [i for i in order if i.startswith("unix")] == [w[0] for w in want if w[0].startswith("unix")]


def test_streaming_scan_equals_batch_scan(spark, peptides, tmp_path):
    from motifspark.streaming.scan import best_hits_per_batch, scored_windows

    rows = [(i, s) for i, s in enumerate(words(12, 400))]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame(rows, "protein_id long, seq string")
    df.write.parquet(src)
    model = C.ConditionalModel.from_pwm(T.Training(peptides).pwm())
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = best_hits_per_batch(stream, model, out, str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    cols = ["protein_id", "rank", "motif"]
    want = sorted(map(tuple, scan.best_hits(scored_windows(df, model)).select(*cols).collect()))
    assert sorted(map(tuple, spark.read.parquet(out).select(*cols).collect())) == want and want


# ---- edges -----------------------------------------------------------------------------------------------------

def test_scratch_needs_a_shared_folder(spark):
    class Elsewhere:
        conf = spark.conf

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return spark.sparkContext.getConf()

    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError):
            scratch_path(Elsewhere, "x")
        assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_last_record_of_a_sequence_counts(spark):
    fasta = spark.createDataFrame([("P1.9", "OLD", 1), ("P1.10", "NEW", 2), ("P2.5", "NEW", 3), ("P2.6", "OLD", 2)], "id string, sequence string, input_ord long")
    got = D.attach_sequences(spark.createDataFrame([("P1",), ("P2",), ("P3",)], "k string"), fasta, "k").collect()
    assert {r.k: r.sequence for r in got} == {"P1": "NEW", "P2": "NEW", "P3": None}


def test_homologs_are_as_wide_as_there_are(spark):
    rows = spark.createDataFrame([(1, "fr", j, f"h{j}", "S" * j) for j in range(9)], "protein_id long, taxid string, j int, homolog string, sequence string")
    got = D.widen_homologs(rows, ["fr", "de"]).first()
    assert [got[f"fr_homolog_{j}"] for j in range(9)] == [f"h{j}" for j in range(9)] and got["de_homolog_8"] == ""


@pytest.mark.parametrize("target,start", [("**ACDEFGHIKLMNPQR*", 3), ("acdefghiklmnpqr", 1), ("ACDEFGHIKLMNPQR", 1), ("ACD", 0), ("é" * 20, 1)])
def test_odd_letters_in_targets(spark, target, start):
    got = M.best_match(one(spark, motif="ACDEFGHIKLMNPQR", target=target)).first()
    assert got.similarity == (1.0 if "ACDEFGHIKLMNPQR" in target else 0.0) and (got.match == "") == (start == 0)
    if "ACDEFGHIKLMNPQR" in target:
        assert got.match == "ACDEFGHIKLMNPQR"


def test_missing_control_is_an_error(spark):
    rows = spark.createDataFrame([(1, "Yes", 5.0), (2, "Yes", 9.0), (2, "No", 3.0)], "peptide_id long, one_passes string, max_signal double")
    assert sorted(r.peptide_id for r in X.training_rows(rows, 2, 0.6).collect()) == [2]
    with pytest.raises(Exception, match="control"):
        X.training_rows(rows, 7, 0.6).collect()


def test_percentiles_equal_numpy(spark):
    from motifspark.operators.running import percentiles

    values = [RNG.gauss(0, 1) if RNG.random() < 0.6 else 1.5 for _ in range(777)] + [None]
    got = {r.percentile: r.value for r in percentiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", [0, 1, 25, 50, 99, 100]).collect()}
    known = [v for v in values if v is not None]
    assert got == {p: pytest.approx(float(np.percentile(known, p))) for p in got} and len(got) == 6


def test_grid_hits_in_blocks(spark):
    rows = [(RNG.randint(0, 9), RNG.randint(0, 9), RNG.random() < 0.5, RNG.randint(1, 4)) for _ in range(200)]
    choices = [[0.0, 1.0, 2.5], [0.5, 2.0]]
    got = {(r.w1, r.w2): r.hits for r in H.grid_hits(spark.createDataFrame(rows, "a long, b long, truth boolean, n long").repartition(4), choices, ("a", "b"), 9.0, block=4).collect()}
    assert got == {(v, w): sum(n for a, b, t, n in rows if (v * a + w * b >= 9.0) == t) for v in choices[0] for w in choices[1]}


def test_barnard_equals_enumeration():
    def plain(a, b, c, d):
        n1, n2, best = a + c, b + d, 0.0

        def stat(x, y):
            p = (x + y) / (n1 + n2)
            var = p * (1 - p) * (1 / n1 + 1 / n2)
            return (x / n1 - y / n2) / math.sqrt(var) if var > 0 else 0.0

        for p in np.linspace(0, 1, 66)[1:-1]:
            best = max(best, sum(math.comb(n1, x) * p**x * (1 - p) ** (n1 - x) * math.comb(n2, y) * p**y * (1 - p) ** (n2 - y)
                                 for x in range(n1 + 1) for y in range(n2 + 1) if abs(stat(x, y)) >= abs(stat(a, b)) - 1e-9))
        return min(best, 1.0)

    for _ in range(12):
        t = [RNG.randint(0, 7) for _ in range(4)]
        if t[0] + t[2] and t[1] + t[3]:
            assert pvalues.barnard_p(*t) == pytest.approx(plain(*t), abs=1e-9)


def test_models_come_back_as_saved(spark):
    from motifspark.plans import training_plan as P

    rows = [(i, w, RNG.random() < 0.4, RNG.random() * 100) for i, w in enumerate(words(300))]
    peptides = spark.createDataFrame(rows, "peptide_id long, seq string, passes boolean, signal double")
    matrices = T.Training(peptides).pwm()
    weights = P.default_weights()
    model = C.ConditionalModel.from_pwm(T.weight_matrices(matrices, weights), P.KINDS, method="wps", threshold=1.5, mode="sum", suppressed=(2, 9))
    model.coefficients = {"total": (1.0, 2.0)}
    again = P.load(spark, P.save(scratch_path(spark, "model"), matrices, weights, model))
    assert (again.method, again.threshold, again.mode, again.suppressed, again.coefficients) == ("wps", 1.5, "sum", (2, 9), {"total": (1.0, 2.0)})
    one_way, other = ([tuple(r) for r in m.score(peptides, "seq").orderBy("peptide_id").collect()] for m in (model, again))
    assert one_way == other


def test_sum_mode_is_twice_the_mean(spark):
    peptides = spark.createDataFrame([(i, w, RNG.random() < 0.4, RNG.random() * 100) for i, w in enumerate(words(200))], "peptide_id long, seq string, passes boolean, signal double")
    matrices = T.Training(peptides).pwm()
    mean, total = (C.ConditionalModel.from_pwm(matrices, mode=m) for m in ("mean", "sum"))
    for r in peptides.select(mean.total_score(F.col("seq"), "positive").alias("a"), total.total_score(F.col("seq"), "positive").alias("b")).collect():
        assert r.b == pytest.approx(2 * r.a)


def test_coordinate_names_carry_no_paths(spark, tmp_path):
    from motifspark.sources import readers

    folder = tmp_path / "names of 50%"
    folder.mkdir()
    (folder / "b.csv").write_text("A1,last\nA2,only\n")
    (folder / "a.csv").write_text("A1,first\nA3,x\n" + "A1,second\n" * 500 + "A3,y\n")
    names = readers.coordinate_names(spark, str(folder))
    assert {(r["coord"], r["name"]) for r in names.collect()} == {("A1", "last"), ("A2", "only"), ("A3", "y")}
    combined = names._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "RepartitionByExpression" in combined and "file_path" not in combined  # small tasks sort places in numbers
