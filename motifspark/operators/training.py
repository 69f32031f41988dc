"""Training of position-weighted matrices, one per rule (chemical class at a position), from measured peptides.

Peptides have seq, signal and passes. One distributed pass reduces them to counts and rank sums per
(rule, position, residue); everything after that works on this bounded table.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from motifspark import constants as K
from motifspark.functions import sequence as S
from motifspark.functions.pvalues import barnard_pvalue, z_pvalue
from motifspark.operators.running import running_totals
from motifspark.session import materialize

RULE = ["rule_class", "rule_pos"]
CELL = [*RULE, "pos"]


def stratified_split(peptides, share=0.2, seed=1, key="peptide_id", flag="passes"):
    """Exact split of passing and failing rows alike, in the order of a seeded hash."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))
    h = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")
    tagged = peptides.withColumn("_h", h)
    place = running_totals(tagged, [flag], "_h", {"_n": F.lit(1)}).select(flag, "_h", F.col("cum__n").alias("_place"))
    size = peptides.groupBy(flag).agg(F.ceil(F.count("*") * share).alias("_test"))
    out = tagged.join(place, [flag, "_h"]).join(size, flag)
    return out.withColumn("is_test", F.col("_place") <= F.col("_test")).drop("_h", "_place", "_test")


def rules(spark, n=K.MOTIF_LENGTH):
    """All rules, class by class, then position."""
    one = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("class_no"), F.lit(c).alias("rule_class")) for i, c in enumerate(K.CHEMICAL_CLASSES)
    ])).alias("c"))
    return one.select("c.*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("rule_pos")).select(
        "rule_class", "rule_pos", (F.col("class_no") * n + F.col("rule_pos")).alias("rule_no")
    )


CLASS_NAMES = list(K.CHEMICAL_CLASSES)


def _class_numbers(aa):
    """Array of the numbers of the classes a residue belongs to."""
    member = {a: [i for i, c in enumerate(CLASS_NAMES) if a in K.CHEMICAL_CLASSES[c]] for a in K.RESIDUES_PHOSPHO}
    out = F.array(S.letter_table({a: m[0] for a, m in member.items()}, -1)[S.letter_index(aa)].cast("int"))
    for a, m in member.items():
        if len(m) > 1:
            out = F.when(aa == a, F.array(*[F.lit(i) for i in m])).otherwise(out)
    return out


def _positions():
    return F.explode(F.array(*[F.lit(i) for i in range(1, K.MOTIF_LENGTH + 1)]))


def _numbered_members(peptides):
    """(rule number, seq, signal, passes): rules count from 0, class by class."""
    at = peptides.select("seq", "signal", "passes", _positions().alias("_i"))
    found = at.select("seq", "signal", "passes", "_i", F.explode(_class_numbers(F.substring(F.col("seq"), F.col("_i"), F.lit(1)))).alias("_c"))
    return found.filter("_c >= 0").select((F.col("_c") * K.MOTIF_LENGTH + F.col("_i") - 1).alias("rule"), "seq", "signal", "passes")


def _rule_names(rule):
    """Class and position of a rule number; the number past the last stands for all rows."""
    n, last = K.MOTIF_LENGTH, len(CLASS_NAMES) * K.MOTIF_LENGTH
    names = F.array(*[F.lit(c) for c in CLASS_NAMES], F.lit("All"))
    return {"rule_class": names[(rule / n).cast("int")], "rule_pos": F.when(rule == last, 0).otherwise(rule % n + 1).cast("int")}


def _lookup(mapping, aa):
    """Array of single letters for a residue."""
    text = ",".join(mapping.get(chr(65 + i), "") for i in range(26))
    return F.split(F.split(F.lit(text), ",")[S.letter_index(aa)], "")


def memberships(peptides):
    """One row per peptide and rule it belongs to; W belongs to two classes."""
    names = _rule_names(F.col("rule"))
    return _numbered_members(peptides).select(*[v.alias(k) for k, v in names.items()], "seq", "signal", "passes")


def member_counts(peptides, min_members=K.MIN_MEMBERS):
    """Members per rule; rules with too few train on all rows instead."""
    n = memberships(peptides).groupBy(*RULE).agg(F.count("*").alias("n_members"))
    return _with_fallback(peptides.sparkSession, n, min_members)


def _with_fallback(spark, counts, min_members):
    out = rules(spark, K.MOTIF_LENGTH).join(counts, RULE, "left").withColumn("n_members", F.coalesce("n_members", F.lit(0)))
    return out.withColumn("all_rows", F.col("n_members") < min_members)


#: Rows of a slice that are counted together, and cells by rule, position and letter.
TOGETHER = 1 << 14
CELLS = K.MOTIF_LENGTH * 26


class RankedCells:
    """Counts and rank sums per cell of rows that come in the order of their signals; holds cells, not rows.

    Equal signals are ranked as one group, however many rows or batches it spans: of the group that is still open only the
    rows of each rule and cell are kept.
    """

    def __init__(self):
        member = [[i for i, c in enumerate(CLASS_NAMES) if chr(65 + a) in K.CHEMICAL_CLASSES[c]] for a in range(26)]
        self.first = np.array([m[0] if m else -1 for m in member])
        self.more = {a: m[1:] for a, m in enumerate(member) if len(m) > 1}
        self.rules = len(CLASS_NAMES) * K.MOTIF_LENGTH + 1
        size = self.rules * CELLS
        self.count, self.rank_sum, self.tie_sum = np.zeros(size, np.int64), np.zeros(size), np.zeros(size, np.int64)
        self.below = np.zeros(self.rules, np.int64)  # members of each rule so far, open group aside
        self.open, self.members, self.cells = None, np.zeros(self.rules, np.int64), np.zeros(size, np.int64)

    def entries(self, letters, known):
        """(row, rule) of every membership in the order of rows, the rule of all rows included."""
        n = K.MOTIF_LENGTH
        rows, rules = [np.arange(len(letters))], [np.full(len(letters), self.rules - 1)]
        found = np.where(known[:, None], self.first[letters], -1)
        row, place = np.nonzero(found >= 0)
        rows.append(row)
        rules.append(found[row, place] * n + place)
        for a, others in self.more.items():
            row, place = np.nonzero((letters == a) & known[:, None])
            for c in others:
                rows.append(row)
                rules.append(c * n + place)
        rows, rules = np.concatenate(rows), np.concatenate(rules)
        by = np.argsort(rows, kind="stable")
        return rows[by], rules[by]

    def codes(self, letters, known, rows, rules):
        """Cells of memberships, and which membership each is of; rows without a sequence have none."""
        which = np.flatnonzero(known[rows])
        code = rules[which, None] * CELLS + np.arange(K.MOTIF_LENGTH) * 26 + letters[rows[which]]
        return code.ravel(), np.repeat(which, K.MOTIF_LENGTH)

    def add(self, signal, letters, known):
        """Takes the next rows, in order of their signals."""
        if not len(signal):
            return
        if self.open is not None and signal[0] != self.open:
            self.close()
        last = np.searchsorted(signal, signal[-1])
        head = np.searchsorted(signal, self.open, "right") if self.open is not None else 0
        if head:
            self.keep(letters[:head], known[:head])
            if head == len(signal):
                return
            self.close()
        self.rank(signal[head:last], letters[head:last], known[head:last])
        self.open = signal[-1]
        self.keep(letters[last:], known[last:])

    def keep(self, letters, known):
        """Rows of the open group."""
        rows, rules = self.entries(letters, known)
        self.members += np.bincount(rules, minlength=self.rules)
        self.cells += np.bincount(self.codes(letters, known, rows, rules)[0], minlength=len(self.cells))

    def close(self):
        """Ranks the open group."""
        if self.open is None:
            return
        at = np.flatnonzero(self.cells)
        of, held = at // CELLS, self.cells[at]
        self.count[at] += held
        self.rank_sum[at] += held * (self.below + (self.members + 1) / 2)[of]
        self.tie_sum[at] += held * (self.members * self.members - 1)[of]
        self.below += self.members
        self.open = None
        self.members[:], self.cells[:] = 0, 0

    def rank(self, signal, letters, known):
        """Rows whose groups all end here."""
        if not len(signal):
            return
        rows, rules = self.entries(letters, known)
        by = np.argsort(rules, kind="stable")
        rows, rules = rows[by], rules[by]
        value = signal[rows]
        begins = np.flatnonzero(np.concatenate([[True], (rules[1:] != rules[:-1]) | (value[1:] != value[:-1])]))
        ties = np.diff(np.concatenate([begins, [len(rules)]]))
        place = np.arange(len(rules)) - np.searchsorted(rules, rules)
        rank = self.below[rules] + place[np.repeat(begins, ties)] + (np.repeat(ties, ties) + 1) / 2
        spread = np.repeat(ties * ties - 1, ties)
        code, of = self.codes(letters, known, rows, rules)
        size = len(self.count)
        self.count += np.bincount(code, minlength=size)
        self.rank_sum += np.bincount(code, rank[of], size)
        if spread.any():
            tied = np.flatnonzero(spread[of])
            self.tie_sum += np.bincount(code[tied], spread[of][tied], size).astype(np.int64)
        self.below += np.bincount(rules, minlength=self.rules)

    def unranked(self, letters, known):
        """Counts of rows that are not ranked."""
        rows, rules = self.entries(letters, known)
        return np.bincount(self.codes(letters, known, rows, rules)[0], minlength=len(self.count))


def _letters_of(column):
    """(letters, known) of sequences: one row of numbers each; a row without a sequence is not known."""
    texts = column.to_pylist()
    known = np.array([t is not None for t in texts], bool)
    raw = np.frombuffer("".join("A" * K.MOTIF_LENGTH if t is None else t for t in texts).encode("utf-32-le"), np.uint32)
    if len(raw) != len(texts) * K.MOTIF_LENGTH or ((raw < 65) | (raw > 90)).any():
        raise ValueError(f"training sequences must have at least {K.MOTIF_LENGTH} letters from A to Z")
    return (raw - 65).astype(np.int64).reshape(-1, K.MOTIF_LENGTH), known


SLICE = "first double, code long, n_pass long, n_fail long, n_ranked long, rank_sum double, tie_sum long"


def _sliced(first, code, n_pass, n_fail, n_ranked, rank_sum, tie_sum):
    columns = (np.full(len(code), first), code, n_pass, n_fail, n_ranked, rank_sum, tie_sum)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in SLICE.split(", ")])


def statistics(peptides, ignore_failed=True):
    """Counts and rank sums per (rule, pos, aa); rule ('All', 0) holds every peptide. At most 136 x 15 x 23 rows.

    Ranked rows are dealt by ranges of the signal. A slice ranks its rows among themselves, rule by rule, and hands on its
    cells; the members of the lower slices, added per rule, turn these ranks into ranks among all rows. Rows that are not
    ranked are counted where they are.
    """
    n = K.MOTIF_LENGTH
    signal = F.greatest(F.col("signal"), F.lit(0.0)).cast("double") + 0.0
    p = peptides.select(F.substring("seq", 1, n).alias("seq"), signal.alias("signal"), "passes")
    ranked = (F.col("passes") if ignore_failed else F.lit(True)) & ~F.isnan("signal")

    def rank(batches):
        cells, first = RankedCells(), None
        passed = np.zeros(len(cells.count), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                (letters, known), value = _letters_of(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
                first = value[0] if first is None else first
                cells.add(value, letters, known)
                if not ignore_failed:
                    good = batch.column(2).fill_null(False).to_numpy(zero_copy_only=False)
                    passed += cells.unranked(letters[good], known[good])
        if first is None:
            return
        cells.close()
        at = np.flatnonzero(cells.count)
        count = cells.count[at]
        good = count if ignore_failed else passed[at]
        yield _sliced(first, at, good, count - good, count, cells.rank_sum[at], cells.tie_sum[at])
        rule = np.flatnonzero(cells.below)  # the members of a rule, under a number of their own
        none = np.zeros(len(rule), np.int64)
        yield _sliced(first, -1 - rule, none, none, cells.below[rule], none.astype(float), none)

    def count(batches):
        cells = RankedCells()
        total = np.zeros(len(cells.count), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                total += cells.unranked(*_letters_of(whole.column(0).slice(at, TOGETHER)))
        at = np.flatnonzero(total)
        none = np.zeros(len(at), np.int64)
        yield _sliced(0.0, at, none, total[at], none, none.astype(float), none)

    cuts = 4 * peptides.sparkSession.sparkContext.defaultParallelism
    parts = p.filter(ranked).repartitionByRange(cuts, "signal").sortWithinPartitions("signal").mapInArrow(rank, SLICE)
    if ignore_failed:
        parts = parts.unionByName(p.filter(~F.col("passes")).select("seq").mapInArrow(count, SLICE))
    parts = materialize(parts, "rule-slices")
    lower = Window.partitionBy("_rule").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    members = parts.filter("code < 0").withColumn("_rule", -1 - F.col("code"))
    below = members.select("_rule", "first", F.coalesce(F.sum("n_ranked").over(lower), F.lit(0)).alias("_below"))
    cells = parts.filter("code >= 0").withColumn("_rule", F.expr(f"code div {CELLS}")).join(below, ["_rule", "first"], "left")
    summed = cells.groupBy("code").agg(
        F.sum("n_pass").alias("n_pass"), F.sum("n_fail").alias("n_fail"), F.sum("n_ranked").alias("n_ranked"),
        F.sum(F.when(F.col("n_ranked") > 0, F.col("rank_sum") + F.col("_below") * F.col("n_ranked"))).alias("rank_sum"),
        F.sum(F.when(F.col("n_ranked") > 0, F.col("tie_sum"))).alias("tie_sum"),
    )
    names = _rule_names((F.col("code") / CELLS).cast("int"))
    return summed.select(
        *[v.alias(k) for k, v in names.items()], ((F.col("code") / 26).cast("int") % n + 1).alias("pos"),
        F.char(F.col("code") % 26 + 65).alias("aa"), "n_pass", "n_fail", "n_ranked", "rank_sum", "tie_sum",
    )


def yule_q(a, b, n_pass, n_fail):
    """Association of residue and pass: a, b passing and failing with the residue, out of the totals."""
    x, y = a * (n_fail - b), (n_pass - a) * b
    return F.coalesce(F.try_divide(x - y, x + y), F.lit(0.0))


def rank_biserial(n1, rank_sum, n):
    """2U / (n1 n2) - 1 from the rank sum of the n1 rows with the residue; null if a side is empty."""
    u = rank_sum - n1 * (n1 + 1) / 2
    return F.try_divide(2 * u, n1 * (n - n1)) - 1


def rank_p(n1, rank_sum, n, ties):
    """Two-sided p of the same U by normal approximation with tie and continuity correction."""
    n2 = n - n1
    u = rank_sum - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * (n + 1 - F.try_divide(ties, n * (n - 1))))
    return z_pvalue(F.try_divide(F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)), spread))


def contrasts(stats):
    """The full (rule, pos, residue) grid with the residue alone, its equivalence group, and the rule's totals."""
    totals = stats.groupBy(*RULE).agg(
        *[F.sum(F.when(F.col("pos") == 1, F.col(c))).alias(t) for c, t in
          (("n_pass", "all_pass"), ("n_fail", "all_fail"), ("n_ranked", "all_ranked"), ("tie_sum", "all_ties"))]
    )
    letters = F.array(*[F.lit(a) for a in K.RESIDUES_PHOSPHO])
    grid = totals.select("*", F.explode(F.sequence(F.lit(1), F.lit(K.MOTIF_LENGTH))).alias("pos")).select(
        "*", F.explode(letters).alias("aa")
    )
    own = grid.join(stats.drop("tie_sum"), [*CELL, "aa"], "left")
    standing = {}
    for aa, group in K.EQUIVALENTS.items():
        for e in group:
            standing[e] = standing.get(e, "") + aa
    group = stats.withColumn("aa", F.explode(_lookup(standing, F.col("aa")))).groupBy(*CELL, "aa").agg(
        F.sum("n_pass").alias("g_pass"), F.sum("n_fail").alias("g_fail"), F.sum("n_ranked").alias("g_ranked"),
        F.sum("rank_sum").alias("g_rank_sum"),
    )
    counts = ["n_pass", "n_fail", "n_ranked", "g_pass", "g_fail", "g_ranked", "all_ranked", "all_ties"]
    full = own.join(group, [*CELL, "aa"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    c = F.col
    return full.withColumns({
        "r_alone": rank_biserial(c("n_ranked"), c("rank_sum"), c("all_ranked")),
        "r_group": rank_biserial(c("g_ranked"), c("g_rank_sum"), c("all_ranked")),
        "q_alone": yule_q(c("n_pass"), c("n_fail"), c("all_pass"), c("all_fail")),
        "q_group": yule_q(c("g_pass"), c("g_fail"), c("all_pass"), c("all_fail")),
    })


def _cells(x, baseline, p):
    """Matrix values before fills. ``baseline`` is the finished all-rows matrix or None."""
    c, zero = F.col, F.lit(0.0)
    if baseline is not None:
        b = baseline.select("pos", "aa", c("positive").alias("b_pos"), c("suboptimal").alias("b_sub"), c("forbidden").alias("b_forb"))
        x = x.join(F.broadcast(b), ["pos", "aa"], "left")
    alone_ok = c("n_ranked") > p["min_aa"]
    group_ok = c("r_group").isNotNull()
    if p["alpha"] < 1:
        alone_ok = alone_ok & (rank_p(c("n_ranked"), c("rank_sum"), c("all_ranked"), c("all_ties")) <= p["alpha"])
        group_ok = group_ok & (rank_p(c("g_ranked"), c("g_rank_sum"), c("all_ranked"), c("all_ties")) <= p["alpha"])
    if p["require_same_sign"]:
        group_ok = group_ok & (c("r_alone") * c("r_group") > 0)
    positive = F.when(alone_ok & c("r_alone").isNotNull(), c("r_alone")).when(group_ok, c("r_group")).otherwise(zero)
    n, g = c("n_pass") + c("n_fail"), c("g_pass") + c("g_fail")
    enough, group_enough = n >= p["min_aa"], (g >= p["min_aa"]) | F.lit(p["always_assign"])
    q, qg = c("q_alone"), c("q_group")
    same = ((q >= 0) & (qg >= 0)) | ((q <= 0) & (qg <= 0))
    weaker = F.greatest(F.when(F.abs(qg) < F.abs(q), -qg).otherwise(-q), zero)
    from_base = F.coalesce("b_sub", zero) if baseline is not None else zero
    suboptimal = (
        F.when(n == 0, zero).when(enough, F.greatest(-q, zero))
        .when(group_enough & same, F.greatest(-qg, zero))
        .when(group_enough, weaker if p["always_assign"] else zero)
        .otherwise(from_base)
    )
    never = (c("n_pass") == 0) & (c("n_fail") >= p["forbidden_threshold"])
    group_never = (c("g_pass") == 0) & (c("g_fail") >= p["forbidden_threshold"])
    base_forb = F.coalesce("b_forb", zero) if baseline is not None else zero
    forbidden = (
        F.when(n == 0, zero).when(enough, never.cast("double"))
        .when(group_enough, (same & group_never).cast("double"))
        .otherwise(F.when(never, base_forb).otherwise(zero))
    )
    return x.withColumns({"positive": F.when(c("n_ranked") > 0, positive).otherwise(zero), "suboptimal": suboptimal,
                          "forbidden": forbidden})


def _fill(cells, baseline, p):
    """Unseen residues: the baseline's value or the mean of their equivalents (values from before any fill)."""
    c = F.col
    others = {}
    for aa, group in K.EQUIVALENTS.items():
        for e in group:
            if e != aa:
                others[e] = others.get(e, "") + aa
    lent = cells.select(*CELL, F.explode(_lookup(others, c("aa"))).alias("aa"), "positive", "suboptimal").filter("aa <> ''")
    mean = lent.groupBy(*CELL, "aa").agg(F.avg(F.nullif(c("positive"), F.lit(0.0))).alias("_pos"), F.avg("suboptimal").alias("_sub"))
    x = cells.join(mean, [*CELL, "aa"], "left")
    base = F.nullif(c("b_pos"), F.lit(0.0)) if baseline is not None else F.lit(None).cast("double")
    positive = F.when(c("n_ranked") == 0, F.coalesce(base, c("_pos"), F.lit(0.0))).otherwise(c("positive"))
    suboptimal = F.when(c("n_pass") + c("n_fail") == 0, F.coalesce(c("_sub"), F.lit(0.0))).otherwise(c("suboptimal"))
    forbidden = c("forbidden")
    for pos, required in p["forced_required"].items():
        forbidden = F.when((c("pos") == pos) & ~c("aa").isin(*required), 1.0).otherwise(forbidden)
    return x.withColumns({"positive": positive, "suboptimal": suboptimal, "forbidden": forbidden})


def collapse_phospho(cells, keys=tuple(CELL)):
    """Phospho rows folded into their plain residue: stronger effect, weaker penalty, forbidden only if both are."""
    c = F.col
    aa = S.plain(c("aa"))
    is_phospho = c("aa").isin(*K.PHOSPHO)
    kinds = ("positive", "suboptimal", "forbidden")
    g = cells.groupBy(*keys, aa.alias("aa")).agg(
        *[F.max(F.when(~is_phospho, c(k))).alias(k) for k in kinds],
        *[F.max(F.when(is_phospho, c(k))).alias(f"_{k}") for k in kinds],
    )
    has = c("_positive").isNotNull()
    return g.withColumns({
        "positive": F.when(has & (F.abs("_positive") >= F.abs("positive")), c("_positive")).otherwise(c("positive")),
        "suboptimal": F.when(has & ((c("suboptimal") == 0) | (F.abs("_suboptimal") < F.abs("suboptimal"))), c("_suboptimal"))
        .otherwise(c("suboptimal")),
        "forbidden": F.when(has & (c("_forbidden") == 0), F.lit(0.0)).otherwise(c("forbidden")),
    }).drop(*[f"_{k}" for k in kinds])


def collapse_sum(matrix, keys=("pos",), value="value"):
    return matrix.groupBy(*keys, S.plain(F.col("aa")).alias("aa")).agg(F.sum(value).alias(value))


DEFAULTS = dict(
    min_members=K.MIN_MEMBERS, min_aa=K.MIN_AA_ENTRIES, alpha=1.0, forbidden_threshold=K.FORBIDDEN_THRESHOLD,
    forced_required=K.FORCED_REQUIRED, always_assign=False, ignore_failed=True, include_phospho=False,
    replace_forbidden=False, require_same_sign=False,
)


class Training:
    """The bounded statistics of one peptide table and the matrices that follow from them."""

    def __init__(self, peptides, **params):
        self.params = {**DEFAULTS, **params}
        peptides = materialize(peptides.select("seq", "signal", "passes"), "training-peptides")
        self.stats = materialize(statistics(peptides, self.params["ignore_failed"]), "rule-statistics")
        self._contrasts = None
        self._baseline = None

    @property
    def counts(self):
        """Members per rule, from the statistics: every member is counted once at position 1."""
        n = self.stats.filter("pos = 1").groupBy(*RULE).agg(F.sum(F.col("n_pass") + F.col("n_fail")).alias("n_members"))
        return _with_fallback(self.stats.sparkSession, n, self.params["min_members"])

    @property
    def contrasts(self):
        if self._contrasts is None:
            self._contrasts = materialize(contrasts(self.stats), "rule-contrasts")
        return self._contrasts

    def cells(self, baseline=None, only_all=False):
        """Values per (rule, pos, aa) before and after fills, phospho rows included."""
        x = self.contrasts.filter("rule_class = 'All'") if only_all else self.contrasts
        return _fill(_cells(x, baseline, self.params), baseline, self.params)

    @property
    def baseline(self):
        """The matrix of all rows, trained without a rule."""
        if self._baseline is None:
            cells = self.cells(only_all=True)
            kept = cells if self.params["include_phospho"] else collapse_phospho(cells)
            self._baseline = materialize(kept.select("pos", "aa", "positive", "suboptimal", "forbidden"), "baseline")
        return self._baseline

    def pwm(self):
        """All conditional matrices; rules with too few members get the all-rows matrix."""
        cells = self.cells(self.baseline)
        kept = cells if self.params["include_phospho"] else collapse_phospho(cells)
        source = self.counts.select(
            *RULE, F.when(F.col("all_rows"), "All").otherwise(F.col("rule_class")).alias("_class"),
            F.when(F.col("all_rows"), 0).otherwise(F.col("rule_pos")).alias("_pos"),
        )
        trained = kept.select(F.col("rule_class").alias("_class"), F.col("rule_pos").alias("_pos"), "pos", "aa",
                              "positive", "suboptimal", "forbidden")
        out = source.join(trained, ["_class", "_pos"]).drop("_class", "_pos")
        return replace_forbidden(out, self.baseline)[0] if self.params["replace_forbidden"] else out


def replace_forbidden(pwm, baseline):
    """Baseline forbidden values in every rule matrix, and what happened per rule."""
    c = F.col
    b = baseline.select("pos", "aa", c("positive").alias("_p"), c("suboptimal").alias("_s"), c("forbidden").alias("_f"))
    both = pwm.join(F.broadcast(b), ["pos", "aa"])
    report = both.groupBy(*RULE).agg(
        F.bool_or((c("positive") != c("_p")) | (c("suboptimal") != c("_s")) | (c("forbidden") != c("_f"))).alias("differs"),
        F.bool_or(c("forbidden") != c("_f")).alias("forbidden_replaced"),
    )
    return both.withColumn("forbidden", c("_f")).drop("_p", "_s", "_f"), report


def weight_matrices(pwm, weights):
    """Matrix values times position weights; penalties use the absolute weight.

    ``weights`` maps binding, positive, suboptimal and forbidden to one weight per position.
    """
    def at(kind):
        return F.array(*[F.lit(float(w)) for w in weights[kind]])[F.col("pos") - 1]

    return pwm.withColumns({
        "binding": F.col("positive") * at("binding"),
        "positive": F.col("positive") * at("positive"),
        "suboptimal": F.col("suboptimal") * F.abs(at("suboptimal")),
        "forbidden": F.col("forbidden") * F.abs(at("forbidden")),
    })


def copy_column(target, source, pos, kinds=("positive", "suboptimal", "forbidden")):
    """Values of one position taken from another matrix, per kind."""
    own = [k for k in target.columns if k not in kinds]
    s = source.filter(F.col("pos") == pos).select("pos", "aa", *[F.col(k).alias(f"_{k}") for k in kinds])
    out = target.join(F.broadcast(s), ["pos", "aa"], "left")
    return out.select(*own, *[F.when(F.col("pos") == pos, F.col(f"_{k}")).otherwise(F.col(k)).alias(k) for k in kinds])


def rule_regressions(peptides, cells, ignore_failed=True):
    """ln(signal + 1) on the members' own points: one slope on the sum, and all positions at once."""
    n = K.MOTIF_LENGTH
    rows = cells.withColumn("_k", (F.col("pos") - 1) * 26 + S.letter_index(F.col("aa")))
    table = rows.groupBy(*RULE).agg(F.map_from_entries(F.collect_list(F.struct("_k", "positive"))).alias("_m"))
    keys = F.sequence(F.lit(0), F.lit(26 * n - 1))
    table = table.select(*RULE, F.transform(keys, lambda k: F.coalesce(F.col("_m")[k], F.lit(0.0))).alias("_t"))
    p = peptides.withColumn("signal", F.greatest("signal", F.lit(0.0)))
    every = p.select(F.lit("All").alias("rule_class"), F.lit(0).alias("rule_pos"), "seq", "signal", "passes")
    members = memberships(p).unionByName(every)
    members = members.filter("passes") if ignore_failed else members
    m = members.join(F.broadcast(table), RULE).withColumns({
        f"x{i}": F.col("_t")[26 * (i - 1) + S.letter_index(S.residue_at(F.col("seq"), i))] for i in range(1, n + 1)
    }).withColumn("y", F.ln(F.col("signal") + 1))
    xs = [F.col(f"x{i}") for i in range(1, n + 1)]
    total = sum(xs[1:], xs[0])
    moments = m.groupBy(*RULE).agg(
        F.count("*").alias("n_rows"), F.regr_slope("y", total).alias("slope"), F.regr_intercept("y", total).alias("intercept"),
        F.regr_r2("y", total).alias("sum_r2"),
        F.array(F.sum("y"), F.sum(F.col("y") * F.col("y"))).alias("ys"),
        F.array(*[F.sum(x) for x in xs]).alias("sx"), F.array(*[F.sum(x * F.col("y")) for x in xs]).alias("sxy"),
        F.array(*[F.sum(xs[i] * xs[j]) for i in range(n) for j in range(i, n)]).alias("sxx"),
    )

    return moments.select(*RULE, "n_rows", "slope", "intercept", "sum_r2", explained_share(n, "n_rows", "ys", "sx", "sxy", "sxx").alias("multi_r2"))


def explained_share(n, count, ys, sx, sxy, sxx):
    """R2 of a linear fit on n columns, from their moments, as a column expression; null where y does not vary.

    The centred moments of the columns and of y are one symmetric matrix, kept as a flat array. Eliminating a column takes
    out of every other what it explains; what is left of y in the end is the residual. The largest remaining pivot goes
    first, and a column whose remaining square is under 1e-10 of its own is a combination of the others and is passed.
    """
    wide, c = n + 1, F.col
    upper = [(i, j) for i in range(n) for j in range(i, n)]
    at = {pair: k for k, pair in enumerate(upper)}

    def cell(i, j):
        i, j = min(i, j), max(i, j)
        if j < n:
            return c(sxx)[at[i, j]] - c(sx)[i] * c(sx)[j] / c(count)
        return c(ys)[1] - c(ys)[0] * c(ys)[0] / c(count) if i == n else c(sxy)[i] - c(sx)[i] * c(ys)[0] / c(count)

    matrix = F.array(*[cell(i, j) for i in range(wide) for j in range(wide)])
    places = F.sequence(F.lit(0), F.lit(wide * wide - 1))
    least = F.array(*[F.greatest(1e-10 * cell(i, i), F.lit(1e-300)) for i in range(n)])

    def eliminate(state):
        m, left = state["m"], state["left"]
        best = F.array_max(F.transform(left, lambda i: F.struct(F.get(m, i * wide + i).alias("v"), (-i).alias("i"))))
        k = -best["i"]
        pivot = best["v"]
        cleared = F.transform(places, lambda p: F.get(m, p) - F.get(m, F.floor(p / wide).cast("int") * wide + k) * F.get(m, k * wide + p % wide) / pivot)
        return F.struct(F.when(pivot > F.get(least, k), cleared).otherwise(m).alias("m"), F.array_remove(left, k).alias("left"))

    start = F.struct(matrix.alias("m"), F.sequence(F.lit(0), F.lit(n - 1)).alias("left"))
    rest = F.get(F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, lambda state, _: eliminate(state))["m"], F.lit(wide * wide - 1))
    whole = cell(n, n)
    return F.when(whole > 0, 1 - F.greatest(rest, F.lit(0.0)) / whole)


def exact_forbidden(peptides, alpha=0.2, threshold=K.FORBIDDEN_THRESHOLD):
    """Forbidden residues by Barnard's test: residues never seen in passing peptides, alone or as a group."""
    c = F.col
    at = peptides.select("passes", F.posexplode(S.residues(c("seq"))).alias("_i", "aa"))
    n = at.groupBy((c("_i") + 1).alias("pos"), "aa").agg(F.count_if("passes").alias("n_pass"), F.count_if(~c("passes")).alias("n_fail"))
    stats = n.withColumns({"rule_class": F.lit("All"), "rule_pos": F.lit(0), "n_ranked": F.lit(0), "rank_sum": F.lit(0.0), "tie_sum": F.lit(0)})
    x = contrasts(stats).filter((c("n_pass") == 0) & (c("n_fail") > 0))
    rest_pass, rest_fail = c("all_pass") - c("g_pass"), c("all_fail") - c("g_fail")
    own_p = barnard_pvalue("n_pass", rest_pass, "n_fail", rest_fail)
    group_p = barnard_pvalue("g_pass", rest_pass, "g_fail", rest_fail)
    scored = x.select("pos", "aa", "n_fail", "g_pass", "g_fail", own_p.alias("p_alone"), group_p.alias("p_group"))
    group_case = (c("g_pass") == 0) & (c("p_group") <= alpha) & (c("g_fail") >= threshold)
    return scored.withColumn("forbidden", F.coalesce(c("p_alone") <= alpha, F.lit(False)) | F.coalesce(group_case, F.lit(False)))


def any_forbidden(peptides, matrix):
    """True for a peptide with a forbidden residue at any position. ``matrix`` has pos, aa, forbidden."""
    at = peptides.select("peptide_id", F.posexplode(S.residues(F.col("seq"))).alias("_i", "aa")).withColumn("pos", F.col("_i") + 1)
    hit = at.join(F.broadcast(matrix.select("pos", "aa", "forbidden")), ["pos", "aa"], "left")
    return hit.groupBy("peptide_id").agg(F.bool_or(F.coalesce(F.col("forbidden") > 0, F.lit(False))).alias("forbidden"))


def signal_points(signal, midpoint=None, k=1.0, top=1.0, thresholds=None, constant=None):
    """Points of a peptide: a sigmoid through the origin, the last threshold reached, or a constant."""
    if constant is not None:
        return F.lit(float(constant))
    if thresholds is not None:
        out = F.lit(0.0)
        for limit, points in sorted(thresholds):
            out = F.when(signal >= limit, F.lit(float(points))).otherwise(out)
        return out
    at_zero = top / (1 + F.exp(F.lit(k * midpoint)))
    return top / (1 + F.exp(-k * (signal - midpoint))) - at_zero


def additive_matrix(peptides, points):
    at = peptides.select(points.alias("points"), F.posexplode(S.residues(F.col("seq"))).alias("_i", "aa"))
    return at.groupBy((F.col("_i") + 1).alias("pos"), "aa").agg(F.sum("points").alias("value"))


def always_allowed(matrix, allowed, value="value"):
    """Listed residues get the value 1 at their position."""
    out = F.col(value)
    for pos, letters in allowed.items():
        out = F.when((F.col("pos") == pos) & F.col("aa").isin(*letters), 1.0).otherwise(out)
    return matrix.withColumn(value, out)
