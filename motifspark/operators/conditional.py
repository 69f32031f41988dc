"""Conditional scoring: the value of a residue is looked up in the matrices of its two neighbours' classes.

The trained matrices are a bounded table (9 classes x 15 positions x 20 residues x 15 positions). They become tables by
two neighbouring residues, which an Arrow function looks up for all sequences of a batch at once.
"""

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from motifspark import constants as K
from motifspark.functions import sequence as S

N, AA = K.MOTIF_LENGTH, len(K.RESIDUES)
CLASSES = list(K.CHEMICAL_CLASSES)
CLASS_NO = [max(i for i, c in enumerate(CLASSES) if aa in K.CHEMICAL_CLASSES[c]) for aa in K.RESIDUES]


@dataclass
class ConditionalModel:
    """Matrices per kind as arrays [class, rule position, residue, position], plus scalar parameters."""

    matrices: dict
    method: str = "ps"
    threshold: float = 0.0
    coefficients: dict = field(default_factory=dict)
    suppressed: tuple = K.SUPPRESSED_FORBIDDEN
    disqualifying: str = "forbidden"
    mode: str = "mean"  # of the two lookups of a residue; "sum" adds them

    @classmethod
    def from_pwm(cls, pwm, kinds=("positive", "suboptimal", "forbidden"), **params):
        """Reads the matrices once; their size is fixed by the alphabet, not by the data."""
        rows = pwm.select(
            F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("rule_class")).alias("c"), "rule_pos",
            F.expr(f"instr('{K.RESIDUES}', aa)").alias("a"),
            "pos", *kinds,
        ).toPandas()
        at = tuple(rows[k].to_numpy(dtype=int) - 1 for k in ("c", "rule_pos", "a", "pos"))
        out = {}
        for kind in kinds:
            m = np.zeros((len(CLASSES), N, AA, N))
            m[at] = rows[kind].to_numpy(dtype=float)
            out[kind] = m
        return cls(out, **params)

    def sides(self, kind):
        """Left and right tables [position, neighbour residue, residue], each worth half of the mean."""
        share = {"mean": 2, "sum": 1}[self.mode]
        m = self.matrices[kind]
        left = np.stack([m[:, max(j - 1, 0), :, j][CLASS_NO] for j in range(N)]) / share
        right = np.stack([m[:, min(j + 1, N - 1), :, j][CLASS_NO] for j in range(N)]) / share
        return left, right

    def position_scores(self, seq, kind):
        """One column per position."""
        left, right = self.sides(kind)
        o = [_ordinal(seq, i) for i in range(1, N + 1)]
        return [
            _table(left[j])[o[max(j - 1, 0)] * (AA + 1) + o[j]] + _table(right[j])[o[min(j + 1, N - 1)] * (AA + 1) + o[j]]
            for j in range(N)
        ]

    def pair_tables(self, kind, suppress=()):
        """Tables [position, residue, next residue] whose lookups add up to the score of a kind."""
        left, right = (t.copy() for t in self.sides(kind))
        for pos in suppress:
            left[pos - 1] = right[pos - 1] = 0
        pairs = [right[j].T + left[j + 1] for j in range(N - 1)]
        pairs[0] = pairs[0] + np.diag(left[0])[:, None]
        pairs[-1] = pairs[-1] + np.diag(right[N - 1])[None, :]
        return np.stack(pairs)

    def total_score(self, seq, kind, suppress=()):
        """Sum over positions as one lookup per adjacent pair of residues."""
        return _sums({kind: self.pair_tables(kind, suppress)})(seq)[kind]

    def standardized(self, kind, column):
        a, b = self.coefficients.get(kind, (0.0, 1.0))
        return (column - a) / b

    def score(self, df, seq="motif", strict=False):
        """Adds binding, positive, suboptimal, forbidden, total and call for the sequences of a column."""
        s = F.col(seq)
        if strict:
            bad = F.raise_error(F.concat(F.lit("residue without matrix row in "), s)).cast("string")
            s = F.when(F.rlike(s, F.lit(f"[^{K.RESIDUES}]")), bad).otherwise(s)
        kinds = ["positive", "suboptimal"] + (["binding"] if "binding" in self.matrices else [])
        tables = {k: self.pair_tables(k) for k in kinds} | {"forbidden": self.pair_tables("forbidden", self.suppressed)}
        if self.disqualifying != "forbidden":
            tables["banned"] = self.pair_tables(self.disqualifying, self.suppressed)
        out = df.withColumn("_sums", _sums(tables)(s))
        banned = F.col("_sums")["banned" if "banned" in tables else "forbidden"] > 0
        out = out.withColumns({f"_{k}": F.col("_sums")[k] for k in kinds} | {"forbidden": F.col("_sums.forbidden"), "_banned": banned})
        binding = F.col("_binding") if "binding" in self.matrices else F.col("_positive")
        total = {"ps": F.col("_positive") - F.col("_suboptimal"), "wps": binding - F.col("_suboptimal"),
                 "suboptimal": -F.col("_suboptimal")}[self.method]
        c = self.standardized
        out = out.withColumns({
            "total": F.when(~F.col("_banned"), c("total", total)), "binding": c("binding", binding),
            "positive": c("positive", F.col("_positive")), "suboptimal": c("suboptimal", F.col("_suboptimal")),
        })
        return out.drop("_sums", "_banned", *[f"_{k}" for k in kinds]).withColumn(
            "call", F.coalesce(F.round("total", 9) >= self.threshold, F.lit(False))
        )


def _ordinal(seq, pos):
    table = S.letter_table({aa: i for i, aa in enumerate(K.RESIDUES)}, AA)
    return table[S.letter_index(S.residue_at(seq, pos))].cast("int")


def _table(values):
    """Array literal of a residue-by-residue table; the extra row and column for other letters are NaN."""
    full = np.full((AA + 1, AA + 1), np.nan)
    full[:AA, :AA] = values
    return F.split(F.lit(",".join(repr(float(v)) if v == v else "NaN" for v in full.ravel())), ",").cast("array<double>")


def _sums(tables):
    """Function of a sequence column: a struct with the sum of each set of pair tables over the first residues.

    Null for sequences with other letters; a known sequence that is too short is an error.
    """
    used = {k: [(j, t[j].ravel()) for j in range(N - 1) if np.any(t[j])] for k, t in tables.items()}
    code = np.full(256, AA, np.uint8)
    code[[ord(aa) for aa in K.RESIDUES]] = np.arange(AA)

    def sums(column: pa.Array) -> pa.Array:
        texts = column.to_pylist()
        raws = [b"" if t is None else t.encode() for t in texts]
        size = np.fromiter(map(len, raws), np.int64, len(raws))
        letters = code[np.frombuffer(b"".join(raws), np.uint8)]
        end = np.cumsum(size)
        other = np.concatenate([[0], np.cumsum(letters == AA)])
        known = (other[end] == other[end - size]) & np.fromiter((t is not None for t in texts), bool, len(texts))
        short = np.flatnonzero(known & (size < N))
        if len(short):
            raise ValueError(f"sequence of fewer than {N} residues: {texts[short[0]]}")
        begin = (end - size)[known]
        at = [letters[begin + j].astype(np.intp) for j in range(N)]
        pair = [at[j] * AA + at[j + 1] for j in range(N - 1)]
        columns = []
        for terms in used.values():
            total = np.zeros(len(begin))
            for j, values in terms:
                total += values[pair[j]]
            full = np.zeros(len(texts))
            full[known] = total
            columns.append(pa.array(full, mask=~known))
        return pa.StructArray.from_arrays(columns, names=list(used))

    return F.arrow_udf(sums, ", ".join(f"{k} double" for k in used))


def score_by_join(peptides, pwm, kinds=("positive", "suboptimal", "forbidden"), key="peptide_id"):
    """The same scores from their definition: two joins per residue. For checks; the array form is the scan."""
    at = peptides.select(key, F.posexplode(S.residues(F.col("seq"))).alias("_i", "aa"), F.col("seq")).withColumn("pos", F.col("_i") + 1)
    lp, rp = F.greatest(F.col("pos") - 1, F.lit(1)), F.least(F.col("pos") + 1, F.lit(N))
    both = at.select(key, "pos", "aa", F.explode(F.array(lp, rp)).alias("rule_pos"), "seq")
    both = both.withColumn("rule_class", S.class_of(F.substring(F.col("seq"), F.col("rule_pos"), F.lit(1))))
    hit = both.join(F.broadcast(pwm), ["rule_class", "rule_pos", "pos", "aa"])
    return hit.groupBy(key).agg(*[(F.sum(k) / 2).alias(k) for k in kinds])


def minmax_coefficients(scored, kinds=("total", "positive", "suboptimal", "binding")):
    """Per kind a = min and b = max(x - a); b is 1 where it would be 0, except for the total."""
    def pair(k):
        a, b = F.min(k), F.max(k) - F.min(k)
        return F.struct(F.lit(k).alias("kind"), a.alias("a"), (b if k == "total" else F.when(b == 0, 1.0).otherwise(b)).alias("b"))

    return scored.agg(F.array(*[pair(k) for k in kinds]).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def exponential_fit(df, y, x, rates):
    """Best R2 of y = a exp(b x) - d over a grid of b; for each b the fit is linear."""
    tried = df.select(y, x, F.explode(F.array(*[F.lit(float(b)) for b in rates])).alias("b"))
    e = F.exp(F.col("b") * F.col(x))
    fits = tried.groupBy("b").agg(F.regr_r2(y, e).alias("r2"), F.regr_slope(y, e).alias("a"), (-F.regr_intercept(y, e)).alias("d"))
    best = F.struct(F.round("r2", 9), -F.abs("b"))
    return fits.agg(F.max_by(F.struct("b", "a", "d", "r2"), best).alias("f")).select("f.*")


def sigmoid_fit(df, y, x, steepness, midpoints):
    """Best R2 of y = L / (1 + exp(-k (x - x0))) + c over a grid of (k, x0); for each pair the fit is linear."""
    grid = F.array(*[F.struct(F.lit(float(k)).alias("k"), F.lit(float(m)).alias("x0")) for k in steepness for m in midpoints])
    tried = df.select(y, x, F.explode(grid).alias("g")).select(y, x, "g.*")
    s = 1 / (1 + F.exp(-F.col("k") * (F.col(x) - F.col("x0"))))
    fits = tried.groupBy("k", "x0").agg(F.regr_r2(y, s).alias("r2"), F.regr_slope(y, s).alias("height"), F.regr_intercept(y, s).alias("base"))
    best = F.struct(F.round("r2", 9), -F.col("k"), -F.col("x0"))
    return fits.agg(F.max_by(F.struct("k", "x0", "height", "base", "r2"), best).alias("f")).select("f.*")
