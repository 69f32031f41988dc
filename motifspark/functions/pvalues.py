"""p-values on small aggregated tables, as Arrow batches."""

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _betacf(a, b, x):
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_inc(a, b, x):
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1 - x) / b


def student_p(t, df):
    """Two-sided p of Student's t."""
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return None
    return 0.0 if math.isinf(t) else beta_inc(df / 2, 0.5, df / (df + t * t))


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([student_p(a, b) for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(DoubleType())
def z_pvalue(z: pd.Series) -> pd.Series:
    return pd.Series([math.erfc(abs(v) / math.sqrt(2)) if v == v else None for v in z], dtype="float64")


#: Standard deviations around its mean beyond which a binomial count is left out; their weight is below the smallest double.
REACH = 40
#: Counts of a column up to which the borders of its tails are kept instead of found again.
KEPT = 1 << 17


def _binomial(n, p):
    """First count, and probabilities from there, of a binomial distribution as far as they are not zero."""
    import numpy as np

    spread = REACH * (math.sqrt(n * p * (1 - p)) + 1)
    x = np.arange(max(0, int(n * p - spread)), min(n, int(n * p + spread) + 1) + 1)
    # ratios of neighbours, summed from the mode outwards, do not lose digits as differences of log-gammas do
    step = np.log((n - x[:-1]) / (x[:-1] + 1)) + math.log(p) - math.log1p(-p)
    log = np.concatenate([[0.0], np.cumsum(step)])
    f = np.exp(log - log.max())
    return x[0], f / f.sum()


def barnard_p(a, b, c, d):
    """Two-sided Barnard test of the table [[a, b], [c, d]] with the pooled score statistic, exact at every size.

    For a fixed count in the first column the statistic falls with the count in the second, so that the tables at least
    as extreme are two tails of the second column; their weight comes from running totals of its probabilities. The
    nuisance parameter takes 64 values.
    """
    import numpy as np

    n1, n2 = int(a + c), int(b + d)
    if n1 == 0 or n2 == 0:
        return None

    def stat(x1, x2):
        p = (x1 + x2) / (n1 + n2)
        var = p * (1 - p) * (1 / n1 + 1 / n2)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(var > 0, (x1 / n1 - x2 / n2) / np.sqrt(np.where(var > 0, var, 1)), 0.0)

    own = abs(float(stat(np.float64(a), np.float64(b)))) - 1e-9
    if own <= 0:
        return 1.0

    def below(x1, least):
        """How many counts of the second column, from 0 on, have a statistic of `least` or more."""
        low, high = np.zeros(len(x1), np.int64), np.full(len(x1), n2 + 1)
        while (low < high).any():
            middle = (low + high) // 2
            good = (low < high) & (stat(x1.astype(float), np.minimum(middle, n2).astype(float)) >= least)
            low, high = np.where(good, middle + 1, low), np.where((low < high) & ~good, middle, high)
        return low

    def borders(x1):
        return below(x1, own), below(x1, np.nextafter(-own, 0))

    known = borders(np.arange(n1 + 1)) if n1 < KEPT else None  # the same for every value of the nuisance parameter
    best = 0.0
    for p in np.linspace(0.0, 1.0, 66)[1:-1]:
        at1, f1 = _binomial(n1, p)
        at2, f2 = _binomial(n2, p)
        x1 = at1 + np.arange(len(f1))
        total = np.concatenate([[0.0], np.cumsum(f2)])
        low, high = (b[x1] for b in known) if known else borders(x1)
        few = total[np.clip(low - at2, 0, len(f2))]
        many = 1.0 - total[np.clip(high - at2, 0, len(f2))]
        best = max(best, float(f1 @ (few + many)))
    return min(best, 1.0)


@F.pandas_udf(DoubleType())
def barnard_pvalue(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([barnard_p(*row) for row in zip(a, b, c, d)], dtype="float64")
