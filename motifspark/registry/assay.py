from pyspark.sql import functions as F

from motifspark import fixtures as fx
from motifspark.operators import assay as A
from motifspark.operators.running import percentiles
from motifspark.registry import q6, r6, register

B, N, CTRL = list(fx.BAITS), fx.CONTROL_BAIT, fx.CONTROL_PEPTIDES
INDEX, MULT = 1.0, 1.0

CALLS = f"""{fx.ASSAY_SQL},
control AS (SELECT dataset, bait, avg(bas) AS control FROM assay WHERE peptide_id IN (0, 1) GROUP BY 1, 2),
calls AS (
  SELECT a.dataset, peptide_id, bait,
    CASE WHEN bool_and(coalesce(call_index >= 1.0, false) AND coalesce(bas >= 0.05 * control, false)) THEN 'Pass' ELSE '' END AS call
  FROM assay a LEFT JOIN control USING (dataset, bait) GROUP BY 1, 2, 3)"""

MEANS = f"""{CALLS},
m AS (SELECT dataset, peptide_id, avg(bas) FILTER (WHERE bait = 'A') AS a, avg(bas) FILTER (WHERE bait = 'R') AS r,
        avg(bas) FILTER (WHERE bait = 'N') AS n FROM assay GROUP BY 1, 2),
c AS (SELECT dataset, peptide_id, bool_or(bait = 'A' AND call = 'Pass') AS pa, bool_or(bait = 'R' AND call = 'Pass') AS pr
      FROM calls GROUP BY 1, 2)"""

LFC = "(log2(greatest({0}, 0) + 0.01) - log2(greatest({1}, 0) + 0.01))"
PAIRS = f"""{MEANS},
pair AS (
  SELECT dataset, peptide_id, 'A_R' AS pair,
    CASE WHEN (pa OR pr) AND (coalesce(a > n, false) OR coalesce(r > n, false)) AND a IS NOT NULL AND r IS NOT NULL
         THEN {LFC.format('a', 'r')} END AS log2fc FROM m JOIN c USING (dataset, peptide_id)
  UNION ALL
  SELECT dataset, peptide_id, 'R_A' AS pair,
    CASE WHEN (pa OR pr) AND (coalesce(a > n, false) OR coalesce(r > n, false)) AND a IS NOT NULL AND r IS NOT NULL
         THEN {LFC.format('r', 'a')} END AS log2fc FROM m JOIN c USING (dataset, peptide_id))"""


def calls_of(cells):
    return A.positive_calls(cells, CTRL, 0.05, INDEX)


def pairs_of(cells):
    return A.conditional_log2fc(cells, calls_of(cells), B, N, MULT)


@register("a01_coordinate_cutoff", f"""
WITH {fx.SPOT_SQL} SELECT spot_id, l_linenumber, coord FROM spot
WHERE (substr(coord, 1, 1) < 'R' OR (substr(coord, 1, 1) = 'R' AND CAST(substr(coord, 2) AS INT) <= 12))
  AND coord NOT IN ('A1', 'C3')""")
def a01(spark, sf):
    return A.drop_coordinates(fx.spots(spark, sf), "R12", ("A1", "C3")).select("spot_id", "l_linenumber", "coord")


WIDE_COLS = [(b, c, v) for b in B for c in ("F", "O") for v in ("raw", "bas", "call_index")]


@register("a02_spots_wide", f"""
WITH {fx.ASSAY_SQL} SELECT peptide_id, {", ".join(
    f"{q6(f'''max({v}) FILTER (WHERE bait = '{b}' AND copy = '{c}')''')} AS \"{b}_Copy-{c}_{v}\"" for b, c, v in WIDE_COLS)}
FROM assay GROUP BY 1""")
def a02(spark, sf):
    wide = A.widen_spots(fx.assay(spark, sf), B, ["F", "O"])
    return wide.select("peptide_id", *[r6(F.col(f"`{c}`")).alias(c) for c in wide.columns[1:]])


@register("a03_attach_names", f"""
WITH {fx.ASSAY_SQL}, {fx.PEPTIDE_SQL} SELECT a.peptide_id, bait, copy, seq FROM assay a LEFT JOIN peptide p USING (peptide_id)""")
def a03(spark, sf):
    names = fx.peptides(spark, sf).select("peptide_id", "seq")
    return A.attach_names(fx.assay(spark, sf), names).select("peptide_id", "bait", "copy", "seq")


@register("a04_column_order", f"""
WITH {fx.ASSAY_SQL}, w AS (SELECT peptide_id, {", ".join(
    f"max(bas) FILTER (WHERE bait = '{b}' AND copy = '{c}') AS {b}{c}" for b in B for c in ("F", "O"))} FROM assay GROUP BY 1)
SELECT peptide_id, 'N_Copy-F_bas,N_Copy-O_bas,R_Copy-F_bas,R_Copy-O_bas,A_Copy-F_bas,A_Copy-O_bas' AS columns,
  {q6("coalesce(NF, NO, RF, RO, AF, AO)")} AS first_value FROM w""")
def a04(spark, sf):
    wide = A.order_columns(A.widen_spots(fx.assay(spark, sf), B, ["F", "O"], ("bas",)), [N, "R", "A"])
    cols = wide.columns[1:]
    return wide.select("peptide_id", F.lit(",".join(cols)).alias("columns"),
                       r6(F.coalesce(*[F.col(f"`{c}`") for c in cols])).alias("first_value"))


@register("a05_positive_calls", f"WITH {CALLS} SELECT dataset, peptide_id, bait, call FROM calls")
def a05(spark, sf):
    return calls_of(fx.assay(spark, sf))


@register("a06_exceeds_control", f"""
WITH {MEANS} SELECT dataset, peptide_id, 'A' AS bait, CASE WHEN a > n THEN 'Yes' ELSE '' END AS exceeds FROM m
UNION ALL SELECT dataset, peptide_id, 'R', CASE WHEN r > n THEN 'Yes' ELSE '' END FROM m""")
def a06(spark, sf):
    return A.exceeds_control(fx.assay(spark, sf), B, N, MULT)


@register("a07_concat_datasets", f"""
WITH {fx.ASSAY_SQL} SELECT dataset || '-' || peptide_id AS row_id, bait, copy, {q6("bas")} AS bas,
  CASE WHEN dataset = 0 THEN {q6("call_index")} END AS call_index FROM assay""")
def a07(spark, sf):
    cells = fx.assay(spark, sf)
    out = A.concat_datasets(cells.filter("dataset = 0"), cells.filter("dataset = 1").drop("call_index"))
    return out.select("row_id", "bait", "copy", r6(F.col("bas")).alias("bas"), r6(F.col("call_index")).alias("call_index"))


@register("a08_bait_columns", f"""
WITH {fx.ASSAY_SQL}, k AS (SELECT DISTINCT peptide_id FROM assay),
g AS (SELECT peptide_id, b AS bait, c AS copy FROM k, (VALUES ('A'), ('N'), ('R')) t(b), (VALUES ('F'), ('O')) u(c))
SELECT g.peptide_id, g.bait, g.copy, {q6("bas")} AS bas FROM g LEFT JOIN assay a USING (peptide_id, bait, copy)""")
def a08(spark, sf):
    long = A.narrow_spots(A.widen_spots(fx.assay(spark, sf), B, ["F", "O"], ("bas",)))
    return long.select("peptide_id", "bait", "copy", r6(F.col("bas")).alias("bas"))


WITHIN = f"""{fx.ASSAY_SQL},
own AS (SELECT dataset, bait, copy, avg(bas) AS own FROM assay WHERE bait <> 'N' AND peptide_id IN (0, 1) GROUP BY 1, 2, 3),
grand AS (SELECT dataset, avg(bas) AS grand FROM assay WHERE bait <> 'N' AND peptide_id IN (0, 1) GROUP BY 1)"""


@register("a09_within_dataset", f"""
WITH {WITHIN} SELECT a.dataset, peptide_id, bait, copy,
  {q6("CASE WHEN bait = 'N' THEN bas WHEN own / grand <> 0 THEN bas / (own / grand) END")} AS bas
FROM assay a LEFT JOIN own USING (dataset, bait, copy) LEFT JOIN grand USING (dataset)""")
def a09(spark, sf):
    return A.standardize_within(fx.assay(spark, sf), CTRL, N).select(
        "dataset", "peptide_id", "bait", "copy", r6(F.col("bas")).alias("bas")
    )


@register("a10_between_datasets", f"""
WITH {fx.ASSAY_SQL}, c AS (SELECT dataset, avg(greatest(bas, 0)) AS m FROM assay WHERE bait <> 'N' AND peptide_id IN (0, 1) GROUP BY 1)
SELECT a.dataset, peptide_id, bait, copy, {q6("bas * ((SELECT avg(m) FROM c) / nullif(m, 0))")} AS standardized
FROM assay a LEFT JOIN c USING (dataset)""")
def a10(spark, sf):
    return A.standardize_between(fx.assay(spark, sf), CTRL, N).select(
        "dataset", "peptide_id", "bait", "copy", r6(F.col("standardized")).alias("standardized")
    )


@register("a11_log2fc", f"""
WITH {fx.ASSAY_SQL} SELECT peptide_id, bait, copy, {q6(LFC.format("bas - 5", "raw - 30"))} AS log2fc FROM assay""")
def a11(spark, sf):
    return fx.assay(spark, sf).select(
        "peptide_id", "bait", "copy", r6(A.log2fc(F.col("bas") - 5, F.col("raw") - 30)).alias("log2fc")
    )


@register("a12_conditional_log2fc", f"WITH {PAIRS} SELECT dataset, peptide_id, pair, {q6('log2fc')} AS log2fc FROM pair")
def a12(spark, sf):
    return pairs_of(fx.assay(spark, sf)).select("dataset", "peptide_id", "pair", r6(F.col("log2fc")).alias("log2fc"))


@register("a13_one_passes", f"""
WITH {MEANS} SELECT dataset, peptide_id,
  CASE WHEN (coalesce(a > n, false) OR coalesce(r > n, false)) AND (pa OR pr) THEN 'Yes' ELSE '' END AS one_passes
FROM m JOIN c USING (dataset, peptide_id)""")
def a13(spark, sf):
    cells = fx.assay(spark, sf)
    return A.passes(cells, calls_of(cells), B, N, MULT).select("dataset", "peptide_id", "one_passes")


@register("a14_bait_passes", f"""
WITH {MEANS} SELECT dataset, peptide_id, CASE WHEN coalesce(a > n, false) AND pa THEN 'Yes' ELSE '' END AS "A_passes",
  CASE WHEN coalesce(r > n, false) AND pr THEN 'Yes' ELSE '' END AS "R_passes" FROM m JOIN c USING (dataset, peptide_id)""")
def a14(spark, sf):
    cells = fx.assay(spark, sf)
    return A.passes(cells, calls_of(cells), B, N, MULT).drop("one_passes")


MAXSIG = f"""{MEANS}, mx AS (SELECT dataset, peptide_id,
  greatest(CASE WHEN a IS NOT NULL THEN greatest(a - 0.5 * coalesce(n, 0), 0) END,
           CASE WHEN r IS NOT NULL THEN greatest(r - 0.5 * coalesce(n, 0), 0) END) AS max_signal FROM m)"""


@register("a15_max_bait_signal", f"WITH {MAXSIG} SELECT dataset, peptide_id, {q6('max_signal')} AS max_signal FROM mx")
def a15(spark, sf):
    return A.max_bait_signal(fx.assay(spark, sf), B, N, 0.5, True).select(
        "dataset", "peptide_id", r6(F.col("max_signal")).alias("max_signal")
    )


@register("a16_signal_percentiles", f"""
WITH {MAXSIG}, q AS (SELECT quantile_cont(max_signal, [{", ".join(str(p / 100) for p in range(1, 100))}]) AS v FROM mx)
SELECT unnest(range(1, 100)) AS percentile, {q6("unnest(v)")} AS value FROM q""")
def a16(spark, sf):
    out = percentiles(A.max_bait_signal(fx.assay(spark, sf), B, N, 0.5, True), "max_signal")
    return out.select("percentile", r6(F.col("value")).alias("value"))


LEAST = """SELECT dataset, peptide_id, {0} AS log2fc, CASE WHEN log2fc IS NOT NULL THEN pair END AS pair FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset, peptide_id ORDER BY log2fc IS NULL, round({1}, 9), pair) AS k FROM pair) WHERE k = 1"""


@register("a17_least_different", f"WITH {PAIRS} {LEAST.format(q6('log2fc'), 'abs(log2fc)')}")
def a17(spark, sf):
    out = A.least_different(pairs_of(fx.assay(spark, sf)))
    return out.select("dataset", "peptide_id", r6(F.col("log2fc")).alias("log2fc"), "pair")


@register("a18_least_different_signed", f"WITH {PAIRS} {LEAST.format(q6('log2fc'), 'log2fc')}")
def a18(spark, sf):
    out = A.least_different(pairs_of(fx.assay(spark, sf)), chosen=["A_R", "R_A"], signed=True)
    return out.select("dataset", "peptide_id", r6(F.col("log2fc")).alias("log2fc"), "pair")


@register("a19_row_mean", """
SELECT l_orderkey, l_linenumber, round((l_discount + l_tax + l_quantity) / 3, 6) + 0.0 AS mean FROM lineitem""")
def a19(spark, sf):
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", r6(A.row_mean("l_discount", "l_tax", "l_quantity")).alias("mean")
    )
