from pyspark.sql import functions as F

from motifspark import constants as K
from motifspark import fixtures as fx
from motifspark.functions import sequence as S
from motifspark.registry import q6, r6, register
from motifspark.registry.sql import sql_list

CLASS_SQL = "CASE " + " ".join(
    f"WHEN {{0}} IN ({', '.join(repr(a) for a in aas)}) THEN '{name}'" for name, aas in reversed(K.CHEMICAL_CLASSES.items())
) + " END"


@register("q01_length_check", f"""
WITH {fx.PEPTIDE_SQL} SELECT min(length(seq)) AS shortest, max(length(seq)) AS longest, count(*) AS n,
  count(*) FILTER (WHERE length(seq) = 15) AS fitting FROM peptide""")
def q01(spark, sf):
    p = fx.peptides(spark, sf).withColumn("seq", S.check_length(F.col("seq")))
    return p.agg(F.min(F.length("seq")).alias("shortest"), F.max(F.length("seq")).alias("longest"),
                 F.count("*").alias("n"), F.count_if(F.length("seq") == 15).alias("fitting"))


@register("q02_unravel", f"""
WITH {fx.PEPTIDE_SQL}, u AS (SELECT peptide_id, seq, unnest(range(1, 16)) AS pos FROM peptide)
SELECT peptide_id, pos, substr(seq, pos, 1) AS aa FROM u""")
def q02(spark, sf):
    return fx.peptides(spark, sf).select("peptide_id", F.posexplode(S.residues(F.col("seq"))).alias("pos", "aa")).select(
        "peptide_id", (F.col("pos") + 1).alias("pos"), "aa"
    )


@register("q03_phospho_to_plain", f"WITH {fx.PEPTIDE_SQL} SELECT peptide_id, replace(replace(replace(seq,'B','S'),'J','T'),'O','Y') AS seq FROM peptide")
def q03(spark, sf):
    return fx.peptides(spark, sf).select("peptide_id", S.plain(F.col("seq")).alias("seq"))


@register("q04_residue_columns", f"WITH {fx.PEPTIDE_SQL} SELECT peptide_id, "
          + ", ".join(f"substr(seq, {i}, 1) AS \"#{i}\"" for i in range(1, 16)) + " FROM peptide")
def q04(spark, sf):
    return fx.peptides(spark, sf).select("peptide_id", *S.residue_columns(F.col("seq")))


@register("q05_class_encoding", f"""
WITH {fx.PEPTIDE_SQL}, u AS (SELECT peptide_id, unnest(range(1, 16)) AS pos, seq FROM peptide)
SELECT {CLASS_SQL.format("substr(seq, pos, 1)")} AS class, pos, count(*) AS n FROM u GROUP BY 1, 2""")
def q05(spark, sf):
    u = fx.peptides(spark, sf).select(F.posexplode(S.residues(F.col("seq"))).alias("pos", "aa"))
    return u.groupBy(S.class_of(F.col("aa")).alias("class"), (F.col("pos") + 1).alias("pos")).agg(F.count("*").alias("n"))


@register("q06_neighbour_classes", f"""
WITH {fx.PEPTIDE_SQL}, u AS (SELECT peptide_id, unnest(range(1, 16)) AS pos, seq FROM peptide),
aa AS (SELECT *, substr(seq, pos, 1) AS aa FROM u)
SELECT pos, {CLASS_SQL.format("coalesce(l, aa)")} AS left_class, {CLASS_SQL.format("coalesce(r, aa)")} AS right_class,
  count(*) AS n
FROM (SELECT *, lag(aa) OVER w AS l, lead(aa) OVER w AS r FROM aa WINDOW w AS (PARTITION BY peptide_id ORDER BY pos))
GROUP BY 1, 2, 3""")
def q06(spark, sf):
    pairs = []
    for i in range(1, K.MOTIF_LENGTH + 1):
        left, right = S.neighbours(F.col("seq"), i)
        pairs.append(F.struct(F.lit(i).alias("pos"), S.class_of(left).alias("l"), S.class_of(right).alias("r")))
    return fx.peptides(spark, sf).select(F.explode(F.array(*pairs)).alias("p")).groupBy(
        F.col("p.pos").alias("pos"), F.col("p.l").alias("left_class"), F.col("p.r").alias("right_class")
    ).agg(F.count("*").alias("n"))


@register("q07_uncertain_residues", f"""
WITH {fx.PROTEIN_SQL} SELECT protein_id, length(replace(seq, 'U', '')) AS n_not_u, length(replace(seq, 'X', '')) AS n_not_x,
  replace(replace(seq, 'U', 'C'), 'X', 'G') AS seq FROM protein""")
def q07(spark, sf):
    return fx.proteins(spark, sf).select(
        "protein_id", F.length(F.replace("seq", F.lit("U"), F.lit(""))).alias("n_not_u"),
        F.length(F.replace("seq", F.lit("X"), F.lit(""))).alias("n_not_x"),
        S.substitute_uncertain(F.col("seq")).alias("seq"),
    )


SCALES = S.residue_scales()


def _scale_sum(values):
    return q6("(SELECT sum(" + sql_list(values, 0) + "::DOUBLE[][ascii(substr(seq, i, 1)) - 64]) FROM range(1, 16) t(i))")


@register("q08_feature_encoding", f"""
WITH {fx.PEPTIDE_SQL}, tabs AS (SELECT {", ".join(f"{sql_list(v, 0)}::DOUBLE[] AS {k}" for k, v in SCALES.items())}),
u AS (SELECT peptide_id, unnest(range(1, 16)) AS pos, seq FROM peptide)
SELECT peptide_id, CAST(240 AS BIGINT) AS width, {", ".join(f"{q6(f'sum(pos * {k}[ascii(substr(seq, pos, 1)) - 64])')} AS {k}" for k in SCALES)}
FROM u, tabs GROUP BY 1""")
def q08(spark, sf):
    enc = fx.peptides(spark, sf).select("peptide_id", S.encode(F.col("seq")).alias("f"))

    def weighted(j):
        return sum((i * F.col("f")[15 * j + i - 1] for i in range(1, 16)), F.lit(0.0))

    return enc.select("peptide_id", F.size("f").cast("long").alias("width"),
                      *[r6(weighted(j)).alias(name) for j, name in enumerate(SCALES)])


@register("q09_ordinal_suffix", """
SELECT event_id, CAST(event_id AS VARCHAR) || CASE event_id % 10 WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END AS label
FROM events""")
def q09(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", S.ordinal_column(F.col("event_id")).alias("label"))


@register("q10_finite_descending", """
WITH v AS (SELECT event_id, user_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value FROM events)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place
FROM v WHERE value IS NOT NULL""")
def q10(spark, sf):
    from motifspark.operators.running import finite_descending

    v = fx.table(spark, sf, "events").withColumn(
        "value", F.when(F.col("event_id") % 10 == 0, F.lit(float("inf"))).when(F.col("event_id") % 5 == 0, F.lit(float("nan")))
        .otherwise(F.col("value"))
    )
    return finite_descending(v, ["user_id"], "value", "event_id").select("user_id", "event_id", "place")
