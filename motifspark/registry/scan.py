from pyspark.sql import functions as F

from motifspark import fixtures as fx
from motifspark.functions import sequence as S
from motifspark.functions.classical import classical_score
from motifspark.operators import scan
from motifspark.registry import q6, r6, register
from motifspark.registry.sql import CLASSICAL, HITS, WINDOWS, classical_sql


@register("g01_tm_masking", f"""
WITH {fx.PROTEIN_SQL}, {fx.TM_SQL},
piece AS (
  SELECT t.protein_id, t.b, substr(seq, CAST(coalesce(lag(e) OVER w, 0) + 1 AS BIGINT),
         CAST(t.b - 1 - coalesce(lag(e) OVER w, 0) AS BIGINT)) AS part,
         max(e) OVER (PARTITION BY t.protein_id) AS last_end
  FROM tm t JOIN protein USING (protein_id)
  WINDOW w AS (PARTITION BY t.protein_id ORDER BY t.b)),
joined AS (SELECT protein_id, string_agg(part, 'X' ORDER BY b) AS head, max(last_end) AS last_end FROM piece GROUP BY 1)
SELECT p.protein_id, length(coalesce(head || 'X' || substr(seq, CAST(last_end + 1 AS BIGINT)), seq)) AS n,
       coalesce(head || 'X' || substr(seq, CAST(last_end + 1 AS BIGINT)), seq) AS masked
FROM protein p LEFT JOIN joined USING (protein_id)""")
def g01(spark, sf):
    out = scan.mask_transmembrane(fx.proteins(spark, sf), fx.tm_ranges(spark, sf))
    return out.select("protein_id", F.length("seq").alias("n"), F.col("seq").alias("masked"))


@register("g02_valid_sequences", f"""
WITH {fx.PROTEIN_SQL}, starred AS (
  SELECT protein_id, CASE protein_id % 3 WHEN 0 THEN seq || '*' WHEN 1 THEN seq || '*K' ELSE seq END AS seq FROM protein)
SELECT protein_id, length(regexp_replace(seq, '\\*$', '')) AS n FROM starred
WHERE length(seq) >= 15 AND NOT contains(left(seq, length(seq) - 1), '*')""")
def g02(spark, sf):
    kind = F.col("protein_id") % 3
    starred = fx.proteins(spark, sf).withColumn(
        "seq", F.when(kind == 0, F.concat("seq", F.lit("*"))).when(kind == 1, F.concat("seq", F.lit("*K"))).otherwise(F.col("seq"))
    )
    return scan.valid_sequences(starred).select("protein_id", F.length("seq").alias("n"))


@register("g03_sliding_windows", f"""
WITH {WINDOWS} SELECT protein_id, count(*) AS n, max(pos) AS last_pos, min(motif) AS least, max(motif) AS greatest,
  count(DISTINCT motif) AS kinds FROM wnd GROUP BY 1""")
def g03(spark, sf):
    return scan.all_windows(fx.proteins(spark, sf), together=("protein_id",)).groupBy("protein_id").agg(
        F.count("*").alias("n"), F.max("pos").alias("last_pos"), F.min("motif").alias("least"),
        F.max("motif").alias("greatest"), F.countDistinct("motif").alias("kinds"),
    )


@register("g04_position_rules", f"""
WITH {WINDOWS} SELECT protein_id, pos, motif FROM wnd
WHERE substr(motif, 8, 1) IN ('F','Y') AND substr(motif, 10, 1) IN ('D','E','S','T')
  AND contains('AVILMFYWSTHNQCGP', substr(motif, 11, 1))""")
def g04(spark, sf):
    return scan.all_windows(fx.proteins(spark, sf)).filter(S.satisfies_rules(F.col("motif"))).select(
        "protein_id", "pos", "motif"
    )


@register("g05_candidate_windows", f"WITH {HITS} SELECT protein_id, ord, motif FROM cand")
def g05(spark, sf):
    return scan.candidate_windows(fx.proteins(spark, sf))


@register("k01_classical_single", f"""
WITH {fx.PEPTIDE_SQL}, cut AS (SELECT peptide_id, substr(translate(seq, 'BJO', 'STY'), 1, CAST(13 + peptide_id % 3 AS BIGINT)) AS motif
  FROM peptide), {CLASSICAL}
SELECT peptide_id, motif, {q6(classical_sql("motif"))} AS score FROM cut, ctab""")
def k01(spark, sf):
    cut = fx.peptides(spark, sf).select(
        "peptide_id", F.substring(S.plain(F.col("seq")), F.lit(1), (F.col("peptide_id") % 3 + 13).cast("int")).alias("motif")
    )
    return cut.select("peptide_id", "motif", r6(classical_score(F.col("motif"), min_length=13)).alias("score"))


@register("k02_classical_many", f"""
WITH {fx.PEPTIDE_SQL}, {CLASSICAL}
SELECT peptide_id, CASE WHEN isinf({classical_sql("seq")}) THEN NULL ELSE {q6(classical_sql("seq"))} END AS score,
  isinf({classical_sql("seq")}) AS unknown FROM peptide, ctab""")
def k02(spark, sf):
    score = classical_score(F.col("seq"))
    return fx.peptides(spark, sf).select(
        "peptide_id", r6(F.when(score != float("inf"), score)).alias("score"), (score == float("inf")).alias("unknown")
    )


@register("k03_classical_top_k", f"""
WITH {WINDOWS}, {CLASSICAL},
scored AS (SELECT protein_id, pos, motif, {classical_sql("motif")} AS score FROM wnd, ctab),
top AS (SELECT *, row_number() OVER (PARTITION BY protein_id ORDER BY round(score, 9), pos) AS rank FROM scored),
grid AS (SELECT protein_id, unnest([1, 2, 3]) AS rank FROM protein)
SELECT g.protein_id, g.rank, coalesce(t.motif, '') AS motif,
  CASE WHEN t.motif IS NULL OR isinf(score) THEN 9999 ELSE {q6("score")} END AS score
FROM grid g LEFT JOIN top t ON t.protein_id = g.protein_id AND t.rank = g.rank""")
def k03(spark, sf):
    out = scan.classical_hits(fx.proteins(spark, sf))
    return out.withColumn("score", F.when(F.col("score") == float("inf"), 9999.0).otherwise(r6(F.col("score"))))


@register("scan_rule_hits", f"WITH {HITS} SELECT protein_id, rank, motif, {q6('score')} AS score FROM hit")
def rule_hits(spark, sf):
    return scan.rule_hits(fx.proteins(spark, sf)).select("protein_id", "rank", "motif", r6(F.col("score")).alias("score"))
