from pyspark.sql import Window
from pyspark.sql import functions as F

from motifspark import fixtures as fx
from motifspark.operators import homology as M
from motifspark.operators import scan
from motifspark.operators import topology as O
from motifspark.registry import q6, q9, r6, r9, register
from motifspark.registry.sql import HITS, classical_sql

SIM = "([" + ",".join(repr(v) for v in M.score_table(M.substitution_scores())) + "]::DOUBLE[])"

PAIRS = f"""{HITS},
hom AS (SELECT a.protein_id, b.lang AS taxid, b.protein_id AS homolog_id,
  row_number() OVER (PARTITION BY a.protein_id, b.lang ORDER BY b.protein_id) - 1 AS j
  FROM protein a JOIN protein b USING (hid) WHERE a.lang = 'en' AND b.lang <> 'en'),
pairs AS (SELECT h.protein_id, rank, motif, taxid, homolog_id, j FROM hit h JOIN hom USING (protein_id)),
targets AS (SELECT DISTINCT motif, homolog_id FROM pairs),
hchunk AS (SELECT protein_id AS homolog_id, c, substr(s, c * 256 + 1, 270) AS t FROM (
  SELECT protein_id, seq AS s, unnest(range(0, (length(seq) - 15) // 256 + 1)) AS c FROM protein WHERE length(seq) >= 15)),
hwnd AS (SELECT homolog_id, c * 256 + i AS pos, translate(substr(t, i, 15), 'U', 'C') AS w
  FROM (SELECT homolog_id, c, t, unnest(range(1, least(length(t) - 14, 256) + 1)) AS i FROM hchunk)),
aligned AS (SELECT motif, homolog_id, pos, w, round(({" + ".join(
    f"{SIM}[(ascii(substr(motif, {i}, 1)) - 65) * 26 + ascii(substr(w, {i}, 1)) - 64]" for i in range(1, 16))}) / 15, 9) AS s
  FROM targets JOIN hwnd USING (homolog_id)),
bestm AS (SELECT motif, homolog_id, arg_max(w, (s, -pos)) AS match, max(s) AS s FROM aligned GROUP BY 1, 2),
matched AS (SELECT p.*, coalesce(match, '') AS match, coalesce(s, 0) AS similarity,
  coalesce(({" + ".join(f"(substr(p.motif, {i}, 1) = substr(match, {i}, 1))::INT" for i in range(1, 16))}) / 15, 0) AS identity
  FROM pairs p LEFT JOIN bestm b ON b.motif = p.motif AND b.homolog_id = p.homolog_id),
ready AS (SELECT *, substr(match, 8, 1) IN ('F','Y') AND substr(match, 10, 1) IN ('D','E','S','T')
    AND match <> '' AND contains('AVILMFYWSTHNQCGP', substr(match, 11, 1)) AS valid, replace(replace(match, 'U', 'C'), 'X', 'G') AS sub FROM matched),
scm AS (SELECT r.*, CASE WHEN valid THEN {classical_sql("sub")} END AS score FROM ready r, ctab),
bh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY protein_id, rank, taxid ORDER BY valid DESC, round(similarity, 9) DESC, j) AS k FROM scm) WHERE k = 1)"""


def homologs(proteins):
    """Host protein, species and homolog number, from shared groups; sequences are attached later."""
    ids = proteins.select("protein_id", "hid", "lang")
    host = ids.filter("lang = 'en'").select("protein_id", "hid")
    other = ids.filter("lang <> 'en'").select("hid", F.col("lang").alias("taxid"), F.col("protein_id").alias("homolog_id"))
    w = Window.partitionBy("protein_id", "taxid").orderBy("homolog_id")
    return host.join(other, "hid").withColumn("j", F.row_number().over(w) - 1).drop("hid")


def pairs(spark, sf):
    p = fx.proteins(spark, sf)
    hits = scan.rule_hits(p).select("protein_id", "rank", "motif")
    return M.motif_homolog_pairs(hits, homologs(p))


def matched(spark, sf):
    return M.best_match(M.attach_targets(pairs(spark, sf), fx.proteins(spark, sf))).drop("target")


def scored(spark, sf):
    return M.score_motifs(matched(spark, sf), M.classical_scorer)


KEY = ("protein_id", "rank", "taxid", "homolog_id")


@register("h01_best_gapless_match", f"WITH {PAIRS} SELECT protein_id, rank, taxid, homolog_id, match, {q6('similarity')} AS similarity, {q6('identity')} AS identity FROM matched")
def h01(spark, sf):
    return matched(spark, sf).select(*KEY, "match", r6(F.col("similarity")).alias("similarity"), r6(F.col("identity")).alias("identity"))


@register("h02_motif_homolog_pairs", f"WITH {PAIRS} SELECT protein_id, rank, taxid, homolog_id, motif, j FROM pairs")
def h02(spark, sf):
    return pairs(spark, sf).select(*KEY, "motif", "j")


@register("h03_homolog_motif_scores", f"WITH {PAIRS} SELECT protein_id, rank, taxid, homolog_id, valid, {q9('score')} AS score FROM scm")
def h03(spark, sf):
    return scored(spark, sf).select(*KEY, "valid", r9(F.col("score")).alias("score"))


@register("h04_best_homolog", f"WITH {PAIRS} SELECT protein_id, rank, taxid, homolog_id, match, {q6('similarity')} AS similarity, valid FROM bh")
def h04(spark, sf):
    return M.best_homolog(scored(spark, sf)).select(*KEY, "match", r6(F.col("similarity")).alias("similarity"), "valid")


@register("h05_best_homolog_classical", f"""WITH {PAIRS}, sub2 AS (SELECT *, nullif(sub, '') AS m2 FROM bh)
SELECT protein_id, rank, taxid, homolog_id, CASE WHEN m2 IS NULL THEN NULL WHEN isinf({classical_sql("m2")}) THEN 9999 ELSE {q9(classical_sql("m2"))} END AS score
FROM sub2, ctab""")
def h05(spark, sf):
    best = M.classical_of_best(M.best_homolog(scored(spark, sf)))
    return best.select(*KEY, r9(F.when(F.col("best_score") == float("inf"), 9999.0).otherwise(F.col("best_score"))).alias("score"))


PLACED = f"""{HITS}, {fx.DOMAIN_SQL},
placed AS (SELECT h.protein_id AS accession, h.rank, h.motif, CASE WHEN position(substr(motif, 7, 7) IN seq) > 0 THEN position(substr(motif, 7, 7) IN seq) - 1 END AS start
  FROM hit h JOIN protein USING (protein_id)),
met AS (SELECT p.accession, p.rank, ord, type, description, start >= b - 1 AND start + 7 <= e - 1 AS inside
  FROM placed p JOIN domain d ON d.accession = p.accession
  WHERE (start >= b - 1 AND start + 7 <= e - 1) OR (start >= b - 1 AND start <= e - 1 AND start + 7 > e - 1)
     OR (start < b - 1 AND start + 7 > b - 1 AND start + 7 <= e - 1) OR (start < b - 1 AND start + 7 > e - 1)),
stopped AS (SELECT *, min(ord) FILTER (WHERE inside) OVER (PARTITION BY accession, rank) AS stop FROM met),
topo AS (SELECT accession, rank, string_agg(type, ';' ORDER BY ord) AS type, string_agg(description, ';' ORDER BY ord) AS description
  FROM stopped WHERE stop IS NULL OR ord <= stop GROUP BY 1, 2),
topology AS (SELECT p.accession, p.rank, motif, start, coalesce(type, '') AS type, coalesce(description, '') AS description
  FROM placed p LEFT JOIN topo t ON t.accession = p.accession AND t.rank = p.rank)"""


def topology(spark, sf):
    p = fx.proteins(spark, sf)
    hits = scan.rule_hits(p).select(F.col("protein_id").alias("accession"), "rank", "motif")
    seqs = p.select(F.col("protein_id").alias("accession"), F.col("seq").alias("sequence"))
    return O.classify(hits, seqs, fx.domains(spark, sf))


@register("o01_motif_position", f"WITH {PLACED} SELECT accession, rank, motif, start FROM placed")
def o01(spark, sf):
    p = fx.proteins(spark, sf)
    hits = scan.rule_hits(p).select("protein_id", "rank", "motif")
    return hits.join(p.select("protein_id", "seq"), "protein_id").select(
        F.col("protein_id").alias("accession"), "rank", "motif", O.motif_position(F.col("motif"), F.col("seq")).alias("start")
    )


@register("o02_interval_classification", f"WITH {PLACED} SELECT accession, rank, type, description FROM topology")
def o02(spark, sf):
    return topology(spark, sf).select("accession", "rank", "type", "description")


@register("o03_accessible", f"""WITH {PLACED} SELECT accession, rank,
  (motif <> '' AND type = '') OR (type = 'topological domain' AND description = 'Cytoplasmic') AS accessible FROM topology""")
def o03(spark, sf):
    return topology(spark, sf).select("accession", "rank", O.accessible(F.col("motif"), F.col("type"), F.col("description")).alias("accessible"))
