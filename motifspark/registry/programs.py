from pyspark.sql import functions as F

from motifspark import fixtures as fx
from motifspark.operators import scan
from motifspark.plans import dataset, prediction, training_plan
from motifspark.registry import assay as RA
from motifspark.registry import assembly as RD
from motifspark.registry import homology as RH
from motifspark.registry import q9, r9, register
from motifspark.registry.scoring import KINDS, cell_sql, weighted_model
from motifspark.registry.sequences import CLASS_SQL
from motifspark.registry.sql import HITS, classical_sql
from motifspark.registry.training import WEIGHTED_SQL
from motifspark.registry.training_sql import PWM
from motifspark.session import materialize

MODEL_SQL = PWM.replace(fx.PEPTIDE_SQL + ",", "", 1)

SCAN = f"""{HITS}, {fx.PEPTIDE_SQL}, {MODEL_SQL.lstrip()}, {WEIGHTED_SQL},
kinds AS (SELECT DISTINCT motif FROM cand),
pres AS (SELECT motif AS peptide_id, true AS passes, 0 AS signal, pos, substr(motif, pos, 1) AS aa,
  {CLASS_SQL.format("substr(motif, greatest(pos - 1, 1), 1)")} AS lc, {CLASS_SQL.format("substr(motif, least(pos + 1, 15), 1)")} AS rc
  FROM (SELECT motif, unnest(range(1, 16)) AS pos FROM kinds)),
cell AS ({cell_sql("wpwm", KINDS)}),
msum AS (SELECT peptide_id AS motif, {", ".join(f"sum({k}) AS {k}" for k in KINDS)} FROM cell GROUP BY 1),
scored AS (SELECT protein_id, ord, c.motif, binding, positive, suboptimal, forbidden,
  CASE WHEN NOT forbidden > 0 THEN positive - suboptimal END AS total FROM cand c JOIN msum m ON m.motif = c.motif),
called AS (SELECT *, coalesce(round(total, 9) >= 0, false) AS call, round(sqrt(total * total + binding * binding), 9) AS norm FROM scored),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY protein_id ORDER BY call DESC, norm DESC NULLS LAST, ord) AS rank FROM called) WHERE rank <= 3)"""


def model_of(spark, sf):
    return weighted_model(fx.peptides(spark, sf))


COLS = ("total", "binding", "positive", "suboptimal", "forbidden")


@register("g06_score_windows", f"WITH {SCAN} SELECT protein_id, ord, motif, call, {', '.join(f'{q9(c)} AS {c}' for c in COLS)} FROM called")
def g06(spark, sf):
    model = model_of(spark, sf)
    out = model.score(scan.candidate_windows(fx.proteins(spark, sf)))
    return out.select("protein_id", "ord", "motif", "call", *[r9(F.col(c)).alias(c) for c in COLS])


@register("g07_top_k", f"""WITH {SCAN}, g AS (SELECT protein_id, unnest([1, 2, 3]) AS rank FROM protein)
SELECT g.protein_id, g.rank, coalesce(motif, '') AS motif, coalesce(call, false) AS call, {q9('total')} AS total, {q9('binding')} AS binding
FROM g LEFT JOIN best b ON b.protein_id = g.protein_id AND b.rank = g.rank""")
def g07(spark, sf):
    out = prediction.novel_hits(fx.proteins(spark, sf), model_of(spark, sf))
    return out.select("protein_id", "rank", "motif", "call", r9(F.col("total")).alias("total"), r9(F.col("binding")).alias("binding"))


WIDE = [(i, n, v) for i, n in ((1, "1st"), (2, "2nd"), (3, "3rd")) for v in ("motif", "total", "binding", "positive", "suboptimal", "forbidden", "call")]


def _wide_sql(i, n, v):
    label = f"Novel_{n}_{v}"
    body = f"max({v}) FILTER (WHERE rank = {i})"
    return f'{body if v in ("motif", "call") else q9(body)} AS "{label}"'


@register("g08_wide_hits", f"WITH {SCAN} SELECT protein_id, {', '.join(_wide_sql(*w) for w in WIDE)} FROM best GROUP BY 1")
def g08(spark, sf):
    hits = scan.best_hits(model_of(spark, sf).score(scan.candidate_windows(fx.proteins(spark, sf))))
    hits = hits.withColumns({c: r9(F.col(c)) for c in COLS})
    wide = scan.widen_hits(hits, ["motif", "total", "binding", "positive", "suboptimal", "forbidden", "call"], prefix="Novel_")
    return wide


@register("g09_protein_scan", f"""WITH {SCAN} SELECT b.protein_id, rank, b.motif, call, {q9('total')} AS total,
  CASE WHEN isinf({classical_sql('b.motif')}) THEN NULL ELSE {q9(classical_sql('b.motif'))} END AS classical FROM best b, ctab""")
def g09(spark, sf):
    out = prediction.novel_hits(fx.proteins(spark, sf), model_of(spark, sf)).filter("motif <> ''")
    return out.select("protein_id", "rank", "motif", "call", r9(F.col("total")).alias("total"), r9(F.col("classical")).alias("classical"))


def predicted(spark, sf):
    p = materialize(fx.proteins(spark, sf), "proteins")  # each step reads the sequences; the texts are read once
    return prediction.predict(p, RH.homologs(p), fx.domains(spark, sf, p), model_of(spark, sf))


@register("program_predict_genes")
def predict_genes(spark, sf):
    return predicted(spark, sf)["genes"]


@register("program_predict_homologs")
def predict_homologs(spark, sf):
    return predicted(spark, sf)["homologs"].select("protein_id", "family", "rank", "taxid", "homolog_id", "match", "similarity", "identity", "valid", "total", "call")


@register("program_train_model")
def train_model(spark, sf):
    settings = training_plan.AssaySettings(fx.BAITS, fx.CONTROL_BAIT, fx.CONTROL_PEPTIDES, RA.MULT, RA.INDEX)
    out = training_plan.process_assay(fx.assay(spark, sf), settings)
    seqs = fx.peptides(spark, sf).select("peptide_id", "seq")
    rows = out["peptides"].join(seqs, "peptide_id").select(
        "peptide_id", "seq", F.coalesce("max_signal", F.lit(0.0)).alias("signal"), (F.col("one_passes") == "Yes").alias("passes")
    )
    _, _, _, report = training_plan.train_conditional(rows, trials=20)
    return report


@register("program_protein_dataset", f"""WITH {RD.GENE} SELECT n.protein_id, n.taxid, n.j, n.homolog, length(p.seq) AS n, e.uniprot, e.trembl FROM num n
LEFT JOIN protein p ON n.homolog = CASE WHEN p.protein_id % 3 = 0 THEN 'XP_' ELSE 'NP_' END || p.protein_id || '.1'
LEFT JOIN (SELECT event_id // 10 AS pid, 'P' || user_id AS uniprot, 'T' || event_id AS trembl,
  row_number() OVER (PARTITION BY event_id // 10 ORDER BY event_id DESC) AS k FROM events) e ON e.pid = n.protein_id AND k = 1""")
def protein_dataset(spark, sf):
    g = RD.homologene(spark, sf)
    fasta = fx.proteins(spark, sf).select(F.col("protein_id").cast("string").alias("id"), F.col("seq").alias("sequence"), F.col("protein_id").alias("input_ord"))
    seqs = fx.proteins(spark, sf).select(
        F.concat(F.when(F.col("protein_id") % 3 == 0, "XP_").otherwise("NP_"), "protein_id", F.lit(".1")).alias("accession"), F.col("seq").alias("sequence")
    )
    base, homologs = dataset.protein_dataset(RD.refseq_proteins(spark, sf), RD.accessions(spark, sf), fasta, g, seqs, "en", RD.TARGETS)
    return homologs.join(base.select("protein_id", "uniprot", "trembl"), "protein_id", "left").select(
        "protein_id", "taxid", "j", "homolog", F.length("sequence").alias("n"), "uniprot", "trembl"
    )
