from pyspark.sql import functions as F

from motifspark import fixtures as fx
from motifspark.operators import consolidate as J
from motifspark.registry import r6, register

HOST = ["host_call", "binding", "accessible", "refseq"]
SPECIES = ("click", "error", "purchase", "view")
B = "round(binding, 6) + 0.0"


def first_sql(keys, order, cols):
    return f"SELECT {keys}, {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS k FROM motif_row) WHERE k = 1"


@register("j01_host_rows", f"WITH {fx.MOTIF_ROW_SQL} {first_sql('protein_id', 'input_ord', f'host_call, {B} AS binding, accessible, refseq')}")
def j01(spark, sf):
    return J.host_rows(fx.motif_rows(spark, sf), HOST).withColumn("binding", r6(F.col("binding")))


HOMOLOG = first_sql("protein_id, taxid", "model_call DESC, round(similarity, 9) DESC, input_ord",
                    "homolog_id, round(similarity, 6) + 0.0 AS similarity, model_call, refseq AS match_refseq")


@register("j02_homolog_rows", f"WITH {fx.MOTIF_ROW_SQL} {HOMOLOG}")
def j02(spark, sf):
    return J.homolog_rows(fx.motif_rows(spark, sf)).withColumn("similarity", r6(F.col("similarity")))


MOTIFS = f"""{fx.MOTIF_ROW_SQL}, family AS (SELECT *, 'NP_' || protein_id AS refseq_peptide, 'XP_' || input_ord AS refseq_peptide_predicted,
  unnest(['novel', 'novel', 'classical']) AS family, unnest([1, 2, 1]) AS rank,
  unnest([similarity, round(1 - similarity, 9), round(similarity / 2, 9)]) AS own FROM motif_row)"""


@register("j02_homolog_rows_by_motif", f"""WITH {MOTIFS} SELECT protein_id, family, rank, taxid, homolog_id, round(own, 6) + 0.0 AS similarity, model_call,
  refseq_peptide AS match_refseq_peptide, refseq_peptide_predicted AS match_refseq_peptide_predicted
FROM (SELECT *, row_number() OVER (PARTITION BY protein_id, family, rank, taxid
  ORDER BY model_call DESC, round(own, 9) DESC, input_ord) AS k FROM family) WHERE k = 1""")
def j02_by_motif(spark, sf):
    s = F.col("similarity")
    motifs = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(r).alias("rank"), F.round(v, 9).alias("own")) for f, r, v in (
        ("novel", 1, s), ("novel", 2, 1 - s), ("classical", 1, s / 2))])
    rows = fx.motif_rows(spark, sf).withColumns({
        "refseq_peptide": F.concat(F.lit("NP_"), "protein_id"), "refseq_peptide_predicted": F.concat(F.lit("XP_"), "input_ord"), "m": F.explode(motifs)})
    rows = rows.select("*", "m.*").drop("similarity", "refseq", "m").withColumnRenamed("own", "similarity")
    return J.homolog_rows(rows, ("protein_id", "family", "rank")).withColumn("similarity", r6(F.col("similarity")))


@register("j05_classical_gene_species_rows", f"""WITH {fx.MOTIF_ROW_SQL}
{first_sql('gene_id, taxid', '(homolog_id IS NOT NULL) DESC, accessible DESC, classical, input_ord', 'protein_id, homolog_id, round(classical, 6) + 0.0 AS classical')}""")
def j05_classical(spark, sf):
    rows = J.gene_species_rows(fx.motif_rows(spark, sf), ["protein_id", "homolog_id", "classical"], order=J.CLASSICAL_ORDER)
    return rows.withColumn("classical", r6(F.col("classical")))


@register("j03_species_merge", f"""WITH {fx.MOTIF_ROW_SQL}, h AS ({HOMOLOG}),
ids AS (SELECT DISTINCT protein_id FROM motif_row)
SELECT protein_id, {", ".join(f"max(homolog_id) FILTER (WHERE taxid = '{t}') AS {t}_homolog, max(similarity) FILTER (WHERE taxid = '{t}') AS {t}_similarity" for t in SPECIES)}
FROM h WHERE taxid IN {SPECIES} GROUP BY 1""")
def j03(spark, sf):
    rows = J.homolog_rows(fx.motif_rows(spark, sf)).withColumn("similarity", r6(F.col("similarity")))
    frames = {t: rows.filter(F.col("taxid") == t).select("protein_id", F.col("homolog_id").alias(f"{t}_homolog"), F.col("similarity").alias(f"{t}_similarity"))
              for t in SPECIES}
    return J.merge_species(frames)


NOVEL = "accessible DESC, host_call DESC, binding DESC, input_ord"


@register("j04_gene_rows", f"WITH {fx.MOTIF_ROW_SQL} {first_sql('gene_id', NOVEL, f'protein_id, accessible, host_call, {B} AS binding')}")
def j04(spark, sf):
    return J.gene_rows(fx.motif_rows(spark, sf), ["protein_id", "accessible", "host_call", "binding"]).withColumn("binding", r6(F.col("binding")))


@register("j05_gene_species_rows", f"""WITH {fx.MOTIF_ROW_SQL}, g AS ({first_sql('gene_id, taxid', '(homolog_id IS NOT NULL) DESC, ' + NOVEL, f'protein_id, homolog_id, {B} AS binding')})
SELECT gene_id, {", ".join(f'max({c}) FILTER (WHERE taxid = {t!r}) AS "{t}_Host_Match_{c}"' for t in SPECIES for c in ("protein_id", "homolog_id", "binding"))} FROM g GROUP BY 1""")
def j05(spark, sf):
    rows = J.gene_species_rows(fx.motif_rows(spark, sf), ["protein_id", "homolog_id", "binding"]).withColumn("binding", r6(F.col("binding")))
    return J.widen_species(rows, SPECIES, ["protein_id", "homolog_id", "binding"])


@register("j06_gene_merge", f"""WITH {fx.MOTIF_ROW_SQL}, n AS ({first_sql('gene_id', NOVEL, f'protein_id, {B} AS binding')}),
c AS ({first_sql('gene_id', 'accessible DESC, classical, input_ord', 'protein_id, round(classical, 6) + 0.0 AS classical')})
SELECT gene_id, n.protein_id AS protein_id_novel, n.binding, c.protein_id AS protein_id_classical, c.classical FROM n FULL JOIN c USING (gene_id)""")
def j06(spark, sf):
    rows = fx.motif_rows(spark, sf)
    novel = J.gene_rows(rows, ["protein_id", "binding"]).withColumn("binding", r6(F.col("binding")))
    classical = J.classical_gene_rows(rows, ["protein_id", "classical"]).withColumn("classical", r6(F.col("classical")))
    return J.merge_gene_tables(novel, classical)
