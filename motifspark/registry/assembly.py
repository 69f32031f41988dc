from pyspark.sql import functions as F

from motifspark import fixtures as fx
from motifspark.operators import assembly as D
from motifspark.registry import register
from motifspark.session import scratch_path

TARGETS = ["de", "fr", "es"]


def accessions(spark, sf):
    e = fx.table(spark, sf, "events")
    return e.select(F.expr("event_id div 10").alias("protein_id"), F.concat(F.lit("P"), F.col("user_id")).alias("uniprot"),
                    F.concat(F.lit("T"), F.col("event_id")).alias("trembl"), F.col("event_id").alias("input_ord"))


def fasta(spark, sf):
    return fx.proteins(spark, sf).select(
        F.concat(F.lit("ENSP"), F.col("protein_id"), F.lit("."), F.col("protein_id") % 3 + 1).alias("id"), F.col("seq").alias("sequence"),
        F.col("protein_id").alias("input_ord"),
    )


def fasta_with_versions(spark, sf):
    """Every fourth record comes a second time, later, under version 10 and with its sequence reversed."""
    once = fasta(spark, sf)
    again = once.filter("input_ord % 4 = 0").select(
        F.concat(F.substring_index("id", ".", 1), F.lit(".10")).alias("id"), F.reverse("sequence").alias("sequence"), (F.col("input_ord") + 10**9).alias("input_ord"))
    return once.unionByName(again)


def homologene(spark, sf):
    kind = F.when(F.col("protein_id") % 3 == 0, "XP_").otherwise("NP_")
    return fx.proteins(spark, sf).select(
        "hid", F.col("lang").alias("taxid"), F.concat(kind, F.col("protein_id"), F.lit(".1")).alias("accession"),
        F.col("protein_id").alias("input_ord"), F.when(F.col("protein_id") % 5 > 0, F.col("seq")).alias("sequence"),
    )


def refseq_proteins(spark, sf):
    return fx.table(spark, sf, "documents", columns=("doc_id",)).select(
        F.col("doc_id").alias("protein_id"), F.concat(F.lit("NP_"), F.col("doc_id")).alias("refseq_peptide"),
        F.concat(F.lit("XP_"), F.col("doc_id") + 1).alias("refseq_peptide_predicted"),
    )


GENE = f"""{fx.PROTEIN_SQL},
hg AS (SELECT hid, lang AS taxid, CASE WHEN protein_id % 3 = 0 THEN 'XP_' ELSE 'NP_' END || protein_id || '.1' AS accession,
  protein_id AS input_ord, CASE WHEN protein_id % 5 > 0 THEN seq END AS sequence FROM protein),
grp AS (SELECT w.query, w.taxid, t.accession AS homolog, t.sequence, t.input_ord
  FROM (SELECT DISTINCT split_part(accession, '.', 1) AS query, hid, unnest(['de', 'fr', 'es']) AS taxid FROM hg WHERE taxid = 'en') w
  LEFT JOIN hg t ON t.hid = w.hid AND t.taxid = w.taxid),
num AS (SELECT protein_id, taxid, row_number() OVER (PARTITION BY protein_id, taxid ORDER BY source, input_ord) - 1 AS j, homolog, sequence
  FROM (SELECT doc_id AS protein_id, unnest([0, 1]) AS source, unnest(['NP_' || doc_id, 'XP_' || (doc_id + 1)]) AS query FROM documents)
  JOIN grp USING (query) WHERE homolog IS NOT NULL)"""


@register("d01_accession_merge", """
SELECT d.doc_id AS protein_id, 'P' || e.user_id AS uniprot, 'T' || e.event_id AS trembl FROM documents d LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY event_id // 10 ORDER BY event_id DESC) AS k FROM events) e ON e.event_id // 10 = d.doc_id AND k = 1""")
def d01(spark, sf):
    base = fx.table(spark, sf, "documents", columns=("doc_id",)).select(F.col("doc_id").alias("protein_id"))
    return D.merge_accessions(base, accessions(spark, sf), "protein_id", ["uniprot", "trembl"])


@register("d02_sequence_attach", f"""
WITH {fx.PROTEIN_SQL} SELECT 'ENSP' || l.doc_id AS peptide, CASE WHEN p.protein_id % 4 = 0 THEN reverse(p.seq) ELSE p.seq END AS sequence FROM labels l LEFT JOIN protein p ON p.protein_id = l.doc_id""")
def d02(spark, sf):
    base = fx.table(spark, sf, "labels").select(F.concat(F.lit("ENSP"), F.col("doc_id")).alias("peptide"))
    return D.attach_sequences(base, fasta_with_versions(spark, sf), "peptide")


@register("d03_accession_sequences", f"""
WITH {fx.PROTEIN_SQL} SELECT d.doc_id % 3 + 1 AS version, 'ENSP' || d.doc_id || '.2' AS accession, p.seq AS sequence
FROM documents d LEFT JOIN protein p ON p.protein_id = d.doc_id AND p.protein_id % 3 + 1 = 2""")
def d03(spark, sf):
    rows = fx.table(spark, sf, "documents", columns=("doc_id",)).select(
        (F.col("doc_id") % 3 + 1).alias("version"), F.concat(F.lit("ENSP"), F.col("doc_id"), F.lit(".2")).alias("accession")
    )
    return D.attach_by_accession(rows, fasta(spark, sf).withColumnRenamed("id", "accession"))


@register("d04_homolog_self_join", f"WITH {GENE} SELECT query, taxid, homolog, length(sequence) AS n, input_ord FROM grp")
def d04(spark, sf):
    return D.homolog_groups(homologene(spark, sf), "en", TARGETS).select("query", "taxid", "homolog", F.length("sequence").alias("n"), "input_ord")


def numbered(spark, sf):
    return D.number_homologs(refseq_proteins(spark, sf), D.homolog_groups(homologene(spark, sf), "en", TARGETS))


@register("d05_homolog_numbering", f"WITH {GENE} SELECT protein_id, taxid, CAST(j AS INT) AS j, homolog, sequence FROM num")
def d05(spark, sf):
    return numbered(spark, sf)


@register("d05_homolog_columns", f"""WITH {GENE}, wide AS (SELECT protein_id, taxid, 'homolog_' || j AS name, homolog AS value FROM num
  UNION ALL SELECT protein_id, taxid, 'homolog_' || j || '_sequence', coalesce(sequence, '') FROM num)
SELECT protein_id, taxid || '_' || name AS name, value FROM wide WHERE value <> ''""")
def d05_columns(spark, sf):
    wide = D.widen_homologs(numbered(spark, sf), TARGETS)
    names = [c for c in wide.columns if c != "protein_id"]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in names]))
    return wide.select("protein_id", cells.alias("c")).select("protein_id", "c.*").filter("value <> ''")


@register("d06_split_by_taxid", f"WITH {GENE} SELECT taxid, protein_id, CAST(j AS INT) AS j, homolog FROM num")
def d06(spark, sf):
    parts = D.split_by_taxid(numbered(spark, sf), scratch_path(spark, "homologs"))
    return parts.select("taxid", "protein_id", "j", "homolog")
