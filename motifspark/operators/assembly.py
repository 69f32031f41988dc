"""Protein tables: accessions, sequences and homologs brought together by equi-joins."""

from pyspark.sql import Window
from pyspark.sql import functions as F


def merge_accessions(proteins, accessions, key, values, order="input_ord"):
    """Left lookup; of several rows per key the last one counts."""
    last = accessions.groupBy(key).agg(F.max_by(F.struct(*values), F.col(order)).alias("_last"))
    return proteins.join(last, key, "left").select(proteins["*"], *[F.col(f"_last.{v}").alias(v) for v in values])


def without_version(accession):
    return F.substring_index(accession, ".", 1)


def attach_sequences(base, fasta, key, order="input_ord"):
    """Sequence by id without its version, the last record by ``order``; null where there is none."""
    seqs = fasta.groupBy(without_version(F.col("id")).alias(key)).agg(F.max_by("sequence", order).alias("sequence"))
    return base.join(seqs, key, "left")


def attach_by_accession(rows, sequences, key="accession"):
    return rows.join(sequences.select(key, "sequence"), key, "left")


def homolog_groups(homologene, reference, targets):
    """Rows of the target species that share a group with a row of the reference species.

    Columns: query (accession without version), taxid, homolog, sequence, input_ord. A query without homologs
    keeps one row per target with nulls.
    """
    ref = homologene.filter(F.col("taxid") == reference).select(without_version(F.col("accession")).alias("query"), "hid").distinct()
    wanted = ref.select("query", "hid", F.explode(F.array(*[F.lit(t) for t in targets])).alias("taxid"))
    found = homologene.filter(F.col("taxid").isin(*targets)).select("hid", "taxid", F.col("accession").alias("homolog"), "sequence", "input_ord")
    return wanted.join(found, ["hid", "taxid"], "left").drop("hid")


def number_homologs(proteins, groups, key="protein_id"):
    """Homologs of the RefSeq id, then of the predicted one, numbered from 0 per protein and species."""
    known = groups.filter(F.col("homolog").isNotNull())
    ids = proteins.select(key, F.explode(F.array(
        F.struct(F.lit(0).alias("source"), F.col("refseq_peptide").alias("query")),
        F.struct(F.lit(1).alias("source"), F.col("refseq_peptide_predicted").alias("query")),
    )).alias("i")).select(key, "i.*").filter(F.col("query") != "")
    w = Window.partitionBy(key, "taxid").orderBy("source", "input_ord")
    return ids.join(known, "query").withColumn("j", F.row_number().over(w) - 1).select(key, "taxid", "j", "homolog", "sequence")


def widen_homologs(numbered, taxids, width=None, key="protein_id"):
    """``{taxid}_homolog_{j}`` and its sequence as columns, by default as many as there are; blanks where there is none."""
    if width is None:
        width = (numbered.agg(F.max("j")).first()[0] or 0) + 1

    def pick(t, j, c):
        return F.coalesce(F.max(F.when((F.col("taxid") == t) & (F.col("j") == j), F.col(c))), F.lit(""))

    cols = []
    for t in taxids:
        for j in range(width):
            cols += [pick(t, j, "homolog").alias(f"{t}_homolog_{j}"), pick(t, j, "sequence").alias(f"{t}_homolog_{j}_sequence")]
    return numbered.groupBy(key).agg(*cols)


def split_by_taxid(numbered, path):
    """One partition directory per species; readers of one species prune the others."""
    numbered.write.partitionBy("taxid").parquet(path)
    return numbered.sparkSession.read.parquet(path)
