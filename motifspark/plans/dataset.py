"""Program 3: a protein table with homologs from accessions, FASTA and homology groups."""

from pyspark.sql import functions as F

from motifspark.operators import assembly as D


def protein_dataset(proteins, accessions, fasta, homologene, sequences, reference, targets):
    """(protein table, homologs in long form).

    ``proteins`` has protein_id, refseq_peptide and refseq_peptide_predicted; ``sequences`` accession and sequence;
    ``fasta`` id, sequence and ``input_ord``, the order of its records.
    """
    base = D.merge_accessions(proteins, accessions, "protein_id", ["uniprot", "trembl"])
    base = D.attach_sequences(base, fasta, "protein_id")
    rows = homologene.withColumnRenamed("protein_accession", "accession")
    # Sequences join after numbering, so that each is moved once.
    groups = D.homolog_groups(rows.withColumn("sequence", F.lit(None).cast("string")), reference, targets)
    numbered = D.number_homologs(proteins, groups).drop("sequence")
    return base, D.attach_by_accession(numbered.withColumnRenamed("homolog", "accession"), sequences).withColumnRenamed("accession", "homolog")
