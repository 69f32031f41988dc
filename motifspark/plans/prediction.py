"""Program 2: motifs of a proteome, in homologs and on membranes, down to one row per protein and gene."""

from pyspark.sql import functions as F

from motifspark.functions.classical import classical_score
from motifspark.operators import consolidate as J
from motifspark.operators import homology as M
from motifspark.operators import scan
from motifspark.operators import specificity as X
from motifspark.operators import topology as O
from motifspark.session import materialize, tune


def novel_hits(proteins, model, k=3, rules=None, specificity=None):
    """Exactly k rows per protein: conditional scores, call, classical score and, if asked, specificity."""
    windows = scan.candidate_windows(proteins, rules)
    best = scan.best_hits(model.score(windows), k)
    best = best.withColumn("classical", classical_score(F.col("motif")))
    if specificity is not None:
        best = best.withColumn("specificity", X.specificity_score(F.col("motif"), specificity))
    hits = scan.pad_ranks(proteins, best.drop("ord", "norm"), k)
    return hits.withColumns({"motif": F.coalesce("motif", F.lit("")), "call": F.coalesce("call", F.lit(False))})


def homolog_scorer(model):
    def score(df):
        out = model.score(df.withColumnRenamed("match", "_match").withColumnRenamed("_scored", "match"), "match")
        return out.drop("match").withColumnRenamed("_match", "match").withColumn("_scored", F.lit(None).cast("string"))

    return score


def classical_hits(proteins, k=3, specificity=None):
    """Exactly k rows per protein by the classical score, without position rules."""
    hits = scan.classical_hits(proteins, k).withColumnRenamed("score", "classical")
    if specificity is not None:
        hits = hits.withColumn("specificity", X.specificity_score(F.nullif(F.col("motif"), F.lit("")), specificity))
    return hits


HIT = ("protein_id", "family", "rank", "motif", "call", "total", "binding", "positive", "suboptimal", "forbidden", "classical", "specificity")


def all_hits(proteins, model, k=3, specificity=None):
    """Novel and classical hits as one long table, told apart by `family`; columns a family lacks are null."""
    novel = novel_hits(proteins, model, k, specificity=specificity).withColumn("family", F.lit("novel"))
    classical = classical_hits(proteins, k, specificity).withColumn("family", F.lit("classical"))
    rows = novel.unionByName(classical, allowMissingColumns=True)
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("double").alias(c) for c in HIT])


def predict(proteins, homologs, domains, model, k=3, by="similarity", specificity=None, helices=None, similarity_weights=None):
    """``proteins``: protein_id, gene_id, seq; ``homologs``: protein_id, taxid, j, homolog_id and, where known,
    refseq_peptide and refseq_peptide_predicted; ``domains`` by accession; ``helices`` (protein_id, begin, end) to mask.

    Every motif of both families and of every rank is placed, matched in homologs and scored. Returns DataFrames: hits,
    topology and homologs by motif; protein_homologs, the best homolog by motif and species with both RefSeq ids;
    proteins, one row each by its first motifs; genes and gene_species, one row per gene (and species) for each family.
    """
    tune(proteins.sparkSession)
    scanned = proteins if helices is None else scan.mask_transmembrane(proteins, helices)
    hits = materialize(all_hits(scanned, model, k, specificity), "hits")
    key = ["protein_id", "family", "rank"]
    found = hits.filter("motif <> ''")
    seqs = proteins.select(F.col("protein_id").alias("accession"), F.col("seq").alias("sequence"))
    topo = O.classify(found.select(F.col("protein_id").alias("accession"), "family", "rank", "motif"), seqs, domains)
    topo = topo.withColumn("accessible", O.accessible(F.col("motif"), F.col("type"), F.col("description")))
    pairs = M.motif_homolog_pairs(found.select(*key, "motif"), homologs)
    matched = M.best_match(M.attach_targets(pairs, proteins), weights=similarity_weights).drop("target").withColumnRenamed("motif", "host_motif")
    matched = materialize(matched, "matched")
    scored = M.score_motifs(matched.filter("family = 'novel'"), homolog_scorer(model))
    classical = M.score_motifs(matched.filter("family = 'classical'"), M.classical_scorer)
    scored = scored.unionByName(classical, allowMissingColumns=True)
    if specificity is not None:
        scored = scored.withColumn("specificity", X.specificity_score(F.nullif(F.col("match"), F.lit("")), specificity))
    best = materialize(M.best_homolog(scored, by, (*key, "taxid")), "best-homologs")

    placed = topo.select(F.col("accession").alias("protein_id"), "family", "rank", "type", "description", "accessible")
    first = hits.filter("rank = 1").join(placed, key, "left").join(proteins.select("protein_id", "gene_id"), "protein_id")
    rows = first.select(
        "protein_id", "gene_id", "family", "motif", "total", "binding", "classical", F.coalesce("call", F.lit(False)).alias("host_call"),
        F.coalesce("type", F.lit("")).alias("type"), F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("accessible", F.lit(False)).alias("accessible"), F.col("protein_id").alias("input_ord"),
    )
    rows = materialize(rows, "host-rows")
    novel, other = (rows.filter(F.col("family") == f).drop("family") for f in ("novel", "classical"))
    ids = [c if c in best.columns else F.lit(None).cast("string").alias(c) for c in ("refseq_peptide", "refseq_peptide_predicted")]
    chosen = best.select(*key, "taxid", "homolog_id", F.col("match").alias("homolog_motif"), "similarity", "identity",
                         F.col("call").alias("model_call"), F.col("total").alias("homolog_total"), *ids, F.col("j").alias("input_ord"))
    homolog = J.homolog_rows(chosen, tuple(key))
    top = homolog.filter("rank = 1")
    species = {f: h.join(top.filter(F.col("family") == f).drop("family", "rank"), "protein_id") for f, h in (("novel", novel), ("classical", other))}
    shown = ["protein_id", "homolog_id", "homolog_motif", "similarity"]
    by_species = J.gene_species_rows(species["novel"], [*shown, "model_call"]).join(
        J.gene_species_rows(species["classical"], shown, order=J.CLASSICAL_ORDER).select(
            "gene_id", "taxid", *[F.col(c).alias(f"{c}_classical") for c in shown]), ["gene_id", "taxid"], "full")
    genes = J.gene_rows(novel, ["protein_id", "motif", "accessible", "host_call", "binding"])
    classical_genes = J.classical_gene_rows(other, ["protein_id", "motif", "classical"])
    proteins_out = novel.join(other.select("protein_id", F.col("motif").alias("classical_motif"), F.col("classical").alias("classical_score"),
                                           F.col("accessible").alias("classical_accessible")), "protein_id", "left")
    return {"hits": hits, "topology": topo, "homologs": best, "proteins": proteins_out, "protein_homologs": homolog,
            "genes": J.merge_gene_tables(genes, classical_genes), "gene_species": by_species}
