"""Sources and sinks: tables written from the given data, then read back through the readers."""

from pyspark.sql import functions as F

from motifspark import fixtures as fx
from motifspark.operators import training as T
from motifspark.registry import q6, q9, r6, r9, register
from motifspark.registry.training import WEIGHTS
from motifspark.registry.training_sql import BASE, PWM, STATS
from motifspark.session import scratch_path
from motifspark.sources import readers, sinks
from motifspark.sources.tables import piece_count

TAX = {"en": 9606, "de": 3702, "fr": 7227, "es": 6239}


@register("s01_fasta", f"""WITH {fx.PROTEIN_SQL} SELECT 'ENSP' || protein_id || '.' || (protein_id % 3) AS id, 'ENST' || protein_id AS transcript,
  'ENSG' || gene_id AS gene, lang AS gene_symbol, seq AS sequence FROM protein""")
def s01(spark, sf):
    p = fx.proteins(spark, sf)
    head = F.concat(F.lit(">ENSP"), "protein_id", F.lit("."), F.col("protein_id") % 3, F.lit(" pep gene:ENSG"), "gene_id",
                    F.lit(" transcript:ENST"), "protein_id", F.lit(" gene_symbol:"), "lang")
    lines = F.regexp_replace("seq", "(.{60})", "$1\n")
    path = scratch_path(spark, "proteins.fa")
    p.select(F.concat(head, F.lit("\n"), lines).alias("value")).write.text(path)
    return readers.fasta(spark, path).drop("input_ord")


@register("s02_homologene", f"""WITH {fx.PROTEIN_SQL} SELECT hid, CASE lang {" ".join(f"WHEN '{k}' THEN {v}" for k, v in TAX.items())} END::BIGINT AS taxid, gene_id,
  lang AS gene_name, protein_id AS protein_gi, 'NP_' || protein_id || '.1' AS protein_accession FROM protein""")
def s02(spark, sf):
    tax = F.coalesce(*[F.when(F.col("lang") == k, v) for k, v in TAX.items()])
    rows = fx.proteins(spark, sf).select("hid", tax.alias("taxid"), "gene_id", "lang", "protein_id", F.concat(F.lit("NP_"), "protein_id", F.lit(".1")))
    path = scratch_path(spark, "homologene")
    rows.write.csv(path, sep="\t")
    return readers.homologene(spark, path).drop("input_ord")


@register("s03_protein_table", f"""WITH {fx.PROTEIN_SQL} SELECT CAST(gene_id AS VARCHAR) AS ensembl_gene_id, CAST(protein_id AS VARCHAR) AS ensembl_peptide_id,
  seq AS sequence FROM protein WHERE seq <> ''""")
def s03(spark, sf):
    p = fx.proteins(spark, sf).filter("seq <> ''").select(F.col("gene_id").alias("ensembl_gene_id"), F.col("protein_id").alias("ensembl_peptide_id"), F.col("seq").alias("sequence"), "lang")
    host = p.filter("lang = 'en'").drop("lang")
    other = p.filter("lang <> 'en'").drop("lang")
    paths = [sinks.save_csv(host, scratch_path(spark, "host")), sinks.save_csv(other, scratch_path(spark, "other"))]
    return readers.protein_table(spark, paths)


@register("s04_tm_ranges", f"WITH {fx.PROTEIN_SQL}, {fx.TM_SQL} SELECT CAST(protein_id AS VARCHAR) AS protein_id, CAST(b AS INT) AS begin, CAST(e AS INT) AS \"end\" FROM tm")
def s04(spark, sf):
    r = fx.tm_ranges(spark, sf)
    named = r.select(F.col("protein_id").alias("ensembl_peptide_id"), F.col("begin").alias("start"), "end").filter("ensembl_peptide_id % 2 = 0")
    titled = r.select(F.col("protein_id").alias("Protein stable ID"), F.col("begin").alias("Transmembrane helices start"),
                      F.col("end").alias("Transmembrane helices end")).filter("`Protein stable ID` % 2 = 1")
    first = sinks.save_csv(named, scratch_path(spark, "tm"))
    second = scratch_path(spark, "tm") + ".tsv"
    titled.write.option("header", True).csv(second, sep="\t")
    return readers.tm_ranges(spark, first).unionByName(readers.tm_ranges(spark, second))


@register("s05_uniprot_topology", f"""WITH {fx.PROTEIN_SQL}, {fx.DOMAIN_SQL} SELECT 'P' || accession AS accession, CAST(ord AS INT) AS ord, type, description,
  CAST(b AS INT) AS begin, CAST(e AS INT) AS "end", length(seq) AS n FROM domain d JOIN protein p ON p.protein_id = d.accession""")
def s05(spark, sf):
    location = F.struct(F.struct(F.col("begin").alias("_position")).alias("begin"), F.struct(F.col("end").alias("_position")).alias("end"))
    feature = F.struct(F.col("ord").alias("o"), F.col("type").alias("_type"), F.col("description").alias("_description"), location.alias("location"))
    per = fx.domains(spark, sf).groupBy("accession").agg(F.array_sort(F.collect_list(feature)).alias("f"))
    other = F.struct(F.lit("chain").alias("_type"), F.lit("whole").alias("_description"),
                     F.struct(F.struct(F.lit(1).alias("_position")).alias("begin"), F.struct(F.lit(2).alias("_position")).alias("end")).alias("location"))
    entry = per.join(fx.proteins(spark, sf).select(F.col("protein_id").alias("accession"), "seq"), "accession").select(
        F.array(F.concat(F.lit("P"), "accession")).alias("accession"),
        F.concat(F.array(other), F.transform("f", lambda x: F.struct(x["_type"].alias("_type"), x["_description"].alias("_description"), x["location"].alias("location")))).alias("feature"),
        F.col("seq").alias("sequence"),
    )
    path = scratch_path(spark, "uniprot.xml")
    entry.write.format("xml").option("rootTag", "uniprot").option("rowTag", "entry").save(path)
    domains, seqs = readers.uniprot_topology(spark, path)
    renumbered = domains.join(seqs.select("accession", F.length("sequence").alias("n")), "accession")
    return renumbered


@register("s06_coordinate_names", """SELECT coord, last(name ORDER BY spot_id, l_linenumber) AS name FROM (
  SELECT 'A' || l_partkey AS coord, l_orderkey AS spot_id, l_linenumber, 'pep' || l_suppkey AS name FROM lineitem) GROUP BY 1""")
def s06(spark, sf):
    line = fx.table(spark, sf, "lineitem").select(F.concat(F.lit("A"), "l_partkey").alias("coord"), F.concat(F.lit("pep"), "l_suppkey").alias("name"),
                                                  "l_orderkey", "l_linenumber")
    path = scratch_path(spark, "names")
    order = ["l_orderkey", "l_linenumber"]
    line.repartitionByRange(piece_count(spark), *order).sortWithinPartitions(*order).select("coord", "name").write.csv(path)
    return readers.coordinate_names(spark, path)


@register("s07_matrix_source", f"WITH {STATS} SELECT aa, CAST(pos AS INT) AS pos, {q6('sum(signal)')} AS value FROM res GROUP BY 1, 2")
def s07(spark, sf):
    m = T.additive_matrix(fx.peptides(spark, sf), F.col("signal"))
    path = sinks.save_csv(sinks.wide_matrix(m, "value").drop("aa_no"), scratch_path(spark, "matrix"))
    out = readers.matrix(spark, path).filter("value is not null")
    return out.select("aa", "pos", r6(F.col("value")).alias("value"))


@register("s08_accession_table", "SELECT 'ENSP' || (event_id // 10) AS ensembl_peptide_id, 'P' || user_id AS uniprot, 'T' || event_id AS trembl FROM events")
def s08(spark, sf):
    e = fx.table(spark, sf, "events").select(F.concat(F.lit("ENSP"), F.expr("event_id div 10")), F.concat(F.lit("P"), "user_id"), F.concat(F.lit("T"), "event_id"))
    path = scratch_path(spark, "accessions")
    e.write.csv(path, sep="\t")
    return readers.accession_table(spark, path).drop("input_ord")


@register("s09_scored_table_sink", f"WITH {fx.ASSAY_SQL} SELECT CAST(peptide_id AS VARCHAR) AS peptide_id, bait, copy, {q6('bas')} AS bas FROM assay")
def s09(spark, sf):
    path = sinks.save_csv(fx.assay(spark, sf).select("peptide_id", "bait", "copy", "bas"), scratch_path(spark, "scored"))
    return spark.read.csv(path, header=True).withColumn("bas", r6(F.col("bas").cast("double")))


POS = range(1, 16)


@register("s10_matrix_sink", f"""WITH {PWM}, k AS (SELECT rule_class, rule_pos, pos, aa, unnest(['positive', 'suboptimal', 'forbidden']) AS kind,
  unnest([positive, suboptimal, forbidden]) AS v FROM pwm)
SELECT kind, rule_class, rule_pos, aa, {", ".join(f'{q9(f"max(v) FILTER (WHERE pos = {i})")} AS "#{i}"' for i in POS)} FROM k GROUP BY 1, 2, 3, 4""")
def s10(spark, sf):
    path = sinks.save_matrices(T.Training(fx.peptides(spark, sf)).pwm(), scratch_path(spark, "matrices"))
    back = spark.read.option("header", True).csv(path)
    return back.select("kind", "rule_class", F.col("rule_pos").cast("int").alias("rule_pos"), "aa", *[r9(F.col(f"`#{i}`").cast("double")).alias(f"#{i}") for i in POS])


@register("s11_model_persistence", f"""WITH {BASE} SELECT pos, aa, {q9("positive")} AS positive, {q9("suboptimal")} AS suboptimal,
  {[float(w) for w in WEIGHTS["binding"]]}[pos] AS weight, 0.25 AS threshold FROM base""")
def s11(spark, sf):
    base = T.Training(fx.peptides(spark, sf)).baseline
    path = sinks.save_model(scratch_path(spark, "model"), base, WEIGHTS, {"threshold": 0.25})
    pwm, weights, params = sinks.load_model(spark, path)
    w = F.array(*[F.lit(float(v)) for v in weights["binding"]])
    return pwm.select("pos", "aa", r9(F.col("positive")).alias("positive"), r9(F.col("suboptimal")).alias("suboptimal"),
                      w[F.col("pos") - 1].alias("weight"), F.lit(params["threshold"]).alias("threshold"))


@register("s12_generic_saves", f"WITH {fx.PEPTIDE_SQL} SELECT peptide_id || ': ' || seq AS line FROM peptide")
def s12(spark, sf):
    path = sinks.save_pairs(fx.peptides(spark, sf), "peptide_id", "seq", scratch_path(spark, "pairs"))
    return spark.read.text(path).withColumnRenamed("value", "line")
