"""Views over the driver's tables, in the shapes the operators read. Whole tables, whole texts."""

from pyspark.sql import functions as F

from motifspark.sources.tables import read_parquet

CONTROL_BAIT = "N"
BAITS = ("A", "N", "R")
CONTROL_PEPTIDES = (0, 1)


def table(spark, sf, name, key=None, columns=None):
    return read_parquet(spark, f"{sf}/{name}.parquet", key, columns)


def texts(spark, sf, *columns):
    return table(spark, sf, "documents", "doc_id", ("doc_id", "text", *columns))


def _letters(text):
    return F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))


def _replaced(text, old, new):
    """As translate does, for whole texts in passes that skip over what stays; no new letter is among the old."""
    for a, b in zip(old, new):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def proteins(spark, sf):
    return texts(spark, sf, "lang").select(
        F.col("doc_id").alias("protein_id"),
        F.expr("doc_id div 3").alias("gene_id"),
        F.expr("doc_id div 8").alias("hid"),
        "lang",
        _replaced(_letters(F.col("text")), "BJOZ", "STYQ").alias("seq"),
    )


PROTEIN_SQL = """protein AS (
  SELECT doc_id AS protein_id, doc_id // 3 AS gene_id, doc_id // 8 AS hid, lang,
         translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'BJOZ', 'STYQ') AS seq
  FROM documents)"""


def peptides(spark, sf):
    """Ten measured 15-mers per protein, spread over its whole text."""
    letters = texts(spark, sf).select("doc_id", _letters(F.col("text")).alias("letters"))
    events = table(spark, sf, "events").select("event_id", F.expr("event_id div 10").alias("doc_id"), "value")
    # Too short texts are dropped by the length of what was cut, which keeps the letters off the file scan.
    start = (F.col("event_id") * 7919) % F.greatest(F.length("letters") - 14, F.lit(1)) + 1
    return events.join(letters, "doc_id").select(
        F.col("event_id").alias("peptide_id"),
        F.col("doc_id").alias("protein_id"),
        F.translate(F.substring("letters", start, 15), "ZUX", "QCG").alias("seq"),
        F.col("value").alias("signal"),
        (F.col("value") >= 50).alias("passes"),
    ).filter(F.length("seq") == 15)


PEPTIDE_SQL = """letters AS (
  SELECT doc_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'ZUX', 'QCG') AS letters
  FROM documents),
peptide AS (
  SELECT event_id AS peptide_id, doc_id AS protein_id,
         substr(letters, (event_id * 7919) % (length(letters) - 14) + 1, 15) AS seq,
         value AS signal, value >= 50 AS passes
  FROM events JOIN letters ON event_id // 10 = doc_id WHERE length(letters) >= 15)"""


def assay(spark, sf):
    """One row per peptide, bait and replicate."""
    line = table(spark, sf, "lineitem")
    return line.groupBy(
        F.col("l_partkey").alias("peptide_id"), F.col("l_returnflag").alias("bait"),
        F.col("l_linestatus").alias("copy"),
    ).agg(
        (F.avg("l_extendedprice") / 1009).alias("raw"),
        ((F.avg(F.col("l_extendedprice") * (1 - 10 * F.col("l_discount")))) / 1009).alias("bas"),
        (F.avg("l_quantity") / 25).alias("call_index"),
    ).withColumn("dataset", F.col("peptide_id") % 2)


ASSAY_SQL = """assay AS (
  SELECT l_partkey AS peptide_id, l_returnflag AS bait, l_linestatus AS copy,
         avg(l_extendedprice) / 1009 AS raw,
         avg(l_extendedprice * (1 - 10 * l_discount)) / 1009 AS bas,
         avg(l_quantity) / 25 AS call_index, l_partkey % 2 AS dataset
  FROM lineitem GROUP BY 1, 2, 3)"""


def spots(spark, sf):
    """Single measured spots with an alphanumeric array coordinate."""
    line = table(spark, sf, "lineitem")
    letter = F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (F.col("l_partkey") % 26 + 1).cast("int"), 1)
    return line.select(
        F.concat(letter, (F.col("l_partkey") % 24 + 1).cast("string")).alias("coord"),
        F.col("l_orderkey").alias("spot_id"), "l_linenumber",
        F.col("l_returnflag").alias("bait"), F.col("l_linestatus").alias("copy"),
        F.col("l_extendedprice").alias("signal"),
    )


SPOT_SQL = """spot AS (
  SELECT substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(l_partkey % 26 + 1 AS BIGINT), 1)
         || CAST(l_partkey % 24 + 1 AS VARCHAR) AS coord,
         l_orderkey AS spot_id, l_linenumber, l_returnflag AS bait, l_linestatus AS copy, l_extendedprice AS signal
  FROM lineitem)"""


def tm_ranges(spark, sf):
    """Two-helix pattern repeated over every protein: begin/end from residue 30 on, every 60 residues."""
    p = proteins(spark, sf).select("protein_id", F.length("seq").alias("n"))
    k = F.explode(F.when(F.col("n") >= 50, F.sequence(F.lit(0), ((F.col("n") - 50) / 60).cast("int")))).alias("k")
    return p.select("protein_id", k).select(
        "protein_id", (F.col("k") * 60 + 30).alias("begin"), (F.col("k") * 60 + 50).alias("end")
    )


TM_SQL = """tm AS (
  SELECT protein_id, k * 60 + 30 AS b, k * 60 + 50 AS e
  FROM (SELECT protein_id, unnest(range(0, (length(seq) - 50) // 60 + 1)) AS k FROM protein WHERE length(seq) >= 50))"""


def domains(spark, sf, given=None):
    """Topological domains of 40 residues that tile every protein, or every one of a given table of proteins."""
    p = (proteins(spark, sf) if given is None else given).select("protein_id", F.length("seq").alias("n"))
    kind = (F.col("protein_id") + F.col("k")) % 3
    tiles = F.when(F.col("n") >= 1, F.sequence(F.lit(0), F.expr("cast((n - 1) div 40 as int)")))
    return p.select("protein_id", "n", F.explode(tiles).alias("k")).select(
        F.col("protein_id").alias("accession"),
        F.col("k").alias("ord"),
        F.when(kind == 1, "transmembrane region").otherwise("topological domain").alias("type"),
        F.when(kind == 0, "Cytoplasmic").when(kind == 1, "Helical").otherwise("Extracellular").alias("description"),
        (F.col("k") * 40 + 1).alias("begin"),
        F.least(F.col("k") * 40 + 40, F.col("n")).alias("end"),
    )


DOMAIN_SQL = """domain AS (
  SELECT protein_id AS accession, k AS ord,
         CASE WHEN (protein_id + k) % 3 = 1 THEN 'transmembrane region' ELSE 'topological domain' END AS type,
         CASE (protein_id + k) % 3 WHEN 0 THEN 'Cytoplasmic' WHEN 1 THEN 'Helical' ELSE 'Extracellular' END AS description,
         k * 40 + 1 AS b, least(k * 40 + 40, n) AS e
  FROM (SELECT protein_id, length(seq) AS n, unnest(range(0, (length(seq) - 1) // 40 + 1)) AS k
        FROM protein WHERE length(seq) >= 1))"""


def pixels(spark, sf):
    """One image per event type, 40 pixels wide, filled in event order."""
    e = table(spark, sf, "events")
    return e.select(
        F.lit("scan").alias("image"),
        F.expr("cast(event_id div 40 as int)").alias("y"), (F.col("event_id") % 40).cast("int").alias("x"),
        (F.col("value") / 500).alias("v"),
    )


PIXEL_SQL = """pixel AS (
  SELECT 'scan' AS image, CAST(event_id // 40 AS INT) AS y, CAST(event_id % 40 AS INT) AS x, value / 500 AS v
  FROM events)"""


def motif_rows(spark, sf):
    """Scored motif rows of several species tables, in file order."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("input_ord"),
        F.expr("event_id div 10").alias("protein_id"),
        F.expr("event_id div 30").alias("gene_id"),
        F.col("event_type").alias("taxid"),
        (F.col("value") >= 50).alias("host_call"),
        F.col("value").alias("binding"),
        (F.col("user_id") % 3 == 0).alias("accessible"),
        (F.col("user_id") * 0.25).alias("classical"),
        F.when(F.col("user_id") % 4 > 0, F.concat(F.lit("h"), F.col("user_id").cast("string"))).alias("homolog_id"),
        (F.col("value") / 500).alias("similarity"),
        (F.col("value") >= 60).alias("model_call"),
        F.concat(F.lit("NP_"), F.col("event_id").cast("string")).alias("refseq"),
    )


MOTIF_ROW_SQL = """motif_row AS (
  SELECT event_id AS input_ord, event_id // 10 AS protein_id, event_id // 30 AS gene_id, event_type AS taxid,
         value >= 50 AS host_call, value AS binding, user_id % 3 = 0 AS accessible, user_id * 0.25 AS classical,
         CASE WHEN user_id % 4 > 0 THEN 'h' || user_id END AS homolog_id, value / 500 AS similarity,
         value >= 60 AS model_call, 'NP_' || event_id AS refseq
  FROM events)"""
