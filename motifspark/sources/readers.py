"""File sources. Each reader gives a typed table; where later rows win, ``input_ord`` keeps the file order."""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motifspark.sources.tables import fan_out


def _file_order():
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("line"))


def _strings(*names):
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def fasta(spark, path):
    """One row per record: id, transcript, gene, gene symbol, sequence, and its place in the file.

    A record begins where a line begins with ``>``; the sign may stand anywhere else in a header. Spark's text reader
    cuts at that mark itself, so a large file is read in splits. Lines may end in CRLF. An id does not begin with ``>``.
    """
    records = spark.read.option("lineSep", "\n>").text(path).withColumn("value", F.regexp_replace("value", r"^[\s\x{feff}]*>", ""))
    records = records.filter(F.trim("value") != "")
    head = F.regexp_replace(F.substring_index("value", "\n", 1), r"\s+$", "")
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")

    def tagged(tag):
        return F.regexp_extract(head, rf"(?:^|\s)\S*{tag}\S*?:(\S*)", 1)

    gene = F.regexp_extract(head, r"(?:^|\s)(?!\S*gene_symbol)\S*gene:(\S*)", 1)
    transcript = F.regexp_extract(head, r"(?:^|\s)(?!\S*gene)\S*transcript:(\S*)", 1)
    return records.select(
        F.substring_index(head, " ", 1).alias("id"), transcript.alias("transcript"), gene.alias("gene"),
        tagged("gene_symbol").alias("gene_symbol"), body.alias("sequence"), _file_order().alias("input_ord"),
    )


HOMOLOGENE = T.StructType([
    T.StructField("hid", T.LongType()), T.StructField("taxid", T.LongType()), T.StructField("gene_id", T.LongType()),
    T.StructField("gene_name", T.StringType()), T.StructField("protein_gi", T.LongType()),
    T.StructField("protein_accession", T.StringType()),
])


def homologene(spark, path):
    rows = spark.read.csv(path, sep="\t", schema=HOMOLOGENE)
    return rows.select("*", _file_order().alias("input_ord"))


def protein_table(spark, paths, schema=None):
    """One or more protein tables with a header; all columns are text."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(paths)


def tm_ranges(spark, path):
    """Helix ranges by protein from either header dialect; rows without both ends are dropped."""
    rows = spark.read.csv(path, sep="," if path.rstrip("/").endswith(".csv") else "\t", header=True)

    def either(name, title):
        return F.col(name if name in rows.columns else f"`{title}`")

    out = rows.select(
        either("ensembl_peptide_id", "Protein stable ID").alias("protein_id"),
        either("start", "Transmembrane helices start").cast("double").cast("int").alias("begin"),
        either("end", "Transmembrane helices end").cast("double").cast("int").alias("end"),
    )
    return out.dropna(subset=["begin", "end"])


UNIPROT_ENTRY = T.StructType([
    T.StructField("accession", T.ArrayType(T.StringType())),
    T.StructField("feature", T.ArrayType(T.StructType([
        T.StructField("_type", T.StringType()), T.StructField("_description", T.StringType()),
        T.StructField("location", T.StructType([
            T.StructField("begin", T.StructType([T.StructField("_position", T.IntegerType())])),
            T.StructField("end", T.StructType([T.StructField("_position", T.IntegerType())])),
        ])),
    ]))),
    T.StructField("sequence", T.StringType()),
])


def uniprot_topology(spark, path):
    """(domains, sequences) per accession; entries without a located topology feature are left out."""
    entries = spark.read.format("xml").option("rowTag", "entry").schema(UNIPROT_ENTRY).load(path)
    located = F.filter("feature", lambda f: f["_type"].rlike("topo|transmem|intramem") & f["location"]["begin"]["_position"].isNotNull()
                       & f["location"]["end"]["_position"].isNotNull())
    kept = entries.select("accession", "sequence", located.alias("f")).filter(F.size("f") > 0)
    each = kept.select(F.explode("accession").alias("accession"), "sequence", "f")
    domains = each.select("accession", F.posexplode("f").alias("ord", "d")).select(
        "accession", "ord", F.col("d._type").alias("type"), F.col("d._description").alias("description"),
        F.col("d.location.begin._position").alias("begin"), F.col("d.location.end._position").alias("end"),
    )
    return domains, each.select("accession", F.regexp_replace("sequence", r"\s", "").alias("sequence"))


def coordinate_names(spark, path, columns=("name",)):
    """Headerless lookup by the first column; the last row of a key counts.

    Files are numbered by path, so that a row carries its place as numbers and not as the path of its file. Each split is
    dealt by key into many small tasks before its rows are sorted for combining; a frequent key stays spread over splits.
    """
    source = spark.read.csv(path, schema=_strings("coord", *columns))
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("_file")).distinct()  # lists, reads no content
    files = files.select("_file", F.shiftleft(F.row_number().over(Window.orderBy("_file")).cast("long"), 40).alias("_n"))
    rows = source.select("*", _file_order().alias("_o")).select("coord", *columns, F.col("_o.file").alias("_file"), F.col("_o.block").alias("_block"),
                                                                F.col("_o.line").alias("_line"))
    rows = rows.join(F.broadcast(files), "_file").select("coord", *columns, (F.col("_n") + F.col("_block")).alias("_block"), "_line")
    rows = fan_out(rows.withColumn("_split", F.shiftright("_line", 33)), "coord", "_split")
    last = rows.groupBy("coord").agg(F.max_by(F.struct(*columns), F.struct("_block", "_line")).alias("_l"))
    return last.select("coord", "_l.*")


def matrix(spark, path):
    """Residue rows by ``#position`` columns, as (aa, pos, value)."""
    wide = spark.read.csv(path, header=True)
    first, *positions = wide.columns
    long = wide.unpivot([first], positions, "column", "value")
    return long.select(F.col(first).alias("aa"), F.expr("cast(substring(column, 2) as int)").alias("pos"), F.col("value").cast("double").alias("value"))


def accession_table(spark, path, columns=("ensembl_peptide_id", "uniprot", "trembl")):
    rows = spark.read.csv(path, sep="\t", schema=_strings(*columns))
    return rows.select("*", _file_order().alias("input_ord"))
