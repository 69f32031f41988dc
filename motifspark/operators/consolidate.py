"""From scored motif rows to one row per protein and one per gene."""

from functools import reduce

from pyspark.sql import functions as F


def first_by(df, keys, order, columns):
    """The first row per key in an explicit order. Partial results are combined before the shuffle."""
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_b"))
    return best.select(*keys, "_b.*")


def down(column):
    """Descending sort key for use inside a struct; nulls last."""
    number = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.struct(number.isNull().alias("n"), (-number).alias("v"))


def up(column):
    return F.struct(F.col(column).isNull().alias("n"), F.col(column).alias("v"))


def host_rows(df, columns, key="protein_id", order="input_ord"):
    return first_by(df, [key], [F.col(order)], columns)


REFSEQ = ("refseq_peptide", "refseq_peptide_predicted")


def homolog_rows(df, key=("protein_id",), classical=False):
    """Best homolog row per key (a protein, or a motif of one) and species, with both RefSeq ids it came from.

    Called motifs come first, except for classical motifs, which have no call; then the most similar, then input order.
    """
    key = [key] if isinstance(key, str) else list(key)
    order = ([] if classical else [down("model_call")]) + [down(F.round("similarity", 9)), F.col("input_ord")]
    kept = [c for c in ("homolog_id", "homolog_motif", "similarity", "identity", "model_call", "homolog_total") if c in df.columns]
    kept += [F.col(c).alias(f"match_{c}") for c in ("refseq", *REFSEQ) if c in df.columns]
    return first_by(df, [*key, "taxid"], order, kept)


def check_unique(df, keys, name):
    """The frame itself; running it fails if a key occurs more than once."""
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*[c for c in df.columns if c not in keys])).alias("_r"))
    bad = F.raise_error(F.concat(F.lit(f"{name}: key is not unique: "), *[F.col(k).cast("string") for k in keys]))
    return n.withColumn("_ok", F.when(F.col("_n") == 1, F.lit(True)).otherwise(bad.cast("boolean"))).filter("_ok").select(*keys, "_r.*")


def merge_species(frames, key="protein_id"):
    """Full outer join of per-species tables on a unique key; host columns come from the first."""
    parts = [check_unique(f, [key], name) for name, f in frames.items()]
    return reduce(lambda a, b: a.join(b, key, "full"), parts)


GENE_ORDER = ("accessible", "host_call", "binding")
CLASSICAL_ORDER = ((down, "accessible"), (up, "classical"))


def gene_rows(df, columns, gene="gene_id"):
    """Best novel row per gene: accessible, then called, then by binding, then input order."""
    return first_by(df, [gene], [*[down(c) for c in GENE_ORDER], F.col("input_ord")], columns)


def gene_species_rows(df, columns, gene="gene_id", order=None):
    """Best row per gene and species; rows with a homolog first, then as `gene_rows`, or in another order of sort keys."""
    has = (F.col("homolog_id").isNotNull() & (F.col("homolog_id") != "")).cast("int")
    order = [down(c) for c in GENE_ORDER] if order is None else [way(c) for way, c in order]
    return first_by(df, [gene, "taxid"], [down(has), *order, F.col("input_ord")], columns)


def widen_species(rows, taxids, columns, gene="gene_id"):
    return rows.groupBy(gene).agg(*[
        F.max(F.when(F.col("taxid") == t, F.col(c))).alias(f"{t}_Host_Match_{c}") for t in taxids for c in columns
    ])


def classical_gene_rows(df, columns, gene="gene_id"):
    return first_by(df, [gene], [down("accessible"), up("classical"), F.col("input_ord")], columns)


def merge_gene_tables(novel, classical, gene="gene_id"):
    """Full outer join; columns of both sides are told apart by a suffix."""
    def named(df, suffix, other):
        return df.select(gene, *[F.col(c).alias(c + suffix if c in other.columns else c) for c in df.columns if c != gene])

    return named(novel, "_novel", classical).join(named(classical, "_classical", novel), gene, "full")
