"""Where a motif lies among the topological domains of its protein."""

from pyspark.sql import functions as F

from motifspark import constants as K


def motif_position(motif, sequence, trim_begin=K.TRIM_BEGIN, trim_end=K.TRIM_END):
    """0-based first occurrence of the trimmed motif; null for a blank motif or no occurrence."""
    core = F.substring(motif, F.lit(trim_begin + 1), F.length(motif) - trim_begin - trim_end)
    found = F.position(core, sequence)
    return F.when((F.length(motif) > trim_begin + trim_end) & (found > 0), found - 1)


def classify(motifs, sequences, domains, trim_begin=K.TRIM_BEGIN, trim_end=K.TRIM_END):
    """Joined types and descriptions of the domains a motif meets, in order, up to the first that contains it.

    ``motifs`` has accession, rank and motif, and family where there are several; ``domains`` accession, ord, type,
    description, begin, end.
    """
    key = [c for c in ("accession", "family", "rank") if c in motifs.columns]
    placed = motifs.join(sequences.select("accession", "sequence"), "accession", "left").select(
        *key, "motif", motif_position(F.col("motif"), F.col("sequence"), trim_begin, trim_end).alias("start")
    )
    size = F.greatest(F.length("motif") - trim_begin - trim_end, F.lit(0))
    placed = placed.withColumn("stop", F.col("start") + size)
    b, e = F.col("begin") - 1, F.col("end") - 1
    x = placed.filter("start is not null").join(domains, "accession")
    within = (F.col("start") >= b) & (F.col("stop") <= e)
    head = (F.col("start") >= b) & (F.col("start") <= e) & (F.col("stop") > e)
    tail = (F.col("start") < b) & (F.col("stop") > b) & (F.col("stop") <= e)
    middle = (F.col("start") < b) & (F.col("stop") > e)
    met = x.filter(within | head | tail | middle).select(
        *key, "ord", within.alias("_within"), F.coalesce("type", F.lit("")).alias("type"), F.coalesce("description", F.lit("")).alias("description")
    )
    stop = F.min(F.when(F.col("_within"), F.col("ord")))
    rows = met.groupBy(*key).agg(stop.alias("_stop"), F.array_sort(F.collect_list(F.struct("ord", "type", "description"))).alias("_d"))
    kept = F.filter("_d", lambda d: F.col("_stop").isNull() | (d["ord"] <= F.col("_stop")))
    text = rows.select(*key, F.array_join(F.transform(kept, lambda d: d["type"]), ";").alias("type"),
                       F.array_join(F.transform(kept, lambda d: d["description"]), ";").alias("description"))
    return placed.select(*key, "motif", "start").join(text, key, "left").withColumns(
        {c: F.coalesce(c, F.lit("")) for c in ("type", "description")}
    )


def accessible(motif, kind, description):
    """A motif without topology, or anything on a cytoplasmic topological domain."""
    exists = F.coalesce(motif, F.lit("")) != ""
    return (exists & (F.coalesce(kind, F.lit("")) == "")) | ((kind == "topological domain") & (description == "Cytoplasmic"))
