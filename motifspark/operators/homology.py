"""Motifs in homologous proteins: best gapless match, scores, and the best homolog per motif and species."""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from motifspark import constants as K
from motifspark.functions import sequence as S
from motifspark.functions.classical import classical_score
from motifspark.sources.tables import fan_out

MATCH = StructType([StructField("start", IntegerType()), StructField("similarity", DoubleType())])


def substitution_scores(text=K.BLOSUM62, normalize=True):
    """``{(motif residue, target residue): score}`` from a lower-triangle table, divided by the target's maximum."""
    rows = [line.split() for line in text.strip().splitlines()]
    letters = [r[0] for r in rows]
    raw = {}
    for r in rows:
        for b, v in zip(letters, r[1:]):
            raw[r[0], b] = raw[b, r[0]] = float(v)
    top = {b: max(raw[a, b] for a in letters) or 1.0 for b in letters}
    return {(a, b): v / (top[b] if normalize else 1.0) for (a, b), v in raw.items()}


def score_table(scores):
    """Flat 26 x 26 list indexed by (motif letter, target letter); pairs without a score, and other characters, count 0."""
    return [scores.get((chr(65 + i), chr(65 + j)), 0.0) for i in range(26) for j in range(26)]


#: Sums of motifs and windows that are held together, and windows that are scored together.
HELD, STRIP = 1 << 20, 512


def _align(table, weights, n):
    """Arrow-batched alignment: all motifs of a target meet strips of its windows at once, two positions at a time."""
    w = np.asarray(weights, dtype=float)
    rows = np.zeros((27, 27))
    rows[:26, :26] = np.asarray(table, dtype=float).reshape(26, 26)
    code = np.full(256, 26, np.intp)
    code[65:91] = np.arange(26)
    pair = [(j, j + 1) for j in range(0, n - 1, 2)]

    def letters(text):
        return code[np.frombuffer(text.encode("ascii", "replace"), dtype=np.uint8)]

    def best(motifs, target, doubles):
        """First best window of a target, from 1, and its score, for each of some motifs."""
        places = len(target) - n + 1
        own = (rows[motifs] * w[:, None]).transpose(1, 2, 0).copy()  # position, target letter, motif
        both = [(own[i][:, None] + own[j][None, :]).reshape(27 * 27, -1) for i, j in pair]
        total, held = np.zeros((places, len(motifs))), np.empty((STRIP, len(motifs)))
        for a in range(0, places, STRIP):
            strip = total[a : a + STRIP]
            size = len(strip)
            for (i, _), values in zip(pair, both):
                strip += np.take(values, doubles[a + i : a + i + size], axis=0, out=held[:size], mode="clip")
            if n % 2:
                strip += np.take(own[n - 1], target[a + n - 1 : a + n - 1 + size], axis=0, out=held[:size], mode="clip")
        if w.sum() > 0:  # only windows that may round to the highest are rounded
            place, motif = np.nonzero(total >= total.max(axis=0) - 2e-9 * w.sum())
        else:
            place, motif = (x.ravel() for x in np.indices(total.shape))
        scores = np.round(total[place, motif] / w.sum(), 9)
        order = np.lexsort((place, -scores, motif))
        first = order[np.searchsorted(motif[order], np.arange(len(motifs)))]
        return place[first] + 1, scores[first]

    @F.pandas_udf(MATCH)
    def align(motif: pd.Series, target: pd.Series) -> pd.DataFrame:
        motifs, targets = motif.fillna("").tolist(), target.fillna("").tolist()
        by_target = {}
        for k, (m, t) in enumerate(zip(motifs, targets)):
            if len(m) == n and len(t) >= n:
                by_target.setdefault(t, {}).setdefault(m, []).append(k)
        starts, scores, known = np.zeros(len(motifs), np.int32), np.zeros(len(motifs)), {}
        for t, asked in by_target.items():  # a batch scores equal pairs once
            text = letters(t.replace("U", "C"))
            doubles = text[:-1] * 27 + text[1:]
            for m in asked.keys() - known.keys():
                known[m] = letters(m)
            own, step = list(asked), max(1, HELD // len(t))
            for a in range(0, len(own), step):
                some = own[a : a + step]
                for m, start, score in zip(some, *best(np.stack([known[m] for m in some]), text, doubles)):
                    starts[asked[m]], scores[asked[m]] = start, score
        return pd.DataFrame({"start": starts, "similarity": scores})

    return align


def best_match(pairs, motif="motif", target="target", weights=None, scores=None, n=K.MOTIF_LENGTH):
    """Slide each motif along its target; adds the first best window, its similarity and identity.

    One row in, one row out: the windows of a target never leave its row, so nothing is shuffled for them.
    """
    align = _align(score_table(scores or substitution_scores()), list(weights or [1.0] * n), n)
    t = F.col(target)
    found = pairs.withColumn("_motif", F.translate(F.col(motif), "U", "C"))
    found = found.withColumn("_best", align(F.col("_motif"), t)).withColumn(
        "match", F.when(F.col("_best.start") > 0, F.translate(F.substring(t, F.col("_best.start"), F.lit(n)), "U", "C")).otherwise("")
    )
    same = sum((F.when(S.residue_at(F.col("match"), j) == S.residue_at(F.col("_motif"), j), 1).otherwise(0) for j in range(1, n + 1)), F.lit(0))
    return found.withColumns({
        "similarity": F.col("_best.similarity"),
        "identity": F.when(F.col("_best.start") == 0, 0.0).otherwise(same / float(n)),
    }).drop("_best", "_motif")


def motif_homolog_pairs(hits, homologs):
    """Every host motif with every homolog of its protein; ``homologs`` has protein_id, taxid, j, homolog_id."""
    return hits.join(homologs, "protein_id")


def attach_targets(pairs, proteins):
    """The homolog's sequence. It comes last, so that long texts are shuffled once and not per motif."""
    seqs = proteins.select(F.col("protein_id").alias("homolog_id"), F.col("seq").alias("target"))
    return fan_out(pairs, "homolog_id").join(seqs, "homolog_id", "left")


def score_motifs(df, scorer, motif="match", rules=None):
    """Scores for motifs that satisfy the rules after U and X substitution; others get nulls and a false call.

    ``scorer`` adds its columns for the text in column ``_scored``. Scoring is a column expression, so finding
    the distinct motifs first would cost a shuffle and save nothing.
    """
    text = F.nullif(F.col(motif), F.lit(""))
    ready = df.withColumn("_valid", F.coalesce(S.satisfies_rules(text, rules), F.lit(False)))
    ready = ready.withColumn("_scored", F.when(F.col("_valid"), S.substitute_uncertain(text)))
    out = scorer(ready)
    if "call" in out.columns:
        out = out.withColumn("call", F.coalesce(F.col("call"), F.lit(False)))
    return out.drop("_scored").withColumnRenamed("_valid", "valid")


def classical_scorer(df):
    return df.withColumn("score", classical_score(F.col("_scored")))


def best_homolog(scored, by="similarity", keys=("protein_id", "rank", "taxid")):
    """Highest value among homologs whose motif satisfies the rules; among all if none does; first j on ties."""
    w = Window.partitionBy(*keys).orderBy(F.col("valid").desc(), F.round(by, 9).desc_nulls_last(), "j")
    return scored.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def classical_of_best(best, motif="match"):
    """Classical score of the chosen homolog motif, whether or not it satisfies the rules."""
    text = best.withColumn("_text", S.substitute_uncertain(F.nullif(F.col(motif), F.lit(""))))
    return text.withColumn("best_score", classical_score(F.col("_text"))).drop("_text")
