"""Proteome scan: windows, rules, scores and the best motifs of each protein."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from motifspark import constants as K
from motifspark.functions import sequence as S
from motifspark.functions.classical import classical_score, core_matrix, tract_table
from motifspark.sources.tables import fan_out


def mask_transmembrane(proteins, ranges, id_col="protein_id", start_tolerance=0, end_tolerance=0):
    """Replace every helix range by one X. ``ranges`` has the id, begin and end."""
    cuts = ranges.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("_cuts"))
    masked = S.mask_ranges(F.col("seq"), F.col("_cuts"), start_tolerance, end_tolerance)
    return proteins.join(cuts, id_col, "left").withColumn("seq", masked).drop("_cuts")


def valid_sequences(proteins, n=K.MOTIF_LENGTH):
    return proteins.withColumn("seq", S.scan_text(F.col("seq"), n)).filter(F.col("seq").isNotNull())


def all_windows(proteins, n=K.MOTIF_LENGTH, keep=("protein_id",), together=()):
    """Every padded window of every valid protein with its 1-based position.

    With ``together`` the proteins are dealt by these keys before they are cut. Grouping the windows by them then moves no
    window between tasks.
    """
    if together:
        proteins = fan_out(proteins.select(*dict.fromkeys((*keep, *together, "seq"))), *together, pieces=4)
    text = S.padded(S.scan_text(F.col("seq"), n))
    return proteins.select(*keep, F.posexplode(S.windows(text, n)).alias("pos", "motif")).withColumn(
        "pos", F.col("pos") + 1
    )


def candidate_windows(proteins, rules=None, n=K.MOTIF_LENGTH, keep=("protein_id",)):
    """Windows that satisfy the rules and are free of X, numbered in order; selenocysteine becomes cysteine."""
    text = S.padded(S.scan_text(F.col("seq"), n))
    found = proteins.select(*keep, F.posexplode(S.rule_windows(text, rules, n)).alias("ord", "motif"))
    return found.select(*keep, F.col("ord"), F.translate("motif", "U", "C").alias("motif"))


def top_k(windows, order, k=3, key="protein_id"):
    """First k rows per key; the limit is applied before the shuffle as well as after it."""
    w = Window.partitionBy(key).orderBy(*order)
    return windows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def pad_ranks(proteins, hits, k=3, key="protein_id"):
    """Exactly k rows per protein; missing ranks are blank."""
    grid = proteins.select(key, F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    return grid.join(hits, [key, "rank"], "left")


def best_hits(scored, k=3):
    """Passing motifs first, each group by the length of (total, binding), ties by order of appearance."""
    norm = F.round(F.sqrt(F.col("total") * F.col("total") + F.col("binding") * F.col("binding")), 9)
    return top_k(
        scored.withColumn("norm", norm),
        [F.col("call").desc(), F.col("norm").desc_nulls_last(), F.col("ord")],
        k,
    )


def rule_hits(proteins, k=3, rules=None, n=K.MOTIF_LENGTH):
    """Best rule-satisfying motifs by the classical score."""
    scored = candidate_windows(proteins, rules, n).withColumn("score", classical_score(F.col("motif"), n))
    return top_k(scored, [F.round("score", 9), F.col("ord")], k)


#: Characters that are scored together, and the line ends that no window reaches over.
TOGETHER = 1 << 20
LINE_ENDS = (0x0A, 0x0D, 0x85, 0x2028, 0x2029)


def lowest_windows(proteins, k=3, n=K.MOTIF_LENGTH):
    """Of every protein row the windows of :func:`all_windows` that can be among its k lowest by the classical score.

    All windows of a strip of rows are scored at once, position by position; k of each row leave the task. Windows with
    signs other than A to Z go first, so that scoring them fails as it does elsewhere.
    """
    charges, points = tract_table()
    core = {}
    for pos, column in sorted(core_matrix().items()):
        core[pos] = np.zeros(27)
        core[pos][:26] = [column.get(chr(65 + i), np.inf) for i in range(26)]
    charge = np.zeros(27, np.int8)
    charge[:26] = charges
    points = np.asarray(points)

    def scores(codes):
        """Score of the window at each place of a strip of codes."""
        places = len(codes) - n + 1
        held = charge[codes]
        tract = sum((held[i : i + places] for i in range(1, 6)), held[:places])
        total = np.zeros(places)
        for pos, column in core.items():
            total += column[codes[pos - 1 : pos - 1 + places]]
        total = np.round(points[tract] + total, 9)
        odd = np.flatnonzero(codes == 26)
        for i in range(max(core)):
            total[odd[(odd >= i) & (odd - i < places)] - i] = -np.inf
        return total

    def lowest(texts):
        """(text, place) of the chosen windows of some texts; every text has a window."""
        letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        codes = np.minimum(letters - np.uint32(65), np.uint32(26)).astype(np.intp)
        sizes = np.array([len(t) for t in texts], np.int64)
        total, begin = scores(codes), np.cumsum(sizes) - sizes
        broken = np.isin(letters, LINE_ENDS)
        if broken.any():
            past = np.concatenate([[0], np.cumsum(broken)])
            total[past[n:] > past[:-n]] = np.nan
        for number, (a, m) in enumerate(zip(begin.tolist(), (sizes - n + 1).tolist())):
            own = total[a : a + m]
            limit = np.partition(own, k - 1)[k - 1] if m > k else np.nan
            place = np.flatnonzero(own <= limit if limit == limit else own == own)  # nan sorts last
            for at in place[np.argsort(own[place], kind="stable")][:k].tolist():
                yield number, at

    def choose(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= TOGETHER):
                    size += len(texts[to])
                    to += 1
                found = list(lowest(texts[at:to]))
                own = pa.array([at + number for number, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(own), pa.array([place + 1 for _, place in found], pa.int32()),
                    pa.array([texts[at + number][place : place + n] for number, place in found], pa.string()),
                ], names=["protein_id", "pos", "motif"])
                at = to

    text = S.padded(S.scan_text(F.col("seq"), n))
    kind = proteins.schema["protein_id"].dataType.simpleString()
    return proteins.select("protein_id", text.alias("_text")).filter(F.length("_text") >= n).mapInArrow(choose, f"protein_id {kind}, pos int, motif string")


def classical_hits(proteins, k=3, n=K.MOTIF_LENGTH):
    """Classical best motifs without position rules; padded with a blank motif and +infinity."""
    scored = lowest_windows(proteins, k, n).withColumn("score", classical_score(F.col("motif"), n))
    hits = top_k(scored, [F.round("score", 9), F.col("pos")], k).select("protein_id", "rank", "motif", "score")
    slots = F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank")
    grid = proteins.select("protein_id", F.col("seq").isNotNull().alias("_text"), slots)
    blank = F.when(F.col("motif").isNull(), F.lit(float("inf"))).otherwise(F.col("score"))
    return grid.join(hits, ["protein_id", "rank"], "left").select(
        "protein_id", "rank", F.coalesce("motif", F.lit("")).alias("motif"),
        F.when(F.col("_text"), blank).alias("score"),
    )


def widen_hits(hits, values, k=3, key="protein_id", prefix=""):
    """One row per protein with one column per rank and value."""
    names = [S.ordinal(i) for i in range(1, k + 1)]
    cols = []
    for i, name in enumerate(names, start=1):
        for v in values:
            label = f"{prefix}{name}_motif" if v == "motif" else f"{prefix}{name}_{v}"
            cols.append(F.max(F.when(F.col("rank") == i, F.col(v))).alias(label))
    return hits.groupBy(key).agg(*cols)
