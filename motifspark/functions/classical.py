"""The classical additive score: acidic tract points plus core matrix points."""

from pyspark.sql import functions as F

from motifspark import constants as K
from motifspark.functions.sequence import letter_index, letter_table, residue_at


def core_matrix(text=K.CLASSICAL_MATRIX):
    """``{position: {residue: points}}`` from an aa-by-position table."""
    head, *rows = [line.split() for line in text.strip().splitlines()]
    positions = [int(h.lstrip("#")) for h in head[1:]]
    return {p: {row[0]: float(row[i + 1]) for row in rows} for i, p in enumerate(positions)}


def tract_table():
    """(charge of each letter in halves, points by charge): negative charges count from the end of the points."""
    charges = [int(2 * K.TRACT_CHARGES.get(chr(65 + i), 0.0)) for i in range(26)]
    points = [next((v for limit, v in K.TRACT_POINTS if c / 2 <= limit), K.TRACT_POINTS_ELSE) for c in (*range(0, 13), *range(-12, 0))]
    return charges, points


def tract_points(window):
    """Charges are multiples of a half, so the points of every possible sum fit one small table."""
    charges = letter_table(K.TRACT_CHARGES, 0.0)
    charge = sum((charges[letter_index(residue_at(window, i))] for i in range(2, 7)),
                 charges[letter_index(residue_at(window, 1))])
    points = [next((v for limit, v in K.TRACT_POINTS if c / 2 <= limit), K.TRACT_POINTS_ELSE) for c in range(-12, 13)]
    return F.array(*[F.lit(float(v)) for v in points])[(charge * 2 + 12).cast("int")]


def classical_score(window, n=K.MOTIF_LENGTH, matrix=None, min_length=None):
    """Lower is better. Unknown core residues give +infinity, a wrong length gives null."""
    core = sum(
        (letter_table(column, "Infinity")[letter_index(residue_at(window, pos))]
         for pos, column in sorted((matrix or core_matrix()).items())),
        F.lit(0.0),
    )
    fits = F.length(window).between(min_length or n, n)
    return F.when(fits, tract_points(window) + core)
