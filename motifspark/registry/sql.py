"""Shared pieces of the oracle SQL."""

from motifspark import constants as K
from motifspark import fixtures as fx
from motifspark.functions.classical import core_matrix


def sql_list(values, default):
    return "[" + ",".join(str(values.get(chr(65 + i), default)) for i in range(26)) + "]"


WINDOWS = f"""{fx.PROTEIN_SQL},
padded AS (SELECT protein_id, 'GGGGGG' || seq || 'GG' AS s FROM protein WHERE length(seq) >= 15),
chunk AS (SELECT protein_id, c, substr(s, c * 256 + 1, 270) AS t
          FROM (SELECT protein_id, s, unnest(range(0, (length(s) - 15) // 256 + 1)) AS c FROM padded)),
wnd AS (SELECT protein_id, c * 256 + i AS pos, substr(t, i, 15) AS motif
        FROM (SELECT protein_id, c, t, unnest(range(1, least(length(t) - 14, 256) + 1)) AS i FROM chunk))"""

CLASSICAL = "ctab AS (SELECT " + ", ".join(
    [f"{sql_list(K.TRACT_CHARGES, 0.0)}::DOUBLE[] AS tract"]
    + [f"{sql_list(col, 1e300)}::DOUBLE[] AS c{pos}" for pos, col in sorted(core_matrix().items())]
) + ")"


def classical_sql(m):
    def at(lst, pos):
        return f"{lst}[ascii(substr({m}, {pos}, 1)) - 64]"

    charge = "(" + " + ".join(at("tract", i) for i in range(1, 7)) + ")"
    core = " + ".join(at(f"c{i}", i) for i in range(7, 14))
    points = f"CASE WHEN {charge} <= -4 THEN 0 WHEN {charge} <= -3 THEN 0.5 WHEN {charge} <= -2 THEN 1 ELSE 1.5 END"
    return f"(CASE WHEN ({core}) >= 1e300 THEN 'Infinity'::DOUBLE ELSE {points} + {core} END)"


HITS = f"""{WINDOWS}, {CLASSICAL},
cand AS (
  SELECT protein_id, row_number() OVER (PARTITION BY protein_id ORDER BY pos) - 1 AS ord,
         translate(motif, 'U', 'C') AS motif
  FROM wnd WHERE substr(motif, 8, 1) IN ('F','Y') AND substr(motif, 10, 1) IN ('D','E','S','T')
    AND contains('AVILMFYWSTHNQCGP', substr(motif, 11, 1)) AND NOT contains(motif, 'X')),
hit AS (
  SELECT protein_id, ord, motif, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY protein_id ORDER BY round(score, 9), ord) AS rank
    FROM (SELECT protein_id, ord, motif, {classical_sql("motif")} AS score FROM cand, ctab))
  WHERE rank <= 3)"""
