"""Oracle SQL of the training, as one chain of CTEs ending in ``pwm`` and ``base``."""

from motifspark import constants as K
from motifspark import fixtures as fx


def values(rows):
    return ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)


CLASS_ROWS = values([(c, a) for c, aas in K.CHEMICAL_CLASSES.items() for a in aas])
RULE_ROWS = values([(i, c) for i, c in enumerate(K.CHEMICAL_CLASSES)])
EQUIV_ROWS = values([(a, e) for a, es in K.EQUIVALENTS.items() for e in es])
ALPHA_ROWS = values([(a,) for a in K.RESIDUES_PHOSPHO])
FORCED = " ".join(f"WHEN pos = {p} AND aa NOT IN ({', '.join(repr(a) for a in aas)}) THEN 1.0" for p, aas in K.FORCED_REQUIRED.items())


def yule(a, b):
    x, y = f"({a} * (f - {b}))", f"((p - {a}) * {b})"
    return f"coalesce(({x} - {y})::DOUBLE / nullif({x} + {y}, 0), 0.0)"


def biserial(n1, r):
    return f"(2 * ({r} - {n1} * ({n1} + 1) / 2.0) / nullif({n1} * (p - {n1}), 0) - 1)"


STATS = f"""{fx.PEPTIDE_SQL},
cls(rule_class, aa) AS (VALUES {CLASS_ROWS}), rul(class_no, rule_class) AS (VALUES {RULE_ROWS}),
eqv(aa, e) AS (VALUES {EQUIV_ROWS}), alpha(aa) AS (VALUES {ALPHA_ROWS}),
res AS (SELECT peptide_id, seq, passes, greatest(signal, 0) AS signal, pos, substr(seq, pos, 1) AS aa
        FROM (SELECT *, unnest(range(1, 16)) AS pos FROM peptide)),
mem AS (SELECT rule_class, pos AS rule_pos, peptide_id, seq, passes, signal FROM res JOIN cls USING (aa)
        UNION ALL SELECT 'All', 0, peptide_id, seq, passes, greatest(signal, 0) FROM peptide),
rnk AS (SELECT *, CASE WHEN passes THEN rank() OVER (PARTITION BY rule_class, rule_pos, passes ORDER BY signal)
          + (count(*) OVER (PARTITION BY rule_class, rule_pos, passes, signal) - 1) / 2.0 END AS rk FROM mem),
st AS (SELECT rule_class, rule_pos, pos, substr(seq, pos, 1) AS aa, count(*) FILTER (WHERE passes) AS n_pass,
         count(*) FILTER (WHERE NOT passes) AS n_fail, sum(rk) AS rk
       FROM (SELECT *, unnest(range(1, 16)) AS pos FROM rnk) GROUP BY 1, 2, 3, 4),
tot AS (SELECT rule_class, rule_pos, count(*) FILTER (WHERE passes) AS p, count(*) FILTER (WHERE NOT passes) AS f
        FROM mem GROUP BY 1, 2),
grid AS (SELECT rule_class, rule_pos, p, f, pos, aa FROM (SELECT *, unnest(range(1, 16)) AS pos FROM tot), alpha),
b0 AS (SELECT g.*, coalesce(n_pass, 0) AS n_pass, coalesce(n_fail, 0) AS n_fail, rk
       FROM grid g LEFT JOIN st USING (rule_class, rule_pos, pos, aa)),
grp AS (SELECT b.rule_class, b.rule_pos, b.pos, q.aa, sum(n_pass) AS gp, sum(n_fail) AS gf, sum(rk) AS grk
        FROM b0 b JOIN eqv q ON b.aa = q.e GROUP BY 1, 2, 3, 4),
con AS (SELECT b0.*, gp, gf, {biserial("n_pass", "rk")} AS r_alone, {biserial("gp", "grk")} AS r_group,
          {yule("n_pass", "n_fail")} AS q, {yule("gp", "gf")} AS qg
        FROM b0 JOIN grp USING (rule_class, rule_pos, pos, aa))"""


def cells(name, source, base):
    b_sub, b_forb = ("coalesce(b_sub, 0)", "coalesce(b_forb, 0)") if base else ("0.0", "0.0")
    b_pos = "nullif(b_pos, 0)" if base else "NULL::DOUBLE"
    same = "((q >= 0 AND qg >= 0) OR (q <= 0 AND qg <= 0))"
    never, gnever = "(n_pass = 0 AND n_fail >= 8)", "(gp = 0 AND gf >= 8)"
    return f"""{name}_raw AS (SELECT *,
  CASE WHEN n_pass = 0 THEN 0.0 WHEN n_pass > 5 AND r_alone IS NOT NULL THEN r_alone ELSE coalesce(r_group, 0.0) END AS positive,
  CASE WHEN n_pass + n_fail = 0 THEN 0.0 WHEN n_pass + n_fail >= 5 THEN greatest(-q, 0)
       WHEN gp + gf >= 5 THEN CASE WHEN {same} THEN greatest(-qg, 0) ELSE 0.0 END ELSE {b_sub} END AS suboptimal,
  CASE WHEN n_pass + n_fail = 0 THEN 0.0 WHEN n_pass + n_fail >= 5 THEN CASE WHEN {never} THEN 1.0 ELSE 0.0 END
       WHEN gp + gf >= 5 THEN CASE WHEN {same} AND {gnever} THEN 1.0 ELSE 0.0 END
       WHEN {never} THEN {b_forb} ELSE 0.0 END AS forbidden FROM {source}),
{name}_lent AS (SELECT r.rule_class, r.rule_pos, r.pos, e.aa, avg(nullif(positive, 0)) AS lp, avg(suboptimal) AS ls
  FROM {name}_raw r JOIN eqv e ON r.aa = e.e AND e.aa <> e.e GROUP BY 1, 2, 3, 4),
{name}_cell AS (SELECT r.rule_class, r.rule_pos, r.pos, r.aa,
  CASE WHEN n_pass = 0 THEN coalesce({b_pos}, lp, 0.0) ELSE positive END AS positive,
  CASE WHEN n_pass + n_fail = 0 THEN coalesce(ls, 0.0) ELSE suboptimal END AS suboptimal,
  CASE {FORCED} ELSE forbidden END AS forbidden
  FROM {name}_raw r LEFT JOIN {name}_lent USING (rule_class, rule_pos, pos, aa)),
{name}_two AS (SELECT rule_class, rule_pos, pos, translate(aa, 'BJO', 'STY') AS aa,
  {", ".join(f"max({k}) FILTER (WHERE aa NOT IN ('B','J','O')) AS {k}, max({k}) FILTER (WHERE aa IN ('B','J','O')) AS h_{k}" for k in ("positive", "suboptimal", "forbidden"))}
  FROM {name}_cell GROUP BY 1, 2, 3, 4),
{name} AS (SELECT rule_class, rule_pos, pos, aa,
  CASE WHEN abs(h_positive) >= abs(positive) THEN h_positive ELSE positive END AS positive,
  CASE WHEN h_suboptimal IS NOT NULL AND (suboptimal = 0 OR abs(h_suboptimal) < abs(suboptimal)) THEN h_suboptimal ELSE suboptimal END AS suboptimal,
  CASE WHEN h_forbidden = 0 THEN 0.0 ELSE forbidden END AS forbidden FROM {name}_two)"""


BASE = STATS + ",\n" + "con0 AS (SELECT * FROM con WHERE rule_class = 'All'),\n" + cells("base", "con0", False)

COUNTS = """cnt AS (SELECT r.rule_class, t.pos AS rule_pos, CAST(class_no * 15 + t.pos AS BIGINT) AS rule_no, coalesce(n, 0) AS n_members
  FROM rul r CROSS JOIN range(1, 16) t(pos) LEFT JOIN (SELECT rule_class, rule_pos, count(*) AS n FROM mem GROUP BY 1, 2) m
    ON m.rule_class = r.rule_class AND m.rule_pos = t.pos)"""

PWM = BASE + f""",
conb AS (SELECT c.*, b.positive AS b_pos, b.suboptimal AS b_sub, b.forbidden AS b_forb
         FROM con c LEFT JOIN base b ON b.pos = c.pos AND b.aa = c.aa),
{cells("rulem", "conb", True)},
{COUNTS},
pwm AS (SELECT c.rule_class, c.rule_pos, m.pos, m.aa, positive, suboptimal, forbidden FROM cnt c JOIN rulem m
  ON m.rule_class = CASE WHEN n_members < 24 THEN 'All' ELSE c.rule_class END
 AND m.rule_pos = CASE WHEN n_members < 24 THEN 0 ELSE c.rule_pos END)"""
