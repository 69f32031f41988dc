from pyspark.sql import functions as F

from motifspark import fixtures as fx
from motifspark.operators import spots as P
from motifspark.registry import q6, r6, register

CELL, RADIUS = 10, 4

GRID = f"""{fx.PIXEL_SQL}, size AS (SELECT image, max(y) + 1 AS height, max(x) + 1 AS width FROM pixel GROUP BY 1),
grid AS (SELECT image, row, col, row * 10 + 5 AS cy, col * 10 + 5 AS cx, row * 10 AS top, least(row * 10 + 10, height) AS bottom,
  col * 10 AS "left", least(col * 10 + 10, width) AS "right"
  FROM (SELECT *, unnest(range(0, CAST(ceil(width / 10) AS BIGINT))) AS col FROM (
    SELECT *, unnest(range(0, CAST(ceil(height / 10) AS BIGINT))) AS row FROM size)))"""


def quant_sql(spots):
    return f"""{GRID}, sp AS ({spots}),
q AS (SELECT image, row, col, cy, cx,
    sum(v) FILTER (WHERE ins) AS inside_sum, count(*) FILTER (WHERE ins) AS inside_count,
    sum(v) FILTER (WHERE NOT ins) AS outside_sum, count(*) FILTER (WHERE NOT ins) AS outside_count,
    median(v) FILTER (WHERE NOT ins) AS outside_median
  FROM (SELECT s.*, v, (y - cy) * (y - cy) + (x - cx) * (x - cx) <= 16 AS ins FROM sp s JOIN pixel p
        ON s.image = p.image AND y >= cy - 10 AND y < cy + 10 AND x >= cx - 10 AND x < cx + 10) GROUP BY ALL),
qq AS (SELECT *, CASE WHEN outside_median * inside_count = 0 THEN 'Infinity'::DOUBLE ELSE inside_sum / (outside_median * inside_count) END AS call_index,
  inside_sum - inside_count * outside_sum / outside_count AS bas FROM q)"""


OUT = ", ".join(f"{q6(c)} AS {c}" for c in ("inside_sum", "outside_sum", "outside_median", "call_index", "bas"))


def _show(q):
    return q.select("image", "row", "col", "cy", "cx", "inside_count", "outside_count",
                    *[r6(F.col(c)).alias(c) for c in ("inside_sum", "outside_sum", "outside_median", "call_index", "bas")])


def _grid(pixels):
    return P.regular_grid(P.image_sizes(pixels), CELL)


@register("a20_spot_quantification", f"""
WITH {quant_sql('SELECT image, row, col, cy, cx FROM grid')}
SELECT image, row, col, cy, cx, inside_count, outside_count, {OUT} FROM qq""")
def a20(spark, sf):
    px = fx.pixels(spark, sf)
    return _show(P.quantify(px, _grid(px).select("image", "row", "col", "cy", "cx"), RADIUS, CELL))


@register("a21_best_centre", f"""
WITH {quant_sql("SELECT image, row, col, cy + dy AS cy, cx + dx AS cx FROM grid, (VALUES (-1), (0)) a(dy), (VALUES (-1), (0)) b(dx)")},
best AS (SELECT *, row_number() OVER (PARTITION BY image, row, col ORDER BY isinf(call_index), round(call_index, 9) DESC, cy, cx) AS k FROM qq)
SELECT image, row, col, cy, cx, inside_count, outside_count, {OUT} FROM best WHERE k = 1""")
def a21(spark, sf):
    px = fx.pixels(spark, sf)
    return _show(P.best_centres(px, _grid(px), RADIUS, CELL))


@register("a22_regular_grid", f'WITH {GRID} SELECT * FROM grid')
def a22(spark, sf):
    return _grid(fx.pixels(spark, sf))


@register("a23_pixel_linearization", f"""
WITH {fx.PIXEL_SQL}, p AS (SELECT image, y, x, v * 1.5 - 0.1 AS v FROM pixel), t AS (SELECT image, max(v) AS top FROM p GROUP BY 1)
SELECT image, y, x, {q6("pow(2, greatest(v, 0) / CASE WHEN top > 1 THEN top ELSE 1 END)")} AS v FROM p JOIN t USING (image)""")
def a23(spark, sf):
    px = fx.pixels(spark, sf).withColumn("v", F.col("v") * 1.5 - 0.1)
    return P.linearize(px, base=2, bright="scale").select("image", "y", "x", r6(F.col("v")).alias("v"))
