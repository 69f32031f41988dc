"""Spot quantification on a long pixel table (image, y, x, v)."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F


def linearize(pixels, base=1, bright="error"):
    """Negative values to zero; images with a maximum between 1 and 2 are scaled by it; powers of ``base`` undone.

    A maximum of 2 or more is an error, as such values are no encoding from 0 to 1; with ``bright="scale"`` it scales too.
    """
    top = pixels.groupBy("image").agg(F.max("v").alias("_top"))
    joined = pixels.join(top, "image")
    wrong = F.col("_top") >= 2 if bright == "error" else F.lit(False)
    scale = F.when(wrong, F.raise_error(F.lit("pixel values are not in the 0 to 1 range"))).when(
        F.col("_top") > 1, F.col("_top")).otherwise(F.lit(1.0)).cast("double")
    v = F.greatest(F.col("v"), F.lit(0.0)) / scale
    return joined.withColumn("v", v if base == 1 else F.pow(F.lit(float(base)), v)).drop("_top")


def regular_grid(images, cell):
    """Equal cells per image: centre at (i + 1/2)d, borders at i*d, the last one clipped to the image."""
    rows = F.explode(F.sequence(F.lit(0), F.ceil(F.col("height") / cell).cast("int") - 1)).alias("row")
    cols = F.explode(F.sequence(F.lit(0), F.ceil(F.col("width") / cell).cast("int") - 1)).alias("col")
    grid = images.select("image", "height", "width", rows).select("*", cols)
    return grid.select(
        "image", "row", "col",
        F.floor((F.col("row") + 0.5) * cell).cast("int").alias("cy"),
        F.floor((F.col("col") + 0.5) * cell).cast("int").alias("cx"),
        (F.col("row") * cell).alias("top"), F.least((F.col("row") + 1) * cell, F.col("height")).alias("bottom"),
        (F.col("col") * cell).alias("left"), F.least((F.col("col") + 1) * cell, F.col("width")).alias("right"),
    )


def image_sizes(pixels):
    return pixels.groupBy("image").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))


def _surroundings(pixels, spots, cell, reach=0):
    """Pixels from ``cell + reach`` before to ``cell + reach - 1`` behind each spot's centre, with their distances dy, dx.

    Each spot is listed once for every grid cell its box touches, so pixels meet spots on equal (image, cell).
    """
    wide = cell + reach

    def cells(centre):
        return F.explode(F.sequence(F.floor((centre - wide) / cell).cast("int"), F.floor((centre + wide - 1) / cell).cast("int")))

    wanted = spots.select("*", cells(F.col("cy")).alias("_gy")).select("*", cells(F.col("cx")).alias("_gx"))
    placed = pixels.select(
        "image", F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("v").alias("_v"),
        F.floor(F.col("y") / cell).cast("int").alias("_gy"), F.floor(F.col("x") / cell).cast("int").alias("_gx"),
    )
    dy, dx = F.col("_y") - F.col("cy"), F.col("_x") - F.col("cx")
    return placed.join(wanted, ["image", "_gy", "_gx"]).filter(dy.between(-wide, wide - 1) & dx.between(-wide, wide - 1)).withColumns({"_dy": dy, "_dx": dx})


def quantify(pixels, spots, radius, cell, buffer=0):
    """Signal of each spot (image, row, col, cy, cx) against its surrounding box of twice the cell size."""
    met = _surroundings(pixels, spots, cell)
    dy, dx = F.col("_dy"), F.col("_dx")
    inside = dy * dy + dx * dx <= radius * radius
    outside = dy * dy + dx * dx > (radius + buffer) * (radius + buffer)
    q = met.groupBy("image", "row", "col", "cy", "cx").agg(
        F.sum(F.when(inside, F.col("_v"))).alias("inside_sum"), F.count_if(inside).alias("inside_count"),
        F.sum(F.when(outside, F.col("_v"))).alias("outside_sum"), F.count_if(outside).alias("outside_count"),
        F.percentile(F.when(outside, F.col("_v")), F.lit(0.5)).alias("outside_median"),
    )
    expected = F.col("outside_median") * F.col("inside_count")
    return q.withColumn("call_index", F.when(expected == 0, F.lit(float("inf"))).otherwise(F.col("inside_sum") / expected)).withColumn(
        "bas", F.col("inside_sum") - F.col("inside_count") * F.col("outside_sum") / F.col("outside_count")
    )


MEASURES = ("inside_sum", "inside_count", "outside_sum", "outside_count", "outside_median", "call_index", "bas")


def _measured(dy, dx, v, radius, cell, buffer):
    """MEASURES of one centre from the pixels around it; None where there is no pixel to measure."""
    box = (dy >= -cell) & (dy < cell) & (dx >= -cell) & (dx < cell)
    far = dy * dy + dx * dx
    inside, outside = v[box & (far <= radius * radius)], v[box & (far > (radius + buffer) ** 2)]
    total, ground = (float(x.sum()) if len(x) else None for x in (inside, outside))
    median = float(np.median(outside)) if len(outside) else None
    expected = None if median is None else median * len(inside)
    index = float("inf") if expected == 0 else None if expected is None or total is None else total / expected
    bas = None if ground is None or total is None else total - len(inside) * ground / len(outside)
    return total, len(inside), ground, len(outside), median, index, bas


def best_centres(pixels, spots, radius, cell, variance=0.33):
    """Every candidate centre around each spot; the one with the highest finite call index is kept.

    A spot collects the pixels that any of its candidates can need once, at most (2 (cell + reach))^2 of them, and all its
    candidates are measured on these.
    """
    reach = int(variance * radius)
    shifts = range(-reach, reach) if reach else range(1)
    centre = spots.select("image", *[F.col(c).cast("int").alias(c) for c in ("row", "col", "cy", "cx")])
    pixel = F.struct(F.col("_dy").cast("long").alias("dy"), F.col("_dx").cast("long").alias("dx"), F.col("_v").cast("double").alias("v"))
    around = _surroundings(pixels.filter("v is not null"), centre, cell, reach).groupBy(*centre.columns).agg(F.collect_list(pixel).alias("pixels"))

    def order(y, x, index):
        known = 0 if index is None else 1 if index == float("inf") else 2
        return -known, -round(index, 9) if known == 2 else 0.0, y, x

    def choose(batches):
        for batch in batches:
            centres = list(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()))
            dy, dx, v = (x.to_numpy(zero_copy_only=False) for x in batch.column(5).flatten().flatten())
            ends = np.concatenate([[0], np.cumsum(batch.column(5).value_lengths().to_numpy(zero_copy_only=False))])
            spot, best = [], []
            for k, (cy, cx) in enumerate(centres):
                at = slice(ends[k], ends[k + 1])
                tried = [(cy + sy, cx + sx, *_measured(dy[at] - sy, dx[at] - sx, v[at], radius, cell, 0)) for sy in shifts for sx in shifts]
                tried = [t for t in tried if t[3] or t[5]]
                if tried:
                    spot.append(k)
                    best.append(min(tried, key=lambda t: order(t[0], t[1], t[7])))
            columns = [pa.array(c, t) for c, t in zip(zip(*best), types)] if best else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(pa.array(spot, pa.int64())) for i in range(3)], *columns], names=names)

    small, long, double = pa.int32(), pa.int64(), pa.float64()
    types = [small, small, double, long, double, long, double, double, double]
    names = [*centre.columns, *MEASURES]
    kinds = [*[kind for _, kind in centre.dtypes], "double", "long", "double", "long", "double", "double", "double"]
    return around.mapInArrow(choose, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))
