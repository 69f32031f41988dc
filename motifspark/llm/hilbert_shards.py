"""Shards along a Hilbert curve over document metadata, so that files can be pruned by several of them at once.

Each dimension is quantised to `BITS` bits; the cells that occur, at most 2 ** (dimensions * BITS), are counted and put
in the order of the curve. Running counts of the cells give every row its place in the whole order, and runs of that
order are the shards. Only DataFrame functions are used.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from motifspark.session import materialize

BITS = 4
SHARDS = 24
#: Rows of a cell that are numbered by one task; larger cells are cut by a hash of their rows.
PART = 2_000


def then(state, body):
    """`body` over `s`, the struct that `state` gives; one lambda per step keeps the expression as long as its steps."""
    return f"element_at(transform(array({state}), s -> {body}), 1)"


def untwist(axis, q):
    """Step of bit `q` of an axis: where it is set the lower bits of x are inverted, else exchanged with the axis'."""
    low = (1 << q) - 1
    inverted = f"struct(s.x ^ {low} as x, s.y as y, s.z as z)"
    swap = f"((s.x ^ s.{axis}) & {low})"
    y, z = (f"s.{a} ^ {swap}" if a == axis else f"s.{a}" for a in "yz")
    exchanged = "s" if axis == "x" else f"struct(s.x ^ {swap} as x, {y} as y, {z} as z)"
    return f"if((shiftright(s.{axis}, {q}) & 1) = 1, {inverted}, {exchanged})"


def hilbert(x, y, z, bits=BITS):
    """Index of a cell on a three-dimensional Hilbert curve from three integer columns: Gray code of the untwisted axes."""
    expr = f"struct({x} as x, {y} as y, {z} as z)"
    for q in range(bits - 1, 0, -1):
        for axis in "xyz":
            expr = then(expr, untwist(axis, q))
    expr = then(expr, "struct(s.x as x, s.x ^ s.y as y, s.x ^ s.y ^ s.z as z)")
    turn = " ^ ".join(f"if((shiftright(s.z, {q}) & 1) = 1, {(1 << q) - 1}, 0)" for q in range(bits - 1, 0, -1))
    expr = then(expr, f"struct(s.x ^ {turn} as x, s.y ^ {turn} as y, s.z ^ {turn} as z)")
    index = " | ".join(f"shiftleft(shiftright(s.{a}, {q}) & 1, {3 * q + k})" for q in range(bits) for a, k in zip("xyz", (2, 1, 0)))
    return F.expr(then(expr, index))


def level(size, bits=BITS):
    """A size on a scale of half powers of two: 0 to 2 ** bits - 1."""
    return F.least(F.lit(2**bits - 1), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(size, F.lit(1))) - 4))).cast("int")


def name_level(column, bits=BITS):
    """A name's bin by hash; null is a value of its own."""
    return F.when(F.col(column).isNull(), 0).otherwise(F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(2**bits - 1)) + 1).cast("int")


def shard(docs, shards=SHARDS):
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, cell and curve of every row; law `rows`: shard counts differ by one at most.

    The dimensions are source, lang and size. Null text has size 8 and the checksum of no bytes, null source or lang is
    a value of its own, and missing source or lang columns count as null. Equal cells and repeated rows are put in the
    order of a hash and doc_id, rows that are alike in all of these in any order. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text", *[F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("source", "lang")])
    raw = F.col("text").cast("string").cast("binary")
    rows = docs.select(
        "doc_id", (F.coalesce(F.octet_length(raw), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"), name_level("source").alias("x"), name_level("lang").alias("y"))
    rows = rows.withColumn("z", level("size")).withColumn("tie", F.xxhash64("doc_id", "text_crc32"))
    cell = F.col("x") * 4**BITS + F.col("y") * 2**BITS + F.col("z")
    rows = materialize(rows.withColumn("cell", cell.cast("int")), "rows")

    total = rows.count()
    counts = rows.groupBy("cell", "x", "y", "z").agg(F.count("*").alias("n"))
    counts = counts.withColumn("curve", hilbert("x", "y", "z")).select("cell", "curve", "n")
    cells = counts.withColumn("before", F.sum("n").over(Window.orderBy("curve", "cell")) - F.col("n"))  # at most 2 ** 12 rows
    part = F.pmod("tie", F.ceil(F.col("n") / PART)).cast("int")  # a cell has as many parts as its rows ask for
    rows = rows.join(F.broadcast(cells), "cell").withColumn("part", part).drop("n")
    parts = rows.groupBy("cell", "part").agg(F.count("*").alias("m"))
    ahead = F.sum("m").over(Window.partitionBy("cell").orderBy("part")) - F.col("m")
    parts = parts.select("cell", "part", ahead.alias("ahead"))

    within = F.row_number().over(Window.partitionBy("cell", "part").orderBy("tie", "doc_id")) - 1
    placed = rows.withColumn("within", within).join(parts, ["cell", "part"])
    place = F.col("before") + F.col("ahead") + F.col("within")
    low, more = total // shards, total % shards
    edge = more * (low + 1)  # the first `more` shards hold one row more
    number = F.when(place < edge, F.floor(place / F.lit(low + 1))).otherwise(more + F.floor((place - edge) / F.lit(max(low, 1)))).cast("int")
    slot = F.when(place < edge, place % (low + 1)).otherwise((place - edge) % max(low, 1))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), number.alias("shard"), slot.cast("long").alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"), "cell", "curve")
