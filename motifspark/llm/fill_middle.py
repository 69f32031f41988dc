"""Fill-in-middle transformation over a sparse index of the characters that are not ASCII.

Cuts are drawn in lines or in characters but made in bytes. Instead of a table with a place for every character, the index
of a batch holds only its multibyte characters: where each begins and how many bytes it takes beyond one. Between two of
them a character is a byte, so a binary search for the exceptions before a cut and one subtraction turn a place in bytes
into one in characters, and one addition turns it back. A batch is indexed as one buffer; a text is a range of it.

The draws of a row depend on its doc_id and the seed alone, so a repeated task cuts at the same places.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes of text that are indexed together.
SLICE = 8 << 20


class Exceptions:
    """The characters of a UTF-8 buffer that take more than one byte."""

    def __init__(self, buffer):
        self.at = np.flatnonzero(buffer >= 0xC0)
        first = buffer[self.at]
        extra = 1 + (first >= 0xE0) + (first >= 0xF0).astype(np.int64)
        self.excess = np.concatenate([[0], np.cumsum(extra)])
        self.ordinal = self.at - self.excess[:-1]

    def characters(self, place):
        """Characters before places in bytes, each at the begin of a character."""
        return place - self.excess[np.searchsorted(self.at, place)]

    def bytes(self, ordinal):
        """Places in bytes of characters by number."""
        return ordinal + self.excess[np.searchsorted(self.ordinal, ordinal)]


class Units:
    """Lines or characters of the texts of a buffer, `start` to `end` each."""

    def __init__(self, buffer, start, end, unit):
        self.start, self.end, self.unit = start, end, unit
        self.index = Exceptions(buffer)
        if unit == "line":
            self.breaks = np.flatnonzero(buffer == 10)
            self.first = np.searchsorted(self.breaks, start)
            self.full = np.searchsorted(self.breaks, end) - self.first
            ended = np.zeros(len(start), bool)
            some = end > start
            ended[some] = buffer[end[some] - 1] == 10
            self.n = self.full + (some & ~ended)
        elif unit == "char":
            self.first = self.index.characters(start)
            self.n = self.index.characters(end) - self.first
        else:
            raise ValueError(f"unit must be line or char, not {unit}")

    def place(self, k):
        """Place in bytes behind the first `k` units of each text."""
        if self.unit == "char":
            return self.index.bytes(self.first + k)
        if not len(self.breaks):
            return np.where(k > 0, self.end, self.start)
        at = self.breaks[np.clip(self.first + k - 1, 0, len(self.breaks) - 1)] + 1
        return np.where(k == 0, self.start, np.where(k <= self.full, at, self.end))


def slices(column, limit):
    """Ranges of rows with about `limit` bytes each, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield at, to
        at = to


def bytes_of(column):
    """The bytes of a binary column as one array, and the start and end of each row in it; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buffer = np.frombuffer(data, np.uint8)[: bounds[-1]] if data is not None and len(bounds) else np.empty(0, np.uint8)
    buffer = buffer[bounds[0] :]
    return buffer, bounds[:-1] - bounds[0], bounds[1:] - bounds[0]


def rearranged(text, draws, unit, rate, spm, marks):
    """(n, form, prefix_chars, middle_chars, output) of a slice of rows."""
    buffer, start, end = bytes_of(text)
    units = Units(buffer, start, end, unit)
    hexes = draws.to_pylist()
    h = np.array([[int(x[k : k + 8], 16) for k in (0, 8, 16, 24)] for x in hexes], np.int64).reshape(-1, 4)
    cuts = np.sort(h[:, :2] % (units.n[:, None] + 1), axis=1)
    one, two = units.place(cuts[:, 0]), units.place(cuts[:, 1])
    begin, left, right = (units.index.characters(x) for x in (start, one, two))
    raw, (p, s, m) = buffer.tobytes(), [x.encode() for x in marks]
    form, output = [], []
    for k, (a, b, c, d) in enumerate(zip(start.tolist(), one.tolist(), two.tolist(), end.tolist())):
        whole = raw[a:d]
        if not whole or h[k, 2] % 100 >= rate or p in whole or s in whole or m in whole:
            form.append("plain")
            output.append(whole)
        elif h[k, 3] % 100 < spm:
            form.append("spm")
            output.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c])))
        else:
            form.append("psm")
            output.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c])))
    plain = np.array([f == "plain" for f in form], bool)
    return (pa.array(units.n.astype(np.int64)), pa.array(form, pa.string()), pa.array(left - begin, pa.int64(), mask=plain),
            pa.array(right - left, pa.int64(), mask=plain), pa.array(output, pa.binary()).view(pa.string()))


def transform(docs, unit="line", seed=7, rate=100, spm=50, marks=MARKS, keep=("doc_id",)):
    """`keep` columns of every row with n (units of its text), form, prefix_chars, middle_chars and output.

    `rate` percent of the rows are rearranged, `spm` percent of these with the suffix first. Rows without text (null or
    empty) and those that hold a mark stay as they are: form plain, no lengths, output the text, empty for null. A null
    doc_id draws as an empty one; equal ids draw alike. Repeated rows are answered one by one.
    """
    keep, marks = list(keep), tuple(marks)
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], draw.alias("draw"), F.col("text").cast("string").cast("binary").alias("text"))

    def run(batches):
        names = [*keep, "n", "form", "prefix_chars", "middle_chars", "output"]
        for batch in batches:
            text, draws = batch.column(len(keep) + 1), batch.column(len(keep))
            for at, to in slices(text, SLICE):
                found = rearranged(text.slice(at, to - at), draws.slice(at, to - at), unit, rate, spm, marks)
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(at, to - at) for i in range(len(keep))] + list(found), names=names)

    added = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
             T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
    return rows.mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + added))


def restored(output="output", form="form", marks=MARKS):
    """The text as a column, from output and form alone.

    A rearranged text holds no mark and marks do not overlap one another, so each stands once in its output.
    """
    out, kind = F.col(output), F.col(form)
    p, s, m = marks

    def between(one, other=None):
        rest = F.substring_index(out, one, -1)
        return F.substring_index(rest, other, 1) if other else rest

    psm = F.concat(between(p, s), between(m), between(s, m))
    spm = F.concat(between(p, m), between(m), between(s, p))
    return F.when(kind == "psm", psm).when(kind == "spm", spm).otherwise(out)


def digest(rows, keep=("doc_id",)):
    """What the transformation gave, with digests of output and of the text that is rebuilt from it."""
    return rows.select(*keep, "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(restored().cast("binary"), 256).alias("restored_sha256"))
