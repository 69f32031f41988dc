"""Words of a text as 64-bit hashes, and the Arrow plumbing around them."""

import ctypes
import functools
import gc

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

#: Entries of a worker's word cache before it starts anew; bounds memory, never results.
CACHE = 250_000
MIX = np.uint64(0xBF58476D1CE4E5B9)
STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hash of each word seen by this worker."""

    def __missing__(self, word):
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


HASHES = WordHashes()


def hashes(words):
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def mix(x):
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * MIX
    x = (x ^ (x >> np.uint64(29))) * STEP
    return x ^ (x >> np.uint64(32))


def words_of(raw):
    """Runs of bytes other than space and 0x09-0x0D, A-Z in lower case. `bytes.split` and `bytes.lower` know ASCII only."""
    return raw.lower().split() if raw else []


#: Whether a byte stands between words.
BETWEEN = np.zeros(256, bool)
BETWEEN[[0x20, *range(0x09, 0x0E)]] = True
#: Base of the word hash, its inverse, bytes that are hashed together, and the longest word that is hashed with others.
BASE, PIECE, SHORT = 0x9E3779B97F4A7C15, 1 << 18, 64
UNDO = pow(BASE, -1, 1 << 64)


def powers(base, n):
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Powers:
    """Powers of the base and of its inverse, made when a worker first needs them."""

    up = down = None

    @classmethod
    def get(cls):
        if cls.up is None:
            cls.up, cls.down = powers(BASE, PIECE + 1), powers(UNDO, PIECE + 1)
        return cls.up, cls.down


def word_hashes(raws):
    """Hashes of the words of all texts, one after the other, and the bounds of each text among them.

    A word is a polynomial of its bytes. Running sums over the bytes of many texts give all of them at once; a word over
    `SHORT` bytes is hashed by itself.
    """
    text = b"\n".join([raw or b"" for raw in raws]).lower()
    buffer = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(buffer) + 2, np.int8)
    inside[1:-1] = ~BETWEEN[buffer]
    change = np.diff(inside)
    start, end = np.flatnonzero(change > 0), np.flatnonzero(change < 0)
    out = np.empty(len(start), np.uint64)
    up, down = Powers.get()
    at = 0
    while at < len(start):
        first = start[at]
        to = max(at + 1, int(np.searchsorted(end, first + PIECE, "right")))
        if to == at + 1 and end[at] - first > PIECE:
            out[at], at = 0, to  # a long word
            continue
        part = buffer[first : end[to - 1]].astype(np.uint64)
        part += np.uint64(1)
        part *= up[: len(part)]
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum(part, out=total[1:])
        s = start[at:to] - first
        out[at:to] = mix((total[end[at:to] - first] - total[s]) * down[s])
        at = to
    for k in np.flatnonzero(end - start > SHORT).tolist():
        out[k] = xxhash.xxh3_64_intdigest(text[start[k] : end[k]])
    begin = np.cumsum([0] + [len(raw or b"") + 1 for raw in raws])
    return out, np.searchsorted(start, begin)


def shingles_of(h, width=5):
    """Sorted distinct hashes of `width`-word shingles; fewer words make one shingle of all, no words the empty set."""
    if not len(h):
        return np.empty(0, np.uint64)
    n = max(1, len(h) - width + 1)
    out = np.full(n, np.uint64(min(len(h), width)), np.uint64)
    for k in range(min(len(h), width)):
        out = out * STEP + h[k : k + n]
    out = mix(out)
    out.sort()
    keep = np.empty(n, bool)
    keep[0] = True
    np.not_equal(out[1:], out[:-1], out=keep[1:])
    return out[keep]


def shingle_sets(raws, width=5):
    """The shingle set of each text, in order."""
    h, bounds = word_hashes(raws)
    for a, b in zip(bounds, bounds[1:]):
        yield shingles_of(h[a:b], width)


def shingle_set(raw, width=5):
    return next(shingle_sets([raw], width))


def raw_column(batch, name):
    """A binary column of an Arrow batch as a list of bytes or None."""
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def as_batch(**columns):
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def trim():
    """Hands memory that this worker has freed back to the system, where the C library can do so."""
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free:
        free(0)


def give_back():
    """Frees what is no longer used, such as the tables of a step that this worker served before, and hands it back."""
    gc.collect()
    trim()


def tidy(run):
    """An Arrow map that gives memory back before its task and after it; other steps of a job run beside idle workers."""

    @functools.wraps(run)
    def tidied(batches):
        give_back()
        yield from run(batches)
        trim()

    return tidied


def binary(column="text"):
    return F.col(column).cast("binary").alias(column)


def read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
