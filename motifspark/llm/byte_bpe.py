"""Byte-level BPE encoding and decoding in two tiers.

The pattern cuts a text into pre-tokens. Those that are a token as a whole are found by a minimal perfect hash over the
vocabulary: as many slots as tokens, one displacement per bucket, and one comparison with the token in the slot. All
others are merged: their bytes are a linked list, a heap holds the ranks of neighbours that form a token, and the lowest
rank, leftmost among equals, is joined until none is left.

The vocabulary is a file of ranks; its path is a parameter and nothing is trained. A batch resolves each distinct
pre-token once, in all texts at a time.
"""

import base64
import functools
import heapq
import re
import sys
import unicodedata
from itertools import accumulate
from operator import eq
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motifspark.llm.fill_middle import slices
from motifspark.llm.text import STEP, mix

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Bytes of text whose pre-tokens are resolved together; ids that are decoded together.
SLICE, DECODED = 2 << 20, 1 << 20
#: Merged pre-tokens that a worker remembers in each of two generations, and the longest of them in bytes.
CACHE, REMEMBERED = 250_000, 64
#: Keys per bucket of the perfect hash, and displacements tried at once.
BUCKET, TRIES = 4, 128


class PerfectHash:
    """A minimal perfect hash of distinct byte strings: `slots` numbers them from 0 without gaps, unknown ones arbitrarily."""

    def __init__(self, keys):
        keys, self.seed = list(keys), 0
        self.size = len(keys)
        while len(set(h := self.hashed(keys).tolist())) < len(keys):
            self.seed += 1
        h = np.array(h, np.uint64)
        self.shift = np.zeros(max(1, -(-len(keys) // BUCKET)), np.int64)
        bucket = (h % np.uint64(len(self.shift))).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        count = np.bincount(bucket, minlength=len(self.shift))
        begin = np.cumsum(count) - count
        taken = np.zeros(len(keys), bool)
        for b in np.argsort(-count, kind="stable").tolist():
            if count[b] < 2:
                break
            own, first = h[order[begin[b] : begin[b] + count[b]]], 0
            while True:
                at = np.sort(self.place(own, np.arange(first, first + TRIES)[:, None]), axis=1)
                good = ~taken[at].any(axis=1) & (at[:, 1:] != at[:, :-1]).all(axis=1)
                if good.any():
                    t = int(good.argmax())
                    self.shift[b], taken[at[t]] = first + t, True
                    break
                first += TRIES
        alone = np.flatnonzero(count == 1)  # these take what is left
        self.shift[alone] = -1 - np.flatnonzero(~taken)

    def hashed(self, keys):
        return np.fromiter((xxhash.xxh3_64_intdigest(k, self.seed) for k in keys), np.uint64, len(keys))

    def place(self, h, shift):
        return (mix(h + shift.astype(np.uint64) * STEP) % np.uint64(self.size)).astype(np.int64)

    def slots(self, keys):
        if not self.size:
            return np.zeros(len(keys), np.int64)
        h = self.hashed(keys)
        shift = self.shift[(h % np.uint64(len(self.shift))).astype(np.int64)]
        return np.where(shift < 0, -1 - shift, self.place(h, np.maximum(shift, 0)))


def read_ranks(path):
    """Rank of each token, from a file of the driver."""
    with open(path, "rb") as file:
        pairs = [(base64.b64decode(token), int(rank)) for token, rank in map(bytes.split, filter(bytes.strip, file))]
    ranks = dict(pairs)
    if len(ranks) < len(pairs) or len(set(ranks.values())) < len(pairs) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a vocabulary needs every byte as a token, and one rank for each token")
    return ranks


@functools.cache
def newer_letters():
    """Characters that are letters or numbers for `regex` but, being of a later Unicode version, not for the library.

    Each candidate behind a letter and behind a digit is a token of a trial vocabulary: one id means one pre-token.
    """
    late = "".join(chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn")
    late = regex.findall(r"[\p{L}\p{N}]", late)
    words = [before + c for c in late for before in "a1"]
    ranks = {bytes([b]): b for b in range(256)} | {w.encode(): 256 + k for k, w in enumerate(words)}
    trial = tiktoken.Encoding("trial", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    known = {w[1] for w in words if len(trial.encode_ordinary(w)) == 1}
    return "".join(c for c in late if c not in known)


class Vocabulary:
    """Ranks, pattern, perfect hash, and the tokens in the order of its slots; sent to the tasks as plain data."""

    def __init__(self, ranks, pattern=public_tokenizers.PATTERN):
        self.ranks, self.pattern, self.newer = ranks, pattern, newer_letters()
        self.hash = PerfectHash(ranks)
        self.tokens = [b""] * len(ranks)
        for token, slot in zip(ranks, self.hash.slots(list(ranks)).tolist()):
            self.tokens[slot] = token

    def encoder(self):
        """The worker's encoder; a broadcast vocabulary keeps it, with what it has merged, from task to task."""
        if not hasattr(self, "kept"):
            self.kept = Encoder(self)
        return self.kept

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "kept"}


class Encoder:
    """Encoder of a worker."""

    def __init__(self, vocabulary):
        self.vocabulary = vocabulary
        self.ranks, self.tokens = vocabulary.ranks, vocabulary.tokens
        self.first = [self.ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        self.cut = regex.compile(vocabulary.pattern).findall
        newer = vocabulary.newer
        self.late = re.compile(f"[{min(newer)}-{max(newer)}]").search if newer else lambda text: None
        self.signs = dict.fromkeys(map(ord, newer), "\ue000")
        self.merged, self.older = {}, {}

    def pieces(self, text):
        """Pre-tokens of a text; letters that the library does not know yet are cut as the signs they are to it."""
        if not self.late(text):
            return self.cut(text)
        ends = [0, *accumulate(map(len, self.cut(text.translate(self.signs))))]
        return [text[a:b] for a, b in zip(ends, ends[1:])]

    def merge(self, raw):
        """Ids of a pre-token that is no token itself."""
        rank, n = self.ranks.get, len(raw)
        pop, push = heapq.heappop, heapq.heappush
        end = list(range(1, n + 1))  # of the part that begins here
        before = list(range(-1, n))  # begin of the part that ends here, at the begin of the next
        current = [self.first[a << 8 | b] for a, b in zip(raw, raw[1:])]  # rank of a part and the next one
        current.append(-1)
        heap = [r << 40 | i for i, r in enumerate(current) if r >= 0]
        heapq.heapify(heap)
        while heap:
            top = pop(heap)
            i = top & 0xFFFFFFFFFF
            if current[i] != top >> 40:
                continue  # its parts have grown since
            j = end[i]
            end[i] = after = end[j]
            current[j] = new = -1
            if after < n:
                before[after] = i
                new = rank(raw[i : end[after]], -1)
                if new >= 0:
                    push(heap, new << 40 | i)
            current[i] = new
            p = before[i]
            if p >= 0:
                current[p] = new = rank(raw[p:after], -1)
                if new >= 0:
                    push(heap, new << 40 | p)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def resolve(self, pieces):
        """Ids of distinct pre-tokens, as the bytes of 32-bit integers."""
        pieces = list(pieces)
        raws = [p.encode() for p in pieces]
        slots = self.vocabulary.hash.slots(raws).tolist()
        out, kept, older = {}, self.merged, self.older.get
        for piece, raw, whole in zip(pieces, raws, map(eq, raws, map(self.tokens.__getitem__, slots))):
            if whole:
                out[piece] = self.ranks[raw].to_bytes(4, "little")
                continue
            ids = kept.get(piece)
            if ids is None:
                ids = older(piece)
                if ids is None:
                    merged = self.merge(raw)
                    ids = pack(f"<{len(merged)}i", *merged)
                if len(raw) <= REMEMBERED:
                    kept[piece] = ids
            out[piece] = ids
        if len(kept) > CACHE:  # what is still used comes back from the older generation
            self.merged, self.older = {}, kept
        return out

    def encode(self, texts):
        """Ids of all texts (bytes or None) as one array, and the bounds of each text in it."""
        parts = [self.pieces(t.decode("utf-8", "replace")) if t else [] for t in texts]
        known = self.resolve(set().union(*parts)).__getitem__
        found = [b"".join(map(known, p)) for p in parts]
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)])
        return np.frombuffer(b"".join(found), "<i4"), bounds


def encode(docs, ranks=RANKS, pattern=public_tokenizers.PATTERN, keep=("doc_id",)):
    """`keep` columns of every row with the ids of its text, without special tokens; null and empty texts have none.

    Repeated rows are answered one by one. Bytes that are no UTF-8 count as U+FFFD. The vocabulary is broadcast; its size
    does not depend on the data.
    """
    vocabulary, keep = docs.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(ranks), pattern)), list(keep)

    def run(batches):
        encoder = vocabulary.value.encoder()
        for batch in batches:
            text = batch.column(len(keep))
            for at, to in slices(text, SLICE):
                ids, bounds = encoder.encode(text.slice(at, to - at).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(at, to - at) for i in range(len(keep))]
                                                 + [pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(ids))], names=[*keep, "ids"])

    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + [T.StructField("ids", T.ArrayType(T.IntegerType()))]))


class Tokens:
    """The bytes of all tokens as one array, found by id."""

    def __init__(self, ranks):
        self.start = np.full(max(ranks.values(), default=-1) + 1, -1, np.int64)
        self.length = np.zeros(len(self.start), np.int64)
        self.flat = np.frombuffer(b"".join(ranks), np.uint8)
        at = np.cumsum([0, *map(len, ranks)])
        ids = np.fromiter(ranks.values(), np.int64, len(ranks))
        self.start[ids], self.length[ids] = at[:-1], np.diff(at)

    def text(self, ids):
        """The bytes of an array of ids, and where each id begins and ends in them."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.start) or (self.start[ids] < 0).any()):
            raise ValueError("an id is not in the vocabulary")
        length = self.length[ids]
        ends = np.concatenate([[0], np.cumsum(length)])
        return self.flat[np.arange(ends[-1]) + np.repeat(self.start[ids] - ends[:-1], length)], ends


def decode(rows, ranks=RANKS, keep=("doc_id",)):
    """`keep` columns of every row with the bytes of its `ids` as `decoded`; null ids give null, no ids no bytes.

    An id that is not in the vocabulary, or null within a row, is an error.
    """
    shared, keep = rows.sparkSession.sparkContext.broadcast(Tokens(read_ranks(ranks))), list(keep)

    def run(batches):
        tokens = shared.value
        for batch in batches:
            column = batch.column(len(keep))
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, at = np.cumsum(size), 0
            while at < len(ends):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + DECODED, "right")))
                some = column.slice(at, to - at)
                flat, ids = some.flatten(), np.concatenate([[0], np.cumsum(size[at:to])])
                if flat.null_count:
                    raise ValueError("an id is null")
                text, places = tokens.text(flat.to_numpy(zero_copy_only=False))
                bounds = places[ids].astype(np.int32)
                whole = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(bounds), pa.py_buffer(text)])
                decoded = pc.if_else(some.is_null(), pa.scalar(None, pa.binary()), whole) if some.null_count else whole
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(at, to - at) for i in range(len(keep))] + [decoded], names=[*keep, "decoded"])
                at = to

    picked = rows.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], "ids")
    return picked.mapInArrow(run, T.StructType([rows.schema[c] for c in keep] + [T.StructField("decoded", T.BinaryType())]))


def digest(rows, ranks=RANKS):
    """Number and digest of the ids of every row, and the digest of the bytes that they decode to."""
    n, ids = F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256)
    seen = rows.select("doc_id", "ids", n, ids.alias("ids_sha256"))
    back = decode(seen, ranks, keep=("doc_id", "n_tokens", "ids_sha256"))
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
